"""LM scoring by a Brown class-based bigram model.

A word's probability is that of its class after the class before, times that of the word in its class. Classes come from exchange clustering.
The most frequent words (the core; its size grows with the root of the vocabulary up to ``CORE``) are exchanged one by one, each to the class
that raises the likelihood of the class bigrams most, until none moves. All other words are then exchanged together in ``ROUNDS`` rounds: in the
first each goes to the class that fits its core neighbours best, in the next to the one that fits all its neighbours in the corpus, at
the class bigrams of the round before. A neighbour that has no class yet doesn't count, and a word that sees no other stays in a state of its own,
the rest. Where ``CORE`` keeps words out of the core, a closing round exchanges all words outside it once more, and the rest counts as a
neighbour like the classes: then each word of a training text has two neighbours that count, and a class. Transitions and emissions are counted over all training tokens with these classes and smoothed by
addition. A word that training lacks is summed over the classes it may belong to, and leaves the state as it was.

Texts are read once. A task cuts its texts into chunks of about ``CHUNK_BYTES`` and writes each as numbers of the chunk's words to a file in the
shared folder; the words go, once for each chunk, to a bucket by their hash. A bucket adds up its words over all chunks, remembers the order in
which they came in a file of its own, and answers each chunk in that order: so after the first step no word is sent again, only a few
bytes for each word of a chunk. Rows name the files of finished tasks; files of lost ones are never read. Nothing that grows with the corpus is
broadcast or collected: the driver sees at most CORE squared bigrams, class bigrams and class sizes. A word that is in every text is one
entry for each chunk. All counts are whole numbers, so results don't depend on how rows are dealt to files and tasks.

Defined results: null and empty texts are one end token; a row with a null identifier is scored, held_out false, and not learned from;
repeated rows count each time; without training rows the base has N = V = 0 and score uses uniform classes; an empty table gives an empty
result; further columns are not read.
"""

from __future__ import annotations

import json
import math
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_rows, crc_mod, load, new_path, parts, release, released, save, scratch_path, stored, table, text_bytes

CHUNK_BYTES, BUCKET_BYTES = 16 << 20, 8 << 20
#: Texts that go to a worker at a time.
TEXTS = 500
#: Bounds of the core and of the classes, which are the cube root of the vocabulary.
CORE, CLASSES, SWEEPS, ROUNDS = 1024, (8, 64), 12, 2
UNKNOWN = 255
ADD = 0.1
#: Rows of a bucket's words whose neighbours are added up at a time; pairs of neighbours that are; and bytes and rows sent at a time.
BLOCK, PAIRS, SENT_BYTES, SENT_ROWS = 1 << 15, 1 << 18, 1 << 20, 512


def words(text: bytes) -> list[bytes]:
    return text.lower().split()


def core_size(types: int) -> int:
    return min(CORE, max(64, 2 * math.isqrt(types)))


def capped(types: int) -> bool:
    """Whether CORE keeps words out of the core."""
    return 2 * math.isqrt(types) > CORE


def class_count(types: int) -> int:
    return max(CLASSES[0], min(CLASSES[1], round(types ** (1 / 3))))


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows by a hash of key: a row may stand for megabytes of a file, so partitions must not be joined for their few bytes."""
    return rows.repartition(parts(rows.sparkSession), key)


# the first step: chunks, buckets

#: a chunk's words of one bucket; or, with bucket -1, the chunk itself (a: its file, train: its training texts)
SENT = "chunk long, bucket int, a binary, b binary, n binary, train long"


def _rows(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def _sent(schema: str, rows):
    """Rows in batches: with many buckets there are very many small ones, and a batch for each costs the JVM more than its bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if size >= SENT_BYTES or len(held) >= SENT_ROWS:
            yield _rows(schema, *zip(*held))
            held, size = [], 0
    if held:
        yield _rows(schema, *zip(*held))


def chunked(docs: DataFrame, folder: str, buckets: int, chunk_bytes: int) -> DataFrame:
    """Reads docs (doc_id, text, train, held_out) and writes the chunks' files. Words are numbered by bucket."""

    def run(batches):
        seq = count(TaskContext.get().partitionId() << 32)
        index, ids, held, size = defaultdict(count().__next__), [], [], 0
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), text_bytes(batch, "text"), batch.column(2).to_pylist(), batch.column(3).to_pylist())
            for doc_id, text, train, out in rows:
                w = words(text)
                ids.append(np.fromiter(map(index.__getitem__, w), np.uint32, len(w)))
                held.append((doc_id, train, out))
                size += len(text) + 64
                if size >= chunk_bytes:
                    yield from done(next(seq), index, ids, held)
                    index, ids, held, size = defaultdict(count().__next__), [], [], 0
        if held:
            yield from done(next(seq), index, ids, held)

    def done(chunk, index, ids, held):
        own = list(index)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        bucket = (np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(own), np.uint32)
        place[order] = np.arange(len(own), dtype=np.uint32)
        flat = place[flat]
        train = np.array([t for _, t, _ in held], bool)
        n = np.bincount(flat[np.repeat(train, lengths)], minlength=len(own))
        path = new_path(folder, "chunk")
        save(
            path, ids=flat, lengths=lengths, train=train, out=np.array([o for _, _, o in held], bool), named=np.array([d is not None for d, _, _ in held], bool),
            doc=np.array([d or 0 for d, _, _ in held], np.int64), buckets=(sizes := np.bincount(bucket, minlength=buckets)).astype(np.int32),
        )
        yield _rows(SENT, [chunk], [-1], [path.encode()], [b""], [b""], [int(train.sum())])
        yield from _sent(SENT, of_buckets(chunk, own, order, n, sizes))

    def of_buckets(chunk, own, order, n, sizes):
        at = 0
        for b in np.flatnonzero(sizes).tolist():
            some = [own[i] for i in order[at : at + sizes[b]].tolist()]
            yield chunk, b, b"".join(some), np.fromiter(map(len, some), "<u4", len(some)).tobytes(), n[at : at + sizes[b]].astype("<u4").tobytes(), 0
            at += int(sizes[b])

    return stored(docs.select("doc_id", "text", "train", "held_out").mapInArrow(released(run), SENT), "chunks")


#: kind 0: a bucket's file, its known words (n) and their tokens (m); kind 1: one of its most frequent words, by place and digest
TOLD = "kind int, bucket int, path string, place long, n long, m long, digest binary"


def counted(sent: DataFrame, folder: str) -> DataFrame:
    """Adds up each bucket's words. Its file: the place of each chunk's words among them, and their totals."""

    def run(key, group):
        group = group.sort_by("chunk")
        sizes = np.array([len(x) // 4 for x in group.column("b").to_pylist()], np.int64)
        lengths = np.frombuffer(b"".join(group.column("b").to_pylist()), "<u4")
        n = np.frombuffer(b"".join(group.column("n").to_pylist()), "<u4")
        offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        data = b"".join(group.column("a").to_pylist())
        own = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)]).dictionary_encode()
        place = own.indices.to_numpy()
        total = np.bincount(place, n, len(own.dictionary)).astype(np.int64)
        path = new_path(folder, "bucket")
        save(path, place=place.astype(np.int32), chunks=group.column("chunk").to_numpy(), sizes=sizes, total=total)
        least = np.partition(total, -CORE)[-CORE] if len(total) > CORE else 1
        top = np.flatnonzero(total >= max(1, least))
        digests = [xxhash.xxh3_128_digest(w) for w in own.dictionary.take(pa.array(top)).to_pylist()]
        k, bucket = len(top), key[0].as_py()
        out = _rows(TOLD, [0] + [1] * k, [bucket] * (k + 1), [path] + [None] * k, [0, *top.tolist()], [int((total > 0).sum()), *total[top].tolist()], [int(total.sum())] + [0] * k, [b"", *digests])
        return pa.Table.from_batches([out])

    return stored(_dealt(sent.where("bucket >= 0"), "bucket").groupBy("bucket").applyInArrow(run, TOLD), "buckets")


# answers to chunks: one blob of a bucket; with bucket -1 the chunk's files; with chunk -1 a class (bucket), its tokens and its known words

ANSWER = "chunk long, bucket int, a binary, b binary, n long, m long"
#: kind 0: a chunk with its files; kind 1: a pair of states and its count
SETTLED = "kind int, chunk long, files binary, pair long, n long"


def first_answers(buckets: DataFrame, core: dict[int, list[tuple[int, int]]]) -> DataFrame:
    """Each chunk's words' totals, and which of them are in the core. core: of each bucket, places and numbers."""

    def run(batches):
        for batch in batches:
            for bucket, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                f = load(path)
                tags = np.full(len(f["total"]), -1, "<i2")
                for place, number in core.get(bucket, ()):
                    tags[place] = number
                yield from _sent(ANSWER, _answers(bucket, f, tags, f["total"].astype("<i8")))

    return _dealt(buckets.where("kind = 0").select("bucket", "path"), "bucket").mapInArrow(released(run), ANSWER)


def _answers(bucket: int, f: dict, tags: np.ndarray, total: np.ndarray | None = None):
    at = 0
    for chunk, size in zip(f["chunks"].tolist(), f["sizes"].tolist()):
        own = f["place"][at : at + size]
        yield chunk, bucket, tags[own].tobytes(), b"" if total is None else total[own].tobytes(), 0, 0
        at += size


def settled(answers: DataFrame, chunks: DataFrame, folder: str, states: int) -> DataFrame:
    """Gathers the answers to each chunk in a file, and counts pairs of neighbours' states (the end of a text is the state ``states``; -1 is
    none) in training texts. chunks: chunk, files."""

    def run(key, group):
        group = group.sort_by("bucket")
        files = json.loads(group.column("a")[0].as_py())
        tags = np.frombuffer(b"".join(group.column("a").to_pylist()[1:]), "<i2")
        if total := b"".join(group.column("b").to_pylist()[1:]):
            files["total"] = new_path(folder, "total")
            save(files["total"], total=np.frombuffer(total, "<i8"))
        files["tags"] = new_path(folder, "tags")
        save(files["tags"], tags=tags)
        files.setdefault("core", files["tags"])
        f = load(files["chunk"])
        seq = sequence(tags[f["ids"][np.repeat(f["train"], f["lengths"])]], f["lengths"][f["train"]], states)[0]
        seen = np.zeros((states + 1) ** 2, np.int64)
        for lo in range(0, len(seq) - 1, PAIRS):
            a, b = seq[lo : lo + PAIRS][: len(seq) - 1 - lo], seq[lo + 1 : lo + 1 + PAIRS]
            both = (a >= 0) & (b >= 0)
            codes, times = np.unique(a[both] * (states + 1) + b[both], return_counts=True)
            seen[codes] += times
        pairs = np.flatnonzero(seen)
        k = len(pairs)
        out = _rows(SETTLED, [0] + [1] * k, [key[0].as_py()] + [None] * k, [json.dumps(files).encode()] + [None] * k, [0, *pairs.tolist()], [0, *seen[pairs].tolist()])
        release()
        return pa.Table.from_batches([out])

    rows = chunks.select("chunk", F.lit(-1).alias("bucket"), F.col("files").alias("a"), F.lit(b"").alias("b"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("m"))
    return stored(_dealt(answers.where("chunk >= 0").unionByName(rows), "chunk").groupBy("chunk").applyInArrow(run, SETTLED), "settled")


def sequence(tags: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Tags of texts' words with an end before the first text and after each, and the words' places in that."""
    ends = np.cumsum(lengths + 1)
    seq = np.full(1 + len(tags) + len(lengths), end, np.int64)
    inside = np.ones(len(seq), bool)
    inside[0] = inside[ends] = False
    at = np.flatnonzero(inside)
    seq[at] = tags
    return seq, at


# rounds

#: what a chunk sends to a bucket: of each word, how many entries follow (a), their sides and states (b), and counts (n). chunk -1: the bucket's file
NEAR = "bucket int, chunk long, a binary, b binary, n binary"


def neighbours(chunks: DataFrame, of: np.ndarray, classes: int) -> DataFrame:
    """Of each word outside the core, the states beside it in training texts: of maps a word's tag to its class (-1: none)."""
    end, side = classes + 1, classes + 2

    def run(batches):
        for batch in batches:
            for chunk, files in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                files = json.loads(files)
                f, tags, core = load(files["chunk"]), load(files["tags"])["tags"], load(files["core"])["tags"]
                ids = f["ids"][np.repeat(f["train"], f["lengths"])]
                known = of[tags]
                seq, at = sequence(known[ids], f["lengths"][f["train"]], end)
                keep = core[ids] < 0
                ids, at = ids[keep], at[keep]
                codes = []
                for beside, shift in ((seq[at - 1], 0), (seq[at + 1], side)):
                    has = beside >= 0
                    codes.append(ids[has].astype(np.int64) * (2 * side) + beside[has] + shift)
                codes = np.concatenate(codes)
                if len(tags) * 2 * side < 1 << 32:
                    codes = codes.astype(np.uint32)  # sorts faster
                codes, times = np.unique(codes, return_counts=True)
                again = (times + 254) // 255  # a byte for each count: greater ones are several entries
                codes, first = np.repeat(codes, again), np.cumsum(again) - again
                counts = np.full(len(codes), 255, np.uint8)
                counts[first + again - 1] = times - 255 * (again - 1)
                entries = np.bincount(codes // (2 * side), minlength=len(tags)).astype("<u4")
                upto = np.concatenate([[0], np.cumsum(entries, dtype=np.int64)])
                codes = (codes % (2 * side)).astype(np.uint8)
                yield from _sent(NEAR, of_buckets(chunk, f["buckets"], entries, upto, codes, counts))

    def of_buckets(chunk, sizes, entries, upto, codes, counts):
        ends = np.cumsum(sizes, dtype=np.int64)
        for b in np.flatnonzero(sizes).tolist():
            lo, hi = int(ends[b] - sizes[b]), int(ends[b])
            x, y = int(upto[lo]), int(upto[hi])
            yield b, chunk, entries[lo:hi].tobytes(), codes[x:y].tobytes(), counts[x:y].tobytes()

    return _dealt(chunks, "chunk").mapInArrow(released(run), NEAR)


def moved(near: DataFrame, buckets: DataFrame, core: dict[int, list[tuple[int, int]]], fit: np.ndarray, rest: int) -> DataFrame:
    """Each bucket gives its words the class that fits their neighbours best, ``rest`` where they have none, and answers the chunks. core:
    of each bucket, places and classes of core words, which stay."""
    classes, side = fit.shape[1], len(fit)

    def run(key, group):
        group = group.sort_by("chunk")
        bucket = key[0].as_py()
        f = load(group.column("a")[0].as_py().decode())
        entries, codes, counts = (np.frombuffer(b"".join(group.column(c).to_pylist()[1:]), kind) for c, kind in (("a", "<u4"), ("b", np.uint8), ("n", np.uint8)))
        place = np.repeat(f["place"], entries)
        tags = np.full(len(f["total"]), rest, "<i2")
        for lo in range(0, len(tags), BLOCK):
            size = min(BLOCK, len(tags) - lo)
            some = (place >= lo) & (place < lo + size)
            seen = np.bincount((place[some] - lo).astype(np.int64) * side + codes[some], counts[some], size * side).reshape(size, side)
            has = seen.any(axis=1)
            tags[lo : lo + size][has] = np.argmax(seen[has] @ fit, axis=1)
        for at, cls in core.get(bucket, ()):
            tags[at] = cls
        known = (tags >= 0) & (f["total"] > 0)
        n, m = np.bincount(tags[known], f["total"][known], classes + 1), np.bincount(tags[known], minlength=classes + 1)
        k = classes + 1
        out = [_rows(ANSWER, [-1] * k, range(k), [b""] * k, [b""] * k, n.astype(np.int64), m), *_sent(ANSWER, _answers(bucket, f, tags))]
        release()
        return pa.Table.from_batches(out)

    files = buckets.where("kind = 0").select("bucket", F.lit(-1).cast("long").alias("chunk"), F.col("path").cast("binary").alias("a"), F.lit(b"").alias("b"), F.lit(b"").alias("n"))
    return stored(_dealt(near.unionByName(files), "bucket").groupBy("bucket").applyInArrow(run, ANSWER), "answers")


# classes


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each core word (the end token, last, keeps the class ``classes``). Words start dealt by rank; each in turn leaves its
    class and enters the one where sum N(c,d) log N(c,d) - sum N(c) log N(c) over both sides grows most."""
    k = len(bigrams) - 1
    of = np.append(np.arange(k) % classes, classes)
    c = classes + 1
    one = np.eye(c)[of]
    n = one.T @ bigrams @ one
    for _ in range(sweeps):
        moved_ = 0
        for w in range(k):
            right, left, own = bigrams[w] @ one, bigrams[:, w] @ one, bigrams[w, w]
            old = of[w]
            right[old] -= own
            left[old] -= own
            n[old] -= right
            n[:, old] -= left
            n[old, old] -= own
            row, col = n.sum(axis=1), n.sum(axis=0)
            gain = (_xlogx(n + right) - _xlogx(n)).sum(axis=1) + (_xlogx(n + left[:, None]) - _xlogx(n)).sum(axis=0)
            d = np.diag(n)
            gain += _xlogx(d + right + left + own) - _xlogx(d + right) - _xlogx(d + left) + _xlogx(d)
            gain -= _xlogx(row + right.sum() + own) - _xlogx(row) + _xlogx(col + left.sum() + own) - _xlogx(col)
            new = int(np.argmax(gain[:classes]))
            if gain[new] <= gain[old] + 1e-9:
                new = old
            n[new] += right
            n[:, new] += left
            n[new, new] += own
            moved_ += new != old
            one[w, old], one[w, new] = 0, 1
            of[w] = new
        if not moved_:
            break
    return of


def affinity(pairs: np.ndarray, classes: int) -> np.ndarray:
    """What a left, then a right neighbour's state adds to the log likelihood of a class, in whole thousandths: sums of these over
    counts are exact, whatever their order."""
    n = pairs + 0.05
    pmi = np.log(n) - np.log(n.sum(axis=1, keepdims=True)) - np.log(n.sum(axis=0, keepdims=True))
    return np.rint(1000 * (np.concatenate([pmi[:, :classes], pmi[:classes].T]) + math.log(n.sum())))


def core_pairs(pairs: np.ndarray, of: np.ndarray, classes: int) -> np.ndarray:
    """Counts of states (classes, the rest, the end) from those of core words."""
    one = np.eye(classes + 2)[np.append(of[:-1], classes + 1)]
    return one.T @ pairs @ one


class Model:
    """Totals, and each class's emission denominator: bounded by the number of classes. States: classes, the rest, the end."""

    def __init__(self, classes: int, ends: int, sums: np.ndarray) -> None:
        """sums: tokens and distinct words of each state; ends: training texts."""
        self.end, self.ends = classes + 1, ends
        self.size, self.types = sums[0].copy(), sums[1].copy()
        self.size[self.end], self.types[self.end] = ends, int(ends > 0)
        self.tokens, self.distinct = int(self.size.sum()), int(self.types.sum())
        self.base = self.tokens + ADD * (self.distinct + 1)
        self.below = self.size + ADD * (self.types + 1)

    def fit(self, pairs: np.ndarray) -> None:
        """pairs: counts of states after states in training texts."""
        prior = (pairs.sum(axis=0) + ADD) / (pairs.sum() + ADD * len(pairs))
        step = (pairs + prior) / (pairs.sum(axis=1, keepdims=True) + 1)
        self.step = np.log10(step)
        self.lost = np.log10(step @ (ADD / self.below))

    def told(self, ids: np.ndarray, lengths: np.ndarray, total: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each text: known tokens, base and score. ids: words of all texts; total, tags: of each word."""
        seq, at = sequence(ids, lengths, len(total))
        n = np.append(total, self.ends)[seq[1:]]
        known = n > 0
        state = np.append(tags, self.end)[seq].astype(np.int64)
        last = np.maximum.accumulate(np.where(np.append(True, known), np.arange(len(seq)), -1))
        before, state = state[last[:-1]], state[1:]
        token = np.where(known, self.step[before, state] + np.log10((n + ADD) / self.below[state]), self.lost[before])
        text = np.repeat(np.arange(len(lengths)), lengths + 1)
        return np.bincount(text, known, len(lengths)), np.bincount(text, np.log10((n + ADD) / self.base), len(lengths)), np.bincount(text, token, len(lengths))


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, perplexity double"


def scored(chunks: DataFrame, model: Model) -> DataFrame:
    """score: the log10 probability of the text; perplexity: a token's."""

    def run(batches):
        for batch in batches:
            for files in map(json.loads, batch.column(1).to_pylist()):
                f, tags = load(files["chunk"]), load(files["tags"])["tags"]
                total = load(files["total"])["total"] if "total" in files else np.zeros(0, np.int64)
                ends = np.cumsum(f["lengths"])
                at = 0
                while at < len(ends):  # some texts at a time
                    start = ends[at] - f["lengths"][at]
                    upto = max(at + 1, int(np.searchsorted(ends, start + (1 << 20))))
                    lengths = f["lengths"][at:upto]
                    known, base, score = model.told(f["ids"][start : ends[upto - 1]], lengths, total, tags)
                    perplexity = 10.0 ** np.minimum(300.0, -score / (lengths + 1))
                    doc = pa.array(f["doc"][at:upto], mask=~f["named"][at:upto])
                    columns = [doc, pa.array(f["out"][at:upto]), pa.array(lengths + 1), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score), pa.array(perplexity)]
                    yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCORED.split(", ")])
                    at = upto

    return _dealt(chunks, "chunk").mapInArrow(released(run), SCORED)


def _pairs(settled_: DataFrame, states: int) -> np.ndarray:
    """The summed pairs of states: at most (states + 1) squared rows."""
    got = settled_.where("kind = 1").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((states + 1) ** 2)
    out[got["pair"].to_numpy(int)] = got["n"].to_numpy(float)
    return out.reshape(states + 1, states + 1)


def _chunks(settled_: DataFrame) -> DataFrame:
    return settled_.where("kind = 0").select("chunk", "files")


def score_texts(docs: DataFrame) -> tuple[DataFrame, Model]:
    """docs: doc_id, text, train, held_out. A row for each row, and the model."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "words")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    with batch_rows(spark, TEXTS):
        sent = chunked(docs, folder, max(parts(spark), -(-size // BUCKET_BYTES)), CHUNK_BYTES)
    buckets = counted(sent, folder)
    sums = buckets.where("kind = 0").agg(F.sum("n").alias("types")).first()
    ends = sent.where("bucket = -1").agg(F.sum("train")).first()[0] or 0
    types = sums["types"] or 0
    classes = class_count(types)
    top = buckets.where("kind = 1").orderBy(F.desc("n"), "digest").limit(core_size(types)).select("bucket", "place").collect()
    numbers, of_core = defaultdict(list), defaultdict(list)
    for i, r in enumerate(top):
        numbers[r["bucket"]].append((r["place"], i))
    own = sent.where("bucket = -1").select("chunk", F.to_json(F.struct(F.col("a").cast("string").alias("chunk"))).cast("binary").alias("files"))
    step = settled(first_answers(buckets, dict(numbers)), own, folder, len(top))
    bigrams = _pairs(step, len(top))
    of = exchange(bigrams, classes)
    for i, r in enumerate(top):
        of_core[r["bucket"]].append((r["place"], int(of[i])))
    pairs, tag_class = core_pairs(bigrams, of, classes), np.append(of[:-1], -1)  # the last is that of tag -1
    for i in range(ROUNDS + capped(types)):
        answers = moved(neighbours(_chunks(step), tag_class, classes), buckets, dict(of_core), affinity(pairs, classes), classes if i >= ROUNDS - 1 else -1)
        step = settled(answers, _chunks(step), folder, classes + 1)
        pairs, tag_class = _pairs(step, classes + 1), np.append(np.arange(classes + 1), -1)
    told = np.zeros((2, classes + 2))
    for r in answers.where("chunk = -1").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).collect():
        told[:, r["bucket"]] = r["n"], r["m"]
    model = Model(classes, ends, told)
    model.fit(pairs)
    return scored(_chunks(step), model), model


def op1_brown_class_lm(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rest = crc_mod("doc_id", 10)
    found, model = score_texts(docs.withColumns({"train": F.coalesce(rest != 0, F.lit(False)), "held_out": F.coalesce(rest == 0, F.lit(False))}))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
