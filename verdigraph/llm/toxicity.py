"""Toxicity by a linear-chain conditional random field.

Labels are of documents; tokens are labelled from them. In a bounded sample of labelled documents a word type is toxic if it has at
least ``CONTEXTS`` different neighbours in toxic documents and is ``RATIO`` times likelier there than in others (counting neighbours,
not occurrences, keeps copies of one document from making its words toxic); its tokens in toxic documents are labelled 1, all others 0.
The field has two states, weights for the word, the word before and the word after, and transitions; it is fitted by gradient on the exact
likelihood (forward-backward). Marginals of all tokens of a whole text aggregate to the expected number of toxic tokens and the two largest
marginals; a logistic curve, fitted on the sample's documents, maps them to a score. Tokens over ``SPAN`` give the offending offsets.

Words are runs of letters, digits and bytes over 127 after lower-casing A-Z, so the score depends on the text alone.

Defined results: a null or empty text has the score of a text without toxic tokens; unlabelled rows, null labels and null identifiers
are scored and not learned from; repeated rows get equal scores; without labelled rows of both kinds every score is the share of
toxic ones (0 if there is none); an empty table gives an empty result; further columns pass through :func:`tagged`.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, released, table, text_bytes

#: The bound of the sample: documents, and bytes of their texts. Whole texts are taken. Toxic words and the curve are learned from all
#: of it; the field's weights from its toxic documents and as many others, up to FIELD_BYTES.
SAMPLE_DOCS, SAMPLE_BYTES, FIELD_BYTES = 6000, 24 << 20, 2 << 20
CONTEXTS, RATIO = 5, 50.0
ROUNDS, STEP, DECAY = 40, 1.0, 1e-6
SPAN = 0.5
THRESHOLD = 0.7
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    """Lower-cased words; translating keeps every byte's place."""
    return text.translate(_LOWER).split()


def sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> list[tuple[bytes, int]]:
    """Labelled texts in order of a hash of their identifiers, up to the bound: two bounded collects."""
    known = labels.where(f"{label} IS NOT NULL AND {key} IS NOT NULL").groupBy(key).agg(F.max(label).alias(label))
    sized = docs.select(key, F.octet_length(text).alias("_n")).where(f"{key} IS NOT NULL").groupBy(key).agg(F.max("_n").alias("_n"))
    first = sized.where(f"coalesce(_n, 0) <= {SAMPLE_BYTES}").join(known, key).orderBy(F.xxhash64(key), key).limit(SAMPLE_DOCS).collect()
    chosen, total = {}, 0
    for r in first:
        if total + (r["_n"] or 0) <= SAMPLE_BYTES:  # one that doesn't fit any more is passed over
            total += r["_n"] or 0
            chosen[r[key]] = int(r[label])
    if not chosen:
        return []
    ids = docs.sparkSession.createDataFrame([(k,) for k in chosen], T.StructType([T.StructField("_k", docs.schema[key].dataType)]))
    got = docs.join(F.broadcast(ids), F.col(key) == F.col("_k")).groupBy(key).agg(F.max(text).alias("t"), F.max(F.octet_length(text)).alias("n")).collect()
    return [((r["t"] or "").encode(), chosen[r[key]]) for r in sorted(got, key=lambda r: r[key]) if (r["n"] or 0) <= SAMPLE_BYTES]


def lexicon(pairs: list[tuple[bytes, int]]) -> set[bytes]:
    """Word types that mark toxic documents. Only words with enough neighbours in toxic ones are counted in the others."""
    seen: dict[bytes, set] = defaultdict(set)
    bad, clean = Counter(), Counter()
    for text, toxic in pairs:
        if toxic:
            w = words(text)
            bad.update(set(w))
            for a, x, b in zip([b"", *w], w, [*w[1:], b""]):
                seen[x].add(hash((a, b)))
    some = {x for x, c in seen.items() if len(c) >= CONTEXTS}
    for text, toxic in pairs:
        if not toxic:
            clean.update(some.intersection(words(text)))
    n_bad = sum(t for _, t in pairs)
    n_clean = len(pairs) - n_bad
    if not n_bad or not n_clean:
        return set()
    return {x for x in some if (bad[x] + 0.5) / (n_bad + 1) >= RATIO * (clean[x] + 0.5) / (n_clean + 1)}


def marginals(e: np.ndarray, first: np.ndarray, a: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """For token scores e (n x 2, log), first tokens of texts, transitions a (2 x 2, log) and starts s (log): each token's probabilities
    (n x 2), each step's joint probabilities from the token before (n x 2 x 2, 0 at first tokens), and the log partition.

    All texts are one sequence: at a first token the step forgets the state before. The sequence is cut into equal lanes; a pass over
    all lanes at once multiplies their 2 x 2 steps, then states are carried from lane to lane, then passes go through the lanes."""
    n = len(e)
    width = max(1, int(np.sqrt(n) / 4))
    lanes = -(-n // width)
    m = np.exp(a)[None] * np.exp(e - e.max(axis=1, keepdims=True))[:, None, :]
    peak = e.max(axis=1).sum()
    m[first] = (np.exp(s) * np.exp(e[first] - e[first].max(axis=1, keepdims=True)))[:, None, :]
    m = np.concatenate([m, np.tile(np.eye(2), (lanes * width - n, 1, 1))]).reshape(lanes, width, 2, 2)
    prod = np.tile(np.eye(2), (lanes, 1, 1))
    for k in range(width):
        prod = prod @ m[:, k]
        prod /= prod.sum(axis=(1, 2), keepdims=True)
    into, out = np.empty((lanes, 2)), np.empty((lanes, 2))
    v = np.array([1.0, 0.0])
    for i in range(lanes):
        into[i] = v
        v = v @ prod[i]
        v = v / v.sum()
    b = np.ones(2)
    for i in range(lanes - 1, -1, -1):
        out[i] = b
        b = prod[i] @ b
        b = b / b.sum()
    alpha, before, scale = np.empty((lanes, width, 2)), np.empty((lanes, width, 2)), np.empty((lanes, width))
    for k in range(width):
        before[:, k] = into
        into = (into[:, :, None] * m[:, k]).sum(axis=1)
        scale[:, k] = into.sum(axis=1)
        into = into / scale[:, k, None]
        alpha[:, k] = into
    beta = np.empty((lanes, width, 2))
    for k in range(width - 1, -1, -1):
        beta[:, k] = out
        out = (m[:, k] * out[:, None, :]).sum(axis=2)
        out = out / out.sum(axis=1, keepdims=True)
    p = (alpha * beta).reshape(-1, 2)[:n]
    p /= p.sum(axis=1, keepdims=True)
    joint = (before[..., None] * m * beta[:, :, None, :]).reshape(-1, 2, 2)[:n]
    joint /= joint.sum(axis=(1, 2), keepdims=True)
    joint[first] = 0
    return p, joint, float(np.log(scale.reshape(-1)[:n]).sum() + peak)


class Field:
    """Weights of known words as themselves, before and after; row 0 is for all other words."""

    def __init__(self, index: dict[bytes, int]) -> None:
        self.index = index
        self.w = np.zeros((3, len(index) + 1))
        self.bias = 0.0
        self.a, self.s = np.zeros((2, 2)), np.zeros(2)
        self.curve = np.zeros(4)

    def rows(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Row of each token of all texts, and the first tokens of texts that have any."""
        lengths = np.array([len(t) for t in texts], np.int64)
        ids = np.empty(lengths.sum(), np.int64)
        at = 0
        for t in texts:
            ids[at : at + len(t)] = np.fromiter(map(self.index.get, t, repeat(0)), np.int64, len(t))
            at += len(t)
        ends = np.cumsum(lengths)
        return ids, (ends - lengths)[lengths > 0]

    def around(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        before, after = np.roll(ids, 1), np.roll(ids, -1)
        before[first] = 0
        after[np.append(first[1:], len(ids)) - 1] = 0
        return before, after

    def scores(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        before, after = self.around(ids, first)
        e = np.zeros((len(ids), 2))
        e[:, 1] = self.bias + self.w[0][ids] + self.w[1][before] + self.w[2][after]
        return e

    def fit(self, texts: list[list[bytes]], y: list[np.ndarray]) -> None:
        ids, first = self.rows(texts)
        if not len(ids):
            return
        told = np.concatenate(y)
        before, after = self.around(ids, first)
        prior = np.ones(len(ids), bool)
        prior[first] = False
        seen = np.zeros((2, 2))
        np.add.at(seen, (told[:-1][prior[1:]], told[1:][prior[1:]]), 1)
        starts = np.bincount(told[first], minlength=2)
        size = self.w.shape[1]
        params = [self.w, np.zeros(1), self.a, self.s]
        sums = [np.zeros_like(p) for p in params]
        for _ in range(ROUNDS):
            self.bias = params[1][0]
            p, joint, _ = marginals(self.scores(ids, first), first, self.a, self.s)
            g = told - p[:, 1]
            grads = [np.stack([np.bincount(x, g, size) for x in (ids, before, after)]), np.array([g.sum()]), seen - joint.sum(axis=0), starts - p[first].sum(axis=0)]
            grads[0][:, 0] = 0
            for x, d, q in zip(params, grads, sums):  # per-weight steps by the sum of squares
                d = d - DECAY * len(ids) * x * (x is not self.w) - 0.01 * x * (x is self.w)
                q += d * d
                x += STEP * d / np.sqrt(q + 1e-8)
        self.bias = params[1][0]

    def tag(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Each text's marginals of the toxic state."""
        ids, first = self.rows(texts)
        if not len(ids):
            return [np.zeros(0) for _ in texts]
        p = marginals(self.scores(ids, first), first, self.a, self.s)[0][:, 1]
        return np.split(p, np.cumsum([len(t) for t in texts])[:-1])

    def score(self, tagged: list[np.ndarray]) -> np.ndarray:
        z = self.curve @ gathered(tagged)
        return 1 / (1 + np.exp(-z))


def gathered(tagged: list[np.ndarray]) -> np.ndarray:
    """1, log of the expected toxic tokens, largest and second largest marginal."""
    top = [np.partition(p, -2)[-2:] if len(p) > 1 else np.append(np.zeros(2 - len(p)), p) for p in tagged]
    return np.array([[1.0, np.log1p(p.sum()), t[1], t[0]] for p, t in zip(tagged, top)]).reshape(-1, 4).T


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method."""
    c = np.zeros(len(x))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(c @ x, -30, 30)))
        h = (x * (p * (1 - p))) @ x.T + ridge * np.eye(len(x))
        c = c + np.linalg.solve(h, x @ (y - p) - ridge * c)
    return c


def fit(pairs: list[tuple[bytes, int]]) -> Field:
    """Texts are split where they are needed and not kept, so the driver holds little more than the sample."""
    bad = lexicon(pairs)
    some, size = [], 0
    for a, b in zip([t for t, y in pairs if y], [t for t, y in pairs if not y]):
        size += len(a) + len(b)
        if size > FIELD_BYTES and some:
            break
        some += [(words(a), 1), (words(b), 0)]
    used, common = set(bad), Counter()
    for w, y in some:
        common.update(w)
        for i, x in enumerate(w):
            if y and x in bad:
                used.update(w[max(0, i - 1) : i + 2])
    used |= {x for x, _ in common.most_common(2000)}
    field = Field({x: i + 1 for i, x in enumerate(sorted(used))})
    field.fit([w for w, _ in some], [np.array([y and x in bad for x in w], np.int64) for w, y in some])
    y = np.array([y for _, y in pairs], float)
    if not len(y):
        field.curve = np.array([-30.0, 0.0, 0.0, 0.0])
    elif 0 < y.sum() < len(y):
        seen = [gathered(field.tag([words(t) for t, _ in pairs[i : i + 256]])) for i in range(0, len(pairs), 256)]
        field.curve = logistic(np.concatenate(seen, axis=1), y)
    else:
        field.curve = np.array([30.0 if y[0] else -30.0, 0.0, 0.0, 0.0])
    return field


def spans(text: bytes, p: np.ndarray) -> list[tuple[int, int]]:
    """Code-point offsets [start, end) of words whose marginal is over SPAN."""
    found, at, low = [], 0, text.translate(_LOWER)
    for i, w in enumerate(low.split()):
        at = low.index(w, at)
        if p[i] > SPAN:
            start = len(text[:at].decode("utf-8", "replace"))
            found.append((start, start + len(w.decode("utf-8", "replace"))))
        at += len(w)
    return found


def tagged(docs: DataFrame, text: str, field: Field) -> DataFrame:
    """docs with _score, _predicted, _spans. The field is a few thousand weights, whatever the input."""
    docs = docs.drop("_score", "_predicted", "_spans")
    schema = T.StructType([*docs.schema.fields, T.StructField("_score", T.DoubleType()), T.StructField("_predicted", T.IntegerType()), T.StructField("_spans", T.ArrayType(T.ArrayType(T.IntegerType())))])
    names = [f.name for f in schema.fields]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = text_bytes(part, text)
                split = [words(t) for t in texts]
                p = field.tag(split)
                score = field.score(p)
                found = [[list(x) for x in spans(t, q)] if len(q) and q.max() > SPAN else [] for t, q in zip(texts, p)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32)), pa.array(found, pa.list_(pa.list_(pa.int32())))], names)

    return docs.mapInArrow(released(run), schema)


def learned(docs: DataFrame, labels: DataFrame) -> Field:
    """The field of rows whose crc32(doc_id as text) mod 3 is not 1."""
    return fit(sample(docs.select("doc_id", "text").where(crc_mod("doc_id", 3) != 1), labels.select("doc_id", "toxic").where(crc_mod("doc_id", 3) != 1), "doc_id", "text", "toxic"))


def op2_crf_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = tagged(docs, "text", learned(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), F.col("_score").alias("score"), F.col("_predicted").alias("predicted"), F.to_json("_spans").alias("spans"))
