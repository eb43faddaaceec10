"""SimHash near-dedup over a byte-position inverted index with count filtering.

A fingerprint is 64 majority bits of its shingles' hashes, so 8 byte positions. Fingerprints that differ in at most k bits agree in at
least 8 - k whole bytes: the guaranteed minimum. The index lists fingerprints under their positional bytes, in two steps. A list for one
position over the whole corpus would hold 1/256 of all fingerprints, and its pairs would grow with the square of the input; so with the
positions in k + 2 runs a posting is two whole runs' bytes (at least two runs are untouched by k differing bytes), and pairs that can reach the
minimum meet in at least one. Inside a posting, the fingerprints are listed by their byte at each position that is left; every list a pair shares
adds to its count, and only pairs whose count and the posting's own bytes reach the minimum are verified by their differing bits.

Equal fingerprints are one entry. A posting leaves only a spanning forest of its verified links, not its pairs; one with more than
``POSTING`` entries is dealt into blocks, and each pair of blocks is a posting of its own, so no task holds an unbounded list.

Defined results: null and empty texts have fingerprint zero and are linked like any other; texts shorter than a shingle are one
shingle; repeated identifiers are one node; a row with a null identifier is given its fingerprint, counts as no node, and has the
component of the other rows with its fingerprint, or null; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, parts, released, stored, table, text_bytes
from .components import components, forest

BITS = 2
SHINGLE = 3
SEED = 42
POSTING = 2048
#: Links that are held before they are reduced to a forest.
HELD = 1 << 20
#: Possible pairs whose shared bytes are counted at a time.
PAIRS = 1 << 22


def hashes(text: bytes, words: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, max(1, len(w) - words + 1))


def fingerprint(h: np.ndarray) -> int:
    """Bit i is 1 if set in over half of h."""
    if not len(h):
        return 0
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int.from_bytes(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, key: str, text: str, words: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def mark(batches):
        for batch in batches:
            fps = np.array([fingerprint(hashes(t, words, seed)) for t in text_bytes(batch, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(released(mark), "doc_id long, fp long")


def runs_of(bits: int) -> list[tuple[int, ...]]:
    """The positions of each posting: two of bits + 2 runs. Those left must take part in the count, so bits may be 3 at most."""
    if not 0 <= bits <= 3:
        raise ValueError("bits must be 0 to 3")
    runs = bits + 2
    cuts = [8 * i // runs for i in range(runs + 1)]
    return [(*range(cuts[i], cuts[i + 1]), *range(cuts[j], cuts[j + 1])) for i in range(runs) for j in range(i + 1, runs)]


def postings(entries: DataFrame, bits: int) -> DataFrame:
    """posting, value, fp, node: under each pair of runs of byte positions, the bytes there."""
    masks = [sum(0xFF << 8 * p for p in own) for own in runs_of(bits)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return entries.select("fp", "node", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("posting", "value"))


def links(entries: DataFrame, bits: int = BITS) -> DataFrame:
    """entries: fp (distinct), node. Spanning links (a, b) between the nodes of fingerprints that differ in at most ``bits`` bits."""
    listed = postings(entries, bits)
    long_ = listed.groupBy("posting", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > POSTING)
    blocks = F.ceil(F.col("n") / (POSTING // 2)).cast("int")
    dealt = listed.join(long_, ["posting", "value"], "left").withColumn("k", F.coalesce(blocks, F.lit(1)))
    dealt = dealt.withColumn("i", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.select("posting", "value", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "fp", "node")
    keys = ["posting", "value", "i", "j"]
    n = parts(entries.sparkSession)
    return dealt.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(released(lambda batches: _verified(batches, bits)), "a long, b long")


def _verified(batches, bits):
    """Streams postings, which are runs of equal keys; a run that a batch's end cuts waits for the next batch."""
    rest = None
    for batch in batches:
        rows = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(6)])
        rows = rows if rest is None else np.concatenate([rest, rows], axis=1)
        if not rows.shape[1]:
            continue
        same = (rows[:4, 1:] == rows[:4, :-1]).all(axis=0)
        last = np.flatnonzero(~same)
        cut = last[-1] + 1 if len(last) else 0
        if cut:
            yield from _pairs(rows[:, :cut], same[: cut - 1], bits)
        rest = rows[:, cut:]
    if rest is not None and rest.shape[1]:
        yield from _pairs(rest, (rest[:4, 1:] == rest[:4, :-1]).all(axis=0), bits)


def tallied(fp: np.ndarray, run: np.ndarray, own: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of entries of one run that share at least ``least`` positional bytes. own: of each entry, the positions that its posting shares
    already. Of every other position the run's entries are listed by their byte there, and each list adds one to its pairs' counts."""
    n, by, codes = len(fp), fp.astype("<u8").view(np.uint8).reshape(-1, 8), [np.zeros(0, np.int64)]
    for p in range(8):
        some = np.flatnonzero(~own[:, p])
        key = run[some] * 256 + by[some, p]
        order = np.argsort(key, kind="stable")
        some, key = some[order], key[order]
        first, d = np.flatnonzero(key[1:] == key[:-1]), 1
        while len(first):
            codes.append(some[first] * n + some[first + d])
            d += 1
            first = first[first + d < len(key)]
            first = first[key[first] == key[first + d]]
    codes = np.concatenate(codes)
    if n * n <= 4 * PAIRS:
        count = np.bincount(codes, minlength=n * n)
        pairs = np.flatnonzero(count)
        count = count[pairs]
    else:
        pairs, count = np.unique(codes, return_counts=True)
    a, b = np.divmod(pairs, n)
    enough = count + own.sum(axis=1)[a] >= least
    return a[enough], b[enough]


def _pairs(rows, same, bits):
    """Spanning links of the verified pairs. Runs are taken together up to PAIRS possible pairs at a time."""
    fp, node = rows[4].view(np.uint64), rows[5]
    n = len(fp)
    run = np.concatenate([[0], np.cumsum(~same)])
    kinds = np.zeros((len(runs_of(bits)), 8), bool)
    for k, positions in enumerate(runs_of(bits)):
        kinds[k, list(positions)] = True
    sizes = np.bincount(run)
    group = (np.cumsum(sizes.astype(float) ** 2) // PAIRS).astype(np.int64)
    ends = np.cumsum(sizes)[np.append(group[1:] != group[:-1], True)]
    root, found, held, lo = np.arange(n), [], 0, 0
    for hi in ends.tolist():
        a, b = tallied(fp[lo:hi], run[lo:hi], kinds[rows[0][lo:hi]], 8 - bits)
        near = np.bitwise_count(fp[lo:hi][a] ^ fp[lo:hi][b]) <= bits
        if near.any():
            found.append(np.stack([a[near], b[near]]) + lo)
            held += found[-1].shape[1]
        if held > HELD:
            found = [np.stack([np.arange(n), root]), *found]
            a, b = np.concatenate(found, axis=1)
            root, found, held = forest(a, b, n), [], 0
        lo = hi
    a, b = np.concatenate([np.stack([np.arange(n), root]), *found], axis=1)
    root = forest(a, b, n)
    out = root != np.arange(n)
    if out.any():
        yield pa.RecordBatch.from_arrays([pa.array(node[out], pa.int64()), pa.array(node[root[out]], pa.int64())], ["a", "b"])


def near_duplicates(docs: DataFrame, key: str, text: str, words: int = SHINGLE, bits: int = BITS, seed: int = SEED) -> DataFrame:
    """doc_id, fp, component_id: the smallest identifier that links of at most ``bits`` differing bits reach."""
    marked = stored(fingerprints(docs, key, text, words, seed), "fingerprints")
    classes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n")), "classes")
    named = classes.where("node IS NOT NULL").select("fp", "node")
    # an identifier on rows of different texts ties their classes together
    many = marked.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("doc_id")
    tied = marked.join(many, "doc_id").distinct().join(named, "fp").select("doc_id", "node")
    ties = tied.join(tied.groupBy("doc_id").agg(F.min("node").alias("b")), "doc_id").select(F.col("node").alias("a"), "b").where("a <> b")
    found = components(links(named, bits).unionByName(ties))
    labels = classes.join(found, "node", "left").select("fp", "n", F.coalesce("component", "node").alias("component_id"))
    return hot_join(marked, labels, "fp", marked.count()).select("doc_id", "fp", "component_id")


def op5_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
