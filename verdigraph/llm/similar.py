"""Near-duplicate documents by SimHash over a byte-position index, by least hashes where that guarantees nothing, and an exact check.

Texts with equal 512-bit fingerprints are one entry. The first 64 of these bits are the SimHash of the text's set of shingles, and those go through
the index of ``simhash``: entries that chains of at most ``BITS`` differing bits connect are a posting. Two texts of Jaccard similarity 0.8,
though, differ in some ten of 64 bits (77 of 512), where no count of equal bytes is guaranteed, and no limit of bits tells them from pairs at
0.75. So candidates are also found by their least hashes: a posting is the least values of the shingles under ``ROWS`` hash functions, and there
are ``BANDS`` of them; a pair at 0.8 shares none with chance (1 - 0.8 ** 5) ** 24 = 0.00007, and pairs of unrelated texts hardly ever share
one, however many there are. Each candidate of either kind is decided by the exact similarity of its sets of five-word shingles (64-bit hashes).

First each entry of a posting is compared with the posting's first one, which settles most groups with as many pairs as entries. Then every
pair of entries is compared in each posting whose entries are not yet of one component. One with more than ``POSTING`` entries is dealt into
blocks, and each pair of blocks is compared by itself; only a spanning forest of the links leaves it.

Defined results: null and empty texts are near copies of each other; repeated identifiers are one document; rows with a null identifier take no
part and stay; an empty table gives an empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, released, stored, text_bytes
from .components import components, forest
from .simhash import SEED, hashes
from .simhash import links as near_bits

WORDS = 5
LANES = 8
BYTES = 8 * LANES
#: The least similarity of a link, as a fraction.
SHARED, OF = 4, 5
BANDS, ROWS = 24, 5
#: Differing bits of a link of 64-bit fingerprints.
BITS = 2
POSTING = 512
DEALT = 4096
_RNG = np.random.default_rng(SEED)
_MIX, _TURN = _RNG.integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)
_TURN |= np.uint64(1)


def wide(h: np.ndarray) -> bytes:
    """Majority bits of the hashes and of LANES - 1 mixes of them."""
    out = np.zeros((LANES, 64), np.int64)
    if not len(h):
        return bytes(BYTES)
    h = np.unique(h)
    for lane in range(LANES):
        if lane:
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * lane)
            h = h ^ (h >> np.uint64(29))
        for at in range(0, len(h), 1 << 14):
            some = h[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
            out[lane] += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(out * 2 > len(h), bitorder="little").tobytes()


def least(h: np.ndarray) -> np.ndarray:
    """Postings of a set of hashes: one number for each band of least values. None for an empty set."""
    if not len(h):
        return np.zeros(0, np.int64)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(h), 1 << 12):
        low = np.minimum(low, ((h[at : at + (1 << 12)] ^ _MIX) * _TURN).min(axis=1))
    key = np.arange(BANDS, dtype=np.uint64)
    for row in low.reshape(BANDS, ROWS).T:
        key = (key ^ row) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _marked(batches):
    for batch in batches:
        fps, keys = [], []
        for t in text_bytes(batch, "text"):
            h = np.unique(hashes(t, WORDS, SEED))
            fps.append(wide(h))
            keys.append(least(h))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fps, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "row", "fp", "keys"])


def _sets(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = [np.unique(hashes(t, WORDS, SEED)).astype("<u8").tobytes() for t in text_bytes(part, "text")]
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(sets, pa.binary())], ["node", "row", "h"])


def _verified(batches):
    for batch in batches:
        ok = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            common = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(OF * common >= SHARED * (len(x) + len(y) - common))
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])


def _compared(group: pa.Table) -> pa.Table:
    """All pairs of a block: spanning links."""
    nodes = group.column("node").to_numpy()
    sets = [np.frombuffer(h, "<u8") for h in group.column("h").to_pylist()]
    size = np.array([len(h) for h in sets])
    at = np.concatenate([[0], np.cumsum(size)])
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    a, b = [], []
    for i in range(len(sets) - 1):
        mark = np.zeros(len(values), bool)
        mark[ids[at[i] : at[i + 1]]] = True
        common = np.add.reduceat(mark[ids[at[i + 1] :]], at[i + 1 : -1] - at[i + 1], dtype=np.int64)
        near = i + 1 + np.flatnonzero(OF * common >= SHARED * (size[i] + size[i + 1 :] - common))
        a.append(np.full(len(near), i))
        b.append(near)
    none = [np.zeros(0, np.int64)]
    root = forest(np.concatenate(a + none), np.concatenate(b + none), len(sets))
    out = nodes != nodes[root]
    return pa.table({"a": nodes[out], "b": nodes[root[out]]})


def links(posted: DataFrame, sets: Callable[[DataFrame], DataFrame], ties: DataFrame | None = None) -> DataFrame:
    """posted: key, node. sets: node, h (its sorted hashes) of the nodes given. ties: a, b, links that are known. node, component of the links of nodes that share a posting."""
    many = posted.groupBy("key").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("size", F.col("n"))
    shared = stored(hot_join(posted, many, "key", posted.count()).withColumnRenamed("size", "n"), "shared")
    held = stored(sets(shared.select("node").distinct()), "sets")
    pairs = stored(shared.where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct(), "pairs")
    # a first entry with very many partners is sent to several places, DEALT partners to each
    load = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")).withColumn("places", F.ceil(F.col("n") / DEALT).cast("int"))
    dealt = hot_join(pairs, load, "b", pairs.count()).select("a", "b", F.pmod(F.xxhash64("a"), F.col("places")).cast("int").alias("place"))
    firsts = load.select("b", F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place")).join(held.select(F.col("node").alias("b"), F.col("h").alias("hb")), "b")
    by_a = dealt.join(held.select(F.col("node").alias("a"), F.col("h").alias("ha")), "a")
    both = by_a.join(firsts, ["b", "place"]).select("a", "b", "ha", "hb")
    found = both.mapInArrow(released(_verified), "a long, b long")
    first = components(found.unionByName(ties) if ties else found)
    open_ = shared.join(first, "node", "left").groupBy("key").agg(F.min(F.coalesce("component", "node")).alias("lo"), F.max(F.coalesce("component", "node")).alias("hi")).where("lo <> hi").select("key")
    dealt = shared.join(open_, "key").withColumn("k", F.ceil(F.col("n") / (POSTING // 2)).cast("int")).withColumn("k", F.when(F.col("n") > POSTING, F.col("k")).otherwise(1))
    dealt = dealt.withColumn("i", F.pmod(F.xxhash64("node"), F.col("k")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.select("key", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "node").join(held, "node")
    rest = stored(dealt.groupBy("key", "i", "j").applyInArrow(_compared, "a long, b long"), "rest")
    if rest.isEmpty():
        return first
    return components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(rest))


def by_bits(entries: DataFrame) -> DataFrame:
    """entries: node, fp (wide). key, node: postings of entries whose 64-bit fingerprints are connected by at most BITS differing bits; none
    of a single entry."""
    marked = entries.select("node", F.conv(F.hex(F.substring("fp", 1, 8)), 16, -10).cast("long").alias("bits"))
    classes = marked.groupBy("bits").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n"))
    near = components(near_bits(classes.select(F.col("bits").alias("fp"), F.col("first").alias("node")), BITS))
    told = classes.join(near, F.col("first") == F.col("node"), "left").select("bits", "n", F.coalesce("component", "first").alias("first"))
    shared = told.groupBy("first").agg(F.sum("n").alias("all")).where("all > 1").select("first")
    return hot_join(marked, told.join(shared, "first"), "bits", marked.count()).select(F.xxhash64(F.lit("bits"), "first").alias("key"), "node")


def groups(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, component_id, n (its rows) of rows that have an identifier."""
    named = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("row"), F.col(text).alias("text")).where("doc_id IS NOT NULL")
    marked = stored(named.mapInArrow(released(_marked), "doc_id long, row long, fp binary, keys array<long>"), "wide")
    entries = stored(marked.groupBy("fp").agg(F.min(F.struct("doc_id", "row")).alias("m"), F.count(F.lit(1)).alias("n")).select("fp", F.col("m.doc_id").alias("node"), F.col("m.row").alias("row"), "n"), "entries")
    own = marked.groupBy("fp", "doc_id", "row").agg(F.first("keys").alias("keys")).join(entries.select("fp", F.col("node").alias("doc_id"), "row"), ["fp", "doc_id", "row"]).select(F.col("doc_id").alias("node"), "keys")
    # rows of one identifier with different texts are one document
    many = marked.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("doc_id")
    tied = marked.select("doc_id", "fp").join(many, "doc_id").distinct().join(entries, "fp").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).where("a <> b")
    posted = stored(own.select(F.explode("keys").alias("key"), "node").distinct().unionByName(by_bits(entries)), "postings")

    def sets(nodes: DataFrame) -> DataFrame:
        """Only texts that share a posting are read again for their hashes; these are as large as the texts."""
        chosen = entries.join(nodes, "node", "left_semi").select(F.col("node").alias("doc_id"), "row").distinct()
        texts = named.join(chosen, ["doc_id", "row"], "left_semi")
        return texts.mapInArrow(released(_sets), "node long, row long, h binary").dropDuplicates(["node", "row"]).select("node", "h")

    found = links(posted, sets, tied)
    labels = entries.join(found, "node", "left").select("fp", "n", F.coalesce("component", "node").alias("component_id"))
    return hot_join(marked.select("doc_id", "fp"), labels, "fp", marked.count()).groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count(F.lit(1)).alias("n"))


def one_of_each(docs: DataFrame, key: str, text: str) -> DataFrame:
    """docs with one document of each group, the one with the smallest identifier; rows without identifiers stay. Of rows that have an
    identifier and the text in common one stays, the first by its JSON; different texts under one identifier all stay."""
    told = stored(groups(docs, key, text).where("doc_id <> component_id OR n > 1").withColumn("lost", F.col("doc_id") != F.col("component_id")).select("doc_id", "lost"), "lost")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("r"))
    seen = rows.join(told, rows["r"].getField(key).cast("long") == told["doc_id"], "left").where("NOT coalesce(lost, false)")
    once = seen.where("doc_id IS NULL").select("r.*")
    if told.where("NOT lost").isEmpty():
        return once
    own = F.col("r").getField(key).alias("k"), F.col("r").getField(text).alias("t")
    again = seen.where("doc_id IS NOT NULL").groupBy(*own).agg(F.min_by("r", F.to_json("r")).alias("r"))
    return once.unionByName(again.select("r.*"))
