"""Line dedup: keep bitmaps from a range-partitioned, sorted stream of line hashes.

A line's key (blanks stripped at both ends, A-Z lower-cased) of at least ``least`` code points that at least two documents hold loses
all its lines but those of the smallest document. Key hashes (128 bits) are range-partitioned by hash, document and position and
sorted so; each task streams its part and knows the first document of each run of equal hashes. A hash with very many lines spreads
over several parts, since document and position are part of the range: a run that a part's start or end cuts is settled from one row
for each end of each part. Only positions of lost lines leave the stream; they become one compressed keep bitmap per document.

Defined results: a null or empty text is one empty line and is kept; a key repeated inside its smallest document stays there each
time; rows with one identifier are one document, null identifiers together one that sorts last; an empty table gives an empty result;
further columns pass through, but for those named as the three that are added, which they replace.
"""

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, release, released, stored, table, text_bytes

BLANK = b" \t\n\x0b\x0c\r"
LEAST = 10
_CONTINUED = re.compile(rb"[\x80-\xbf]")
LINES = "h1 long, h2 long, none int, doc long, row long, pos int"


def line_key(line: bytes) -> bytes:
    return line.strip(BLANK).lower()


def long_enough(key: bytes, least: int) -> bool:
    """At least so many code points; bytes that continue one are not counted."""
    return len(key) >= least and (len(key) - len(_CONTINUED.findall(key)) >= least if not key.isascii() else True)


def line_rows(docs: DataFrame, least: int) -> DataFrame:
    """Hash, document (none is 1 for a null one), row hash and position of each line that counts. docs: none, doc, row, text."""

    def hashes(batches):
        for batch in batches:
            digests, at, pos = [], [], []
            for k, text in enumerate(text_bytes(batch, "text")):
                for i, line in enumerate(text.split(b"\n")):
                    if long_enough(key := line_key(line), least):
                        digests.append(xxhash.xxh3_128_digest(key))
                        at.append(k)
                        pos.append(i)
            h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            own = [batch.column(i).take(pa.array(at, pa.int64())) for i in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0].copy(), pa.int64()), pa.array(h[:, 1].copy(), pa.int64()), *own, pa.array(pos, pa.int32())], ["h1", "h2", "none", "doc", "row", "pos"])

    return docs.mapInArrow(released(hashes), LINES)


def lost_lines(lines: DataFrame) -> DataFrame:
    """(none, doc, row, pos) of the lines that go. lines is read twice: to find the ranges, and to deal them."""
    n = parts(lines.sparkSession)
    order = ["h1", "h2", "none", "doc", "row", "pos"]
    streamed = lines.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(released(_stream), "kind int, " + LINES)
    found = stored(streamed, "lost-lines")
    ends = found.where("kind > 0")
    least = ends.groupBy("h1", "h2").agg(F.min(F.struct("none", "doc")).alias("least"))
    cut = ends.where("kind = 1").join(least, ["h1", "h2"]).where(F.struct("none", "doc") > F.col("least"))
    return found.where("kind = 0").select("none", "doc", "row", "pos").unionByName(cut.select("none", "doc", "row", "pos"))


def _stream(batches):
    """kind 0: a lost line. kind 1: a line of the first run's first document, which an earlier part may undo. kind 2: the last run's
    first document. A run's state goes from batch to batch: its hash, its first document and whether it is the part's first run."""
    run = None  # (h1, h2, first document: none, doc)
    first_run = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, none, doc = (batch.column(i).to_numpy() for i in range(4))
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        if run is not None:
            new[0] = (h1[0], h2[0]) != run[:2]
        else:
            first_run = (h1[0], h2[0])
        starts = np.flatnonzero(new)
        which = np.cumsum(new) - 1
        owner = [np.where(which >= 0, x[starts][np.maximum(which, 0)] if len(starts) else 0, run[k] if run else 0) for k, x in ((2, none), (3, doc))]
        lost = (none != owner[0]) | (doc != owner[1])
        cut = ~lost & (h1 == first_run[0]) & (h2 == first_run[1])
        for kind, mask in ((0, lost), (1, cut)):
            if mask.any():
                some = batch.filter(pa.array(mask))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(some.num_rows, kind, np.int32)), *some.columns], ["kind", *some.schema.names])
        run = (h1[-1], h2[-1], owner[0][-1], owner[1][-1])
    if run is not None:
        yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([run[0]], pa.int64()), pa.array([run[1]], pa.int64()), pa.array([run[2]], pa.int32()), pa.array([run[3]], pa.int64()), pa.array([0], pa.int64()), pa.array([0], pa.int32())], ["kind", "h1", "h2", "none", "doc", "row", "pos"])


def keep_bitmaps(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """docs with _keep: zlib-compressed bits, the first line's highest, 1 where the line stays; _lines; _dropped."""
    own_key = F.col(key).isNull().cast("int").alias("none"), F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("doc"), F.xxhash64(F.col(text)).alias("row")
    keyed = docs.select(*own_key, F.col(text).alias("text"))
    lost = lost_lines(stored(line_rows(keyed, least), "lines")).distinct().groupBy("none", "doc", "row").agg(F.collect_list("pos").alias("_lost"))  # of one text: bounded by its own lines
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("r"), *own_key)
    joined = packed.join(lost, ["none", "doc", "row"], "left").select("r", "_lost")
    whole = F.col("r").getField(text)
    n = F.coalesce(F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1, F.lit(1)).cast("long")
    own = [F.col("r").getField(c).alias(c) for c in docs.columns if c not in ("_lines", "_dropped", "_keep")]
    return joined.select(*own, n.alias("_lines"), F.coalesce(F.size("_lost"), F.lit(0)).cast("long").alias("_dropped"), F.pandas_udf(_bitmap, "binary")(n, F.col("_lost")).alias("_keep"))


def _bitmap(lines, lost):
    out = []
    for n, gone in zip(lines, lost):
        keep = np.ones(int(n), np.uint8)
        if gone is not None and len(gone):
            keep[np.asarray(gone, np.int64)] = 0
        out.append(zlib.compress(np.packbits(keep).tobytes(), 1))
    return pd.Series(out)


def kept_bytes(text: bytes, keep: bytes, n: int) -> bytes:
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n)
    if bits.all():
        return text
    return b"\n".join([x for x, k in zip(text.split(b"\n"), bits.tolist()) if k])


def kept_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """Applies _keep: the text without its lost lines. A text that loses nothing stays as it is, null too."""

    @F.pandas_udf("string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, keep, lines in batches:
            yield pd.Series([None if t is None else kept_bytes(t.encode(), k, int(n)).decode() for t, k, n in zip(texts, keep, lines)])
        release()

    return docs.withColumn(text, F.when(F.col("_dropped") > 0, cut(F.col(text), F.col("_keep"), F.col("_lines"))).otherwise(F.col(text)))


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = keep_bitmaps(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def digests(batches):
        for batch in batches:
            keep, n = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            sha = [hashlib.sha256(kept_bytes(t, k, m)).hexdigest() for t, k, m in zip(text_bytes(batch, "text"), keep, n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), batch.column(4), pa.array(sha, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return docs.select("doc_id", "text", "_keep", "_lines", "_dropped").mapInArrow(released(digests), "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


OP6_SQL = r"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM cut),
keyed AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
many AS (SELECT k, min(doc_id) AS least FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
told AS (SELECT l.doc_id, l.line, l.pos, m.k IS NOT NULL AND l.doc_id <> m.least AS lost FROM keyed l LEFT JOIN many m USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (lost))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM told GROUP BY doc_id
"""
