"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Only DataFrame expressions run here. The unit is a document's size in words; a source's share of the mix is its weight's share of
the budget, clamped at ``max_epochs`` times the source's size, with the excess dealt again by weight until no source is above.

A source is repeated target / size times: every document whole as often as that holds, and a seeded choice of documents once more for
the fraction. The choice orders a source's documents by a digest of seed and identifier. Only sums by the digest's first digits are
gathered for a source; just the documents in the one digest bin where the fraction ends are ordered, by digest and size alone, and the last
one that is taken tells all rows whether they are. So a source with a third of all rows never meets in one task, and no text is shuffled.

Defined results: a null text has size 0, as an empty one; rows of size 0 are repeated as their source is and count nothing; a null
source is a source of its own, last in order; repeated identifiers are rows of their own (equal digests are ordered by size, and rows equal
in both are chosen together or not at all); null identifiers are told apart by their texts where ``tie`` names them; an empty table gives an
empty result; other columns pass through, but for those named as the four that are added, which they replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored, table

#: Hex digits of the digest that make a bin: 16 ** 3 bins a source.
BIN_DIGITS = 3
#: Sources whose plan is sent to the rows; beyond them the two are joined by a shuffle.
SENT = 50_000
ADDED = ("_size", "_source_size", "_target", "_times")


def ranked(sources: DataFrame, key: str, into: str) -> DataFrame:
    """Adds the 0-based rank of each row by key, nulls last, without one task seeing all rows: ranks inside range partitions plus the
    sizes of those before. sources is stored, so that both readings agree."""
    kept = stored(sources.repartitionByRange(F.asc_nulls_last(key)).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(F.asc_nulls_last(key)))
    return (
        kept.withColumn("_inside", inside)
        .join(F.broadcast(before.select("_part", F.coalesce("_before", F.lit(0)).alias("_before"))), "_part")  # a row per partition
        .withColumn(into, F.col("_before") + F.col("_inside") - 1)
        .drop("_part", "_inside", "_before")
    )


def water_fill(sources: DataFrame, budget: float, max_epochs: float, total: str = "source_size", weight: str = "weight") -> DataFrame:
    """Adds ``target``. Each round needs one row of sums; rounds end when no further source is clamped."""
    cap = F.col(total) * F.lit(float(max_epochs))
    level = None
    while True:
        clamped = F.lit(False) if level is None else cap < F.col(weight) * F.lit(level)
        got = sources.agg(
            F.coalesce(F.sum(F.when(clamped, cap)), F.lit(0.0)).alias("held"),
            F.coalesce(F.sum(F.when(~clamped, F.col(weight))), F.lit(0)).cast("double").alias("open"),
        ).first()
        new = (budget - got["held"]) / got["open"] if got["open"] else float("inf")
        if level is not None and new <= level or got["open"] == 0:
            break
        level = new
    if level is None:
        return sources.withColumn("target", cap)
    return sources.withColumn("target", F.least(cap, F.col(weight) * F.lit(level)))


def digest_of(key: str, tie: Column | None, seed: str) -> Column:
    """What orders a source's rows: a digest of seed and identifier, of seed and ``tie`` where the identifier is null."""
    name = F.col(key).cast("string")
    if tie is not None:
        name = F.coalesce(name, F.concat(F.lit("text:"), F.md5(F.coalesce(tie.cast("binary"), F.lit(b"")))))
    return F.md5(F.concat(F.coalesce(name, F.lit("")), F.lit(f":{seed}")))


def mix(docs: DataFrame, key: str, source: str, size: Column, weights: tuple[float, ...], share: float, max_epochs: float, seed: str, tie: Column | None = None) -> DataFrame:
    """docs with _size, _source_size, _target, and _times, how often the mix repeats the row.

    weights: dealt to the sources in order of their names, again and again; share: of all sizes that the mix holds; tie: tells rows with
    null identifiers apart.
    """
    own = {"_size": size.cast("long"), "_source": F.col(source).cast("string"), "_digest": digest_of(key, tie, seed)}
    # what the plan needs of each row, without its text
    narrow = stored(docs.select(*[c.alias(n) for n, c in own.items()]).withColumn("_bin", F.substring("_digest", 1, BIN_DIGITS)), "sizes")
    sums = stored(narrow.groupBy("_source", "_bin").agg(F.sum("_size").alias("_in_bin")), "bins")
    totals = sums.groupBy("_source").agg(F.sum("_in_bin").alias("_source_size"))
    total = totals.agg(F.sum("_source_size")).first()[0] or 0
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    plan = water_fill(ranked(totals, "_source", "_rank").withColumn("weight", weight), share * total, max_epochs, "_source_size")
    plan = plan.withColumnRenamed("target", "_target").withColumn("_epochs", F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0)))
    plan = plan.withColumn("_whole", F.floor("_epochs")).withColumn("_part", F.col("_target") - F.col("_whole") * F.col("_source_size"))
    plan = stored(plan.select(F.col("_source").alias("_s"), "_source_size", "_target", "_whole", "_part"), "targets")
    # the bin in which each source's fraction ends: at most 16 ** BIN_DIGITS rows a source are ordered
    run = Window.partitionBy("_source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    through = sums.withColumn("_through", F.sum("_in_bin").over(run))
    before = F.col("_through") - F.col("_in_bin")
    ends = through.join(plan.select("_s", "_part"), F.col("_source").eqNullSafe(F.col("_s"))).where((before <= F.col("_part")) & (F.col("_through") > F.col("_part")))
    ends = stored(ends.select("_s", F.col("_bin").alias("_end"), before.alias("_before"), "_part"), "ends")
    # only that bin's rows are ordered; those that are repeated once more are a prefix of it, which its last row tells
    upto = F.col("_before") + F.sum("_size").over(Window.partitionBy("_source").orderBy("_digest", "_size")) - F.col("_size") / 2
    closing = narrow.join(ends, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bin") == F.col("_end"))).withColumn("_upto", upto)
    last = closing.where((F.col("_upto") <= F.col("_part")) & (F.col("_part") > 0)).groupBy("_source").agg(F.max(F.struct("_digest", "_size")).alias("_last"))
    plan = plan.join(ends.select(F.col("_s").alias("_e"), "_end"), F.col("_s").eqNullSafe(F.col("_e")), "left")
    plan = stored(plan.join(last, F.col("_s").eqNullSafe(F.col("_source")), "left").select("_s", "_source_size", "_target", "_whole", "_part", "_end", "_last"), "plan")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("r"), *[c.alias(n) for n, c in own.items()])
    if plan.count() <= SENT:
        rows = rows.join(F.broadcast(plan), F.col("_source").eqNullSafe(F.col("_s")))
    else:  # dealt by source and the digest's first digits, so that no source is one task's
        deal = F.explode(F.array(*[F.lit(f"{d:02x}") for d in range(256)]))
        named = lambda c: F.coalesce(F.concat(F.lit("s"), F.col(c)), F.lit("-")).alias("_key")
        rows = rows.select("*", named("_source"), F.substring("_digest", 1, 2).alias("_salt")).join(plan.select("*", named("_s"), deal.alias("_salt")), ["_key", "_salt"])
    bin_ = F.substring("_digest", 1, BIN_DIGITS)
    more = F.when(F.col("_end").isNull() | (bin_ < F.col("_end")), F.col("_part") > 0).when(bin_ == F.col("_end"), F.struct("_digest", "_size") <= F.col("_last"))
    times = (F.col("_whole") + F.coalesce(more, F.lit(False)).cast("int")).cast("long")
    return rows.withColumn("_times", times).select(*[F.col("r").getField(c).alias(c) for c in docs.columns if c not in ADDED], *ADDED)


PRODUCTION = {"weights": (3, 1, 2), "share": 1.5, "max_epochs": 2.0, "seed": "mix-1"}


def op7_mixing_target_weights(spark, sf_dir: str) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n")
    tie = F.when(F.col("doc_id").isNull(), F.col("text")).alias("tie")
    docs = stored(table(spark, sf_dir, "documents").select("doc_id", "source", size, tie), "counted")  # texts are read once
    mixed = mix(docs, "doc_id", "source", F.col("n"), tie=F.col("tie"), **PRODUCTION)
    return mixed.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_times") * F.col("_size")).alias("taken"))


OP7_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, ''))) || ':mix-1') AS digest FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, ([3, 1, 2])[(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS weight FROM totals),
filling AS (
  SELECT 0 AS round, 1.5 * sum(source_size)::DOUBLE / sum(weight)::DOUBLE AS level, -1::DOUBLE AS old FROM weighed
  UNION ALL
  SELECT * FROM (
    SELECT f.round + 1 AS round,
           (1.5 * sum(w.source_size)::DOUBLE - coalesce(sum(w.source_size * 2.0::DOUBLE) FILTER (w.source_size * 2.0::DOUBLE < w.weight * f.level), 0))
           / nullif(coalesce(sum(w.weight) FILTER (w.source_size * 2.0::DOUBLE >= w.weight * f.level), 0), 0)::DOUBLE AS level, any_value(f.level) AS old
    FROM filling f CROSS JOIN weighed w GROUP BY f.round) g WHERE g.level > g.old),
targets AS (
  SELECT source, source_size, least(source_size * 2.0::DOUBLE, weight * (SELECT max(level) FROM filling)) AS target FROM weighed),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets),
run AS (
  SELECT doc_id, size, source_size, target, whole, target - whole * source_size AS part,
         sum(size) OVER (PARTITION BY s.source ORDER BY digest, size) AS upto
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       ((whole + CASE WHEN part > 0 AND upto - size / 2.0 <= part THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM run
"""
