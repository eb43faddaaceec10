"""Walks over levels, votes over walks, and the walk that a report shows.

Tables: levels (warning_id, walk, level, label, ...), a row for each planned level; walks, a row for each (warning_id, walk); verdicts, a
row for each warning. All windows of a walk share one partitioning, so levels are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import DECISIVE, METADATA, VALID

WALK = ("warning_id", "walk")
STREAK = 3


def decisive(label: Column) -> Column:
    return F.coalesce(label.isin(*DECISIVE), F.lit(False))


def planned(records: DataFrame, max_level: str = "max_level", votes: int = 3) -> DataFrame:
    """A row for each walk and level of each warning."""
    if votes < 1:
        raise ValueError("votes must be at least 1")
    return records.withColumn("walk", F.explode(F.sequence(F.lit(0), F.lit(votes - 1)))).withColumn("level", F.explode(F.sequence(F.lit(1), F.col(max_level).cast("int"))))


def streaks(levels: DataFrame) -> DataFrame:
    """Adds streak (agreeing decisive labels so far), base_level (where it began) and evaluated (not after the walk was confirmed)."""
    by_level = Window.partitionBy(*WALK).orderBy("level")
    whole = Window.partitionBy(*WALK)
    broken = ~decisive(F.col("label")) | ~F.col("label").eqNullSafe(F.lag("label").over(by_level))
    run = F.sum(broken.cast("int")).over(by_level)
    in_run = Window.partitionBy(*WALK, "_run").orderBy("level")
    out = levels.withColumn("_run", run)
    out = out.withColumns({"streak": F.when(decisive(F.col("label")), F.row_number().over(in_run)).otherwise(F.lit(0)), "base_level": F.when(decisive(F.col("label")), F.min("level").over(in_run))})
    stop = F.min(F.when(F.col("streak") >= STREAK, F.col("level"))).over(whole)
    return out.withColumn("evaluated", stop.isNull() | (F.col("level") <= stop)).drop("_run")


def majority_of_levels(tp: Column, fp: Column) -> Column:
    """The decisive label with more votes; UNKNOWN for a tie or none."""
    return F.when(tp > fp, F.lit("TP")).when(fp > tp, F.lit("FP")).otherwise(F.lit("UNKNOWN"))


def walks(levels: DataFrame) -> DataFrame:
    """One row for each walk: label, stability, where it stopped and why, and its levels in order."""
    keep = F.col("evaluated")
    label = F.when(keep, F.col("label"))
    last = F.max_by(F.struct("label", "streak", "base_level", "level"), F.when(keep, F.col("level")))
    fields = [c for c in ("level", "label", "response", "reasoning", "usage", "estimated_input_tokens", "error") if c in levels.columns]
    grouped = streaks(levels).groupBy(*WALK).agg(
        last.alias("_last"),
        F.count(F.lit(1)).alias("_planned"),
        F.count_if(keep).alias("_evaluated"),
        F.min(F.when(label == "FP", F.col("level"))).alias("first_fp_level"),
        F.count_if(label == "TP").alias("n_tp"),
        F.count_if(label == "FP").alias("n_fp"),
        F.array_sort(F.collect_list(F.when(keep, F.struct(*fields)))).alias("levels"),
    )
    stable = decisive(F.col("_last.label"))
    confirmed = F.col("_last.streak") >= STREAK
    return grouped.select(
        *WALK,
        stable.alias("stable"),
        F.when(stable, F.col("_last.label")).alias("stable_label"),
        F.when(stable, F.col("_last.label")).otherwise(majority_of_levels(F.col("n_tp"), F.col("n_fp"))).alias("walk_label"),
        "first_fp_level",
        F.when(confirmed, F.lit("confirmed_two_levels_above")).when(stable, F.lit("exhausted_pending_verdict")).otherwise(F.lit("exhausted_no_verdict")).alias("stop_reason"),
        F.when(stable, F.col("_last.label")).alias("base_label_at_stop"),
        F.when(stable, F.col("_last.base_level")).alias("base_level"),
        F.when(confirmed, F.col("_last.level")).alias("confirmed_at_level"),
        (F.col("_evaluated") < F.col("_planned")).alias("stopped_early"),
        F.transform("levels", lambda x: x["level"]).alias("levels_evaluated"),
        F.transform("levels", lambda x: x["label"]).alias("level_labels"),
        "levels",
        "n_tp",
        "n_fp",
        F.col("_planned").alias("n_planned"),
    )


def majority_label(counts: dict[str, Column], slots: Column | int) -> Column:
    """The label with more than half of the slots, which may be more than the votes; UNKNOWN if none has."""
    least = F.floor((slots if isinstance(slots, Column) else F.lit(slots)) / 2) + 1
    out = F.lit("UNKNOWN")
    for label in reversed(VALID):
        out = F.when(counts[label] >= least, F.lit(label)).otherwise(out)
    return out


def verdicts(walked: DataFrame, votes: int) -> DataFrame:
    """One row for each warning from its walks: final label, stability, and the walks in order."""
    least = votes // 2 + 1
    counts = {x: F.count_if(F.col("walk_label") == x) for x in VALID}
    stable = {x: F.count_if(F.col("stable") & (F.col("walk_label") == x)) for x in DECISIVE}
    grouped = walked.groupBy("warning_id").agg(
        majority_label(counts, votes).alias("label"),
        *[n.alias(f"_stable_{x}") for x, n in stable.items()],
        majority_of_levels(F.sum("n_tp"), F.sum("n_fp")).alias("majority_label"),
        F.array_sort(F.collect_list(F.struct("walk", "walk_label"))).alias("_labels"),
        F.count_if("stable").alias("n_stable_walks"),
        F.max("n_planned").alias("max_level"),
    )
    enough = F.when(F.col("label") == "TP", F.col("_stable_TP")).when(F.col("label") == "FP", F.col("_stable_FP")).otherwise(F.lit(0)) >= least
    return grouped.select(
        "warning_id",
        "label",
        (F.col("label").isin(*DECISIVE) & enough).alias("is_stable"),
        "majority_label",
        F.transform("_labels", lambda x: x["walk_label"]).alias("walk_labels"),
        "n_stable_walks",
        F.lit(votes).alias("num_votes"),
        "max_level",
        F.sequence(F.lit(1), F.col("max_level").cast("int")).alias("levels_plan"),
    )


def representative(walked: DataFrame, judged: DataFrame) -> DataFrame:
    """The walk that the report shows: one with the final label if there is any, with the largest first FP level, and the earliest."""
    both = walked.join(judged.select("warning_id", F.col("label").alias("final_label")), "warning_id")
    order = Window.partitionBy("warning_id").orderBy(F.desc(F.col("walk_label") == F.col("final_label")), F.desc(F.coalesce("first_fp_level", F.lit(-1))), "walk")
    return both.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def max_level(callers: DataFrame, records: DataFrame, cap: int | None = None) -> DataFrame:
    """records with max_level: 1 and the number of caller levels that follow each other from 1; nodes count, with or without bodies."""
    if cap is not None and cap < 0:
        raise ValueError("cap must not be negative")
    each = callers.where("level >= 1").select("warning_id", "level").distinct()
    each = each.withColumn("_n", F.row_number().over(Window.partitionBy("warning_id").orderBy("level")))
    count = each.groupBy("warning_id").agg((1 + F.count_if(F.col("level") == F.col("_n"))).alias("_max"))
    found = F.coalesce("_max", F.lit(1))
    return records.join(count, "warning_id", "left").withColumn("max_level", F.greatest(F.lit(1), F.least(found, F.lit(cap)) if cap is not None else found).cast("int")).drop("_max")


def metadata(warnings: DataFrame) -> DataFrame:
    """What a verdict repeats of its warning."""
    names = [c for c in METADATA if c in warnings.columns]
    return warnings.select(*names, *([F.col("label").alias("gold_label")] if "label" in warnings.columns else []))


def reports(judged: DataFrame, chosen: DataFrame, warnings: DataFrame, model: str) -> DataFrame:
    """Six columns for each warning; the levels are those of its representative walk."""
    slim = F.transform("levels", lambda x: F.struct(x["level"].alias("level"), x["label"].alias("label"), *([x["response"].alias("response")] if _has(chosen, "response") else []), *([x["error"].alias("error")] if _has(chosen, "error") else [])))
    facts = warnings.select("warning_id", *([F.col("project")] if "project" in warnings.columns else [F.lit(None).cast("string").alias("project")]), F.col("label").alias("ground_truth_label") if "label" in warnings.columns else F.lit(None).cast("string").alias("ground_truth_label"))
    return (
        judged.select("warning_id", F.col("label").alias("final_label"))
        .join(chosen.select("warning_id", slim.alias("levels")), "warning_id")
        .join(facts, "warning_id")
        .select("warning_id", "project", F.lit(model).alias("model"), "final_label", "ground_truth_label", "levels")
    )


def _has(walked: DataFrame, name: str) -> bool:
    return name in walked.schema["levels"].dataType.elementType.names
