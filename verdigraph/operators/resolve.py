"""Warnings to declarations: unit, file, enclosing function. Every join is an equi-join with a residual.

A file matches when one path is a suffix of the other, so their base names are equal: that is the join key. Order among matches is the
path variant's place, then the file key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: How a warning was resolved.
STATUSES = ("no_call_graph", "file_not_resolved", "line_name_match", "line_name_multiple_first_used", "enclosing_line_match", "enclosing_line_multiple_smallest_span", "name_match", "name_multiple_first_used", "function_not_resolved")


def suffix_match(norm: Column, variant: Column) -> Column:
    return (norm == variant) | norm.endswith(F.concat(F.lit("/"), variant)) | variant.endswith(F.concat(F.lit("/"), norm))


def with_units(warnings: DataFrame, units: DataFrame, key: str) -> DataFrame:
    """warnings with has_unit and the unit's repo_root."""
    known = units.where(F.col("status") != "failed").select(F.col("key").alias(key), "repo_root").dropDuplicates([key]).withColumn("has_unit", F.lit(True))
    return warnings.join(known, key, "left").withColumn("has_unit", F.coalesce("has_unit", F.lit(False)))


def decl_files(warnings: DataFrame, files: DataFrame, root: str | None = "repo_root") -> DataFrame:
    """(warning_id, file_key) of each warning whose path matches a declaration file of its unit. files: unit, file_key."""
    variants = X.path_variants(F.col("file_path"), F.col(root) if root and root in warnings.columns else None)
    asked = warnings.where("file_path <> ''").select("warning_id", "unit", F.posexplode(variants).alias("ord", "variant")).withColumn("base", X.basename(F.col("variant")))
    known = files.select("unit", "file_key").distinct().withColumn("norm", X.normalize_path(F.col("file_key"))).withColumn("base", X.basename(F.col("norm")))
    met = asked.join(known, ["unit", "base"]).where(suffix_match(F.col("norm"), F.col("variant")))
    return met.groupBy("warning_id").agg(F.min_by("file_key", F.struct("ord", "file_key")).alias("file_key"))


def checkout_files(warnings: DataFrame, files: DataFrame) -> DataFrame:
    """(warning_id, resolved_file_path): the exact path, else the only file that ends with it, else the only one with its name.
    files: repo_root, path (relative)."""
    asked = warnings.where("file_path <> ''").select("warning_id", "repo_root", X.normalize_path(F.col("file_path")).alias("target")).withColumn("base", X.basename(F.col("target")))
    met = asked.join(files.select("repo_root", "path").distinct().withColumn("base", X.basename(F.col("path"))), ["repo_root", "base"])
    exact = F.col("path") == F.col("target")
    suffix = exact | F.col("path").endswith(F.concat(F.lit("/"), F.col("target")))
    told = met.groupBy("warning_id").agg(
        F.max(F.when(exact, F.col("path"))).alias("e"), F.count_if(suffix).alias("ns"), F.min(F.when(suffix, F.col("path"))).alias("s"), F.count(F.lit(1)).alias("na"), F.min("path").alias("a")
    )
    return told.select("warning_id", F.coalesce("e", F.when(F.col("ns") == 1, F.col("s")), F.when((F.col("ns") == 0) & (F.col("na") == 1), F.col("a"))).alias("resolved_file_path"))


def enclosing(warnings: DataFrame, matched: DataFrame, decls: DataFrame) -> DataFrame:
    """Per warning: resolve_status, file_key, sig. One left join with the functions of the matched file, then one aggregation.

    warnings: warning_id, unit, has_unit, file_path, line_number, enclosing_function."""
    line = F.greatest(F.lit(0), F.expr("try_cast(trim(line_number) AS INT)") - 1)
    has = F.col("has_unit") if "has_unit" in warnings.columns else F.lit(True)
    asked = warnings.select("warning_id", "unit", has.alias("has_unit"), F.when(F.expr("try_cast(trim(line_number) AS INT)").isNotNull(), line).alias("line0"), F.nullif(X.strip(F.coalesce("enclosing_function", F.lit(""))), F.lit("")).alias("wanted"))
    asked = asked.join(matched, "warning_id", "left")
    funcs = decls.where("sig.ftype = 'func'").select("unit", "file_key", "sig", "start_row", "end_row")
    met = asked.join(funcs, ["unit", "file_key"], "left").withColumn("sig_text", X.signature_text(F.col("sig")))
    around = F.coalesce(F.col("line0").between(F.col("start_row"), F.col("end_row")), F.lit(False))
    named = F.coalesce(F.col("sig.name") == F.col("wanted"), F.lit(False))
    span = F.greatest(F.lit(0), F.col("end_row") - F.col("start_row"))
    told = met.groupBy("warning_id", "has_unit", "file_key").agg(
        F.count_if(around).alias("n_around"),
        F.count_if(around & named).alias("n_both"),
        F.count_if(named).alias("n_named"),
        F.min_by("sig", F.when(around & named, F.col("sig_text"))).alias("by_both"),
        F.min_by("sig", F.when(around, F.struct(span.alias("span"), F.col("sig_text").alias("sig_text")))).alias("by_span"),
        F.min_by("sig", F.when(named, F.struct(F.col("start_row").alias("start_row"), F.col("sig_text").alias("sig_text")))).alias("by_name"),
    )
    status = (
        F.when(~F.col("has_unit"), "no_call_graph").when(F.col("file_key").isNull(), "file_not_resolved")
        .when(F.col("n_both") == 1, "line_name_match").when(F.col("n_both") > 1, "line_name_multiple_first_used")
        .when(F.col("n_around") == 1, "enclosing_line_match").when(F.col("n_around") > 1, "enclosing_line_multiple_smallest_span")
        .when(F.col("n_named") == 1, "name_match").when(F.col("n_named") > 1, "name_multiple_first_used")
        .otherwise("function_not_resolved")
    )
    sig = F.when(F.col("n_both") > 0, F.col("by_both")).when(F.col("n_around") > 0, F.col("by_span")).when(F.col("n_named") > 0, F.col("by_name"))
    return told.select("warning_id", status.alias("resolve_status"), "file_key", sig.alias("sig"))


def status_counts(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("resolve_status").agg(F.count(F.lit(1)).alias("n"))


def spans_at(points: DataFrame, spans: DataFrame, key: list[str], at: str, start: str, end: str, tie: str, width: int) -> DataFrame:
    """points with the smallest span of the same key that holds them (inclusive). Spans are listed under each bin of ``width`` that they
    touch, so a long list under one key is met bin by bin, not as a product."""
    binned = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    met = points.withColumn("_bin", F.floor(F.col(at) / width)).join(binned, [*key, "_bin"]).where(F.col(at).between(F.col(start), F.col(end)))
    best = Window.partitionBy(*points.columns).orderBy(F.col(end) - F.col(start), tie)
    return met.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "_bin")


def lookup(asked: DataFrame, decls: DataFrame, every: bool = False) -> DataFrame:
    """Entries for (unit, file_key, sig): those with the signature, else with kind and name, else with the name; the first or every.

    Namesakes are not met one by one: what is known of a name is added up first, so rows grow with the input (and, for every, the result)."""
    of = ["unit", "file_key"]
    known = decls.where("sig.name IS NOT NULL").select(*of, F.col("sig").alias("found"), "start_row").withColumns({"_name": F.col("found.name"), "_kind": F.col("found.ftype")})
    same = known.select(*of, F.col("found").alias("sig")).distinct().withColumn("_same", F.lit(True))
    place = F.struct(F.col("start_row").alias("row"), X.signature_text(F.col("found")).alias("text"))
    kinds = known.groupBy(*of, "_name", "_kind").agg(F.min(F.struct(place.alias("place"), "found")).alias("first"))
    names = kinds.groupBy(*of, "_name").agg(F.min("first").alias("_any"), F.map_from_entries(F.collect_list(F.when(F.col("_kind").isNotNull(), F.struct("_kind", "first")))).alias("_by_kind"))
    met = asked.withColumn("_name", F.col("sig.name"))
    met = (met if every else met.dropDuplicates([*of, "sig"])).join(same, [*of, "sig"], "left").join(names, [*of, "_name"])
    by_kind = F.col("_by_kind")[F.col("sig.ftype")]
    if not every:
        return met.withColumn("found", F.when(F.col("_same"), F.col("sig")).otherwise(F.coalesce(by_kind, "_any")["found"])).drop("_name", "_same", "_any", "_by_kind")
    met = met.withColumn("_rank", F.when(F.col("_same"), 0).when(by_kind.isNotNull(), 1).otherwise(2)).drop("_same", "_any", "_by_kind")
    own = met.where("_rank = 0").join(known.select(*of, F.col("found").alias("sig"), "found"), [*of, "sig"])
    kind = met.where("_rank = 1").withColumn("_kind", F.col("sig.ftype")).join(known.drop("start_row"), [*of, "_name", "_kind"])
    name = met.where("_rank = 2").join(known.drop("start_row", "_kind"), [*of, "_name"])
    return own.unionByName(kind.select(*own.columns)).unionByName(name.select(*own.columns)).drop("_name", "_rank")


def enclosing_at(asked: DataFrame, decls: DataFrame) -> DataFrame:
    """asked (unit, file_key, line0, name) with the function there: by line the smallest, else by name a function, else the last entry of that name."""
    known = decls.select("unit", "file_key", "sig", "start_row", "end_row")
    met = asked.join(known, ["unit", "file_key"], "left")
    func = F.col("sig.ftype") == "func"
    around = func & F.col("line0").between(F.col("start_row"), F.col("end_row"))
    named = F.col("sig.name") == F.col("name")
    keys = ["unit", "file_key", "line0", "name"]
    told = met.groupBy(*keys).agg(
        F.min_by("sig", F.when(around, F.struct(F.col("end_row") - F.col("start_row"), "start_row"))).alias("a"),
        F.min_by("sig", F.when(func & named, F.col("start_row"))).alias("b"),
        F.max_by("sig", F.when(named, F.col("start_row"))).alias("c"),
    )
    return told.select(*keys, F.coalesce("a", "b", "c").alias("sig"))
