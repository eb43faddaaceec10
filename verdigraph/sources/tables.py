"""Sources and sinks: warnings, checkouts, units, source trees, declarations, contexts, reports."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import text as X
from .cparse import parser

SUFFIXES = (".c", ".cpp", ".h")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = schemas.WARNING) -> DataFrame:
    """Rows of a JSON-lines file with an ordinal in input order; blank lines are skipped, a bad line fails."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return rows.withColumn("ordinal", F.monotonically_increasing_id())


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def only_projects(warnings: DataFrame, projects: list[str] | None) -> DataFrame:
    return warnings.where(F.col("project").isin(list(projects))) if projects else warnings


def first_rows(warnings: DataFrame, limit: int | None) -> DataFrame:
    """The first rows in input order, after filters."""
    return warnings if limit is None else warnings.orderBy("ordinal").limit(limit)


def with_ids(warnings: DataFrame) -> DataFrame:
    """Rows without a warning_id get <project>__<four digits of their place> among all rows in input order."""
    missing = warnings.where("warning_id IS NULL OR warning_id = ''")
    if missing.isEmpty():
        return warnings
    # the ordinal's high bits are the input partition: places are counted inside it, and added to the rows of those before
    part = F.shiftright("ordinal", 33)
    before = warnings.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = before.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("ordinal")) - 1
    numbered = warnings.withColumn("_part", part).withColumn("_inside", inside).join(F.broadcast(before), "_part")  # a row for each input partition
    numbered = numbered.withColumn("_place", F.col("_inside") + F.col("_before"))
    made = F.concat(F.coalesce("project", F.lit("unknown")), F.lit("__"), F.lpad(F.col("_place").cast("string"), 4, "0"))
    return numbered.withColumn("warning_id", F.coalesce(F.nullif("warning_id", F.lit("")), made)).drop("_part", "_inside", "_before", "_place")


def unique_checkouts(warnings: DataFrame, projects: list[str] | None = None) -> DataFrame:
    """Distinct project, url and commit, in order of first appearance; rows without a url have none."""
    commit = F.nullif("commit_id", F.lit(""))
    kept = only_projects(warnings, projects).where("project_url <> ''")
    return kept.groupBy("project", F.col("project_url").alias("url"), commit.alias("commit")).agg(F.min("ordinal").alias("ordinal"))


def join_checkouts(warnings: DataFrame, checkouts: DataFrame) -> DataFrame:
    """warnings with the checkout of their project and commit; no commit equals no commit."""
    c = checkouts.select(F.col("project").alias("_p"), F.col("commit").alias("_c"), F.col("dest").alias("repo_root"), "ok")
    return warnings.join(c, (F.col("project") == F.col("_p")) & F.nullif("commit_id", F.lit("")).eqNullSafe(F.nullif("_c", F.lit(""))), "left").drop("_p", "_c")


def checkout_summary(checkouts: DataFrame, resolved: DataFrame) -> DataFrame:
    a = checkouts.agg(F.count(F.lit(1)).alias("checkouts_total"), F.count_if("ok").alias("checkouts_ok"), F.count_if(~F.col("ok")).alias("checkouts_failed"))
    b = resolved.agg(F.count_if(F.coalesce("file_exists", F.lit(False))).alias("warning_files_resolved"), F.count_if(~F.coalesce("file_exists", F.lit(False))).alias("warning_files_missing"))
    return a.join(b, F.lit(True))  # one row each


def read_checkout_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Checked-out units of a manifest: those that are ok."""
    schema = T.StructType([T.StructField("checkouts", T.ArrayType(schemas.CHECKOUT))])
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("checkouts"))
    return rows.where("ok").withColumn("key", X.checkout_key(F.col("project"), F.col("commit")))


def folder_units(warnings: DataFrame) -> DataFrame:
    """Distinct parent folders of the warnings' files, keyed by their names."""
    folder = F.regexp_replace(X.normalize_path(F.col("file_path")), "/?[^/]*$", "")
    return warnings.select(folder.alias("testcase_folder"), X.parent_name(X.normalize_path(F.col("file_path"))).alias("key")).distinct()


def read_units(spark: SparkSession, path: str) -> DataFrame:
    """Units by key, the last one of a key."""
    rows = spark.read.schema(schemas.UNIT).json(path).withColumn("_n", F.monotonically_increasing_id())
    names = [f.name for f in schemas.UNIT.fields if f.name != "key"]
    return rows.groupBy("key").agg(F.max_by(F.struct(*names), "_n").alias("r")).select("key", "r.*")


def scan_sources(spark: SparkSession, root: str, unit: Column | str | None = None) -> DataFrame:
    """unit, file_key, text of all .c, .cpp and .h files under root. unit: a name, or a column of path; the parent folder's name if not given."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{c,cpp,h}").load(root)
    path = F.regexp_replace("path", "^file:/+", "/")
    of = X.parent_name(path) if unit is None else F.lit(unit) if isinstance(unit, str) else unit
    return files.select(of.alias("unit"), path.alias("file_key"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def scan_checkouts(spark: SparkSession, checkouts: DataFrame) -> DataFrame:
    """Sources of checked-out units (key, dest), in one scan: a path's unit is the one whose folder holds it."""
    found = [(r["key"], r["dest"].rstrip("/")) for r in checkouts.select("key", "dest").distinct().collect()]  # a row for each repository
    if not found:
        return spark.createDataFrame([], "unit string, file_key string, text string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{c,cpp,h}").load([d for _, d in found])
    path = F.regexp_replace("path", "^file:/+", "/")
    key = F.coalesce(*[F.when(path.startswith(re.sub("^file:/+", "/", d) + "/"), F.lit(k)) for k, d in found])
    return files.select(key.alias("unit"), path.alias("file_key"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def parse(sources: DataFrame, name: str = "tokens") -> tuple[DataFrame, DataFrame]:
    """Declarations of sources (unit, file_key, text), and errors (unit, file_key, error): a file that fails loses only itself.

    Files that are equal in many units are parsed once: texts are grouped by content first."""
    schema = T.StructType([T.StructField("sha", T.StringType()), T.StructField("error", T.StringType()), *[f for f in schemas.DECL.fields if f.name != "unit"]])
    tagged = sources.withColumn("sha", F.sha2(F.concat_ws("\u0000", F.element_at(F.split("file_key", r"\."), -1), F.col("text")), 256))
    once = tagged.groupBy("sha").agg(F.first("text").alias("text"), F.first(F.element_at(F.split("file_key", r"\."), -1)).alias("kind"))

    def run(batches):
        import pandas as pd

        declarations = parser(name)
        for pdf in batches:
            rows = []
            for sha, text, kind in zip(pdf["sha"], pdf["text"], pdf["kind"]):
                try:
                    rows += [{"sha": sha, "error": None, **d} for d in declarations(f"x.{kind}", text or "")]
                except Exception as e:  # noqa: BLE001  the row tells it
                    rows.append({"sha": sha, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=schema.names)

    found = once.mapInPandas(run, schema).drop("file_key").join(tagged.select("sha", "unit", "file_key"), "sha")
    names = [f.name for f in schemas.DECL.fields]
    return found.where("error IS NULL").select(*names), found.where("error IS NOT NULL").select("unit", "file_key", "error")


def write_decls(decls: DataFrame, path: str, force: bool = False) -> DataFrame:
    """Appends units that the store at path lacks (all of them with force, replacing), partitioned by unit; returns what was written."""
    spark = decls.sparkSession
    new = decls
    if not force and (old := existing(spark, path)) is not None:
        new = decls.join(old.select("unit").distinct(), "unit", "left_anti")
    new.write.partitionBy("unit").mode("overwrite" if force else "append").option("partitionOverwriteMode", "dynamic").parquet(path)
    return new


def read_decls(spark: SparkSession, path: str, units: list[str] | None = None) -> DataFrame:
    """The store; with units, only their partitions are read."""
    rows = spark.read.schema(T.StructType([*[f for f in schemas.DECL.fields if f.name != "unit"], T.StructField("unit", T.StringType())])).parquet(path)
    return rows.where(F.col("unit").isin(units)) if units else rows


def there(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    """A parquet table, or None where there is none."""
    return spark.read.parquet(path) if there(spark, path) else None


def build_manifest(units: DataFrame, decls: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """units (key, and skipped: it was in the store before) with status, n_functions (entries of all kinds) and error: of a unit's failed
    files the first message. A unit without entries whose files failed has failed itself."""
    counts = decls.groupBy(F.col("unit").alias("key")).agg(F.count(F.lit(1)).cast("int").alias("n_functions"))
    out = units.join(counts, "key", "left").withColumn("n_functions", F.coalesce("n_functions", F.lit(0)))
    if errors is None:
        out = out.withColumn("error", F.lit(None).cast("string"))
    else:
        out = out.join(errors.groupBy(F.col("unit").alias("key")).agg(F.min_by("error", "file_key").alias("error")), "key", "left")
    failed = F.col("error").isNotNull() & (F.col("n_functions") == 0)
    return out.withColumn("status", F.when(failed, "failed").when(F.col("skipped"), "skipped").otherwise("built")).drop("skipped")


def pending(warnings: DataFrame, reports: DataFrame | None, model: str) -> DataFrame:
    """Warnings that have no report of the model."""
    if reports is None:
        return warnings
    return warnings.join(reports.where(F.col("model") == model).select("warning_id"), "warning_id", "left_anti")


def write_reports(reports: DataFrame, path: str) -> None:
    """JSON rows under model=... folders. A row names the file that a per-warning export would use."""
    reports.withColumn("report_file", X.report_name(F.col("model"), F.col("warning_id"))).write.mode("append").partitionBy("model").option("ignoreNullFields", False).json(path)


def export_reports(reports: DataFrame, folder: str) -> DataFrame:
    """One JSON file for each report under folder (any store that Arrow opens), written by the tasks; (report_file) of what was written.
    Writing again gives the same file."""
    named = reports.select(X.report_name(F.col("model"), F.col("warning_id")).alias("report_file"), F.to_json(F.struct(*reports.columns), {"ignoreNullFields": "false"}).alias("body"))

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, inside = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store.create_dir(f"{inside}/{name.rsplit('/', 1)[0]}")
                with store.open_output_stream(f"{inside}/{name}") as out:
                    out.write(body.encode())
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["report_file"])

    return named.mapInArrow(write, "report_file string")


def manifest_summary(df: DataFrame, status: str = "status") -> dict:
    """Counts by status: a handful of rows."""
    return {r[status]: r["n"] for r in df.groupBy(status).agg(F.count(F.lit(1)).alias("n")).collect()}


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in any store that Spark writes to."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(text.encode())
    out.close()


def checkout_manifest(checkouts: DataFrame, resolved: DataFrame) -> dict:
    """The checkout manifest: a row for each checkout in order of first appearance, and the summary."""
    rows = [r.asDict() for r in checkouts.orderBy("ordinal").drop("ordinal").collect()]  # a row for each repository that was fetched
    return {"checkouts": rows, "summary": checkout_summary(checkouts, resolved).first().asDict()}


def write_manifest(spark: SparkSession, path: str, head: dict) -> None:
    write_text(spark, path, json.dumps(head, indent=1, sort_keys=True))
