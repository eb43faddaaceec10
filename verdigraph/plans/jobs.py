"""Jobs: build declarations, extract contexts, climb the ladder. Also the command line."""

from __future__ import annotations

import argparse
import logging
import os
import re
import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import context as C
from ..operators import ladder as L
from ..operators import resolve as R
from ..schemas import VALID
from ..sources import fetch as fetching
from ..sources import tables as S
from ..store import stored
from . import evaluate as E
from . import providers
from . import prompts as P


log = logging.getLogger("verdigraph")


def build(spark: SparkSession, sources: DataFrame, store: str, force: bool = False, roots: DataFrame | None = None, previous: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Parses sources (unit, file_key, text) into the declaration store; units that it has are skipped before parsing, unless forced.
    Returns the manifest of all units known, and the errors. roots: unit, repo_root of these sources; previous: the manifest before, whose
    rows stay as they were for units that are not parsed now."""
    units = stored(sources.select(F.col("unit").alias("key")).distinct(), "units")
    there = None if force else S.existing(spark, store)
    old = there.select(F.col("unit").alias("key")).distinct() if there is not None else units.limit(0)
    marked = units.join(old.withColumn("skipped", F.lit(True)), "key", "left").withColumn("skipped", F.coalesce("skipped", F.lit(False)))
    fresh = marked.where("NOT skipped").select(F.col("key").alias("unit"))
    decls, errors = S.parse(sources.join(fresh, "unit", "left_semi"))
    new, errors = stored(decls, "decls"), stored(errors, "errors")
    S.write_decls(new, store, force)
    known = S.read_decls(spark, store).select("unit") if S.existing(spark, store) is not None else new.select("unit")
    told = S.build_manifest(marked, known, errors)
    told = told.join(roots.select(F.col("unit").alias("key"), "repo_root").dropDuplicates(["key"]), "key", "left") if roots is not None else told.withColumn("repo_root", F.lit(None).cast("string"))
    if previous is not None:  # a unit that isn't parsed now keeps its root, and its row if it isn't among these sources
        before = previous.join(marked.where("NOT skipped").select("key"), "key", "left_anti")
        was = before.select(F.col("key").alias("_k"), F.col("repo_root").alias("_root"))
        told = told.join(was, F.col("key") == F.col("_k"), "left").withColumn("repo_root", F.coalesce("_root", "repo_root")).drop("_k", "_root")
        told = told.unionByName(before.join(units, "key", "left_anti"), allowMissingColumns=True)
    return stored(told, "manifest"), errors


def fetch_job(spark: SparkSession, warnings: DataFrame, root: str, manifest: str, force: bool = False, blobless: bool = False) -> dict:
    """Fetches the repositories that warnings name, resolves the warnings' files in them, and writes the manifest, which comes back."""
    checkouts = stored(fetching.fetch_all(S.unique_checkouts(warnings), root, force, blobless), "checkouts")
    joined = S.join_checkouts(warnings, checkouts).where("repo_root IS NOT NULL")
    found = R.checkout_files(joined, fetching.files_of(checkouts))
    resolved = joined.select("warning_id", "repo_root", "file_path").join(found, "warning_id", "left").withColumn("file_exists", F.col("resolved_file_path").isNotNull())
    told = S.checkout_manifest(checkouts, stored(resolved, "resolved"))
    S.write_manifest(spark, manifest, told)
    return told


def extract(warnings: DataFrame, decls: DataFrame, units: DataFrame | None = None, depth: int = 2, edges: str = "calls") -> tuple[DataFrame, DataFrame]:
    context, callers = C.contexts(warnings, decls, units, depth, edges)
    return stored(context, "context"), stored(callers, "callers")


def triage(context: DataFrame, callers: DataFrame, make: Callable[[], E.Evaluator], model: str, votes: int = 3, cap: int | None = None, blind: bool = False, done: DataFrame | None = None, **options) -> dict[str, DataFrame]:
    """Verdicts and reports of the warnings that have none of the model. failed: warnings without an enclosing body, which get no verdict."""
    rows, failed = C.triageable(S.pending(context, done, model))
    sized = L.max_level(callers, rows, cap)
    planned = stored(L.planned(sized.select("warning_id", "max_level"), votes=votes), "planned")
    build_ = lambda now: C.prompts(now, rows, callers, P.SYSTEM, P.BLIND, blind)
    records = E.climb(planned, build_, make, **options)
    walked = stored(L.walks(E.with_plan(records, planned)), "walks")
    judged = stored(L.verdicts(walked, votes), "verdicts")
    reports = L.reports(judged, L.representative(walked, judged), rows, model)
    return {"records": records, "walks": walked, "verdicts": judged.join(L.metadata(rows), "warning_id"), "reports": reports, "failed": failed}


def summary(out: dict[str, DataFrame], asked: int) -> dict:
    """Counts of a triage run: warnings asked for, final labels, stable verdicts, levels with errors, warnings without context."""
    labels = {r["label"]: r["n"] for r in out["verdicts"].groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # three labels
    stable = out["verdicts"].agg(F.count_if("is_stable")).first()[0]
    errors = out["records"].agg(F.count_if(F.col("error").isNotNull())).first()[0] if "error" in out["records"].columns else 0
    return {"asked": asked, **{x: labels.get(x, 0) for x in VALID}, "stable": stable, "errors": errors, "no_context": out["failed"].count()}


def logged(folder: str, model: str) -> str:
    """Logs this run to a file under folder as well as to the terminal; returns the file's path."""
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{re.sub(r'[^A-Za-z0-9._-]', '_', model)}-{time.strftime('%Y%m%d-%H%M%S')}.log"
    for handler in list(log.handlers):
        log.removeHandler(handler)
        handler.close()
    for handler in (logging.FileHandler(path), logging.StreamHandler()):
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(handler)
    log.setLevel(logging.INFO)
    return path


def dry_run(context: DataFrame, callers: DataFrame, cap: int | None = None, blind: bool = False) -> DataFrame:
    """Builds the first and the deepest prompt of each warning; counts by outcome."""
    rows, failed = C.triageable(context)
    sized = L.max_level(callers, rows, cap).select("warning_id", "max_level").withColumn("walk", F.lit(0)).withColumn("level", F.explode(F.array_distinct(F.array(F.lit(1), "max_level"))))
    built = C.prompts(sized, rows, callers, P.SYSTEM, P.BLIND, blind)
    told = built.groupBy("warning_id").agg(F.max(F.col("prompt_error").isNotNull()).alias("bad")).select(F.when(F.col("bad"), "prompt_build_error").otherwise("ok").alias("status"))
    return told.unionByName(failed.select(F.lit("no_enclosing_body").alias("status"))).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


#: Datasets: real repositories, and generated test cases, whose names and comments give answers away.
DATASETS = {"real_world": False, "juliet": True}


def parse_args(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser("verdigraph")
    p.add_argument("--warehouse", default="warehouse", help="folder of all tables")
    sub = p.add_subparsers(dest="job", required=True)
    f = sub.add_parser("fetch")
    f.add_argument("warnings")
    f.add_argument("root", help="folder that all executors share")
    f.add_argument("--blobless", action="store_true")
    b = sub.add_parser("build")
    b.add_argument("root", nargs="?", help="source tree; without one, the checkouts of the manifest")
    b.add_argument("--unit")
    x = sub.add_parser("extract")
    x.add_argument("warnings")
    x.add_argument("--depth", type=int, default=2)
    x.add_argument("--edges", choices=("calls", "references"), default="calls")
    t = sub.add_parser("triage")
    t.add_argument("--provider", default="offline")
    t.add_argument("--model", default="offline")
    t.add_argument("--thinking", action="store_true")
    t.add_argument("--votes", type=int, default=3)
    t.add_argument("--max-level", type=int)
    t.add_argument("--dataset", choices=tuple(DATASETS), default="real_world")
    t.add_argument("--blind", action=argparse.BooleanOptionalAction, default=None, help="default: by dataset")
    t.add_argument("--workers", type=int, default=1)
    t.add_argument("--tokens-per-minute", type=int, default=0)
    t.add_argument("--max-retries", type=int, default=5)
    t.add_argument("--backoff", type=float, default=2.0)
    t.add_argument("--dry-run", action="store_true")
    for q in (f, b, t):
        q.add_argument("--force", action="store_true")
    for q in (f, x, t):
        q.add_argument("--projects", nargs="*")
        q.add_argument("--limit", type=int)
    return p.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Runs a job; 0 if nothing failed."""
    a = parse_args(sys.argv[1:] if argv is None else argv)
    if getattr(a, "depth", 0) < 0 or getattr(a, "votes", 1) < 1:
        raise SystemExit("depth must be 0 or more, votes 1 or more")
    spark = spark or SparkSession.builder.appName("verdigraph").getOrCreate()
    at = lambda name: f"{a.warehouse}/{name}"
    rows = lambda path: S.with_ids(S.first_rows(S.only_projects(S.read_jsonl(spark, path), a.projects), a.limit))
    if a.job == "fetch":
        told = fetch_job(spark, rows(a.warnings), a.root, at("checkouts.json"), a.force, a.blobless)
        log.info("fetched: %s", told["summary"])
        return int(told["summary"]["checkouts_failed"] > 0)
    if a.job == "build":
        if a.root:
            sources = S.scan_sources(spark, a.root, a.unit)
            roots = sources.select("unit").distinct().withColumn("repo_root", F.lit(a.root))
        else:
            checkouts = S.read_checkout_manifest(spark, at("checkouts.json"))
            sources, roots = S.scan_checkouts(spark, checkouts), checkouts.select(F.col("key").alias("unit"), F.col("dest").alias("repo_root"))
        previous = S.read_units(spark, at("units")) if S.there(spark, at("units")) else None
        manifest, errors = build(spark, sources, at("decls"), a.force, roots, previous)
        manifest.orderBy("key").write.mode("overwrite").json(at("units"))
        errors.write.mode("overwrite").json(at("errors"))
        counts = S.manifest_summary(manifest)
        log.info("built: %s", counts)
        return int(not counts or counts.get("failed", 0) > 0)
    if a.job == "extract":
        warnings = rows(a.warnings)
        key = F.when(F.coalesce("project_url", F.lit("")) != "", X.checkout_key(F.col("project"), F.col("commit_id"))).otherwise(X.parent_name(X.normalize_path(F.col("file_path"))))
        context, callers = extract(warnings.withColumn("unit", key), S.read_decls(spark, at("decls")), S.read_units(spark, at("units")), a.depth, a.edges)
        context.write.mode("overwrite").parquet(at("context"))
        callers.write.mode("overwrite").parquet(at("callers"))
        log.info("contexts: %d, by status %s", context.count(), S.manifest_summary(context, "resolve_status"))
        return 0
    context = S.first_rows(S.only_projects(spark.read.parquet(at("context")), a.projects), a.limit)
    callers = spark.read.parquet(at("callers"))
    blind = DATASETS[a.dataset] if a.blind is None else a.blind
    logged(at("logs"), a.model)
    n = context.count()
    log.info("dataset %s, provider %s, model %s, votes %d, workers %d, blind %s, records %d", a.dataset, a.provider, a.model, a.votes, a.workers, blind, n)
    if a.dry_run:
        counts = dry_run(context, callers, a.max_level, blind)
        log.info("dry run: %s", {r["status"]: r["n"] for r in counts.collect()})
        return 0
    make = providers.maker(a.provider, a.model, a.thinking)
    done = None if a.force else S.existing(spark, at("reported"))
    out = triage(context, callers, make, a.model, a.votes, a.max_level, blind, done, retries=a.max_retries, backoff=a.backoff, tokens_per_minute=a.tokens_per_minute, concurrency=a.workers)
    reports = stored(out["reports"], "reports")
    S.write_reports(reports, at("reports"))
    reports.select("warning_id", "model").write.mode("append").parquet(at("reported"))
    asked = S.pending(context, done, a.model).count()
    log.info("summary: %s, skipped %d", summary(out, asked), n - asked)
    return 0


if __name__ == "__main__":
    sys.exit(main())
