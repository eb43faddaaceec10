"""Warnings to context rows, and context rows to prompts for each level."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..schemas import CALLERS
from . import callgraph as G
from . import resolve as R


def body_of(text, start_row, end_row):
    """Rows start to end of a source text, both included."""
    rows = X.lines(text)
    fine = (start_row >= 0) & (end_row >= start_row) & (start_row < F.size(rows))
    return F.when(fine, F.array_join(F.slice(rows, start_row + 1, F.least(end_row + 1, F.size(rows)) - start_row), "\n"))


def contexts(warnings: DataFrame, decls: DataFrame, units: DataFrame | None = None, depth: int = 2, edges: str = "calls") -> tuple[DataFrame, DataFrame]:
    """Context rows (warnings with resolve_status, enclosing_function_identifier, enclosing_function_bodies) and their callers
    (warning_id, level, ord, identifier, bodies). warnings: with unit; edges: calls, or references for the wider graph."""
    base = warnings
    if units is not None:
        base = R.with_units(warnings, units, "unit")
    files = decls.select("unit", "file_key").distinct()
    matched = R.decl_files(base, files)
    funcs = G.functions(decls)
    roots = units.select(F.col("key").alias("unit"), "repo_root").dropDuplicates(["unit"]) if units is not None else None
    named = funcs.join(roots, "unit", "left") if roots is not None else funcs.withColumn("repo_root", F.lit(None).cast("string"))
    ident = F.when(F.col("repo_root").isNull(), X.identifier(F.col("file_key"), F.col("sig"))).otherwise(X.identifier(F.col("file_key"), F.col("sig"), F.col("repo_root")))
    bodies = named.select("node", ident.alias("identifier"), F.when(F.col("body").isNotNull(), F.array("body")).otherwise(F.array().cast("array<string>")).alias("bodies"), "file_key", X.signature_text(F.col("sig")).alias("sig_text"))
    found = R.enclosing(base, matched, decls).join(base.select("warning_id", "unit"), "warning_id")
    found = found.withColumn("node", F.when(F.col("sig").isNotNull(), G.node_id(F.col("unit"), F.col("file_key"), F.col("sig"))))
    rows = found.select("warning_id", "resolve_status", "node").join(bodies.select("node", "identifier", "bodies"), "node", "left")
    context = base.drop("repo_root", "has_unit").join(
        rows.select("warning_id", "resolve_status", F.col("identifier").alias("enclosing_function_identifier"), F.coalesce("bodies", F.array().cast("array<string>")).alias("enclosing_function_bodies"), "node"), "warning_id"
    )
    starts = rows.where("node IS NOT NULL").select(F.col("node").alias("start")).distinct()
    if edges == "calls":
        reached = G.callers_by_name(starts, funcs, depth)
    else:
        reached = G.caller_levels(starts, G.back_references(funcs).select(F.col("target").alias("callee"), F.col("source").alias("caller")), depth)
    reached = reached.join(bodies, "node")
    order = Window.partitionBy("start", "level").orderBy("file_key", "sig_text")
    ordered = reached.withColumn("ord", F.row_number().over(order)).select(F.col("start").alias("node"), "level", "ord", "identifier", "bodies")
    callers = context.select("warning_id", "node").join(ordered, "node").select("warning_id", "level", "ord", "identifier", "bodies")
    return context.drop("node"), callers


def nested(context: DataFrame, callers: DataFrame) -> DataFrame:
    """context with callers_by_level, a map of level to a map of identifier to bodies, in order."""
    inner = callers.groupBy("warning_id", "level").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("ord", "identifier", "bodies"))), lambda x: F.struct(x["identifier"], x["bodies"]))).alias("m"))
    outer = inner.groupBy("warning_id").agg(F.collect_list(F.struct("level", "m")).alias("all"))
    told = outer.select("warning_id", F.map_from_entries(F.transform(F.sequence(F.lit(1), F.size("all")), lambda i: F.struct(i.cast("string"), F.element_at(F.filter("all", lambda x: x["level"] == i), 1)["m"]))).alias("callers_by_level"))
    return context.join(told, "warning_id", "left").withColumn("callers_by_level", F.coalesce("callers_by_level", F.create_map().cast(CALLERS)))


def failed(warnings: DataFrame, status: str) -> DataFrame:
    """Context rows of warnings that can't be resolved at all."""
    return warnings.withColumns({"resolve_status": F.lit(status), "enclosing_function_identifier": F.lit(None).cast("string"), "enclosing_function_bodies": F.array().cast("array<string>"), "callers_by_level": F.create_map().cast(CALLERS)})


def triageable(context: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with an enclosing body that isn't blank, and the others, which get no verdict."""
    has = F.exists("enclosing_function_bodies", lambda b: ~X.blank(b))
    return context.where(has), context.where(~F.coalesce(has, F.lit(False)))


def prompts(planned: DataFrame, context: DataFrame, callers: DataFrame, system: str, blind_system: str, blind: bool = False) -> DataFrame:
    """planned (warning_id, walk, level) with context, input, prompt_error, estimated_input_tokens.

    Caller chunks are put together once for each warning and level and then in order, so texts are assembled after one aggregation."""
    clean = X.strip_comments if blind else (lambda c: c)
    bodies = lambda c: F.transform(c, clean) if blind else c
    lines = [F.col(c) for c in ("warning_code_line", "code_line", "source_line", "warning_line") if c in context.columns]
    line = X.warning_line(*[clean(c) for c in lines]) if lines else F.lit(None).cast("string")
    own = context.select("warning_id", X.finding(F.col("bug_type"), line).alias("sast"), X.function_section(bodies(F.col("enclosing_function_bodies"))).alias("function"))
    told = callers.select("warning_id", "level", "ord", bodies(F.col("bodies")).alias("bodies"), "identifier")
    each = told.groupBy("warning_id", "level").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", X.caller_chunk(F.col("identifier"), F.col("bodies")).alias("chunk")))), lambda x: x["chunk"]), "\n\n").alias("chunk"),
        F.max(F.exists("bodies", lambda b: ~X.blank(b))).alias("full"),
    )
    by_level = each.groupBy("warning_id").agg(F.array_sort(F.collect_list(F.struct("level", F.concat(F.lit(X.LEVEL_HEAD), F.col("level").cast("string"), F.lit("\n\n"), F.col("chunk")).alias("chunk"), "full"))).alias("by_level"))
    rows = planned.join(own, "warning_id").join(by_level, "warning_id", "left")
    upto = F.filter(F.coalesce("by_level", F.array().cast(by_level.schema["by_level"].dataType)), lambda x: x["level"] < F.col("level"))
    rows = rows.withColumn("upto", upto)
    asked = F.when(F.col("level") > 1, F.sequence(F.lit(1), F.col("level") - 1)).otherwise(F.array().cast("array<int>"))
    missing = F.filter(asked, lambda i: ~F.exists("upto", lambda x: x["level"] == i))
    empty = F.filter(asked, lambda i: F.exists("upto", lambda x: (x["level"] == i) & ~x["full"]))
    told_of = lambda name, a: F.when(F.size(a) > 0, F.concat(F.lit(f"{name} level(s): ["), F.array_join(a.cast("array<string>"), ", "), F.lit("]")))
    last = (F.col("level") - 1).cast("string")
    problem = F.when(F.col("function").isNull(), F.lit("record has no enclosing function body that isn't blank")).when(
        (F.size(missing) > 0) | (F.size(empty) > 0),
        F.when(F.size("upto") == 0, F.concat(F.lit("requested caller levels 1.."), last, F.lit(", but callers_by_level is missing or empty"))).otherwise(
            F.concat(F.lit("requested caller levels 1.."), last, F.lit(", but caller context is incomplete ("), F.concat_ws("; ", told_of("missing", missing), told_of("empty", empty)), F.lit(")"))
        ),
    )
    callers_text = F.array_join(F.transform("upto", lambda x: x["chunk"]), "\n\n")
    shown = (blind_system if blind else system).strip()
    out = rows.withColumns({"prompt_error": problem, "context": F.lit(shown), "input": F.when(problem.isNull(), X.input_sections(F.col("level"), F.col("sast"), F.col("function"), callers_text))})
    return out.withColumn("estimated_input_tokens", X.estimated_tokens(F.col("context"), F.coalesce("input", F.lit("")))).drop("sast", "function", "by_level", "upto")
