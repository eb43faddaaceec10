"""Queries over the driver's tables, and their SQL.

The tables hold no code and no warnings, so each query is a stand-in: an operator of the engine on another subject. All run over whole
tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as X
from .operators import callgraph as G
from .operators import context as C
from .operators import ladder as L
from .operators import resolve as R
from .operators import throttle as H
from .sources import tables as S
from .store import spread, stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def since_epoch(unit: str, ts: str = "ts") -> Column:
    """Whole units since 1970, whatever the session's time zone."""
    return F.expr(f"timestampdiff({unit}, TIMESTAMP_NTZ '1970-01-01 00:00:00', {ts})")


# walks: a user's events of a day climb levels


def event_levels(spark: SparkSession, sf_dir: str, slots: int | None = None) -> DataFrame:
    """warning_id (user), walk (day, or day modulo slots), level (in order of time), label by event type."""
    day = since_epoch("DAY").cast("int")
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("warning_id"), (day % slots if slots else day).alias("walk"), "ts", "event_id", "event_type")
    order = Window.partitionBy("warning_id", "walk").orderBy("ts", "event_id")
    label = F.when(F.col("event_type") == "error", "FP").when(F.col("event_type") == "view", "UNKNOWN").otherwise("TP")
    return e.select("warning_id", "walk", F.row_number().over(order).alias("level"), label.alias("label"))


def _levels_sql(walk: str) -> str:
    return f"""lv AS (
  SELECT user_id::VARCHAR AS warning_id, {walk} AS walk, row_number() OVER (PARTITION BY user_id, {walk} ORDER BY ts, event_id) AS level,
    CASE event_type WHEN 'error' THEN 'FP' WHEN 'view' THEN 'UNKNOWN' ELSE 'TP' END AS label FROM events),
s1 AS (SELECT *, CASE WHEN label NOT IN ('TP', 'FP') OR label IS DISTINCT FROM lag(label) OVER (PARTITION BY warning_id, walk ORDER BY level) THEN 1 ELSE 0 END AS brk FROM lv),
s2 AS (SELECT *, sum(brk) OVER (PARTITION BY warning_id, walk ORDER BY level) AS run FROM s1),
s3 AS (SELECT *, CASE WHEN label IN ('TP', 'FP') THEN row_number() OVER (PARTITION BY warning_id, walk, run ORDER BY level) ELSE 0 END AS streak,
              min(level) OVER (PARTITION BY warning_id, walk, run) AS base FROM s2),
s4 AS (SELECT *, min(level) FILTER (streak >= 3) OVER (PARTITION BY warning_id, walk) AS stop, count(*) OVER (PARTITION BY warning_id, walk) AS n_planned FROM s3),
wk AS (SELECT warning_id, walk, max_by(label, level) AS last_label, max_by(streak, level) AS last_streak, max_by(base, level) AS last_base, max(level) AS last_level,
         count(*) AS n_evaluated, max(n_planned) AS n_planned, min(level) FILTER (label = 'FP') AS first_fp, count(*) FILTER (label = 'TP') AS n_tp, count(*) FILTER (label = 'FP') AS n_fp
       FROM s4 WHERE stop IS NULL OR level <= stop GROUP BY 1, 2),
walks AS (SELECT *, last_label IN ('TP', 'FP') AS stable,
         CASE WHEN last_label IN ('TP', 'FP') THEN last_label WHEN n_tp > n_fp THEN 'TP' WHEN n_fp > n_tp THEN 'FP' ELSE 'UNKNOWN' END AS walk_label FROM wk)"""


_DAY = "date_diff('day', TIMESTAMP '1970-01-01', ts)"
_VOTES = """votes AS (SELECT warning_id, count(*) FILTER (walk_label = 'TP') AS tp, count(*) FILTER (walk_label = 'FP') AS fp, count(*) FILTER (walk_label = 'UNKNOWN') AS un,
    count(*) FILTER (walk_label = 'TP' AND stable) AS stp, count(*) FILTER (walk_label = 'FP' AND stable) AS sfp, count(*) FILTER (stable) AS n_stable, sum(n_tp) AS ltp, sum(n_fp) AS lfp
  FROM walks GROUP BY 1),
judged AS (SELECT *, CASE WHEN tp >= 2 THEN 'TP' WHEN fp >= 2 THEN 'FP' ELSE 'UNKNOWN' END AS final_label FROM votes)"""
_BEST = """best AS (SELECT w.*, final_label FROM walks w JOIN judged USING (warning_id)
  QUALIFY row_number() OVER (PARTITION BY warning_id ORDER BY (walk_label = final_label) DESC, coalesce(first_fp, -1) DESC, walk) = 1)"""


def walk_stabilize(spark, sf_dir):
    w = L.walks(event_levels(spark, sf_dir))
    as_long = [F.col(c).cast("long").alias(c) for c in ("first_fp_level", "base_level", "confirmed_at_level")]
    return w.select("warning_id", F.col("walk").cast("long").alias("walk"), "stable", "walk_label", "stop_reason", "stopped_early", *as_long, F.size("levels").cast("long").alias("n_evaluated"))


WALK_STABILIZE = f"""WITH {_levels_sql(_DAY)}
SELECT warning_id, walk::BIGINT AS walk, stable, walk_label,
  CASE WHEN last_streak >= 3 THEN 'confirmed_two_levels_above' WHEN stable THEN 'exhausted_pending_verdict' ELSE 'exhausted_no_verdict' END AS stop_reason,
  n_evaluated < n_planned AS stopped_early, first_fp::BIGINT AS first_fp_level, (CASE WHEN stable THEN last_base END)::BIGINT AS base_level,
  (CASE WHEN last_streak >= 3 THEN last_level END)::BIGINT AS confirmed_at_level, n_evaluated::BIGINT AS n_evaluated FROM walks"""


def vote_final(spark, sf_dir):
    v = L.verdicts(L.walks(event_levels(spark, sf_dir, 3)), 3)
    return v.select("warning_id", "label", "is_stable", "majority_label", F.col("n_stable_walks").cast("long").alias("n_stable_walks"))


VOTE_FINAL = f"""WITH {_levels_sql(_DAY + " % 3")}, {_VOTES}
SELECT warning_id, final_label AS label, CASE final_label WHEN 'TP' THEN stp >= 2 WHEN 'FP' THEN sfp >= 2 ELSE false END AS is_stable,
  CASE WHEN ltp > lfp THEN 'TP' WHEN lfp > ltp THEN 'FP' ELSE 'UNKNOWN' END AS majority_label, n_stable::BIGINT AS n_stable_walks FROM judged"""


def _judged(spark, sf_dir):
    w = stored(L.walks(event_levels(spark, sf_dir, 3)), "walks")
    v = L.verdicts(w, 3)
    return v, L.representative(w, v)


def representative_walk(spark, sf_dir):
    return _judged(spark, sf_dir)[1].select("warning_id", F.col("walk").cast("long").alias("walk"), "walk_label", F.col("first_fp_level").cast("long").alias("first_fp_level"), "final_label")


REPRESENTATIVE = f"WITH {_levels_sql(_DAY + ' % 3')}, {_VOTES}, {_BEST} SELECT warning_id, walk::BIGINT AS walk, walk_label, first_fp::BIGINT AS first_fp_level, final_label FROM best"


def report_levels(spark, sf_dir):
    v, best = _judged(spark, sf_dir)
    facts = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("warning_id")).distinct()
    r = L.reports(v, best, facts, "offline").select("warning_id", "model", "final_label", F.inline("levels"))
    return r.withColumn("level", F.col("level").cast("long"))


REPORT_LEVELS = f"""WITH {_levels_sql(_DAY + " % 3")}, {_VOTES}, {_BEST}
SELECT b.warning_id, 'offline' AS model, b.final_label, s.level::BIGINT AS level, s.label FROM best b JOIN s4 s ON s.warning_id = b.warning_id AND s.walk = b.walk
WHERE s.stop IS NULL OR s.level <= s.stop"""


# answers


def label_extract(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    answers = [F.lit('{"label": "tp", "reason": "x"}'), F.lit('{"label": null} "label": "FP"'), F.concat(F.lit('{"label": "'), F.col("event_type"), F.lit('"}')), F.lit('```{"label" : "unknown"}```'), F.lit("no label here"), F.lit('{"label": 3}'), F.lit(""), F.lit('[{"label": "FP"}]'), F.lit(None).cast("string")]
    answer = F.element_at(F.array(*answers), (F.col("event_id") % len(answers) + 1).cast("int"))
    return e.select("event_id", X.extract_label(answer).alias("label"))


LABEL_EXTRACT = r"""WITH a AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN '{"label": "tp", "reason": "x"}' WHEN 1 THEN '{"label": null} "label": "FP"'
  WHEN 2 THEN '{"label": "' || event_type || '"}' WHEN 3 THEN '```{"label" : "unknown"}```' WHEN 4 THEN 'no label here' WHEN 5 THEN '{"label": 3}' WHEN 6 THEN ''
  WHEN 7 THEN '[{"label": "FP"}]' END AS s FROM events),
b AS (SELECT event_id, s, CASE WHEN json_valid(s) THEN json_extract_string(s, '$.label') END AS inside FROM a)
SELECT event_id, CASE WHEN inside IS NOT NULL THEN CASE WHEN upper(inside) IN ('TP', 'FP', 'UNKNOWN') THEN upper(inside) END
  ELSE upper(nullif(regexp_extract(s, '(?i)"label"\s*:\s*"(TP|FP|UNKNOWN)"', 1), '')) END AS label FROM b"""


# points in spans


def _spans(spark, sf_dir):
    """A view or signup event opens a span that its user's next event of that type closes."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", since_epoch("MICROSECOND").alias("us"))
    order = Window.partitionBy("user_id", "event_type").orderBy("us", "event_id")
    spans = e.where("event_type IN ('view', 'signup')").withColumn("close", F.lead("us").over(order) - 1).where("close IS NOT NULL AND close >= us")
    return e, spans


_SPANS = """e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us FROM events),
spans AS (SELECT * FROM (SELECT *, lead(us) OVER (PARTITION BY user_id, event_type ORDER BY us, event_id) - 1 AS close FROM e WHERE event_type IN ('view', 'signup'))
  WHERE close IS NOT NULL AND close >= us)"""


def enclosing_span(spark, sf_dir):
    e, spans = _spans(spark, sf_dir)
    points = e.where("event_type = 'error'").select("event_id", "user_id", F.col("us").alias("at"))
    found = R.spans_at(points, spans.select("user_id", F.col("us").alias("open"), "close", F.col("event_id").alias("span_id")), ["user_id"], "at", "open", "close", "span_id", 86_400_000_000)
    return found.select("event_id", "span_id", (F.col("close") - F.col("open")).alias("span_us"))


ENCLOSING_SPAN = f"""WITH {_SPANS}
SELECT p.event_id, s.event_id AS span_id, s.close - s.us AS span_us FROM e p JOIN spans s ON s.user_id = p.user_id AND p.us BETWEEN s.us AND s.close WHERE p.event_type = 'error'
QUALIFY row_number() OVER (PARTITION BY p.event_id ORDER BY s.close - s.us, s.event_id) = 1"""


def resolve_status(spark, sf_dir):
    """Spans as functions (rows are minutes, files are users), errors as warnings; every tenth names a file that isn't there."""
    e, spans = _spans(spark, sf_dir)
    minute = lambda c: F.floor(F.col(c) / 60_000_000).cast("int")
    sig = F.struct(F.lit("func").alias("ftype"), F.col("event_type").alias("name"), F.col("event_id").cast("string").alias("return_type"), F.lit(False).alias("is_static"), F.array().cast("array<string>").alias("param_types"))
    decls = spans.select(F.lit("log").alias("unit"), F.concat(F.lit("src/user_"), "user_id", F.lit(".c")).alias("file_key"), sig.alias("sig"), minute("us").alias("start_row"), minute("close").alias("end_row"))
    wanted = F.when(F.col("event_id") % 3 == 0, "view").when(F.col("event_id") % 3 == 1, "signup")
    asked = e.where("event_type = 'error'").select(
        F.col("event_id").alias("warning_id"), F.lit("log").alias("unit"), F.concat(F.when(F.col("event_id") % 10 == 0, "./none_").otherwise("user_"), "user_id", F.lit(".c")).alias("file_path"),
        (minute("us") + 1).cast("string").alias("line_number"), wanted.alias("enclosing_function"),
    )
    matched = R.decl_files(asked, decls.select("unit", "file_key"))
    return R.status_counts(R.enclosing(asked, matched, decls))


RESOLVE_STATUS = f"""WITH {_SPANS},
w AS (SELECT event_id, user_id, us // 60000000 AS m, CASE event_id % 3 WHEN 0 THEN 'view' WHEN 1 THEN 'signup' END AS wanted,
  event_id % 10 <> 0 AND user_id IN (SELECT user_id FROM spans) AS has_file FROM e WHERE event_type = 'error'),
c AS (SELECT w.event_id, any_value(has_file) AS has_file, count(*) FILTER (inside) AS n_around, count(*) FILTER (inside AND named) AS n_both, count(*) FILTER (named) AS n_named
  FROM (SELECT w.*, coalesce(w.m BETWEEN s.us // 60000000 AND s.close // 60000000, false) AS inside, coalesce(s.event_type = w.wanted, false) AS named
        FROM w LEFT JOIN spans s ON s.user_id = w.user_id AND w.has_file) w GROUP BY 1)
SELECT CASE WHEN NOT has_file THEN 'file_not_resolved' WHEN n_both = 1 THEN 'line_name_match' WHEN n_both > 1 THEN 'line_name_multiple_first_used' WHEN n_around = 1 THEN 'enclosing_line_match'
  WHEN n_around > 1 THEN 'enclosing_line_multiple_smallest_span' WHEN n_named = 1 THEN 'name_match' WHEN n_named > 1 THEN 'name_multiple_first_used' ELSE 'function_not_resolved' END AS resolve_status,
  count(*)::BIGINT AS n FROM c GROUP BY 1"""


# graphs


def caller_levels(spark, sf_dir):
    """Parts that follow each other in an order, from every part, two levels: the depth that callers have by default."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"))
    edges = stored(li.where("dst IS NOT NULL").distinct(), "edges")
    starts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("start"))
    return G.levels(starts, edges, 2).withColumn("level", F.col("level").cast("long"))


CALLER_LEVELS = """WITH RECURSIVE edges AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS dst
  FROM lineitem) WHERE dst IS NOT NULL),
walk AS (SELECT p_partkey AS start, p_partkey AS node, 0 AS level FROM part
  UNION SELECT w.start, e.dst, w.level + 1 FROM walk w JOIN edges e ON e.src = w.node WHERE w.level < 2)
SELECT start, min(level)::BIGINT AS level, node FROM walk WHERE node <> start GROUP BY start, node"""


def name_callers(spark, sf_dir):
    """Documents as functions named by their first word, calling every word they hold; those of low quality are static to their source."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    funcs = d.select(F.lit("corpus").alias("unit"), F.col("source").alias("file_key"), F.col("doc_id").alias("node"), F.regexp_extract(F.lower("text"), "[a-z]+", 0).alias("name"), F.coalesce(F.col("quality") == 0, F.lit(False)).alias("static"), F.transform(words, lambda w: F.struct(w.alias("name"))).alias("calls"))
    return G.caller_counts(funcs).select(F.col("node").alias("doc_id"), "n_callers")


NAME_CALLERS = """WITH f AS (SELECT d.doc_id, source, regexp_extract(lower(text), '[a-z]+', 0) AS name, coalesce(quality = 0, false) AS static, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS words
  FROM documents d LEFT JOIN labels l USING (doc_id)),
c AS (SELECT doc_id AS caller, source, unnest(words) AS name FROM f),
g AS (SELECT name, count(*) AS n FROM c GROUP BY 1), h AS (SELECT source, name, count(*) AS n FROM c GROUP BY 1, 2)
SELECT f.doc_id, (CASE WHEN static THEN coalesce(h.n, 0) ELSE coalesce(g.n, 0) END)::BIGINT AS n_callers FROM f LEFT JOIN g ON g.name = f.name LEFT JOIN h ON h.name = f.name AND h.source = f.source"""


# paths


def path_resolve(spark, sf_dir):
    """Pages as files, asked for by their last one or two segments."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    asked = p.select(F.col("page_id").alias("warning_id"), F.lit("web").alias("unit"), F.concat(F.element_at(F.array(F.lit(""), F.lit("./"), F.lit("../")), (F.col("page_id") % 3 + 1).cast("int")), F.substring_index("path", "/", -2)).alias("file_path"))
    return R.decl_files(asked, p.select(F.lit("web").alias("unit"), F.col("path").alias("file_key"))).select(F.col("warning_id").alias("page_id"), "file_key")


PATH_RESOLVE = r"""WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages),
q AS (SELECT page_id, (['', './', '../'])[page_id % 3 + 1] || array_to_string(list_slice(string_split(path, '/'), -2, -1), '/') AS fp FROM p),
v AS (SELECT page_id, 0 AS ord, fp AS variant FROM q UNION ALL SELECT page_id, 1, ltrim(fp, './') FROM q UNION ALL SELECT page_id, 2, string_split(fp, '/')[-1] FROM q)
SELECT page_id, path AS file_key FROM (SELECT v.page_id, f.path, v.ord FROM v JOIN p f ON f.path = v.variant OR f.path LIKE '%/' || replace(replace(v.variant, '%', '\%'), '_', '\_') ESCAPE '\' OR ends_with(v.variant, '/' || f.path))
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY ord, path) = 1"""


def checkout_paths(spark, sf_dir):
    """Pages as checkout files; the last segment must be unambiguous."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    asked = p.select(F.col("page_id").alias("warning_id"), F.lit("web").alias("repo_root"), F.when(F.col("page_id") % 2 == 0, F.col("path")).otherwise(X.basename(F.col("path"))).alias("file_path"))
    return R.checkout_files(asked, p.select(F.lit("web").alias("repo_root"), "path")).select(F.col("warning_id").alias("page_id"), "resolved_file_path")


CHECKOUT_PATHS = r"""WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages),
q AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN path ELSE string_split(path, '/')[-1] END AS target FROM p),
f AS (SELECT DISTINCT path, string_split(path, '/')[-1] AS base FROM p),
m AS (SELECT q.page_id, q.target, f.path, f.path = q.target AS exact, f.path = q.target OR ends_with(f.path, '/' || q.target) AS suffix FROM q JOIN f ON f.base = string_split(q.target, '/')[-1] WHERE q.target <> '')
SELECT page_id, coalesce(max(path) FILTER (exact), CASE WHEN count(*) FILTER (suffix) = 1 THEN min(path) FILTER (suffix) WHEN count(*) FILTER (suffix) = 0 AND count(*) = 1 THEN min(path) END) AS resolved_file_path FROM m GROUP BY 1"""


def unique_checkouts(spark, sf_dir):
    """Customers' segments, nations and a commit of some as projects, urls and commits."""
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("project"), F.when(F.col("c_nationkey") > 0, F.concat(F.lit("https://host/"), "c_nationkey")).otherwise("").alias("project_url"), F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("0123456789abcdef"), F.col("c_custkey") % 3)).otherwise("").alias("commit_id"), F.col("c_custkey").alias("ordinal"))
    return S.unique_checkouts(c).withColumn("key", X.checkout_key(F.col("project"), F.col("commit")))


UNIQUE_CHECKOUTS = """SELECT c_mktsegment AS project, 'https://host/' || c_nationkey AS url, CASE WHEN c_custkey % 3 > 0 THEN '0123456789abcdef' || (c_custkey % 3) END AS "commit", min(c_custkey) AS ordinal,
  any_value(regexp_replace(c_mktsegment, '[^A-Za-z0-9._-]', '_', 'g') || CASE WHEN c_custkey % 3 > 0 THEN '__0123456789ab' ELSE '' END) AS key
FROM customer WHERE c_nationkey > 0 GROUP BY 1, 2, 3"""


def identifiers(spark, sf_dir):
    """Parts as signatures, shown as text."""
    sig = F.struct(F.lit("func").alias("ftype"), F.col("p_name").alias("name"), F.col("p_type").alias("return_type"), (F.col("p_size") % 2 == 0).alias("is_static"), F.when(F.col("p_size") % 3 == 0, F.array().cast("array<string>")).when(F.col("p_size") % 3 == 1, F.array("p_brand")).otherwise(F.array("p_brand", F.lit("it's"))).alias("param_types"))
    return table(spark, sf_dir, "part").select("p_partkey", X.identifier(F.concat(F.lit("/root/src/"), F.col("p_brand"), F.lit(".c")), sig, F.lit("/root/src")).alias("identifier"))


IDENTIFIERS = """SELECT p_partkey, p_brand || '.c::(''func'', ''' || p_name || ''', ''' || p_type || ''', ' || CASE WHEN p_size % 2 = 0 THEN 'True' ELSE 'False' END || ', ' ||
  CASE p_size % 3 WHEN 0 THEN '()' WHEN 1 THEN '(''' || p_brand || ''',)' ELSE '(''' || p_brand || ''', "it''s")' END || ')' AS identifier FROM part"""


def joined_checkouts(spark, sf_dir):
    """Customers as warnings, met with the checkout of their project and commit; no commit equals no commit."""
    commit = F.when(F.col("c_custkey") % 3 == 1, F.lit("0a")).when(F.col("c_custkey") % 3 == 2, F.lit(""))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("project"), commit.alias("commit_id"))
    made = c.where("project <> 'BUILDING'").groupBy("project", F.nullif("commit_id", F.lit("")).alias("commit")).agg(F.concat(F.first("project"), F.lit("/"), F.coalesce(F.first(F.nullif("commit_id", F.lit(""))), F.lit("none"))).alias("dest"))
    return S.join_checkouts(c, made.withColumn("ok", F.col("commit").isNotNull())).select("c_custkey", "repo_root", "ok")


JOINED_CHECKOUTS = """WITH c AS (SELECT c_custkey, c_mktsegment AS project, CASE WHEN c_custkey % 3 = 1 THEN '0a' END AS "commit" FROM customer),
m AS (SELECT DISTINCT project, "commit", project || '/' || coalesce("commit", 'none') AS repo_root, "commit" IS NOT NULL AS ok FROM c WHERE project <> 'BUILDING')
SELECT c.c_custkey, m.repo_root, m.ok FROM c LEFT JOIN m ON m.project = c.project AND m."commit" IS NOT DISTINCT FROM c."commit" """


def _parts(spark, sf_dir):
    """Parts as functions named by their type and size, in a file for each brand, calling those of the two parts after them."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.concat("p_type", F.lit(" "), "p_size").alias("p_type"), "p_size")
    called = p.select(F.explode(F.array(F.col("p_partkey") - 1, F.col("p_partkey") - 2)).alias("p_partkey"), F.struct(F.col("p_type").alias("name")).alias("c")).groupBy("p_partkey").agg(F.collect_list("c").alias("calls"))
    f = p.join(called, "p_partkey", "left").withColumn("calls", F.coalesce("calls", F.array().cast("array<struct<name: string>>")))
    return f.select(F.lit("shop").alias("unit"), F.col("p_brand").alias("file_key"), F.col("p_partkey").alias("node"), F.col("p_type").alias("name"), (F.col("p_size") % 2 == 0).alias("static"), "calls", F.col("calls").alias("expr_used"))


_PARTS = """p AS (SELECT p_partkey, p_brand, p_type || ' ' || p_size AS p_type, p_size % 2 = 0 AS static FROM part),
c AS (SELECT a.p_partkey, a.p_brand, a.p_type AS own, b.p_type AS name FROM p a JOIN p b ON b.p_partkey - a.p_partkey IN (1, 2))"""


def call_edges(spark, sf_dir):
    return G.callers(_parts(spark, sf_dir)).select("callee", "caller")


CALL_EDGES = f"""WITH {_PARTS} SELECT DISTINCT p.p_partkey AS callee, c.p_partkey AS caller FROM c JOIN p ON p.p_type = c.name AND (NOT p.static OR p.p_brand = c.p_brand)"""


def name_references(spark, sf_dir):
    return G.back_references(_parts(spark, sf_dir)).select("target", "source")


NAME_REFERENCES = f"""WITH {_PARTS} SELECT DISTINCT p.p_partkey AS target, c.p_partkey AS source FROM c JOIN p ON p.p_type = c.name AND c.name <> c.own AND (NOT p.static OR p.p_brand = c.p_brand)"""


def callers_of_some(spark, sf_dir):
    """Callers of the suppliers' parts by the frontier's names, two levels, without the edges of all parts."""
    starts = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("start"))
    return G.callers_by_name(starts, _parts(spark, sf_dir), 2).withColumn("level", F.col("level").cast("long"))


CALLERS_OF_SOME = f"""WITH RECURSIVE {_PARTS},
e AS (SELECT DISTINCT p.p_partkey AS callee, c.p_partkey AS caller FROM c JOIN p ON p.p_type = c.name AND (NOT p.static OR p.p_brand = c.p_brand)),
walk AS (SELECT s_suppkey AS start, s_suppkey AS node, 0 AS level FROM supplier UNION SELECT w.start, e.caller, w.level + 1 FROM walk w JOIN e ON e.callee = w.node WHERE w.level < 2)
SELECT start, min(level)::BIGINT AS level, node FROM walk WHERE node <> start GROUP BY start, node"""


def last_entries(spark, sf_dir):
    """Line items as entries of files by ship status, one signature for each part: the one that begins last stays."""
    sig = F.struct(F.lit("func").alias("ftype"), F.col("l_partkey").cast("string").alias("name"), F.lit("").alias("return_type"), F.lit(False).alias("is_static"), F.array().cast("array<string>").alias("param_types"))
    d = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("unit"), F.col("l_linestatus").alias("file_key"), sig.alias("sig"), F.col("l_orderkey").alias("start_row"), F.col("l_linenumber").alias("start_col"))
    return G.last_of_each(d).select("unit", "file_key", F.col("sig.name").alias("name"), "start_row", F.col("start_col").cast("long").alias("start_col"))


LAST_ENTRIES = """SELECT l_returnflag AS unit, l_linestatus AS file_key, l_partkey::VARCHAR AS name, l_orderkey AS start_row, l_linenumber::BIGINT AS start_col FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_returnflag, l_linestatus, l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC) = 1"""


def entry_lookup(spark, sf_dir):
    """Parts as entries of a file for each brand. Each is asked for by its signature, by its kind and name, or by its name alone."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.concat("p_type", F.lit(" "), F.col("p_size") % 5).alias("name"), F.when(F.col("p_size") % 2 == 0, "func").otherwise("func_decl").alias("kind"))
    sig = lambda kind, told: F.struct(kind.alias("ftype"), F.col("name"), told.alias("return_type"), F.lit(False).alias("is_static"), F.array().cast("array<string>").alias("param_types"))
    key = F.col("p_partkey").cast("string")
    decls = p.select(F.lit("shop").alias("unit"), F.col("p_brand").alias("file_key"), sig(F.col("kind"), key).alias("sig"), F.col("p_partkey").alias("start_row"))
    way = F.col("p_partkey") % 3
    asked = p.select(F.lit("shop").alias("unit"), F.col("p_brand").alias("file_key"), sig(F.when(way == 2, "macro").otherwise(F.col("kind")), F.when(way == 0, key).otherwise(F.concat(F.lit("asked "), key))).alias("sig"))
    return R.lookup(asked, decls).select(F.col("sig.return_type").alias("asked"), F.col("found.return_type").alias("found"))


ENTRY_LOOKUP = """WITH p AS (SELECT p_partkey, p_brand, p_type || ' ' || p_size % 5 AS name, CASE WHEN p_size % 2 = 0 THEN 'func' ELSE 'func_decl' END AS kind FROM part)
SELECT CASE WHEN a.p_partkey % 3 = 0 THEN '' ELSE 'asked ' END || a.p_partkey AS asked, d.p_partkey::VARCHAR AS found FROM p a JOIN p d ON d.p_brand = a.p_brand AND d.name = a.name
QUALIFY row_number() OVER (PARTITION BY a.p_partkey ORDER BY CASE WHEN a.p_partkey % 3 = 0 AND a.p_partkey = d.p_partkey THEN 0 WHEN a.p_partkey % 3 < 2 AND a.kind = d.kind THEN 1 ELSE 2 END, d.p_partkey) = 1"""


def _orders(spark, sf_dir):
    """Orders as functions in a file for each customer, which call (and use as types) one name each; and each file's first one, with a limit of
    rows for even customers."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    used = F.array(F.struct(F.concat(F.lit("f"), F.floor(F.col("o_orderkey") / 3) % 5).alias("name"), (F.col("o_orderkey") % 7).cast("int").alias("row")))
    sig = F.struct(F.lit("func").alias("ftype"), F.concat(F.lit("f"), F.col("o_orderkey") % 5).alias("name"), F.col("o_orderkey").cast("string").alias("return_type"), F.lit(False).alias("is_static"), F.array().cast("array<string>").alias("param_types"))
    decls = o.select(F.lit("shop").alias("unit"), F.col("o_custkey").cast("string").alias("file_key"), sig.alias("sig"), used.alias("calls"), used.alias("types_used"))
    first = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
    roots = first.select(G.node_id(F.lit("shop"), F.col("o_custkey").cast("string"), sig).alias("start"), F.when(F.col("o_custkey") % 2 == 0, 3).alias("lineno"))
    return roots, decls


def _order_keys(found):
    key = lambda c: F.regexp_extract(c, "'([0-9]+)', False", 1).cast("long").alias(c)
    return found.select(key("start"), key("node"))


_ORDERS = """d AS (SELECT o_custkey AS f, o_orderkey AS k, o_orderkey % 5 AS name, o_orderkey // 3 % 5 AS called, o_orderkey % 7 AS row FROM orders),
e AS (SELECT a.k AS src, b.k AS dst, a.row FROM d a JOIN d b ON b.f = a.f AND b.name = a.called),
r AS (SELECT min(k) AS k, CASE WHEN f % 2 = 0 THEN 3 END AS lim FROM d GROUP BY f)"""


def callees_in_file(spark, sf_dir):
    return _order_keys(G.local_callees(*_orders(spark, sf_dir)))


CALLEES_IN_FILE = f"""WITH RECURSIVE {_ORDERS},
reach(start, node) AS (SELECT r.k, e.dst FROM r JOIN e ON e.src = r.k WHERE lim IS NULL OR row <= lim UNION SELECT start, dst FROM reach JOIN e ON src = node)
SELECT start, node FROM reach UNION SELECT k, k FROM r"""


def types_in_file(spark, sf_dir):
    return _order_keys(G.used_types(*_orders(spark, sf_dir)))


TYPES_IN_FILE = f"""WITH RECURSIVE {_ORDERS},
reach(start, lim, node) AS (SELECT k, lim, k FROM r UNION SELECT start, lim, dst FROM reach JOIN e ON src = node AND (lim IS NULL OR row <= lim))
SELECT DISTINCT start, node FROM reach"""


# texts


def line_number(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.number_lines(F.col("text"))).alias("numbered"))


_NUMBERED = """array_to_string(list_transform(range(1, len({r}) + 1), lambda i: 'L' || lpad(i::VARCHAR, length(len({r})::VARCHAR)::INTEGER, '0') || ': ' || {r}[i]), chr(10))"""
LINE_NUMBER = f"""WITH a AS (SELECT doc_id, CASE WHEN text = '' THEN []::VARCHAR[] WHEN ends_with(text, chr(10)) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS r FROM documents)
SELECT doc_id, md5({_NUMBERED.format(r="r")}) AS numbered FROM a"""


def strip_comments(spark, sf_dir):
    """Pages as they are (their addresses hold //), and documents with comments and literals put around them."""
    pages = table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("code"))
    docs = table(spark, sf_dir, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), F.concat(F.lit('/* a\n b */"/*" '), F.replace("text", F.lit(". "), F.lit(". // ")), F.lit(" '//' /* end"), F.replace("text", F.lit("a"), F.lit("*/\""))).alias("code"))
    return pages.unionByName(docs).select("kind", "id", F.md5(X.strip_comments(F.col("code"))).alias("stripped"))


STRIP_COMMENTS = r"""WITH c AS (SELECT 'page' AS kind, page_id AS id, html AS code FROM pages
  UNION ALL SELECT 'doc', doc_id, '/* a' || chr(10) || ' b */"/*" ' || replace(text, '. ', '. // ') || ' ''//'' /* end' || replace(text, 'a', '*/"') FROM documents)
SELECT kind, id, md5(array_to_string(list_transform(regexp_extract_all(code, '(?s)"(?:[^"\\]|\\.)*(?:"|\\?\z)|''(?:[^''\\]|\\.)*(?:''|\\?\z)|//[^\n]*|/\*.*?(?:\*/|\z)|[^"''/]+|/'),
  lambda t: CASE WHEN starts_with(t, '//') THEN '' WHEN starts_with(t, '/*') THEN regexp_replace(t, '[^\n]', '', 'g') || CASE WHEN length(t) >= 4 AND ends_with(t, '*/') THEN ' ' ELSE '' END ELSE t END), '')) AS stripped FROM c"""


# budgets, plans, resumption


def token_budget(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", since_epoch("MICROSECOND").alias("us"), F.floor("value").cast("long").alias("tokens"))
    return H.demand(e, "event_type", "us", "tokens").select("event_id", "in_window")


TOKEN_BUDGET = """SELECT event_id, (sum(floor(value)::BIGINT) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW))::BIGINT AS in_window FROM events"""


def token_admission(spark, sf_dir):
    """When each event's tokens fit under its type's budget of 3000 a minute."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", (since_epoch("MICROSECOND") / 1e6).alias("at"), F.greatest(F.lit(0), F.floor("value")).cast("long").alias("tokens"))
    return H.admitted(e, "event_type", "at", "tokens", "event_id", 3000).select("event_id", "admitted_at")


#: A round takes each type's next event; the state holds what was admitted in the window.
TOKEN_ADMISSION = """WITH RECURSIVE e AS (SELECT event_id, event_type AS k, epoch_us(ts) / 1e6::DOUBLE AS at, greatest(0, floor(value)::BIGINT) AS n, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events),
run(k, i, event_id, clock, seen) AS (
  SELECT DISTINCT k, 0::BIGINT, NULL::BIGINT, '-infinity'::DOUBLE, []::STRUCT(t DOUBLE, n BIGINT)[] FROM e
  UNION ALL
  SELECT k, i, event_id, go, CASE WHEN counted THEN list_append(kept, {'t': go, 'n': n}) ELSE kept END FROM (
    SELECT *, CASE WHEN NOT counted OR lacking <= 0 THEN now ELSE greatest(now + 0.1::DOUBLE,
        list_filter(kept, lambda x, p: coalesce(list_sum(list_transform(kept[1:p], lambda y: y.n)), 0) >= lacking)[1].t + 60.05::DOUBLE) END AS go FROM (
      SELECT *, n > 0 AND n <= 3000 AS counted, coalesce(list_sum(list_transform(kept, lambda x: x.n)), 0) + n - 3000 AS lacking FROM (
        SELECT e.k, e.i, e.event_id, e.n, greatest(r.clock, e.at) AS now, list_filter(r.seen, lambda x: x.t > greatest(r.clock, e.at) - 60) AS kept
        FROM run r JOIN e ON e.k = r.k AND e.i = r.i + 1))))
SELECT event_id, clock AS admitted_at FROM run WHERE event_id IS NOT NULL"""


def max_level(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("warning_id"), F.col("turn").alias("level"))
    return L.max_level(c, c.select("warning_id").distinct(), 6).select(F.col("warning_id").alias("conv_id"), F.col("max_level").cast("long").alias("max_level"))


MAX_LEVEL = """WITH t AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE turn >= 1), n AS (SELECT conv_id, turn = row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ok FROM t)
SELECT c.conv_id, greatest(1, least(1 + coalesce(k, 0), 6))::BIGINT AS max_level FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN (SELECT conv_id, count(*) FILTER (ok) AS k FROM n GROUP BY 1) USING (conv_id)"""


def resume_pending(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("warning_id"), "source")
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("warning_id"), F.lit("m").alias("model"))
    return S.pending(docs, done, "m").select(F.col("warning_id").alias("doc_id"), "source")


RESUME_PENDING = "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)"


def prompt_sections(spark, sf_dir):
    """Conversations as warnings: the first turn is the function, later turns are callers; the deepest prompt of each."""
    c = table(spark, sf_dir, "conversations")
    first = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"), F.min_by("role", "turn").alias("role"))
    context = first.select(F.col("conv_id").alias("warning_id"), F.array("role").alias("bug_type"), F.lit(" x \n").alias("code_line"), F.array("text").alias("enclosing_function_bodies"))
    callers = c.where("turn >= 1").select(F.col("conv_id").alias("warning_id"), F.col("turn").cast("int").alias("level"), F.lit(1).alias("ord"), F.col("role").alias("identifier"), F.array("text").alias("bodies"))
    sized = L.max_level(callers, context.select("warning_id"))
    plan = sized.select("warning_id", F.lit(0).alias("walk"), F.col("max_level").alias("level"))
    p = C.prompts(plan, context, callers, "system", "blind")
    return p.select(F.col("warning_id").alias("conv_id"), F.col("level").cast("long").alias("level"), F.md5("input").alias("input"), F.col("prompt_error").isNotNull().alias("failed"))


_ROWS = "string_split(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10))"
PROMPT_SECTIONS = f"""WITH t AS (SELECT conv_id, turn, role, {_ROWS} AS r FROM conversations),
n AS (SELECT conv_id, turn, role, {_NUMBERED.format(r="r")} AS body FROM t),
f AS (SELECT conv_id, arg_min(role, turn) AS role, arg_min(body, turn) AS body FROM n GROUP BY 1),
k AS (SELECT conv_id, turn, turn = row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ok FROM (SELECT DISTINCT conv_id, turn FROM n WHERE turn >= 1)),
m AS (SELECT f.conv_id, f.role, f.body, 1 + coalesce((SELECT count(*) FILTER (ok) FROM k WHERE k.conv_id = f.conv_id), 0) AS level FROM f),
c AS (SELECT conv_id, turn, '## Caller level ' || turn || chr(10) || chr(10) || '### Caller function: ' || role || chr(10) || chr(10) || body AS chunk FROM n WHERE turn >= 1),
j AS (SELECT m.conv_id, string_agg(chunk, chr(10) || chr(10) ORDER BY turn) AS callers FROM m JOIN c ON c.conv_id = m.conv_id AND c.turn < m.level GROUP BY 1)
SELECT m.conv_id, m.level::BIGINT AS level, false AS failed,
  md5('### SAST finding' || chr(10) || 'Warning type: ' || m.role || chr(10) || 'Warning code line:  x' || chr(10) || chr(10) || '### Function containing the warning line' || chr(10) || '// Enclosing function body 1' || chr(10) || m.body
   || CASE WHEN m.level > 1 THEN chr(10) || chr(10) || '### Caller Context' || chr(10) || j.callers ELSE '' END) AS input FROM m LEFT JOIN j USING (conv_id)"""


def context_problems(spark, sf_dir):
    """What is wrong with the fourth level's context of conversations, some of whose turns are missing or empty."""
    c = table(spark, sf_dir, "conversations")
    context = c.select(F.col("conv_id").alias("warning_id"), F.array(F.lit("b")).alias("bug_type"), F.lit("x").alias("code_line"), F.array(F.lit("body")).alias("enclosing_function_bodies")).distinct()
    turns = c.where("turn >= 1 AND (conv_id + turn) % 4 > 0").select("conv_id", "turn").distinct()
    callers = turns.select(F.col("conv_id").alias("warning_id"), F.col("turn").cast("int").alias("level"), F.lit(1).alias("ord"), F.lit("f").alias("identifier"), F.array(F.when(F.expr("(conv_id + turn) % 5 = 0"), " ").otherwise("x")).alias("bodies"))
    plan = context.select("warning_id", F.lit(0).alias("walk"), F.lit(4).alias("level"))
    return C.prompts(plan, context, callers, "system", "blind").select(F.col("warning_id").alias("conv_id"), "prompt_error")


CONTEXT_PROBLEMS = """WITH l AS (SELECT DISTINCT conv_id, turn, (conv_id + turn) % 5 > 0 AS whole FROM conversations WHERE turn BETWEEN 1 AND 3 AND (conv_id + turn) % 4 > 0),
t AS (SELECT conv_id, i, any_value(whole) FILTER (here) AS whole FROM (SELECT c.conv_id, r.i, l.whole, l.turn IS NOT NULL AS here FROM (SELECT DISTINCT conv_id FROM conversations) c CROSS JOIN range(1, 4) r(i) LEFT JOIN l ON l.conv_id = c.conv_id AND l.turn = r.i) GROUP BY 1, 2),
s AS (SELECT conv_id, count(whole) AS n, string_agg(i::VARCHAR, ', ' ORDER BY i) FILTER (whole IS NULL) AS missing, string_agg(i::VARCHAR, ', ' ORDER BY i) FILTER (NOT whole) AS empty FROM t GROUP BY 1)
SELECT conv_id, CASE WHEN n = 0 THEN 'requested caller levels 1..3, but callers_by_level is missing or empty' WHEN missing IS NOT NULL OR empty IS NOT NULL THEN
  'requested caller levels 1..3, but caller context is incomplete (' || concat_ws('; ', 'missing level(s): [' || missing || ']', 'empty level(s): [' || empty || ']') || ')' END AS prompt_error FROM s"""


def dry_counts(spark, sf_dir):
    """Outcomes of building prompts from conversations, and of those that have no body."""
    from .plans.jobs import dry_run

    c = table(spark, sf_dir, "conversations")
    context = c.groupBy("conv_id").agg(F.array(F.max(F.when((F.col("turn") == 0) & (F.col("conv_id") % 7 > 0), F.col("text")))).alias("enclosing_function_bodies")).select(F.col("conv_id").alias("warning_id"), F.array(F.lit("x")).alias("bug_type"), F.lit("x").alias("code_line"), "enclosing_function_bodies")
    callers = c.where("turn >= 1").select(F.col("conv_id").alias("warning_id"), F.col("turn").cast("int").alias("level"), F.lit(1).alias("ord"), F.col("role").alias("identifier"), F.array("text").alias("bodies"))
    return dry_run(context, callers)


DRY_COUNTS = r"""WITH b AS (SELECT conv_id, max(text) FILTER (turn = 0 AND conv_id % 7 > 0) AS body FROM conversations GROUP BY 1)
SELECT CASE WHEN regexp_replace(coalesce(body, ''), '\s', '', 'g') = '' THEN 'no_enclosing_body' ELSE 'ok' END AS status, count(*)::BIGINT AS n FROM b GROUP BY 1"""


QUERIES = {
    "walk_stabilize": (walk_stabilize, WALK_STABILIZE),
    "vote_final": (vote_final, VOTE_FINAL),
    "representative_walk": (representative_walk, REPRESENTATIVE),
    "report_levels": (report_levels, REPORT_LEVELS),
    "label_extract": (label_extract, LABEL_EXTRACT),
    "enclosing_span": (enclosing_span, ENCLOSING_SPAN),
    "resolve_status": (resolve_status, RESOLVE_STATUS),
    "caller_levels": (caller_levels, CALLER_LEVELS),
    "name_callers": (name_callers, NAME_CALLERS),
    "path_resolve": (path_resolve, PATH_RESOLVE),
    "checkout_paths": (checkout_paths, CHECKOUT_PATHS),
    "unique_checkouts": (unique_checkouts, UNIQUE_CHECKOUTS),
    "identifiers": (identifiers, IDENTIFIERS),
    "joined_checkouts": (joined_checkouts, JOINED_CHECKOUTS),
    "call_edges": (call_edges, CALL_EDGES),
    "name_references": (name_references, NAME_REFERENCES),
    "callers_of_some": (callers_of_some, CALLERS_OF_SOME),
    "last_entries": (last_entries, LAST_ENTRIES),
    "entry_lookup": (entry_lookup, ENTRY_LOOKUP),
    "callees_in_file": (callees_in_file, CALLEES_IN_FILE),
    "types_in_file": (types_in_file, TYPES_IN_FILE),
    "context_problems": (context_problems, CONTEXT_PROBLEMS),
    "line_number": (line_number, LINE_NUMBER),
    "strip_comments": (strip_comments, STRIP_COMMENTS),
    "token_budget": (token_budget, TOKEN_BUDGET),
    "token_admission": (token_admission, TOKEN_ADMISSION),
    "max_level": (max_level, MAX_LEVEL),
    "resume_pending": (resume_pending, RESUME_PENDING),
    "prompt_sections": (prompt_sections, PROMPT_SECTIONS),
    "dry_counts": (dry_counts, DRY_COUNTS),
}


def queries() -> dict:
    return {name: run for name, (run, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
