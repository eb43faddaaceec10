import itertools

from pyspark.sql import functions as F

from verdigraph.operators import ladder as L
from verdigraph.plans import evaluate as E


def model(labels):
    """Straight-line walk over labels of levels 1, 2, ..."""
    base = at = None
    streak, seen = 0, []
    for level, label in enumerate(labels, 1):
        seen.append(label)
        if label not in ("TP", "FP"):
            base, at, streak = None, None, 0
            continue
        if label == base:
            streak += 1
        else:
            base, at, streak = label, level, 1
        if streak == 3:
            break
    tp, fp = seen.count("TP"), seen.count("FP")
    most = "TP" if tp > fp else "FP" if fp > tp else "UNKNOWN"
    first = seen.index("FP") + 1 if "FP" in seen else None
    reason = "confirmed_two_levels_above" if streak == 3 else "exhausted_pending_verdict" if base else "exhausted_no_verdict"
    return (base is not None, base or most, first, reason, at, len(seen) if streak == 3 else None, len(seen) < len(labels), seen)


def levels(spark, walks):
    rows = [(w, k, i, label) for (w, k), labels in walks.items() for i, label in enumerate(labels, 1)]
    return spark.createDataFrame(rows, "warning_id string, walk int, level int, label string")


def test_every_label_sequence(spark):
    all_ = [s for n in range(1, 6) for s in itertools.product(("TP", "FP", "UNKNOWN", None), repeat=n)]
    walks = {(str(i), 0): s for i, s in enumerate(all_)}
    got = {int(r["warning_id"]): r for r in L.walks(levels(spark, walks)).collect()}
    for i, s in enumerate(all_):
        r = got[i]
        told = (r["stable"], r["walk_label"], r["first_fp_level"], r["stop_reason"], r["base_level"], r["confirmed_at_level"], r["stopped_early"], list(r["level_labels"]))
        assert told == model(s), s


def strict(votes, slots):
    return next((x for x in ("TP", "FP", "UNKNOWN") if votes.count(x) >= slots // 2 + 1), "UNKNOWN")


def test_votes_and_representative(spark):
    kinds = [("TP",), ("FP",), ("UNKNOWN",), ("UNKNOWN", "FP"), ("FP", "UNKNOWN"), ("TP", "FP"), (None,)]
    groups = [g for n in (1, 2, 3) for g in itertools.product(kinds, repeat=n)]
    for n in (1, 2, 3):
        some = {str(i): g for i, g in enumerate(groups) if len(g) == n}
        walks = L.walks(levels(spark, {(w, k): s for w, g in some.items() for k, s in enumerate(g)}))
        judged = L.verdicts(walks, n)
        best = {r["warning_id"]: r["walk"] for r in L.representative(walks, judged).collect()}
        for r in judged.collect():
            told = [model(s) for s in some[r["warning_id"]]]
            final = strict([t[1] for t in told], n)
            stable = final in ("TP", "FP") and sum(t[0] and t[1] == final for t in told) >= n // 2 + 1
            every = [x for t in told for x in t[7]]
            tp, fp = every.count("TP"), every.count("FP")
            assert (r["label"], r["is_stable"], list(r["walk_labels"]), r["n_stable_walks"]) == (final, stable, [t[1] for t in told], sum(t[0] for t in told))
            assert r["majority_label"] == ("TP" if tp > fp else "FP" if fp > tp else "UNKNOWN")
            those = [k for k, t in enumerate(told) if t[1] == final] or list(range(n))
            assert best[r["warning_id"]] == max(those, key=lambda k: (told[k][2] or -1, -k))


def test_slots_may_exceed_votes(spark):
    walks = L.walks(levels(spark, {("a", 0): ("TP",)}))
    assert L.verdicts(walks, 3).first()["label"] == "UNKNOWN"


def test_max_level(spark):
    callers = spark.createDataFrame([("gap", 1), ("gap", 3), ("two", 1), ("two", 2), ("two", 2), ("late", 2)], "warning_id string, level int")
    records = spark.createDataFrame([("gap",), ("two",), ("late",), ("none",)], "warning_id string")
    assert {r[0]: r[1] for r in L.max_level(callers, records).collect()} == {"gap": 2, "two": 3, "late": 1, "none": 1}
    assert {r[0]: r[1] for r in L.max_level(callers, records, 2).collect()} == {"gap": 2, "two": 2, "late": 1, "none": 1}
    assert {r[1] for r in L.max_level(callers, records, 0).collect()} == {1}


def test_climb_asks_no_more_than_needed(spark):
    plan = L.planned(spark.createDataFrame([("a", 5), ("b", 5)], "warning_id string, max_level int"), votes=1)
    labels = {("a", 0, i): "TP" for i in range(1, 6)} | {("b", 0, i): x for i, x in enumerate(("TP", "FP", "FP", "FP", "TP"), 1)}
    build = lambda now: now.withColumns({"context": F.lit("c"), "input": F.lit("i"), "prompt_error": F.lit(None).cast("string"), "estimated_input_tokens": F.lit(1)})
    records = E.climb(plan, build, lambda: E.Scripted(labels))
    assert sorted((r["warning_id"], r["level"], r["label"]) for r in records.collect()) == [("a", 1, "TP"), ("a", 2, "TP"), ("a", 3, "TP"), ("b", 1, "TP"), ("b", 2, "FP"), ("b", 3, "FP"), ("b", 4, "FP")]
    walked = {r["warning_id"]: r for r in L.walks(E.with_plan(records, plan)).collect()}
    assert walked["a"]["stopped_early"] and walked["b"]["stopped_early"] and walked["b"]["confirmed_at_level"] == 4


def test_errors_have_no_label(spark):
    class Fails:
        def __call__(self, context, prompt, *where):
            raise ValueError("no")

    rows = spark.createDataFrame([("a", 0, 1, "c", "i", None, 1), ("a", 0, 2, "c", None, "bad", 1)], "warning_id string, walk int, level int, context string, input string, prompt_error string, estimated_input_tokens int")
    got = {r["level"]: r for r in E.evaluated(rows, Fails).collect()}
    assert got[1]["error"] == "ValueError: no" and got[2]["error"] == "prompt_build_error: bad" and got[1]["label"] is got[2]["label"] is None


def test_retries_and_budget():
    calls, waits = [], []

    def answer(*prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise RuntimeError("status 429")
        return "x"

    assert E.asked(answer, 5, 2.0, waits.append, "p") == "x" and 2 <= waits[0] < 3 and 4 <= waits[1] < 5
    clock = [0.0]
    budget = E.Budget(100, lambda: clock[0], lambda s: clock.__setitem__(0, clock[0] + s))
    for n in (60, 40, 500, 10):
        budget(n)
    assert clock[0] == 60.05
