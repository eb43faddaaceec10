import json
import subprocess
import tarfile

import pytest
from pyspark.sql import functions as F

from verdigraph.operators import callgraph as G
from verdigraph.plans import evaluate as E
from verdigraph.plans import jobs, providers
from verdigraph.sources import fetch
from verdigraph.sources import tables as S


def test_ids_by_place(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.jsonl").write_text("".join(json.dumps({"project": "p", "warning_id": "own" if (i, k) == (1, 0) else None}) + "\n" for k in range(2)))
    rows = S.read_jsonl(spark, str(tmp_path)).repartition(3, "warning_id")
    got = [r["warning_id"] for r in S.with_ids(rows).orderBy("ordinal").collect()]
    assert sorted(got) == sorted(["own", *(f"p__{i:04d}" for i in range(6) if got[i] != "own")]) and got.count("own") == 1


def test_used_types_with_limits(spark):
    use = "array<struct<name: string, row: int>>"
    sig = "struct<ftype: string, name: string, return_type: string, is_static: boolean, param_types: array<string>>"
    entry = lambda n, uses: ("u", "f", ("struct", n, "", False, []), [(x, r) for x, r in uses])
    decls = spark.createDataFrame([entry("a", [("b", 1), ("c", 9)]), entry("b", [("d", 2), ("a", 3)]), entry("c", []), entry("d", [])], f"unit string, file_key string, sig {sig}, types_used {use}")
    node = {r["n"]: r["x"] for r in decls.select(F.col("sig.name").alias("n"), G.node_id(F.col("unit"), F.col("file_key"), F.col("sig")).alias("x")).collect()}
    roots = spark.createDataFrame([(node["a"], None), (node["b"], 2)], "start string, lineno int")
    got = {(r["start"], r["node"]) for r in G.used_types(roots, decls).collect()}
    assert got == {(node["a"], node[x]) for x in "abcd"} | {(node["b"], node[x]) for x in "bd"}


def test_reports_as_files(spark, tmp_path):
    r = spark.createDataFrame([("a:1", "m/x", "TP", None)], "warning_id string, model string, final_label string, project string")
    assert [x[0] for x in S.export_reports(r, f"file://{tmp_path}").collect()] == ["m_x/a__1.json"]
    assert json.loads((tmp_path / "m_x" / "a__1.json").read_text()) == {"warning_id": "a:1", "model": "m/x", "final_label": "TP", "project": None}


def test_fetch(tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.c").write_text("int a;")
    run = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", "-C", str(src), *a], check=True, capture_output=True, text=True).stdout.strip()
    run("init", "-q")
    run("add", ".")
    run("commit", "-qm", "x")
    head = run("rev-parse", "HEAD")
    row = fetch.fetch("p q", str(src), head, tmp_path / "out")
    assert row["ok"] and row["checked_out_commit"] == head and (tmp_path / "out" / f"p_q__{head[:12]}" / "a.c").exists()
    assert fetch.fetch("p q", str(src), head, tmp_path / "out")["ok"] and not fetch.fetch("z", str(tmp_path / "none"), None, tmp_path / "out")["ok"]
    with tarfile.open(tmp_path / "t.tar.gz", "w:gz") as t:
        t.add(src / "a.c", "top/a.c")
    row = fetch.fetch("tar", f"file://{tmp_path}/t.tar.gz", None, tmp_path / "out")
    assert row["ok"] and row["type"] == "tarball" and (tmp_path / "out" / "tar" / "a.c").exists()


def test_fetch_and_build_jobs(spark, tmp_path):
    src = tmp_path / "src"
    (src / "lib").mkdir(parents=True)
    (src / "lib" / "a.c").write_text("int f(void) { return 1; }")
    run = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", "-C", str(src), *a], check=True, capture_output=True, text=True).stdout.strip()
    run("init", "-q")
    run("add", ".")
    run("commit", "-qm", "x")
    head = run("rev-parse", "HEAD")
    rows = [{"project": "p", "project_url": str(src), "commit_id": head, "file_path": "lib/a.c", "line_number": "1"}, {"project": "p", "project_url": str(src), "commit_id": head, "file_path": "no.c"}, {"project": "q", "project_url": str(tmp_path / "none"), "commit_id": "", "file_path": "a.c"}]
    (tmp_path / "w.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    house = ["--warehouse", str(tmp_path / "h")]
    assert jobs.main([*house, "fetch", str(tmp_path / "w.jsonl"), str(tmp_path / "out")], spark) == 1
    told = json.loads((tmp_path / "h" / "checkouts.json").read_text())
    assert [(c["project"], c["ok"]) for c in told["checkouts"]] == [("p", True), ("q", False)]
    assert told["summary"] == {"checkouts_total": 2, "checkouts_ok": 1, "checkouts_failed": 1, "warning_files_resolved": 1, "warning_files_missing": 2}
    assert jobs.main([*house, "build"], spark) == 0
    unit = S.read_units(spark, str(tmp_path / "h" / "units")).first()
    assert unit["key"] == f"p__{head[:12]}" and unit["n_functions"] == 1 and unit["repo_root"].endswith(unit["key"])
    assert jobs.main([*house, "extract", str(tmp_path / "w.jsonl")], spark) == 0
    assert spark.read.parquet(str(tmp_path / "h" / "context")).where("resolve_status = 'enclosing_line_match'").count() == 1


def test_requests_of_services(monkeypatch):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    seen, replies = [], [(429, {}), (200, {"choices": [{"message": {"content": '{"label": "TP"}', "reasoning_content": "r"}}], "usage": {"prompt_tokens": 1, "completion_tokens": 2, "total_tokens": 3}})]
    replies.append((200, {"content": [{"type": "thinking"}, {"type": "text", "text": "a"}, {"type": "text", "text": "b"}], "usage": {"input_tokens": 4, "output_tokens": 5}}))

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((json.loads(self.rfile.read(int(self.headers["Content-Length"]))), dict(self.headers)))
            status, body = replies.pop(0)
            self.send_response(status)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    address = f"http://127.0.0.1:{server.server_port}/"
    monkeypatch.setenv("K", "secret")
    waits = []
    chat = providers.Http(providers.Service("K", address), "some-llama")
    assert E.asked(chat, 2, 0.0, waits.append, "sys", "ask", "w", 0, 1) == ('{"label": "TP"}', "r", (1, 2, 3)) and len(waits) == 1
    assert seen[1][0] == {"model": "some-llama", "messages": [{"role": "system", "content": "sys"}, {"role": "user", "content": "ask"}], "temperature": 0.7, "response_format": {"type": "json_object"}}
    assert seen[1][1]["Authorization"] == "Bearer secret"
    other = providers.Http(providers.Service("K", address, "messages"), "claude-x")
    assert other("sys", "ask", "w", 0, 1) == ("ab", "", (4, 5, 9)) and seen[2][0]["system"] == "sys" and seen[2][0]["max_tokens"] == 64_000
    server.shutdown()
    assert "temperature" not in providers.body("chat", "gpt-5-x", "c", "p") and providers.body("chat", "other", "c", "p", True)["enable_thinking"]
    monkeypatch.delenv("K")
    for bad in (lambda: providers.maker("nobody", "m"), lambda: providers.maker("openai", "claude-x"), lambda: providers.Http(providers.Service("K", address), "m")):
        with pytest.raises(ValueError):
            bad()
    providers.register("mine", lambda model: E.Scripted({("w", 0, 1): model}))
    assert "TP" in providers.maker("mine", "TP")()("c", "p", "w", 0, 1)[0]


def test_messages_of_a_prompt(spark):
    from verdigraph.functions import text as X

    got = spark.createDataFrame([("s", "u")], "c string, p string").select(X.messages(F.col("c"), F.col("p")).alias("m")).first()["m"]
    assert [tuple(x) for x in got] == [("system", "s"), ("user", "u")]


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace as N

    from verdigraph import store

    nowhere = N(get=lambda *a: None)
    sc = N(master="spark://host:7077", getConf=lambda: nowhere, getCheckpointDir=lambda: None)
    with pytest.raises(ValueError):
        store.shared_dir(N(sparkContext=sc, conf=nowhere))
    path = store.scratch_path(spark, "x")
    assert path.startswith(store.shared_dir(spark)) and spark.sparkContext.applicationId in path
    small = store.spread(spark.range(5, numPartitions=1))
    assert small.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and small.count() == 5
    assert store.spread(spark.range(5, numPartitions=9)).rdd.getNumPartitions() == 9
