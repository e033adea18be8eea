import io
import json

from loomspark import cli
from loomspark.model import USAGE
from loomspark.operators import usage
from loomspark.sources import files, requests, usage_log
from loomspark.streaming import rpc, watch


def test_request_defaults_and_result(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"query": "q", "chunks": [{"id": "a", "content": "x"}, {"content": "y", "kind": "odd", "priority": 3}]}))
    c, q = requests.read_request(spark, str(tmp_path / "r.json"))
    rows = c.orderBy("pos").collect()
    assert q == "q" and (rows[0].language, rows[0].kind, rows[0].priority, rows[0].skeleton_hint) == ("unknown", "code", 0, False) and (rows[1].id, rows[1].kind, rows[1].priority) == ("", "code", 3)
    assert requests.bundle(c.where("pos = 0")).first()[0] == "// --- a ---\nx"


def test_scan_and_imports(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "a.ts").write_text("import { b } from './b';\nimport z from 'zlib';\n")
    (tmp_path / "src" / "b.tsx").write_bytes(b"export const b = '\xff';\n")
    (tmp_path / "node_modules" / "c.js").write_text("x")
    (tmp_path / "notes.md").write_text("# x")
    s = files.scan(spark, str(tmp_path), ["node_modules/", "*.log"])
    assert sorted(r.path for r in s.collect()) == ["src/a.ts", "src/b.tsx"]
    assert "�" in s.where("path = 'src/b.tsx'").first().content
    got = files.resolve_imports(files.imports_of(s), s).collect()
    assert [(r.path, r.spec, r.target) for r in got] == [("src/a.ts", "./b", "src/b.tsx")]


def test_editor_context(spark):
    f = lambda *rows: spark.createDataFrame(rows, "path string, content string")
    got = files.editor_context(f(("a.ts", "A")), f(("a.ts", "sel")), f(("b.ts", "B")), f(("a.ts", "A"), ("c.py", "C"))).orderBy("pos").collect()
    assert [(r.id, r.priority) for r in got] == [("selection:a.ts", 10), ("active:a.ts", 5), ("import:b.ts", 2), ("visible:c.py", 1)]


def test_usage_log(spark, tmp_path, monkeypatch):
    log = str(tmp_path / "log")
    row = (0, 100, 40, 60, 5.0, "é" * 150, 1, 1, "cli", "p")
    assert usage_log.append_usage(spark.createDataFrame([row], USAGE), log)
    (tmp_path / "log" / "more.json").write_text('\nnot json\n{"ts": 3, "in_tokens": 0, "saved_tokens": 0, "elapsed_ms": 1.0}\n')
    d = usage_log.read_usage(spark, log)
    rows = sorted(d.collect(), key=lambda r: r.ts)
    assert len(rows) == 2 and rows[1].query == "é" * 100 and rows[1].ts > 10**9
    assert usage_log.shortened("é" * 150) == "é" * 100
    assert usage.by_query(d).first().query == "é" * 100 and usage.totals(usage.of_project(d, "p")).first().runs == 1
    assert usage.totals(d.limit(0)).first().pct == 0.0 and usage_log.read_usage(spark, str(tmp_path / "none")).count() == 0
    monkeypatch.setenv(usage_log.DISABLED_BY, "1")
    assert not usage_log.append_usage(d, log)


def events(spark, rows):
    return spark.createDataFrame(rows, "ms long, path string").selectExpr("timestamp_millis(ms) as ts", "path", "'modify' as op")


def test_debounce(spark, tmp_path):
    rows = [(0, "a.py"), (199, "b.py"), (300, "a.py"), (501, "c.py"), (5000, ".git/x"), (9000, "d~")]
    got = watch.debounced(events(spark, rows)).orderBy("start").collect()
    assert [r.paths for r in got] == [["a.py", "b.py"], ["c.py"]]
    keeps_open = watch.debounced(events(spark, [(0, "a.py"), (150, "node_modules/x"), (300, "b.py")])).collect()
    assert [r.paths for r in keeps_open] == [["a.py", "b.py"]]
    events(spark, rows + [(60_000, "z.py")]).coalesce(1).write.json(str(tmp_path / "in"))
    q = watch.debounced(watch.read_events(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.paths for r in spark.table("bursts").orderBy("start").collect()] == [["a.py", "b.py"], ["c.py"]]


def test_server_and_command_line(spark, tmp_path):
    (tmp_path / "a.py").write_text("def f():\n    return g()\n\ndef g():\n    pass\n")
    s = rpc.Server(spark, str(tmp_path / ".loomspark"), str(tmp_path))
    call = lambda name, **a: s.handle(json.dumps({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": name, "arguments": a}}))
    assert s.handle("{")["error"]["code"] == -32700 and s.handle("{}")["error"]["code"] == -32600 and s.handle('{"jsonrpc":"2.0","method":"x"}')["error"]["code"] == -32601 and call("nope")["error"]["code"] == -32000
    assert len(s.handle('{"jsonrpc":"2.0","id":2,"method":"tools/list"}')["result"]["tools"]) == 6
    assert json.loads(call("build_graph")["result"]["content"][0]["text"])["reparsed"] == 1
    assert json.loads(call("graph_stats")["result"]["content"][0]["text"]) == {"nodes": 3, "edges": 3, "files": 1}
    assert call("skeleton", path="a.py")["result"]["content"][0]["text"] == "def f():;\ndef g():;\n"
    out = io.StringIO()
    assert cli.run(spark, ["--root", str(tmp_path), "impact", "a.py"], out=out) == 0 and json.loads(out.getvalue()) == {"path": "a.py"}
    out = io.StringIO()
    cli.run(spark, ["--root", str(tmp_path), "optimize", "--max-tokens", "100"], io.StringIO(json.dumps({"chunks": [{"id": "a", "content": "hello world"}], "query": "hello"})), out)
    assert json.loads(out.getvalue())["chunks"][0]["id"] == "a"


def test_many_folders_are_listed_by_a_few_tasks(spark, tmp_path):
    for i in range(60):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "a.py").write_text(f"x = {i}\n")
    sc = spark.sparkContext
    sc.setJobGroup("listing", "listing")
    try:
        tree = files.scan(spark, str(tmp_path))
        stages = [k for j in sc.statusTracker().getJobIdsForGroup("listing") for k in sc.statusTracker().getJobInfo(j).stageIds]
        tasks = [sc.statusTracker().getStageInfo(k).numTasks for k in stages]
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert max(tasks) <= files.LISTERS_A_CORE * sc.defaultParallelism
    assert tree.count() == 60


def test_bursts_are_merged_before_they_meet(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "e.json").write_text("".join(json.dumps({"ts": f"2024-01-01T00:00:{i:02d}Z", "path": f"p{i % 3}", "op": "modify"}) + "\n" for i in range(40)))
    run = watch.debounced(watch.read_events(spark, str(tmp_path / "in")), "10 seconds").writeStream.format("memory").queryName("bursts").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    plan = run._jsq.explainInternal(False)
    tail = plan[plan.rindex("hashpartitioning"):]  # what a task does before the last exchange by key
    assert "MergingSessions" in tail
