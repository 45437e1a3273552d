"""Frames, matching, and the client end to end."""

import json

import pytest
from pyspark.sql import functions as F

from stratagraph.client import Client
from stratagraph.functions.frames import FrameNormaliser, FrameParser, normalise
from stratagraph.operators.correlate import match_frames
from stratagraph.sources import server
from stratagraph.sources.repo import DEFAULT_EXCLUDES, discover, exclude_rules
from stratagraph.store import ConcurrentChange, Store

from .test_graph import node


def frame(spark, name, **given):
    cols = {"name": name} | given
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'int' if k == 'line' else 'string'}" for k in cols))
    return normalise(df).first()


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("MyApp.Services.UserService.GetUser", ("dotnet", "GetUser", "UserService", "MyApp.Services")),
        ("MyModule!MyApp.Services.UserService.GetUser", ("dotnet", "GetUser", "UserService", "MyApp.Services")),
        ("System.Collections.Generic.List`1.Add", ("dotnet", "Add", "List", "System.Collections.Generic")),
        ("MyApp.OuterClass+InnerClass.Method", ("dotnet", "Method", "InnerClass", "MyApp")),
        ("<module>:45(process_data)", ("python", "process_data", None, None)),
        ("handleRequest (src/handler.js:10:5)", ("javascript", "handleRequest", None, None)),
        ("Foo.prototype.bar", ("javascript", "bar", "Foo", None)),
        ("SomeRandomFormat123", ("unknown", "SomeRandomFormat123", None, None)),
    ],
)
def test_frame_names(spark, name, want):
    r = frame(spark, name)
    assert (r["language"], r["function_name"], r["class_name"], r["namespace"]) == want


def test_frame_details(spark):
    assert json.loads(frame(spark, "MyModule!A.B.C")["metadata"])["module"] == "MyModule"
    assert json.loads(frame(spark, "A.List`1.Add")["metadata"])["is_generic"]
    js = frame(spark, "handleRequest (src/handler.js:10:5)")
    assert (js["file_path"], js["line_number"], js["column"]) == ("src/handler.js", 10, 5)
    assert frame(spark, "pkg/x.py:7(run_it)")["file_path"] == "pkg/x.py"

    class Own(FrameParser):
        language = "own"

        def can_parse(self, name):
            return name.startswith("@")

        def parse(self, name):
            return {"function_name": name[1:], "line_number": 3}

    n = FrameNormaliser()
    n.register_parser(Own())
    rows = {r["name"]: r for r in n(spark.createDataFrame([("@f",), ("x_y",)], "name string")).collect()}
    assert (rows["@f"]["language"], rows["@f"]["function_name"], rows["@f"]["line_number"]) == ("own", "f", 3) and rows["x_y"]["language"] == "python"


@pytest.fixture()
def store(spark):
    s = Store(spark)
    s.put_nodes([
        node("n1", "process_data", "a.py", line=10, end=20, q="a.process_data"), node("n2", "process_data", "b.py", line=5, end=9, q="b.process_data"),
        node("n3", "GetUser", "U.cs", line=3, end=8, kind="method", q="MyApp.UserService.GetUser"), node("n4", "unique_fn", "c.py", line=1, q="c.unique_fn"),
    ])
    return s


def test_matching(spark, store):
    frames = [("process_data", "b.py", 7), ("MyApp.UserService.GetUser", None, None), ("X.UserService.GetUser", None, None), ("unique_fn", None, None), ("a_b:1(process_data)", None, None), ("nobody_here", None, None)]
    df = normalise(spark.createDataFrame(frames, "name string, file string, line int"))
    got = {r["name"]: (r["symbol_id"], r["confidence"]) for r in match_frames(df, store.nodes, "/r").collect()}
    assert got["process_data"] == ("n2", 0.95) and got["MyApp.UserService.GetUser"] == ("n3", 0.9)
    assert got["X.UserService.GetUser"] == ("n3", 0.8) and got["unique_fn"] == ("n4", 0.85)
    assert got["a_b:1(process_data)"] == ("n1", 0.85) and "nobody_here" not in got


SPEED = {"shared": {"frames": [{"name": "main"}, {"name": "helper"}, {"name": "zzz"}]}, "profiles": [{"type": "sampled", "name": "p", "startValue": 0, "endValue": 3, "samples": [[0, 1], [0], [0, 2]], "weights": [1, 1, 1]}]}


def test_client(spark, tmp_path):
    repo = tmp_path / "proj"
    (repo / "pkg").mkdir(parents=True)
    (repo / "node_modules").mkdir()
    (repo / "main.py").write_text("from utils import helper\nimport pkg.deep\n\ndef main():\n    helper()\n    pkg.deep.dig()\n")
    (repo / "utils.py").write_text("def helper():\n    return 1\n")
    (repo / "pkg" / "__init__.py").write_text("")
    (repo / "pkg" / "deep.py").write_text("from utils import helper\n\nclass Digger:\n    def run(self):\n        self.step()\n        helper()\n    def step(self): pass\n\ndef dig(): pass\n")
    (repo / "bad.py").write_bytes(b"\xff\xfe\x00")
    (repo / "node_modules" / "x.py").write_text("def hidden(): pass\n")
    c = Client(spark)
    seen = []
    r = c.index_repo(str(repo), progress_callback=lambda *x: seen.append(x))
    assert (r.files_indexed, r.files_failed) == (4, 1) and r.nodes_created > 8 and "bad.py" in r.errors[0] and seen[-1] == (5, 5, f"{repo}/utils.py")
    names = lambda df: sorted(x["name"] for x in df.collect())
    assert names(c.find_callers("helper", str(repo))) == ["main", "run"]
    assert names(c.find_callees("main", str(repo))) == ["dig", "helper"]
    assert names(c.find_callers("step", str(repo))) == ["run"] and names(c.find_callers("helper")) == []
    assert {x["location_file"] for x in c.get_import_graph("main.py", str(repo)).collect()} == {"main.py"}
    assert {x["name"] for x in c.impact_analysis("dig", str(repo)).collect()} >= {"main"}
    nodes, edges = c.get_stats(str(repo))
    assert {x["node_type"] for x in nodes.collect()} >= {"function", "class", "import", None} and edges.count() > 1
    assert names(c.get_symbol_info("Digger", str(repo))) == ["Digger"]

    (repo / "utils.py").write_text("def helper():\n    return 1\n\ndef more():\n    helper()\n")
    r = c.index_file(str(repo / "utils.py"), str(repo))
    assert r.files_indexed == 1 and names(c.find_callers("helper", str(repo))) == ["more"]
    with pytest.raises(FileNotFoundError):
        c.index_file(str(repo / "none.py"), str(repo))
    with pytest.raises(ValueError):
        c.index_file(str(tmp_path), str(repo))

    r = c.index_repo(str(repo))
    (tmp_path / "p.json").write_text(json.dumps(SPEED))
    got = c.ingest_profile(str(tmp_path / "p.json"), str(repo))
    assert got.profiles_ingested == 1 and got.frames_ingested == 3 and got.frames_correlated == 2 and not got.errors
    p = got.profile_ids[0]
    assert names(c.top_functions(p, limit=1, by="total")) == ["main"]
    assert names(c.get_unmapped_frames()) == [] and c.clear_correlation_cache() == 3 and names(c.get_unmapped_frames(p)) == ["helper", "main", "zzz"]
    hot = [(x["name"], x["self_weight"]) for x in c.hot_callers("helper", str(repo), profile_id=p).collect()]
    assert hot[0] == ("main", 1.0) and hot[1][1] is None
    assert c.correlate_frame("helper", str(repo))["confidence"] > 0.5 and c.correlate_frame("zzz", str(repo)) is None
    assert c.compare_profiles(p, "x") is None and c.ingest_profile(str(tmp_path / "none.json")).errors
    (tmp_path / "q.json").write_text("{}")
    assert c.ingest_profile(str(tmp_path / "q.json")).errors
    assert c.delete_profile(p) and c.list_profiles().count() == 0


def test_sequential_visibility(spark, tmp_path):
    (tmp_path / "a.py").write_text("from z import late\n\ndef first():\n    late()\n")
    (tmp_path / "z.py").write_text("def late(): pass\n")
    c = Client(spark)
    c.index_repo(str(tmp_path), visibility="sequential")
    targets = {x["target_id"] for x in c.store.edges.where("edge_type = 'calls'").collect()}
    assert targets == {f"{tmp_path}/a.py:late:1"}  # the import stands for it
    c.index_repo(str(tmp_path), force=True)
    assert {x["target_id"] for x in c.store.edges.where("edge_type = 'calls'").collect()} == {f"{tmp_path}/z.py:late:1"}


def test_excludes(tmp_path):
    out = exclude_rules(["**/d/**", "**/x.py", "p/**", "a/*/*.py"])
    assert [out("/r", p) for p in ("a/d/b.py", "a/dd/b", "q/x.py", "pfoo/y", "a/b/c.py", "b/c.py")] == [True, False, True, True, True, False]
    for p in ("build/a.py", "x/__init__.py", "y.egg-info/z.py"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("")
    assert discover(str(tmp_path), [".py"], DEFAULT_EXCLUDES) == ["x/__init__.py", "y.egg-info/z.py"]


def test_server_dump(spark, tmp_path):
    at = lambda a, b: {"Start": {"Line": a, "Column": 0}, "End": {"Line": b, "Column": 9}}
    tree = {"FileName": "S.cs", "Elements": [{"Kind": "namespace", "Name": "N", "Ranges": {"name": at(0, 0), "full": at(0, 30)}, "Children": [{"Kind": "class", "Name": "C", "Ranges": {"name": at(1, 1), "full": at(1, 29)}, "Children": [{"Kind": "method", "Name": "A", "Ranges": {"full": at(2, 9)}}, {"Kind": "method", "Name": "B", "Ranges": {"full": at(10, 20)}}]}]}]}
    (tmp_path / "symbols.jsonl").write_text(json.dumps(tree) + "\n")
    (tmp_path / "usages.jsonl").write_text(json.dumps({"SymbolId": "S.cs:A:3", "QuickFixes": [{"FileName": "S.cs", "Line": 12, "Column": 4, "EndLine": 12, "EndColumn": 6}, {"FileName": "S.cs", "Line": 3}]}) + "\n")
    c = Client(spark)
    r = c.index_server_dump(str(tmp_path / "symbols.jsonl"), str(tmp_path / "usages.jsonl"), "/r", wanted="full")
    assert r.nodes_created == 4
    assert {x["id"]: x["node_type"] for x in c.store.nodes.collect()} == {"/r/S.cs:N:1": "module", "/r/S.cs:C:2": "class", "/r/S.cs:A:3": "method", "/r/S.cs:B:11": "method"}
    assert {(x["source_id"], x["target_id"], x["edge_type"]) for x in c.store.edges.collect()} == {("/r/S.cs:N:1", "/r/S.cs:C:2", "contains"), ("/r/S.cs:C:2", "/r/S.cs:A:3", "contains"), ("/r/S.cs:C:2", "/r/S.cs:B:11", "contains"), ("/r/S.cs:B:11", "/r/S.cs:A:3", "calls")}
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.sln").write_text('Project("{A}") = "P", "P.csproj", "{B}"\nEndProject\n')
    assert server.discover_solution(str(tmp_path)).endswith("x.sln") and server.count_projects(str(tmp_path / "sub" / "x.sln")) == 1


def test_server_answers(spark, tmp_path):
    (tmp_path / "projects.jsonl").write_text(json.dumps({"MsBuild": {"Projects": [{"Path": "P.csproj", "SourceFiles": ["A.cs", "B.cs", "A.cs"]}, {"Path": "Q.csproj", "SourceFiles": []}]}}) + "\n")
    assert sorted(map(tuple, server.project_files(spark, str(tmp_path / "projects.jsonl")).collect())) == [("P.csproj", "A.cs"), ("P.csproj", "B.cs")]
    ask = {"FileName": "A.cs", "Line": 4, "Column": 2, "Definition": {"FileName": "B.cs", "Range": {"Start": {"Line": 0, "Column": 1}, "End": {"Line": 0, "Column": 5}}}}
    (tmp_path / "defs.jsonl").write_text(json.dumps(ask) + "\n" + json.dumps(ask | {"Definition": None}) + "\n")
    assert [tuple(r) for r in server.definitions(spark, str(tmp_path / "defs.jsonl")).collect()] == [("A.cs", 5, 2, "B.cs", 1, 1, 1, 5)]


def test_two_repositories(spark, tmp_path):
    for repo, callee in (("one", "helper"), ("two", "other")):
        (tmp_path / repo).mkdir()
        (tmp_path / repo / "m.py").write_text(f"def helper(): pass\n\ndef other(): pass\n\ndef main():\n    {callee}()\n")
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    c = Client(spark)
    c.index_repo(one)
    c.index_repo(two)
    names = lambda df: sorted(x["name"] for x in df.collect())
    assert names(c.find_callers("helper", one)) == ["main"] and names(c.find_callers("other", one)) == []
    assert names(c.find_callers("other", two)) == ["main"] and c.store.nodes.groupBy("repo_path").count().count() == 2
    assert c.store.clear_repo(one) == 4 and names(c.find_callers("other", two)) == ["main"] and c.store.edges.count() == 1


def test_index_file_order_and_language(spark, tmp_path):
    (tmp_path / "a.py").write_text("def same(): pass\n")
    (tmp_path / "z.py").write_text("def same(): pass\n")
    (tmp_path / "x.txt").write_text("def texted(): pass\n")
    c, repo = Client(spark), str(tmp_path)
    c.index_repo(repo)
    c.index_file(str(tmp_path / "a.py"), repo)
    seqs = [r["seq"] for r in c.store.nodes.collect()]
    assert len(set(seqs)) == len(seqs) and c.get_symbol_info("same", repo).first()["file_path"] == "z.py"
    with pytest.raises(ValueError):
        c.index_file(str(tmp_path / "x.txt"), repo)
    r = c.index_file(str(tmp_path / "x.txt"), repo, language="python")
    assert (r.files_indexed, r.errors) == (1, []) and c.get_symbol_info("texted", repo).first()["file_path"] == "x.txt"
    before = c.store.nodes.count()
    c.index_repo(repo)  # x.txt is not of the tree's extensions, and stays unless the index is forced
    assert c.store.nodes.count() == before
    c.index_repo(repo, force=True)
    assert c.get_symbol_info("texted", repo).count() == 0 and c.get_symbol_info("same", repo).first()["file_path"] == "a.py"


def test_many_profiles_in_one_file(spark, tmp_path):
    one = {"type": "sampled", "name": "p", "startValue": 0, "endValue": 1, "samples": [[0]], "weights": [1]}
    (tmp_path / "many.json").write_text(json.dumps({"shared": {"frames": [{"name": "work"}]}, "profiles": [one] * 1001}))
    (tmp_path / "m.py").write_text("def work(): pass\n")
    c = Client(spark)
    c.index_repo(str(tmp_path))
    got = c.ingest_profile(str(tmp_path / "many.json"), str(tmp_path))
    assert (got.profiles_ingested, got.frames_ingested, got.frames_correlated, len(set(got.profile_ids))) == (1001, 1001, 1001, 1001)
    assert c.store.function_stats.where("symbol_id is null").count() == 0


def test_changes_are_whole(spark, monkeypatch):
    from stratagraph import store as store_module

    monkeypatch.setattr(store_module, "SEGMENTS", 3)
    store = Store(spark)
    store.put_nodes([node("a", "f", "a.py"), node("b", "g", "b.py")])
    with pytest.raises(RuntimeError, match="midway"), store.change():
        store.clear_repo("/r")
        assert store.nodes.count() == 0
        raise RuntimeError("midway")
    assert store.nodes.count() == 2
    other = Store(spark, store.path)
    with pytest.raises(ConcurrentChange), store.change():
        other.put_nodes([node("c", "h", "c.py")])
        store.put_nodes([node("d", "h", "d.py")])
    assert {r["id"] for r in store.nodes.collect()} == {"a", "b", "c"}
    for k in range(6):
        store.put_mappings([{"frame_name": f"n{k}", "symbol_id": "s"}])
    assert store.mappings.count() == 6 and len(store._segments("frame_symbol_mappings")) <= 4
    assert store.vacuum(0.0) > 0 and store.mappings.count() == 6 and store.nodes.count() == 3


def test_scope_deletes_what_it_made(spark, tmp_path):
    import os

    from stratagraph.scratch import materialise, scope

    at = lambda df: os.path.isdir(df._scratch_path.removeprefix("file://"))
    with scope() as outer:
        with scope() as inner:
            a, b = materialise(spark.range(3), "a"), materialise(spark.range(4), "b")
            inner.append(a)
        assert at(a) and not at(b)
        outer.append(materialise(spark.range(5), "c"))
    assert not at(a) and outer[0].count() == 5


def test_all_ways_to_match(spark):
    s = Store(spark)
    s.put_nodes([
        node("u1", "get", "u.py", line=3, end=9, q="app.UserStore.get"), node("u2", "get", "u.py", line=20, end=29, q="app.Outer.Cache.get"), node("v1", "get", "v.py", line=1, end=2, q="lib.get"),
        node("w1", "solo", "w.py", line=1, end=5, q="w.solo"), node("x1", "twice", "x.py", line=1, q="x.twice"), node("y1", "twice", "y.py", line=1, q="y.twice"),
    ])
    schema = "name string, file string, line int, function_name string, class_name string, namespace string, qualified_name string, file_path string, line_number int, `column` int, language string, metadata string"
    row = lambda name, fn, cls=None, q=None, file=None, line=None: (name, file, line, fn, cls, None, q, file, line, None, "python", None)
    frames = spark.createDataFrame([
        row("at line", "other", file="u.py", line=20), row("inside", "get", file="u.py", line=25), row("whole", "get", q="lib.get"), row("tail", "get", q="UserStore.get"), row("class in file", "get", "Outer", file="u.py"), row("file", "get", file="v.py"),
        row("class", "get", "Cache"), row("class end", "get", "Store"), row("run", "get", "Outer.Cache"), row("alone", "solo"), row("guess", "twice"), row("none", "nothing"), row("inner", "get", "Outer"),
    ], schema)
    got = {r["name"]: (r["symbol_id"], r["confidence"], r["match_reason"]) for r in match_frames(frames, s.nodes, "/r").collect()}
    assert got == {
        "at line": ("u2", 0.95, "Location match"), "inside": ("u2", 0.95, "Location match"), "whole": ("v1", 0.9, "Qualified name match"), "tail": ("u1", 0.85, "Qualified name suffix match"),
        "class in file": ("u2", 0.85, "Name and file match"), "file": ("v1", 0.85, "Name and file match"), "class": ("u2", 0.8, "Name and class match"), "class end": ("u1", 0.8, "Name and class match"),
        "run": ("u2", 0.8, "Name and class match"), "alone": ("w1", 0.7, "Unique name match"), "guess": ("x1", 0.6, "Best guess from 2 matches"), "inner": ("u2", 0.8, "Name and class match"),
    }


def test_tables_of_matches_are_small_and_not_broadcast(spark):
    """Only endings of a length that is asked for are made, and of tables with a row for each node none is held by each task."""
    nodes = spark.createDataFrame([(f"n{k}", "/r", "m", "f", f"app.Class{k}.f", 1, 2, k) for k in range(50)], "id string, repo_path string, file_path string, name string, qualified_name string, start_line int, end_line int, seq long")
    given = {"name": "k", "function_name": "f", "class_name": "ss7", "qualified_name": "Class9.f", "language": "unknown"}
    empty = {"namespace": "string", "file_path": "string", "line_number": "int", "column": "int", "metadata": "string"}
    frames = spark.createDataFrame([given]).select("*", *[F.lit(None).cast(t).alias(c) for c, t in empty.items()])
    found = match_frames(frames.withColumn("qualified_name", F.lit(None).cast("string")).union(frames.withColumn("name", F.lit("q"))), nodes, "/r")
    assert sorted((r["name"], r["symbol_id"]) for r in found.collect()) == [("k", "n7"), ("q", "n9")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "LeftSemi" not in x]
    assert not [x for x in plan.splitlines() if "Generate explode" in x and "sizes" not in x]
