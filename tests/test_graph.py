"""Graph store and queries on hand-built graphs."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from stratagraph import store as stores
from stratagraph.operators import graph, resolve
from stratagraph.store import Store, latest, without_dangling


def node(i, name=None, file="a.py", repo="/r", kind="function", line=1, end=None, q=None):
    return {"id": i, "name": name or i, "file_path": file, "repo_path": repo, "node_type": kind, "start_line": line, "start_column": 0, "end_line": end or line, "end_column": 0, "qualified_name": q}


def edge(a, b, kind="calls"):
    return {"source_id": a, "target_id": b, "edge_type": kind}


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.fixture()
def store(spark):
    s = Store(spark)
    s.put_nodes([node("process_data", line=1), node("helper", line=20), node("transform", line=30), node("validate", line=40), node("DataProcessor", kind="class", line=50), node("other", repo="/other")])
    s.put_edges([edge("process_data", "validate"), edge("process_data", "helper"), edge("process_data", "transform"), edge("validate", "helper"), edge("process_data", "DataProcessor", "instantiates"), edge("validate", "DataProcessor", "references"), edge("process_data", "helper")])
    return s


def test_callers_callees_references(store):
    n, e = store.nodes, store.edges
    assert ids(graph.find_callers(n, e, "helper", "/r")) == ["process_data", "validate"]
    assert [r["id"] for r in graph.find_callers(n, e, "helper", "/r", 1, 1).collect()] == ["validate"]
    assert [r["id"] for r in graph.find_callers(n, e, "helper", "/r", None, 1).collect()] == ["validate"]
    assert ids(graph.find_callees(n, e, "process_data", "/r")) == ["helper", "transform", "validate"]
    assert ids(graph.find_references(n, e, "DataProcessor", "/r")) == ["process_data", "validate"]
    assert ids(graph.find_callers(n, e, "helper", "/other")) == [] == ids(graph.find_callers(n, e, "", ""))


def test_lookups_and_stats(store):
    n, e = store.nodes, store.edges
    assert ids(graph.nodes_by_name(n, "helper", None, "function")) == ["helper"] and ids(graph.nodes_by_name(n, "Helper")) == []
    assert len(ids(graph.all_nodes(n))) == 6 and ids(graph.all_nodes(n, "/other")) == ["other"]
    assert graph.edges_from(e, "process_data", "calls").count() == 4 and graph.edges_to(e, "DataProcessor").count() == 2
    assert graph.symbol_info(n, "helper", "/r").first()["start_line"] == 20
    stats = {r["node_type"]: r["n_nodes"] for r in graph.node_stats(n, "/r").collect()}
    assert stats == {None: 5, "function": 4, "class": 1}
    assert {r["edge_type"]: r["n_edges"] for r in graph.edge_stats(n, e, "/r").collect()} == {None: 7, "calls": 5, "references": 1, "instantiates": 1}


def test_upsert_takes_edges_away_and_clear_cascades(store):
    assert [r["id"] for r in store.edges.orderBy("id").collect()] == list(range(1, 8))
    store.put_nodes([node("validate", line=41)])
    assert graph.get_node(store.nodes, "validate").first()["start_line"] == 41 and store.edges.count() == 4
    with pytest.raises(ValueError):
        store.put_edges([edge("validate", "nobody")])
    assert store.clear_file("a.py", "/r") == 5 and store.edges.count() == 0 and ids(store.nodes) == ["other"]
    assert store.clear_repo("/r") == 0 and store.clear_repo("/other") == 1 and store.nodes.count() == 0


def test_reopened_store_keeps_its_tables(store, spark):
    again = Store(spark, store.path)
    assert again.nodes.count() == 6 and again.edges.count() == 7


def test_import_graph_with_cycle(spark):
    s = Store(spark)
    s.put_nodes([node(m, file=f"{m}.py", kind="module") for m in ("main", "utils", "helpers", "unrelated")])
    s.put_edges([edge("main", "utils", "imports"), edge("utils", "helpers", "imports"), edge("helpers", "main", "imports")])
    count = lambda d: graph.import_graph(s.nodes, s.edges, "main.py", "/r", d).count()
    assert [count(d) for d in (0, 1, 2, 3, 10)] == [0, 1, 2, 3, 3]


def test_impact_and_self_edge(spark):
    s = Store(spark)
    s.put_nodes([node(x) for x in "abcd"])
    s.put_edges([edge("a", "b"), edge("b", "c"), edge("c", "a"), edge("d", "d")])
    assert {r["id"]: r["level"] for r in graph.impact(s.nodes, s.edges, "c", "/r").collect()} == {"b": 1, "a": 2}
    assert ids(graph.find_callers(s.nodes, s.edges, "d", "/r")) == ["d"] == ids(graph.find_callees(s.nodes, s.edges, "d", "/r"))


def test_containing_node(spark):
    s = Store(spark)
    s.put_nodes([node("C", kind="class", line=1, end=50), node("m", kind="method", line=10, end=20), node("f", line=10, end=20)])
    places = spark.createDataFrame([("/r", "a.py", 12), ("/r", "a.py", 30), ("/r", "a.py", 99)], "repo_path string, file_path string, line int")
    assert {r["line"]: r["node_id"] for r in graph.containing_nodes(s.nodes, places).collect()} == {12: "m", 30: "C"}


def test_latest(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "k string, v int")
    assert sorted(map(tuple, latest(df, ["k"], F.col("v")).collect())) == [("a", 3), ("b", 2)]


def test_nodes_are_not_broadcast_for_their_numbers(spark):
    """A table of few bytes can hold any number of nodes once it is made files."""
    rows = __spark_entry__.rules._two_files(__spark_entry__.catalogue.Tables(spark, __spark_entry__.FLAGSHIP_DIR))
    plan = resolve.nodes_of(rows, "r")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [file_path" in plan and "BroadcastHashJoin [file_path" not in plan


def test_node_ids_are_not_broadcast(store):
    """However small the ids are estimated to be: a broadcast of them is held by each task."""
    for df in (without_dangling(store.edges, store.nodes), graph.all_edges(store.nodes, store.edges, "/r")):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString() and df.count() == 7


@pytest.mark.parametrize("few", [0, 200_000])
def test_edges_are_joined_for_the_ends_that_were_removed(spark, monkeypatch, few):
    monkeypatch.setattr(stores, "BROADCAST_IDS", few, raising=False)
    plans, replace = [], Store._replace

    def noted(self, table, segments, rows, tag):
        if table == "edges" and rows is not None:
            plans.append((len(segments), rows._jdf.queryExecution().optimizedPlan().toString().count("LeftAnti")))
        replace(self, table, segments, rows, tag)

    monkeypatch.setattr(Store, "_replace", noted)
    s = Store(spark)
    s.put_nodes([node("a", repo="/x"), node("b", repo="/x"), node("c"), node("d")])
    s.put_edges([edge("a", "c"), edge("c", "d"), edge("b", "d")])
    s.put_edges([edge("c", "d"), edge("d", "c"), edge("d", "d")])
    left = lambda: sorted((r["source_id"], r["target_id"]) for r in s.edges.collect())
    s.clear_repo("/x")  # sources of the first segment only
    assert plans == [(1, 1)] and left() == [("c", "d"), ("c", "d"), ("d", "c"), ("d", "d")]
    s.put_nodes([node("c", line=9), node("e")])  # c is a source and a target
    assert plans[1:] == [(2, 2)] and left() == [("d", "d")] and ids(s.nodes) == ["c", "d", "e"]
