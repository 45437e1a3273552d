"""More queries of the catalogue: what a store holds after it was changed.

Each query makes a store of its own in the shared folder, puts the adapter's
rows into it by the functions that users call, and reads a table back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..codegraph import CodeGraph, decoded, from_code_graph, to_code_graph, with_location
from ..operators import correlate, profiles, resolve
from ..sources import server
from ..scratch import shared_dir
from ..store import Store
from .catalogue import _MAPPINGS, _NODES, _STATS, Tables, _query

_PLACES = {"start_column": 0, "end_column": 0}
_STAT_COLUMNS = ("profile_id", "frame_index", "name", "self_weight", "symbol_id")


def _graph(t: Tables) -> Store:
    """The adapter's nodes, and its edges whose line numbers are one."""
    store = Store(t.spark)
    store.put_nodes(t.nodes().withColumns({c: F.lit(v) for c, v in _PLACES.items()}))
    store.put_edges(t.edges(), check=False)
    return store


def _profiles(t: Tables) -> Store:
    """The days' statistics, a frame for each of their rows, and the profiles."""
    store = Store(t.spark)
    kind = {"profile_type": F.lit("sampled"), "unit": F.lit("none")}
    stats = t.stats()
    store.put_profiles(t.profiles().withColumns(kind), stats.select("profile_id", "frame_index", "name", "file", "line"), stats)
    return store


def _part_profiles(t: Tables) -> Store:
    store = Store(t.spark)
    stats = t.part_stats().withColumns({c: F.lit(0.0) for c in ("self_percentage", "total_percentage")})
    brands = stats.select(F.col("profile_id").alias("id")).distinct().select("id", F.col("id").alias("name"), F.lit("sampled").alias("profile_type"), F.lit("none").alias("unit"), F.lit(0.0).alias("start_value"), F.lit(1.0).alias("end_value"))
    store.put_profiles(brands, stats.select("profile_id", "frame_index", "name"), stats)
    return store


def _mappings(t: Tables) -> DataFrame:
    return t.mappings().withColumn("last_updated", F.timestamp_seconds("last_updated"))


@_query("""select r || '/' || f || ':' || p_name || ':' || p_size as id, r as repo_path, p_name as name from part, (select 'm' || k || '.py' as f, k from (select distinct p_partkey as k from part)) g, (values ('two')) v(r) where g.k = p_partkey""")
def nodes_two_repos(t: Tables) -> DataFrame:
    """Two repositories with files of the same relative paths; the first is cleared."""
    null = lambda kind="string": F.lit(None).cast(kind)
    rows = t.read("part").select(
        F.concat(F.lit("m"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("file_path"), F.lit("node").alias("record"), F.lit(0).alias("ordinal"), F.lit("function").alias("node_type"), F.col("p_name").alias("name"),
        *[null().alias(c) for c in ("qualified_name", "signature", "docstring", "metadata")], F.col("p_size").cast("int").alias("start_line"), F.lit(0).alias("start_column"), F.col("p_size").cast("int").alias("end_line"), F.lit(0).alias("end_column"),
    )
    store = Store(t.spark)
    for repo in ("one", "two"):
        store.put_nodes(resolve.nodes_of(rows, repo, modules=False, after=store.last_seq), repo_path=repo)
    store.clear_repo("one")
    return store.nodes.select("id", "repo_path", "name")


@_query(f"with {_NODES} select id, case when file_path = 'Brand#11' then 'new ' || name else name end as name from n")
def store_upsert_nodes(t: Tables) -> DataFrame:
    store = _graph(t)
    store.put_nodes(store.nodes.where("file_path = 'Brand#11'").withColumn("name", F.concat(F.lit("new "), "name")))
    return store.nodes.select("id", "name")


@_query(f"with {_NODES} select source_id, target_id, edge_type from e where target_id not in (select id from n where file_path = 'Brand#11')")
def store_upsert_edges(t: Tables) -> DataFrame:
    """A node that is replaced loses its edges."""
    store = _graph(t)
    store.put_nodes(store.nodes.where("file_path = 'Brand#11'"))
    return store.edges.select("source_id", "target_id", "edge_type")


@_query("select count(*)::bigint as n, count(*)::bigint as n_ids, min(1)::bigint as first, count(*)::bigint as last from (select 1 from lineitem union all select 1 from lineitem)")
def store_numbered_edges(t: Tables) -> DataFrame:
    """Edges are numbered from 1 without gaps, over appends."""
    store = _graph(t)
    store.put_edges(t.edges(), check=False)
    return store.edges.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_ids"), F.min("id").alias("first"), F.max("id").alias("last"))


@_query(f"with {_NODES} select source_id, target_id, edge_type from e where source_id not in (select id from n where repo_path = 'F')")
def store_clear_repo(t: Tables) -> DataFrame:
    store = _graph(t)
    store.clear_repo("F")
    return store.edges.select("source_id", "target_id", "edge_type")


@_query(f"with {_NODES} select id, repo_path from n where not (repo_path = 'lib' and file_path = 'Brand#11')")
def store_clear_file(t: Tables) -> DataFrame:
    store = _graph(t)
    store.clear_file("Brand#11", "lib")
    return store.nodes.select("id", "repo_path")


@_query(f"with {_NODES} select e.* from e where source_id in (select id from n where repo_path = 'P')")
def code_graph_round_trip(t: Tables) -> DataFrame:
    """Into a store and out of it, in two parts."""
    nodes, edges = t.nodes().withColumns({c: F.lit(v) for c, v in _PLACES.items()}).where("repo_path in ('P', 'lib')"), t.edges()
    edges = edges.join(nodes.where("repo_path = 'P'").select(F.col("id").alias("source_id")).hint("merge"), "source_id", "left_semi").select(*edges.columns)
    store = Store(t.spark)
    half = F.col("edge_type") == "calls"
    from_code_graph(store, CodeGraph(nodes.limit(0), edges.where(half).limit(0)).add_nodes(nodes).add_edges(edges.where(half)).add_edges(edges.where(~half)), "P")
    return to_code_graph(store, "P").edges.select("source_id", "target_id", "edge_type")


@_query("select 'p' || p_partkey as id, case when p_partkey % 2 = 0 then p_type end as kind, (p_partkey % 2 = 0)::int as n_keys, case when p_partkey % 3 = 0 then 'f' || p_partkey end as file_path from part")
def decoded_metadata(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    rows = t.read("part").select(F.concat(F.lit("p"), k).alias("id"), F.when(k % 2 == 0, F.to_json(F.struct(F.col("p_type").alias("kind")))).alias("metadata"), F.when(k % 3 == 0, F.concat(F.lit("f"), k)).alias("location_file"), *[F.lit(1).alias(f"location_{c}") for c in ("start_line", "start_column", "end_line", "end_column")])
    located = with_location(rows).select("id", F.col("location.file_path").alias("file_path"))
    return decoded(rows).select("id", F.try_element_at("metadata", F.lit("kind")).alias("kind"), F.size("metadata").alias("n_keys")).join(located, "id")


@_query(f"with {_STATS} select profile_id, frame_index, name, case when profile_id = '2024-01-02' then self_weight * 2 else self_weight end as self_weight, symbol_id from st where not (profile_id = '2024-01-02' and name = 'root')")
def store_replace_profile(t: Tables) -> DataFrame:
    """A profile is put again, with twice the weight and without a frame."""
    store, day = _profiles(t), "2024-01-02"
    again = store.function_stats.where((F.col("profile_id") == day) & (F.col("name") != "root")).withColumn("self_weight", F.col("self_weight") * 2)
    store.put_profiles(store.profiles.where(F.col("id") == day), store.frames.where(F.col("profile_id") == day), again)
    return store.function_stats.select(*_STAT_COLUMNS)


@_query(f"with {_STATS} select profile_id, frame_index, name from st where profile_id <> '2024-01-02'")
def store_delete_profile(t: Tables) -> DataFrame:
    store = _profiles(t)
    store.delete_profile("2024-01-02")
    return store.frames.select("profile_id", "frame_index", "name").join(store.profiles.select(F.col("id").alias("profile_id")), "profile_id", "left_semi")


@_query(f"with {_STATS} select profile_id, frame_index, name, self_weight, case when profile_id = '2024-01-02' and frame_index in (1, 2) then 's' || frame_index else symbol_id end as symbol_id from st")
def store_correlate(t: Tables) -> DataFrame:
    store = _profiles(t)
    store.correlate("2024-01-02", {1: "s1", 2: "s2", 999: "s999"})
    return store.function_stats.select(*_STAT_COLUMNS)


@_query(f"with {_MAPPINGS} select profile_id, frame_index, name, self_weight, case when profile_id = 'Brand#11' then m.symbol_id end as symbol_id from ps left join m on name = frame_name")
def store_apply_mappings(t: Tables) -> DataFrame:
    store = _part_profiles(t)
    store.put_mappings(_mappings(t))
    store.apply_mappings("Brand#11")
    return store.function_stats.select(*_STAT_COLUMNS)


@_query(f"with {_MAPPINGS} select frame_name, case when frame_name like 'red%' then 'again' else symbol_id end as symbol_id, case when frame_name like 'red%' then 1.0 else confidence end as confidence from m where frame_name <> 'red plate'")
def store_mappings(t: Tables) -> DataFrame:
    """Mappings, some put anew, one deleted."""
    store = Store(t.spark)
    store.put_mappings(_mappings(t))
    store.put_mappings(store.mappings.where("frame_name like 'red%'").select("frame_name", F.lit("again").alias("symbol_id")))
    store.delete_mapping("red plate")
    return store.mappings.select("frame_name", "symbol_id", "confidence")


@_query("""with p as (select p_partkey as k, 'g' || p_partkey % 40 as name from part), f as (select name, min(k) as k from p group by name)
select p_brand as profile_id, 'g' || p_partkey % 40 as name, 'n' || f.k as symbol_id from part join f on f.name = 'g' || p_partkey % 40 group by all""")
def correlate_profiles(t: Tables) -> DataFrame:
    """Profiles of brands, all in one job, against nodes of which many have one name."""
    name = F.concat(F.lit("g"), (F.col("p_partkey") % 40).cast("string"))
    p = t.read("part")
    store = Store(t.spark)
    store.put_nodes(p.select(F.concat(F.lit("n"), "p_partkey").alias("id"), F.lit("r").alias("repo_path"), F.concat(F.lit("m"), "p_partkey").alias("file_path"), F.lit("function").alias("node_type"), name.alias("name"), F.lit(1).alias("start_line"), F.lit(0).alias("start_column"), F.lit(2).alias("end_line"), F.lit(0).alias("end_column"), F.col("p_partkey").alias("seq")))
    stats = p.groupBy(F.col("p_brand").alias("profile_id"), name.alias("name")).agg(F.min("p_partkey").cast("int").alias("frame_index")).withColumns({"call_count": F.lit(1), **{c: F.lit(0.0) for c in ("self_weight", "total_weight", "self_percentage", "total_percentage")}})
    brands = stats.select(F.col("profile_id").alias("id")).distinct()
    store.put_profiles(brands.select("id", F.col("id").alias("name"), F.lit("sampled").alias("profile_type"), F.lit("none").alias("unit"), F.lit(0.0).alias("start_value"), F.lit(1.0).alias("end_value")), stats.select("profile_id", "frame_index", "name"), stats)
    correlate.Correlator(store).correlate_profiles(brands.select(F.col("id").alias("profile_id")), "r")
    return store.function_stats.select("profile_id", "name", "symbol_id")


@_query(f"with {_STATS} select * from st where profile_id = '2024-01-02' order by total_weight desc, frame_index limit 4")
def hotspots_total(t: Tables) -> DataFrame:
    return profiles.hotspots(t.stats(), "2024-01-02", 4, "total")


@_query("""with p as (select p_partkey as k, 'S' || p_partkey || '.cs' as f from part)
select 'r/' || f || ':C' || k || ':2' as source_id, 'r/' || f || ':A' || k || ':3' as target_id, 'contains' as edge_type, 3::int as line from p
union all select 'r/' || f || ':C' || k || ':2', 'r/' || f || ':B' || k || ':11', 'contains', 11 from p
union all select 'r/' || f || ':B' || k || ':11', 'r/' || f || ':A' || k || ':3', 'calls', 13 from p""")
def server_dump_edges(t: Tables) -> DataFrame:
    """A language server's dumps, a file a part: class C with the methods A and B, B uses A, and A's own line is left out."""
    k = F.col("p_partkey").cast("string")
    file = F.concat(F.lit("S"), k, F.lit(".cs"))
    span = lambda a, b: F.struct(F.struct(F.struct(F.lit(a).alias("Line"), F.lit(0).alias("Column")).alias("Start"), F.struct(F.lit(b).alias("Line"), F.lit(9).alias("Column")).alias("End")).alias("full"))
    method = lambda n, a, b: F.struct(F.lit("method").alias("Kind"), F.concat(F.lit(n), k).alias("Name"), span(a, b).alias("Ranges"))
    tree = F.struct(file.alias("FileName"), F.array(F.struct(F.lit("class").alias("Kind"), F.concat(F.lit("C"), k).alias("Name"), span(1, 29).alias("Ranges"), F.array(method("A", 2, 9), method("B", 10, 20)).alias("Children"))).alias("Elements"))
    fix = lambda line: F.struct(file.alias("FileName"), F.lit(line).alias("Line"), F.lit(4).alias("Column"), F.lit(line).alias("EndLine"), F.lit(6).alias("EndColumn"))
    usage = F.struct(F.concat(file, F.lit(":A"), k, F.lit(":3")).alias("SymbolId"), F.array(fix(12), fix(3)).alias("QuickFixes"))
    store = Store(t.spark)
    base = f"{shared_dir(t.spark)}/dump-{store.path.rsplit('-', 1)[-1]}"
    for name, rows in (("symbols", tree), ("usages", usage)):
        t.read("part").select(F.to_json(rows)).write.text(f"{base}/{name}")
    nodes, inside = server.server_nodes(t.spark, f"{base}/symbols", "r", "full")
    store.put_nodes(nodes, repo_path="r")
    edges = inside.unionByName(server.usage_edges(t.spark, f"{base}/usages", store.nodes, "r"))
    return edges.select("source_id", "target_id", "edge_type", F.col("location_start_line").alias("line"))
