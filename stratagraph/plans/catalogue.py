"""The operators of the graph and profile engine as queries over the driver's tables, with SQL for each.

The tables become graphs and profiles by one adapter, the same in both
engines.  Orders and parts are nodes, line items edges (returned A: calls, N:
references, R: imports).  The events of a day are a profile whose samples are
stacks ``root``, ``user_k``, event type.  Weights are summed as decimals, so
that sums don't depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import store
from ..functions import frames
from ..operators import correlate, graph, profiles, resolve
from ..sources.extract import default_registry, extract_files
from ..sources.repo import excluded, has_extension, infer_language

SYMBOL, REPO = "red plate", "F"
DAY_1, DAY_2 = "2024-01-02", "2024-01-03"


class Tables:
    """The adapter's frames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def nodes(self) -> DataFrame:
        o, p = self.read("orders"), self.read("part")
        key = F.col("o_orderkey")
        orders = o.select(
            F.concat(F.lit("order:"), key).alias("id"), F.col("o_orderstatus").alias("repo_path"), F.concat(F.lit("cust/"), F.col("o_custkey")).alias("file_path"), F.lit("function").alias("node_type"),
            F.col("o_orderpriority").alias("name"), F.lit(None).cast("string").alias("qualified_name"), (key + 1).cast("int").alias("start_line"), (key + 10).cast("int").alias("end_line"), key.alias("seq"),
        )
        key = F.col("p_partkey")
        parts = p.select(
            F.concat(F.lit("part:"), key).alias("id"), F.lit("lib").alias("repo_path"), F.col("p_brand").alias("file_path"), F.lit("class").alias("node_type"),
            F.col("p_name").alias("name"), F.concat_ws(".", "p_brand", "p_type", "p_name").alias("qualified_name"), F.col("p_size").cast("int").alias("start_line"), (F.col("p_size") + 5).cast("int").alias("end_line"), (key + 1_000_000_000).alias("seq"),
        )
        return orders.unionByName(parts)

    def edges(self) -> DataFrame:
        kind = F.when(F.col("l_returnflag") == "A", "calls").when(F.col("l_returnflag") == "N", "references").otherwise("imports")
        return self.read("lineitem").select(F.concat(F.lit("order:"), F.col("l_orderkey")).alias("source_id"), F.concat(F.lit("part:"), F.col("l_partkey")).alias("target_id"), kind.alias("edge_type"))

    def file_edges(self) -> DataFrame:
        """Imports, and back again, so that there are cycles."""
        imports = self.edges().where("edge_type = 'imports'")
        return imports.unionByName(imports.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "edge_type"))

    def samples(self) -> DataFrame:
        e = self.read("events")
        stack = F.array(F.lit("root"), F.concat(F.lit("user_"), F.pmod("user_id", F.lit(5))), F.col("event_type"))
        return e.select(F.to_date("ts").cast("string").alias("profile_id"), stack.alias("stack"), F.col("value").cast("decimal(18,2)").alias("weight"))

    def stats(self) -> DataFrame:
        """Statistics by profile and frame, as decimals made doubles."""
        samples = self.samples()
        w = profiles.sampled_weights(samples, ["profile_id"])
        whole = samples.groupBy("profile_id").agg(F.sum("weight").alias("whole"))
        both = w.join(whole, "profile_id")
        d = lambda c: F.col(c).cast("double")
        pct = lambda c: F.coalesce(F.try_divide(d(c) * 100, d("whole")), F.lit(0.0))
        index = F.dense_rank().over(profiles.Window.partitionBy("profile_id").orderBy("frame"))
        return both.select(
            "profile_id", index.cast("int").alias("frame_index"), F.col("frame").alias("name"), F.lit("events").alias("file"), F.lit(1).alias("line"),
            d("self_weight").alias("self_weight"), d("total_weight").alias("total_weight"), "call_count", pct("self_weight").alias("self_percentage"), pct("total_weight").alias("total_percentage"),
            F.when(F.col("frame") == "root", "part:1").alias("symbol_id"),
        )

    def profiles(self) -> DataFrame:
        days = self.read("events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
        return days.select(F.col("day").cast("string").alias("id"), F.concat(F.lit("day "), F.col("day").cast("string")).alias("name"), F.lit(0.0).alias("start_value"), F.col("n").cast("double").alias("end_value"), F.when(F.dayofmonth("day") % 2 == 0, "even").otherwise("odd").alias("repo_path"), F.col("day").cast("timestamp_ntz").alias("created_at"), F.lit(None).cast("string").alias("metadata"))

    def mappings(self) -> DataFrame:
        names = self.read("part").select(F.col("p_name").alias("frame_name"), F.col("p_partkey").alias("k")).groupBy("frame_name").agg(F.min("k").alias("k"))
        return names.where(F.col("k") % 2 == 0).select("frame_name", F.when(F.col("k") % 4 == 0, F.concat(F.lit("part:"), "k")).alias("symbol_id"), (F.pmod("k", F.lit(10)).cast("double") / 10).alias("confidence"), F.col("k").alias("last_updated"))

    def part_stats(self) -> DataFrame:
        """Statistics whose frames have the names of parts: one profile a brand."""
        p = self.read("part")
        w = p.groupBy(F.col("p_brand").alias("profile_id"), F.col("p_name").alias("name")).agg(F.sum(F.col("p_retailprice").cast("decimal(18,2)")).cast("double").alias("self_weight"), F.count(F.lit(1)).alias("call_count"), F.min("p_partkey").cast("int").alias("frame_index"))
        return w.select("profile_id", "frame_index", "name", "self_weight", F.col("self_weight").alias("total_weight"), "call_count", F.lit(None).cast("string").alias("symbol_id"))


_NODES = """
n as (
  select 'order:' || o_orderkey as id, o_orderstatus as repo_path, 'cust/' || o_custkey as file_path, 'function' as node_type, o_orderpriority as name, null::varchar as qualified_name, (o_orderkey + 1)::int as start_line, (o_orderkey + 10)::int as end_line, o_orderkey::bigint as seq from orders
  union all
  select 'part:' || p_partkey, 'lib', p_brand, 'class', p_name, p_brand || '.' || p_type || '.' || p_name, p_size::int, (p_size + 5)::int, (p_partkey + 1000000000)::bigint from part),
e as (select 'order:' || l_orderkey as source_id, 'part:' || l_partkey as target_id, case l_returnflag when 'A' then 'calls' when 'N' then 'references' else 'imports' end as edge_type from lineitem)
"""
_STATS = """
s as (select ts::date::varchar as profile_id, ['root', 'user_' || (user_id % 5), event_type] as stack, value::decimal(18,2) as w from events),
x as (select profile_id, unnest(stack) as name, stack[3] as leaf, w from s),
t as (select profile_id, name, sum(case when name = leaf then w else 0 end)::double as self_weight, sum(w)::double as total_weight, count(*) filter (name = leaf)::bigint as call_count from x group by all),
z as (select profile_id, sum(w)::double as whole from s group by all),
st as (select profile_id, dense_rank() over (partition by profile_id order by name)::int as frame_index, name, 'events' as file, 1::int as line, self_weight, total_weight, call_count, self_weight * 100 / whole as self_percentage, total_weight * 100 / whole as total_percentage, case when name = 'root' then 'part:1' end as symbol_id from t join z using (profile_id)),
pr as (select ts::date::varchar as id, 'day ' || ts::date::varchar as name, 0.0::double as start_value, count(*)::double as end_value, case when day(ts::date) % 2 = 0 then 'even' else 'odd' end as repo_path, ts::date::timestamp as created_at, null::varchar as metadata from events group by ts::date)
"""
_MAPPINGS = """
m0 as (select p_name as frame_name, min(p_partkey) as k from part group by p_name),
m as (select frame_name, case when k % 4 = 0 then 'part:' || k end as symbol_id, (k % 10)::double / 10 as confidence, k::bigint as last_updated from m0 where k % 2 = 0),
ps as (select p_brand as profile_id, p_name as name, sum(p_retailprice::decimal(18,2))::double as self_weight, count(*)::bigint as call_count, min(p_partkey)::int as frame_index from part group by p_brand, p_name)
"""
_N = "id, repo_path, file_path, node_type, name, qualified_name, start_line, end_line, seq"
_KINDS = "('calls', 'references', 'imports', 'instantiates', 'inherits', 'implements')"

FOUND: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None):
    def keep(f: Callable[[Tables], DataFrame]):
        FOUND[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _linked(where: str, kinds: str, here: str = "target_id", there: str = "source_id", tail: str = "") -> str:
    return f"with {_NODES} select {_N} from n where id in (select {there} from e where edge_type in {kinds} and {here} in (select id from n where {where})) {tail}"


_CALLERS = _linked(f"name = '{SYMBOL}'", "('calls')", tail=f"and repo_path = '{REPO}'")
_ORDER = "order by file_path, start_line, id"


@_query(_CALLERS)
def find_callers(t: Tables) -> DataFrame:
    return graph.find_callers(t.nodes(), t.edges(), SYMBOL, REPO)


@_query(f"{_CALLERS} {_ORDER} limit 20 offset 10")
def find_callers_paged(t: Tables) -> DataFrame:
    return graph.find_callers(t.nodes(), t.edges(), SYMBOL, REPO, limit=20, offset=10)


@_query(f"{_CALLERS} {_ORDER} offset 15")
def find_callers_offset(t: Tables) -> DataFrame:
    return graph.find_callers(t.nodes(), t.edges(), SYMBOL, REPO, offset=15)


_CALLEES = _linked("name = '1-URGENT' and repo_path = 'F'", "('calls')", "source_id", "target_id")


@_query(_CALLEES)
def find_callees(t: Tables) -> DataFrame:
    return graph.find_callees(t.nodes(), t.edges(), "1-URGENT", REPO)


@_query(f"{_CALLEES} {_ORDER} limit 25 offset 5")
def find_callees_paged(t: Tables) -> DataFrame:
    return graph.find_callees(t.nodes(), t.edges(), "1-URGENT", REPO, limit=25, offset=5)


_REFERENCES = _linked(f"name = '{SYMBOL}'", _KINDS, tail=f"and repo_path = '{REPO}'")


@_query(_REFERENCES)
def find_references(t: Tables) -> DataFrame:
    return graph.find_references(t.nodes(), t.edges(), SYMBOL, REPO)


@_query(f"{_REFERENCES} {_ORDER} limit 30 offset 3")
def find_references_paged(t: Tables) -> DataFrame:
    return graph.find_references(t.nodes(), t.edges(), SYMBOL, REPO, limit=30, offset=3)


@_query(f"with {_NODES} select {_N} from n where name = '{SYMBOL}' and repo_path = 'lib' order by seq, id limit 1")
def symbol_info(t: Tables) -> DataFrame:
    return graph.symbol_info(t.nodes(), SYMBOL, "lib")


@_query(f"with {_NODES} select {_N} from n where id = 'part:7'")
def node_by_id(t: Tables) -> DataFrame:
    return graph.get_node(t.nodes(), "part:7")


@_query(f"with {_NODES} select {_N} from n where name = '{SYMBOL}' and node_type = 'class'")
def nodes_by_name(t: Tables) -> DataFrame:
    return graph.nodes_by_name(t.nodes(), SYMBOL, kind="class")


@_query(f"with {_NODES} select {_N} from n where file_path = 'Brand#11' and repo_path = 'lib'")
def nodes_by_file(t: Tables) -> DataFrame:
    return graph.nodes_by_file(t.nodes(), "Brand#11", "lib")


@_query(f"with {_NODES} select {_N} from n where repo_path = 'P'")
def nodes_by_repo(t: Tables) -> DataFrame:
    return graph.all_nodes(t.nodes(), "P")


@_query(f"with {_NODES} select * from e where source_id = 'order:1'")
def edges_from(t: Tables) -> DataFrame:
    return graph.edges_from(t.edges(), "order:1")


@_query(f"with {_NODES} select * from e where target_id = 'part:1' and edge_type = 'calls'")
def edges_to(t: Tables) -> DataFrame:
    return graph.edges_to(t.edges(), "part:1", "calls")


@_query(f"with {_NODES} select e.* from e where source_id in (select id from n where repo_path = 'P')")
def edges_by_repo(t: Tables) -> DataFrame:
    return graph.all_edges(t.nodes(), t.edges(), "P")


@_query(f"with {_NODES} select node_type, count(*)::bigint as n_nodes, count(distinct file_path)::bigint as n_files from n group by grouping sets ((node_type), ())")
def repo_stats_nodes(t: Tables) -> DataFrame:
    return graph.node_stats(t.nodes())


@_query(f"with {_NODES} select edge_type, count(*)::bigint as n_edges from e where source_id in (select id from n where repo_path = '{REPO}') group by rollup (edge_type)")
def repo_stats_edges(t: Tables) -> DataFrame:
    return graph.edge_stats(t.nodes(), t.edges(), REPO)


@_query(f"""with recursive {_NODES},
b as (select source_id, target_id, edge_type from e where edge_type = 'imports' union all select target_id, source_id, edge_type from e where edge_type = 'imports'),
fs as (select distinct a.file_path as a, c.file_path as b from b join n a on b.source_id = a.id join n c on b.target_id = c.id where a.file_path <> c.file_path and a.repo_path = 'lib'),
r as (select 'Brand#11' as f, 0 as d union select fs.b, d + 1 from r join fs on fs.a = r.f where d < 1)
select b.* from b join n on b.source_id = n.id where n.repo_path = 'lib' and n.file_path in (select f from r)""")
def import_graph_depth2(t: Tables) -> DataFrame:
    return graph.import_graph(t.nodes(), t.file_edges(), "Brand#11", "lib", depth=2)


@_query(f"with {_NODES} select distinct file_path from n where id in (select source_id from e where edge_type in {_KINDS} and target_id in (select id from n where name = '{SYMBOL}' and repo_path = 'lib'))")
def impact_files(t: Tables) -> DataFrame:
    return graph.impact(t.nodes(), t.edges(), SYMBOL, "lib").select("file_path").distinct()


@_query(f"""with {_NODES},
p as (select o_orderkey as k, o_orderstatus as repo_path, 'cust/' || o_custkey as file_path, (o_orderkey + 4)::int as line from orders),
c as (select p.*, n.id, row_number() over (partition by p.k order by n.end_line - n.start_line, n.seq) as r from p join n using (repo_path, file_path) where p.line between n.start_line and n.end_line)
select k, repo_path, file_path, line, id as node_id from c where r = 1""")
def containing_node(t: Tables) -> DataFrame:
    places = t.read("orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("repo_path"), F.concat(F.lit("cust/"), F.col("o_custkey")).alias("file_path"), (F.col("o_orderkey") + 4).cast("int").alias("line"))
    return graph.containing_nodes(t.nodes(), places)


@_query(f"with {_STATS} select * from st")
def sampled_stats(t: Tables) -> DataFrame:
    return t.stats()


@_query(f"with {_STATS} select * from st where profile_id = '{DAY_1}' order by self_weight desc, frame_index limit 5")
def top_functions_self(t: Tables) -> DataFrame:
    return profiles.top_functions(t.stats(), DAY_1, 5, "self")


@_query(f"with {_STATS} select * from st where profile_id = '{DAY_1}' order by total_weight desc, frame_index limit 5")
def top_functions_total(t: Tables) -> DataFrame:
    return profiles.top_functions(t.stats(), DAY_1, 5, "total")


@_query(f"with {_STATS} select id, name, start_value, end_value, repo_path, created_at, metadata from pr where repo_path = 'even' order by created_at desc, id limit 5 offset 2")
def list_profiles(t: Tables) -> DataFrame:
    return profiles.list_profiles(t.profiles(), "even", 5, 2)


@_query(f"with {_STATS} select * from st where translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') like '%user%' order by self_weight desc, profile_id, frame_index limit 50")
def search_functions(t: Tables) -> DataFrame:
    return profiles.search_functions(t.stats(), "USER")


_TREND = "with {s} select st.*, pr.name as profile_name, created_at, metadata as profile_metadata from st join pr on st.profile_id = pr.id where {w} order by created_at desc, profile_id, frame_index limit 10"


@_query(_TREND.format(s=_STATS, w="st.name = 'root'"))
def function_trend(t: Tables) -> DataFrame:
    return profiles.function_trend(t.profiles(), t.stats(), "root")


@_query(_TREND.format(s=_STATS, w="st.name like 'user__'"))
def function_trend_pattern(t: Tables) -> DataFrame:
    return profiles.function_trend(t.profiles(), t.stats(), "user__")


@_query(f"with {_STATS} select st.*, pr.name as profile_name, created_at from st join pr on st.profile_id = pr.id where symbol_id = 'part:1' order by created_at desc, profile_id, frame_index limit 10")
def functions_by_symbol(t: Tables) -> DataFrame:
    return profiles.functions_by_symbol(t.profiles(), t.stats(), "part:1")


def _compared(kind: str) -> str:
    return f"""with {_STATS},
b as (select * from st where profile_id = '{DAY_1}' and name <> 'purchase'), a as (select * from st where profile_id = '{DAY_2}' and name <> 'user_1'),
c as (select coalesce(a.name, b.name) as name, coalesce(nullif(a.file, ''), b.file) as file, coalesce(b.self_weight, 0) as before_self, coalesce(a.self_weight, 0) as after_self, coalesce(b.total_weight, 0) as before_total, coalesce(a.total_weight, 0) as after_total, coalesce(b.call_count, 0) as before_count, coalesce(a.call_count, 0) as after_count, b.name is null as is_new, a.name is null as is_gone from a full join b on a.name = b.name),
d as (select *, after_self - before_self as self_delta, after_total - before_total as total_delta, after_count - before_count as count_delta, case when before_self > 0 then (after_self - before_self) / before_self * 100 end as self_pct, case when before_total > 0 then (after_total - before_total) / before_total * 100 end as total_pct from c),
k as (select * exclude (is_new, is_gone), case when is_new then 'new' when is_gone then 'removed' when self_pct > 5 then 'regression' when self_pct < -5 then 'improvement' else 'unchanged' end as change_class from d)
select * from k where change_class = '{kind}'"""


def _compare(t: Tables, kind: str) -> DataFrame:
    s = t.stats().where(f"not (profile_id = '{DAY_1}' and name = 'purchase') and not (profile_id = '{DAY_2}' and name = 'user_1')")
    return profiles.compare(s, DAY_1, DAY_2).where(F.col("change_class") == kind)


@_query(_compared("regression"))
def compare_regressions(t: Tables) -> DataFrame:
    return _compare(t, "regression")


@_query(_compared("improvement"))
def compare_improvements(t: Tables) -> DataFrame:
    return _compare(t, "improvement")


@_query(_compared("new"))
def compare_new(t: Tables) -> DataFrame:
    return _compare(t, "new")


@_query(_compared("removed"))
def compare_removed(t: Tables) -> DataFrame:
    return _compare(t, "removed")


@_query(f"with {_STATS} select b.end_value - b.start_value as before_duration, a.end_value - a.start_value as after_duration, a.end_value - a.start_value - (b.end_value - b.start_value) as duration_delta, (a.end_value - a.start_value - (b.end_value - b.start_value)) / (b.end_value - b.start_value) * 100 as duration_pct from pr b, pr a where b.id = '{DAY_1}' and a.id = '{DAY_2}'")
def compare_summary(t: Tables) -> DataFrame:
    return profiles.compare_summary(t.profiles(), DAY_1, DAY_2)


@_query("""with o as (select user_id, event_type, epoch_us(ts) as t0, lead(epoch_us(ts)) over (partition by user_id order by ts, event_id) as t1 from events)
select user_id, event_type as frame, sum(t1 - t0)::double as self_weight, sum(t1 - t0)::double as total_weight, count(*)::bigint as call_count from o where t1 is not null group by all""")
def evented_stats(t: Tables) -> DataFrame:
    """Each event is a call that lasts until the user's next one."""
    e = t.read("events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("ends", F.lead("at").over(profiles.Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("ends is not null")
    row = lambda kind, at, k: F.struct(F.lit(kind).alias("kind"), F.col("event_type").alias("frame"), F.col(at).cast("double").alias("at"), F.struct(F.col("at").alias("p"), F.col("event_id").alias("q"), F.lit(k).alias("r")).alias("at_pos"))
    events = e.select("user_id", F.explode(F.array(row("O", "at", 0), row("C", "ends", 1))).alias("x")).select("user_id", "x.*")
    return profiles.evented_weights(events, ["user_id"])


@_query(f"with {_MAPPINGS} select distinct name from ps where name not in (select frame_name from m)")
def unmapped_frames(t: Tables) -> DataFrame:
    return correlate.unmapped_frames(t.part_stats(), t.mappings())


@_query(f"with {_MAPPINGS} select frame_name, symbol_id, confidence, last_updated from m where confidence >= 0.4 order by last_updated desc, frame_name limit 10")
def symbol_mappings(t: Tables) -> DataFrame:
    return correlate.symbol_mappings(t.mappings(), 0.4, 10)


@_query(f"with {_MAPPINGS} select frame_name, symbol_id, confidence, last_updated from m where frame_name = '{SYMBOL}'")
def symbol_mapping(t: Tables) -> DataFrame:
    return correlate.symbol_mapping(t.mappings(), SYMBOL)


@_query(f"with {_MAPPINGS} select profile_id, frame_index, name, m.symbol_id from ps join m on name = frame_name where m.symbol_id is not null")
def apply_mappings(t: Tables) -> DataFrame:
    known = t.mappings().where("symbol_id is not null").select(F.col("frame_name").alias("name"), F.col("symbol_id").alias("found"))
    return store.with_symbols(t.part_stats(), known, ["name"], F.lit(True)).where("symbol_id is not null").select("profile_id", "frame_index", "name", "symbol_id")


@_query(f"""with {_NODES}, w as (select o_orderpriority as name, sum(o_totalprice::decimal(18,2))::double as self_weight, sum(o_totalprice::decimal(18,2))::double as total_weight, count(*)::bigint as call_count from orders group by all),
c as (select {_N} from n where repo_path = '{REPO}' and id in (select source_id from e where edge_type = 'calls' and target_id in (select id from n where name = '{SYMBOL}')))
select c.*, self_weight, total_weight, call_count from c left join w using (name)""")
def hot_callers(t: Tables) -> DataFrame:
    w = t.read("orders").groupBy(F.col("o_orderpriority").alias("name")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("self_weight"), F.count(F.lit(1)).alias("call_count"))
    stats = w.select(F.lit("p").alias("profile_id"), F.lit(0).alias("frame_index"), "name", "self_weight", F.col("self_weight").alias("total_weight"), "call_count")
    return profiles.hot_callers(graph.find_callers(t.nodes(), t.edges(), SYMBOL, REPO), stats, "p")


@_query("""with f as (select p_partkey as k, p_brand || '.' || p_type || '.' || upper(left(p_name, 1)) || regexp_replace(p_name[2:], ' .*', '') as name from part)
select k, name, string_split(name, '.')[-1] as function_name, string_split(name, '.')[-2] as class_name, array_to_string(string_split(name, '.')[1:-3], '.') as namespace, name as qualified_name, 'dotnet' as language from f""")
def normalise_frames(t: Tables) -> DataFrame:
    p = t.read("part")
    first = F.split_part("p_name", F.lit(" "), F.lit(1))
    name = F.concat_ws(".", "p_brand", "p_type", F.concat(F.upper(F.substring(first, 1, 1)), F.expr("substring(split_part(p_name, ' ', 1), 2)")))
    return frames.normalise(p.select(F.col("p_partkey").alias("k"), name.alias("name"))).select("k", "name", "function_name", "class_name", "namespace", "qualified_name", "language")


@_query("""select p_name as name, 'part:' || min(p_partkey) as symbol_id, 0.85::double as confidence, 'Qualified name suffix match' as match_reason from part group by p_name
union all select o_orderpriority, 'order:' || min(o_orderkey), 0.6::double, 'Best guess from ' || count(*) || ' matches' from orders group by o_orderpriority""")
def match_frames(t: Tables) -> DataFrame:
    names = t.read("part").select(F.col("p_name").alias("name")).union(t.read("orders").select("o_orderpriority")).distinct()
    return correlate.match_frames(frames.normalise(names, hint="unknown"), t.nodes().withColumn("repo_path", F.lit("all")), "all")


@_query(f"""with {_NODES}, u as (select l_partkey, max(struct_pack(d := l_shipdate, o := l_orderkey, n := l_linenumber, q := l_quantity)) as m from lineitem group by l_partkey)
select l_partkey, m.q as l_quantity from u""")
def upsert_latest(t: Tables) -> DataFrame:
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_quantity")
    return store.latest(t.read("lineitem"), ["l_partkey"], order).select("l_partkey", "l_quantity")


@_query(f"with {_NODES}, g as (select id from n where repo_path = 'lib' and file_path = 'Brand#11') select * from e where source_id not in (select id from g) and target_id not in (select id from g)")
def clear_file_cascade(t: Tables) -> DataFrame:
    return store.cascade(t.edges(), graph.nodes_by_file(t.nodes(), "Brand#11", "lib").select("id"))


@_query("""with n as (select 'p' || p_partkey as id, p_brand as file_path, p_name as name, p_brand || '.' || p_name as qualified_name, p_partkey as seq from part),
ed as (select l_orderkey as ok, l_linenumber as ln, row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as ordinal, p.p_brand as file_path, p.p_name as source_name, q.p_name as target_name from lineitem join part p on l_partkey = p.p_partkey join part q on q.p_partkey = l_suppkey),
f as (select file_path, name, arg_min(id, seq) as id from n group by all),
a as (select name, arg_min(id, seq) as id from n group by all)
select ok, ln, s.id as source_id, coalesce(x.id, a.id) as target_id from ed join f s on s.file_path = ed.file_path and s.name = ed.source_name left join f x on x.file_path = ed.file_path and x.name = ed.target_name left join a on a.name = ed.target_name""")
def resolve_edges(t: Tables) -> DataFrame:
    p = t.read("part")
    nodes = p.select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_brand").alias("file_path"), F.col("p_name").alias("name"), F.concat_ws(".", "p_brand", "p_name").alias("qualified_name"), F.col("p_partkey").alias("seq"), F.lit("class").alias("node_type"))
    by = lambda a, b: p.select(F.col("p_partkey").alias(a), F.col("p_name").alias(b), F.col("p_brand").alias(f"{b}_brand"))
    li = t.read("lineitem").join(by("l_partkey", "source_name"), "l_partkey").join(by("l_suppkey", "target_name"), "l_suppkey")
    edges = li.select(F.col("source_name_brand").alias("file_path"), F.struct("l_orderkey", "l_linenumber", F.monotonically_increasing_id().alias("u")).alias("ordinal"), "source_name", "target_name", F.lit(None).cast("string").alias("target_module"))
    out = resolve.resolve_edges(nodes, edges)
    return out.select(F.col("ordinal.l_orderkey").alias("ok"), F.col("ordinal.l_linenumber").alias("ln"), "source_id", "target_id")


@_query("select file_path, not starts_with(file_path, 'Brand#1') and string_split(file_path, '/')[2] <> 'ECONOMY' and not ends_with(file_path, 'SMALL') as kept from (select distinct p_brand || '/' || p_type as file_path from part)")
def exclude_patterns(t: Tables) -> DataFrame:
    paths = t.read("part").select(F.concat_ws("/", "p_brand", "p_type").alias("file_path")).distinct()
    return paths.select("file_path", (~excluded(F.col("file_path"), ["Brand#1/**", "**/ECONOMY/**", "**/SMALL"])).alias("kept"))


# --- sources: files are made from rows, so that SQL knows what extractors must find ---


def _extracted(t: Tables, path: str, content: str) -> DataFrame:
    """What an extractor finds in one file a part; ``{k}`` is the part's key, ``{m}`` the key modulo 7."""
    key = F.col("p_partkey").cast("string")
    fill = lambda s: F.replace(F.replace(F.lit(s), F.lit("{k}"), key), F.lit("{m}"), F.pmod("p_partkey", F.lit(7)).cast("string"))
    files = t.read("part").select(fill(path).alias("file_path"), F.encode(fill(content), "UTF-8").alias("content"))
    rows = extract_files(files, default_registry()).where("record != 'file'")
    return rows.select("file_path", "record", F.coalesce("node_type", "edge_type").alias("kind"), F.coalesce("qualified_name", "source_name").alias("name"), "target_name", "signature", "start_line", F.coalesce("end_line", "start_line").alias("end_line"))


def _expected(path: str, *rows: tuple[str, str, str, str | None, str | None, int, int | None]) -> str:
    def text(x) -> str:
        if x is None:
            return "null"
        return str(x) if isinstance(x, int) else "replace(replace('" + x.replace("'", "''") + "', '{k}', p_partkey::varchar), '{m}', (p_partkey % 7)::varchar)"

    names = ("file_path", "record", "kind", "name", "target_name", "signature", "start_line", "end_line")
    kinds = ("varchar",) * 6 + ("int",) * 2
    return " union all ".join("select " + ", ".join(f"{text(x)}::{k} as {n}" for x, k, n in zip((path, *row[:-1], row[-2] if row[-1] is None else row[-1]), kinds, names)) + " from part" for row in rows)


@_query(_expected(
    "src/p{k}.py", ("node", "import", "lib.call_{m}", None, None, 1, 1), ("edge", "imports", "<module>", "lib.call_{m}", None, 1, None), ("node", "class", "C{k}", None, None, 2, 4),
    ("edge", "inherits", "C{k}", "Base", None, 2, None), ("node", "method", "C{k}.run", None, "async def run(self, x: int=1) -> str", 3, 4), ("edge", "calls", "C{k}.run", "call_{m}", None, 4, None),
))
def extract_python(t: Tables) -> DataFrame:
    return _extracted(t, "src/p{k}.py", "from lib import call_{m}\nclass C{k}(Base):\n    async def run(self, x: int=1) -> str:\n        return call_{m}(x)\n")


@_query(_expected(
    "p{k}.cs", ("node", "namespace", "N", None, None, 1, 3), ("node", "class", "N.C{k}", None, None, 2, 2), ("edge", "inherits", "N.C{k}", "Base", None, 2, None), ("edge", "implements", "N.C{k}", "IRun", None, 2, None),
    ("node", "method", "N.C{k}.M{m}", None, "void M{m}(int a)", 2, 2), ("edge", "calls", "C{k}.M{m}", "other.Call", None, 2, None),
))
def extract_csharp(t: Tables) -> DataFrame:
    return _extracted(t, "p{k}.cs", "namespace N {\npublic class C{k} : Base, IRun { void M{m}(int a) { other.Call(a); } }\n}\n")


@_query(_expected(
    "p{k}.go", ("node", "package", "shop", None, None, 1, 1), ("node", "import", "a/fmt", None, None, 2, 2), ("edge", "imports", "<module>", "a/fmt", None, 2, None),
    ("node", "method", "shop.T{k}.Do", None, "func (t *T{k}) Do(n int) error", 3, 5), ("edge", "calls", "T{k}.Do", "Print", None, 4, None), ("edge", "calls", "T{k}.Do", "call{m}", None, 4, None),
))
def extract_go(t: Tables) -> DataFrame:
    return _extracted(t, "p{k}.go", 'package shop\nimport "a/fmt"\nfunc (t *T{k}) Do(n int) error {\n\treturn fmt.Print(call{m}(n))\n}\n')


@_query(_expected(
    "p{k}.php", ("node", "function", "f_{k}", None, "function f_{k}($x): int", 2, 2), ("edge", "calls", "f_{k}", "g_{m}", None, 2, None), ("edge", "registers_action", "f_{k}", "hook_{m}", None, 3, None), ("edge", "calls", "<module>", "add_action", None, 3, None),
))
def extract_php(t: Tables) -> DataFrame:
    return _extracted(t, "p{k}.php", "<?php\nfunction f_{k}($x): int { return g_{m}($x); }\nadd_action('hook_{m}', 'f_{k}');\n")


@_query(_expected(
    "p{k}.xaml", ("node", "page", "A.P{k}", None, None, 1, 4), ("node", "named_element", "A.P{k}.b{m}", None, None, 2, 2), ("edge", "event_handler", "p{k}.xaml", "A.P{k}.On{m}", None, 2, None),
    ("edge", "binding", "p{k}.xaml", "Save{k}", None, 2, None), ("edge", "command", "p{k}.xaml", "Save{k}", None, 2, None),
))
def extract_xaml(t: Tables) -> DataFrame:
    return _extracted(t, "p{k}.xaml", '<Page xmlns:x="http://schemas.microsoft.com/winfx/2006/xaml" x:Class="A.P{k}">\n<Button x:Name="b{m}" Clicked="On{m}" Command="{Binding Save{k}}"/>\n</Page>\n')


@_query("""with e as (select ts::date::varchar as day, event_type from events), z as (select day, count(*)::double as whole from e group by day)
select day || '.json - run' as profile_name, event_type as name, count(*)::double as self_weight, count(*)::double as total_weight, count(*)::bigint as call_count, count(*)::double / any_value(whole) * 100 as self_percentage from e join z using (day) group by day, event_type""")
def ingest_speedscope(t: Tables) -> DataFrame:
    """A day's events as a speedscope document: the frames are the event types, each event a sample."""
    types = ["click", "error", "purchase", "signup", "view"]
    e = t.read("events").select(F.to_date("ts").cast("string").alias("day"), (F.array_position(F.array(*map(F.lit, types)), F.col("event_type")) - 1).cast("int").alias("f"))
    days = e.groupBy("day").agg(F.collect_list(F.array("f")).alias("samples"))
    frames_ = F.array(*[F.struct(F.lit(x).alias("name")) for x in types])
    profile = F.struct(F.lit("sampled").alias("type"), F.lit("run").alias("name"), F.lit("none").alias("unit"), "samples")
    texts = days.select(F.concat("day", F.lit(".json")).alias("source_file"), F.to_json(F.struct(F.struct(frames_.alias("frames")).alias("shared"), F.array(profile).alias("profiles"))).alias("json"))
    bronze = profiles.bronze_profiles(profiles.checked(profiles.parse_speedscope(texts)))
    return profiles.function_stats(bronze, profile_name=True).select("profile_name", "name", "self_weight", "total_weight", "call_count", "self_percentage")


@_query("""with f as (select 'pkg/' || p_brand || '/m' || p_partkey || case p_partkey % 3 when 0 then '.py' when 1 then '.CS' else '.txt' end as file_path from part)
select file_path, case when file_path like '%.py' then 'python' when file_path like '%.CS' then 'csharp' end as language, file_path not like '%.txt' as taken from f""")
def scan_languages(t: Tables) -> DataFrame:
    end = F.when(F.col("p_partkey") % 3 == 0, ".py").when(F.col("p_partkey") % 3 == 1, ".CS").otherwise(".txt")
    path = F.concat(F.lit("pkg/"), "p_brand", F.lit("/m"), F.col("p_partkey").cast("string"), end)
    return t.read("part").select(path.alias("file_path")).select("file_path", infer_language(F.col("file_path")).alias("language"), has_extension(F.col("file_path"), [".py", ".cs"]).alias("taken"))


@_query("""select 'r/p' || p_partkey || '.py:' || p_name || ':' || p_size as id, 'r' as repo_path, 'p' || p_partkey || '.py' as file_path, case p_type when 'ECONOMY' then 'class' when 'STANDARD' then 'function' else 'variable' end as node_type, p_name as name from part""")
def nodes_of_symbols(t: Tables) -> DataFrame:
    raw = F.when(F.col("p_type") == "ECONOMY", "Page").when(F.col("p_type") == "STANDARD", "FUNCTION").otherwise("trait")
    null = lambda kind="string": F.lit(None).cast(kind)
    rows = t.read("part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("file_path"), F.lit("node").alias("record"), F.lit(0).alias("ordinal"), raw.alias("node_type"), F.col("p_name").alias("name"),
        *[null().alias(c) for c in ("qualified_name", "signature", "docstring", "metadata")], F.col("p_size").cast("int").alias("start_line"), *[null("int").alias(c) for c in ("start_column", "end_line", "end_column")],
    )
    return resolve.nodes_of(rows, "r", modules=False).select("id", "repo_path", "file_path", "node_type", "name")
