"""More queries of the catalogue: extraction rules, frame names, matching, resolution, evented profiles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import frames
from ..operators import correlate, profiles, resolve
from ..sources.repo import exclude_rules
from .catalogue import Tables, _expected, _extracted, _query


def _edge(kind: str, source: str, target: str, line: int) -> tuple:
    return "edge", kind, source, target, None, line, None


def _node(kind: str, name: str, line: int, end: int | None = None, signature: str | None = None) -> tuple:
    return "node", kind, name, None, signature, line, line if end is None else end


# --- extraction ---


@_query(_expected(
    "src/app/q{k}.py",
    _node("import", "os.path", 1), _edge("imports", "<module>", "os.path", 1), _node("import", "sys", 2), _edge("imports", "<module>", "sys", 2), _node("import", "app.near.*", 3), _edge("imports", "<module>", "app.near.*", 3),
    _node("import", "far.thing_{m}", 4), _edge("imports", "<module>", "far.thing_{m}", 4), _node("variable", "A", 5), _node("variable", "B", 5), _node("variable", "LIMIT", 6),
    _node("function", "f_{m}", 8, 11, "def f_{m}(a, *b, c = 2, **d)"), _edge("calls", "<module>", "wrap", 7), _edge("calls", "f_{m}.inner", "thing_{m}", 10), _edge("calls", "f_{m}", "join", 11), _edge("calls", "f_{m}", "exit", 11),
))
def extract_python_imports(t: Tables) -> DataFrame:
    return _extracted(t, "src/app/q{k}.py", "import os.path as osp\nimport sys\nfrom .near import *\nfrom far import thing_{m} as t\nA, B = 1, 2\nLIMIT: int = 7\n@wrap(1)\ndef f_{m}(a, *b, c = 2, **d):\n    def inner():\n        t()\n    return osp.join(sys.exit(a))\n")


@_query(_expected(
    "r{k}.py", _node("class", "K{k}", 3, 10), _edge("inherits", "K{k}", "Base", 3), _edge("inherits", "K{k}", "object", 3), _node("import", "lib", 1), _edge("imports", "<module>", "lib", 1),
    _node("method", "K{k}.p", 6, 7, "def p(self)"), _node("class", "K{k}.In", 8, 10), _node("method", "K{k}.In.m", 9, 10, "def m(cls, n{m}=(1, 2))"),
    _edge("calls", "K{k}.p", "f{m}", 7), _edge("calls", "K{k}.In.m", "n{m}", 10), _edge("calls", "K{k}.In.m", "Base.go", 10),
))
def extract_python_classes(t: Tables) -> DataFrame:
    return _extracted(t, "r{k}.py", "import lib\nif 1:\n  class K{k}(lib.Base, object, metaclass=M):\n    x = 1\n    @property\n    def p(self):\n        return self.f{m}()\n    class In:\n        def m(cls, n{m}=(1, 2)):\n            cls.n{m}(); lib.Base.go(); x[0]()\n")


@_query(_expected(
    "s{k}.cs", _node("import", "System.Linq", 1), _edge("imports", "<module>", "System.Linq", 1), _node("namespace", "A.B", 2, 9), _node("namespace", "A.B.C", 2, 9),
    _node("struct", "A.B.C.S{k}", 3), _node("field", "A.B.C.S{k}.X", 3), _node("field", "A.B.C.S{k}.Y", 3), _node("constructor", "A.B.C.S{k}.S{k}", 3, None, "S{k}(int x)"), _edge("calls", "S{k}.S{k}", "Init{m}", 3),
    _node("interface", "A.B.C.IThing", 4), _edge("implements", "A.B.C.IThing", "IBase", 4), _node("property", "A.B.C.IThing.Count", 4, None, "int Count"), _node("enum", "A.B.C.E{m}", 5), _node("record", "A.B.C.R{k}", 6),
    _node("class", "A.B.C.K{k}", 7, 8), _edge("inherits", "A.B.C.K{k}", "Base<int>", 7), _edge("implements", "A.B.C.K{k}", "IOne", 7), _node("method", "A.B.C.K{k}.RunAsync", 8, None, "async Task<int> RunAsync(int a, params string[] b)"),
    _edge("calls", "K{k}.RunAsync", "this.Do", 8), _edge("calls", "K{k}.RunAsync", "Helper.Get<int>", 8),
))
def extract_csharp_types(t: Tables) -> DataFrame:
    return _extracted(t, "s{k}.cs", "using System.Linq;\nnamespace A.B { namespace C {\npublic struct S{k}<T> where T : class { public int X, Y; public S{k}(int x) { Init{m}(x); } }\npublic interface IThing : IBase { int Count { get; } }\npublic enum E{m} { One, Two = 2 }\npublic record R{k}(int A, string B);\n[Serializable] public abstract partial class K{k} : Base<int>, IOne {\n  static async Task<int> RunAsync(int a, params string[] b) { await this.Do(a); return Helper.Get<int>(b); } }\n} }\n")


@_query(_expected(
    "c{k}.go", _node("package", "shop", 1), _node("import", "fmt", 3), _edge("imports", "<module>", "fmt", 3), _node("import", "x/y/zed{m}", 4), _edge("imports", "<module>", "x/y/zed{m}", 4), _node("import", "side/effect", 5), _edge("imports", "<module>", "side/effect", 5),
    _node("struct", "shop.Item{k}", 7, 10), _node("interface", "shop.Doer", 11), _node("type", "shop.Num", 12), _node("constant", "shop.X{m}", 14), _node("constant", "shop.Y{m}", 15), _node("variable", "shop.v1", 17), _node("variable", "shop.V2", 17),
    _node("function", "shop.F{k}", 18, 22, "func F{k}(a, b int, c ...string) (n int, err error)"), _edge("calls", "F{k}", "Go", 19), _edge("calls", "F{k}", "Println", 20), _edge("calls", "F{k}", "len", 20), _edge("calls", "F{k}", "x.y.Z", 21),
    _node("method", "shop.Item{k}.val", 23, None, "func (t Item{k}) val()"),
))
def extract_go_types(t: Tables) -> DataFrame:
    return _extracted(t, "c{k}.go", 'package shop\nimport (\n\t"fmt"\n\tal "x/y/zed{m}"\n\t_ "side/effect"\n)\ntype Item{k} struct {\n\tBase\n\tA, B string `json:"a"`\n}\ntype Doer interface { Do(x int) error; Base2 }\ntype Num int\nconst (\n\tX{m} = iota\n\tY{m}\n)\nvar v1, V2 = 1, 2\nfunc F{k}(a, b int, c ...string) (n int, err error) {\n\tal.Go(a)\n\tfmt.Println(len(c))\n\tx.y.Z()\n}\nfunc (t Item{k}) val() {}\n')


@_query(_expected(
    "d{k}.php", _node("import", "Lib\\Tool", 3), _edge("imports", "<module>", "Lib\\Tool", 3), _node("import", "Lib\\One", 4), _edge("imports", "<module>", "Lib\\One", 4), _node("import", "Lib\\Two", 4), _edge("imports", "<module>", "Lib\\Two", 4),
    _node("constant", "App\\M\\C{m}", 5), _node("class", "App\\M\\K{k}", 6, 11), _edge("inherits", "App\\M\\K{k}", "Base", 6), _edge("implements", "App\\M\\K{k}", "IA", 6), _edge("implements", "App\\M\\K{k}", "IB", 6), _edge("uses_trait", "App\\M\\K{k}", "TraitX", 7),
    _node("constant", "App\\M\\K{k}::ONE", 8), _node("property", "App\\M\\K{k}::$p", 9), _node("method", "App\\M\\K{k}::run", 10, None, "function run(int $a, $b = 1): ?string"),
    _edge("calls", "K{k}::run", "go", 10), _edge("calls", "K{k}::run", "st", 10), _edge("calls", "K{k}::run", "Lib\\Tool::make", 10), _edge("calls", "K{k}::run", "m", 10), _edge("calls", "K{k}::run", "strlen", 10),
    _node("interface", "App\\M\\I{k}", 12), _edge("extends", "App\\M\\I{k}", "IA", 12), _node("trait", "App\\M\\T{k}", 13), _node("method", "App\\M\\T{k}::tt", 13, None, "function tt()"),
))
def extract_php_types(t: Tables) -> DataFrame:
    return _extracted(t, "d{k}.php", "<?php\nnamespace App\\M;\nuse Lib\\Tool;\nuse Lib\\{One, Two as Deux};\nconst C{m} = 1;\nabstract class K{k} extends Base implements IA, IB {\n  use TraitX;\n  const ONE = 1;\n  public static ?int $p = 2;\n  protected function run(int $a, $b = 1): ?string { $this->go($a); self::st(); Tool::make(); $o->m(); return strlen($b); }\n}\ninterface I{k} extends IA {}\ntrait T{k} { function tt() {} }\n")


@_query(_expected(
    "h{k}.php", _node("function", "g{k}", 2, None, "function g{k}()"), _edge("registers_filter", "title{m}", "the_title", 3), _edge("calls", "<module>", "add_filter", 3), _edge("registers_action", "g{k}", "wp_ajax_nopriv_do{m}", 4), _edge("calls", "<module>", "add_action", 4),
    _edge("triggers_action", "<module>", "fire{m}", 5), _edge("calls", "<module>", "do_action", 5), _edge("triggers_filter", "<module>", "flt{m}", 6), _edge("calls", "<module>", "apply_filters", 6), _edge("registers_shortcode", "g{k}", "[sc{m}]", 7), _edge("calls", "<module>", "add_shortcode", 7),
))
def extract_php_hooks(t: Tables) -> DataFrame:
    return _extracted(t, "h{k}.php", "<?php\nfunction g{k}() {}\nadd_filter(\"the_title\", [$this, \"title{m}\"]);\nadd_action('wp_ajax_nopriv_do{m}', 'g{k}');\ndo_action('fire{m}', 1);\napply_filters('flt{m}', 1);\nadd_shortcode('sc{m}', 'g{k}');\n")


@_query(_expected(
    "e{k}.xaml", _node("page", "N.P{k}", 1, 10), _node("resource", "N.P{k}.k{m}", 3), _node("named_element", "N.P{k}.l{m}", 5), _edge("binding", "e{k}.xaml", "User.Name{m}", 5), _edge("resource_ref", "e{k}.xaml", "s{m}", 5),
    _edge("template_binding", "e{k}.xaml", "Bg{m}", 6), _edge("resource_ref", "e{k}.xaml", "d{m}", 6), _edge("event_handler", "e{k}.xaml", "N.P{k}.Done{m}", 7), _edge("binding", "e{k}.xaml", "Go{m}", 7), _edge("command", "e{k}.xaml", "Go{m}", 7),
))
def extract_xaml_bindings(t: Tables) -> DataFrame:
    return _extracted(t, "e{k}.xaml", '<ContentPage xmlns="u" xmlns:x="http://schemas.microsoft.com/winfx/2009/xaml" x:Class="N.P{k}">\n<ContentPage.Resources>\n<Color x:Key="k{m}">Red</Color>\n</ContentPage.Resources>\n<Label Name="l{m}" Text="{Binding Path=User.Name{m}, Mode=OneWay}" Style="{StaticResource s{m}}"/>\n<Border Background="{TemplateBinding Bg{m}}" Foreground="{DynamicResource d{m}}">\n<Entry Completed="Done{m}" Command="{Binding Go{m}}"/>\n</Border>\n</ContentPage>\n')


# --- frame names ---


@_query("""with p as (select p_partkey as k, p_partkey % 8 as c, (p_partkey % 90 + 1)::int as l from part)
select k, case c when 0 then 'python' when 1 then 'python' when 2 then 'javascript' when 3 then 'javascript' when 4 then 'javascript' when 5 then 'dotnet' when 6 then 'dotnet' else 'unknown' end as language,
case c when 0 then 'run' when 1 then 'load_' || k when 2 then 'go' when 3 then 'bar' when 4 then '<anonymous>' when 5 then 'Add' when 6 then 'Method' else 'plainname' || k end as function_name,
case c when 3 then 'Foo' when 5 then 'List' when 6 then 'Inner' || k end as class_name,
case c when 0 then 'pkg/m' || k || '.py' when 2 then 'src/h' || k || '.js' when 4 then 'a/b.js' end as file_path,
case when c in (0, 2, 4) then l end as line_number, case c when 2 then 5 when 4 then 9 end::int as "column" from p""")
def frame_languages(t: Tables) -> DataFrame:
    k, line = F.col("p_partkey").cast("string"), (F.col("p_partkey") % 90 + 1).cast("int").cast("string")
    c = F.pmod("p_partkey", F.lit(8))
    shapes = [
        ("pkg/m", k, ".py:", line, "(run)"), ("load_", k), ("go (src/h", k, ".js:", line, ":5)"), ("Foo.prototype.bar",), ("a/b.js:", line, ":9"), ("System.Collections.List`1.Add",), ("My.App.Outer+Inner", k, ".Method"), ("plainname", k),
    ]
    name = F.coalesce(*[F.when(c == i, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in shape])) for i, shape in enumerate(shapes)])
    return frames.normalise(t.read("part").select(F.col("p_partkey").alias("k"), name.alias("name"))).select("k", "language", "function_name", "class_name", "file_path", "line_number", "column")


# --- matching: for each part a node f<k> in class C<k> of file m<k>, and a frame that finds it in one of six ways ---


@_query("""select p_partkey as name, 'n' || p_partkey as symbol_id, case p_partkey % 6 when 0 then 0.95 when 1 then 0.9 when 2 then 0.85 when 3 then 0.85 when 4 then 0.8 else 0.7 end::double as confidence,
case p_partkey % 6 when 0 then 'Location match' when 1 then 'Qualified name match' when 2 then 'Qualified name suffix match' when 3 then 'Name and file match' when 4 then 'Name and class match' else 'Unique name match' end as match_reason from part""")
def match_ways(t: Tables) -> DataFrame:
    p = t.read("part").select(F.col("p_partkey").alias("k"))
    k, way = F.col("k").cast("string"), F.pmod("k", F.lit(6))
    name, file = F.concat(F.lit("f"), k), F.concat(F.lit("m"), k)
    nodes = p.select(F.concat(F.lit("n"), k).alias("id"), F.lit("r").alias("repo_path"), file.alias("file_path"), name.alias("name"), F.concat(F.lit("app.C"), k, F.lit("."), name).alias("qualified_name"), F.lit(10).alias("start_line"), F.lit(20).alias("end_line"), F.col("k").alias("seq"))
    null = lambda kind="string": F.lit(None).cast(kind)
    given = {"file_path": F.when(way.isin(0, 3), file), "line_number": F.when(way == 0, F.lit(15)), "qualified_name": F.when(way == 1, F.concat(F.lit("app.C"), k, F.lit("."), name)).when(way == 2, F.concat(F.lit("C"), k, F.lit("."), name)), "class_name": F.when(way == 4, F.concat(F.lit("C"), k)), "function_name": name, "language": F.lit("unknown"), "namespace": null(), "column": null("int"), "metadata": null()}
    found = p.select(F.col("k").alias("name"), *[given[c].alias(c) for c in frames.FIELDS])
    return correlate.match_frames(found, nodes, "r")


# --- resolution: files x<k>.py and y<k>.py, with the extractors' rows for them ---

_ROWS = "file_path string, record string, ordinal int, node_type string, name string, qualified_name string, source_name string, target_name string, edge_type string, target_module string, start_line int"


def _two_files(t: Tables) -> DataFrame:
    """In x: first (line 1), which calls late (only in y), y's own (by module) and what y has too; on top a call of first. In y: late, own and shared."""
    k = F.col("p_partkey").cast("string")
    x, y = F.concat(F.lit("x"), k, F.lit(".py")), F.concat(F.lit("y"), k, F.lit(".py"))
    null = lambda: F.lit(None).cast("string")
    named = lambda n: F.concat(F.lit(n), k)
    node = lambda f, i, n, line: F.struct(f.alias("file_path"), F.lit("node").alias("record"), F.lit(i).alias("ordinal"), F.lit("function").alias("node_type"), named(n).alias("name"), F.concat(F.lit("K."), named(n)).alias("qualified_name"), null().alias("source_name"), null().alias("target_name"), null().alias("edge_type"), null().alias("target_module"), F.lit(line).alias("start_line"))
    edge = lambda i, s, n, module: F.struct(x.alias("file_path"), F.lit("edge").alias("record"), F.lit(i).alias("ordinal"), null().alias("node_type"), null().alias("name"), null().alias("qualified_name"), s.alias("source_name"), named(n).alias("target_name"), F.lit("calls").alias("edge_type"), module.alias("target_module"), F.lit(i).alias("start_line"))
    first, top = named("first"), F.lit(resolve.MODULE)
    every = [node(x, 0, "first", 1), node(x, 1, "shared", 5), edge(2, first, "late", null()), edge(3, first, "shared", null()), edge(4, first, "shared", F.concat(F.lit("y"), k)), edge(5, top, "first", null()), edge(6, first, "nothing", null()), node(y, 0, "late", 1), node(y, 1, "shared", 3)]
    rows = t.read("part").select(F.explode(F.array(*every)).alias("r")).select("r.*")
    for c in ("signature", "docstring", "metadata"):
        rows = rows.withColumn(c, null())
    for c in ("start_column", "end_line", "end_column"):
        rows = rows.withColumn(c, F.col("start_line"))
    return rows


def _resolved(t: Tables, visibility: str) -> DataFrame:
    rows = _two_files(t)
    edges = resolve.edge_rows(resolve.resolve_edges(resolve.nodes_of(rows, "r"), resolve.edges_of(rows), visibility))
    return edges.select("source_id", "target_id", F.col("location_start_line").alias("line"))


_FULL = """with p as (select p_partkey::varchar as k from part), i as (select k, 'r/x' || k || '.py:' as x, 'r/y' || k || '.py:' as y from p)
{own} select x || 'first' || k || ':1' as source_id, x || 'shared' || k || ':5' as target_id, 3::int as line from i
union all {module}
union all select x || 'x' || k || ':1', x || 'first' || k || ':1', 5::int from i"""


@_query(_FULL.format(own="select x || 'first' || k || ':1' as source_id, y || 'late' || k || ':1' as target_id, 2::int as line from i union all", module="select x || 'first' || k || ':1', y || 'shared' || k || ':3', 4::int from i"))
def resolve_by_module(t: Tables) -> DataFrame:
    return _resolved(t, "full")


@_query(_FULL.format(own="", module="select x || 'first' || k || ':1', x || 'shared' || k || ':5', 4::int from i"))
def resolve_sequentially(t: Tables) -> DataFrame:
    """Files are seen up to the edge's own, in order of path, so that nothing of y is."""
    return _resolved(t, "sequential")


# --- evented profiles: a profile a part, by the automaton that ingest uses ---


@_query("""with p as (select p_partkey as k, (p_partkey % 50 + 1)::double as u from part)
select k || '.json - calls' as profile_name, 'boot' as name, 6 * u as self_weight, 10 * u as total_weight, 1::bigint as call_count, 60.0::double as self_percentage from p
union all select k || '.json - calls', 'walk', 4 * u, 5 * u, 2::bigint, 40.0 from p
union all select k || '.json - calls', 'stray', 0.0, 0.0, 0::bigint, 0.0 from p
union all select k || '.json - calls', 'open', 0.0, 0.0, 1::bigint, 0.0 from p""")
def evented_nested(t: Tables) -> DataFrame:
    """boot 0 to 10; in it walk 2 to 6 with itself inside 3 to 4; closes of stray and boot that aren't open are left out; open stays open."""
    u = (F.col("p_partkey") % 50 + 1).cast("double")
    event = lambda kind, frame, at: F.struct(F.lit(kind).alias("type"), F.lit(frame).alias("frame"), (u * at).alias("at"))
    events = F.array(event("O", 0, 0), event("O", 1, 2), event("O", 1, 3), event("C", 1, 4), event("C", 2, 5), event("C", 1, 6), event("C", 0, 10), event("O", 3, 10), event("C", 0, 12))
    profile = F.struct(F.lit("evented").alias("type"), F.lit("calls").alias("name"), F.lit(0.0).alias("startValue"), (u * 10).alias("endValue"), events.alias("events"))
    names = F.array(*[F.struct(F.lit(n).alias("name")) for n in ("boot", "walk", "stray", "open")])
    texts = t.read("part").select(F.concat(F.col("p_partkey").cast("string"), F.lit(".json")).alias("source_file"), F.to_json(F.struct(F.struct(names.alias("frames")).alias("shared"), F.array(profile).alias("profiles"))).alias("json"))
    bronze = profiles.bronze_profiles(profiles.checked(profiles.parse_speedscope(texts)))
    return profiles.function_stats(bronze, profile_name=True).select("profile_name", "name", "self_weight", "total_weight", "call_count", "self_percentage")


# --- sources ---


@_query("select file_path, file_path like '%/STANDARD/%' or file_path like 'Brand#2%' or contains('/' || file_path, '/SMALL') or (file_path like '%/ECONOMY/%' and file_path like '%E.py') as out from (select distinct p_brand || '/' || p_type || '/' || p_partkey || p_type || '.py' as file_path from part union select distinct p_brand || '/' || p_type || '/SMALL' from part)")
def exclude_rules_of_paths(t: Tables) -> DataFrame:
    """The rules that indexing runs, over paths."""
    p = t.read("part")
    kind = F.col("p_type")
    paths = p.select(F.concat_ws("/", "p_brand", kind, F.concat(F.col("p_partkey").cast("string"), kind, F.lit(".py"))).alias("file_path")).union(p.select(F.concat_ws("/", "p_brand", kind, F.lit("SMALL")))).distinct()

    def run(parts):
        rules = exclude_rules(["**/STANDARD/**", "Brand#2/**", "**/SMALL", "ECONOMY/*E.py"])
        for part in parts:
            yield pd.DataFrame({"file_path": part["file_path"], "out": [rules("/r", x) for x in part["file_path"]]})

    return paths.mapInPandas(run, "file_path string, out boolean")
