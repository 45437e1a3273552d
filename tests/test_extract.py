"""Extractors: snippets of each language, and what they must yield."""

import json
import time

import pytest
from pyspark.sql import functions as F

from stratagraph.sources.extract import default_registry, extract_files, records
from stratagraph.sources.extract.base import Tokens
from stratagraph.sources.extract.python_source import absolute_module

REGISTRY = default_registry()


def found(path: str, text: str):
    rows = list(records(REGISTRY, path, text.encode()))
    nodes = {(r["node_type"], r["qualified_name"]): r for r in rows if r["record"] == "node"}
    edges = {(r["edge_type"], r["source_name"], r["target_name"]): r for r in rows if r["record"] == "edge"}
    return nodes, edges, [r["message"] for r in rows if r["record"] == "error"]


PY = '''"""A module."""
import os
import a.b as ab
from ..pkg import helper as h, other
from util import *

LIMIT, SIZE = 1, 2

@deco(1)
async def run(x: int, *rest, k=2) -> str:
    """Runs."""
    h(x)
    ab.go()
    os.path.join("a")
    def inner():
        other()

class Base(ab.Root, metaclass=M):
    """Base."""
    def one(self):
        self.two()
        unknown.call()
    if True:
        def two(self): pass

if LIMIT:
    def late(): pass
'''


def test_python():
    nodes, edges, errors = found("proj/app/sub/mod.py", PY)
    assert not errors
    run = nodes["function", "run"]
    assert run["signature"] == "async def run(x: int, *rest, k=2) -> str" and run["docstring"] == "Runs."
    assert json.loads(run["metadata"]) == {"decorators": ["deco(1)"], "async": True}
    assert ("method", "Base.one") in nodes and ("method", "Base.two") in nodes and ("function", "late") in nodes
    assert ("function", "run.inner") not in nodes
    assert {n for k, n in nodes if k == "variable"} == {"LIMIT", "SIZE"}
    assert nodes["import", "proj.app.pkg.helper"]["name"] == "h" and ("import", "util.*") in nodes
    assert edges["calls", "run", "helper"]["target_module"] == "proj.app.pkg"
    assert edges["calls", "run", "go"]["target_module"] == "a.b"
    assert edges["calls", "run", "path.join"]["target_module"] == "os"
    assert ("calls", "run.inner", "other") in edges
    assert json.loads(edges["calls", "Base.one", "two"]["metadata"])["same_class_call"]
    assert ("calls", "Base.one", "unknown.call") in edges
    assert edges["inherits", "Base", "Root"]["target_module"] == "a.b"
    assert ("imports", "<module>", "proj.app.pkg.other") in edges


def test_python_syntax_error_keeps_the_rest():
    nodes, _, errors = found("x.py", "def good():\n    pass\n\ndef bad(:\n    pass\n\nclass C:\n    def m(self): pass\n")
    assert errors and ("function", "good") in nodes and ("method", "C.m") in nodes


def test_relative_imports():
    assert absolute_module("src/a/b/c.py", 1, "d") == "a.b.d"
    assert absolute_module("src/a/b/c.py", 2, None) == "a"


CS = """using System.Text;
using static System.Math;
namespace Shop.Core
{
    /// <summary>Sells.</summary>
    [Serializable]
    public partial class Seller<T> : Person, ISeller where T : class
    {
        private readonly int count = 3, total;
        public string Name { get; set; }
        public int Twice => count * 2;
        public Seller(int c) { Init(c); }
        public async Task<int> SellAsync(string what, int n = 1)
        {
            if (n > 0) { await store.Save(what); }
            return Count<int>(n);
        }
        public event Handler Sold;
    }
    public interface ISeller { void Sell(); }
    public enum Mood { Good, Bad = 2 }
    public record Point(int X, int Y);
    public struct Size { public int W; }
}
"""


def test_csharp():
    nodes, edges, errors = found("a.cs", CS)
    assert not errors
    seller = nodes["class", "Shop.Core.Seller"]
    meta = json.loads(seller["metadata"])
    assert meta["bases"] == ["Person", "ISeller"] and meta["partial"] and meta["attributes"] == ["Serializable"] and meta["type_parameters"] == ["T"]
    assert nodes["method", "Shop.Core.Seller.SellAsync"]["signature"] == "async Task<int> SellAsync(string what, int n = 1)"
    for key in [("constructor", "Shop.Core.Seller.Seller"), ("property", "Shop.Core.Seller.Name"), ("property", "Shop.Core.Seller.Twice"), ("field", "Shop.Core.Seller.count"), ("field", "Shop.Core.Seller.total"), ("event", "Shop.Core.Seller.Sold"), ("interface", "Shop.Core.ISeller"), ("method", "Shop.Core.ISeller.Sell"), ("enum", "Shop.Core.Mood"), ("record", "Shop.Core.Point"), ("struct", "Shop.Core.Size"), ("namespace", "Shop.Core"), ("import", "System.Text"), ("import", "System.Math")]:
        assert key in nodes, key
    assert json.loads(nodes["enum", "Shop.Core.Mood"]["metadata"])["members"] == ["Good", "Bad"]
    assert ("inherits", "Shop.Core.Seller", "Person") in edges and ("implements", "Shop.Core.Seller", "ISeller") in edges
    assert ("calls", "Seller.SellAsync", "store.Save") in edges and ("calls", "Seller.SellAsync", "Count<int>") in edges
    assert ("calls", "Seller.Seller", "Init") in edges and not any(t == "if" for _, _, t in edges)


GO = """// Package shop sells.
package shop

import (
\t"fmt"
\tstr "strings"
\t_ "embed"
)

const Max, min = 10, 1

// Seller sells.
type Seller struct {
\tName string `json:"name"`
\t*Base
}

type Store interface {
\tSave(x int) error
\tio.Reader
}

type ID = int

// Sell sells.
func (s *Seller) Sell(n int, what string) (int, error) {
\tfmt.Println(str.ToUpper(what))
\ts.note(n)
\treturn n, nil
}

func note(n int) bool { return helper(n) }
"""


def test_go():
    nodes, edges, errors = found("a.go", GO)
    assert not errors
    sell = nodes["method", "shop.Seller.Sell"]
    assert sell["docstring"] == "Sell sells." and json.loads(sell["metadata"])["receiver"] == {"name": "s", "type": "Seller", "pointer": True}
    fields = json.loads(nodes["struct", "shop.Seller"]["metadata"])["fields"]
    assert fields[0] == {"name": "Name", "type": "string", "embedded": False, "tag": 'json:"name"'} and fields[1]["embedded"]
    meta = json.loads(nodes["interface", "shop.Store"]["metadata"])
    assert meta["methods"] == ["Save(x int) error"] and meta["embeds"] == ["io.Reader"]
    for key in [("package", "shop"), ("import", "fmt"), ("constant", "shop.Max"), ("constant", "shop.min"), ("type", "shop.ID"), ("function", "shop.note")]:
        assert key in nodes, key
    assert nodes["import", "strings"]["name"] == "str"
    assert edges["calls", "Seller.Sell", "Println"]["target_module"] == "fmt" and edges["calls", "Seller.Sell", "ToUpper"]["target_module"] == "strings"
    assert ("calls", "Seller.Sell", "s.note") in edges and ("calls", "note", "helper") in edges


PHP = r"""<?php
namespace App\Shop;

use Lib\Base;
use Lib\Tools\{Saw, Hammer as H};

/** Sells. */
abstract class Seller extends Base implements Sells {
    use Logs;
    const MAX = 3;
    private ?string $name = 'x';
    public function sell(int $n): bool {
        $this->note($n);
        self::check();
        H::hit($n);
        return other_fn($n);
    }
}
interface Sells extends Trades {}
trait Logs { protected static function note($x) {} }
function boot() { do_action('booted'); return apply_filters('limit', 3); }
add_action('init', 'boot');
add_action('wp_ajax_nopriv_save', array($this, 'save_it'));
add_filter('the_title', [$obj, 'title']);
add_shortcode('price', 'show_price');
"""


def test_php():
    nodes, edges, errors = found("a.php", PHP)
    assert not errors
    seller = nodes["class", "App\\Shop\\Seller"]
    meta = json.loads(seller["metadata"])
    assert meta["base_class"] == "Lib\\Base" and meta["traits"] == ["Logs"] and meta["modifiers"] == ["abstract"] and seller["docstring"] == "Sells."
    for key in [("method", "App\\Shop\\Seller::sell"), ("property", "App\\Shop\\Seller::$name"), ("constant", "App\\Shop\\Seller::MAX"), ("interface", "App\\Shop\\Sells"), ("trait", "App\\Shop\\Logs"), ("function", "App\\Shop\\boot"), ("import", "Lib\\Tools\\Hammer")]:
        assert key in nodes, key
    assert nodes["method", "App\\Shop\\Seller::sell"]["signature"] == "function sell(int $n): bool"
    assert ("calls", "Seller::sell", "Lib\\Tools\\Hammer::hit") in edges and ("calls", "Seller::sell", "other_fn") in edges
    assert json.loads(edges["calls", "Seller::sell", "note"]["metadata"])["same_class_call"]
    assert ("triggers_action", "boot", "booted") in edges and ("triggers_filter", "boot", "limit") in edges
    assert ("registers_action", "boot", "init") in edges and ("registers_filter", "title", "the_title") in edges
    assert json.loads(edges["registers_action", "save_it", "wp_ajax_nopriv_save"]["metadata"])["nopriv"]
    assert ("registers_shortcode", "show_price", "[price]") in edges
    assert ("inherits", "App\\Shop\\Seller", "Lib\\Base") in edges and ("extends", "App\\Shop\\Sells", "Trades") in edges and ("uses_trait", "App\\Shop\\Seller", "Logs") in edges


XAML = """<ContentPage xmlns="http://xamarin.com/schemas/2014/forms" xmlns:x="http://schemas.microsoft.com/winfx/2006/xaml" x:Class="App.MainPage" Appearing="OnShow">
  <ContentPage.Resources><Style x:Key="Big" TargetType="Label"/></ContentPage.Resources>
  <Label x:Name="title" Text="{Binding Title, Mode=OneWay}" Style="{StaticResource Big}"/>
  <Button Clicked="OnClick" Command="{Binding Path=SaveCommand}"/>
</ContentPage>
"""


def test_xaml():
    nodes, edges, errors = found("views/MainPage.xaml", XAML)
    assert not errors
    assert ("page", "App.MainPage") in nodes and ("named_element", "App.MainPage.title") in nodes and ("resource", "App.MainPage.Big") in nodes
    src = "MainPage.xaml"
    for key in [("event_handler", src, "App.MainPage.OnShow"), ("event_handler", src, "App.MainPage.OnClick"), ("binding", src, "Title"), ("binding", src, "SaveCommand"), ("command", src, "SaveCommand"), ("resource_ref", src, "Big")]:
        assert key in edges, key
    assert found("x.xaml", "<a><b></a>")[2][0].startswith("XML parse error")


def test_registry_and_errors():
    assert REGISTRY.for_file("x.PY").language == "python" and "go" in REGISTRY and len(REGISTRY) == 5
    assert [r["message"] for r in records(REGISTRY, "x.zig", b"")] == ["no extractor for this extension"]
    assert "UTF-8" in [r["message"] for r in records(REGISTRY, "x.py", b"\xff\xfe")][0]
    for path in ("x.py", "x.cs", "x.go", "x.php"):
        assert not list(records(REGISTRY, path, b""))


def test_python_with_many_faults():
    """Old syntax on very many lines costs a parse of its function each, and the rest is found."""
    import time

    from stratagraph.sources.extract.python_source import PythonExtractor

    text = "".join(f"def f{k}(x):\n    y = g{k}(x)\n    print 'old', x\n    return y\n\n" for k in range(800))
    began = time.perf_counter()
    found = list(PythonExtractor().extract("a.py", text))
    assert time.perf_counter() - began < 20
    assert sum(r["record"] == "node" for r in found) == 800 and sum(r.get("edge_type") == "calls" for r in found) == 800
    assert [r["record"] for r in found].count("error") == 1


def test_python_deep_expressions_and_written_signatures():
    from stratagraph.sources.extract.python_source import PythonExtractor

    deep = "x = " + ".a".join(["f()"] + ["b()"] * 0) + "".join(f".m{k}()" for k in range(700)) + "\n"
    found = list(PythonExtractor().extract("a.py", deep + "def g(a : int=1,\n      *b , c = 'x)'): pass\n"))
    assert any(r.get("target_name") == "f" for r in found)
    assert [r["signature"] for r in found if r.get("name") == "g"] == ["def g(a : int=1,\n      *b , c = 'x)')"]


def test_shared_registry():
    from stratagraph.sources import extract

    class Toml(extract.Extractor):
        language, extensions = "toml-test", (".toml-test",)

    extract.register(Toml())
    try:
        assert extract.extractor_of("toml-test") is extract.extractor_for_file("a/b.TOML-test") is extract.shared_registry().get("toml-test")
        assert extract.extractor_for_file("a.none") is None and extract.extractor_of("none") is None
        with pytest.raises(ValueError):
            extract.register(Toml())
    finally:
        extract.shared_registry().unregister("toml-test")


def test_language_of():
    from stratagraph.sources.extract import default_registry
    from stratagraph.sources.repo import language_of

    assert [language_of(p, default_registry()) for p in ("a.PY", "b.go", "c.xaml", "d.tsx")] == ["python", "go", "xaml", "typescript"]
    for path in ("a.unknown", "Makefile"):
        with pytest.raises(ValueError):
            language_of(path, default_registry())


def test_files_of_one_partition_are_dealt_out(spark):
    """A table of short rows is read by one task; the extraction must not be."""
    files = spark.range(400).coalesce(1).select(F.concat(F.lit("f"), F.col("id").cast("string"), F.lit(".go")).alias("file_path"), F.encode(F.lit("package p\nfunc F() { g() }\n"), "UTF-8").alias("content"))
    rows = extract_files(files, REGISTRY).withColumn("task", F.spark_partition_id())
    tasks = {r["task"]: r["n"] for r in rows.where("record = 'file'").groupBy("task").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sum(tasks.values()) == 400 and len(tasks) >= 8 and max(tasks.values()) < 100


def test_columns_of_long_lines_with_wide_characters():
    """Columns are bytes, and a line costs what its length is, not the square of it."""
    text = "/* ü */ é(); 'ß' + b()\n" + "é(a);" * 40_000 + "\nx"
    began = time.perf_counter()
    tokens = Tokens(text, [("comment", r"/\*.*?\*/"), ("skip", r"\s+"), ("string", r"'[^']*'"), ("word", r"\w+"), ("op", r"[^\s\w]")])
    assert time.perf_counter() - began < 5
    lines = text.split("\n")
    for t in [*tokens.tokens[:40], *tokens.tokens[-40:]]:
        before = sum(len(x) + 1 for x in lines[: t.line - 1])
        assert t.column == len(text[before : t.start].encode())
