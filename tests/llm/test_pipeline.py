"""The pipeline's stages against brute force, each on its own input."""

import pytest

import corpus_pipeline as cp
from stratagraph.llm import line_dedup, mixture, simhash

from .test_operators import brute_fingerprint, brute_hits, groups

AT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    out = [spark.read.parquet(f"{AT}/documents.parquet")]
    for _, stage in cp.STAGES:
        out.append(spark.createDataFrame((df := stage(spark, out[-1], AT)).collect(), df.schema))
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns(stages):
    for s in stages[1:-1]:
        assert s.columns == stages[0].columns
    assert stages[-1].columns == [*stages[0].columns, "copy"]


def test_language(stages):
    a, b = rows(stages[0]), rows(stages[1])
    assert set(b) == {i for i, r in a.items() if any(c.isalpha() for c in r["text"] or "")}


def test_lines(stages):
    a, b = rows(stages[1]), rows(stages[2])
    assert set(a) == set(b) and all(r["n_chars"] == len(r["text"] or "") for r in b.values())
    again = line_dedup.line_dedup(stages[1], stats=("n1", "n2")).collect()
    assert {r["doc_id"]: r["text"] for r in again} == {i: r["text"] for i, r in b.items()}


def test_one_of_each_group(stages):
    a, b = rows(stages[2]), rows(stages[3])
    ids = sorted(a)
    fps = [brute_fingerprint(a[i]["text"]) for i in ids]
    root = groups([(i, j) for i in range(len(ids)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3], len(ids))
    assert set(b) == {ids[c] for c in set(root)}


def test_decontaminated(spark, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{AT}/benchmark.parquet").collect()]
    a, b = rows(stages[3]), rows(stages[4])
    assert set(b) == {i for i, r in a.items() if not brute_hits(r["text"], items)[1]} and len(b) < len(a)


def test_mixed(stages):
    plan = {r["doc_id"]: r["copies"] for r in mixture.plan_mixture(stages[4]).collect()}
    got: dict = {}
    for r in stages[5].collect():
        got.setdefault(r["doc_id"], []).append(r["copy"])
    assert {i: len(c) for i, c in got.items()} == {i: n for i, n in plan.items() if n} and all(sorted(c) == list(range(len(c))) for c in got.values())


def test_run_equals_stages(spark, stages):
    got = sorted((r["doc_id"], r["copy"], r["text"]) for r in cp.run(spark, AT).collect())
    assert got == sorted((r["doc_id"], r["copy"], r["text"]) for r in stages[5].collect())
    assert simhash.BLOCKS * simhash.WIDTH == 64
