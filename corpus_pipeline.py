"""A training corpus from raw documents: five stages, each written before the next.

Language ID drops what has no language; line dedup takes out lines that many
documents share; SimHash near-dedup keeps one document of each group;
decontamination drops documents with benchmark passages; mixing repeats or
drops documents so that sources come to their target weights.

A stage takes ``(spark, docs, sf_dir)``, works on all that its predecessor
kept and returns a frame with the columns of ``docs``; the last adds ``copy``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratagraph.llm.decontaminate import decontaminate
from stratagraph.llm.language_id import keep_identified, learn
from stratagraph.llm.line_dedup import line_dedup
from stratagraph.llm.mixture import mix
from stratagraph.llm.simhash import drop_near_copies
from stratagraph.scratch import discard, materialise, scope


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; null texts and texts without letters go."""
    return keep_identified(docs, learn(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts without lines that three documents share; ``n_chars`` follows the text."""
    out = line_dedup(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target wants it; ``copy`` counts from 0."""
    return mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_languages),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_documents),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: SQL can express neither the language model nor the fingerprints; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared folder and read again; only the last one's table stays there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scope() as kept:
            done = materialise(stage(spark, docs, sf_dir), name)
            kept.append(done)
        discard(docs)  # what the stage before wrote
        docs = done
    return docs
