"""Intermediate tables in the folder that the cluster shares.

The folder is ``spark.checkpoint.dir``.  Only in local mode, where driver and
executors are one process, is a temporary one made if the session has none.
"""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F


#: Tasks for each core that rows are dealt out to where Python takes long for each.
TASKS_A_CORE = 3

#: Tables written and not yet deleted, by the scope that is open, the innermost last.
_open: list[dict[str, DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """Return the shared folder; a cluster must have set one (RuntimeError), since others don't see a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="stratagraph-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    The result's lineage is the written table, so a lost executor costs only
    the tasks that it was running.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    if _open:
        _open[-1][path] = out
    return out


def discard(df: DataFrame) -> None:
    """Delete the table behind a frame that ``materialise`` returned."""
    path = getattr(df, "_scratch_path", None)
    if path:
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
        for scope in _open:
            scope.pop(path, None)


@contextlib.contextmanager
def scope() -> Iterator[list[DataFrame]]:
    """Deletes at its end all tables that were written inside, but for frames that are put into the list."""
    made, kept = {}, []
    _open.append(made)
    try:
        yield kept
    finally:
        _open.remove(made)
        stay = {getattr(x, "_scratch_path", None) for x in kept}
        for path, df in list(made.items()):
            if path not in stay:
                discard(df)
            elif _open:
                _open[-1][path] = df


def spread_out(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt out by ``key`` to all cores: what Spark reads a table by are its bytes, which say nothing of how long a row takes."""
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_A_CORE * spark.sparkContext.defaultParallelism)
    return rows.repartition(tasks, key)


def numbered(rows: DataFrame, name: str, after: int = 0) -> DataFrame:
    """``rows`` with consecutive numbers from ``after + 1``, in the order of sorted rows.

    Rows are written with their partition and their place in it, partitions
    are counted, and each row's number follows from the sums of the counts;
    no task sees more than its own partition.
    """
    tagged = rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() % F.lit(1 << 33))
    tagged = materialise(tagged, "numbered")
    starts, total = [], after
    for r in tagged.groupBy("_part").count().orderBy("_part").collect():  # a row for each partition
        starts.append((r["_part"], total + 1))
        total += r["count"]
    first = rows.sparkSession.createDataFrame(starts, "_part int, _first long")
    both = tagged.join(F.broadcast(first), "_part")  # as many rows as partitions
    return both.withColumn(name, F.col("_first") + F.col("_at")).drop("_part", "_at", "_first")
