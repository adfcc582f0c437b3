"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a context, so that it need not be installed on the executors."""
    sc = spark.sparkContext
    if getattr(sc, "_tavla_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="tavla-"), "tavla.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.join("tavla", os.path.relpath(path, root)))
    sc.addPyFile(archive)
    sc._tavla_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the scan is lazy, so Catalyst still prunes and pushes down."""
    ship(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster.

    ``spark.checkpoint.dir`` of the session wins. Only where neither it nor the context names a
    folder (local tests) a temporary one is set.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if named:
        sc.setCheckpointDir(named)
        return named
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="tavla-checkpoint-")
    sc.setCheckpointDir(made)
    return made


def cut(df: DataFrame, **measured: Column) -> DataFrame:
    """Write ``df`` as a table into the shared checkpoint folder and read it back: the lineage is forgotten, the
    files outlive any executor, and the planner knows the real size, where checkpoint() would keep multiplying the
    estimates of iterated joins. The files go when the session ends, or earlier by :func:`discard`.

    ``measured`` are aggregates of the rows taken while they are written; :func:`seen` has their values.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tavla-{uuid.uuid4().hex}"
    df, count = seen_while(df, **measured)
    df.write.parquet(path)
    fs, p = _file_system(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._tavla_path = path
    out._tavla_seen = count
    return out


def seen_while(df: DataFrame, **measured: Column) -> tuple[DataFrame, Callable[[str], int]]:
    """``df`` that takes aggregates of its rows while an action runs over it, and a function that gives them afterwards."""
    if not measured:
        return df, lambda name: 0
    observation = Observation()
    return df.observe(observation, *[c.alias(k) for k, c in measured.items()]), lambda name: observation.get.get(name) or 0


def seen(df: DataFrame, name: str) -> int:
    """A count that :func:`cut` took while it wrote; of a plan that the optimizer knew to be empty it is zero."""
    return df._tavla_seen(name)


def discard(df: DataFrame) -> None:
    """Delete the files of a :func:`cut` table that no later plan reads."""
    path = getattr(df, "_tavla_path", None)
    if path:
        fs, p = _file_system(df.sparkSession, path)
        fs.delete(p, True)


def _file_system(spark: SparkSession, path: str) -> tuple:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p
