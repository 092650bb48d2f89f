"""What the operators share: the shared folder, written intermediate tables, worker-side caches, word splitting."""

from __future__ import annotations

import ctypes
import functools
import sys
import types
import uuid

from pyspark.sql import DataFrame, SparkSession

from loomgraph.sources.storage import shared_dir

#: Caches of worker_cache() that are large.
LARGE = frozenset({"codecs"})


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/loomgraph/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once and written to the shared folder, so that a lost executor costs a read and not a recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_written_at", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def unused(df: DataFrame, name: str) -> str:
    """A column name like name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def freed(run, *uses: str):
    """run, a function over batches, around which the worker hands unused memory back to the system, as it outlives its stage:
    before it the LARGE caches that run doesn't use, which another operator has left; after it what run has freed."""

    def trimmed():
        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # only glibc has it
            pass

    @functools.wraps(run)
    def out(batches):
        if left := LARGE.difference(uses) & worker_cache().keys():
            for name in left:
                del worker_cache()[name]
            trimmed()
        yield from run(batches)
        trimmed()

    return out


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, whichever task runs in it."""
    return sys.modules.setdefault("_loomgraph_worker", types.ModuleType("_loomgraph_worker")).__dict__


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
