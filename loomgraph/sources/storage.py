"""Tables that cut lineage: written once to the folder that driver and executors share, and read again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of our own only where that is unset and there is one machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="loomgraph-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return f"file://{_own[app]}"


def cut(df: DataFrame) -> DataFrame:
    """df as a written table: later rounds of a loop read it instead of repeating what led to it."""
    path = f"{shared_dir(df.sparkSession)}/loomgraph/loop-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


class Grown:
    """A table that grows by written parts; a part is written once, however many come after it."""

    def __init__(self, first: DataFrame):
        self.parts = [cut(first)]

    @property
    def last(self) -> DataFrame:
        return self.parts[-1]

    def add(self, df: DataFrame) -> bool:
        """Writes a part; whether it has any row."""
        self.parts.append(cut(df))
        return self.last.limit(1).count() > 0

    @property
    def df(self) -> DataFrame:
        return self.last.sparkSession.read.schema(self.last.schema).parquet(*(p._cut_at for p in self.parts))


def drop(*tables: DataFrame) -> None:
    """Deletes tables of cut() that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_cut_at", None)
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
