"""Session helpers: scratch storage every executor can see, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes up to which a side counts as small enough to send to every executor.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20
_written: list[DataFrame] = []


def scratch(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where that is unset, a local one, but only if Spark runs in this process; on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that every executor sees")
        at = f"file://{tempfile.gettempdir()}/lexiquarry-scratch"
        spark.conf.set("spark.checkpoint.dir", at)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def materialise(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back, which cuts its lineage.

    A lost executor then costs a re-read, not a recomputation. The path is kept on the frame for :func:`discard`.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    _written.append(out)
    return out


def _place(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def exists(spark: SparkSession, path: str) -> bool:
    at, system = _place(spark, path)
    return system.exists(at)


def listing(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder."""
    at, system = _place(spark, path)
    return sorted(x.getPath().toString() for x in system.listStatus(at))


def delete(spark: SparkSession, path: str) -> None:
    at, system = _place(spark, path)
    system.delete(at, True)


def rename(spark: SparkSession, path: str, to: str) -> bool:
    """Move a finished folder to where readers look for it; False if one is there already."""
    at, system = _place(spark, path)
    end = _place(spark, to)[0]
    return not system.exists(end) and system.rename(at, end)


def discard(df: DataFrame) -> None:
    """Delete a table that :func:`materialise` wrote; only for tables nothing unread depends on."""
    path = getattr(df, "_scratch_path", None)
    if path:
        delete(df.sparkSession, path)


def state(df: DataFrame) -> str:
    """A name for what a table's files hold now: it changes with any file's path, size or time of change. No column is read."""
    files = df.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("n"), F.col("_metadata.file_modification_time").cast("double").alias("t")).distinct()
    n, x, s = files.agg(F.count("*"), F.bit_xor(F.xxhash64("p", "n", "t")), F.sum(F.xxhash64("t", "n", "p").cast("decimal(38,0)"))).first()
    return f"{n}-{(x or 0) & (1 << 64) - 1:x}-{int(s or 0) & (1 << 64) - 1:x}"


def sweep(spark: SparkSession) -> None:
    """Delete every table that :func:`materialise` wrote in this process; call it when no result that rests on one is still to be read."""
    while _written:
        df = _written.pop()
        if df.sparkSession is spark:
            discard(df)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it holds at most ``rows`` rows and ``size`` bytes, else as it is, for a shuffled join.

    ``df`` is read up to the bound on rows, so pass a materialised or cheap frame.
    """
    wide = [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c, k in df.dtypes if k == "string" or k == "binary" or k.startswith(("array", "map", "struct"))]
    each = sum(wide, F.lit(8 * len(df.columns)))
    n, held = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(each), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and held <= size else df


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete a finished query's shuffle files; what later steps need is written by :func:`materialise`."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
