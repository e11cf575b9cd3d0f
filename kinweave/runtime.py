"""Session-level helpers shared by all operators: reading tables, cutting lineage, and joins that survive hot keys."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: str | None = None

#: A key is hot when it alone holds more than this many rows; see ``join_hot``.
HOT_ROWS = 50_000
#: At most this many hot keys are ever broadcast (they are the keys over ``rows / MAX_HOT_KEYS``).
MAX_HOT_KEYS = 2_000


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One parquet table of a data directory; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``; only where it is unset (tests), a temporary one, removed at exit."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    global _own_folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="kinweave-")
        atexit.register(shutil.rmtree, _own_folder, ignore_errors=True)
    return f"file://{_own_folder}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table into the shared folder and go on from there.

    That survives lost executors, keeps plans short, stops filters from being pushed into costly expressions, and gives the planner true sizes,
    where a checkpoint would multiply estimated ones from round to round.
    """
    path = f"{shared_folder(df.sparkSession)}/kinweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kinweave_path = path
    return out


def _file(spark: SparkSession, path: str):
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any file system; nothing happens if it isn't there."""
    fs, p = _file(spark, path)
    fs.delete(p, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file into any file system."""
    fs, p = _file(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def file_state(spark: SparkSession, path: str) -> list | None:
    """Length and time of change of a file, or of every file of a folder in order of their names; None if it isn't there."""
    fs, p = _file(spark, path)
    if not path or not fs.exists(p):
        return None
    return sorted([f.getPath().getName(), f.getLen(), f.getModificationTime()] for f in fs.listStatus(p))


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, or None if it isn't there."""
    fs, p = _file(spark, path)
    return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(fs.open(p), "UTF-8") if fs.exists(p) else None


def release(*tables: DataFrame | None) -> None:
    """Delete tables that ``cut`` wrote and nothing reads any more."""
    for df in tables:
        path = getattr(df, "_kinweave_path", None)
        if path:
            delete(df.sparkSession, path)


def parallelism(spark: SparkSession) -> int:
    """Number of tasks that keep every core busy a few times over, independent of the data."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """Over as many partitions as keep all cores busy, for steps that cost much per row: by bytes, small tables would get a single task."""
    return df.repartition(parallelism(df.sparkSession))


def norm_text(column: Column | str) -> Column:
    """Upper-cased, trimmed, with null as ''."""
    c = F.col(column) if isinstance(column, str) else column
    return F.upper(F.trim(F.coalesce(c, F.lit(""))))


def dedup_latest(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per ``key``: the one with the greatest ``order`` columns (nulls lowest). Rows with a null key are dropped.

    ``max_by`` over a struct aggregates on the map side, so repeated deliveries of one key never meet as rows in one task.
    """
    rest = [c for c in df.columns if c != key]
    rank = F.struct(*[F.col(c) for c in order], F.xxhash64(*[F.col(c) for c in rest]))
    picked = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), rank).alias("_row"))
    return picked.select(key, *[F.col("_row")[c].alias(c) for c in rest])


def hot_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys holding more than ``max(hot_rows, rows / MAX_HOT_KEYS)`` rows; by construction at most MAX_HOT_KEYS of them."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = df.count()
    return counts.where(F.col("_n") > max(hot_rows, total // MAX_HOT_KEYS)).select(key)


def join_hot(large: DataFrame, small: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Inner join of ``large`` with ``small`` (unique on ``key``): hot keys by broadcast (bounded, see hot_keys), the rest by shuffle."""
    hot_small = small.join(F.broadcast(hot), key, "left_semi")
    cold = large.join(F.broadcast(hot), key, "left_anti").join(small, key)
    return large.join(F.broadcast(hot_small), key).unionByName(cold)


def plain_strings(pdf: pd.DataFrame) -> pd.DataFrame:
    """String columns as Python objects: chunked Arrow strings of pandas can't go back to Spark."""
    return pdf.astype({c: object for c in pdf.columns if pd.api.types.is_string_dtype(pdf[c].dtype) and pdf[c].dtype != object})
