"""The shared folder, intermediate tables and files that every executor can reach.

Everything that outlives one Spark job is written below the application's checkpoint folder, which the cluster
names in ``spark.checkpoint.dir``; a local folder is set only where that setting is absent and the master is local, as
in tests.  A table written there also cuts the lineage: a lost executor costs the tasks of one stage, not a
recomputation from the source.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shipping


#: Settings that a session keeps if it has chosen its own: rows here are whole documents, so batches are bounded by bytes.
BOUNDS = {"spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4m"), "spark.sql.parquet.columnarReaderBatchSize": ("4096", "512")}


def ship(spark: SparkSession) -> None:
    """Make the package known to the executors' Python workers, and bound the batches that rows travel in."""
    shipping.ship(spark)
    for name, (default, bound) in BOUNDS.items():
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, bound)


def shared_root(spark: SparkSession) -> str:
    """URI of a folder that the driver and all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tidemark-shared-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the shared folder; nothing is created yet."""
    return f"{shared_root(spark)}/tidemark/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and return the table read back."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


#: Columns that together name a row of a table.
ROW = ("__tidemark_file", "__tidemark_row")


def _is_scan(docs: DataFrame) -> bool:
    """Whether each row of ``docs`` is one row of a file: a scan, perhaps projected and filtered."""
    node = docs._jdf.queryExecution().analyzed()
    while not node.children().isEmpty():
        if node.nodeName() not in ("Project", "Filter", "SubqueryAlias"):
            return False
        node = node.children().head()
    return node.nodeName() == "LogicalRelation" and not node.metadataOutput().isEmpty() and "_metadata" not in docs.columns


def with_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with the two long columns ``ROW``, which differ between any two rows, equal ones too.

    A table that is scanned from files names its rows by file and place, at no cost.  Any other is written to the shared
    folder with numbers, so that the numbers stay what they are however often the table is read.
    """
    if _is_scan(docs):
        return docs.select("*", F.xxhash64("_metadata.file_path").alias(ROW[0]), F.col("_metadata.row_index").alias(ROW[1]))
    return stage(docs.select("*", F.lit(0).cast("long").alias(ROW[0]), F.monotonically_increasing_id().alias(ROW[1])), "rows")


def only_rows(keyed: DataFrame, chosen: DataFrame, columns: list[str], how: str = "left_semi") -> DataFrame:
    """``columns`` of the rows of ``keyed`` that ``chosen (ROW)`` names, or with ``left_anti`` of the others."""
    return keyed.join(chosen.select(*ROW), list(ROW), how).select(*(keyed[c] for c in columns))


def open_filesystem(uri: str):
    """The Arrow filesystem and the path in it for a URI such as ``file:/x``, ``hdfs://h/x`` or ``/x``."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), os.path.abspath(uri)
    return fs.FileSystem.from_uri(uri)


def shuffle_width(spark: SparkSession) -> int:
    """Number of shuffle partitions that the session is configured for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
