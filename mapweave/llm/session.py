"""What every operator here needs from the session: shared checkpoints and shippable functions."""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text handed to a Python worker at once; with long texts this bounds the worker's memory.
TEXTS_PER_BATCH = 1000
#: Shuffle partitions whose results make one file where results are few beside what a task reads.
SHARE = 8
#: Copies of a table that ``attached`` deals, so that rows of one key go to as many tasks.
SALTS = 8

cloudpickle.register_pickle_by_value(sys.modules[__name__.partition(".")[0]])


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers receive; Spark has this as a setting of the session only."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXTS_PER_BATCH)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where none is set and all runs in one process."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder, so that lineage ends and lost executors cost nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Like ``checkpointed``, as a table of its own whose statistics are those of its files.

    A checkpoint keeps the size that was estimated for its plan; over the joins of a loop such estimates multiply.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def gathered(df: DataFrame) -> DataFrame:
    """The rows dealt to ``fewer`` partitions, for results that are few beside what their tasks read."""
    return df.repartition(fewer(df.sparkSession))


def fewer(spark: SparkSession) -> int:
    """One partition for every ``SHARE`` of the session: they grow with the input as those do, and are files that hold more.

    Without its native library Hadoop starts a process (``chmod``) for each file, checksum and folder that a task writes to a
    local disk. For a moment that process counts with the whole memory of the executor that starts it.
    """
    return max(1, shuffle_partitions(spark) // SHARE)


def stable(df: DataFrame) -> DataFrame:
    """The rows such that several reads give the same ones in the same order: of files or a checkpoint as they are, else checkpointed."""
    lines = df._jdf.queryExecution().analyzed().toString().splitlines()
    nodes = {re.sub(r"^[\s:+-]*", "", line).split(" ")[0].split("[")[0] for line in lines if line.strip()}
    return df if nodes <= {"Project", "Filter", "Relation", "SubqueryAlias", "View", "LogicalRDD", "LocalRelation"} else checkpointed(df)


def attached(rows: DataFrame, table: DataFrame, on: list[str], salt_by: str, how: str = "left") -> DataFrame:
    """``rows`` joined with a table that has each key once; many rows of one key are dealt to ``SALTS`` tasks."""
    salt = unused("salt", rows, table)
    dealt = rows.withColumn(salt, F.pmod(F.xxhash64(salt_by, F.lit("salt")), F.lit(SALTS)).cast("int"))
    copies = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies, [*on, salt], how).drop(salt)


def unused(name: str, *frames: DataFrame) -> str:
    """A column name, ``name`` or like it, that none of the tables has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def unused_prefix(prefix: str, df: DataFrame) -> str:
    """A prefix, ``prefix`` or like it, that no column's name begins with, whatever underscores stand before it."""
    while any(c.lower().lstrip("_").startswith(prefix.lower()) for c in df.columns):
        prefix = f"x{prefix}"
    return prefix


def release() -> None:
    """Give what a block of work needed back to the system: a worker that waits for its next task counts against its executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text as UTF-8 bytes: other columns, whatever their names, never reach a worker."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
