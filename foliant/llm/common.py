"""Helpers shared by the corpus operators: cutting lineage, the word rule, stable hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The contract's white space, for Java, Python and DuckDB patterns alike.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_BYTES = b" \t\n\x0b\x0c\r"


#: Bounds of an Arrow batch on its way to a Python worker. A batch is held by both sides, several times over while it grows, and long texts make large rows.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def small_batches(spark: SparkSession) -> None:
    """Set the session's bounds of Arrow batches, where they are unset."""
    for name, most in BATCH.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, most)


def lean(run):
    """run over batches, after which the worker, which waits for other tasks, gives the memory that it no longer uses back to the machine."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
                pool.release_unused()

    return task


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset and all run on one machine."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not (sc.master or "").startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="foliant-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: later stages no longer depend on executors' shuffle files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/foliant-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(cut_off: DataFrame) -> None:
    """Delete a table that cut() wrote and that nothing will read again."""
    jvm, conf = cut_off.sparkSession._jvm, cut_off.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rpartition("/")[0] for f in cut_off.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if path.getName().startswith("foliant-"):
            path.getFileSystem(conf).delete(path, True)


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (public constants of MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def spare(name: str, *frames: DataFrame) -> str:
    """The name, with underscores before it until no frame has such a column (in any case)."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
