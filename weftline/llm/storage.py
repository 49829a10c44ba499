"""Where intermediate tables go, and how rows go through Python: both within bounds."""

from __future__ import annotations

import ctypes
import gc
import pickle
import tempfile
import uuid

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder where it is unset in local mode, as in tests.

    ValueError where it is unset on a cluster, whose executors share no local folder.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        given = "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.checkpoint.dir", given)
    return given.rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables and archives of this application."""
    return f"{shared_dir(spark)}/weftline/{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Delete all intermediate tables and archives of this application; results not yet computed from them are lost."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(session_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back.

    Lineage ends here: a lost executor costs a read, not a recomputation, and
    every later use sees the same rows.
    """
    spark = df.sparkSession
    path = f"{session_dir(spark)}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` has returned; nothing may be computed from it any more."""
    spark = df.sparkSession
    own = session_dir(spark).split(":", 1)[-1].lstrip("/")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if own in folder:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows and bytes of one Arrow batch, on both sides of the pipe to Python.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20
M_MMAP_THRESHOLD, M_TRIM_THRESHOLD = -3, -1  # of mallopt() in the C library


def give_back() -> None:
    """Return what this Python process has freed to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def arrow_map(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with batches of bounded size, whose task gives back all its memory.

    Python workers live on from task to task and stage to stage. What one task
    has freed would stay with its worker: garbage in cycles, Arrow's pool and the
    C heap are therefore emptied at its end, and large arrays are mapped one by
    one, so that freeing them returns their pages. The batch limits are lowered
    for the session, never raised.
    """
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = int(conf.get(f"spark.sql.execution.arrow.{name}").rstrip("b"))
        if now <= 0 or now > most:
            conf.set(f"spark.sql.execution.arrow.{name}", str(most))

    def lean(batches):
        libc = ctypes.CDLL(None)
        if hasattr(libc, "mallopt"):
            libc.mallopt(M_MMAP_THRESHOLD, 4 << 20)
            libc.mallopt(M_TRIM_THRESHOLD, 64 << 20)
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(lean, schema)


class Shared:
    """A broadcast value that brings its classes along; each task loads it once."""

    def __init__(self, spark: SparkSession, value) -> None:
        self._sent, self._held = spark.sparkContext.broadcast(cloudpickle.dumps(value)), None

    @property
    def value(self):
        if self._held is None:
            self._held = pickle.loads(self._sent.value)
        return self._held
