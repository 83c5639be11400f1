"""What the operators share: tables, the shared scratch folder, model files."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import hashlib
import inspect
import os
import shutil
import tempfile
import uuid
import zipfile
from contextvars import ContextVar

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Parquet's vectored reads of local files take direct buffers as large as a column's part of a file, outside of the JVM's
#: heap, and the threads that read keep them.
_VECTORED = "parquet.hadoop.vectored.io.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.option(_VECTORED, "false").parquet(f"{sf_dir}/{name}.parquet")


def _folder() -> str:
    """A folder of the driver's own, for files that it serves to executors; gone when the driver ends."""
    path = os.path.realpath(tempfile.mkdtemp(prefix="gapline-"))
    atexit.register(shutil.rmtree, path, True)
    return path


def importable(spark: SparkSession) -> None:
    """Serves this package to Python workers, which import it wherever they were started."""
    context = spark.sparkContext
    if any(os.path.basename(x).startswith("gapline-code") for x in context._python_includes):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(_folder(), "gapline-code.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, files in os.walk(os.path.join(root, "gapline")):
            for name in sorted(files):
                if name.endswith(".py"):
                    out.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), root))
    context.addPyFile(path)


def without(df: DataFrame, names: set[str], *kept: str) -> DataFrame:
    """df without the columns that an operator is about to add under the same names; its own inputs stay."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c in kept or c.lower() not in names])


def lower_ascii(column):
    """Lower-cases A-Z and nothing else."""
    return F.translate(column, _UPPER, _LOWER)


def word_count(text):
    """Number of words `[^\\x20\\x09-\\x0D]+`, as long; 0 for null."""
    # each word becomes one character, with the white space after it
    marks = F.regexp_replace(F.ltrim(text, F.lit(" \t\n\x0b\x0c\r")), "[^\\x20\\x09-\\x0D]++[\\x20\\x09-\\x0D]*+", "x")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def crc_fold(doc_id, modulus: int):
    """crc32 of the id as text, modulo `modulus`; null ids give null."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(modulus))


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share. Where it is unset, a folder of this machine
    will do for a local session (tests); on a cluster it is an error."""
    importable(spark)
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{_folder()}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base}/llm-{uuid.uuid4().hex}"
    atexit.register(_gone, spark, path)
    return path


def _gone(spark: SparkSession, path: str) -> None:
    try:
        drop(spark, path)
    except Exception:  # noqa: BLE001 - the session may be gone already; then its owner clears the shared folder
        pass


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a written table."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, codec: str = "zstd") -> tuple[DataFrame, str]:
    """Writes `df` to the shared folder and reads it again: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark)
    # the table holds the result: the shuffle files of the write are of no more use
    cleanup, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", None
    try:
        before = spark.conf.get(cleanup)
        spark.conf.set(cleanup, "true")
        df.write.option("compression", codec).parquet(path)
    finally:
        if before is not None:
            spark.conf.set(cleanup, before)
    if _SCOPE.get() is not None:
        _SCOPE.get().append(path)
    return spark.read.schema(df.schema).option(_VECTORED, "false").parquet(path), path


#: Bytes of an Arrow batch at most (a row at least). Spark's own 64 MB, or 10,000 rows, come to buffers of twice that in the
#: JVM, outside of its heap, and as much in a Python worker, for each task.
BATCH = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of `BATCH` bytes at most, and plain reads of Parquet files, in what this session plans from now on."""
    spark.conf.set(_BATCH, BATCH)
    spark.conf.set(_VECTORED, "false")


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of `BATCH` bytes at most, and plain reads of Parquet files, in what runs meanwhile."""
    before = {k: spark.conf.get(k, None) for k in (_BATCH, _VECTORED)}
    bound_batches(spark)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


#: The tables written since the innermost `tidied` began.
_SCOPE: ContextVar[list[str] | None] = ContextVar("tables", default=None)


def tidied(spark: SparkSession, make) -> tuple[DataFrame, str]:
    """What `make` returns, as a written table; every other table that was written for it is dropped."""
    tables: list[str] = []
    token, path = _SCOPE.set(tables), None
    try:
        out, path = written(make())
    finally:
        _SCOPE.reset(token)
        for used in tables:
            if used != path:
                drop(spark, used)
    if _SCOPE.get() is not None:
        _SCOPE.get().append(path)
    return out, path


def ship(spark: SparkSession, data: bytes, kind: str, max_bytes: int = 1 << 30) -> str:
    """Hands a file of proven size to every executor (each fetches it once) and returns its name for `local_file`."""
    importable(spark)
    if len(data) > max_bytes:
        raise ValueError(f"{kind}: {len(data)} bytes exceed the bound of {max_bytes} for a file on every executor")
    name = f"{kind}-{hashlib.sha1(data).hexdigest()[:16]}.bin"
    # the name carries the digest of the content, so a file that was added before is the same file
    if not any(str(x).endswith(f"/{name}") for x in spark.sparkContext.listFiles):
        path = os.path.join(_folder(), name)
        with open(path, "wb") as out:
            out.write(data)
        spark.sparkContext.addFile(path)
    return name


def lean(task):
    """A function for Python workers, or a generator of batches, that gives freed memory back to the machine at its end:
    workers stay for the next task, beside others."""

    def trim() -> None:
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not the C library that has it
            pass

    if inspect.isgeneratorfunction(task):

        @functools.wraps(task)
        def batches(given):
            yield from task(given)
            trim()

        return batches

    @functools.wraps(task)
    def whole(given):
        out = task(given)
        trim()
        return out

    return whole


@contextlib.contextmanager
def settled():
    """While it lasts, freed memory stays with the process: work that takes the same arrays again and again does not get
    fresh pages each time. `lean` gives it back at the task's end."""
    try:
        mallopt = ctypes.CDLL(None).mallopt
    except (AttributeError, OSError):  # not the C library that has it
        yield
        return
    trim, mapped = -1, -3  # M_TRIM_THRESHOLD, M_MMAP_THRESHOLD
    mallopt(mapped, 32 << 20)
    mallopt(trim, 1 << 30)
    try:
        yield
    finally:
        mallopt(mapped, 128 << 10)
        mallopt(trim, 128 << 10)


def learned(rows: DataFrame, learn, least: bytes = b"") -> bytes:
    """What `learn` makes of the Arrow batches of `rows`, a sample of proven size, in one task of an executor; `least` if
    there are no rows."""
    importable(rows.sparkSession)

    @lean
    def task(batches):
        yield pa.RecordBatch.from_arrays([pa.array([learn(batches)], pa.binary())], ["model"])

    made = rows.mapInArrow(task, "model binary").collect()  # a row a task that had rows
    return bytes(made[0][0]) if made else least


def local_file(name: str) -> str:
    """The path of a shipped file on this executor."""
    return SparkFiles.get(name)
