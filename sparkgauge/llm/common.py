"""What the operators share: reading tables, cutting lineage, naming and dropping rows, numbering rows without gaps."""

from __future__ import annotations

import atexit
import contextvars
import ctypes
import functools
import gc
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_OWN: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []
_SCOPE: contextvars.ContextVar[list | None] = contextvars.ContextVar("sparkgauge_tables", default=None)

#: Rows and bytes in an Arrow batch at most: texts and sets are long, and a batch is held more than once on its way.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: Bits of a Spark bitmap, and bitmaps of row numbers (4 KB each) that are broadcast at most.
BITMAP_BITS, BROADCAST_BITMAPS = 32768, 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def worker_cache(owner: str) -> dict:
    """What a Python worker keeps from task to task, for one operator at a time."""
    kept = sys.modules.setdefault("_sparkgauge_kept", types.ModuleType("_sparkgauge_kept")).__dict__
    if kept.get("owner") != owner:
        kept.clear()
        kept["owner"] = owner
        give_back()
    return kept


def give_back() -> None:
    """Hand freed memory to the system. A Python worker lives as long as its executor, so what one task has freed would count
    against the next ones."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def frugal(run: Callable) -> Callable:
    """A function over Arrow batches that gives memory back when its task ends."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that isn't set, a temporary one on a single machine; on a cluster, whose
    executors don't share such a folder, an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if "dir" not in _OWN:
            _OWN["dir"] = "file://" + tempfile.mkdtemp(prefix="sparkgauge-")
        folder = _OWN["dir"]
    return folder.rstrip("/")


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def own_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted like the tables that cut() writes."""
    entry = (spark, f"{shared_folder(spark)}/sparkgauge/{name}-{uuid.uuid4().hex}")
    _WRITTEN.append(entry)
    if (scope := _SCOPE.get()) is not None:
        scope.append(entry)
    return entry[1]


def cut(df: DataFrame, name: str, rows: int = BATCH_ROWS) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: later steps start from the files, not from its plan.

    While it is written, batches hold ``rows`` rows at most; its shuffle files go as soon as it is there."""
    spark = df.sparkSession
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.parquet.columnarReaderBatchSize": rows}
    wanted["spark.sql.execution.arrow.maxBytesPerBatch"] = BATCH_BYTES
    wanted["spark.sql.classic.shuffleDependency.fileCleanup.enabled"] = True
    path = own_folder(spark, name)
    with _settings(spark, {k: str(v).lower() for k, v in wanted.items()}):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(entry: tuple[SparkSession, str]) -> None:
    spark, path = entry
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _WRITTEN.remove(entry)


def settled(name: str) -> Callable:
    """For a function that returns a DataFrame: its result is written, and what the function cut on the way is deleted."""

    def around(function: Callable) -> Callable:
        @functools.wraps(function)
        def run(*args, **kwargs) -> DataFrame:
            outer, own = _SCOPE.get(), []
            token = _SCOPE.set(own)
            try:
                found = cut(function(*args, **kwargs), name)
                kept = own.pop()
            finally:
                _SCOPE.reset(token)
                for entry in own:
                    _delete(entry)
            if outer is not None:
                outer.append(kept)
            return found

        return run

    return around


@atexit.register
def clear_tables() -> None:
    """Delete the tables that cut() wrote. Results that still read them can't be evaluated afterwards."""
    while _WRITTEN:
        try:
            _delete(_WRITTEN[-1])
        except Exception:  # the session may be gone; what is left is in the shared folder
            return


def small_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A DataFrame of a few numbers or nulls, made by SQL so that no Python runs on the executors."""
    fields = [f.split() for f in schema.split(",")]
    if not rows:
        return spark.sql("SELECT " + ", ".join(f"CAST(NULL AS {t}) AS {n}" for n, t in fields) + " WHERE false")
    value = lambda v: "NULL" if v is None else repr(v) + "D" * isinstance(v, float)
    told = ", ".join("(" + ", ".join(map(value, r)) + ")" for r in rows)
    table = spark.sql(f"SELECT * FROM VALUES {told} AS t({', '.join(n for n, _ in fields)})")
    return table.select(*[table[n].cast(t) for n, t in fields])


def _is_table(df: DataFrame) -> bool:
    """Whether ``df`` is a scan of Parquet files, narrowed by columns and filters at most."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().apply(0)
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    return plan.relation().fileFormat().getClass().getSimpleName() == "ParquetFileFormat"


def located(df: DataFrame) -> tuple[DataFrame, Column, Column]:
    """(df, file, row): ``df`` as a table, and two columns that say which row of which of its files a row is.

    They belong to the stored rows, so they are the same in every scan, however it is split, ordered or repeated after a
    lost executor. What isn't a plain Parquet table is written as one first. A file is known by a 64-bit hash of its path.
    """
    if not _is_table(df):
        df = cut(df, "rows")
    place = df.metadataColumn("_metadata")
    return df, F.xxhash64(place["file_path"]), place["row_index"]


def without_rows(df: DataFrame, file: Column, row: Column, gone: DataFrame, broadcast: int = BROADCAST_BITMAPS) -> DataFrame:
    """The rows of ``df`` whose place (columns that located() gave) isn't in ``gone`` (file, row); no column is moved, as
    the places that go come as a bitmap of 4 KB for each 32768 rows of a file. Beyond ``broadcast`` bitmaps they are joined."""
    part = F.floor(F.col("row") / BITMAP_BITS)
    maps = gone.groupBy(F.col("file").alias("_gone_file"), part.alias("_gone_part")).agg(F.bitmap_construct_agg(F.col("row") % BITMAP_BITS).alias("_gone"))
    maps = cut(maps, "gone")
    maps = F.broadcast(maps) if maps.count() <= broadcast else maps
    names = df.columns
    marked = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), file.alias("_file"), row.alias("_row"))
    met = marked.join(maps, (F.col("_file") == F.col("_gone_file")) & (F.floor(F.col("_row") / BITMAP_BITS) == F.col("_gone_part")), "left")
    return met.filter(~bit_of("_gone", F.col("_row") % BITMAP_BITS)).select("row.*")


def bit_of(bitmap: str, spot: Column) -> Column:
    """Whether the bit is set in a bitmap that bitmap_construct_agg() made; not in a null one."""
    byte = F.conv(F.hex(F.substring(F.col(bitmap), (spot / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.call_function("shiftright", byte, (spot % 8).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))


def numbered(df: DataFrame, by: list[str], order: list[Column], name: str, spread: Column, buckets: int) -> DataFrame:
    """``df`` with the column ``name``: 0, 1, 2, ... without gaps within each ``by``.

    Rows of a ``by`` are dealt to ``buckets`` buckets by ``spread``; each bucket is numbered by itself and starts after
    the counts of those before it. No task holds a whole ``by``, however many rows it has. The counts are a table of
    (groups x buckets) rows, which are joined, not collected.
    """
    dealt = df.withColumn("_bucket", F.pmod(spread, F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    before = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*by, "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    within = W.partitionBy(*by, "_bucket").orderBy(*order)
    ranked = dealt.withColumn("_nth", F.row_number().over(within))
    joined = ranked.join(starts, [*by, "_bucket"])
    return joined.withColumn(name, (F.col("_start") + F.col("_nth") - 1).cast("long")).drop("_bucket", "_rows", "_start", "_nth")
