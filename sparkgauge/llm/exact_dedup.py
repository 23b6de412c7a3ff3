"""Exact dedup by progressive refinement, in DataFrame operations only.

Rows are grouped by length, the survivors by length and the hash of a prefix, and only what survives that too has its
full text hashed. Between the rounds a bitmap of fixed size carries which keys occurred more than once; it may let a
lone row through (which costs one more hash, never a wrong group) but never stops a row that has a partner. No text
moves between executors: groups are told by hash and by the places of their rows, and the rows that go are dropped where
they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgauge.llm.common import BITMAP_BITS as _PER_BITMAP
from sparkgauge.llm.common import bit_of, cut, located, settled, table, without_rows

#: Bits in the bitmap of surviving keys: 2^24 bits, 2 MB, whatever the input's size.
FILTER_BITS = 24


def _occurs_twice(keyed: DataFrame, key: str, bits: int = FILTER_BITS) -> DataFrame:
    """The bitmap of the keys that occur in two rows or more."""
    return _occurs_once(keyed.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), key, bits)


def _occurs_once(keyed: DataFrame, key: str, bits: int = FILTER_BITS) -> DataFrame:
    """(part, bitmap): the bits on which the keys fall. At most 2^bits / 32768 rows."""
    spots = keyed.select(F.pmod(F.col(key), F.lit(1 << bits)).alias("bit")).distinct()
    return spots.groupBy(F.floor(F.col("bit") / _PER_BITMAP).cast("int").alias("_part")).agg(
        F.bitmap_construct_agg(F.col("bit") % _PER_BITMAP).alias("_bitmap")
    )


def _with_flag(rows: DataFrame, key: Column, twice: DataFrame, flag: str, bits: int = FILTER_BITS) -> DataFrame:
    """``rows`` with ``flag``: whether the bit of ``key`` is set. The bitmap has a fixed size, so it is broadcast."""
    bit = F.pmod(key, F.lit(1 << bits))
    marked = rows.withColumn("_part", F.floor(bit / _PER_BITMAP).cast("int")).join(F.broadcast(twice), "_part", "left")
    return marked.withColumn(flag, bit_of("_bitmap", bit % _PER_BITMAP)).drop("_part", "_bitmap")


def _hashed(docs: DataFrame, place: Column, id_col: str, text_col: str, prefix_chars: int, bits: int, carried: list[str]) -> DataFrame:
    """(row, _id, _at, _full): each row's columns ``carried``, id and place, and the hash of its text if another may have it."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row") if carried else F.lit(None).alias("row"),
        F.col(id_col).alias("_id"),
        place.alias("_at"),
        text.alias("_text"),
        F.xxhash64(F.octet_length(text)).alias("_length_key"),
    )
    by_length = _occurs_twice(rows.select("_length_key"), "_length_key", bits)
    rows = _with_flag(rows, F.col("_length_key"), by_length, "_length_twice", bits)
    prefix = F.xxhash64(F.octet_length("_text"), F.substring("_text", 1, prefix_chars))
    rows = rows.withColumn("_prefix_key", F.when(F.col("_length_twice"), prefix))
    by_prefix = _occurs_twice(rows.filter("_prefix_key is not null").select("_prefix_key"), "_prefix_key", bits)
    rows = _with_flag(rows, F.coalesce("_prefix_key", F.lit(0)), by_prefix, "_prefix_twice", bits)
    full = F.when(F.col("_length_twice") & F.col("_prefix_twice"), F.unhex(F.sha2(F.encode("_text", "UTF-8"), 256)))
    return rows.select("row", "_id", "_at", full.alias("_full"))


def _groups(rows: DataFrame) -> DataFrame:
    """(_key, _keep, _size): of each text that was hashed, the id and place of the row that stays, and how many have it."""
    groups = rows.filter("_full is not null").groupBy("_full").agg(F.max(F.struct("_id", "_at")).alias("_keep"), F.count(F.lit(1)).alias("_size"))
    # The joins' key is made anew on both sides, so that each is a plain exchange, whose hot partitions Spark can split.
    return groups.select(F.hex("_full").alias("_key"), "_keep", "_size")


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64, bits: int = FILTER_BITS
) -> DataFrame:
    """One row per row of ``docs``: ``row`` (a struct of all its columns), ``keep_id``, ``group_size``, ``kept``.

    A group is the rows whose texts are identical (a null text counts as empty), however long; its row with the largest id
    stays. Null ids come last: they stay only in a group without another id. Rows that repeat both id and text are told
    apart by where they are stored, so exactly one row of a group has ``kept``. Any further columns, whatever their names,
    are left alone. An empty table gives an empty one.
    """
    names = docs.columns
    docs, file, place = located(docs)
    rows = _hashed(docs, F.struct(file.alias("file"), place.alias("row")), id_col, text_col, prefix_chars, bits, names)
    # A row that dropped out on the way is alone: its key is its own place, which no group has.
    own = F.concat(F.lit("@"), F.col("_at.file"), F.lit(":"), F.col("_at.row"))
    found = rows.withColumn("_key", F.coalesce(F.hex("_full"), own)).join(_groups(rows), "_key", "left")
    return found.select(
        "row",
        F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_keep._id")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("_keep._at") == F.col("_at"), F.lit(True)).alias("kept"),
    )


@settled("unique")
def _copies(docs: DataFrame, place: Column, id_col: str, text_col: str, prefix_chars: int, bits: int) -> DataFrame:
    """(file, row): the places of the rows that exact_groups() doesn't keep."""
    rows = cut(_hashed(docs, place, id_col, text_col, prefix_chars, bits, []).filter("_full is not null").drop("row"), "hashed")
    met = rows.withColumn("_key", F.hex("_full")).join(_groups(rows).filter("_size > 1"), "_key")
    return met.filter(F.col("_keep._at") != F.col("_at")).select("_at.file", "_at.row")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64, bits: int = FILTER_BITS) -> DataFrame:
    """``docs`` without the rows that exact_groups() doesn't keep; same columns. Only hashes and places are shuffled.

    Null texts are like empty ones, so one row of both stays; of rows with the largest id, or of rows that all have a null one, it is
    the one stored last. An empty table gives an empty one."""
    docs, file, row = located(docs)
    gone = _copies(docs, F.struct(file.alias("file"), row.alias("row")), id_col, text_col, prefix_chars, bits)
    return without_rows(docs, file, row, gone)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sha = F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)
    found = exact_groups(docs.select("doc_id", "text", sha.alias("text_sha256")))
    return found.select(F.col("row.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("row.text_sha256").alias("text_sha256"))


OP9_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
