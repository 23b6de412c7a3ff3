"""Benchmark decontamination by winnowing, in DataFrame operations only.

Of the k-gram hashes of a text, the smallest in each sliding window of w is kept, with its place. With k + w - 1 = 10 every
span of ten words that a document shares with an item has a kept hash at the same place of the span on both sides. Kept
hashes are joined, and each match is extended word by word, up to w - 1 words to either side, so a hit is decided by the
words themselves and never by a hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgauge.llm.common import located, settled, table, without_rows

#: Words in a window, in a hashed k-gram, and k-grams in a sliding window: K + REACH = WINDOW.
WINDOW, K = 10, 5
REACH = WINDOW - K
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word is a run of characters outside this class (after A-Z have been lower-cased).
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The place of a k-gram in the low bits, 35 bits of its hash above.
PLACE_BITS = 28
#: Bytes of the items' kept hashes with the words around them up to which they are broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 64 << 20


def words_of(text: Column) -> Column:
    split = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAPS, -1)
    return F.filter(split, lambda w: w != "")


def _grams(words: Column, n: Column, size: int) -> Column:
    """Hash and place of each ``size``-gram in one long, in order of place."""

    def coded(i: Column) -> Column:
        h = F.xxhash64(*[F.get(words, i + j) for j in range(size)])
        return F.shiftleft(F.shiftrightunsigned(h, 64 - 35), PLACE_BITS).bitwiseOR(i.cast("long"))

    return F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), coded)).otherwise(F.array().cast("array<bigint>"))


def _fingerprints(rows: DataFrame, short: list[int]) -> DataFrame:
    """``rows`` (with ``words``) with ``size``, ``hash`` and ``place``: a row for each kept k-gram (size WINDOW) of a text
    of WINDOW words or more and for each gram of the ``short`` sizes. Texts without any have no row."""
    n = F.size("words")
    codes = rows.withColumn("_grams", _grams(F.col("words"), n, K))
    least = F.transform(
        F.sequence(F.lit(0), n - WINDOW), lambda i: F.least(*[F.get("_grams", i + j) for j in range(REACH + 1)])
    )
    codes = codes.withColumn("_least", F.when(n >= WINDOW, least).otherwise(F.array().cast("array<bigint>")))
    kept = F.filter("_least", lambda x, i: (i == 0) | (F.get("_least", i - 1) != x))

    def tagged(size: int, grams: Column) -> Column:
        return F.transform(grams, lambda g: F.struct(F.lit(size).alias("size"), g.alias("code")))

    every = [tagged(WINDOW, kept), *[tagged(s, _grams(F.col("words"), n, s)) for s in short]]
    found = codes.withColumn("_print", F.explode(F.concat(*every) if short else every[0])).drop("_grams", "_least")
    return found.select(
        *rows.columns,
        F.col("_print.size").alias("size"),
        F.shiftright("_print.code", PLACE_BITS).alias("hash"),
        F.col("_print.code").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int").alias("place"),
    )


def _sliced(rows: DataFrame) -> DataFrame:
    """``rows`` with the words that an extension may look at instead of all (``base`` of them are before), ``place`` in them."""
    base = F.greatest(F.col("place") - REACH, F.lit(0))
    rows = rows.withColumn("base", base).withColumn("words", F.slice("words", F.col("base") + 1, WINDOW + REACH))
    return rows.withColumn("place", F.col("place") - F.col("base"))


def _run(step: int) -> Column:
    """How many words in a row agree beyond the k-gram, up to REACH: leftwards (step -1) or rightwards (step 1)."""
    count = F.lit(0)
    for j in reversed(range(REACH)):
        off = -1 - j if step < 0 else K + j
        same = F.get("words", F.col("place") + off) == F.get("item_words", F.col("item_place") + off)
        count = F.when(same, 1 + count).otherwise(0)
    return count


def hits(docs: DataFrame, items: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(at, item_id, start, end): the spans of words (end exclusive) of ``docs`` (at, words) that lie in occurrences of a
    window of ``items`` (item_id, words). Spans of a row overlap or repeat; together they cover all hit words."""
    size = F.size("words")
    items = items.filter(size > 0)
    short = sorted(r[0] for r in items.filter(size < WINDOW).select(size).distinct().collect())  # at most nine
    prints = _sliced(_fingerprints(items.filter(size >= WINDOW), [])).drop("base")
    for s in short:
        few = items.filter(size == s)
        grams = _grams(F.col("words"), size, s)
        prints = prints.unionByName(few.select("item_id", "words", F.lit(s).alias("size"), F.shiftright(F.get(grams, F.lit(0)), PLACE_BITS).alias("hash"), F.lit(0).alias("place")))
    prints = prints.withColumnsRenamed({"words": "item_words", "place": "item_place"})
    rows = _fingerprints(docs, short)
    weight = F.coalesce(F.sum(F.octet_length(F.array_join("item_words", " ")) + F.lit(16 * (WINDOW + REACH) + 100)), F.lit(0))
    if prints.agg(weight.alias("bytes")).first()["bytes"] <= broadcast_bytes:
        met = rows.join(F.broadcast(prints), ["size", "hash"]).withColumn("base", F.lit(0))
    else:  # each row takes along the words that the extension looks at, not its whole text
        met = _sliced(rows).join(prints, ["size", "hash"])
    met = met.withColumn("_left", _run(-1)).withColumn("_right", _run(1))
    same = F.slice("words", F.col("place") + 1, K) == F.slice("item_words", F.col("item_place") + 1, K)
    long_hit = (F.col("size") == WINDOW) & same & (F.col("_left") + F.col("_right") >= REACH)
    short_hit = (F.col("size") < WINDOW) & (F.slice("words", F.col("place") + 1, F.col("size")) == F.col("item_words"))
    start = F.col("base") + F.col("place") - F.when(F.col("size") == WINDOW, F.col("_left")).otherwise(0)
    end = F.col("base") + F.col("place") + F.when(F.col("size") == WINDOW, K + F.col("_right")).otherwise(F.col("size"))
    return met.filter(long_hit | short_hit).select("at", "item_id", start.alias("start"), end.alias("end"))


def _words_by_place(docs: DataFrame, place: Column, text_col: str) -> DataFrame:
    return docs.select(place.alias("at"), words_of(F.col(text_col)).alias("words"))


def _tests(items: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    return items.select(F.col(item_col).cast("string").alias("item_id"), words_of(F.col(item_text_col)).alias("words"))


def decontaminate(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    carry: list[str] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: ``row`` (a struct of its columns, or of those in ``carry``), ``n_words``, ``n_hit`` (words inside an
    occurrence of a window), ``spans`` (sorted disjoint (start, end) in words), ``items`` (sorted ids, as strings, of the
    items with an occurring window).

    Null and empty texts have no words and no hits, and an item without words has no window. An item with a null id marks
    words but isn't listed. Repeated rows are judged each by itself, texts of any length as a whole. Further columns,
    whatever their names, are left alone. Without any item nothing is hit; an empty table gives an empty one.
    """
    names = docs.columns if carry is None else carry
    docs, file, place = located(docs)
    at = F.struct(file.alias("file"), place.alias("row"))
    n_words = F.size(words_of(F.col(text_col)))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
        n_words.cast("long").alias("n_words"),
        at.alias("at"),
    )
    found = hits(_words_by_place(docs, at, text_col), _tests(items, item_col, item_text_col)).groupBy("at").agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("hits"), F.array_sort(F.collect_set("item_id")).alias("items")
    )
    # A fold over the sorted spans that keeps the open one and what is done.
    none = F.array().cast("array<struct<start:int,end:int>>")
    zero = F.struct(none.alias("done"), F.lit(-1).alias("start"), F.lit(-1).alias("end"))

    def span(start: Column, end: Column) -> Column:
        return F.struct(start.alias("start"), end.alias("end"))

    def grow(acc: Column, x: Column) -> Column:
        opens = x.getField("start") > acc.getField("end")
        closed = F.when(opens & (acc.getField("end") >= 0), F.concat(acc.getField("done"), F.array(span(acc.getField("start"), acc.getField("end")))))
        return F.struct(
            closed.otherwise(acc.getField("done")).alias("done"),
            F.when(opens, x.getField("start")).otherwise(acc.getField("start")).alias("start"),
            F.when(opens, x.getField("end")).otherwise(F.greatest(acc.getField("end"), x.getField("end"))).alias("end"),
        )

    def finish(acc: Column) -> Column:
        return F.when(acc.getField("end") < 0, acc.getField("done")).otherwise(
            F.concat(acc.getField("done"), F.array(span(acc.getField("start"), acc.getField("end"))))
        )

    found = found.select(F.col("at").alias("_hit_at"), F.aggregate("hits", zero, grow, finish).alias("spans"), "items")
    joined = rows.join(found, F.col("at") == F.col("_hit_at"), "left")
    n_hit = F.aggregate(F.coalesce("spans", none), F.lit(0), lambda acc, s: acc + s.getField("end") - s.getField("start"))
    return joined.select(
        "row", "n_words", n_hit.cast("long").alias("n_hit"), F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


@settled("contaminated")
def _contaminated(docs: DataFrame, place: Column, items: DataFrame, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    return hits(_words_by_place(docs, place, text_col), _tests(items, item_col, item_text_col)).select("at.*").distinct()


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the rows in which a window of an item occurs; same columns. No text is shuffled.

    Rows without words stay (null, empty), texts of any length are read whole, each repeated row is judged alike, and null
    ids don't matter. Items without words have no window; without items, or documents, nothing goes."""
    docs, file, row = located(docs)
    gone = _contaminated(docs, F.struct(file.alias("file"), row.alias("row")), items, text_col, item_col, item_text_col)
    return without_rows(docs, file, row, gone)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP4_SQL = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row_no,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, m, array_to_string(w[p:p + m - 1], ' ') AS said
  FROM (SELECT item_id, w, least({WINDOW}, len(w)) AS m, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)
), dw AS (
  SELECT row_no, p, m, array_to_string(w[p:p + m - 1], ' ') AS said
  FROM (SELECT row_no, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM iw))
), hit AS (SELECT row_no, p, m, item_id FROM dw JOIN iw USING (m, said)),
words AS (SELECT row_no, count(DISTINCT x) AS n_hit FROM (SELECT row_no, unnest(range(p, p + m)) AS x FROM hit) GROUP BY row_no),
items AS (SELECT row_no, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT row_no, item_id FROM hit) GROUP BY row_no)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (row_no) LEFT JOIN items USING (row_no)
"""
