"""Sharding by k-d tree, in DataFrame operations only.

Texts that are equal are one point, weighted with their bytes. Every node of the tree is split at the weighted median of
its widest metadata dimension (the one of which it still has the largest part of the whole span) until the leaves reach the
target bytes. A median is found by descending through the digits
of a 60-bit key (12 bits of the dimension's value, then bits of the point's hash that break ties), all nodes of a level at
once: each step aggregates the weights by node and digit, so no task sorts or holds a node's points. To the driver go one
row per node and step only, and their number is that of the shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkgauge.llm.common import cut, located, numbered, settled, small_rows, table

#: Bits of a digit, and digits in a key.
DIGIT, DIGITS = 12, 5
#: A group of equal texts that weighs more than this part of a shard is cut into pieces of about that weight, but of no
#: fewer rows each than PIECE_ROWS, so that rows dealt by hash fill them evenly.
PIECE, PIECE_ROWS = 1 / 64, 32


def _codes(lang: Column, source: Column, size: Column) -> dict[str, Column]:
    """The metadata dimensions, each scaled to 0 .. 4095."""
    return {
        "size": F.least(F.lit(4095), F.floor(F.log2(size.cast("double")) * 100)).cast("long"),
        "source": F.pmod(F.xxhash64(source), F.lit(4096)),
        "lang": F.pmod(F.xxhash64(lang), F.lit(4096)),
    }


def kd_leaves(points: DataFrame, dims: list[str], shards: int) -> DataFrame:
    """``points`` (columns dims, ``hash``, ``weight``) with ``shard``: the leaf 0 .. shards-1 of each point.

    A node that has to make k shards gives the lower k // 2 of them that share of its weight. At the cut the digit that
    straddles the share goes to the side that brings the weights closer to it.
    """
    spark = points.sparkSession
    points = cut(points.withColumn("_node", F.lit(0)), "kd-points")
    nodes, root = {0: (0, shards)}, None  # node -> first shard, shards
    while any(k > 1 for _, k in nodes.values()):
        open_nodes = {n: v for n, v in nodes.items() if v[1] > 1}
        here = points.filter(F.col("_node").isin(list(open_nodes))) if len(open_nodes) <= 64 else points
        spans = here.groupBy("_node").agg(
            F.sum("weight").alias("w"), *[(F.max(d) - F.min(d)).alias(d) for d in dims]
        ).collect()
        if root is None and spans:
            root = {d: max(1, spans[0][d]) for d in dims}
        seen = {r["_node"]: (max(dims, key=lambda d: r[d] / root[d]), r["w"]) for r in spans}  # noqa: B023
        chosen = {n: seen.get(n, (dims[0], 0)) for n in open_nodes}
        rows = [(n, dims.index(d), float(w) * (open_nodes[n][1] // 2) / open_nodes[n][1]) for n, (d, w) in chosen.items()]
        plan = small_rows(spark, rows, "_node int, _dim int, _share double")
        value = F.element_at(F.array(*dims), F.col("_dim") + 1)
        tail = F.shiftrightunsigned("hash", 64 - DIGIT * (DIGITS - 1))
        keyed = points.join(F.broadcast(plan), "_node").withColumn("_key", F.shiftleft(value, DIGIT * (DIGITS - 1)) + tail)
        cuts = {n: 0 for n in open_nodes}  # the key below which a point goes left
        left = {n: r[2] for n, r in zip(open_nodes, rows, strict=True)}  # weight still to be taken
        active = dict(chosen)
        for step in range(DIGITS):
            shift = DIGIT * (DIGITS - 1 - step)
            state = small_rows(spark, [(n, cuts[n], float(left[n])) for n in active], "_node int, _from long, _left double")
            inside = keyed.join(F.broadcast(state), "_node")
            if step:
                inside = inside.filter(F.shiftright("_key", shift + DIGIT) == F.shiftright("_from", shift + DIGIT))
            digit = F.shiftright("_key", shift).bitwiseAND(F.lit((1 << DIGIT) - 1)).alias("_digit")
            sums = inside.groupBy("_node", "_left", digit).agg(F.sum("weight").alias("w"))
            run = sums.withColumn("upto", F.sum("w").over(W.partitionBy("_node").orderBy("_digit")))
            straddles = run.filter((F.col("upto") > F.col("_left")) & (F.col("upto") - F.col("w") <= F.col("_left")))
            found = {r["_node"]: r for r in straddles.collect()}
            going = {}
            for n in active:
                r = found.get(n)
                if r is None:  # all of it goes left
                    cuts[n] += 1 << (shift + DIGIT) if step else (1 << (DIGIT * DIGITS))
                    continue
                cuts[n] += r["_digit"] << shift
                left[n] -= r["upto"] - r["w"]
                if r["w"] <= chosen[n][1] * 1e-4 or step == DIGITS - 1:
                    if left[n] * 2 >= r["w"]:
                        cuts[n] += 1 << shift
                else:
                    going[n] = active[n]
            active = going
            if not active:
                break
        following, made, splits = {}, max(nodes) + 1, []
        for n, (first, k) in nodes.items():
            if k == 1:
                following[n] = (first, k)
                continue
            following[made], following[made + 1] = (first, k // 2), (first + k // 2, k - k // 2)
            splits.append((n, dims.index(chosen[n][0]), cuts[n], made, made + 1))
            made += 2
        tree = small_rows(spark, splits, "_node int, _dim int, _cut long, _low int, _high int")
        at = points.join(F.broadcast(tree), "_node", "left")
        key = F.shiftleft(value, DIGIT * (DIGITS - 1)) + tail
        to = F.when(F.col("_cut").isNull(), F.col("_node")).when(key < F.col("_cut"), F.col("_low")).otherwise(F.col("_high"))
        points = cut(at.withColumn("_node", to).drop("_dim", "_cut", "_low", "_high"), "kd-points")
        nodes = following
    shard = small_rows(spark, [(n, first) for n, (first, _) in nodes.items()], "_node int, shard int")
    return points.join(F.broadcast(shard), "_node").drop("_node")


@settled("shards")
def kd_shards(
    docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text",
    lang_col: str = "lang", source_col: str = "source",
) -> DataFrame:
    """(id, size, text_crc32, shard, slot) per row of ``docs``, shards of nearly equal bytes.

    Give the number of shards, or the bytes that a leaf shall reach. A row's size is the UTF-8 bytes of its text plus 1 (a
    null text has none, and is like an empty one). Rows with equal texts go to the same shard, unless they are PIECE_ROWS
    rows or more and weigh more than PIECE of it together: then they are dealt out in pieces by id. So a shard may differ
    from the mean by about the weight of the heaviest point, which is one text or a group of fewer copies. Null ids, langs
    and sources are values like others; repeated rows are rows like others, told apart by where they are stored. An empty
    table gives an empty one. A text longer than a shard makes its shard larger. Further columns of any name aren't looked
    at. ``slot`` counts a shard's rows from 0.
    """
    names = docs.columns
    docs, file, place = located(docs)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("_text"),
        F.col(lang_col).alias("_lang") if lang_col in names else F.lit(None).cast("string").alias("_lang"),
        F.col(source_col).alias("_source") if source_col in names else F.lit(None).cast("string").alias("_source"),
        F.xxhash64(file, place).alias("_at"),
    )
    rows = cut(rows, "shard-rows")
    sums = rows.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    total, count = sums["bytes"] or 0, sums["rows"]
    if shards is None:
        shards = max(1, -(-total // target_bytes)) if target_bytes else 1
    piece = max(1, int(total / shards * PIECE))
    pieces = F.greatest(F.lit(1), F.least(F.ceil(F.col("weight") / piece), F.floor(F.col("copies") / PIECE_ROWS))).cast("long")
    codes = _codes(F.col("lang"), F.col("source"), F.col("size"))
    groups = rows.groupBy("_text", "size").agg(
        F.sum("size").alias("weight"), F.count(F.lit(1)).alias("copies"), F.min("_lang").alias("lang"), F.min("_source").alias("source")
    )
    groups = groups.select(
        "_text", "size", "weight", pieces.alias("pieces"), *[c.alias(n) for n, c in codes.items() if n != "size"],
        codes["size"].alias("size_code"),
    )
    split = groups.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    points = split.select(
        "_text", "size", "piece", "size_code", "source", "lang",
        F.xxhash64("_text", "size", "piece").alias("hash"), (F.col("weight") / F.col("pieces")).alias("weight"),
    )
    leaves = kd_leaves(points, ["size_code", "source", "lang"], shards)
    # The pieces of a group are at most shards / PIECE many.
    # Written first, so that the join's two sides are plain exchanges, whose hot partitions Spark can split.
    homes = leaves.groupBy("_text", "size").agg(F.sort_array(F.collect_list(F.struct("piece", "shard"))).alias("homes"))
    placed = rows.join(cut(homes, "shard-homes"), ["_text", "size"])
    which = F.pmod(F.xxhash64("id", "_at"), F.size("homes").cast("long")).cast("int")
    placed = placed.select("id", "size", "text_crc32", F.get("homes", which).getField("shard").alias("shard"), "_at")
    buckets = max(16, -(-count // (shards * 250_000)))
    slotted = numbered(placed, ["shard"], [F.col("id"), F.col("_at")], "slot", F.xxhash64("id", "_at"), buckets)
    return slotted.select("id", "size", "text_crc32", "shard", "slot")


def op7_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kd_shards(table(spark, sf_dir, "documents"), shards=16)
    return found.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
