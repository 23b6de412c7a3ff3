"""Guaranteed heavy hitters per group: Weighted Lossy Counting in every partition, summaries added up, survivors recounted.

A summary keeps, for each group, entries (count, delta) of keys: ``count`` is the weight seen since the key came in, ``delta`` the most that may
have been missed before. The weight of a group is measured in epochs of EPOCH; whenever it passes the end of one, entries
whose count + delta aren't over the number of epochs gone by are pruned. So a key's weight in the partition lies between
count and count + delta, or is at most the number of epochs if it has no entry, and a group holds some EPOCH * log(weight)
entries however many keys it has. Summaries of partitions are added up: counts, and deltas (or epochs, where a key has no entry). What may
be heavy by that is counted exactly in a second pass, unless its bounds meet already.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgauge.llm.common import cut, settled, table

#: A key is heavy if SUPPORT times its weight is over the group's; an epoch's weight is so that bounds are at most half of that apart.
SUPPORT = 50
#: Entries that are taken into a summary at once, and that a summary may hold before it is given out and begun anew.
CHUNK, MOST = 250_000, 1_000_000
#: Bits of the bitmap of survivors (1 MB), whatever the input.
FILTER_BITS = 23


def _chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _summed(rows: pa.Table, by: list[str], sums: list[str], least: tuple[str, ...] = ()) -> pa.Table:
    wanted = [(c, "sum") for c in sums] + [(c, "min") for c in least]
    found = rows.group_by(by, use_threads=False).aggregate(wanted)
    return found.rename_columns([c.removesuffix("_sum").removesuffix("_min") if c not in by else c for c in found.column_names])


def _with_epochs(rows: pa.Table, groups: pa.Table, by: list[str], name: str) -> pa.Table:
    """``rows`` with the epochs gone by in their groups."""
    some = groups.filter(pc.greater(groups["epochs"], 0)).select([*by, "epochs"])
    if not some.num_rows:
        return rows.append_column(name, pa.nulls(rows.num_rows, pa.int64()).fill_null(0))
    met = rows.join(some, by, join_type="left outer", use_threads=False)
    return met.set_column(met.column_names.index("epochs"), name, pc.fill_null(met["epochs"], 0))


def _summariser(by: list[str], item: str, weight: str, epoch: int, chunk: int, most: int) -> Callable:
    keys = [*by, item]

    def given_out(entries: pa.Table, groups: pa.Table) -> Iterator[pa.RecordBatch]:
        told = _with_epochs(entries, groups, by, "epochs")
        slack = pc.subtract(told["epochs"], told["delta"])
        none = pa.nulls(told.num_rows, pa.int64())
        yield from pa.table([*(told[k] for k in keys), told["count"], slack, none, none, none], names=[*keys, "low", "slack", "total", "epochs", "n"]).to_batches(max_chunksize=100_000)
        empty = pa.nulls(groups.num_rows, pa.int64())
        nothing = pa.nulls(groups.num_rows, entries.schema.field(item).type)
        yield from pa.table([*(groups[k] for k in by), nothing, empty, empty, groups["total"], groups["epochs"], groups["n"]], names=[*keys, "low", "slack", "total", "epochs", "n"]).to_batches(max_chunksize=100_000)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = groups = None
        for rows in _chunks(batches, chunk):
            rows = rows.append_column("n", pa.nulls(rows.num_rows, pa.int64()).fill_null(1))
            new = _summed(rows, keys, [weight, "n"])
            new = new.rename_columns(["count" if c == weight else c for c in new.column_names])
            seen = _summed(new, by, ["count", "n"])
            seen = seen.rename_columns(["total" if c == "count" else c for c in seen.column_names])
            # A key that comes in now may have been missed as often as epochs have gone by; an entry keeps its smaller delta.
            if entries is None:
                new = new.append_column("delta", pa.nulls(new.num_rows, pa.int64()).fill_null(0)).select([*keys, "count", "delta"])
                entries, groups = new, seen.select([*by, "total", "n"])
            else:
                new = _with_epochs(new, groups, by, "delta").select([*keys, "count", "delta"])
                entries = _summed(pa.concat_tables([entries, new]), keys, ["count"], ("delta",)).select([*keys, "count", "delta"])
                groups = _summed(pa.concat_tables([groups.select([*by, "total", "n"]), seen.select([*by, "total", "n"])]), by, ["total", "n"])
            groups = groups.append_column("epochs", pc.divide(groups["total"], epoch))
            aged = _with_epochs(entries, groups, by, "epochs")
            entries = aged.filter(pc.greater(pc.add(aged["count"], aged["delta"]), aged["epochs"])).select([*keys, "count", "delta"])
            if entries.num_rows > most:
                yield from given_out(entries, groups)
                entries = groups = None
        if entries is not None:
            yield from given_out(entries, groups)

    return summarise


def _survivors(rows: DataFrame, wanted: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """The rows whose keys are in ``wanted``, and few others: a bitmap of 2^bits bits is broadcast, as at most 2^bits / 64 words."""
    spot = F.pmod(F.xxhash64(*keys), F.lit(1 << bits))
    word, bit = F.shiftright(spot, 6), F.pmod(spot, F.lit(64)).cast("int")
    words = wanted.select(word.alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("one")).groupBy("_word").agg(F.bit_or("one").alias("_map"))
    met = rows.withColumn("_word", word).join(F.broadcast(words), "_word", "left")
    return met.filter(F.coalesce(F.getbit("_map", bit), F.lit(0)) == 1).select(*rows.columns)


@settled("heavy")
def heavy_hitters(
    entries: DataFrame, by: list[str], item: str = "item", weight: str = "w", support: int = SUPPORT, chunk: int = CHUNK, most: int = MOST, bits: int = FILTER_BITS,
) -> DataFrame:
    """(by, item, n_entries, total, w, low, estimate, high): exactly the keys whose weight times ``support`` is over their group's.

    ``entries`` are rows of group columns ``by`` (of simple types), a text ``item`` and a whole ``weight`` of 0 or more; rows with a null in any of them, or a weight
    below 0, take no part. ``n_entries`` and ``total`` are the group's rows and weight, ``w`` the key's exact weight;
    ``low`` and ``high`` bound it by the summaries alone, at most total / (2 * support) apart, and ``estimate`` is between. Repeated rows count
    again; a key as heavy as another is given like it. An empty table gives an empty one; further columns aren't looked at.

    No task holds a group or its keys as a whole: summaries are made where rows are read, added up by group and key, and met with their groups'
    totals by a join of plain exchanges, of which Spark splits hot partitions. The second pass reads the entries again
    through a bitmap of fixed size; where survivors are so many that it is full, it only spares nothing.
    """
    keys = [*by, item]
    whole = entries.select(*[F.col(f"`{c}`") for c in by], F.col(item).cast("string").alias(item), F.col(weight).cast("long").alias(weight)).dropna().filter(F.col(weight) >= 0)
    whole = cut(whole, "entries", chunk)
    types = {f.name: f.dataType.simpleString() for f in whole.schema}
    head = ", ".join(f"`{k}` {types[k]}" for k in keys)
    made = whole.mapInArrow(_summariser(by, item, weight, 2 * support, chunk, most), f"{head}, low long, slack long, total long, epochs long, n long")
    summaries = cut(made, "summaries", chunk)
    counts = summaries.filter(F.col(item).isNotNull()).groupBy(*keys).agg(F.sum("low").alias("low"), F.sum("slack").alias("slack"))
    totals = summaries.filter(F.col(item).isNull()).groupBy(*by).agg(F.sum("total").alias("total"), F.sum("epochs").alias("epochs"), F.sum("n").alias("n_entries"))
    group = F.struct(*by).alias("_group")  # made anew on both sides, so that each is a plain exchange
    met = counts.select(group, item, "low", "slack").join(totals.select(group, "total", "epochs", "n_entries"), "_group")
    high = F.col("low") + F.col("epochs") - F.col("slack")
    # whole numbers: support * w > total, without a product that could overflow
    limit = F.expr(f"total div {support}")
    maybe = met.select("_group.*", item, "n_entries", "total", "low", high.alias("high")).filter(F.col("high") > limit)
    maybe = cut(maybe, "candidates", chunk)
    open_ = maybe.filter("low < high")
    exact = _survivors(whole, open_, keys, bits).groupBy(*keys).agg(F.sum(weight).alias("_w"))
    known = maybe.filter("low = high").withColumn("_w", F.col("low")).unionByName(open_.join(exact, keys))
    estimate = F.col("low") + F.expr("(high - low) div 2")
    return known.filter(F.col("_w") > limit).select(*keys, "n_entries", "total", F.col("_w").alias("w"), "low", estimate.alias("estimate"), "high")


def _refused(name: str):
    raise ValueError(name)


def props_of(text: str) -> list[str]:
    """The keys that occur in a click's props; none if the text isn't valid JSON as a whole (or nested too deeply for Python's parser)."""
    try:
        props = json.loads(text, parse_int=str, parse_float=str, parse_constant=_refused)
    except (ValueError, RecursionError):
        return []
    if not isinstance(props, dict):
        return []
    device, tags, items = props.get("device"), props.get("tags"), props.get("items")
    found = [("os", device.get("os"))] if isinstance(device, dict) else []
    found += [("tag", tag) for tag in tags] if isinstance(tags, list) else []
    found += [("sku", x.get("sku")) for x in items if isinstance(x, dict)] if isinstance(items, list) else []
    return [f"{kind}={value if isinstance(value, str) else json.dumps(value)}".encode("utf-8", "replace").decode() for kind, value in found if value is not None]


def _prop_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [props_of(text) for text in batch.column("props").to_pylist()]
        rows = pa.array([i for i, keys in enumerate(found) for _ in keys], pa.int64())
        yield pa.record_batch([batch.column("grp").take(rows), pa.array([k for keys in found for k in keys], pa.string())], names=["grp", "item"])


def op13_heavy_hitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks, lines = table(spark, sf_dir, "clicks"), table(spark, sf_dir, "sale_lines")
    quarter = F.unix_date(F.col("ts").cast("date")).cast("long") * 4 + F.floor(F.hour("ts") / 6)  # of a day, whatever the session's zone
    one = F.lit(1).cast("long").alias("w")
    user = clicks.select(F.lit("user").alias("stream"), quarter.cast("long").alias("grp"), F.col("client_id").cast("string").alias("item"), one)
    part = lines.select(F.lit("part").alias("stream"), F.col("vendor_id").alias("grp"), F.col("item_id").cast("string").alias("item"), F.col("quantity").cast("long").alias("w"))
    told = clicks.select(F.col("client_id").alias("grp"), "props").filter("grp is not null and props is not null").mapInArrow(_prop_entries, "grp long, item string")
    prop = told.select(F.lit("prop").alias("stream"), "grp", "item", one)
    return heavy_hitters(user.unionByName(part).unionByName(prop), ["stream", "grp"])
