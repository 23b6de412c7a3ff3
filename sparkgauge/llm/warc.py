"""WARC archives of pages, and the index of their captures by external merge.

Spark's text writer lays down the records, so archives are committed and retried like any table; every record names, right
after the version, a boundary that belongs to the archives as a whole, and by that line the text reader takes them apart
again record by record, however large a file is. Payloads that repeat are told by digest before anything is written: the
records of later ones (revisits) need no payload, and those of the others are written where their rows are read, so no payload is ever
shuffled.

The index is merged the way an archive's is: what a task reads is sorted into runs and written; splitters from samples
of all runs cut them into ranges; each range's pieces, one from each run, go through a loser tree by URL key, time and
record. Ranges follow each other, so the histories are in order as a whole, and hot URLs are cut by time.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgauge.llm.common import cut, located, own_folder, settled, table, without_rows

CRLF, BLANK = "\r\n", "\r\n\r\n"
#: Payloads under this many bytes never become revisits.
LEAST = 100
#: Records in an archive file, captures in a sorted run and in a block of one, one sample for so many captures, captures in a range of the merge.
FILE_RECORDS, RUN, BLOCK, STRIDE, RANGE = 50_000, 65_536, 256, 32, 100_000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_KEY = ("url_key", "timestamp", "record_id")
_CAPTURE = "url_key string, timestamp string, record_id string, id string, record_type string, payload_bytes long, payload_digest string, refers_to string, archive string"


def _head_line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def _urn(id_: Column, file: Column, row: Column) -> Column:
    """A record's name: its row's id (~ for none) and place, which no other row has."""
    own = F.coalesce(F.url_encode(id_.cast("string")), F.lit("~"))
    return F.concat(F.lit("<urn:page:"), own, F.lit(":"), F.lower(F.hex(file)), F.lit("-"), row.cast("string"), F.lit(">"))


def _id_of(urn: Column) -> Column:
    own = F.regexp_extract(urn, "^<urn:page:([^:]*):", 1)
    return F.when(own.isin("", "~"), F.lit(None)).otherwise(F.url_decode(own))


def _digest(payload: Column) -> Column:
    return F.sha2(payload.cast("binary"), 256)


def _record(boundary: str, kind: str, urn: Column, url: Column, time: Column, digest: Column, size: Column, payload: Column | None, more: Column | None = None) -> Column:
    """A record, but for the two line ends after it."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"), _head_line("Content-Length", size.cast("string")), F.lit(CRLF))
    length = F.octet_length(http) + (size if payload is not None else 0)
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Boundary: {boundary}{CRLF}WARC-Type: {kind}{CRLF}"), _head_line("WARC-Record-ID", urn), _head_line("WARC-Date", F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        _head_line("WARC-Target-URI", F.replace(F.replace(F.coalesce(url, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))), _head_line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        *([more] if more is not None else []), F.lit(f"Content-Type: application/http;msgtype=response{CRLF}"), _head_line("Content-Length", length.cast("string")), F.lit(CRLF), http,
    )
    return head if payload is None else F.concat(head, payload)


def write_warc(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", time: Column | None = None, least: int = LEAST,
    records: int = FILE_RECORDS, compression: str = "gzip",
) -> str:
    """Write a record per row of ``pages`` to new files in ``folder``; returns the boundary by which read_warc() tells records.

    Of rows with equal payloads of ``least`` bytes or more, the one with the smallest id (nulls last; of rows that repeat it the
    one stored first) is a response, the others are revisits of it; all other rows are responses. A null payload is
    empty, a null URL too, line breaks in one are percent-encoded. ``time`` is a column of UTC times without a zone; without one, or where it is null, the moment of writing. An
    empty table writes no record; further columns aren't looked at.
    """
    boundary = uuid.uuid4().hex
    now = F.lit(datetime.now(UTC).replace(tzinfo=None, microsecond=0).isoformat()).cast("timestamp_ntz")
    time = now if time is None else F.coalesce(time.cast("timestamp_ntz"), now)
    pages, file, row = located(pages)
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    facts = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), time.alias("time"), file.alias("file"), row.alias("row"), F.octet_length(payload).cast("long").alias("size"),
        F.when(F.octet_length(payload) >= least, F.unhex(_digest(payload))).alias("digest"),
    ).filter("digest is not null")
    facts = cut(facts, "payloads")
    first = F.min(F.struct(F.col("id").isNull(), "id", "file", "row")).alias("first")
    groups = facts.groupBy("digest").agg(first, F.count(F.lit(1)).alias("n")).filter("n > 1")
    # The key is made anew on both sides, so that each is a plain exchange, whose hot partitions Spark can split.
    met = facts.withColumn("key", F.hex("digest")).join(groups.select(F.hex("digest").alias("key"), "first"), "key")
    later = cut(met.filter((F.col("first.file") != F.col("file")) | (F.col("first.row") != F.col("row"))), "revisits")
    refers = F.concat(_head_line("WARC-Profile", F.lit(_PROFILE)), _head_line("WARC-Refers-To", _urn(F.col("first.id"), F.col("first.file"), F.col("first.row"))))
    again = later.select(_record(boundary, "revisit", _urn(F.col("id"), F.col("file"), F.col("row")), F.col("url"), F.col("time"), F.lower("key"), F.col("size"), None, refers).alias("value"))
    kept = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), time.alias("time"), payload.alias("payload"), file.alias("file_"), row.alias("row_"))
    told = without_rows(kept, F.col("file_"), F.col("row_"), later.select("file", "row"))
    size = F.octet_length("payload").cast("long")
    whole = told.select(_record(boundary, "response", _urn(F.col("id"), F.col("file_"), F.col("row_")), F.col("url"), F.col("time"), _digest(F.col("payload")), size, F.col("payload")).alias("value"))
    whole.unionByName(again).write.mode("append").option("lineSep", BLANK).option("maxRecordsPerFile", records).option("compression", compression).text(folder)
    return boundary


def url_key(url: Column) -> Column:
    """A URL as it is sorted: the host's parts from the last to the first, then what follows; no scheme, user, www. or fragment, all in
    lower case. Empty for a null."""
    bare = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://([^/?#]*@)?(www\.)?|#.*$", "")
    host = F.regexp_extract(bare, r"^([^/?:]*)", 1)
    rest = F.substr(bare, F.length(host) + 1)
    return F.when(bare == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), ","), F.lit(")"), rest))


def _field(head: str, name: str) -> Column:
    return F.regexp_extract(head, rf"(?:^|\n){name}: ([^\r\n]*)", 1)


def read_warc(spark: SparkSession, folder: str, boundary: str) -> DataFrame:
    """The records of write_warc(): url, time and names as written, ``http`` and ``payload`` (null for a revisit), ``payload_bytes`` and
    ``payload_digest`` of the whole payload. A record that isn't as long as it says raises an error."""
    raw = spark.read.option("lineSep", f"WARC/1.1{CRLF}WARC-Boundary: {boundary}{CRLF}").text(folder)
    parts = raw.select("value", F.col("_metadata.file_name").alias("archive")).filter("value <> ''").withColumn("head", F.substring_index("value", BLANK, 1))
    rest = F.substr("value", F.length("head") + 5)
    parts = parts.select("archive", "head", F.substr(rest, F.lit(1), F.length(rest) - 4).alias("block"))
    damaged = F.concat(F.lit("damaged record in "), F.col("archive"))
    parts = parts.withColumn("http", F.when(F.octet_length("block") == _field("head", "Content-Length").try_cast("long"), F.substring_index("block", BLANK, 1)).otherwise(F.raise_error(damaged)))
    kind, urn = _field("head", "WARC-Type"), _field("head", "WARC-Record-ID")
    parts = parts.withColumn("record_type", kind).withColumn("payload", F.when(F.col("record_type") == "response", F.substr("block", F.length("http") + 5)))
    return parts.select(
        _field("head", "WARC-Target-URI").alias("url"), F.regexp_replace(_field("head", "WARC-Date"), "[^0-9]", "").alias("timestamp"), urn.alias("record_id"), _id_of(urn).alias("id"), "record_type",
        "http", "payload", F.when(F.col("payload").isNull(), _field("http", "Content-Length").cast("long")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(F.col("payload").isNull(), F.substring_index(_field("head", "WARC-Payload-Digest"), ":", -1)).otherwise(_digest(F.col("payload"))).alias("payload_digest"),
        _id_of(_field("head", "WARC-Refers-To")).alias("refers_to"), "archive",
    )


class LoserTree:
    """The smallest head of many sorted runs, again and again: each inner node remembers the loser of the match below it, so the next winner
    takes one match per level on the way up from the leaf that moved."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at = runs, [0] * len(runs)
        k = max(len(runs), 1)
        self.k, self.losers = k, [0] * k
        winners = [0] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._beats(a, b) else (b, a)
        self.top = winners[1] if k > 1 else 0

    def _beats(self, a: int, b: int) -> bool:
        """Whether the head of run a comes first; an ended run never does, of equals the earlier run."""
        if self.at[a] >= len(self.runs[a]):
            return False
        if self.at[b] >= len(self.runs[b]):
            return True
        x, y = self.runs[a][self.at[a]], self.runs[b][self.at[b]]
        return x < y or x == y and a < b

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, place) in order."""
        while self.runs and self.at[self.top] < len(self.runs[self.top]):
            yield self.top, self.at[self.top]
            self.at[self.top] += 1
            winner, node = self.top, (self.k + self.top) // 2
            while node:
                if self._beats(self.losers[node], winner):
                    winner, self.losers[node] = self.losers[node], winner
                node //= 2
            self.top = winner


def _keys(captures: pa.Table) -> list[tuple]:
    return list(zip(*(captures[c].to_pylist() for c in _KEY), strict=True))


def _runs(run: int, block: int, stride: int) -> Callable:
    """Captures as they are read, sorted into runs of ``run``, in blocks: an array of captures and the keys of a few."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            rows = rows.sort_by([(c, "ascending") for c in _KEY])
            name = uuid.uuid4().hex
            for nth, start in enumerate(range(0, rows.num_rows, block)):
                part = rows.slice(start, block).combine_chunks()
                keys = part.select(_KEY).to_pylist()
                whole = pa.StructArray.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in part.columns], names=part.column_names)
                listed = pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole)
                sample = keys[min(stride, len(keys)) // 2 :: stride]
                yield pa.record_batch([pa.array([name]), pa.array([nth], pa.int32()), pa.array([sample], pa.list_(pa.struct([(c, pa.string()) for c in _KEY]))), listed], names=["run", "block", "sample", "captures"])

        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= run:
                yield from flush()
                held, n = [], 0
        if n:
            yield from flush()

    return sort


def _cutter(splitters) -> Callable:
    """Blocks cut at the splitters: (range, run, block, captures)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits = splitters.value
        for batch in batches:
            for i in range(batch.num_rows):
                captures = batch.column("captures").slice(i, 1).flatten()
                keys = list(zip(*(captures.field(c).to_pylist() for c in _KEY), strict=True))
                start = 0
                while start < len(keys):
                    nth = bisect_right(limits, keys[start])
                    low, high = start + 1, len(keys)
                    while low < high and nth < len(limits):  # the first key of a later range
                        middle = (low + high) // 2
                        low, high = (low, middle) if keys[middle] >= limits[nth] else (middle + 1, high)
                    end = high if nth < len(limits) else len(keys)
                    part = pa.ListArray.from_arrays(pa.array([0, end - start], pa.int32()), captures.slice(start, end - start))
                    yield pa.record_batch([pa.array([nth], pa.int32()), batch.column("run").slice(i, 1), batch.column("block").slice(i, 1), part], names=["range", "run", "block", "captures"])
                    start = end

    return split


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of one range, which come by run and block, merged."""
    numbers: list[int] = []
    names: list[str] = []
    parts: list[pa.Array] = []
    for batch in batches:
        for i in range(batch.num_rows):
            numbers.append(batch.column("range")[i].as_py())
            names.append(batch.column("run")[i].as_py())
            parts.append(batch.column("captures").slice(i, 1).flatten())
    if not parts:
        return
    whole = pa.Table.from_struct_array(pa.concat_arrays(parts))
    keys, runs, starts, begin = _keys(whole), [], [], 0
    for i, part in enumerate(parts):
        if i == 0 or names[i] != names[i - 1]:
            runs.append([])
            starts.append(begin)
        runs[-1] += keys[begin : begin + len(part)]
        begin += len(part)
    order = [starts[run] + place for run, place in LoserTree(runs)]
    out = whole.take(pa.array(order, pa.int64())).append_column("range", pa.array([numbers[0]] * len(order), pa.int32())).append_column("place", pa.array(range(len(order)), pa.int64()))
    yield from out.combine_chunks().to_batches(max_chunksize=10_000)


def capture_index(captures: DataFrame, run: int = RUN, block: int = BLOCK, stride: int = STRIDE, size: int = RANGE) -> DataFrame:
    """Captures (as read_warc() gives them) in one order: by ``url_key``, ``timestamp`` and ``record_id``; ``range`` and ``place`` number them.

    Runs are written before they are merged, as what is sampled and what is merged must be the same. The driver gets one splitter per
    ``size`` captures, or per shuffle partition if those are more. A range is merged in one task; no key can be hot, as records' names
    differ. Captures with the same url and time are told by their names. An empty table gives an empty one.
    """
    spark = captures.sparkSession
    rows = captures.select(url_key(F.col("url")).alias("url_key"), "timestamp", "record_id", "id", "record_type", "payload_bytes", "payload_digest", "refers_to", "archive")
    key = ", ".join(f"{c}: string" for c in _KEY)
    shape = "struct<" + ", ".join(": ".join(c.split(" ")) for c in _CAPTURE.split(", ")) + ">"
    made = cut(rows.mapInArrow(_runs(run, block, stride), f"run string, block int, sample array<struct<{key}>>, captures array<{shape}>"), "runs")
    samples = made.select(F.explode("sample").alias("s")).select("s.*")
    n = made.agg(F.sum(F.size("captures"))).first()[0] or 0
    spread = min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // (8 * stride))
    ranges = max(1, -(-n // size), spread)
    firsts = samples.repartitionByRange(ranges, *_KEY).groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct(*_KEY)).alias("first"))
    limits = sorted(tuple(r["first"]) for r in firsts.collect())[1:]  # a row for each range
    pieces = made.select("run", "block", "captures").mapInArrow(_cutter(spark.sparkContext.broadcast(limits)), f"range int, run string, block int, captures array<{shape}>")
    dealt = pieces.repartitionById(len(limits) + 1, "range").sortWithinPartitions("run", "block")
    return dealt.mapInArrow(_merge, f"{_CAPTURE}, range int, place long")


@settled("captures")
def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", time: Column | None = None) -> DataFrame:
    """capture_index() of archives of ``pages``, which are deleted once they are read back."""
    spark = pages.sparkSession
    folder = own_folder(spark, "archives")
    boundary = write_warc(pages, folder, id_col, url_col, payload_col, time)
    return capture_index(read_warc(spark, folder, boundary))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captured = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")  # pages don't say when
    found = archive(table(spark, sf_dir, "pages"), time=captured)
    return found.select(F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


OP12_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes < 100 OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
