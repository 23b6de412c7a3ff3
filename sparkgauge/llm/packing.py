"""Best-fit packing of tokenized documents into sequences of a fixed number of tokens.

Best fit decreasing needs only lengths, and there are at most `capacity` different ones. So the driver packs a histogram:
open bins with the same room left are interchangeable and kept as ranges of sequence numbers, a segment tree over the
remaining capacities finds the tightest open bin in logarithmic time, and equal pieces are placed a range at a time. The
plan it makes (some thousand ranges at most, for any number of documents) is joined to the pieces by length and rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgauge.llm.common import cut, frugal, numbered, table, worker_cache

CAPACITY = 2048
#: The id after each document.
END_ID = 0
#: Parts of texts, and words, whose ids a Python worker remembers; when there are more, it starts anew.
REMEMBERED_WORDS = 700_000


class RoomTree:
    """A segment tree over the remaining capacities 0 .. top: which of them some open bin has."""

    def __init__(self, top: int):
        self.base = 1 << top.bit_length()
        self.any = [False] * (2 * self.base)

    def put(self, room: int, there: bool) -> None:
        at = self.base + room
        self.any[at] = there
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def tightest(self, need: int) -> int | None:
        """The smallest capacity >= need that an open bin has."""
        at = self.base + need
        if self.any[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                break
            at //= 2
        else:
            return None
        while at < self.base:
            at = 2 * at if self.any[2 * at] else 2 * at + 1
        return at - self.base


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best fit decreasing for counts[length] pieces of each length (1 .. capacity).

    Returns rows (length, first_rank, pieces, first_sequence, per_sequence, offset) and the number of sequences: the
    pieces of that length with ranks from first_rank go, per_sequence to each, into the sequences from first_sequence,
    starting at offset.
    """
    tree, bins, opened = RoomTree(capacity), {}, 0  # bins: room -> ranges [first, number] of sequences
    rows = []

    def give(room: int, first: int, number: int) -> None:
        if room and number:
            bins.setdefault(room, []).append([first, number])
            tree.put(room, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, fits = capacity, capacity // length
                first, number = opened, -(-left // fits)
                opened += number
            else:
                fits = room // length
                first, have = bins[room].pop()
                number = min(have, -(-left // fits))
                if number < have:
                    bins[room].append([first + number, have - number])
                if not bins[room]:
                    del bins[room]
                    tree.put(room, False)
            placed = min(left, number * fits)
            rows.append((length, rank, placed, first, fits, capacity - room))
            whole = placed // fits
            give(room - fits * length, first, whole)
            if placed % fits:
                give(room - placed % fits * length, first + whole, 1)
            rank, left = rank + placed, left - placed
    return rows, opened


#: How the word vocabulary splits a normalized text (white space between the parts is dropped).
WORD_RULE = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


class _Words:
    """A vocabulary whose rules drop white space and never look across it: a text's ids are those of its parts between
    ASCII white space. The ids of the parts met are remembered, and those of the words in them. A Latin part is split here;
    what isn't plain (other scripts, uncomposed letters, special tokens) goes to the tokenizer as it is."""

    def __init__(self, tokenizer, bare):
        import regex

        self.tokenizer, self.bare, self.rule = tokenizer, bare, regex.compile(WORD_RULE)
        self.parts: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}

    @staticmethod
    def _encoded(tokenizer, texts: list[str]) -> list[bytes]:
        import array

        return [array.array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, part: str) -> bool:
        if part.isascii():
            return "<|" not in part
        import unicodedata

        return max(part) < "\u0250" and "<|" not in part and not any(map(str.isspace, part)) and unicodedata.is_normalized("NFC", part)

    def _learn(self, new: list[bytes]) -> dict[bytes, bytes]:
        told = [w.decode() for w in new]
        split = [self.rule.findall(w.lower()) if self._plain(w) else None for w in told]
        if len(self.words) > REMEMBERED_WORDS:
            self.words.clear()
        unknown = list({x for words in split if words for x in words if x not in self.words})
        own = dict(zip(unknown, self._encoded(self.bare, unknown), strict=True))
        known = self.words
        other = iter(self._encoded(self.tokenizer, [w for w, words in zip(told, split, strict=True) if words is None]))
        out = {}
        for w, words in zip(new, split, strict=True):
            out[w] = next(other) if words is None else b"".join([own[x] if x in own else known[x] for x in words])
        known.update((x, ids) for x, ids in own.items() if len(x) <= 64)
        return out

    def ids(self, text: bytes) -> bytes:
        parts = text.split()
        ids = list(map(self.parts.get, parts))
        if None in ids:
            if len(self.parts) > REMEMBERED_WORDS:
                self.parts.clear()
            new = self._learn(list({w for w, x in zip(parts, ids, strict=True) if x is None}))
            self.parts.update((w, x) for w, x in new.items() if len(w) <= 64)
            ids = [new[w] if x is None else x for w, x in zip(parts, ids, strict=True)]
        return b"".join(ids)


class _Whole:
    """Any other vocabulary: texts are encoded whole."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def ids(self, text: bytes) -> bytes:
        return _Words._encoded(self.tokenizer, [text.decode()])[0]


def _encoder(path: str):
    """ids(text): the ids of a UTF-8 text as little-endian unsigned 32-bit numbers. Kept in the worker process from task to
    task."""
    kept = worker_cache("packing")
    if path not in kept:
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        steps = [n.get("type") for n in (rules.get("normalizer") or {}).get("normalizers", [])]
        splits = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        by_words = splits[0].get("pattern") == {"Regex": WORD_RULE} and splits[0].get("behavior") == "Removed" and splits[0].get("invert")
        if by_words and steps == ["NFC", "Replace", "Lowercase"] and len(splits) == 2:
            bare = Tokenizer.from_file(path)
            bare.normalizer = normalizers.Sequence([])
            bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            kept[path] = _Words(tokenizer, bare)
        else:
            kept[path] = _Whole(tokenizer)
    return kept[path]


def tokenize_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and END_ID, in pieces of ``capacity``.

    Only the last piece may be shorter. A null text is like an empty one: one piece with END_ID alone. Repeated rows are
    documents by themselves, null ids are kept. Texts of any length are encoded whole; further columns of any name aren't
    looked at; an empty table gives an empty one.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            out = {k: [] for k in ("row", "piece", "start", "length", "ids_crc32", "ids")}
            for row in range(len(batch)):
                text = texts[row].as_py()
                ids = (encoder.ids(text) if text else b"") + END_ID.to_bytes(4, "little")
                for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + capacity)]
                    for k, v in (("row", row), ("piece", piece), ("start", start), ("length", len(part) // 4), ("ids_crc32", zlib.crc32(part))):
                        out[k].append(v)
                    if keep_ids:
                        out["ids"].append(part)
            columns = [batch.column(0).take(pa.array(out["row"], pa.int32())), pa.array(out["piece"], pa.int32())]
            columns += [pa.array(out[k], pa.int64()) for k in ("start", "length", "ids_crc32")]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns, names = [*columns, pa.array(out["ids"], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(frugal(run), schema)


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``. Reads them twice, so hand over a table and not its computation.

    Pieces of one length are placed in order of document, piece and checksum within hash buckets; of pieces that agree in all
    of these either may come first. No pieces give no sequences."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # <= capacity rows
    rows, _ = plan_packing(counts, capacity)
    plan = spark.createDataFrame(rows, "length long, first long, placed long, at_sequence long, fits long, at_offset long")
    plan = plan.groupBy("length").agg(F.collect_list(F.struct("first", "placed", "at_sequence", "fits", "at_offset")).alias("plan"))
    buckets = max(16, -(-sum(counts.values()) // 1_000_000))
    order = [F.col(c) for c in ("doc_id", "piece", "ids_crc32")]
    ranked = numbered(pieces, ["length"], order, "_rank", F.xxhash64("doc_id", "piece", "ids_crc32"), buckets)
    met = ranked.join(F.broadcast(plan), "length")
    part = F.get(F.filter("plan", lambda p: (p.getField("first") <= F.col("_rank")) & (F.col("_rank") < p.getField("first") + p.getField("placed"))), F.lit(0))
    nth = F.col("_rank") - F.col("_part.first")
    fits = F.col("_part.fits")
    found = met.withColumn("_part", part)
    return found.select(
        *pieces.columns,
        (F.col("_part.at_sequence") + F.floor(nth / fits)).cast("long").alias("sequence_id"),
        (F.col("_part.at_offset") + nth % fits * F.col("length")).cast("long").alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, from pack() over pieces that kept their ids. A sequence holds
    at most ``capacity`` tokens, so its group is bounded."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    # binary values are concatenated in order of their offset
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p.getField("ids"))).alias("ids")
    )


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    pieces = tokenize_pieces(docs, vocabulary or vocabulary_path(), capacity, keep_ids=keep_ids)
    return pack(cut(pieces, "pieces"), capacity)


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pack_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
