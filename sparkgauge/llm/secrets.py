"""Secret scans: fixed patterns, and strings that a tokenizer can't shorten.

Prose and code take few tokens for their length, since a byte-pair vocabulary has learnt their parts; random strings take
many. A run of key-like characters with fewer than MIN_RATIO characters per token is reported as ``random``, unless it is
a known digest, a UUID, a number or an identifier of delimited words, or lies in a span that a pattern has found. Whether
letters make words is left to the tokenizer, so keys of few or no digits are found too.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgauge.llm.common import settled, table, worker_cache

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: The same matches that are long enough: a maximal run of 24 or more, found without a match for every short run.
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
MIN_VALUE, MIN_ACCESS = 6, 20
#: Key-like runs. What they touch doesn't matter: a key may stand right after a word of a script without spaces.
RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
MIN_RATIO = 2.0
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: Hexadecimal digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGESTS = {32, 40, 56, 64, 96, 128}
#: What divides an identifier or a path into its parts; parts up to SHORT_PART are too short to be judged.
DELIMITERS = re.compile(r"[+/_=-]+")
SHORT_PART = 2


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of what the fixed patterns find, leftmost and without overlap within a kind."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    found += [("hex", m.start(), m.end()) for m in LONG_HEX.finditer(text)]
    return found


def tokens(run: str, encoding) -> int:
    """Tokens of a whole run, however long."""
    return len(encoding.encode_ordinary(run))


def excluded(run: str, encoding) -> bool:
    """Whether a run is a known digest, a UUID, a number or an identifier: delimited parts that are all numbers or words."""
    if not any(c.isalpha() for c in run):
        return True
    if UUID.fullmatch(run) or (len(run) in DIGESTS and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", run)):
        return True
    parts = [p for p in DELIMITERS.split(run) if p]
    return len(parts) > 1 and all(len(p) <= SHORT_PART or p.isdigit() or len(p) >= MIN_RATIO * tokens(p, encoding) for p in parts)


def random_spans(text: str, encoding, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    found, covered, at = [], [], 0
    for _, start, end in sorted(taken, key=lambda s: s[1:]):
        if covered and start <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], end)
        else:
            covered.append([start, end])
    for m in RUN.finditer(text):
        start, end = m.span()
        while at < len(covered) and covered[at][1] <= start:
            at += 1
        if at < len(covered) and covered[at][0] < end:
            continue
        if len(m[0]) < MIN_RATIO * tokens(m[0], encoding) and not excluded(m[0], encoding):
            found.append(("random", start, end))
    return found


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _encoding(path: str, pattern: str):
    """The tiktoken encoding, kept in the worker process from task to task."""
    kept = worker_cache("secrets")
    if path not in kept:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        kept[path] = tiktoken.Encoding("scan", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return kept[path]


@settled("secrets")
def scan_secrets(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): one row per row of ``docs``; spans is an array of (kind, start, end) in code points of the whole
    text, by start and then kind. A null or empty text has none; repeated rows and null ids are rows like others, texts and
    runs of any length are read whole, further columns of any name aren't looked at, and an empty table gives an empty one."""
    import public_tokenizers

    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    pattern = public_tokenizers.PATTERN
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(vocabulary, pattern)
        for batch in batches:
            every = []
            for text in batch.column(1):
                text = text.as_py() or ""
                spans = base_spans(text)
                spans += random_spans(text, encoding, spans)
                every.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in in_order(spans)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(every, pa.list_(span))], ["doc_id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>"
    )


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s.getField("kind") == kind)).cast("long").alias(f"n_{kind}")

    def told(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.getField("kind"), s.getField("start"), s.getField("end"))), ",")

    base = F.filter("spans", lambda s: s.getField("kind") != "random")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(F.encode(told(base), "UTF-8"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans")
    )
