"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of a text come from its byte histogram, words and lines. Trees are grown level by level on binned features
with logistic loss; the finished ensemble is flattened into arrays, and a batch of documents walks all trees at once as
numpy vectors, one step per level.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgauge.llm.common import cut, frugal, located, settled, table, without_rows, worker_cache

#: Rows that a classifier is fitted on at most (those with the smallest hashes of their id and row): 20 MB of features.
MAX_TRAIN_ROWS = 200_000
#: log2 of the classes of hashes that are taken or left as a whole.
HASH_CLASSES = 12
TREES, DEPTH, BINS, RATE, RIDGE, MIN_WEIGHT = 80, 4, 48, 0.15, 1.0, 2.0
THRESHOLD = 0.3

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "letters", "upper", "digits", "spaces", "beyond_ascii", "marks", "bangs", "pipes",
    "stops", "brackets", "other", "entropy", "log_lines", "line_bytes", "stopped_lines", "distinct_lines", "distinct_words",
    "repeats", "top_word", "short_words", "symbol_words", "upper_words",
)


def _bytes_in(chars: bytes) -> np.ndarray:
    mask = np.zeros(256, bool)
    mask[list(chars)] = True
    return mask


_LOWER, _UPPER = _bytes_in(bytes(range(97, 123))), _bytes_in(bytes(range(65, 91)))
_CLASSES = np.stack(
    [
        _LOWER | _UPPER, _UPPER, _bytes_in(b"0123456789"), _bytes_in(b" \t\n\r\x0b\x0c"), _bytes_in(bytes(range(128, 256))),
        _bytes_in(b"#$%&*~^=_+\\"), _bytes_in(b"!?"), _bytes_in(b"|"), _bytes_in(b".,;:"), _bytes_in(b"<>[]{}()"),
        _bytes_in(b"@/'\"`-"),
    ]
).astype(float)


def statistics(text: bytes | None) -> list[float]:
    """The features of a UTF-8 text, whole; a null text is like an empty one."""
    text = text or b""
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    letters, upper, digits, spaces, high, marks, bangs, pipes, stops, brackets, other = (_CLASSES @ counts).tolist()
    shares = counts[counts > 0] / max(n, 1)
    words = text.split()
    many = max(len(words), 1)
    tally = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    few = max(len(lines), 1)
    size = max(n, 1)
    mixed = sum(c for w, c in tally.items() if not w[-1:].isalpha() and w[-1] < 128 and w[-1] not in b".,;:")
    return [
        math.log1p(n), math.log1p(len(words)), n / many, letters / size, upper / max(letters, 1), digits / size, spaces / size, high / size,
        marks / size, bangs / size, pipes / many, stops / many, brackets / size, other / size, float(-(shares * np.log(shares)).sum()),
        math.log1p(len(lines)), n / few, sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / few, len(set(lines)) / few,
        len(tally) / many, sum(map(eq, words, words[1:])) / many, max(tally.values(), default=0) / many,
        sum(c for w, c in tally.items() if len(w) <= 3) / many, mixed / many, sum(c for w, c in tally.items() if w.isupper() and len(w) > 1) / many,
    ]


def features_of(texts: pa.Array) -> np.ndarray:
    found = [statistics(x.as_py()) for x in texts.cast(pa.binary())]
    return np.array(found, np.float32).reshape(len(found), len(FEATURES))


def train(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """The fitted ensemble as arrays [tree, node]: ``feature`` and ``cut`` of each inner node and the ``value`` of each
    leaf, nodes in heap order (children of i at 2i+1 and 2i+2), and the ``base`` log-odds."""
    n, m = x.shape
    base = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    model = {"feature": np.zeros((TREES, inner), np.int32), "cut": np.full((TREES, inner), np.inf), "value": np.zeros((TREES, leaves)), "base": np.array(base)}
    if n == 0:
        return model
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(m)])  # bin <= k exactly if x <= edges[k]
    margin = np.full(n, base)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, wide = 2**level - 1, 2**level
            best, at = np.full(wide, 1e-6), np.full((wide, 2), -1)
            g_all, h_all = np.bincount(node, grad, wide), np.bincount(node, hess, wide)
            whole = g_all**2 / (h_all + RIDGE)
            for j in range(m):
                if len(edges[j]) == 0:
                    continue
                cell = node * BINS + binned[j]
                g = np.bincount(cell, grad, wide * BINS).reshape(wide, BINS).cumsum(1)
                h = np.bincount(cell, hess, wide * BINS).reshape(wide, BINS).cumsum(1)
                right_g, right_h = g_all[:, None] - g, h_all[:, None] - h
                gain = g**2 / (h + RIDGE) + right_g**2 / (right_h + RIDGE) - whole[:, None]
                gain[(h < MIN_WEIGHT) | (right_h < MIN_WEIGHT)] = 0
                gain = gain[:, : len(edges[j])]
                k = gain.argmax(1)
                top = gain[np.arange(wide), k]
                for i in np.flatnonzero(top > best):
                    best[i], at[i] = top[i], (j, k[i])
            goes_right = np.zeros(n, np.int64)
            for i in range(wide):
                j, k = at[i]
                if j >= 0:
                    model["feature"][t, first + i], model["cut"][t, first + i] = j, edges[j][k]
                    goes_right |= (node == i) & (binned[j] > k)
            node = 2 * node + goes_right
        g, h = np.bincount(node, grad, leaves), np.bincount(node, hess, leaves)
        model["value"][t] = -RATE * g / (h + RIDGE)
        margin += model["value"][t][node]
    return model


def score(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each row of ``x``."""
    trees = np.arange(len(model["feature"]))[None, :]
    out = np.empty(len(x))
    for at in range(0, len(x), 4096):
        part = x[at : at + 4096].astype(np.float64)
        node = np.zeros((len(part), len(model["feature"])), np.int64)
        rows = np.arange(len(part))[:, None]
        for _ in range(DEPTH):
            right = part[rows, model["feature"][trees, node]] > model["cut"][trees, node]
            node = 2 * node + 1 + right
        margin = model["base"] + model["value"][trees, node - (2**DEPTH - 1)].sum(1)
        out[at : at + 4096] = 1 / (1 + np.exp(-margin))
    return out


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is divisible by 5; a null id isn't."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def document_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, file, row, x): each row's place and statistics; nothing but the text goes into x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("quality")  # drops what other operators keep
        for batch in batches:
            x = features_of(batch.column(3))
            values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel(), pa.float32()), len(FEATURES)).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], values], ["doc_id", "file", "row", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    docs, file, row = located(docs)
    rows = docs.select(F.col(id_col).alias("doc_id"), file.alias("file"), row.alias("row"), F.col(text_col).alias("text"))
    return rows.mapInArrow(frugal(run), f"doc_id {kind}, file long, row long, x array<float>")


def _chosen(rows: DataFrame, max_rows: int) -> Column:
    """Which ``rows`` (hash) are taken: all, or those with the least hashes, ``max_rows`` at most and half of that at least.

    Where the line lies is found by counts of classes of hashes, 2^HASH_CLASSES at a time: the first class that doesn't fit
    is divided again. So one class may hold any number of rows. (Only rows with the same hash can't be divided.)"""
    prefix, taken, shift = 0, 0, 64
    while shift >= HASH_CLASSES:
        within = rows if shift == 64 else rows.filter(F.shiftrightunsigned("hash", shift) == prefix)
        shift -= HASH_CLASSES
        counts = within.groupBy(F.shiftrightunsigned("hash", shift).alias("class")).agg(F.count(F.lit(1)).alias("n"))
        line = None
        for r in counts.orderBy("class").collect():  # 2^HASH_CLASSES rows at most
            if taken + r["n"] > max_rows:
                line = r["class"]
                break
            taken += r["n"]
        if line is None:
            return F.lit(True)
        prefix = line
        if 2 * taken >= max_rows:
            break
    return F.shiftrightunsigned("hash", shift) < prefix


def training_rows(features: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = MAX_TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """The statistics and labels of the labelled rows of ``features`` that aren't held out: all, or of more than ``max_rows``
    those with the least hashes, at least half as many as allowed. Which is decided by counts, so no task sees more than its own rows."""
    known = labels.select("doc_id", F.col(label_col).cast("int").alias("label")).filter("doc_id is not null and label is not null")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    rows = features.filter(~held_out()).join(known, "doc_id").withColumn("hash", F.xxhash64("doc_id", "row"))
    got = rows.filter(_chosen(rows, max_rows)).select("hash", "x", "label").toArrow()
    x = got.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, got.column("hash").to_numpy()))
    return x[order], (got.column("label").to_numpy()[order] > 0).astype(float)


def fit(features: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = MAX_TRAIN_ROWS) -> dict[str, np.ndarray]:
    """Train on training_rows(). Rows without a label or id don't count; of several labels of an id the largest counts, and
    each row with the id. Without any row every score is a half."""
    return train(*training_rows(features, labels, label_col, max_rows))


def score_features(features: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """``features`` (doc_id, file, row, x) with ``score`` in place of x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("quality")  # drops what other operators keep
        for batch in batches:
            x = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(score(model, x))], ["doc_id", "file", "row", "score"])

    return features.mapInArrow(frugal(run), f"doc_id {features.schema['doc_id'].dataType.simpleString()}, file long, row long, score double")


@settled("quality")
def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(doc_id, file, row, score): one row per row of ``docs``, whose labels (doc_id, quality) it learns from.

    Null and empty texts are scored like others, texts of any length as a whole, repeated rows each by itself; null ids are
    kept and never learnt from. Further columns of any name aren't looked at. An empty table gives an empty one."""
    features = cut(document_features(docs, id_col, text_col), "features")
    return score_features(features, fit(features, labels, label_col))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score under ``threshold``; same columns. Only scores are written, no text is moved.

    Rows on the threshold stay, and so do rows with null ids that score well; null and empty texts are scored like others,
    repeated rows alike. Without any label every score is a half, so all rows stay. An empty table gives an empty one."""
    docs, file, row = located(docs)
    scored = score_documents(docs, labels, text_col=text_col)
    return without_rows(docs, file, row, scored.filter(F.col("score") < threshold))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
