"""N-gram Jaccard join: every pair of documents whose sets of word shingles are alike, and their components.

Texts with the same set are one node. A node's shingles are ordered by how often their hash bucket occurs in the corpus
(a sketch of fixed size), rare ones first; nodes that are alike share a shingle among the first n - ceil(0.8 n) + 1, so
those prefixes are shuffled by shingle, and shingles that only one node has fall away.

First every node is compared with two hubs of its groups, which joins groups of copies in linear work. What is left are
pairs of nodes in one group but in different components so far: the groups are cut into tiles by size band, and in a tile
the nodes' hashed bitmaps are compared; bits that differ bound the overlap from above. Pairs that pass are settled by
intersecting the sorted shingle arrays. A small tile gives all its pairs at once. Of a larger one the first turns take only
as many pairs as span what could be linked, so that large groups of copies become components in linear work; a last turn
gives every pair that is still between two components. No pair within a component needs to be looked at, and no other is
skipped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkgauge.llm.common import BITMAP_BITS, cut, frugal, located, settled, table, without_rows, worker_cache
from sparkgauge.llm.exact_dedup import _occurs_once, _with_flag
from sparkgauge.llm.graph import components

#: Words in a shingle, and the similarity in percent from which two sets are linked.
SHINGLE, PERCENT = 5, 80
#: log2 of the buckets in which shingles are counted: 4 MB, whatever the input's size.
SKETCH_BITS = 20
#: log2 of the bits in the bitmap of shared prefix keys: 16 MB, whatever the input's size.
ASKED_BITS = 27
#: A task reports the buckets that it met this often, and this many times as often as the mean.
SKETCH_LEAST, SKETCH_TIMES = 8, 4
#: Rows in a tile, and the ratio of sizes in a band: nodes that are alike are in the same band or in neighbouring ones.
TILE, BAND = 1024, 100 / PERCENT
#: Rows up to which a tile gives all its pairs in the first turn.
SMALL = 64
#: Turns in which a tile gives a forest of its pairs, before it gives all that are then left.
FOREST_TURNS = 2
#: Times that sets are named, should two get the same name. Of 10^10 sets some 3 pairs do, and hardly any a second time.
SEEDS = 4
#: Words whose hashes a Python worker remembers.
REMEMBERED_WORDS = 100_000
_MULTIPLIERS = [pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(1, SHINGLE + 1)]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < REMEMBERED_WORDS:
            self[word] = h
        return h


def _kept_hashes() -> dict:
    kept = worker_cache("ngram_join")
    return kept.setdefault("word_hashes", _Hashes())


def shingle_set(text: bytes | None, hashes: dict) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles; of the whole sequence, if it has fewer words."""
    words = (text or b"").lower().split()  # of bytes: A-Z and ASCII white space only
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    k = min(n, SHINGLE)
    s = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        s += w[i : n - k + 1 + i] * np.uint64(_MULTIPLIERS[i])
    s ^= s >> np.uint64(33)
    s *= np.uint64(0xFF51AFD7ED558CCD)
    s ^= s >> np.uint64(29)
    return np.unique(s)


def bitmap_of(own: np.ndarray) -> np.ndarray:
    """The set's hashed bitmap: a bit is set if an odd number of shingles fall on it, so that differing bits of two sets
    never outnumber their differing shingles. One or two bits a shingle, 128 at least."""
    bits = 1 << max(7, (len(own) - 1).bit_length())
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.uint64)


def folded(bitmap: np.ndarray, words: int) -> np.ndarray:
    """The bitmap of the same set with fewer bits."""
    while len(bitmap) > words:
        half = len(bitmap) // 2
        bitmap = bitmap[:half] ^ bitmap[half:]
    return bitmap


def could_be_alike(n, m, differ):
    """Whether sets of n and m shingles whose bitmaps differ in so many bits can be linked: sizes must be near, and as
    |a & b| <= (n + m - differ) / 2, alike means (100 + PERCENT) |a & b| >= PERCENT (n + m)."""
    near = np.minimum(n, m) * 100 >= PERCENT * np.maximum(n, m)
    return near & ((100 + PERCENT) * (n + m - differ) >= 2 * PERCENT * (n + m))


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def shingle_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """(id, file, row, n, node, check, shingles): a row per row of ``docs``. ``file`` and ``row`` are its place, ``node`` and
    ``check`` the halves of a 128-bit hash of the set, null for an empty one; a task gives the shingles of a node once only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = _kept_hashes(), set()
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                sizes, nodes, checks, sets = [], [], [], []
                for text in batch.column(3).cast(pa.binary()):
                    own = shingle_set(text.as_py(), hashes)
                    data = own.tobytes()
                    both = xxhash.xxh3_128_intdigest(data, seed)
                    node = _signed(both & ((1 << 64) - 1)) if len(own) else None
                    sizes.append(len(own))
                    nodes.append(node)
                    checks.append(_signed(both >> 64) if len(own) else None)
                    sets.append(None if node is None or node in seen else data)
                    seen.add(node)
                made = [pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(checks, pa.int64()), pa.array(sets, pa.binary())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], ["id", "file", "row", "n", "node", "check", "shingles"])

    kind = docs.schema[id_col].dataType.simpleString()
    docs, file, row = located(docs)
    rows = docs.select(F.col(id_col).alias("id"), file.alias("file"), row.alias("row"), F.col(text_col).alias("text"))
    return rows.mapInArrow(frugal(run), f"id {kind}, file long, row long, n long, node long, check long, shingles binary")


def _sketch(sets: DataFrame) -> np.ndarray:
    """How often each hash bucket occurs, 0 for those that aren't frequent. Of fixed size."""
    size, least, times = 1 << SKETCH_BITS, SKETCH_LEAST, SKETCH_TIMES  # as the driver has them

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column(0):
                own = np.frombuffer(x.as_py(), np.uint64) >> np.uint64(64 - SKETCH_BITS)
                if len(own) > size // 16:
                    counts += np.bincount(own.astype(np.int64), minlength=size)
                else:
                    np.add.at(counts, own.astype(np.int64), 1)
        often = np.flatnonzero(counts >= max(least, times * counts.mean()))
        yield pa.RecordBatch.from_arrays([pa.array(often, pa.int64()), pa.array(counts[often], pa.int64())], ["bucket", "times"])

    found = sets.select("shingles").mapInArrow(frugal(run), "bucket long, times long").groupBy("bucket").agg(F.sum("times").alias("times"))
    counts = np.zeros(size, np.uint32)
    for r in found.toLocalIterator():  # at most 2^SKETCH_BITS rows
        counts[r["bucket"]] = min(r["times"], (1 << 32) - 1)
    return counts


def _prefixes(sets: DataFrame, counts, asked=None) -> DataFrame:
    """(key, node, n): the shingles of each node's prefix; of those, if ``asked`` is given, the ones whose bit is set there.
    ``counts`` is the broadcast sketch, ``asked`` a broadcast bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = counts.value
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                keys, nodes, sizes = [], [], []
                for node, x in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    own = np.frombuffer(x.as_py(), np.uint64)
                    n = len(own)
                    first = n - -(-n * PERCENT // 100) + 1
                    rank = often[(own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                    kept = own[np.lexsort((own, rank))[:first]]
                    if asked is not None:
                        spot = (kept & np.uint64((1 << ASKED_BITS) - 1)).astype(np.int64)
                        kept = kept[(asked.value[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 > 0]
                    keys.append(kept)
                    nodes.append(np.full(len(kept), node, np.int64))
                    sizes.append(np.full(len(kept), n, np.int32))
                if keys:
                    columns = [np.concatenate(keys).view(np.int64), np.concatenate(nodes), np.concatenate(sizes)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "node", "n"])

    return sets.select("node", "shingles").mapInArrow(frugal(run), "key long, node long, n int")


def _bits_of(keys: DataFrame) -> np.ndarray:
    """The bitmap of the keys' low bits as bytes."""
    found = np.zeros(1 << (ASKED_BITS - 3), np.uint8)
    size = BITMAP_BITS // 8
    for r in _occurs_once(keys, "key", ASKED_BITS).toLocalIterator():
        found[r["_part"] * size : (r["_part"] + 1) * size] = np.frombuffer(r["_bitmap"], np.uint8)
    return found


def _bitmaps(sets: DataFrame) -> DataFrame:
    """(node, n, bitmap) for the rows of ``sets``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = [bitmap_of(np.frombuffer(x.as_py(), np.uint64)).tobytes() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(maps, pa.binary())], ["node", "n", "bitmap"])

    return sets.select("node", "n", "shingles").mapInArrow(frugal(run), "node long, n long, bitmap binary")


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted distinct arrays are linked, by their exact intersection."""
    if min(len(a), len(b)) * 100 < PERCENT * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are alike. ``sets``: (node, shingles), one row a node."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    full = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [
                alike(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64))
                for x, y in zip(batch.column(2), batch.column(3), strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return full.mapInArrow(frugal(run), "a long, b long")


def _sets_of(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``sets`` for ``nodes`` (node), once each. A bitmap of fixed size stops most others where they are read,
    so that only the sets in question are shuffled."""
    marked = _with_flag(sets.select("node", "shingles"), F.xxhash64("node"), _occurs_once(nodes.select(F.xxhash64("node").alias("k")), "k"), "_asked")
    return marked.filter("_asked").select("node", "shingles").dropDuplicates(["node"])


def _possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sizes and bitmaps allow a link. ``nodes``: (node, n, bitmap)."""
    for end in "ab":
        own = nodes.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("bitmap").alias(f"map_{end}"))
        pairs = pairs.join(own, end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            differ = np.zeros(len(batch), np.int64)
            for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                words = min(len(x), len(y))
                differ[i] = np.bitwise_count(folded(x, words) ^ folded(y, words)).sum(dtype=np.int64)
            good = could_be_alike(batch.column(2).to_numpy(), batch.column(3).to_numpy(), differ)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    near = (F.least("n_a", "n_b") * 100) >= (F.greatest("n_a", "n_b") * PERCENT)
    return pairs.filter(near).select("a", "b", "n_a", "n_b", "map_a", "map_b").mapInArrow(frugal(run), "a long, b long")


def _checked(pairs: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """The links among ``pairs``: bitmaps first, then the sets of those that are left."""
    left = cut(_possible(pairs, nodes), "possible-pairs")
    return _verified(left, cut(_sets_of(sets, left.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "pair-sets"))


def _and_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def _tile_pairs(tiles: DataFrame, turn: int | None) -> DataFrame:
    """(a, b, key, band): pairs, a < b, in each tile (columns key, band, low, high; rows node, n, comp, chunk, home, bitmap) that differ
    in ``comp``, could be alike by size, and whose bitmaps allow the overlap. A small tile gives all of them; a larger one,
    with a ``turn``, a forest, which spans what they join and has fewer pairs than the tile has rows (turns differ in which
    pairs they take). ``key`` and ``band`` say where a pair was found. Tiles come one after the other in the sorted rows of a partition; one of them is held at a time."""
    tile, small = ["key", "band", "low", "high"], SMALL

    def pairs_in(rows: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
        node, n, comp, chunk, home, low, high = (rows.column(c).to_numpy() for c in ("node", "n", "comp", "chunk", "home", "low", "high"))
        maps = [np.frombuffer(x.as_py(), np.uint64) for x in rows.column("bitmap")]
        wide = np.array([len(x) for x in maps])
        folds = {w: np.stack([folded(x, w) if len(x) >= w else np.zeros(w, np.uint64) for x in maps]) for w in set(wide.tolist())}
        n = n.astype(np.int64)
        a_out, b_out = [], []
        place, root = np.arange(len(node)), comp.copy()
        rows_of = np.flatnonzero(chunk == low[0])
        forest = turn is not None and len(node) > small
        for i in rows_of[::-1] if forest and turn % 2 else rows_of:
            other = (chunk == high[0]) & (root != root[i]) & ((home | home[i]) > 0) & could_be_alike(n, n[i], 0)
            if low[0] == high[0] and not forest:
                other &= place > i
            j = np.flatnonzero(other)
            if len(j):
                differ, least = np.empty(len(j), np.int64), np.minimum(wide[j], wide[i])
                for w in set(least.tolist()):  # in as many bits as the smaller of two has
                    own = least == w
                    differ[own] = np.bitwise_count(folds[w][j[own]] ^ folds[w][i]).sum(1, dtype=np.int64)
                j = j[could_be_alike(n[j], n[i], differ)]
                if forest:
                    taken = []
                    while len(j):
                        taken.append(j[-1 if turn % 2 else 0])
                        root[root == root[taken[-1]]] = root[i]
                        j = j[root[j] != root[i]]
                    j = np.array(taken, np.int64)
                a_out.append(np.minimum(node[j], node[i]))
                b_out.append(np.maximum(node[j], node[i]))
        return a_out, b_out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in _and_end(batches):
            new = [] if batch is None else [pa.Table.from_batches([batch])]
            old = [] if held is None else [held]
            if not new + old:
                return
            rows = pa.concat_tables(old + new).combine_chunks()
            keys = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in tile])
            starts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), len(rows)]
            done = len(starts) - 1 if batch is None else len(starts) - 2  # the last tile may go on in the next batch
            found = []
            for start, end in zip(starts[:done], starts[1 : done + 1], strict=True):
                if end - start > 1:
                    for a, b in zip(*pairs_in(rows.slice(start, end - start)), strict=True):
                        found.append((a, b, *[np.full(len(a), k) for k in keys[:2, start]]))
            held = rows.slice(starts[done])
            if found:
                columns = [pa.array(np.concatenate(x), pa.int64()) for x in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns[:3], columns[3].cast(pa.int32())], ["a", "b", "key", "band"])

    dealt = tiles.repartition(*tile).sortWithinPartitions(*tile)
    return dealt.select(*tile, "node", "n", "comp", "chunk", "home", "bitmap").mapInArrow(frugal(run), "a long, b long, key long, band int")


def _residual_pairs(groups: DataFrame, comps: DataFrame, nodes: DataFrame, turn: int | None, places: DataFrame | None) -> DataFrame:
    """(a, b, key, band): pairs of nodes that share a key of ``groups`` (key, node, n, size) but not a component of ``comps``
    (node, comp), and that bitmaps don't rule out: all of them, or in a ``turn`` a forest in each tile that isn't small.

    A small group is one tile, and turn 0 does it. Of the large ones, later turns only look at the ``places`` (key, band) in
    which turn 0 found pairs: where it found none there is none."""
    if turn != 0:
        groups = groups.filter(F.col("size") > SMALL).join(places.select("key").distinct(), "key")
    rows = groups.select("key", "node", "n", "size").join(comps, "node")
    rows = cut(rows, "group-comps")
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(BAND) + 1e-9).cast("int")
    homed = rows.filter(F.col("size") > SMALL).drop("size").withColumn("band", band)
    banded = homed.withColumn("home", F.lit(1)).unionByName(homed.withColumn("band", F.col("band") + 1).withColumn("home", F.lit(0)))
    if turn != 0:
        banded = banded.join(places, ["key", "band"])
    spans = banded.groupBy("key", "band").agg(
        F.count(F.lit(1)).alias("rows"), F.max("home").alias("homes"), F.min("comp").alias("lo"), F.max("comp").alias("hi")
    )
    spans = spans.filter("homes = 1 and lo < hi").select("key", "band", F.ceil(F.col("rows") / TILE).cast("int").alias("chunks"))
    dealt = banded.join(cut(spans, "spans"), ["key", "band"]).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    tiled = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tiled = tiled.withColumn("low", F.least("chunk", "other")).withColumn("high", F.greatest("chunk", "other")).drop("chunks", "other")
    if turn == 0:
        whole = {"band": -1, "home": 1, "chunk": 0, "low": 0, "high": 0}
        tiled = tiled.unionByName(rows.filter(F.col("size") <= SMALL).drop("size").withColumns({k: F.lit(v) for k, v in whole.items()}))
    return _tile_pairs(tiled.join(nodes.select("node", "bitmap"), "node"), turn)


def _groups(sets: DataFrame) -> DataFrame:
    """(key, node, n, size, low, high) of the keys that ``size`` nodes from low to high share, two or more; of keys with the
    same nodes, one.

    Which keys are shared is found by an aggregate, in which no hot key meets in one task; a bitmap of them then stops most
    other keys where they are made."""
    spark = sets.sparkSession
    sketch = spark.sparkContext.broadcast(_sketch(sets))
    ends = _prefixes(sets, sketch).groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    asked = spark.sparkContext.broadcast(_bits_of(cut(ends.filter("low < high").select("key"), "shared-keys")))
    shared = cut(_prefixes(sets, sketch, asked).distinct(), "shared-rows")
    # Their number, least, greatest and sum (without carry) of hashes say which nodes a key has.
    told = [F.count(F.lit(1)).alias("size"), F.min("node").alias("low"), F.max("node").alias("high"), F.bit_xor(F.xxhash64("node")).alias("sum")]
    alike = shared.groupBy("key").agg(*told).filter("size > 1")
    kept = alike.groupBy("size", "low", "high", "sum").agg(F.min("key").alias("key"))
    kept = cut(kept.select("key", "size", "low", "high"), "kept-keys")
    likely = _with_flag(shared, F.col("key"), _occurs_once(kept, "key"), "_kept").filter("_kept").drop("_kept")
    return cut(likely.join(kept, "key"), "groups")


def similar_groups(shingled: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of ``shingled`` (a table that shingle_table() made) that share a key with another one."""
    sets = shingled.filter("shingles is not null")
    groups = _groups(sets)
    shared = cut(groups.select("node").distinct(), "shared-nodes")
    nodes = cut(_bitmaps(sets).join(shared, "node", "left_semi").dropDuplicates(["node"]), "nodes")
    hubs = groups.groupBy("node").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    pairs = hubs.select(F.explode(F.array("low", "high")).alias("hub"), "node").filter("hub <> node")
    pairs = cut(pairs.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct(), "hub-pairs")
    roots = components(cut(_checked(pairs, nodes, sets), "hub-links"))
    comps = shared.join(roots, F.col("node") == F.col("v"), "left").select("node", F.coalesce("root", "node").alias("comp"))
    comps = cut(comps, "comps")
    places = None
    for turn in (*range(FOREST_TURNS), None):
        found = cut(_residual_pairs(groups, comps, nodes, turn, places), "tile-pairs")
        if turn == 0:
            places = cut(found.filter("band >= 0").select("key", "band").distinct(), "tile-places")
        more = cut(found.select("a", "b").distinct(), "more-pairs")
        asked = more.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        more = cut(_verified(more, cut(_sets_of(sets, asked), "pair-sets")), "more-links")
        if not more.isEmpty():
            comps = cut(_joined(comps, more), "comps")
        if places.isEmpty():
            break
    return comps


def _joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """``comps`` (node, comp) after the components that ``links`` (a, b) connect have become one."""
    ends = links.join(comps.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a")
    ends = ends.join(comps.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b")
    tops = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")).filter("a <> b"))
    joined = comps.join(tops, F.col("comp") == F.col("v"), "left")
    return joined.select("node", F.coalesce("root", "comp").alias("comp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id): one row per row of ``docs``.

    Two rows are linked when their sets of 5-word shingles (words are runs of anything but ASCII white space, A-Z
    lower-cased; a text of fewer words is one shingle) have a Jaccard similarity of 0.8 or more; ``component_id`` is the
    smallest id that a row reaches by links. Null and empty texts have no shingles and stay alone. A null id is never a
    component's id, unless all of the component's are null; repeated rows link with each other. Texts of any length are read
    whole, further columns of any name aren't looked at, and an empty table gives an empty one. Sets are sets of 64-bit
    hashes, and equal sets are known by a 128-bit hash: nodes are named by half of it, and named anew should different sets
    get one name.
    """
    return _placed(docs, id_col, text_col).drop("file", "row")


@settled("components")
def _placed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, file, row, n_shingles, component_id) for each row of ``docs``."""
    for seed in range(SEEDS):
        shingled = cut(shingle_table(docs, id_col, text_col, seed), "shingles")
        classes = shingled.filter("node is not null").groupBy("node").agg(F.min("id").alias("least_id"), (F.min("check") < F.max("check")).alias("mixed"))
        classes = cut(classes, "sets")
        if classes.filter("mixed").isEmpty():
            break
    classes = classes.select("node", "least_id")
    comps = similar_groups(shingled)
    known = cut(classes.join(comps, "node", "left").select("node", "least_id", F.coalesce("comp", "node").alias("comp")), "classes")
    tops = known.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    homes = cut(known.join(cut(tops, "component-ids"), "comp").select("node", "component_id"), "node-components")
    own = ["id", "file", "row"]
    empty = shingled.filter("node is null").select(*own, F.lit(0).cast("long").alias("n_shingles"), F.col("id").alias("component_id"))
    rest = shingled.filter("node is not null").join(homes, "node").select(*own, F.col("n").alias("n_shingles"), "component_id")
    return rest.unionByName(empty)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, that with the smallest id (of rows that repeat it, the one whose place in the
    stored table comes first); rows without shingles (null, empty, white space alone) all stay, and so does a component without an id. Same columns; an
    empty table gives an empty one."""
    docs, file, row = located(docs)
    linked = _placed(docs, id_col, text_col).filter("n_shingles > 0 and component_id is not null")
    first = linked.groupBy("component_id").agg(F.min(F.when(F.col("id") == F.col("component_id"), F.struct("file", "row"))).alias("keep"))
    gone = linked.join(first, "component_id").filter(F.struct("file", "row") != F.col("keep")).select("file", "row")
    return without_rows(docs, file, row, gone)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + least(5, len(w)) - 1], ' ') AS said
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS p FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.said = y.said AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)
), reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) r USING (doc_id)
"""
