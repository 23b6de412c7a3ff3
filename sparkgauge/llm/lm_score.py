"""LM scoring with a weighted backoff automaton.

A trigram model with Dirichlet smoothing (each order adds PRIOR times the lower order's probability to its counts) is a
weighted automaton: a state for each context that training has seen (two words, one word, none), an arc for each n-gram
seen, with its smoothed probability, and from each state a failure arc to the context without its first word, with the
weight that the state's arcs leave. A document is one walk from left to right: take the arc of the next word, or follow
failure arcs until a state has one; the arc leads to the longest context seen that ends in the word.

No n-gram is dropped, at any size, so the whole automaton may be larger than any memory. Therefore documents are dealt to
blocks of some BLOCK_TOKENS tokens. A block needs only the part of the automaton that its own n-grams touch, and that is
as large as the block:

1. each block is written as one row: its documents as numbers of its own words;
2. its distinct n-grams, as 64-bit hashes with how often its training documents have them, are shuffled by ranges of the
   hash and summed over all blocks; how often the others have them is written back. Bigrams go first, then trigrams;
3. documents and counts meet by block, which builds its part of the automaton and walks it.

A hash goes to one range however often it occurs, with one row per block at most: a frequent word costs its range as many rows
as there are blocks, not as many as it has occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgauge.llm.common import cut, settled, table, worker_cache

#: The token that ends a document, and what is before its first word; no word holds a space or is empty.
END, START = b" ", b""
#: What a context of one word and of two words adds of the lower order's probability, in occurrences.
PRIOR = {2: 500.0, 3: 5.0}
#: Tokens in a block (a longer document is a block by itself), n-grams in a range, and blocks that are read at once.
BLOCK_TOKENS, RANGE_GRAMS, BLOCKS_READ = 1 << 20, 1 << 21, 8
#: Words whose hashes a Python worker remembers.
REMEMBERED_WORDS = 200_000
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD)]


def _hash_of(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) & ~3 | 1


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = _hash_of(word)
        if len(self) < REMEMBERED_WORDS:
            self[word] = h
        return h


def tokens_of(text: bytes | None) -> list[bytes]:
    """Words (of bytes, so that only A-Z is lower-cased and only ASCII white space splits) and one END."""
    words = (text or b"").lower().split()
    words.append(END)
    return words


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 7; a null id doesn't."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 7 == 2, F.lit(False))


def _mixed(x: np.ndarray, order: int) -> np.ndarray:
    """Hashes whose two low bits say the order of the n-gram."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M[3]
    x ^= x >> np.uint64(29)
    return x & np.uint64((1 << 64) - 4) | np.uint64(order)


class Grams:
    """The n-grams of a block of documents: ``words`` (hashes, documents one after the other), ``lengths`` in tokens.

    ``of[k]`` are the sorted distinct hashes of order k, ``at[k]`` says which of them ends at a token (-1: none, as no
    trigram ends at a document's first token), ``seen[k]`` a token at which each of them ends.
    """

    def __init__(self, words: np.ndarray, lengths: np.ndarray, orders: tuple[int, ...] = (1, 2, 3)):
        n = len(words)
        self.starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
        self.first = np.zeros(n, bool)
        self.first[self.starts] = True
        before = np.concatenate((words[:1], words[:-1]))
        before[self.starts] = np.uint64(_hash_of(START))
        self.of, self.at, self.seen = {}, {}, {}
        for order in orders:
            if order == 1:
                hashes = words
            elif order == 2:
                hashes = _mixed(before * _M[0] + words * _M[1], 2)
            else:
                further = np.concatenate((before[:1], before[:-1]))
                hashes = _mixed(further * _M[0] + before * _M[1] + words * _M[2], 3)[~self.first]
            self.of[order], self.seen[order], self.at[order] = np.unique(hashes, return_index=True, return_inverse=True)
            if order == 3:
                rest = np.flatnonzero(~self.first)
                every = np.full(n, -1)
                every[rest] = self.at[3]
                self.seen[3], self.at[3] = rest[self.seen[3]], every

    def counts(self, order: int, training: np.ndarray) -> np.ndarray:
        """How often the block's ``training`` tokens (a mask) end in each n-gram of the order."""
        use = training & ~self.first if order == 3 else training
        return np.bincount(self.at[order][use], minlength=len(self.of[order]))


class Automaton:
    """The part of the automaton that a block's n-grams touch. States: 0 is the empty context, then one for each word of the
    block (END's is the context before a first word), then one for each of its bigrams."""

    def __init__(self, grams: Grams, totals: dict[int, np.ndarray], n: int, v: int):
        self.grams, self.totals = grams, totals
        n_words, n_pairs = len(grams.of[1]), len(grams.of[2])
        end = int(np.searchsorted(grams.of[1], np.uint64(_hash_of(END))))
        self.start = 1 + end if totals[1][end] else 0
        alone = (totals[1] + 1) / (n + v + 1)
        self.alone = np.log10(alone)
        # how often a state is a context: each word but END is followed by one, and a start by one
        uses = np.concatenate(([0], totals[1], totals[2])).astype(float)
        prior = np.concatenate(([1.0], np.full(n_words, PRIOR[2]), np.full(n_pairs, PRIOR[3])))
        self.fail_weight = np.log10(prior / (uses + prior))
        last = grams.at[1][grams.seen[2]]  # a bigram's second word
        self.fail = np.concatenate(([0], np.zeros(n_words, np.int64), 1 + last))
        context = np.where(grams.first, 1 + end, 1 + np.concatenate(([0], grams.at[1][:-1])))  # the state of the word before
        at = grams.seen[2]
        two = (totals[2] + PRIOR[2] * alone[last]) / (uses[context[at]] + PRIOR[2])
        at = grams.seen[3]
        pair = 1 + n_words + grams.at[2][at - 1]
        three = (totals[3] + PRIOR[3] * two[grams.at[2][at]]) / (uses[pair] + PRIOR[3])
        self.arcs = {1: self.alone, 2: np.log10(two), 3: np.log10(three)}
        #: the state that a bigram's second word leads to: the longest context that training has seen
        self.into = np.where(totals[2] > 0, 1 + n_words + np.arange(n_pairs), np.where(totals[1][last] > 0, 1 + last, 0))

    def walk(self) -> tuple[np.ndarray, np.ndarray]:
        """log10 of each token's probability by the model and by the empty context alone.

        The state that a token is read in is what the arc of the token before led to. It doesn't depend on how many failure
        arcs were followed there, so all states of the walks are known at once, and one hop is taken for all tokens."""
        grams, n_words = self.grams, len(self.grams.of[1])
        state = np.where(grams.first, self.start, np.concatenate(([0], self.into[grams.at[2][:-1]])))
        weight = np.zeros(len(state))
        for order in (3, 2):
            here = np.flatnonzero(state > n_words if order == 3 else state > 0)
            arc = grams.at[order][here]
            found = self.totals[order][arc] > 0
            weight[here[found]] += self.arcs[order][arc[found]]
            lost = here[~found]
            weight[lost] += self.fail_weight[state[lost]]
            state[lost] = self.fail[state[lost]]
            state[here[found]] = -1  # the token has been read
        alone = self.alone[grams.at[1]]
        weight[state == 0] += alone[state == 0]
        return weight, alone


def _narrow(x: np.ndarray) -> bytes:
    """Numbers >= 0 in as few bytes each as the largest needs."""
    wide = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide]).tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    found = np.zeros((n, 8), np.uint8)
    if n:
        found[:, : len(data) // n] = np.frombuffer(data, np.uint8).reshape(n, -1)
    return found.view("<u8").ravel()


def _batch(rows: list[tuple], fields: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(fields.values())], list(fields))


def _blocks(docs: DataFrame, tokens_in_block: int) -> DataFrame:
    """(block, ids, held, lengths, words, data): the blocks of ``docs`` (doc_id, text, held_out). ``words`` are the sorted
    hashes of a block's words, ``data`` its tokens as numbers of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = worker_cache("lm_score").setdefault("word_hashes", _Hashes())
        block, held, size, fields = TaskContext.get().partitionId() << 32, [], 0, {}

        def told() -> pa.RecordBatch:
            ids, out, own = zip(*held, strict=True)
            words, data = np.unique(np.concatenate(own), return_inverse=True)
            return _batch([(block, ids, out, [len(x) for x in own], words.tobytes(), _narrow(data))], fields)

        for batch in batches:
            fields = {"block": pa.int64(), "ids": pa.list_(batch.column(0).type), "held": pa.list_(pa.bool_()), "lengths": pa.list_(pa.int64()), "words": pa.binary(), "data": pa.binary()}
            for doc_id, text, out in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), strict=True):
                tokens = tokens_of(text.as_py())
                if held and size + len(tokens) > tokens_in_block:
                    yield told()
                    block, held, size = block + 1, [], 0
                held.append((doc_id, out, np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))))
                size += len(tokens)
        if held:
            yield told()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "held_out").mapInArrow(run, f"block long, ids array<{kind}>, held array<boolean>, lengths array<long>, words binary, data binary")


def _read(lengths: list[int], words: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a block's tokens, and its documents' lengths."""
    lengths = np.array(lengths)
    return np.frombuffer(words, np.uint64)[_wide(data, lengths.sum()).astype(np.int64)], lengths


def _by_range(blocks: DataFrame, orders: tuple[int, ...], ranges: int) -> DataFrame:
    """(range, block, at, first, n, gaps, counts): the n-grams of the ``orders`` of each block, in rows for each range of
    hashes. A row has the ``first`` hash and the gaps between the sorted hashes; ``at`` is its place among the block's."""
    fields = {"range": pa.int64(), "block": pa.int64(), "at": pa.int64(), "first": pa.int64(), "n": pa.int64(), "gaps": pa.binary(), "counts": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, held, *rest in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                words, lengths = _read(*rest)
                grams = Grams(words, lengths, orders)
                training = np.repeat(~np.array(held, bool), lengths)
                place, out = 0, []
                for order in orders:
                    own, counts = grams.of[order], grams.counts(order, training)
                    to = ((own >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
                    ends = [0, *(np.flatnonzero(to[1:] != to[:-1]) + 1).tolist(), len(own)]
                    gaps = np.concatenate((own[:1] * np.uint64(0), own[1:] - own[:-1]))
                    gaps[ends[:-1] if len(own) else []] = 0
                    for a, b in zip(ends[:-1], ends[1:], strict=True):
                        if b > a:
                            out.append((to[a], block, place + a, int(own[a]) - (1 << 63), b - a, _narrow(gaps[a:b]), _narrow(counts[a:b])))
                    place += len(own)
                for i in range(0, len(out), 64):
                    yield _batch(out[i : i + 64], fields)

    return blocks.select("block", "held", "lengths", "words", "data").mapInArrow(run, "range long, block long, at long, first long, n long, gaps binary, counts binary")


def _others(by_range: DataFrame) -> DataFrame:
    """(block, at, n, others): how often other blocks' training documents have a block's n-grams from ``at`` on; and for each
    range a row with a null block, whose n and at are the training tokens and the distinct training words of the range."""
    fields = {"block": pa.int64(), "at": pa.int64(), "n": pa.int64(), "others": pa.binary()}

    def summed(rows: list[tuple]) -> pa.RecordBatch:
        hashes, counts = [], []
        for _, _, first, n, gaps, own in rows:
            steps = _wide(gaps, n)
            steps[0] = first + (1 << 63)
            hashes.append(np.cumsum(steps, dtype=np.uint64))
            counts.append(_wide(own, n).astype(np.int64))
        hashes, counts = np.concatenate(hashes), np.concatenate(counts)
        order = np.argsort(hashes, kind="stable")
        ranked = hashes[order]
        starts = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
        sums = np.add.reduceat(counts[order], starts)
        every = np.empty_like(counts)
        every[order] = np.repeat(sums, np.diff(np.append(starts, len(ranked))))
        words = (ranked[starts] & np.uint64(3)) == 1
        out, place = [(None, int((sums[words] > 0).sum()), int(sums[words].sum()), None)], 0
        for block, at, _, n, _, _ in rows:
            out.append((block, at, n, _narrow((every - counts)[place : place + n])))
            place += n
        return _batch(out, fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for own, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and own != now:
                    yield summed(held)
                    held = []
                now = own
                held.append(tuple(row))
        if held:
            yield summed(held)

    dealt = by_range.repartition("range").sortWithinPartitions("range")
    return dealt.select("range", "block", "at", "first", "n", "gaps", "counts").mapInArrow(run, "block long, at long, n long, others binary")


def _walked(rows: DataFrame, n: int, v: int) -> DataFrame:
    """The scores of the documents in ``rows``: blocks, and after each of them (``order`` > 0) the counts of the others."""
    kind = rows.schema["ids"].dataType.elementType.simpleString()

    def scores(block: tuple, pieces: list, id_type: pa.DataType) -> pa.RecordBatch:
        ids, held, *rest = block
        words, lengths = _read(*rest)
        grams, totals = Grams(words, lengths), {}
        training = np.repeat(~np.array(held, bool), lengths)
        others = {1: [], 3: []}
        for order, _, size, data in sorted(pieces, key=lambda p: p[:2]):
            others[order].append(_wide(data, size).astype(np.int64))
        every = np.concatenate([np.empty(0, np.int64), *others[1], *others[3]])
        ends = np.cumsum([len(grams.of[k]) for k in (1, 2, 3)])
        for order, own in zip((1, 2, 3), np.split(every, ends[:-1]), strict=True):
            totals[order] = own + grams.counts(order, training)
        weight, alone = Automaton(grams, totals, n, v).walk()
        known = totals[1][grams.at[1]] > 0
        sums = [np.add.reduceat(x, grams.starts) for x in (known.astype(np.int64), alone, weight)]
        columns = [pa.array(ids, id_type), pa.array(held, pa.bool_()), pa.array(lengths, pa.int64()), *map(pa.array, sums)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, pieces, id_type = None, None, [], pa.null()
        for batch in batches:
            id_type = batch.column(5).type.value_type
            for own, order, at, size, others, *documents in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if own != now:
                    if block:
                        yield scores(block, pieces, id_type)
                    now, pieces = own, []
                if order:
                    pieces.append((order, at, size, others))
                else:
                    block = documents
        if block:
            yield scores(block, pieces, id_type)

    dealt = rows.repartition("block").sortWithinPartitions("block", "order")
    return dealt.select("block", "order", "at", "n", "others", "ids", "held", "lengths", "words", "data").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )


@settled("lm-scores")
def lm_scores(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: Column | None = None, block_tokens: int = BLOCK_TOKENS, range_grams: int = RANGE_GRAMS
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row per row of ``docs``.

    Tokens are the words (runs of anything but ASCII white space, A-Z lower-cased) and one end. The model learns from the
    rows that aren't ``held``. ``base_score`` is the add-one unigram model's log10 probability, ``score`` the automaton's. A
    null text is like an empty one: an end alone. Without any training row every token is unknown and has probability 1.
    Repeated rows count each, null ids are kept, texts of any length are walked as a whole; further columns of any name
    aren't looked at, and an empty table gives an empty one. Words and n-grams are known by 62-bit hashes.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (held if held is not None else F.lit(False)).alias("held_out"))
    blocks = cut(_blocks(rows, block_tokens), "lm-blocks")
    size = blocks.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda acc, x: acc + x))).first()[0] or 1
    pairs = cut(_others(_by_range(blocks, (1, 2), -(-2 * size // range_grams))), "lm-pairs", BLOCKS_READ)
    triples = cut(_others(_by_range(blocks, (3,), -(-size // range_grams))), "lm-triples", BLOCKS_READ)
    whole = pairs.filter("block is null").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("at"), F.lit(0))).first()
    every = blocks.withColumn("order", F.lit(0))
    for order, counts in ((1, pairs), (3, triples)):
        every = every.unionByName(counts.filter("block is not null").withColumn("order", F.lit(order)), allowMissingColumns=True)
    scored = cut(_walked(every, *whole), "lm-walks", BLOCKS_READ)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(whole[0]).cast("long").alias("train_tokens"), "base_score", "score")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), held=held_out())
