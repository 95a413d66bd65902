"""Benchmark decontamination with an FM-index of each training shard.

A phrase is a window of ``WINDOW`` consecutive words of a benchmark item (a shorter
item is one phrase). A training shard, consecutive documents of about ``SHARD_BYTES`` of
text, is reduced to its maximal runs of benchmark words that are long enough to hold a
phrase of those words (no other place can), and over these runs an FM-index is
built: suffix order by prefix doubling, the Burrows-Wheeler transform in a wavelet
matrix for rank queries, and sampled suffix positions. Backward search finds all
phrases at once, occurrences are located by walking to a sampled position, and the
word spans are merged per document.

The benchmark is a stated query set. It is read in blocks of about ``BLOCK_WORDS``
words, hence of no more phrases, each block broadcast by itself, so its size is bounded
(a longer item is cut into pieces that overlap by a phrase less a word); spans and items
found by several blocks are merged. Null or empty texts have no words; null items are
ignored; rows of one item_id are one item; repeated documents each get a row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytable.llm.storage import materialize, small_batches
from keytable.llm.words import ALNUM, encode, slices, split

WINDOW = 10
SHARD_BYTES = 4 << 20
BLOCK_WORDS = 100_000


class WaveletMatrix:
    """Rank queries over a sequence of numbers below 2**bits."""

    def __init__(self, values: np.ndarray, bits: int):  # fewer than 2**31 of them
        self.n, self.bits, self.zeros, self.ones = len(values), bits, [], []
        for k in range(bits - 1, -1, -1):
            bit = (values >> k) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(self.n - int(self.ones[-1][-1]))
            values = np.concatenate((values[bit == 0], values[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        lo, hi = np.zeros_like(at), at.copy()
        for level, k in enumerate(range(self.bits - 1, -1, -1)):
            ones, zeros = self.ones[level], self.zeros[level]
            one = ((symbol >> k) & 1).astype(bool)
            lo, hi = (np.where(one, zeros + ones[x], x - ones[x]) for x in (lo, hi))
        return hi - lo


class FMIndex:
    """Over runs of symbols 1..sigma; a run never matches across its ends."""

    def __init__(self, runs: list[np.ndarray], sigma: int, sample: int = 8):
        lengths = np.array([len(r) for r in runs], np.int64)
        text = np.zeros(int(lengths.sum()) + len(runs), np.int64)
        begins = np.cumsum(lengths + 1) - lengths - 1
        for b, r in zip(begins.tolist(), runs, strict=True):
            text[b : b + len(r)] = r
        ends = begins + lengths
        self.text_length = len(text)
        order = text + len(runs)  # ends of runs differ, so no suffix comparison passes one
        order[ends] = np.arange(len(runs))
        suffix = _suffix_order(order, int(lengths.max(initial=0)) + 1)
        bwt = text[suffix - 1]
        self.bits = max(1, int(sigma).bit_length())
        self.wavelet = WaveletMatrix(bwt, self.bits)
        self.bwt = bwt
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma + 1)))).astype(np.int64)
        kept = suffix % sample == 0
        kept |= np.isin(suffix, begins)
        self.kept_rank = np.concatenate(([0], np.cumsum(kept))).astype(np.int64)
        self.kept, self.sampled = kept, suffix[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of phrases, given right-aligned in a matrix."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.text_length, np.int64)
        for step in range(phrases.shape[1]):
            live = np.flatnonzero((step < lengths) & (hi > lo))
            if not len(live):
                break
            symbol = phrases[live, phrases.shape[1] - 1 - step]
            lo[live] = self.first[symbol] + self.wavelet.rank(symbol, lo[live])
            hi[live] = self.first[symbol] + self.wavelet.rank(symbol, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back until a sampled one."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        while len(live := np.flatnonzero(~self.kept[rows])):
            symbol = self.bwt[rows[live]]
            rows[live] = self.first[symbol] + self.wavelet.rank(symbol, rows[live])
            steps[live] += 1
        return self.sampled[self.kept_rank[rows]] + steps


def _suffix_order(values: np.ndarray, longest: int) -> np.ndarray:
    """Suffix array by prefix doubling; ranks differ after ``longest`` symbols."""
    rank = np.unique(values, return_inverse=True)[1].astype(np.int64)
    n, width = len(values), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - width)] = rank[width:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        width *= 2
        if fresh[-1] == n - 1 or width > 2 * longest:
            return order


class Phrases:
    """The phrases of some benchmark items, over numbered words."""

    def __init__(self, items: list[tuple[object, str]], window: int):
        self.number: dict[bytes, int] = {}
        rows, self.owner, index = [], [], {}
        for item, text in items:
            words = [self.number.setdefault(w, len(self.number) + 1) for w in split(encode(text), ALNUM)]
            if words:
                own = index.setdefault(item, len(index))
                for i in range(max(1, len(words) - window + 1)):
                    rows.append(words[i : i + window])
                    self.owner.append(own)
        self.items = list(index)
        self.lengths = np.array([len(r) for r in rows], np.int64)
        self.width = int(self.lengths.max(initial=1))
        #: (length, which word numbers stand in phrases of that length)
        self.vocabularies = []
        for n in np.unique(self.lengths).tolist():
            member = np.zeros(len(self.number) + 1, bool)
            member[[w for r in rows if len(r) == n for w in r]] = True
            self.vocabularies.append((n, member))
        self.matrix = np.zeros((len(rows), self.width), np.int64)
        for i, r in enumerate(rows):
            self.matrix[i, self.width - len(r) :] = r
        self.owner = np.array(self.owner, np.int64)


_GAP = np.zeros(1, np.int32)  # parts texts; no phrase has word 0


def shard_hits(texts: list[bytes], phrases: Phrases) -> tuple[np.ndarray, dict[int, tuple[list[tuple[int, int]], list]]]:
    """Words of each text, and for those with hits the merged word spans [start, end)
    and the items whose phrases occur."""
    counts = np.zeros(len(texts), np.int64)
    numbered = []
    get = phrases.number.get
    for i, text in enumerate(texts):
        words = split(text, ALNUM)
        counts[i] = len(words)
        numbered.append(np.fromiter(map(get, words, repeat(0)), np.int32, len(words)))
        numbered.append(_GAP)
    ids = np.concatenate(numbered) if numbered else _GAP
    kept = np.zeros(len(ids), bool)
    for length, member in phrases.vocabularies:
        edge = np.flatnonzero(np.diff(np.concatenate(([0], member[ids], [0])).astype(np.int8)))
        start, end = edge[0::2], edge[1::2]
        long = end - start >= length
        change = np.zeros(len(ids) + 1, np.int32)
        change[start[long]] += 1
        change[end[long]] -= 1
        kept |= np.cumsum(change[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([0], kept, [0])).astype(np.int8)))
    if not len(edge):
        return counts, {}
    runs = [ids[a:b] for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True)]
    begin = np.cumsum(counts + 1) - counts - 1
    docs = np.searchsorted(begin, edge[0::2], side="right") - 1
    at = edge[0::2] - begin[docs]
    index = FMIndex(runs, len(phrases.number))
    lo, hi = index.search(phrases.matrix, phrases.lengths)
    begins = np.cumsum([0] + [len(r) + 1 for r in runs[:-1]])
    found: dict[int, tuple[list, set]] = {}
    width = hi - lo
    total, a = np.cumsum(width), 0
    while a < len(width):  # occurrences in blocks of bounded size
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + 2_000_000, side="right")))
        n = int(width[a:b].sum())
        which = np.repeat(np.arange(a, b), width[a:b])
        rows = np.repeat(lo[a:b], width[a:b]) + np.arange(n) - np.repeat(np.cumsum(width[a:b]) - width[a:b], width[a:b])
        position = index.locate(rows)
        run = np.searchsorted(begins, position, side="right") - 1
        first = at[run] + position - begins[run]
        for d, s, k in zip(docs[run].tolist(), first.tolist(), which.tolist(), strict=True):
            spans, items = found.setdefault(d, ([], set()))
            spans.append((s, s + int(phrases.lengths[k])))
            items.add(int(phrases.owner[k]))
        a = b
    return counts, {d: (merge(spans), [phrases.items[k] for k in sorted(items)]) for d, (spans, items) in found.items()}


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[list[tuple[object, str]]]:
    """The items, read through an iterator, in blocks of bounded size."""
    items = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", F.col("text").cast("string").alias("text"))
    block, size, any_yet = [], 0, False
    for row in items.toLocalIterator():
        words = split(encode(row["text"]), ALNUM)
        for a in range(0, max(1, len(words) - window + 1), block_words):
            piece = words[a : a + block_words + window - 1]
            if block and size + len(piece) > block_words:
                yield block
                block, size, any_yet = [], 0, True
            block.append((row["item_id"], b" ".join(piece).decode("utf-8", "surrogatepass")))
            size += len(piece)
    if block or not any_yet:
        yield block


SPANS = "array<struct<start:long,end:long>>"


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with columns n_words, spans (merged word spans covered by a phrase) and
    items (item_ids, as strings, of items with a phrase in the text), in place of any
    columns of these names."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("n_words", "spans", "items")
    at = docs.columns.index("text")
    schema = docs.select("*", F.lit(0).cast("long").alias("n_words"), F.lit(None).cast(SPANS).alias("spans"), F.lit(None).cast("array<string>").alias("items")).schema
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def search(shared, frame: DataFrame) -> DataFrame:
        def answer(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, hits = shard_hits([encode(t) for t in batch.column(at).to_pylist()], shared.value)
            spans = [[{"start": s, "end": e} for s, e in hits[i][0]] if i in hits else [] for i in range(batch.num_rows)]
            items = [sorted({str(x) for x in hits[i][1]}) if i in hits else [] for i in range(batch.num_rows)]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts), pa.array(spans, span_type), pa.array(items, pa.list_(pa.string()))], names=[*batch.schema.names, "n_words", "spans", "items"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, at, shard_bytes):
                    yield answer(part)

        return frame.mapInArrow(run, schema)

    blocks = iter(_blocks(benchmark, window, block_words))
    out = search(spark.sparkContext.broadcast(Phrases(next(blocks), window)), docs)
    for block in blocks:  # further blocks look again and add to what was found
        out = _add_block(materialize(out, "decontam"), spark.sparkContext.broadcast(Phrases(block, window)))
    return out


def _add_block(out: DataFrame, shared) -> DataFrame:
    """``out`` with the spans and items of one more block of phrases merged in."""
    at = out.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, at, SHARD_BYTES):
                rows = batch.to_pydict()
                hits = shard_hits([encode(t) for t in batch.column(at).to_pylist()], shared.value)[1]
                for i, (spans, items) in hits.items():
                    old = [(s["start"], s["end"]) for s in rows["spans"][i]]
                    rows["spans"][i] = [{"start": s, "end": e} for s, e in merge(old + spans)]
                    rows["items"][i] = sorted({*rows["items"][i], *map(str, items)})
                yield pa.RecordBatch.from_pydict(rows, schema=batch.schema)

    return out.mapInArrow(run, out.schema)


_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between these."""
    raw = encode(text)
    at = [(m.start(), m.end()) for m in _WORD.finditer(raw)]
    out, upto = [], 0
    for start, end in spans:
        out.append(raw[upto : at[start][0]])
        upto = at[end - 1][1]
    return b"".join([*out, raw[upto:]]).decode("utf-8", "surrogatepass")


def remove_contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without the benchmark's phrases: removal spans are cut from the texts,
    again until none is left where a cut brought words together. With several blocks
    of phrases, they are gone through until a text passes all of them uncut."""
    spark = docs.sparkSession
    small_batches(spark)
    at = docs.columns.index("text")
    # how a text stands: 1 to be looked at, 2 cut in this pass
    marked = docs.withColumn("__open", F.lit(1))
    mark = len(docs.columns)

    def without(shared, frame: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole, at, shard_bytes):
                    texts, state = batch.column(at).to_pylist(), batch.column(mark).to_pylist()
                    rows = [i for i, t in enumerate(texts) if t and state[i]]
                    while rows:
                        hits = shard_hits([encode(texts[i]) for i in rows], shared.value)[1]
                        rows = [rows[k] for k in sorted(hits)]
                        for i, (_, (spans, _)) in zip(rows, sorted(hits.items()), strict=True):
                            texts[i], state[i] = cut(texts[i], spans), 2
                    yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type)).set_column(mark, batch.schema.field(mark), pa.array(state, pa.int32()))

        return frame.mapInArrow(run, marked.schema)

    out, fresh = marked, True
    while True:
        count = 0
        for block in _blocks(benchmark, window, block_words):
            out = without(spark.sparkContext.broadcast(Phrases(block, window)), out if fresh else materialize(out, "decontam"))
            fresh = False
            count += 1
        if count == 1:
            return out.drop("__open")
        out = materialize(out, "decontam").withColumn("__open", F.when(F.col("__open") == 2, 1).otherwise(0))
        if not out.where("__open = 1").limit(1).count():
            return out.drop("__open")


def hit_words(spans) -> F.Column:
    """Words inside the spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def items_digest(items) -> F.Column:
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(items)), ","), 256)
