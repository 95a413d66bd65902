"""Document fingerprints: a homomorphic multiset hash of paragraphs.

Every paragraph is hashed to a wide vector, and a fingerprint is the sum of these
vectors lane by lane modulo powers of two:

* ``DENSE`` lanes modulo 2**64 of whole paragraphs. Equal multisets of paragraphs
  have equal lanes in whatever order; adding or removing a paragraph adds or
  subtracts its vector, so a fingerprint is maintained without the text.
* ``LANES`` lanes modulo 2**32 of a Cauchy number for every piece of a paragraph, and one
  lane modulo 2**32 that counts pieces. A piece ends where the bytes before say so, after
  ``PIECE`` bytes on average, so pieces do not depend on the language, and those beside an
  edit are as before. Cauchy numbers are 1-stable: the difference of two such sums is a
  Cauchy number whose scale is the sum of the absolute differences of the counts,
  however often a piece repeats. The scale that is likeliest over the lanes gives a
  likeness between 0 and 1. Only numbers far out in few lanes can wrap, which the
  likeliest scale withstands up to about ten million repeats of a piece.

Null and empty texts have no paragraph: the zero fingerprint. Two empty multisets
are alike (1.0). Blank paragraphs are ignored; repeated ones count repeatedly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytable.llm.storage import small_batches, text_column

DENSE, LANES = 8, 256  # a standard error of sqrt(2 / LANES) of the unlike share, 0.09 at most
UNIT = 16  # Cauchy numbers are rounded to this part of one
GROUP_CHARS = 1 << 20  # of texts that are fingerprinted together
STEPS = 30  # halvings of the error of a scale
_CAUCHY = np.rint(UNIT * np.tan(np.pi * ((np.arange(1 << 16) + 0.5) / (1 << 16) - 0.5))).astype(np.int32)
PIECE, LONGEST = 24, 64  # bytes of a piece on average and at most


def paragraphs(text: str) -> list[bytes]:
    """The paragraphs: lines that are not blank, without outer white space."""
    return [p for line in text.encode("utf-8", "surrogatepass").split(b"\n") if (p := line.strip())]


def _digests(units: list[bytes], size: int) -> bytes:
    new = hashlib.blake2b
    return b"".join([new(u, digest_size=size).digest() for u in units])


def pieces(paragraphs: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The pieces of all paragraphs, and how many each has: a piece ends where a hash of the
    last four bytes is one of so many, at the end, and after ``LONGEST`` bytes."""
    raw = b"".join(paragraphs)
    ends = np.cumsum([len(p) for p in paragraphs])
    data = np.frombuffer(raw + b"\0" * 4, np.uint8).astype(np.uint32)
    four = data[:-3] | data[1:-2] << np.uint32(8) | data[2:-1] << np.uint32(16) | data[3:] << np.uint32(24)
    found = np.flatnonzero(((four * np.uint32(0x9E3779B1)) >> np.uint32(16)) % np.uint32(PIECE) == 0) + 4
    owner = np.searchsorted(ends, found, side="left")  # no cut looks back into the paragraph before
    inside = owner < len(ends)
    found, owner = found[inside], owner[inside]
    found = found[found - 4 >= (ends - [len(p) for p in paragraphs])[owner]]
    cuts = np.unique(np.concatenate((found, ends)))
    starts = np.concatenate(([0], cuts[:-1]))
    more = (cuts - starts - 1) // LONGEST  # further cuts within long pieces
    if more.any():
        k = np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more) + 1
        cuts = np.sort(np.concatenate((cuts, np.repeat(starts, more) + k * LONGEST)))
        starts = np.concatenate(([0], cuts[:-1]))
    return [raw[a:b] for a, b in zip(starts.tolist(), cuts.tolist(), strict=True)], np.diff(np.concatenate(([0], np.searchsorted(cuts, ends, side="right"))))


def vectors(groups: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums over each group of paragraphs: dense lanes (n, DENSE) uint64 and Cauchy
    lanes with the count of pieces (n, LANES + 1) uint32."""
    n = len(groups)
    dense, lanes = np.zeros((n, DENSE), np.uint64), np.zeros((n, LANES + 1), np.uint32)
    flat = [p for g in groups for p in g]
    if not flat:
        return dense, lanes
    lengths = np.array([len(g) for g in groups])
    full = np.flatnonzero(lengths)
    wide = np.frombuffer(_digests(flat, 8 * DENSE), "<u8").reshape(-1, DENSE)
    dense[full] = np.add.reduceat(wide, (np.cumsum(lengths) - lengths)[full], axis=0)
    units, counts = pieces(flat)
    per_group = np.add.reduceat(counts, (np.cumsum(lengths) - lengths)[full])
    owner = np.repeat(np.arange(len(full)), per_group)
    sums = np.zeros((len(full), LANES), np.uint32)  # wraps, as the lanes do
    # a text and its edited form have most pieces in common, so each is hashed once
    known = {u: i for i, u in enumerate(dict.fromkeys(units))}
    numbers = np.empty((len(known), LANES), np.uint32)
    each, step = list(known), 1 << 12
    for a in range(0, len(each), step):
        raw = b"".join([hashlib.shake_128(u).digest(2 * LANES) for u in each[a : a + step]])
        numbers[a : a + step] = _CAUCHY.view(np.uint32)[np.frombuffer(raw, "<u2")].reshape(-1, LANES)
    which = np.fromiter(map(known.__getitem__, units), np.int64, len(units))
    for a in range(0, len(units), step):
        own = owner[a : a + step]
        starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        rows = numbers[which[a : a + step]]
        for o, b, e in zip(own[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(own)], strict=True):
            sums[o] += np.add.reduce(rows[b:e], axis=0)
    lanes[full, :LANES] = sums
    lanes[full, LANES] = per_group
    return dense, lanes


def to_hex(dense: np.ndarray, lanes: np.ndarray) -> str:
    """One fingerprint: the dense lanes, the Cauchy lanes, the count."""
    return (dense.astype("<u8").tobytes() + lanes.astype("<u4").tobytes()).hex()


def from_hex(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = bytes.fromhex(fingerprint)
    return np.frombuffer(raw[: 8 * DENSE], "<u8").copy(), np.frombuffer(raw[8 * DENSE :], "<u4").copy()


def update(fingerprint: str, added: Iterable[bytes] = (), removed: Iterable[bytes] = ()) -> str:
    """The fingerprint after paragraphs were added and removed."""
    dense, lanes = from_hex(fingerprint)
    (d_in, d_out), (s_in, s_out) = vectors([list(added), list(removed)])
    return to_hex(dense + d_in - d_out, lanes + s_in - s_out)


def fingerprints(texts: list[str]) -> tuple[list[str], np.ndarray]:
    dense, lanes = vectors([paragraphs(t) for t in texts])
    return [to_hex(d, s) for d, s in zip(dense, lanes, strict=True)], lanes


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated share of pieces that two multisets have in common, row by row: one
    less the sum of absolute differences of the counts by the number of all pieces."""
    squares = ((a[:, :LANES] - b[:, :LANES]).astype(np.int32).astype(np.float64) / UNIT) ** 2
    scale = np.maximum(np.median(squares, axis=1), 1e-9)  # squared; the median starts the likeliest
    for _ in range(STEPS):
        scale *= 2 * (squares / (squares + scale[:, None])).mean(axis=1)
        np.maximum(scale, 1e-9, out=scale)
    total = a[:, LANES].astype(np.float64) + b[:, LANES].astype(np.float64)
    alike = np.where(total > 0, 1 - np.sqrt(scale) / np.maximum(total, 1), 1.0)
    return np.where((a == b).all(axis=1), 1.0, np.clip(alike, 0.0, 1.0))


def fingerprint(docs: DataFrame, *, name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of every whole text in column ``name``, in place of
    any column of that name."""
    small_batches(docs.sparkSession)
    docs = docs.drop(name)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = fingerprints([t or "" for t in batch.column(at).to_pylist()])[0] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, docs.select("*", F.lit("").alias(name)).schema)


def edit(text: str, after: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many of ``after``."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _bounds(keys: DataFrame, per_task: int = 8) -> np.ndarray:
    """Smallest keys of ranges that cover all keys: every task of a range partitioning
    of the keys alone cuts its share into ``per_task`` ranges. Equal keys are never cut
    apart. Their number follows the number of shuffle partitions, not of rows."""
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.sort(np.concatenate([b.column(0).to_numpy() for b in batches] or [np.zeros(0, np.int64)]))
        at = np.unique(np.arange(per_task) * len(own) // per_task) if len(own) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(own[at], pa.int64())], names=["key"])

    rows = keys.repartitionByRange(n, "key").mapInArrow(cut, "key long").collect()
    return np.unique(np.array([r["key"] for r in rows], np.int64))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (part, lead, key, doc_id, text) sorted within partitions: a part is a range
    of ids in ascending order, closed by a row with ``lead`` set, which repeats the first
    row of the next part (after the last part, the very first row). Each text moves
    once; no task holds more than the rows of its ranges. Null ids come first, rows of
    equal id in the order of their texts."""
    spark = docs.sparkSession
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    bounds = spark.sparkContext.broadcast(_bounds(base.select("key")))

    @F.pandas_udf("array<int>")
    def parts(key):  # of the row itself, and for a first row the part that it closes
        import pandas as pd

        b = bounds.value
        k = key.to_numpy()
        own = np.searchsorted(b, k, side="right") - 1
        first = b[own] == k
        return pd.Series([[p, (p - 1) % len(b)] if f else [p] for p, f in zip(own.tolist(), first.tolist(), strict=True)])

    dealt = base.select(F.posexplode(parts("key")).alias("lead", "part"), "key", "doc_id", "text")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "part").sortWithinPartitions("part", "lead", "key", "text")


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """For every row: n_chars, the digest of its edited text (see ``edit``), both
    fingerprints, and the likeness of the row's fingerprint to the edited text's and
    to the next row's."""
    small_batches(docs.sparkSession)
    fields = ["doc_id long", "n_chars long", "edited_sha256 string", "fingerprint string", "edited_fingerprint string", "near_edited double", "near_next double"]

    def answer(ids: list, texts: list[str], after: list[str]) -> pa.RecordBatch:
        edited = [edit(t, x) for t, x in zip(texts, after, strict=True)]
        n = len(texts)
        both, all_lanes = fingerprints([*texts, after[-1], *edited])
        own, lanes, changed, other = both[: n + 1], all_lanes[: n + 1], both[n + 1 :], all_lanes[n + 1 :]
        nexts = np.concatenate((lanes[1:-1], lanes[-1:]))
        columns = [
            pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array(own[:-1]), pa.array(changed),
            pa.array(likeness(lanes[:-1], other)), pa.array(likeness(lanes[:-1], nexts)),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []  # rows of one part that wait for the row after them
        size = 0
        for batch in batches:
            for lead, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("lead", "doc_id", "text")), strict=True):
                if texts and (lead or size > GROUP_CHARS):
                    yield answer(ids, texts, [*texts[1:], text])
                    ids, texts, size = [], [], 0
                if not lead:
                    ids.append(doc_id)
                    texts.append(text)
                    size += len(text)

    return with_next(docs).select("lead", "doc_id", "text").mapInArrow(run, ", ".join(fields))
