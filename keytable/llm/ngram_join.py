"""N-gram Jaccard join by parity sketches.

A text's set is that of its distinct ``size``-word shingles. Every shingle flips one
bit of a sketch, so two sketches differ in at most as many bits as the sets differ in
shingles. Two sketches are kept:

* a long sparse one, cut into K blocks per size band. Sets of Jaccard similarity t or
  more whose smaller one lies in the band differ in at most D shingles, so at least
  K - D blocks are equal (pigeonhole). Blocks, XOR-folded to 64 bits, are the join
  keys; empty ones are not emitted unless a set has more of them than K - D - 1.
* a dense one of ``SKETCH_BITS`` bits, whose Hamming distance drops most candidate
  pairs before the exact check.

Sets that are equal form one class, and classes are joined, so copies cost nothing.
K - D is more than one, which keeps passages that many texts share from joining them
all: a class that has fewer than K - D blocks in common with others links with none and
goes, and of the shared blocks of the rest the K - D - 1 most frequent ones are left
out (a linked pair has a rarer one in common). Classes that still share blocks, directly
or through others, form clusters. A cluster is compared within one task if it has no more
than ``PART_ROWS`` classes of ``PART_BYTES`` in all, else in parts of that size: the
classes of equal least block together, then parts of a hash, then what is not yet in the
cluster's largest component, in pairs of parts that share a block. Pairs that are
already in one component are skipped, others are dropped by their sketches, and the exact
check compares the sets themselves (hashes of 64 bits). So copies and near copies are not
expanded into pairs, and no link that joins components is lost.

Defined results: null, empty or wordless texts have an empty set and link with
nothing; texts of fewer words than a shingle have their whole sequence as the one
shingle; rows count by what they hold, so rows of one id may differ and repeated rows
are in one class; rows without an id link like others but are named by no component;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keytable.llm.components import merge_labels
from keytable.llm.storage import join_hot, materialize, observed, small, small_batches, text_column
from keytable.llm.words import BLANK, encode, mix, word_hashes

SLACK = 0.35  # blocks beyond the D + 1 that the pigeonhole needs
SKETCH_BITS = 1024
BAND_RATIO = 1.25
PART_BYTES, PART_ROWS = 4 << 20, 128
_PIECE = 1 << 20
_A = np.uint64(0x9FB21C651E98DF25)


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and how many each has."""
    hashes, counts = [], np.zeros(len(texts), np.int64)
    group: list[bytes] = []
    owners: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal group, owners, size
        if not group:
            return
        data = np.frombuffer(b" ".join(group) + b" ", np.uint8)
        found, start = word_hashes(data)
        ends = np.cumsum([len(g) + 1 for g in group])
        np.add.at(counts, owners, np.diff(np.concatenate(([0], np.searchsorted(start, ends)))))
        hashes.append(found)
        group, owners, size = [], [], 0

    for i, text in enumerate(texts):
        text = text.translate(BLANK)
        a = 0
        while a < len(text):
            b = len(text) if len(text) - a <= _PIECE else (text.rfind(b" ", a, a + _PIECE) + 1 or text.find(b" ", a + _PIECE) + 1 or len(text))
            b = b if b > a else len(text)
            group.append(text[a:b])
            owners.append(i)
            size += b - a
            a = b
            if size >= _PIECE:
                flush()
    flush()
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), counts


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted 64-bit hashes of the distinct shingles of every text."""
    words, counts = _words(texts)
    salt = np.uint64(size)
    rolled = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        rolled = rolled * _A + words[k : k + len(rolled)]
    rolled = mix(rolled + salt)
    out, at = [], 0
    for n in counts.tolist():
        if n >= size:
            own = np.sort(rolled[at : at + n - size + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif n:
            value = np.zeros(1, np.uint64)
            for w in words[at : at + n]:
                value = value * _A + w
            out.append(mix(value ^ mix(np.array([n], np.uint64))))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


@cache
def _edges(limit: int) -> tuple[int, ...]:
    """Lower ends of the size bands."""
    out = [1]
    while out[-1] <= limit:
        out.append(max(out[-1] + 1, int(out[-1] * BAND_RATIO)))
    return tuple(out)


@cache
def band(g: int, percent: int, limit: int) -> tuple[int, int]:
    """Blocks K of a band, and D: in how many shingles sets may differ whose smaller
    one lies in the band. 100 * |A and B| >= percent * |A or B| bounds the difference
    by (100 - percent) / percent of the smaller set."""
    hi = _edges(limit)[g + 1]
    d = (100 - percent) * (hi - 1) // percent
    return d + 1 + math.ceil(SLACK * (d + 1)), d


def bands(n: int, percent: int) -> list[tuple[int, int, int]]:
    """(band, K, D) of the bands in which a set of n shingles is compared: its own and
    the lower ones that a linked smaller set may lie in. Without difference (D = 0)
    linked sets are equal and need no key."""
    limit = 1 << max(6, n.bit_length() + 1)
    edges = _edges(limit)
    own = int(np.searchsorted(edges, n, side="right")) - 1
    least = -(-percent * n // 100)
    out = []
    g = own
    while g >= 0 and edges[g + 1] - 1 >= least:
        k, d = band(g, percent, limit)
        if d:
            out.append((g, k, d))
        g -= 1
    return out


def block_keys(own: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The join keys of a set, and for each its band and how many of the band's keys a
    linked set has in common at least (band << 32 | number)."""
    keys, tags = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    top = own >> np.uint64(32)
    folded = mix(own ^ np.uint64(0x5851F42D4C957F2D))
    for g, k, d in bands(len(own), percent):
        block = (top * np.uint64(k)) >> np.uint64(32)  # rises with the hash: blocks are runs
        start = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        value = np.bitwise_xor.reduceat(folded, start)
        number = block[start]
        need = k - d - (k - len(number))  # the empty blocks may be among the equal ones
        if need < 1:
            empty = np.setdiff1d(np.arange(k, dtype=np.uint64), number)
            number, value = np.concatenate((number, empty)), np.concatenate((value, np.zeros(len(empty), np.uint64)))
            need = 1  # sets without these keys may be linked too, so nothing is left out
        keys.append(mix(value + mix(number + np.uint64(g << 40) + np.uint64(1))))
        tags.append(np.full(len(number), g << 32 | need, np.int64))
    return np.concatenate(keys), np.concatenate(tags)


def signature(own: np.ndarray) -> int:
    """64 bits of a whole set, as a signed number."""
    return int(np.bitwise_xor.reduce(mix(own + np.uint64(0x632BE59BD9B4E019))).astype(np.int64)) if len(own) else 0


def sketch(own: np.ndarray) -> bytes:
    bits = np.bincount((own & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def _texts(batches: Iterator[pa.RecordBatch], limit: int = 2 << 20) -> Iterator[tuple[list, list[bytes]]]:
    """Rows (doc_id, hash, text) as keys and texts, in groups of bounded size."""
    ids: list = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        for i, h, t in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            ids.append((i, h))
            texts.append(encode(t))
            size += len(texts[-1])
            if size >= limit:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def hashed(docs: DataFrame) -> DataFrame:
    """(doc_id, hash, text): what tells rows apart here."""
    text = text_column(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text"))


def sets_table(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, hash, n, sig, sketch) of every row; sig and sketch are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in _texts(batches):
            sets = shingle_sets(texts, size)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s) if len(s) else None for s in sets], pa.int64()), pa.array([sketch(s) if len(s) else None for s in sets], pa.binary())],
                names=["doc_id", "hash", "n", "sig", "sketch"],
            )

    return hashed(docs).mapInArrow(run, "doc_id long, hash long, n long, sig long, sketch binary")


def shared_blocks(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(key, sig, tag): the members of every key that several classes have. A sorted
    stream per partition, so a group may be of any size."""
    names = ["key", "sig", "tag"]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[int, None] = {}  # classes just seen here need not emit again
        for _, texts in _texts(batches):
            found, tags, owners = [], [], []
            for own in shingle_sets(texts, size):
                if not len(own) or (sig := signature(own)) in last:
                    continue
                last[sig] = None
                if len(last) > 100_000:
                    last.pop(next(iter(last)))
                key, tag = block_keys(own, percent)
                found.append(key)
                tags.append(tag)
                owners.append(sig)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.repeat(np.array(owners, np.int64), [len(f) for f in found])), pa.array(np.concatenate(tags))], names=names)

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row of the batch before: (key, sig, tag, emitted)
        for batch in batches:
            key, sig, tag = (batch.column(i).to_numpy() for i in range(3))
            if not len(key):
                continue
            same = np.concatenate(([held is not None and key[0] == held[0]], key[1:] == key[:-1]))
            twin = same & np.concatenate(([held is not None and sig[0] == held[1]], sig[1:] == sig[:-1]))
            more = same & ~twin  # a further class of the key
            # a row is kept if its key has a further class here, before it, or after it
            start = np.flatnonzero(~same)
            run = np.searchsorted(start, np.arange(len(key)), side="right")  # 0: the key of the batch before
            several = np.zeros(len(start) + 1, bool)
            several[run[more]] = True
            if held is not None and held[3]:
                several[0] = True
            keep = several[run] & ~twin
            out = [key[keep], sig[keep], tag[keep]]
            if held is not None and not held[3] and several[0]:
                out = [np.concatenate(([h], o)) for h, o in zip(held[:3], out, strict=True)]
            last = int(run[-1])
            own = start[last - 1] if last else 0  # the only class of the last key, if there is one
            held = (key[own], sig[own], tag[own], bool(several[last])) if last else (held[0], held[1], held[2], bool(several[0]))
            held = (held[0], held[1] if not held[3] else sig[-1], held[2], held[3])
            if len(out[0]):
                yield pa.RecordBatch.from_arrays([pa.array(o) for o in out], names=names)

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = hashed(docs).mapInArrow(keys, "key long, sig long, tag long")
    return rows.repartition(n, "key").sortWithinPartitions("key", "sig").mapInArrow(group, "key long, sig long, tag long")


def _thinned(groups: DataFrame) -> DataFrame:
    """(key, sig, leader) of the shared blocks that a link needs: classes that share too
    few go, twice, since that leaves others alone; then each class leaves out its most
    frequent blocks but for one less than a link shares."""
    need = F.col("tag").bitwiseAND(0xFFFFFFFF)
    for _ in range(2):
        enough = groups.groupBy("sig", "tag").agg(F.count("*").alias("n")).where(F.col("n") >= need).select("sig", "tag")
        groups = groups.join(enough, ["sig", "tag"])
        size = groups.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
        groups = materialize(groups.join(size, "key").select("key", "sig", "tag", "size"), "shared").drop("size")
    size = groups.groupBy("key").agg(F.count("*").alias("size"))
    own = W.partitionBy("sig", "tag")
    ranked = groups.join(size, "key").withColumn("nth", F.row_number().over(own.orderBy("size", "key"))).withColumn("n", F.count("*").over(own))
    kept = ranked.where(F.col("nth") <= F.col("n") - need + 1).select("key", "sig")
    lead = kept.groupBy("key").agg(F.min("sig").alias("leader"), F.count("*").alias("size")).where("size > 1").select("key", "leader")
    return kept.join(lead, "key").where("sig <> leader").select("key", "sig", "leader")


def links_within(rows: dict[str, list], percent: int) -> list[tuple[int, int]]:
    """Links between classes of ``rows`` (sig, n, sketch, packed, label, side) that join
    components: any two rows, or if both sides 0 and 1 occur only pairs of one row of each."""
    sig, n, label = (np.array(rows[c], np.int64) for c in ("sig", "n", "label"))
    side = np.array(rows["side"], np.int64)
    both = side.min() != side.max()
    bits = np.frombuffer(b"".join(rows["sketch"]), "<u8").reshape(len(sig), -1)
    label = np.unique(label, return_inverse=True)[1]
    sets: dict[int, np.ndarray] = {}

    def own(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = np.frombuffer(rows["packed"][i], "<u8")
        return sets[i]

    found = []
    for i in range(len(sig)):
        if both and side[i]:
            continue
        rest = slice(0, None) if both else slice(i + 1, None)
        least = -(-percent * (n[i] + n[rest]) // (100 + percent))  # fewest shared shingles of a link
        open_to = (label[rest] != label[i]) & (np.minimum(n[i], n[rest]) >= least)
        if both:
            open_to &= side[rest] == 1
        if not open_to.any():
            continue
        j = np.flatnonzero(open_to)
        apart = np.bitwise_count(bits[rest][j] ^ bits[i]).sum(axis=1, dtype=np.int64)
        near = apart <= n[i] + n[rest][j] - 2 * least[j]
        for k in (j[near][np.argsort(apart[near], kind="stable")] + (0 if both else i + 1)).tolist():
            if label[k] == label[i]:
                continue
            merged = np.concatenate((own(i), own(k)))
            merged.sort()
            shared = int((merged[1:] == merged[:-1]).sum())
            if 100 * shared >= percent * int(n[i] + n[k] - shared):
                found.append((int(sig[i]), int(sig[k])))
                label[label == label[k]] = label[i]
        if not both:
            sets.pop(i, None)
    return found


def _compared(units: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Links within each group of rows of bounded size."""

    def one(pdf):
        import pandas as pd

        rows = {c: pdf[c].tolist() for c in ("sig", "n", "sketch", "packed", "label", "side")}
        return pd.DataFrame(links_within(rows, percent) if len(pdf) > 1 else [], columns=["a", "b"], dtype="int64")

    return units.groupBy(*keys).applyInPandas(one, "a long, b long")


def _sets_of(docs: DataFrame, wanted: DataFrame, n: int, size: int) -> DataFrame:
    """(sig, packed): the sets of the ``n`` rows ``wanted`` (doc_id, hash), as their sorted hashes.
    The signature is taken from the row's own text again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _texts(batches):
            sets = [s for s in shingle_sets(texts, size) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([signature(s) for s in sets], pa.int64()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], names=["sig", "packed"])

    chosen = _matching(hashed(docs), wanted, n, "left_semi")
    return materialize(chosen.mapInArrow(run, "sig long, packed binary"), "sets").dropDuplicates(["sig"])


def _matching(rows: DataFrame, named: DataFrame, n: int, how: str) -> DataFrame:
    """``rows`` joined to ``n`` rows (doc_id, hash), ids null-safe; the named side is broadcast
    if its counted size allows."""
    named = named.select(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash"))
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("hash") == F.col("__hash"))
    return rows.join(F.broadcast(named) if small(named, row_bytes=64, rows=n) else named, on, how)


def grouped(docs: DataFrame, *, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, hash, n, label) of every row: rows whose sets are linked, directly or
    through others, have one label; it is null for empty sets."""
    small_batches(docs.sparkSession)
    table = materialize(sets_table(docs, size), "classes")
    filled = table.where(F.col("sig").isNotNull())
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("first")
    classes = materialize(filled.groupBy("sig").agg(first, F.min("n").alias("n"), F.min("sketch").alias("sketch"), F.count("*").alias("rows")).select("sig", "first.doc_id", "first.hash", "n", "sketch", "rows"), "classes")
    groups = materialize(_thinned(materialize(shared_blocks(docs, size, percent), "shared")), "groups")

    nodes = groups.select(F.col("sig").alias("node")).union(groups.select(F.col("leader").alias("node"))).distinct()
    alone = materialize(nodes.select("node", F.col("node").alias("label")), "labels")
    clusters = merge_labels(alone, groups.select(F.col("leader").alias("a"), F.col("sig").alias("b")).distinct())
    members, seen = observed(clusters.select(F.col("node").alias("sig"), F.col("label").alias("cluster")).join(classes.drop("rows"), "sig"), "members", rows=F.count("*"))
    sets = _sets_of(docs, members.select("doc_id", "hash"), seen["rows"], size)
    keyed = materialize(groups.select("key", "sig").union(groups.select("key", F.col("leader").alias("sig"))).distinct(), "keyed")
    home = keyed.groupBy("sig").agg(F.min("key").alias("home"))
    members = materialize(members.join(sets, "sig").join(home, "sig").select("cluster", "home", "sig", "n", "sketch", "packed"), "members")
    labels = _components(members, keyed, alone, percent)

    by_class = classes.select("sig", "rows").join(labels.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "rows", F.coalesce("label", "sig").alias("label"))
    rows = join_hot(filled.select("sig", "doc_id", "hash", "n"), by_class, "sig", "rows", "labelled").select("doc_id", "hash", "n", "label")
    return rows.unionByName(table.where(F.col("sig").isNull()).select("doc_id", "hash", "n", F.lit(None).cast("long").alias("label")))


def near_duplicates(docs: DataFrame, *, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id): texts whose shingle sets have a Jaccard
    similarity of ``percent`` or more are linked; component_id is the smallest doc_id
    reachable by links. Rows without an id have none."""
    rows = materialize(grouped(docs, size=size, percent=percent), "grouped")
    smallest = rows.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("rows"))
    linked = join_hot(rows.where("label is not null").drop("hash"), smallest, "label", "rows", "smallest").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    return linked.unionByName(rows.where("label is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, *, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of linked texts: that of the smallest id, of
    its rows that of the smallest hash. Rows with empty sets stay."""
    rows = materialize(grouped(docs, size=size, percent=percent), "grouped").where("label is not null")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    first = rows.groupBy("label").agg(F.min(key).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    several = join_hot(rows.drop("n"), first, "label", "rows", "first")
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("hash") == F.col("first.hash"))
    # rows of one id and hash have one label, so all of them are the first or none is
    copies = several.groupBy("doc_id", "hash").agg(F.min(is_first).alias("stays"), F.count("*").alias("n")).where("not stays or n > 1")
    copies, seen = observed(copies, "copies", gone=F.count_if(~F.col("stays")), twice=F.count_if("stays"))
    gone, twice = copies.where("not stays"), copies.where("stays")
    clear = docs.withColumnRenamed("hash", "__theirs") if "hash" in docs.columns else docs
    columns = [F.col("__theirs").alias("hash") if c == "hash" else F.col(c) for c in docs.columns]
    kept = _matching(clear.withColumn("hash", F.xxhash64(text_column(clear))), gone, seen["gone"], "left_anti")
    if not seen["twice"]:
        return kept.select(*columns)
    once = _matching(kept, twice, seen["twice"], "left_semi").dropDuplicates(["doc_id", "hash"])
    return _matching(kept, twice, seen["twice"], "left_anti").select(*columns).unionByName(once.select(*columns))


def _parted(rows: DataFrame, groups: list[str], parts: str) -> DataFrame:
    """``rows`` with column part: those of one least block together, ``parts`` of them in
    each of ``groups``, and what is more than a part's rows divided by a hash."""
    rows = rows.withColumn("__p", F.pmod(F.xxhash64("home", F.lit(1)), F.col(parts)))
    more = rows.groupBy(*groups, "__p").agg(_parts().alias("__more"))
    split = rows.join(more, [*groups, "__p"])
    return split.withColumn("part", F.xxhash64("__p", F.pmod(F.xxhash64("sig", F.lit(2)), F.col("__more")))).drop("__p", "__more")


def _parts(those: F.Column | None = None) -> F.Column:
    """How many parts the rows of a group (or those of them) need."""
    each = F.lit(True) if those is None else those
    return F.greatest(F.lit(1), F.ceil(F.count_if(each) / PART_ROWS), F.ceil(F.sum(F.when(each, F.length("packed") + SKETCH_BITS // 8)) / PART_BYTES))


def _components(members: DataFrame, keyed: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(node, label) of all classes in clusters: components of the links between them."""
    sizes = members.groupBy("cluster").agg(_parts().alias("parts"), F.count("*").alias("rows"))
    sized, seen = observed(_parted(join_hot(members, sizes, "cluster", "rows", "sizes"), ["cluster"], "parts"), "sized", large=F.count_if(F.col("parts") > 1))

    def current(rows: DataFrame) -> DataFrame:
        return rows.join(labels.withColumnRenamed("node", "sig"), "sig")

    for turn in range(2):
        rows = sized if turn == 0 else sized.where("parts > 1").withColumn("part", F.pmod(F.xxhash64("sig", F.lit(turn)), F.col("parts")))
        labels = merge_labels(labels, _compared(current(rows).withColumn("side", F.lit(0)), ["cluster", "part"], percent))
        if turn == 0 and not seen["large"]:
            return labels

    # large clusters: what is outside their largest component, against all of it and itself
    rows = materialize(current(sized.where("parts > 1").drop("part")), "large")
    largest = rows.groupBy("cluster", "label").agg(F.count("*").alias("c")).groupBy("cluster").agg(F.max_by("label", F.struct("c", "label")).alias("largest"), F.sum("c").alias("rows"))
    rows, seen = observed(join_hot(rows, largest, "cluster", "rows", "largest").withColumn("outside", F.col("label") != F.col("largest")), "large", outside=F.count_if("outside"))
    if not seen["outside"]:
        return labels
    pools = rows.groupBy("cluster").agg(_parts(F.col("outside")).alias("out"), _parts(~F.col("outside")).alias("in"), F.count("*").alias("rows"))
    rows = join_hot(rows, pools, "cluster", "rows", "pools").withColumn("pool", F.when(F.col("outside"), F.col("out")).otherwise(F.col("in")))
    rows = _parted(rows, ["cluster", "outside"], "pool").withColumn("part", F.xxhash64("cluster", "outside", "part"))
    rows = materialize(rows.select("outside", "part", "sig", "n", "sketch", "packed", "label"), "parts")
    # pairs of parts that have a block in common which stands in several components
    held = materialize(keyed.join(rows.select("sig", "part", "outside", "label"), "sig").groupBy("key", "part", "outside").agg(F.min("label").alias("lo"), F.max("label").alias("hi")), "held")
    mixed = held.groupBy("key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("key")
    held = held.join(mixed, "key")
    left = held.where("outside").select("key", F.col("part").alias("i"))
    right = held.select("key", F.col("part").alias("j"), "outside")
    units = materialize(left.join(right, "key").where("not outside or i <= j").select("i", "j").distinct(), "units")
    columns = ["i", "j", "sig", "n", "sketch", "packed", "label", "side"]
    one = units.join(rows.withColumnRenamed("part", "i"), "i").withColumn("side", F.lit(0)).select(*columns)
    two = units.where("i <> j").join(rows.withColumnRenamed("part", "j"), "j").withColumn("side", F.lit(1)).select(*columns)
    return merge_labels(labels, _compared(one.unionByName(two), ["i", "j"], percent))
