"""WARC archives: writing, and reading by boundary-chain verification.

Writing: one record per page. Of pages with equal payloads the one with the smallest
id becomes a ``response`` with the payload, the others ``revisit`` records that refer
to it. A task writes archives of its own under a fresh name, and a manifest table,
committed by Spark, lists those that count; files of failed attempts are never read.

Reading: archives are cut into byte ranges. The task of a range emits every place
that looks like a record (``WARC/1.`` in plain archives, a gzip member in compressed
ones), also inside payloads, with the offset of its successor as its own length says
(of plain archives no payload is read for that). Within a range, pointer jumping gives
each candidate's first offset beyond the range; across ranges, pointer jumping from
offset 0 of every file marks the true entries, and only records on a chain from a true
entry are read. A chain that does not end at the size of its archive is an error.

Null payloads are empty; pages without an id get records that are never chosen before
those with one; repeated ids each get a record, and of equal payloads under the
smallest id each is a response. Header blocks may be of any length.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytable.llm.storage import materialize, scratch_path, small, small_batches

GZIP_MAGIC, PLAIN_MAGIC = b"\x1f\x8b\x08", b"WARC/1."
ARCHIVE_BYTES = 128 << 20
RANGE_BYTES = 16 << 20
SALTS = 16  # of the join by digest: one payload may be a third of all
_PIECE = 1 << 16
_NAMES = {b"warc-type": "kind", b"warc-target-uri": "url", b"warc-record-id": "record", b"warc-refers-to": "refers", b"warc-payload-digest": "digest", b"content-length": "length"}


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, digest: str) -> bytes:
    """One record; ``first`` is the page that a revisit refers to."""
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = head.encode() + (payload if first is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", "WARC-Target-URI: " + " ".join((url or "").split()), f"WARC-Payload-Digest: sha1:{digest}"]
    if first is not None:
        lines += [f"WARC-Refers-To: <urn:page:{first}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


def _open(url: str):
    """The file system and path of a url; ``file:/x`` is ``file:///x``."""
    return pafs.FileSystem.from_uri("file:///" + url[5:].lstrip("/") if url.startswith("file:") else url)


def write(pages: DataFrame, *, smallest: int = 0, compress: bool = True, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write (page_id, url, html) and return the manifest (path, size). Payloads of
    fewer than ``smallest`` bytes are always responses."""
    spark = pages.sparkSession
    small_batches(spark)
    folder = scratch_path(spark, "warc")
    fs, path = _open(folder)
    fs.create_dir(path, recursive=True)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    # only ids and digests are compared; later copies are few or narrow, never payloads
    marked = rows.select("page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("n")).where(F.col("n") >= smallest)
    firsts = marked.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where((F.col("copies") > 1) & F.col("first").isNotNull())
    salted = firsts.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    later = marked.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"])
    later = materialize(later.where(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("id"), F.col("digest").alias("d"), "first").distinct(), "later")
    keyed = rows.withColumn("digest", F.sha1("payload"))
    joined = keyed.join(F.broadcast(later) if small(later, row_bytes=128) else later, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("d")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        out, name, size, done = None, "", 0, []
        for batch in batches:
            for page_id, url, payload, digest, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "first")), strict=True):
                if out is None:
                    name, size = f"{uuid.uuid4().hex}.warc{'.gz' if compress else ''}", 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                data = record(page_id, url, payload, first, base64.b32encode(bytes.fromhex(digest)).decode())
                if compress:
                    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
                    data = packer.compress(data) + packer.flush()
                out.write(data)
                size += len(data)
                if size >= archive_bytes:
                    out.close()
                    done.append((name, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, size))
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{n}" for n, _ in done], pa.string()), pa.array([s for _, s in done], pa.int64())], names=["path", "size"])

    packed = joined.select("page_id", "url", "payload", "digest", "first").mapInArrow(run, "path string, size long")
    return materialize(packed, "manifest")


class _Source:
    """Pieces of one archive from an offset on: out of the range in memory, beyond it
    from the file. Pieces grow, since most records are short."""

    def __init__(self, file, size: int, start: int, data: bytes):
        self.file, self.size, self.start, self.data = file, size, start, data

    def pieces(self, at: int) -> Iterator[bytes]:
        step = 1 << 12
        while at < self.size:
            inside = at - self.start
            data = self.data[inside : inside + step] if inside < len(self.data) else self.file.read_at(min(step, self.size - at), at)
            if not data:
                return
            yield data
            at += len(data)
            step = min(_PIECE, 2 * step)


def _headers(head: bytes) -> dict | None:
    """The fields of a record's header block; None if it isn't one."""
    lines = head.split(b"\r\n")
    if not lines[0].startswith(PLAIN_MAGIC):
        return None
    found = {}
    for line in lines[1:]:
        name, _, value = line.partition(b":")
        if (key := _NAMES.get(name.strip().lower())) is not None:
            found[key] = value.strip().decode("utf-8", "replace")
    length = found.get("length", "")
    return found if length.isascii() and length.isdigit() and len(length) < 19 else None


class _Head:
    """Collects a header block, which ends with an empty line, from pieces."""

    def __init__(self):
        self.data, self.seen = bytearray(), 0

    def feed(self, data: bytes) -> bytes | None:
        """What follows the block, once it is complete; ``data`` is the block then."""
        self.data += data
        end = self.data.find(b"\r\n\r\n", self.seen)
        if end < 0:
            self.seen = max(0, len(self.data) - 3)
            return None
        rest = bytes(self.data[end + 4 :])
        del self.data[end:]
        return rest


class _Record:
    """Reads a record from a stream of plain pieces: header block, then a body of which
    only the length and, if wanted, the digest of the payload are kept."""

    def __init__(self, digest: bool):
        self.head, self.fields, self.left = _Head(), None, 0
        self.http, self.sha, self.payload, self.tail = _Head(), hashlib.sha1() if digest else None, 0, b""
        self.in_payload = False

    def feed(self, data: bytes) -> bool | None:
        """True when the record has ended, False when it is none, else None."""
        if self.fields is None:
            rest = self.head.feed(data)
            if rest is None:
                start = bytes(self.head.data[: len(PLAIN_MAGIC)])
                return None if PLAIN_MAGIC.startswith(start) else False
            self.fields = _headers(bytes(self.head.data))
            if self.fields is None:
                return False
            self.left, data = int(self.fields["length"]), rest
        part, data = data[: self.left], data[self.left :]
        self.left -= len(part)
        if self.sha is not None and part:
            if not self.in_payload and (rest := self.http.feed(part)) is not None:
                self.in_payload, part = True, rest
            if self.in_payload:
                self.sha.update(part)
                self.payload += len(part)
        if data:
            self.tail += data
            if not b"\r\n\r\n".startswith(self.tail[:4]):
                return False
        return True if not self.left and len(self.tail) >= 4 else None


def _members(source: _Source, at: int) -> Iterator[tuple[bytes, int, bool]]:
    """(plain bytes, bytes used so far, whether it ends) of the gzip member at an offset;
    ends early where there is none."""
    unpack, used = zlib.decompressobj(31), 0
    for data in source.pieces(at):
        try:
            plain = unpack.decompress(data)
        except zlib.error:
            return
        used += len(data) - len(unpack.unused_data)
        yield plain, used, unpack.eof
        if unpack.eof:
            return


def _successor(source: _Source, at: int, packed: bool) -> int | None:
    """The offset after the record at an offset, if it is one."""
    if packed:
        record, end = _Record(False), None
        for plain, used, last in _members(source, at):
            if plain and end is None and (end := record.feed(plain)) is False:
                return None
            if last:
                return at + used if end and len(record.tail) == 4 else None
        return None
    head = _Head()
    for data in source.pieces(at):
        if head.feed(data) is not None:
            fields = _headers(bytes(head.data))
            if fields is None:
                return None
            end = at + len(head.data) + 4 + int(fields["length"]) + 4
            return end if end <= source.size and source.file.read_at(4, end - 4) == b"\r\n\r\n" else None
    return None


def _fields(source: _Source, at: int, packed: bool) -> dict:
    """The fields of the true record at an offset, with the digest of its payload."""
    record = _Record(True)
    for plain in (p for p, _, _ in _members(source, at)) if packed else source.pieces(at):
        if plain and record.feed(plain):
            break
    http = bytes(record.http.data).decode("utf-8", "replace")
    declared = next((int(v) for k, _, v in (h.partition(":") for h in http.split("\r\n")) if k.strip().lower() == "content-length" and v.strip().isdigit()), None)
    f = record.fields
    return {
        "page_id": _page(f.get("record")), "url": f.get("url"), "record_type": f.get("kind"), "digest": (f.get("digest") or "").rpartition(":")[2], "refers_to": _page(f.get("refers")),
        "payload": record.payload, "sha1": base64.b32encode(record.sha.digest()).decode(), "declared": declared,
    }


def _page(value: str | None) -> int | None:
    digits = (value or "").strip("<>").rpartition(":")[2]
    return int(digits) if digits.lstrip("-").isdigit() else None


def _jump(offsets: np.ndarray, following: np.ndarray) -> np.ndarray:
    """For each candidate the first offset on its chain that is no candidate here, by
    pointer jumping: after k rounds every pointer has passed 2**k records."""
    at = np.searchsorted(offsets, following)
    at[at == len(offsets)] = 0
    inner = offsets[at] == following if len(offsets) else np.zeros(0, bool)
    pointer = np.where(inner, at, np.arange(len(offsets)))
    while True:
        after = pointer[pointer]
        if (after == pointer).all():
            return following[pointer]
        pointer = after


CANDIDATE = "path string, size long, piece long, offset long, next long, exit long"
RECORD = "page_id long, url string, record_type string, digest string, refers_to long, payload long, sha1 string, declared long"


def candidates(manifest: DataFrame, *, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Every candidate record of every byte range, with its successor's offset."""
    spark = manifest.sparkSession
    pieces = manifest.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / range_bytes))).alias("piece"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, piece in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "piece")), strict=True):
                fs, name = _open(path)
                packed = path.endswith(".gz")
                magic = GZIP_MAGIC if packed else PLAIN_MAGIC
                start, end = piece * range_bytes, min(size, (piece + 1) * range_bytes)
                rows = []
                with fs.open_input_file(name) as file:
                    data = file.read_at(min(size, end + len(magic) - 1) - start, start)
                    source = _Source(file, size, start, data)
                    at = data.find(magic)
                    while at >= 0:
                        if start + at < end and (after := _successor(source, start + at, packed)):
                            rows.append((start + at, after))
                        at = data.find(magic, at + 1)
                offsets, following = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
                n = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array([size] * n, pa.int64()), pa.array([piece] * n, pa.int64()), pa.array(offsets), pa.array(following), pa.array(_jump(offsets, following))], names=[c.split()[0] for c in CANDIDATE.split(", ")])

    return pieces.repartition(tasks, "path", "piece").mapInArrow(run, CANDIDATE)


def true_entries(found: DataFrame, *, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, piece, entry) of the ranges that a chain from offset 0 enters. The graph
    has one node per possible entry (the exits of other ranges), not per record."""
    exits = found.select("path", F.col("exit").alias("offset")).distinct().unionByName(found.select("path").distinct().withColumn("offset", F.lit(0).cast("long"))).distinct()
    hops = materialize(found.select("path", "offset", "exit").join(exits, ["path", "offset"]), "hops")
    reached = hops.where("offset = 0").select("path", "offset")
    longest = hops.groupBy("path").count().agg(F.max("count")).first()[0] or 0
    for _ in range(int(longest).bit_length()):  # each round doubles the length of known chains
        jumped = reached.join(hops, ["path", "offset"]).select("path", F.col("exit").alias("offset"))
        reached = materialize(reached.unionByName(jumped).distinct(), "reached")
        far = hops.select("path", "offset", F.col("exit").alias("mid")).join(hops.select("path", F.col("offset").alias("mid"), F.col("exit").alias("far")), ["path", "mid"], "left")
        hops = materialize(far.select("path", "offset", F.coalesce("far", "mid").alias("exit")), "hops")
    return reached.select("path", F.floor(F.col("offset") / range_bytes).alias("piece"), F.col("offset").alias("entry"))


class BrokenArchive(ValueError):
    """The chain of an archive's records does not end at its size."""


def read(manifest: DataFrame, *, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records that are reachable from the start of their archive."""
    found = materialize(candidates(manifest, range_bytes=range_bytes), "candidates")
    entries = true_entries(found, range_bytes=range_bytes)
    ends = entries.groupBy("path").agg(F.max("entry").alias("end"))
    broken = manifest.join(ends, "path", "left").where(~F.col("size").eqNullSafe(F.col("end"))).select("path").limit(3).collect()
    if broken:
        raise BrokenArchive(f"records don't reach the end of {', '.join(r['path'] for r in broken)}")
    marked = found.join(entries.select("path", "piece", F.col("entry").alias("offset"), F.lit(True).alias("is_entry")), ["path", "piece", "offset"], "left")

    def keep(pdf):
        """One range: a bounded number of bytes, so a bounded number of candidates."""
        import pandas as pd

        pdf = pdf.sort_values("offset")
        offsets, following = pdf["offset"].to_numpy(), pdf["next"].to_numpy()
        at = np.searchsorted(offsets, following)
        at[at == len(offsets)] = 0
        pointer = np.where(offsets[at] == following, at, np.arange(len(offsets)))
        live = pdf["is_entry"].notna().to_numpy().copy()
        while True:
            before = live.sum()
            live[pointer[live]] = True
            pointer = pointer[pointer]
            if live.sum() == before and (pointer == pointer[pointer]).all():
                break
        path, size, start = pdf["path"].iloc[0], int(pdf["size"].iloc[0]), int(pdf["piece"].iloc[0]) * range_bytes
        rows = []
        if live.any():
            fs, name = _open(path)
            with fs.open_input_file(name) as file:
                source = _Source(file, size, start, file.read_at(min(size - start, range_bytes), start))
                rows = [_fields(source, o, path.endswith(".gz")) for o in offsets[live].tolist()]
        return pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in ("page_id", "refers_to", "payload", "declared")})

    names = [c.split()[0] for c in RECORD.split(", ")]
    return marked.groupBy("path", "piece").applyInPandas(keep, RECORD)


def resolve(records: DataFrame) -> DataFrame:
    """Per record: payload_bytes and payload_digest of the full payload, for revisits as
    the record they refer to has them."""
    return records.select(
        "page_id", "url",
        F.when(F.col("record_type") == "revisit", F.col("declared")).otherwise(F.col("payload")).alias("payload_bytes"),
        F.when(F.col("record_type") == "revisit", F.col("digest")).otherwise(F.col("sha1")).alias("payload_digest"),
        "record_type", "refers_to",
    )


def round_trip(pages: DataFrame, *, range_bytes: int = RANGE_BYTES, **options) -> DataFrame:
    """Write the pages and read every record back."""
    return resolve(read(write(pages, **options), range_bytes=range_bytes))
