"""Operator 10: WARC archives with revisits, and a reader that salvages damaged ones.

A record is one gzip member. The reader checks each member (its length and CRC, the version line,
the header, Content-Length and the block digest). Where a check fails it looks for the next gzip
magic, or version line in plain archives, from the byte after, and logs the gap with its reason.
Members are inflated through a window, record by record, so one that breaks still gives back the
records before the damage.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

VERSION = b"WARC/1.1\r\n"
GZIP = b"\x1f\x8b\x08"
FILE_BYTES, READ_BYTES = 64 << 20, 1 << 20
#: Bytes of a member that are inflated at a time, and the longest header of a record.
PACKED_BYTES, HEADER_BYTES = 1 << 16, 16 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, size: int, refers_to: int | None) -> bytes:
    """One record as a gzip member. A revisit's block holds no payload, but its header has the length of it."""
    block = HTTP + (payload if refers_to is None else b"")
    lines = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(page_id))}>",
        "WARC-Date": "2024-01-01T00:00:00Z",
        "WARC-Target-URI": "".join((url or "").split()),
        "WARC-Payload-Digest": f"sha1:{payload_digest}",
        "WARC-Block-Digest": f"sha1:{digest(block)}",
        "X-Page-ID": "" if page_id is None else str(page_id),
        "X-Payload-Length": str(size),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if refers_to is not None:
        lines |= {"WARC-Profile": REVISIT, "WARC-Refers-To": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(refers_to))}>", "X-Refers-To-Page": str(refers_to)}
    plain = VERSION + "".join(f"{k}: {v}\r\n" for k, v in lines.items()).encode() + b"\r\n" + block + b"\r\n\r\n"
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(plain) + press.flush()


def with_roles(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """pages with digest, size and refers_to (null: a response).

    Only digests and ids are grouped, with partial maxima, so a payload that a third of the pages
    share is one row; pages then meet the digests that repeat, in a join that Spark may split.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(t or "").encode() for t in common.column(batch, "html")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest(r) for r in raw], pa.string()), pa.array([len(r) for r in raw], pa.int64())], names=["page_id", "digest", "size"])

    text = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["html"].alias("html"))
    digests = common.stored(common.map_batches(text, run, "page_id long, digest string, size long"), folder, "digests")
    newest = digests.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("newest"), F.count("*").alias("n")).where("n > 1")
    refers = digests.join(newest, "digest").where("page_id < newest").select("page_id", F.col("newest").alias("refers_to")).groupBy("page_id").agg(F.max("refers_to").alias("refers_to"))
    whole = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"), pages["html"].alias("html"))
    return whole.join(refers, "page_id", "left")


def write(roles: DataFrame, folder: str) -> DataFrame:
    """Archives of ``with_roles`` rows in the shared folder; one row for each: file, n_records, n_bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = common.filesystem(folder)
        store.create_dir(base, recursive=True)
        part, k, out = TaskContext.get().partitionId(), 0, None

        def close():
            out.close()
            store.move(draft, f"{base}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n]), pa.array([size])], names=["file", "n_records", "n_bytes"])

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(common.column(batch, c) for c in ("page_id", "url", "html", "refers_to")), strict=True):
                if out is None:
                    name = f"pages-{part:06d}-{k:04d}.warc.gz"
                    draft = f"{base}/{name}.{uuid.uuid4().hex}"
                    out, n, size = store.open_output_stream(draft), 0, 0
                payload = (html or "").encode()
                raw = record(page_id, url, payload, digest(payload), len(payload), refers_to)
                out.write(raw)
                n, size = n + 1, size + len(raw)
                if size >= FILE_BYTES:
                    yield close()
                    out, k = None, k + 1
        if out is not None:
            yield close()

    return common.map_batches(roles, run, "file string, n_records long, n_bytes long")


class Bytes:
    """A window over a file that is read on demand and forgotten behind the reader."""

    def __init__(self, f):
        self.f, self.size, self.lo, self.held = f, f.size(), 0, b""

    def at(self, a: int, n: int) -> bytes:
        if a < self.lo or a + n > self.lo + len(self.held):
            self.lo, self.held = a, self.f.read_at(min(max(n, READ_BYTES), self.size - a), a) if a < self.size else b""
        return self.held[a - self.lo : a - self.lo + n]

    def find(self, what: bytes, a: int) -> int:
        """First place of ``what`` at or after ``a``; the file's size if there is none."""
        while a < self.size:
            part = self.at(a, min(READ_BYTES, self.size - a))
            if (k := part.find(what)) >= 0:
                return a + k
            if a + len(part) >= self.size:
                break
            a += max(1, len(part) - len(what) + 1)
        return self.size


class Plain:
    """A file's bytes from a place on, read forwards, with a way back to a mark."""

    def __init__(self, data: Bytes, at: int):
        self.data, self.pos, self.error = data, at, ""

    def peek(self, n: int) -> bytes:
        """The next ``n`` bytes, or all that are left."""
        return self.data.at(self.pos, min(n, self.data.size - self.pos))

    def skip(self, n: int):
        self.pos += n

    def mark(self):
        return self.pos

    def back(self, mark):
        self.pos = mark

    def trusted(self) -> bool:
        return True


class Inflated:
    """The content of the gzip member at a place, inflated as it is read: a window of it is in memory, never the whole.

    Damage ends the content behind the last byte before it, and ``error`` says so. ``after`` is the place behind a sound member.
    """

    def __init__(self, data: Bytes, at: int):
        self.data, self.start, self.place = data, at, at
        self.press, self.tail, self.step = zlib.decompressobj(31), b"", READ_BYTES
        self.held, self.at, self.base, self.error, self.sound = b"", 0, 0, "", None

    @property
    def pos(self) -> int:
        return self.base + self.at

    @property
    def after(self) -> int:
        return self.place - len(self.press.unused_data)

    def _more(self) -> bool:
        """Inflate a piece. Where a piece has damage, smaller ones give all that precedes it."""
        while not (self.error or self.press.eof):
            if not self.tail:
                self.tail = self.data.at(self.place, min(PACKED_BYTES, self.data.size - self.place))
                self.place += len(self.tail)
                if not self.tail:
                    self.error = "member cut short"
                    return False
            kept = self.press.copy()
            try:
                got = self.press.decompress(self.tail, self.step)
            except zlib.error as e:
                if self.step == 1:
                    self.error = str(e)
                    return False
                self.press, self.step = kept, max(1, self.step // 16)
                continue
            self.tail = self.press.unconsumed_tail
            if got:
                self.held, self.base, self.at = self.held[self.at :] + got, self.pos, 0
                return True
        return False

    def peek(self, n: int) -> bytes:
        while len(self.held) - self.at < n and self._more():
            pass
        return self.held[self.at : self.at + n]

    def skip(self, n: int):
        self.at += n

    def mark(self):
        return self.place, self.press.copy(), self.tail, self.step, self.held, self.at, self.base, self.error

    def back(self, mark):
        self.place, self.press, self.tail, self.step, self.held, self.at, self.base, self.error = mark
        self.press = self.press.copy()

    def trusted(self) -> bool:
        """Whether the whole member passes its checks, so that a record without a digest can be believed. Inflates it once more."""
        if self.sound is None:
            again = Inflated(self.data, self.start)
            while part := again.peek(READ_BYTES):
                again.skip(len(part))
            self.sound = not again.error
        return self.sound


def seek(src: Plain | Inflated, what: bytes):
    """Move to the first place of ``what`` behind the current one, or to the end."""
    src.skip(1)
    while part := src.peek(1 << 16):
        if (k := part.find(what)) >= 0:
            return src.skip(k)
        src.skip(max(1, len(part) - len(what) + 1))


def take(src: Plain | Inflated) -> dict:
    """Header fields and payload checks of the record that starts here; its block passes by in pieces."""
    if src.peek(10) not in (b"WARC/1.0\r\n", b"WARC/1.1\r\n"):
        raise ValueError("no version line")
    n, end = 1 << 12, -1
    while end < 0:
        head = src.peek(n)
        end = head.find(b"\r\n\r\n")
        if end < 0 and (len(head) < n or n > HEADER_BYTES):
            raise ValueError("header without end")
        n *= 4
    fields: dict[str, str] = {}
    for line in head[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header line without colon")
        fields[name.decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        raise ValueError("no content length")
    src.skip(end + 4)
    block, payload, size, left = hashlib.sha1(), hashlib.sha1(), 0, int(length)
    http, edge = fields.get("content-type", "").startswith("application/http"), b""
    while left:
        part = src.peek(min(left, READ_BYTES))
        if not part:
            raise ValueError("block cut short")
        src.skip(len(part))
        left -= len(part)
        block.update(part)
        if http:  # the payload starts behind the first empty line
            edge += part
            k = edge.find(b"\r\n\r\n")
            http, part, edge = k < 0, edge[k + 4 :] if k >= 0 else b"", edge[-3:]
        payload.update(part)
        size += len(part)
    if src.peek(4) != b"\r\n\r\n":
        raise ValueError("block cut short")
    src.skip(4)
    named = lambda h: f"sha1:{base64.b32encode(h.digest()).decode()}"
    if fields.get("warc-block-digest", named(block)) != named(block):
        raise ValueError("block digest differs")
    if "warc-block-digest" not in fields and not src.trusted():
        raise ValueError("no block digest in a broken member")
    kind = fields.get("warc-type", "")
    out = {"record_type": kind, "page_id": number(fields.get("x-page-id")), "url": fields.get("warc-target-uri"), "refers_to": number(fields.get("x-refers-to-page"))}
    if kind == "revisit":
        return out | {"payload_bytes": number(fields.get("x-payload-length")), "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:")}
    if fields.get("warc-payload-digest", named(payload)) != named(payload):
        raise ValueError("payload digest differs")
    return out | {"payload_bytes": size, "payload_digest": named(payload).removeprefix("sha1:")}


def number(text: str | None) -> int | None:
    return int(text) if text and text.lstrip("-").isdigit() else None


def content(src: Plain | Inflated) -> Iterator[dict]:
    """Records (with ``at``) and gaps (``at``, gap_bytes, reason), in order, each as soon as it is known.

    After a failed check the search goes on from the byte behind the failed record's first one. Content that breaks off has no last gap,
    ``src.error`` tells of it; content without any record gives only the gap.
    """
    bad, reason = None, ""
    while src.peek(1):
        mark, at = src.mark(), src.pos
        try:
            found = take(src)
        except ValueError as e:
            src.back(mark)
            if bad is None:
                bad, reason = at, str(e)
            seek(src, b"WARC/1.")
            continue
        if bad is not None:
            yield {"at": bad, "gap_bytes": at - bad, "reason": reason}
            bad = None
        yield found | {"at": at}
    if bad is not None and not src.error:
        yield {"at": bad, "gap_bytes": src.pos - bad, "reason": reason}


def believed(src: Inflated) -> Iterator[dict]:
    """``content`` of a member. Where it breaks off just behind a record, nothing shows that the record is whole, so it is left out."""
    held, end = None, 0
    for one in content(src):
        if held is not None:
            yield held
        held, end = one, src.pos
    if held is not None and ("reason" in held or not src.error or src.pos > end):
        yield held


def salvage(f) -> Iterator[dict]:
    """Records and gaps of one archive, in order: a gap has gap_start, gap_bytes and reason.

    A gzip member may hold any number of records. Damage within its content is a gap at the member's place. Of a member that breaks, the
    records that fit their block digests and are followed by more content before the damage are kept; its gap runs from its first byte to the
    next member that has a record, and the reason says how many were kept. So a broken member of one record is a gap. Members and records of any length pass through a window of a few MB; only a header must
    fit it (HEADER_BYTES).
    """
    data = Bytes(f)
    packed = data.at(0, 3) == GZIP or (data.find(GZIP, 0) < data.find(b"WARC/1.", 0))
    if not packed:
        for one in content(Plain(data, 0)):
            at = one.pop("at")
            yield one | ({"gap_start": at} if "reason" in one else {"offset": at})
        return
    at, bad, reason = 0, None, ""
    while at < data.size:
        src, kept, first = Inflated(data, at), 0, None
        if data.at(at, len(GZIP)) == GZIP:
            for one in believed(src):
                place, damage = one.pop("at"), "reason" in one
                if damage:
                    one |= {"gap_start": at, "reason": f"{one['reason']}, at byte {place} of a member's content"}
                    if not kept and first is None:
                        first = one  # a gap of its own only if a record follows
                        continue
                elif bad is not None:
                    yield {"gap_start": bad, "gap_bytes": at - bad, "reason": reason}
                    bad = None
                if first is not None and not kept:
                    yield first
                kept += not damage
                yield one if damage else one | {"offset": at}
        else:
            src.error = "no record starts here"
        if kept and not src.error:
            at = src.after
            continue
        if bad is None:
            why = src.error or (first or {}).get("reason", "empty member")
            bad, reason = at, why + (f", at byte {src.pos} of a member's content; {kept} records before it kept" if kept else "")
        at = data.find(GZIP, at + 1)
    if bad is not None:
        yield {"gap_start": bad, "gap_bytes": data.size - bad, "reason": reason}


FIELDS = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "offset", "gap_start", "gap_bytes", "reason")
TYPES = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())


def read(files: DataFrame, folder: str) -> DataFrame:
    """Records and quarantined gaps of archives (column file): ``reason`` is null for records. One task reads an archive, by parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = common.filesystem(folder)
        for batch in batches:
            for name in common.column(batch, "file"):
                rows: list[dict] = []
                with store.open_input_file(f"{base}/{name}") as f:
                    for row in salvage(f):
                        rows.append(row)
                        if len(rows) == 4096:
                            yield packed(name, rows)
                            rows = []
                yield packed(name, rows)

    def packed(name: str, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), *(pa.array([r.get(c) for r in rows], t) for c, t in zip(FIELDS, TYPES, strict=True))], names=["file", *FIELDS])

    kinds = {pa.int64(): "long", pa.string(): "string"}
    return common.map_batches(common.spread(files.select("file"), "file"), run, "file string, " + ", ".join(f"{c} {kinds[t]}" for c, t in zip(FIELDS, TYPES, strict=True)))


def archive(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) read back from written archives.

    A null html is an empty payload. Equal payloads of at least ``least_bytes`` bytes: the largest
    page_id is the response and smaller ones revisit it; rows that share the largest id are all
    responses, and rows that share an id refer to the largest of their responses. A null page_id is
    a response. Other columns are ignored; an empty table gives an empty one. An archive that does
    not give back all its records raises an error that names it and its first gap.
    """
    folder = common.shared_dir(pages.sparkSession)
    files = common.stored(write(with_roles(pages, folder, least_bytes), f"{folder}/warc"), folder, "files")
    found = common.stored(read(files, f"{folder}/warc"), folder, "read")
    counted = found.groupBy("file").agg(F.count(F.when(F.col("reason").isNull(), 1)).alias("n"), F.min(F.struct("gap_start", "gap_bytes", "reason")).alias("gap"), F.count("reason").alias("gaps"))
    lost = files.join(counted, "file", "left").where("gaps > 0 or n is null or n <> n_records").select("file", "gap").head(1)
    if lost:
        raise ValueError(f"archive {lost[0]['file']} does not give back its records: {lost[0]['gap']}")
    return found.where("reason is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
