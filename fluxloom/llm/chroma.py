"""Operator 2: audio fingerprints from pitch-class frames, and alignment of recordings.

A media column holds WAV files (16-bit PCM, mixed to one channel). Overlapping frames are folded
into twelve pitch classes. An integral image over time and pitch class gives the sum of any
rectangle in four reads; sixteen rectangle filters, each quantised to a two-bit Gray code, make one
packed 32-bit integer for each frame. Recordings that share integers vote for an offset
by their places; at the offset with most votes the share of differing bits decides.
"""

from __future__ import annotations

import io
import math
import uuid
import wave
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

FRAME, HOP = 1024, 128
LOWEST, HIGHEST = 110.0, 1900.0
WINDOW = np.hanning(FRAME)
#: Frames whose spectra are made at a time.
FRAMES_IN_CACHE = 48
#: Frames that the widest filter spans.
SPAN = 24
#: Votes of an offset, and the most differing bits, for two recordings to match.
VOTES, BIT_ERRORS = 1, 0.2
#: Frames of recordings of equal length whose integers are made together.
FRAMES_AT_ONCE = 4096
#: Integers of queries that a task holds at once (16 bytes each), votes that it counts and integers that it compares at once.
BLOCK_CODES, VOTES_AT_ONCE, CODES_AT_ONCE = 1 << 22, 1 << 18, 1 << 16
#: Bits for an offset: a WAV file has at most 4 GB, so less than 2^24 integers.
OFFSET_BITS = 26


def samples(media: bytes | None) -> tuple[np.ndarray, int]:
    """Samples in [-1, 1] and their rate; nothing for a null, empty or unreadable file."""
    try:
        with wave.open(io.BytesIO(media or b"")) as w:
            if w.getsampwidth() != 2:
                return np.empty(0), 1
            x = np.frombuffer(w.readframes(w.getnframes()), "<i2")
            x = x.reshape(-1, w.getnchannels()).mean(axis=1) if w.getnchannels() > 1 else x
            return x / 32768.0, w.getframerate()
    except (wave.Error, EOFError, ValueError):
        return np.empty(0), 1


@lru_cache(maxsize=16)
def pitch_bins(rate: int) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    """Of a spectrum at ``rate``: the bins in use (from, to), their order by pitch class, the classes present, and where each starts."""
    hz = np.fft.rfftfreq(FRAME, 1 / rate)
    use = np.flatnonzero((hz >= LOWEST) & (hz <= HIGHEST))
    pitch = np.round(12 * np.log2(hz[use] / 440.0)).astype(int) % 12
    order = np.argsort(pitch, kind="stable")  # bins of a pitch class side by side, so that sums need no matrix product
    present, starts = np.unique(pitch[order], return_index=True)
    lo, hi = (int(use[0]), int(use[-1]) + 1) if len(use) else (0, 0)
    return lo, hi, order, present, starts


def chroma(x: np.ndarray, rate: int) -> np.ndarray:
    """Pitch-class energies of each frame, scaled to a length of one; frames in blocks that a processor's cache holds."""
    n = (len(x) - FRAME) // HOP + 1 if len(x) >= FRAME else 0
    if n <= 0:
        return np.empty((0, 12))
    lo, hi, order, present, starts = pitch_bins(rate)
    energy = np.zeros((n, 12))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    rows = min(n, FRAMES_IN_CACHE)
    part, spectrum, power, dealt = np.empty((rows, FRAME)), np.empty((rows, FRAME // 2 + 1), complex), np.empty((rows, hi - lo)), np.empty((rows, hi - lo))
    squares = spectrum.view(float)[:, 2 * lo : 2 * hi]  # real and imaginary parts in turn
    for at in range(0, n, rows):
        k = min(rows, n - at)
        np.fft.rfft(np.multiply(frames[at : at + k], WINDOW, out=part[:k]), axis=1, out=spectrum[:k])
        np.square(squares[:k], out=squares[:k])
        np.add(squares[:k, ::2], squares[:k, 1::2], out=power[:k])
        energy[at : at + k, present] = np.add.reduceat(power[:k].take(order, axis=1, out=dealt[:k], mode="clip"), starts, axis=1)
    size = np.linalg.norm(energy, axis=1, keepdims=True)
    return np.divide(energy, size, out=np.zeros_like(energy), where=size > 1e-9)


def filters() -> list[tuple[int, int, int, int]]:
    """Sixteen rectangle filters (kind, first pitch class, height, width) from a rule: kinds in turn, sizes growing."""
    out = []
    for k in range(16):
        height = (2, 4, 6, 12)[k // 4]
        out.append((k % 4, (5 * k) % (13 - height), height, 4 + 5 * (k % 5)))
    return out


def codes(energy: np.ndarray) -> np.ndarray:
    """A packed 32-bit integer for each run of SPAN frames."""
    return codes_of(energy[None])[0]


def codes_of(energies: np.ndarray) -> np.ndarray:
    """``codes`` of recordings of equal length (recordings, frames, classes), a row for each."""
    size, frames = energies.shape[:2]
    n = frames - SPAN + 1
    if n <= 0:
        return np.empty((size, 0), np.uint32)
    image = np.zeros((size, frames + 1, 13))
    image[:, 1:, 1:] = energies.cumsum(axis=1).cumsum(axis=2)

    def box(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        late, early = image[:, t1 : t1 + n], image[:, t0 : t0 + n]
        return late[..., p1] - early[..., p1] - late[..., p0] + early[..., p0]

    out = np.zeros((size, n), np.uint32)
    for kind, p, h, w in filters():
        half_h, half_w = p + h // 2, w // 2
        whole = box(0, w, p, p + h)
        if kind == 0:
            part = box(0, half_w, p, p + h)
        elif kind == 1:
            part = box(0, w, p, half_h)
        elif kind == 2:
            part = box(0, half_w, p, half_h) + box(half_w, w, half_h, p + h)
        else:
            part = box(w // 4, w - w // 4, p, p + h)
        value = np.log1p(part) - np.log1p(whole - part)
        level = (value > -0.25).astype(np.uint32) + (value > 0.0) + (value > 0.25)
        out = out << np.uint32(2) | (level ^ (level >> np.uint32(1))).astype(np.uint32)
    return out


def fingerprint(media: DataFrame, key: str = "id", column: str = "media") -> DataFrame:
    """(id, codes): packed integers of each recording as little-endian bytes; none for a short or unreadable one."""

    def pack(group: list[tuple[int, np.ndarray]], out: list[bytes]) -> None:
        for (at, _), row in zip(group, codes_of(np.stack([e for _, e in group])), strict=True):
            out[at] = row.astype("<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, alike = [b""] * batch.num_rows, {}
            for at, m in enumerate(common.column(batch, "media")):
                energy = chroma(*samples(m))
                group = alike.setdefault(len(energy), [])
                group.append((at, energy))
                if len(group) * len(energy) >= FRAMES_AT_ONCE:
                    pack(alike.pop(len(energy)), out)
            for group in alike.values():
                pack(group, out)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "codes"])

    return common.map_batches(media.select(media[key].cast("long").alias("id"), media[column].alias("media")), run, "id long, codes binary")


def bit_errors(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, int]:
    """Differing bits and compared integers where ``b`` starts ``offset`` integers into ``a`` (or before, if negative)."""
    lo, hi = max(0, offset), min(len(a), offset + len(b))
    if hi <= lo:
        return 0, 0
    return int(np.bitwise_count(a[lo:hi] ^ b[lo - offset : hi - offset]).sum()), hi - lo


def shelved(queries: DataFrame, folder: str) -> list[list[tuple[str, int, int]]]:
    """Blocks of at most about BLOCK_CODES integers: files (name, recordings, integers) of the queries in the shared folder.

    A task writes a file or more of its queries; only their names and sizes come to the driver.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = common.filesystem(folder)
        ids, raws, size = [], [], 0

        def close() -> pa.RecordBatch:
            name = f"queries-{uuid.uuid4().hex}"
            store.create_dir(base, recursive=True)
            with store.open_output_stream(f"{base}/{name}") as f:
                f.write(np.array(ids, "<i8").tobytes() + np.array([len(r) // 4 for r in raws], "<i8").tobytes() + b"".join(raws))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(ids)]), pa.array([size])], names=["file", "n", "size"])

        for batch in batches:
            for i, raw in zip(common.column(batch, "id"), common.column(batch, "codes"), strict=True):
                if ids and size + len(raw) // 4 > BLOCK_CODES:
                    yield close()
                    ids, raws, size = [], [], 0
                ids.append(i)
                raws.append(raw)
                size += len(raw) // 4
        if ids:
            yield close()

    blocks, held = [], BLOCK_CODES + 1
    for file in sorted(map(tuple, common.map_batches(queries, write, "file string, n long, size long").collect())):
        if held + file[2] > BLOCK_CODES:
            blocks.append([])
            held = 0
        blocks[-1].append(file)
        held += file[2]
    return blocks


class Prints:
    """Fingerprints of some recordings: ids, sizes, and the integers of all side by side."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray):
        self.ids, self.sizes, self.codes = ids, sizes, codes
        self.starts = np.cumsum(sizes) - sizes

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Where an integer differs from the one before it in its recording, and in which recording; a long run is one place."""
        new = np.ones(len(self.codes), bool)
        new[1:] = self.codes[1:] != self.codes[:-1]
        new[self.starts[self.sizes > 0]] = True
        at = np.flatnonzero(new)
        return at, np.repeat(np.arange(len(self.sizes)), self.sizes)[at]


class Block:
    """Queries, and a sorted list of the places of their integers."""

    def __init__(self, prints: Prints):
        at, whose = prints.places()
        keys = prints.codes[at].astype(np.uint64) << np.uint64(32) | whose.astype(np.uint64)
        order = np.argsort(keys, kind="stable")
        self.prints, self.keys, self.pos = prints, keys[order], (at - prints.starts[whose])[order].astype(np.int32)

    @classmethod
    def read(cls, folder: str, files: list[tuple[str, int, int]]) -> Block:
        store, base = common.filesystem(folder)
        parts = []
        for name, n, size in files:
            with store.open_input_file(f"{base}/{name}") as f:
                raw = f.read()
            parts.append([np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<i8", n, 8 * n), np.frombuffer(raw, "<u4", size, 16 * n)])
        return cls(Prints(*map(np.concatenate, zip(*parts, strict=True))))

    def matches(self, got: Prints, votes: int, most: float) -> list[np.ndarray]:
        """Columns (id, query, offset, votes, differing bits, compared integers) of recordings that match a query at its best offset.

        Votes are counted for some recordings, or for one and some queries, where all would be over VOTES_AT_ONCE.
        """
        at, whose = got.places()
        order = np.argsort(got.codes[at], kind="stable")  # neighbours in the list are looked up one after the other
        found, work = [], [(at[order], whose[order], 0, len(self.prints.ids))]
        while work:
            at, whose, lo, hi = work.pop()
            keys = got.codes[at].astype(np.uint64) << np.uint64(32)
            first, last = np.searchsorted(self.keys, keys | np.uint64(lo)), np.searchsorted(self.keys, keys + np.uint64(hi))
            met = np.flatnonzero(last > first)
            at, whose, first, n = at[met], whose[met], first[met], (last - first)[met]
            seen = np.unique(whose)
            if n.sum() > VOTES_AT_ONCE and len(seen) > 1:
                early = whose < seen[len(seen) // 2]
                work += [(at[early], whose[early], lo, hi), (at[~early], whose[~early], lo, hi)]
            elif n.sum() > VOTES_AT_ONCE and hi - lo > 1:
                work += [(at, whose, lo, (lo + hi) // 2), (at, whose, (lo + hi) // 2, hi)]
            elif len(n):
                rows = stretches(first, n)
                query = (self.keys[rows] & np.uint64(0xFFFFFFFF)).astype(np.int64)
                found.append(self.compared(got, *best_offsets(np.repeat(whose, n), query, self.pos[rows] - np.repeat(at - got.starts[whose], n), votes), most))
        return [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0, np.int64)] * 6

    def compared(self, got: Prints, who: np.ndarray, query: np.ndarray, offset: np.ndarray, votes: np.ndarray, most: float) -> list[np.ndarray]:
        asked = self.prints
        apart = got.ids[who] != asked.ids[query]
        who, query, offset, votes = who[apart], query[apart], offset[apart], votes[apart]
        lo = np.maximum(offset, 0)
        n = np.minimum(asked.sizes[query], offset + got.sizes[who]) - lo
        bits = differing_bits(asked.codes, asked.starts[query] + lo, got.codes, got.starts[who] + lo - offset, n)
        good = bits / (32 * n) <= most
        return [c[good] for c in (got.ids[who], asked.ids[query], offset, votes, bits, n)]


def stretches(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each start and the numbers after it, ``n`` of them, side by side."""
    return np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum())


def best_offsets(who: np.ndarray, query: np.ndarray, offset: np.ndarray, votes: int) -> tuple[np.ndarray, ...]:
    """Of a row for each vote: (who, query, offset, votes) at the offset with most votes, the least of equal ones."""
    queries = int(query.max()) + 1
    keys = np.sort((who * queries + query << OFFSET_BITS) + offset + (1 << OFFSET_BITS - 1))
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    n, keys = np.diff(np.r_[first, len(keys)]), keys[first]
    pair = keys >> OFFSET_BITS
    starts = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
    best = np.repeat(np.maximum.reduceat(n, starts), np.diff(np.r_[starts, len(pair)]))
    top = np.flatnonzero((n == best) & (n >= votes))
    top = top[np.r_[True, pair[top][1:] != pair[top][:-1]][: len(top)]]
    return pair[top] // queries, pair[top] % queries, (keys[top] & (1 << OFFSET_BITS) - 1) - (1 << OFFSET_BITS - 1), n[top]


def differing_bits(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Differing bits of stretches of ``n`` integers of ``a`` and of ``b``, about CODES_AT_ONCE integers at a time; no stretch is empty."""
    out, ends = np.zeros(len(n), np.int64), np.cumsum(n)
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CODES_AT_ONCE, "right")))
        m = n[lo:hi]
        apart = np.bitwise_count(a[stretches(a_at[lo:hi], m)] ^ b[stretches(b_at[lo:hi], m)])
        out[lo:hi] = np.add.reduceat(apart, np.cumsum(m) - m, dtype=np.int64)
        lo = hi
    return out


def align(prints: DataFrame, queries: DataFrame, votes: int = VOTES, most: float = BIT_ERRORS) -> DataFrame:
    """(id, query, offset, votes, bit_error_rate, overlap) of recordings that match a query at its best offset.

    ``prints`` and ``queries``: (id, codes), without nulls. The queries are written in blocks of about
    BLOCK_CODES integers, and recordings stream past each block: a task looks up their integers in the block's
    sorted list, counts votes and compares bits at once. So neither places, votes nor pairs that share an
    integer by chance are rows of Spark or are shuffled; only matches leave a task. The work on such pairs
    still grows with recordings times queries. Tasks are the partitions of ``prints``, once for each block.
    """
    folder = common.shared_dir(prints.sparkSession)
    schema = "id long, query long, offset long, votes long, bit_error_rate double, overlap long"

    def past(files: list[tuple[str, int, int]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = None
            for batch in batches:
                block = block or Block.read(folder, files)
                raws = common.column(batch, "codes")
                got = Prints(batch.column(0).to_numpy(), np.array([len(r) // 4 for r in raws], np.int64), np.frombuffer(b"".join(raws), "<u4"))
                *columns, bits, n = block.matches(got, votes, most)
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(bits / (32 * n)), pa.array(n)], names=["id", "query", "offset", "votes", "bit_error_rate", "overlap"])

        return common.map_batches(prints.select("id", "codes"), run, schema)

    blocks = shelved(queries.select("id", "codes"), folder)
    return reduce(DataFrame.union, map(past, blocks)) if blocks else prints.sparkSession.createDataFrame([], schema)


def search(media: DataFrame, is_query, key: str = "id", column: str = "media", votes: int = VOTES, most: float = BIT_ERRORS) -> DataFrame:
    """(id, class_id, n_codes, matches): each recording, its class, and the matches of its class with the queries'.

    Recordings with equal fingerprints are one class, named by its smallest id; only classes are
    aligned, so copies make no pairs. matches: (query class, offset, votes, bit_error_rate, overlap),
    by query; empty where nothing matches. ``is_query`` is a condition on id. Null, empty, short and
    unreadable media have no codes and are one class without matches. Rows with a null id are left
    out; rows that repeat an id stay. Other columns are ignored; an empty table gives an empty one.
    """
    folder = common.shared_dir(media.sparkSession)
    prints = common.stored(fingerprint(media, key, column).where("id is not null"), folder, "prints")
    classes = common.stored(prints.groupBy("codes").agg(F.min("id").alias("class_id"), F.max(is_query(F.col("id"))).alias("asked")), folder, "classes")
    some = classes.where(F.length("codes") > 0)
    found = align(some.select(F.col("class_id").alias("id"), "codes"), some.where("asked").select(F.col("class_id").alias("id"), "codes"), votes, most)
    lists = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("query", "offset", "votes", "bit_error_rate", "overlap"))).alias("matches"))
    empty = F.from_json(F.lit("[]"), "array<struct<query:long,offset:long,votes:long,bit_error_rate:double,overlap:long>>")
    by_class = classes.join(lists, classes["class_id"] == lists["id"], "left").select("codes", "class_id", F.coalesce("matches", empty).alias("matches"))
    return prints.join(by_class, "codes").select("id", "class_id", F.floor(F.length("codes") / 4).cast("long").alias("n_codes"), "matches")


def tune(vector: list[float], rate: int = 4000, seconds: float = 0.08) -> bytes:
    """A WAV file that plays a vector: a tone of an equal length for each number, higher for larger ones."""
    x = np.array(vector or [], float)
    scale = np.sqrt((x**2).mean()) if len(x) else 1.0
    step = np.clip(np.round(12 + 8 * np.nan_to_num(x / (scale or 1.0))), 0, 35)
    n = int(rate * seconds)
    phase = 2 * math.pi * np.cumsum(np.repeat(220.0 * 2 ** (step / 12), n)) / rate
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((20000 * np.sin(phase)).astype("<i2").tobytes())
    return out.getvalue()


def as_media(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, media): each vector as a recording, so that the operator has a media column to work on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([tune(v) for v in common.column(batch, "vector")], pa.binary())], names=["id", "media"])

    return common.map_batches(vectors.select(vectors[key].cast("long").alias("id"), vectors[column].alias("vector")), run, "id long, media binary")
