"""Operators 4 and 5: flat token files scanned for separators, and dictionary-compressed token files.

Files go to the shared folder through Arrow's file systems. A task writes under a name of its own
attempt and moves the file to its final name when it is whole, so a repeated task leaves one file.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import common
from .bpe import KEPT_LENGTH, MARKS, PRETOKEN, byte_alphabet, pieces_of

#: Bytes of a flat file that a scan task reads at a time.
BLOCK_BYTES = 4 << 20
#: Bytes after which a writer starts another file.
FILE_BYTES = 64 << 20
#: Documents, and ids of each, that the compression dictionary may be trained on, and its bytes.
DICT_DOCS, DICT_IDS, DICT_BYTES = 1000, 4096, 32 << 10
MAGIC = b"TOKZ0001"
#: Bytes read at once from a compressed file.
READ_BYTES = 8 << 20


# ---- operator 4 ---------------------------------------------------------------------------------


def write_flat(docs: DataFrame, folder: str, vocabulary: str, end_id: int, width: int = 2) -> DataFrame:
    """Flat files of ids of ``width`` bytes each, a separator after each document, and nothing else: no index.

    Returns one row per file: file, n_bytes, and the doc_ids in it, in order. A null or empty text is
    a separator alone; repeated rows and null ids are kept; an empty table gives no file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if max(end_id, *ranks.values()) >= 1 << 8 * width:
            raise ValueError(f"ids of this vocabulary need more than {width} bytes")
        encoder = tiktoken.Encoding("flat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        store, base = common.filesystem(folder)
        store.create_dir(base, recursive=True)
        part, k, out, ids = TaskContext.get().partitionId(), 0, None, []
        size = 0

        def close():
            out.close()
            store.move(draft, name)
            return pa.RecordBatch.from_arrays([pa.array([f"flat-{part:06d}-{k:04d}"]), pa.array([size]), pa.array([ids], pa.list_(pa.int64()))], names=["file", "n_bytes", "doc_ids"])

        for batch in batches:
            for doc, text in zip(common.column(batch, "doc_id"), common.column(batch, "text"), strict=True):
                if out is None:
                    name = f"{base}/flat-{part:06d}-{k:04d}"
                    draft = f"{name}.{uuid.uuid4().hex}"
                    out, size, ids = store.open_output_stream(draft), 0, []
                raw = np.array([*encoder.encode_ordinary(text or ""), end_id], f"<u{width}").tobytes()
                out.write(raw)
                size += len(raw)
                ids.append(doc)
                if size >= FILE_BYTES:
                    yield close()
                    out, k = None, k + 1
        if out is not None:
            yield close()

    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return common.map_batches(texts, run, "file string, n_bytes long, doc_ids array<long>")


def scan_separators(files: DataFrame, folder: str, end_id: int, block_bytes: int = BLOCK_BYTES, width: int = 2) -> DataFrame:
    """(file, doc_index, start, n_tokens) of every document of flat files (file, n_bytes), by blocks.

    Each block is searched at once for the separator. It yields its separators' places and their
    number; a running sum over a file's blocks numbers the documents, and a running maximum of the
    last separator so far stitches documents that began in earlier blocks. Tokens after a file's
    last separator are a document without an end: they come out as a row with ``ended`` false.
    Separators side by side are empty documents; an empty file and an empty table give no row.
    """
    block_bytes -= block_bytes % width
    blocks = files.where("n_bytes > 0").select("file", "n_bytes", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_bytes") - 1) / block_bytes))).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = common.filesystem(folder)
        for batch in batches:
            for file, n, block in zip(*(common.column(batch, c) for c in ("file", "n_bytes", "block")), strict=True):
                with store.open_input_file(f"{base}/{file}") as f:
                    ids = np.frombuffer(f.read_at(min(block_bytes, n - block * block_bytes), block * block_bytes), f"<u{width}")
                places = np.flatnonzero(ids == end_id) + block * (block_bytes // width)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([places], pa.list_(pa.int64())), pa.array([n // width])], names=["file", "block", "places", "total"])

    found = common.map_batches(common.spread(blocks, "file", "block"), run, "file string, block long, places array<long>, total long")
    order = Window.partitionBy("file").orderBy("block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    stitched = found.select(
        "file", "block", "total",
        F.coalesce(F.sum(F.size("places")).over(earlier), F.lit(0)).alias("docs_before"),
        F.coalesce(F.max(F.array_max("places")).over(earlier) + 1, F.lit(0)).alias("start"),
        (F.lead("block").over(order).isNull()).alias("last"),
        "places",
    )
    with_tail = stitched.withColumn("ends", F.when(F.col("last") & (F.coalesce(F.array_max("places") + 1, F.col("start")) < F.col("total")), F.concat("places", F.array("total"))).otherwise(F.col("places")))
    each = with_tail.select("file", "docs_before", "start", "total", "ends", F.posexplode("ends").alias("k", "end"))
    start = F.when(F.col("k") == 0, F.col("start")).otherwise(F.element_at("ends", F.col("k")) + 1)
    return each.select("file", (F.col("docs_before") + F.col("k")).alias("doc_index"), start.alias("start"), (F.col("end") - start).alias("n_tokens"), (F.col("end") < F.col("total")).alias("ended"))


def token_counts(docs: DataFrame, vocabulary: str | None = None, end_id: int = 50256, block_bytes: int = BLOCK_BYTES, width: int = 2) -> DataFrame:
    """(doc_id, n_tokens): tokens of each whole text, counted by a scan of flat files of its ids.

    Null and empty texts have no tokens. Repeated rows stay repeated, a null doc_id is kept, other
    columns are ignored, an empty table gives an empty one.
    """
    folder = common.shared_dir(docs.sparkSession)
    files = common.stored(write_flat(docs, f"{folder}/flat", vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), end_id, width), folder, "files")
    names = files.select("file", F.posexplode("doc_ids").alias("doc_index", "doc_id"))
    counted = scan_separators(files.select("file", "n_bytes"), f"{folder}/flat", end_id, block_bytes, width)
    # both sides come from short tables and are long: Spark's size estimates would broadcast one of them
    return names.hint("merge").join(counted, ["file", "doc_index"]).select("doc_id", "n_tokens")


# ---- operator 5 ---------------------------------------------------------------------------------


#: Entries of each generation of a worker's dictionaries of pieces and of words: the library is slow to learn a word.
KEPT_PIECES, KEPT_WORDS = 400_000, 150_000


class Remembered(dict):
    """Ids of pieces, made by ``learn`` where they are first met. Two generations bound it: what the older one has moves over when it is used."""

    def __init__(self, learn: Callable[[str], bytes], limit: int):
        super().__init__()
        self.learn, self.limit, self.old = learn, limit, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.learn(piece)
        if len(piece) <= KEPT_LENGTH:
            self[piece] = ids
        return ids

    def renew(self) -> None:
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()


class LibraryEncoder:
    """Encodes with the tokenizers library; its model gets each word once while the word is remembered.

    A text is cut at single spaces before words, which always start pre-tokens (see ``bpe.pieces_of``),
    and each piece is looked up. A piece that this library's own pre-tokenizer has to cut goes
    through the whole tokenizer.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.packed = [struct.pack("<I", k) for k in range(self.tokenizer.get_vocab_size())]
        with open(path, encoding="utf-8") as f:
            self.special = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in json.load(f)["added_tokens"]}
        self.alphabet = dict(enumerate(byte_alphabet()))
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pieces, self.words = Remembered(self.learn, KEPT_PIECES), Remembered(self.learn_word, KEPT_WORDS)

    def learn(self, piece: str) -> bytes:
        """Ids of a piece: a space and what follows it, or, after a NUL, a text's start as it is."""
        if piece.isalpha():
            if piece.isascii():
                return b"".join([self.packed[t.id] for t in self.tokenize(self.alphabet[32] + piece)])
            return self.learn_word(" " + piece)
        core, mark = piece[:-1], piece[-1:]
        if mark in MARKS and core.isalpha():
            return self.pieces[core] + self.words[mark]
        text = piece[1:] if piece[:1] == "\0" else " " + piece
        if not text.isascii() and max(text) > "\u03ff":
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join([self.words[w] for w in PRETOKEN.findall(text)])

    def learn_word(self, word: str) -> bytes:
        """Ids of one pre-token, by the library's model."""
        if word.isascii() and word.isprintable():  # such characters but the space stand for themselves
            word = word.replace(" ", self.alphabet[32])
        elif word.isascii() or max(word) <= "\u03ff":
            word = word.encode().decode("latin-1").translate(self.alphabet)
        else:
            return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        return b"".join([self.packed[t.id] for t in self.tokenize(word)])

    def ids_of(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, pieces_of(text))) if text else b""

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        self.pieces.renew()
        self.words.renew()
        out = []
        for text in texts:
            if self.at_special and any(s in text for s in self.special):
                out.append(b"".join([self.special.get(part) or self.ids_of(part) for part in self.at_special.split(text)]))
            else:
                out.append(self.ids_of(text))
        return out


@lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    """A worker's encoder, which serves all tasks that the worker runs."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return LibraryEncoder(path)


def pack(raw: bytes) -> bytes:
    """Serialized ids of a document: 16 bits each where all fit, else 32, after a byte that says which."""
    ids = np.frombuffer(raw, "<u4")
    return b"\x02" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else b"\x04" + raw


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if data[0] == 2 else "<u4", offset=1).astype("<u4")


def train_dictionary(docs: DataFrame, path: str, end_id: int, most: int = DICT_DOCS) -> bytes:
    """A zstandard dictionary from serialized ids of the documents with the smallest hashes of doc_id.

    At most ``most`` documents and DICT_IDS ids of each, from a place in its text that a hash gives.
    Too few to train on: no dictionary.
    """
    size = F.lit(4 * DICT_IDS)
    start = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.length("text") - size, F.lit(0)) + 1).cast("int") + 1
    chosen = docs.where("doc_id is not null and text is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", F.substr("text", start, size).alias("text")).dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    encoder = library_encoder(path)
    end = np.array([end_id], "<u4").tobytes()
    samples = [pack((raw + end)[-4 * DICT_IDS :]) for raw in encoder.encode([r["text"] for r in rows])]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_compressed(docs: DataFrame, folder: str, path: str, end_id: int, dictionary: bytes) -> DataFrame:
    """Files of separately compressed documents in ascending doc_id order; one row for each file.

    File: MAGIC, the dictionary's SHA-256, frames, then an index of (doc_id, is null, first byte,
    bytes, tokens) for each document, its length and MAGIC again. The dictionary lies beside them.
    Rows: part, k, file, n_docs, n_tokens. Files (part, k) follow one another in doc_id order.
    """
    store, base = common.filesystem(folder)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/dictionary") as f:
        f.write(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = library_encoder(path), np.array([end_id], "<u4").tobytes()
        press = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=3)
        store, base = common.filesystem(folder)
        part, k, out = TaskContext.get().partitionId(), 0, None

        def close():
            body = b"".join(index)
            out.write(body + struct.pack("<Q", len(body)) + MAGIC)
            out.close()
            store.move(draft, f"{base}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, k, name, len(index), tokens)], names=["part", "k", "file", "n_docs", "n_tokens"])

        for batch in batches:
            for doc, raw in zip(common.column(batch, "doc_id"), encoder.encode([t or "" for t in common.column(batch, "text")]), strict=True):
                if out is None:
                    name = f"tokens-{part:06d}-{k:04d}"
                    draft = f"{base}/{name}.{uuid.uuid4().hex}"
                    out, index, at, tokens = store.open_output_stream(draft), [], 40, 0
                    out.write(MAGIC + hashlib.sha256(dictionary).digest())
                frame = press.compress(pack(raw + end))
                out.write(frame)
                n = len(raw) // 4 + 1
                index.append(struct.pack("<q?QQQ", doc or 0, doc is None, at, len(frame), n))
                at, tokens = at + len(frame), tokens + n
                if at >= FILE_BYTES:
                    yield close()
                    out, k = None, k + 1
        if out is not None:
            yield close()

    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    ordered = texts.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return common.map_batches(ordered, run, "part long, k long, file string, n_docs long, n_tokens long")


INDEX = struct.Struct("<q?QQQ")


class TokenFile:
    """Random access to one file of ``write_compressed``: its index, and any document by its place."""

    def __init__(self, store, base: str, name: str):
        self.f = store.open_input_file(f"{base}/{name}")
        with store.open_input_stream(f"{base}/dictionary") as d:
            dictionary = d.read()
        n = self.f.size()
        if n < 56 or self.f.read_at(8, 0) != MAGIC or self.f.read_at(8, n - 8) != MAGIC:
            raise ValueError(f"{name} is no whole token file")
        if self.f.read_at(32, 8) != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{name} was written with another dictionary")
        size = struct.unpack("<Q", self.f.read_at(8, n - 16))[0]
        self.index = list(INDEX.iter_unpack(self.f.read_at(size, n - 16 - size)))
        self.press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()

    def document(self, k: int) -> np.ndarray:
        _, _, at, size, _ = self.index[k]
        return unpack(self.press.decompress(self.f.read_at(size, at)))

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) of all documents, with long reads."""
        lo, held = 0, b""
        for doc, null, at, size, _ in self.index:
            if at + size > lo + len(held):
                lo, held = at, self.f.read_at(max(size, READ_BYTES), at)
            yield None if null else doc, unpack(self.press.decompress(held[at - lo : at - lo + size]))


def read_compressed(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read back from the files; start counts the ids of all earlier documents."""
    before = F.sum("n_tokens").over(Window.orderBy("part", "k").rowsBetween(Window.unboundedPreceding, -1))
    placed = files.withColumn("before", F.coalesce(before, F.lit(0)))  # one short row for each file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = common.filesystem(folder)
        for batch in batches:
            for name, start in zip(common.column(batch, "file"), common.column(batch, "before"), strict=True):
                rows: list[tuple] = []
                for doc, ids in TokenFile(store, base, name).documents():
                    rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return common.map_batches(common.spread(placed, "file"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, path: str | None = None, end_id: int = 2) -> DataFrame:
    """Encode, compress with a shared dictionary, write, and read back the digests of each document.

    A null text is an empty one: its ids are the end id alone. Rows without a doc_id come first;
    rows that share one follow one another by text. Other columns are ignored; an empty table gives
    an empty one.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    folder = common.shared_dir(docs.sparkSession)
    dictionary = train_dictionary(docs, path, end_id)
    files = common.stored(write_compressed(docs, f"{folder}/tokens", path, end_id, dictionary), folder, "files")
    return read_compressed(files, f"{folder}/tokens")
