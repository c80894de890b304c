"""Operator 9: byte-level BPE by a segment tree over the ranks of adjacent pairs.

The symbols of a word are leaves in text order, and a leaf holds the rank of the pair that it
starts. Each inner node holds the lower rank of its children, so the root yields the lowest rank
and a walk that goes left on ties yields the leftmost such pair. A merge changes two leaves, each
a logarithmic update, until the root holds no rank.

Trees of many words are the rows of one array, so one NumPy step descends or updates them all.
Words come from the pre-tokenizer, and ids of a word are kept in a bounded dictionary.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from . import common

#: The pre-tokenizer of the public vocabulary file (fixed value).
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
SPACE_BEFORE_SPACE = regex.compile(r" (?!\S)")
SPACE_BEFORE_WORD = regex.compile(r" (?=\S)")
#: Characters that are one pre-token where they follow letters and end a piece.
MARKS = frozenset(".,;:!?)]}\"")
NO_RANK = np.int32(2**31 - 1)
#: Entries of each generation of a worker's dictionaries of pieces and of words.
KEPT_PIECES, KEPT_WORDS = 120_000, 60_000
#: Characters of the longest piece that is kept.
KEPT_LENGTH = 64


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabulary files."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + rest.index(b)) for b in range(256)]


class Vocabulary:
    """Ids, merges and special tokens of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        back = {c: b for b, c in enumerate(alphabet)}
        ids: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*ids.values(), *self.special.values()])
        self.of_byte = np.array([ids[c] for c in alphabet], np.int32)
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in ids.items():
            self.bytes_of[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NO_RANK where the pair never merges (an id of -1: no symbol)."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], NO_RANK)


def merge_words(words: list[bytes], vocabulary: Vocabulary, leaves: int) -> list[bytes]:
    """Packed ids of words of at most ``leaves`` bytes (a power of two), by a segment tree for each."""
    count, depth = len(words), leaves.bit_length() - 1
    lengths = np.fromiter(map(len, words), np.int64, count)
    flat = vocabulary.of_byte[np.frombuffer(b"".join(words), np.uint8)]
    symbol = np.full((count, leaves + 1), -1, np.int32)
    symbol[:, :leaves][np.arange(leaves) < lengths[:, None]] = flat
    after = np.tile(np.arange(1, leaves + 2, dtype=np.int32), (count, 1))  # of each symbol, the leaf of the next one
    after = np.where(after >= lengths[:, None], leaves, after).astype(np.int32)
    before = np.tile(np.arange(-1, leaves, dtype=np.int32), (count, 1))
    tree = np.full((count, 2 * leaves), NO_RANK, np.int32)
    tree[:, leaves:] = vocabulary.rank(symbol[:, :-1], symbol[:, 1:])
    for level in range(depth - 1, -1, -1):
        a = 1 << level
        tree[:, a : 2 * a] = np.minimum(tree[:, 2 * a : 4 * a : 2], tree[:, 2 * a + 1 : 4 * a : 2])
    open_rows = np.flatnonzero(tree[:, 1] != NO_RANK)
    while len(open_rows):
        r = open_rows
        best = tree[r, 1]
        node = np.ones(len(r), np.int64)
        for _ in range(depth):
            node = 2 * node + (tree[r, 2 * node] != best)  # left on ties
        left = node - leaves
        right = after[r, left].astype(np.int64)
        beyond = after[r, right].astype(np.int64)
        symbol[r, left] = vocabulary.merged[best]
        symbol[r, right] = -1
        after[r, left] = beyond
        inner = beyond < leaves
        before[r[inner], beyond[inner]] = left[inner]
        put(tree, r, right, np.full(len(r), NO_RANK, np.int32), leaves, depth)
        put(tree, r, left, vocabulary.rank(symbol[r, left], symbol[r, beyond]), leaves, depth)
        first = before[r, left].astype(np.int64)
        has = first >= 0
        put(tree, r[has], first[has], vocabulary.rank(symbol[r[has], first[has]], symbol[r[has], left[has]]), leaves, depth)
        open_rows = r[tree[r, 1] != NO_RANK]
    kept = symbol >= 0
    flat_ids = symbol[kept].astype("<u4").tobytes()
    ends = (4 * np.cumsum(kept.sum(axis=1))).tolist()
    return [flat_ids[a:b] for a, b in zip([0, *ends], ends)]


def put(tree: np.ndarray, rows: np.ndarray, leaf: np.ndarray, value: np.ndarray, leaves: int, depth: int) -> None:
    """Point update: set a leaf of each row and renew the minima above it."""
    node = leaf + leaves
    tree[rows, node] = value
    for _ in range(depth):
        node = node >> 1
        tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])


def merge_long(word: bytes, vocabulary: Vocabulary) -> np.ndarray:
    """The same tree for one long word, with plain lists: O(n log n) whatever its length."""
    n = len(word)
    leaves = 1 << (n - 1).bit_length()
    none = int(NO_RANK)
    symbol = vocabulary.of_byte[np.frombuffer(word, np.uint8)]
    tree = [none] * (2 * leaves)
    tree[leaves : leaves + n - 1] = vocabulary.rank(symbol[:-1], symbol[1:]).tolist()
    for k in range(leaves - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])
    symbol = symbol.tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    ranks = vocabulary_ranks(vocabulary)

    def update(leaf: int, value: int) -> None:
        k = leaf + leaves
        tree[k] = value
        while k > 1:
            k >>= 1
            low = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == low:
                return
            tree[k] = low

    while (best := tree[1]) != none:
        k = 1
        while k < leaves:
            k = 2 * k + (tree[2 * k] != best)
        left = k - leaves
        right = after[left]
        beyond = after[right]
        symbol[left], symbol[right] = int(vocabulary.merged[best]), -1
        after[left] = beyond
        update(right, none)
        if beyond < n:
            before[beyond] = left
            update(left, ranks.get(symbol[left] << 32 | symbol[beyond], none))
        else:
            update(left, none)
        if (first := before[left]) >= 0:
            update(first, ranks.get(symbol[first] << 32 | symbol[left], none))
    return np.array([s for s in symbol if s >= 0], np.int32)


def vocabulary_ranks(vocabulary: Vocabulary) -> dict[int, int]:
    if not hasattr(vocabulary, "rank_dict"):
        vocabulary.rank_dict = dict(zip(vocabulary.keys.tolist(), vocabulary.ranks.tolist(), strict=True))
    return vocabulary.rank_dict


def merge_all(words: list[str], vocabulary: Vocabulary) -> list[bytes]:
    """Little-endian 32-bit ids of each word."""
    out: list[bytes] = [b""] * len(words)
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    classes: dict[int, list[int]] = {}
    for k, w in enumerate(raw):
        if len(w) == 1:
            out[k] = vocabulary.of_byte[w[0]].astype("<u4").tobytes()
        elif w:
            classes.setdefault(max(4, 1 << (len(w) - 1).bit_length()), []).append(k)
    for leaves, members in classes.items():
        if leaves > 64:
            for k in members:
                out[k] = merge_long(raw[k], vocabulary).astype("<u4").tobytes()
        else:
            for lo in range(0, len(members), 4096):
                part = members[lo : lo + 4096]
                for k, ids in zip(part, merge_words([raw[k] for k in part], vocabulary, leaves), strict=True):
                    out[k] = ids
    return out


class Kept:
    """A bounded dictionary in two generations: what the older one holds moves over when it is used."""

    def __init__(self, limit: int):
        self.limit, self.new, self.old = limit, {}, {}

    def missing(self, keys: set[str]) -> list[str]:
        """Those of ``keys`` that it doesn't hold; the others are in ``new`` afterwards."""
        if len(self.new) > self.limit:
            self.new, self.old = {}, self.new
        new, old = self.new, self.old
        absent = [k for k in keys if k not in new]
        if old:  # one look at a time: a set operation with a dictionary would walk the whole dictionary
            moved = [k for k in absent if k in old]
            if moved:
                new.update(zip(moved, map(old.__getitem__, moved)))
                absent = [k for k in absent if k not in new]
        return absent


def pieces_of(text: str) -> list[str]:
    """Pieces between spaces that stand before a character other than white space: such a space always starts a pre-token.

    So the pieces can be encoded one by one and their ids joined. A piece stands for a space and what
    follows it, but one that starts with a NUL for what follows the NUL.
    """
    if "\0" in text:
        return ["\0" + text]  # cut by the pre-tokenizer alone
    # of printable characters only the space is white space, so most texts need no pattern
    plain = text[-1] != " " and "  " not in text and " \n" not in text and text.replace("\n", "-").isprintable()
    if plain:
        if "\n" in text and "\n\n" not in text and "\n " not in text and text[0] != "\n" != text[-1]:
            text = text.replace("\n", " \0\n \0")  # a line feed between words is a pre-token, and so is the word after it
        pieces = text.split(" ")
    else:
        pieces = SPACE_BEFORE_WORD.split(text) if SPACE_BEFORE_SPACE.search(text) else text.split(" ")
    pieces[0] = "\0" + pieces[0]
    return pieces


class PieceEncoder:
    """Encodes texts by the pieces of ``pieces_of``; ``encode_words`` gets the pre-tokens that no dictionary holds, many at a time."""

    def __init__(self, encode_words: Callable[[list[str]], list[bytes]], special: dict[str, int]):
        self.encode_words = encode_words
        self.special = {k: np.array([v], "<u4").tobytes() for k, v in special.items()}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.pieces, self.words = Kept(KEPT_PIECES), Kept(KEPT_WORDS)

    def _learn(self, missing: list[str]) -> dict[str, bytes]:
        split: list[str | list[str]] = []
        for p in missing:
            t = p[1:] if p[:1] == "\0" else " " + p
            if p.isalpha():
                split.append(t)  # a space and letters are one pre-token
            elif p[-1:] in MARKS and p[:-1].isalpha():
                split.append([t[:-1], p[-1]])  # a mark after letters is another
            else:
                split.append(PRETOKEN.findall(t))
        wanted = {w for w in split if type(w) is str}
        wanted.update(chain.from_iterable(w for w in split if type(w) is list))
        need = self.words.missing(wanted)
        known = self.words.new
        known.update(zip(need, self.encode_words(need), strict=True))
        out = {p: known[w] if type(w) is str else b"".join([known[x] for x in w]) for p, w in zip(missing, split, strict=True)}
        for w in need:
            if len(w) > KEPT_LENGTH:
                del known[w]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        plan: list[list] = []
        wanted: set[str] = set()
        for text in texts:
            parts: list = []
            for part in self.at_special.split(text) if self.at_special and any(s in text for s in self.special) else [text]:
                if part in self.special:
                    parts.append(self.special[part])
                elif part:
                    parts.append(pieces := pieces_of(part))
                    wanted.update(pieces)
            plan.append(parts)
        missing = self.pieces.missing(wanted)
        look = self.pieces.new
        look.update(self._learn(missing))
        out = [b"".join([part if isinstance(part, bytes) else b"".join(map(look.__getitem__, part)) for part in parts]) for parts in plan]
        for p in missing:
            if len(p) > KEPT_LENGTH:
                del look[p]
        return out


def decode(ids: np.ndarray, vocabulary: Vocabulary) -> str:
    """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
    table = vocabulary.bytes_of
    return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def own_encoder(path: str) -> tuple[Vocabulary, PieceEncoder]:
    """A worker's encoder; its dictionaries serve all tasks that the worker runs."""
    vocabulary = Vocabulary(path)
    return vocabulary, PieceEncoder(lambda words: merge_all(words, vocabulary), vocabulary.special)


def encode_decode(docs: DataFrame, path: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """Encode each whole text, decode its ids, and return digests of both.

    Columns: ``keep``, then n_tokens, ids_sha256, decoded_sha256. A null text is an empty one
    (no ids). Repeated rows stay repeated, an empty table gives an empty one, and other columns
    are ignored. Rows are handled one by one: there is no shuffle and nothing to rebuild.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(f"`{k}` {fields[k]}" for k in keep) + f", {prefix}n_tokens long, {prefix}ids_sha256 string, {prefix}decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, encoder = own_encoder(path)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            texts = [t or "" for t in common.column(batch, "__text")]
            for raw in encoder.encode(texts):
                ids = np.frombuffer(raw, "<u4")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(raw).hexdigest())
                text_sha.append(hashlib.sha256(decode(ids, vocabulary).encode()).hexdigest())
            kept = [batch.column(batch.schema.get_field_index(k)) for k in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=[*keep, f"{prefix}n_tokens", f"{prefix}ids_sha256", f"{prefix}decoded_sha256"])

    return common.map_batches(docs.select(*[docs[k] for k in keep], docs[text].alias("__text")), run, schema)
