"""Operator 8: benchmark decontamination by rare n-gram seeds and Smith-Waterman alignment.

The n-grams of a test item that up to a share ``RARE`` of the documents hold are its seeds, counted
over all documents. Each stretch of an item also gives its rarest ones, whatever their share: those
in up to ``NEAR`` times as many documents as the one that the fewest hold, of those that any does.
So which n-grams are seeds depends on shares alone, not on the size of the corpus. A document's passages that hold a seed are joined to the item, and a
local alignment of the passage's words with the item's words scores exact, edited and reordered
copies alike. A document is contaminated if an alignment scores at least ``least`` of the score of
the whole item.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORD = re.compile(r"\w+")
N = 3
#: Positions of an item that share one seed at least.
STRETCH = 3
#: Share of the documents that may hold an n-gram that is a seed wherever it stands.
RARE = 0.1
#: How many times the documents of a stretch's rarest n-gram may hold another seed of that stretch.
NEAR = 4
MATCH, MISMATCH, GAP = 2, -1, -1
#: Part of an item's own score that a copy must reach.
LEAST = 0.5
#: Items are sent to every task only while their texts are below this many bytes; more go through in blocks of this size.
ITEMS_BYTES = 8 << 20


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def align(item: np.ndarray, passages: np.ndarray) -> np.ndarray:
    """Best Smith-Waterman score of an item's words against each row of ``passages`` (-1: no word).

    All passages advance together, a row of the matrix at a time. With a linear gap cost the gaps
    along a row are a running maximum, so no cell is visited on its own.
    """
    count, width = passages.shape
    slope = GAP * np.arange(width + 1, dtype=np.int32)
    row, best = np.zeros((count, width + 1), np.int32), np.zeros(count, np.int32)
    for word in item:
        step = np.where(passages == word, MATCH, MISMATCH).astype(np.int32)
        new = np.maximum(row + GAP, 0)
        new[:, 1:] = np.maximum(new[:, 1:], row[:, :-1] + step)
        row = np.maximum.accumulate(new - slope, axis=1) + slope
        best = np.maximum(best, row.max(axis=1))
    return best


class Items:
    """Test items as numbered words, with the n-grams of each."""

    def __init__(self, items: list[tuple[int, str]], n: int):
        self.ids = [i for i, _ in items]
        split = [words_of(t) for _, t in items]
        self.number = {w: k for k, w in enumerate(sorted({w for ws in split for w in ws}))}
        self.words = [np.array([self.number[w] for w in ws], np.int32) for ws in split]
        self.n = n
        grams: dict[tuple[int, ...], int] = {}
        self.grams: list[list[int]] = []
        for ws in self.words:
            size = min(n, len(ws))
            self.grams.append([grams.setdefault(tuple(ws[k : k + size].tolist()), len(grams)) for k in range(len(ws) - size + 1)] if size else [])
        self.gram_ids = grams
        size = max(2, len(self.number) + 1)
        self.base = size
        full = np.array([[*g] for g in grams if len(g) == n], np.int64).reshape(-1, n)
        keys = full @ np.array([size**k for k in range(n - 1, -1, -1)], np.int64) if len(full) else np.empty(0, np.int64)
        order = np.argsort(keys)
        self.keys, self.key_gram = keys[order], np.array([i for g, i in grams.items() if len(g) == n], np.int64)[order] if len(full) else np.empty(0, np.int64)
        self.short = {g: i for g, i in grams.items() if len(g) < n}

    def find(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A document's words as numbers (-1: in no item), and positions and ids of the items' n-grams in it."""
        get = self.number.get
        found = words_of(text)
        w = np.fromiter((get(x, -1) for x in found), np.int32, len(found))
        at, gram = np.empty(0, np.int64), np.empty(0, np.int64)
        if len(w) >= self.n and len(self.keys):
            known = w >= 0
            run = known.copy()
            for k in range(1, self.n):
                run[:-k] &= known[k:]
                run[-k:] = False
            at = np.flatnonzero(run)
            if len(at):
                key = np.zeros(len(at), np.int64)
                for k in range(self.n):
                    key = key * self.base + w[at + k]
                place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[place] == key
                at, gram = at[hit], self.key_gram[place[hit]]
        for g, i in self.short.items():
            ok = np.ones(max(0, len(w) - len(g) + 1), bool)
            for k, x in enumerate(g):
                ok &= w[k : k + len(ok)] == x
            more = np.flatnonzero(ok)
            at, gram = np.concatenate([at, more]), np.concatenate([gram, np.full(len(more), i, np.int64)])
        return w, at, gram

    def seeds(self, frequency: dict[int, int], most: float = np.inf) -> dict[int, list[tuple[int, int]]]:
        """gram -> (item, position): all n-grams in up to ``most`` documents and the rarest of each stretch of each item; none that no document holds."""
        out: dict[int, list[tuple[int, int]]] = {}
        for k, grams in enumerate(self.grams):
            held = [frequency.get(g, 0) for g in grams]
            chosen = {p for p, n in enumerate(held) if 0 < n <= most}
            for lo in range(0, max(1, len(grams) - STRETCH + 1)):
                part = [p for p in range(lo, min(lo + STRETCH, len(grams))) if held[p]]
                least = min((held[p] for p in part), default=0)
                chosen.update(p for p in part if held[p] <= NEAR * least)
            for p in chosen:
                out.setdefault(grams[p], []).append((k, p))
        return out


def blocks_of(items: DataFrame, limit: int) -> Iterator[list[tuple[int, str]]]:
    """Test items in blocks of at most ``limit`` bytes of text (one item, if it is longer)."""
    block, size = [], 0
    for r in items.select("item_id", "text").where("item_id is not null and text is not null").dropDuplicates().orderBy("item_id", "text").toLocalIterator():
        n = len(r["text"].encode())
        if block and size + n > limit:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += n
    if block:
        yield block


def matches(docs: DataFrame, items: DataFrame, least: float = LEAST, n: int = N, limit: int = ITEMS_BYTES) -> DataFrame:
    """(doc_id, item_id, score): the best alignment of each document and item that reaches ``least``.

    score is the alignment's share of the item's own score. Repeated rows are one document to the
    counts and one row here. Null or empty texts and items match nothing. Items of fewer than ``n``
    words are one seed. Other columns are ignored; an empty table gives an empty result. All of a
    document's text is searched and every seed hit is in an aligned passage.
    """
    out = None
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    for block in blocks_of(items, limit):
        find = searcher(texts.select("text"), Items(block, n), least)

        def search(batches: Iterator[pa.RecordBatch], find=find) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = common.column(batch, "doc_id")
                found = [(ids[row], item, score) for row, item, score in find(common.column(batch, "text"))]
                yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["doc_id", "item_id", "score"])

        one = common.map_batches(texts, search, "doc_id long, item_id long, score double")
        out = one if out is None else out.union(one)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double")
    return out.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))


def seeded(texts: DataFrame, items: Items, rare: float = RARE) -> dict[int, list[tuple[int, int]]]:
    """The seeds of ``items``, by the share of ``texts`` (rows with a word) that hold each n-gram. Nulls and empty texts count for nothing."""
    every = len(items.gram_ids)  # the place of the number of documents

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(every + 1, np.int64)
        for batch in batches:
            for text in common.column(batch, "text"):
                words, _, grams = items.find(text)
                totals[np.unique(grams)] += 1
                totals[every] += len(words) > 0
        held = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(totals[held])], names=["gram", "docs"])

    counted = common.map_batches(texts, count, "gram long, docs long").groupBy("gram").agg(F.sum("docs").alias("docs"))
    frequency = {r["gram"]: r["docs"] for r in counted.collect()}  # one row for each n-gram of this block's items at most
    return items.seeds(frequency, rare * frequency.pop(every, 0))


def passages(items: Items, seeds: dict[int, list[tuple[int, int]]], is_seed: np.ndarray, text: str | None) -> dict[int, list[np.ndarray]]:
    """item -> passages of a document that hold its seeds: all of the item and a third more would fit around each."""
    w, at, gram = items.find(text)
    spans: dict[int, list[tuple[int, int]]] = {}
    for p, g in sorted(zip(at[is_seed[gram]].tolist(), gram[is_seed[gram]].tolist())):
        for k, q in seeds[g]:
            size = len(items.words[k])
            a, b = max(0, p - q - size // 3), min(len(w), p - q + size + size // 3 + 1)
            mine = spans.setdefault(k, [])
            if not mine or mine[-1] != (a, b):
                mine.append((a, b))
    out: dict[int, list[np.ndarray]] = {}
    for k, mine in spans.items():
        merged: list[list[int]] = []
        for a, b in sorted(mine):
            # spans that mostly overlap are one; a run of them is cut so that its length stays within a few items
            if merged and a <= merged[-1][0] + len(items.words[k]) and b <= merged[-1][0] + 4 * len(items.words[k]):
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        out[k] = [w[a:b] for a, b in merged]
    return out


def searcher(texts: DataFrame, items: Items, least: float) -> Callable[[list], list[tuple[int, int, float]]]:
    """A function from a list of texts to (place in the list, item_id, score) of alignments that reach ``least``."""
    seeds = seeded(texts, items)
    is_seed = np.zeros(len(items.gram_ids) + 1, bool)
    is_seed[list(seeds)] = True

    def find(some: list) -> list[tuple[int, int, float]]:
        waiting: dict[int, dict[bytes, tuple[np.ndarray, set]]] = {}
        for row, text in enumerate(some):
            for k, parts in passages(items, seeds, is_seed, text).items():
                for part in parts:
                    waiting.setdefault(k, {}).setdefault(part.tobytes(), (part, set()))[1].add(row)
        found = []
        for k, rows in waiting.items():
            parts, held_by = zip(*rows.values())
            own = MATCH * len(items.words[k])
            order = sorted(range(len(parts)), key=lambda j: len(parts[j]))
            for lo in range(0, len(order), 256):
                chosen = order[lo : lo + 256]
                grid = np.full((len(chosen), max(len(parts[j]) for j in chosen)), -1, np.int32)
                for r, j in enumerate(chosen):
                    grid[r, : len(parts[j])] = parts[j]
                for j, s in zip(chosen, align(items.words[k], grid).tolist(), strict=True):
                    if s >= least * own:
                        found.extend((row, items.ids[k], s / own) for row in held_by[j])
        return found

    return find


def contamination(docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, item_ids, best_score): each document that holds a copy of a test item, once. Edge cases are those of ``matches``."""
    return matches(docs, items, least).groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("score").alias("best_score"))


def drop_contaminated(docs: DataFrame, items: DataFrame, least: float = LEAST, n: int = N, limit: int = ITEMS_BYTES) -> DataFrame:
    """The rows of ``docs``, with their columns, without a copy of a test item.

    Each row is judged by its own text, in the task that reads it, whatever rows share its doc_id or
    have none: nothing is shuffled. Rows with a null or empty text stay, repeated rows stay or go
    together, other columns are returned as they are, an empty table gives an empty one.
    """
    out, texts = docs, docs.select(docs["text"].alias("text"))
    place = docs.columns.index("text")
    for block in blocks_of(items, limit):
        find = searcher(texts, Items(block, n), least)

        def clean(batches: Iterator[pa.RecordBatch], find=find) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[row for row, _, _ in find(batch.column(place).to_pylist())]] = False
                yield batch.filter(pa.array(keep))

        out = common.map_batches(out, clean, docs.schema)
    return out
