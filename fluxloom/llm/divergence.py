"""Operator 11: how far the sources of each language differ, term by term and pair by pair.

Two groups differ by the sum, over all kept terms, of the absolute differences of their smoothed
shares. The shares are held in a term-major index (a term, and its count in each source). Each group
walks its own terms through that index and adds into one dense row with a place for each peer
(Gustavson's row-by-row product), so that no pair of postings is ever a row. A term that a group
lacks still has a share there, the group's baseline: the sum over all terms starts from the
baselines' difference, and terms held by one or both groups correct it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Production parameters: documents that hold a kept term, smoothing, scale of shares, ranks of the term report.
LEAST_DOCS, SMOOTHING, SCALE, TERM_RANKS = 30, 5, 1_000_000_000, 50
#: Entries that a task counts before it sends them on, and bytes of a text that it splits at a time.
ENTRIES, SLICE_BYTES = 200_000, 1 << 20
#: Postings of a block of the index on average: this many, or as many as the language has pairs of groups, up to a bound.
BLOCK_POSTINGS, MOST_POSTINGS = 1 << 15, 1 << 21
#: Groups whose corrections by all peers are held at a time.
PEER_ROWS = 256
#: Letters in lower case; every other byte below 128 parts terms.
FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in slices cut between two terms."""
    at = 0
    while at < len(text):
        end = at + SLICE_BYTES
        while end < len(text) and FOLD[text[end]] != 32:
            end += 1
        yield text[at:end].translate(FOLD).split()
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of whole texts, counted in each task: several rows of a term may remain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        entries = 0
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary())
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                total, in_docs = held.setdefault((lang, source), (Counter(), Counter()))
                entries -= len(total)
                seen: set[bytes] = set()
                for part in words(text.as_py()):
                    total.update(part)
                    seen.update(part)
                in_docs.update(seen)
                entries += len(total)
                if entries > ENTRIES:
                    yield from frames(held)
                    held, entries = {}, 0
        yield from frames(held)

    def frames(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (total, in_docs) in held.items():
            n = len(total)
            terms = pa.array(total.keys(), pa.binary()).cast(pa.string())
            arrays = [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), terms, pa.array(total.values(), pa.int64()), pa.array([in_docs[t] for t in total], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "term", "n", "docs"])

    none = lambda c: F.coalesce(docs[c].cast("string"), F.lit("")).alias(c)
    return common.map_batches(docs.select(none("lang"), none("source"), none("text")), run, "lang string, source string, term string, n long, docs long")


def share(count, total, terms):
    """1 + floor(SCALE * (count + SMOOTHING) / (total + SMOOTHING * terms)) in exact decimals; null without terms."""
    wide = lambda c: c.cast("decimal(20,0)")
    top = (wide(count) + SMOOTHING) * F.lit(SCALE).cast("decimal(11,0)")
    under = wide(total) + wide(F.lit(SMOOTHING)) * wide(terms)
    return F.when(terms > 0, F.call_function("div", top.cast("decimal(38,0)"), under.cast("decimal(38,0)")) + 1)


def peer_rows(peers: list[tuple[int, int | None]], terms: int, index: pa.RecordBatch | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(group, peers above it, what this block adds to their distances) for each group of a language.

    ``peers``: (group, baseline share), in order. ``terms``: how many terms of the language this block
    starts the sum for. ``index``: the block's postings (term, group, share), any order.
    """
    groups = np.array([g for g, _ in peers], np.int64)
    base = np.array([b or 0 for _, b in peers], np.int64)
    empty = np.empty(0, np.int64)
    term, owner, p = (c.to_numpy(zero_copy_only=False) for c in index.columns) if index is not None else (empty,) * 3
    owner = np.searchsorted(groups, owner)
    term = np.unique(term, return_inverse=True)[1]
    order = np.lexsort((owner, term))  # the term-major index: postings of a term lie together, by group
    term, owner, p = term[order], owner[order], p[order]
    starts = np.searchsorted(term, np.arange(term.max() + 2 if len(term) else 1))
    by_group = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[by_group], np.arange(len(groups) + 1))
    shares = [np.sort(p[by_group[cuts[g] : cuts[g + 1]]]) for g in range(len(groups))]
    sums = [np.concatenate([[0], np.cumsum(s)]) for s in shares]

    def held_by_one(g: int, other: np.ndarray) -> np.ndarray:
        """Sum over the terms of g of |share - baseline of another|, for several others."""
        s, c = shares[g], sums[g]
        below = np.searchsorted(s, other)
        return other * below - c[below] + (c[-1] - c[below]) - other * (len(s) - below)

    for first in range(0, len(groups), PEER_ROWS):
        mine_base = base[first : first + PEER_ROWS]
        # terms that a peer holds, measured from the baselines of some groups
        theirs = np.stack([held_by_one(h, mine_base) - len(shares[h]) * np.abs(mine_base - base[h]) for h in range(len(groups))])
        for g in range(first, min(first + PEER_ROWS, len(groups) - 1)):
            others = np.arange(g + 1, len(groups))
            acc = np.zeros(len(groups), np.int64)
            mine = by_group[cuts[g] : cuts[g + 1]]
            # all postings of this group's terms behind its own: one run of the index for each term
            runs = starts[term[mine] + 1] - mine - 1
            at = np.repeat(mine + 1 - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())
            a, b, who = np.repeat(p[mine], runs), p[at], owner[at]
            # both hold the term: its true difference, in place of what the two baselines' corrections count for it
            np.add.at(acc, who, np.abs(a - b) - np.abs(a - base[who]) - np.abs(base[g] - b) + np.abs(base[g] - base[who]))
            acc[others] += (terms - len(mine)) * np.abs(base[g] - base[others]) + held_by_one(g, base[others]) + theirs[others, g - first]
            yield int(groups[g]), groups[others], acc[others]


def index_of(docs: DataFrame, folder: str, least_docs: int) -> DataFrame:
    """The term-major index: (lang, term, total, postings) of the kept terms, postings being (source, n)."""
    rows = term_counts(docs).repartition("lang", "term")
    each = rows.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = each.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("postings"))
    return common.stored(terms.where(F.col("docs") >= least_docs).drop("docs"), folder, "index")


def block_count(postings, groups):
    """Blocks of a language's index: by its postings, and no more blocks than leave each as many postings as it has pairs of groups."""
    per = F.least(F.greatest(F.lit(BLOCK_POSTINGS), groups * groups / 2), F.lit(MOST_POSTINGS))
    return F.greatest(F.lit(1), F.ceil(F.coalesce(postings, F.lit(0)) / per)).cast("int")


def pair_sums(postings: DataFrame, peers: DataFrame) -> DataFrame:
    """(lang, g, h, value) with g < h: distances of all pairs of groups of a language.

    ``postings``: (lang, term, g, p, blocks). ``peers``: (lang, g, base, terms, blocks). Terms are dealt to a language's blocks by
    their hash, and each block has the peers of its language as its first rows. A block's distances add up over blocks.
    """
    first = peers.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # the first block starts the sums over all terms; the others only correct them
    first = first.select("lang", "block", F.lit(None).cast("long").alias("term"), "g", F.col("base").alias("p"), F.when(F.col("block") == 0, F.col("terms")).otherwise(0).alias("terms"))
    rest = postings.select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), F.xxhash64("term", F.lit(1)).alias("term"), "g", "p", F.lit(0).cast("long").alias("terms"))
    dealt = first.union(rest).repartition("lang", "block").sortWithinPartitions("lang", "block", F.col("term").isNotNull(), "g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            at = 0
            for k in range(1, len(keys) + 1):
                if k < len(keys) and keys[k] == keys[at]:
                    continue
                if keys[at] != key:
                    yield from closed(key, held)
                    key, held = keys[at], []
                held.append(batch.slice(at, k - at).select([2, 3, 4, 5]))
                at = k
        yield from closed(key, held)

    def closed(key, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        block = pa.Table.from_batches(held).combine_chunks()
        top = block.filter(pc.is_null(block.column("term")))
        peers = list(zip(top.column("g").to_pylist(), top.column("p").to_pylist(), strict=True))
        below = block.filter(pc.is_valid(block.column("term"))).select(["term", "g", "p"]).to_batches()
        below = pa.Table.from_batches(below).combine_chunks().to_batches()[0] if below else None
        for g, others, value in peer_rows(peers, top.column("terms")[0].as_py(), below):
            n = len(others)
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * n, pa.string()), pa.array([g] * n, pa.int64()), pa.array(others), pa.array(value)], names=["lang", "g", "h", "value"])

    parts = dealt.mapInArrow(run, "lang string, g long, h long, value long")
    return parts.groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = TERM_RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank): each source against the others of its language, and its own most frequent terms.

    Null lang, source and text count as ''. A repeated row counts as often as it stands. A language
    without kept terms has pairs at distance 0; a group without terms has its baseline for each;
    texts may be of any length; other columns are ignored; an empty table gives an empty one.

    Counts are gathered in the tasks that read, so a source with a third of the rows sends no more
    than its distinct terms from each. A term's postings are one row, as long as a language has sources.
    """
    folder = common.shared_dir(docs.sparkSession)
    index = index_of(docs, folder, least_docs)
    flat = index.select("lang", "term", "total", F.inline("postings"))
    sums = flat.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    vocabulary = index.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_size"), F.sum(F.size("postings")).alias("held"))
    none = lambda c: F.coalesce(docs[c].cast("string"), F.lit("")).alias(c)
    named = docs.select(none("lang"), none("source")).distinct()
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long").alias("g")
    groups = named.join(sums, ["lang", "source"], "left").join(vocabulary, "lang", "left")
    groups = groups.select("lang", "source", number, F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("kept", F.lit(0)).alias("terms"), F.coalesce("lang_size", F.lit(0)).alias("lang_size"), block_count(F.col("held"), F.count("*").over(Window.partitionBy("lang"))).alias("blocks"))
    groups = common.stored(groups.withColumn("base", share(F.lit(0), F.col("size"), F.col("terms"))), folder, "groups")

    held = flat.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("size"), F.col("terms")))
    sums = pair_sums(held.select("lang", "term", "g", "p", "blocks"), groups.select("lang", "g", "base", "terms", "blocks"))
    pairs = common.stored(sums, folder, "pairs")
    both = pairs.union(pairs.select("lang", "h", "g", "value"))
    names = groups.select("lang", "g", "source")
    pair = both.join(names, ["lang", "g"]).join(names.select("lang", F.col("g").alias("h"), F.col("source").alias("item")), ["lang", "h"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = pair.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))

    more = held.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - share(F.col("total"), F.col("lang_size"), F.col("terms"))).alias("value"))
    term = more.where("value > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)
    return pair.union(term)
