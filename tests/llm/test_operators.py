"""The operators against brute force, exact round trips and held-out accuracy, with edge tables."""

import contextlib
import gzip
import hashlib
import io
import random
import re
import time
import tracemalloc
import wave
import zlib
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fluxloom.llm import bpe, chat, chroma, common, components, decontaminate, html, simhash, similar, tokenfiles, toxicity, warc

LONG = "word " * 30_000 + "x" * 5_000
TEXTS = ["", None, "a", "the the the", LONG, "é<|endoftext|>  two\n\n lines ", "a\0b \0c", "同じ 文字 🙂", "the the the"]
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "src") for k, t in enumerate(TEXTS)] + [(None, "no id", "src")]
    return spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, severity string")


# ---- 1 ----


@pytest.mark.parametrize("budget", [10, 60, 2048])
def test_chat_round_trip(spark, budget):
    rnd = random.Random(5)
    odd = ["\\", "<turn>", "</turn>\n", "\\b", "\\l", "user\n", "x" * 90, "é🙂", "", " "]
    rows = [(c, k, rnd.choice(["user", "assistant", "system", "a\nb", None]), None if rnd.random() < 0.1 else "".join(rnd.choices(odd, k=rnd.randint(0, 4)))) for c in range(12) for k in range(rnd.randint(1, 14))]
    rows += [(3, 0, "system", "be brief"), (3, 0, "user", "tie"), (3, 0, "user", "tie"), (None, 0, "user", "null id")]
    turns = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, window string").repartition(4)
    made = chat.windows(turns, budget, budget // 4)
    got = {r["conv_id"]: r for r in chat.read_back(made).collect()}
    by = {}
    for c, k, role, text in rows:
        by.setdefault(c, []).append((k, role or "", text or ""))
    assert set(got) == set(by)
    for c, mine in by.items():
        mine.sort()
        loss = "".join(t for _, r, t in mine if r == "assistant")
        assert got[c]["n_turns"] == len(mine)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in mine).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for w in made.collect():
        assert w["over_budget"] == (w["n_tokens"] > budget)
        assert not w["over_budget"] or w["n_targets"] <= 2  # a single long turn, with a system turn before it
    assert chat.read_back(chat.windows(turns.limit(0))).count() == 0


def test_chat_repeats_history_unmasked(spark):
    turns = spark.createDataFrame([(1, 0, "system", "s" * 8)] + [(1, k, "assistant" if k % 2 == 0 else "user", f"{k}" * 40) for k in range(1, 9)], "conv_id long, turn long, role string, text string")
    made = chat.windows(turns, budget=80, history_tokens=30, history_turns=2).orderBy("window").collect()
    assert len(made) > 2
    for w in made[1:]:
        assert w["text"].startswith("<turn>system\nssssssss</turn>\n") and w["n_repeated"] >= 2
        masked = "".join(w["text"][s["start"] - 1 : s["start"] - 1 + s["length"]] for s in w["loss"])
        repeated = "".join(w["text"].split("</turn>\n")[: w["n_repeated"]])
        assert masked == "" or masked not in repeated


# ---- 2 ----


def cut(media, n):
    x, rate = chroma.samples(media)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((1, 2, rate, 0, "NONE", ""))
        w.writeframes((32767 * x[n:]).astype("<i2").tobytes())
    return out.getvalue()


def test_chroma_aligns_shifted_recordings(spark):
    rng = np.random.default_rng(0)
    song = rng.normal(size=80).tolist()
    rows = [(0, chroma.tune(song)), (1, chroma.tune(song[10:])), (2, chroma.tune(song)), (50, chroma.tune(rng.normal(size=80).tolist())), (7, None), (8, b"noise"), (9, chroma.tune([])), (4, cut(chroma.tune(song), 3237))]
    media = spark.createDataFrame([(*r, "x") for r in rows], "id long, media binary, codes string")
    got = {r["id"]: r for r in chroma.search(media, lambda i: i % 50 == 0).collect()}
    assert len(got) == len(rows) and got[2]["class_id"] == 0 and got[0]["matches"] == []
    m = got[1]["matches"]
    assert [x["query"] for x in m] == [0] and abs(m[0]["offset"] - 25) <= 1 and m[0]["bit_error_rate"] < 0.2
    assert [x["query"] for x in got[4]["matches"]] == [0] and abs(got[4]["matches"][0]["offset"] - 25) <= 1
    assert got[50]["matches"] == [] and got[7]["n_codes"] == 0 and got[7]["class_id"] == got[8]["class_id"] == 7
    a, b = (chroma.codes(chroma.chroma(*chroma.samples(x))) for x in (rows[0][1], rows[1][1]))
    rates = {o: d / (32 * n) for o in range(-40, 41) for d, n in [chroma.bit_errors(a, b, o)] if n >= 20}
    assert abs(min(rates, key=rates.get) - m[0]["offset"]) <= 1
    assert chroma.search(media.limit(0), lambda i: i % 50 == 0).count() == 0


def plain_codes(energy):
    """Codes by sums over each rectangle, cell by cell."""
    out = []
    for t in range(len(energy) - chroma.SPAN + 1):
        code = 0
        for kind, p, h, w in chroma.filters():
            part = whole = 0.0
            for i in range(w):
                for j in range(h):
                    left, low = i < w // 2, j < h // 2
                    inside = (left, low, left == low, w // 4 <= i < w - w // 4)[kind]
                    whole += energy[t + i, p + j]
                    part += energy[t + i, p + j] if inside else 0.0
            v = np.log1p(part) - np.log1p(whole - part)
            level = int(v > -0.25) + int(v > 0) + int(v > 0.25)
            code = code << 2 | (level ^ level >> 1)
        out.append(code)
    return out


def test_integral_image_sums():
    energy = np.random.default_rng(1).random((40, 12))
    assert chroma.codes(energy).tolist() == plain_codes(energy) and len(chroma.codes(energy[:5])) == 0


def test_pitch_classes_of_tones():
    rate = 4000
    for step in range(0, 24, 5):
        x = np.sin(2 * np.pi * 220 * 2 ** (step / 12) * np.arange(rate) / rate)
        assert (chroma.chroma(x, rate).argmax(axis=1) == step % 12).all()  # A is class 0, and so is the tone at 220


def test_chroma_codes_recordings_of_equal_length_together():
    rng = np.random.default_rng(6)
    energies = rng.uniform(0, 1, (9, chroma.SPAN + 40, 12))
    energies[3] = 0.5  # where halves are equal, the last bits of the sums decide
    assert chroma.codes_of(energies).tolist() == [chroma.codes(e).tolist() for e in energies]
    assert chroma.codes_of(energies[:, :5]).shape == (9, 0)


def plain_matches(prints, queries, votes, most):
    """Pair by pair: votes by offset, the least of the best, differing bits there."""
    out = []
    for i, b in prints:
        for q, a in queries:
            spots = [{}, {}]
            for at, c in enumerate((a, b)):
                for pos in range(len(c)):
                    if not pos or c[pos] != c[pos - 1]:
                        spots[at].setdefault(c[pos], []).append(pos)
            found = {}
            for code, mine in spots[1].items():
                for x in spots[0].get(code, []):
                    for y in mine:
                        found[x - y] = found.get(x - y, 0) + 1
            best = max(found.values(), default=0)
            if i == q or best < votes or not best:
                continue
            offset = min(o for o, n in found.items() if n == best)
            pairs = [(a[k], b[k - offset]) for k in range(len(a)) if 0 <= k - offset < len(b)]
            rate = sum((x ^ y).bit_count() for x, y in pairs) / (32 * len(pairs))
            if rate <= most:
                out.append((i, q, offset, best, rate, len(pairs)))
    return sorted(out)


def hummed(n, seed):
    """Short recordings of few different integers, some of them silent for long, two of them empty."""
    rnd = random.Random(seed)
    return [(k, rnd.choices([0, 0, 0, 7, 2**32 - 1, 2**31, rnd.getrandbits(32)], k=rnd.randint(1, 24)) if k % 17 else []) for k in range(n)]


def held(rows):
    return chroma.Prints(np.array([i for i, _ in rows]), np.array([len(c) for _, c in rows]), np.array([x for _, c in rows for x in c], np.uint32))


@pytest.mark.parametrize("votes, most", [(1, 1.0), (1, 0.2), (3, 0.45)])
@pytest.mark.parametrize("at_once", [1 << 18, 40, 1])
def test_chroma_block_by_brute_force(monkeypatch, votes, most, at_once):
    monkeypatch.setattr(chroma, "VOTES_AT_ONCE", at_once)
    monkeypatch.setattr(chroma, "CODES_AT_ONCE", at_once)
    prints = hummed(34, 1)
    queries = [r for r in prints if r[0] % 3 == 0]
    i, q, offset, n, bits, size = chroma.Block(held(queries)).matches(held(prints), votes, most)
    want = plain_matches(prints, queries, votes, most)
    assert want and sorted(zip(*(c.tolist() for c in (i, q, offset, n, bits / (32 * size), size)))) == want


def test_chroma_pairs_by_chance_are_not_shuffled(spark, monkeypatch):
    """A code that all recordings share: pairs by chance grow with the square, but are no rows of Spark."""
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 1 << 32, (2500, 30), dtype=np.uint32)
    codes[:, 11] = 77
    codes[2001:2050] = codes[1]
    codes[2001:2050, 12:] ^= np.uint32(1 << 9)
    prints = spark.createDataFrame([(k, c.astype("<u4").tobytes()) for k, c in enumerate(codes)], "id long, codes binary").repartition(3)
    monkeypatch.setattr(chroma, "BLOCK_CODES", 30 * 100, raising=False)  # several blocks
    found = chroma.align(prints, prints.where("id < 500"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") > 1 and "Join" not in plan and plan.count("Exchange") <= plan.count("RoundRobinPartitioning")
    assert sorted((r["id"], r["query"], r["offset"], r["votes"], r["overlap"]) for r in found.collect()) == [(k, 1, 0, 12, 30) for k in range(2001, 2050)]
    assert chroma.align(prints, prints.limit(0)).count() == 0


def test_chroma_recall_against_brute_force(spark):
    """All pairs of a query and a recording, at all offsets, against the search."""
    rng = np.random.default_rng(11)
    songs = [rng.normal(size=64) for _ in range(6)]
    vectors = {}
    for k in range(120):
        v = songs[k % 6].copy() if k % 2 else rng.normal(size=64)
        noise = (0.0, 0.02, 0.05, 0.1)[k // 2 % 4]
        v = (v + rng.normal(0, noise, 64))[k % 7 if k % 3 == 0 else 0 :]
        vectors[k] = v.tolist()
    media = spark.createDataFrame([(k, chroma.tune(v)) for k, v in vectors.items()], "id long, media binary")
    codes = {k: chroma.codes(chroma.chroma(*chroma.samples(chroma.tune(v)))) for k, v in vectors.items()}
    rows = chroma.search(media, lambda i: i % 10 == 1).collect()
    cls = {r["id"]: r["class_id"] for r in rows}
    found = {(m["query"], r["class_id"]) for r in rows for m in r["matches"]}
    want = set()
    for q in {cls[k] for k in vectors if k % 10 == 1}:
        for k in set(cls.values()) - {q}:
            a, b = codes[q], codes[k]
            tried = [chroma.bit_errors(a, b, o) for o in range(-len(b) + 40, len(a) - 40)]
            if any(n >= 40 and d <= chroma.BIT_ERRORS * 32 * n for d, n in tried):
                want.add((q, k))
    assert len(want) > 30 and len(want & found) >= 0.9 * len(want)


# ---- 3 ----


def brute_fingerprint(text, n):
    import re

    import xxhash

    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[k : k + n]) for k in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(fps):
    label = list(range(len(fps)))
    while True:
        new = [min(label[j] for j in range(len(fps)) if bin(fps[i] ^ fps[j]).count("1") <= 4) for i in range(len(fps))]
        if new == label:
            return label
        label = new


def test_simhash_by_brute_force(spark, docs, empty):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(TEXTS) + 1
    fps = [brute_fingerprint(t, 4) for t in TEXTS]
    labels = reach(fps)
    for r in got:
        if r["doc_id"] is not None:
            assert int(r["fingerprint"], 16) == fps[r["doc_id"]] and r["component_id"] == labels[r["doc_id"]]
    assert simhash.near_duplicates(empty).count() == 0
    assert {r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()} == {*labels, None}


@pytest.mark.parametrize("bucket", [4, 1000])
def test_links_of_crowded_buckets(spark, bucket):
    rng, base = np.random.default_rng(2), 0x0123456789ABCDEF
    fps = {base}
    while len(fps) < 90:
        x = base
        for b in rng.choice(64, rng.integers(0, 12), replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(k, f - (1 << 64) if f >> 63 else f) for k, f in enumerate(fps)], "id long, fp long")
    folder = common.shared_dir(spark)
    found = {r["node"]: r["component"] for r in components.components(simhash.links(nodes, folder, bucket=bucket), folder).collect()}
    assert [found.get(k, k) for k in range(len(fps))] == reach(fps)


def test_chains_lose_no_pair():
    rng = np.random.default_rng(3)
    bounds, keys = simhash.segment_bounds(), simhash.chain_keys(7, 4)
    for _ in range(500):
        diff = 0
        for b in rng.choice(64, 4, replace=False):
            diff |= 1 << int(b)
        assert any(all(not diff >> bounds[s][0] & (1 << bounds[s][1]) - 1 for s in k) for k in keys)
        assert simhash.chain_passes(np.array([diff], np.uint64), 7, 4)[0]


def test_components_of_chains_and_loops(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 100), (7, 3), (60, 50), (60, 50)], "a long, b long")
    found = {r["node"]: r["component"] for r in components.components(edges, common.shared_dir(spark)).collect()}
    assert found == {**{k: 0 for k in range(41)}, 50: 50, 60: 50}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0


@pytest.mark.parametrize("group", [512, 3])
def test_similar_texts_by_brute_force(spark, docs, empty, monkeypatch, group):
    monkeypatch.setattr(similar, "GROUP", group)
    rnd, texts = random.Random(8), list(TEXTS)
    for _ in range(12):
        base = [f"w{rnd.randrange(5000)}" for _ in range(rnd.choice([30, 120, 400]))]
        for edits in (0, 0, 1, 2, 3, 5, 9):
            words = list(base)
            for k in rnd.sample(range(len(words)), edits):
                words[k] = f"x{rnd.randrange(5000)}"
            texts.append(" ".join(words))
    sets = [set(simhash.hashes(t, 5).tolist()) for t in texts]
    fps = [brute_fingerprint(t, 5) for t in texts]
    near = lambda i, j: i == j or bin(fps[i] ^ fps[j]).count("1") <= 4 or jaccard(sets[i], sets[j]) >= 0.8
    edges = [[j for j in range(len(texts)) if near(i, j)] for i in range(len(texts))]
    label = list(range(len(texts)))
    while (new := [min(label[j] for j in e) for e in edges]) != label:
        label = new
    assert any(i != j and jaccard(sets[i], sets[j]) >= 0.8 and bin(fps[i] ^ fps[j]).count("1") > 4 for i, e in enumerate(edges) for j in e)
    rows = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(20, texts[20], 1), (None, texts[20], 1)], "doc_id long, text string, bands int").repartition(3)
    got = simhash.similar_or_near(rows).collect()
    assert len(got) == len(texts) + 2
    assert {(r["doc_id"], r["component_id"]) for r in got} == {*enumerate(label), (None, None)}
    assert simhash.similar_or_near(empty).count() == 0 and simhash.similar_or_near(rows.where("doc_id is null")).count() == 1


def test_similar_texts_of_a_large_group(spark):
    rnd = random.Random(11)
    hub = [f"h{k}" for k in range(200)]
    ids = rnd.sample(range(10_000), 901)
    middle = sorted(ids)[450]
    ids.remove(middle)
    data = [(middle, " ".join(hub))]
    for n, k in enumerate(ids):
        words = list(hub)
        for p in rnd.sample(range(200), 4):
            words[p] = f"x{n}.{p}"
        data.append((k, " ".join(words)))
    assert len(data) > similar.GROUP
    sets = {k: set(simhash.hashes(t, 5).tolist()) for k, t in data}
    linked = {k for k, _ in data if jaccard(sets[k], sets[middle]) >= 0.8}
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_or_near(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()}
    assert len(got) == 901 and len(linked) > 800
    assert {got[k] for k in linked} == {min(k for k in got if got[k] == got[middle])}


@pytest.mark.parametrize("split", [0, 3])
def test_forest_of_blocks(split):
    sets = [np.arange(k, k + 40, dtype=np.int32) for k in (0, 2, 100, 4, 102, 300)]
    labels = np.array([5, 5, 6, 7, 8, 9])
    found = similar.forest(np.arange(6), sets, 0.8, labels, split)
    assert sorted((labels[a], labels[b]) for a, b in found) == [(5, 7), (6, 8)]


# ---- 4, 5, 9 ----


def library_ids():
    t = Tokenizer.from_file(PATH)
    return [t.encode(x or "", add_special_tokens=False).ids for x in [*TEXTS, "no id"]]


@pytest.mark.parametrize("block", [64, 4 << 20])
def test_separator_scan_counts(spark, docs, empty, block):
    got = {r["doc_id"]: r["n_tokens"] for r in tokenfiles.token_counts(docs, block_bytes=block).collect()}
    want = [len(bpe_plain(t)) for t in [*TEXTS, "no id"]]
    assert got == dict(zip([*range(len(TEXTS)), None], want))
    assert tokenfiles.token_counts(empty).count() == 0


def bpe_plain(text):
    """Ids with the separator's own text taken as ordinary characters."""
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


def test_scan_of_a_file_without_an_end(spark, tmp_path):
    ids = np.array([5, 9, 9, 7, 9, 1, 2, 3], "<u4")
    (tmp_path / "f").write_bytes(ids.tobytes())
    files = spark.createDataFrame([("f", ids.nbytes), ("g", 0)], "file string, n_bytes long")
    rows = tokenfiles.scan_separators(files, f"file://{tmp_path}", 9, 8, width=4).orderBy("doc_index").collect()
    assert [(r["start"], r["n_tokens"], r["ended"]) for r in rows] == [(0, 1, True), (2, 0, True), (3, 1, True), (5, 3, False)]


def test_token_files_round_trip(spark, docs, empty):
    got = tokenfiles.write_and_read(docs).collect()
    order, start = [None, *range(len(TEXTS))], 0
    ids = library_ids()
    by = {r["doc_id"]: r for r in got}
    for k in order:
        mine = np.array([*ids[-1 if k is None else k], 2], "<u4")
        assert tuple(by[k])[1:] == (start, len(mine), zlib.crc32(mine.tobytes()))
        start += len(mine)
    assert tokenfiles.write_and_read(empty).count() == 0


def test_bpe_equals_the_library(spark, docs, empty):
    t = Tokenizer.from_file(PATH)
    got = {r["doc_id"]: r for r in bpe.encode_decode(docs).collect()}
    for k, ids in zip([*range(len(TEXTS)), None], library_ids()):
        assert got[k]["n_tokens"] == len(ids) and got[k]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_decode(empty).count() == 0


def test_bpe_on_random_texts():
    t, rnd = Tokenizer.from_file(PATH), random.Random(9)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "'", "<|endoftext|>", "é", "中", "🙂", "́", "12", "!", "...", "\x1c", "\x85", "　", "\xa0", "​", "the", "²", "x" * 70]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 12))) for _ in range(3000)]
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    for encoder in (bpe.own_encoder(PATH)[1], tokenfiles.library_encoder(PATH)):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == want


# ---- 6 ----


def test_main_text():
    tree = html.grow(*html.labelled_blocks())
    page = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header>
    <nav><ul><li><a href=/>Home</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy now and save a lot of money on things that you never knew you would need so badly.</div>
    <article><h1>Title &amp; more</h1><p><b>First&nbsp; line<br><p>Be.</p><ul><li>one</li></ul><div class="comments"><p>Nice text, thank you for all of this work, I liked it very much indeed.</p></div></article>
    <aside><p>Side words go here and they go on for quite a while to look like text.</p></aside><form><p>Name</p></form><footer>&copy; me</footer>"""
    assert html.main_text(page, tree) == "Title & more\nFirst line\nBe.\none"
    assert html.main_text(None, tree) == html.main_text("<<<", tree).strip("<") == html.main_text("<p", tree) == ""
    x, y = html.labelled_blocks()
    assert (html.classify(tree, x) == y).all() and y.sum() > 15 and (~y).sum() > 15


class PlainBlocks(HTMLParser):
    """Blocks of a well-formed page by the standard parser, with open elements in a plain list."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.text, self.linked, self.blocks, self.prose, self.skip, self.link, self.own, self.forms = [], "", "", [], False, 0, False, False, 0

    def close_block(self):
        words, linked = self.text.split(), self.linked.split()
        if words:
            main = [k for k, (article, _, _) in enumerate(self.open) if article]
            named = [k for k, (_, sure, _) in enumerate(self.open) if sure]
            inner = [k for k in named if main and k > main[0]]
            self.blocks.append([" ".join(words), len(words), len(linked) / len(words), self.prose, bool(main), len(named) + self.own, sum(p for _, _, p in self.open), len(inner) + self.own, self.forms])
        self.text = self.linked = ""

    def handle_starttag(self, tag, attrs):
        if tag in html.SKIPPED_TAGS:
            self.skip += 1
        elif tag == "a":
            self.link = True
        elif tag == "br":
            self.text += " "
        elif tag in html.BLOCK_TAGS and not self.skip:
            self.close_block()
            self.prose = tag in html.PROSE_TAGS
            inside = any(article for article, _, _ in self.open)
            sure, perhaps = html.names_of(" ".join(f'{k}="{v}"' for k, v in attrs), inside)
            self.own = sure and tag not in html.CONTAINERS
            self.forms += tag == "form"
            if tag in html.CONTAINERS:
                boiler = sure or tag in html.BOILER_TAGS or (tag == "header" and not inside)
                self.open.append((tag in ("article", "main") and not sure, boiler and tag not in ("body", "main"), perhaps))

    def handle_endtag(self, tag):
        if tag in html.SKIPPED_TAGS:
            self.skip -= 1
        elif tag == "a":
            self.link = False
        elif tag in html.BLOCK_TAGS and not self.skip:
            self.close_block()
            self.prose = self.own = False
            self.forms -= tag == "form"
            if tag in html.CONTAINERS:
                self.open.pop()

    def handle_data(self, data):
        if not self.skip:
            self.text += data
            self.linked += data if self.link else ""


def plain_main_text(page, tree):
    parser = PlainBlocks()
    parser.feed(page)
    parser.close_block()
    found = parser.blocks
    if sum(b[1] for b in found if b[8]) > sum(b[1] for b in found) / 2:
        for b in found:
            b[5], b[7] = max(0, b[5] - b[8]), max(0, b[7] - b[8])
    if any(b[4] for b in found) and not any(b[4] and not b[5] for b in found):
        for b in found:
            b[5] = b[7] if b[4] else b[5]
    out = []
    for k, (text, words, links, prose, main, named, perhaps, _, _) in enumerate(found):
        before, after = (found[j] if 0 <= j < len(found) else ["", 0, 0] for j in (k - 1, k + 1))
        row = [words, links, before[1], before[2], after[1], after[2], prose, main, any(b[4] for b in found) and not main, named, perhaps]
        node = tree
        while not isinstance(node, bool):
            node = node["low"] if row[node["feature"]] <= node["cut"] else node["high"]
        if node:
            out.append(text)
    return "\n".join(out)


def test_main_text_by_brute_force():
    tree, rnd = html.grow(*html.labelled_blocks()), random.Random(12)
    names = ["", ' class="ad"', ' class="share-price"', ' class="post-header"', ' id="comments"', ' class="has-sidebar x"', ' role="navigation"', ' class="ad-slot"']
    words = lambda: " ".join(rnd.choices(["river", "&amp;", "a&nbsp;b", "x", "é", "3 &lt; 4"], k=rnd.randint(1, 30)))

    def piece(depth):
        kind = rnd.randrange(7) if depth else rnd.randrange(3)
        if kind == 0:
            return f"<p{rnd.choice(names)}>{words()}</p>"
        if kind == 1:
            return f"<h2>{words()}</h2>{words()}"
        if kind == 2:
            return "<ul>" + "".join(f"<li><a href=/x>{words()}</a>{rnd.choice(['', words()])}</li>" for _ in range(rnd.randint(1, 5))) + "</ul>"
        if kind == 3:
            return f"<script>if (a < b) {{ '<p>' }}</script><!-- <p>no</p> -->{words()}<br>{words()}"
        tag = rnd.choice(["div", "section", "article", "aside", "header", "footer", "nav", "main", "form"])
        return f"<{tag}{rnd.choice(names)}>" + "".join(piece(depth - 1) for _ in range(rnd.randint(1, 4))) + f"</{tag}>"

    for _ in range(400):
        page = "<html><head><title>t</title></head><body>" + "".join(piece(3) for _ in range(rnd.randint(1, 5))) + "</body></html>"
        assert html.main_text(page, tree) == plain_main_text(page, tree), page


def test_main_text_of_odd_pages():
    tree = html.grow(*html.labelled_blocks())
    text = lambda page: html.main_text(page, tree)
    rise = "The share price rose by a tenth."
    assert text(f'<article><div class="post-header"><h1>Title words</h1></div><div class="share-price"><p>{rise}</p></div></article>') == f"Title words\n{rise}"
    assert text("<body><p>Short text.</p><p>Another.</p></body>") == "Short text.\nAnother."
    assert text("<html><head><title>x</title><body><p>No end of head.</p>") == "No end of head."
    assert text("<body><svg viewBox='0'/><p>After a picture.</p><svg-icon></svg-icon><p>And an icon.</p>") == "After a picture.\nAnd an icon."
    assert text('<div class="has-sidebar"><article><p>Hello there.</p></article></div>') == "Hello there."
    assert text("<p>1 < 2 and a <b>bold</b> <a title='x>y'>word</a></p>") == "1 < 2 and a bold word"
    assert text("<p>one</p><noscript><p>two</p>") == "one\ntwo" and text("<p>one</p><style>p { }<p>two</p>") == "one"
    rain = "The rain fell on the town for days and nobody went out."
    for page in (f'<article><div class="overflow-hidden"><p>{rain}</p></div></article>', f'<div class="overflow-hidden hidden-print"><p>{rain}</p></div>', f"<div data-x='a hidden b'><p>{rain}</p></div>",
                 f'<article><p>{rain}</p><p class="ad">Buy two lamps and get one free.</p></article>', f'<article><p>{rain}</p><p hidden>Not shown.</p><div style="color:red; display: none">Nor this.</div></article>',
                 f'<form id="aspnetForm"><nav><a href=/>Home</a></nav><article><p>{rain}</p></article></form>', f"<p>{rain}</p><form><p>Your name</p></form>"):
        assert text(page) == rain, page
    table = "<table><tr><th>Year</th><th>Rain</th></tr><tr><td>1990</td><td>20 mm</td></tr></table>"
    assert text(f"<article><h1>Rain</h1><p>{rain}</p>{table}</article>") == f"Rain\n{rain}\nYear\nRain\n1990\n20 mm"
    for page in ("<a " * 330_000, "<div>x" * 160_000, "<svg>" * 200_000, "<p title='" * 100_000, "</script " * 100_000, "<" * 500_000, '<a x=">" ' * 100_000):
        began = time.time()
        text(page)
        assert time.time() - began < 10, page[:9]


def test_both_neighbours_links_are_asked():
    def asked(node):
        return set() if isinstance(node, bool) else {html.FEATURES[node["feature"]]} | asked(node["low"]) | asked(node["high"])

    assert {"words", "links", "links_before", "links_after"} <= asked(html.grow(*html.labelled_blocks()))


def test_main_text_query(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>a  b</p></article>", 5), (None, None, None, 5), (1, "u", "<article><p>a  b</p></article>", 5)], "page_id long, url string, html string, n_chars int")
    assert sorted((r["text"], r["n_chars"]) for r in html.extract(pages).collect()) == [("", 0), ("a b", 3), ("a b", 3)]
    assert html.extract(pages.limit(0)).count() == 0


# ---- 7 ----


def test_toxicity_on_held_out_rows(spark, docs, empty):
    rnd = random.Random(1)
    words = [f"w{k}" for k in range(400)]
    bad = ["awful", "vileness", "vilely", "nastier"]
    rows = []
    for k in range(900):
        toxic = k % 4 == 0
        text = rnd.choices(words, k=60) + (rnd.choices(bad, k=rnd.randint(1, 6)) if toxic else [])
        rnd.shuffle(text)
        rows.append((k, " ".join(text), int(toxic)))
    data = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    labels = data.where("doc_id < 600").select("doc_id", "toxic")
    model = toxicity.train(data.drop("toxic"), labels)
    assert model.thresholds == sorted(model.thresholds) and len(model.thresholds) == 2
    scored = toxicity.score(data.drop("toxic"), model).join(data.select("doc_id", "toxic"), "doc_id").where("doc_id >= 600").collect()
    assert all((r["p_toxic"] > 0.5) == bool(r["toxic"]) for r in scored)
    assert all(abs(r["severity"]) <= 2 and r["grade"] in (0, 1, 2) for r in scored)
    more = toxicity.score(spark.createDataFrame([(1, "awful"), (2, "awful vileness vilely nastier")], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert more[0]["severity"] < more[1]["severity"]
    assert toxicity.drop_toxic(data, model).count() == 675 and toxicity.drop_toxic(data, model).columns == data.columns
    assert toxicity.score(docs, model).count() == len(TEXTS) + 1 and toxicity.score(empty, model).count() == 0
    assert toxicity.train(data, labels.limit(0)).probabilities(5.0)[0] < 0.5


def plain_likelihood(model, sets, grades):
    """Mean log-likelihood of grades by the definition: P(grade = g) = P(> g - 1) - P(> g)."""
    total = 0.0
    for found, g in zip(sets, grades):
        over = [1.0, *model.probabilities(sum(model.weights.get(f, 0.0) for f in found)), 0.0]
        total += np.log(max(over[g] - over[g + 1], 1e-12))
    return total / len(grades)


def test_fit_is_a_maximum():
    rnd = random.Random(7)
    texts, grades = [], []
    for k in range(400):
        g = k % 3
        marks = rnd.choices(["vile", "awful", "nasty"], k=g + (rnd.random() < 0.2)) + (["awful"] if rnd.random() < 0.1 else [])
        texts.append(" ".join(rnd.choices([f"w{j}" for j in range(60)], k=9) + marks + [f"t{k}"]))
        grades.append(g)
    model = toxicity.fit(texts, grades, ridge=0.0, rounds=2000)
    sets = [{f for w in t.split() for f in toxicity.features_of(w)} for t in texts]
    best = plain_likelihood(model, sets, grades)
    assert model.thresholds == sorted(model.thresholds) and best > -np.log(3)
    for seed in range(30):
        rng = np.random.default_rng(seed)
        moved = toxicity.Model({f: w + rng.normal(0, 0.05) for f, w in model.weights.items()}, [t + rng.normal(0, 0.05) for t in model.thresholds])
        assert plain_likelihood(moved, sets, grades) <= best + 1e-3


# ---- 8 ----


@pytest.mark.parametrize("seed", [0, 1])
def test_recall_of_edited_copies(spark, seed):
    """Copies at many edit rates: those that an alignment with the whole document accepts are found through seeds."""
    rnd = random.Random(seed)
    pool = [f"v{k}" for k in range(900)]
    items = [(k, rnd.choices(pool, k=rnd.randint(12, 60))) for k in range(12)]
    data, want = [], set()
    for d in range(160):
        k, words = rnd.choice(items)
        rate, copy = rnd.uniform(0, 0.35), []
        for w in words:
            x = rnd.random()
            copy += [] if x < rate / 4 else [w, rnd.choice(pool)] if x < rate / 2 else [rnd.choice(pool)] if x < rate else [w]
        text = rnd.choices(pool, k=30) + copy + rnd.choices(pool, k=30)
        data.append((d, " ".join(text)))
        for i, item in items:
            number = {w: n for n, w in enumerate(dict.fromkeys(item))}
            row = np.array([[number.get(w, -1) for w in text]], np.int32)
            if decontaminate.align(np.array([number[w] for w in item]), row)[0] >= decontaminate.LEAST * 2 * len(item):
                want.add((d, i))
    rows = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    tests = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(rows, tests).collect()}
    assert got <= want and len(want) > 80 and len(got) >= 0.9 * len(want)


def plain_align(a, b):
    h, best = np.zeros((len(a) + 1, len(b) + 1), int), 0
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
            best = max(best, h[i + 1, j + 1])
    return best


def test_alignment_scores():
    rng = np.random.default_rng(4)
    item, rows = rng.integers(0, 4, 15), rng.integers(-1, 4, (20, 33))
    assert decontaminate.align(item, rows).tolist() == [plain_align(item, r) for r in rows]


def test_leaks_are_found(spark, docs, empty):
    rnd = random.Random(2)
    item = [f"q{k}" for k in range(40)]
    edited = [w if k % 6 else "other" for k, w in enumerate(item) if k % 11]
    noise = lambda n: " ".join(rnd.choices([f"n{k}" for k in range(500)], k=n))
    data = [(0, noise(80)), (1, noise(50) + " " + " ".join(item).upper() + "! " + noise(20)), (2, noise(9) + ", ".join(edited) + " " + noise(9)), (3, " ".join(item[:9]) + " " + noise(80)), (4, noise(30_000) + " " + " ".join(item)), (5, None), (6, "short one"), (6, "short one")]
    rows = spark.createDataFrame(data, "doc_id long, text string").withColumn("item_id", F.lit("x")).repartition(3)
    items = spark.createDataFrame([(7, " ".join(item)), (8, "short one"), (9, None), (10, "")], "item_id long, text string")
    for limit in (decontaminate.ITEMS_BYTES, 10):
        got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(rows, items, limit=limit).collect()}
        assert got == {(1, 7), (2, 7), (4, 7), (6, 8)}
    assert sorted(r["doc_id"] for r in decontaminate.drop_contaminated(rows, items).collect()) == [0, 3, 5]
    assert decontaminate.contamination(empty, items).count() == 0 and decontaminate.contamination(rows, items.limit(0)).count() == 0


@pytest.mark.parametrize("every", [4, 5])
@pytest.mark.parametrize("exact", [False, True])
def test_leaks_with_regular_edits(spark, every, exact):
    item = [f"q{k}" for k in range(60)]
    copies = [" ".join(["n"] * 50 + [f"x{k}" if k % every == s else w for k, w in enumerate(item)] + ["n"] * 50) for s in range(every)]
    for text in copies:  # each by itself, or with no other document than the whole item
        items = decontaminate.Items([(7, " ".join(item))], decontaminate.N)
        held = [set(items.find(t)[2].tolist()) for t in ([text, " ".join(item)] if exact else [text])]
        seeds = items.seeds({g: sum(g in h for h in held) for g in set().union(*held)})
        assert held[0] & set(seeds)
    rows = spark.createDataFrame([(1, copies[0]), *([(9, " ".join(item))] if exact else [])], "doc_id long, text string")
    got = decontaminate.contamination(rows, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string"))
    assert {r["doc_id"] for r in got.collect()} == ({1, 9} if exact else {1})


@pytest.mark.parametrize("every", [4, 5])
def test_leaks_with_regular_edits_among_frequent_copies(every):
    item = [f"q{k}" for k in range(60)]
    items = decontaminate.Items([(7, " ".join(item))], decontaminate.N)
    for shift in range(every):  # the item's own copies make all its n-grams frequent: no share helps, only the stretches
        edited = set(items.find(" ".join(f"x{k}" if k % every == shift else w for k, w in enumerate(item)))[2].tolist())
        assert edited & set(items.seeds({g: 50_000 + 900 * (g in edited) for g in range(len(item) - 2)}, most=0))


def test_leaks_where_shares_act(spark):
    rnd = random.Random(8)
    stock = [" ".join(rnd.choices([f"s{k}" for k in range(40)], k=6)) for _ in range(30)]  # phrases that most documents hold
    phrase = lambda: rnd.choice(stock) if rnd.random() < 0.5 else " ".join(rnd.choices([f"w{k}" for k in range(3000)], k=6))
    tests = [(k, " ".join(phrase() for _ in range(8))) for k in range(20)]
    edit = lambda text: " ".join(f"z{rnd.random()}" if rnd.random() < 0.12 else w for w in text.split())
    texts = [" ".join([*(phrase() for _ in range(40)), *([edit(tests[k % 20][1])] if k < 60 else []), *(phrase() for _ in range(9))]) for k in range(600)]
    items = decontaminate.Items(tests, decontaminate.N)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    seeds = decontaminate.seeded(rows.select("text"), items)
    assert len(items.gram_ids) - len(seeds) >= 20  # n-grams too common, though stretches within a phrase keep theirs
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(rows, spark.createDataFrame(tests, "item_id long, text string")).collect()}
    want, found = set(), [items.find(t)[0] for t in texts]
    grid = np.full((len(texts), max(map(len, found))), -1, np.int32)
    for r, w in enumerate(found):
        grid[r, : len(w)] = w
    for k, words in enumerate(items.words):
        best = decontaminate.align(words, grid)
        want |= {(r, k) for r in np.flatnonzero(best >= decontaminate.LEAST * decontaminate.MATCH * len(words)).tolist()}
    planted = {(k, k % 20) for k in range(60)} & want
    assert got <= want and len(planted) >= 55 and len(got & planted) >= 0.98 * len(planted) and len(got) >= 0.9 * len(want)


def test_rows_are_judged_by_their_texts(spark):
    text = lambda c: " ".join(f"{c}{k}" for k in range(40))
    data = [(None, text("a")), (None, text("b")), (1, text("a")), (1, text("c")), (1, text("c")), (2, text("c")), (3, None)]
    rows = spark.createDataFrame([(*d, "s") for d in data], "doc_id long, text string, source string")
    clean = decontaminate.drop_contaminated(rows, spark.createDataFrame([(7, text("a"))], "item_id long, text string")).select("doc_id", "text").collect()
    assert sorted(map(tuple, clean), key=str) == sorted((d for d in data if d[1] != text("a")), key=str)
    once = simhash.drop_near_duplicates(rows).select("doc_id", "text").collect()
    assert sorted(map(tuple, once), key=str) == sorted([*data[:4], (3, None)], key=str)


# ---- 10 ----


def test_warc_roles(spark):
    rows = [(1, "u", "same"), (2, "u", "same"), (3, "u", None), (4, "u", ""), (5, None, "other é"), (9, "u\n v", "same"), (None, "u", "same"), (9, "u", "same")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    got = sorted(map(tuple, warc.archive(pages).collect()), key=str)
    role = lambda i, h: ("response", None) if i in (None, 4, 5, 9) else ("revisit", 9 if h == "same" else 4)
    want = [(i, len((h or "").encode()), warc.digest((h or "").encode()), *role(i, h)) for i, _, h in rows]
    assert got == sorted(want, key=str)
    assert warc.archive(pages.limit(0)).count() == 0
    with pytest.raises(ValueError, match="does not give back"):
        broken = lambda f: iter([{"gap_start": 0, "gap_bytes": 9, "reason": "planted"}])
        held = warc.salvage
        warc.salvage = broken
        try:
            warc.archive(pages)
        finally:
            warc.salvage = held
    assert {r["record_type"] for r in warc.archive(pages, least_bytes=100).collect()} == {"response"}


def member(k, text):
    return warc.record(k, "http://x/", text, warc.digest(text), len(text), None)


class File(io.BytesIO):
    def size(self):
        return len(self.getvalue())

    def read_at(self, n, a):
        return self.getvalue()[a : a + n]


def test_salvage_after_damage():
    parts = [member(k, b"payload %d " % k * 200) for k in range(5)]
    bad = bytearray(parts[2])
    bad[len(bad) // 2] ^= 0xFF
    data = b"junk" + parts[0] + parts[1] + bytes(bad) + parts[3] + parts[4][:-9]
    rows = list(warc.salvage(File(data)))
    assert [r["page_id"] for r in rows if "reason" not in r] == [0, 1, 3]
    gaps = [(r["gap_start"], r["gap_bytes"]) for r in rows if "reason" in r]
    start = 4 + len(parts[0]) + len(parts[1])
    assert gaps == [(0, 4), (start, len(bad)), (start + len(bad) + len(parts[3]), len(parts[4]) - 9)]
    plain = [gzip.decompress(p) for p in parts]
    wrong = plain[1].replace(b"payload 1", b"payload X", 1)
    cut = plain[0] + wrong + plain[2] + plain[3][:-30] + plain[4]
    assert [r["page_id"] for r in warc.salvage(File(cut)) if "reason" not in r] == [0, 2, 4]
    assert list(warc.salvage(File(b""))) == []
    whole = plain[0] + wrong + plain[2] + b"tail"
    rows = list(warc.salvage(File(gzip.compress(whole) + parts[3])))
    assert [r["page_id"] for r in rows if "reason" not in r] == [0, 2, 3]
    assert [r["gap_bytes"] for r in rows if "reason" in r] == [len(wrong), 4] and all(r["gap_start"] == 0 for r in rows if "reason" in r)


def test_salvage_within_a_broken_member():
    rnd = random.Random(3)
    texts = [" ".join(rnd.choices(["rain", "sun", "wind", "storm", "café"], k=400)).encode() for _ in range(20)]
    plain = [gzip.decompress(member(k, t)) for k, t in enumerate(texts)]
    packed = bytearray(gzip.compress(b"".join(plain)))
    packed[-20] ^= 0xFF
    rows = list(warc.salvage(File(bytes(packed) + member(77, b"next"))))
    assert [r["page_id"] for r in rows if "reason" not in r] == [*range(19), 77]
    (gap,) = [r for r in rows if "reason" in r]
    assert (gap["gap_start"], gap["gap_bytes"]) == (0, len(packed)) and "19 records before it kept" in gap["reason"]
    assert [r["payload_digest"] for r in rows if "reason" not in r] == [warc.digest(t) for t in [*texts[:19], b"next"]]
    # damage anywhere: what comes back is a true record, and no whole record before the damage is lost
    sound = gzip.compress(b"".join(plain))
    for place in range(30, len(sound) - 8, len(sound) // 40):
        hurt = bytearray(sound)
        hurt[place] ^= 0x10
        got = [(r["page_id"], r["payload_digest"]) for r in warc.salvage(File(bytes(hurt))) if "reason" not in r]
        assert set(got) <= {(k, warc.digest(t)) for k, t in enumerate(texts)} and len(set(got)) == len(got)
        inflate, before = zlib.decompressobj(31), b""
        with contextlib.suppress(zlib.error):
            for k in range(place):
                before += inflate.decompress(sound[k : k + 1])
        ends = np.cumsum([len(p) for p in plain])
        assert len(got) >= int((ends <= len(before) - 300).sum())
    # a record without a digest is believed in a sound member only
    bare = [re.sub(rb"WARC-(Block|Payload)-Digest: [^\r]*\r\n", b"", p) for p in plain]
    assert len([r for r in warc.salvage(File(gzip.compress(b"".join(bare)))) if "reason" not in r]) == 20
    hurt = bytearray(gzip.compress(b"".join(bare)))
    hurt[-6] ^= 0xFF  # the checksum
    assert [sorted(r) for r in warc.salvage(File(bytes(hurt)))] == [["gap_bytes", "gap_start", "reason"]]


def test_salvage_in_bounded_memory(monkeypatch):
    payload = bytes(range(256)) * (1 << 18)  # one record of 64 MB in one member, and 40 MB of others
    one = gzip.decompress(warc.record(1, "u", payload, warc.digest(payload), len(payload), None))
    small = gzip.decompress(member(2, b"x" * (1 << 20)))
    data = File(gzip.compress(one + small * 40 + one[:-9], 1))
    want = warc.digest(payload)
    del payload, one, small
    tracemalloc.start()
    rows = list(warc.salvage(data))
    peak = tracemalloc.get_traced_memory()[1] - len(data.getvalue())
    tracemalloc.stop()
    assert [r["page_id"] for r in rows if "reason" not in r] == [1] + [2] * 40 and rows[0]["payload_digest"] == want
    assert len([r for r in rows if "reason" in r]) == 1 and peak < 24 << 20
