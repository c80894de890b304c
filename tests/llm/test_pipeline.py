"""The pipeline's stages against brute-force decisions on a small corpus with edge rows."""

import random

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fluxloom.llm import common, decontaminate, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component string, key long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder, rnd = tmp_path_factory.mktemp("corpus"), random.Random(3)
    words = [f"w{k}" for k in range(3000)]
    text = lambda n=60: " ".join(rnd.choices(words, k=n))
    docs, labels = [], []
    for k in range(200):
        docs.append((k, text() + (" horrid vile" if k % 5 == 0 else "")))
        labels.append((k, 1, int(k % 5 == 0)))
    item, base = text(40), text(200).split()
    near = lambda n: " ".join(f"x{rnd.randrange(9)}" if k in rnd.sample(range(200), n) else w for k, w in enumerate(base))
    docs += [(400, docs[1][1]), (401, docs[2][1].upper()), (402, text() + " " + item), (403, ""), (404, None), (405, "   ")]
    docs += [(500 + k, near(k % 6)) for k in range(12)]
    docs += [(None, text()), (None, text() + " " + item), (None, "horrid vile horrid vile"), (None, docs[3][1])]
    docs += [(7, text()), (7, docs[7][1]), (7, docs[7][1]), (6, text() + " " + item), (600, "long " * 20_000 + text(2000))]
    rows = [(d, t, "en", "s", 1, "mine", 5) for d, t in docs]
    make = lambda data, schema, name: spark.createDataFrame(data, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    make(rows, SCHEMA, "documents")
    make(labels, "doc_id long, quality int, toxic int", "labels")
    make([(1, item)], "item_id long, text string", "benchmark")
    return str(folder), docs, item


def kept_by_classes(docs):
    """One row of each class: all pairs of texts by bits of their fingerprints and by their sets of shingles."""
    texts = list(dict.fromkeys(t for d, t in docs if d is not None))
    prints = [simhash.fingerprint(t, 5) for t in texts]
    sets = [set(simhash.hashes(t, 5).tolist()) for t in texts]
    label = list(range(len(texts)))
    alike = lambda i, j: bin(prints[i] ^ prints[j]).count("1") <= 4 or (sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    edges = [[j for j in range(len(texts)) if alike(i, j)] for i in range(len(texts))]
    while (new := [min(label[j] for j in e) for e in edges]) != label:
        label = new
    of = dict(zip(texts, label))
    least = {}
    for d, t in docs:
        if d is not None:
            least[of[t]] = min(d, least.get(of[t], d))
    return of, least


def test_stages_equal_brute_force(spark, corpus):
    folder, docs, item = corpus
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_and_similarity_near_dedup", "benchmark_decontamination", "bpe"]
    now = common.table(spark, folder, "documents")
    schema = now.schema
    model = toxicity.train(now, common.table(spark, folder, "labels"))
    stages = [f for _, f in corpus_pipeline.STAGES]
    rows = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    out, shared = [], common.shared_dir(spark)
    for k, stage in enumerate(stages):
        now = common.stored(stage(spark, now, folder), shared, str(k))
        out.append(now)
        assert k == 3 or now.schema == schema and now.where("component = 'mine' and key = 5").count() == now.count()
    bad = lambda t: model.probabilities(sum(model.weights.get(f, 0.0) for f in {f for w in toxicity.WORD.findall((t or "").lower()) for f in toxicity.features_of(w)}))[0] > 0.5
    clean = [(d, t) for d, t in docs if not bad(t)]
    assert rows(out[0]) == sorted(clean, key=str) and sum(bad(t) for _, t in docs) > 35
    of, least = kept_by_classes(clean)
    once = rows(out[1])
    assert [r for r in once if r[0] is None] == sorted((r for r in clean if r[0] is None), key=str)
    known = [r for r in once if r[0] is not None]
    assert sorted((of[t], d) for d, t in known) == sorted(least.items()) and set(known) <= set(clean)
    size = {w: k for k, w in enumerate(dict.fromkeys(item.split()))}
    score = lambda t: decontaminate.align(np.array([size[w] for w in item.split()]), np.array([[size.get(w, -1) for w in decontaminate.words_of(t)] or [-1]], np.int32))[0]
    left = [r for r in once if score(r[1]) < decontaminate.LEAST * 2 * 40]
    assert rows(out[2]) == sorted(left, key=str) and len(once) - len(left) >= 2
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sorted((r["doc_id"] is None, r["doc_id"], r["n_tokens"]) for r in out[3].where("doc_id is not null").collect()) == sorted((False, d, len(t.encode(x or "", add_special_tokens=False).ids)) for d, x in left if d is not None)
    assert out[3].count() == len(left)


def test_empty_tables(spark, corpus, tmp_path):
    folder = corpus[0]
    for name in ("documents", "labels", "benchmark"):
        common.table(spark, folder, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
