import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import ODD
from pyspark.sql import functions as F

from ledgerlake.llm import toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.fit(docs, labels, ~toxicity.held_out(F.col("doc_id"))), docs, labels


def test_held_out_accuracy(fitted):
    model, docs, labels = fitted
    rows = docs.join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).select("doc_id", "text", "toxic").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)
    scores, _, _ = model.score([r["text"] for r in rows])
    toxic = np.array([r["toxic"] for r in rows]) == 1
    hit = scores >= toxicity.THRESHOLD
    assert (hit & toxic).sum() / toxic.sum() > 0.9 and (hit & toxic).sum() / hit.sum() > 0.9
    assert not set(model.ids.tolist()) & {r["doc_id"] for r in rows}


def test_neighbours_are_exact(fitted):
    model, docs, _ = fitted
    texts = [r["text"] for r in docs.orderBy("doc_id").limit(300).collect()]
    queries = model.weights(texts)
    examples = np.zeros((len(model.ids), len(model.terms)), np.float32)
    for b, (terms, postings) in enumerate(model.blocks):
        examples[b * toxicity.BLOCK : b * toxicity.BLOCK + postings.shape[1], terms] = postings.T
    every = queries @ examples.T
    where, near = model.nearest(queries)
    best = -np.sort(-every, 1)[:, : near.shape[1]]
    assert np.allclose(near, np.where(best > 0, best, 0), atol=1e-5)
    for k in range(len(texts)):
        for p, s in zip(where[k], near[k], strict=True):
            assert p < 0 or abs(every[k, p] - s) < 1e-5


def test_odd_rows(fitted, docs, odd):
    model, _, _ = fitted
    got = toxicity.score(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] < toxicity.THRESHOLD for r in got)
    assert toxicity.without_toxic(odd, model).count() == len(ODD) and toxicity.without_toxic(odd, model).columns == odd.columns
    assert toxicity.score(docs([]), model).count() == 0


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, None), (2, 7), (None, 1), (99, 0)]])
def test_few_or_odd_labels(spark, docs, odd, labels):
    model = toxicity.fit(odd, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(odd, model).collect())
    assert toxicity.fit(docs([]), spark.createDataFrame(labels, "doc_id long, toxic int")).terms.size == 0


def plain_terms(text):
    """Words, beginnings of longer ones in bytes, and beginnings that several words share."""
    words = Counter(w.encode() for w in re.findall(r"\w+", (text or "").lower()))
    stems = Counter(w[:n] for w in words for n in toxicity.STEMS if len(w) > n)
    return Counter({("word", w): n for w, n in words.items()} | {("stem", s): n for s, n in stems.items()} | {("shared", s): n for s, n in stems.items() if n > 1})


def made(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéü") for _ in range(rng.randint(1, 11))) for _ in range(120)] + ["vile", "vilest", "vileness"]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) + (" vile vileness" if k % 3 == 0 else "") for k in range(n)]


def test_neighbours_against_plain_cosine_over_all_terms(docs):
    texts = made(4, 90)
    labelled = {k: int(k % 3 == 0) for k in range(60)}
    model = toxicity.fit(docs(list(enumerate(texts))), docs([]).sparkSession.createDataFrame(list(labelled.items()), "doc_id long, toxic int"))
    terms = [plain_terms(t) for t in texts]
    n1, n0 = sum(labelled.values()), len(labelled) - sum(labelled.values())

    def weight(term):
        a, b = (sum(term in terms[k] for k in labelled if labelled[k] == y) for y in (1, 0))
        if not a + b:
            return 0.0
        n, seen = n1 + n0, a + b
        variance = (seen + toxicity.UNTOLD) * max(n - seen, 1) * n1 * n0 / n**2
        phi = abs(a - seen * n1 / n) / math.sqrt(variance)
        return (math.log((1 + len(texts)) / (1 + sum(term in x for x in terms))) + 0.01) * (phi + toxicity.LEAST_PHI)

    weights = {t: weight(t) for t in set().union(*terms)}
    assert len(model.terms) == sum(w > 0 for w in weights.values())

    def unit(counts):
        out = {t: (1 + math.log(n)) * weights[t] for t, n in counts.items() if weights[t] > 0}
        norm = math.sqrt(sum(v * v for v in out.values()))
        return {t: v / norm for t, v in out.items()}

    vectors = [unit(x) for x in terms]
    where, near = model.nearest(model.weights(texts))
    for k, query in enumerate(vectors):
        every = {d: sum(v * vectors[d].get(t, 0) for t, v in query.items()) for d in labelled}
        best = sorted(every.values(), reverse=True)[: near.shape[1]]
        assert np.allclose(near[k], [max(0, x) for x in best], atol=1e-5)
        assert all(p < 0 or abs(every[int(model.ids[p])] - s) < 1e-5 for p, s in zip(where[k], near[k], strict=True))


def test_terms_of_texts_taken_together_stay_apart():
    texts = [*made(5, 30), None, "", "«Wort», “word” it's a_b 9x", "é" * 40 + " " + "long" * 60]
    together, alone = toxicity._terms(texts), [toxicity._terms([t]) for t in texts]
    for k, (_, term, n) in enumerate(alone):
        mine = together[0] == k
        assert Counter(dict(zip(together[1][mine].tolist(), together[2][mine].tolist(), strict=True))) == Counter(dict(zip(term.tolist(), n.tolist(), strict=True)))
        assert sorted(n.tolist()) == sorted(plain_terms(texts[k]).values())


def test_held_out_recall_on_the_smaller_table(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet".replace("sf0.1", "sf0.01")) for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels, ~toxicity.held_out(F.col("doc_id")))
    rows = docs.join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).select("text", "toxic").collect()
    hit, toxic = model.score([r["text"] for r in rows])[0] >= toxicity.THRESHOLD, np.array([r["toxic"] for r in rows]) == 1
    assert (hit & toxic).sum() / toxic.sum() >= 0.9 and (hit & ~toxic).sum() / (~toxic).sum() < 0.1


def test_rows_of_one_id_count_once(docs, spark):
    rows = [(k, f"{'vile word' if k < 5 else 'mild word'} {k}") for k in range(10)] + [(0, "other text"), (0, "vile word 0")]
    model = toxicity.fit(docs(rows), spark.createDataFrame([(k, int(k < 5)) for k in range(10)] + [(0, 0)], "doc_id long, toxic int"))
    assert sorted(model.ids.tolist()) == list(range(10)) and model.toxic.sum() == 5


def test_rare_words_count(spark):
    few = [(k, "the grumblewort came by" if k < 3 else f"the day {'went' if k % 2 else 'came'} by") for k in range(30)]
    made = spark.createDataFrame([*few, (100, "a grumblewort"), (101, "a day")], "doc_id long, text string")
    model = toxicity.fit(made, spark.createDataFrame([(k, int(k < 3)) for k, _ in few], "doc_id long, toxic int"))
    scores, where, _ = model.score(["a grumblewort", "a day", "qqq"])
    assert set(toxicity._terms(["grumblewort day went the"])[1]) <= set(model.terms)
    assert scores[0] >= toxicity.THRESHOLD > scores[1] and (where[1] >= 0).any() and not (where[2] >= 0).any()
    assert scores[2] == model.prior == 0.1


def test_all_words_of_the_examples_are_terms(fitted):
    model, docs, labels = fitted
    some = docs.where(F.col("doc_id").isin([int(x) for x in model.ids[:20]])).select("text").collect()
    assert np.isin(toxicity._terms([r["text"] for r in some])[1], model.terms).all()


def test_fitting_holds_little_beside_the_model(spark):
    n, terms = 300, 4000
    model = toxicity.Model(np.arange(terms, dtype=np.uint64), np.ones(terms), np.arange(n), np.ones(n), np.arange(terms + 1) * n, np.tile(np.arange(n, dtype=np.int32), terms), np.ones(n * terms, np.float32), 0.5, np.array([0.0, 1.0]), np.array([0.5, 0.5]))
    tracemalloc.start()
    dense = model._readied().dense
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert dense.shape == (terms, n) and (dense == 1).all() and peak < 2 * dense.nbytes
    docs = spark.createDataFrame([(1, "good day"), (2, "bad day")], "doc_id long, text string")
    assert toxicity.fit(docs, spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")).ready is None


def test_unit_vectors_in_parts_are_those_of_all_rows_at_once():
    rng = np.random.default_rng(3)
    sizes = rng.integers(0, 6, 700)
    at = [np.sort(rng.choice(50, k, replace=False)).astype(np.int32) for k in sizes]
    counts = [rng.integers(1, 9, k).astype(np.int32) for k in sizes]
    rows = pa.table({"at": pa.array(at, pa.list_(pa.int32())), "n": pa.array(counts, pa.list_(pa.int32()))})
    weight = rng.random(50)
    want = toxicity.Rows.of(700, np.repeat(np.arange(700), sizes), np.concatenate(at), np.concatenate(counts).astype(np.int64), weight)
    for some in (rows, pa.concat_tables([rows[:333], rows[333:]])):
        got = toxicity._units(some, weight)
        assert all(np.array_equal(a, b) for a, b in zip((got.starts, got.terms, got.values), (want.starts, want.terms, want.values), strict=True))
