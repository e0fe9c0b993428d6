import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import substring_dedup as sd
from ledgerlake.llm.common import WordHasher

from cases import ODD


def brute(rows, width=20, seen=()):
    """kept texts by doc position; windows judged on the input."""
    first, out = {w: None for w in seen}, []
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    for k in order:
        words = (rows[k][1] or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - width + 1):
            w = tuple(words[s : s + width])
            if w in first:
                gone[s : s + width] = [True] * width
            else:
                first[w] = (k, s)
        out.append((rows[k][0], len(words), sum(gone), b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()))
    return sorted(out, key=str), first


def got(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in df.collect()), key=str)


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(30)]
    shared = [" ".join(rng.choice(words) for _ in range(rng.randint(18, 60))) for _ in range(5)]
    rows = []
    for d in range(n):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 50)))]
        for _ in range(rng.randint(0, 3)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(shared))
        rows.append((d, rng.choice((" ", "\n", "  ")).join(parts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(docs, seed):
    rows = corpus(seed)
    assert got(sd.remove_repeats(docs(rows), block_chars=2000, buckets=7)) == brute(rows)[0]


def test_odd_rows_and_empty_table(docs, odd):
    assert got(sd.remove_repeats(odd)) == brute(ODD)[0]
    assert sd.remove_repeats(docs([])).count() == 0


def test_spans_are_what_is_removed(docs):
    text = " ".join(f"x{k}" for k in range(30))
    rows = [(1, f"a {text} b"), (2, f"c d {text}")]
    spans = {r["doc_id"]: [(s["begin"], s["end"]) for s in r["removed"]] for r in sd.remove_repeats(docs(rows)).collect()}
    assert spans == {1: [], 2: [(2, 32)]}


def test_batches_against_an_index_equal_one_pass(docs):
    rows = corpus(5)
    early, late = rows[:25], rows[25:]
    index = sd.fingerprints(docs(early), buckets=5, block_chars=2000).cache()
    grown = sd.compact(index.unionByName(sd.fingerprints(docs(late), buckets=5, block_chars=2000)))
    want, _ = brute(rows)
    parts = got(sd.remove_repeats(docs(early), buckets=5, block_chars=2000)) + got(sd.remove_repeats(docs(late), index, buckets=5, block_chars=2000))
    assert sorted(parts, key=str) == want
    again = sd.remove_repeats(docs(late), grown, buckets=5, block_chars=2000)
    assert got(again) == brute(late, seen=brute(rows)[1])[0]
    sizes = lambda df: df.agg(F.sum(F.length("keys"))).first()[0]
    assert sizes(sd.compact(grown.unionByName(grown))) == sizes(grown)


def test_hashes_do_not_depend_on_how_texts_are_cut():
    h = WordHasher(3)
    words = [b"a", b"bb", b"c" * 300_000, b"d", "é".encode()] * 3
    joined, begins = h.texts([b" ".join(words), b"", b"\n".join(words)])
    each = np.concatenate([h.words(w) for w in words])
    assert list(begins) == [0, len(words), len(words), 2 * len(words)]
    assert (joined == np.concatenate([each, each])).all()
