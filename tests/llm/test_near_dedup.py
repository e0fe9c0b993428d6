import random

import numpy as np
import pytest

from ledgerlake.llm import near_dedup as nd
from ledgerlake.llm.components import components

from cases import ODD

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = (text or "").translate(LOWER).encode().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None:
                continue
            both = len(sets[i] & sets[j])
            same_id = rows[i][0] == rows[j][0]
            if same_id or (both and 100 * both >= 75 * len(sets[i] | sets[j])):
                root[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[top(k)] = min(least.get(top(k), d), d)
    return sorted(((d, len(sets[k]), None if d is None else least[top(k)], d is None or least[top(k)] == d) for k, (d, _) in enumerate(rows)), key=str)


def got(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()), key=str)


def corpus(seed, groups=12, most=9):
    """Groups of copies with single words changed, so similarities lie on both sides of 0.75."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(4000)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.randint(30, 160))]
        for _ in range(rng.randint(1, most)):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            if rng.random() < 0.3:
                copy = [w.upper() for w in copy]
            rows.append((len(rows) * 7 % 1009, " ".join(copy)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(docs, seed):
    rows = corpus(seed)
    assert got(nd.near_duplicates(docs(rows))) == brute(rows)


def test_widespread_passages_and_repeated_ids(docs):
    """A passage that most documents share, at every part of their length, and rows of one id with different texts."""
    rng = random.Random(4)
    words = [f"w{k}" for k in range(4000)]
    passage = [rng.choice(words) for _ in range(60)]
    rows = [(k, " ".join([*passage, *(rng.choice(words) for _ in range(rng.choice((3, 8, 15, 20, 30, 60, 200))))])) for k in range(120)]
    rows += [(k, " ".join([*passage[: 30 + k % 30], "end"])) for k in range(200, 230)]
    rows += [(3, rows[50][1]), (3, " ".join(words[:40])), (500, " ".join(words[:41])), (60, None), (61, ""), (3, None)]
    assert got(nd.near_duplicates(docs(rows))) == brute(rows)
    kept = {d for d, _, _, keep in brute(rows) if keep}
    assert {r["doc_id"] for r in nd.without_near_duplicates(docs(rows)).collect()} == kept


def test_what_nodes_keep_meets_wherever_enough_coordinates_agree(spark):
    rng = np.random.default_rng(3)
    signatures = rng.integers(0, 6, (60, nd.COORDINATES), dtype=np.uint32)
    for k in range(0, 60, 3):  # pairs that agree in just the threshold, one more and one less
        some = rng.permutation(nd.COORDINATES)[: nd.THRESHOLD + k % 3 - 1]
        signatures[k + 1, some] = signatures[k, some]
    nodes = spark.createDataFrame([(k, s.tobytes()) for k, s in enumerate(signatures)], "node long, signature binary")
    lists = {}
    for r in nd._merged(nd._posted(nodes)).collect():
        lists.setdefault(r["key"], set()).add(r["node"])
    for a in range(60):
        for b in range(a):
            if (signatures[a] == signatures[b]).sum() >= nd.THRESHOLD:
                assert any({a, b} <= some for some in lists.values())


def test_a_lower_similarity_is_refused(docs):
    with pytest.raises(ValueError):
        nd.near_duplicates(docs([]), 74)


@pytest.mark.parametrize("texts", [("a" * 9, "b"), ("x y z", "x y"), (" ".join("abcd"), " ".join("abc"))])
def test_sets_of_patterned_words(texts):
    """Words that a polynomial hash cannot tell apart make different sets."""
    one = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    x, y = (nd.shingle_sets([f"{texts[0]} {w} {texts[1]} c d e f"])[0] for w in (one, other))
    assert len(np.intersect1d(x, y)) < len(x)


def test_odd_rows_and_empty_table(docs, odd):
    assert got(nd.near_duplicates(odd)) == brute(ODD)
    assert nd.near_duplicates(docs([])).count() == 0
    assert nd.without_near_duplicates(odd).columns == odd.columns


def test_small_parts_and_blocks_lose_nothing(docs, monkeypatch):
    monkeypatch.setattr(nd, "PART", 300)
    monkeypatch.setattr(nd, "OTHERS", 200)
    rows = corpus(9, groups=3, most=40)
    assert got(nd.near_duplicates(docs(rows))) == brute(rows)


def test_components_of_a_path_a_star_and_loops(spark):
    path = [(k + 1, k) for k in range(100, 160)]
    edges = spark.createDataFrame([*path, *((500 + k, 500) for k in range(40)), (7, 7), (500, 501)], "u long, v long")
    found = {r["node"]: r["component"] for r in components(edges).collect()}
    assert found == {**{k: 100 for k in range(100, 161)}, **{500 + k: 500 for k in range(40)}}
    assert components(edges.where("false")).count() == 0
