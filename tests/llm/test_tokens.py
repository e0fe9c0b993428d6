import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from ledgerlake.llm import packing, token_counts, token_files
from ledgerlake.llm.encoding import DEFAULT_VOCABULARY, Encoder

from cases import ODD

TEXTS = ["a  b", "  x", " x ", "a \n b", "a\n b", "x y  z", "it's 'll  we,ll. end.", "<|endoftext|> hi <|endoftext|>", " ", "", "naïve café, déjà.", "\U0001f600 ok", "a,b ,c .d e..", "٣ ٤٥", "tab\tin it"]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(DEFAULT_VOCABULARY)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library(plain):
    encode = Encoder()
    rng = random.Random(1)
    more = ["".join(rng.choice("ab ,.\n\té'1 ") for _ in range(rng.randint(0, 40))) for _ in range(400)]
    for texts in (TEXTS, more, TEXTS + more, [None]):
        assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == [plain(t) for t in texts]
    assert encode.markers == ["<|endoftext|>"] and plain("a <|endoftext|> b") == [64, 220, 50256, 275]
    encode.KEPT = 0
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(TEXTS)] == [plain(t) for t in TEXTS]


def test_markers_as_text():
    t = Tokenizer.from_file(DEFAULT_VOCABULARY)
    t.encode_special_tokens = True
    got = Encoder(markers_as_text=True)(TEXTS)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [t.encode(x, add_special_tokens=False).ids for x in TEXTS]


@pytest.mark.parametrize("planes", ["byte", "bit"])
@pytest.mark.parametrize("n", [1, 7, 1000])
def test_blocks_round_trip(planes, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    assert (token_files.decode_block(token_files.encode_block(ids, planes)) == ids).all()
    with pytest.raises(ValueError):
        token_files.decode_block(b"????" + token_files.encode_block(ids, planes)[4:])


def test_crc_combine():
    a, b = b"some bytes" * 9, b"and others" * 1001
    assert token_files.crc_combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert token_files.crc_combine(zlib.crc32(a), 0, 0) == zlib.crc32(a)


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_files_read_back_in_order(docs, plain, planes):
    rows = [(d, t) for d, t in ODD if d is not None and d not in (4, 8)] + [(100 + k, t) for k, t in enumerate(TEXTS)]
    random.Random(2).shuffle(rows)
    blocks = token_files.write_token_files(docs(rows), block_ids=50, planes=planes)
    want, at = [], 0
    for d, t in sorted(rows):
        ids = np.array([*plain(t), 0], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in token_files.read_token_files(blocks).collect()) == want


def test_odd_rows_keep_their_counts(docs, odd):
    got = token_files.read_token_files(token_files.write_token_files(odd)).collect()
    assert len(got) == len(ODD)
    assert sum(r["n_tokens"] for r in got) == max(r["start"] + r["n_tokens"] for r in got)
    assert token_files.read_token_files(token_files.write_token_files(docs([]))).count() == 0


def check_packing(rows, pieces, plain, capacity):
    used = {}
    by_doc = {}
    for p in pieces:
        used.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        by_doc.setdefault(p["doc_id"], []).append(p)
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    for d, t in rows:
        ids = np.array([*plain(t), 0], "<u4")
        mine = sorted(by_doc[d], key=lambda p: p["piece"])
        assert [p["piece"] for p in mine] == list(range(len(mine)))
        assert sum(p["length"] for p in mine) == len(ids) and all(p["length"] == capacity for p in mine[1:])
        for p in mine:
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())
    return len(used)


def test_packing(docs, plain):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(rng.choice((0, 3, 10, 40, 90))))) for k in range(300)]
    rows += [(1000 + k, t) for k, t in enumerate(TEXTS)] + [(2000, None)]
    pieces = packing.pack_documents(docs(rows), capacity=512).collect()
    n = check_packing(rows, pieces, plain, 512)
    total = sum(p["length"] for p in pieces)
    assert n <= -(-total // 512) * 1.02 + 2
    assert packing.pack_documents(docs([])).count() == 0
    kept = {(p["doc_id"], p["piece"]): p for p in packing.pack_documents(docs(rows), capacity=512, keep_ids=True).collect()}
    assert len(kept) == len(pieces)
    for d, t in rows:
        ids = np.array([*plain(t), 0], "<u4")
        for p in pieces:
            if p["doc_id"] == d:
                assert np.array_equal(np.frombuffer(kept[d, p["piece"]]["ids"], "<u4"), ids[p["start"] : p["start"] + p["length"]])


@pytest.mark.parametrize("seed", range(5))
def test_plan_places_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    capacity = 50
    counts = np.concatenate(([0], rng.integers(0, 1 + 10 ** (seed % 4), capacity)))
    plan = packing.Plan(counts, capacity)
    fill, seen = {}, {n: [] for n in range(1, capacity + 1)}
    for n, rank, times, sequence, offset in plan.intervals:
        seen[n] += range(rank, rank + times)
        for k in range(times):
            fill.setdefault(sequence + k, []).append((offset, n))
    assert all(sorted(seen[n]) == list(range(counts[n])) for n in seen)
    for spans in fill.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= capacity
    assert len(fill) == plan.sequences


def greedy(word, vocabulary):
    n, at = 0, 0
    while at < len(word):
        size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in vocabulary), 0)
        if not size:
            return None
        at, n = at + size, n + 1
    return n


def test_automaton_against_greedy_matching():
    rng = random.Random(4)
    for _ in range(60):
        vocabulary = {bytes(rng.choice(b"ab c") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 12))}
        m = token_counts.LongestMatch(vocabulary)
        for _ in range(60):
            word = bytes(rng.choice(b"ab c") for _ in range(rng.randint(0, 12)))
            want = greedy(word, vocabulary)
            assert m.count(word, unknown=-7) == (-7 if want is None else want), (vocabulary, word)


def test_token_counts(docs, odd):
    got = {(r["doc_id"], r["n_chars"]): r for r in token_counts.token_counts(odd).collect()}
    assert got[(2, 0)]["n_tokens"] == 0 and got[(3, 5)]["n_words"] == 0
    assert token_counts.token_counts(odd).count() == len(ODD) and token_counts.token_counts(docs([])).count() == 0
    m = token_counts.automaton()
    entries = set()
    import json

    to_byte = token_counts.byte_alphabet()
    with open(DEFAULT_VOCABULARY, encoding="utf-8") as f:
        entries = {bytes(to_byte[c] for c in e) for e in json.load(f)["model"]["vocab"] if all(c in to_byte for c in e)}
    for word in ("hello", "antidisestablishmentarianism", "naïve", "x9$%", "ингредиент"):
        assert m.count(b" " + word.encode()) == greedy(b" " + word.encode(), entries)


def test_token_counts_of_texts_are_the_sums_of_their_words(docs):
    import json

    to_byte = token_counts.byte_alphabet()
    with open(DEFAULT_VOCABULARY, encoding="utf-8") as f:
        entries = {bytes(to_byte[c] for c in e) for e in json.load(f)["model"]["vocab"] if all(c in to_byte for c in e)}
    rng = random.Random(7)
    stock = ["hello", "Donaudampfschiff", "x9$%", "naïve", "ингредиент", "a,b", "\U0001f600", "the", "zzzzqqq"]
    rows = [(k, "".join(rng.choice(stock) + rng.choice((" ", "  ", "\n", "\t ")) for _ in range(rng.randint(0, 30)))) for k in range(60)]
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs(rows)).collect()}
    assert got == {k: sum(greedy(b" " + w, entries) for w in t.encode().split()) for k, t in rows}


def test_triples_are_indexed():
    counts = np.zeros(51, np.int64)
    counts[[30, 3, 7, 10, 40]] = 2
    plan = packing.Plan(counts, 50)
    assert plan.sequences == 4 and sum(n * times for n, _, times, _, _ in plan.intervals) == 180
    there = (counts > 0).astype(int)
    fresh = packing.Plan(np.zeros(51, np.int64), 50)
    fresh.there, fresh.pairs = counts > 0, np.convolve(there, there)[:51]
    assert fresh.triples.astype(int).tolist() == [sum(a + b + c == s for a in np.flatnonzero(there) for b in np.flatnonzero(there) for c in np.flatnonzero(there)) for s in range(51)]
