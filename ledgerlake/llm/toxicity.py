"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

A term is a word, the beginning of a longer word (STEMS bytes), or such a beginning that at least two words of a text share;
insults come in many inflected and compound forms, most of which no example has. Words are runs of letters, digits and
underscores in lower case, found for many texts at once in a few array passes, and terms are known by 64-bit hashes.

What is bounded: the labelled examples (EXAMPLES of each label, those of the least hashes). What covers everything: the terms,
all that the examples have; the document frequencies, counted over all documents; and the scores. How well a term tells the
labels apart (phi, the root of chi-squared over the examples) is a factor of its weight and never leaves it out.

Postings of rarer terms are added up one by one. The common terms' postings lie in a dense table, cut into blocks of examples
with the largest weight of each term; a block whose bound lies below a query's k-th best similarity is skipped, so the k
nearest are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHasher, arrow_rows, bounded_batches, bounds, mix, table, task, trim, written

EXAMPLES, NEIGHBOURS, BLOCK = 1000, 15, 128
STEMS = range(3, 9)
#: Added to phi, so that terms which tell nothing still count where a text has no others.
LEAST_PHI = 1e-4
#: Examples that tell nothing, added to those of each term, and to each level of votes.
UNTOLD, LEVELLED = 8.0, 2.0
#: Terms in more than a COMMON-th of the examples are common, the DENSE most frequent at most.
COMMON, DENSE = 16, 4000
#: Texts, and characters, that are looked up together.
PART, PART_CHARS = 64, 1 << 18
THRESHOLD, HELD_OUT = 0.3, 2
_HASHER = WordHasher(29)
#: What keeps the terms of words, of beginnings and of shared beginnings apart.
_WORD, _STEM, _SHARED = (np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for k in (1, 2, 3))
_LETTER = np.array([b >= 0x80 or chr(b).isalnum() or b == 95 for b in range(256)])


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT


def _letters(raw: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 are in words: ASCII letters, digits and underscores, and all else past ASCII but Latin-1's and
    general punctuation."""
    inside = _LETTER[raw]
    if len(raw) > 2 and (raw >= 0x80).any():
        marks = np.flatnonzero((raw[:-2] == 0xE2) & (raw[1:-1] & 0xFE == 0x80))
        inside[(marks[:, None] + np.arange(3)).ravel()] = False
        marks = np.flatnonzero((raw[:-1] == 0xC2) & (raw[1:] < 0xC0))
        inside[(marks[:, None] + np.arange(2)).ravel()] = False
    return inside


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values, ascending; where one of each stands; each value's place among them)."""
    order = np.argsort(values)
    ranked = values[order]
    new = np.append(True, ranked[1:] != ranked[:-1])[: len(values)]
    place = np.empty(len(values), np.int64)
    place[order] = np.cumsum(new) - 1
    return ranked[new], order[new], place


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, ascending; how often each)."""
    keys = np.sort(keys)
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[at], np.diff(at, append=len(keys))


class Words:
    """The words of some texts: each (text, distinct word) with its count, and the distinct words' terms."""

    def __init__(self, texts: list[str | None]) -> None:
        data = [(t or "").lower().encode() for t in texts]
        raw = np.frombuffer(b"\n".join(data), np.uint8)
        begin, end = bounds(_letters(raw))
        total = _HASHER.sums(raw, begin)
        starts = np.cumsum([0, *(len(d) + 1 for d in data)])
        text = np.searchsorted(starts, begin, "right") - 1
        _, one, word = _distinct(_HASHER.mixed(total, begin, end))
        begin, end = begin[one], end[one]
        size = max(1, len(one))
        keys, self.times = _counted(text * size + word)
        self.text, self.word = keys // size, keys % size
        #: terms of the distinct words, and of their beginnings (0 where a word is no longer than that)
        self.terms = mix(_HASHER.mixed(total, begin, end) ^ _WORD)
        self.stems = np.zeros((len(STEMS), len(one)), np.uint64)
        for row, n in zip(self.stems, STEMS, strict=True):
            longer = np.flatnonzero(end - begin > n)
            row[longer] = mix(total[begin[longer] + n] - total[begin[longer]] ^ _STEM)


def _terms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count) of all terms of some texts, by text."""
    words = Words(texts)
    known, _, place = _distinct(np.concatenate((words.terms, words.stems.ravel())))
    size = max(1, len(known))
    places = place.reshape(1 + len(STEMS), -1)
    there = words.stems[:, words.word] > 0
    keys = (words.text * size + places[1:, words.word])[there]
    shared, n = _counted(keys)
    several = n > 1
    text = np.concatenate((words.text, shared // size, shared[several] // size))
    stems = known[shared % size]
    term = np.concatenate((words.terms[words.word], stems, mix(stems[several] ^ _SHARED)))
    order = np.argsort(text, kind="stable")
    return text[order], term[order], np.concatenate((words.times, n, n[several]))[order]


class _Lookup:
    """Places of texts' terms among the indexed ones, which are ascending."""

    def __init__(self, terms: np.ndarray) -> None:
        self.terms = terms
        #: for each stem, the term for several words that share it
        self.again = self.places(mix(terms ^ _SHARED))

    def places(self, terms: np.ndarray) -> np.ndarray:
        """Where each of terms is, -1 for those not indexed."""
        if not len(self.terms):
            return np.full(terms.shape, -1, np.int64)
        asked, _, place = _distinct(terms.ravel())  # ascending, so that the search walks through memory
        at = np.minimum(np.searchsorted(self.terms, asked), len(self.terms) - 1)
        return np.where(self.terms[at] == asked, at, -1)[place].reshape(terms.shape)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place, count) of the indexed terms, by text and place."""
        words = Words(texts)
        size = max(1, len(self.terms))
        own = self.places(words.terms)[words.word]
        stems = self.places(words.stems)[:, words.word]
        shared, n = _counted((words.text * size + stems)[stems >= 0])
        again = self.again[shared % size] if len(shared) else shared
        several = (n > 1) & (again >= 0)
        keys = np.concatenate(((words.text * size + own)[own >= 0], shared, (shared // size * size + again)[several]))
        counts = np.concatenate((words.times[own >= 0], n, n[several]))
        order = np.argsort(keys)
        return keys[order] // size, keys[order] % size, counts[order]


def _parts(texts: list[str | None]) -> Iterator[list[str | None]]:
    """texts in order, PART of them and PART_CHARS characters at a time (or one longer text)."""
    part: list[str | None] = []
    size = 0
    for t in texts:
        n = len(t or "")
        if part and (len(part) == PART or size + n > PART_CHARS):
            yield part
            part, size = [], 0
        part.append(t)
        size += n
    if part:
        yield part


@dataclass
class Rows:
    """Sparse vectors over the terms, one after the other: those of row r lie from starts[r] to starts[r + 1]."""

    starts: np.ndarray
    terms: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, n: int, row: np.ndarray, terms: np.ndarray, counts: np.ndarray, weight: np.ndarray) -> Rows:
        """Unit TF-IDF vectors of n rows, given by row."""
        values = (1 + np.log(counts)) * weight[terms]
        norm = np.sqrt(np.bincount(row, values * values, n))
        return cls(np.searchsorted(row, np.arange(n + 1)), terms, (values / np.where(norm > 0, norm, 1)[row]).astype(np.float32))

    def __len__(self) -> int:
        return len(self.starts) - 1

    def __matmul__(self, dense: np.ndarray) -> np.ndarray:
        pairs = [(self.terms[a:b], self.values[a:b]) for a, b in zip(self.starts[:-1], self.starts[1:], strict=True)]
        return np.stack([v @ dense[t] for t, v in pairs]) if pairs else np.zeros((0, dense.shape[1]), np.float32)

    def some(self, begin: int, end: int) -> Rows:
        a, b = self.starts[begin], self.starts[end]
        return Rows(self.starts[begin : end + 1] - a, self.terms[a:b], self.values[a:b])

    def taken(self, order: np.ndarray) -> Rows:
        sizes = np.diff(self.starts)[order]
        at = _ranges(self.starts[:-1][order], sizes)
        return Rows(np.append(0, np.cumsum(sizes)), self.terms[at], self.values[at])

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.starts))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... sizes[0] numbers; then those from starts[1]; and so on."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


@dataclass
class _Ready:
    """What a worker makes of a model once: the look-up and the dense table of common terms, with its bounds."""

    lookup: _Lookup
    #: each term's row in the dense table, -1 for rare ones
    common: np.ndarray
    dense: np.ndarray
    bounds: np.ndarray


@dataclass
class Model:
    """A fitted index and its calibration; its size is that of the bounded examples, whatever the corpus."""

    #: the indexed terms, ascending
    terms: np.ndarray
    weight: np.ndarray
    ids: np.ndarray
    toxic: np.ndarray
    #: postings by term: those of term t lie from starts[t] to starts[t + 1]
    starts: np.ndarray
    examples: np.ndarray
    values: np.ndarray
    prior: float
    votes: np.ndarray
    rates: np.ndarray
    ready: _Ready | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"ready": None}

    @property
    def blocks(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each block of examples: its terms, their postings as weights (terms x examples)."""
        out, term = [], np.repeat(np.arange(len(self.terms)), np.diff(self.starts))
        for begin in range(0, len(self.ids), BLOCK):
            end = min(begin + BLOCK, len(self.ids))
            here = (self.examples >= begin) & (self.examples < end)
            there, row = np.unique(term[here], return_inverse=True)
            postings = np.zeros((len(there), end - begin), np.float32)
            postings[row, self.examples[here] - begin] = self.values[here]
            out.append((there, postings))
        return out

    def _readied(self) -> _Ready:
        if self.ready is None:
            n, sizes = len(self.ids), np.diff(self.starts)
            often = np.argsort(-sizes, kind="stable")[:DENSE]
            often = np.sort(often[sizes[often] * COMMON > n])
            common = np.full(len(self.terms), -1, np.int64)
            common[often] = np.arange(len(often))
            dense = np.zeros((len(often), n), np.float32)
            for k in range(0, len(often), BLOCK):
                some = often[k : k + BLOCK]
                at = _ranges(self.starts[:-1][some], sizes[some])
                dense[np.repeat(np.arange(k, k + len(some)), sizes[some]), self.examples[at]] = self.values[at]
            cuts = np.arange(0, n, BLOCK)
            self.ready = _Ready(_Lookup(self.terms), common, dense, np.maximum.reduceat(dense, cuts, 1) if n else np.zeros((len(often), 0), np.float32))
        return self.ready

    def weights(self, texts: list[str | None]) -> Rows:
        """Unit TF-IDF vectors over the index's terms; zero where a text has none of them."""
        return Rows.of(len(texts), *self._readied().lookup(texts), self.weight)

    def nearest(self, queries: Rows, k: int = NEIGHBOURS, leave_out: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(positions, similarities) of each query's k nearest examples, best first; -1 where fewer have a term in common.

        leave_out: for each query, the position of an example that must not be found.
        """
        parts = [self._nearest(queries.some(b, min(b + PART, len(queries))), k, None if leave_out is None else leave_out[b : b + PART]) for b in range(0, len(queries), PART)]
        if not parts:
            return np.zeros((0, k), np.int64), np.zeros((0, k), np.float32)
        return np.concatenate([w for w, _ in parts]), np.concatenate([s for _, s in parts])

    def _nearest(self, queries: Rows, k: int, leave_out: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Blocks are taken in the order of the bounds' sum; a query takes part in a block only while its bound there reaches
        its k-th best."""
        n, size, ready = len(queries), len(self.ids), self._readied()
        best, where = np.zeros((n, k), np.float32), np.full((n, k), -1, np.int64)
        if not size or not len(queries.terms):
            return where, best
        row, column = queries.row, ready.common[queries.terms]
        often, seldom = column >= 0, column < 0
        table = np.zeros((n, len(ready.dense)), np.float32)
        table[row[often], column[often]] = queries.values[often]
        begins = self.starts[queries.terms[seldom]]
        sizes = self.starts[queries.terms[seldom] + 1] - begins
        at = _ranges(begins, sizes)
        rare = np.bincount(np.repeat(row[seldom] * size, sizes) + self.examples[at], np.repeat(queries.values[seldom], sizes) * self.values[at], n * size)
        rare = rare.astype(np.float32).reshape(n, size)
        bounds = table @ ready.bounds + np.maximum.reduceat(rare, np.arange(0, size, BLOCK), 1)
        for b in np.argsort(-bounds.sum(0), kind="stable").tolist():
            active = np.flatnonzero((bounds[:, b] > 0) & (bounds[:, b] + 1e-6 >= best[:, -1]))
            if not len(active):
                continue
            here = slice(b * BLOCK, min((b + 1) * BLOCK, size))
            some = table[active] @ ready.dense[:, here] + rare[active, here]
            positions = np.arange(here.start, here.stop)
            if leave_out is not None:
                some[positions[None, :] == leave_out[active][:, None]] = 0
            both = np.concatenate((best[active], some), 1)
            names = np.concatenate((where[active], np.broadcast_to(positions, some.shape)), 1)
            top = np.argsort(-both, 1, kind="stable")[:, :k] if both.shape[1] <= 4 * k else _top(both, k)
            best[active] = np.take_along_axis(both, top, 1)
            where[active] = np.take_along_axis(names, top, 1)
        where[best <= 0] = -1
        return where, best

    def vote(self, where: np.ndarray, near: np.ndarray) -> np.ndarray:
        """The part of the weight of the neighbours, by the inverse of their distance, that is toxic; the prior without any."""
        w = np.where(where >= 0, near / (1.05 - near), 0)
        total = w.sum(1)
        if not len(self.toxic):
            return np.full(len(w), self.prior)
        return np.where(total > 0, (w * self.toxic[where]).sum(1) / np.maximum(total, 1e-9), self.prior)

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated scores, and the neighbours' positions and similarities."""
        parts = [self.nearest(self.weights(part)) for part in _parts(texts)] or [self.nearest(self.weights([]))]
        where, near = np.concatenate([w for w, _ in parts]), np.concatenate([s for _, s in parts])
        vote = self.vote(where, near)
        found = (where >= 0).any(1)
        score = np.where(found, np.interp(vote, self.votes, self.rates), self.prior)
        return np.clip(score, 0, 1), where, near


def _top(values: np.ndarray, k: int) -> np.ndarray:
    part = np.argpartition(-values, k - 1, 1)[:, :k]
    order = np.argsort(-np.take_along_axis(values, part, 1), 1, kind="stable")
    return np.take_along_axis(part, order, 1)


def _monotone(x: np.ndarray, y: np.ndarray, weight: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of y on x: the means of pooled neighbours, at their mean x, drawn to the prior by LEVELLED examples."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for xi, yi, wi in zip(x[order].tolist(), y[order].tolist(), weight[order].tolist(), strict=True):
        pools.append([xi * wi, yi * wi, wi])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    drawn = np.array([(p[1] + LEVELLED * prior) / (p[2] + LEVELLED) for p in pools])
    return np.array([p[0] / p[2] for p in pools]), np.maximum.accumulate(drawn)


def _examples(docs: DataFrame, labels: DataFrame, learn: Column, limit: int) -> tuple[DataFrame, dict[int, int]]:
    """At most limit learnable rows (doc_id, toxic, text) of either label, by the least hashes, written; each label's rows in all.

    Of rows with one doc_id the least text counts; a doc_id labelled both ways is toxic.
    """
    known = labels.where(learn & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {int(r["toxic"]): r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    picks = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit) for y in (0, 1)]
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picks[0].unionByName(picks[1])), "doc_id")
    return written(found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "examples"), sizes


def _term_counts(picked: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms, ascending; toxic examples that have each; others)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, term, _ = _terms(b.column("text").to_pylist())
            toxic = b.column("toxic").to_numpy()[text]
            known, _, place = _distinct(term)
            counts = [pa.array(np.bincount(place, toxic == y, len(known)).astype(np.int64)) for y in (1, 0)]
            yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), *counts], ["term", "a", "b"])

    counted = picked.select("toxic", "text").mapInArrow(task(run), "term long, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toArrow()
    term = counted.column("term").to_numpy().view(np.uint64)
    order = np.argsort(term)
    return term[order], *(counted.column(x).to_numpy()[order].astype(np.float64) for x in ("a", "b"))


def _frequencies(docs: DataFrame, look: _Lookup) -> np.ndarray:
    """In how many of all documents each indexed term is; the number of documents comes last."""
    size = len(look.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            for part in _parts(batch.column("text").to_pylist()):
                seen += np.bincount(look(part)[1], minlength=size + 1)
                seen[-1] += len(part)
        there = np.flatnonzero(seen)
        for k in range(0, len(there), 50_000):
            some = there[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], ["term", "n"])

    got = docs.select("text").mapInArrow(task(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size + 1)
    out[got.column("term").to_numpy()] = got.column("n").to_numpy()
    return out


def _units(rows: pa.Table, weight: np.ndarray) -> Rows:
    """Unit vectors of rows (at, n: terms and counts), BLOCK rows at a time, as the driver holds them beside Spark's heap."""
    sizes, terms, values = [np.zeros(1, np.int64)], [], []
    for b in rows.select(["at", "n"]).to_batches(max_chunksize=BLOCK):
        sizes.append(b.column("at").value_lengths().to_numpy().astype(np.int64))
        at, n = (b.column(x).flatten().to_numpy() for x in ("at", "n"))
        terms.append(at)
        values.append(Rows.of(b.num_rows, np.repeat(np.arange(b.num_rows), sizes[-1]), at, n.astype(np.int64), weight).values)
    return Rows(np.cumsum(np.concatenate(sizes)), np.concatenate(terms), np.concatenate(values))


def _vectors(picked: DataFrame, look: _Lookup, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, Rows]:
    """(ids, labels, unit vectors) of the examples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, at, n = look(b.column("text").to_pylist())
            starts = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(starts, pa.array(x.astype(np.int32))) for x in (at, n)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), *lists], ["doc_id", "toxic", "at", "n"])

    rows = picked.select("doc_id", "toxic", "text").mapInArrow(task(run), "doc_id long, toxic int, at array<int>, n array<int>").toArrow()
    ids, toxic = rows.column("doc_id").to_numpy(), rows.column("toxic").to_numpy().astype(np.float64)
    if not len(ids):
        return ids, toxic, Rows(np.zeros(1, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))
    unit = _units(rows, weight)
    del rows
    # examples of one leading term lie together, so that a block's bounds are high for few terms
    leading = [unit.terms[a + unit.values[a:b].argmax()] if b > a else -1 for a, b in zip(unit.starts[:-1], unit.starts[1:], strict=True)]
    order = np.lexsort((ids, leading, toxic))
    return ids[order], toxic[order], unit.taken(order)


def _phi(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """How well terms tell the labels apart, that a of n1 and b of n0 examples have; UNTOLD more that tell nothing are added
    to each term's examples, so that one which only a few examples have does not weigh more than it can show."""
    n, seen = n1 + n0, a + b
    off = np.abs(a - seen * n1 / n)
    spread = (seen + UNTOLD) * np.maximum(n - seen, 1) / n * (n1 / n) * (n0 / n)
    return off / np.sqrt(spread * n)


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, examples: int = EXAMPLES) -> Model:
    """Fit a model on labelled rows (doc_id, toxic) of docs (doc_id, text) for which learn holds.

    The driver gets the terms of the examples with their frequencies, and each example's counts, as Arrow tables.
    Null labels, labels other than 0 and 1 and those of unknown documents are passed over. Without examples of both labels,
    every score is the prior (0 with no label at all). The votes are calibrated on the examples, each left out in its turn.
    """
    bounded_batches(docs.sparkSession)
    picked, sizes = _examples(docs, labels, F.lit(True) if learn is None else learn, examples)
    total = sum(sizes.values())
    prior = sizes.get(1, 0) / total if total else 0.0
    terms, a, b = _term_counts(picked) if len(sizes) == 2 else (np.empty(0, np.uint64), np.empty(0), np.empty(0))
    look, weight = _Lookup(terms), np.zeros(len(terms))
    ids, toxic, unit = np.empty(0, np.int64), np.empty(0), Rows(np.zeros(1, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))
    if len(terms):
        n1, n0 = min(examples, sizes[1]), min(examples, sizes[0])
        phi = _phi(a, b, n1, n0)
        seen = _frequencies(docs, look)
        weight = (np.log((1 + seen[-1]) / (1 + seen[:-1])) + 0.01) * (phi + LEAST_PHI)
        ids, toxic, unit = _vectors(picked, look, weight)
    by_term = np.argsort(unit.terms, kind="stable")
    starts = np.append(0, np.cumsum(np.bincount(unit.terms, minlength=len(terms))))
    model = Model(terms, weight, ids, toxic, starts, unit.row.astype(np.int32)[by_term], unit.values[by_term], prior, np.array([0.0, 1.0]), np.array([prior, prior]))
    del by_term
    if len(ids):
        where, near = model.nearest(unit, leave_out=np.arange(len(ids)))
        vote = model.vote(where, near)
        share = np.where(toxic > 0, prior / max(toxic.mean(), 1e-9), (1 - prior) / max(1 - toxic.mean(), 1e-9))
        votes, rates = _monotone(vote, toxic, share, prior)
        # a little of the vote itself keeps the order within pools
        model.votes = np.concatenate(([-1e-9], votes, [1 + 1e-9]))
        model.rates = 0.98 * np.concatenate((rates[:1], rates, rates[-1:])) + 0.02 * np.clip(model.votes, 0, 1)
    model.ready = None  # the driver scores nothing more; workers make their own
    del look, unit
    trim()
    return model


SCORED = pa.schema(
    [("doc_id", pa.int64()), ("score", pa.float64()), ("evidence", pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())])))]
)
SCORED_SQL = "doc_id long, score double, evidence array<struct<doc_id:long,similarity:double,toxic:int>>"


def score(docs: DataFrame, model: Model, evidence: int = 3) -> DataFrame:
    """(doc_id, score, evidence) of each row of docs (doc_id, text); one narrow pass.

    evidence: the nearest examples with their similarity and label. A text without any indexed term, so an empty or null
    one too, gets the prior (the share of toxic rows among all learnable labels) and no evidence. Equal texts get equal scores.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores, where, near = model.score(b.column("text").to_pylist())
            shown = [[{"doc_id": int(model.ids[p]), "similarity": float(s), "toxic": int(model.toxic[p])} for p, s in zip(ps, ss, strict=True) if p >= 0] for ps, ss in zip(where[:, :evidence], near[:, :evidence], strict=True)]
            yield arrow_rows(SCORED, list(zip(b.column("doc_id").to_pylist(), scores.tolist(), shown, strict=True)))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task(run), SCORED_SQL)


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose score is below threshold; one narrow pass."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.score(b.column("text").to_pylist())[0] < threshold))

    return docs.mapInArrow(task(run), docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document; labels of held-out rows are never read for it."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
