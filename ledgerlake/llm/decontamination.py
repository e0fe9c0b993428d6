"""Benchmark decontamination by template canonicalisation.

A word is stripped of punctuation; words with digits and number words become <number>, a unit after a number <unit>, a
capitalised word <name>, others their lower case; what is punctuation alone is left out. Runs of WIDTH such template words
of the benchmark are hashed and joined with those of every document, so a question whose numbers, names or units were
changed still meets its template. Slots then have to agree: within an item, one value stands for one value throughout, and
the other way round. A document holds an item where windows with agreeing slots cover COVERED of the item's words.

The join is one of tables, so a benchmark may be of any size: a pass over the documents keeps the hashes that a sieve of the
benchmark's lets through (PROBES bits of SIEVE_BITS at most; what it lets through wrongly, the join drops), these are joined
with the benchmark's windows, and pairs of a document and an item whose windows could cover enough are compared in full.

Words may be put in or left out: stretches of windows are chained over increasing places, and runs of numbers or of names
also count as one, so that one name may stand for two. Windows of items under 3 * WIDTH words are a third of the item, SHORTEST
words at least, and have to cover WIDTH words (the item, if it has fewer) together. Case doesn't decide: a third reading takes capitalised words as
literals. Items of fewer than SHORTEST template words are held where all their words follow each other unchanged.
"""

from __future__ import annotations

import string
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHasher, arrow_rows, bounded_batches, keeps, mix, table, task, written

WIDTH, SHORTEST, COVERED, AGREEING = 8, 4, 0.5, 0.8
#: Bits of the sieve for each benchmark window, the logarithms of the least and the largest sieve, its probes, and of a part of it.
SIEVE_PER, SIEVE_BITS, PROBES, CHUNK_BITS = 32, (18, 28), 8, 18
KEPT = 300_000
#: Characters of the texts that are read together.
TOGETHER = 1 << 16

#: Words read as numbers, and as units after a number.
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty "
    "thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half".split()
)
UNIT_WORDS = frozenset(
    "m km cm mm mi ft in yd kg g mg lb oz l ml s sec min h hr hz khz mhz w kw v a j n pa c f k mph kph percent dollars dollar euros euro cents cent "
    "pounds pound meters meter metres metre kilometers kilometer miles mile feet foot inches inch grams gram kilograms kilogram liters liter litres "
    "litre seconds second minutes minute hours hour days day weeks week months month years year degrees degree".split()
)
LITERAL, NUMBER, NAME, UNIT = range(4)
_EDGES = string.punctuation + "“”‘’«»…–—¿¡·•"


def _code(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode()) & ~7 | 4


_SLOTS = {NUMBER: _code("<number>"), NAME: _code("<name>"), UNIT: _code("<unit>")}


def canonical(word: str) -> int:
    """A word's template in 64 bits, its kind in the lowest two; 0 for punctuation alone."""
    core = word.strip(_EDGES)
    if not core:
        return 0
    low = core.lower()
    if any(c.isdigit() for c in core) or low in NUMBER_WORDS:
        return _SLOTS[NUMBER] | NUMBER
    if low in UNIT_WORDS:
        return _code(low) | UNIT
    if core[0].isupper():
        return _SLOTS[NAME] | NAME
    return _code(low)


class _Templates(dict):
    """Templates of words met before: the first, frequent ones are kept."""

    def __missing__(self, word: str) -> int:
        code = canonical(word)
        if len(self) < KEPT and len(word) <= 64:
            self[word] = code
        return code


_templates = _Templates()


class _Folded(dict):
    """Templates of capitalised words as if they were not: the first, frequent ones are kept."""

    def __missing__(self, word: str) -> int:
        code = _code(_value(word))
        if len(self) < KEPT and len(word) <= 64:
            self[word] = code
        return code


_folded = _Folded()


def _drop() -> None:
    _templates.clear()
    _folded.clear()


keeps("templates", _drop)

#: Readings of a text: word by word; runs of numbers and of names as one each; the same with capitalised words as literals;
#: word by word with capitalised words as literals, for items too short for a template.
WORDS, RUNS, FOLDED, WHOLE = range(4)


class Template:
    """The template words of some texts, one text after the other, without punctuation words."""

    def __init__(self, texts: list[str | None]) -> None:
        words: list[str] = []
        starts = [0]
        for text in texts:
            words += (text or "").split()
            starts.append(len(words))
        codes, bounds = np.fromiter(map(_templates.__getitem__, words), np.uint64, len(words)), np.array(starts)
        if len(codes) and not codes.all():
            there = np.flatnonzero(codes)
            words, codes, bounds = [words[k] for k in there.tolist()], codes[there], np.searchsorted(there, bounds)
        kinds = (codes & np.uint64(3)).astype(np.int8)
        first = np.zeros(len(words) + 1, bool)
        first[bounds] = True
        units = np.flatnonzero(kinds == UNIT)
        if len(units):
            after = units[(units > 0) & (kinds[units - 1] == NUMBER) & ~first[units]]
            codes[after] = _SLOTS[UNIT] | UNIT
            kinds[np.setdiff1d(units, after)] = LITERAL
        self.words, self.codes, self.kinds = words, codes, kinds
        #: where each text's words begin, one more at the end, and whether a word is the first of its text
        self.bounds, self.first = bounds, first[:-1]

    def reading(self, how: int) -> tuple[np.ndarray, np.ndarray]:
        """(codes, where each begins and, one more, where the last ends)."""
        codes, slots = self.codes, (NUMBER, NAME)
        if how in (FOLDED, WHOLE):
            names = np.flatnonzero(self.kinds == NAME)
            codes, slots = codes.copy(), (NUMBER,)
            codes[names] = np.fromiter(map(_folded.__getitem__, map(self.words.__getitem__, names.tolist())), np.uint64, len(names))
        begin = np.arange(len(codes))
        if how in (RUNS, FOLDED) and len(codes):
            new = np.ones(len(codes), bool)
            new[1:] = (self.kinds[1:] != self.kinds[:-1]) | ~np.isin(self.kinds[1:], slots) | self.first[1:]
            begin = np.flatnonzero(new)
        return codes[begin], np.append(begin, len(codes))


def template(text: str | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(words, codes, kinds) of a text, without punctuation words."""
    t = Template([text])
    return t.words, t.codes, t.kinds


def _value(word: str) -> str:
    return word.strip(_EDGES).lower()


_HASHER = WordHasher(41)
_FACTORS = _HASHER.factors(WIDTH)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)

#: A template word of an item and the one of a document that stands for it: first and past the last word there, and here.
Pair = tuple[int, int, int, int]


def window_keys(codes: np.ndarray, how: int, widths: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(width, keys of all windows of that width), the narrower first; a wider window's sum goes on from a narrower one's."""
    wanted, sums = set(widths), np.zeros(len(codes), np.uint64)
    for k in range(min(max(wanted), len(codes))):
        sums = sums[: len(codes) - k]
        sums += codes[k:] * _FACTORS[k]
        if k + 1 in wanted:
            yield k + 1, sums + mix(np.array([how * 64 + k + 1], np.uint64))


class Sieve:
    """Which keys may be among some: no key of theirs is ever held back."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits, self.shift = bits, np.uint64(64 - (len(bits) * 8).bit_length() + 1)

    @staticmethod
    def places(keys: np.ndarray, probe: int, shift: np.uint64) -> np.ndarray:
        return ((mix(keys + np.uint64(probe)) if probe else keys) * _GOLDEN >> shift).astype(np.int64)

    def passing(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys that pass; the later probes see what the first left."""
        at: np.ndarray | None = None
        for probe in range(PROBES):
            place = self.places(keys if at is None else keys[at], probe, self.shift)
            there = np.flatnonzero(self.bits[place >> 3] >> (place & 7).astype(np.uint8) & 1)
            at = there if at is None else at[there]
        return at


@dataclass
class Windows:
    """Item windows of one reading and width: sorted keys, their items, first words and words."""

    keys: np.ndarray
    items: np.ndarray
    places: np.ndarray
    words: np.ndarray

    @classmethod
    def of(cls, parts: list[tuple[np.ndarray, np.ndarray, int]], width: int) -> Windows:
        keys = np.concatenate([h for h, _, _ in parts])
        order = np.argsort(keys, kind="stable")
        items = np.concatenate([np.full(len(h), k, np.int32) for h, _, k in parts])
        places = np.concatenate([np.arange(len(h), dtype=np.int32) for h, _, _ in parts])
        words = np.concatenate([(ends[width:] - ends[:-width]).astype(np.int32) for _, ends, _ in parts])
        return cls(keys[order], items[order], places[order], words[order])

    def met(self, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in mine, positions here) of equal keys, all with all."""
        begin, end = np.searchsorted(self.keys, mine, "left"), np.searchsorted(self.keys, mine, "right")
        at = np.flatnonzero(end > begin)
        begin, n = begin[at], (end - begin)[at]
        return np.repeat(at, n), np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())


Held = tuple[int, int, int, bool, int, int]


@dataclass
class Items:
    """Some benchmark items, indexed by their template windows."""

    ids: list[int]
    values: list[list[str]]
    kinds: list[np.ndarray]
    #: for each reading and item, where its template words begin and the last ends
    ends: list[dict[int, np.ndarray]]
    index: dict[tuple[int, int], Windows] = field(default_factory=dict)

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> Items:
        found: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray, int]]] = defaultdict(list)
        out = cls([], [], [], [])
        for item_id, text in rows:
            t = Template([text])
            if not t.words:
                continue
            ends = {}
            for how in (WORDS, RUNS, FOLDED) if len(t.words) >= SHORTEST else (WHOLE,):
                codes, begin = t.reading(how)
                if how == WHOLE or len(codes) >= SHORTEST:
                    width = len(codes) if how == WHOLE else min(WIDTH, max(SHORTEST, len(codes) // 3))
                    found[how, width] += [(keys, begin, len(out.ids)) for _, keys in window_keys(codes, how, [width])]
                    ends[how] = begin
            out.ids.append(item_id)
            out.values.append([_value(w) for w in t.words])
            out.kinds.append(t.kinds)
            out.ends.append(ends)
        out.index = {key: Windows.of(parts, key[1]) for key, parts in sorted(found.items())}
        return out

    def held_by(self, text: str | None) -> list[Held]:
        """(item id, words covered, words of the item, are all slots unchanged, first and last word's place) of each item held."""
        return self._held_by_some([text])[0]

    def _held_by_some(self, texts: list[str | None]) -> list[list[Held]]:
        t = Template(texts)
        out: list[list[Held]] = [[] for _ in texts]
        read: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        met = []
        for how, width, keys, begin in _read(t, self.index, read):
            windows = self.index[how, width]
            at, there = windows.met(keys)
            at, text, inside = _inside(t, begin, width, at)
            there = there[inside]
            if not len(at):
                continue
            shape = np.broadcast_to(np.array([[how], [width]]), (2, len(at)))
            met.append(np.stack((text, windows.items[there], at, windows.places[there], windows.words[there], *shape)))
        if not met:
            return out
        rows = np.concatenate(met, 1)
        rows = rows[:, np.lexsort((rows[1], rows[0]))]
        cuts = np.flatnonzero(np.any(rows[:2, 1:] != rows[:2, :-1], 0)) + 1
        for part in np.split(rows, cuts, 1):
            if not part.shape[1]:
                continue
            text, item = part[:2, 0].tolist()
            if part[4].sum() < COVERED * len(self.values[item]):
                continue  # too few windows to cover enough, even if no two share a word
            if row := self._agreeing(item, self._pairs(item, part, read, int(t.bounds[text])), t.words, int(t.bounds[text])):
                out[text].append(row)
        return out

    def _pairs(self, item: int, windows: np.ndarray, read: dict[int, tuple[np.ndarray, np.ndarray]], start: int) -> list[Pair]:
        """The pairs in some windows; where a run meets one of as many words, a pair for each word."""
        out: set[Pair] = set()
        for how, width in np.unique(windows[5:], axis=1).T.tolist():
            _, _, at, place, *_ = windows[:, (windows[5] == how) & (windows[6] == width)]
            step = np.arange(width)
            both = np.unique(np.stack(((place[:, None] + step).ravel(), (at[:, None] + step).ravel())), axis=1)
            ours, theirs = self.ends[item][how], read[how][1] - start
            for a, b, c, d in np.stack((ours[both[0]], ours[both[0] + 1], theirs[both[1]], theirs[both[1] + 1]), 1).tolist():
                if b - a == d - c:
                    out.update((a + k, a + k + 1, c + k, c + k + 1) for k in range(b - a))
                else:
                    out.add((a, b, c, d))
        return list(out)

    def _agreeing(self, item: int, pairs: list[Pair], words: list[str], start: int) -> Held | None:
        """The chain of pairs that covers most of the item and whose slots agree; else the best at one offset."""
        best = None
        n = len(self.values[item])
        for chain in _chains(pairs, n):
            if best and sum(_cover(p) for s in chain for p in s) <= best[1]:
                continue
            if (row := self._held(item, chain, words, start)) and (best is None or row[1] > best[1]):
                best = row
        if best is None:
            offsets: dict[int, list[Pair]] = defaultdict(list)
            for p in sorted(pairs):
                if p[1] - p[0] == p[3] - p[2] == 1:
                    offsets[p[2] - p[0]].append(p)
            for same in offsets.values():
                if len(same) >= COVERED * n and (row := self._held(item, [same], words, start)) and (best is None or row[1] > best[1]):
                    best = row
        return best

    def _held(self, item: int, chain: list[list[Pair]], words: list[str], start: int) -> Held | None:
        """The row of a chain; stretches whose slots disagree most are given up while the rest covers enough."""
        values, kinds = self.values[item], self.kinds[item]
        least = min(len(values), WIDTH)
        chain = list(chain)
        while chain:
            covered = sum(_cover(p) for s in chain for p in s)
            if covered < COVERED * len(values) or sum(p[1] - p[0] for s in chain for p in s) < least:
                return None
            slots = []
            for k, stretch in enumerate(chain):
                for a, b, c, d in stretch:
                    if kinds[a] != LITERAL:
                        slots.append((k, " ".join(values[a:b]), " ".join(map(_value, words[start + c : start + d]))))
            there, back = defaultdict(Counter), defaultdict(Counter)
            for _, ours, theirs in slots:
                there[ours][theirs] += 1
                back[theirs][ours] += 1
            agree = sum(c.most_common(1)[0][1] for c in there.values()), sum(c.most_common(1)[0][1] for c in back.values())
            unchanged = all(ours == theirs for _, ours, theirs in slots)
            if min(agree) >= AGREEING * len(slots):
                if len(values) < SHORTEST and not unchanged:
                    return None
                return self.ids[item], covered, len(values), unchanged, chain[0][0][2], chain[-1][-1][3] - 1
            wrong = Counter(k for k, ours, theirs in slots if there[ours].most_common(1)[0][0] != theirs or back[theirs].most_common(1)[0][0] != ours)
            del chain[wrong.most_common(1)[0][0]]
        return None


def _read(t: Template, index: Iterable[tuple[int, int]], read: dict[int, tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(reading, width, keys, where template words begin) of all windows of some texts; read takes the readings."""
    widths: dict[int, list[int]] = defaultdict(list)
    for how, width in index:
        widths[how].append(width)
    for how, some in sorted(widths.items()):
        codes, begin = read[how] = t.reading(how)
        for width, keys in window_keys(codes, how, some):
            yield how, width, keys, begin


def _inside(t: Template, begin: np.ndarray, width: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows at some places, (those that lie in one text, that text, which they are of the given ones)."""
    text = np.searchsorted(t.bounds, begin[at], "right") - 1
    inside = begin[at + width] <= t.bounds[text + 1] if len(at) else np.empty(0, bool)
    return at[inside], text[inside], inside


def _together(texts: list[str | None]) -> Iterator[list[str | None]]:
    """texts in order, TOGETHER characters at a time."""
    some: list[str | None] = []
    size = 0
    for text in texts:
        n = len(text or "")
        if some and size + n > TOGETHER:
            yield some
            some, size = [], 0
        some.append(text)
        size += n
    if some:
        yield some


def _cover(pair: Pair) -> int:
    """Words of the item that a pair covers: a run covers no more of them than it has words itself."""
    return min(pair[1] - pair[0], pair[3] - pair[2])


def _stretches(pairs: list[Pair]) -> list[list[Pair]]:
    """Runs of pairs that follow on each other in item and document; of pairs with one beginning or one end the longest counts."""
    begins: dict[tuple[int, int], Pair] = {}
    ends: dict[tuple[int, int], Pair] = {}
    for p in sorted(pairs, key=lambda p: (p[0] + p[2] - p[1] - p[3], p)):
        if (p[0], p[2]) not in begins and (p[1], p[3]) not in ends:
            begins[p[0], p[2]] = ends[p[1], p[3]] = p
    out = []
    for p in begins.values():
        if (p[0], p[2]) in ends:
            continue
        run = [p]
        while (p := begins.get((p[1], p[3]))) is not None:
            run.append(p)
        out.append(run)
    return out


def _chains(pairs: list[Pair], n: int) -> Iterator[list[list[Pair]]]:
    """Chains of stretches in increasing places of item and document, those that cover most first; a stretch is in one at most.

    From one stretch to the next, the offset between item and document moves by n words at most. What two of them share
    belongs to the first.
    """
    runs = sorted(_stretches(pairs), key=lambda r: (r[-1][3], r[-1][1], r[0][2]))
    total, back = [], []
    lasts = [r[-1][3] for r in runs]
    for k, r in enumerate(runs):
        size = sum(map(_cover, r))
        best, via = size, -1
        begin, here = r[0][0], r[0][2]
        for j in range(k - 1, bisect_left(lasts, here - 2 * n) - 1, -1):
            last = runs[j][-1]
            if last[1] >= r[-1][1] or last[3] >= r[-1][3] or abs((here - begin) - (last[3] - last[1])) > n:
                continue
            if (sum_ := total[j] + size - max(0, last[1] - begin, last[3] - here)) > best:
                best, via = sum_, j
        total.append(best)
        back.append(via)
    used: set[int] = set()
    for k in sorted(range(len(runs)), key=lambda k: -total[k]):
        chain = []
        while k >= 0 and k not in used:
            used.add(k)
            chain.append(runs[k])
            k = back[k]
        out, a, c = [], 0, 0
        for r in reversed(chain):
            if rest := [p for p in r if p[0] >= a and p[2] >= c]:
                out.append(rest)
                a, c = rest[-1][1], rest[-1][3]
        if out:
            yield out


WINDOWS = pa.schema([("key", pa.int64()), ("item", pa.int64()), ("how", pa.int32()), ("width", pa.int32()), ("words", pa.int32()), ("n_words", pa.int32())])
WINDOWS_SQL = "key long, item long, how int, width int, words int, n_words int"


def _items(benchmark: DataFrame) -> DataFrame:
    """A written table (item, item_id, text, copies) of the distinct benchmark rows; null ids and texts are passed over."""
    known = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    known = known.groupBy("item_id", "text").agg(F.count("*").alias("copies"))
    return written(known.select(F.monotonically_increasing_id().alias("item"), "item_id", "text", "copies"), "items")


def _item_windows(items: DataFrame) -> DataFrame:
    """A written table of WINDOWS: every window of every item, with the words it covers and those that the item has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number = b.column("item").to_pylist()
            these = Items.of(list(zip(range(len(number)), b.column("text").to_pylist(), strict=True)))
            rows = []
            for (how, width), w in these.index.items():
                at = w.items.tolist()
                rows += [(int(k), number[these.ids[i]], how, width, n, len(these.values[i])) for k, i, n in zip(w.keys.view(np.int64).tolist(), at, w.words.tolist(), strict=True)]
            yield arrow_rows(WINDOWS, rows)

    return written(items.select("item", "text").mapInArrow(task(run, "templates"), WINDOWS_SQL), "item-windows")


def _sieve(windows: DataFrame) -> Sieve:
    """The sieve of all windows' keys, put together from the tasks' parts; SIEVE_BITS bound what the driver gets."""
    n = windows.count()
    log = min(SIEVE_BITS[1], max(SIEVE_BITS[0], (SIEVE_PER * n - 1).bit_length() if n else 0))
    shift, chunk = np.uint64(64 - log), 1 << CHUNK_BITS

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for b in batches:
            keys = b.column("key").to_numpy().view(np.uint64)
            for probe in range(PROBES):
                places = np.unique(Sieve.places(keys, probe, shift))
                for k in np.unique(places >> CHUNK_BITS).tolist():
                    here = places[places >> CHUNK_BITS == k] & (chunk - 1)
                    np.bitwise_or.at(parts.setdefault(k, np.zeros(chunk // 8, np.uint8)), here >> 3, (1 << (here & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([p.tobytes() for p in parts.values()], pa.binary())], ["part", "bits"])

    def merge(group: pa.Table) -> pa.Table:
        bits = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in group.column("bits").to_pylist()])
        return pa.table({"part": group.column("part")[:1], "bits": pa.array([bits.tobytes()], pa.binary())})

    bits = np.zeros((1 << log) // 8, np.uint8)
    for r in windows.select("key").mapInArrow(task(mark), "part int, bits binary").groupBy("part").applyInArrow(merge, "part int, bits binary").toLocalIterator():
        bits[r["part"] * chunk // 8 : (r["part"] + 1) * chunk // 8] = np.frombuffer(r["bits"], np.uint8)
    return Sieve(bits)


MET = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("text", pa.string()), ("keys", pa.list_(pa.int64()))])


def _met(docs: DataFrame, sieve: Sieve, shapes: list[tuple[int, int]]) -> DataFrame:
    """A written table (row, doc_id, text, keys) of the rows of docs with window keys that pass the sieve; one narrow pass.

    row numbers the rows; as the table is written once, it is the same whenever it is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            found: list[tuple] = []
            ids, done = b.column("doc_id").to_pylist(), 0
            for texts in _together(b.column("text").to_pylist()):
                t, keys, owner = Template(texts), [], []
                for _, width, mine, begin in _read(t, shapes, {}):
                    at, text, _ = _inside(t, begin, width, sieve.passing(mine))
                    keys.append(mine[at])
                    owner.append(text)
                if sum(map(len, keys)):
                    some, whose = np.concatenate(keys).view(np.int64), np.concatenate(owner)
                    for k in np.unique(whose).tolist():
                        found.append((row, ids[done + k], texts[k], np.unique(some[whose == k])))
                        row += 1
                done += len(texts)
            yield arrow_rows(MET, found)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text <> ''")
    return written(rows.mapInArrow(task(run, "templates"), "row long, doc_id long, text string, keys array<long>"), "met")


HELD = pa.schema(
    [("text", pa.string()), ("doc_id", pa.int64()), ("item_id", pa.int64()), ("covered_words", pa.int64()), ("item_words", pa.int64()), ("unchanged", pa.bool_()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("copies", pa.int64())]
)
HELD_SQL = "text string, doc_id long, item_id long, covered_words long, item_words long, unchanged boolean, first_word long, last_word long, copies long"


def _held(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """HELD for each row of docs and distinct row of benchmark that it holds."""
    bounded_batches(docs.sparkSession)
    items = _items(benchmark)
    windows = _item_windows(items)
    shapes = sorted((r["how"], r["width"]) for r in windows.select("how", "width").distinct().collect())
    met = _met(docs, _sieve(windows), shapes)
    # a window of an item counts once, however often a document has it, so the sum bounds the words that could be covered
    pairs = met.select("row", F.explode("keys").alias("key")).join(windows.select("key", "item", "words", "n_words"), "key")
    pairs = pairs.groupBy("row", "item").agg(F.sum("words").alias("words"), F.max("n_words").alias("n_words")).where(F.col("words") >= COVERED * F.col("n_words"))
    rows = pairs.select("row", "item").join(items.withColumnRenamed("text", "asked"), "item").join(met.select("row", "doc_id", "text"), "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for (_, doc_id, text), some in groupby(b.to_pylist(), lambda r: (r["row"], r["doc_id"], r["text"])):
                asked = list(some)
                copies = [r["copies"] for r in asked]
                these = Items.of([(k, r["asked"]) for k, r in enumerate(asked)])
                out += [(text, doc_id, asked[k]["item_id"], *held, copies[k]) for k, *held in these.held_by(text)]
            yield arrow_rows(HELD, out)

    return rows.select("row", "doc_id", "text", "item_id", "asked", "copies").mapInArrow(task(run, "templates"), HELD_SQL)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document of docs (doc_id, text) and item of benchmark (item_id, text) that it holds.

    unchanged tells whether all slots have the item's own values; first_word and last_word count the document's template
    words. Null and empty texts hold nothing, items without a template word are held by nothing; repeated rows of either
    table give a row each; an empty table on either side gives no row.
    """
    held = _held(docs, benchmark).drop("text")
    return held.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copy", "copies")


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that hold no item of benchmark.

    What a row holds follows from its text alone, so rows go by their text's digest; the join with the digests of the texts
    found is left to Spark, which sends them to all tasks only while its size check allows.
    """
    mark = "_".join(["digest", *docs.columns])  # no column of docs can have this name
    gone = written(_held(docs, benchmark).select(F.sha2("text", 256).alias(mark)).distinct(), "contaminated")
    return docs.join(gone, F.sha2(docs["text"], 256) == gone[mark], "left_anti")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
