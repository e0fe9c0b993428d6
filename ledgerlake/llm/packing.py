"""Best-fit packing by exact-complement hashing of length sums."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_rows, bounded_batches, table, task, written
from .encoding import DEFAULT_VOCABULARY, END, encoder

CAPACITY = 2048


class Plan:
    """How pieces of 1..capacity ids fill sequences, from their counts alone.

    The longest piece left opens a sequence. Its gap is looked up in the index of available lengths: one length, a pair
    or a triple that fills it exactly is taken; failing all three, the longest piece that fits is put in and the rest of
    the gap looked up anew. A pattern repeats as often as the counts allow, so the work depends on the capacity, not on
    the number of pieces. intervals: (length, first rank, repeats, first sequence, offset); the k-th piece of a length
    finds its place by its rank.
    """

    def __init__(self, counts: np.ndarray, capacity: int = CAPACITY) -> None:
        self.left = np.asarray(counts, np.int64).copy()
        self.capacity, self.sequences = capacity, 0
        self.intervals: list[tuple[int, int, int, int, int]] = []
        ranks = np.zeros(capacity + 1, np.int64)
        there = (self.left > 0).astype(np.float64)
        #: pairs[s]: ordered pairs of available lengths whose sum is s; kept up as lengths run out
        self.pairs = np.rint(np.convolve(there, there))[: capacity + 1].astype(np.int64)
        self.there = self.left > 0
        #: triples[s]: ordered triples of available lengths whose sum is s; made anew after a length has run out
        self._triples: np.ndarray | None = None
        longest = capacity
        while True:
            while longest and not self.left[longest]:
                longest -= 1
            if not longest:
                break
            pattern = self._pattern(longest)
            lengths, uses = np.unique(pattern, return_counts=True)
            times = int((self.left[lengths] // uses).min())
            offset = 0
            for n in pattern:
                self.intervals.append((n, int(ranks[n]), times, self.sequences, offset))
                ranks[n] += times
                offset += n
            self.sequences += times
            self.left[lengths] -= uses * times
            for n in lengths[self.left[lengths] == 0]:
                self._gone(int(n))

    @property
    def triples(self) -> np.ndarray:
        if self._triples is None:
            self._triples = np.rint(np.convolve(self.pairs.astype(np.float64), self.there.astype(np.float64)))[: self.capacity + 1]
        return self._triples

    def _gone(self, n: int) -> None:
        self.there[n], self._triples = False, None
        lengths = np.flatnonzero(self.there)
        lengths = lengths[lengths + n <= self.capacity]
        self.pairs[lengths + n] -= 2
        if 2 * n <= self.capacity:
            self.pairs[2 * n] -= 1

    def _pattern(self, longest: int) -> list[int]:
        used, pattern, gap = {longest: 1}, [longest], self.capacity - longest
        free = lambda n: self.left[n] - used.get(n, 0) > 0

        def exact() -> list[int] | None:
            if free(gap):
                return [gap]
            return pair(gap) or triple()

        def pair(total: int, first: int = 0) -> list[int] | None:
            if not self.pairs[total]:
                return None
            b = np.arange((total + 1) // 2, total)
            for n in b[self.there[b] & self.there[total - b]][::-1].tolist():
                need = [n, total - n, *([first] if first else [])]
                if all(self.left[x] - used.get(x, 0) >= need.count(x) for x in need):
                    return need[:2]
            return None

        def triple() -> list[int] | None:
            if not self.triples[gap]:
                return None
            b = np.arange(gap - 2, (gap + 2) // 3 - 1, -1)  # the longest of three is a third of the gap at least
            if not len(b):
                return None
            for n in b[self.there[b] & (self.pairs[gap - b] > 0)].tolist():
                if free(n) and (two := pair(gap - n, n)):
                    return [n, *two]
            return None

        while gap:
            if found := exact():
                return pattern + found
            fits = np.flatnonzero(self.there[: gap + 1])
            n = next((n for n in fits[::-1].tolist() if free(n)), 0)
            if not n:
                break
            used[n] = used.get(n, 0) + 1
            pattern.append(n)
            gap -= n
        return pattern

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys (length and first rank in one integer), first sequences and offsets, for bisection."""
        rows = sorted((n << 48 | rank, sequence, offset) for n, rank, _, sequence, offset in self.intervals)
        return tuple(np.array([r[k] for r in rows], np.int64) for k in range(3))


PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary()), ("part", pa.int32()), ("local_rank", pa.int64())]
)
PIECES_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, part int, local_rank long"


def _cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole capacities, but for the first."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def cut_pieces(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """A written table of pieces with the columns of PIECES, their rank among those of their length in their task's rows included.

    Ranks come from a counter in each task; as the table is written once, later stages see the same ranks whatever is
    recomputed. Null texts count as empty: the end id alone.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = encoder(vocabulary), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist()), strict=True):
                ids += END
                for k, (start, n) in enumerate(_cut(len(ids) // 4, capacity)):
                    raw = ids[4 * start : 4 * (start + n)]
                    rows.append((doc_id, k, start, n, zlib.crc32(raw), raw if keep_ids else None, part, int(seen[n])))
                    seen[n] += 1
            yield arrow_rows(PIECES, rows)

    return written(docs.select("doc_id", "text").mapInArrow(task(run, "encoder"), PIECES_SQL), "pieces")


PACKED_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(pieces: DataFrame, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """Give each piece of cut_pieces its sequence_id and offset; with keep_ids its ids too, little-endian 32-bit integers.

    The driver gets one count for each length, so at most capacity of them; the plan made of them is as bounded. A piece's
    rank among all of its length is its rank within its task plus the counts of the tasks before, from a window over
    (task, length) counts. No key gathers pieces of one length.
    """
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r["length"]] = r["n"]
    keys, sequences, offsets = Plan(counts, capacity).arrays()
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["part", "length"])
    told = ["doc_id", "piece", "start", "length", "ids_crc32"]
    more = ["ids"] if keep_ids else []

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
            key = length << 48 | rank
            at = np.searchsorted(keys, key, "right") - 1
            placed = [pa.array(sequences[at] + (key - keys[at])), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays([*map(b.column, told), *placed, *map(b.column, more)], [*told, "sequence_id", "offset", *more])

    rank = (F.col("local_rank") + F.col("before")).alias("rank")
    return ranked.select(*told, rank, *more).mapInArrow(task(place, "encoder"), PACKED_SQL + ", ids binary" * keep_ids)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = DEFAULT_VOCABULARY, keep_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with keep_ids its ids.

    Empty and null texts give one piece of one id; repeated rows are packed each; an empty table gives no row.
    """
    return pack(cut_pieces(docs, vocabulary, capacity, keep_ids), capacity, keep_ids)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack the ids of all documents into sequences of 2048."""
    return pack_documents(table(spark, sf_dir, "documents"))
