"""Token counts by a linear longest-match automaton: a vocabulary trie with failure links and popped-token counts."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, bounded_batches, keeps, table, task
from .encoding import DEFAULT_VOCABULARY, byte_alphabet


class LongestMatch:
    """Greedy longest-match piece counts, one automaton step a byte and no piece ever built.

    A state is a prefix of vocabulary entries. Where a byte can't extend it, the pieces that greedy matching is sure to
    take by then are counted (pops) and the state becomes what remains after them (fail). Each byte enters one state and
    every failure takes a matched piece off, so a word of n bytes takes O(n) steps.
    """

    def __init__(self, vocabulary: Iterable[bytes]) -> None:
        step: dict[int, int] = {}  # state * 256 + byte
        final, parent, last, depth = {}, [0], [0], [0]
        for entry in vocabulary:
            at = 0
            for b in entry:
                key = at << 8 | b
                if key not in step:
                    step[key] = len(parent)
                    parent.append(at)
                    last.append(b)
                    depth.append(depth[at] + 1)
                at = step[key]
            if entry:
                final[at] = True
        n = len(parent)
        fail, pops = [-1] * n, [0] * n
        for v in sorted(range(1, n), key=depth.__getitem__):
            if v in final:
                fail[v], pops[v] = 0, 1
                continue
            u, b = parent[v], last[v]
            z, count = fail[u], pops[u]
            while z >= 0 and z << 8 | b not in step:
                z, count = fail[z], count + pops[z]
            if z >= 0:
                fail[v], pops[v] = step[z << 8 | b], count
        #: at_end[v]: pieces still to come when the word ends in v; -1 where greedy matching breaks off
        at_end = [0] * n
        for v in sorted(range(1, n), key=depth.__getitem__):
            z = fail[v]
            at_end[v] = -1 if z < 0 or at_end[z] < 0 else pops[v] + at_end[z]
        self.step, self.fail, self.pops, self.at_end = step, fail, pops, at_end

    def count(self, word: bytes, unknown: int = 1) -> int:
        """Pieces of word; unknown where no sequence of longest matches covers it."""
        step, fail, pops = self.step, self.fail, self.pops
        at = total = 0
        for b in word:
            while (to := step.get(at << 8 | b)) is None:
                total += pops[at]
                at = fail[at]
                if at < 0:
                    return unknown
            at = to
        rest = self.at_end[at]
        return unknown if rest < 0 else total + rest


class _Counts(dict):
    """Counts of words met before, bounded in number; a word not met goes through the automaton."""

    KEPT = 400_000

    def __init__(self, automaton: LongestMatch) -> None:
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(b" " + word)
        if len(word) <= 64:
            if len(self) >= self.KEPT:
                self.clear()
            self[word] = n
        return n


keeps("automaton", lambda: automaton.cache_clear())


@cache
def automaton(vocabulary: str = DEFAULT_VOCABULARY) -> LongestMatch:
    """The automaton of a byte-level vocabulary file; one for each worker process."""
    with open(vocabulary, encoding="utf-8") as f:
        entries = json.load(f)["model"]["vocab"]
    to_byte = byte_alphabet()
    return LongestMatch(bytes(to_byte[c] for c in e) for e in entries if all(c in to_byte for c in e))


ROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("n_bytes", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("longest_word_tokens", pa.int64())])


def token_counts(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """doc_id, n_chars, n_bytes, n_words, n_tokens, longest_word_tokens of each (doc_id, text); one narrow pass.

    Words are [^\\x20\\x09-\\x0D]+; each is matched with one space in front, which marks its start as in a byte-level
    vocabulary. Null and empty texts have no words and no tokens; repeated rows are counted each.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(automaton(vocabulary)).__getitem__

        def one(doc_id: int, text: str | None) -> tuple:
            raw = (text or "").encode()
            found = list(map(counts, raw.split()))
            return doc_id, len(text or ""), len(raw), len(found), sum(found), max(found, default=0)

        for b in batches:
            yield arrow_rows(ROW, [one(d, t) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(task(run, "automaton"), "doc_id long, n_chars long, n_bytes long, n_words long, n_tokens long, longest_word_tokens long")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy longest-match token counts of every document."""
    return token_counts(table(spark, sf_dir, "documents"))
