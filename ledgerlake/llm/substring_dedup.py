"""Substring dedup over a log-structured fingerprint index of word windows.

Documents are dealt into blocks of bounded size. A block's distinct window fingerprints, sorted and cut by bucket, are its
runs; they never change. Three rounds follow, and each moves integers only:

1. The runs of a bucket, and the index's historical run where there is one, are merge-joined: each block learns which of its
   fingerprints occur elsewhere too.
2. For those alone, blocks send a second, independent hash of the whole window with its first place; runs are merged again
   and equal windows are told from chance collisions. The earliest place owns a window; other blocks learn that they don't.
3. Blocks remove the words under windows that start earlier elsewhere or in the block itself.

A passage that a third of all documents share appears once a block, not once a document, so no bucket grows with it.
A bucket and 32 bits find a window, 64 more of an independent hash verify it: over 100 bits at 10^6 windows a bucket, however
many there are; both hashes add up random numbers of each byte at its place, so no pattern makes them collide together.
``compact`` merges a batch's runs into the index, so that later batches are checked against all earlier ones.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHasher, bounded_batches, table

WIDTH, BLOCK_CHARS, BUCKET_WINDOWS = 20, 1 << 20, 1 << 20
FINDER, VERIFIER = WordHasher(11), WordHasher(23)

RUN = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("keys", pa.binary())])
RUN_SQL = "bucket long, block long, keys binary"
PLACED = pa.schema([*RUN, ("checks", pa.binary()), ("doc_ids", pa.binary()), ("starts", pa.binary())])
PLACED_SQL = f"{RUN_SQL}, checks binary, doc_ids binary, starts binary"
REPLY = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary()), ("checks", pa.binary())])
REPLY_SQL = "block long, bucket long, keys binary, checks binary"
INDEX_SQL = "bucket long, keys binary, checks binary"
HISTORY = -1


def _join(column: pa.ChunkedArray, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of packed arrays, and the row that each comes from."""
    parts = column.to_pylist()
    sizes = np.array([len(p) for p in parts], np.int64) // np.dtype(dtype).itemsize
    return np.frombuffer(b"".join(parts), dtype), np.repeat(np.arange(len(parts)), sizes)


def _planes(a: np.ndarray) -> bytes:
    """Integers by bytes of equal significance, so that the shuffle's codec drops the empty ones."""
    return np.ascontiguousarray(a.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _stretches(values: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of one value in an ascending array of non-negative integers."""
    edges = np.flatnonzero(np.diff(values, prepend=-1))
    return list(zip(edges, np.append(edges[1:], len(values)), strict=True)) if len(edges) else []


class _Block:
    """The documents of one block in ascending doc_id order, and their windows."""

    def __init__(self, docs: pa.Table, buckets: int, width: int) -> None:
        ids = docs.column("doc_id").to_pylist()
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0))
        texts = docs.column("text").to_pylist()
        self.doc_ids = [ids[k] for k in order]
        self.texts = [(texts[k] or "").encode() for k in order]
        self.buckets, self.width = buckets, width
        words, self.begins = FINDER.texts(self.texts)
        n = np.diff(self.begins)
        #: places of the windows among the block's words; none crosses from one document into the next
        self.places = np.flatnonzero(np.arange(len(words)) + width <= np.repeat(self.begins[1:], n)) if len(words) else np.empty(0, np.int64)
        found = FINDER.windows(words, width)[self.places] if len(self.places) else np.empty(0, np.uint64)
        high, low = found >> np.uint64(32), found & np.uint64(0xFFFFFFFF)
        #: bucket and 32-bit key of each window in one integer
        self.found = (high * np.uint64(buckets)) >> np.uint64(32) << np.uint64(32) | low

    def checks(self) -> np.ndarray:
        words, _ = VERIFIER.texts(self.texts)
        return VERIFIER.windows(words, self.width)[self.places] if len(self.places) else np.empty(0, np.uint64)

    def by_bucket(self, found: np.ndarray) -> list[tuple[int, slice]]:
        bucket = (found >> np.uint64(32)).astype(np.int64)
        return [(int(bucket[a]), slice(a, b)) for a, b in _stretches(bucket)]


def _keys(found: np.ndarray) -> bytes:
    return (found & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()


def _told(replies: pa.Table, with_checks: bool) -> tuple[np.ndarray, np.ndarray]:
    keys, row = _join(replies.column("keys"), "<u4")
    bucket = replies.column("bucket").to_numpy().astype(np.uint64) if replies.num_rows else np.empty(0, np.uint64)
    found = bucket[row] << np.uint64(32) | keys
    return found, _join(replies.column("checks"), "<u8")[0] if with_checks else np.empty(0, np.uint64)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else ([] for _ in schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _runs(docs: pa.Table, buckets: int, width: int) -> pa.Table:
    block = docs.column("block")[0].as_py()
    it = _Block(docs, buckets, width)
    found = np.unique(it.found)
    return _table([(b, block, _keys(found[s])) for b, s in it.by_bucket(found)], RUN)


def _shared(runs: pa.Table) -> pa.Table:
    """For each block of a bucket's runs, its keys that other runs have too."""
    bucket = runs.column("bucket")[0].as_py()
    keys, row = _join(runs.column("keys"), "<u4")
    blocks = runs.column("block").to_numpy()
    both = keys.astype(np.uint64) << np.uint64(32) | row.astype(np.uint64)  # eight bytes a key, merged in place
    both.sort()
    keys = (both >> np.uint64(32)).astype(np.uint32)
    same = keys[1:] == keys[:-1]
    again = np.concatenate((same, [False])) | np.concatenate(([False], same))
    return _by_row(bucket, blocks, (both[again] & np.uint64(0xFFFFFFFF)).astype(np.int64), keys[again], None)


def _by_row(bucket: int, blocks: np.ndarray, row: np.ndarray, keys: np.ndarray, checks: np.ndarray | None) -> pa.Table:
    keep = blocks[row] != HISTORY
    row, keys = row[keep], keys[keep]
    order = np.argsort(row, kind="stable")
    row, keys = row[order], keys[order]
    checks = checks[keep][order] if checks is not None else None
    out = []
    for a, b in _stretches(row):
        out.append((int(blocks[row[a]]), bucket, keys[a:b].tobytes(), checks[a:b].tobytes() if checks is not None else b""))
    return _table(out, REPLY)


def _candidates(docs: pa.Table, replies: pa.Table, buckets: int, width: int) -> pa.Table:
    """First places in a block of windows that the first round found elsewhere too, with their second hash."""
    if not docs.num_rows or not replies.num_rows:
        return _table([], PLACED)
    it = _Block(docs, buckets, width)
    mine = np.flatnonzero(np.isin(it.found, _told(replies, False)[0]))
    if not len(mine):
        return _table([], PLACED)
    found, checks = it.found[mine], it.checks()[mine]
    order = np.lexsort((mine, checks, found))
    found, checks, mine = found[order], checks[order], mine[order]
    first = np.concatenate(([True], (found[1:] != found[:-1]) | (checks[1:] != checks[:-1])))
    found, checks, place = found[first], checks[first], it.places[mine[first]]
    doc = np.searchsorted(it.begins, place, "right") - 1
    ids = np.array([np.iinfo(np.int64).max if d is None else d for d in it.doc_ids], np.int64)[doc]
    starts, block = place - it.begins[doc], docs.column("block")[0].as_py()
    return _table([(b, block, _keys(found[s]), checks[s].tobytes(), _planes(ids[s]), _planes(starts[s])) for b, s in it.by_bucket(found)], PLACED)


def _owned_elsewhere(placed: pa.Table) -> pa.Table:
    """For each block of a bucket, the windows that start earlier in another block or in the index."""
    bucket = placed.column("bucket")[0].as_py()
    blocks = placed.column("block").to_numpy()
    keys, row = _join(placed.column("keys"), "<u4")
    checks, _ = _join(placed.column("checks"), "<u8")
    ids = np.concatenate([_unplanes(x) for x in placed.column("doc_ids").to_pylist()])
    starts = np.concatenate([_unplanes(x) for x in placed.column("starts").to_pylist()])
    order = np.lexsort((blocks[row], starts, ids, blocks[row] != HISTORY, checks, keys))
    keys, checks, row = keys[order], checks[order], row[order]
    later = np.concatenate(([False], (keys[1:] == keys[:-1]) & (checks[1:] == checks[:-1])))
    return _by_row(bucket, blocks, row[later], keys[later], checks[later])


KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("removed", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))])
KEPT_SQL = "doc_id long, n_words long, n_removed long, kept string, removed array<struct<begin:long,end:long>>"


def _kept(docs: pa.Table, replies: pa.Table, buckets: int, width: int) -> pa.Table:
    if not docs.num_rows:
        return _table([], KEPT)
    it = _Block(docs, buckets, width)
    total = int(it.begins[-1])
    gone = np.zeros(len(it.places), bool)
    told, told_checks = _told(replies, True)
    _, inverse, n = np.unique(it.found, return_inverse=True, return_counts=True)
    look = np.flatnonzero((n[inverse] > 1) | np.isin(it.found, told)) if len(it.found) else np.empty(0, np.int64)
    if len(look):
        found, checks = it.found[look], it.checks()[look]
        order = np.lexsort((look, checks, found))
        f, c = found[order], checks[order]
        gone[look[order[1:]]] = (f[1:] == f[:-1]) & (c[1:] == c[:-1])
        gone[look] |= _in_pairs(found, checks, told, told_checks)
    covered = np.zeros(total + 1, np.int64)
    np.add.at(covered, it.places[gone], 1)
    np.subtract.at(covered, it.places[gone] + width, 1)
    covered = np.cumsum(covered[:total]) > 0
    rows = []
    for k, (doc_id, text) in enumerate(zip(it.doc_ids, it.texts, strict=True)):
        words, mask = text.split(), covered[it.begins[k] : it.begins[k + 1]]
        edges = np.flatnonzero(np.diff(mask, prepend=False, append=False)).tolist()
        spans = [{"begin": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)]
        kept, at = [], 0
        for s in spans:
            kept += words[at : s["begin"]]
            at = s["end"]
        kept += words[at:]
        rows.append((doc_id, len(words), len(words) - len(kept), b" ".join(kept).decode(), spans))
    return _table(rows, KEPT)


def _in_pairs(found: np.ndarray, checks: np.ndarray, told: np.ndarray, told_checks: np.ndarray) -> np.ndarray:
    """Which (found, check) pairs are among the told ones. Told pairs of one key differ by chance alone, so they are few."""
    out = np.zeros(len(found), bool)
    if not len(told):
        return out
    order = np.lexsort((told_checks, told))
    told, told_checks = told[order], told_checks[order]
    begin, end = np.searchsorted(told, found, "left"), np.searchsorted(told, found, "right")
    for step in range(int((end - begin).max(initial=0))):
        at = np.minimum(begin + step, len(told) - 1)
        out |= (begin + step < end) & (told_checks[at] == checks)
    return out


def _growth(total: int) -> int:
    """How many times larger blocks and buckets are than at 4 GB: as the root of the corpus, 32 at most. A block sends a row to
    each bucket that it has windows of, so in a large corpus larger ones keep rows from holding a key or two each: at 100 TB
    a row has some ten. 32 MB of text, and 2^25 windows at eight bytes and as much again to sort, are what a task holds."""
    return min(32, max(1, math.isqrt(total >> 32)))


def in_blocks(docs: DataFrame, block_chars: int | None = None) -> tuple[DataFrame, int]:
    """(block, doc_id, text) and all texts' characters. A row's block follows from its content, so a rerun task deals alike."""
    total = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // (block_chars or BLOCK_CHARS * _growth(total))))
    return docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).alias("block"), F.col("doc_id").cast("long").alias("doc_id"), "text"), total


def remove_repeats(docs: DataFrame, index: DataFrame | None = None, width: int = WIDTH, buckets: int | None = None, block_chars: int | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept (its words left, joined by one space) and removed word ranges.

    A word goes where a window of ``width`` words covers it whose word sequence starts earlier: in a smaller doc_id,
    earlier in the same document, or in ``index`` (see fingerprints and compact; give its ``buckets``). Windows are judged
    on the input. Null and empty texts, and those of fewer than width words, keep all they have. Of rows with equal doc_id
    each counts as a document, one of them first; rows of null doc_id come last. An empty table gives no row.
    """
    bounded_batches(docs.sparkSession)
    blocks, total = in_blocks(docs, block_chars)
    if buckets is None:
        buckets = max(1, -(-total // 6 // (BUCKET_WINDOWS * _growth(total))))
    runs = blocks.groupBy("block").applyInArrow(lambda t: _runs(t, buckets, width), RUN_SQL)
    if index is not None:
        runs = runs.unionByName(index.select("bucket", F.lit(HISTORY).cast("long").alias("block"), "keys"))
    shared = runs.groupBy("bucket").applyInArrow(_shared, REPLY_SQL)
    placed = blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(lambda t, r: _candidates(t, r, buckets, width), PLACED_SQL)
    if index is not None:
        history = index.select("bucket", F.lit(HISTORY).cast("long").alias("block"), "keys", "checks")
        nothing = F.expr("unhex(repeat('00', 2 * length(keys)))")  # a 64-bit zero for each 32-bit key
        placed = placed.unionByName(history.withColumns({"doc_ids": nothing, "starts": nothing}))
    owned = placed.groupBy("bucket").applyInArrow(_owned_elsewhere, REPLY_SQL)
    return blocks.groupBy("block").cogroup(owned.groupBy("block")).applyInArrow(lambda t, r: _kept(t, r, buckets, width), KEPT_SQL)


def fingerprints(docs: DataFrame, buckets: int, width: int = WIDTH, block_chars: int | None = None) -> DataFrame:
    """Runs of a batch for an index of so many buckets: (bucket, keys, checks), sorted within a row."""
    blocks, _ = in_blocks(docs, block_chars)

    def run(docs: pa.Table) -> pa.Table:
        it = _Block(docs, buckets, width)
        checks = it.checks()
        order = np.lexsort((checks, it.found))
        found, checks = it.found[order], checks[order]
        return _table([(b, _keys(found[s]), checks[s].tobytes()) for b, s in it.by_bucket(found)], INDEX)

    return compact(blocks.groupBy("block").applyInArrow(run, INDEX_SQL))


INDEX = pa.schema([("bucket", pa.int64()), ("keys", pa.binary()), ("checks", pa.binary())])


def compact(runs: DataFrame) -> DataFrame:
    """Merge all runs of a bucket into one without repeats: union an index with a batch's fingerprints, compact, and write."""

    def run(rows: pa.Table) -> pa.Table:
        keys, _ = _join(rows.column("keys"), "<u4")
        checks, _ = _join(rows.column("checks"), "<u8")
        order = np.lexsort((checks, keys))
        keys, checks = keys[order], checks[order]
        new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1]))) if len(keys) else np.empty(0, bool)
        return _table([(rows.column("bucket")[0].as_py(), keys[new].tobytes(), checks[new].tobytes())], INDEX)

    return runs.groupBy("bucket").applyInArrow(run, INDEX_SQL)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove 20-word windows that start earlier, over all documents."""
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), windows AS (
  SELECT doc_id, s, array_to_string(words[s:s + 19], chr(32)) AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS s FROM w)
), later AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY win ORDER BY doc_id, s) AS k FROM windows) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM later
), placed AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM w
), kept AS (
  SELECT placed.doc_id, string_agg(word, ' ' ORDER BY placed.p) AS kept, count(*) AS n FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY placed.doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
