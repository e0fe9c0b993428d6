"""MinHash near-dedup by an inverted join of signature coordinates.

Each distinct shingle set, a node, is signed with COORDINATES minima and posted under each of its coordinate-value pairs. Two
sets of the similarity asked for agree in THRESHOLD coordinates or more but for a chance of 3 * 10^-9, so lists are merged
with skips: a node leaves its THRESHOLD - 1 longest lists out (lists of one are no match for anybody), and of a pair that
agrees in THRESHOLD the rarest common value is still in what both keep, as the lists' order is the same for all. That is what
keeps the lists of widespread passages out. Collisions over the whole signature are then counted for nodes that meet, and
pairs at or above the threshold are confirmed on their full shingle sets.

What is asked for is components, so a list need not be expanded into its pairs:

- Round one compares each node of a list with the list's least one alone. Lists of near copies end there.
- Round two looks at lists that still hold several components, and compares only nodes of different ones, each pair in the
  first list that both keep. The largest component of a list is cut into parts, the others into blocks; one of either meet
  in a task. Signatures meet first; texts are fetched for the nodes that are left with a partner, and a task gives out links
  alone, and no link that joins what it has joined before. So a list never becomes pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Batches, WordHasher, arrow_rows, bounded_batches, mix, table, task, written
from .components import components

SHINGLE, COORDINATES, THRESHOLD = 5, 80, 36
#: Round two: shingles of a part of the largest component, and of a block of the others, that meet in one task.
PART, OTHERS = 400_000, 200_000
HASHER = WordHasher(5, fold_case=True)
_rng = np.random.default_rng(17)
_FACTORS, _TERMS = (_rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct 5-word shingles; A-Z in lower case; fewer words are one shingle."""
    words, begins = HASHER.texts([(t or "").encode() for t in texts])
    out = []
    for a, b in zip(begins[:-1], begins[1:], strict=True):
        mine = words[a:b]
        if len(mine) >= SHINGLE:
            out.append(np.unique(HASHER.windows(mine, SHINGLE)))
        else:
            out.append(np.array([HASHER.whole(mine)] if len(mine) else [], np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """COORDINATES 32-bit minima of a set that isn't empty."""
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint64)
    for k in range(0, len(shingles), 2048):
        part = shingles[k : k + 2048]
        np.minimum(out, ((part[None, :] * _FACTORS[:, None] + _TERMS[:, None]) >> np.uint64(32)).min(1), out=out)
    return out.astype(np.uint32)


SIGNED = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()), ("signature", pa.binary())])


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def sign(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, set_id, signature), written. Equal sets have equal set_id; an empty set has its document's."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text_hash, s in zip(b.column("doc_id").to_pylist(), b.column("text_hash").to_pylist(), shingle_sets(b.column("text").to_pylist()), strict=True):
                mark = hashlib.blake2b(s.tobytes() if len(s) else b"empty %d" % (-1 if doc_id is None else doc_id), digest_size=16)
                rows.append((doc_id, text_hash, len(s), mark.digest(), signature(s).tobytes() if len(s) else None))
            yield arrow_rows(SIGNED, rows)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash(F.col("text")).alias("text_hash"), "text")
    return written(rows.mapInArrow(task(run), "doc_id long, text_hash long, n_shingles long, set_id binary, signature binary"), "signed")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)


#: The low bits of a list's key: its coordinate.
_NUMBER = np.uint64(127)


def _posted(nodes: DataFrame) -> DataFrame:
    """(key, node) for each coordinate-value pair; the key hashes the pair and ends in the coordinate's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = _matrix(b.column("signature")).astype(np.uint64)
            number = np.broadcast_to(np.arange(COORDINATES, dtype=np.uint64), values.shape)
            keys = mix(values << np.uint64(7) | number) & ~_NUMBER | number
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(b.column("node").to_numpy(), COORDINATES))], ["key", "node"])

    return nodes.select("node", "signature").mapInArrow(task(run), "key long, node long")


def _merged(posts: DataFrame) -> DataFrame:
    """Posts (key, node) of the lists that several nodes keep, each node's THRESHOLD - 1 longest lists left out.

    Lists are counted before the shuffle; the join that gives each post its list's size can split a long list's posts. What
    is left, a small part, is ranked within nodes, COORDINATES posts at most.
    """
    sizes = posts.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = posts.join(sizes, "key")
    ranked = shared.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("size"), F.desc("key"))))
    return written(ranked.where(F.col("rank") >= THRESHOLD).select("key", "node"), "posts")


def _close(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """The pairs (a, b) with at least THRESHOLD equal coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = (_matrix(b.column("sa")) == _matrix(b.column("sb"))).sum(1) >= THRESHOLD
            yield b.select(["a", "b"]).filter(pa.array(near))

    joined = pairs.join(signatures.select(F.col("node").alias("b"), F.col("signature").alias("sb")), "b").join(signatures.select(F.col("node").alias("a"), F.col("signature").alias("sa")), "a")
    return joined.select("a", "b", "sa", "sb").mapInArrow(task(run), "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have the similarity asked for, from texts (node, text).

    The text of b, which many pairs may share, is joined first; where one b is hot, the join's skew is split, as the other
    side has one row of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, theirs = [], batch.column("tb").to_pylist()
            distinct = list(dict.fromkeys(theirs))
            sets = dict(zip(distinct, shingle_sets(distinct), strict=True))
            for x, y in zip(shingle_sets(batch.column("ta").to_pylist()), map(sets.__getitem__, theirs), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    return joined.select("a", "b", "ta", "tb").mapInArrow(task(run), "a long, b long").select(F.col("a").alias("u"), F.col("b").alias("v"))


def _sided(posts: DataFrame) -> DataFrame:
    """Posts (key, node, comp, n) of the lists that hold several components, each with the task or tasks (x, y) that it goes
    to and main: is it of the list's largest component there?

    A task is part x of the largest component with block y of the others, or (x below 0) block -1 - x of the others with y.
    """
    sizes = posts.groupBy("key", "comp").agg(F.sum("n").alias("n"))
    lists = sizes.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("top"), F.max("n").alias("n_main"), F.sum("n").alias("n_all"), F.count("*").alias("n_comps"))
    sided = posts.join(lists.where("n_comps > 1"), "key")
    count = lambda n, most: F.ceil(n / most).cast("int")
    sided = sided.select("key", "node", "comp", (F.col("comp") == F.col("top")).alias("main"), count(F.col("n_main"), PART).alias("parts"), count(F.col("n_all") - F.col("n_main"), OTHERS).alias("blocks"))
    mine = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    own = sided.where("main").select("key", "node", "comp", "main", mine("parts").alias("x"), F.explode(upto(F.col("blocks"))).alias("y"))
    others = sided.where("NOT main").withColumn("mine", mine("blocks"))
    along = others.select("key", "node", "comp", "main", F.explode(upto(F.col("parts"))).alias("x"), F.col("mine").alias("y"))
    first = others.select("key", "node", "comp", F.lit(True).alias("main"), (-1 - F.col("mine")).alias("x"), F.explode(F.sequence(F.col("mine"), F.col("blocks") - 1)).alias("y"))
    back = F.sequence(F.lit(-1), -1 - F.col("mine"), F.lit(-1))
    second = others.select("key", "node", "comp", F.lit(False).alias("main"), F.explode(back).alias("x"), F.col("mine").alias("y"))
    return own.unionByName(along).unionByName(first).unionByName(second)


def _each_task(rows: DataFrame, one: Callable[[pa.Table], pa.RecordBatch | None], sql: str) -> DataFrame:
    """one(rows of a task) for each (key, x, y) of rows; sorted and streamed, as there are many small ones."""

    def run(batches: Batches) -> Batches:
        waiting: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            ids = np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("key", "x", "y")])
            cuts = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                if begin == end:
                    continue
                name = tuple(ids[:, begin].tolist())
                if waiting and name != last:
                    if (out := one(pa.Table.from_batches(waiting))) is not None:
                        yield out
                    waiting = []
                waiting.append(b.slice(begin, end - begin))
                last = name
        if waiting and (out := one(pa.Table.from_batches(waiting))) is not None:
            yield out

    return rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", F.desc("main"), "node").mapInArrow(task(run), sql)


def _partners(group: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of the others in a task, the rows of the main side that collide with it often enough; each pair of nodes
    in the first list that both keep."""
    main, number = group.column("main").to_numpy(), group.column("key")[0].as_py() & int(_NUMBER)
    comp, sig = group.column("comp").to_numpy(), _matrix(group.column("signature"))
    kept = (np.stack([group.column(c).to_numpy().view(np.uint64) for c in ("low", "high")], 1)[:, :, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)).reshape(len(main), -1)[:, :COORDINATES] > 0
    left = np.flatnonzero(main)
    for k in np.flatnonzero(~main).tolist():
        same = sig[left] == sig[k]
        first = (same & kept[left] & kept[k]).argmax(1) == number
        yield k, left[(same.sum(1) >= THRESHOLD) & first & (comp[left] != comp[k])]


def _linked(sided: DataFrame, met: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (u, v) between different components of a list; in each task no more than join them."""
    signed = sided.join(met.drop("text"), "node")
    columns = ["key", "x", "y", "node", "comp", "main", "signature", "low", "high"]

    def collide(group: pa.Table) -> pa.RecordBatch | None:
        left = np.zeros(group.num_rows, bool)
        for k, near in _partners(group):
            left[near] = True
            left[k] |= len(near) > 0
        return group.filter(pa.array(left)).combine_chunks().to_batches()[0] if left.any() else None

    collided = _each_task(signed.select(*columns), collide, "key long, x int, y int, node long, comp long, main boolean, signature binary, low long, high long")
    collided = written(collided, "collided").join(met.select("node", "text"), "node")

    def confirm(group: pa.Table) -> pa.RecordBatch | None:
        node, comp, text = (group.column(c).to_pylist() for c in ("node", "comp", "text"))
        sets: dict[int, set[int]] = {}
        root: dict[int, int] = {}
        found = []

        def of(k: int) -> set[int]:
            if k not in sets:
                sets[k] = set(shingle_sets([text[k]])[0].tolist())
            return sets[k]

        def top(c: int) -> int:
            while c in root:
                c = root[c]
            return c

        for k, near in _partners(group):
            for j in near.tolist():
                a, b = top(comp[j]), top(comp[k])
                if a == b:
                    continue
                x, y = of(j), of(k)
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    root[max(a, b)] = min(a, b)
                    found.append((max(node[j], node[k]), min(node[j], node[k])))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["u", "v"]) if found else None

    return _each_task(collided.select(*columns, "text"), confirm, "u long, v long").distinct()


def _same_documents(named: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (u, v) between the sets that rows of one doc_id have."""
    sets = named.groupBy("doc_id").agg(F.min("set_id").alias("one"), F.max("set_id").alias("last")).where("one <> last").select("doc_id", "one")
    pairs = named.select("doc_id", "set_id").join(sets, "doc_id").where("set_id <> one").select("set_id", "one").distinct()
    node = classes.select("set_id", "node")
    return pairs.join(node.withColumnRenamed("node", "u"), "set_id").join(node.select(F.col("set_id").alias("one"), F.col("node").alias("v")), "one").select("u", "v")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of docs (doc_id, text).

    Documents are linked where 100 * intersection >= percent * union of their 5-word shingle sets; component_id is the
    least doc_id reachable over links, kept where that is the document itself. Null and empty texts have no shingles and
    are linked with nothing. Rows of equal doc_id count as linked, whatever their texts; those of null doc_id are kept, with
    a null component. An empty table gives no row. percent is 75 or more: the threshold of collisions is made for that.
    """
    if percent < 75:
        raise ValueError("the threshold of collisions finds similarities of 75 % or more")
    signed = sign(docs)
    named = signed.where("doc_id IS NOT NULL")
    classes = named.groupBy("set_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("least"), F.max("n_shingles").alias("n"), F.first("signature").alias("signature"))
    # ids are given as the table is written, so they are the same whenever it is read
    classes = written(classes.select(F.monotonically_increasing_id().alias("node"), "set_id", "n", "least.*", "signature"), "classes")
    nodes = classes.where("n > 0")
    posts = _merged(_posted(nodes))
    lists = posts.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("size")).where("size > 1")
    posts = written(posts.join(lists.select("key", "least"), "key"), "lists")
    # of the nodes that meet another in some list, signatures, texts and the coordinates they keep; all that follows joins with these
    number = F.col("key").bitwiseAND(F.lit(int(_NUMBER)))
    bit = lambda low: F.when((number >= low) & (number < low + 64), F.expr(f"shiftleft(1L, CAST((key & {int(_NUMBER)}) - {low} AS INT))")).otherwise(F.lit(0).cast("long"))
    met = posts.groupBy("node").agg(F.bit_or(bit(0)).alias("low"), F.bit_or(bit(64)).alias("high"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash(F.col("text")).alias("text_hash"), "text")
    met = written(met.join(nodes.select("node", "doc_id", "text_hash", "signature", "n"), "node").join(texts, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"]).drop("doc_id", "text_hash"), "met")
    first = _close(posts.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct(), met.select("node", "signature"))
    edges = written(_confirmed(first, met.select("node", "text"), percent).unionByName(_same_documents(named, classes)), "links")
    comps = written(components(edges), "components")

    labelled = posts.select("key", "node").join(met.select("node", "n"), "node").join(comps, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("comp"))
    sided = written(_sided(labelled), "sided")
    second = written(_linked(sided, met.drop("n"), percent), "links")
    if second.take(1):
        comps = written(components(edges.unionByName(second)), "components")
    ids = classes.select("node", F.col("doc_id").alias("doc"))
    least = comps.join(ids, "node").groupBy("component").agg(F.min("doc").alias("component_id"))
    of_class = comps.join(least, "component").select("node", "component_id")
    of_class = classes.select("set_id", "node", "doc_id").join(of_class, "node", "left").select("set_id", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "set_id").join(of_class, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """docs, all columns, less the rows that are not the least of their component; repeated rows of one doc_id stay together.

    Only the ids to drop are joined, so rows are compared by doc_id alone; rows of null doc_id stay.
    """
    name = "_".join(["gone", *docs.columns])  # no column of docs can have this name
    gone = near_duplicates(docs, percent).where("NOT kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs["doc_id"] == gone[name], "left_anti")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[k:k + 4], chr(32)) AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS k FROM w WHERE len(words) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)
), sym AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, sym.b FROM reach JOIN sym ON reach.b = sym.a
), c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT c.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, c.doc_id = c.component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
