import random

import numpy as np
import pyarrow as pa
import pytest

from ledgerlake.llm import common


def test_a_worker_drops_what_another_operator_kept(monkeypatch):
    dropped = []
    monkeypatch.setattr(common, "_kept", {"a": lambda: dropped.append("a"), "b": lambda: dropped.append("b")})
    monkeypatch.setattr(common, "_current", None)
    for name in ("a", "a", "b", None):
        list(common.task(lambda batches: batches, name)(iter([])))
    assert dropped == ["b", "a", "a", "b"]


def test_written_tables_lie_in_the_shared_folder_and_read_back(spark):
    df = spark.range(5).selectExpr("id", "CAST(NULL AS STRING) AS nothing")
    back = common.written(df, "numbers")
    assert back.dtypes == df.dtypes and sorted(r["id"] for r in back.collect()) == list(range(5))
    assert f"/ledgerlake-{spark.sparkContext.applicationId}/numbers-" in back.inputFiles()[0]
    assert common.written(df.where("false"), "none").count() == 0


def test_rows_of_no_columns_or_no_rows():
    schema = pa.schema([("a", pa.int64()), ("b", pa.string())])
    assert common.arrow_rows(schema, []).num_rows == 0
    assert common.arrow_rows(schema, [(1, None), (None, "x")]).to_pylist() == [{"a": 1, "b": None}, {"a": None, "b": "x"}]


def thue_morse(n):
    return "".join("ab"[bin(k).count("1") % 2] for k in range(n))


@pytest.mark.parametrize("seed", [5, 11, 23, 29, 41])
@pytest.mark.parametrize("n", [64, 1024, 1 << 17, 1 << 19])
def test_patterned_words_do_not_collide(seed, n):
    """Words that a polynomial modulo a power of two cannot tell apart, whatever its base."""
    one = thue_morse(n)
    other = one.translate(str.maketrans("ab", "ba"))
    hasher = common.WordHasher(seed)
    hashes = hasher.words(f"{one} {other} {one[:-1]} {one}".encode())
    assert len(set(hashes.tolist())) == 3 and hashes[0] == hashes[3]
    sequence = hasher.words(" ".join(one[:1024]).encode())
    swapped = hasher.words(" ".join(other[:1024]).encode())
    assert hasher.whole(sequence) != hasher.whole(swapped)
    assert (hasher.windows(sequence, 1024) != hasher.windows(swapped, 1024)).all()


def test_words_hash_alike_wherever_they_stand(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab \n\té") for _ in range(rng.randint(0, 90))).encode() for _ in range(50)]
    plain, folded = common.WordHasher(3), common.WordHasher(3, fold_case=True)
    want = [plain.words(w)[0] for t in texts for w in t.split()]
    assert plain.texts(texts)[0].tolist() == want
    assert folded.words(b"ABc \xc3\x89")[0] == folded.words(b"abC")[0] != plain.words(b"ABC")[0]
    monkeypatch.setattr(common.WordHasher, "CHUNK", 16)
    hashes, begins = plain.texts(texts)
    assert hashes.tolist() == want and np.diff(begins).tolist() == [len(t.split()) for t in texts]


def test_writing_a_table_gives_back_the_drivers_free_memory(spark, monkeypatch):
    done, plain = [], common.trim_driver
    monkeypatch.setattr(common, "trim_driver", lambda s: done.append(plain(s)))
    assert common.written(spark.range(3), "three").count() == 3
    assert done == [True]
