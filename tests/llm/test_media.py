import hashlib
import struct
import zlib

import pytest

from ledgerlake.llm import media

from cases import ODD


@pytest.mark.parametrize("n", [0, 1, 5, 32, 33, 64, 100])
def test_container_round_trip(n):
    payload = bytes(k % 251 for k in range(64 * n))
    data = media.build_container(payload)
    track = media.tracks(data)[0]
    assert b"".join(data[a : a + b] for a, b in track["spans"]) == payload
    assert (track["codec"], track["handler"], track["scale"], track["duration"], track["n"]) == ("raw ", "audio", 8000, 64 * n, n)
    assert track["keys"] == [(40 + 64 * k, 64) for k in range(0, n, 16)]


def box(kind, body):
    return struct.pack(">I4s", len(body) + 8, kind) + body


def test_other_forms_of_boxes_and_tables():
    body = b"ABCDEFGHIJ"
    large = struct.pack(">I4sQ", 1, b"mdat", 16 + len(body)) + body
    full = lambda *x: struct.pack(f">{len(x)}I", *x)
    stbl = box(b"stbl", box(b"stsd", full(0, 1) + box(b"avc1", bytes(70))) + box(b"stts", full(0, 2, 1, 5, 2, 7)) + box(b"stsc", full(0, 2, 1, 2, 1, 2, 1, 1)) + box(b"stz2", b"\0\0\0\0\0\0\0\x08" + full(3) + b"\4\3\3") + box(b"co64", full(0, 2) + struct.pack(">QQ", 16, 23)))
    mdhd = box(b"mdhd", b"\1\0\0\0" + bytes(16) + struct.pack(">IQ", 600, 19) + bytes(4))
    trak = box(b"trak", box(b"mdia", mdhd + box(b"hdlr", bytes(8) + b"vide" + bytes(12)) + box(b"minf", stbl)))
    data = large + box(b"uuid", bytes(16) + b"zz") + struct.pack(">I4s", 0, b"moov") + trak
    track = media.tracks(data)[0]
    assert (track["codec"], track["handler"], track["duration"], track["ticks"]) == ("avc1", "video", 19, 19)
    assert [data[a : a + b] for a, b in track["keys"]] == [b"ABCD", b"EFG", b"HIJ"]  # no stss: all are key samples


def test_fragments():
    full = lambda *x: struct.pack(f">{len(x)}I", *x)
    stbl = box(b"stbl", box(b"stsd", full(0, 1) + box(b"avc1", bytes(70))) + box(b"stts", full(0, 0)) + box(b"stsc", full(0, 0)) + box(b"stsz", full(0, 0, 0)) + box(b"stco", full(0, 0)))
    tkhd = lambda n: box(b"tkhd", full(0, 0, 0, n) + bytes(64))
    mdia = lambda h: box(b"mdia", box(b"mdhd", full(0, 0, 0, 1000, 0) + bytes(4)) + box(b"hdlr", bytes(8) + h + bytes(12)) + box(b"minf", stbl))
    trex = lambda n: box(b"trex", full(0, n, 1, 40, 3, 0x10000))
    moov = box(b"moov", box(b"trak", tkhd(1) + mdia(b"soun")) + box(b"trak", tkhd(2) + mdia(b"vide")) + box(b"mvex", trex(1) + trex(2)) + box(b"meta", full(0) + box(b"hdlr", bytes(24))))

    def moof(where):
        # track 2: sizes of its own, the first sample a key one; track 1: all defaults of trex, after it
        two = box(b"traf", box(b"tfhd", full(0x20000, 2)) + box(b"trun", full(0x205, 3, where, 0, 2, 4, 1)))
        one = box(b"traf", box(b"tfhd", full(0x20020, 1, 0)) + box(b"trun", full(0x1, 2, where + 7)))
        return box(b"moof", box(b"mfhd", full(0, 1)) + two + one)

    size = len(moof(0))
    part = moof(size + 8) + box(b"mdat", b"AABBBBCdddeee")
    data = moov + part + part
    sound, video = media.tracks(data)
    read = lambda spans: [data[a : a + b] for a, b in spans]
    assert (video["n"], video["duration"], read(video["keys"]), read(video["spans"])) == (6, 240, [b"AA", b"AA"], [b"AABBBBC"] * 2)
    assert (sound["n"], read(sound["keys"]), read(sound["spans"])) == (4, [b"ddd", b"eee"] * 2, [b"dddeee"] * 2)
    row = media.features(data)
    assert row[:6] == ("avc1", "video", 2, 0.24, 6, 2) and row[7] is None
    assert media.features(data[:-1] if len(data) else data)[7] is not None


def test_malformed_files_give_errors(spark):
    good = media.build_container(bytes(640))
    rows = [(1, good), (2, None), (3, b""), (4, b"\0\0\0\4moov"), (5, good[:-9]), (6, b"junk" * 30), (7, good[:700])]
    got = {r["id"]: r for r in media.media_columns(spark.createDataFrame(rows, "id long, content binary"), "content", "id").collect()}
    assert got[1]["error"] is None and got[1]["n_keyframes"] == 1 and got[1]["keyframe_ranges"][0]["offset"] == 40
    assert all(got[k]["error"] for k in range(2, 8))


def test_query_columns(docs, odd):
    rows = media.store_texts(odd).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        d = media._digest(r["doc_id"], r["n_bytes"], bytes(r["media"]))
        text = next(t for k, t in ODD if k == r["doc_id"] and len((t or "").encode()) == r["n_bytes"])
        want = media.padded(text)
        assert d[2] == len(want) and len(want) % 64 == 0 and d[3] == hashlib.sha256(want).hexdigest() and d[4] == zlib.crc32(want[-64:])
    assert media.store_texts(docs([])).count() == 0
