"""Media columns: ISO media containers, read by walking boxes and sample tables; payloads are never decoded."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, bounded_batches, per_row, table, task, written

#: Boxes that hold boxes; meta has four bytes of its own before them, but in some older files. stsd and dref are read as tables.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"dinf", b"stbl", b"edts", b"udta", b"mvex", b"moof", b"traf", b"meta"}
#: Track handlers by name.
HANDLERS = {b"soun": "audio", b"vide": "video", b"hint": "hint", b"meta": "metadata", b"text": "text"}
SAMPLE, RATE, PER_CHUNK, SYNC_EVERY = 64, 8000, 32, 16


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def build_container(payload: bytes, sample: int = SAMPLE, rate: int = RATE, per_chunk: int = PER_CHUNK, sync_every: int = SYNC_EVERY) -> bytes:
    """A file of one track of unsigned 8-bit samples holding payload as it is.

    A unit of the sample table is a block of ``sample`` bytes; every ``sync_every``-th is marked as a key unit and
    ``per_chunk`` of them lie together. len(payload) must be a multiple of sample.
    """
    if len(payload) % sample:
        raise ValueError("payload must be whole samples")
    n, identity = len(payload) // sample, struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    chunks, rest = -(-n // per_chunk), n % per_chunk
    brand = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    media_at = len(brand) + 16
    large = media_at + len(payload) > 0xFFFFFFFF
    entry = _box(b"raw ", bytes(6), struct.pack(">HQHHHHI", 1, 0, 1, 8, 0, 0, rate << 16))
    runs = [(1, per_chunk, 1)] * (chunks > bool(rest)) + [(chunks, rest, 1)] * bool(rest)
    offsets = [media_at + k * per_chunk * sample for k in range(chunks)]
    sync = range(1, n + 1, sync_every)
    tables = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), entry),
        _full(b"stts", struct.pack(">III", 1, n, sample) if n else struct.pack(">I", 0)),
        _full(b"stss", struct.pack(f">I{len(sync)}I", len(sync), *sync)),
        _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        _full(b"stsz", struct.pack(">II", sample, n)),
        _full(b"co64" if large else b"stco", struct.pack(f">I{chunks}{'Q' if large else 'I'}", chunks, *offsets)),
    )
    long = n * sample > 0xFFFFFFFF
    span = struct.pack(">QQIQ" if long else ">IIII", 0, 0, rate, n * sample)
    head = _full(b"mvhd", span, struct.pack(">IH10x", 0x10000, 0x100), identity, bytes(24), struct.pack(">I", 2), version=int(long))
    track = _full(b"tkhd", struct.pack(">QQIIQ" if long else ">IIIII", 0, 0, 1, 0, n * sample), bytes(8), struct.pack(">hhHH", 0, 0, 0x100, 0), identity, bytes(8), version=int(long), flags=3)
    media = _box(
        b"mdia",
        _full(b"mdhd", span, struct.pack(">HH", 0x55C4, 0), version=int(long)),
        _full(b"hdlr", bytes(4), b"soun", bytes(12), b"samples\0"),
        _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), tables),
    )
    return b"".join((brand, struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16), payload, _box(b"moov", head, _box(b"trak", track, media))))


def walk(data: bytes, begin: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, start of body, end of body) of each box, outer before inner.

    Sizes of 32 and 64 bits, to the end of the file and of uuid boxes are read; ValueError where a box passes its parent's end.
    """
    end = len(data) if end is None else end
    while begin < end:
        if end - begin < 8:
            raise ValueError("box header cut off")
        size, kind = struct.unpack_from(">I4s", data, begin)
        body = begin + 8
        if size == 1:
            if end - begin < 16:
                raise ValueError("box header cut off")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - begin
        if kind == b"uuid":
            body += 16
        if size < body - begin or begin + size > end:
            raise ValueError(f"box {kind!r} passes its parent's end")
        yield (*path, kind), body, begin + size
        if kind in NESTED:
            own = 4 if kind == b"meta" and data[body + 4 : body + 8] != b"hdlr" else 0
            yield from walk(data, min(body + own, begin + size), begin + size, (*path, kind))
        begin += size


def _times(data: bytes, at: int) -> tuple[int, int]:
    """Time scale and duration of an mvhd or mdhd box."""
    return struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)


def _ints(data: bytes, at: int, n: int, kind: str, end: int) -> tuple[int, ...]:
    if at + n * struct.calcsize(kind) > end:
        raise ValueError("table cut off")
    return struct.unpack_from(f">{n}{kind}", data, at)


def tracks(data: bytes) -> list[dict]:
    """For each track: codec, handler, time scale, duration, sample sizes and offsets, key samples and their byte ranges.

    Samples of fragments follow those of the track's own tables.
    """
    found: list[dict] = []
    fragments: list[tuple[int, int, int, bytes]] = []
    extends: dict[int, tuple[int, ...]] = {}
    moof = 0
    for path, at, end in walk(data):
        kind = path[-1]
        if kind == b"moof":
            moof = at - 8
        elif path[:2] == (b"moof", b"traf"):
            fragments.append((moof, at, end, kind))
        elif kind == b"trex":
            number, *defaults = _ints(data, at + 4, 5, "I", end)
            extends[number] = tuple(defaults[1:])
        elif kind == b"tkhd" and found:
            found[-1]["id"] = struct.unpack_from(">I", data, at + (20 if data[at] == 1 else 12))[0]
        if kind == b"trak":
            found.append({"codec": "", "handler": "", "scale": 0, "duration": 0})
        elif not found or path[:2] != (b"moov", b"trak"):
            continue
        track = found[-1]
        if kind == b"mdhd":
            track["scale"], track["duration"] = _times(data, at)
        elif kind == b"hdlr":
            track["handler"] = HANDLERS.get(data[at + 8 : at + 12], "other")
        elif kind == b"stsd" and struct.unpack_from(">I", data, at + 4)[0]:
            track["codec"] = data[at + 12 : at + 16].decode("latin-1")
        elif kind == b"stsz":
            same, n = struct.unpack_from(">II", data, at + 4)
            track["sizes"] = (same, n) if same else _ints(data, at + 12, n, "I", end)
            track["same"], track["n"] = bool(same), n
        elif kind == b"stz2":
            width, n = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
            raw = data[at + 12 : end]
            track["sizes"] = tuple(raw[k // 2] >> 4 * (1 - k % 2) & 15 for k in range(n)) if width == 4 else _ints(data, at + 12, n, "B" if width == 8 else "H", end)
            track["same"], track["n"] = False, n
        elif kind in (b"stco", b"co64"):
            track["chunks"] = _ints(data, at + 8, struct.unpack_from(">I", data, at + 4)[0], "I" if kind == b"stco" else "Q", end)
        elif kind == b"stsc":
            n = struct.unpack_from(">I", data, at + 4)[0]
            flat = _ints(data, at + 8, 3 * n, "I", end)
            track["runs"] = [(flat[k], flat[k + 1]) for k in range(0, 3 * n, 3)]
        elif kind == b"stts":
            n = struct.unpack_from(">I", data, at + 4)[0]
            flat = _ints(data, at + 8, 2 * n, "I", end)
            track["ticks"] = sum(a * b for a, b in zip(flat[::2], flat[1::2], strict=True))
        elif kind == b"stss":
            track["sync"] = _ints(data, at + 8, struct.unpack_from(">I", data, at + 4)[0], "I", end)
    for track in found:
        _ranges(track, len(data))
    _add_fragments(data, {t["id"]: t for t in found if "id" in t}, fragments, extends)
    return found


def _add_fragments(data: bytes, tracks: dict[int, dict], boxes: list[tuple[int, int, int, bytes]], extends: dict[int, tuple[int, ...]]) -> None:
    """Samples of track fragments: sizes, durations and flags from trun, else tfhd, else trex; offsets from the fragment's base."""
    track, header, offset, moof_end = None, {}, 0, {}
    for moof, at, end, kind in boxes:
        if kind == b"tfhd":
            flags, number = struct.unpack_from(">I", data, at)[0] & 0xFFFFFF, struct.unpack_from(">I", data, at + 4)[0]
            place, header = at + 8, dict(zip(("duration", "size", "flags"), extends.get(number, (0, 0, 0)), strict=True))
            base = moof if flags & 0x20000 else moof_end.get(moof, moof)
            for bit, name, form in ((1, "base", "Q"), (2, "description", "I"), (8, "duration", "I"), (16, "size", "I"), (32, "flags", "I")):
                if flags & bit:
                    (header[name],) = _ints(data, place, 1, form, end)
                    place += struct.calcsize(form)
            base = header.get("base", base)
            track, offset, start = tracks.get(number), base, base
        elif kind == b"trun" and track is not None:
            flags, n = struct.unpack_from(">I", data, at)[0] & 0xFFFFFF, struct.unpack_from(">I", data, at + 4)[0]
            place = at + 8
            if flags & 1:
                (ahead,) = _ints(data, place, 1, "i", end)
                offset, place = start + ahead, place + 4
            first = header["flags"]
            if flags & 4:
                (first,) = _ints(data, place, 1, "I", end)
                place += 4
            fields = [name for bit, name in ((0x100, "duration"), (0x200, "size"), (0x400, "flags"), (0x800, "shift")) if flags & bit]
            table = _ints(data, place, n * len(fields), "I", end)
            begin = offset
            for k in range(n):
                sample = header | dict(zip(fields, table[k * len(fields) :], strict=False))
                marks = first if k == 0 and flags & 4 else sample["flags"]
                if not marks & 0x10000:  # not marked as depending on others
                    track["keys"].append((offset, sample["size"]))
                offset += sample["size"]
                track["ticks"] = track.get("ticks", 0) + sample["duration"]
            if offset > len(data):
                raise ValueError("samples pass the end of the file")
            track["n"] = track.get("n", 0) + n
            track["spans"].append((begin, offset - begin))
            moof_end[moof] = offset
    for t in tracks.values():
        t["duration"] = t["duration"] or t.get("ticks", 0)


def _ranges(track: dict, total: int) -> None:
    """Byte ranges of chunks and key samples, from the sample tables alone."""
    n, sizes = track.get("n", 0), track.get("sizes", ())
    size_of = (lambda k: sizes[0]) if track.get("same") else (lambda k: sizes[k])
    runs, sync = track.get("runs", []), track.get("sync")
    wanted = set(sync) if sync is not None else None  # no table: every sample is a key sample
    sample, run, spans, keys = 0, 0, [], []
    for chunk, offset in enumerate(track.get("chunks", ()), 1):
        while run + 1 < len(runs) and runs[run + 1][0] <= chunk:
            run += 1
        at = offset
        for _ in range(runs[run][1] if runs else 0):
            if sample >= n:
                break
            if wanted is None or sample + 1 in wanted:
                keys.append((at, size_of(sample)))
            at += size_of(sample)
            sample += 1
        if at > total:
            raise ValueError("samples pass the end of the file")
        spans.append((offset, at - offset))
    if sample != n:
        raise ValueError("sample tables disagree")
    track["spans"], track["keys"] = spans, keys


FEATURES = pa.schema(
    [
        ("codec", pa.string()), ("handler", pa.string()), ("n_tracks", pa.int64()), ("duration_s", pa.float64()), ("n_samples", pa.int64()), ("n_keyframes", pa.int64()),
        ("keyframe_ranges", pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))), ("error", pa.string()),
    ]
)
FEATURES_SQL = "codec string, handler string, n_tracks long, duration_s double, n_samples long, n_keyframes long, keyframe_ranges array<struct<offset:long,length:long>>, error string"


def features(data: bytes | None) -> tuple:
    """The FEATURES of a file's first video track, else its first; nulls and an error for null bytes and malformed files, never an
    exception."""
    try:
        if data is None:
            raise ValueError("no bytes")
        return described(tracks(data))
    except (ValueError, struct.error, IndexError) as e:
        return None, None, None, None, None, None, None, str(e)


def described(found: list[dict]) -> tuple:
    """The FEATURES of a file's tracks."""
    if not found:
        raise ValueError("no track")
    track = next((t for t in found if t["handler"] == "video"), found[0])
    seconds = track["duration"] / track["scale"] if track["scale"] else None
    return track["codec"], track["handler"], len(found), seconds, track.get("n", 0), len(track["keys"]), [{"offset": a, "length": b} for a, b in track["keys"]], None


def media_columns(df: DataFrame, content: str, key: str) -> DataFrame:
    """key and the FEATURES of each file in the binary column content. One narrow pass, no shuffle.

    Null or empty content and malformed files give a row with error set; repeated keys give a row each.
    """
    bounded_batches(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(content).alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            schema = pa.schema([b.schema.field("key"), *FEATURES])
            yield arrow_rows(schema, [(k, *features(c)) for k, c in zip(b.column("key").to_pylist(), b.column("content").to_pylist(), strict=True)])

    return rows.mapInArrow(task(run), f"key {kind}, {FEATURES_SQL}").withColumnRenamed("key", key)


def padded(text: str | None) -> bytes:
    """UTF-8 of text and zero bytes up to a positive multiple of 64."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64))


STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


def store_texts(docs: DataFrame) -> DataFrame:
    """A table (doc_id, n_bytes, media) of containers, written to the shared folder and read back. Null texts count as empty."""
    bounded_batches(docs.sparkSession)
    one = lambda k, t: (k, len((t or "").encode()), build_container(padded(t)))
    made = docs.select("doc_id", "text").mapInArrow(per_row(STORED, one, "doc_id", "text"), "doc_id long, n_bytes long, media binary")
    return written(made, "media")


DIGEST = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), *FEATURES]
)


def _digest(key: int, n_bytes: int, media: bytes) -> tuple:
    found = tracks(media)
    got = found[0]
    payload = b"".join(media[a : a + b] for a, b in got["spans"])
    row = described(found)
    ranges = hashlib.md5(repr(got["keys"]).encode()).hexdigest()
    feature = f"{row[0].strip()}/{row[1]}/{got['scale']}Hz/{got['duration']}t/{row[4]}u/{row[5]}k/{ranges}"
    return key, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, *row


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every text as a container, read the stored bytes back and describe them."""
    stored = store_texts(table(spark, sf_dir, "documents"))
    sql = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, " + FEATURES_SQL
    return stored.mapInArrow(per_row(DIGEST, _digest, "doc_id", "n_bytes", "media"), sql)
