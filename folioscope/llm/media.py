"""Payloads in ISO media containers, and the columns that walking such a container gives.

``write_container`` stores bytes as 8-bit samples of one audio track; ``read_container`` walks the nested boxes of any
such file, decodes each track's sample tables, and reports codec, duration and the byte ranges of key frames without decoding a
payload. What a file says of itself is checked against its length before anything of that size is made. Null text counts as
empty; equal texts give equal rows; a malformed container gives an ``error`` text. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, map_batches

UNIT, SAMPLE, CHUNK, KEY_EVERY, RATE = 64, 64, 64, 16, 8000
#: Boxes that hold boxes.
CONTAINERS = frozenset({b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"moof", b"traf", b"mvex"})


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0, version: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def write_container(payload: bytes) -> bytes:
    """A file whose media data is ``payload``, a multiple of ``SAMPLE`` bytes, one sample every ``SAMPLE`` bytes."""
    if not payload or len(payload) % SAMPLE:
        raise ValueError("the payload must be a positive multiple of the sample size")
    n = len(payload) // SAMPLE
    chunks, last = -(-n // CHUNK), n % CHUNK
    keys = np.arange(1, n + 1, KEY_EVERY, dtype=">u4")
    runs = [(1, CHUNK, 1)] if not last else [(1, last, 1)] if chunks == 1 else [(1, CHUNK, 1), (chunks, last, 1)]
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    duration = n * SAMPLE
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isom", b"iso2")

    def moov(first: int) -> bytes:
        wide = first + len(payload) > 0xFFFFFFFF
        offsets = first + np.arange(chunks, dtype=np.int64) * CHUNK * SAMPLE
        entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, SAMPLE)),
            _full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", struct.pack(">II", SAMPLE, n)),
            _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
        )
        dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        minf = _box(b"minf", _full(b"smhd", bytes(4)), dinf, stbl)
        mdhd = _full(b"mdhd", struct.pack(">QQIQ", 0, 0, RATE, duration), struct.pack(">HH", 0x55C4, 0), version=1)
        hdlr = _full(b"hdlr", bytes(4), b"soun", bytes(12), b"sound\0")
        tkhd = _full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, duration), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), matrix, bytes(8), flags=7, version=1)
        mvhd = _full(b"mvhd", struct.pack(">QQIQ", 0, 0, RATE, duration), struct.pack(">IH", 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2), version=1)
        return _box(b"moov", mvhd, _box(b"trak", tkhd, _box(b"mdia", mdhd, hdlr, minf)))

    head = 8 if len(payload) + 8 <= 0xFFFFFFFF else 16
    first = len(ftyp) + len(moov(0)) + head
    mdat = struct.pack(">I4s", 8 + len(payload), b"mdat") if head == 8 else struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload))
    return ftyp + moov(first) + mdat + payload


def walk(data: bytes):
    """Kind, track, body start and body end of every box, outer boxes first and in the order of the file, however deep they are
    nested. The track is the number of the track box around it, 0 outside of any. A size that does not fit raises ValueError."""
    todo, tracks = [(0, len(data), 0)], 0
    while todo:
        start, end, track = todo.pop()
        if start + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if start + 16 > end:
                raise ValueError("a box is cut off")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError(f"box {kind!r} does not fit")
        todo.append((start + size, end, track))
        if kind == b"trak":
            track = tracks = tracks + 1
        yield kind, track, body, start + size
        if kind in CONTAINERS:
            todo.append((body, start + size, track))


def _table(data: bytes, body: int, end: int, kind: str, width: int = 1) -> np.ndarray:
    """Entries of a sample table, as many as it says, all of which must lie within its box."""
    (n,) = struct.unpack_from(">I", data, body + 4)
    if body + 8 + n * width * int(kind[-1]) > end:
        raise ValueError("a sample table is cut off")
    return np.frombuffer(data, kind, n * width, body + 8).reshape(n, width).astype(np.int64)


def _track(data: bytes, found: dict[bytes, tuple[int, int]]) -> dict:
    if missing := {b"mdhd", b"stsd", b"stts", b"stsc", b"stsz"} - found.keys():
        raise ValueError(f"no box {sorted(missing)}")
    at, _ = found[b"mdhd"]
    scale, duration = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
    at, end = found[b"stsd"]
    if at + 16 > end or not scale:
        raise ValueError("no codec or no time scale")
    codec = data[at + 12 : at + 16].decode("latin-1")
    at, end = found[b"stsz"]
    same, n = struct.unpack_from(">II", data, at + 4)
    if n * (same or 4) > (len(data) if same else end - at - 12):
        raise ValueError("more samples than the file can hold")
    sizes = np.full(n, same, np.int64) if same else np.frombuffer(data, ">u4", n, at + 12).astype(np.int64)
    if b"co64" in found:
        chunks = _table(data, *found[b"co64"], ">u8")[:, 0]
    elif b"stco" in found:
        chunks = _table(data, *found[b"stco"], ">u4")[:, 0]
    else:
        raise ValueError("no chunk offsets")
    runs = _table(data, *found[b"stsc"], ">u4", 3)
    times = np.diff(np.append(runs[:, 0], len(chunks) + 1))
    if (times < 0).any() or (len(runs) and runs[0, 0] != 1):
        raise ValueError("the chunk runs are out of order")
    per = np.repeat(runs[:, 1], times)
    if per.sum() != n or len(per) != len(chunks):
        raise ValueError("the sample tables disagree")
    ahead = np.concatenate(([0], np.cumsum(sizes)))
    first = np.concatenate(([0], np.cumsum(per)))[:-1].astype(np.int64)
    place = np.repeat(chunks - ahead[first], per) + ahead[:-1]
    if n and ((place < 0).any() or (place + sizes > len(data)).any()):
        raise ValueError("a sample lies outside the file")
    times = _table(data, *found[b"stts"], ">u4", 2)
    keys = _table(data, *found[b"stss"], ">u4")[:, 0] - 1 if b"stss" in found else np.arange(n)
    if len(keys) and (keys.min() < 0 or keys.max() >= n):
        raise ValueError("a key frame has no sample")
    return {"codec": codec, "timescale": scale, "duration": duration, "sample_time": int((times[:, 0] * times[:, 1]).sum()), "place": place, "size": sizes, "keys": keys}


def read_tracks(data: bytes) -> list[dict]:
    """Codec, time scale, duration and, for each sample of each track, its place, size and whether it is a key frame. Each track is
    described by its own boxes; a track whose boxes do not fit together raises ValueError, as does a file without any, or one in fragments,
    whose samples are not in these tables."""
    tracks: dict[int, dict[bytes, tuple[int, int]]] = {}
    for kind, track, body, end in walk(data):
        if kind == b"moof":
            raise ValueError("samples in fragments are not read")
        if track:
            tracks.setdefault(track, {}).setdefault(kind, (body, end))
    if not tracks:
        raise ValueError("no track")
    return [_track(data, found) for _, found in sorted(tracks.items())]


def read_container(data: bytes) -> dict:
    """The first track."""
    return read_tracks(data)[0]


def key_ranges(info: dict) -> np.ndarray:
    """First and last-plus-one byte of each key frame."""
    at, size = info["place"][info["keys"]], info["size"][info["keys"]]
    return np.stack([at, at + size], axis=1)


def stored_payload(data: bytes, info: dict) -> bytes:
    """The samples' bytes in order; adjacent samples are read at once."""
    place, size = info["place"], info["size"]
    breaks = np.flatnonzero(place[1:] != place[:-1] + size[:-1]) + 1
    return b"".join(data[place[a] : place[b - 1] + size[b - 1]] for a, b in zip([0, *breaks], [*breaks, len(place)], strict=True))


def feature(info: dict) -> str:
    """Codec, duration and the key frames' byte ranges, the latter counted and summed up in a checksum."""
    ranges = key_ranges(info)
    first = f"{ranges[0, 0]}-{ranges[0, 1]}" if len(ranges) else ""
    return f"codec={info['codec'].strip()};seconds={info['duration'] / info['timescale']:.6f};samples={len(info['size'])};keyframes={len(ranges)};key_bytes={int((ranges[:, 1] - ranges[:, 0]).sum())};first_key={first};key_crc32={zlib.crc32(ranges.astype('<i8').tobytes())}"


RANGES = "array<struct<begin:bigint,end:bigint>>"
_RANGE = pa.struct([("begin", pa.int64()), ("end", pa.int64())])


def _range_lists(lists: list[np.ndarray | None]) -> pa.Array:
    ends = np.cumsum([0, *(0 if x is None else len(x) for x in lists)])
    flat = np.concatenate([np.empty((0, 2), np.int64), *(x for x in lists if x is not None)])
    made = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], fields=list(_RANGE))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), made, mask=pa.array([x is None for x in lists]))


def media_columns(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """``codec, duration_s, keyframes`` (array of begin and end bytes) of the first track, the same of all ``tracks`` and ``error`` for
    each container; null, and a file that cannot be read, gives nulls and an error."""

    def work(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c: [] for c in ("codec", "duration_s", "keyframes", "tracks", "error")}
        for media in batch.column("media").to_pylist():
            row = (None, None, None, None, "no container")
            if media is not None:
                try:
                    tracks = [{"codec": i["codec"], "duration_s": i["duration"] / i["timescale"], "keyframes": [{"begin": a, "end": b} for a, b in key_ranges(i).tolist()]} for i in read_tracks(media)]
                    row = (*tracks[0].values(), tracks, None)
                except (ValueError, struct.error) as e:
                    row = (None, None, None, None, str(e) or type(e).__name__)
            for c, v in zip(out, row, strict=True):
                out[c].append(v)
        return {"doc_id": batch.column("doc_id"), **out}

    schema = f"doc_id bigint, codec string, duration_s double, keyframes {RANGES}, tracks array<struct<codec:string,duration_s:double,keyframes:{RANGES}>>, error string"
    return map_batches(df.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"cast(`{media_col}` as binary) media"), schema, work)


def store_documents(df: DataFrame, keep_media: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored in a container, read back, and described; ``media`` is the file itself if it is to be kept."""
    schema = f"doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, codec string, duration_s double, keyframes {RANGES}"
    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "duration_s", "keyframes", "media")

    def work(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c: [] for c in names}
        for text in batch.column("text").to_pylist():
            raw = text.encode()
            media = write_container(raw + bytes(-len(raw) % UNIT if raw else UNIT))
            info = read_container(media)
            back = stored_payload(media, info)
            row = (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(info), info["codec"].strip(), info["duration"] / info["timescale"], key_ranges(info), media if keep_media else None)
            for c, v in zip(names, row, strict=True):
                out[c].append(v)
        return {"doc_id": batch.column("doc_id"), **out, "keyframes": _range_lists(out["keyframes"])}

    return map_batches(id_and_text(df, id_col, text_col), schema + ", media binary" * keep_media, work)
