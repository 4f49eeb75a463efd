"""Media columns (5): ISO base media containers are walked box by box; the sample tables give codec, duration and byte ranges of keyframes."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricegrain.llm.common import id_type

UNIT, SAMPLES_A_CHUNK, KEYFRAME_EVERY, TIMESCALE = 64, 16, 8, 8000
#: Boxes that hold nothing but boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"mvex", b"moof", b"traf"}


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I", 8 + len(body)) + kind + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + b"\0" * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def build(payload: bytes) -> bytes:
    """A file with one sound track of unsigned 8-bit samples ('raw '), 64 of them to an access unit, whose bytes are payload."""
    n = len(payload) // UNIT
    duration = n * UNIT
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = _box(b"raw ", b"\0" * 6, struct.pack(">H", 1), b"\0" * 8, struct.pack(">HHHHI", 1, 8, 0, 0, TIMESCALE << 16))
    chunks = -(-n // SAMPLES_A_CHUNK)
    last = n - (chunks - 1) * SAMPLES_A_CHUNK
    runs = [(1, SAMPLES_A_CHUNK, 1)] * (chunks > 1 or last == SAMPLES_A_CHUNK) + [(chunks, last, 1)] * (last != SAMPLES_A_CHUNK)
    keys = range(1, n + 1, KEYFRAME_EVERY)

    def moov(offset: int) -> bytes:
        table = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, UNIT)),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", struct.pack(">II", UNIT, n)),
            _full(b"stco", struct.pack(">I", chunks), struct.pack(f">{chunks}I", *(offset + i * SAMPLES_A_CHUNK * UNIT for i in range(chunks)))),
            _full(b"stss", struct.pack(f">{len(keys) + 1}I", len(keys), *keys)),
        )
        media = _box(
            b"mdia",
            _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, duration, 0x55C4, 0)),
            _full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"\0"),
            _box(b"minf", _full(b"smhd", b"\0" * 4), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), table),
        )
        track = _box(b"trak", _full(b"tkhd", struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, duration, 0, 0, 0x0100, 0), matrix, b"\0" * 8, flags=3), media)
        return _box(b"moov", _full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, TIMESCALE, duration, 0x10000, 0x0100), matrix, b"\0" * 24, struct.pack(">I", 2)), track)

    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    offset = len(head) + len(moov(0)) + 8
    return head + moov(offset) + _box(b"mdat", payload)


def boxes(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, first byte, end) of each box's content; sizes of 64 bits and 'to the end' too."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if start + 16 > end:
                raise ValueError(f"box {kind!r} at {start} is cut off")
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} at {start} has a bad size")
        yield kind, start + head, start + size
        start += size


def _tracks(data: bytes) -> list[dict[bytes, tuple[int, int]]]:
    """The boxes of each track by kind: (first byte, end) of their content. Fragmented files, whose samples lie in moof
    boxes in place of tables, are an error."""
    tracks: list[dict[bytes, tuple[int, int]]] = []
    todo = [(0, len(data), None)]
    while todo:
        start, end, track = todo.pop()
        for kind, a, b in boxes(data, start, end):
            if kind in (b"moof", b"mvex"):
                raise ValueError("fragmented file")
            own = track
            if kind == b"trak":
                tracks.append(own := {})
            elif own is not None:
                own.setdefault(kind, (a, b))
            if kind in NESTED:
                todo.append((a, b, own))
    return tracks


def _field(data: bytes, track: dict, kind: bytes, form: str, at: int = 0) -> tuple:
    """Numbers at a place of a box's content, which must lie within the box."""
    if kind not in track:
        raise ValueError(f"no box {kind!r}")
    a, b = track[kind]
    one = struct.Struct(">" + form)
    if a + at + one.size > b:
        raise ValueError(f"box {kind!r} is cut off")
    return one.unpack_from(data, a + at)


def _table(data: bytes, track: dict, kind: bytes, width: int, columns: int = 1, at: int = 4) -> np.ndarray:
    """The list in a box as int64 [entries, columns]: its number of entries is checked against the box before it is read."""
    (n,) = _field(data, track, kind, "I", at)
    a, b = track[kind]
    a += at + 4
    if n * columns * width > b - a:
        raise ValueError(f"table {kind!r} is cut off")
    found = np.frombuffer(data, dtype=f">u{width}", count=n * columns, offset=a)
    if width == 8 and (found >> 62).any():
        raise ValueError(f"table {kind!r} points beyond any file")
    return found.astype(np.int64).reshape(n, columns)


def walk(data: bytes) -> dict:
    """codec, timescale, duration (seconds), n_samples, samples and keyframes as arrays of (offset, size), of the first track.

    The payload is not touched. Every size, count, place and number is checked against the box or the file before it is
    used: a file without a track, a fragmented one, or one with broken boxes or tables raises ValueError and nothing else.
    """
    tracks = _tracks(data)
    if not tracks:
        raise ValueError("no track")
    track = tracks[0]
    (version,) = _field(data, track, b"mdhd", "B")
    timescale, duration = _field(data, track, b"mdhd", "IQ", 20) if version else _field(data, track, b"mdhd", "II", 12)
    (codec,) = _field(data, track, b"stsd", "4s", 12)
    each, n = _field(data, track, b"stsz", "II", 4)
    if each and n * each > len(data):
        raise ValueError("more samples than bytes")
    sizes = np.full(n, each, dtype=np.int64) if each else _table(data, track, b"stsz", 4, at=8)[:, 0]
    chunks = (_table(data, track, b"stco", 4) if b"stco" in track else _table(data, track, b"co64", 8))[:, 0]
    runs = _table(data, track, b"stsc", 4, 3)
    first, per = runs[:, 0], runs[:, 1]
    if len(runs) and (first[0] != 1 or (np.diff(first) <= 0).any() or first[-1] > len(chunks) or (per > n).any()):
        raise ValueError("the chunk runs don't agree")
    held = np.repeat(per, np.diff(np.append(first, len(chunks) + 1))) if len(runs) else np.zeros(len(chunks), dtype=np.int64)
    if int(held.sum()) != n:
        raise ValueError("the sample tables don't agree")
    before = np.cumsum(sizes) - sizes  # bytes of the samples before each
    lead = np.cumsum(held) - held  # samples of the chunks before each
    lead = np.where(held > 0, np.minimum(lead, max(n - 1, 0)), 0)
    at = np.repeat(chunks - (before[lead] if n else 0), held) + before
    if n and int((at + sizes).max()) > len(data):
        raise ValueError("a sample lies beyond the end")
    samples = np.stack([at, sizes], axis=1)
    keys = _table(data, track, b"stss", 4)[:, 0] if b"stss" in track else np.arange(1, n + 1)
    if len(keys) and (keys.min() < 1 or keys.max() > n):
        raise ValueError("a keyframe is no sample")
    return {"codec": codec.decode("latin-1"), "timescale": timescale, "duration": duration / timescale if timescale else 0.0, "n_samples": n, "samples": samples, "keyframes": samples[keys - 1]}


def payload_of(data: bytes, found: dict) -> bytes:
    """The samples' bytes one after another; those that adjoin in the file are one piece."""
    at, size = found["samples"].T
    if not len(at):
        return b""
    new = np.flatnonzero(at[1:] != at[:-1] + size[:-1]) + 1
    starts, ends = at[np.concatenate([[0], new])], (at + size)[np.concatenate([new - 1, [len(at) - 1]])]
    return b"".join(data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True))


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each whole text, padded with zero bytes to a positive multiple of 64, as a media file. Null is
    empty; repeated rows give repeated files; other columns are left out."""
    own, sent, kind = id_type(docs, id_col)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[[id_col, "n_bytes"]].assign(media=[build(pad(t)) for t in pdf[text_col]])

    text = F.coalesce(F.col(text_col), F.lit(""))
    stored = docs.select(own.alias(id_col), text.alias(text_col), F.octet_length(text).cast("long").alias("n_bytes")).mapInPandas(make, f"`{id_col}` {sent}, n_bytes long, media binary")
    return stored.withColumn(id_col, F.col(id_col).cast(kind))


MEDIA_SCHEMA = "codec string, duration double, n_samples long, keyframes array<struct<offset:long,size:long>>, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string, error string"


def media_columns(files: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id, codec, duration, n_samples, keyframes, payload_bytes, payload_sha256, tail_crc32, feature, error) of each file.

    The stored bytes that the sample tables point to are digested, not decoded. A file that cannot be walked, null or
    empty ones too, has nulls and the reason in error; a feature is never null. Samples may overlap, in which case their
    bytes count as often as they are pointed to, up to the length of the file; beyond that a file is unreadable. Rows are
    read one by one: repeated rows and ids, null ids too, give repeated rows, an empty table none, and other columns are
    left out, whatever their names.
    """
    own, sent, kind = id_type(files, id_col)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, data in zip(pdf[id_col].tolist(), pdf[media_col], strict=True):
                try:
                    found = walk(data or b"")
                    if int(found["samples"][:, 1].sum()) > len(data or b""):
                        raise ValueError("more sample bytes than the file has")
                except ValueError as e:
                    rows.append((doc, None, None, None, None, None, None, None, "unreadable", str(e)))
                    continue
                stored, keys = payload_of(data, found), found["keyframes"].tolist()
                ranges = zlib.crc32(",".join(f"{a}+{n}" for a, n in keys).encode())
                feature = f"{found['codec'].strip()};{found['duration']:.6f}s;samples={found['n_samples']};keyframes={len(keys)};ranges={ranges:08x}"
                rows.append((doc, found["codec"], found["duration"], found["n_samples"], [{"offset": a, "size": n} for a, n in keys], len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-UNIT:]), feature, None))
            out = pd.DataFrame(rows, columns=[id_col, "codec", "duration", "n_samples", "keyframes", "payload_bytes", "payload_sha256", "tail_crc32", "feature", "error"])
            yield out.astype({c: "Int64" for c in ("n_samples", "payload_bytes", "tail_crc32")})

    found = files.select(own.alias(id_col), media_col).mapInPandas(read, f"`{id_col}` {sent}, {MEDIA_SCHEMA}")
    return found if sent == kind else found.withColumn(id_col, F.col(id_col).cast(kind))
