"""Files with broken bytes are unreadable, never an error of the job."""

from __future__ import annotations

import random
import struct

import numpy as np
import pytest

from pricegrain.llm import media


def mutated(rng, data):
    out = bytearray(data)
    head = data.index(b"mdat")
    kind = rng.randrange(4)
    if kind == 0:
        for _ in range(rng.randint(1, 3)):
            out[rng.randrange(head)] = rng.randrange(256)
    elif kind == 1:
        at = rng.randrange(head - 4)
        out[at : at + 4] = struct.pack(">I", rng.choice([0, 1, 2, 3, 0x7FFFFFFF, 0x80000000, 0xFFFFFFFF, rng.randrange(1 << 32)]))
    elif kind == 2:
        out = out[: rng.randrange(len(out))]
    else:
        at = rng.randrange(head)
        out = out[:at] + rng.randbytes(rng.randint(1, 20)) + out[at:]
    return bytes(out)


def test_fuzz():
    rng = random.Random(0)
    files = [media.build(media.pad("x" * n)) for n in (0, 100, 1500, 5000)]
    read = 0
    for i in range(6000):
        data = mutated(rng, files[i % 4])
        try:
            found = media.walk(data)
        except ValueError:
            continue
        read += 1
        at, size = found["samples"].T
        assert len(at) == found["n_samples"] and all(at + size <= len(data))
    assert read > 100


def test_broken_rows_in_a_job(spark):
    rng = random.Random(1)
    data = media.build(media.pad("y" * 3000))
    rows = [(i, mutated(rng, data)) for i in range(300)] + [(1000, data), (1000, data), (None, data), (1001, None), (1002, b"")]
    got = media.media_columns(spark.createDataFrame(rows, "doc_id long, media binary")).collect()
    assert len(got) == len(rows) and all((r.error is None) == (r.feature != "unreadable") for r in got)
    assert sum(r.doc_id == 1000 and r.payload_bytes == 3008 for r in got) == 2


def patched(kind, at, value):
    data = bytearray(media.build(media.pad("z" * 2000)))
    where = data.index(kind) + 4 + at
    data[where : where + 4] = struct.pack(">I", value)
    return bytes(data)


@pytest.mark.parametrize(("kind", "at", "value"), [(b"stss", 8, 0), (b"stss", 8, 1000), (b"stsz", 8, 1 << 30), (b"stsz", 4, 1 << 31), (b"stsc", 8, 0), (b"stsc", 8, 3), (b"stco", 8, 1 << 31), (b"stco", 4, 1 << 31), (b"stsc", 12, 1 << 31)])
def test_bad_numbers(kind, at, value):
    with pytest.raises(ValueError):
        media.walk(patched(kind, at, value))


def test_fragments_are_told():
    with pytest.raises(ValueError, match="fragmented"):
        media.walk(media.build(media.pad("a")) + media._box(b"moof", media._box(b"traf")))


def test_scattered_chunks_and_sizes():
    """Two chunks out of order, samples of different sizes, offsets of 64 bits."""
    parts = [b"aaa", b"b", b"cccc", b"dd"]
    payload = parts[2] + parts[3] + b"--" + parts[0] + parts[1]
    def file(offset):
        table = media._box(
            b"stbl", media._full(b"stsd", struct.pack(">I", 1), media._box(b"abcd")), media._full(b"stsc", struct.pack(">I", 1), struct.pack(">III", 1, 2, 1)),
            media._full(b"stsz", struct.pack(">II", 0, 4), struct.pack(">4I", 3, 1, 4, 2)), media._full(b"co64", struct.pack(">I", 2), struct.pack(">QQ", offset + 8, offset)),
        )
        track = media._box(b"trak", media._box(b"mdia", media._full(b"mdhd", struct.pack(">QQIQI", 0, 0, 10, 25, 0), version=1), media._box(b"minf", table)))
        return media._box(b"moov", track)

    data = file(len(file(0)) + 8) + media._box(b"mdat", payload)
    found = media.walk(data)
    assert media.payload_of(data, found) == b"".join(parts) and found["duration"] == 2.5 and found["codec"] == "abcd"
    assert np.array_equal(found["keyframes"], found["samples"])
