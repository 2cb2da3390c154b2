import hashlib
import random
import zlib

import pytest

from tuplewise.llm import media as M

from .conftest import ROWS


@pytest.mark.parametrize("n", [0, 1, 150, 161, 162, 163, 345, 346, 347, 7680, 7681, 4 * 7680, 50_000])
def test_round_trip(n):
    data = random.Random(n).randbytes(n)
    s = M.demux(M.mux(data))
    assert s.payload == data and not s.cc_errors and not s.repeats and len(s.pts) == -(-n // M.UNIT)
    assert s.pts == [i * M.UNIT * M.CLOCK // M.RATE for i in range(len(s.pts))]
    assert s.access == [i % M.ACCESS_EVERY == 0 for i in range(len(s.pts))]


def test_counts_lost_repeated_and_damaged_packets():
    data = random.Random(1).randbytes(40_000)
    stream = M.mux(data)
    cut = lambda i: stream[: 188 * i] + stream[188 * (i + 1) :]
    assert M.demux(cut(10)).cc_errors == 1
    twice = stream[: 188 * 11] + stream[188 * 10 :]
    assert M.demux(twice).repeats == 1 and M.demux(twice).payload == data
    bad = bytearray(stream)
    bad[188 * 10 + 1] |= 0x80
    assert M.demux(bytes(bad)).damaged == 1
    assert M.demux(b"junk" + stream).payload == data and M.demux(stream[:-50]).cc_errors == 0


def test_garbage_holds_nothing():
    for junk in (b"", b"abc", b"\x47" * 188, bytes(1000)):
        assert M.demux(junk).payload == b""


def test_bad_table_is_not_used():
    stream = bytearray(M.mux(b"x" * 192))
    stream[12] ^= 1  # inside the program table
    assert M.demux(bytes(stream)).program == 0


def test_operator(odd, empty):
    rows = M.media_table(odd).collect()
    assert len(rows) == len(ROWS) and M.media_table(empty).count() == 0
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for i, text, _ in ROWS:
        raw = (text or "").encode()
        size = max(1, -(-len(raw) // 192)) * 192
        payload = raw.ljust(size)
        r = by[i][0]
        stored = M.mux(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256, r.cc_errors) == (len(stored), hashlib.sha256(stored).hexdigest(), 0)
    assert by[1][0].feature == by[2][0].feature
