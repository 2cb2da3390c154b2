"""Media columns: payloads stored as MPEG transport streams (ISO/IEC 13818-1), and read back.

`mux` wraps a payload in packetised elementary stream (PES) packets with presentation time stamps and
cuts these into transport packets of 188 bytes, with program tables before each random-access point.
`demux` parses the program tables, checks the continuity counters, reassembles the elementary packets and
lists each one's time stamp, place and random-access mark. Both work on whole packet arrays in numpy.

Defined results: a null payload is an empty one; bytes that hold no transport packet give no tables, no
payload and no access points; packets out of order, repeated or lost are counted in `cc_errors`, `repeats`;
a packet with the transport error bit, or scrambled, is dropped and counted in `damaged`.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts

PACKET, SYNC = 188, 0x47
PAT_PID, NULL_PID = 0x0000, 0x1FFF
PMT_PID, ES_PID, PROGRAM = 0x1000, 0x0100, 1
#: PES private data: the samples are opaque 8-bit units.
STREAM_TYPE, STREAM_ID = 0x06, 0xBD
PAD_TO = 192
#: Samples in one access unit, access units between random-access points, samples a second, clock ticks a second.
UNIT, ACCESS_EVERY, RATE, CLOCK = 40 * PAD_TO, 4, 48_000, 90_000


def _crc_table() -> list[int]:
    table = []
    for n in range(256):
        c = n << 24
        for _ in range(8):
            c = (c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1
        table.append(c & 0xFFFFFFFF)
    return table


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    """The CRC-32 that closes a program table: polynomial 0x04C11DB7, most significant bit first."""
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, ext: int, body: bytes) -> bytes:
    head = bytes([table_id, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 0xFF, ext >> 8, ext & 0xFF, 0xC1, 0, 0])
    return head + body + section_crc(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    raw = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section
    return np.frombuffer(raw.ljust(PACKET, b"\xff"), np.uint8)


_PAT = _table_packet(PAT_PID, _section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
_PMT = _table_packet(PMT_PID, _section(0x02, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00"))


def _pes_header(n: int, pts: np.ndarray, size: int) -> np.ndarray:
    """PES headers with a PTS, one row each, for payloads of `size` bytes."""
    h = np.zeros((n, 14), np.uint8)
    h[:, 2], h[:, 3] = 1, STREAM_ID
    length = size + 8
    h[:, 4], h[:, 5] = length >> 8, length & 0xFF
    h[:, 6], h[:, 7], h[:, 8] = 0x84, 0x80, 5
    h[:, 9] = 0x21 | (pts >> 29) & 0x0E
    h[:, 10] = pts >> 22 & 0xFF
    h[:, 11] = 1 | (pts >> 14) & 0xFE
    h[:, 12] = pts >> 7 & 0xFF
    h[:, 13] = 1 | (pts << 1) & 0xFE
    return h


def _packets(data: np.ndarray, pts: np.ndarray, access: np.ndarray) -> np.ndarray:
    """Transport packets (units, packets, 188) of equally long access units (units, bytes)."""
    n, size = data.shape
    pes = np.concatenate([_pes_header(n, pts, size), data], axis=1)
    first = PACKET - 4 - 8  # the first packet of a unit carries flags and a clock reference
    stuffed = pes.shape[1] < first
    rest = 0 if stuffed else pes.shape[1] - first
    more = -(-rest // (PACKET - 4))
    out = np.full((n, 1 + more, PACKET), 0xFF, np.uint8)
    out[:, :, 0], out[:, :, 1], out[:, :, 2], out[:, :, 3] = SYNC, ES_PID >> 8, ES_PID & 0xFF, 0x10
    out[:, 0, 1] |= 0x40
    out[:, 0, 3] = 0x30
    pad = first - pes.shape[1] if stuffed else 0
    out[:, 0, 4], out[:, 0, 5] = 7 + pad, np.where(access, 0x50, 0x10)
    for i, shift in enumerate((25, 17, 9, 1)):
        out[:, 0, 6 + i] = pts >> shift & 0xFF
    out[:, 0, 10], out[:, 0, 11] = (pts << 7 & 0x80) | 0x7E, 0
    take = min(first, pes.shape[1])
    out[:, 0, PACKET - take :] = pes[:, :take]
    if more:
        whole = (PACKET - 4) * (more - 1)
        out[:, 1:more, 4:] = pes[:, first : first + whole].reshape(n, more - 1, PACKET - 4)
        last = pes[:, first + whole :]
        gap = PACKET - 4 - last.shape[1]
        if gap:  # stuffing stands in an adaptation field
            out[:, more, 3] = 0x30
            out[:, more, 4] = gap - 1
            if gap > 1:
                out[:, more, 5] = 0
        out[:, more, 4 + gap :] = last
    return out


def mux(payload: bytes, unit: int = UNIT, access_every: int = ACCESS_EVERY) -> bytes:
    """A transport stream with one program and one elementary stream that carries `payload`."""
    data = np.frombuffer(payload, np.uint8)
    full = data.size // unit
    parts: list[np.ndarray] = []
    index = np.arange(full + bool(data.size % unit), dtype=np.int64)
    pts = index * unit * CLOCK // RATE & (1 << 33) - 1
    access = index % access_every == 0
    units = []
    if full:
        units = list(_packets(data[: full * unit].reshape(full, unit), pts[:full], access[:full]))
    if data.size % unit:
        units.append(_packets(data[full * unit :][None], pts[full:], access[full:])[0])
    for i in range(0, len(units), access_every):
        parts += [_PAT[None], _PMT[None], *units[i : i + access_every]]
    if not parts:
        parts = [_PAT[None], _PMT[None]]
    out = np.concatenate(parts)
    es = (out[:, 1] & 0x1F) == ES_PID >> 8
    tables = np.cumsum(~es)
    out[es, 3] |= (np.arange(es.sum()) & 15).astype(np.uint8)
    out[~es, 3] |= ((tables[~es] - 1) // 2 & 15).astype(np.uint8)
    return out.tobytes()


@dataclass
class Stream:
    """What demux() finds."""

    program: int = 0
    pmt_pid: int = 0
    pid: int = 0
    stream_type: int = 0
    packets: int = 0
    cc_errors: int = 0
    repeats: int = 0
    damaged: int = 0
    table_errors: int = 0
    payload: bytes = b""
    #: For each elementary packet: time stamp (-1: none), byte of its first transport packet, random access.
    pts: list[int] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)
    access: list[bool] = field(default_factory=list)


def _section_at(packet: np.ndarray, start: int, table_id: int) -> bytes | None:
    """The section in a packet whose payload begins at start, if its CRC holds; tables here fit in one packet."""
    raw = packet.tobytes()[start:]
    if not raw:
        return None
    raw = raw[1 + raw[0] :]
    if len(raw) < 12 or raw[0] != table_id:
        return None
    raw = raw[: 3 + (raw[1] << 8 & 0xF00 | raw[2])]
    return raw if len(raw) >= 12 and section_crc(raw) == 0 else None


def _aligned(stream: bytes) -> np.ndarray:
    """Packets from the first place where the sync byte repeats; a torn last packet is left out."""
    b = np.frombuffer(stream, np.uint8)
    for start in range(min(PACKET, b.size)):
        n = (b.size - start) // PACKET
        if n and b[start] == SYNC and (b[start : start + n * PACKET : PACKET] == SYNC).mean() > 0.5:
            p = b[start : start + n * PACKET].reshape(n, PACKET)
            return p[p[:, 0] == SYNC]
    return np.zeros((0, PACKET), np.uint8)


def demux(stream: bytes) -> Stream:
    """Parse a transport stream and reassemble the first elementary stream of its first program."""
    out = Stream()
    p = _aligned(stream)
    bad = (p[:, 1] & 0x80 > 0) | (p[:, 3] & 0xC0 > 0)
    out.damaged, place = int(bad.sum()), np.flatnonzero(~bad)
    p = p[~bad]
    out.packets = len(p)
    pids = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    flags = p[:, 3] >> 4 & 3
    start = np.where(flags & 2, 5 + p[:, 4].astype(np.int32), 4)
    start = np.where(flags & 1, np.minimum(start, PACKET), PACKET)

    def section(pid: int, table_id: int) -> bytes | None:
        for i in np.flatnonzero((pids == pid) & (p[:, 1] & 0x40 > 0)):
            if (found := _section_at(p[i], int(start[i]), table_id)) is not None:
                return found
            out.table_errors += 1
        return None

    if (pat := section(PAT_PID, 0x00)) is None:
        return out
    for k in range(8, len(pat) - 4, 4):
        if number := pat[k] << 8 | pat[k + 1]:
            out.program, out.pmt_pid = number, (pat[k + 2] << 8 | pat[k + 3]) & 0x1FFF
            break
    if not out.program or (pmt := section(out.pmt_pid, 0x02)) is None:
        return out
    k = 12 + ((pmt[10] << 8 | pmt[11]) & 0xFFF)
    if k + 5 > len(pmt) - 4:
        return out
    out.stream_type, out.pid = pmt[k], (pmt[k + 1] << 8 | pmt[k + 2]) & 0x1FFF

    es = (pids == out.pid) & (start < PACKET)
    p, start, place, flags = p[es], start[es], place[es], flags[es]
    if not len(p):
        return out
    cc = (p[:, 3] & 15).astype(np.int32)
    step = np.diff(cc) & 15
    jump = ((flags[1:] & 2) > 0) & (start[1:] > 5) & (p[1:, 5] & 0x80 > 0)  # an announced discontinuity
    repeat = np.concatenate([[False], (step == 0) & ~jump])
    repeat[1:] &= (p[1:, 4:] == p[:-1, 4:]).all(axis=1) if repeat.any() else False
    out.repeats = int(repeat.sum())
    out.cc_errors = int(((step != 1) & ~jump & ~repeat[1:]).sum())
    p, start, place, flags = p[~repeat], start[~repeat], place[~repeat], flags[~repeat]

    unit = p[:, 1] & 0x40 > 0
    if not unit.any():
        return out
    head = int(unit.argmax())  # what comes before the first unit's start can't be placed
    p, start, place, flags, unit = p[head:], start[head:], place[head:], flags[head:], unit[head:]
    body = p[np.arange(PACKET) >= start[:, None]]
    sizes = PACKET - start
    ends = np.cumsum(sizes)
    begin = (ends - sizes)[unit]
    stop = np.append(begin[1:], body.size)
    access = ((flags & 2) > 0) & (p[:, 4] > 0) & (p[:, 5] & 0x40 > 0)
    out.offsets, out.access = (place[unit] * PACKET).tolist(), access[unit].tolist()
    pieces = []
    for b, e in zip(begin.tolist(), stop.tolist(), strict=True):
        h = body[b : min(e, b + 19)].tobytes()
        if len(h) < 9 or h[:3] != b"\x00\x00\x01":
            out.pts.append(-1)
            continue
        length = h[4] << 8 | h[5]
        if length:
            e = min(e, b + 6 + length)
        if h[7] & 0x80 and len(h) >= 14:
            out.pts.append((h[9] & 0x0E) << 29 | h[10] << 22 | (h[11] & 0xFE) << 14 | h[12] << 7 | h[13] >> 1)
        else:
            out.pts.append(-1)
        pieces.append(body[b + 9 + h[8] : e])
    out.payload = b"".join(x.tobytes() for x in pieces)
    return out


def text_payload(text: str | None) -> tuple[int, bytes]:
    """A text's UTF-8 length, and its bytes with spaces up to a positive multiple of PAD_TO."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(1, -(-len(raw) // PAD_TO)) * PAD_TO)


def store_media(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_bytes, media): each text as a transport stream in a binary column. Null: as the empty text."""

    def make():
        def work(texts):
            pairs = [text_payload(t) for t in texts]
            return {"n_bytes": [n for n, _ in pairs], "media": [mux(x) for _, x in pairs]}

        return work

    return map_texts(df, [id_col], text_col, "n_bytes long, media binary", make)


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_units int, cc_errors int, pts array<long>, unit_offsets array<long>, random_access array<boolean>"


def media_features(media: bytes | None) -> dict:
    """Features of a stored stream; all from the bytes read back."""
    media = media or b""
    s = demux(media)
    points = sum(s.access)
    return {
        "payload_bytes": len(s.payload),
        "payload_sha256": hashlib.sha256(s.payload).hexdigest(),
        "tail_crc32": zlib.crc32(s.payload[-16:]),
        "media_bytes": len(media),
        "media_sha256": hashlib.sha256(media).hexdigest(),
        "feature": f"program={s.program};pmt={s.pmt_pid:#06x};pid={s.pid:#06x};type={s.stream_type:#04x};packets={s.packets};units={len(s.pts)};access={points};pts={s.pts[0] if s.pts else -1}..{s.pts[-1] if s.pts else -1};cc_errors={s.cc_errors};repeats={s.repeats};damaged={s.damaged}",
        "n_units": len(s.pts),
        "cc_errors": s.cc_errors,
        "pts": s.pts,
        "unit_offsets": s.offsets,
        "random_access": s.access,
    }


def read_media(df: DataFrame, id_col: str = "doc_id", media_col: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, kept columns, FEATURES): what the streams in a binary column hold."""
    from pyspark.sql import types as T

    names = [f.name for f in T.StructType.fromDDL(FEATURES)]
    from pyspark.sql.pandas.types import to_arrow_schema

    from .common import ship_package

    ship_package(df.sparkSession)
    kept = [id_col, *keep]
    out = T.StructType([df.schema[c] for c in kept] + list(T.StructType.fromDDL(FEATURES)))
    arrow = to_arrow_schema(out)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [media_features(part.column(len(kept))[i].as_py()) for i in range(part.num_rows)]
                columns = [part.column(i).cast(arrow.field(i).type) for i in range(len(kept))]
                columns += [pa.array([r[n] for r in rows], type=arrow.field(n).type) for n in names]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.select(*kept, media_col).mapInArrow(run, out)


def media_table(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Store every text as a transport stream, read the stored bytes back, return their features.

    Null texts are stored as empty ones; equal texts give equal rows but for the id. No shuffle: the two
    steps run where the rows are.
    """
    stored = store_media(df, text_col, id_col)
    return read_media(stored, id_col, "media", keep=("n_bytes",))
