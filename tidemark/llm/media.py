"""Media columns: MPEG transport streams as binary values.

``mux`` stores bytes losslessly as one private elementary stream: program tables (PAT, PMT) before
each group, PES packets with PTS and DTS, a PCR and the random-access flag at the packets that start
them. ``demux`` parses any single-program stream of 188-byte packets: it resynchronises, reads the
tables, checks continuity counters, reassembles elementary packets and lists timestamps.

Defined results: a null text is an empty one; a payload is never empty, as it is padded to a positive
multiple of 192; a null stream gives null fields; damaged packets are counted and skipped.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, slices, texts_of

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, ES_PID, PROGRAM = 0, 0x1000, 0x100, 1
#: stream_type of PES packets with private data, and their stream_id (values of the standard).
PRIVATE_PES, PRIVATE_STREAM_1 = 0x06, 0xBD
#: Payload bytes of an access unit, units from one random-access point to the next, 90 kHz ticks a unit.
UNIT, GROUP, TICKS, FIRST_PTS = 12_288, 8, 3_600, 90_000
PAD = 192
UNIT_FIELDS = ("pts", "dts", "random_access", "packet", "offset")


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 1 << 31 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


@lru_cache(1024)
def crc32_mpeg(data: bytes) -> int:
    """CRC of program-table sections; 0 over a section that ends with its own CRC."""
    c = 0xFFFFFFFF
    for b in data:
        c = c << 8 & 0xFFFFFFFF ^ _CRC[c >> 24 ^ b]
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\0\0"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


@lru_cache(16)
def _tables(counter: int) -> bytes:
    """A PAT packet and a PMT packet with this continuity counter."""
    pat = _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pmt = _section(2, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\0" + bytes([PRIVATE_PES]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\0")
    return b"".join((bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10 | counter, 0]) + s).ljust(PACKET, b"\xff") for pid, s in ((PAT_PID, pat), (PMT_PID, pmt)))


def _stamp(mark: int, t: int) -> bytes:
    return bytes([mark << 4 | t >> 29 & 14 | 1, t >> 22 & 255, t >> 14 & 254 | 1, t >> 7 & 255, t << 1 & 254 | 1])


def _stamp_value(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


_COLUMNS = np.arange(PACKET)


def _unit_packets(data: np.ndarray, pts: int, random_access: bool, counter: int) -> np.ndarray:
    """Transport packets of one access unit; its first packet has a PCR, its last one is stuffed."""
    pes_length = 13 + len(data)
    head = b"\0\0\1" + bytes([PRIVATE_STREAM_1]) + pes_length.to_bytes(2, "big") + b"\x84\xc0\x0a" + _stamp(3, pts) + _stamp(1, pts)
    total = len(head) + len(data)
    first = PACKET - 12
    n = 1 + max(0, -(-(total - first) // (PACKET - 4)))
    spare = first + (n - 1) * (PACKET - 4) - total
    out = np.full((n, PACKET), 255, np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = SYNC, ES_PID >> 8, ES_PID & 255
    out[0, 1] |= 0x40
    out[:, 3] = 0x10 | (counter + np.arange(n)) & 15
    start = np.full(n, 4)
    start[0] = 12
    start[-1] += spare
    out[0, 3] |= 0x20
    out[0, 4] = start[0] - 5
    out[0, 5] = 0x10 | 0x40 * random_access
    out[0, 6:12] = np.frombuffer((pts << 15 | 0x3F << 9).to_bytes(6, "big"), np.uint8)
    if n > 1 and spare:
        out[-1, 3] |= 0x20
        out[-1, 4] = spare - 1
        if spare > 1:
            out[-1, 5] = 0
    out[_COLUMNS >= start[:, None]] = np.concatenate([np.frombuffer(head, np.uint8), data])
    return out


def mux(payload: bytes) -> bytes:
    data, parts, counter = np.frombuffer(payload, np.uint8), [], 0
    for i in range(max(1, -(-len(data) // UNIT))):
        if i % GROUP == 0:
            parts.append(_tables(i // GROUP & 15))
        packets = _unit_packets(data[i * UNIT : (i + 1) * UNIT], FIRST_PTS + i * TICKS, i % GROUP == 0, counter)
        counter += len(packets)
        parts.append(packets.tobytes())
    return b"".join(parts)


def _synced(media: bytes) -> tuple[np.ndarray, int]:
    """Whole packets in step with the sync bytes, and the number of bytes left out."""
    data = np.frombuffer(media, np.uint8)
    n = len(data) // PACKET
    rows = data[: n * PACKET].reshape(n, PACKET)
    if len(data) == n * PACKET and (not n or (rows[:, 0] == SYNC).all()):
        return rows, 0
    kept, at, taken = [], 0, 0
    while at + PACKET <= len(data):
        run = len(data[at:]) // PACKET
        good = data[at : at + run * PACKET].reshape(run, PACKET)[:, 0] == SYNC
        m = run if good.all() else int(good.argmin())
        if m:
            kept.append(data[at : at + m * PACKET].reshape(m, PACKET))
            at, taken = at + m * PACKET, taken + m * PACKET
        else:
            nxt = np.flatnonzero(data[at + 1 :] == SYNC)
            at = at + 1 + int(nxt[0]) if len(nxt) else len(data)
    return (np.concatenate(kept) if kept else rows[:0]), len(data) - taken


def _starts(rows: np.ndarray) -> np.ndarray:
    """Column where each packet's payload begins; PACKET without one."""
    adapt = rows[:, 3] >> 4 & 3
    start = np.where(adapt & 2, 5 + rows[:, 4].astype(np.int64), 4)
    return np.where(adapt & 1, np.minimum(start, PACKET), PACKET)


def _sections(rows: np.ndarray) -> list[bytes]:
    """Sections of one PID whose CRC holds, also those that span packets."""
    found, open_ = [], b""
    for row, at in zip(rows, _starts(rows), strict=True):
        body = row[at:].tobytes()
        if row[1] & 0x40 and body:
            body = body[1 + body[0] :]
            open_ = b""
        elif not open_:
            continue
        open_ += body
        while len(open_) >= 3 and open_[0] != 255:
            n = 3 + (int.from_bytes(open_[1:3], "big") & 0xFFF)
            if len(open_) < n:
                break
            if not crc32_mpeg(open_[:n]):
                found.append(open_[:n])
            open_ = open_[n:]
        if open_[:1] == b"\xff":
            open_ = b""
    return found


def _continuity(rows: np.ndarray) -> tuple[int, np.ndarray]:
    """Breaks of one PID's continuity counter, and which packets are not repeats of the one before."""
    carries = (rows[:, 3] & 0x10) > 0
    if carries.all() and len(rows):
        step = np.diff(rows[:, 3] & 15) & 15
        if (step == 1).all():
            return 0, carries
    keep, last, breaks = carries.copy(), None, 0
    for i, row in enumerate(rows):
        now, flagged = int(row[3] & 15), row[3] & 0x20 and row[4] > 0 and row[5] & 0x80
        if last is not None and carries[i] and not flagged:
            if now == last and i and (rows[i - 1, 12:] == row[12:]).all():
                keep[i] = False
            elif now != (last + 1) & 15:
                breaks += 1
        last = now if carries[i] or last is None else last
    return breaks, keep


def demux(media: bytes) -> dict:
    """payload (all elementary packets of the first program's first stream), streams by PID, units as
    (pts, dts, random_access, packet number, payload offset), and counts of faults."""
    rows, lost = _synced(media)
    good = rows[(rows[:, 1] & 0x80) == 0]
    pids = (good[:, 1].astype(np.int64) & 31) << 8 | good[:, 2]
    pats = [s for s in _sections(good[pids == PAT_PID]) if s[0] == 0]
    programs = {int.from_bytes(s[i : i + 2], "big"): int.from_bytes(s[i + 2 : i + 4], "big") & 0x1FFF for s in pats for i in range(8, len(s) - 4, 4)}
    programs.pop(0, None)
    streams, pmts = {}, 0
    for pid in sorted(set(programs.values())):
        for s in _sections(good[pids == pid]):
            if s[0] != 2:
                continue
            pmts += 1
            at = 12 + (int.from_bytes(s[10:12], "big") & 0xFFF)
            while at + 5 <= len(s) - 4:
                streams[int.from_bytes(s[at + 1 : at + 3], "big") & 0x1FFF] = s[at]
                at += 5 + (int.from_bytes(s[at + 3 : at + 5], "big") & 0xFFF)
    out = {"packets": len(rows), "lost_bytes": lost, "errored": len(rows) - len(good), "pats": len(pats), "pmts": pmts, "programs": programs, "streams": streams, "breaks": 0, "units": [], "payload": b""}
    for pid in programs.values():
        out["breaks"] += _continuity(good[pids == pid])[0]
    for k, pid in enumerate(sorted(streams)):
        at = np.flatnonzero(pids == pid)
        own = good[at]
        breaks, keep = _continuity(own)
        out["breaks"] += breaks
        if k:
            continue
        own, at = own[keep], at[keep]
        begin = _starts(own)
        flat = own[_COLUMNS >= begin[:, None]].tobytes()
        edges = np.concatenate([[0], np.cumsum(PACKET - begin)])
        heads = np.flatnonzero(own[:, 1] & 0x40)
        parts, size = [], 0
        for h, nxt in zip(heads, [*heads[1:], len(own)], strict=True):
            pes = flat[edges[h] : edges[nxt]]
            if pes[:3] != b"\0\0\1" or len(pes) < 9:
                out["errored"] += 1
                continue
            n, flags = int.from_bytes(pes[4:6], "big"), pes[7] >> 6
            body = pes[9 + pes[8] : 6 + n if n else len(pes)]
            pts = _stamp_value(pes[9:14]) if flags & 2 else None
            dts = _stamp_value(pes[14:19]) if flags == 3 else pts
            row = own[h]
            out["units"].append((pts, dts, bool(row[3] & 0x20 and row[4] and row[5] & 0x40), int(at[h]), size))
            parts.append(body)
            size += len(body)
        out["payload"] = b"".join(parts)
    return out


def feature(d: dict) -> str:
    """One line about a parsed stream: tables, faults, timestamps and the random-access index."""
    units = d["units"]
    points = [u for u in units if u[2]]
    index = ";".join(f"{u[0]}@{u[3]}+{u[4]}" for u in points)
    ends = f"{units[0][0]}-{units[-1][0]}" if units else "-"
    streams = ",".join(f"{p}:{t}" for p, t in sorted(d["streams"].items()))
    return f"packets={d['packets']} tables={d['pats']}/{d['pmts']} streams={streams} breaks={d['breaks']} lost={d['lost_bytes']} units={len(units)} pts={ends} access={len(points)}:{hashlib.md5(index.encode()).hexdigest()[:12]}"


def seek(media: bytes, points: list[tuple], pts: int) -> bytes:
    """Payload from the last random-access point at or before ``pts`` on, read from its packet alone.
    ``points`` are rows (pts, dts, random_access, packet, offset) of ``parse_media``; the first point serves
    earlier times."""
    known = [p for p in points if p[2] and p[0] is not None]
    before = [p for p in known if p[0] <= pts] or known[:1]
    if not before:
        return b""
    at = before[-1][3] * PACKET  # the program tables stand in front, at the start of the stream
    return demux(media[: 2 * PACKET] + media[at:])["payload"]


def padded(data: bytes) -> bytes:
    return data + b" " * (max(1, -(-len(data) // PAD)) * PAD - len(data))


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text's padded UTF-8 bytes as a transport stream."""
    bounded_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts = part.column("text").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array([mux(padded(t)) for t in texts], pa.binary())], schema=schema)

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def parse_media(media: DataFrame) -> DataFrame:
    """Adds what ``demux`` reads from the binary column ``media`` of (doc_id, n_bytes, media). ``units`` has
    the timestamps of every access unit, whether it is a random-access point, its packet and the place of
    its payload."""
    bounded_batches(media.sparkSession)
    plain = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_units long, n_access long, n_breaks long"
    unit = pa.struct([("pts", pa.int64()), ("dts", pa.int64()), ("random_access", pa.bool_()), ("packet", pa.int64()), ("offset", pa.int64())])
    names = [*(x.split()[0] for x in plain.split(", ")), "units"]
    types = [*(pa.string() if x.endswith("string") else pa.int64() for x in plain.split(", ")), pa.list_(unit)]
    ddl = f"{plain}, units array<struct<pts:long,dts:long,random_access:boolean,packet:long,offset:long>>"

    def row(doc_id, n_bytes, m: bytes | None) -> tuple:
        if m is None:
            return (doc_id, n_bytes, *[None] * 10)
        d = demux(m)
        p = d["payload"]
        return (doc_id, n_bytes, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature(d), len(d["units"]), sum(u[2] for u in d["units"]), d["breaks"], [dict(zip(UNIT_FIELDS, u, strict=True)) for u in d["units"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "media"):
            got = list(map(row, *(part.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media"))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), types, strict=True)], names=names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, ddl)
