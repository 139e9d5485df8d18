"""Bytes kept in MPEG transport streams (ISO/IEC 13818-1) and read back.

``mux`` writes program tables, packetised elementary packets with time stamps
and random-access points. ``demux`` trusts nothing of that: it parses the
association and map tables (with their checksums, also where a section goes on
in later packets), checks continuity counters of each packet id, reassembles
the elementary packets of one stream, of any type, and returns time stamps with
random-access points.

A null text is an empty one, and an empty one is padded as any other. Equal
texts give equal streams. Repeated rows are kept; an empty table gives an empty
result; other columns are ignored, whatever their names. A damaged stream, or
bytes that are none, give what could be read, with its errors counted.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from weir.llm.common import per_document

UNIT = 192
#: Samples of one elementary packet, and its length in ticks of the 90 kHz clock at 48,000 samples a second.
ACCESS_BYTES = UNIT * 60
ACCESS_TICKS = ACCESS_BYTES * 90_000 // 48_000
#: Every so many elementary packets may decoding begin.
RAP_EVERY = 4
PMT_PID, ES_PID, NULL_PID = 0x1000, 0x0101, 0x1FFF
STREAM_TYPE, STREAM_ID = 0x06, 0xBD
PTS_WRAP = 1 << 33

_CRC = []
for _i in range(256):
    _c = _i << 24
    for _ in range(8):
        _c = ((_c << 1) ^ 0x04C11DB7 if _c & 0x80000000 else _c << 1) & 0xFFFFFFFF
    _CRC.append(_c)


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _table(pid: int, section: bytes) -> bytes:
    """The packet of a table section, without its counter."""
    section += struct.pack(">I", crc32_mpeg(section))
    body = b"\x00" + section
    return struct.pack(">BHB", 0x47, 0x4000 | pid, 0x10) + body + b"\xff" * (184 - len(body))


_PAT = _table(0, struct.pack(">BHHBBBHH", 0x00, 0xB000 | 13, 1, 0xC1, 0, 0, 1, 0xE000 | PMT_PID))
_PMT = _table(PMT_PID, struct.pack(">BHHBBBHHBHH", 0x02, 0xB000 | 18, 1, 0xC1, 0, 0, 0xE000 | ES_PID, 0xF000, STREAM_TYPE, 0xE000 | ES_PID, 0xF000))


def _pts(t: int) -> bytes:
    return bytes((0x21 | (t >> 29) & 0x0E, (t >> 22) & 0xFF, (t >> 14) & 0xFE | 1, (t >> 7) & 0xFF, (t << 1) & 0xFE | 1))


def mux(payload: bytes) -> bytes:
    """A transport stream of one program whose private stream carries payload."""
    out: list[bytes] = []
    counter = tables = 0
    for n, at in enumerate(range(0, len(payload), ACCESS_BYTES)):
        t = n * ACCESS_TICKS % PTS_WRAP
        rap = n % RAP_EVERY == 0
        if rap:
            out += [_PAT[:3], bytes((0x10 | tables,)), _PAT[4:], _PMT[:3], bytes((0x10 | tables,)), _PMT[4:]]
            tables = (tables + 1) & 15
        data = payload[at : at + ACCESS_BYTES]
        pes = b"\x00\x00\x01" + struct.pack(">BH", STREAM_ID, len(data) + 8) + b"\x80\x80\x05" + _pts(t) + data
        done = 0
        while done < len(pes):
            first = done == 0
            field_ = b""
            if first and rap:
                field_ = b"\x50" + struct.pack(">IH", t >> 1, (t & 1) << 15 | 0x7E00)
            room = 184 - (1 + len(field_) if field_ else 0)
            left = len(pes) - done
            if left < room:  # stuffing
                fill = 184 - left - 1
                field_ = (field_ or (b"\x00" if fill else b"")).ljust(fill, b"\xff")
                room = left
                adapt = bytes((fill,)) + field_
            else:
                adapt = bytes((len(field_),)) + field_ if field_ else b""
            out.append(struct.pack(">BHB", 0x47, (0x4000 if first else 0) | ES_PID, (0x30 if adapt else 0x10) | counter))
            if adapt:
                out.append(adapt)
            out.append(pes[done : done + room])
            counter = (counter + 1) & 15
            done += room
    return b"".join(out)


@dataclass
class Demuxed:
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    payload: bytes = b""
    #: (pts, is a random-access point, bytes, dts) of each elementary packet; -1 where it has no such stamp
    units: list[tuple[int, bool, int, int]] = field(default_factory=list)
    packets: int = 0
    continuity_errors: int = 0
    table_errors: int = 0
    damaged_units: int = 0


class _Sections:
    """Puts the sections of one packet id together, from the payloads of its packets."""

    def __init__(self):
        self.held: bytes | None = None

    def lost(self) -> None:
        self.held = None

    def add(self, body: bytes, starts: bool, d: Demuxed) -> list[bytes]:
        """Whole sections that end in this payload, without their checksums; damaged ones are counted."""
        out: list[bytes] = []
        if starts:
            skip = body[0] if body else 0
            if not body or 1 + skip > len(body):
                d.table_errors += 1
                self.held = None
                return out
            if self.held is not None:
                self.held += body[1 : 1 + skip]
                self._take(out, d)
                if self.held:
                    d.table_errors += 1  # cut off by the next one
            self.held = body[1 + skip :]
        elif self.held is None:
            return out
        else:
            self.held += body
        self._take(out, d)
        return out

    def _take(self, out: list[bytes], d: Demuxed) -> None:
        while self.held:
            if self.held[0] == 0xFF:  # stuffing
                self.held = None
                return
            if len(self.held) < 3:
                return
            end = 3 + (struct.unpack_from(">H", self.held, 1)[0] & 0x0FFF)
            if end > len(self.held):
                return
            s, self.held = self.held[:end], self.held[end:]
            if end < 12 or crc32_mpeg(s) != 0:
                d.table_errors += 1
            else:
                out.append(s[:-4])


def _stamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


#: Stream ids whose packets have no header after their length.
_BARE = {0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF}


def demux(stream: bytes, pid: int | None = None) -> Demuxed:
    """Reads one elementary stream of a transport stream: that of a packet id, or the first private one, or else the first."""
    d = Demuxed()
    last: dict[int, int] = {}
    sections: dict[int, _Sections] = {}
    seen: dict[bytes, list[bytes]] = {}
    chunks: list[bytes] = []
    unit: list[bytes] | None = None
    unit_rap = broken = False

    def close() -> None:
        nonlocal unit
        if unit is None:
            return
        pes = b"".join(unit)
        unit = None
        if len(pes) < 6 or pes[:3] != b"\x00\x00\x01" or (pes[3] not in _BARE and len(pes) < 9):
            d.damaged_units += 1
            return
        size = struct.unpack_from(">H", pes, 4)[0]
        start = 6 if pes[3] in _BARE else 9 + pes[8]
        data = pes[start : 6 + size] if size else pes[start:]
        pts = dts = -1
        if start >= 14 and len(pes) >= 14 and pes[7] & 0x80:
            pts = dts = _stamp(pes[9:14])
            if start >= 19 and len(pes) >= 19 and pes[7] & 0x40:
                dts = _stamp(pes[14:19])
        d.damaged_units += bool(broken or start > len(pes) or (size != 0 and len(pes) < 6 + size))
        d.units.append((pts, unit_rap, len(data), dts))
        chunks.append(data)

    def tables(own: int, found: list[bytes]) -> None:
        nonlocal es
        for s in found:
            if own == 0 and s[0] == 0x00:
                entries = s[8 : 8 + (len(s) - 8) // 4 * 4]
                d.table_errors += len(entries) != len(s) - 8
                d.programs = {n: p & 0x1FFF for n, p in struct.iter_unpack(">HH", entries) if n}
            elif own != 0 and s[0] == 0x02:
                k = 12 + (struct.unpack_from(">H", s, 10)[0] & 0x0FFF) if len(s) >= 12 else len(s) + 1
                while k + 5 <= len(s):
                    kind, epid, info = struct.unpack_from(">BHH", s, k)
                    d.streams[epid & 0x1FFF] = kind
                    k += 5 + (info & 0x0FFF)
                d.table_errors += k != len(s)
        if es is None or es not in d.streams:
            private = [p for p, kind in d.streams.items() if kind == STREAM_TYPE]
            es = pid if pid is not None else next(iter(private or d.streams), None)

    es = pid
    d.continuity_errors += len(stream) % 188 != 0
    for at in range(0, len(stream) - 187, 188):
        if stream[at] != 0x47:
            d.continuity_errors += 1
            continue
        d.packets += 1
        head = stream[at + 1] << 8 | stream[at + 2]
        own, ctl = head & 0x1FFF, stream[at + 3]
        if own == NULL_PID:
            continue
        start, rap, jump = at + 4, False, False
        if ctl & 0x20:
            size = stream[start]
            if size:
                rap, jump = bool(stream[start + 1] & 0x40), bool(stream[start + 1] & 0x80)
            start += 1 + size
        if not ctl & 0x10:
            continue
        cc = ctl & 15
        before = last.get(own)
        if before is not None and not jump:
            if cc == before:  # a repeated packet is sent twice by intention
                continue
            if cc != (before + 1) & 15:
                d.continuity_errors += 1
                broken = broken or (own == es and unit is not None)
                if own in sections:
                    sections[own].lost()
        last[own] = cc
        body = stream[start : at + 188]
        if own == es:
            if head & 0x4000:
                close()
                unit, unit_rap, broken = [body], rap, bool(head & 0x8000)
            elif unit is not None:
                unit.append(body)
                broken = broken or bool(head & 0x8000)
        elif own == 0 or own in d.programs.values():
            waits = sections.setdefault(own, _Sections())
            if head & 0x4000 and not waits.held and body in seen:
                continue  # a table that is sent again
            whole = head & 0x4000 and not waits.held
            errors = d.table_errors
            found = waits.add(body, bool(head & 0x4000), d)
            tables(own, found)
            if whole and not waits.held and d.table_errors == errors:
                seen[body] = found
    close()
    d.payload = b"".join(chunks)
    return d


def pad(data: bytes) -> bytes:
    """data with blanks up to a positive multiple of UNIT."""
    return data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), b" ")


def feature(d: Demuxed) -> str:
    samples = np.frombuffer(d.payload, np.uint8)
    raps = [k for k, u in enumerate(d.units) if u[1]]
    return (
        f"packets={d.packets};units={len(d.units)};pts={d.units[0][0] if d.units else -1}-{d.units[-1][0] if d.units else -1};raps={len(raps)};"
        f"errors={d.continuity_errors + d.table_errors + d.damaged_units};mean={int(samples.sum(dtype=np.int64)) * 1000 // max(1, len(samples))};peak={int(samples.max(initial=0))}"
    )


def digest(text: bytes | None) -> tuple:
    data = text or b""
    stored = mux(pad(data))
    d = demux(stored)
    return (
        len(data), len(d.payload), hashlib.sha256(d.payload).hexdigest(), zlib.crc32(d.payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(d),
        len(d.units), sum(u[1] for u in d.units), d.units[-1][0] if d.units else -1,
    )


def op4_mpegts(docs: DataFrame) -> DataFrame:
    """One row a document: digests of its stream and of what is read back from it, and features of both."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_units long, n_raps long, last_pts long"
    return per_document(docs, lambda rows: [(i, *digest(t)) for i, t in rows], ["doc_id", "text"], schema)


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, media, n_bytes): each text as a transport stream."""
    return per_document(docs, lambda rows: [(i, mux(pad(t or b"")), len(t or b"")) for i, t in rows], ["doc_id", "text"], "doc_id long, media binary, n_bytes long")


def timeline(media: DataFrame) -> DataFrame:
    """(doc_id, pts, is_rap, n_bytes, dts) of every elementary packet in column media."""
    from pyspark.sql import functions as F

    def run(rows: list) -> list[tuple]:
        out = []
        for i, m in rows:
            u = demux(m or b"").units
            halves = [[x[k] % (1 << 31) for x in u] for k in (0, 3)] + [[x[k] >> 31 for x in u] for k in (0, 3)]
            out.append((i, *halves, [int(x[1]) for x in u], [x[2] for x in u]))
        return out

    z = per_document(media, run, ["doc_id", "media"], "doc_id long, plo array<int>, dlo array<int>, phi array<int>, dhi array<int>, rap array<int>, size array<int>")
    x = z.select("doc_id", F.explode(F.arrays_zip("plo", "dlo", "phi", "dhi", "rap", "size")).alias("u"))
    stamp = lambda a: (F.col(f"u.{a}hi").cast("long") * (1 << 31) + F.col(f"u.{a}lo")).alias(f"{a}ts")
    return x.select("doc_id", stamp("p"), (F.col("u.rap") == 1).alias("is_rap"), F.col("u.size").cast("long").alias("n_bytes"), stamp("d"))
