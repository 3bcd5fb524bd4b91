"""Ogg containers: a writer for 8-bit PCM with an index stream, and a reader for any logical streams.

Fixed values of the format (RFC 3533): capture pattern ``OggS``, version 0, header flags 1 continued, 2 first page, 4 last
page, a 27-byte header before the lacing values, CRC polynomial 0x04C11DB7 without reflection, start or final inversion.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

CAPTURE = b"OggS"
HEADER = "<4sBBqIIIB"
CONTINUED, FIRST, LAST = 1, 2, 4
REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
#: PCM stream header: magic, version, format (unsigned 8-bit), rate, bits, channels, most frames in a packet, extra headers.
PCM_HEADER = ">8sHHIIBBHI"
RATE, PACKET, PCM_SERIAL, INDEX_SERIAL = 19_200, 3_840, 1, 2


def crc32_ogg(data: bytes) -> int:
    """Ogg's CRC by way of zlib's: that one reads bits in the other order and inverts at both ends."""
    plain = zlib.crc32(data.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(plain.to_bytes(4, "big").translate(REVERSED), "little")


class StreamWriter:
    """Packets of one logical stream, cut into pages of at most ``segments`` lacing values."""

    def __init__(self, serial: int, segments: int = 128):
        self.serial, self.segments, self.sequence = serial, segments, 0
        self.lacing, self.body, self.granule, self.continued = bytearray(), bytearray(), -1, False

    def packet(self, data: bytes, granule: int, flush: bool = False, last: bool = False) -> bytes:
        """Add a packet; returns the pages that are full, or all if ``flush``."""
        out, at = [], 0
        values = b"\xff" * (len(data) // 255) + bytes([len(data) % 255])
        while True:
            room = self.segments - len(self.lacing)
            part = values[:room]
            size = sum(part)
            self.lacing += part
            self.body += data[at : at + size]
            at += size
            values = values[room:]
            if values:
                out.append(self._page(0))
                self.continued = True
                continue
            self.granule = granule
            break
        if flush or last or len(self.lacing) == self.segments:
            out.append(self._page(LAST if last else 0))
            self.continued = False
        return b"".join(out)

    def _page(self, flags: int) -> bytes:
        flags |= (CONTINUED if self.continued else 0) | (FIRST if not self.sequence else 0)
        head = struct.pack(HEADER, CAPTURE, 0, flags, self.granule, self.serial, self.sequence, 0, len(self.lacing)) + bytes(self.lacing)
        page = head + bytes(self.body)
        self.sequence += 1
        self.lacing, self.body, self.granule = bytearray(), bytearray(), -1
        return page[:22] + crc32_ogg(page).to_bytes(4, "little") + page[26:]


def write_pcm(samples: bytes) -> bytes:
    """An Ogg file with two multiplexed streams: the samples, and an index that has each packet's first sample and CRC-32."""
    pcm, index = StreamWriter(PCM_SERIAL), StreamWriter(INDEX_SERIAL)
    out = [pcm.packet(struct.pack(PCM_HEADER, b"PCM     ", 0, 0, 1, RATE, 8, 1, PACKET, 0), 0, flush=True), index.packet(b"Index\0\0\0", 0, flush=True)]
    starts = range(0, len(samples), PACKET)
    for start in starts:
        data, last = samples[start : start + PACKET], start + PACKET >= len(samples)
        out.append(index.packet(struct.pack("<QI", start, zlib.crc32(data)), start, last=last))
        out.append(pcm.packet(data, start + len(data), last=last))
    return b"".join(out)


@dataclass
class Packet:
    data: bytes
    granule: int  # of the page on which it ends; -1 for packets before the last that ends there


@dataclass
class Stream:
    serial: int
    packets: list[Packet] = field(default_factory=list)
    partial: bytearray | None = None
    next_sequence: int = 0
    gaps: int = 0
    pages: int = 0
    ended: bool = False


def read_pages(data: bytes):
    """(flags, granule, serial, sequence, lacing, body) of each page whose checksum holds, None for each damaged place.

    After damage the next capture pattern is looked for.
    """
    at, hurt = 0, False
    while (found := data.find(CAPTURE, at)) >= 0:
        if found > at and not hurt:
            yield None
        hurt = False
        ok = found + 27 <= len(data)
        if ok:
            _, version, flags, granule, serial, sequence, crc, n = struct.unpack_from(HEADER, data, found)
            lacing = data[found + 27 : found + 27 + n]
            end = found + 27 + n + sum(lacing)
            ok = not version and len(lacing) == n and end <= len(data)
            ok = ok and crc32_ogg(data[found : found + 22] + b"\0\0\0\0" + data[found + 26 : end]) == crc
        if ok:
            yield flags, granule, serial, sequence, lacing, data[found + 27 + n : end]
            at = end
        else:
            yield None
            hurt, at = True, found + 4
    if at < len(data) and not hurt:
        yield None


def demultiplex(data: bytes) -> tuple[dict[int, Stream], int]:
    """Logical streams by serial number, and the number of damaged places. A packet with a lost page is left out."""
    streams: dict[int, Stream] = {}
    damaged = 0
    for page in read_pages(data):
        if page is None:
            damaged += 1
            continue
        flags, granule, serial, sequence, lacing, body = page
        s = streams.setdefault(serial, Stream(serial))
        s.pages += 1
        if sequence != s.next_sequence:
            s.gaps += 1
            s.partial = None
        s.next_sequence = sequence + 1
        skip = bool(flags & CONTINUED) and s.partial is None  # its beginning is lost
        if not flags & CONTINUED:
            s.partial = None
        part, at, complete = s.partial or bytearray(), 0, []
        for value in lacing:
            part += body[at : at + value]
            at += value
            if value < 255:
                if skip:
                    skip = False
                else:
                    complete.append(Packet(bytes(part), -1))
                part = bytearray()
        s.partial = part if lacing and lacing[-1] == 255 and not skip else None
        if complete:
            complete[-1].granule = granule
        s.packets += complete
        s.ended |= bool(flags & LAST)
    return streams, damaged


def packet_times(packets: list[Packet], frames, rate: int) -> list[tuple[float, float] | None]:
    """(start, end) in seconds of each packet: a page's granule is the position after its last packet, the ones before count back."""
    ends: list[int | None] = [None] * len(packets)
    position: int | None = None
    for i in range(len(packets) - 1, -1, -1):
        if packets[i].granule >= 0:
            position = packets[i].granule
        ends[i] = position
        if position is not None:
            position = max(0, position - frames(packets[i].data))
    return [None if e is None else ((e - frames(p.data)) / rate, e / rate) for p, e in zip(packets, ends, strict=True)]


def read_pcm(data: bytes) -> dict:
    """The samples of the first PCM stream, its packets' times, and what the index says about them."""
    streams, damaged = demultiplex(data)
    pcm = next((s for s in streams.values() if s.packets and s.packets[0].data[:8] == b"PCM     "), None)
    if pcm is None:
        return {"samples": b"", "rate": 0, "times": [], "streams": len(streams), "pages": sum(s.pages for s in streams.values()), "damaged": damaged, "indexed": 0}
    rate = struct.unpack_from(PCM_HEADER, pcm.packets[0].data)[4]
    own = pcm.packets[1:]
    index = next((s for s in streams.values() if s.packets and s.packets[0].data[:8] == b"Index\0\0\0"), None)
    listed = {}
    for p in index.packets[1:] if index else []:
        start, crc = struct.unpack("<QI", p.data)
        listed[start] = crc
    times = packet_times(own, len, rate)
    indexed = sum(t is not None and listed.get(round(t[0] * rate)) == zlib.crc32(p.data) for p, t in zip(own, times, strict=True))
    return {"samples": b"".join(p.data for p in own), "rate": rate, "times": times, "streams": len(streams), "pages": sum(s.pages for s in streams.values()), "damaged": damaged, "indexed": indexed}
