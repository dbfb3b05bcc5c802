"""Ogg containers in a binary column: pages, packets, logical streams, timestamps.

A container is a run of pages. Each has a checksum over all its bytes (CRC-32 of
polynomial 0x04C11DB7, no inversion), the serial number of its logical stream, the
page's number in that stream, a granule position, and lacing values from which packets
are put together: a packet ends at the first value under 255, and may go on over pages.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_HEAD = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4


def checksum(page: bytes) -> int:
    """zlib's CRC works on mirrored bits: mirror the bytes, take its inversions back, mirror the result."""
    got = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(got.to_bytes(4, "little").translate(_REVERSED), "big")


def page(serial: int, number: int, granule: int, flags: int, lacing: bytes, body: bytes) -> bytes:
    raw = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body
    return raw[:22] + struct.pack("<I", checksum(raw)) + raw[26:]


def mux(streams: dict[int, list[tuple[int, bytes]]], order: list[int]) -> bytes:
    """A container. streams: (granule position, packet) by serial; order: the serials, one for each packet after the streams' first, which come before all others."""
    out, number, at = [], dict.fromkeys(streams, 0), dict.fromkeys(streams, 0)

    def put(serial: int) -> None:
        granule, packet = streams[serial][at[serial]]
        at[serial] += 1
        lacing = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
        for i in range(0, len(lacing), 255):
            part = lacing[i : i + 255]
            done = i + 255 >= len(lacing)
            flags = CONTINUED * (i > 0) | FIRST * (number[serial] == 0) | LAST * (done and at[serial] == len(streams[serial]))
            out.append(page(serial, number[serial], granule if done else -1, flags, part, packet[i * 255 : i * 255 + sum(part)]))
            number[serial] += 1

    for serial in streams:
        put(serial)
    for serial in order:
        put(serial)
    return b"".join(out)


def pages_of(raw: bytes) -> Iterator[tuple[int, bool, int, int, int, int, bytes, bytes]]:
    """(offset, checksum right, flags, granule, serial, number, lacing, body). Bytes that begin no whole page are passed over."""
    at = 0
    while (at := raw.find(b"OggS", at)) >= 0:
        if len(raw) < at + 27:
            return
        _, version, flags, granule, serial, number, crc, segments = _HEAD.unpack_from(raw, at)
        lacing = raw[at + 27 : at + 27 + segments]
        end = at + 27 + segments + sum(lacing)
        if version or len(lacing) < segments or end > len(raw):
            at += 4
            continue
        whole = raw[at:end]
        good = checksum(whole[:22] + b"\0\0\0\0" + whole[26:]) == crc
        yield at, good, flags, granule, serial, number, lacing, whole[27 + segments :]
        at = end if good else at + 4  # a damaged length can't be trusted


def clock(packet: bytes) -> tuple[str, int, int]:
    """(codec, granules a second, granules before time zero) from a stream's first packet; rate 0 where it isn't known."""
    if packet[:8] == b"OpusHead" and len(packet) >= 12:
        return "opus", 48000, int.from_bytes(packet[10:12], "little")
    if packet[:7] == b"\x01vorbis" and len(packet) >= 16:
        return "vorbis", int.from_bytes(packet[12:16], "little"), 0
    if packet[:5] == b"\x7fFLAC" and len(packet) >= 30:
        return "flac", int.from_bytes(packet[27:30], "big") >> 4, 0
    if packet[:8] == b"Speex   " and len(packet) >= 40:
        return "speex", int.from_bytes(packet[36:40], "little"), 0
    return "unknown", 0, 0


class Stream:
    def __init__(self) -> None:
        self.next, self.held, self.broken, self.count, self.clock = 0, [], True, 0, ("unknown", 0, 0)
        self.granule = 0


def packets_of(raw: bytes) -> Iterator[tuple]:
    """(serial, packet number, page number, granule, exact, codec, seconds, complete, data) in the order in which packets end."""
    streams: dict[int, Stream] = {}
    for _, good, flags, granule, serial, number, lacing, body in pages_of(raw):
        if not good:
            continue
        if flags & FIRST or serial not in streams:
            streams[serial] = Stream()
            streams[serial].next = number
        s = streams[serial]
        lost = number != s.next
        s.next = number + 1
        if lost:
            s.held, s.broken = [], True
        if not flags & CONTINUED:
            s.held, s.broken = [], False  # what was left open will never end
        ends, at, size = [], 0, 0
        for x in lacing:
            size += x
            if x < 255:
                ends.append((at, at + size))
                at, size = at + size, 0
        done = []
        for i, (a, b) in enumerate(ends):
            if i == 0 and flags & CONTINUED:
                done.append((b"".join([*s.held, body[a:b]]), not s.broken))
                s.held, s.broken = [], False
            else:
                done.append((body[a:b], True))
        if size or lacing and lacing[-1] == 255:
            s.held = [*(s.held if flags & CONTINUED and not ends else []), body[at : at + size]]
            s.broken = s.broken and not ends
        for i, (packet, complete) in enumerate(done):
            if s.count == 0 and complete:
                s.clock = clock(packet)
            last = i == len(done) - 1
            # packets before the page's last share its span evenly
            own = granule if last or granule < 0 else s.granule + (granule - s.granule) * (i + 1) // len(done)
            codec, rate, skip = s.clock
            yield serial, s.count, number, own if granule >= 0 else None, last and granule >= 0, codec, max(0, own - skip) / rate if rate and granule >= 0 else None, complete, packet
            s.count += 1
        if granule >= 0:
            s.granule = granule


def packets(media: DataFrame, id_col: str = "id", content: str = "content") -> DataFrame:
    """(id, serial, packet, page, granule, exact, codec, seconds, complete, data): the packets of every container, stream by stream.

    Pages whose checksum is wrong are left out. A packet of which a page is missing comes with complete false and what was found after
    the gap; one that never ends doesn't come. granule is the end of the packet, exact where the page says it, else the page's span
    in even parts; seconds follow from the rate in the stream's first packet and are null where that or the position isn't known.
    Null and empty contents and those without a page give no rows; an empty table gives none. Repeated rows are read alike. A
    serial number that begins again in one container is a new stream, whose packets count from 0. Other columns aren't read.
    """
    names = ["id", "serial", "packet", "page", "granule", "exact", "codec", "seconds", "complete", "data"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.float64(), pa.bool_(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in kinds]
            source: list[int] = []
            held = 0
            for i, x in enumerate(batch.column(1)):
                for found in packets_of(x.as_py() or b"") if x.is_valid else ():
                    source.append(i)
                    for col, value in zip(rows, found):
                        col.append(value)
                    held += len(found[-1])
                    if held > 1 << 24:
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(source)), *(pa.array(v, k) for v, k in zip(rows, kinds))], names)
                        rows, source, held = [[] for _ in kinds], [], 0
            if source:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(source)), *(pa.array(v, k) for v, k in zip(rows, kinds))], names)

    kind = media.schema[id_col].dataType.simpleString()
    return media.select(F.col(id_col).alias("id"), F.col(content).cast("binary").alias("content")).mapInArrow(run, f"id {kind}, serial bigint, packet int, page bigint, granule bigint, exact boolean, codec string, seconds double, complete boolean, data binary")


def pages(media: DataFrame, id_col: str = "id", content: str = "content") -> DataFrame:
    """(id, offset, serial, page, granule, flags, segments, size, checksum_ok): every page of every container, damaged ones too."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
    names = ["id", "offset", "serial", "page", "granule", "flags", "segments", "size", "checksum_ok"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, source = [], []
            for i, x in enumerate(batch.column(1)):
                for at, good, flags, granule, serial, number, lacing, body in pages_of(x.as_py() or b"") if x.is_valid else ():
                    rows.append((at, serial, number, granule, flags, len(lacing), len(body), good))
                    source.append(i)
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(source)), *(pa.array(list(v), k) for v, k in zip(zip(*rows), kinds))], names)

    kind = media.schema[id_col].dataType.simpleString()
    return media.select(F.col(id_col).alias("id"), F.col(content).cast("binary").alias("content")).mapInArrow(run, f"id {kind}, offset bigint, serial bigint, page bigint, granule bigint, flags int, segments int, size int, checksum_ok boolean")


PRE_SKIP, FRAME, FRAME_BYTES = 312, 960, 64


def containers(conversations: DataFrame) -> DataFrame:
    """(id, content): each conversation as a container, a logical stream for each role with a header packet, its turns as packets of one frame for each 64 bytes begun (one at least). Null texts, roles and turns are left out; a null conv_id is a conversation of its own."""
    turns = conversations.where("role is not null and text is not null and turn is not null")
    rows = turns.groupBy(F.col("conv_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    @F.arrow_udf("binary")
    def run(column: pa.Array) -> pa.Array:
        out = []
        for conversation in column:
            turns_ = conversation.as_py()
            roles = sorted({t["role"] for t in turns_})
            head = b"OpusHead\x01\x02" + struct.pack("<HIhB", PRE_SKIP, 48000, 0, 0)
            streams = {i + 1: [(0, head + role.encode())] for i, role in enumerate(roles)}
            order, clock_ = [], {i + 1: PRE_SKIP for i in range(len(roles))}
            for t in turns_:
                serial, packet = roles.index(t["role"]) + 1, t["text"].encode()
                clock_[serial] += FRAME * max(1, -(-len(packet) // FRAME_BYTES))
                streams[serial].append((clock_[serial], packet))
                order.append(serial)
            out.append(mux(streams, order))
        return pa.array(out, pa.binary())

    return rows.select("id", run("turns").alias("content"))
