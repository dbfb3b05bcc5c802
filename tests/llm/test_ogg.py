import random
import struct

from tidewater.llm import ogg as O


def crc_bitwise(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def head(skip=312):
    return b"OpusHead\x01\x02" + struct.pack("<HIhB", skip, 48000, 0, 0)


def sample(seed=1):
    rng = random.Random(seed)
    streams = {7: [(0, head())], 9: [(0, b"\x01vorbis" + struct.pack("<IBI", 0, 2, 44100) + bytes(14))]}
    order, at = [], {7: 312, 9: 0}
    for size in (0, 1, 254, 255, 256, 510, 65025, 65026, 200_000, 300):
        for s in (7, 9):
            at[s] += 48000
            streams[s].append((at[s], rng.randbytes(size)))
            order.append(s)
    rng.shuffle(order)
    return streams, order


def test_checksum():
    rng = random.Random(0)
    for n in (0, 1, 2, 27, 500):
        data = rng.randbytes(n)
        assert O.checksum(data) == crc_bitwise(data)


def test_round_trip():
    streams, order = sample()
    raw = O.mux(streams, order)
    for s, codec, skip, rate in ((7, "opus", 312, 48000), (9, "vorbis", 0, 44100)):
        got = [x for x in O.packets_of(b"noise" + raw + b"OggS tail") if x[0] == s]
        assert [x[8] for x in got] == [p for _, p in streams[s]]
        assert [x[1] for x in got] == list(range(11)) and all(x[7] and x[4] and x[5] == codec for x in got)
        assert [x[3] for x in got] == [g for g, _ in streams[s]]
        assert [x[6] for x in got] == [max(0, g - skip) / rate for g, _ in streams[s]]


def test_damage_drops_what_it_touches():
    streams, order = sample(2)
    raw = O.mux(streams, order)
    listed = list(O.pages_of(raw))
    whole = {(x[0], x[8]) for x in O.packets_of(raw)}
    for hit in (2, 5, len(listed) // 2, len(listed) - 1):
        at, _, _, _, serial, _, lacing, body = listed[hit]
        where = at + 27 + len(lacing) + len(body) // 2 if body else at + 6
        bad = raw[:where] + bytes([raw[where] ^ 1]) + raw[where + 1 :]
        assert sum(not x[1] for x in O.pages_of(bad)) == 1
        got = list(O.packets_of(bad))
        assert all((x[0], x[8]) in whole for x in got if x[7])
        lost = {x for x in whole if x[0] == serial} - {(x[0], x[8]) for x in got if x[7]}
        assert len(lost) == 1
        assert all((x[0], x[8]) in {(y[0], y[8]) for y in got} for x in O.packets_of(raw) if x[0] != serial)


def test_several_packets_on_a_page_and_open_ends():
    first = O.page(1, 0, 0, O.FIRST, bytes([19]), head())
    page = O.page(1, 1, 312 + 300, 0, bytes([2, 3, 4, 255]), b"aabbbcccc" + b"x" * 255)
    got = list(O.packets_of(first + page))
    assert [(x[8], x[3], x[4]) for x in got[1:]] == [(b"aa", 204, False), (b"bbb", 408, False), (b"cccc", 612, True)]
    fresh = O.page(1, 2, 900, 0, bytes([1]), b"z")  # not continued: the open packet is lost
    assert [x[8] for x in O.packets_of(first + page + fresh)][-1] == b"z"
    again = O.page(1, 0, 0, O.FIRST, bytes([1]), b"n")
    last = list(O.packets_of(first + page + again))[-1]
    assert (last[1], last[5], last[6], last[8]) == (0, "unknown", None, b"n")


def test_rows(spark):
    streams, order = sample(3)
    raw = O.mux(streams, order)
    rows = [(1, raw, 5), (2, None, 5), (3, b"", 5), (4, b"OggS", 5), (None, raw, 5), (1, raw, 5)]
    df = spark.createDataFrame(rows, "id bigint, content binary, serial int")
    got = O.packets(df).collect()
    assert len(got) == 66 and {r.id for r in got} == {1, None}
    assert all(r.checksum_ok for r in O.pages(df).collect())
    assert O.packets(df.limit(0)).count() == 0 == O.pages(df.limit(0)).count()


def test_containers(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "x" * 70_000), (1, 2, "user", ""), (None, 0, "user", "a"), (2, 0, None, "b"), (2, 0, "user", None), (1, 0, "user", "hi")]
    got = O.packets(O.containers(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))).collect()
    texts = {(r.id, r.serial): [bytes(x.data).decode() for x in sorted(got, key=lambda x: x.packet) if (x.id, x.serial) == (r.id, r.serial) and x.packet] for r in got}
    assert texts == {(1, 1): ["x" * 70_000], (1, 2): ["hi", "hi", ""], (None, 1): ["a"]}
