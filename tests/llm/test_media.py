import hashlib
import zlib

from loomfold.llm import ogg
from loomfold.llm.media import pad_payload, read_media, store_texts


def slow_crc(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def test_checksum():
    for data in (b"", b"a", b"OggS and more", bytes(range(256)) * 3):
        assert ogg.crc32_ogg(data) == slow_crc(data)


def test_round_trip_and_times():
    for n in (192, 3840, 3840 * 5 + 192, 200_064):
        samples = (bytes(range(256)) * (n // 256 + 1))[:n]
        got = ogg.read_pcm(ogg.write_pcm(samples))
        assert got["samples"] == samples and not got["damaged"] and got["streams"] == 2
        assert got["indexed"] == len(got["times"]) == -(-n // ogg.PACKET)
        assert got["times"][-1][1] == n / ogg.RATE and got["times"][0][0] == 0
        assert all(a[1] == b[0] for a, b in zip(got["times"], got["times"][1:], strict=False))


def test_packets_across_pages_and_multiples_of_255():
    w = ogg.StreamWriter(7, segments=3)
    packets = [b"x" * n for n in (0, 255, 510, 765, 2000, 1)]
    data = b"".join(w.packet(p, i, last=i == 5) for i, p in enumerate(packets))
    streams, damaged = ogg.demultiplex(data)
    assert [p.data for p in streams[7].packets] == packets and not damaged and streams[7].ended


def test_damage_loses_only_its_packets():
    samples = bytes(200_064)
    data = bytearray(ogg.write_pcm(samples))
    pages = [i for i in range(len(data)) if data[i : i + 4] == b"OggS"]
    data[pages[4] + 40] ^= 1
    streams, damaged = ogg.demultiplex(b"junk" + bytes(data) + b"OggS")
    assert damaged == 3 and sum(s.gaps for s in streams.values()) == 1
    whole = len(ogg.demultiplex(ogg.write_pcm(samples))[0][1].packets)
    assert 0 < len(streams[1].packets) < whole
    assert all(len(p.data) in (28, 3840, 192, 384) or not len(p.data) % 192 for p in streams[1].packets)
    assert ogg.read_pcm(b"")["samples"] == b"" and ogg.read_pcm(b"no ogg at all")["damaged"] == 1


def test_odd_rows(odd_docs, odd_rows, no_docs):
    got = read_media(store_texts(odd_docs)).collect()
    want = sorted((len((t or "").encode()), hashlib.sha256(pad_payload((t or "").encode())).hexdigest(), zlib.crc32(pad_payload((t or "").encode())[-16:])) for _, t, *_ in odd_rows)
    assert sorted((r["n_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    assert all("damaged=0" in r["feature"] for r in got)
    same = {r["n_bytes"]: r["media_sha256"] for r in got}
    assert all(same[r["n_bytes"]] == r["media_sha256"] or r["n_bytes"] for r in got)
    assert read_media(store_texts(no_docs)).count() == 0


def test_feature_is_what_a_loop_over_the_samples_finds(spark):
    texts = ["", "short", "é" * 100, "some words here. " * 700, "x" * 20_000]
    got = read_media(store_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    for r in got:
        samples = [b - 128 for b in pad_payload(texts[r["rest"]["doc_id"]].encode())]
        feature = dict(x.split("=") for x in r["feature"].split(";"))
        crossed = sum((a >= 0) != (b >= 0) for a, b in zip(samples, samples[1:], strict=False))
        packets = -(-len(samples) // ogg.PACKET)
        assert int(feature["ms"]) == round(1000 * len(samples) / ogg.RATE)
        assert int(feature["mean"]) == sum(samples) // len(samples) and int(feature["energy"]) == sum(x * x for x in samples) // len(samples)
        assert (int(feature["crossings"]), int(feature["packets"]), int(feature["indexed"]), int(feature["damaged"])) == (crossed, packets, packets, 0)


def test_a_very_long_text(spark):
    text = "0123456789 " * 300_000
    r = read_media(store_texts(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert r["n_bytes"] == len(text) and r["payload_sha256"] == hashlib.sha256(pad_payload(text.encode())).hexdigest() and "damaged=0" in r["feature"]
