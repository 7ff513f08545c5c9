"""Ogg files with damage at every page, and passage features against a plain version."""

import hashlib
import math
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from lexarium.llm import ogg, quality


def pages_of(media):
    """(begin, end) of each page of an undamaged file."""
    at, found = 0, []
    while at < len(media):
        n = media[at + 26]
        end = at + 27 + n + sum(media[at + 27 : at + 27 + n])
        found.append((at, end))
        at = end
    return found


def slow_checksum(data):
    c = 0
    for byte in data:
        c ^= byte << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c >> 31 else c << 1) & 0xFFFFFFFF
    return c


@pytest.fixture(scope="module")
def content():
    return bytes(np.random.default_rng(5).integers(1, 256, 150_000, np.uint8))


def test_pages_have_the_checksum_of_the_format(content):
    media = ogg.mux(content[:9000])
    for a, b in pages_of(media):
        page = media[a:b]
        assert slow_checksum(page[:22] + bytes(4) + page[26:]) == struct.unpack("<I", page[22:26])[0]


def rows_of(spark, medias):
    return {r.doc_id: r for r in ogg.from_media(spark.createDataFrame(list(enumerate(medias)), "doc_id long, media binary")).collect()}


def same_or_zero(payload, content):
    got, want = np.frombuffer(payload, np.uint8).reshape(-1, 64), np.frombuffer(ogg.padded(content), np.uint8).reshape(-1, 64)
    assert got.shape == want.shape
    differs = (got != want).any(axis=1)
    assert not got[differs].any()
    return int(differs.sum()) * 64


def test_a_flipped_byte_in_every_page(spark, content):
    media = ogg.mux(content)
    hurt = []
    for a, b in pages_of(media):
        for at in (a + 1, a + 10, a + 27, b - 1):
            x = bytearray(media)
            x[at] ^= 1
            hurt.append(bytes(x))
    rows = rows_of(spark, hurt)
    for k, m in enumerate(hurt):
        payload, n, spans, seen = ogg.demuxed_payload(m)
        assert n == len(content) == rows[k].n_bytes and rows[k].payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert same_or_zero(payload, content) == seen["missing"] == rows[k].missing_bytes
        assert seen["missing"] > 0 or k // 4 < 2  # first pages carry no samples
        assert rows[k].pages == len(pages_of(media)) - 1 and rows[k].bad_pages + (k % 4 == 0) >= 1


def test_a_cut_at_every_page(spark, content):
    media = ogg.mux(content)
    cuts = [media[:a] for a, _ in pages_of(media)] + [media[: b - 3] for _, b in pages_of(media)] + [media[a:] for a, _ in pages_of(media)]
    rows = rows_of(spark, cuts)
    for k, m in enumerate(cuts):
        payload, n, spans, seen = ogg.demuxed_payload(m)
        assert rows[k].payload_bytes == len(payload)
        if payload:
            assert n == len(content) and same_or_zero(payload, content) == seen["missing"]
        else:
            assert n == 0 and not spans
    assert rows[0].payload_bytes == 0 and rows[1].payload_bytes == len(ogg.padded(content))


def test_foreign_files(spark):
    page = lambda packets, serial: b"".join(p for _, p in ogg.paginate(packets, serial))
    head = ogg._HEAD.pack(ogg._MAGIC, 1, 0, 2, 64, 8000, 1 << 60)
    odd = [
        b"", None, b"OggS", b"OggSOggS" * 50, bytes(1000), page([(b"x", 0)], 1), page([(b"PCM     ", 0), (b"y" * 64, 64)], 1), page([(b"vorbis" * 20, 0), (b"z" * 300, 900)], 9),
        page([(head, 0), (b"y" * 64, 64)], 1), page([(ogg._HEAD.pack(ogg._MAGIC, 1, 0, 0, 0, 0, 10), 0), (b"y" * 64, 64)], 1),
    ]
    assert all(r.payload_bytes == 0 and r.n_bytes == 0 for r in rows_of(spark, odd).values())
    # packets that fit no place of the stream are left out; another kind of stream beside ours doesn't matter
    media = ogg.mux(b"a" * 500) + page([(b"vorbis" * 20, 0), (b"z" * 300, 900)], 9)
    assert ogg.demuxed_payload(media)[0] == ogg.padded(b"a" * 500)
    wrong = page([(ogg._HEAD.pack(ogg._MAGIC, 1, 0, 2, 64, 8000, 500), 0), (b"y" * 64, 128), (b"y" * 63, 64), (b"w" * 64, 1 << 40), (b"v" * 64, 64)], 1)
    payload, _, _, seen = ogg.demuxed_payload(wrong)
    assert payload[:64] == b"v" * 64 and not any(payload[64:]) and seen["lost"] == 3 and seen["missing"] == 448


def test_feature_and_packets(spark):
    text = "Ab\x00é" * 3000
    raw = ogg.padded(text.encode())
    docs = spark.createDataFrame([(1, text), (2, None), (3, text)], "doc_id long, text string")
    rows = {r.doc_id: r for r in ogg.from_media(ogg.to_media(docs)).collect()}
    mean = sum(x - 128 for x in raw) / len(raw)
    rms = math.sqrt(sum((x - 128) ** 2 for x in raw) / len(raw))
    entropy = -sum(n / len(raw) * math.log2(n / len(raw)) for n in Counter(raw).values())
    above = [x - 128 >= mean for x in raw]
    crossings = sum(a != b for a, b in zip(above, above[1:]))
    packets = sum(-(-len(range(s, len(raw) // 64, 2)) // 64) for s in (0, 1))
    assert rows[1].feature == f"duration={len(raw) / 8000:.6f};packets={packets};mean={mean:.4f};rms={rms:.4f};crossings={crossings};entropy={entropy:.4f}"
    assert rows[1].feature == rows[3].feature and rows[1].media_sha256 == rows[3].media_sha256
    assert rows[1].tail_crc32 == zlib.crc32(raw[-64:]) and (rows[2].payload_bytes, rows[2].n_bytes, rows[2].missing_bytes) == (64, 0, 0)
    timed = ogg.packets(ogg.to_media(docs)).where("doc_id = 1").orderBy("begin_s").collect()
    assert len(timed) == packets and sum(r.n_bytes for r in timed) == len(raw) and timed[0].begin_s == 0.0 and max(r.end_s for r in timed) == len(raw) / 8000


TEXTS = ["", " ", "one", "gamma rho", " gamma rho gamma rho gamma rho", "the end the end the end!!", "É" * 90, "a b " * 200, "\n\nx  y\tz " * 60, "w w w", "rho\n"]


def test_features_of_a_text_are_its_own():
    """Alone and in any group."""
    together, sizes = quality.encode(TEXTS)
    back, back_sizes = quality.encode(TEXTS[::-1])
    parts, back_parts = np.split(together, np.cumsum(sizes)[:-1]), np.split(back, np.cumsum(back_sizes)[:-1])[::-1]
    for t, part, other in zip(TEXTS, parts, back_parts, strict=True):
        alone, n = quality.encode([t])
        assert n[0] == len(part) and np.array_equal(alone, part) and np.array_equal(part, other)


def test_features_against_a_plain_version():
    for t in TEXTS:
        x, _ = quality.encode([t])
        raw = t.encode() + b" "
        words = t.encode().split()
        assert np.isclose(x[:, quality._CLASSES : quality._CLASSES + quality._HASHED].sum(), len(x) if words else 0)
        threes = Counter(tuple(w.lower() for w in words[i : i + 3]) for i in range(len(words) - 2))
        for p in range(len(x)):
            own = words[64 * p : 64 * p + 64]
            k = quality._CLASSES + quality._HASHED
            assert np.isclose(x[p, k], sum(map(len, own)) / max(1, len(own)) / 10)
            assert np.isclose(x[p, k + 1], len({w.lower() for w in own}) / max(1, len(own)))
            again = [threes[tuple(w.lower() for w in words[i : i + 3])] > 1 for i in range(64 * p, min(64 * p + 64, len(words) - 2))]
            assert np.isclose(x[p, k + 2], sum(again) / max(1, len(own)))
        if len(x) == 1:
            assert np.isclose(x[0, k + 3], sum(a == b for a, b in zip(raw, raw[1:])) / len(raw))


def test_attention_bag_by_bag():
    rng = np.random.default_rng(2)
    sizes = np.array([3, 1, 5])
    x = rng.normal(size=(9, quality.FEATURES))
    m = quality.GatedAttention.fit(x, sizes, np.array([1.0, 0, 1]))
    p, at, want = m.p, 0, []
    for n in sizes:
        h = [np.tanh((v - p["mean"]) / p["std"] @ p["W"] + p["b"]) for v in x[at : at + n]]
        s = [float((np.tanh(v @ p["V"]) * (1 / (1 + np.exp(-(v @ p["U"]))))) @ p["w"]) for v in h]
        weights = np.exp(s) / np.exp(s).sum()
        z = sum(a * v for a, v in zip(weights, h))
        want.append(1 / (1 + np.exp(-(z @ p["c"] + p["d"][0]))))
        at += n
    assert np.allclose(m.score(x, sizes), want, atol=1e-8)


def test_lost_packets_are_counted_wherever_they_were():
    """Damage to any page: as many packets are lost as frames that nothing fills amount to, at a stream's end too."""
    content = bytes(np.random.default_rng(2).integers(0, 256, 120_000, np.uint8))
    whole = ogg.mux(content)
    assert ogg.demuxed_payload(whole)[3]["lost"] == 0
    starts, at = [], whole.find(b"OggS")
    while at >= 0:
        starts.append(at)
        at = whole.find(b"OggS", at + 4)
    for k, start in enumerate(starts):
        broken = bytearray(whole)
        broken[start + 30] ^= 255
        payload, _, spans, seen = ogg.demuxed_payload(bytes(broken))
        assert seen["bad"] == 1 and (seen["lost"] > 0) == (k > -1), k
        packets = -(-seen["missing"] // ogg.PACKET)
        assert packets <= seen["lost"] <= packets + 3, (k, seen)
    payload, _, _, seen = ogg.demuxed_payload(whole[: starts[-1]])
    assert seen["missing"] > 0 and seen["lost"] >= seen["missing"] // ogg.PACKET > 0
