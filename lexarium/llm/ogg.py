"""Media columns in Ogg.

A payload is stored losslessly as unsigned 8-bit samples at 8 kHz in two logical streams: frames of 64 samples go to them in
turn. ``mux`` writes pages with lacing values, granule positions and checksums; ``demux`` finds the pages by
their capture pattern, verifies the checksums, separates the streams by serial number, puts packets together from the lacing
values, also over page ends, and gives each a begin and end in seconds from the granule positions.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import arrow_map, batch_of, id_text, table, texts

FRAME = 64
RATE = 8000
#: Samples of a packet; a multiple of FRAME.
PACKET = 4096
#: Fixed values of the container format.
CAPTURE = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
_PAGE = struct.Struct("<4sBBqIIIB")
#: Of the first packet of a stream: name, version, stream's number, number of streams, frame, rate, unpadded bytes.
_HEAD = struct.Struct("<8sBBBxIIQ")
_MAGIC = b"PCM     "
#: A first packet that speaks of more is none of ours.
MOST_BYTES = 1 << 31
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(page: bytes) -> int:
    """CRC-32 with polynomial 04c11db7, not reflected, from 0: the reflected CRC of the bytes with their bits reversed."""
    c = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(c.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    blank = _PAGE.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body
    return blank[:22] + struct.pack("<I", checksum(blank)) + blank[26:]


def paginate(packets: list[tuple[bytes, int]], serial: int) -> list[tuple[int, bytes]]:
    """(granule, page) of one logical stream; ``packets`` are (bytes, granule at the end). The first is alone on its page."""
    pages: list[tuple[int, bytes]] = []

    def flush(lacing: bytearray, body: list[bytes], granule: int, continued: bool, last: bool) -> None:
        flags = CONTINUED * continued | FIRST * (not pages) | LAST * last
        pages.append((granule, _page(flags, granule, serial, len(pages), bytes(lacing), b"".join(body))))

    lacing, body, granule, continued = bytearray(), [], -1, False
    for k, (packet, end) in enumerate(packets):
        values = [255] * (len(packet) // 255) + [len(packet) % 255]
        at = 0
        for i, v in enumerate(values):
            if len(lacing) == 255:
                flush(lacing, body, granule, continued, False)
                lacing, body, granule, continued = bytearray(), [], -1, i > 0
            lacing.append(v)
            body.append(packet[at : at + v])
            at += v
        granule = end
        if k == 0 or k == len(packets) - 1:
            flush(lacing, body, granule, continued, k == len(packets) - 1)
            lacing, body, granule, continued = bytearray(), [], -1, False
    return pages


def padded(content: bytes) -> bytes:
    """With bytes 0 up to a positive multiple of FRAME."""
    return content + bytes(-len(content) % FRAME if content else FRAME)


def mux(content: bytes) -> bytes:
    """``content``, padded, as an Ogg file of two logical streams."""
    payload = padded(content)
    frames = np.frombuffer(payload, np.uint8).reshape(-1, FRAME)
    pages = []
    for s in (0, 1):
        own = frames[s::2]
        packets = [(_HEAD.pack(_MAGIC, 1, s, 2, FRAME, RATE, len(content)), 0)]
        step = PACKET // FRAME
        for i in range(0, len(own), step):
            part = own[i : i + step]
            packets.append((part.tobytes(), (2 * (i + len(part) - 1) + s + 1) * FRAME))
        pages += [(granule, k > 0, s, k, page) for k, (granule, page) in enumerate(paginate(packets, s + 1))]
    # first pages of all streams come first; the others by time (a page in which no packet ends goes with the one after it)
    last: dict[int, int] = {}
    timed = []
    for granule, later, s, k, page in reversed(pages):
        last[s] = granule if granule >= 0 else last.get(s, 0)
        timed.append((later, last[s], s, k, page))
    return b"".join(x[-1] for x in sorted(timed, key=lambda x: x[:4]))


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    #: Granule position at the end of a packet; -1 where the page gives it for a later one.
    granules: list[int] = field(default_factory=list)
    lost: int = 0
    ended: bool = False
    #: The first page is missing.
    headless: bool = False
    _open: bytearray | None = None
    _next: int = 0


def demux(media: bytes) -> tuple[dict[int, Stream], dict[str, int]]:
    """Logical streams by serial, and counts: pages, bad (checksum), skipped (bytes outside of pages).

    A page that is cut off or fails its checksum is left out; a packet of which part is missing is dropped and counted as lost.
    """
    streams: dict[int, Stream] = {}
    seen = {"pages": 0, "bad": 0, "skipped": 0}
    at = 0
    while (found := media.find(CAPTURE, at)) >= 0:
        seen["skipped"] += found - at
        head = media[found : found + _PAGE.size]
        if len(head) < _PAGE.size:
            at = found
            break
        _, version, flags, granule, serial, number, crc, n = _PAGE.unpack(head)
        lacing = media[found + _PAGE.size : found + _PAGE.size + n]
        end = found + _PAGE.size + n + sum(lacing)
        page = media[found:end]
        if version or len(lacing) < n or end > len(media) or checksum(page[:22] + bytes(4) + page[26:]) != crc:
            seen["bad"] += 1
            seen["skipped"] += 4
            at = found + 4
            continue
        seen["pages"] += 1
        s = streams.setdefault(serial, Stream(serial))
        if number != s._next:  # pages are missing
            s.headless |= s._next == 0
            s.lost += 1
            s._open = None
        s._next = number + 1
        if not flags & CONTINUED and s._open is not None:
            s.lost += 1
            s._open = None
        whole = not flags & CONTINUED or s._open is not None
        part = s._open if s._open is not None else bytearray()
        s._open = None
        done, where = 0, found + _PAGE.size + n
        for v in lacing:
            part += media[where : where + v]
            where += v
            if v < 255:
                if whole:
                    s.packets.append(bytes(part))
                    s.granules.append(-1)
                    done += 1
                part, whole = bytearray(), True
        if n and lacing[-1] == 255 and whole:
            s._open = part
        if done:
            s.granules[-1] = granule
        s.ended |= bool(flags & LAST)
        at = end
    seen["skipped"] += len(media) - at
    return streams, seen


@dataclass(frozen=True)
class Head:
    """What the first packet of a stream says; ``own`` is the stream's place among ``streams``."""

    own: int
    streams: int
    frame: int
    rate: int
    length: int

    @property
    def frames(self) -> int:
        return max(1, -(-self.length // self.frame))


def head_of(packet: bytes) -> Head | None:
    """None if this isn't a first packet as ``mux`` writes it."""
    if len(packet) != _HEAD.size or packet[:8] != _MAGIC:
        return None
    _, version, own, streams, frame, rate, length = _HEAD.unpack(packet)
    return Head(own, streams, frame, rate, length) if version == 1 and own < streams and frame and rate and length <= MOST_BYTES else None


def timed_packets(stream: Stream, head: Head) -> list[tuple[int, bytes]]:
    """(granule position at the end, samples) of the data packets that are whole frames in the stream's places; others are counted as lost.

    Where a page gives no granule position for a packet, it follows from the next, which ends on the same page.
    """
    first = 1 if stream.packets and head_of(stream.packets[0]) else 0
    data, ends = stream.packets[first:], list(stream.granules[first:])
    for i in range(len(ends) - 2, -1, -1):
        if ends[i] < 0:
            ends[i] = ends[i + 1] - len(data[i + 1]) * head.streams
    out = []
    for samples, end in zip(data, ends, strict=True):
        n, last = len(samples) // head.frame, end // head.frame - 1
        fits = n and len(samples) % head.frame == 0 and end % head.frame == 0 and last % head.streams == head.own
        if fits and last - head.streams * (n - 1) >= 0 and last < head.frames:
            out.append((end, samples))
        else:
            stream.lost += 1
    return out


def demuxed_payload(media: bytes) -> tuple[bytes, int, list[tuple[int, float, float, int]], dict[str, int]]:
    """Payload, its unpadded length, (serial, begin, end, bytes) of the packets, and the counts of ``demux`` with lost and missing.

    Each packet is placed by its granule position; what no packet fills is zeros, ``missing`` counts these bytes, and ``lost`` the packets that they were, or
    those that were dropped if they are more. A stream whose
    first packet is lost has the place that is left, if there is but one. Streams of other kinds are left out. Without any first
    packet there is no payload.
    """
    streams, seen = demux(media)
    heads = {k: h for k, s in sorted(streams.items()) if s.packets and (h := head_of(s.packets[0]))}
    seen |= {"lost": 0, "missing": 0}
    spans: list[tuple[int, float, float, int]] = []
    if not heads:
        seen["lost"] = sum(s.lost for s in streams.values())
        return b"", 0, spans, seen
    known = next(iter(heads.values()))
    heads = {k: h for k, h in heads.items() if h == replace(known, own=h.own)}
    headless = [k for k, s in streams.items() if k not in heads and s.headless]
    free = sorted(set(range(known.streams)) - {h.own for h in heads.values()})
    if len(headless) == len(free) == 1:
        heads[headless[0]] = replace(known, own=free[0])
    frames = np.zeros((known.frames, known.frame), np.uint8)
    filled = np.zeros(known.frames, bool)
    for serial in sorted(heads):
        head = heads[serial]
        for end, samples in timed_packets(streams[serial], head):
            n, last = len(samples) // head.frame, end // head.frame - 1
            begin = last - head.streams * (n - 1)
            frames[begin : last + 1 : head.streams] = np.frombuffer(samples, np.uint8).reshape(n, head.frame)
            filled[begin : last + 1 : head.streams] = True
            spans.append((serial, begin * head.frame / head.rate, end / head.rate, len(samples)))
        seen["lost"] += streams[serial].lost
    seen["missing"] = int((~filled).sum()) * known.frame
    # pages that are gone leave no trace but frames that nothing fills: so many packets, as ``mux`` cuts them, and the first ones of streams
    step, places = max(1, PACKET // known.frame), [~filled[k :: known.streams] for k in range(known.streams)]
    gone = sum(int((np.add.reduceat(x, np.arange(0, len(x), step), dtype=np.int64) > 0).sum()) for x in places if len(x))
    present = sum(bool(streams[k].packets and head_of(streams[k].packets[0])) for k in heads)
    seen["lost"] = max(seen["lost"], gone + known.streams - present)
    return frames.tobytes(), known.length, spans, seen


def feature(payload: bytes, spans: list[tuple[int, float, float, int]]) -> str:
    """Duration, packets, mean, root mean square, crossings of the mean and entropy of the samples."""
    x = np.frombuffer(payload, np.uint8)
    signal = x.astype(np.float32) - 128
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / max(1, x.size)
    level = float(np.sqrt(np.mean(signal.astype(np.float64) ** 2))) if x.size else 0.0
    mean = float(signal.mean(dtype=np.float64)) if x.size else 0.0
    above = signal >= mean
    crossings = int(np.count_nonzero(above[1:] != above[:-1]))
    end = max((e for _, _, e, _ in spans), default=0.0)
    return f"duration={end:.6f};packets={len(spans)};mean={mean:.4f};rms={level:.4f};crossings={crossings};entropy={float(-(p * np.log2(p)).sum()) + 0.0:.4f}"


def to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, media): each text's UTF-8 bytes as an Ogg file. Null text counts as empty; the least payload is one frame of zeros."""

    def each(batch):
        ids, out, size = [], [], 0
        for i, t in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
            ids.append(i)
            out.append(mux(t.encode()))
            size += len(out[-1])
            if size > 8 << 20:
                yield batch_of(doc_id=pa.array(ids, pa.int64()), media=pa.array(out, pa.binary()))
                ids, out, size = [], [], 0
        if ids:
            yield batch_of(doc_id=pa.array(ids, pa.int64()), media=pa.array(out, pa.binary()))

    return arrow_map(id_text(docs), each, "doc_id long, media binary")


_FOUND = {
    "doc_id": "long", "n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string",
    "feature": "string", "pages": "long", "bad_pages": "long", "lost_packets": "long", "missing_bytes": "long",
}


def from_media(media: DataFrame) -> DataFrame:
    """What the stored bytes of (doc_id, media) hold: payload and stored form as digests and lengths, page counts and the feature.

    Bad pages are left out and counted, as are packets of which part is lost; samples that no packet gives are zeros and counted as
    missing. Null media, and media without a first packet of this kind, give zeros and a payload of no bytes.
    """

    def each(batch):
        for i, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            m = m or b""
            payload, length, spans, seen = demuxed_payload(m)
            yield (
                i, length, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature(payload, spans),
                seen["pages"], seen["bad"], seen["lost"], seen["missing"],
            )

    def rows(batches):
        for batch in batches:
            cols = list(zip(*each(batch), strict=True)) or [[]] * len(_FOUND)
            yield batch_of(**{n: pa.array(c, pa.string() if k == "string" else pa.int64()) for (n, k), c in zip(_FOUND.items(), cols, strict=True)})

    return media.select("doc_id", "media").mapInArrow(rows, ", ".join(f"{n} {k}" for n, k in _FOUND.items()))


def packets(media: DataFrame) -> DataFrame:
    """One row for each data packet of (doc_id, media): serial, position in its stream, begin and end in seconds, bytes."""

    def each(batch):
        rows = []
        for i, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            nth: dict[int, int] = {}
            for serial, begin, end, size in demuxed_payload(m or b"")[2]:
                rows.append((i, serial, nth.setdefault(serial, 0), begin, end, size))
                nth[serial] += 1
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
        yield batch_of(**{n: pa.array(list(c), k) for n, c, k in zip(("doc_id", "serial", "packet", "begin_s", "end_s", "n_bytes"), cols, kinds, strict=True)})

    return arrow_map(media.select("doc_id", "media"), each, "doc_id long, serial long, packet long, begin_s double, end_s double, n_bytes long")


def query(spark, sf_dir: str) -> DataFrame:
    return from_media(to_media(table(spark, sf_dir, "documents")))
