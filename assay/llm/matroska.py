"""Media columns: Matroska bytes to packet tables.

``parse`` walks EBML elements (variable-length ids and sizes, unknown sizes
included) through Segment, Tracks, Clusters, SimpleBlocks, BlockGroups with any
lacing (none, Xiph, fixed, EBML) and Cues, and returns one packet for each frame
with its track, timestamp and byte range in the file.  ``packet_table`` applies
it to a binary column.  ``as_media`` stores texts losslessly as 8-bit PCM: the
UTF-8 bytes, zero-padded to a positive multiple of 64, are the samples of a mono
track cut into frames, laced into blocks, clusters and cue points.

A packet table is exploded in the task that parses the row: one row of media is
one unit of work, and nothing is shuffled.

Null media give no packets, null texts are stored as empty ones.  Damaged media
give the packets before the damage and a non-null ``error``.  Very long texts are
stored whole.  Repeated rows are all returned; ids may have any type; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import freeing, small_batches

# Element ids of the Matroska and EBML specifications.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, TRACK, NUMBER, UID, KIND, CODEC, LACING = 0x2AD7B1, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C
AUDIO, RATE, CHANNELS, DEPTH, DEFAULT_DURATION = 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE, MUXER, WRITER = 0x4282, 0x4D80, 0x5741
_TOP = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES}

SAMPLE_RATE, FRAME, LACED, BLOCKS = 8000, 512, 8, 16


class Damaged(ValueError):
    pass


@dataclass
class Media:
    scale: int = 1_000_000
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple] = field(default_factory=list)  # track, timestamp in ns, start, size, key frame, lacing
    clusters: int = 0
    blocks: int = 0
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time in ns, track, position of the cluster
    error: str | None = None


# ---- reading --------------------------------------------------------------------------------------


def vint(data: memoryview, at: int, end: int, keep_marker: bool = False) -> tuple[int, int, bool]:
    """A variable-length integer: (value, place after it, whether all its value bits are set)."""
    if at >= end or not data[at]:
        raise Damaged(f"no variable-length integer at {at}")
    n = 9 - data[at].bit_length()
    if at + n > end:
        raise Damaged(f"cut off at {at}")
    raw = int.from_bytes(data[at : at + n], "big")
    value = raw & ((1 << (7 * n)) - 1)
    return (raw if keep_marker else value), at + n, value == (1 << (7 * n)) - 1


def elements(data: memoryview, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of the elements' contents in a range; one of unknown size reaches to the next top-level element or the end."""
    while at < end:
        eid, body, _ = vint(data, at, end, True)
        size, body, unknown = vint(data, body, end)
        if unknown:
            stop = _until(data, body, end, eid)
        elif body + size > end:
            yield eid, body, end
            raise Damaged(f"element {eid:#x} at {at} reaches beyond its parent")
        else:
            stop = body + size
        yield eid, body, stop
        at = stop


def _until(data: memoryview, at: int, end: int, inside: int) -> int:
    while at < end and inside != SEGMENT:
        eid, body, _ = vint(data, at, end, True)
        if eid in _TOP:
            return at
        size, body, _ = vint(data, body, end)
        at = min(end, body + size)
    return end


def _uint(data: memoryview, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _float(data: memoryview, a: int, b: int) -> float:
    return struct.unpack(">f" if b - a == 4 else ">d", data[a:b])[0] if b - a in (4, 8) else 0.0


def laces(data: memoryview, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """(start, size) of each frame of a block's body; kind: 0 none, 1 Xiph, 2 fixed, 3 EBML."""
    if kind == 0:
        return [(at, end - at)]
    if at >= end:
        raise Damaged("laced block without a frame count")
    n, at = data[at] + 1, at + 1
    if kind == 2:
        if (end - at) % n:
            raise Damaged("fixed lacing does not divide the block")
        sizes = [(end - at) // n] * n
    else:
        sizes = []
        for k in range(n - 1):
            if kind == 1:
                size = 0
                while True:
                    if at >= end:
                        raise Damaged("Xiph lacing cut off")
                    size, at = size + data[at], at + 1
                    if data[at - 1] != 255:
                        break
            else:
                start = at
                value, at, _ = vint(data, at, end)
                size = value if k == 0 else sizes[-1] + value - ((1 << (7 * (at - start) - 1)) - 1)
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0 or sum(sizes) > end - at:
        raise Damaged("lacing sizes do not fit the block")
    out = []
    for s in sizes:
        out.append((at, s))
        at += s
    return out


def _block(m: Media, data: memoryview, a: int, b: int, cluster_time: int, key: bool | None) -> None:
    track, at, _ = vint(data, a, b)
    if at + 3 > b:
        raise Damaged(f"block at {a} cut off")
    relative, flags = struct.unpack(">hB", data[at : at + 3])
    lacing = (flags >> 1) & 3
    each = m.tracks.get(track, {}).get("duration", 0)
    m.blocks += 1
    for k, (start, size) in enumerate(laces(data, at + 3, b, lacing)):
        m.packets.append((track, (cluster_time + relative) * m.scale + k * each, start, size, bool(flags & 0x80) if key is None else key, lacing))


def parse(media: bytes | memoryview) -> Media:
    m, data = Media(), memoryview(media).cast("B")
    try:
        first = True
        for eid, a, b in elements(data, 0, len(data)):
            if first and eid != EBML:
                raise Damaged("no EBML header")
            first = False
            if eid == SEGMENT:
                _segment(m, data, a, b)
        if first:
            raise Damaged("empty")
    except Damaged as e:
        m.error = str(e)
    return m


def _segment(m: Media, data: memoryview, a: int, b: int) -> None:
    for eid, x, y in elements(data, a, b):
        if eid == INFO:
            for e, s, t in elements(data, x, y):
                if e == TIMESTAMP_SCALE:
                    m.scale = _uint(data, s, t)
        elif eid == TRACKS:
            for e, s, t in elements(data, x, y):
                if e == TRACK:
                    _track(m, data, s, t)
        elif eid == CLUSTER:
            m.clusters += 1
            time = 0
            for e, s, t in elements(data, x, y):
                if e == TIMESTAMP:
                    time = _uint(data, s, t)
                elif e == SIMPLE_BLOCK:
                    _block(m, data, s, t, time, None)
                elif e == BLOCK_GROUP:
                    inner = list(elements(data, s, t))
                    key = not any(i == REFERENCE for i, _, _ in inner)
                    for i, p, q in inner:
                        if i == BLOCK:
                            _block(m, data, p, q, time, key)
        elif eid == CUES:
            for e, s, t in elements(data, x, y):
                if e == CUE_POINT:
                    time, where = 0, []
                    for i, p, q in elements(data, s, t):
                        if i == CUE_TIME:
                            time = _uint(data, p, q)
                        elif i == CUE_POSITIONS:
                            parts = {j: _uint(data, u, v) for j, u, v in elements(data, p, q) if j in (CUE_TRACK, CUE_CLUSTER)}
                            where.append((parts.get(CUE_TRACK, 0), a + parts.get(CUE_CLUSTER, 0)))
                    m.cues += [(time * m.scale, track, at) for track, at in where]


def _track(m: Media, data: memoryview, a: int, b: int) -> None:
    t: dict = {"number": 0, "kind": 0, "codec": "", "duration": 0, "rate": 8000.0, "channels": 1, "depth": 0}
    for e, s, u in elements(data, a, b):
        if e in (NUMBER, KIND, DEFAULT_DURATION):
            t[{NUMBER: "number", KIND: "kind", DEFAULT_DURATION: "duration"}[e]] = _uint(data, s, u)
        elif e == CODEC:
            t["codec"] = bytes(data[s:u]).decode("ascii", "replace")
        elif e == AUDIO:
            for i, p, q in elements(data, s, u):
                if i == RATE:
                    t["rate"] = _float(data, p, q)
                elif i in (CHANNELS, DEPTH):
                    t["channels" if i == CHANNELS else "depth"] = _uint(data, p, q)
    m.tracks[t["number"]] = t


# ---- writing --------------------------------------------------------------------------------------


def _size(n: int) -> bytes:
    k = 1
    while n >= (1 << (7 * k)) - 1:
        k += 1
    return ((1 << (7 * k)) | n).to_bytes(k, "big")


def _el(eid: int, body: bytes) -> bytes:
    return eid.to_bytes((eid.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def _num(eid: int, n: int) -> bytes:
    return _el(eid, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _signed(n: int) -> bytes:
    k = 1
    while not -((1 << (7 * k - 1)) - 1) <= n <= (1 << (7 * k - 1)) - 1:
        k += 1
    return ((1 << (7 * k)) | (n + (1 << (7 * k - 1)) - 1)).to_bytes(k, "big")


def lace(frames: list[bytes], kind: int) -> bytes:
    """A block's body."""
    if kind == 0:
        return frames[0]
    sizes = [len(f) for f in frames]
    head = bytes([len(frames) - 1])
    if kind == 1:
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif kind == 3:
        head += _size(sizes[0]) + b"".join(_signed(y - x) for x, y in zip(sizes[:-2], sizes[1:-1], strict=True))
    return head + b"".join(frames)


_HEADER = _el(EBML, _el(DOC_TYPE, b"matroska"))
_INFO = _el(INFO, _num(TIMESTAMP_SCALE, 1_000_000) + _el(MUXER, b"assay") + _el(WRITER, b"assay"))
_TRACK = _el(TRACKS, _el(TRACK, _num(NUMBER, 1) + _num(UID, 1) + _num(KIND, 2) + _num(LACING, 1) + _num(DEFAULT_DURATION, FRAME * 10**9 // SAMPLE_RATE) + _el(CODEC, b"A_PCM/INT/LIT") + _el(AUDIO, _el(RATE, struct.pack(">f", SAMPLE_RATE)) + _num(CHANNELS, 1) + _num(DEPTH, 8))))


def padded(data: bytes) -> bytes:
    return data + bytes((-len(data)) % 64 if data else 64)


def write(payload: bytes) -> bytes:
    """The payload as the samples of a Matroska file; the lacing kinds take turns."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    blocks = [frames[i : i + LACED] for i in range(0, len(frames), LACED)]
    body, cues = bytearray(_INFO + _TRACK), b""
    for c in range(0, len(blocks), BLOCKS):
        time = c * LACED * FRAME * 1000 // SAMPLE_RATE
        cluster = _num(TIMESTAMP, time)
        for k, group in enumerate(blocks[c : c + BLOCKS]):
            equal = len({len(f) for f in group}) == 1
            kind = 0 if len(group) == 1 else (2, 1, 3)[k % 3] if equal else (1, 3)[k % 2]
            head = b"\x81" + struct.pack(">hB", k * LACED * FRAME * 1000 // SAMPLE_RATE, 0x80 | kind << 1)
            cluster += _el(SIMPLE_BLOCK, head + lace(group, kind))
        cues += _el(CUE_POINT, _num(CUE_TIME, time) + _el(CUE_POSITIONS, _num(CUE_TRACK, 1) + _num(CUE_CLUSTER, len(body))))
        body += _el(CLUSTER, cluster)
    body += _el(CUES, cues)
    return _HEADER + _el(SEGMENT, bytes(body))


# ---- columns --------------------------------------------------------------------------------------


def _write_rows(batches):
    for b in batches:
        at, step = 0, 256
        while at < b.num_rows:
            part = b.slice(at, step)
            texts = [(x or "").encode() for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array([write(padded(x)) for x in texts], pa.binary())], names=["id", "n_bytes", "media"])
            at += step


def as_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text as a Matroska file."""
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(freeing(_write_rows), f"id {id_type}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def _packet_rows(batches):
    for b in batches:
        ids, rows = [], []
        for i, media in enumerate(b.column(1)):
            m = parse(media.as_buffer()) if media.is_valid else Media()
            got = [(k, *p, m.tracks.get(p[0], {}).get("codec"), m.error) for k, p in enumerate(m.packets)]
            rows += got or ([(None,) * 8 + (m.error,)] if m.error else [])
            ids += [i] * (len(got) or bool(m.error))
        names = ["packet", "track", "timestamp_ns", "start", "size", "key_frame", "lacing", "codec", "error"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.string(), pa.string()]
        cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), *[pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)]], names=["id", *names])


def packet_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id, packet, track, timestamp_ns, start, size, key_frame, lacing, codec, error): a row for each packet of each file."""
    id_type = media.schema[id_col].dataType.simpleString()
    rows = media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    return rows.mapInArrow(freeing(_packet_rows), f"id {id_type}, packet long, track long, timestamp_ns long, start long, size long, key_frame boolean, lacing int, codec string, error string").withColumnRenamed("id", id_col)


def payload(media, m: Media) -> bytes:
    """The bytes of all packets in file order."""
    return b"".join([media[start : start + size] for _, _, start, size, _, _ in m.packets])


def _feature(m: Media, data: bytes) -> str:
    x = np.frombuffer(data, np.uint8)
    t = next(iter(m.tracks.values()), {})
    kinds = ",".join(str(sum(1 for p in m.packets if p[5] == k)) for k in range(4))
    last, mean, peak = m.packets[-1][1] if m.packets else 0, x.mean() if len(x) else 0.0, x.max() if len(x) else 0
    return f"codec={t.get('codec')};rate={t.get('rate') or 0:g};clusters={m.clusters};blocks={m.blocks};packets={len(m.packets)};lacing={kinds};cues={len(m.cues)};last_ns={last};mean={mean:.4f};peak={peak}"


def _digest_rows(batches):
    for b in batches:
        rows = []
        for media in b.column(2):
            if not media.is_valid:
                rows.append((None,) * 7)
                continue
            raw = media.as_buffer().to_pybytes()
            m = parse(raw)
            p = payload(raw, m)
            rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), _feature(m, p), m.error))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)]], names=names)


def digests(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, error), read back from the stored files.

    Null media have null digests; damaged ones the digests of the packets before the damage, and the error.
    """
    small_batches(media.sparkSession)
    id_type = media.schema[id_col].dataType.simpleString()
    rows = media.select(F.col(id_col).alias("id"), F.col("n_bytes").cast("long").alias("n_bytes"), F.col(media_col).alias("media"))
    kinds = f"id {id_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
    return rows.mapInArrow(freeing(_digest_rows), kinds).withColumnRenamed("id", id_col)
