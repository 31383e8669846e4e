"""Matroska files in binary columns: writing 8-bit audio, and parsing into tables of packets, tracks and cues.

The parser walks EBML elements with variable-length ids and sizes (unknown sizes too), clusters, simple blocks and block
groups with no, Xiph, fixed-size and EBML lacing, and cues. It keeps byte ranges, not copies of the data.

Defined results: null media gives no packets; a file that breaks off or is no Matroska gives the packets before the
break and an error; an empty payload gives a file without clusters; repeated rows stay; other columns are not read,
whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusflow.llm.tables import pieces, stored

# Element ids of the Matroska specification.
EBML, DOC_TYPE, SEGMENT, INFO, SCALE = 0x1A45DFA3, 0x4282, 0x18538067, 0x1549A966, 0x2AD7B1
TRACKS, TRACK, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS}
TOP = {CLUSTER, CUES, INFO, TRACKS}

RATE = 8000              # samples a second
FRAME = 256              # samples of a full frame, 32 ms
FRAMES_PER_BLOCK = 8
BLOCKS_PER_CLUSTER = 20
UNIT = 64                # payloads are whole multiples of this many samples


# writing

def size_of(n: int) -> bytes:
    """A size as a variable-length number; all ones of a length are reserved."""
    k = 1
    while n >= (1 << (7 * k)) - 1:
        k += 1
    return (n | 1 << (7 * k)).to_bytes(k, "big")


def _id(i: int) -> bytes:
    return i.to_bytes((i.bit_length() + 7) // 8, "big")


def element(i: int, body: bytes) -> bytes:
    return _id(i) + size_of(len(body)) + body


def uint(i: int, n: int) -> bytes:
    return element(i, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes]) -> tuple[int, bytes]:
    """Lacing flags and head for the frames of a block: fixed-size where all are equal, else EBML lacing."""
    sizes = [len(f) for f in frames]
    if len(frames) == 1:
        return 0x00, b""
    if len(set(sizes)) == 1:
        return 0x04, bytes([len(frames) - 1])
    head = bytes([len(frames) - 1]) + size_of(sizes[0])
    for a, b in zip(sizes, sizes[1:-1]):
        d, k = b - a, 1
        while not -((1 << (7 * k - 1)) - 1) <= d <= (1 << (7 * k - 1)) - 1:
            k += 1
        head += (d + (1 << (7 * k - 1)) - 1 | 1 << (7 * k)).to_bytes(k, "big")
    return 0x06, head


def write(payload: bytes) -> bytes:
    """A file with one track of unsigned 8-bit samples."""
    header = element(EBML, uint(0x4286, 1) + uint(0x42F7, 1) + uint(0x42F2, 4) + uint(0x42F3, 8) + element(DOC_TYPE, b"matroska") + uint(0x4287, 4) + uint(0x4285, 2))
    info = element(INFO, uint(SCALE, 1_000_000))
    audio = element(AUDIO, element(SAMPLING, struct.pack(">d", RATE)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    track = element(TRACKS, element(TRACK, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + element(CODEC, b"A_PCM/INT/LIT")
                                    + uint(DEFAULT_DURATION, FRAME * 1_000_000_000 // RATE) + audio))
    body, at, cues = [info, track], len(info) + len(track), []
    step = FRAME * FRAMES_PER_BLOCK
    for c in range(0, len(payload), step * BLOCKS_PER_CLUSTER):
        time = c * 1000 // RATE
        blocks = [uint(TIMESTAMP, time)]
        for b in range(c, min(len(payload), c + step * BLOCKS_PER_CLUSTER), step):
            frames = [payload[f:f + FRAME] for f in range(b, min(len(payload), b + step), FRAME)]
            flags, head = lace(frames)
            blocks.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", b * 1000 // RATE - time, 0x80 | flags) + head + payload[b:b + step]))
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE_POINT, uint(CUE_TIME, time) + element(CUE_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    if cues:
        body.append(element(CUES, b"".join(cues)))
    return header + element(SEGMENT, b"".join(body))


# reading

MAX_DEPTH = 16            # the format itself needs half of it
MAX_NUMBER = (1 << 63) - 1  # of tables


class Broken(ValueError):
    pass


def number(data, at: int, keep_marker: bool = False) -> tuple[int, int, int]:
    """A variable-length number: value, position behind it, its length. All ones give -1 (unknown)."""
    if at >= len(data):
        raise Broken("ends inside a number")
    first = data[at]
    k = 9 - first.bit_length()
    if k > 8 or at + k > len(data):
        raise Broken("bad number")
    n = int.from_bytes(data[at:at + k], "big")
    if keep_marker:
        return n, at + k, k
    n &= (1 << (7 * k)) - 1
    return (-1 if n == (1 << (7 * k)) - 1 else n), at + k, k


@dataclass
class Media:
    packets: list[tuple] = field(default_factory=list)  # track, timestamp in ns, start, length, keyframe, cluster
    tracks: list[dict] = field(default_factory=list)
    cues: list[tuple] = field(default_factory=list)     # time in ns, track, position of the cluster
    scale: int = 1_000_000
    doc_type: str | None = None
    error: str | None = None


def _fits(n: int) -> int:
    if not -MAX_NUMBER <= n <= MAX_NUMBER:
        raise Broken("number beyond 64 bits")
    return n


def _block(data, at: int, end: int, base: int, cluster: int, simple: bool, media: Media, keyframe: bool) -> None:
    track, at, _ = number(data, at)
    if at + 3 > end:
        raise Broken("short block")
    (offset,) = struct.unpack(">h", data[at:at + 2])
    flags = data[at + 2]
    at += 3
    key = bool(flags & 0x80) if simple else keyframe
    lacing = flags >> 1 & 3
    if not lacing:
        sizes = [end - at]
    else:
        count = data[at] + 1
        at += 1
        if lacing == 2:
            if (end - at) % count:
                raise Broken("fixed lacing doesn't divide")
            sizes = [(end - at) // count] * count
        else:
            sizes = []
            for i in range(count - 1):
                if lacing == 1:
                    n = 0
                    while True:
                        if at >= end:
                            raise Broken("short lace")
                        n += data[at]
                        at += 1
                        if data[at - 1] < 255:
                            break
                else:
                    n, at, k = number(data, at)
                    if i:
                        n = sizes[-1] + n - ((1 << (7 * k - 1)) - 1)
                sizes.append(n)
            sizes.append(end - at - sum(sizes))
    if min(sizes) < 0 or at + sum(sizes) > end:
        raise Broken("lace beyond its block")
    duration = next((t.get("duration", 0) for t in media.tracks if t.get("number") == track), 0)
    time = _fits((base + offset) * media.scale)
    _fits(time + len(sizes) * duration)
    for i, n in enumerate(sizes):
        media.packets.append((track, time + i * duration, at, n, key, cluster))
        at += n


def read(data: bytes) -> Media:
    """Walk a file. What stands before a break is kept."""
    media = Media()
    try:
        _walk(data, 0, len(data), media, None, {}, 0)
        if media.doc_type is None:
            media.error = "no EBML header"
    except (Broken, IndexError, struct.error) as e:
        media.error = str(e) or type(e).__name__
    return media


def _walk(data, at: int, end: int, media: Media, parent: int | None, state: dict, depth: int) -> int:
    if depth > MAX_DEPTH:
        raise Broken("elements nested too deep")
    while at < end:
        start = at
        i, at, _ = number(data, at, keep_marker=True)
        if parent == CLUSTER and state.get("open") and i in TOP:
            return start  # a cluster of unknown size ends where the next one begins
        n, at, _ = number(data, at)
        stop = end if n < 0 else at + n
        if stop > end:
            if i not in MASTERS:
                raise Broken(f"element {i:#x} beyond its parent")
            stop, cut = end, True
        else:
            cut = False
        if i in MASTERS:
            inner = {"open": n < 0, "base": 0, "start": start, "segment": at if i == SEGMENT else state.get("segment", 0)}
            if i in (BLOCK_GROUP, AUDIO, CUE_POSITIONS):
                inner = state | {"group": None}
            if i == TRACK:
                media.tracks.append({})
            at = _walk(data, at, stop, media, i, inner, depth + 1)
            if i == BLOCK_GROUP and inner["group"]:
                _block(data, *inner["group"], state["base"], state["start"] - state["segment"], False, media, not inner.get("referenced"))
            if i == CUE_POINT and "time" in inner:
                media.cues.append((_fits(inner["time"] * media.scale), inner.get("track"), inner.get("cluster")))
            if i == CUE_POSITIONS:
                state |= {k: inner[k] for k in ("track", "cluster") if k in inner}
            if cut:
                raise Broken(f"element {i:#x} breaks off")
            continue
        value = lambda a=at, b=stop: _fits(int.from_bytes(data[a:b] if b - a <= 8 else b"\xff" * 9, "big"))
        if i == SIMPLE_BLOCK:
            _block(data, at, stop, state["base"], state["start"] - state["segment"], True, media, False)
        elif i == BLOCK:
            state["group"] = (at, stop)
        elif i == REFERENCE:
            state["referenced"] = True
        elif i == TIMESTAMP:
            state["base"] = value()
        elif i == SCALE:
            media.scale = value()
        elif i == DOC_TYPE:
            media.doc_type = bytes(data[at:stop]).decode("ascii", "replace").rstrip("\0")
        elif parent in (TRACK, AUDIO) and media.tracks:
            t = media.tracks[-1]
            if i in (TRACK_NUMBER, TRACK_TYPE, DEFAULT_DURATION, CHANNELS, BIT_DEPTH):
                t[{TRACK_NUMBER: "number", TRACK_TYPE: "type", DEFAULT_DURATION: "duration", CHANNELS: "channels", BIT_DEPTH: "bits"}[i]] = value()
            elif i == CODEC:
                t["codec"] = bytes(data[at:stop]).decode("ascii", "replace")
            elif i == SAMPLING:
                t["rate"] = struct.unpack(">d" if stop - at == 8 else ">f", data[at:stop])[0]
        elif i == CUE_TIME:
            state["time"] = value()
        elif i == CUE_TRACK:
            state["track"] = value()
        elif i == CUE_CLUSTER:
            state["cluster"] = value()
        at = stop
    return at


# tables

def payload_of(text: str | None) -> tuple[int, bytes]:
    """Bytes of a text and the payload: UTF-8 with zeros up to a positive multiple of the unit."""
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b"\0")


def mux(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """A Matroska file per text: id, ``n_bytes``, ``media``."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        for batch in pieces(batches, text_column):
            got = [payload_of(t) for t in batch.column(text_column).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_column), pa.array([n for n, _ in got], pa.int64()), pa.array([write(p) for _, p in got], pa.binary())],
                                             names=[id_column, "n_bytes", "media"])

    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, n_bytes long, media binary")


def packets(media: DataFrame, id_column: str, media_column: str) -> DataFrame:
    """The packet table: one row per frame with its track, codec, time and byte range; a row with an error where a file breaks."""
    kind = media.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, packet long, track long, codec string, timestamp_ns long, start long, length long, keyframe boolean, cluster long, error string"

    def run(batches):
        for batch in pieces(batches, media_column):
            types = [batch.schema.field(id_column).type, *[pa.int64()] * 2, pa.string(), *[pa.int64()] * 3, pa.bool_(), pa.int64(), pa.string()]
            rows = []
            for key, data in zip(batch.column(id_column).to_pylist(), batch.column(media_column).to_pylist()):
                if data is None:
                    continue
                m = read(data)
                codec = {t.get("number"): t.get("codec") for t in m.tracks}
                rows += [(key, i, p[0], codec.get(p[0]), *p[1:], None) for i, p in enumerate(m.packets)]
                if m.error:
                    rows.append((key, *[None] * 8, m.error))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[
                    id_column, "packet", "track", "codec", "timestamp_ns", "start", "length", "keyframe", "cluster", "error"])

    return media.select(id_column, media_column).mapInArrow(run, schema)


def samples(data: bytes, media: Media) -> bytes:
    """The samples of the first track, put together from the packets' byte ranges."""
    first = media.tracks[0].get("number") if media.tracks else None
    return b"".join(data[s:s + n] for t, _, s, n, _, _ in media.packets if t == first)


def feature(payload: bytes, media: Media) -> str:
    """Packets, clusters and duration, then mean, deviation, turns and a 16-step energy envelope of the samples."""
    x = np.frombuffer(payload, np.uint8)
    ms = (media.packets[-1][1] // 1_000_000 + media.packets[-1][3] * 1000 // RATE) if media.packets else 0
    steps = np.linspace(0, len(x), 17).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    envelope = (total[steps[1:]] - total[steps[:-1]]) // np.maximum(1, np.diff(steps))
    turns = int(np.count_nonzero(np.diff((x > 100).view(np.int8))))
    mean = int(total[-1]) / max(1, len(x))
    square = int((x.astype(np.int64) ** 2).sum()) / max(1, len(x))
    return f"p{len(media.packets)} c{len(media.cues)} ms{ms} m{mean:.3f} d{max(0.0, square - mean * mean) ** 0.5:.3f} t{turns} e" + bytes(envelope.astype(np.uint8)).hex()


def digest(media: DataFrame, id_column: str) -> DataFrame:
    """Parse the files of :func:`mux` and describe the payload read back."""
    kind = media.schema[id_column].dataType.simpleString()
    names = [id_column, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for batch in pieces(batches, "media"):
            rows = []
            for data in batch.column("media").to_pylist():
                m = read(data)
                if m.error:
                    raise ValueError(f"a stored file can't be read: {m.error}")
                p = samples(data, m)
                rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature(p, m)))
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(id_column), batch.column("n_bytes"), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names=names)

    return media.select(id_column, "n_bytes", "media").mapInArrow(
        run, f"`{id_column}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def stored_media(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Write a table's media to the shared work folder, read it back and describe each."""
    return digest(stored(mux(docs, id_column, text_column), "matroska"), id_column)
