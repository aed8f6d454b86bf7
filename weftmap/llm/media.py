"""Media columns: Matroska files in binary columns, parsed into packet tables.

The reader walks the EBML tree: variable-length ids and sizes, unknown sizes, voids and
checksums, cluster timestamps, simple blocks and block groups with no, Xiph, fixed-size or
EBML lacing, and the cues. It gives a row for each packet: track, timestamp (in ticks of
the file, and nanoseconds), byte range in the file, key flag, lacing, cluster. The writer
puts 8-bit samples into blocks of up to 8 frames of 576 bytes with all kinds of lacing,
clusters of 256 frames with cues for each, one audio track.

Defined cases: null text is empty; every payload has at least one frame; equal texts give
equal files; null media and media that isn't EBML have no packets, null media null digests;
of a file cut anywhere what is whole is read: elements that hold others are read as far as
they go, blocks and numbers that are cut are left out, as are blocks whose lacing doesn't
fill them and numbers beyond 64 bits; repeated rows give repeated rows; an empty table
gives no rows; columns other than those named are ignored. A file is worked on in one
task, a few documents at a time, so a very long text needs some times its size in memory.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: Element ids of the public format (fixed values).
EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE1
CLUSTER, CLUSTER_TIME, SIMPLE_BLOCK, GROUP, BLOCK, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
SCALE, DURATION, NUMBER, UID, KIND, CODEC, DEFAULT_DURATION = 0x2AD7B1, 0x4489, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
RATE, CHANNELS, DEPTH = 0xB5, 0x9F, 0x6264
VERSION, READ_VERSION, MAX_ID, MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3
LACINGS = ("none", "xiph", "fixed", "ebml")

#: Elements that hold others and are read as far as they go.
MASTERS = frozenset({SEGMENT, INFO, TRACKS, TRACK, CLUSTER, CUES, CUE, CUE_POSITIONS})
#: The largest number of a column.
MOST = 2**63 - 1

FRAME = 576
FRAME_TICKS = 72  # milliseconds of 576 samples at 8000 a second
BLOCK_FRAMES = 8
CLUSTER_FRAMES = 256


def id_bytes(element: int) -> bytes:
    return element.to_bytes((element.bit_length() + 7) // 8, "big")


def size_bytes(n: int) -> bytes:
    """The shortest variable-length number; all ones are kept for unknown sizes."""
    width = next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(kind: int, body: bytes | int | str) -> bytes:
    if isinstance(body, int):
        body = body.to_bytes(max(1, (body.bit_length() + 7) // 8), "big")
    elif isinstance(body, str):
        body = body.encode()
    return id_bytes(kind) + size_bytes(len(body)) + body


def signed_size(n: int) -> bytes:
    """A size difference of EBML lacing: a variable-length number with a bias."""
    width = next(w for w in range(1, 9) if abs(n) < (1 << 7 * w - 1) - 1)
    return (n + (1 << 7 * width - 1) - 1 | 1 << 7 * width).to_bytes(width, "big")


def block_body(track: int, relative: int, frames: list[bytes], lacing: int, key: bool = True) -> bytes:
    flags = (0x80 if key else 0) | lacing << 1
    head = size_bytes(track) + struct.pack(">hB", relative, flags)
    if lacing == NO_LACING:
        return head + frames[0]
    head += bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if lacing == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == EBML_LACING:
        head += size_bytes(sizes[0]) + b"".join(signed_size(b - a) for a, b in zip(sizes[:-2], sizes[1:-1]))
    return head + b"".join(frames)


def padded(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, payload): UTF-8, filled with 255 to a positive multiple of a frame."""
    data = (text or "").encode("utf-8")
    return len(data), data + b"\xff" * (-len(data) % FRAME if data else FRAME)


def write_matroska(payload: bytes) -> bytes:
    """A file with one track of 8-bit samples; payload is a multiple of a frame long."""
    frames = [payload[k : k + FRAME] for k in range(0, len(payload), FRAME)]
    header = element(EBML, element(VERSION, 1) + element(READ_VERSION, 1) + element(MAX_ID, 4) + element(MAX_SIZE, 8) + element(DOC_TYPE, "matroska") + element(DOC_VERSION, 4) + element(DOC_READ, 2))
    info = element(INFO, element(SCALE, 1_000_000) + element(DURATION, struct.pack(">d", float(len(frames) * FRAME_TICKS))))
    audio = element(AUDIO, element(RATE, struct.pack(">d", 8000.0)) + element(CHANNELS, 1) + element(DEPTH, 8))
    track = element(TRACKS, element(TRACK, element(NUMBER, 1) + element(UID, 1) + element(KIND, 2) + element(CODEC, "A_PCM/INT/LIT") + element(DEFAULT_DURATION, FRAME_TICKS * 1_000_000) + audio))
    parts, at, cues = [info, track], len(info) + len(track), []
    for first in range(0, len(frames), CLUSTER_FRAMES):
        inside = frames[first : first + CLUSTER_FRAMES]
        body = [element(CLUSTER_TIME, first * FRAME_TICKS)]
        for k in range(0, len(inside), BLOCK_FRAMES):
            some = inside[k : k + BLOCK_FRAMES]
            lacing = NO_LACING if len(some) == 1 else (FIXED, XIPH, EBML_LACING)[k // BLOCK_FRAMES % 3]
            body.append(element(SIMPLE_BLOCK, block_body(1, k * FRAME_TICKS, some, lacing)))
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(CUE, element(CUE_TIME, first * FRAME_TICKS) + element(CUE_POSITIONS, element(CUE_TRACK, 1) + element(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    return header + element(SEGMENT, b"".join([*parts, element(CUES, b"".join(cues))]))


@dataclass
class Media:
    """What a file holds: packets (track, ticks, offset, size, key, lacing, cluster offset) and cues (ticks, track, offset)."""

    scale: int = 1_000_000
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple[int, int, int, int, bool, int, int]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)


def read_number(data: bytes, at: int, keep_marker: bool, end: int) -> tuple[int, int, bool]:
    """A variable-length number before end: (value, place after it, whether all its bits are ones)."""
    first = data[at] if at < end else 0
    if not first:
        raise ValueError("no number of 8 bytes or less")
    width = 9 - first.bit_length()
    if at + width > end:
        raise ValueError("a number ends beyond its element")
    raw = int.from_bytes(data[at : at + width], "big")
    value = raw & (1 << 7 * width) - 1
    return (raw if keep_marker else value), at + width, value == (1 << 7 * width) - 1


def elements(data: bytes, at: int, end: int, ends_before: frozenset[int] = frozenset()) -> Iterator[tuple[int, int, int]]:
    """(id, begin, end) of the elements of a stretch; it ends before one of ends_before.

    An element that ends beyond the stretch is cut if it holds others, else left out. Only
    segments and clusters may be of unknown size.
    """
    while at < end:
        try:
            kind, body, _ = read_number(data, at, True, end)
            size, body, unknown = read_number(data, body, False, end)
        except ValueError:
            return
        if kind in ends_before or (unknown and kind not in (SEGMENT, CLUSTER)) or (not unknown and body + size > end and kind not in MASTERS):
            return
        if unknown:
            # lasts until an element that can't stand inside it
            outer = frozenset({CLUSTER, CUES, INFO, TRACKS, SEGMENT, EBML}) if kind == CLUSTER else frozenset({SEGMENT, EBML})
            stop = body
            for _, _, stop in elements(data, body, end, outer):
                pass
        else:
            stop = min(body + size, end)
        yield kind, body, stop
        at = stop


def lacing_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """(sizes, where the frames begin) of a block's frames; ValueError unless they fill it exactly."""
    if lacing == NO_LACING:
        return [end - at], at
    if at >= end:
        raise ValueError("a block without its number of frames")
    n, at = data[at] + 1, at + 1
    if lacing == FIXED:
        if (end - at) % n:
            raise ValueError("frames of one size don't fill their block")
        return [(end - at) // n] * n, at
    sizes: list[int] = []
    for k in range(n - 1):
        if lacing == XIPH:
            stop = next((x for x in range(at, end) if data[x] != 255), end)
            if stop == end:
                raise ValueError("a size ends beyond its block")
            size, at = 255 * (stop - at) + data[stop], stop + 1
        else:
            value, after, _ = read_number(data, at, False, end)
            size = value if k == 0 else sizes[-1] + value - ((1 << 7 * (after - at) - 1) - 1)
            at = after
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("frames reach beyond their block")
    return sizes, at


def read_block(data: bytes, at: int, end: int, cluster_time: int, cluster: int, key: bool | None, media: Media) -> None:
    """Add a block's packets to media; a block that doesn't hold what its head says is left out."""
    try:
        track, at, _ = read_number(data, at, False, end)
        if at + 3 > end:
            return
        relative, flags = struct.unpack_from(">hB", data, at)
        lacing = flags >> 1 & 3
        sizes, at = lacing_sizes(data, at + 3, end, lacing)
    except ValueError:
        return
    step = media.tracks.get(track, {}).get("default_duration", 0) // media.scale
    time = cluster_time + relative
    key = bool(flags & 0x80) if key is None else key
    for size in sizes:
        media.packets.append((track, time, at, size, key, lacing, cluster))
        at += size
        time += step


def read_matroska(data: bytes | None) -> Media:
    media = Media()
    # numbers beyond a signed 64-bit one count as missing
    number = lambda a, b, missing=0: value if b - a <= 8 and (value := int.from_bytes(data[a:b], "big")) <= MOST else missing
    if not data or data[:4] != id_bytes(EBML):
        return media
    for top, a, b in elements(data, 0, len(data)):
        if top != SEGMENT:
            continue
        for kind, x, y in elements(data, a, b):
            if kind == INFO:
                media.scale = next((number(p, q) for k, p, q in elements(data, x, y) if k == SCALE), 0) or media.scale
            elif kind == TRACKS:
                for _, p, q in (e for e in elements(data, x, y) if e[0] == TRACK):
                    found = {k: (r, s) for k, r, s in elements(data, p, q)}
                    if NUMBER in found:
                        media.tracks[number(*found[NUMBER])] = {"codec": data[slice(*found[CODEC])].decode("ascii", "replace") if CODEC in found else None, "default_duration": number(*found[DEFAULT_DURATION]) if DEFAULT_DURATION in found else 0}
            elif kind == CLUSTER:
                time = 0
                for k, p, q in elements(data, x, y):
                    if k == CLUSTER_TIME:
                        time = number(p, q)
                    elif k == SIMPLE_BLOCK:
                        read_block(data, p, q, time, x - a, None, media)
                    elif k == GROUP:
                        inside = {g: (r, s) for g, r, s in elements(data, p, q)}
                        if BLOCK in inside:
                            read_block(data, *inside[BLOCK], time, x - a, REFERENCE not in inside, media)
            elif kind == CUES:
                for _, p, q in (e for e in elements(data, x, y) if e[0] == CUE):
                    ticks = next((number(r, s) for k, r, s in elements(data, p, q) if k == CUE_TIME), 0)
                    for _, r, s in (e for e in elements(data, p, q) if e[0] == CUE_POSITIONS):
                        where = {k: number(u, v) for k, u, v in elements(data, r, s)}
                        media.cues.append((ticks, where.get(CUE_TRACK, 0), a + where.get(CUE_CLUSTER, 0)))
    return media


def packet_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(doc_id, packet, track, ticks, nanoseconds, offset, size, key, lacing, cluster, cue_offset): a row for each packet.

    cue_offset: where the last cue at or before the packet points to; null without cues.
    """
    ship(media.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, data in zip(*batch.columns):
                found = read_matroska(data.as_py())
                if not found.packets:
                    continue
                track, ticks, offset, size, key, lacing, cluster = map(list, zip(*found.packets))
                in_range = lambda xs: [v if -MOST <= v <= MOST else None for v in xs]
                cues = sorted(found.cues)
                times = [c[0] for c in cues]
                index = [bisect_right(times, t) - 1 for t in ticks]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([doc_id.as_py()] * len(track), pa.int64()), pa.array(range(len(track)), pa.int64()), pa.array(track, pa.int64()), pa.array(in_range(ticks), pa.int64()),
                        pa.array(in_range([t * found.scale for t in ticks]), pa.int64()), pa.array(offset, pa.int64()), pa.array(size, pa.int64()), pa.array(key, pa.bool_()),
                        pa.array([LACINGS[x] for x in lacing], pa.string()), pa.array(cluster, pa.int64()), pa.array(in_range([cues[i][2] if i >= 0 else MOST + 1 for i in index]), pa.int64()),
                    ],
                    ["doc_id", "packet", "track", "ticks", "nanoseconds", "offset", "size", "key", "lacing", "cluster", "cue_offset"],
                )

    chosen = media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media"))
    return chosen.mapInArrow(of, "doc_id long, packet long, track long, ticks long, nanoseconds long, offset long, size long, key boolean, lacing string, cluster long, cue_offset long")


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): texts stored as the samples of Matroska files."""
    ship(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                made = [padded(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([write_matroska(p) for _, p in made], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(of, "doc_id long, n_bytes long, media binary")


def feature(found: Media, payload: bytes) -> str:
    """Packets, clusters, cues and length of a file, and mean, deviation and mean step of its samples."""
    samples = np.frombuffer(payload or b"\0", np.uint8).astype(np.int16)
    ticks = found.packets[-1][1] + FRAME_TICKS if found.packets else 0
    step = np.abs(np.diff(samples)).mean() if len(samples) > 1 else 0.0
    return f"packets={len(found.packets)};clusters={len({p[6] for p in found.packets})};cues={len(found.cues)};ms={ticks};mean={samples.mean():.4f};std={samples.std():.4f};step={step:.4f}"


def media_digests(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", size_col: str = "n_bytes") -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), all read from the files."""
    ship(media.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, n_bytes, data in zip(*batch.columns):
                stored = data.as_py()
                if stored is None:
                    rows.append((doc_id.as_py(), n_bytes.as_py(), 0, None, None, None, None, None))
                    continue
                found = read_matroska(stored)
                payload = b"".join([stored[p[2] : p[2] + p[3]] for p in found.packets])
                rows.append((doc_id.as_py(), n_bytes.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(found, payload)))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    chosen = media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(size_col).alias("n_bytes"), F.col(media_col).alias("media"))
    return chosen.mapInArrow(of, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
