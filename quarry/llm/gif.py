"""GIF columns: byte payloads as timed 8-bit frames, and frames back from code streams.

``encode`` is a real LZW encoder (code widths 9 to 12, a clear code when the table is
full). ``decode`` reads any GIF87a/89a: global and local palettes, sub-blocks, interlacing,
graphic control (delay, disposal, transparency), and composes each frame on the canvas.
Between two clear codes the width of the j-th code depends on j alone, so codes are read
from the bit stream as arrays; only the string table is a loop. Where a clear code is
deferred, the table stays full and 12-bit codes are read on, array by array.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, slices, text_bytes

WIDTH, ROWS, UNIT, DELAY, MOST_PIXELS = 192, 64, 192, 10, 1 << 27
FRAME = "index int, delay_ms int, left int, top int, width int, height int, disposal int, transparent int, pixels binary, histogram array<long>"
_SINGLE = [bytes([i]) for i in range(256)]


def _schedule(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths of the codes after a clear code, and their bit offsets."""
    free = (1 << bits) + 2 + np.maximum(np.arange(1 << 14) - 1, 0)
    width = bits + 1 + np.searchsorted([1 << w for w in range(bits + 1, 12)], free, side="right")
    return width, np.concatenate([[0], np.cumsum(width)])


_SCHEDULES = {bits: _schedule(bits) for bits in range(2, 9)}
_LATE = np.full(1 << 14, 12), 12 * np.arange((1 << 14) + 1)  # once the table is full
_GREY = bytes(v for i in range(256) for v in (i, i, i))


def lzw_encode(data: bytes) -> bytes:
    """The code stream of 8-bit samples."""
    width, _ = _SCHEDULES[8]
    codes: list[int] = [256 << 8]  # codes stand eight bits up, so that a sample is added without a shift
    marks = [0]  # where codes follow a clear code
    emit, table = codes.append, {}
    find, free, full = table.get, 258 << 8, 4096 << 8
    if data:
        at = data[0] << 8
        for c in memoryview(data)[1:]:
            key = at + c
            longer = find(key)
            if longer:
                at = longer
                continue
            emit(at)
            at = c << 8
            if free < full:
                table[key] = free
                free += 256
            else:
                emit(256 << 8)
                marks.append(len(codes) - 1)
                table.clear()
                free = 258 << 8
        emit(at)
    emit(257 << 8)
    marks = np.array([*marks, len(codes)])
    nth = np.arange(len(codes)) - np.repeat(marks[:-1], np.diff(marks)) - 1  # a clear code ends the run before it
    nth[marks[1:-1]] = np.diff(marks)[:-1] - 1
    nth[0] = 0
    size = width[nth]
    end = np.cumsum(size)
    place = end - size
    bits = (np.array(codes, np.int64) >> 8) << (place & 7)
    place >>= 3
    out = np.zeros((int(end[-1]) + 7 >> 3) + 2)
    for i in range(3):  # the bits of different codes never meet, so sums are unions
        out += np.bincount(place + i, weights=bits >> 8 * i & 255, minlength=len(out))
    return out[:-2].astype(np.uint8).tobytes()


def _codes(stream: np.ndarray, at: int, schedule: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """All codes that could follow a bit offset, up to the table of widths."""
    width, offset = schedule
    count = int(np.searchsorted(offset, len(stream) * 8 - 32 - at, side="right")) - 1  # 32 bits of padding
    if count <= 0:
        return np.empty(0, np.int64)
    place = at + offset[:count]
    byte = place >> 3
    word = stream[byte].astype(np.uint32) | stream[byte + 1].astype(np.uint32) << 8 | stream[byte + 2].astype(np.uint32) << 16
    return ((word >> (place & 7).astype(np.uint32)) & ((1 << width[:count]) - 1).astype(np.uint32)).astype(np.int64)


def _expand(codes: np.ndarray, clear: int, most: int) -> tuple[bytes, bool]:
    """Samples of a run of codes between clear codes, at most ``most``, and whether a code was out of range before them.

    The string that the j-th code adds to the table is what the stream says from the start
    of code j up to the first sample of code j + 1. So every code is a sample or a copy of
    earlier output, and all copies resolve together.
    """
    n = len(codes)
    entry = codes - (clear + 2)
    ok = (codes < clear) | ((entry >= 0) & (entry < np.minimum(np.arange(n), 4096 - clear - 2)))
    broken = not ok.all()
    if broken:
        n = int(ok.argmin())
        codes, entry = codes[:n], entry[:n]
    if not n:
        return b"", broken
    copies = entry >= 0
    # A code is one sample longer than the code whose table entry it names.
    own = np.arange(n)
    length, link = copies.astype(np.int64), np.where(copies, entry, own)
    moving = np.flatnonzero(copies)
    while len(moving):
        towards = link[moving]
        length[moving] += length[towards]
        link[moving] = link[towards]
        moving = moving[length[link[moving]] > 0]
    length += 1
    end = np.cumsum(length)
    if end[-1] > most:
        n = int(np.searchsorted(end, most)) + 1
        entry, copies, length, end, codes = entry[:n], copies[:n], length[:n], end[:n], codes[:n]
        broken = False
    start = end - length
    entry[~copies] = own[:n][~copies]
    link = np.arange(int(end[-1]))
    link -= np.repeat(start - start[entry], length)
    other = np.empty_like(link)
    for _ in range(int(2 * length.max()).bit_length()):  # a sample's way goes down its code, and once over to the first sample of the next
        np.take(link, link, out=other, mode="clip")
        link, other = other, link
    samples = np.zeros(len(link), np.uint8)
    samples[start[~copies]] = codes[~copies]
    return np.take(samples, link, mode="clip")[:most].tobytes(), broken


def lzw_decode(stream: bytes, bits: int, most: int) -> bytes:
    """The first ``most`` samples of a code stream; ValueError if it ends or breaks off before."""
    clear, end = 1 << bits, (1 << bits) + 1
    padded = np.frombuffer(stream + bytes(4), np.uint8)
    out, size, at, schedule, run, over = [], 0, 0, _SCHEDULES[bits], [], False
    while size < most and not over:
        codes = _codes(padded, at, schedule)
        stop = np.flatnonzero((codes == clear) | (codes == end))
        n = int(stop[0]) if len(stop) else len(codes)
        run.append(codes[:n])
        if n and not len(stop):  # a clear code is deferred
            at, schedule = at + int(schedule[1][n]), _LATE
            continue
        over = not len(stop) or codes[n] == end
        samples, broken = _expand(np.concatenate(run), clear, most - size)
        out.append(samples)
        size += len(samples)
        if broken and size < most:
            raise ValueError("a code is out of range")
        if not over:
            at, schedule, run = at + int(schedule[1][n + 1]), _SCHEDULES[bits], []
    if size < most:
        raise ValueError("the code stream ends early")
    return b"".join(out)


def encode(payload: bytes, *, width: int = WIDTH, rows: int = ROWS, delay: int = DELAY) -> bytes:
    """A GIF whose frames hold ``payload``, a multiple of ``width`` bytes, as palette indices (grey levels)."""
    height = len(payload) // width
    parts = [b"GIF89a", struct.pack("<HHBBB", width, min(rows, height), 0xF7, 0, 0), _GREY]
    for top in range(0, height, rows):
        pixels = payload[top * width : (top + rows) * width]
        stream = lzw_encode(pixels)
        parts += [b"\x21\xf9\x04\x04", struct.pack("<HBB", delay, 0, 0), b"\x2c", struct.pack("<HHHHB", 0, 0, width, len(pixels) // width, 0), b"\x08"]
        for i in range(0, len(stream), 255):
            block = stream[i : i + 255]
            parts += [_SINGLE[len(block)], block]
        parts.append(b"\0")
    return b"".join([*parts, b"\x3b"])


class _Reader:
    def __init__(self, media: bytes):
        self.media, self.at = media, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.media):
            raise ValueError("the file ends early")
        self.at += n
        return self.media[self.at - n : self.at]

    def blocks(self) -> bytes:
        parts = []
        while n := self.take(1)[0]:
            parts.append(self.take(n))
        return b"".join(parts)

    def palette(self, flags: int) -> np.ndarray | None:
        return np.frombuffer(self.take(3 << (flags & 7) + 1), np.uint8).reshape(-1, 3) if flags & 0x80 else None


def _rows_in_order(height: int) -> np.ndarray:
    return np.concatenate([np.arange(a, height, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])


def _bins(colours: np.ndarray) -> np.ndarray:
    """Histogram bins of colours: two bits of each channel."""
    top = colours.reshape(-1, 3) >> 6
    return top[:, 0].astype(np.int64) << 4 | top[:, 1] << 2 | top[:, 2]


def frames(media: bytes, canvases: bool = False, most_pixels: float | None = None):
    """Yield frames as dicts, with the composed RGB canvas where ``canvases`` asks; ValueError on a bad file.

    The canvas, and all frames together, may hold ``most_pixels`` pixels (``MOST_PIXELS``
    unless given); a header that claims more is a fault, reported before anything is
    allocated. Files of one's own making are as large as their texts and need no bound.
    """
    most_pixels = MOST_PIXELS if most_pixels is None else most_pixels
    read = _Reader(media)
    if read.take(6) not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack("<HHBBB", read.take(7))
    if width * height > most_pixels:
        raise ValueError("the canvas is too large")
    shared = read.palette(flags)
    canvas = np.zeros((height, width, 3), np.uint8)
    covering = None  # indices and colours of a frame that hides the canvas, painted once a later frame shows some of it
    delay = disposal = 0
    transparent, index, held = -1, 0, 0
    while (kind := read.take(1)) != b"\x3b":
        if kind == b"\x21":
            label, data = read.take(1), read.blocks()
            if label == b"\xf9" and len(data) >= 4:
                disposal, delay = data[0] >> 2 & 7, struct.unpack("<H", data[1:3])[0]
                transparent = data[3] if data[0] & 1 else -1
            continue
        if kind != b"\x2c":
            raise ValueError("unknown block")
        left, top, w, h, flags = struct.unpack("<HHHHB", read.take(9))
        held += w * h
        if held > most_pixels:
            raise ValueError("the frames are too large")
        palette = read.palette(flags)
        palette = shared if palette is None else palette
        bits = read.take(1)[0]
        if not 2 <= bits <= 8 or palette is None:
            raise ValueError("no usable palette or code size")
        pixels = lzw_decode(read.blocks(), bits, w * h)
        image = np.frombuffer(pixels, np.uint8).reshape(h, w)
        if flags & 0x40:
            image = image[np.argsort(_rows_in_order(h))]
        image = image[: max(0, height - top), : max(0, width - left)]
        colours = np.vstack([palette, np.repeat(palette[-1:], 256 - len(palette), 0)])  # beyond the palette: its last colour
        hidden = image.shape == (height, width) and transparent < 0 and not canvases
        if hidden:
            histogram = np.bincount(_bins(colours), weights=np.bincount(image.ravel(), minlength=256), minlength=64).astype(np.int64)
        else:
            if covering is not None:
                canvas[:], covering = covering[1][covering[0]], None
            spot = (slice(top, top + image.shape[0]), slice(left, left + image.shape[1]))
            before = canvas[spot].copy() if disposal == 3 else None
            canvas[spot] = np.where((image == transparent)[..., None], canvas[spot], colours[image]) if transparent >= 0 else colours[image]
            histogram = np.bincount(_bins(canvas), minlength=64)
        frame = {
            "index": index, "delay_ms": 10 * delay, "left": left, "top": top, "width": w, "height": h,
            "disposal": disposal, "transparent": transparent, "pixels": pixels, "histogram": histogram.tolist(),
        }
        yield frame | ({"canvas": canvas.copy()} if canvases else {})
        if hidden:
            if disposal == 2:
                canvas[:], covering = 0, None
            elif disposal != 3:
                covering = image, colours
        elif disposal == 2:
            canvas[spot] = 0
        elif disposal == 3:
            canvas[spot] = before
        delay = disposal = 0
        transparent, index = -1, index + 1


def payload_of(raw: bytes, unit: int = UNIT) -> bytes:
    """Padded with blanks to a positive multiple of ``unit`` bytes."""
    return raw.ljust(max(unit, -(-len(raw) // unit) * unit), b" ")


def with_media(docs: DataFrame, *, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """``docs`` with each text's UTF-8 bytes (null: none), padded, stored as a GIF in ``media_col``."""
    bound_batches(docs.sparkSession)
    def run(batches):
        for batch in slices(batches):
            media = pa.array([encode(payload_of(raw)) for raw in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], media, *batch.columns[at + 1 :]], batch.schema.names)

    packed = docs.withColumn(media_col, text_bytes(text_col))
    at = packed.columns.index(media_col)
    return packed.mapInArrow(run, packed.schema)


def with_frames(df: DataFrame, *, media_col: str = "media", frames_col: str = "frames", error_col: str = "media_error") -> DataFrame:
    """``df`` with the decoded frames of a GIF column and, for a broken file, why reading stopped.

    Null media have null frames; a broken file keeps the frames before the fault.
    """
    bound_batches(df.sparkSession)
    at = df.columns.index(media_col)
    kind_name = "array<struct<" + ",".join(x.replace(" ", ":") for x in FRAME.split(", ")) + ">>"
    schema = df.withColumn(frames_col, F.lit(None).cast(kind_name)).withColumn(error_col, F.lit(None).cast("string")).schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(schema[frames_col].dataType)
        for batch in slices(batches):
            found, errors = [], []
            for media in batch.column(at).to_pylist():
                some, error = None if media is None else [], None
                try:
                    for frame in frames(media) if media is not None else ():
                        some.append(frame)
                except ValueError as fault:
                    error = str(fault)
                found.append(some)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind), pa.array(errors, pa.string())], schema.names)

    return df.mapInArrow(run, schema)


def _digest(batches):
    for batch in slices(batches):
        out = {name: [] for name in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "histogram")}
        for media in batch.column("media").to_pylist():
            found = list(frames(media, most_pixels=math.inf))
            payload = b"".join(f["pixels"] for f in found)
            histogram = np.sum([f["histogram"] for f in found], axis=0)
            row = (
                len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(),
                f"frames={len(found)};ms={sum(f['delay_ms'] for f in found)};size={found[0]['width']}x{found[0]['height']};colours=" + ",".join(f"{i}:{n}" for i, n in enumerate(histogram.tolist()) if n),
                len(found), histogram.tolist(),
            )
            for column, value in zip(out.values(), row):
                column.append(value)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes")} | {k: pa.array(v) if v else pa.array(v, pa.null()) for k, v in out.items()})


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns, read back from the stored media, with frame count and colour histogram."""
    media = with_media(docs.select("doc_id", F.octet_length(text_bytes("text")).cast("long").alias("n_bytes"), "text")).drop("text")
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, histogram array<long>"
    return media.mapInArrow(_digest, schema)
