"""GIF as a column: frames with their pixels, times and colour histograms, and a lossless store for bytes.

The reader handles everything a GIF89a file may hold: global and local palettes, interlacing, transparency, the
four disposal rules, delays, several frames on one canvas, comments and application blocks.  LZW codes are read
in two steps.  Between two clear codes the width of every code is known from its place alone, so numpy takes the
codes off the bit stream at once; and a code's text is always a run of the output already written (the run of an
earlier code and one byte more), so each code is one slice copy.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import bounded
from .common import map_rows

#: Payload bytes of a row of pixels, and rows of a frame: longer payloads become more frames.
WIDTH, FRAME_ROWS = 64, 16_384
#: Hundredths of a second between the frames of a stored payload.
DELAY = 10
#: Classes of each colour channel's histogram.
BINS = 4

_LIMIT = 4096


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """LZW code stream of samples below ``2 ** bits``; a clear code whenever the table is full."""
    clear, first = 1 << bits, (1 << bits) + 2
    codes, at_clear = [clear], [0]
    if data:
        table: dict[int, int] = {}
        get, put, entry = table.get, codes.append, first
        samples = iter(data)
        current = next(samples)
        for sample in samples:
            pair = current << 8 | sample
            longer = get(pair)
            if longer is not None:
                current = longer
                continue
            put(current)
            if entry < _LIMIT:
                table[pair] = entry
                entry += 1
            else:
                at_clear.append(len(codes))
                put(clear)
                table.clear()
                entry = first
            current = sample
        put(current)
    codes.append(clear + 1)
    return _pack_codes(np.array(codes, np.int64), np.array(at_clear), bits)


def _widths(count: int, bits: int) -> np.ndarray:
    """Bits of the codes behind a clear code, by place: from the second code on, each code that is read adds an entry."""
    entries = (1 << bits) + 2 + np.maximum(np.arange(count) - 1, 0)
    return np.clip(np.floor(np.log2(entries)).astype(np.int64) + 1, bits + 1, 12)


def _pack_codes(codes: np.ndarray, at_clear: np.ndarray, bits: int) -> bytes:
    """Codes as a little-endian bit stream.  A clear code has the width in force before it."""
    widths = np.empty(len(codes), np.int64)
    widths[0] = bits + 1
    stops = np.append(at_clear[1:], len(codes) - 1)
    for start, stop in zip(at_clear, stops, strict=True):
        run = _widths(stop - start, bits)  # the codes behind this clear code, up to the next one and with it
        widths[start + 1:stop + 1] = run
    begins = np.append(0, np.cumsum(widths))
    size = -(-int(begins[-1]) // 8)
    place, shifted = begins[:-1] >> 3, codes << (begins[:-1] & 7)
    # a code touches at most three bytes; no two codes share a bit, so sums are unions
    parts = [np.bincount(place + k, shifted >> 8 * k & 255, size + 2) for k in range(3)]
    return (parts[0] + parts[1] + parts[2])[:size].astype(np.uint8).tobytes()


def _codes(stream: bytes, bits: int) -> Iterator[np.ndarray]:
    """The codes between two clear codes, run by run, up to the end code."""
    clear = 1 << bits
    raw = np.frombuffer(stream + b"\0\0\0\0", np.uint8).astype(np.int64)
    words = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16
    at, size, ended = 0, len(stream) * 8, False
    block = _LIMIT - clear  # a full table's codes; a writer may go on at 12 bits without a clear code
    width = _widths(block, bits)
    begin = np.append(0, np.cumsum(width))
    while not ended and at < size:
        parts, place = [], 0
        while True:
            if place == 0:
                w, b = width, begin
            else:
                w, b = np.full(block, 12), np.arange(block + 1) * 12
            fits = int(np.searchsorted(b, size - at, "right")) - 1
            if fits <= 0:
                ended = True
                break
            bit = at + b[:fits]
            found = words[bit >> 3] >> (bit & 7) & (1 << w[:fits]) - 1
            stop = np.flatnonzero((found == clear) | (found == clear + 1))
            if len(stop):
                parts.append(found[:stop[0]])
                ended = found[stop[0]] == clear + 1
                at += int(b[stop[0] + 1])
                break
            parts.append(found)
            at += int(b[fits])
            place += fits
        yield np.concatenate(parts) if parts else np.zeros(0, np.int64)


def lzw_decode(stream: bytes, bits: int, size: int) -> bytes:
    """The first ``size`` samples of a code stream; a broken or short stream gives what it holds."""
    out, first, here = bytearray(), (1 << bits) + 2, 0
    try:
        for run in _codes(stream, bits):
            starts: list[int] = []  # where the output of each code of this run begins
            begin, literal = starts.append, out.append
            for code in run.tolist():
                begin(here)
                if code < first:
                    literal(code)
                    here += 1
                else:
                    start, stop = starts[code - first], starts[code - first + 1]
                    out += out[start:stop + 1]
                    if stop == here:  # the entry that this very code completes
                        literal(out[start])
                    here += stop + 1 - start
            if here >= size:
                break
    except IndexError:  # a code without an entry: the stream is broken here
        pass
    return bytes(out[:size])


@dataclass
class Frame:
    number: int
    delay_ms: int
    at_ms: int
    pixels: np.ndarray  # the canvas once the frame is drawn: height, width, RGBA


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while at < len(data) and data[at]:
        parts.append(data[at + 1:at + 1 + data[at]])
        at += data[at] + 1
    return b"".join(parts), at + 1


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    """256 opaque colours, four bytes in one number each."""
    if not flags & 0x80:
        return None, at
    n = 2 << (flags & 7)
    colours = np.zeros((256, 4), np.uint8)
    colours[:, 3] = 255
    colours[:n, :3] = np.frombuffer(data[at:at + 3 * n].ljust(3 * n, b"\0"), np.uint8).reshape(n, 3)
    return colours.view(np.uint32).ravel(), at + 3 * n


#: Canvases and frames of more pixels are refused: a header of a few bytes can ask for 17 GB.
MOST_PIXELS = 1 << 26


def read_frames(data: bytes) -> Iterator[Frame]:
    """The frames of a file as they are seen, one after another.  What is no GIF, or has a canvas of more than ``MOST_PIXELS``,
    has none; a cut or broken file gives its whole frames in front of the fault (samples must be of 2 to 8 bits)."""
    if len(data) < 13 or data[:6] not in (b"GIF87a", b"GIF89a"):
        return
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    shared, at = _palette(data, 13, flags)
    if width * height > MOST_PIXELS:
        return
    canvas = np.zeros((height, width), np.uint32)
    black = np.frombuffer(b"\0\0\0\xff", np.uint32).repeat(256)
    delay, disposal, clear_index, number, clock = 0, 0, None, 0, 0
    while at < len(data):
        kind = data[at]
        if kind == 0x21 and at + 2 <= len(data):
            label = data[at + 1]
            block, at = _blocks(data, at + 2)
            if label == 0xF9 and len(block) >= 4:
                disposal, delay = block[0] >> 2 & 7, struct.unpack_from("<H", block, 1)[0] * 10
                clear_index = block[3] if block[0] & 1 else None
        elif kind == 0x2C and at + 10 <= len(data):
            left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
            own, at = _palette(data, at + 10, flags)
            if at >= len(data) or not 2 <= data[at] <= 8 or w * h > MOST_PIXELS:
                return
            bits = data[at]
            stream, at = _blocks(data, at + 1)
            indexes = np.frombuffer(lzw_decode(stream, bits, w * h).ljust(w * h, b"\0"), np.uint8).reshape(h, w)
            if flags & 0x40:
                rows = np.concatenate([np.arange(0, h, 8), np.arange(4, h, 8), np.arange(2, h, 4), np.arange(1, h, 2)])
                straight = np.empty_like(indexes)
                straight[rows] = indexes
                indexes = straight
            colours = own if own is not None else shared if shared is not None else black
            kept = canvas.copy() if disposal == 3 else None
            part = canvas[top:top + h, left:left + w]
            indexes = indexes[:part.shape[0], :part.shape[1]]
            if clear_index is None:
                part[:] = colours[indexes]
            else:
                np.copyto(part, colours[indexes], where=indexes != clear_index)
            yield Frame(number, delay, clock, canvas.copy().view(np.uint8).reshape(height, width, 4))
            number, clock = number + 1, clock + delay
            if disposal == 2:
                part[:] = 0
            elif disposal == 3:
                canvas = kept
            delay, disposal, clear_index = 0, 0, None
        elif kind == 0x3B:
            return
        else:
            return


def histogram(frame: Frame) -> list[int]:
    """Pixels that are not transparent in each of ``BINS ** 3`` colour classes (red, then green, then blue)."""
    p = frame.pixels.view(np.uint32).ravel()
    if not frame.pixels[..., 3].all():
        p = p[frame.pixels[..., 3].ravel() > 0]
    colours, counts = np.unique(p, return_counts=True)
    c = colours.view(np.uint8).reshape(-1, 4).astype(np.int64) * BINS >> 8
    return np.bincount((c[:, 0] * BINS + c[:, 1]) * BINS + c[:, 2], counts, BINS ** 3).astype(np.int64).tolist()


_GREYS = bytes(v for i in range(256) for v in (i, i, i))


def store_bytes(payload: bytes) -> bytes:
    """A payload of whole rows of ``WIDTH`` bytes as a GIF of grey pixels, one pixel a byte; many rows make many frames."""
    rows = len(payload) // WIDTH
    height = min(rows, FRAME_ROWS)
    parts = [struct.pack("<6sHHBBB", b"GIF89a", WIDTH, height, 0xF7, 0, 0), _GREYS]
    for top in range(0, rows, FRAME_ROWS):
        piece = payload[top * WIDTH:(top + FRAME_ROWS) * WIDTH]
        stream = lzw_encode(piece)
        parts.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 2 << 2, DELAY, 0, 0))  # the canvas is cleared behind each frame
        parts.append(struct.pack("<BHHHHBB", 0x2C, 0, 0, WIDTH, len(piece) // WIDTH, 0, 8))
        parts += [bytes([len(s := stream[at:at + 255])]) + s for at in range(0, len(stream), 255)]
        parts.append(b"\0")
    return b"".join(parts) + b";"


def read_bytes(frames: list[Frame]) -> bytes:
    """The payload of ``store_bytes``: the red channel of the pixels that a frame draws."""
    return b"".join((f.pixels[..., 0] if f.pixels[..., 3].all() else f.pixels[..., 0][f.pixels[..., 3] > 0]).tobytes() for f in frames)


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes of a text (null: none), with bytes 0 up to a positive multiple of ``WIDTH``; and their count before."""
    raw = (text or "").encode()
    return raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH, b"\0"), len(raw)


def decode_gifs(df: DataFrame, *, key: str, media: str) -> DataFrame:
    """Rows ``(key, frame, delay_ms, at_ms, width, height, rgba binary, histogram array<long>)``, one per frame.

    Null, empty and foreign bytes give no rows; repeated rows give repeated frames; other columns are left out.
    """
    kind = df.schema[key].dataType.simpleString()
    names = [key, "frame", "delay_ms", "at_ms", "width", "height", "rgba", "histogram"]
    types = [None, pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())]

    def run(batches):
        for batch in batches:
            for i, data in enumerate(batch.column(1).to_pylist()):
                for f in read_frames(data or b""):
                    row = [f.number, f.delay_ms, f.at_ms, f.pixels.shape[1], f.pixels.shape[0], f.pixels.tobytes(), histogram(f)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *[pa.array([v], t) for v, t in zip(row, types[1:], strict=True)]], names)

    return df.select(key, media).mapInArrow(run, f"`{key}` {kind}, frame int, delay_ms int, at_ms long, width int, height int, "
                                                 "rgba binary, histogram array<long>")


def store_texts(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``(key, n_bytes, media binary)``: each whole text stored as a GIF; null and empty texts as one row of zeros."""
    def make():
        def work(batch):
            sizes, media = [], []
            for t in batch.column(1).to_pylist():
                payload, n = padded(t)
                sizes.append(n)
                media.append(store_bytes(payload))
            return [batch.column(0), (sizes, pa.int64()), (media, pa.binary())]
        return work

    kind = df.schema[key].dataType.simpleString()
    return map_rows(df.select(key, text), f"`{key}` {kind}, n_bytes long, media binary", make)


def media_digest(df: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Rows ``(key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature)`` of stored texts.

    The payload is read back from the file.  ``feature``: frames, playing time, mean grey and the shares (in
    thousandths) of the grey classes of the colour histogram.  One row per input row.
    """
    def make():
        def work(batch):
            out = [[] for _ in range(6)]
            for data in batch.column(2).to_pylist():
                payload, frames, ms, total = [], 0, 0, np.zeros(BINS ** 3, np.int64)
                for f in read_frames(data):
                    payload.append(read_bytes([f]))
                    total += histogram(f)
                    frames, ms = frames + 1, ms + f.delay_ms
                payload = b"".join(payload)
                greys = total[::BINS * BINS + BINS + 1]
                mean = np.frombuffer(payload, np.uint8).mean() if payload else 0.0
                feature = f"frames={frames};ms={ms};mean={mean:.3f};hist=" + ",".join(str(int(g) * 1000 // max(1, int(total.sum()))) for g in greys)
                values = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature)
                for column, v in zip(out, values, strict=True):
                    column.append(v)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            return [batch.column(0), batch.column(1), *zip(out, kinds, strict=True)]
        return work

    kind = df.schema[key].dataType.simpleString()
    return map_rows(df.select(key, "n_bytes", "media"), f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, "
                                                        "tail_crc32 long, media_bytes long, media_sha256 string, feature string", make)
