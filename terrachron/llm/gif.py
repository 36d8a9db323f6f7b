"""GIF columns (operator 3).

Method: parse the blocks of a GIF, decode the LZW code streams, apply global and
local palettes, interlacing, transparency and disposal, and store each timed
frame with its colour histogram. The codes between two clear codes have widths
that depend on their number alone, so they are cut out of the stream with array
operations; only the table of strings is built code by code.

``payload_gifs`` is the way in for samples that have no picture: bytes become
the palette indices of 64-pixel rows, in frames of up to 256 rows.

Defined results: null texts count as empty; a payload has 64 bytes at least;
bytes that are no GIF give an ``error`` and no frames; a stream that ends early
leaves its missing pixels undrawn; rows are independent, so ties, repeated rows
and further columns have no effect; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

WIDTH, ROWS = 64, 256
MOST_PIXELS = 1 << 24  # of a canvas or frame; larger ones give the error, as memory is taken by what a file declares
DELAY_CS = 4
_SINGLE = [bytes([k]) for k in range(256)]


def code_widths(start: int, count: int) -> np.ndarray:
    """Width of each of the `count` codes after a clear code, for an alphabet of 2**start: as many bits as the table's next entry has, 12 at most."""
    table = np.arange(count) + (1 << start) + 1
    return np.clip(np.floor(np.log2(table)).astype(np.int64) + 1, start + 1, 12)


_WIDTHS: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def widths(start: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths and bit offsets; counts are rounded up to share tables."""
    key = start, 1 << max(6, (count - 1).bit_length())
    if key not in _WIDTHS:
        w = code_widths(*key)
        _WIDTHS[key] = w, np.concatenate([[0], np.cumsum(w)])
    return _WIDTHS[key]


def lzw_encode(data: bytes, start: int = 8) -> bytes:
    """GIF's LZW with a clear code first and whenever the table is full."""
    clear, end = 1 << start, (1 << start) + 1
    full = 4096 - end - 1
    runs, codes, table, free, at = [], [], {}, end + 1, -1
    add, get = codes.append, table.get
    for b in data:
        if at < 0:
            at = b
            continue
        key = at << 8 | b
        found = get(key)
        if found is not None:
            at = found
            continue
        add(at)
        table[key] = free
        free += 1
        at = b
        if len(codes) >= full:
            runs.append(codes)
            codes, table, free = [], {}, end + 1
            add, get = codes.append, table.get
    if at >= 0:
        add(at)
    runs.append(codes)
    all_codes, all_widths = [], []
    last = start + 1
    for run in runs:
        w, _ = widths(start, len(run) + 1)
        all_codes += [[clear], run]
        all_widths += [[last], w[: len(run)]]
        last = int(w[len(run)])
    all_codes.append([end])
    all_widths.append([last])
    return pack_bits(np.concatenate([np.asarray(c, np.uint32) for c in all_codes]), np.concatenate([np.asarray(w, np.int64) for w in all_widths]))


def pack_bits(codes: np.ndarray, w: np.ndarray) -> bytes:
    """Codes of the given widths, least significant bit first."""
    at = np.cumsum(w) - w
    total = int(w.sum())
    out = np.zeros((total + 7) // 8 + 3, np.uint32)
    shifted = codes.astype(np.uint32) << (at & 7).astype(np.uint32)
    byte = at >> 3
    for k in range(3):
        out += np.bincount(byte + k, (shifted >> np.uint32(8 * k)) & np.uint32(255), len(out))[: len(out)].astype(np.uint32)
    return out[: (total + 7) // 8].astype(np.uint8).tobytes()


def codes_at(raw: np.ndarray, bit: int, start: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to `most` codes after a clear code that ends before `bit`, and the offsets at which they end. raw: with 4 zero bytes behind."""
    _, offsets = widths(start, most)
    offsets = offsets[: most + 1]
    left = (len(raw) - 4) * 8 - bit
    n = int(np.searchsorted(offsets, left, "right")) - 1
    if n <= 0:
        return np.empty(0, np.int64), offsets[1:1]
    at = bit + offsets[:n]
    byte = at >> 3
    value = raw[byte].astype(np.int64) | raw[byte + 1].astype(np.int64) << 8 | raw[byte + 2].astype(np.int64) << 16
    w = offsets[1 : n + 1] - offsets[:n]
    return (value >> (at & 7)) & ((1 << w) - 1), offsets[1 : n + 1]


def lzw_decode(data: bytes, start: int, pixels: int) -> bytes:
    """At most `pixels` indices of a code stream. Codes that are not in the table end it."""
    clear, end = 1 << start, (1 << start) + 1
    raw = np.frombuffer(data + b"\0\0\0\0", np.uint8)
    bit, out, have = 0, [], 0
    single = _SINGLE[:clear]
    while have < pixels:
        most = min(4096, pixels - have + 2)
        codes, ends = codes_at(raw, bit, start, most)
        if not len(codes):
            break
        stop = np.flatnonzero((codes == clear) | (codes == end))
        n = int(stop[0]) if len(stop) else len(codes)
        table = [*single, b"", b""]
        add, put = table.append, out.append
        size, prev = end + 1, b""
        for c in codes[:n].tolist():
            if c < size:
                e = table[c]
            elif c == size and prev and size < 4096:
                e = prev + prev[:1]
            else:
                return b"".join(out)[:pixels]
            if prev and size < 4096:
                add(prev + e[:1])
                size += 1
            put(e)
            have += len(e)
            prev = e
        if len(stop):
            if codes[n] == end:
                break
            bit += int(ends[n])
        elif n == most and have < pixels:  # a full table that goes on: 12 bits each, nothing more is added
            bit += int(ends[-1])
            while have < pixels and bit + 12 <= len(data) * 8:
                k = bit >> 3
                c = (int(raw[k]) | int(raw[k + 1]) << 8 | int(raw[k + 2]) << 16) >> (bit & 7) & 0xFFF
                bit += 12
                if c == end:
                    return b"".join(out)[:pixels]
                if c == clear:
                    break
                e = table[c] if c < size else b""
                put(e)
                have += len(e)
        else:
            break
    return b"".join(out)[:pixels]


@dataclass
class Frame:
    start_ms: int
    delay_ms: int
    disposal: int
    left: int
    top: int
    indices: np.ndarray  # height x width, as stored
    canvas: np.ndarray  # height x width x 4, RGBA after drawing


def sub_blocks(raw: bytes, at: int) -> tuple[bytes, int]:
    out = []
    while at < len(raw) and raw[at]:
        out.append(raw[at + 1 : at + 1 + raw[at]])
        at += 1 + raw[at]
    return b"".join(out), at + 1


def palette(raw: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    if not flags & 0x80:
        return None, at
    n = 2 << (flags & 7)
    colours = np.zeros((256, 3), np.uint8)
    got = np.frombuffer(raw[at : at + 3 * n], np.uint8)
    colours[: len(got) // 3] = got[: len(got) // 3 * 3].reshape(-1, 3)
    return colours, at + 3 * n


def row_order(height: int, interlaced: bool) -> np.ndarray:
    if not interlaced:
        return np.arange(height)
    return np.concatenate([np.arange(first, height, step) for first, step in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode_gif(raw: bytes) -> tuple[int, int, list[Frame]]:
    """Width, height and frames. Raises ValueError if the bytes are no GIF."""
    if raw[:6] not in (b"GIF87a", b"GIF89a") or len(raw) < 13:
        raise ValueError("no GIF header")
    width, height, flags = struct.unpack("<HHB", raw[6:11])
    if width * height > MOST_PIXELS:
        raise ValueError(f"canvas of {width} x {height}")
    shared, at = palette(raw, 13, flags)
    canvas = np.zeros((height, width, 4), np.uint8)
    frames, now = [], 0
    delay, disposal, clear = 0, 0, -1
    while at < len(raw):
        kind = raw[at]
        if kind == 0x3B:
            break
        if kind == 0x21:
            body, after = sub_blocks(raw, at + 2)
            if raw[at + 1 : at + 2] == b"\xf9" and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, struct.unpack("<H", body[1:3])[0] * 10
                clear = body[3] if body[0] & 1 else -1
            at = after
            continue
        if kind != 0x2C or at + 10 > len(raw):
            raise ValueError(f"unknown block {kind:#x} at {at}")
        left, top, w, h, flags = struct.unpack("<HHHHB", raw[at + 1 : at + 10])
        if w * h > MOST_PIXELS:
            raise ValueError(f"frame of {w} x {h}")
        own, at = palette(raw, at + 10, flags)
        colours = own if own is not None else shared if shared is not None else np.zeros((256, 3), np.uint8)
        if at >= len(raw) or not 1 <= raw[at] <= 8:
            raise ValueError("bad code size")
        start = raw[at]
        data, at = sub_blocks(raw, at + 1)
        flat = np.frombuffer(lzw_decode(data, start, w * h), np.uint8)
        drawn = np.zeros(w * h, bool)
        drawn[: len(flat)] = True
        flat = np.concatenate([flat, np.zeros(w * h - len(flat), np.uint8)])
        order = row_order(h, bool(flags & 0x40))
        indices, there = np.empty((h, w), np.uint8), np.empty((h, w), bool)
        indices[order], there[order] = flat.reshape(h, w), drawn.reshape(h, w)
        before = canvas.copy() if disposal == 3 else None
        show = there & (indices != clear)
        rows, cols = max(0, min(h, height - top)), max(0, min(w, width - left))
        part, seen = canvas[top : top + rows, left : left + cols], show[:rows, :cols]
        part[seen, :3] = colours[indices[:rows, :cols][seen]]
        part[seen, 3] = 255
        frames.append(Frame(now, delay, disposal, left, top, indices, canvas.copy()))
        now += delay
        if disposal == 2:
            canvas[top : top + rows, left : left + cols] = 0
        elif disposal == 3:
            canvas = before
        delay, disposal, clear = 0, 0, -1
    return width, height, frames


def histogram(canvas: np.ndarray) -> list[int]:
    """Visible pixels in each of 4 x 4 x 4 colour cells."""
    seen = canvas[canvas[..., 3] > 0]
    cell = (seen[:, 0] >> 6).astype(np.int64) * 16 + (seen[:, 1] >> 6) * 4 + (seen[:, 2] >> 6)
    return np.bincount(cell, minlength=64).tolist()


GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()


def encode_gif(payload: bytes) -> bytes:
    """Bytes as indices of a grey palette, 64 to a row, 256 rows to a frame. The length is a positive multiple of 64."""
    rows = len(payload) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, ROWS), 0xF7, 0, 0), GREY]
    for at in range(0, rows, ROWS):
        part = payload[at * WIDTH : (at + ROWS) * WIDTH]
        data = lzw_encode(part)
        out += [b"\x21\xf9\x04", struct.pack("<BHB", 1 << 2, DELAY_CS, 0), b"\0\x2c", struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0), b"\x08"]
        out += [bytes([len(data[k : k + 255])]) + data[k : k + 255] for k in range(0, len(data), 255)]
        out.append(b"\0")
    return b"".join([*out, b"\x3b"])


def read_payload(raw: bytes) -> tuple[bytes, list[Frame]]:
    """Indices of all frames in order."""
    frames = decode_gif(raw)[2]
    return b"".join(f.indices.tobytes() for f in frames), frames


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % 64 if raw else 64)


def frames_table(media: DataFrame, column: str = "gif", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each frame of each GIF in a binary column: keep..., frame, start_ms, delay_ms, disposal, width, height, rgba, histogram, error. Bytes that are no GIF give one row with the error."""
    small_batches(media.sparkSession, 64)
    kept = media.select(*keep, F.col(column).alias("_gif"))
    fields = ", ".join(f"{c} {media.schema[c].dataType.simpleString()}" for c in keep)
    schema = (fields + ", " if fields else "") + "frame int, start_ms bigint, delay_ms bigint, disposal int, width int, height int, rgba binary, histogram array<bigint>, error string"

    def run(batches):
        for b in batches:
            for row in range(b.num_rows):
                raw, same, error = b.column("_gif")[row].as_py(), {c: b.column(c).slice(row, 1) for c in keep}, None
                try:
                    w, h, frames = decode_gif(raw or b"")
                except (ValueError, struct.error) as e:
                    w, h, frames, error = None, None, [], str(e)
                cells = [(k, f.start_ms, f.delay_ms, f.disposal, w, h, f.canvas.tobytes(), histogram(f.canvas), None) for k, f in enumerate(frames)] or [(None,) * 8 + (error or "no frames",)]
                columns = [pa.array([x[k] for x in cells], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.string()))]
                repeated = [pa.concat_arrays([same[c]] * len(cells)) for c in keep]
                yield pa.RecordBatch.from_arrays([*repeated, *columns], [*keep, "frame", "start_ms", "delay_ms", "disposal", "width", "height", "rgba", "histogram", "error"])

    return kept.mapInArrow(run, schema)


def payload_gifs(docs: DataFrame, *, with_media: bool = False) -> DataFrame:
    """Store each text as a GIF, read the stored bytes back, and describe both."""
    small_batches(docs.sparkSession, 256)
    key = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "histogram"]

    def run(batches):
        for b in batches:
            rows = []
            for t in b.column("text"):
                n, payload = padded(t.as_py())
                media = encode_gif(payload)
                back, frames = read_payload(media)
                bins = np.bincount(np.frombuffer(back, np.uint8) >> 4, minlength=16)
                feature = ",".join(str(int(x) * 1000 // len(back)) for x in bins) + f";{len(frames)}"
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, len(frames), bins.tolist(), media))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.binary())[: 9 + with_media]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], [*names, "gif"][: 10 + with_media])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_frames bigint, histogram array<bigint>" + (", gif binary" if with_media else ""))
