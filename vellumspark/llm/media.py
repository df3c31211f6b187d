"""GIF media columns: a writer, a decoder and frame features.

``write_gif`` stores bytes losslessly as 8-bit palette indexes in compressed LZW code streams, ``iter_gif``
decodes any GIF87a or GIF89a file (LZW code streams, local and global palettes,
interlacing, disposal, transparency, delays), ``frame_features`` summarises
frames by colour histograms, ``gif_columns`` applies decoding to a binary column
and ``text_payload_columns`` the whole round trip to a text column.

Defined results: a null or empty text is a payload of 64 zero bytes; equal texts
give equal values; null media give null columns, and damaged media an error
message with the frames before the damage; an empty table gives an empty table.
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
from pyspark.sql import functions as F

from .common import pick, text_rows

BLOCK = 64
WIDTH = 64
#: Rows of one frame; longer payloads go on in further frames.
FRAME_ROWS = 1024
DELAY_CS = 4
HISTOGRAM_BINS = 16
MAX_CODES = 4096

PAYLOAD_SCHEMA = ("doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
                  "media_bytes long, media_sha256 string, feature string")
MEDIA_SCHEMA = ("id long, width int, height int, error string, "
                "frames array<struct<number:int,delay_cs:int,disposal:int,left:int,top:int,width:int,height:int,pixels:binary,histogram:array<bigint>>>")


@dataclass
class Frame:
    """One frame: its place, timing and disposal, its own indexes and palette, and the canvas it leaves, as RGBA."""

    left: int
    top: int
    indexes: np.ndarray
    palette: np.ndarray
    transparent: int | None
    delay_cs: int
    disposal: int
    canvas: np.ndarray | None


# --- writing -----------------------------------------------------------------


def lzw_segments(data: bytes, bits: int = 8) -> Iterator[list[int]]:
    """Codes of the data, each times 256, in runs that each start from an empty string table.

    The table maps (code of a known string, next byte) to the longer string's
    code. A run ends when the table's 4,096 codes are used up, so the table is
    bounded however long the data are.
    """
    first = (1 << bits) + 2 << 8
    rest = iter(data)
    word = next(rest, None)
    if word is None:
        return
    word <<= 8
    table: dict[int, int] = {}
    codes: list[int] = []
    free, full = first, MAX_CODES << 8
    for byte in rest:
        longer = word | byte
        if longer in table:
            word = table[longer]
            continue
        codes.append(word)
        word = byte << 8
        if free < full:
            table[longer] = free
            free += 256
        else:
            yield codes
            table.clear()
            codes, free = [], first
    codes.append(word)
    yield codes


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """A GIF code stream: a clear code before each run of codes, widths that grow with the table, an end code."""
    clear, offsets = 1 << bits, _widths(bits)
    codes, where, at = [[clear]], [np.zeros(1, np.int64)], bits + 1
    for run in lzw_segments(data, bits):
        if len(codes) > 1:  # the clear code between two runs still has the width of the run before it
            codes.append([clear])
            where.append(np.array([at]))
            at += width
        codes.append(np.array(run, np.uint32) >> np.uint32(8))
        where.append(at + offsets[: len(run)])
        width = int(offsets[len(run) + 1] - offsets[len(run)])
        at += int(offsets[len(run)])
    codes.append([clear + 1])
    where.append(np.array([at]))
    end = at + (width if len(codes) > 2 else bits + 1)
    return _packed(np.concatenate([np.array(c, np.uint32) for c in codes]), np.concatenate(where), end)


def _packed(codes: np.ndarray, where: np.ndarray, end: int) -> bytes:
    """Codes of 12 bits at most at their bit offsets, least significant bit first; no two overlap."""
    out = np.zeros(int(where[-1] >> 3) + 4, np.uint32)
    wide = codes << (where & 7).astype(np.uint32)
    byte = where >> 3
    for k in range(3):
        np.add.at(out, byte + k, wide >> np.uint32(8 * k) & np.uint32(255))
    return out[: -(-end // 8)].astype(np.uint8).tobytes()


def _sub_blocks(stream: bytes) -> bytes:
    whole = len(stream) // 255 * 255
    rows = np.frombuffer(stream[:whole], dtype=np.uint8).reshape(-1, 255)
    head = np.concatenate([np.full((len(rows), 1), 255, np.uint8), rows], axis=1).tobytes()
    tail = stream[whole:]
    return head + (bytes([len(tail)]) + tail if tail else b"") + b"\0"


def write_gif(payload: bytes, width: int = WIDTH, frame_rows: int = FRAME_ROWS, delay_cs: int = DELAY_CS) -> bytes:
    """Payload (a positive multiple of ``width`` bytes) as the pixel indexes of one or more frames, grey palette.

    Every frame is cleared after its time, so the canvas shows one part of the payload at a time.
    """
    data = np.frombuffer(payload, dtype=np.uint8)
    rows = len(data) // width
    if rows * width != len(data) or not rows:
        raise ValueError("payload is not a positive multiple of the width")
    height = min(rows, frame_rows)
    palette = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), palette]
    for at in range(0, rows, frame_rows):
        part = data[at * width : min(rows, at + frame_rows) * width]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 2 << 2, delay_cs, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0) + b"\x08")
        out.append(_sub_blocks(lzw_encode(part.tobytes())))
    out.append(b"\x3b")
    return b"".join(out)


# --- reading -----------------------------------------------------------------


def _code_offsets(bits: int, after_clear: int) -> np.ndarray:
    """Bit offsets and widths of up to ``after_clear`` codes that follow a clear code, none of them a clear."""
    first_free = (1 << bits) + 2
    # the k-th code after a clear is read when the table holds first_free + max(0, k - 1) entries
    entries = first_free + np.maximum(np.arange(after_clear) - 1, 0)
    widths = np.minimum(np.maximum(bits + 1, np.floor(np.log2(entries)).astype(np.int64) + 1), 12)
    return np.concatenate(([0], np.cumsum(widths)))


SPAN = MAX_CODES + 64
_OFFSETS: dict[int, np.ndarray] = {}


def _widths(bits: int) -> np.ndarray:
    if bits not in _OFFSETS:
        _OFFSETS[bits] = _code_offsets(bits, SPAN)
    return _OFFSETS[bits]


def lzw_decode(stream: bytes, min_bits: int, limit: int) -> np.ndarray:
    """Indexes of an LZW code stream, at most ``limit``.

    The width of every code between two clear codes follows from its number
    alone, so a run's codes are cut out of the bit stream at once; then they go
    through the string table that they build.
    """
    clear, end = 1 << min_bits, (1 << min_bits) + 1
    offsets = _widths(min_bits)
    data = np.frombuffer(stream + b"\0\0\0\0", dtype=np.uint8)
    total_bits = len(stream) * 8
    out: list[np.ndarray] = []
    have, at = 0, 0
    while have < limit:
        parts: list[np.ndarray] = []
        k, stop, base = 0, None, at
        while stop is None:
            # a table stays full at 12 bits until the next clear, however far that is
            if k < SPAN:
                m = min(SPAN - k, 320 if k == 0 else SPAN)
                where = base + offsets[k : k + m]
                width = offsets[k + 1 : k + m + 1] - offsets[k : k + m] if k + m < len(offsets) else np.diff(offsets[k:])
                where = where[: len(width)]
            else:
                where = base + offsets[SPAN] + 12 * (np.arange(SPAN) + k - SPAN)
                width = np.full(SPAN, 12)
            inside = where + width <= total_bits
            where, width = where[inside], width[inside]
            byte = where >> 3
            raw = data[byte].astype(np.int64) | (data[byte + 1].astype(np.int64) << 8) | (data[byte + 2].astype(np.int64) << 16)
            codes = (raw >> (where & 7)) & ((1 << width) - 1)
            hits = np.flatnonzero((codes == clear) | (codes == end))
            if len(hits):
                stop = int(codes[hits[0]])
                at = int(where[hits[0]] + width[hits[0]])
                codes = codes[: hits[0]]
            elif not inside.all() or not len(where):
                stop = end  # the stream ends without an end code
            parts.append(codes)
            k += len(width)
        codes = np.concatenate(parts)
        if len(codes):
            out.append(_expand(codes, clear))
            have += len(out[-1])
        if stop == end:
            break
    found = np.concatenate(out) if out else np.zeros(0, np.uint8)
    return found[:limit]


def _expand(codes: np.ndarray, clear: int) -> np.ndarray:
    """Strings of a run's codes, through the table that the codes themselves build.

    The table's k-th string is the k-th code's string and the byte that follows
    it in the output, so each byte of the output is a literal or has its source
    further to the front. Lengths and sources are followed by pointer doubling.
    """
    n = len(codes)
    place = np.arange(n, dtype=np.int32)
    literal = codes < clear
    entry = np.where(literal, place, codes - (clear + 2)).astype(np.int32)
    if not literal[0]:
        raise ValueError("a run starts with a code that is not a literal")
    if (~literal & ((entry < 0) | (entry >= place))).any():
        raise ValueError("a code lies beyond the table")
    size, ahead = np.where(literal, 0, 1).astype(np.int32), entry
    while not literal[ahead].all():
        size = size + size[ahead]
        ahead = ahead[ahead]
    size = size + 1
    start = np.cumsum(size, dtype=np.int32) - size
    at = np.arange(int(start[-1] + size[-1]), dtype=np.int32)
    source = at - np.repeat(np.where(literal, 0, start - start[entry]).astype(np.int32), size)
    while True:
        further = source[source]
        if (further == source).all():
            break
        source = further
    value = np.zeros(len(at), np.uint8)
    value[start[literal]] = codes[literal]
    return value[source]


def _blocks(media: bytes, at: int) -> tuple[bytes, int]:
    """Sub-blocks from ``at`` on, joined, and the place behind their terminator."""
    size = media[at]
    start, n = at, 0
    # writers fill blocks: a run of full ones is cut out together
    while at + 256 <= len(media) and media[at] == 255:
        at += 256
        n += 1
    parts = [np.frombuffer(media[start:at], np.uint8).reshape(n, 256)[:, 1:].tobytes()] if n else []
    while (size := media[at]) != 0:
        parts.append(media[at + 1 : at + 1 + size])
        at += 1 + size
    return b"".join(parts), at + 1


def _deinterlace(rows: np.ndarray) -> np.ndarray:
    height = len(rows)
    order = np.concatenate([np.arange(s, height, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
    out = np.empty_like(rows)
    out[order] = rows
    return out


def iter_gif(media: bytes, render: bool = True) -> Iterator[tuple[int, int, Frame]]:
    """(canvas width, canvas height, frame) for each frame, in order; ValueError where the file is damaged."""
    try:
        if media[:6] not in (b"GIF87a", b"GIF89a"):
            raise ValueError("no GIF header")
        width, height, packed, _, _ = struct.unpack_from("<HHBBB", media, 6)
        at, shared = 13, np.zeros((0, 3), np.uint8)
        if packed & 0x80:
            size = 2 << (packed & 7)
            shared = np.frombuffer(media, np.uint8, 3 * size, at).reshape(-1, 3)
            at += 3 * size
        canvas = np.zeros((height, width, 4), np.uint8) if render else None
        delay, disposal, transparent = 0, 0, None
        while True:
            kind = media[at]
            if kind == 0x3B:
                return
            if kind == 0x21:
                body, following = _blocks(media, at + 2)
                if media[at + 1] == 0xF9 and len(body) >= 4:
                    flags, delay, index = struct.unpack_from("<BHB", body)
                    disposal, transparent = (flags >> 2) & 7, index if flags & 1 else None
                at = following
                continue
            if kind != 0x2C:
                raise ValueError(f"unknown block {kind:#x}")
            left, top, w, h, flags = struct.unpack_from("<HHHHB", media, at + 1)
            at += 10
            palette = shared
            if flags & 0x80:
                size = 2 << (flags & 7)
                palette = np.frombuffer(media, np.uint8, 3 * size, at).reshape(-1, 3)
                at += 3 * size
            min_bits = media[at]
            if not 1 <= min_bits <= 8:
                raise ValueError("code size out of range")
            stream, at = _blocks(media, at + 1)
            found = lzw_decode(stream, min_bits, w * h)
            if len(found) < w * h:
                raise ValueError("a frame's codes end early")
            indexes = found.reshape(h, w)
            if flags & 0x40:
                indexes = _deinterlace(indexes)
            shown = None
            if render:
                before = canvas.copy() if disposal == 3 else None
                y1, x1 = min(top + h, height), min(left + w, width)
                part = indexes[: max(0, y1 - top), : max(0, x1 - left)]
                colours = np.zeros((256, 4), np.uint8)
                colours[: len(palette), :3] = palette
                colours[:, 3] = 255
                pixels = colours.view(np.uint32).ravel()[part]  # a pixel's four bytes as one number
                area = canvas.view(np.uint32)[top:y1, left:x1, 0]
                if transparent is None:
                    area[:] = pixels
                else:
                    np.copyto(area, pixels, where=part != transparent)
                shown = canvas.copy()
                if disposal == 2:
                    area[:] = 0
                elif disposal == 3:
                    canvas = before
            yield width, height, Frame(left, top, indexes, palette, transparent, delay, disposal, shown)
            delay, disposal, transparent = 0, 0, None
    except (IndexError, struct.error) as e:
        raise ValueError("the file ends early") from e


def read_payload(media: bytes) -> bytes:
    """The bytes that ``write_gif`` stored."""
    return b"".join(frame.indexes.tobytes() for _, _, frame in iter_gif(media, render=False))


def colour_histogram(frame: Frame, bins: int = HISTOGRAM_BINS) -> np.ndarray:
    """Pixels by luminance bin; transparent ones are not counted. Counted by index, then mapped by palette."""
    counts = np.bincount(frame.indexes.ravel(), minlength=256)
    if frame.transparent is not None:
        counts[frame.transparent] = 0
    palette = np.zeros((256, 3), np.int64)
    palette[: len(frame.palette)] = frame.palette
    luminance = (77 * palette[:, 0] + 150 * palette[:, 1] + 29 * palette[:, 2]) // 256
    return np.bincount(luminance * bins // 256, weights=counts, minlength=bins).astype(np.int64)


def canvas_histogram(canvas: np.ndarray, bins: int = HISTOGRAM_BINS) -> np.ndarray:
    """Visible pixels of an RGBA canvas by luminance bin."""
    seen = canvas[canvas[..., 3] > 0]
    weight = np.array([77, 150, 29], np.uint16)  # of 256
    luminance = (seen[:, 0] * weight[0] + seen[:, 1] * weight[1] + seen[:, 2] * weight[2]) >> np.uint16(8)
    return np.bincount(luminance.astype(np.int64) * bins // 256, minlength=bins)


def frame_features(media: bytes) -> tuple[bytes, str]:
    """The stored bytes, and the features of the decoded and rendered frames as text."""
    payload, hist, n, height, delay = [], np.zeros(HISTOGRAM_BINS, np.int64), 0, 0, 0
    width = 0
    for width, _, frame in iter_gif(media):
        payload.append(frame.indexes.tobytes())
        hist += canvas_histogram(frame.canvas)
        n, height, delay = n + 1, height + len(frame.indexes), delay + frame.delay_cs
    share = hist / max(1, hist.sum())
    entropy = float(-(share[share > 0] * np.log2(share[share > 0])).sum()) + 0.0
    text = f"gif;frames={n};width={width};rows={height};delay_cs={delay};entropy={entropy:.4f};hist={','.join(map(str, hist))}"
    return b"".join(payload), text


# --- columns -----------------------------------------------------------------


def text_payload_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored as a GIF, read back, and described. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for value in batch.column(1):
                text = (value.as_py() or "").encode("utf-8", "surrogatepass")
                padded = text + b"\0" * (-len(text) % BLOCK or (0 if text else BLOCK))
                media = write_gif(padded)
                back, feature = frame_features(media)
                row = (len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]),
                       len(media), hashlib.sha256(media).hexdigest(), feature)
                for column, item in zip(out, row):
                    column.append(item)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds))],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return text_rows(pick(docs, doc_id=id_col, text=text_col)).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PAYLOAD_SCHEMA)


def gif_columns(media: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """Timed frames of a binary column: canvas pixels as RGBA rows, place, delay, disposal and colour histogram."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for pdf in frames:
            rows = []
            for key, data in zip(pdf["id"], pdf["media"]):
                width = height = None
                error, found = None, None
                if data is not None:
                    found = []
                    try:
                        for width, height, f in iter_gif(bytes(data)):
                            found.append({"number": len(found), "delay_cs": f.delay_cs, "disposal": f.disposal, "left": f.left, "top": f.top,
                                          "width": f.indexes.shape[1], "height": f.indexes.shape[0], "pixels": f.canvas.tobytes(),
                                          "histogram": colour_histogram(f).tolist()})
                    except ValueError as e:
                        error = str(e)
                rows.append((key, width, height, error, found))
            out = pd.DataFrame(rows, columns=["id", "width", "height", "error", "frames"])
            for c in ("id", "width", "height"):
                out[c] = out[c].astype("Int64")
            yield out

    return pick(media, id=id_col, media=media_col).select(F.col("id").cast("long"), "media").mapInPandas(run, MEDIA_SCHEMA)
