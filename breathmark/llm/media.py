"""Media columns: PNG written and read through its zlib chunks, and cosine-transform hashes of its samples."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

# Fixed values of the PNG format: the signature, and the channels of each colour type.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}

#: Samples in a row of a stored payload, and the block that payloads are padded to.
WIDTH = 64
#: Edge of the picture that the transform sees, and of the low-frequency corner that it keeps.
THUMB, CORNER = 32, 8
LEVEL = 6


class MediaError(ValueError):
    """Bytes that are not a whole and valid PNG of a kind that is read here."""


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(samples: np.ndarray, row_filter: int | None = None, level: int = LEVEL) -> bytes:
    """An 8-bit PNG of (height, width) or (height, width, channels) samples.

    Every row is under the filter type given, or each under that of none, left and up whose differences add up to least.
    """
    pixels = samples.reshape(samples.shape[0], samples.shape[1], -1)
    height, width, channels = pixels.shape
    color = {1: 0, 3: 2, 2: 4, 4: 6}[channels]
    rows = np.ascontiguousarray(pixels, np.uint8).reshape(height, -1)

    def filtered(kind: int) -> np.ndarray:
        left, up, corner = np.zeros_like(rows), np.zeros_like(rows), np.zeros_like(rows)
        left[:, channels:] = rows[:, :-channels]
        up[1:] = rows[:-1]
        corner[1:, channels:] = rows[:-1, :-channels]
        if kind < 3:
            return rows - (0, left, up)[kind]
        if kind == 3:
            return rows - ((left.astype(np.uint16) + up) >> 1).astype(np.uint8)
        return rows - _paeth(left.astype(np.int16), up.astype(np.int16), corner.astype(np.int16)).astype(np.uint8)

    lines = np.empty((height, rows.shape[1] + 1), np.uint8)
    if row_filter is None:
        tried = [filtered(kind) for kind in range(3)]
        sums = np.stack([abs(t.view(np.int8).astype(np.int16)).sum(axis=1, dtype=np.int64) for t in tried])
        lines[:, 0] = sums.argmin(axis=0)
        lines[:, 1:] = np.where(lines[:, :1] == 0, tried[0], np.where(lines[:, :1] == 1, tried[1], tried[2]))
    else:
        lines[:, 0], lines[:, 1:] = row_filter, filtered(row_filter)
    header = struct.pack(">IIBBBBB", width, height, 8, color, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.data, level)) + _chunk(b"IEND", b"")


def _paeth(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    by_left, by_up, by_corner = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
    return np.where((by_left <= by_up) & (by_left <= by_corner), left, np.where(by_up <= by_corner, up, corner))


def decode_png(data: bytes) -> np.ndarray:
    """Samples as (height, width, channels) uint8 of a non-interlaced 8-bit PNG.

    Each chunk's checksum is tested, the compressed stream must be whole, and its length must fit the header.
    """
    if data[:8] != SIGNATURE:
        raise MediaError("no PNG signature")
    at, header, packed, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise MediaError("cut within a chunk")
        size = int.from_bytes(data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(body) < size or data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            raise MediaError(f"bad checksum or length of {kind!r}")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            ended = True
        at += 12 + size
    if header is None or not ended:
        raise MediaError("no header or no end")
    width, height, depth, color, method, filtering, interlace = header
    if depth != 8 or color not in CHANNELS or (method, filtering, interlace) != (0, 0, 0):
        raise MediaError("only 8-bit samples without interlacing are read")
    channels = CHANNELS[color]
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as e:
        raise MediaError(str(e)) from e
    if len(raw) != height * (width * channels + 1):
        raise MediaError("the data do not fill the picture")
    lines = np.frombuffer(raw, np.uint8).reshape(height, width * channels + 1)
    return _unfilter(lines[:, 0], lines[:, 1:], channels).reshape(height, width, channels)


def _unfilter(kinds: np.ndarray, lines: np.ndarray, channels: int) -> np.ndarray:
    if kinds.max(initial=0) > 4:
        raise MediaError("unknown filter type")
    if not kinds.any():
        return lines
    out = lines.copy()
    if kinds.max() <= 2:  # no row needs another but through sums: along it, and down from the last row that isn't under up
        left, up = kinds == 1, kinds == 2
        if left.any():
            pixels = out[left].reshape(int(left.sum()), -1, channels)
            out[left] = np.cumsum(pixels, axis=1, dtype=np.uint8).reshape(len(pixels), -1)
        if up.any():
            down = np.cumsum(np.where(up[:, None], out, np.uint8(0)), axis=0, dtype=np.uint8)
            last = np.maximum.accumulate(np.where(up, -1, np.arange(len(kinds))))
            base = np.where(last[:, None] < 0, np.uint8(0), out[last] - down[last])
            out[up] = (base + down)[up]
        return out
    starts = np.flatnonzero(np.diff(kinds, prepend=-1))
    for a, b in zip(starts, [*starts[1:], len(kinds)], strict=True):
        kind, block = kinds[a], out[a:b]
        if kind == 1:  # sums along each row, by channel
            pixels = block.reshape(b - a, -1, channels)
            np.cumsum(pixels, axis=1, dtype=np.uint8, out=pixels)
        elif kind == 2:  # sums down the block, from the row above it
            if a:
                block[0] += out[a - 1]
            np.cumsum(block, axis=0, dtype=np.uint8, out=block)
        elif kind > 2:  # each sample needs the one before it
            for y in range(a, b):
                up = out[y - 1].reshape(-1, channels).astype(np.int16) if y else np.zeros((out.shape[1] // channels, channels), np.int16)
                row, left, corner = out[y].reshape(-1, channels), np.zeros(channels, np.int16), np.zeros(channels, np.int16)
                for x in range(len(row)):
                    guess = (left + up[x]) >> 1 if kind == 3 else _paeth(left, up[x], corner)
                    row[x] += guess.astype(np.uint8)
                    left, corner = row[x].astype(np.int16), up[x]
    return out


def _cosines(n: int, kept: int) -> np.ndarray:
    """The first ``kept`` rows of the orthonormal type-II cosine transform of ``n`` samples."""
    k, i = np.arange(kept)[:, None], np.arange(n)[None, :]
    return np.sqrt(2 / n) * np.where(k == 0, np.sqrt(0.5), 1) * np.cos(np.pi * (2 * i + 1) * k / (2 * n))


_BASIS = _cosines(THUMB, CORNER)


def _thumb(gray: np.ndarray, edge: int = THUMB) -> np.ndarray:
    """Area means on an edge x edge grid; a picture with fewer rows or columns repeats them."""
    for axis in (0, 1):
        n = gray.shape[axis]
        if n >= edge:
            cuts = np.arange(edge) * n // edge
            sums = np.add.reduceat(gray, cuts, axis=axis, dtype=np.float64)
            widths = np.diff(np.append(cuts, n))
            gray = sums / (widths[:, None] if axis == 0 else widths)
        else:
            gray = np.take(gray, np.arange(edge) * n // edge, axis=axis)
    return gray.astype(np.float64)


def cosine_hash(samples: np.ndarray) -> bytes:
    """64 bits: which low-frequency coefficients of the thumbnail exceed their median (the mean level left out)."""
    gray = samples.reshape(samples.shape[0], samples.shape[1], -1)
    gray = gray[:, :, 0] if gray.shape[2] == 1 else gray.mean(axis=2)
    corner = (_BASIS @ _thumb(gray) @ _BASIS.T).round(6).ravel()
    corner[0] = 0.0
    return np.packbits(corner > np.median(corner[1:])).tobytes()


def payload(text: str) -> tuple[bytes, int]:
    """UTF-8 bytes padded with zeros to a positive multiple of WIDTH, and their number before that."""
    data = text.encode()
    return data + bytes(-len(data) % WIDTH if data else WIDTH), len(data)


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: the id, the ``media`` PNG as a binary column, and what is read back from it.

    A text, however long, becomes the rows of a 64-sample wide grey picture, each under the PNG filter that suits it. Columns: ``n_bytes``, ``payload_bytes``,
    ``payload_sha256`` and ``tail_crc32`` of the bytes read back, ``media_bytes``, ``media_sha256``, ``media``,
    and ``feature``, the 64-bit cosine hash in binary. A null or empty text is one row of zeros. Rows are
    independent, so ties and repeated rows give repeated values, an empty table gives none, and a lost executor
    costs its own tasks. Other columns of ``df`` are not read.
    """
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "media", "feature"]
    kinds = ["long", "long", "string", "long", "long", "string", "binary", "binary"]
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, " + ", ".join(map(" ".join, zip(names[1:], kinds, strict=True)))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = [_row(x.as_py()) for x in part.column(1)]
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names)

    return df.select(F.col(id_col), text_or_empty(text_col)).mapInArrow(store, schema)


_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary()]


def _row(text: str) -> tuple:
    data, size = payload(text)
    media = encode_png(np.frombuffer(data, np.uint8).reshape(-1, WIDTH))
    samples = decode_png(media)
    back = samples.tobytes()
    return (
        size, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-WIDTH:]),
        len(media), hashlib.sha256(media).hexdigest(), media, cosine_hash(samples),
    )
