"""Media columns: PNG images in binary columns, read back with checksum tests.

encode_png and decode_png are small codecs for 8-bit RGB images 64 pixels wide: the chunks are
tested by CRC, the pixel data by zlib's own checksum, and the rows are unfiltered with
numpy. phash is the sign pattern of the lowest 8 x 8 cosine coefficients of the 32 x 32
grey image, against their median.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verilake.llm.common import bounded_batches, table

#: Fixed values of the file format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH, DEPTH = 64, 3
ROW = WIDTH * DEPTH
SIDE, LOW = 32, 8
_BASIS = np.cos(np.pi * np.arange(LOW)[:, None] * (2 * np.arange(SIDE)[None, :] + 1) / (2 * SIDE))


class BadImage(ValueError):
    """A damaged or unsupported image."""


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def pad(data: bytes) -> bytes:
    """Spaces up to a positive multiple of one row."""
    return data + b" " * ((-len(data)) % ROW if data else ROW)


def _filtered(rows: np.ndarray, kind: int) -> np.ndarray:
    """Rows less what a filter predicts: 0 nothing, 1 the pixel to the left, 2 that above, 3 the mean of both, 4 the nearest to left + above - corner of these."""
    if kind == 0:
        return rows
    left, above = np.zeros_like(rows), np.zeros_like(rows)
    left[:, DEPTH:], above[1:] = rows[:, :-DEPTH], rows[:-1]
    if kind < 3:
        return rows - (left if kind == 1 else above)
    corner = np.zeros_like(rows)
    corner[1:, DEPTH:] = rows[:-1, :-DEPTH]
    return rows - _predicted(kind, left.astype(np.int16), above.astype(np.int16), corner.astype(np.int16)).astype(np.uint8)


def _predicted(kind, left: np.ndarray, above: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """What each kind of filter (a number, or one for each pixel) predicts from the neighbours."""
    estimate = left + above - corner
    a, b, c = abs(estimate - left), abs(estimate - above), abs(estimate - corner)
    nearest = np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))
    return np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, above, (left + above) >> 1, nearest], 0)


def encode_png(payload: bytes, filters: int | None = None, level: int = 4) -> bytes:
    """payload, a positive multiple of 192 bytes, as the rows of an image.

    filters names one filter for all rows; without it each row gets that of 0, 1, 2 and 4 with
    the smallest differences, the usual rule of encoders.
    """
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.empty((len(rows), ROW + 1), np.uint8)
    if filters is None:
        kinds = np.array([0, 1, 2, 4], np.uint8)
        coded = np.stack([_filtered(rows, int(kind)) for kind in kinds])
        best = np.minimum(coded, -coded).sum(2, dtype=np.int64).argmin(0)
        lines[:, 0], lines[:, 1:] = kinds[best], coded[best, np.arange(len(rows))]
    else:
        lines[:, 0], lines[:, 1:] = filters, _filtered(rows, filters)
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines, level)) + _chunk(b"IEND", b"")


def _unfilter(images: list[np.ndarray], depth: int) -> list[np.ndarray]:
    """Rows with a leading filter byte -> samples, for images of one width.

    A pixel needs those to its left, above and at the corner between, so all pixels of a
    diagonal are done at once, for all images together, one diagonal after the other.
    """
    heights = np.array([len(x) for x in images])
    lines = np.concatenate(images)
    kinds, width = lines[:, 0], (lines.shape[1] - 1) // depth
    pixels = lines[:, 1:].reshape(-1, depth)
    row = np.arange(len(lines))
    y = row - np.repeat(np.cumsum(heights) - heights, heights)
    order = np.argsort(y, kind="stable")
    level = y[order]
    # One more row and column of zeros for what lies outside of an image.
    out = np.zeros(((len(lines) + 1) * (width + 1), depth), np.int16)
    above_row = np.where(y > 0, row - 1, len(lines))
    for d in range(int(heights.max()) + width - 1):
        lo, hi = np.searchsorted(level, (d - width + 1, d + 1))
        at = order[lo:hi]
        x = d - level[lo:hi]
        here, above = at * (width + 1) + x, above_row[at] * (width + 1) + x
        guess = _predicted(kinds[at, None], out.take(here, 0), out.take(above + 1, 0), out.take(above, 0))
        out[here + 1] = (pixels.take(at * width + x, 0) + guess) & 255
    samples = out.reshape(-1, width + 1, depth)[:-1, 1:].astype(np.uint8).reshape(len(lines), -1)
    return np.split(samples, np.cumsum(heights)[:-1])


def _simple(lines: np.ndarray, depth: int) -> np.ndarray | None:
    """The samples of an image whose rows need no diagonals, else None."""
    kinds, rows = lines[:, 0], lines[:, 1:]
    if (kinds == 2).all():
        return np.cumsum(rows, axis=0, dtype=np.uint8)
    if (kinds > 1).any():
        return None
    out = rows.copy()
    out[kinds == 1] = np.cumsum(rows[kinds == 1].reshape(-1, rows.shape[1] // depth, depth), axis=1, dtype=np.uint8).reshape(-1, rows.shape[1])
    return out


def _rows_of(data: bytes) -> np.ndarray:
    """The filtered rows. Raises BadImage on a wrong checksum, length or kind."""
    if data[:8] != SIGNATURE:
        raise BadImage("signature")
    at, header, packed, kind = 8, None, [], b""
    while kind != b"IEND":
        if at + 12 > len(data):
            raise BadImage("truncated")
        (length,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + length]
        if len(body) != length or data[at + 8 + length : at + 12 + length] != struct.pack(">I", zlib.crc32(body, zlib.crc32(kind))):
            raise BadImage("checksum of a chunk")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + length
    if header is None or header[2:] != (8, 2, 0, 0, 0):
        raise BadImage("kind of image")
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as e:
        raise BadImage("pixel data") from e
    width, height = header[:2]
    if len(raw) != height * (width * DEPTH + 1):
        raise BadImage("length of the pixel data")
    lines = np.frombuffer(raw, np.uint8).reshape(height, -1)
    if (lines[:, 0] > 4).any():
        raise BadImage("kind of filter")
    return lines


def decode_all(images: list[bytes | None]) -> list[np.ndarray | None]:
    """The samples of each image, (height, width, 3); None for one that is missing, damaged or of another kind."""
    found: list[np.ndarray | None] = []
    waiting: dict[int, list[int]] = {}
    for i, data in enumerate(images):
        try:
            lines = _rows_of(data)
        except (BadImage, TypeError):
            found.append(None)
            continue
        found.append(_simple(lines, DEPTH))
        if found[-1] is None:
            found[-1] = lines
            waiting.setdefault(lines.shape[1], []).append(i)
    for group in waiting.values():
        for i, samples in zip(group, _unfilter([found[i] for i in group], DEPTH)):
            found[i] = samples
    return [None if x is None else x.reshape(len(x), -1, DEPTH) for x in found]


def decode_png(data: bytes) -> np.ndarray:
    """The samples of one image, (height, width, 3). Raises BadImage on a wrong checksum, length or kind."""
    _rows_of(data)
    return decode_all([data])[0]


def _shrink(grey: np.ndarray, axis: int) -> np.ndarray:
    n = grey.shape[axis]
    if n <= SIDE:
        return np.take(grey, np.arange(SIDE) * n // SIDE, axis)
    edges = np.arange(SIDE + 1) * n // SIDE
    shape = [1, 1]
    shape[axis] = SIDE
    return np.add.reduceat(grey, edges[:-1], axis) / np.diff(edges).reshape(shape)


def phash(pixels: np.ndarray) -> str:
    """16 hex digits from the low-frequency cosine coefficients of the grey image."""
    small = _shrink(_shrink(pixels.sum(2, dtype=np.int64), 0), 1)
    low = np.round(_BASIS @ small @ _BASIS.T, 3)
    bits = low > np.median(low.ravel()[1:])
    return np.packbits(bits.ravel()).tobytes().hex()


def text_to_png(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Whole texts as images; a null text is stored like an empty one."""
    for text in texts:
        yield pd.Series([encode_png(pad((t or "").encode("utf-8", "replace"))) for t in text], dtype=object)


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def png_features(images: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Digests and hash of stored images, from the bytes read back; an image that fails its checksums gives nulls."""
    for batch in images:
        rows = []
        for image, pixels in zip(batch, decode_all([*batch])):
            if pixels is None:
                rows.append((None,) * 6)
                continue
            payload = pixels.tobytes()
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(image), hashlib.sha256(image).hexdigest(), phash(pixels)))
        yield pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def store_texts(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """id, n_bytes and the image of every text. Nulls are stored like empty texts; repeated rows stay; other columns are ignored."""
    bounded_batches(docs.sparkSession)
    return docs.select(id_col, F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.pandas_udf(text_to_png, "binary")(text_col).alias("media"))


def op5_media(spark, sf_dir):
    """Every text stored as an image, read back, digested and hashed."""
    stored = store_texts(table(spark, sf_dir, "documents"))
    return stored.select("doc_id", "n_bytes", F.pandas_udf(png_features, FEATURES)("media").alias("f")).select("doc_id", "n_bytes", "f.*")
