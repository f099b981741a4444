"""PNG storage of payloads, and low-frequency cosine hashes of what is read back."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textnum import lean, small_batches

WIDTH = 64
#: Samples, about, that are read back together.
STEP_BYTES = 4_000_000
_SIGNATURE = b"\x89PNG\r\n\x1a\n"  # fixed value of the format


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def _predicted(left: np.ndarray, above: np.ndarray, corner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the filters average and Paeth subtract, for int16 neighbours."""
    p, q = np.abs(above - corner), np.abs(left - corner)  # distances of left + above - corner from left and from above
    r = np.abs(left + above - 2 * corner)
    return (left + above) >> 1, np.where((p <= q) & (p <= r), left, np.where(q <= r, above, corner))


def encode(payload: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    """An 8-bit greyscale PNG of `width` columns; the payload is a positive multiple of width.

    Each row takes the filter (none, sub, up, average or Paeth) with the least sum of absolute
    differences, the first of equal ones.
    """
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, width)
    around = np.zeros((len(rows) + 1, width + 1), dtype=np.int16)
    around[1:, 1:] = rows
    left, above, corner = around[1:, :-1], around[:-1, 1:], around[:-1, :-1]
    average, paeth = _predicted(left, above, corner)
    tried = (rows[None] - np.stack([np.zeros_like(left), left, above, average, paeth])).astype(np.uint8)
    lines = np.zeros((len(rows), width + 1), dtype=np.uint8)
    lines[:, 0] = np.minimum(tried, -tried).sum(axis=2, dtype=np.int64).argmin(axis=0)
    lines[:, 1:] = tried[lines[:, 0], np.arange(len(rows))]
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def unfilter(images: list[np.ndarray]) -> list[np.ndarray]:
    """Undo the five PNG row filters of images of one width; an image has the filter types in column 0.

    A sample needs those at its left, above and at the corner.  So the samples of one
    diagonal, column plus row number, are made together: one step takes a diagonal of all images at once.
    """
    heights = np.array([len(x) for x in images])
    lines = np.concatenate(images)
    kind, raw = lines[:, 0], np.ascontiguousarray(lines[:, 1:])
    if (kind > 4).any():
        raise ValueError("unknown PNG filter")
    width = raw.shape[1]
    start = np.repeat(np.cumsum(heights) - heights, heights)
    number = np.arange(len(raw)) - start
    by = np.argsort(number, kind="stable")  # rows of equal number follow one another
    edge = np.concatenate([[0], np.cumsum(np.bincount(number))])
    # a row of zeros lies before the first rows, and a column of zeros before the first columns
    stride = width + 1
    out = np.zeros((len(raw) + 1) * stride, dtype=np.int16)
    own = (by + 1) * stride
    above = np.where(number[by] > 0, own - stride, 0)
    filter_ = kind[by]
    source = by * width
    flat = raw.reshape(-1)
    for step in range(int(heights.max()) + width - 1):
        lo, hi = edge[max(0, step - width + 1)], edge[min(step + 1, len(edge) - 1)]
        column = step - number[by[lo:hi]]
        a = own[lo:hi] + column
        b = above[lo:hi] + column
        left, up, corner = out[a], out[b + 1], out[b]
        average, paeth = _predicted(left, up, corner)
        guess = np.choose(filter_[lo:hi], [0, left, up, average, paeth])
        out[a + 1] = (flat[source[lo:hi] + column] + guess) & 255
    done = out.reshape(-1, stride)[1:, 1:].astype(np.uint8)
    return np.split(done, np.cumsum(heights)[:-1])


def filtered(png: bytes) -> np.ndarray:
    """The filtered rows of an 8-bit greyscale PNG, after testing the signature, each chunk's CRC and the sizes."""
    if png[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, width, height, parts = 8, 0, 0, []
    while at < len(png):
        size, kind = struct.unpack_from(">I4s", png, at)
        data = memoryview(png)[at + 8 : at + 8 + size]
        if len(data) != size or struct.unpack_from(">I", png, at + 8 + size)[0] != zlib.crc32(data, zlib.crc32(kind)):
            raise ValueError("a PNG chunk fails its checksum")
        if kind == b"IHDR":
            width, height, *rest = struct.unpack(">IIBBBBB", data)
            if rest != [8, 0, 0, 0, 0]:
                raise ValueError("only 8-bit greyscale without interlacing")
        elif kind == b"IDAT":
            parts.append(data)
        elif kind == b"IEND":
            break
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), dtype=np.uint8)
    if not width or len(lines) != height * (width + 1):
        raise ValueError("a PNG of the wrong size")
    return lines.reshape(height, width + 1)


def decode(pngs: list[bytes]) -> list[np.ndarray]:
    """The samples of 8-bit greyscale PNGs of one width."""
    return unfilter([filtered(x) for x in pngs]) if pngs else []


_SIDE, _LOW = 32, 8
_DCT = np.cos(np.pi / _SIDE * (np.arange(_SIDE) + 0.5)[None, :] * np.arange(_LOW)[:, None])


def cosine_hash(samples: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest cosine frequencies of the image, averaged to 32 x 32, exceed their median.

    The constant term takes part in the order but its bit is cleared.
    """
    rows = np.minimum(np.arange(_SIDE + 1) * len(samples) // _SIDE, len(samples))
    if len(samples) < _SIDE:
        small = samples[np.minimum(np.arange(_SIDE) * len(samples) // _SIDE, len(samples) - 1)].astype(np.float64)
    else:
        small = np.add.reduceat(samples, rows[:-1], axis=0, dtype=np.float64) / np.diff(rows)[:, None]
    small = small.reshape(_SIDE, _SIDE, -1).mean(axis=2)
    low = (_DCT @ small @ _DCT.T).reshape(-1).round(6)
    bits = low > np.median(low[1:])
    bits[0] = False
    return np.packbits(bits).tobytes()


def pad(raw: bytes, unit: int = WIDTH) -> bytes:
    return raw + bytes(-len(raw) % unit or (0 if raw else unit))


def _in_steps(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Neighbouring rows of together about STEP_BYTES, or one larger row."""
    lo = total = 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > STEP_BYTES:
            yield lo, i
            lo, total = i, 0
        total += n
    if sizes:
        yield lo, len(sizes)


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) for each row of docs(doc_id, text): the text's bytes as a PNG in a binary column.

    A null text is empty; the payload of an empty text is 64 zero bytes.  Rows are independent;
    other columns are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession, 500)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in b.column("text")]
            media = [encode(pad(x)) for x in raw]
            yield pa.record_batch([b.column("doc_id"), pa.array(list(map(len, raw)), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, n_bytes long, media binary")


def read_back(stored: DataFrame) -> DataFrame:
    """What the binary column of store()'s rows holds.

    Columns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature (hex of the cosine hash), and the binary columns media and hash.  A null media, or
    one that fails a checksum, ends the job with an error, as a fixity test should.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media", "hash"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            media = b.column("media").to_pylist()
            rows = []
            # what a row takes once it is decoded stands in its header, whatever its compressed length
            for lo, hi in _in_steps([int.from_bytes(x[16:20], "big") * int.from_bytes(x[20:24], "big") for x in media]):
                for png, samples in zip(media[lo:hi], decode(media[lo:hi]), strict=True):
                    back, feature = samples.tobytes(), cosine_hash(samples)
                    rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(png), hashlib.sha256(png).hexdigest(), feature.hex(), png, feature))
            yield pa.record_batch([b.column("doc_id"), b.column("n_bytes"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds[2:]))], names)

    kind = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary, hash binary"
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(lean(run), kind)
