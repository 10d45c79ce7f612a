"""Media columns: bytes as PNG images in binary columns, with a cosine-transform hash.

encode() writes an 8-bit greyscale PNG (signature, IHDR, IDAT, IEND; a CRC-32 for each
chunk); decode() tests signature and checksums, inflates the IDAT chunks and undoes the
scan-line filters with numpy; feature() is a 64-bit hash of low-frequency cosine terms.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from prosegauge.llm.common import map_batches

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 192
FILTERS = {"none": 0, "sub": 1, "up": 2, "average": 3, "paeth": 4}
#: Side of the reduced image and of the block of cosine terms that make the hash.
REDUCED, KEPT = 32, 8


class BadImage(ValueError):
    """The bytes aren't an image that encode() writes, or were damaged."""


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    a, b, c = (x.astype(np.int16) for x in (a, b, c))
    pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
    return np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c)).astype(np.uint8)


def _filtered(rows: np.ndarray, kind: int) -> np.ndarray:
    """All scan lines under one filter kind; the four neighbours come from shifted copies."""
    left, up, corner = (np.zeros_like(rows) for _ in range(3))
    left[:, 1:], up[1:], corner[1:, 1:] = rows[:, :-1], rows[:-1], rows[:-1, :-1]
    if kind == 0:
        return rows
    if kind == 3:
        return rows - ((left.astype(np.uint16) + up) >> 1).astype(np.uint8)
    return rows - {1: lambda: left, 2: lambda: up, 4: lambda: _paeth(left, up, corner)}[kind]()


def encode(payload: bytes, width: int = WIDTH, filter_kind: str = "sub", level: int = 1, idat_bytes: int = 1 << 16) -> bytes:
    """The payload, a positive multiple of width, as a PNG of 8-bit grey samples.

    filter_kind names one filter for all lines, or "adaptive": for each line the filter
    whose signed differences sum to the least.
    """
    if not payload or len(payload) % width:
        raise BadImage("payload must be a positive multiple of the width")
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    lines = np.empty((len(rows), width + 1), np.uint8)
    if filter_kind == "adaptive":
        tried = np.stack([_filtered(rows, k) for k in range(5)])
        best = abs(tried.view(np.int8).astype(np.int16)).sum(axis=2).argmin(axis=0)
        lines[:, 0], lines[:, 1:] = best, tried[best, np.arange(len(rows))]
    else:
        lines[:, 0], lines[:, 1:] = FILTERS[filter_kind], _filtered(rows, FILTERS[filter_kind])
    packed = zlib.compress(lines.tobytes(), level)
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    body = b"".join(_chunk(b"IDAT", packed[i : i + idat_bytes]) for i in range(0, len(packed), idat_bytes))
    return SIGNATURE + _chunk(b"IHDR", head) + body + _chunk(b"IEND", b"")


def _by_diagonals(block: np.ndarray, paeth: np.ndarray, above: np.ndarray) -> None:
    """Undo Paeth or average lines in place; the samples of a diagonal depend on earlier diagonals only."""
    n, width = block.shape
    done = np.zeros((n + 1, width + 1), np.int16)
    done[0, 1:] = above
    for d in range(n + width - 1):
        r = np.arange(max(0, d - width + 1), min(n, d + 1))
        j = d - r
        left, up, corner = done[r + 1, j], done[r, j + 1], done[r, j]
        guess = np.where(paeth[r], _paeth(left, up, corner), (left + up) >> 1)
        done[r + 1, j + 1] = (block[r, j] + guess) & 255
    block[:] = done[1:, 1:]


def _unfiltered(lines: np.ndarray) -> np.ndarray:
    """Undo the filters, a block of lines with one kind at a time.

    None, sub and up are cumulative sums modulo 256 over a block. Average and Paeth need the
    finished neighbours left and above: their lines are undone along the diagonals.
    """
    kinds, rows = lines[:, 0], lines[:, 1:].copy()
    if len(kinds) and kinds.max() > 4:
        raise BadImage("unknown filter")
    cuts = [0, *(np.flatnonzero(np.diff(np.minimum(kinds, 3))) + 1).tolist(), len(kinds)]
    above = np.zeros(rows.shape[1], np.uint8)
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        kind, block = int(kinds[lo]) if hi > lo else 0, rows[lo:hi]
        if kind == 1:
            np.cumsum(block, axis=1, dtype=np.uint8, out=block)
        elif kind == 2:
            block[0] += above
            np.cumsum(block, axis=0, dtype=np.uint8, out=block)
        elif kind >= 3:
            _by_diagonals(block, kinds[lo:hi] == 4, above)
        if hi > lo:
            above = rows[hi - 1]
    return rows


def decode(data: bytes) -> np.ndarray:
    """Samples (height, width) of a PNG that encode() wrote; BadImage if it is damaged."""
    if data[:8] != SIGNATURE:
        raise BadImage("no PNG signature")
    at, packed, size, ended = 8, [], None, False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise BadImage("cut off")
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(body) != n or at + 12 + n > len(data):
            raise BadImage("cut off")
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise BadImage(f"checksum of {kind!r}")
        if kind == b"IHDR":
            if n != 13:
                raise BadImage("header of another length")
            size = struct.unpack(">IIBBBBB", body)
            if not size[0] or not size[1]:
                raise BadImage("no samples")
            if size[2:] != (8, 0, 0, 0, 0):
                raise BadImage("not 8-bit grey without interlace")
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if not ended or size is None:
        raise BadImage("cut off")
    expected = size[1] * (size[0] + 1)
    try:
        # one byte more than the header promises shows that there are too many
        raw = zlib.decompressobj().decompress(b"".join(packed), expected + 1)
    except zlib.error as e:
        raise BadImage(str(e)) from e
    if len(raw) != expected:
        raise BadImage("wrong number of samples")
    return _unfiltered(np.frombuffer(raw, np.uint8).reshape(size[1], size[0] + 1))


def _cosines(n: int, kept: int) -> np.ndarray:
    k, x = np.arange(kept)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * (2 * x + 1) * k / (2 * n)) * np.where(k, np.sqrt(2 / n), np.sqrt(1 / n))


_BASIS = _cosines(REDUCED, KEPT)


def _reduced(samples: np.ndarray, axis: int) -> np.ndarray:
    """Means over REDUCED nearly equal stretches; stretches repeat lines of smaller images."""
    n = samples.shape[axis]
    lo = np.arange(REDUCED) * n // REDUCED
    hi = np.maximum(lo + 1, (np.arange(REDUCED) + 1) * n // REDUCED)
    sums = np.concatenate([np.zeros_like(samples.take([0], axis)), samples.cumsum(axis)], axis)
    width = (hi - lo).reshape([-1 if i == axis else 1 for i in range(2)])
    return (sums.take(hi, axis) - sums.take(lo, axis)) / width


def feature(samples: np.ndarray) -> str:
    """16 hex digits: which of the 8 x 8 lowest cosine terms lie above their median (the constant term apart)."""
    across = samples.astype(np.int32).reshape(len(samples), -1)
    small = _reduced(_reduced(across, 1), 0)
    terms = (_BASIS @ small @ _BASIS.T).round(6).ravel()
    bits = terms > np.median(terms[1:])
    return np.packbits(bits).tobytes().hex()


def padded(text: str | None, width: int = WIDTH) -> tuple[int, bytes]:
    """UTF-8 bytes of the text (null: empty), filled with blanks to a positive multiple of width."""
    raw = (text or "").encode("utf-8")
    return len(raw), raw.ljust(max(1, -(-len(raw) // width)) * width, b" ")


def to_media(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", filter_kind: str = "sub") -> DataFrame:
    """(id, n_bytes, media): each text as a PNG in a binary column.

    Null and empty texts become one line of blanks; repeated rows and null ids stay; other
    columns go. An empty table gives no rows.
    """

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            both = [padded(x) for x in batch.column(1).to_pylist()]
            return {
                id_column: batch.column(0),
                "n_bytes": pa.array([n for n, _ in both], pa.int64()),
                "media": pa.array([encode(p, filter_kind=filter_kind) for _, p in both], pa.binary()),
            }

        return work

    kind = docs.schema[id_column].dataType.simpleString()
    return map_batches(docs.select(id_column, text_column), make, f"{id_column} {kind}, n_bytes long, media binary")


def features(media: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Read the stored images back: digests of payload and image, and the hash.

    A damaged image gives ok = false and nulls, not a failed job. Columns besides id, n_bytes
    and media go.
    """

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (False,) + (None,) * 6
        try:
            samples = decode(data)
        except BadImage:
            return False, None, None, None, len(data), hashlib.sha256(data).hexdigest(), None
        payload = samples.tobytes()
        return (True, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(samples))

    kinds = [pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["ok", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            found = [one(x) for x in batch.column(2).to_pylist()]
            out = {n: pa.array([r[i] for r in found], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))}
            return {id_column: batch.column(0), "n_bytes": batch.column(1)} | out

        return work

    kind = media.schema[id_column].dataType.simpleString()
    return map_batches(
        media.select(id_column, "n_bytes", "media"),
        make,
        f"{id_column} {kind}, n_bytes long, ok boolean, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )
