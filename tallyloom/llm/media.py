"""Media columns: any payload as an 8-bit greyscale PNG in a binary column, read back
chunk by chunk with checksum tests, and a low-frequency cosine-transform hash of it.

Defined cases: a null text is an empty one; an empty text is one row of 64 zero
samples; a very long text is a taller image, made in a step of its own; equal texts give
equal PNGs and hashes, and of two filters that suit an image alike the first one is taken;
repeated rows stay repeated; an empty table gives an empty table. Columns of the input that aren't asked for don't matter,
whatever their names."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import held, joined

#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples in a row, and compressed bytes in one IDAT chunk.
WIDTH, IDAT_BYTES = 64, 1 << 16
#: The image is averaged to SIDE x SIDE; LOW x LOW of its cosine coefficients are hashed.
SIDE, LOW = 32, 8

_K = np.arange(LOW)[:, None] * (2 * np.arange(SIDE)[None, :] + 1) * (np.pi / (2 * SIDE))
DCT = np.cos(_K)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def _filtered(rows: np.ndarray, kind: int) -> np.ndarray:
    """Rows behind their filter byte: 0 as they are, 1 less the left sample, 2 less the one above."""
    out = np.empty((len(rows), rows.shape[1] + 1), np.uint8)
    out[:, 0] = kind
    out[:, 1:] = rows
    if kind == 1:
        out[:, 2:] -= rows[:, :-1]
    elif kind == 2:
        out[1:, 1:] -= rows[:-1]
    return out


def encode_png(payload: bytes, width: int = WIDTH, level: int = 3) -> bytes:
    """payload, a positive multiple of width long, as the samples of a greyscale PNG. The
    filter is the one that packs the first rows best, the first of 0, 2, 1 on a tie."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    head = rows[:24]
    kind = min((0, 2, 1), key=lambda k: len(zlib.compress(_filtered(head, k).tobytes(), 1)))
    packed = zlib.compress(_filtered(rows, kind).tobytes(), level)
    parts = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0))]
    parts += [_chunk(b"IDAT", packed[i : i + IDAT_BYTES]) for i in range(0, len(packed), IDAT_BYTES)]
    return b"".join([*parts, _chunk(b"IEND", b"")])


def _paeth(a: int, b: int, c: int) -> int:
    p = a + b - c
    da, db, dc = abs(p - a), abs(p - b), abs(p - c)
    return a if da <= db and da <= dc else b if db <= dc else c


def unfilter(kinds: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Undoes the row filters of 8-bit greyscale rows. Runs of rows with filter 0, 1 or 2
    are undone at once (sums modulo 256 along rows or down columns); 3 and 4, where each
    sample needs its left neighbour's result, sample by sample."""
    out = data.copy()
    n, width = data.shape
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for at, to in zip([0, *edges], [*edges, n], strict=True) if n else ():
        kind = int(kinds[at])
        above = out[at - 1] if at else np.zeros(width, np.uint8)
        if kind == 1:
            out[at:to] = np.cumsum(data[at:to], axis=1, dtype=np.uint8)
        elif kind == 2:
            out[at:to] = np.cumsum(np.vstack([above[None], data[at:to]]), axis=0, dtype=np.uint8)[1:]
        elif kind in (3, 4):
            for y in range(at, to):
                up = (out[y - 1] if y else np.zeros(width, np.uint8)).tolist()
                line, left, corner = data[y].tolist(), 0, 0
                for x in range(width):
                    guess = (left + up[x]) >> 1 if kind == 3 else _paeth(left, up[x], corner)
                    corner, left = up[x], (line[x] + guess) & 255
                    line[x] = left
                out[y] = line
        elif kind:
            raise ValueError(f"unknown row filter {kind}")
    return out


def decode_png(png: bytes) -> np.ndarray:
    """The rows of samples of an 8-bit greyscale PNG. Raises ValueError where the
    signature, a chunk's checksum, the packed stream or its size is wrong."""
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, size, packed, ended = 8, None, [], False
    while at < len(png) and not ended:
        if at + 12 > len(png):
            raise ValueError("a chunk is cut off")
        (n,) = struct.unpack_from(">I", png, at)
        kind, body = png[at + 4 : at + 8], png[at + 8 : at + 8 + n]
        if len(body) != n or at + 12 + n > len(png):
            raise ValueError("a chunk is cut off")
        if struct.unpack_from(">I", png, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"checksum of {kind!r} is wrong")
        if kind == b"IHDR":
            width, height, *rest = struct.unpack(">IIBBBBB", body)
            if rest != [8, 0, 0, 0, 0]:
                raise ValueError("not 8-bit greyscale without interlace")
            size = (height, width)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise ValueError(f"unknown critical chunk {kind!r}")
        at += 12 + n
    if size is None or not ended:
        raise ValueError("no header or no end")
    try:
        data = zlib.decompress(b"".join(packed))
    except zlib.error as e:
        raise ValueError(str(e)) from e
    if len(data) != size[0] * (size[1] + 1):
        raise ValueError("wrong number of samples")
    rows = np.frombuffer(data, np.uint8).reshape(size[0], size[1] + 1)
    return unfilter(rows[:, 0], rows[:, 1:])


def reduced(rows: np.ndarray) -> np.ndarray:
    """An image averaged to SIDE x SIDE; rows are repeated where there are fewer."""
    rows = rows.reshape(len(rows), SIDE, -1).mean(axis=2) if rows.shape[1] % SIDE == 0 else rows[:, np.arange(SIDE) * rows.shape[1] // SIDE].astype(float)
    n = len(rows)
    if n < SIDE:
        return rows[np.arange(SIDE) * n // SIDE]
    at = np.arange(SIDE) * n // SIDE
    return np.add.reduceat(rows, at, axis=0) / np.diff([*at, n])[:, None]


def cosine_hashes(images: np.ndarray) -> list[bytes]:
    """64 bits per SIDE x SIDE image: which low-frequency coefficients lie above their median; the mean (0, 0) counts as 0."""
    low = DCT @ images @ DCT.T
    low = np.round(low.reshape(len(images), -1), 6)
    low[:, 0] = 0
    bits = low > np.median(low, axis=1)[:, None]
    return [x.tobytes() for x in np.packbits(bits, axis=1)]


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in held(batch, "text"):
            raw, at = joined(part.column("text"))
            data, sizes, media, payloads, images = raw.tobytes(), [], [], [], []
            for i in range(part.num_rows):
                text = data[at[i] : at[i + 1]]
                sizes.append(len(text))
                media.append(encode_png(text + bytes(-len(text) % WIDTH if text else WIDTH)))
                rows = decode_png(media[-1])
                payloads.append(rows.tobytes())
                images.append(reduced(rows))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), pa.array(payloads, pa.binary()), pa.array(cosine_hashes(np.array(images)), pa.binary())],
                names=["doc_id", "n_bytes", "media", "payload", "dct_hash"],
            )


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (the PNG), payload (read back from it) and dct_hash of every
    text. One pass over the scan, no shuffle, about 1 MB of text in memory at a time."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_encoded, "doc_id long, n_bytes long, media binary, payload binary, dct_hash binary")


def digests(media: DataFrame) -> DataFrame:
    """What a reader needs to compare media columns without carrying them."""
    return media.select(
        "doc_id", "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.lower(F.hex("dct_hash")).alias("feature"),
    )
