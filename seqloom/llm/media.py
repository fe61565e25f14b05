"""Media columns: Netpbm and BMP bytes to numpy arrays, area resizing by integral images, NPY tiles, difference hashes."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: An image row of a stored payload: 64 pixels of three 8-bit samples.
ROW_PIXELS, ROW_BYTES = 64, 192
TILE = 16
#: Rows that the horizontal step of a resize holds at once.
ROW_BLOCK = 4096


class MediaError(ValueError):
    """Bytes that are no complete Netpbm or BMP image of a kind that is read here."""


def _header(data: bytes, n: int) -> tuple[list[int], int]:
    """The first ``n`` numbers after the magic number, past comments, and where the samples begin."""
    numbers, at = [], 2
    while len(numbers) < n:
        while at < len(data) and (data[at : at + 1].isspace() or data[at] == 35):
            if data[at] == 35:
                at = data.find(b"\n", at)
                if at < 0:
                    raise MediaError("comment without end")
            at += 1
        end = at
        while end < len(data) and data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise MediaError("number missing in header")
        numbers.append(int(data[at:end]))
        at = end
    return numbers, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6: height x width, or height x width x 3, as uint8 (uint16 where the maximum exceeds 255). Bitmaps: 1 is 0, 0 is 255."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise MediaError("no Netpbm image")
    bitmap, bands = kind in (b"P1", b"P4"), 3 if kind in (b"P3", b"P6") else 1
    numbers, at = _header(data, 2 if bitmap else 3)
    width, height = numbers[:2]
    top = 1 if bitmap else numbers[2]
    if not 0 < top < 65536:
        raise MediaError("maximum out of range")
    n = width * height * bands
    if kind == b"P4":
        stride = -(-width // 8)
        raw = np.frombuffer(data, np.uint8, min(stride * height, max(0, len(data) - at)), at)
        if len(raw) < stride * height:
            raise MediaError("samples missing")
        samples = np.unpackbits(raw.reshape(height, stride), axis=1)[:, :width].reshape(-1)
    elif kind in (b"P5", b"P6"):
        kind_of = np.dtype(np.uint8 if top < 256 else ">u2")
        if len(data) - at < n * kind_of.itemsize:
            raise MediaError("samples missing")
        samples = np.frombuffer(data, kind_of, n, at)
    else:
        body = b"\n".join(line.split(b"#")[0] for line in data[at:].split(b"\n"))
        samples = np.array(list(body.replace(b" ", b"").replace(b"\n", b"").replace(b"\t", b"").replace(b"\r", b"")) if bitmap else body.split(), dtype=np.int64)
        samples = samples[:n] - (48 if bitmap else 0)
        if len(samples) < n:
            raise MediaError("samples missing")
    if bitmap:
        samples = (1 - samples.astype(np.uint8)) * np.uint8(255)
    samples = samples.astype(np.uint8 if top < 256 else np.uint16)
    return samples.reshape((height, width, 3) if bands == 3 else (height, width))


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits a pixel: height x width x 3 as uint8, top row first."""
    if data[:2] != b"BM" or len(data) < 54:
        raise MediaError("no BMP image")
    number = lambda at, size=4: int.from_bytes(data[at : at + size], "little", signed=size == 4)
    start, head, width, height, bits, packed = number(10), number(14), number(18), number(22), number(28, 2), number(30)
    if head < 40 or packed not in (0, 3) or bits not in (1, 4, 8, 24, 32) or width <= 0 or not height:
        raise MediaError("BMP of a kind that is not read")
    stride, rows = (width * bits + 31) // 32 * 4, abs(height)
    if start < 0 or len(data) - start < stride * rows:
        raise MediaError("pixels missing")
    raw = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)
    if bits >= 24:
        step = bits // 8
        image = raw[:, : width * step].reshape(rows, width, step)[:, :, 2::-1]
    else:
        used = number(46) or 1 << bits
        palette = np.frombuffer(data, np.uint8, 4 * used, 14 + head).reshape(used, 4)[:, 2::-1]
        if bits == 8:
            index = raw
        elif bits == 4:
            index = np.stack([raw >> 4, raw & 15], axis=2).reshape(rows, -1)
        else:
            index = np.unpackbits(raw, axis=1)
        index = index[:, :width]
        if index.max(initial=0) >= used:
            raise MediaError("colour outside the palette")
        image = palette[index]
    return np.ascontiguousarray(image if height < 0 else image[::-1])


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def _means(x: np.ndarray, n: int) -> np.ndarray:
    """Means of ``n`` equal stretches of the first axis, whose bounds may lie inside samples: differences of the integral."""
    total = np.zeros((len(x) + 1, *x.shape[1:]))
    np.cumsum(x, axis=0, out=total[1:])
    at = np.arange(n + 1) * (len(x) / n)
    low = np.minimum(at.astype(np.int64), len(x) - 1)
    part = (at - low).reshape(-1, *[1] * (x.ndim - 1))
    return np.diff(total[low] * (1 - part) + total[low + 1] * part, axis=0) * (n / len(x))


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Each output pixel is the mean over its area of the image, by integral images along both axes."""
    if not image.size:
        return np.zeros((height, width, *image.shape[2:]))
    across = [_means(np.moveaxis(image[a : a + ROW_BLOCK], 1, 0), width) for a in range(0, len(image), ROW_BLOCK)]
    return _means(np.moveaxis(np.concatenate(across, axis=1), 1, 0), height)


def difference_hash(image: np.ndarray) -> str:
    """128 bits: is each cell of a coarse grey image brighter than its right, then than its lower neighbour. 32 hex digits."""
    grey = image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])
    grey = np.round(area_resize(grey, 9, 9), 6)
    bits = np.concatenate([(grey[:8, :8] > grey[:8, 1:]).ravel(), (grey[:8, :8] > grey[1:, :8]).ravel()])
    return np.packbits(bits).tobytes().hex()


def npy_tile(image: np.ndarray, height: int = TILE, width: int = TILE) -> bytes:
    """The resized image as the bytes of an NPY file, in the image's own sample type."""
    out = io.BytesIO()
    np.save(out, np.round(area_resize(image, height, width)).astype(image.dtype), allow_pickle=False)
    return out.getvalue()


def to_ppm(payload: bytes) -> bytes:
    """A payload of whole rows as a binary Netpbm colour image."""
    return b"P6\n%d %d\n255\n" % (ROW_PIXELS, len(payload) // ROW_BYTES) + payload


def _store(batches):
    for part in C.chunks(batches):
        sizes, media = [], []
        for text in part.column(1).to_pylist():
            raw = (text or "").encode()
            sizes.append(len(raw))
            media.append(to_ppm(raw.ljust(max(1, -(-len(raw) // ROW_BYTES)) * ROW_BYTES, b" ")))
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def _features(batches):
    for part in C.chunks(batches, "media"):
        rows = []
        for data in part.column(2).to_pylist():
            try:
                image = decode(data or b"")
                rows.append((image.shape[1], image.shape[0], image.tobytes(), npy_tile(image), difference_hash(image)))
            except MediaError:
                rows.append((None,) * 5)
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string())
        yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x, k) for x, k in zip(zip(*rows), kinds))], names=["doc_id", "n_bytes", "media", "width", "height", "payload", "tile", "feature"])


def stored(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, padded with spaces to whole image rows, as a Netpbm image.

    A null text is an empty one; a null doc_id is kept; repeated rows give equal rows. Other columns may have any names.
    """
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_store, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """``media`` (doc_id, n_bytes, media) with width, height, payload (samples read back), tile (NPY) and feature.

    Bytes that are no image of a kind read here give nulls. An empty table gives an empty result.
    """
    kind = dict(media.dtypes)["doc_id"]
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_features, f"doc_id {kind}, n_bytes long, media binary, width long, height long, payload binary, tile binary, feature string")


def op3_media_columns(spark, sf_dir: str) -> DataFrame:
    read = features(stored(C.table(spark, sf_dir, "documents")))
    return read.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), "feature", F.sha2("tile", 256).alias("tile_sha256"),
    )
