"""Media columns: lossless WebP files in binary columns, written from bytes or pixels and decoded to pixel arrays.

A payload is stored as grey samples, one byte a pixel, in images of ROW pixels a line. Images of more than MAX_ROWS
lines are followed by another file, so a text of any length fits and the codec's memory stays bounded.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm import webp
from loomspark.llm.common import free, ready, text_buffers

ROW, MAX_ROWS = 576, 1024
FILL = 255
#: Bytes of stored media that a worker remembers by content so that copies are not coded again; only saves work.
MEMO_BYTES = 32 << 20
#: Rows leave in Arrow batches of about this size.
OUT_BYTES = 8 << 20


def padded(raw: bytes) -> bytes:
    """raw with FILL appended up to a positive multiple of ROW."""
    return raw + bytes([FILL]) * (max(1, -(-len(raw) // ROW)) * ROW - len(raw))


def store(payload: bytes) -> bytes:
    """The payload, a multiple of ROW bytes, as grey lossless WebP files."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, ROW).astype(np.uint32)
    grey = samples * np.uint32(0x010101) | np.uint32(0xFF000000)
    return b"".join(webp.encode(grey[i : i + MAX_ROWS]) for i in range(0, len(grey), MAX_ROWS))


def pixels_of(media: bytes) -> np.ndarray:
    """ARGB words of all images of a stored form, one under the other; their widths must agree."""
    parts = [webp.decode(x) for x in webp.split_files(media)]
    if not parts or len({p.shape[1] for p in parts}) != 1:
        raise webp.BadImage("no image, or images of different widths")
    return np.concatenate(parts) if len(parts) > 1 else parts[0]


def feature(pixels: np.ndarray) -> str:
    """height x width, mean luma, and 64 bits: which cells of an 8 x 8 grid are lighter than the mean."""
    c = np.ascontiguousarray(pixels).view(np.uint8).reshape(*pixels.shape, 4)
    rows, cols = (np.arange(8) * pixels.shape[0] // 8), (np.arange(8) * pixels.shape[1] // 8)
    if not ((pixels ^ pixels >> np.uint32(8)) & np.uint32(0xFFFF)).any():
        luma = c[..., 1].astype(np.int64) * 256
    else:
        luma = 77 * c[..., 2].astype(np.int64) + 150 * c[..., 1] + 29 * c[..., 0]
    lines = np.add.reduceat(luma, np.unique(cols), axis=1)
    cells = np.add.reduceat(lines, np.unique(rows), axis=0)
    size = np.diff(np.append(np.unique(rows), pixels.shape[0]))[:, None] * np.diff(np.append(np.unique(cols), pixels.shape[1]))
    mean = int(luma.sum()) // luma.size
    light = (cells // size > mean)[np.searchsorted(np.unique(rows), rows, side="right") - 1][:, np.searchsorted(np.unique(cols), cols, side="right") - 1]
    return f"{pixels.shape[0]}x{pixels.shape[1]}:{mean >> 8}:{np.packbits(light).tobytes().hex()}"


class _Memo(dict):
    size = 0

    def keep(self, key, value, weight: int):
        if self.size > MEMO_BYTES:
            self.clear()
            self.size = 0
        self[key] = value
        self.size += weight
        return value


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    total, i = np.cumsum(sizes), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + OUT_BYTES, side="right")))
        yield i, j
        i = j


def store_texts(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """docs without `text`, plus n_bytes (long) and `media` (binary): each whole text, padded, as lossless WebP.

    Null texts are empty, which is one line of fill. Columns named like the added ones are replaced, all others come back
    as they are; repeated rows each return a row; an empty table gives an empty result. A text is held whole, and of its
    pixels MAX_ROWS lines at a time."""
    ready(docs.sparkSession)
    keep = [c for c in docs.columns if c not in (text, "n_bytes", media)]
    raw_text = free([*keep, "n_bytes", media], "text")[0]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(raw_text))
    schema = rows.drop(raw_text).withColumns({"n_bytes": F.lit(0).cast("long"), media: F.lit(b"")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo()
        for b in batches:
            data, off, _ = text_buffers(b.column(raw_text))
            for i, j in _slices(np.diff(off)):
                out = []
                for p, q in zip(off[i:j].tolist(), off[i + 1 : j + 1].tolist()):
                    raw = data[p:q].tobytes()
                    key = hashlib.sha256(raw).digest()
                    out.append(memo.get(key) or memo.keep(key, x := store(padded(raw)), len(x)))
                cols = [c.slice(i, j - i) for c in b.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.diff(off[i : j + 1])), pa.array(out, pa.binary())], schema.names)

    return rows.mapInArrow(run, schema)


def _read(media: DataFrame, column: str, added: str, work) -> DataFrame:
    names = [x.split()[0] for x in added.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in added.split(", ")]
    keep = [c for c in media.columns if c != column and c not in names]
    stored = free([*keep, *names], "media")[0]
    rows = media.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{column}`").alias(stored))
    schema = rows.drop(stored).schema
    whole = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields), added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo()
        for b in batches:
            data, off, valid = text_buffers(b.column(stored))
            for i, j in _slices(np.diff(off) * 4):
                out = []
                for k in range(i, j):
                    raw = data[off[k] : off[k + 1]].tobytes() if valid[k] else None
                    key = raw if raw is None else hashlib.sha256(raw).digest()
                    out.append(memo.get(key) or memo.keep(key, x := work(raw), sum(len(v) for v in x if isinstance(v, bytes)) + 200))
                yield pa.RecordBatch.from_arrays([*[c.slice(i, j - i) for c in b.columns[:-1]], *[pa.array(v, t) for v, t in zip(zip(*out), types)]], [*schema.names, *names])

    return rows.mapInArrow(run, whole)


def decode_images(media: DataFrame, column: str = "media") -> DataFrame:
    """media without `column`, plus width, height (int), pixels (binary: R, G, B, A bytes by rows), error (string).

    Where the bytes are null or no lossless WebP, width, height and pixels are null and error says why. Columns named
    like the added ones are replaced."""

    def work(raw: bytes | None) -> tuple:
        try:
            if raw is None:
                raise webp.BadImage("null")
            p = pixels_of(raw)
        except webp.BadImage as e:
            return None, None, None, str(e)
        c = np.ascontiguousarray(p).view(np.uint8).reshape(*p.shape, 4)
        return p.shape[1], p.shape[0], c[..., [2, 1, 0, 3]].tobytes(), None

    ready(media.sparkSession)
    return _read(media, column, "width int, height int, pixels binary, error string", work)


def read_digests(media: DataFrame, column: str = "media") -> DataFrame:
    """media without `column`, plus payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    The payload is read back from the stored bytes: the grey samples of the decoded pixels."""

    def work(raw: bytes | None) -> tuple:
        if raw is None:
            return (None,) * 6
        p = pixels_of(raw)
        payload = np.ascontiguousarray(p).view(np.uint8)[..., 1::4].tobytes()
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(p)

    ready(media.sparkSession)
    return _read(media, column, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", work)
