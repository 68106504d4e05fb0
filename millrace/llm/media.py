"""Operator 1: texts as lossless WebP images.

Every text's UTF-8 bytes, padded with spaces to a positive multiple of 192, become the RGBA rows of
48-pixel-wide lossless WebP images of at most 32 rows, one after another in the stored form; the stored bytes are decoded again and all digests
come from the decoded pixels. Predictors, cross-colour multipliers, palettes, back-references, cache hits and prefix codes are
chosen from each image's own pixels (``webp_batch``). Row-local, no shuffle; images of some megabytes of texts are coded in step.
Null and empty texts are one row of spaces. Equal texts are equal images, whatever else is in the batch.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame

from . import webp_batch
from .common import slices, table, text_buffers, tidy

UNIT = 192
#: Text that is coded in step.
SLICE_BYTES, SLICE_DOCS = 4 << 20, 8000


def pad(text: bytes) -> bytes:
    return text + b" " * (-len(text) % UNIT if text else UNIT)


def features(images: list[np.ndarray]) -> str:
    """Per-channel means and an 8 x 8 average hash of the decoded pixels, as text."""
    rows = np.concatenate(images) if len(images) > 1 else images[0]
    means = rows.reshape(-1, 4).mean(axis=0)
    light = rows.sum(axis=2, dtype=np.int64)
    at = np.minimum(np.arange(9) * len(light) // 8, len(light) - 1)[:8]
    bands = np.add.reduceat(light, at, axis=0) / np.diff(np.append(at, len(light)))[:, None].clip(1)
    cells = bands.reshape(8, 8, -1).mean(axis=2)
    bits = np.packbits(cells > cells.mean()).tobytes().hex()
    return ",".join(f"{m:.4f}" for m in means) + ";" + bits


def round_trips(texts: list[bytes]) -> list[tuple]:
    """(n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, media) of each text."""
    media = webp_batch.store([pad(t) for t in texts])
    out = []
    for text, file, images in zip(texts, media, webp_batch.images(media), strict=True):
        back = b"".join(x.tobytes() for x in images)
        out.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(file), hashlib.sha256(file).hexdigest(), features(images), file))
    return out


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """One row per input row: digests of the payload read back from the stored WebP; with keep_media the file too."""
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * keep_media

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()][: 7 + keep_media]
        names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *["media"] * keep_media]
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j in slices(offsets, SLICE_BYTES, SLICE_DOCS):
                texts = [data[offsets[k] : offsets[k + 1]].tobytes() for k in range(i, j)]
                single = list(dict.fromkeys(texts))  # repeated texts of a slice are coded once
                done = dict(zip(single, round_trips(single), strict=True))
                cols = list(zip(*(done[t] for t in texts), strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=False))], names=names)

    return docs.select(id_col, text_col).mapInArrow(tidy(run), schema)


def op1_media_webp(spark, sf_dir: str) -> DataFrame:
    return media_column(table(spark, sf_dir, "documents"))
