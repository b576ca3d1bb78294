"""Media columns (operator 3): texts' bytes as progressive JPEG images, read back with full-resolution RGB tensors.

A text's UTF-8 bytes, filled up with bytes 255 to a positive multiple of 576, become the quantised coefficients of an image
(the format's unit): each byte b is the coefficient 256 + b, so storage is lossless. jpeg.py reads the stored bytes back,
scan by scan, into coefficient arrays, which give both the payload and the RGB tensor.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jpeg
from .common import offsets_and_bytes, sliced, table

UNIT, FILL = 576, 255
BATCH_BYTES = 4 << 20
FACTS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, height int, width int, feature string"


def store(raw: bytes) -> bytes:
    """The image of some bytes; their number is in the comment."""
    payload = np.full(max(UNIT, -(-len(raw) // UNIT) * UNIT), FILL, np.uint8)
    payload[: len(raw)] = np.frombuffer(raw, np.uint8)
    return jpeg.encode(jpeg.to_coefficients(payload), b"%d %d" % (len(raw), len(payload)))


def read(media: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """(bytes without the filling, payload, RGB tensor)."""
    image = jpeg.Decoder(media)
    n, total = map(int, image.comment.split())
    return n, jpeg.from_coefficients(image, total), image.rgb()


def feature(rgb: np.ndarray) -> str:
    """Size, mean of each colour, and checksum of a tensor."""
    total = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64)
    return f"{rgb.shape[0]}x{rgb.shape[1]}:" + ",".join(f"{int(x) / (rgb.shape[0] * rgb.shape[1]):.4f}" for x in total) + f":{zlib.crc32(np.ascontiguousarray(rgb)):08x}"


def media_column(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("media", "rgb")) -> DataFrame:
    """The other columns of df, then what FACTS names; keep adds the stored image (media) and the tensor's bytes (rgb, height x
    width x 3). Columns of df with these names give way.

    A null or empty text is one unit of filling; texts are independent, so repeated rows give equal results; an empty table
    gives an empty one. An image holds up to 65,535 x 65,535 pixels, more than a string can."""
    names = [x.split()[0] for x in FACTS.split(", ")] + ["media", "rgb"]
    rest = [c for c in df.columns if c not in (*names, text)]
    src = df.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest") if rest else F.lit(0).alias("rest"), F.col(text).cast("string").alias("text"))
    schema = f"rest {src.schema['rest'].dataType.simpleString()}, {FACTS}" + "".join(f", {c} binary" for c in keep)

    def run(batches):
        for b in sliced(batches, BATCH_BYTES):
            offs, data = offsets_and_bytes(b.column(1))
            raw, rows = data.tobytes(), []
            for i in range(b.num_rows):
                media = store(raw[offs[i] : offs[i + 1]])
                n, payload, rgb = read(media)
                p = payload.tobytes()
                facts = [n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(media), hashlib.sha256(media).hexdigest(), rgb.shape[0], rgb.shape[1], feature(rgb)]
                rows.append([*facts, *({"media": media, "rgb": rgb.tobytes()}[c] for c in keep)])
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), *[pa.binary()] * len(keep)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=["rest", *names[:9], *keep])

    out = src.mapInArrow(run, schema)
    return out.select(*[F.col("rest").getField(c).alias(c) for c in rest], *names[:9], *keep)


def op3_media(spark, sf_dir: str) -> DataFrame:
    return media_column(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=()).drop("height", "width")
