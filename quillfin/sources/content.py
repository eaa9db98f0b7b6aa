"""Classifying and decoding file bytes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Leading bytes (hex) of the image formats that are indexed.
IMAGE_MAGIC = (
    "89504E470D0A1A0A",  # PNG
    "FFD8FF",  # JPEG
    "424D",  # BMP
    "49492A00",  # TIFF, little endian
    "4D4D002A",  # TIFF, big endian
    "474946383761",  # GIF87a
    "474946383961",  # GIF89a
)
PDF_MAGIC = "255044462D"  # %PDF-


def file_type(content: Column) -> Column:
    """text / pdf / image by content alone; null for empty, binary and unknown files."""
    head = F.hex(F.substring(content, 1, 16))
    image = F.lit(False)
    for magic in IMAGE_MAGIC:
        image = image | F.startswith(head, F.lit(magic))
    webp = F.startswith(head, F.lit("52494646")) & (F.substring(head, 17, 8) == "57454250")
    clean = F.is_valid_utf8(content.cast("string"))
    text = clean & ~F.contains(content, F.lit(b"\x00"))
    return (
        F.when(F.length(content) == 0, None)
        .when(F.startswith(head, F.lit(PDF_MAGIC)), "pdf")
        .when(image | webp, "image")
        .when(text, "text")
    )


@F.arrow_udf(T.StringType())
def decode_text(contents: pa.Array) -> pa.Array:
    """UTF-8 with replacement characters for bad bytes, and universal newlines."""
    out = []
    for value in contents:
        raw = value.as_py()
        if raw is None:
            out.append(None)
        else:
            out.append(raw.decode("utf-8", errors="replace").replace("\r\n", "\n").replace("\r", "\n"))
    return pa.array(out, pa.string())
