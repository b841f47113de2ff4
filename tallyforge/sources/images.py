"""Image files: dimensions from their first bytes, without decoding, and which uploads are accepted."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def _number(content: Column, at: int, size: int) -> Column:
    return F.conv(F.hex(F.substring(content, at, size)), 16, 10).cast("long")


def png_size(content: Column) -> Column:
    """struct<width, height> of a PNG's header, else NULL."""
    ok = (F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A") & (F.hex(F.substring(content, 13, 4)) == "49484452")
    return F.when(ok, F.struct(_number(content, 17, 4).alias("width"), _number(content, 21, 4).alias("height")))


#: Markers that stand alone: a restart, the start and the end of an image, and a private one. Frame headers are C0 to CF but for three tables among them.
_ALONE = {0x01, 0xD8, 0xD9, *range(0xD0, 0xD8)}
_FRAMES = set(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}


def _frame(data: bytes) -> tuple[int, int] | None:
    """(width, height) of the first frame header, found by going from segment to segment by their lengths, so what is inside a segment (a thumbnail) isn't looked at."""
    at, end = 2, len(data)
    while at + 9 <= end and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF:  # a fill byte
            at += 1
        elif marker in _ALONE:
            at += 2
        elif marker in _FRAMES:
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        else:
            at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None


@F.pandas_udf(StructType([StructField("width", LongType()), StructField("height", LongType())]))
def _jpeg_size(content: pd.Series) -> pd.DataFrame:
    sizes = [_frame(c) if c is not None and c[:2] == b"\xff\xd8" else None for c in content]
    return pd.DataFrame([s or (None, None) for s in sizes], columns=["width", "height"], dtype="Int64")


def jpeg_size(content: Column) -> Column:
    """struct<width, height> of a JPEG of any kind (grey, colour, four inks; baseline, progressive), its fields NULL if there is no frame header."""
    return _jpeg_size(content)


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, width, height, rejected) of each file: wrong suffixes and unreadable sizes are rejected with their reason."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    x = f.select("path", "length", png_size(F.col("content")).alias("png"), jpeg_size(F.col("content")).alias("jpeg")).select("path", "length", F.coalesce("png", "jpeg").alias("s"))
    why = F.when(~F.lower("path").rlike(r"\.(?:png|jpe?g)$"), "suffix").when(F.coalesce(F.col("s.width") * F.col("s.height"), F.lit(0)) == 0, "unreadable")
    return x.select("path", "length", F.col("s.width").alias("width"), F.col("s.height").alias("height"), why.alias("rejected"))
