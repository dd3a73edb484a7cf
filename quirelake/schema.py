"""Types of pages and regions, and the domain's fixed names."""

from __future__ import annotations

from pyspark.sql import types as T

# Region types, in the order of detector class numbers.
REGION_TYPES = ("handwritten", "printed", "formula", "table", "annotation", "image", "graph")
NON_SCORABLE = ("image", "graph")
NATURAL = ("handwritten", "printed", "annotation")
MARKUP = ("formula", "table")
SCORABLE = ("handwritten", "printed", "formula", "table", "annotation")

REGION = T.StructType(
    [
        T.StructField("bbox", T.ArrayType(T.DoubleType())),
        T.StructField("type", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("legibility", T.StringType()),
        T.StructField("conf", T.DoubleType()),
    ]
)
REGIONS = T.ArrayType(REGION)
PAGE = T.StructType(
    [
        *[T.StructField(c, T.StringType()) for c in ("image", "file_name", "filename", "id", "source")],
        T.StructField("image_width", T.IntegerType()),
        T.StructField("image_height", T.IntegerType()),
        *[T.StructField(c, REGIONS) for c in ("regions", "annotations", "labels")],
    ]
)
