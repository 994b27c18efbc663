"""Files and text: listings, types by magic number, sizes, formatted and free-format reading, stores of named arrays, images."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.strings import sscanf
from lattica.ndarray import NdArray

# How files of a type begin, in hexadecimal.
MAGIC = {"array": "aaaa5555", "array_msb": "5555aaaa", "fits": "53494d504c45", "gif": "474946", "jpeg": "ffd8ff", "png": "89504e47", "tiff": "49492a00", "tiff_msb": "4d4d002a", "parquet": "50415231", "gzip": "1f8b", "pdf": "25504446"}


def listing(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = False) -> DataFrame:
    """(path, length, modificationTime) of the files of a directory, those whose path fits a regular expression."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "length", "modificationTime")
    return df.where(F.col("path").rlike(pattern)) if pattern else df


def directories(spark: SparkSession, path: str) -> DataFrame:
    return listing(spark, path, None, True).select(F.regexp_replace("path", "/[^/]*$", "").alias("path")).distinct()


def type_of(content: Column) -> Column:
    """Type by the first bytes, or "other"."""
    start = F.lower(F.hex(F.substring(content, 1, 8)))
    out = None
    for name, magic in MAGIC.items():
        out = F.when(start.startswith(magic), name) if out is None else out.when(start.startswith(magic), name)
    return out.otherwise("other")


def file_types(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", type_of(F.col("content")).alias("type"))


def read_format(spark: SparkSession, path: str, form: str) -> DataFrame:
    """Lines read by a format of %d, %f and %s parts: v0, v1, ...; nulls where a line does not fit."""
    return spark.read.text(path).select(sscanf(F.col("value"), form).alias("r")).select("r.*")


def read_numbers(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, place, v): all numbers of text files, in free format. Lines are numbered within a file's split."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line"), "value")
    words = lines.select("file", "line", F.posexplode(F.split(F.trim(F.translate("value", ",\t", "  ")), " +")).alias("place", "word"))
    return words.select("file", "line", "place", F.col("word").try_cast("double").alias("v")).where("v is not null")


def read_unformatted(spark: SparkSession, path: str, dtype: str, offset: int = 0, count: int | None = None) -> DataFrame:
    """(path, i, v): raw cells of an element type (numpy's name) from a byte offset."""
    import pandas as pd

    def cells(frames):
        for frame in frames:
            for p, c in zip(frame["path"], frame["content"], strict=True):
                size = np.dtype(dtype).itemsize
                n = (len(c) - offset) // size if count is None else count
                a = np.frombuffer(bytes(c), dtype, n, offset).astype(float)
                yield pd.DataFrame({"path": p, "i": np.arange(n), "v": a})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(cells, "path string, i bigint, v double")


def write_format(df: DataFrame, form: str, columns: list[str], path: str) -> None:
    """One line of C-format text for each row."""
    df.select(F.format_string(form, *columns).alias("value")).write.text(path)


def hex_dump(v: Column) -> Column:
    return F.lower(F.hex(v))


def store(arrays: dict[str, NdArray], path: str) -> None:
    """Named arrays as Parquet folders, and their dimensions in a manifest."""
    spark = next(iter(arrays.values())).df.sparkSession
    for name, a in arrays.items():
        a.df.write.parquet(f"{path}/{name}")
    rows = [(name, json.dumps(a.dims)) for name, a in arrays.items()]
    spark.createDataFrame(rows, "name string, dims string").coalesce(1).write.json(f"{path}/manifest")


def restore(spark: SparkSession, path: str) -> dict[str, NdArray]:
    """The arrays of `store`, read lazily."""
    return {r["name"]: NdArray(spark.read.parquet(f"{path}/{r['name']}"), tuple(json.loads(r["dims"]))) for r in spark.read.json(f"{path}/manifest").collect()}


def images(spark: SparkSession, path: str) -> DataFrame:
    """(origin, height, width, nChannels, mode, data) of pictures that the JVM reads (jpeg, png, gif, bmp)."""
    return spark.read.format("image").load(path).select("image.*")


def pack_pnm(a: np.ndarray) -> bytes:
    """A grey or colour (last axis 3) byte image as a portable any map."""
    colour = a.ndim == 3
    return f"P{6 if colour else 5}\n{a.shape[1]} {a.shape[0]}\n255\n".encode() + np.ascontiguousarray(a, np.uint8).tobytes()


def unpack_pnm(content: bytes) -> np.ndarray:
    kind, width, height, _, data = _pnm_head(content)
    shape = (height, width, 3) if kind == b"P6" else (height, width)
    return np.frombuffer(data, np.uint8, int(np.prod(shape))).reshape(shape)


def _pnm_head(content: bytes):
    kind, size, top, data = content.split(b"\n", 3)
    width, height = map(int, size.split())
    return kind, width, height, top, data
