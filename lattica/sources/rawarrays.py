"""Arrays of raw files: cells of one element type end to end, in a file or in the numbered part files of a folder.

A file is read in splits of whole records, so that one large file is many tasks.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.ndarray import NdArray
from lattica.plans.lineage import shared

#: Element types by name, and cells of a record at most.
TYPES = {"uint8": "u1", "int16": "<i2", "int32": "<i4", "int64": "<i8", "float32": "<f4", "float64": "<f8", "complex64": "<c8", "complex128": "<c16"}
RECORD_CELLS = 4096


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared(spark)}/raw-{uuid.uuid4().hex}"


def _index(a: NdArray):
    """A cell's place in its file: the first axis runs fastest."""
    place, step = F.lit(0).cast("bigint"), 1
    for c, d in zip(a.axes, a.dims, strict=True):
        place, step = place + F.col(c) * step, step * d
    return place


def write_array(a: NdArray, path: str, dtype: str = "float64") -> None:
    """The array's cells as records of (place, bytes) in Parquet; `file_array` reads them and raw files alike.

    A record holds the cells of RECORD_CELLS places in order.
    """
    kind = np.dtype(TYPES[dtype])
    place = _index(a)
    cells = a.df.select(F.floor(place / RECORD_CELLS).cast("bigint").alias("record"), (place % RECORD_CELLS).cast("int").alias("k"), F.col("v"))

    def pack(frame):
        import pandas as pd

        frame = frame.sort_values("k")
        return pd.DataFrame({"record": frame["record"].iloc[:1], "data": [frame["v"].to_numpy().astype(kind).tobytes()]})

    cells.groupBy("record").applyInPandas(pack, "record bigint, data binary").write.mode("overwrite").parquet(path)


def _cells(records: DataFrame, dtype: str, size: int) -> DataFrame:
    """(place, v) of records (record, data) of `size` cells each."""
    kind = np.dtype(TYPES[dtype])
    complex_ = kind.kind == "c"

    def unpack(batches):
        for b in batches:
            for r, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                a = np.frombuffer(data, kind)
                place = pa.array(r * size + np.arange(len(a), dtype=np.int64))
                if complex_:
                    yield pa.RecordBatch.from_arrays([place, pa.array(a.real.astype(float)), pa.array(a.imag.astype(float))], names=["place", "re", "im"])
                else:
                    yield pa.RecordBatch.from_arrays([place, pa.array(a.astype(float if kind.kind == "f" else np.int64))], names=["place", "v"])

    schema = "place bigint, re double, im double" if complex_ else f"place bigint, v {'double' if kind.kind == 'f' else 'bigint'}"
    found = records.select("record", "data").mapInArrow(unpack, schema)
    return found.select("place", F.struct("re", "im").alias("v")) if complex_ else found


def file_array(spark: SparkSession, path: str, dtype: str, dims: tuple[int, ...], offset: int = 0) -> NdArray:
    """The array of a raw file from a byte offset, which must be a whole number of cells, or of what `write_array` wrote.

    Complex cells are structs of re and im.  Cells past the end of the file are missing rows.
    """
    n, kind = math.prod(dims), np.dtype(TYPES[dtype])
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    status = file.getFileSystem(conf).getFileStatus(file)
    if status.isDirectory():
        if offset:
            raise ValueError("an offset is for raw files")
        cells = _cells(spark.read.parquet(path), dtype, RECORD_CELLS)
    else:
        if offset % kind.itemsize or status.getLen() % kind.itemsize:
            raise ValueError("a raw file and the offset must be whole cells")
        total, before = status.getLen() // kind.itemsize, offset // kind.itemsize
        size = next(s for s in range(min(RECORD_CELLS, max(1, total)), 0, -1) if total % s == 0)
        # Fixed-length records are a source that only the RDD interface has; their order is the file's.
        numbered = spark.sparkContext.binaryRecords(path, size * kind.itemsize).zipWithIndex()
        records = spark.createDataFrame(numbered.map(lambda r: (r[1], bytearray(r[0]))), "record bigint, data binary")
        cells = _cells(records, dtype, size).select((F.col("place") - before).alias("place"), "v")
    cells = cells.where((F.col("place") >= 0) & (F.col("place") < n))
    index, rest = [], F.col("place")
    for k, d in enumerate(dims):
        index.append(F.pmod(rest, F.lit(d)).cast("bigint").alias(f"i{k}"))
        rest = ((rest - F.pmod(rest, F.lit(d))) / d).cast("bigint")
    return NdArray(cells.select(*index, "v"), tuple(dims))


def _typed(dtype: str):
    def read(spark: SparkSession, path: str, dims: tuple[int, ...], offset: int = 0) -> NdArray:
        return file_array(spark, path, dtype, dims, offset)

    read.__doc__ = f"`file_array` of {dtype} cells."
    return read


bytfarr = uint8farr = _typed("uint8")
intfarr = int16farr = _typed("int16")
lonfarr = int32farr = _typed("int32")
int64farr, fltfarr, dblfarr, cfltfarr, cdblfarr = map(_typed, ("int64", "float32", "float64", "complex64", "complex128"))
