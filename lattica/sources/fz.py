"""Array files: a 512-byte head, text blocks and the cells, plain or difference-coded.

Files are read through Spark's binary source, so any store that Spark reads will do.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.ndarray import NdArray

# Fixed values of the file format.
SYNCH = 0x5555AAAA
DTYPES = ("u1", "i2", "i4", "f4", "f8", "i8")


def pack(a: np.ndarray, text: str = "", compressed: bool = False) -> bytes:
    """The bytes of a file for an array; the first axis runs fastest."""
    kind = np.dtype(a.dtype).str[1:]
    if kind not in DTYPES:
        raise ValueError(f"element type {a.dtype}")
    raw = text.encode()
    blocks = 1 if len(raw) < 256 else 1 + -(-len(raw) // 512)
    flat = a.ravel(order="F").astype("<" + kind)
    data = crunch(flat) if compressed else flat.tobytes()
    head = bytearray(512)
    struct.pack_into("<IBBBBB", head, 0, SYNCH, int(compressed), 0, blocks, DTYPES.index(kind), a.ndim)
    struct.pack_into("<I", head, 10, len(data) if compressed else 0)
    struct.pack_into(f"<{a.ndim}i", head, 192, *a.shape)
    if blocks == 1:
        head[256 : 256 + len(raw)] = raw
        return bytes(head) + data
    return bytes(head) + raw.ljust(512 * (blocks - 1), b"\0") + data


def header(content: bytes) -> tuple[str, str, tuple[int, ...], int, bool]:
    """(text, element type with byte order, dimensions, offset of the cells, whether they are coded)."""
    order = "<" if struct.unpack_from("<I", content)[0] == SYNCH else ">"
    if struct.unpack_from(order + "I", content)[0] != SYNCH:
        raise ValueError("not an array file")
    flags, _, blocks, kind, ndim = struct.unpack_from("BBBBB", content, 4)
    dims = struct.unpack_from(f"{order}{ndim}i", content, 192)
    text = content[256:512] if blocks == 1 else content[512 : 512 * blocks]
    return text.split(b"\0")[0].decode(errors="replace"), order + DTYPES[kind], dims, 512 * blocks, bool(flags & 1)


def unpack(content: bytes) -> tuple[np.ndarray, str]:
    """The array of a file's bytes, and its text."""
    text, kind, dims, at, coded = header(content)
    n = int(np.prod(dims))
    flat = decrunch(content[at:]) if coded else np.frombuffer(content, kind, n, at)
    return flat.reshape(dims, order="F"), text


def crunch(a: np.ndarray) -> bytes:
    """Lossless difference coding of whole numbers: per block of 64 differences, a width and packed bits."""
    if a.dtype.kind not in "iu":
        raise ValueError("only whole numbers are coded")
    x = a.ravel(order="F").astype(np.int64)
    d = np.diff(x, prepend=0)
    z = ((d << 1) ^ (d >> 63)).astype(np.uint64)  # sign in the lowest bit
    out = [np.dtype(a.dtype).str.encode().ljust(4), struct.pack("<Q", len(x))]
    for k in range(0, len(z), 64):
        block = z[k : k + 64]
        width = int(block.max()).bit_length()
        bits = ((block[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        out.append(bytes([width]) + np.packbits(bits.ravel(), bitorder="little").tobytes())
    return b"".join(out)


def decrunch(data: bytes) -> np.ndarray:
    kind, n = data[:4].strip().decode(), struct.unpack_from("<Q", data, 4)[0]
    z, at = np.zeros(n, np.uint64), 12
    for k in range(0, n, 64):
        size, width = min(64, n - k), data[at]
        nbytes = (size * width + 7) // 8
        if width:
            bits = np.unpackbits(np.frombuffer(data, np.uint8, nbytes, at + 1), bitorder="little")[: size * width].reshape(size, width)
            z[k : k + size] = (bits.astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        at += 1 + nbytes
    d = (z >> np.uint64(1)).astype(np.int64) ^ -(z & np.uint64(1)).astype(np.int64)
    return np.cumsum(d).astype(kind)


def run_lengths(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, lengths) of the runs of equal cells."""
    if not len(a):
        return a, np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    return a[start], np.diff(np.append(start, len(a)))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, i (cell number), v) of all array files under a path; cells are doubles. A file is one task's."""

    def cells(files):
        for frame in files:
            for p, content in zip(frame["path"], frame["content"], strict=True):
                a, text = unpack(bytes(content))
                flat = a.ravel(order="F").astype(float)
                for k in range(0, len(flat), 1 << 20):
                    part = flat[k : k + (1 << 20)]
                    yield pd.DataFrame({"path": p, "text": text, "i": np.arange(k, k + len(part)), "v": part})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(cells, "path string, text string, i bigint, v double")


def heads(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, dtype, dims) of all array files under a path."""

    def run(files):
        for frame in files:
            rows = [header(bytes(c)) for c in frame["content"]]
            yield pd.DataFrame({"path": frame["path"], "text": [r[0] for r in rows], "dtype": [r[1] for r in rows], "dims": [list(r[2]) for r in rows]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string, dtype string, dims array<int>")


def load(spark: SparkSession, path: str) -> NdArray:
    """One array file as an array."""
    dims = tuple(heads(spark, path).first()["dims"])
    cols, rest = [], F.col("i")
    for k, d in enumerate(dims):
        cols.append((rest % d).cast("bigint").alias(f"i{k}"))
        rest = F.floor(rest / d)
    return NdArray(read(spark, path).select(*cols, "v"), dims)
