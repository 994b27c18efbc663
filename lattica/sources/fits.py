"""FITS images: headers, keys, image and extension data."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# Element types by BITPIX.
BITPIX = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}


def cards(content: bytes, at: int = 0) -> tuple[dict[str, object], int]:
    """Keys and values of the header at an offset, and where its data begin."""
    out: dict[str, object] = {}
    while True:
        card = content[at : at + 80].decode("ascii", "replace")
        at += 80
        if card[:8].strip() == "END" or len(card) < 80:
            return out, -(-at // 2880) * 2880
        if card[8:10] == "= ":
            m = re.match(r"\s*('(?:[^']|'')*'|[^/]*)", card[10:])
            raw = m[1].strip()
            if raw.startswith("'"):
                value: object = raw[1:-1].replace("''", "'").rstrip()
            elif raw in ("T", "F"):
                value = raw == "T"
            else:
                try:
                    value = int(raw)
                except ValueError:
                    try:
                        value = float(raw.replace("D", "E"))
                    except ValueError:
                        value = raw
            out[card[:8].strip()] = value


def unpack(content: bytes, extension: int = 0, scaled: bool = True) -> tuple[np.ndarray, dict[str, object]]:
    """Image (first axis fastest) and header of the primary unit or an extension; scaled by BSCALE and BZERO, blanks NaN."""
    at = 0
    for unit in range(extension + 1):
        head, data = cards(content, at)
        dims = [int(head[f"NAXIS{k + 1}"]) for k in range(int(head.get("NAXIS", 0)))]
        kind = BITPIX[int(head["BITPIX"])]
        n = int(np.prod(dims)) if dims else 0
        size = n * np.dtype(kind).itemsize + int(head.get("PCOUNT", 0)) * (unit > 0)
        if unit == extension:
            a = np.frombuffer(content, kind, n, data).reshape(dims or (0,), order="F")
            if scaled and any(k in head for k in ("BSCALE", "BZERO", "BLANK")):
                b = a * float(head.get("BSCALE", 1)) + float(head.get("BZERO", 0))
                a = np.where(a == head["BLANK"], np.nan, b) if "BLANK" in head and a.dtype.kind in "iu" else b
            return a, head
        at = data + -(-size // 2880) * 2880


def pack(a: np.ndarray, keys: dict[str, object] | None = None) -> bytes:
    kind = next(b for b, t in BITPIX.items() if t[1:] == np.dtype(a.dtype).str[1:])
    rows = {"SIMPLE": True, "BITPIX": kind, "NAXIS": a.ndim, **{f"NAXIS{k + 1}": d for k, d in enumerate(a.shape)}, **(keys or {})}

    def card(k, v):
        text = "T" if v is True else "F" if v is False else "'" + str(v).replace("'", "''").ljust(8) + "'" if isinstance(v, str) else repr(v)
        return f"{k:<8}= {text if isinstance(v, str) else text.rjust(20)}".ljust(80)

    head = "".join([*(card(k, v) for k, v in rows.items()), "END".ljust(80)])
    data = a.ravel(order="F").astype(BITPIX[kind]).tobytes()
    pad = lambda b, fill: b.ljust(-(-len(b) // 2880) * 2880, fill)
    return pad(head.encode(), b" ") + pad(data, b"\0")


def read(spark: SparkSession, path: str, extension: int = 0) -> DataFrame:
    """(path, i (pixel number), v) of the images under a path."""

    def pixels(files):
        for frame in files:
            for p, c in zip(frame["path"], frame["content"], strict=True):
                a, _ = unpack(bytes(c), extension)
                flat = a.ravel(order="F").astype(float)
                for k in range(0, len(flat), 1 << 20):
                    yield pd.DataFrame({"path": p, "i": np.arange(k, min(k + (1 << 20), len(flat))), "v": flat[k : k + (1 << 20)]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(pixels, "path string, i bigint, v double")


def keys(spark: SparkSession, path: str) -> DataFrame:
    """(path, key, value) of the primary headers under a path, values as text."""

    def run(files):
        for frame in files:
            rows = [(p, k, str(v)) for p, c in zip(frame["path"], frame["content"], strict=True) for k, v in cards(bytes(c))[0].items()]
            yield pd.DataFrame(rows, columns=["path", "key", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, key string, value string")
