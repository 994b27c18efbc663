"""Helpers shared by the text operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy pass works on; a longer single text is a pass of its own.
PASS_BYTES = 1 << 21
#: Rows that a Python function turns into results at a time.
SLICE_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, which all executors share.

    Where that is unset, a local-mode session (tests, bench) gets a temporary folder; on a cluster it is
    an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if shared is None:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder, so that its lineage ends there; Spark removes the files when it is no longer used."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, path: str) -> DataFrame:
    """`df` written to `path` as Parquet, and read from there."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    file = jvm.org.apache.hadoop.fs.Path(path)
    file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(file, True)


def remainder(col: str, n: int) -> Column:
    """crc32 of the id's text, mod n: the fold of a row. A null id has fold 0."""
    return F.coalesce(F.crc32(F.col(col).cast("string")) % n, F.lit(0))


def lowest_hashes(df: DataFrame, id_col: str, rows: int) -> DataFrame:
    """The `rows` rows of the lowest hashes of their ids (all, if there are fewer), as a table to collect.

    Only a share of the rows that holds about twice as many is sorted; should it hold too few, all are.
    The share is of the rows of `df`, so apply every filter and join before.
    """
    h = F.xxhash64(F.col(id_col).cast("string"))
    of = df.count()
    share = 2 * (rows + 50) / max(1, of)
    if share < 1:
        some = df.where(h <= F.lit(int(-(2**63) + share * 2**64)))
        if some.count() >= rows:
            df = some
    return df.orderBy(h, *(c for c in df.columns if c != id_col)).limit(rows)


def apart(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """`df` with its columns renamed to _c0, _c1, ..., which no operator uses, and the new name of each."""
    names = {c: f"_c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def with_numbers(rows: DataFrame, numbers: DataFrame, key: str, spread: Column, bound: int, salts: int = 64, how: str = "inner") -> DataFrame:
    """`rows` joined to the few columns that `numbers` has for each value of `key` (nulls are equal).

    Up to `bound` rows `numbers` is broadcast; more are joined, copied to `salts` parts by `spread` (a bigint of
    the row), so that the rows of one key are not one task.
    """
    named = numbers.withColumnRenamed(key, "other_key")
    same = F.col(key).eqNullSafe(F.col("other_key"))
    if numbers.limit(bound + 1).count() <= bound:
        return rows.join(F.broadcast(named), same, how).drop("other_key")
    salted = rows.withColumn("salt", F.pmod(spread, F.lit(salts)).cast("int"))
    copies = named.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, same & (F.col("salt") == F.col("part")), how).drop("other_key", "salt", "part")


def sql_type(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.simpleString()


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of a few rows, so that what is made from them stays small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def map_texts(df: DataFrame, keep: list[str], text: str, fn: Callable, out: str) -> DataFrame:
    """One row per input row: the columns `keep`, then the columns `out` that `fn` returns for the texts.

    `fn` takes a list of strings (nulls are empty) and returns a list of columns, each a list, a numpy
    array or an Arrow array.
    """
    head = ", ".join(f"`{c}` {sql_type(df, c)}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column(len(keep)).fill_null("").to_pylist()
            cols = [pa.array(c) if not isinstance(c, pa.Array) else c for c in fn(texts)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *cols], names=names)

    schema = ", ".join(x for x in (head, out) if x)
    names = [*keep, *(x.split()[0].strip("`") for x in out.split(", "))]
    return df.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 8192) -> Iterator[pa.Table]:
    """Sorted batches as tables of whole groups (rows with equal `keys`), of about `rows` rows or one group."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            t = pa.Table.from_batches(held)
            change = np.zeros(n - 1, bool)
            for k in keys:
                v = t.column(k).to_numpy()
                change |= v[1:] != v[:-1]
            last = np.flatnonzero(change)
            if len(last):
                yield t.slice(0, last[-1] + 1)
                t = t.slice(last[-1] + 1)
            held, n = t.to_batches(), t.num_rows
    if n:
        yield pa.Table.from_batches(held)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, end to end, and the offset of each text (one more than rows)."""
    column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    n = len(column)
    at = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return buf, at - at[0]


def passes(at: np.ndarray, limit: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most `limit` bytes, or of one row."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, j
        i = j


def word_spans(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start, byte end and row of each word, words being runs without ASCII white space."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    word = (buf != 32) & ((buf < 9) | (buf > 13))
    full = at[1:] > at[:-1]
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    before[at[:-1][full]] = False
    after = np.empty_like(word)
    after[-1], after[:-1] = False, word[1:]
    after[at[1:][full] - 1] = False
    start = np.flatnonzero(word & ~before)
    end = np.flatnonzero(word & ~after) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


_BYTE = np.random.RandomState(20240501).randint(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    first = np.cumsum(size) - size
    where = np.arange(int(size.sum())) - np.repeat(first, size)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(size.max()), _BASE)]).astype(np.uint64))
    value = _BYTE[buf[np.repeat(start, size) + where]] * power[where]
    return mix64(np.add.reduceat(value, first) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
