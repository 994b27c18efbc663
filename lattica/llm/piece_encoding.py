"""SentencePiece encoding and decoding with a table of distinct chunks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import bpe
from lattica.llm.common import map_texts, slices, table


def _encoder(model: str | None):
    path = bpe.model_path(model)
    piece, ids_of = bpe.load(path), bpe.table_of(path, "encode").__getitem__
    begin, end = (np.array([i], "<u4").tobytes() for i in (piece.bos, piece.eos))
    return piece, lambda text: b"".join([begin, *map(ids_of, bpe.chunks(text)), end])


def encode(docs: DataFrame, text_col: str = "text", model: str | None = None) -> DataFrame:
    """All columns of `docs` and `ids` (array of int): the text's ids with begin and end.

    Each distinct chunk is segmented once into the worker's table, and the ids are put together by the
    chunks' positions.  A column named ids is replaced.  Null and empty texts: begin and end only.
    """
    keep = [c for c in docs.columns if c != "ids"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "ids"), "ids array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, ids_of = _encoder(model)
        for b in slices(batches, 500):
            raw = [ids_of(t) for t in b.column(keep.index(text_col)).fill_null("").to_pylist()]
            at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(raw), "<i4")))
            yield pa.RecordBatch.from_arrays([*b.columns, ids], names=[*keep, "ids"])

    return docs.select(*keep).mapInArrow(run, schema)


def decode(docs: DataFrame, ids_col: str = "ids", text_col: str = "text", model: str | None = None) -> DataFrame:
    """All columns of `docs` with `text_col` set to the library's decoding of `ids_col` (null: the empty text)."""
    keep = [c for c in docs.columns if c != text_col]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text_col), f"`{text_col}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, _ = _encoder(model)
        for b in slices(batches, 500):
            texts = [piece.processor.decode(x.as_py() or []) for x in b.column(keep.index(ids_col))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*keep, text_col])

    return docs.select(*keep).mapInArrow(run, schema)


def round_trip(docs: DataFrame, text_col: str = "text", model: str | None = None) -> DataFrame:
    """`encode`, then `decode` into `text_col`, in one pass over the rows; columns of `docs` and ids."""
    keep = [c for c in docs.columns if c not in ("ids", text_col)]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "ids array<int>", f"`{text_col}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, ids_of = _encoder(model)
        for b in slices(batches, 500):
            raw = [np.frombuffer(ids_of(t), "<i4") for t in b.column(len(keep)).fill_null("").to_pylist()]
            at = np.cumsum([0, *map(len, raw)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(raw)))
            texts = pa.array([piece.processor.decode(x.tolist()) for x in raw], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], ids, texts], names=[*keep, "ids", text_col])

    return docs.select(*keep, F.col(text_col).cast("string")).mapInArrow(run, schema)


def encoding_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """`id_col`, n_tokens, ids_sha256 and decoded_sha256 of every row, from the ids that `encode` gives."""

    def digest(texts: list[str]):
        piece, ids_of = _encoder(model)
        n, ids_sha, text_sha = [], [], []
        for t in texts:
            raw = ids_of(t)
            n.append(len(raw) // 4)
            ids_sha.append(hashlib.sha256(raw).hexdigest())
            text_sha.append(hashlib.sha256(piece.processor.decode(np.frombuffer(raw, "<u4").tolist()).encode()).hexdigest())
        return n, ids_sha, text_sha

    return map_texts(docs, [id_col], text_col, digest, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op8_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(table(spark, sf_dir, "documents"))
