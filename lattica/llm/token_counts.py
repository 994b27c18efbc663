"""Token counts by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import bpe
from lattica.llm.common import map_texts, table

#: Texts of more tokens than this are over the limit.
TOKEN_LIMIT = 4096


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, limit: int = TOKEN_LIMIT) -> DataFrame:
    """`id_col`, n_bytes, n_tokens and over_limit of every row.

    Tokens are those of the SentencePiece library for the model, without begin and end; no identifier is
    made: a chunk's count is its initial symbols less its merges.  Null and empty texts have 0 tokens.
    """

    def count(texts: list[str]):
        tokens = bpe.table_of(bpe.model_path(model), "count").__getitem__
        return [len(t.encode()) for t in texts], [sum(map(tokens, bpe.chunks(t))) for t in texts]

    return map_texts(docs, [id_col], text_col, count, "n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
