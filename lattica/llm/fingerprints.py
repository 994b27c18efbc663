"""Document fingerprints: one-permutation MinHash with optimal densification, in Spark expressions only."""

from __future__ import annotations

import json
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.llm.common import apart, table

#: Bins (a power of two), stored bits of each bin, words of a shingle.
BIN_BITS, BITS, SHINGLE = 7, 8, 5
BINS = 1 << BIN_BITS
#: Text bytes of a range of documents, ranges at most (which bounds what is broadcast; a larger range is sorted and read
#: by spilling), and sampled rows for each range's bound.
RANGE_BYTES, MAX_RANGES, RANGE_SAMPLE = 4 << 20, 50_000, 40
#: Donors tried one by one before all the rest are looked at together.
FIRST_DONORS = 6


def _let(value: Column, body) -> Column:
    """body(value), with `value` computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _donors() -> Column:
    """For each bin, the order in which other bins are asked when it is empty: independent random orders from a fixed seed."""
    rng = random.Random(20240607)
    rows = [rng.sample([j for j in range(BINS) if j != i], BINS - 1) for i in range(BINS)]
    return F.from_json(F.lit(json.dumps(rows)), "array<array<int>>")


def fingerprint_bins(text: Column) -> Column:
    """The stored bits of the BINS bins of a text, an empty array if it has no word.

    Shingles are runs of five words (all words, if fewer).  Each is hashed once; the hash's upper bits name
    its bin, and a bin keeps its least hash.  An empty bin takes the value of the first filled one in its
    own random order.  Only the low bits are kept.
    """
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    shingles = lambda h: F.slice(F.transform(h, lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, SHINGLE)))), F.lit(1), F.greatest(F.size(h) - (SHINGLE - 1), F.lit(1)))
    bin_of = lambda x: F.shiftrightunsigned(x, 64 - BIN_BITS).cast("int")
    least = lambda s: F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(s, i - 1))))
    spread = lambda m: F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: F.try_element_at(m, j))
    bins = lambda s: _let(least(s), lambda k: _let(F.map_from_arrays(F.transform(k, bin_of), k), spread))

    def densified(b: Column) -> Column:
        donor = lambda j: _let(F.get(_donors(), j), lambda d: F.coalesce(*(F.get(b, F.get(d, F.lit(t))) for t in range(FIRST_DONORS)), F.get(F.filter(F.transform(d, lambda q: F.get(b, q)), lambda v: v.isNotNull()), 0)))
        return F.transform(b, lambda v, j: F.coalesce(v, donor(j)).bitwiseAND(F.lit((1 << BITS) - 1).cast("bigint")).cast("int"))

    return _let(hashes, lambda h: F.when(F.size(h) == 0, F.array().cast("array<int>")).otherwise(_let(F.array_sort(shingles(h)), lambda s: _let(bins(s), densified))))


def packed(bins: Column) -> Column:
    """The bins' bits as hexadecimal digits, two for each bin."""
    return F.array_join(F.transform(bins, lambda v: F.lpad(F.lower(F.hex(v)), 2, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of the shingle sets behind two arrays of bins.

    Bins agree by chance once in 2**BITS times; that bias is taken out.  Two texts without words are alike (1),
    one with and one without are not (0).
    """
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    chance = 2.0**-BITS
    corrected = F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(corrected)


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with `fingerprint`: the packed bits of each whole text. A column of that name is replaced.

    A null or empty text, or one without a word, has the empty fingerprint; equal texts have equal ones.
    """
    return docs.withColumn("fingerprint", packed(fingerprint_bins(F.col(text_col).cast("string"))))


def _ranges(rows: DataFrame) -> Column:
    """The number of a row's range in the order of (place, tie); the bounds come from a sample of at most RANGE_SAMPLE rows a range.

    Any bounds give the same result.  Bounds hold both numbers, so that rows without an id, or with the same
    one, are dealt to many ranges too.  Two levels of bounds keep the search short.
    """
    total, count = rows.agg(F.sum("bytes"), F.count("*")).first()
    n = max(1, min(MAX_RANGES, -(-(total or 0) // RANGE_BYTES)))
    bounds: list[tuple[int, int]] = []
    if n > 1:
        share = 2 * (RANGE_SAMPLE * n + 50) / count
        some = rows if share >= 1 else rows.where(F.xxhash64("place", "tie") <= int(-(2**63) + share * 2**64))
        found = some.select("place", "tie", "bytes").limit(RANGE_SAMPLE * n * 4).toPandas().sort_values(["place", "tie"])
        size = found["bytes"].to_numpy(np.int64).cumsum()
        cuts = np.searchsorted(size, size[-1] * np.arange(1, n) // n) if len(size) else []
        bounds = sorted({(int(found["place"].iloc[k]), int(found["tie"].iloc[k])) for k in cuts})
    group = max(1, int(len(bounds) ** 0.5))
    groups = [[{"p": p, "t": t} for p, t in bounds[i : i + group]] for i in range(0, len(bounds), group)]
    kind = "struct<p:bigint,t:bigint>"
    tops = F.from_json(F.lit(json.dumps([g[-1] for g in groups])), f"array<{kind}>")
    all_ = F.from_json(F.lit(json.dumps(groups)), f"array<array<{kind}>>")
    below = lambda a: F.size(F.filter(a, lambda b: b < F.struct(F.col("place").alias("p"), F.col("tie").alias("t"))))
    fine = lambda c: F.when(F.get(all_, c).isNull(), 0).otherwise(below(F.get(all_, c)))
    return _let(below(tops), lambda c: c * group + fine(c)).cast("int")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last quarter of its characters replaced by the first ones of the next row's
    text, in ascending order of the integer id (nulls last; equal ids in the order of their texts' hashes;
    after the last comes the first, which in a table of one row is that row).  Null texts are empty; very long
    texts are read whole; an empty table gives an empty result; other columns may have any names.  Rows are
    dealt by ranges of that order once, with their texts; the first text of each range is sent to the range
    before it.
    """
    docs, back = apart(docs.select(id_col, text_col))
    text = F.coalesce(F.col(back[text_col]).cast("string"), F.lit(""))
    place = F.coalesce(F.col(back[id_col]).cast("bigint"), F.lit(2**63 - 1))
    rows = docs.select(F.col(back[id_col]).alias("id"), place.alias("place"), text.alias("text")).withColumns({"tie": F.xxhash64("text"), "bytes": F.octet_length("text").cast("bigint")})
    rows = rows.withColumn("range", _ranges(rows)).drop("bytes")
    heads = sorted((r["range"], r["first"]) for r in rows.groupBy("range").agg(F.min(F.struct("place", "tie")).alias("first")).collect())
    follows = [{"r": r, "next": heads[(i + 1) % len(heads)][0], "p": heads[(i + 1) % len(heads)][1][0], "t": heads[(i + 1) % len(heads)][1][1]} for i, (r, _) in enumerate(heads)]
    follow = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(follows)), "array<struct<r:int,next:int,p:bigint,t:bigint>>")))
    # A row for each range; where the first row is repeated, its copies are one.
    first = rows.join(F.broadcast(follow), (rows["range"] == follow["next"]) & (rows["place"] == follow["p"]) & (rows["tie"] == follow["t"])).groupBy("r").agg(F.first("text").alias("head"))

    w = W.partitionBy("range").orderBy("place", "tie")
    rows = rows.withColumn("n_chars", F.length("text").cast("bigint")).withColumn("next", F.lead("text").over(w))
    rows = rows.join(first, rows["range"] == first["r"], "left")
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - quarter), F.substring(F.coalesce("next", "head"), F.lit(1), quarter))
    rows = rows.withColumn("edited", edited).withColumn("head", F.when(F.col("next").isNull(), F.col("head")))
    rows = rows.select("id", "place", "tie", "range", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint_bins(F.col("text")).alias("bins"), fingerprint_bins(F.col("edited")).alias("edited_bins"), F.when(F.col("head").isNotNull(), fingerprint_bins(F.col("head"))).alias("head_bins"))
    rows = rows.withColumn("next_bins", F.coalesce(F.lead("bins").over(w), "head_bins"))
    return rows.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", packed(F.col("bins")).alias("fingerprint"), packed(F.col("edited_bins")).alias("edited_fingerprint"), likeness(F.col("bins"), F.col("edited_bins")).alias("near_edited"), likeness(F.col("bins"), F.col("next_bins")).alias("near_next"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
