"""Mixing sources to target weights by random keys, range sorting and distributed prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.llm.common import apart, checkpointed, table, with_numbers

WORD = "[^\\x20\\x09-\\x0D]+"
#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: A source gives each of its words this many times at most.
MAX_EPOCHS = 3
#: Documents in a key range on average, and ranges in a group of ranges.
RANGE_ROWS, GROUP_RANGES = 4_000, 2_000
#: Sources up to which their few numbers are broadcast.
BROADCAST_SOURCES = 100_000


def words_in(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("bigint")


def random_key(id_col: Column, text: Column, seed: int) -> Column:
    """A 60-bit key of a row, from a hash of seed, id and text that SQL engines share; only repeated rows have one key.

    Null ids and null texts are hashed as empty ones.
    """
    part = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), part(id_col), F.md5(part(text)))), 1, 15), 16, 10).cast("bigint")


def _ranked(sources: DataFrame) -> DataFrame:
    """`sources` with `rank`: its place in the order of source by code point, null last, from 0.

    Ranges are sorted apart and numbered within; the sizes of the ranges (a few numbers) give their offsets.
    """
    order = F.col("source").asc_nulls_last()
    ranged = checkpointed(sources.repartitionByRange(order).sortWithinPartitions(order).withColumn("seq", F.monotonically_increasing_id()))
    counts = {r[0]: r[1] for r in ranged.groupBy(F.shiftright("seq", 33)).count().collect()}
    offsets, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        offsets.append(total)
        total += counts.get(p, 0)
    at = F.from_json(F.lit(str(offsets)), "array<bigint>")
    return ranged.withColumn("rank", F.get(at, F.shiftright("seq", 33).cast("int")) + F.col("seq").bitwiseAND(F.lit((1 << 33) - 1))).drop("seq")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS) -> DataFrame:
    """`sources` (source, source_size, ...) with `target`, in words.

    The total size is shared by weight; what would exceed `most` times a source's size is shared again
    among the rest, until none is above.  Each round is one aggregate over the sources; a round that changes
    anything holds a source at its cap for good, and the level doubles or ends within as many rounds as there
    are different ratios of cap to weight.
    """
    w = F.get(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights)).cast("int")).cast("double")
    ranked = checkpointed(_ranked(sources).withColumn("w", w).withColumn("cap", F.col("source_size") * float(most)))
    total, weight = ranked.agg(F.sum("source_size"), F.sum("w")).first()
    level, full = (total / weight if total else 0.0), -1
    while total:
        above = F.col("cap") < F.col("w") * level
        n, held, free = ranked.agg(F.sum(above.cast("int")), F.sum(F.when(above, F.col("cap")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("w")))).first()
        if n == full or not free:
            break
        full, level = n, (total - held) / free
    return ranked.withColumn("target", F.round(F.least(F.col("cap"), F.col("w") * level), 6)).drop("w", "cap", "rank")


def _with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """`rows` (source, key, ...) joined to the numbers of their source."""
    return with_numbers(rows, sources, "source", F.col("key"), BROADCAST_SOURCES)


def mix_cuts(slim: DataFrame) -> DataFrame:
    """The cut of each source of the rows (source, key, size).

    A cut: source, source_size, target, epochs (how often every document of the source is taken whole), and
    cut_key, cut_words, cut_rows: documents of lower keys are taken once more, and of those with that key
    so many words together.  Prefix sums are taken within key ranges, over the ranges of a group of ranges, and
    over the groups of a source: no window holds more than a few thousand rows on average.
    """
    totals = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    budget = F.floor("target").cast("bigint")
    targets = source_targets(totals).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("bigint"))
    targets = checkpointed(targets.withColumn("rest", budget - F.col("epochs") * F.col("source_size")))

    ranges = F.ceil(F.col("n") / RANGE_ROWS)
    place = F.least(ranges - 1, F.floor(F.col("key") / F.lit(2.0**60) * ranges)).cast("bigint")
    spread = _with_source(slim.select("source", "key", "size"), targets.select("source", "n")).withColumn("range", place)
    units = spread.repartition("source", "range").groupBy("source", "range", "key").agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
    units = checkpointed(units.withColumn("end", F.sum("words").over(W.partitionBy("source", "range").orderBy("key"))))
    sums = units.groupBy("source", "range").agg(F.sum("words").alias("all")).withColumn("group", F.floor(F.col("range") / GROUP_RANGES))
    running = lambda by, order: F.sum("all").over(W.partitionBy(*by).orderBy(order)) - F.col("all")
    groups = sums.groupBy("source", "group").agg(F.sum("all").alias("all"))
    groups = groups.withColumn("before", running(["source"], "group")).select(F.col("source").alias("s"), F.col("group").alias("g"), "before")
    within = sums.withColumn("inside", running(["source", "group"], "range"))
    before = within.join(groups, F.col("source").eqNullSafe(F.col("s")) & (F.col("group") == F.col("g"))).select("source", "range", "all", (F.col("before") + F.col("inside")).alias("before"))
    # The range that holds a source's budget, then the row in it.
    rest = targets.select(F.col("source").alias("s"), "rest")
    holds = before.join(rest, F.col("source").eqNullSafe(F.col("s"))).where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("all")))
    holds = holds.select("s", F.col("range").alias("r"), (F.col("rest") - F.col("before")).alias("left"))
    cut = units.join(holds, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r"))).where((F.col("end") - F.col("words") <= F.col("left")) & (F.col("left") < F.col("end")))
    cut = cut.select("s", F.col("key").alias("cut_key"), (F.col("left") - F.col("end") + F.col("words")).alias("cut_words"), F.col("rows").alias("cut_rows"))
    return checkpointed(targets.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "epochs", "cut_key", "cut_words", "cut_rows"))


def _taken(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """`rows` (source, key, size, ...) with their source's cut, part and taken."""
    part = F.when(F.col("key") < F.col("cut_key"), F.col("size")).when(F.col("key") == F.col("cut_key"), F.least(F.col("size"), F.floor(F.col("cut_words") / F.col("cut_rows")))).otherwise(0).cast("bigint")
    joined = _with_source(rows, cuts).withColumn("part", part)
    return joined.withColumn("taken", F.col("epochs") * F.col("size") + F.col("part"))


def _slim(rows: DataFrame, id_: str, text: str, source: str, seed: int) -> DataFrame:
    return checkpointed(rows.select(F.col(id_).alias("id"), F.col(source).cast("string").alias("source"), random_key(F.col(id_), F.col(text), seed).alias("key"), words_in(F.col(text)).alias("size")))


def mix_amounts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17) -> DataFrame:
    """`id_col`, size, source_size, target and taken of every row: how many words of it the mix takes.

    A null source is a source of its own, last in order.  Null and empty texts have size 0 and give 0; very
    long texts are counted whole.  Repeated rows share one key; if the cut falls on them, each gives the same
    part.  An empty table gives an empty result; other columns may have any names.
    """
    rows, back = apart(docs)
    slim = _slim(rows, back[id_col], back[text_col], back[source_col], seed)
    return _taken(slim, mix_cuts(slim)).select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17) -> DataFrame:
    """The mixed rows, with the columns of `docs`: each row as often as the mix takes it, the one at the cut with its first words only.

    Which rows the mix takes is worked out on slim rows (id, key, size); only then are texts read again, and a
    row's copies follow from its own key and its source's cut.
    """
    rows, back = apart(docs)
    id_, text, source = back[id_col], back[text_col], back[source_col]
    cuts = mix_cuts(_slim(rows, id_, text, source, seed))
    keyed = rows.withColumns({"source": F.col(source).cast("string"), "key": random_key(F.col(id_), F.col(text), seed), "size": words_in(F.col(text))})
    copies = F.col("epochs") + (F.col("part") > 0).cast("bigint")
    taken = _taken(keyed, cuts).where((F.col("size") > 0) & (copies > 0)).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), copies)))
    first = F.array_join(F.slice(F.regexp_extract_all(F.col(text), F.lit(f"[\\x20\\x09-\\x0D]*{WORD}"), F.lit(0)), F.lit(1), F.col("part").cast("int")), "")
    cut_off = (F.col("copy") > F.col("epochs")) & (F.col("part") < F.col("size"))
    taken = taken.withColumn(text, F.when(cut_off, first).otherwise(F.col(text)))
    return taken.select(*(F.col(v).alias(c) for c, v in back.items()))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_amounts(table(spark, sf_dir, "documents"))
