"""Personal data: patterns, and terms that corpus co-occurrence shows to reveal what the patterns found.

Spark expressions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import apart, checkpointed, table

# The kinds of base spans, in the order in which they are listed, with what a text must hold
# for the pattern to be tried. Possessive and look-behind forms find the same matches as the plain patterns
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+    ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card  [0-9]([\x20-]?[0-9])+                                phone \+[0-9][\x20().0-9-]+[0-9]
# without trying each start of a long run, and without recursion.
KINDS = {
    "email": ("@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9](?:[\x20-]?[0-9]){12}", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
_IP = f"^{_PART}\\.{_PART}\\.{_PART}\\.{_PART}$"

#: Terms are words of two letters or more, in lower case.
TERM = r"\p{L}{2,}"
#: A term reveals an entity if at least so many different texts hold both ...
MIN_SUPPORT = 2
#: ... and its pointwise mutual information with the entity is at least this share of the entity's own
#: information: beyond the first it is generalised, beyond the second removed.
GENERALISE, REMOVE = 0.8, 0.95
#: Keys of repeated texts up to which they are broadcast (32 bytes each).
BROADCAST_KEYS = 500_000
#: Spans of a text beyond which it is taken apart by an array of its characters (in place of substrings, each of
#: which reads the text from its start).
MANY_SPANS = 32

_SPAN = "array<struct<start:int,end:int,s:string>>"


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), 0)


def _prefixes(values: Column, fold) -> Column:
    """The running folds of an array of ints (of sums, of maxima), in two levels: n**1.5 steps, not n**2."""
    none = F.array().cast("array<int>")
    last = lambda a: F.get(a, F.size(a) - 1)
    grow = lambda acc, x: F.concat(acc, F.array(F.coalesce(fold(last(acc), x), x)))
    folds = lambda a: F.aggregate(a, none, grow)

    def both(v: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(v))).cast("int")
        inner = F.transform(F.sequence(F.lit(0), F.size(v) - 1, step), lambda o: folds(F.slice(v, o + 1, step)))
        joined = lambda p: _let(folds(F.transform(p, last)), lambda tops: F.transform(p, lambda a, k: F.when(k == 0, a).otherwise(F.transform(a, lambda x: fold(F.get(tops, k - 1), x)))))
        return F.flatten(_let(inner, joined))

    return _let(values, lambda v: F.when(F.size(v) > 0, both(v)).otherwise(none))


def located(text: Column, pattern: str | Column) -> Column:
    """Leftmost non-overlapping matches of `pattern` with their code-point offsets: array of (start, end, s).

    The pieces between the matches and the matches themselves are lengths that add up to the offsets.
    """
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    found = F.regexp_extract_all(text, pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(0))

    def spans(m: Column) -> Column:
        sizes = F.zip_with(F.slice(between, F.lit(1), F.size(m)), m, lambda g, s: g + F.length(s))
        return F.zip_with(_prefixes(sizes, lambda x, y: x + y), m, lambda end, s: F.struct((end - F.length(s)).alias("start"), end.alias("end"), s.alias("s")))

    return _let(found, spans).cast(_SPAN)


def _luhn(digits: Column) -> Column:
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda c, i: _let(c.cast("int") * (1 + i % 2), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    return F.aggregate(doubled, F.lit(0), lambda a, v: a + v) % 10 == 0


def _valid(kind: str, s: Column) -> Column:
    digits = F.regexp_replace(s, "[^0-9]", "")
    if kind == "ip":
        return s.rlike(_IP)
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _found(text: Column, kind: str, guard: str, pattern: str) -> Column:
    may = F.contains(text, F.lit("@")) if guard == "@" else text.rlike(guard)
    found = F.when(may, F.filter(located(text, pattern), lambda x: _valid(kind, x["s"]))).otherwise(F.array().cast(_SPAN))
    return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["s"].alias("s")))


def base_spans(text: Column) -> Column:
    """The base spans of a text by kind and start: array of (kind, start, end, s)."""
    return F.concat(*(_found(text, kind, *how) for kind, how in KINDS.items()))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def levels(kind: Column, s: Column) -> Column:
    """What a found value is counted as: itself, its group (domain, network, issuer, number prefix) and its kind."""
    digits = F.regexp_replace(s, "[^0-9]", "")
    group = F.when(kind == "email", F.lower(F.substring_index(s, "@", -1))).when(kind == "ip", F.substring_index(s, ".", 2))
    group = group.when(kind == "card", F.substring(digits, 1, 6)).otherwise(F.substring(digits, 1, 4))
    return F.array(F.concat(F.lit("value "), s), F.concat(F.lit("group "), kind, F.lit(" "), group), F.concat(F.lit("kind "), kind))


def revealing_terms(docs: DataFrame, text_col: str = "text", min_support: int = MIN_SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """For each text (by its hash, key) that holds entities and terms that reveal them: terms, array of (term, kind).

    An entity is a value that a pattern finds, its group or its kind (`levels`).  Over different texts: n_e
    hold entity e, n_t hold term t, n_te hold both, of N texts.  PMI(t;e) = log2(N n_te / (n_t n_e)) is
    measured against the information of e, log2(N / n_e).  Equal texts count once in all four.  A term that
    reveals an entity is listed for every text that holds both.

    As n_te is n_e at most, only terms of n_t <= n_e (N / n_e)**(1 - generalise) can reach the share; other
    pairs are never made.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(text.alias("text")).withColumn("key", F.md5("text"))
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0))).alias("words")
    found = rows.where(_may("text")).withColumn("spans", base_spans(F.col("text"))).where(F.size("spans") > 0)
    entities = F.array_distinct(F.flatten(F.transform("spans", lambda x: levels(x["kind"], x["s"])))).alias("entities")
    found = checkpointed(found.select("key", entities, words).dropDuplicates(["key"]))
    holders = found.select("key", F.explode("entities").alias("entity"))
    n_e = checkpointed(holders.groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= min_support))
    times = checkpointed(rows.groupBy("key").agg(F.count("*").alias("times")))
    n = float(max(1, times.count()))
    n_t = _once(rows, times).select(F.explode(words)).select(F.col("col").alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    n_t = checkpointed(n_t.where(F.col("n_t") >= min_support))
    most = F.col("n_e") * F.pow(F.lit(n) / F.col("n_e"), F.lit(1 - generalise)) * 1.000001
    n_e = n_e.withColumn("most", most)
    held = checkpointed(holders.join(n_e, "entity"))
    met = found.select("key", F.explode("words").alias("term")).join(n_t, "term")
    met = checkpointed(met.where(F.col("n_t") <= (held.agg(F.max("most")).first()[0] or 0.0)))
    pairs = met.join(held, (met["key"] == held["key"]) & (F.col("n_t") <= F.col("most"))).groupBy("entity", "term").agg(F.count("*").alias("n_te"), F.max("n_t").alias("n_t"), F.max("n_e").alias("n_e"))
    pmi = F.log2(F.lit(n) * F.col("n_te") / (F.col("n_t").cast("double") * F.col("n_e")))
    share = pmi / F.greatest(F.log2(F.lit(n) / F.col("n_e")), F.lit(1e-9))
    kind = F.when(share >= remove, "removed").when(share >= generalise, "term")
    revealing = checkpointed(pairs.where(F.col("n_te") >= min_support).withColumn("kind", kind).where(F.col("kind").isNotNull()).select("entity", "term", "kind"))
    listed_ = met.select("key", "term").join(revealing, "term").join(held.select("key", "entity"), ["key", "entity"]).groupBy("key", "term").agg(F.min("kind").alias("kind"))
    return listed_.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("term", "kind"))).alias("terms"))


def _once(rows: DataFrame, times: DataFrame) -> DataFrame:
    """One row (text) of each key of `rows` (text, key), which `times` has how often.

    Up to BROADCAST_KEYS repeated keys are broadcast and only their texts are shuffled, else all texts are.
    """
    repeated = times.where("times > 1").select("key")
    if repeated.limit(BROADCAST_KEYS + 1).count() > BROADCAST_KEYS:
        return rows.dropDuplicates(["key"]).select("text")
    single = rows.join(F.broadcast(repeated), "key", "left_anti").select("text")
    return single.union(rows.join(F.broadcast(repeated), "key", "left_semi").dropDuplicates(["key"]).select("text"))


def _may(text: str) -> Column:
    """Whether a text can hold an entity at all."""
    return F.contains(F.col(text), F.lit("@")) | F.col(text).rlike("[0-9]")


def _term_spans(text: Column, terms: Column, base: Column) -> Column:
    """All places in a text of the terms listed for it, apart from its base spans: array of (kind, start, end)."""
    names = F.transform(terms, lambda x: x["term"])
    kind = lambda s: F.get(terms, F.array_position(names, F.lower(s)).cast("int") - 1)["kind"]
    words = F.filter(located(text, TERM), lambda x: F.array_contains(names, F.lower(x["s"])))
    free = F.filter(words, lambda x: ~F.exists(base, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))
    return F.array_sort(F.transform(free, lambda x: F.struct(kind(x["s"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))))


def find_pii(docs: DataFrame, text_col: str = "text", spans_col: str = "pii_spans") -> DataFrame:
    """`docs` with `spans_col`: array of (kind, start, end), base spans by kind and start, then the revealing terms'.

    Kinds email, ip, card and phone are the base; term and removed are the method's (a removed term
    reveals more).  Texts without base spans get none of these, and are not shuffled.  Null and empty texts
    have no span; equal texts have equal spans; very long texts are searched whole; other columns may have
    any names (one named `spans_col` is replaced).
    """
    rows, back = apart(docs.drop(spans_col))
    text = F.coalesce(F.col(back[text_col]).cast("string"), F.lit(""))
    terms = revealing_terms(rows, back[text_col])
    kind_spans = "array<struct<kind:string,start:int,end:int>>"
    rows = rows.withColumn("text", text)
    base = F.when(_may("text"), base_spans(F.col("text"))).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,s:string>>"))
    plain = rows.where(F.size(base) == 0).withColumn("spans", F.array().cast(kind_spans))
    some = rows.where(_may("text")).withColumn("base", base_spans(F.col("text"))).where(F.size("base") > 0).withColumn("key", F.md5("text")).join(terms, "key", "left")
    slim = F.transform("base", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    added = F.when(F.col("terms").isNotNull(), _term_spans(F.col("text"), F.col("terms"), F.col("base"))).otherwise(F.array().cast(kind_spans))
    names = [*back.values(), "spans"]
    both = plain.select(*names).unionByName(some.withColumn("spans", F.concat(slim, added).cast(kind_spans)).select(*names))
    return both.select(*(F.col(v).alias(c) for c, v in back.items()), F.col("spans").alias(spans_col))


def sanitise(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with personal data in `text_col` replaced by its kind in brackets, revealing terms by [term] or by nothing.

    Of overlapping spans the first, and of those the longest, is replaced; the rest of a later one stays
    inside it or is replaced with it.  Null texts stay null.  Other columns may have any names.
    """
    rows, back = apart(docs)
    rows = find_pii(rows, back[text_col], "pii")
    text = F.col(back[text_col]).cast("string")
    word = lambda k: F.when(k == "removed", "").otherwise(F.concat(F.lit("["), k, F.lit("]")))

    def rebuilt(cut: Callable[[Column, Column], Column]) -> Column:
        def pieces(spans: Column) -> Column:
            # Where the text goes on before each span: after the furthest end of the spans before it.
            after = _prefixes(F.transform(spans, lambda x: -x["last"]), lambda x, y: F.greatest(x, y))

            def joined(ends: Column) -> Column:
                at = lambda k: F.coalesce(F.get(ends, k - 1), F.lit(0))
                part = F.transform(spans, lambda x, k: F.when(x["start"] >= at(k), F.concat(cut(at(k), x["start"]), word(x["kind"]))).otherwise(""))
                return F.concat(F.array_join(part, ""), cut(at(F.size(spans)), F.length(text)))

            return _let(after, joined)

        return _let(F.array_sort(F.transform("pii", lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("last"), x["kind"].alias("kind")))), pieces)

    few = rebuilt(lambda a, b: F.substring(text, a + 1, b - a))
    many = _let(F.split(text, ""), lambda chars: rebuilt(lambda a, b: F.array_join(F.slice(chars, a + 1, F.greatest(b - a, F.lit(0))), "")))
    n = F.size("pii")
    rows = rows.withColumn(back[text_col], F.when(n == 0, F.col(back[text_col])).when(n <= MANY_SPANS, few).otherwise(many))
    return rows.select(*(F.col(v).alias(c) for c, v in back.items()))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii_spans", lambda x: x["kind"].isin(*KINDS))
    count = lambda k: F.size(F.filter("pii_spans", lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return rows.select("doc_id", *map(count, KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii_spans")).alias("spans"))
