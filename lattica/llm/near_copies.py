"""N-gram Jaccard join with Bayesian pruning of candidates by MinHash values."""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import apart, checkpointed, mix64, passes, sql_type, table, text_bytes, whole_groups, word_hashes, word_spans

#: Words of a shingle, and the least Jaccard similarity of a link.
SHINGLE, THRESHOLD = 5, 0.8
#: MinHash values by band. Two texts at the threshold share no band with probability (1 - 0.8**6)**40 = 5e-6.
BAND_ROWS, BANDS = 6, 40
HASHES = BAND_ROWS * BANDS
#: MinHash values that are compared between two looks at the posterior, and the probability of reaching
#: the threshold below which a pair is dropped.
LOOK, TOLERANCE = 24, 1e-7
#: Texts and bytes of a block on average; two blocks at most meet in a task's group.
BLOCK, BLOCK_BYTES = 2048, 16 << 20
#: Pairs that are compared in one numpy pass.
PASS_PAIRS = 1 << 18
#: Parts that the edges of one node are dealt to in `components`.
SALTS = 8

_RNG = np.random.RandomState(20240311)
_A = (_RNG.randint(0, 2**62, HASHES, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _RNG.randint(0, 2**62, HASHES, dtype=np.int64).astype(np.uint64)


def shingles(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the distinct shingles of texts, row by row in ascending order, and each row's offset.

    A text of one to four words has one shingle of all of them; one without words has none.
    """
    start, end, row = word_spans(buf, at)
    n = len(at) - 1
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    h = word_hashes(buf, start, end)
    words = np.bincount(row, minlength=n)
    first = np.cumsum(words) - words
    left = words[row] - (np.arange(len(h)) - first[row])  # words from here to the end of the text
    value = np.zeros(len(h), np.uint64)
    for k in range(SHINGLE):
        part = np.zeros(len(h), np.uint64)
        part[: max(0, len(h) - k)] = h[k:]
        part[left <= k] = 0
        value = mix64(value * np.uint64(0x9E3779B97F4A7C15) + part)
    keep = (left >= SHINGLE) | (left == words[row])
    value, row = value[keep], row[keep]
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[new], row[new]
    return value, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int64)


def minhashes(value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The low 16 bits of HASHES MinHash values of each row of shingles; rows without shingles have zeros.

    Values that differ agree in these bits once in 65,536 times, which only lets a pair go on.
    """
    n = len(at) - 1
    out = np.zeros((n, HASHES), np.uint16)
    full = np.flatnonzero(at[1:] > at[:-1])
    if len(full):
        step = 1 << 15
        i = 0
        while i < len(full):  # few enough shingles at a time that they stay in the processor's cache
            j = max(i + 1, int(np.searchsorted(at[full], at[full[i]] + step, "left")))
            rows = full[i:j]
            v = value[at[rows[0]] : at[rows[-1] + 1]]
            cut = at[rows] - at[rows[0]]
            for k in range(HASHES):
                out[rows, k] = (np.minimum.reduceat(((v ^ _B[k]) * _A[k]) >> np.uint64(32), cut) & np.uint64(0xFFFF)).astype(np.uint16)
            i = j
    return out


def _bands(signature: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each band of each signature; its highest bits are the band's number."""
    s = signature.reshape(len(signature), BANDS, BAND_ROWS).astype(np.uint64)
    out = np.zeros(s.shape[:2], np.uint64)
    for k in range(BAND_ROWS):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + s[:, :, k] + np.uint64(1))
    return (out >> np.uint64(7) | np.arange(BANDS, dtype=np.uint64) << np.uint64(57)).view(np.int64)


def _set_keys(value: np.ndarray, at: np.ndarray) -> list[bytes]:
    """A 128-bit key of each row's shingle set: equal for equal sets."""
    return [hashlib.blake2b(value[i:j].tobytes(), digest_size=16).digest() for i, j in zip(at[:-1], at[1:], strict=True)]


def _text_hashes(text: Column) -> list[Column]:
    """Two 64-bit hashes of a text, which together name it."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(whole).alias("h1"), F.xxhash64(F.lit(1), whole).alias("h2")]


def _order_id(id_: Column) -> Column:
    """The id as a number; a null id is the largest."""
    return F.coalesce(id_.cast("bigint"), F.lit(2**63 - 1))


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, h1, h2 (hashes of the text), set (key of the shingle set), sig (MinHash values), shingles (their number) and bytes of each row."""
    schema = f"id {sql_type(docs, id_col)}, h1 bigint, h2 bigint, set binary, sig binary, shingles int, bytes bigint"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, at = text_bytes(b.column(3))
            for i, j in passes(at):
                value, cut = shingles(buf[at[i] : at[j]], at[i : j + 1] - at[i])
                sig = minhashes(value, cut)
                heads = [b.column(k).slice(i, j - i) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*heads, pa.array(_set_keys(value, cut), pa.binary()), pa.array([s.tobytes() for s in sig], pa.binary()), pa.array(np.diff(cut).astype(np.int32)), pa.array(np.diff(at[i : j + 1]))], names=names)

    return docs.select(F.col(id_col).alias("id"), *_text_hashes(F.col(text_col)), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): root is the component's smallest node.

    Rounds of hooking to the smallest neighbour and of shortening paths, each written to the checkpoint
    folder; a star around a hub costs its number of edges, as neighbours are folded by minimum, and its
    edges are dealt to SALTS parts.
    """
    links = checkpointed(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").dropDuplicates())
    turned = lambda e: e.select(F.col("b").alias("a"), F.col("a").alias("b"))
    salted = lambda e: e.withColumn("s", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    while True:
        least = links.union(turned(links)).groupBy("a").agg(F.min("b").alias("ma")).withColumn("ma", F.least("a", "ma"))
        # Each edge now joins the least neighbours of its ends, and each node its own.
        dealt = least.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        step = salted(links.union(turned(links))).join(dealt, ["a", "s"]).select("ma", "b")
        new = step.union(least.select("ma", F.col("a").alias("b"))).where("ma != b").select(F.least("ma", "b").alias("a"), F.greatest("ma", "b").alias("b"))
        links = checkpointed(new.dropDuplicates())
        # Done when every edge goes from a root (a node that is nowhere the larger end) to a node with that edge only.
        more = links.groupBy("b").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        chained = links.select("a").distinct().join(links.select(F.col("b").alias("a")), "a", "left_semi").limit(1).count() if more == 1 else 1
        if more == 0 or more == 1 and not chained:
            break
    return links.select(F.col("b").alias("node"), F.col("a").alias("root")).union(links.select(F.col("a").alias("node"), F.col("a").alias("root")).dropDuplicates())


@functools.cache
def least_matches() -> tuple[int, ...]:
    """For each look, the least number of equal MinHash values with which a pair goes on.

    With a uniform prior, m of n equal values give a Beta(m + 1, n - m + 1) posterior of the similarity;
    P(similarity >= t) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(LOOK, HASHES + 1, LOOK):
        p, m = 0.0, -1
        while p < TOLERANCE:
            m += 1
            p += math.comb(n + 1, m) * THRESHOLD**m * (1 - THRESHOLD) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def prune(sig: np.ndarray, bands: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (i, j) of rows, those whose first common band is `band` and that no look at the posterior drops."""
    go = (bands[i, band] == bands[j, band]) & (np.minimum(size[i], size[j]) >= THRESHOLD * np.maximum(size[i], size[j]) - 1e-9) & (size[i] > 0)
    i, j, band = i[go], j[go], band[go]
    for k in range(int(band.max(initial=0))):
        go = (band <= k) | (bands[i, k] != bands[j, k])
        if not go.all():
            i, j, band = i[go], j[go], band[go]
    matches = np.zeros(len(i), np.int64)
    for look, least in enumerate(least_matches()):
        if not len(i):
            break
        part = slice(look * LOOK, (look + 1) * LOOK)
        a, b = sig[:, part], sig[:, part]
        matches = matches + np.concatenate([(a[i[k : k + 65536]] == b[j[k : k + 65536]]).sum(axis=1) for k in range(0, len(i), 65536)])
        go = matches >= least
        i, j, matches = i[go], j[go], matches[go]
    return i, j


def _pairs(start: np.ndarray, block: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the groups that start at `start`: of a block with itself each once, of two blocks each of one with each of the other."""
    i, j, held = [], [], 0
    ends = [*start[1:].tolist(), len(block)]
    for s, e in zip(start.tolist(), ends, strict=True):
        same = lo[s] == hi[s]
        a, b = (np.arange(s, e),) * 2 if same else (s + np.flatnonzero(block[s:e] == lo[s]), s + np.flatnonzero(block[s:e] == hi[s]))
        step = max(1, PASS_PAIRS // max(1, len(b)))
        for k in range(0, len(a), step):
            x, y = np.repeat(a[k : k + step], len(b)), np.tile(b, len(a[k : k + step]))
            if same:
                x, y = x[x < y], y[x < y]
            i.append(x)
            j.append(y)
            held += len(x)
            if held >= PASS_PAIRS:
                yield np.concatenate(i), np.concatenate(j)
                i, j, held = [], [], 0
    if held:
        yield np.concatenate(i), np.concatenate(j)


def verified(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) of shingle sets reach the threshold, counted exactly."""
    if not len(i):
        return np.zeros(0, bool)
    size = np.array([len(s) for s in sets], np.float64)
    need = THRESHOLD * (size[i] + size[j]) / (1 + THRESHOLD) - 1e-9  # common shingles of a link
    rows_a, rows_b = np.unique(i), np.unique(j)
    if len(i) > 4 * (len(rows_a) + len(rows_b)):
        # Many pairs of the same texts: count common shingles by products of 0/1 matrices, some shingles at a time.
        vocabulary = np.unique(np.concatenate([sets[k] for k in np.union1d(rows_a, rows_b)]))
        common = np.zeros((len(rows_a), len(rows_b)), np.float32)
        place_a, place_b = ([np.searchsorted(vocabulary, sets[k]) for k in rows] for rows in (rows_a, rows_b))
        for lo in range(0, len(vocabulary), 4096):

            def dense(places):
                out = np.zeros((len(places), min(4096, len(vocabulary) - lo)), np.float32)
                for r, p in enumerate(places):
                    out[r, p[np.searchsorted(p, lo) : np.searchsorted(p, lo + 4096)] - lo] = 1
                return out

            common += dense(place_a) @ dense(place_b).T
        both = common[np.searchsorted(rows_a, i), np.searchsorted(rows_b, j)]
    else:
        both = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist(), strict=True)])
    return both >= need


def _chains(i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Links that join all that the given links join, in chains: fewer than rows, and two at most at a row."""
    parent: dict[int, int] = {}

    def root(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        parent[root(y)] = root(x)
    last: dict[int, int] = {}
    out = []
    for x in sorted(parent):
        r = root(x)
        if r in last:
            out.append((last[r], x))
        last[r] = x
    return out


_GROUP = ["bucket", "lo", "hi"]


def _group_pass(t: pa.Table):
    """Of a pass of whole groups: nodes, signatures, sizes, and the surviving pairs in index order."""
    col = lambda c: t.column(c).to_numpy()
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(t.num_rows, HASHES)
    bucket, lo, hi, block = col("bucket"), col("lo"), col("hi"), col("block")
    start = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
    bands, band, size = _bands(sig), bucket >> 57, col("shingles").astype(np.float64)
    found = [prune(sig, bands, size, i, j, band[i]) for i, j in _pairs(start, block, lo, hi)]
    i, j = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    return start, i, j


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (bucket, lo, hi, block, node) that have a pair in their group that the posterior lets go on."""
    for t in whole_groups(batches, _GROUP):
        _, i, j = _group_pass(t)
        rows = np.union1d(i, j)
        if len(rows):
            yield from t.select([*_GROUP, "block", "node"]).take(pa.array(rows)).combine_chunks().to_batches()


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified links: a row (a, a, n) for each text a with links in its group, n of them counting copies, and rows (a, b, 0) that join them."""
    for t in whole_groups(batches, _GROUP):
        start, i, j = _group_pass(t)
        if not len(i):
            continue
        node, rows = t.column("node").to_numpy(), t.column("rows").to_numpy()
        buf, at = text_bytes(t.column("text").combine_chunks())
        value, cut = shingles(buf, at)
        sets = [value[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]
        group = np.searchsorted(start, i, "right")
        order = np.argsort(group, kind="stable")
        i, j, group = i[order], j[order], group[order]
        edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]).tolist()
        go = np.concatenate([verified(sets, i[x:y], j[x:y]) for x, y in zip(edge, [*edge[1:], len(i)], strict=True)])
        i, j = i[go], j[go]
        n = np.bincount(i, weights=rows[j], minlength=len(node)) + np.bincount(j, weights=rows[i], minlength=len(node))
        linked = np.flatnonzero(n)
        pairs = np.array(_chains(i, j), np.int64).reshape(-1, 2)
        a, b = np.concatenate([node[linked], node[pairs[:, 0]]]), np.concatenate([node[linked], node[pairs[:, 1]]])
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.concatenate([n[linked], np.zeros(len(pairs))]).astype(np.int64))], names=["a", "b", "n"])


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, bytes, bucket): a row for each band of each signature."""
    for b in batches:
        for k in range(0, b.num_rows, 2000):
            part = b.slice(k, 2000)
            bands = _bands(np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint16).reshape(part.num_rows, HASHES))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(c).to_numpy(), BANDS)) for c in (0, 1)] + [pa.array(bands.reshape(-1))], names=["node", "bytes", "bucket"])


def _in_groups(rows: DataFrame, fn: Callable, schema: str) -> DataFrame:
    return rows.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(fn, schema)


def _classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """For every row: id, h1, h2, class_id, n_links, and first: (id, h1, h2) of the class's first row.

    A text (rows of one shingle set) is a node, numbered when the texts are written.  Written to the checkpoint
    folder is what is read again, and the members of buckets, so that the shuffles of all bands can go.
    """
    rows = checkpointed(signatures(docs, id_col, text_col))
    first = F.min(F.struct(_order_id(F.col("id")).alias("id"), "h1", "h2")).alias("first")
    texts = rows.groupBy("set").agg(first, F.count("*").alias("rows"), F.first("sig").alias("sig"), F.first("shingles").alias("shingles"), F.max("bytes").alias("bytes"))
    texts = checkpointed(texts.withColumn("node", F.monotonically_increasing_id()))
    # Buckets of texts that share a band; of buckets with the same texts the first.
    band = texts.where("shingles > 0").select("node", "bytes", "sig").mapInArrow(_exploded, "node bigint, bytes bigint, bucket bigint")
    mark = lambda k: F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"x{k}")
    buckets = band.groupBy("bucket").agg(F.count("*").alias("n"), mark(0), mark(1), F.sum("bytes").alias("bytes")).where("n > 1")
    buckets = buckets.groupBy("n", "x0", "x1").agg(F.min("bucket").alias("bucket"), F.max("bytes").alias("bytes"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.least(F.col("bytes") / BLOCK_BYTES, F.col("n") / 2))).cast("int")
    members = band.select("bucket", "node").join(buckets.select("bucket", blocks.alias("blocks")), "bucket")
    members = checkpointed(members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks").cast("bigint")).cast("int")))
    pairs_of = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = members.join(texts.select("node", "sig", "shingles"), "node").select("bucket", "block", "node", "sig", "shingles", pairs_of)
    dealt = dealt.select("bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "sig", "shingles")
    alive = checkpointed(_in_groups(dealt, _candidates, "bucket bigint, lo int, hi int, block int, node bigint"))
    # Texts of what is still alive, one for each node, whichever rows hold it.
    needed = texts.join(alive.select("node").distinct(), "node").select("node", "rows", "sig", "shingles", "first.id", "first.h1", "first.h2")
    sources = docs.select(_order_id(F.col(id_col)).alias("id"), *_text_hashes(F.col(text_col)), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    whole = sources.join(needed, ["id", "h1", "h2"]).groupBy("node").agg(*(F.first(c).alias(c) for c in ("rows", "sig", "shingles", "text")))
    found = _in_groups(alive.join(whole, "node").select(*_GROUP, "block", "node", "rows", "sig", "shingles", "text"), _links, "a bigint, b bigint, n bigint")
    found = checkpointed(found.groupBy("a", "b").agg(F.sum("n").alias("n")))
    links = found.where("n > 0").select(F.col("a").alias("node"), F.col("n").alias("links"))
    joined = components(found.where("n = 0"))
    known = texts.select("set", "node", "rows", "first").join(links, "node", "left").join(joined, "node", "left")
    known = checkpointed(known.withColumn("root", F.coalesce("root", "node")))
    firsts = known.groupBy("root").agg(F.min("first").alias("class_first"))
    known = known.join(firsts, "root").select("set", F.col("class_first.id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links"), F.col("class_first").alias("first"))
    return rows.select("id", "h1", "h2", "set").join(known, "set").drop("set")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, class_id and n_links of every row; ids are integers.

    A link is a pair of rows whose sets of five-word shingles have a Jaccard similarity of THRESHOLD or
    more.  n_links is the row's number of them, copies included.  class_id is the smallest id among the
    rows that links join to it.  Rows without words (null, empty) are copies of one another and linked to
    no other; a null id takes part like any other, as the largest number; repeated rows are copies.  Very
    long texts are read whole.  An empty table gives an empty result.

    Rows of equal sets are one text from the start.  Texts that share a band of MinHash values are
    candidates, once, at the first band that they share: a bucket of a band is dealt in blocks of signatures,
    and each two blocks meet in a group that drops pairs by the posterior, a look at a time.  Only texts that
    have a pair left are sent to where the pairs are verified exactly.  Groups return counts and chains of
    links, not pairs.
    """
    return _classes(docs, id_col, text_col).select(F.col("id").alias(id_col), "class_id", "n_links")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each class: the one of the smallest id (of repeated rows, one). Other columns may have any names."""
    rows, back = apart(docs)
    id_, text = back[id_col], back[text_col]
    keep = _classes(rows.select(id_, text), id_, text).select("first.*").dropDuplicates()
    keyed = rows.withColumn("id", _order_id(F.col(id_))).withColumns(dict(zip(("h1", "h2"), _text_hashes(F.col(text)), strict=True)))
    kept = keyed.join(keep, ["id", "h1", "h2"]).dropDuplicates(["id", "h1", "h2"])
    return kept.select(*(F.col(v).alias(c) for c, v in back.items()))


def op7_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))
