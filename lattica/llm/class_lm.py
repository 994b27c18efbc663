"""Brown class-based bigram model: exchange clustering, class transitions and word emissions.

Words are told apart by 64-bit hashes in the workers' tables; counts that are joined go by the words themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import apart, checkpointed, passes, remainder, sql_type, table, text_bytes, whole_groups, word_hashes, word_spans

#: Words of the core, which the exchange moves among the classes in rounds; class 0 is the end.
CORE_WORDS, CLASSES = 1000, 48
#: The class of words that have none of their own: those that occur less than MIN_COUNT times, or never.
RARE = CLASSES
#: Least count of a word with a class of its own, and the most words, the most frequent ones, whose counts and
#: classes workers hold (17 bytes each); those of all other words are joined.
MIN_COUNT, HELD_WORDS = 2, 1_000_000
#: Added to a word's count in its class's emission, and to a class pair's count in the transitions.
EMIT_ADD, MOVE_ADD = 0.5, 0.5
#: Distinct words or contexts that a counting task holds.
COUNTER_SIZE = 500_000
#: Contexts that are put against all classes at a time.
CONTEXT_ROWS = 20_000
_KINDS = CLASSES + 1  # the classes and RARE


def tokens(column: pa.Array) -> Iterator[tuple[int, int, bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Passes of a text column: its rows i to j, their bytes with A-Z in lower case, and start, end, row and hash of each word."""
    buf, at = text_bytes(column)
    for i, j in passes(at):
        part = buf[at[i] : at[j]].copy()
        part[(part >= 65) & (part <= 90)] |= 32
        start, end, row = word_spans(part, at[i : j + 1] - at[i])
        yield i, j, part.tobytes(), start, end, row, word_hashes(part, start, end)


def in_sequence(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """The words' values end to end, a 0 (the end) before the first text and after each."""
    out = np.zeros(len(values) + rows + 1, values.dtype)
    out[np.arange(len(values)) + row + 1] = values
    return out


def places(hashes: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of `h` stands in the sorted `hashes`, and whether it does."""
    if not len(hashes):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
    return at, hashes[at] == h


def _collected(df: DataFrame) -> list[np.ndarray]:
    """The columns (whole numbers) of a table whose size has a bound, as arrays and never as rows."""
    t = df.toArrow()
    return [t.column(c).to_numpy().astype(np.int64) for c in t.column_names]


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, h, c): how often each word occurs, over all rows, and its hash. Tasks fold what they read before it is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[int, int] = {}
        word: dict[int, bytes] = {}

        def flush():
            keys = list(count)
            for i in range(0, len(keys), 100_000):
                part = keys[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([word[k] for k in part], pa.binary()), pa.array(np.array(part, np.uint64).view(np.int64)), pa.array([count[k] for k in part], pa.int64())], names=["word", "h", "c"])
            count.clear(), word.clear()

        for b in batches:
            for _, _, raw, start, end, _, h in tokens(b.column(0)):
                u, first, n = np.unique(h, return_index=True, return_counts=True)
                for k, s, e, c in zip(u.tolist(), start[first].tolist(), end[first].tolist(), n.tolist(), strict=True):
                    if k in count:
                        count[k] += c
                    else:
                        count[k], word[k] = c, raw[s:e]
                if len(count) > COUNTER_SIZE:
                    yield from flush()
        yield from flush()

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "word binary, h bigint, c bigint").groupBy("word").agg(F.first("h").alias("h"), F.sum("c").alias("c"))


def pair_counts(docs: DataFrame, text_col: str, numbers, kinds: int) -> np.ndarray:
    """How often a word or end of each number precedes one of each number, over all rows: a matrix of `kinds` squared.

    `numbers` is a broadcast of sorted hashes, their numbers, and the number of all other words; the end is 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, number, other = numbers.value
        total = np.zeros(kinds * kinds, np.int64)
        for b in batches:
            for i, j, _, _, _, row, h in tokens(b.column(0)):
                at, known = places(hashes, h)
                seq = in_sequence(np.where(known, number[at] if len(number) else 0, other).astype(np.int64), row, j - i)
                key, n = np.unique(seq[:-1] * kinds + seq[1:], return_counts=True)
                total[key] += n
        pair = np.flatnonzero(total)
        for i in range(0, len(pair), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(pair[i : i + 200_000]), pa.array(total[pair[i : i + 200_000]])], names=["pair", "n"])

    found = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    pair, n = _collected(found)
    out = np.zeros(kinds * kinds)
    out[pair] = n
    return out.reshape(kinds, kinds)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int = CLASSES, rounds: int | None = None, other: bool = False) -> np.ndarray:
    """A class for each symbol by the exchange algorithm, from a matrix of symbol pair counts.

    The end (symbol 0) has class 0 for itself, and with `other` the last symbol the class after the last.  The
    rest start dealt out by frequency; then each in turn leaves its class and joins the one that raises the
    class bigram likelihood most (of equal ones the first), until a round moves none (or for `rounds` rounds,
    where given).  Each move raises the likelihood, so that the rounds end.
    """
    n, kinds = len(pairs), classes + other
    m = pairs.astype(np.float64)
    freq = m.sum(axis=0)
    order = [s for s in np.argsort(-freq, kind="stable") if s and freq[s] > 0 and not (other and s == n - 1)]
    cls = np.zeros(n, np.int64)
    rest = max(1, classes - 1)
    cls[1:] = 1 + np.arange(n - 1) % rest
    for r, s in enumerate(order):
        cls[s] = 1 + r % rest
    if other:
        cls[-1] = classes
    one = np.zeros((n, kinds))
    one[np.arange(n), cls] = 1
    g = one.T @ m @ one
    k = np.arange(kinds)
    while rounds is None or rounds > 0:
        rounds = None if rounds is None else rounds - 1
        moved = 0
        for s in order:
            out = np.bincount(cls, weights=m[s], minlength=kinds)
            into = np.bincount(cls, weights=m[:, s], minlength=kinds)
            loop, old = m[s, s], cls[s]
            out[old] -= loop
            into[old] -= loop
            g[old] -= out
            g[:, old] -= into
            g[old, old] -= loop
            rows, cols = g.sum(axis=1) + into, g.sum(axis=0) + out  # a class keeps its pairs with s wherever s goes
            f = _xlogx(g)
            grow_rows, grow_cols = _xlogx(g + out[None, :]) - f, _xlogx(g + into[:, None]) - f
            gain = grow_rows.sum(axis=1) - grow_rows[k, k] + grow_cols.sum(axis=0) - grow_cols[k, k]
            gain += _xlogx(g[k, k] + out + into + loop) - f[k, k]
            gain -= _xlogx(rows + out.sum() + loop) - _xlogx(rows) + _xlogx(cols + into.sum() + loop) - _xlogx(cols)
            gain[0] = -np.inf
            gain[classes:] = -np.inf
            best = int(gain.argmax())
            if gain[best] <= gain[old] + 1e-9:
                best = int(old)
            moved += best != old
            cls[s] = best
            g[best] += out
            g[:, best] += into
            g[best, best] += loop
        if not moved:
            break
    return cls


def best_classes(g: np.ndarray, word: np.ndarray, context: np.ndarray, n: np.ndarray, words: int) -> np.ndarray:
    """The class that raises the class bigram likelihood most for each of `words` words, given the core's class pairs `g`.

    The words' contexts: `word` (ascending), `context` (the class before it, or _KINDS and the class after it) and
    count `n`.  Contexts are classes of core words, so that one word's class does not depend on another's.
    """
    rows, cols = g.sum(axis=1), g.sum(axis=0)
    after, c = context >= _KINDS, context % _KINDS
    out, into = np.zeros((words, _KINDS)), np.zeros((words, _KINDS))
    np.add.at(out, (word[after], c[after]), n[after])
    np.add.at(into, (word[~after], c[~after]), n[~after])
    edge = np.where(after[:, None], g[:, c].T, g[c, :])  # each context's pairs with each class
    grow = _xlogx(edge + n[:, None]) - _xlogx(edge)
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    gain = np.zeros((words, _KINDS))
    gain[word[first]] = np.add.reduceat(grow, first, axis=0)
    r, s = rows + into, cols + out
    gain -= _xlogx(r + out.sum(axis=1, keepdims=True)) - _xlogx(r) + _xlogx(s + into.sum(axis=1, keepdims=True)) - _xlogx(s)
    return 1 + gain[:, 1:CLASSES].argmax(axis=1)


def _binary(cut: np.ndarray, data: np.ndarray) -> pa.Array:
    """A binary column of the items of `data` from each number of `cut` to the next."""
    return pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer((cut * data.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _items(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The items of such a column end to end (nulls are empty), and where each row's begin (one more than rows)."""
    data, size = [np.zeros(0, kind)], [np.zeros(1, np.int64)]
    for c in column.chunks:
        if len(c):
            c = c.fill_null(b"").cast(pa.binary())
            at = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64)
            size.append(np.diff(at) // np.dtype(kind).itemsize)
            if at[-1] > at[0]:
                data.append(np.frombuffer(c.buffers()[2], np.uint8)[at[0] : at[-1]].copy().view(kind))
    return np.concatenate(data), np.cumsum(np.concatenate(size))


def own_classes(docs: DataFrame, text_col: str, core, g: np.ndarray, min_count: int) -> DataFrame:
    """(h, cls): the class of every word outside the core that occurs `min_count` times or more, by its hash.

    A word's class is by the core classes before and after it, over all rows.  `core` is a broadcast of the core's
    sorted hashes and their classes.  Tasks fold the contexts of what they read before they are shuffled.
    """

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, cls = core.value
        held, size = [], 0

        def sent():
            h, before, after = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(h)
            h = h[order]
            new = np.r_[True, h[1:] != h[:-1]]
            base = (np.cumsum(new) - 1) * (2 * _KINDS)
            key, n = np.unique(np.concatenate([base + before[order], base + _KINDS + after[order]]), return_counts=True)
            word, packed = key // (2 * _KINDS), (n * 128 + key % (2 * _KINDS)).astype(np.uint32)
            h = h[new].view(np.int64)
            cut = np.searchsorted(word, np.arange(len(h) + 1))
            for i in range(0, len(h), 100_000):
                part = cut[i : i + 100_001]
                yield pa.RecordBatch.from_arrays([pa.array(h[i : i + 100_000]), _binary(part - part[0], packed[part[0] : part[-1]])], names=["h", "contexts"])

        for b in batches:
            for i, j, _, _, _, row, h in tokens(b.column(0)):
                at, known = places(hashes, h)
                seq = in_sequence(np.where(known, cls[at] if len(cls) else RARE, RARE).astype(np.uint8), row, j - i)
                mine = np.flatnonzero(~known)
                spot = mine + row[mine] + 1
                if len(mine):
                    held.append((h[mine], seq[spot - 1], seq[spot + 1]))
                    size += len(mine)
                if size > 4 * COUNTER_SIZE:
                    yield from sent()
                    held, size = [], 0
        if size:
            yield from sent()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["h"]):
            words, row = np.unique(t.column("h").to_numpy(), return_inverse=True)
            packed, at = _items(t.column("contexts"), np.uint32)
            key, where = np.unique(np.repeat(row, np.diff(at)) * (2 * _KINDS) + packed % 128, return_inverse=True)
            n = np.bincount(where, weights=packed // 128, minlength=len(key))
            word, context = key // (2 * _KINDS), key % (2 * _KINDS)
            count = np.bincount(word, weights=n * (context < _KINDS), minlength=len(words))  # each has one class before it
            cut, i = np.searchsorted(word, np.arange(len(words) + 1)), 0
            while i < len(words):
                j = max(i + 1, int(np.searchsorted(cut, cut[i] + CONTEXT_ROWS, "right")) - 1)
                part = slice(cut[i], cut[j])
                own = best_classes(g, word[part] - i, context[part], n[part], j - i)
                often = count[i:j] >= min_count
                yield pa.RecordBatch.from_arrays([pa.array(words[i:j][often]), pa.array(own[often].astype(np.int32))], names=["h", "cls"])
                i = j

    found = docs.select(F.col(text_col).cast("string")).mapInArrow(contexts, "h bigint, contexts binary")
    return found.repartition("h").sortWithinPartitions("h").mapInArrow(assign, "h bigint, cls int")


class Words:
    """The words of the rows learned from: their counts and classes, of which workers hold a bounded part.

    `counts` has all words (word, h, c, cls), `rest` those that are not held (word, c, cls); `hashes`, `c` and `cls`
    are of the held words, by hash.  `tokens_of` and `words_of` are how many tokens and words each class has, over
    all words.
    """

    def __init__(self, docs: DataFrame, text_col: str, min_count: int):
        sc = docs.sparkSession.sparkContext
        counts = checkpointed(word_counts(docs, text_col))
        often = F.col("c") >= min_count
        core = [np.uint64(r["h"] % 2**64) for r in counts.where(often).orderBy(F.desc("c"), "word").limit(CORE_WORDS).select("h").collect()]
        by_hash = np.sort(np.array(core, np.uint64))
        symbol = np.argsort(np.argsort(np.array(core, np.uint64))) + 1  # of the words by frequency: their places by hash
        pairs = pair_counts(docs, text_col, sc.broadcast((by_hash, np.arange(1, len(core) + 1), len(core) + 1)), len(core) + 2)
        by_frequency = np.r_[0, symbol, len(core) + 1].astype(np.int64)
        core_cls = np.empty(len(core) + 2, np.int64)
        core_cls[by_frequency] = exchange(pairs[np.ix_(by_frequency, by_frequency)], other=True)
        one = np.zeros((len(core) + 2, _KINDS))
        one[np.arange(len(core) + 2), core_cls] = 1

        own = own_classes(docs, text_col, sc.broadcast((by_hash, core_cls[1:-1].astype(np.uint8))), one.T @ pairs @ one, min_count)
        of_core = docs.sparkSession.createDataFrame(list(zip(by_hash.view(np.int64).tolist(), core_cls[1:-1].tolist(), strict=True)), "h bigint, cls int")
        rare = F.lit(RARE).alias("cls")
        classed = counts.where(often).join(own.union(of_core), "h", "left").select("word", "h", "c", F.coalesce("cls", rare).alias("cls"))
        classed = checkpointed(classed)
        seldom = counts.where(~often).select("word", "h", "c", rare)
        self.counts = classed.union(seldom)

        of = np.array([tuple(r) for r in self.counts.groupBy("cls").agg(F.sum("c"), F.count("*")).collect()], np.float64).reshape(-1, 3)
        self.tokens_of, self.words_of = np.zeros(_KINDS), np.zeros(_KINDS)
        self.tokens_of[of[:, 0].astype(int)], self.words_of[of[:, 0].astype(int)] = of[:, 1], of[:, 2]

        level = F.floor(F.log2("c") * 8).cast("int")
        least, held = 1 << 20, 0
        for l, n in sorted(((r[0], r[1]) for r in classed.groupBy(level.alias("l")).count().collect()), reverse=True):  # a few hundred levels
            if held + n > max(HELD_WORDS, CORE_WORDS):
                break
            least, held = l, held + n
        h, c, cls = _collected(classed.where(level >= least).select("h", "c", "cls"))  # HELD_WORDS at most
        hashes = h.view(np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.c, self.cls = hashes[order], c[order], cls[order].astype(np.uint8)
        self.rest = classed.where(level < least).union(seldom).select("word", "c", "cls")


def sequences(rows: DataFrame, text_col: str, words: Words) -> DataFrame:
    """Every row's other columns, and of its text: seq, the class of each word (a byte each); known, how many of
    them were learned; base and emit, the sums of log10(c + 1) and log10(c + EMIT_ADD) over them.

    Words that workers hold are looked up in place; for the others each row sends its distinct words once, with
    their places, to where their counts and classes are, and gets those back.
    """
    keep = [c for c in rows.columns if c != text_col]
    head = [f"{c} {sql_type(rows, c)}" for c in keep]
    local = ["seq binary", "known bigint", "base double", "emit double"]
    sent = rows.sparkSession.sparkContext.broadcast((words.hashes, words.c, words.cls))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, c, cls = sent.value
        logs = np.log10(c + 1.0), np.log10(c + EMIT_ADD)
        for b in batches:
            for i, j, raw, start, end, row, h in tokens(b.column(len(keep) + 1)):
                n = j - i
                at, held = places(hashes, h)
                kind = np.where(held, cls[at] if len(cls) else RARE, RARE).astype(np.uint8)
                got, spot = row[held], at[held]
                base, emit = (np.bincount(got, weights=x[spot], minlength=n) for x in logs)
                begin = np.r_[0, np.cumsum(np.bincount(row, minlength=n))]
                # The distinct words of each text that are not held, and where each stands.
                rest = np.flatnonzero(~held)
                rest = rest[np.lexsort((h[rest], row[rest]))]
                new = np.ones(len(rest), bool)
                new[1:] = (h[rest][1:] != h[rest][:-1]) | (row[rest][1:] != row[rest][:-1])
                first = np.flatnonzero(new)
                cut = pa.array(np.r_[0, np.cumsum(np.bincount(row[rest[first]], minlength=n))].astype(np.int32))
                word = pa.array([raw[s:e] for s, e in zip(start[rest[first]].tolist(), end[rest[first]].tolist(), strict=True)], pa.binary())
                spots = _binary(np.r_[first, len(rest)], (rest - begin[row[rest]]).astype(np.int32))
                left = pa.ListArray.from_arrays(cut, pa.StructArray.from_arrays([word, spots], names=["word", "spots"]))
                heads = [b.column(k).slice(i, n) for k in range(len(keep) + 1)]
                yield pa.RecordBatch.from_arrays([*heads, _binary(begin, kind), pa.array(np.bincount(got, minlength=n)), pa.array(base), pa.array(emit), left], names=[*keep, "row", *(x.split()[0] for x in local), "left"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["row"]):
            info = t.column("info").combine_chunks()
            info = pa.Table.from_arrays(info.filter(info.is_valid()).flatten(), names=[*keep, *(x.split()[0] for x in local)])  # one of each row, in their order
            row, c = np.unique(t.column("row").to_numpy(), return_inverse=True)[1], t.column("c").to_numpy()
            seq, begin = _items(info.column("seq"), np.uint8)
            spots, at = _items(t.column("spots"), np.int32)
            times = np.diff(at)
            seq[np.repeat(begin[row], times) + spots] = np.repeat(t.column("cls").to_numpy(), times)
            known, base, emit = (np.bincount(row, weights=times * x, minlength=info.num_rows) for x in (c > 0, np.log10(c + 1.0), np.log10(c + EMIT_ADD)))
            sums = [info.column(x).to_numpy() + y for x, y in (("known", known.astype(np.int64)), ("base", base), ("emit", emit))]
            yield from pa.Table.from_arrays([*(info.column(k) for k in keep), _binary(begin, seq), *map(pa.array, sums)], names=info.column_names).to_batches()

    done = rows.select(*keep, F.monotonically_increasing_id().alias("row"), text_col).mapInArrow(run, ", ".join([*head, "row bigint", *local, "left array<struct<word: binary, spots: binary>>"]))
    info = F.struct(*keep, *(x.split()[0] for x in local))
    # A row without such words still sends one, its own number, that stands nowhere.
    sends = done.select("row", info.alias("info"), F.posexplode_outer("left").alias("at", "w"))
    sends = sends.select("row", F.when(F.coalesce("at", F.lit(0)) == 0, F.col("info")).alias("info"), F.coalesce("w.word", F.col("row").cast("string").cast("binary")).alias("word"), F.col("w.spots").alias("spots"))
    got = sends.join(words.rest, "word", "left").select("row", "info", "spots", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("cls", F.lit(RARE)).alias("cls"))
    return got.repartition("row").sortWithinPartitions("row").mapInArrow(fill, ", ".join([*head, *local]))


def _class_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The classes of all texts of a column of `sequences`, ends before the first and after each, and the text of each token."""
    seq, begin = _items(pa.chunked_array([column]), np.uint8)
    size = np.diff(begin)
    row = np.repeat(np.arange(len(size)), size)
    return in_sequence(seq, row, len(size)).astype(np.int64), np.repeat(np.arange(len(size)), size + 1)


def class_moves(seqs: DataFrame) -> np.ndarray:
    """How often a token of each class precedes one of each class, over all rows of `sequences`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_KINDS * _KINDS, np.int64)
        for b in batches:
            seq, _ = _class_rows(b.column(0))
            total += np.bincount(seq[:-1] * _KINDS + seq[1:], minlength=len(total))
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(total[pair])], names=["pair", "n"])

    pair, n = _collected(seqs.select("seq").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")))
    out = np.zeros(_KINDS * _KINDS)
    out[pair] = n
    return out.reshape(_KINDS, _KINDS)


class ClassModel:
    """The classes' transitions and emissions, and the counts and classes of the held words. All parts have a fixed bound."""

    def __init__(self, words: Words, moves: np.ndarray):
        self.hashes, self.counts, self.cls = words.hashes, words.c, words.cls
        self.ends = int(moves[:, 0].sum())
        tokens_of, words_of = words.tokens_of.copy(), words.words_of.copy()
        tokens_of[0], words_of[0] = self.ends, self.ends > 0
        self.total, self.distinct = int(tokens_of.sum()), int(words_of.sum())
        self.log_base = math.log10(self.total + self.distinct + 1)
        moves = moves + MOVE_ADD
        self.move = np.log10(moves / moves.sum(axis=1, keepdims=True))
        # Of a class with n tokens and v words, each word has (c + a) / (n + a (v + 1)), words never seen the rest.
        self.log_class = np.log10(tokens_of + EMIT_ADD * (words_of + 1))


def fit(docs: DataFrame, text_col: str, min_count: int = MIN_COUNT) -> tuple[ClassModel, DataFrame]:
    """The model of all rows of `docs`, and their words' counts and classes (word, h, c, cls).

    The core's words get their classes by the exchange, in rounds until none moves.  Every other word that
    occurs `min_count` times or more gets the class that raises the same likelihood most, from how often it stands
    before and after core words of each class (other words are one class more there), however many such words
    there are.  Words that occur less are the class RARE, from which words never seen are expected.
    """
    words = Words(docs, text_col, min_count)
    return ClassModel(words, class_moves(sequences(docs.select(F.col(text_col).cast("string").alias("text")), "text", words))), words.counts


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2, min_count: int = MIN_COUNT) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every row.

    Learned from all rows outside fold `held_fold` (crc32 of the id's text, mod `folds`).  score is the
    log10 probability of the text: each token's class given the class before, times the token given its
    class.  A null or empty text is one token, the end.  Without rows to learn from, all counts are 0.  Very long
    texts are read whole, repeated rows give repeated results, and other columns may have any names.

    The classes of all texts (`sequences`) are made once; the transitions are counted in them, then they are scored.
    """
    rows, back = apart(docs.select(id_col, text_col))
    rows = rows.select(F.col(back[id_col]).alias("id"), F.col(back[text_col]).cast("string").alias("text")).withColumn("held_out", remainder("id", folds) == held_fold)
    words = Words(rows.where(~F.col("held_out")), "text", min_count)
    seqs = checkpointed(sequences(rows, "text", words))
    model = ClassModel(words, class_moves(seqs.where(~F.col("held_out"))))
    step = model.move - model.log_class
    ends, log_base = model.ends, model.log_base

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seq, of = _class_rows(b.column(2))
            n = b.num_rows
            size = np.bincount(of, minlength=n)
            known, base, emit = (b.column(k).to_numpy() for k in (3, 4, 5))
            whole = np.bincount(of, weights=step[seq[:-1], seq[1:]], minlength=n) + emit + math.log10(ends + EMIT_ADD)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size), pa.array(known + (ends > 0)), pa.array(base + math.log10(ends + 1) - size * log_base), pa.array(whole)], names=names)

    names = ["id", "held_out", "n_tokens", "n_known", "base_score", "score"]
    done = seqs.select("id", "held_out", "seq", "known", "base", "emit").mapInArrow(run, f"id {sql_type(rows, 'id')}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    out = done.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(model.total).cast("bigint").alias("train_tokens"), "base_score", "score")
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op10_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
