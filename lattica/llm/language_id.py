"""Language identification of words in code-switched text by a linear-chain conditional random field."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.llm.common import _BASE, apart, map_texts, mix64, remainder, table

#: Hashed features, words of each language's lexicon, and entries of a worker's table of words.
FEATURES, LEXICON, TABLE_SIZE = 1 << 17, 300, 500_000
#: Rows that are learned from at most, the same number of each language where there are so many, and the length of the
#: stretch that a longer one of them gives (None: all of it).
MAX_TRAINING_ROWS, TRAINING_STRETCH = 3_000, 50_000
#: Words of a piece of a long text; the pieces advance together.
PIECE = 512
#: Words that one pass of forward-backward holds; a longer single text is a pass of its own.
PASS_WORDS = 400_000


def _core(word: str) -> str:
    """A word in lower case without what is not a letter at its ends; empty if it has no letter."""
    i, j = 0, len(word)
    while i < j and not word[i].isalpha():
        i += 1
    while j > i and not word[j - 1].isalpha():
        j -= 1
    return word[i:j].lower()


def word_features(cores: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all words end to end, and the place of each word's first one.

    A word has affixes of one to four characters, n-grams of two and three with its two ends marked, the whole word
    and the lexicon that it is in.
    """
    n = len(cores)
    size = np.fromiter(map(len, cores), np.int64, n) + 2
    start = np.cumsum(size) - size
    c = np.frombuffer("".join([f"^{x}$" for x in cores]).encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    word = np.repeat(np.arange(n), size)
    place = np.arange(len(c)) - start[word]
    grams = [c]  # hashes of the 1 to 4 characters from each place on
    for k in range(1, 4):
        grams.append(np.concatenate([grams[-1][: len(c) - k] * _BASE + c[k:], np.zeros(k, np.uint64)]))
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(size.max()), _BASE)]))
    inside = size - 2
    affixes = np.minimum(4, inside)
    listed = np.fromiter((lexicon.get(x, -1) for x in cores), np.int64, n)
    count = 2 * affixes + (size - 1) + (size - 2) + 1 + (listed >= 0)
    first = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.int64)

    def put(at: np.ndarray, kind: int, h: np.ndarray) -> None:
        out[at] = mix64(h * _BASE + np.uint64(kind)) % np.uint64(FEATURES)

    for k in range(1, 5):
        w = np.flatnonzero(inside >= k)
        put(first[w] + k - 1, k, grams[k - 1][start[w] + 1])
        put(first[w] + affixes[w] + k - 1, 4 + k, grams[k - 1][start[w] + size[w] - 1 - k])
    at = first + 2 * affixes
    for k, kind in ((2, 9), (3, 10)):
        i = np.flatnonzero(place <= size[word] - k)
        put(at[word[i]] + place[i], kind, grams[k - 1][i])
        at = at + size - k + 1
    put(at, 11, np.add.reduceat(c * power[place], start))
    w = np.flatnonzero(listed >= 0)
    put(at[w] + 1, 12, listed[w].astype(np.uint64))
    return out, first


@dataclass
class Crf:
    """Weights of a linear-chain CRF over words: labels, emissions by feature, transitions, start, lexicon."""

    labels: list[str]
    emit: np.ndarray
    move: np.ndarray
    start: np.ndarray
    lexicon: dict[str, int]

    def emissions(self, cores: list[str]) -> np.ndarray:
        flat, first = word_features(cores, self.lexicon)
        return np.add.reduceat(self.emit[flat], first, axis=0)


def _carried(e: np.ndarray, first: np.ndarray, length: np.ndarray, seq: np.ndarray, t: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each piece (in order, `seq` names its sequence) the forward vector before its first word and the backward one at its last.

    What a piece does to them is a matrix each; only the product over the pieces is taken one by one.
    """
    n, k = len(first), len(s)
    ahead, back = np.ones((n, k)), np.ones((n, k))
    f, b = np.broadcast_to(np.eye(k), (n, k, k)).copy(), np.broadcast_to(np.eye(k), (n, k, k)).copy()
    starts = np.r_[True, seq[1:] != seq[:-1]]
    for x, of in ((f, np.r_[~starts[1:], False]), (b, ~starts)):  # all but a sequence's last piece, and all but its first
        which = np.flatnonzero(of)
        which = which[np.argsort(-length[which], kind="stable")]
        y, ends = x[which], length[which]
        for p in range(int(ends[0]) if len(which) else 0):
            j = int(np.searchsorted(-ends, -p, "left"))  # pieces longer than this place
            w = e[first[which[:j]] + p][:, None, :]
            y[:j] = (y[:j] * w) @ t if x is f else (y[:j] @ t) * w
            y[:j] /= y[:j].max(axis=(1, 2), keepdims=True)
        x[which] = y
    for i in range(n):
        v = s if starts[i] else ahead[i - 1] @ f[i - 1]
        ahead[i] = v / v.sum()
    for i in range(n - 2, -1, -1):
        if not starts[i + 1]:
            v = b[i + 1] @ back[i + 1]
            back[i] = v / v.sum()
    return ahead, back


def posteriors(emission: np.ndarray, size: np.ndarray, move: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Label probabilities of every word by forward-backward.

    `emission` holds the words of all sequences end to end; `size` (positive) their lengths.  Sequences are
    cut to pieces of PIECE words, which carry exact messages over; at each place all pieces that are that
    long advance together.
    """
    e = np.exp(emission - emission.max(axis=1, keepdims=True)).astype(np.float64)
    t, s = np.exp(move - move.max()), np.exp(start - start.max())
    pieces = -(-size // PIECE)
    seq = np.repeat(np.arange(len(size)), pieces)
    within = np.arange(len(seq)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = np.repeat(np.cumsum(size) - size, pieces) + within * PIECE
    length = np.minimum(PIECE, size[seq] - within * PIECE)
    ahead, back = _carried(e, first, length, seq, t, s)
    order = np.argsort(-length, kind="stable")
    first, length, ahead, back = first[order], length[order], ahead[order], back[order]
    active = np.searchsorted(-length, -np.arange(length[0]), "left")  # pieces longer than each place
    out = np.empty_like(e)
    a = None
    for p in range(length[0]):
        k = active[p]
        at = first[:k] + p
        a = (ahead if a is None else a[:k] @ t) * e[at]
        a /= a.sum(axis=1, keepdims=True)
        out[at] = a
    b = np.ones((0, len(s)))
    for p in range(length[0] - 1, -1, -1):
        k = active[p]
        at = first[:k] + p
        if p < length[0] - 1:
            b = (e[first[: len(b)] + p + 1] * b) @ t.T
            b /= b.sum(axis=1, keepdims=True)
        b = np.concatenate([b, back[len(b) : k]])
        out[at] *= b
    return out / out.sum(axis=1, keepdims=True)


def fit_crf(texts: list[str], labels: list[str], words: int = 40, sequences: int | None = None, epochs: int = 12, seed: int = 5, ridge: float = 1e-6) -> Crf:
    """Maximum likelihood on code-switched sequences that are put together from runs of the texts' words.

    The runs' lengths and their neighbours are random, so that words are learned in mixed company.  Then the
    transitions are learned once more from stretches of the texts as they stand, their words labelled by the
    field itself, so that they are those of the corpus.  There are as many sequences as texts, 2,500 at least.
    """
    names = sorted(set(labels))
    y_of = {x: i for i, x in enumerate(names)}
    rng = np.random.RandomState(seed)
    docs = [(c, y_of[l]) for t, l in zip(texts, labels, strict=True) if len(c := [x for w in t.split() if (x := _core(w))])]
    count = [Counter() for _ in names]
    for cores, y in docs:
        count[y].update(cores)
    lexicon: dict[str, int] = {}
    for y, c in enumerate(count):
        total = sum(c.values())
        for w, n in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            if all(n / total > 3 * o[w] / max(1, sum(o.values())) for z, o in enumerate(count) if z != y):
                lexicon[w] = y
    model = Crf(names, np.zeros((FEATURES, len(names)), np.float32), np.zeros((len(names), len(names))), np.zeros(len(names)), lexicon)
    if len(names) < 2 or not docs:
        return model
    sequences = max(2500, len(docs)) if sequences is None else sequences
    by_label = [[d for d, y in docs if y == k] for k in range(len(names))]
    by_label = [x or [["x"]] for x in by_label]
    seqs, tags = [], []
    for _ in range(sequences):
        s, g = [], []
        y = int(rng.randint(len(names)))
        while len(s) < words:
            d = by_label[y][rng.randint(len(by_label[y]))]
            n = int(rng.randint(4, 30))
            i = int(rng.randint(max(1, len(d) - n + 1)))
            s += d[i : i + n]
            g += [y] * len(d[i : i + n])
            if rng.rand() < 0.3:
                y = int(rng.randint(len(names)))
        seqs.append(s[:words])
        tags.append(g[:words])
    _learn(model, seqs, np.array(tags), epochs, rng, ridge)
    long = [d for d, _ in docs if len(d) >= words]
    if long:
        starts = [(d, int(rng.randint(len(d) - words + 1))) for d in (long[k] for k in rng.randint(len(long), size=sequences))]
        real = [d[i : i + words] for d, i in starts]
        flat = {w: i for i, w in enumerate(dict.fromkeys(w for s in real for w in s))}
        known = model.emissions(list(flat))
        p = posteriors(known[[flat[w] for s in real for w in s]], np.full(len(real), words), model.move, model.start)
        _learn(model, real, p.argmax(axis=1).reshape(len(real), words), max(1, epochs // 3), rng, ridge, moves_only=True)
    return model


def _learn(model: Crf, seqs: list[list[str]], y: np.ndarray, epochs: int, rng: np.random.RandomState, ridge: float, moves_only: bool = False) -> None:
    """Adam steps on the likelihood of sequences of one length with labels `y`; only transitions and start, where asked."""
    names, sequences = model.labels, len(seqs)
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for s in seqs for w in s))}
    features, first = word_features(list(vocabulary), model.lexicon)
    feats = np.split(features, first[1:])
    x = np.array([[vocabulary[w] for w in s] for s in seqs])
    m, v, step = {}, {}, 0
    for _ in range(epochs):
        order = rng.permutation(sequences)
        for part in np.array_split(order, max(1, sequences // 100)):
            xs, ys = x[part], y[part]
            used, inverse = np.unique(xs, return_inverse=True)
            flat = np.concatenate([feats[k] for k in used])
            lengths = np.array([len(feats[k]) for k in used])
            at = np.cumsum(lengths) - lengths
            e = np.add.reduceat(model.emit[flat], at, axis=0)[inverse.reshape(xs.shape)].astype(np.float64)
            g_e, g_t, g_s = _gradients(e, ys, model.move, model.start)
            steps = [("t", model.move, g_t, slice(None)), ("s", model.start, g_s, slice(None))]
            if not moves_only:
                words_g = np.stack([np.bincount(inverse.ravel(), weights=g_e[:, :, k].ravel(), minlength=len(used)) for k in range(len(names))], axis=1)
                active, spot = np.unique(flat, return_inverse=True)
                feat_g = np.stack([np.bincount(spot, weights=np.repeat(words_g[:, k], lengths), minlength=len(active)) for k in range(len(names))], axis=1)
                steps.append(("e", model.emit, feat_g + ridge * model.emit[active], active))
            step += 1
            for key, value, grad, rows in steps:
                m.setdefault(key, np.zeros_like(value)), v.setdefault(key, np.zeros_like(value))
                m[key][rows] = 0.9 * m[key][rows] + 0.1 * grad
                v[key][rows] = 0.99 * v[key][rows] + 0.01 * grad**2
                value[rows] -= 0.02 * (m[key][rows] / (1 - 0.9**step)) / (np.sqrt(v[key][rows] / (1 - 0.99**step)) + 1e-8)


def _gradients(e: np.ndarray, y: np.ndarray, move: np.ndarray, start: np.ndarray):
    """Gradients of the mean negative log-likelihood of sequences of one length, for emissions, transitions and start."""
    n, length, k = e.shape
    ex, t, s = np.exp(e - e.max(axis=2, keepdims=True)), np.exp(move), np.exp(start)
    a, b = np.empty_like(ex), np.ones_like(ex)
    a[:, 0] = s * ex[:, 0]
    a[:, 0] /= a[:, 0].sum(axis=1, keepdims=True)
    for p in range(1, length):
        a[:, p] = (a[:, p - 1] @ t) * ex[:, p]
        a[:, p] /= a[:, p].sum(axis=1, keepdims=True)
    for p in range(length - 2, -1, -1):
        b[:, p] = (ex[:, p + 1] * b[:, p + 1]) @ t.T
        b[:, p] /= b[:, p].sum(axis=1, keepdims=True)
    post = a * b
    post /= post.sum(axis=2, keepdims=True)
    g_t = np.zeros_like(move)
    for p in range(length - 1):
        pair = a[:, p, :, None] * t[None] * (ex[:, p + 1] * b[:, p + 1])[:, None, :]
        g_t += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    np.subtract.at(g_t, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    one = np.eye(k)[y]
    return (post - one) / n, g_t / n, (post[:, 0] - one[:, 0]).sum(axis=0) / n


class _Words(dict):
    """Row of each word in a table of emissions; row 0 is a word without letters. Emptied when it is full."""

    def __init__(self, model: Crf):
        super().__init__()
        self.model, self.rows, self.missing = model, np.zeros((1, len(model.labels)), np.float32), []

    def __missing__(self, word: str) -> int:
        core = _core(word)
        if not core:
            self[word] = 0
            return 0
        self.missing.append(core)
        self[word] = i = len(self.rows) + len(self.missing) - 1
        return i

    def filled(self) -> np.ndarray:
        if self.missing:
            parts = [self.model.emissions(self.missing[k : k + 20_000]) for k in range(0, len(self.missing), 20_000)]
            self.rows = np.concatenate([self.rows, *parts]).astype(np.float32)
            self.missing = []
        return self.rows

    def trim(self) -> None:
        if len(self) > TABLE_SIZE:
            self.clear()
            self.rows, self.missing = self.rows[:1], []


_TABLES: dict[int, _Words] = {}


def label_texts(texts: list[str], model: Crf, key: int | None = None) -> tuple[list[str], list[float], list[np.ndarray]]:
    """For each text its language, that language's mean probability over words with a letter, and all languages' means."""
    if not model.labels:
        return ["und"] * len(texts), [0.0] * len(texts), [np.zeros(0)] * len(texts)
    if key not in _TABLES or key is None:
        _TABLES.clear()
        _TABLES[key] = _Words(model)
    rows_of = _TABLES[key]
    langs, scores, means = ["und"] * len(texts), [0.0] * len(texts), [np.zeros(len(model.labels))] * len(texts)
    sizes = np.array([t.count(" ") + t.count("\n") + 1 for t in texts])  # roughly, to form passes
    order = np.argsort(-sizes, kind="stable")
    i = 0
    while i < len(order):
        part, total = [], 0
        while i < len(order) and (not part or total + sizes[order[i]] <= PASS_WORDS):
            part.append(order[i])
            total += sizes[order[i]]
            i += 1
        rows_of.trim()
        ids = [np.array([rows_of[w] for w in texts[k].split()], np.int64) for k in part]
        part = [(k, x) for k, x in zip(part, ids, strict=True) if x.any()]
        if not part:
            continue
        table_ = rows_of.filled()
        flat, size = np.concatenate([x for _, x in part]), np.array([len(x) for _, x in part])
        p = posteriors(table_[flat], size, model.move, model.start) * (flat > 0)[:, None]
        first = np.cumsum(size) - size
        mean = np.add.reduceat(p, first, axis=0) / np.add.reduceat((flat > 0).astype(np.float64), first)[:, None]
        best = mean.argmax(axis=1)
        for r, (k, _) in enumerate(part):
            langs[k], scores[k], means[k] = model.labels[best[r]], float(min(1.0, mean[r, best[r]])), mean[r]
    return langs, scores, means


def training_rows(rows: DataFrame, max_rows: int = MAX_TRAINING_ROWS, stretch: int | None = TRAINING_STRETCH) -> list[tuple[str, str]]:
    """(text, language) of at most `max_rows` of the rows (id, text, lang): of each language those of the lowest hashes, as many of each as there are.

    Rows of equal id and text count once.  Of more than `max_rows` languages the most frequent are learned.  A text
    longer than `stretch` gives a stretch of that length from a place that its hash picks.
    """
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_rows)
    count = {r["lang"]: r["n"] for r in counts.collect()}  # max_rows languages at most
    quota, left = 0, max_rows
    for k, n in enumerate(sorted(count.values())):  # the same number of each, as far as there are so many
        quota = max(quota, left // (len(count) - k))
        left -= min(n, quota)
    quota = max(1, quota)
    share = {lang: 2 * (quota + 50) / n for lang, n in count.items()}
    text, h = F.col("text"), F.col("h")
    if stretch:
        at = F.pmod(h, F.greatest(F.length(text) - stretch, F.lit(0)) + 1).cast("int") + 1
        text = F.when(F.length(text) > stretch, F.substring(text, at, F.lit(stretch))).otherwise(text)
    hashed = rows.withColumn("h", F.xxhash64(F.col("id").cast("string"), "text"))
    found: list = []
    while count:
        bound = rows.sparkSession.createDataFrame([(lang, int(min(2**63 - 1, -(2**63) + x * 2**64))) for lang, x in share.items()], "lang string, bound bigint")
        some = hashed.join(F.broadcast(bound), "lang").where(h <= F.col("bound"))  # a row for each language in `count`
        once = some.groupBy("lang", "h").agg(F.min(text).alias("text"))  # about twice the quota of each language
        first = F.row_number().over(W.partitionBy("lang").orderBy("h"))
        found = once.withColumn("r", first).where(F.col("r") <= quota).select("h", "lang", "text").collect()
        got = Counter(r["lang"] for r in found)
        short = [lang for lang, n in count.items() if got[lang] < min(n, quota) and share[lang] < 1]
        if not short:
            break
        share |= {lang: share[lang] * 4 for lang in short}
    return [(r["text"], r["lang"]) for r in sorted(found, key=lambda r: (r["h"], r["lang"], r["text"]))][:max_rows]


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, held: int = 0, max_rows: int = MAX_TRAINING_ROWS, stretch: int | None = TRAINING_STRETCH) -> DataFrame:
    """`id_col`, held_out, lang_pred and score of every row.

    The field is learned from rows outside fold `held` with a text and a language, at most `max_rows` of
    them (`training_rows`).  lang_pred is the language of the highest mean probability over the words (of
    equal ones the first in order), und (score 0) for a null or empty text, for one without a letter, and
    for all if nothing could be learned.  Very long texts are labelled whole.  Repeated rows give repeated
    results; other columns may have any names.
    """
    rows, back = apart(docs)
    rows = rows.select(F.col(back[id_col]).alias("id"), F.col(back[text_col]).cast("string").alias("text"), F.col(back[lang_col]).cast("string").alias("lang"))
    sample = training_rows(rows.where((remainder("id", folds) != held) & F.col("lang").isNotNull() & F.col("text").isNotNull()), max_rows, stretch)
    model = fit_crf([t for t, _ in sample], [l for _, l in sample])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES rows at most
    key = sent._jbroadcast.id()

    def label(texts: list[str]):
        return label_texts(texts, sent.value, key)[:2]

    out = map_texts(rows.withColumn("held_out", remainder("id", folds) == held), ["id", "held_out"], "text", label, "lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
