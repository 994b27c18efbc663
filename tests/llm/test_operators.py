"""Each operator against a plain version on a small table with odd rows."""

import hashlib
import math
import pathlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lattica.llm import bpe, class_lm, language_id, mixing, near_copies, pii, rule_ensemble
from lattica.llm import fingerprints as fingerprint_module
from lattica.llm import host_rules as host_rules_module
from lattica.llm.class_lm import score
from lattica.llm.fingerprints import BINS, edited_fingerprints, fingerprint_bins, fingerprints, likeness, packed
from lattica.llm.host_rules import host_rules, host_verdicts
from lattica.llm.language_id import Crf, fit_crf, identify, label_texts, posteriors
from lattica.llm.mixing import mix, mix_amounts, source_targets
from lattica.llm.piece_encoding import decode, encode, encoding_digests, round_trip
from lattica.llm.token_counts import token_counts

rng = random.Random(4)
VOCABULARY = {lang: ["".join(rng.choice(s) for _ in range(rng.randint(1, 3))) for _ in range(400)] for lang, s in {"aa": ["ka", "to", "mi", "re", "su"], "bb": ["brü", "schx", "ent", "ölz", "ung"], "cc": ["que", "llo", "ñar", "ción", "ez"]}.items()}


def prose(lang, n):
    return " ".join(rng.choice(VOCABULARY[lang]) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


def rows():
    out = []
    for k in range(60):
        lang = ["aa", "bb", "cc"][k % 3]
        out.append((k, prose(lang, rng.randint(12, 120)) + ("\nsecond line\n\nsecond line" if k % 7 == 0 else ""), lang, ["s1", "s2", "s3", None][k % 4]))
    base = out[3][1]
    for k in range(60, 70):  # near copies: a word changed here and there
        words = base.split(" ")
        words[rng.randrange(len(words))] = "changed"
        out.append((k, " ".join(words), "aa", "s1"))
    out += [(70, base, "aa", "s1"), (71, base, "aa", "s2"), (72, None, None, None), (73, "", "bb", "s2"), (74, " \n\t ", None, "s3"), (75, "one", "aa", "s1"), (76, "12 34 !!", "aa", "s1")]
    out += [(77, "日本語 😀 text\x00 with ▁ marks  and   runs ", "cc", "s3"), (78, "ab" * 60_000, "aa", "s1"), (79, prose("bb", 30_000), "bb", "s2"), (None, "a row without an id is a row", None, "s1")]
    out += [out[10], out[10], (80, prose("cc", 40) + " write to jo.doe@mail.example.org or +1 (555) 010-9999 from 10.0.0.300 or 192.168.1.77.", "cc", "s2")]
    return out


ROWS = rows()
SCHEMA = "doc_id bigint, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    # Columns that bear the names of results or of what operators make inside.
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("x") for c in ("n_tokens", "score", "size", "target", "fingerprint", "spans", "ids", "words", "chars", "start", "term", "node", "class_id", "n_chars", "held_out", "word", "c")}).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def whole(df):
    return Counter(tuple(r) for r in df.collect())


def texts():
    return [(r[0], r[1] or "") for r in ROWS]


WS = re.compile(r"[^\x20\x09-\x0D]+")


def test_token_counts(docs, empty):
    lib = bpe.load(bpe.model_path(None)).processor
    want = Counter((i, len(t.encode()), len(lib.encode(t)), len(lib.encode(t)) > 4096) for i, t in texts())
    assert whole(token_counts(docs)) == want
    assert token_counts(empty).count() == 0


def test_encoding_is_the_librarys(docs, empty):
    lib = bpe.load(bpe.model_path(None)).processor
    want = Counter()
    for i, t in texts():
        ids = lib.encode(t, add_bos=True, add_eos=True)
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()] += 1
    assert whole(encoding_digests(docs)) == want
    assert encoding_digests(empty).count() == 0
    back = Counter((r["doc_id"], r["text"]) for r in decode(encode(docs)).collect())
    assert back == Counter((i, lib.decode(lib.encode(t))) for i, t in texts())
    assert whole(round_trip(docs).select("doc_id", "ids", "text").withColumn("ids", F.size("ids"))) == whole(decode(encode(docs)).select("doc_id", F.size("ids").alias("ids"), "text"))


def test_merging_equals_the_library_on_random_strings():
    model = bpe.load(bpe.model_path(None))
    for _ in range(300):
        t = "".join(rng.choice("aabcdeinrst  .\n\tßé▁0190日<s>") for _ in range(rng.randint(0, 40)))
        ids = np.frombuffer(b"".join(map(model.encode, bpe.chunks(t))), "<u4").tolist()
        assert ids == model.processor.encode(t), t
        assert sum(map(model.count, bpe.chunks(t))) == len(ids)


def test_chunk_table_keeps_generations(monkeypatch):
    monkeypatch.setattr(bpe, "TABLE_SIZE", 4)
    seen = []
    t = bpe.ChunkTable(lambda k: seen.append(k) or len(k))
    assert [t[k] for k in ["a", "bb", "ccc", "a", "dddd", "e", "a", "x" * 99]] == [1, 2, 3, 1, 4, 1, 1, 99]
    assert seen.count("a") == 1


def plain_rules(t):
    w = WS.findall(t)
    lines = [x for x in t.split("\n") if WS.search(x)]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def plain_verdicts(rows, threshold=0.5):
    """Of rows (host, whether each rule fails): for each host the shrunk rate of each rule, by the definition."""
    out = defaultdict(list)
    hosts = sorted({h for h, _ in rows if h is not None})
    for rule in range(len(rows[0][1])):
        n, k = Counter(h for h, _ in rows if h is not None), Counter(h for h, f in rows if h is not None and f[rule])
        all_ = sum(n.values())
        m = sum(k.values()) / all_
        spread = sum(n[h] * (k[h] / n[h] - m) ** 2 for h in hosts) - m * (1 - m) * (len(hosts) - 1)
        room = all_ - sum(x * x for x in n.values()) / all_
        between = spread / room if room > 0 else 0.0
        s = min(max(m * (1 - m) / between - 1, 1.0), 1e6) if between > 0 else 1e6 if m * (1 - m) else 1.0
        for h in hosts:
            out[h].append((k[h] + m * s) / (n[h] + s))
    return out


@pytest.mark.parametrize("bound", [100_000, 1])
def test_host_rules(spark, docs, empty, monkeypatch, bound):
    monkeypatch.setattr(host_rules_module, "BROADCAST_HOSTS", bound)
    spam = [(900 + k, "buy now | " * 3 + "#$ " * k, None, "spam") for k in range(9)] + [(950, "a fine text of more than ten words stands here among the bad", None, "spam")]
    both = docs.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(spam, SCHEMA))
    rows, want = [(i, t or "", s) for i, t, _, s in ROWS + spam], Counter()
    facts = [plain_rules(t) for _, t, _ in rows]
    fails = [(x[0] < 10, 100 * x[4] > 20 * x[0], 10 * x[2] > x[1], 30 * x[3] > x[0]) for x in facts]
    rates = plain_verdicts([(s, f) for (_, _, s), f in zip(rows, fails, strict=True)])
    for (i, _, s), x, f in zip(rows, facts, fails, strict=True):
        base = f[0] or f[1]
        want[(i, *x, base, not base and not (s is not None and max(rates[s]) > 0.5), *(round(r, 9) for r in rates[s] or [-1] * 4))] += 1
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = host_rules(both).select(*names, *(F.round(F.coalesce(f"rate_{r}", F.lit(-1.0)), 9) for r in host_rules_module.RULES))
    assert whole(got) == want
    assert any(not k[7] and not k[6] for k in want)
    assert host_rules(empty).count() == 0


def test_host_verdicts_shrink(spark):
    many = [("bad", i % 10 < 9) for i in range(100)] + [("good", i % 10 < 1) for i in range(100)] + [("tiny", True)] + [("mid", i % 2 == 0) for i in range(100)] + [(None, True)]
    v = {r["host"]: r for r in host_verdicts(spark.createDataFrame(many, "host string, failed boolean"), "host", ["failed"]).collect()}
    assert set(v) == {"bad", "good", "tiny", "mid"}
    assert v["bad"]["host_rejected"] and not v["good"]["host_rejected"] and 0.5 < v["tiny"]["rate_failed"] < 0.95


def test_repeated_words_of_long_texts_agree(monkeypatch):
    r = random.Random(5)
    for n in (0, 4, 5, 6, 40, 400):
        words = [r.choice("abcd").encode() for _ in range(n)]
        short = host_rules_module.repeated_words(words)
        monkeypatch.setattr(host_rules_module, "LONG_TEXT", 0)
        assert host_rules_module.repeated_words(words) == short == plain_rules(" ".join(w.decode() for w in words))[4]
        monkeypatch.setattr(host_rules_module, "LONG_TEXT", 20_000)


def test_rule_ensemble_separates(spark):
    good = [(i, prose("aa", 80), 1) for i in range(0, 120)]
    bad = [(i, " ".join(w.upper() + "!!" for w in prose("bb", 80).split()), 0) for i in range(120, 200)]
    odd = [(300, None, None), (301, "", 1), (302, "x" * 100_000, None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in good + bad + odd], "doc_id bigint, text string, words string")
    labels = spark.createDataFrame([(i, q) for i, _, q in good + bad + odd], "doc_id bigint, quality int")
    out = {r["doc_id"]: r for r in rule_ensemble.classify(docs, labels).collect()}
    assert len(out) == 203 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out.values())
    held = [i for i, r in out.items() if r["held_out"] and i < 200]
    assert all((zlib.crc32(str(i).encode()) % 3 == 1) == r["held_out"] for i, r in out.items())
    assert held and all(out[i]["predicted"] == (i < 120) for i in held)
    kept = rule_ensemble.drop_low_quality(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in out.items() if r["predicted"] == 1}
    assert rule_ensemble.classify(docs.where("false"), labels).count() == 0
    assert {r["score"] for r in rule_ensemble.classify(docs, labels.where("false")).collect()} == {0.5}


def test_rules_are_sparse():
    r = np.random.RandomState(0)
    x = r.rand(2000, len(rule_ensemble.STATISTICS))
    y = ((x[:, 0] > 0.5) & (x[:, 3] <= 0.7)).astype(float)
    m = rule_ensemble.fit_rules(x, y)
    z = m.intercept + sum(w * rule.holds(x) for rule, w in m.weights)
    assert ((z > 0) == y).mean() > 0.97 and len(m.weights) < 60


def test_language_id(docs, empty, spark):
    more = spark.createDataFrame([(1000 + k, prose(lang, 40), lang, "s") for k, lang in enumerate(["aa", "bb", "cc"] * 60)], SCHEMA)
    both = docs.select("doc_id", "text", "lang", "source").unionByName(more)
    out = identify(both).join(both.withColumnRenamed("lang", "truth").select("doc_id", "truth"), "doc_id").collect()
    assert all(0 <= r["score"] <= 1 for r in out)
    held = [r for r in out if r["held_out"] and r["doc_id"] >= 1000]
    assert held and all(r["lang_pred"] == r["truth"] for r in held)
    und = {r["doc_id"] for r in identify(both).collect() if r["lang_pred"] == "und"}
    assert und == {72, 73, 74, 76}
    assert identify(empty).count() == 0


def test_words_of_code_switched_text_are_labelled():
    t = [prose(lang, 60) for lang in ("aa", "bb") for _ in range(30)]
    m = fit_crf(t, ["aa"] * 30 + ["bb"] * 30, sequences=600, epochs=6)
    assert m.move[0, 0] > m.move[0, 1] and m.move[1, 1] > m.move[1, 0]
    _, _, means = label_texts([prose("aa", 30) + " " + prose("bb", 10)], m)
    assert means[0] == pytest.approx([0.75, 0.25], abs=0.08)
    assert label_texts(["x"], Crf([], np.zeros((1, 0)), np.zeros((0, 0)), np.zeros(0), {}))[0] == ["und"]


def test_forward_backward_sums_over_all_paths():
    r = np.random.RandomState(1)
    size, k = [4, 3, 1], 3
    e, move, start = r.randn(8, k), r.randn(k, k), r.randn(k)
    got, at = posteriors(e, np.array(size), move, start), 0
    for n in size:
        p = np.zeros((n, k))
        for path in np.ndindex(*[k] * n):
            w = math.exp(start[path[0]] + sum(move[a, b] for a, b in zip(path, path[1:], strict=False)) + sum(e[at + i, y] for i, y in enumerate(path)))
            for i, y in enumerate(path):
                p[i, y] += w
        assert np.allclose(got[at : at + n], p / p.sum(axis=1, keepdims=True))
        at += n


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(v - 9 if v > 9 else v for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def test_pii_base_spans(spark, docs, empty):
    bits = ["a", "b.", "@", ".", "x@y.z", "+", "1", "23", "255", "256", ".1.2", " ", "-", "4111 1111 1111 1111", "4111-1111", "(55)", "é", "😀", "%", "_", "\n", "0" * 5]
    cases = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(1500)] + ["7" * 30_000, "1 " * 30_000, "a" * 50_000 + "@", "a@b" + ".c" * 30_000, "1.2.3.4.5.6.7.8", "a@b@c.d", "a@b.c._x@d.e", "a@b.c.@d.e"]
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id bigint, text string")
    got = {r["doc_id"]: [(x["kind"], x["start"], x["end"]) for x in r["s"]] for r in df.select("doc_id", pii.base_spans(F.col("text")).alias("s")).collect()}
    for i, t in enumerate(cases):
        assert got[i] == [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, t) if valid(k, m[0])], t[:200]
    assert pii.find_pii(docs).count() == len(ROWS) and pii.find_pii(empty).count() == 0
    assert whole(pii.sanitise(docs).where("doc_id <> 80").select("doc_id", "text")) == Counter((r[0], r[1]) for r in ROWS if r[0] not in (80, None))
    assert pii.sanitise(docs).where("doc_id = 80").first()["text"].endswith("write to [email] or [phone] from 10.0.0.300 or [ip].")


def test_pii_revealing_terms(spark):
    rest = [(i, prose("aa", 30)) for i in range(60)]
    told = [(100 + i, prose("aa", 8) + f" zorbington hotline jo@ex.org {prose('aa', 8)}") for i in range(5)]
    plain = [(200, "a zorbington of nothing " + prose("aa", 10)), (201, None), (202, "")]
    hot = [(300 + i, f"qwertz unique near al@ex.org {i % 1}") for i in range(40)]  # one text, often: no support
    df = spark.createDataFrame(rest + told + plain + hot, "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: [(x["kind"], r["text"][x["start"] : x["end"]]) for x in r["pii_spans"]] for r in pii.find_pii(df).collect()}
    for i in range(5):
        assert ("removed", "hotline") in got[100 + i] and ("term", "zorbington") in got[100 + i] and ("email", "jo@ex.org") in got[100 + i]
    assert not any(got[i] for i, _ in rest + plain) and got[300] == [("email", "al@ex.org")]
    assert "zorbington" not in pii.sanitise(df).where("doc_id = 100").first()["text"]


def pii_found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    return {r["doc_id"]: [(x["kind"], r["text"][x["start"] : x["end"]]) for x in r["pii_spans"]] for r in pii.find_pii(df).collect()}


def test_pii_terms_of_values_that_stand_in_one_text(spark):
    told = [f"{prose('aa', 8)} hotline person{'xyz'[k]}@one.example {prose('aa', 8)}" for k in range(3)]
    got = pii_found(spark, told + [prose("aa", 30) for _ in range(60)])
    assert all(("removed", "hotline") in got[k] for k in range(3)) and not any(got[k] for k in range(3, 63))


def test_pii_copies_count_once(spark):
    told = [f"{prose('aa', 8)} hotline jo@ex.org {prose('aa', 8)}" for _ in range(4)]
    got = pii_found(spark, told + [told[0]] * 200 + [prose("aa", 30) for _ in range(100)])
    assert all(("removed", "hotline") in got[k] for k in range(204))


def test_pii_terms_in_the_whole_text(spark):
    told = [f"{prose('aa', 8)} hotline jo@ex.org {prose('aa', 8)}" for _ in range(4)]
    far = f"Hotline {prose('aa', 60)} jo@ex.org {prose('aa', 60)} HOTLINE hotlines"
    got = pii_found(spark, [*told, far, *(prose("aa", 30) for _ in range(60))])
    assert [s for s in got[4] if s[1].lower().startswith("hot")] == [("removed", "Hotline"), ("removed", "HOTLINE")]


def plain_pii(texts):
    """Spans of each text by the definition: base spans, then the revealing terms'."""
    term = re.compile(r"[^\W\d_]{2,}")
    base = [[(k, m.start(), m.end(), m[0]) for k, p in PATTERNS.items() for m in re.finditer(p, t) if valid(k, m[0])] for t in texts]

    def entities(spans):
        for k, _, _, s in spans:
            d = re.sub("[^0-9]", "", s)
            group = {"email": s.rsplit("@", 1)[-1].lower(), "ip": ".".join(s.split(".")[:2]), "card": d[:6], "phone": d[:4]}[k]
            yield from (("value", s), ("group", k, group), ("kind", k))

    of = {t: (set(entities(b)), {m[0].lower() for m in term.finditer(t)}) for t, b in zip(texts, base, strict=True)}
    n, n_e, n_t, n_te = len(of), Counter(), Counter(), Counter()
    for e, w in of.values():
        n_e.update(e)
        n_t.update(w)
        n_te.update((x, y) for x in e for y in w)
    shares = {(e, w): math.log2(n * c / (n_t[w] * n_e[e])) / max(1e-9, math.log2(n / n_e[e])) for (e, w), c in n_te.items() if c >= 2}
    out = []
    for t, b in zip(texts, base, strict=True):
        kind = {}
        for e in of[t][0]:
            for w in of[t][1]:
                if shares.get((e, w), 0) >= 0.8:
                    kind[w] = min(kind.get(w, "term"), "removed" if shares[e, w] >= 0.95 else "term")
        free = [m for m in term.finditer(t) if m[0].lower() in kind and not any(y < m.end() and m.start() < z for _, y, z, _ in b)]
        out.append([(k, y, z) for k, y, z, _ in b] + sorted((kind[m[0].lower()], m.start(), m.end()) for m in free))
    return out


@pytest.mark.parametrize("keys", [500_000, 1])
def test_pii_equals_a_plain_version(spark, monkeypatch, keys):
    monkeypatch.setattr(pii, "BROADCAST_KEYS", keys)
    r = random.Random(3)
    contact = ["jo@ex.org", "al@ex.org", "10.0.0.7", "10.0.9.9", "+1 (555) 010-9999", "4111 1111 1111 1111", "my line", "nothing"]
    texts = [f"{prose('aa', r.randint(1, 12))} {r.choice(['Desk', 'agent', 'of', 'été'])} {r.choice(contact)} {prose('bb', r.randint(1, 6))} {r.choice(contact)}" for _ in range(150)]
    texts += [f"{prose('cc', 9)} plain" for _ in range(150)] + texts[:5] + ["", "x@y.z " * 300 + "deskline"] + ["4111 1111 1111 1111 10.0.0.7@a.b"] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: [tuple(x) for x in r["pii_spans"]] for r in pii.find_pii(df).collect()}
    want = plain_pii(texts)
    assert [got[k] for k in range(len(texts))] == want
    assert sum(k[0] in ("term", "removed") for w in want for k in w) > 20
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    for k, (t, spans) in enumerate(zip(texts, want, strict=True)):
        text, at = "", 0
        for start, last, kind in sorted((y, -z, x) for x, y, z in spans):
            if start >= at:
                text += t[at:start] + ("" if kind == "removed" else f"[{kind}]")
            at = max(at, -last)
        assert clean[k] == text + t[at:]


def test_pii_digests(spark, tmp_path):
    texts = [f"mail jo{k}@ex.org or 10.0.0.{k} {prose('aa', 5)}" for k in range(300)] + ["", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in pii.op5_pii(spark, str(tmp_path)).collect():
        t = texts[r["doc_id"]] or ""
        base = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, t) if valid(k, m[0])]
        listed = ",".join(f"{k}:{y}:{z}" for k, y, z in base)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest() and r["spans"].startswith(listed)
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(b[0] == k for b in base) for k in PATTERNS]


def test_located_is_near_linear(spark):
    import time

    took = []
    for n in (20_000, 40_000):
        df = spark.createDataFrame([(" ".join(f"u{i}@ex{i}.org" for i in range(n)),)], "text string").cache()
        df.count()
        start = time.time()
        assert len(df.select(pii.located(F.col("text"), PATTERNS["email"].replace("(", "(?:")).alias("s")).first()["s"]) == n
        took.append(time.time() - start)
    assert took[1] < 8


def plain_mix(rows, most=3):
    """(id, size, source_size, target, taken) of rows (id, text, source), and the words the mix takes of each text, by the definition."""
    size = [len(WS.findall(t or "")) for _, t, _ in rows]
    by = defaultdict(int)
    for (_, _, s), n in zip(rows, size, strict=True):
        by[s] += n
    order = sorted((s for s in by if s is not None)) + ([None] if None in by else [])
    weight, total = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, sum(by.values())
    capped = set()
    while True:
        free = [s for s in order if s not in capped]
        left, w = total - sum(most * by[s] for s in capped), sum(weight[s] for s in free)
        target = {s: most * by[s] if s in capped else left * weight[s] / w for s in order}
        over = {s for s in free if target[s] > most * by[s]}
        if not over:
            break
        capped |= over
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    key = [int(md5(f"17|{'' if i is None else i}|{md5(t or '')}")[:15], 16) for i, t, _ in rows]
    taken = [0] * len(rows)
    for s in order:
        epochs, rest = divmod(int(target[s]), by[s]) if by[s] else (0, 0)
        mine = defaultdict(list)
        for k, r in enumerate(rows):
            if r[2] == s:
                mine[key[k]].append(k)
        before = 0
        for x in sorted(mine):
            words = sum(size[k] for k in mine[x])
            for k in mine[x]:
                taken[k] = epochs * size[k] + (size[k] if before + words <= rest else min(size[k], (rest - before) // len(mine[x])) if before < rest else 0)
            before += words
    return [(r[0], size[k], by[r[2]], round(target[r[2]], 6), taken[k]) for k, r in enumerate(rows)]


@pytest.mark.parametrize(("ranges", "sources"), [(4000, 100_000), (3, 1)])
def test_mixing(docs, empty, monkeypatch, ranges, sources):
    monkeypatch.setattr(mixing, "RANGE_ROWS", ranges)
    monkeypatch.setattr(mixing, "GROUP_RANGES", 2)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", sources)
    want = plain_mix([(r[0], r[1], r[3]) for r in ROWS])
    out = mix_amounts(docs).collect()
    assert Counter((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in out) == Counter(want)
    assert all(t <= 3 * n for _, n, _, _, t in want)
    mixed = mix(docs)
    assert mixed.columns == docs.columns
    got, taken = Counter(), Counter()
    for r in mixed.collect():
        got[r["source"]] += len(WS.findall(r["text"]))
    for r, x in zip(ROWS, want, strict=True):
        taken[r[3]] += x[4]
    assert got == taken
    assert mix_amounts(empty).count() == 0 and mix(empty).count() == 0


def test_targets_of_many_sources(spark):
    df = spark.createDataFrame([(f"h{k:03d}", 10 + k % 17) for k in range(200)] + [(None, 5), ("h999", 0)], "source string, source_size bigint")
    t = {r["source"]: (r["source_size"], r["target"]) for r in source_targets(df.repartition(8)).collect()}
    assert sum(x for _, x in t.values()) == pytest.approx(sum(s for s, _ in t.values()))
    assert all(x <= 3 * s + 1e-9 for s, x in t.values())
    free = {k: x for k, (s, x) in t.items() if x < 3 * s - 1e-9}
    rank = {k: i for i, k in enumerate(sorted(x for x in t if x is not None))}
    assert len({round(x / (5, 2, 1)[rank[k] % 3], 9) for k, x in free.items() if k is not None}) == 1


def shingle_set(t):
    w = WS.findall(t)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain_classes(rows):
    sets, n = [shingle_set(t) for _, t in rows], len(rows)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * n
    for i in range(n):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or a and b and len(a & b) >= 0.8 * len(a | b) - 1e-12:
                links[i], links[j] = links[i] + 1, links[j] + 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    key = [2**63 - 1 if i is None else i for i, _ in rows]
    least = defaultdict(lambda: 2**63 - 1)
    for i in range(n):
        least[find(i)] = min(least[find(i)], key[i])
    return Counter((rows[i][0], least[find(i)], links[i]) for i in range(n))


@pytest.mark.parametrize("block", [2048, 4])
def test_near_copies(spark, docs, empty, monkeypatch, block):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    group = []
    base = prose("aa", 150).split()
    for k in range(40):  # a chain in which ends are no longer alike
        base[(k * 3) % 150] = f"w{k}"
        group.append((500 + k, " ".join(base)))
    rows = [*texts(), *group, (12, prose("bb", 30))]  # an id twice, with different texts
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert whole(near_copies.near_copies(df)) == plain_classes(rows)
    assert near_copies.near_copies(empty).count() == 0
    kept = near_copies.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({None if c == 2**63 - 1 else c: 1 for _, c, _ in plain_classes(texts())})


def test_posterior_bounds():
    for k, m in enumerate(near_copies.least_matches()):
        n = (k + 1) * near_copies.LOOK
        tail = lambda m: sum(math.comb(n + 1, i) * 0.8**i * 0.2 ** (n + 1 - i) for i in range(m + 1))
        assert tail(m) >= near_copies.TOLERANCE > tail(m - 1)


def test_links_by_products_and_by_pairs_agree():
    r = np.random.RandomState(2)
    pool = r.randint(0, 2**63, 400, dtype=np.int64).astype(np.uint64)
    sets = [np.unique(np.concatenate([pool[: r.randint(250, 400)], r.randint(0, 2**62, 10, dtype=np.int64).astype(np.uint64)])) for _ in range(60)]
    at = np.cumsum([0, *map(len, sets)])
    sig = near_copies.minhashes(np.concatenate(sets), at)
    jac = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    i, j = np.triu_indices(60, 1)
    truth = np.array([jac(sets[x], sets[y]) >= 0.8 for x, y in zip(i, j, strict=True)])
    assert 0 < truth.sum() < len(truth) and (near_copies.verified(sets, i, j) == truth).all()
    assert [near_copies.verified(sets, i[k : k + 1], j[k : k + 1])[0] for k in range(0, len(i), 20)] == truth[::20].tolist()
    # Every pair goes on at its first common band and at no other.
    bands, size = near_copies._bands(sig), np.array(list(map(len, sets)), float)
    met = Counter()
    for k in range(near_copies.BANDS):
        met.update(zip(*near_copies.prune(sig, bands, size, i, j, np.full(len(i), k)), strict=True))
    assert set(met.values()) == {1} and set(met) >= {p for p, t in zip(zip(i, j, strict=True), truth, strict=True) if t}


def test_chains_join_what_links_join():
    links = [(1, 9), (9, 4), (2, 3), (4, 1), (7, 3), (3, 2)]
    got = near_copies._chains(np.array([a for a, _ in links]), np.array([b for _, b in links]))
    assert sorted(got) == [(1, 4), (2, 3), (3, 7), (4, 9)]


@pytest.mark.parametrize("some", [["two words"], ["a", "b c"], ["", "a b", None], ["a b c d e", "a b c d"], []])
def test_near_copies_of_few_words(spark, some):
    rows = list(enumerate(some))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert whole(near_copies.near_copies(df)) == plain_classes([(i, t or "") for i, t in rows])
    assert near_copies.drop_near_copies(df).count() == len({t or "" for t in some})


def test_short_texts_between_long_ones(spark, monkeypatch):
    from lattica.llm import common

    monkeypatch.setattr(common, "PASS_BYTES", 64)
    assert [(i, j) for i, j in common.passes(np.array([0, 3, 200, 203, 400]), 64)] == [(0, 1), (1, 2), (2, 3), (3, 4)]
    value, at = near_copies.shingles(np.frombuffer(b"a b", np.uint8), np.array([0, 3]))
    assert len(value) == 1 and at.tolist() == [0, 1]


def test_near_copies_with_null_ids(spark):
    base = prose("aa", 120).split()
    rows = []
    for _ in range(60):
        w = list(base)
        w[rng.randrange(len(w))] = f"v{rng.random()}"
        rows.append((None, " ".join(w)))
    rows += rows[:20]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert whole(near_copies.near_copies(df)) == plain_classes(rows)
    assert near_copies.drop_near_copies(df).count() == 1


def test_near_copies_write_no_texts_and_each_link_once(spark, monkeypatch):
    written, write = [], near_copies.checkpointed
    monkeypatch.setattr(near_copies, "checkpointed", lambda df: written.append(write(df)) or written[-1])
    base, rows = prose("aa", 150).split(), []
    for k in range(40):
        base[(k * 3) % 150] = f"w{k}"
        rows.append((k, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert whole(near_copies.near_copies(df)) == plain_classes(rows)
    assert not [d.columns for d in written if "text" in d.columns]
    found = [d for d in written if d.columns == ["a", "b", "n"]]
    assert [d.count() for d in found] == [d.select("a", "b").distinct().count() for d in found] and found[0].count() > 40


def test_recall_over_ten_thousand_texts(spark):
    """Near copies of all degrees against an exact count by an index of shingles."""
    r = random.Random(11)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(5000)]
    rows = []
    while len(rows) < 10_000:
        base = [r.choice(words) for _ in range(r.randint(20, 120))]
        for _ in range(r.choice([1, 1, 2, 4])):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(words)
            rows.append((len(rows), " ".join(w)))
    sets, holders = [shingle_set(t) for _, t in rows], defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    common = Counter((a, b) for h in holders.values() for k, a in enumerate(h) for b in h[k + 1 :])
    links = Counter(x for (a, b), n in common.items() if n >= 0.8 * len(sets[a] | sets[b]) - 1e-12 for x in (a, b))
    got = {r["doc_id"]: r["n_links"] for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert sum(links.values()) > 3000 and got == {i: links[i] for i in range(len(rows))}


def plain_bins(t):
    """The bins of a text by the definition, with the published xxHash of words and of their runs."""
    words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WS.findall(t)]
    if not words:
        return []

    def run(part):
        h = 42
        for x in part:
            h = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), h)
        return h

    filled = {}
    for i in range(max(1, len(words) - 4)):
        x = run(words[i : i + 5])
        filled[x >> 57] = min(filled.get(x >> 57, 2**64), x)
    r = random.Random(20240607)
    donors = [r.sample([j for j in range(BINS) if j != i], BINS - 1) for i in range(BINS)]
    return [(filled[i] if i in filled else filled[next(j for j in donors[i] if j in filled)]) & 255 for i in range(BINS)]


@pytest.mark.parametrize("size", [16 << 20, 4000])
def test_fingerprints(spark, docs, empty, monkeypatch, size):
    monkeypatch.setattr(fingerprint_module, "RANGE_BYTES", size)
    nulls = [(None, prose("aa", 40)) for _ in range(40)] + [(None, "a row without an id is a row")] * 30
    some = docs.select("doc_id", "text").unionByName(spark.createDataFrame(nulls, "doc_id bigint, text string"))
    signed = lambda x: x - 2**64 if x >> 63 else x
    keyed = sorted(((i, t or "") for i, t in [*texts(), *nulls]), key=lambda r: (r[0] is None, r[0] or 0, signed(xxhash.xxh64_intdigest(r[1].encode(), 42))))
    hexed = lambda b: "".join(f"{x:02x}" for x in b)

    def alike(a, b):
        if not a or not b:
            return float(not a and not b)
        return max(0.0, (sum(x == y for x, y in zip(a, b, strict=True)) / BINS - 1 / 256) / (1 - 1 / 256))

    want = Counter()
    for k, (i, t) in enumerate(keyed):
        nxt, cut = keyed[(k + 1) % len(keyed)][1], len(t) // 4
        edited = t[: len(t) - cut] + nxt[:cut]
        a, b, c = plain_bins(t), plain_bins(edited), plain_bins(nxt)
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), hexed(a), hexed(b), round(alike(a, b), 9), round(alike(a, c), 9)] += 1
    out = edited_fingerprints(some)
    assert Counter((*r[:5], round(r[5], 9), round(r[6], 9)) for r in out.collect()) == want
    if size == 4000:
        rows = some.select(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("place"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"), F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("bytes"))
        of = rows.withColumn("r", fingerprint_module._ranges(rows))
        assert of.select("r").distinct().count() > 5 and of.where(F.col("place") == 2**63 - 1).select("r").distinct().count() > 1
        return
    by_text = defaultdict(set)
    for r in fingerprints(docs).collect():
        by_text[r["text"] or ""].add(r["fingerprint"])
        assert len(r["fingerprint"]) == (2 * BINS if WS.search(r["text"] or "") else 0)
    assert all(len(v) == 1 for v in by_text.values())
    assert edited_fingerprints(empty).count() == 0
    one = edited_fingerprints(spark.createDataFrame([(1, "a b c d e f g h")], "doc_id bigint, text string")).first()
    assert one["near_next"] == 1.0 and one["n_chars"] == 15


def test_fingerprint_likeness_is_unbiased(spark):
    rows = []
    for _ in range(60):
        w = [f"w{rng.random()}" for _ in range(400)]
        rows.append((" ".join(w), " ".join(w[:200] + [f"v{rng.random()}" for _ in range(200)])))
    df = spark.createDataFrame(rows, "a string, b string")
    mean = df.select(F.avg(likeness(fingerprint_bins(F.col("a")), fingerprint_bins(F.col("b")))).alias("m")).first()["m"]
    assert mean == pytest.approx(196 / 596, abs=0.03)
    assert df.select(packed(fingerprint_bins(F.lit("x y z"))).alias("p")).first()["p"] == df.select(packed(fingerprint_bins(F.lit("x  y\nz"))).alias("p")).first()["p"]


def plain_tokens(t):
    return [*WS.findall("".join(c.lower() if c < "\x80" else c for c in t)), None]


def plain_model(train, cls):
    """log10 probability of a text by the definition, from the training texts and the words' classes (None is the end)."""
    count = Counter(w for t in train for w in plain_tokens(t))
    kind = lambda w: 0 if w is None else cls.get(w, class_lm.RARE)
    moves = Counter()
    last = 0
    for t in train:
        for w in plain_tokens(t):
            moves[last, kind(w)] += 1
            last = kind(w)
    leaving, kinds = Counter(), class_lm.CLASSES + 1
    for (a, _), n in moves.items():
        leaving[a] += n
    tokens, words = Counter(), Counter()
    for w, n in count.items():
        tokens[kind(w)] += n
        words[kind(w)] += 1

    def of(t):
        total, last = 0.0, 0
        for w in plain_tokens(t):
            k = kind(w)
            total += math.log10((moves[last, k] + 0.5) / (leaving[last] + 0.5 * kinds)) + math.log10((count[w] + 0.5) / (tokens[k] + 0.5 * (words[k] + 1)))
            last = k
        return total

    return of


@pytest.mark.parametrize(("held", "core"), [(1_000_000, 1000), (300, 50)])
def test_class_lm(spark, docs, empty, monkeypatch, held, core):
    monkeypatch.setattr(class_lm, "HELD_WORDS", held)
    monkeypatch.setattr(class_lm, "CORE_WORDS", core)
    train = [t for i, t in texts() if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(w for t in train for w in plain_tokens(t))
    n, v = sum(count.values()), len(count)
    # The words' classes as fitted, by their hashes.
    model, counts = class_lm.fit(docs.where("doc_id is null or pmod(crc32(cast(doc_id as string)), 7) <> 2").repartition(1).sortWithinPartitions("doc_id"), "text")
    at = {int(h): k for k, h in enumerate(model.hashes)}
    cls = {bytes(r["word"]).decode(): int(model.cls[at[r["h"] % 2**64]]) for r in counts.collect() if r["h"] % 2**64 in at}
    assert len(cls) == len(model.hashes) <= held and all(0 < k < class_lm.CLASSES for k in cls.values())
    if held > v:
        assert set(cls) == {w for w, c in count.items() if c >= 2 and w is not None}
    got = Counter()
    rows = docs.repartition(1).sortWithinPartitions("doc_id")
    out = score(rows).collect()
    for r in out:
        got[r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)] += 1
        assert r["score"] < 0 and r["perplexity"] > 1
    want = Counter((i, len(plain_tokens(t)), sum(count[w] > 0 for w in plain_tokens(t)), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in plain_tokens(t)), 6)) for i, t in texts())
    assert got == want
    if held > v:
        plain = plain_model([t for i, t in sorted(texts(), key=lambda r: (r[0] is not None, r[0] or 0)) if i is None or zlib.crc32(str(i).encode()) % 7 != 2], cls)
        by_id = defaultdict(list)
        for i, t in texts():
            by_id[i].append(plain(t))
        for r in out:
            assert any(r["score"] == pytest.approx(x, rel=1e-9) for x in by_id[r["doc_id"]])
    assert score(empty).count() == 0


@pytest.mark.parametrize("held", [0, 300])
def test_words_beyond_those_held_keep_their_classes(spark, docs, monkeypatch, held):
    """The model and every row's score are the same whatever part of the words workers hold."""
    monkeypatch.setattr(class_lm, "CORE_WORDS", 50)
    train = docs.where("doc_id is null or pmod(crc32(cast(doc_id as string)), 7) <> 2")
    whole, _ = class_lm.fit(train, "text")
    want = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in score(docs).collect())
    monkeypatch.setattr(class_lm, "HELD_WORDS", held)
    part, _ = class_lm.fit(train, "text")
    assert len(part.hashes) <= max(held, 50) < len(whole.hashes)
    assert np.allclose(part.move, whole.move) and np.allclose(part.log_class, whole.log_class)
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in score(docs).collect())
    for a, b in zip(got, want, strict=True):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], abs=1e-5)


def test_class_lm_is_a_distribution(spark):
    df = spark.createDataFrame([(i, " ".join(rng.choice(["red", "blue", "cat", "dog", "x1", "y2"]) for _ in range(6)) + f" u{i}") for i in range(80)], "doc_id bigint, text string")
    model, counts = class_lm.fit(df, "text")
    assert np.allclose((10**model.move).sum(axis=1), 1)
    at = {int(h): k for k, h in enumerate(model.hashes)}
    total = defaultdict(float)
    for r in counts.collect():
        k = at.get(r["h"] % 2**64)
        total[class_lm.RARE if k is None else model.cls[k]] += r["c"] + class_lm.EMIT_ADD
    assert class_lm.RARE in total and len(total) > 1
    for k, x in total.items():
        assert (x + class_lm.EMIT_ADD) / 10 ** model.log_class[k] == pytest.approx(1)


def test_words_outside_the_core_join_their_kind(spark, monkeypatch):
    """Over 10,000 words of two kinds that take turns, nearly all outside the core, fall into classes of one kind."""
    monkeypatch.setattr(class_lm, "CORE_WORDS", 60)
    r = random.Random(9)
    kinds = [[f"{k}{i}" for i in range(6000)] for k in "ab"]
    pick = lambda k: kinds[k][int(6000 * r.random() ** 2)]
    df = spark.createDataFrame([(i, " ".join(pick(j % 2) for j in range(60))) for i in range(3000)], "doc_id bigint, text string")
    model, counts = class_lm.fit(df, "text")
    at = {int(h): k for k, h in enumerate(model.hashes)}
    by = defaultdict(Counter)
    for row in counts.where("c >= 16").collect():
        by[int(model.cls[at[row["h"] % 2**64]])][bytes(row["word"])[:1]] += 1
    pure = sum(max(c.values()) for c in by.values()) / sum(sum(c.values()) for c in by.values())
    assert len(model.hashes) > 10_000 and pure > 0.97


def test_best_class_has_the_largest_likelihood():
    r = np.random.RandomState(4)
    g = r.poisson(3, (class_lm._KINDS, class_lm._KINDS)).astype(float)
    word, context, n = np.array([0, 0, 0, 1, 1, 2]), np.array([3, 60, 70, 5, 49 + 5, 48]), np.array([2.0, 5, 1, 40, 2, 1])
    got = class_lm.best_classes(g, word, context, n, 3)
    f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
    for w in range(3):
        gain = []
        for k in range(1, class_lm.CLASSES):
            h = g.copy()
            for c, x in zip(context[word == w], n[word == w], strict=True):
                if c >= 49:
                    h[k, c - 49] += x
                else:
                    h[c, k] += x
            gain.append(f(h) - f(h.sum(axis=0)) - f(h.sum(axis=1)))
        assert got[w] == 1 + int(np.argmax(gain))


def test_exchange_never_lowers_the_likelihood():
    r = np.random.RandomState(3)
    kind = r.randint(0, 3, 40)
    m = r.poisson(np.array([[1, 30, 1], [1, 1, 30], [30, 1, 1]])[kind][:, kind]).astype(float)

    def fitness(cls):
        one = np.eye(4)[cls]
        g = one.T @ m @ one
        f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
        return f(g) - f(g.sum(axis=0)) - f(g.sum(axis=1))

    start = np.r_[0, 1 + np.arange(39) % 3]
    cls = class_lm.exchange(m, 4, 20)
    assert fitness(cls) > fitness(start) and cls[0] == 0 and (cls[1:] > 0).all()
    pairs = [(a, b) for a in range(1, 40) for b in range(1, a)]
    assert np.mean([(cls[a] == cls[b]) == (kind[a] == kind[b]) for a, b in pairs]) > 0.95


def test_lowest_hashes(spark):
    from lattica.llm.common import lowest_hashes

    df = spark.range(50_000).withColumnRenamed("id", "doc_id")
    h = F.xxhash64(F.col("doc_id").cast("string"))
    want = [r[0] for r in df.orderBy(h).limit(500).collect()]
    assert [r[0] for r in lowest_hashes(df, "doc_id", 500).collect()] == want
    assert lowest_hashes(df, "doc_id", 60_000).count() == 50_000
    same = df.select(F.lit(None).cast("bigint").alias("doc_id"))  # one hash for all: none or all below any bound
    assert lowest_hashes(same, "doc_id", 500).count() == 500


def test_rules_learn_from_few_documents_of_many_labels(spark, monkeypatch):
    docs = spark.createDataFrame([(k, prose("aa", 5)) for k in range(300)], "doc_id bigint, text string")
    labels = spark.range(100_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    seen = []
    fit = rule_ensemble.fit_rules
    monkeypatch.setattr(rule_ensemble, "fit_rules", lambda x, y: seen.append(len(y)) or fit(x, y))
    rule_ensemble.classify(docs, labels.union(labels), max_rows=1000)
    rule_ensemble.classify(docs, labels, max_rows=50)
    assert seen == [sum(zlib.crc32(str(k).encode()) % 3 != 1 for k in range(300)), 50]


def test_score_column_equals_the_plain_score(spark):
    """Statistics and score of every row against the definitions, word by word."""
    odd = [None, "", " ", "a", "É é 12 !! | #", "x\ny\nx\n\n", "the the the", "a" * 5000, "\U0001f600 b\x00c"] + [prose(k, 30) for k in ("aa", "bb")] * 20

    def plain(t):
        raw = t.encode()
        if not raw:
            return [0.0] * len(rule_ensemble.STATISTICS)
        words, lines, n = raw.split(), raw.split(b"\n"), len(raw)
        nw, count = max(1, len(words)), Counter(words)
        up, low, high = (sum(a <= b < z for b in raw) for a, z in ((65, 91), (97, 123), (128, 256)))
        return [
            len(t), len(words), up / max(1, up + low + high), sum(48 <= b < 58 for b in raw) / n, sum(b in b"#*$%&|<>@^~=_{}[]\\" for b in raw) / n, raw.count(b"!") / n, raw.count(b"|") / n, 1 - len(set(lines)) / len(lines), len(t) / len(lines),
            n / nw, len(count) / nw, sum(a == b for a, b in zip(words, words[1:], strict=False)) / nw, raw.count(b".") / nw, raw.count(b",") / nw, sum(b < 128 for b in raw) / n, max(count.values(), default=0) / nw,
        ]

    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, int(k > 25)) for k in range(len(odd))], "doc_id bigint, quality int")
    got = {r["doc_id"]: r["score"] for r in rule_ensemble.classify(docs, labels).collect()}
    model = rule_ensemble.fit_labels(docs.select(F.col("doc_id").alias("id"), "text"), labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("label")))
    x = np.array([plain(t or "") for t in odd])
    z = np.full(len(x), model.intercept)
    for rule, w in model.weights:
        z += w * np.array([all(v[rule_ensemble.STATISTICS.index(s)] > b if above else v[rule_ensemble.STATISTICS.index(s)] <= b for s, above, b in rule.bounds) for v in x])
    assert [got[k] for k in range(len(odd))] == pytest.approx((1 / (1 + np.exp(-z))).tolist())


def test_exchange_goes_on_until_no_symbol_moves():
    m = np.random.RandomState(0).poisson(0.7, (200, 200)).astype(float)
    cls = class_lm.exchange(m, 9)

    def fitness(c):
        one = np.eye(9)[c]
        g = one.T @ m @ one
        f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
        return f(g) - f(g.sum(axis=0)) - f(g.sum(axis=1))

    best = fitness(cls)
    assert best > fitness(class_lm.exchange(m, 9, 6))
    for s in range(1, 200):
        for k in range(1, 9):
            assert fitness(np.r_[cls[:s], k, cls[s + 1 :]]) <= best + 1e-6


def test_language_id_learns_from_few_labelled_rows_among_many(spark, monkeypatch):
    df = spark.createDataFrame([(k, prose("aa", 5), ["aa", "bb"][k % 2] if k % 50 == k % 2 else None) for k in range(3000)], "doc_id bigint, text string, lang string")
    learned = []
    monkeypatch.setattr(language_id, "fit_crf", lambda texts, labels: learned.extend(labels) or fit_crf(texts, labels))
    identify(df, max_rows=20)
    assert len(learned) == 20


def test_training_rows_of_each_language(spark):
    df = spark.createDataFrame([(None, f"{k} " * 40, "big") for k in range(3000)] + [(k, "x", "rare") for k in range(7)] + [(k, f"y{k}", "mid") for k in range(300)], "id bigint, text string, lang string")
    got = language_id.training_rows(df, 107, 50)
    assert Counter(l for _, l in got) == {"big": 50, "rare": 7, "mid": 50} and max(len(t) for t, _ in got) == 50
    assert len(language_id.training_rows(df, 10_000, None)) == 3307
    assert language_id.training_rows(df.where("false")) == []
    again = spark.createDataFrame([(5, "same", "big")] * 2000 + [(k, f"z{k}", "big") for k in range(40)] + [(1, "w", f"l{k}") for k in range(30)], "id bigint, text string, lang string")
    assert sum(t == "same" for t, _ in language_id.training_rows(again, 3000)) == 1 and len(language_id.training_rows(again, 3000)) == 71
    few = language_id.training_rows(again, 4)
    assert [l for _, l in few].count("big") == 1 and len({l for _, l in few}) == 4


def test_long_chains_carry_exact_messages(monkeypatch):
    r = np.random.RandomState(2)
    size = np.array([5, 40, 1, 17, 8])
    e, move, start = r.randn(size.sum(), 3) * 3, r.randn(3, 3), r.randn(3)
    want = posteriors(e, size, move, start)
    monkeypatch.setattr(language_id, "PIECE", 4)
    assert np.allclose(posteriors(e, size, move, start), want)


INSIDE = sorted({w for f in ("common", "near_copies", "mixing", "pii", "rule_ensemble", "host_rules", "fingerprints", "class_lm", "language_id", "piece_encoding") for w in re.findall(r"[\"'](_{0,2}[a-z][a-z0-9_]{0,14})[\"']", (pathlib.Path(near_copies.__file__).parent / f"{f}.py").read_text())} - {"doc_id", "text", "lang", "source"})


def test_columns_of_any_name_come_back(spark):
    """Tables whose other columns have every name that the operators use inside."""
    base = [(k, prose("aa", 30) + (f" mail jo{k % 3}@ex.org" if k % 2 else ""), "aa", f"s{k % 2}") for k in range(12)]
    names = [n for n in INSIDE if n.isidentifier()]
    df = spark.createDataFrame(base, SCHEMA).withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    labels = spark.createDataFrame([(k, 1) for k in range(12)], "doc_id bigint, quality int").withColumns({n: F.lit("y") for n in names if n != "quality"})
    own = lambda rows: {r["doc_id"]: tuple(r[n] for n in names) for r in rows.collect()}
    want = own(df)
    for back in (mix(df), pii.sanitise(df), pii.find_pii(df, spans_col="found"), near_copies.drop_near_copies(df), rule_ensemble.drop_low_quality(df, labels)):
        got = own(back)
        assert got and got == {k: want[k] for k in got}
    for back in (encode(df, model=None), round_trip(df)):
        got = {r["doc_id"]: tuple(r[n] for n in names if n != "ids") for r in back.collect()}
        assert got == {k: tuple(x for n, x in zip(names, v, strict=True) if n != "ids") for k, v in want.items()}
    for rows in (mix_amounts(df), near_copies.near_copies(df), rule_ensemble.classify(df, labels), identify(df), host_rules(df), token_counts(df), encoding_digests(df), edited_fingerprints(df), score(df)):
        assert rows.count() == 12


def test_word_features_are_those_of_each_word():
    rng = np.random.RandomState(3)
    words = ["a", "ab", "straße", "ελλάς", "𝒳y", "^$", "don't" * 30, "hello"]
    words += ["".join(rng.choice(list("abcdé"), rng.randint(1, 12))) for _ in range(300)]
    lexicon = {"hello": 2, "a": 0}
    flat, first = language_id.word_features(words, lexicon)
    seen = {}
    for w, found in zip(words, np.split(flat, first[1:]), strict=True):
        c, n = f"^{w}$", min(4, len(w))
        names = [("first", w[:k]) for k in range(1, n + 1)] + [("last", w[-k:]) for k in range(1, n + 1)]
        names += [("gram", c[i : i + k]) for k in (2, 3) for i in range(len(c) - k + 1)] + [("word", w)]
        names += [("lexicon", lexicon[w])] if w in lexicon else []
        assert len(names) == len(found)
        for name, h in zip(names, found, strict=True):
            assert seen.setdefault(name, h) == h
    assert len(set(seen.values())) > 0.98 * len(seen)
