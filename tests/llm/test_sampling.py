"""Resampling, mixing and phrases against brute force; nulls, ties, long texts, repeated rows, empty tables, clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_edges import clashing
from test_operators import documents, prose

from corploom.llm import mixing, phrases, resampling
from corploom.llm.common import Scratch
from corploom.llm.words import numbered

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORD.findall((text or "").translate(LOW))
    return w, [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def bucket(f):
    return zlib.crc32(f.encode()) % 10_000


def texts(rng, n):
    odd = ["", None, "É1 straße, Über-ALLES 東京 x", "a" * 5000 + " b", "one", "...", "x y " * 30]
    return [*odd, *(prose(rng.randrange(5, 90), rng) for _ in range(n - len(odd)))]


# numbering


def test_numbered(spark):
    rows = [(random.Random(k).randrange(20), k) for k in range(500)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(7)
    got = numbered(df, [F.col("a").desc(), F.col("b").asc()], "place", Scratch(spark, "test")).orderBy("place").collect()
    assert [(r["a"], r["b"]) for r in got] == sorted(rows, key=lambda r: (-r[0], r[1])) and [r["place"] for r in got] == list(range(1, 501))
    assert numbered(df.limit(0), [F.col("a")], "place", Scratch(spark, "test")).count() == 0


# resampling


def draws(docs, target, percent=5):
    s, t = (Counter(bucket(f) for x in side for f in features(x)[1]) for side in ([x for _, x in docs], target))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + 10_000) / ((s[b] + 1) * (n_t + 10_000)))) for b in range(10_000)]
    out = []
    for d, x in docs:
        words, fs = features(x)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in fs)
        out.append([d, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = k
    return [tuple(r[:5]) for r in out]


def same(got, want):
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_resampling(spark):
    rng = random.Random(11)
    docs = list(enumerate(texts(rng, 200))) + [(7, prose(40, rng)), (None, prose(50, rng)), (30, prose(60, rng))]
    target = [prose(30, rng) for _ in range(9)] + [None, ""]
    wanted = spark.createDataFrame([(x,) for x in target], "text string")
    for parts in (1, 5):
        got = resampling.resample(documents(spark, docs).repartition(parts), wanted, percent=20)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
        same([tuple(r) for r in got.collect()], draws(docs, target, 20))


def test_resampling_stretches_and_parts(spark, monkeypatch):
    """A text longer than a stretch, parts as small as a few features, and tables of checksums for long words."""
    rng = random.Random(12)
    docs = [(1, prose(900, rng)), (2, "y" * 70_000 + " z " + prose(80, rng)), (3, prose(20, rng))]
    monkeypatch.setattr(resampling, "PART", 4000)
    monkeypatch.setattr(resampling, "STRETCH", 100)
    got = resampling.resample(documents(spark, docs), spark.createDataFrame([(docs[0][1][:300],)], "text string"), percent=50)
    same([tuple(r) for r in got.collect()], draws(docs, [docs[0][1][:300]], 50))


def test_dictionary(spark):
    rng = random.Random(13)
    rows = list(enumerate(texts(rng, 80)))
    got = resampling.dictionary(documents(spark, rows).repartition(3)).collect()
    want = Counter(f for _, x in rows for f in features(x)[1])
    assert len(got) == len(want) and {r["feature"]: r["n"] for r in got} == want and all(r["bucket"] == bucket(r["feature"]) for r in got)


def test_joined_checksums():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 31, 400, 70_001):
        a, b = rng.bytes(23), rng.bytes(n)
        crc = resampling._joined(np.array([zlib.crc32(a)], np.uint32), resampling._shift(n)[None], np.zeros(1, np.int64), np.array([zlib.crc32(b)], np.uint32))
        assert crc[0] == zlib.crc32(a + b)


def test_resampling_repeated_rows_empty_tables_and_names(spark):
    rng = random.Random(14)
    docs = [(5, prose(30, rng))] * 40 + [(k, prose(25, rng)) for k in range(10, 20)]
    target = spark.createDataFrame([(prose(30, rng),)], "text string")
    got = resampling.resample(documents(spark, docs), target, percent=50).collect()
    ranks = sorted(r["rank"] for r in got if r["rank"])
    assert len(got) == 50 and ranks == list(range(1, 26))
    assert {tuple(r)[:4] for r in got} == {r[:4] for r in draws(docs, [target.first()[0]], 50)}
    clash = resampling.resample(clashing(documents(spark, docs)), target, percent=50)
    same([tuple(r) for r in clash.collect()], [tuple(r) for r in got])
    assert resampling.resample(documents(spark, docs).limit(0), target).count() == 0
    none = resampling.resample(documents(spark, docs), target.limit(0), percent=50).collect()
    assert {tuple(r)[:4] for r in none} == {r[:4] for r in draws(docs, [], 50)}


# mixing


def mixed(docs, weights=(5, 2, 1), most=3):
    """Targets by the rule as it stands, draws by sorting; of equal rows any are taken."""
    size = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x or ""))
    of = {}
    for d, x, s in docs:
        of.setdefault(s, []).append((d, x))
    names = sorted(of, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(size(x) for _, x in of[s]) for s in names}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full, whole = set(), sum(total.values())
    while True:
        rest, w = whole - sum(most * total[s] for s in full), sum(weight[s] for s in names if s not in full)
        more = {s for s in names if s not in full and weight[s] * rest > most * total[s] * w}
        if not more:
            break
        full |= more
    out = []
    for s in names:
        target = float(most * total[s]) if s in full else weight[s] * rest / w
        times = min(most, int(target // total[s])) if total[s] else 0
        left, reach = target - times * total[s], 0
        for d, x in sorted(of[s], key=lambda r: hashlib.md5(f"{'' if r[0] is None else r[0]}:{r[1] or ''}".encode()).hexdigest()[:15]):
            reach += size(x)
            copies = times + (left > 0 and 2 * reach - size(x) <= 2 * left)
            out.append((d, size(x), s, total[s], target, copies, copies * size(x)))
    return out


def sourced(spark, rows):
    return spark.createDataFrame([(d, x, "en", s, 1) for d, x, s in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_mixing(spark):
    rng = random.Random(21)
    rows = [(k, prose(rng.choice([1, 5, 30, 200]), rng), rng.choice(["b", "b", "b", "b", "a", "é", "Z", None])) for k in range(400)]
    rows += [(1000, None, "a"), (1001, "", None), (1002, "w " * 4000, "tiny"), (1003, "one two", "small"), (None, prose(9, rng), "b"), (1004, "", "silent")]
    for parts in (1, 6):
        got = [tuple(r) for r in mixing.mix(sourced(spark, rows).repartition(parts)).collect()]
        same(got, mixed(rows))
    assert all(r[6] <= 3 * r[1] for r in got)
    for s in {r[2] for r in got}:
        mine = [r for r in got if r[2] == s]
        assert abs(sum(r[6] for r in mine) - mine[0][4]) <= max(r[1] for r in mine) / 2 + 1e-6
    assert abs(sum({r[2]: r[4] for r in got}.values()) - sum(r[1] for r in got)) < 1e-6


@pytest.mark.parametrize("weights, most", [((5, 2, 1), 3), ((1,), 2), ((100, 1), 5)])
def test_mixing_targets(spark, weights, most):
    rng = random.Random(22)
    for _ in range(4):
        sizes = [(f"s{k:02d}", rng.choice([0, 3, 50, 400, 9000])) for k in range(12)]
        rows = [(k, "w " * n, s) for k, (s, n) in enumerate(sizes)]
        got = mixing.targets(spark.createDataFrame(sizes, "source string, source_size long"), Scratch(spark, "test"), weights, most).collect()
        assert {r["source"]: r["target"] for r in got} == {r[2]: r[4] for r in mixed(rows, weights, most)}


def test_mixing_repeated_rows(spark):
    """Rows alike in all tie; a third of a source may be such a group, and still its target is met."""
    rng = random.Random(23)
    rows = [(9, "a b c", "x")] * 60 + [(k, prose(3, rng), "x") for k in range(100, 220)] + [(k, prose(40, rng), "y") for k in range(20)]
    for parts in (1, 4):
        got = [tuple(r) for r in mixing.mix(sourced(spark, rows).repartition(parts)).collect()]
        same(got, mixed(rows))


def test_mixing_draw_empty_and_names(spark):
    rng = random.Random(24)
    rows = [(k, prose(rng.randrange(1, 20), rng), rng.choice("ab")) for k in range(60)]
    df = clashing(sourced(spark, rows))
    drawn = mixing.draw(df)
    assert drawn.columns == df.columns
    assert Counter(r["doc_id"] for r in drawn.collect()) == {r[0]: r[5] for r in mixed(rows) if r[5]}
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.draw(df.limit(0)).count() == 0


# phrases


def mined(rows, least, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, " ".join(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    out = {}
    often = {k: a for k, a in f.items() if a >= least and " " in k[1]}
    for (lang, p), a in often.items():
        if any(x == lang and f" {p} " in f" {q} " and q != p and b >= a for (x, q), b in often.items()):
            continue
        w = p.split(" ")
        cuts = []
        for k in range(1, len(w)):
            l, r = f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]
            cuts.append((1000 * a * n[lang] // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        out.setdefault(lang, []).append((p, a, l, r, n[lang], score))
    return [(lang, k, *x) for lang, xs in out.items() for k, x in enumerate(sorted(xs, key=lambda x: (-x[5], -x[1], x[0].encode()))[:top], 1)]


def spoken(spark, rows):
    return spark.createDataFrame([(k, x, lang, "s", 1) for k, (x, lang) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")


def speech(rng, n):
    few = ["the", "Of", "and", "über", "東京", "x-y", "a\tb", "to", "in"]
    rows = []
    for _ in range(n):
        w = [rng.choice(few) if rng.random() < 0.8 else f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 40))]
        rows.append(("".join(x + rng.choice([" ", " ", " ", "  ", ", ", "\n", ". "]) for x in w), rng.choice(["en", "en", "de", None])))
    return [*rows, ("", "en"), (None, "de"), ("la la la la la la la la", "fr"), ("New York City hall " * 9, "de"), ("...", "fr")]


def test_phrases(spark):
    rows = speech(random.Random(31), 250)
    want = mined(rows, 6, 40)
    assert {r[0] for r in want} >= {"en", "de", "und"}
    for parts in (1, 4):
        same([tuple(r) for r in phrases.mine(spoken(spark, rows).repartition(parts), least=6, top=40).collect()], want)
    same([tuple(r) for r in phrases.mine(clashing(spoken(spark, rows)), least=6, top=40).collect()], want)


def test_phrases_small_sketch_and_groups(spark, monkeypatch):
    """A sketch with eight bits lets nearly everything through, in many groups; stretches of a few words; the same result."""
    rows = speech(random.Random(32), 120)
    monkeypatch.setattr(phrases, "GROUP", 700)
    monkeypatch.setattr(phrases, "LEAST_BITS", 8)
    monkeypatch.setattr(phrases, "MOST_BITS", 8)
    monkeypatch.setattr(phrases, "STRETCH", 50)
    same([tuple(r) for r in phrases.mine(spoken(spark, rows), least=5, top=30).collect()], mined(rows, 5, 30))


def test_phrases_long_repeated_and_empty(spark):
    rows = [("alpha beta gamma " * 4000, "en"), *[("alpha beta; gamma delta", "en")] * 30, ("q" * 100_000 + " z", None)]
    same([tuple(r) for r in phrases.mine(spoken(spark, rows), least=25, top=50).collect()], mined(rows, 25, 50))
    assert phrases.mine(spoken(spark, rows).limit(0)).count() == 0
    assert phrases.mine(spoken(spark, rows[-1:]), least=5).count() == 0


def test_phrases_exact_beyond_64_bits(spark):
    big = spark.createDataFrame([(10**12, 10**14, 3 * 10**12, 5 * 10**13)], "a long, n long, l long, r long")
    assert big.selectExpr(phrases.SCORE).first()[0] == 1000 * 10**12 * 10**14 // (3 * 10**12 * 5 * 10**13)


def test_phrases_are_counted_without_a_scan_for_each_group(spark, monkeypatch):
    monkeypatch.setattr(phrases, "_counted", None)  # the automata, which read all texts
    known, words = phrases.counts(spark.createDataFrame([("a b a b. a b", "en"), ("a b", None)], "text string, lang string"), least=2)
    assert {tuple(r) for r in known.collect()} == {("en", "a", 3, 1), ("en", "b", 3, 1), ("en", "a b", 3, 2)}
    assert {tuple(r) for r in words.collect()} == {("en", 6), ("und", 2)}
