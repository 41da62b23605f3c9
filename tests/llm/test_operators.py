"""Operators against brute force, exact round trips and planted cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corploom.llm import bpe, components, decontamination, embeddings, quality, sharding, simhash, substring, toxicity, urlfilter, warc
from corploom.llm.common import Scratch

VOCAB = ["".join(random.Random(k).choice("abcdefghijklm") for _ in range(3 + k % 6)) for k in range(900)]


def prose(n, rng):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def classes(ids, linked):
    """Union-find oracle: least member of each id's class."""
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        p, q = find(a), find(b)
        up[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 130)] + [(7, 7)]
    ids = {x for e in edges if e[0] != e[1] for x in e}
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    got = components.connected_components(df, Scratch(spark, "test")).collect()
    assert {r["node"]: r["component"] for r in got} == {k: v for k, v in classes(ids | {x for e in edges for x in e}, edges).items() if k in ids}
    assert components.connected_components(df.limit(0), Scratch(spark, "test")).count() == 0


# simhash


def fingerprint(text):
    import re

    import xxhash

    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash_against_brute_force(spark):
    rng = random.Random(1)
    texts = [prose(rng.randint(1, 40), rng) for _ in range(60)]
    base = prose(150, rng).split()
    texts += [" ".join([*base[:k], "edit", *base[k + 1 :]]).upper() for k in (10, 11, 70)]
    rows = list(enumerate([*texts, texts[0], "", None, "a", "a b", "É é x\ty\x0bz", "q " * 3000]))
    rows += [(None, texts[1]), (3, texts[3]), (900, "")]
    prints = {t: fingerprint(t) for _, t in rows}
    ids = sorted({i for i, _ in rows if i is not None})
    by_id = {i: prints[t] for i, t in rows if i is not None}
    want = classes(ids, [(a, b) for a in ids for b in ids if a < b and (by_id[a] ^ by_id[b]).bit_count() <= 3])
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert r["fingerprint"] == format(by_id[r["doc_id"]], "016x") and r["component_id"] == want[r["doc_id"]]
        else:
            assert r["component_id"] == want[1]
    assert simhash.near_duplicates(documents(spark, rows).limit(0)).count() == 0
    kept = simhash.keep_first(documents(spark, rows))
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(set(want.values()))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_simhash_tiles():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 300, np.uint64)
    b = np.concatenate([a[:60] ^ (np.uint64(1) << rng.integers(0, 63, 60).astype(np.uint64)), rng.integers(0, 1 << 63, 200, np.uint64)])
    edges = simhash.linked(a, b, 3)
    both = sorted(set(a.tolist()) | set(b.tolist()))
    true = [(x, y) for x in a.tolist() for y in b.tolist() if (x ^ y).bit_count() <= 3]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    assert classes(map(signed, both), edges) == classes(map(signed, both), [(signed(x), signed(y)) for x, y in true])


# BPE


@pytest.fixture(scope="module")
def spec():
    return bpe.read_spec(bpe.word_bpe_path())


def test_bpe_equals_library(spark, spec):
    from tokenizers import Tokenizer

    rng = random.Random(3)
    lib = Tokenizer.from_str(spec)
    lib.no_padding(), lib.no_truncation()
    vocab = [t.replace("</w>", "") for t in lib.get_vocab()]
    texts = [prose(60, rng) for _ in range(20)] + ["".join(rng.choice(vocab) for _ in range(rng.randint(1, 5))) for _ in range(1500)]
    texts += ["", None, "<|endoftext|>x<|startoftext|>", "İstanbul ΣΑΣ ﬁ 漢字 é́", "don't we'll 's'T 12½", "\x00\x1c\x85  \xa0a", "a" * 5000, "!?" * 400, "😀👨‍👩‍👧", "Straße ÀÉ"]
    rows = [*enumerate(texts), (None, "x"), (0, texts[0])]
    df = documents(spark, rows).withColumn("ids", F.lit(1)).withColumn("decoded", F.lit(2))
    got = bpe.encode(df, spec, texts=True).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "x" if r["doc_id"] is None else texts[r["doc_id"]] or ""
        ids = lib.encode(text, add_special_tokens=False).ids
        whole = lib.decode(ids, skip_special_tokens=False)
        assert r["ids"] == ids and r["decoded"] == whole and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
    assert bpe.encode(df.limit(0), spec).count() == 0


# decontamination


def edits(item, text):
    """Least edits from the item to any run of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_edit_distance():
    rng = random.Random(5)
    for _ in range(1500):
        p, t = [rng.randint(0, 3) for _ in range(rng.randint(1, 9))], [rng.randint(0, 4) for _ in range(rng.randint(0, 14))]
        assert decontamination.distance(p, t)[0] == edits(p, t)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(6)
    items = [(k, prose(rng.randint(8, 50), rng)) for k in range(30)] + [(30, None), (31, ""), (32, "too short"), (33, "the " * 20), (0, prose(20, rng))]
    docs = []
    for k in range(120):
        words = rng.choice(items[:30])[1].split()
        for _ in range(rng.randint(0, len(words) // 3)):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([[], [rng.choice(VOCAB)], [words[at], rng.choice(VOCAB)]])
            if not words:
                words = ["x"]
        docs.append((k, f"{prose(rng.randint(0, 40), rng)}, {' '.join(words).upper()}; {prose(20, rng)}"))
    docs += [(500, None), (501, ""), (502, prose(5000, rng)), (None, items[3][1]), (3, docs[3][1])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    df = documents(spark, docs)
    got = {}
    for r in decontamination.find(df, bench).collect():
        key = (r["doc_id"], r["item_id"])
        got[key] = min(r["distance"], got.get(key, 99))
    want = {}
    for i, t in docs:
        for j, u in items:
            w = decontamination.words(u)
            if w and (d := edits(w, decontamination.words(t))) <= decontamination.budget(len(w)):
                want[i, j] = min(d, want.get((i, j), 99))
    assert got == want
    kept = decontamination.drop_contaminated(df, bench)
    dirty = {i for i, _ in want}
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(i for i, _ in docs if i is not None and i not in dirty)
    assert kept.columns == df.columns
    assert decontamination.find(df.limit(0), bench).count() == 0 and decontamination.find(df, bench.limit(0)).count() == 0


# URL filters


def test_urls_against_brute_force(spark):
    rows = [
        (1, "http://a.net/es/1", '<link rel="canonical" href="/x/2?q=1#f">'), (2, "http://A.net/x/2?q=1", ""), (3, "https://ok.com/", "<META HTTP-EQUIV=refresh content='0; url=http://a.net/x/3'>"),
        (4, "http://a.net/x/3", None), (5, None, "<link rel=canonical href=foo>"), (6, "nourl", "x"), (7, "http://b.net/p/q.html", "<link href='r.html' rel='canonical'>"),
        (8, "http://b.net/p/r.html", "<meta http-equiv='refresh' content='1;URL=//c.net/es/9'>"), (9, "http://c.net/es/9#z", ""), (9, "http://c.net/es/9#z", ""),
        (10, "http://x.example.com/en/5", ""), (11, "http://www.example.com/en/5", ""), (12, "http://example.com/EN/5", ""), (13, "http://notexample.org/en/", ""), (14, "HTTP://Q.COM", ""),
        (15, "ftp://u@fr.net:80/fr/", '<link rel="stylesheet" href="http://c.net/es/9">'), (None, "http://z.net/fr/a?b", ""),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(df).collect()]
    assert sorted(got, key=str) == sorted([
        (1, "a.net", "/es/1", "net/es/", "block"), (2, "a.net", "/x/2", None, "block"), (3, "ok.com", "/", "com/", "allow"), (4, "a.net", "/x/3", None, "allow"),
        (5, "", "", None, "allow"), (6, "", "", None, "allow"), (7, "b.net", "/p/q.html", None, "block"), (8, "b.net", "/p/r.html", None, "block"),
        (9, "c.net", "/es/9", "net/es/", "block"), (9, "c.net", "/es/9", "net/es/", "block"), (10, "x.example.com", "/en/5", "example.com/en/", "block"),
        (11, "www.example.com", "/en/5", "www.example.com/en/", "allow"), (12, "example.com", "/EN/5", "com/", "allow"), (13, "notexample.org", "/en/", None, "allow"),
        (14, "q.com", "", None, "allow"), (15, "u@fr.net:80", "/fr/", None, "allow"), (None, "z.net", "/fr/a", "net/fr/", "block"),
    ], key=str)
    assert urlfilter.judge(df.limit(0)).count() == 0
    told = urlfilter.judge(df, redirects=spark.createDataFrame([("http://notexample.org/en/", "http://c.net/es/9"), ("http://u", None)], "src string, dst string"))
    assert told.where("page_id = 13").first()["verdict"] == "block"


# WARC


def test_warc_round_trip(spark, tmp_path):
    big, other = "é" * 700, "x" * 1000
    rows = [(1, "http://a/\r\nX: y", big), (5, "http://b", big), (3, None, big), (2, "u", other), (4, "u", "small"), (6, "u", "small"), (7, "u", None), (8, "u", ""), (9, "u", "y" * 999), (10, "u", "y" * 999), (5, "http://b", big), (None, "u", other), (None, "u", "z" * 1000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(0))
    warc.write_archive(df, f"{tmp_path}/h", f"{tmp_path}/p")
    got = warc.read_records(spark, f"{tmp_path}/h", f"{tmp_path}/p").collect()
    assert len(got) == len(rows) and spark.read.parquet(f"{tmp_path}/p").count() == len({r[2] or "" for r in rows})
    seen = []
    for r in got:
        body = bytes(r["payload"])
        assert r["payload_digest"] == hashlib.sha1(body).hexdigest() and r["payload_bytes"] == len(body)
        record = bytes(r["record"])
        head, block = record.split(b"\r\n\r\n", 1)
        length = int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
        assert record.endswith(b"\r\n\r\n") and len(block) == length + 4
        assert block[:-4].endswith(body) == (r["record_type"] == "response" or not body)
        seen.append((r["page_id"], body.decode(), r["record_type"], r["refers_to"]))
    want = []
    for i, _, b in rows:
        b = b or ""
        top = max((j for j, _, c in rows if (c or "") == b and j is not None), default=None)
        full = len(b.encode()) < 1000 or i == top
        want.append((i, b, "response" if full else "revisit", None if full else top))
    assert sorted(seen, key=str) == sorted(want, key=str)
    warc.write_archive(df.limit(0), f"{tmp_path}/h0", f"{tmp_path}/p0")
    assert warc.read_records(spark, f"{tmp_path}/h0", f"{tmp_path}/p0").count() == 0


def test_warc_finds_damage(spark, tmp_path):
    spark.createDataFrame([(bytearray(32), bytearray(b"x"))], "key binary, payload binary").write.parquet(f"{tmp_path}/p")
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read_payloads(spark, f"{tmp_path}/p").collect()


# sharding


def test_sharding(spark):
    rng = random.Random(8)
    rows = [(k, "x" * rng.randint(0, 300)) for k in range(400)] + [(900, "y" * 5000), (901, None), (902, "")] + [(77, "z" * 200)] * 60 + [(None, "n" * 30)]
    got = sharding.assign(documents(spark, rows).withColumn("shard", F.lit(1)), limit=2000).collect()
    assert len(got) == len(rows)
    held = {}
    for r in got:
        held.setdefault(r["shard"], []).append(r)
    names = sorted(held)
    assert all(not b.startswith(a) for a, b in zip(names, names[1:]))
    for shard, rs in held.items():
        total = sum(r["n_bytes"] for r in rs)
        assert total <= 2000 or len(rs) == 1
        assert all(r["shard_bytes"] == total and r["depth"] == len(shard) for r in rs)
        if shard:  # its parent had to split
            assert sum(r["n_bytes"] for r in got if r["shard"].startswith(shard[:-1])) > 2000
    assert sharding.assign(documents(spark, rows).limit(0)).count() == 0
    assert {r["shard"] for r in sharding.assign(documents(spark, rows[:5])).collect()} == {""}


def test_written_shards(spark, tmp_path):
    rng = random.Random(24)
    hot = [(None, f"{k:03d}" + "n" * 197) for k in range(60)] + [(77, "z" * 200)] * 60
    rows = [(k, "x" * rng.randint(0, 300)) for k in range(200)] + hot + [(900, "y" * 5000), (901, None), (902, "")]
    path = str(tmp_path / "shards")
    sharding.write_shards(documents(spark, rows), path, limit=2000)
    got = spark.read.parquet(path).withColumn("folder", F.regexp_extract(F.input_file_name(), "shard=([^/]*)", 1)).collect()
    assert sorted(map(repr, rows)) == sorted(repr((r["doc_id"], r["text"])) for r in got)
    held = {}
    for r in got:
        held.setdefault(r["folder"], []).append(len(r["text"] or ""))
    assert all(sum(sizes) <= 2000 or len(sizes) == 1 for sizes in held.values())


# embeddings


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((150, 16))
    near = np.repeat(x[:10], 6, axis=0) + 0.05 * rng.standard_normal((60, 16))
    vecs = [v.astype(np.float32).tolist() for v in np.vstack([x, near])]
    rows = [*enumerate(vecs), (400, vecs[0]), (401, [2 * c for c in vecs[1]]), (402, None), (403, []), (404, [0.0] * 16), (405, [float("nan")] * 16), (406, [None] + vecs[0][1:]), (407, [float("inf")] * 16), (408, [1.0, 0.0]), (None, vecs[2]), (None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(1))
    ok = [(i, np.float32(v).astype(float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    linked = [(a, b) for a in range(len(ok)) for b in range(a) if len(ok[a][1]) == len(ok[b][1]) and ok[a][1] @ ok[b][1] / np.linalg.norm(ok[a][1]) / np.linalg.norm(ok[b][1]) >= 0.95]
    degree = np.bincount(np.array(linked).ravel(), minlength=len(ok))
    names = classes(range(len(ok)), linked)
    least = {}
    for k, (i, _) in enumerate(ok):
        least[names[k]] = min(least.get(names[k], 1 << 60), 1 << 60 if i is None else i)
    want = {i: (int(degree[k]), least[names[k]]) for k, (i, _) in enumerate(ok)}
    got = embeddings.near_duplicates(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["vec_id"] is not None:
            assert (r["n_links"], r["component_id"]) == want.get(r["vec_id"], (0, r["vec_id"])), r
            assert r["kept"] == (r["vec_id"] == r["component_id"])
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_beyond_the_window(spark):
    rng = np.random.default_rng(10)
    v = rng.standard_normal(24) + 0.01 * rng.standard_normal((80, 24))
    df = spark.createDataFrame([(k, x.astype(np.float32).tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = embeddings.near_duplicates(df, window=3, passes=4).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(79, 0)}


def test_embeddings_in_a_dense_group(spark):
    # all point one way, pairwise cosine 0.9, so a sort puts many between the two of a pair
    rng = np.random.default_rng(23)
    axis = rng.standard_normal(64) / 8
    x = np.sqrt(0.9) * axis + np.sqrt(0.1) * rng.standard_normal((1500, 64)) / 8
    twins = x[:100] + 0.025 * rng.standard_normal((100, 64))
    v = np.vstack([x, twins]).astype(np.float32)
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    linked = np.argwhere(np.triu(unit @ unit.T >= 0.95, 1)).tolist()
    names = classes(range(len(v)), [tuple(p) for p in linked])
    least = {}
    for k in range(len(v)):
        least.setdefault(names[k], k)
    df = spark.createDataFrame(list(enumerate(v.tolist())), "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df, window=2).collect()}
    degree = np.bincount(np.array(linked).ravel(), minlength=len(v))
    assert sum(got[k]["component_id"] == least[names[k]] and got[k]["n_links"] == degree[k] for k in got) >= 0.99 * len(v)


# classifiers


def judge(score, truth):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    k = truth.sum()
    return (rank[truth == 1].mean() - (k - 1) / 2) / (len(truth) - k)


def test_quality_held_out(spark):
    rng = random.Random(11)
    rows, marks = [], []
    for k in range(400):
        good = rng.random() < 0.7
        t = prose(rng.randint(20, 120), rng)
        rows.append((k, t if good else " ".join(w.upper() + "!!" for w in t.split()[:30]) * 3))
        marks.append((k, int(good), 0))
    odd = [(900, None), (901, ""), (None, "x"), (902, "word " * 20000), (0, rows[0][1])]
    labels = spark.createDataFrame([*marks, (None, 1, 0), (901, None, 0)], "doc_id long, quality int, toxic int")
    df = documents(spark, rows + odd)
    got = quality.score(df, labels).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    truth = {k: q for k, q, _ in marks}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got if r["doc_id"] is not None)
    held = [(r["score"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert judge(np.array([s for s, _ in held]), np.array([q for _, q in held])) > 0.97
    # held-out labels don't matter
    flipped = labels.withColumn("quality", F.when(quality.remainder("doc_id", 3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in quality.score(df, flipped).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-6 for r in got)
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and kept.where("doc_id < 400").count() < 400
    none = quality.score(df, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5} and quality.score(df.limit(0), labels).count() == 0


def test_isotonic():
    rng = np.random.default_rng(3)
    n = rng.integers(1, 50, 60).astype(float)
    y = rng.binomial(n.astype(int), np.linspace(0.1, 0.9, 60)).astype(float)
    x = np.arange(60.0)
    at, share = quality.isotonic(n, y, x)
    assert (np.diff(at) > 0).all() and (np.diff(share) > 0).all() and 0 < share.min() and share.max() < 1
    # the least-squares fit that does not fall: max over starts of the min over ends of block means (with the prior's half row)
    m, k = n + 0.5, y + 0.5 * (y.sum() + 0.5) / (n.sum() + 1)
    mean = lambda a, b: k[a : b + 1].sum() / m[a : b + 1].sum()
    best = [max(min(mean(a, b) for b in range(i, 60)) for a in range(i + 1)) for i in range(60)]
    assert np.allclose(sorted(set(np.round(best, 9))), share)
    assert all(v.size == 0 for v in quality.isotonic(np.zeros(0), np.zeros(0), np.zeros(0)))


def test_toxicity_held_out(spark):
    rng = random.Random(12)
    bad = ["grobnik", "zlomrak", "krivozub"]
    rows, marks = [], []
    for k in range(500):
        w = prose(rng.randint(20, 80), rng).split()
        toxic = rng.random() < 0.4
        if toxic:
            for _ in range(max(1, len(w) // 20)):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((k, " ".join(w)))
        marks.append((k, 1, int(toxic)))
    odd = [(900, None), (901, ""), (None, "x"), (902, prose(30, rng) + " grobnyk zlomraak"), (903, prose(32, rng)), (0, rows[0][1])]
    labels = spark.createDataFrame([*marks, (None, 1, 1), (901, 1, None)], "doc_id long, quality int, toxic int")
    df = documents(spark, rows + odd)
    got = toxicity.score(df, labels).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    truth = {k: x for k, _, x in marks}
    held = [(r["score"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert judge(np.array([s for s, _ in held]), np.array([x for _, x in held])) > 0.97
    assert by[902]["score"] > by[903]["score"] + 0.2  # misspellings never seen
    assert {r["score"] for r in toxicity.score(df, labels.limit(0)).collect()} == {0.5}
    assert toxicity.score(df.limit(0), labels).count() == 0


# substring


def test_substrings(spark):
    rng = random.Random(13)
    rows = {k: "\n".join(prose(rng.randint(5, 90), rng) for _ in range(rng.randint(1, 4))) for k in range(80)}
    passages = [prose(n, rng) for n in (51, 52, 55, 60, 90, 140)]
    spots = list(range(80))
    rng.shuffle(spots)
    holders = {}
    for p in passages:
        holders[p] = sorted(spots.pop() for _ in range(4))
        for i in holders[p]:
            w = rows[i].split(" ")
            w.insert(rng.randrange(len(w)), p)
            rows[i] = " ".join(w)
    line = prose(100, rng).split()
    a, b = sorted((spots.pop(), spots.pop()))
    rows[a] += "\n" + " ".join(line)
    rows[b] += "\n" + " ".join(line[:40] + ["changed"] + line[41:])
    short = prose(30, rng)
    for i in (spots.pop(), spots.pop()):
        rows[i] += " " + short
    own = spots.pop()
    rows[own] += "\n" + prose(60, random.Random(1)) + "\n" + prose(60, random.Random(1))
    data = [*rows.items(), (500, None), (501, ""), (502, ""), (a, rows[a]), (None, "lone"), (503, "rep " * 3000), (504, passages[0])]
    df = documents(spark, data)
    found = substring.find(df).collect()
    expect = {i for h in holders.values() for i in h[1:]} | {b, 504}
    assert {r["doc_id"] for r in found} == expect
    for r in found:
        assert r["n_words"] >= 50 and r["kept_doc_id"] < r["doc_id"]
    out = substring.remove(df)
    assert out.columns == df.columns
    left = {r["doc_id"]: r for r in out.collect()}
    squeeze = lambda t: " ".join((t or "").split())
    for p, h in holders.items():
        assert [i for i in h if p in squeeze(left[i]["text"])] == h[:1]
    assert 504 not in left and {500, 501, 502, 503, None} <= set(left) and out.count() == len(data) - 1
    for i, t in data:
        if i not in expect:
            assert left[i]["text"] == t
    assert all(left[i]["n_chars"] == len(left[i]["text"]) for i in expect - {504})
    assert substring.find(df.limit(0)).count() == 0 and substring.remove(df.limit(0)).count() == 0


# pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(14)
    rows = []
    for k in range(150):
        t = prose(rng.randint(40, 100), rng)
        rows.append((k, t if k % 4 else " ".join(w.upper() + "!!" for w in t.split()[:20]) * 3))
    item = prose(30, rng)
    copy = rows[1][1]
    rows += [(200, copy), (201, prose(20, rng) + " " + item + " " + prose(20, rng)), (202, None), (203, "")]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(k % 4 != 0), 0) for k in range(150)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 200 not in got and 201 not in got and 1 in got
    assert not any(k in got for k in range(0, 150, 4)) and sum(k in got for k in range(150) if k % 4) >= 105
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "simhash", "substring", "decontamination", "bpe"]


def test_crowded_lines(spark):
    rng = random.Random(15)
    shared = prose(70, rng)
    rows = {k: f"{shared} {prose(60, rng)}" for k in range(260)}
    for k in range(0, 20, 2):  # one word of the line's own part differs
        w = rows[k].split()
        w[100] = "other"
        rows[300 + k] = " ".join(w)
    got = {r["doc_id"]: r for r in substring.find(documents(spark, list(rows.items()))).collect()}
    assert set(got) == set(rows) - {0}
    assert all((got[300 + k]["first_word"], got[300 + k]["n_words"]) == (0, 130) for k in range(0, 20, 2))
    agree = lambda i, j: next(n for n, (a, b) in enumerate(zip(rows[i].split(), rows[j].split())) if a != b)
    for k in range(1, 260):  # what the first document holds, at most what any earlier one does
        assert (got[k]["first_word"], got[k]["kept_doc_id"]) == (0, 0)
        assert agree(0, k) <= got[k]["n_words"] <= max(agree(j, k) for j in range(k))


def ranges(rows):
    """The words to remove, as (doc_id, word) pairs: those in a window of 50 that an earlier document holds."""
    first, out = {}, set()
    for i, text in sorted(rows):
        w = text.lower().split()
        for k in range(len(w) - 49):
            if first.setdefault(tuple(w[k : k + 50]), i) != i:
                out |= {(i, x) for x in range(k, k + 50)}
    return out


def told(found):
    return {(r["doc_id"], x) for r in found.collect() for x in range(r["first_word"], r["first_word"] + r["n_words"])}


def test_passages_in_pieces(spark):
    # each stretch of 40 words stands in an earlier document of its own; only the last two share the whole
    rng = random.Random(21)
    whole = prose(160, rng).split()
    rows = [(k, " ".join([prose(20, rng), *whole[at : at + 40], prose(20, rng)])) for k, at in enumerate(range(0, 121, 5))]
    rows += [(100, " ".join([prose(30, rng), *whole, prose(30, rng)])), (101, " ".join([prose(17, rng), *whole, prose(9, rng)]))]
    line = prose(70, rng)
    rows += [(k, prose(10, rng) + "\n" + line + "\n" + prose(12, rng)) for k in (102, 103, 104)]
    expect = ranges(rows)
    assert {i for i, _ in expect} == {101, 103, 104}
    assert told(substring.find(documents(spark, rows))) == expect


def test_periodic_passages(spark):
    # text with a short period has no landmarks; it stands at other places in each document
    rng = random.Random(22)
    loops = ["rep " * 120, "one two three " * 30, "a b c d e " * 40, "Is " * 51]
    rows = []
    for k, loop in enumerate(loops):
        rows += [(10 * k + j, " ".join([prose(5 + 9 * j + k, rng), loop * (1 + j % 2), prose(7, rng)])) for j in range(4)]
    rows += [(90, "lone " * 49 + prose(9, rng)), (91, prose(11, rng) + " lone" * 49)]
    expect = ranges(rows)
    assert {i for i, _ in expect} == {10 * k + j for k in range(4) for j in range(1, 4)}
    assert told(substring.find(documents(spark, rows))) == expect
