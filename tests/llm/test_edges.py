"""Clashing names, odd ids, very long texts, ties, and models against dense arithmetic."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import VOCAB, documents, prose

import corploom.storage as storage
from corploom.llm import bpe, decontamination, embeddings, quality, sharding, simhash, substring, toxicity, urlfilter, warc
from corploom.llm.common import _cuts, fresh

CLASHES = ["new", "r", "_rid", "_row", "_id", "_n", "shard", "h", "k", "d", "fp", "rid", "did", "component", "x", "n", "row", "ranges", "_known", "item_id"]


def clashing(df):
    return df.withColumns({c: F.concat(F.lit(c + ":"), F.col("doc_id").cast("string")) for c in CLASHES})


def intact(out, df):
    assert out.columns == df.columns
    for row in out.collect():
        assert all(row[c] == (None if row["doc_id"] is None else f"{c}:{row['doc_id']}") for c in CLASHES)


def test_pieces_keep_all_rows():
    import pyarrow as pa

    texts = pa.array(["a" * 5, None, "b" * 100, "", "cc"] * 7)
    cuts = list(_cuts(texts, 10, 3))
    assert [k for at, n in cuts for k in range(at, at + n)] == list(range(35)) and max(n for _, n in cuts) <= 3


def test_residents_go_with_the_next_operator():
    from corploom.llm.common import _RESIDENT, evict, resident

    first = resident("a", 1, list)
    assert resident("a", 1, list) is first and resident("a", 2, list) is not first
    evict("a")
    assert set(_RESIDENT) == {"a"}
    evict()
    assert not _RESIDENT


def test_bpe_generations():
    own, small = bpe.WordBpe(spec := bpe.read_spec(bpe.word_bpe_path())), bpe.WordBpe(spec)
    rng = random.Random(42)
    texts = [[prose(40, rng) + " qzx" + str(k % 7) for k in range(5)] for _ in range(12)]
    whole = [own.encode(t) for t in texts]
    before, bpe.MEMORY = bpe.MEMORY, 2000
    try:
        assert [small.encode(t) for t in texts] == whole
    finally:
        bpe.MEMORY = before
    assert len(small.known) < len(own.known)


def test_fresh_names(spark):
    df = spark.range(1).toDF("Row").withColumn("_row", F.lit(1))
    assert fresh(df, "row", "n") == ["__row", "n"]


def test_clashing_columns(spark, tmp_path):
    rng = random.Random(31)
    shared = prose(80, rng)
    rows = [(k, prose(60, rng) + "\n" + shared * (k < 4) + prose(10, rng)) for k in range(30)] + [(None, prose(40, rng)), (7, prose(30, rng))]
    df = clashing(documents(spark, rows))
    labels = spark.createDataFrame([(k, int(k % 3 > 0), k % 2) for k in range(30)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, shared)], "item_id long, text string")
    for out in (quality.keep_good(df, labels), simhash.keep_first(df), substring.remove(df), decontamination.drop_contaminated(df, bench)):
        intact(out, df)
    assert {r["doc_id"] for r in decontamination.drop_contaminated(df, bench).collect()} == {None, *range(4, 30)}
    sharding.write_shards(df, str(tmp_path / "s"), limit=2000)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert set(back.columns) == {*df.columns, "_shard"}
    intact(back.select(df.columns), df)
    for op in (simhash.near_duplicates(df), substring.find(df), quality.score(df, labels), toxicity.score(df, labels), sharding.assign(df)):
        op.collect()


def test_one_id_for_different_texts(spark):
    rng = random.Random(32)
    a, b, c = (prose(60, rng) for _ in range(3))
    rows = [(1, a), (1, b), (1, b), (2, a), (3, c), (None, c), (None, a + " x"), (None, None), (None, "")]
    kept = [(r["doc_id"], r["text"]) for r in simhash.keep_first(documents(spark, rows)).collect()]
    assert sorted(map(repr, kept))[:2] == sorted(map(repr, [(1, a), (1, b)])) or {(1, a), (1, b), (3, c)} <= set(kept)
    assert sum(not t for _, t in kept) == 1 and (2, a) not in kept and (None, c) not in kept
    good = [(9, prose(50, rng)), (9, "!! " * 40)]
    marks = [(100 + k, prose(50, rng) if k % 2 else "!! " * (30 + k)) for k in range(60)]
    labels = spark.createDataFrame([(100 + k, k % 2, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    left = quality.keep_good(documents(spark, good + marks + [(None, "!! " * 50)]), labels).collect()
    assert [r["text"] for r in left if r["doc_id"] in (9, None)] == [good[0][1]]


def test_large_and_null_ids_in_substrings(spark):
    rng = random.Random(33)
    shared = prose(60, rng)
    ids = [(1 << 62) + 5, (1 << 63) - 1, -(1 << 63), 3, None]
    rows = [(i, f"{prose(9, rng)} {shared} {prose(9, rng)}") for i in ids]
    got = {r["doc_id"]: r["kept_doc_id"] for r in substring.find(documents(spark, rows)).collect()}
    assert got == {i: -(1 << 63) for i in ids if i != -(1 << 63)}
    left = {r["doc_id"]: r["text"] for r in substring.remove(documents(spark, rows)).collect()}
    assert [i for i in ids if shared in left[i]] == [-(1 << 63)]
    two = [(None, f"a {shared} b"), (None, f"c {shared} d")]
    assert sum(shared in r["text"] for r in substring.remove(documents(spark, two)).collect()) == 1


def test_shorter_passages_and_paragraphs(spark):
    rng = random.Random(34)
    shared = prose(22, rng)
    rows = [(k, f"{prose(30, rng)} {shared} {prose(8, rng)}") for k in range(3)]
    assert substring.find(documents(spark, rows)).count() == 0
    assert {(r["doc_id"], r["n_words"]) for r in substring.find(documents(spark, rows), least=20).collect()} == {(1, 22), (2, 22)}
    words = prose(80, rng).split()
    wrap = lambda w: "\n".join(" ".join(w[k : k + 9]) for k in range(0, len(w), 9))
    near = [*words[:40], "one", *words[41:]]
    rows = [(1, prose(20, rng) + "\n\n" + wrap(words) + "\n\n" + prose(20, rng)), (2, prose(9, rng) + "\n \t\n" + wrap(near) + "\n\n\n" + prose(12, rng))]
    found = substring.find(documents(spark, rows)).collect()
    assert [(r["doc_id"], r["first_word"], r["n_words"], r["kept_doc_id"]) for r in found] == [(2, 9, 80, 1)]


def test_items_of_any_length(spark):
    rng = random.Random(35)
    items = [(1, "zylo quent brax"), (None, prose(20, rng)), (3, "漢字仮名交じり文を探す"), (4, "lone"), (5, "...")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, "x Zylo, quent BRAX y"), (2, "x zylo quent y brax"), (3, f"a {items[1][1]} b"), (4, "これは漢字仮名交じり文を探す例"), (5, "a lone b"), (6, "... ..."), (7, prose(30, rng))]
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.find(documents(spark, rows), bench).collect()}
    assert got == {(1, 1), (3, None), (4, 3), (5, 4)}
    assert {r["doc_id"] for r in decontamination.drop_contaminated(documents(spark, rows), bench).collect()} == {2, 6, 7}
    # the same in small blocks
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.find(documents(spark, rows), bench, most=30).collect()} == got
    assert {r["doc_id"] for r in decontamination.drop_contaminated(documents(spark, rows), bench, most=30).collect()} == {2, 6, 7}


def test_simhash_of_very_long_texts():
    rng = random.Random(36)
    text = " ".join(rng.choices(VOCAB, k=50_000)).encode()
    assert simhash.fingerprints([text, b"a b"])[0] == simhash.fingerprints([text], at_once=10**9)[0] == simhash.fingerprints([b"x", text], at_once=17)[1]


def test_simhash_links_in_many_tiles(spark):
    rng = np.random.default_rng(37)
    base = rng.integers(0, 1 << 63, 250, np.uint64)
    flip = lambda v, n: v ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(63, n, False).astype(np.uint64))
    values = np.unique(np.concatenate([base, [flip(v, 1 + k % 4) for k, v in enumerate(base[:120])], [0, 1, 7, 15]]).astype(np.uint64))
    signed = values.view(np.int64).tolist()
    true = {tuple(sorted((signed[i], signed[j]))) for i in range(len(values)) for j in range(i) if int(values[i] ^ values[j]).bit_count() <= 3}
    from test_operators import classes

    got = [(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), tile_rows=5).collect()]
    assert classes(signed, got) == classes(signed, true) and {tuple(sorted(e)) for e in got} <= true


def test_bpe_of_very_long_words():
    own = bpe.WordBpe(bpe.read_spec(bpe.word_bpe_path()))
    rng = random.Random(38)
    for alphabet in ("ab", "abcdefghijklmnopqrstuvwxyz", "the"):
        word = "".join(rng.choices(alphabet, k=700))
        parts = own.units(word)
        want, get = list(parts), own.rank.get
        while True:  # step by step
            ranks = [get(x << 32 | y, bpe.NONE) for x, y in zip(want, want[1:])]
            if not ranks or min(ranks) == bpe.NONE:
                break
            k = ranks.index(min(ranks))
            want[k : k + 2] = [own.made[ranks[k]]]
        assert own.merge_long(list(parts)) == want
    begun = time.time()
    own.merge(own.units("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))))
    assert time.time() - begun < 60


def test_warc_misses_nothing_silently(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a/\r\n%0Ax", "a" * 2000), (2, None, "b"), (3, "http://a", "a" * 2000), (3, "http://a", "a" * 2000), (None, " u ", "b")], "page_id long, url string, html string")
    h, p = f"{tmp_path}/h", f"{tmp_path}/p"
    warc.write_archive(df, h, p)
    rows = warc.read_records(spark, h, p).collect()
    assert sorted((r["page_id"] or 0, r["url"]) for r in rows) == [(0, " u "), (1, "http://a/\r\n%0Ax"), (2, ""), (3, "http://a"), (3, "http://a")]
    names = [bytes(r["header"]).split(b"WARC-Record-ID: <")[1].split(b">")[0] for r in rows]
    assert len(set(names)) == 5
    dates = {bytes(r["header"]).split(b"WARC-Date: ")[1].split(b"\r\n")[0] for r in rows}
    assert len(dates) == 1 and len(dates.pop()) == len("2020-01-01T00:00:00Z")
    spark.read.parquet(p).where(F.length("payload") > 1000).write.parquet(f"{tmp_path}/part")
    with pytest.raises(Exception, match="no stored payload"):
        warc.read_records(spark, h, f"{tmp_path}/part").collect()


def test_relative_and_listed_links(spark):
    rows = [
        (1, "http://c.net/es/", ""), (2, "http://a.org/p/q/r.html?x=1", "<link rel='x canonical' href='http://c.net/es/'>"), (3, "http://b.org/p/q/r.html", "<link rel=canonical href='../s.html'>"),
        (4, "http://b.org/p/s.html", "<link rel=canonical href='http://c.net/es/'>"), (5, "http://d.org/p?a=1", "<link rel=canonical href='?a=2'>"), (6, "http://d.org/p?a=2", "<link rel=canonical href='http://c.net/es/'>"),
        (7, "http://e.org/p", "<link rel='noncanonical' href='http://c.net/es/'>"), (8, "http://f.org/a/b/c", "<link rel=canonical href='./../../../x'>"), (9, "http://f.org/x", "<link rel=canonical href='http://c.net/es/'>"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in urlfilter.judge(df).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "block", 7: "allow", 8: "block", 9: "block"}


def test_embeddings_across_blocks(spark):
    # a window and blocks far smaller than the table, and many partitions: what the passes find hangs on none of them
    rng = np.random.default_rng(39)
    x = rng.standard_normal((3000, 24))
    twins = x[:400] / np.linalg.norm(x[:400], axis=1, keepdims=True) + 0.055 * rng.standard_normal((400, 24))
    v = np.vstack([x, twins]).astype(np.float32).astype(float)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    true = [tuple(p) for p in np.argwhere(np.triu(unit @ unit.T >= 0.95, 1)).tolist()]
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(v)], "vec_id long, embedding array<double>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for parts in ("2", "37"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = {r["vec_id"]: r["component_id"] for r in embeddings.near_duplicates(df, window=8).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        found.append(sum(got[a] == got[b] for a, b in true))
    assert found[0] == found[1] >= 0.97 * len(true) and len(true) > 200


def test_quality_against_dense_arithmetic(spark):
    rng = np.random.default_rng(40)
    x = rng.standard_normal((500, quality.N_STATS))
    y = (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(float)
    rows = spark.createDataFrame([(r.tolist(), float(t)) for r, t in zip(x, y)], "x array<double>, y double").repartition(7)
    phi = quality.Fourier(x.mean(0), x.std(0), 4.0)
    a, b = quality.normal_equations(rows, phi)
    f = phi(x)
    assert np.allclose(a, f.T @ f) and np.allclose(b, f.T @ y)
    # the features' products come near the kernel
    z = (x - x.mean(0)) / x.std(0)
    wide = quality.Fourier(x.mean(0), x.std(0), 4.0, features=20_000)
    k = wide(x[:20])[:, :20_000]
    kernel = np.exp(-((z[:20, None] - z[None, :20]) ** 2).sum(-1) / (2 * 16))
    assert np.abs(k @ k.T - kernel).max() < 0.05


def test_toxicity_gradient_and_bounds(spark):
    texts = ["aa bb cc", "bb dd aa", "xx yy bb", "yy zz aa"] * 5
    y = [0, 0, 1, 1] * 5
    model = toxicity.train(texts, y, epochs=60)
    s = model.score(texts)
    assert ((s > 0.5).astype(int) == np.array(y)).all()
    # the margin of a text is the mean of its words' vectors, each the mean of its subwords', times the softmax
    words = "xx yy bb".split()
    vec = lambda w: model.vectors[toxicity.slots([w])[0]].mean(axis=0) * model.weight.get(w, 1.0)
    z = np.mean([vec(w) for w in words], axis=0) @ model.out + model.bias
    assert abs(1 / (1 + np.exp(z[0] - z[1])) - s[2]) < 1e-5
    rng = random.Random(41)
    rows = [(k, prose(40, rng) + (" grobnik" if k % 2 else "")) for k in range(60)] + [(61, "grobnik " * 50_000)]
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(62)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(documents(spark, rows), labels, most=20_000).collect()}  # the long text is beyond the bytes
    assert len(got) == 61 and got[61] > 0.5


def test_scratch_belongs_to_its_scope(spark):
    outer = storage.Scratch(spark, "outer").save(spark.range(3))
    with storage.scope("inner"):
        inner = storage.Scratch(spark, "inner").save(spark.range(4))
    storage.release(spark, "inner")
    assert outer.count() == 3
    with pytest.raises(Exception):
        inner.count()
    storage.release(spark)


def test_warc_buckets_and_hot_payloads(spark, tmp_path):
    """Payloads stay in their buckets; records of a payload that two thirds of them share are rebuilt in several shares."""
    rng = random.Random(17)
    hot = prose(300, rng)
    rows = [(k, f"http://h/{k}", hot if k % 3 else prose(5 + k % 200, rng)) for k in range(90)] + [(90, None, None), (None, "http://h/x", hot)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    h, p = f"{tmp_path}/h", f"{tmp_path}/p"
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        buckets = warc.write_archive(df, h, p)
        records = warc.read_records(spark, h, p, buckets)
        plan = records._jdf.queryExecution().executedPlan().toString()
        plain = warc.read_records(spark, h, p)
        told = lambda d: sorted((r["page_id"] is None, r["page_id"] or 0, r["record_type"], r["refers_to"], bytes(r["payload"]), bytes(r["record"])) for r in d.collect())
        got = told(records)
        assert got == told(plain) and len(got) == len(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Bucketed: true" in plan
    assert [x[4].decode() for x in got[:91]] == [r[2] or "" for r in rows[:91]]
    kinds = {x[1]: (x[2], x[3]) for x in got[:91]}
    assert kinds[89] == ("response", None) and all(kinds[k] == ("revisit", 89) for k in range(88) if k % 3)
