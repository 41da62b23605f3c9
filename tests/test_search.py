"""Search from postings against the scan; the lexer's table functions in SQL; counts without a second scan."""

import random

import pyarrow as pa
from pyspark.sql import functions as F
from test_flow import CODE

from corploom.operators import corpus, evidence, facts, search, table_functions


def test_search_from_postings(spark, tmp_path):
    rng = random.Random(9)
    words = ["goto", "LAB_1", "return", "Über", "x", "ab", "(int)", "system", "  ", "Straße"]
    rows = [(f"{k:04x}", "\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 9)))) for k in range(150)]
    docs = spark.createDataFrame([*rows, ("ffff", None), ("fffe", ""), (None, "system")], "address string, code string")
    path = str(tmp_path / "index")
    search.build(docs.repartition(3), path, "address", "code")
    known = docs.where("address is not null")
    for needle in ("System", "ÜBER", "t) g", "none such", "ab"):
        for limit in (2, 1000):
            want = [tuple(r) for r in corpus.search_text(known, "address", "code", needle, limit).collect()]
            assert [tuple(r) for r in search.search(spark, path, needle, limit).collect()] == want, (needle, limit)
    few = search.candidates(spark, path, "goto system")
    assert 0 < few.count() < 150 and search.candidates(spark, path, "zzz").count() == 0 and search.candidates(spark, path, "ab") is None
    search.build(docs.limit(0), path, "address", "code")
    assert search.search(spark, path, "system").count() == 0


def test_postings_are_lists_of_keys(spark, tmp_path, monkeypatch):
    rows = [(k, "goto LAB_1;\n\U0001f600\u00dcber\u00df" + "x" * (k % 3)) for k in range(300)]
    path = str(tmp_path / "index")
    search.build(spark.createDataFrame(rows, "k long, code string").coalesce(1), path, "k", "code")
    held = spark.read.parquet(f"{path}/postings").where("gram = 'got'")
    assert held.count() <= 2 and sorted(k for r in held.collect() for k in r["keys"]) == list(range(300))  # no row for each text
    counts = {r["gram"]: r["n"] for r in spark.read.parquet(f"{path}/counts").collect()}
    assert counts == {g: sum(g in search.grams(t.lower()) for _, t in rows) for g in set().union(*(search.grams(t.lower()) for _, t in rows))}
    # any characters; a text longer than what is numbered at once has each trigram once, many characters are numbered for fewer texts
    rng = random.Random(3)
    texts = ["", "ab", "\n\n", *("".join(rng.choice("ab\n\u00df\u20ac\U0001f600 \x00") for _ in range(rng.randrange(60))) for _ in range(20))]
    many = ["".join(map(chr, range(k << 16, k + 1 << 16))) for k in range(1, 17)]
    for at_once, some in ((1 << 22, texts), (5, texts), (1 << 22, many)):
        monkeypatch.setattr(search, "AT_ONCE", at_once)
        got = [(g, k) for b in search._lists(pa.array(range(len(some))), some) for g, n, keys in zip(*(c.to_pylist() for c in b.columns)) for k in keys if n == len(keys)]
        if some is texts:
            assert sorted(got) == sorted((g, k) for k, t in enumerate(texts) for g in search.grams(t))
        else:
            assert len(got) == len(set(got)) == sum(len(t) - 2 for t in many)


def test_table_functions(spark):
    rows = [(f"{k:08x}", n, c) for k, (n, c) in enumerate(sorted(CODE.items()))] + [("000000ff", None, "int f(int *p)\n{\n  return *(int *)(p + 8) + q->x;\n}"), ("000000fe", "none", None)]
    f = spark.createDataFrame(rows, "address string, ghidra_name string, code string")
    f.createOrReplaceTempView("told_functions")
    assert set(table_functions.register(spark, "c_")) == {f"c_{n}" for n in table_functions.FUNCTIONS}
    ask = lambda what: sorted(map(repr, spark.sql(f"SELECT {what}").collect()))
    plain = lambda df: sorted(map(repr, df.collect()))
    assert ask("a.* FROM told_functions f, LATERAL c_accesses(f.address, f.ghidra_name, f.code) a") == plain(evidence.access_facts(f)) != []
    assert ask("f.address AS caller, a.* FROM told_functions f, LATERAL c_arguments(f.code) a") == plain(facts.call_arguments(f)) != []
    assert ask("base, member FROM (SELECT u.base, u.field AS member FROM told_functions f, LATERAL c_member_uses(f.code) u)") == ["Row(base='cmd', member='len')", "Row(base='j', member='line')", "Row(base='j', member='line')", "Row(base='q', member='x')"]
    assert ask("f.ghidra_name, p.name FROM told_functions f, LATERAL c_parameter_names(f.code) p WHERE f.ghidra_name = 'sum'") == ["Row(ghidra_name='sum', name='a')", "Row(ghidra_name='sum', name='b')"]


def test_one_scan_counts(spark):
    f = spark.createDataFrame([("1", "_start"), ("2", "main"), ("3", "_INIT_0")], "address string, ghidra_name string")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("select", "select")
    kept, counts = corpus.select_functions(f)
    jobs = len(tracker.getJobIdsForGroup("select"))
    spark.sparkContext.setJobGroup("rest", "rest")
    assert counts.first().asDict() == {"raw": 3, "runtime": 2} and [r["address"] for r in kept.collect()] == ["2"] and jobs == 1
