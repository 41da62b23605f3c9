import pytest
from pyspark.sql import functions as F

from corploom.operators import bundle, catalog, edits, evidence, graph
from corploom.sources import raw_json, sinks

USE = "void {0}(int p)\n{{\n  send({1}(p + 0x1c), 1);\n  *(int *)(p + 0x1c) = 1;\n  *(short *)(p + 0x2c) = 2;\n  put(*(char *)(p + 0x30));\n}}"


def functions(spark):
    rows = [(f"0000000{k}", name, USE.format(name, "*(int *)")) for k, name in enumerate(("one", "two", "three"), 1)]
    rows += [("00000008", "put", "int put(int c)\n{\n  return c;\n}"), ("00000009", "jump", "void jump(void)\n{\n  goto LAB_2;\n  work();\n  goto LAB_1;\nout:\n LAB_1: \n  clean();\n  done();\nLAB_2:\n  x();\n}")]
    rows += [("0000000a", "pass", "void pass(void)\n{\n  char b[8];\n  x = b[1];\n  put(&b);\n}")]
    return spark.createDataFrame(rows, "address string, ghidra_name string, code string")


def test_bundles(spark):
    got = {r["address"][-1]: r["bundle"] for r in bundle.bundles(functions(spark)).collect()}
    assert set(got) == {"1", "2", "3", "9", "a"}
    assert "+0x1c: 4B; int; read, write; calls send arg0/2" in got["1"]
    assert "kin 0x00000002 p: 3 offsets shared (+0x1c, +0x2c, +0x30), score 2.00" in got["1"]
    assert "repeated in three functions or more:\n    +0x1c: one, three, two; calls send/arg0\n    +0x2c: one, three, two\n    +0x30: one, three, two; calls put/arg0" in got["1"]
    assert "roles passed_to_send_arg0" in got["1"] and "line 4: *(int *)(p + 0x1c) = 1;\n      L1: void one(int p)" in got["1"] and "write line 5: *(short *)(p + 0x2c) = 2;" in got["1"]
    assert "callee put:\nint put(int c)" in got["1"] and "callee put:" in got["a"]
    assert got["9"] == "label LAB_2 (line 10):\nLAB_2:\n  x();\n}\nlabel LAB_1 (line 7):\n LAB_1: \n  clean();\n  done();"
    tails = functions(spark).where("ghidra_name = 'put'").withColumn("code", F.concat(F.lit("goto LAB_a;\nLAB_a:\n"), F.repeat(F.lit("y;\n"), 30)))
    assert [(r["label"], r["line_no"], r["body"].count("\n"), r["cut"]) for r in catalog.goto_tails(tails).collect()] == [("LAB_a", 2, 9, True)]
    long = functions(spark).where("ghidra_name = 'put'").withColumn("code", F.concat(F.lit("int put(int c)\n{\n goto LAB_e;\nLAB_e:\n"), F.repeat(F.lit("x"), 13_000)))
    assert len(bundle.bundles(long).first()["bundle"]) < 12_100


def test_pcode(spark):
    lines = "  0x1: (r, 1, 4) = LOAD(a)\n0x2: = COPY(b)\n0x3: STORE(c)\n0x4: CAST(d)\n0x5: INT_MULT(e)\n"
    rows = [(lines, "*(int *)(p + 4)"), ("0x1: LOAD(a)", "return p + 4;"), ("0x1: LOAD(a)", "x = p[0x10];"), ("0x1: LOAD(a)", "x = p[16];"), ("0x1: LOAD(a)", ""), ("", "*(int *)(p + 4)"), ("LOAD " * 2000, "")]
    got = [r[0] for r in spark.createDataFrame(rows, "pcode string, code string").select(catalog.relevant_pcode(F.col("pcode"), F.col("code"))).collect()]
    assert got[:6] == ["0x1: (r, 1, 4) = LOAD(a)\n0x3: STORE(c)\n0x4: CAST(d)", "", "0x1: LOAD(a)", "", "0x1: LOAD(a)", ""]
    assert len(got[6]) == 6015 and got[6].endswith("\n...(truncated)")


def test_facts_of_nested_text(spark):
    code = "int f(void)\n{\n  g(h((int)(*(undefined4 *)((char *)q + 8)), b) + 1, *(char **)(*(int *)(r + 0xc) + 4));\n  int w[4]; w[2] = q[3]; if (w[1] == 2) t = *(longlong *)(s + 0xffffffffffffffff);\n  x = k(*(uint *)(y + 4)) + *(int *)(z + 2)"
    got = {(r["base"], r["offset"]): r for r in evidence.access_facts(spark.createDataFrame([("1", "", code)], "address string, ghidra_name string, code string")).collect()}
    # the outer access of *(char **)(*(int *)(r + 0xc) + 4) has no plain base
    assert set(got) == {("q", 8), ("r", 12), ("w", 2), ("q", 3), ("w", 1), ("s", -1), ("y", 4), ("z", 2)}
    assert (got["q", 8]["callee"], got["q", 8]["arg_index"], got["q", 8]["arg_count"], got["q", 8]["function"]) == ("h", 0, 2, "FUN_1")
    assert (got["r", 12]["callee"], got["r", 12]["arg_index"], got["r", 12]["arg_count"]) == ("g", 1, 2)
    assert (got["w", 2]["access_mode"], got["w", 2]["byte_offset"], got["w", 1]["access_mode"], got["w", 1]["callee"]) == ("write", 8, "read", "")
    assert got["s", -1]["size"] == 8 and got["q", 3]["snippet"] == "w[2] = q[3];"
    assert got["y", 4]["roles"] == ["participates_in_pointer_or_offset_addition", "passed_to_k_arg0", "read_on_assignment_rhs"] and got["z", 2]["callee"] == ""
    long = "a; x = " + "y + " * 100 + "*(int *)(p + 4);"
    snippet = evidence.facts_of("1", "f", long)[0][7]
    assert len(snippet) <= 220 and snippet.endswith("...") and snippet.startswith("x = y")


def test_indirect_edges(spark):
    f = [("1", "main", "void main(void)\n{\n  table[0] = run(x);\n}"), ("2", "run", "int run(int a, int b)\n{\n}"), ("3", "loop", "void loop(int a)\n{\n  switch (a) {\n  case 1: break;\n  }\n  t[ i ](a);\n}"), ("4", "quiet", "int quiet(int a, int b)\n{\n}")]
    functions = spark.createDataFrame(f, "address string, name string, code string")
    pairs = spark.createDataFrame([("1", "2"), ("3", "2"), ("4", "2"), ("4", "1")], "source string, suspect string")
    got = {(r["source"], r["suspect"]): r for r in catalog.indirect_candidates(functions, pairs).collect()}
    assert (got["1", "2"]["named_line"], got["1", "2"]["confirmed"], got["1", "2"]["signature_fits"]) == (3, True, True)
    assert (got["3", "2"]["named_line"], got["3", "2"]["table_line"], got["3", "2"]["switches"], got["3", "2"]["confirmed"]) == (None, 6, 2, True)
    assert not got["4", "2"]["confirmed"] and got["4", "2"]["signature_fits"] and not got["4", "1"]["signature_fits"]


def test_edits(spark):
    corpus = spark.createDataFrame([("1", "a b a"), ("2", "c"), ("3", "x.y")], "address string, code string")
    e = spark.createDataFrame([("1", "a", "z"), ("2", "c", "d"), ("3", "q", "r")], "address string, old string, new string")
    got = {r["address"]: (r["code"], r["status"]) for r in edits.unique_edits(corpus, e).collect()}
    assert got == {"1": ("a b a", "ambiguous"), "2": ("d", "edited"), "3": ("x.y", "missing")}
    done = edits.substitute(corpus, "code", r"\ba\b", "n")
    assert edits.substitution_totals(done).first().asDict() == {"occurrences": 2, "texts": 1}
    assert [r["code"] for r in edits.rename_symbol(corpus, "code", "a", "zed").collect()][0] == "zed b zed"
    with pytest.raises(ValueError):
        edits.rename_symbol(corpus, "code", "a", "1x")
    new = spark.createDataFrame([("2", "\nint x;"), ("3", "#include <t>\nint y;\n")], "address string, code string")
    assert {r["address"]: r["code"] for r in edits.rewrite(corpus, new, "#include <t>\n").collect()} == {"1": "a b a", "2": "#include <t>\nint x;\n", "3": "#include <t>\nint y;\n"}
    log = spark.createDataFrame([(2, "types", "edit", "1"), (1, "naming", "rename", ""), (3, "", "edit", "2")], "seq int, agent string, tool string, address string")
    assert {r["agent"]: r["changes"] for r in edits.changes_by_agent(log).collect()} == {"types": 1, "naming": 1}
    assert [r["line"][:8] for r in edits.review_log(log).collect()] == ['{"seq":1', '{"seq":2', '{"seq":3']
    assert {r["tool"]: (r["changes"], r["addresses"]) for r in edits.change_totals(log).collect()} == {"edit": (2, 2), "rename": (1, 1)}
    layouts = spark.createDataFrame([("a", 1), ("b", 2)], "name string, size int")
    assert {(r["name"], r["size"]) for r in edits.rename_layout(layouts, "a", "c").collect()} == {("c", 1), ("b", 2)}
    assert {(r["name"], r["size"]) for r in edits.rename_layout(layouts, "a", "b").collect()} == {("b", 2)}
    sym = spark.createDataFrame([("FUN_1", "run"), ("FUN_2", "stop")], "symbol string, canonical_name string")
    want = spark.createDataFrame([("FUN_1", "run", "function"), ("FUN_2", "go", "function"), ("FUN_3", "new", "constant"), ("FUN_4", "1x", "function"), ("FUN_5", "y", "oops")], "symbol string, canonical_name string, kind string")
    assert {r["symbol"][-1]: r["status"] for r in edits.resolve_batch(want, sym).collect()} == {"1": "same", "2": "conflict", "3": "applied", "4": "invalid", "5": "applied"}


def test_flows_and_handlers(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e")], "src string, dst string")
    node = lambda *x: spark.createDataFrame([(v,) for v in x], "node string")
    assert {r["node"] for r in graph.flows(e, node("a", "d"), node("c")).collect()} == {"a"}
    more = spark.createDataFrame([("e", "c")], "src string, dst string")
    assert {r["node"] for r in graph.flows(e, node("a", "d"), node("c"), more).collect()} == {"a", "d"}
    f = spark.createDataFrame([("a", "handle_x", "int handle_x(struct pkt *p)\n{\n}"), ("b", "handle_y", "int handle_y(void)\n{\n}")], "address string, name string, code string")
    assert [r["address"] for r in graph.handlers(f, e, node("c"), "handle_.*", r"struct pkt \*p").collect()] == ["a"]


def test_reports(spark, tmp_path):
    import json

    for address, level, calls in (("0x1", "high", ["system(x)", "strlen"]), ("0x2", "low", [])):
        (tmp_path / address).mkdir()
        (tmp_path / address / "summary.json").write_text(json.dumps({
            "function_name_suggestion": "f" + address, "summary": "  a   b ", "security_relevance": {"level": level, "reason": "r"}, "api_calls": calls,
            "important_strings": ["x", "NEW_DEVICE"], "side_effects": ["calls system(x)", "fine"], "confirmed_behaviors": ["b"] * 9,
        }, indent=1))
    rows = sinks.summaries(raw_json.read_summaries(spark, str(tmp_path)))
    a = spark.createDataFrame([("0x1", "x\n\t system(a);\n" + "popen(b)\n" * 4, "strcpy(b, c);\nstrcat(d);"), ("0x2", "", None)], "address string, named string, structured string")
    r = sinks.risk_candidates(rows, a).collect()
    assert [(x["address"], x["level"], x["summary"], x["risk_apis"], x["risk_strings"], x["side_effects"], len(x["behaviors"]), x["confidence"]) for x in r] == [("0x1", "high", "a b", ["system(x)"], ["NEW_DEVICE"], ["calls system(x)"], 8, "unknown")]
    assert [(x["file"], x["line_no"], x["snippet"]) for x in r[0]["snippets"]][::5] == [("named", 2, "system(a);"), ("structured", 1, "strcpy(b, c);")] and len(r[0]["snippets"]) == 6
    text = sinks.report_appendix(sinks.risk_candidates(rows, a)).first()["text"]
    assert text.startswith("### f0x1 (0x1)") and "- risky calls:\n  - `system(x)`" in text and "  - `named:2` `system(a);`" in text
    m = sinks.manifest(spark.createDataFrame([("1", "produced"), ("2", "failed"), ("3", None)], "address string, status string")).first()
    assert (m["selected"], m["produced"], m["failed"], m["not_run"], m["full_success"]) == (3, 1, 1, 1, False)
    assert not sinks.manifest(spark.createDataFrame([("1", "produced")], "address string, status string"), database=False).first()["full_success"]
    listed = sinks.manifest_entries(spark.createDataFrame([("2", "failed", "n", "why"), ("1", "produced", "", "")], "address string, status string, name string, reason string"))
    assert [tuple(x) for x in listed.collect()] == [("failed", "2", "n", "why")]
    skipped = spark.createDataFrame([("2", "g", "odd"), ("1", None, None)], "address string, name string, reason string")
    assert [x["line"] for x in sinks.skipped_lines(skipped).collect()] == ["0x1 |  | ", "0x2 | g | odd"]
    facts = evidence.access_facts(functions(spark))
    objects = [json.loads(x["object"]) for x in evidence.evidence_json(facts).collect()]
    assert [(o["address"][-1], o["base"], o["offsets"], len(o["facts"])) for o in objects][:1] == [("1", "p", ["0x1c", "0x2c", "0x30"], 4)] and objects[0]["facts"][0]["roles"] == ["passed_to_send_arg0"]
    text = spark.createDataFrame([("a\r\n\n\n\nb \n\n",)], "x string")
    assert text.select(sinks.normal_text(F.col("x")), sinks.normal_code(F.col("x"))).first()[:] == ("a\n\nb\n", "a\nb")
    inputs = spark.createDataFrame([("1", "n", "a -> b"), ("2", "n", None), ("3", "", "x")], "address string, named string, naming_map string")
    assert {x["address"]: x["text"] for x in raw_json.summary_inputs(inputs).collect()} == {"1": "n\n\nNAMING_MAP:\na -> b", "2": "n"}


def test_alike_of_all_sizes(spark):
    """Few and many offsets, ten of which half of all objects share, against all pairs."""
    import random

    from corploom.operators import similarity

    rng = random.Random(8)
    sets = {}
    for k in range(70):
        own = {1000 + rng.randrange(60) for _ in range(rng.choice([1, 2, 4, 9, 14, 25]))}
        sets[f"o{k:02d}"] = own | (set(range(10)) if k % 2 else set())
    sets["o70"], sets["o71"] = sets["o03"], set(sets["o03"])  # one class
    writes = {o: set(rng.sample(sorted(s), len(s) // 4)) for o, s in sets.items()}
    calls = {o: {f"c{rng.randrange(12)}"} if rng.random() < 0.3 else set() for o in sets}
    facts = spark.createDataFrame([(o, x, x in writes[o]) for o, s in sets.items() for x in s], "obj string, off int, is_write boolean")
    met = spark.createDataFrame([(o, c) for o, s in calls.items() for c in s], "obj string, callee string")
    for writer in (False, True):
        want = set()
        for a, x in sets.items():
            scored = [(-len(x & y) / len(x | y) - bool(calls[a] & calls[b]), b) for b, y in sets.items() if b != a and len(x & y) >= 2 and len(x) >= 2]
            ranked = [b for _, b in sorted(scored)]
            slot = next((k for k, b in enumerate(ranked) if x <= sets[b] and writes[b] & x), None) if writer else None
            if slot is not None and len(ranked) > 1:
                ranked.insert(1, ranked.pop(slot))
            want |= {(a, b, k) for k, b in enumerate(ranked[:3], 1)}
        got = similarity.related(facts, met, limit=3, writer=writer).collect()
        assert {(r["a"], r["b"], r["place"]) for r in got} == want
        assert all(abs(r["score"] - len(sets[r["a"]] & sets[r["b"]]) / len(sets[r["a"]] | sets[r["b"]]) - bool(calls[r["a"]] & calls[r["b"]])) < 1e-9 for r in got)
