import json
import random

import pytest
from pyspark.sql import functions as F

from corploom.operators import catalog, corpus, evidence, export, graph, registry, similarity, validation
from corploom.sources import raw_json, sinks


def functions(spark, rows):
    return spark.createDataFrame(rows, "address string, ghidra_name string, code string")


def test_read_functions(spark, tmp_path):
    for name, body in {
        "a.json": {"address": "0x401000", "ghidra_name": "old", "code": "x"},
        "b.json": {"address": "00401000", "ghidra_name": "new", "code": None},
        "c.json": {"address": "zz", "ghidra_name": "bad"},
        "_skip.json": {"address": "1", "ghidra_name": "no"},
    }.items():
        (tmp_path / name).write_text(json.dumps(body, indent=1))
    got = raw_json.read_functions(spark, str(tmp_path)).collect()
    assert [(r["address"], r["ghidra_name"], r["code"], r["pcode"]) for r in got] == [("00401000", "new", "", "")]
    (tmp_path / "d.json").write_text("{oops")
    with pytest.raises(Exception):
        raw_json.read_functions(spark, str(tmp_path)).collect()


def test_runtime_stubs(spark):
    df = functions(spark, [("1", n, "") for n in ("_start", "_INIT_0", "_DT_FINI", "main", "start")])
    assert {r["ghidra_name"] for r in corpus.drop_runtime_stubs(df).collect()} == {"main", "start"}


def fold(rows, gap):
    """Sequential oracle of overlap removal."""
    rows = sorted(rows)
    gone = {}
    for (a, ra, fa), (b, rb, fb) in zip(rows, rows[1:]):
        if not 0 < b - a <= gap or a in gone or b in gone:
            continue
        if ra and not rb:
            gone[b] = "callsite"
        elif rb and not ra:
            gone[a] = "callsite"
        elif not ra and not rb and fa == fb:
            gone[b] = "fingerprint"
    return gone


@pytest.mark.parametrize("seed", [0, 1])
def test_overlap_against_fold(spark, seed):
    random.seed(seed)
    at, rows = 65_400, []
    for _ in range(150):
        at += random.choice([4, 8, 12, 16, 17, 40])
        rows.append((at, random.choice([0, 0, 1]), random.choice("xy")))
    got = corpus.drop_overlapping(spark.createDataFrame(rows, "k long, refs int, f string"), "k", "refs", "f").collect()
    assert {r["k"]: r["reason"] for r in got if r["dropped"]} == fold(rows, 16) and len(got) == len(rows)


CODE = [
    ("00000001", "main", "int main(void)\n{\n  helper(1);\n  FUN_00000003();\n  return 0;\n}"),
    ("00000002", "helper", "int helper(int a)\n{\n  return leaf(a, \"x\");\n}"),
    ("00000003", "leaf", "int leaf(int a, int b)\n{\n  return a;\n}"),
    ("00000004", "loop", "void loop(void)\n{\n  loop(); twin();\n}"),
    ("00000005", "twin", "void twin(void)\n{\n  loop();\n}"),
    ("00000006", "user", "void user(void)\n{\n  twin();\n}"),
]


def test_edges_layers_and_catalog(spark):
    f = functions(spark, CODE)
    edges = graph.call_edges(f)
    pairs = {(r["caller"][-1], r["callee"][-1]) for r in edges.collect()}
    assert pairs == {("1", "2"), ("2", "3"), ("4", "5"), ("5", "4"), ("6", "5")}
    assert {(r["caller"][-1], r["callee"][-1]) for r in graph.placeholder_edges(f).collect()} == {("1", "3")}
    both = edges.select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    layered = graph.layers(f, "address", both)
    got = {r["address"][-1]: r["depth"] for r in layered.collect()}
    assert got == {"3": 0, "2": 1, "1": 2, "4": None, "5": None, "6": None}
    assert {r["label"] for r in graph.layer_places(layered, "address").collect()} == {"d0 1/1", "d1 1/1", "d2 1/1", "cycle 1/3", "cycle 2/3", "cycle 3/3"}
    assert graph.plan_summary(layered).first().asDict() == {"layers": "d0:1 d1:1 d2:1", "cycles": 3}
    united = {(r["src"][-1], r["dst"][-1]) for r in graph.order_edges(f).collect()}
    assert united == pairs | {("1", "3")}
    twice = functions(spark, [("00000001", "FUN_a", "dup(1); FUN_a();"), ("00000002", "dup", ""), ("00000003", "dup", "dup();"), ("00000004", "", "(x)"), ("0000000a", "FUN_a", "")])
    assert {(r["src"][-1], r["dst"][-1]) for r in graph.order_edges(twice).collect()} == {("1", "3"), ("1", "a")}
    assert {(r["caller"][-1], r["callee"][-1]) for r in graph.call_edges(twice).collect()} == {("1", "2"), ("3", "2")}
    assert {(r["caller"][-1], r["callee"][-1]) for r in graph.call_edges(twice, by_name=True).collect()} == {("1", "2")}
    assert [r["address"][-1] for r in graph.node(f, "0x2").collect()] == ["2"] and [r["address"][-1] for r in graph.node(f, "twin").collect()] == ["5"]
    target = spark.createDataFrame([("00000003",)], "node string")
    assert {r["node"][-1] for r in graph.reaches(both, target).collect()} == {"1", "2", "3"}

    cat = catalog.build(f.withColumnRenamed("ghidra_name", "name"), edges)
    rows = {r["name"]: r for r in cat.collect()}
    assert rows["main"]["is_entry"] and rows["main"]["n_callees"] == 1 and rows["twin"]["n_callers"] == 2
    assert rows["main"]["placeholders"] == ["FUN_00000003"] and rows["leaf"]["params"] == ["int a", "int b"]
    assert [r["name"] for r in catalog.browse(cat, "entries").collect()] == ["main", "user"]
    assert [r["name"] for r in catalog.browse(cat, "unknown", "FUN_0").collect()] == ["main"]
    sites = catalog.call_sites(f.withColumnRenamed("ghidra_name", "name"), edges).where("callee = '00000003'").collect()
    assert [(s["caller"][-1], s["line_no"], s["snippet"]) for s in sites] == [("2", 3, 'return leaf(a, "x");')]
    assert cat.where("address = '00000001'").select(catalog.row_line()).first()[0] == "0x00000001 | main | int | (void) | callers:0 callees:1 | entry,ph:1"
    told = {r["address"][-1]: r["text"] for r in catalog.detail(cat, edges).collect()}
    assert "resolved callees: leaf(0x00000003)" in told["2"] and "callers: main(0x00000001)" in told["2"] and "body preview:\nreturn a;" in told["3"]
    review = catalog.review_context(cat)
    assert review["totals"].first().asDict() == {"functions": 6, "placeholders": 1, "indirect_sites": 0}
    assert [r["name"] for r in review["entries"].collect()] == ["main", "user"] and review["notable"].count() == 1
    maps = spark.createDataFrame([("00000001", " a -> b\n" + "x" * 900)], "address string, naming_map string")
    cut = {r["address"][-1]: r["naming_map"] for r in catalog.with_naming_maps(cat, maps).collect()}
    assert cut["1"].endswith("x\n...(truncated)") and len(cut["1"]) == 800 + 15 and cut["2"] == ""
    wrong = validation.signature_audit(edges, f).collect()
    assert [(w["caller"][-1], w["position"], w["argument"]) for w in wrong] == [("2", 1, '"x"')]


def test_search(spark):
    df = spark.createDataFrame([(1, "a\nNEEDLE x\n"), (0, "needle"), (2, None)], "k long, code string")
    assert [(r["k"], r["line_no"]) for r in corpus.search_text(df, "k", "code", "Needle").collect()] == [(0, 1), (1, 2)]


def test_access_facts(spark):
    code = "void f(int param_1)\n{\n  uint buf[16];\n  int *words;\n  *(uint *)(param_1 + 0x1c) = send(1, *(short *)(param_1 + 44));\n  x = words[0x10] + other[7];\n}"
    rows = {(r["base"], r["offset"]): r for r in evidence.access_facts(functions(spark, [("1", "f", code)])).collect()}
    assert set(rows) == {("param_1", 28), ("param_1", 44), ("words", 16), ("other", 7)}
    assert rows["param_1", 28]["access_mode"] == "write" and rows["param_1", 28]["size"] == 4 and rows["param_1", 28]["line_no"] == 5
    assert (rows["param_1", 44]["callee"], rows["param_1", 44]["arg_index"], rows["param_1", 44]["arg_count"], rows["param_1", 44]["size"]) == ("send", 1, 2, 2)
    assert rows["words", 16]["byte_offset"] == 64 and rows["other", 7]["byte_offset"] is None
    offs = evidence.effective_offsets(evidence.access_facts(functions(spark, [("1", "f", code)]))).collect()
    assert sorted(r["off"] for r in offs) == [28, 44, 64]


def test_similarity_and_writer(spark):
    rows = [("t", o, False) for o in (1, 2, 3)] + [(f"r{k}", o, False) for k in range(4) for o in (1, 2, 3)] + [("w", o, True) for o in (1, 2, 3, 4, 5)] + [("z", 9, False)]
    facts = spark.createDataFrame(rows, "obj string, off long, is_write boolean")
    plain = facts.drop("is_write")
    top = [(r["b"], round(r["score"], 2), r["place"]) for r in similarity.related(plain, limit=3).where("a = 't'").orderBy("place").collect()]
    assert top == [("r0", 1.0, 1), ("r1", 1.0, 2), ("r2", 1.0, 3)]
    got = [r["b"] for r in similarity.related(facts, limit=3, writer=True).where("a = 't'").orderBy("place").collect()]
    assert got == ["r0", "w", "r1"]
    calls = spark.createDataFrame([("t", "send/0"), ("r3", "send/0")], "obj string, callee string")
    assert similarity.related(plain, calls, limit=1).where("a = 't'").first()["b"] == "r3"
    lone = spark.createDataFrame([("a", 1, False), ("a", 2, False), ("b", 1, True), ("b", 2, True), ("b", 3, True)], "obj string, off long, is_write boolean")
    assert {(r["a"], r["b"], r["place"]) for r in similarity.related(lone, limit=3, writer=True).collect()} == {("a", "b", 1), ("b", "a", 1)}


def test_similarity_against_brute_force(spark):
    rng = random.Random(5)
    held = {f"o{k:02d}": {0, 4, *rng.sample(range(8, 60, 4), rng.randint(0, 4))} if k % 3 else {0, *rng.sample(range(8, 40, 4), 2)} for k in range(60)}
    written = {k: {o for o in v if rng.random() < 0.2} for k, v in held.items()}
    met = {k: {rng.choice("xyz")} if rng.random() < 0.5 else set() for k in held}
    facts = spark.createDataFrame([(k, o, o in written[k]) for k, v in held.items() for o in v], "obj string, off long, is_write boolean")
    calls = spark.createDataFrame([(k, c) for k, v in met.items() for c in v], "obj string, callee string")
    want = set()
    for a in held:
        near = [(-(len(held[a] & held[b]) / len(held[a] | held[b]) + bool(met[a] & met[b])), b) for b in held if b != a and len(held[a] & held[b]) >= 2]
        near.sort()
        first = next((x for x in near if held[a] <= held[x[1]] and written[x[1]] & held[a]), None)
        if first:
            near.remove(first)
            near.insert(1, first)
        want |= {(a, b, round(-s, 9), k) for k, (s, b) in enumerate(near[:3], 1)}
    got = similarity.related(facts, calls, limit=3, writer=True).collect()
    assert {(r["a"], r["b"], round(r["score"], 9), r["place"]) for r in got} == want


def test_consensus_counts_functions(spark):
    # three objects, but two functions: nothing is repeated in three
    f = [("00000001", "one", "f"), ("00000001", "one", "g"), ("00000002", "two", "h")]
    near = spark.createDataFrame([(a, b, 2.0) for a in "fgh" for b in "fgh" if a != b], "a string, b string, score double")
    offsets = spark.createDataFrame([(o, k) for _, _, o in f for k in (1, 2)], "obj string, off long")
    uses = spark.createDataFrame([(o, n, k, f"put/arg{k}") for _, n, o in f for k in (1, 2)], "obj string, function string, off long, call string")
    assert similarity.consensus(near, offsets, uses).count() == 0
    more = uses.withColumn("function", F.col("obj"))
    got = {(r["obj"], r["off"]): r for r in similarity.consensus(near, offsets, more).collect()}
    assert set(got) == {(o, k) for o in "fgh" for k in (1, 2)} and got["f", 1]["functions"] == ["f", "g", "h"] and got["f", 1]["calls"] == ["put/arg1"] and got["f", 1]["sites"] == 3
    assert similarity.consensus(near.withColumn("score", F.lit(1.9)), offsets, more).count() == 0


def test_registries(spark):
    rows = [(1, "s", "a"), (2, "s", "b"), (3, "s", "a"), (1, "q", "c")]
    judged = registry.first_write_wins(spark.createDataFrame(rows, "seq int, sym string, name string"), "sym", ["name"], ["seq"])
    assert {(r["sym"], r["seq"]): r["status"] for r in judged.collect()} == {("s", 1): "inserted", ("s", 2): "conflict", ("s", 3): "updated", ("q", 1): "inserted"}
    log = registry.conflict_log(judged, "sym", ["name"], ["seq"], "symbol").collect()
    assert [(r["name"], r["existing"], r["incoming"]) for r in log] == [("s", '{"name":"a"}', '{"name":"b"}')]
    assert {r["sym"]: r["name"] for r in registry.current_entries(judged, "sym", ["name"], ["seq"]).collect()} == {"s": "a", "q": "c"}


def test_layout_registry(spark):
    f = lambda *x: [{"offset": o, "name": n, "type": t, "size": s} for o, n, t, s in x]
    steps = [
        ("n", f((0, "a", "int", 4)), "inserted"), ("n", f((8, "b", "int", 4)), "merged"), ("n", f((0, "a", "uint", 4)), "conflict"),
        ("n", f((2, "c", "int", 4)), "conflict"), ("n", f((16, "a", "int", 4)), "conflict"), ("n", f((0, "a", "int", 4), (8, "b", "int", 4)), "updated"),
        ("p", f((28, "field_0x1C", "int", 4)), "inserted"), ("p", f((28, "length", "int", 4)), "merged"), ("p", f((28, "other", "int", 4)), "conflict"),
        ("p", [], "rejected"), ("1bad", f((0, "a", "int", 4)), "rejected"),
    ]
    df = spark.createDataFrame([(k, n, v, 0, "medium", "", "") for k, (n, v, _) in enumerate(steps)], "seq long, name string, fields array<struct<offset:bigint,name:string,type:string,size:bigint>>, size long, confidence string, evidence string, source_file string")
    judged = registry.merge_layouts(df)
    got = {r["seq"]: r["status"] for r in judged.collect()}
    assert [got[k] for k in range(len(steps))] == [s for _, _, s in steps]
    held = {r["name"]: r for r in registry.layouts(judged).collect()}
    assert [(x["offset"], x["name"]) for x in held["n"]["fields"]] == [(0, "a"), (8, "b")] and [x["name"] for x in held["p"]["fields"]] == ["length"]
    # a later batch goes on where the registry stands; evidence is added up, and longer fields keep others out
    later = [("n", f((4, "d", "int", 4)), "merged"), ("n", f((10, "e", "char", 1)), "conflict"), ("n", f((-1, "x", "int", 4), (40, "2x", "int", 4), (44, "y", " ", 4)), "rejected"), ("n", f((40, "_pad1", "int", 1), (40, "k", "int", 1)), "merged")]
    more = spark.createDataFrame([(k, n, v, 99, "high", f"seen {k}", "s") for k, (n, v, _) in enumerate(later)], df.schema)
    base = registry.layouts(judged).withColumn("evidence", F.lit("first"))
    again = {r["seq"]: r for r in registry.merge_layouts(more, base).collect()}
    assert [again[k]["status"] for k in range(4)] == [s for _, _, s in later]
    assert again[3]["evidence"] == "first\nMerged compatible fields: seen 0\nMerged compatible fields: seen 3" and (again[3]["size"], again[3]["confidence"], again[3]["source_file"]) == (99, "high", "s")
    line = df.limit(1).select(registry.layout_line(F.col("name"), F.col("fields"), F.lit(8))).first()[0]
    assert line == "struct n (size 0x8): +0x0 a int"


def layout_oracle(rows):
    """A registry of one name, field by field."""
    held, out = {}, []
    for fields in rows:
        if not held:
            status = "inserted"
        elif {o: f[:2] for o, f in held.items()} == {o: f[:2] for o, f in fields.items()}:
            status = "updated"
        else:
            status = "merged"
            for o, (name, kind, size) in fields.items():
                if o in held:
                    upgrade = held[o][0] == f"field_{o:x}" and not name.startswith("field_") and held[o][1] == kind
                    if held[o][:2] != (name, kind) and not upgrade:
                        status = "conflict"
                elif any(n == name for n, _, _ in held.values()) or any(a < o + max(1, size) and o < a + max(1, s) for a, (_, _, s) in held.items()):
                    status = "conflict"
        if status in ("inserted", "updated"):
            held = dict(fields)
        elif status == "merged":
            held |= {o: f for o, f in fields.items() if o not in held or held[o][:2] != f[:2]}
        out.append((status, sorted(held.items())))
    return out


def test_layouts_against_a_fold(spark):
    rng = random.Random(7)
    steps = []
    for _ in range(160):
        at = rng.sample(range(0, 40, 2), rng.randint(1, 3))
        steps.append({o: (rng.choice([f"field_{o:x}", f"m{o}", "other"]), rng.choice(["int", "int", "char"]), rng.choice([0, 2, 4])) for o in sorted(at)})
    rows = [(k, f"s{k % 20}", [{"offset": o, "name": n, "type": t, "size": z} for o, (n, t, z) in reversed(v.items())], 0, "medium", "", "") for k, v in enumerate(steps)]
    df = spark.createDataFrame(rows, "seq long, name string, fields array<struct<offset:bigint,name:string,type:string,size:bigint>>, size long, confidence string, evidence string, source_file string")
    got = {r["seq"]: (r["status"], [(f["offset"], (f["name"], f["type"], f["size"])) for f in r["fields"]]) for r in registry.merge_layouts(df).collect()}
    for name in range(20):
        own = range(name, 160, 20)
        assert [got[k] for k in own] == layout_oracle([steps[k] for k in own])


def test_coherence(spark):
    code = "int f(struct node *n, int x)\n{\n  struct item v;\n  struct node *m;\n  m = n;\n  m->next->bad = 1; // n->nope\n  v.size = n->gone + q->z;\n  return v.none;\n}"
    structs = [("node", [(0, "next", "struct node *", 4)], 0), ("item", [(0, "size", "int", 4)], 0), ("item", [(4, "more", "int", 4)], 1)]
    s = spark.createDataFrame(structs, "name string, fields array<struct<offset:bigint,name:string,type:string,size:bigint>>, rank int")
    r = validation.field_coherence(spark.createDataFrame([("1", code)], "address string, code string"), s).first()
    assert {(v["base"], v["field"], v["line"]) for v in r["violations"]} == {("m->next", "bad", 6), ("n", "gone", 7), ("v", "none", 8)}
    assert (r["unbound"], r["checked"]) == (1, 5)
    told = validation.coherence_summary(validation.field_coherence(spark.createDataFrame([("1", code), ("2", ""), ("3", None)], "address string, code string"), s))
    told = {x["address"]: x for x in told.collect()}
    assert told["1"]["summary"].startswith("FAIL 3: node.bad via m->next (L6)") and told["2"]["summary"] == told["3"]["summary"] == "ok: checked=0 unbound=0" and told["3"]["ok"]
    # chains through values and text: a member is no base of the next, a URL is no comment
    more = "void g(struct node *n, void (*f)(int, int), struct item *i)\n{\n  n->next->_pad1 = 1; n->_pad0 = 2;\n  a.b.c.d = 1;\n  i = n; i->next = 0;\n  w = (struct lost *)n; w->x = 1;\n}"
    r = validation.field_coherence(spark.createDataFrame([("1", more)], "address string, code string"), s).first()
    assert [(v["base"], v["field"], v["struct_name"]) for v in r["violations"]] == [("n->next", "_pad1", "node")] and (r["checked"], r["unbound"]) == (5, 3)
    # a proposal of one function holds for it alone
    own = spark.createDataFrame([("1", "node", [(8, "gone", "struct item *", 4)]), ("9", "item", [(9, "none", "int", 4)])], "address string, name string, fields array<struct<offset:bigint,name:string,type:string,size:bigint>>")
    two = validation.field_coherence(spark.createDataFrame([("1", code), ("2", code)], "address string, code string"), s, own)
    two = {x["address"]: [(v["base"], v["field"], v["struct_name"]) for v in x["violations"]] for x in two.collect()}
    assert two["1"] == [("m->next", "bad", "node"), ("v", "none", "item")] and len(two["2"]) == 3
    none = validation.field_coherence(spark.createDataFrame([("1", code)], "address string, code string"), s.limit(0)).first()
    assert (none["violations"], none["checked"], none["unbound"]) == ([], 0, 0)
    texts = spark.createDataFrame([("1", code, None, "raw"), ("2", code, "int x;", "raw"), ("3", "int y;", "s", "raw"), ("4", code, None, None)], "address string, named string, structured string, raw string")
    assert {x["address"]: x["chosen"] for x in validation.choose_export(texts, s).collect()} == {"1": "raw", "2": "structured", "3": "named", "4": "named"}


def test_headers_and_export(spark):
    sym = spark.createDataFrame(
        [("DAT_1", "LIMIT", "constant", "", "high", "4"), ("DAT_2", "LIMIT", "constant", "", "high", "5"), ("DAT_3", "g", "global_var", "", "high", ""), ("FUN_00000001", "run", "function", "", "high", "")],
        "symbol string, canonical_name string, kind string, inferred_type string, confidence string, value string",
    )
    assert [r["line"] for r in sinks.macro_lines(sym).collect()] == ["#define LIMIT 4"]
    assert [r["line"] for r in sinks.global_lines(sym).collect()] == ["extern uint32_t g;  /* type unknown */"]
    names = export.unique_names(spark.createDataFrame([("00000001", "run"), ("00000002", "run"), ("00000003", "x")], "address string, base string"))
    assert {r["name"] for r in names.collect()} == {"run_0x00000001", "run_0x00000002", "x"}
    mapping = export.export_map(sym, names)
    corpus_df = spark.createDataFrame([("1", "FUN_00000001(DAT_1, DAT_11);")], "address string, code string")
    r = registry.replace_symbols(corpus_df, "address", "code", mapping).first()
    assert (r["code"], r["hits"]) == ("run_0x00000001(LIMIT, DAT_11);", 2)
    s = spark.createDataFrame([("a", [(4, "x", "int", 4), (6, "y", "char[2]", 2)], 16)], "name string, fields array<struct<offset:bigint,name:string,type:string,size:bigint>>, size long")
    body = sinks.struct_bodies(s).first()["body"]
    assert body == (
        "struct a {\n    unsigned char _pad0[4];\n    int x;  /* +0x4 */\n    /* WARNING: field y at offset 0x6 overlaps the previous field (cursor 0x8); review manually */\n"
        "    char y[2];  /* +0x6 */\n    unsigned char _pad_end[8];\n};"
    )
    kinds = "name string, fields array<struct<offset:bigint,name:string,type:string,size:bigint>>, size long"
    s = spark.createDataFrame([("bare", [], 4), ("b", [(0, "x", "int", 0), (8, "in", "struct a", 0), (8, "z", "short", None)], 0), ("a", [(0, "n", "struct b *", 0)], 0), ("stat", [(0, "n", "int", 4)], 0)], kinds)
    text = sinks.types_header(s)
    assert "struct b {\n    int x;  /* +0x0 */\n    unsigned char _pad0[4];\n    struct a in;  /* +0x8 */\n    short z;  /* +0x8 */\n};" in text
    assert "struct bare {\n    unsigned char _pad_end[4];\n};" in text and text.index("struct a {") < text.index("struct b {") and "struct a;\nstruct b;\nstruct bare;" in text
    assert "struct stat {" not in text and "standard headers: stat" in text and text.startswith("#ifndef")
    assert [r["line"] for r in sinks.header("G_H", sinks.macro_lines(sym), ("a.h",)).collect()] == ["#ifndef G_H", "#define G_H", "", '#include "a.h"', "", "#define LIMIT 4", "", "#endif /* G_H */"]
    assert [r["line"] for r in sinks.symbol_lines(sym.where("kind = 'function'")).collect()] == ["FUN_00000001 -> run | kind: function | confidence: high | evidence: "]
    assert json.loads(sinks.symbol_json(sym).first()["entry"])["canonical_name"] == "LIMIT"
    assert "typedef unsigned int undefined4;" in sinks.stub_header()
    assert sinks.declaration_order(["c", "a", "b"], [("a", "b"), ("b", "c"), ("c", "a")]) == ["c", "b", "a"]


def test_stream(spark, tmp_path):
    from corploom.streaming import registry as live

    src = spark.createDataFrame([(1, "s", "a"), (2, "s", "b")], "seq int, sym string, name string")
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    live.run(stream(), str(tmp_path / "out"), str(tmp_path / "cp"), "sym", ["name"], ["seq"]).awaitTermination()
    spark.createDataFrame([(3, "s", "a"), (4, "t", "z")], src.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live.run(stream(), str(tmp_path / "out"), str(tmp_path / "cp"), "sym", ["name"], ["seq"]).awaitTermination()
    got = {r["seq"]: r["status"] for r in spark.read.parquet(str(tmp_path / "out/log")).collect()}
    assert got == {1: "inserted", 2: "conflict", 3: "updated", 4: "inserted"}
