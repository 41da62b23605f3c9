"""Whole runs: passes and repairs, settings, the service source, the command line."""

import json
import os

import pytest
from pyspark.sql import functions as F

from corploom import cli, settings
from corploom.operators import corpus, facts, graph, rebuild, registry, tools
from corploom.sources import raw_json, service

FUNCTIONS = [
    ("00000001", "leaf", "int leaf(int param_1)\n{\n  return *(int *)(param_1 + 4);\n}"),
    ("00000002", "mid", "int mid(int param_1)\n{\n  char buf[8];\n  return leaf(param_1) + FUN_00000009();\n}"),
    ("00000003", "top", "int top(int param_1)\n{\n  return mid(param_1);\n}"),
]


def functions(spark, rows=FUNCTIONS):
    return spark.createDataFrame(rows, "address string, ghidra_name string, code string")


def replies(spark, told):
    """A pass that answers from a table, and remembers what it was asked."""
    asked = []

    def ask(rows):
        got = rows.collect()
        asked.append({r["address"]: r.asDict() for r in got})
        return spark.createDataFrame([(r["address"], told(r)) for r in got], "address string, reply string")

    return ask, asked


def structured(code, *updates):
    return f"<structured>{code}</structured><struct_updates>{json.dumps(list(updates))}</struct_updates>"


NODE = {"name": "node", "size": 8, "fields": [{"offset": 4, "name": "value", "type": "int", "size": 4}]}


def test_repair_flow(spark):
    # three leaves with an unknown field each: the repair of one holds, of one does not, of one is empty
    leaf = "int {0}(int param_1)\n{{\n  return *(int *)(param_1 + 4);\n}}"
    rows = [(f"0000000{k}", n, leaf.format(n)) for k, n in enumerate(("one", "two", "three"), 1)]
    good = {a: f"int {n}(struct node *param_1)\n{{\n  return param_1->value;\n}}" for a, n, _ in rows}
    bad = {a: c.replace("value", "wrong") for a, c in good.items()}
    ask, _ = replies(spark, lambda r: structured(bad[r["address"]], NODE))
    repair, seen = replies(spark, lambda r: {"1": f"<structured>{good[r['address']]}</structured>", "2": structured(bad[r["address"]])}.get(r["address"][-1], "<skip>no</skip>"))
    out, state = rebuild.run(functions(spark, rows), ask, repair)
    got = {r["address"][-1]: r for r in out.collect()}
    assert [got[k]["structured"] for k in "123"] == [good["00000001"], rows[1][2], rows[2][2]] and {r["status"] for r in got.values()} == {"produced"}
    assert got["1"]["reason"] == "" and got["2"]["reason"].startswith("reverted: ") and got["3"]["reason"] == "reverted: empty repair"
    assert len(seen) == 1 and len(seen[0]) == 3 and "no field `wrong`" in seen[0]["00000001"]["report"]
    assert [r["name"] for r in state.structs.collect()] == ["node"]


def test_layers_names_and_retries(spark):
    calls = {}

    def structure(r):
        calls[r["address"]] = calls.get(r["address"], 0) + 1
        if r["address"] == "00000002" and calls[r["address"]] == 1:
            return None  # fails once
        if r["address"] == "00000003":
            return "<skip>lazy</skip>"  # fails always
        return structured(r["code"].replace("char buf[8];", "char *buf;") if r["address"] == "00000009" else r["code"])

    def name(r):
        update = [{"symbol": "FUN_00000009", "canonical_name": "nine", "kind": "function", "confidence": "high"}] if r["unknown_symbols"] else []
        return f"<naming_map>param_1 -> count | n\nmissing -> x</naming_map><registry_updates>{json.dumps(update)}</registry_updates>"

    ask, asked = replies(spark, structure)
    naming, told = replies(spark, name)
    rows = functions(spark, [*FUNCTIONS, ("00000004", "after", "int after(int a)\n{\n  return top(a);\n}")])
    out, state = rebuild.run(rows, ask, None, naming, retries=1)
    got = {r["address"][-1]: r for r in out.collect()}
    assert {k: r["status"] for k, r in got.items()} == {"1": "produced", "2": "produced", "3": "failed", "4": "not run"}
    assert got["3"]["reason"] == "skipped: lazy" and calls["00000003"] == 2 and calls["00000002"] == 2
    assert "int leaf(int count)" in got["1"]["named"] and got["1"]["naming_map"] == "param_1 -> count | n\n# skipped: missing -> x"
    assert [set(a) for a in asked][:3] == [{"00000001"}, {"00000002"}, {"00000002"}]
    assert [(r["symbol"], r["canonical_name"]) for r in state.symbols.collect()] == [("FUN_00000009", "nine")]


def test_conflicting_layouts_are_logged(spark):
    other = {"name": "node", "fields": [{"offset": 4, "name": "value", "type": "char", "size": 1}]}
    ask, _ = replies(spark, lambda r: structured(r["code"], NODE if r["address"] == "00000001" else other))
    out, state = rebuild.run(functions(spark, FUNCTIONS[:2]), ask)
    lost = state.conflicts.collect()
    assert [(r["category"], r["name"]) for r in lost] == [("struct", "node")] and json.loads(lost[0]["existing"])["fields"][0]["type"] == "int" and json.loads(lost[0]["incoming"])["fields"][0]["type"] == "char"
    assert out.where("structured = raw").count() == 2
    plain, _ = rebuild.run(functions(spark))
    assert plain.where("raw = structured and raw = named").count() == 3


def test_registry_access(spark):
    entries = spark.createDataFrame([("b", "x", "function"), ("a", "y", "constant"), ("c", "z", "function")], "symbol string, canonical_name string, kind string")
    assert [r["symbol"] for r in registry.scan(entries, "symbol", "function").collect()] == ["b", "c"] and [r["symbol"] for r in registry.scan(entries, "symbol").collect()] == ["a", "b", "c"]
    keys = spark.createDataFrame([("a",), ("q",)], "symbol string")
    assert {r["symbol"]: r["canonical_name"] for r in registry.lookup(entries, keys, "symbol").collect()} == {"a": "y", "q": None}
    assert {r["symbol"] for r in registry.delete(entries, keys, "symbol").collect()} == {"b", "c"}
    text = functions(spark, [("1", "f", "FUN_1a(DAT_2); FUN_1a; notFUN_3")])
    got = registry.placeholder_split(text, spark.createDataFrame([("DAT_2", "d")], "symbol string, canonical_name string")).collect()
    assert sorted((r["place"], r["symbol"], r["known"], r["canonical_name"]) for r in got) == [(0, "FUN_1a", False, None), (1, "DAT_2", True, "d")]
    names = [(" FUN_1 ", "run", None, "high"), ("FUN_2", "FUN_00ab", "function", "high"), ("FUN_3", "ok", "function", "low"), ("", "x", "function", "high"), ("FUN_4", "y", "odd", "high")]
    taken = registry.accepted_names(spark.createDataFrame(names, "symbol string, canonical_name string, kind string, confidence string"))
    assert [(r["symbol"], r["kind"]) for r in taken.collect()] == [("FUN_1", "function")]
    many = registry.replace_symbols(text, "address", "code", spark.createDataFrame([("FUN_1a", "run"), ("DAT_2", "FUN_1a"), ("never", "x")], "old string, new string"), sent_pairs=1).first()
    assert (many["code"], many["hits"]) == ("run(FUN_1a); run; notFUN_3", 3)


def test_overlap_report(spark):
    rows = [("00000010", "a", "b();"), ("00000018", "b", "x"), ("00000040", "c", "same FUN_1 0x10"), ("00000044", "d", "same FUN_2 0x20"), ("00000048", "e", "same FUN_3 0x30"), ("00000100", "f", "")]
    got = {r["dropped"]: r for r in corpus.overlap_report(functions(spark, rows)).collect()}
    assert {k: (r["kept"], r["gap"], r["kept_name"], r["dropped_name"], r["kept_callers"], r["dropped_callers"], r["reason"]) for k, r in got.items()} == {
        "00000010": ("00000018", 8, "b", "a", 1, 0, "callsite"), "00000044": ("00000040", 4, "c", "d", 0, 0, "fingerprint"),
    }
    assert corpus.without_overlaps(functions(spark, rows)).count() == 4
    kept, counts = corpus.select_functions(functions(spark, [("1", "_start", ""), ("2", "main", "")]))
    assert kept.count() == 1 and counts.first().asDict() == {"raw": 2, "runtime": 1}
    around = functions(spark, [("1", "f", "\n".join(f"line {k}" for k in range(1, 21)))]).select(corpus.text_around(F.col("code"), F.lit(2), 2, 1), corpus.text_around(F.col("code"), F.lit(99), 1, 1), corpus.text_around(F.col("code"), F.lit(10), 5, 5, 30)).first()
    assert around[:] == ("L1: line 1\nL2: line 2\nL3: line 3", "L19: line 19\nL20: line 20", "L5: line 5\nL6: line 6\nL7: line\n...(context window truncated)")


def test_noise_reports(spark):
    rows = [(f"0x{k}_f", "goto x; FUN_1 " * k) for k in range(12)]
    counts = corpus.noise_counts(spark.createDataFrame(rows, "f string, code string"), "f", "code")
    files = {r["kind"]: (r["count"], r["files"]) for r in corpus.noise_files(counts, "f", ["goto", "FUN_", "LAB_"]).collect()}
    assert files["goto"] == (66, [f"0x{k}_f ({k})" for k in (10, 11, 1, 2, 3, 4, 5, 6)]) and set(files) == {"goto", "FUN_"}
    assert corpus.noise_summary(counts).first().asDict() == {"files_scanned": 12, "files_with_noise": 11, "total_score": 66 * 8}
    assert [r["line"] for r in corpus.hotspot_lines(counts, "f", ["goto", "LAB_"], 2).collect()] == ["- 0x11  score=88  0x11_f  (goto=11)", "- 0x10  score=80  0x10_f  (goto=10)"]
    got = corpus.regression_metrics(spark.createDataFrame([("1", "goto LAB_a; uVar1 uVar2 tmp_q *(int *)((int)p)")], "f string, code string"), "f", "code").collect()
    assert (got[0]["pattern"], got[0]["n"]) == ("iVar/uVar", 2) and {r["pattern"]: r["n"] for r in got}["bare ptr cast"] == 1 and len(got) == 10


def test_settings(tmp_path):
    chosen = settings.settings_of({"TOGGLES": {"skip_naming": 1, "reconstruction_workers": "3", "odd": 1}, "THINKING": {"type": "Enabled", "reasoning_effort": "max"}, "MODEL": "m"}, ("MODEL",))
    assert chosen.toggles.skip_naming is True and chosen.toggles.reconstruction_workers == 3 and chosen.toggles.active == ["skip_naming", "reconstruction_workers"]
    assert (chosen.thinking_type, chosen.reasoning_effort, chosen.timeout_seconds, chosen.language, chosen.get("MODEL")) == ("enabled", "max", 600.0, "en", "m")
    for data, need in (({}, ("MODEL",)), ({"THINKING": "maybe"}, ()), ({"THINKING": {"type": "enabled", "reasoning_effort": "huge"}}, ())):
        with pytest.raises(ValueError):
            settings.settings_of(data, need)
    with pytest.raises(FileNotFoundError):
        settings.load(str(tmp_path / "none.yaml"))
    context = {"domain": "d", "layouts": {"pkt": {"size": 8, "fields": [{"offset": 4, "name": "len", "type": "int"}]}}, "distortions": [{"id": "a", "pattern": " p "}, {"id": "b", "layer": "naming", "fix": "f"}]}
    text = settings.context_text(context, "structure")
    assert "### pkt (struct pkt, size 8)\n+0x4 len int" in text and "pattern: p" in text and "### b" not in text
    assert "### b\nfix: f" in settings.context_text(context, "naming") and settings.load_context(str(tmp_path), "x", "naming") == ""
    assert settings.fill("a {{ x }} {{y}}", x=1, y="z") == "a 1 z" and settings.safe_name(" a b/c ") == "a_b_c" and settings.safe_name("..") == "binary"
    assert settings.find_package(str(tmp_path)) == str(tmp_path) and settings.package_folder("/x/fw.bin") == "output/fw.bin"
    with pytest.raises(FileNotFoundError):
        settings.find_package(str(tmp_path / "gone"), str(tmp_path))
    with pytest.raises(ValueError, match="b"):
        settings.require("tool", a="1", b="")


class Client:
    """A service of 1200 functions that fails by kinds; it keeps count of its calls in a folder, and dies where a file there says so."""

    def __init__(self, options):
        self.looks, self.folder, self.calls = 0, options["folder"], {}

    def ready(self):
        self.looks += 1
        return self.looks > 1

    def count(self):
        return 1200

    def list(self, offset, limit):
        if os.path.exists(f"{self.folder}/dies{offset}"):
            raise RuntimeError("died")
        rows = [{"address": f"0x{k:x}", "name": f"f{k}", "is_thunk": k == 7, "is_external": k == 8} for k in range(offset, min(1200, offset + limit))]
        return rows + [{"address": "0x11", "name": "a_second_name"}] * (offset == 500)

    def decompile(self, address):
        with open(f"{self.folder}/calls", "a") as f:
            f.write(address + "\n")
        n = self.calls[address] = self.calls.get(address, 0) + 1
        if address == "0x9" or (address == "0x12" and n < 3):
            raise OSError("gone")
        if address == "0x13":
            return service.answer("sorry", refused=True)
        if address == "0x14":
            return service.answer(" " if n == 1 else "{no json")
        if address == "0x11" and n == 1 and not os.path.exists(f"{self.folder}/well"):
            open(f"{self.folder}/well", "w").close()
            raise ValueError("once")
        return ("" if address == "0xa" else f"int f;\r\n\n\n// {address}"), "p"


def test_service(spark, tmp_path, monkeypatch):
    code = "import importlib.util, sys\nsys.path.insert(0, %r)\nspec = importlib.util.spec_from_file_location('_run', %r)\nm = importlib.util.module_from_spec(spec)\nspec.loader.exec_module(m)\nmake = m.Client\n" % (os.path.dirname(os.path.abspath(__file__)), os.path.abspath(__file__))
    (tmp_path / "fake_service.py").write_text(code)
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "fake_service.py"))
    folder = tmp_path / "service"
    folder.mkdir()
    options = {"poll": "0", "backoff": "0.001", "folder": str(folder)}
    calls = lambda: (folder / "calls").read_text().split()
    (folder / "dies1000").write_text("")
    with pytest.raises(Exception, match="died"):
        service.fetch(spark, "fake_service:make", str(tmp_path / "out"), pages=1, **options)
    before = len(calls())
    (folder / "dies1000").unlink()
    good, failed = service.fetch(spark, "fake_service:make", str(tmp_path / "out"), pages=1, **options)
    lost = {r["address"][-2:]: (r["kind"], r["error"], r["tries"]) for r in failed.collect()}
    assert lost == {"09": ("unreachable", "OSError: gone", 4), "13": ("refused", "Refused: sorry", 1), "14": ("malformed", lost["14"][1], 4), "0a": ("empty", "no text", 1)}
    assert good.count() == 1200 - 2 - 4 and good.where("address = '00000001'").first()["code"] == "int f;\n// 0x1"
    assert good.where("address = '00000011'").first()["ghidra_name"] == "a_second_name"  # it failed under its first name; a success counts before a failure
    assert len(calls()) - before == 200 and len(set(calls())) == 1198  # the second run asked for the last page only
    again, _ = service.fetch(spark, "fake_service:make", str(tmp_path / "out"), pages=1, **options)
    assert again.count() == good.count() and len(calls()) - before == 200
    assert service.kind_of(TimeoutError()) == "unreachable" and service.kind_of(KeyError()) == "failed" and service.answer('{"a": 1}') == {"a": 1}


def test_explorer(spark):
    structs = spark.createDataFrame([("node", [(4, "value", "int", 4)], 8)], "name string, fields array<struct<offset:bigint,name:string,type:string,size:bigint>>, size bigint")
    symbols = spark.createDataFrame([("FUN_00000009", "nine", "function")], "symbol string, canonical_name string, kind string")
    x = tools.Explorer(functions(spark, [*FUNCTIONS, ("00000004", "odd", "void odd(struct node *p)\n{\n  p->gone = (1;\n}")]), symbols, structs)
    assert [r["line"] for r in x.browse_functions("placeholders").collect()] == ["0x00000002 | mid | int | (int param_1) | callers:1 callees:1 | ph:1"]
    assert [r["caller_name"] for r in x.get_callers("0x1").collect()] == ["mid"] and [r["name"] for r in x.get_callees("top").collect()] == ["mid"]
    assert [(r["caller"][-1], r["line_no"]) for r in x.get_call_sites("leaf").collect()] == [("2", 4)] and "callers: mid(0x00000002)" in x.get_function_info("1").first()["text"]
    assert [(r["address"][-1], r["line_no"]) for r in x.search_code("BUF").collect()] == [("2", 3)] and x.read_function("0x00003").count() == 1
    assert [r["line"] for r in x.get_structs().collect()] == ["struct node (size 0x8): +0x4 value int"] and x.get_registry("function").count() == 1
    assert x.check_field_coherence("odd").first()["summary"] == "FAIL 1: node.gone via p (L3)"
    assert [r["address"][-1] for r in tools.bracket_suspects(x.functions).collect()] == ["4"]
    assert all(hasattr(x, t) for t in tools.READ) and not set(tools.EDIT) & set(tools.ROLES["syntax"])
    assert tools.by_key(x.functions, spark.createDataFrame([("0x2",), ("00003",)], "address string")).count() == 2
    steps = graph.argument_steps(functions(spark, [("1", "f", "void f(char *a)\n{\n  copy(b, &a);\n  run((int)b);\n}")]))
    assert {(r["src"], r["dst"]) for r in steps.collect()} == {("1/a", "1/b"), ("1/b", "1/a")}
    start = graph.parameter_sources(functions(spark), ["leaf"])
    assert [r["node"] for r in start.collect()] == ["00000001/param_1"]


def test_completions(spark):
    def make():
        seen = {}

        def ask(prompt):
            seen[prompt] = seen.get(prompt, 0) + 1
            if prompt == "never" or (prompt == "third" and seen[prompt] < 3):
                raise OSError("busy")
            return " " if prompt == "blank" else '```json\n{"summary": "s", "security_relevance": {"level": "high"}, "confidence": 0x1f}\n```'

        return ask

    rows = spark.createDataFrame([("1", "plain"), ("2", "third"), ("3", "never"), ("4", "blank")], "address string, prompt string").coalesce(1)
    got = {r["address"]: r for r in tools.completions(rows, make, tries=3, wait=0.0).collect()}
    assert [(got[k]["tries"], got[k]["error"]) for k in "1234"] == [(1, None), (3, None), (3, "OSError: busy"), (3, "blank answer")]
    told = {r["address"]: r for r in tools.summaries(tools.completions(rows, make, tries=3, wait=0.0)).collect()}
    assert (told["2"]["summary"], told["2"]["security_relevance"]["level"], told["2"]["confidence"], told["3"]["summary"]) == ("s", "high", "0x1f", None)


def test_fact_tables(spark, tmp_path):
    """A package's facts, written and asked in SQL; whole runs of the command line are in test_files."""
    raw = tmp_path / "raw"
    raw.mkdir()
    out = str(tmp_path / "out")
    for a, n, c in [("00002000", "_start", "x"), *[(f"{k:08x}", n, c) for k, (_, n, c) in zip((16, 256, 4096), FUNCTIONS)]]:
        (raw / f"{a}.json").write_text(json.dumps({"address": a, "ghidra_name": n, "code": c}))
    kept, counts = corpus.select_functions(raw_json.read_package(spark, str(raw)))
    assert kept.count() == 3 and counts.first().asDict() == {"raw": 4, "runtime": 1}
    facts.write(kept, f"{out}/facts", "raw")
    facts.register(spark, f"{out}/facts", "raw")
    asked = spark.sql("SELECT e.caller, s.line_no, s.arg_text FROM call_edges e JOIN call_sites s ON s.caller = e.caller JOIN definitions d ON d.address = e.callee AND d.name = s.callee_name WHERE e.kind = 'catalog'")
    assert {tuple(r) for r in asked.collect()} == {("00000100", 4, "param_1"), ("00001000", 3, "param_1")}
    assert spark.sql("SELECT symbol, n FROM placeholders").first()[:] == ("FUN_00000009", 1) and spark.sql("SELECT offsets FROM objects").first()[0] == [4]
    assert spark.sql("SELECT count(*) FROM flow_edges WHERE kind = 'call'").first()[0] == 2 and spark.sql("SELECT count(*) FROM lines").first()[0] == 4 + 5 + 4
    back = raw_json.read_package(spark, "none", str(raw))
    raw_json.write_functions(back, str(tmp_path / "lines"))
    assert sorted(raw_json.read_lines(spark, str(tmp_path / "lines")).collect()) == sorted(back.collect())
    with pytest.raises(SystemExit):
        cli.arguments(["one"])
