"""The file sink, the headers, a whole run's files, the command line's switches, catalog sections."""

import json
import os
import re
import sys
import types

import pytest
from pyspark.sql import functions as F
from test_run import FUNCTIONS, structured

from corploom import cli
from corploom.operators import corpus, sections
from corploom.sources import files, sinks


def tree(folder):
    out = {}
    for top, _, names in os.walk(folder):
        for n in names:
            at = os.path.join(top, n)
            with open(at, encoding="utf-8", newline="") as f:
                out[os.path.relpath(at, folder)] = f.read()
    return {k: v for k, v in out.items() if not k.endswith(".crc")}


def test_files(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = [(f"d{k % 3}/f{k}.c", f"text {k}\né 東") for k in range(40)] + [("empty.txt", ""), ("none.txt", None)]
    df = spark.createDataFrame(rows, "path string, content string")
    files.save(df.repartition(5), folder)
    assert tree(folder) == {p: c or "" for p, c in rows}
    back = files.read(spark, folder, "*.c").collect()
    assert {(r["path"], r["content"]) for r in back} == {r for r in rows if r[0].endswith(".c")}
    files.save(df.limit(0).unionByName(spark.createDataFrame([("new", "x")], df.schema)), f"file://{folder}")  # a second run replaces
    assert tree(folder) == {"new": "x"}
    files.save(spark.createDataFrame([("more", "y")], df.schema), folder, mode="append")
    assert tree(folder) == {"new": "x", "more": "y"}
    parts = spark.createDataFrame([("a", k, f"{k};") for k in (3, 1, 2)] + [("b", 9, "z")], "path string, n int, content string")
    files.save(parts.repartition(3), folder, ["n"])
    assert tree(folder) == {"a": "1;2;3;", "b": "z"}
    files.save(df.limit(0), folder)
    assert tree(folder) == {}


@pytest.mark.parametrize("bad", [[("x", "1"), ("x", "2")], [("../x", "1")], [("/abs", "1")], [("a//b", "1")], [(None, "1")]])
def test_files_refused(spark, tmp_path, bad):
    folder = str(tmp_path / "out")
    schema = "path string, content string"
    files.save(spark.createDataFrame([("kept", "k")], schema), folder)
    with pytest.raises(Exception):
        files.save(spark.createDataFrame([("fine", "f"), *bad], schema), folder)
    assert tree(folder) == {"kept": "k"} and os.listdir(folder) == ["kept"]  # nothing staged is left either


def test_failed_task_leaves_none(spark, tmp_path):
    folder = str(tmp_path / "out")
    df = spark.range(0, 60, 1, 6).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"), F.when(F.col("id") == 57, F.raise_error(F.lit("late"))).otherwise("t").alias("content"))
    with pytest.raises(Exception, match="late"):
        files.save(df, folder)
    assert not os.path.isdir(folder) or os.listdir(folder) == []


class Cast:
    """(uintN_t) as an operator that binds like it."""

    def __init__(self, size):
        self.mask = (1 << size) - 1

    def __matmul__(self, x):
        return int(x) & self.mask


def called(name, *values):
    """What a helper macro comes to, its casts and suffixes read as Python's."""
    head, params, body = next(re.fullmatch(r"#define (\w+)\(([^)]*)\) (.*)", m).groups() for m in sinks.helper_macros() if m.startswith(f"#define {name}("))
    told = re.sub(r"\(uint(\d+)_t\)", r"u\1 @ ", re.sub(r"(0x[0-9a-f]+)u", r"\1", body))
    return int(eval(told, {f"u{n}": Cast(n) for n in (8, 16, 32, 64)}, dict(zip(params.split(", "), values))))


def test_helper_macros():
    """The macros against arithmetic."""
    signed = lambda v, n: v - (1 << 8 * n) if v >> (8 * n - 1) else v
    for a in range(1, 8):
        for b in range(1, 9 - a):
            for hi, lo in ((0, 0), (0xFFFFFFFFFFFFFFFF, 1), (0x1122334455667788, 0x99AABBCCDDEEFF00)):
                assert called(f"CONCAT{a}{b}", hi, lo) == (hi & ((1 << 8 * a) - 1)) << 8 * b | lo & ((1 << 8 * b) - 1)
    for a in range(2, 9):
        for b in range(1, a):
            for n in range(a):
                assert called(f"SUB{a}{b}", 0x1122334455667788, n) == ((0x1122334455667788 & ((1 << 8 * a) - 1)) >> 8 * n) & ((1 << 8 * b) - 1)
    for n in (1, 2, 4, 8):
        low, high = -(1 << 8 * n - 1), (1 << 8 * n - 1) - 1
        edges = (0, 1, 2, high - 1, high, high + 1, (1 << 8 * n) - 2, (1 << 8 * n) - 1)
        for x in edges:
            for y in edges:
                assert called(f"CARRY{n}", x, y) == (x + y >= 1 << 8 * n)
                assert called(f"SCARRY{n}", x, y) == (not low <= signed(x, n) + signed(y, n) <= high)
                assert called(f"SBORROW{n}", x, y) == (not low <= signed(x, n) - signed(y, n) <= high)
    text = sinks.stub_header()
    assert text.count("#include <") == 25 and "typedef struct { ulonglong lo; ulonglong hi; } _OWORD;" in text and "int open64(const char *pathname, int flags, ...);" in text


def package(tmp_path, rows=FUNCTIONS):
    raw = tmp_path / "raw"
    raw.mkdir()
    for k, (_, n, c) in enumerate(rows):
        (raw / f"{k}.json").write_text(json.dumps({"address": f"{16 ** (k + 1):08x}", "ghidra_name": n, "code": c, "pcode": "u1 = LOAD x\nnothing"}))
    return str(raw)


class Passes(types.ModuleType):
    """A module of passes that answers as a test says, and remembers what it was asked."""

    def __init__(self, spark, tmp_path, **told):
        super().__init__("told_passes")
        self.seen = {}
        for layer, reply in told.items():
            setattr(self, layer, self._pass(spark, layer, reply) if layer in ("structure", "repair", "name") else reply)
        sys.modules["told_passes"] = self

    def _pass(self, spark, layer, reply):
        def ask(rows):
            self.seen.setdefault("workers", set()).add(rows.rdd.getNumPartitions())
            got = rows.collect()
            self.seen.setdefault(layer, []).extend(r.asDict() for r in got)
            return spark.createDataFrame([(r["address"], reply(r)) for r in got], "address string, reply string")

        return ask


def settings(tmp_path, monkeypatch, **values):
    from corploom import settings as st

    path = tmp_path / "settings.yaml"
    path.write_text("")
    contexts = tmp_path / "contexts"
    contexts.mkdir(exist_ok=True)
    (contexts / "net.yaml").write_text("")
    told = {str(path): values, str(contexts / "net.yaml"): {"domain": "packets", "distortions": [{"id": "w", "layer": "naming", "fix": "call it so"}]}}
    monkeypatch.setattr(st, "_yaml", lambda p: told[p])
    return ["--settings", str(path), "--contexts", str(contexts)]


UPDATES = [{"symbol": "FUN_00000009", "canonical_name": "nine", "kind": "function", "confidence": "high"}, {"symbol": "DAT_1", "canonical_name": "LIMIT", "kind": "constant", "value": "4", "confidence": "high"}]
NODE = {"name": "node", "size": 8, "fields": [{"offset": 4, "name": "value", "type": "int", "size": 4}]}
NAMED = lambda r: f"<naming_map></naming_map><registry_updates>{json.dumps(UPDATES)}</registry_updates>"


def test_a_run_leaves_files(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    built = []
    passes = Passes(
        spark, tmp_path, configure=lambda s: built.append(s.timeout_seconds), structure=lambda r: structured(r["code"], NODE), name=NAMED, database=lambda o: built.append(o) or True,
        prescan=lambda x: spark.createDataFrame([("meta", '{"a": 1}'), ("noise_report", '{"by_type": "mine"}')], "section string, content string"),
        review=lambda x, role, catalog: x.functions.where("ghidra_name = 'mid'").select("address", F.replace("code", F.lit("return leaf"), F.lit("return  leaf")).alias("code")),
        summary=lambda: lambda prompt: json.dumps({"summary": "s", "security_relevance": {"level": "high", "reason": "r"}, "api_calls": ["system(x)"]}),
    )
    toggles = {"disable_domain_context": False, "reconstruction_workers": 3, "enable_prescan": True, "enable_multi_agent": True}
    args = settings(tmp_path, monkeypatch, TOGGLES=toggles, CONTEXT="net", OUTPUT_LANGUAGE="zh", TIMEOUT_SECONDS=7)
    assert cli.main([package(tmp_path, FUNCTIONS[:2]), out, "--passes", "told_passes", *args], spark) == cli.DONE
    got = tree(f"{out}/reconstruction")
    for a, (_, n, c) in zip(("00000010", "00000100"), FUNCTIONS):
        assert got[f"functions/0x{a}/raw.c"] == c + "\n" and f"int {n}(" in got[f"functions/0x{a}/named.c"] and got[f"functions/0x{a}/pcode.txt"] == "u1 = LOAD x\nnothing\n"
    assert "functions/0x00000010/access_evidence.txt" in got and "functions/0x00000010/naming_map.txt" not in got and "skipped.txt" not in got
    entries = json.loads(got["registry/symbol_registry.json"])
    assert {k: e["canonical_name"] for k, e in entries.items()} == {"DAT_1": "LIMIT", "FUN_00000009": "nine"} and got["registry/symbol_registry.txt"].splitlines()[0].startswith("DAT_1 -> LIMIT | kind: constant")
    assert [(o["address"], o["base"], o["offsets"]) for o in json.loads(got["access_evidence.json"])["objects"]] == [("00000010", "param_1", ["0x4"])]
    told = json.loads(got["completeness_manifest.json"])
    assert (told["selected"], told["produced"], told["full_success"], told["failed_functions"], told["skipped_functions"]) == (2, 2, True, [], [])
    src = tree(f"{out}/codeql/src")
    assert set(src) == {"0x00000010_leaf.c", "0x00000100_mid.c", "stubs.h", "types.h", "macros.h", "globals.h", "decls.h"}
    assert src["0x00000100_mid.c"].startswith(cli.PROLOGUE) and "nine()" in src["0x00000100_mid.c"] and got["registry/unresolved_symbols.txt"] == "(none)\n"
    assert "return  leaf" in src["0x00000100_mid.c"]  # the review's text
    assert "#define LIMIT 4\n" in src["macros.h"] and "int mid(int param_1);\n" in src["decls.h"] and "struct node {\n    unsigned char _pad0[4];\n    int value;  /* +0x4 */\n};" in src["types.h"]
    assert src["types.h"].startswith("#ifndef") and src["types.h"].endswith("#endif /* CORPLOOM_TYPES_H */\n") and src["stubs.h"] == sinks.stub_header()
    reports = tree(f"{out}/reports")
    assert reports["report.md"].count("- level: high") == 2 and json.loads(reports["summaries/0x00000010.json"])["risk_apis"] == ["system(x)"]
    asked = passes.seen["structure"][0]
    assert (asked["context"], asked["pcode"]) == ("## Domain\npackets", "u1 = LOAD x") and "Chinese" in asked["language"] and asked["bundle"].startswith("object param_1")
    assert passes.seen["name"][0]["context"].endswith("## Distortions\n### w\nfix: call it so") and passes.seen["workers"] == {3} and built == [7.0, out]
    changes = spark.read.parquet(f"{out}/changes").collect()
    assert {r["agent"] for r in changes} <= {"naming", "types", "dispatch"} and changes  # roles that may edit
    known = {r["section"]: json.loads(r["content"]) for r in spark.read.parquet(f"{out}/sections").collect()}
    assert known["meta"] == {"a": 1} and known["noise_report"]["by_type"] == "mine" and known["noise_report"]["rule_scan"]["files_scanned"] == 2


def test_switches(spark, tmp_path, monkeypatch):
    (tmp_path / "two").mkdir()
    raw, two, out = package(tmp_path, FUNCTIONS[:1]), package(tmp_path / "two", FUNCTIONS[:2]), str(tmp_path / "out")
    quiet = {"skip_agent_review": True, "disable_pcode": True, "disable_access_evidence": True, "skip_structure": True}
    passes = Passes(spark, tmp_path, structure=lambda r: 1 / 0, name=NAMED, review=lambda *a: 1 / 0, prescan=lambda *a: 1 / 0, database=lambda o: False)
    args = settings(tmp_path, monkeypatch, TOGGLES=quiet, CONTEXT="net")
    assert cli.main([raw, out, "--passes", "told_passes", "--reconstruction-workers", "2", *args], spark) == cli.NO_DATABASE
    asked = passes.seen["name"][0]
    assert (asked["context"], asked["pcode"], passes.seen["workers"]) == ("", "", {2}) and "bundle" not in asked and "structure" not in passes.seen
    assert "access_evidence.json" not in tree(f"{out}/reconstruction") and not json.loads(tree(f"{out}/reconstruction")["completeness_manifest.json"])["full_success"]
    passes = Passes(spark, tmp_path, structure=lambda r: structured(r["code"]) if "leaf" not in r["code"] else "<skip>x</skip>", name=lambda r: 1 / 0)
    args = settings(tmp_path, monkeypatch, TOGGLES={"skip_naming": True})
    assert cli.main([two, out, "--passes", "told_passes", *args], spark) == cli.PARTIAL
    got = tree(f"{out}/reconstruction")
    told = json.loads(got["completeness_manifest.json"])
    assert not os.path.isdir(f"{out}/codeql") and told["failed_functions"][0]["address"] == "00000010" and told["not_run"] == 1 and got["skipped.txt"].startswith("0x00000010 | leaf | skipped: x")
    assert cli.main([raw, out, "--reconstruction-workers", "0"], spark) == cli.REFUSED and cli.main([raw, out, "--settings", str(tmp_path / "gone")], spark) == cli.REFUSED
    skipped = cli.chosen_settings(cli.arguments([raw, out, "--skip-database", *args]))
    assert skipped.toggles.skip_database and skipped.toggles.active == ["skip_naming", "skip_database"]


def test_sections(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "section string, content string")
    counts = corpus.noise_counts(spark.createDataFrame([(f"f{k}", "goto x; " * k) for k in range(12)], "f string, code string"), "f", "code")
    scanned = sections.scan(counts, "f")
    got = {r["section"]: json.loads(r["content"]) for r in sections.with_scan(rows(("meta", "2"), ("noise_report", '{"recommendation": "r", "rule_scan": 1, "mine": [1]}')), scanned).collect()}
    noise = got["noise_report"]
    assert got["meta"] == 2 and (noise["recommendation"], noise["mine"]) == ("r", [1]) and noise["rule_scan"]["files_with_noise"] == 11 and noise["by_type"]["goto"]["count"] == 66
    assert [x["file"] for x in noise["priority_files"]][:2] == ["f11", "f10"] and len(noise["priority_files"]) == 10
    for odd in ("[1]", "no json", '"text"'):
        assert json.loads(sections.with_scan(rows(("noise_report", odd)), scanned).first()["content"])["rule_scan"]["files_scanned"] == 12
    summary = sections.with_scan(rows(("a", "1")), scanned)
    assert [(r["file"], r["score"]) for r in sections.priority_files(summary, 2).collect()] == [("f11", 33), ("f10", 30)]
    nested = rows(("noise_report", '{"priority_files": [], "rule_scan": {"priority_files": [{"file": "x"}, 3, {"file": "y", "score": "7"}]}}'))
    assert [(r["file"], r["score"]) for r in sections.priority_files(nested).collect()] == [("x", None), ("y", 7)] and sections.priority_files(rows(("noise_report", "{}"))).count() == 0
    held = rows(("placeholder_inventory", '{"by_priority": [{"symbol": "s", "confidence": "HIGH"}, {"confidence": "low"}, 3]}'))
    assert [r["symbol"] for r in sections.sure_placeholders(held).collect()] == ["s"]
    many = spark.createDataFrame([(1, "a", "1", 5), (1, "a", "2", 9), (1, "b", "3", 1), (2, "a", None, 2)], "g int, section string, content string, n int")
    assert {(r["g"], r["section"], r["content"]) for r in sections.merged(many, ["g"], "n").collect()} == {(1, "a", "2"), (1, "b", "3"), (2, "a", None)}
