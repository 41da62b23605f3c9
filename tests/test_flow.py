"""Matched calls against a pushdown search, witnesses against breadth-first search, and flows of C-like text."""

import random
from collections import deque

from corploom.operators import flow, graph
from corploom.storage import Scratch

SCHEMA = "src string, dst string, kind string, site string"


def pushdown(edges, sources, sinks, depth=9):
    """Sources that reach a sink over stacks of open calls up to a depth; a return without an open call may leave by any site."""
    out = {}
    for s in sources:
        seen, todo = {(s, ())}, deque([(s, ())])
        while todo:
            v, stack = todo.popleft()
            if v in sinks:
                out.setdefault(s, set()).add(v)
            for a, b, kind, site in edges:
                if a != v:
                    continue
                if kind == "call":
                    state = (b, (*stack, site))
                elif kind == "return":
                    if stack and stack[-1] != site:
                        continue
                    state = (b, stack[:-1])
                else:
                    state = (b, stack)
                if len(state[1]) <= depth and state not in seen:
                    seen.add(state)
                    todo.append(state)
    return out


def nodes(spark, names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def test_plain_reachability_is_wrong(spark):
    # two callers of one function: what enters at site 1 does not come out at site 2
    edges = [("a", "f", "call", "1"), ("b", "f", "call", "2"), ("f", "g", "step", None), ("g", "ra", "return", "1"), ("g", "rb", "return", "2"), ("rb", "sink", "step", None)]
    df = spark.createDataFrame(edges, SCHEMA)
    assert {r["node"] for r in graph.reaches(df.select("src", "dst"), nodes(spark, ["sink"])).collect()} >= {"a", "b"}
    got = {r["source"]: r for r in flow.matched_witnesses(df, nodes(spark, ["a", "b", "f"]), nodes(spark, ["sink"])).collect()}
    assert set(got) == {"b", "f"}  # f was never seen to be entered, so it may return anywhere
    assert (got["b"]["path"], got["b"]["kinds"], got["b"]["length"]) == (["b", "rb", "sink"], ["through", "step"], 2)
    assert got["f"]["path"] == ["f", "g", "rb", "sink"] and got["f"]["kinds"] == ["step", "return", "step"]


def test_matched_calls(spark):
    for seed in (1, 2):
        rng = random.Random(seed)
        names = [f"n{k}" for k in range(14)]
        edges = [(rng.choice(names), rng.choice(names), "step", None) for _ in range(7)]
        for site in range(5):
            at = [rng.choice(names) for _ in range(4)]
            edges += [(at[0], at[1], "call", str(site)), (at[2], at[3], "return", str(site))]
        sinks = {"n0", "n1"}
        df = spark.createDataFrame(edges, SCHEMA)
        got = flow.matched_witnesses(df, nodes(spark, names), nodes(spark, sinks)).collect()
        want = pushdown(edges, names, sinks)
        assert {r["source"] for r in got} == set(want) and all(r["sink"] in want[r["source"]] for r in got)


def test_witnesses(spark):
    rng = random.Random(3)
    edges = sorted({(f"{rng.randrange(40):02d}", f"{rng.randrange(40):02d}") for _ in range(70)})
    sinks = {"00", "01", "02"}
    back = {}
    for a, b in edges:
        back.setdefault(b, []).append(a)
    best, front, far = {s: (0, s) for s in sinks}, set(sinks), 0
    while front:
        far += 1
        met = {}
        for v in front:
            for a in back.get(v, []):
                if a not in best:
                    met.setdefault(a, set()).add(best[v][1])
        front = set(met)
        best |= {a: (far, min(s)) for a, s in met.items()}
    df = spark.createDataFrame(edges, "src string, dst string")
    got = {r["source"]: r for r in flow.witnesses(df, nodes(spark, [f"{k:02d}" for k in range(40)]), nodes(spark, sinks)).collect()}
    assert {k: (r["length"], r["sink"]) for k, r in got.items()} == best
    for k, r in got.items():
        assert r["path"][0] == k and r["path"][-1] == r["sink"] and len(r["path"]) == r["length"] + 1 and all(e in set(edges) for e in zip(r["path"], r["path"][1:]))
    assert flow.witnesses(df, nodes(spark, []), nodes(spark, sinks)).count() == 0 and flow.witnesses(df, nodes(spark, sinks), nodes(spark, [])).count() == 0


CODE = {
    "handle": "int handle(char *req)\n{\n  char cmd[64];\n  char safe[64];\n  fill(cmd, req);\n  fill(safe, cmd->len);\n  run(safe);\n  return 0;\n}",
    "fill": "void fill(char *to, char *from)\n{\n  strcpy(to, from);\n}",
    "run": "void run(char *what)\n{\n  struct job *j;\n  j->line = what;\n  system(j->line);\n}",
    "quiet": "void quiet(char *req)\n{\n  char own[8];\n  char other[8];\n  fill(own, req);\n  fill(other, \"x\");\n  system(other);\n}",
    "sum": "int sum(int a, int b)\n{\n  int c = a + 1;\n  c = scale((int)c, \"system(b)\");\n  return c;\n}",
}


def test_flows_of_text(spark):
    rows = [(f"{k:08x}", n, c) for k, (n, c) in enumerate(sorted(CODE.items()))]
    f = spark.createDataFrame(rows, "address string, ghidra_name string, code string")
    at = {n: a for a, n, _ in rows}
    way = flow.flow_graph(f, Scratch(spark, "test"))
    sources = graph.parameter_sources(f, ["handle", "quiet", "sum"])
    got = {r["source"]: r for r in flow.matched_witnesses(way, sources, flow.call_arguments(f, ["system"], 0)).collect()}
    assert set(got) == {f"{at['handle']}/req"}  # quiet's two calls of fill do not mix; text in quotes is no call
    path = [p.partition("/")[2] for p in got[f"{at['handle']}/req"]["path"]]
    assert path[:3] == ["req", "cmd", "cmd.len"] and path[-3:] == ["safe", "what", "j.line"]
    plain = graph.flows(way, sources, flow.call_arguments(f, ["system"]))
    assert f"{at['quiet']}/req" in {r["node"] for r in plain.collect()}
    uses = {tuple(r)[2:] for r in flow.value_steps(f).where(f"address = '{at['sum']}'").collect()}
    assert {("copy", "a", "c", -1), ("argument", "c", "scale", 0), ("result", "c", "scale", -1), ("returned", "c", "", -1), ("parameter", "b", "", 1)} <= uses
    assert not any(n == "b" and role == "argument" for role, n, *_ in uses)
