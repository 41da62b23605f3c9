import itertools

import pytest

from corploom.plans import queries


@pytest.fixture
def tables(spark, tmp_path):
    # quantities below 45 and order keys that 7 does not divide, but for one line
    lines = [(o, 1 + k, s, p, 5.0 + k, "RA"[(o + k) % 2]) for o, (s, p) in enumerate(itertools.product(range(1, 7), range(1, 9)), 1) for k in range(2) if (s * p + k) % 3]
    lines.append((7, 9, 1, 1, 50.0, "A"))
    put = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    put(lines, "l_orderkey long, l_linenumber long, l_suppkey long, l_partkey long, l_quantity double, l_returnflag string", "lineitem")
    put([(s, s % 2) for s in range(1, 7)], "s_suppkey long, s_nationkey long", "supplier")
    put([(p, f"Brand#{p}") for p in range(1, 9)], "p_partkey long, p_brand string", "part")
    return str(tmp_path), lines


def test_offsets_of_all_lines(spark, tables):
    path, lines = tables
    held = {}
    for _, _, s, p, _, _ in lines:
        held.setdefault(s, set()).add(p)
    ranked = {}
    for a, b in itertools.permutations(held, 2):
        both = len(held[a] & held[b])
        if both >= 2:
            ranked.setdefault(a, []).append((-both / len(held[a] | held[b]), b, both))
    want = {(a, b, both, k, round(-s, 9)) for a, xs in ranked.items() for k, (s, b, both) in enumerate(sorted(xs)[:3], 1)}
    assert {(r.a, r.b, r.overlap, r.place, r.score) for r in queries.QUERIES["offset_jaccard_topk"](spark, path).collect()} == want
    sites = {}
    for a, xs in ranked.items():
        top = [b for x, b, _ in sorted(xs)[:8] if -x >= 0.015]
        for off in held[a] if len(top) >= 2 else ():
            n = {a % 2} | {b % 2 for b in top if off in held[b]}
            if len(n) >= 3:
                sites[a, off] = len(n)
    got = {(r.obj, r.off): r.sites for r in queries.QUERIES["consensus_offsets"](spark, path).collect()}
    assert got == sites == {}  # two nations only
