"""The operators bound to the driver's tables, each with its DuckDB SQL.

The driver's tables hold no C text, so operators that read it run over text
made of the parts' columns (``ctext``), while the SQL reads the columns; others
run over a shape alike: suppliers are objects whose offsets are part keys,
events are proposals and edits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import addresses as ad
from ..functions import source_text as st
from ..operators import catalog, corpus, evidence, export, flow, graph, registry, search, sections, similarity, validation
from ..sources import sinks
from ..storage import Scratch
from . import ctext
from .catalog import merged_usage, usage_text

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Stand-ins for the patterns of C noise that prose can hold; both regex dialects read them alike.
PROSE_NOISE = {
    "capitals": (r"[A-Z]{3,}", 5), "shouts": (r"!!", 4), "pipes": (r"\|", 4), "marks": (r"[#$%&*]{3}", 3),
    "numbers": (r"[0-9]+", 3), "short": (r"\n[a-z]{1,3} ", 2), "stops": (r"[.]\n", 1),
}

_NOISE_SQL = "WITH n AS (SELECT doc_id, " + ", ".join(
    "len(regexp_extract_all(coalesce(text, ''), '{}')) AS {}".format(rx.replace("\\n", "\\n"), k) for k, (rx, _) in PROSE_NOISE.items()
) + ", length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1 AS n_lines FROM documents)"
_SCORE_SQL = " + ".join(f"{k} * {w}" for k, (_, w) in PROSE_NOISE.items())
_TOTAL_SQL = " + ".join(PROSE_NOISE)


@query(f"{_NOISE_SQL} SELECT doc_id, {', '.join(PROSE_NOISE)}, n_lines, {_SCORE_SQL} AS score, {_TOTAL_SQL} AS total FROM n WHERE {_SCORE_SQL} > 0 ORDER BY score DESC, total DESC, doc_id LIMIT 10")
def noise_hotspots(spark, sf):
    return corpus.noise_hotspots(corpus.noise_counts(t(spark, sf, "documents"), "doc_id", "text", PROSE_NOISE), "doc_id")


@query(f"{_NOISE_SQL} SELECT kind, CAST(sum(n) AS BIGINT) AS hits, count(*) FILTER (WHERE n > 0) AS files FROM (UNPIVOT n ON {', '.join(PROSE_NOISE)} INTO NAME kind VALUE n) GROUP BY kind")
def noise_by_type(spark, sf):
    return corpus.noise_by_type(corpus.noise_counts(t(spark, sf, "documents"), "doc_id", "text", PROSE_NOISE), list(PROSE_NOISE))


@query(f"""{_NOISE_SQL}, u AS (SELECT doc_id, kind, n FROM (UNPIVOT n ON {', '.join(PROSE_NOISE)} INTO NAME kind VALUE n) WHERE n > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY doc_id) AS place FROM u)
SELECT kind, CAST(sum(n) AS BIGINT) AS count, array_to_string(list(doc_id || ' (' || n || ')' ORDER BY place) FILTER (WHERE place <= 8), ',') AS files FROM r GROUP BY kind""")
def noise_first_files(spark, sf):
    counts = corpus.noise_counts(t(spark, sf, "documents"), "doc_id", "text", PROSE_NOISE)
    return corpus.noise_files(counts, "doc_id", list(PROSE_NOISE)).withColumn("files", F.array_join("files", ","))


@query("SELECT doc_id, name FROM (SELECT doc_id, CASE source WHEN 'src0' THEN '_start' WHEN 'src1' THEN '_INIT_' || doc_id WHEN 'src2' THEN '_DT_FINI' ELSE source END AS name FROM documents) WHERE name <> '_start' AND NOT starts_with(name, '_INIT') AND NOT starts_with(name, '_FINI') AND NOT starts_with(name, '_DT_INIT') AND NOT starts_with(name, '_DT_FINI')")
def runtime_filter(spark, sf):
    s = F.col("source")
    name = F.when(s == "src0", "_start").when(s == "src1", F.concat(F.lit("_INIT_"), F.col("doc_id").cast("string"))).when(s == "src2", "_DT_FINI").otherwise(s)
    return corpus.drop_runtime_stubs(t(spark, sf, "documents").select("doc_id", name.alias("name")), "name")


@query(r"""SELECT doc_id, line_no, substr(regexp_replace(line, '^\s+|\s+$', '', 'g'), 1, 240) AS snippet FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents) WHERE contains(lower(line), 'license') ORDER BY doc_id, line_no LIMIT 30""")
def text_search_topn(spark, sf):
    return corpus.search_text(t(spark, sf, "documents"), "doc_id", "text", "License")


@query(r"""SELECT doc_id, line_no, substr(regexp_replace(line, '^\s+|\s+$', '', 'g'), 1, 240) AS snippet FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents) WHERE contains(lower(line), 'tioning the') ORDER BY doc_id, line_no LIMIT 100""")
def text_search_indexed(spark, sf):
    path = Scratch(spark, "search").path()
    search.build(t(spark, sf, "documents"), path, "doc_id", "text")
    return search.search(spark, path, "Tioning THE", 100).withColumnRenamed("key", "doc_id")


@query("SELECT p_partkey, p_name, p_brand, p_size FROM part WHERE p_size >= 25 AND (contains(lower(p_name), 'red') OR contains(lower(p_brand), 'red') OR contains(lower(p_type), 'red'))")
def catalog_browse(spark, sf):
    return corpus.browse(t(spark, sf, "part"), F.col("p_size") >= 25, "Red", ["p_name", "p_brand", "p_type"]).select("p_partkey", "p_name", "p_brand", "p_size")


@query(r"""
WITH f AS (SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '/\*(?s:.*?)\*/', '', 'g'), '//[^\n]*', '', 'g'), '\bFUN_[0-9a-fA-F]+\b', 'FUN_', 'g'), '\b0x[0-9a-fA-F]+\b', '0x', 'g'), '\s+', ' ', 'g'), ' ')) AS fingerprint FROM documents)
SELECT fingerprint, count(*) AS n, min(doc_id) AS first_key FROM f GROUP BY fingerprint HAVING count(*) > 1""")
def fingerprint_groups(spark, sf):
    return corpus.fingerprint_groups(t(spark, sf, "documents"), "doc_id", "text")


def _entries(spark, sf):
    c = t(spark, sf, "customer")
    refs = t(spark, sf, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    place = F.col("c_custkey") * 24 + F.pmod(F.conv(F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 6), 16, 10).cast("long"), F.lit(24))
    return c.join(refs, "c_custkey", "left").select(place.alias("address"), F.coalesce("n", F.lit(0)).alias("refs"), F.col("c_mktsegment").alias("print"))


@query("""
WITH RECURSIVE e AS (
  SELECT c_custkey * 24 + CAST('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 6) AS BIGINT) % 24 AS address, coalesce(n, 0) AS refs, c_mktsegment AS print
  FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey
), s AS (
  SELECT *, row_number() OVER (ORDER BY address) AS rn, coalesce(address - lag(address) OVER (ORDER BY address) > 16, true) AS head FROM e
), w AS (
  SELECT rn, address, refs, print, false AS gone, CAST(NULL AS BIGINT) AS dropped, '' AS reason FROM s WHERE head
  UNION ALL
  SELECT rn, address, refs, print, drops_b, CASE WHEN drops_a THEN pa WHEN drops_b THEN address END, CASE WHEN drops_a OR (drops_b AND pr > 0) THEN 'callsite' WHEN drops_b THEN 'fingerprint' ELSE '' END
  FROM (SELECT s.*, w.address AS pa, w.refs AS pr, NOT w.gone AND w.refs = 0 AND s.refs > 0 AS drops_a,
               NOT w.gone AND s.refs = 0 AND (w.refs > 0 OR w.print = s.print) AS drops_b
        FROM w JOIN s ON s.rn = w.rn + 1 AND NOT s.head)
), d AS (SELECT dropped, reason FROM w WHERE dropped IS NOT NULL)
SELECT address, dropped IS NOT NULL AS dropped, coalesce(reason, '') AS reason FROM e LEFT JOIN d ON dropped = address
""")
def overlap_dedup(spark, sf):
    return corpus.drop_overlapping(_entries(spark, sf), "address", "refs", "print").drop("kept")


@query("SELECT user_id, event_id, next_key FROM (SELECT user_id, event_id, ts, lead(ts) OVER w AS there, lead(event_id) OVER w AS next_key FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE there > ts AND there <= ts + INTERVAL 1 HOUR")
def successor_pairs(spark, sf):
    return corpus.successor_pairs(t(spark, sf, "events"), "user_id", "ts", "event_id", F.expr("there > here and there <= here + interval 1 hour"))


@query(f"""WITH {ctext.FN}, {ctext.SYMBOLS}, found AS (
  SELECT address, 'FUN_' || {ctext.ADDRESS.format('third')} AS symbol, 0 AS place FROM fn
  UNION ALL SELECT address, 'DAT_' || printf('%x', k % 50), 1 FROM fn WHERE k % 2 = 0)
SELECT address, symbol, place, canonical_name IS NOT NULL AS known, canonical_name FROM found LEFT JOIN sym USING (symbol)""")
def placeholder_split(spark, sf):
    return registry.placeholder_split(ctext.functions(spark, sf), ctext.symbols(spark, sf))


def _heap(spark, sf):
    return t(spark, sf, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("src"), F.expr("(p_partkey - 1) div 2").alias("dst"))


_HEAP = "heap AS (SELECT p_partkey AS src, (p_partkey - 1) // 2 AS dst FROM part WHERE p_partkey > 0)"


@query(f"WITH {_HEAP} SELECT p_partkey, (SELECT count(*) FROM heap WHERE dst = p_partkey) AS callers, (SELECT count(*) FROM heap WHERE src = p_partkey) AS callees FROM part")
def edges_indegree(spark, sf):
    return graph.degrees(t(spark, sf, "part"), "p_partkey", _heap(spark, sf))


@query(f"WITH {ctext.FN}, {ctext.CALLS} SELECT a.address AS caller, a.name AS caller_name, b.address AS callee, b.name AS callee_name FROM edges JOIN fn a ON a.k = src JOIN fn b ON b.k = dst")
def callers_callees(spark, sf):
    f = ctext.functions(spark, sf)
    return catalog.neighbours(graph.call_edges(f), f)


@query(f"""WITH {ctext.FN}, {ctext.CALLS}, u AS (SELECT src, dst FROM edges UNION SELECT k, third FROM fn WHERE k <> third)
SELECT a.address AS src, b.address AS dst FROM u JOIN fn a ON a.k = src JOIN fn b ON b.k = dst""")
def united_edges(spark, sf):
    return graph.order_edges(ctext.functions(spark, sf))


@query(f"""WITH {ctext.FN}, {ctext.CALLS}, s AS (SELECT b.address AS callee, a.address AS caller, line_no, snippet FROM calls JOIN fn a ON a.k = src JOIN fn b ON b.k = dst WHERE src <> dst)
SELECT callee, caller, line_no, snippet FROM (SELECT *, row_number() OVER (PARTITION BY callee ORDER BY caller, line_no) AS n FROM s) WHERE n <= 24""")
def call_sites_topk(spark, sf):
    f = ctext.functions(spark, sf)
    return catalog.call_sites(f, graph.call_edges(f), 24)


@query(f"""WITH {ctext.FN}, odd AS (SELECT *, '*(int *)(p + ' || (k % 5) * 4 || ')' AS a FROM fn)
SELECT address, name AS function, 8 AS line_no, 'p' AS base, CAST(off AS BIGINT) AS "offset", ctype, size, CASE WHEN k % 2 = 1 THEN 'use(' || a || ' + *(short *)(p + 64), name);' ELSE a || ' = DAT_' || printf('%x', k % 50) || ';' END AS snippet,
  CASE WHEN k % 2 = 1 THEN 'use' ELSE '' END AS callee, CASE WHEN k % 2 = 1 THEN 0 ELSE -1 END AS arg_index, CASE WHEN k % 2 = 1 THEN 2 ELSE 0 END AS arg_count, 'displacement' AS access_kind,
  CASE WHEN k % 2 = 1 THEN 'read' ELSE 'write' END AS access_mode, CASE WHEN k % 2 = 1 THEN 'participates_in_pointer_or_offset_addition,passed_to_use_arg0' ELSE '' END AS roles
FROM (SELECT address, name, k, a, (k % 5) * 4 AS off, 'int' AS ctype, 4 AS size FROM odd UNION ALL SELECT address, name, k, a, 64, 'short', 2 FROM odd WHERE k % 2 = 1)""")
def access_facts(spark, sf):
    facts = evidence.access_facts(ctext.functions(spark, sf))
    return facts.drop("byte_offset").withColumn("roles", F.array_join("roles", ","))


@query(f"WITH RECURSIVE {_HEAP}, d(n, depth) AS (SELECT 0::BIGINT, 0 UNION ALL SELECT src, depth + 1 FROM d JOIN heap ON dst = n), x AS (SELECT n, max(depth) AS depth FROM d GROUP BY n) SELECT n AS p_partkey, depth, false AS is_cycle FROM x")
def topo_layers(spark, sf):
    return graph.layers(t(spark, sf, "part"), "p_partkey", _heap(spark, sf))


@query("""
WITH RECURSIVE n AS (SELECT DISTINCT event_type AS node FROM events UNION ALL SELECT 'start' UNION ALL SELECT 'leaf' UNION ALL SELECT 'middle'),
e AS (SELECT DISTINCT a AS src, b AS dst FROM (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NOT NULL AND a <> b
      UNION ALL SELECT 'start', min(event_type) FROM events UNION ALL SELECT 'middle', 'leaf'),
r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst),
c AS (SELECT DISTINCT src AS node FROM r WHERE src = dst), bad AS (SELECT node FROM c UNION SELECT src FROM r WHERE dst IN (SELECT node FROM c)),
d(node, depth) AS (SELECT node, 0 FROM n WHERE node NOT IN (SELECT node FROM bad) UNION ALL SELECT e.src, depth + 1 FROM d JOIN e ON e.dst = d.node WHERE e.src NOT IN (SELECT node FROM bad))
SELECT node, max(depth) AS depth, false AS is_cycle FROM d GROUP BY node UNION ALL SELECT node, NULL, true FROM bad
""")
def topo_cycle_residue(spark, sf):
    e = t(spark, sf, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = e.select(F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst")).where("dst is not null").distinct()
    steps = steps.unionByName(e.agg(F.min("event_type").alias("dst")).select(F.lit("start").alias("src"), "dst")).unionByName(spark.createDataFrame([("middle", "leaf")], "src string, dst string"))
    nodes = e.select(F.col("event_type").alias("node")).distinct().unionByName(spark.createDataFrame([("start",), ("leaf",), ("middle",)], "node string"))
    return graph.layers(nodes, "node", steps)


@query(f"WITH RECURSIVE {_HEAP}, r AS (SELECT p_partkey AS node FROM part WHERE p_size = 1 UNION SELECT src FROM heap JOIN r ON dst = node) SELECT node FROM r")
def reach_closure(spark, sf):
    return graph.reaches(_heap(spark, sf), t(spark, sf, "part").where("p_size = 1").select(F.col("p_partkey").alias("node")))


@query("SELECT l_orderkey, l_linenumber, l_suppkey AS caller, s_name AS caller_name, l_partkey AS callee, p_brand AS callee_name FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE p_brand IN ('Brand#1', 'Brand#7', 'Brand#19')")
def exec_calls(spark, sf):
    calls = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("caller"), F.col("l_partkey").alias("callee"))
    callers = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("caller"), F.col("s_name").alias("caller_name"))
    callees = t(spark, sf, "part").select(F.col("p_partkey").alias("callee"), F.col("p_brand").alias("callee_name"))
    return graph.calls_between(calls, callers, callees, ["Brand#1", "Brand#7", "Brand#19"]).select("l_orderkey", "l_linenumber", "caller", "caller_name", "callee", "callee_name")


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS src, (p_partkey - 1) // 2 AS dst FROM part WHERE p_partkey > 0 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey > 0),
d AS (SELECT p_partkey AS node, 0 AS length FROM part WHERE p_size = 7 UNION SELECT e.src, d.length + 1 FROM d JOIN e ON e.dst = d.node WHERE d.length < 20),
far AS (SELECT node, min(length) AS length FROM d GROUP BY node),
s AS (SELECT p_partkey AS node, p_partkey AS sink, 0 AS length FROM part WHERE p_size = 7 UNION SELECT f.node, s.sink, f.length FROM s JOIN e ON e.dst = s.node JOIN far f ON f.node = e.src AND f.length = s.length + 1),
near AS (SELECT node, min(sink) AS sink, min(length) AS length FROM s GROUP BY node),
step AS (SELECT n.node, n.sink, n.length, min(m.node) AS next FROM near n LEFT JOIN (SELECT e.src, m.node, m.sink, m.length FROM e JOIN near m ON m.node = e.dst) m ON m.src = n.node AND m.sink = n.sink AND m.length = n.length - 1 GROUP BY 1, 2, 3),
w AS (SELECT node AS source, sink, length, CAST(node AS VARCHAR) AS path, next FROM step UNION ALL SELECT w.source, w.sink, w.length, w.path || '>' || s.node, s.next FROM w JOIN step s ON s.node = w.next)
SELECT source, sink, length, path FROM w WHERE next IS NULL""")
def witness_paths(spark, sf):
    sinks_ = t(spark, sf, "part").where("p_size = 7").select(F.col("p_partkey").alias("node"))
    thirds = t(spark, sf, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 3").alias("dst"))
    got = flow.witnesses(_heap(spark, sf).unionByName(thirds), t(spark, sf, "part").select(F.col("p_partkey").alias("node")), sinks_)
    return got.select("source", "sink", "length", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query("""WITH RECURSIVE l AS (SELECT l_orderkey AS o, l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_linenumber = 1),
e AS (SELECT 'o' || o AS src, 's' || s AS dst, 'call' AS kind, 'o' || o AS site FROM l UNION SELECT 'u' || s, 'p' || p, 'return', 'o' || o FROM l
      UNION SELECT 's' || s_suppkey, 't' || s_suppkey, 'step', NULL FROM supplier UNION SELECT 't' || s_suppkey, 'n' || s_nationkey, 'call', 's' || s_suppkey FROM supplier UNION SELECT 'n' || s_nationkey, 'u' || s_suppkey, 'return', 's' || s_suppkey FROM supplier),
w AS (SELECT source, source AS node, CAST([] AS VARCHAR[]) AS open_calls FROM (SELECT 'o' || o AS source FROM l UNION SELECT 't' || s_suppkey FROM supplier)
      UNION SELECT w.source, e.dst, CASE e.kind WHEN 'call' THEN list_append(w.open_calls, e.site) WHEN 'return' THEN w.open_calls[1:len(w.open_calls) - 1] ELSE w.open_calls END
      FROM w JOIN e ON e.src = w.node WHERE len(w.open_calls) < 4 AND (e.kind <> 'return' OR len(w.open_calls) = 0 OR w.open_calls[len(w.open_calls)] = e.site))
SELECT source, min(node) AS sink FROM w WHERE node LIKE 'p%' GROUP BY source""")
def matched_flow(spark, sf):
    n = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    way = lambda df, a, b, kind, site: df.select(a.alias("src"), b.alias("dst"), F.lit(kind).alias("kind"), site.cast("string").alias("site"))
    first, supplier = t(spark, sf, "lineitem").where("l_linenumber = 1"), t(spark, sf, "supplier")
    o, s = n("o", "l_orderkey"), n("s", "s_suppkey")
    edges = way(first, o, n("s", "l_suppkey"), flow.CALL, o).unionByName(way(first, n("u", "l_suppkey"), n("p", "l_partkey"), flow.RETURN, o))
    inner = way(supplier, s, n("t", "s_suppkey"), flow.STEP, F.lit(None)).unionByName(way(supplier, n("t", "s_suppkey"), n("n", "s_nationkey"), flow.CALL, s)).unionByName(way(supplier, n("n", "s_nationkey"), n("u", "s_suppkey"), flow.RETURN, s))
    sources = first.select(o.alias("node")).unionByName(supplier.select(n("t", "s_suppkey").alias("node")))
    return flow.matched_witnesses(edges.unionByName(inner), sources, first.select(n("p", "l_partkey").alias("node"))).select("source", "sink")


def _facts(spark, sf, obj="l_suppkey"):
    return t(spark, sf, "lineitem").select(F.col(obj).alias("obj"), F.col("l_partkey").alias("off"), (F.col("l_returnflag") == "R").alias("is_write"))


def _pairs_sql(obj: str) -> str:
    return f"""f AS (SELECT {obj} AS obj, l_partkey AS off, max(l_returnflag = 'R') AS is_write FROM lineitem GROUP BY 1, 2),
z AS (SELECT obj, count(*) AS n FROM f GROUP BY obj),
s AS (SELECT x.obj AS a, y.obj AS b, count(*) AS overlap FROM f x JOIN f y ON x.off = y.off AND x.obj <> y.obj GROUP BY 1, 2 HAVING count(*) >= 2),
p AS (SELECT a, b, overlap, overlap / (za.n + zb.n - overlap) AS score, za.n AS na FROM s JOIN z za ON za.obj = a JOIN z zb ON zb.obj = b)"""


@query(f"WITH {_pairs_sql('l_suppkey')} SELECT a, b, overlap, round(score, 9) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS place FROM p) WHERE place <= 3")
def offset_jaccard_topk(spark, sf):
    return similarity.related(_facts(spark, sf).drop("is_write"), limit=3).withColumn("score", F.round("score", 9))


@query(f"""WITH {_pairs_sql('l_suppkey')}, top AS (SELECT a, b, score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS k FROM p) WHERE k <= 8),
peer AS (SELECT a, b FROM top WHERE score >= 0.015), ok AS (SELECT a FROM peer GROUP BY a HAVING count(*) >= 2),
u AS (SELECT DISTINCT l_suppkey AS obj, l_partkey AS off, s_nationkey AS fn, l_returnflag AS call FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
seen AS (SELECT o.obj, o.off, u.fn, u.call FROM ok JOIN f o ON o.obj = a JOIN peer USING (a) JOIN u ON u.obj = b AND u.off = o.off UNION ALL SELECT o.obj, o.off, s_nationkey, NULL FROM ok JOIN f o ON o.obj = a JOIN supplier ON s_suppkey = a)
SELECT obj, off, count(DISTINCT fn) AS sites, array_to_string(list_slice(list_sort(list(DISTINCT CAST(fn AS VARCHAR))), 1, 3), ',') AS functions, array_to_string(list_sort(list(DISTINCT call) FILTER (WHERE call IS NOT NULL)), ',') AS calls
FROM seen GROUP BY 1, 2 HAVING count(DISTINCT fn) >= 3""")
def consensus_offsets(spark, sf):
    facts = _facts(spark, sf).drop("is_write")
    nation = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("obj"), F.col("s_nationkey").cast("string").alias("function"))
    uses = t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("obj"), F.col("l_partkey").alias("off"), F.col("l_returnflag").alias("call")).join(nation, "obj")
    got = similarity.consensus(similarity.related(facts, limit=8), facts, uses, least_score=0.015)
    return got.select("obj", "off", "sites", F.array_join("functions", ",").alias("functions"), F.array_join("calls", ",").alias("calls"))


@query(f"""WITH {_pairs_sql('l_orderkey')},
w AS (SELECT DISTINCT p.a, p.b FROM p JOIN f o ON o.obj = p.a JOIN f y ON y.obj = p.b AND y.off = o.off AND y.is_write WHERE p.overlap = p.na),
r AS (SELECT p.*, w.a IS NOT NULL AS writer, row_number() OVER (PARTITION BY p.a ORDER BY score DESC, p.b) AS k, count(*) OVER (PARTITION BY p.a) AS n FROM p LEFT JOIN w ON w.a = p.a AND w.b = p.b),
m AS (SELECT *, min(CASE WHEN writer THEN k END) OVER (PARTITION BY a) AS slot FROM r),
q AS (SELECT *, CASE WHEN slot IS NULL THEN k WHEN k = slot THEN least(2, n) WHEN slot = 1 AND k = 2 THEN 1 WHEN slot > 1 AND k >= 2 AND k < slot THEN k + 1 ELSE k END AS place FROM m)
SELECT a, b, overlap, round(score, 9) AS score, CAST(place AS BIGINT) AS place FROM q WHERE place <= 3""")
def writer_slot(spark, sf):
    return similarity.related(_facts(spark, sf, "l_orderkey"), limit=3, writer=True).withColumn("score", F.round("score", 9))


@query("""SELECT l_suppkey, l_linenumber,
  array_to_string(list_slice(list_sort(list(DISTINCT l_returnflag)), 1, 3), ',') AS l_returnflag, array_to_string(list_slice(list_sort(list(DISTINCT CAST(l_partkey AS VARCHAR))), 1, 5), ',') AS l_partkey
FROM lineitem GROUP BY 1, 2""")
def object_digest(spark, sf):
    return similarity.digest(t(spark, sf, "lineitem"), ["l_suppkey", "l_linenumber"], {"l_returnflag": 3, "l_partkey": 5})


@query("""SELECT l_suppkey, l_partkey, l_quantity, l_orderkey, place FROM (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY w, l_quantity, l_orderkey, l_linenumber, l_extendedprice) AS place FROM (
    SELECT *, l_returnflag <> 'R' AS w, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_returnflag <> 'R', l_quantity, l_orderkey, l_linenumber, l_extendedprice) AS n FROM lineitem) WHERE n = 1) WHERE place <= 5""")
def fact_select(spark, sf):
    order = [F.col("l_returnflag") != "R", F.col("l_quantity"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_extendedprice")]
    return corpus.pick_facts(t(spark, sf, "lineitem"), "l_suppkey", "l_partkey", order, 5).select("l_suppkey", "l_partkey", "l_quantity", "l_orderkey", "place")


@query("""SELECT user_id, event_id, context FROM (SELECT user_id, event_id, event_type, array_to_string(list(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), ',') AS context FROM events) WHERE event_type = 'error'""")
def context_window(spark, sf):
    got = corpus.context_windows(t(spark, sf, "events"), "user_id", "event_id", F.col("event_type") == "error", "event_id")
    return got.select("user_id", "event_id", "context")


def _judged(spark, sf):
    return registry.first_write_wins(t(spark, sf, "events").select("user_id", "event_type", "ts", "event_id"), "user_id", ["event_type"], ["ts", "event_id"])


_FWW = """j AS (SELECT user_id, event_id, CASE WHEN row_number() OVER w = 1 THEN 'inserted' WHEN event_type IS NOT DISTINCT FROM first_value(event_type) OVER w THEN 'updated' ELSE 'conflict' END AS status
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


@query(f"WITH {_FWW} SELECT * FROM j")
def fww_registry(spark, sf):
    return _judged(spark, sf).select("user_id", "event_id", "status")


@query(f"WITH {_FWW} SELECT status, count(*) AS n, count(DISTINCT user_id) AS symbols FROM j GROUP BY status")
def fww_conflict_counts(spark, sf):
    return _judged(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("symbols"))


#: One field a proposal, never overlapping, so an entry only gains offsets: conflicts are other types at a known offset.
@query("""WITH p AS (SELECT l_partkey, l_linenumber * 8 AS off, l_returnflag = 'R' AS r, l_suppkey % 9 AS size, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS seq FROM lineitem),
q AS (SELECT *, first_value(r) OVER (PARTITION BY l_partkey, off ORDER BY seq) AS known, row_number() OVER (PARTITION BY l_partkey, off ORDER BY seq) = 1 AS fresh FROM p),
n AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY l_partkey ORDER BY seq) AS n_fields, off + greatest(size, 1) AS stop FROM q),
s AS (SELECT *, CASE WHEN r <> known THEN 'conflict' WHEN seq = 1 THEN 'inserted' WHEN n_fields = 1 THEN 'updated' ELSE 'merged' END AS status FROM n),
f AS (SELECT l_partkey, arg_max(stop, seq) AS first_stop FROM s WHERE n_fields = 1 AND status <> 'conflict' GROUP BY 1)
SELECT seq, 'part_' || s.l_partkey AS name, status, CAST(n_fields AS INTEGER) AS n_fields,
  CAST(CASE WHEN n_fields = 1 THEN 0 ELSE greatest(first_stop, max(CASE WHEN fresh AND n_fields > 1 THEN stop END) OVER (PARTITION BY s.l_partkey ORDER BY seq)) END AS BIGINT) AS size, 'medium' AS confidence
FROM s JOIN f ON f.l_partkey = s.l_partkey""")
def struct_merge(spark, sf):
    line = t(spark, sf, "lineitem")
    order = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    offset = F.col("l_linenumber") * 8
    field = F.struct(
        offset.cast("long").alias("offset"), F.concat(F.lit("field_"), F.lower(F.hex(offset))).alias("name"),
        F.when(F.col("l_returnflag") == "R", "int").otherwise("uint").alias("type"), F.pmod(F.col("l_suppkey"), F.lit(9)).cast("long").alias("size"),
    )
    judged = registry.merge_layouts(line.select(
        F.row_number().over(order).cast("long").alias("seq"), F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("name"), F.array(field).alias("fields"), F.lit(0).alias("size"),
        F.lit("medium").alias("confidence"), F.col("l_returnflag").alias("evidence"), F.lit("").alias("source_file"),
    ))
    return judged.select("seq", "name", "status", "n_fields", "size", "confidence")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id, event_type) = 1 AS granted FROM events")
def edit_lock(spark, sf):
    return registry.edit_locks(t(spark, sf, "events").select("user_id", "event_id", "ts", "event_type"), "user_id", "event_type", ["ts", "event_id"]).select("user_id", "event_id", "granted")


@query(f"""WITH {ctext.FN}, b AS (SELECT address, CASE WHEN size <= 10 THEN replace(p_name, ' ', '_') ELSE 'do_' || replace(p_name, ' ', '_') END AS base FROM fn)
SELECT address, CASE WHEN count(*) OVER (PARTITION BY base) > 1 THEN base || '_0x' || address ELSE base END AS name FROM b""")
def dup_base_names(spark, sf):
    return export.unique_names(_bases(spark, sf))


def _bases(spark, sf):
    """Parts whose definitions are named by the part, and the small ones by the registry."""
    p = t(spark, sf, "part").select(ctext.address(F.col("p_partkey")).alias("address"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("n"))
    f = p.select("address", F.concat(F.lit("FUN_"), "address").alias("ghidra_name"), F.concat(F.lit("int do_"), "n", F.lit("(void)\n{\n}")).alias("code"))
    return export.base_names(f, ctext.symbols(spark, sf))


@query(f"""WITH {ctext.FN}, {ctext.SYMBOLS}, b AS (SELECT address, replace(p_name, ' ', '_') AS base, CASE WHEN size <= 10 THEN replace(p_name, ' ', '_') ELSE 'do_' || replace(p_name, ' ', '_') END AS whole FROM fn),
n AS (SELECT address, CASE WHEN count(*) OVER (PARTITION BY whole) > 1 THEN whole || '_0x' || address ELSE whole END AS name FROM b)
SELECT symbol AS old, coalesce(name, canonical_name) AS new FROM sym LEFT JOIN n ON symbol = 'FUN_' || address""")
def export_map(spark, sf):
    return export.export_map(ctext.symbols(spark, sf), export.unique_names(_bases(spark, sf)))


@query(f"""WITH {ctext.FN}, {ctext.SYMBOLS}, c AS (SELECT fn.*, f.canonical_name AS called, d.canonical_name AS data FROM fn LEFT JOIN sym f ON f.symbol = 'FUN_' || {ctext.ADDRESS.format('third')} LEFT JOIN sym d ON k % 2 = 0 AND d.symbol = 'DAT_' || printf('%x', k % 50))
SELECT address, CAST((called IS NOT NULL) AS INTEGER) + CAST((data IS NOT NULL) AS INTEGER) AS hits, '  ' || coalesce(called, 'FUN_' || {ctext.ADDRESS.format('third')}) || '();' AS line6,
  CASE WHEN k % 2 = 0 THEN '  *(int *)(p + ' || (k % 5) * 4 || ') = ' || coalesce(data, 'DAT_' || printf('%x', k % 50)) || ';' ELSE '  use(*(int *)(p + ' || (k % 5) * 4 || ') + *(short *)(p + 64), name);' END AS line8 FROM c""")
def export_text(spark, sf):
    mapping = ctext.symbols(spark, sf).select(F.col("symbol").alias("old"), F.col("canonical_name").alias("new"))
    got = registry.replace_symbols(ctext.functions(spark, sf), "address", "code", mapping)
    line = lambda k: F.element_at(st.lines(F.col("code")), k).alias(f"line{k}")
    return got.select("address", "hits", line(6), line(8))


@query(f"""WITH {ctext.FN}, known AS (SELECT DISTINCT size, k % 7 AS f FROM fn WHERE k % 2 = 0), s AS (SELECT DISTINCT size FROM known),
u AS (SELECT fn.*, s.size IS NOT NULL AS there, known.size IS NULL AND s.size IS NOT NULL AS bad FROM fn LEFT JOIN s ON s.size = fn.size LEFT JOIN known ON known.size = fn.size AND known.f = k % 7)
SELECT address, 1 AS checked, CASE WHEN there THEN 0 ELSE 1 END AS unbound, CASE WHEN bad THEN 'p.f_' || k % 7 || ' of s_' || size || ' at 7: p->f_' || k % 7 || ' = ' || size || ';' ELSE '' END AS violations FROM u""")
def coherence_antijoin(spark, sf):
    got = validation.field_coherence(ctext.functions(spark, sf), ctext.structs(spark, sf))
    told = F.transform("violations", lambda v: F.format_string("%s.%s of %s at %d: %s", v["base"], v["field"], v["struct_name"], v["line"], v["snippet"]))
    return got.select("address", "checked", "unbound", F.array_join(told, ";").alias("violations"))


@query(f"""WITH {ctext.FN}, {ctext.CALLS}
SELECT a.address AS caller, b.address AS callee, 4 AS line_no, 0 AS position, '"' || a.p_name || '"' AS argument, 'int size' AS parameter, 'char*' AS actual, snippet
FROM edges e JOIN calls c ON c.src = e.src AND c.line_no = 4 JOIN fn a ON a.k = e.src JOIN fn b ON b.k = e.dst
WHERE a.k % 3 = 0 AND b.k % 4 <> 0 AND contains('fn_' || a.half, b.name)""")
def signature_audit(spark, sf):
    f = ctext.functions(spark, sf)
    return validation.signature_audit(graph.call_edges(f), f)


@query(f"""WITH {ctext.FN} SELECT address, name, CASE WHEN size <= 5 THEN 'missing' ELSE 'mismatch' END AS problem, CASE WHEN size > 5 THEN 'int ' || name || '(int size, char *name);' END AS found FROM fn WHERE size <= 5 OR k % 4 = 0""")
def decl_audit(spark, sf):
    p = t(spark, sf, "part").where("p_size > 5")
    header = p.select(F.concat(F.lit("int fn_"), F.col("p_partkey").cast("string"), F.lit("(int size, char *name);")).alias("line"))
    return validation.declaration_audit(ctext.functions(spark, sf), header)


@query("""WITH f AS (SELECT l_orderkey, l_linenumber * 16 AS off, max(CAST(l_quantity AS INTEGER) % 24) AS n, max(l_returnflag) AS kind FROM lineitem GROUP BY 1, 2),
g AS (SELECT *, CASE WHEN n > 0 THEN n WHEN kind = 'A' THEN 4 WHEN kind = 'N' THEN 18 ELSE 0 END AS size FROM f),
e AS (SELECT *, coalesce(lag(off + size) OVER (PARTITION BY l_orderkey ORDER BY off), 0) AS cursor FROM g)
SELECT 'o_' || l_orderkey AS name, CAST(off AS BIGINT) AS "offset", CAST(size AS BIGINT) AS size, CAST(greatest(off - cursor, 0) AS BIGINT) AS pad, off < cursor AS overlap FROM e""")
def struct_layout_pad(spark, sf):
    f = t(spark, sf, "lineitem").groupBy("l_orderkey", (F.col("l_linenumber") * 16).cast("long").alias("offset")).agg((F.max(F.col("l_quantity").cast("int") % 24)).cast("long").alias("size"), F.max("l_returnflag").alias("kind"))
    kind = F.when(F.col("kind") == "A", "int").when(F.col("kind") == "N", "short[3][3]").otherwise("struct other")
    field = F.struct("offset", F.concat(F.lit("f_"), F.col("offset").cast("string")).alias("name"), kind.alias("type"), "size")
    laid = f.groupBy("l_orderkey").agg(F.collect_list(field).alias("fields")).select(F.concat(F.lit("o_"), F.col("l_orderkey").cast("string")).alias("name"), "fields")  # an order's lines
    return sinks.struct_layout(laid).select("name", "offset", "size", "pad", "overlap")


@query("""WITH s AS (SELECT 'DAT_' || printf('%x', p_partkey) AS symbol, replace(p_brand, '#', '_') AS name, CASE WHEN p_size < 3 THEN '' ELSE CAST(p_size AS VARCHAR) END AS value FROM part WHERE p_partkey % 3 > 0)
SELECT '#define ' || name || ' ' || arg_min(value, symbol) AS line FROM s WHERE value <> '' GROUP BY name""")
def macro_dedup(spark, sf):
    p = t(spark, sf, "part")
    kind = F.when(F.col("p_partkey") % 3 > 0, "constant").otherwise("global_var")
    value = F.when(F.col("p_size") < 3, "").otherwise(F.col("p_size").cast("string"))
    return sinks.macro_lines(p.select(F.concat(F.lit("DAT_"), F.lower(F.hex("p_partkey"))).alias("symbol"), F.replace("p_brand", F.lit("#"), F.lit("_")).alias("canonical_name"), kind.alias("kind"), value.alias("value")))


@query("SELECT DISTINCT lower(regexp_replace(p_type, '[^A-Za-z]', '', 'g')) || ' ** ' || replace(p_brand, '#', '_') || '(int a, char *b);' AS line FROM part")
def decls_distinct(spark, sf):
    kind = F.lower(F.regexp_replace("p_type", "[^A-Za-z]", ""))
    code = F.concat(F.lit("// made\n"), kind, F.lit(" **"), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit("(int a,char *b)\n{\n}"))
    return sinks.declaration_lines(t(spark, sf, "part").select(code.alias("code")))


@query(r"""WITH d AS (SELECT doc_id, replace(coalesce(text, ''), 'the ', 'system(') AS named, replace(coalesce(text, ''), 'idiot', 'strcpy(') AS structured FROM documents JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) USING (doc_id)),
l AS (SELECT doc_id, 0 AS rank, 'named' AS file, unnest(string_split(named, chr(10))) AS line, unnest(range(1, len(string_split(named, chr(10))) + 1)) AS line_no FROM d
      UNION ALL SELECT doc_id, 1, 'structured', unnest(string_split(structured, chr(10))), unnest(range(1, len(string_split(structured, chr(10))) + 1)) FROM d),
h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank, line_no) AS place FROM l WHERE contains(line, 'system(') OR contains(line, 'strcpy('))
SELECT doc_id AS address, place, file, line_no, regexp_replace(line, '^\s+|\s+$', '', 'g') AS snippet FROM h WHERE place <= 6""")
def risk_report(spark, sf):
    high = t(spark, sf, "labels").where("toxic = 1").select("doc_id").distinct()
    docs = t(spark, sf, "documents").join(high, "doc_id", "left_semi")
    put = lambda a, b: F.replace(F.coalesce("text", F.lit("")), F.lit(a), F.lit(b))
    return sinks.threat_lines(docs.select(F.col("doc_id").alias("address"), put("the ", "system(").alias("named"), put("idiot", "strcpy(").alias("structured")))


@query("""SELECT role, CAST(sum(length(text)) AS BIGINT) AS used, CASE WHEN sum(length(text)) >= 1000000 THEN CAST(floor(sum(length(text)) / 10000) / 100 AS VARCHAR) || 'M' WHEN sum(length(text)) >= 1000 THEN CAST(floor(sum(length(text)) / 100) / 10 AS VARCHAR) || 'K' ELSE CAST(sum(length(text)) AS VARCHAR) END AS shown FROM conversations GROUP BY role""")
def usage_rollup(spark, sf):
    used = t(spark, sf, "conversations").groupBy("role").agg(F.sum(F.length("text")).alias("used"))
    return used.select("role", "used", usage_text(F.col("used")).alias("shown"))


@query("""WITH s AS (SELECT CASE WHEN quality = 0 THEN 'failed' WHEN toxic = 1 THEN 'skipped' WHEN quality = 1 THEN 'produced' END AS status FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
c AS (SELECT count(*) AS selected, count(*) FILTER (WHERE status = 'produced') AS produced, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'skipped') AS skipped FROM s)
SELECT *, greatest(0, selected - produced - failed - skipped) AS not_run, true AS database_created, selected = produced AND failed = 0 AND skipped = 0 AS full_success FROM c""")
def completeness(spark, sf):
    met = t(spark, sf, "documents").select(F.col("doc_id").alias("address")).join(t(spark, sf, "labels"), F.col("address") == F.col("doc_id"), "left")
    status = F.when(F.col("quality") == 0, "failed").when(F.col("toxic") == 1, "skipped").when(F.col("quality") == 1, "produced")
    return sinks.manifest(met.select("address", status.alias("status")))


@query("SELECT user_id, event_type AS section, arg_max(props, event_id) AS content FROM events GROUP BY 1, 2")
def catalog_merge(spark, sf):
    e = t(spark, sf, "events").select("user_id", F.col("event_type").alias("section"), F.col("props").alias("content"), "event_id")
    return sections.merged(e, ["user_id"], "event_id")


@query("""WITH e AS (SELECT user_id, event_type AS section, arg_max(CASE WHEN event_id % 3 = 0 THEN '{"rule_scan": ' || props || '}' WHEN event_id % 7 = 0 THEN substr(props, 1, 4) ELSE props END, event_id) AS content FROM events GROUP BY 1, 2)
SELECT user_id, section, CASE WHEN json_valid(content) THEN CAST(coalesce(json_extract_string(content, '$.k'), json_extract_string(content, '$.rule_scan.k')) AS BIGINT) END AS k,
       coalesce(CASE WHEN json_valid(content) THEN json_extract_string(content, '$.k') IS NULL END, false) AS fell_back FROM e""")
def catalog_sections(spark, sf):
    wrapped = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"rule_scan": '), "props", F.lit("}"))).when(F.col("event_id") % 7 == 0, F.expr("substr(props, 1, 4)")).otherwise(F.col("props"))
    e = t(spark, sf, "events").select("user_id", F.col("event_type").alias("section"), wrapped.alias("content"), "event_id")
    rows = sections.merged(e, ["user_id"], "event_id").withColumn("v", sections.parsed("content"))
    at = lambda *paths: sections.at(F.col("v"), *paths, kind="long")
    return rows.select("user_id", "section", at("$.k", "$.rule_scan.k").alias("k"), (F.col("v").isNotNull() & at("$.k").isNull()).alias("fell_back"))


@query("""WITH u AS (SELECT role, count(*) AS requests, sum(CASE WHEN role = 'user' THEN length(text) ELSE 0 END) AS input_tokens, sum(CASE WHEN role <> 'user' THEN length(text) ELSE 0 END) AS output_tokens, sum(length(text) // 3) AS cache_read_tokens, sum(length(text) % 5) AS cache_write_tokens FROM conversations GROUP BY role),
v AS (SELECT *, input_tokens + output_tokens + cache_read_tokens + cache_write_tokens AS total FROM u)
SELECT role, CAST(requests AS BIGINT) AS requests, CAST(input_tokens AS BIGINT) AS input_tokens, CAST(output_tokens AS BIGINT) AS output_tokens, CAST(cache_read_tokens AS BIGINT) AS cache_read_tokens, CAST(cache_write_tokens AS BIGINT) AS cache_write_tokens, CAST(total AS BIGINT) AS total,
       CASE WHEN total >= 1000000 THEN CAST(floor(total / 10000) / 100 AS VARCHAR) || 'M' WHEN total >= 1000 THEN CAST(floor(total / 100) / 10 AS VARCHAR) || 'K' ELSE CAST(total AS VARCHAR) END AS shown FROM v""")
def usage_merge(spark, sf):
    n, user = F.length("text"), F.col("role") == "user"
    c = t(spark, sf, "conversations").select(
        "role", "conv_id", F.lit(1).alias("requests"), F.when(user, n).otherwise(0).alias("input_tokens"), F.when(user, 0).otherwise(n).alias("output_tokens"), F.expr("length(text) div 3").alias("cache_read_tokens"), (n % 5).alias("cache_write_tokens")
    )
    return merged_usage(merged_usage(c, ["role", "conv_id"]), ["role"])  # counters of conversations merged into those of roles


@query("""WITH k AS (SELECT o_orderkey, '0x' || upper(printf('%x', o_orderkey * 1000003)) AS raw FROM orders)
SELECT o_orderkey, CASE WHEN length(substr(raw, 3)) >= 8 THEN lower(substr(raw, 3)) ELSE lpad(lower(substr(raw, 3)), 8, '0') END AS address, coalesce(nullif(ltrim(lower(substr(raw, 3)), '0'), ''), '0') AS key, o_orderkey * 1000003 AS number FROM k""")
def addr_normalise(spark, sf):
    raw = t(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("0x"), F.hex(F.col("o_orderkey") * 1000003)).alias("raw"))
    return raw.select("o_orderkey", ad.normalize_address(F.col("raw")).alias("address"), ad.address_key(F.col("raw")).alias("key"), ad.address_number(F.col("raw")).alias("number"))


@query("SELECT event_id, CASE WHEN json_valid(p) THEN CAST(json_extract_string(p, '$.k') AS BIGINT) ELSE -1 END AS k FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN substr(props, 2) ELSE props END AS p FROM events)")
def json_lenient(spark, sf):
    p = F.when(F.col("event_id") % 5 == 0, F.expr("substr(props, 2)")).otherwise(F.col("props"))
    fenced = F.concat(F.lit("```json\n"), p, F.lit("\n```"))
    return t(spark, sf, "events").select("event_id", F.coalesce(st.lenient_json(fenced, "k bigint")["k"], F.lit(-1)).cast("long").alias("k"))


@query("""WITH a AS (SELECT l_suppkey, coalesce(list(DISTINCT l_partkey) FILTER (WHERE l_returnflag <> 'R'), []) AS x, coalesce(list(DISTINCT l_partkey) FILTER (WHERE l_returnflag = 'R'), []) AS y FROM lineitem GROUP BY 1)
SELECT l_suppkey, len(list_intersect(x, y)) AS n_both, len(list_distinct(list_concat(x, y))) AS n_any, len(x) - len(list_intersect(x, y)) AS n_only, len(x) = len(list_intersect(x, y)) AS is_subset FROM a""")
def set_algebra(spark, sf):
    own = t(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.collect_set(F.when(F.col("l_returnflag") != "R", F.col("l_partkey"))).alias("x"), F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))).alias("y")
    )
    return own.select("l_suppkey", *similarity.set_sizes(F.col("x"), F.col("y")))
