"""Data flow through calls: matched calls and returns, fields, and the path that shows it.

A flow graph is ``src, dst, kind, site``.  A ``step`` stays within a function;
a ``call`` at a site enters one and a ``return`` of a site leaves it again, to
the site that was entered last.  A flow may return from functions that it was
never seen to enter, then call, but a call and the return that closes it have
one site, so what enters a function at one place does not come out at another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexer
from ..functions.batches import by_text
from ..storage import Scratch

STEP, CALL, RETURN = "step", "call", "return"
#: Rows that a join may send to all tasks.
FEW = 50_000


def _joined(df: DataFrame) -> DataFrame:
    """The side of a join that counts: sent to all tasks if its table has few rows, else sorted and merged.

    Spark goes by bytes on disk, and tables of sorted keys are far larger in memory.
    """
    return df.hint("broadcast" if df.count() <= FEW else "merge")


def _columns(edges: DataFrame) -> DataFrame:
    site = F.col("site") if "site" in edges.columns else F.lit(None).cast("string")
    return edges.select("src", "dst", F.coalesce("kind", F.lit(STEP)).alias("kind"), site.cast("string").alias("site")).distinct()


class _Grown:
    """Rows that are added round by round, each round a table; read as one."""

    def __init__(self, scratch: Scratch, schema):
        self.scratch, self.schema, self.paths = scratch, schema, []

    def add(self, df: DataFrame) -> DataFrame:
        path = self.scratch.path()
        df.write.option("compression", "zstd").parquet(path)
        self.paths.append(path)
        return self.scratch.spark.read.schema(self.schema).parquet(path)

    def all(self, but: int = 0) -> DataFrame:
        paths = self.paths[: len(self.paths) - but]
        return self.scratch.spark.read.schema(self.schema).parquet(*paths) if paths else self.scratch.spark.createDataFrame([], self.schema)


def summaries(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``src, dst``: what a whole call does, from where a value enters at a site to where it comes back at that site; a fixpoint.

    For each entry of a function the places that it reaches within balanced
    calls are kept, ``(entry, node)``; where one of them returns, the sites
    that both entered there and are returned to become steps, which may let
    other entries reach further.  Semi-naive: a round joins only what the last
    one added, with the old rows and the other way round.
    """
    edges = scratch.save(_columns(edges))
    calls, returns = edges.where(F.col("kind") == CALL), edges.where(F.col("kind") == RETURN)
    enters = scratch.save(calls.select("site", F.col("src").alias("a"), F.col("dst").alias("entry")).distinct())
    leaves = scratch.save(returns.select("site", F.col("src").alias("node"), F.col("dst").alias("b")).distinct())
    # a value that enters at a site and comes back at it: the entry, where it leaves, and what that is worth
    round_trips = scratch.save(enters.join(leaves, "site").select("entry", "node", "a", "b").distinct())
    steps = edges.where(F.col("kind") == STEP).select("src", "dst")
    kind = edges.schema["src"].dataType.simpleString()
    reached, short = _Grown(scratch, f"entry {kind}, node {kind}"), _Grown(scratch, f"src {kind}, dst {kind}")
    entries = round_trips.select("entry").distinct()
    new = reached.add(entries.select("entry", F.col("entry").alias("node")))
    fresh = short.add(scratch.spark.createDataFrame([], short.schema))
    while True:
        over = lambda pairs, way: pairs.join(way, pairs["node"] == way["src"]).select("entry", F.col("dst").alias("node"))
        on = over(new, steps).unionByName(over(new, short.all())).unionByName(over(reached.all(but=1), fresh)).distinct()
        added = on.join(reached.all(), ["entry", "node"], "left_anti")
        found = new.join(round_trips, ["entry", "node"]).select(F.col("a").alias("src"), F.col("b").alias("dst")).where("src <> dst").distinct()
        fresh = short.add(found.join(short.all(), ["src", "dst"], "left_anti"))
        new = reached.add(added)
        if new.isEmpty() and fresh.isEmpty():
            return short.all()


def matched(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``src, dst, kind``, nodes with a phase, ``struct<node, entered>``: over these plain reachability is reachability over matched calls.

    While nothing has been entered a flow may return; once it has entered a
    function without coming back it may only call.
    """
    edges = scratch.save(_columns(edges))
    whole = summaries(edges, scratch).select("src", "dst", F.lit("through").alias("kind"))
    at = lambda c, entered: F.struct(F.col(c).alias("node"), F.lit(entered).alias("entered")).alias(c)
    way = lambda df, a, b: df.select(at("src", a), at("dst", b), "kind")
    plain = edges.where(F.col("kind") == STEP).select("src", "dst", "kind").unionByName(whole)
    calls, returns = edges.where(F.col("kind") == CALL), edges.where(F.col("kind") == RETURN)
    return way(plain, False, False).unionByName(way(plain, True, True)).unionByName(way(returns, False, False)).unionByName(way(calls, False, True)).unionByName(way(calls, True, True)).distinct()


def nearest(edges: DataFrame, sinks: DataFrame) -> DataFrame:
    """``node, sink, length, next, kind``: of every node that reaches a sink the least number of edges to one, and the first edge of such a path.

    Of sinks equally near the least is meant, of edges to it the one to the
    least node.  One row a node, found backwards from the sinks, a round for
    each length; ``next`` is null at the sink itself.
    """
    scratch = Scratch(edges.sparkSession, "nearest")
    back = scratch.save((edges if "kind" in edges.columns else edges.withColumn("kind", F.lit(STEP))).select("src", "dst", "kind").distinct())
    kind = back.schema["src"].dataType.simpleString()
    known = _Grown(scratch, f"node {kind}, sink {kind}, length int, next {kind}, kind string")
    front = known.add(sinks.select("node", F.col("node").alias("sink"), F.lit(0).alias("length"), F.lit(None).cast(kind).alias("next"), F.lit(None).cast("string").alias("kind")).distinct())
    length = 0
    while not front.isEmpty():
        length += 1
        met = back.join(_joined(front.select(F.col("node").alias("dst"), "sink")), "dst")
        best = met.groupBy(F.col("src").alias("node")).agg(F.min(F.struct("sink", F.col("dst").alias("next"), "kind")).alias("x"))
        new = best.join(_joined(known.all().select("node")), "node", "left_anti")
        front = known.add(new.select("node", "x.sink", F.lit(length).alias("length"), "x.next", "x.kind"))
    return known.all(but=1) if len(known.paths) > 1 else known.all()


def witnesses(edges: DataFrame, sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """``source, sink, length, path, kinds`` of every source that reaches a sink: the nodes of a shortest path in order, and its edges' kinds.

    Paths are read off ``nearest``'s rows, a join for each further node, all
    sources at a time; those that have arrived leave.
    """
    scratch = Scratch(edges.sparkSession, "witness")
    far = scratch.save(nearest(edges, sinks))
    node = far.schema["node"].dataType.simpleString()
    walk = sources.select("node").distinct().join(far.hint("merge"), "node").select(F.col("node").alias("source"), "sink", "length", F.array("node").alias("path"), F.array().cast("array<string>").alias("kinds"), "next", "kind")
    done = _Grown(scratch, f"source {node}, sink {node}, length int, path array<{node}>, kinds array<string>")
    walk = scratch.save(walk)
    while True:
        done.add(walk.where("next is null").select("source", "sink", "length", "path", "kinds"))
        open_ = walk.where("next is not null")
        if open_.isEmpty():
            return done.all()
        ahead = far.select(F.col("node").alias("_n"), F.col("next").alias("_next"), F.col("kind").alias("_kind"))
        met = _joined(open_).join(ahead, open_["next"] == ahead["_n"])
        walk = scratch.save(met.select("source", "sink", "length", F.concat("path", F.array("next")).alias("path"), F.concat("kinds", F.array("kind")).alias("kinds"), F.col("_next").alias("next"), F.col("_kind").alias("kind")))


def matched_witnesses(edges: DataFrame, sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """``witnesses`` over matched calls; a step of kind ``through`` is a call and its return."""
    scratch = Scratch(edges.sparkSession, "matched")
    way = scratch.save(matched(edges, scratch))
    at = lambda df, *entered: df.select(F.explode(F.array(*[F.struct("node", F.lit(e).alias("entered")) for e in entered])).alias("node"))
    got = witnesses(way, at(sources, False), at(sinks, False, True))
    return got.select("source.node", "sink.node", "length", F.transform("path", lambda x: x["node"]).alias("path"), "kinds").toDF("source", "sink", "length", "path", "kinds")


# the flow graph of C-like text


def value_steps(functions: DataFrame) -> DataFrame:
    """``address, site, role, node, name, place``: what calls, assignments, fields and returns say of values, one scan of each text.

    Roles: ``argument`` ``place`` of the call ``site`` to ``name``; ``result``,
    the variable that a call's value is assigned to; ``copy``, a variable
    (``node``) whose value goes into another (``name``); ``field``, a use of a
    member (``node``, as ``base.member``) of a variable (``name``);
    ``returned``, a variable that a return names; ``parameter`` ``place``.
    """
    make = lambda a, c: [(a, *x) for x in lexer.value_uses(lexer.without_literals(c or ""))]
    return by_text(functions, ["address", "code"], "code", make, "address string, site int, role string, node string, name string, place int")


def flow_graph(functions: DataFrame, scratch: Scratch) -> DataFrame:
    """``src, dst, kind, site`` of ``functions(address, ghidra_name, code)``; nodes are ``address/variable`` and ``address/base.member``.

    Arguments flow to parameters and, since a callee may write through them,
    back; a callee's returned variables to the variable that takes the call's
    value.  Of functions that are not there any argument may flow to the others
    of that call and to its result.  A variable flows to its members' uses.
    """
    uses = scratch.save(value_steps(functions))
    node = lambda c: F.concat_ws("/", "address", c)
    own = lambda role: uses.where(F.col("role") == role)
    step = lambda df: df.select("src", "dst", F.lit(STEP).alias("kind"), F.lit(None).cast("string").alias("site"))
    site = F.concat_ws("#", "address", F.col("site").cast("string")).alias("site")
    copies = own("copy").select(node("node").alias("src"), node("name").alias("dst"))
    fields = own("field").select(node("name").alias("src"), node("node").alias("dst"))
    args = own("argument").select(site, "name", "place", node("node").alias("v"))
    results = own("result").select(site, "name", node("node").alias("v"))
    first = functions.where("ghidra_name <> ''").groupBy(F.col("ghidra_name").alias("name")).agg(F.min("address").alias("callee"))
    params = own("parameter").select(F.col("address").alias("callee"), "place", node("node").alias("p"))
    returned = own("returned").select(F.col("address").alias("callee"), node("node").alias("p"))
    met = scratch.save(args.join(first, "name").join(params, ["callee", "place"]).select("site", "v", "p"))
    calls = met.select(F.col("v").alias("src"), F.col("p").alias("dst"), F.lit(CALL).alias("kind"), "site")
    back = met.select(F.col("p").alias("src"), F.col("v").alias("dst"), F.lit(RETURN).alias("kind"), "site")
    values = results.join(first, "name").join(returned, "callee").select(F.col("p").alias("src"), F.col("v").alias("dst"), F.lit(RETURN).alias("kind"), "site")
    unknown = args.join(first, "name", "left_anti").select("site", "v")
    to = unknown.unionByName(results.join(first, "name", "left_anti").select("site", "v")).withColumnRenamed("v", "dst")
    beside = unknown.withColumnRenamed("v", "src").join(to, "site")
    inner = step(copies.unionByName(fields).unionByName(beside.select("src", "dst")).where("src <> dst"))
    return scratch.save(inner.unionByName(calls).unionByName(back).unionByName(values).distinct())


def call_arguments(functions: DataFrame, names: list[str], place: int | None = None) -> DataFrame:
    """``node``: what calls of the named functions are given, at one place or any."""
    uses = value_steps(functions).where((F.col("role") == "argument") & F.col("name").isin(*names))
    uses = uses if place is None else uses.where(F.col("place") == place)
    return uses.select(F.concat_ws("/", "address", "node").alias("node")).distinct()
