"""Call-graph operators: edges, degrees, layers, closure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.addresses import normalize_address
from ..storage import Scratch

_CALL = r"(?<![A-Za-z0-9_])([A-Za-z_][A-Za-z0-9_]*)\s*\("


def _first_of_name(functions: DataFrame, last: bool = False) -> DataFrame:
    pick = F.max("address") if last else F.min("address")
    return functions.where("ghidra_name <> ''").groupBy(F.col("ghidra_name").alias("callee_name")).agg(pick.alias("callee"))


def called_names(text: Column) -> Column:
    """Names before a bracket, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(_CALL), F.lit(1)))


def call_edges(functions: DataFrame, by_name: bool = False) -> DataFrame:
    """``caller, callee, callee_name`` of ``name(`` mentions, self-calls apart; a name means the least address that bears it.

    Every text is cut into called names once; names meet the functions in a
    sort-merge join: Spark's sizes of cut-up text are far too low, and a
    broadcast of it would outgrow the driver.  Comments count, as the tool that this serves reads them.  With
    ``by_name``, as callers are counted, a mention of the caller's own name is a
    self-call whatever address it means.
    """
    called = functions.select(F.col("address").alias("caller"), F.col("ghidra_name").alias("_own"), F.explode(called_names(F.col("code"))).alias("callee_name"))
    apart = F.col("callee_name") != F.col("_own") if by_name else F.col("callee") != F.col("caller")
    return called.join(_first_of_name(functions).hint("merge"), "callee_name").where(apart).select("caller", "callee", "callee_name").distinct()


def placeholder_edges(functions: DataFrame) -> DataFrame:
    """``caller, callee`` of FUN_<hex> mentions of known addresses."""
    hexes = F.array_distinct(F.regexp_extract_all("code", F.lit(r"\bFUN_([0-9a-fA-F]+)\b"), F.lit(1)))
    found = functions.select(F.col("address").alias("caller"), F.explode(hexes).alias("hex"))
    known = functions.select(F.col("address").alias("callee"))
    return found.select("caller", normalize_address(F.col("hex")).alias("callee")).join(known.hint("merge"), "callee").where("caller <> callee").select("caller", "callee").distinct()


def order_edges(functions: DataFrame) -> DataFrame:
    """``src, dst`` as layers are built from: placeholder mentions and called names together.

    Placeholder names count by their address only; of several functions with
    one other name the greatest address is meant; empty names mean none.
    """
    named = functions.where(~F.startswith("ghidra_name", F.lit("FUN_")))
    called = functions.select(F.col("address").alias("caller"), F.explode(called_names(F.col("code"))).alias("callee_name"))
    by_name = called.join(_first_of_name(named, last=True).hint("merge"), "callee_name").where("caller <> callee").select("caller", "callee")
    return placeholder_edges(functions).unionByName(by_name).distinct().select(F.col("caller").alias("src"), F.col("callee").alias("dst"))


def node(functions: DataFrame, key: str) -> DataFrame:
    """The function of an address in any spelling, or of a name."""
    from ..functions.addresses import address_key

    by_address = address_key(F.col("address")) == address_key(F.lit(key))
    return functions.where(by_address | (F.col("ghidra_name") == key))


def degrees(nodes: DataFrame, node: str, edges: DataFrame) -> DataFrame:
    """``node, callers, callees``, zeros included."""
    ins = edges.groupBy(F.col("dst").alias(node)).agg(F.count_distinct("src").alias("callers"))
    outs = edges.groupBy(F.col("src").alias(node)).agg(F.count_distinct("dst").alias("callees"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return nodes.join(ins, node, "left").join(outs, node, "left").select(node, zero("callers"), zero("callees"))


def layers(nodes: DataFrame, node: str, edges: DataFrame) -> DataFrame:
    """Leaf-first layers: ``node, depth, is_cycle``; depth is null for cycles and all that depend on them.

    Each round places the nodes whose callees have all been placed: those that
    lost an edge and have none left.  One round is one written table that holds
    the edges left and the nodes placed, so plans stay short, lost executors
    harm nothing, and work shrinks with the edges.
    """
    scratch = Scratch(nodes.sparkSession, "layers")
    spark = nodes.sparkSession
    every = nodes.select(F.col(node).alias("n")).distinct()
    kind = every.schema["n"].dataType.simpleString()
    schema = f"src {kind}, dst {kind}, depth int, edge boolean"
    inner = edges.where("src <> dst").select("src", "dst").distinct()
    inner = inner.join(every.withColumnRenamed("n", "src"), "src", "left_semi").join(every.withColumnRenamed("n", "dst"), "dst", "left_semi").select("src", "dst")
    inner = scratch.save(inner)
    every = scratch.save(every)

    def write(left: DataFrame, ready: DataFrame, depth: int) -> str:
        path = scratch.path()
        placed = ready.select(F.col("n").alias("src"), F.lit(None).cast(kind).alias("dst"), F.lit(depth).alias("depth"), F.lit(False).alias("edge"))
        kept = left.select("src", "dst", F.lit(None).cast("int").alias("depth"), F.lit(True).alias("edge"))
        kept.unionByName(placed).write.partitionBy("edge").option("compression", "zstd").parquet(path)
        return path

    paths = [write(inner, every.join(inner, every["n"] == inner["src"], "left_anti"), 0)]
    while True:
        table = spark.read.schema(schema).parquet(paths[-1])
        left, ready = table.where("edge").select("src", "dst"), table.where("not edge").select(F.col("src").alias("n"))
        if ready.isEmpty():
            break
        marked = left.join(ready.select(F.col("n").alias("dst"), F.lit(True).alias("gone")), "dst", "left").select("src", "dst", F.col("gone").isNotNull().alias("gone"))
        free = marked.groupBy("src").agg(F.bool_and("gone").alias("free")).where("free").select(F.col("src").alias("n"))
        paths.append(write(marked.where("not gone"), free, len(paths)))
    done = [f"{p}/edge=false" for p in paths[:-1]]  # the last round placed nothing
    out = every.withColumn("depth", F.lit(None).cast("int"))
    if done:
        placed = spark.read.schema(f"src {kind}, dst {kind}, depth int").parquet(*done)
        out = every.join(placed.select(F.col("src").alias("n"), "depth"), "n", "left")
    return out.select(F.col("n").alias(node), "depth", F.col("depth").isNull().alias("is_cycle"))


def layer_places(layered: DataFrame, node: str) -> DataFrame:
    """``place`` and ``size`` within the layer, and a label like d2 1/7, or cycle 1/7 for what has no layer."""
    w = Window.partitionBy("depth")
    got = layered.withColumn("place", F.row_number().over(w.orderBy(node))).withColumn("size", F.count(F.lit(1)).over(w))
    prefix = F.when(F.col("is_cycle"), "cycle").otherwise(F.concat(F.lit("d"), F.col("depth").cast("string")))
    return got.withColumn("label", F.format_string("%s %d/%d", prefix, "place", "size"))


def plan_summary(layered: DataFrame) -> DataFrame:
    """One row: d0:12 d1:3 and so on, and the number without a layer."""
    sizes = layered.groupBy("depth").agg(F.count(F.lit(1)).alias("n"))  # one row a layer
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("depth").isNotNull(), F.struct("depth", "n")))), lambda x: F.format_string("d%d:%d", x["depth"], x["n"])), " ")
    cycles = F.coalesce(F.sum(F.when(F.col("depth").isNull(), F.col("n"))), F.lit(0))
    return sizes.agg(text.alias("layers"), cycles.alias("cycles"))


def reaches(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """``node``: every node with a path, of no edges or more, to a target; semi-naive, one join a round, each round's nodes written once."""
    scratch = Scratch(edges.sparkSession, "closure")
    spark = edges.sparkSession
    back = scratch.save(edges.select("src", "dst").distinct())
    new = targets.select("node").distinct()
    schema = new.schema
    paths: list[str] = []
    while True:
        path = scratch.path()
        new.write.option("compression", "zstd").parquet(path)
        front = spark.read.schema(schema).parquet(path)
        if front.isEmpty():
            break
        paths.append(path)
        step = back.join(front, back["dst"] == front["node"], "left_semi").select(F.col("src").alias("node")).distinct()
        new = step.join(spark.read.schema(schema).parquet(*paths), "node", "left_anti")
    return spark.read.schema(schema).parquet(*(paths or [path]))


def calls_between(calls: DataFrame, callers: DataFrame, callees: DataFrame, names: list[str]) -> DataFrame:
    """Calls whose callee has one of the names, with both ends' names."""
    wanted = callees.where(F.col("callee_name").isin(*names))
    return calls.join(wanted, "callee").join(callers, "caller")


def argument_steps(functions: DataFrame) -> DataFrame:
    """``src, dst``: from each argument of a call to the others of that call, as variables of their function (``address/name``)."""
    from .evidence import plain_arguments

    args = plain_arguments(functions).select("address", "place", F.concat_ws("/", "address", "base").alias("v"))
    a, b = args.withColumnRenamed("v", "src"), args.withColumnRenamed("v", "dst")
    return a.join(b, ["address", "place"]).where("src <> dst").select("src", "dst").distinct()


def parameter_sources(functions: DataFrame, names: list[str]) -> DataFrame:
    """``node``: the parameters (``address/name``) of the functions with one of the names."""
    from ..functions.source_text import definition

    wanted = functions.where(F.col("ghidra_name").isin(*names))
    params = wanted.select("address", F.explode(definition(F.col("code"))["params"]).alias("p"))
    return params.select(F.concat_ws("/", "address", F.regexp_extract("p", r"([A-Za-z_]\w*)\s*(?:\[[^\]]*\])?$", 1)).alias("node")).distinct()


def flows(edges: DataFrame, sources: DataFrame, sinks: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """``node``: sources from which some sink can be reached over ``edges(src, dst)`` and ``extra`` steps.

    Reachability, an approximation of data flow: it knows no calling context
    and no values.
    """
    steps = edges.select("src", "dst")
    if extra is not None:
        steps = steps.unionByName(extra.select("src", "dst"))
    return reaches(steps, sinks).join(sources.select("node").distinct(), "node", "left_semi")


def handlers(functions: DataFrame, edges: DataFrame, sinks: DataFrame, name_pattern: str, type_pattern: str) -> DataFrame:
    """``address, name``: functions whose name and first parameter match wholly and that reach a sink."""
    from ..functions.source_text import definition

    first = F.try_element_at(definition(F.col("code"))["params"], F.lit(1))
    fit = functions.where(F.rlike("name", F.lit(f"^(?:{name_pattern})$")) & F.coalesce(F.rlike(first, F.lit(f"^(?:{type_pattern})$")), F.lit(False)))
    return fit.join(reaches(edges, sinks).withColumnRenamed("node", "address"), "address", "left_semi").select("address", "name")
