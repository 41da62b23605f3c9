"""Near-duplicate vectors by sorted projection passes.

Each pass orders the distinct vectors lexicographically by the signs of many
random projections and compares every vector with a bounded window of its
neighbours, in blocks of matrix products in double precision.  Blocks are cut
by place in the order and hold the window before their first row as well, so
no border hides a pair, whatever the number of partitions.  Pairs that reach
the threshold are united across passes.  Where more vectors share a pass's first
``PREFIX`` signs than a window holds, those of different components are then
compared exactly, tile against tile; so a pass finds each pair that shares
these signs, however dense its surroundings are and however many rows there
are.  Links are counted exactly inside each component, tile against tile; no
partner is capped.

Defined results: vectors that are null, empty, zero, or hold a null or
non-finite component link with nothing and are their own component; vectors of
different lengths do not link; components are taken in the column's own
precision, products in double precision; exact copies are one class whose rows
all link with each other; repeated ids each get a row, and a null id names a
component only if all its members are null; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, lean, table
from .components import connected_components
from .simhash import _Forest

#: Cosine that links, passes, sign bits of a pass, neighbours on either side, vectors in a tile, rows of a block of the order, seed.
COSINE, PASSES, BITS, WINDOW, TILE, BLOCK, SEED = 0.95, 16, 60, 256, 1024, 4096, 5
#: Signs that share a crowded cell (a pair at COSINE shares them in one of PASSES with probability 0.99), vectors in its tiles.
PREFIX, CELL_TILE = 13, 4096


def _rows(column: pa.Array) -> list[np.ndarray]:
    """Each list as a float64 array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    n = np.array([0 if x is None else x for x in pa.compute.list_value_length(column).to_pylist()], np.int64)
    return np.split(flat, np.cumsum(n)[:-1]) if len(n) else []


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _keys(vectors: DataFrame, passes: int) -> DataFrame:
    """``(pass, key, cid, d)``: a row for each pass, the key being the pass's sign bits as a number, ``d`` the vector's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            rows = _rows(b.column(1))
            size = np.array([len(r) for r in rows])
            keys = np.zeros((len(rows), passes), np.int64)
            for d in np.unique(size):
                if d not in planes:
                    planes[d] = np.random.default_rng(SEED + int(d)).standard_normal((d, passes * BITS))
                at = np.flatnonzero(size == d)
                for k in range(0, len(at), 512):
                    x = np.stack([rows[i] for i in at[k : k + 512]])
                    signs = (x @ planes[d] > 0).reshape(len(x), passes, BITS)
                    keys[at[k : k + 512]] = signs @ weights
            listed = pa.FixedSizeListArray.from_arrays(keys.ravel(), passes).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size.astype(np.int32)), listed], ["cid", "d", "keys"])

    keyed = vectors.select("cid", "v").mapInArrow(lean(run), "cid long, d int, keys array<long>")
    return keyed.select(F.posexplode("keys").alias("pass", "key"), "cid", "d")


def _windows(cosine: float, window: int):
    """Links of a block's rows with the ``window`` rows before them."""

    def run(key, batch):
        own = np.asarray(batch.column("own"))
        order = np.argsort(np.asarray(batch.column("place")), kind="stable")
        ids, own = np.asarray(batch.column("cid"))[order], own[order]
        v = _unit(np.stack(_rows(batch.column("v")))[order])  # one block is of one length
        values, at = np.unique(ids, return_inverse=True)
        forest = _Forest(len(values))
        first, step = int(np.argmax(own)), 256
        for k in range(first, len(ids), step):
            lo, hi = max(0, k - window), min(len(ids), k + step)
            i, j = np.nonzero(v[k:hi] @ v[lo:hi].T >= cosine)
            i, j = i + k, j + lo
            ok = (j < i) & (i - j <= window)
            forest.add(at[i[ok]], at[j[ok]])
        a, c = np.array(forest.edges, np.int64).reshape(-1, 2).T
        return pa.table({"a": pa.array(values[a], pa.int64()), "b": pa.array(values[c], pa.int64())})

    return run


def places(keys: DataFrame, scratch: Scratch) -> DataFrame:
    """``(pass, d, cid, place)``: the place of each row in its pass's order, from 0 in each pass and length of vector.

    The sort is a range partitioning; a row's place is its place in its
    partition and the sizes of the partitions before, a row for each of those.
    """
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keys.repartitionByRange(max(16, n), "pass", "d", "key", "cid").sortWithinPartitions("pass", "d", "key", "cid")
    at = F.monotonically_increasing_id()
    ordered = scratch.save(ordered.select("pass", "d", "cid", F.shiftright(at, 33).cast("int").alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("i")))
    sizes = ordered.groupBy("pass", "d", "part").agg(F.min("i").alias("lo"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("pass", "d").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = scratch.save(sizes.select("pass", "d", "part", (F.coalesce(before, F.lit(0)) - F.col("lo")).alias("shift")))
    return ordered.join(F.broadcast(sizes), ["pass", "d", "part"]).select("pass", "d", "cid", (F.col("i") + F.col("shift")).alias("place"))


def links(vectors: DataFrame, scratch: Scratch, cosine: float = COSINE, passes: int = PASSES, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Verified edges ``(a, b)`` that connect what the windows of all passes link, of distinct ``vectors(cid, v)``."""
    block = max(block, window)
    at = places(_keys(vectors, passes), scratch)
    number = F.floor(F.col("place") / block).cast("long")
    also = (F.col("place") % block) >= block - window  # the next block begins with these
    spots = F.filter(F.array(F.struct(number.alias("block"), F.lit(True).alias("own")), F.when(also, F.struct((number + 1).alias("block"), F.lit(False).alias("own")))), lambda x: x.isNotNull())
    dealt = at.withColumn("s", F.explode(spots)).select("pass", "d", "s.block", "s.own", "place", "cid").join(vectors.select("cid", "v"), "cid")
    return dealt.groupBy("pass", "d", "block").applyInArrow(_windows(cosine, window), "a long, b long").distinct()


def _across(cosine: float):
    def run(key, batch):
        ids = [np.asarray(x.values) for x in batch.column("ids").combine_chunks()]
        comps = [np.asarray(x.values) for x in batch.column("comps").combine_chunks()]
        flat = [_unit(np.asarray(x.values).astype(np.float64).reshape(len(i), -1)) for x, i in zip(batch.column("vs").combine_chunks(), ids)]
        values, at = np.unique(np.concatenate(comps), return_inverse=True)
        a, b = at[: len(ids[0])], at[-len(ids[-1]) :]  # one tile meets itself
        forest = _Forest(len(values))
        for k in range(0, len(a), 256):
            near = flat[0][k : k + 256] @ flat[-1].T >= cosine
            near &= forest.root[a[k : k + 256], None] != forest.root[b][None, :]
            i, j = np.nonzero(near)
            forest.add(a[k + i], b[j])
        x, y = np.array(forest.edges, np.int64).reshape(-1, 2).T
        return pa.table({"a": pa.array(values[x], pa.int64()), "b": pa.array(values[y], pa.int64())})

    return run


def crowded_links(vectors: DataFrame, comp: DataFrame, scratch: Scratch, cosine: float = COSINE, passes: int = PASSES, window: int = WINDOW) -> DataFrame:
    """Edges ``(a, b)`` between components ``comp(cid, comp)`` of ``vectors(cid, v)`` that share a crowded cell; exact there.

    A vector that ``comp`` does not list is its own component.
    """
    cells = _keys(vectors, passes).select("cid", "d", "pass", F.shiftright("key", BITS - PREFIX).alias("cell"))
    cells = scratch.save(cells.join(comp, "cid", "left").withColumn("comp", F.coalesce("comp", "cid")))
    n = cells.groupBy("pass", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where((F.col("n") > window) & (F.col("lo") < F.col("hi")))
    n = scratch.save(n.select("pass", "cell", F.ceil(F.col("n") / CELL_TILE).cast("int").alias("tiles")))
    dealt = cells.join(n, ["pass", "cell"]).withColumn("t", F.pmod(F.xxhash64("cid", F.lit(1)), F.col("tiles")).cast("int")).join(vectors, "cid")
    tiles = dealt.groupBy("pass", "cell", "d", "t", "tiles").agg(F.collect_list(F.struct("cid", "comp", "v")).alias("x")).select(
        "pass", "cell", "d", "t", "tiles", F.col("x.cid").alias("ids"), F.col("x.comp").alias("comps"), F.flatten("x.v").alias("vs")
    )
    others = F.sequence(F.lit(0), F.col("tiles") - 1)
    paired = tiles.withColumn("o", F.explode(others)).select("pass", "cell", "d", F.least("t", "o").alias("p"), F.greatest("t", "o").alias("q"), "ids", "comps", "vs")
    out = scratch.save(paired.groupBy("pass", "cell", "d", "p", "q").applyInArrow(_across(cosine), "a long, b long").distinct())
    scratch.drop(cells, n)
    return out


def _count(cosine: float):
    def run(key, batch):
        ids = [np.asarray(x.values) for x in batch.column("ids").combine_chunks()]
        n = [np.asarray(x.values) for x in batch.column("ns").combine_chunks()]
        flat = [np.asarray(x.values).astype(np.float64).reshape(len(i), -1) for x, i in zip(batch.column("vs").combine_chunks(), ids)]
        if len(ids) == 1:
            ids, n, flat, own = ids * 2, n * 2, flat * 2, True
        else:
            own = False
        a, b = _unit(flat[0]), _unit(flat[1])
        near = a @ b.T >= cosine
        if own:
            np.fill_diagonal(near, False)
            cid, got = ids[0], near @ n[1]
        else:
            cid, got = np.concatenate(ids), np.concatenate([near @ n[1], n[0] @ near])
        return pa.table({"cid": pa.array(cid, pa.int64()), "links": pa.array(got.astype(np.int64), pa.int64())})

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE, passes: int = PASSES, window: int = WINDOW) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, a row for each vector."""
    scratch = Scratch(vectors.sparkSession, "vectors")
    kind = "float" if dict(vectors.dtypes)[vec_col] == "array<float>" else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(f"array<{kind}>").alias("v"))
    ok = F.expr("v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    rows = rows.withColumn("v", F.when(F.coalesce(ok, F.lit(False)), F.transform("v", lambda x: x + F.lit(0.0).cast(kind))))
    # exact copies are one class, named by a strong hash of the components
    name = F.md5(F.concat_ws(",", F.transform("v", lambda x: x.cast("string"))).cast("binary"))
    rows = rows.withColumn("h", F.when(F.col("v").isNotNull(), name))
    members = scratch.save(rows.select("vec_id", "h"))
    classes = rows.where("h is not null").groupBy("h").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    classes = scratch.save(classes.withColumn("cid", F.xxhash64("h")))
    edges = scratch.save(links(classes.select("cid", "v"), scratch, cosine, passes, window))
    united = lambda e: scratch.save(connected_components(e, scratch).select(F.col("node").alias("cid"), F.col("component").alias("comp")))
    comp = united(edges)
    more = crowded_links(classes.select("cid", "v"), comp, scratch, cosine, passes, window)
    if not more.isEmpty():
        scratch.drop(comp)
        comp = united(edges.unionByName(more))
    scratch.drop(edges, more)

    inside = scratch.save(classes.join(comp, "cid").select("comp", "cid", "n", "v", "least", F.size("v").alias("d")))
    sizes = inside.groupBy("comp").agg(F.count(F.lit(1)).alias("m"), F.min("least").alias("component_id"))
    sizes = scratch.save(sizes.select("comp", F.ceil(F.col("m") / TILE).cast("int").alias("tiles"), "component_id"))
    # a tile holds about TILE vectors of a component; small components are one tile
    dealt = inside.join(sizes, "comp").withColumn("t", F.pmod(F.xxhash64("cid", F.lit(1)), F.col("tiles")).cast("int"))
    tiles = dealt.groupBy("comp", "t", "tiles").agg(F.collect_list(F.struct("cid", "n", "v")).alias("x")).select(
        "comp", "t", "tiles", F.col("x.cid").alias("ids"), F.col("x.n").alias("ns"), F.flatten("x.v").alias("vs")
    )
    others = F.sequence(F.lit(0), F.col("tiles") - 1)
    paired = tiles.withColumn("o", F.explode(others)).select("comp", F.least("t", "o").alias("p"), F.greatest("t", "o").alias("q"), "t", "ids", "ns", "vs")
    counted = paired.groupBy("comp", "p", "q").applyInArrow(_count(cosine), "cid long, links long").groupBy("cid").agg(F.sum("links").alias("links"))
    named = inside.join(sizes, "comp").select("cid", "component_id").join(counted, "cid")
    told = classes.join(named, "cid", "left").select(
        "h", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component_id", "least").alias("component_id")
    )
    told = scratch.save(told)
    scratch.drop(inside, classes, comp, sizes)
    out = members.join(told, "h", "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
