"""Registries over a stream of proposals, in keyed state: first write wins, and layouts that merge.

What the registry holds of a key is the key's state, kept by the state store
under the query's checkpoint: a micro-batch reads the keys that it has
proposals for and nothing else, however long the stream has run.  Proposals of
a key are taken in order within a micro-batch, and micro-batches in the order
they come, so a stream in any number of batches comes to what a batch comes to
whose proposals are in that order.  A key's proposals of one micro-batch meet in
one task; ``maxFilesPerTrigger`` and the like bound how many those are.

Results go to a file sink, which names the batches that it has written, so a
query that is started again from its checkpoint neither loses nor repeats rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import registry


def first_writes(stream: DataFrame, key: str, values: list[str], order: list[str]) -> DataFrame:
    """The stream with ``status``, as ``operators.registry.first_write_wins`` gives it.

    A key's state is its first values.  Columns travel as text, which every
    atomic type but binary survives, so that nulls among numbers do no harm;
    ``order`` travels as it is, too.
    """
    text = [f"_t{k}" for k in range(len(stream.columns))]
    sort = [f"_o{k}" for k in range(len(order))]
    told = F.to_json(F.struct(*values), {"ignoreNullFields": "false"})
    rows = stream.select(F.col(key).cast("string").alias("_key"), told.alias("_v"), *[F.col(c).alias(s) for c, s in zip(order, sort)], *[F.col(c).cast("string").alias(t) for c, t in zip(stream.columns, text)])

    def judge(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values([*sort, "_v"], kind="stable", na_position="first")
        first = state.get[0] if state.exists else None
        inserted = None
        if first is None:
            first, inserted = rows["_v"].iloc[0], tuple(rows[[*sort, "_v"]].iloc[0])
            state.update((first,))
        at = [tuple(r) for r in rows[[*sort, "_v"]].itertuples(index=False)]
        rows["status"] = ["inserted" if a == inserted else "updated" if a[-1] == first else "conflict" for a in at]
        yield rows[[*text, "status"]]

    schema = T.StructType([*[T.StructField(t, T.StringType()) for t in text], T.StructField("status", T.StringType())])
    state = T.StructType([T.StructField("first", T.StringType())])
    judged = rows.groupBy("_key").applyInPandasWithState(judge, schema, state, "append", GroupStateTimeout.NoTimeout)
    kinds = dict(stream.dtypes)
    return judged.select(*[F.col(t).cast(kinds[c]).alias(c) for c, t in zip(stream.columns, text)], "status")


def _stored(e: registry.Entry) -> str:
    return json.dumps([sorted([o, *f] for o, f in e.at.items()), e.size, e.confidence, e.evidence, e.source])


def _entry(stored: str | None) -> registry.Entry:
    e = registry.Entry()
    if stored is not None:
        at, e.size, e.confidence, e.evidence, e.source = json.loads(stored)
        e.at = {o: (name, kind, size) for o, name, kind, size in at}
    return e


def merged_layouts(stream: DataFrame) -> DataFrame:
    """Each proposal's status and the entry after it, as ``operators.registry.merge_layouts`` gives them; a name's state is its entry."""
    fields = F.to_json(F.col("fields"))
    rows = registry.sound_proposals(stream).withColumns({"fields": fields, "_key": F.coalesce("name", F.lit(""))})
    judged_columns = [x.split()[0] for x in registry.JUDGED.split(", ")]

    def fold(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        entry, out = _entry(state.get[0] if state.exists else None), []
        for r in pd.concat(list(batches)).sort_values("seq", kind="stable").itertuples():
            status = "rejected"
            if r.valid:
                new = {f["offset"]: (f["name"], f["type"], f["size"]) for f in json.loads(r.fields)}
                status = entry.take(new, int(r.size), r.confidence, r.evidence or "", r.source_file or "")
            held = [{"offset": o, "name": n, "type": t, "size": s} for o, (n, t, s) in sorted(entry.at.items())]
            out.append((r.seq, r.name, status, json.dumps(held), len(held), entry.size, entry.confidence, entry.evidence, entry.source))
        state.update((_stored(entry),))
        yield pd.DataFrame(out, columns=judged_columns)

    kinds = T.StructType.fromDDL(registry.JUDGED)
    flat = T.StructType([T.StructField(f.name, T.StringType() if f.name == "fields" else f.dataType) for f in kinds])
    state = T.StructType([T.StructField("entry", T.StringType())])
    judged = rows.groupBy("_key").applyInPandasWithState(fold, flat, state, "append", GroupStateTimeout.NoTimeout)
    return judged.withColumn("fields", F.from_json("fields", kinds["fields"].dataType))


def write(judged: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append all that is there now to ``path/log``, and stop."""
    return judged.writeStream.format("parquet").option("path", f"{path}/log").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def run(stream: DataFrame, path: str, checkpoint: str, key: str, values: list[str], order: list[str]) -> StreamingQuery:
    """``first_writes`` of what is there now, appended to ``path/log``."""
    return write(first_writes(stream, key, values, order), path, checkpoint)


def run_layouts(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """``merged_layouts`` of what is there now, appended to ``path/log``."""
    return write(merged_layouts(stream), path, checkpoint)


def entries(judged: DataFrame, key: str, values: list[str], order: list[str]) -> DataFrame:
    return registry.current_entries(judged, key, values, order)
