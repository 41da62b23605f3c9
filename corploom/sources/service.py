"""A decompiler service as a data source, read in pages that can be taken up again.

The service itself is not here: the option ``client`` names a function
(``module:function``) that is called with the options and returns an object
with ``ready()``, ``count()``, ``list(offset, limit)`` (rows with address, name,
is_external, is_thunk) and ``decompile(address)`` (code, pcode).  A call that
fails in a way that may pass (``PASSING``) is made again after a wait that
doubles; what still fails is a row with the kind of its error, not a lost one.

``fetch`` reads some pages at a time and writes each such step whole, so a run
that dies goes on where it was, and asks for nothing twice that it has.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.addresses import normalize_address
from ..storage import exists
from .sinks import normal_code

SCHEMA = "address string, ghidra_name string, code string, pcode string, kind string, error string, tries int"
#: Functions of a page; seconds between two looks at whether the service is ready, and until it must be.
PAGE, POLL, WAIT = 500, 3.0, 300.0
#: Calls made at most, and seconds before the second one.
TRIES, BACKOFF = 4, 1.0
#: Kinds of error that may pass by themselves.
PASSING = ("unreachable", "blank", "malformed")


class Refused(RuntimeError):
    """The service answered that it can't."""


class Blank(RuntimeError):
    """The service answered nothing."""


def kind_of(error: BaseException) -> str:
    """unreachable, malformed, blank, refused or failed."""
    for kinds, name in (((OSError, TimeoutError, EOFError), "unreachable"), (json.JSONDecodeError, "malformed"), (Blank, "blank"), (Refused, "refused")):
        if isinstance(error, kinds):
            return name
    return "failed"


def answer(text: str, refused: bool = False) -> dict:
    """A reply's JSON; what it says of an error, nothing at all and no JSON are errors of their own kinds.  For clients."""
    if refused:
        raise Refused(text[:300] or "no reason given")
    if not text.strip():
        raise Blank("no content")
    return json.loads(text)


def tried(call: Callable, tries: int = TRIES, wait: float = BACKOFF) -> tuple[object, BaseException | None, int]:
    """The call's result, or its last error, and how often it was made."""
    for n in range(1, tries + 1):
        try:
            return call(), None, n
        except Exception as e:
            if kind_of(e) not in PASSING or n == tries:
                return None, e, n
            time.sleep(wait * 2 ** (n - 1))
    raise ValueError("a call must be made once at least")


def client_of(options: dict[str, str]):
    module, _, function = options["client"].partition(":")
    return getattr(importlib.import_module(module), function)(options)


def wait_until_ready(client, wait: float = WAIT, poll: float = POLL) -> None:
    end = time.time() + wait
    while not client.ready():
        if time.time() > end:
            raise TimeoutError(f"the service is not ready after {wait} s")
        time.sleep(poll)


def ready_client(options: dict[str, str]):
    client = client_of(options)
    wait_until_ready(client, float(options.get("wait", WAIT)), float(options.get("poll", POLL)))
    return client


class Page(InputPartition):
    def __init__(self, offset: int):
        self.offset = offset


class Reader(DataSourceReader):
    """All pages, or those from function ``from`` on and before ``until``."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        first = int(self.options.get("from", 0))
        until = int(self.options["until"]) if "until" in self.options else ready_client(self.options).count()
        return [Page(k) for k in range(first, until, PAGE)] or [Page(until)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        client = client_of(self.options)
        again = {"tries": int(self.options.get("tries", TRIES)), "wait": float(self.options.get("backoff", BACKOFF))}
        rows, error, _ = tried(lambda: client.list(partition.offset, PAGE), **again)
        if error is not None:  # without its list a page has no functions; the step fails as a whole
            raise error
        for row in rows:
            if row.get("is_external") or row.get("is_thunk"):
                continue
            got, error, n = tried(lambda: client.decompile(row["address"]), **again)  # noqa: B023  called at once
            if error is None:
                code, pcode = got
                yield row["address"], row.get("name") or "", code or "", pcode or "", None, None, n
            else:
                yield row["address"], row.get("name") or "", None, None, kind_of(error), f"{type(error).__name__}: {error}", n


class Decompiler(DataSource):
    @classmethod
    def name(cls) -> str:
        return "decompiler"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Reader(dict(self.options))


def _rows(spark: SparkSession, client: str, **options: str) -> DataFrame:
    spark.dataSource.register(Decompiler)
    return spark.read.format("decompiler").options(client=client, **options).load()


def settled(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Functions with a text, one for each address, and the addresses without any: why, and after how many calls.

    Of an address that is there more than once a text counts before an empty
    one, that before a failure, then the least name; an empty text is a failure
    of the kind ``empty``.
    """
    rows = rows.withColumns({"address": normalize_address(F.col("address")), "code": normal_code(F.coalesce("code", F.lit("")))}).where("address <> ''")
    worth = F.when(F.col("code") != "", 0).when(F.col("error").isNull(), 1).otherwise(2).alias("worth")
    one = rows.groupBy("address").agg(F.min(F.struct(worth, "ghidra_name", "code", "pcode", "kind", "error", "tries")).alias("r")).select("address", "r.*")
    name = F.coalesce(F.nullif("ghidra_name", F.lit("")), F.concat(F.lit("FUN_"), "address")).alias("ghidra_name")
    lost = one.where("worth > 0").select("address", name, F.coalesce("kind", F.lit("empty")).alias("kind"), F.coalesce("error", F.lit("no text")).alias("error"), "tries")
    return one.where("worth = 0").select("address", name, "code", "pcode"), lost


def read_service(spark: SparkSession, client: str, **options: str) -> tuple[DataFrame, DataFrame]:
    """``settled`` rows of the whole service, asked for as they are read."""
    return settled(_rows(spark, client, **options))


def fetch(spark: SparkSession, client: str, path: str, pages: int = 16, **options: str) -> tuple[DataFrame, DataFrame]:
    """``settled`` rows of the whole service, written under ``path`` in steps of so many pages.

    A step that has been written whole is not asked for again; a run that
    failed leaves its steps to the next one.  Failures that may pass are asked
    for again by deleting their step.
    """
    total = ready_client({"client": client, **options}).count()
    step = pages * PAGE
    steps = [f"{path}/from={k}" for k in range(0, total, step)]
    for k, place in zip(range(0, total, step), steps):
        if not exists(spark, f"{place}/_SUCCESS"):
            _rows(spark, client, **{**options, "from": str(k), "until": str(min(total, k + step))}).write.mode("overwrite").parquet(place)
    rows = spark.read.schema(SCHEMA).parquet(*steps) if steps else spark.createDataFrame([], SCHEMA)
    return settled(rows)
