"""The lexer's questions as table functions, to be asked in SQL of any text column: ``SELECT … FROM f, LATERAL accesses(address, name, code)``."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import lexer
from . import evidence, facts, validation

#: Name, rows of a text, their schema.  Null texts have no rows.
FUNCTIONS: dict[str, tuple[Callable[..., Iterable[tuple]], str]] = {
    "accesses": (lambda address, name, code: evidence.facts_of(address, name or f"FUN_{address}", code), evidence.SCHEMA),
    "arguments": (lambda code: facts.arguments_of(code), facts.ARGUMENTS),
    "member_uses": (lambda code: validation.uses_of(code), validation.USES.partition(", ")[2]),
    "value_uses": (lambda code: lexer.value_uses(lexer.without_literals(code)), "site int, role string, node string, name string, place int"),
    "parameter_names": (lambda code: [(k, n) for k, n in enumerate(lexer.parameter_names(lexer.without_literals(code)))], "place int, name string"),
}


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Register all of them, each under its name with a prefix; returns the names.  The text is each one's last argument."""

    def table(make: Callable[..., Iterable[tuple]], ddl: str):
        class Rows:
            def eval(self, *values) -> Iterator[tuple]:
                if values[-1] is not None:
                    yield from make(*values)

        return F.udtf(Rows, returnType=ddl, useArrow=True)

    for name, (make, ddl) in FUNCTIONS.items():
        spark.udtf.register(prefix + name, table(make, ddl))
    return [prefix + n for n in FUNCTIONS]
