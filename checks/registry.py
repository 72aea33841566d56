"""Registry of checked queries: a Spark callable and, where SQL can say it, its SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.fixture import Tables, with_ctes

DIGITS = 6


@dataclass
class Check:
    run: Callable[[Tables], DataFrame]
    sql: str | None
    doubles: Sequence[str]
    ctes: dict[str, str] | None

    def spark(self, spark: SparkSession, folder: str) -> DataFrame:
        return settle(self.run(Tables(spark, folder)))

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        final = f"SELECT * FROM ({self.sql})"
        if self.doubles:
            rounded = ", ".join(f"round({c}::DOUBLE, {DIGITS}) + 0.0 AS {c}" for c in self.doubles)
            final = f"SELECT * REPLACE ({rounded}) FROM ({self.sql})"
        return with_ctes(final, self.ctes)


CHECKS: dict[str, Check] = {}


def check(name: str, sql: str | None = None, doubles: Sequence[str] = (), ctes: dict[str, str] | None = None):
    def wrap(run: Callable[[Tables], DataFrame]):
        if name in CHECKS:
            raise ValueError(f"query registered twice: {name}")
        CHECKS[name] = Check(run, sql, doubles, ctes)
        return run

    return wrap


def settle(df: DataFrame) -> DataFrame:
    """Doubles rounded so that summation order cannot show."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({n: F.round(F.col(n).cast("double"), DIGITS) + F.lit(0.0) for n in names})
