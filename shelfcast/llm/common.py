"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Word characters of the size and quality contracts: everything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
# Word characters of the decontamination and license contracts, on text whose
# case is not folded yet (A-Z fold to a-z, so both belong to words).
ALNUM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
NOT_ALNUM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once.

    Catalyst may inline a projected column into each use; a lambda variable
    cannot be inlined, so an array used in many places is built only once.
    """
    return F.transform(F.array(value), body)[0]


def spans_digest(spans: Iterable[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


# Largest table (bytes, measured) that is shipped whole to every task.
BROADCAST_BYTES = 64 * 1024 * 1024


def near(table: DataFrame, row_bytes: Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``table`` marked for broadcast if the sum of ``row_bytes`` allows it, else unchanged (a shuffled join)."""
    measured = table.agg(F.sum(row_bytes)).first()[0] or 0
    return F.broadcast(table) if measured <= limit else table


def sample_by_hash(rows: DataFrame, columns: list[str], n: int) -> DataFrame:
    """At most ``n`` of the distinct ``rows``, those of the smallest hash of ``columns``.

    The rows are counted first and only hashes below a bound that lets some
    ``4 n`` rows through are sorted, so what meets in one place does not grow
    with the table.
    """
    ticket = F.xxhash64(*columns)
    total = rows.count()
    if total > 4 * n:
        rows = rows.where(ticket < -2 ** 63 + int(4 * n / total * 2 ** 64))
    return rows.orderBy(ticket, *columns).limit(n)
