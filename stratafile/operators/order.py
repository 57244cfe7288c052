"""Numbers and running sums over a total order, for results of any size.

A window without partitions puts all rows into one task. Up to ONE_TASK rows that is the cheapest plan. Beyond it rows are dealt out by ranges of the whole order (Spark samples it for
the bounds), about PIECE rows a range, and written in that order; a row's place in its range is known from there, the ranges' counts and sums are added up, one row a
range, and go back to the rows. Rows with equal keys part by the ties, then by a hash of all their columns, so that a key of any number of rows spans as many ranges as it takes;
only rows that are equal in every column stay together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from ..scratch import few, written

ONE_TASK = 1_000_000
PIECE = 500_000
#: monotonically_increasing_id holds the partition above these bits, and the row's place in it below.
PLACE_BITS = 33


def in_pieces(rows: DataFrame, order: list[Column], pieces: int) -> DataFrame:
    """rows as a written table in the total order, with _piece and _place (from 0 in the piece)."""
    plain = [c.name for c in rows.schema if not isinstance(c.dataType, MapType)]
    last = F.xxhash64(*[F.col(f"`{c}`") for c in plain])
    dealt = rows.repartitionByRange(pieces, *order, last).sortWithinPartitions(*order, last).withColumn("_at", F.monotonically_increasing_id())
    kept = written(dealt, "ordered")
    return kept.withColumns({"_piece": F.shiftright("_at", PLACE_BITS), "_place": F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))}).drop("_at")


def _starts(parts: DataFrame, names: list[str]) -> DataFrame:
    """(_piece, _o_<name>...): the sums of the pieces before; parts has a row for each piece."""
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    return written(parts.select("_piece", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in names]), "order-starts")


def numbered(rows: DataFrame, order: list[Column], name: str, pieces: int | None = None) -> DataFrame:
    """rows numbered from 0 in the order. pieces: as many tasks whatever the number of rows; else one up to ONE_TASK rows and one for each PIECE rows beyond."""
    n = rows.count() if pieces is None else 0
    if pieces is None and n <= ONE_TASK:
        return rows.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
    kept = in_pieces(rows, order, pieces or n // PIECE + 1)
    starts = _starts(kept.groupBy("_piece").agg(F.count("*").alias("_t_n")), ["n"])
    return kept.join(few(starts), "_piece").withColumn(name, F.col("_o_n") + F.col("_place")).drop("_piece", "_place", "_o_n")


def with_running(rows: DataFrame, key: str, sums: dict[str, Column], ties: list[str] | None = None) -> DataFrame:
    """Adds, for each (name, value) of sums, the sum of value over the rows up to and with this one in the order of key, then ties."""
    order = [F.col(c) for c in (key, *(ties or []))]
    n = rows.count()
    if n <= ONE_TASK:
        over = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return rows.withColumns({k: F.sum(v).over(over) for k, v in sums.items()})
    kept = in_pieces(rows, order, n // PIECE + 1)
    starts = _starts(kept.groupBy("_piece").agg(*[F.sum(v).alias(f"_t_{k}") for k, v in sums.items()]), [*sums])
    inside = Window.partitionBy("_piece").orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = kept.join(few(starts), "_piece")
    return out.withColumns({k: F.col(f"_o_{k}") + F.sum(v).over(inside) for k, v in sums.items()}).drop("_piece", "_place", *[f"_o_{k}" for k in sums])
