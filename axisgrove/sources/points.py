"""Points as rows: (point_id bigint, coords array<double>)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def points(df: DataFrame, id_col: str, coords: str | Sequence[str], name: str = "point_id", float32: bool = False) -> DataFrame:
    """The id and coordinates of df. coords is an array column or a list of numeric columns; float32 rounds
    coordinates to single precision first."""
    if isinstance(coords, str):
        if not isinstance(df.schema[coords].dataType, T.ArrayType):
            coords = [coords]
        else:
            array = F.col(coords).cast("array<float>").cast("array<double>") if float32 else F.col(coords).cast("array<double>")
            return df.select(F.col(id_col).cast("bigint").alias(name), array.alias("coords"))
    cols = [F.col(c).cast("float").cast("double") if float32 else F.col(c).cast("double") for c in coords]
    return df.select(F.col(id_col).cast("bigint").alias(name), F.array(*cols).alias("coords"))


def valid(coords: str = "coords"):
    """Whether all coordinates are there and finite."""
    c = F.col(coords)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(c.isNotNull() & (F.size(c) > 0) & finite, F.lit(False))


def dimensions(df: DataFrame) -> int:
    row = df.agg(F.max(F.size("coords")).alias("d")).first()
    return row["d"] if row["d"] is not None and row["d"] > 0 else 0


def validated(df: DataFrame, dims: int | None = None, on_invalid: str = "raise") -> DataFrame:
    """Rows with null, NaN or infinite coordinates, or another number of axes, raise when they are read, or are
    dropped (on_invalid="drop")."""
    if on_invalid not in ("raise", "drop"):
        raise ValueError(f"on_invalid: {on_invalid!r}")
    good = valid() if dims is None else valid() & (F.size("coords") == dims)
    if on_invalid == "drop":
        return df.where(good)
    checked = F.when(good, F.col("coords")).otherwise(F.raise_error(F.lit("dimensions mismatch or coordinate that is null, NaN or infinite")).cast("array<double>"))
    return df.select(*(c for c in df.columns if c != "coords"), checked.alias("coords"))


def distinct_points(df: DataFrame) -> DataFrame:
    """One row for each coordinate tuple: that of the lowest id. (-0.0 and 0.0 are one coordinate.)"""
    plus = F.transform("coords", lambda x: x + F.lit(0.0))
    return df.groupBy(plus.alias("coords")).agg(F.min("point_id").alias("point_id")).select("point_id", "coords")
