"""Totals, weighted means, shares and overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def global_totals(df: DataFrame, measures: list[str], country: str | None = "country_code") -> DataFrame:
    """A1: the sum of each measure in one row, and in millions; with ``country`` only rows that have one."""
    rows = df.filter(F.coalesce(F.col(country) > 0, F.lit(False))) if country else df
    return rows.agg(*[F.coalesce(F.sum(m), F.lit(0.0)).alias(m) for m in measures], *[(F.coalesce(F.sum(m), F.lit(0.0)) / 1e6).alias(f"{m}_mha") for m in measures])


def country_totals(df: DataFrame, measures: list[str], country: str = "country_code") -> DataFrame:
    """A2: (country, measure, total): each country's sums; a measure of 0 has no row."""
    sums = df.filter(F.coalesce(F.col(country) > 0, F.lit(False))).groupBy(country).agg(*[F.sum(m).alias(m) for m in measures])
    return sums.unpivot([country], measures, "measure", "total").filter(F.col("total") != 0)


def rolled_totals(df: DataFrame, measures: list[str], country: str = "country_code") -> DataFrame:
    """A1 and A2 by one rollup; the global row has a null country."""
    return df.filter(F.coalesce(F.col(country) > 0, F.lit(False))).rollup(country).agg(*[F.sum(m).alias(m) for m in measures])


def weighted_means(df: DataFrame, variables: list[str], weights: list[str]) -> DataFrame:
    """A3: (variable, weight, mean): sum of x w by sum of w; rows without x still weigh in the denominator."""
    sums = df.agg(*[F.try_divide(F.sum(F.col(x) * F.col(w)), F.sum(w)).alias(f"{x}|{w}") for x in variables for w in weights])
    pairs = F.explode(F.array(*[F.struct(F.lit(x).alias("variable"), F.lit(w).alias("weight"), F.col(f"`{x}|{w}`").alias("mean")) for x in variables for w in weights]))
    return sums.select(pairs.alias("p")).select("p.*")


def intensity_shares(totals: DataFrame, low: list[str], high: list[str], fallow: float = 440e6) -> DataFrame:
    """A4: low- and high-intensity area and their shares of cropland without and with fallow land."""
    add = lambda names: sum((F.coalesce(F.col(n), F.lit(0.0)) for n in names), F.lit(0.0))
    both = totals.select(add(low).alias("low_intensity"), add(high).alias("high_intensity"))
    total = F.col("low_intensity") + F.col("high_intensity")
    return both.select(
        "*", F.try_divide("low_intensity", total).alias("low_share"), F.try_divide("high_intensity", total).alias("high_share"),
        ((F.col("low_intensity") + fallow) / (total + fallow)).alias("low_share_fallow"), (F.col("high_intensity") / (total + fallow)).alias("high_share_fallow"),
    )


def overlay_merge(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """A5: the value of ``a``, else that of ``b``."""
    joined = a.select(key, F.col(value).alias("first_value")).join(b.select(key, F.col(value).alias("second_value")), key, "full_outer")
    return joined.select(key, F.coalesce("first_value", "second_value").alias(value))


def top_n(df: DataFrame, column: str, n: int, key: str) -> DataFrame:
    """The ``n`` rows with the largest values, ties by key."""
    return df.orderBy(F.desc_nulls_last(column), key).limit(n)
