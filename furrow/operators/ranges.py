"""Running sums over a whole group without ordering it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def same_keys(a: DataFrame, b: DataFrame, keys: list[str]):
    """Equality of keys in which null equals null; true for no keys."""
    on = F.lit(True)
    for k in keys:
        on = on & a[k].eqNullSafe(b[k])
    return on


def running_sums(df: DataFrame, by: list[str], order: str, sums: list[str], descending: bool = False, ranges: int = 200) -> DataFrame:
    """``df``, one row for each group and value of the number ``order``, with run_<c> for each of ``sums``: the sum of c over the rows up to this one.

    A group's values are cut at approximate quantiles into ranges of about equal size; the ranges' sums are added up first (at most ``ranges`` rows for each group), and only
    the rows of one range are ordered in one task. ``df`` is read three times: give it a stored table or the result of a group-by, whose shuffle Spark reads again. Rows whose ``order`` is null are passed over; a null in a key is a group of its own. Columns that begin with r_ are used here.
    """
    rows = df.filter(F.col(order).isNotNull())
    shares = F.array(*[F.lit(k / ranges) for k in range(1, ranges)])
    cuts = rows.groupBy(*[F.col(c).alias(f"r_{c}") for c in by]).agg(F.percentile_approx(order, shares, F.lit(10 * ranges)).alias("r_cuts"))
    on = F.lit(True)
    for c in by:
        on = on & rows[c].eqNullSafe(cuts[f"r_{c}"])
    part = F.size(F.filter("r_cuts", lambda e: e < F.col(order)))
    marked = rows.join(cuts, on, "left").withColumn("r_part", -part if descending else part).drop("r_cuts")
    mine = [f"r_{c}" for c in by] + ["r_part"]
    totals = marked.groupBy(*mine).agg(*[F.sum(c).alias(f"r_sum_{c}") for c in sums])
    up = Window.partitionBy(*mine[:-1]).orderBy("r_part") if by else Window.partitionBy(F.lit(0)).orderBy("r_part")  # at most a row for each range
    before = totals.select(*[F.col(m).alias(f"{m}_") for m in mine], *[(F.sum(f"r_sum_{c}").over(up) - F.col(f"r_sum_{c}")).alias(f"r_before_{c}") for c in sums])
    met = F.lit(True)
    for m in mine:
        met = met & marked[m].eqNullSafe(before[f"{m}_"])
    inside = Window.partitionBy(*mine).orderBy(F.desc(order) if descending else F.asc(order))
    out = marked.join(before, met)
    return out.select(*rows.columns, *[(F.col(f"r_before_{c}") + F.sum(c).over(inside)).alias(f"run_{c}") for c in sums])


def exact_percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float], ranges: int = 64) -> DataFrame:
    """(by, one column for each of ``shares``): exact percentiles of the number ``value`` in each group, interpolated between neighbours like Spark's ``percentile``.

    Equal values are counted first. Approximate quantiles cut each group into ``ranges``, whose counts (that many rows a group at most) tell in which of them a wanted rank lies; only the
    values of those are ordered. So no group, not even the whole table, is one buffer or one sort. The counts are shuffled once and read again by each step.

    Defined results: null values are passed over, and a group without any has no row; a null key is a group; NaN is larger than every number; without ``by`` a table without values gives one row of nulls.
    """
    keys = [f"p{k}" for k in range(len(by))]
    rows = df.filter(F.col(value).isNotNull()).select(*[F.col(b).alias(k) for k, b in zip(keys, by)], F.col(value).cast("double").alias("v"))
    counted = rows.groupBy(*keys, "v").agg(F.count("*").alias("n"))

    def met(a: DataFrame, b: DataFrame, on: list[str], prefix: str) -> DataFrame:
        """``a`` with the columns of ``b``, whose keys go; null keys meet."""
        other = b.select(*[F.col(c).alias(f"{prefix}{c}") if c in on else F.col(c) for c in b.columns])
        alike = F.lit(True)
        for c in on:
            alike = alike & F.col(c).eqNullSafe(F.col(f"{prefix}{c}"))
        return a.join(other, alike).drop(*[f"{prefix}{c}" for c in on])

    steps = F.array(*[F.lit(k / ranges) for k in range(1, ranges)])
    cuts = counted.groupBy(*keys).agg(F.percentile_approx("v", steps, F.lit(10 * ranges)).alias("cuts"))
    marked = met(counted, cuts, keys, "c_").select(*keys, "v", "n", F.size(F.filter("cuts", lambda c: c < F.col("v"))).alias("part"))
    sums = marked.groupBy(*keys, "part").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(*keys) if by else Window.partitionBy(F.lit(0))  # a row for each range
    placed = sums.select(*keys, "part", (F.sum("n").over(whole.orderBy("part")) - F.col("n")).alias("before"), "n", F.sum("n").over(whole).alias("all_rows"))
    rank = {name: (F.col("all_rows") - 1) * F.lit(share) for name, share in shares.items()}
    inside = lambda r, first, n: (r >= first) & (r < first + n)
    wanted = F.lit(False)
    for r in rank.values():
        wanted = wanted | inside(F.floor(r), F.col("before"), F.col("n")) | inside(F.ceil(r), F.col("before"), F.col("n"))
    held = met(marked, placed.filter(wanted).select(*keys, "part", "before", "all_rows"), [*keys, "part"], "w_")
    up = Window.partitionBy(*keys, "part").orderBy("v")
    run = held.withColumn("first", F.col("before") + F.sum("n").over(up) - F.col("n"))
    at = lambda r: F.max(F.when(inside(r, F.col("first"), F.col("n")), F.col("v")))
    found = run.groupBy(*keys).agg(*[x for k, r in enumerate(rank.values()) for x in (at(F.floor(r)).alias(f"low{k}"), at(F.ceil(r)).alias(f"high{k}"), F.max(r).alias(f"rank{k}"))])
    between = lambda k: (F.ceil(f"rank{k}") - F.col(f"rank{k}")) * F.col(f"low{k}") + (F.col(f"rank{k}") - F.floor(f"rank{k}")) * F.col(f"high{k}")
    return found.select(*[F.col(k).alias(b) for k, b in zip(keys, by)], *[F.when(F.col(f"low{k}") == F.col(f"high{k}"), F.col(f"low{k}")).otherwise(between(k)).alias(name) for k, name in enumerate(shares)])
