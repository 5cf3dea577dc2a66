"""Evaluation of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.operators.ranges import running_sums
from furrow.session import stored


def confusion_matrix(df: DataFrame, truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """(truth, prediction, n)."""
    return df.groupBy(truth, pred).agg(F.count("*").alias("n"))


def classification_report(df: DataFrame, truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """(name, precision, recall, f1, support) of each class, and rows accuracy, macro and weighted; 0 where a ratio has no base.

    One pass over the rows gives the matrix; the rest works on a row for each pair of classes.
    """
    matrix = confusion_matrix(df, truth, pred)
    cells = matrix.select(F.explode(F.array(
        F.struct(F.col(truth).alias("c"), F.col("n").alias("support"), F.lit(0).cast("long").alias("picked"), F.when(F.col(truth) == F.col(pred), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col(pred).alias("c"), F.lit(0).cast("long").alias("support"), F.col("n").alias("picked"), F.lit(0).cast("long").alias("hit")),
    )).alias("x")).select("x.*")
    per = cells.groupBy("c").agg(F.sum("support").alias("support"), F.sum("picked").alias("picked"), F.sum("hit").alias("hit"))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    per = per.withColumn("precision", zero(F.col("hit"), F.col("picked"))).withColumn("recall", zero(F.col("hit"), F.col("support")))
    per = per.withColumn("f1", zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    names = ["precision", "recall", "f1"]
    rows = per.select(F.col("c").cast("string").alias("name"), *names, "support")
    total = F.sum("support")
    accuracy = per.agg(F.lit("accuracy").alias("name"), *[(F.sum("hit") / total).alias(n) for n in names], total.alias("support"))
    macro = per.agg(F.lit("macro avg").alias("name"), *[F.avg(n).alias(n) for n in names], total.alias("support"))
    weighted = per.agg(F.lit("weighted avg").alias("name"), *[(F.sum(F.col(n) * F.col("support")) / total).alias(n) for n in names], total.alias("support"))
    return rows.unionByName(accuracy).unionByName(macro).unionByName(weighted)


def overlap_metrics(df: DataFrame, pairs: list[tuple[str, str]], alpha: float = 0.3, beta: float = 0.7, smooth: float = 1e-6) -> DataFrame:
    """(class, iou, dice, tversky) from soft truths and predictions: alpha weighs misses, beta false finds."""
    sums = df.agg(*[F.struct(F.sum(F.col(t) * F.col(p)).alias("tp"), F.sum((1 - F.col(t)) * F.col(p)).alias("fp"), F.sum(F.col(t) * (1 - F.col(p))).alias("fn")).alias(f"c{k}") for k, (t, p) in enumerate(pairs)])
    rows = sums.select(F.explode(F.array(*[F.struct(F.lit(k).alias("class"), F.col(f"c{k}").alias("c")) for k in range(len(pairs))])).alias("r")).select("r.class", "r.c.*")
    return rows.select(
        "class", ((F.col("tp") + smooth) / (F.col("tp") + F.col("fp") + F.col("fn") + smooth)).alias("iou"), ((2 * F.col("tp") + smooth) / (2 * F.col("tp") + F.col("fp") + F.col("fn") + smooth)).alias("dice"),
        ((F.col("tp") + smooth) / (F.col("tp") + alpha * F.col("fn") + beta * F.col("fp") + smooth)).alias("tversky"),
    )


def score_steps(df: DataFrame, score: str, positive: str, by: list[str]) -> DataFrame:
    """Positives and negatives of each distinct score and how many stand at or above it: rows are summed by score, then by ranges of scores."""
    steps = stored(df.filter(F.col(score).isNotNull()).groupBy(*by, score).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.sum(1 - F.col(positive).cast("long")).alias("q")))
    return running_sums(steps, by, score, ["p", "q"], descending=True).withColumnsRenamed({"run_p": "tp", "run_q": "fp"})


def roc_auc(df: DataFrame, score: str, positive: str, by: list[str]) -> DataFrame:
    """(by, auc): the area under the curve, ties by half; null with one class."""
    steps = score_steps(df, score, positive, by)
    area = F.sum(F.col("q") * (F.col("tp") - F.col("p") / 2))
    return steps.groupBy(*by).agg(F.try_divide(area, F.sum("p") * F.sum("q")).alias("auc"))


def average_precision(df: DataFrame, score: str, positive: str, by: list[str]) -> DataFrame:
    """(by, ap): precision averaged over the gains in recall."""
    steps = score_steps(df, score, positive, by)
    return steps.groupBy(*by).agg(F.try_divide(F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.sum("p")).alias("ap"))


def regression_metrics(df: DataFrame, truth: str, pred: str, by: list[str]) -> DataFrame:
    """(by, r2, rmse, mae); r2 is null for a constant truth."""
    e = F.col(truth) - F.col(pred)
    return df.groupBy(*by).agg((1 - F.try_divide(F.sum(e * e), F.var_pop(truth) * F.count(truth))).alias("r2"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))


def encode_scale(df: DataFrame, label: str, numbers: list[str], train) -> DataFrame:
    """``df`` with label_code (alphabetical, from 0; null for a null label) and numbers standardised by mean and population deviation of the training rows."""
    names = df.select(label).filter(F.col(label).isNotNull()).distinct()
    codes = names.withColumn("label_code", F.row_number().over(Window.orderBy(label)) - 1)  # one row for each class
    stats = df.filter(train).agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(f"s_{c}") for c in numbers])
    # The codes are written first, so that Spark sends them to the rows only where they are small.
    out = df.join(stored(codes), label, "left").crossJoin(F.broadcast(stats))  # against one row
    return out.select(*[c for c in df.columns if c not in numbers], "label_code", *[((F.col(c) - F.col(f"s_{c}.m")) / F.when(F.col(f"s_{c}.s") == 0, 1.0).otherwise(F.col(f"s_{c}.s"))).alias(c) for c in numbers])


def information_gain(df: DataFrame, feature: str, label: str) -> DataFrame:
    """(threshold, gain): the gain in natural-log entropy of every split value <= threshold, from running class counts of distinct values.

    The classes (a row for each on the driver, as a tree's target has) become columns of counts, so a row stands for each distinct value. Rows with a null value or class are
    passed over; the largest value splits nothing and has no row.
    """
    rows = df.filter(F.col(feature).isNotNull() & F.col(label).isNotNull())
    classes = [(r[0], r[1]) for r in rows.groupBy(label).count().orderBy(label).collect()]
    names = [f"n{k}" for k in range(len(classes))]
    if not classes:
        return df.select(F.col(feature).alias("threshold"), F.lit(0.0).alias("gain")).limit(0)
    wide = stored(rows.groupBy(F.col(feature).alias("threshold")).agg(*[F.count_if(F.col(label) == F.lit(c)).alias(n) for n, (c, _) in zip(names, classes)]))
    cum = running_sums(wide, [], "threshold", names)
    xlogx = lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0)
    total = sum(n for _, n in classes)

    def side(parts: list):
        """The size of a side times its entropy."""
        size = sum(parts[1:], parts[0])
        own = [xlogx(x) for x in parts]
        return xlogx(size) - sum(own[1:], own[0])

    left = [F.col(f"run_{n}") for n in names]
    right = [F.lit(all_n) - x for x, (_, all_n) in zip(left, classes)]
    gain = (side([F.lit(n).cast("double") for _, n in classes]) - side(left) - side(right)) / total
    return cum.filter(sum(right[1:], right[0]) > 0).select("threshold", gain.alias("gain"))
