"""Target-distribution importance resampling: documents are drawn by how much more likely their words are in a target corpus.

Features are runs of 1 to ``longest`` words, hashed into buckets. A document's weight is the mean of its buckets' gains, an array of integers computed from the counts
of the corpus and of the target; every slice of texts adds up its own counts before they are shuffled, so the counts are ``buckets`` rows whatever the corpus. Weights with
Gumbel noise that depends on the id alone make a draw without replacement: the highest scores win.

The cut is found by bisection. Scores are written once; each round counts, exactly and over all rows, how many lie at or above some thresholds inside the interval that is
left, and takes the part in which the wanted number is crossed. Rows that share the score at the cut are told apart by id in the same way. No round orders anything, and each
brings a few numbers to the driver. Only the drawn rows are then range-partitioned by (score, id, row number), sorted where they lie, and ranked by the sizes of the partitions before.

Defined results: null texts and texts without a word have no features and weight 0; documents under ``least_words`` words and those without features are never drawn unless
``least_words`` allows it, but return with their score; a null id hashes as an empty one and loses every tie to another id; rows that share score and id are drawn in any order
up to the number asked for (their results differ in the rank alone, or in n_features where their texts differ); an empty table gives an empty result, an empty target leaves
gains that follow from its counts of 0; other columns of the input are ignored, whatever they are called.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.batches import map_texts, small_batches, text_slices
from furrow.session import stored

#: Bytes of words keep their value (A-Z become a-z), all others part words.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def feature_buckets(text: bytes, longest: int, buckets: int) -> np.ndarray:
    """The bucket of each run of 1 to ``longest`` words, repeats included."""
    words = text.translate(_WORDS).split()
    found = list(map(zlib.crc32, words))
    for n in range(2, longest + 1):
        found += [zlib.crc32(b" ".join(words[k : k + n])) for k in range(len(words) - n + 1)]
    return np.array(found, np.int64) % buckets


def bucket_counts(docs: DataFrame, text: str = "text", longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket that has any."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, texts in text_slices(batch.column(0)):
                for t in texts:
                    if t:
                        total += np.bincount(feature_buckets(t.encode(), longest, buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    parts = docs.select(F.col(text).alias("text")).mapInArrow(count, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text: str = "text", longest: int = 1, buckets: int = 10_000) -> np.ndarray:
    """floor(1000 ln(share in the target / share in the corpus)) of each bucket, both smoothed by one. At most ``buckets`` rows come to the driver."""
    counts = bucket_counts(docs, text, longest, buckets).withColumnRenamed("n", "s").join(bucket_counts(target, text, longest, buckets).withColumnRenamed("n", "t"), "bucket", "full")
    s, t = np.zeros(buckets), np.zeros(buckets)
    for row in counts.collect():
        s[row.bucket], t[row.bucket] = row.s or 0, row.t or 0
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, id: str = "doc_id", text: str = "text", longest: int = 1) -> DataFrame:
    """(id, n_words, n_features, weight) of each row: the floored mean of its features' gains."""
    buckets = len(gains)

    def make():
        def weights(texts: list) -> list[np.ndarray]:
            words, n, weight = (np.zeros(len(texts), np.int64) for _ in range(3))
            for k, t in enumerate(texts):
                found = feature_buckets(t.encode(), longest, buckets) if t else ()
                n[k] = len(found)
                if n[k]:
                    # Of m words there are m + (m - 1) + ... features; for single words both numbers are the same.
                    words[k] = n[k] if longest == 1 else len(t.encode().translate(_WORDS).split())
                    weight[k] = int(gains[found].sum()) // int(n[k])
            return [words, n, weight]

        return weights

    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    return map_texts(rows, "text", "n_words long, n_features long, weight long", make)


def gumbel_score(weight: Column, id: Column, seed: str) -> Column:
    """The weight with Gumbel noise, in thousandths, from a digest of ``seed:id``."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return weight + F.floor(-1000.0 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def crossing(rows: DataFrame, column: str, wanted: int, descending: bool, ways: int = 16) -> tuple[int | None, int]:
    """(cut, before): with rows taken from the highest ``column`` down (else from the lowest up), the value at which the ``wanted``-th row stands and the number of rows ahead of that value.

    Null is no value. Each job counts at ``ways`` thresholds, so an interval shrinks to a seventeenth a round: 64-bit values take 16 rounds at most. cut is None where fewer rows have a value.
    """
    sign = -1 if descending else 1
    value = sign * F.col(column)
    low, high, n = rows.agg(F.min(value), F.max(value), F.count(column)).first()
    if wanted <= 0 or n < wanted:
        return None, n
    ahead = 0  # rows under low
    while low < high:
        step = max(1, -(-(high - low) // (ways + 1)))
        cuts = list(range(low, high, step))
        counts = rows.agg(*[F.count(F.when(value <= c, 1)).alias(f"n{k}") for k, c in enumerate(cuts)]).first()
        at = next((k for k, c in enumerate(counts) if c >= wanted), len(cuts))
        if at:
            ahead = counts[at - 1]
        low, high = (cuts[at - 1] + 1 if at else low), (cuts[at] if at < len(cuts) else high)
    return sign * low, ahead


def draw(scored: DataFrame, eligible: Column, percent: int) -> DataFrame:
    """``scored(id, score, ...)`` with rank: 1, 2, 3... for the floor(``percent`` N / 100) highest scores of the N eligible rows, ties to the smaller id, null for the others."""
    every = stored(scored.withColumn("eligible_", F.coalesce(eligible, F.lit(False))).withColumn("row_", F.monotonically_increasing_id()), "scores")
    mine = every.filter("eligible_")
    wanted = mine.count() * percent // 100
    cut, before = crossing(mine, "score", wanted, descending=True)
    if cut is None:
        return every.select(*scored.columns, F.lit(None).cast("long").alias("rank"))
    ties = mine.filter(F.col("score") == cut)
    last, _ = crossing(ties, "id", wanted - before, descending=False)
    in_tie = F.lit(True) if last is None else F.coalesce(F.col("id") <= last, F.lit(False))
    # Rows that share score and id with the last one drawn come along and are trimmed by their rank.
    picked = F.col("eligible_") & ((F.col("score") > cut) | ((F.col("score") == cut) & in_tie))
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("row_")]
    dealt = every.filter(picked).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = stored(dealt.withColumn("at_", F.monotonically_increasing_id()), "drawn")
    part, place = F.shiftrightunsigned("at_", 33), F.col("at_").bitwiseAND((1 << 33) - 1)
    sizes = dealt.groupBy(part.alias("part_")).agg(F.count("*").alias("n_"))  # a row for each partition
    starts = stored(sizes.select("part_", (F.sum("n_").over(Window.orderBy("part_")) - F.col("n_")).alias("start_")), "starts")
    ranked = dealt.withColumn("part_", part).join(starts, "part_").withColumn("rank", F.col("start_") + place + 1)
    drawn = ranked.select(*scored.columns, F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank"))
    return drawn.unionByName(every.filter(~picked).select(*scored.columns, F.lit(None).cast("long").alias("rank")))


def resample(
    docs: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", longest: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: str = "2024"
) -> DataFrame:
    """(id, n_features, weight, score, rank) of each row of ``docs``; ``percent`` of a hundred of those with ``least_words`` words or more are drawn towards the word distribution of ``target``."""
    texts = target.select(F.col(text).alias(text))
    weighed = weigh(docs, bucket_gains(docs, texts, text, longest, buckets), id, text, longest)
    scored = weighed.withColumn("score", gumbel_score(F.col("weight"), F.col("id"), seed).cast("long"))
    ranked = draw(scored, F.col("n_words") >= least_words, percent)
    return ranked.select(F.col("id").alias(id), "n_features", "weight", "score", "rank")
