"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

The words of a source stand in one line: its documents in the order of a hash, cut into blocks of equal size. A recipe gives each
source its weight, target and exact quota of blocks. The quotas of all sources are split over the output shards by a tree: a node
draws, from the multivariate hypergeometric law, which part of its blocks goes to its left half. A source's draws are numbered; each pass over
its blocks takes them in the order of a keyed permutation of its own, and a shard owns a range of numbers, those that the tree gave it, so shards draw
disjoint blocks. What no shard owns isn't drawn. Inside a shard draws are ordered by a hash.

The recipe has one row for each source, as mixing weights have, and is held on the driver; all that grows with the documents stays in Spark. Places
in the line are found by two cumulative sums: over the buckets of a source (as many as its count of documents needs), and inside a
bucket, so that no source of any size meets in one task. Only rows that share both id and text always stand in one bucket.

Defined results: null and empty texts have size 0 and are never drawn; a null source is a source of its own and comes last; rows with the same id, or
none, are told apart by their texts and drawn on their own; equal rows are drawn one after the other; an empty table gives an empty result. ``mix`` replaces
columns of the input called size, source_size, target or draws; ``drawn_texts`` returns all columns of the input whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.llm.batches import CHUNK_CHARS, cuts, release, small_batches
from furrow.session import stored

WEIGHTS = (5, 2, 1)
#: Documents of one source in a bucket, which is ordered as a whole.
BUCKET_ROWS = 2_000
#: Rounds of the permutation of blocks; words of a shard that one task writes, unless that makes more than so many tasks of it.
ROUNDS, SLOT_WORDS, SLOTS = 16, 3_000_000, 1_000


def word_count(text):
    """Words between blanks of ASCII, null as none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Share:
    """A row of the recipe."""

    source: str | None
    size: int
    target: float
    blocks: int
    quota: int
    ends: tuple[int, ...]
    """For each shard the number of the source's draws before its end."""
    keys: tuple[tuple[int, ...], ...]
    """For each pass the keys of its permutation of blocks."""


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, total: float = 1.5, most: float = 2.0) -> list[float]:
    """Targets by weight of ``total`` times all sizes; none above ``most`` times its size, what is over shared again by weight."""
    n = len(sizes)
    weight = [weights[k % len(weights)] for k in range(n)]
    full: set[int] = set()
    while True:
        left = total * sum(sizes) - sum(most * sizes[k] for k in full)
        open_weight = sum(weight[k] for k in range(n) if k not in full)
        out = [most * sizes[k] if k in full else left * weight[k] / open_weight for k in range(n)]
        over = {k for k in range(n) if k not in full and out[k] > most * sizes[k]}
        if not over:
            return out
        full |= over


def split_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards, sources) whole numbers whose columns sum to ``quotas`` and whose rows differ by one block at most."""
    out = np.zeros((shards, len(quotas)), np.int64)
    total = int(quotas.sum())
    bounds = [total * k // shards for k in range(shards + 1)]

    def split(left: int, right: int, own: np.ndarray) -> None:
        if right - left == 1:
            out[left] = own
            return
        middle = (left + right) // 2
        taken = _hypergeometric(own, bounds[middle] - bounds[left], rng)
        split(left, middle, taken)
        split(middle, right, own - taken)

    split(0, shards, quotas)
    return out


def _hypergeometric(colours: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """A multivariate hypergeometric draw, one source after the other; populations beyond the generator's limit are halved first."""
    out, rest = np.zeros_like(colours), int(colours.sum())
    for k, own in enumerate(colours.tolist()):
        rest -= own
        out[k] = _draw(own, rest, n, rng)
        n -= int(out[k])
    return out


def _draw(good: int, bad: int, n: int, rng: np.random.Generator) -> int:
    if good == 0 or n == 0:
        return 0
    if bad == 0:
        return n
    if good < 10**9 and bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    # Beyond the generator's limit the normal law is as close as doubles are.
    p = good / (good + bad)
    spread = (n * p * (1 - p) * (good + bad - n) / (good + bad - 1)) ** 0.5
    return int(min(max(round(rng.normal(n * p, spread)), 0, n - bad), good, n))


def permuted(block_no: Column, keys: Column, blocks: Column) -> Column:
    """The place of a block in a keyed permutation of 0 .. blocks - 1: in each round a block and its mirror image about the key change places or not, by a
    hash of the larger of the two, which both share (a swap-or-not shuffle; Hoang, Morris, Rogaway 2012)."""

    def swap(x, key):
        other = F.pmod(key - x, blocks)
        return F.when(F.xxhash64(key, F.greatest(x, other)).bitwiseAND(F.lit(1)) == 1, other).otherwise(x)

    return F.aggregate(keys, block_no, swap)


def recipe(sizes: list[tuple[str | None, int]], block: int, shards: int, seed: int, weights: tuple[int, ...] = WEIGHTS, total: float = 1.5, most: float = 2.0) -> list[Share]:
    """Shares of (source, size) pairs in the order of code points, null last."""
    ordered = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode()))
    goals = targets([s for _, s in ordered], weights, total, most)
    blocks = [-(-s // block) for _, s in ordered]
    # Quotas in blocks, by the mean size of the source's blocks; the last block may be short.
    quotas = np.array([min(round(g * b / s), int(most * b)) if s else 0 for (_, s), g, b in zip(ordered, goals, blocks)], np.int64)
    parts = split_tree(quotas, shards, np.random.default_rng(seed)) if len(quotas) else np.zeros((shards, 0), np.int64)
    ends = np.cumsum(parts, axis=0)
    passes = max(1, int(np.ceil(most)))
    keys = [tuple(tuple(np.random.default_rng([seed, k, p]).integers(0, max(1, b), ROUNDS).tolist()) for p in range(passes)) for k, b in enumerate(blocks)]
    return [Share(name, s, g, b, int(q), tuple(ends[:, k].tolist()), keys[k]) for k, ((name, s), g, b, q) in enumerate(zip(ordered, goals, blocks, quotas))]


DRAWS = "array<struct<pass:int,shard:int,place:long,first_word:long,end_word:long>>"


def _mixed(docs: DataFrame, id: str, text: str, source: str, block: int, shards: int, seed: int, weights: tuple[int, ...], total: float, most: float) -> tuple[DataFrame, list[Share]]:
    """The columns of ``docs`` as c0, c1, ... with id, size, source_size, target and draws; and the recipe."""
    spark = docs.sparkSession
    key = [F.col(id), F.xxhash64(F.col(text))]
    # A null source as a plain pair of keys: the window and the joins below share them, so texts are shuffled once.
    sized = docs.select(
        *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)], F.col(id).alias("id"), word_count(F.col(text)).alias("size"), F.coalesce(F.col(source), F.lit("")).alias("name"),
        F.col(source).isNull().alias("none"), F.xxhash64(F.lit(seed), *key).alias("deal"), F.xxhash64(F.lit(seed + 1), *key).alias("order"),
    )
    fine_buckets = max(1, -(-docs.count() // BUCKET_ROWS))
    fine = F.pmod("deal", F.lit(fine_buckets))
    sums = stored(sized.groupBy("name", "none", fine.alias("fine")).agg(F.sum("size").alias("size"), F.count("*").alias("rows")), "mix-sums")
    by_source = sums.groupBy("name", "none").agg(F.sum("size").alias("size"), F.sum("rows").alias("rows")).collect()
    shares = recipe([(None if r["none"] else r["name"], r["size"]) for r in by_source], block, shards, seed, weights, total, most)
    rows = {(None if r["none"] else r["name"]): r["rows"] for r in by_source}
    schema = "name string, none boolean, source_size long, target double, blocks long, ends array<long>, keys array<array<long>>, buckets long"
    # A row for each source: the recipe's size, not the documents'.
    table = F.broadcast(spark.createDataFrame([(s.source or "", s.source is None, s.size, s.target, s.blocks, list(s.ends), [list(k) for k in s.keys], -(-rows[s.source] // BUCKET_ROWS)) for s in shares], schema))
    # A bucket holds as many documents in a large source as in a small one: fine buckets next to each other are joined.
    bucket = F.floor(F.col("fine") * F.least("buckets", F.lit(fine_buckets)) / fine_buckets).cast("long")
    keys = ["name", "none", "bucket"]
    counted = table.select("name", "none", "buckets")
    coarse = sums.join(F.broadcast(counted), ["name", "none"]).groupBy("name", "none", bucket.alias("bucket")).agg(F.sum("size").alias("bucket_size"))
    starts = coarse.select(*keys, (F.sum("bucket_size").over(Window.partitionBy("name", "none").orderBy("bucket")) - F.col("bucket_size")).alias("bucket_start"))
    dealt = sized.withColumn("fine", fine).join(F.broadcast(counted), ["name", "none"]).withColumn("bucket", bucket).drop("fine", "buckets", "deal")
    line = Window.partitionBy(*keys).orderBy("order", "id", "size")
    placed = dealt.withColumn("start", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    joined = placed.join(starts.join(table, ["name", "none"]), keys)
    start, end = F.col("start") + F.col("bucket_start"), F.col("start") + F.col("bucket_start") + F.col("size")
    inside = F.sequence(F.floor(start / block), F.floor((end - 1) / block))
    draws = F.when(F.col("size") > 0, F.flatten(F.transform(inside, lambda k: _draws_of(k, start, end, block, most, seed)))).otherwise(F.array().cast(DRAWS))
    return joined.select(*[f"c{k}" for k in range(len(docs.columns))], "id", "size", "source_size", "target", draws.alias("draws")), shares


def _draws_of(block_no, start, end, block: int, most: float, seed: int):
    """The draws of one block, cut to the document that stands at start..end: those whose number lies in the range of a shard."""
    out = []
    for p in range(max(1, int(np.ceil(most)))):
        number = permuted(block_no, F.col("keys")[p], F.col("blocks")) + F.lit(p) * F.col("blocks")
        shard = F.transform(F.array(number), lambda n: F.size(F.filter("ends", lambda e: e <= n)))[0]
        out.append(
            F.struct(
                F.lit(p).alias("pass"), shard.alias("shard"), F.xxhash64(F.lit(seed), F.lit(p), F.col("name"), F.col("none"), block_no).alias("place"),
                (F.greatest(block_no * block, start) - start).cast("long").alias("first_word"), (F.least((block_no + 1) * block, end) - start).cast("long").alias("end_word"),
            )
        )
    return F.filter(F.array(*out), lambda d: d["shard"] < F.size("ends")).cast(DRAWS)


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", block: int = 64, shards: int = 16, seed: int = 1, weights: tuple[int, ...] = WEIGHTS, total: float = 1.5, most: float = 2.0) -> DataFrame:
    """``docs`` with size, source_size, target and draws: an array of (pass, shard, place, first_word, end_word), one for each part of a drawn block in the document.

    ``place`` orders the draws inside their shard.
    """
    mixed, _ = _mixed(docs, id, text, source, block, shards, seed, weights, total, most)
    new = ["size", "source_size", "target", "draws"]
    return mixed.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns) if c not in new or c in (id, text, source)], *[n for n in new if n not in (id, text, source)])


def taken_by_shard(draws, shards: int = 16):
    """Words that each shard takes of a document, repeats counted: an array with a place for each shard."""
    own = lambda all_, k: F.aggregate(F.filter(all_, lambda d: d["shard"] == k), F.lit(0).cast("long"), lambda n, d: n + d["end_word"] - d["first_word"])
    # An array of one makes the draws a variable: as an expression they would be drawn anew for each shard.
    return F.transform(F.array(draws), lambda all_: F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda k: own(all_, k)))[0]


_BLANK = np.isin(np.arange(256), (32, 9, 10, 11, 12, 13))


def cut(text: bytes, parts: list[tuple[int, int]]) -> bytes:
    """The words of ``parts`` (first, end) of a text with the signs between them; parts that don't touch are put on lines of their own."""
    inside = np.concatenate([[False], ~_BLANK[np.frombuffer(text, np.uint8)], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if parts == [(0, len(starts))]:
        return text
    return b"\n".join(text[starts[a] : ends[b - 1]] for a, b in parts)


def shard_parts(draws: dict[str, np.ndarray]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(shard, place, parts) for each shard and pass that draws from a text: the words that it takes, parts that touch joined, and the place of its first draw."""
    order = np.lexsort((draws["first_word"], draws["pass"], draws["shard"]))
    held: tuple[int, int] | None = None
    place, parts = 0, []
    for k in order.tolist():
        own, a, b = (int(draws["shard"][k]), int(draws["pass"][k])), int(draws["first_word"][k]), int(draws["end_word"][k])
        if own != held:
            if held is not None:
                yield held[0], place, parts
            held, place, parts = own, int(draws["place"][k]), []
        place = min(place, int(draws["place"][k]))
        parts[-1:] = [(parts[-1][0], b)] if parts and parts[-1][1] == a else [*parts[-1:], (a, b)]
    if held is not None:
        yield held[0], place, parts


def drawn_texts(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", n_chars: str = "n_chars", block: int = 64, shards: int = 16, seed: int = 1, weights: tuple[int, ...] = WEIGHTS, total: float = 1.5, most: float = 2.0) -> DataFrame:
    """The columns of ``docs`` with the drawn words as text and its length in ``n_chars``: one row for each document, shard and pass that draws from it.

    Rows are dealt to their shards and stand in the order of ``place`` there: a shard is a run of partitions with rows of all sources mixed.
    """
    mixed, shares = _mixed(docs, id, text, source, block, shards, seed, weights, total, most)
    columns = [f"c{k}" for k in range(len(docs.columns))]
    at, chars = docs.columns.index(text), docs.columns.index(n_chars) if n_chars in docs.columns else None
    fields = [T.StructField(c, f.dataType) for c, f in zip(columns, docs.schema)]
    names = [*columns, "shard", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in cuts(sizes, CHUNK_CHARS):
                part = batch.slice(a, b - a)
                raw, draws = part.column(at).cast(pa.binary()).to_pylist(), part.column(len(columns))
                flat = draws.flatten()
                own = {n: flat.field(n).to_numpy(zero_copy_only=False) for n in ("pass", "shard", "place", "first_word", "end_word")}
                offset = np.concatenate([[0], np.cumsum(pc.list_value_length(draws).to_numpy(zero_copy_only=False).astype(np.int64))])
                rows, dealt, places, texts = [], [], [], []
                for k in np.flatnonzero(np.diff(offset)).tolist():
                    for shard, place, parts in shard_parts({n: x[offset[k] : offset[k + 1]] for n, x in own.items()}):
                        rows.append(k)
                        dealt.append(shard)
                        places.append(place)
                        texts.append(cut(raw[k], parts))
                out = part.select(range(len(columns))).take(pa.array(rows, pa.int64())).columns
                out[at] = pa.array(texts, pa.binary()).cast(pa.string())
                if chars is not None:
                    out[chars] = pc.utf8_length(out[at]).cast(out[chars].type)
                yield pa.RecordBatch.from_arrays([*out, pa.array(dealt, pa.int32()), pa.array(places, pa.int64())], names)
        release()

    small_batches(docs.sparkSession)
    made = mixed.select(*columns, "draws").mapInArrow(run, T.StructType([*fields, T.StructField("shard", T.IntegerType()), T.StructField("place", T.LongType())]))
    # A number of partitions of its own keeps files, and the row groups that the next stage reads at once, of moderate size.
    slots = min(SLOTS, max(1, -(-sum(s.quota for s in shares) * block // (shards * SLOT_WORDS))))
    dealt = made.withColumn("slot", F.pmod("place", F.lit(slots))).repartition(shards * slots, "shard", "slot").sortWithinPartitions("shard", "slot", "place", *[c for c, f in zip(columns, fields) if c == f"c{docs.columns.index(id)}"])
    return dealt.select(*[F.col(c).alias(n) for c, n in zip(columns, docs.columns)])
