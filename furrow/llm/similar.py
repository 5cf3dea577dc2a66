"""Near copies by exact similarity of word shingles, found first by SimHash.

Two texts are linked where their sets of word shingles have a Jaccard similarity of ``least`` or more; the smallest id reachable over links
names a document's group. No link is missed, and each is decided on the whole sets:

- SimHash fingerprints of the sets within a few bits, found through the Gray-order index, bring most copies together at little cost; sets that they bring together are compared.
- The rest is found by counting. Two sets of similarity t share at least k of their first n - ceil(t n) + k shingles in any common order, or all that they have in
  common. Sets without so many partners among these have no copy; of the others at least ceil(t n) shingles must have partners. What is left is a small part of a
  corpus, and of it only the rarest of each set's shared shingles, all but ceil(t n) - 1, are needed to bring all similar sets together: sets that share one form a cluster.
- Sets of a cluster are compared inside tiles, by products of their incidence matrices. Clusters of several tiles are dealt anew once, and then those sets that aren't
  in the cluster's largest group yet meet all tiles. Clusters whose sets are joined already are passed over. A task holds two tiles at the most.

Shingles that a sample shows to be very common stand last in the order and are taken to have partners, so that none of them is counted or joined in one task; which
ones these are changes the work, never the result. Shingles and sets are told apart by 64-bit hashes.

Defined results: texts with the same set are always linked, null and empty ones too. A row is known by its id and a digest of its text, so rows that share an id
but not a text, and rows without an id, are documents of their own. Of a group ``keep_one`` keeps the row with the smallest id, a null id after all others,
of equal ids the one with the smallest digest, and of rows that are equal in both one. An empty table gives an empty result; other columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.batches import map_texts, release, small_batches, text_slices
from furrow.llm.components import components, local_roots
from furrow.llm.simhash import SEED, near_links
from furrow.session import drop_stored, free_shuffles, stored

#: One in so many rows is counted to find common shingles.
SAMPLE = 8
#: Sets of a tile, and their shingles together.
TILE, TILE_SHINGLES = 512, 1_000_000


def shingle_hashes(text: str | None, shingle: int = 5, known: dict | None = None) -> np.ndarray:
    """The sorted distinct hashes of a text's lower-cased word shingles; a shorter text is one shingle."""
    import xxhash

    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    known = {} if known is None else known
    if len(known) > 200_000:
        known.clear()
    codes = np.empty(len(words), np.uint64)
    for k, w in enumerate(words):
        c = known.get(w)
        if c is None:
            c = known[w] = xxhash.xxh64_intdigest(w, SEED)
        codes[k] = c
    size = min(shingle, len(words))
    n = len(words) - size + 1
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = (h ^ codes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(h ^ (h >> np.uint64(32)))


def _simhash(h: np.ndarray, step: int = 1 << 16) -> np.uint64:
    total = np.zeros(64, np.int64)
    for k in range(0, len(h), step):
        total += np.unpackbits(h[k : k + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > len(h), bitorder="little").view(np.uint64)[0]


def fewest(n, least: float):
    """Shingles that a set of ``n`` has in common at least with a similar one: ceil(least * n)."""
    return np.ceil(least * n - 1e-9).astype(np.int64)


def shared_first(n, least: float):
    """The number k that a set of ``n`` shares with a similar one that isn't smaller, among their first n - fewest + k."""
    return np.minimum(8 + n // 16, fewest(n, least))


def rare_first(h: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, int]:
    """(a set in the common order, the rare ones before the common ones, number of the rare)."""
    if not len(common) or not len(h):
        return h, len(h)
    last = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h
    return np.concatenate([h[~last], h[last]]), int((~last).sum())


def digested(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, digest, text): the rows of ``docs`` with a digest of their texts."""
    return docs.select(F.col(id).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("digest"), F.col(text).alias("text"))


def same_row(a: DataFrame, b: DataFrame):
    return a["id"].eqNullSafe(b["id"]) & (a["digest"] == b["digest"])


def marked_rows(rows: DataFrame, shingle: int = 5) -> DataFrame:
    """(id, digest, node, fp) of ``digested`` rows: a hash of each row's set of shingles and its fingerprint."""

    def make():
        import xxhash

        known: dict = {}

        def f(texts: list) -> list:
            sets = [shingle_hashes(t, shingle, known) for t in texts]
            node = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in sets], np.uint64)
            return [node.view(np.int64), np.array([_simhash(h) for h in sets], np.uint64).view(np.int64)]

        return f

    return map_texts(rows, "text", "node long, fp long", make)


def shingle_sets(rows: DataFrame, shingle: int = 5, common: np.ndarray | None = None) -> DataFrame:
    """The columns of ``rows`` but the text, n, rare and hashes: the size of each set, the number of its rare shingles, and the set with these first."""
    held = rows.sparkSession.sparkContext.broadcast(np.zeros(0, np.uint64) if common is None else common)

    def make():
        known: dict = {}

        def f(texts: list) -> list:
            sets = [rare_first(shingle_hashes(t, shingle, known), held.value) for t in texts]
            return [[len(h) for h, _ in sets], [k for _, k in sets], [h.view(np.int64) for h, _ in sets]]

        return f

    return map_texts(rows, "text", "n int, rare int, hashes array<long>", make)


def common_shingles(rows: DataFrame, shingle: int, seen: int = 25) -> np.ndarray:
    """Sorted shingles that at least ``seen`` texts of a sample have, or one in 2,000 of the sample where that is more: 2,000 times the mean size of a set at the most."""
    sample = rows.filter(F.pmod("digest", F.lit(SAMPLE)) == 0)
    seen = max(seen, sample.count() // 2000)
    found = shingle_sets(sample, shingle).select(F.explode("hashes").alias("h")).groupBy("h").count().filter(F.col("count") >= seen).select("h").toPandas()
    return np.sort(found["h"].to_numpy(np.int64).view(np.uint64))


def texts_of(nums: DataFrame, rows: DataFrame, classes: DataFrame, repeats: bool) -> DataFrame:
    """(num, text): one text of each set of ``nums(num)``. The chosen rows are written first, so that Spark sends them to the texts where they are few."""
    chosen = stored(classes.join(nums, "num", "left_semi").select("num", "row.id", "row.digest"), "chosen")
    found = rows.join(chosen, same_row(rows, chosen)).select("num", "text")
    return found.dropDuplicates(["num"]) if repeats else found


def first_rows(texts: DataFrame, shingle: int, common: np.ndarray, least: float) -> DataFrame:
    """(h, num, head) of ``texts(num, text)``: a row for each rare one of a set's first shingles, and one with its size and the number of common ones among the first."""
    held = texts.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            nums = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, part in text_slices(batch.column(1)):
                sets = [rare_first(shingle_hashes(t, shingle, known), held.value) for t in part]
                n = np.array([len(h) for h, _ in sets], np.int64)
                first = n - fewest(n, least) + shared_first(n, least)
                rare = np.minimum(first, [k for _, k in sets])
                own = nums[a:b]
                h = np.concatenate([*(x[:k] for (x, _), k in zip(sets, rare)), own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)]).view(np.int64)
                heads = pa.array(np.concatenate([np.zeros(int(rare.sum()), np.int64), n << 31 | first - rare]), mask=np.arange(len(h)) < rare.sum())
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.concatenate([np.repeat(own, rare), own])), heads], ["h", "num", "head"])
        release()

    small_batches(texts.sparkSession)
    return texts.mapInArrow(run, "h long, num long, head long")


def candidates(first: DataFrame, least: float) -> DataFrame:
    """(num): sets whose first shingles have enough partners, for the smallest set that can be similar. ``first``: see ``first_rows``."""
    shared = first.withColumn("df", F.count("*").over(Window.partitionBy("h"))).filter("df > 1 OR head IS NOT NULL")
    per = shared.groupBy("num").agg(F.count_if(F.col("head").isNull()).alias("k"), F.max("head").alias("head"))
    n, common = F.shiftright("head", 31), F.col("head").bitwiseAND(F.lit((1 << 31) - 1))
    smallest = F.ceil(n * least - 1e-9)
    needed = F.least(8 + F.floor(smallest / 16), F.ceil(smallest * least - 1e-9))
    return per.filter((n > 0) & (F.col("k") + common >= needed)).select("num")


def clusters(sets: DataFrame, least: float) -> DataFrame:
    """(num, cluster): sets brought together by their rarest shared shingles, so that no similar pair is parted. ``sets(num, n, rare, hashes)`` are whole."""
    spark = sets.sparkSession
    rows = sets.select("num", F.explode(F.slice("hashes", F.lit(1), F.col("rare"))).alias("h"))
    shared = stored(rows.withColumn("df", F.count("*").over(Window.partitionBy("h"))).filter("df > 1"), "shared")
    free_shuffles(spark)
    counted = shared.groupBy("num").agg(F.count("*").cast("int").alias("m"))
    of_set = sets.select("num", "n", "rare").join(counted, "num", "left").select("num", "n", "rare", F.coalesce("m", F.lit(0)).alias("m"))
    # All but fewest - 1 of a set's shared shingles, the rarest first.
    spare = (F.col("m") + F.col("n") - F.col("rare") - F.ceil(F.col("n") * least - 1e-9) + 1).cast("int")
    of_set = stored(of_set.withColumn("spare", spare).filter("spare > 0"), "spares")
    place = F.row_number().over(Window.partitionBy("num").orderBy("df", "h"))
    rarest = shared.join(of_set.select("num", "spare"), "num").withColumn("place", place).filter("place <= spare").select("num", "h")
    more = sets.select("num", "hashes").join(of_set.filter("spare > m"), "num").select("num", F.explode(F.slice("hashes", F.col("rare") + 1, F.col("spare") - F.col("m"))).alias("h"))
    met = stored(rarest.unionByName(more), "met")
    drop_stored(shared)
    free_shuffles(spark)
    first = stored(met.groupBy("h").agg(F.min("num").alias("first"), F.count("*").alias("k")).filter("k > 1").select("h", "first"), "firsts")
    found = components(met.join(first, "h").select(F.col("num").alias("a"), F.col("first").alias("b")))
    return found.select(F.col("node").alias("num"), F.col("root").alias("cluster"))


def similar_within(x: list[np.ndarray], y: list[np.ndarray], least: float, columns: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(places in x, places in y) of the pairs of sets with a similarity of ``least`` or more: products of incidence matrices, some columns at a time."""
    sizes = np.array([len(h) for h in (*x, *y)], np.int64)
    _, column, seen = np.unique(np.concatenate([*x, *y]), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sizes)), sizes)[seen[column] > 1]
    column = (np.cumsum(seen > 1) - 1)[column[seen[column] > 1]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(x), len(y)))
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        a, b = np.searchsorted(column, (first, first + columns))
        part = np.zeros((len(sizes), columns), np.float32)
        part[owner[a:b], column[a:b] - first] = 1
        both += part[: len(x)] @ part[len(x) :].T
    union = sizes[: len(x), None] + sizes[None, len(x) :] - both
    return np.nonzero(both / np.maximum(union, 1) >= least)


def _links(frame: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links of a piece as a forest: sets of ``side`` 0 are compared with those of side 1, or with each other where there is one side."""
    frame = frame.sort_values(["side", "num"], kind="stable")
    node, sets = frame["num"].to_numpy(), [np.asarray(h, np.int64) for h in frame["hashes"]]
    n = int((frame["side"] == 0).sum())
    left, right = sets[:n], sets[n:] or sets
    a, b = similar_within(left, right, least)
    # A set can stand on both sides: its places are one.
    own, place = np.unique(node, return_inverse=True)
    root = local_roots(len(own), [(place[:n][a], (place[n:] if n < len(node) else place)[b])])
    linked = root != np.arange(len(own))
    return pd.DataFrame({"a": own[linked], "b": own[root[linked]]})


def tile_links(dealt: DataFrame, least: float) -> DataFrame:
    """(a, b): links inside the pieces of ``dealt(cluster, i, j, side, num, hashes)``."""
    return dealt.groupBy("cluster", "i", "j").applyInPandas(lambda frame: _links(frame, least), "a long, b long")


def own_tile(seed: int, tiles: str = "tiles"):
    return F.pmod(F.xxhash64(F.lit(seed), "num"), tiles).cast("int")


def inside_tiles(sets: DataFrame, seed: int) -> DataFrame:
    """Each set of ``sets(cluster, tiles, num, hashes)`` in one tile of its cluster."""
    return sets.select("cluster", own_tile(seed).alias("i"), F.lit(-1).alias("j"), F.lit(0).alias("side"), "num", "hashes")


def fingerprint_links(classes: DataFrame, rows: DataFrame, repeats: bool, shingle: int, most: int, least: float, tile: int = TILE) -> DataFrame:
    """Links (a, b) among the sets that SimHash brings together: equal fingerprints, and links of the Gray-order index."""
    of_fp = components(near_links(classes.select("fp").distinct(), most)).withColumnRenamed("node", "fp")
    placed = stored(classes.select("num", "fp").join(of_fp, "fp", "left").select("num", F.coalesce("root", "fp").alias("cluster")), "fingerprint-groups")
    shape = placed.groupBy("cluster").agg(F.count("*").alias("rows")).filter("rows > 1").select("cluster", F.ceil(F.col("rows") / tile).cast("int").alias("tiles"))
    met = stored(placed.join(shape, "cluster"), "fingerprint-tiles")
    sets = shingle_sets(texts_of(met.select("num"), rows, classes, repeats), shingle)
    return stored(tile_links(inside_tiles(sets.join(met, "num"), 1), least), "fingerprint-links")


def cluster_links(sets: DataFrame, placed: DataFrame, sure: DataFrame, least: float, tile: int = TILE) -> DataFrame:
    """Links (a, b) that join all similar sets of each cluster, besides those of ``sure(a, b)``. ``placed(num, cluster)``."""

    def rooted(links: DataFrame) -> DataFrame:
        roots = components(links).withColumnRenamed("node", "num")
        return stored(placed.join(roots, "num", "left").select("num", "cluster", F.coalesce("root", "num").alias("root")), "cluster-roots")

    now = rooted(sure)
    shape = now.join(sets.select("num", "n"), "num").groupBy("cluster").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("rows"), F.sum("n").alias("shingles"))
    tiles = F.greatest(F.ceil(F.col("rows") / tile), F.ceil(F.col("shingles") / TILE_SHINGLES)).cast("int")
    open_ = stored(now.join(shape.filter("low <> high").select("cluster", tiles.alias("tiles")), "cluster").select("num", "cluster", "tiles"), "cluster-tiles")
    held = sets.select("num", "hashes").join(open_, "num")
    found = stored(tile_links(inside_tiles(held, 1), least), "tile-links")
    wide = open_.filter("tiles > 1")
    if not wide.isEmpty():
        large = stored(sets.select("num", "hashes").join(wide, "num"), "cluster-sets")
        found = stored(found.unionByName(tile_links(inside_tiles(large, 2), least)), "tile-links")
        now = rooted(sure.unionByName(found)).join(wide.select("num"), "num", "left_semi")
        # Only pairs across groups are open: sets outside their cluster's largest group meet all sets of the cluster.
        largest = now.groupBy("cluster", "root").count().groupBy("cluster").agg(F.max_by("root", F.struct("count", "root")).alias("largest"))
        rest = now.join(largest, "cluster").filter("root <> largest").select("num", "cluster")
        few = stored(rest.groupBy("cluster").agg(F.ceil(F.count("*") / tile).cast("int").alias("few")), "few")
        split = large.join(few, "cluster")
        one = split.join(rest.select("num"), "num", "left_semi").select("cluster", own_tile(3, "few").alias("i"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("j"), F.lit(0).alias("side"), "num", "hashes")
        two = split.select("cluster", F.explode(F.sequence(F.lit(0), F.col("few") - 1)).alias("i"), own_tile(3).alias("j"), F.lit(1).alias("side"), "num", "hashes")
        found = found.unionByName(stored(tile_links(one.unionByName(two), least), "tile-links"))
    return found


def similar_rows(docs: DataFrame, id: str, text: str, shingle: int, least: float, most: int) -> tuple[DataFrame, DataFrame, bool]:
    """(id, digest, node) of each row; (node, row) of each set: the row (none, id, digest) that stands for its group; whether rows repeat."""
    rows = digested(docs, id, text)
    spark = docs.sparkSession
    marked = stored(marked_rows(rows, shingle), "shingles")
    repeats = not marked.groupBy("id", "digest").count().filter("count > 1").isEmpty()
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("row")
    # Written once, so that a set keeps its number.
    classes = stored(marked.groupBy("node", "fp").agg(first).withColumn("num", F.monotonically_increasing_id()), "sets")
    common = common_shingles(rows, shingle)
    sure = fingerprint_links(classes, rows, repeats, shingle, most, least)
    # Before each larger shuffle those of the finished steps go: kept together they take several times the texts' disk.
    free_shuffles(spark)
    some = stored(candidates(first_rows(texts_of(classes.select("num"), rows, classes, repeats), shingle, common, least), least), "candidates")
    free_shuffles(spark)
    sets = stored(shingle_sets(texts_of(some, rows, classes, repeats), shingle, common), "candidate-sets")
    free_shuffles(spark)
    placed = stored(clusters(sets, least), "clusters")
    free_shuffles(spark)
    more = cluster_links(sets, placed, sure, least)
    roots = components(sure.unionByName(more)).withColumnRenamed("node", "num")
    drop_stored(sets)
    rooted = classes.join(roots, "num", "left").select("node", "row", F.coalesce("root", "num").alias("root"))
    # Written first: nothing then stands between the shuffle and the join, which Spark splits for a very large group.
    named = stored(rooted.groupBy("root").agg(F.min("row").alias("row")), "named")
    return marked.select("id", "digest", "node"), rooted.select("node", "root").join(named, "root").select("node", "row"), repeats


def similar_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, least: float = 0.8, most: int = 4) -> DataFrame:
    """(id, component_id) for each row: the smallest id reachable over links of texts with a similarity of ``least`` or more."""
    marked, named, _ = similar_rows(docs, id, text, shingle, least, most)
    return marked.join(named, "node").select(F.col("id").alias(id), F.col("row.id").alias("component_id"))


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, least: float = 0.8, most: int = 4) -> DataFrame:
    """One row of ``docs`` of each group of near copies, unchanged."""
    _, named, repeats = similar_rows(docs, id, text, shingle, least, most)
    whole = docs.select(F.struct("*").alias("doc"), F.col(id).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("digest"))
    chosen = stored(named.select("row.id", "row.digest").distinct(), "kept")
    free_shuffles(docs.sparkSession)
    kept = whole.join(chosen, same_row(whole, chosen), "left_semi")
    return (kept.dropDuplicates(["id", "digest"]) if repeats else kept).select("doc.*")
