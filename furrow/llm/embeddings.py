"""Near-duplicate embeddings by int8 tile products with proven error bounds.

Equal vectors of a label form a class with a number of its own that is compared once. The classes of a label are dealt into tiles by a hash, each pair of tiles is
a piece of work. In a piece every unit vector x is rounded to s * q with q of int8; the error e = |x - s q| is kept for each vector, so

    |x . y - s_x s_y (q_x . q_y)| <= e_x |s_y q_y| + e_y

holds for every pair. The product of two tiles runs over small integers, a run of ``EXACT`` components at a time, whose sums single precision holds exactly; the runs
are added in double precision. Only pairs whose bound reaches the threshold are computed again in double precision. A piece returns for each class its number of
links there and the smallest class it reaches, at most a row for each class, whatever the number of links.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label or id, link with nothing; vectors of
different lengths never link; repeated rows are vectors of their own, also where they share an id: each row has the links of its own vector, and an id that stands
in several components names each of them it is the smallest of. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.components import components, local_roots
from furrow.session import stored

#: Vectors of a tile.
TILE = 2_048
#: Components whose products of int8 values sum to whole numbers under 2^24: 127 * 127 * 1,040 < 2^24.
EXACT = 1_040


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(q as float32 of whole numbers, scales s, lengths |s q|, errors |x - s q|) of rows ``x``; lengths and errors are rounded up."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None])
    back = q * scale[:, None]
    up = 1 + 1e-9
    return q.astype(np.float32), scale, np.linalg.norm(back, axis=1) * up, np.linalg.norm(x - back, axis=1) * up + 1e-12


def near_pairs(x: np.ndarray, y: np.ndarray, threshold: float, block: int = 512):
    """Arrays (row of x, row of y) of pairs of unit rows whose dot product in double precision reaches ``threshold``."""
    qx, sx, lx, ex = quantise(x)
    qy, sy, ly, ey = quantise(y)
    for a in range(0, len(x), block):
        rows = slice(a, a + block)
        product = sum((qx[rows, k : k + EXACT] @ qy[:, k : k + EXACT].T).astype(np.float64) for k in range(0, x.shape[1], EXACT)) * sx[rows, None] * sy
        i, j = np.nonzero(product + ex[rows, None] * ly + ey >= threshold)
        for k in range(0, len(i), 200_000):
            ii, jj = i[k : k + 200_000] + a, j[k : k + 200_000]
            exact = np.einsum("ij,ij->i", x[ii], y[jj]) >= threshold
            yield ii[exact], jj[exact]


def _piece(frame: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links inside a tile, or between two: for each class its links' number of vectors and its root in the piece."""
    frame = frame.sort_values("class", kind="stable")
    x = np.stack(frame["embedding"].to_numpy()).astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    i, j = int(frame["i"].iat[0]), int(frame["j"].iat[0])
    copies, n = frame["copies"].to_numpy(), len(frame)
    left = np.flatnonzero(frame["own"].to_numpy() == i)
    right = left if i == j else np.flatnonzero(frame["own"].to_numpy() == j)
    links = np.zeros(n, np.int64)

    def pairs():
        for a, b in near_pairs(x[left], x[right], threshold):
            a, b = left[a], right[b]
            other = a != b
            a, b = a[other], b[other]
            np.add.at(links, a, copies[b])
            if i != j:
                np.add.at(links, b, copies[a])
            yield a, b

    root = local_roots(n, pairs())
    found = links > 0
    own = frame["class"].to_numpy()
    return pd.DataFrame({"class": own[found], "links": links[found], "root": own[root[found]]})


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.93, id: str = "vec_id", vector: str = "embedding", label: str = "label", tile: int = TILE) -> DataFrame:
    """(id, n_links, component_id, kept) for each row of ``vectors``."""
    rows = vectors.select(F.col(id).alias("id"), F.col(vector).alias("embedding"), F.col(label).alias("label"))
    e = F.col("embedding")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.col("label").isNotNull() & F.col("id").isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda v: v != 0)
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    good = rows.filter("usable").drop("usable")
    counted = good.groupBy("label", "embedding").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    # Written once, so that a class keeps its number.
    classes = stored(counted.withColumn("length", F.size("embedding")).withColumn("class", F.monotonically_increasing_id()), "vector-classes")
    tiles = classes.groupBy("label", "length").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    dealt = (
        classes.join(tiles, ["label", "length"])
        .withColumn("own", F.pmod(F.xxhash64("class"), F.col("tiles")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("label", "length", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "class", "copies", "embedding")
    )
    keys = ["label", "length", "i", "j"]
    found = stored(dealt.groupBy(*keys).applyInPandas(lambda frame: _piece(frame, threshold), "class long, links long, root long"), "vector-links")
    counts = found.groupBy("class").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("class").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "class")
    rooted = classes.select("class", "least", "copies").join(roots, "class", "left").join(counts, "class", "left").select("class", "least", "copies", "links", F.coalesce("root", "class").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = rooted.join(named, "root").select("class", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = good.join(classes.select("class", "label", "embedding").join(of_class, "class"), ["label", "embedding"]).select("id", "n_links", "component_id")
    alone = rows.filter("NOT usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
