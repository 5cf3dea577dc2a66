"""SimHash near-duplicates through a Gray-order hierarchical index.

A text's fingerprint has a bit set where more than half of its shingles' hashes have it. Fingerprints within a few bits are
linked; the smallest id reachable over links names a document's group.

Spark deals distinct fingerprints into bands: with d differing bits allowed, at least one of d + 1 bands of bits is equal in both, so every
link meets in the band that it shares. A band's value with very many fingerprints is dealt into tiles by a hash, and each pair of tiles is
its own piece of work, so no group of any size meets in one task. Inside a piece fingerprints are sorted by Gray rank; runs of
neighbours share bits, which are factored into a node (mask and pattern), runs of nodes into upper nodes. A search keeps for each node the
differences gathered on the way down and drops the whole group once they exceed the limit. A piece returns its links as a forest (each
fingerprint with the smallest it reaches there), which has at most a row for each fingerprint, whatever the number of links.

Defined results: null and empty texts, and those without words, have fingerprint zero and are linked like any other; equal fingerprints are
always linked; a group whose ids are all null has a null component; repeated rows each keep their row; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.batches import map_texts
from furrow.llm.components import components, local_roots
from furrow.session import stored

SEED = 42
#: Fingerprints of one band value that are searched in one piece; larger groups are dealt into pairs of tiles.
TILE = 20_000


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned 64-bit SimHash of a text's lower-cased word shingles."""
    import xxhash

    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = [b" ".join(s) for s in zip(*(words[k:] for k in range(shingle)))] or [b" ".join(words)]
    h = xxhash.xxh64_intdigest
    total, most = np.zeros(64, np.int64), 1 << 16
    for k in range(0, len(joined), most):
        hashes = np.array([h(s, SEED) for s in joined[k : k + most]], np.uint64)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(joined), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of each row as a signed long."""

    return map_texts(docs.select(id, text), text, "fp long", lambda: lambda texts: [np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)])


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """The place of each fingerprint in Gray-code order."""
    rank = fp.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Fingerprints in Gray order under nodes that hold the bits common to a run of ``fanout`` children."""

    def __init__(self, fps: np.ndarray, fanout: int = 8):
        self.order = np.argsort(gray_rank(fps), kind="stable")
        self.fps, self.fanout = fps[self.order], fanout
        #: From the leaves up: (mask of bits common to the group, their pattern).
        self.levels: list[tuple[np.ndarray, np.ndarray]] = [(np.full(len(fps), ~np.uint64(0)), self.fps)]
        while len(self.levels[-1][0]) > fanout:
            mask, pattern = self.levels[-1]
            starts = np.arange(0, len(mask), fanout)
            same = ~(np.bitwise_or.reduceat(pattern, starts) ^ np.bitwise_and.reduceat(pattern, starts)) & np.bitwise_and.reduceat(mask, starts)
            self.levels.append((same, pattern[starts] & same))

    def search(self, queries: np.ndarray, most: int):
        """(number of the query, place in the sorted fingerprints) of all pairs within ``most`` bits."""
        mask, pattern = self.levels[-1]
        q, node = np.repeat(np.arange(len(queries)), len(mask)), np.tile(np.arange(len(mask)), len(queries))
        gathered = np.bitwise_count((queries[q] ^ pattern[node]) & mask[node])
        for level in range(len(self.levels) - 2, -1, -1):
            keep = gathered <= most
            q, node, gathered = q[keep], node[keep], gathered[keep]
            upper_mask = mask[node]
            mask, pattern = self.levels[level]
            child = (node[:, None] * self.fanout + np.arange(self.fanout)).ravel()
            q, gathered, upper_mask = np.repeat(q, self.fanout), np.repeat(gathered, self.fanout), np.repeat(upper_mask, self.fanout)
            real = child < len(mask)
            q, node, gathered, upper_mask = q[real], child[real], gathered[real], upper_mask[real]
            # Only the bits that the upper node had not fixed are compared here.
            gathered = gathered + np.bitwise_count((queries[q] ^ pattern[node]) & mask[node] & ~upper_mask)
        keep = gathered <= most
        return q[keep], node[keep]


def forest(fps: np.ndarray, most: int, block: int = 512) -> np.ndarray:
    """For each of the distinct ``fps`` the place of the root of its linked group."""
    n = len(fps)
    if n == 1:
        return np.zeros(1, np.int64)
    if n <= 48:
        a, b = np.triu_indices(n, 1)
        near = np.bitwise_count(fps[a] ^ fps[b]) <= most
        return local_roots(n, [(a[near], b[near])])
    index = GrayIndex(fps)

    def pairs():
        for k in range(0, n, block):
            q, place = index.search(fps[k : k + block], most)
            yield q + k, index.order[place]

    return local_roots(n, pairs())


def bands(most: int) -> list[tuple[int, int]]:
    """(shift, bits) of ``most`` + 1 bands that cover 64 bits."""
    cuts = [64 * k // (most + 1) for k in range(most + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def band_keys(classes: DataFrame, most: int, tile: int) -> DataFrame:
    """(band, value, i, j, fp): each fingerprint once for each band, and again for each pair of tiles where its band value is crowded."""
    keys = F.array(*[F.struct(F.lit(k).alias("band"), F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << n) - 1)).alias("value")) for k, (s, n) in enumerate(bands(most))])
    rows = classes.select("fp", F.explode(keys).alias("key")).select("fp", "key.band", "key.value")
    crowded = rows.groupBy("band", "value").count().filter(F.col("count") > tile).select("band", "value", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    dealt = rows.join(crowded, ["band", "value"], "left").select("fp", "band", "value", F.coalesce("tiles", F.lit(1)).alias("tiles"))
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("tiles")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    return dealt.select("fp", "band", "value", own.alias("own"), other.alias("other")).select("band", "value", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")


def near_links(classes: DataFrame, most: int = 2, tile: int = TILE) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``classes(fp)`` that join all of those within ``most`` bits."""
    keys = ["band", "value", "i", "j"]
    dealt = band_keys(classes, most, tile).repartition(*keys).sortWithinPartitions(*keys, "fp")

    def run(batches):
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if not len(pdf):
                continue
            rows = pdf[keys].to_numpy()
            cuts = np.flatnonzero((rows[1:] != rows[:-1]).any(axis=1)) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            rest = pdf.iloc[last:]
            yield _linked(pdf["fp"].to_numpy()[:last], cuts[:-1], most)
        if rest is not None:
            yield _linked(rest["fp"].to_numpy(), np.zeros(0, np.int64), most)

    return dealt.mapInPandas(run, "a long, b long").distinct()


def _linked(fps: np.ndarray, cuts: np.ndarray, most: int) -> pd.DataFrame:
    """The forests of the groups between ``cuts``; groups of one are passed over."""
    a, b = [], []
    if len(fps):
        starts, ends = np.append(0, cuts).astype(int), np.append(cuts, len(fps)).astype(int)
        for k in np.flatnonzero(ends - starts > 1):
            group = fps[starts[k] : ends[k]].view(np.uint64)
            root = forest(group, most)
            linked = root != np.arange(len(group))
            a.append(group[linked].view(np.int64))
            b.append(group[root[linked]].view(np.int64))
    empty = [np.zeros(0, np.int64)]
    return pd.DataFrame({"a": np.concatenate(a or empty), "b": np.concatenate(b or empty)})


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 3, most: int = 2, tile: int = TILE) -> DataFrame:
    """(id, fp, component_id) for each row: fingerprint as a signed long and the smallest id reachable over links of ``most`` bits or fewer."""
    marked = stored(fingerprints(docs, id, text, shingle), "fingerprints")
    classes = stored(marked.groupBy("fp").agg(F.min(id).alias("least")), "classes")
    roots = components(near_links(classes.select("fp"), most, tile)).select(F.col("node").alias("fp"), "root")
    rooted = classes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = rooted.join(named, "root").select("fp", "component_id")
    return marked.join(of_fp, "fp").select(id, "fp", "component_id")


def hex_fingerprint(fp):
    """Sixteen lower-case hex digits of a signed long column."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
