"""SimHash groups, embedding links and components against brute force."""

import numpy as np
import pytest

from furrow.llm import embeddings, simhash
from furrow.llm.components import components
from furrow.session import table


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def brute_components(nodes, links):
    parent = {n: n for n in nodes}
    for a, b in links:
        ra, rb = find(parent, a), find(parent, b)
        parent[max(ra, rb)] = min(ra, rb)
    return {n: find(parent, n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(5001, 5100)]
    df = spark.createDataFrame([*links, (None, 3), (7, 7)], "a long, b long")
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert {r.node: r.root for r in components(df).collect()} == brute_components(nodes, [x for x in links if x[0] != x[1]])
    assert components(df.filter("a = b")).count() == 0


def plain_fingerprint(text):
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(fps, ids, most):
    """Smallest reachable id of each row, from the full matrix of differences."""
    u = np.unique(np.array(fps, np.uint64))
    a, b = np.nonzero(np.bitwise_count(u[:, None] ^ u[None, :]) <= most)
    root = brute_components(range(len(u)), zip(a.tolist(), b.tolist()))
    place = {int(f): k for k, f in enumerate(u)}
    least = {}
    for f, i in zip(fps, ids):
        if i is not None:
            r = root[place[f]]
            least[r] = min(least.get(r, i), i)
    return [least.get(root[place[f]]) for f in fps]


@pytest.mark.parametrize("which,tile", [("odd", 20_000), ("small", 20_000), ("small", 3)])
def test_near_duplicates(spark, odd, small, which, tile):
    docs = odd if which == "odd" else table(spark, small, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    fps = [plain_fingerprint(t) for _, t in rows]
    want = sorted(zip([i for i, _ in rows], fps, brute_groups(fps, [i for i, _ in rows], 2)), key=repr)
    got = [(r[0], r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs, tile=tile).collect()]
    assert sorted(got, key=repr) == want


def test_near_duplicates_of_nothing(none):
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("tile", [20_000, 40])
@pytest.mark.parametrize("most", [1, 2, 4])
def test_links_of_crowded_bands(spark, tile, most):
    """Families around a few centres, so that band values are crowded and tiles are needed."""
    rng = np.random.default_rng(1)
    fps = []
    for centre in rng.integers(0, 1 << 63, 6, dtype=np.uint64):
        for _ in range(150):
            flip = 0
            for bit in rng.integers(0, 64, rng.integers(0, 9)):
                flip ^= 1 << int(bit)
            fps.append(int(centre) ^ flip)
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    links = [(r.a, r.b) for r in simhash.near_links(df, most, tile).collect()]
    place = {f: k for k, f in enumerate(signed)}
    root = brute_components(range(len(fps)), [(place[a], place[b]) for a, b in links])
    assert [fps[root[k]] for k in range(len(fps))] == brute_groups(fps, fps, most)


def test_index_finds_every_pair():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base ^ np.uint64(1 << int(b)) for b in rng.integers(0, 63, 30)]))
    index = simhash.GrayIndex(fps)
    q, place = index.search(fps, 2)
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2))}
    assert {(int(a), int(b)) for a, b in zip(q, index.order[place])} == want
    ranks = simhash.gray_rank(np.array([0, 1, 3, 2, 6, 7, 5, 4], np.uint64))
    assert ranks.tolist() == list(range(8))


def brute_vectors(rows, threshold=0.93):
    """Components of rows, not of ids: rows that share an id have links of their own."""
    usable = [v is not None and la is not None and i is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v, la in rows]
    links, n = [], [0] * len(rows)
    for a in range(len(rows)):
        for b in range(len(rows)):
            if a != b and usable[a] and usable[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], np.float64), np.array(rows[b][1], np.float64)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    n[a] += 1
                    links.append((a, b))
    root = brute_components(range(len(rows)), links)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[root[k]] = min(least.get(root[k], i), i)
    return sorted(((i, n[k], least.get(root[k]), i == least.get(root[k])) for k, (i, _, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("tile", [2048, 7])
def test_vectors(spark, tile):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(160):
        v = rng.normal(size=8) if k % 3 or k < 2 else np.array(rows[k - 2][1]) + rng.normal(size=8) * 0.2
        rows.append((k, [float(np.float32(x)) for x in v], int(k % 2)))
    rows += [(200 + k, rows[4][1], 0) for k in range(9)] + [(300, None, 1), (301, [], 1), (302, [0.0] * 8, 1), (303, [float("nan")] * 8, 1), (304, [1.0, None], 1), (305, rows[0][1], None), (306, [1.0, 2.0], 1), (307, [2.0, 4.0], 1), (308, [float("inf"), 1.0], 1)]
    df = spark.createDataFrame([(i, v, la, "x", 0) for i, v, la in rows], "vec_id long, embedding array<float>, label int, root string, copies int")
    got = sorted((tuple(r) for r in embeddings.near_duplicate_vectors(df, tile=tile).collect()), key=repr)
    assert got == brute_vectors(rows)
    assert embeddings.near_duplicate_vectors(df.limit(0)).count() == 0


def test_vectors_that_share_an_id(spark):
    rows = [(1, [1.0, 0.0, 0.0], 0), (1, [0.0, 1.0, 0.0], 0), (2, [1.0, 0.0, 0.0], 0), (3, [1.0, 0.01, 0.0], 0), (4, [0.0, 0.0, 1.0], 0), (0, [0.0, 0.99, 0.01], 0), (None, [1.0, 0.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((tuple(r) for r in embeddings.near_duplicate_vectors(df).collect()), key=repr)
    assert got == brute_vectors(rows) and (1, 1, 0, False) in got and (1, 2, 1, True) in got


def test_products_of_long_vectors_are_exact():
    x = np.full((2, 4096), 1 / 64.0)
    q, _, _, _ = embeddings.quantise(x)
    assert (q == 127).all() and 127 * 127 * embeddings.EXACT < 1 << 24
    assert [(a.tolist(), b.tolist()) for a, b in embeddings.near_pairs(x, x, 1 - 1e-12)] == [([0, 0, 1, 1], [0, 1, 0, 1])]


def test_bounds_hold():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 64)) * rng.lognormal(size=(60, 1))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q, s, length, error = embeddings.quantise(x)
    gap = np.abs(x @ x.T - (q @ q.T) * s[:, None] * s)
    assert (gap <= error[:, None] * length + error).all()
