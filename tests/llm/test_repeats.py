"""Repeated strings: the index against plain search, the removal against a dictionary of all strings."""

import hashlib

import numpy as np
import pytest

from furrow.llm import repeats
from furrow.llm.queries import QUERIES
from furrow.session import table

LAST = (1 << 63) - 1


def plain(docs, length):
    """Every string with its least (id, start); rows with what is left."""
    first: dict = {}
    texts = [(LAST if i is None else i, i, (t or "").encode()) for i, t in docs]
    for key, _, t in texts:
        for k in range(len(t) - length + 1):
            s = t[k : k + length]
            first[s] = min(first.get(s, (key, k)), (key, k))
    out = []
    for key, i, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - length + 1):
            if first[t[k : k + length]] < (key, k):
                gone[k : k + length] = True
        edges = np.flatnonzero(np.diff(gone[:-1].astype(int), prepend=0, append=0)).tolist() if t else []
        kept = bytes(c for c, g in zip(t, gone.tolist()) if not g)
        out.append((i, len(t), tuple(zip(edges[::2], edges[1::2])), kept))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r[0], r.n_bytes, tuple(map(tuple, r.spans)), bytes(r.kept)) for r in df.collect()), key=repr)


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_index():
    """Order of suffixes, rows that share a prefix, and matching statistics of patterns inside and outside the index."""
    rng = np.random.default_rng(1)
    for _ in range(120):
        texts = [bytes(rng.integers(97, 99 + rng.integers(0, 3), rng.integers(12, 70)).astype(np.uint8)) for _ in range(rng.integers(1, 12))]
        texts += [texts[0]] * 2
        index = repeats.RunLengthIndex(texts, 12)
        data = index.data.tobytes()
        assert index.order.tolist() == [i for _, i in sorted((data[i : data.index(b"\xff", i) + 1], i) for i in range(len(data)))]
        assert len(index.starts) <= len(data) and sum(index.ends - index.starts) == len(data)
        group = np.searchsorted(index.groups, np.arange(len(data)), "right")
        for a in range(len(data) - 1):
            x, y = (data[p : p + 12] for p in index.order[a : a + 2].tolist())
            assert (group[a] == group[a + 1]) == (x == y and b"\xff" not in x and len(x) == 12)
        patterns = [bytes(rng.integers(97, 102, rng.integers(1, 60)).astype(np.uint8)) for _ in range(4)] + [texts[0][5:30] + texts[-1][2:20], b"abz" + texts[0], b"", *texts]
        joined, steps = b"\xff".join(texts), 0
        for who, at, row, length in index.stream(patterns):
            for w, a, r, n in zip(who.tolist(), at.tolist(), row.tolist(), length.tolist()):
                best, steps = 0, steps + 1
                while a + best < len(patterns[w]) and patterns[w][a : a + best + 1] in joined:
                    best += 1
                assert best == n and (not n or data[index.order[r] :][:n] == patterns[w][a : a + n])
        assert steps == sum(map(len, patterns))


def test_anchors_cover_every_string():
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (0, 39, 40, 41, 500)] + [b"a" * 300, b"ab" * 90]
    sizes, data = np.array([len(t) for t in texts]), np.frombuffer(b"".join(t + b"\xff" for t in texts), np.uint8)
    first, n, place, key = repeats.anchor_runs(data, sizes, 40)
    begins, anchor_of = np.concatenate([[0], np.cumsum(sizes + 1)]), {}
    starts = [s for a, m in zip(first.tolist(), n.tolist()) for s in range(a, a + m)]
    assert sorted(starts) == [int(b) + k for b, s in zip(begins, sizes) for k in range(s - 39)] and len(set(starts)) == len(starts)
    raw = data.tobytes()
    for a, m, p, k in zip(first.tolist(), n.tolist(), place.tolist(), key.tolist()):
        for s in range(a, a + m):
            assert anchor_of.setdefault(raw[s : s + 40], (p - s, k)) == (p - s, k)


@pytest.mark.parametrize("length, most, group, pack", [(100, 3000, 1_500_000, 2_000_000), (100, 2, 5_000, 30_000)])
def test_documents(spark, small, length, most, group, pack):
    """Also with tiny packs and groups and anchors that are split again and again."""
    docs = table(spark, small, "documents")
    assert rows_of(repeats.remove_repeats(docs, length=length, most=most, group_bytes=group, pack_bytes=pack)) == plain(texts_of(docs), length)


def test_query(spark, small):
    want = [(i, n, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest()) for i, n, spans, kept in plain(texts_of(table(spark, small, "documents")), 100)]
    assert sorted(map(tuple, QUERIES["op13_repeated_strings"](spark, small).collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("most", [3000, 1])
def test_strange_rows(spark, odd, none, most):
    """Nulls, a long text that repeats itself, repeated and null ids, texts of about the length, signs of several bytes, clashing names."""
    more = [(20, "x" * 99), (21, "x" * 100), (22, "x" * 101), (None, "x" * 100), (None, "é日" * 60), (23, "日é" * 60), (23, "日é" * 60), (24, "ab" * 30 + "c" + "ab" * 90)]
    # One passage between many different neighbours.
    more += [(100 + k, f"{k * 7919 % 1000:03d} " * 9 + "a passage that many documents share, of some hundred and forty bytes, so that strings of a hundred lie wholly inside of it, and also across its ends. " + f"{k * 104729 % 997:03d} " * 9) for k in range(40)]
    docs = odd.withColumnsRenamed({"size": "key", "label": "pack", "n_tokens": "kept"}).drop("n_chars")
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    got = rows_of(repeats.remove_repeats(docs, most=most))
    assert got == plain(texts_of(docs), 100)
    assert repeats.remove_repeats(none).count() == 0
