"""Mixing: targets, exact quotas, disjoint draws and repeatability."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.llm import mixing
from furrow.llm.queries import QUERIES
from furrow.session import table


def brute_targets(sizes):
    """The capped shares by bisection on the common rate."""
    weight = [(5, 2, 1)[k % 3] for k in range(len(sizes))]
    low, high = 0.0, 1e12
    for _ in range(300):
        rate = (low + high) / 2
        got = sum(min(rate * w, 2 * s) for w, s in zip(weight, sizes))
        low, high = (rate, high) if got < 1.5 * sum(sizes) else (low, rate)
    return [min(low * w, 2 * s) for w, s in zip(weight, sizes)]


@pytest.mark.parametrize("sizes", [[100] * 20, [1000, 1, 5, 70, 900000, 3], [7], [0, 0, 5], []])
def test_targets(sizes):
    assert mixing.targets(sizes) == pytest.approx(brute_targets(sizes), rel=1e-6, abs=1e-6) if sum(sizes) else True


def test_tree_keeps_quotas():
    quotas = np.array([10, 0, 500, 3, 77])
    parts = mixing.split_tree(quotas, 7, np.random.default_rng(0))
    assert (parts.sum(axis=0) == quotas).all() and parts.sum(axis=1).max() - parts.sum(axis=1).min() <= 1 and (parts >= 0).all()
    big = mixing.split_tree(np.array([5 * 10**9, 3 * 10**9]), 4, np.random.default_rng(0))
    assert (big.sum(axis=0) == [5 * 10**9, 3 * 10**9]).all() and (big >= 0).all()


@pytest.mark.parametrize("n", [1, 2, 3, 4, 12, 97, 360, 1000])
def test_permutation(spark, n):
    keys = F.array(*[F.lit(int(k)) for k in np.random.default_rng(n).integers(0, n, mixing.ROUNDS)]).cast("array<long>")
    got = [r.p for r in spark.range(n).orderBy("id").select(mixing.permuted(F.col("id"), keys, F.lit(n).cast("long")).alias("p")).collect()]
    assert sorted(got) == list(range(n))
    if n > 300:  # no stride: neighbours lie at many different distances
        assert len({(b - a) % n for a, b in zip(got, got[1:])}) > n / 3


@pytest.mark.parametrize("which", ["odd", "small"])
def test_mix(spark, odd, small, which):
    docs = odd if which == "odd" else table(spark, small, "documents")
    rows = mixing.mix(docs, block=16).select("doc_id", "text", "source", "size", "source_size", "target", "draws").collect()
    assert len(rows) == docs.count()
    sizes, per_source, taken, seen, shards = {}, {}, {}, {}, {}
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        per_source[r.source] = (r.source_size, r.target)
        own = {}
        for d in r.draws:
            assert 0 <= d.first_word < d.end_word <= r.size and 0 <= d.shard < 16
            for k in range(d.first_word, d.end_word):
                own[d["pass"], k] = own.get((d["pass"], k), 0) + 1
            shards[d.shard] = shards.get(d.shard, 0) + d.end_word - d.first_word
        assert max(own.values(), default=1) == 1  # a pass takes no word twice
        assert len(own) <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + len(own)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    for source, goal in zip(order, brute_targets([sizes[s] for s in order])):
        assert per_source[source][0] == sizes[source] and per_source[source][1] == pytest.approx(goal, rel=1e-6, abs=1e-6)
        assert abs(taken[source] - goal) <= 64
    if which == "small":
        assert max(shards.values()) - min(shards.values()) < 0.1 * max(shards.values())


def test_reruns_agree(spark, small, none):
    one = QUERIES["op2_mix_sources"](spark, small)
    assert sorted(one.collect()) == sorted(QUERIES["op2_mix_sources"](spark, small).collect())
    assert mixing.mix(none).count() == 0


def all_to_the_first(quotas, shards, rng):
    out = np.zeros((shards, len(quotas)), np.int64)
    out[0] = quotas
    return out


def half_lost(quotas, shards, rng):
    return split_tree(quotas, shards, rng) // 2


split_tree = mixing.split_tree


@pytest.mark.parametrize("damaged,taken_changes", [(all_to_the_first, False), (half_lost, True)])
def test_a_damaged_tree_changes_the_query(spark, small, monkeypatch, damaged, taken_changes):
    get = lambda: sorted(map(tuple, QUERIES["op2_mix_sources"](spark, small).collect()))
    whole = get()
    monkeypatch.setattr(mixing, "split_tree", damaged)
    broken = get()
    assert whole != broken and (sum(r[4] for r in whole) != sum(r[4] for r in broken)) == taken_changes


def test_shards_hold_what_the_tree_gives_them(spark, small):
    docs = table(spark, small, "documents")
    rows = QUERIES["op2_mix_sources"](spark, small).collect()
    shards = np.array([[int(x) for x in r.shard_words.split(",")] for r in rows])
    assert shards.sum(axis=1).tolist() == [r.taken for r in rows] and shards.sum(axis=0).max() < 1.1 * shards.sum(axis=0).min()
    out = mixing.drawn_texts(docs, shards=3)
    parts = out.rdd.glom().collect()
    assert len([p for p in parts if p]) <= 3 and sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for p in parts for r in p) == shards.sum()
    longest = max(parts, key=len)
    assert len({r.source for r in longest[:40]}) > 3 and [r.doc_id for r in longest] != sorted(r.doc_id for r in longest)


def test_any_column_names(spark):
    names = ["doc_id", "text", "source", "draws", "quota", "blocks", "keys", "size", "target", "place", "shard", "slot", "name", "none", "c0"]
    rows = [(k, "w " * (k % 7), "ab"[k % 2], *["x"] * (len(names) - 3)) for k in range(30)] + [(None, "a b", None, *["x"] * (len(names) - 3))] * 2
    docs = spark.createDataFrame(rows, ", ".join(f"{n} {'long' if n == 'doc_id' else 'string'}" for n in names))
    assert mixing.mix(docs).count() == 32
    out = mixing.drawn_texts(docs)
    assert out.columns == names and {tuple(r)[3:] for r in out.collect()} == {("x",) * (len(names) - 3)}
    none = docs.limit(0)
    assert mixing.drawn_texts(none).count() == 0 and mixing.mix(none).count() == 0
