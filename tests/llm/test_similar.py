"""The near-duplicate stage of the pipeline against all pairs of shingle sets."""

import os
import random
import re
import time

import numpy as np
import pytest

import corpus_pipeline as P
from furrow.llm import similar
from furrow.session import table
from tests.llm.test_near import brute_components


def plain_sets(texts):
    out = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    return out


def brute(rows):
    sets = plain_sets([t for _, t in rows])
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    roots = brute_components(range(len(rows)), links)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[roots[k]] = min(least.get(roots[k], i), i)
    return sorted((i, least[roots[k]]) for k, (i, _) in enumerate(rows))


def near_copies():
    """Families of copies with some words changed, on both sides of 0.8, one large family, and unlike texts that share a passage."""
    rng, rows = random.Random(3), []
    word = lambda: f"w{rng.randrange(50_000)}"
    for family in range(30):
        base = [word() for _ in range(rng.choice([6, 40, 120, 400]))]
        for _ in range(60 if family == 0 else 5):
            copy = list(base)
            for _ in range(rng.randrange(1 + len(base) // 40)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    passage = " ".join(word() for _ in range(60))
    rows += [" ".join(word() for _ in range(rng.randrange(2, 30))) + " " + passage for _ in range(40)] + [None, "", " ", "One two", "one  TWO"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_groups_against_all_pairs(spark):
    rows = near_copies()
    got = similar.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == brute(rows)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert similar.similar_groups(none).count() == 0


def test_stage_keeps_one_of_near_copies(spark, small):
    rows = near_copies()
    kept = P.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), small)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in brute(rows)})


def test_shuffles_of_finished_steps_are_freed(spark, monkeypatch):
    """When a large step begins, no file of the shuffles before it stands on the disks."""
    folders = [f.getPath() for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {n for folder in folders for _, _, names in os.walk(folder) for n in names if n.startswith("shuffle_")}
    docs, before, left, write = spark.createDataFrame(near_copies(), "doc_id long, text string"), files(), {}, similar.stored

    def watched(df, name="stored", *more):
        end = time.time() + 3  # Spark's cleaner works beside the job
        while (now := files() - before) and name in ("candidates", "candidate-sets") and time.time() < end:
            time.sleep(0.1)
        left[name] = len(now)
        return write(df, name, *more)

    monkeypatch.setattr(similar, "stored", watched)
    assert similar.keep_one(docs).count()
    assert max(left.values()) > 20 and (left["candidates"], left["candidate-sets"]) == (0, 0), left


@pytest.mark.parametrize("tile", [512, 7])
def test_clusters_of_several_tiles(spark, monkeypatch, tile):
    """Without any link from SimHash, and with clusters dealt to many tiles, all pairs are still found."""
    rows = near_copies()
    monkeypatch.setattr(similar, "fingerprint_links", lambda *a, **k: spark.createDataFrame([], "a long, b long"))
    monkeypatch.setattr(similar.cluster_links, "__defaults__", (tile,))
    got = similar.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == brute(rows)


@pytest.mark.parametrize("seen", [2, 10**9])
def test_common_shingles_change_no_result(spark, monkeypatch, seen):
    """Nearly all shingles taken for common, or none, with and without SimHash."""
    rows = near_copies()
    find = similar.common_shingles
    monkeypatch.setattr(similar, "SAMPLE", 1)
    monkeypatch.setattr(similar, "common_shingles", lambda *a: find(*a, seen=seen))
    monkeypatch.setattr(similar, "fingerprint_links", lambda *a, **k: spark.createDataFrame([], "a long, b long"))
    got = similar.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == brute(rows)


def test_products_of_incidence():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))) for _ in range(40)]
    want = {(i, j) for i, a in enumerate(sets[:15]) for j, b in enumerate(sets[15:]) if len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.4}
    a, b = similar.similar_within(sets[:15], sets[15:], 0.4, columns=7)
    assert want and set(zip(a.tolist(), b.tolist())) == want


def test_rows_without_an_id_or_with_one_id(spark):
    """Distinct texts of one id, and texts without an id, are documents of their own and near copies of others."""
    base = " ".join(f"w{k}" for k in range(100))
    near, other = base.replace("w50 ", "x "), " ".join(f"v{k}" for k in range(100))
    docs = spark.createDataFrame([(7, base), (10, near), (10, other), (10, other), (None, other), (None, "alone here"), (None, "alone here"), (9007199254740993, "large id")], "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in similar.keep_one(docs).collect()), key=repr)
    assert kept == sorted([(7, base), (10, other), (None, "alone here"), (9007199254740993, "large id")], key=repr)
    groups = sorted(((r.doc_id, r.component_id) for r in similar.similar_groups(docs).collect()), key=repr)
    assert groups == sorted([(7, 7), (10, 7), (10, 10), (10, 10), (None, 10), (None, None), (None, None), (9007199254740993, 9007199254740993)], key=repr)


def test_small_table(spark, small):
    rows = [(r.doc_id, r.text) for r in table(spark, small, "documents").select("doc_id", "text").collect()]
    got = similar.similar_groups(table(spark, small, "documents"))
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == brute(rows)
