"""Quality, language identification, language-model scores: exact parts against plain versions, models on held-out rows."""

import itertools
import math
import sys
import timeit
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.llm import langid, lm, quality
from furrow.llm.queries import QUERIES
from furrow.session import table

MIDDLE = "/root/testdata/sf0.01"


def test_marginals_against_all_paths():
    rng = np.random.default_rng(0)
    for sizes in ([1], [4, 0, 2, 5], [3, 1]):
        scores, trans = rng.normal(size=(sum(sizes), 3)), rng.normal(size=(3, 3))
        got, pairs = langid.forward_backward(scores, np.array(sizes), trans)
        want_pairs, at = np.zeros((3, 3)), 0
        start = np.log(np.exp(trans).mean(axis=0))  # a text begins as if after a word of any language
        for n in sizes:
            total, marginal, moves = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
            for path in itertools.product(range(3), repeat=n):
                if n:
                    w = math.exp(start[path[0]] + sum(scores[at + k, y] for k, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
                    total += w
                    for k, y in enumerate(path):
                        marginal[k, y] += w
                    for a, b in zip(path, path[1:]):
                        moves[a, b] += w
            if n:
                assert got[at : at + n] == pytest.approx(marginal / total)
                want_pairs += moves / total
            at += n
        assert pairs == pytest.approx(want_pairs)


def test_long_sequences_are_exact():
    rng = np.random.default_rng(1)
    sizes = np.array([5, 700, 64, 65, 1, 200])
    scores, trans = rng.normal(size=(sizes.sum(), 4)), rng.normal(size=(4, 4))
    got, _ = langid.forward_backward(scores, sizes, trans)
    m, at = np.exp(trans), 0
    for n in sizes:
        psi, alpha, beta = np.exp(scores[at : at + n]), [], [np.ones(4)]
        now = np.full(4, 0.25)
        for p in psi:
            now = now @ m * p
            now /= now.sum()
            alpha.append(now)
        for p in psi[:0:-1]:
            b = m @ (p * beta[-1])
            beta.append(b / b.sum())
        g = np.array(alpha) * np.array(beta[::-1])
        assert got[at : at + n] == pytest.approx(g / g.sum(axis=1, keepdims=True))
        at += n


def test_language_of_held_out_documents(spark):
    docs = table(spark, MIDDLE, "documents").select("doc_id", "lang")
    got = QUERIES["op1_language_id"](spark, MIDDLE).join(docs, "doc_id").filter("held_out").collect()
    assert len(got) > 200 and np.mean([r.lang == r.lang_pred for r in got]) > 0.99 and all(0 <= r.score <= 1 for r in got)


def test_code_switched_words_are_labelled(spark):
    docs = table(spark, MIDDLE, "documents")
    model = langid.train(docs, F.col("doc_id") % 2 == 0)
    rows = docs.filter("doc_id % 2 = 1 AND n_chars > 900").select("lang", "text").orderBy("doc_id").limit(40).collect()
    right = words = 0
    for a, b in zip(rows, rows[1:]):
        parts = [(r.lang, " ".join(r.text.split()[:60])) for r in (a, b, a)]
        marginals, n = model.label_words([" ".join(p for _, p in parts)])
        truth = [la for la, p in parts for _ in langid.WORDS.findall(p.lower())]
        assert n.tolist() == [len(truth)]
        right += sum(model.languages[k] == t for k, t in zip(marginals.argmax(axis=1), truth))
        words += len(truth)
    assert right / words > 0.95


def test_language_of_odd_rows(odd, none):
    model = langid.train(odd, F.lit(True))
    got = {(r.doc_id, r.lang_pred): r.score for r in langid.identify(odd, model).collect()}
    assert len(got) == 11 and all((k, "und") in got and got[k, "und"] == 0 for k in (1, 2, 3)) and model.languages == ("de", "en", "fr")
    assert langid.Model.from_bytes(model.to_bytes()).predict(["the thing"]) == model.predict(["the thing"])
    assert langid.train(none, F.lit(True)) is None and langid.identify(none, None).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}


def test_numbers_are_no_letters(spark):
    """Superscripts, fractions, circled and Roman numerals and digits of other scripts: none is of category L."""
    docs = spark.createDataFrame([(1, "²½ Ⅷ ①"), (2, "123"), (3, "١٢"), (4, "the ² thing")], "doc_id long, text string")
    model = langid.train(docs.withColumn("lang", F.lit("en")).filter("doc_id = 4"), F.lit(True))
    assert sorted((r.doc_id, r.lang_pred, r.score > 0) for r in langid.identify(docs, model).collect()) == [(1, "und", False), (2, "und", False), (3, "und", False), (4, "en", True)]
    assert langid.WORDS.findall("a²b 一 é_x ªº") == ["a", "b", "一", "é", "x", "ªº"]


def test_words_of_texts_are_found_fast():
    """The words are those of the pattern for every sign there is; searching whole texts with it took most of a prediction's time."""
    signs = "".join(f"a{chr(c)}b " for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    assert langid.words_of(signs) == langid.WORDS.findall(signs.lower())
    text = "Of the thing that is there été où ça naïve " * 2000
    seconds = lambda f: min(timeit.repeat(f, number=1, repeat=3))
    assert langid.words_of(text) == langid.WORDS.findall(text.lower())
    assert 2 * seconds(lambda: langid.Model(("a", "b"), np.zeros((1 << langid.BITS, 2)), np.zeros((2, 2)), np.zeros(0, np.uint64)).predict([text])) < seconds(lambda: langid.WORDS.findall(text.lower()))


def test_isotonic_against_plain_means():
    raw = np.arange(6.0)
    x, p = quality.isotonic(raw, np.ones(6), np.array([0, 1, 0, 0, 1, 1.0]))
    assert p.tolist() == pytest.approx([0, 1 / 3, 1]) and (np.diff(p) > 0).all() and x.tolist() == pytest.approx([0, 2, 4.5])


def test_features_approach_the_kernel():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 5))
    z = quality.fourier(np.zeros(5), np.ones(5), 20_000, 2.0, 1)(x)[:, :-1]
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * 2.0**2))
    assert np.abs(z @ z.T - kernel).max() < 0.05


def test_normal_equations_are_those_of_all_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, len(quality.STATISTICS)))
    y = (x[:, 0] + 0.3 * rng.normal(size=300) > 0).astype(float)
    df = spark.createDataFrame([(int(k % 4), row.tolist(), float(v)) for k, (row, v) in enumerate(zip(x, y))], "fold int, x array<double>, y double").repartition(5)
    model = quality.fit(df, features=50)
    z = model.transform(x)
    penalty = np.eye(51) * 1e-3 * 300 / 50
    penalty[-1, -1] = 1e-9
    assert model.weights == pytest.approx(np.linalg.solve(z.T @ z + penalty, z.T @ y), rel=1e-5, abs=1e-6)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.85


def test_quality_of_held_out_documents(spark):
    labels = table(spark, MIDDLE, "labels")
    got = QUERIES["op3_quality"](spark, MIDDLE).join(labels, "doc_id").filter("held_out").collect()
    assert len(got) > 100 and np.mean([r.quality == r.predicted for r in got]) > 0.96 and all(0 <= r.score <= 1 for r in got)


def test_quality_query_against_a_plain_fit(spark, small):
    """All rows in one matrix: moments, folds, ridge, and pooling of neighbours until shares rise."""
    texts = {r.doc_id: r.text for r in table(spark, small, "documents").select("doc_id", "text").collect()}
    fold = {r.doc_id: r.f for r in table(spark, small, "documents").select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(quality.FOLDS)).alias("f")).collect()}
    labels = [(r.doc_id, r.quality) for r in table(spark, small, "labels").collect() if r.quality in (0, 1) and r.doc_id in texts and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    x, y, f = np.array([quality.statistics(texts[i]) for i, _ in labels]), np.array([q for _, q in labels], float), np.array([fold[i] for i, _ in labels])
    z = quality.fourier(x.mean(axis=0), x.std(axis=0), 200, 4.0, 11)
    m = z(x)
    penalty = lambda n: np.diag([1e-3 * n / 200] * 200 + [1e-9])
    solve = lambda rows: np.linalg.solve(m[rows].T @ m[rows] + penalty(rows.sum()), m[rows].T @ y[rows])
    raw = np.zeros(len(y))
    for k in range(quality.FOLDS):
        raw[f == k] = m[f == k] @ solve(f != k)
    bins = np.minimum(((np.clip(raw, -1, 2) + 1) / 3 * quality.BINS).astype(int), quality.BINS - 1)
    pools = [[(b + 0.5) / quality.BINS * 3 - 1, float((bins == b).sum()), y[bins == b].sum()] for b in sorted(set(bins.tolist()))]
    while bad := [k for k in range(len(pools) - 1) if pools[k][2] / pools[k][1] >= pools[k + 1][2] / pools[k + 1][1]]:
        (ra, na, pa), (rb, nb, pb) = pools[bad[0] : bad[0] + 2]
        pools[bad[0] : bad[0] + 2] = [[(ra * na + rb * nb) / (na + nb), na + nb, pa + pb]]
    weights = solve(np.ones(len(y), bool))
    for r in QUERIES["op3_quality"](spark, small).collect():
        own = float(np.clip((z(quality.statistics(texts[r.doc_id])[None]) @ weights)[0], -1, 2))
        want = 0.999 * np.interp(own, [p[0] for p in pools], [p[2] / p[1] for p in pools]) + 0.001 * min(max(own, 0), 1)
        assert r.score == pytest.approx(want, abs=1e-5) and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_language_query_against_a_plain_pass(spark, small):
    """The sample drawn row by row, and every text walked word by word with the whole chain in double precision."""
    rows = table(spark, small, "documents").select("doc_id", "text", "lang", F.xxhash64(F.lit(17), "doc_id").alias("h")).collect()
    held_out = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    sample = []
    for la in sorted({r.lang for r in rows if r.lang}):
        own = sorted((r.h, r.text) for r in rows if r.lang == la and r.text is not None and not held_out(r.doc_id))
        sample += [(t, la) for _, t in own[: langid.PER_LANGUAGE]]
    model = langid.fit(sample)
    move = np.exp(model.transitions - model.transitions.max())
    got = {r.doc_id: r for r in QUERIES["op1_language_id"](spark, small).collect()}
    assert len(got) == len(rows)
    for r in rows:
        words = langid.WORDS.findall((r.text or "").lower())
        if not words:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0)
            continue
        psi = np.exp([langid.Features([w], model.lexicon).emissions(model.weights)[0] for w in words])
        n = len(model.languages)
        alpha, beta = [np.full(n, 1 / n)], [np.ones(n)]
        for p in psi:
            a = alpha[-1] @ move * p
            alpha.append(a / a.sum())
        for p in psi[:0:-1]:
            b = move @ (p * beta[-1])
            beta.append(b / b.sum())
        marginal = np.array(alpha[1:]) * np.array(beta[::-1])
        mean = (marginal / marginal.sum(axis=1, keepdims=True)).mean(axis=0)
        assert got[r.doc_id].lang_pred == model.languages[mean.argmax()] and got[r.doc_id].score == pytest.approx(mean.max(), abs=1e-5) and got[r.doc_id].held_out == held_out(r.doc_id)


def test_bounded_training_sample(spark):
    labels = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("quality"))
    few = quality.training_ids(labels, F.lit(False), most=1000)
    assert 800 < few.count() < 1200 and few.exceptAll(quality.training_ids(labels, F.lit(False), most=1000)).count() == 0
    assert quality.training_ids(labels, F.col("doc_id") < 10).count() == 19_990


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (5, None), (8, 0), (99, 1), (None, 1), (4, 1)], "doc_id long, quality int")
    assert odd.count() == quality.score_quality(odd, labels, F.lit(False)).count() == 12
    assert {r.score for r in quality.score_quality(odd, labels.limit(0), F.lit(False)).select(F.round("score", 2).alias("score")).collect()} == {0.5}
    assert quality.score_quality(none, labels, F.lit(False)).count() == 0
    assert quality.score_quality(odd, labels.filter("quality = 1"), F.lit(False)).count() == 12


def plain_scores(texts, order=3, backoff=0.4, least=2):
    words = [(t or "").encode().lower().split() for t in texts]
    counts = [Counter(tuple(w[k - n : k]) for w in words for k in range(n, len(w) + 1)) for n in range(1, order + 1)]
    total, out = sum(map(len, words)), []
    for w in words:
        score = 0.0
        for k in range(1, len(w) + 1):
            n = min(order, k)
            factor = 0.0
            while n > 1 and counts[n - 1][tuple(w[k - n : k])] < least:
                n, factor = n - 1, factor + math.log(backoff)
            score += factor + (math.log(counts[n - 1][tuple(w[k - n : k])] / counts[n - 2][tuple(w[k - n : k - 1])]) if n > 1 else math.log(counts[0][w[k - 1],] / total))
        out.append((len(w), round(score, 5)))
    return out


@pytest.mark.parametrize("which,order,block", [("odd", 3, 1000), ("small", 3, 6_000_000), ("small", 4, 30_000), ("small", 1, 100_000), ("small", 2, 100_000)])
def test_lm_scores(spark, odd, small, which, order, block):
    docs = odd if which == "odd" else table(spark, small, "documents")
    rows = docs.select("doc_id", "text").collect()
    want = sorted(((r.doc_id, *s) for r, s in zip(rows, plain_scores([r.text for r in rows], order))), key=repr)
    got = sorted(((r.doc_id, r.n_words, round(r.log_score, 5)) for r in lm.lm_scores(docs, order=order, block_chars=block).collect()), key=repr)
    assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=2e-5, rel=1e-9)


def test_lm_scores_of_nothing(none):
    assert lm.lm_scores(none).count() == 0


def test_lm_scores_of_packed_texts(spark):
    empty = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string").coalesce(1)
    assert {(r.n_words, r.log_score, r.mean_log_score) for r in lm.lm_scores(empty).collect()} == {(0, 0.0, None)}
    texts = ["a b a b", "É é  x", ""] * 4
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_words, r.log_score) for r in lm.lm_scores(docs, block_chars=10).collect()}
    for k, (n, score) in enumerate(plain_scores(texts)):
        assert got[k][0] == n and got[k][1] == pytest.approx(score, abs=2e-5)
