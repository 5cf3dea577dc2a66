"""Importance resampling against a plain version; bisection and ranks on ties."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from furrow.llm import resample
from furrow.llm.queries import QUERIES
from furrow.session import table

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, target, buckets=10_000, longest=1, percent=10, least=20):
    def features(text):
        w = WORDS.findall((text or "").translate(LOWER))
        return len(w), [zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for n in range(1, longest + 1) for k in range(len(w) - n + 1)]

    found = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for *_, own in found for b in own), Counter(b for x in target for b in features(x)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    rows = []
    for i, words, own in found:
        gains = [math.floor(1000 * math.log((t[b] + 1.0) * (n_s + buckets) / ((s[b] + 1.0) * (n_t + buckets)))) for b in own]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    order = sorted((k for k, r in enumerate(rows) if r[4] >= least), key=lambda k: (-rows[k][3], rows[k][0] is None, rows[k][0]))
    rank = {k: n + 1 for n, k in enumerate(order[: percent * len(order) // 100])}
    return sorted(((*r[:4], rank.get(k)) for k, r in enumerate(rows)), key=repr)


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_query(spark, small):
    docs, target = table(spark, small, "documents"), [r.text for r in table(spark, small, "benchmark").collect()]
    want = plain(texts_of(docs), target)
    assert rows_of(QUERIES["op11_importance_resampling"](spark, small)) == want and any(r[4] for r in want)


@pytest.mark.parametrize("longest, percent, least", [(1, 50, 0), (3, 35, 2), (2, 100, 0)])
def test_strange_rows(spark, odd, none, longest, percent, least):
    """Nulls, empty and very long texts, repeated ids, clashing names (score, rank's helpers), runs of several words."""
    docs = odd.withColumnsRenamed({"size": "row_", "label": "bucket", "n_tokens": "weight"})
    got = rows_of(resample.resample(docs, docs.filter("doc_id < 8"), longest=longest, buckets=64, percent=percent, least_words=least))
    want = plain(texts_of(odd), [t for _, t in texts_of(odd.filter("doc_id < 8"))], 64, longest, percent, least)
    assert got == want
    assert resample.resample(none, odd).count() == 0
    assert all(r.rank is None for r in resample.resample(odd, none, percent=0).collect())


def test_ties(spark):
    """Thousands of equal scores, repeated and null ids: the number drawn is exact, ids decide, ranks have no gap."""
    scored = spark.range(6000).selectExpr("if(id % 7 = 0, null, id % 3000 - 500) AS id", "cast(if(id % 3 = 0, 5, id % 4) AS long) AS score", "id AS row_")
    for percent in (40, 100):
        rows = resample.draw(scored.select("id", "score"), resample.F.lit(True), percent).collect()
        drawn = sorted((r.rank, -r.score, r.id is None, r.id or 0) for r in rows if r.rank)
        everyone = sorted((-r.score, r.id is None, r.id or 0) for r in rows)
        assert len(rows) == 6000 and [d[0] for d in drawn] == list(range(1, 60 * percent + 1))
        assert [d[1:] for d in drawn] == everyone[: 60 * percent]


def test_crossing(spark):
    values = [-(2**62), -5, -5, 0, 7, 7, 7, 2**62, None]
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    real = sorted(v for v in values if v is not None)
    for n in range(1, 9):
        assert resample.crossing(rows, "v", n, False) == (real[n - 1], sum(v < real[n - 1] for v in real))
        assert resample.crossing(rows, "v", n, True) == (real[-n], sum(v > real[-n] for v in real))
    assert resample.crossing(rows, "v", 9, False)[0] is None
