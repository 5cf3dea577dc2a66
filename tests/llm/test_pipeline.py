"""Every stage of the pipeline against a plain version of what it decides."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

pytest.importorskip("corpus_pipeline", reason="the pipeline isn't there") if not Path(__file__).parents[2].joinpath("corpus_pipeline.py").exists() else None

import corpus_pipeline as P
from furrow.llm import langid, mixing, quality
from furrow.llm.queries import QUERIES, remainder, tokenizer_path
from furrow.session import stored, table
from tests.llm.test_similar import brute


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def states(spark, small):
    docs, out = table(spark, small, "documents"), []
    for _, stage in P.STAGES:
        out.append((docs, docs := stored(stage(spark, docs, small))))
    return out


def test_stages(spark, small, states):
    columns = table(spark, small, "documents").columns
    assert [n for n, _ in P.STAGES] == ["quality", "language", "near_duplicates", "mix", "encode"]
    assert all(after.columns == columns for _, after in states[:-1])
    (all_docs, good), (_, known), (_, single), (_, mixed), (_, encoded) = states
    scored = quality.score_quality(all_docs, table(spark, small, "labels"), remainder("doc_id", 3) == 1)
    assert rows(good) == rows(all_docs.join(scored.filter("predicted = 1"), "doc_id", "left_semi"))
    assert good.count() < all_docs.count()
    found = langid.identify(good, langid.train(good, F.coalesce(remainder("doc_id", 4) != 2, F.lit(False))))
    assert rows(known) == rows(good.join(found.filter("lang_pred <> 'und' AND score >= 0.3"), "doc_id", "left_semi"))
    texts = [(r.doc_id, r.text) for r in known.collect()]
    assert sorted(r.doc_id for r in single.collect()) == sorted({c for _, c in brute(texts)}) and single.exceptAll(known).count() == 0
    taken = {r.doc_id: sum(r.taken) for r in mixing.mix(single, block=P.MIX_BLOCK).select("doc_id", mixing.taken_by_shard(F.col("draws")).alias("taken")).collect()}
    words: dict = {}
    source = {r.doc_id: r.text for r in single.collect()}
    for r in mixed.collect():
        own = re.findall(r"[^\x20\x09-\x0D]+", r.text)
        assert r.n_chars == len(r.text) and set(own) <= set(re.findall(r"[^\x20\x09-\x0D]+", source[r.doc_id]))
        words[r.doc_id] = words.get(r.doc_id, 0) + len(own)
    assert words == {k: v for k, v in taken.items() if v}
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    assert sorted((r.doc_id, r.ids) for r in encoded.collect()) == sorted((r.doc_id, sp.encode(r.text, add_eos=True)) for r in mixed.collect())


def test_odd_rows(spark, odd, none, small):
    """Nulls, clashing names, repeated rows and an empty table go through every stage."""
    docs = odd.unionByName(odd).select("*", F.lit("x").alias("draws"), F.lit("x").alias("target"), F.lit("x").alias("quota"), F.lit("x").alias("id"), F.lit("x").alias("digest"), F.lit("x").alias("doc"))
    for df in (docs, docs.limit(0)):
        for name, stage in P.STAGES:
            out = stage(spark, df, small)
            assert out.count() <= (32 if name == "mix" else 1) * df.count() and (name == "encode" or out.columns == df.columns)
    kept = P.near_duplicates(spark, docs, small).collect()
    # Ids 1 to 3 have no words, 4 and 5 are copies; 10 has two texts; the row without an id is a document of its own.
    assert sorted(((r.doc_id, (r.text or "")[:4]) for r in kept), key=repr) == sorted([(1, ""), (4, "Of t"), (None, "no i"), (7, "le l"), (8, "one"), (9, "a  b"), (10, "word"), (10, "same"), (12, "<|en")], key=repr)


def test_run(spark, small):
    assert P.run(spark, small).count() > 50 and P.ORACLE_SQL is None and "op8_sentencepiece_spans" in QUERIES
