"""The registered queries of the corpus operators, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.conversations import damage, repair
from furrow.llm.embeddings import near_duplicate_vectors
from furrow.llm.langid import identify, train
from furrow.llm.licenses import BASE, TEMPLATES, TEXTS, scan_licenses, template_regex
from furrow.llm.lm import lm_scores
from furrow.llm.media import media_columns, pack_texts
from furrow.llm.mixing import mix, taken_by_shard
from furrow.llm.pieces import encode_texts
from furrow.llm.quality import score_quality
from furrow.llm.repeats import remove_repeats
from furrow.llm.resample import resample
from furrow.llm.simhash import hex_fingerprint, near_duplicates
from furrow.llm.tokencount import token_counts
from furrow.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def remainder(id: str, by: int):
    """crc32 of the id as text, modulo ``by``; null for a null id."""
    return F.crc32(F.col(id).cast("string").cast("binary")) % by


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    found = identify(docs, train(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    of_shards = mixed.select("doc_id", "size", "source_size", "target", taken_by_shard(F.col("draws")).alias("of_shards"))
    taken = F.aggregate("of_shards", F.lit(0).cast("long"), lambda n, k: n + k)
    return of_shards.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.concat_ws(",", F.col("of_shards").cast("array<string>")).alias("shard_words"))


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    return score_quality(docs, labels, held_out).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op4_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("places")


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@query
def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = media_columns(pack_texts(table(spark, sf_dir, "documents")), payload=True)
    keys = F.col("keyframes")
    first, last = keys[0], F.element_at(keys, -1)
    feature = F.format_string(
        "codec=%s;size=%dx%d;duration=%.6f;samples=%d;keyframes=%d;first=%d+%d;last=%d+%d",
        F.trim("codec"), "width", "height", "duration", "n_samples", F.size(keys), first["first_byte"], first["n_bytes"], last["first_byte"], last["n_bytes"],
    )
    return read.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )


@query
def op8_sentencepiece_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_texts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"), F.sha2(F.concat_ws(" ", F.col("end_bytes").cast("array<string>")), 256).alias("spans_sha256"),
    )


@query
def op9_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scores(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("log_score", 6).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


ORACLE_SQL["op9_stupid_backoff"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
o AS (SELECT r, unnest(range(1, len(w) + 1)) AS k, w FROM d),
t AS (SELECT r, k, w[k] AS a, CASE WHEN k > 1 THEN w[k - 1] || ' ' || w[k] END AS b, CASE WHEN k > 2 THEN w[k - 2] || ' ' || w[k - 1] || ' ' || w[k] END AS c FROM o),
ca AS (SELECT a, count(*) AS na FROM t GROUP BY a), cb AS (SELECT b, count(*) AS nb FROM t GROUP BY b HAVING count(*) >= 2), cc AS (SELECT c, count(*) AS nc FROM t GROUP BY c HAVING count(*) >= 2),
n AS (SELECT count(*) AS n FROM t),
j AS (SELECT r, k, na, nb, nc, lag(na) OVER p AS pa, lag(nb) OVER p AS pb FROM t JOIN ca USING (a) LEFT JOIN cb USING (b) LEFT JOIN cc USING (c) WINDOW p AS (PARTITION BY r ORDER BY k)),
s AS (SELECT r, CASE WHEN nc IS NOT NULL THEN ln(nc) - ln(pb) WHEN nb IS NOT NULL THEN ln(nb) - ln(pa) + CASE WHEN k > 2 THEN ln(0.4) ELSE 0 END
  ELSE ln(na) - ln(n) + least(k - 1, 2) * ln(0.4) END AS x FROM j, n),
z AS (SELECT r, sum(x) AS x, count(*) AS m FROM s GROUP BY r)
SELECT doc_id, CAST(coalesce(m, 0) AS BIGINT) AS n_words, round(coalesce(x, 0), 6) AS log_score, round(x / m, 6) AS mean_log_score FROM d LEFT JOIN z USING (r)"""


@query
def op10_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


ORACLE_SQL["op10_embedding_links"] = """
WITH RECURSIVE u AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_aggregate(list_transform(embedding, lambda x: abs(x)), 'max') > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
r AS (SELECT a AS v, a AS w FROM l UNION SELECT r.v, l.b FROM r JOIN l ON r.w = l.a),
m AS (SELECT v, min(w) AS c FROM r GROUP BY v), n AS (SELECT a, count(*) AS k FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links, coalesce(c, vec_id) AS component_id, vec_id = coalesce(c, vec_id) AS kept
FROM embeddings LEFT JOIN m ON v = vec_id LEFT JOIN n ON n.a = vec_id"""


def _licenses_sql() -> str:
    """Words joined by single spaces; places of a phrase are counted word by word, templates as regular expressions."""
    hits = " UNION ALL ".join(
        f"SELECT n, unnest(list_filter(range(1, len(w) - {len(p.split()) - 1} + 1), lambda i: {' AND '.join(f'w[i + {k}] = {chr(39)}{x}{chr(39)}' for k, x in enumerate(p.split()))})) - 1 AS place, '{label}' AS label FROM t"
        for p, label in BASE.items()
    )
    found = " UNION ALL ".join(f"SELECT n, '{label}' AS label FROM t WHERE regexp_matches(j, '{template_regex(x)}')" for label, x in TEMPLATES.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM documents),
t AS (SELECT n, doc_id, regexp_extract_all(s, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, ' ' || array_to_string(regexp_extract_all(s, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), ' ') || ' ' AS j FROM d),
base AS ({hits}),
found AS ({found}),
b AS (SELECT n, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY n),
f AS (SELECT n, count(*) AS n_found, count(*) FILTER (WHERE label IN ({", ".join(f"'{x}'" for x in TEXTS)})) AS n_texts FROM found GROUP BY n),
a AS (SELECT n, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT n, label FROM base UNION ALL SELECT n, label FROM found) GROUP BY n)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CAST(CASE WHEN n_texts > 0 THEN 1.0 WHEN n_found > 0 THEN 0.75 WHEN n_base > 0 THEN 0.5 ELSE 0.0 END AS DOUBLE) AS score
FROM t LEFT JOIN b USING (n) LEFT JOIN f USING (n) LEFT JOIN a USING (n)"""


ORACLE_SQL["op4_license_templates"] = _licenses_sql()


@query
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# DuckDB has no crc32: its table of 256 entries follows from the polynomial, and each distinct word is digested byte by byte.
ORACLE_SQL["op11_importance_resampling"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
e AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
dw AS (SELECT r, x, count(*) AS k FROM (SELECT r, unnest(w) AS x FROM d) GROUP BY r, x), ew AS (SELECT x, count(*) AS k FROM (SELECT unnest(w) AS x FROM e) GROUP BY x),
v AS (SELECT DISTINCT x FROM dw UNION SELECT x FROM ew),
h AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS f),
y AS (SELECT x, list_transform(range(1, CAST(len(hex(encode(x))) AS BIGINT), 2), lambda i: CAST('0x' || substr(hex(encode(x)), i, 2) AS BIGINT)) AS b FROM v),
c AS (SELECT x, xor(list_reduce(list_prepend(4294967295, b), lambda a, z: xor(a // 256, f[xor(a, z) % 256 + 1])), 4294967295) % 10000 AS bucket FROM y, h),
s AS (SELECT bucket, sum(k) AS s FROM dw JOIN c USING (x) GROUP BY bucket), t AS (SELECT bucket, sum(k) AS t FROM ew JOIN c USING (x) GROUP BY bucket),
n AS (SELECT coalesce((SELECT sum(s) FROM s), 0) + 10000 AS ns, coalesce((SELECT sum(t) FROM t), 0) + 10000 AS nt),
g AS (SELECT s.bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * CAST(ns AS DOUBLE) / ((CAST(s AS DOUBLE) + 1) * CAST(nt AS DOUBLE)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), n),
m AS (SELECT r, CAST(floor(sum(k * gain) / sum(k)) AS BIGINT) AS weight FROM dw JOIN c USING (x) JOIN g USING (bucket) GROUP BY r),
z AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN m USING (r)),
o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n FROM z WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM z LEFT JOIN o USING (r)"""


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damage(table(spark, sf_dir, "conversations")), F.col("there"))


@query
def op13_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL["op13_repeated_strings"] = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT r, doc_id, i, substr(x, 2 * i + 1, 200) AS s FROM (SELECT r, doc_id, x, unnest(range(0, len(x) // 2 - 99)) AS i FROM d)),
f AS (SELECT s, min(coalesce(doc_id, 9223372036854775807)) AS id FROM w GROUP BY s),
k AS (SELECT s, id, min(i) AS i FROM w JOIN f USING (s) WHERE coalesce(doc_id, 9223372036854775807) = id GROUP BY s, id),
m AS (SELECT w.r, w.i FROM w JOIN k USING (s) WHERE (coalesce(w.doc_id, 9223372036854775807), w.i) > (k.id, k.i)),
g AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 100 THEN 0 ELSE 1 END AS fresh FROM m),
n AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS n FROM g),
b AS (SELECT r, min(i) AS a, max(i) + 100 AS b FROM n GROUP BY r, n),
l AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS z FROM b),
q AS (SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substr(x, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS head FROM l JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head || substr(x, 2 * last + 1), x))) AS kept_sha256 FROM d LEFT JOIN q USING (r)"""
