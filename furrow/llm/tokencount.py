"""Token counts through a digest cache.

Every text is reduced to the digest of its normalised content. The digests of a corpus are joined to a
stored table (content digest, tokenizer-version digest) -> count; only distinct contents that the table lacks
are encoded, and their counts are appended to it. A rerun over grown data encodes what is new.

Where the tokenizer ends every token at white space, runs of white space count as one space and a text's count is the sum over its words; this is probed on
the tokenizer itself. Other tokenizers get the texts as they are.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows each get their row; an
empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.batches import map_texts
from furrow.session import fresh_path, stored

#: Words whose counts a task remembers between slices of texts, and the characters of a slice; both bound its memory.
REMEMBERED, SLICE_CHARS = 300_000, 1_000_000
CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """Names a tokenizer's version: library, library version and the file's digest."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f"tokenizers {tokenizers.__version__} ".encode() + f.read()).hexdigest()


def load(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def ends_at_white_space(path: str) -> bool:
    """Whether no part that the tokenizer cuts a text into holds white space, between signs of all kinds."""
    cut = load(path).pre_tokenizer
    if cut is None:
        return False
    probes = [f"{a}{blank}{b}" for a in ("a", "7", ".", "é", "日", "'") for b in ("a", "7", ".", "é", "日", "'s") for blank in (" ", "\t", "\n", "\x0b", "\f", "\r", "  \n ")]
    return not any(any(x in p[a:b] for x in " \t\n\x0b\f\r") for p in probes for _, (a, b) in cut.pre_tokenize_str(p))


def content_digest(text, by_word: bool = True):
    """Digest of the normalised content: null as empty, and with ``by_word`` each run of ASCII white space as one space, which keeps every count."""
    whole = F.coalesce(text, F.lit(""))
    return F.unhex(F.sha2(F.regexp_replace(whole, r"[ \t\n\x0B\f\r]+", " ") if by_word else whole, 256))


def _counter(path: str, by_word: bool):
    """Counts for a slice of texts; with ``by_word`` each distinct word is encoded once while the task remembers it."""
    # Spark's tasks are the threads here; the library's own would multiply a worker's memory.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = load(path)
    known: dict[bytes, int] = {}

    def whole(texts: list[str]) -> list:
        return [[len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]]

    def count(texts: list[str]) -> list:
        words, per_text = [], []
        for text in texts:
            own = text.encode().split()
            words += own
            per_text.append(len(own))
        new = list({w for w in words if w not in known})
        for k in range(0, len(new), 5_000):
            block = new[k : k + 5_000]
            encoded = tokenizer.encode_batch_fast([w.decode() for w in block], add_special_tokens=False)
            known.update(zip(block, map(len, encoded)))
        total = np.concatenate([[0], np.cumsum(np.fromiter((known[w] for w in words), np.int64, len(words)))])
        ends = np.cumsum(np.array(per_text, np.int64))
        if len(known) > REMEMBERED:
            known.clear()
        return [total[ends] - total[ends - per_text]]

    return count if by_word else whole


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The stored counts; an absent cache is an empty one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache)


def fill_cache(docs: DataFrame, text: str, tokenizer: str, cache: str) -> DataFrame:
    """Encode the distinct contents of ``docs`` that ``cache`` lacks and append their counts; returns the cache.

    The group-by keeps one text for each digest and combines before the shuffle, so copies meet as one row.
    """
    version, by_word = tokenizer_digest(tokenizer), ends_at_white_space(tokenizer)
    known = read_cache(docs.sparkSession, cache).filter(F.col("tokenizer_digest") == version).select("content_digest")
    distinct = (
        docs.select(content_digest(F.col(text), by_word).alias("content_digest"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        .groupBy("content_digest").agg(F.first("text").alias("text"))
    )
    misses = distinct.join(known, "content_digest", "left_anti")
    counted = map_texts(misses, "text", "n_tokens long", lambda: _counter(tokenizer, by_word), SLICE_CHARS)
    counted.select("content_digest", F.lit(version).alias("tokenizer_digest"), "n_tokens").write.mode("append").parquet(cache)
    return read_cache(docs.sparkSession, cache).filter(F.col("tokenizer_digest") == version)


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, id: str = "doc_id", text: str = "text", limit: int = 2048) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row of ``docs``; ``cache`` is a path that all executors reach.

    Without ``cache`` a new one is begun in the shared folder.
    """
    cache = cache or fresh_path(docs.sparkSession, "token-cache")
    # Written without repeats, which two runs that append at once may leave, so that nothing stands between the shuffle and the join: Spark then splits the rows of a very frequent text.
    counts = stored(fill_cache(docs, text, tokenizer, cache).select("content_digest", "n_tokens").dropDuplicates(["content_digest"]), "token-counts")
    keyed = docs.select(F.col(id), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"), content_digest(F.col(text), ends_at_white_space(tokenizer)).alias("content_digest"))
    return keyed.join(counts, "content_digest", "left").select(id, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
