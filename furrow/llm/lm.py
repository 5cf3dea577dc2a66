"""Stupid-backoff language-model scores of all documents, from the counts of all documents.

Equal texts are counted first where they stand, so that copies travel and are scored once. Texts are dealt by a hash into blocks of bounded size, the texts
that a task sends to a block compressed together. A block lists its n-grams of each order once, as 64-bit keys in ascending
order; the lists are cut by key range, so that the rows (range, block, keys, counts) of one range are one partition of the count tables.
A partition adds up its keys over all blocks and joins the totals back to the rows they came from; the rows return to their block, where they meet the
exploded n-grams of its texts again, and each text's logarithms are summed and joined to its documents. Rows hold lists in place of single n-grams because a list of sorted
keys takes about six bytes each on its way, and single rows twice as many and more in each of the shuffles (the README has both measured).

There are as many ranges as blocks, so tasks stay of one size whatever the corpus, and the number of rows is the square of the number of blocks: a row's list gets
shorter as the corpus grows. ``block_chars`` goes with the memory of an executor: with blocks of 9 MB a row holds about a thousand keys at 30 GB, with blocks of 256 MB some
hundreds at 100 TB. n-grams are told apart by 64-bit hashes: with 10^10 different ones the chance that any two share a key is about nine in ten,
the share of n-grams that such a pair touches about 10^-9.

With counts c, corpus size N, backoff factor f and least count m, the score of word i is c(i-2..i) / c(i-2..i-1) if c(i-2..i) >= m, else
f c(i-1..i) / c(i-1) if c(i-1..i) >= m, else f^2 c(i) / N, and so on for other orders; at a text's start only the orders that fit are tried, without a
factor for those that don't.

Defined results: null and empty texts have no words, a sum of 0 and a null mean; repeated rows each count and keep their row; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_CHARS = 9_000_000


def word_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit keys of all words in a row, number of words of each text in UTF-8); A-Z are lower-cased, blanks of ASCII part words."""
    words: list[bytes] = []
    n = np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        own = t.lower().split()
        n[k] = len(own)
        words += own
    codes, distinct = pd.factorize(pd.Series(words, dtype=object))
    import xxhash

    keys = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct), np.uint64, len(distinct))
    return keys[codes] if len(codes) else np.zeros(0, np.uint64), n


def _mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit (SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ngram_keys(words: np.ndarray, n_words: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n from 1 to ``order``: (keys of the n-grams that end at each place, whether one does: n-grams don't cross texts)."""
    ends = np.cumsum(n_words)
    place = np.arange(len(words)) - np.repeat(ends - n_words, n_words)
    out, keys = [(words, np.ones(len(words), bool))], words
    for n in range(2, order + 1):
        longer = np.zeros_like(keys)
        longer[1:] = _mixed(keys[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:] + np.uint64(n))
        keys = longer
        out.append((keys, place >= n - 1))
    return out


def _lists(words, n_words, copies, order):
    """(n, distinct keys, their counts) of a block whose texts stand for ``copies`` documents each."""
    weight = np.repeat(copies, n_words)
    for n, (keys, real) in enumerate(ngram_keys(words, n_words, order), 1):
        distinct, back = np.unique(keys[real], return_inverse=True)
        yield n, distinct, np.bincount(back, weight[real], len(distinct)).astype(np.int64)


def _pack(lists: list[np.ndarray]) -> bytes:
    """Sorted lists of keys as their differences, eight planes of bytes, compressed: the upper planes are nearly empty."""
    steps = np.concatenate([np.diff(keys, prepend=np.uint64(0)) for keys in lists])
    return _pack_counts(steps)


def _unpack(data: bytes, sizes: list[int]) -> list[np.ndarray]:
    steps, ends = _unpack_counts(data).view(np.uint64), np.cumsum(sizes)
    return [np.cumsum(steps[b - n : b], dtype=np.uint64) for n, b in zip(sizes, ends)]


def _pack_counts(counts: np.ndarray) -> bytes:
    import zstandard

    raw = counts.astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw.view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack_counts(data: bytes) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(raw.T).view("<u8")[:, 0].astype(np.int64)


def counted_copies(docs: DataFrame, n_blocks: int, most: int = 4_000_000) -> DataFrame:
    """(block, digests, sizes, copies, texts): packed rows of texts, those equal within a task as one. ``most``: bytes of text that a task holds."""

    def count(batches):
        held: dict[bytes, list] = {}
        size = 0
        for pdf in batches:
            for digest, text in zip(pdf["digest"], pdf["text"]):
                if digest in held:
                    held[digest][1] += 1
                    continue
                own = text.encode()
                held[digest] = [own, 1]
                size += len(own)
                if size > most:
                    yield frame(held)
                    held, size = {}, 0
        if held:
            yield frame(held)

    def frame(held):
        import zstandard

        of_block: dict[int, list[bytes]] = {}
        for digest in held:
            of_block.setdefault(int.from_bytes(digest[:8]) % n_blocks, []).append(digest)
        press, rows = zstandard.ZstdCompressor(level=3), []
        for block, own in of_block.items():
            sizes, copies = (np.array(x, np.int64) for x in ([len(held[d][0]) for d in own], [held[d][1] for d in own]))
            rows.append((block, b"".join(own), _pack_counts(sizes), _pack_counts(copies), press.compress(b"".join(held[d][0] for d in own))))
        return pd.DataFrame(rows, columns=["block", "digests", "sizes", "copies", "texts"])

    return docs.mapInPandas(count, "block int, digests binary, sizes binary, copies binary, texts binary")


def _open_texts(frame: pd.DataFrame) -> tuple[list[bytes], list[bytes], np.ndarray]:
    """(digests, texts, copies) of the packed rows of a block; a text can stand there once for each task that sent it."""
    import zstandard

    digests, texts, copies = [], [], [np.zeros(0, np.int64)]
    for row in frame.itertuples():
        data, at = zstandard.ZstdDecompressor().decompress(row.texts), 0
        for k, n in enumerate(_unpack_counts(row.sizes).tolist()):
            digests.append(row.digests[32 * k : 32 * k + 32])
            texts.append(data[at : at + n])
            at += n
        copies.append(_unpack_counts(row.copies))
    return digests, texts, np.concatenate(copies)


LISTS = "part int, block int, sizes array<int>, keys binary, counts binary"


def block_lists(blocks: DataFrame, order: int, parts: int) -> DataFrame:
    """(part, block, sizes, keys, counts): each block's n-grams, cut into ``parts`` ranges of keys; a row has a list for each n, of ``sizes`` keys."""

    def lists(frame: pd.DataFrame) -> pd.DataFrame:
        _, texts, copies = _open_texts(frame)
        words, n_words = word_keys(texts)
        bounds = np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)
        found = [(keys, counts, [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]) for _, keys, counts in _lists(words, n_words, copies, order)]
        rows = []
        for p in range(parts):
            own = [(keys[at[p] : at[p + 1]], counts[at[p] : at[p + 1]]) for keys, counts, at in found]
            sizes = [len(k) for k, _ in own]
            if any(sizes):
                rows.append((p, frame["block"].iat[0], sizes, _pack([k for k, _ in own]), _pack_counts(np.concatenate([c for _, c in own]))))
        return pd.DataFrame(rows, columns=["part", "block", "sizes", "keys", "counts"])

    return blocks.groupBy("block").applyInPandas(lists, LISTS)


def total_counts(lists: DataFrame, least: int) -> DataFrame:
    """The same rows with the counts of the whole corpus in place of the block's; counts of n > 1 below ``least`` become 0."""

    def totals(frame: pd.DataFrame) -> pd.DataFrame:
        sizes = [list(s) for s in frame["sizes"]]
        keys = [_unpack(k, s) for k, s in zip(frame["keys"], sizes)]
        counts = [np.split(_unpack_counts(c), np.cumsum(s)[:-1]) for c, s in zip(frame["counts"], sizes)]
        of_row: list[list[np.ndarray]] = [[] for _ in sizes]
        for n in range(len(sizes[0])):
            distinct, back = np.unique(np.concatenate([k[n] for k in keys]), return_inverse=True)
            total = np.bincount(back, np.concatenate([c[n] for c in counts]), len(distinct)).astype(np.int64)
            if n:
                total[total < least] = 0
            for row, own in zip(of_row, np.split(total[back], np.cumsum([s[n] for s in sizes])[:-1])):
                row.append(own)
        return pd.DataFrame({"part": frame["part"], "block": frame["block"], "sizes": frame["sizes"], "counts": [_pack_counts(np.concatenate(x)) for x in of_row]})

    return lists.groupBy("part").applyInPandas(totals, "part int, block int, sizes array<int>, counts binary")


def _scores(words: np.ndarray, n_words: np.ndarray, counts: list[np.ndarray], order: int, backoff: float, total: int) -> np.ndarray:
    """Summed logarithms of each text; ``counts`` has for each n the counts of the block's distinct n-grams."""
    at_place = []
    for (keys, real), count in zip(ngram_keys(words, n_words, order), counts):
        own = np.zeros(len(words), np.int64)
        if real.any():
            own[real] = count[np.unique(keys[real], return_inverse=True)[1]]
        at_place.append((own, real))
    logs = np.log(np.maximum(at_place[0][0], 1)) - np.log(max(total, 1))
    for n in range(2, order + 1):
        own, real = at_place[n - 1]
        before = np.concatenate([[1], at_place[n - 2][0][:-1]])
        logs = np.where(own > 0, np.log(np.maximum(own, 1)) - np.log(np.maximum(before, 1)), np.where(real, logs + np.log(backoff), logs))
    ends = np.concatenate([[0], np.cumsum(n_words)])
    return np.array([logs[a:b].sum() for a, b in zip(ends, ends[1:])])


def lm_scores(docs: DataFrame, id: str = "doc_id", text: str = "text", order: int = 3, backoff: float = 0.4, least: int = 2, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, n_words, log_score, mean_log_score) for each row: natural logarithms of the backoff scores, summed and per word."""
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    size, total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.coalesce(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))), F.lit(0))).first()
    n_blocks = max(1, -(-size // block_chars))
    blocks = counted_copies(rows.select("digest", "text"), n_blocks).repartition("block")
    # As many ranges as blocks, so that a partition of the count tables is as large as a block, whatever the corpus.
    totals = total_counts(block_lists(blocks, order, n_blocks), least)

    def score(texts: pd.DataFrame, lists: pd.DataFrame) -> pd.DataFrame:
        digests, found, _ = _open_texts(texts)
        distinct = dict(zip(digests, found))
        words, n_words = word_keys(list(distinct.values()))
        lists = lists.sort_values("part")
        own = [np.split(_unpack_counts(c), np.cumsum(s)[:-1]) for c, s in zip(lists["counts"], lists["sizes"])]
        counts = [np.concatenate([np.zeros(0, np.int64), *(row[n] for row in own)]) for n in range(order)]
        return pd.DataFrame({"digest": list(distinct), "n_words": n_words, "log_score": _scores(words, n_words, counts, order, backoff, total)})

    scored = blocks.groupBy("block").cogroup(totals.groupBy("block")).applyInPandas(score, "digest binary, n_words long, log_score double")
    out = rows.select("id", "digest").join(scored, "digest").select(F.col("id").alias(id), "n_words", "log_score")
    return out.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))
