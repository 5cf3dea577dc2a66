"""Language identification with a linear-chain conditional random field over words.

Every word of a text is labelled with a language. A word's features are its character n-grams, those that touch its start or end being its
affixes, and its place in a lexicon; their weights and the transitions between the languages of neighbouring words are learned together by the
gradient of the conditional likelihood. Forward and backward passes give each word's marginal probabilities, so that code-switched text is
labelled word by word; a text's language is the one with the largest summed marginals, its score that sum's share.

Training uses a bounded sample: ``per_language`` whole texts for each language, those with the smallest hashes of their ids. Parts of texts of different
languages are joined to code-switched sequences, which is where the transitions are learned. The model is fitted in one task, its size depends on the
number of languages only.

Defined results: null texts and those without a letter are ``und`` with score 0; without any training text every row is; rows without a
language are not learned from; repeated rows each keep their row; an empty table gives an empty result; only the text is looked at.
"""

from __future__ import annotations

import io
import re
import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.batches import decide, map_texts

UNDETERMINED = "und"
#: Letters are those of Unicode category L. ``\w`` also takes numbers that are no decimal digits (superscripts, fractions, circled and Roman numerals).
_NUMBERS = "".join(c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isnumeric() and not c.isalpha() and not c.isdecimal())
WORDS = re.compile(rf"[^\W\d_{_NUMBERS}]+")
#: The same but for those numbers: a class of a few signs, which is many times faster than one that lists them all.
_RUNS = re.compile(r"[^\W\d_]+")
GRAMS, BITS, PER_LANGUAGE, LEXICON = 4, 16, 200, 20_000
SEGMENT = 64
#: Characters labelled at a time: a word's features take some hundred bytes each, so this bounds a task's memory.
SLICE_CHARS = 400_000


def words_of(text: str) -> list[str]:
    """The lower-cased text's matches of ``WORDS``. Runs with a sign that is no letter are rare; only these are cut by the slow pattern."""
    found = _RUNS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [w for run in found for w in ([run] if run.isalpha() else WORDS.findall(run))]


class Features:
    """Hashed character n-grams and lexicon places of distinct words, as one flat list with the place where each word begins."""

    def __init__(self, words: list[str], lexicon: np.ndarray):
        joined = "".join(f"\x02{w}\x03" for w in words)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), sizes)
        ends = np.cumsum(sizes)[word] if len(words) else np.zeros(0, np.int64)
        ids, owners, key, at = [], [], np.zeros(len(codes), np.uint64), np.arange(len(codes))
        whole = np.zeros(len(words), np.uint64)
        for n in range(1, GRAMS + 1):
            if len(codes) < n:
                break
            key = (key[: len(codes) - n + 1] if n > 1 else key) * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(1)
            inside = at[: len(key)] + n <= ends[: len(key)]
            mixed = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
            ids.append((mixed[inside] >> np.uint64(64 - BITS)).astype(np.int64))
            owners.append(word[: len(key)][inside])
        for k in range(int(sizes.max()) if len(words) else 0):
            open_ = sizes > k
            whole[open_] = whole[open_] * np.uint64(0x100000001B3) + codes[(np.cumsum(sizes) - sizes)[open_] + k]
        self.whole = whole
        place = np.searchsorted(lexicon, whole)
        known = np.flatnonzero(lexicon[np.minimum(place, len(lexicon) - 1)] == whole) if len(lexicon) else np.zeros(0, np.int64)
        ids.append((1 << BITS) + place[known])
        owners.append(known)
        owner, flat = np.concatenate(owners), np.concatenate(ids)
        order = np.argsort(owner, kind="stable")
        self.flat, self.counts = flat[order], np.bincount(owner, minlength=len(words))
        self.starts = np.cumsum(self.counts) - self.counts

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        """(words, languages): the summed weights of each word's features, by the root of their number."""
        if not len(self.counts):
            return np.zeros((0, weights.shape[1]))
        return np.add.reduceat(weights[self.flat], self.starts, axis=0) / np.sqrt(self.counts)[:, None]


def forward_backward(scores: np.ndarray, sizes: np.ndarray, transitions: np.ndarray, moves: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(marginals of every word, expected transitions summed) for sequences of ``sizes`` words whose emission scores stand in a row.
    Without ``moves`` the transitions, which only learning needs, stay zero.

    Sequences are cut into segments; the product of a segment's transfer matrices carries messages over it, so that all
    segments are walked at once, and whole sequences of any length are exact.
    """
    n, labels = scores.shape
    if n == 0:
        return np.zeros((0, labels)), np.zeros((labels, labels))
    psi = np.exp(scores - scores.max(axis=1, keepdims=True))
    m = np.exp(transitions - transitions.max())
    sizes = sizes[sizes > 0]
    order = np.argsort(-sizes, kind="stable")
    starts = np.cumsum(sizes) - sizes
    n_segments = -(-sizes // SEGMENT)
    first = np.cumsum(n_segments) - n_segments
    total = int(n_segments.sum())
    owner = np.repeat(np.arange(len(sizes)), n_segments)
    within = np.arange(total) - first[owner]
    begin = starts[owner] + within * SEGMENT
    length = np.minimum(SEGMENT, sizes[owner] - within * SEGMENT)
    most = int(length.max())
    place = np.minimum(begin[:, None] + np.arange(most), n - 1)
    real = np.arange(most) < length[:, None]
    # Products over segments.
    product = np.broadcast_to(np.eye(labels), (total, labels, labels)).copy()
    for t in range(most):
        step = np.matmul(product, m) * psi[place[:, t], None, :]
        step /= step.sum(axis=(1, 2), keepdims=True)
        product = np.where(real[:, t, None, None], step, product)
    # Messages into each segment from the left and from the right.
    left, right = np.full((total, labels), 1 / labels), np.full((total, labels), 1 / labels)
    deepest = int(n_segments.max())
    for k in range(1, deepest):
        own = order[: np.searchsorted(-n_segments[order], -k, side="left")]
        at = first[own] + k
        a = np.matmul(left[at - 1, None, :], product[at - 1])[:, 0]
        left[at] = a / a.sum(axis=1, keepdims=True)
    for k in range(deepest - 2, -1, -1):
        own = order[: np.searchsorted(-n_segments[order], -(k + 1), side="left")]
        at = first[own] + k
        b = np.matmul(product[at + 1], right[at + 1, :, None])[:, :, 0]
        right[at] = b / b.sum(axis=1, keepdims=True)
    # Messages inside segments.
    alpha = np.zeros((most, total, labels))
    now = left
    for t in range(most):
        new = (now @ m) * psi[place[:, t]]
        new /= new.sum(axis=1, keepdims=True)
        now = np.where(real[:, t, None], new, now)
        alpha[t] = now
    out, pairs = np.zeros((n, labels)), np.zeros((labels, labels))
    beta = right
    for t in range(most - 1, -1, -1):
        live = real[:, t]
        g = alpha[t, live] * beta[live]
        out[place[live, t]] = g / g.sum(axis=1, keepdims=True)
        back = psi[place[:, t]] * beta
        if moves:
            before = alpha[t - 1] if t else left
            inner = live if t else live & (within > 0)
            xi = before[inner, :, None] * m * back[inner, None, :]
            pairs += (xi / xi.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        new = back @ m.T
        new /= new.sum(axis=1, keepdims=True)
        beta = np.where(live[:, None], new, beta)
    return out, pairs


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: np.ndarray

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, languages=np.array(self.languages), weights=self.weights, transitions=self.transitions, lexicon=self.lexicon)
        return out.getvalue()

    @staticmethod
    def from_bytes(data: bytes) -> Model:
        with np.load(io.BytesIO(data)) as f:
            return Model(tuple(f["languages"].tolist()), f["weights"], f["transitions"], f["lexicon"])

    def label_words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(marginals of all words in a row, number of words of each text)."""
        words, n = [], np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            own = words_of(t) if t else []
            n[k] = len(own)
            words += own
        codes, distinct = pd.factorize(pd.Series(words, dtype=object))
        if not words:
            return np.zeros((0, len(self.languages))), n
        scores = Features(list(distinct), self.lexicon).emissions(self.weights)[codes]
        return forward_backward(scores, n, self.transitions, moves=False)[0], n

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        marginals, n = self.label_words(texts)
        total = np.zeros((len(texts), len(self.languages)))
        some = n > 0
        if some.any():
            total[some] = np.add.reduceat(marginals, (np.cumsum(n) - n)[some], axis=0) / n[some, None]
        best = total.argmax(axis=1)
        return [self.languages[b] if s else UNDETERMINED for b, s in zip(best, some)], np.clip(total.max(axis=1), 0, 1).tolist()


def fit(texts: list[tuple[str, str]], seed: int = 3, rounds: int = 4, rate: float = 0.5) -> Model | None:
    """Learn from (text, language) pairs by AdaGrad on code-switched sequences made of their parts."""
    rng = np.random.default_rng(seed)
    languages = tuple(sorted({la for _, la in texts}))
    parts: list[tuple[list[str], int]] = []
    counts: dict[str, int] = {}
    for text, la in texts:
        words = words_of(text)
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        at = 0
        while at < len(words):
            size = int(rng.integers(4, 60))
            parts.append((words[at : at + size], languages.index(la)))
            at += size
    if not parts:
        return None
    frequent = sorted((w for w, c in counts.items() if c >= 3), key=lambda w: (-counts[w], w))[:LEXICON]
    lexicon = np.unique(Features(frequent, np.zeros(0, np.uint64)).whole)
    labels = len(languages)
    weights, transitions = np.zeros(((1 << BITS) + len(lexicon), labels)), np.zeros((labels, labels))
    grown, grown_t = np.full(weights.shape, 1e-3), np.full(transitions.shape, 1e-3)
    for _ in range(rounds):
        order = rng.permutation(len(parts))
        for a in range(0, len(order), 400):
            chosen = [parts[k] for k in order[a : a + 400]]
            words = [w for p, _ in chosen for w in p]
            truth = np.repeat([la for _, la in chosen], [len(p) for p, _ in chosen])
            # About four parts to a sequence, so most words keep the language of the word before.
            sizes = np.array([sum(len(p) for p, _ in chosen[k : k + 4]) for k in range(0, len(chosen), 4)])
            codes, distinct = pd.factorize(pd.Series(words, dtype=object))
            features = Features(list(distinct), lexicon)
            marginals, expected = forward_backward(features.emissions(weights)[codes], sizes, transitions)
            error = -marginals
            error[np.arange(len(truth)), truth] += 1
            by_word = np.zeros((len(distinct), labels))
            np.add.at(by_word, codes, error)
            gradient = np.zeros_like(weights)
            np.add.at(gradient, features.flat, np.repeat(by_word / np.sqrt(features.counts)[:, None], features.counts, axis=0))
            starts = np.cumsum(sizes) - sizes
            follows = np.ones(len(truth), bool)
            follows[starts] = False
            seen = np.zeros_like(transitions)
            np.add.at(seen, (truth[:-1][follows[1:]], truth[1:][follows[1:]]), 1)
            step, step_t = gradient / len(truth) - 1e-7 * weights, (seen - expected) / len(truth)
            grown += step * step
            grown_t += step_t * step_t
            weights += rate * step / np.sqrt(grown)
            transitions += rate * step_t / np.sqrt(grown_t)
    return Model(languages, weights.astype(np.float32), transitions, lexicon)


def train(docs: DataFrame, use: Column, id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model | None:
    """Fit on a bounded sample of rows of ``docs`` for which ``use`` holds."""
    from pyspark.sql import Window

    rows = docs.filter(use & F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.lit(17), id).alias("h"))
    count = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not count:
        return None
    # Only rows whose hash falls under a limit of twice the sample reach the ranking, so the texts moved stay bounded.
    limit = F.create_map(*[x for la, n in count.items() for x in (F.lit(la), F.lit(int(min(1.0, 2 * per_language / n) * (1 << 62)) * 2 - (1 << 63) if 2 * per_language < n else (1 << 63) - 1))])
    few = rows.filter(F.col("h") <= limit[F.col("lang")])
    ranked = few.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).filter(F.col("k") <= per_language)

    def learn(batches):
        frames = [b for b in batches if len(b)]
        if frames:
            all_ = pd.concat(frames).sort_values(["lang", "h", "text"])
            model = fit(list(zip(all_["text"], all_["lang"])))
            if model:
                yield pd.DataFrame({"model": [model.to_bytes()]})

    found = ranked.select("lang", "text", "h").coalesce(1).mapInPandas(learn, "model binary").collect()
    return Model.from_bytes(bytes(found[0].model)) if found else None


def identify(docs: DataFrame, model: Model | None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, lang_pred, score) for each row."""

    def label(texts: list[str | None]) -> list:
        return list(model.predict(texts)) if model else [[UNDETERMINED] * len(texts), [0.0] * len(texts)]

    return map_texts(docs.select(id, text), text, "lang_pred string, score double", lambda: label, SLICE_CHARS)


def keep_identified(docs: DataFrame, model: Model | None, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, whose main language holds at least ``least`` of the words' marginals."""
    if not model:
        return docs.limit(0)

    def make():
        def known(texts: list[str | None]) -> np.ndarray:
            names, scores = model.predict(texts)
            return np.array([n != UNDETERMINED and s >= least for n, s in zip(names, scores)], bool)

        return known

    return docs.filter(decide(docs.sparkSession, make, SLICE_CHARS)(F.col(text)))
