"""SentencePiece encoding that keeps source offsets, and decoding.

Normalisation follows the model's compiled character map: at each place the longest prefix in the map's
double-array trie is replaced, and for every normalised byte the first source byte it stands for is kept; bytes that the map leaves alone
stand for themselves. Each piece of the encoding is projected through that alignment to a span of bytes of the original text; spans of a
text follow each other without gaps or overlaps. Models without a map (identity) keep the bytes. The pieces have to spell
the normalised text byte for byte, or the encoding fails.

In models where no piece crosses the start of a word, a text's encoding and alignment are those of its words, so each distinct
word of a slice of texts is normalised and encoded once.

Defined results: a null text is encoded as an empty one, which has the end id only; repeated rows each keep their
row; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from furrow.llm.batches import map_texts

SPACE = "▁"
WORDS = re.compile(r" *[^ ]+| +")
#: Bytes of text encoded at a time; bounds a task's memory.
SLICE_BYTES = 400_000


class CharMap:
    """The compiled character map: a double-array trie whose values are places in a block of zero-ended strings."""

    def __init__(self, blob: bytes):
        self.units, self.text = np.zeros(0, np.uint32), b""
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.units, self.text = np.frombuffer(blob, "<u4", size // 4, 4), blob[4 + size :]
        self.units = self.units.tolist()

    def longest(self, source: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes of the longest prefix of source[at:] in the map, its replacement)."""
        units, found = self.units, None
        if not units:
            return None
        unit = units[0]
        node = (unit >> 10) << ((unit & 0x200) >> 6)
        for k in range(at, len(source)):
            byte = source[k]
            node ^= byte
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != byte:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                value = units[node] & 0x7FFFFFFF
                found = (k + 1 - at, self.text[value : self.text.index(b"\0", value)])
        return found


def char_bytes(first: int) -> int:
    return 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4


def normalise(text: str, charmap: CharMap, dummy_prefix: bool = True, squeeze: bool = False) -> tuple[bytes, np.ndarray]:
    """(normalised bytes, for each of them and for the end the source byte it starts at).

    ``dummy_prefix`` puts a space sign before the text; ``squeeze`` drops outer spaces and keeps one of each run.
    """
    source, sign = text.encode(), SPACE.encode()
    if not charmap.units and not squeeze:
        raw = np.frombuffer(source, np.uint8)
        align = np.repeat(np.arange(len(raw) + 1), np.append(np.where(raw == 32, len(sign), 1), 1))
        prefix = dummy_prefix and bool(source)
        return (sign if prefix else b"") + source.replace(b" ", sign), np.concatenate([np.zeros(len(sign) * prefix, np.int64), align])
    out, align, at = bytearray(), [], 0
    parts: list[tuple[bytes, int, bool]] = []
    while at < len(source):
        hit = charmap.longest(source, at)
        n, new = hit if hit else (char_bytes(source[at]), source[at : at + char_bytes(source[at])])
        parts.append((new, at, hit is None))
        at += n
    last_space = squeeze
    if dummy_prefix and parts:
        out += sign
        align += [0] * len(sign)
    for new, where, kept in parts:
        if squeeze and last_space:
            new = new.lstrip(b" ")
        if not new:
            continue
        for k, byte in enumerate(new):
            piece = sign if byte == 32 else bytes((byte,))
            out += piece
            align += [where + k * kept] * len(piece)
        last_space = squeeze and new.endswith(b" ")
    if squeeze:
        while out.endswith(sign):
            del out[-len(sign) :], align[-len(sign) :]
        if out == sign:
            out, align = bytearray(), []
    return bytes(out), np.array([*align, len(source)], np.int64)


class Encoder:
    """A loaded model with what the offsets need: each piece's normalised bytes."""

    def __init__(self, model: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(model, "rb") as f:
            raw = f.read()
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(raw)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=raw)
        spec = proto.normalizer_spec
        self.charmap, self.dummy, self.squeeze = CharMap(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces
        kinds = proto.SentencePiece
        #: The normalised bytes that each piece spells.
        self.spelt = [bytes((int(p.piece[3:5], 16),)) if p.type == kinds.BYTE else b"" if p.type == kinds.CONTROL else p.piece.encode() for p in proto.pieces]
        self.unknown = self.library.unk_id()
        inner = any(SPACE in p.piece.lstrip(SPACE) for p in proto.pieces)
        own = any(p.type == kinds.USER_DEFINED for p in proto.pieces)
        self.by_word = not (self.charmap.units or inner or own or self.squeeze) and self.dummy and spec.escape_whitespaces and proto.trainer_spec.byte_fallback
        self.end, self.sign = self.library.eos_id(), self.library.piece_to_id(SPACE)

    def projected(self, surfaces: list[bytes], text: str, dummy: bool) -> np.ndarray:
        """The first source byte of each piece and of the end, through the alignment of the normalised text."""
        norm, align = normalise(text, self.charmap, dummy, self.squeeze)
        if b"".join(surfaces) != norm:
            raise ValueError("the pieces don't spell the normalised text")
        return align[np.concatenate([[0], np.cumsum(np.fromiter(map(len, surfaces), np.int64, len(surfaces)))])]

    def whole(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first source byte of each piece and of the end) of a text encoded as a whole."""
        ids = self.library.encode(text, num_threads=1)
        surfaces = [self.spelt[i] for i in ids]
        if self.unknown in ids:  # an unknown piece stands for a run of characters
            surfaces = [w.encode() if i == self.unknown else s for w, i, s in zip(self.library.encode(text, out_type=str, num_threads=1), ids, surfaces)]
        return np.array(ids, np.int32), self.projected(surfaces, text, self.dummy)

    def by_words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text, source end of each piece in its text); each distinct word is encoded once.

        Where the map is empty the alignment of words in a row is that of each, so the distinct words, each with the space before it, are normalised together.
        """
        words, counts = [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            own = WORDS.findall(text)
            if own:
                own[0] = " " + own[0]  # the sign put before a text
            counts[k] = len(own)
            words += own
        code, distinct = pd.factorize(pd.Series(words, dtype=object))
        distinct = list(distinct)
        # The library puts the sign before each word too; a word of spaces alone is read up to its last space.
        encoded = [e or [self.sign] for e in self.library.encode([w[1:] for w in distinct], num_threads=1)] if distinct else []
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        flat = np.fromiter((i for e in encoded for i in e), np.int32, int(sizes.sum()))
        bounds = self.projected([self.spelt[i] for i in flat.tolist()], "".join(distinct), False)
        first = np.cumsum(sizes) - sizes
        word_start, word_end = bounds[first], bounds[first + sizes]
        ends_in_word = bounds[1:] - np.repeat(word_start, sizes)
        n, length = sizes[code], (word_end - word_start)[code]
        at = np.repeat(first[code] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        before, start = np.cumsum(length) - length, np.cumsum(counts) - counts
        in_text = before - np.repeat(np.append(before, 0)[start], counts)
        # The sign put before a text stands for no byte of it.
        ends = np.maximum(ends_in_word[at] + np.repeat(in_text, n) - 1, 0)
        pieces = np.concatenate([[0], np.cumsum(n)])
        return flat[at], pieces[start + counts] - pieces[start], ends

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, number of ids of each text, first and end source byte of each piece); each text ends with the end id."""
        plain = [self.by_word and SPACE not in t for t in texts]
        ids, n, word_ends = self.by_words([t if p else "" for t, p in zip(texts, plain)])
        at, out, lasts, firsts, sizes = 0, [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64)
        end = np.array([self.end], np.int32)
        for k, text in enumerate(texts):
            if plain[k]:
                own, ends = ids[at : at + n[k]], word_ends[at : at + n[k]]
                at += n[k]
            else:
                own, bounds = self.whole(text)
                ends = bounds[1:]
            last = ends[-1:] if len(ends) else np.zeros(1, np.int32)
            out += [own, end]
            firsts += [np.zeros(1, np.int32), ends]
            lasts += [ends, last]
            sizes[k] = len(own) + 1
        return tuple(np.concatenate(x).astype(kind) for x, kind in ((out, np.int32), (sizes[None], np.int64), (firsts, np.int32), (lasts, np.int32)))


def encode_texts(docs: DataFrame, model: str, id: str = "doc_id", text: str = "text", decode: bool = True) -> DataFrame:
    """(id, ids, first_bytes, end_bytes[, decoded]): the ids of each text with the end id, each piece's source span, and the ids decoded again."""

    def make():
        encoder = Encoder(model)

        def f(texts: list[str | None]) -> list:
            ids, sizes, first, end = encoder.encode([t or "" for t in texts])
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            made = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x)) for x in (ids, first, end)]
            return made + [[encoder.library.decode(ids[x:y].tolist()) for x, y in zip(offsets, offsets[1:])]] * decode

        return f

    return map_texts(docs.select(id, text), text, "ids array<int>, first_bytes array<int>, end_bytes array<int>" + ", decoded string" * decode, make, SLICE_BYTES)
