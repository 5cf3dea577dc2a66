"""Licence templates, token counts, media columns and SentencePiece spans against brute force."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest

from furrow.llm import licenses, media, pieces, tokencount
from furrow.llm.queries import QUERIES
from furrow.session import fresh_path, table

WORD_BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def count_with_library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_BPE)
    return [len(e) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("which", ["odd", "small"])
def test_token_counts(spark, odd, small, which):
    docs = odd if which == "odd" else table(spark, small, "documents")
    rows = texts_of(docs)
    want = sorted(((i, len((t or "").encode()), n, n > 2048) for (i, t), n in zip(rows, count_with_library([t for _, t in rows]))), key=repr)
    got = tokencount.token_counts(docs, WORD_BPE)
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_token_cache_encodes_only_misses(spark, odd, none):
    cache = fresh_path(spark, "cache")
    assert tokencount.token_counts(none, WORD_BPE, cache).count() == 0
    first = tokencount.fill_cache(odd.limit(6), "text", WORD_BPE, cache).count()
    again = tokencount.fill_cache(odd.limit(6), "text", WORD_BPE, cache).count()
    assert first == again == odd.limit(6).selectExpr("coalesce(text, '')").distinct().count()
    assert first < tokencount.fill_cache(odd, "text", WORD_BPE, cache).count()
    assert sorted(r.n_tokens for r in tokencount.token_counts(odd, WORD_BPE, cache).collect()) == sorted(count_with_library([t for _, t in texts_of(odd)]))


def test_tokenizers_that_keep_spaces_get_whole_texts(odd):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert tokencount.ends_at_white_space(WORD_BPE) and not tokencount.ends_at_white_space(path)
    t = Tokenizer.from_file(path)
    want = sorted(len(t.encode(x or "", add_special_tokens=False)) for _, x in texts_of(odd))
    assert sorted(r.n_tokens for r in tokencount.token_counts(odd, path).collect()) == want


@pytest.mark.parametrize("which", ["odd", "small"])
def test_pieces(spark, odd, small, which):
    import sentencepiece

    docs = odd if which == "odd" else table(spark, small, "documents")
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = []
    for i, t in texts_of(docs):
        ids = sp.encode(t or "", add_eos=True)
        want.append((i, ids, sp.decode(ids), t))
    got = [tuple(r) for r in pieces.encode_texts(docs, PIECES).collect()]
    assert sorted(((i, list(a), d) for i, a, _, _, d in got), key=repr) == sorted(((i, a, d) for i, a, d, _ in want), key=repr)
    by_ids = {(i, tuple(a)): t for i, a, _, t in want}
    for i, ids, first, end, _ in got:
        raw = (by_ids[i, tuple(ids)] or "").encode()
        assert list(first[1:]) == list(end[:-1]) and first[0] == 0 and end[-1] == len(raw)
        for piece, a, b in zip(ids[:-1], first, end):
            if not sp.is_byte(piece) and a > 0:
                assert raw[a:b].decode().replace(" ", "▁") == sp.id_to_piece(piece)


def test_pieces_of_nothing(none):
    assert pieces.encode_texts(none, PIECES).count() == 0


def test_spans_agree_with_library_for_each_way():
    encoder = pieces.Encoder(PIECES)
    assert encoder.by_word
    for text in ("Hello  world", " a b", "naïve 日本 x", "x\ny  ", "é"):
        ids, _, first, end = encoder.encode([text])
        whole, bounds = encoder.whole(text)
        assert ids[:-1].tolist() == whole.tolist() and first[:-1].tolist() == bounds[:-1].tolist() and end[:-1].tolist() == bounds[1:].tolist()


def test_a_damaged_alignment_changes_the_spans(monkeypatch):
    """The spans that the query digests come from the alignment; pieces that don't spell the normalised text are an error."""
    whole, bad = pieces.normalise, pieces.Encoder(PIECES)
    text = "Hello  world naïve"
    good = bad.encode([text])
    monkeypatch.setattr(pieces, "normalise", lambda *a: (whole(*a)[0], whole(*a)[1] // 2))
    assert bad.encode([text])[3].tolist() != good[3].tolist()
    monkeypatch.setattr(pieces, "normalise", lambda *a: (whole(*a)[0] + b"x", whole(*a)[1]))
    with pytest.raises(ValueError, match="spell"):
        bad.encode([text])


def test_pieces_query(spark, small):
    """The digests of the registered query against the library; spans against the library's own places."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = dict(texts_of(table(spark, small, "documents")))
    rows = QUERIES["op8_sentencepiece_spans"](spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids, digest = sp.encode(texts[r.doc_id], add_eos=True), lambda x: hashlib.sha256(x.encode()).hexdigest()
        spans = sp.encode(texts[r.doc_id], return_type="proto")
        ends = [p.end for p in spans.pieces]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(" ".join(map(str, ids))), digest(sp.decode(ids)))
        if not any(sp.is_byte(i) for i in ids):  # the library gives bytes of one character no places of their own
            assert r.spans_sha256 == digest(" ".join(map(str, [*ends, *(ends[-1:] or [0])])))


def test_charmap_takes_the_longest_prefix():
    """Against the library's own normaliser, whose compiled map is read here."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    normalizer = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(normalizer.serialized_model_proto())
    charmap = pieces.CharMap(proto.normalizer_spec.precompiled_charsmap)
    assert charmap.units
    for text in ("ﬁne ½ ｱｲ ①②", "été", "ｶﾞｷﾞ x", "㍿ plain", "tab\there", ""):
        spec = proto.normalizer_spec
        norm, align = pieces.normalise(text, charmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces)
        assert norm.decode() == normalizer.normalize(text)
        assert len(align) == len(norm) + 1 and align[-1] == len(text.encode()) and (np.diff(align) >= 0).all()


def test_media_round_trip(spark, odd, none):
    docs = odd.select("doc_id", "text", "size")
    rows = media.media_columns(media.pack_texts(docs), payload=True).collect()
    want = sorted((t or "").encode().ljust(max(192, -(-len((t or "").encode()) // 192) * 192)) for _, t in texts_of(docs))
    assert sorted(bytes(r.payload) for r in rows) == want
    for r in rows:
        assert r.error is None and r.codec == "raw " and (r.width, r.height) == (16, 12) and r.n_samples * 192 == len(r.payload)
        assert r.duration == pytest.approx(r.n_samples / 24) and len(r.keyframes) == -(-r.n_samples // 24)
        for k in r.keyframes:
            assert bytes(r.media[k.first_byte : k.first_byte + k.n_bytes]) == bytes(r.payload[k.sample * 192 : k.sample * 192 + 192])
    assert media.media_columns(media.pack_texts(none)).count() == 0


def test_media_query(spark, small):
    texts = dict(texts_of(table(spark, small, "documents")))
    for r in QUERIES["op7_media_columns"](spark, small).collect():
        raw = texts[r.doc_id].encode()
        full = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
        n = len(full) // 192
        assert r.media_bytes > r.payload_bytes and r.media_sha256 == hashlib.sha256(media.pack_frames(full)).hexdigest()
        keys, head = range(0, n, 24), len(media.box(b"ftyp", b"isom", b"\0" * 12)) + 8
        assert r.feature == f"codec=raw;size=16x12;duration={n / 24:.6f};samples={n};keyframes={len(keys)};first={head}+192;last={head + keys[-1] * 192}+192"


def test_media_tables_of_other_files():
    import struct

    data = b"0123456789abcdef" * 4
    tables = [
        media.full_box(b"stsd", struct.pack(">I", 1), media.box(b"mp4a", b"\0" * 28)), media.full_box(b"stts", struct.pack(">IIIII", 2, 4, 10, 1, 20)),
        media.full_box(b"stsc", struct.pack(">IIIIIII", 2, 1, 2, 1, 2, 1, 1)), media.full_box(b"stsz", struct.pack(">IIIIIII", 0, 5, 3, 4, 5, 6, 7)),
    ]
    head = media.box(b"ftyp", b"isom", b"\0\0\0\0")
    at = len(head) + 8
    tables.append(media.full_box(b"stco", struct.pack(">IIIII", 4, at, at + 10, at + 20, at + 30)))
    mdia = media.box(b"mdia", media.full_box(b"mdhd", struct.pack(">IIIIHH", 0, 0, 100, 50, 0, 0)), media.box(b"minf", media.box(b"stbl", *tables)))
    f = head + media.box(b"mdat", data) + media.box(b"moov", media.box(b"trak", mdia))
    found = media.describe(f, payload=True)
    assert found["codec"] == "mp4a" and found["duration"] == 0.6  # by the sample times; the header says 0.5
    assert [k["seconds"] for k in found["keyframes"]] == [0.0, 0.1, 0.2, 0.3, 0.4]
    assert [(k["first_byte"] - at, k["n_bytes"]) for k in found["keyframes"]] == [(0, 3), (3, 4), (10, 5), (20, 6), (30, 7)]
    assert found["payload"] == data[:7] + data[10:15] + data[20:26] + data[30:37]
    for broken in (b"", f[:-9], b"\0\0\0\x04abcd", None, head):
        assert media.describe(broken)["error"]


def test_media_fragments():
    """Two fragments of a fragmented file: defaults from trex and tfhd, sizes, times and sync flags from the runs."""
    import struct

    full, box = media.full_box, media.box
    table = [full(b"stsd", struct.pack(">I", 1), box(b"avc1", b"\0" * 78)), *(full(k, struct.pack(">I", 0)) for k in (b"stts", b"stsc", b"stco")), full(b"stsz", struct.pack(">II", 0, 0))]
    mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 1000, 0, 0, 0)), full(b"hdlr", struct.pack(">I4s12x", 0, b"vide"), b"\0"), box(b"minf", box(b"stbl", *table)))
    moov = box(b"moov", box(b"trak", full(b"tkhd", struct.pack(">IIII", 0, 0, 7, 0)), mdia), box(b"mvex", full(b"trex", struct.pack(">5I", 7, 1, 40, 5, 0x10000))))
    head = box(b"ftyp", b"iso5", b"\0\0\0\0") + moov

    def one(offset):  # three samples of five bytes and 40 ticks, the first of them a sync sample
        return [full(b"trun", struct.pack(">IiI", 3, offset, 0), flags=0x5)]

    def two(offset):  # a run with own sizes, times and flags, and one that goes on behind it
        return [full(b"trun", struct.pack(">Ii6I", 2, offset, 10, 2, 0, 30, 4, 0x10000), flags=0x701), full(b"trun", struct.pack(">I", 1))]

    def build(time, runs):
        size = len(box(b"moof", full(b"mfhd", struct.pack(">I", 1)), box(b"traf", full(b"tfhd", struct.pack(">I", 7), flags=0x20000), full(b"tfdt", struct.pack(">Q", time), version=1), *runs(0))))
        return box(b"moof", full(b"mfhd", struct.pack(">I", 1)), box(b"traf", full(b"tfhd", struct.pack(">I", 7), flags=0x20000), full(b"tfdt", struct.pack(">Q", time), version=1), *runs(size + 8)))

    first = head + build(0, one) + box(b"mdat", b"aaaaabbbbbccccc")
    f = first + build(500, two) + box(b"mdat", b"ddeeeefffff")
    found = media.describe(f, payload=True)
    assert found["payload"] == b"aaaaabbbbbcccccddeeeefffff" and found["n_samples"] == 6 and found["codec"] == "avc1"
    assert [(k["sample"], f[k["first_byte"] : k["first_byte"] + k["n_bytes"]], k["seconds"]) for k in found["keyframes"]] == [(0, b"aaaaa", 0.0), (3, b"dd", 0.5)]
    assert found["duration"] == 0.58 and found["tracks"][0]["n_keyframes"] == 2
    assert media.describe(f[:-3])["error"] and media.describe(first[:-8])["error"]


def test_license_markup():
    a = licenses.Automaton({"x": 'one <<beginOptional>>two <<beginOptional>>deep<<endOptional>><<endOptional>> three <<var;name="n";original="";match=".{1,2}">> end', "y": 'loop <<var;match=".+">> stop'})
    ok = lambda t: set(a.labels(licenses.words_of(t)))
    assert ok("zero One, two THREE a end") == {"x"} and ok("one two deep three a b end") == {"x"} and ok("one three a b c end") == set() and ok("one deep three a end") == set()
    assert ok("loop a b c d e stop") == {"y"} and ok("loop stop") == set() and ok("") == set()
    with pytest.raises(ValueError):
        licenses.parse("<<beginOptional>> a")


def test_whole_license_texts(spark):
    """A text without its disclaimer is no licence text; holders and marks may differ; a notice scores less than a text."""
    plain = {label: licenses.MARKUP.sub(lambda m: "A. Holder" if m[1] else "", t) for label, t in licenses.TEXTS.items()}
    docs = [(k, x) for k, x in enumerate(plain.values())] + [(10 + k, x[: len(x) * 2 // 3]) for k, x in enumerate(plain.values())] + [(20, "Released under the MIT License.")]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [got[k] for k in range(3)] == [(label, 1.0) for label in plain]
    assert all(got[10 + k] == ("", 0.0) for k in range(3)) and got[20] == ("mit,mit-notice", 0.75)


def test_license_scan_of_odd_rows(odd, none):
    rows = licenses.scan_licenses(odd).collect()
    assert len(rows) == 12 and licenses.scan_licenses(none).count() == 0
    for r in rows:
        text = {4: "mit", 5: "mit"}.get(r.doc_id, "")
        assert r.base_labels == text and (r.first_word is None) == (not text) and r.score == (0.5 if text else 0)
    texts = ["Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License."]
    df = odd.sparkSession.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.labels for r in licenses.scan_licenses(df).orderBy("doc_id").collect()] == ["cc-by,cc-by-nc", "gpl,gpl-notice", "mit,mit-notice"]
