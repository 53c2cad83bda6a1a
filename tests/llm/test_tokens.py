"""Token segments and pieces: exact round trips and the libraries' own results."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from helpers import clashing, docs, odd_texts
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from matchwright.llm import pieces, token_files

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "It's O'Neil'S don't 've'", "Straße ÉCOLE œuvre ŒUVRE", "a—b … «x» ¿q?", "<|endoftext|> hi", "x_y-z__ 1,234.5",
    "É combining", "\x1c\x1da\x85b", "ΣΑΣ", "naïve\xa0nbsp", "²³ª", "日本語", "▁x ▁▁y", "  a  b   c ", "\n\n x\ty", "", " ",
]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=3000), st.sampled_from([1, 3, 128, 1024]), st.sampled_from([1, 50, 90, 100]))
def test_segments_round_trip(values, block, percentile):
    values = np.array(values, dtype=np.uint32)
    segment = token_files.encode_segment(values, block, percentile)
    assert (token_files.decode_blocks(segment) == values).all()
    assert (token_files.decode_blocks(segment, 1, 3) == values[block : 3 * block]).all()


def test_outliers_go_to_the_exception_list():
    values = np.full(1024, 7, np.uint32)
    values[::100] = 4_000_000_000
    assert len(token_files.encode_segment(values)) < 200  # 11 exceptions, width 0
    assert (token_files.decode_blocks(token_files.encode_segment(values)) == values).all()


def test_words_equal_whole_texts():
    tokenizer, encoder = Tokenizer.from_file(WORDS), token_files.WordEncoder(WORDS, remember=30)
    ends = ["'s", "'some", "''s", "x''t", "don't've", "we're they'll I'd've 'm 'r 'v", "'", "a'", "'ll'", "it's'", "5's", "'RE", "l'été"]
    for text in TEXTS + ends + [" ".join(ends)]:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids


def test_long_texts_are_split_at_blanks(monkeypatch):
    monkeypatch.setattr(token_files.WordEncoder, "UNITS", 40)
    tokenizer, encoder = Tokenizer.from_file(WORDS), token_files.WordEncoder(WORDS)
    texts = ["some words and more " * 30, "x" * 300, "a " * 10 + "y" * 90 + " b", "short", "<|endoftext|> " * 20]
    for text, own in zip(texts, encoder.encode_all(texts), strict=True):
        assert np.frombuffer(own, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_token_table(spark):
    df = docs(spark, odd_texts() + TEXTS)
    got = sorted(map(tuple, token_files.token_table(clashing(df), WORDS).collect()), key=lambda r: r[1])
    tokenizer = Tokenizer.from_file(WORDS)
    rows = sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    start = 0
    for row, mine in zip(rows, got, strict=True):
        ids = [*tokenizer.encode(row.text or "", add_special_tokens=False).ids, 1]
        assert mine == (row.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_table_of_nothing(spark):
    assert token_files.token_table(docs(spark, []), WORDS).count() == 0


def spans_by_library(library, text):
    return [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]


@pytest.mark.parametrize("text", TEXTS + [t for t in odd_texts() if isinstance(t, str)])
def test_pieces_and_their_spans(text):
    library, encoder = sentencepiece.SentencePieceProcessor(model_file=PIECES), pieces.PieceEncoder(PIECES, remember=5)
    ids, spans = encoder.encode(text)
    assert ids.tolist() == library.encode(text)
    for i, mine, own in zip(ids.tolist(), spans.tolist(), spans_by_library(library, text), strict=True):
        if not library.is_byte(i):  # the library gives a character to its last byte only
            assert tuple(mine) == own
    assert spans.size == 0 or (spans[0][0] == 0 and spans[-1][1] == len(text.encode()) and (spans[1:, 0] == spans[:-1, 1]).all())


def test_piece_table(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    df = docs(spark, odd_texts())
    want = []
    for row in df.collect():
        ids = library.encode(row.text or "", add_bos=True, add_eos=True)
        want.append((row.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    got = [tuple(r)[:4] for r in pieces.piece_table(clashing(df), PIECES).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert pieces.piece_table(docs(spark, []), PIECES).count() == 0


# -- a compiled character map ----------------------------------------------------------


def nfkc():
    return sentencepiece.SentencePieceNormalizer(rule_name="nfkc")


def test_character_map_and_normalising():
    normalizer = nfkc()
    model = normalizer.serialized_model_proto()
    spec = next(dict(pieces._fields(v)) for f, v in pieces._fields(model) if f == 3)
    rules = pieces.read_character_map(spec[2])
    assert rules["ﬁ".encode()] == b"fi" and rules["①".encode()] == b"1" and len(rules) > 1000
    encoder = pieces.PieceEncoder.__new__(pieces.PieceEncoder)
    encoder.set_rules(rules)
    for trim, prefix, escape in [(True, True, True), (True, False, True), (False, True, True), (False, False, False), (True, True, False)]:
        encoder.trim, encoder.prefix, encoder.escape = trim, prefix, escape
        spec_bytes = bytes([0x18, prefix, 0x20, trim, 0x28, escape])
        own = sentencepiece.SentencePieceProcessor
        library = sentencepiece.SentencePieceNormalizer(model_proto=model + b"\x1a" + bytes([len(spec_bytes)]) + spec_bytes)
        for text in ["ﬁne ① ｱﾊﾟ", "  two  spaces ", "é é ü", "㍿ x", "a　b", "", "   ", "plain"]:
            normal, alignment = encoder.normalise(text)
            assert normal == library.normalize(text), (text, trim, prefix, escape)
            size = len(normal.encode())
            places = alignment.project(np.arange(size + 1))
            assert (np.diff(places) >= 0).all() and places[-1] <= len(text.encode())
