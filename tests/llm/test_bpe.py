from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wireloom.llm import bpe, lexicon

PATH = public_tokenizers.path("byte_bpe_50k.json")
THEIRS = Tokenizer.from_file(PATH)
ODD = [
    "", "<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "  \n\n <|endoftext|>x  ", "'s'll it's   \t\n x", "🤦🏼‍♂️ x" * 5,
    "a" * 5000, "ab" * 3000 + " " * 3000, "\x00\x1f\x85 ﻿", "日本語" * 100, "x" * 48, "x" * 49, "don't DON'T",
]


def ids(data: bytes) -> list[int]:
    return np.frombuffer(data, "<u4").tolist()


def encoder(words: list[str], tmp_path) -> bpe.Encoder:
    own = bpe.tokenizer(PATH)
    coded = [w.encode() for w in words]
    path = tmp_path / "lexicon.bin"
    path.write_bytes(lexicon.compile_lexicon(zip(coded, map(ids, own.merged_together(coded)), strict=True)))
    return bpe.Encoder(own, lexicon.Lexicon(path))


def test_odd_texts(tmp_path):
    for own in (bpe.Encoder(bpe.tokenizer(PATH)), encoder(["a", " x", "don", "日本"], tmp_path), encoder([], tmp_path)):
        got = own.encode(ODD)
        for t, g, w in zip(ODD, got, THEIRS.encode_batch(ODD, add_special_tokens=False), strict=True):
            assert ids(g) == w.ids
            assert bpe.decode_bytes(g, own.tokens) == THEIRS.decode(w.ids, skip_special_tokens=False) == t


def test_every_character():
    own = bpe.Encoder(bpe.tokenizer(PATH))
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    for at in range(0, len(points), 5000):
        texts = [f"a{c} 1{c}a {c}{c}. {c}'s" for c in points[at : at + 5000]]
        for t, g, w in zip(texts, own.encode(texts), THEIRS.encode_batch(texts, add_special_tokens=False), strict=True):
            assert ids(g) == w.ids, t


@settings(max_examples=500, deadline=None)
@given(st.lists(st.text(alphabet=" '\n\u3000stmdrevlLa1é.-", max_size=30), max_size=5))
def test_texts_of_borders(texts):
    got = bpe.Encoder(bpe.tokenizer(PATH)).encode(texts)
    assert [ids(g) for g in got] == [e.ids for e in THEIRS.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    got = bpe.Encoder(bpe.tokenizer(PATH)).encode([text])[0]
    want = THEIRS.encode(text, add_special_tokens=False).ids
    assert ids(got) == want
    assert bpe.decode_bytes(got, bpe.tokenizer(PATH)) == THEIRS.decode(want, skip_special_tokens=False)


@given(st.lists(st.binary(min_size=1, max_size=60), max_size=30))
@settings(deadline=None)
def test_both_merges_agree(words):
    own = bpe.tokenizer(PATH)
    assert [ids(x) for x in own.merged_together(words)] == [own.merged(w) for w in words]


@given(words=st.sets(st.binary(min_size=1, max_size=6), max_size=60), others=st.lists(st.binary(max_size=7), max_size=30))
@settings(deadline=None)
def test_the_lexicon_holds_its_words_and_no_others(words, others, tmp_path_factory):
    path = tmp_path_factory.mktemp("lex") / "l.bin"
    entries = {w: list(w) + [len(w)] for w in words}
    path.write_bytes(lexicon.compile_lexicon(entries.items()))
    own = lexicon.Lexicon(path)
    asked = [*words, *others]
    for w, number in zip(asked, own.numbers(asked).tolist(), strict=True):
        assert (number >= 0) == (w in entries)
        if number >= 0:
            assert ids(own.ids_of(number)) == entries[w]


def test_suffixes_are_shared():
    build = lexicon._Builder()
    for w in sorted([b"nation", b"station", b"ration", b"option"]):
        build.add(w)
    build.end()
    assert len(build.states) < 16 and len(set(build.states)) == len(build.states)


def test_damaged_file(tmp_path):
    (tmp_path / "x").write_bytes(b"nothing like it, but long enough to look at")
    with pytest.raises(ValueError):
        lexicon.Lexicon(tmp_path / "x")


def test_query_against_the_library(spark, docs, sf, monkeypatch):
    from wireloom.llm.queries import QUERIES, token_digests

    def want(t):
        w = THEIRS.encode(t or "", add_special_tokens=False).ids
        return len(w), hashlib.sha256(np.array(w, "<u4").tobytes()).hexdigest(), hashlib.sha256(THEIRS.decode(w, skip_special_tokens=False).encode()).hexdigest()

    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op10_bpe_encoding"](spark, sf).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == {i: want(t) for i, t in rows.items()}
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 3)
    monkeypatch.setattr(bpe, "COUNTED_WORDS", 2)
    odd = [(i, t) for i, t in enumerate(ODD)] + [(0, "dup"), (None, None)]
    got = token_digests(docs(odd).withColumnRenamed("source", "ids")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(i, *want(t)) for i, t in odd], key=repr)
    assert token_digests(docs([])).count() == 0


def test_decode_column(spark):
    rows = [(np.array(THEIRS.encode(t).ids, "<u4").tobytes(),) for t in ODD] + [(None,), (b"",), (np.array([127], "<u4").tobytes(),)]
    df = spark.createDataFrame(rows, "ids binary")
    got = [r[0] for r in df.select(bpe.decoded(df.ids, PATH)).collect()]
    assert got == [*ODD, "", "", THEIRS.decode([127])]
