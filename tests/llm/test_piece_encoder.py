"""Texts of the byte-level tokenizer are cut by one pattern, each distinct pre-token is encoded once."""

import random
from functools import cache

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from ledgerlens.llm import tokenize
from ledgerlens.llm.tokenize import TextEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABETS = [
    "abstrevmlldZQ019''''..,!_-~&   \t\n\x0b\r\x1c\x1f\x00\x7f",
    "aébÈçÑßüÜ¡«»…—’'sSt019 \n \u0085 　​﻿",
    "abéσΣςİıſǅẞΩ²½Ⅷ٣०१ ._语言二三，。「ガパ한국नमस्ते\n",
    "a😀👩‍💻❤𝒜𝟘𐐀\U0010ffff͸ 'll",
]


@cache
def _tokenizer():
    return tokenizers.Tokenizer.from_file(PATH)


def _expected(texts):
    return [np.array(e.ids, "<u4").tobytes() for e in _tokenizer().encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("alphabet", [*ALPHABETS, "".join(ALPHABETS)])
def test_ids_equal_the_tokenizers(alphabet):
    rnd = random.Random(len(alphabet))
    texts = ["".join(rnd.choices(alphabet, k=rnd.randrange(60))) for _ in range(1500)] + list(alphabet) + [""]
    encoder = TextEncoder(PATH)
    assert encoder.encode_batch(texts) == _expected(texts)
    assert encoder.encode_batch(texts) == _expected(texts)


def test_each_code_point_gets_the_tokenizers_ids():
    points = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}a{c}{c}1{c} !{c}  {c}\n" for c in points]
    assert TextEncoder(PATH).encode_batch(texts) == _expected(texts)


def test_a_pre_token_is_encoded_once_whatever_stands_around_it():
    encoder = TextEncoder(PATH)
    calls, merged = [], encoder.plain.merged
    encoder.plain.merged = lambda word: calls.append(word) or merged(word)
    texts = ["Late late, late.", "Late\nété late;", "Late late."]
    assert encoder.encode_batch(texts) == _expected(texts)
    assert sorted(calls) == sorted({"Late", "Ġlate", ",", ".", ";", "Ċ", "Ã©tÃ©"})


def test_a_worker_reads_the_vocabulary_once(monkeypatch):
    read, calls = tokenizers.Tokenizer.from_file, []

    class Counted:
        from_file = staticmethod(lambda path: calls.append(path) or read(path))

    monkeypatch.setattr(tokenizers, "Tokenizer", Counted)
    TextEncoder(PATH)
    assert calls == [PATH]


def test_caches_share_one_bound(monkeypatch):
    monkeypatch.setattr(tokenize, "MAX_PIECES", 10)
    encoder = TextEncoder(PATH)
    for k in range(30):
        texts = [f"w{k} x{k} ² {k}x {'y' * 500}", f"v{k} u{k}"]
        assert encoder.encode_batch(texts) == _expected(texts)
        plain = encoder.plain
        assert len(plain.units) + len(plain.pieces) + len(getattr(plain, "words", ())) <= 10 + 20
