"""Texts of the word tokenizer are cut by one pattern, each distinct word is encoded once."""

import random
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerlens.llm import tokenize
from ledgerlens.llm.tokenize import ASCII_WORDS, TextEncoder, WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
ALPHABETS = [
    "abstrevmlldZQ019''''..,!_-~&   \t\n\x0b\r\x1c\x1f\x00\x7f",
    "aébÈçÑßüÜœŒÿ¡«»…—’'sSt019 \n \u0085 　​﻿",
    "abéȩ́̊σΣςİıſǅßẞKΩ²½Ⅷ٣०१ẛ̣ ._",
    "语言模型的一 二三，。「日本語カタカナ゙がパ한국어각 नमस्ते दुनिया กำ ",
    "a😀👩‍💻🏽️❤𝒜𝟘𐐀𐐨ꟲ𞤀\U0010ffff͸ 'll",
]


@cache
def _tokenizer():
    return Tokenizer.from_file(PATH)


def _expected(texts):
    return [np.array(e.ids, "<u4").tobytes() for e in _tokenizer().encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("alphabet", [*ALPHABETS, "".join(ALPHABETS)])
def test_ids_equal_the_tokenizers(alphabet):
    rnd = random.Random(len(alphabet))
    texts = ["".join(rnd.choices(alphabet, k=rnd.randrange(60))) for _ in range(1500)] + list(alphabet) + [""]
    encoder = TextEncoder(PATH)
    assert isinstance(encoder.plain, WordEncoder)
    assert encoder.encode_batch(texts) == _expected(texts)
    assert encoder.encode_batch(texts) == _expected(texts)


def test_each_code_point_gets_the_tokenizers_ids():
    points = [chr(c) for c in (*range(0x3100), *range(0xA000, 0xAC10), *range(0xF900, 0x10900), *range(0x1D400, 0x1D800), *range(0x1E900, 0x1FB00))
              if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}a{c}{c}1" for c in points]
    assert TextEncoder(PATH).encode_batch(texts) == _expected(texts)


def test_a_word_is_encoded_once_whatever_stands_around_it():
    encoder = TextEncoder(PATH)
    calls, merged = [], encoder.plain.merged
    encoder.plain.merged = lambda word: calls.append(word) or merged(word)
    texts = ["Late (late) LATE, late.", "\nlate\tété; Été", "late."]
    assert encoder.encode_batch(texts) == _expected(texts)
    assert sorted(calls) == sorted({"late", "(", ")", ",", ".", "Ã©tÃ©", ";"})
    assert not encoder.plain.units and not encoder.plain.pieces


def test_caches_stay_bounded(monkeypatch):
    monkeypatch.setattr(tokenize, "MAX_UNITS", 20)
    monkeypatch.setattr(tokenize, "MAX_PIECES", 10)
    encoder = TextEncoder(PATH)
    for k in range(30):
        texts = [f"w{'abcdefghij'[k % 10]}x{'klmnopqrst'[k // 10]} Σ{k} {'y' * 500}{'abcdefghij'[k % 10]}"]
        assert encoder.encode_batch(texts) == _expected(texts)
        plain = encoder.plain
        assert len(plain.words) + len(plain.units) + len(plain.pieces) <= 40
        assert max(map(len, plain.words), default=0) <= tokenize.LONG_WORD


def test_pattern_of_ascii_words():
    rnd = random.Random(3)
    for _ in range(5000):
        text = "".join(rnd.choices("abstrevmlld09''.,_- \n\x1c", k=rnd.randrange(12)))
        assert len(ASCII_WORDS.findall(text)) == len(_tokenizer().pre_tokenizer.pre_tokenize_str(text))
