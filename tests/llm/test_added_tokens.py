"""Texts that contain the string of an added token get the tokenizer's ids."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerlens.llm import packing
from ledgerlens.llm.tokenize import ASCII_PIECES, UnitEncoder, encoder

TEXTS = ["a <|endoftext|> x", "<|endoftext|>", "<|startoftext|>q", "plain text", "x <|endoftext|><|startoftext|> y  z",
         "", "<|ENDOFTEXT|> A", "<|endoftext", " lead <|endoftext|>"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_the_unflagged_tokenizer(name):
    path = public_tokenizers.path(name)
    plain = Tokenizer.from_file(path)
    expected = [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch(TEXTS, add_special_tokens=False)]
    assert encoder(path).encode_batch(TEXTS) == expected
    assert encoder(path).encode_batch(TEXTS[3:4]) == expected[3:4]


def test_packing_maps_added_tokens(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in packing.pack_documents(frame, path, with_ids=True).collect()}
    want = {}
    for i, text in enumerate(TEXTS):
        ids = [*plain.encode(text, add_special_tokens=False).ids, 0]
        want[i] = (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert got == want


def test_pattern_gives_the_byte_level_pre_tokens():
    """Printable ASCII is split by a pattern, units with a line break many in one call; ids stay the tokenizer's."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, units = Tokenizer.from_file(path), UnitEncoder(path)
    assert units.byte_level and not UnitEncoder(public_tokenizers.path("word_bpe_49k.json")).byte_level
    rnd = random.Random(5)
    odd = ["".join(rnd.choice("abstrevmlldZ019'''..,!_-~&\\\x1c\té") for _ in range(rnd.randrange(1, 9))) for _ in range(20_000)]
    for unit in odd:
        if unit.isascii() and unit.isprintable():
            assert ASCII_PIECES.findall("Ġ" + unit) == [p for p, _ in plain.pre_tokenizer.pre_tokenize_str(" " + unit)]
    texts = [" ".join(odd), " ".join(a + "\n" + b for a, b in zip(odd, odd[1:]))]
    expected = [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert units.encode_batch(texts) == expected
