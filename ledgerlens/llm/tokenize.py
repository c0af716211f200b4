"""Tokenisation with a cache of units, for tasks that read many texts.

Byte-pair encoding never merges across pre-tokens, and a space between two
characters that are not white space always starts a new pre-token.  A text is
therefore cut at such spaces, and the ids of each unit are looked up; only new
units go through the tokenizer's own normaliser, pre-tokeniser and model.  A
text that contains the string of an added token is encoded whole by the
tokenizer.  Ids equal those of encoding the whole text; the tests compare both.

A tokenizer that lower-cases and then takes words by a pattern (``WORD_STEPS``), and
one of the byte-level pattern alone, need no units: the pattern cuts whole texts, and
the ids of each word, or pre-token, are looked up.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array

import numpy as np
import pyarrow.compute as pc

#: A cut is safe between two characters that are not white space.
SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
#: A space with white space on both sides: cut by SAFE_CUT only.
INNER = re.compile(r"\s \s")
#: The pattern of the byte-level pre-tokeniser on printable ASCII behind a space, which it writes as Ġ.
ASCII_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|Ġ?[A-Za-z]+|Ġ?[0-9]+|Ġ?[^A-Za-z0-9Ġ]+")
#: Normaliser and pre-tokeniser of tokenizers of words.
WORD_STEPS = (
    {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]})
#: Their pattern on lower-case ASCII, and on texts that ``WordEncoder.reads_alike`` lets pass.
ASCII_WORDS = re.compile(r"[a-z]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^ \t-\r0-9a-z]+")
WORDS = re.compile(r"[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)|\d|(?:[^\w\s]|_)+")
#: The byte-level pattern on ASCII, and on texts that ``PieceEncoder.reads_alike`` lets pass.
ASCII_TEXT = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r 0-9A-Za-z]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
TEXT = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")
#: The character of each byte in byte-level pre-tokens: itself if printable, else one from U+0100 on.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_CHARS = "".join(chr(b if b in _PRINTABLE else 0x100 + sum(c not in _PRINTABLE for c in range(b))) for b in range(256))
#: Cached units and pre-tokens of a worker process before a cache restarts;
#: an entry takes about 200 bytes.  Words have the room of both, longer ones than
#: ``LONG_WORD`` characters are not kept.  The pre-tokens of whole texts share the
#: room of ``MAX_PIECES`` with what the units of other texts take.
MAX_UNITS, MAX_PIECES, LONG_WORD = 1_000_000, 700_000, 64


class UnitEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, tokenizer=None):
        from tokenizers import Tokenizer

        # Its parts know no added tokens; TextEncoder keeps their strings away.
        tokenizer = tokenizer or Tokenizer.from_file(path)
        normaliser = tokenizer.normalizer
        self.normalise = normaliser.normalize_str if normaliser else (lambda text: text)
        self.split = tokenizer.pre_tokenizer.pre_tokenize_str
        self.model = tokenizer.model.tokenize
        self.byte_level = _is_of_pieces(tokenizer)
        self.units: dict[str, bytes] = {}  # ids of a unit behind a space
        self.heads: dict[str, bytes] = {}  # and at the beginning of a text
        self.pieces: dict[str, bytes] = {}

    def piece(self, pre_token: str) -> bytes:
        ids = self.pieces.get(pre_token)
        if ids is None:
            ids = self.pieces[pre_token] = self.merged(pre_token)
        return ids

    def merged(self, pre_token: str) -> bytes:
        return array("I", [t.id for t in self.model(pre_token)]).tobytes()

    def single(self, unit: str) -> bytes:
        return b"".join([self.piece(p) for p, _ in self.split(self.normalise(unit))])

    def learn(self, new: list[str]) -> None:
        """Encode units without a space and without white space at their ends, many
        in one call, each behind a space: a pre-token belongs to the unit it starts in."""
        for k in range(0, len(new), 512):
            part = new[k : k + 512]
            text = self.normalise(" " + " ".join(part))
            starts = [i for i, c in enumerate(text) if c == " "]
            if len(starts) != len(part):  # normalisation made or removed spaces
                self.units.update((unit, self.single(" " + unit)) for unit in part)
                continue
            starts.append(len(text) + 1)
            ids: list[list[bytes]] = [[] for _ in part]
            at, end = 0, starts[1]
            for piece, (begin, _) in self.split(text):
                while begin >= end:
                    at += 1
                    end = starts[at + 1]
                ids[at].append(self.piece(piece))
            self.units.update((unit, b"".join(found)) for unit, found in zip(part, ids, strict=True))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        for cache, limit in ((self.units, MAX_UNITS), (self.pieces, MAX_PIECES), (self.heads, MAX_PIECES // 10)):
            if len(cache) > limit:
                cache.clear()
        cut = [SAFE_CUT.split(text) if INNER.search(text) else text.split(" ") for text in texts]
        heads = [units.pop(0) for units in cut]
        new = set().union(*cut).difference(self.units)
        plain, lined = [], []
        piece, units = self.piece, self.units
        for unit in new:
            if unit.split() != [unit]:
                if unit and unit == unit.strip() and " " not in unit:
                    lined.append(unit)
                else:
                    units[unit] = self.single(" " + unit)
            elif self.byte_level and unit.isascii() and unit.isprintable():
                units[unit] = b"".join(map(piece, ASCII_PIECES.findall("Ġ" + unit)))
            else:
                plain.append(unit)
        self.learn(plain)
        self.learn(lined)
        for unit in set(heads).difference(self.heads):
            self.heads[unit] = self.single(unit)
        known, first = self.units.__getitem__, self.heads.__getitem__
        return [b"".join([first(head), *map(known, units)]) for head, units in zip(heads, cut, strict=True)]


class _Words(dict):
    """Ids of words, encoded when first asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word)
        if len(word) <= LONG_WORD:
            self[word] = ids
        return ids


class PatternEncoder(UnitEncoder):
    """The same for a tokenizer whose pattern Python can apply to whole texts.  A
    text with characters that both may read differently is encoded by units."""

    def __init__(self, path: str, tokenizer=None):
        super().__init__(path, tokenizer)
        self.words = _Words(self.word)
        self.alike: dict[str, bool] = {}  # is a character read alike by both?

    def word(self, word: str) -> bytes:
        if not (word.isascii() and word.isprintable()) or " " in word:
            word = word.encode().decode("latin-1").translate(BYTE_CHARS)
        return self.merged(word)

    def same_kind(self, char: str) -> bool:
        raise NotImplementedError

    def reads_alike(self, text: str) -> bool:
        if text.isascii():
            return True
        chars = set(text)
        for char in chars.difference(self.alike):
            self.alike[char] = self.same_kind(char)
        return all(map(self.alike.__getitem__, chars))

    def words_of(self, text: str) -> list[str]:
        raise NotImplementedError

    def room(self) -> int:
        return MAX_PIECES

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        caches = self.words, self.units, self.pieces
        if sum(map(len, caches)) > self.room():
            for cache in caches:
                cache.clear()
        alike = [self.reads_alike(text) for text in texts]
        rest = iter(super().encode_batch([text for text, same in zip(texts, alike, strict=True) if not same]))
        ids, found = self.words.__getitem__, []
        for text, same in zip(texts, alike, strict=True):
            found.append(b"".join(map(ids, self.words_of(text))) if same else next(rest))
        return found


class WordEncoder(PatternEncoder):
    """For a tokenizer of ``WORD_STEPS``."""

    def same_kind(self, char: str) -> bool:
        """Is the character normalised alike, and of the same kind (letter, digit, space, other)?"""
        low, normal = char.lower(), self.normalise(char)
        if unicodedata.category(char) == "Cn" or low != normal and WORDS.search(low):
            return False
        return all([m.span() for m in WORDS.finditer(a)] == [span for _, span in self.split(b)]
                   for a, b in (("a" + low, "a" + normal), (low + low, normal + normal)))

    def reads_alike(self, text: str) -> bool:
        # Python lower-cases a sigma by its place in the word, the tokenizer does not.
        if not text.isascii() and ("Σ" in text or not unicodedata.is_normalized("NFC", text)):
            return False
        return super().reads_alike(text)

    def words_of(self, text: str) -> list[str]:
        return (ASCII_WORDS if text.isascii() else WORDS).findall(text.lower())

    def room(self) -> int:
        return MAX_UNITS + MAX_PIECES


class PieceEncoder(PatternEncoder):
    """For a tokenizer without a normaliser, of the byte-level pattern."""

    def same_kind(self, char: str) -> bool:
        """Is the character of the same kind (letter, digit, space, other)?  It goes on
        with a letter, a digit or another character only if it is of that kind."""
        return all([m.span() for m in TEXT.finditer(a + char)] == [span for _, span in self.split(a + char)]
                   for a in ("a", "1", "!", " "))

    def words_of(self, text: str) -> list[str]:
        return (ASCII_TEXT if text.isascii() else TEXT).findall(text)


class TextEncoder:
    """Ids as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them:
    a text with the string of an added token goes through the tokenizer itself,
    which maps it, and all others through the cache of units or words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)  # once, also for the parts
        kind = WordEncoder if _is_of_words(self.tokenizer) else PieceEncoder if _is_of_pieces(self.tokenizer) else UnitEncoder
        self.plain = kind(path, self.tokenizer)
        tokens = self.tokenizer.get_added_tokens_decoder().values()
        # A token with normalized=True is looked for in the normalised text.
        self.raw = _any_of(t.content for t in tokens if not t.normalized)
        normalise = self.plain.normalise
        self.normalised = _any_of(normalise(t.content) for t in tokens if t.normalized)

    def has_added(self, text: str) -> bool:
        return bool(self.raw and self.raw.search(text)
                    or self.normalised and self.normalised.search(self.plain.normalise(text)))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        added = [k for k, text in enumerate(texts) if self.has_added(text)]
        if not added:
            return self.plain.encode_batch(texts)
        direct = dict.fromkeys(added, b"")
        for k in added:
            ids = self.tokenizer.encode(texts[k], add_special_tokens=False).ids
            direct[k] = array("I", ids).tobytes()
        rest = iter(self.plain.encode_batch([text for k, text in enumerate(texts) if k not in direct]))
        return [direct[k] if k in direct else next(rest) for k in range(len(texts))]


def _is_of_pieces(tokenizer) -> bool:
    """Is there only the byte-level pre-tokeniser with its own pattern and no added space?"""
    from tokenizers.pre_tokenizers import ByteLevel

    step = tokenizer.pre_tokenizer
    return tokenizer.normalizer is None and isinstance(step, ByteLevel) and step.use_regex and not step.add_prefix_space


def _is_of_words(tokenizer) -> bool:
    steps = tokenizer.normalizer, tokenizer.pre_tokenizer
    return None not in steps and tuple(json.loads(step.__getstate__()) for step in steps) == WORD_STEPS


def _any_of(strings) -> re.Pattern | None:
    found = sorted({s for s in strings if s}, key=len, reverse=True)
    return re.compile("|".join(map(re.escape, found))) if found else None


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """The worker process's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


def text_runs(texts: list, limit: int = 2_000_000, most: int | None = None):
    """Index ranges of ``texts`` with about ``limit`` characters each, and with
    ``most`` texts at most if given."""
    begin = size = 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= limit or k + 1 - begin == most:
            yield begin, k + 1
            begin, size = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def small_batches(batches, *columns: int, limit: int = 4_000_000):
    """The rows of the batches in slices of about ``limit`` bytes of text in these
    columns, so that no more than a slice at a time becomes Python strings."""
    for batch in batches:
        size = np.zeros(batch.num_rows, np.int64)
        for k in columns:
            size += pc.binary_length(batch.column(k)).fill_null(0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size) // limit
        bounds = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(bounds, bounds[1:]):
            yield batch.slice(lo, hi - lo)
