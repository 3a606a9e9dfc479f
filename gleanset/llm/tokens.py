"""Exact token ids and token counts of public vocabularies, cached by word.

The library's own encoder takes some 20 microseconds a word, whatever the word.
Both JSON vocabularies split a text before merging, so ids depend on a word
alone. Each worker keeps the ids of the words it has met and asks the library's
BPE model for a new piece only. Whatever does not fit the splitting rule stated
here (special strings, unusual white space, letters beyond the Latin blocks)
goes to the library as it is.
"""

from __future__ import annotations

import functools
import itertools
import json
import operator
import struct
import unicodedata

import numpy as np
import regex
from tokenizers import Tokenizer

from gleanset.llm.common import held

# Splitting patterns of the two vocabularies (fixed values of the file formats).
BYTE_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# Below this code point every character is its own composed form and lower-cases
# to one character, but for the dotted capital I.
PLAIN_BELOW = "ɐ"
DOTTED_I = "İ"
# Separators that Python splits at and the vocabularies do not, or the reverse.
ODD_SPACES = "\x1c\x1d\x1e\x1f\x85"
# A character outside the byte alphabet: the model skips it, so that what stands
# before it is not taken for the end of a word.
NO_END = "一"

# Marks that are a piece of their own after a letter at the end of a word.
ENDS = ".,;:!?"

WORDS = 300_000
PIECES = 600_000
STATES = 300_000
# Prefixes up to this length are looked up among those of other pieces.
SHARED = 16


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next free one from U+0100."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in printable else next(free)) for b in range(256)]


_LETTERS = dict(enumerate(byte_letters()))


def letters(text: str) -> str:
    """A piece in the alphabet of the model."""
    if text.isascii() and text.isprintable():
        return text.replace(" ", _LETTERS[32])
    return text.encode().decode("latin-1").translate(_LETTERS)


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Kept(dict):
    """A dict that makes missing values and keeps at most ``most`` of them."""

    def __init__(self, make, most: int):
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < self.most:
            self[key] = value
        return value


class _Irregular(Exception):
    """A word that cannot be encoded apart from its neighbours."""


class Vocabulary:
    """Ids by the library alone; the base of the cached ones."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]

    def plain_ids(self, text: str) -> bytes:
        return packed(self.library.encode(text, add_special_tokens=False).ids)

    def ids(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        return self.plain_ids(text)

    def _odd(self, text: str) -> bool:
        return any(s in text for s in self.special) or any(c in text for c in ODD_SPACES)


class _Pieced(Vocabulary):
    """Shared by both: a cache of words above a cache of pieces."""

    pattern = ""

    def __init__(self, path: str):
        super().__init__(path)
        self.find = regex.compile(self.pattern).findall
        self.model = self.library.model
        self.pieces = Kept(self._piece, PIECES)
        self.words = Kept(self._word, WORDS)

    def _piece(self, piece: str) -> bytes:
        return packed([t.id for t in self.model.tokenize(letters(piece))])

    def _word(self, word: str) -> bytes:
        raise NotImplementedError


class SpaceDropping(_Pieced):
    """Lower-cased words whose white space is dropped: any word stands alone."""

    pattern = WORD_PIECES

    def _word(self, word: str) -> bytes:
        if max(word) >= PLAIN_BELOW or DOTTED_I in word:
            return self.plain_ids(word)
        word = word.lower()
        if word.isalpha():
            return self.pieces[word]
        if word[:-1].isalpha() and word[-1] in ENDS:
            return self.pieces[word[:-1]] + self.pieces[word[-1]]
        return b"".join([self.pieces[p] for p in self.find(word)])

    def ids(self, text: str) -> bytes:
        if self._odd(text):
            return self.plain_ids(text)
        return b"".join(map(self.words.__getitem__, text.split()))


class SpaceLeading(_Pieced):
    """Pieces with the space before them. A text may be cut before a space that a word follows at once.

    Words keep their marks and their case, so there are more of them to keep.
    """

    pattern = BYTE_PIECES

    def __init__(self, path: str):
        super().__init__(path)
        self.words.most = 2 * WORDS

    def _chunk(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        if max(chunk) < PLAIN_BELOW:
            return b"".join([self.pieces[p] for p in self.find(chunk)])
        return self.plain_ids(chunk)

    def _word(self, word: str) -> bytes:
        if not word or word[0].isspace():
            raise _Irregular
        if max(word) < PLAIN_BELOW:
            if word.isalpha():
                return self.pieces[" " + word]
            if word[:-1].isalpha() and word[-1] in ENDS:
                return self.pieces[" " + word[:-1]] + self.pieces[word[-1]]
        return self._chunk(" " + word)

    def ids(self, text: str) -> bytes:
        if self._odd(text):
            return self.plain_ids(text)
        first, *rest = text.split(" ")
        try:
            return b"".join([self._chunk(first), *map(self.words.__getitem__, rest)])
        except _Irregular:
            return self._chunk(text)


class PrefixCounts(_Pieced):
    """The number of tokens of every prefix of a text, by dynamic programming.

    Between words the count of a prefix is that of the shorter prefix plus the
    tokens of the unfinished word. Within a piece, the last token of a prefix
    is the one vocabulary entry that ends there and may follow the last token of
    the prefix before it: a BPE encoding is the only sequence of tokens of which
    each neighbouring pair is its own encoding. So each prefix costs a few
    lookups, and its state (last token, count inside a word, count as a word's
    end) is kept for all pieces that begin alike.
    """

    pattern = WORD_PIECES

    def __init__(self, path: str):
        super().__init__(path)
        model = json.loads(self.library.to_str())["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocabulary = model["vocab"]
        self.longest = max(len(t) - len(self.end) * t.endswith(self.end) for t in self.vocabulary)
        ends = {t.removesuffix(self.end) for t in self.vocabulary if t.endswith(self.end)}
        starts = {t for t in self.vocabulary if not t.endswith(self.end)}
        self.kinds = {t: (t in starts, t in ends) for t in starts | ends}
        self.inner = Kept(self._stays_inside, 4 * STATES)
        self.final = Kept(self._stays_at_end, 4 * STATES)
        self.kept = {}
        self.unbroken = regex.compile(r"\S+").findall
        self.space = regex.compile(r"\s").match
        self.cut = regex.compile("|".join(map(regex.escape, self.special)) or "(?!)").finditer

    def _stays_inside(self, pair: tuple[str, str]) -> bool:
        """Whether two tokens inside a word are the encoding of their text; with an empty first one, a single token."""
        return [t.value for t in self.model.tokenize(pair[0] + pair[1] + NO_END)] == [t for t in pair if t]

    def _stays_at_end(self, pair: tuple[str, str]) -> bool:
        """The same at the end of a word."""
        return [t.value for t in self.model.tokenize(pair[0] + pair[1])] == [t for t in (pair[0], pair[1] + self.end) if t]

    def _state(self, piece: str, end: int, found: list[tuple]) -> tuple[str | None, int, int]:
        """The state of ``piece[:end]`` from those of its shorter prefixes."""
        last, inside, ended, kinds = None, 0, 0, self.kinds
        for size in range(end if end < self.longest else self.longest, 0, -1):
            token = piece[end - size:end]
            kind = kinds.get(token)
            if kind is None:
                continue
            before, count, _ = found[end - size]
            if before is None:
                continue
            if not ended and kind[1] and self.final[before, token]:
                ended = count + 1
                if last is not None:
                    break
            if last is None and kind[0] and self.inner[before, token]:
                last, inside = token, count + 1
                if ended:
                    break
        return last, inside, ended

    def _states(self, piece: str) -> list[tuple[str | None, int, int]]:
        """The state of every prefix of a piece, the empty one first."""
        found, kept = [("", 0, 0)], self.kept
        for end in range(1, len(piece) + 1):
            if end > SHARED:
                found.append(self._state(piece, end, found))
                continue
            prefix = piece[:end]
            state = kept.get(prefix)
            if state is None:
                state = self._state(piece, end, found)
                if len(kept) < STATES:
                    kept[prefix] = state
            found.append(state)
        return found

    def _piece(self, piece: str) -> list[int]:
        """Tokens of each prefix of a piece, counted in characters."""
        if piece[0] == "'" and len(piece) > 2:  # an unfinished contraction splits differently
            return [sum(self.pieces[p][-1] for p in self.find(piece[:k])) for k in range(1, len(piece))] + [
                self._states(letters(piece))[-1][2]
            ]
        states = self._states(letters(piece))
        if piece.isascii():
            return [s[2] for s in states[1:]]
        ends = itertools.accumulate([1 if c < "\x80" else len(c.encode()) for c in piece])
        return [states[e][2] for e in ends]

    def _word(self, word: str) -> bytes:
        """Changes of the count at each character of a word, as 32-bit integers."""
        if max(word) >= PLAIN_BELOW or DOTTED_I in word:
            counts = self._by_library(word)
        else:
            word = word.lower()
            if word.isalpha():
                counts = self.pieces[word]
            elif word[:-1].isalpha() and word[-1] in ENDS:
                counts = self.pieces[word[:-1]]
                counts = [*counts, counts[-1] + 1]
            else:
                counts, before = [], 0
                for piece in self.find(word):
                    counts.extend([before + c for c in self.pieces[piece]])
                    before = counts[-1]
        return struct.pack(f"<{len(counts)}i", counts[0], *map(operator.sub, counts[1:], counts))

    def _by_library(self, word: str) -> list[int]:
        """Counts of a word in other scripts, split by the library's own rules.

        In a composed word whose characters lower-case one by one every prefix
        normalizes to a prefix, so the program above applies. Other words, with
        loose accents, are encoded anew for each prefix.
        """
        normal = self.library.normalizer.normalize_str(word)
        if len(normal) != len(word) or not unicodedata.is_normalized("NFC", word):
            return [len(self.plain_ids(word[:stop])) // 4 for stop in range(1, len(word) + 1)]
        counts, total = [], 0
        for _, (begin, end) in self.library.pre_tokenizer.pre_tokenize_str(normal):
            counts.extend([total] * (begin - len(counts)))
            counts.extend([total + c for c in self._piece(normal[begin:end])])
            total = counts[-1]
        return counts + [total] * (len(word) - len(counts))

    def counts(self, text: str) -> np.ndarray:
        """Entry i is the number of tokens of the first i + 1 characters."""
        if any(s in text for s in self.special):
            return self._with_special(text)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        out = np.zeros(len(points), np.int64)
        words = self.unbroken(text) if self._odd(text) else text.split()
        out[~_space(points)] = np.frombuffer(b"".join(map(self.words.__getitem__, words)), "<i4")
        return np.cumsum(out, out=out)

    def _with_special(self, text: str) -> np.ndarray:
        """Special strings are one token each once they are complete; until then they are text like any other."""
        parts, done, total = [], 0, 0
        for match in [*self.cut(text), None]:
            start = match.start() if match else len(text)
            part = self.counts(text[done:start]) + total
            parts.append(part)
            at_start = int(part[-1]) if len(part) else total
            if match:
                word = start
                while word > done and not self.space(text[word - 1]):
                    word -= 1
                before = int(part[word - done - 1]) if word > done else total
                inside = [before + len(self.plain_ids(text[word:stop])) // 4 for stop in range(start + 1, match.end())]
                total = at_start + 1
                parts.append(np.array([*inside, total], np.int64))
                done = match.end()
        return np.concatenate(parts)


# White space of Unicode beyond ASCII, as Python splits it (fixed values).
_WIDE_SPACES = np.array([0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)


def _space(points: np.ndarray) -> np.ndarray:
    found = (points == 32) | ((points >= 9) & (points <= 13))
    wide = points >= 0x85
    return found | (wide & np.isin(points, _WIDE_SPACES)) if wide.any() else found


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """The fastest exact encoder for a vocabulary file; one per worker process."""
    with open(path, encoding="utf-8") as file:
        layout = json.load(file)
    before = layout["pre_tokenizer"] or {}
    if layout["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space"):
        return SpaceLeading(path)
    if _drops_spaces(layout):
        return SpaceDropping(path)
    return Vocabulary(path)


def _drops_spaces(layout: dict) -> bool:
    steps = [s["type"] for s in (layout["normalizer"] or {}).get("normalizers", [])]
    splits = (layout["pre_tokenizer"] or {}).get("pretokenizers", [])
    return steps == ["NFC", "Replace", "Lowercase"] and bool(splits) and splits[0].get("pattern") == {"Regex": WORD_PIECES}


@functools.lru_cache(maxsize=2)
def prefix_counts(path: str) -> PrefixCounts:
    """The prefix counter of a vocabulary file that drops white space; one per worker process."""
    with open(path, encoding="utf-8") as file:
        if not _drops_spaces(json.load(file)):
            raise ValueError("prefix counts need a vocabulary whose words stand alone")
    return PrefixCounts(path)


def _release() -> None:
    vocabulary.cache_clear()
    prefix_counts.cache_clear()


held("tokens", _release)
