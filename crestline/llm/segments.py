"""Splitting whole texts into the units that a tokenizer merges within, and looking each distinct unit up once.

Texts are joined into one array of code points per chunk. A `Splitter` says where units start;
each unit gets a 64-bit key (a random polynomial over its code points), so that a chunk's
distinct units are found by one sort. `Lookup` keeps the ids of units met before, in bounded
memory, and sends only new ones to the merge engine.
"""

from __future__ import annotations

import functools
import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import regex
from tokenizers import pre_tokenizers

from crestline.llm.merges import MergeTable, merge_all

#: A code point that no valid text holds: it stands between two texts.
GAP = 0xD800
#: Code points in a chunk, units that a lookup keeps.
CHUNK, KEPT = 2_000_000, 1_000_000
_SAFE_CUT = re.compile(r"(?<=[A-Za-z])(?=[ \u2581][A-Za-z])")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Keys:
    """Keys of units: the sum of a random number per code point times a power of its place."""

    def __init__(self):
        with np.errstate(over="ignore"):
            self.value = _mix(np.arange(sys.maxunicode + 1, dtype=np.uint64))
        self.power = np.ones(1, np.uint64)
        self._grow(4096)

    def _grow(self, n: int) -> None:
        with np.errstate(over="ignore"):
            base = np.full(n, np.uint64(0xD1342543DE82EF95))
            base[0] = np.uint64(1)
            self.power = np.cumprod(base, dtype=np.uint64)

    def __call__(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, np.uint64)
        if (longest := int(lengths.max())) > len(self.power):
            self._grow(2 * longest)
        place = np.arange(len(codes)) - np.repeat(starts, lengths)
        with np.errstate(over="ignore"):
            key = np.add.reduceat(self.value[codes] * self.power[place], starts)
            return _mix(key + lengths.astype(np.uint64))


@functools.cache
def keys() -> _Keys:
    return _Keys()


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gather(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The elements of many ranges, end to end."""
    ends = np.cumsum(lengths)
    at = np.arange(int(ends[-1]) if len(ends) else 0)
    return codes[at + np.repeat(starts - (ends - lengths), lengths)]


def cut(text: str, limit: int = CHUNK) -> Iterator[str]:
    """A very long text in parts, cut where every splitter starts a unit: before a space (or ▁) between ASCII letters."""
    at = 0
    while len(text) - at > limit and (m := _SAFE_CUT.search(text, at + limit)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


class Lookup:
    """unit key -> ids, for units met before. Holds at most KEPT units besides the fixed ones."""

    def __init__(self, encode):
        self.encode = encode
        self._set(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))

    def _set(self, key, start, length, ids):
        order = np.argsort(key, kind="stable")
        self.key, self.start, self.length, self.ids = key[order], start[order], length[order], ids

    def _add(self, key, start, length, ids):
        """The new keys go to their places among the sorted ones: one pass, no sort of what is there."""
        order = np.argsort(key, kind="stable")
        at = np.searchsorted(self.key, key[order])
        self.start = np.insert(self.start, at, (start + len(self.ids))[order])
        self.length = np.insert(self.length, at, length[order])
        self.key = np.insert(self.key, at, key[order])
        self.ids = np.r_[self.ids, ids].astype(np.int32)

    def __call__(self, key, codes, starts, lengths):
        """Rows of start and length (into self.ids) for distinct units."""
        at = np.searchsorted(self.key, key)
        at[at == len(self.key)] = 0
        new = np.flatnonzero(self.key[at] != key) if len(self.key) else np.arange(len(key))
        if len(new):
            ids, counts = self.encode(gather(codes, starts[new], lengths[new]), lengths[new])
            begin = np.cumsum(counts) - counts
            if len(self.key) + len(new) > KEPT:  # start anew with this chunk's units
                old = np.setdiff1d(np.arange(len(key)), new)
                o_len = self.length[at[old]]
                o_ids = gather(self.ids, self.start[at[old]], o_len)
                self._set(np.r_[key[old], key[new]], np.r_[np.cumsum(o_len) - o_len, begin + len(o_ids)], np.r_[o_len, counts], np.r_[o_ids, ids].astype(np.int32))
            else:
                self._add(key[new], begin, counts, ids)
            at = np.searchsorted(self.key, key)
        return self.start[at], self.length[at]


class ByteSplitter:
    """Units of byte-level vocabularies: contractions, words, numbers and signs with one space before, and white space."""

    LETTER, NUMBER, SPACE, OTHER, BREAK = 1, 2, 3, 4, 5
    _TAILS = ("s", "t", "re", "ve", "m", "ll", "d")

    def __init__(self):
        import regex

        every = "".join(map(chr, range(0xD800))) + "" * 0x800 + "".join(map(chr, range(0xE000, sys.maxunicode + 1)))
        kind = np.full(sys.maxunicode + 1, self.OTHER, np.uint8)
        for pattern, k in ((r"\p{L}+", self.LETTER), (r"\p{N}+", self.NUMBER), (r"[\p{White_Space}]+", self.SPACE)):
            for m in regex.finditer(pattern, every):
                kind[m.start() : m.end()] = k
        # code points newer than Python's own tables: as the library that is matched has them
        split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        for c in np.flatnonzero(kind != self.OTHER).tolist():
            if unicodedata.category(chr(c)) == "Cn":
                like = {self.LETTER: "a", self.NUMBER: "1", self.SPACE: " "}[int(kind[c])]
                if len(split(like + chr(c) + like)) > 1:
                    kind[c] = self.OTHER
        kind[GAP] = self.BREAK
        self.kind = kind

    def starts(self, codes: np.ndarray) -> np.ndarray:
        """Which code points begin a unit; a GAP is a unit of its own."""
        k = self.kind[codes]
        n = len(k)
        before, after = np.r_[np.uint8(self.BREAK), k[:-1]], np.r_[k[1:], np.uint8(self.BREAK)]
        start = k != before
        space, was_space = k == self.SPACE, before == self.SPACE
        blank = codes == 32
        after_blank = np.r_[False, blank[:-1]]
        start &= ~(after_blank & ~space & (k != self.BREAK))  # the space before has begun it
        start |= space & was_space & (after != self.SPACE) & (after != self.BREAK)  # the last of a run goes on
        start |= k == self.BREAK
        quotes = np.flatnonzero((codes == 39) & (before != self.OTHER) & ~after_blank)
        if len(quotes):
            padded = np.r_[codes, np.zeros(3, codes.dtype)]
            for q in quotes.tolist():
                one, two = chr(padded[q + 1]), chr(padded[q + 1]) + chr(padded[q + 2])
                size = 1 if one in self._TAILS else 2 if two in self._TAILS else 0
                if size:
                    start[q + 1 : q + 1 + size] = False
                    if q + 1 + size < n and k[q + 1 + size] == self.LETTER:
                        start[q + 1 + size] = True
        return start


class PieceSplitter:
    """Units of vocabularies with ▁ for a space: each run of ▁ begins one. Exact where no piece has ▁ after another character."""

    def starts(self, codes: np.ndarray) -> np.ndarray:
        mark = codes == 0x2581
        gap = codes == GAP
        start = mark & ~np.r_[False, mark[:-1]]
        start |= gap | np.r_[True, gap[:-1]]
        return start


class Encoder:
    """Ids of whole texts: split, look up the distinct units, spread the ids out again."""

    def __init__(self, splitter, encode):
        self.splitter, self.lookup = splitter, Lookup(encode)

    def units(self, texts: list[str]):
        """For one chunk: each unit's distinct unit and text (-1: a gap), and the distinct ones' keys and ranges."""
        codes = code_points(chr(GAP).join(texts))
        if not len(codes):
            none = np.zeros(0, np.int64)
            return codes, none, none, none.astype(np.uint64), none, none
        start = np.flatnonzero(self.splitter.starts(codes))
        length = np.diff(np.r_[start, len(codes)])
        key = keys()(codes, start, length)
        gap = codes[start] == GAP
        text = np.cumsum(gap)[~gap]
        start, length, key = start[~gap], length[~gap], key[~gap]
        distinct, first, which = np.unique(key, return_index=True, return_inverse=True)
        return codes, text, which, distinct, start[first], length[first]

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and how many each text has."""
        codes, text, which, key, start, length = self.units(texts)
        begin, count = self.lookup(key, codes, start, length)
        each = count[which]
        out = gather(self.lookup.ids, begin[which], each) if len(each) else np.zeros(0, np.int32)
        return out, np.bincount(text, each, minlength=len(texts)).astype(np.int64)[: len(texts)]

    def encode(self, texts: Iterable[str], special: dict[str, int]) -> list[np.ndarray]:
        """The ids of each whole text; a special string in it gives its own id."""
        pieces: list[list[np.ndarray]] = []
        for who, parts, found in batches_of(texts, list(special)):
            ids, counts = self.ids(parts)
            if found:
                at = (np.cumsum(counts) - counts)[[p for p, _ in found]]
                ids = np.insert(ids, at, [special[x] for _, x in found])
                counts[[p for p, _ in found]] += 1
            for i, own in zip(who, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                while len(pieces) <= i:
                    pieces.append([])
                pieces[i].append(own)
        return [p[0] if len(p) == 1 else np.concatenate(p) for p in pieces]


@functools.cache
def byte_bpe(path: str):
    """(initial id of each byte, merge table, id of each special string, vocabulary) of a byte-level BPE file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
    a, b = [vocab[x] for x, _ in pairs], [vocab[y] for _, y in pairs]
    table = MergeTable(a, b, range(len(pairs)), [vocab[x + y] for x, y in pairs])
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return np.array([vocab[c] for c in byte_characters()]), table, special, vocab


@functools.cache
def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where it prints, else the next from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(printable) else chr(next(rest)) for b in range(256)]


def utf8_lengths(codes: np.ndarray) -> np.ndarray:
    return 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)


def byte_units(codes: np.ndarray, lengths: np.ndarray, first: np.ndarray, table: MergeTable):
    """Encode units of code points by merging their UTF-8 bytes."""
    data = np.frombuffer(codes.astype(np.uint32).tobytes().decode("utf-32-le").encode(), np.uint8)
    size = np.add.reduceat(utf8_lengths(codes), np.cumsum(lengths) - lengths) if len(lengths) else lengths
    return merge_all(first[data], size, table)


def batches_of(texts: Iterable[str], specials: list[str]) -> Iterator[tuple[list[int], list[str], list[tuple[int, str]]]]:
    """Chunks of (text number of each part, parts, specials between parts as (text number, string)).

    A special string ends a part as the end of a text does.
    """
    pattern = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None
    who, parts, found, size = [], [], [], 0
    for i, t in enumerate(texts):
        for piece in pattern.split(t) if pattern and any(s in t for s in specials) else [t]:
            if specials and piece in specials:
                who.append(i)
                parts.append("")
                found.append((len(parts) - 1, piece))
                continue
            for p in cut(piece):
                who.append(i)
                parts.append(p)
                size += len(p)
                if size >= CHUNK:
                    yield who, parts, found
                    who, parts, found, size = [], [], [], 0
    if parts:
        yield who, parts, found
