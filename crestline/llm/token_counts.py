"""Token counts by the whole-token shortcut.

Offline, once in the driver, every string of the vocabulary is merged from its bytes; those that end as
one token are proven whole, and their sorted keys (8 bytes a token) go to the workers. A pre-token that equals one counts 1 at once; only the rest are merged, each
distinct one once per chunk, and remembered in bounded memory.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.llm import segments as S


@functools.cache
def whole_tokens(path: str) -> np.ndarray:
    """Sorted keys of the vocabulary's strings that encode alone, as one pre-token, as one token."""
    first, table, special, vocab = S.byte_bpe(path)
    byte = {c: b for b, c in enumerate(S.byte_characters())}
    splitter, texts = S.ByteSplitter(), []
    for word in vocab:
        if word in special:
            continue
        try:
            texts.append(bytes(byte[c] for c in word).decode())
        except (KeyError, UnicodeDecodeError):
            continue  # part of a character: never a whole pre-token
    codes = S.code_points(chr(S.GAP).join(texts))
    start = np.flatnonzero(splitter.starts(codes))
    length = np.diff(np.r_[start, len(codes)])
    gap = codes[start] == S.GAP
    text = np.cumsum(gap)[~gap]
    alone = np.bincount(text, minlength=len(texts)) == 1
    start, length = start[~gap][alone[text]], length[~gap][alone[text]]
    units = S.gather(codes, start, length)
    _, count = S.byte_units(units, length, first, table)
    begin = np.cumsum(length) - length
    return np.sort(S.keys()(units, begin, length)[count == 1])


class Counter:
    """Token counts of whole texts under one byte-level BPE file; `whole` has what whole_tokens() proved."""

    def __init__(self, path: str, whole: np.ndarray | None = None):
        first, table, self.special, _ = S.byte_bpe(path)
        self.whole = whole_tokens(path) if whole is None else whole
        self.encoder = S.Encoder(S.ByteSplitter(), lambda codes, lengths: self._counts(codes, lengths, first, table))

    @staticmethod
    def _counts(codes, lengths, first, table):
        _, count = S.byte_units(codes, lengths, first, table)
        return count.astype(np.int32), np.ones(len(lengths), np.int64)  # the "id" kept for a unit is its count

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        for who, parts, found in S.batches_of(texts, list(self.special)):
            codes, text, which, key, start, length = self.encoder.units(parts)
            count = np.ones(len(key), np.int64)
            at = np.searchsorted(self.whole, key)
            at[at == len(self.whole)] = 0
            rest = np.flatnonzero(self.whole[at] != key)
            begin, _ = self.encoder.lookup(key[rest], codes, start[rest], length[rest])
            count[rest] = self.encoder.lookup.ids[begin]
            np.add.at(out, who, np.bincount(text, count[which], minlength=len(parts)).astype(np.int64)[: len(parts)])
            np.add.at(out, [who[p] for p, _ in found], 1)
        return out


_COUNTERS: dict[str, Counter] = {}


def counter(path: str, whole: np.ndarray | None = None) -> Counter:
    """This process's counter of a file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path, whole)
    return _COUNTERS[path]


def count_tokens(df: DataFrame, tokenizer: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Add `out`, the number of tokens of the whole `text` under the byte-level BPE file `tokenizer`.

    The file must be at that path on the driver and on every executor. Null and empty texts count 0; special
    strings in a text count one each; other columns stay, whatever their names; repeated rows
    are counted each. Narrow: one pass, no shuffle.
    """

    proven = df.sparkSession.sparkContext.broadcast(whole_tokens(tokenizer))

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(tokenizer, proven.value)
        for s in batches:
            yield pd.Series(count([t or "" for t in s]), dtype="int64")

    return df.withColumn(out, tokens(F.col(text)))
