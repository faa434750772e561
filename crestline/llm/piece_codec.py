"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies.

A text is normalised as the model says, split before each run of ▁ (no piece has ▁ after
another character, which the loader proves), and each distinct unit goes through the agenda of
adjacent symbol pairs: highest score first, leftmost among equals. Characters without a piece
fall back to their bytes. Units new to a worker are checked against the sentencepiece library
in the same Arrow batch. Decoding is the library's.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from crestline.llm import segments as S
from crestline.llm.common import slices
from crestline.llm.merges import MergeTable, merge_all

_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


class PieceCodec:
    """Encoder and decoder for one model file."""

    def __init__(self, path: str, check: bool = True):
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = {p.type for p in model.pieces}
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or kinds - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError("a merge-type model with byte fallback and no user-defined pieces is needed")
        normal = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type == _NORMAL}
        if any("▁" in piece.lstrip("▁") for piece in normal) or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a piece has ▁ after another character: units would not be independent")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bos, self.eos = self.library.bos_id(), self.library.eos_id()
        self.size, self.check = len(model.pieces), check
        #: Identity normalisation needs no call into the library.
        rule = model.normalizer_spec
        self.plain = not rule.precompiled_charsmap and rule.add_dummy_prefix and rule.escape_whitespaces and not rule.remove_extra_whitespaces
        self.bytes = np.array([self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.symbol = self.size + np.arange(0x110000)  # a character without a piece stands for itself
        for piece, (i, _) in normal.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        scores = sorted({s for _, s in normal.values()}, reverse=True)
        rank = {s: r for r, s in enumerate(scores)}
        a, b, ranks, merged = [], [], [], []
        for piece, (i, score) in normal.items():
            for k in range(1, len(piece)):
                left, right = self._symbol(piece[:k], normal), self._symbol(piece[k:], normal)
                if left is not None and right is not None:
                    a.append(left), b.append(right), ranks.append(rank[score]), merged.append(i)
        self.table = MergeTable(a, b, ranks, merged)
        self.encoder = S.Encoder(S.PieceSplitter(), self._units)

    def _symbol(self, text: str, normal: dict) -> int | None:
        return int(self.symbol[ord(text)]) if len(text) == 1 else normal[text][0] if text in normal else None

    def _units(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = merge_all(self.symbol[codes], lengths, self.table)
        lost = np.flatnonzero(ids >= self.size)
        if len(lost):
            point = ids[lost] - self.size
            each = np.ones(len(ids), np.int64)
            each[lost] = S.utf8_lengths(point)
            unit = np.repeat(np.repeat(np.arange(len(counts)), counts), each)
            spread = np.repeat(ids, each)
            data = np.frombuffer(point.astype(np.uint32).tobytes().decode("utf-32-le").encode(), np.uint8)
            spread[spread >= self.size] = self.bytes[data]
            ids, counts = spread, np.bincount(unit, minlength=len(counts))
        if self.check:
            self._compare(codes, lengths, ids, counts)
        return ids, counts

    def _compare(self, codes, lengths, ids, counts) -> None:
        ends = np.cumsum(lengths)
        text = codes.astype(np.uint32).tobytes().decode("utf-32-le")
        units = [text[e - n + 1 : e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]  # the library puts the first ▁
        at = np.cumsum(counts) - counts
        keep = [i for i, u in enumerate(units) if u]
        for i, theirs in zip(keep, self.library.encode([units[i] for i in keep], num_threads=1), strict=True):
            if theirs != ids[at[i] : at[i] + counts[i]].tolist():
                raise ValueError(f"the agenda differs from the sentencepiece library on {units[i]!r}")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without begin and end."""
        if self.plain:
            ready = ["▁" + t.replace(" ", "▁") if t else "" for t in texts]
        else:
            ready = [self.library.normalize(t) for t in texts]
        return self.encoder.encode(ready, {})

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids)


@functools.cache
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def encode_decode(df: DataFrame, model: str, digests: bool = True) -> DataFrame:
    """df's doc_id with n_tokens and, of the ids (with begin and end) and the decoded text, digests or the things themselves.

    Null and empty texts give begin and end only and decode to an empty text; repeated rows
    come out as often; other columns are not read. Narrow: one pass, no shuffle.
    """
    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            for b, texts in slices(batch):
                ids = [np.r_[c.bos, x, c.eos].astype("<u4") for x in c.encode(texts)]
                back = c.decode([x.tolist() for x in ids])
                counts = pa.array([len(x) for x in ids], pa.int64())
                if digests:
                    rest = [pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids]), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back])]
                else:
                    rest = [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), counts, *rest], names=["doc_id", "n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"])])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
