"""Byte-level BPE encoding and decoding.

Bytes are mapped to Latin-1 characters so that an Aho-Corasick automaton over
the vocabulary reports every token that occurs in a piece. Encoding walks the
piece left to right with the longest token at each place and backs up when two
neighbours could not have come out of the merges; whether two tokens may stand
side by side is worked out once and remembered. The result equals that of the
merges themselves, in time linear in the piece.

Empty and null texts give no ids; texts of any length are encoded whole;
repeated rows are encoded each; the other columns pass through. A null id list
decodes to no bytes.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from folioscope.llm.common import beside_text, fresh, named, release, slices, texts_of

#: Entries of a memo, after which it starts anew.
MEMO = 400_000
#: Bytes of text that are encoded before a batch is handed on.
SLICE_BYTES = 1 << 20


class _Pieces(dict):
    """Ids of the pieces met so far."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.codec.encode_bytes(piece.encode())
        if len(piece) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """Encoder and decoder for one file of ranks (token bytes in base64, a blank, rank)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        size = max(ranks.values(), default=-1) + 1
        self.ranks = ranks
        self.split_text = regex.compile(pattern).findall
        self.token = [b""] * size
        self.length = [0] * size
        self.shorter = [-1] * size
        self.halves: list[tuple[int, int] | None] = [None] * size
        self.merged: dict[tuple[int, int], int] = {}
        self.beside: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.token[rank], self.length[rank] = token, len(token)
            self.automaton.add_word(token.decode("latin-1"), rank)
            self.shorter[rank] = next((ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in ranks), -1)
        self.automaton.make_automaton()
        # In order of rank, so that what a token was merged from is known before the token is used.
        for rank in range(size):
            token = self.token[rank]
            for n in range(len(token) - 1, 0, -1):
                left, right = ranks.get(token[:n], size), ranks.get(token[n:], size)
                if left < rank and right < rank and self._may_touch(left, right):
                    self.halves[rank] = (left, right)
                    self.merged[left, right] = rank
                    break
        self.pieces = _Pieces(self)

    def _may_touch(self, left: int, right: int) -> bool:
        """Whether the merges leave left and right standing side by side.

        Both tokens are taken apart again, last merge first. At each step the two
        that meet at the boundary must not have had a merge of their own that
        would have come before what was done instead.
        """
        bound = len(self.token)
        while True:
            if self.merged.get((left, right), bound) < bound:
                return False
            a, b = self.halves[left], self.halves[right]
            if a is None and b is None:
                return True
            # The later merge is undone first; of equal ones the left ran first, so the right is undone.
            if b is None or (a is not None and left > right):
                bound, left = left, a[1]
            else:
                bound, right = right + 1, b[0]

    def fits(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.beside.get(key)
        if known is None:
            if len(self.beside) >= 4 * MEMO:
                self.beside.clear()
            known = self.beside[key] = self._may_touch(left, right)
        return known

    def encode_bytes(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        length, shorter, fits = self.length, self.shorter, self.fits
        end = len(piece)
        longest = [-1] * (end + 1)
        for last, rank in self.automaton.iter(piece.decode("latin-1")):
            longest[last + 1 - length[rank]] = rank
        open_at = bytearray(b"\x01") * (end + 1)
        out: list[int] = []
        at, rank = 0, longest[0]
        while at < end:
            while rank >= 0 and not (open_at[at + length[rank]] and (not out or fits(out[-1], rank))):
                rank = shorter[rank]
            if rank >= 0:
                out.append(rank)
                at += length[rank]
                rank = longest[at]
            elif out:
                open_at[at] = 0
                rank = out.pop()
                at -= length[rank]
            else:
                raise ValueError("the vocabulary lacks a byte of the text")
        return tuple(out)

    def encode(self, text: str) -> np.ndarray:
        return np.fromiter(chain.from_iterable(map(self.pieces.__getitem__, self.split_text(text))), np.int32)

    def forget(self) -> None:
        """Empties the memos."""
        self.pieces.clear()
        self.beside.clear()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process; the file is local to every machine, like the libraries."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    return Codec(ranks, pattern)


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with the ids of its texts in ``ids_col`` (array of int; empty for empty or null texts)."""
    (ids_col, work) = fresh(df, ids_col, "bpe_text")
    beside, own = beside_text(df, text_col)

    def run(batches):
        coder = codec(ranks_path, pattern)
        for batch in batches:
            texts = texts_of(batch, work, own)
            for a, b in slices(texts, SLICE_BYTES):
                part = batch.slice(a, b - a)
                ids = [coder.encode(t) for t in texts.slice(a, b - a).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int64).astype(np.int32)
                flat = np.concatenate([np.empty(0, np.int32), *ids])
                columns = [c for c, name in zip(part.columns, part.schema.names) if name != work]
                names = [name for name in part.schema.names if name != work]
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], [*names, ids_col])
        batch = texts = part = None
        coder.forget()
        release()

    schema = T.StructType([*df.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))])
    return df.select(*map(named, df.columns), beside.alias(work)).mapInArrow(run, schema)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``df`` with the bytes that the ids in ``ids_col`` stand for in ``bytes_col``."""
    (bytes_col,) = fresh(df, bytes_col)

    def run(batches):
        coder = codec(ranks_path, pattern)
        for batch in batches:
            ids = batch.column(batch.schema.names.index(ids_col))
            flat, ends = ids.flatten().to_numpy(zero_copy_only=False), ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).cumsum()
            parts = (coder.decode(flat[a:b].tolist()) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(parts), pa.binary())], [*batch.schema.names, bytes_col])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(bytes_col, T.BinaryType())]))
