"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A table of ranks is turned into a byte-pair model of the library: each byte is written as its printable letter, and
any two tokens whose joined bytes are a token form a merge of that token's rank. Each match of the pre-token pattern
is encoded on its own; matches already met in a task come from a bounded memo. Token places follow from the lengths
of the tokens in bytes and a map from the bytes of a text to its characters. Decoding puts the bytes of the tokens
together before it reads characters, so a character split over several tokens comes back whole.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tillwise.llm.common import runs, utf8
from tillwise.llm.token_count import byte_letters

#: Longer texts are cut at spaces into parts of about so many characters; a part never ends inside a match.
PART = 1 << 18
#: The memo is emptied at this many matches and holds none above MEMO_CHARS characters: it only saves work.
MEMO, MEMO_CHARS = 250_000, 32
#: Ids decoded at a time, unless one row has more.
DECODED = 1 << 18
_CUT = re.compile(r"[^\W_] ")


class ByteBpe:
    """Encodes and decodes by a table of ranks (base64 token, rank a line)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.sizes = np.zeros(max(self.tokens, default=0) + 1, np.int64)
        self.sizes[list(self.tokens)] = [len(t) for t in self.tokens.values()]
        self.memo: dict[str, tuple[int, ...]] = {}

    @cached_property
    def letters(self) -> dict[int, str]:
        """Each byte's printable letter."""
        return {b: c for c, b in byte_letters().items()}

    @cached_property
    def model(self):
        """The library's model: all pairs of tokens that make up a token, in the order of that token's rank."""
        from tokenizers import models

        ranks = self.ranks
        name = {token: "".join(map(self.letters.__getitem__, token)) for token in ranks}
        pairs = sorted(
            (rank, i, name[token[:i]], name[token[i:]])
            for token, rank in ranks.items() for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks
        )
        return models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=[p[2:] for p in pairs], ignore_merges=True, cache_capacity=0)

    @cached_property
    def matches(self):
        import public_tokenizers
        import regex

        return regex.compile(public_tokenizers.PATTERN).findall

    def _learn(self, match: str) -> tuple[int, ...]:
        """The ids of one match: its bytes as letters, through the library's model."""
        ids = tuple([t.id for t in self.model.tokenize(match.encode().decode("latin-1").translate(self.letters))])
        if len(match) <= MEMO_CHARS:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[match] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        found, known = [], self.memo.get
        for part in parts(text):
            found.extend(chain.from_iterable([known(m) or self._learn(m) for m in self.matches(part)]))
        return found

    def decode(self, ids: list[int]) -> bytes | None:
        """The bytes of the tokens; None if an id is null or no token."""
        try:
            return b"".join(map(self.tokens.__getitem__, ids))
        except KeyError:
            return None


def parts(text: str, size: int = PART) -> Iterator[str]:
    """``text`` cut before single spaces that follow a letter or digit, where any match of the pattern ends."""
    at = 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if cut is None:
            break
        yield text[at:cut.start() + 1]
        at = cut.start() + 1
    yield text[at:]


def char_places(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first character, character after the last) of tokens of so many bytes that make up the UTF-8 bytes ``data``; a
    token with part of a character covers all of it."""
    char = np.cumsum((data & 0xC0) != 0x80) - 1
    ends = np.cumsum(sizes)
    return char[ends - sizes], char[ends - 1] + 1


_CODERS: dict[str, ByteBpe] = {}


def coder(path: str) -> ByteBpe:
    if path not in _CODERS:
        _CODERS[path] = ByteBpe(path)
    return _CODERS[path]


def _lists(values: list, lengths: list[int], kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


Work = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
_INTS = T.ArrayType(T.IntegerType())
_CODED = [("ids", _INTS), ("n_tokens", T.LongType()), ("n_split", T.LongType()), ("starts", _INTS), ("ends", _INTS)]
_DECODED = [("bytes", T.BinaryType()), ("text", T.StringType())]


def _encoder(ranks: str, places: bool) -> Work:
    """Turns batches of (doc_id, text) into small batches of (doc_id, ids, n_tokens, n_split[, starts, ends])."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks)
        for batch in batches:
            offsets, data = utf8(batch.column(1))
            for first, last in runs(offsets):
                ids, split, starts, ends = [], [], [], []
                for text, a, b in zip(batch.column(1).slice(first, last - first).to_pylist(), offsets[first:last], offsets[first + 1:last + 1]):
                    one = np.array(bpe.encode(text or ""), np.int32)
                    start, end = char_places(data[a:b], bpe.sizes[one])
                    broken = np.zeros(len(one) + 1, bool)
                    broken[1:-1] = start[1:] < end[:-1]  # a character goes on from the token before
                    ids.append(one)
                    split.append(int(np.count_nonzero(broken[1:] | broken[:-1])))
                    starts.append(start)
                    ends.append(end)
                n = [len(one) for one in ids]
                columns = [batch.column(0).slice(first, last - first), _lists(ids, n, pa.int32()), pa.array(n, pa.int64()), pa.array(split, pa.int64())]
                columns += [_lists(x, n, pa.int32()) for x in (starts, ends)] if places else []
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *[c for c, _ in _CODED[:len(columns) - 1]]])

    return work


def _decoder(ranks: str, at: int, names: list[str], texts: bool) -> Work:
    """Adds bytes (and text) to batches whose column ``at`` has the ids, a bounded number of ids at a time."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks)
        for batch in batches:
            ends = np.r_[0, np.cumsum(batch.column(at).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]
            for first, last in runs(ends, DECODED):
                part = batch.slice(first, last - first)
                lists, flat = part.column(at), part.column(at).flatten()
                flat = flat.to_pylist() if flat.null_count else flat.to_numpy().tolist()
                span = (ends[first:last + 1] - ends[first]).tolist()
                out = [bpe.decode(flat[a:b]) if valid else None for a, b, valid in zip(span, span[1:], lists.is_valid().to_pylist())]
                columns = [*part.columns, pa.array(out, pa.binary())]
                if texts:
                    columns.append(pa.array([None if b is None else b.decode(errors="replace") for b in out], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return work


def encode(docs: DataFrame, ranks: str, places: bool = True) -> DataFrame:
    """(doc_id, ids, n_tokens, n_split[, starts, ends]) per row of ``docs``, for the rank file ``ranks`` that every executor can read.

    ids are those of the whole text without special tokens; strings of special tokens are ordinary text. With
    ``places``, starts and ends are the characters each token covers. n_split counts the tokens that hold a part of a
    character only. Null and empty texts have no ids. Every row returns a row, repeated or not; a null doc_id stays
    null; other columns are ignored. Nothing is shuffled.
    """
    rows = docs.select("doc_id", "text")
    fields = [rows.schema.fields[0], *[T.StructField(*f) for f in (_CODED if places else _CODED[:3])]]
    return rows.mapInArrow(_encoder(ranks, places), T.StructType(fields))


def decode(coded: DataFrame, ranks: str, texts: bool = True) -> DataFrame:
    """The columns of ``coded`` with bytes and, with ``texts``, text decoded from its ``ids``; columns of these two names are replaced.

    A character split over tokens of one row is whole. Where a list of ids begins or ends inside a character, bytes
    holds the part as it is, text has U+FFFD in its place. A null list, and one with a null or an id that
    is no token, gives null.
    """
    new = _DECODED if texts else _DECODED[:1]
    rows = coded.select(*[c for c in coded.columns if c not in dict(new)])
    schema = T.StructType([*rows.schema.fields, *[T.StructField(*f) for f in new]])
    return rows.mapInArrow(_decoder(ranks, rows.columns.index("ids"), schema.names, texts), schema)


def round_trip(docs: DataFrame, ranks: str) -> DataFrame:
    """``decode`` of ``encode`` without places and text, in one pass: (doc_id, ids, n_tokens, n_split, bytes)."""
    rows = docs.select("doc_id", "text")
    schema = T.StructType([rows.schema.fields[0], *[T.StructField(*f) for f in (*_CODED[:3], _DECODED[0])]])
    there, back = _encoder(ranks, False), _decoder(ranks, 1, schema.names, False)
    return rows.mapInArrow(lambda batches: back(there(batches)), schema)
