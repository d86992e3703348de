"""Encoding of a corpus with a public byte-level BPE vocabulary.

A text is cut at boundaries no token crosses, and every distinct piece is
encoded once per worker. Within a piece the encoding is a dynamic programme
over its byte prefixes: each prefix has exactly one valid last token, the one
that is compatible with the last token of what is left before it. Two
neighbouring tokens are compatible if no merge across their boundary comes
before the merges that make them. The stored last tokens allow appending
without encoding the beginning again, and re-encoding only near an edit.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wildloom.session import c, columns_or_fail

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
# The published pattern that splits a text before merging; white space is the Unicode property.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
# The signs with the Unicode property White_Space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"
_SPACE_SET = frozenset(SPACES)
_ASCII_BEFORE = tuple(s + " " for s in SPACES if s.isascii())
_OTHER_BEFORE = tuple(s + " " for s in SPACES if not s.isascii())
#: Pieces up to this length are remembered, at most so many at a time.
KEEP_LEN, KEEP = 48, 400_000
NEVER = 1 << 60


def byte_signs() -> list[str]:
    """The printable sign that stands for each byte: itself if printable in Latin-1, else the next free one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, free = {b: chr(b) for b in plain}, 0x100
    for b in range(256):
        if b not in out:
            out[b] = chr(free)
            free += 1
    return [out[b] for b in range(256)]


class Vocabulary:
    def __init__(self, text: str):
        model = json.loads(text)["model"]
        back = {s: b for b, s in enumerate(byte_signs())}
        raw = lambda t: bytes(back[x] for x in t)
        self.id_of = {raw(t): i for t, i in model["vocab"].items()}
        self.bytes_of = {i: t for t, i in self.id_of.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, m in enumerate(model["merges"]):
            left, right = (raw(x) for x in (m.split(" ") if isinstance(m, str) else m))
            pair = self.id_of[left], self.id_of[right]
            self.rank[pair] = r
            self.parts.setdefault(self.id_of[left + right], (*pair, r))
        lengths: dict[bytes, set[int]] = {}
        for t in self.id_of:
            lengths.setdefault(t[-2:], set()).add(len(t))
        self.lengths = {k: sorted(v, reverse=True) for k, v in lengths.items()}
        self.fits: dict[tuple[int, int], bool] = {}

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """From the outermost byte up: (token, rank of the merge that uses it up)."""
        out, until = [], NEVER
        while True:
            out.append((token, until))
            made = self.parts.get(token)
            if made is None:
                return out[::-1]
            token, until = made[side], made[2]

    def compatible(self, a: int, b: int) -> bool:
        """Whether ``a`` followed by ``b`` is left as it is by the merges."""
        known = self.fits.get((a, b))
        if known is not None:
            return known
        left, right = self._spine(a, 1), self._spine(b, 0)
        i = j = 0
        ok = True
        while True:
            (x, x_until), (y, y_until) = left[i], right[j]
            r = self.rank.get((x, y), NEVER)
            if r < x_until and r <= y_until and r != NEVER:
                ok = False
                break
            if x_until == NEVER and y_until == NEVER:
                break
            if x_until <= y_until:
                i += 1
            else:
                j += 1
        if len(self.fits) > 2 * KEEP:
            self.fits.clear()
        self.fits[a, b] = ok
        return ok

    def extend(self, data: bytes, last: list[int]) -> None:
        """Complete ``last``, the last tokens of the prefixes of ``data``; those it holds are kept."""
        ids, lengths = self.id_of, self.lengths
        for end in range(len(last) + 1, len(data) + 1):
            for tail in (data[end - 2 : end], data[end - 1 : end]) if end > 1 else (data[:1],):
                for n in lengths.get(tail, ()):
                    if n > end:
                        continue
                    token = ids.get(data[end - n : end])
                    if token is not None and (n == end or self.compatible(last[end - n - 1], token)):
                        last.append(token)
                        break
                else:
                    continue
                break
            else:
                raise ValueError(f"no token ends at byte {end}")

    def trace(self, last: list[int]) -> list[int]:
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.bytes_of[last[end - 1]])
        return out[::-1]

    def piece(self, data: bytes) -> list[int]:
        whole = self.id_of.get(data)
        if whole is not None:
            return [whole]
        last: list[int] = []
        self.extend(data, last)
        return self.trace(last)


class _Known(dict):
    """Encoded pieces as little-endian 32-bit integers."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        out = self.make(key)
        if len(key) <= KEEP_LEN:
            if len(self) >= KEEP:
                self.clear()
            self[key] = out
        return out


class Encoder:
    """Text to token ids. ``<|endoftext|>`` in a text is ordinary text."""

    def __init__(self, vocabulary: str):
        self.v = Vocabulary(vocabulary)
        self.split = regex.compile(SPLIT).findall
        self.pieces = _Known(lambda s: np.asarray(self.v.piece(s.encode()), "<i4").tobytes())
        self.starts = _Known(self._unit)
        self.units = _Known(lambda s: self._unit(" " + s))

    def _unit(self, s: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(s)))

    def units_of(self, text: str) -> list[str]:
        """Pieces that are encoded on their own: cut before a blank that follows a sign that is no white space."""
        out: list[str] = []
        for i, part in enumerate(text.split(" ")):
            unit = " " + part if i else part
            if out and (not out[-1] or out[-1][-1] in _SPACE_SET):
                out[-1] += unit
            else:
                out.append(unit)
        return out

    def encode(self, text: str | None) -> bytes:
        """Token ids as little-endian 32-bit integers; of a null or empty text none."""
        if not text:
            return b""
        if any(s in text for s in _ASCII_BEFORE) or (not text.isascii() and any(s in text for s in _OTHER_BEFORE)):
            return b"".join(map(self.starts.__getitem__, self.units_of(text)))
        head, *rest = text.split(" ")
        return self.starts[head] + b"".join(map(self.units.__getitem__, rest))

    def ids(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode(text), "<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.v.bytes_of[i] for i in ids).decode("utf-8", "replace")


class EditableText:
    """A text with its encoding, kept exact under appends and edits.

    Only the pieces that an edit touches, and the two around it, are encoded
    again; in the last piece an append continues from the stored prefixes.
    """

    def __init__(self, encoder: Encoder, text: str = ""):
        self.e = encoder
        self.units = encoder.units_of(text) if text else []
        self.codes = [encoder._unit(u) for u in self.units]
        self._tail: tuple[bytes, list[int]] = (b"", [])

    @property
    def text(self) -> str:
        return "".join(self.units)

    def ids(self) -> list[int]:
        return np.frombuffer(b"".join(self.codes), "<i4").tolist()

    def append(self, more: str) -> None:
        n = len(self.units)
        tail = self.units[n - 1] if n else ""
        again = [u for u in self.e.units_of(tail + more) if u]
        self.units[max(0, n - 1) :] = again
        self.codes[max(0, n - 1) :] = [self.e._unit(u) for u in again[:-1]] + ([self._last_unit(again[-1])] if again else [])

    def _last_unit(self, unit: str) -> bytes:
        pieces = self.e.split(unit)
        data = pieces[-1].encode()
        old, last = self._tail
        same = len(old) if data.startswith(old) else 0
        last = last[:same]
        self.e.v.extend(data, last)
        self._tail = (data, last)
        return b"".join(map(self.e.pieces.__getitem__, pieces[:-1])) + np.asarray(self.e.v.trace(last), "<i4").tobytes()

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replace the signs from ``start`` up to ``stop`` by ``new``."""
        i, at = 0, 0
        while i < len(self.units) and at + len(self.units[i]) < start:
            at += len(self.units[i])
            i += 1
        j, end = i, at
        while j < len(self.units) and end < stop:
            end += len(self.units[j])
            j += 1
        # the piece after an edit may join what stands before it
        while j < len(self.units) and j <= i + 1:
            end += len(self.units[j])
            j += 1
        old = "".join(self.units[i:j])
        fresh = old[: start - at] + new + old[stop - at :]
        if i:
            i -= 1
            fresh = self.units[i] + fresh
        if j < len(self.units) and (not fresh or fresh[-1] in _SPACE_SET):
            fresh += self.units[j]
            j += 1
        again = [u for u in self.e.units_of(fresh) if u]
        self.units[i:j] = again
        self.codes[i:j] = [self.e._unit(u) for u in again]
        self._tail = (b"", [])


@lru_cache(maxsize=2)
def encoder_for(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


def read_vocabulary(path: str = VOCABULARY) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_corpus(df: DataFrame, key: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """``key`` and ``ids`` (array<int>) of each row; null and empty texts have the empty list.

    The vocabulary file (a fixed size, under 2 MB) is read once by the driver
    and broadcast. Rows are independent: no shuffle.
    """
    columns_or_fail(df, key, text)
    sent = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_for(sent.value).encode
        for b in batches:
            coded = [encode(t) for t in b.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, coded)]) // 4
            values = pa.array(np.frombuffer(b"".join(coded), "<i4"), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=[key, "ids"])

    src = df.select(c(key), c(text))
    schema = T.StructType([T.StructField(key, src.schema[0].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return src.mapInArrow(run, schema)


def decode_corpus(df: DataFrame, key: str, ids: str, out: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``key`` and the text of each list of ids; null and empty lists give the empty text."""
    columns_or_fail(df, key, ids)
    sent = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoder_for(sent.value).decode
        for b in batches:
            texts = pa.array([decode(x or []) for x in b.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), texts], names=[key, out])

    src = df.select(c(key), c(ids))
    return src.mapInArrow(run, T.StructType([T.StructField(key, src.schema[0].dataType), T.StructField(out, T.StringType())]))


def count_tokens(df: DataFrame, text: str, out: str, path: str = VOCABULARY) -> DataFrame:
    """``df`` with the number of tokens of ``text`` in ``out``; null and empty texts have 0."""
    columns_or_fail(df, text)
    sent = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    keep = [x for x in df.columns if x.lower() != out.lower()]
    src = df.select(*[c(x) for x in keep])
    where = keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_for(sent.value).encode
        for b in batches:
            n = [len(encode(t)) // 4 for t in b.column(where).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], names=[*keep, out])

    return src.mapInArrow(run, T.StructType([*src.schema.fields, T.StructField(out, T.LongType())]))
