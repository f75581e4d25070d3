"""Words, runs and hashes of many texts at once, as numpy arrays over the bytes of an Arrow column.

A batch of texts is one byte array with offsets, so no Python object is made per word. Words and lines are hashed by a random
value per place and byte, short runs of words by polynomials modulo 2**64 over those hashes (under which only sequences of 1,024
words and more can meet by their order). Hashes depend on content only, never on place in a text, batch or process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SLICE_BYTES = 1 << 19
BYTE_BASE, GRAM_BASE, SECOND_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xA0761D6478BD642F
_KEPT_POWERS = 1 << 20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def byte_table(inside: bytes | range | list[int]) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(inside)] = True
    return table


SPACES = byte_table([0x20, *range(0x09, 0x0E)])
WORD_BYTES = ~SPACES
UPPER = np.arange(256, dtype=np.uint8)
UPPER[65:91] += 32
ALNUM = byte_table([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
UNIT_BYTES = byte_table([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])


def bucket_of(column: Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo ``modulus``; NULL counts as empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def pack(docs: DataFrame) -> Column:
    """The whole row as struct ``doc``, so that no other column's name can clash with or break what is built around it."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")


def field(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column, or with ``parent.child`` a field of a struct column."""
    parent, _, child = name.partition(".")
    return batch.column(parent).field(child) if child else batch.column(parent)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice holds at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(field(batch, column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if i > start and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; NULL is empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1]
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[at[0]:at[-1]]
    return raw, at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0..n-1 and their inverses modulo 2**64 (odd bases only)."""
    have = _powers.get(base)
    if have is not None and len(have[0]) >= n:
        return have
    size = ((n >> 18) + 1) << 18
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(size, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    if size <= _KEPT_POWERS:
        _powers[base] = (out[0], out[1])
    return out[0], out[1]


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True bytes; a run never crosses a text."""
    if len(mask) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    last[:-1] &= ~mask[1:]
    edges = offsets[(offsets > 0) & (offsets < len(mask))]
    first[edges] = mask[edges]
    last[edges - 1] = mask[edges - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def owners(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.searchsorted(offsets, starts, side="right") - 1


def segment_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BYTE_BASE) -> np.ndarray:
    """Hash of each byte range."""
    n = len(raw)
    power, inverse = powers(base, n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts])


_PLACES = 64
_tables: dict[int, np.ndarray] = {}


def placed_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of each byte range as a sum of random values, one per place and byte; ranges are not empty.

    No relation between the values of two places exists, so no order of bytes, however regular, makes two ranges meet; two seeds
    give independent hashes.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    if seed not in _tables:
        _tables[seed] = _placed(np.arange(_PLACES * 256, dtype=np.uint64), seed)
    length = ends - starts
    begin = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(begin, length)
    cell = place << 8 | raw[np.repeat(starts, length) + place]
    value = _tables[seed][np.minimum(cell, _PLACES * 256 - 1)]
    far = np.flatnonzero(place >= _PLACES)
    value[far] = _placed(cell[far].astype(np.uint64), seed)
    return mix(np.add.reduceat(value, begin) + length.astype(np.uint64) * np.uint64(GRAM_BASE))


def _placed(cell: np.ndarray, seed: int) -> np.ndarray:
    return mix(mix(cell * np.uint64(BYTE_BASE) + np.uint64(SECOND_BASE)) + np.uint64(seed * 0x9FB21C651E98DF25 & (1 << 64) - 1))


class Rolling:
    """Prefix sums over a sequence of hashes: the hash of any range of it in constant time."""

    def __init__(self, values: np.ndarray, base: int = GRAM_BASE):
        n = len(values)
        power, self.inverse = powers(base, n + 1)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(values * power[:n], out=self.total[1:])

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.total[ends] - self.total[starts]) * self.inverse[starts])


def grams(values: np.ndarray, owner: np.ndarray, k: int, base: int = GRAM_BASE) -> tuple[np.ndarray, np.ndarray]:
    """(start index, hash) of every k consecutive values of one text."""
    if len(values) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(owner[:len(owner) - k + 1] == owner[k - 1:])
    return at, Rolling(values, base).ranges(at, at + k)


def repeated(keys: np.ndarray) -> np.ndarray:
    """For each key whether it occurs at least twice."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    hit = np.zeros(len(keys), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    return hit


def covered(starts: np.ndarray, length, n: int) -> np.ndarray:
    """Which of n places lie in one of the ranges [start, start + length)."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + length, -1)
    return np.cumsum(change[:n]) > 0


def gather(flat: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of the ragged rows ``which`` one after another."""
    length = offsets[which + 1] - offsets[which]
    out = np.zeros(len(which) + 1, np.int64)
    np.cumsum(length, out=out[1:])
    return flat[np.repeat(offsets[which] - out[:-1], length) + np.arange(out[-1])], out


def per_text(owner: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(owner, weights=weights, minlength=n).astype(np.int64)


class Words:
    """The words of a slice: byte ranges, hashes and the text each belongs to."""

    def __init__(self, column: pa.Array, table: np.ndarray = WORD_BYTES, lower: bool = False):
        raw, self.offsets = text_bytes(column)
        self.raw = UPPER[raw] if lower else raw
        self.mask = table[self.raw]
        self.starts, self.ends = runs(self.mask, self.offsets)
        self.owner = owners(self.starts, self.offsets)
        self.hash = placed_hash(self.raw, self.starts, self.ends)
        self.n_texts = len(column)
        self.counts = per_text(self.owner, self.n_texts)

    def second_hash(self) -> np.ndarray:
        """Another hash of the words, from their bytes on."""
        return placed_hash(self.raw, self.starts, self.ends, 1)


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def map_arrow(df: DataFrame, fn, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` that hands Arrow's free memory back after each task, since workers are used again by later stages."""

    def task(batches):
        yield from fn(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(task, schema)


def units(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, whether it is a mark) of each unit, A-Z lower-cased.

    A unit is a run of letters and digits, or a run of other printing characters; so a mark glued to a word counts as itself.
    """
    raw, offsets = text_bytes(column)
    raw = UPPER[raw]
    letters, marks = runs(ALNUM[raw], offsets), runs(~ALNUM[raw] & ~SPACES[raw], offsets)
    starts, ends = np.concatenate([letters[0], marks[0]]), np.concatenate([letters[1], marks[1]])
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    return owners(starts, offsets), segment_hash(raw, starts, ends), order >= len(letters[0])


def with_partner(df: DataFrame, key: str, *rest: str) -> DataFrame:
    """The rows whose bigint ``key`` another row has too, and at most a few rows more at the edges of tasks.

    Rows are dealt by ranges of (key, rest), so a very common key spreads over tasks and none is gathered. A row goes where its
    neighbours in order have other keys; the first and last key of a task stay, since the next task may hold more of them.
    """

    def meet(batches):
        held = None  # the last row of the batch before, and whether it is known to stay
        for batch in batches:
            if not batch.num_rows:
                continue
            known = True if held is None else held[1]
            joined = pa.Table.from_batches([batch] if held is None else [held[0], batch]).combine_chunks().to_batches()[0]
            value = joined.column(key).to_numpy()
            stay = np.zeros(len(value), bool)
            stay[0] = known
            same = value[1:] == value[:-1]
            stay[1:] |= same
            stay[:-1] |= same
            held = (joined.slice(len(value) - 1), bool(stay[-1]))
            yield joined.slice(0, len(value) - 1).filter(pa.array(stay[:-1]))
        if held is not None:
            yield held[0]

    ordered = df.repartitionByRange(key, *rest).sortWithinPartitions(key, *rest)
    return map_arrow(ordered, meet, df.schema)
