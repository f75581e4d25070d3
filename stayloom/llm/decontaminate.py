"""Benchmark decontamination with a generalised suffix automaton over the words of the benchmark items.

The automaton is built per block of items of bounded size; every document streams through it word by word, tracking the
longest match that ends at each word. Words that no item has, and neighbours that no item has side by side, end every match,
so numpy cuts a text at those places first and only stretches that can hold a whole window are streamed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayloom.llm import textkit as K
from stayloom.session import cut_lineage

WINDOW = 10
BLOCK_WORDS = 200_000
COVERAGE_LIMIT = 0.5
TOKEN_BYTES = K.byte_table([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
FOUND = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:int,end:int>>, cleaned string"


def tokens(column: pa.Array) -> K.Words:
    return K.Words(column, TOKEN_BYTES, lower=True)


class SuffixAutomaton:
    """Suffix automaton of several word sequences, with the items of each window marked on its states."""

    def __init__(self, items: list[tuple[str | None, list[int]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, sequence in items:
            last = 0
            for symbol in sequence:
                last = self._extend(last, symbol)
        self._anchors()
        self.names = [name for name, _ in items]
        self.window_items: dict[int, set[int]] = {}
        self.short_items: dict[int, list[tuple[int, int]]] = {}
        self.sizes = {min(len(s), window) for _, s in items if s}
        for number, (_, sequence) in enumerate(items):
            if len(sequence) >= window:
                for _, state, _ in self._walk(sequence):
                    if self.anchor[state] >= 0:
                        self.window_items.setdefault(self.anchor[state], set()).add(number)
            elif sequence:
                *_, (_, state, _) = self._walk(sequence)
                self.short_items.setdefault(state, []).append((len(sequence), number))
        self._short_links()

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, parent: int, symbol: int, child: int) -> int:
        """The state for the strings of ``child`` no longer than ``parent`` and the symbol, made where it does not exist."""
        if self.length[child] == self.length[parent] + 1:
            return child
        twin = self._state(self.length[parent] + 1, dict(self.next[child]), self.link[child])
        self.link[child] = twin
        while parent >= 0 and self.next[parent].get(symbol) == child:
            self.next[parent][symbol] = twin
            parent = self.link[parent]
        return twin

    def _extend(self, last: int, symbol: int) -> int:
        if symbol in self.next[last]:
            return self._split(last, symbol, self.next[last][symbol])
        new = self._state(self.length[last] + 1, {}, 0)
        while last >= 0 and symbol not in self.next[last]:
            self.next[last][symbol] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, symbol, self.next[last][symbol])
        return new

    def _anchors(self) -> None:
        """For every state the state on its suffix chain that holds strings of exactly ``window`` words."""
        self.anchor = [-1] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            parent = self.link[state]
            if self.length[state] >= self.window:
                self.anchor[state] = state if self.length[parent] < self.window else self.anchor[parent]

    def _short_links(self) -> None:
        """For every state the nearest state on its chain, itself included, where a short item ends."""
        self.short_at = [-1] * len(self.link)
        for state in sorted(range(len(self.link)), key=self.length.__getitem__):
            parent = self.link[state]
            self.short_at[state] = state if state in self.short_items else self.short_at[parent] if parent >= 0 else -1

    def _walk(self, sequence) -> Iterator[tuple[int, int, int]]:
        """(place, state, longest matching length) after each word."""
        state = matched = 0
        for place, symbol in enumerate(sequence):
            while state and symbol not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if symbol in self.next[state]:
                state, matched = self.next[state][symbol], matched + 1
            yield place, state, matched

    def hits(self, sequence) -> Iterator[tuple[int, int, int]]:
        """(first place, last place, item) of every window and short item that occurs."""
        for place, state, matched in self._walk(sequence):
            if matched >= self.window and self.anchor[state] >= 0:
                for item in self.window_items.get(self.anchor[state], ()):
                    yield place - self.window + 1, place, item
            short = self.short_at[state]
            while short >= 0:
                for size, item in self.short_items[short]:
                    if size <= matched:
                        yield place - size + 1, place, item
                short = self.short_at[self.link[short]] if self.link[short] >= 0 else -1


class Block:
    """One block of items: word numbers, neighbouring pairs and the automaton."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        words = tokens(pa.array([text for _, text in items], pa.string()))
        self.vocabulary, symbol = np.unique(words.hash, return_inverse=True)
        cuts = np.concatenate([[0], np.cumsum(words.counts)])
        self.pairs = np.unique(self._pair(symbol[:-1], symbol[1:])[words.owner[1:] == words.owner[:-1]])
        self.automaton = SuffixAutomaton([(name, symbol[a:b].tolist()) for (name, _), a, b in zip(items, cuts, cuts[1:])], window)

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a.astype(np.int64) * len(self.vocabulary) + b

    def search(self, words: K.Words) -> tuple[np.ndarray, list[set[int]]]:
        """(hit flag per word, items per text)."""
        hit, items = np.zeros(len(words.hash), bool), [set() for _ in range(words.n_texts)]
        if not len(self.vocabulary) or not len(words.hash):
            return hit, items
        place = np.minimum(np.searchsorted(self.vocabulary, words.hash), len(self.vocabulary) - 1)
        known = self.vocabulary[place] == words.hash
        joined = known[1:] & known[:-1] & (words.owner[1:] == words.owner[:-1])
        spots = np.flatnonzero(joined)
        if len(self.pairs):
            pair = self._pair(place[spots], place[spots + 1])
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            joined[spots[self.pairs[at] != pair]] = False
        else:
            joined[:] = False
        first = known & ~np.concatenate([[False], joined])
        last = known & ~np.concatenate([joined, [False]])
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        enough = ends - starts >= min(self.automaton.sizes, default=1)
        for a, b in zip(starts[enough].tolist(), ends[enough].tolist()):
            for x, y, item in self.automaton.hits(place[a:b].tolist()):
                hit[a + x:a + y + 1] = True
                items[words.owner[a]].add(item)
        return hit, items


def blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[Block]:
    """Blocks of whole items; what the driver holds at a time is bounded by ``block_words`` and one item."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).where("t is not null")
    held, size = [], 0
    for row in rows.toLocalIterator():
        count = row.t.count(" ") + 1
        if held and size + count > block_words:
            yield Block(held, window)
            held, size = [], 0
        held.append((row.i, row.t))
        size += count
    yield Block(held, window)


def _spans(hit: np.ndarray, words: K.Words, text: int, first: int) -> list[dict]:
    flags = np.concatenate([[False], hit[first:first + int(words.counts[text])], [False]]).astype(np.int8)
    edge = np.flatnonzero(np.diff(flags))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])]


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, coverage_limit: float = COVERAGE_LIMIT,
                  block_words: int = BLOCK_WORDS) -> DataFrame:
    """Every row of ``docs`` with all its columns, and a column ``found``.

    ``found`` is a struct: n_words, n_hit (words inside any occurring window of ``window`` consecutive item words; a shorter
    item is one window), items (ids of the items with occurring windows, distinct, sorted as text; an item with a NULL id marks
    words but has no name), spans (half-open word ranges) and cleaned (the text with the hit spans cut out, each leaving a
    line break; empty text where more than ``coverage_limit`` of the words are hit). NULL and empty texts have no words and
    keep their text. Rows are judged one by one, so repeated ids and repeated rows are no special case, and the only name
    taken is ``found``, which replaces a column of that name. An empty benchmark hits nothing. A benchmark of more than
    ``block_words`` words is searched block by block, each pass adding to what the passes before it found.
    """
    docs = docs.drop("found")
    result = docs.select(K.pack(docs), F.lit(None).cast(f"struct<{FOUND_TYPE}>").alias("found"))
    for number, block in enumerate(blocks(benchmark, window, block_words)):
        if number:
            result = cut_lineage(result, "decontaminate")
        result = _search(result, block, coverage_limit)
    return result.select("doc.*", "found")


FOUND_TYPE = ", ".join(f"{n}:{t}" for n, t in (part.split(" ", 1) for part in FOUND.split(", ")))


def _search(frame: DataFrame, block: Block, coverage_limit: float) -> DataFrame:
    """One pass over (doc, found): adds the hits of a block to ``found``."""
    shared = frame.sparkSession.sparkContext.broadcast(block)
    struct = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
                        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("cleaned", pa.string())])
    schema = T.StructType([frame.schema["doc"], *T.StructType.fromDDL(f"found struct<{FOUND_TYPE}>").fields])

    def work(batches):
        names = shared.value.automaton.names
        for part in K.slices(batches, "doc.text"):
            text = K.field(part, "doc.text")
            words = tokens(text)
            hit, items = shared.value.search(words)
            firsts = np.concatenate([[0], np.cumsum(words.counts)])
            before = part.column("found")
            touched = np.flatnonzero(np.add.reduceat(np.concatenate([hit, [False]]), np.minimum(firsts[:-1], len(hit)))
                                     * (words.counts > 0)) if len(hit) else np.zeros(0, np.int64)
            marked = set(touched.tolist())
            out = []
            for i, count in enumerate(words.counts.tolist()):
                old = before[i].as_py()
                listed = {names[k] for k in items[i] if names[k] is not None} | set(old["items"] if old else ())
                first = int(firsts[i])
                for s in old["spans"] if old else ():
                    hit[first + s["start"]:first + s["end"]] = True
                if not (i in marked or old and old["spans"]):
                    out.append({"n_words": count, "n_hit": 0, "items": [], "spans": [], "cleaned": text[i].as_py()})
                    continue
                n_hit = int(hit[first:first + count].sum())
                spans = _spans(hit, words, i, first)
                base, kept, at = int(words.offsets[i]), [], 0
                raw = text[i].as_py().encode()
                for s in spans:
                    kept.append(raw[at:int(words.starts[first + s["start"]]) - base])
                    at = int(words.ends[first + s["end"] - 1]) - base
                kept.append(raw[at:])
                cleaned = "" if n_hit > coverage_limit * count else b"\n".join(kept).decode()
                out.append({"n_words": count, "n_hit": n_hit, "items": sorted(listed), "spans": spans, "cleaned": cleaned})
            yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(out, struct)], schema=pa.schema([part.schema.field("doc"), ("found", struct)]))

    return K.map_arrow(frame, work, schema)
