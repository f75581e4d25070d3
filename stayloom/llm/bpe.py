"""Byte-level BPE by speculation: longest matches are proposed, adjacent pairs verified, only failing words merged exactly.

A sequence of tokens is what merging would give exactly when every adjacent pair of it is (each token being what merging
gives for its own bytes). So a greedy longest-match proposal needs no merging once all its pairs are found compatible.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayloom.llm import textkit as K

LONG_PIECE = 512
REMEMBERED, HELD_CHARACTERS, EXACT_BYTES = 200_000, 1 << 24, 1 << 22
ENCODE_SLICE = 1 << 20
MARK = "\0special "  # no piece of the pattern holds both a control character and letters
# The split pattern of the public byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ENCODED = "doc_id bigint, ids array<int>"
DECODED = "doc_id bigint, decoded string"
ROUND_TRIP = "doc_id bigint, ids array<int>, decoded string"


def printable_bytes() -> dict[str, int]:
    """The character that stands for each byte in vocabulary files of this kind."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def read_tokenizer(path: str) -> dict:
    """Token bytes, merges as id pairs and special tokens of a tokenizer file; its size bounds what is broadcast."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte_of = printable_bytes()
    vocab = spec["model"]["vocab"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    size = max([*vocab.values(), *special.values()]) + 1
    tokens = [b""] * size
    for token, i in vocab.items():
        tokens[i] = token.encode() if token in special else bytes(byte_of[c] for c in token)
    for token, i in special.items():
        tokens[i] = token.encode()
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
    return {"tokens": tokens, "special": special, "merges": [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs],
            "plain": [i for t, i in vocab.items() if t not in special]}


class Codec:
    """Lookup tables of one vocabulary inside a worker."""

    def __init__(self, spec: dict):
        tokens = spec["tokens"]
        self.size, self.special = len(tokens), spec["special"]
        self.merge = {(a, b): (rank, new) for rank, (a, b, new) in enumerate(spec["merges"])}
        lengths = np.array([len(t) for t in tokens], np.int64)
        self.token_offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.byte_id = np.zeros(256, np.int64)
        for i in spec["plain"]:
            if len(tokens[i]) == 1:
                self.byte_id[tokens[i][0]] = i
        self.pattern = regex.compile(PATTERN)
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.exact: dict[bytes, list[int]] = {}
        self.exact_bytes = 0
        self.rows: dict[str, int] = {}
        self.held = 0
        self._trie(tokens, spec["plain"])
        self._spines(spec["merges"])
        self._self_stable(tokens, spec["plain"])

    def _trie(self, tokens, plain) -> None:
        prefixes: dict[bytes, int] = {b"": 0}
        accept, edges = [-1], []
        for i in plain:
            token = tokens[i]
            for k in range(1, len(token) + 1):
                if token[:k] not in prefixes:
                    prefixes[token[:k]] = len(accept)
                    edges.append((prefixes[token[:k - 1]], token[k - 1], len(accept)))
                    accept.append(-1)
            accept[prefixes[token]] = i
        e = np.array(edges, np.int64)
        children = np.bincount(e[:, 0], minlength=len(accept))
        number = np.argsort(np.argsort(-np.minimum(children, 2), kind="stable"))  # first nodes of several children, then of one
        self.forks, self.inner = int((children > 1).sum()), int((children > 0).sum())
        parent, byte, child = number[e[:, 0]], e[:, 1], number[e[:, 2]]
        self.next = np.zeros((self.forks + 1, 256), np.int32)  # only forks have a row, the last row is empty
        fork = parent < self.forks
        self.next[parent[fork], byte[fork]] = child[fork]
        self.only_byte, self.only_child = np.full(self.inner + 1, -1, np.int16), np.zeros(self.inner + 1, np.int32)
        self.only_byte[parent[~fork]], self.only_child[parent[~fork]] = byte[~fork], child[~fork]
        self.accept = np.empty(len(accept), np.int32)
        self.accept[number] = accept

    def follow(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The child of each node by a byte; 0, the root, where there is none."""
        inner = np.minimum(node, self.inner)
        only = np.where(self.only_byte[inner] == byte, self.only_child[inner], 0)
        return np.where(node < self.forks, self.next[np.minimum(node, self.forks), byte], only)

    def _spines(self, merges) -> None:
        """Per token the pieces on its right and left edge, from itself down to one byte, and the rank that ends each."""
        never = len(merges) + 1
        children = {new: (a, b, rank) for rank, (a, b, new) in reversed(list(enumerate(merges)))}

        def spine(token: int, side: int) -> list[tuple[int, int]]:
            out, ends = [(token, never)], never
            while token in children:
                ends, token = children[token][2], children[token][side]
                out.append((token, ends))
            return out

        for name, side in (("right", 1), ("left", 0)):
            lines = [spine(t, side) for t in range(self.size)]
            depth = max(map(len, lines))
            piece, ends = np.full((self.size, depth), -1, np.int32), np.zeros((self.size, depth), np.int32)
            for t, line in enumerate(lines):
                for j, (p, e) in enumerate(line):
                    piece[t, j], ends[t, j] = p, e
            setattr(self, name, (piece, ends))
        keys = np.array([a * self.size + b for a, b, _ in merges], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], order
        self.pair_new = np.array([new for _, _, new in merges], np.int64)[order]

    def _self_stable(self, tokens, plain) -> None:
        self.stable = np.zeros(self.size, bool)
        for i in plain:
            self.stable[i] = self.merged(tokens[i]) == [i]
        self.exact.clear()
        self.exact_bytes = 0

    def merged(self, piece: bytes) -> list[int]:
        """Exact merging of one piece with a heap of (rank, place); remembers pieces of bounded number and size."""
        have = self.exact.get(piece)
        if have is not None:
            return have
        ids = [int(self.byte_id[b]) for b in piece]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            found = self.merge.get((ids[i], ids[i + 1]))
            if found:
                heap.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n:
                    found = self.merge.get((ids[left], ids[right]))
                    if found:
                        heapq.heappush(heap, (found[0], left, ids[left], ids[right], found[1]))
        out = [t for t in ids if t >= 0]
        if len(self.exact) >= REMEMBERED or self.exact_bytes > EXACT_BYTES:
            self.exact.clear()
            self.exact_bytes = 0
        self.exact[piece] = out
        self.exact_bytes += n
        return out

    def merged_together(self, raw: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, token) of exact merging of many pieces: each round, every piece makes the leftmost merge of its lowest rank."""
        ids, owner = self.byte_id[raw].astype(np.int64), np.repeat(np.arange(len(length)), length)
        who, what = [], []
        while len(ids):
            key = np.where(owner[:-1] == owner[1:], ids[:-1] * self.size + ids[1:], -1)
            place = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            at = np.flatnonzero(self.pair_keys[place] == key)
            moving = np.zeros(len(length), bool)
            moving[owner[at]] = True
            here = moving[owner]
            who.append(owner[~here])
            what.append(ids[~here])
            if not len(at):
                break
            first = np.flatnonzero(np.concatenate([[True], owner[at[1:]] != owner[at[:-1]]]))
            best = np.minimum.reduceat(self.pair_ranks[place[at]] << 32 | at, first) & 0xFFFFFFFF
            ids[best] = self.pair_new[place[best]]
            here[best + 1] = False
            ids, owner = ids[here], owner[here]
        who, what = np.concatenate(who or [np.zeros(0, np.int64)]), np.concatenate(what or [np.zeros(0, np.int64)])
        order = np.argsort(who, kind="stable")
        return who[order], what[order]

    def propose(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, token) of greedy longest matches, all pieces walking the trie in step; pieces in order."""
        at, piece, stop = starts.copy(), np.arange(len(starts)), ends
        node = np.zeros(len(at), np.int64)
        best, best_at = np.full(len(at), -1, np.int64), at.copy()
        who, what = [], []
        while len(at):
            inside = at < stop
            step = np.where(inside, self.follow(node, raw[np.minimum(at, len(raw) - 1)]), 0)
            go = step > 0
            at, node = at + go, np.where(go, step, 0)
            token = self.accept[node]
            better = go & (token >= 0)
            best, best_at = np.where(better, token, best), np.where(better, at, best_at)
            done = np.flatnonzero(~go)
            if len(done):
                who.append(piece[done])
                what.append(best[done])
                at[done] = best_at[done]
                live = go | (best_at < stop)
                at, piece, stop, node, best, best_at = (x[live] for x in (at, piece, stop, node, best, best_at))
        if not who:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        who, what = np.concatenate(who), np.concatenate(what)
        order = np.argsort(who, kind="stable")
        return who[order], what[order]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of two tokens side by side leaves the two tokens.

        A merge across the border joins a piece of the right edge of ``a`` and one of the left edge of ``b`` while both exist;
        at equal rank the leftmost merge goes first, so the left piece must outlive it and the right piece need not.
        """
        good = self.stable[a] & self.stable[b]
        (right, right_end), (left, left_end) = self.right, self.left
        for j in range(right.shape[1]):
            some = np.flatnonzero(good & (right[a, j] >= 0))
            if not len(some):
                break
            for i in range(left.shape[1]):
                some = some[left[b[some], i] >= 0]
                if not len(some):
                    break
                key = right[a[some], j].astype(np.int64) * self.size + left[b[some], i]
                place = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
                rank = np.where(self.pair_keys[place] == key, self.pair_ranks[place], len(self.pair_keys) + 9)
                bad = (rank < right_end[a[some], j]) & (rank <= left_end[b[some], i])
                good[some[bad]] = False
        return good

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of distinct pieces."""
        n = len(pieces)
        length = np.array([len(p) for p in pieces], np.int64)
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum(length)
        short = np.flatnonzero((length <= LONG_PIECE) & (length > 0))
        who, what = self.propose(raw, (ends - length)[short], ends[short])
        who = short[who]
        joint = np.flatnonzero(who[1:] == who[:-1]) if len(who) else np.zeros(0, np.int64)
        pair, back = np.unique(what[joint] * self.size + what[joint + 1], return_inverse=True)
        ok = self.compatible(pair // self.size, pair % self.size)
        failing = length > LONG_PIECE
        failing[who[joint[~ok[back]]]] = True
        failing[who[~self.stable[what]]] = True
        keep = ~failing[who]
        who, what = who[keep], what[keep]
        exact = [(i, self.merged(pieces[i])) for i in np.flatnonzero(length > LONG_PIECE).tolist()]
        again = np.flatnonzero(failing & (length <= LONG_PIECE))
        if exact or len(again):
            few, tokens = self.merged_together(np.frombuffer(b"".join([pieces[i] for i in again.tolist()]), np.uint8), length[again])
            who = np.concatenate([who, again[few], np.repeat(np.array([i for i, _ in exact], np.int64), [len(t) for _, t in exact])])
            what = np.concatenate([what, tokens, np.array([t for _, ids in exact for t in ids], np.int64)])
            order = np.argsort(who, kind="stable")
            who, what = who[order], what[order]
        return what, np.concatenate([[0], np.cumsum(np.bincount(who, minlength=n))])

    def known_pieces(self, listed: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of each piece, ids, offsets): pieces are encoded once and kept until there are more than ``REMEMBERED``."""
        fresh = [p for p in dict.fromkeys(listed) if p not in self.rows]
        self.held += sum(map(len, fresh))
        if len(self.rows) + len(fresh) > REMEMBERED or self.held > HELD_CHARACTERS or not self.rows:
            self.held = sum(map(len, listed))
            self.rows = {MARK + s: i for i, s in enumerate(self.special)}
            self.ids, self.ids_at = np.array(list(self.special.values()), np.int64), np.arange(len(self.special) + 1)
            fresh = [p for p in dict.fromkeys(listed) if p not in self.rows]
        if fresh:
            flat, offsets = self.encode_pieces([p.encode() for p in fresh])
            self.rows.update(zip(fresh, range(len(self.rows), len(self.rows) + len(fresh))))
            self.ids, self.ids_at = np.concatenate([self.ids, flat]), np.concatenate([self.ids_at, self.ids_at[-1] + offsets[1:]])
        return np.fromiter(map(self.rows.__getitem__, listed), np.int64, len(listed)), self.ids, self.ids_at

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of whole texts; NULL is empty."""
        listed: list[str] = []
        sizes = []
        for text in texts:
            before = len(listed)
            if text:
                parts = self.splitter.split(text) if self.special and any(s in text for s in self.special) else (text,)
                for k, part in enumerate(parts):
                    if k % 2:
                        listed.append(MARK + part)
                    else:
                        listed += self.pattern.findall(part)
            sizes.append(len(listed) - before)
        codes, flat, offsets = self.known_pieces(listed)
        ids, place = K.gather(flat, offsets, codes)
        return ids.astype(np.int32), place[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        raw, place = K.gather(self.token_bytes, self.token_offsets, ids.astype(np.int64))
        data, cut = raw.tobytes(), place[offsets].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(cut, cut[1:])]


class Vocabulary:
    """What is broadcast of a tokenizer file; a worker makes the tables once and holds them as long as Spark leaves the broadcast there."""

    def __init__(self, spec: dict):
        self.spec: dict | None = spec
        self.codec: Codec | None = None

    def tables(self) -> Codec:
        if self.codec is None:
            self.codec, self.spec = Codec(self.spec), None
        return self.codec


def _lists(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))


def _run(df: DataFrame, path: str, schema: str, build) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary(read_tokenizer(path)))

    def work(batches):
        yield from build(shared.value.tables(), batches)

    return K.map_arrow(df, work, schema)


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and token ids of every row's whole text; NULL and empty text give an empty array. Other columns are ignored."""

    def build(codec, batches):
        for part in K.slices(batches, "text", ENCODE_SLICE):
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "ids": _lists(*codec.encode(part.column("text").to_pylist()))})

    return _run(_source(docs), path, ENCODED, build)


def _decoded(codec: Codec, ids: pa.Array) -> list[str]:
    ids = ids.cast(pa.list_(pa.int32())).fill_null([])
    at = ids.offsets.to_numpy()
    return codec.decode(ids.values.to_numpy()[at[0]:at[-1]], at - at[0])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row's ids; bytes that are no UTF-8 become replacement characters, a NULL array empty text."""

    def build(codec, batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "decoded": _decoded(codec, part.column("ids"))})

    return _run(encoded.select("doc_id", "ids"), path, DECODED, build)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``encode`` and ``decode`` of the ids it gave, in one pass over the texts; rows with equal ids stay separate rows."""

    def build(codec, batches):
        for part in K.slices(batches, "text", ENCODE_SLICE):
            ids = codec.encode(part.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "ids": _lists(*ids), "decoded": codec.decode(*ids)})

    return _run(_source(docs), path, ROUND_TRIP, build)
