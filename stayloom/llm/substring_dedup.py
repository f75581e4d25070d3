"""Repeated passages by a compacted De Bruijn graph of word windows.

An edge of the graph is a window of 35 words, from the node of its first 34 words to that of its last 34. Consecutive windows
of a document that have the same smallest 12-word hash, their anchor, form a path without listing its edges. Paths whose anchor
is nowhere else cannot repeat and go first; equal paths then collapse in one aggregation. A path that occurs twice repeats with all its edges. Only where different paths share an anchor can the graph
branch inside a path, so only those are opened into single edges, counted again. Joins on source coordinates bring the
repeated stretches back to their documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayloom.llm import textkit as K
from stayloom.session import cut_lineage

WINDOW = 35
ANCHOR = 12
PATH = "row bigint, first int, edges int, anchor bigint, h1 bigint, h2 bigint"
EDGE = "row bigint, first int, weight int, h1 bigint, h2 bigint"
RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept string"


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` consecutive values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:len(out) - step], out[step:])
        have += step
    return out


def path_rows(words: K.Words, window: int, anchor: int) -> dict[str, np.ndarray]:
    """The paths of every text: owner, first window, number of windows, anchor hash, and two hashes of all its words."""
    value, owner = words.hash, words.owner
    if len(value) < window:
        none = np.zeros(0, np.int64)
        return {"owner": none, "first": none, "edges": none, "anchor": none, "h1": none, "h2": none}
    one = K.Rolling(value)
    at = np.arange(len(value) - anchor + 1)
    lowest = sliding_min(one.ranges(at, at + anchor), window - anchor + 1)
    valid = owner[:len(owner) - window + 1] == owner[window - 1:]
    fresh = valid.copy()
    fresh[1:] &= ~valid[:-1] | (lowest[1:] != lowest[:-1]) | (owner[1:len(valid)] != owner[:len(valid) - 1])
    stop = valid.copy()
    stop[:-1] &= ~valid[1:] | fresh[1:]
    start, end = np.flatnonzero(fresh), np.flatnonzero(stop) + 1
    two = K.Rolling(words.second_hash(), K.SECOND_BASE)
    firsts = np.concatenate([[0], np.cumsum(words.counts)])
    return {"owner": owner[start], "first": start - firsts[owner[start]], "edges": end - start, "anchor": lowest[start],
            "h1": one.ranges(start, end + window - 1), "h2": two.ranges(start, end + window - 1)}


def _paths(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    def work(batches):
        for part in K.slices(batches, "text"):
            rows = path_rows(K.Words(part.column("text")), window, anchor)
            ids = part.column("row").to_numpy()
            yield pa.RecordBatch.from_pydict({
                "row": ids[rows["owner"]], "first": rows["first"].astype(np.int32), "edges": rows["edges"].astype(np.int32),
                **{c: K.signed(rows[c].astype(np.uint64)) for c in ("anchor", "h1", "h2")}})

    return K.map_arrow(docs, work, PATH)


def _edges(docs: DataFrame, opened: DataFrame, window: int) -> DataFrame:
    """One row per window of the paths to open; ``opened``: row, list of (first, edges, weight)."""

    def work(batches):
        for part in K.slices(batches, "text"):
            words = K.Words(part.column("text"))
            value = words.hash
            one, two = K.Rolling(value), K.Rolling(words.second_hash(), K.SECOND_BASE)
            firsts = np.concatenate([[0], np.cumsum(words.counts)])
            lists = part.column("paths")
            owner = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            first, edges, weight = (flat.field(i).to_numpy() for i in range(3))
            inside = first + edges + window - 1 <= words.counts[owner]
            owner, first, edges, weight = owner[inside], first[inside], edges[inside], weight[inside]
            row = np.repeat(np.arange(len(owner)), edges)
            if not len(row):
                continue
            begin = np.cumsum(edges) - edges
            at = first[row] + np.arange(len(row)) - begin[row]
            where = firsts[owner[row]] + at
            yield pa.RecordBatch.from_pydict({
                "row": part.column("row").to_numpy()[owner[row]], "first": at.astype(np.int32), "weight": weight[row],
                "h1": K.signed(one.ranges(where, where + window)), "h2": K.signed(two.ranges(where, where + window))})

    return K.map_arrow(docs.join(opened, "row").select("row", "text", "paths"), work, EDGE)


def repeated_ranges(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(row, first, edges): stretches of consecutive windows that also start elsewhere.

    Windows repeated only inside one document may be missing here; ``substring_dedup`` finds those document by document.
    """
    key = ["anchor", "h1", "h2"]
    paths = cut_lineage(K.with_partner(_paths(docs, window, anchor), "anchor", "row", "first"), "paths")
    kinds = paths.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("shown"))
    branching = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.max("n").alias("most")).where("kinds > 1 or most > 1")
    known = kinds.join(branching, "anchor").select(*key, "n", "shown", (F.col("kinds") > 1).alias("branches"))
    found = paths.join(known, key).select("row", "first", "edges", "n", "shown", "branches")
    whole = found.where("n > 1").select("row", "first", "edges")
    opened = found.where("branches and (n = 1 or row = shown)").groupBy("row").agg(F.collect_set(F.struct(
        "first", "edges", F.when(F.col("n") > 1, 2).otherwise(1).cast("int").alias("weight"))).alias("paths"))
    edges = _edges(docs, opened, window)
    twice = edges.groupBy("h1", "h2").agg(F.sum("weight").alias("w")).where("w > 1").select("h1", "h2")
    single = edges.where("weight = 1").join(twice, ["h1", "h2"]).select("row", "first", F.lit(1).alias("edges"))
    return whole.unionByName(single)


def substring_dedup(docs: DataFrame, *, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed and ``kept`` (the words left, joined by one space) for every row of ``docs``.

    A word goes when a window of ``window`` consecutive words that covers it also starts anywhere else, in another document or
    in the same; every occurrence is judged on the input, so all copies of a passage go. Equality is decided by two
    64-bit hashes that are independent from the bytes on. NULL and empty texts have no words and keep ''. A text shorter than the window loses nothing. Rows
    are told apart by 64 bits of hash over id and text, so rows without an id or with one id are occurrences of their own; equal
    rows are too, and their stretches are the same. Columns other than doc_id and text are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    ranges = repeated_ranges(docs, window, anchor).groupBy("row").agg(F.collect_set(F.struct("first", "edges")).alias("ranges"))

    def cut(batches):
        for part in K.slices(batches, "text"):
            words = K.Words(part.column("text"))
            n, firsts = len(words.hash), np.concatenate([[0], np.cumsum(words.counts)])
            at, window_hash = K.grams(words.hash, words.owner, window)
            local = K.repeated(K.mix(window_hash + words.owner[at].astype(np.uint64) * np.uint64(K.SECOND_BASE)))
            lists = part.column("ranges").fill_null([])
            owner = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            first, edges = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            inside = first + edges + window - 1 <= words.counts[owner]
            begin = (firsts[owner] + first)[inside]
            change = np.zeros(n + 1, np.int64)
            np.add.at(change, np.concatenate([at[local], begin]), 1)
            np.add.at(change, np.concatenate([at[local] + window, begin + edges[inside] + window - 1]), -1)
            gone = np.cumsum(change[:n]) > 0
            removed = K.per_text(words.owner[gone], part.num_rows)
            stay = np.flatnonzero(~gone)
            ranges_at = np.concatenate([[0], np.cumsum(K.per_text(words.owner[stay], part.num_rows))])
            length = words.ends[stay] - words.starts[stay] + 1
            place = np.repeat(words.starts[stay] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
            raw = np.append(words.raw, np.uint8(32))[np.minimum(place, len(words.raw))]
            raw[np.cumsum(length) - 1] = 32
            data, cuts = raw.tobytes(), np.concatenate([[0], np.cumsum(length)])[ranges_at].tolist()
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id"),
                "n_words": words.counts, "n_removed": removed,
                "kept": [data[a:max(a, b - 1)].decode() for a, b in zip(cuts, cuts[1:])]})

    return K.map_arrow(docs.join(ranges, "row", "left").select("doc_id", "text", "ranges"), cut, RESULT)
