"""Repeated byte strings by a suffix sort with hash-compared suffixes.

Only suffixes that can have an equal start anywhere are sorted, and only next to each other. The smallest hash of the grams
in a window of 200 bytes is its bucket, so equal windows share a bucket; consecutive windows of a text with one bucket are a
path. Paths alone in their bucket hold no repeat of another place. Equal paths (128-bit BLAKE2b of their bytes) are repeats as
a whole, and one of them stands for all in what follows. Buckets with different paths send the bytes of these to one task, which sorts
all suffixes of its buckets: prefix polynomial hashes and binary search give the common extension of two suffixes, so
a comparison in the mergesort takes logarithmic time, and afterwards the bytes of every two neighbours are compared. A sort
with a pair out of order, which only a collision can cause, is done again on the bytes. A bucket too large for a block is split
by the smallest hash of longer grams, down to the window itself, so every bucket comes to an end whatever its share of the rows.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayloom.llm import textkit as K
from stayloom.llm.substring_dedup import sliding_min
from stayloom.session import cut_lineage

WINDOW = 200
GRAMS = (24, 100, 170, 195, 200)
PIECE = 4096
BLOCK = 1 << 20
BASE = K.GRAM_BASE
NO_ID = -(1 << 63)
PATH = "id bigint, tkey bigint, first int, edges int, bucket bigint, d1 bigint, d2 bigint"
PLACED = "id bigint, tkey bigint, first int, edges int, bucket bigint, known boolean, hot boolean, content binary"
RANGE = "id bigint, tkey bigint, first int, edges int"
RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"


class Prefix:
    """Prefix sums of the polynomial hash of a byte array: the hash of any range of it in constant time."""

    def __init__(self, raw: np.ndarray):
        power, self.inverse = K.powers(BASE, len(raw) + 1)
        self.total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:len(raw)], out=self.total[1:])

    def grams(self, k: int) -> np.ndarray:
        """A mixed hash of the ``k`` bytes at every place."""
        return K.mix((self.total[k:] - self.total[:-k]) * self.inverse[:len(self.total) - k])

    def common(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Length of the common extension of the suffixes at ``a`` and ``b``, at most ``most``, by binary search on hashes."""
        from_a, from_b, scale_a, scale_b = self.total[a], self.total[b], self.inverse[a], self.inverse[b]
        low, high = np.zeros(len(a), np.int64), np.full(len(a), most, np.int64)
        for _ in range(most.bit_length()):
            middle = (low + high + 1) >> 1
            same = (self.total[a + middle] - from_a) * scale_a == (self.total[b + middle] - from_b) * scale_b
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low


def _order(raw: np.ndarray, prefix: Prefix, a: np.ndarray, b: np.ndarray, window: int) -> np.ndarray:
    """-1, 0 or 1 as the window at ``a`` is before, equal to or after that at ``b``."""
    length = prefix.common(a, b, window)
    at = np.minimum(length, window - 1)
    return np.where(length == window, 0, np.sign(raw[a + at].astype(np.int16) - raw[b + at]))


def _byte_order(raw: np.ndarray, a: np.ndarray, b: np.ndarray, window: int) -> np.ndarray:
    """The same by comparing the bytes, eight at a time."""
    eight = np.ndarray((len(raw) - 7,), ">u8", raw, 0, (1,))
    result, left = np.zeros(len(a), np.int64), np.arange(len(a))
    for at in [*range(0, window - 8, 8), window - 8]:
        x, y = eight[a[left] + at], eight[b[left] + at]
        differ = x != y
        result[left[differ]] = np.where(x[differ] < y[differ], -1, 1)
        left = left[~differ]
    return result


def _merge_runs(raw, prefix, place, first, size, window):
    """``place`` sorted inside each group (its first index and size given per element): bottom-up merges of all groups at once."""
    group, local = first, np.arange(len(place)) - first
    width = 1
    while len(place) and width < size.max():
        run = local // width
        other = group + (run ^ 1) * width
        end = np.minimum(other + width, group + size)
        low, high = np.minimum(other, end), end.copy()
        right = (run & 1).astype(bool)
        begin = low.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) >> 1
            order = _order(raw, prefix, place[middle], place[open_], window)
            before = np.where(right[open_], order <= 0, order < 0)
            low[open_] = np.where(before, middle + 1, low[open_])
            high[open_] = np.where(before, high[open_], middle)
        target = group + (run >> 1) * 2 * width + (local - run * width) + (low - begin)
        lost = np.bincount(target, minlength=len(place)) != 1
        if lost.any():  # comparisons that contradict each other; the group stays as it is and fails the check of the bytes
            stay = np.isin(group, group[lost])
            target[stay] = np.flatnonzero(stay)
        merged = np.empty_like(place)
        merged[target] = place
        place, width = merged, width * 2
    return place


def sorted_suffixes(raw: np.ndarray, starts: np.ndarray, group: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, same): indices of ``starts`` sorted by group and window bytes, and which has the window of the one before it.

    ``raw`` must reach ``window`` bytes beyond every start. Suffixes alone with their first eight bytes in their group are left
    out. The order is checked on the bytes, and groups in which it fails are sorted by their bytes.
    """
    eight = np.ndarray((len(raw) - 7,), ">u8", raw, 0, (1,))
    head = eight[starts].astype(np.uint64)
    order = np.lexsort((head, group))
    change = np.ones(len(order) + 1, bool)
    change[1:-1] = (head[order[1:]] != head[order[:-1]]) | (group[order[1:]] != group[order[:-1]])
    order = order[~(change[:-1] & change[1:])]
    if not len(order):
        return order, np.zeros(0, bool)
    fresh = np.ones(len(order), bool)
    fresh[1:] = (head[order[1:]] != head[order[:-1]]) | (group[order[1:]] != group[order[:-1]])
    number = np.cumsum(fresh) - 1
    first = np.flatnonzero(fresh)
    prefix = Prefix(raw)
    place = starts[order]
    inside = np.flatnonzero(~fresh)
    wrong = np.zeros(len(first), bool)
    wrong[number[inside[_order(raw, prefix, place[inside - 1], place[inside], window) > 0]]] = True
    todo = np.flatnonzero(wrong[number])  # groups that are in order already, as in periodic text, need no merge
    if len(todo):
        size = np.diff(np.append(first, len(order)))[number[todo]]
        begin = np.ones(len(todo), bool)
        begin[1:] = number[todo[1:]] != number[todo[:-1]]
        at = np.flatnonzero(begin)[np.cumsum(begin) - 1]
        back = dict(zip(("place", "index"), (place[todo], order[todo])))
        merged = _merge_runs(raw, prefix, back["place"], at, size, window)
        index = np.argsort(back["place"], kind="stable")
        order[todo] = back["index"][index[np.searchsorted(back["place"], merged, sorter=index)]]
        place[todo] = merged
    exact = _byte_order(raw, place[inside - 1], place[inside], window)
    for g in np.unique(number[inside[exact > 0]]).tolist():  # a hash collision misled the sort of this group
        members = np.flatnonzero(number == g)
        members_in_order = sorted(order[members].tolist(), key=lambda i: raw[starts[i]:starts[i] + window].tobytes())
        order[members] = members_in_order
        place[members] = starts[members_in_order]
    if (exact > 0).any():
        exact = _byte_order(raw, place[inside - 1], place[inside], window)
    same = np.zeros(len(order), bool)
    same[inside] = exact == 0
    return order, same


def repeated_windows(raw: np.ndarray, starts: np.ndarray, group: np.ndarray, window: int) -> np.ndarray:
    """For each start whether another start of its group has the same ``window`` bytes; the starts must differ."""
    hit = np.zeros(len(starts), bool)
    if len(starts):
        order, same = sorted_suffixes(raw, starts, group, window)
        hit[order[same]] = True
        hit[order[np.flatnonzero(same) - 1]] = True
    return hit


def _lowest(raw: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram hashes, the smallest of each window, and which windows lie inside one text."""
    grams = Prefix(raw).grams(gram)
    low = sliding_min(grams, window - gram + 1)
    owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    return grams, low, owner[:len(low)] == owner[window - 1:]


def paths(raw: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, end and bucket of every path; long ones, which only periodic text has, in pieces."""
    if len(raw) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    _, low, valid = _lowest(raw, offsets, window, gram)
    fresh = valid.copy()
    fresh[1:] &= ~valid[:-1] | (low[1:] != low[:-1])
    stop = valid.copy()
    stop[:-1] &= ~valid[1:] | fresh[1:]
    start, end = np.flatnonzero(fresh), np.flatnonzero(stop) + 1
    pieces = -(-(end - start) // PIECE)
    if pieces.max(initial=1) > 1:
        path = np.repeat(np.arange(len(start)), pieces)
        nth = np.arange(len(path)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start, end = start[path] + nth * PIECE, np.minimum(start[path] + (nth + 1) * PIECE, end[path])
    return start, end, low[start]


def repeats_inside(raw: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Starts of windows that are repeated inside one path: only where the bucket's gram comes twice in a row of windows."""
    if len(raw) < window:
        return np.zeros(0, np.int64)
    grams, low, valid = _lowest(raw, offsets, window, gram)
    width = window - gram + 1
    most = ~sliding_min(np.concatenate([np.full(width - 1, ~np.uint64(0)), ~np.where(valid, low, np.uint64(0)), np.full(width - 1, ~np.uint64(0))]), width)
    chosen = np.flatnonzero(grams == most)
    order = chosen[np.argsort(grams[chosen], kind="stable")]
    again = np.flatnonzero((grams[order[1:]] == grams[order[:-1]]) & (order[1:] - order[:-1] <= width))
    change = np.zeros(len(low) + 1, np.int64)
    np.add.at(change, np.clip(order[again] - width + 1, 0, len(low)), 1)
    np.add.at(change, np.clip(order[again + 1] + 1, 0, len(low)), -1)
    starts = np.flatnonzero((np.cumsum(change[:-1]) > 0) & valid)
    return starts[repeated_windows(raw, starts, K.owners(starts, offsets), window)]


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return K.text_bytes(column.cast(pa.large_binary()).fill_null(b"")) if pa.types.is_binary(column.type) else K.text_bytes(column)


def _path_rows(raw, offsets, ids, keys, base, window, gram):
    """Columns of the path table; ``base`` is the place of each text in its document. Also byte ranges of the paths."""
    start, end, bucket = paths(raw, offsets, window, gram)
    owner = K.owners(start, offsets)
    stop = start + window if gram == window else end + window - 1  # windows of one hash are one window, the path holds it once
    data = raw.tobytes()
    digest = b"".join([hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), stop.tolist())])
    d = np.frombuffer(digest, np.int64).reshape(-1, 2)
    rows = {"id": ids[owner], "tkey": keys[owner], "first": (start - offsets[owner] + base[owner]).astype(np.int32),
            "edges": (end - start).astype(np.int32), "bucket": K.signed(bucket), "d1": d[:, 0].copy(), "d2": d[:, 1].copy()}
    return rows, owner, data, start, stop


def _paths(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def work(batches):
        for part in K.slices(batches, "text"):
            raw, offsets = K.text_bytes(part.column("text"))
            ids, keys = part.column("id").to_numpy(), part.column("tkey").to_numpy()
            yield pa.RecordBatch.from_pydict(_path_rows(raw, offsets, ids, keys, np.zeros(len(ids), np.int64), window, gram)[0])

    return K.map_arrow(docs, work, PATH)


def _finer(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """The paths that longer grams make of the contents of hot buckets."""

    def work(batches):
        for part in K.slices(batches, "content"):
            raw, offsets = _bytes(part.column("content"))
            found, owner, data, start, stop = _path_rows(
                raw, offsets, part.column("id").to_numpy(), part.column("tkey").to_numpy(), part.column("first").to_numpy().astype(np.int64), window, gram)
            known = part.column("known").to_numpy(zero_copy_only=False)[owner] | ((found["edges"] > 1) if gram == window else False)
            yield pa.RecordBatch.from_pydict({**found, "known": pa.array(known, pa.bool_()),
                                              "content": pa.array([data[a:b] for a, b in zip(start.tolist(), stop.tolist())], pa.binary())})

    return K.map_arrow(rows, work, PATH + ", known boolean, content binary")


def _meet(found: DataFrame) -> DataFrame:
    """Paths whose bucket another path has too, with ``twice``: an equal one is next to it, and ``rep``: it is the first of those.

    Rows are dealt by ranges, so neither a common bucket nor a common path is gathered in a task. The first and the last row
    of a task stay, since their neighbours are not seen; equal paths of two tasks have a ``rep`` in each.
    """
    order = ["bucket", "d1", "d2", "id", "tkey", "first"]
    schema = ", ".join([", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema.fields), "twice boolean, rep boolean"])

    def meet(batches):
        held, state = None, (False, True)  # the last row, and whether it equals and shares its bucket with the one before
        for batch in batches:
            if not batch.num_rows:
                continue
            joined = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
            bucket, d1, d2 = (joined.column(c).to_numpy() for c in ("bucket", "d1", "d2"))
            shares = np.concatenate([[state[1]], bucket[1:] == bucket[:-1]])
            equal = np.concatenate([[state[0]], shares[1:] & (d1[1:] == d1[:-1]) & (d2[1:] == d2[:-1])])
            n = len(bucket) - 1
            out = joined.slice(0, n).filter(pa.array(shares[:-1] | shares[1:]))
            stay = shares[:-1] | shares[1:]
            yield pa.RecordBatch.from_arrays(
                [*out.columns, pa.array((equal[:-1] | equal[1:])[stay]), pa.array(~equal[:-1][stay])], names=[*out.schema.names, "twice", "rep"])
            held, state = joined.slice(n), (bool(equal[-1]), bool(shares[-1]))
        if held is not None:
            yield pa.RecordBatch.from_arrays([*held.columns, pa.array([state[0]]), pa.array([not state[0]])], names=[*held.schema.names, "twice", "rep"])

    return K.map_arrow(found.repartitionByRange(*order).sortWithinPartitions(*order), meet, schema)


def _judge(marked: DataFrame, window: int, block: int, content: bool) -> tuple[DataFrame, DataFrame]:
    """(ranges of paths with an equal one, one path of each kind in buckets with several kinds)."""
    key = ["bucket", "d1", "d2"]
    shown = ["id", "tkey", "first", "edges", *(["content"] if content else [])]
    reps = marked.where("rep")
    known = F.max(F.col("twice") | F.col("known")) if content else F.max("twice")
    kinds = reps.groupBy(*key).agg(F.min(F.struct(*shown)).alias("shown"), known.alias("known"), F.count(F.lit(1)).alias("tasks"))
    split = kinds.where("tasks > 1").select(*key)  # at most two kinds per task
    whole = marked.where("twice").select("id", "tkey", "first", "edges").unionByName(
        reps.where("not twice").join(split, key).select("id", "tkey", "first", "edges"))
    size = F.sum(F.col("shown.edges").cast("bigint") + window - 1)
    buckets = kinds.groupBy("bucket").agg(F.count(F.lit(1)).alias("kinds"), size.alias("size")).where("kinds > 1")
    several = kinds.join(buckets, "bucket").select(
        "shown.*", "bucket", (F.col("known") | (F.col("tasks") > 1)).alias("known"), (F.col("size") > block).alias("hot"))
    return whole, several


def _with_content(docs: DataFrame, places: DataFrame, window: int) -> DataFrame:
    def work(batches):
        for part in K.slices(batches, "text"):
            raw, offsets = K.text_bytes(part.column("text"))
            data = raw.tobytes()
            lists = part.column("places")
            owner = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            first, edges = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            begin = offsets[owner] + first
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(pa.array(owner)), part.column("tkey").take(pa.array(owner)), *[flat.field(i) for i in range(5)],
                 pa.array([data[a:b] for a, b in zip(begin.tolist(), (begin + edges + window - 1).tolist())], pa.binary())],
                names=["id", "tkey", "first", "edges", "bucket", "known", "hot", "content"])

    listed = places.groupBy("id", "tkey").agg(F.collect_list(F.struct("first", "edges", "bucket", "known", "hot")).alias("places"))
    return K.map_arrow(docs.join(listed, ["id", "tkey"]).select("id", "tkey", "text", "places"), work, PLACED)


def _sorted_ranges(rows: DataFrame, window: int, block: int) -> DataFrame:
    """Ranges of repeated windows of the paths of whole buckets, by suffix sorts of about ``block`` bytes."""

    def ranges(table: pa.Table):
        batch = table.combine_chunks().to_batches()[0]
        raw, offsets = _bytes(batch.column("content"))
        count = np.maximum(np.diff(offsets) - window + 1, 0)
        owner = np.repeat(np.arange(len(count)), count)
        begin = np.cumsum(count) - count
        nth = np.arange(len(owner)) - begin[owner]
        hit = repeated_windows(raw, offsets[owner] + nth, batch.column("bucket").to_numpy()[owner], window)
        hit &= ~batch.column("known").to_numpy(zero_copy_only=False)[owner]
        first, last = K.runs(hit, np.append(begin, len(owner)))
        path = owner[first]
        at = pa.array(path)
        return pa.RecordBatch.from_pydict({
            "id": batch.column("id").take(at), "tkey": batch.column("tkey").take(at),
            "first": (batch.column("first").to_numpy()[path] + nth[first]).astype(np.int32), "edges": (last - first).astype(np.int32)})

    def work(batches):
        held, size = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            size += batch.column("content").nbytes
            while size > block:
                bucket = held.column("bucket").to_numpy()
                edge = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
                if not len(edge):
                    break
                ends = np.cumsum(np.array([len(v) for chunk in held.column("content").chunks for v in chunk.to_pylist()]))
                cut = edge[max(0, int(np.searchsorted(ends[edge - 1], block, side="right")) - 1)]
                yield ranges(held.slice(0, int(cut)))
                held = held.slice(int(cut)).combine_chunks()
                size = held.column("content").nbytes
        if held is not None and held.num_rows:
            yield ranges(held)

    dealt = rows.select("id", "tkey", "first", "bucket", "known", "content").repartition("bucket").sortWithinPartitions("bucket")
    return K.map_arrow(dealt, work, RANGE)


def repeated_ranges(docs: DataFrame, window: int = WINDOW, grams: tuple[int, ...] = GRAMS, block: int = BLOCK) -> DataFrame:
    """(id, tkey, first, edges): stretches of consecutive windows that also start in another path.

    Windows repeated only inside one path may be missing here; ``suffix_dedup`` finds those text by text.
    """
    marked = cut_lineage(_meet(_paths(docs, window, grams[0])), "paths")
    whole, several = _judge(marked, window, block, content=False)
    found, todo = [whole], cut_lineage(_with_content(docs, several, window), "contents")
    for gram in grams[1:]:
        found.append(_sorted_ranges(todo.where("not hot"), window, block))
        hot = todo.where("hot")
        if hot.isEmpty():
            return reduce(DataFrame.unionByName, found)
        marked = cut_lineage(_meet(_finer(hot, window, gram)), "finer")
        whole, todo = _judge(marked, window, block, content=True)
        found.append(whole)
    return reduce(DataFrame.unionByName, [*found, _sorted_ranges(todo, window, block)])


def suffix_dedup(docs: DataFrame, *, window: int = WINDOW, grams: tuple[int, ...] = GRAMS, block: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and ``kept`` (the bytes left) for every row of ``docs``.

    A byte of the UTF-8 text goes when a string of ``window`` bytes that covers it also starts anywhere else, in another
    text or in the same one; every occurrence is judged on the input, so all copies go. Spans are the maximal runs of removed
    bytes. NULL and empty texts have no bytes and keep none; a text shorter than the window loses nothing. What is kept may not be
    valid UTF-8, so it is binary. Rows are told apart by id and 64 bits of hash over the text; rows equal in both are
    occurrences of their own all the same. Columns other than doc_id and text are ignored. ``grams`` must rise and end with
    ``window``.
    """
    if window < 8 or list(grams) != sorted(set(grams)) or grams[-1] != window:
        raise ValueError("gram lengths rise up to the window, which has 8 bytes or more")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumns({"id": F.coalesce("doc_id", F.lit(NO_ID)), "tkey": F.xxhash64("text")})
    ranges = repeated_ranges(docs.select("id", "tkey", "text"), window, grams, block)
    ranges = ranges.groupBy("id", "tkey").agg(F.collect_set(F.struct("first", "edges")).alias("ranges"))
    gram = grams[0]

    def cut(batches):
        for part in K.slices(batches, "text"):
            raw, offsets = K.text_bytes(part.column("text"))
            lists = part.column("ranges").fill_null([])
            owner = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            begin = offsets[owner] + flat.field(0).to_numpy()
            inside = repeats_inside(raw, offsets, window, gram)
            change = np.zeros(len(raw) + 1, np.int64)
            np.add.at(change, np.concatenate([inside, begin]), 1)
            np.add.at(change, np.concatenate([inside + window, begin + flat.field(1).to_numpy() + window - 1]), -1)
            gone = np.cumsum(change[:len(raw)]) > 0
            first, last = K.runs(gone, offsets)
            text = K.owners(first, offsets)
            removed = K.per_text(text, part.num_rows, (last - first).astype(float))
            ends = offsets[1:] - np.cumsum(removed)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed), pa.array(K.per_text(text, part.num_rows)),
                 pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(np.append(0, ends).astype(np.int64).tobytes()),
                                                                          pa.py_buffer(raw[~gone].tobytes())]).cast(pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return K.map_arrow(docs.join(ranges, ["id", "tkey"], "left").select("doc_id", "text", "ranges"), cut, RESULT)
