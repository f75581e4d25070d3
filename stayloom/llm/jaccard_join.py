"""N-gram Jaccard join by parity sketches.

The shingles of a document are dealt by hash into parts; each part is the XOR of its shingles' hashes, so a shingle that only
one of two documents has changes one part. The number of differing parts, like the Hamming distance of the parity bits, is
a lower bound of the symmetric difference. Two sets of a and b shingles with Jaccard similarity t differ in at most
(1 - t)(a + b) / (1 + t) places, never more than (1 / t - 1) a; so of a document's first d + 1 filled parts, in an order that all
documents share, one is equal in its partner. Parts are dealt per size band; a document that can have partners beyond its
band shows parts there too. Candidates are compared in full.

In bands of up to 64 shingles every shingle has a part of its own, so d + 1 parts are always filled. Above, 0.4 parts per
shingle of the band's upper size leave fewer than d + 1 filled parts with a probability below 1e-12 per document.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayloom.llm import textkit as K
from stayloom.llm.components import components
from stayloom.session import cut_lineage

SHINGLE = 5
PERCENT = 80
PARTS = 0.4
SMALL_BAND, WIDE = 6, 40
SLOTS = 1 << 20
SKETCH = 8
BROADCAST_IDS = 500_000


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the distinct shingles of each text, in order; a text of fewer words has its whole sequence."""
    words = K.Words(column, lower=True)
    n = words.n_texts
    at, value = K.grams(words.hash, words.owner, size)
    owner = words.owner[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):
        firsts = np.concatenate([[0], np.cumsum(words.counts)])
        whole = K.Rolling(words.hash, K.SECOND_BASE).ranges(firsts[short], firsts[short + 1])
        owner, value = np.concatenate([owner, short]), np.concatenate([value, whole])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    owner, value = owner[new], value[new]
    return value, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])


def _sum_rows(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, 128 bits that are equal for equal sets, and parity sketches of the set.

    ``s0``.. hold 512 parity bits. Sets of more than 512 shingles also have ``wide``, with a bit per shingle of their size band;
    bit places are low bits of one hash, so a longer sketch folds onto a shorter one.
    """
    bits = 64 * SKETCH

    def work(batches):
        for part in K.slices(batches, "text"):
            value, offsets = shingle_sets(part.column("text"), shingle)
            n = part.num_rows
            owner = np.repeat(np.arange(n), np.diff(offsets))
            place = K.mix(value ^ np.uint64(K.SECOND_BASE))
            spot = (place & np.uint64(bits - 1)).astype(np.int64)
            parity = (np.bincount(owner * bits + spot, minlength=n * bits) & 1).astype(np.uint8).reshape(n, bits)
            sketch = np.packbits(parity, axis=1).view(np.int64).reshape(n, SKETCH)
            wide: list[np.ndarray | None] = [None] * n
            for i in np.flatnonzero(np.diff(offsets) > bits).tolist():
                span = 1 << (int(offsets[i + 1] - offsets[i]) - 1).bit_length()
                flips = np.bincount((place[offsets[i]:offsets[i + 1]] & np.uint64(span - 1)).astype(np.int64), minlength=span) & 1
                wide[i] = np.packbits(flips.astype(np.uint8)).view(np.int64)
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id"), "n_shingles": np.diff(offsets), "wide": pa.array(wide, pa.list_(pa.int64())),
                "f1": K.signed(_sum_rows(K.mix(value), offsets)), "f2": K.signed(_sum_rows(K.mix(value ^ np.uint64(K.BYTE_BASE)), offsets)),
                **{f"s{i}": np.ascontiguousarray(sketch[:, i]) for i in range(SKETCH)}})

    schema = "doc_id bigint, n_shingles bigint, wide array<bigint>, f1 bigint, f2 bigint, " + ", ".join(f"s{i} bigint" for i in range(SKETCH))
    return K.map_arrow(docs, work, schema)


def frequent_slots(docs: DataFrame, shingle: int = SHINGLE) -> np.ndarray:
    """Flags of the hash slots whose shingles are in very many documents, from counts over all documents.

    They only decide which parts a document shows first, so that boilerplate does not become a meeting place.
    """

    def count(batches):
        seen, n = np.zeros(SLOTS, np.int64), 0
        for part in K.slices(batches, "text"):
            value, _ = shingle_sets(part.column("text"), shingle)
            seen += np.bincount((value >> np.uint64(44)).astype(np.int64), minlength=SLOTS)
            n += part.num_rows
        high = np.flatnonzero(seen > 12 + n / 400 + 4 * seen.mean())
        yield pa.RecordBatch.from_pydict({"slot": high.astype(np.int32), "n": seen[high]})

    rows = K.map_arrow(docs, count, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).where("n > 40").select("slot").toPandas()
    flags = np.zeros(SLOTS, bool)
    flags[rows["slot"].to_numpy(np.int64)] = True
    return flags


def part_keys(value: np.ndarray, offsets: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, key): the parts that each text shows, in its own size band and, where a partner may lie there, in the next."""
    size = np.diff(offsets)
    texts, keys = [], []
    level = np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64)  # band of a set: size in (2**(level-1), 2**level]
    beyond = (size > 0) & (size * 100 // percent > (1 << level))
    own = np.repeat(np.arange(len(size)), size)
    common = frequent[(value >> np.uint64(44)).astype(np.int64)]
    for step in (0, 1):
        use = (size > 0) if step == 0 else beyond
        if not use.any():
            continue
        band = level + step
        parts = np.where(band <= SMALL_BAND, 1 << WIDE, np.ceil(PARTS * (1 << band)).astype(np.int64))
        some = use[own]
        who, v, rare = own[some], value[some], ~common[some]
        spot = (K.mix(v + np.uint64(K.SECOND_BASE)) % parts[who].astype(np.uint64)).astype(np.int64)
        cell = (who << WIDE) + spot
        order = np.argsort(cell, kind="stable")
        begin = np.flatnonzero(np.concatenate([[True], np.diff(cell[order]) != 0]))
        xor = np.bitwise_xor.reduceat(v[order], begin)
        has_rare = np.maximum.reduceat(rare[order].astype(np.int8), begin)
        who, spot = who[order][begin], spot[order][begin]
        ranked = np.lexsort((spot, -has_rare, who))
        who, spot, xor = who[ranked], spot[ranked], xor[ranked]
        first = np.searchsorted(who, np.arange(len(size)))
        allowed = size * (100 - percent) // percent + 1
        shown = np.arange(len(who)) - first[who] < allowed[who]
        who, spot, xor = who[shown], spot[shown], xor[shown]
        texts.append(who)
        keys.append(K.mix(xor + K.mix(spot.astype(np.uint64) * np.uint64(64) + band[who].astype(np.uint64))))
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(texts), np.concatenate(keys)


def meeting_rows(docs: DataFrame, frequent: np.ndarray, shingle: int, percent: int) -> DataFrame:
    """(key, doc_id): documents that show a part another one shows too."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(frequent))

    def show(batches):
        flags = np.unpackbits(shared.value).astype(bool)
        for part in K.slices(batches, "text"):
            text, key = part_keys(*shingle_sets(part.column("text"), shingle), flags, percent)
            yield pa.RecordBatch.from_pydict({"key": K.signed(key), "doc_id": part.column("doc_id").to_numpy()[text]})

    return K.with_partner(K.map_arrow(docs, show, "key bigint, doc_id bigint"), "key", "doc_id")


def only(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The documents whose ids are in ``wanted``; a list of at most BROADCAST_IDS ids is broadcast, a longer one is shuffled."""
    wanted = cut_lineage(wanted.distinct(), "wanted")
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    return docs.join(wanted, "doc_id", "left_semi")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, set size and sorted shingle hashes."""

    def work(batches):
        for part in K.slices(batches, "text"):
            value, offsets = shingle_sets(part.column("text"), shingle)
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id"), "n": np.diff(offsets).astype(np.int32),
                "grams": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(K.signed(value)))})

    return K.map_arrow(docs, work, "doc_id bigint, n int, grams array<bigint>")


def _may_link(a: str, b: str, percent: int):
    """The bound of the sketches: Hamming distance <= (100 - t) (a + b) / (100 + t), and sizes within the ratio t."""
    na, nb = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    distance = sum((F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(SKETCH)), F.lit(0))
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (distance * (100 + percent) <= (100 - percent) * (na + nb))


def _wide_distance(x: str, y: str):
    """Hamming distance of two wide sketches, the longer folded onto the shorter; NULL where a set has none."""

    def fold(a, b):
        half = F.size(b)
        halves = F.zip_with(F.slice(a, 1, half), F.slice(a, half + 1, half), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(a) > half, halves).otherwise(a)

    a, b = F.col(x), F.col(y)
    bits = F.zip_with(fold(a, b), fold(b, a), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.aggregate(bits, F.lit(0), lambda total, n: total + n)


def sketch_allows(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose wide sketches, where both have one, keep the bound too."""
    wide = sketches.where("wide is not null").select("doc_id", "n_shingles", "wide")
    both = pairs.join(wide.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("wide").alias("wa")), "a", "left").join(
        wide.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("wide").alias("wb")), "b", "left")
    near = _wide_distance("wa", "wb") * (100 + percent) <= (100 - percent) * (F.col("na") + F.col("nb"))
    return both.where(F.col("wa").isNull() | F.col("wb").isNull() | near).select("a", "b")


def verified(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets really have the similarity, compared in full."""
    pairs = cut_lineage(pairs, "pairs")
    sets = _sets(only(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))), shingle)
    both = pairs.alias("p").join(sets.alias("x"), F.col("p.a") == F.col("x.doc_id")).join(sets.alias("y"), F.col("p.b") == F.col("y.doc_id"))
    common = F.size(F.array_intersect("x.grams", "y.grams"))
    found = both.select("p.a", "p.b", (F.col("x.n") + F.col("y.n")).alias("total"), common.alias("common")).where(
        100 * F.col("common") >= percent * (F.col("total") - F.col("common")))
    return cut_lineage(found.select("a", "b"), "links")


def jaccard_groups(docs: DataFrame, *, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) for every row of ``docs`` (doc_id, text).

    Two documents link when 100 * intersection >= ``percent`` * union of their distinct ``shingle``-word sets (A-Z
    lower-cased). Documents with equal sets collapse to one first. In each meeting place all documents are compared with one
    pivot; only those that are still in different components afterwards are paired, after the sketches of both allow it,
    so no link between components is lost and no group is expanded into all its pairs. NULL, empty and wordless texts have
    0 shingles and are their own component. Rows that share an id are one node with the links of each of them; a row without
    an id has a NULL component and links nothing. Repeated rows stay repeated. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = cut_lineage(fingerprints(docs, shingle), "prints")
    same = ["f1", "f2", "n_shingles"]
    reps = prints.where("n_shingles > 0 and doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("rep"))
    sketches = prints.where("doc_id is not null").drop("f1", "f2")
    light = sketches.drop("wide")
    meetings = meeting_rows(docs.where("doc_id is not null"), frequent_slots(docs, shingle), shingle, percent)
    meetings = cut_lineage(meetings.join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"), "meetings")
    pivots = meetings.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).where("pivot < last")
    at = meetings.join(pivots.select("key", "pivot", "n"), "key")
    stars = at.where("doc_id <> pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct()
    stars = stars.join(light.alias("x"), F.col("a") == F.col("x.doc_id")).join(light.alias("y"), F.col("b") == F.col("y.doc_id"))
    links = verified(sketch_allows(stars.where(_may_link("x", "y", percent)).select("a", "b"), sketches, percent), docs, shingle, percent)
    at = at.where("n > 2").join(components(links), F.col("doc_id") == F.col("node"), "left").select(
        "key", "doc_id", "pivot", F.coalesce("component", "doc_id").alias("component"))
    mixed = at.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    rows = at.where("doc_id <> pivot").join(mixed, "key").join(light, "doc_id")
    rest = rows.alias("x").join(rows.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.component") < F.col("y.component"))
                                & _may_link("x", "y", percent))
    rest = rest.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()
    more = verified(sketch_allows(rest, sketches, percent), docs, shingle, percent)
    owned = prints.join(reps, same, "left").select("doc_id", "n_shingles", "rep")
    several = owned.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high").select("doc_id", "low")
    joined = owned.join(several, "doc_id").select(F.col("rep").alias("a"), F.col("low").alias("b"))
    labels = components(links.unionByName(more).unionByName(joined))
    return owned.join(labels, F.col("rep") == F.col("node"), "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))
