"""Quality rules: exact surface counts, then an n-gram log-likelihood ratio of trusted target against raw corpus.

Texts are handled in blocks. A block sends each of its grams once, with the documents that have it, to the gram's cell; there
all blocks meet, the gram is counted and weighed, and one sum per document goes back. What crosses the network is packed:
grams in order are differences, and a pair of frequent units is two small numbers, any other gram a 64-bit hash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayloom.llm import textkit as K

SYMBOLS = K.byte_table(list(b"#*$%&|<>"))
PRIOR = 4.0
THRESHOLD = -0.25
CODED_UNITS = 1 << 17  # units that get a number
CODE_SAMPLE = 8  # of so many slices of text one is looked at for the numbers; they change no result
BLOCK_UNITS, BLOCK_TEXTS = 1 << 22, 1 << 17
CELL_GRAMS = 1 << 22
LANES = 32  # tasks that weigh at most; each sends one sum per document
HELD_SUMS = 1 << 24
TARGET_IDS = 1 << 23
RESULT = ("doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
          "base_failed boolean, llr double, kept boolean")


def surface_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """The exact counts of a slice of texts, one value per text."""
    words = K.Words(column)
    raw, n = words.raw, words.n_texts

    def total(flags: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return upto[words.offsets[1:]] - upto[words.offsets[:-1]]

    lines, ends = K.runs(raw != 10, words.offsets)
    upto = np.concatenate([[0], np.cumsum(words.mask, dtype=np.int64)])
    filled = upto[ends] > upto[lines]
    lines, ends = lines[filled], ends[filled]
    line_owner = K.owners(lines, words.offsets)
    key = K.mix(K.placed_hash(raw, lines, ends) + line_owner.astype(np.uint64) * np.uint64(K.SECOND_BASE))
    _, first = np.unique(key, return_index=True)
    again = np.ones(len(key), np.int64)
    again[first] = 0
    at, window = K.grams(words.hash, words.owner, 3)
    twice = K.repeated(K.mix(window + words.owner[at].astype(np.uint64) * np.uint64(K.SECOND_BASE)))
    in_repeat = K.covered(at[twice], 3, len(words.hash))
    return {"n_words": words.counts, "word_chars": total(words.mask & ((raw & 0xC0) != 0x80)), "n_symbols": total(SYMBOLS[raw]),
            "n_dup_lines": K.per_text(line_owner, n, again), "n_repeat_words": K.per_text(words.owner[in_repeat], n)}


def packed(values: np.ndarray) -> bytes:
    """Unsigned integers as planes of bytes, lowest first, each compressed on its own; few of them in one piece."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T)
    pieces = [pa.compress(part.tobytes(), codec="zstd", asbytes=True) for part in (planes if len(values) >= 4096 else planes[None]) if part.size]
    return np.array([len(values), width, *map(len, pieces)], np.uint32).tobytes() + b"".join(pieces)


def unpacked(data: bytes, at: int) -> tuple[np.ndarray, int]:
    """The integers packed from byte ``at`` on, and where they end."""
    n, width = np.frombuffer(data, np.uint32, 2, at).tolist()
    pieces = 0 if not width else width if n >= 4096 else 1
    lengths = np.frombuffer(data, np.uint32, pieces, at + 8).tolist()
    at += 8 + 4 * pieces
    out = np.zeros((n, 8), np.uint8)
    first = 0
    for length in lengths:
        wide = width // pieces
        plane = pa.decompress(memoryview(data)[at:at + length], decompressed_size=n * wide, codec="zstd", asbytes=True)
        out[:, first:first + wide] = np.frombuffer(plane, np.uint8).reshape(wide, n).T
        first, at = first + wide, at + length
    return out.view(np.uint64).reshape(-1), at


def starts_of(*ordered: np.ndarray) -> np.ndarray:
    """Where a new value begins in arrays that are in order together."""
    new = np.ones(len(ordered[0]), bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in ordered], axis=0)
    return np.flatnonzero(new)


def steps(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Differences to the value before, whole values at ``starts``."""
    out = np.diff(values, prepend=values[:1])
    out[starts] = values[starts]
    return out


def sums_from(steps: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """What ``steps`` was made of."""
    total = np.cumsum(steps)
    before = total[starts] - steps[starts]
    return total - np.repeat(before, np.diff(np.append(starts, len(steps))))


def pack_grams(cell: np.ndarray, gram: np.ndarray, text: np.ndarray, n: np.ndarray, cells: int) -> list[bytes]:
    """Per cell the distinct grams, in how many texts each is, those texts and how often it is there; all ordered by cell, gram, text."""
    out = []
    cuts = np.searchsorted(cell, np.arange(cells + 1))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        first = starts_of(gram[a:b]) if b > a else np.zeros(0, np.int64)
        key = gram[a:b][first]
        out.append(packed(steps(key, np.zeros(min(1, len(key)), np.int64))) + packed(np.diff(np.append(first, b - a)) - 1 if b > a else key)
                   + packed(steps(text[a:b], first)) + packed(n[a:b] - 1))
    return out


def unpack_grams(data: bytes, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(gram, texts with it, text, times) of one section, and where it ends."""
    key, at = unpacked(data, at)
    texts, at = unpacked(data, at)
    text, at = unpacked(data, at)
    n, at = unpacked(data, at)
    texts = texts.astype(np.int64) + 1
    first = np.cumsum(texts) - texts
    return np.cumsum(key), texts, sums_from(text, first).astype(np.int64), n.astype(np.int64) + 1, at


class GramCode:
    """Which cell a gram belongs to, and its number there.

    A unit of ``known`` is its place there; such units and pairs of them are numbered without loss. Any other gram is a hash. With
    ``buckets`` every gram is the number of its bucket.
    """

    def __init__(self, known: np.ndarray, cells: int, buckets: int | None):
        order = np.argsort(known)
        self.known, self.place, self.cells, self.buckets = known[order], order.astype(np.uint64), cells, buckets
        self.size = np.uint64(len(known))
        self.stride = np.uint64((len(known) * (len(known) + 1)) // cells + 1)

    def block(self, unit: np.ndarray, owner: np.ndarray, texts: int) -> list[bytes]:
        """What a block sends to each cell: its numbered grams, then its hashed ones."""
        cells = np.uint64(self.cells)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, unit), len(self.known) - 1)
            inside, place = self.known[at] == unit, self.place[at]
            del at
        else:
            inside, place = np.zeros(len(unit), bool), unit
        pair = np.flatnonzero(owner[1:] == owner[:-1])
        both = inside[pair] & inside[pair + 1]
        numbered, other = pair[both], pair[~both]
        del pair, both

        alone = int(inside.sum())
        code, text = np.empty(alone + len(numbered), np.uint64), np.empty(alone + len(numbered), np.uint32)
        code[:alone], text[:alone], text[alone:] = place[inside], owner[inside], owner[numbered]
        code[:alone] += self.size * self.size
        code[alone:] = place[numbered]
        code[alone:] *= self.size
        code[alone:] += place[numbered + 1]
        del place, numbered
        bits = np.uint64(max(texts - 1, 1).bit_length())
        code, cell = np.divmod(code, cells)
        cell *= self.stride
        code += cell
        del cell
        code <<= bits
        code |= text
        del text
        code.sort()
        first = starts_of(code)
        n, code = np.diff(np.append(first, len(code))), code[first]
        gram = code >> bits
        code &= (np.uint64(1) << bits) - np.uint64(1)
        low = pack_grams(*np.divmod(gram, self.stride), code, n, self.cells)
        del gram, code, n

        gram = np.concatenate([unit[~inside], K.mix(unit[other] + unit[other + 1] * np.uint64(K.GRAM_BASE))])
        if self.buckets is not None:
            gram = K.mix(gram % np.uint64(self.buckets))
        text = np.concatenate([owner[~inside], owner[other]]).astype(np.uint64)
        order = np.lexsort((text, gram))
        gram, text = gram[order], text[order]
        first = starts_of(gram, text)
        n, gram, text = np.diff(np.append(first, len(gram))), gram[first], text[first]
        high = pack_grams((gram >> np.uint64(32)) * cells >> np.uint64(32), gram, text, n, self.cells)
        return [a + b for a, b in zip(low, high)]


class Target:
    """Which documents of a batch are labelled good.

    Up to ``TARGET_IDS`` ids are sent to the texts, as packed differences. More of them meet the texts in a shuffled join.
    """

    def __init__(self, docs: DataFrame, labels: DataFrame):
        good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
        self.ids = self.sent = None
        if good.count() <= TARGET_IDS:
            ids = np.sort(good.toArrow().column("doc_id").to_numpy()).view(np.uint64)
            self.sent = packed(np.diff(ids, prepend=np.uint64(0)))
            self.docs = docs.withColumn("good", F.lit(None).cast("boolean"))
        else:
            self.docs = docs.join(good.withColumn("good", F.lit(True)), "doc_id", "left")

    def __getstate__(self) -> dict:
        return {"ids": None, "sent": self.sent}

    def __call__(self, part: pa.RecordBatch) -> np.ndarray:
        if self.sent is None:
            return part.column("good").is_valid().to_numpy(zero_copy_only=False)
        if self.ids is None:
            self.ids = np.cumsum(unpacked(self.sent, 0)[0]).view(np.int64)
        column = part.column("doc_id")
        if not len(self.ids):
            return np.zeros(len(column), bool)
        doc_id = column.fill_null(0).to_numpy()
        return column.is_valid().to_numpy(zero_copy_only=False) & (self.ids[np.minimum(np.searchsorted(self.ids, doc_id), len(self.ids) - 1)] == doc_id)


def corpus_sums(of: Target, coded_units: int) -> tuple[int, int, np.ndarray]:
    """Number of grams of all documents and of the good ones, and the most frequent units of a sample, most frequent first."""

    def work(batches):
        sample, total, target, seen = [], 0, 0, 0
        for part in K.slices(batches, "text"):
            owner, unit, _ = K.units(part.column("text"))
            units = K.per_text(owner, part.num_rows)
            n = units + np.maximum(units - 1, 0)
            total, target = total + int(n.sum()), target + int(n[of(part)].sum())
            if seen % CODE_SAMPLE == 0:
                sample.append(unit)
            seen += 1
        if seen:
            value, n = np.unique(np.concatenate(sample), return_counts=True)
            value, n = value[n > 1], n[n > 1]
            yield pa.RecordBatch.from_pydict({"unit": pa.array([None], pa.int64()), "n": pa.array([total], pa.int64()), "good": pa.array([target], pa.int64())})
            yield pa.RecordBatch.from_pydict({"unit": K.signed(value), "n": n, "good": np.zeros(len(n), np.int64)})

    rows = K.map_arrow(of.docs, work, "unit bigint, n bigint, good bigint").groupBy("unit").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    found = rows.orderBy(F.col("unit").isNotNull(), F.desc("n"), "unit").limit(1 + coded_units).toArrow().to_pydict()
    if not found["unit"]:
        return 0, 0, np.zeros(0, np.uint64)
    return found["n"][0], found["good"][0], np.array(found["unit"][1:], np.int64).view(np.uint64)


def gram_records(of: Target, code: GramCode, block_units: int) -> DataFrame:
    """What blocks send: per cell their packed grams, and once their documents with the surface counts.

    In a block the good documents come first, so ``target``, their number, tells which ones they are.
    """

    def block(number: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        docs = pa.Table.from_batches([x[0] for x in held]).combine_chunks()
        good = np.concatenate([x[1] for x in held])
        at = np.cumsum([0] + [len(x[1]) for x in held])
        order = np.argsort(~good, kind="stable")
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order))
        owner = np.concatenate([place[x[2] + a] for x, a in zip(held, at)])
        unit = np.concatenate([x[3] for x in held])
        held.clear()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(docs.take(pa.array(order)))
        part = TaskContext.get().partitionId()
        name, target = part << 32 | number, int(good.sum())

        def record(cell, grams, docs):
            return pa.RecordBatch.from_pydict({"cell": pa.array([cell], pa.int32()), "block": pa.array([name], pa.int64()), "texts": pa.array([len(order)], pa.int32()),
                                               "target": pa.array([target], pa.int32()), "grams": pa.array([grams], pa.binary()), "docs": pa.array([docs], pa.binary())})

        yield record((part + number) % code.cells, None, sink.getvalue().to_pybytes())
        if len(unit):
            for cell, grams in enumerate(code.block(unit, owner, len(order))):
                yield record(cell, grams, None)

    def work(batches):
        held, units, texts, number = [], 0, 0, 0
        for part in K.slices(batches, "text"):
            text = part.column("text")
            c = surface_counts(text)
            owner, unit, _ = K.units(text)
            own = K.per_text(owner, part.num_rows)
            docs = pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), **c, "grams": own + np.maximum(own - 1, 0)})
            held.append((docs, of(part), owner.astype(np.uint32), unit))
            units, texts = units + len(unit), texts + part.num_rows
            if units >= block_units or texts >= BLOCK_TEXTS:
                yield from block(number, held)
                units, texts, number = 0, 0, number + 1
        if held:
            yield from block(number, held)

    return K.map_arrow(of.docs, work, "cell int, block bigint, texts int, target int, grams binary, docs binary")


def quality_rules(docs: DataFrame, labels: DataFrame, *, buckets: int | None = None, prior: float = PRIOR,
                  threshold: float = THRESHOLD, block_units: int = BLOCK_UNITS, coded_units: int = CODED_UNITS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): exact counts, base rules, the mean log-likelihood ratio and the verdict.

    The target is every document labelled good, the raw corpus every document. A gram's weight is log((g + prior) / (e + prior)):
    g is its count in the target, e the count the raw rate lets expect there, so a rare gram stays near 0. With ``buckets``,
    grams share that many cells with add-one smoothing. ``llr`` is the mean weight over all unigrams and bigrams of the
    whole text, and a text is kept from ``threshold`` upward. NULL and empty text: all counts 0, llr 0, failed by the base
    rule. Rows with a NULL or repeated id are judged row by row. Without good labels every weight is 0, and the verdict falls back
    to the base rules. Other columns are ignored. ``block_units`` and ``coded_units`` change what is sent, not the result.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    target = Target(docs, labels)
    raw, good, known = corpus_sums(target, 0 if buckets is not None else coded_units)
    lanes = min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), LANES)
    code = GramCode(known, max(8 * lanes, raw // CELL_GRAMS + 1) | 1, buckets)

    def weight(n: np.ndarray, among_good: np.ndarray) -> np.ndarray:
        if not good:
            return np.zeros(len(n))
        if buckets is not None:
            return np.log((among_good + 1) / (good + buckets)) - np.log((n + 1) / (raw + buckets))
        return np.log((among_good + prior) / (n * (good / raw) + prior))

    def add_cell(records: list[tuple[int, int, int, bytes]], sums: dict[int, np.ndarray]) -> None:
        """To each document the weights of its grams in one cell; unpacked twice, so that only distinct grams of all blocks are held."""
        at = [0] * len(records)
        for _ in range(2):
            begin, parts = list(at), []
            for i, (_, _, n_good, data) in enumerate(records):
                key, texts, text, n, at[i] = unpack_grams(data, at[i])
                first = np.cumsum(texts) - texts
                parts.append((key, *(np.add.reduceat(x, first) if len(first) else x for x in (n, n * (text < n_good)))))
            key, total, among_good = (np.concatenate(x) for x in zip(*parts))
            _, gram = np.unique(key, return_inverse=True)
            each = weight(np.bincount(gram, weights=total), np.bincount(gram, weights=among_good))[gram]
            done = 0
            for i, (block, size, _, data) in enumerate(records):
                _, texts, text, n, _ = unpack_grams(data, begin[i])
                value = np.repeat(each[done:done + len(texts)], texts) * n
                sums[block] = sums.get(block, 0.0) + np.bincount(text, weights=value, minlength=size)
                done += len(texts)

    def weigh(batches):
        """The sums of all blocks over the cells of this task, and the documents as they came."""
        records, sums, cell = [], {}, None

        def out():
            for block, values in sums.items():
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "sums": pa.array([values.tobytes()], pa.binary()), "docs": pa.array([None], pa.binary())})
            sums.clear()

        for batch in batches:
            for row in batch.to_pylist():
                if row["docs"] is not None:
                    yield pa.RecordBatch.from_pydict({"block": pa.array([row["block"]], pa.int64()), "sums": pa.array([None], pa.binary()), "docs": pa.array([row["docs"]], pa.binary())})
                    continue
                if row["cell"] != cell and records:
                    add_cell(records, sums)
                    records = []
                    if sum(map(len, sums.values())) > HELD_SUMS:
                        yield from out()
                cell = row["cell"]
                records.append((row["block"], row["texts"], row["target"], row["grams"]))
        if records:
            add_cell(records, sums)
        yield from out()

    def judged(docs: bytes, total: np.ndarray | float) -> pa.RecordBatch:
        docs = pa.ipc.open_stream(docs).read_all().combine_chunks()
        n_words, repeated, grams = (docs.column(c).to_numpy() for c in ("n_words", "n_repeat_words", "grams"))
        failed = (n_words < 50) | (100 * repeated > 50 * n_words)
        llr = total / np.maximum(grams, 1) + np.zeros(len(grams))
        counts = {c: docs.column(c) for c in docs.column_names if c != "grams"}
        return pa.Table.from_pydict({**counts, "base_failed": failed, "llr": llr, "kept": ~failed & (llr >= threshold)}).combine_chunks().to_batches()[0]

    def judge(batches):
        block, total, held = None, 0.0, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != block and held is not None:
                    yield judged(held, total)
                    total, held = 0.0, None
                block = row["block"]
                if row["docs"] is not None:
                    held = row["docs"]
                else:
                    total = total + np.frombuffer(row["sums"])
        if held is not None:
            yield judged(held, total)

    records = gram_records(target, code, block_units).repartition(lanes, "cell").sortWithinPartitions("cell")
    sums = K.map_arrow(records, weigh, "block bigint, sums binary, docs binary")
    return K.map_arrow(sums.repartition("block").sortWithinPartitions("block"), judge, RESULT)
