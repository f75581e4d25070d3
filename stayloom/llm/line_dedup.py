"""Line dedup by line windows: every window of adjacent lines that an earlier text has too, or the same text before, goes.

A run of two or more lines is repeated exactly where all its pairs of adjacent lines are, and a pair is itself such a run; so
the pairs, keyed at every place of a text, find every repeated run whatever stands around it. Keys are SHA-256 digests of the
lines' bytes. One aggregation per key finds its first text, a join brings the repeated places back to their texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayloom.llm import textkit as K

MIN_LINES = 2
NO_ID = -(1 << 63)


class Lines:
    """The non-empty lines of a slice of texts and the windows of ``width`` adjacent ones: text, first line, key, first place."""

    def __init__(self, column: pa.Array, width: int):
        raw, self.offsets = K.text_bytes(column)
        self.starts, self.ends = K.runs(raw != 10, self.offsets)
        self.owner = K.owners(self.starts, self.offsets)
        self.counts = K.per_text(self.owner, len(column))
        self.data = raw.tobytes()
        n = len(self.starts)
        self.at = np.flatnonzero(self.owner[:n - width + 1] == self.owner[width - 1:]) if n >= width else np.zeros(0, np.int64)
        digest = [hashlib.sha256(self.data[a:b]).digest() for a, b in zip(self.starts.tolist(), self.ends.tolist())]
        self.keys = [hashlib.sha256(b"".join(digest[i:i + width])).digest() for i in self.at.tolist()]
        first: dict[tuple[int, bytes], int] = {}
        self.first = np.array([first.setdefault(k, i) for i, k in zip(self.at.tolist(), zip(self.owner[self.at].tolist(), self.keys))], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.counts)])


def _window_rows(texts: DataFrame, width: int) -> DataFrame:
    """One row per text and different window: the text's id and digest, the window's key and its first line in the text."""

    def work(batches):
        for part in K.slices(batches, "text"):
            lines = Lines(part.column("text"), width)
            one = np.flatnonzero(lines.first == lines.at)
            owner = lines.owner[lines.at[one]]
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id").to_numpy()[owner], "digest": part.column("digest").take(pa.array(owner)),
                "key": pa.array([lines.keys[i] for i in one.tolist()], pa.binary()),
                "at": (lines.at[one] - lines.begin[owner]).astype(np.int32)})

    return K.map_arrow(texts.select("doc_id", "digest", "text"), work, "doc_id bigint, digest binary, key binary, at int")


def line_dedup(docs: DataFrame, *, min_lines: int = MIN_LINES) -> DataFrame:
    """Every row of ``docs`` as struct ``doc``, with n_lines, n_removed (lines) and ``cleaned`` (the text that is left).

    A line goes when a window of ``min_lines`` adjacent non-empty lines that covers it is also in an earlier text, or starts at
    least ``min_lines`` lines before in the same text; so the union of all repeated runs of that many lines and more goes,
    and the first occurrence of every line stays. A removed line takes the line breaks up to the next line with it. Lines
    are split at line feeds only; empty lines are no lines, so they neither part nor tell apart windows. NULL text stays NULL,
    empty text empty. Texts are in order of id (NULL first), then of the SHA-256 of the text; of equal texts with one id, one
    is the first and the others are later. Packing the row into ``doc`` keeps any other column, whatever its name.
    """
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc_id")
    text = F.col("text").cast("string")
    digest = F.unhex(F.sha2(text, 256)).alias("digest")
    row = F.struct("doc_id", "digest")
    windows = _window_rows(docs.select(key, digest, text.alias("text")), min_lines)
    groups = windows.groupBy("key").agg(F.min(row).alias("first"), F.max(row).alias("last"))
    shared = groups.where("first < last").select("key", "first")
    marked = windows.join(shared, "key").where(row > F.col("first")).groupBy("doc_id", "digest").agg(F.collect_set("at").alias("gone"))
    others = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]))).alias("others")
    copy = F.row_number().over(Window.partitionBy("doc_id", "digest").orderBy("others")) - 1
    rows = docs.select(key, digest, others, K.pack(docs)).withColumn("copy", copy)

    def cut(batches):
        for part in K.slices(batches, "doc.text"):
            text = K.field(part, "doc.text").cast(pa.string())
            lines = Lines(text, min_lines)
            gone = part.column("gone").fill_null([])
            owner = np.repeat(np.arange(part.num_rows), np.diff(gone.offsets.to_numpy()))
            marks = np.zeros(len(lines.starts), bool)
            marks[lines.begin[owner] + gone.flatten().to_numpy()] = True
            again = part.column("copy").to_numpy()[lines.owner[lines.at]] > 0
            hit = lines.at[marks[lines.first] | again | (lines.at >= lines.first + min_lines)]
            drop = K.covered(hit, min_lines, len(lines.starts))
            removed = K.per_text(lines.owner[drop], part.num_rows)
            cleaned = text.to_pylist()
            for i in np.flatnonzero(removed).tolist():
                lo, hi, b = int(lines.begin[i]), int(lines.begin[i + 1]), int(lines.offsets[i + 1])
                after = [*lines.starts[lo + 1:hi].tolist(), b]
                pieces, at = [], int(lines.offsets[i])
                for j in np.flatnonzero(drop[lo:hi]).tolist():
                    pieces.append(lines.data[at:lines.starts[lo + j]])
                    at = after[j]
                cleaned[i] = (b"".join(pieces) + lines.data[at:b]).decode()
            yield pa.RecordBatch.from_arrays(
                [part.column("doc"), pa.array(lines.counts), pa.array(removed), pa.array(cleaned, pa.string())],
                schema=pa.schema([part.schema.field("doc"), ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("cleaned", pa.string())]))

    joined = rows.join(marked, ["doc_id", "digest"], "left").select("doc", "copy", "gone")
    schema = T.StructType([joined.schema["doc"], *T.StructType.fromDDL("n_lines bigint, n_removed bigint, cleaned string").fields])
    return K.map_arrow(joined, cut, schema)
