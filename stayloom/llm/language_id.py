"""Language identification: blended-spectrum presence kernels, Nystroem landmarks, one-versus-rest kernel ridge regression.

A text is cut into pieces of 1024 bytes. Two pieces are as similar as the share of hashed 1- to 3-grams present in both; the
similarities of all pieces to all landmarks are one matrix product. Ridge regression on the Nystroem features of the
landmarks gives one weight column per language, and a text's decision is the mean over its pieces by length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stayloom.llm import textkit as K

PIECE, GRAMS, CELLS = 1024, (1, 2, 3), 4096
LANDMARKS_PER_LANGUAGE, ROWS_PER_LANGUAGE = 32, 1200
RIDGE, SHARPNESS = 1e-3, 4.0
UNKNOWN = "und"
# Bytes as kernels see them: letters lower-cased, bytes of other scripts as they are, all else one space.
FOLD = np.where(K.ALNUM[K.UPPER] & ~K.byte_table(range(0x30, 0x3A)), K.UPPER, 0x20).astype(np.uint8)
LETTERS = K.byte_table([*range(0x41, 0x5B), *range(0x61, 0x7B)])


def presence(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, weight, unit-length presence vector) of each piece of each text."""
    raw, offsets = K.text_bytes(column)
    size = np.diff(offsets)
    raw = FOLD[raw]
    pieces = -(-size // PIECE)
    base = np.cumsum(pieces) - pieces
    owner = np.repeat(np.arange(len(size)), size)
    piece = base[owner] + (np.arange(len(raw)) - offsets[owner]) // PIECE
    matrix = np.zeros((int(pieces.sum()), CELLS), np.float32)
    code = raw.astype(np.uint64)
    for n in GRAMS:
        if n > 1:
            code = code[:-1] * np.uint64(257) + raw[n - 1:]
        valid = owner[:len(owner) - n + 1] == owner[n - 1:] if len(owner) >= n else np.zeros(0, bool)
        cell = (K.mix(code[valid] * np.uint64(4) + np.uint64(n)) % np.uint64(CELLS)).astype(np.int64)
        matrix[piece[:len(valid)][valid], cell] = 1
    matrix /= np.sqrt(np.maximum(matrix.sum(1, keepdims=True), 1))
    return np.repeat(np.arange(len(size)), pieces), np.bincount(piece, minlength=len(matrix)).astype(float), matrix


def similarities(column: pa.Array, landmarks: np.ndarray) -> np.ndarray:
    """Mean kernel value of each text with each landmark."""
    owner, weight, matrix = presence(column)
    kernel = (matrix @ landmarks.T) * weight[:, None]
    out = np.zeros((len(column), len(landmarks)))
    np.add.at(out, owner, kernel)
    return out / np.maximum(np.bincount(owner, weights=weight, minlength=len(column)), 1)[:, None]


def _texts(docs: DataFrame, *more) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def fit(docs: DataFrame, rows: int = ROWS_PER_LANGUAGE, landmarks: int = LANDMARKS_PER_LANGUAGE):
    """(languages, landmark vectors, weights), or None without a labelled text.

    Per language about ``rows`` documents are drawn by hash among those whose crc32 modulo 4 is not 2, and the first ``landmarks``
    of them in hash order give a landmark each (the middle piece of the text). Both bounds make the fit independent of the
    corpus size; the counts that set the sampling rate are over all rows.
    """
    known = _texts(docs, F.col("lang").cast("string").alias("lang")).where("lang is not null and length(text) > 0").where(K.bucket_of(F.col("doc_id"), 4) != 2)
    known = known.withColumn("order", F.xxhash64("doc_id", F.lit(17)))
    rates = {r.lang: rows / r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not rates:
        return None
    draw = F.pmod("order", F.lit(1 << 20)) / float(1 << 20)
    rate = F.create_map(*[F.lit(x) for pair in rates.items() for x in pair])
    sample = known.where(draw < rate[F.col("lang")])
    first = sample.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("order", "doc_id"))).where(F.col("n") <= landmarks)
    chosen = [r.text.encode() for r in first.orderBy("lang", "n").select("text").collect()]
    pieces = [t[max(0, len(t) // 2 - PIECE // 2):][:PIECE].decode("utf-8", "ignore") for t in chosen]
    vectors = presence(pa.array(pieces, pa.string()))[2]

    def kernels(batches):
        for part in K.slices(batches, "text"):
            x = similarities(part.column("text"), vectors)
            yield pa.RecordBatch.from_pydict({"lang": part.column("lang"), "x": pa.array(list(x), pa.list_(pa.float64()))})

    taken = K.map_arrow(sample.select("text", "lang"), kernels, "lang string, x array<double>").toPandas().sort_values("lang")
    languages = sorted(rates)
    x = np.array(taken["x"].tolist())
    values, basis = np.linalg.eigh((vectors @ vectors.T).astype(float))
    solid = values > 1e-6 * values[-1]
    lift = basis[:, solid] / np.sqrt(values[solid])
    feature = np.column_stack([x @ lift, np.ones(len(x))])
    target = np.array([[1.0 if a == b else -1.0 for b in languages] for a in taken["lang"]])
    balance = 1 / np.sqrt(taken.groupby("lang")["lang"].transform("size").to_numpy(float))[:, None]
    feature, target = feature * balance, target * balance
    weight = np.linalg.solve(feature.T @ feature + RIDGE * np.eye(feature.shape[1]), feature.T @ target)
    return languages, vectors, np.vstack([lift @ weight[:-1], weight[-1:]])


def language_id(docs: DataFrame, rows: int = ROWS_PER_LANGUAGE, landmarks: int = LANDMARKS_PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred and score (0 to 1) for every row of ``docs`` (doc_id, text, lang).

    Only the whole text is an input of a prediction. NULL texts and texts without a letter are ``und`` with score 0, as is every
    text when nothing is labelled. Ties go to the language first in order. Rows with a NULL or repeated id are judged one by
    one; other columns are ignored.
    """
    model = fit(docs, rows, landmarks)

    def predict(batches):
        for part in K.slices(batches, "text"):
            text = part.column("text")
            raw, offsets = K.text_bytes(text)
            seen = np.concatenate([[0], np.cumsum(LETTERS[raw])])
            lettered = seen[offsets[1:]] > seen[offsets[:-1]]
            for i in np.flatnonzero(~lettered & (np.diff(offsets) > 0)).tolist():
                lettered[i] = any(c.isalpha() for c in text[i].as_py())
            if model is None:
                names, score = np.full(len(text), UNKNOWN, object), np.zeros(len(text))
            else:
                languages, vectors, weight = model
                decision = similarities(text, vectors) @ weight[:-1] + weight[-1]
                power = np.exp(SHARPNESS * (decision - decision.max(1, keepdims=True)))
                names = np.where(lettered, np.array(languages, object)[decision.argmax(1)], UNKNOWN)
                score = np.where(lettered, 1 / power.sum(1), 0.0)
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "held_out": part.column("held_out"),
                                              "lang_pred": pa.array(names.tolist(), pa.string()), "score": score})

    texts = _texts(docs, (K.bucket_of(F.col("doc_id"), 4) == 2).alias("held_out"))
    return K.map_arrow(texts, predict, "doc_id bigint, held_out boolean, lang_pred string, score double")
