"""Strings of two bytes in the Thue-Morse order from opposite starts, which every polynomial hash modulo 2**64 takes for equal."""

import numpy as np
import plain
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stayloom.llm import decontaminate, jaccard_join, quality_rules, substring_dedup
from stayloom.llm import textkit as K

ORDER = [bin(i).count("1") & 1 for i in range(4096)]
A, B = ("".join("ab"[x ^ flip] for x in ORDER) for flip in (0, 1))


@pytest.fixture(scope="module")
def pair(make):
    return make([(1, A, "en", "s", 0), (2, B, "en", "s", 0)])


def test_words_differ():
    words = K.Words(pa.array([f"{A} {B} {A}"]))
    assert len(set(words.hash.tolist())) == 2 and len(set(words.second_hash().tolist())) == 2
    assert not set(words.hash.tolist()) & set(words.second_hash().tolist())
    raw = np.frombuffer(b"xyxyz" * 40, np.uint8)
    one, two = K.placed_hash(raw, np.array([0, 5, 1]), np.array([3, 8, 4])), K.placed_hash(raw, np.array([0]), np.array([150]))
    assert one[0] == one[1] != one[2] and two[0] not in one


def test_lines(make):
    docs = make([(1, f"{A}\n{B}\n{A}", "en", "s", 0)])
    row = quality_rules.quality_rules(docs, make([(1, 1, 0)], "doc_id bigint, quality int, toxic int")).first()
    assert row.n_dup_lines == 1


def test_items(make):
    common = " ".join(f"w{i}" for i in range(9))
    found = decontaminate.decontaminate(make([(1, f"{common} {A}", "en", "s", 0), (2, f"{common} {B}", "en", "s", 0)]).select("doc_id", "text"),
                                        make([("i", f"{common} {A}")], "item_id string, text string"))
    assert {r.doc_id: r.n_hit for r in found.select("doc_id", F.col("found.n_hit").alias("n_hit")).collect()} == {1: 10, 2: 0}


def test_passages(make):
    words = [f"w{i}" for i in range(34)]
    docs = [(1, " ".join([*words[:17], A, *words[17:]])), (2, " ".join([*words[:17], B, *words[17:]]))]
    got = substring_dedup.substring_dedup(make([(*d, "en", "s", 0) for d in docs])).collect()
    assert sorted(tuple(r) for r in got) == sorted(plain.repeats(docs))


def test_sets(pair):
    assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_groups(pair).collect()} == {1: 1, 2: 2}
