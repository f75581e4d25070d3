"""What a worker of the corpus pipeline is given at a time and what it holds."""

import os
import re

import pyarrow as pa

import corpus_pipeline
from stayloom.llm import bpe
from stayloom.llm.queries import TOKENIZER
from stayloom.operators.prepare import number_rows

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_a_stage_called_alone_sends_small_batches(spark, make, folder):
    docs = make([(i, f"alpha {i}", "en", "s", 7) for i in range(3)])
    for name, stage in corpus_pipeline.STAGES:
        session = spark.newSession()
        session.conf.set(LIMIT, "64m")
        rows = session.createDataFrame(docs.collect(), docs.schema)
        stage(session, rows, folder)
        assert session.conf.get(LIMIT) == "4m", name


def test_tables_are_made_once_for_the_tasks_of_a_worker(spark, make):
    def count(codec, batches):
        for batch in batches:
            codec.tasks = getattr(codec, "tasks", 0) + 1
            yield pa.RecordBatch.from_pydict({"n": [codec.tasks], "worker": [os.getpid()]})

    texts = make([(i, f"alpha {i}", "en", "s", 7) for i in range(128)]).repartition(32)
    rows = bpe._run(texts.select("doc_id", "text"), TOKENIZER, "n long, worker long", count).collect()
    assert len(rows) == 32 and sum(r.n == 1 for r in rows) == len({r.worker for r in rows}) < 32


def test_what_exact_merging_remembers_is_bounded_in_bytes():
    codec = bpe.Codec(bpe.read_tokenizer(TOKENIZER))
    for i in range(20):
        codec.merged(b"x%d" % i * (1 << 17))
    assert sum(map(len, codec.exact)) <= bpe.EXACT_BYTES + (1 << 20)


def test_the_trie_has_rows_for_forks_only():
    codec = bpe.Codec(bpe.read_tokenizer(TOKENIZER))
    assert codec.next.nbytes < codec.inner * 256 and 0 < codec.forks < codec.inner
    assert codec.next.shape == (codec.forks + 1, 256) and not codec.next[-1].any()


def test_numbered_rows_are_shuffled_and_written_once(spark, make):
    numbered = number_rows(make([(i % 3, f"text {i}", "en", "s", 6) for i in range(20)]), ["doc_id"], "place")
    assert not re.search(r"hashpartitioning|Window|SortMergeJoin", numbered._jdf.queryExecution().executedPlan().toString())
    assert sorted(r.place for r in numbered.collect()) == list(range(20)) == sorted(r.place for r in numbered.collect())
