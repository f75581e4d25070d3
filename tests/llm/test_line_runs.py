"""op7: every repeated run of two or more lines, whole copies, and rows without an id or with one id."""

import hashlib
import random

import corpus_pipeline
import pytest
from stayloom.llm import line_dedup


def brute(rows, width=2):
    """(doc_id, cleaned lines) by listing, for every run of lines, whether an earlier text or an earlier place has it."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, hashlib.sha256(rows[i][1].encode()).digest()))
    before, out = set(), [None] * len(rows)
    for i in order:
        lines = [x for x in rows[i][1].split("\n") if x]
        runs = [(a, b) for a in range(len(lines)) for b in range(a + width, len(lines) + 1)]
        gone = set()
        for a, b in runs:
            run = tuple(lines[a:b])
            if run in before or any(tuple(lines[j:j + b - a]) == run for j in range(a - (b - a) + 1)):
                gone |= set(range(a, b))
        before |= {tuple(lines[a:b]) for a, b in runs}
        out[i] = (rows[i][0], [x for j, x in enumerate(lines) if j not in gone])
    return sorted(out, key=repr)


def cleaned(docs):
    return sorted(((r.doc.doc_id, [x for x in r.cleaned.split("\n") if x]) for r in line_dedup.line_dedup(docs).collect()), key=repr)


def test_every_repeated_run(make):
    rng = random.Random(8)
    passages = [[f"passage {p} line {i}" for i in range(rng.randint(2, 8))] for p in range(30)]
    rows = []
    for d in range(150):
        lines = [f"own {d} {i}" for i in range(rng.randint(0, 4))]
        for p in rng.sample(passages, rng.randint(0, 3)):
            at = rng.randint(0, len(lines))
            lines[at:at] = p
        rows.append((rng.choice([d, d, d, None, 7]), "\n".join(lines) + "\n" * rng.randint(0, 2), "en", "s", 0))
    rows.append((200, "a\na\na\na\na", "en", "s", 0))
    assert cleaned(make(rows)) == brute(rows)


def test_exact_copies_go_whole(make):
    rng = random.Random(9)
    texts = ["\n".join(f"text {t} line {i} {rng.random()}" for i in range(rng.randint(2, 30))) for t in range(20)]
    rows = [(c * 100 + t, text, "en", "s", 0) for c in range(3) for t, text in enumerate(texts)]
    got = {r.doc.doc_id: r for r in line_dedup.line_dedup(make(rows)).collect()}
    assert all(got[t].n_removed == 0 for t in range(20))
    assert all(got[d].n_removed == got[d].n_lines and got[d].cleaned == "" for d in got if d >= 100)
    left = corpus_pipeline.without_repeated_lines(None, make(rows), "")
    left = corpus_pipeline.one_of_each_group(None, left, "")
    assert {r.doc_id: r.text for r in left.collect()} == dict(enumerate(texts))


@pytest.mark.parametrize("doc_id", [None, 5])
def test_rows_of_one_id(make, doc_id):
    rows = [(doc_id, "a\nb\nc", "en", "s", 0), (doc_id, "x\na\nb\ny", "en", "s", 0), (doc_id, "a\nb\nc", "fr", "s", 0), (doc_id, None, "en", "s", 0)]
    got = line_dedup.line_dedup(make(rows)).collect()
    kept = [x for r in got for x in (r.cleaned or "").split("\n") if x]
    assert len(got) == 4 and sorted(kept) == ["a", "b", "c", "x", "y"] and [r.cleaned for r in got if r.doc.text is None] == [None]
