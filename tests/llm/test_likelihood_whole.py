"""op3: no two grams share a count however many there are, and every good document is in the target."""

import random
from collections import Counter

import numpy as np
import pytest
from stayloom.llm import quality_rules

LABELS = "doc_id bigint, quality int, toxic int"


def grams(text):
    w = text.split()
    return Counter(w) + Counter(zip(w, w[1:]))


def test_every_gram_has_its_own_weight(make):
    rng = random.Random(3)
    common = [f"c{i}" for i in range(30)]
    rows = [(i % 590 or None, " ".join(rng.choice(common) if rng.random() < 0.3 else f"w{rng.randrange(40_000)}" for _ in range(60)), "en", "s", 0) for i in range(600)]
    rows += [rows[3], rows[3]]
    good = {i for i in range(1, 300)}
    raw, target = Counter(), Counter()
    for d, text, *_ in rows:
        raw += grams(text)
        target += grams(text) if d in good else Counter()
    assert len(raw) > 1 << 15
    share, prior = target.total() / raw.total(), quality_rules.PRIOR
    want = []
    for d, text, *_ in rows:
        own = grams(text)
        want.append((d or 0, sum(n * np.log((target[g] + prior) / (raw[g] * share + prior)) for g, n in own.items()) / own.total()))
    got = quality_rules.quality_rules(make(rows), make([(i, 1, 0) for i in good] * 2 + [(None, 1, 0)], LABELS)).collect()
    assert [x for p in sorted((r.doc_id or 0, r.llr) for r in got) for x in p] == pytest.approx([x for p in sorted(want) for x in p])


def test_every_good_document_counts(spark, make):
    docs = spark.range(50_000).selectExpr("id AS doc_id", "if(id < 25000, 'a', 'b') AS text")
    marks = spark.range(25_000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    cells = 1 << 12
    want = np.log(25_001 / (25_000 + cells)) - np.log(25_001 / (50_000 + cells))
    assert quality_rules.quality_rules(docs, marks, buckets=cells).where("doc_id = 1").first().llr == pytest.approx(want)


def mixed_rows():
    """Repeated, NULL and negative ids, copies, frequent and rare words, empty texts."""
    rng = random.Random(8)
    rows = [(rng.choice([None, -i, i, i // 2]), " ".join(rng.choice(["the", "of", f"a{rng.randrange(50)}", f"r{rng.randrange(9_000)}"]) for _ in range(rng.choice([1, 2, 60, 300]))), "en", "s", 0) for i in range(300)]
    return rows + [rows[5]] * 40 + [(7, None, "en", "s", 0), (8, "", "en", "s", 0), (9, " ", "en", "s", 0)]


def expected(rows, good):
    raw, target = Counter(), Counter()
    for d, text, *_ in rows:
        raw += grams(text or "")
        target += grams(text or "") if d in good else Counter()
    share, prior = target.total() / raw.total(), quality_rules.PRIOR
    out = []
    for d, text, *_ in rows:
        own = grams(text or "")
        out.append((d is None, d or 0, sum(n * np.log((target[g] + prior) / (raw[g] * share + prior)) for g, n in own.items()) / max(own.total(), 1)))
    return [x for row in sorted(out) for x in row]


@pytest.mark.parametrize("limits", [{"block_units": 700, "coded_units": 40}, {"block_units": 1, "coded_units": 0}, {}, {"ids": 3}])
def test_blocks_and_numbers_change_no_weight(make, monkeypatch, limits):
    rows, good = mixed_rows(), {i for i in range(-50, 200, 3)}
    monkeypatch.setattr(quality_rules, "TARGET_IDS", limits.pop("ids", quality_rules.TARGET_IDS))
    got = quality_rules.quality_rules(make(rows), make([(i, 1, 0) for i in good] + [(None, 1, 0), (1, 0, 0)], LABELS), **limits).collect()
    assert [x for row in sorted((r.doc_id is None, r.doc_id or 0, r.llr) for r in got) for x in row] == pytest.approx(expected(rows, good), abs=1e-9)


def test_grams_are_sent_packed_and_once(make, capsys):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.7)) % 20_000}" for _ in range(200)), "en", "s", 0) for i in range(1_000)]
    pairs = sum(len(grams(text)) for _, text, *_ in rows)
    docs, labels = make(rows).coalesce(1), make([(i, 1, 0) for i in range(300)], LABELS)
    of = quality_rules.Target(docs.select("doc_id", "text"), labels)
    raw, good, known = quality_rules.corpus_sums(of, quality_rules.CODED_UNITS)
    assert raw == sum(grams(text).total() for _, text, *_ in rows) and good == sum(grams(text).total() for d, text, *_ in rows if d < 300)
    sent = quality_rules.gram_records(of, quality_rules.GramCode(known, 9, None), quality_rules.BLOCK_UNITS).where("grams IS NOT NULL").collect()
    assert len(sent) == 9 and sum(len(r.grams) for r in sent) < 6 * pairs
    quality_rules.quality_rules(docs, labels).explain()
    assert "Join" not in capsys.readouterr().out


@pytest.mark.parametrize("n, most", [(0, 1), (1, 1), (5, 1 << 63), (4_095, 256), (4_096, 1 << 17), (9_000, 1), (9_000, 1 << 40)])
def test_packing_keeps_every_value(n, most):
    values = np.random.default_rng(n).integers(0, most, n, dtype=np.uint64)
    data = b"x" * 4 + quality_rules.packed(values) + b"rest"
    back, end = quality_rules.unpacked(data, 4)
    assert back.tolist() == values.tolist() and data[end:] == b"rest"
