import os
import random
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import plain  # noqa: E402

from stayloom.llm import (  # noqa: E402
    bpe, decontaminate, host_reputation, jaccard_join, language_id, line_dedup, quality_model, quality_rules, substring_dedup, warc,
)
from stayloom.llm.components import components  # noqa: E402
from stayloom.llm.queries import TOKENIZER  # noqa: E402
from stayloom.session import stage_path  # noqa: E402


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, str(type(x)), x) if not isinstance(x, float) else (True, "f", x) for x in r))


@pytest.fixture(scope="module")
def labels(make):
    return make([(i, i % 2, 0) for i in range(0, 240)] + [(None, 1, None), (3, None, 0)], "doc_id bigint, quality int, toxic int")


# 1
def test_quality_learns_marks(make, none, odd):
    rng = random.Random(2)
    texts = [(i, " ".join(rng.choice("abcdefgh") + ("***" if i % 3 == 0 else "") for _ in range(40)), "en", "s", 0) for i in range(300)]
    marks = make([(i, int(i % 3 != 0), 0) for i in range(300)], "doc_id bigint, quality int, toxic int")
    docs = make(texts)
    got = quality_model.quality_scores(docs, marks).toPandas().set_index("doc_id")
    held = got[got.held_out]
    assert len(held) > 20 and all((held.predicted == 1) == (held.index % 3 != 0))
    assert quality_model.keep_good(docs, marks).count() == 200
    again = quality_model.quality_scores(docs.repartition(5), marks).toPandas().set_index("doc_id")
    assert np.allclose(again.score.sort_index(), got.score.sort_index(), atol=1e-6)
    strange = quality_model.quality_scores(odd, marks).toPandas()
    assert len(strange) == 9 and strange.score.between(0, 1).all()
    assert quality_model.quality_scores(none, marks).count() == 0
    assert quality_model.keep_good(odd, marks).columns == odd.columns


# 2
def test_bpe_equals_the_library(make, odd, none):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(TOKENIZER)
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "b", " ", "é", "!", "漢", "1", "\n", "'s", "the", "ing", "<|endoftext|>", "\0"]) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["a" * 700, " " * 900, "ab" * 600, None]
    codec = bpe.Codec(bpe.read_tokenizer(TOKENIZER))
    ids, at = codec.encode(texts)
    decoded = codec.decode(ids, at)
    for i, text in enumerate(texts):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert ids[at[i]:at[i + 1]].tolist() == want
        assert decoded[i] == library.decode(want, skip_special_tokens=False)
    got = bpe.round_trip(odd, TOKENIZER).collect()
    assert sorted(r.decoded for r in got) == sorted(r.text or "" for r in odd.collect())
    back = bpe.decode(bpe.encode(odd, TOKENIZER), TOKENIZER)
    assert rows_of(back) == rows_of(odd.select("doc_id", F.coalesce("text", F.lit(""))))
    assert bpe.encode(none, TOKENIZER).count() == 0


def test_bpe_pairs_are_what_merging_gives():
    codec = bpe.Codec(bpe.read_tokenizer(TOKENIZER))
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 5000, 4000), rng.integers(0, 5000, 4000)
    tokens = bpe.read_tokenizer(TOKENIZER)["tokens"]
    want = [codec.merged(tokens[x] + tokens[y]) == [x, y] for x, y in zip(a, b)]
    assert codec.compatible(a, b).tolist() == want


# 3
def test_surface_counts(make, corpus, labels, odd, none):
    docs = make(corpus)
    got = quality_rules.quality_rules(docs, labels).collect()
    assert {r.doc_id: tuple(r)[1:7] for r in got} == {d: plain.surface(t) for d, t, *_ in corpus}
    assert all(r.kept == (not r.base_failed and r.llr >= quality_rules.THRESHOLD) for r in got)
    strange = quality_rules.quality_rules(odd, labels).collect()
    assert sorted(tuple(r)[1:7] for r in strange) == sorted(plain.surface(r.text) for r in odd.collect())
    assert quality_rules.quality_rules(none, labels).count() == 0


def test_likelihood_ratio_by_hand(make):
    docs = make([(1, "good good", "en", "s", 0), (2, "bad", "en", "s", 0)])
    marks = make([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r.llr for r in quality_rules.quality_rules(docs, marks, buckets=1 << 12).collect()}
    cells = 1 << 12
    good, pair, bad = (np.log((1 + g) / (3 + cells)) - np.log((1 + r) / (4 + cells)) for g, r in ((2, 2), (1, 1), (0, 1)))
    assert got[1] == pytest.approx((2 * good + pair) / 3) and got[2] == pytest.approx(bad)


# 4
def test_decontamination(make, corpus, odd, none):
    items = [(i, " ".join(corpus[i][1].split()[3:3 + n])) for i, n in ((5, 20), (6, 10), (8, 4), (10, 1), (20, 30), (25, 14))] + [(5, "w1 w2"), (30, None), (31, "")]
    bench = make(items, "item_id bigint, text string")
    docs = make(corpus)
    want = sorted(plain.contamination([r[:2] for r in corpus], items))
    for limit in (10_000, 15):
        got = decontaminate.decontaminate(docs, bench, block_words=limit).select("doc_id", "found.n_words", "found.n_hit", "found.items")
        assert [tuple(r) for r in sorted(got.collect())] == want
    cleaned = decontaminate.decontaminate(docs, bench).select("doc_id", "found.cleaned").collect()
    assert not any(hit for _, _, hit, _ in plain.contamination([tuple(r) for r in cleaned], [i for i in items if i[0] in (5, 6, 20, 25) and i[1] != "w1 w2"]))
    strange = decontaminate.decontaminate(odd, bench)
    assert strange.count() == 9 and set(odd.columns) <= set(strange.columns)
    assert decontaminate.decontaminate(none, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("found.n_hit > 0").count() == 0


# 5
def test_substring_dedup(make, corpus, odd, none):
    long = [(i, t * 2 if i % 17 == 0 else t, *rest) for i, t, *rest in corpus] + [(900, "x " * 200, "en", "s", 0), (901, "y " * 34, "en", "s", 0)]
    got = substring_dedup.substring_dedup(make(long)).collect()
    assert sorted(tuple(r) for r in got) == sorted(plain.repeats([r[:2] for r in long]))
    strange = {r.doc_id: r for r in substring_dedup.substring_dedup(odd).collect()}
    assert len(strange) == 8 and strange[6].n_removed == 60_000 and strange[4].n_removed == 0 and strange[1].kept == ""
    assert substring_dedup.substring_dedup(none).count() == 0


# 6
def test_language_id(make, odd, none):
    rng = random.Random(4)
    parts = {"aa": ["the", "ing", "tion", "wh"], "bb": ["der", "ung", "sch", "ß"], "cc": ["ción", "que", "ll", "ñ"]}
    rows = [(i, " ".join("".join(rng.choice(parts[k]) for _ in range(3)) for _ in range(30)), k, "s", 0) for i in range(300) for k in [rng.choice(list(parts))]]
    got = language_id.language_id(make(rows)).toPandas().set_index("doc_id")
    truth = {r[0]: r[2] for r in rows}
    assert (got[got.held_out].lang_pred == got[got.held_out].index.map(truth)).mean() > 0.97
    strange = {(r.doc_id): r for r in language_id.language_id(odd).collect()}
    assert [strange[i].lang_pred for i in (1, 2, 3, 5)] == ["und"] * 4 and strange[1].score == 0 and strange[7].lang_pred != "und"
    assert language_id.language_id(none).count() == 0


# 7
def test_line_dedup(make, odd, none):
    block = "\n".join(f"shared line {i} of the block" for i in range(40))
    rows = [(1, f"own one\n{block}\nend one", "en", "s", 0), (2, f"{block}\n", "en", "s", 0), (3, f"first\nsecond\n{block}\nlast", "en", "s", 0),
            (4, "single", "en", "s", 0), (5, "single", "en", "s", 0), (6, f"{block}\n{block}", "en", "s", 0)]
    got = {r.doc.doc_id: r for r in line_dedup.line_dedup(make(rows)).collect()}
    assert got[1].n_removed == 0 and got[1].cleaned == rows[0][1]
    assert got[2].n_removed >= 30 and got[3].n_removed >= 30 and got[6].n_removed >= 65 and got[4].cleaned == got[5].cleaned == "single"
    kept = {k for k in range(1, 7) for line in [got[k].cleaned.split("\n")] if "shared line 20 of the block" in line}
    assert kept == {1}
    for r in got.values():
        before = dict((d, t) for d, t, *_ in rows)[r.doc.doc_id].split("\n")
        assert len([x for x in before if x]) == r.n_lines and len([x for x in r.cleaned.split("\n") if x]) == r.n_lines - r.n_removed
    strange = line_dedup.line_dedup(odd).collect()
    assert len(strange) == 9 and all(r.cleaned == r.doc.text for r in strange)
    assert line_dedup.line_dedup(none).count() == 0


# 8
def test_url_filter(make):
    urls = ["http://A.Example.NET/en/x?y#z", "https://example.net", "http://example.com/de/", "ftp://x.org/fr/a", "http://notexample.net/q", None,
            "no scheme", "http://bad.site.io/p", "http://good.site.io/p", "http://x.org?fr/"]
    pages = [(i, u, "<p>fine words here</p>") for i, u in enumerate(urls)]
    pages += [(100 + i, "http://bad.site.io/" + str(i), "<p>*** $$$ ***</p>") for i in range(60)] + [(200 + i, "http://good.site.io/", "<b>fine</b>") for i in range(60)]
    got = {r.page_id: r for r in host_reputation.url_filter(make(pages, "page_id bigint, url string, html string")).collect()}
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert (got[1].path, got[1].rule) == ("", None) and got[2].verdict == "block" and got[3].rule == "org/fr/" and got[4].rule is None or got[4].rule == "net/"
    assert got[5].host == got[6].host == "" and got[7].verdict == "block" and got[8].verdict == "allow" and got[9].host == "x.org" and got[9].path == ""
    assert host_reputation.url_filter(make([], "page_id bigint, url string, html string")).count() == 0


# 9
def test_warc_round_trip(spark, make):
    trap = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nWARC/1.1WARC/1.1\r\n" * 40
    html = [None, "", "short", "é漢🎉" * 3000, trap, trap, "b" * 1000, "b" * 1000, "c" * 999, "c" * 999, trap]
    rows = [(i, None if i == 3 else "http://h/%0D\r\nX: y" if i == 4 else f"http://h/{i}", h) for i, h in enumerate(html)]
    rows += [(6, "http://h/6", "b" * 1000), (None, "u", "q")]
    path = stage_path(spark, "warc-test")
    warc.write_warc(make(rows, "page_id bigint, url string, html string").repartition(3), path, segment_bytes=700)
    records = warc.read_warc(spark, path)
    assert records.where("not intact").count() == 0
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.page_summary(records).collect()}
    size = [len((h or "").encode()) for h in html]
    revisit = {4: 10, 5: 10, 6: 7}
    assert got == {(i, "revisit" if i in revisit else "response", revisit.get(i), n) for i, n in enumerate(size)} | {(None, "response", None, 1)}
    assert records.count() == len(rows)
    texts = {r.page_id: r.payload.decode() for r in records.where("record_type = 'response'").collect()}
    assert texts[10] == trap and texts[3] == html[3]
    assert warc.unchunked(b"5\r\nab") is None and warc.unchunked(warc.chunked(b"x" * 9000)) == b"x" * 9000
    lost = warc.assemble([{**warc.parse_record(warc.record_texts(1, None, b"z" * 3000, "00" * 20, None, "", "t", 700)[1]), "number": 2}])
    assert not lost["intact"]


# 10
def test_jaccard_groups(make, corpus, odd, none):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(90)]
    near = [(1000 + i, " ".join(base[:k] + [f"e{i}"] + base[k + 1:]), "en", "s", 0) for i in range(60) for k in [rng.randrange(90)]]
    docs = corpus + near
    got = sorted(tuple(r) for r in jaccard_join.jaccard_groups(make(docs)).collect())
    assert got == sorted(plain.groups([r[:2] for r in docs]))
    strange = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_groups(odd).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (None, 1, None)} <= {(a, min(b, 1), c) for a, b, c in strange}
    assert jaccard_join.jaccard_groups(none).count() == 0


def test_parts_of_linked_texts_meet():
    rng = random.Random(6)
    flags = np.zeros(jaccard_join.SLOTS, bool)
    for n in (6, 9, 20, 65, 70, 130, 400):
        for _ in range(40):
            a = [str(rng.random()) for _ in range(n)]
            b = list(a)
            for _ in range(max(1, n // 60)):
                b[rng.randrange(n)] = "z"
            value, at = jaccard_join.shingle_sets(pa.array([" ".join(a), " ".join(b)]))
            x, y = set(value[:at[1]].tolist()), set(value[at[1]:].tolist())
            text, key = jaccard_join.part_keys(value, at, flags, 80)
            if 100 * len(x & y) >= 80 * len(x | y):
                assert set(key[text == 0].tolist()) & set(key[text == 1].tolist())


def test_components(make):
    links = make([(5, 4), (4, 3), (3, 2), (9, 8), (7, 7), (2, 1), (8, 9)], "a bigint, b bigint")
    assert sorted(tuple(r) for r in components(links).collect()) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (8, 8), (9, 8)]
