import pytest

from stayloom.llm import warc
from stayloom.session import stage_path

URLS = ["http://h/WARC/1.1", "WARC/1.1\r\nWARC/1.1", "http://h/%57ARC/1.1", "x\r\n\r\ny", "", None, "http://h/WARC-Segment-Number: 2"]


@pytest.mark.parametrize("segment", [60, 8192])
def test_no_url_can_pass_for_a_record(spark, make, segment):
    rows = [(i, u, f"page {i} " * (1 + 60 * (i % 2))) for i, u in enumerate(URLS)]
    path = stage_path(spark, "warc-urls")
    warc.write_warc(make([(*r, "x", "y", 1) for r in rows], "page_id bigint, url string, html string, content string, keeper string, size int"), path, segment_bytes=segment)
    records = warc.read_warc(spark, path).collect()
    assert all(r.intact for r in records) and sorted((r.page_id, r.payload.decode()) for r in records) == [(i, h) for i, _, h in rows]


def test_escaped_values_differ():
    assert len({warc.escaped(u) for u in URLS if u is not None}) == len(URLS) - 1
    assert all(warc.VERSION not in warc.escaped(u) and "\n" not in warc.escaped(u) for u in URLS if u)


def test_no_pages(spark, make):
    path = stage_path(spark, "warc-none")
    warc.write_warc(make([], "page_id bigint, url string, html string"), path)
    assert warc.page_summary(warc.read_warc(spark, path)).count() == 0
