"""op5: rows without an id, or with one id, are rows of their own."""

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import plain  # noqa: E402

from stayloom.llm import substring_dedup  # noqa: E402


@pytest.mark.parametrize("doc_id", [None, 5])
def test_rows_that_share_an_id(make, doc_id):
    rng = random.Random(12)
    own = lambda n: [f"o{rng.randrange(10**9)}" for _ in range(n)]
    passage, other = own(60), own(50)
    texts = [own(20) + passage + own(300), own(90) + passage + own(3), own(70), other + own(5), own(40) + other[:40], own(400)]
    # Paths with the anchor of a repeated passage but other words around it are opened into edges.
    texts += [own(30) + passage[:48] + own(20), own(7) + passage[8:] + own(100)]
    rows = [(doc_id if i % 3 else 9, " ".join(t), "en", "s", 0) for i, t in enumerate(texts)] + [(doc_id, " ".join(texts[2]), "en", "s", 0)] * 2
    got = substring_dedup.substring_dedup(make(rows)).collect()
    want = plain.repeats([r[:2] for r in rows])
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)
