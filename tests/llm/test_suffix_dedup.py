import random
from collections import Counter

import numpy as np
import pytest

from stayloom.llm import suffix_dedup as S


def plain(rows, window):
    """(id, bytes, removed, spans, kept) by counting every window of every text."""
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[j:j + window] for _, b in data for j in range(len(b) - window + 1))
    out = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - window + 1):
            if seen[b[j:j + window]] > 1:
                gone[j:j + window] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out.append((i, len(b), int(gone.sum()), int((edges == 1).sum()), bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


def found(df, **kwargs):
    rows = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in S.suffix_dedup(df, **kwargs).collect()]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


def texts(seed, n, alphabet, length, shared):
    rng = random.Random(seed)
    parts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(10, 60))) for _ in range(shared)]
    rows = []
    for i in range(n):
        t = "".join(rng.choice(parts) if rng.random() < 0.3 else "".join(rng.choice(alphabet) for _ in range(rng.randint(1, length))) for _ in range(6))
        if rng.random() < 0.2 and rows:
            t = list(rng.choice(rows)[1])
            t[rng.randrange(len(t))] = "#"
            t = "".join(t)
        if rng.random() < 0.1:
            t = t[:5] + rng.choice(["ab", "x", "xyz"]) * rng.randint(5, 60) + t[5:]
        rows.append((i, t))
    return rows


@pytest.mark.parametrize("seed, alphabet, block", [(1, "abcdefgh é", 1 << 20), (2, "ab", 200), (3, "abc漢", 400)])
def test_equals_counting_windows(make, seed, alphabet, block):
    rows = texts(seed, 70, alphabet, 40, 6) + [(None, "q" * 90), (None, None), (900, ""), (901, "short"), (5, "another text " * 9), (5, "another text " * 9)]
    df = make([(i, t, None, None, None) for i, t in rows]).repartition(4)
    assert found(df, window=16, grams=(5, 9, 14, 16), block=block) == plain(rows, 16)


def test_production_window_with_a_hot_passage(make, corpus):
    rng = random.Random(9)
    hot = "".join(rng.choice("abcdefghij ") for _ in range(260))
    tight = hot[:199]  # one byte short of a window: in every text, yet no repeat by itself
    rows = [(i, t) for i, t, *_ in corpus[:80]]
    rows += [(1000 + i, f"{i:05d} own words {i * 7919}" + hot + f"{i * 104729} tail {i}") for i in range(120)]
    rows += [(2000 + i, f"{i * 31337:09d}" + tight + f"{i * 65537:09d}") for i in range(120)]
    assert found(make([(i, t, "en", "s", 1) for i, t in rows]), block=20_000) == plain(rows, 200)


def test_odd_rows(odd, none, make):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(odd.select(*[f"`{c}`" for c in odd.columns])) == plain(rows, 200)
    assert found(none) == []
    long = [(1, " " * 20_000), (2, "ab" * 9_000 + "c"), (3, None)]
    assert found(make([(i, t, None, None, None) for i, t in long])) == plain(long, 200)


def test_hash_collisions_are_found_on_the_bytes(monkeypatch):
    rng = np.random.default_rng(1)
    raw = rng.integers(97, 99, 3000).astype(np.uint8)
    raw[1000:1400] = raw[:400]
    starts = np.arange(len(raw) - 24)
    want = Counter(bytes(raw[s:s + 24]) for s in starts)
    expected = [want[bytes(raw[s:s + 24])] > 1 for s in starts]
    group = np.zeros(len(starts), np.int64)
    assert S.repeated_windows(raw, starts, group, 24).tolist() == expected
    common = S.Prefix.common
    monkeypatch.setattr(S.Prefix, "common", lambda self, a, b, most: np.where((a + b) % 3 == 0, most, common(self, a, b, most)))
    assert S.repeated_windows(raw, starts, group, 24).tolist() == expected
    monkeypatch.setattr(S.Prefix, "common", lambda self, a, b, most: np.full(len(a), 1))
    order, _ = S.sorted_suffixes(raw, starts, group, 24)
    keys = [bytes(raw[s:s + 24]) for s in starts[order]]
    assert keys == sorted(keys)


def test_common_extension_is_exact():
    rng = np.random.default_rng(2)
    raw = rng.integers(97, 99, 500).astype(np.uint8)
    a, b = rng.integers(0, 450, 400), rng.integers(0, 450, 400)
    got = S.Prefix(raw).common(a, b, 50)
    want = [next((i for i in range(50) if raw[x + i] != raw[y + i]), 50) for x, y in zip(a, b)]
    assert got.tolist() == want
