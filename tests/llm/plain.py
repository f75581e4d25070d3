"""Brute-force versions of the operators' contracts."""

import hashlib
import re
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return SPACED.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def windows(w, k):
    return [tuple(w[i:i + k]) for i in range(len(w) - k + 1)]


def surface(text):
    w, seen, again = words(text), set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            again += line in seen
            seen.add(line)
    n = Counter(windows(w, 3))
    hit = {i + j for i, x in enumerate(windows(w, 3)) if n[x] > 1 for j in range(3)}
    marks = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), marks, again, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def contamination(docs, items):
    known = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall(lower(text))
        for x in windows(w, 10) or ([tuple(w)] if w else []):
            known[x].add(str(item))
    for doc, text in docs:
        w, hit, found = ALNUM.findall(lower(text)), set(), set()
        for k in {len(x) for x in known}:
            for i, x in enumerate(windows(w, k)):
                if x in known:
                    found |= known[x]
                    hit |= set(range(i, i + k))
        yield doc, len(w), len(hit), sorted(found)


def repeats(docs):
    docs = [(d, words(t)) for d, t in docs]
    n = Counter(x for _, w in docs for x in windows(w, 35))
    for doc, w in docs:
        gone = {i + j for i, x in enumerate(windows(w, 35)) if n[x] > 1 for j in range(35)}
        yield doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)


def groups(docs):
    sets = []
    for doc, text in docs:
        w = words(lower(text))
        sets.append((doc, set(windows(w, 5)) or ({tuple(w)} if w else set())))
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return [(d, len(s), find(d)) for d, s in sets]
