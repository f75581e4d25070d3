"""Cheapest edits of a sequence of turns, by min-plus matrices over a Re-Pair grammar.

A turn is one of nine symbols: its role's initial (s, u, a or another) and whether it is sound, truncated, or must be deleted.
Editing turns so that the roles left read ``(s?(ua)+)?`` is a walk over four states, so a sequence of turns is a 4 x 4 matrix of
(cost, audit), and concatenation is a min-plus product. Re-Pair names the most frequent pairs of symbols of all conversations;
each rule gets its matrix once, from those of its two sides, and every conversation is evaluated over the symbols that are left.

An audit has one letter per turn and one per insertion. Inserts after a turn belong to its matrix, so every audit is read in
one way only; of two audits with one cost neither begins the other, and the least audit of a product is the product of least audits.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = "sua"
GONE = 8
SYMBOLS = 9
SEPARATOR = np.uint16(65535)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
INSERTS = {START: (USER, ASSISTANT), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: (USER,)}
ACCEPTING = (START, ASSISTANT)
SHORT = 64


class Rope:
    """A text as a shared tree of parts."""

    __slots__ = ("text", "left", "right")

    def __init__(self, text: str | None, left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right

    def __reduce__(self):
        return Rope, (self.text, self.left, self.right)

    def __add__(self, other: Rope) -> Rope:
        if self.text is not None and other.text is not None and len(self.text) + len(other.text) <= SHORT:
            return Rope(self.text + other.text)
        return Rope(None, self, other)

    def leaves(self) -> Iterable[str]:
        stack = [self]
        while stack:
            node = stack.pop()
            if node.text is None:
                stack += (node.right, node.left)
            else:
                yield node.text

    def __str__(self) -> str:
        return "".join(self.leaves())

    def __lt__(self, other: Rope) -> bool:
        """Order of the texts; parts that both share at the same place are passed over unread."""
        a, b, at_a, at_b = [self], [other], 0, 0
        while a and b:
            if at_a == at_b == 0 and a[-1] is b[-1]:
                a.pop()
                b.pop()
                continue
            for stack in (a, b):
                while stack[-1].text is None:
                    node = stack.pop()
                    stack += (node.right, node.left)
            if at_a == at_b == 0 and a[-1] is b[-1]:
                continue
            x, y = a[-1].text, b[-1].text
            n = min(len(x) - at_a, len(y) - at_b)
            if x[at_a:at_a + n] != y[at_b:at_b + n]:
                return x[at_a:at_a + n] < y[at_b:at_b + n]
            at_a, at_b = at_a + n, at_b + n
            if at_a == len(x):
                a.pop()
                at_a = 0
            if at_b == len(y):
                b.pop()
                at_b = 0
        return not any(n.text != "" for n in a) and any(n.text != "" for n in b)


Entry = tuple[int, Rope] | None
Matrix = tuple[tuple[Entry, ...], ...]
EMPTY = Rope("")


def better(a: Entry, b: Entry) -> Entry:
    if a is None or b is None:
        return b if a is None else a
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return b if b[1] < a[1] else a


def through(vector: tuple[Entry, ...], matrix: Matrix) -> tuple[Entry, ...]:
    """The min-plus product of a row of entries with a matrix."""
    out: list[Entry] = [None] * 4
    for here, row in zip(vector, matrix):
        if here is not None:
            for q, step in enumerate(row):
                if step is not None and (out[q] is None or here[0] + step[0] <= out[q][0]):
                    out[q] = better(out[q], (here[0] + step[0], here[1] + step[1]))
    return tuple(out)


def product(a: Matrix, b: Matrix) -> Matrix:
    return tuple(through(row, b) for row in a)


IDENTITY: Matrix = tuple(tuple((0, EMPTY) if p == q else None for q in range(4)) for p in range(4))


def _inserts() -> Matrix:
    rows = [list(row) for row in IDENTITY]
    for state, reached in INSERTS.items():
        for n, q in enumerate(reached, 1):
            rows[state][q] = better(rows[state][q], (n * INSERT, Rope("I" * n)))
    return tuple(map(tuple, rows))


ANY_INSERTS = _inserts()


def symbol(initial: str, gone: bool, truncated: bool) -> int:
    return GONE if gone else (ROLES.index(initial) if initial and initial in ROLES else 3) + 4 * truncated


def terminal(code: int) -> Matrix:
    """What can be done with one turn and the inserts after it."""
    rows: list[list[Entry]] = [[None] * 4 for _ in range(4)]
    for p in range(4):
        rows[p][p] = (DELETE, Rope("D"))
        if code == GONE:
            continue
        extra, role = (TRUNCATED, code - 4) if code >= 4 else (0, code)
        options = [(r, REROLE, "R") for r in "ua"] + ([(ROLES[role], KEEP, "K")] if role < 3 else [])
        for letter, cost, edit in options:
            q = STEP.get((p, letter))
            if q is not None:
                rows[p][q] = better(rows[p][q], (cost + extra, Rope(edit)))
    return product(tuple(map(tuple, rows)), ANY_INSERTS)


def joined(parts: list[bytes]) -> np.ndarray:
    """The symbols of all sequences with a separator after each."""
    codes = np.frombuffer(b"".join(p + b"\xff" for p in parts), np.uint8).astype(np.uint16)
    codes[codes == 255] = SEPARATOR
    return codes


def pair_counts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Adjacent pairs inside sequences as left * 65536 + right, and how often each comes."""
    pair = codes[:-1].astype(np.int64) << 16 | codes[1:]
    return np.unique(pair[(codes[:-1] != SEPARATOR) & (codes[1:] != SEPARATOR)], return_counts=True)


def replace(codes: np.ndarray, rules: list[tuple[int, int]], first: int = 0) -> np.ndarray:
    """The sequences with every rule from number ``first`` on applied, one rule after another, from left to right."""
    for number, (a, b) in enumerate(rules[first:], first):
        hit = np.flatnonzero((codes[:-1] == a) & (codes[1:] == b))
        if a == b and len(hit):  # in a run of one symbol every second place
            head = np.ones(len(hit), bool)
            head[1:] = hit[1:] != hit[:-1] + 1
            begin = hit[np.flatnonzero(head)[np.cumsum(head) - 1]]
            hit = hit[(hit - begin) % 2 == 0]
        if len(hit):
            codes = codes.copy()
            codes[hit] = SYMBOLS + number
            codes = np.delete(codes, hit + 1)
    return codes


class Grammar:
    """Rules in the order of their making, and the matrix of every symbol, bottom-up."""

    def __init__(self, rules: list[tuple[int, int]]):
        self.rules = list(rules)
        self.matrices = [terminal(code) for code in range(SYMBOLS)]
        for a, b in self.rules:
            self.matrices.append(product(self.matrices[a], self.matrices[b]))

    def sequences(self, parts: list[bytes]) -> list[list[int]]:
        """Each sequence of turns over the grammar's symbols."""
        codes = replace(joined(parts), self.rules)
        ends = np.flatnonzero(codes == SEPARATOR)
        return [codes[a:b].tolist() for a, b in zip(np.append(0, ends[:-1] + 1), ends)]

    def whole(self, sequence: list[int]) -> tuple[int, str]:
        """Cost and audit of a whole conversation."""
        vector = ANY_INSERTS[START] if sequence else IDENTITY[START]
        for code in sequence:
            vector = through(vector, self.matrices[code])
        best = None
        for state in ACCEPTING:
            best = better(best, vector[state])
        return best[0], str(best[1])

    def part(self, sequence: list[int]) -> Matrix:
        """The matrix of a part of a conversation."""
        matrix = IDENTITY
        for code in sequence:
            matrix = product(matrix, self.matrices[code])
        return matrix


# A part of a long conversation is known to the others by 16 costs, the first letters of its audits, and the order of its audits
# with any first letter that may follow them; so the best way through all parts is found without their audits.
LETTERS = ("", "D", "K", "R")
NONE = 1 << 40


def describe(matrix: Matrix) -> tuple[list[int], list[str], list[int]]:
    """(16 costs, 16 first letters, 64 ranks) of a part."""
    costs = [NONE if e is None else e[0] for row in matrix for e in row]
    texts = [["" if e is None else str(e[1]) for e in row] for row in matrix]
    ranks = []
    for row in texts:
        followed = [t + letter for t in row for letter in LETTERS]
        order = {t: i for i, t in enumerate(sorted(set(followed)))}
        ranks += [order[t] for t in followed]
    return costs, [t[:1] for row in texts for t in row], ranks


def best_way(parts: list[tuple[list[int], list[str], list[int]]]) -> tuple[int, int, list[tuple[int, int]]]:
    """(cost, inserts before the first turn, state before and after each part) of the cheapest, then least audit of all parts."""
    to_go = [0 if q in ACCEPTING else NONE for q in range(4)]
    letter = [""] * 4
    choices = []
    for costs, heads, ranks in reversed(parts):
        choice, new_cost, new_letter = [0] * 4, [NONE] * 4, [""] * 4
        for p in range(4):
            options = [(costs[4 * p + q] + to_go[q], ranks[16 * p + 4 * q + LETTERS.index(letter[q])], q) for q in range(4)
                       if costs[4 * p + q] < NONE and to_go[q] < NONE]
            if options:
                new_cost[p], _, q = min(options)
                choice[p], new_letter[p] = q, heads[4 * p + q] or letter[q]
        to_go, letter = new_cost, new_letter
        choices.append(choice)
    begin = [(to_go[START], letter[START], START, 0)]
    begin += [(n * INSERT + to_go[q], "I" * n + letter[q], q, n) for n, q in enumerate(INSERTS[START], 1)]
    cost, _, state, inserts = min(begin)
    way = []
    for choice in reversed(choices):
        way.append((state, choice[state]))
        state = choice[state]
    return cost, inserts, way


def repaired(audit: str, roles: list[str], texts: list[str], state: int = START) -> list[tuple[str, str, str]]:
    """(edit, role, text) of the turns that an audit leaves or inserts, from the state before the first of them."""
    out, turns = [], zip(roles, texts)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(turns)
        if edit == "D":
            continue
        if edit != "K":
            role = "assistant" if state == USER else "user"
        state = STEP[state, role[:1]]
        out.append((edit, role, text))
    return out
