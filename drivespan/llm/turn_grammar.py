"""What it costs to repair a sequence of turns, by dynamic programming over a Re-Pair grammar.

A turn is a symbol: s, u, a or x for its role's initial, in capitals if its text is truncated, d if it must go. Repaired sequences read
(s?(ua)+)?, so an automaton of four states follows them: START, after a system turn, after a user turn, and after a whole pair. A symbol is a min-plus
matrix between the states: cheapest edits in between, as a cost and the edits' initials, ties to the least string. The matrix of two symbols in a row is the product of
theirs. Of one stretch of turns, edits of equal cost are never one another's beginnings (their costs follow from the letters, and what could follow is insertions, which cost),
so the least string of a product is made of least strings.

Re-Pair replaces the most frequent pair of symbols by a new one, again and again. A rule's matrix is the product of two that are there already, with audits as
ropes that share their parts; each is computed once and serves all sequences.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

#: Fixed values of the contract: what edits cost, and what an undeleted truncated turn adds.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
START, SYSTEM, USER, PAIR = range(4)
STATES = range(4)
#: The automaton: next state by state and role initial.
MOVES = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (PAIR, "u"): USER, (USER, "a"): PAIR}
ENDS = (START, PAIR)
MUST_GO = "d"
SYMBOLS = "suaxSUAX" + MUST_GO
#: Symbols of rules are private characters from here on.
FIRST_RULE = 0xE000
#: Rules at most, of one round and altogether, and symbols that a rule may stand for.
ROUND_RULES, MOST_RULES, LONGEST_RULE = 16, 128, 256


class Entry(NamedTuple):
    """A matrix's cell: the cost, and the edits' initials as a rope, which is a string or a pair of ropes."""

    cost: int
    rope: str | tuple


Matrix = list[dict[int, Entry]]


def flat(rope: str | tuple) -> str:
    """The rope's string."""
    out, todo = [], [rope]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            todo += (x[1], x[0])
    return "".join(out)


def _better(a: Entry, b: Entry | None) -> bool:
    return b is None or a.cost < b.cost or a.cost == b.cost and flat(a.rope) < flat(b.rope)


def product(first: Matrix, then: Matrix) -> Matrix:
    out: Matrix = [{} for _ in STATES]
    for p in STATES:
        for r, a in first[p].items():
            for q, b in then[r].items():
                x = Entry(a.cost + b.cost, (a.rope, b.rope) if a.rope and b.rope else a.rope or b.rope)
                if _better(x, out[p].get(q)):
                    out[p][q] = x
    return out


def _insertions() -> Matrix:
    """Insertions of user and assistant turns, from none to as many as reach another state."""
    out: Matrix = [{} for _ in STATES]
    for p in STATES:
        at, n = p, 0
        while at not in out[p]:
            out[p][at] = Entry(n * INSERT, "I" * n)
            at, n = MOVES[at, "a" if at == USER else "u"], n + 1
    return out


def _edit(symbol: str) -> Matrix:
    """Keeping, reroling or deleting one turn."""
    out: Matrix = [{p: Entry(DELETE, "D")} for p in STATES]
    if symbol != MUST_GO:
        more = TRUNCATED * symbol.isupper()
        for (p, initial), q in MOVES.items():
            edits = [Entry(KEEP + more, "K")] * (initial == symbol.lower()) + [Entry(REROLE + more, "R")] * (initial in "ua")
            for x in edits:
                if _better(x, out[p].get(q)):
                    out[p][q] = x
    return out


INSERTED = _insertions()
#: A symbol's matrix: insertions before it, then its own edit. Insertions behind the last turn are INSERTED once more.
BASE = {c: product(INSERTED, _edit(c)) for c in SYMBOLS}


class Grammar:
    """Rules in the order in which they replace pairs. The matrices of all symbols, with strings for ropes, are made once where they are needed."""

    def __init__(self, rules: tuple[tuple[str, str], ...] = ()):
        self.rules = tuple(rules)
        self.spans = dict.fromkeys(SYMBOLS, 1)
        for pair, name in self.rules:
            self.spans[name] = self.spans[pair[0]] + self.spans[pair[1]]
        self._moves: dict[str, list[list[tuple[int, int, str]]]] | None = None

    def __getstate__(self):
        return {"rules": self.rules, "spans": self.spans, "_moves": None}

    @property
    def moves(self) -> dict[str, list[list[tuple[int, int, str]]]]:
        """By symbol and state: (next state, cost, edits)."""
        if self._moves is None:
            matrices = dict(BASE)
            for pair, name in self.rules:
                matrices[name] = product(matrices[pair[0]], matrices[pair[1]])
            self._moves = {c: [[(q, x.cost, flat(x.rope)) for q, x in row.items()] for row in m] for c, m in matrices.items()}
        return self._moves

    def compressed(self, symbols: str) -> str:
        for pair, name in self.rules:
            symbols = symbols.replace(pair, name)
        return symbols

    def grown(self, pairs: list[tuple[str, int]]) -> Grammar:
        """With rules for the most frequent of the pairs (pair, times): those that occur twice or more, have no symbol in common and are not too long."""
        rules, used = list(self.rules), set()
        for pair, times in sorted(pairs, key=lambda x: (-x[1], x[0])):
            if len(rules) == MOST_RULES or len(rules) - len(self.rules) == ROUND_RULES:
                break
            if times > 1 and not used & set(pair) and self.spans[pair[0]] + self.spans[pair[1]] <= LONGEST_RULE:
                used |= set(pair)
                rules.append((pair, chr(FIRST_RULE + len(rules))))
        return Grammar(tuple(rules))

    def pairs(self, sequences: dict[str, int]) -> Counter:
        """How often pairs of symbols stand side by side in the compressed sequences, each taken as often as given."""
        found: Counter = Counter()
        for symbols, times in sequences.items():
            small = self.compressed(symbols)
            for a, b in zip(small, small[1:], strict=False):
                found[a + b] += times
        return found

    def matrix(self, symbols: str) -> list[dict[int, tuple[int, str]]]:
        """The sequence's matrix, its cells as (cost, edits)."""
        small = self.compressed(symbols)
        return [follow([(0, "") if q == p else None for q in STATES], (self.moves[c] for c in small)) for p in STATES]


def follow(start: list[tuple[int, str] | None], steps) -> dict[int, tuple[int, str]]:
    """The cheapest edits (cost, initials) by last state, from what stands at each state before. A step has, by state, its (next state, cost, edits).

    What all states' edits begin with is put aside as it grows, so that only their ends are compared and copied.
    """
    live, aside = {p: x for p, x in enumerate(start) if x is not None}, []
    for step in steps:
        new: dict[int, tuple[int, str]] = {}
        for p, (cost, said) in live.items():
            for q, more, edits in step[p]:
                x = (cost + more, said + edits)
                if q not in new or x < new[q]:
                    new[q] = x
        live = new
        said = [s for _, s in live.values()]
        if said and len(said[0]) > 64:
            low, high = min(said), max(said)
            n = next((i for i, (a, b) in enumerate(zip(low, high, strict=False)) if a != b), min(len(low), len(high)))
            aside.append(low[:n])
            live = {q: (cost, s[n:]) for q, (cost, s) in live.items()}
    front = "".join(aside)
    return {q: (cost, front + s) for q, (cost, s) in live.items()}


CLOSING = [[(q, x.cost, flat(x.rope)) for q, x in row.items()] for row in INSERTED]


def cheapest(live: dict[int, tuple[int, str]]) -> tuple[int, str]:
    """(cost, edits) of the whole sequence, with the insertions behind its last turn."""
    ends = follow([live.get(p) for p in STATES], [CLOSING])
    return min(ends[q] for q in ENDS if q in ends)


def written(matrix: list[dict[int, tuple[int, str]]]) -> str:
    """A matrix as a string."""
    return "|".join(f"{p}{q}{cost}:{edits}" for p, row in enumerate(matrix) for q, (cost, edits) in sorted(row.items()))


def read(text: str) -> list[list[tuple[int, int, str]]]:
    """What written() made, as a step for follow()."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in STATES]
    for cell in text.split("|"):
        head, _, edits = cell.partition(":")
        out[int(head[0])].append((int(head[1]), int(head[2:]), edits))
    return out
