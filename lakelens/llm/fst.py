"""A small weighted finite-state toolkit: patterns over label sets, transducers over lattices, their composition.

A token is a set of labels. A pattern is written as words, labels (upper case), ``A&B`` for a token with both, ``.``
for any token, ``( | )``, and the suffixes ``?``, ``*``, ``+`` and ``{m,n}``; it is
compiled to a non-deterministic automaton, ``*`` and ``+`` to loops without a bound.

A sentence is a lattice: arcs from one position to a later one, each with labels and a weight. A ``Transducer`` is the
union of weighted rules with a copy of every arc at weight 0. Composing it with a lattice adds, for every match of a
rule, an arc with the rule's output over the matched span, whose weight is the best inner path's plus the rule's. So
all readings of all stages stay side by side, and only the last transducer's best path through the whole lattice
decides between them: a Viterbi search whose time is linear in the length of the sentence, with matches of any length.
Rules of the last stage whose name is none that is asked for serve to read their span as saying nothing of its own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import product

Labels = frozenset[str]
Arc = tuple[int, Labels, float]
LEX = re.compile(r"\{\d+,\d+\}|[()|?*+.]|[^\s(){}|?*+.]+")
#: Arcs made by ``compose`` span at most this many positions; the last stage knows no such bound.
SPAN = 64


class Lattice:
    """``arcs[position]`` lists (end, labels, weight)."""

    def __init__(self, tokens: list[Labels]):
        self.arcs: list[list[Arc]] = [[(i + 1, labels, 0.0)] for i, labels in enumerate(tokens)]

    def __len__(self) -> int:
        return len(self.arcs)


class Pattern:
    """An automaton without empty moves: ``arcs[state]`` lists (labels that are needed together, none for any; next state).

    Every match has a token of each set of labels in ``needs``.
    """

    def __init__(self, text: str):
        self.text = text
        self.tokens = LEX.findall(text)
        self.moves: list[list[tuple[Labels, int]]] = []
        self.empty: list[list[int]] = []
        self.at = 0
        start, end, self.needs = self._alternatives()
        if self.at != len(self.tokens):
            raise ValueError(f"unbalanced pattern: {text}")
        closure = [self._closure(s) for s in range(len(self.moves))]
        self.start = start
        self.arcs = [tuple({m for c in closure[s] for m in self.moves[c]}) for s in range(len(self.moves))]
        self.final = [end in closure[s] for s in range(len(self.moves))]
        firsts = {labels for labels, _ in self.arcs[start]}
        #: One label of each first token; None where any token may be first.
        self.first: set[str] | None = None if frozenset() in firsts else {min(x) for x in firsts}

    def _state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def _closure(self, s: int) -> set[int]:
        seen, todo = {s}, [s]
        while todo:
            for n in self.empty[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return seen

    def _alternatives(self) -> tuple[int, int, list[Labels]]:
        start, end = self._state(), self._state()
        branches = []
        while True:
            a, b, needs = self._sequence()
            branches.append(needs)
            self.empty[start].append(a)
            self.empty[b].append(end)
            if self.at < len(self.tokens) and self.tokens[self.at] == "|":
                self.at += 1
                continue
            return start, end, [frozenset().union(*one) for one in product(*branches)]

    def _sequence(self) -> tuple[int, int, list[Labels]]:
        start = end = self._state()
        needs: list[Labels] = []
        while self.at < len(self.tokens) and self.tokens[self.at] not in ")|":
            here = self.at
            a, b, met = self._atom()
            low, high = 1, 1
            if self.at < len(self.tokens) and self.tokens[self.at][0] in "?*+{":
                mark = self.tokens[self.at]
                self.at += 1
                low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(mark) or map(int, mark[1:-1].split(","))
            after = self.at
            needs += met if low else []
            if high is None:
                done = self._state()
                self.empty[end].append(a)
                self.empty[b] += [a, done]
                if not low:
                    self.empty[end].append(done)
                end = done
                continue
            copies = [(a, b)]
            while len(copies) < high:
                self.at = here
                copies.append(self._atom()[:2])
            self.at = after
            for k, (a, b) in enumerate(copies):
                done = self._state()
                self.empty[end].append(a)
                self.empty[b].append(done)
                if k >= low:
                    self.empty[end].append(done)
                end = done
        return start, end, needs

    def _atom(self) -> tuple[int, int, list[Labels]]:
        token = self.tokens[self.at]
        self.at += 1
        if token == "(":
            a, b, needs = self._alternatives()
            self.at += 1
            return a, b, needs
        a, b = self._state(), self._state()
        labels = frozenset() if token == "." else frozenset(token.split("&"))
        self.moves[a].append((labels, b))
        return a, b, [frozenset({x}) for x in labels]

    def words(self) -> set[str]:
        """The literal words (not labels) of the pattern."""
        return {x for t in self.tokens if t[0] not in "(){}|?*+." for x in t.split("&") if not x.isupper()}

    def ends(self, lattice: Lattice, at: int) -> dict[int, float]:
        """The end of every match that starts at ``at``, with the weight of its best inner path."""
        n, steps, final = len(lattice.arcs), self.arcs, self.final
        ahead: dict[int, dict[int, float]] = {at: {self.start: 0.0}}
        out: dict[int, float] = {}
        while ahead:
            p = min(ahead)
            states = ahead.pop(p)
            if p > at:
                done = [w for s, w in states.items() if final[s]]
                if done:
                    out[p] = max(done)
            if p == n or p - at >= SPAN:
                continue
            for end, here, weight in lattice.arcs[p]:
                for s, w in states.items():
                    for labels, to in steps[s]:
                        if labels <= here:
                            goal = ahead.setdefault(end, {})
                            if w + weight > goal.get(to, -1e9):
                                goal[to] = w + weight
        return out


@dataclass
class Rule:
    pattern: Pattern
    weight: float
    output: Labels = frozenset()
    name: str = ""


@dataclass
class Transducer:
    """The union of weighted rules."""

    rules: list[Rule] = field(default_factory=list)
    starting: tuple[int, dict[str | None, list[int]]] = (0, {})

    def add(self, name: str, weight: float, *patterns: str, output: str = "") -> Transducer:
        for p in patterns:
            self.rules.append(Rule(Pattern(p), weight, frozenset(output.split()), name))
        return self

    def words(self) -> set[str]:
        return set().union(*(r.pattern.words() for r in self.rules))

    def ready(self, arcs: list[Arc]) -> list[int]:
        """The rules that may start with one of these arcs."""
        if self.starting[0] != len(self.rules):  # rules by the labels that their first token may have
            by_label: dict[str | None, list[int]] = {}
            for k, rule in enumerate(self.rules):
                for label in (None,) if rule.pattern.first is None else rule.pattern.first:
                    by_label.setdefault(label, []).append(k)
            self.starting = len(self.rules), by_label
        by_label = self.starting[1]
        found = set(by_label.get(None, ()))
        for _, labels, _ in arcs:
            for label in labels:
                if label in by_label:
                    found.update(by_label[label])
        return sorted(found)

    def compose(self, lattice: Lattice) -> Lattice:
        """The lattice with an arc for each match; equal arcs keep the larger weight."""
        fresh: list[dict[tuple[int, Labels], float]] = []
        for i in range(len(lattice)):
            best: dict[tuple[int, Labels], float] = {}
            for k in self.ready(lattice.arcs[i]):
                rule = self.rules[k]
                for end, inner in rule.pattern.ends(lattice, i).items():
                    key = end, rule.output
                    best[key] = max(best.get(key, -1e9), inner + rule.weight)
            fresh.append(best)
        out = Lattice([])
        out.arcs = [[*arcs, *((end, labels, w) for (end, labels), w in best.items())] for arcs, best in zip(lattice.arcs, fresh)]
        return out

    def score(self, lattice: Lattice) -> dict[str, float]:
        """Summed weight of each rule name on the best path: the largest sum of weights, then the fewest rules.

        One pass over the positions: ``free`` is the best way to a position outside any rule, ``inside`` the best to each
        state of each rule that is under way there.
        """
        n = len(lattice)
        free: list[tuple[float, int, tuple | None] | None] = [(0.0, 0, None), *[None] * n]
        inside: list[dict[tuple[int, int], tuple[float, int, tuple | None]]] = [{} for _ in range(n + 1)]
        for p in range(n + 1):
            here = inside[p]
            for (k, state), (value, count, chain) in here.items():
                rule = self.rules[k]
                if rule.pattern.final[state]:
                    way = (value + rule.weight, count - 1)
                    if free[p] is None or way > free[p][:2]:
                        free[p] = (*way, (chain, rule))
            if p == n:
                break
            arcs, now = lattice.arcs[p], free[p]
            moves = list(here.items())
            if now is not None:
                moves += [((k, self.rules[k].pattern.start), now) for k in self.ready(arcs)]
                for end, _, weight in arcs:
                    way = (now[0] + weight, now[1])
                    if free[end] is None or way > free[end][:2]:
                        free[end] = (*way, now[2])
            for (k, state), (value, count, chain) in moves:
                steps = self.rules[k].pattern.arcs[state]
                for end, labels, weight in arcs:
                    goal = inside[end]
                    for needed, to in steps:
                        if needed <= labels:
                            old = goal.get((k, to))
                            if old is None or (value + weight, count) > old[:2]:
                                goal[k, to] = (value + weight, count, chain)
            inside[p] = {}
        found: dict[str, float] = {}
        chain = free[n][2]
        while chain is not None:
            chain, rule = chain
            found[rule.name] = found.get(rule.name, 0.0) + rule.weight
        return found


def compose(tokens: list[Labels], *stages: Transducer) -> Lattice:
    """The lattice of a sentence under a cascade of transducers."""
    lattice = Lattice(tokens)
    for stage in stages:
        lattice = stage.compose(lattice)
    return lattice
