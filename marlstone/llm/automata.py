"""Regular expressions over ASCII bytes as one minimal deterministic automaton.

``combined`` turns several rules into one transition array by subset construction and
partition refinement. A byte of the text is one step, whatever the number of rules; each
state knows the set of rules that have a match ending there.
"""

from __future__ import annotations

import re._constants as sre
from re._parser import parse
from typing import NamedTuple

import numpy as np


class Automaton(NamedTuple):
    """classes: byte -> column; step: [state, column] -> state; accepts: per state, a bit per rule. 0 is the start."""

    classes: bytes
    step: np.ndarray
    accepts: list[int]


class _Graph:
    """A nondeterministic automaton: edges on byte sets, and free moves."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def node(self) -> int:
        self.edges.append([])
        self.free.append([])
        return len(self.edges) - 1

    def add(self, ops, at: int, fold: bool) -> int:
        """Append a parsed pattern behind node ``at``; the node it ends in."""
        for op, arg in ops:
            if op is sre.LITERAL or op is sre.IN:
                to = self.node()
                self.edges[at].append((_bytes(op, arg, fold), to))
                at = to
            elif op is sre.SUBPATTERN:
                _, on, _, inner = arg
                at = self.add(inner, at, fold or bool(on & sre.SRE_FLAG_IGNORECASE))
            elif op is sre.BRANCH:
                end = self.node()
                for way in arg[1]:
                    begin = self.node()
                    self.free[at].append(begin)
                    self.free[self.add(way, begin, fold)].append(end)
                at = end
            elif op is sre.MAX_REPEAT:
                least, most, inner = arg
                for _ in range(least):
                    at = self.add(inner, at, fold)
                if most is sre.MAXREPEAT:
                    loop = self.node()
                    self.free[at].append(loop)
                    self.free[self.add(inner, loop, fold)].append(loop)
                    at = loop
                else:
                    end = self.node()
                    for _ in range(most - least):
                        self.free[at].append(end)
                        at = self.add(inner, at, fold)
                    self.free[at].append(end)
                    at = end
            else:
                raise ValueError(f"not supported in a rule: {op}")
        return at

    def closed(self, nodes) -> frozenset[int]:
        seen, todo = set(nodes), list(nodes)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)

    def turned(self) -> _Graph:
        """The same automaton with all edges reversed."""
        other = _Graph()
        for _ in self.edges:
            other.node()
        for a, out in enumerate(self.edges):
            for on, b in out:
                other.edges[b].append((on, a))
            for b in self.free[a]:
                other.free[b].append(a)
        return other


def _bytes(op, arg, fold: bool) -> frozenset[int]:
    found: set[int] = set()
    for kind, x in [(op, arg)] if op is sre.LITERAL else arg:
        if kind is sre.LITERAL:
            found.add(x)
        elif kind is sre.RANGE:
            found |= set(range(x[0], x[1] + 1))
        else:
            raise ValueError(f"not supported in a rule's class: {kind}")
    if fold:
        found |= {ord(c) for x in found for c in (chr(x).lower(), chr(x).upper())}
    if max(found) > 127:
        raise ValueError("rules are ASCII")
    return frozenset(found)


def _columns(sets: set[frozenset[int]]) -> tuple[bytes, list[int]]:
    """Bytes that no set tells apart share a column; a byte of each column."""
    ordered = list(sets)
    known: dict[tuple, int] = {}
    classes, some = bytearray(256), []
    for b in range(256):
        key = tuple(b in s for s in ordered)
        if key not in known:
            known[key] = len(known)
            some.append(b)
        classes[b] = known[key]
    return bytes(classes), some


def _determined(graph: _Graph, start: list[int], ends: dict[int, int], anywhere: bool) -> Automaton:
    """Subset construction, with sets of nodes as bit masks; with ``anywhere`` a match may begin at every byte."""
    classes, some = _columns({on for out in graph.edges for on, _ in out})
    mask = lambda nodes: sum(1 << x for x in graph.closed(nodes))
    moves = [[mask([t for on, t in out if b in on]) for b in some] for out in graph.edges]
    first = mask(start)
    number, todo, step = {first: 0}, [first], []
    for now in todo:
        row = [first if anywhere else 0] * len(some)
        for x in _members(now):
            row = [a | b for a, b in zip(row, moves[x], strict=True)] if graph.edges[x] else row
        for then in row:
            if then not in number:
                number[then] = len(number)
                todo.append(then)
        step.append([number[then] for then in row])
    accepts = [sum({1 << ends[x] for x in _members(s) if x in ends}) for s in todo]
    return _minimal(classes, np.array(step), accepts)


def _members(mask: int) -> list[int]:
    found = []
    while mask:
        low = mask & -mask
        found.append(low.bit_length() - 1)
        mask ^= low
    return found


def _minimal(classes: bytes, step: np.ndarray, accepts: list[int]) -> Automaton:
    """Refine the partition by acceptance until no step leads equivalent states apart."""
    _, block = np.unique(accepts, return_inverse=True)
    while True:
        rows = np.column_stack([block, block[step]])
        _, finer = np.unique(rows, axis=0, return_inverse=True)
        if finer.max() == block.max():
            break
        block = finer
    _, some = np.unique(block, return_index=True)
    order = np.argsort(some, kind="stable")  # the start's block comes first
    rank = np.empty_like(order)
    rank[order] = np.arange(order.size)
    some = some[order]
    return Automaton(classes, rank[block[step[some]]], [accepts[x] for x in some])


def combined(rules: list[str]) -> Automaton:
    """One automaton that says, after each byte, which rules have a match ending there."""
    graph, start, ends = _Graph(), [], {}
    for i, rule in enumerate(rules):
        begin = graph.node()
        start.append(begin)
        ends[graph.add(parse(rule), begin, False)] = i
    return _determined(graph, start, ends, anywhere=True)


def backwards(rule: str) -> Automaton:
    """Read from a match's end towards its start: accepts where a match may begin."""
    graph = _Graph()
    begin = graph.node()
    end = graph.add(parse(rule), begin, False)
    return _determined(graph.turned(), [end], {begin: 0}, anywhere=False)
