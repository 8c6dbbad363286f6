"""Regular expressions over bytes as one deterministic automaton of transition arrays.

A pattern goes through a parse tree and a nondeterministic automaton (Thompson) to a deterministic one by subset
construction over classes of equivalent bytes, which is then minimised by refining a partition (Moore). Several
patterns share one automaton whose states carry a bit for each pattern that has just matched.

The syntax is what secret rules need: literals, escapes (\\xHH, \\., \\n ...), classes with ranges and negation, groups
(all non-capturing), alternation and the repeats ? * + {n} {n,} {n,m}.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LETTERS = b"abcdefghijklmnopqrstuvwxyz"


class _Parser:
    """Nodes: ("set", frozenset of bytes), ("cat", nodes), ("alt", nodes), ("rep", node, least, most or None)."""

    def __init__(self, pattern: str, any_case: bool):
        self.s, self.i, self.any_case = pattern, 0, any_case

    def parse(self):
        node = self.alternation()
        if self.i < len(self.s):
            raise ValueError(f"unexpected {self.s[self.i]!r} at {self.i} of {self.s!r}")
        return node

    def alternation(self):
        branches = [self.sequence()]
        while self.s[self.i : self.i + 1] == "|":
            self.i += 1
            branches.append(self.sequence())
        return branches[0] if len(branches) == 1 else ("alt", branches)

    def sequence(self):
        parts = []
        while self.i < len(self.s) and self.s[self.i] not in "|)":
            parts.append(self.repeated())
        return ("cat", parts)

    def repeated(self):
        node = self.atom()
        while self.i < len(self.s) and self.s[self.i] in "?*+{":
            c = self.s[self.i]
            if c == "{":
                end = self.s.index("}", self.i)
                least, comma, most = self.s[self.i + 1 : end].partition(",")
                node, self.i = ("rep", node, int(least), (int(most) if most else None) if comma else int(least)), end + 1
            else:
                node, self.i = ("rep", node, int(c == "+"), 1 if c == "?" else None), self.i + 1
        return node

    def atom(self):
        c = self.s[self.i]
        if c == "(":
            self.i += 3 if self.s.startswith("(?:", self.i) else 1
            node = self.alternation()
            if self.s[self.i : self.i + 1] != ")":
                raise ValueError(f"a group of {self.s!r} does not end")
            self.i += 1
            return node
        if c == "[":
            return ("set", self.members())
        if c == ".":
            self.i += 1
            return ("set", frozenset(range(256)) - {10})
        return ("set", self.cased({self.byte()}))

    def byte(self) -> int:
        c = self.s[self.i]
        self.i += 1
        if c != "\\":
            return ord(c)
        c = self.s[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.s[self.i - 2 : self.i], 16)
        return {"n": 10, "t": 9, "r": 13}.get(c) or ord(c)

    def members(self) -> frozenset[int]:
        self.i += 1
        inverse = self.s[self.i] == "^"
        self.i += inverse
        found: set[int] = set()
        while self.s[self.i] != "]":
            low = self.byte()
            if self.s[self.i] == "-" and self.s[self.i + 1] != "]":
                self.i += 1
                found |= set(range(low, self.byte() + 1))
            else:
                found.add(low)
        self.i += 1
        found = set(self.cased(found))
        return frozenset(range(256)) - found if inverse else frozenset(found)

    def cased(self, members: set[int]) -> frozenset[int]:
        if self.any_case:
            members = members | {b ^ 32 for b in members if (b | 32) in LETTERS}
        return frozenset(members)


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append(None)
        return len(self.empty) - 1

    def add(self, node, start: int) -> int:
        """The end of what recognises node from start."""
        if node[0] == "set":
            end = self.state()
            at = self.state()
            self.empty[start].append(at)
            self.moves[at] = (node[1], end)
            return end
        if node[0] == "cat":
            for part in node[1]:
                start = self.add(part, start)
            return start
        if node[0] == "alt":
            end = self.state()
            for branch in node[1]:
                begin = self.state()
                self.empty[start].append(begin)
                self.empty[self.add(branch, begin)].append(end)
            return end
        _, part, least, most = node
        for _ in range(least):
            start = self.add(part, start)
        if most is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.add(part, loop)].append(loop)
            return loop
        end = self.state()
        self.empty[start].append(end)
        for _ in range(most - least):
            start = self.add(part, start)
            self.empty[start].append(end)
        return end


def _shortest(node):
    """The same pattern without what an open repeat at its end adds: where it matches is the same, and states are far fewer."""
    if node[0] == "cat" and node[1]:
        return ("cat", [*node[1][:-1], _shortest(node[1][-1])])
    if node[0] == "rep" and node[3] is None and node[2]:
        return ("rep", node[1], node[2], node[2])
    return node


@dataclass(frozen=True)
class Automaton:
    """next[state, class_of[byte]]; accepts[state]: bit k if pattern k has matched; dead: the state that nothing leaves, or -1."""

    class_of: np.ndarray
    next: np.ndarray
    accepts: np.ndarray
    start: int
    dead: int


def compile_patterns(patterns: list[tuple[str, bool]], anywhere: bool) -> Automaton:
    """patterns: pattern and whether letters match in either case.

    anywhere: a match may begin at any byte, and the automaton tells only that there is one; else at the first byte, and it tells every end.
    """
    nfa = _Nfa()
    root = nfa.state()
    ends = {}
    for k, (pattern, any_case) in enumerate(patterns):
        begin = nfa.state()
        nfa.empty[root].append(begin)
        tree = _Parser(pattern, any_case).parse()
        ends[nfa.add(_shortest(tree) if anywhere else tree, begin)] = 1 << k

    signature = [[] for _ in range(256)]
    for at, move in enumerate(nfa.moves):
        if move:
            for b in move[0]:
                signature[b].append(at)
    kinds: dict[tuple, int] = {}
    class_of = np.array([kinds.setdefault(tuple(s), len(kinds)) for s in signature], np.uint8)
    sample = [int(np.flatnonzero(class_of == k)[0]) for k in range(len(kinds))]

    def closed(states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in nfa.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)

    first = closed([root])
    number, todo, rows = {first: 0}, [first], []
    while todo:
        subset = todo.pop(0)
        row = []
        for b in sample:
            after = [nfa.moves[x][1] for x in subset if nfa.moves[x] and b in nfa.moves[x][0]]
            target = closed(after + [root]) if anywhere else closed(after)
            if target not in number:
                number[target] = len(number)
                todo.append(target)
            row.append(number[target])
        rows.append(row)
    table = np.array(rows, np.int64)
    accepts = np.array([sum({ends[x] for x in subset if x in ends}) for subset in number], np.int64)

    block = np.unique(accepts, return_inverse=True)[1]
    while True:  # states stay together while they go to the same blocks
        finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    kept = np.unique(block, return_index=True)[1]
    small, accepts = block[table[kept]], accepts[kept]
    still = np.flatnonzero((small == np.arange(len(small))[:, None]).all(1) & (accepts == 0))
    dead = int(still[0]) if len(still) and not anywhere else -1
    return Automaton(class_of, small.astype(np.int32), accepts, int(block[0]), dead)


def resets(automaton: Automaton) -> np.ndarray:
    """For each byte, whether it brings every state back to the start: matches never hold it, so texts can be cut there."""
    return (automaton.next == automaton.start).all(0)[automaton.class_of]


#: Pieces still open below which the rest of each is walked alone: a step of all costs about as much as so many single ones.
FEW_LANES = 48


def scan(automaton: Automaton, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Run the automaton over pieces of data at once, one byte of each a step.

    Returns for each piece the bits of all patterns that match somewhere in it.
    """
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    found = np.zeros(len(order), np.int64)
    if len(order):
        flat = (automaton.next * automaton.next.shape[1]).ravel()
        bits = automaton.accepts
        wide = automaton.next.shape[1]
        classes = automaton.class_of[data]
        state = np.full(len(order), automaton.start * wide, np.int32)
        # pieces are sorted by length, so those that are open are the first ones
        together = int(lengths[min(FEW_LANES, len(order)) - 1]) if len(order) >= FEW_LANES else 0
        for p, n in enumerate(np.searchsorted(-lengths, -np.arange(together), side="left").tolist()):
            state[:n] = flat[state[:n] + classes[starts[:n] + p]]
            hit = bits[state[:n] // wide]
            if hit.any():
                found[:n] |= hit
        after, hits = flat.tolist(), {s * wide: int(b) for s, b in enumerate(bits.tolist()) if b}
        for k in np.flatnonzero(lengths > together).tolist():
            at, seen = int(state[k]), 0
            for c in classes[starts[k] + together : starts[k] + lengths[k]].tobytes():
                at = after[at + c]
                if at in hits:
                    seen |= hits[at]
            found[k] |= seen
    out = np.zeros(len(order), np.int64)
    out[order] = found
    return out


def matches(automaton: Automaton, text: bytes) -> list[tuple[int, int]]:
    """Leftmost non-overlapping longest matches of a one-pattern automaton that begins at the first byte.

    States from which no match ends are noted where they were met, so each place is walked once in each state at most, and
    the time is linear in the text.
    """
    table, accepts, kinds, dead = automaton.next.tolist(), automaton.accepts.tolist(), automaton.class_of.tolist(), automaton.dead
    codes = [kinds[b] for b in text]
    opening = [row != dead for row in table[automaton.start]]
    hopeless: set[tuple[int, int]] = set()
    out, i, n = [], 0, len(codes)
    while i < n:
        if not opening[codes[i]]:
            i += 1
            continue
        state, end, j, walked = automaton.start, -1, i, []
        while j < n:
            state = table[state][codes[j]]
            j += 1
            if state == dead or (j, state) in hopeless:
                break
            walked.append((j, state))
            if accepts[state]:
                end, walked = j, []
        hopeless.update(walked)
        if end > i:
            out.append((i, end))
            i = end
        else:
            i += 1
    return out
