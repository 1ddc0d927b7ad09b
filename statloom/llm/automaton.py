"""A deterministic automaton over many small patterns, run over many overlapping chunks at once.

Patterns are literals, classes ``[a-z_]``, groups ``(a|b)``, the marks ``? * + {m} {m,}`` and ``^`` for the start of a line.  They are combined into one
NFA with a restart at every character, made deterministic by subset construction, and stepped with numpy: one
lane per chunk of the text, so a step costs one table look-up for thousands of chunks.  Without restarts the automaton
tells where the longest match from a place ends, and of which patterns.
"""

from __future__ import annotations

import numpy as np

CHUNK = 1024
OVERLAP = 192


class Automaton:
    """Case-insensitive over ASCII unless ``cased``; every other character is one class that no pattern but ``[^...]`` accepts."""

    def __init__(self, patterns: list[str], restart: bool = True, cased: bool = False):
        self._cased = cased
        self._next: list[list[tuple[frozenset[int], int]]] = []
        self._skip: list[list[int]] = []
        self._line: list[list[int]] = []
        self._final: dict[int, int] = {}
        roots = []
        for n, pattern in enumerate(patterns):
            self._text, self._at = pattern, 0
            a, b = self._either()
            if self._at != len(pattern):
                raise ValueError(f"cannot read pattern {pattern!r} at {self._at}")
            self._final[b] = n
            roots.append(a)
        self._build(roots, restart)

    # --- pattern to NFA
    def _state(self) -> int:
        self._next.append([])
        self._skip.append([])
        self._line.append([])
        return len(self._next) - 1

    def _either(self) -> tuple[int, int]:
        a, b = self._state(), self._state()
        while True:
            x, y = self._sequence()
            self._skip[a].append(x)
            self._skip[y].append(b)
            if self._text[self._at:self._at + 1] != "|":
                return a, b
            self._at += 1

    def _sequence(self) -> tuple[int, int]:
        first = last = self._state()
        while self._at < len(self._text) and self._text[self._at] not in "|)":
            begin = self._at
            x, y = self._atom()
            if self._text[self._at:self._at + 1] == "{":
                x, y = self._repeated(begin, x, y)
            mark = self._text[self._at:self._at + 1]
            if mark and mark in "?*+":
                self._at += 1
                a, b = self._state(), self._state()
                self._skip[a].append(x)
                self._skip[y].append(b)
                if mark in "?*":
                    self._skip[a].append(b)
                if mark in "*+":
                    self._skip[y].append(x)
                x, y = a, b
            self._skip[last].append(x)
            last = y
        return first, last

    def _repeated(self, begin: int, x: int, y: int) -> tuple[int, int]:
        """So many copies of an atom, with ``{m,}`` any number more of the last one."""
        close = self._text.index("}", self._at)
        least, more, _ = self._text[self._at + 1:close].partition(",")
        last = x
        for _ in range(int(least) - 1):
            self._at = begin
            last, end = self._atom()
            self._skip[y].append(last)
            y = end
        if more:
            self._skip[y].append(last)
        self._at = close + 1
        return x, y

    def _atom(self) -> tuple[int, int]:
        c = self._text[self._at]
        self._at += 1
        if c == "(":
            pair = self._either()
            self._at += 1
            return pair
        if c == "^":
            a, b = self._state(), self._state()
            self._line[a].append(b)
            return a, b
        if c == "[":
            end = self._text.index("]", self._at + 1)
            inner, self._at = self._text[self._at:end], end + 1
            negate = inner[0] == "^"
            inner = inner[negate:]
            chars: set[int] = set()
            i = 0
            while i < len(inner):
                if inner[i + 1:i + 2] == "-" and i + 2 < len(inner):
                    chars |= set(range(ord(inner[i]), ord(inner[i + 2]) + 1))
                    i += 3
                else:
                    chars.add(ord(inner[i]))
                    i += 1
            if negate:
                chars = set(range(129)) - chars - {10} - (set() if self._cased else set(range(65, 91)))
        else:
            if c == "\\":
                c = self._text[self._at]
                self._at += 1
            chars = {ord(c)}
        a, b = self._state(), self._state()
        self._next[a].append((frozenset(ord(chr(x).lower()) if x < 128 and not self._cased else x for x in chars), b))
        return a, b

    # --- NFA to table
    def _closure(self, states: set[int], line: bool = False) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            s = todo.pop()
            for t in self._skip[s] + self._line[s] * line:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    def _build(self, roots: list[int], restart: bool) -> None:
        sets = {s for row in self._next for s, _ in row}
        kinds: dict[tuple, int] = {}
        of = np.zeros(256, np.int64)
        for c in range(129):
            key = (c == 10, tuple(c in s for s in sets))
            of[c] = kinds.setdefault(key, len(kinds))
        if not self._cased:
            of[65:91] = of[97:123]
        of[128:] = of[128]
        sample = {k: next(c for c in range(129) if of[c] == k and (self._cased or not 65 <= c <= 90)) for k in set(of.tolist())}
        near = [self._closure({s}) for s in range(len(self._next))]
        moves: list[dict[int, frozenset[int]]] = []
        for edges in self._next:
            by: dict[int, frozenset[int]] = {}
            for chars, t in edges:
                for k, c in sample.items():
                    if c in chars and c != 10:
                        by[k] = by.get(k, frozenset()) | near[t]
            moves.append(by)
        start = frozenset().union(*(near[r] for r in roots))
        line = self._closure(set(roots), line=True)
        if not restart:
            self._without_restart(moves, self._closure(set(roots)), len(kinds), of)
            return
        again = [start.union(*(moves[s].get(k, ()) for s in start)) for k in range(len(kinds))]
        ids, rows, todo = {start: 0}, [], [start]
        hits: list[frozenset[int]] = []
        for now in todo:
            hits.append(frozenset(self._final[s] for s in now if s in self._final))
            more: dict[int, set[int]] = {}
            for s in now - start:
                for k, to in moves[s].items():
                    more.setdefault(k, set()).update(to)
            row = []
            for k in range(len(kinds)):
                c = sample.get(k, 10)
                to = line if c == 10 else again[k] | more[k] if k in more else again[k]
                if to not in ids:
                    ids[to] = len(ids)
                    todo.append(to)
                row.append(ids[to])
            rows.append(row)
        # accepting states get the highest numbers, so that one comparison finds them
        order = sorted(range(len(rows)), key=lambda s: bool(hits[s]))
        new = np.empty(len(rows), np.int64)
        new[order] = np.arange(len(rows))
        self.width = len(kinds)
        self.table = (new[np.array(rows)][order] * self.width).astype(np.int32).ravel()
        self.start = int(new[0]) * self.width
        self.first_hit = sum(not h for h in hits) * self.width
        self.hits = [hits[s] for s in order]
        self.of = of.astype(np.uint8)

    def _without_restart(self, moves: list[dict[int, frozenset[int]]], start: frozenset[int], n_kinds: int, of: np.ndarray) -> None:
        """Rows of the table as lists; the state without a way on is -1."""
        ids, todo, rows = {start: 0}, [start], []
        for now in todo:
            row = []
            for k in range(n_kinds):
                to = frozenset().union(*(moves[s].get(k, ()) for s in now))
                if to and to not in ids:
                    ids[to] = len(ids)
                    todo.append(to)
                row.append(ids[to] if to else -1)
            rows.append(row)
        self.rows, self.of = rows, of.astype(np.uint8)
        self.accepts = [frozenset(self._final[s] for s in now if s in self._final) for now in todo]

    def longest(self, data: np.ndarray, at: int) -> tuple[int, frozenset[int]]:
        """(end, patterns) of the longest match that begins at a place; end -1 without one."""
        state, end, found = 0, -1, frozenset()
        rows, accepts, step = self.rows, self.accepts, 256
        while at < len(data):
            for k in self.of[data[at:at + step]].tolist():
                state = rows[state][k]
                if state < 0:
                    return end, found
                at += 1
                if accepts[state]:
                    end, found = at, accepts[state]
            step = 16_384
        return end, found

    def ends(self, data: np.ndarray) -> np.ndarray:
        """Absolute positions (sorted, each once) at which a pattern ends."""
        return np.unique(self.hits_in(data)[0])

    def hits_in(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(absolute position, state) of the places at which patterns end, by position, each pair once.  ``data``: one byte per character, above 127 for non-ASCII.

        Chunks overlap; a pattern that is longer than the overlap is found if the part of it inside a chunk matches.
        """
        if not len(data):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        lanes = -(-len(data) // CHUNK)
        padded = np.full(lanes * CHUNK + OVERLAP, 10, np.uint8)
        padded[OVERLAP:OVERLAP + len(data)] = data
        kinds = self.of[padded]
        view = np.lib.stride_tricks.as_strided(kinds, (CHUNK + OVERLAP, lanes), (1, CHUNK))
        base = np.arange(lanes, dtype=np.int64) * CHUNK - OVERLAP
        state = np.full(lanes, self.start, np.int32)
        found = []
        for i in range(CHUNK + OVERLAP):
            state = self.table[state + view[i]]
            if int(state.max()) >= self.first_hit:
                hit = np.flatnonzero(state >= self.first_hit)
                found.append((base[hit] + i) * len(self.hits) + state[hit] // self.width)
        both = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        return both // len(self.hits), both % len(self.hits)
