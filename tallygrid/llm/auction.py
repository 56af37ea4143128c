"""The cheapest edits that make a sequence of roles a proper conversation, by the auction algorithm for shortest paths.

Node ``(i, q)`` of a lattice means that ``i`` rows are dealt with and what stands so far ends in state ``q``; arcs are edits
of integer cost. Each node has a price, never above its distance to the goal. A path grows from its origin: where the
price of its last node is below the least of arc and price beyond, the price rises to it and the path contracts by
that node; otherwise the path is extended by the best arc. When it reaches the goal, the prices along it are the exact
distances. Prices begin with what the rows left cost in any case, so that only the rest is bid for.

An arc is tight when its cost and the price beyond make up the price of its node. All cheapest paths consist of tight arcs
whose far ends are converged as well, so taking the first such letter at each node gives the least audit. No two arcs of a
node have the same letter.

Long sequences are cut into blocks, solved from the last to the first: the exact prices of a block's entry are those of
the exit of the one before, so that the work stays in proportion to the length.

Rows come as letters, one each: ``s``, ``u``, ``a`` for the initial of the role, ``o`` for any other, in capitals where the
text is truncated, and ``x`` for a row that must go.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

# The costs of edits, of which Keep is free.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
# What may follow a state: the initial and the next state. Only the first row may be the system's.
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ROLES = {USER: "user", ASSISTANT: "assistant"}
# The price of ending in a state: nothing at all, or after an answer; otherwise not allowed.
ENDS = (0, None, None, 0)
BLOCK = 64
GOAL = -1

Prices = tuple[int | None, ...]


class Lattice:
    """Layers of four states each; ``arcs[node]`` are ``(letter, cost, node)`` in order of the letters."""

    def __init__(self, layers: int, arcs: list[list[tuple[str, int, int]]], least: list[int], exits: Prices):
        """``least`` has for each layer what is at least paid from it to the last."""
        goal = min(p for p in exits if p is not None)
        self.price = [least[node // 4] + goal for node in range(4 * layers)] + [0]
        last = 4 * (layers - 1)
        # Nodes from which the goal can't be reached take no part.
        self.open = [False] * (4 * layers) + [True]
        self.arcs = [[] for _ in range(4 * layers)] + [[]]
        for q, price in enumerate(exits):
            if price is not None:
                self.arcs[last + q].append(("", price, GOAL))
        for layer in reversed(range(layers)):
            # Within a layer any state is at most three steps from another.
            for _ in range(3):
                for node in range(4 * layer, 4 * layer + 4):
                    self.open[node] = any(
                        self.open[target] for _, _, target in (*self.arcs[node], *arcs[node]))
        for node in range(4 * layers):
            self.arcs[node] += [arc for arc in arcs[node] if self.open[arc[2]]]
        self.exact = {GOAL}

    def converge(self, origin: int) -> int | None:
        """The exact price of a node, None where the goal can't be reached."""
        if not self.open[origin]:
            return None
        if origin in self.exact:
            return self.price[origin]
        price, arcs, path = self.price, self.arcs, [origin]
        while path[-1] not in self.exact:
            node = path[-1]
            best, ahead = min((cost + price[target], target) for _, cost, target in arcs[node])
            if price[node] < best:
                price[node] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(ahead)
        self.exact.update(path)
        return price[origin]

    def entries(self) -> Prices:
        return tuple(self.converge(q) for q in STATES)

    def trace(self, entry: int) -> tuple[str, int]:
        """The least letters of a cheapest path from an entry, and the state that it ends in."""
        self.converge(entry)
        node, letters = entry, []
        while True:
            for letter, cost, target in self.arcs[node]:
                if self.price[node] == cost + self.price[target] and self.price[node] == cost + self.converge(target):
                    break
            if target == GOAL:
                return "".join(letters), node % 4
            letters.append(letter)
            node = target


def _edits(row: str | None, q: int) -> list[tuple[str, int, int, int]]:
    """``(letter, cost, rows taken, next state)`` of the edits at a state before a row, or after the last."""
    found = [("D", DELETE, 1, q)] if row else []
    follow = NEXT[q]
    found += [("I", INSERT, 0, state) for initial, state in follow.items() if state in ROLES]
    if row and row != "x":
        extra, initial = (TRUNCATED, row.lower()) if row.isupper() else (0, row)
        if initial in follow:
            found.append(("K", extra, 1, follow[initial]))
        found += [("R", REROLE + extra, 1, state) for state in follow.values() if state in ROLES]
    return found


def _least(row: str) -> int:
    return DELETE if row == "x" or row.isupper() else REROLE if row == "o" else 0


def of_rows(code: str, exits: Prices = ENDS) -> Lattice:
    arcs = [[(letter, cost, 4 * (i + taken) + state) for letter, cost, taken, state in _edits(row, q)]
            for i, row in enumerate([*code, None]) for q in STATES]
    least = [0]
    for row in reversed(code):
        least.append(least[-1] + _least(row))
    return Lattice(len(code) + 1, arcs, least[::-1], exits)


def of_parts(tables: list[list[int | None]], exits: Prices) -> Lattice:
    """A lattice whose arcs are whole parts of a sequence, given their sixteen prices from state to state."""
    arcs = [[("", table[4 * q + r], 4 * (i + 1) + r) for r in STATES if table[4 * q + r] is not None]
            for i, table in enumerate(tables) for q in STATES]
    least = [0]
    for table in reversed(tables):
        least.append(least[-1] + min(cost for cost in table if cost is not None))
    return Lattice(len(tables) + 1, [*arcs, [], [], [], []], least[::-1], exits)


def _blocks(code: str, exits: Prices) -> list[Lattice]:
    """The lattices of the blocks of a sequence, in order, solved from the last."""
    found: list[Lattice] = []
    for at in reversed(range(0, max(len(code), 1), BLOCK)):
        found.append(of_rows(code[at:at + BLOCK], exits if not found else found[-1].entries()))
    return found[::-1]


def table_of(code: str) -> list[int | None]:
    """The prices of a sequence from each of the four states to each: element ``4 * entry + exit``."""
    columns = [_blocks(code, tuple(0 if q == exit_ else None for q in STATES))[0].entries() for exit_ in STATES]
    return [columns[exit_][entry] for entry in STATES for exit_ in STATES]


def traced(code: str, exits: Prices, entries: Iterable[int]) -> list[tuple[str, int] | None]:
    """For each entry its audit and the state it ends in, None where there is none."""
    blocks, found = _blocks(code, exits), []
    for entry in entries:
        if blocks[0].converge(entry) is None:
            found.append(None)
            continue
        letters, state = [], entry
        for block in blocks:
            part, state = block.trace(state)
            letters.append(part)
        found.append(("".join(letters), state))
    return found


@lru_cache(maxsize=20_000)
def solved(code: str) -> tuple[int, str]:
    """The cost and the audit of a whole sequence."""
    blocks = _blocks(code, ENDS)
    return blocks[0].converge(START), traced(code, ENDS, [START])[0][0]
