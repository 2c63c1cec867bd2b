"""Wagner-Fischer alignment of conversation turns to the strings of an alternating grammar.

A repaired conversation reads ``(s?(ua)+)?`` in role initials. A turn is told by its role
initial and by its fault, in two letters: the initial (``x`` if it is none of ``sua``) and
``-`` (sound), ``b`` or ``d`` (blank or duplicate, must be deleted) or ``t`` (truncated, costs
extra if it stays). A sequence of edits is its audit: a letter each of D(elete), I(nsert),
K(eep), R(erole).

What of the grammar string is still to come depends on one of four states, so a long
conversation can be aligned in blocks, each from every state to every state.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

# What an edit costs.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

# Nothing yet; after the system turn; a user turn is next; an assistant turn is next.
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTED = (START, USER)

# Work on a block grows with the cube of its faults, so blocks are short.
BLOCK = 32

_NEVER = 1 << 60


def target(state: int, system: bool, length: int) -> tuple[str, int]:
    """The grammar string of ``length`` from ``state``, with a system turn or not, and the state after it."""
    text, left = "", length
    if system:
        text, left, state = "s", length - 1, SYSTEM
    pair = "au" if state == ASSISTANT else "ua"
    text += (pair * (left // 2 + 1))[:left]
    if left:
        state = ASSISTANT if text[-1] == "u" else USER
    return text, state


@lru_cache(1 << 16)
def repairs(turns: str, state: int = START, final: bool = True) -> dict[int, tuple[int, str]]:
    """For each state reached the least cost, and of the audits of that cost the first in ASCII order.

    Strings of each feasible length are aligned, those nearest the number of turns first.
    The best cost so far of a state bounds the lengths that can still reach it, and the
    band of cells that are visited. Unless ``final``, no audit ends with an insertion: it
    would stand before the next block's first turn.
    """
    n = len(turns) // 2
    best: dict[int, tuple[int, str]] = {}
    for system in (False, True) if state == START else (False,):
        # To delete all and insert the shortest string (two at most) costs no less than the best: no longer one can cost that little.
        longest = n + (DELETE * n + INSERT * 2) // INSERT
        for length in sorted(range(system, longest + 1), key=lambda length: (_apart(n, length), length)):
            wanted, reached = target(state, system, length)
            incumbent = best.get(reached, (DELETE * n + INSERT * length, ""))[0]
            if _apart(n, length) <= incumbent:
                found = _align(turns, wanted, incumbent, final)
                if found is not None:
                    best[reached] = min(found, best.get(reached, found))
    return best


def _apart(n: int, length: int) -> int:
    """The least that ``n`` turns and a string of ``length`` cost by their lengths alone."""
    return (length - n) * INSERT if length > n else (n - length) * DELETE


def blocks_of(turns: str) -> list[str]:
    """A conversation in blocks of at most ``BLOCK`` turns; one without turns is one block."""
    return [turns[i : i + 2 * BLOCK] for i in range(0, len(turns), 2 * BLOCK)] or [""]


def path(tables: list[list[dict[int, tuple[int, str]]]]) -> tuple[int, list[tuple[int, str]]]:
    """Cost of a whole conversation's repair, and the state before and the audit of each block.

    ``tables`` holds for each block and state what ``repairs`` tells. Two audits of one
    block from one state never begin alike, so among ways of equal cost the one of least
    letters is found block by block, from the last.
    """
    ahead = {state: (0, 0, "") for state in ACCEPTED}
    chosen = []
    for table in reversed(tables):
        here = {}
        for state, reached in enumerate(table):
            ways = [
                (cost + ahead[after][0], audit, after) for after, (cost, audit) in reached.items() if after in ahead
            ]
            if ways:
                cost, audit, after = min(ways)
                here[state] = (cost, after, audit)
        chosen.append({state: (after, audit) for state, (_, after, audit) in here.items()})
        ahead = here
    state, audits = START, []
    for step in reversed(chosen):
        after, audit = step[state]
        audits.append((state, audit))
        state = after
    return ahead[START][0], audits


def best_repair(turns: str) -> tuple[int, str]:
    """Cost of the cheapest repair of a whole conversation, and its audit."""
    blocks = blocks_of(turns)
    if len(blocks) == 1:
        found = repairs(turns)
        return min(found[state] for state in ACCEPTED if state in found)
    cost, audits = path([block_table(b, i == len(blocks) - 1) for i, b in enumerate(blocks)])
    return cost, "".join(audit for _, audit in audits)


def block_table(turns: str, final: bool) -> list[dict[int, tuple[int, str]]]:
    """What ``repairs`` tells from each state."""
    return [repairs(turns, state, final) for state in range(4)]


def _align(turns: str, wanted: str, incumbent: int, final: bool) -> tuple[int, str] | None:
    """Cost and audit of ``turns`` against one string, if it costs ``incumbent`` or less.

    ``costs[i][j - low[i]]`` is the cost of what follows turn ``i`` and character ``j``.
    """
    n, m = len(turns) // 2, len(wanted)
    shift = m - n
    # A path that leaves the diagonals between its ends comes back: one insertion, one deletion.
    slack = (incumbent - (shift * INSERT if shift > 0 else -shift * DELETE)) // (INSERT + DELETE)
    lowest, highest = min(0, shift) - slack, max(0, shift) + slack
    inserted = [INSERT if c != "s" else _NEVER for c in wanted]
    rows: list[list[int]] = [[]] * (n + 1)
    lows = [max(0, i + lowest) for i in range(n + 1)]
    for i in range(n, -1, -1):
        low, high = lows[i], min(m, i + highest)
        row = [_NEVER] * (high - low + 1)
        if i < n:
            below, below_low = rows[i + 1], lows[i + 1]
            below_high = below_low + len(below) - 1
            role, fault = turns[2 * i], turns[2 * i + 1]
            extra = TRUNCATED if fault == "t" else 0
        for j in range(high, low - 1, -1):
            cost = 0 if i == n and j == m else _NEVER
            if j < high and (final or i < n):
                cost = min(cost, row[j + 1 - low] + inserted[j])
            if i < n:
                if below_low <= j <= below_high:
                    cost = min(cost, below[j - below_low] + DELETE)
                if j < m and fault not in "bd" and below_low <= j + 1 <= below_high:
                    change = extra if role == wanted[j] else extra + REROLE if wanted[j] != "s" else _NEVER
                    cost = min(cost, below[j + 1 - below_low] + change)
            row[j - low] = cost
        rows[i] = row
    total = rows[0][0]
    if total > incumbent:
        return None
    return total, _first_audit(turns, wanted, rows, lows, inserted, final)


def _first_audit(turns, wanted, rows, lows, inserted, final) -> str:
    """Of the paths of least cost the one whose letters come first, walked from the start."""
    n, m = len(turns) // 2, len(wanted)

    def cost(i, j):
        at = j - lows[i]
        return rows[i][at] if 0 <= at < len(rows[i]) else _NEVER

    audit, i, j = [], 0, 0
    while i < n or j < m:
        here = cost(i, j)
        if i < n and cost(i + 1, j) + DELETE == here:
            audit.append("D")
            i += 1
        elif j < m and (final or i < n) and cost(i, j + 1) + inserted[j] == here:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if turns[2 * i] == wanted[j] else "R")
            i, j = i + 1, j + 1
    return "".join(audit)


def edits(audit: str, turns: str, state: int) -> Iterator[tuple[str, str, int]]:
    """For each letter of an audit: the letter, the role initial it gives (none if deleted), the state after."""
    i = 0
    for letter in audit:
        role = ""
        if letter != "D":
            role = turns[2 * i] if letter == "K" else "a" if state == ASSISTANT else "u"
            state = {"s": SYSTEM, "u": ASSISTANT, "a": USER}[role]
        i += letter != "I"
        yield letter, role, state
