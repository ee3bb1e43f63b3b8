"""Double-array tries over sequences of word numbers, advanced at all positions of a text at once."""

from __future__ import annotations

import numpy as np

from postlens.llm.shared import by_value

by_value(__name__)

DIGIT = 256
#: Slots among which a node's base is looked for before the next ones are opened.
WINDOW = 4096


class Trie:
    """Sequences of `length` numbers from 1 on, each number given by `digits` digits of eight bits.

    A state s goes with digit d to base[s] + d, if check of that slot is s. Nodes with several children get the first base
    in a window of slots where all their children's slots are free; nodes with one child then fill what is left, so
    few slots stay empty. `accept` has a sequence's row at its last state."""

    def __init__(self, rows: np.ndarray, digits: int):
        """`rows`: distinct sequences, one to a row."""
        self.rows, self.digits = rows, digits
        n, length = rows.shape
        self.length = length
        shifts = 8 * np.arange(digits)[::-1]
        steps = ((rows[:, :, None] >> shifts) & 255).reshape(n, length * digits)
        order = np.lexsort(steps.T[::-1]) if n else np.zeros(0, np.int64)
        steps = steps[order]
        # No child lies in the first slots, one of which is the root's, so bases are never negative.
        states = np.zeros(n, np.int64)
        new = np.zeros(n, bool)
        new[:1] = True
        self.base, self.check = np.zeros(DIGIT, np.int32), np.full(DIGIT, -1, np.int32)
        used = np.ones(DIGIT, bool)
        for depth in range(steps.shape[1]):
            digit = steps[:, depth]
            child = new.copy()
            child[1:] |= digit[1:] != digit[:-1]
            first = np.flatnonzero(new)
            edges = np.flatnonzero(child)
            node = np.searchsorted(first, edges, "right") - 1
            counts = np.bincount(node, minlength=len(first))
            bases = np.zeros(len(first), np.int64)
            ends = np.cumsum(counts)
            many = np.flatnonzero(counts > 1)
            bases[many] = self._bases([digit[edges[ends[i] - counts[i] : ends[i]]].tolist() for i in many], len(used))
            top = max(len(used), int(bases.max(initial=0)) + DIGIT)
            used = np.append(used, np.zeros(top - len(used), bool))
            wide = counts[node] > 1
            used[bases[node[wide]] + digit[edges[wide]]] = True
            one = np.flatnonzero(counts == 1)
            free = np.flatnonzero(~used)[: len(one)]
            free = np.append(free, np.arange(len(used), len(used) + len(one) - len(free)))
            used = np.append(used, np.zeros(-(-max(0, int(free.max(initial=0)) + 1 - len(used)) // DIGIT) * DIGIT, bool))
            used[free] = True
            bases[one] = free - digit[edges[~wide]]
            self.base = np.append(self.base, np.zeros(len(used) + DIGIT - len(self.base), np.int32))
            self.check = np.append(self.check, np.full(len(used) + DIGIT - len(self.check), -1, np.int32))
            self.base[states[first]] = bases
            slots = bases[node] + digit[edges]
            self.check[slots] = states[edges]
            states = slots[np.cumsum(child) - 1] if n else states
            new = child
        self.accept = np.full(len(self.base), -1, np.int32)
        self.accept[states] = order

    @staticmethod
    def _bases(nodes: list[list[int]], begin: int) -> list[int]:
        """A base from `begin` on for each node, so that the children's slots are all different; most children first.

        The bits of an integer are the taken slots of the window: shifted right by a digit they are the bases that
        this digit rules out, so one expression finds all bases that are free for a node."""
        out, taken, everywhere = [0] * len(nodes), 0, (1 << WINDOW) - 1
        for i in sorted(range(len(nodes)), key=lambda i: -len(nodes[i])):
            while True:
                ruled_out = 0
                for d in nodes[i]:
                    ruled_out |= taken >> d
                free = ~ruled_out & everywhere
                if free:
                    break
                taken, begin = taken >> WINDOW, begin + WINDOW
            at = (free & -free).bit_length() - 1
            for d in nodes[i]:
                taken |= 1 << (at + d)
            out[i] = begin + at
        return out

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of `ids` where a sequence begins, and that sequence's row.

        The states of all positions take one digit at a time; positions without a transition leave. A 0 is no number,
        so no sequence goes over it."""
        padded = np.append(ids, np.zeros(self.length, ids.dtype))
        parts = [(padded >> (8 * j) & 255).astype(np.int32) for j in reversed(range(self.digits))]
        at, states = np.arange(len(ids)), np.zeros(len(ids), np.int32)
        for word in range(self.length):
            for part in parts:
                following = self.base[states] + part[at + word]
                alive = np.flatnonzero(self.check[following] == states)
                at, states = at[alive], following[alive]
        return at, self.accept[states]
