"""Machines over one key's rows in order whose state is compact."""

from __future__ import annotations

from collections import deque


class LargestRectangle:
    """The largest area under bars of ``v``, by a stack of rising bars."""

    def __init__(self):
        self.stack, self.best, self.at = [], 0, 0

    def step(self, v):
        start = self.at
        while self.stack and self.stack[-1][1] >= v:
            start, height = self.stack.pop()
            self.best = max(self.best, height * (self.at - start))
        self.stack.append((start, v))
        self.at += 1
        return ()

    def finish(self):
        return [(max([self.best, *(h * (self.at - s) for s, h in self.stack)]),)]


class LongestWithin:
    """The longest run whose sum of ``v`` (none negative) keeps to a budget."""

    def __init__(self, budget: int):
        self.budget, self.run, self.total, self.best = budget, deque(), 0, 0

    def step(self, v):
        self.run.append(v)
        self.total += v
        while self.total > self.budget:
            self.total -= self.run.popleft()
        self.best = max(self.best, len(self.run))
        return ()

    def finish(self):
        return [(self.best,)] if self.best else []


class Split:
    """Subset sums as the bits of one number: the split of all values nearest to half."""

    def __init__(self):
        self.bits, self.total = 1, 0

    def step(self, v):
        self.bits |= self.bits << v
        self.total += v
        return ()

    def finish(self):
        near = self.bits & ((1 << (self.total // 2 + 1)) - 1)
        below = near.bit_length() - 1  # the largest sum up to half; sums are symmetric about it
        return [(self.total - 2 * below, 2 * below == self.total)]


class Halves:
    """Whether a sum of some values of each half makes the target; each half's sums are bits of one number."""

    def __init__(self, target: int):
        self.target, self.sums, self.at = target, [1, 1], 0

    def step(self, v):
        side, self.at = self.at % 2, self.at + 1
        self.sums[side] |= (self.sums[side] << v) & ((1 << (self.target + 1)) - 1)
        return ()

    def finish(self):
        one, two = self.sums
        two = int(f"{two:0{self.target + 1}b}"[::-1], 2)  # bit i: target - i
        return [((one & two) != 0,)]


class Stretch:
    """The pairs of rows out of order, by a merge of sorted runs of doubling length."""

    def __init__(self):
        self.runs, self.count = [], 0

    def _merge(self, a: list, b: list) -> list:
        out, i = [], 0
        for x in b:
            while i < len(a) and a[i] <= x:
                out.append(a[i])
                i += 1
            self.count += len(a) - i
            out.append(x)
        return out + a[i:]

    def step(self, v):
        run = [v]
        while self.runs and len(self.runs[-1]) <= len(run):
            run = self._merge(self.runs.pop(), run)
        self.runs.append(run)
        return ()

    def finish(self):
        while len(self.runs) > 1:
            last = self.runs.pop()
            self.runs.append(self._merge(self.runs.pop(), last))
        return [(self.count,)] if self.count else []
