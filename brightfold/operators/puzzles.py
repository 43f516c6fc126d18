"""Searches over one row's small board or list; exponential by nature, so rows bound their size."""

from __future__ import annotations

from collections import Counter, deque
from fractions import Fraction
from functools import lru_cache
from itertools import product

from .sequences import largest_rectangle


def combinations(values: list[int], target: int) -> list[list[int]]:
    """Ascending lists of values, repeats allowed, that add up to the target."""
    if target == 0:
        return [[]]
    return [[v, *rest] for i, v in enumerate(values) if v <= target for rest in combinations(values[i:], target - v)]


def sub_multisets(values: list[int]) -> list[list[int]]:
    counts = sorted(Counter(values).items())
    return [[v for (v, _), n in zip(counts, times) for _ in range(n)] for times in product(*(range(n + 1) for _, n in counts))]


def solve_sudoku(board: str) -> str | None:
    """The first solution in order of cells' fewest choices; none if there is none."""
    units = lambda i: {j for j in range(81) if j // 9 == i // 9 or j % 9 == i % 9 or (j // 27, j % 9 // 3) == (i // 27, i % 9 // 3)} - {i}
    beside = [units(i) for i in range(81)]
    if any(board[i] != "." and board[i] in {board[j] for j in beside[i]} for i in range(81)):
        return None

    def go(b: list[str]) -> list[str] | None:
        open_ = [(len(free := set("123456789") - {b[j] for j in beside[i]}), i, free) for i in range(81) if b[i] == "."]
        if not open_:
            return b
        _, i, free = min(open_, key=lambda x: x[0])
        for v in sorted(free):
            if found := go([*b[:i], v, *b[i + 1 :]]):
                return found
        return None

    solved = go(list(board))
    return "".join(solved) if solved else None


def slide(board: str, goal: str = "123456780") -> int:
    """Least moves of the blank (0) on a 3 by 3 board; -1 if the goal can't be reached."""
    seen, queue = {board}, deque([(board, 0)])
    while queue:
        b, n = queue.popleft()
        if b == goal:
            return n
        z = b.index("0")
        for j in (z - 3, z + 3, *([z - 1] if z % 3 else []), *([z + 1] if z % 3 < 2 else [])):
            if 0 <= j < 9:
                x = list(b)
                x[z], x[j] = x[j], x[z]
                if (s := "".join(x)) not in seen:
                    seen.add(s)
                    queue.append((s, n + 1))
    return -1


def _splits(values: tuple) -> set[tuple[tuple, tuple]]:
    """The ways to deal ascending values into two parts that aren't empty; the part that holds the first value first."""
    n = len(values)
    masks = range(1, 1 << n, 2)
    return {(tuple(v for i, v in enumerate(values) if m >> i & 1), tuple(v for i, v in enumerate(values) if not m >> i & 1)) for m in masks if m != (1 << n) - 1}


@lru_cache(1 << 14)
def _results(values: tuple) -> frozenset:
    """All that + - * / of all the ascending values, in any order and grouping, give."""
    if len(values) == 1:
        return frozenset(values)
    pairs = ((a, b) for x, y in _splits(values) for a in _results(x) for b in _results(y))
    return frozenset(r for a, b in pairs for r in (a + b, a - b, b - a, a * b, *([a / b] if b else []), *([b / a] if a else [])))


@lru_cache(1 << 14)
def _reaches(values: tuple, target: Fraction) -> bool:
    """The last step is looked up: for each result of the smaller part, what the other part would have to give."""
    if len(values) == 1:
        return values[0] == target
    for x, y in _splits(values):
        few, many = sorted((_results(x), _results(y)), key=len)
        for a in few:
            need = [target - a, a - target, a + target]
            need += [target / a, target * a] if a else []
            need += [a / target] if target and a else []
            if any(v in many for v in need) or not target and (not a or 0 in many and a):
                return True
    return False


def reaches(values: list, target) -> bool:
    """Whether + - * / of all values, in any order and grouping, give the target. What parts of a list give is kept, so lists of the same values
    are searched once a worker."""
    return bool(values) and _reaches(tuple(sorted(map(Fraction, values))), Fraction(target))


def ones_rectangle(grid: list[list[int]]) -> int:
    heights, best = [0] * len(grid[0]), 0
    for row in grid:
        heights = [h + 1 if v else 0 for h, v in zip(heights, row)]
        best = max(best, largest_rectangle(heights))
    return best


def ones_cross(grid: list[list[int]]) -> int:
    """Arm length of the largest X of ones (its centre alone is 1)."""
    n, m = len(grid), len(grid[0])

    def arm(r: int, c: int) -> int:
        k = 0
        while all(0 <= r + x * k < n and 0 <= c + y * k < m and grid[r + x * k][c + y * k] for x in (-1, 1) for y in (-1, 1)):
            k += 1
        return k

    return max(arm(r, c) for r in range(n) for c in range(m))
