"""One tree held in a row: lists of ids, or values by path."""

from __future__ import annotations


def from_pre_in(pre: list[int], inside: list[int]) -> list[dict]:
    place, out = {x: i for i, x in enumerate(inside)}, []
    spans = [(0, 0, len(pre), 0)]  # start in pre, start in inside, size, parent
    while spans:
        p, i, n, parent = spans.pop()
        if n:
            root = pre[p]
            left = place[root] - i
            out.append({"id": root, "parent": parent})
            spans += [(p + 1, i, left, root), (p + 1 + left, i + left + 1, n - left - 1, root)]
    return out


def from_in_post(inside: list[int], post: list[int]) -> list[dict]:
    """The post-order list backwards is a pre-order that goes right first."""
    return from_pre_in(post[::-1], inside[::-1])


def write(nodes: dict[str, int], path: str = "") -> str:
    return f"{nodes[path]} {write(nodes, path + 'L')} {write(nodes, path + 'R')}" if path in nodes else "#"


def read(text: str) -> list[dict]:
    tokens, out = iter(text.split()), []

    def node(parent: int) -> None:
        if (t := next(tokens)) != "#":
            out.append({"id": int(t), "parent": parent})
            node(int(t))
            node(int(t))

    node(0)
    return out


def write_part(nodes: dict[str, tuple[int, int]]) -> str:
    """Part of a tree as text, from (id, parent) by path: each tree of it in order, its root's parent and side (0 for none) before its pre-order text;
    # is also where a child is in another part."""
    ids = {path: x for path, (x, _) in nodes.items()}
    roots = sorted(path for path in nodes if not path or path[:-1] not in nodes)
    return " ".join(f"{nodes[p][1]}{p[-1:]} {write(ids, p)}" for p in roots)


def read_part(text: str) -> list[dict]:
    tokens, out = iter(text.split()), []
    for head in tokens:
        open_ = [int(head.rstrip("LR"))]
        while open_:
            parent = open_.pop()
            if (t := next(tokens)) != "#":
                out.append({"id": int(t), "parent": parent})
                open_ += [int(t)] * 2
    return out


def balanced(lo: int, hi: int, parent: int = 0) -> list[dict]:
    if lo > hi:
        return []
    mid = (lo + hi) // 2
    return [{"id": mid, "parent": parent}, *balanced(lo, mid - 1, mid), *balanced(mid + 1, hi, mid)]


def all_bsts(lo: int, hi: int) -> list[str]:
    if lo > hi:
        return ["#"]
    return [f"{m} {a} {b}" for m in range(lo, hi + 1) for a in all_bsts(lo, m - 1) for b in all_bsts(m + 1, hi)]


def _up(vals: dict[str, int]):
    return sorted(vals, key=len, reverse=True)


def best_path(vals: dict[str, int]) -> int:
    down, best = {}, None
    for p in _up(vals):
        a, b = (max(0, down.get(p + s, 0)) for s in "LR")
        down[p] = vals[p] + max(a, b)
        best = max(vals[p] + a + b, vals[p] + a + b if best is None else best)
    return best


def independent(vals: dict[str, int]) -> int:
    take, skip = {}, {}
    for p in _up(vals):
        take[p] = vals[p] + sum(skip.get(p + s, 0) for s in "LR")
        skip[p] = sum(max(take.get(p + s, 0), skip.get(p + s, 0)) for s in "LR")
    return max(take.get("", 0), skip.get("", 0))
