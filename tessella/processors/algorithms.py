"""Algorithms over one small file, chosen by its metadata: for tables use the operators.

A graph is lines ``a b [weight]``, numbers from 0; sets, texts and leaves are
lines.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import math
from collections.abc import Callable, Iterator

Graph = dict[int, list[tuple[int, float]]]


def read_graph(text: str, directed: bool) -> Graph:
    graph: Graph = {}
    for line in text.splitlines():
        parts = line.replace(",", " ").split()
        if len(parts) < 2:
            continue
        a, b, w = int(parts[0]), int(parts[1]), float(parts[2]) if len(parts) > 2 else 1.0
        graph.setdefault(a, []).append((b, w))
        graph.setdefault(b, [])
        if not directed:
            graph[b].append((a, w))
    return graph


def breadth_first(graph: Graph, start: int = 0) -> list[int]:
    out, seen = [start], {start}
    for node in out:
        for other, _ in graph.get(node, ()):
            if other not in seen:
                seen.add(other)
                out.append(other)
    return out


def depth_first(graph: Graph, start: int = 0) -> list[int]:
    out, stack, seen = [], [start], set()
    while stack:
        node = stack.pop()
        if node not in seen:
            seen.add(node)
            out.append(node)
            stack += [other for other, _ in reversed(graph.get(node, ()))]
    return out


def distances(graph: Graph, start: int = 0, goal: int | None = None, guess: Callable[[int], float] = lambda _: 0.0) -> tuple[dict[int, float], dict[int, int]]:
    """Distances and previous nodes; with a goal the search ends there, led by a guess that never says too much."""
    best, before, heap, done = {start: 0.0}, {}, [(guess(start), start)], set()
    while heap:
        _, node = heapq.heappop(heap)
        if node in done:
            continue
        done.add(node)
        if node == goal:
            break
        for other, weight in graph.get(node, ()):
            offer = best[node] + weight
            if offer < best.get(other, math.inf):
                best[other], before[other] = offer, node
                heapq.heappush(heap, (offer + guess(other), other))
    return best, before


def route(graph: Graph, start: int, goal: int, guess: Callable[[int], float] = lambda _: 0.0) -> tuple[float, list[int]] | None:
    best, before = distances(graph, start, goal, guess)
    if goal not in best:
        return None
    path = [goal]
    while path[-1] != start:
        path.append(before[path[-1]])
    return best[goal], path[::-1]


def strong_components(graph: Graph) -> list[list[int]]:
    """Nodes that reach each other: finished in order, then collected against the edges."""
    order, seen = [], set()
    for root in graph:
        stack = [(root, iter(graph[root]))] if root not in seen else []
        seen.add(root)
        while stack:
            node, rest = stack[-1]
            for other, _ in rest:
                if other not in seen:
                    seen.add(other)
                    stack.append((other, iter(graph[other])))
                    break
            else:
                order.append(node)
                stack.pop()
    back: dict[int, list[int]] = {n: [] for n in graph}
    for a, outs in graph.items():
        for b, _ in outs:
            back[b].append(a)
    out, used = [], set()
    for root in reversed(order):
        if root in used:
            continue
        part, stack = [], [root]
        used.add(root)
        while stack:
            node = stack.pop()
            part.append(node)
            for other in back[node]:
                if other not in used:
                    used.add(other)
                    stack.append(other)
        out.append(sorted(part))
    return sorted(out)


def ranks(graph: Graph, damping: float = 0.85, rounds: int = 20) -> dict[int, float]:
    n = len(graph)
    rank = dict.fromkeys(graph, 1 / n) if n else {}
    for _ in range(rounds):
        loose = sum(r for k, r in rank.items() if not graph[k])
        new = dict.fromkeys(graph, (1 - damping) / n + damping * loose / n)
        for a, outs in graph.items():
            for b, _ in outs:
                new[b] += damping * rank[a] / len(outs)
        rank = new
    return rank


def merkle(lines: list[str]) -> str | None:
    level = [hashlib.sha256(x.encode()).hexdigest() for x in lines]
    while len(level) > 1:
        level = [hashlib.sha256((level[i] + level[i + 1]).encode()).hexdigest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else None


def _hash(token: str) -> int:
    return int.from_bytes(hashlib.sha256(token.encode()).digest()[:8], "little")


def min_hashes(tokens: set[str], k: int = 128) -> list[int]:
    return [min((_hash(t) * (1000003 * (i + 1) + 1000009) % (1 << 64) for t in tokens), default=(1 << 64) - 1) for i in range(k)]


def sim_hash(tokens: list[str]) -> int:
    votes = [sum(1 if _hash(t) >> b & 1 else -1 for t in tokens) for b in range(64)]
    return sum(1 << b for b, v in enumerate(votes) if v > 0)


def distinct(tokens: list[str], p: int = 12) -> float:
    registers = [0] * (1 << p)
    for t in tokens:
        h = _hash(t)
        rest = h & (1 << 64 - p) - 1
        registers[h >> 64 - p] = max(registers[h >> 64 - p], 64 - p - rest.bit_length() + 1)
    m, empty = 1 << p, registers.count(0)
    raw = 0.7213 / (1 + 1.079 / m) * m * m / sum(2.0**-r for r in registers)
    return m * math.log(m / empty) if raw <= 5 * m and empty else raw


def _two(text: str) -> tuple[list[str], list[str]]:
    lines = [line.split() for line in text.splitlines() if line.strip()]
    return (lines[0] if lines else []), (lines[1] if len(lines) > 1 else [])


def _jaccard(text: str) -> float:
    a, b = map(set, _two(text))
    return len(a & b) / len(a | b) if a | b else 1.0


def _cosine(text: str) -> float:
    a, b = ([float(x) for x in part] for part in _two(text))
    size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=False)) / size if size else 0.0


def _shortest(text: str, directed: bool) -> dict[str, object]:
    graph = read_graph(text, directed)
    goal = max(graph, default=0)
    found = route(graph, 0, goal, lambda n: 0.0)
    return {"goal": goal, "distance": found[0] if found else None, "path": found[1] if found else []}


def _slots(text: str) -> float:
    a, b = (min_hashes(set(part)) for part in _two(text))
    return sum(x == y for x, y in zip(a, b, strict=True)) / len(a)


def _bands(text: str) -> bool:
    a, b = (min_hashes(set(part)) for part in _two(text))
    return any(a[i:i + 4] == b[i:i + 4] for i in range(0, len(a), 4))


#: Algorithms by the name that a file's metadata gives.
ALGORITHMS: dict[str, Callable[[str, bool], object]] = {
    "bfs": lambda t, d: breadth_first(read_graph(t, d)), "dfs": lambda t, d: depth_first(read_graph(t, d)), "dijkstra": lambda t, d: {str(k): v for k, v in sorted(distances(read_graph(t, d))[0].items())},
    "shortest_path": _shortest, "astar": _shortest, "tarjan": lambda t, d: strong_components(read_graph(t, d)), "kosaraju": lambda t, d: strong_components(read_graph(t, d)),
    "pagerank": lambda t, d: {str(k): v for k, v in sorted(ranks(read_graph(t, d)).items())}, "jaccard": lambda t, d: _jaccard(t), "cosine": lambda t, d: _cosine(t), "minhash": lambda t, d: _slots(t), "lsh": lambda t, d: _bands(t),
    "simhash": lambda t, d: f"{sim_hash(t.split()):016x}", "hyperloglog": lambda t, d: distinct(t.split()), "merkle": lambda t, d: merkle(t.splitlines()), "inverted_index": lambda t, d: {w: [i for i, line in enumerate(t.splitlines()) if w in line.split()] for w in sorted(set(t.split()))},
}


def process(data: bytes, meta: dict[str, str]) -> Iterator[tuple[str, str, dict[str, str]]]:
    name = meta.get("algorithm", "")
    if name not in ALGORITHMS:
        raise ValueError(f"no algorithm is named {name!r}")
    directed = meta.get("directed", "false") == "true"
    yield "algorithm.result", json.dumps(ALGORITHMS[name](data.decode(), directed)), {"algorithm": name}
