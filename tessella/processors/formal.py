"""Small notations: sets, graphs, categories, optimisation problems, temporal expressions."""

from __future__ import annotations

import re


def sets(text: str) -> list[list[str]]:
    """The sets of a text: ``{a,b}`` groups, or else lines in parts that ``---`` divides; elements are distinct and sorted."""
    groups = re.findall(r"\{([^{}]*)\}", text)
    parts = [g.split(",") for g in groups] if groups else [p.splitlines() for p in re.split(r"^\s*---\s*$", text, flags=re.M)]
    return [sorted({e.strip() for e in p if e.strip()}) for p in parts]


def set_measures(text: str) -> dict[str, object]:
    """Sizes of all sets, and intersection, union and difference of the first two."""
    found = sets(text)
    out: dict[str, object] = {"sets": found, "sizes": [len(s) for s in found]}
    if len(found) > 1:
        a, b = set(found[0]), set(found[1])
        out |= {"intersection": sorted(a & b), "union": sorted(a | b), "difference": sorted(a - b)}
    return out


def edge_list(text: str) -> list[tuple[str, str]]:
    """Edges of lines ``a--b``, ``a->b`` or ``a,b``."""
    out = []
    for line in text.splitlines():
        parts = re.split(r"\s*(?:--|->|,)\s*", line.strip(), maxsplit=1)
        if len(parts) == 2 and all(parts):
            out.append((parts[0], parts[1]))
    return out


def graph_measures(text: str) -> dict[str, float]:
    edges = edge_list(text)
    nodes = {n for e in edges for n in e}
    n, e = len(nodes), len(edges)
    return {"nodes": n, "edges": e, "density": e / (n * (n - 1) / 2) if n > 1 else 0.0, "average_degree": 2 * e / n if n else 0.0}


def category(text: str) -> dict[str, object]:
    """Objects, morphisms ``f: A -> B``, identities and compositions that two morphisms allow."""
    morphisms = [(m[1], m[2], m[3]) for m in re.finditer(r"^\s*(\w+)\s*:\s*(\w+)\s*->\s*(\w+)\s*$", text, re.M)]
    objects = sorted({o for _, a, b in morphisms for o in (a, b)} | set(re.findall(r"^\s*(?:object|obj)\s+(\w+)", text, re.M)))
    by_source: dict[str, list[tuple[str, str]]] = {}
    for name, a, b in morphisms:
        by_source.setdefault(a, []).append((name, b))
    compositions = sorted((f"{g}.{f}", a, c) for f, a, b in morphisms for g, c in by_source.get(b, []))
    return {"objects": objects, "morphisms": morphisms, "identities": [f"id_{o}" for o in objects], "compositions": compositions}


def optimisation(text: str) -> dict[str, object]:
    """Objectives, constraints, variables and the range of the numbers of a problem's lines."""
    objectives, constraints = [], []
    for line in text.splitlines():
        s = line.strip()
        if re.match(r"(?i)(min|max)(imi[sz]e)?\b", s):
            objectives.append(s)
        elif re.search(r"<=|>=|[<>]|(?<![<>=!])=", s):
            constraints.append(s)
    body = " ".join(re.sub(r"(?i)\b(min|max)(imi[sz]e)?\b|\bsubject to\b|\bs\.t\.", " ", x) for x in objectives + constraints)
    numbers = [float(x) for x in re.findall(r"(?<![\w.])-?\d+(?:\.\d+)?", text)]
    return {"objectives": objectives, "constraints": constraints, "variables": sorted(set(re.findall(r"\b[A-Za-z_]\w*\b", body))), "least": min(numbers, default=None), "greatest": max(numbers, default=None)}


def temporal(text: str) -> dict[str, int]:
    """Intervals ``[x]`` and before:, after:, during:, seq, par, alt marks."""
    return {"intervals": len(re.findall(r"\[[^\[\]]*\]", text)), **{k: len(re.findall(rf"\b{k}:", text)) for k in ("before", "after", "during")}, **{k: len(re.findall(rf"\b{k}\b", text)) for k in ("seq", "par", "alt")}}
