"""Forward chaining over facts (predicate, subject, object, confidence)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tessella.sources.checkpoints import cut


@dataclass(frozen=True)
class Pattern:
    """A predicate with terms: ``$X`` is a variable, ``*`` is anything, None is no object, others are constants."""

    predicate: str
    subject: str
    object: str | None = None


@dataclass(frozen=True)
class Rule:
    name: str
    conditions: tuple[Pattern, ...]
    conclusion: Pattern
    confidence: float = 1.0


def _bindings(facts: DataFrame, pattern: Pattern) -> DataFrame:
    """A column for each variable of a pattern, over the facts that match it."""
    rows = facts if pattern.predicate == "*" else facts.where(F.col("predicate") == pattern.predicate)
    variables = {}
    for column, term in (("subject", pattern.subject), ("object", pattern.object)):
        if term is None:
            rows = rows.where(F.col(column).isNull())
        elif term.startswith("$"):
            name = term[1:]
            rows = rows.where(F.col(column).isNotNull())
            if name in variables:
                rows = rows.where(F.col(column) == F.col(variables[name]))
            else:
                variables[name] = column
        elif term != "*":
            rows = rows.where(F.col(column) == term)
    return rows.select(*(F.col(c).alias(f"v_{v}") for v, c in variables.items())).distinct() if variables else rows.limit(1).select(F.lit(1).alias("v_"))


def derive(facts: DataFrame, rule: Rule) -> DataFrame:
    """Facts that a rule concludes: its conditions joined on the variables that they share."""
    joined = None
    for pattern in rule.conditions:
        found = _bindings(facts, pattern)
        if joined is None:
            joined = found
            continue
        shared = [c for c in found.columns if c in joined.columns]
        joined = joined.join(found, shared) if shared else joined.join(F.broadcast(found.limit(1_000)) if found.columns == ["v_"] else found)
    if joined is None:
        return facts.limit(0)

    def term(t: str | None):
        return F.lit(None).cast("string") if t is None else F.col(f"v_{t[1:]}") if t.startswith("$") else F.lit(t)

    c = rule.conclusion
    return joined.select(F.lit(c.predicate).alias("predicate"), term(c.subject).alias("subject"), term(c.object).alias("object"), F.lit(float(rule.confidence)).alias("confidence")).distinct()


def chain(facts: DataFrame, rules: list[Rule], rounds: int = 10) -> DataFrame:
    """Conclusions that are no given facts, until no rule adds any or the rounds are over."""
    own = ["predicate", "subject", "object", "confidence"]
    known = cut(facts.select(*own).distinct())
    derived = known.limit(0)
    for _ in range(rounds if rules else 0):
        new = None
        for rule in rules:
            found = derive(known, rule)
            new = found if new is None else new.unionByName(found)
        fresh = new.distinct().alias("n").join(known.alias("k"), [F.col(f"n.{c}").eqNullSafe(F.col(f"k.{c}")) for c in own], "left_anti")
        fresh = cut(fresh)
        if fresh.isEmpty():
            break
        derived = cut(derived.unionByName(fresh))
        known = cut(known.unionByName(fresh))
    return derived
