"""Search algebra and pipeline language on hand-made rows."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessella.operators import reasoning, search as S
from tessella.plans import compiler, dsl

DOCS = [
    (1, "Rust ownership", "Ownership is Rust's unique memory management system. It ensures memory safety.", "article", "docs", None, {}),
    (2, "Python generators", "Generators in Python allow lazy evaluation using yield statements.", "article", "docs", None, {}),
    (3, "Rust vs Python", "Rust offers memory safety while Python prioritizes developer speed.", "comparison", "blog", None, {"depends_on": "serde"}),
    (4, "Cargo package manager", "Cargo is the Rust package manager. It handles dependencies and builds.", "article", "docs", datetime(2024, 5, 1), {"package": "cargo"}),
    (5, "main.rs", "fn main() { println!(\"hello\"); }", "code", "src", None, {"symbol_kind": "function", "dep_chain": "a>serde", "dep_depth": "2"}),
]
SCHEMA = "id long, title string, body string, kind string, source string, ts timestamp, metadata map<string,string>"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA)


@pytest.fixture(scope="module")
def find(spark, docs):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, [1.0, 1.0, 1.0])], "id long, embedding array<float>")
    edges = spark.createDataFrame([(1, 3, "like"), (3, 4, "like"), (4, 5, "other")], "src long, dst long, kind string")
    engine = S.Search(docs, vectors, edges)
    return lambda q, limit=None: [(r.id, r.score) for r in engine.run(q, limit).collect()]


def ids(rows):
    return sorted(i for i, _ in rows)


def test_leaves(find):
    assert dict(find(S.Keyword("Rust"))) == {1: 4, 3: 4, 4: 1}
    assert ids(find(S.Phrase(("memory", "safety")))) == [1, 3]
    assert ids(find(S.Contains("gen"))) == [2] == ids(find(S.StartsWith("gener")))
    assert find(S.Temporal(start=datetime.now() + timedelta(days=1))) == []
    assert ids(find(S.Temporal(end=datetime(2024, 5, 1)))) == [4]
    assert len(find(S.Temporal())) == 5
    assert ids(find(S.Structural("function", "main"))) == [5] == ids(find(S.Structural("call", "main")))
    assert ids(find(S.Structural("symbol", None, "function"))) == [5]
    assert ids(find(S.Dependency("dependents", "serde"))) == [3]
    assert ids(find(S.Architecture("package", "cargo"))) == [4]
    assert ids(find(S.Node("Rust", "comparison"))) == [3]
    assert find(S.Semantic((1.0, 0.0))) == [(1, 1.0), (2, 0.0)]
    assert ids(find(S.Neighbors(1, 2, "like"))) == [3, 4]
    assert ids(find(S.Dependency("transitive", "1", 2))) == [3, 4]
    assert ids(find(S.Edge("like"))) == [1, 3, 4] and ids(find(S.Path(1, 5, 3))) == [1, 3, 4, 5] and find(S.Path(1, 5, 2)) == []
    assert ids(find(S.Subgraph((1, 5), 1))) == [1, 3, 4, 5]


def test_trees(find):
    assert ids(find(S.And((S.Keyword("rust"), S.Keyword("python"))))) == [3]
    assert ids(find(S.Or((S.Keyword("ownership"), S.Keyword("generators"))))) == [1, 2]
    assert 4 not in ids(find(S.And((S.Keyword("rust"), S.Not(S.Keyword("cargo"))))))
    assert ids(find(S.Filter(S.Keyword("rust"), (("kind", "comparison"),)))) == [3]
    assert ids(find(S.Filter(S.Keyword("rust"), (("time_before", datetime(2024, 1, 1)),)))) == [1, 3]
    assert find(S.Or((S.And((S.Keyword("rust"), S.Similarity(S.Keyword("cargo"), 0.99))), S.Keyword("yield")))) == [(2, 1.0), (4, 1.0)]
    assert find(S.Keyword("rust"), 1) == [(1, 4)]
    assert find(S.And(())) == [] == find(S.Or(()))


def test_similarity_includes_its_base(find):
    found = dict(find(S.Similarity(S.Keyword("ownership"), 0.3)))
    assert found[1] == pytest.approx(1) and 3 in found


def test_local_trees_are_one_scan(docs):
    plan = S.Search(docs).run(S.And((S.Keyword("rust"), S.Or((S.Contains("a"), S.Not(S.Phrase(("x",))))))))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


@pytest.fixture
def catalog(spark, docs, tmp_path):
    edges = spark.createDataFrame([(1, 2, "cites"), (2, 3, "cites"), (3, 4, "cites"), (4, 5, "other")], "src long, dst long, kind string")
    facts = spark.createDataFrame([("is_a", "Rust", "systems_language", 1.0), ("is_a", "systems_language", "programming_language", 1.0), ("has_vulnerability", "libfoo", None, 1.0)], "predicate string, subject string, object string, confidence double")
    rules = {"taxonomy": [reasoning.Rule("t", (reasoning.Pattern("is_a", "$X", "$Y"), reasoning.Pattern("is_a", "$Y", "$Z")), reasoning.Pattern("is_a", "$X", "$Z"), 0.9)], "danger": [
        reasoning.Rule("d", (reasoning.Pattern("has_vulnerability", "$L"),), reasoning.Pattern("is", "$L", "dangerous"), 0.8), reasoning.Rule("p", (reasoning.Pattern("is", "$L", "dangerous"),), reasoning.Pattern("action_required", "$L", "patch"), 0.7)]}
    return compiler.Catalog(spark, {"documents": docs, "facts": facts}, edges, rules, root=str(tmp_path))


def run(program, catalog):
    return compiler.compile_program(program, catalog)[-1]


def test_programs(catalog, tmp_path):
    assert [r.id for r in run("From documents\nMatch kind == 'article' # only these\nSort id DESC\nLimit 2\n", catalog).collect()] == [4, 2]
    assert {r.id for r in run('documents\nWHERE (kind == "code" OR source != "docs") AND NOT title == "main.rs"', catalog).collect()} == {3}
    assert {r.id for r in run('FROM documents\nMATCH id == 1\nTRAVERSE cites DEPTH 2\n', catalog).collect()} == {2, 3}
    assert {r.id for r in run('FROM documents\nMATCH title == "Rust*"\n', catalog).collect()} == {1, 3}
    assert {r.id for r in run("FROM documents\nMATCH ts != NULL\n", catalog).collect()} == {4}
    assert [r.id for r in run('FROM documents\nSIMILAR TO "cargo is the rust package manager it handles dependencies and builds"\n', catalog).collect()] == [4]
    assert {(r.subject, r.object) for r in run("FROM facts\nINFER taxonomy\n", catalog).collect()} == {("Rust", "programming_language")}
    assert {(r.predicate, r.subject, r.object) for r in run("FROM facts\nINFER danger\n", catalog).collect()} == {("is", "libfoo", "dangerous"), ("action_required", "libfoo", "patch")}
    assert run("FROM documents\nSUMMARIZE\n", catalog).columns == ["id", "summary", "n_sentences"]
    assert {r.correlation for r in run('FROM documents\nMATCH id == 5\nCORRELATE "nothing alike"\n', catalog).collect()} == {"none"}
    run("FROM documents\nMATCH id < 3\nSTORE AS few\nEXPORT json\n", catalog)
    assert run("LOAD few\n", catalog).count() == 2 and (tmp_path / "export-json").exists()
    assert len(compiler.compile_program("FROM documents\nFROM facts\n", catalog)) == 2


@pytest.mark.parametrize("program", ["MATCH a == 1", "FROM documents\nLIMIT x", "FROM documents\nLIMIT 1.5", "FROM", "FROM documents\nTRAVERSE x DEPTH y", "FROM documents\n@", "FROM documents\nWHERE (a == 1", "DEPTH 3"])
def test_wrong_programs_are_told(catalog, program):
    with pytest.raises(dsl.SyntaxProblem):
        run(program, catalog)


def test_fluent_verbs(catalog):
    p = compiler.source(catalog, "documents")
    assert p.where("kind == 'article'").sort("id", True).limit(1).df.first().id == 4
    assert p.where(F.col("id") > 4).snapshot("graph").df.first().asDict() == {"kind": "graph", "rows": 1, "columns": "id,title,body,kind,source,ts,metadata"}
    assert p.search(S.Keyword("rust"), 2).df.count() == 2 and p.resolve(S.Keyword("rust")).df.count() == 3
    assert p.classify("x").df.where("class = 'x'").count() == 5 and "fingerprint" in p.observe().df.columns
    with pytest.raises(KeyError):
        p.collect("missing")


@pytest.mark.parametrize(("threshold", "bases"), [(0.9, 1 << 13), (0.5, 3), (0.0, 7)])
def test_similarity_is_that_of_all_pairs_and_shuffles_no_words(spark, monkeypatch, threshold, bases):
    monkeypatch.setattr(S, "_BASES", bases)
    rng = random.Random(5)
    words = [f"w{k}" for k in range(900)]
    texts = [rng.choices(words, weights=[1 / (k + 1) for k in range(900)], k=rng.choice([1, 5, 40])) for _ in range(400)]
    texts += [[*t[:-1], "odd"] for t in texts[:100]] + texts[:50] + [[]]
    rows = [(i, " ".join(t[:2]), " ".join(t), "k", "s", None, {}) for i, t in enumerate(texts)] + [(7, "w1 w1", "w5", "k", "s", None, {}), (None, "w1", "w1", "k", "s", None, {}), (9999, None, None, "k", "s", None, {})]
    counts = {}
    for i, title, body, *_ in rows:
        if i is not None:
            counts.setdefault(i, Counter()).update(((title or "") + " ").split() * 3 + (body or "").split())
    length = {i: sum(n * n for n in c.values()) ** 0.5 for i, c in counts.items()}
    expected = {}
    for i in counts:
        for b in range(0, 460, 5):
            dot = sum(n * counts[b][w] for w, n in counts[i].items())
            if dot and dot / (length[i] * length[b]) >= threshold - 1e-12:
                expected[i] = dot / (length[i] * length[b])
                break
    found = S.similar(spark.createDataFrame(rows, SCHEMA).repartition(3), spark.range(0, 460, 5), threshold)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan and "dot" not in plan
    assert {r.id: r.score for r in found.collect()} == pytest.approx(expected, abs=1e-12) and len(expected) > 50
