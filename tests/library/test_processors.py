"""Processors on hand-made files."""

from __future__ import annotations

import io
import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from tessella.functions import ids
from tessella.processors import algorithms, code, files, formal, manifests, measures, pages, registry
from tessella.queries.literals import MANIFESTS, SOURCES


def test_pages(spark):
    page = pages.read_page("<html><head><title>A &amp; B</title><meta name='Author' content='me'></head><body><h1>One <b>two</b></h1><p>text</p><script>zz</script><a href='#top'>t</a><a href='../c'>c</a><img src='i.png'></body></html>")
    assert (page.title, page.headings, page.links, page.meta) == ("A & B", [("h1", "One two")], ["../c"], {"author": "me"})
    assert "".join(page.text).split() == ["One", "two", "text", "tc"] and ("img", "i.png") in page.resources
    base = "https://h.com/a/b/p.html"
    for href, url in {"http://x": "http://x", "//y/z": "https://y/z", "/q": "https://h.com/q", "r": "https://h.com/a/b/r", "./r": "https://h.com/a/b/r", "../r": "https://h.com/a/r", "../../../r": pages.resolve_url(base, "../../../r"), "?q=1": base, "#f": base}.items():
        assert pages.resolve_url(base, href) == url
    urls = spark.createDataFrame([("https://a.com/x",), ("https://b.a.com/i.png",), ("mailto:x@a.com",), ("https://c.com/",), ("/relative",)], "url string")
    assert [r[0] for r in urls.select(pages.admitted(F.col("url"), ["a.com"])).collect()] == [True, False, False, False, True]


@pytest.mark.parametrize("path", SOURCES)
def test_sources(path):
    source, symbols, imports = SOURCES[path]
    lang = code.language_of(path)
    assert {(k, n) for k, n, _ in code.symbols(source, lang)} == symbols
    assert list(code.imports(source, lang)) == imports


def test_flow_and_calls():
    assert code.cyclomatic(*code.control_flow("x = 1\nreturn x")) == 1
    assert code.cyclomatic(*code.control_flow("if a {\n b\n}\nfor c {\n d\n}")) >= 2
    assert list(code.calls(SOURCES["a.py"][0], "python")) == [("m", "f")]
    assert code.detect("fn main() { let mut x = crate::y; }") == "rust" and code.detect("\x00") == "unknown"


@pytest.mark.parametrize("name", MANIFESTS)
def test_manifests(name):
    text, expected = MANIFESTS[name]
    assert {(d, c, k) for _, _, _, d, c, k in manifests.dependencies(f"some/{name}", text)} == expected


def test_files(spark):
    assert files.dimensions(b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 7, 9)) == ("png", 7, 9)
    assert files.dimensions(b"GIF89a" + struct.pack("<HH", 3, 4)) == ("gif", 3, 4)
    assert files.dimensions(b"\xff\xd8\xff\xe0\x00\x02\xff\xc0" + struct.pack(">HBHHB", 11, 8, 5, 6, 1) + bytes(6)) == ("jpeg", 6, 5)
    assert files.container(b"\0\0\0\x18ftypmp42") == "mp4" and files.pdf_version(b"%PDF-1.7\n") == "1.7"
    assert files.elf(b"\x7fELF\x02\x01" + bytes(12) + b"\x3e\x00" + bytes(4) + (0x400000).to_bytes(8, "little"))["machine"] == "x86_64"
    packet = struct.pack("<IIII", 0, 0, 3, 3) + b"abc"
    assert files.capture(b"\xd4\xc3\xb2\xa1" + bytes(16) + struct.pack("<I", 1) + packet * 2) == ("Ethernet", 2)
    assert files.git_file(b"PACK" + struct.pack(">II", 2, 5)) == ("pack", {"version": "2", "objects": "5"}) and files.git_file(b"ref: refs/heads/m\n")[0] == "head"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", '<w:d xmlns:w="u"><w:t>Hello</w:t><w:t>you</w:t></w:d>')
    assert files.office_text(out.getvalue()) == ("docx", "Hello you")
    found = files.dockerfile("FROM a:1 AS s\nRUN x \\\n y\nCOPY . .\n")
    assert found == {"images": ["a:1"], "stages": ["s"], "instructions": {"FROM": 1, "RUN": 1, "COPY": 1}}
    text = "---\nt: 1\n---\n# A\nbody\n## B\nmore\n```py\nx\n```\n"
    assert [(k, v) for k, v, _ in files.markdown(text)] == [("markdown.frontmatter", "t: 1"), ("markdown.heading", "A"), ("markdown.text", "body"), ("markdown.heading", "B"), ("markdown.text", "more"), ("markdown.code_block", "x")]
    rows = spark.createDataFrame([(bytearray(b"%PDF-1.4"),), (bytearray(b"MZ\0\0"),), (bytearray(b"ab"),), (bytearray(b"zzzz"),)], "d binary")
    assert [r[0] for r in rows.select(files.magic(F.col("d"))).collect()] == ["PDF", "PE", None, None]


def test_formal():
    assert formal.set_measures("{a,b} {b, c}") == {"sets": [["a", "b"], ["b", "c"]], "sizes": [2, 2], "intersection": ["b"], "union": ["a", "b", "c"], "difference": ["a"]}
    assert formal.sets("a\nb\n---\nc") == [["a", "b"], ["c"]]
    assert formal.graph_measures("a--b\nb,c\n") == {"nodes": 3, "edges": 2, "density": 2 / 3, "average_degree": 4 / 3}
    assert formal.category("f: A -> B\ng: B -> C")["compositions"] == [("g.f", "A", "C")]
    found = formal.optimisation("minimize x + 2 y\nx >= -1.5\ny <= 4")
    assert (len(found["objectives"]), len(found["constraints"]), found["variables"], found["least"], found["greatest"]) == (1, 2, ["x", "y"], -1.5, 4.0)
    assert formal.temporal("[a] before: [b] seq")["intervals"] == 2


def test_measures():
    found = measures.measure(b"aabb")
    assert found["entropy"] == 1.0 and found["half_pmi"] == 0.0 and found["transition_rate"] == pytest.approx(1 / 3) and found["mode_byte"] == 97
    assert measures.histogram(b"abb") == [(98, 2), (97, 1)]


def test_registry(spark):
    rows = [("1", bytearray(b"<title>T</title><a href='/x'>l</a>"), "text/html", {"url": "http://h/y"}), ("2", bytearray(b"\xff\xfe"), "text/html", {}), ("3", bytearray(b""), "application/x-probability", {}), ("4", bytearray(b"a--b"), "application/x-graph", None), ("5", None, "text/unknown", {}), ("6", bytearray(b"numpy"), "application/x-manifest", {"path": "requirements.txt"})]
    observations = spark.createDataFrame(rows, "id string, data binary, content_type string, metadata map<string,string>")
    found = registry.process(observations).collect()
    assert {(r.id, r.kind, r.value) for r in found if r.id in "16"} == {("1", "html.title", "T"), ("1", "html.extracted_text", "l"), ("1", "html.link", "http://h/x"), ("6", "package.dependency", "numpy")}
    assert {r.kind for r in found if r.id in "23"} == {"processing.error"}
    assert json.loads(next(r.value for r in found if r.id == "4"))["edges"] == 1
    assert not [r for r in found if r.id == "5"]
    assert {(r.id, r.processor) for r in registry.routes(observations).collect()} == {(r.id, r.processor) for r in found}
    every = registry.process(spark.createDataFrame([("9", bytearray(b"plain"), None, None)], observations.schema)).collect()
    assert {r.processor for r in every} >= {"html", "binary", "pdf", "probability"}


def test_algorithms():
    def run(name, text, directed="false"):
        return json.loads(next(algorithms.process(text.encode(), {"algorithm": name, "directed": directed}))[1])

    simple, directed = "0 1 1\n0 2 4\n1 2 2\n1 3 5\n2 3 1", "0 1\n1 2\n2 0\n2 3\n3 4\n4 3"
    assert run("bfs", simple)[0] == 0 and len(run("dfs", simple)) == 4
    assert run("dijkstra", simple)["3"] == 4 and run("astar", simple) == {"goal": 3, "distance": 4.0, "path": [0, 1, 2, 3]} == run("shortest_path", simple)
    assert run("tarjan", directed, "true") == [[0, 1, 2], [3, 4]] == run("kosaraju", directed, "true") and run("tarjan", simple) == [[0, 1, 2, 3]]
    assert sum(run("pagerank", "0 1\n0 2\n1 2\n2 0", "true").values()) == pytest.approx(1)
    assert run("jaccard", "a b\nb a") == 1 and run("jaccard", "") == 1 and run("cosine", "1 2 3\n2 4 6") == pytest.approx(1) and run("minhash", "a b\na b") == 1 and run("lsh", "a b\na b") is True
    assert abs(run("hyperloglog", " ".join(f"t{i}" for i in range(500))) - 500) < 25 and len(run("merkle", "a\nb\nc")) == 64
    assert run("inverted_index", "a b\nb")["b"] == [0, 1] and len(run("simhash", "the lazy dog")) == 16
    assert algorithms.route(algorithms.read_graph(simple, False), 0, 5) is None
    with pytest.raises(ValueError, match="named"):
        run("nothing", "")


def test_ids(spark):
    row = spark.createDataFrame([(1469918176385, 12345)], "t long, n long").select(ids.ulid(F.col("t"), F.col("n")).alias("u"))
    found = row.select("u", ids.ulid_millis(F.col("u")), ids.is_ulid(F.col("u")), ids.is_ulid(F.lit("x"))).first()
    assert found[0].startswith("01ARYZ6S41") and tuple(found[1:]) == (1469918176385, True, False)


@pytest.mark.parametrize(("body", "jumps"), [
    ("", [("entry", "exit")]),
    ("x = 1\nreturn x", [("entry", "exit")]),
    ("if a {\n b\n}\nc", [("entry", "conditional"), ("conditional", "branch"), ("branch", "exit"), ("conditional", "exit")]),
    ("if a:\n    return 1\nelse:\n    b\nc", [("entry", "conditional"), ("conditional", "branch"), ("conditional", "branch"), ("branch", "exit"), ("branch", "exit")]),
    ("while a {\n if b {\n  break;\n }\n c\n}", [("entry", "loop"), ("loop", "branch"), ("branch", "conditional"), ("conditional", "branch"), ("conditional", "loop"), ("branch", "exit"), ("loop", "exit")]),
    ("for a in b:\n    if c: continue\n    d", [("entry", "loop"), ("loop", "branch"), ("branch", "conditional"), ("conditional", "branch"), ("branch", "loop"), ("conditional", "loop"), ("loop", "exit")]),
    ("loop {\n a\n}", [("entry", "loop"), ("loop", "branch"), ("branch", "loop")]),
    ("match a {\n 1 => b,\n _ => c,\n}", [("entry", "conditional"), ("conditional", "branch"), ("conditional", "branch"), ("branch", "exit"), ("branch", "exit")]),
    ("if a {\n} else if b {\n} else {\n}", [("entry", "conditional"), ("conditional", "branch"), ("conditional", "conditional"), ("conditional", "branch"), ("conditional", "branch"), ("branch", "exit"), ("branch", "exit"), ("branch", "exit")]),
])
def test_jumps_of_control_flow(body, jumps):
    blocks, found = code.control_flow(body)
    assert sorted((blocks[a], blocks[b]) for a, b in found) == sorted(jumps)


def test_complexity_counts_decisions():
    assert [code.cyclomatic(*code.control_flow(b)) for b in ("a", "if a {\n b\n}\nfor c {\n d\n}", "if a:\n  b\nelif c:\n  d\nelse:\n  e")] == [1, 3, 3]
