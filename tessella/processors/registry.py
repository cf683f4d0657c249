"""Processors as table functions: observations in, derived observations out.

A processor takes (id, data, content type, metadata) and yields (kind, value,
metadata). Observations are routed by the beginning of their content type;
without one all processors try. What a processor raises becomes a
``processing.error`` row, so one bad file does not fail a job.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessella.functions import json as canonical, text as T
from tessella.operators import aitext
from tessella.processors import algorithms, code, files, formal, manifests, measures, pages

Result = tuple[str, str, dict[str, str]]
Processor = Callable[[bytes, dict[str, str]], Iterator[Result]]


def _text(data: bytes) -> str:
    return data.decode("utf-8")


def html(data: bytes, meta: dict[str, str]) -> Iterator[Result]:
    page = pages.read_page(_text(data))
    if page.title.strip():
        yield "html.title", page.title.strip(), {}
    for name, content in page.meta.items():
        yield "html.metadata", content, {"name": name}
    for level, heading in page.headings:
        yield "html.heading", heading, {"level": level}
    if body := " ".join("".join(page.text).split()):
        yield "html.extracted_text", body, {}
    for link in page.links:
        yield "html.link", pages.resolve_url(meta["url"], link) if meta.get("url") else link, {"href": link}


def ast(data: bytes, meta: dict[str, str]) -> Iterator[Result]:
    source = _text(data)
    lang = code.detect(source)
    yield "ast.language", lang, {}
    yield "ast.metadata", str(len(source.splitlines())), {"metric": "line_count"}
    yield "ast.metadata", str(len(data)), {"metric": "byte_size"}
    if found := list(code.imports(source, lang)):
        yield "ast.imports", json.dumps(found), {"import_count": str(len(found))}
    if n := code.functions(source, lang):
        yield "ast.metadata", str(n), {"metric": "function_count"}


def repository(data: bytes, meta: dict[str, str]) -> Iterator[Result]:
    source = _text(data)
    lang = code.language_of(meta.get("path", ""))
    for kind, name, line in code.symbols(source, lang):
        yield "code.symbol", name, {"kind": kind, "line": str(line), "language": lang}
    for target in code.imports(source, lang):
        yield "code.import", target, {"language": lang}
    for caller, callee in code.calls(source, lang):
        yield "code.call", callee, {"caller": caller}
    blocks, jumps = code.control_flow(source)
    yield "code.complexity", str(code.cyclomatic(blocks, jumps)), {"blocks": str(len(blocks)), "jumps": str(len(jumps))}


def package(data: bytes, meta: dict[str, str]) -> Iterator[Result]:
    for ecosystem, name, version, dependency, constraint, kind in manifests.dependencies(meta.get("path", ""), _text(data)):
        yield "package.dependency", dependency, {"ecosystem": ecosystem, "package": name, "version": version, "constraint": constraint, "kind": kind}


def binary(data: bytes, meta: dict[str, str]) -> Iterator[Result]:
    head = data[:4].hex().upper()
    if name := next((n for s, n in files.MAGIC if head.startswith(s)), None) if len(data) >= 4 else None:
        yield "binary.magic", name, {}
    if found := files.elf(data):
        yield "binary.elf", found["machine"], found
    yield "binary.strings", json.dumps(files.strings(data)), {}
    yield "binary.size", str(len(data)), {}


def image(data: bytes, meta: dict[str, str]) -> Iterator[Result]:
    if found := files.dimensions(data):
        yield "image.dimensions", f"{found[1]}x{found[2]}", {"format": found[0]}


def video(data: bytes, meta: dict[str, str]) -> Iterator[Result]:
    yield "video.container", files.container(data), {}


def pdf(data: bytes, meta: dict[str, str]) -> Iterator[Result]:
    version = files.pdf_version(data)
    if version is None:
        raise ValueError("not a PDF")
    yield "pdf.version", version, {"size": str(len(data))}


def office(data: bytes, meta: dict[str, str]) -> Iterator[Result]:
    kind, text = files.office_text(data)
    yield "office.text", text, {"format": kind}


def containers(data: bytes, meta: dict[str, str]) -> Iterator[Result]:
    text = _text(data)
    if text.lstrip().startswith("{"):
        yield "container.manifest", json.dumps(files.oci_manifest(text)), {}
        return
    found = files.dockerfile(text)
    for base in found["images"]:
        yield "container.base_image", base, {}
    for stage in found["stages"]:
        yield "container.stage", stage, {}
    yield "container.instructions", json.dumps(found["instructions"], sort_keys=True), {}


def network(data: bytes, meta: dict[str, str]) -> Iterator[Result]:
    link, packets = files.capture(data)
    yield "network.capture", str(packets), {"link_type": link}


def git(data: bytes, meta: dict[str, str]) -> Iterator[Result]:
    kind, found = files.git_file(data)
    yield f"git.{kind}", json.dumps(found, sort_keys=True), {}


def markdown(data: bytes, meta: dict[str, str]) -> Iterator[Result]:
    yield from files.markdown(_text(data))


def probability(data: bytes, meta: dict[str, str]) -> Iterator[Result]:
    if not data:
        raise ValueError("no data")
    found = measures.measure(data)
    yield "probability.distribution", json.dumps(measures.histogram(data)), {"unique_values": str(found["unique_bytes"])}
    yield "probability.entropy", f"{found['entropy']:.4f}", {}
    yield "probability.statistics", f"mean={found['mean']:.4f}, std_dev={found['std_dev']:.4f}, mode=0x{found['mode_byte']:02x}", {}


def information(data: bytes, meta: dict[str, str]) -> Iterator[Result]:
    if not data:
        raise ValueError("no data")
    found = measures.measure(data)
    for name in ("entropy", "redundancy", "half_pmi"):
        yield f"information.{name}", f"{found[name]:.4f}", {}
    yield "information.compression_ratio", f"{found['entropy'] / 8:.4f}", {}


def vector(data: bytes, meta: dict[str, str]) -> Iterator[Result]:
    if not data:
        raise ValueError("no data")
    found = measures.measure(data)
    for name in ("mean", "magnitude", "std_dev", "sparsity", "first_half_sum", "second_half_sum"):
        yield f"vector.{name}", str(found[name]), {}


def temporal(data: bytes, meta: dict[str, str]) -> Iterator[Result]:
    yield "temporal.events", json.dumps(formal.temporal(_text(data)), sort_keys=True), {}
    if data:
        yield "temporal.transition_rate", f"{measures.measure(data)['transition_rate']:.4f}", {}


def knowledge(data: bytes, meta: dict[str, str]) -> Iterator[Result]:
    text = _text(data)
    form = canonical.canonical(text)
    yield "knowledge.fingerprint", hashlib.sha256(data).hexdigest(), {"canonical": "" if form is None else hashlib.sha256(form.encode()).hexdigest()}


#: Fixed names of the text models that there are, with what they do.
MODELS = {
    "ner-rules-v1": "entities", "extractive-summarizer-v1": "summaries", "keyword-classifier-v1": "classification",
    "bow-embeddings-v1": "embeddings", "forward-chainer-v1": "reasoning", "phrase-translator-v1": "translation",
}


def _entities(text: str, meta: dict[str, str]) -> Iterator[Result]:
    for piece, kind, confidence, start, _ in aitext.find_entities(text):
        yield "entity", piece, {"kind": kind, "confidence": str(confidence), "start": str(start)}


def _summary(text: str, meta: dict[str, str]) -> Iterator[Result]:
    best = aitext.best_sentences(text, int(meta.get("max_sentences", 5)), int(meta.get("min_sentence_length", 20)))
    yield "ai.summary", " ".join(best), {"summary_sentences": str(len(best))}


def _category(text: str, meta: dict[str, str]) -> Iterator[Result]:
    low = text.lower()
    n = max(len(re.findall(r"[^ \t\n\r\f\x0b]+", text)), 1)
    scores = {name: sum(low.count(k) * w for k, w in keywords.items()) / n for name, keywords in T.CATEGORIES.items()}
    best = max(scores, key=scores.__getitem__)
    known = scores[best] >= T.CATEGORY_THRESHOLD
    yield "ai.classification", best if known else "unknown", {"confidence": f"{scores[best] if known else 0.0:.4f}"}


def _embedding(text: str, meta: dict[str, str]) -> Iterator[Result]:
    least = int(meta.get("min_term_length", 2))
    counts = Counter(w for w in re.findall(r"[^\W_]+", text.lower()) if len(w.encode()) >= least)
    most = max(counts.values(), default=1)
    yield "ai.embeddings", json.dumps({w: c / most for w, c in sorted(counts.items())}, ensure_ascii=False), {"dimension": str(len(counts)), "method": "bow"}


def _translation(text: str, meta: dict[str, str]) -> Iterator[Result]:
    target, out, hits = meta.get("target_language", "en"), text, 0
    for phrase, other in T.PHRASES.items() if target == "es" else ():
        hits += phrase in out
        out = out.replace(phrase, other)
    n = max(len(re.findall(r"[^ \t\n\r\f\x0b]+", text)), 1)
    yield "ai.translation", out, {"confidence": f"{hits / n:.4f}", "target_language": target}


def _models(text: str, meta: dict[str, str]) -> Iterator[Result]:
    for name, task in MODELS.items():
        yield "ai.model", name, {"task": task}


ACTIONS: dict[str, Callable[[str, dict[str, str]], Iterator[Result]]] = {"ner": _entities, "summarize": _summary, "classify": _category, "embed": _embedding, "translate": _translation, "models": _models}


def ai_text(data: bytes, meta: dict[str, str]) -> Iterator[Result]:
    """The action that the metadata name, entities without one. Reasoning is over tables of facts: ``operators.reasoning``."""
    action = meta.get("action", "ner")
    if action not in ACTIONS:
        raise ValueError(f"unknown action: {action}")
    yield from ACTIONS[action](_text(data), meta)


def _json(kind: str, function: Callable[[str], object]) -> Processor:
    def run(data: bytes, meta: dict[str, str]) -> Iterator[Result]:
        yield kind, json.dumps(function(_text(data)), sort_keys=True), {}

    return run


#: Processors with the beginnings of the content types that they take.
PROCESSORS: dict[str, tuple[tuple[str, ...], Processor]] = {
    "html": (("text/html", "application/xhtml"), html), "markdown": (("text/markdown", "text/x-markdown"), markdown), "ast": (("text/x-", "application/javascript", "application/json", "text/javascript"), ast),
    "repo_intel": (("text/x-source", "application/x-source"), repository), "package_intel": (("application/x-manifest",), package), "binary": (("application/octet-stream", "application/x-executable"), binary),
    "images": (("image/",), image), "video": (("video/",), video), "pdf": (("application/pdf",), pdf), "office": (("application/vnd.openxmlformats",), office), "containers": (("application/x-dockerfile", "text/x-dockerfile", "application/vnd.oci"), containers),
    "network": (("application/vnd.tcpdump.pcap",), network), "repositories": (("application/x-git",), git), "graph_theory": (("application/x-graph",), _json("graph.measures", formal.graph_measures)), "probability": (("application/x-probability",), probability),
    "information_theory": (("application/x-information",), information), "set_theory": (("application/x-set",), _json("set.measures", formal.set_measures)), "vector_spaces": (("application/x-vector",), vector), "temporal_algebra": (("application/x-temporal",), temporal),
    "algorithm_engine": (("application/x-algorithm",), algorithms.process), "knowledge": (("application/x-knowledge",), knowledge), "ai_runtime": (("application/x-ai-runtime", "application/x-ai-text"), ai_text),
    "category_theory": (("application/x-category",), _json("category.structure", formal.category)), "optimization": (("application/x-optimization",), _json("optimization.problem", formal.optimisation)),
}
_SCHEMA = "id string, processor string, kind string, value string, metadata map<string,string>"


def process(observations: DataFrame, processors: list[str] | None = None) -> DataFrame:
    """(id, processor, kind, value, metadata) from observations (id, data, content_type, metadata)."""
    chosen = {n: PROCESSORS[n] for n in (processors or PROCESSORS)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, data, kind, meta in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                meta = dict(meta or [])
                for name, (begins, processor) in chosen.items():
                    if kind is not None and not kind.startswith(begins):
                        continue
                    try:
                        out += [(key, name, k, v, list(m.items())) for k, v, m in processor(data or b"", meta)]
                    except Exception as e:  # whatever a file makes a parser raise is a row
                        out.append((key, name, "processing.error", f"{type(e).__name__}: {e}", []))
            types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["id", "processor", "kind", "value", "metadata"])

    own = observations.select(F.col("id").cast("string"), F.col("data").cast("binary"), F.col("content_type").cast("string"), F.col("metadata").cast("map<string,string>"))
    return own.mapInArrow(run, _SCHEMA)


def routes(observations: DataFrame) -> DataFrame:
    """(id, processor): which processors take an observation, by an expression alone."""
    takes = [F.when(F.col("content_type").isNull() | F.exists(F.array(*map(F.lit, begins)), lambda b: F.startswith(F.col("content_type"), b)), F.lit(name)) for name, (begins, _) in PROCESSORS.items()]
    return observations.select("id", F.explode(F.filter(F.array(*takes), lambda p: p.isNotNull())).alias("processor"))
