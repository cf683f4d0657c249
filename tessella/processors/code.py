"""Source code by line prefixes: language, imports, functions, symbols, control flow."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

#: Fixed marks of programming languages; the most marks win, ties go to the first.
LANGUAGES = {
    "rust": ["fn ", "let mut ", "use ", "impl ", "struct ", "enum ", "pub ", "crate::"],
    "python": ["def ", "import ", "class ", "async def", "if __name__", "self", "None"],
    "javascript": ["function", "const ", "let ", "var ", "import ", "export ", "=>"],
    "typescript": [": string", ": number", ": boolean", "interface ", "type ", "<T>"],
    "go": ["func ", "package ", "import (", "defer ", "go ", "chan "],
    "java": ["public class", "private ", "protected ", "import java.", "@Override", "void "],
    "c": ["#include", "int main(", "void ", "printf(", "malloc(", "struct "],
    "cpp": ["#include", "int main(", "std::", "template<", "class ", "virtual "],
    "ruby": ["def ", "class ", "end", "require ", "attr_", "gem "],
    "php": ["<?php", "function ", "echo ", "$", "namespace "],
    "swift": ["func ", "import ", "class ", "struct ", "var ", "let "],
    "kotlin": ["fun ", "val ", "var ", "class ", "import ", "package "],
    "scala": ["def ", "val ", "var ", "object ", "class ", "import "],
    "haskell": ["main =", "::", "->", "where", "data ", "module "],
    "lua": ["function ", "local ", "end", "require ", "::"],
    "shell": ["#!/bin", "#!/usr", "#!/bash", "export ", "echo \"", "if [", "then", "fi", "done"],
    "sql": ["SELECT", "FROM ", "WHERE", "INSERT", "CREATE TABLE", "ALTER TABLE"],
    "yaml": ["---", ":", "  - "],
    "toml": ["[package]", "[dependencies]", "edition ="],
    "dockerfile": ["FROM ", "RUN ", "CMD ", "COPY ", "WORKDIR ", "EXPOSE "],
}
#: Fixed line beginnings that count as functions.
FUNCTIONS = {
    **dict.fromkeys(("rust", "swift", "kotlin", "scala"), ("fn ", "func ", "fun ")), **dict.fromkeys(("python", "ruby"), ("def ",)),
    **dict.fromkeys(("javascript", "typescript"), ("function ",)), "go": ("func ",), "java": ("public ", "private ", "protected "),
}
#: Fixed file endings of languages.
ENDINGS = {".rs": "rust", ".py": "python", ".go": "go", ".java": "java", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".c": "c", ".h": "c", ".cc": "cpp", ".cpp": "cpp", ".hpp": "cpp", ".cs": "csharp", ".php": "php", ".kt": "kotlin", ".swift": "swift", ".zig": "zig", ".lua": "lua", ".wasm": "wasm"}
_NAME = r"([A-Za-z_][A-Za-z0-9_]*)"
_ACCESS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|override|virtual|async|export|default|open|data|partial|extern|inline|unsafe|readonly|mut|const)\s+)*"


def _rules(*pairs: tuple[str, str]) -> list[tuple[str, re.Pattern]]:
    return [(kind, re.compile(p)) for kind, p in pairs]


#: Symbols by language: kind and line pattern, whose group is the name.
SYMBOLS = {
    "rust": _rules(("function", rf"^(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+)*fn\s+{_NAME}"), ("struct", rf"^(?:pub(?:\([^)]*\))?\s+)?struct\s+{_NAME}"), ("enum", rf"^(?:pub(?:\([^)]*\))?\s+)?enum\s+{_NAME}"), ("trait", rf"^(?:pub(?:\([^)]*\))?\s+)?trait\s+{_NAME}"), ("impl", rf"^impl(?:<[^>]*>)?\s+(?:.*\sfor\s+)?{_NAME}"), ("module", rf"^(?:pub\s+)?mod\s+{_NAME}")),
    "python": _rules(("function", rf"^(?:async\s+)?def\s+{_NAME}"), ("class", rf"^class\s+{_NAME}")),
    "go": _rules(("method", rf"^func\s+\([^)]*\)\s*{_NAME}"), ("function", rf"^func\s+{_NAME}"), ("struct", rf"^type\s+{_NAME}\s+struct"), ("interface", rf"^type\s+{_NAME}\s+interface")),
    "java": _rules(("class", rf"^{_ACCESS}class\s+{_NAME}"), ("interface", rf"^{_ACCESS}interface\s+{_NAME}"), ("enum", rf"^{_ACCESS}enum\s+{_NAME}"), ("method", rf"^(?:public|private|protected)\s+(?:static\s+|final\s+|abstract\s+)*[\w<>\[\], ]+\s+{_NAME}\s*\(")),
    "javascript": _rules(("function", rf"^{_ACCESS}function\s*\*?\s*{_NAME}"), ("class", rf"^{_ACCESS}class\s+{_NAME}"), ("function", rf"^(?:export\s+)?(?:const|let|var)\s+{_NAME}\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>"), ("interface", rf"^{_ACCESS}interface\s+{_NAME}")),
    "c": _rules(("struct", rf"^(?:typedef\s+)?struct\s+{_NAME}"), ("class", rf"^class\s+{_NAME}"), ("namespace", rf"^namespace\s+{_NAME}"), ("function", rf"^(?!return|else|if|for|while|switch)[A-Za-z_][\w\s*&:<>]*[\s*&]{_NAME}\s*\([^;]*$")),
    "csharp": _rules(("class", rf"^{_ACCESS}class\s+{_NAME}"), ("interface", rf"^{_ACCESS}interface\s+{_NAME}"), ("struct", rf"^{_ACCESS}struct\s+{_NAME}"), ("enum", rf"^{_ACCESS}enum\s+{_NAME}"), ("namespace", r"^namespace\s+([\w.]+)"), ("method", rf"^(?:public|private|protected|internal)\s+(?:static\s+|virtual\s+|override\s+|async\s+)*[\w<>\[\], ]+\s+{_NAME}\s*\(")),
    "php": _rules(("class", rf"^{_ACCESS}class\s+{_NAME}"), ("interface", rf"^interface\s+{_NAME}"), ("trait", rf"^trait\s+{_NAME}"), ("function", rf"^{_ACCESS}function\s+&?{_NAME}")),
    "kotlin": _rules(("function", rf"^{_ACCESS}fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?{_NAME}"), ("class", rf"^{_ACCESS}class\s+{_NAME}"), ("interface", rf"^{_ACCESS}interface\s+{_NAME}"), ("object", rf"^{_ACCESS}object\s+{_NAME}")),
    "swift": _rules(("function", rf"^{_ACCESS}func\s+{_NAME}"), ("class", rf"^{_ACCESS}class\s+{_NAME}"), ("struct", rf"^{_ACCESS}struct\s+{_NAME}"), ("enum", rf"^{_ACCESS}enum\s+{_NAME}"), ("protocol", rf"^{_ACCESS}protocol\s+{_NAME}")),
    "zig": _rules(("function", rf"^(?:pub\s+|export\s+|inline\s+)*fn\s+{_NAME}"), ("struct", rf"^(?:pub\s+)?const\s+{_NAME}\s*=\s*(?:packed\s+|extern\s+)?struct"), ("enum", rf"^(?:pub\s+)?const\s+{_NAME}\s*=\s*enum")),
    "lua": _rules(("function", r"^(?:local\s+)?function\s+([\w.:]+)"), ("function", r"^(?:local\s+)?([\w.]+)\s*=\s*function")),
}
SYMBOLS["typescript"], SYMBOLS["cpp"] = SYMBOLS["javascript"], SYMBOLS["c"]

IMPORTS = {
    "rust": [re.compile(r"^(?:pub\s+)?use\s+(.+?);"), re.compile(r"^extern\s+crate\s+(\w+)")],
    "python": [re.compile(r"^import\s+(.+)$"), re.compile(r"^from\s+(\S+)\s+import\b")],
    "java": [re.compile(r"^import\s+(?:static\s+)?(?!javax?\.)([\w.*]+);")],
    "javascript": [re.compile(r"""^(?:import|export)\b.*?from\s+['"]([^'"]+)['"]"""), re.compile(r"""^import\s+['"]([^'"]+)['"]"""), re.compile(r"""require\(\s*['"]([^'"]+)['"]\s*\)""")],
    "c": [re.compile(r"""^#\s*include\s*[<"]([^>"]+)[>"]""")],
    "csharp": [re.compile(r"^using\s+(?:static\s+)?([\w.]+)\s*;")],
    "php": [re.compile(r"^use\s+([\w\\]+)"), re.compile(r"""^(?:require|include)(?:_once)?\s*\(?\s*['"]([^'"]+)['"]""")],
    "kotlin": [re.compile(r"^import\s+([\w.*]+)")],
    "swift": [re.compile(r"^import\s+(\w+)")],
    "zig": [re.compile(r"""@import\(\s*"([^"]+)"\s*\)""")],
    "lua": [re.compile(r"""require\s*\(?\s*['"]([^'"]+)['"]""")],
}
IMPORTS["typescript"], IMPORTS["cpp"] = IMPORTS["javascript"], IMPORTS["c"]


def language(source: Column) -> Column:
    """The language with most marks in a text, or unknown."""
    scores = [(name, sum((source.contains(m).cast("int") for m in marks), F.lit(0))) for name, marks in LANGUAGES.items()]
    best = F.greatest(*(s for _, s in scores))
    out = F.lit("unknown")
    for name, score in reversed(scores):
        out = F.when((score == best) & (best > 0), name).otherwise(out)
    return out


def language_of(path: str) -> str:
    """The language of a file by its ending, or unknown."""
    return next((lang for ending, lang in sorted(ENDINGS.items(), key=lambda e: -len(e[0])) if path.lower().endswith(ending)), "unknown")


def detect(source: str) -> str:
    best, most = "unknown", 0
    for name, marks in LANGUAGES.items():
        n = sum(m in source for m in marks)
        if n > most:
            best, most = name, n
    return best


def functions(source: str, lang: str) -> int:
    return sum(line.strip().startswith(FUNCTIONS[lang]) for line in source.splitlines()) if lang in FUNCTIONS else 0


def symbols(source: str, lang: str) -> Iterator[tuple[str, str, int]]:
    """(kind, name, line) of a source's symbols."""
    for number, line in enumerate(source.splitlines(), 1):
        stripped = line.strip()
        for kind, pattern in SYMBOLS.get(lang, ()):
            if m := pattern.search(stripped):
                inside = lang == "python" and kind == "function" and line[:1].isspace()
                yield "method" if inside else kind, m[1], number
                break


def imports(source: str, lang: str) -> Iterator[str]:
    """What a source imports, in order."""
    block = False
    for line in source.splitlines():
        stripped = line.strip()
        if lang == "go":
            if stripped.startswith("import ("):
                block = True
            elif block and stripped == ")":
                block = False
            elif (block or stripped.startswith("import ")) and (m := re.search(r'"([^"]+)"', stripped)):
                yield m[1]
            continue
        for pattern in IMPORTS.get(lang, ()):
            if m := pattern.search(stripped):
                yield m[1].strip()
                break


_STATEMENTS = [
    ("else if", re.compile(r"(?:else\s+if|elif)\b")), ("else", re.compile(r"else\b")), ("if", re.compile(r"if\b")),
    ("loop", re.compile(r"(?:for|while|loop)\b")), ("switch", re.compile(r"(?:match|switch)\b")),
    ("arm", re.compile(r"(?:case|default)\b|[^=\"']*=>")), ("exit", re.compile(r"(?:return|raise|throw)\b")),
    ("break", re.compile(r"break\b")), ("continue", re.compile(r"continue\b")),
]
_INLINE = re.compile(r"\b(return|raise|throw|break|continue)\b")
_ENDLESS = re.compile(r"loop\b|while\s*\(?\s*(?:true|True|1)\b")


@dataclass
class _Statement:
    kind: str
    line: str
    inner: list[_Statement] = field(default_factory=list)


def _statements(body: str) -> list[_Statement]:
    """The tree of a body's statements, nested by braces, or by indentation where there are none."""
    braces = "{" in body
    depth, root = 0, _Statement("root", "")
    open_ones = [(-1, root)]
    for line in body.splitlines():
        text = line.strip()
        closing = len(text) - len(text.lstrip("} "))
        own = text[closing:]
        level = depth - text[:closing].count("}") if braces else len(line) - len(line.lstrip())
        if braces:
            depth += text.count("{") - text.count("}")
        if not own or own == "{":
            continue
        kind = next((k for k, p in _STATEMENTS if p.match(own)), "plain")
        while open_ones[-1][0] >= level and len(open_ones) > 1:
            open_ones.pop()
        node = _Statement(kind, own)
        open_ones[-1][1].inner.append(node)
        open_ones.append((level, node))
    return root.inner


def control_flow(body: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Blocks, the entry first and the exit last, and jumps of a function's body.

    A condition jumps to its branch and past it; branches meet in whatever
    follows. A loop's branch jumps back to its head, break behind it, continue to
    the head; returns and errors raised go to the exit. A choice has a branch for
    each arm, and jumps past them unless an arm takes the rest. What cannot be
    reached has blocks without jumps to them. An empty body is entry and exit.
    """
    blocks, jumps, leaving = ["entry"], {}, []

    def block(kind: str, before: list[int]) -> int:
        blocks.append(kind)
        jumps.update(((b, len(blocks) - 1), None) for b in before)
        return len(blocks) - 1

    def inside(node: _Statement, head: int, loop: tuple[int, list[int]] | None) -> list[int]:
        """The ends of a statement's branch."""
        found = _INLINE.search(node.line)
        own = node.inner or ([_Statement("exit" if found[1] not in ("break", "continue") else found[1], "")] if found else [])
        return walk(own, [block("branch", [head])], loop)

    def walk(nodes: list[_Statement], at: list[int], loop: tuple[int, list[int]] | None) -> list[int]:
        past: list[int] = []  # ends of the branches of the choice that is being read
        head = None
        for node in nodes:
            if node.kind in ("else if", "else") and head is not None:
                if node.kind == "else":
                    past, head = past + inside(node, head, loop), None
                else:
                    head = block("conditional", [head])
                    past = past + inside(node, head, loop)
                at = past + ([] if head is None else [head])
                continue
            past, head = [], None
            if node.kind in ("if", "else if"):
                head = block("conditional", at)
                past = inside(node, head, loop)
                at = [*past, head]
            elif node.kind == "switch":
                choice = block("conditional", at)
                arms = _arms(node.inner)
                at = [e for arm in arms for e in inside(arm, choice, loop)]
                if not any(re.match(r"default\b|(?:case\s+)?_\s*(?:=>|:)", arm.line) for arm in arms):
                    at.append(choice)
            elif node.kind == "loop":
                top, breaks = block("loop", at), []
                jumps.update(((e, top), None) for e in inside(node, top, (top, breaks)))
                at = breaks + ([] if _ENDLESS.match(node.line) else [top])
            elif node.kind == "exit":
                leaving.extend(at)
                at = []
            elif node.kind == "break" and loop:
                loop[1].extend(at)
                at = []
            elif node.kind == "continue" and loop:
                jumps.update(((e, loop[0]), None) for e in at)
                at = []
            elif node.inner:
                at = walk(node.inner, at, loop)
        return at

    ends = walk(_statements(body), [0], None)
    block("exit", list(dict.fromkeys(leaving + ends)))
    return blocks, list(jumps)


def _arms(nodes: list[_Statement]) -> list[_Statement]:
    """A choice's arms, with the statements that follow on their own level."""
    arms: list[_Statement] = []
    for node in nodes:
        if node.kind == "arm":
            arms.append(_Statement("arm", node.line, list(node.inner)))
        elif arms:
            arms[-1].inner.append(node)
    return arms


def cyclomatic(blocks: list[str], jumps: list[tuple[int, int]]) -> int:
    return max(1, len(jumps) - len(blocks) + 2)


def calls(source: str, lang: str) -> Iterator[tuple[str, str]]:
    """(caller, callee) between functions of one source, by names before parentheses."""
    known = {name for kind, name, _ in symbols(source, lang) if kind in ("function", "method")}
    current = None
    starts = {line: name for kind, name, line in symbols(source, lang) if kind in ("function", "method")}
    for number, line in enumerate(source.splitlines(), 1):
        found = re.findall(r"([A-Za-z_]\w*)\s*\(", line)
        if number in starts:
            current = starts[number]
            found = [f for f in found if f != current]
        if current:
            for f in found:
                if f in known:
                    yield current, f
