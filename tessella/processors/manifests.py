"""Package manifests to dependencies: (ecosystem, package, version, dependency, constraint, kind)."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

Row = tuple[str, str, str, str, str, str]


def _name(path: str) -> str:
    return path.rpartition("/")[2].lower()


def cargo(text: str) -> Iterator[Row]:
    found = tomllib.loads(text)
    package = found.get("package", {})
    for table, kind in (("dependencies", "runtime"), ("dev-dependencies", "dev"), ("build-dependencies", "build")):
        for name, value in found.get(table, {}).items():
            constraint = value if isinstance(value, str) else str(value.get("version", "*"))
            yield "cargo", str(package.get("name", "")), str(package.get("version", "")), name, constraint, kind


def npm(text: str) -> Iterator[Row]:
    found = json.loads(text)
    for table, kind in (("dependencies", "runtime"), ("devDependencies", "dev"), ("peerDependencies", "peer"), ("optionalDependencies", "optional")):
        for name, constraint in (found.get(table) or {}).items():
            yield "npm", found.get("name", ""), found.get("version", ""), name, str(constraint), kind


_REQUIREMENT = re.compile(r"^([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*([=~><!][^;]*)?")


def _requirement(line: str) -> tuple[str, str] | None:
    m = _REQUIREMENT.match(line.strip())
    return (m[1], (m[2] or "*").strip()) if m else None


def requirements(text: str) -> Iterator[Row]:
    for line in text.splitlines():
        line = line.split(" #")[0].strip()
        if line and not line.startswith(("#", "-")) and (r := _requirement(line)):
            yield "pypi", "", "", *r, "runtime"


def setup_py(text: str) -> Iterator[Row]:
    named = {k: (m[1] if (m := re.search(rf"""\b{k}\s*=\s*['"]([^'"]+)['"]""", text)) else "") for k in ("name", "version")}
    for table, kind in (("install_requires", "runtime"), ("tests_require", "dev"), ("setup_requires", "build")):
        if m := re.search(rf"{table}\s*=\s*\[(.*?)\]", text, re.S):
            for item in re.findall(r"""['"]([^'"]+)['"]""", m[1]):
                if r := _requirement(item):
                    yield "pypi", named["name"], named["version"], *r, kind


def pyproject(text: str) -> Iterator[Row]:
    project = tomllib.loads(text).get("project", {})
    for item in project.get("dependencies", []):
        if r := _requirement(item):
            yield "pypi", project.get("name", ""), project.get("version", ""), *r, "runtime"
    for items in project.get("optional-dependencies", {}).values():
        for item in items:
            if r := _requirement(item):
                yield "pypi", project.get("name", ""), project.get("version", ""), *r, "optional"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def nuget(text: str) -> Iterator[Row]:
    for e in ElementTree.fromstring(text).iter():
        if _local(e.tag) == "PackageReference":
            version = e.get("Version") or next((c.text or "" for c in e if _local(c.tag) == "Version"), "*")
            yield "nuget", "", "", e.get("Include", ""), version, "runtime"
        elif _local(e.tag) == "package" and e.get("id"):
            yield "nuget", "", "", e.get("id"), e.get("version", "*"), "dev" if e.get("developmentDependency") == "true" else "runtime"


def go(text: str) -> Iterator[Row]:
    module = m[1] if (m := re.search(r"^module\s+(\S+)", text, re.M)) else ""
    version = m[1] if (m := re.search(r"^go\s+(\S+)", text, re.M)) else ""
    block = False
    for line in text.splitlines():
        s = line.strip()
        if s.startswith("require ("):
            block = True
        elif block and s == ")":
            block = False
        elif m := re.match(r"(?:require\s+)?(\S+)\s+(v\S+)(\s*//\s*indirect)?", s):
            if block or s.startswith("require "):
                yield "go", module, version, m[1], m[2], "indirect" if m[3] else "runtime"


def composer(text: str) -> Iterator[Row]:
    found = json.loads(text)
    for table, kind in (("require", "runtime"), ("require-dev", "dev")):
        for name, constraint in (found.get(table) or {}).items():
            yield "composer", found.get("name", ""), found.get("version", ""), name, str(constraint), kind


def maven(text: str) -> Iterator[Row]:
    root = ElementTree.fromstring(text)

    def child(e, name: str) -> str:
        return next(((c.text or "").strip() for c in e if _local(c.tag) == name), "")

    package = f"{child(root, 'groupId')}:{child(root, 'artifactId')}"
    for e in root.iter():
        if _local(e.tag) == "dependency":
            kind = {"test": "dev", "provided": "build"}.get(child(e, "scope"), "runtime")
            yield "maven", package, child(root, "version"), f"{child(e, 'groupId')}:{child(e, 'artifactId')}", child(e, "version") or "*", kind


def gradle(text: str) -> Iterator[Row]:
    for m in re.finditer(r"""\b(implementation|api|compileOnly|runtimeOnly|testImplementation)\s*\(?\s*['"]([^:'"]+):([^:'"]+)(?::([^'"]+))?['"]""", text):
        yield "gradle", "", "", f"{m[2]}:{m[3]}", m[4] or "*", "dev" if m[1].startswith("test") else "build" if m[1] == "compileOnly" else "runtime"


def apt(text: str) -> Iterator[Row]:
    for part in re.split(r"\n\s*\n", text):
        fields = dict(re.findall(r"^(\w[\w-]*):\s*(.*)$", part, re.M))
        for item in filter(None, (d.strip() for d in fields.get("Depends", "").split(","))):
            m = re.match(r"([^\s(|]+)\s*(?:\(([^)]*)\))?", item)
            yield "apt", fields.get("Package", ""), fields.get("Version", ""), m[1], m[2] or "*", "runtime"


def pacman(text: str) -> Iterator[Row]:
    name = m[1] if (m := re.search(r"^pkgname=['\"(]*([\w.+-]+)", text, re.M)) else ""
    version = m[1] if (m := re.search(r"^pkgver=(\S+)", text, re.M)) else ""
    for table, kind in (("depends", "runtime"), ("makedepends", "build"), ("checkdepends", "dev"), ("optdepends", "optional")):
        if m := re.search(rf"^{table}=\(([^)]*)\)", text, re.M):
            for item in re.findall(r"""['"]?([^\s'"]+)['"]?""", m[1]):
                d = re.match(r"([^<>=:]+)([<>=].*)?", item)
                yield "pacman", name, version, d[1], d[2] or "*", kind


def docker(text: str) -> Iterator[Row]:
    for m in re.finditer(r"^\s*FROM\s+(?:--\S+\s+)*([^\s:@]+(?::\d+/[^\s:@]+)?)(?:[:@](\S+))?", text, re.M | re.I):
        yield "docker", "", "", m[1], m[2] or "latest", "runtime"


def oci(text: str) -> Iterator[Row]:
    found = json.loads(text)
    if config := found.get("config"):
        yield "oci", "", "", config.get("digest", ""), config.get("mediaType", "*"), "runtime"
    for layer in found.get("layers", []):
        yield "oci", "", "", layer.get("digest", ""), layer.get("mediaType", "*"), "optional" if "foreign" in layer.get("mediaType", "") else "runtime"
    for m in found.get("manifests", []):
        platform = m.get("platform", {})
        yield "oci", "", "", m.get("digest", ""), f"{platform.get('os', '')}/{platform.get('architecture', '')}", "runtime"


#: Which parser takes a file: by its name first, then by what it holds.
PARSERS: list[tuple[Callable[[str, str], bool], Callable[[str], Iterator[Row]]]] = [
    (lambda n, t: n == "cargo.toml", cargo), (lambda n, t: n == "package.json", npm), (lambda n, t: n.startswith("requirements") and n.endswith(".txt"), requirements),
    (lambda n, t: n == "setup.py", setup_py), (lambda n, t: n == "pyproject.toml", pyproject), (lambda n, t: n.endswith(".csproj") or n == "packages.config", nuget),
    (lambda n, t: n == "go.mod", go), (lambda n, t: n == "composer.json", composer), (lambda n, t: n == "pom.xml", maven), (lambda n, t: n in ("build.gradle", "build.gradle.kts"), gradle),
    (lambda n, t: n == "pkgbuild", pacman), (lambda n, t: n == "dockerfile" or n.endswith(".dockerfile"), docker), (lambda n, t: n in ("index.json", "manifest.json") and "application/vnd.oci" in t, oci),
    (lambda n, t: n == "packages" and "Package:" in t and "Version:" in t, apt),
]


def dependencies(path: str, text: str) -> list[Row]:
    """The dependencies that a manifest names; a file that is no manifest has none."""
    name = _name(path)
    for takes, parse in PARSERS:
        if takes(name, text):
            return list(parse(text))
    return []
