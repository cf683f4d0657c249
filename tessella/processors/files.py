"""Binary and document files: signatures, strings, images, video, PDF, office, pcap, git, containers, Markdown."""

from __future__ import annotations

import io
import json
import re
import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import Column, functions as F

#: Fixed signatures of file formats, as hex of the first bytes.
MAGIC = [
    ("7F454C46", "ELF"), ("4D5A", "PE"), ("CEFAEDFE", "Mach-O (32-bit)"), ("CFFAEDFE", "Mach-O (64-bit)"), ("CAFEBABE", "Mach-O universal"),
    ("89504E47", "PNG image"), ("FFD8FF", "JPEG image"), ("47494638", "GIF image"), ("25504446", "PDF"), ("504B0304", "ZIP archive"),
    ("1F8B08", "GZIP archive"), ("425A68", "BZIP2 archive"), ("FD377A58", "XZ archive"), ("72617221", "RAR archive"), ("00000018", "MP4 video"), ("52494646", "AVI/WAV container"),
]
#: Fixed machine numbers of ELF files.
ELF_MACHINES = {0x03: "x86", 0x3E: "x86_64", 0x28: "ARM", 0xB7: "AArch64", 0xF3: "RISC-V", 0x08: "MIPS", 0x14: "PowerPC"}
#: Fixed link types of capture files.
LINK_TYPES = {0: "Null", 1: "Ethernet", 101: "Raw IP", 105: "IEEE 802.11", 113: "Linux cooked", 127: "Radiotap"}


def magic(data: Column) -> Column:
    """The format that a binary column's first bytes tell, or null."""
    head = F.hex(F.substring(data, 1, 4))
    out = F.lit(None).cast("string")
    for signature, name in reversed(MAGIC):
        out = F.when(head.startswith(signature), name).otherwise(out)
    return F.when(F.octet_length(data) >= 4, out)


def strings(data: bytes, least: int = 4) -> list[str]:
    """Runs of printable ASCII."""
    return [m.decode() for m in re.findall(rb"[\x20-\x7e]{%d,}" % least, data)]


def elf(data: bytes) -> dict[str, str]:
    if data[:4] != b"\x7fELF" or len(data) < 20:
        return {}
    order = "<" if data[5] == 1 else ">"
    out = {"class": "64-bit" if data[4] == 2 else "32-bit", "machine": ELF_MACHINES.get(struct.unpack_from(order + "H", data, 18)[0], "unknown")}
    if len(data) >= 32:
        out["entry"] = hex(struct.unpack_from(order + ("Q" if data[4] == 2 else "I"), data, 24)[0])
    return out


def dimensions(data: bytes) -> tuple[str, int, int] | None:
    """Format, width and height of a PNG, GIF or JPEG image."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return ("png", *struct.unpack_from(">II", data, 16))
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return ("gif", *struct.unpack_from("<HH", data, 6))
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(data) and data[at] == 0xFF:
            marker = data[at + 1]
            if marker in (0xC0, 0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
                height, width = struct.unpack_from(">HH", data, at + 5)
                return "jpeg", width, height
            at += 2 + struct.unpack_from(">H", data, at + 2)[0]
    return None


def container(data: bytes) -> str:
    """The container format of a video file."""
    if data[4:8] == b"ftyp":
        return "mp4"
    if data[:4] == b"RIFF" and data[8:12] == b"AVI ":
        return "avi"
    if data[:4] == b"\x1aE\xdf\xa3":
        return "webm" if b"webm" in data[:64] else "matroska"
    if data[:3] == b"FLV":
        return "flv"
    if data[:4] == b"OggS":
        return "ogg"
    return "unknown"


def pdf_version(data: bytes) -> str | None:
    m = re.match(rb"%PDF-(\d\.\d)", data)
    return m[1].decode() if m else None


def office_text(data: bytes) -> tuple[str, str]:
    """Kind and text of a docx, xlsx or pptx file."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted(z.namelist())
        for kind, pattern in (("docx", r"word/document\.xml"), ("xlsx", r"xl/sharedStrings\.xml"), ("pptx", r"ppt/slides/slide\d+\.xml")):
            parts = [n for n in names if re.fullmatch(pattern, n)]
            if parts:
                texts = []
                for name in parts:
                    for element in ElementTree.fromstring(z.read(name)).iter():
                        if element.tag.rpartition("}")[2] == "t" and element.text:
                            texts.append(element.text)
                return kind, " ".join(texts)
    return "unknown", ""


def capture(data: bytes) -> tuple[str, int]:
    """Link type and number of packets of a capture file."""
    number = data[:4]
    order = "<" if number in (b"\xd4\xc3\xb2\xa1", b"\x4d\x3c\xb2\xa1") else ">" if number in (b"\xa1\xb2\xc3\xd4", b"\xa1\xb2\x3c\x4d") else None
    if order is None or len(data) < 24:
        raise ValueError("not a capture file")
    link = LINK_TYPES.get(struct.unpack_from(order + "I", data, 20)[0], "unknown")
    at, packets = 24, 0
    while at + 16 <= len(data):
        at += 16 + struct.unpack_from(order + "I", data, at + 8)[0]
        packets += at <= len(data)
    return link, packets


def git_file(data: bytes) -> tuple[str, dict[str, str]]:
    """What a file of a git folder is: pack, head, config or object."""
    if data[:4] == b"PACK" and len(data) >= 12:
        version, objects = struct.unpack_from(">II", data, 4)
        return "pack", {"version": str(version), "objects": str(objects)}
    text = data.decode("utf-8", "replace").strip()
    if text.startswith("ref: "):
        return "head", {"ref": text[5:]}
    if re.fullmatch(r"[0-9a-f]{40}", text):
        return "head", {"commit": text}
    if text.startswith("["):
        return "config", {"sections": str(len(re.findall(r"^\[", text, re.M)))}
    return "object", {}


def dockerfile(text: str) -> dict[str, object]:
    """Base images, stages and instruction counts of a Dockerfile."""
    images, stages, counts = [], [], {}
    for line in re.sub(r"\\\n", " ", text).splitlines():
        m = re.match(r"\s*([A-Za-z]+)\s+(.+)", line)
        if not m or line.lstrip().startswith("#"):
            continue
        word = m[1].upper()
        counts[word] = counts.get(word, 0) + 1
        if word == "FROM":
            parts = [p for p in m[2].split() if not p.startswith("--")]
            images.append(parts[0])
            if len(parts) > 2 and parts[1].upper() == "AS":
                stages.append(parts[2])
    return {"images": images, "stages": stages, "instructions": counts}


def oci_manifest(text: str) -> dict[str, object]:
    """Layers, their total size, and the config digest of an image manifest."""
    found = json.loads(text)
    layers = found.get("layers", [])
    return {"layers": len(layers), "size": sum(x.get("size", 0) for x in layers), "config": found.get("config", {}).get("digest"), "digests": [x.get("digest") for x in layers]}


def markdown(text: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(kind, value, metadata) of front matter, headings, text below each heading, and code blocks."""
    lines = text.splitlines()
    at = 0
    if lines and lines[0].strip() == "---" and "---" in (x.strip() for x in lines[1:]):
        end = next(i for i, x in enumerate(lines[1:], 1) if x.strip() == "---")
        yield "markdown.frontmatter", "\n".join(lines[1:end]), {}
        at = end + 1
    paragraph: list[str] = []
    heading = ""

    def flush() -> Iterator[tuple[str, str, dict[str, str]]]:
        body = "\n".join(paragraph).strip()
        if body:
            yield "markdown.text", body, {"heading": heading}
        paragraph.clear()

    while at < len(lines):
        line = lines[at]
        if line.lstrip().startswith("```"):
            yield from flush()
            language = line.strip()[3:].strip()
            code = []
            at += 1
            while at < len(lines) and not lines[at].lstrip().startswith("```"):
                code.append(lines[at])
                at += 1
            yield "markdown.code_block", "\n".join(code), {"language": language}
        elif m := re.match(r"(#{1,6})\s+(.*)", line):
            yield from flush()
            heading = m[2].strip()
            yield "markdown.heading", heading, {"level": str(len(m[1]))}
        else:
            paragraph.append(line)
        at += 1
    yield from flush()
