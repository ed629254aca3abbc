"""Presentations: a .pptx is a zip of XML, which the standard library reads.

Register with `files.register(".pptx", slides.read_pptx)`.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"


def _clean(text: str) -> str:
    return "\n".join(filter(None, (" ".join(line.split()) for line in text.splitlines())))


def _paragraphs(node: ElementTree.Element) -> str:
    return _clean("\n".join("".join(t.text or "" for t in p.iter(f"{A}t")) for p in node.iter(f"{A}p")))


def _placeholder(shape: ElementTree.Element) -> str:
    mark = shape.find(f"{P}nvSpPr/{P}nvPr/{P}ph")
    return "" if mark is None else mark.get("type", "body")


def _shapes(tree: ElementTree.Element) -> Iterator[tuple[str, str]]:
    """(placeholder, text) of shapes in order, those in groups too; rows of tables are joined by bars."""
    for node in tree:
        if node.tag == f"{P}sp":
            yield _placeholder(node), _paragraphs(node)
        elif node.tag == f"{P}grpSp":
            yield from _shapes(node)
        elif node.tag == f"{P}graphicFrame":
            for row in node.iter(f"{A}tr"):
                yield "", " | ".join(filter(None, (_paragraphs(cell).replace("\n", " ") for cell in row.iter(f"{A}tc"))))


def read_pptx(path: str, content: bytes, notes: bool = True) -> Iterator[dict]:
    """A section for each slide that holds text."""
    with zipfile.ZipFile(io.BytesIO(content)) as pack:
        names = set(pack.namelist())
        numbers = sorted(int(m[1]) for n in names if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        index = 0
        for number in numbers:
            tree = ElementTree.fromstring(pack.read(f"ppt/slides/slide{number}.xml")).find(f"{P}cSld/{P}spTree")
            shapes = [s for s in _shapes(tree) if s[1]]
            title = next((t for kind, t in shapes if kind in ("title", "ctrTitle")), None)
            said = ""
            relations = f"ppt/slides/_rels/slide{number}.xml.rels"
            if notes and relations in names:
                for relation in ElementTree.fromstring(pack.read(relations)):
                    if relation.get("Type", "").endswith("/notesSlide"):
                        page = ElementTree.fromstring(pack.read("ppt/" + relation.get("Target").removeprefix("../")))
                        said = "\n".join(t for kind, t in _shapes(page.find(f"{P}cSld/{P}spTree")) if kind == "body" and t)
            visible = "\n".join(t for kind, t in shapes if kind not in ("title", "ctrTitle"))
            blocks = [f"Slide title: {title}" if title else "", visible, f"Speaker notes:\n{said}" if said else ""]
            text = "\n\n".join(filter(None, blocks))
            if text:
                yield {"index": index, "text": text, "raw_text": text, "heading": title, "slide_number": number, "extraction_method": "pptx_xml"}
                index += 1
