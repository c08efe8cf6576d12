"""Small helpers over ElementTree: names without namespaces, texts, kept subtrees."""

from __future__ import annotations

import json
import uuid
import xml.etree.ElementTree as ET
from collections.abc import Iterator


def parse(text: str) -> ET.Element:
    """The root; documents with a DTD are refused, since entities could blow them up."""
    if "<!DOCTYPE" in text[:4096] or "<!ENTITY" in text:
        raise ET.ParseError("document type definitions are not read")
    return ET.fromstring(text.lstrip("﻿").strip())


def name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def children(e: ET.Element, *names: str) -> Iterator[ET.Element]:
    return (c for c in e if not names or name(c) in names)


def first(e: ET.Element | None, *path: str) -> ET.Element | None:
    for p in path:
        e = None if e is None else next(children(e, p), None)
    return e


def text(e: ET.Element | None, *path: str) -> str | None:
    """Text of an element, or null where it is missing or empty."""
    e = first(e, *path)
    got = "" if e is None else "".join(e.itertext()).strip()
    return got or None


def leaf(e: ET.Element | None) -> str | None:
    """Text of an element, or null where it is missing or empty."""
    if e is None:
        return None
    return ("".join(e.itertext()) if len(e) else e.text or "").strip() or None


def firsts(e: ET.Element) -> dict[str, ET.Element]:
    """The first child of each name."""
    out: dict[str, ET.Element] = {}
    for c in e:
        out.setdefault(c.tag.rpartition("}")[2], c)
    return out


def keep(elements: list[ET.Element]) -> str | None:
    """Subtrees as JSON, for columns that carry them through."""
    return json.dumps([_tree(e) for e in elements], ensure_ascii=False) if elements else None


def _tree(e: ET.Element) -> dict:
    out = {"tag": e.tag}
    if e.attrib:
        out["attributes"] = dict(e.attrib)
    if (e.text or "").strip():
        out["text"] = e.text.strip()
    if len(e):
        out["children"] = [_tree(c) for c in e]
    return out


def put(parent: ET.Element, tag: str, value=None, **attributes) -> ET.Element:
    e = ET.SubElement(parent, tag, {k: v for k, v in attributes.items() if v is not None})
    if value is not None:
        e.text = str(value)
    return e


def restore(parent: ET.Element, kept: str | None) -> None:
    """Appends subtrees that keep() stored."""
    for node in json.loads(kept or "[]"):
        _grow(parent, node)


def _grow(parent: ET.Element, node: dict) -> None:
    e = ET.SubElement(parent, node["tag"], node.get("attributes", {}))
    e.text = node.get("text")
    for c in node.get("children", []):
        _grow(e, c)


def escaped(text) -> str:
    return str(text).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


class Bodies:
    """Elements whose children are written as text at once, since a tree of every point takes most of the time."""

    def __init__(self):
        self.texts: list[str] = []
        self.mark = f"\0{uuid.uuid4().hex}\0"

    def put(self, e: ET.Element, lines: list[str], level: int) -> None:
        """The lines between the tags of e, which is so deep in the tree."""
        if lines:
            e.text = self.mark
            self.texts.append("\n" + "\n".join(lines) + "\n" + "  " * level)


def show(root: ET.Element, bodies: Bodies | None = None) -> str:
    ET.indent(root)
    out = '<?xml version="1.0" encoding="UTF-8"?>\n' + ET.tostring(root, encoding="unicode") + "\n"
    if bodies is None:
        return out
    between = out.split(bodies.mark)
    return "".join(t for pair in zip(between, [*bodies.texts, ""], strict=True) for t in pair)
