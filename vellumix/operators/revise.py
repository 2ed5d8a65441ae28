"""Two versions of a document become one: what proofreading lost, and what an update changed. Each pair is a row; nothing depends on any other row."""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as E

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import pieces, spread

DB, XML = "{http://docbook.org/ns/docbook}", "{http://www.w3.org/XML/1998/namespace}"
SYNOPSES = ("fieldsynopsis", "methodsynopsis", "constructorsynopsis", "destructorsynopsis", "enumsynopsis", "typedefsynopsis", "classsynopsis", "namespacesynopsis")
SECTIONS = ("section", *(f"sect{k}" for k in range(1, 7)), "chapter")
NAMESPACES = {"": DB[1:-1], "xlink": "http://www.w3.org/1999/xlink"}


def local(e: E.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else "#"


def sections(root: E.Element) -> Iterator[tuple[tuple[int, int], E.Element, E.Element]]:
    """Sections in document order, each with its place (ancestors, sections before it that have ended) and its parent."""
    ended = 0

    def walk(e: E.Element, depth: int):
        nonlocal ended
        for c in list(e):
            mine = local(c) in SECTIONS
            if mine:
                yield (depth + 1, ended), c, e
            yield from walk(c, depth + 1)
            ended += mine

    yield from walk(root, 0)


def words(e: E.Element) -> str:
    return " ".join("".join(e.itertext()).split())


def own_words(e: E.Element) -> str:
    """The text of a section without that of the sections within it."""
    return " ".join(x for c in e if local(c) not in SECTIONS for x in [words(c)])


def after_proofreading(original: E.Element, altered: E.Element, problems: list[str]) -> E.Element:
    """The altered document with the synopses of the original's sections at the same places, and the metadata that it lacks."""
    places = {at: s for at, s, _ in sections(original)}
    ids = {s.get(f"{XML}id") for s in places.values()} - {None}
    for at, s, _ in sections(altered):
        if at in places:
            lost = [copy.deepcopy(x) for kind in SYNOPSES for x in places[at] if local(x) == kind]
            for x in s.findall("*"):
                if local(x) in SYNOPSES:
                    s.remove(x)
            titles = [k for k, x in enumerate(s) if local(x) in ("title", "info")]
            for k, x in enumerate(lost):
                s.insert((titles[-1] + 1 if titles else 0) + k, x)
    for parent in altered.iter():
        for b in [x for x in parent if local(x) == "bridgehead" and x.get(f"{XML}id") in ids]:
            problems.append(f"section_became_bridgehead:{b.get(f'{XML}id')}")
    first = lambda root: next((x for x in root if local(x) == "info"), None)
    mine, theirs = first(altered), first(original)
    if theirs is not None:
        if mine is None:
            mine = E.Element(f"{DB}info")
            altered.insert(0, mine)
        there = {local(x) for x in mine}
        mine.extend(copy.deepcopy(x) for x in theirs if local(x) not in there)
        at = list(altered).index(mine) + 1
        kept = {words(x) for x in altered if local(x) in ("classsynopsis", "namespacesynopsis")}
        for x in [x for kind in ("classsynopsis", "namespacesynopsis") for x in original if local(x) == kind and words(x) not in kept]:
            altered.insert(at, copy.deepcopy(x))
            at += 1
    return altered


def _known(root: E.Element) -> dict:
    """Sections by their ids, else by their places."""
    return {s.get(f"{XML}id") or at: s for at, s, _ in sections(root)}


def update(old: E.Element, new: E.Element, problems: list[str]) -> E.Element:
    """The new version; sections that the old one lacks have the flag added, and those of another text changed."""
    before = _known(old)
    now = _known(new)
    for key, s in now.items():
        if key not in before:
            s.set("revisionflag", "added")
        elif own_words(s) != own_words(before[key]):
            s.set("revisionflag", "changed")
    problems += [f"section_deleted:{k if isinstance(k, str) else '_'.join(map(str, k))}" for k in before if k not in now]
    return new


def update_translation(translated: E.Element, flagged: E.Element, problems: list[str]) -> E.Element:
    """The flagged new version with the translation of what hasn't changed; changed sections stand behind their old translation, which is flagged as deleted."""
    old = _known(translated)
    for at, s, parent in list(sections(flagged)):
        there = old.get(s.get(f"{XML}id") or at)
        if there is None or s.get("revisionflag") == "added":
            continue
        own = [copy.deepcopy(c) for c in there if local(c) not in SECTIONS]
        if s.get("revisionflag") == "changed":
            gone = E.Element(s.tag, {k: v for k, v in there.attrib.items() if k != f"{XML}id"} | {"revisionflag": "deleted"})
            gone.extend(own)
            parent.insert(list(parent).index(s), gone)
        else:
            inner = [c for c in s if local(c) in SECTIONS]
            for c in list(s):
                s.remove(c)
            s.extend([*own, *inner])
    return flagged


KINDS: dict[str, Callable] = {"after_proofreading": after_proofreading, "update": update, "update_translation": update_translation}


def merge_texts(original: str | None, altered: str | None, kind: str) -> tuple[str | None, list[str]]:
    """The merged document and what was noticed; without both documents in DocBook there is no result."""
    roots, problems = [], []
    for side, text in (("original", original), ("altered", altered)):
        if text is None:
            problems.append(f"{side}_lacks")
            continue
        try:
            if "<!ENTITY" in text:
                raise ValueError
            root = E.fromstring(text)
        except (E.ParseError, ValueError):
            problems.append(f"{side}_not_well_formed")
            continue
        if not root.tag.startswith(DB):
            problems.append(f"{side}_not_docbook")
        roots.append(root)
    if problems:
        return None, problems
    for prefix, uri in NAMESPACES.items():
        E.register_namespace(prefix, uri)
    return E.tostring(KINDS[kind](*roots, problems), encoding="unicode"), problems


def merge_documents(pairs: DataFrame, key: str | Column, original: str, altered: str, kind: str) -> DataFrame:
    """key, content and problems of every pair. kind: after_proofreading, update or update_translation.

    Defined results. A side that is null, not well-formed or not DocBook gives no content and a problem that says so; keys may be null or repeat. Sections of one id, or at one place, are the same;
    of several with one id the last counts. Only the three columns are read."""
    if kind not in KINDS:
        raise ValueError(f"no such merge: {kind}")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            made = [merge_texts(a, b, kind) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in made], pa.string()), pa.array([p for _, p in made], pa.list_(pa.string()))], ["name", "content", "problems"])

    name = F.col(key) if isinstance(key, str) else key
    rows = pairs.select(name.cast("string").alias("name"), F.col(original).cast("string").alias("original"), F.col(altered).cast("string").alias("altered"))
    return spread(rows, "name", "altered").mapInArrow(each, "name string, content string, problems array<string>")
