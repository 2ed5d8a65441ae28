"""What a class's page lists, from its DocBook and its HTML: types, properties, public functions, signals, and the classes that inherit it.

Defined results. Pages that aren't of a class, empty ones and those that aren't well-formed list nothing; HTML is read however it is written. Members that repeat count once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .markup import shred_html, shred_xml
from .shared import pieces, spread

MEMBERS = "doc_id long, is_class boolean, check string, element string"
TYPES, PROPERTIES, FUNCTIONS, SIGNALS, INHERITED = "types", "properties", "public_functions", "signals", "inherited_by"
#: Headings of an HTML page (their ids) whose lists make up each check; related non-members are types where the first column says so.
HEADINGS = {
    TYPES: ("public-types",),
    PROPERTIES: ("properties",),
    FUNCTIONS: ("public-functions", "public-slots", "reimplemented-public-functions", "reimplemented-protected-functions", "static-public-members", "protected-functions"),
    SIGNALS: ("signals",),
}
RELATED = "related-non-members"


class _Tree:
    def __init__(self, rows: list[list]) -> None:
        self.rows, self.below, self.kids, self.place, self.heads = rows, {}, {}, {}, {}  # kids: elements alone; heads: second headings by their ids
        for r in rows:
            self.below.setdefault(r[2], []).append(r)
            if r[5] == "elem":
                own = self.kids.setdefault(r[2], [])
                self.place[r[0]] = len(own)
                own.append(r)
                if r[8] == "h2" and "id" in r[9]:
                    self.heads.setdefault(r[9]["id"], r)

    def elements(self, pre: int) -> list[list]:
        return self.kids.get(pre, [])

    def all(self, r: list) -> Iterator[list]:
        """The elements below, in order."""
        stack = self.elements(r[0])[::-1]
        while stack:
            x = stack.pop()
            yield x
            stack += self.elements(x[0])[::-1]

    def text(self, r: list) -> str:
        out, stack = [], [r]
        while stack:
            x = stack.pop()
            if x[5] == "text":
                out.append(x[10])
            stack += self.below.get(x[0], [])[::-1]
        return " ".join("".join(out).split())

    def before(self, r: list) -> list | None:
        at = self.place[r[0]]
        return self.kids[r[2]][at - 1] if at else None

    def after(self, r: list) -> list | None:
        own, at = self.kids[r[2]], self.place[r[0]] + 1
        return own[at] if at < len(own) else None


def of_docbook(text: str) -> tuple[bool, set[tuple[str, str]]]:
    """Whether it is a class, and its (check, element)."""
    t = _Tree(shred_xml(text))
    elements = [r for r in t.rows if r[5] == "elem"]
    out: set[tuple[str, str]] = set()
    for r in elements:
        name, parent = r[8], t.rows[r[2] - 1] if r[2] else None
        up = parent[8] if parent else ""
        if name == "enumname" and up == "enumsynopsis":
            out.add((TYPES, t.text(r)))
        elif name == "typedefname" and up == "typedefsynopsis":
            before = t.before(parent)
            if before is None or before[8] != "enumsynopsis":  # the flags of an enumeration are no type of their own
                out.add((TYPES, t.text(r)))
        elif name == "varname" and up == "fieldsynopsis":
            out.add((PROPERTIES, t.text(r)))
        elif name == "methodname" and up in ("methodsynopsis", "constructorsynopsis", "destructorsynopsis"):
            signal = up == "methodsynopsis" and any(x[8] == "modifier" and t.text(x) == "signal" for x in t.elements(parent[0]))
            out.add((SIGNALS if signal else FUNCTIONS, t.text(r)))
        elif name == "classsynopsisinfo" and r[9].get("role") == "inheritedBy":
            out.add((INHERITED, t.text(r)))
    return any(r[8] == "classsynopsis" for r in elements), out


def _listed(t: _Tree, heading: str, enums: bool = False, first: Callable[[str], bool] | None = None) -> set[str]:
    """Link texts of the element behind a heading. enums: a link to where the one before it goes is left out; first: what the cell before has to say."""
    head = t.heads.get(heading)
    body = t.after(head) if head else None
    out, last = set(), ""
    for a in t.all(body) if body else ():
        if a[8] != "a":
            continue
        href = a[9].get("href", "")
        take = not (enums and last and href == last)
        last = href if enums else last
        cell = t.rows[t.rows[a[2] - 1][2] - 1] if a[2] and t.rows[a[2] - 1][2] else None
        column = t.before(cell) if cell else None
        if take and first is not None and column is not None:
            take = first(t.text(column))
        if take:
            out.add(t.text(a))
    return out


def of_html(text: str) -> tuple[bool, set[tuple[str, str]]]:
    t = _Tree(shred_html(text))
    out = {(check, e) for check, headings in HEADINGS.items() for h in headings for e in _listed(t, h, enums=check == TYPES)}
    out |= {(TYPES, e) for e in _listed(t, RELATED, first=lambda s: s == "typedef")} | {(FUNCTIONS, e) for e in _listed(t, RELATED, first=lambda s: s != "typedef")}
    whole = " ".join("".join(r[10] for r in t.rows if r[5] == "text").split())
    says = [r for r in t.rows if r[5] == "elem" and "Inherited By:" in t.text(r)] if "Inherited By:" in whole else []
    if says:
        beside = [x for x in t.elements(says[-1][2]) if x is not says[-1]]
        out |= {(INHERITED, t.text(a)) for a in t.all(beside[0]) if a[8] == "a"} if beside else set()
    return True, out


def members(docs: DataFrame, doc_id: str, content: str, fmt: str) -> DataFrame:
    """doc_id, is_class, check and element of every document of a format (docbook or html); a document without any has one row without check."""
    read = {"docbook": of_docbook, "html": of_html}[fmt]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    is_class, found = read(text or "")
                except expat.ExpatError:
                    is_class, found = False, set()
                rows += [(i, is_class, c, e) for c, e in sorted(found)] or [(i, is_class, None, None)]
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.bool_(), pa.string(), pa.string()))], ["doc_id", "is_class", "check", "element"])

    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(content).cast("string").alias("content"))
    return spread(texts, "doc_id", "content").mapInArrow(each, MEMBERS)


def compare_members(docbook: DataFrame, html: DataFrame) -> DataFrame:
    """doc_id, check, numbers on either side, what either side lacks, and whether the sets are equal; for documents that are a class in DocBook."""
    classes = docbook.filter("is_class").select("doc_id").distinct()
    mark = lambda df, side: df.filter("check IS NOT NULL").select("doc_id", "check", "element", F.lit(side).alias("side"))
    both = mark(docbook, 1).unionByName(mark(html, 2)).groupBy("doc_id", "check", "element").agg(F.sum(F.col("side")).alias("side"))
    only = lambda k: F.array_join(F.array_sort(F.collect_list(F.when(F.col("side") == k, F.col("element")))), ",")
    out = both.groupBy("doc_id", "check").agg(F.count_if(F.col("side") != 2).alias("n_docbook"), F.count_if(F.col("side") != 1).alias("n_html"), only(1).alias("only_docbook"), only(2).alias("only_html"), F.every(F.col("side") == 3).alias("equal"))
    return out.join(classes, "doc_id", "left_semi")
