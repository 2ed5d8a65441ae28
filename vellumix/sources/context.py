"""What the mapping rules ask of a node beyond itself, told by the parser: it has the whole document at hand, so no window and no join is needed afterwards."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import mapping
from ..operators.tree import NODE
from . import markup
from .shared import PIECE_BYTES, pieces, tasks

CONTEXT = (
    "parent_local string, before string, nth int, in_code boolean, in_head boolean, splits boolean, split boolean, number string, label string, ref_number int, opens boolean, closes boolean, "
    "last int, gone boolean, around_open string, around_close string"
)
FIELDS = tuple(f.split()[0] for f in CONTEXT.split(", "))
PRE, PARENT, DEPTH, KIND, LOCAL, ATTRS, TEXT = 0, 2, 3, 5, 8, 9, 10
ROMAN = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))
SECTIONS, BLOCKS, CODE = frozenset(mapping.SECTIONS), frozenset(mapping.BLOCKS), frozenset(mapping.CODE)


def roman(n: int) -> str:
    out = ""
    for value, sign in ROMAN:
        out += sign * (n // value)
        n %= value
    return out


class Document:
    """The nodes of a document and what stands around them."""

    def __init__(self, rows: list[list], dropped: frozenset) -> None:
        self.rows, self.extra = rows, []
        below: dict[int, list[int]] = {}
        kids: dict[int, list[list]] = {}
        for r in rows:
            below.setdefault(r[PARENT], []).append(r[PRE])
            if r[KIND] == "elem":
                kids.setdefault(r[PARENT], []).append(r)
        self.below, self.kids = below, kids  # all nodes, and the elements alone
        names: dict[tuple[int, str], int] = {}
        last_of: dict[int, str] = {}
        ids: dict[str, list] = {}
        uses: dict[str, int] = {}
        up: list[dict] = []  # by depth: what holds for all below
        for r in rows:
            del up[r[DEPTH] :]
            above = up[-1] if up else {"local": None, "code": False, "head": False, "gone": False, "path": (), "sections": {}}
            key = (r[PARENT], r[LOCAL])
            names[key] = nth = names.get(key, 0) + 1
            element, section = r[KIND] == "elem", r[KIND] == "elem" and r[LOCAL] in SECTIONS
            path = above["path"]
            if section:
                at = above["sections"]["n"] = above["sections"].get("n", 0) + 1
                path = (*path, at)
            block = above["local"] == "para" and element and r[LOCAL] in BLOCKS
            first_block = block and not above.get("blocked")
            if first_block:
                above["blocked"] = True
                self.extra[r[PARENT] - 1]["split"] = True
            gone = above["gone"] or (element and r[LOCAL] in dropped)
            number = ".".join([roman(path[0]), *map(str, path[1:])]) if section else None
            self.extra.append(
                {"parent_local": above["local"], "before": last_of.get(r[PARENT]), "nth": nth, "in_code": above["code"], "in_head": above["head"], "splits": first_block, "split": False, "number": number, "label": None,
                 "ref_number": None, "opens": False, "closes": False, "last": r[PRE], "gone": gone, "around_open": "", "around_close": ""}
            )
            last_of[r[PARENT]] = r[LOCAL]
            if element:
                up.append({"local": r[LOCAL], "code": above["code"] or r[LOCAL] in CODE, "head": above["head"] or r[LOCAL] in ("thead", "entete"), "gone": gone, "path": path, "sections": {}})
                if (ident := r[ATTRS].get("xml:id")) is not None:
                    ids.setdefault(ident, r)
                if r[LOCAL] == "biblioref" and "endterm" in r[ATTRS]:
                    uses.setdefault(r[ATTRS]["endterm"], len(uses) + 1)
        for r, x in zip(reversed(rows), reversed(self.extra)):
            if r[PARENT]:
                parent = self.extra[r[PARENT] - 1]
                parent["last"] = max(parent["last"], x["last"])
        for r, x in zip(rows, self.extra):
            a = r[ATTRS]
            ref = a.get("linkend", a.get("endterm")) if a else None
            if ref is not None:
                x["ref_number"] = uses.get(ref)
                title = self.child(ids[ref][PRE], "title") if ref in ids else None
                x["label"] = self.text(title[PRE]) if title else None
        self._lead_in()

    def node(self, pre: int) -> list:
        return self.rows[pre - 1]

    def elements(self, pre: int, *names: str) -> list[list]:
        own = self.kids.get(pre, ())
        return [r for r in own if r[LOCAL] in names] if names else list(own)

    def child(self, pre: int, name: str) -> list | None:
        for r in self.kids.get(pre, ()):
            if r[LOCAL] == name:
                return r
        return None

    def all(self, pre: int, *names: str) -> Iterator[list]:
        for r in self.rows[pre : self.extra[pre - 1]["last"]]:
            if r[KIND] == "elem" and (not names or r[LOCAL] in names):
                yield r

    def text(self, pre: int, without: tuple[str, ...] = ()) -> str:
        """The text below a node, but for what is within elements of these names."""
        out, skip = [], 0
        for r in self.rows[pre - 1 : self.extra[pre - 1]["last"]]:
            if r[PRE] <= skip:
                continue
            if r[KIND] == "elem" and r[LOCAL] in without and r[PRE] != pre:
                skip = self.extra[r[PRE] - 1]["last"]
            elif r[KIND] == "text":
                out.append(r[TEXT])
        return "".join(out)

    def _lead_in(self) -> None:
        """What stands before the first section of an article or chapter that has one goes into a section without number."""
        for r in self.rows:
            if r[KIND] == "elem" and r[LOCAL] in ("article", "chapter"):
                inner = self.elements(r[PRE])
                first = next((c[PRE] for c in inner if c[LOCAL] in SECTIONS), None)
                early = [c[PRE] for c in inner if first and c[PRE] < first and c[LOCAL] not in ("info", "title", *mapping.DROPPED)]
                if early:
                    self.extra[early[0] - 1]["opens"] = self.extra[early[-1] - 1]["closes"] = True


def in_context(docs: DataFrame, doc_id: str, content: str, fmt: str = "xml", dropped: list[str] = (), more: Callable[[Document, dict], None] | None = None, config: str | None = None, only: tuple[str, ...] | None = None, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The nodes of all documents with CONTEXT. more: changes a document's extra columns, given its configuration (a column map<string,string>).

    Documents go over all cores by the hash of doc_id first. Where a plan reads no others: only names the columns that it reads, keep the elements that are given with what is right below them.
    What is returned has `written`, by which mappings write the documents at once, without the table of nodes."""
    shred, left_out = {"xml": markup.shred_xml, "html": markup.shred_html}[fmt], frozenset(dropped)
    types = dict(zip(markup.FIELDS, [pa.int32()] * 5 + [pa.string()] * 4 + [pa.map_(pa.string(), pa.string()), pa.string()]))
    types |= {f.split()[0]: {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[f.split()[1]] for f in CONTEXT.split(", ")}
    schema = [f for f in f"{NODE}, {CONTEXT}".split(", ") if only is None or f.split()[0] in ("doc_id", *only)]
    names = [f.split()[0] for f in schema[1:]]
    place = {f: k for k, f in enumerate(markup.FIELDS)}

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Document, int]]:
        for batch in pieces(batches):
            for i, text, given in zip(*(c.to_pylist() for c in batch.columns)):
                if text:
                    d = Document(shred(text), left_out)
                    if more is not None:
                        more(d, dict(given or ()))
                    yield i, d, len(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def column(f: str) -> list:
            if f not in place:
                return [e[f] for e in extras]
            k = place[f]
            return [list(r[k].items()) for r in rows] if f == "attrs" else [r[k] for r in rows]

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(column(f), types[f]) for f in names)], ["doc_id", *names])

        ids, rows, extras, size = [], [], [], 0
        for i, d, n in documents(batches):
            kept = d.rows if keep is None else [r for r in d.rows if r[LOCAL] in keep or d.extra[r[PRE] - 1]["parent_local"] in keep]
            rows += kept
            extras += d.extra if keep is None else [d.extra[r[PRE] - 1] for r in kept]
            ids += [i] * len(kept)
            size += n
            if len(rows) > 20_000 or size > PIECE_BYTES:
                yield emit()
                ids, rows, extras, size = [], [], [], 0
        yield emit()

    def written(markup: str, lead: bool = False, pages: bool = False) -> DataFrame:
        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def emit() -> pa.RecordBatch:
                cols = list(zip(*out)) or [(), (), ()]
                arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string()))]
                return pa.RecordBatch.from_arrays(arrays if pages else [arrays[0], arrays[2]], ["doc_id", "page", "xml"] if pages else ["doc_id", "xml"])

            out, size = [], 0
            rules = mapping.calls(markup)
            for i, d, n in documents(batches):
                out += [(i, *x) for x in mapping.written(d.rows, d.extra, rules, lead, pages)]
                size += n
                if size > PIECE_BYTES:
                    yield emit()
                    out, size = [], 0
            yield emit()

        return texts.mapInArrow(write, "doc_id long, page int, xml string" if pages else "doc_id long, xml string")

    given = F.col(config) if config else F.lit(None).cast("map<string,string>")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(content).cast("string").alias("content"), given.alias("config"))
    texts = texts.repartition(tasks(docs.sparkSession), "doc_id")
    nodes = texts.mapInArrow(run, ", ".join(schema))
    nodes.written = written
    return nodes
