"""Markup sources: XML and lenient HTML are shredded into nodes (see operators.tree), one document at a time, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tree import NODE
from .shared import PIECE_BYTES, cut, pieces, spread

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
IMPLIED = {"p": {"p", "div", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "section", "article", "footer", "header", "nav"}, "li": {"li"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
FIELDS = ("pre", "post", "parent", "depth", "sib", "kind", "ns", "qname", "local", "attrs", "text")


class Shredder:
    """Numbers nodes as they begin and end. Neighbouring pieces of text are one node."""

    def __init__(self) -> None:
        self.rows: list[list] = []
        self.stack: list[int] = []
        self.siblings = [0]
        self.ended = 0
        self.pending: list[str] = []

    def _add(self, kind: str, ns: str | None, qname: str, attrs: dict, text: str | None) -> int:
        self.siblings[-1] += 1
        pre = len(self.rows) + 1
        self.rows.append([pre, 0, self.stack[-1] if self.stack else 0, len(self.stack), self.siblings[-1], kind, ns, qname, qname.rpartition(":")[2], attrs, text])
        return pre

    def _leaf(self, *args) -> None:
        pre = self._add(*args)
        self.ended += 1
        self.rows[pre - 1][1] = self.ended

    def flush(self) -> None:
        if self.pending:
            text = "".join(self.pending)
            self.pending.clear()
            self._leaf("text", None, "#text", {}, text)

    def open(self, qname: str, attrs: dict, ns: str | None = None) -> None:
        self.flush()
        self.stack.append(self._add("elem", ns, qname, attrs, None))
        self.siblings.append(0)

    def close(self) -> None:
        self.flush()
        self.siblings.pop()
        self.ended += 1
        self.rows[self.stack.pop() - 1][1] = self.ended

    def instruction(self, name: str, data: str) -> None:
        self.flush()
        self._leaf("pi", None, name, {}, data)

    def name(self) -> str:
        return self.rows[self.stack[-1] - 1][7]

    def done(self) -> list[list]:
        while self.stack:
            self.close()
        self.flush()
        return self.rows


class _Html(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out = Shredder()

    def handle_starttag(self, tag, attrs):
        while self.out.stack and tag in IMPLIED.get(self.out.name(), ()):
            self.out.close()
        self.out.open(tag, {k: v or "" for k, v in attrs})
        if tag in VOID:
            self.out.close()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.out.stack and self.out.name() == tag:
            return self.out.close()
        names = [self.out.rows[i - 1][7] for i in self.out.stack]
        if tag in names:
            for _ in range(len(names) - 1 - names[::-1].index(tag), len(names)):
                self.out.close()

    def handle_data(self, data):
        self.out.pending.append(data)


#: A tag with plain attributes, or text. What a browser reads otherwise (comments, declarations, quotes of other kinds, elements whose content is no markup) isn't among it.
_PLAIN = re.compile(r'<(/?)([a-z][a-z0-9]*)((?: [a-z][a-z0-9-]*="[^"<>&]*")*)(/?)>|([^<]+)')
_ATTRIBUTE = re.compile(r' ([a-z][a-z0-9-]*)="([^"]*)"')
RAW = frozenset("script style title textarea iframe noembed noframes noscript plaintext xmp".split())


def _plain_html(text: str) -> list[list] | None:
    """What the parser gives for markup without anything unusual, in a fraction of its time; null for other markup."""
    p, at = _Html(), 0
    while at < len(text):
        m = _PLAIN.match(text, at)
        if m is None:
            return None
        end, tag, attrs, empty, data = m.groups()
        at = m.end()
        if data is not None:
            p.out.pending.append(unescape(data) if "&" in data else data)
        elif tag in RAW or (end and (attrs or empty)):
            return None
        elif end:
            p.handle_endtag(tag)
        elif empty:
            p.handle_startendtag(tag, _ATTRIBUTE.findall(attrs))
        else:
            p.handle_starttag(tag, _ATTRIBUTE.findall(attrs))
    return p.out.done()


def shred_html(text: str) -> list[list]:
    if (plain := _plain_html(text)) is not None:
        return plain
    p = _Html()
    p.feed(text)
    p.close()
    return p.out.done()


def shred_xml(text: str) -> list[list]:
    """Nodes of a well-formed document; of another one, a single node of kind `error` with the parser's message. Entities that are declared in the document aren't expanded."""
    out, p = Shredder(), expat.ParserCreate()
    p.buffer_text = True
    scope: list[dict] = [{"xml": "http://www.w3.org/XML/1998/namespace"}]

    def start(qname, attrs):
        inner = scope[-1]
        for k, v in attrs.items():
            if k.startswith("xmlns") and k[5:6] in ("", ":"):
                inner = inner | {k[6:]: v}
        scope.append(inner)
        out.open(qname, attrs, inner.get(qname.rpartition(":")[0]))

    def end(_):
        scope.pop()
        out.close()

    def declared(*_):
        raise ValueError("entities may not be declared")

    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler, p.ProcessingInstructionHandler, p.EntityDeclHandler = start, end, out.pending.append, out.instruction, declared
    try:
        p.Parse(text, True)
    except (expat.ExpatError, ValueError) as e:
        return [[1, 1, 0, 0, 1, "error", None, "#error", "#error", {}, str(e)]]
    return out.done()


def _batches(shred: Callable[[str], list[list]]):
    types = [pa.int32()] * 5 + [pa.string()] * 4 + [pa.map_(pa.string(), pa.string()), pa.string()]

    def emit(ids: list, rows: list) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [()] * len(FIELDS)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array([list(x.items()) for x in c] if f == "attrs" else c, t) for f, c, t in zip(FIELDS, cols, types))], ["doc_id", *FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, size = [], [], 0
        for batch in pieces(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    new = shred(text)
                    rows += new
                    ids += [doc_id] * len(new)
                    size += len(text)
                if len(rows) > 20_000 or size > PIECE_BYTES:
                    yield emit(ids, rows)
                    ids, rows, size = [], [], 0
        yield emit(ids, rows)

    return run


def shred(docs: DataFrame, doc_id: str, content: str, fmt: str = "xml") -> DataFrame:
    """The nodes of all documents; empty ones have none. fmt: xml or html."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(content).cast("string").alias("content"))
    return spread(rows, "doc_id", "content").mapInArrow(_batches({"xml": shred_xml, "html": shred_html}[fmt]), NODE)


def shredded(docs: DataFrame, doc_id: str, content: str, fmt: str = "xml") -> DataFrame:
    """The nodes as a table in the shared folder, for plans that use them several times: documents are parsed once."""
    return cut(shred(docs, doc_id, content, fmt))


def each(docs: DataFrame, doc_id: str, content: str, rows: Callable[[list[list]], list[tuple]], schema: str, fmt: str = "xml") -> DataFrame:
    """doc_id and the rows that a function of a document's nodes gives, so that the nodes themselves stay where they were parsed. schema: names and types (string, binary, int, long or boolean) of the rows."""
    read = {"xml": shred_xml, "html": shred_html}[fmt]
    names, kinds = zip(*(f.split() for f in schema.split(", ")))
    types = [{"string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}[k] for k in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out = [(i, *x) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if text for x in rows(read(text))]
            cols = list(zip(*out)) or [()] * (len(names) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), *types))], ["doc_id", *names])

    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(content).cast("string").alias("content"))
    return spread(texts, "doc_id", "content").mapInArrow(run, f"doc_id long, {schema}")


def read_folder(spark: SparkSession, folder: str, ext: str = "xml", depth: int | None = 1) -> DataFrame:
    """path, name, ext and content of the files of a folder with an extension; depth 1 is the folder itself, None any depth. Names that begin with search-results are left out."""
    plain = lambda path: F.regexp_replace(path, "^[a-z]+:/*", "/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", depth != 1).option("pathGlobFilter", f"*.{ext}").load(folder)
    df = files.select(plain("path").alias("path"), F.decode("content", "UTF-8").alias("content"))
    # scans skip files of no length
    empty = listing(spark, folder, ext, depth != 1).filter("size = 0").select(plain("path").alias("path"), F.lit("").alias("content"))
    df = df.unionByName(empty)
    name = F.substring_index("path", "/", -1)
    df = df.select("path", F.regexp_replace(name, "[.][^.]+$", "").alias("name"), F.lit(ext).alias("ext"), "content").filter(~F.col("name").startswith("search-results"))
    if depth not in (None, 1):
        base = F.lit(folder.removeprefix("file:").rstrip("/") + "/")
        df = df.filter(F.size(F.split(F.replace("path", base, F.lit("")), "/")) <= depth)
    return df


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def listing(spark: SparkSession, folder: str, ext: str, deep: bool = False) -> DataFrame:
    """path and size of the files with an extension; a task lists them, so their names don't go through the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for _ in batches:
            system, base = _filesystem(folder)
            found = [f for f in system.get_file_info(fs.FileSelector(base, recursive=deep)) if f.type == fs.FileType.File and f.path.endswith(f".{ext}") and not f.base_name.startswith((".", "_"))]
            yield pa.RecordBatch.from_arrays([pa.array([f.path for f in found], pa.string()), pa.array([f.size for f in found], pa.int64())], ["path", "size"])

    return spark.range(1, numPartitions=1).mapInArrow(run, "path string, size long")


def write_files(docs: DataFrame, folder: str) -> int:
    """Each row of out_path and content (text) or file (bytes) becomes that file below a folder that all executors share; returns how many.

    A file that is there is replaced, so a task that runs again does no harm. Rows of one path replace each other; rows without content are left out."""
    texts, files = ("content" in docs.columns), ("file" in docs.columns)
    rows = docs.select("out_path", F.col("content").cast("string") if texts else F.lit(None).cast("string").alias("content"), F.col("file") if files else F.lit(None).cast("binary").alias("file"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _filesystem(folder)
        done = 0
        for batch in batches:
            for name, text, data in zip(*(c.to_pylist() for c in batch.columns)):
                data = data if data is not None else None if text is None else text.encode()
                if data is None or name is None or ".." in name.split("/"):
                    continue
                path = f"{base.rstrip('/')}/{name.lstrip('/')}"
                system.create_dir(path.rpartition("/")[0], recursive=True)
                with system.open_output_stream(path) as out:
                    out.write(data)
                done += 1
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["n"])

    return rows.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
