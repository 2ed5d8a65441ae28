"""Word-processing files (ZIP with XML parts): reading to paragraphs and runs, writing from them, and nesting paragraphs into articles.

paras(doc_id, pos, style, num_id, num_lvl, align, runs): runs are structs of text, bold, italic, underline, strike, vert, style, href, footnote_id and image.
Files are made and read in Python, a file at a time; all the rest are windows and one group per document.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as E
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import mapping, sequence
from . import markup
from .shared import pieces

RUN = "struct<text:string,bold:boolean,italic:boolean,underline:boolean,strike:boolean,vert:string,style:string,href:string,footnote_id:string,image:string>"
PARAS = f"doc_id long, pos int, style string, num_id string, num_lvl int, align string, runs array<{RUN}>"
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/><Override PartName="/word/numbering.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.numbering+xml"/></Types>'
RELS = f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{R}/officeDocument" Target="word/document.xml"/></Relationships>'
#: Lists 1 are bulleted, lists 2 are numbered, nine levels each.
NUMBERING = (
    f'<?xml version="1.0" encoding="UTF-8"?><w:numbering xmlns:w="{W}">'
    + "".join(
        f'<w:abstractNum w:abstractNumId="{i}">' + "".join(f'<w:lvl w:ilvl="{k}"><w:numFmt w:val="{fmt}"/></w:lvl>' for k in range(9)) + "</w:abstractNum>" for i, fmt in ((1, "bullet"), (2, "decimal"))
    )
    + "".join(f'<w:num w:numId="{i}"><w:abstractNumId w:val="{i}"/></w:num>' for i in (1, 2))
    + "</w:numbering>"
)
STYLES = {"note": "Note", "tip": "Tip", "warning": "Warning", "caution": "Caution", "important": "Important", "programlisting": "ProgramListing", "screen": "Screen"}


def _table(rows: list[list[str]]) -> str:
    cell = lambda text: f'<w:tc><w:p><w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p></w:tc>'
    return "<w:tbl>" + "".join(f"<w:tr>{''.join(map(cell, r))}</w:tr>" for r in rows) + "</w:tbl>"


def _file(paras: list[dict], tables: list[list[list[str]]] = (), media: dict[str, bytes] | None = None) -> bytes:
    links: list[str] = []
    body = []
    for p in paras:
        props = f'<w:pStyle w:val={quoteattr(p["style"])}/>' if p["style"] else ""
        if p["num_id"]:
            props += f'<w:numPr><w:ilvl w:val="{p["num_lvl"] or 0}"/><w:numId w:val={quoteattr(p["num_id"])}/></w:numPr>'
        if p["align"]:
            props += f'<w:jc w:val={quoteattr(p["align"])}/>'
        runs = []
        for r in p["runs"] or []:
            on = "".join(f"<w:{t}/>" for t, k in (("b", "bold"), ("i", "italic"), ("strike", "strike")) if r[k])
            on += ('<w:u w:val="single"/>' if r["underline"] else "") + (f'<w:vertAlign w:val={quoteattr(r["vert"])}/>' if r["vert"] else "") + (f'<w:rStyle w:val={quoteattr(r["style"])}/>' if r["style"] else "")
            run = f'<w:r>{f"<w:rPr>{on}</w:rPr>" if on else ""}<w:t xml:space="preserve">{escape(r["text"] or "")}</w:t></w:r>'
            if r["href"]:
                links.append(r["href"])
                run = f'<w:hyperlink r:id="rId{len(links)}">{run}</w:hyperlink>'
            runs.append(run)
        body.append(f"<w:p>{f'<w:pPr>{props}</w:pPr>' if props else ''}{''.join(runs)}</w:p>")
    rels = "".join(f'<Relationship Id="rId{k}" Type="{R}/hyperlink" Target={quoteattr(h)} TargetMode="External"/>' for k, h in enumerate(links, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in (
            ("[Content_Types].xml", TYPES),
            ("_rels/.rels", RELS),
            ("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{W}" xmlns:r="{R}"><w:body>{"".join(body)}{"".join(map(_table, tables))}</w:body></w:document>'),
            ("word/_rels/document.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>'),
            ("word/numbering.xml", NUMBERING),
        ):
            z.writestr(zipfile.ZipInfo(name), text)  # no date: the same paragraphs give the same bytes
        for name, data in (media or {}).items():
            z.writestr(zipfile.ZipInfo(f"word/media/{name}"), data)
    return out.getvalue()


def _paras(file: bytes) -> list[dict]:
    w, r = f"{{{W}}}", f"{{{R}}}"
    with zipfile.ZipFile(io.BytesIO(file)) as z:
        body = E.fromstring(z.read("word/document.xml")).find(f"{w}body")
        names = set(z.namelist())
        rels = {x.get("Id"): x.get("Target") for x in E.fromstring(z.read("word/_rels/document.xml.rels"))} if "word/_rels/document.xml.rels" in names else {}
    out = []
    for pos, p in enumerate(body.iter(f"{w}p")):
        get = lambda path, of=p: None if (x := of.find(path)) is None else x.get(f"{w}val")
        runs = []
        for holder in [p, *p.iter(f"{w}hyperlink")]:
            for run in holder.findall(f"{w}r"):
                on = run.find(f"{w}rPr")
                has = lambda t, on=on: on is not None and (x := on.find(f"{w}{t}")) is not None and x.get(f"{w}val") not in ("0", "false", "none")
                val = lambda t, on=on: None if on is None or (x := on.find(f"{w}{t}")) is None else x.get(f"{w}val")
                note, image = run.find(f"{w}footnoteReference"), run.find(".//{http://schemas.openxmlformats.org/drawingml/2006/main}blip")
                text = "".join((x.text or "") if x.tag == f"{w}t" else "\t" if x.tag == f"{w}tab" else "\n" if x.tag == f"{w}br" else "" for x in run)
                runs.append(
                    (run, {"text": text, "bold": has("b"), "italic": has("i"), "underline": has("u"), "strike": has("strike"), "vert": val("vertAlign"), "style": val("rStyle"), "href": rels.get(holder.get(f"{r}id")) if holder is not p else None, "footnote_id": None if note is None else note.get(f"{w}id"), "image": None if image is None else rels.get(image.get(f"{r}embed"))})
                )
        order = {x: k for k, x in enumerate(p.iter(f"{w}r"))}
        runs.sort(key=lambda x: order[x[0]])
        lvl = get(f"{w}pPr/{w}numPr/{w}ilvl")
        out.append({"pos": pos, "style": get(f"{w}pPr/{w}pStyle"), "num_id": get(f"{w}pPr/{w}numPr/{w}numId"), "num_lvl": None if lvl is None else int(lvl), "align": get(f"{w}pPr/{w}jc"), "runs": [x for _, x in runs]})
    return out




def read(files: DataFrame, doc_id: str, file: str) -> DataFrame:
    """The paragraphs of all files."""
    run = pa.struct([("text", pa.string()), *((k, pa.bool_()) for k in ("bold", "italic", "underline", "strike")), *((k, pa.string()) for k in ("vert", "style", "href", "footnote_id", "image"))])
    schema = pa.schema([("doc_id", pa.int64()), ("pos", pa.int32()), ("style", pa.string()), ("num_id", pa.string()), ("num_lvl", pa.int32()), ("align", pa.string()), ("runs", pa.list_(run))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.RecordBatch.from_pylist([{"doc_id": i, **p} for i, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if f for p in _paras(f)], schema=schema)

    return files.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(file).alias("file")).mapInArrow(each, PARAS)


def write(paras: DataFrame) -> DataFrame:
    """doc_id and file, the bytes of a word-processing file, for each document."""
    p = F.struct("pos", "style", "num_id", "num_lvl", "align", "runs")
    docs = paras.groupBy("doc_id").agg(F.array_sort(F.collect_list(p), lambda a, b: a["pos"] - b["pos"]).alias("paras"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            files = [_file(ps) for ps in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary())], ["doc_id", "file"])

    return docs.mapInArrow(each, "doc_id long, file binary")


def write_tables(tables: DataFrame) -> DataFrame:
    """doc_id and file for rows of doc_id and rows, an array of arrays of cell texts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            files = [_file([], [rows]) for rows in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary())], ["doc_id", "file"])

    return tables.select("doc_id", "rows").mapInArrow(each, "doc_id long, file binary")


def paragraphs_of(nodes: DataFrame) -> DataFrame:
    """DocBook nodes as paragraphs: one for each title and para, styled by what is around it; one run for each text."""
    elem = mapping.context(nodes)
    holders = elem.filter(F.col("local").isin("title", "para", "programlisting", "screen"))
    above = nodes.filter("kind = 'elem'").select("doc_id", F.col("pre").alias("a_pre"), F.col("post").alias("a_post"), F.col("local").alias("a"), F.col("attrs").alias("a_attrs"))
    texts = nodes.filter("kind = 'text'").select("doc_id", "pre", "post", "text")
    around = lambda rows: rows.join(above, "doc_id").filter("a_pre < pre AND a_post > post")
    styled = around(holders.select("doc_id", "pre", "post", "local", "parent_local")).groupBy("doc_id", "pre", "post", "local", "parent_local").agg(
        F.count_if(F.col("a").isin(mapping.SECTIONS)).alias("depth"),
        F.count_if(F.col("a").isin("itemizedlist", "orderedlist")).alias("lists"),
        F.max_by("a", F.when(F.col("a").isin("itemizedlist", "orderedlist"), F.col("a_pre"))).alias("list"),
        F.max_by("a", F.when(F.col("a").isin(*STYLES), F.col("a_pre"))).alias("box"),
    )
    box = F.coalesce(*(F.when(F.col(c) == k, v) for c in ("local", "box") for k, v in STYLES.items()))
    style = F.when((F.col("local") == "title") & (F.col("depth") == 0), "Title").when(F.col("local") == "title", F.concat(F.lit("Heading"), F.least("depth", F.lit(9)).cast("string"))).otherwise(F.coalesce(box, F.lit("Normal")))
    styled = styled.select("doc_id", "pre", "post", style.alias("style"), F.when(F.col("lists") > 0, F.when(F.col("list") == "orderedlist", "2").otherwise("1")).alias("num_id"), F.when(F.col("lists") > 0, F.col("lists") - 1).cast("int").alias("num_lvl"))
    role = F.coalesce(F.try_element_at("a_attrs", F.lit("role")), F.lit(""))
    emphasis = F.col("a") == "emphasis"
    runs = around(texts).groupBy("doc_id", "pre", "text").agg(
        F.max_by("a_pre", F.when(F.col("a").isin("title", "para", "programlisting", "screen"), F.col("a_pre"))).alias("holder"),
        F.bool_or(emphasis & role.isin("bold", "strong")).alias("bold"),
        F.bool_or(emphasis & (role == "")).alias("italic"),
        F.bool_or(emphasis & (role == "underline")).alias("underline"),
        F.bool_or(emphasis & role.isin("strike", "strikethrough")).alias("strike"),
        F.max(F.when(F.col("a").isin("superscript", "subscript"), F.col("a"))).alias("vert"),
        F.max(F.when(F.col("a").isin(mapping.CODE), "Code")).alias("style"),
        F.max(F.when(F.col("a") == "link", F.coalesce(F.try_element_at("a_attrs", F.lit("xlink:href")), F.lit("")))).alias("href"),
    )
    run = F.struct("pre", F.struct("text", "bold", "italic", "underline", "strike", "vert", "style", "href", F.lit(None).cast("string").alias("footnote_id"), F.lit(None).cast("string").alias("image")).alias("r"))
    runs = runs.filter("holder IS NOT NULL").groupBy("doc_id", F.col("holder").alias("pre")).agg(F.array_sort(F.collect_list(run)).alias("runs"))
    out = styled.join(runs, ["doc_id", "pre"], "left")
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("pre")) - 1
    return out.select("doc_id", pos.cast("int").alias("pos"), "style", "num_id", "num_lvl", F.lit(None).cast("string").alias("align"), F.coalesce(F.transform("runs", lambda x: x["r"]), F.array().cast(f"array<{RUN}>")).alias("runs"))


HOLDERS = ("title", "para", "programlisting", "screen")


def paragraphs_in(rows: list[list]) -> list[dict]:
    """What paragraphs_of() gives for one document, for where the parser has its nodes at hand."""
    above: dict[int, dict] = {}  # by elements: what holds for all below them
    paras: dict[int, dict] = {}
    for r in rows:
        up = above.get(r[2])
        if up is not None and r[5] == "text" and up["holder"] in paras:
            run = {k: up[k] for k in ("bold", "italic", "underline", "strike", "vert", "style", "href")}
            paras[up["holder"]]["runs"].append({"text": r[10], **run, "footnote_id": None, "image": None})
        if r[5] != "elem":
            continue
        name, role = r[8], r[9].get("role", "")
        if up is not None and name in HOLDERS:
            box = STYLES.get(name) or STYLES.get(up["box"]) or "Normal"
            style = box if name != "title" else f"Heading{min(up['depth'], 9)}" if up["depth"] else "Title"
            paras[r[0]] = {"style": style, "num_id": ("2" if up["list"] == "orderedlist" else "1") if up["lists"] else None, "num_lvl": up["lists"] - 1 if up["lists"] else None, "align": None, "runs": []}
        now = dict(up) if up else {"depth": 0, "lists": 0, "list": None, "box": None, "holder": None, "bold": False, "italic": False, "underline": False, "strike": False, "vert": None, "style": None, "href": None}
        now["depth"] += name in mapping.SECTIONS
        if name in ("itemizedlist", "orderedlist"):
            now["lists"], now["list"] = now["lists"] + 1, name
        if name in STYLES:
            now["box"] = name
        if name in HOLDERS:
            now["holder"] = r[0]
        if name == "emphasis":
            kind = {"bold": "bold", "strong": "bold", "": "italic", "underline": "underline", "strike": "strike", "strikethrough": "strike"}.get(role)
            if kind:
                now[kind] = True
        elif name in ("superscript", "subscript"):
            now["vert"] = max(now["vert"] or "", name)
        elif name in mapping.CODE:
            now["style"] = "Code"
        elif name == "link":
            now["href"] = max(now["href"] or "", r[9].get("xlink:href", ""))
        above[r[0]] = now
    return [{"pos": k, **p} for k, p in enumerate(paras.values())]


def files_of(docs: DataFrame, doc_id: str, content: str) -> DataFrame:
    """doc_id and file of DocBook documents: what write() makes of paragraphs_of(), without a table of nodes. Documents without a paragraph have no file."""

    def rows(nodes: list[list]) -> list[tuple]:
        paras = paragraphs_in(nodes)
        return [(_file(paras),)] if paras else []

    return markup.each(docs, doc_id, content, rows, "file binary")


def to_docbook(paras: DataFrame) -> DataFrame:
    """doc_id and xml: headings nest sections, numbered paragraphs nest lists, neighbouring boxes of a style are one."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    level = F.regexp_extract("style", "^Heading([0-9])$", 1).try_cast("int")
    rows = paras.withColumn("level", level).withColumn("box", F.when(F.col("style").isin(list(STYLES.values())) & ~F.col("style").isin("ProgramListing", "Screen"), F.lower("style")))
    rows = rows.filter((F.col("style") == "Title") | F.exists("runs", lambda r: (F.length(r["text"]) > 0) | r["image"].isNotNull()))
    rows = sequence.list_moves(rows, ["doc_id"], ["pos"], "num_id", "num_lvl")
    rows = rows.withColumn("open_sections", F.coalesce(F.last("level", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("box_before", F.lag("box").over(w)).withColumn("box_after", F.lead("box").over(w)).withColumn("last", F.lead("pos").over(w).isNull())
    content = F.array_join(F.transform("runs", _inline), "")
    closes = F.when(F.col("level").isNotNull() & (F.col("level") <= F.col("open_sections")), F.repeat(F.lit("</section>"), F.col("open_sections") - F.col("level") + 1)).otherwise(F.lit(""))
    item = F.when(F.col("num_id") == "2", "orderedlist").otherwise("itemizedlist")
    begin = F.concat(F.repeat(F.concat(F.lit("<"), item, F.lit("><listitem>")), F.floor(F.col("opens") / 2).cast("int")), F.when(F.col("opens") % 2 == 1, "<listitem>").otherwise(""))
    # the item ends, and for each level less a list and the item that holds it
    end = F.when(F.col("closes") == 0, "").when(F.col("closes") % 2 == 1, F.concat(F.lit("</listitem>"), F.repeat(F.concat(F.lit("</"), item, F.lit("></listitem>")), F.floor(F.col("closes") / 2).cast("int")))).otherwise(F.repeat(F.concat(F.lit("</listitem></"), item, F.lit(">")), F.floor(F.col("closes") / 2).cast("int")))
    boxed = F.col("box").isNotNull()
    open_box = F.when(boxed & ~F.col("box").eqNullSafe(F.col("box_before")), F.concat(F.lit("<"), "box", F.lit(">"))).otherwise(F.lit(""))
    close_box = F.when(boxed & ~F.col("box").eqNullSafe(F.col("box_after")), F.concat(F.lit("</"), "box", F.lit(">"))).otherwise(F.lit(""))
    body = (
        F.when(F.col("style") == "Title", F.concat(F.lit("<info><title>"), content, F.lit("</title></info>")))
        .when(F.col("level").isNotNull(), F.concat(closes, F.lit("<section><title>"), content, F.lit("</title>")))
        .when(F.col("style") == "ProgramListing", F.concat(F.lit("<programlisting>"), content, F.lit("</programlisting>")))
        .when(F.col("style") == "Screen", F.concat(F.lit("<screen>"), content, F.lit("</screen>")))
        .otherwise(F.concat(begin, open_box, F.lit("<para>"), content, F.lit("</para>"), close_box, end))
    )
    rest = F.when(F.col("last"), F.repeat(F.lit("</section>"), F.coalesce("level", "open_sections"))).otherwise(F.lit(""))
    rows = rows.select("doc_id", "pos", F.concat(body, rest).alias("s"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]), "")
    head = '<article xmlns="http://docbook.org/ns/docbook" xmlns:xlink="http://www.w3.org/1999/xlink" version="5.2">'
    return rows.groupBy("doc_id").agg(F.concat(F.lit(head), joined, F.lit("</article>")).alias("xml"))


def _inline(r):
    """A run's text within the tags of its formats, the outermost first. The text is mentioned once, so the expression stays small."""
    code = r["style"].eqNullSafe("Code")
    tags = [
        (r["href"].isNotNull(), F.concat(F.lit('<link xlink:href="'), T.xml_escape(F.coalesce(r["href"], F.lit(""))), F.lit('">')), "</link>"),
        (code, F.lit("<code>"), "</code>"),
        *((r[flag], F.lit(f'<emphasis role="{role}">'), "</emphasis>") for flag, role in (("strike", "strikethrough"), ("underline", "underline"), ("bold", "bold"))),
        (r["italic"] & ~code, F.lit("<emphasis>"), "</emphasis>"),
        (r["italic"] & code, F.lit("<replaceable>"), "</replaceable>"),
        (r["vert"] == "subscript", F.lit("<subscript>"), "</subscript>"),
        (r["vert"] == "superscript", F.lit("<superscript>"), "</superscript>"),
    ]
    begin = [F.when(on, tag).otherwise(F.lit("")) for on, tag, _ in tags]
    end = [F.when(on, F.lit(tag)).otherwise(F.lit("")) for on, _, tag in reversed(tags)]
    return F.concat(*begin, T.xml_escape(F.coalesce(r["text"], F.lit(""))), *end)


def images(files: DataFrame, doc_id: str, file: str) -> DataFrame:
    """doc_id, name and bytes of every picture within the files."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = []
            for i, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if f:
                    with zipfile.ZipFile(io.BytesIO(f)) as z:
                        found += [(i, n.rpartition("/")[2], z.read(n)) for n in z.namelist() if n.startswith("word/media/")]
            cols = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.binary()))], ["doc_id", "name", "image"])

    return files.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(file).alias("file")).mapInArrow(each, "doc_id long, name string, image binary")


def cells(files: DataFrame, doc_id: str, file: str) -> DataFrame:
    """doc_id, table, row, column (each from 1) and text of every table cell; paragraphs within a cell are joined by line ends, an empty cell has an empty text."""
    w = f"{{{W}}}"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            for i, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not f:
                    continue
                with zipfile.ZipFile(io.BytesIO(f)) as z:
                    body = E.fromstring(z.read("word/document.xml")).find(f"{w}body")
                out = [
                    (i, t, r, c, "\n".join("".join(x.text or "" for x in p.iter(f"{w}t")) for p in cell.findall(f"{w}p")))
                    for t, table in enumerate(body.iter(f"{w}tbl"), 1)
                    for r, row in enumerate(table.findall(f"{w}tr"), 1)
                    for c, cell in enumerate(row.findall(f"{w}tc"), 1)
                ]
                cols = list(zip(*out)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()))], ["doc_id", "tbl", "row", "col", "text"])

    return files.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(file).alias("file")).mapInArrow(each, "doc_id long, tbl int, row int, col int, text string")


def tables_docbook(found: DataFrame) -> DataFrame:
    """doc_id, tbl and xml of every table of cells()."""
    cell = F.concat(F.lit("<td>"), F.when(F.col("text") != "", F.concat(F.lit("<para>"), F.replace(T.xml_escape(F.col("text")), F.lit("\n"), F.lit("</para><para>")), F.lit("</para>"))).otherwise(F.lit("")), F.lit("</td>"))
    rows = found.groupBy("doc_id", "tbl", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", cell.alias("s")))), lambda x: x["s"]), "").alias("s"))
    body = rows.groupBy("doc_id", "tbl").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "s"))), lambda x: F.concat(F.lit("<tr>"), x["s"], F.lit("</tr>"))), "").alias("s"))
    return body.select("doc_id", "tbl", F.concat(F.lit("<informaltable>"), "s", F.lit("</informaltable>")).alias("xml"))


def properties(nodes: DataFrame) -> DataFrame:
    """doc_id, title (of the root, not of what is below it) and creators, parted by a separator, for a file's properties."""
    from ..operators import articles

    head = articles.header(nodes).select("doc_id", "title")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "fullname")))
    return head.join(articles.authors(nodes).groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["fullname"]), "; ").alias("creators")), "doc_id")


__all__ = ["cells", "images", "paragraphs_of", "properties", "read", "tables_docbook", "to_docbook", "write", "write_tables"]
