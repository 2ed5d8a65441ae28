"""Whole DocBook documents as word-processing files and back: heads, parts, tables, pictures, footnotes and all kinds of lists.

A document is one row on either side, and what becomes of it depends on nothing but itself, so each direction is one pass in Arrow batches without any exchange.
What a file can't hold is told in `problems`; nothing is left out silently. Word files of other makers are read by their own numbering definitions.

Defined results. Null and empty inputs, documents that aren't well-formed and broken archives give no result and a problem; entities may not be declared. Elements
without a counterpart keep their text. Pictures whose bytes aren't given are linked by their names. Other columns aren't read.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from functools import lru_cache
from xml.etree import ElementTree as E
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import pieces, spread

DB, XL, XML = "{http://docbook.org/ns/docbook}", "{http://www.w3.org/1999/xlink}", "{http://www.w3.org/XML/1998/namespace}"
NS = {
    "w": "http://schemas.openxmlformats.org/wordprocessingml/2006/main",
    "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
    "a": "http://schemas.openxmlformats.org/drawingml/2006/main",
    "pic": "http://schemas.openxmlformats.org/drawingml/2006/picture",
    "wp": "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing",
}
W, R, A = (f"{{{NS[k]}}}" for k in "wra")
HEAD = '<%s xmlns="http://docbook.org/ns/docbook" xmlns:xlink="http://www.w3.org/1999/xlink" version="5.2">'
PACKAGE = "http://schemas.openxmlformats.org/package/2006"

TITLES = {"article": "Title", "book": "TitleBook", "part": "TitlePart", "chapter": "TitleChapter"}
SECTIONS = frozenset(("section", *(f"sect{k}" for k in range(1, 7))))
NOTES = {"note": "Note", "tip": "Tip", "warning": "Warning", "caution": "Caution", "important": "Important"}
LISTINGS = {"programlisting": "ProgramListing", "screen": "Screen", "synopsis": "Synopsis", "literallayout": "LiteralLayout"}
DATES = {"date": "Date", "pubdate": "PublicationDate"}
PEOPLE = {"author": "Author", "editor": "Editor", "othercredit": "OtherCredit"}
LISTS, PICTURES, TABLES = ("itemizedlist", "orderedlist"), ("mediaobject", "figure", "informalfigure"), ("table", "informaltable")
CODE = {"code": "Code", "literal": "Literal", "command": "Command", "varname": "VarName", "classname": "ClassName", "function": "Function", "filename": "FileName"}
STYLE_TAGS = {v: k for k, v in (NOTES | LISTINGS | DATES | PEOPLE | CODE).items()}
EMPHASIS = {"bold": "b", "strong": "b", "underline": "u", "strike": "strike", "strikethrough": "strike", "": "i"}
FIELDS = ("firstname", "surname", "othername", "orgname", "email", "uri")
EMU = {"in": 914400, "cm": 360000, "mm": 36000, "pt": 12700, "px": 9525, "": 9525}
DEEPEST = 9


def local(e: E.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else "#"


def emu(length: str, default: int = 640) -> int:
    m = re.fullmatch(r"\s*([0-9]+(?:\.[0-9]+)?)\s*(in|cm|mm|pt|px|)\s*", length or "")
    return round(float(m[1]) * EMU[m[2]]) if m else default * EMU["px"]


def parsed(text: str) -> E.Element:
    if re.search(r"<!ENTITY", text):
        raise ValueError("entities may not be declared")
    return E.fromstring(text)


# to word-processing files


class WordWriter:
    """Blocks of one document, in order, with its links, notes and pictures."""

    def __init__(self, pictures: dict[str, bytes] | None = None) -> None:
        self.body: list[str] = []
        self.rels: list[str] = []
        self.notes: list[str] = []
        self.media: dict[str, bytes] = {}
        self.problems: list[str] = []
        self.pictures = pictures or {}
        self.numbers = [("bullet", 0)]  # a list number for each list at the top, so that a new one begins again at 1
        self.drawn = 0

    def rel(self, kind: str, target: str, external: bool) -> str:
        self.rels.append(f'<Relationship Id="rId{len(self.rels) + 10}" Type="{NS["r"]}/{kind}" Target={quoteattr(target)}{" TargetMode=\"External\"" if external else ""}/>')
        return f"rId{len(self.rels) + 9}"

    def text(self, s: str, on: frozenset, style: str = "") -> str:
        if not s:
            return ""
        props = (f'<w:rStyle w:val="{style}"/>' if style else "") + "".join(f"<w:{k}/>" for k in ("b", "i", "strike") if k in on) + ('<w:u w:val="single"/>' if "u" in on else "")
        props += "".join(f'<w:vertAlign w:val="{k}"/>' for k in ("superscript", "subscript") if k in on)
        return f"<w:r>{f'<w:rPr>{props}</w:rPr>' if props else ''}<w:t xml:space=\"preserve\">{escape(s)}</w:t></w:r>"

    def picture(self, e: E.Element) -> str:
        data = next((x for x in e.iter() if local(x) in ("imagedata", "videodata", "audiodata")), None)
        if data is None:
            self.problems.append("picture_without_data")
            return ""
        name = data.get("fileref", "")
        self.drawn += 1
        if name in self.pictures:
            self.media[f"{self.drawn}-{name.rpartition('/')[2]}"] = self.pictures[name]
            blip = f'r:embed="{self.rel("image", f"media/{self.drawn}-{name.rpartition("/")[2]}", False)}"'
        else:
            blip = f'r:link="{self.rel("image", name, True)}"'
        cx, cy = emu(data.get("width", "")), emu(data.get("depth", data.get("height", "")), 480)
        shape = f'<pic:pic><pic:nvPicPr><pic:cNvPr id="{self.drawn}" name={quoteattr(name)}/><pic:cNvPicPr/></pic:nvPicPr><pic:blipFill><a:blip {blip}/></pic:blipFill><pic:spPr/></pic:pic>'
        sized = " ".join(f"{k}={data.get(k)}" for k in ("width", "depth") if data.get(k))
        return f'<w:r><w:drawing><wp:inline><wp:extent cx="{cx}" cy="{cy}"/><wp:docPr id="{self.drawn}" name={quoteattr(name)} descr={quoteattr(sized)}/><a:graphic><a:graphicData uri="{NS["pic"]}">{shape}</a:graphicData></a:graphic></wp:inline></w:drawing></w:r>'

    def runs(self, e: E.Element, on: frozenset = frozenset(), style: str = "") -> str:
        """The inline content of an element."""
        out = self.text(e.text or "", on, style)
        for c in e:
            name = local(c)
            if name == "emphasis":
                role = c.get("role", "")
                out += self.runs(c, on | {EMPHASIS.get(role, "i")}, style)
            elif name in CODE:
                out += self.runs(c, on, CODE[name])
            elif name == "replaceable":
                out += self.runs(c, on | {"i"}, style or "Code")
            elif name in ("superscript", "subscript"):
                out += self.runs(c, on | {name}, style)
            elif name == "link":
                target = c.get(f"{XL}href") or f"#{c.get('linkend', '')}"
                out += f'<w:hyperlink r:id="{self.rel("hyperlink", target, True)}">{self.runs(c, on, style)}</w:hyperlink>'
            elif name == "footnote":
                self.notes.append("".join(self.para(p, "FootnoteText") for p in c) or self.para(c, "FootnoteText"))
                out += f'<w:r><w:footnoteReference w:id="{len(self.notes) + 1}"/></w:r>'
            elif name == "inlinemediaobject":
                out += self.picture(c)
            else:
                if name not in ("phrase", "quote", "personname", "term", "member", "acronym", "anchor", "#"):
                    self.problems.append(f"unknown_inline:{name}")
                out += self.runs(c, on, style)
            out += self.text(c.tail or "", on, style)
        return out

    def made(self, content: str, style: str = "", number: tuple[int, int] | None = None) -> str:
        props = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:numPr><w:ilvl w:val="{number[1]}"/><w:numId w:val="{number[0]}"/></w:numPr>' if number else "")
        return f"<w:p>{f'<w:pPr>{props}</w:pPr>' if props else ''}{content}</w:p>"

    def para(self, e: E.Element, style: str = "", number: tuple[int, int] | None = None) -> str:
        return self.made(self.runs(e), style, number)

    def title_of(self, e: E.Element) -> E.Element | None:
        return next((x for h in (e, e.find(f"{DB}info") if e.find(f"{DB}info") is not None else e.find("info")) if h is not None for x in h if local(x) == "title"), None)

    def head(self, root: E.Element) -> None:
        name = local(root)
        title = self.title_of(root)
        if title is not None:
            self.body.append(self.para(title, TITLES[name]))
        for info in (x for x in root if local(x) == "info"):
            for e in self.heads(info):
                kind = local(e)
                if kind in PEOPLE:
                    names = {local(x): " ".join("".join(x.itertext()).split()) for x in e.iter() if local(x) in FIELDS}
                    plain = " ".join("".join(e.itertext()).split())
                    fields = "; ".join(f"{k}: {names[k]}" for k in FIELDS if k in names) or plain
                    role = f" ({e.get('class')})" if e.get("class") else ""
                    self.body.append(self.made(self.text(f"{PEOPLE[kind]}{role}: ", frozenset("b")) + self.text(fields, frozenset()), PEOPLE[kind]))
                elif kind in DATES:
                    self.body.append(self.made(self.text(f"{DATES[kind]}: ", frozenset("b")) + self.text("".join(e.itertext()), frozenset()), DATES[kind]))
                elif kind == "abstract":
                    self.body += [self.para(p, "Abstract") for p in e if local(p) in ("para", "simpara")]
                elif kind != "title":
                    self.problems.append(f"info_left_out:{kind}")

    def heads(self, info: E.Element) -> Iterator[E.Element]:
        for e in info:
            if local(e) == "authorgroup":
                yield from e
            else:
                yield e

    def blocks(self, e: E.Element, depth: int = 0, lists: tuple[int, ...] = (), style: str = "") -> None:
        """The block content of an element: depth sections around it, in lists of these numbers."""
        first = bool(lists)
        for c in e:
            name = local(c)
            number = (lists[-1], len(lists) - 1) if lists and first else None
            here = style or ("ListParagraph" if lists and not first else "")
            if name in ("para", "simpara"):
                self.split(c, here, number, depth, lists)
                first = False
            elif name in ("part", "chapter"):
                if local(e) not in (("book",) if name == "part" else ("book", "part")):
                    self.problems.append(f"bad_nesting:{name}")
                self.head(c)
                self.blocks(c, 0)
            elif name in SECTIONS:
                title = self.title_of(c)
                if depth >= DEEPEST:
                    self.problems.append("sections_too_deep")
                self.body.append(self.para(title if title is not None else E.Element("title"), f"Heading{min(depth + 1, DEEPEST)}"))
                self.blocks(c, depth + 1)
            else:
                self.block(c, name, depth, lists, here, number)
                if name not in ("info", "title"):
                    first = False

    def split(self, p: E.Element, style: str, number, depth: int, lists: tuple[int, ...]) -> None:
        """A para as paragraphs, with the blocks within it between them."""
        own = E.Element(p.tag, p.attrib)
        own.text, last = p.text, None
        done = False
        for c in p:
            if local(c) in (*LISTS, *LISTINGS, *NOTES, *TABLES, *PICTURES, "variablelist", "segmentedlist"):
                if (own.text or "").strip() or len(own):
                    self.body.append(self.para(own, style, None if done else number))
                    done = True
                self.block(c, local(c), depth, lists, style, None)
                own, last = E.Element(p.tag), None
                own.text = (c.tail or "").lstrip() or None
            else:
                own.append(c)
                last = c
        if (own.text or "").strip() or len(own) or not done:
            self.body.append(self.para(own, style, None if done else number))

    def block(self, c: E.Element, name: str, depth: int, lists: tuple[int, ...], style: str, number) -> None:
        if name in LISTS:
            if len(lists) >= DEEPEST:
                self.problems.append("lists_too_deep")
            self.numbers.append(("decimal" if name == "orderedlist" else "bullet", len(lists)))
            mine = (*lists, len(self.numbers) - 1)[:DEEPEST]
            for item in c:
                if local(item) == "listitem":
                    self.blocks(item, depth, mine)
        elif name == "variablelist":
            for entry in (x for x in c if local(x) == "varlistentry"):
                for x in entry:
                    if local(x) == "term":
                        self.body.append(self.para(x, "VariableListTitle"))
                    else:
                        self.blocks(x, depth, (), "VariableListItem")
        elif name == "segmentedlist":
            titles = [x for x in c if local(x) == "segtitle"]
            for item in (x for x in c if local(x) == "seglistitem"):
                for t, s in zip(titles, item):
                    self.body += [self.para(t, "SegmentedListTitle"), self.para(s, "SegmentedListItem")]
        elif name in NOTES:
            self.blocks(c, depth, (), NOTES[name])
        elif name in LISTINGS:
            said = "; ".join(f"{k}: {v}" for k, v in c.attrib.items() if k in ("language", "role", "linenumbering", "continuation"))
            if said:
                self.body.append(self.made(self.text(said, frozenset("b")), LISTINGS[name]))
            self.body.append(self.para(c, LISTINGS[name]))
        elif name in TABLES:
            if any(local(x) == "tgroup" for x in c):
                self.problems.append("cals_table")
            if any(local(x) in ("thead", "tfoot") for x in c):
                self.problems.append("table_head_or_foot")
            title = next((x for x in c if local(x) in ("title", "caption")), None)
            if title is not None:
                self.body.append(self.para(title, "TableTitle"))
            rows = [x for x in c.iter() if local(x) in ("tr", "row")]
            self.body.append("<w:tbl>" + "".join(f"<w:tr>{''.join(self.cell(d) for d in r if local(d) in ('td', 'th', 'entry'))}</w:tr>" for r in rows) + "</w:tbl>")
        elif name in PICTURES:
            title, caption = self.title_of(c), next((x for x in c.iter() if local(x) == "caption"), None)
            if title is not None:
                self.body.append(self.para(title, "FigureTitle"))
            self.body.append(self.made(self.picture(c), "Figure", number))
            if caption is not None:
                self.body.append(self.made("".join(self.runs(x) for x in caption) or self.runs(caption), "Caption"))
        elif name in ("title", "info", "anchor", "#"):
            pass
        elif len(c) and any(local(x) in ("para", "simpara", *LISTS, *LISTINGS) for x in c):
            self.problems.append(f"unknown_block:{name}")
            self.blocks(c, depth, lists, style)
        else:
            self.problems.append(f"unknown_block:{name}")
            self.body.append(self.para(c, style, number))

    def cell(self, d: E.Element) -> str:
        inner = WordWriter(self.pictures)
        inner.rels, inner.notes, inner.media, inner.problems, inner.numbers, inner.drawn = self.rels, self.notes, self.media, self.problems, self.numbers, self.drawn
        if any(local(x) in ("para", "simpara", *LISTS, *LISTINGS, *NOTES, *PICTURES) for x in d):
            inner.blocks(d)
        else:
            inner.body.append(inner.para(d))
        self.drawn = inner.drawn
        return f"<w:tc>{''.join(inner.body)}</w:tc>"

    def file(self) -> bytes:
        space = " ".join(f'xmlns:{k}="{v}"' for k, v in NS.items())
        head = '<?xml version="1.0" encoding="UTF-8"?>'
        kinds = "".join(f'<w:abstractNum w:abstractNumId="{i}">' + "".join(f'<w:lvl w:ilvl="{k}"><w:start w:val="1"/><w:numFmt w:val="{fmt}"/></w:lvl>' for k in range(9)) + "</w:abstractNum>" for i, fmt in ((1, "bullet"), (2, "decimal")))
        nums = "".join(f'<w:num w:numId="{i}"><w:abstractNumId w:val="{1 if fmt == "bullet" else 2}"/></w:num>' for i, (fmt, _) in enumerate(self.numbers) if i)
        notes = "".join(f'<w:footnote w:id="{i}">{n}</w:footnote>' for i, n in enumerate(self.notes, 2))
        own = "".join(f'<Relationship Id="rId{k}" Type="{NS["r"]}/{t}" Target="{t}.xml"/>' for k, t in ((1, "numbering"), (2, "footnotes")))
        parts = "".join(f'<Override PartName="/word/{n}.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.{t}+xml"/>' for n, t in (("document", "document.main"), ("numbering", "numbering"), ("footnotes", "footnotes")))
        exts = sorted({n.rpartition(".")[2].lower() for n in self.media})
        images = "".join(f'<Default Extension="{x}" ContentType="image/{"jpeg" if x == "jpg" else x}"/>' for x in exts)
        files = {
            "[Content_Types].xml": f'{head}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{images}{parts}</Types>',
            "_rels/.rels": f'{head}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{NS["r"]}/officeDocument" Target="word/document.xml"/></Relationships>',
            "word/document.xml": f"{head}<w:document {space}><w:body>{''.join(self.body)}</w:body></w:document>",
            "word/_rels/document.xml.rels": f'{head}<Relationships xmlns="{PACKAGE}/relationships">{own}{"".join(self.rels)}</Relationships>',
            "word/numbering.xml": f"{head}<w:numbering {space}>{kinds}{nums}</w:numbering>",
            "word/footnotes.xml": f"{head}<w:footnotes {space}>{notes}</w:footnotes>",
        }
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in (*files.items(), *((f"word/media/{n}", b) for n, b in self.media.items())):
                z.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_DEFLATED)  # no date: one document gives the same bytes
        return out.getvalue()


def to_file(content: str, pictures: dict[str, bytes] | None = None) -> tuple[bytes | None, list[str]]:
    """The word-processing file of a DocBook document, and what it couldn't hold."""
    try:
        root = parsed(content or "")
    except (E.ParseError, ValueError) as e:
        return None, [f"not_well_formed: {e}"]
    if local(root) not in TITLES:
        return None, [f"root: {local(root)}"]
    out = WordWriter(pictures)
    out.head(root)
    out.blocks(root)
    return out.file(), sorted(set(out.problems))


# from word-processing files


@lru_cache(256)
def orders(numbering: bytes) -> dict[tuple[str, int], bool]:
    """Whether lists of a number are ordered, by number and level; files of one maker have few kinds of this part."""
    part, levels, ordered = E.fromstring(numbering), {}, {}
    for a in part.findall(f"{W}abstractNum"):
        levels[a.get(f"{W}abstractNumId")] = {v.get(f"{W}ilvl"): v.find(f"{W}numFmt").get(f"{W}val") for v in a.findall(f"{W}lvl") if v.find(f"{W}numFmt") is not None}
    for n in part.findall(f"{W}num"):
        for lvl, fmt in levels.get(n.find(f"{W}abstractNumId").get(f"{W}val"), {}).items():
            ordered[n.get(f"{W}numId"), int(lvl)] = fmt != "bullet"
    return ordered


class WordReader:
    """The parts of a file that its paragraphs refer to."""

    def __init__(self, file: bytes) -> None:
        with zipfile.ZipFile(io.BytesIO(file)) as z:
            names = set(z.namelist())
            part = lambda n: E.fromstring(z.read(n)) if n in names else None
            self.body = part("word/document.xml").find(f"{W}body")
            rels, notes = part("word/_rels/document.xml.rels"), part("word/footnotes.xml")
            self.ordered = orders(z.read("word/numbering.xml")) if "word/numbering.xml" in names else {}
            self.media = {n.removeprefix("word/media/"): z.read(n) for n in sorted(names) if n.startswith("word/media/")}
        self.targets = {x.get("Id"): x.get("Target") for x in rels} if rels is not None else {}
        self.notes = {n.get(f"{W}id"): n for n in notes.findall(f"{W}footnote")} if notes is not None else {}
        self.problems: list[str] = []

    def picture(self, drawing: E.Element) -> str:
        blip, prop = drawing.find(f".//{A}blip"), drawing.find(f".//{{{NS['wp']}}}docPr")
        name = self.targets.get(blip.get(f"{R}embed") or blip.get(f"{R}link"), "") if blip is not None else ""
        if blip is not None and blip.get(f"{R}embed") and prop is not None and prop.get("name"):
            name = prop.get("name")  # what the picture was called before it was packed
        size = re.findall(r"(width|depth)=(\S+)", prop.get("descr", "")) if prop is not None else []
        return f"<imageobject><imagedata fileref={quoteattr(name)}{''.join(f' {k}={quoteattr(v)}' for k, v in size)}/></imageobject>"

    def inline(self, p: E.Element) -> list[tuple[tuple, str]]:
        """Pieces of a paragraph: the formats around each, outermost first, and its content; pictures have the format `image`."""
        out: list[tuple[tuple, str]] = []
        for holder in p:
            link = (("link", self.targets.get(holder.get(f"{R}id"), "")),) if holder.tag == f"{W}hyperlink" else ()
            for run in holder.findall(f"{W}r") if link else [holder] if holder.tag == f"{W}r" else ():
                on = run.find(f"{W}rPr")
                has = lambda t, on=on: on is not None and (x := on.find(f"{W}{t}")) is not None and x.get(f"{W}val") not in ("0", "false", "none")
                val = lambda t, on=on: None if on is None or (x := on.find(f"{W}{t}")) is None else x.get(f"{W}val")
                code = STYLE_TAGS.get(val("rStyle") or "", "") if (val("rStyle") or "") in CODE.values() else ""
                marks = link + ((("code", code),) if code else ()) + tuple((k, "") for k in ("strike", "u", "b", "i") if has(k)) + (((val("vertAlign"), ""),) if val("vertAlign") in ("superscript", "subscript") else ())
                for x in run:
                    if x.tag == f"{W}t":
                        out.append((marks, escape(x.text or "", {'"': "&quot;"})))
                    elif x.tag in (f"{W}tab", f"{W}br"):
                        out.append((marks, "\t" if x.tag.endswith("tab") else "\n"))
                    elif x.tag == f"{W}drawing":
                        out.append((("image", ""), self.picture(x)))
                    elif x.tag == f"{W}footnoteReference":
                        note = self.notes.get(x.get(f"{W}id"))
                        if note is None:
                            self.problems.append("footnote_lacks")
                        else:
                            out.append((link, "<footnote>" + "".join(f"<para>{self.content(q)}</para>" for q in note.findall(f"{W}p")) + "</footnote>"))
        return out

    def content(self, p: E.Element) -> str:
        """A paragraph's content as markup; tags that neighbouring pieces share are written once."""
        out, open_ = [], ()
        opening = {"strike": '<emphasis role="strikethrough">', "u": '<emphasis role="underline">', "b": '<emphasis role="bold">', "superscript": "<superscript>", "subscript": "<subscript>"}

        def begin(mark: tuple, around: tuple) -> tuple[str, str]:
            kind, value = mark
            if kind == "link":
                return (f'<link linkend={quoteattr(value[1:])}>' if value.startswith("#") else f"<link xlink:href={quoteattr(value)}>"), "</link>"
            if kind == "code":
                return f"<{value}>", f"</{value}>"
            if kind == "i":
                return ("<replaceable>", "</replaceable>") if any(k == "code" for k, _ in around) else ("<emphasis>", "</emphasis>")
            tag = opening[kind]
            return tag, f"</{tag[1:].split()[0].rstrip('>')}>"

        for marks, text in self.inline(p):
            if marks == ("image", ""):
                marks, text = (), f"<inlinemediaobject>{text}</inlinemediaobject>"
            same = 0
            while same < min(len(marks), len(open_)) and marks[same] == open_[same]:
                same += 1
            for k in range(len(open_) - 1, same - 1, -1):
                out.append(begin(open_[k], open_[:k])[1])
            for k in range(same, len(marks)):
                out.append(begin(marks[k], marks[:k])[0])
            out.append(text)
            open_ = marks
        for k in range(len(open_) - 1, -1, -1):
            out.append(begin(open_[k], open_[:k])[1])
        return "".join(out)

    def style(self, p: E.Element) -> str:
        s = p.find(f"{W}pPr/{W}pStyle")
        return "" if s is None else s.get(f"{W}val") or ""

    def number(self, p: E.Element) -> tuple[str, int] | None:
        n = p.find(f"{W}pPr/{W}numPr/{W}numId")
        if n is None or n.get(f"{W}val") == "0":
            return None
        lvl = p.find(f"{W}pPr/{W}numPr/{W}ilvl")
        return n.get(f"{W}val"), 0 if lvl is None else int(lvl.get(f"{W}val"))

    def bold(self, p: E.Element) -> bool:
        pieces = [x for x in self.inline(p) if x[1].strip()]
        return bool(pieces) and all(("b", "") in marks for marks, _ in pieces)

    def plain(self, p: E.Element) -> str:
        return "".join(x.text or "" for x in p.iter(f"{W}t"))

    def head(self, blocks: list, at: int) -> tuple[str, int]:
        """The info of the title at this place, and where what follows it begins."""
        out, at, abstract = [f"<title>{self.content(blocks[at])}</title>"], at + 1, []
        while at < len(blocks) and blocks[at].tag == f"{W}p":
            style, p = self.style(blocks[at]), blocks[at]
            if style in PEOPLE.values():
                m = re.match(r"\w+(?: \((\w+)\))?: ?(.*)", self.plain(p), re.S)
                fields = re.findall(rf"({'|'.join(FIELDS)}): ([^;]*)", m[2]) if m else []
                made = "".join(f"<{k}>{escape(v.strip())}</{k}>" for k, v in fields if k in ("firstname", "surname", "othername"))
                rest = "".join(f"<{k}>{escape(v.strip())}</{k}>" for k, v in fields if k in ("orgname", "email", "uri"))
                made = (f"<personname>{made}</personname>" if made else "") + rest or f"<personname>{escape(m[2] if m else self.plain(p))}</personname>"
                tag = STYLE_TAGS[style]
                out.append(f"<{tag}{f' class={quoteattr(m[1])}' if m and m[1] else ''}>{made}</{tag}>")
            elif style in DATES.values():
                tag = STYLE_TAGS[style]
                out.append(f"<{tag}>{escape(re.sub(r'^[^:]*: ?', '', self.plain(p)))}</{tag}>")
            elif style == "Abstract":
                abstract.append(f"<para>{self.content(p)}</para>")
            else:
                break
            at += 1
        return f"<info>{''.join(out)}{f'<abstract>{"".join(abstract)}</abstract>' if abstract else ''}</info>", at

    def listing(self, blocks: list, at: int, style: str) -> tuple[str, int]:
        tag, said, p = STYLE_TAGS[style], "", blocks[at]
        if self.bold(p) and at + 1 < len(blocks) and self.style(blocks[at + 1]) == style and re.fullmatch(r"(?:[a-z]+: [^;]*)(?:; [a-z]+: [^;]*)*", self.plain(p)):
            said = "".join(f" {k}={quoteattr(v)}" for k, v in re.findall(r"([a-z]+): ([^;]*)", self.plain(p)))
            at += 1
        return f"<{tag}{said}>{self.content(blocks[at])}</{tag}>", at + 1

    def figure(self, blocks: list, at: int) -> tuple[str, int]:
        """A picture of its own, with a title before and a caption behind it."""
        title = ""
        if self.style(blocks[at]) == "FigureTitle":
            title, at = f"<title>{self.content(blocks[at])}</title>", at + 1
        images = "".join(t for m, t in self.inline(blocks[at]) if m == ("image", "")) if at < len(blocks) and blocks[at].tag == f"{W}p" else ""
        if not images:
            self.problems.append("figure_without_picture")
            return f"<bridgehead>{title.removeprefix('<title>').removesuffix('</title>')}</bridgehead>", at
        at, caption = at + 1, ""
        if at < len(blocks) and blocks[at].tag == f"{W}p" and self.style(blocks[at]) == "Caption":
            caption, at = f"<caption><para>{self.content(blocks[at])}</para></caption>", at + 1
        media = f"<mediaobject>{images}{caption}</mediaobject>"
        return (f"<figure>{title}{media}</figure>" if title else media), at

    def is_picture(self, p: E.Element) -> bool:
        pieces = [x for x in self.inline(p) if x[1].strip()]
        return bool(pieces) and all(m == ("image", "") for m, _ in pieces)

    def lists(self, blocks: list, at: int) -> tuple[str, int]:
        """Numbered paragraphs from here on, nested by their levels; what is styled as going on belongs to the item before it."""
        out, open_ = [], []
        while at < len(blocks):
            b = blocks[at]
            number = self.number(b) if b.tag == f"{W}p" else None
            if number:
                while open_ and (len(open_) - 1 > number[1] or (len(open_) - 1 == number[1] and open_[-1][0] != number[0])):
                    out.append(f"</listitem></{open_.pop()[1]}>")
                if not open_ and out:
                    break  # another list begins
                if len(open_) - 1 == number[1]:
                    out.append("</listitem><listitem>")
                while len(open_) - 1 < number[1]:
                    tag = "orderedlist" if self.ordered.get((number[0], len(open_)), False) else "itemizedlist"
                    open_.append((number[0], tag))
                    out.append(f"<{tag}><listitem>")
                if self.is_picture(b):
                    made, at = self.figure(blocks, at)
                    out.append(made)
                    continue
                out.append(f"<para>{self.content(b)}</para>")
            elif b.tag == f"{W}p" and self.style(b) == "ListParagraph":
                out.append(f"<para>{self.content(b)}</para>")
            else:
                break
            at += 1
        while open_:
            out.append(f"</listitem></{open_.pop()[1]}>")
        return "".join(out), at

    def variables(self, blocks: list, at: int) -> tuple[str, int]:
        """Terms, several of them or one, with the paragraphs behind them."""
        out, in_item = [], False
        style = lambda k: self.style(blocks[k]) if k < len(blocks) and blocks[k].tag == f"{W}p" else ""
        while style(at) in ("VariableListTitle", "VariableListItem"):
            if style(at) == "VariableListTitle":
                if in_item:
                    out.append("</listitem></varlistentry>")
                if in_item or not out:
                    out.append("<varlistentry>")
                out.append(f"<term>{self.content(blocks[at])}</term>")
                in_item = False
            else:
                if not out:
                    out.append("<varlistentry><term></term>")
                out.append(("" if in_item else "<listitem>") + f"<para>{self.content(blocks[at])}</para>")
                in_item = True
            at += 1
        out.append("</listitem></varlistentry>" if in_item else "<listitem><para></para></listitem></varlistentry>")
        return f"<variablelist>{''.join(out)}</variablelist>", at

    def segments(self, blocks: list, at: int) -> tuple[str, int]:
        """Titles and their values in turn; a title that comes again begins another item."""
        titles, items, now = [], [], {}
        while at + 1 < len(blocks) and self.style(blocks[at]) == "SegmentedListTitle" and self.style(blocks[at + 1]) == "SegmentedListItem":
            title = self.content(blocks[at])
            if title in now:
                items.append(now)
                now = {}
            if title not in titles:
                titles.append(title)
            now[title] = self.content(blocks[at + 1])
            at += 2
        items.append(now)
        made = "".join("<seglistitem>" + "".join(f"<seg>{i.get(t, '')}</seg>" for t in titles) + "</seglistitem>" for i in items)
        return f"<segmentedlist>{''.join(f'<segtitle>{t}</segtitle>' for t in titles)}{made}</segmentedlist>", at

    def table(self, t: E.Element, title: str = "") -> str:
        rows = "".join("<tr>" + "".join(f"<td>{self.cell(c)}</td>" for c in r.findall(f"{W}tc")) + "</tr>" for r in t.findall(f"{W}tr"))
        return f"<table><caption>{title}</caption>{rows}</table>" if title else f"<informaltable>{rows}</informaltable>"

    def cell(self, c: E.Element) -> str:
        """An empty cell has no paragraph."""
        blocks = [x for x in c if x.tag in (f"{W}p", f"{W}tbl")]
        if all(x.tag == f"{W}p" and not self.content(x) for x in blocks):
            return ""
        return self.flow(blocks, 0)[0]

    def flow(self, blocks: list, at: int) -> tuple[str, int]:
        """Everything from here up to the next title of a part or chapter."""
        out, depth = [], 0
        while at < len(blocks):
            b = blocks[at]
            if b.tag == f"{W}tbl":
                out.append(self.table(b))
                at += 1
                continue
            style = self.style(b)
            if style in TITLES.values():
                break
            if m := re.fullmatch("Heading([1-9])", style):
                level = int(m[1])
                out.append("</section>" * max(0, depth - level + 1) + "<section>" * max(1, level - depth) + f"<title>{self.content(b)}</title>")
                if level > depth + 1:
                    self.problems.append("heading_skips_a_level")
                depth, at = level, at + 1
            elif self.number(b):
                made, at = self.lists(blocks, at)
                out.append(made)
            elif style in LISTINGS.values():
                made, at = self.listing(blocks, at, style)
                out.append(made)
            elif style in NOTES.values():
                tag, paras = STYLE_TAGS[style], []
                while at < len(blocks) and blocks[at].tag == f"{W}p" and self.style(blocks[at]) == style:
                    paras.append(f"<para>{self.content(blocks[at])}</para>")
                    at += 1
                out.append(f"<{tag}>{''.join(paras)}</{tag}>")
            elif style in ("VariableListTitle", "VariableListItem"):
                made, at = self.variables(blocks, at)
                out.append(made)
            elif style == "SegmentedListTitle":
                made, at = self.segments(blocks, at)
                out.append(made)
            elif style == "FigureTitle" or self.is_picture(b):
                made, at = self.figure(blocks, at)
                out.append(made)
            elif style == "TableTitle" and at + 1 < len(blocks) and blocks[at + 1].tag == f"{W}tbl":
                out.append(self.table(blocks[at + 1], self.content(b)))
                at += 2
            else:
                if style not in ("", "Normal", "ListParagraph", "Caption", "TextBody", "BodyText"):
                    self.problems.append(f"unknown_style:{style}")
                content = self.content(b)
                if content:
                    out.append(f"<para>{content}</para>")
                at += 1
        return "".join(out) + "</section>" * depth, at

    def document(self) -> str:
        """What the first title says, with the parts and chapters that follow it within."""
        blocks = [x for x in self.body if x.tag in (f"{W}p", f"{W}tbl")]
        kinds = {v: k for k, v in TITLES.items()}
        kind = lambda k: kinds.get(self.style(blocks[k]), "") if blocks[k].tag == f"{W}p" else ""
        at, root = 0, kind(0) if blocks else ""
        if not root:
            self.problems.append("no_title")
            root = "article"
        out, open_, rank = [HEAD % root], [], {"article": 0, "book": 0, "part": 1, "chapter": 2}
        if blocks and kind(0):
            made, at = self.head(blocks, 0)
            out.append(made)
        made, at = self.flow(blocks, at)
        out.append(made)
        while at < len(blocks):
            name = kind(at)
            if name == "article" or name == "book" or root == "article":
                self.problems.append("second_title")
                name = "chapter" if root == "book" else "section"
            while open_ and rank.get(open_[-1], 2) >= rank.get(name, 2):
                out.append(f"</{open_.pop()}>")
            head, at = self.head(blocks, at)
            out.append(f"<{name}>{head}")
            open_.append(name)
            made, at = self.flow(blocks, at)
            out.append(made)
        return "".join(out) + "".join(f"</{x}>" for x in open_[::-1]) + f"</{root}>"


def from_file(file: bytes | None) -> tuple[str | None, list[str]]:
    """The DocBook document of a word-processing file, and what wasn't understood."""
    if not file:
        return None, ["empty"]
    try:
        reader = WordReader(file)
    except (zipfile.BadZipFile, E.ParseError, AttributeError, KeyError) as e:
        return None, [f"not_a_file: {type(e).__name__}"]
    return reader.document(), sorted(set(reader.problems))


# whole tables


def to_word(docs: DataFrame, doc_id: str, content: str, pictures: str | None = None) -> DataFrame:
    """doc_id, file and problems of every DocBook document. pictures: a column map<string,binary> with the pictures' bytes by the names that the document uses."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            given = [dict(p or ()) for p in batch.column(2).to_pylist()]
            made = [to_file(c, p) for c, p in zip(batch.column(1).to_pylist(), given)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f for f, _ in made], pa.binary()), pa.array([p for _, p in made], pa.list_(pa.string()))], ["doc_id", "file", "problems"])

    images = F.col(pictures) if pictures else F.lit(None).cast("map<string,binary>")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(content).cast("string").alias("content"), images.alias("pictures"))
    return spread(rows, "doc_id", "content").mapInArrow(each, "doc_id long, file binary, problems array<string>")


def from_word(files: DataFrame, doc_id: str, file: str) -> DataFrame:
    """doc_id, xml and problems of every word-processing file."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            made = [from_file(f) for f in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in made], pa.string()), pa.array([p for _, p in made], pa.list_(pa.string()))], ["doc_id", "xml", "problems"])

    rows = files.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(file).alias("file"))
    return spread(rows, "doc_id", "file").mapInArrow(each, "doc_id long, xml string, problems array<string>")
