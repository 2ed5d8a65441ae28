"""Rule-driven mapping from one markup to another.

A rule says which nodes it takes and what stands before and after their content; the first rule that fits wins. The tables of rules are written once and read in two ways: over a table of nodes (Columns)
they become two conditional columns, with their context (parent, sibling before, ancestors of certain kinds, first block child ...) by windows within the document, and serialise() puts the tokens of each document in order.
Where the parser has the whole document at hand (sources.context) they become functions of a node (Calls) and the document is written at once: as generated code such conditions are too long a method for the JVM to compile.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from . import tree

SECTIONS = ["section", "sect1", "sect2", "sect3", "sect4", "sect5", "sect6", "chapter"]
BLOCKS = ["itemizedlist", "orderedlist", "variablelist", "programlisting", "screen", "note", "tip", "warning", "caution", "important", "table", "informaltable", "figure", "informalfigure", "mediaobject", "blockquote", "equation", "informalequation"]
SYNOPSES = ["classsynopsis", "fieldsynopsis", "methodsynopsis", "constructorsynopsis", "destructorsynopsis", "enumsynopsis", "typedefsynopsis", "funcsynopsis"]
CODE = ["code", "literal", "command", "varname", "classname", "function"]


@dataclass(frozen=True)
class Rule:
    """For elements with one of the names (and for which `when` holds): text before and after the content."""

    names: tuple[str, ...]
    opening: Column | Callable | str = ""
    closing: Column | Callable | str = ""
    when: Column | Callable | None = None


def escaped(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def attr(name: str, default: str = "") -> Column:
    return F.coalesce(F.try_element_at("attrs", F.lit(name)), F.lit(default))


def tag(name: str, **attributes: Column) -> Column:
    """An opening tag; attributes that are empty are left out."""
    parts = [F.when(v != "", F.concat(F.lit(f' {k.rstrip("_")}="'), T.xml_escape(v), F.lit('"'))).otherwise(F.lit("")) for k, v in attributes.items()]
    return F.concat(F.lit(f"<{name}"), *parts, F.lit(">"))


def lookup(value: Column, table: dict[str, str], default: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), value), F.lit(default))


def context(nodes: DataFrame) -> DataFrame:
    """nodes with parent_local, before, nth (place among siblings of the same name), in_code, in_head, splits (the first block child of a para), split (a para that has one)."""
    out = tree.parents(nodes, "local")
    w = Window.partitionBy("doc_id", "parent").orderBy("pre")
    out = out.withColumn("before", F.lag("local").over(w)).withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "parent", "local").orderBy("pre")))
    block = (F.col("parent_local") == "para") & F.col("local").isin(BLOCKS)
    out = out.withColumn("splits", block & (F.count(F.when(block, 1)).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1))
    paras = out.filter("splits").select("doc_id", F.col("parent").alias("pre"), F.lit(True).alias("split"))
    out = out.join(paras, ["doc_id", "pre"], "left").withColumn("split", F.coalesce("split", F.lit(False)))
    for name, of in (("in_code", F.col("local").isin(CODE)), ("in_head", F.col("local").isin("thead", "entete"))):
        out = tree.inside(out, of).withColumnRenamed("inside", name)
    return out


def section_numbers(nodes: DataFrame, names: list[str] = SECTIONS) -> DataFrame:
    """doc_id, pre and number (I.1.2) of every section at any depth."""
    s = nodes.filter(F.col("local").isin(names))
    s = s.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "parent").orderBy("pre"))).select("doc_id", "pre", "post", "depth", "n")
    up = s.select("doc_id", F.col("pre").alias("up_pre"), F.col("post").alias("up_post"), F.col("depth").alias("up_depth"), F.col("n").alias("up_n"))
    above = s.join(up, "doc_id").filter("up_pre <= pre AND up_post >= post")
    parts = F.array_sort(F.collect_list(F.struct("up_depth", "up_n")))
    rows = above.groupBy("doc_id", "pre").agg(parts.alias("p"))
    rest = F.transform(F.slice("p", F.lit(2), F.size("p")), lambda x: x["up_n"].cast("string"))
    return rows.select("doc_id", "pre", F.array_join(F.concat(F.array(N.roman(F.col("p")[0]["up_n"])), rest), ".").alias("number"))


def apply_rules(nodes: DataFrame, rules: list[Rule], dropped: list[str] = (), around: tuple[Column, Column] | None = None) -> DataFrame:
    """doc_id and xml of every document. `around`: what stands outside of a node's own opening and closing. Elements in `dropped` go with all below them; elements without a rule leave their content."""
    told = "gone" in nodes.columns  # by sources.context
    if told:
        nodes = nodes.filter("NOT gone")
    elif dropped:
        gone = F.col("local").isin(list(dropped))
        nodes = tree.inside(nodes, gone).filter(~F.col("inside") & ~gone).drop("inside")
    opening = closing = None
    for r in rules:
        fits = F.col("local").isin(list(r.names)) if r.when is None else F.col("local").isin(list(r.names)) & F.coalesce(r.when, F.lit(False))
        o, c = (x if isinstance(x, Column) else F.lit(x) for x in (r.opening, r.closing))
        opening = F.when(fits, o) if opening is None else opening.when(fits, o)
        closing = F.when(fits, c) if closing is None else closing.when(fits, c)
    rows = nodes.filter("kind <> 'pi'").withColumn("text", T.xml_escape(F.col("text")))
    before, after = around or (F.lit(""), F.lit(""))
    empty = F.lit("")
    return tree.serialise(rows, F.concat(F.coalesce(before, empty), F.coalesce(opening, empty)), F.concat(F.coalesce(closing, empty), F.coalesce(after, empty)))


def unknown_elements(nodes: DataFrame, rules: list[Rule], dropped: list[str] = ()) -> DataFrame:
    """A finding for every element that no rule takes."""
    known = sorted({n for r in rules for n in r.names} | set(dropped))
    left = nodes.filter((F.col("kind") == "elem") & ~F.col("local").isin(known))
    return left.select("doc_id", "pre", F.lit("unknown_element").alias("check"), F.lit("warning").alias("severity"), F.col("local").alias("element"))


NOTES = {"note": "info", "tip": "idea", "warning": "warning", "caution": "error", "important": "error"}
NUMERATION = {"arabic": "1", "upperalpha": "A", "loweralpha": "a", "upperroman": "I", "lowerroman": "i"}
EMPHASIS = {"bold": "b", "strong": "b", "underline": "u", "strike": "s", "strikethrough": "s"}
ROLES = {"b": "bold", "important": "bold", "u": "underline", "s": "strikethrough", "i": ""}
AUTHOR = {"technicaleditor": "reviewer", "reviewer": "reviewer", "translator": "translator", "proofreader": "proofreader", "author": "author"}


class Columns:
    """What rules are made of, as columns over nodes in context."""

    attr, tag, lookup = staticmethod(attr), staticmethod(tag), staticmethod(lookup)
    escape, embed = staticmethod(T.xml_escape), staticmethod(T.video_embed)
    col = staticmethod(F.col)

    @staticmethod
    def parent(*names: str) -> Column:
        return F.col("parent_local").isin(*names)

    @staticmethod
    def below_other(name: str) -> Column:
        return F.col("parent_local") != name

    @staticmethod
    def among(value: Column, texts) -> Column:
        return value.isin(*texts)

    @staticmethod
    def told(name: str, default: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(default))

    @staticmethod
    def first(*names: str) -> Column:
        return F.coalesce(*(F.try_element_at("attrs", F.lit(n)) for n in names), F.lit(""))

    @staticmethod
    def when(condition: Column, then: Column | str, other: Column | str = "") -> Column:
        return F.when(condition, then if isinstance(then, Column) else F.lit(then)).otherwise(other if isinstance(other, Column) else F.lit(other))

    @staticmethod
    def concat(*parts: Column | str) -> Column:
        return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))

    @staticmethod
    def filled(value: Column) -> Column:
        return value != ""

    @staticmethod
    def later(any_before: bool = False) -> Column:
        """Not the first of its name; any_before: nor the first of all."""
        return F.col("nth") + (F.when(F.col("before").isNotNull(), 1).otherwise(0) if any_before else 0) > 1

    @staticmethod
    def behind(value: Column, prefix: str) -> Column:
        return F.regexp_extract(value, f"^{prefix}(.*)$", 1)

    @staticmethod
    def starts(value: Column, prefix: str) -> Column:
        return value.startswith(prefix)

    @staticmethod
    def width(value: Column) -> Column:
        return F.when(value != "", N.pixel_width(value)).otherwise(F.lit(""))

    @staticmethod
    def topic(href: Column) -> Column:
        return F.coalesce(T.forum_topic(href).cast("string"), F.lit(""))

    @staticmethod
    def post(href: Column) -> Column:
        return F.coalesce(T.forum_post(href).cast("string"), F.lit(""))

    @staticmethod
    def in_forum(href: Column) -> Column:
        return T.forum_topic(href).isNotNull() & href.contains("forum")

    @staticmethod
    def forum_url(base: str, topic: Column, post: Column) -> Column:
        return T.forum_url(base, topic, F.nullif(post, F.lit("")))


def _number(pattern: str, s: str) -> str:
    found = re.search(pattern, s)
    return str(int(found[1])) if found else ""


class Calls:
    """The same as functions of a node's row and of its context (see sources.context)."""

    @staticmethod
    def call(value):
        return value if callable(value) else lambda r, x: value

    @staticmethod
    def col(name: str):
        return (lambda r, x: r[8]) if name == "local" else (lambda r, x: x[name])

    @staticmethod
    def attr(name: str, default: str = ""):
        return lambda r, x: r[9].get(name, default)

    @staticmethod
    def tag(name: str, **attributes):
        parts = [(f' {k.rstrip("_")}="', v) for k, v in attributes.items()]

        def made(r, x):
            out = f"<{name}"
            for k, f in parts:
                if v := f(r, x):
                    out += k + escaped(v) + '"'
            return out + ">"

        return made

    @staticmethod
    def lookup(value, table: dict[str, str], default: str):
        return lambda r, x: table.get(value(r, x), default)

    @staticmethod
    def escape(value):
        return lambda r, x: escaped(value(r, x))

    @staticmethod
    def embed(value):
        return lambda r, x: value(r, x).replace("watch?v=", "embed/")

    @staticmethod
    def parent(*names: str):
        return lambda r, x: x["parent_local"] in names

    @staticmethod
    def below_other(name: str):
        return lambda r, x: x["parent_local"] not in (None, name)

    @staticmethod
    def among(value, texts):
        texts = tuple(texts)
        return lambda r, x: value(r, x) in texts

    @staticmethod
    def told(name: str, default: str):
        return lambda r, x: default if x[name] is None else str(x[name])

    @staticmethod
    def first(*names: str):
        return lambda r, x: next((r[9][n] for n in names if n in r[9]), "")

    @classmethod
    def when(cls, condition, then, other=""):
        then, other = cls.call(then), cls.call(other)
        return lambda r, x: then(r, x) if condition(r, x) else other(r, x)

    @classmethod
    def concat(cls, *parts):
        calls = [cls.call(p) for p in parts]
        return lambda r, x: "".join([f(r, x) for f in calls])

    @staticmethod
    def filled(value):
        return lambda r, x: value(r, x) != ""

    @staticmethod
    def later(any_before: bool = False):
        return lambda r, x: x["nth"] + (any_before and x["before"] is not None) > 1

    @staticmethod
    def behind(value, prefix: str):
        return lambda r, x: found[1] if (found := re.search(f"^{prefix}(.*)$", value(r, x))) else ""

    @staticmethod
    def starts(value, prefix: str):
        return lambda r, x: value(r, x).startswith(prefix)

    @staticmethod
    def width(value):
        def made(r, x):
            v = value(r, x)
            whole = re.fullmatch("[\\x00-\\x20]*([+-]?[0-9]+)[\\x00-\\x20]*", v)
            return f"{v}px" if whole and -(2**31) <= int(whole[1]) < 2**31 else v

        return made

    @staticmethod
    def topic(href):
        return lambda r, x: _number("(?:[?&]t=|/d|/t)([0-9]+)", href(r, x))

    @staticmethod
    def post(href):
        return lambda r, x: _number("(?:#post|[?&]p=|/p)([0-9]+)", href(r, x))

    @staticmethod
    def in_forum(href):
        return lambda r, x: "forum" in href(r, x) and _number("(?:[?&]t=|/d|/t)([0-9]+)", href(r, x)) != ""

    @staticmethod
    def forum_url(base: str, topic, post):
        return lambda r, x: f"{base}?t={topic(r, x)}" + (f"#post{p}" if (p := post(r, x)) else "")


def _split(b, opening):
    """A paragraph ends before its first block."""
    return b.concat(b.when(b.col("splits"), "</paragraph>"), opening)


def article_rules(b=Columns) -> list[Rule]:
    """From DocBook to the article markup (elements named in French)."""
    attr, tag, lookup, parent = b.attr, b.tag, b.lookup, b.parent
    role, href, width = attr("role"), b.first("xlink:href", "href"), b.width(attr("width"))
    emphasis = lookup(role, EMPHASIS, "i")
    return [
        Rule(("article", "book"), tag("document", id=attr("xml:id")), "</document>"),
        Rule(("info",), "<entete>", "</entete>", parent("article", "book")),
        Rule(("pubdate",), "<date>", "</date>"),
        Rule(("date",), "<miseajour>", "</miseajour>"),
        Rule(("abstract",), "<synopsis>", "</synopsis>"),
        Rule(("author", "othercredit"), tag("auteur", role=lookup(attr("class", "author"), AUTHOR, "author")), "</auteur>"),
        Rule(("personname",), "<nom>", "</nom>", parent("author", "othercredit", "editor")),
        Rule(("personname",), "", ""),
        Rule(("surname", "lineage"), b.when(b.later(any_before=True), " "), ""),
        Rule(("uri",), "<url>", "</url>"),
        Rule(tuple(SECTIONS), b.concat(tag("section", id=b.told("number", "")), b.when(b.filled(attr("xml:id")), b.concat('<signet id="', b.escape(attr("xml:id")), '"/>'))), "</section>"),
        Rule(("title",), "<titre>", "</titre>", parent("info", "article")),
        Rule(("title",), "<i>", "</i>", parent("biblioentry", "biblioset")),
        Rule(("title",), "<title>", "</title>"),
        Rule(("para", "simpara", "address"), "<paragraph>", b.when(b.col("split"), "", "</paragraph>")),
        Rule(("bridgehead",), "<paragraph><b>", "</b></paragraph>"),
        Rule(("itemizedlist",), _split(b, '<liste type="none">'), "</liste>"),
        Rule(("orderedlist",), _split(b, tag("liste", type=lookup(attr("numeration", "arabic"), NUMERATION, "1"))), "</liste>"),
        Rule(("listitem",), '<element useText="0">', "</element>"),
        Rule(("variablelist",), _split(b, '<liste type="none">'), "</liste>"),
        Rule(("varlistentry",), "", "", None),
        Rule(("term",), "<b>", "</b> : "),
        Rule(("simplelist",), "", ""),
        Rule(("member",), b.when(b.later(), ", "), ""),
        Rule(tuple(NOTES), _split(b, tag("rich-imgtext", type=lookup(b.col("local"), NOTES, "info"))), "</rich-imgtext>"),
        Rule(("programlisting",), _split(b, "<html-brut><![CDATA["), "]]></html-brut>", b.among(role, ["raw-html"])),
        Rule(("programlisting", "screen"), _split(b, tag("code", langage=attr("language", "other"))), "</code>"),
        Rule(("blockquote",), _split(b, "<tableau><ligne><colonne>"), "</colonne></ligne></tableau>"),
        Rule(("table", "informaltable"), _split(b, tag("tableau", width=width, border=attr("border"))), "</tableau>"),
        Rule(("caption",), "<legende>", "</legende>"),
        Rule(("tr", "row"), b.when(b.col("in_head"), "<entete>", "<ligne>"), b.when(b.col("in_head"), "</entete>", "</ligne>")),
        Rule(("td", "th", "entry"), "<colonne>", "</colonne>"),
        Rule(("tgroup", "tbody", "thead", "colspec", "imageobject", "videoobject", "audioobject", "textobject"), "", ""),
        Rule(("formalgroup",), "<tableau><ligne>", "</ligne></tableau>"),
        Rule(("figure", "informalfigure"), "<colonne>", "</colonne>", parent("formalgroup")),
        Rule(("figure", "informalfigure", "mediaobject"), _split(b, ""), ""),
        Rule(("inlinemediaobject",), "", ""),
        Rule(("imagedata",), tag("image", src=attr("fileref"), align=attr("align"), titre=attr("media:titre"), alt=attr("media:alt"), legende=attr("media:legende"), url=attr("media:url")), "</image>"),
        Rule(("videodata", "audiodata"), tag("animation", width=attr("width", "640"), height=attr("height", "480"), src=b.embed(attr("fileref")), type=b.when(b.among(b.col("local"), ["audiodata"]), "audio", attr("role")), titre=attr("media:titre"), legende=attr("media:legende")), "</animation>"),
        Rule(("equation", "informalequation", "inlineequation"), _split(b, "<latex>"), "</latex>"),
        Rule(("mathphrase", "alt"), "", ""),
        Rule(("anchor",), tag("signet", id=attr("xml:id")), "</signet>"),
        Rule(("emphasis",), "", "", b.col("in_code")),
        Rule(("emphasis",), b.concat("<", emphasis, ">"), b.concat("</", emphasis, ">")),
        Rule(tuple(CODE), "<inline>", "</inline>"),
        Rule(("superscript",), "<sup>", "</sup>"),
        Rule(("subscript",), "<sub>", "</sub>"),
        Rule(("phrase",), tag("font", color=b.behind(role, "color:")), "</font>", b.starts(role, "color:")),
        Rule(("phrase", "quote"), "", ""),
        Rule(("acronym",), "<acronyme>", "</acronyme>"),
        Rule(("link",), tag("renvoi", id=attr("linkend")), "</renvoi>", b.filled(attr("linkend"))),
        Rule(("link",), tag("lien-forum", id=b.topic(href), idpost=b.post(href)), "</lien-forum>", b.in_forum(href)),
        Rule(("link",), tag("link", href=href, langue=attr("xml:lang"), target=lookup(attr("xlink:show"), {"new": "_blank"}, "")), "</link>"),
        Rule(("xref",), b.concat(tag("renvoi", id=attr("linkend")), b.escape(b.told("label", "[]"))), "</renvoi>"),
        Rule(("biblioref",), b.concat("[", b.told("ref_number", "?"), "]"), ""),
        Rule(("footnote",), "<noteBasPage>", "</noteBasPage>"),
        Rule(("indexterm",), "<index>", "</index>"),
        Rule(("primary",), "<index1>", "</index1>"),
        Rule(("secondary",), "<index2>", "</index2>"),
        Rule(("bibliography", "bibliodiv"), '<section noNumber="1">', "</section>"),
        Rule(("biblioentry", "bibliomixed"), tag("signet", id=attr("xml:id")), "</signet>"),
    ]


def docbook_rules(b=Columns) -> list[Rule]:
    """From the article markup back to DocBook."""
    attr, tag, lookup, parent = b.attr, b.tag, b.lookup, b.parent
    role = attr("role")
    emphasis = lookup(b.col("local"), ROLES, "")
    kind, kinds = attr("type", "none"), {v: k for k, v in NUMERATION.items()}
    ordered = b.among(kind, NUMERATION.values())
    back = {"info": "note", "idea": "tip", "warning": "warning", "error": "important"}
    note = lookup(attr("type", "info"), back, "note")
    return [
        Rule(("document",), '<article xmlns="http://docbook.org/ns/docbook" xmlns:xlink="http://www.w3.org/1999/xlink" version="5.2">', "</article>"),
        Rule(("livre",), '<book xmlns="http://docbook.org/ns/docbook" xmlns:xlink="http://www.w3.org/1999/xlink" version="5.2">', "</book>"),
        Rule(("chapitre",), "<chapter>", "</chapter>"),
        Rule(("entete",), "<info>", "</info>", parent("document")),
        Rule(("date",), "<pubdate>", "</pubdate>"),
        Rule(("miseajour",), "<date>", "</date>"),
        Rule(("synopsis",), "<abstract>", "</abstract>"),
        Rule(("auteur",), "<author>", "</author>", b.among(attr("role", "author"), ["author"])),
        Rule(("auteur",), tag("othercredit", class_=role), "</othercredit>"),
        Rule(("nom",), "<personname>", "</personname>"),
        Rule(("url",), "<uri>", "</uri>"),
        Rule(("section",), "<section>", "</section>"),
        Rule(("titre", "title"), "<title>", "</title>"),
        Rule(("paragraph",), "<para>", "</para>"),
        Rule(("liste",), b.concat(b.when(ordered, tag("orderedlist", numeration=lookup(kind, kinds, "arabic"), continuation=b.when(b.filled(attr("debut")), "continues")), "<itemizedlist>"), b.when(b.filled(attr("titre")), b.concat("<title>", b.escape(attr("titre")), "</title>"))), b.when(ordered, "</orderedlist>", "</itemizedlist>")),
        Rule(("element",), "<listitem>", "</listitem>", b.among(attr("useText", "1"), ["0"])),
        Rule(("element",), "<listitem><para>", "</para></listitem>"),
        Rule(("rich-imgtext", "imgtext"), b.concat("<", note, ">"), b.concat("</", note, ">")),
        Rule(("citation",), "<blockquote>", "</blockquote>"),
        Rule(("code",), tag("programlisting", language=attr("langage")), "</programlisting>"),
        Rule(("html-brut",), '<programlisting role="raw-html"><![CDATA[', "]]></programlisting>"),
        Rule(("tableau",), b.concat(tag("table", width=attr("width"), border=attr("border")), "<title>", b.escape(attr("titre")), "</title>"), "</table>", b.filled(attr("titre"))),
        Rule(("tableau",), tag("informaltable", width=attr("width"), border=attr("border")), "</informaltable>"),
        Rule(("entete",), "<thead><tr>", "</tr></thead>", parent("tableau")),
        Rule(("ligne",), "<tr>", "</tr>"),
        Rule(("colonne",), b.when(b.col("in_head"), "<th>", "<td>"), b.when(b.col("in_head"), "</th>", "</td>")),
        Rule(("legende",), "<caption>", "</caption>"),
        Rule(("image",), b.concat("<inlinemediaobject><imageobject>", tag("imagedata", fileref=attr("src"), align=attr("align"))), "</imagedata></imageobject></inlinemediaobject>", parent("paragraph")),
        Rule(("image",), b.concat("<mediaobject><imageobject>", tag("imagedata", fileref=attr("src"), align=attr("align"))), "</imagedata></imageobject></mediaobject>"),
        Rule(("animation",), b.concat("<mediaobject><videoobject>", tag("videodata", width=attr("width"), height=attr("height"), fileref=attr("src"))), "</videodata></videoobject></mediaobject>"),
        Rule(("latex",), "<informalequation><mathphrase>", "</mathphrase></informalequation>", b.below_other("paragraph")),
        Rule(("latex",), "<inlineequation><mathphrase>", "</mathphrase></inlineequation>"),
        Rule(("i", "b", "important", "u", "s"), tag("emphasis", role=emphasis), "</emphasis>"),
        Rule(("inline",), "<code>", "</code>"),
        Rule(("sup",), "<superscript>", "</superscript>"),
        Rule(("sub",), "<subscript>", "</subscript>"),
        Rule(("font",), tag("phrase", role=b.concat("color:", attr("color"))), "</phrase>"),
        Rule(("acronyme",), "<acronym>", "</acronym>"),
        Rule(("link",), tag("link", **{"xlink:href": attr("href"), "xml:lang": attr("langue"), "xlink:show": b.when(b.among(attr("target"), ["_blank"]), "new")}), "</link>"),
        Rule(("renvoi",), tag("link", linkend=attr("id")), "</link>"),
        Rule(("signet",), tag("anchor", **{"xml:id": attr("id")}), "</anchor>"),
        Rule(("lien-forum",), tag("link", **{"xlink:href": b.forum_url("https://forum.example.org/showthread.php", attr("id"), attr("idpost"))}), "</link>"),
        Rule(("noteBasPage",), "<footnote><para>", "</para></footnote>"),
        Rule(("index",), "<indexterm>", "</indexterm>"),
        Rule(("index1",), "<primary>", "</primary>"),
        Rule(("index2",), "<secondary>", "</secondary>"),
    ]


DROPPED = [*SYNOPSES, "tfoot", "extendedlink", "bibliorelation", "remark"]


@cache
def calls(markup: str) -> dict[str, list[tuple]]:
    """The rules into a markup (article, docbook or html, which is from HTML into the article markup) by the names of the elements: condition, opening and closing as functions."""
    found: dict[str, list[tuple]] = {}
    for r in {"article": article_rules, "docbook": _back_rules, "html": html_rules}[markup](Calls):
        for n in r.names:
            found.setdefault(n, []).append((r.when, Calls.call(r.opening), Calls.call(r.closing)))
    return found


def written(rows: list[list], extra: list[dict], rules: dict[str, list[tuple]], lead: bool = False, pages: bool = False) -> list[tuple[int, str]]:
    """What apply_rules() gives for the nodes of one document with what is told of them. lead: what stands before the first section is a section without number.

    pages: what is within nodes that begin with a document of their own is a page, numbered from 1; the rest is 0. A document of which nothing is left has none."""
    texts: dict[int, list[str]] = {}
    stack: list[tuple[int, str, list]] = []
    number = page_end = 0
    out = None
    for r, x in zip(rows, extra):
        kind = r[5]
        if x["gone"] or kind == "pi":
            continue
        pre = r[0]
        while stack and stack[-1][0] < pre:
            _, closing, at = stack.pop()
            at.append(closing)
        if pages:
            if x["around_open"].startswith("<document>"):
                number, page_end = number + 1, max(page_end, x["last"])
            out = texts.setdefault(number if page_end >= pre else 0, [])
        elif out is None:
            out = texts.setdefault(0, [])
        if kind != "elem":
            out.append(escaped(r[10] or ""))
            continue
        first, last = x["around_open"], x["around_close"]
        if lead:
            if x["opens"]:
                first += '<section noNumber="1">'
            if x["closes"]:
                last = "</section>" + last
        for fits, opening, closing in rules.get(r[8], ()):
            if fits is None or fits(r, x):
                first += opening(r, x)
                last = closing(r, x) + last
                break
        out.append(first)
        stack.append((x["last"], last, out))
    while stack:
        _, closing, at = stack.pop()
        at.append(closing)
    return [(k, "".join(t)) for k, t in sorted(texts.items())]


def to_article(nodes: DataFrame) -> DataFrame:
    """doc_id and xml of DocBook nodes in the article markup. Nodes just as sources.context made them need one exchange, of the documents; others some twenty, of the nodes."""
    if hasattr(nodes, "written"):
        return nodes.written("article", lead=True)
    if "gone" in nodes.columns:
        lead = (F.when(F.col("opens"), F.lit('<section noNumber="1">')).otherwise(F.lit("")), F.when(F.col("closes"), F.lit("</section>")).otherwise(F.lit("")))
        return apply_rules(nodes, article_rules(), DROPPED, around=(F.concat("around_open", lead[0]), F.concat(lead[1], "around_close")))
    rows = context(nodes).join(section_numbers(nodes), ["doc_id", "pre"], "left")
    ident = F.col("attrs")["xml:id"]
    titles = nodes.filter("local = 'title'").select("doc_id", F.col("parent").alias("pre"), F.col("pre").alias("title_pre"))
    value = tree.string_value(nodes, nodes.filter("local = 'title'")).select("doc_id", F.col("pre").alias("title_pre"), "value")
    targets = nodes.filter(ident.isNotNull()).select("doc_id", "pre", ident.alias("ref")).join(titles, ["doc_id", "pre"], "left").join(value, ["doc_id", "title_pre"], "left")
    labels = targets.groupBy("doc_id", "ref").agg(F.min_by("value", "title_pre").alias("label"))
    uses = nodes.filter("local = 'biblioref'").groupBy("doc_id", F.col("attrs")["endterm"].alias("ref")).agg(F.min("pre").alias("first"))
    numbers = uses.select("doc_id", "ref", F.row_number().over(Window.partitionBy("doc_id").orderBy("first")).alias("ref_number"))
    rows = rows.withColumn("ref", F.coalesce(F.col("attrs")["linkend"], F.col("attrs")["endterm"]))
    rows = rows.join(labels, ["doc_id", "ref"], "left").join(numbers, ["doc_id", "ref"], "left")
    from .articles import lead_in

    rows = rows.join(lead_in(nodes), ["doc_id", "pre"], "left")
    return apply_rules(rows, article_rules(), DROPPED, around=(F.when(F.col("opens"), F.lit('<section noNumber="1">')), F.when(F.col("closes"), F.lit("</section>"))))


def _back_rules(b=Columns) -> list[Rule]:
    """br ends a footnote's paragraph and goes elsewhere."""
    return [*docbook_rules(b), Rule(("br",), "</para><para>", "", b.parent("noteBasPage"))]


def to_docbook(nodes: DataFrame) -> DataFrame:
    """doc_id and xml of article-markup nodes in DocBook."""
    if hasattr(nodes, "written"):
        return nodes.written("docbook")
    told = "gone" in nodes.columns
    around = (F.col("around_open"), F.col("around_close")) if told else None
    return apply_rules(nodes if told else context(nodes), _back_rules(), around=around)


HTML = [
    Rule(("html",), "<document>", "</document>"), Rule(("h1", "title"), "<titre>", "</titre>"), Rule(("p",), "<paragraph>", "</paragraph>"), Rule(("ul", "ol"), '<liste type="none">', "</liste>"),
    Rule(("li",), "<element>", "</element>"), Rule(("b",), "<b>", "</b>"), Rule(("article",), "<section>", "</section>"),
]

HTML_DROPPED = ["script", "style", "nav", "footer", "meta"]


def html_rules(b=Columns) -> list[Rule]:
    """Links keep their targets."""
    return [*HTML, Rule(("a",), b.tag("link", href=b.attr("href")), "</link>")]


def html_to_article(nodes: DataFrame) -> DataFrame:
    """doc_id and xml of HTML nodes in the article markup."""
    return nodes.written("html") if hasattr(nodes, "written") else apply_rules(nodes, html_rules(), HTML_DROPPED)


#: A paragraph right below one of these is one of its own; elsewhere only if nothing stands before it.
PARA_PARENTS = ("article", "section", "chapter", "listitem", "blockquote", "note", "tip", "warning", "caution", "important", "td")


def para_admitted() -> Column:
    """Over nodes in context: whether a paragraph becomes a paragraph of the other markup."""
    return F.col("parent_local").isin(*PARA_PARENTS) | F.col("before").isNull()


def paras_counted(rows: list[list]) -> list[tuple[int, int]]:
    """How many paragraphs of a document para_admitted() takes and refuses; nothing without any."""
    last: dict[int, str] = {}
    counts = [0, 0]
    for r in rows:
        if r[8] == "para":
            counts[not ((rows[r[2] - 1][8] if r[2] else None) in PARA_PARENTS or r[2] not in last)] += 1
        last[r[2]] = r[8]
    return [tuple(counts)] if any(counts) else []


def items_counted(rows: list[list]) -> list[tuple[int, int]]:
    """How many items of a document's lists are complex (of more than one element, or without a paragraph), and how many there are; nothing without any."""
    items = {r[0]: [0, 0] for r in rows if r[8] == "listitem"}
    for r in rows:
        if r[2] in items:
            items[r[2]][0] += r[5] != "text"
            items[r[2]][1] += r[8] == "para"
    return [(sum(n > 1 or not paras for n, paras in items.values()), len(items))] if items else []
