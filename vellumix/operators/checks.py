"""Integrity checks over nodes; each gives findings (doc_id, pre, check, severity, element)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import mapping, tree

INLINES = frozenset(
    "emphasis code literal command varname classname function filename replaceable phrase quote link xref anchor footnote footnoteref indexterm superscript subscript acronym abbrev personname inlinemediaobject inlineequation "
    "biblioref term simplelist option parameter type systemitem uri email guilabel guimenu keycap trademark productname remark tag constant symbol userinput computeroutput prompt envar property methodname".split()
)
LISTS = frozenset("itemizedlist orderedlist variablelist simplelist segmentedlist".split())
BLOCKS = LISTS | frozenset(
    "para simpara formalpara programlisting screen synopsis literallayout address blockquote epigraph note tip warning caution important table informaltable figure informalfigure example informalexample equation informalequation "
    "mediaobject bridgehead anchor remark indexterm sidebar procedure task revhistory formalgroup".split()
) | frozenset((*mapping.SYNOPSES, "namespacesynopsis"))
SECTION, HEADS = frozenset(mapping.SECTIONS), frozenset(("title", "subtitle", "titleabbrev", "info"))
PLAIN: frozenset = frozenset()
#: What may stand below which element: the content models of the schema's commonly used part. An element that isn't listed isn't judged.
ALLOWED: dict[str, frozenset] = {
    "article": HEADS | BLOCKS | SECTION | {"bibliography", "appendix", "index", "glossary"},
    "book": HEADS | {"part", "chapter", "preface", "appendix", "bibliography", "glossary", "index", "article"},
    "part": HEADS | {"partintro", "chapter", "preface", "appendix", "bibliography"},
    "chapter": HEADS | BLOCKS | SECTION | {"bibliography"},
    **{s: HEADS | BLOCKS | SECTION | {"bibliography"} for s in mapping.SECTIONS if s != "chapter"},
    "info": HEADS | frozenset("abstract author authorgroup editor othercredit date pubdate releaseinfo copyright legalnotice keywordset subjectset bibliorelation extendedlink productname productnumber edition revhistory org orgname mediaobject cover annotation".split()),
    "authorgroup": frozenset(("author", "editor", "othercredit")),
    **{p: frozenset("personname orgname org personblurb affiliation email uri address contrib".split()) for p in ("author", "editor", "othercredit")},
    "personname": frozenset("firstname givenname surname othername lineage honorific".split()) | INLINES,
    "abstract": frozenset(("title", "para", "simpara", "info")),
    "keywordset": frozenset(("keyword",)),
    **{p: INLINES | BLOCKS for p in ("para",)},
    **{p: INLINES for p in ("simpara", "title", "subtitle", "titleabbrev", "bridgehead", "member", "term", "emphasis", "link", "phrase", "quote", "programlisting", "screen", "literallayout", "synopsis", "code", "segtitle")},
    **{p: HEADS | BLOCKS | {"listitem"} for p in ("itemizedlist", "orderedlist")},
    "listitem": BLOCKS,
    "variablelist": HEADS | {"varlistentry"},
    "varlistentry": frozenset(("term", "listitem")),
    "simplelist": frozenset(("member",)),
    "segmentedlist": HEADS | {"segtitle", "seglistitem"},
    "seglistitem": frozenset(("seg",)),
    **{p: HEADS | BLOCKS for p in ("note", "tip", "warning", "caution", "important", "sidebar")},
    "blockquote": HEADS | BLOCKS | {"attribution"},
    "footnote": BLOCKS,
    "table": HEADS | frozenset("caption tgroup thead tbody tfoot tr colgroup col mediaobject textobject alt".split()),
    "informaltable": frozenset("info caption tgroup thead tbody tfoot tr colgroup col mediaobject textobject alt".split()),
    "tgroup": frozenset("colspec spanspec thead tfoot tbody".split()),
    **{p: frozenset(("tr", "row")) for p in ("thead", "tbody", "tfoot")},
    "tr": frozenset(("td", "th")),
    "row": frozenset(("entry", "entrytbl")),
    **{p: INLINES | BLOCKS for p in ("td", "th", "entry")},
    "figure": HEADS | BLOCKS | {"alt", "caption"},
    "informalfigure": frozenset(("info", "caption")) | BLOCKS,
    "mediaobject": frozenset("info imageobject videoobject audioobject textobject caption alt".split()),
    "inlinemediaobject": frozenset("info imageobject videoobject audioobject textobject alt".split()),
    "imageobject": frozenset(("info", "imagedata")),
    "videoobject": frozenset(("info", "videodata")),
    "audioobject": frozenset(("info", "audiodata")),
    "imagedata": frozenset(("info", "svg", "math")),
    "videodata": frozenset(("info", "multimediaparam")),
    "bibliography": HEADS | BLOCKS | {"bibliodiv", "biblioentry", "bibliomixed"},
    "indexterm": frozenset("primary secondary tertiary see seealso".split()),
    **{p: PLAIN for p in ("anchor", "xref", "biblioref", "multimediaparam", "colspec", "pubdate", "date", "keyword", "uri", "email")},
}
#: What has to stand below an element: one of each group.
NEEDED: dict[str, tuple[tuple[str, ...], ...]] = {
    "article": (("title", "info"),), "book": (("title", "info"),), "section": (("title", "info"),), "chapter": (("title", "info"),),
    "itemizedlist": (("listitem",),), "orderedlist": (("listitem",),), "variablelist": (("varlistentry",),), "varlistentry": (("term",), ("listitem",)), "simplelist": (("member",),), "segmentedlist": (("seglistitem",),),
    "listitem": (tuple(BLOCKS),), "note": (tuple(BLOCKS),), "tip": (tuple(BLOCKS),), "warning": (tuple(BLOCKS),), "caution": (tuple(BLOCKS),), "important": (tuple(BLOCKS),), "abstract": (("para", "simpara"),),
    "table": (("title", "caption", "info"), ("tgroup", "tr", "tbody", "mediaobject")), "informaltable": (("tgroup", "tr", "tbody", "mediaobject"),), "tr": (("td", "th"),), "row": (("entry", "entrytbl"),), "tgroup": (("tbody",),),
    "mediaobject": (("imageobject", "videoobject", "audioobject", "textobject"),), "imageobject": (("imagedata",),), "figure": (("title", "info"),), "keywordset": (("keyword",),), "indexterm": (("primary",),),
}
REQUIRED = {"imagedata": "fileref", "anchor": "xml:id", "xref": "linkend", "biblioref": "endterm", "multimediaparam": "name", "tgroup": "cols"}
#: The same for the article markup.
ARTICLE_ALLOWED: dict[str, frozenset] = {
    "document": frozenset("entete voiraussi authorDescriptions synopsis multi-page summary section tableau soustitre".split()),
    "entete": frozenset("rubrique meta titre date miseajour licauteur lictype licannee lictext serveur chemin urlhttp extratag googleAnalytics colonne".split()),
    "meta": frozenset(("description", "keywords")),
    "titre": frozenset(("page", "article", "soustitre")),
    "voiraussi": frozenset(("lien",)),
    "lien": frozenset(("texte", "url")),
    "authorDescriptions": frozenset(("authorDescription",)),
    "authorDescription": frozenset("fullname url homepage blog".split()),
    **{p: frozenset("title section paragraph liste tableau code html-brut image animation imgtext rich-imgtext citation latex signet index br".split()) for p in ("summary", "section", "synopsis", "element", "colonne", "rich-imgtext", "citation")},
    "paragraph": frozenset("b i u s important inline sup sub font acronyme link renvoi lien-forum signet index noteBasPage image latex br".split()),
    "liste": frozenset(("element",)),
    "tableau": frozenset("entete ligne legende".split()),
    "ligne": frozenset(("colonne",)),
    "index": frozenset(("index1", "index2")),
}
ARTICLE_NEEDED: dict[str, tuple[tuple[str, ...], ...]] = {"document": (("entete",),), "section": (("title", "signet", "paragraph", "section"),), "liste": (("element",),), "ligne": (("colonne",),), "voiraussi": (("lien",),), "authorDescriptions": (("authorDescription",),)}
ARTICLE_REQUIRED = {"image": "src", "animation": "src", "link": "href", "renvoi": "id", "signet": "id", "liste": "type", "authorDescription": "name"}


def finding(rows: DataFrame, check: str, severity: Column | str, element: str = "local") -> DataFrame:
    return rows.select("doc_id", "pre", F.lit(check).alias("check"), (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"), F.col(element).alias("element"))


def sanity(nodes: DataFrame) -> DataFrame:
    """Root, lists and listings within paragraphs, text before the first section, CALS tables and tables of one column."""
    elem = tree.parents(nodes.filter("kind = 'elem'"), "local")
    out = [finding(elem.filter("parent = 0 AND local <> 'article'"), "root", F.when(F.col("local") == "book", "warning").otherwise("error"))]
    in_para = elem.filter("parent_local = 'para'")
    out.append(finding(in_para.filter(F.col("local").isin("itemizedlist", "orderedlist")), "list_in_para", "warning"))
    out.append(finding(in_para.filter(F.col("local").isin("programlisting", "screen")), "code_in_para", "warning"))
    out.append(finding(elem.filter("local = 'tgroup'"), "cals_table", "warning"))
    # between the info and the first section: content is an error, synopses alone a warning
    w = Window.partitionBy("doc_id", "parent")
    top = elem.filter(F.col("parent_local").isin("article", "chapter")).withColumn("first", F.min(F.when(F.col("local").isin(mapping.SECTIONS), F.col("pre"))).over(w))
    early = top.filter(F.col("pre") < F.col("first")).filter(~F.col("local").isin("info", "title"))
    early = early.withColumn("only", F.every(F.col("local").isin(mapping.SYNOPSES)).over(w))
    out.append(finding(early, "content_before_section", F.when(F.col("only"), "warning").otherwise("error")))
    cells = elem.filter("local = 'tr'").select("doc_id", "pre", "post").alias("r")
    n = elem.filter(F.col("local").isin("td", "th")).groupBy("doc_id", F.col("parent").alias("pre")).agg(F.count("*").alias("n"))
    rows = cells.join(n, ["doc_id", "pre"], "left")
    tables = elem.filter("local = 'informaltable'").select("doc_id", F.col("pre").alias("t"), F.col("post").alias("t_end"))
    most = rows.join(tables, "doc_id").filter("pre > t AND post < t_end").groupBy("doc_id", F.col("t").alias("pre")).agg(F.max("n").alias("n")).filter("n = 1")
    out.append(finding(most.withColumn("local", F.lit("informaltable")), "one_column_table", "warning"))
    return reduce(DataFrame.unionByName, out)


def grammar(nodes: DataFrame, allowed: dict[str, frozenset] = ALLOWED, needed: dict[str, tuple[tuple[str, ...], ...]] = NEEDED, required: dict[str, str] = REQUIRED) -> DataFrame:
    """Elements where the grammar doesn't allow them, children and attributes that lack, and documents that aren't well-formed or are empty of elements; the rules are literals of the plan."""
    elem = nodes.filter("kind = 'elem'") if "parent_local" in nodes.columns else tree.parents(nodes.filter("kind = 'elem'"), "local")
    may = F.lit(True)
    for parent, names in allowed.items():
        may = F.when(F.col("parent_local") == parent, F.col("local").isin(sorted(names)) if names else F.lit(False)).otherwise(may)
    lacking = F.lit(False)
    for name, attribute in required.items():
        lacking = lacking | ((F.col("local") == name) & F.try_element_at("attrs", F.lit(attribute)).isNull())
    # what an element is and what it has in one group, not in a join: a side that is small when compressed would be broadcast through the driver
    owner = F.struct("pre", F.when(F.col("local").isin(*needed), F.col("local")).alias("local"), F.lit(None).cast("string").alias("has"))
    child = F.struct(F.col("parent").alias("pre"), F.lit(None).cast("string").alias("local"), F.when(F.col("parent_local").isin(*needed), F.col("local")).alias("has"))
    pairs = elem.select("doc_id", F.explode(F.array(owner, child)).alias("x")).select("doc_id", "x.*").filter("local IS NOT NULL OR has IS NOT NULL")
    rows = pairs.groupBy("doc_id", "pre").agg(F.max("local").alias("local"), F.collect_set("has").alias("has"))
    short = F.lit(False)
    for name, groups in needed.items():
        for group in groups:
            short = short | ((F.col("local") == name) & ~F.arrays_overlap("has", F.array(*map(F.lit, sorted(group)))))
    return (
        finding(elem.filter(~may), "not_allowed", "error")
        .unionByName(finding(elem.filter(lacking), "attribute_lacks", "error"))
        .unionByName(finding(rows.filter(short), "child_lacks", "error"))
        .unionByName(finding(nodes.filter("kind = 'error'"), "not_well_formed", "error", "text"))
    )


def judged(rows: list[list], allowed: dict[str, frozenset] = ALLOWED, needed: dict[str, tuple[tuple[str, ...], ...]] = NEEDED, required: dict[str, str] = REQUIRED) -> list[tuple[int, str, str, str]]:
    """What grammar() finds in one document, for where the parser has its nodes at hand: pre, check, severity and element."""
    out, has = [], {}
    for r in rows:
        if r[5] == "error":
            out.append((r[0], "not_well_formed", "error", r[10]))
        if r[5] != "elem":
            continue
        name, up = r[8], rows[r[2] - 1][8] if r[2] else None
        if name in needed:
            has.setdefault(r[0], set())
        if up in needed:
            has[r[2]].add(name)
        if up in allowed and name not in allowed[up]:
            out.append((r[0], "not_allowed", "error", name))
        if name in required and required[name] not in r[9]:
            out.append((r[0], "attribute_lacks", "error", name))
    out += [(pre, "child_lacks", "error", rows[pre - 1][8]) for pre, own in has.items() if any(own.isdisjoint(group) for group in needed[rows[pre - 1][8]])]
    return out


ARTICLE = (ARTICLE_ALLOWED, ARTICLE_NEEDED, ARTICLE_REQUIRED)


def article_grammar(nodes: DataFrame) -> DataFrame:
    """The same of the article markup."""
    return grammar(nodes, ARTICLE_ALLOWED, ARTICLE_NEEDED, ARTICLE_REQUIRED)
