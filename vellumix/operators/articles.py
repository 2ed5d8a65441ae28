"""What stands around an article's body: head fields, authors, licence, see-also, navigation, ids, parts and configuration checks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import mapping, tree
from .checks import finding


def _under(nodes: DataFrame, parent: str) -> DataFrame:
    """Elements right below elements of that name, with their text as value."""
    rows = tree.parents(nodes.filter("kind = 'elem'"), "local").filter(F.col("parent_local") == parent)
    return rows.join(tree.string_value(nodes, rows.select("doc_id", "pre", "post")), ["doc_id", "pre"], "left")


def header(nodes: DataFrame) -> DataFrame:
    """One row per document: title, subtitle, abbreviated title, description, keywords and abstract, each with its fallback."""
    info = _under(nodes, "info")
    value = T.normalize_space(F.coalesce("value", F.lit("")))
    first = lambda name, when=None: F.min_by(value, F.when((F.col("local") == name) & (F.lit(True) if when is None else when), F.col("pre")))
    described = F.coalesce(F.try_element_at("attrs", F.lit("role")), F.lit("")) == "description"
    head = info.groupBy("doc_id").agg(
        first("title").alias("title"), first("subtitle").alias("subtitle"), first("titleabbrev").alias("abbrev"), first("abstract", described).alias("described"), first("abstract", ~described).alias("abstract"),
    )
    keywords = _under(nodes, "keywordset").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", T.normalize_space(F.col("value")).alias("v")))), lambda x: x["v"]), ",").alias("keywords"))
    out = head.join(keywords, "doc_id", "left")
    return out.select("doc_id", "title", "subtitle", F.coalesce("abbrev", "title").alias("abbrev"), F.coalesce("described", "abstract", "title").alias("description"), F.coalesce("keywords", F.lit("")).alias("keywords"), "abstract")


def authors(nodes: DataFrame, nobody: str = "Dummy") -> DataFrame:
    """doc_id, pos, role, key and full name of each author: pseudonym, else first name and surname, else person or organisation name. A document without any gets `nobody`."""
    people = nodes.filter(F.col("local").isin("author", "othercredit") & (F.col("kind") == "elem"))
    below = tree.descendants(nodes.filter("kind = 'elem'"), people).select("doc_id", "top_pre", "pre", "post", F.col("local").alias("field"), F.coalesce(F.try_element_at("attrs", F.lit("role")), F.lit("")).alias("role"))
    below = below.join(tree.string_value(nodes, below.select("doc_id", "pre", "post").distinct()), ["doc_id", "pre"], "left")
    get = lambda name, role=None: F.min(F.when((F.col("field") == name) & (F.lit(True) if role is None else F.col("role") == role), F.trim("value")))
    fields = below.groupBy("doc_id", F.col("top_pre").alias("pre")).agg(get("othername", "pseudonym").alias("pseudonym"), get("firstname").alias("first"), get("surname").alias("last"), get("personname").alias("person"), get("orgname").alias("org"))
    both = F.when(F.col("first").isNotNull() | F.col("last").isNotNull(), F.concat_ws(" ", "first", "last"))
    named = people.select("doc_id", "pre", mapping.lookup(mapping.attr("class", "author"), mapping.AUTHOR, "author").alias("role")).join(fields, ["doc_id", "pre"], "left")
    full = F.coalesce(both, "person", "org", "pseudonym", F.lit(nobody))
    out = named.select("doc_id", "pre", "role", F.coalesce("pseudonym", full).alias("key"), full.alias("fullname"))
    every = nodes.filter("pre = 1").select("doc_id").join(out, "doc_id", "left")
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("pre"))
    return every.select("doc_id", pos.alias("pos"), *(F.coalesce(c, F.lit(d)).alias(c) for c, d in (("role", "author"), ("key", nobody), ("fullname", nobody))))


def _below(rows: list[list], r: list) -> list[list]:
    """The nodes within a node, which stand right behind it."""
    end = r[0]
    while end < len(rows) and rows[end][1] < r[1]:
        end += 1
    return rows[r[0] : end]


def _value(rows: list[list], r: list) -> str | None:
    """The text within a node, null if there is none."""
    texts = [x[10] for x in _below(rows, r) if x[5] == "text"]
    return "".join(texts) if texts else None


def header_of(rows: list[list]) -> list[tuple]:
    """The row that header() gives for one document, for where the parser has its nodes at hand."""
    normal = lambda s: re.sub("[ \\t\\r\\n]+", " ", s).strip(" ")
    info, words = [], []
    for r in rows:
        up = rows[r[2] - 1][8] if r[5] == "elem" and r[2] else None
        if up == "info":
            info.append(r)
        elif up == "keywordset" and (v := _value(rows, r)) is not None:
            words.append(normal(v))
    if not info:
        return []
    first = lambda *fits: next((normal(_value(rows, r) or "") for r in info if (r[8], r[8] == "abstract" and r[9].get("role") == "description") == fits), None)
    title, abbrev, told, abstract = first("title", False), first("titleabbrev", False), first("abstract", True), first("abstract", False)
    return [(title, first("subtitle", False), title if abbrev is None else abbrev, next((x for x in (told, abstract, title) if x is not None), None), ",".join(words), abstract)]


def authors_of(rows: list[list], nobody: str = "Dummy") -> list[tuple]:
    """The rows that authors() gives for one document."""
    out = []
    for a in rows:
        if a[5] != "elem" or a[8] not in ("author", "othercredit"):
            continue
        found: dict[str, str] = {}
        for r in _below(rows, a):
            name = r[8] if r[8] != "othername" else "pseudonym" if r[9].get("role") == "pseudonym" else ""
            if r[5] == "elem" and name in ("pseudonym", "firstname", "surname", "personname", "orgname") and (v := _value(rows, r)) is not None:
                found[name] = min(found.get(name, v.strip(" ")), v.strip(" "))
        both = " ".join(found[k] for k in ("firstname", "surname") if k in found) if found.keys() & {"firstname", "surname"} else None
        full = next((x for x in (both, found.get("personname"), found.get("orgname"), found.get("pseudonym")) if x is not None), nobody)
        out.append((len(out) + 1, mapping.AUTHOR.get(a[9].get("class", "author"), "author"), found.get("pseudonym", full), full))
    return out or ([(1, "author", nobody, nobody)] if rows else [])


def licence(number: Column, year: Column, author: Column, text: Column) -> Column:
    """Either all of number, year and author, or a text; both or neither give null (see licence_findings)."""
    fields = number.isNotNull() & year.isNotNull() & author.isNotNull()
    made = F.concat(F.lit('<licence type="'), number.cast("string"), F.lit('" annee="'), year.cast("string"), F.lit('" auteur="'), T.xml_escape(author), F.lit('"/>'))
    return F.when(fields & text.isNull(), made).when(~fields & text.isNotNull(), F.concat(F.lit("<licence>"), T.xml_escape(text), F.lit("</licence>")))


def config_problem(number: Column, year: Column, author: Column, text: Column, topic: Column, post: Column) -> Column:
    """What is wrong with an article's configuration, or an empty string."""
    some, every = number.isNotNull() | year.isNotNull() | author.isNotNull(), number.isNotNull() & year.isNotNull() & author.isNotNull()
    return F.when(some & text.isNotNull(), "licence_twice").when(some & ~every, "licence_incomplete").when(post.isNotNull() & topic.isNull(), "post_without_topic").otherwise("")


def see_also(nodes: DataFrame) -> DataFrame:
    """doc_id, pos and entry of the links listed in the last paragraph of the abstract, without their marks."""
    paras = tree.parents(nodes.filter("kind = 'elem'"), "local").filter("parent_local = 'abstract' AND local = 'para'")
    last = paras.groupBy("doc_id").agg(F.max_by(F.struct("pre", "post"), "pre").alias("p")).select("doc_id", "p.pre", "p.post")
    members = tree.descendants(nodes.filter("local = 'member'"), last).select("doc_id", "pre", "post")
    rows = tree.string_value(nodes, members)
    return rows.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("pre")).alias("pos"), F.trim(F.regexp_replace("value", "^[<>^ ]+|[<>^ ]+$", "")).alias("entry"))


def navigation(nodes: DataFrame) -> DataFrame:
    """One row per document with the targets of its previous, start and next arcs."""
    arcs = nodes.filter("local = 'locator'").select("doc_id", mapping.attr("xlink:label").alias("label"), mapping.attr("xlink:href").alias("href"))
    return arcs.groupBy("doc_id").agg(*(F.max(F.when(F.col("label") == k, F.col("href"))).alias(n) for k, n in (("prev", "previous"), ("home", "start"), ("next", "following"))))


def ids(nodes: DataFrame) -> DataFrame:
    """All ids of each document in its order, as one string."""
    ident = F.try_element_at("attrs", F.lit("xml:id"))
    rows = nodes.filter(ident.isNotNull()).select("doc_id", F.struct("pre", ident.alias("id")).alias("x"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["id"]), " ").alias("ids"))


def obsolete_by(nodes: DataFrame) -> DataFrame:
    rows = nodes.filter("local = 'bibliorelation'")
    return rows.filter(mapping.attr("type") == "isreplacedby").select("doc_id", mapping.attr("xlink:href").alias("replaced_by"))


def lead_in(nodes: DataFrame) -> DataFrame:
    """doc_id, pre and what to do with nodes before the first section of an article that has one: they go into a section without number."""
    top = tree.parents(nodes.filter("kind = 'elem'"), "local").filter(F.col("parent_local").isin("article", "chapter"))
    w = Window.partitionBy("doc_id", "parent")
    first = F.min(F.when(F.col("local").isin(mapping.SECTIONS), F.col("pre"))).over(w)
    early = top.withColumn("first", first).filter((F.col("pre") < F.col("first")) & ~F.col("local").isin("info", "title", *mapping.DROPPED))
    return early.select("doc_id", "pre", (F.col("pre") == F.min("pre").over(w)).alias("opens"), (F.col("pre") == F.max("pre").over(w)).alias("closes"))


def parts(nodes: DataFrame, of: tuple[str, ...] = ("part", "chapter")) -> DataFrame:
    """Nodes of books, each part (or, without parts, chapter) a document of its own: doc_id becomes `id/number`, with the contents at number 0."""
    w = Window.partitionBy("doc_id").orderBy("pre")
    has = F.max(F.when(F.col("local") == of[0], 1).otherwise(0)).over(Window.partitionBy("doc_id")) == 1
    cut = nodes.withColumn("__has", has).withColumn("__cut", F.when(F.col("__has"), F.col("local") == of[0]).otherwise(F.col("local") == of[1]))
    cut = cut.withColumn("__n", F.sum(F.col("__cut").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    within = F.max(F.when(F.col("__cut"), F.col("post"))).over(w.rowsBetween(Window.unboundedPreceding, 0)) >= F.col("post")
    cut = cut.withColumn("__n", F.when(F.coalesce(within, F.lit(False)), F.col("__n")).otherwise(0))
    return cut.withColumn("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("/"), F.col("__n").cast("string"))).drop("__has", "__cut", "__n")


def nesting(nodes: DataFrame) -> DataFrame:
    """Findings: parts and chapters outside books, an info outside what may have one, and sets, which can't be converted."""
    elem = tree.parents(nodes.filter("kind = 'elem'"), "local")
    up = F.coalesce("parent_local", F.lit("#root"))
    wrong = ((F.col("local") == "part") & (up != "book")) | ((F.col("local") == "chapter") & ~up.isin("book", "part", "#root")) | ((F.col("local") == "info") & ~up.isin("article", "book", "part", "chapter", *mapping.SECTIONS, "table", "figure", "abstract", "bibliography"))
    return finding(elem.filter(wrong), "bad_nesting", "error").unionByName(finding(elem.filter("local = 'set'"), "set_not_supported", "error"))
