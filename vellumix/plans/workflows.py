"""Whole workflows over folders: transform, repair, validate, compare, merge and publish. Each is one plan over all files of a folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import checks, mapping, merge, reconcile, repair, revise
from ..sources import assembly, context, markup, members, office
from ..sources.shared import cut

DOCBOOK, ARTICLE, WORD = "docbook", "article", "word"
MARKS = {DOCBOOK: "http://docbook.org/ns/docbook", ARTICLE: "<document"}
EXTENSION = {DOCBOOK: "xml", ARTICLE: "xml", WORD: "docx"}


def sniff(content: Column) -> Column:
    return F.when(content.contains("xmlns") & content.contains(MARKS[DOCBOOK]), DOCBOOK).when(content.contains(MARKS[ARTICLE]), ARTICLE).otherwise("other")


def documents(spark: SparkSession, folder: str, ext: str = "xml") -> DataFrame:
    """doc_id (a hash of the path), path, name and content of the files of a folder."""
    df = markup.read_folder(spark, folder, ext)
    return df.select(F.xxhash64("path").alias("doc_id"), "path", "name", "content", sniff(F.col("content")).alias("fmt"))


def word_documents(spark: SparkSession, folder: str) -> DataFrame:
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(folder)
    path = F.regexp_replace("path", "^[a-z]+:/*", "/")
    return df.select(F.xxhash64(path).alias("doc_id"), path.alias("path"), T.strip_extension(T.file_name(path)).alias("name"), F.col("content").alias("file"))


def out_name(name: Column, source: str, target: str) -> Column:
    """A result of the same extension as its source gets a suffix, so that it doesn't replace it."""
    same = EXTENSION[source] == EXTENSION[target]
    return F.concat(name, F.lit({ARTICLE: "_article", DOCBOOK: "_db"}.get(target, "") if same else ""), F.lit(f".{EXTENSION[target]}"))


def _in_docbook(docs: DataFrame, files: DataFrame) -> DataFrame:
    """Articles and word-processing files in DocBook."""
    some = docs.filter(F.col("fmt") == ARTICLE)
    xml = assembly.to_docbook(some, "doc_id", "content")
    texts = some.select("doc_id", out_name(F.col("name"), ARTICLE, DOCBOOK).alias("out_path")).join(xml, "doc_id").select("out_path", F.col("xml").alias("content"))
    read = office.from_word(files, "doc_id", "file").filter("xml IS NOT NULL")
    return texts.unionByName(files.select("doc_id", out_name(F.col("name"), WORD, DOCBOOK).alias("out_path")).join(read, "doc_id").select("out_path", F.col("xml").alias("content")))


def _in_word(docs: DataFrame) -> DataFrame:
    some = docs.filter(F.col("fmt") == DOCBOOK)
    made = office.to_word(some, "doc_id", "content").filter("file IS NOT NULL")
    return some.select("doc_id", out_name(F.col("name"), DOCBOOK, WORD).alias("out_path")).join(made, "doc_id").select("out_path", "file")


def transform(spark: SparkSession, folder: str, target: str | None = None) -> DataFrame:
    """out_path and content (text) or file (bytes) of every document of a folder in the target format.

    Without a target, DocBook becomes word-processing files and all else becomes DocBook. What can't be is told by problems()."""
    docs = documents(spark, folder)
    if target == ARTICLE:
        some = docs.filter(F.col("fmt") == DOCBOOK)
        xml = assembly.to_article(some, "doc_id", "content")
        return some.select("doc_id", out_name(F.col("name"), DOCBOOK, ARTICLE).alias("out_path")).join(xml, "doc_id").select("out_path", F.col("xml").alias("content"))
    if target == DOCBOOK:
        return _in_docbook(docs, word_documents(spark, folder))
    if target == WORD:
        return _in_word(docs)
    if target is None:
        text, nothing = _in_docbook(docs, word_documents(spark, folder)), F.lit(None)
        return text.withColumn("file", nothing.cast("binary")).unionByName(_in_word(docs).withColumn("content", nothing.cast("string")))
    raise ValueError(f"no such format: {target}")


def problems(spark: SparkSession, folder: str, target: str | None = None) -> DataFrame:
    """name and problem of every document of a folder that a transformation leaves out, or of which it leaves something out."""
    docs, files = documents(spark, folder), word_documents(spark, folder)
    takes = {ARTICLE: (DOCBOOK,), DOCBOOK: (ARTICLE,), WORD: (DOCBOOK,), None: (DOCBOOK, ARTICLE)}[target]
    why = F.when(F.length("content") == 0, "empty").when(F.col("fmt") == "other", "format_not_recognised").otherwise(F.concat(F.lit("format_not_taken:"), "fmt"))
    out = docs.filter(~F.col("fmt").isin(*takes) | (F.length("content") == 0)).select("name", why.alias("problem"))
    told = []
    if target in (WORD, None):
        told.append(office.to_word(docs.filter(F.col("fmt") == DOCBOOK), "doc_id", "content").join(docs.select("doc_id", "name"), "doc_id"))
    if target in (DOCBOOK, None):
        told.append(office.from_word(files, "doc_id", "file").join(files.select("doc_id", "name"), "doc_id"))
    for df in told:
        out = out.unionByName(df.select("name", F.explode("problems").alias("problem")))
    return out


def fix(spark: SparkSession, folder: str, day: str, authors: str = "") -> DataFrame:
    """name, content and changed of every document after the rules, dates and authors put in where they lack, and links flattened."""
    docs = documents(spark, folder)
    out = repair.repair_documents(docs.select("doc_id", "name", F.col("content").alias("before"), "content"), "name", "content", repair.BOTH).drop("changed")
    c = repair.inject_after(F.col("content"), "abstract", f"<pubdate>{day}</pubdate><date>{day}</date>", "<pubdate>")
    if authors:
        c = repair.inject_after(c, "pubdate", f"<authorgroup>{authors}</authorgroup>", "<authorgroup>")
    return out.select("name", F.when(F.length("before") > 0, T.flatten_link(c)).otherwise(F.col("before")).alias("content"), "before").withColumn("changed", F.col("content") != F.col("before")).drop("before")


def _grammar(docs: DataFrame) -> DataFrame:
    """Each document by the grammar of its markup."""
    nodes = lambda df: cut(context.in_context(df, "doc_id", "content"))
    return checks.grammar(nodes(docs.filter(F.col("fmt") != ARTICLE))).unionByName(checks.article_grammar(nodes(docs.filter(F.col("fmt") == ARTICLE))))


def validate(spark: SparkSession, folder: str) -> DataFrame:
    """One row: documents in all, empty, valid and invalid; empty ones count for themselves."""
    docs = documents(spark, folder)
    bad = _grammar(docs).filter("severity = 'error'").select("doc_id", F.lit(True).alias("bad")).distinct()
    rows = docs.select("doc_id", (F.length("content") == 0).alias("empty")).join(bad, "doc_id", "left")
    broken = F.coalesce("bad", F.lit(False))
    return rows.agg(F.count("*").alias("n_total"), F.count_if("empty").alias("n_empty"), F.count_if(~F.col("empty") & ~broken).alias("n_valid"), F.count_if(~F.col("empty") & broken).alias("n_invalid"))


def findings(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    nodes = markup.shredded(docs.filter(F.col("fmt") != ARTICLE), "doc_id", "content")
    return checks.sanity(nodes).unionByName(_grammar(docs)).join(docs.select("doc_id", "name"), "doc_id")


def consistency(spark: SparkSession, docbook: str, html: str, local: str = "link") -> DataFrame:
    """Pages of two folders held against each other: which lack, and for those on both sides the targets that only one of them links to."""
    a, b = documents(spark, docbook), markup.read_folder(spark, html, "html").select(F.xxhash64("path").alias("doc_id"), "name", "content")
    pages = reconcile.reconcile(a, b, ["name"], ("docbook", "html"))

    def links(docs: DataFrame, fmt: str, tag: str, attribute: str) -> DataFrame:
        nodes = markup.shred(docs, "doc_id", "content", fmt).filter((F.col("kind") == "elem") & (F.col("local") == tag))
        target = F.regexp_replace(F.try_element_at("attrs", F.lit(attribute)), "[.](html|xml)(#.*)?$", "")
        return nodes.select("doc_id", target.alias("element")).filter("element IS NOT NULL").distinct().join(docs.select("doc_id", "name"), "doc_id").select("name", "element")

    sets = reconcile.compare_sets(links(a, "xml", local, "xlink:href"), links(b, "html", "a", "href"), ["name"], "element")
    return pages.join(sets, "name", "left")


def members_of(spark: SparkSession, docbook: str, html: str) -> DataFrame:
    """name, check and the members that either side lacks, of the pages of classes in two folders."""
    a, b = documents(spark, docbook), markup.read_folder(spark, html, "html")
    ident = F.xxhash64("name").alias("doc_id")
    sides = (members.members(a.select(ident, "content"), "doc_id", "content", "docbook"), members.members(b.select(ident, "content"), "doc_id", "content", "html"))
    return members.compare_members(*sides).join(a.select(ident, "name"), "doc_id").drop("doc_id")


def merged(spark: SparkSession, original: str, altered: str, kind: str) -> DataFrame:
    """out_path, content and problems of every document of either folder, merged with the one of the same name in the other."""
    a, b = (documents(spark, x).select("name", F.col("content").alias(c)) for x, c in ((original, "o"), (altered, "n")))
    out = revise.merge_documents(a.join(b, "name", "full"), "name", "o", "n", kind)
    return out.select(F.concat("name", F.lit(".xml")).alias("out_path"), "content", "problems")


def revisions(spark: SparkSession, old: str, new: str) -> DataFrame:
    """name, section and flag (added, deleted, changed, same) of every section of two versions of a folder; sections are known by their id, else by their place."""

    def sections(folder: str) -> DataFrame:
        docs = documents(spark, folder)
        nodes = markup.shredded(docs, "doc_id", "content")
        numbers = mapping.section_numbers(nodes)
        own = nodes.filter(F.col("local").isin(mapping.SECTIONS))
        from ..operators import tree

        text = tree.string_value(nodes, own)
        rows = own.join(numbers, ["doc_id", "pre"]).join(text, ["doc_id", "pre"], "left").join(docs.select("doc_id", "name"), "doc_id")
        return rows.select("name", F.coalesce(F.try_element_at("attrs", F.lit("xml:id")), "number").alias("section"), F.coalesce("value", F.lit("")).alias("text"))

    return merge.revision_flags(sections(old), sections(new), ["name", "section"], "text")


def publish(spark: SparkSession, folder: str, root: str) -> DataFrame:
    """out_path and content of every page in the article markup, links based on the site's root, the index at the top."""
    pages = transform(spark, folder, ARTICLE)
    path = F.when(F.col("out_path").rlike("^index_"), "index.xml").otherwise(F.regexp_replace("out_path", "_article[.]xml$", ".xml"))
    return pages.select(path.alias("out_path"), T.rebase_link(F.col("content"), root).alias("content"))
