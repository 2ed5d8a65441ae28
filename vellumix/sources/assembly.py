"""Whole documents in the article markup: head, see-also, authors, licence, synopsis, navigation, contents, parts, pictures with their titles, and pictures drawn in the document.

assemble() changes what stands around a document's nodes before the mapping's rules are read; documents are exchanged once, by doc_id. Configuration keys: section, licence_number, licence_year, licence_author,
licence_text, forum_topic, forum_post, server, folder, url. What is told about links and media are findings of their own (see warnings())."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import mapping
from . import context, markup
from .context import ATTRS, KIND, LOCAL, PARENT, PRE, TEXT, Document
from .shared import pieces, spread

#: Without formats, these leave their content, and those nothing.
TRANSPARENT = ("emphasis", "code", "superscript", "subscript", "phrase", "link", "personname", "term", "title")
SILENT = ("footnote", "indexterm", "biblioref", "inlinemediaobject", "xref", "anchor", "inlineequation", "titleabbrev")
MEDIA = ("figure", "informalfigure", "mediaobject", "inlinemediaobject")
LINK_ATTRIBUTES = ("actuate", "from", "label", "role", "to", "type")
FORUM = "https://forum.example.org/showthread.php"


def esc(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def field(name: str, value: str | None) -> str:
    return f"<{name}>{esc(value)}</{name}>" if value else ""


def plain(d: Document, node: list | None) -> str:
    """A node's text without any format."""
    return " ".join(d.text(node[PRE], SILENT).split()) if node else ""


def licence(config: dict) -> str:
    number, year, author, text = (config.get(f"licence_{k}") for k in ("number", "year", "author", "text"))
    if number and year and author and not text:
        return f"<licauteur>{esc(author)}</licauteur><lictype>{esc(number)}</lictype><licannee>{esc(year)}</licannee>"
    return field("lictext", text) if not (number or year or author) else ""


def entete(d: Document, owner: list, config: dict) -> str:
    """The head of a document: what it lacks falls back to what it has."""
    info = d.child(owner[PRE], "info")
    get = lambda name: plain(d, (info and d.child(info[PRE], name)) or d.child(owner[PRE], name))
    abstracts = d.elements(info[PRE], "abstract") if info else []
    told = next((plain(d, a) for a in abstracts if a[ATTRS].get("role") == "description"), None)
    about = next((" ".join(d.text(a[PRE], ("simplelist",)).split()) for a in abstracts if a[ATTRS].get("role") != "description"), None)
    keywords = ",".join(plain(d, k) for s in (d.elements(info[PRE], "keywordset") if info else []) for k in d.elements(s[PRE], "keyword"))
    meta = f"<meta>{field('description', told or about or get('title'))}{field('keywords', keywords)}</meta>"
    title = f"<titre>{field('page', get('titleabbrev') or get('title'))}{field('article', get('title'))}{field('soustitre', get('subtitle'))}</titre>"
    where = "".join(field(k, config.get(v)) for k, v in (("serveur", "server"), ("chemin", "folder"), ("urlhttp", "url")))
    return f"<entete><rubrique>{esc(config.get('section', '1'))}</rubrique>{meta}{title}{field('date', get('pubdate'))}{field('miseajour', get('date'))}{licence(config)}{where}</entete>"


def authors(d: Document, info: list | None) -> str:
    """Pseudonym, else full name; a document without any has one by the name of Dummy."""
    out = []
    people = [a for a in (d.all(info[PRE], "author", "othercredit", "editor") if info else ())]
    for a in people:
        get = lambda *names, a=a: next((plain(d, x) for n in names for x in d.all(a[PRE], n)), None)
        both = " ".join(x for x in (get("firstname"), get("surname")) if x)
        full = both or get("personname") or get("orgname") or get("othername") or "Dummy"
        role = mapping.AUTHOR.get(a[ATTRS].get("class", "author"), "author")
        urls = "".join(field("url", plain(d, u)) for u in d.all(a[PRE], "uri"))
        out.append(f'<authorDescription name="{esc(get("othername") or full)}" role="{role}">{field("fullname", full)}{urls}</authorDescription>')
    return f"<authorDescriptions>{''.join(out) or '<authorDescription name=\"Dummy\" role=\"author\"><fullname>Dummy</fullname></authorDescription>'}</authorDescriptions>"


def see_also(d: Document, abstract: list | None) -> str:
    """The links of a list that is all of the abstract's last paragraph; the list goes from there."""
    last = (d.elements(abstract[PRE], "para", "simpara") or [None])[-1] if abstract else None
    lists = d.elements(last[PRE]) if last else []
    if not lists or any(x[LOCAL] != "simplelist" for x in lists):
        return ""
    out = []
    for m in d.all(last[PRE], "member"):
        link = next(d.all(m[PRE], "link"), None)
        text = re.sub(r"^[<>^\s]+|[<>^\s]+$", "", plain(d, m))
        out.append(f"<lien>{field('texte', text)}{field('url', link[ATTRS].get('xlink:href') if link else None)}</lien>")
    gone(d, last[PRE])
    return f"<voiraussi>{''.join(out)}</voiraussi>"


def gone(d: Document, pre: int) -> None:
    for x in d.extra[pre - 1 : d.extra[pre - 1]["last"]]:
        x["gone"] = True


def navigation(d: Document, info: list | None) -> str:
    """The previous, first and next document, as a table of links."""
    arcs = {a[ATTRS].get("xlink:label"): a[ATTRS] for a in (d.all(info[PRE], "locator") if info else ())}
    cells = [f'<colonne><link href="{esc(a.get("xlink:href", ""))}">{esc(a.get("xlink:title", a.get("xlink:href", "")))}</link></colonne>' for k in ("prev", "home", "next") if (a := arcs.get(k))]
    return f'<tableau width="100%"><ligne>{"".join(cells)}</ligne></tableau>' if cells else ""


def synopsis_end(d: Document, info: list | None, config: dict) -> str:
    """Behind the abstract: where each id is, the forum's topic, and what replaces the document."""
    ids = "".join(f'<renvoi id="{esc(r[ATTRS]["xml:id"])}">{esc(r[ATTRS]["xml:id"])}</renvoi>' for r in d.rows if r[KIND] == "elem" and "xml:id" in r[ATTRS])
    out = f"<paragraph>{ids}</paragraph>" if ids else ""
    if int(config.get("forum_topic") or 0) > 0:
        post = f' idpost="{esc(config["forum_post"])}"' if config.get("forum_post") else ""
        out += f'<paragraph><lien-forum id="{esc(config["forum_topic"])}"{post}/></paragraph>'
    for r in d.all(info[PRE], "bibliorelation") if info else ():
        if r[ATTRS].get("type") == "isreplacedby":
            target = esc(r[ATTRS].get("xlink:href", ""))
            out += f'<rich-imgtext type="error"><paragraph><link href="{target}">{target}</link></paragraph></rich-imgtext>'
    return out


def contents(d: Document, pre: int) -> str:
    """The parts, chapters and sections below, as nested lists of links with their numbers."""
    out = []
    for r in d.elements(pre, "part", *mapping.SECTIONS):
        title = plain(d, d.child(r[PRE], "title") or ((i := d.child(r[PRE], "info")) and d.child(i[PRE], "title")))
        number = d.extra[r[PRE] - 1]["number"]
        out.append(f'<element useText="0"><paragraph>{f"{number}. " if number else ""}<renvoi id="{esc(r[ATTRS].get("xml:id", number or ""))}">{esc(title)}</renvoi></paragraph>{contents(d, r[PRE])}</element>')
    return f'<liste type="none">{"".join(out)}</liste>' if out else ""


def pictures(d: Document, name: str) -> None:
    """A picture takes its title, alternative, caption and link from what is around it; only the first of several objects counts; a drawing becomes a file."""
    drawn = 0
    for r in d.rows:
        if r[KIND] != "elem" or d.extra[r[PRE] - 1]["gone"]:
            continue
        if r[LOCAL] in MEDIA and (r[PARENT] == 0 or d.node(r[PARENT])[LOCAL] not in ("figure", "informalfigure")):
            inner = next((m for m in d.all(r[PRE], "mediaobject", "inlinemediaobject")), r) if r[LOCAL] in ("figure", "informalfigure") else r
            for m in d.elements(r[PRE], "mediaobject", "inlinemediaobject"):
                if m is not inner:
                    gone(d, m[PRE])
            objects = d.elements(inner[PRE], "videoobject", "audioobject") or d.elements(inner[PRE], "imageobject")
            for o in d.elements(inner[PRE], "imageobject", "videoobject", "audioobject", "textobject"):
                if not objects or o is not objects[0]:
                    gone(d, o[PRE])
            data = next((x for o in objects[:1] for x in d.all(o[PRE], "imagedata", "videodata", "audiodata")), None)
            first = lambda *tags: next((plain(d, x) for owner in (r, inner, *objects[:1]) for t in tags for x in d.elements(owner[PRE], t)), "")  # noqa: E731, B023
            link = next((x[ATTRS]["xlink:href"] for x in (r, inner, *objects[:1]) if "xlink:href" in x[ATTRS]), "")
            if data:
                told = {"titre": first("title"), "alt": first("alt"), "legende": first("caption"), "url": link}
                data[ATTRS] = data[ATTRS] | {f"media:{k}": v for k, v in told.items() if v}
                for x in [x for o in objects[:1] for x in d.all(o[PRE], "imagedata", "videodata", "audiodata") if x is not data]:
                    gone(d, x[PRE])
            for owner in {r[PRE], inner[PRE], *(o[PRE] for o in objects)}:
                for x in d.elements(owner, "title", "alt", "caption", "info"):
                    gone(d, x[PRE])
        if r[LOCAL] == "svg":
            drawn += 1
            gone(d, r[PRE])
            d.extra[r[PRE] - 1]["gone"] = False
            r[LOCAL], r[ATTRS] = "imagedata", {"fileref": f"images/{name}-svg{drawn}.svg"}
    for r in d.rows:  # what follows a media object within one parent is its explanation and goes
        inner = d.elements(r[PRE]) if r[KIND] == "elem" and r[LOCAL] in MEDIA else []
        for a, b in zip(inner, inner[1:]):
            if a[LOCAL] == "mediaobject" and b[LOCAL] not in ("mediaobject", *mapping.SECTIONS, "para", "simpara"):
                gone(d, b[PRE])


def assemble(d: Document, config: dict) -> None:
    root = next((r for r in d.rows if r[KIND] == "elem"), None)
    if root is None or root[LOCAL] not in ("article", "book"):
        return
    extra = lambda r: d.extra[r[PRE] - 1]
    pictures(d, config.get("name", "document"))
    for t in d.all(root[PRE], "title"):  # index terms stand behind the titles that have them
        for i in list(d.all(t[PRE], "indexterm")):
            words = "".join(field(f"index{k}", plain(d, x)) for k, n in ((1, "primary"), (2, "secondary")) for x in d.elements(i[PRE], n))
            extra(t)["around_close"] += f"<index>{words}</index>"
            gone(d, i[PRE])
    for s in d.all(root[PRE], *mapping.SECTIONS):  # a section's title may stand in an info of its own
        for i in d.elements(s[PRE], "info"):
            for x in d.elements(i[PRE]):
                if x[LOCAL] == "title":
                    extra(x)["parent_local"] = "section"
                else:
                    gone(d, x[PRE])
    info = d.child(root[PRE], "info")
    abstract = next((a for a in d.elements(info[PRE], "abstract") if a[ATTRS].get("role") != "description"), None) if info else None
    head = entete(d, root, config)
    also = see_also(d, abstract)
    head += also + authors(d, info)
    behind = synopsis_end(d, info, config)
    if root[LOCAL] == "book":
        behind += contents(d, root[PRE])
    for x in d.elements(info[PRE]) if info else ():
        if x is not abstract:
            gone(d, x[PRE])
    for t in d.elements(root[PRE], "title", "subtitle"):
        gone(d, t[PRE])
    inner = [r for r in map(d.node, d.below.get(root[PRE], ())) if r[KIND] != "text" or r[TEXT].strip()]
    paras = [p for p in (d.elements(abstract[PRE]) if abstract else ()) if not extra(p)["gone"]]
    if paras:
        extra(paras[-1])["around_close"] += behind
        summary = "<summary>"
    else:
        if abstract:
            gone(d, abstract[PRE])
        summary = f"<synopsis>{behind}</synopsis><summary>"
    end = "</summary>" + navigation(d, info)
    if info:
        info[LOCAL] = "#info"
        extra(info)["around_open"] += head
        extra(info)["around_close"] += summary
        if inner[-1] is info:
            extra(info)["around_close"] += end
    kept = [r for r in inner if r is not info and not extra(r)["gone"]]
    if root[LOCAL] == "book":  # parts() makes a document of each part or chapter
        if info and inner[-1] is not info:
            extra(info)["around_close"] += end
        for r in d.elements(root[PRE], "part") or d.elements(root[PRE], "chapter"):
            extra(r)["around_open"] = f"<document>{entete(d, r, config)}<summary>"
            extra(r)["around_close"] = "</summary></document>"
            for x in d.elements(r[PRE], "info", "title", "subtitle") if r[LOCAL] == "part" else ():
                gone(d, x[PRE])
        return
    if not info and kept:
        extra(kept[0])["around_open"] = head + summary + extra(kept[0])["around_open"]
    if kept:
        extra(kept[-1])["around_close"] += end


def to_article(docs: DataFrame, doc_id: str, content: str, config: str | None = None) -> DataFrame:
    """doc_id and xml of DocBook articles as whole documents."""
    return mapping.to_article(context.in_context(docs, doc_id, content, "xml", mapping.DROPPED, assemble, config))


def to_pages(docs: DataFrame, doc_id: str, content: str, config: str | None = None) -> DataFrame:
    """out_path (`id/number`, with the contents at 0) and xml of books: one document for each part, or for each chapter of a book without parts."""
    nodes = context.in_context(docs, doc_id, content, "xml", mapping.DROPPED, assemble, config)
    return nodes.written("article", lead=True, pages=True).select(F.concat(F.col("doc_id").cast("string"), F.lit("/"), F.col("page").cast("string")).alias("out_path"), "xml")


def _each(docs: DataFrame, doc_id: str, content: str, rows, schema: str) -> DataFrame:
    """Rows that a function of a document gives, with its doc_id."""
    names = [f.split()[0] for f in schema.split(", ")]
    types = {"string": pa.string(), "int": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out = [(i, *x) for i, text in zip(*(c.to_pylist() for c in batch.columns)) if text for x in rows(Document(markup.shred_xml(text), frozenset()), i)]
            cols = list(zip(*out)) or [()] * (len(names) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, types[f.split()[1]]) for c, f in zip(cols[1:], schema.split(", ")))], ["doc_id", *names])

    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(content).cast("string").alias("content"))
    return spread(texts, "doc_id", "content").mapInArrow(run, f"doc_id long, {schema}")


def _source(d: Document, pre: int) -> str:
    """A node as markup again."""
    r = d.node(pre)
    if r[KIND] == "text":
        return esc(r[TEXT])
    if r[KIND] != "elem":
        return ""
    attrs = "".join(f' {k}="{esc(v)}"' for k, v in r[ATTRS].items())
    return f"<{r[7]}{attrs}>{''.join(_source(d, p) for p in d.below.get(pre, ()))}</{r[7]}>"


def drawings(docs: DataFrame, doc_id: str, content: str) -> DataFrame:
    """doc_id, name and svg of every drawing within the documents, by the names that assembled documents refer to."""
    return _each(docs, doc_id, content, lambda d, i: [(f"images/document-svg{k}.svg", _source(d, r[PRE])) for k, r in enumerate((r for r in d.rows if r[KIND] == "elem" and r[LOCAL] == "svg"), 1)], "name string, svg string")


def without_formats(docs: DataFrame, doc_id: str, content: str, element: str = "title") -> DataFrame:
    """doc_id, pre and text of every element of a name, without formats; elements that no rule of this mode takes keep their text and are told."""

    def rows(d: Document, _):
        for r in d.rows:
            if r[KIND] == "elem" and r[LOCAL] == element:
                other = sorted({x[LOCAL] for x in d.all(r[PRE]) if x[LOCAL] not in (*TRANSPARENT, *SILENT) and not any(d.node(p)[LOCAL] in SILENT for p in _above(d, x[PRE]))})
                yield r[PRE], plain(d, r), ",".join(other)

    return _each(docs, doc_id, content, rows, "pre int, text string, unknown string")


def _above(d: Document, pre: int) -> Iterator[int]:
    while (pre := d.node(pre)[PARENT]) > 0:
        yield pre


def warnings(docs: DataFrame, doc_id: str, content: str) -> DataFrame:
    """doc_id, pre, check and detail of what the mapping leaves out of links, media, equations, processing instructions and attributes."""

    def rows(d: Document, _):
        for r in d.rows:
            if r[KIND] == "pi":
                model = r[LOCAL] == "xml-model" and re.search(r"docbook[^\"' ]*[.](rng|sch|rnc)", r[TEXT] or "")
                if not model:
                    yield r[PRE], "instruction_ignored", r[LOCAL]
                continue
            if r[KIND] != "elem":
                continue
            a = r[ATTRS]
            if r[LOCAL] == "link" and "linkend" not in a:
                yield from ((r[PRE], "link_attribute", k) for k in LINK_ATTRIBUTES if f"xlink:{k}" in a)
            if r[LOCAL] in MEDIA:
                for name in ("mediaobject", "imageobject", "videoobject", "audioobject"):
                    if len(d.elements(r[PRE], name)) > 1:
                        yield r[PRE], "only_the_first", name
            if r[LOCAL] in ("equation", "informalequation", "inlineequation") and not any(True for _ in d.all(r[PRE], "mathphrase", "alt")):
                yield r[PRE], "equation_without_tex", r[LOCAL]
            if r[LOCAL] in KNOWN_ATTRIBUTES:
                unknown = [k for k in a if not k.startswith("xmlns") and k not in (*KNOWN_ATTRIBUTES[r[LOCAL]], "xml:base", "xml:id", "xml:lang", "version")]
                yield from ((r[PRE], "unknown_attribute", k) for k in unknown if not (r[LOCAL] == "link" and k.startswith("xlink:")))

    return _each(docs, doc_id, content, rows, "pre int, check string, detail string")


#: What the mapping reads of these elements' attributes.
KNOWN_ATTRIBUTES = {
    "article": (), "para": (), "section": (), "link": ("xlink:href", "linkend", "href", "xlink:show"), "emphasis": ("role",), "phrase": ("role",), "programlisting": ("language", "role", "linenumbering", "continuation"),
    "imagedata": ("fileref", "align", "width", "depth"), "videodata": ("fileref", "width", "height", "format", "role"), "orderedlist": ("numeration", "continuation"), "itemizedlist": (), "table": ("width", "border"), "informaltable": ("width", "border"),
}


def url_findings(docs: DataFrame, doc_id: str, content: str) -> DataFrame:
    """doc_id and expected of articles whose address isn't what server and folder make of it."""

    def rows(d: Document, _):
        get = lambda n: next((plain(d, r) for r in d.rows if r[KIND] == "elem" and r[LOCAL] == n), "")
        expected, url = f"{get('serveur').rstrip('/')}/{get('chemin').strip('/')}", get("urlhttp")
        if url and url.rstrip("/") != expected.rstrip("/"):
            yield url, expected

    return _each(docs, doc_id, content, rows, "url string, expected string")


# and back


def disassemble(d: Document, config: dict) -> None:
    """An assembled document's head becomes the info of an article, or of a book if it has several pages; what belongs to the configuration leaves it (see sidecars())."""
    root = next((r for r in d.rows if r[KIND] == "elem"), None)
    if root is None or root[LOCAL] != "document":
        return
    extra = lambda r: d.extra[r[PRE] - 1]
    head, synopsis = d.child(root[PRE], "entete"), d.child(root[PRE], "synopsis")
    people, also, pages = (d.child(root[PRE], n) for n in ("authorDescriptions", "voiraussi", "multi-page"))
    pictures_back(d)
    if pages or d.child(root[PRE], "chapitre"):
        root[LOCAL] = "livre"
        for s in [x for o in (root, d.child(root[PRE], "summary")) if o for x in d.elements(o[PRE], "section")]:
            s[LOCAL] = "chapitre"
    for x in (people, also, pages):
        if x:
            gone(d, x[PRE])
    if head is None or d.child(head[PRE], "titre") is None:
        return
    title = next((t for t in d.elements(head[PRE], "titre")), None)
    full, short = (title and d.child(title[PRE], n) for n in ("article", "page"))
    names = ""
    if full:  # titles have no formats here, and stand before all else in an info
        names = f"<title>{esc(plain(d, full))}</title>" + (f"<titleabbrev>{esc(plain(d, short))}</titleabbrev>" if short and plain(d, short) != plain(d, full) else "")
        gone(d, title[PRE])
    for x in d.elements(head[PRE], "rubrique", "licauteur", "lictype", "licannee", "lictext", "serveur", "chemin", "urlhttp"):
        gone(d, x[PRE])
    if meta := d.child(head[PRE], "meta"):
        about, words = d.child(meta[PRE], "description"), d.child(meta[PRE], "keywords")
        made = "".join(f"<keyword>{esc(k.strip())}</keyword>" for k in (plain(d, words).split(",") if words else ()) if k.strip())
        told = plain(d, about)
        gone(d, meta[PRE])
        extra(meta)["gone"] = False
        meta[LOCAL] = "#"
        if told and (not full or told != plain(d, full)):
            extra(meta)["around_open"] += f'<abstract role="description"><para>{esc(told)}</para></abstract>'
        extra(meta)["around_open"] += f"<keywordset>{made}</keywordset>" if made else ""
    roles = {"reviewer": "technicaleditor", "translator": "translator", "proofreader": "proofreader"}
    made = ""
    for a in d.elements(people[PRE], "authorDescription") if people else ():
        name, key, role = plain(d, d.child(a[PRE], "fullname")), a[ATTRS].get("name", ""), a[ATTRS].get("role", "author")
        if name == "Dummy":
            continue
        first, _, rest = name.partition(" ")
        whole = f"<firstname>{esc(first)}</firstname><surname>{esc(rest)}</surname>" if rest else esc(name)
        whole += f'<othername role="pseudonym">{esc(key)}</othername>' if key and key != name and rest else ""
        urls = "".join(f"<uri>{esc(plain(d, u))}</uri>" for u in d.elements(a[PRE], "url"))
        tag = "author" if role not in roles else "othercredit"
        made += f"<{tag}{f' class=\"{roles[role]}\"' if role in roles else ''}><personname>{whole}</personname>{urls}</{tag}>"
    links = "".join(f'<member><link xlink:href="{esc(plain(d, d.child(x[PRE], "url")))}">{esc(plain(d, d.child(x[PRE], "texte")))}</link></member>' for x in (d.elements(also[PRE], "lien") if also else ()))
    behind = f"<para><simplelist>{links}</simplelist></para>" if links else ""
    head[LOCAL] = "#"
    extra(head)["around_open"] += "<info>" + names
    extra(head)["around_close"] = made + extra(head)["around_close"]
    for p in d.elements(synopsis[PRE]) if synopsis else ():  # what assembly put there
        inner = d.elements(p[PRE])
        if inner and all(x[LOCAL] in ("renvoi", "lien-forum") for x in inner) and not "".join(d.node(q)[TEXT] or "" for q in d.below.get(p[PRE], ()) if d.node(q)[KIND] == "text").strip():
            gone(d, p[PRE])
    kept = [p for p in (d.elements(synopsis[PRE]) if synopsis else ()) if not extra(p)["gone"]]
    if kept:
        extra(kept[-1])["around_close"] += behind
        extra(synopsis)["around_close"] += "</info>"
    else:
        if synopsis:
            gone(d, synopsis[PRE])
        extra(head)["around_close"] += (f"<abstract>{behind}</abstract>" if behind else "") + "</info>"


def pictures_back(d: Document) -> None:
    """Pictures with a title are figures; alternatives and captions stand in their media objects; parameters of animations stay."""
    for r in d.rows:
        if r[KIND] != "elem" or r[LOCAL] not in ("image", "animation"):
            continue
        a, x = r[ATTRS], d.extra[r[PRE] - 1]
        if x["parent_local"] == "paragraph":
            continue
        title, alt, caption, link = (a.get(k, "") for k in ("titre", "alt", "legende", "url"))
        data = {"image": ("imageobject", "imagedata"), "animation": ("videoobject", "videodata")}[r[LOCAL]]
        own = "".join(f' {k}="{esc(a[v])}"' for k, v in (("fileref", "src"), ("align", "align"), ("width", "width"), ("height", "height"), ("role", "type")) if a.get(v))
        params = "".join(f'<multimediaparam name="{k}" value="{esc(a[k])}"/>' for k in ("autoplay", "controls", "loop") if a.get(k)) if r[LOCAL] == "animation" else ""
        if not (title or alt or caption or link or params):
            continue
        media = f"<mediaobject{f' xlink:href=\"{esc(link)}\"' if link else ''}>{field('alt', alt)}<{data[0]}><{data[1]}{own}>{params}</{data[1]}></{data[0]}>{f'<caption><para>{esc(caption)}</para></caption>' if caption else ''}</mediaobject>"
        gone(d, r[PRE])
        x["gone"] = False
        r[LOCAL] = "#"
        x["around_open"] += f"<figure><title>{esc(title)}</title>{media}</figure>" if title else media


def to_docbook(docs: DataFrame, doc_id: str, content: str) -> DataFrame:
    """doc_id and xml of whole documents of the article markup, in DocBook."""
    return mapping.to_docbook(context.in_context(docs, doc_id, content, "xml", (), disassemble))


def sidecars(docs: DataFrame, doc_id: str, content: str) -> DataFrame:
    """doc_id and json: the configuration that a document's head holds, to stand beside it. Keys that lack are left out."""
    import json

    names = {"section": "rubrique", "licence_author": "licauteur", "licence_number": "lictype", "licence_year": "licannee", "licence_text": "lictext", "server": "serveur", "folder": "chemin", "url": "urlhttp"}

    def rows(d: Document, _):
        head = next((r for r in d.rows if r[KIND] == "elem" and r[LOCAL] == "entete"), None)
        out = {k: plain(d, x) for k, v in names.items() if head and (x := d.child(head[PRE], v))}
        forum = next((r[ATTRS] for r in d.rows if r[KIND] == "elem" and r[LOCAL] == "lien-forum"), {})
        out |= {k: forum[v] for k, v in (("forum_topic", "id"), ("forum_post", "idpost")) if v in forum}
        yield (json.dumps(out, ensure_ascii=False, sort_keys=True),)

    return _each(docs, doc_id, content, rows, "json string")
