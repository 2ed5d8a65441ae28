"""Ordered regular-expression repair: a table of rules folded into one column.

What a page of a real site needs for itself is kept here as the pattern behind it (a list of terms without terms, a section that is a tab, a table left as HTML), guarded by
the page's subject; the rules change nothing in documents without that damage."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEVER = "(?!)"


@dataclass(frozen=True)
class Rule:
    """In documents whose name contains `guard`, every match of `pattern` becomes `replacement` (with $1, $2 ...). @ is the prefix of the markup's tags."""

    pattern: str
    replacement: str
    guard: str = ""
    fired: bool = False  # only if an earlier rule has changed the document
    id: str = ""

    def prefixed(self, prefix: str) -> Rule:
        return replace(self, pattern=self.pattern.replace("@", prefix), replacement=self.replacement.replace("@", prefix))


NL, GAP = r"\R", r"[ ]*\R?[ ]*"  # a line end; what may stand between two tags
PICTURE = rf'<@imageobject>{GAP}<@imagedata fileref="([^"]*)"/>{GAP}</@imageobject>{GAP}'
FIGURE = '<@figure>\n<@title>$2</@title>\n<@mediaobject>\n<@imageobject>\n<@imagedata fileref="$1"/>\n</@imageobject>\n</@mediaobject>\n</@figure>'
TABS = '<@bridgehead xml:id="tab-$1" renderas="sect5" role="tabbed checked" xlink:href="#tab-$1_contents">$2</@bridgehead>\n'
OPEN_TABLE = rf'[ ]*<div class="table">{GAP}<table( style="[^"]*")>{GAP}'


def _lists(role: str, guard: str, id: str) -> Rule:
    """A list of terms of which no item has a term is a plain list."""
    item = rf"<@listitem>{NL}<@para>[^\n]*</@para>{NL}</@listitem>{NL}"
    return Rule(rf'<@variablelist role="({role})">{NL}((?:{item})++)</@variablelist>', '<@itemizedlist role="$1">\n$2</@itemizedlist>', guard, id=id)


def _tabs(guard: str, tail: str, moved: str, id: str) -> Rule:
    """Two sections in a list item, one for each build tool, are two tabs; what follows the second one's listing goes behind them."""
    section = rf'<@section xml:id="using-([a-z]+)">{NL}<@title>Using ([A-Za-z]+)</@title>{NL}((?:<@programlisting[^>]*>[^<]*</@programlisting>{NL})++)'
    second = section.replace("([a-z]+)", "([a-z]+)", 1)
    heads = TABS + TABS.replace("$1", "$4").replace("$2", "$5")
    body = '<@sidebar xml:id="tab-$1_contents">\n$3</@sidebar>\n<@sidebar xml:id="tab-$4_contents">\n$6' + moved
    return Rule(rf"{section}</@section>{NL}{second}{tail}", heads + body, guard, id=id)


PARA = rf"(<@para>[^\n]*</@para>{NL})"
LAST_ITEM = rf"(<@listitem>{NL}<@para>[^\n]*</@para>{NL}</@listitem>){NL}</@listitem>"
#: Typical damage of generated markup, in order. Guards name pages by what they are about; a site with other names passes its own table.
TABLE_RULES = (  # tables written as HTML among the markup
    Rule(rf"{OPEN_TABLE}<tr><td( style=\"[^\"]*\")>{NL}[ ]*(<@para>[^\n]*</@para>){NL}[ ]*<br>{NL}", "<@informaltable$1>\n<@tr>\n<@td$2>\n$3\n", "intro", id="R35"),
    Rule(rf"[ ]*</@td><td( style=\"[^\"]*\")>{NL}[ ]*<@figure>", "</@td>\n<@td$1>\n<@figure>", "intro", id="R36 R46 R51"),
    Rule(rf"{OPEN_TABLE}<tr><td( style=\"[^\"]*\")>{NL}[ ]*<@figure>", "<@informaltable$1>\n<@tr>\n<@td$2>\n<@figure>", "intro", id="R37 R45"),
    Rule(rf"[ ]*</@td><td( style=\"[^\"]*\")>{NL}[ ]*(<@para>[^\n]*</@para>){NL}[ ]*<br>{NL}", "</@td>\n<@td$1>\n$2\n", "intro", id="R38 R39 R44"),
    Rule(rf"{OPEN_TABLE}<tr><td( style=\"[^\"]*\")>{NL}[ ]*(<@para>)", "<@informaltable$1>\n<@tr><@td$2>\n$3", "intro", id="R40 R54"),
    Rule(rf"(</@itemizedlist>){NL}[ ]*</@td><td( style=\"[^\"]*\")>{NL}[ ]*", "$1\n</@td>\n<@td$2>\n", "intro", id="R41"),
    Rule(rf"[ ]*</@td></@tr><tr><td( style=\"[^\"]*\")>{NL}[ ]*(<@para>[^\n]*</@para>){NL}[ ]*</td><td( style=\"[^\"]*\")>{NL}[ ]*", "</@td>\n</@tr>\n<@tr>\n<@td$1>\n$2\n</@td>\n<@td$3>\n", "intro", id="R42"),
    Rule(rf"[ ]*</@td></@tr>{NL}[ ]*</@informaltable>{NL}[ ]*</@section>", "</@td>\n</@tr>\n</@informaltable>\n</@section>", "intro", id="R43 R49"),
    Rule(rf"{OPEN_TABLE}<tr><td colspan=([0-9]+)( style=\"[^\"]*\")>{NL}[ ]*", '<@informaltable$1>\n<@tr>\n<@td colspan="$2"$3>\n', "intro", id="R47 R50 R52"),
    Rule(rf"[ ]*</td><td( style=\"[^\"]*\")>{NL}[ ]*(<@para>)", "</@td>\n<@td$1>\n$2", "intro", id="R48"),
    Rule(rf"[ ]*</td></@tr>{NL}[ ]*</@informaltable>", "</@td>\n</@tr>\n</@informaltable>", "intro", id="R53"),
    *(Rule(f"<{end}{tag}(?=[ >])", f"<{end}@{new}", "intro", fired=True, id="R55") for tag, new in (("tr", "tr"), ("td", "td"), ("table", "informaltable")) for end in ("", "/")),
)
BASE = (
    Rule('[ ]xml:id=""', "", id="R02"),
    Rule(rf"<@para>[ \n]*<@para>([^<]* is part of <@simplelist>[^\n]*?</@simplelist></@para>)[ \n]*</@para>", "<@para>$1", id="R01"),
    Rule("<@para>[ \n]*<@para>", "<@para>"),
    Rule("</@para>[ \n]*</@para>", "</@para>"),
    Rule(r'<@img src="images/([A-Za-z0-9_-]+[.](?:gif|png))"/>', r"\\inlineimage $1", id="R03"),
    Rule("<@emphasis(&#[0-9]+;)/>", "<@emphasis>$1</@emphasis>", id="R04 R23"),
    Rule('xlink:to="Notes for ([A-Z])([a-z]+)"', 'xlink:to="notes-$1$2.xml"', id="R05"),
    Rule('xlink:to="Desktop Notes"', 'xlink:to="desktop-notes.xml"', id="R06"),
    Rule("&amp;(quot|lt|gt|amp);", "&$1;", id="R25"),
    Rule('href="([A-Za-z])"', 'href="#$1"', id="R24"),
    Rule('<@link[^>]*href=""[^>]*>([^<]*)</@link>', "$1", id="R26"),
    Rule(r"<@term>(Since|Inherits|Status|In C[+][+]):</@term>", "<@term>$1</@term>", id="R56 R57 R58 R59"),
    Rule(rf"</@tr>{NL}</@tr>{NL}(<@para>[^\n]*</@para>){NL}</@informaltable>{NL}<@section", "</@tr>\n</@informaltable>\n$1\n<@section", id="R12"),
    Rule("</@tr>[ \n]*</@tr>", "</@tr>"),
    Rule(rf"</@itemizedlist>{NL}</@td>{NL}<@tr>{NL}<@td>", "</@itemizedlist>\n</@td>\n</@tr>\n<@tr>\n<@td>", id="R11"),
    Rule(rf"</@abstract>{NL}</@info>{NL}</@article>", "</@abstract>\n</@info>\n<@para/>\n</@article>", id="R10"),
    Rule(r'<@anchor xml:id="([^"]*)"/>[ \n]*<@section xml:id="\1"', '<@section xml:id="$1"', id="R07"),
    Rule(r'<@section>(<@title>[^<]* : [^<]*</@title><@fieldsynopsis>(?:<@[a-z]+>[^<]*</@[a-z]+>)++</@fieldsynopsis>)<@anchor xml:id="([^"]*)"/>', '<@section xml:id="$2">$1', id="R08"),
    Rule(r'(<@section xml:id="[^"]*"><@title>[^<]* : [^<]*</@title><@fieldsynopsis>(?:<@[a-z]+>[^<]*</@[a-z]+>)++</@fieldsynopsis>)<@anchor xml:id="[^"]*"/>', "$1", id="R09"),
    Rule('<@videodata fileref="([^"]*)"', '<?db video="iframe"?>\n<@videodata format="youtube" fileref="$1"', id="R22"),
    Rule(rf'<@variablelist role="([^"]*)">{NL}(<@listitem>[\s\S]*?)</@variablelist>', '<@itemizedlist role="$1">\n$2</@itemizedlist>', "overviews", id="R13"),
    _lists("annotated[a-z]*", "licence-list", "R14 R15"),
    _lists("macros[a-z-]*", "command-reference", "R16"),
    Rule(rf"<@para><@inlinemediaobject>{GAP}{PICTURE}</@inlinemediaobject></@para>{GAP}<@title>([^<]*)</@title>", FIGURE, "blur-effect", id="R17"),
    Rule(rf"(?<=<@td>\n)<@para><@inlinemediaobject>{GAP}{PICTURE}</@inlinemediaobject></@para>{GAP}<@title>([^<]*)</@title>(?=\n</@td>)", FIGURE, "combo-box", id="R18"),
    Rule('<div style="[^"]*background:#([0-9a-fA-F]+);"></div>', '<@phrase role="color:#$1">' + "&#160;" * 10 + "</@phrase>", "colours", id="R19"),
    Rule(rf'<@bridgehead renderas="sect2" xml:id="([^"]*)">([^<]*)</@bridgehead>(<@para>[\s\S]*?</@variablelist>){NL}</@article>', '<@section xml:id="$1"><@title>$2</@title>$3\n</@section>\n</@article>', "licence-list", id="R20"),
    Rule(rf"[ ]*<blockquote>{NL}[ ]*(<h1 class=[\s\S]*?){NL}[ ]*</blockquote>", '<@blockquote><@programlisting role="raw-html"><![CDATA[$1]]></@programlisting></@blockquote>', "markup-commands", id="R21"),
    _tabs("porting", rf"{PARA}</@section>{NL}{LAST_ITEM}", "</@sidebar>\n$7</@listitem>\n$8\n</@orderedlist>", "R27"),
    _tabs("customize", rf"{PARA}((?:<@programlisting[^>]*>[^<]*</@programlisting>{NL})++){PARA}</@section>{NL}{LAST_ITEM}", "$7$8</@sidebar>\n$9</@listitem>\n$10", "R28"),
    Rule(rf'(</@informaltable>){NL}(<@section xml:id="[a-z-]*-attached-prop">)', "$1\n</@section>\n$2", "theme", id="R29"),
    Rule(r'(<@section xml:id="([a-z-]*-attached-method)">[^\n]*?)<@anchor xml:id="\2"/>', "$1", "theme", id="R30"),
    Rule(rf'[A-Za-z0-9_-]+[.]jpg" title="[^"]*" /></a>{NL}</iframe></div>{NL}', "", "getting-started", id="R31"),
    Rule(rf'[A-Za-z0-9_-]+[.]jpg" title="[^"]*" /></a>{NL}</iframe></div>{NL}', "", "models", id="R32"),
    Rule(rf'</@listitem>{NL}(<@section xml:id="glossary">{NL}<@title>[^<]*</@title>){NL}</@section>{NL}<@listitem>', "</@listitem>\n</@itemizedlist>\n$1\n<@itemizedlist>\n<@listitem>", "high-dpi", id="R33"),
    Rule("</@itemizedlist></@section></@article>", "</@itemizedlist></@section></@section></@article>", "high-dpi", id="R34"),
    *TABLE_RULES,
    Rule("<br>", "<br/>"),
    Rule("<b>([^<]*)<br/>", "<b>$1</b><br/>"),
    Rule("[*#%&$]{3,}", ""),
    Rule("[ ]{2,}", " "),
)


def rules(prefix: str = "") -> tuple[Rule, ...]:
    """The rules for markup whose tags have this prefix, such as `db:`."""
    return tuple(r.prefixed(prefix) for r in BASE)


RULES = rules()
#: For folders in which some documents write the prefix `db:` and others none.
BOTH = RULES + tuple(r for r in rules("db:") if "db:" in r.pattern)


def repair(text: Column, name: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The text after all rules, in order. Each step mentions the text before it once, so the expression grows with the rules and no faster."""

    def step(c: Column, r: Rule) -> Column:
        if not r.guard:
            return F.regexp_replace(c, r.pattern, r.replacement)
        return F.regexp_replace(c, F.when(name.contains(r.guard), F.lit(r.pattern)).otherwise(F.lit(NEVER)), F.lit(r.replacement))

    return reduce(step, [r for r in rules if not r.fired], text)


def repair_documents(docs: DataFrame, name: str, text: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with the text repaired, and `changed`; rules that wait for a change see the text that the others left. Empty texts stay."""
    out = docs.withColumn("__new", repair(F.col(text), F.col(name), rules))
    for r in (r for r in rules if r.fired):
        guard = (F.col("__new") != F.col(text)) & (F.col(name).contains(r.guard) if r.guard else F.lit(True))
        out = out.withColumn("__new", F.regexp_replace("__new", F.when(guard, F.lit(r.pattern)).otherwise(F.lit(NEVER)), F.lit(r.replacement)))
    return out.withColumn("changed", ~F.col("__new").eqNullSafe(F.col(text))).withColumn(text, F.col("__new")).drop("__new")


def counters(repaired: DataFrame, text: str) -> DataFrame:
    """How many documents there are, were changed, and were ignored for being empty."""
    return repaired.agg(F.count("*").alias("n_total"), F.count_if("changed").alias("n_changed"), F.count_if(F.coalesce(F.length(text), F.lit(0)) == 0).alias("n_ignored"))


def inject_after(text: Column, tag: str, new: str, unless: str) -> Column:
    """`new` after the first </tag>, unless `unless` is there already: doing it twice changes nothing more."""
    at = F.instr(text, f"</{tag}>") + len(tag) + 2
    return F.when(F.contains(text, F.lit(unless)) | ~F.contains(text, F.lit(f"</{tag}>")), text).otherwise(F.concat(F.substring(text, F.lit(1), at), F.lit(new), F.substring(text, at + 1, F.length(text))))
