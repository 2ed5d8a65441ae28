"""Generated damage: for every repair rule a page that has it, and the page as it has to be afterwards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import repair
from .registry import query

ITEM = '<listitem>\n<para><link xlink:href="e{n}.xml" xlink:role="page">Example {n}</link></para>\n</listitem>\n'
PICTURE = '<para><inlinemediaobject>\n<imageobject>\n<imagedata fileref="images/p{n}.png"/>\n</imageobject>\n</inlinemediaobject></para>\n<title>Picture {n}</title>'
FIGURE = '<figure>\n<title>Picture {n}</title>\n<mediaobject>\n<imageobject>\n<imagedata fileref="images/p{n}.png"/>\n</imageobject>\n</mediaobject>\n</figure>'
FIELD = "<title>size{n} : int</title><fieldsynopsis><type>int</type><varname>size{n}</varname></fieldsynopsis>"
TABLE, STYLE = '    <div class="table">\n     <table style="border: none">\n      <tr>', ' style="width:50%"'
NEW_TABLE = '<informaltable style="border: none">\n<tr>\n'
END = " </section>"


def _tabs(name: str, more: str, moved: str, tail: str) -> tuple[str, str, str]:
    listing = "<programlisting>{n} %s</programlisting>\n"
    a, b = listing % "a", listing % "b"
    section = '<section xml:id="using-%s">\n<title>Using %s</title>\n'
    before = section % ("cmake", "CMake") + a + "</section>\n" + section % ("make", "Make") + b + more + "</section>\n" + ITEM.rstrip() + "\n</listitem>"
    tab = '<bridgehead xml:id="tab-%s" renderas="sect5" role="tabbed checked" xlink:href="#tab-%s_contents">%s</bridgehead>\n'
    after = tab % ("cmake", "cmake", "CMake") + tab % ("make", "make", "Make") + '<sidebar xml:id="tab-cmake_contents">\n' + a + '</sidebar>\n<sidebar xml:id="tab-make_contents">\n' + b
    return name, before, after + moved + "</listitem>\n" + ITEM.rstrip() + tail


#: rule, page, before, after; {n} is the page's number
DAMAGE: list[tuple[str, str, str, str]] = [
    ("R01", "any", "<para><para>Class {n} is part of <simplelist><member>M</member></simplelist></para>\n</para>", "<para>Class {n} is part of <simplelist><member>M</member></simplelist></para>"),
    ("R02", "any", '<section xml:id=""><title>{n}</title>', "<section><title>{n}</title>"),
    ("R03", "any", 'see <img src="images/face{n}.gif"/>', "see \\inlineimage face{n}.gif"),
    ("R04 R23", "any", "<emphasis&#246;/> {n} <emphasis&#228;/>", "<emphasis>&#246;</emphasis> {n} <emphasis>&#228;</emphasis>"),
    ("R05", "any", '<link xlink:to="Notes for Boards">{n}</link>', '<link xlink:to="notes-Boards.xml">{n}</link>'),
    ("R06", "any", '<link xlink:to="Desktop Notes">{n}</link>', '<link xlink:to="desktop-notes.xml">{n}</link>'),
    ("R07", "any", '<anchor xml:id="a{n}"/>\n<section xml:id="a{n}"><title>', '<section xml:id="a{n}"><title>'),
    ("R08", "any", f'<section>{FIELD}<anchor xml:id="p{{n}}"/>', f'<section xml:id="p{{n}}">{FIELD}'),
    ("R09", "any", f'<section xml:id="q{{n}}">{FIELD}<anchor xml:id="p{{n}}"/>', f'<section xml:id="q{{n}}">{FIELD}'),
    ("R10", "any", "<info><abstract>{n}</abstract>\n</info>\n</article>", "<info><abstract>{n}</abstract>\n</info>\n<para/>\n</article>"),
    ("R11", "any", "</itemizedlist>\n</td>\n<tr>\n<td>\n<para>{n}", "</itemizedlist>\n</td>\n</tr>\n<tr>\n<td>\n<para>{n}"),
    ("R12", "any", "</tr>\n</tr>\n<para>{n}</para>\n</informaltable>\n<section", "</tr>\n</informaltable>\n<para>{n}</para>\n<section"),
    ("R13", "overviews", '<variablelist role="a">\n<listitem>{n}</listitem>\n</variablelist><variablelist><varlistentry/></variablelist>', '<itemizedlist role="a">\n<listitem>{n}</listitem>\n</itemizedlist><variablelist><varlistentry/></variablelist>'),
    ("R14 R15", "licence-list", f'<variablelist role="annotatedattributions">\n{ITEM * 3}</variablelist>', f'<itemizedlist role="annotatedattributions">\n{ITEM * 3}</itemizedlist>'),
    ("R16", "command-reference", f'<variablelist role="macros-x">\n{ITEM}</variablelist>', f'<itemizedlist role="macros-x">\n{ITEM}</itemizedlist>'),
    ("R17", "blur-effect", f"a{{n}}\n{PICTURE}", f"a{{n}}\n{FIGURE}"),
    ("R18", "combo-box", f"<td>\n{PICTURE}\n</td>\n<td>\n{PICTURE}\n</td>", f"<td>\n{FIGURE}\n</td>\n<td>\n{FIGURE}\n</td>"),
    ("R19", "colours", '{n} <div style="border:0;background:#a1B2c3;"></div>', '{n} <phrase role="color:#a1B2c3">' + "&#160;" * 10 + "</phrase>"),
    ("R20", "licence-list", '<bridgehead renderas="sect2" xml:id="more">More</bridgehead><para>{n}</para>\n<variablelist>\n</variablelist>\n</article>', '<section xml:id="more"><title>More</title><para>{n}</para>\n<variablelist>\n</variablelist>\n</section>\n</article>'),
    ("R21", "markup-commands", '    <blockquote>\n<h1 class="title">{n}</h1>\n<p>x</p>\n    </blockquote>', '<blockquote><programlisting role="raw-html"><![CDATA[<h1 class="title">{n}</h1>\n<p>x</p>]]></programlisting></blockquote>'),
    ("R22", "any", '<videodata fileref="v{n}"></videodata>', '<?db video="iframe"?>\n<videodata format="youtube" fileref="v{n}"></videodata>'),
    ("R24", "any", '<member><link xlink:href="a">A</link>{n}</member>', '<member><link xlink:href="#a">A</link>{n}</member>'),
    ("R25", "any", "&amp;quot;{n}&amp;quot;", "&quot;{n}&quot;"),
    ("R26", "any", '<link xlink:href="" xlink:role="x">t{n}</link>', "t{n}"),
    ("R27", *_tabs("porting", "<para>All {n}</para>\n", "</sidebar>\n<para>All {n}</para>\n", "\n</orderedlist>")),
    ("R28", *_tabs("customize", "<para>If {n}</para>\n<programlisting>c</programlisting>\n<para>See</para>\n", "<para>If {n}</para>\n<programlisting>c</programlisting>\n</sidebar>\n<para>See</para>\n", "")),
    ("R29", "theme", '</informaltable>\n<section xml:id="t-attached-prop">{n}', '</informaltable>\n</section>\n<section xml:id="t-attached-prop">{n}'),
    ("R30", "theme", '<section xml:id="c-attached-method"><title>{n}</title><anchor xml:id="c-attached-method"/>', '<section xml:id="c-attached-method"><title>{n}</title>'),
    ("R31", "getting-started", 'a{n}\nI5_x.jpg" title="Play" /></a>\n</iframe></div>\nb', "a{n}\nb"),
    ("R32", "models", 'a{n}\n9B-x.jpg" title="Play" /></a>\n</iframe></div>\nb', "a{n}\nb"),
    ("R33", "high-dpi", '</listitem>\n<section xml:id="glossary">\n<title>G{n}</title>\n</section>\n<listitem>', '</listitem>\n</itemizedlist>\n<section xml:id="glossary">\n<title>G{n}</title>\n<itemizedlist>\n<listitem>'),
    ("R34", "high-dpi", "{n}</itemizedlist></section></article>", "{n}</itemizedlist></section></section></article>"),
    ("R35", "intro", f"{TABLE}<td{STYLE}>\n    <para>{{n}}</para>\n     <br>\n<para>b</para>", f"{NEW_TABLE}<td{STYLE}>\n<para>{{n}}</para>\n<para>b</para>"),
    ("R36 R46 R51", "intro", f"{{n}}\n      </td><td{STYLE}>\n    <figure>", f"{{n}}\n</td>\n<td{STYLE}>\n<figure>"),
    ("R37 R45", "intro", f"{TABLE}<td{STYLE}>\n    <figure>{{n}}", f"{NEW_TABLE}<td{STYLE}>\n<figure>{{n}}"),
    ("R38 R39 R44", "intro", f"a\n      </td><td{STYLE}>\n    <para>{{n}}</para>\n     <br>\n<para>b</para>", f"a\n</td>\n<td{STYLE}>\n<para>{{n}}</para>\n<para>b</para>"),
    ("R40 R54", "intro", f"{TABLE}<td{STYLE}>\n    <para>{{n}}</para>\n<itemizedlist>", f"{NEW_TABLE.rstrip()}<td{STYLE}>\n<para>{{n}}</para>\n<itemizedlist>"),
    ("R41", "intro", f"</itemizedlist>\n      </td><td{STYLE}>\n    <figure2>{{n}}", f"</itemizedlist>\n</td>\n<td{STYLE}>\n<figure2>{{n}}"),
    ("R42", "intro", f"a\n      </td></tr><tr><td{STYLE}>\n    <para>{{n}}</para>\n      </td><td{STYLE}>\n    <figure2>", f"a\n</td>\n</tr>\n<tr>\n<td{STYLE}>\n<para>{{n}}</para>\n</td>\n<td{STYLE}>\n<figure2>"),
    ("R43 R49", "intro", "{n}\n      </td></tr>\n     </informaltable>\n    </section>", "{n}\n</td>\n</tr>\n</informaltable>\n</section>"),
    ("R47 R50 R52", "intro", f"{TABLE}<td colspan=2{STYLE}>\n    <figure>{{n}}", f'{NEW_TABLE}<td colspan="2"{STYLE}>\n<figure>{{n}}'),
    ("R48", "intro", f"a\n      </td><td{STYLE}>\n    <para><link>{{n}}</link>", f"a\n</td>\n<td{STYLE}>\n<para><link>{{n}}</link>"),
    ("R53", "intro", "{n}\n      </td></tr>\n     </informaltable>\n<para>", "{n}\n</td>\n</tr>\n</informaltable>\n<para>"),
    ("R55", "intro", '<emphasis&#246;/><table border="0"><tr><td>{n}</td></tr></table>', '<emphasis>&#246;</emphasis><informaltable border="0"><tr><td>{n}</td></tr></informaltable>'),
    ("R55 not", "intro", "<table><tr><td>{n}</td></tr></table>", "<table><tr><td>{n}</td></tr></table>"),
    ("R56-R59", "any", "<term>Since:</term><term>Inherits:</term><term>In C++:</term><term>Status:</term>{n}", "<term>Since</term><term>Inherits</term><term>In C++</term><term>Status</term>{n}"),
    ("guards", "elsewhere", f"{{n}}<td>\n{PICTURE}\n</td>", f"{{n}}<td>\n{PICTURE}\n</td>"),
]
K = len(DAMAGE)


def _sql() -> str:
    q = lambda x: "'" + x.replace("'", "''") + "'"
    cases = " ".join(f"WHEN {k} THEN {q(after)}" for k, (*_, after) in enumerate(DAMAGE))
    same = ", ".join(str(k) for k, (_, _, before, after) in enumerate(DAMAGE) if before == after)
    rule = " ".join(f"WHEN {k} THEN {q(d[0])}" for k, d in enumerate(DAMAGE))
    return f"SELECT doc_id, CASE doc_id % {K} {rule} END AS rule, replace(CASE doc_id % {K} {cases} END, '{{n}}', CAST(doc_id AS VARCHAR)) AS repaired, doc_id % {K} NOT IN ({same}) AS changed FROM documents"


@query("M R01-R59 R55 I01", _sql())
def repair_damage(t, _):
    """Every rule on pages that need it, one kind of damage for each document number."""
    at = (F.col("doc_id") % K + 1).cast("int")
    pick = lambda k: F.element_at(F.array(*(F.lit(d[k]) for d in DAMAGE)), at)
    text = F.replace(pick(2), F.lit("{n}"), F.col("doc_id").cast("string"))
    rows = t("documents").select("doc_id", pick(0).alias("rule"), F.concat(pick(1), F.lit(".xml")).alias("name"), text.alias("text"))
    return repair.repair_documents(rows, "name", "text").select("doc_id", "rule", F.col("text").alias("repaired"), "changed")
