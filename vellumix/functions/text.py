"""Column functions over names, links, markup and labelled text. All are built-in expressions and stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = "[ \\t\\r\\n]+"


def local_name(name: Column) -> Column:
    """The part of a qualified name behind its prefix."""
    return F.substring_index(name, ":", -1)


def extension(path: Column) -> Column:
    """The extension in lower case, or an empty string."""
    return F.lower(F.regexp_extract(path, "[.]([A-Za-z0-9]+)$", 1))


def strip_extension(path: Column) -> Column:
    return F.regexp_replace(path, "[.][A-Za-z0-9]+$", "")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def url_path(url: Column) -> Column:
    """The path of a URL without its leading slash, query and fragment."""
    return F.regexp_extract(url, "^[a-z]+://[^/]+/([^?#]*)", 1)


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-z]+://([^/?#]+)", 1)


def normalize_space(c: Column) -> Column:
    """XML white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def xpath_substring(c: Column, start: int, length: int) -> Column:
    """Positions count from 1; a start before 1 costs characters of the length."""
    first = max(start, 1)
    return F.substring(c, first, max(0, start + length - first))


def substring_before(c: Column, mark: str) -> Column:
    return F.when(F.instr(c, mark) > 0, F.substring_index(c, mark, 1)).otherwise(F.lit(""))


def substring_after(c: Column, mark: str) -> Column:
    return F.when(F.instr(c, mark) > 0, F.expr("''") if mark == "" else F.regexp_replace(c, f"^.*?\\Q{mark}\\E", "")).otherwise(F.lit(""))


def member_name(c: Column) -> Column:
    """The last part of a name with `::` scopes."""
    return F.substring_index(c, "::", -1)


def xml_escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def xml_unescape(c: Column) -> Column:
    for raw, safe in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("&", "&amp;")):
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


def ampersands_only(c: Column) -> Column:
    """Markup in which `&amp;` is the only reference: every other ampersand is text, as in `&quot;` or in an `&amp` that was cut; HTML parsers read those as references, too."""
    return F.regexp_replace(c, "&(?!amp;)", "&amp;")


def indent(c: Column, depth: Column, unit: str = "  ") -> Column:
    return F.concat(F.repeat(F.lit(unit), depth), c)


def slug(title: Column) -> Column:
    """A title as a file name: lower case, spaces and punctuation as hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-|-$", "")


def given_name(full: Column) -> Column:
    return F.substring_index(full, " ", 1)


def family_name(full: Column) -> Column:
    """All that follows the first space."""
    return F.regexp_replace(full, "^[^ ]+ ?", "")


def forum_topic(url: Column) -> Column:
    """The topic of a forum link in its query or its path, else null."""
    found = F.regexp_extract(url, "(?:[?&]t=|/d|/t)([0-9]+)", 1)
    return F.when(found != "", found.cast("long"))


def forum_post(url: Column) -> Column:
    found = F.regexp_extract(url, "(?:#post|[?&]p=|/p)([0-9]+)", 1)
    return F.when(found != "", found.cast("long"))


def forum_url(base: str, topic: Column, post: Column) -> Column:
    return F.concat(F.lit(base), F.lit("?t="), topic.cast("string"), F.when(post.isNotNull(), F.concat(F.lit("#post"), post.cast("string"))).otherwise(F.lit("")))


def video_embed(url: Column) -> Column:
    """A link to a video page as the link to its player; the mark is taken literally."""
    return F.replace(url, F.lit("watch?v="), F.lit("embed/"))


def flatten_link(text: Column) -> Column:
    """Links into sibling folders point to the flat folder instead; doing it twice changes nothing more."""
    return F.regexp_replace(text, 'href="(?:\\.\\./)+(?:[^"/]+/)*([^"/]+)"', 'href="$1"')


def rebase_link(text: Column, root: str) -> Column:
    """Relative links get the site's root in front."""
    return F.regexp_replace(text, 'href="/?([A-Za-z0-9][^":]*)"', f'href="{root}$1"')


def label_value(line: Column) -> Column:
    """What follows `Label :`, trimmed; null without a label."""
    found = F.regexp_extract(line, "^[^:]{1,40}: *(.*)$", 1)
    return F.when(line.rlike("^[^:]{1,40}:"), F.trim(found))


def label_name(line: Column) -> Column:
    return F.when(line.rlike("^[^:]{1,40}:"), F.lower(F.trim(F.substring_index(line, ":", 1))))
