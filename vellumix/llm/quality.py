"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

MEASURES are ratios of integer counts taken from a text; RULES say which measure has to lie between which bounds, and
for how many words the rule speaks (short texts say little about ratios). A document is kept if no rule speaks against it.

Defined results. A null text counts as empty; an empty text, or one without a word, breaks `enough_words` only. Whole texts
of any length are measured. A value equal to a bound (a tie) is within it. Repeated rows are judged each for itself, and a
null doc_id is kept as it is. Only doc_id and text are read by judge(); filter_docs() returns all columns of its input,
whatever they are called. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table

SYMBOLS = "#$%&*|!^~<>{}[]=_+@\\"
STOP_WORDS = sorted(
    set(
        "the of and to in is it that for with as was on be by this are from at or an not which have has had were they their "
        "der die das und ist nicht mit ein eine den von zu sich auf für dem des im auch als es wie "
        "le la les de des un une et est en que qui dans pour sur pas par du au aux avec il elle ce "
        "el los las y que en un una es por con para del se su al lo como más".split()
    )
)
WORK = "__vellumix_tokens"
WORD_GAP, BULLET, ELLIPSIS = r"[^\p{L}\p{N}]+", r"^[ \t]*[-*•▪]", r"(\.\.\.|…)[ \t]*$"


@dataclass(frozen=True)
class Rule:
    name: str
    measure: str
    low: float
    high: float
    from_words: int = 0
    to_words: int = 1 << 62
    falls_from: int = 0  # from so many words on the lower bound falls with the root of their number, as the measure does in any language


#: The rules of the SQL; they speak against long texts for their length alone.
SQL_RULES = (
    Rule("enough_words", "n_words", 3, 1_000_000),
    Rule("word_length", "mean_word_length", 2.0, 14.0, 20),
    Rule("symbols", "symbols_per_word", 0.0, 0.3, 10),
    Rule("digits", "digit_ratio", 0.0, 0.5, 10),
    Rule("upper_case", "upper_ratio", 0.0, 0.5, 20),
    Rule("stop_words", "stop_word_ratio", 0.05, 1.0, 50),
    Rule("distinct_words", "distinct_word_ratio", 0.05, 1.0, 50),
    Rule("distinct_words_brief", "distinct_word_ratio", 0.25, 1.0, 20, 500),
    Rule("repeated_lines", "repeated_line_ratio", 0.0, 0.3, 50),
    Rule("bullet_lines", "bullet_line_ratio", 0.0, 0.9, 20),
    Rule("ellipsis_lines", "ellipsis_line_ratio", 0.0, 0.3, 20),
)
#: The same, but no text is too long, and the share of distinct words may fall with the length.
WHOLE = {"enough_words": {"high": float("inf")}, "distinct_words": {"falls_from": 20_100}}
RULES = tuple(replace(r, **WHOLE.get(r.name, {})) for r in SQL_RULES)


def tokens(text: str = "text") -> Column:
    """The text with its words (lower case) and its lines that aren't empty."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return F.struct(
        t.alias("t"),
        F.array_remove(F.split(F.lower(t), WORD_GAP), "").alias("words"),
        F.array_remove(F.split(t, "\n"), "").alias("lines"),
    )


def measures(at: str = WORK) -> dict[str, Column]:
    """Columns over the struct made by tokens()."""
    t, words, lines = F.col(f"{at}.t"), F.col(f"{at}.words"), F.col(f"{at}.lines")
    n_chars, n_words, n_lines = F.length(t), F.size(words), F.size(lines)
    some = lambda n: F.greatest(n, F.lit(1)).cast("double")
    without = lambda chars: F.length(F.translate(t, chars, ""))
    letters = F.length(F.regexp_replace(t, WORD_GAP, ""))
    upper = n_chars - F.length(F.regexp_replace(t, r"\p{Lu}+", ""))
    return {
        "n_chars": n_chars,
        "n_words": n_words,
        "n_lines": n_lines,
        "mean_word_length": letters / some(n_words),
        "symbols_per_word": (n_chars - without(SYMBOLS)) / some(n_words),
        "digit_ratio": (n_chars - without("0123456789")) / some(letters),
        "upper_ratio": upper / some(letters),
        "stop_word_ratio": F.size(F.filter(words, lambda w: w.isin(STOP_WORDS))) / some(n_words),
        "distinct_word_ratio": F.size(F.array_distinct(words)) / some(n_words),
        "repeated_line_ratio": (n_lines - F.size(F.array_distinct(lines))) / some(n_lines),
        "bullet_line_ratio": F.size(F.filter(lines, lambda x: x.rlike(BULLET))) / some(n_lines),
        "ellipsis_line_ratio": F.size(F.filter(lines, lambda x: x.rlike(ELLIPSIS))) / some(n_lines),
    }


def broken(rules: tuple[Rule, ...], of: dict[str, Column]) -> Column:
    """The names of the rules that speak against the text, joined by commas in the rules' order."""
    low = lambda r: r.low * F.sqrt(r.falls_from / F.greatest(of["n_words"], F.lit(r.falls_from))) if r.falls_from else r.low
    against = [F.when(of["n_words"].between(r.from_words, r.to_words) & ~of[r.measure].between(low(r), r.high), F.lit(r.name)) for r in rules]
    return F.concat_ws(",", *against)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, every measure, the broken rules and whether the document is kept, for every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tokens().alias(WORK))
    rows = rows.select("doc_id", *(c.alias(k) for k, c in measures().items()))
    return rows.withColumn("broken", broken(rules, {c: F.col(c) for c in rows.columns[1:]})).withColumn("keep", F.col("broken") == "")


def filter_docs(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that no rule speaks against, with their columns."""
    work = free_name(docs, WORK)
    needed = {r.measure for r in rules} | {"n_words"}
    rows = docs.withColumn(work, tokens())
    # a filter isn't pushed through a generator: else it would spell out the tokens anew for each measure in each rule
    measured = F.explode(F.array(F.struct(*(c.alias(k) for k, c in measures(work).items() if k in needed))))
    found = free_name(rows, work)
    kept = broken(rules, {k: F.col(f"{found}.{k}") for k in needed}) == ""
    return rows.select("*", measured.alias(found)).filter(kept).drop(work, found)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


def _sql(rules: tuple[Rule, ...] = SQL_RULES) -> str:
    quoted = ",".join(f"'{w}'" for w in STOP_WORDS)
    against = ", ".join(f"CASE WHEN n_words BETWEEN {r.from_words} AND {min(r.to_words, 1 << 30)} AND NOT {r.measure} BETWEEN {r.low} AND {r.high} THEN '{r.name}' END" for r in rules)
    return rf"""
WITH a AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT doc_id, t, list_filter(string_split_regex(lower(t), '{WORD_GAP}'), lambda w: w <> '') AS words,
  list_filter(string_split(t, chr(10)), lambda w: w <> '') AS lines, length(regexp_replace(t, '{WORD_GAP}', '', 'g')) AS letters FROM a),
c AS (SELECT doc_id, CAST(length(t) AS INTEGER) AS n_chars, CAST(len(words) AS INTEGER) AS n_words, CAST(len(lines) AS INTEGER) AS n_lines,
  letters / greatest(len(words), 1)::DOUBLE AS mean_word_length,
  (length(t) - length(translate(t, '{SYMBOLS}', ''))) / greatest(len(words), 1)::DOUBLE AS symbols_per_word,
  (length(t) - length(translate(t, '0123456789', ''))) / greatest(letters, 1)::DOUBLE AS digit_ratio,
  (length(t) - length(regexp_replace(t, '\p{{Lu}}+', '', 'g'))) / greatest(letters, 1)::DOUBLE AS upper_ratio,
  len(list_filter(words, lambda w: w IN ({quoted}))) / greatest(len(words), 1)::DOUBLE AS stop_word_ratio,
  len(list_distinct(words)) / greatest(len(words), 1)::DOUBLE AS distinct_word_ratio,
  (len(lines) - len(list_distinct(lines))) / greatest(len(lines), 1)::DOUBLE AS repeated_line_ratio,
  len(list_filter(lines, lambda x: regexp_matches(x, '{BULLET}'))) / greatest(len(lines), 1)::DOUBLE AS bullet_line_ratio,
  len(list_filter(lines, lambda x: regexp_matches(x, '{ELLIPSIS}'))) / greatest(len(lines), 1)::DOUBLE AS ellipsis_line_ratio FROM b)
SELECT *, concat_ws(',', {against}) AS broken, concat_ws(',', {against}) = '' AS keep FROM c"""


SQL = _sql()
