"""Secret scans with corpus-wide ownership frequency.

Candidates (well-known key formats, and long values assigned to names such as token or password) are found with one
regular expression and known by the SHA-256 of their value. Each hash is counted over distinct documents, repositories
and owners. A value that many owners have is a copied example; one that a single owner has, with many different
characters, looks live.

The owner is the column source, the repository source/lang. Verdicts: `placeholder` (says so itself), `copied` (COPIED
owners or more), `live` (one owner and at least DISTINCT different characters), else `weak`.

Defined results. Null and empty texts have no candidates; whole texts are read. A null source or lang counts as an empty
name; a null doc_id stays null in the findings and doesn't count as a document. A value that a row has several times gives one
finding, and so do rows that repeat each other. Exactly COPIED owners (a tie) means copied. Other columns aren't read.
An empty table gives no findings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

COPIED, DISTINCT = 3, 10
NAMES = r"(?i:api[_-]?key|access[_-]?key|auth[_-]?key|client[_-]?secret|secret|token|password|passwd)"
ASSIGN = NAMES + r"[\x22\x27]?[ \t]{0,3}(?::=|=>|[:=])[ \t]{0,3}[\x22\x27]?"
VALUE = r"[A-Za-z0-9_+/.=~-]{16,999}"
#: The patterns of the SQL, which can't repeat more than 999 times nor read a key's escapes and headers.
SQL_KINDS = {
    "aws_key": r"(?:AKIA|ASIA)[0-9A-Z]{16}",
    "github_token": r"gh[pousr]_[0-9A-Za-z]{36,251}",
    "payment_key": r"[sr]k_(?:live|test)_[0-9A-Za-z]{16,99}",
    "chat_token": r"xox[abprs]-[0-9A-Za-z-]{10,99}",
    "maps_key": r"AIza[0-9A-Za-z_-]{35}",
    "private_key": r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\r\n]{0,999}",
    "web_token": r"eyJ[0-9A-Za-z_-]{8,999}\.[0-9A-Za-z_-]{8,999}\.[0-9A-Za-z_-]{8,999}",
    "assignment": ASSIGN + VALUE,
}
#: The same without bounds. A private key runs to its END line, over escaped line ends, indents and headers; one without such a line is read as in SQL.
BEGIN, END = "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", "-----END [A-Z ]{0,20}PRIVATE KEY-----"
BODY = r"[A-Za-z0-9+/=\s\\:,.()]*+"
KINDS = {k: p.replace(",999}", ",}").replace(",251}", ",}").replace(",99}", ",}") for k, p in SQL_KINDS.items()}
KINDS["private_key"] = rf"{BEGIN}(?:{BODY}(?:-(?=[A-Za-z0-9]){BODY}){{0,64}}{END}|[A-Za-z0-9+/=\r\n]*)"
ANY, SQL_ANY = "|".join(KINDS.values()), "|".join(SQL_KINDS.values())
ASSIGNED, SQL_ASSIGNED = f"^{ASSIGN}({VALUE.replace(',999}', ',}')})$", f"^{ASSIGN}({VALUE})$"
PLACEHOLDER = r"(?i)example|placeholder|changeme|change-me|your[_-]|dummy|redacted|xxxxxxxx|0123456789|abcdefgh"


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, owner, repo, kind, value hash, number of different characters and whether it is a placeholder."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        name("source").alias("owner"),
        F.concat(name("source"), F.lit("/"), name("lang")).alias("repo"),
        F.explode(F.array_distinct(F.regexp_extract_all(F.col("text").cast("string"), F.lit(ANY), F.lit(0)))).alias("found"),
    )

    def kind(c: str):
        out = F.lit("assignment")
        for k, pattern in reversed([(k, p) for k, p in KINDS.items() if k != "assignment"]):
            out = F.when(F.col(c).rlike(f"^(?:{pattern})$"), k).otherwise(out)
        return out

    rows = rows.withColumn("kind", kind("found"))
    value = F.when(F.col("kind") == "assignment", F.regexp_extract("found", ASSIGNED, 1)).otherwise(F.col("found"))
    # the same key is the same value however its lines end and are indented
    key = F.regexp_replace(F.regexp_replace("found", rf"{END}$", ""), r"(?:\\r)?\\n|\\r", "\n")
    key = F.regexp_replace(F.regexp_replace(key, r"(?<=\n)[ \t]+|[ \t]+(?=\n)", ""), r"\n{2,}(?=$)", "\n")
    value = F.when((F.col("kind") == "private_key") & F.col("found").rlike(f"{END}$"), key).otherwise(value)
    rows = rows.withColumn("value", value)
    rows = rows.withColumn("kind", F.when(F.col("kind") == "assignment", kind("value")).otherwise(F.col("kind")))  # a well-known key is one wherever it is assigned
    return rows.select(
        "doc_id",
        "owner",
        "repo",
        "kind",
        F.sha2(F.col("value").cast("binary"), 256).alias("secret_sha256"),
        F.size(F.array_distinct(F.split("value", ""))).alias("n_characters"),
        F.col("value").rlike(PLACEHOLDER).alias("placeholder"),
    ).distinct()


def scan(docs: DataFrame, copied: int = COPIED, distinct: int = DISTINCT) -> DataFrame:
    """A finding for every row and value hash, with the hash's frequency over the corpus."""
    rows = docs.select("doc_id", "source", "lang", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    found = cut(candidates(rows))
    spread = found.groupBy("secret_sha256").agg(
        F.count_distinct("doc_id").alias("n_docs"), F.count_distinct("repo").alias("n_repos"), F.count_distinct("owner").alias("n_owners")
    )
    verdict = (
        F.when(F.col("placeholder"), "placeholder")
        .when(F.col("n_owners") >= copied, "copied")
        .when((F.col("n_owners") == 1) & (F.col("n_characters") >= distinct), "live")
        .otherwise("weak")
    )
    return found.join(spread, "secret_sha256").select(
        "doc_id", "owner", "repo", "kind", "secret_sha256", "n_characters", "n_docs", "n_repos", "n_owners", verdict.alias("verdict")
    )


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


_KIND = "CASE " + " ".join(f"WHEN regexp_matches(found, '^(?:{p})$') THEN '{k}'" for k, p in SQL_KINDS.items() if k != "assignment") + " ELSE 'assignment' END"
SQL = rf"""
WITH a AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(source, '') AS owner, coalesce(source, '') || '/' || coalesce(lang, '') AS repo,
  unnest(list_distinct(regexp_extract_all(text, '{SQL_ANY}'))) AS found FROM documents),
b AS (SELECT *, {_KIND} AS kind FROM a),
c AS (SELECT *, CASE WHEN kind = 'assignment' THEN regexp_extract(found, '{SQL_ASSIGNED}', 1) ELSE found END AS value FROM b),
d AS (SELECT DISTINCT doc_id, owner, repo, {_KIND.replace("found", "value")} AS kind, sha256(value) AS secret_sha256, CAST(len(list_distinct(string_split(value, ''))) AS INTEGER) AS n_characters,
  regexp_matches(value, '{PLACEHOLDER}') AS placeholder FROM c),
e AS (SELECT secret_sha256, count(DISTINCT doc_id) AS n_docs, count(DISTINCT repo) AS n_repos, count(DISTINCT owner) AS n_owners FROM d GROUP BY 1)
SELECT doc_id, owner, repo, kind, secret_sha256, n_characters, n_docs, n_repos, n_owners,
  CASE WHEN placeholder THEN 'placeholder' WHEN n_owners >= {COPIED} THEN 'copied' WHEN n_owners = 1 AND n_characters >= {DISTINCT} THEN 'live' ELSE 'weak' END AS verdict
FROM d JOIN e USING (secret_sha256)"""
