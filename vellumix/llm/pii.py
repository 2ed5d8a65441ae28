"""Information-theoretic sanitisation of personal data.

Protected are e-mail and network addresses, phone, social-security and account numbers, and IBANs, each as a value and as what it
shares with others (an address's domain, a number's leading digits, a network). Mentions are always generalised to their kind,
such as <EMAIL>. Beyond that, corpus co-occurrence tells how strongly a term (any word of the document outside the mentions) reveals an
entity. The event space is the document on both sides: p(e) and p(t) are shares of documents, IC(e) = -log2 p(e) is what there is to
protect, PMI(t; e) = log2 p(t, e) / (p(t) p(e)) what the term gives away, and IC(e) - PMI(t; e) = -log2 p(e | t) bits stay hidden.

p(e | t) is estimated as (k r + PRIOR p(e)) / (k + PRIOR), with r the share of the term's documents that mention the entity and k the number of
different surroundings among them: a Beta prior of the corpus's own rate in place of a hard minimum, and copies of one text support nothing. A
term that leaves at most REMOVE_BITS is removed, one that leaves at most GENERALISE_BITS becomes <NUMBER>, <NAME> or <TERM>, in all
documents that mention the entity. An entity that is no secret, IC(e) <= GENERALISE_BITS, has nothing to protect beyond its mentions.

Cost. Entities mentioned by exactly the same documents are one class. A term of document frequency n can only reach the threshold for a class of n(e)
documents if n <= n(e) / r_min, where r_min solves the threshold for all k(e) surroundings; all others leave before any pair is made. Nothing that grows with
the corpus is shipped: the COMMON most frequent terms at most are broadcast, so that no join key is hot, and the rest is joined by term, class and row.

Defined results. Null texts stay null and empty ones empty. Texts of any length are read whole; texts without an entity stay as they
are, byte for byte. A term exactly at a threshold (a tie) is treated by it; if several entities of a document want a term treated,
removal wins. Repeated rows count as documents, and a null doc_id is kept. Account numbers and IBANs count whether or not their check digits are right.
sanitise_columns() keeps all columns, whatever their names; sanitise() reads doc_id and text only. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .common import cut, drop, map_batches, pieces, table, text_of, utf8
from .words import WordHasher, lower

PRIOR, REMOVE_BITS, GENERALISE_BITS = 1.0, 0.5, 1.5
PIECE_BYTES, HELD, COMMON = 1 << 20, 1 << 21, 1 << 16

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
NUMBERS = re.compile(
    r"(?P<IP6>(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5})(?![\w:]))"
    rf"|(?P<IP>(?<![\w.]){OCTET}(?:\.{OCTET}){{3}}(?![\w]|\.[0-9]))"
    r"|(?P<IBAN>(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<SSN>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))"
    r"|(?P<PHONE>(?<!\w)\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}(?!\w)|(?<![\w(])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?!\w)|(?<![\w.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![\w-]))"
    r"|(?P<ACCOUNT>(?<!\w)[0-9](?:[ -]?[0-9]){8,18}(?!\w))"
)
LOCAL, DOMAIN = re.compile(r"[\w.+%-]"), re.compile(r"(?:[\w-]+\.)+[\w-]*\w")
MAYBE = r"@|[0-9]|::"
COUNTS = ("n_entities", "n_generalised", "n_removed")
HELPERS = ("uid", "ctx", "entities", "terms")
#: So many leading letters and digits of a value are what it shares with others: country and area, bank, issuer, area.
SHARED = {"PHONE": 5, "IBAN": 8, "ACCOUNT": 6, "SSN": 3}


def entities(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of every mention, in order, none within another."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        if right := DOMAIN.match(text, at + 1):
            left = at
            while left > done and LOCAL.match(text, left - 1):
                left -= 1
            if left < at:
                out.append((left, right.end(), "EMAIL"))
        done = at + 1
        at = text.find("@", done)
    out += [(m.start(), m.end(), "IP" if m.lastgroup == "IP6" else m.lastgroup) for m in NUMBERS.finditer(text)]
    out.sort(key=lambda m: (m[0], -m[1]))
    kept, end = [], 0
    for m in out:
        if m[0] >= end:
            kept.append(m)
            end = m[1]
    return kept


def entity_names(text: str, mention: tuple[int, int, str]) -> tuple[str, str]:
    """What is mentioned, however it is written, and what it shares with others of its kind."""
    start, end, kind = mention
    if kind in ("EMAIL", "IP"):
        value = text[start:end].lower()
        shared = value.rpartition("@")[2] if kind == "EMAIL" else ".".join(value.split(".")[:3]) if "." in value else ":".join(value.split(":")[:3])
    else:
        value = re.sub(r"\W", "", text[start:end]).upper()
        shared = value[: SHARED[kind]]
    return f"{kind}:{value}", f"{kind}*{shared}"


def _hash(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


def entity_keys(text: str, found: list[tuple[int, int, str]]) -> list[int]:
    """Signed 64-bit hashes of the entities of a text."""
    return sorted({_hash(name.encode()) for m in found for name in entity_names(text, m)})


def _mentioning(texts: pa.Array) -> list[tuple[int, str, list[tuple[int, int, str]]]]:
    """Position, text and mentions of all rows that have any."""
    at = np.flatnonzero(pc.match_substring_regex(texts, MAYBE).to_numpy(zero_copy_only=False))
    rows = ((i, t, entities(t)) for i, t in zip(at.tolist(), texts.take(pa.array(at)).to_pylist()))
    return [r for r in rows if r[2]]


def _outside(text: str, found: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, _ in found:
        out.append(text[at:a])
        at = b
    return " ".join([*out, text[at:]])


def _plain(batch: pa.RecordBatch, at: int) -> pa.Array:
    text = batch.column(at)
    return (text if pa.types.is_string(text.type) else text.cast(pa.string())).fill_null("")


def _mark_batches(at: int):
    """Rows with a mention: all their columns, a number, a hash of what surrounds the mentions, their entities and their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, uid = WordHasher(), TaskContext.get().partitionId() << 33
        for whole in batches:
            for batch in pieces(whole, PIECE_BYTES, f"c{at}"):
                rows = _mentioning(_plain(batch, at))
                doc, h = hasher(*utf8(lower(pa.array([_outside(t, found) for _, t, found in rows], pa.string()))))
                words = np.split(h, np.searchsorted(doc, np.arange(1, len(rows)))) if rows else []
                cols = [
                    pa.array(np.arange(uid, uid + len(rows))),
                    pa.array([_hash(w.tobytes()) for w in words], pa.int64()),
                    pa.array([entity_keys(t, found) for _, t, found in rows], pa.list_(pa.int64())),
                    pa.array([np.unique(w).view(np.int64) for w in words], pa.list_(pa.int64())),
                ]
                uid += len(rows)
                kept = batch.take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns, *cols], [*batch.schema.names, *HELPERS])

    return run


def _rest_batches(at: int, counts: bool):
    """Rows without a mention, as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[i for i, _, _ in _mentioning(_plain(batch, at))]] = False
            batch = batch.filter(pa.array(keep))
            zeros = [pa.array(np.zeros(batch.num_rows, np.int32))] * (len(COUNTS) if counts else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, *zeros], [*batch.schema.names, *(COUNTS if counts else ())])

    return run


def marked(docs: DataFrame) -> DataFrame:
    """All rows of docs that mention an entity, as a table: columns c0, c1 and so on, and HELPERS."""
    at, n = docs.columns.index("text"), len(docs.columns)
    fields = [StructField(f"c{k}", f.dataType) for k, f in enumerate(docs.schema.fields)]
    longs = ArrayType(LongType())
    helpers = [StructField(c, t) for c, t in zip(HELPERS, (LongType(), LongType(), longs, longs))]
    return cut(docs.toDF(*(f"c{k}" for k in range(n))).mapInArrow(_mark_batches(at), StructType([*fields, *helpers])))


def _frequency_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher, held, size = WordHasher(), [], 0

    def merged():
        h, n = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(h)
        h, n = h[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        return h[first], np.add.reduceat(n, first)

    for batch in batches:
        for part in pieces(batch, PIECE_BYTES):
            raw, at = utf8(lower(text_of(part)))
            doc, h = hasher(raw, at)
            if not len(h):
                continue
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            first = np.concatenate(([True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])))
            held.append(np.unique(h[first], return_counts=True))
            size += len(held[-1][0])
            if size > HELD:
                h, n = merged()
                held, size = [(h, n)], len(h)
                if size > HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["term", "n"])
                    held, size = [], 0
    if held:
        h, n = merged()
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["term", "n"])


def document_frequency(docs: DataFrame) -> DataFrame:
    """term and n, the number of documents that have it, of all terms of the corpus."""
    rows = docs.select(F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    return rows.mapInArrow(_frequency_batches, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def entity_classes(found: DataFrame, n_docs: int) -> DataFrame:
    """entity and its class; documents n_e and surroundings k_e of it, and the largest document frequency of a term that can disclose it."""
    rows = found.select("uid", "ctx", F.explode("entities").alias("entity"))
    stats = rows.groupBy("entity").agg(F.count("*").alias("n_e"), F.count_distinct("ctx").alias("k_e"), F.bit_xor(F.xxhash64("uid")).alias("sig"))
    least = 2.0**-GENERALISE_BITS
    stats = stats.filter(-F.log2(F.col("n_e") / n_docs) > GENERALISE_BITS)
    r_min = (least * (F.col("k_e") + PRIOR) - PRIOR * F.col("n_e") / n_docs) / F.col("k_e")
    same = Window.partitionBy("n_e", "sig")
    return stats.withColumn("cap", F.floor(F.col("n_e") / r_min + 1e-9)).withColumn("class", F.min("entity").over(same)).drop("sig")


def disclosures(found: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of marked rows: entity and class; class, term, hidden_bits and remove of all pairs that disclose too much; and by uid the terms to treat."""
    n_docs = docs.filter("text IS NOT NULL").count()
    classes = cut(entity_classes(found, n_docs))
    frequency = cut(document_frequency(docs))
    total = frequency.agg(F.sum("n")).first()[0] or 0
    common = frequency.filter(F.col("n") > total / COMMON)  # fewer than COMMON terms, as their frequencies sum up to at most total
    of_doc = found.select("uid", F.explode("entities").alias("entity")).join(classes, "entity").select("uid", "class", "n_e", "cap").distinct()
    of_doc = cut(of_doc)
    caps = of_doc.groupBy("uid").agg(F.max("cap").alias("cap"))
    rows = found.select("uid", "ctx", "terms").join(caps, "uid").select("uid", "ctx", "cap", F.explode("terms").alias("term"))
    known = rows.join(F.broadcast(common), "term")
    rare = rows.join(F.broadcast(common.select("term")), "term", "left_anti").join(frequency.filter(F.col("n") <= total / COMMON), "term")
    able = known.unionByName(rare).filter(F.col("n") <= F.col("cap")).drop("cap")
    able = cut(able.join(of_doc, "uid").filter(F.col("n") <= F.col("cap")).select("uid", "ctx", "class", "n_e", "term", "n"))
    pairs = able.groupBy("class", "term", "n", "n_e").agg(F.count("*").alias("n_both"), F.count_distinct("ctx").alias("k"))
    estimate = (F.col("k") * F.least(F.col("n_both") / F.col("n"), F.lit(1.0)) + PRIOR * F.col("n_e") / n_docs) / (F.col("k") + PRIOR)
    pairs = pairs.select("class", "term", (-F.log2(estimate)).alias("hidden_bits")).filter(F.col("hidden_bits") <= GENERALISE_BITS)
    pairs = cut(pairs.withColumn("remove", F.col("hidden_bits") <= REMOVE_BITS))
    treat = able.select("uid", "class", "term").join(pairs, ["class", "term"]).groupBy("uid", "term").agg(F.max("remove").alias("remove"))
    treat = cut(treat.groupBy("uid").agg(F.collect_list(F.struct("term", "remove")).alias("found")).select("uid", F.col("found.term").alias("treated"), F.col("found.remove").alias("removed")))
    drop(frequency)
    drop(of_doc)
    drop(able)
    return classes.select("entity", "class"), pairs, treat


def disclosing(docs: DataFrame) -> DataFrame:
    """entity, term, hidden_bits and whether to remove the term, for all pairs that disclose too much."""
    docs = docs.select(F.col("text").cast("string").alias("text"))
    classes, pairs, _ = disclosures(marked(docs), docs)
    return classes.join(pairs, "class").drop("class")


def clean(text: str, term: np.ndarray, remove: np.ndarray, hasher: WordHasher) -> tuple[str, int, int, int]:
    """The text without its entities and these terms (hashes); how many were replaced, generalised and removed."""
    found = entities(text)
    edits = [(a, b, f"<{kind}>") for a, b, kind in found]
    n = [len(edits), 0, 0]
    if len(term):
        order = np.argsort(term)
        term, remove = term[order], remove[order]
        raw, at = utf8(lower(pa.array([text])))
        inside = np.zeros(len(raw) + 1, np.int32)  # 1: where the text within the mentions goes on
        byte = np.concatenate((np.flatnonzero((raw & 0xC0) != 0x80), [len(raw)]))  # where each character begins
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        for a, b, _ in found:
            inside[byte[a]] += 1
            inside[byte[b]] -= 1
        inside = np.cumsum(inside)
        bound = np.unique(np.concatenate(([0, len(raw)], *(byte[[a, b]] for a, b, _ in found))))
        start, stop, h = hasher.spans(raw, bound)  # mentions end words
        place = np.minimum(np.searchsorted(term, h), len(term) - 1)
        for i in np.flatnonzero((term[place] == h) & (inside[start] == 0)):
            a, b = int(char[start[i]]), int(char[stop[i] - 1]) + 1
            if remove[place[i]]:
                edits.append((a, b + (text[b : b + 1] == " "), ""))
                n[2] += 1
            else:
                word = text[a:b]
                edits.append((a, b, "<NUMBER>" if any(c.isdigit() for c in word) else "<NAME>" if word[0].isupper() else "<TERM>"))
                n[1] += 1
    out, at = [], 0
    for a, b, new in sorted(edits):
        out += [text[at:a], new]
        at = b
    return "".join(out) + text[at:], *n


def _clean_batches(at: int, names: list[str], counts: bool):
    """Marked rows, with the terms to treat in their last two columns, sanitised."""
    width = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            term, remove = batch.column(width), batch.column(width + 1)
            done = []
            for i, text in enumerate(_plain(batch, at).to_pylist()):
                some = term[i].values if term[i].is_valid else None
                hashes = some.to_numpy().view(np.uint64) if some is not None else np.zeros(0, np.uint64)
                flags = remove[i].values.to_numpy(zero_copy_only=False) if some is not None else np.zeros(0, bool)
                done.append(clean(text, hashes, flags, hasher))
            text, *n = zip(*done) if done else ((),) * 4
            cols = [pa.array(text, pa.string()) if k == at else c for k, c in enumerate(batch.columns[:width])]
            cols += [pa.array(x, pa.int32()) for x in n] if counts else []
            yield pa.RecordBatch.from_arrays(cols, [*names, *(COUNTS if counts else ())])

    return run


def sanitise_columns(docs: DataFrame, counts: bool = False) -> DataFrame:
    """docs with their texts sanitised; with counts, the numbers of replaced entities, generalised and removed terms are added."""
    docs = docs.withColumn("text", F.col("text").cast("string"))
    names, at = docs.columns, docs.columns.index("text")
    schema = StructType([*docs.schema.fields, *(StructField(c, IntegerType()) for c in COUNTS if counts)])
    found = marked(docs)
    classes, pairs, treat = disclosures(found, docs.select("text"))
    drop(pairs)
    rows = found.join(treat, "uid", "left").select(*(f"c{k}" for k in range(len(names))), "treated", "removed")
    rest = map_batches(docs, _rest_batches(at, counts), schema)
    return rest.union(rows.mapInArrow(_clean_batches(at, names, counts), schema))


def sanitise(docs: DataFrame) -> DataFrame:
    """doc_id, the sanitised text and what was done, for every row."""
    return sanitise_columns(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), counts=True)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise(table(spark, sf_dir, "documents"))
