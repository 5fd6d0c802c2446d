"""Personal data: patterns for direct identifiers, co-occurrence for what gives them away.

Patterns find e-mail and IP addresses, card and phone numbers; each distinct
value is a protected entity.  The words of all texts that hold an entity are
counted with it, once for a text, and so are these words anywhere.  A word discloses
the share log(P(e|w) / P(e)) / -log P(e) of the entity's information, where
P(e|w) is estimated as (n_both + P(e)) / (n_word + 1), so that what is seen once
weighs less than what is seen often.  Each occurrence of a word over a threshold,
in every text that holds the entity, is a span as well.
Sanitising replaces identifiers by their kind and revealing words by a mark.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ARROW_ROWS, fresh_names, map_batches, materialize, small_batches

KINDS = ("email", "ip", "card", "phone")
#: Share of an entity's information from which on a word is removed.
DISCLOSURE = 0.8
_BUCKETS = 1 << 20

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match always takes a whole run of digits, so it never begins inside one.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W_]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches in linear time: each @ with the characters before it and the domain behind."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            end = found.end()
        at = text.find("@", max(at + 1, end))


def _luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def identifiers(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; leftmost non-overlapping matches of each kind that pass its check."""
    out = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return out


def _hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "big", signed=True)


def _term(word: str) -> int:
    """A cheap 63-bit hash of a word: two checksums."""
    raw = word.encode()
    return zlib.crc32(raw) << 31 | zlib.adler32(raw, len(raw)) >> 1


def entity_of(kind: str, value: str) -> int:
    """Hash of an identifier's value, without case and separators."""
    return _hash(f"{kind}:{value.lower()}" if kind in ("email", "ip") else f"{kind}:{re.sub('[^0-9]', '', value)}")


def words_of(text: str, found: list[tuple[str, int, int]]) -> list[tuple[int, int, int]]:
    """(term, start, end) of each word of three characters or more outside the identifiers; none where there is no identifier."""
    if not found:
        return []
    merged: list[list[int]] = []
    for a, b in sorted((a, b) for _, a, b in found):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    starts, out = [m[0] for m in merged], []
    for m in _WORD.finditer(text):
        at = bisect_left(starts, m.end()) - 1
        if len(m.group()) >= 3 and not (at >= 0 and m.start() < merged[at][1]):
            out.append((_term(m.group().lower()), *m.span()))
    return out


_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_WORDS = T.StructType([T.StructField("term", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def _scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, found, entities, words) of every row, written once."""
    schema = T.StructType([
        T.StructField("row", T.LongType()), T.StructField("doc_id", docs.schema[id_col].dataType),
        T.StructField("found", T.ArrayType(_SPAN)), T.StructField("entities", T.ArrayType(T.LongType())), T.StructField("words", T.ArrayType(_WORDS)),
    ])

    def run(batch: dict[str, list]) -> dict[str, list]:
        texts = [t or "" for t in batch["text"]]
        found = [identifiers(t) for t in texts]
        return {
            "row": batch["row"], "doc_id": batch["doc_id"],
            "found": [[dict(zip(_SPAN.names, f)) for f in fs] for fs in found],
            "entities": [sorted({entity_of(kind, t[a:b]) for kind, a, b in fs}) for t, fs in zip(texts, found)],
            "words": [[dict(zip(_WORDS.names, w)) for w in words_of(t, fs)] for t, fs in zip(texts, found)],
        }

    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return materialize(map_batches(src, run, schema), "identifiers")


def _entity_rows(scanned: DataFrame) -> DataFrame:
    """(row, entity, n_entity) of every text that holds an entity; entities that stand in the same texts are one, named by a hash of these."""
    held = scanned.select("row", F.explode("entities").alias("value"))
    alike = held.groupBy("value").agg(F.count("*").alias("n_entity"), F.bit_xor(F.xxhash64("row")).alias("rows"))
    named = materialize(alike.select("value", "n_entity", F.xxhash64("n_entity", "rows").alias("entity")), "entities")
    return materialize(held.join(named, "value").select("row", "entity", "n_entity").distinct(), "entity-rows")


def document_frequency(docs: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, df): in how many texts each word of ``terms`` stands, over all of ``docs``.

    The tasks get a bitmap of fixed size that leaves out most other words; a
    task sends one count for a word, or more if it meets very many.
    """
    buckets = terms.select(F.pmod("term", F.lit(_BUCKETS)).cast("int").alias("b")).distinct().toPandas()["b"].to_numpy()
    wanted = np.zeros(_BUCKETS, dtype=bool)
    wanted[buckets] = True

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[int] = Counter()

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(held.keys()), type=pa.int64()), pa.array(list(held.values()), type=pa.int64())], names=["term", "n"])
            held.clear()
            return made

        for batch in batches:
            for at in range(0, batch.num_rows, ARROW_ROWS):
                seen: Counter[str] = Counter()
                for text in batch.column(0).slice(at, ARROW_ROWS).to_pylist():
                    seen.update(set(_WORD.findall(text.lower())))
                hashed = [_term(w) for w in seen]
                keep = wanted[np.array(hashed, dtype=np.int64) % _BUCKETS] if hashed else []
                for h, n, k in zip(hashed, seen.values(), keep):
                    if k:
                        held[h] += n
                if len(held) > 200_000:
                    yield flush()
        yield flush()

    small_batches(docs.sparkSession)
    counted = docs.where(F.col(text_col).isNotNull()).select(text_col).mapInArrow(tally, "term long, n long")
    return counted.groupBy("term").agg(F.sum("n").alias("df")).join(terms.select("term").distinct(), "term")


def revealing(docs: DataFrame, scanned: DataFrame, entities: DataFrame, text_col: str = "text", disclosure: float = DISCLOSURE) -> DataFrame:
    """(entity, term) pairs whose term discloses at least ``disclosure`` of the entity's information."""
    n_docs = scanned.count()
    terms = scanned.where(F.size("words") > 0).select("row", F.explode(F.array_distinct(F.transform("words", lambda w: w["term"]))).alias("term"))
    together = materialize(terms.join(entities, "row").groupBy("entity", "term", "n_entity").agg(F.count("*").alias("n_both")), "together")
    if together.isEmpty():
        return together.select("entity", "term")
    df = document_frequency(docs, together, text_col)
    p_entity = F.col("n_entity") / F.lit(float(n_docs))
    p_given = F.least(F.lit(1.0), (F.col("n_both") + p_entity) / (F.col("df") + 1))
    share = F.when(p_entity < 1, F.log(p_given / p_entity) / -F.log(p_entity)).otherwise(0.0)
    return together.join(df, "term").where(share >= disclosure).select("entity", "term")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = DISCLOSURE) -> DataFrame:
    """(row, doc_id, found, terms) of every row: identifier spans, and spans of the words that reveal one of them.

    Spans are (kind, start, end) in code points, found by kind in the order of
    KINDS and then start, terms by start.  Null and empty texts have none; long
    texts are read whole; rows with null or repeated ids and equal rows are kept
    apart; other columns are not read; an empty table gives no rows.
    """
    scanned = _scan(docs, id_col, text_col)
    entities = _entity_rows(scanned)
    pairs = revealing(docs, scanned, entities, text_col, disclosure)
    words = scanned.where(F.size("words") > 0).select("row", F.inline("words"))
    marked = words.join(entities, "row").join(pairs, ["entity", "term"])
    terms = marked.groupBy("row").agg(F.array_sort(F.collect_set(F.struct(F.lit("term").alias("kind"), "start", "end"))).alias("terms"))
    none = F.array().cast(scanned.schema["found"].dataType)
    return scanned.select("row", "doc_id", "found").join(terms, "row", "left").withColumn("terms", F.coalesce("terms", none))


def _masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span replaced by its kind in brackets; of overlapping spans the one that begins first, then the longest, names all."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def sanitize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with identifiers and revealing words of every text replaced by marks; columns of any name and rows unchanged.

    Null, empty and long texts, repeated rows and empty tables are as in ``find_personal_data``.
    """
    name, marks = fresh_names(docs, "key", "spans")
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"))
    found = find_personal_data(docs.select(key.alias("key"), F.col(text_col).alias("text")), "key", "text", **options)
    spans = found.where(F.size("found") + F.size("terms") > 0).select(F.col("doc_id").alias(name), F.concat("found", "terms").alias(marks)).dropDuplicates([name])
    joined = docs.join(spans, key.eqNullSafe(F.col(name)), "left").drop(name)
    at = docs.columns.index(text_col)

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            made = [t if not s else _masked(t, [(x["kind"], x["start"], x["end"]) for x in s]) for t, s in zip(texts, spans)]
            columns = [pa.array(made, type=batch.schema.field(at).type) if i == at else c for i, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return joined.mapInArrow(mask, docs.schema)
