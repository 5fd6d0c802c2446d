"""Documents kept as they came, beside what a schema takes from them: undeclared fields are known, and can be taken later.

The document is a VARIANT: parsed once, stored in a binary form, and read by
path without parsing it again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.names import fresh, named

PAYLOAD = "raw_payload"


def path_of(field: str) -> str:
    """The path of a top-level field, in the quotes that its name has not; a name with both kinds or a question mark has no path."""
    quote = '"' if "'" in field else "'"
    if quote in field or "?" in field:
        raise ValueError(f"no path to a field named {field}")
    return f"$[{quote}{field}{quote}]"


def taken(payload: Column, field: str, kind: str) -> Column:
    """A field as a type; null where it is missing, null or of another kind."""
    return F.try_variant_get(payload, path_of(field), kind)


def with_payload(df: DataFrame, text: str, declared: Mapping[str, str], payload: str = PAYLOAD, broken: str | None = None) -> DataFrame:
    """``df`` with a column for each declared field (name -> type) of the JSON ``text``, and the document as VARIANT in its place.

    Text that is no JSON gives null in all of them; with ``broken`` it stays in
    a column of that name.  Null text is a null document, and breaks nothing.
    """
    held = fresh(payload, [c for c in df.columns if c != text], declared)
    parsed = df.withColumn(held, F.try_parse_json(named(text)))
    if broken is not None:
        parsed = parsed.withColumn(broken, F.when(named(held).isNull(), named(text)))
    rest = [c for c in df.columns if c not in (text, held)] + ([broken] if broken else [])
    return parsed.select(*map(named, rest), *[taken(named(held), f, kind).alias(f) for f, kind in declared.items()], named(held))


def undeclared(df: DataFrame, declared: Sequence[str], payload: str = PAYLOAD) -> DataFrame:
    """(field, n_rows, kind) of the documents' top-level fields that the schema does not take: how many documents have them, and the type that takes all their values.

    A field is one of the declared if its name is the same to the letter.  One
    row for each field reaches the result; documents that are no objects have
    none.
    """
    objects = df.select(named(payload).alias("doc")).where(F.schema_of_variant("doc").startswith("OBJECT"))
    fields = objects.lateralJoin(objects.sparkSession.tvf.variant_explode(F.col("doc").outer())).select(F.col("key").alias("field"), "value")
    others = fields.where(F.col("field").isNotNull() & ~F.col("field").isin(list(declared)))
    return others.groupBy("field").agg(F.count("*").alias("n_rows"), F.schema_of_variant_agg("value").alias("kind"))


def replayed(df: DataFrame, added: Mapping[str, str], payload: str = PAYLOAD) -> tuple[DataFrame, Column]:
    """``df`` with fields that a later schema declares, taken from the stored documents; and whether a row has one that its type does not take.

    A column that is there already is made anew.
    """
    doc = named(payload)
    found = {f: F.try_variant_get(doc, path_of(f), "variant") for f in added}
    drifted = F.lit(False)
    for f, kind in added.items():
        drifted = drifted | (found[f].isNotNull() & ~F.is_variant_null(found[f]) & taken(doc, f, kind).isNull())
    kept = [named(c) for c in df.columns if c not in added]
    return df.select(*kept, *[taken(doc, f, kind).alias(f) for f, kind in added.items()]), F.coalesce(drifted, F.lit(False))
