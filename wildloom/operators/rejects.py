"""Loading records of which some do not follow the format.

Every field is first loaded as nullable text. Parsing and checking are column
expressions only: quotes are matched by parity (the parts of a record between
its quote signs are alternately outside and inside of quotes), so no regular
expression has to walk over a long text. All rules are evaluated into one
array of errors; rows with an empty array are valid.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wildloom.session import c, columns_or_fail

# Two private-use signs mark separators while a record is taken apart; where a
# record holds them itself they are escaped first and restored afterwards.
SEP, ESC = "\ue000", "\ue001"
INT32 = r"\A-?[0-9]+\z"


@dataclass(frozen=True)
class Field:
    """One field: ``kind`` is string, clean, int, choice or time."""

    name: str
    kind: str
    required: bool = False
    choices: tuple[str, ...] = ()
    sql: str = "string"


ITEM_FIELDS = (
    Field("id", "int", True, sql="int"),
    Field("deleted", "choice", False, ("0", "1"), "smallint"),
    Field("type", "choice", True, ("1", "2", "3", "4", "5"), "smallint"),
    Field("by", "string"),
    Field("time", "time", True, sql="timestamp_ntz"),
    Field("text", "clean"),
    Field("dead", "choice", False, ("0", "1"), "smallint"),
    Field("parent", "int", sql="int"),
    Field("poll", "int", sql="int"),
    Field("url", "string"),
    Field("score", "int", sql="int"),
    Field("title", "clean"),
    Field("descendants", "int", sql="int"),
)


def raw_fields(payload: Column) -> Column:
    """The record's fields as written, quotes included; commas inside quotes do not separate."""
    safe = F.replace(F.replace(payload, F.lit(ESC), F.lit(ESC + "b")), F.lit(SEP), F.lit(ESC + "a"))
    parts = F.split(safe, '"', -1)
    marked = F.transform(parts, lambda s, i: F.when(i % 2 == 0, F.replace(s, F.lit(","), F.lit(SEP))).otherwise(s))
    fields = F.split(F.array_join(marked, '"'), SEP, -1)
    return F.transform(fields, lambda f: F.replace(F.replace(f, F.lit(ESC + "a"), F.lit(SEP)), F.lit(ESC + "b"), F.lit(ESC)))


def _is_quoted(f: Column) -> Column:
    return (F.length(f) >= 2) & f.startswith('"') & f.endswith('"')


def _inner(f: Column) -> Column:
    return f.substr(F.lit(2), F.length(f) - 2)


def _well_formed(f: Column) -> Column:
    """A quoted field whose inner quotes are all doubled, or a bare one without quotes and line breaks."""
    doubled = ~F.contains(F.replace(_inner(f), F.lit('""'), F.lit("")), F.lit('"'))
    bare = ~f.rlike('["\\r\\n]')
    return F.when(_is_quoted(f), doubled).otherwise(bare)


def _value(f: Column) -> Column:
    """The field's text; an empty one is null."""
    text = F.when(_is_quoted(f), F.replace(_inner(f), F.lit('""'), F.lit('"'))).otherwise(f)
    return F.nullif(text, F.lit(""))


def _breaks(field: Field, v: Column) -> Column:
    """Whether a value that is there breaks its field's rule."""
    if field.kind == "int":
        return ~v.rlike(INT32) | v.try_cast("int").isNull()
    if field.kind == "choice":
        return ~v.isin(*field.choices)
    if field.kind == "time":
        form = r"\A(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}\z"
        return ~v.rlike(form) | v.try_cast("timestamp_ntz").isNull()
    if field.kind == "clean":
        return v.rlike("[\\x{FFFD}\\x7F\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]")
    return F.lit(False)


def check_records(df: DataFrame, payload: str = "payload", fields: tuple[Field, ...] = ITEM_FIELDS) -> DataFrame:
    """``df`` with ``values`` (struct of text fields, all nullable) and ``errors`` (array of text).

    Errors: ``no record`` (null payload), ``quoting``, ``columns:N`` (N fields
    found), ``missing:F`` and ``invalid:F`` for field F, in field order. A
    record with bad quoting or a wrong number of fields has no values, as no
    field can be told apart. An empty payload is one empty field. Columns of
    ``df`` named like these two are replaced; all others are kept.
    """
    columns_or_fail(df, payload)
    n = len(fields)
    p = c(payload)
    keep = [x for x in df.columns if x.lower() not in ("values", "errors")]
    # a generator is evaluated once per row; a plain projection would be copied into every rule
    parsed = df.withColumn("__f", F.explode(F.array(raw_fields(p))))
    odd_quotes = (F.length(p) - F.length(F.replace(p, F.lit('"'), F.lit("")))) % 2 == 1
    shape = F.struct((odd_quotes | ~F.forall("__f", _well_formed)).alias("broken"), F.size("__f").alias("n"))
    parsed = parsed.withColumn("__s", F.explode(F.array(shape)))
    broken, found = F.col("__s").getField("broken"), F.col("__s").getField("n")
    whole = p.isNotNull() & ~broken & (found == n)
    text = F.struct(*[F.when(whole, _value(F.get("__f", F.lit(i)))).alias(f.name) for i, f in enumerate(fields)])
    parsed = parsed.select(*[c(x) for x in keep], "__s", F.explode(F.array(text)).alias("__v"))
    values = F.col("__v")
    rules = [
        F.when(p.isNull(), F.lit("no record")),
        F.when(p.isNotNull() & broken, F.lit("quoting")),
        F.when(p.isNotNull() & ~broken & (found != n), F.concat(F.lit("columns:"), found.cast("string"))),
    ]
    for f in fields:
        v = values.getField(f.name)
        if f.required:
            rules.append(F.when(whole & v.isNull(), F.lit(f"missing:{f.name}")))
        if f.kind != "string":
            rules.append(F.when(whole & v.isNotNull() & _breaks(f, v), F.lit(f"invalid:{f.name}")))
    return parsed.select(*[c(x) for x in keep], values.alias("values"), F.array_compact(F.array(*rules)).alias("errors"))


def load_valid(checked: DataFrame, *keys: str, fields: tuple[Field, ...] = ITEM_FIELDS) -> DataFrame:
    """Typed rows of the valid records, after the columns ``keys`` that name the record."""
    typed = [F.col("values").getField(f.name).cast(f.sql).alias(f.name) for f in fields]
    return checked.where(F.size("errors") == 0).select(*[c(k) for k in keys], *typed)


def rejected(checked: DataFrame, *keys: str) -> DataFrame:
    """The other records with their errors, joined to one ``reason`` text."""
    return checked.where(F.size("errors") > 0).select(*[c(k) for k in keys], "errors", F.array_join("errors", "; ").alias("reason"))
