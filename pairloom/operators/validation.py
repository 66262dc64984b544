"""Validation of records held as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom import schemas
from pairloom.functions import jsonx as J
from pairloom.functions import text as X
from pairloom.functions.arrays import bound, let, once, unnest


def record_error(line: Column) -> Column:
    """First reason a JSON line is not a valid record; NULL for a valid one."""

    def in_record(record):
        def checked(v):
            wrong_medicine = ~J.items_have_keys(v, "medicines", schemas.MEDICINE_KEYS)
            return (
                F.when(~J.is_strict(v, record), F.lit("bad_output"))
                .when(~J.object_has_keys(v, schemas.RECORD_KEYS), F.lit("wrong_keys"))
                .when(wrong_medicine, F.lit("wrong_medicine_keys"))
            )

        return let(J.strict_variant(record), checked)

    def in_output(output, text):
        return F.when(output.isNotNull(), let(X.strip_marker(output), in_record)).otherwise(
            F.when(J.is_json(text), F.lit("no_output")).otherwise(F.lit("bad_line"))
        )

    return let(line, lambda text: let(J.text_field(text, "output"), lambda output: in_output(output, text)))


def with_errors(lines: DataFrame, column: str = "line") -> DataFrame:
    return once(lines, column).withColumn("error", record_error(F.col(column)))


def accept(lines: DataFrame, column: str = "line") -> DataFrame:
    """Add the pair (``input``, ``output`` with its marker) and whether the line is accepted.

    A line is accepted where it is an object with an input and an output whose text, without
    markers, is an object with the record's keys.
    """

    line, value, given, output, record = F.col(f"`{column}`"), F.col("__value"), F.col("__given"), F.col("__output"), F.col("__record")
    rows = bound(once(lines, column), "__value", J.strict_variant(line))
    rows = bound(rows, "__value", F.when(J.is_strict(value, line), value))
    rows = bound(bound(rows, "__given", J.member(value, "input")), "__output", J.member(value, "output"))
    rows = bound(rows, "__output", J.string_of(output))
    rows = bound(rows, "__record", F.when(given.isNotNull(), X.strip_marker(X.strip_object(output))))
    rows = bound(rows, "__value", J.strict_variant(record))
    rows = bound(rows, "__good", J.strict_object_has_keys(value, record, schemas.RECORD_KEYS))
    good = F.col("__good")
    return rows.select(
        *[F.col(f"`{c}`") for c in lines.columns], good.alias("accepted"),
        F.when(good, J.shown(given)).alias("input"), F.when(good, X.append_marker(output)).alias("output"),
    )


def batch_report(checked: DataFrame, batch: str = "batch", ok: str = "accepted") -> DataFrame:
    """Valid and total rows per batch, counted before the shuffle."""
    return checked.groupBy(batch).agg(
        F.count_if(F.col(ok)).alias("valid"), F.count(F.lit(1)).alias("total"), F.count_if(~F.col(ok)).alias("invalid")
    )


def typed_or_error(df: DataFrame, column: str, schema: T.StructType, message: str = "Invalid JSON output") -> DataFrame:
    """Parsed struct; where that fails, an error message and the raw text."""
    parsed = J.typed(F.col(column), schema)
    rows = df.withColumn("parsed", parsed)
    failed = F.col("parsed").isNull()
    return rows.withColumn("error", F.when(failed, F.lit(message))).withColumn("raw", F.when(failed, F.col(column)))


def fill_unspecified(record: Column) -> Column:
    """Missing fields of medicines and tests become ``"unspecified"``, missing lists empty; NULL stays NULL."""

    def filled(items, names):
        values = lambda m: F.struct(*[F.coalesce(m[n], F.lit(schemas.UNSPECIFIED)).alias(n) for n in names])
        return F.transform(items, values)

    empty = F.array().cast("array<string>")
    none = lambda schema: F.array().cast(T.ArrayType(schema))

    def whole(r):
        fields = F.struct(
            F.coalesce(filled(r["medicines"], schemas.MEDICINE_KEYS), none(schemas.MEDICINE)).alias("medicines"),
            F.coalesce(r["diseases"], empty).alias("diseases"),
            F.coalesce(r["symptoms"], empty).alias("symptoms"),
            F.coalesce(filled(r["tests"], schemas.TEST_KEYS), none(schemas.TEST)).alias("tests"),
            F.coalesce(r["instructions"], empty).alias("instructions"),
        )
        return F.when(r.isNotNull(), fields)

    return let(record, whole)


def field_coverage(records: DataFrame, column: str = "record") -> DataFrame:
    """Share of medicines in which a field is present and specified, one row per field."""

    def present(field):
        return F.transform(
            F.col(column)["medicines"],
            lambda m: F.coalesce(m[field] != schemas.UNSPECIFIED, F.lit(False)).cast("bigint"),
        )

    add = lambda a, x: a + x
    counts = records.select(
        F.coalesce(F.size(F.col(column)["medicines"]), F.lit(0)).cast("bigint").alias("n"),
        *[F.aggregate(present(f), F.lit(0).cast("bigint"), add).alias(f) for f in schemas.MEDICINE_KEYS],
    ).agg(F.sum("n").alias("n"), *[F.sum(f).alias(f) for f in schemas.MEDICINE_KEYS])
    rows = F.array(*[F.struct(F.lit(f).alias("field"), (F.col(f) / F.col("n")).alias("rate")) for f in schemas.MEDICINE_KEYS])
    return counts.select(F.explode(rows).alias("r")).select("r.field", "r.rate")


VALUE_KINDS = {"disease": "diseases", "symptom": "symptoms", "instruction": "instructions"}  # lists of texts


def explode_entities(records: DataFrame, keys: list[str], column: str = "record") -> DataFrame:
    """One row per entry of the five lists: (keys, pos, kind, name, dosage, frequency, duration, route, timing).

    The name of a disease, symptom or instruction is its text; lists that the record's type lacks have no rows.
    """
    record, none = F.col(column), F.lit(None).cast("string")
    held = records.schema[column].dataType.names

    def entry(kind, name, m=None):
        given = {"medicine": schemas.MEDICINE_KEYS, "test": schemas.TEST_KEYS}.get(kind, [])
        rest = [(m[f] if f in given else none).alias(f) for f in schemas.MEDICINE_KEYS if f != "name"]
        return F.struct(F.lit(kind).alias("kind"), name.alias("name"), *rest)

    def with_pos(items, kind):
        one = (lambda m: entry(kind, m)) if kind in VALUE_KINDS else (lambda m: entry(kind, m["name"], m))
        return F.coalesce(F.transform(items, lambda m, i: F.struct(i.alias("pos"), one(m).alias("e"))), F.array())

    lists = {"medicine": "medicines", "test": "tests", **VALUE_KINDS}
    items = F.concat(*[with_pos(record[name], kind) for kind, name in lists.items() if name in held])
    return unnest(records, keys, items, "x").select(*keys, "x.pos", "x.e.*")
