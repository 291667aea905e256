"""Instrument responses as text of numbered fields (RESP), a row for each stage, as ``models.read_stationxml`` gives.

The text is cut at station fields, which begin a channel's epoch, by the reader
itself, so a long file is many tasks; an epoch is cut at the first field of each
blockette, and blockettes of one stage are put together within the row.  Nothing is
shuffled.

Defined results: comments, blank lines and unknown fields are passed over; a
blockette that goes on in a second one of the same stage adds its coefficients;
stage 0 is the sensitivity of the whole; an end that is not a date is null, as is a
start; ``??`` for the location is none.  Epochs without a channel or without stages
have no rows.  Symmetric filters are written out in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The field of the stage number, by blockette.
STAGE = {"053": "04", "054": "04", "057": "03", "058": "03", "061": "03", "062": "04"}
_START = r"(?m)(?=^\s*B0[0-9]{2}F03\s)"
_DATE = r"^([0-9]{4}),([0-9]{1,3})(?:,([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}(?:\.[0-9]*)?))?)?"


def _field(text: Column, tag: str) -> Column:
    """What follows the colon of a field, null if there is none."""
    return F.nullif(F.regexp_extract(text, rf"(?m)^\s*B{tag}[ \t][^\n:]*:[ \t]*([^\n]*?)\s*$", 1), F.lit(""))


def _numbers(text: Column, tag: str) -> Column:
    """Rows of a field of many: arrays of their numbers, the row's own left out."""
    rows = F.regexp_extract_all(text, F.lit(rf"(?m)^\s*B{tag}[ \t]+[0-9]+[ \t]+([-+0-9.eEdD \t]+?)\s*$"), F.lit(1))
    return F.transform(rows, lambda x: F.transform(F.split(x, r"[ \t]+"), lambda y: F.translate(y, "dD", "ee").try_cast("double")))


def _date(text: Column) -> Column:
    part = lambda k: F.nullif(F.regexp_extract(text, _DATE, k), F.lit(""))
    day = F.expr("to_date('1970-01-01')")
    first = F.make_date(part(1).cast("int"), F.lit(1), F.lit(1))
    micros = F.round((F.coalesce(part(3), F.lit("0")).cast("long") * 3600 + F.coalesce(part(4), F.lit("0")).cast("long") * 60 + F.coalesce(part(5), F.lit("0")).cast("double")) * 1e6).cast("long")
    days = (F.datediff(first, day) + part(2).cast("int") - 1).cast("long")
    return F.when(text.rlike(_DATE), F.timestamp_micros(days * 86_400_000_000 + micros))


def whole_filter(symmetry: Column, half: Column) -> Column:
    """Coefficients of a filter whose symmetry (none, odd or even) lets half of them be left out."""
    back = F.reverse(half)
    return F.when(symmetry == "odd", F.concat(half, F.slice(back, F.lit(2), F.greatest(F.size(half) - 1, F.lit(0))))).when(symmetry == "even", F.concat(half, back)).otherwise(half)


def _first(pieces: Column, tag: str) -> Column:
    return F.try_element_at(F.array_compact(F.transform(pieces, lambda p: _field(p, tag))), F.lit(1))


def _all(pieces: Column, tag: str) -> Column:
    return F.flatten(F.transform(pieces, lambda p: _numbers(p, tag)))


def _complex(rows: Column) -> Column:
    return F.transform(rows, lambda x: F.struct(F.try_element_at(x, F.lit(1)).alias("Real"), F.try_element_at(x, F.lit(2)).alias("Imaginary")))


def _single(rows: Column) -> Column:
    return F.transform(rows, lambda x: F.try_element_at(x, F.lit(1)))


def read_resp(spark: SparkSession, path: str) -> DataFrame:
    """sid, start, end, stage, gain, scale, poles, zeros, kind, numerators, denominators, rate, factor.

    kind: paz, coefficients, fir, polynomial, or null where the stage is only a
    gain; rate (before) and factor are those of decimation.
    """
    text = spark.read.option("lineSep", "B050F03").text(path).select(F.concat(F.lit("B050F03"), F.regexp_replace("value", "\r", "")).alias("t"))
    pieces = F.split("t", _START)
    number = lambda p: F.coalesce(*[_field(p, f"{b}F{f}") for b, f in STAGE.items()]).try_cast("int")
    held = F.filter(F.transform(pieces, lambda p: F.struct(number(p).alias("k"), p.alias("p"))), lambda x: x["k"].isNotNull())
    epochs = text.select(
        _field(F.col("t"), "050F16").alias("net"),
        _field(F.col("t"), "050F03").alias("sta"),
        F.coalesce(F.nullif(_field(F.col("t"), "052F03"), F.lit("??")), F.lit("")).alias("loc"),
        _field(F.col("t"), "052F04").alias("cha"),
        _date(_field(F.col("t"), "052F22")).cast("timestamp_ntz").alias("start"),
        _date(_field(F.col("t"), "052F23")).cast("timestamp_ntz").alias("end"),
        held.alias("held"),
    ).where("cha is not null")
    stages = epochs.select("*", F.explode(F.array_distinct(F.transform("held", lambda x: x["k"]))).alias("stage"))
    own = F.transform(F.filter("held", lambda x: x["k"] == F.col("stage")), lambda x: x["p"])
    rows = stages.select(F.concat_ws(".", F.coalesce("net", F.lit("")), F.coalesce("sta", F.lit("")), "loc", "cha").alias("sid"), "start", "end", "stage", own.alias("own"))
    number = lambda tag: _first(F.col("own"), tag).try_cast("double")
    has = lambda b: F.exists("own", lambda p: F.ltrim(p).startswith(f"B{b}"))
    symmetry = F.element_at(F.create_map(*[F.lit(x) for x in ("A", "none", "B", "odd", "C", "even")]), F.upper(F.coalesce(_first(F.col("own"), "061F05"), F.lit("A"))))
    kind = F.when(has("053"), "paz").when(has("061"), "fir").when(has("062"), "polynomial").when(has("054"), "coefficients")
    numerators = F.when(kind == "fir", whole_filter(symmetry, _single(_all(F.col("own"), "061F09")))).when(kind == "polynomial", _single(_all(F.col("own"), "062F15-16"))).when(kind == "coefficients", _single(_all(F.col("own"), "054F08-09")))
    return rows.select(
        "sid", "start", "end", "stage", number("058F04").alias("gain"), number("053F07").alias("scale"),
        F.when(kind == "paz", _complex(_all(F.col("own"), "053F15-18"))).alias("poles"),
        F.when(kind == "paz", _complex(_all(F.col("own"), "053F10-13"))).alias("zeros"),
        kind.alias("kind"), numerators.alias("numerators"),
        F.when(kind == "coefficients", _single(_all(F.col("own"), "054F11-12"))).alias("denominators"),
        number("057F04").alias("rate"), number("057F05").cast("int").alias("factor"),
    )
