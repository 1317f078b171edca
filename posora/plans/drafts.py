"""Prescription drafts: normal forms, the rules that they break, and a fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posora.functions.arrays import let
from posora.functions.forms import MEALS, WORDS_OF_ROUTE
from posora.functions.names import clean
from posora.sources.contracts import broken_rules

# Limits, and what stands for no answer.
MOST_TIMES, MOST_DAYS = 24, 3650
NO_MEAL, NO_ROUTE, OTHER_ROUTE = "unspecified", "unknown", "other"
NUMBER = r"^\+?(\d+(\.\d*)?|\.\d+)$"

#: The normal fields, in the order of the fingerprint.
FIELDS = [
    "dosage_text", "dose_amount", "dose_unit", "frequency_per_day", "meal_relation", "administration_route", "as_needed",
    "prn_max_per_day", "prescription_days", "long_term", "schedule_times", "start_date", "end_date",
]


def decimal_text(c: Column) -> Column:
    """The shortest decimal text of a number of up to 20 digits before the point and 10 after it; null for other texts."""
    value = let(F.trim(c), lambda text: F.when(text.rlike(NUMBER), text.try_cast("decimal(30,10)")).cast("string"))
    return F.regexp_replace(F.regexp_replace(value, r"0+$", ""), r"\.$", "")


def positive_integer(c: Column, most: int) -> Column:
    """A whole number from 1 to ``most``; null for anything else."""
    return let(decimal_text(c).try_cast("int"), lambda value: F.when(value.between(1, most), value))


def clock(c: Column) -> Column:
    """HH:MM of an hour and a minute of one or two digits; null for anything else."""
    h, m = F.regexp_extract(c, r"^(\d{1,2}):(\d{1,2})$", 1).try_cast("int"), F.regexp_extract(c, r"^(\d{1,2}):(\d{1,2})$", 2).try_cast("int")
    return F.when(h.between(0, 23) & m.between(0, 59), F.format_string("%02d:%02d", h, m))


def normalized_drafts(rows: DataFrame, today: Column) -> DataFrame:
    """``rows`` with the normal FIELDS, ``broken`` and ``fingerprint``.

    ``rows`` has texts for all fields but the booleans as_needed and long_term; schedule_times are comma-separated. Blank texts are
    no answer. ``broken`` names every rule that a draft breaks; a field that can't be read is null. The fingerprint is the SHA-256 of
    the FIELDS as one JSON object with nulls, null for drafts that break a rule. Columns with other names go through.
    """
    given = {c: clean(F.col(c)) for c in ("dosage_text", "dose_amount", "dose_unit", "frequency_per_day", "meal_relation", "administration_route", "prn_max_per_day", "prescription_days", "schedule_times", "start_date", "end_date")}
    rest = [c for c in rows.columns if c not in FIELDS]
    raw = rows.select(*rest, *(v.alias(f"_{c}") for c, v in given.items()), F.coalesce("as_needed", F.lit(False)).alias("as_needed"), F.coalesce("long_term", F.lit(False)).alias("long_term"))
    parts = F.coalesce(F.transform(F.split("_schedule_times", ","), lambda t: clock(F.trim(t))), F.array().cast("array<string>"))
    read = raw.withColumns({
        "_times": parts, "_frequency": positive_integer(F.col("_frequency_per_day"), MOST_TIMES), "prn_max_per_day": positive_integer(F.col("_prn_max_per_day"), MOST_TIMES),
        "prescription_days": positive_integer(F.col("_prescription_days"), MOST_DAYS), "dose_amount": decimal_text(F.col("_dose_amount")), "dose_unit": F.col("_dose_unit"),
        "meal_relation": F.coalesce("_meal_relation", F.lit(NO_MEAL)), "administration_route": F.coalesce("_administration_route", F.lit(NO_ROUTE)),
        "_start": F.coalesce(F.when(F.col("_start_date").isNotNull(), F.to_date(F.try_to_timestamp("_start_date", F.lit("yyyy-MM-dd")))), F.when(F.col("_start_date").isNull(), today)),
        "_end": F.to_date(F.try_to_timestamp("_end_date", F.lit("yyyy-MM-dd"))),
    })
    times = F.array_sort(F.array_compact("_times"))
    told = F.when(F.col("prescription_days").isNotNull(), F.date_add("_start", F.col("prescription_days") - 1))
    full = read.withColumns({
        "schedule_times": times, "frequency_per_day": F.coalesce("_frequency", F.when(F.col("_frequency_per_day").isNull() & (F.size(times) > 0), F.size(times))), "_told": told,
    }).withColumn("_last", F.coalesce("_told", "_end"))
    dose = F.when(F.col("dose_amount").isNotNull(), F.concat("dose_amount", F.coalesce("dose_unit", F.lit(""))))
    full = full.withColumns({"dosage_text": F.coalesce("_dosage_text", dose), "start_date": F.date_format("_start", "yyyy-MM-dd"), "end_date": F.date_format("_last", "yyyy-MM-dd")})

    def given_and_read(c: str) -> Column:
        return F.col(f"_{c}").isNull() | F.col(c).isNotNull()

    rules = {
        "schedule_time": F.size("_times") == F.size("schedule_times"), "schedule_duplicate": F.size(F.array_distinct("schedule_times")) == F.size("schedule_times"),
        "frequency": F.col("_frequency_per_day").isNull() | F.col("_frequency").isNotNull(), "frequency_schedule": (F.size("schedule_times") == 0) | (F.col("frequency_per_day") == F.size("schedule_times")),
        "prn_max": given_and_read("prn_max_per_day"), "prn_fixed": ~F.col("as_needed") | (F.col("frequency_per_day").isNull() & (F.size("schedule_times") == 0)),
        "prn_only": F.col("as_needed") | F.col("_prn_max_per_day").isNull(), "dose_amount": given_and_read("dose_amount") & F.coalesce(F.col("dose_amount") != "0", F.lit(True)),
        "meal_relation": F.col("meal_relation").isin(NO_MEAL, *MEALS), "administration_route": F.col("administration_route").isin(NO_ROUTE, OTHER_ROUTE, *WORDS_OF_ROUTE),
        "days": given_and_read("prescription_days"), "long_term": ~F.col("long_term") | (F.col("_prescription_days").isNull() & F.col("_end_date").isNull()),
        "date": F.col("_start").isNotNull() & (F.col("_end_date").isNull() | F.col("_end").isNotNull()), "end_conflict": F.coalesce(F.col("_end") == F.col("_told"), F.lit(True)),
        "end_before_start": F.coalesce(F.col("_last") >= F.col("_start"), F.lit(True)),
    }
    checked = broken_rules(full, rules)
    whole = F.sha2(F.to_json(F.struct(*FIELDS), {"ignoreNullFields": "false"}), 256)
    return checked.select(*rest, *FIELDS, "broken", F.when(F.size("broken") == 0, whole).alias("fingerprint"))


def repeated_drafts(drafts: DataFrame, who: list[str]) -> DataFrame:
    """(who, fingerprint, n) of drafts that stand more than once for the same person and product."""
    # counted, not filtered: a filter on the fingerprint would be pushed below everything that it is made of
    return drafts.groupBy(*who, "fingerprint").agg(F.count("fingerprint").alias("n")).filter("n > 1")
