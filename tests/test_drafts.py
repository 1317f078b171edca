"""Prescription drafts and the substance layer on reviewed rows."""

from pyspark.sql import functions as F

from posora.plans import drafts, substances

SCHEMA = "k long, person string, dosage_text string, dose_amount string, dose_unit string, frequency_per_day string, meal_relation string, administration_route string, as_needed boolean, prn_max_per_day string, prescription_days string, long_term boolean, schedule_times string, start_date string, end_date string, broken string"


def row(k, **given):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return tuple({"k": k, "person": "A", **given}.get(n) for n in names)


def test_decimal_texts(spark):
    texts = ["1.50", "+2", "010", ".5", "3.", "1e3", "-1", "", None, "0.000", "1.23456789012", "99999999999999999999"]
    found = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(drafts.decimal_text(F.col("t"))).collect()]
    assert found == ["1.5", "2", "10", "0.5", "3", None, None, None, None, "0", "1.2345678901", "99999999999999999999"]


def test_drafts_in_normal_form(spark):
    rows = [
        row(1, dose_amount="1.50", dose_unit=" 정 ", schedule_times="20:5, 8:00", meal_relation="after_meal", prescription_days="3", start_date="2024-02-28"),
        row(2, as_needed=True, prn_max_per_day="4"),
        row(3, as_needed=True, frequency_per_day="2"),
        row(4, frequency_per_day="3", schedule_times="08:00"),
        row(5, schedule_times="25:00"),
        row(6, prescription_days="3", end_date="2024-02-01", start_date="2024-01-01"),
        row(7, long_term=True, end_date="2024-02-01"),
        row(8, start_date="2024-13-01"),
        row(9, end_date="2023-01-01"),
        row(10, prn_max_per_day="1"),
        row(11),
    ]
    found = {r.k: r for r in drafts.normalized_drafts(spark.createDataFrame(rows, SCHEMA).drop("broken"), F.lit("2024-01-05").cast("date")).collect()}
    one = found[1]
    assert (one.dose_amount, one.dosage_text, one.schedule_times, one.frequency_per_day, one.end_date, one.broken) == ("1.5", "1.5정", ["08:00", "20:05"], 2, "2024-03-01", [])
    assert found[2].broken == [] and found[2].prn_max_per_day == 4 and found[2].fingerprint and found[2].fingerprint != one.fingerprint
    broken = {k: found[k].broken for k in range(3, 11)}
    assert broken == {3: ["prn_fixed"], 4: ["frequency_schedule"], 5: ["schedule_time"], 6: ["end_conflict"], 7: ["long_term"], 8: ["date"], 9: ["end_before_start"], 10: ["prn_only"]}
    assert all(found[k].fingerprint is None for k in broken)
    assert (found[11].start_date, found[11].end_date, found[11].meal_relation, found[11].administration_route, found[11].as_needed) == ("2024-01-05", None, "unspecified", "unknown", False)
    twice = spark.createDataFrame([rows[0], row(20, **dict(dose_amount="1.5", dose_unit="정", schedule_times="08:00,20:05", meal_relation="after_meal", prescription_days="3", start_date="2024-02-28", frequency_per_day="2")), rows[10]], SCHEMA).drop("broken")
    same = drafts.repeated_drafts(drafts.normalized_drafts(twice, F.lit("2024-01-05").cast("date")), ["person"]).collect()
    assert [(r.person, r.n) for r in same] == [("A", 2)]


def test_slashes_part_only_trusted_names(spark):
    texts = spark.createDataFrame([(1, "alpha/Beta"), (2, "alpha/gamma"), (3, "alpha (1/2)"), (4, "alpha/ALPHA"), (5, " "), (6, None), (7, "1/2 alpha")], "k long, t string")
    trusted = spark.createDataFrame([("Alpha",), ("beta",), (None,)], "name string")
    found, unsure = substances.safe_slash_split(texts, trusted, "k", "t")
    assert sorted((r.k, r.key) for r in found.collect()) == [(1, "alpha"), (1, "beta"), (4, "alpha")]
    assert sorted((r.k, r.reason) for r in unsure.collect()) == [(k, substances.AMBIGUOUS) for k in (2, 3, 7)]


def test_names_of_one_outside_id_are_one_substance(spark):
    seen = [("a", "Alpha", None), ("a", "alpha", None), ("a2", "Alpha two", None), ("b", None, "베타"), ("c", None, "감"), ("c", None, None), ("d", "D", None), (None, "x", None)]
    matches = [("a", "U1", "normalized_name_exact"), ("a2", "U1", "typo"), ("b", "U2", "typo"), ("c", "U3", "typo"), ("c", "U4", "typo")]
    groups, names = substances.grouped_substances(spark.createDataFrame(seen, "key string, name_en string, name_ko string"), spark.createDataFrame(matches, "key string, external string, method string"), spark.createDataFrame([("d",)], "key string"))
    assert sorted((r.canonical_name, r.identity_status, r.n_names) for r in groups.collect()) == [
        ("Alpha", "resolved_external_exact", 2), ("D", "resolved_source_relation", 1), ("감", "local_exact_unsolved", 1), ("베타", "resolved_external_structured", 1),
    ]
    assert len({r.substance_id for r in names.collect() if r.key in ("a", "a2")}) == 1
