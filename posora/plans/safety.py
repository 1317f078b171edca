"""The rules engine as plans: one row for each person, course and rule in, findings out.

Each function takes tables whose rows are already those of one person and
product (joined on keys) and folds them by ordered conditions. What can't be
told for certain is kept as `unknown` or `conditional`, never dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from posora.functions import rules

# Evaluators, markers of restrictions after a course, patterns of waiting times.
EVALUATORS = ["minimum_separation", "excluded_route"]
WITHIN_HOURS = r"([0-9]+)\s*시간\s*이내"
AFTER_COURSE = r"^(.*?)(?:투여|복용)\s*(?:중단|종료)\s*후\s*([0-9]+)\s*(시간|일|주)"
POST_COURSE_MARKERS = ["중단 후", "종료 후", "중단후", "종료후"]
SUPPORT_AGE, ADULT_AGE = 65, 19


def evaluation_dates(start: Column, end: Column, as_of: Column) -> Column:
    """The days on which a profile is held against rules: today or a later start, and the end if it is later still."""
    first = F.when(as_of.isNull() | (start > as_of), start).otherwise(as_of)
    return F.array_compact(F.array(first, F.when(first.isNull() | (end > first), end)))


def age_risks(rows: DataFrame) -> DataFrame:
    """``rows`` (birth_date, rule_value, dates) with ``outcome``: hit on any day, else unknown on any, else clear."""
    one = F.transform("dates", lambda d: rules.age_rule_applies(F.col("rule_value"), F.col("birth_date"), d))
    outcome = F.when(F.exists(one, lambda x: F.coalesce(x, F.lit(False))), "hit").when(F.exists(one, lambda x: x.isNull()) | (F.size("dates") == 0), "unknown")
    return rows.withColumn("outcome", outcome.otherwise("clear"))


def pregnancy_risks(rows: DataFrame) -> DataFrame:
    """One finding for each rule of a pregnant person, or one unknown finding where grades differ: (person, item, rule_id, outcome)."""
    graded = rows.filter("pregnancy_status = 'pregnant'").withColumn("g", rules.pregnancy_grade(F.col("rule_value")))
    whose = W.partitionBy("person", "item_seq")
    seen = graded.withColumn("grades", F.size(F.collect_set("g.grade").over(whose))).withColumn("first", F.min("rule_id").over(whose))
    outcome = F.when(F.col("grades") > 1, "unknown").when(F.coalesce(F.col("g.conditional"), F.lit(False)), "conditional").otherwise("hit")
    return seen.withColumn("outcome", outcome).filter("grades <= 1 OR rule_id = first").select("person", "item_seq", "rule_id", "outcome")


def timing(details: Column, left: Column, right: Column, evaluator: Column, hours: Column, mode: Column) -> Column:
    """struct(status, kind, hours, source_side) of a combination: facts of the reference first, then its text, else overlap."""
    text = F.trim(F.regexp_replace(F.coalesce(details, F.lit("")), r"\s+", " "))
    within = F.nullif(F.regexp_extract(text, WITHIN_HOURS, 1), F.lit("")).cast("int")
    after = F.nullif(F.regexp_extract(text, AFTER_COURSE, 2), F.lit("")).cast("int")
    unit = F.regexp_extract(text, AFTER_COURSE, 3)
    side = source_side(F.regexp_extract(text, AFTER_COURSE, 1), left, right)
    marked = F.lit(False)
    for word in POST_COURSE_MARKERS:
        marked = marked | text.contains(word)

    def told(status: str, kind: str, h: Column | None = None, s: Column | None = None) -> Column:
        none = F.lit(None)
        return F.struct(F.lit(status).alias("status"), F.lit(kind).alias("kind"), (none if h is None else h).cast("int").alias("hours"), (none if s is None else s).cast("string").alias("source_side"))

    return (
        F.when(evaluator == "minimum_separation", told("structured", "minimum_separation", F.coalesce(hours, F.lit(0))))
        .when((mode == "runtime_evaluable") & ~evaluator.isin(EVALUATORS), told("not_evaluable", "unknown_contract_evaluator"))
        .when(mode == "review_required", told("not_evaluable", "review_required_condition"))
        .when(within.isNotNull(), told("structured", "minimum_separation", within))
        .when(after.isNotNull() & side.isNotNull(), told("structured", "washout_after", after * F.when(unit == "일", 24).when(unit == "주", 168).otherwise(1), side))
        .when(after.isNotNull() | marked, told("not_evaluable", "post_course_restriction"))
        .otherwise(told("default", "course_overlap"))
    )


def source_side(subject: Column, left: Column, right: Column) -> Column:
    """The one side whose words hold all of the subject's or the other way round; null for none and for both."""

    def words(c: Column) -> Column:
        return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[0-9a-z가-힣]+"), F.lit(0)))

    own = words(subject)

    def held(c: Column) -> Column:
        w = words(c)
        return (F.size(w) > 0) & (F.size(own) > 0) & ((F.size(F.array_except(own, w)) == 0) | (F.size(F.array_except(w, own)) == 0))

    a, b = held(left), held(right)
    return F.when(a & ~b, "left").when(b & ~a, "right")


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether two courses share a day; an open end reaches on, a missing start makes it unknown."""
    return F.when(a_start.isNull() | b_start.isNull(), None).otherwise(~F.coalesce(a_end < b_start, F.lit(False)) & ~F.coalesce(b_end < a_start, F.lit(False)))


def timing_applies(t: Column, a: tuple[Column, Column], b: tuple[Column, Column], candidate_side: Column) -> Column:
    """Whether a combination's timing concerns candidate course ``a`` and current course ``b`` (start, end)."""
    (a0, a1), (b0, b1) = a, b

    def gap(x1: Column, y0: Column) -> Column:
        """Hours between courses, of which only whole days count."""
        return F.greatest(F.datediff(y0, x1) - 1, F.lit(0)) * 24

    either = F.when(a1 < b0, gap(a1, b0) < t["hours"]).when(b1 < a0, gap(b1, a0) < t["hours"]).otherwise(F.lit(True))
    from_a = candidate_side == t["source_side"]
    s1, t0, t1 = F.when(from_a, a1).otherwise(b1), F.when(from_a, b0).otherwise(a0), F.when(from_a, b1).otherwise(a1)
    s0 = F.when(from_a, a0).otherwise(b0)
    washout = F.when(s1.isNull(), F.coalesce(t1 >= s0, F.lit(True))).otherwise((t0 > s1) & (gap(s1, t0) < t["hours"]))
    apart = F.when(t["kind"] == "minimum_separation", either).when(t["kind"] == "washout_after", washout).otherwise(F.lit(False))
    return F.coalesce(overlap(a0, a1, b0, b1), F.lit(True)) | (t["status"] == "not_evaluable") | apart


def duration_check(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, result, status) of a course against its duration rules (rule_value, days, review, unlinked; no rule: null rule_value)."""
    limit = rules.duration_days(F.col("rule_value"))
    folded = rows.withColumn("limit", limit).groupBy(*keys, "days", "unlinked").agg(
        F.count("rule_value").alias("n"), F.bool_or(F.coalesce("review", F.lit(False))).alias("review"),
        F.collect_set("limit.days").alias("limits"), F.count_if(F.col("rule_value").isNotNull() & F.col("limit.days").isNull()).alias("unread"),
    )
    result = (
        F.when((F.col("n") == 0) & ~F.col("unlinked"), "not_applicable")
        .when((F.col("n") == 0) | F.col("review") | F.col("days").isNull() | (F.col("days") <= 0), "not_evaluable")
        .when((F.col("unread") > 0) | (F.size("limits") != 1), "not_evaluable")
        .when(F.col("days") > F.col("limits")[0], "exceeded").otherwise("within")
    )
    return folded.select(*keys, result.alias("result"), F.when((F.col("n") > 0) & F.col("review"), "conditional").alias("status"))


def dose_check(rows: DataFrame) -> DataFrame:
    """``rows`` (rule_value, amount text, unit, frequency) with ``daily`` and ``result`` against the rule's threshold."""
    limit = rules.dose_threshold(F.col("rule_value"))
    counted = F.col("unit").isin("정", "캡슐", "포")
    comparable = F.col("limit.unit").eqNullSafe(F.col("unit"))
    daily = F.col("amount").try_cast("decimal(20,10)") * F.col("frequency").cast("decimal(10,0)")
    known = (F.col("limit.status") == "parsed") & F.col("amount").isNotNull() & (F.col("frequency") > 0) & comparable & (counted | (F.col("unit") == "mg"))
    out = rows.withColumn("limit", limit).withColumn("daily", F.when(F.coalesce(known, F.lit(False)), daily))
    result = F.when(F.col("rule_value").isNull(), "not_applicable").when(F.col("daily").isNull(), "not_evaluable").when(F.col("daily") > F.col("limit.value").try_cast("decimal(28,10)"), "exceeded").otherwise("within")
    return out.withColumn("result", result).drop("limit")


def display_state(findings: DataFrame, categories: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, category, state): of all findings of a category the one state that is shown, in fixed precedence.

    ``categories`` crosses persons with the fixed list of categories and says what is known of each: applicable,
    quantitative (a result or null), issue, verified, mapped.
    """
    hit = F.col("severity").isin("danger", "warning") & ~F.coalesce(F.col("status").isin("unknown", "conditional"), F.lit(False))
    conditional = F.coalesce(F.col("status") == "conditional", F.lit(False))
    folded = findings.groupBy(*keys, "category").agg(F.bool_or(hit).alias("hit"), F.bool_or(conditional).alias("conditional"), F.bool_or(~hit & ~conditional).alias("unresolved"))
    both = categories.join(folded, [*keys, "category"], "left").na.fill(False, ["hit", "conditional", "unresolved"])
    state = (
        F.when(F.col("hit"), "hit").when(~F.col("applicable"), "not_applicable").when(F.col("conditional"), "conditional")
        .when(F.col("quantitative") == "exceeded", "hit").when(F.col("quantitative") == "within", "clear").when(F.col("quantitative").isNotNull(), "unknown")
        .when(F.col("unresolved") | F.col("issue") | ~F.col("verified") | ~F.col("mapped"), "unknown").otherwise("clear")
    )
    return both.select(*keys, "category", state.alias("state"))


def daily_plan(medications: DataFrame, schedules: DataFrame, day: Column) -> DataFrame:
    """(med, slot, clock) wanted on a day: a slot for each clock time, else as many as the frequency says; none outside the course."""
    on = medications.filter((F.col("start") <= day) & F.coalesce(F.col("end") >= day, F.lit(True)) & ~F.col("prn"))
    timed = on.join(schedules, "med").withColumn("k", F.row_number().over(W.partitionBy("med").orderBy("clock", "schedule")))
    free = on.join(schedules.select("med").distinct(), "med", "left_anti").filter("frequency >= 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("frequency")))).withColumn("clock", F.lit(None).cast("string"))
    slot = F.concat(F.lit("slot:"), F.col("k").cast("string")).alias("slot")
    return timed.select("med", slot, "clock").unionByName(free.select("med", slot, "clock"))


def exactly_once(requests: DataFrame) -> DataFrame:
    """``requests`` (request, seq, payload) with ``outcome``: the first of an id counts, the same again is a repeat, another payload a conflict."""
    first = F.first("payload").over(W.partitionBy("request").orderBy("seq"))
    return requests.withColumn("outcome", F.when(F.row_number().over(W.partitionBy("request").orderBy("seq")) == 1, "accepted").when(F.col("payload") == first, "repeat").otherwise("conflict"))
