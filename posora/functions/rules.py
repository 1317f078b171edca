"""Rule texts and courses as values: thresholds, durations, grades, ages and progress.

Each function is one expression, so filters and projections over it stay in
generated code. What can't be read for certain gives null and a reason, never a guess.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from posora.functions.arrays import let
from posora.functions.names import clean

# Status names, units, words that make a threshold conditional, patterns and reasons.
STATUS_OF_CANCEL_NAME = {
    "정상": "active",
    "유효기간만료": "expired",
    "취하": "withdrawn",
    "폐업": "business_closed",
    "행정(취소)": "canceled",
    "취소": "canceled",
}
MG_OF_UNIT = {
    "마이크로그램": "0.001",
    "밀리그램": "1",
    "그램": "1000",
    "mcg": "0.001",
    "μg": "0.001",
    "ug": "0.001",
    "㎍": "0.001",
    "mg": "1",
    "g": "1000",
}
COUNT_UNIT = {"정": "정", "캡슐": "캡슐", "캡": "캡슐", "포": "포"}
CONDITIONAL_WORDS = [
    "/", "~", "또는", " or ", "상이", "조건", "환자별", "필요시", "필요 시", "범위", "성인", "소아", "신장", "간장애", "간 장애",
    "체중", "경우", "일때", "일 때", "이상", "이하", "미만", "초과",
]
NUMBER = r"(?<![\d.])([+]?(?:\d+(?:\.\d*)?|\.\d+))"
QUANTITY = NUMBER + r"\s*(마이크로그램|밀리그램|그램|mcg|μg|ug|㎍|mg|g|정|캡슐|캡|포)"
AGE_RULE = r"(\d+)\s*(세|개월|주|일)\s*(미만|이하|이상|초과)"
DOSE_MISSING = "dose criterion is missing"
DOSE_UNCLEAR = "dose criterion is not one unconditional numeric threshold"
DURATION_MONTHS = "month-based duration rule requires calendar-aware evaluation"
DURATION_UNCLEAR = "duration rule is missing, malformed, or ambiguous"


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def permit_status(cancel_name: Column, cancel_date: Column) -> Column:
    """Status of a permit; a name not known is inactive if a date of cancelling stands beside it."""
    other = F.when(clean(cancel_date).isNotNull(), "inactive_unknown").otherwise("unknown")
    return F.coalesce(_lookup(STATUS_OF_CANCEL_NAME, clean(cancel_name)), other)


def dose_threshold(c: Column) -> Column:
    """struct(value, unit, status, reason) of a daily maximum; masses in mg, exact, as decimal text.

    Amounts over 20 digits before the point or 10 after it aren't evaluable.
    """
    text = F.regexp_replace(clean(c.cast("string")), r"(?<=\d),(?=\d{3}(?!\d))", "")

    def found(t: Column) -> Column:
        numbers, quantities = F.regexp_count(t, F.lit(NUMBER)), F.regexp_count(t, F.lit("(?i)" + QUANTITY))
        number, unit = F.regexp_extract(t, "(?i)" + QUANTITY, 1), F.lower(F.regexp_extract(t, "(?i)" + QUANTITY, 2))
        return F.struct(t.alias("text"), F.lower(t).alias("low"), ((numbers == 1) & (quantities == 1)).alias("once"), number.alias("number"), unit.alias("unit"))

    def measured(v: Column) -> Column:
        conditional = F.lit(False)
        for word in CONDITIONAL_WORDS:
            conditional = conditional | v["low"].contains(word)
        decimals = F.length(F.regexp_extract(v["number"], r"\.(\d*)", 1))
        amount = let(decimals, lambda d: F.struct(d.alias("decimals"), F.when(d <= 10, v["number"].try_cast("decimal(30,10)")).alias("amount")))
        return F.struct(v["text"].alias("text"), v["unit"].alias("unit"), (v["once"] & ~conditional).alias("plain"), amount.alias("a"), _lookup(MG_OF_UNIT, v["unit"]).alias("factor"))

    def told(v: Column) -> Column:
        places = v["a"]["decimals"] + F.when(v["factor"] == "0.001", 3).otherwise(0)
        product = (v["a"]["amount"] * F.coalesce(v["factor"], F.lit("1")).cast("decimal(7,3)")).cast("decimal(38,13)").cast("string")
        value = let(product, lambda p: F.regexp_replace(F.substring(p, F.lit(1), F.length(p) - 13 + places), r"\.$", ""))
        good = v["plain"] & (v["a"]["amount"] > 0)
        return F.struct(
            F.when(good, value).alias("value"),
            F.when(good, F.when(v["factor"].isNotNull(), "mg").otherwise(_lookup(COUNT_UNIT, v["unit"]))).alias("unit"),
            F.when(good, "parsed").otherwise("not_evaluable").alias("status"),
            F.when(v["text"].isNull(), DOSE_MISSING).when(good, None).otherwise(DOSE_UNCLEAR).alias("reason"),
        )

    return let(let(let(text, found), measured), told)


def duration_days(c: Column) -> Column:
    """struct(days, reason) of a longest duration: a number of days or weeks; months depend on the calendar."""
    text = clean(c.cast("string"))
    amount = F.regexp_extract(text, "^([0-9]+)", 1).try_cast("bigint")
    unit = F.trim(F.regexp_replace(text, "^[0-9]+", ""))
    valid = amount > 0
    days = F.when(valid & unit.isin("", "일"), amount).when(valid & (unit == "주"), F.try_multiply(amount, F.lit(7)))
    reason = F.when(days.isNotNull(), None).when(valid & (unit == "개월"), DURATION_MONTHS).otherwise(DURATION_UNCLEAR)
    return F.struct(days.alias("days"), reason.alias("reason"))


def pregnancy_grade(c: Column) -> Column:
    """struct(grade, conditional): grade 1 or 2 of a text, and whether a condition in brackets follows it."""
    grade = F.nullif(F.regexp_extract(c, r"([12])\s*등급", 1), F.lit(""))
    return F.struct(grade.cast("int").alias("grade"), c.rlike(r"[12]\s*등급\s*\(").alias("conditional"))


def completed_years(birth: Column, as_of: Column) -> Column:
    """Age in whole years, 0 at least; a birthday of 29 February falls on the 28th in other years."""
    years = F.year(as_of) - F.year(birth)
    return F.greatest(years - (as_of < F.add_months(birth, years * 12)).cast("int"), F.lit(0))


def age_rule_applies(rule: Column, birth: Column, as_of: Column) -> Column:
    """Whether the one age rule of a text holds on a day; null without birth date or with another number of rules."""
    number = F.regexp_extract(rule, AGE_RULE, 1).try_cast("int")
    unit, op = F.regexp_extract(rule, AGE_RULE, 2), F.regexp_extract(rule, AGE_RULE, 3)

    def reaches(n: Column) -> Column:
        day = F.when(unit == "세", F.add_months(birth, n * 12)).when(unit == "개월", F.add_months(birth, n))
        return as_of >= day.when(unit == "주", F.date_add(birth, n * 7)).otherwise(F.date_add(birth, n))

    held = F.when(op == "미만", ~reaches(number)).when(op == "이하", ~reaches(number + 1))
    held = held.when(op == "이상", reaches(number)).when(op == "초과", reaches(number + 1))
    return F.when(F.regexp_count(rule, F.lit(AGE_RULE)) == 1, held)


# What a text must hold, and must not hold, for a form tag.
FORM_TAGS = [
    ("점안제", "점안", None), ("점이제", "점이", None), ("점비제", "점비", None), ("주사제", "주사|수액", None), ("흡입제", "흡입", None), ("크림제", "크림", None), ("연고제", "연고", None),
    ("로션제", "로션", None), ("겔제", "겔", None), ("외용액제", "피부액|외용액", None), ("좌제", "좌제", None), ("경피흡수제", "경피흡수", None), ("첩부제", "첩부|카타플라스마", None),
    ("구강정", "구강정", None), ("박칼정", "박칼정", None), ("설하정", "설하정", None), ("구강붕해필름", "구강붕해필름|구강용해필름", None), ("캡슐제", "캡슐", None),
    ("정제", r"필름코팅정|나정|서방정|장용정|구강붕해정|다층정|저작정|츄어블정|당의정|발포정|(?:^|[,\s(])정제(?:$|[,\s)])", None),
    ("시럽제", "시럽", None), ("과립제", "과립", None), ("세립제", "세립", None), ("산제", "산제", "외용|피부|주사"), ("액제", "액제", "점안|점이|점비|주사|피부|외용"),
    ("액제", "경구.*액|액.*경구", None), ("경구제", "경구", "액"),
]
AGE_REASONS = ["missing", "unread", "product_form", "structure", "segment_form", "not_one"]


def dosage_form_tags(c: Column) -> Column:
    """The forms that a text speaks of, as a set of tags; none for null."""
    text = F.trim(c)

    def tagged(v: Column) -> Column:
        has = [F.when(v.rlike("(?s)" + yes) & (~v.rlike(no) if no else F.lit(True)), tag) for tag, yes, no in FORM_TAGS]
        return F.array_distinct(F.array_compact(F.array(*has)))

    return F.coalesce(let(text, tagged), F.array().cast("array<string>"))


def age_rule_by_form(rule: Column, form: Column, birth: Column, as_of: Column) -> Column:
    """struct(applies, reason): whether a text's age rule holds on a day for a product of the given form.

    One rule holds for every form. Of several each stands after its forms and a colon, and the one whose forms the
    product has counts. Where that isn't clear, ``applies`` is null and ``reason`` says why: one of AGE_REASONS.
    """
    numbers, units, ops = (F.regexp_extract_all(rule, F.lit(AGE_RULE), i) for i in (1, 2, 3))
    before = F.split(rule, AGE_RULE, -1)

    def held(x: Column) -> Column:
        n, unit, op = x["n"].try_cast("int"), x["unit"], x["op"]

        def reaches(k: Column) -> Column:
            day = F.when(unit == "세", F.add_months(birth, k * 12)).when(unit == "개월", F.add_months(birth, k))
            return as_of >= day.when(unit == "주", F.date_add(birth, k * 7)).otherwise(F.date_add(birth, k))

        below = F.when(op == "미만", ~reaches(n)).when(op == "이하", ~reaches(n + 1))
        return below.when(op == "이상", reaches(n)).when(op == "초과", reaches(n + 1))

    def zipped(i: Column) -> Column:
        prefix = F.get(before, i)
        forms = F.when(prefix.contains(":"), F.regexp_replace(prefix, r"(?s):[^:]*$", ""))
        return F.struct(F.get(numbers, i).alias("n"), F.get(units, i).alias("unit"), F.get(ops, i).alias("op"), forms.alias("forms"))

    count = F.size(numbers)
    parts = F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), zipped))
    tagged = F.transform(parts, lambda p: F.struct(p["n"].alias("n"), p["unit"].alias("unit"), p["op"].alias("op"), p["forms"].alias("forms"), dosage_form_tags(p["forms"]).alias("tags")))

    def judged(v: Column) -> Column:
        own = F.filter(v["parts"], lambda p: F.arrays_overlap(p["tags"], v["product"]))

        def told(reason: str) -> Column:
            return F.struct(F.lit(None).cast("boolean").alias("applies"), F.lit(reason).alias("reason"))

        def holds(p: Column) -> Column:
            return let(held(p), lambda h: F.struct(h.alias("applies"), F.when(h.isNull(), "unread").alias("reason")))

        return (
            F.when(F.coalesce(F.trim(v["rule"]), F.lit("")) == "", told("missing"))
            .when(v["parts"].isNull(), told("unread"))
            .when(F.size(v["parts"]) == 1, holds(v["parts"][0]))
            .when(F.size(v["product"]) == 0, told("product_form"))
            .when(F.exists(v["parts"], lambda p: p["forms"].isNull()), told("structure"))
            .when(F.exists(v["parts"], lambda p: F.size(p["tags"]) == 0), told("segment_form"))
            .when(F.size(own) != 1, told("not_one"))
            .otherwise(holds(F.get(own, F.lit(0))))
        )

    return let(F.struct(rule.alias("rule"), tagged.alias("parts"), dosage_form_tags(form).alias("product")), judged)


def course_progress(start: Column, end: Column, day: Column) -> Column:
    """struct(status, total_days, current_day, remaining_days, progress_percent) of a course on a day.

    Null where a bound is missing; status `invalid` where the course ends before it starts. Percents round half to even.
    """
    total, gone, left = F.datediff(end, start) + 1, F.datediff(day, start) + 1, F.datediff(end, day)
    before, after = day < start, day > end
    status = F.when(total <= 0, "invalid").when(before, "upcoming").when(after, "completed").otherwise("active")
    return F.when(
        start.isNotNull() & end.isNotNull() & day.isNotNull(),
        F.struct(
            status.alias("status"),
            F.when(total > 0, total).alias("total_days"),
            F.when(total > 0, F.when(before, 0).when(after, total).otherwise(gone)).alias("current_day"),
            F.when(total > 0, F.when(before, total).when(after, 0).otherwise(left)).alias("remaining_days"),
            F.when(total > 0, F.when(before, 0).when(after, 100).otherwise(F.bround(gone * 100 / total, 0)).cast("int")).alias("progress_percent"),
        ),
    )
