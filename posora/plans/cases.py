"""The domain's plans, each with SQL that gives the same rows.

Queries run them over the domain's tables as they follow from the driver's (``derived``); the
tests also hold them against small reviewed tables. Plans and SQL are written apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from posora.functions import compositions, forms, names, rules
from posora.operators import graph, matching
from posora.plans import derived, drafts as draft_plans, linking, safety, substances

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: name: (plan, its SQL, the tables that it takes)
PLANS: dict[str, tuple[Callable[..., DataFrame], str, tuple[str, ...]]] = {}


def with_tables(body: str, ctes: list[str]) -> str:
    """``body`` with the tables in front."""
    body = body.strip()
    recursive, more = ("RECURSIVE ", body[15:]) if body.startswith("WITH RECURSIVE") else ("", body[5:] if body.startswith("WITH ") else None)
    return f"WITH {recursive}{', '.join(ctes)}" + (f", {more}" if more else f" {body}")


def case(sql: str, *used: str) -> Callable[[Callable], Callable]:
    def add(f: Callable) -> Callable:
        PLANS[f.__name__] = (f, sql, used)
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*(derived.table(spark, sf_dir, n) for n in used))
        ORACLE_SQL[f.__name__] = with_tables(sql, [derived.sql(n) for n in used])
        return f

    return add


SIGNED = """item_sigs AS (
    SELECT item_seq, category, to_json(list_sort(list_distinct(list(code) FILTER (code IS NOT NULL))))::VARCHAR AS signature, count(DISTINCT code) AS n_components,
           'permit_composition' AS method, CASE WHEN category IS NULL THEN 'permit_composition' ELSE 'category_permit_composition' END AS evidence
    FROM components GROUP BY item_seq, category HAVING count(code) > 0)"""
OPTIONS = """options AS (
    SELECT * EXCLUDE (rk) FROM (SELECT *, row_number() OVER (PARTITION BY id, signature ORDER BY rank DESC) AS rk FROM (
        SELECT r.id, '["' || m.canonical || '"]' AS signature, 1::BIGINT AS n_components, 'mfds_ingredient_code' AS method, 'mfds_code_scope' AS evidence, 0 AS rank
        FROM product_rules r JOIN code_map m ON m.category = r.category AND m.code = r.ingredient_code
        UNION ALL
        SELECT r.id, s.signature, s.n_components, s.method, s.evidence, CASE s.evidence WHEN 'permit_composition' THEN 1 ELSE 2 END
        FROM product_rules r JOIN item_sigs s ON s.item_seq = r.item_seq AND (s.category IS NULL OR s.category = r.category))) WHERE rk = 1)"""


def item_signatures(components: DataFrame) -> DataFrame:
    whole = linking.signatures(components, "item_seq", "category").filter("n_components > 0")
    return whole.withColumn("method", F.lit("permit_composition")).withColumn("evidence", F.when(F.col("category").isNull(), "permit_composition").otherwise("category_permit_composition"))


def criterion_signatures(criteria: DataFrame) -> DataFrame:
    keys = [c for c in criteria.columns if c != "code"]
    return linking.signatures(criteria, *keys).drop("n_components")


@case("WITH " + SIGNED + " SELECT item_seq, category, signature, n_components, evidence FROM item_sigs", "components")
def product_signatures(components):
    return item_signatures(components).drop("method")


@case("SELECT criterion_id, to_json(list_sort(list(DISTINCT code) FILTER (side = 'left')))::VARCHAR AS left_signature, to_json(list_sort(list(DISTINCT code) FILTER (side = 'right')))::VARCHAR AS right_signature FROM pairs GROUP BY criterion_id", "pairs")
def criterion_pair_signatures(pairs):
    signed = linking.signatures(pairs, "criterion_id", "side")
    return signed.groupBy("criterion_id").agg(*(F.max(F.when(F.col("side") == s, F.col("signature"))).alias(f"{s}_signature") for s in ("left", "right")))


@case("WITH " + SIGNED + ", " + OPTIONS + " SELECT id, signature, n_components, evidence FROM options", "product_rules", "code_map", "components")
def code_options(product_rules, code_map, components):
    return linking.code_options(product_rules, code_map, item_signatures(components)).drop("method")


def with_forms(product_rules: DataFrame, products: DataFrame) -> DataFrame:
    """Each rule with the permit forms of both its products: the product table is joined twice."""
    left = products.select("item_seq", "permit_form")
    right = products.select(F.col("item_seq").alias("paired_item"), F.col("permit_form").alias("paired_form"))
    return product_rules.join(left, "item_seq", "left").join(right, "paired_item", "left")


@case("SELECT r.id, p.permit_form, q.permit_form AS paired_form FROM product_rules r LEFT JOIN products p ON p.item_seq = r.item_seq LEFT JOIN products q ON q.item_seq = r.paired_item", "product_rules", "products")
def rules_with_both_forms(product_rules, products):
    return with_forms(product_rules, products).select("id", "permit_form", "paired_form")


SINGLE = """crits AS (
    SELECT criterion_id, category, effect, criterion_method, criterion_value, criterion_form, criterion_details, exact, to_json(list_sort(list(DISTINCT code)))::VARCHAR AS signature
    FROM criteria GROUP BY ALL), single AS (
    SELECT r.id, c.criterion_id, max(CASE WHEN o.method = 'permit_composition' AND o.n_components > 1 THEN 'permit_composition' ELSE c.criterion_method END) AS method
    FROM product_rules r LEFT JOIN products p ON p.item_seq = r.item_seq JOIN options o ON o.id = r.id
    JOIN crits c ON c.category = r.category AND c.signature = o.signature AND c.effect = CASE WHEN r.category = 'therapeutic_duplication_caution' THEN coalesce(r.effect_name, '') ELSE '' END
    WHERE r.category <> 'combination_contraindication'
      AND (NOT EXISTS (SELECT 1 FROM allowed a WHERE a.category = r.category AND a.ingredient_code = r.ingredient_code)
           OR EXISTS (SELECT 1 FROM allowed a WHERE a.category = r.category AND a.ingredient_code = r.ingredient_code AND a.item_seq = r.item_seq AND a.rule_value = c.criterion_value))
      AND (NOT c.exact OR o.evidence IN ('permit_composition', 'category_permit_composition', 'category_single_component_rule'))
      AND (c.criterion_form IS NULL OR c.criterion_form = coalesce(r.dosage_form, p.permit_form))
      AND (r.category <> 'dose_caution' OR r.details IS NULL OR replace(r.details, ' ', '') = replace(c.criterion_value, ' ', ''))
    GROUP BY r.id, c.criterion_id)"""


def single_classes(product_rules, products, code_map, components, criteria, allowed):
    """(id, class, method) of the rules' links, and (criterion_id, class)."""
    options = linking.code_options(product_rules, code_map, item_signatures(components))
    members, classes = linking.criterion_classes(criterion_signatures(criteria).drop("ingredient_code").distinct())
    return linking.single_class_links(with_forms(product_rules, products), options, classes, allowed), members


def linked_ids(product_rules, products, code_map, components, criteria, allowed):
    """The ids of linked rules, some repeated."""
    if not product_rules.groupBy("id").count().filter("count > 1").isEmpty():  # rules of one id share their options
        return single_classes(product_rules, products, code_map, components, criteria, allowed)[0].select("id")
    _, classes = linking.criterion_classes(criterion_signatures(criteria).drop("ingredient_code").distinct())
    return linking.linked_rules(product_rules, products, item_signatures(components), code_map, classes, allowed)


LINKING = ("product_rules", "products", "code_map", "components", "criteria", "allowed")


@case("WITH " + SIGNED + ", " + OPTIONS + ", " + SINGLE + " SELECT id, criterion_id, method FROM single", *LINKING)
def signature_links(*tables):
    links, members = single_classes(*tables)
    return links.join(members, "class").select("id", "criterion_id", "method")


@case("WITH " + SIGNED + ", " + OPTIONS + ", " + SINGLE + """, rest AS (
    SELECT r.id, c.criterion_id, trim(regexp_replace(c.criterion_value, '\\s+', ' ', 'g')) AS v, trim(regexp_replace(r.details, '\\s+', ' ', 'g')) = trim(regexp_replace(c.criterion_details, '\\s+', ' ', 'g')) AS told
    FROM product_rules r JOIN (SELECT DISTINCT ON (criterion_id) * FROM criteria) c ON c.category = r.category AND c.ingredient_code = r.ingredient_code
    WHERE r.category = 'age_contraindication' AND r.id NOT IN (SELECT id FROM single)
    ), judged AS (SELECT *, count(*) FILTER (told) OVER w AS n_told, count(DISTINCT v) FILTER (told) OVER w AS v_told, count(DISTINCT v) OVER w AS v_all FROM rest WINDOW w AS (PARTITION BY id))
    SELECT id, criterion_id, CASE WHEN v_told = 1 THEN 'mfds_details_exact' ELSE 'mfds_unanimous_value' END AS method FROM judged WHERE (v_told = 1 AND told) OR (v_told <> 1 AND v_all = 1)""", *LINKING)
def fallback_links(product_rules, products, code_map, components, criteria, allowed):
    linked, _ = single_classes(product_rules, products, code_map, components, criteria, allowed)
    return linking.fallback_links(product_rules, linked, criteria.drop("code").distinct(), ["age_contraindication"], allowed)


@case("WITH " + SIGNED + ", " + OPTIONS + """, roptions AS (
    SELECT r.id, '["' || m.canonical || '"]' AS signature, 1 AS n FROM product_rules r JOIN code_map m ON m.category = r.category AND m.code = r.paired_code
    UNION SELECT r.id, s.signature, s.n_components FROM product_rules r JOIN item_sigs s ON s.item_seq = r.paired_item AND s.category IS NULL
    ), psigs AS (SELECT criterion_id, to_json(list_sort(list(DISTINCT code) FILTER (side = 'left')))::VARCHAR AS l, to_json(list_sort(list(DISTINCT code) FILTER (side = 'right')))::VARCHAR AS r FROM pairs GROUP BY criterion_id
    ), met AS (SELECT r.id, p.criterion_id, CASE WHEN o.signature = p.l AND q.signature = p.r THEN 'forward' ELSE 'reverse' END AS orientation
    FROM product_rules r JOIN options o ON o.id = r.id JOIN roptions q ON q.id = r.id JOIN psigs p ON (o.signature = p.l AND q.signature = p.r) OR (o.signature = p.r AND q.signature = p.l)
    WHERE r.category = 'combination_contraindication')
    SELECT id, criterion_id, min(orientation) AS orientation FROM met GROUP BY id, criterion_id""", "product_rules", "products", "code_map", "components", "pairs")
def oriented_pair_links(product_rules, products, code_map, components, pairs):
    own, sigs = with_forms(product_rules, products), item_signatures(components)
    left, right = linking.code_options(own, code_map, sigs), linking.code_options(own, code_map, sigs, "paired_code", "paired_item")
    signed = criterion_pair_signatures(pairs).withColumn("criterion_method", F.lit("mfds_ingredient_code")).withColumn("criterion_form", F.lit(None).cast("string"))
    return linking.pair_links(own, left, right, signed).drop("method")


@case("WITH " + SIGNED + ", " + OPTIONS + ", " + SINGLE + """ SELECT r.id, r.category, l.criterion_id, c.criterion_value FROM product_rules r LEFT JOIN single l ON l.id = r.id LEFT JOIN (SELECT DISTINCT criterion_id, criterion_value FROM criteria) c ON c.criterion_id = l.criterion_id""", *LINKING)
def rule_criteria_view(product_rules, products, code_map, components, criteria, allowed):
    links, members = single_classes(product_rules, products, code_map, components, criteria, allowed)
    told = members.join(criteria.select("criterion_id", "criterion_value").distinct(), "criterion_id", "left")
    return product_rules.select("id", "category").join(links.select("id", "class"), "id", "left").join(told, "class", "left").select("id", "category", "criterion_id", "criterion_value")


@case("""SELECT category, count(*) AS n_rules, count(l.id) AS n_linked FROM product_rules r LEFT JOIN (SELECT DISTINCT id FROM single) l ON l.id = r.id GROUP BY category""".join(["WITH " + SIGNED + ", " + OPTIONS + ", " + SINGLE + " ", ""]), *LINKING)
def linking_coverage(product_rules, products, code_map, components, criteria, allowed):
    linked = linked_ids(product_rules, products, code_map, components, criteria, allowed).select("id", F.lit(1).alias("hit")).distinct()
    return product_rules.join(linked, "id", "left").groupBy("category").agg(F.count("*").alias("n_rules"), F.count("hit").alias("n_linked"))


PROFILE = "people p JOIN courses c ON c.person = p.person"


@case("""WITH days AS (SELECT p.person, p.birth_date, c.course, c.item_seq, unnest(CASE WHEN c."end" > c.start THEN [c.start, c."end"] ELSE [c.start] END) AS d FROM people p JOIN courses c ON c.person = p.person WHERE c.start IS NOT NULL
    ), parsed AS (SELECT *, len(regexp_extract_all(rule_value, '[0-9]+\\s*(세|개월|주|일)\\s*(미만|이하|이상|초과)')) AS k, TRY_CAST(regexp_extract(rule_value, '([0-9]+)\\s*(세|개월|주|일)\\s*(미만|이하|이상|초과)', 1) AS INTEGER) AS n,
        regexp_extract(rule_value, '([0-9]+)\\s*(세|개월|주|일)\\s*(미만|이하|이상|초과)', 2) AS unit, regexp_extract(rule_value, '([0-9]+)\\s*(세|개월|주|일)\\s*(미만|이하|이상|초과)', 3) AS op FROM age_rules
    ), told AS (SELECT d.course, r.rule_id, r.k, r.op, d.d, CASE unit WHEN '세' THEN birth_date + to_years(m) WHEN '개월' THEN birth_date + to_months(m) WHEN '주' THEN birth_date + to_days(7 * m) ELSE birth_date + to_days(m) END AS bound
        FROM days d JOIN (SELECT *, CASE WHEN op IN ('이하', '초과') THEN n + 1 ELSE n END AS m FROM parsed) r ON r.item_seq = d.item_seq
    ), held AS (SELECT course, rule_id, CASE WHEN k = 1 THEN CASE WHEN op IN ('미만', '이하') THEN d < bound ELSE d >= bound END END AS held FROM told)
    SELECT course, rule_id, CASE WHEN bool_or(held) THEN 'hit' WHEN count(held) < count(*) THEN 'unknown' ELSE 'clear' END AS outcome FROM held GROUP BY course, rule_id""", "people", "courses", "age_rules")
def age_contraindication(people, courses, age_rules):
    rows = people.join(courses.filter("start IS NOT NULL"), "person").join(age_rules, "item_seq")
    rows = rows.withColumn("dates", safety.evaluation_dates(F.col("start"), F.col("end"), F.lit(None).cast("date")))
    return safety.age_risks(rows).select("course", "rule_id", "outcome")


@case("""WITH g AS (SELECT DISTINCT p.person, r.item_seq, r.rule_id, regexp_extract(r.rule_value, '([12])\\s*등급', 1) AS grade, regexp_matches(r.rule_value, '[12]\\s*등급\\s*\\(') AS cond
    FROM people p JOIN courses c ON c.person = p.person JOIN grades r ON r.item_seq = c.item_seq WHERE p.pregnancy_status = 'pregnant'), s AS (SELECT *, count(DISTINCT grade) OVER (PARTITION BY person, item_seq) AS n, min(rule_id) OVER (PARTITION BY person, item_seq) AS f FROM g)
    SELECT person, item_seq, rule_id, CASE WHEN n > 1 THEN 'unknown' WHEN cond THEN 'conditional' ELSE 'hit' END AS outcome FROM s WHERE n = 1 OR rule_id = f""", "people", "courses", "grades")
def pregnancy_risks(people, courses, grades):
    taken = people.filter("pregnancy_status = 'pregnant'").join(courses.select("person", "item_seq").distinct(), "person")
    return safety.pregnancy_risks(grades.join(taken, "item_seq"))


@case("""SELECT p.person, c.course FROM people p JOIN courses c ON c.person = p.person WHERE greatest(c.start, coalesce(c."end", c.start)) >= p.birth_date + INTERVAL 65 YEAR""", "people", "courses")
def elderly_caution(people, courses):
    rows = people.join(courses, "person").withColumn("dates", safety.evaluation_dates(F.col("start"), F.col("end"), F.lit(None).cast("date")))
    return rows.filter(F.exists("dates", lambda d: rules.completed_years(F.col("birth_date"), d) >= safety.SUPPORT_AGE)).select("person", "course")


@case("""SELECT criterion_id, CASE WHEN bool_or(criterion_method = 'mfds_composition') OVER (PARTITION BY category) THEN 'conditional' ELSE 'plain' END AS status FROM (SELECT DISTINCT criterion_id, category, criterion_method FROM criteria)""", "criteria")
def category_escalation(criteria):
    own = criteria.select("criterion_id", "category", "criterion_method").distinct()
    any_ = F.max((F.col("criterion_method") == "mfds_composition").cast("int")).over(W.partitionBy("category"))
    return own.select("criterion_id", F.when(any_ == 1, "conditional").otherwise("plain").alias("status"))


TIMED = """read AS (
    SELECT *, trim(regexp_replace(coalesce(details, ''), '\\s+', ' ', 'g')) AS t FROM windows
    ), cut AS (SELECT *, TRY_CAST(regexp_extract(t, '([0-9]+)\\s*시간\\s*이내', 1) AS INTEGER) AS within, TRY_CAST(regexp_extract(t, '^(.*?)(투여|복용)\\s*(중단|종료)\\s*후\\s*([0-9]+)\\s*(시간|일|주)', 4) AS INTEGER) AS after,
        regexp_extract(t, '^(.*?)(투여|복용)\\s*(중단|종료)\\s*후\\s*([0-9]+)\\s*(시간|일|주)', 5) AS unit, regexp_extract_all(lower(regexp_extract(t, '^(.*?)(투여|복용)\\s*(중단|종료)\\s*후\\s*([0-9]+)\\s*(시간|일|주)', 1)), '[0-9a-z가-힣]+') AS s,
        regexp_extract_all(lower(coalesce(left_name, '')), '[0-9a-z가-힣]+') AS l, regexp_extract_all(lower(coalesce(right_name, '')), '[0-9a-z가-힣]+') AS r FROM read
    ), sides AS (SELECT *, len(s) > 0 AND len(l) > 0 AND (list_has_all(l, s) OR list_has_all(s, l)) AS by_left, len(s) > 0 AND len(r) > 0 AND (list_has_all(r, s) OR list_has_all(s, r)) AS by_right FROM cut
    ), timed AS (SELECT rule_id, item_seq, CASE WHEN evaluator = 'minimum_separation' THEN 'minimum_separation' WHEN mode = 'runtime_evaluable' AND evaluator NOT IN ('minimum_separation', 'excluded_route') THEN 'unknown_contract_evaluator'
        WHEN mode = 'review_required' THEN 'review_required_condition' WHEN within IS NOT NULL THEN 'minimum_separation' WHEN after IS NOT NULL AND by_left <> by_right THEN 'washout_after'
        WHEN after IS NOT NULL OR regexp_matches(t, '(중단|종료) ?후') THEN 'post_course_restriction' ELSE 'course_overlap' END AS kind,
        CASE WHEN evaluator = 'minimum_separation' THEN coalesce(hours, 0) WHEN mode IS NOT NULL THEN NULL WHEN within IS NOT NULL THEN within WHEN after IS NOT NULL AND by_left <> by_right THEN after * CASE unit WHEN '주' THEN 168 WHEN '일' THEN 24 ELSE 1 END END AS hours,
        CASE WHEN evaluator IS NULL AND mode IS NULL AND within IS NULL AND after IS NOT NULL AND by_left <> by_right THEN CASE WHEN by_left THEN 'left' ELSE 'right' END END AS source_side FROM sides)"""


@case("WITH " + TIMED + """ SELECT rule_id, CASE WHEN kind IN ('minimum_separation', 'washout_after') THEN 'structured' WHEN kind = 'course_overlap' THEN 'default' ELSE 'not_evaluable' END AS status, kind, hours, source_side FROM timed""", "windows")
def interaction_timing(windows):
    t = safety.timing(*(F.col(c) for c in ("details", "left_name", "right_name", "evaluator", "hours", "mode")))
    return windows.select("rule_id", t.alias("t")).select("rule_id", "t.*")


PAIRED = """pairs_of AS (SELECT a.person, a.item_seq, a.course AS a, b.course AS b, a.start AS a0, a."end" AS a1, b.start AS b0, b."end" AS b1 FROM courses a JOIN courses b ON a.person = b.person AND a.side = 'left' AND b.side = 'right')"""


@case("WITH " + PAIRED + " SELECT a, b, CASE WHEN a0 IS NULL OR b0 IS NULL THEN NULL ELSE a0 <= coalesce(b1, DATE '9999-12-31') AND b0 <= coalesce(a1, DATE '9999-12-31') END AS overlaps FROM pairs_of", "courses")
def course_overlap_three_valued(courses):
    x, y = course_pairs(courses)
    return x.join(y, "person").select("a", "b", safety.overlap(F.col("a0"), F.col("a1"), F.col("b0"), F.col("b1")).alias("overlaps"))


def course_pairs(courses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Left courses with their item, and right ones."""
    return tuple(courses.filter(F.col("side") == s).select("person", *(["item_seq"] if s == "left" else []), F.col("course").alias(k), F.col("start").alias(k + "0"), F.col("end").alias(k + "1")) for s, k in (("left", "a"), ("right", "b")))


@case("WITH " + PAIRED + ", " + TIMED + """, x AS (SELECT p.*, t.rule_id, t.kind, t.hours, t.source_side, a0 IS NULL OR b0 IS NULL OR (a0 <= coalesce(b1, DATE '9999-12-31') AND b0 <= coalesce(a1, DATE '9999-12-31')) AS o FROM pairs_of p JOIN timed t ON t.item_seq = p.item_seq),
    y AS (SELECT *, CASE WHEN source_side = 'left' THEN a0 ELSE b0 END AS s0, CASE WHEN source_side = 'left' THEN a1 ELSE b1 END AS s1, CASE WHEN source_side = 'left' THEN b0 ELSE a0 END AS t0, CASE WHEN source_side = 'left' THEN b1 ELSE a1 END AS t1 FROM x)
    SELECT a, b, rule_id, o OR CASE kind WHEN 'course_overlap' THEN false WHEN 'minimum_separation' THEN CASE WHEN a1 < b0 THEN greatest(b0 - a1 - 1, 0) * 24 < hours WHEN b1 < a0 THEN greatest(a0 - b1 - 1, 0) * 24 < hours ELSE true END
        WHEN 'washout_after' THEN CASE WHEN s1 IS NULL THEN coalesce(t1 >= s0, true) ELSE t0 > s1 AND greatest(t0 - s1 - 1, 0) * 24 < hours END ELSE true END AS applies FROM y""", "courses", "windows")
def timing_applies(courses, windows):
    x, y = course_pairs(courses)
    t = safety.timing(*(F.col(c) for c in ("details", "left_name", "right_name", "evaluator", "hours", "mode")))
    rows = x.join(y, "person").join(windows.select("rule_id", "item_seq", t.alias("t")), "item_seq")
    return rows.select("a", "b", "rule_id", safety.timing_applies(F.col("t"), (F.col("a0"), F.col("a1")), (F.col("b0"), F.col("b1")), F.lit("left")).alias("applies"))


@case("""SELECT a.person, a.course AS a, b.course AS b, g.grp, bool_or(g.review OR h.review OR (coalesce(g.excluded_route, '') = 'oral' AND g.form IS NULL) OR (coalesce(h.excluded_route, '') = 'oral' AND h.form IS NULL)) AS review
    FROM courses a JOIN courses b ON a.person = b.person AND a.course < b.course JOIN groups g ON g.item_seq = a.item_seq JOIN groups h ON h.item_seq = b.item_seq AND h.grp = g.grp
    WHERE NOT coalesce(g.excluded_route = 'oral' AND g.form IN ('정제', '캡슐제'), false) AND NOT coalesce(h.excluded_route = 'oral' AND h.form IN ('정제', '캡슐제'), false) GROUP BY ALL""", "courses", "groups")
def therapeutic_duplication(courses, groups):
    route = forms.administration_route(F.array_compact(F.array("form")))
    own = groups.withColumn("route", route).filter(~F.coalesce(F.col("excluded_route") == F.col("route"), F.lit(False)))
    own = own.select("item_seq", "grp", (F.col("review") | (F.col("excluded_route").isNotNull() & (F.col("route") == "unknown"))).alias("review"))
    x = courses.join(own, "item_seq").select("person", "grp", F.col("course").alias("a"), F.col("review").alias("ra"))
    y = courses.join(own, "item_seq").select("person", "grp", F.col("course").alias("b"), F.col("review").alias("rb"))
    return x.join(y, ["person", "grp"]).filter("a < b").groupBy("person", "a", "b", "grp").agg(F.bool_or(F.col("ra") | F.col("rb")).alias("review"))


@case("WITH " + SIGNED + ", " + OPTIONS + ", " + SINGLE + """ SELECT id, item_seq, true AS linked FROM product_rules WHERE id IN (SELECT id FROM single)
    UNION ALL SELECT id, item_seq, false FROM product_rules WHERE category = 'therapeutic_duplication_caution' AND effect_name IS NOT NULL""", *LINKING)
def resolved_rows(product_rules, products, code_map, components, criteria, allowed):
    linked = product_rules.join(linked_ids(product_rules, products, code_map, components, criteria, allowed), "id", "left_semi").select("id", "item_seq", F.lit(True).alias("linked"))
    direct = product_rules.filter((F.col("category") == linking.DUPLICATION) & F.col("effect_name").isNotNull())
    return linked.unionByName(direct.select("id", "item_seq", F.lit(False).alias("linked")))


@case("""WITH p AS (SELECT *, CASE WHEN regexp_full_match(rule_value, '0*[1-9][0-9]*(일|주)?') THEN CAST(regexp_extract(rule_value, '[0-9]+') AS BIGINT) * CASE WHEN rule_value LIKE '%주' THEN 7 ELSE 1 END END AS lim FROM durations),
    g AS (SELECT draft, any_value(days) AS days, unlinked, count(rule_value) AS n, bool_or(coalesce(review, false)) AS review, count(DISTINCT lim) AS kinds, max(lim) AS lim, count(*) FILTER (rule_value IS NOT NULL AND lim IS NULL) AS unread FROM p GROUP BY draft, unlinked)
    SELECT draft, CASE WHEN n = 0 AND NOT unlinked THEN 'not_applicable' WHEN n = 0 OR review OR days IS NULL OR days <= 0 OR unread > 0 OR kinds <> 1 THEN 'not_evaluable' WHEN days > lim THEN 'exceeded' ELSE 'within' END AS result,
    CASE WHEN n > 0 AND review THEN 'conditional' END AS status FROM g""", "durations")
def duration_check(durations):
    return safety.duration_check(durations, ["draft"])


LIMITS = """limits AS (
    SELECT *, regexp_extract(plain, '([0-9.]+)(mg|g|마이크로그램|정|캡슐)', 1) AS number, regexp_extract(plain, '([0-9.]+)(mg|g|마이크로그램|정|캡슐)', 2) AS of FROM (SELECT *, replace(rule_value, ',', '') AS plain FROM doses)
    ), dosed AS (SELECT *, CASE WHEN plain NOT LIKE '%또는%' THEN CAST(number AS DECIMAL(18, 6)) * CASE of WHEN 'g' THEN 1000 WHEN '마이크로그램' THEN 0.001 ELSE 1 END END AS most, CASE WHEN of IN ('정', '캡슐') THEN of ELSE 'mg' END AS most_unit FROM limits
    ), checked AS (SELECT *, CASE WHEN rule_value IS NULL THEN 'not_applicable' WHEN most IS NULL OR amount IS NULL OR coalesce(frequency, 0) <= 0 OR unit IS DISTINCT FROM most_unit THEN 'not_evaluable'
        WHEN CAST(amount AS DECIMAL(18, 6)) * frequency > most THEN 'exceeded' ELSE 'within' END AS result FROM dosed)"""


@case("WITH " + LIMITS + " SELECT draft, result FROM checked", "doses")
def dose_check(doses):
    return safety.dose_check(doses).select("draft", "result")


@case("WITH " + LIMITS + """ SELECT draft, d.person, CASE WHEN birth_date > DATE '2024-12-31' - INTERVAL 19 YEAR AND result IN ('within', 'not_applicable') THEN 'not_evaluable' ELSE result END AS result FROM checked d JOIN people p ON p.person = d.person""", "doses", "people")
def pediatric_override(doses, people):
    rows = safety.dose_check(doses).join(people, "person")
    young = rules.completed_years(F.col("birth_date"), F.lit("2024-12-31").cast("date")) < safety.ADULT_AGE
    return rows.select("draft", "person", F.when(young & F.col("result").isin("within", "not_applicable"), "not_evaluable").otherwise(F.col("result")).alias("result"))


@case("""SELECT remark_id, CASE WHEN mode = 'informational' THEN 'informational' ELSE 'applicability_condition' END AS role, CASE mode WHEN 'informational' THEN 'display_only' WHEN 'review_required' THEN 'opaque_condition' WHEN 'interaction_window' THEN 'minimum_separation' ELSE 'excluded_route' END AS evaluator,
    CASE WHEN mode = 'interaction_window' THEN CAST(value AS INTEGER) END AS hours, CASE WHEN mode = 'form_exclusion' THEN value END AS route FROM notes WHERE mode <> 'composition_scope'""", "notes")
def semantic_facts(notes):
    evaluator = F.when(F.col("mode") == "informational", "display_only").when(F.col("mode") == "review_required", "opaque_condition").when(F.col("mode") == "interaction_window", "minimum_separation").when(F.col("mode") == "form_exclusion", "excluded_route")
    role = F.when(F.col("mode") == "informational", "informational").otherwise("applicability_condition")
    return notes.filter("mode <> 'composition_scope'").select("remark_id", role.alias("role"), evaluator.alias("evaluator"), F.when(F.col("mode") == "interaction_window", F.col("value").try_cast("int")).alias("hours"), F.when(F.col("mode") == "form_exclusion", F.col("value")).alias("route"))


@case("""SELECT criterion_id, CASE WHEN role NOT IN ('informational', 'applicability_condition') OR (evaluator = 'minimum_separation' AND coalesce(hours, 0) <= 0) THEN 'review_required' ELSE evaluator END AS evaluator, expected - count(*) OVER (PARTITION BY criterion_id) AS missing FROM facts""", "facts")
def semantic_validation(facts):
    valid = F.col("role").isin("informational", "applicability_condition") & ((F.col("evaluator") != "minimum_separation") | (F.coalesce("hours", F.lit(0)) > 0))
    return facts.select("criterion_id", F.when(valid, F.col("evaluator")).otherwise("review_required").alias("evaluator"), (F.col("expected") - F.count("*").over(W.partitionBy("criterion_id"))).alias("missing"))


@case("""SELECT person, CASE WHEN bool_and(verified AND mapped AND NOT issue) THEN 'complete' ELSE 'limited' END AS coverage, count(*) FILTER (NOT verified) AS dataset_gaps, count(*) FILTER (NOT mapped) AS mapping_gaps FROM known GROUP BY person""", "known")
def coverage_summary(known):
    whole = F.bool_and(F.col("verified") & F.col("mapped") & ~F.col("issue"))
    return known.groupBy("person").agg(F.when(whole, "complete").otherwise("limited").alias("coverage"), F.count_if(~F.col("verified")).alias("dataset_gaps"), F.count_if(~F.col("mapped")).alias("mapping_gaps"))


@case("""SELECT k.person, k.category, CASE WHEN coalesce(f.hit, false) THEN 'hit' WHEN NOT applicable THEN 'not_applicable' WHEN coalesce(f.cond, false) THEN 'conditional' WHEN quantitative = 'exceeded' THEN 'hit' WHEN quantitative = 'within' THEN 'clear'
    WHEN quantitative IS NOT NULL OR coalesce(f.unres, false) OR issue OR NOT verified OR NOT mapped THEN 'unknown' ELSE 'clear' END AS state
    FROM known k LEFT JOIN (SELECT person, category, bool_or(severity IN ('danger', 'warning') AND status IS NULL) AS hit, bool_or(coalesce(status, '') = 'conditional') AS cond, bool_or(coalesce(status, '') = 'unknown' OR (severity = 'info' AND status IS NULL)) AS unres FROM findings GROUP BY person, category) f
    ON f.person = k.person AND f.category = k.category""", "findings", "known")
def display_fold(findings, known):
    return safety.display_state(findings, known, ["person"])


@case("""SELECT k.person, k.category FROM known k WHERE NOT EXISTS (SELECT 1 FROM findings f WHERE f.person = k.person AND f.category = k.category) AND applicable""", "known", "findings")
def flag_fallback(known, findings):
    return known.filter("applicable").join(findings, ["person", "category"], "left_anti").select("person", "category")


@case("""SELECT person, sha256(string_agg(category || ':' || severity || ':' || coalesce(status, ''), '|' ORDER BY category, severity, coalesce(status, ''))) AS token FROM findings GROUP BY person""", "findings")
def warning_token(findings):
    part = F.concat_ws(":", "category", "severity", F.coalesce("status", F.lit("")))
    return findings.groupBy("person").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("category", "severity", F.coalesce("status", F.lit("")), part.alias("part")))), lambda x: x["part"]), "|"), 256).alias("token"))


PLAN = """plan AS (SELECT s.med, 'slot:' || row_number() OVER (PARTITION BY s.med ORDER BY clock, schedule) AS slot, clock FROM schedules s JOIN medications m ON m.med = s.med WHERE NOT prn AND start <= DATE '2024-01-10' AND coalesce("end" >= DATE '2024-01-10', true)
    UNION ALL SELECT med, 'slot:' || k, NULL FROM medications m, range(1, 100) r(k) WHERE k <= frequency AND NOT prn AND start <= DATE '2024-01-10' AND coalesce("end" >= DATE '2024-01-10', true) AND med NOT IN (SELECT med FROM schedules))"""


@case("WITH " + PLAN + " SELECT * FROM plan", "medications", "schedules")
def daily_plan(medications, schedules):
    return safety.daily_plan(medications, schedules, F.lit("2024-01-10").cast("date"))


@case("WITH " + PLAN + """ SELECT coalesce(p.med, i.med) AS med, coalesce(p.slot, i.slot) AS slot, CASE WHEN i.med IS NULL THEN 'insert' WHEN i.state <> 'planned' THEN 'keep' WHEN p.med IS NULL THEN 'delete' WHEN p.clock IS DISTINCT FROM i.clock THEN 'update' ELSE 'keep' END AS action
    FROM plan p FULL JOIN instances i ON i.med = p.med AND i.slot = p.slot""", "medications", "schedules", "instances")
def plan_reconcile(medications, schedules, instances):
    plan = daily_plan(medications, schedules).select("med", "slot", F.col("clock").alias("wanted"), F.lit(True).alias("p"))
    both = plan.join(instances, ["med", "slot"], "full_outer")
    action = F.when(F.col("state").isNull(), "insert").when(F.col("state") != "planned", "keep").when(F.col("p").isNull(), "delete").when(~F.col("wanted").eqNullSafe(F.col("clock")), "update").otherwise("keep")
    return both.select("med", "slot", action.alias("action"))


@case("""SELECT seq, CASE WHEN row_number() OVER w = 1 THEN 'accepted' WHEN payload = first_value(payload) OVER w THEN 'repeat' ELSE 'conflict' END AS outcome FROM requests WINDOW w AS (PARTITION BY request ORDER BY seq)""", "requests")
def prn_exactly_once(requests):
    return safety.exactly_once(requests).select("seq", "outcome")


@case("""SELECT seq, CAST(CAST(substr(replace("at", 'T', ' '), 1, 19) AS TIMESTAMP) + CASE WHEN "at" LIKE '%Z' THEN INTERVAL 9 HOUR ELSE INTERVAL 0 HOUR END AS DATE)::VARCHAR AS day FROM requests""", "requests")
def korean_dates(requests):
    zoned = F.col("at").rlike(r"(Z|[+-]\d\d:\d\d)$")
    text = F.when(zoned, F.col("at")).otherwise(F.concat("at", F.lit("+09:00")))
    seconds = F.unix_timestamp(F.to_timestamp(text)) + 9 * 3600
    return requests.select("seq", F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int")).cast("string").alias("day"))


@case("""SELECT med FROM medications WHERE active AND start <= DATE '2024-01-10' AND coalesce("end" >= DATE '2024-01-10', true)""", "medications")
def active_courses(medications):
    day = F.lit("2024-01-10").cast("date")
    return medications.filter(F.col("active") & (F.coalesce("start", day) <= day) & (F.coalesce("end", day) >= day)).select("med")


@case("""SELECT m.med, p.item_seq, p.permit_status = 'active' AND (m."end" IS NOT NULL OR m.prn) AS allowed FROM medications m JOIN courses c ON c.person = m.person JOIN products p ON p.item_seq = c.item_seq""", "medications", "courses", "products")
def registration_gate(medications, courses, products):
    rows = medications.select("med", "person", F.col("end").alias("last"), "prn").join(courses, "person").join(products, "item_seq")
    return rows.select("med", "item_seq", ((F.col("permit_status") == "active") & (F.col("last").isNotNull() | F.col("prn"))).alias("allowed"))


@case("""SELECT person, CASE WHEN sex = 'male' THEN 'not_applicable' ELSE coalesce(pregnancy_status, 'unknown') END AS pregnancy, sex <> 'male' AND (pregnancy_status IS NULL OR lactation IS NULL) AS needs_review FROM people""", "people")
def profile_review(people):
    male = F.col("sex") == "male"
    return people.select("person", F.when(male, "not_applicable").otherwise(F.coalesce("pregnancy_status", F.lit("unknown"))).alias("pregnancy"), (~male & (F.col("pregnancy_status").isNull() | F.col("lactation").isNull())).alias("needs_review"))


@case("""SELECT seq, del_yn = '정상' AS kept, del_yn NOT IN ('정상', '삭제') AS invalid, coalesce(name_type IN ('of', 'cn', 'sys'), false) AS trusted, value IS NOT NULL AND trim(value) <> '' AS filled FROM raw_criteria""", "raw_criteria")
def source_row_guards(raw_criteria):
    return raw_criteria.select("seq", (F.col("del_yn") == "정상").alias("kept"), (~F.col("del_yn").isin("정상", "삭제")).alias("invalid"), F.coalesce(F.col("name_type").isin("of", "cn", "sys"), F.lit(False)).alias("trusted"), names.clean(F.col("value")).isNotNull().alias("filled"))


@case("""SELECT p.criterion_id, p.left_code AS code FROM (SELECT a.criterion_id, a.code AS left_code, b.code AS right_code FROM pairs a JOIN pairs b ON a.criterion_id = b.criterion_id AND a.side = 'left' AND b.side = 'right') p
    WHERE (left_code = 'D3' AND right_code = 'D1') OR (left_code = 'D1' AND right_code = 'D3')""", "pairs")
def symmetric_pair_lookup(pairs):
    left, right = (pairs.filter(F.col("side") == s).select("criterion_id", F.col("code").alias(s[0])) for s in ("left", "right"))
    both = left.join(right, "criterion_id").withColumn("lo", F.least("l", "r")).withColumn("hi", F.greatest("l", "r"))
    return both.filter("lo = 'D1' AND hi = 'D3'").select("criterion_id", F.col("l").alias("code"))


@case("""SELECT item_seq FROM products p WHERE EXISTS (SELECT 1 FROM (SELECT item_seq FROM product_rules UNION ALL SELECT paired_item FROM product_rules UNION ALL SELECT item_seq FROM components) x WHERE x.item_seq = p.item_seq)""", "products", "product_rules", "components")
def exists_in_any(products, product_rules, components):
    used = product_rules.select("item_seq").union(product_rules.select("paired_item")).union(components.select("item_seq"))
    return products.join(used, "item_seq", "left_semi").select("item_seq")


@case("""SELECT item_seq, permit_form AS form FROM products WHERE permit_form IS NOT NULL UNION SELECT item_seq, dosage_form FROM product_rules WHERE dosage_form IS NOT NULL""", "products", "product_rules")
def forms_union(products, product_rules):
    return products.select("item_seq", F.col("permit_form").alias("form")).union(product_rules.select("item_seq", "dosage_form")).filter("form IS NOT NULL").distinct()


@case("""SELECT CASE WHEN a.code IS NULL THEN 'criteria' WHEN b.code IS NULL THEN 'products' ELSE 'both' END AS side, coalesce(a.code, b.code) AS code FROM (SELECT DISTINCT code FROM components WHERE code IS NOT NULL) a FULL JOIN (SELECT DISTINCT code FROM criteria) b ON a.code = b.code""", "components", "criteria")
def code_set_difference(components, criteria):
    a, b = components.filter("code IS NOT NULL").select("code", F.lit(1).alias("a")).distinct(), criteria.select("code", F.lit(1).alias("b")).distinct()
    return a.join(b, "code", "full_outer").select(F.when(F.col("a").isNull(), "criteria").when(F.col("b").isNull(), "products").otherwise("both").alias("side"), "code")


@case("""SELECT m.med, min(s.clock) AS first_clock, row_number() OVER (PARTITION BY m.person ORDER BY min(s.clock) NULLS LAST, m.seq) AS place FROM medications m LEFT JOIN schedules s ON s.med = m.med WHERE m.active GROUP BY m.med, m.person, m.seq""", "medications", "schedules")
def medications_by_schedule(medications, schedules):
    first = schedules.groupBy("med").agg(F.min("clock").alias("first_clock"))
    place = F.row_number().over(W.partitionBy("person").orderBy(F.col("first_clock").asc_nulls_last(), "seq"))
    return medications.filter("active").join(first, "med", "left").select("med", "first_clock", place.alias("place"))


@case("""SELECT item_seq, CASE permit_status WHEN 'active' THEN 1 WHEN 'withdrawn' THEN 2 WHEN 'expired' THEN 3 ELSE 99 END AS status_code FROM products""", "products")
def enum_encoding(products):
    return products.select("item_seq", F.when(F.col("permit_status") == "active", 1).when(F.col("permit_status") == "withdrawn", 2).when(F.col("permit_status") == "expired", 3).otherwise(99).alias("status_code"))


@case("""SELECT (SELECT count(*) FROM product_rules r WHERE NOT EXISTS (SELECT 1 FROM products p WHERE p.item_seq = r.item_seq)) AS orphan_rules, (SELECT count(*) FROM (SELECT criterion_id FROM criteria GROUP BY criterion_id HAVING count(DISTINCT category) > 1)) AS mixed_criteria,
    (SELECT count(*) FROM components WHERE code IS NULL) AS null_codes, (SELECT count(*) FROM products WHERE permit_form IS NULL) AS no_form""", "product_rules", "products", "criteria", "components")
def canonical_checks(product_rules, products, criteria, components):
    one = product_rules.join(products, "item_seq", "left_anti").agg(F.count("*").alias("orphan_rules"))
    two = criteria.groupBy("criterion_id").agg(F.count_distinct("category").alias("k")).agg(F.count_if(F.col("k") > 1).alias("mixed_criteria"))
    three, four = components.agg(F.count_if(F.col("code").isNull()).alias("null_codes")), products.agg(F.count_if(F.col("permit_form").isNull()).alias("no_form"))
    return one.join(two, F.lit(True)).join(three, F.lit(True)).join(four, F.lit(True))


@case("""WITH RECURSIVE both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), reach AS (SELECT a AS id, a AS other FROM both_ways UNION SELECT r.id, e.b FROM reach r JOIN both_ways e ON e.a = r.other)
    SELECT id, min(other) AS component FROM reach GROUP BY id""", "edges")
def connected_components(edges):
    return graph.components(edges)


@case("SELECT k, nullif(trim(text, E' \\t\\n'), '') AS value FROM raw_texts", "raw_texts")
def text_cleaned(raw_texts):
    return raw_texts.select("k", names.clean(F.col("text")).alias("value"))


@case("""SELECT k, CASE WHEN length(d) = 8 THEN d[1:4] || '-' || d[5:6] || '-' || d[7:8] ELSE nullif(trim(text), '') END AS value FROM (SELECT *, regexp_replace(text, '[^0-9]', '', 'g') AS d FROM date_lines)""", "date_lines")
def date_texts(date_lines):
    return date_lines.select("k", names.date_text(F.col("text")).alias("value"))


@case("""SELECT k, coalesce(s.status, CASE WHEN trim(coalesce(day, '')) <> '' THEN 'inactive_unknown' ELSE 'unknown' END) AS status FROM status_lines t
    LEFT JOIN (VALUES ('정상', 'active'), ('유효기간만료', 'expired'), ('취하', 'withdrawn'), ('폐업', 'business_closed'), ('행정(취소)', 'canceled'), ('취소', 'canceled')) s(name, status) ON s.name = trim(t.text)""", "status_lines")
def permit_statuses(status_lines):
    return status_lines.select("k", rules.permit_status(F.col("text"), F.col("day")).alias("status"))


@case("SELECT DISTINCT k, trim(part) AS code FROM (SELECT k, unnest(string_split(text, ',')) AS part FROM code_lines) WHERE trim(part) <> ''", "code_lines")
def exploded_codes(code_lines):
    return code_lines.select("k", F.explode(names.code_list(F.col("text"))).alias("code"))


@case("""SELECT k, CASE WHEN regexp_full_match(text, '0*[1-9][0-9]*( ?일)?') THEN n WHEN regexp_full_match(text, '0*[1-9][0-9]*주') THEN n * 7 END AS days FROM (SELECT *, TRY_CAST(regexp_extract(text, '^[0-9]+') AS BIGINT) AS n FROM duration_lines)""", "duration_lines")
def duration_texts(duration_lines):
    return duration_lines.select("k", rules.duration_days(F.col("text"))["days"].alias("days"))


@case("""SELECT rule_id AS k, TRY_CAST(regexp_extract(rule_value, '([12])\\s*등급', 1) AS INTEGER) AS grade, regexp_matches(rule_value, '[12]\\s*등급\\s*\\(') AS conditional FROM grades""", "grades")
def pregnancy_grades(grades):
    return grades.select(F.col("rule_id").alias("k"), rules.pregnancy_grade(F.col("rule_value")).alias("g")).select("k", "g.*")


@case("""SELECT k, coalesce(CASE WHEN b <> 0 THEN a / b END, TRY_CAST(regexp_extract(t, '[0-9]+(\\.[0-9]+)?') AS DOUBLE)) AS value
    FROM (SELECT *, TRY_CAST(regexp_extract(t, '([0-9]+)/([0-9]+)', 1) AS DOUBLE) AS a, TRY_CAST(regexp_extract(t, '([0-9]+)/([0-9]+)', 2) AS DOUBLE) AS b FROM (SELECT k, replace(text, ' ', '') AS t FROM role_lines))""", "role_lines")
def role_values(role_lines):
    return role_lines.select("k", forms.role_value(F.col("text")).cast("double").alias("value"))


@case("""WITH x AS (SELECT k, regexp_extract_all(text, '\\[([A-Z]\\d{6})\\]', 1) AS c FROM mixture_lines WHERE text LIKE '[%') SELECT k, unnest(c) AS code FROM x WHERE len(c) = len(list_distinct(c))""", "mixture_lines")
def mixture_codes(mixture_lines):
    return mixture_lines.select("k", F.explode(compositions.mixture(F.col("text"))["entries"]).alias("e")).select("k", "e.code")


@case("WITH " + LIMITS + """ SELECT draft AS k, round(most, 3)::DOUBLE AS value, CASE WHEN most IS NOT NULL THEN most_unit END AS unit, CASE WHEN most IS NULL THEN 'not_evaluable' ELSE 'parsed' END AS status FROM dosed""", "doses")
def dose_thresholds(doses):
    return doses.select(F.col("draft").alias("k"), rules.dose_threshold(F.col("rule_value")).alias("d")).select("k", F.round(F.col("d.value").cast("double"), 3).alias("value"), "d.unit", "d.status")


@case("""WITH own AS (SELECT DISTINCT name FROM local_names), met AS (SELECT o.name, k.substance_id FROM own o JOIN (SELECT DISTINCT trim(regexp_replace(lower(name), '\\s+', ' ', 'g')) AS key, substance_id FROM known_names) k ON k.key = trim(regexp_replace(lower(o.name), '\\s+', ' ', 'g')))
    SELECT o.name, CASE count(m.substance_id) WHEN 0 THEN 'unsolved' WHEN 1 THEN 'selected' ELSE 'ambiguous' END AS status, count(m.substance_id) AS n, min(m.substance_id) AS substance_id FROM own o LEFT JOIN met m ON m.name = o.name GROUP BY o.name""", "local_names", "known_names")
def entity_match(local_names, known_names):
    """Names by the matching cascade, without reviewed aliases."""
    aliases = known_names.select(F.lit(None).cast("string").alias("method"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("evidence_name"), "substance_id").limit(0)
    found = matching.matched(local_names, known_names, aliases)
    return found.groupBy("name").agg(F.min("status").alias("status"), F.count("substance_id").alias("n"), F.min("substance_id").alias("substance_id"))


@case("""WITH names AS (SELECT DISTINCT lower(name) AS key FROM trusted_names),
    parts AS (SELECT k, text, unnest(p) AS part, len(p) AS n FROM (SELECT k, trim(text) AS text, string_split(trim(text), '/') AS p FROM composition_lines WHERE trim(text) <> '' AND text NOT LIKE '%(%')
        UNION ALL SELECT k, trim(text), trim(text), 1 FROM composition_lines WHERE text LIKE '%(%'),
    told AS (SELECT k, text, any_value(n) AS n, bool_and(lower(trim(part)) IN (SELECT key FROM names)) AS sure FROM parts GROUP BY k, text)
    SELECT DISTINCT p.k, lower(trim(p.part)) AS key, NULL AS reason FROM parts p JOIN told t ON t.k = p.k WHERE NOT (t.text LIKE '%/%' AND (t.n < 2 OR NOT t.sure))
    UNION ALL SELECT k, NULL, 'ambiguous_composition_delimiter' FROM told WHERE text LIKE '%/%' AND (n < 2 OR NOT sure)""", "composition_lines", "trusted_names")
def safe_compositions(composition_lines, trusted_names):
    """Components of composition texts, and texts that can't be split for sure."""
    found, unsure = substances.safe_slash_split(composition_lines, trusted_names, "k", "text")
    return found.select("k", "key", F.lit(None).cast("string").alias("reason")).union(unsure.select("k", F.lit(None).cast("string"), "reason"))


@case("""WITH one AS (SELECT key, min(external) AS external, bool_or(method = 'normalized_name_exact') AS exact FROM external_matches GROUP BY key HAVING count(DISTINCT external) = 1),
    placed AS (SELECT k.key, o.external, o.exact, EXISTS (SELECT 1 FROM related_names r WHERE r.key = k.key) AS related,
        'SUB_' || upper(substr(sha256(CASE WHEN o.external IS NULL THEN k.key ELSE 'UNII' || chr(0) || o.external END), 1, 20)) AS substance_id FROM (SELECT DISTINCT key FROM observations WHERE key IS NOT NULL) k LEFT JOIN one o ON o.key = k.key),
    named AS (SELECT p.substance_id, coalesce(first(name_en ORDER BY length(name_en), lower(name_en), name_en) FILTER (name_en IS NOT NULL), first(name_ko ORDER BY length(name_ko), name_ko) FILTER (name_ko IS NOT NULL)) AS canonical_name
        FROM observations o JOIN placed p ON p.key = o.key GROUP BY p.substance_id)
    SELECT p.substance_id, n.canonical_name, CASE WHEN bool_or(p.external IS NOT NULL) THEN CASE WHEN bool_or(coalesce(p.exact, false)) THEN 'resolved_external_exact' ELSE 'resolved_external_structured' END
        WHEN bool_or(related) THEN 'resolved_source_relation' ELSE 'local_exact_unsolved' END AS identity_status, count(*) AS n_names
    FROM placed p JOIN named n ON n.substance_id = p.substance_id GROUP BY p.substance_id, n.canonical_name""", "observations", "external_matches", "related_names")
def substance_groups(observations, external_matches, related_names):
    return substances.grouped_substances(observations, external_matches, related_names)[0]


@case("""WITH rows_of AS (SELECT c.course, p.birth_date, c.start AS d, r.rule_value, pr.permit_form FROM people p JOIN courses c ON c.person = p.person JOIN form_rules r ON r.item_seq = c.item_seq JOIN products pr ON pr.item_seq = c.item_seq WHERE c.start IS NOT NULL
    ), cut AS (SELECT *, regexp_extract_all(rule_value, '([0-9]+)(세|개월|주|일) (미만|이하|이상|초과)', 1) AS n, regexp_extract_all(rule_value, '([0-9]+)(세|개월|주|일) (미만|이하|이상|초과)', 2) AS u, regexp_extract_all(rule_value, '([0-9]+)(세|개월|주|일) (미만|이하|이상|초과)', 3) AS o,
        string_split_regex(rule_value, '[0-9]+(?:세|개월|주|일) (?:미만|이하|이상|초과)') AS s FROM rows_of
    ), seg AS (SELECT *, list_transform(range(1, len(n) + 1), lambda i: {'n': n[i]::INT, 'u': u[i], 'o': o[i], 'colon': contains(s[i], ':'),
        't': list_filter(['정제', '주사제', '캡슐제', '시럽제'], lambda f: contains(s[i], f[1:2])), 'own': permit_form IS NOT NULL AND contains(s[i], permit_form[1:2])}) AS p FROM cut
    ), pick AS (SELECT *, CASE WHEN len(p) = 1 THEN p[1] WHEN permit_form IS NULL OR len(list_filter(p, lambda x: NOT x.colon OR len(x.t) = 0)) > 0 OR len(list_filter(p, lambda x: x.own)) <> 1 THEN NULL ELSE list_filter(p, lambda x: x.own)[1] END AS x,
        CASE WHEN coalesce(rule_value, '') = '' THEN 'missing' WHEN len(p) = 0 THEN 'unread' WHEN len(p) = 1 THEN NULL WHEN permit_form IS NULL THEN 'product_form' WHEN len(list_filter(p, lambda x: NOT x.colon)) > 0 THEN 'structure'
             WHEN len(list_filter(p, lambda x: len(x.t) = 0)) > 0 THEN 'segment_form' WHEN len(list_filter(p, lambda x: x.own)) <> 1 THEN 'not_one' END AS reason FROM seg
    ), bound AS (SELECT *, CASE WHEN x.o IN ('이하', '초과') THEN x.n + 1 ELSE x.n END AS m FROM pick)
    SELECT course, rule_value, CASE WHEN x IS NOT NULL THEN CASE WHEN x.o IN ('미만', '이하') THEN d < b ELSE d >= b END END AS applies, reason
    FROM (SELECT *, CASE x.u WHEN '세' THEN birth_date + to_years(m) WHEN '개월' THEN birth_date + to_months(m) WHEN '주' THEN birth_date + to_days(7 * m) ELSE birth_date + to_days(m) END AS b FROM bound)""", "people", "courses", "form_rules", "products")
def age_rules_by_form(people, courses, form_rules, products):
    """Age rules whose texts differ by the form of the product."""
    rows = people.join(courses.filter("start IS NOT NULL"), "person").join(form_rules, "item_seq").join(products, "item_seq")
    told = rules.age_rule_by_form(F.col("rule_value"), F.col("permit_form"), F.col("birth_date"), F.col("start"))
    return rows.select("course", "rule_value", told.alias("t")).select("course", "rule_value", "t.applies", "t.reason")


SPELT = """spelt AS (SELECT k, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(text)), '\\s*\\(\\s*분류번호\\s*:[^)]+\\)\\s*$', ''), '\\s+', ' ', 'g'), '\\s*([+/])\\s*', '\\1', 'g')) AS name FROM name_lines)"""


@case("WITH " + SPELT + """ SELECT k, name, CASE WHEN regexp_matches(name, '[+/]') THEN name ELSE regexp_replace(CASE WHEN name LIKE 'dilute %' THEN trim(regexp_replace(substr(name, 8), ' solution$', '')) ELSE name END, '^(.+?)(?: (?:hydrochloride|hydrate|sodium|citrate))+$', '\\1') END AS moiety FROM spelt""", "name_lines")
def ingredient_names(name_lines):
    """One spelling of each name, and its active moiety."""
    return name_lines.select("k", names.ingredient_name(F.col("text")).alias("name"), names.moiety_name(F.col("text")).alias("moiety"))


@case("""WITH bare AS (SELECT k, regexp_replace(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' ', '', 'g') AS whole, regexp_replace(regexp_replace(regexp_replace(lower(text), '\\([^)]*\\)|\\[[^\\]]*\\]', '', 'g'), '[0-9]+(\\.[0-9]+)?\\s*(mg|ml|%)', '', 'g'), '[\\s·._/,:;%-]+', '', 'g') AS t FROM stem_lines)
    SELECT k, CASE WHEN s = '' THEN whole ELSE s END AS stem FROM (SELECT *, regexp_replace(t, '^(.{2,}?)(?:정|캡슐|시럽|연고)+$', '\\1') AS s FROM bare)""", "stem_lines")
def family_stems(stem_lines):
    return stem_lines.select("k", forms.family_stem(F.col("text")).alias("stem"))


@case("""WITH t AS (SELECT k, lower(text) AS t, regexp_replace(lower(text), '\\s+', ' ', 'g') AS s, len(regexp_extract_all(text, '□')) AS boxes FROM regimen_lines),
    told AS (SELECT *, boxes <= 1 AND (regexp_matches(s, '필요 ?시|as needed') OR regexp_matches(t, '(^|[^a-z0-9_])prn([^a-z0-9_]|$)')) AS needed,
        [CASE WHEN regexp_matches(s, '식중|식사 ?와|식사 ?중') THEN 'with_meal' END, CASE WHEN regexp_matches(s, '식후|식사 ?후') THEN 'after_meal' END, CASE WHEN regexp_matches(s, '식전|식사 ?전') THEN 'before_meal' END,
         CASE WHEN regexp_matches(s, '공복|빈속') THEN 'empty_stomach' END, CASE WHEN regexp_matches(s, '식사 ?무관|식사 ?관계 ?없이') THEN 'regardless' END] AS meals,
        list_transform(regexp_extract_all(t, '오전\\s*([0-9]{1,2})', 1), lambda h: CASE WHEN h::INT BETWEEN 1 AND 12 THEN lpad((h::INT % 12)::VARCHAR, 2, '0') || ':00' END) AS half,
        CASE WHEN regexp_matches(s, '복용 ?시간') THEN list_filter(regexp_extract_all(t, '[0-9]{1,2}:[0-9]{2}'), lambda h: h[1:2]::INT < 24 AND h[4:5]::INT < 60) ELSE [] END AS day FROM t)
    SELECT k, CASE WHEN needed THEN '' ELSE array_to_string(list_sort(list_distinct(list_filter(half || day, lambda x: x IS NOT NULL))), ',') END AS times,
        CASE WHEN boxes <= 1 AND len(list_filter(meals, lambda m: m IS NOT NULL)) = 1 THEN list_filter(meals, lambda m: m IS NOT NULL)[1] END AS meal,
        CASE WHEN t LIKE '%점안%' THEN 'ophthalmic' WHEN t LIKE '%복용%' OR t LIKE '%oral%' THEN 'oral' END AS route, needed FROM told""", "regimen_lines")
def regimen_texts(regimen_lines):
    r = forms.regimen(F.col("text"))
    return regimen_lines.select("k", r.alias("r")).select("k", F.array_join("r.schedule_times", ",").alias("times"), F.col("r.meal_relation").alias("meal"), F.col("r.administration_route").alias("route"), F.col("r.as_needed").alias("needed"))


@case("SELECT id, regexp_matches(text, '[가-힣]') AS hangul, regexp_matches(text, '[A-Za-z]') AS latin, regexp_matches(text, '[0-9]') AS digit FROM samples", "samples")
def script_flags(samples):
    return samples.select("id", names.scripts(F.col("text")).alias("s")).select("id", "s.*")


@case("""WITH a AS (SELECT k, person, as_needed AS prn, long_term AS long, trim(dosage_text) AS dosage, CASE WHEN regexp_full_match(dose_amount, '[+]?([0-9]+([.][0-9]*)?|[.][0-9]+)') THEN CAST(dose_amount AS DECIMAL(30, 10)) END AS amount, dose_amount IS NOT NULL AS amount_given, trim(dose_unit) AS unit,
        nullif(trim(frequency_per_day), '') AS f, nullif(trim(meal_relation), '') AS meal, administration_route AS route, prn_max_per_day AS pm, prescription_days AS pd, schedule_times AS st, start_date AS sd, end_date AS ed FROM drafts),
    b AS (SELECT *, CASE WHEN CAST(f AS DECIMAL(10, 2)) BETWEEN 1 AND 24 AND CAST(f AS DECIMAL(10, 2)) = floor(CAST(f AS DECIMAL(10, 2))) THEN CAST(CAST(f AS DECIMAL(10, 2)) AS INT) END AS fn, CASE WHEN CAST(pm AS INT) BETWEEN 1 AND 24 THEN CAST(pm AS INT) END AS pn, CASE WHEN CAST(pd AS INT) BETWEEN 1 AND 3650 THEN CAST(pd AS INT) END AS dn,
        coalesce(list_transform(string_split(st, ','), lambda t: CASE WHEN string_split(trim(t), ':')[1]::INT < 24 AND string_split(trim(t), ':')[2]::INT < 60 THEN lpad(string_split(trim(t), ':')[1], 2, '0') || ':' || lpad(string_split(trim(t), ':')[2], 2, '0') END), []) AS ts,
        CASE WHEN sd IS NULL THEN DATE '2024-01-01' ELSE TRY_CAST(CASE WHEN length(sd) = 10 THEN sd END AS DATE) END AS s, CAST(ed AS DATE) AS e FROM a),
    c AS (SELECT *, list_sort(list_filter(ts, lambda t: t IS NOT NULL)) AS times FROM b),
    d AS (SELECT *, coalesce(fn, CASE WHEN f IS NULL AND len(times) > 0 THEN len(times) END) AS freq, CASE WHEN dn IS NOT NULL THEN s + dn - 1 END AS told FROM c),
    g AS (SELECT *, coalesce(told, e) AS last FROM d)
    SELECT k, array_to_string(list_filter([CASE WHEN len(ts) <> len(times) THEN 'schedule_time' END, CASE WHEN len(list_distinct(times)) <> len(times) THEN 'schedule_duplicate' END, CASE WHEN f IS NOT NULL AND fn IS NULL THEN 'frequency' END,
            CASE WHEN len(times) > 0 AND freq IS DISTINCT FROM len(times) THEN 'frequency_schedule' END, CASE WHEN pm IS NOT NULL AND pn IS NULL THEN 'prn_max' END, CASE WHEN prn AND (freq IS NOT NULL OR len(times) > 0) THEN 'prn_fixed' END,
            CASE WHEN NOT prn AND pm IS NOT NULL THEN 'prn_only' END, CASE WHEN amount_given AND (amount IS NULL OR amount = 0) THEN 'dose_amount' END, CASE WHEN meal NOT IN ('after_meal') THEN 'meal_relation' END, CASE WHEN route NOT IN ('oral') THEN 'administration_route' END,
            CASE WHEN pd IS NOT NULL AND dn IS NULL THEN 'days' END, CASE WHEN long AND (pd IS NOT NULL OR ed IS NOT NULL) THEN 'long_term' END, CASE WHEN s IS NULL THEN 'date' END, CASE WHEN e <> told THEN 'end_conflict' END, CASE WHEN last < s THEN 'end_before_start' END], lambda x: x IS NOT NULL), ',') AS broken,
        coalesce(dosage, CASE WHEN amount IS NOT NULL THEN CASE WHEN amount = floor(amount) THEN CAST(amount AS BIGINT)::VARCHAR ELSE regexp_replace(amount::VARCHAR, '0+$', '') END || coalesce(unit, '') END) AS dosage_text,
        freq::INT AS frequency, array_to_string(times, ',') AS times, last::VARCHAR AS end_date FROM g""", "drafts")
def prescription_drafts(drafts):
    """Drafts in normal form and the rules that they break."""
    found = draft_plans.normalized_drafts(drafts, F.lit("2024-01-01").cast("date"))
    return found.select("k", F.array_join("broken", ",").alias("broken"), "dosage_text", F.col("frequency_per_day").alias("frequency"), F.array_join("schedule_times", ",").alias("times"), "end_date")
