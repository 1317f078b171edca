"""The domain's tables as they follow from the driver's.

The driver's tables have no drug rules. Each table of the domain is a query over
them, in SQL that Spark and DuckDB read alike, so plans and their SQL are fed the
same rows and grow with the input. ``{name}`` is a table of the driver, ``{end}`` the quoted column.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = {"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER", "date": "DATE", "boolean": "BOOLEAN", "double": "DOUBLE"}


def category(x: str) -> str:
    return f"CASE {x} % 5 WHEN 0 THEN 'dose_caution' WHEN 1 THEN 'pregnancy_contraindication' WHEN 2 THEN 'combination_contraindication' WHEN 3 THEN 'age_contraindication' ELSE 'therapeutic_duplication_caution' END"


FORM = "CASE p_type WHEN 'ECONOMY' THEN '정제' WHEN 'SMALL' THEN '주사제' WHEN 'PROMO' THEN '캡슐제' WHEN 'STANDARD' THEN '정제' END"
CRITERION = f"""SELECT s_suppkey, {category("s_suppkey")}, 'D' || (s_nationkey % 12), CASE WHEN s_suppkey % 5 = 4 THEN CASE s_suppkey % 3 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '5-LOW' ELSE '3-MEDIUM' END ELSE '' END,
    CASE WHEN s_suppkey % 3 = 0 THEN 'mfds_composition' ELSE 'mfds_ingredient_code' END,
    CASE s_suppkey % 5 WHEN 0 THEN (s_suppkey % 3 + 1) * 100 || 'mg' WHEN 1 THEN (s_suppkey % 2 + 1) || '등급' WHEN 3 THEN (s_nationkey % 3 + 1) * 2 || '세 미만' ELSE 'any' END,
    CASE s_suppkey % 4 WHEN 0 THEN '주사제' WHEN 1 THEN '정제' END, CASE WHEN s_suppkey % 5 = 3 THEN CASE s_suppkey % 2 WHEN 0 THEN (s_nationkey % 3 + 1) * 2 || '세  미만' ELSE 'a' END END, s_suppkey % 3 = 0"""
MED_START = "DATE '2023-12-01' + CAST(o_orderkey % 50 AS INT)"
CATEGORIES = "(VALUES ('combination'), ('age'), ('pregnancy'), ('elderly'), ('dose'), ('duplication')) AS g(category)"

#: name: (columns, SQL)
DERIVED: dict[str, tuple[str, str]] = {
    "products": ("item_seq string, permit_form string, permit_status string", f"SELECT 'P' || p_partkey, {FORM}, CASE p_size % 4 WHEN 0 THEN 'withdrawn' WHEN 1 THEN 'expired' ELSE 'active' END FROM {{part}}"),
    "components": (
        "item_seq string, category string, code string",
        """SELECT 'P' || p_partkey, NULL, CASE WHEN p_partkey % 50 <> 0 THEN 'D' || (p_size % 12) END FROM {part}
        UNION ALL SELECT 'P' || p_partkey, NULL, CASE WHEN p_partkey % 3 = 0 THEN 'D' || ((p_size * 7 + p_partkey) % 12) END FROM {part}
        UNION ALL SELECT 'P' || p_partkey, 'dose_caution', CASE WHEN p_partkey % 5 = 0 THEN 'D' || (p_partkey % 12) END FROM {part}""",
    ),
    "code_map": (
        "category string, code string, canonical string",
        "SELECT c.category, CASE WHEN n_nationkey < 12 THEN 'D' || n_nationkey ELSE 'X' || (n_nationkey % 12) END, 'D' || (n_nationkey % 12) FROM {nation} CROSS JOIN (VALUES ('dose_caution'), ('pregnancy_contraindication'), ('combination_contraindication')) AS c(category)",
    ),
    "product_rules": (
        "id long, category string, item_seq string, ingredient_code string, effect_name string, dosage_form string, details string, paired_item string, paired_code string",
        f"""SELECT o_orderkey, {category("o_orderkey")}, 'P' || o_custkey, CASE WHEN o_orderkey % 7 < 5 THEN 'D' || ((o_orderkey * 5 + o_custkey) % 12) WHEN o_orderkey % 7 = 5 THEN 'X' || ((o_orderkey + o_custkey) % 12) END,
        CASE WHEN o_orderkey % 5 = 4 THEN o_orderpriority END, CASE o_orderstatus WHEN 'O' THEN '정제' WHEN 'P' THEN '주사제' END,
        CASE o_custkey % 4 WHEN 1 THEN (o_orderkey % 3 + 1) * 100 || ' mg' WHEN 2 THEN '-' WHEN 3 THEN (o_orderkey % 4) * 2 || '세 미만' END,
        'P' || ((o_custkey * 3 + o_orderkey) % 1500), 'D' || ((o_orderkey * 7) % 12) FROM {{orders}}""",
    ),
    "criteria": (
        "criterion_id long, category string, ingredient_code string, effect string, criterion_method string, criterion_value string, criterion_form string, criterion_details string, exact boolean, code string",
        f"{CRITERION}, 'D' || (s_nationkey % 12) FROM {{supplier}} UNION ALL {CRITERION}, 'D' || ((s_nationkey + s_suppkey) % 12) FROM {{supplier}} WHERE s_suppkey % 3 = 0",
    ),
    "pairs": (
        "criterion_id long, side string, code string",
        """SELECT s_suppkey, 'left', 'D' || (s_nationkey % 12) FROM {supplier} UNION ALL SELECT s_suppkey, 'right', 'D' || ((s_suppkey * 5 + 1) % 12) FROM {supplier}
        UNION ALL SELECT s_suppkey, 'right', 'D' || ((s_suppkey * 5 + 4) % 12) FROM {supplier} WHERE s_suppkey % 4 = 0""",
    ),
    "allowed": ("category string, ingredient_code string, item_seq string, rule_value string", "SELECT 'pregnancy_contraindication', 'D' || (p_size % 3), 'P' || p_partkey, (p_partkey % 2 + 1) || '등급' FROM {part}"),
    "people": (
        "person string, birth_date date, sex string, pregnancy_status string, lactation string",
        """SELECT 'C' || c_custkey, DATE '1930-01-01' + CAST(c_custkey * 17 % 32000 AS INT), CASE c_custkey % 2 WHEN 0 THEN 'female' ELSE 'male' END,
        CASE WHEN c_custkey % 2 = 0 THEN CASE c_custkey % 3 WHEN 0 THEN 'pregnant' WHEN 1 THEN 'not_pregnant' END END, CASE c_custkey % 5 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' END FROM {customer}""",
    ),
    "courses": (
        "course long, person string, item_seq string, start date, end date, side string",
        """SELECT o_orderkey, 'C' || o_custkey, 'P' || (o_custkey + o_orderkey % 7), CASE WHEN o_orderkey % 41 <> 0 THEN CAST(o_orderdate AS DATE) END,
        CASE WHEN o_orderkey % 9 <> 0 AND o_orderkey % 41 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INT) END, CASE o_orderkey % 2 WHEN 0 THEN 'left' ELSE 'right' END FROM {orders}""",
    ),
    "age_rules": (
        "rule_id long, item_seq string, rule_value string",
        "SELECT p_partkey, 'P' || p_partkey, CASE WHEN p_partkey % 10 = 9 THEN '액제: 2세 미만, 정제: 6세 미만' ELSE (p_size % 30 + 1) || CASE p_partkey % 4 WHEN 0 THEN '세 미만' WHEN 1 THEN '세 이상' WHEN 2 THEN '개월 이하' ELSE '주 초과' END END FROM {part}",
    ),
    "grades": (
        "rule_id long, item_seq string, rule_value string",
        """SELECT p_partkey * 2, 'P' || p_partkey, (p_partkey % 2 + 1) || '등급' || CASE WHEN p_partkey % 7 = 0 THEN '(조건)' ELSE '' END FROM {part}
        UNION ALL SELECT p_partkey * 2 + 1, 'P' || p_partkey, ((p_partkey + p_size) % 2 + 1) || ' 등급' FROM {part} WHERE p_partkey % 4 = 0""",
    ),
    "windows": (
        "rule_id long, item_seq string, details string, left_name string, right_name string, evaluator string, hours int, mode string",
        """SELECT p_partkey, 'P' || p_partkey, CASE p_partkey % 9 WHEN 1 THEN p_size || '시간 이내 병용금기' WHEN 2 THEN p_type || ' 투여 중단 후 ' || (p_size % 4 + 1) || '주' WHEN 3 THEN 'Gamma 투여 중단 후 2주' WHEN 4 THEN p_name || '  복용 종료 후 3 일'
        WHEN 5 THEN '투여 중단 후 주의' ELSE '병용금기' END, p_type, p_name, CASE p_partkey % 9 WHEN 6 THEN 'minimum_separation' WHEN 7 THEN 'new_kind' WHEN 8 THEN 'opaque_condition' END, CASE WHEN p_partkey % 9 = 6 THEN 48 END,
        CASE p_partkey % 9 WHEN 6 THEN 'runtime_evaluable' WHEN 7 THEN 'runtime_evaluable' WHEN 8 THEN 'review_required' END FROM {part}""",
    ),
    "groups": (
        "item_seq string, grp string, form string, excluded_route string, review boolean",
        f"SELECT 'P' || p_partkey, p_brand, {FORM}, CASE WHEN p_partkey % 4 = 0 THEN 'oral' END, p_partkey % 11 = 0 FROM {{part}} UNION ALL SELECT 'P' || p_partkey, p_type, {FORM}, CASE WHEN p_partkey % 3 = 0 THEN 'oral' END, false FROM {{part}}",
    ),
    "durations": (
        "draft long, days int, rule_value string, review boolean, unlinked boolean",
        """SELECT l_orderkey, CASE WHEN l_orderkey % 11 <> 0 THEN l_orderkey % 40 END, CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE CASE l_orderkey % 4 WHEN 0 THEN CASE l_partkey % 2 WHEN 0 THEN '28일' ELSE '4주' END WHEN 1 THEN '2주'
        WHEN 2 THEN CASE l_partkey % 5 WHEN 0 THEN '3개월' ELSE '14' END ELSE CASE l_partkey % 3 WHEN 0 THEN '28일' WHEN 1 THEN '0일' END END END, l_partkey % 29 = 0, l_orderkey % 5 = 0 FROM {lineitem}""",
    ),
    "doses": (
        "draft long, person string, rule_value string, amount string, unit string, frequency int",
        """SELECT o_orderkey, 'C' || o_custkey, CASE o_orderkey % 8 WHEN 0 THEN '가 100mg' WHEN 1 THEN '가 1.5g' WHEN 2 THEN '가 4정' WHEN 3 THEN NULL WHEN 4 THEN '가 100mg 또는 나 50mg' WHEN 5 THEN '가 1,500mg' WHEN 6 THEN '가 90000마이크로그램' ELSE '가 2캡슐' END,
        CASE o_custkey % 5 WHEN 0 THEN '50' WHEN 1 THEN '45.5' WHEN 2 THEN '500' WHEN 3 THEN '1' END, CASE WHEN o_orderkey % 8 IN (2, 7) THEN CASE o_custkey % 6 WHEN 0 THEN 'mg' ELSE CASE o_orderkey % 8 WHEN 2 THEN '정' ELSE '캡슐' END END ELSE 'mg' END,
        CASE WHEN o_orderkey % 17 <> 0 THEN o_orderkey % 5 END FROM {orders}""",
    ),
    "findings": (
        "person string, category string, severity string, status string",
        """SELECT 'C' || o_custkey, CASE o_orderkey % 6 WHEN 0 THEN 'combination' WHEN 1 THEN 'age' WHEN 2 THEN 'pregnancy' WHEN 3 THEN 'elderly' WHEN 4 THEN 'dose' ELSE 'duplication' END,
        CASE o_orderstatus WHEN 'F' THEN 'danger' WHEN 'O' THEN 'warning' ELSE 'info' END, CASE o_orderkey % 7 WHEN 0 THEN 'unknown' WHEN 1 THEN 'conditional' WHEN 2 THEN 'unknown' END FROM {orders}""",
    ),
    "known": (
        "person string, category string, applicable boolean, quantitative string, issue boolean, verified boolean, mapped boolean",
        f"""SELECT 'C' || c_custkey, g.category, NOT (g.category = 'pregnancy' AND c_custkey % 2 = 1), CASE WHEN g.category = 'dose' THEN CASE c_custkey % 4 WHEN 0 THEN 'exceeded' WHEN 1 THEN 'within' WHEN 2 THEN 'not_evaluable' END END,
        c_custkey % 19 = 0, NOT (c_custkey % 6 = 0 AND g.category = 'age'), c_custkey % 7 <> 3 FROM {{customer}} CROSS JOIN {CATEGORIES}""",
    ),
    "medications": (
        "med string, person string, name string, start date, end date, prn boolean, frequency int, active boolean, seq int",
        f"""SELECT 'm' || o_orderkey, 'C' || o_custkey, o_orderpriority, {MED_START}, CASE WHEN o_orderkey % 3 <> 0 THEN {MED_START} + CAST(o_custkey % 30 AS INT) END, o_orderkey % 6 = 0,
        CASE WHEN o_orderkey % 10 <> 0 THEN o_orderkey % 4 END, o_orderkey % 8 <> 0, o_orderkey FROM {{orders}}""",
    ),
    "schedules": (
        "schedule int, med string, clock string",
        "SELECT l_linenumber * 1000 + l_partkey % 1000, 'm' || l_orderkey, CASE WHEN l_suppkey % 2 = 0 THEN '0' || (l_partkey % 10) || ':00' ELSE '1' || (l_partkey % 10) || ':30' END FROM {lineitem} WHERE l_returnflag <> 'A'",
    ),
    "instances": (
        "med string, slot string, clock string, state string",
        "SELECT 'm' || l_orderkey, 'slot:' || l_linenumber, CASE WHEN l_suppkey % 3 <> 0 THEN '0' || (l_partkey % 10) || ':00' END, CASE l_linestatus WHEN 'O' THEN 'planned' ELSE 'taken' END FROM {lineitem}",
    ),
    "requests": (
        "request string, seq int, med string, payload string, at string",
        """SELECT 'r' || (event_id % 997), event_id, 'm' || user_id, event_type, replace(substr(CAST(ts AS STRING), 1, 19), ' ', 'T') || CASE event_id % 3 WHEN 0 THEN 'Z' WHEN 1 THEN '+09:00' ELSE '' END FROM {events}""",
    ),
    "notes": (
        "remark_id long, mode string, value string",
        "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'composition_scope' WHEN 1 THEN 'informational' WHEN 2 THEN 'review_required' WHEN 3 THEN 'interaction_window' ELSE 'form_exclusion' END, CASE p_partkey % 5 WHEN 0 THEN 'all' WHEN 3 THEN CAST(p_size AS STRING) WHEN 4 THEN lower(p_type) END FROM {part}",
    ),
    "facts": (
        "criterion_id long, role string, evaluator string, mode string, fallback string, hours int, expected int",
        """SELECT l_suppkey, CASE l_returnflag WHEN 'A' THEN 'informational' WHEN 'N' THEN 'applicability_condition' ELSE 'something' END, CASE l_linenumber % 2 WHEN 0 THEN 'minimum_separation' ELSE 'display_only' END,
        CASE l_linenumber % 2 WHEN 0 THEN 'runtime_evaluable' ELSE 'resolved_at_build' END, 'none', CASE WHEN l_partkey % 3 <> 0 THEN l_partkey % 4 * 12 END, 500 FROM {lineitem}""",
    ),
    "raw_criteria": (
        "seq long, del_yn string, name_type string, value string",
        "SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN '삭제' WHEN 1 THEN '기타' ELSE '정상' END, CASE p_size % 5 WHEN 0 THEN 'of' WHEN 1 THEN 'cn' WHEN 2 THEN 'sys' WHEN 3 THEN 'bn' END, CASE p_partkey % 4 WHEN 0 THEN '  ' WHEN 1 THEN p_name WHEN 2 THEN ' ' || p_type || ' ' END FROM {part}",
    ),
    "raw_texts": ("k long, text string", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '  ' || p_name || ' ' WHEN 1 THEN '   ' WHEN 2 THEN p_type END FROM {part}"),
    "date_lines": (
        "k long, text string",
        """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN replace(substr(CAST(o_orderdate AS STRING), 1, 10), '-', '') WHEN 1 THEN ' ' || replace(substr(CAST(o_orderdate AS STRING), 1, 10), '-', '. ') || '.' WHEN 2 THEN substr(CAST(o_orderdate AS STRING), 1, 7) || ' ' WHEN 3 THEN substr(CAST(o_orderdate AS STRING), 1, 10) END FROM {orders}""",
    ),
    "status_lines": (
        "k long, text string, day string",
        "SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN ' 정상' WHEN 1 THEN '유효기간만료' WHEN 2 THEN '취하' WHEN 3 THEN '폐업' WHEN 4 THEN '행정(취소)' WHEN 5 THEN '취소 ' WHEN 6 THEN p_name END, CASE p_size % 3 WHEN 0 THEN '20200131' WHEN 1 THEN ' ' END FROM {part}",
    ),
    "code_lines": ("k long, text string", "SELECT p_partkey, 'E' || p_size || ', E' || (p_partkey % 5) || ',,E' || p_size || ' , ' || p_brand FROM {part}"),
    "duration_lines": ("k long, text string", "SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN '0일' WHEN p_partkey % 17 = 0 THEN NULL ELSE p_size || CASE p_partkey % 6 WHEN 0 THEN '일' WHEN 1 THEN '주' WHEN 2 THEN '개월' WHEN 3 THEN '' WHEN 4 THEN ' 일' ELSE '회' END END FROM {part}"),
    "role_lines": ("k long, text string", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size || '/4' WHEN 1 THEN p_size || '.5정' WHEN 2 THEN p_size || ' / 0' WHEN 3 THEN p_name ELSE '하루 ' || p_size || '회' END FROM {part}"),
    "mixture_lines": (
        "k long, text string",
        """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '[D' || lpad(CAST(p_partkey AS STRING), 6, '0') || ']' || p_name WHEN 1 THEN '[D' || lpad(CAST(p_partkey AS STRING), 6, '0') || ']' || p_name || '/[D' || lpad(CAST(p_size AS STRING), 6, '9') || ']' || p_type
        WHEN 2 THEN '[D000001]' || p_name || '/[D000001]' || p_type ELSE p_name || '[D000001]' || p_type END FROM {part}""",
    ),
    "known_names": ("substance_id string, name string, dataset string", "SELECT 'S' || p_partkey, p_name || ' ' || p_brand, p_type FROM {part}"),
    "local_names": ("name string", "SELECT upper(p_name) || '  ' || 'Brand#' || (p_size % 25 + 1) FROM {part}"),
    "composition_lines": (
        "k long, text string",
        "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN ' ' || replace(p_name, ' ', ' / ') WHEN 2 THEN p_name || '/' || lower(p_type) WHEN 3 THEN p_name || ' (1/' || p_size || ')' WHEN 4 THEN replace(p_name, ' ', '/') || '/' || upper(substr(p_name, 1, 1)) || substr(p_name, 2) ELSE ' ' END FROM {part}",
    ),
    "trusted_names": ("name string", "SELECT p_name FROM {part} WHERE p_size > 3 UNION ALL SELECT split_part(p_name, ' ', 1) FROM {part} WHERE p_type <> 'PROMO' UNION ALL SELECT split_part(p_name, ' ', 2) FROM {part} WHERE p_size < 40 UNION ALL SELECT lower(p_type) FROM {part} WHERE p_type IN ('PROMO', 'SMALL')"),
    "observations": (
        "key string, name_en string, name_ko string",
        "SELECT lower(p_name) || ' ' || (p_size % 20), CASE WHEN p_partkey % 3 <> 0 THEN CASE p_partkey % 2 WHEN 0 THEN p_name || ' ' || p_brand ELSE upper(p_name) END END, '이름' || (p_size % 20) || p_type FROM {part}",
    ),
    "external_matches": (
        "key string, external string, method string",
        "SELECT lower(p_name) || ' ' || (p_size % 20), 'U' || (p_size % 4), CASE p_partkey % 4 WHEN 0 THEN 'normalized_name_exact' ELSE 'typo' END FROM {part} WHERE p_type IN ('PROMO', 'SMALL') AND p_size > 15",
    ),
    "related_names": ("key string", "SELECT lower(p_name) || ' ' || (p_size % 20) FROM {part} WHERE p_type = 'LARGE'"),
    "form_rules": (
        "rule_id long, item_seq string, rule_value string",
        """SELECT p_partkey, 'P' || p_partkey, CASE p_partkey % 7 WHEN 0 THEN '정제, 캡슐제: ' || (p_size + 10) || '세 미만, 주사제: ' || p_size || '세 이하' WHEN 1 THEN '정제: 12세 미만, 시럽제: 24개월 미만' WHEN 2 THEN (p_size + 20) || '세 이상' WHEN 3 THEN '정제 6세 미만, 캡슐제: 12세 미만'
        WHEN 4 THEN '가루: 6세 미만, 정제: 12세 미만' WHEN 5 THEN '해당없음' END FROM {part}""",
    ),
    "name_lines": (
        "k long, text string",
        """SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN upper(p_name) || ' (분류번호: ' || p_size || ')' WHEN 1 THEN p_name || '  Hydrochloride hydrate ' WHEN 2 THEN '  ' || p_name || ' + ' || lower(p_type) WHEN 3 THEN p_name || ' sodium /' || p_type
        WHEN 4 THEN 'Dilute ' || p_name || ' solution' WHEN 5 THEN p_name || ' sodium (' || p_size || ')' WHEN 6 THEN 'Sodium citrate' END FROM {part}""",
    ),
    "stem_lines": (
        "k long, text string",
        """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name || '정 ' || p_size || 'mg' WHEN 1 THEN p_name || '캡슐(' || p_type || ')' WHEN 2 THEN upper(p_name) || ' 시럽 ' || p_size || '.5 ml' WHEN 3 THEN '정' ELSE p_name || '-' || p_size || '%연고[' || p_brand || ']' END FROM {part}""",
    ),
    "regimen_lines": (
        "k long, text string",
        """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '1일 ' || (o_custkey % 3 + 1) || '회 ' WHEN 1 THEN '복용  시간 0' || (o_custkey % 10) || ':' || (10 + o_custkey % 50) || ', 2' || (o_custkey % 6) || ':05 ' WHEN 2 THEN '오전 ' || (o_custkey % 14) || '시 ' ELSE '' END
        || CASE o_custkey % 8 WHEN 0 THEN '식사 후' WHEN 1 THEN '식전 복용' WHEN 2 THEN '식사와 함께' WHEN 3 THEN '휴식 후' WHEN 4 THEN '공복, 식후' WHEN 5 THEN '식사 관계없이' ELSE '' END
        || CASE o_custkey % 9 WHEN 0 THEN ' 필요시' WHEN 1 THEN ' PRN' WHEN 2 THEN ' sprn' WHEN 3 THEN ' 눈에 점안' WHEN 4 THEN ' □ □ as needed' WHEN 5 THEN ' oral' ELSE '' END FROM {orders}""",
    ),
    "drafts": (
        "k long, person string, dosage_text string, dose_amount string, dose_unit string, frequency_per_day string, meal_relation string, administration_route string, as_needed boolean, prn_max_per_day string, prescription_days string, long_term boolean, schedule_times string, start_date string, end_date string",
        """SELECT o_orderkey, 'C' || o_custkey, CASE WHEN o_orderkey % 6 = 0 THEN ' 1정 ' END, CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '0' WHEN 2 THEN '1.50' WHEN 3 THEN '+2' WHEN 4 THEN 'x' WHEN 5 THEN '010.0' ELSE '.5' END,
        CASE o_custkey % 3 WHEN 0 THEN 'mg' WHEN 1 THEN ' 정 ' END, CASE o_custkey % 5 WHEN 0 THEN '2' WHEN 1 THEN '25' WHEN 2 THEN ' ' WHEN 3 THEN '2.0' END,
        CASE o_orderkey % 5 WHEN 0 THEN 'after_meal' WHEN 1 THEN 'sometimes' WHEN 2 THEN ' ' END, CASE o_orderkey % 11 WHEN 0 THEN 'oral' WHEN 1 THEN 'by air' END, o_orderkey % 13 = 0,
        CASE o_orderkey % 26 WHEN 0 THEN '3' WHEN 13 THEN '99' WHEN 1 THEN '3' END, CASE o_custkey % 7 WHEN 0 THEN '7' WHEN 1 THEN '0' WHEN 2 THEN '4000' END, o_custkey % 17 = 0,
        CASE o_orderkey % 9 WHEN 0 THEN '8:0, 20:30' WHEN 1 THEN '24:00' WHEN 2 THEN '09:00,9:00' WHEN 3 THEN '12:15,07:05' END,
        CASE WHEN o_orderkey % 4 <> 0 THEN substr(CAST(o_orderdate AS STRING), 1, CASE WHEN o_orderkey % 37 = 1 THEN 7 ELSE 10 END) END, CASE WHEN o_custkey % 6 = 0 THEN '1999-12-31' END FROM {orders}""",
    ),
    "edges": ("a long, b long", "SELECT p_partkey, (p_partkey * p_partkey + 3 * p_size) % 1999 FROM {part}"),
    "samples": (
        "id string, family string, split string, tags string, errors int, chars int, expected int, found int, text string",
        """SELECT conv_id || '-' || turn, 'f' || (conv_id % 50), CASE WHEN conv_id % 10 < 8 THEN 'train' WHEN turn % 2 = 0 THEN 'val' ELSE 'test' END, CASE conv_id % 3 WHEN 0 THEN 'hard,blur' WHEN 1 THEN '' ELSE role END,
        turn * 2, length(text), turn + 1, turn, text FROM {conversations}""",
    ),
    "predicted": ("id string, text string, score double", "SELECT CASE WHEN turn = 5 THEN 'x' ELSE '' END || conv_id || '-' || turn, CASE WHEN conv_id % 3 = 0 THEN upper(text) ELSE text END, turn * 0.5 FROM {conversations}"),
    "exposed": ("family string, source string", "SELECT 'f' || (s_suppkey % 20), 'old' FROM {supplier}"),
    "labels_t": ("id string, text string", "SELECT 'i' || p_partkey, CASE WHEN p_partkey % 9 <> 0 THEN p_name END FROM {part}"),
    "boxes": (
        "doc string, box string, x0 double, y0 double, x1 double, y1 double",
        "SELECT 'd' || (p_partkey % 40), 'b' || p_partkey, p_partkey * 37 % 99991, p_size * 13 % 31, p_partkey * 37 % 99991 + 900 + p_size * 40, p_size * 13 % 31 + 10 + p_size % 7 FROM {part}",
    ),
    "fields": (
        "doc string, field string, wanted string, got string",
        "SELECT 'd' || l_orderkey, CASE l_linenumber % 3 WHEN 0 THEN 'dose' WHEN 1 THEN 'days' ELSE 'route' END, CASE WHEN l_partkey % 5 <> 0 THEN l_returnflag END, CASE WHEN l_suppkey % 7 <> 0 THEN CASE l_partkey % 3 WHEN 0 THEN l_linestatus ELSE l_returnflag END END FROM {lineitem}",
    ),
    "models": ("model string, gate boolean, recall double, precision double, latency double, grp int", "SELECT s_name, s_suppkey % 3 <> 0, s_nationkey / 25.0, s_suppkey % 7 / 10.0, s_acctbal, s_nationkey FROM {supplier}"),
    "metrics": ("metric string, value double, least double, most double", "SELECT 'm' || p_partkey, CASE WHEN p_partkey % 11 <> 0 THEN p_retailprice END, CASE WHEN p_partkey % 2 = 0 THEN 900 + p_size END, CASE WHEN p_partkey % 3 = 0 THEN 1000 + p_size END FROM {part}"),
    "checks": (
        "med string, category string, state string, label string",
        "SELECT 'm' || o_custkey, CASE o_orderkey % 3 WHEN 0 THEN 'age' WHEN 1 THEN 'split' ELSE 'dose' END, CASE o_orderstatus WHEN 'F' THEN 'hit' WHEN 'O' THEN 'clear' ELSE CASE o_orderkey % 2 WHEN 0 THEN 'unknown' ELSE 'conditional' END END, CASE o_orderkey % 4 WHEN 0 THEN '분할불가' ELSE '분할가능' END FROM {orders}",
    ),
    "evidence": ("substance string, dataset string, priority int, name string, rows int", "SELECT p_name, p_brand, p_size % 10, CASE p_partkey % 3 WHEN 0 THEN upper(p_type) WHEN 1 THEN ' ' || lower(p_type) ELSE p_type END, p_partkey % 5 FROM {part}"),
    "current": (
        "person string, med string, mapped boolean, start date, end date",
        f"SELECT 'C' || o_custkey, 'm' || o_orderkey, o_orderkey % 3 = 0, {MED_START}, CASE WHEN o_orderkey % 4 <> 0 THEN {MED_START} + CAST(o_custkey % 20 AS INT) END FROM {{orders}}",
    ),
}


def columns(name: str) -> list[tuple[str, str]]:
    return [tuple(c.split()) for c in DERIVED[name][0].split(", ")]


def _sources(name: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", DERIVED[name][1])) - {"end"})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The derived table ``name`` over the driver's tables in ``sf_dir``."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _sources(name)}
    rows = spark.sql(DERIVED[name][1], **frames)
    named = rows.toDF(*(f"c{i}" for i in range(len(rows.columns))))
    return named.select(*(F.col(f"c{i}").cast(t).alias(c) for i, (c, t) in enumerate(columns(name))))


def sql(name: str) -> str:
    """The derived table ``name`` as a common table expression of DuckDB."""
    text = DERIVED[name][1].format(**{t: t for t in _sources(name)})
    heads = ", ".join(f"c{i}" for i in range(len(columns(name))))
    casts = ", ".join(f'CAST(c{i} AS {TYPES[t]}) AS "{c}"' for i, (c, t) in enumerate(columns(name)))
    return f"{name} AS (SELECT {casts} FROM ({text}) t({heads}))"
