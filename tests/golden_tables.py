"""Small reviewed rows of the domain's tables: the goldens that plans and SQL are held against."""

from pyspark.sql import functions as F

from posora.plans.derived import TYPES

#: name: (columns, rows)
GOLDEN = {
    "products": (
        "item_seq string, permit_form string, permit_status string",
        [
            ('P1', '정제', 'active'),
            ('P2', '주사제', 'active'),
            ('P3', '캡슐제', 'withdrawn'),
            ('P4', None, 'active'),
            ('P5', '정제', 'expired'),
        ],
    ),
    "components": (
        "item_seq string, category string, code string",
        [
            ('P1', None, 'D1'),
            ('P1', None, 'D2'),
            ('P1', None, 'D2'),
            ('P2', None, 'D1'),
            ('P3', None, 'D3'),
            ('P4', 'dose_caution', 'D4'),
            ('P5', None, None),
        ],
    ),
    "code_map": (
        "category string, code string, canonical string",
        [
            ('dose_caution', 'D1', 'D1'),
            ('dose_caution', 'D4', 'D4'),
            ('pregnancy_contraindication', 'D1', 'D1'),
            ('pregnancy_contraindication', 'X1', 'D1'),
            ('combination_contraindication', 'D1', 'D1'),
            ('combination_contraindication', 'D3', 'D3'),
        ],
    ),
    "product_rules": (
        "id long, category string, item_seq string, ingredient_code string, effect_name string, dosage_form string, details string, paired_item string, paired_code string",
        [
            (1, 'dose_caution', 'P1', 'D1', None, None, None, None, None),
            (2, 'dose_caution', 'P1', 'D1', None, None, '100 mg', None, None),
            (3, 'dose_caution', 'P1', 'D1', None, None, '999mg', None, None),
            (4, 'pregnancy_contraindication', 'P2', 'X1', None, '주사제', None, None, None),
            (5, 'pregnancy_contraindication', 'P1', 'D1', None, None, None, None, None),
            (6, 'combination_contraindication', 'P1', 'D1', None, None, None, 'P3', 'D3'),
            (7, 'combination_contraindication', 'P3', 'D3', None, None, None, 'P1', 'D1'),
            (8, 'age_contraindication', 'P4', 'D9', None, None, '6세 미만', None, None),
            (9, 'age_contraindication', 'P5', 'D8', None, None, None, None, None),
            (10, 'therapeutic_duplication_caution', 'P2', None, '진통제', None, None, None, None),
        ],
    ),
    "criteria": (
        "criterion_id long, category string, ingredient_code string, effect string, criterion_method string, criterion_value string, criterion_form string, criterion_details string, exact boolean, code string",
        [
            (101, 'dose_caution', 'D1', '', 'mfds_ingredient_code', '100mg', None, None, False, 'D1'),
            (102, 'dose_caution', 'D1', '', 'mfds_composition', '200mg', None, None, True, 'D1'),
            (102, 'dose_caution', 'D1', '', 'mfds_composition', '200mg', None, None, True, 'D2'),
            (103, 'pregnancy_contraindication', 'D1', '', 'mfds_ingredient_code', '2등급', '주사제', None, False, 'D1'),
            (104, 'pregnancy_contraindication', 'D1', '', 'mfds_ingredient_code', '1등급', None, None, False, 'D1'),
            (105, 'age_contraindication', 'D9', '', 'mfds_ingredient_code', '6세 미만', None, '6세  미만', False, 'D9'),
            (106, 'age_contraindication', 'D9', '', 'mfds_ingredient_code', '12세 미만', None, '12세 미만', False, 'D9'),
            (107, 'age_contraindication', 'D8', '', 'mfds_ingredient_code', '2세 미만', None, 'a', False, 'D8'),
            (108, 'age_contraindication', 'D8', '', 'mfds_ingredient_code', '2세  미만', None, 'b', False, 'D8'),
            (109, 'therapeutic_duplication_caution', None, '진통제', 'mfds_ingredient_code', '진통제', None, None, False, 'D1'),
        ],
    ),
    "pairs": (
        "criterion_id long, side string, code string",
        [
            (201, 'left', 'D1'),
            (201, 'right', 'D3'),
            (202, 'left', 'D3'),
            (202, 'right', 'D1'),
            (202, 'right', 'D2'),
        ],
    ),
    "allowed": (
        "category string, ingredient_code string, item_seq string, rule_value string",
        [
            ('pregnancy_contraindication', 'X1', 'P2', '2등급'),
            ('pregnancy_contraindication', 'D1', 'P9', '1등급'),
        ],
    ),
    "people": (
        "person string, birth_date date, sex string, pregnancy_status string, lactation string",
        [
            ('A', '2016-03-01', 'female', 'not_pregnant', 'no'),
            ('B', '1990-05-05', 'female', 'pregnant', None),
            ('C', '1959-06-15', 'male', None, None),
            ('D', '1956-02-29', 'female', None, 'no'),
        ],
    ),
    "courses": (
        "course long, person string, item_seq string, start date, end date, side string",
        [
            (1, 'A', 'P1', '2024-01-01', '2024-01-10', 'left'),
            (2, 'A', 'P3', '2024-01-12', '2024-01-20', 'right'),
            (3, 'B', 'P1', '2024-02-01', None, 'left'),
            (4, 'B', 'P3', '2024-01-01', '2024-01-30', 'right'),
            (5, 'C', 'P2', '2024-06-10', '2024-06-20', 'left'),
            (6, 'C', 'P3', '2024-05-01', '2024-06-09', 'right'),
            (7, 'D', 'P2', '2021-02-20', '2021-02-27', 'left'),
            (8, 'D', 'P1', None, None, 'right'),
        ],
    ),
    "age_rules": (
        "rule_id long, item_seq string, rule_value string",
        [
            (1, 'P1', '12세 미만'),
            (2, 'P1', '7세 이하'),
            (3, 'P2', '65세 이상'),
            (4, 'P2', '18세 초과'),
            (5, 'P1', '액제: 2세 미만, 정제: 6세 미만'),
            (6, 'P1', '96개월 미만'),
        ],
    ),
    "grades": (
        "rule_id long, item_seq string, rule_value string",
        [
            (1, 'P1', '1등급'),
            (2, 'P3', '2등급(말라리아 치료시 제외)'),
            (3, 'P3', '2등급'),
            (4, 'P2', '1등급'),
            (5, 'P2', '2등급'),
        ],
    ),
    "windows": (
        "rule_id long, item_seq string, details string, left_name string, right_name string, evaluator string, hours int, mode string",
        [
            (1, 'P1', '병용금기', 'Alpha', 'Beta', None, None, None),
            (2, 'P2', '24시간 이내 병용금기', 'Alpha', 'Beta', None, None, None),
            (3, 'P1', 'Alpha 투여 중단 후 2주', 'Alpha', 'Beta', None, None, None),
            (4, 'P2', 'Gamma 투여 중단 후 2주', 'Alpha', 'Beta', None, None, None),
            (5, 'P1', 'beta  복용 종료 후 3 일', 'Alpha', 'Beta', None, None, None),
            (6, 'P2', '투여 중단 후 주의', 'Alpha', 'Beta', None, None, None),
            (7, 'P1', '병용금기', 'Alpha', 'Beta', 'minimum_separation', 48, 'runtime_evaluable'),
            (8, 'P2', '병용금기', 'Alpha', 'Beta', 'new_kind', None, 'runtime_evaluable'),
            (9, 'P1', '병용금기', 'Alpha', 'Beta', 'opaque_condition', None, 'review_required'),
        ],
    ),
    "groups": (
        "item_seq string, grp string, form string, excluded_route string, review boolean",
        [
            ('P1', '진통제', '정제', None, False),
            ('P3', '진통제', '캡슐제', 'oral', False),
            ('P2', '진통제', '주사제', 'oral', False),
            ('P3', '항생제', None, 'oral', False),
            ('P1', '항생제', '정제', None, True),
        ],
    ),
    "durations": (
        "draft long, days int, rule_value string, review boolean, unlinked boolean",
        [
            (1, 20, '28일', False, False),
            (2, 30, '28일', False, False),
            (3, 30, None, False, False),
            (4, 30, None, False, True),
            (5, None, '28일', False, False),
            (6, 10, '28일', True, False),
            (7, 10, '28일', False, False),
            (7, 10, '2주', False, False),
            (8, 10, '3개월', False, False),
            (9, 14, '2주', False, False),
        ],
    ),
    "doses": (
        "draft long, person string, rule_value string, amount string, unit string, frequency int",
        [
            (1, 'B', '가 100mg', '50', 'mg', 2),
            (2, 'C', '가 100mg', '50.5', 'mg', 2),
            (3, 'D', '가 1.5g', '500', 'mg', 3),
            (4, 'A', '가 4정', '2', '정', 3),
            (5, 'B', '가 100mg', '1', '정', 3),
            (6, 'C', None, '1', 'mg', 1),
            (7, 'D', '가 100mg 또는 나 50mg', '1', 'mg', 1),
            (8, 'A', '가 100mg', '50', 'mg', None),
        ],
    ),
    "findings": (
        "person string, category string, severity string, status string",
        [
            ('A', 'combination', 'danger', None),
            ('A', 'combination', 'info', 'unknown'),
            ('A', 'age', 'danger', 'conditional'),
            ('B', 'pregnancy', 'info', 'unknown'),
            ('C', 'elderly', 'warning', None),
        ],
    ),
    "known": (
        "person string, category string, applicable boolean, quantitative string, issue boolean, verified boolean, mapped boolean",
        [
            ('A', 'combination', True, None, False, True, True),
            ('A', 'age', True, None, False, True, True),
            ('A', 'pregnancy', False, None, False, True, True),
            ('A', 'dose', True, 'exceeded', False, True, True),
            ('B', 'pregnancy', True, None, False, True, True),
            ('B', 'dose', True, 'within', False, True, True),
            ('B', 'age', True, None, False, False, True),
            ('C', 'elderly', True, None, False, True, True),
            ('C', 'combination', True, None, False, True, False),
            ('C', 'age', True, None, False, True, True),
        ],
    ),
    "medications": (
        "med string, person string, name string, start date, end date, prn boolean, frequency int, active boolean, seq int",
        [
            ('m1', 'A', '가', '2024-01-01', '2024-01-31', False, 3, True, 1),
            ('m2', 'A', '나', '2024-01-05', None, False, 2, True, 2),
            ('m3', 'B', '다', '2024-01-01', '2024-01-03', False, 1, False, 3),
            ('m4', 'B', '라', '2024-01-01', None, True, None, True, 4),
            ('m5', 'B', '마', '2024-01-01', None, False, 0, True, 5),
        ],
    ),
    "schedules": (
        "schedule int, med string, clock string",
        [
            (1, 'm1', '20:00'),
            (2, 'm1', '08:00'),
            (3, 'm3', '09:00'),
        ],
    ),
    "instances": (
        "med string, slot string, clock string, state string",
        [
            ('m1', 'slot:1', '09:00', 'planned'),
            ('m1', 'slot:2', '20:00', 'planned'),
            ('m2', 'slot:1', None, 'taken'),
            ('m3', 'slot:1', '09:00', 'planned'),
            ('m2', 'slot:3', None, 'planned'),
        ],
    ),
    "requests": (
        "request string, seq int, med string, payload string, at string",
        [
            ('r1', 1, 'm4', 'p', '2024-01-05T23:30:00+09:00'),
            ('r1', 2, 'm4', 'p', '2024-01-05T23:31:00+09:00'),
            ('r1', 3, 'm4', 'q', '2024-01-05T23:32:00+09:00'),
            ('r2', 4, 'm4', 'p', '2024-01-05T15:10:00Z'),
            ('r3', 5, 'm1', 'z', '2024-01-06T00:10:00'),
        ],
    ),
    "notes": (
        "remark_id long, mode string, value string",
        [
            (1, 'composition_scope', 'all'),
            (2, 'informational', None),
            (3, 'review_required', None),
            (4, 'interaction_window', '24'),
            (5, 'form_exclusion', 'topical'),
        ],
    ),
    "facts": (
        "criterion_id long, role string, evaluator string, mode string, fallback string, hours int, expected int",
        [
            (1, 'applicability_condition', 'minimum_separation', 'runtime_evaluable', 'review_required', 24, 1),
            (2, 'applicability_condition', 'minimum_separation', 'runtime_evaluable', 'review_required', 0, 1),
            (3, 'informational', 'display_only', 'resolved_at_build', 'none', None, 2),
            (4, 'something', 'display_only', 'resolved_at_build', 'none', None, 1),
        ],
    ),
    "raw_criteria": (
        "seq long, del_yn string, name_type string, value string",
        [
            (1, '정상', 'of', 'a'),
            (2, '삭제', 'cn', 'b'),
            (3, '정상', 'bn', 'c'),
            (4, '정상', 'sys', '  '),
            (5, '기타', 'of', None),
        ],
    ),
    "edges": (
        "a long, b long",
        [
            (1, 2),
            (2, 3),
            (5, 4),
            (7, 7),
            (8, 9),
            (9, 10),
            (10, 8),
            (11, 3),
        ],
    ),
    "samples": (
        "id string, family string, split string, tags string, errors int, chars int, expected int, found int, text string",
        [
            ('a', 'f1', 'train', 'hard,blur', 2, 20, 4, 4, '가나1'),
            ('b', 'f1', 'test', '', 0, 10, 0, 0, 'AB'),
            ('c', 'f2', 'test', 'hard', 5, 10, 3, 1, '다 2정'),
            ('d', 'f3', 'val', 'blur', 0, 0, 2, 2, None),
            ('e', 'f2', 'train', 'hard', 1, 4, 1, 0, 'z@'),
        ],
    ),
    "predicted": (
        "id string, text string, score double",
        [
            ('a', '가나1', 0.9),
            ('b', 'AC', 0.5),
            ('c', '다 2정', 0.8),
            ('x', '?', 0.1),
        ],
    ),
    "exposed": (
        "family string, source string",
        [
            ('f1', 'old'),
            ('f9', 'old'),
        ],
    ),
    "boxes": (
        "doc string, box string, x0 double, y0 double, x1 double, y1 double",
        [
            ('d1', 'b1', 10.0, 5.0, 20.0, 9.0),
            ('d1', 'b2', 1.0, 5.0, 8.0, 9.0),
            ('d1', 'b3', 0.0, 1.0, 4.0, 3.0),
            ('d2', 'b4', 2.0, 2.0, 6.0, 4.0),
            ('d2', 'b5', 3.0, 2.0, 7.0, 4.0),
        ],
    ),
    "fields": (
        "doc string, field string, wanted string, got string",
        [
            ('d1', 'dose', '1정', '1정'),
            ('d1', 'days', '3', '4'),
            ('d1', 'route', None, 'oral'),
            ('d2', 'dose', '2정', None),
            ('d2', 'days', None, None),
            ('d2', 'route', 'oral', 'oral'),
        ],
    ),
    "models": (
        "model string, gate boolean, recall double, precision double, latency double, grp int",
        [
            ('m1', True, 0.9, 0.8, 12.0, 1),
            ('m2', True, 0.9, 0.85, 30.0, 1),
            ('m3', False, 0.99, 0.9, 5.0, 1),
            ('m4', True, 0.9, 0.8, 10.0, 2),
        ],
    ),
    "metrics": (
        "metric string, value double, least double, most double",
        [
            ('recall', 0.91, 0.9, None),
            ('cer', 0.06, None, 0.05),
            ('precision', 0.8, 0.8, None),
            ('latency', None, None, 100.0),
        ],
    ),
    "checks": (
        "med string, category string, state string, label string",
        [
            ('m1', 'age', 'hit', '연령'),
            ('m1', 'split', 'hit', '분할불가'),
            ('m2', 'dose', 'unknown', '용량'),
            ('m3', 'dose', 'clear', '용량'),
            ('m4', 'age', 'conditional', '연령'),
        ],
    ),
    "evidence": (
        "substance string, dataset string, priority int, name string, rows int",
        [
            ('S1', 'b', 2, 'Alpha', 3),
            ('S1', 'a', 1, '알파', 2),
            ('S1', 'a', 1, 'alpha', 4),
            ('S2', 'c', 5, 'Beta', 1),
            ('S2', 'c', 5, 'beta ', 2),
        ],
    ),
    "current": (
        "person string, med string, mapped boolean, start date, end date",
        [
            ('A', 'm1', False, '2024-01-05', None),
            ('A', 'm2', True, '2024-01-01', '2024-01-02'),
            ('B', 'm3', False, '2023-01-01', '2023-02-01'),
            ('C', 'm4', True, '2024-01-01', None),
        ],
    ),
    "raw_texts": (
        "k long, text string",
        [
            (1, '  가나  '),
            (2, ' \t\n'),
            (3, None),
        ],
    ),
    "date_lines": (
        "k long, text string",
        [
            (4, '20200131'),
            (5, '2020-01-31'),
            (6, '2020.01'),
        ],
    ),
    "status_lines": (
        "k long, text string, day string",
        [
            (7, '정상', None),
            (8, '취하', None),
            (9, '기타', None),
            (10, '기타', '20200131'),
            (11, None, ' '),
        ],
    ),
    "code_lines": (
        "k long, text string",
        [
            (10, 'E1, E2,,E1 '),
        ],
    ),
    "duration_lines": (
        "k long, text string",
        [
            (11, '28일'),
            (12, '2주'),
            (13, '3개월'),
            (14, '0일'),
            (15, None),
        ],
    ),
    "role_lines": (
        "k long, text string",
        [
            (18, '3/4'),
            (19, '2.5정'),
            (20, '1/0'),
            (21, '없음'),
        ],
    ),
    "mixture_lines": (
        "k long, text string",
        [
            (21, '[D000001]Alpha/[D000002]Beta'),
        ],
    ),
    "known_names": (
        "substance_id string, name string, dataset string",
        [
            ('S1', 'alpha', 'a'),
            ('S2', 'beta', 'a'),
            ('S3', 'gamma', 'a'),
            ('S4', 'gamma', 'b'),
        ],
    ),
    "local_names": (
        "name string",
        [
            ('Alpha',),
            ('gamma',),
            ('delta',),
        ],
    ),
    "labels_t": (
        "id string, text string",
        [
            ('a', '가나'),
            ('b', 'AB'),
            ('c', 'abcdefghilmno'),
            ('d', None),
        ],
    ),
}


def columns(name):
    return [tuple(c.split()) for c in GOLDEN[name][0].split(", ")]


def frame(spark, name):
    cols = columns(name)
    raw = spark.createDataFrame(GOLDEN[name][1], ", ".join(f"`{c}` {'string' if t == 'date' else t}" for c, t in cols))
    return raw.select(*(F.col(c).cast(t).alias(c) for c, t in cols))


def literal(v):
    return "NULL" if v is None else str(v) if isinstance(v, (bool, int, float)) else "'" + str(v).replace("'", "''") + "'"


def values(name):
    """The table as a common table expression of DuckDB."""
    cols, rows = columns(name), ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in GOLDEN[name][1])
    casts = ", ".join(f'CAST("{c}" AS {TYPES[t]}) AS "{c}"' for c, t in cols)
    heads = ", ".join('"' + c + '"' for c, _ in cols)
    return f"{name} AS (SELECT {casts} FROM (VALUES {rows}) t({heads}))"
