"""Scalar functions and the line source against small tables of expected values."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from posora.functions import compositions, forms, names, rules
from posora.sources.jsonl import numbered_lines, read_jsonl


def each(spark, function, inputs, kind="string"):
    """Values of function over the inputs, in their order; inputs of more than one column are tuples."""
    rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(inputs)]
    kinds = kind.split()
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"c{k} {t}" for k, t in enumerate(kinds)))
    out = df.select("i", function(*[F.col(f"c{k}") for k in range(len(kinds))]).alias("v")).orderBy("i").collect()
    return [tuple(r.v) if isinstance(r.v, tuple) else r.v for r in out]


def check(spark, function, cases, kind="string"):
    assert each(spark, function, [c for c, _ in cases], kind) == [v for _, v in cases]


def test_clean_and_dates(spark):
    check(spark, names.clean, [(" a\t", "a"), ("  ", None), ("", None), (None, None)])
    check(spark, names.date_text, [("20200102", "2020-01-02"), ("2020. 01. 02", "2020-01-02"), (" x ", "x"), ("2020", "2020"), (" ", None), (None, None)])


def test_first_field(spark):
    cases = [('{" Name ": "a", "name": "b"}', "b"), ('{"other": "c"}', "c"), ('{"NAME": null, "other": "c"}', None), ("{}", None)]
    check(spark, lambda c: names.first_field(F.from_json(c, "map<string,string>"), "name", "OTHER"), cases)


def test_code_lists_and_equal_codes(spark):
    check(spark, names.code_list, [(" b, a,,b ", ["b", "a"]), ("", []), (None, None)])
    check(spark, names.equivalent_code, [("D000195", "D000982"), ("X", "X"), (None, None)])


def test_ingredient_names(spark):
    cases = [
        (" Ｇamma  HCl (분류번호 : 123)", "gamma hcl"), ("Methyl-N/S-Diacetylcysteine", "methyl-n,s-diacetylcysteine"),
        ("(x-N/S-y) / b", "(x-n/s-y)/b"), ("A + B", "a+b"), ("Straße", "strasse"), ("", ""), (None, None),
        ("(]x-n/s-y", "(]x-n/s-y"), ("(])x-n/s-y", "(])x-n,s-y"),
    ]
    check(spark, names.ingredient_name, cases)


def test_moiety_names(spark):
    cases = [
        ("Alpha Hydrochloride Monohydrate", "alpha"), ("Sodium", "sodium"), ("Calcium Sodium", "calcium"), ("Alpha Sodium/Beta Sodium", "alpha sodium/beta sodium"),
        ("X Enteric-coated Granules", "x"), ("Dilute Nitro Solution", "nitro"), ("Dilute Nitro (1 in 10)", "nitro"), ("Nitro Solution", "nitro solution"),
        ("Sodium chloride", "sodium chloride"), (None, None),
    ]
    check(spark, names.moiety_name, cases)


def test_ids_and_signatures(spark):
    import hashlib

    want = "SUB_" + hashlib.sha256(b"a\0b").hexdigest()[:20].upper()
    check(spark, lambda a, b: names.digest_id("SUB", 20, a, b), [(("a", "b"), want)], "string string")
    check(spark, names.set_signature, [(["b", "a", "b"], '["a","b"]'), ([], "[]")], "array<string>")
    check(spark, names.scripts, [("가a", (True, True, False)), ("1", (False, False, True))])


def test_permit_status(spark):
    cases = [(("정상", None), "active"), ((" 취하 ", "20200101"), "withdrawn"), (("?", "20200101"), "inactive_unknown"), ((None, " "), "unknown")]
    check(spark, rules.permit_status, cases, "string string")


def test_dose_thresholds(spark):
    unclear = (None, None, "not_evaluable", rules.DOSE_UNCLEAR)
    missing = (None, None, "not_evaluable", rules.DOSE_MISSING)
    cases = [
        ("가바펜틴 3,600mg", ("3600", "mg", "parsed", None)), ("아미카신 1.5g(역가)", ("1500.0", "mg", "parsed", None)),
        ("폴리트로핀델타 24㎍", ("0.024", "mg", "parsed", None)), ("트리아졸람 0.25밀리그램", ("0.25", "mg", "parsed", None)),
        ("3 캡", ("3", "캡슐", "parsed", None)), ("5. MG", ("5", "mg", "parsed", None)), (".5g", ("500.0", "mg", "parsed", None)),
        ("0.0000001mg", ("0.0000001", "mg", "parsed", None)), ("0mg", unclear), ("10", unclear), ("성인 10mg", unclear),
        ("나프록센 1,250mg 또는 나프록센나트륨 1,350mg", unclear), ("빈크리스틴황산염 주1회 2mg", unclear),
        ("9" * 40 + "mg", unclear), (" ", missing), (None, missing),
    ]
    check(spark, rules.dose_threshold, cases)


def test_durations_and_grades(spark):
    unclear = (None, rules.DURATION_UNCLEAR)
    cases = [
        ("28일", (28, None)), ("28", (28, None)), ("4 주", (28, None)), ("3개월", (None, rules.DURATION_MONTHS)), ("0일", unclear),
        ("약 3일", unclear), ("3년", unclear), ("9" * 18 + "9주", unclear), ("9" * 30, unclear), ("", unclear), (None, unclear),
    ]
    check(spark, rules.duration_days, cases)
    check(spark, rules.pregnancy_grade, [("2 등급(말라리아 치료시 제외)", (2, True)), ("1등급", (1, False)), ("2", (None, False)), (None, (None, None))])


def plain_age(birth, day):
    """Whole years by walking over the birthdays."""
    age = 0
    while True:
        y = birth.year + age + 1
        try:
            birthday = birth.replace(year=y)
        except ValueError:
            birthday = dt.date(y, 2, 28)
        if birthday > day:
            return age
        age += 1


def test_ages(spark):
    births = [dt.date(2000, 2, 29), dt.date(2001, 3, 1), dt.date(1999, 12, 31)]
    days = [dt.date(y, m, d) for y in (1998, 2001, 2004, 2011) for m, d in ((2, 28), (3, 1), (12, 30), (12, 31))]
    cases = [((b, d), max(plain_age(b, d), 0)) for b in births for d in days]
    check(spark, rules.completed_years, cases, "date date")
    b = dt.date(2020, 2, 29)
    cases = [
        (("12세 미만", b, dt.date(2032, 2, 28)), True), (("12세 미만", b, dt.date(2032, 2, 29)), False), (("2세 이하", b, dt.date(2023, 2, 27)), True),
        (("2세 이하", b, dt.date(2023, 2, 28)), False), (("6개월 이상", b, dt.date(2020, 8, 29)), True), (("2주 초과", b, dt.date(2020, 3, 20)), False),
        (("2주 초과", b, dt.date(2020, 3, 21)), True), (("액제: 2세 미만, 정제: 6세 미만", b, b), None), (("소아", b, b), None), (("2세 미만", None, b), None),
        ((None, b, b), None),
    ]
    check(spark, rules.age_rule_applies, cases, "string date date")


def test_course_progress(spark):
    a, z = dt.date(2024, 1, 1), dt.date(2024, 1, 8)
    cases = [
        ((a, z, dt.date(2023, 12, 31)), ("upcoming", 8, 0, 8, 0)), ((a, z, dt.date(2024, 1, 9)), ("completed", 8, 8, 0, 100)),
        ((a, z, a), ("active", 8, 1, 7, 12)), ((a, z, dt.date(2024, 1, 3)), ("active", 8, 3, 5, 38)), ((z, a, a), ("invalid", None, None, None, None)),
        ((None, z, a), None), ((a, None, a), None),
    ]
    check(spark, rules.course_progress, cases, "date date date")


def test_lines_keep_their_numbers_over_many_blocks(spark, tmp_path):
    wanted = {}
    for name, n in (("a.jsonl", 500), ("b.jsonl", 30)):
        lines = ["" if i % 7 == 0 else json.dumps({"k": i, "t": "x" * (i % 50)}) for i in range(1, n + 1)]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
        wanted[name] = [(i, i) for i in range(1, n + 1) if i % 7]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        got = read_jsonl(spark, str(tmp_path), "k int, t string").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name, rows in wanted.items():
        assert sorted((r.source_row, r.k) for r in got if r.file.endswith(name)) == rows


def test_bad_and_empty_lines(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text('{"k": 1}\n{oops\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        read_jsonl(spark, str(tmp_path), "k int").collect()
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "none.jsonl").write_text("\n\n")
    assert numbered_lines(spark, str(tmp_path / "e")).count() == 0


def test_parts_outside_brackets(spark):
    cases = [
        ("A + B/C", ["A", "B", "C"]), ("A (B+C) / D", ["A (B+C)", "D"]), ("x-N/S-y/z", ["x-N/S-y", "z"]), ("[(a]b)+c", ["[(a]b)+c"]),
        ("a)+b", ["a)", "b"]), ("a (b + c", ["a (b + c"]), ("+ /", []), ("", []), (None, []), ("가＋나", ["가", "나"]),
    ]
    check(spark, compositions.split_parts, cases)
    check(spark, lambda c: compositions.split_parts(c, ";", False), [("a+b; c (d;e)", ["a+b", "c (d;e)"])])


def test_atoms(spark):
    text = "Alpha Sodium (정제) + Beta(감마 포함) / 델타(Delta) / Eta (엡실론) / (x) / Zeta (분류번호: 12)"
    rows = spark.createDataFrame([(1, text), (2, None), (3, " ")], "id int, names string")
    got = [tuple(r)[1:] for r in compositions.atoms(rows, "id", "names").orderBy("id", "part").collect()]
    assert got == [
        (0, ["alpha sodium"], "정제", False), (1, ["beta", "감마"], None, True), (2, ["델타", "delta"], None, True),
        (3, ["eta (엡실론)"], None, False), (4, [], None, False), (5, ["zeta"], None, False),
    ]


def test_compositions_resolve_whole_or_not_at_all(spark):
    known = [
        ("k", "Alpha", "D1"), ("k", "Beta Sodium", "D2"), ("k", "Gamma", "D3"), ("k", "Gamma", "D4"), ("m", "Alpha", "D5"), ("m", "Naproxen", "D000195"),
        ("k", None, "D6"), ("k", "Zeta", None), ("k", "Eta Sodium", "D7"), ("k", "Eta Calcium", "D8"), ("m", "Theta", " D9 "),
    ]
    cases = [
        ("Beta + Theta", None, ["D2", "D9"]), ("Alpha", None, None), ("Alpha", "k", ["D1"]), ("alpha hydrochloride/Beta", "k", ["D1", "D2"]),
        ("Gamma", "k", None), ("Beta + Zeta", "k", None), ("Eta", "k", None), ("Naproxen Sodium", "m", ["D000982"]), ("Alpha (정제)", "k", None), (None, "k", None), ("", "k", None),
        ("Beta Potassium + beta sodium", "k", ["D2"]), ("Alpha", None, None),
    ]
    known = spark.createDataFrame(known, "cat string, name string, code string")
    rows = spark.createDataFrame([(i, t, c) for i, (t, c, _) in enumerate(cases)], "id int, text string, cat string")
    everywhere = {r.id: r for r in compositions.resolved(rows.filter("cat IS NULL"), known, "id", "text").collect()}
    within = {r.id: r for r in compositions.resolved(rows.filter("cat IS NOT NULL"), known, "id", "text", "cat").collect()}
    got = {**everywhere, **within}
    assert [got[i].codes for i in range(len(cases))] == [w for _, _, w in cases]
    assert got[0].signature == '["D2","D9"]' and got[1].signature is None
    assert compositions.resolved(rows.limit(0), known, "id", "text").count() == 0


def test_mixtures(spark):
    cases = [
        ("[D000001]Alpha(알파)/[D000002] Beta / ", ([("D000001", "Alpha"), ("D000002", "Beta")], None)), ("[D000001]A[x]/[D000001]A[x]", ([("D000001", "A[x]")], None)),
        ("[D000001]A/[D000001]B", ([], "conflict")), ("A/[D000001]B", ([], "malformed")), ("A", ([], "malformed")), ("[D000001](알파)", ([], "unnamed")),
        (None, ([], None)), (" ", ([], None)),
    ]
    got = each(spark, compositions.mixture, [c for c, _ in cases])
    assert [([tuple(e) for e in entries], reason) for entries, reason in got] == [v for _, v in cases]


def test_form_scopes(spark):
    cases = [
        ((None, None), True), ((" ", "정제"), True), (("정제", None), False), (("정제", "필름코팅정"), True), (("정제", "서방성필름코팅정"), False), (("정제", "장용성 당의정"), False),
        (("캡슐제", "경질캡슐제, 산제"), True), (("산제", "경질캡슐제, 산제"), False), (("액제", "점안액제"), False), (("액제", "경구용액제"), True), (("시럽 / 주사제", "주사액"), True),
        (("서방정", "서방정|정제"), True), (("크림;로션제", "외용로션"), True), (("/", "/"), True), (("연고", "정제"), False), (("필름코팅정", "나정"), False),
    ]
    check(spark, forms.form_scope_applies, cases, "string string")


def test_routes(spark):
    cases = [
        (["필름코팅정", " 캡슐"], "oral"), (["정제", "크림"], "unknown"), (["주사용산제"], "injection"), (["외용산제"], "unknown"), (["산제"], "oral"), (["점안액제"], "ophthalmic"),
        (["붕해정제"], "unknown"), (["기타(정제)"], "oral"), (["피부용액제"], "unknown"), (["외용액제"], "topical"), (["경구액제"], "oral"), ([" ", "나정", None], "oral"), ([], "unknown"), (None, "unknown"),
        (["정제", "?"], "unknown"),
    ]
    check(spark, forms.administration_route, cases, "array<string>")


def test_families(spark):
    cases = [
        ("가나다정 10mg (수출용)", "가나다"), ("가나 연질캡슐 0.5밀리그램", "가나"), ("가정", "가정"), ("가나주사액", "가나"), ("AB-크림 <x>", "ab"), ("(가)", "(가)"), ("", ""), (None, None),
    ]
    check(spark, forms.family_stem, cases)
    import hashlib

    check(spark, lambda c: forms.family_key(c, "ns"), [("가나정", "family-" + hashlib.sha256("ns\0가나".encode()).hexdigest()[:20])])


def test_role_values(spark):
    check(spark, forms.role_value, [("1 / 2 정", 0.5), ("3/0", 3.0), ("약 1.5정", 1.5), ("없음", None), ("", None), (None, None)])


def test_regimens(spark):
    none = ([], None, None, False)
    cases = [
        ("오전 8시, 오후 8시 : 30 식후 복용", (["08:00", "20:30"], "after_meal", "oral", False)), ("AM 12 pm 12:05", (["00:00", "12:05"], None, None, False)),
        ("복용시간 9:00 21:30 9:00", (["09:00", "21:30"], None, "oral", False)), ("9:00", none), ("오후 13시 오전 1:75", none), ("필요시 오전 8시 PRN", ([], None, None, True)),
        ("□ 식후 □ 필요시", none), ("식전 또는 식후", none), ("공복 점안", ([], "empty_stomach", "ophthalmic", False)), ("XPRNX", none), ("", none), (None, none),
        ("식사 와 함께 먹는다", ([], "with_meal", "oral", False)), ("식사중", ([], "with_meal", None, False)), ("식사 관계 없이 PM 3 : 05", (["15:05"], "regardless", None, False)), ("Schedule times 24:00 8：15", (["08:15"], None, None, False)),
        ("as  needed", ([], None, None, True)), ("오후 12시 30", (["12:00"], None, None, False)), ("AM 8am", none), ("귀에 점안", ([], None, "ophthalmic", False)),
    ]
    check(spark, forms.regimen, cases)


def test_age_rules_by_form(spark):
    cases = [
        (None, "정제", None, "missing"), (" ", "정제", None, "missing"), ("해당없음", "정제", None, "unread"), ("12세 미만", None, True, None), ("8세 이하", "나정", False, None),
        ("정제: 12세 미만, 시럽제: 24개월 미만", "필름코팅정", True, None), ("정제: 12세 미만, 시럽제: 24개월 미만", "시럽제", False, None), ("정제: 12세 미만, 시럽제: 24개월 미만", None, None, "product_form"),
        ("정제: 12세 미만, 시럽제: 24개월 미만", "가루", None, "product_form"), ("정제: 12세 미만, 시럽제: 24개월 미만", "주사제", None, "not_one"), ("정제 12세 미만, 시럽제: 24개월 미만", "정제", None, "structure"),
        ("가루: 12세 미만, 시럽제: 24개월 미만", "정제", None, "segment_form"), ("정제, 캡슐제: 3,650일 이상, 좌제: 1주 초과", "캡슐제", True, None), ("정제: 12세 미만, 정제: 3세 미만", "정제", None, "not_one"),
        ("점안액제: 2세 미만, 경구용액: 12세 미만", "액제", True, None),
    ]
    rows = spark.createDataFrame([(i, r, f) for i, (r, f, _, _) in enumerate(cases)], "i int, r string, f string")
    day = F.lit("2024-06-30").cast("date")
    told = {x.i: (x.t.applies, x.t.reason) for x in rows.select("i", rules.age_rule_by_form(F.col("r"), F.col("f"), F.lit("2015-01-01").cast("date"), day).alias("t")).collect()}
    for i, (r, f, applies, reason) in enumerate(cases):
        assert told[i] == (applies, reason), (r, f, told[i])
    unborn = rows.select(rules.age_rule_by_form(F.lit("1세 미만"), F.col("f"), F.lit(None).cast("date"), day).alias("t")).first().t
    assert (unborn.applies, unborn.reason) == (None, "unread")
