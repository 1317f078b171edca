"""Corpus and audit operators against plain versions, and on odd rows."""

import hashlib
import json
import random
from fractions import Fraction
from statistics import median

import pytest
from pyspark.sql import functions as F

from posora.functions.arrays import windows
from posora.operators import digests, division, ordered, pairing, polygons, rule_table, slices, splits, token_matching
from posora.operators.layout import document_lines
from posora.sources import contracts
from posora.sources.published import ManifestError, Published


def plain_split(comps, weights, seed):
    order = sorted(comps.items(), key=lambda c: (-c[1], hashlib.sha256(f"{seed}:{c[0]}".encode()).hexdigest()))
    total, whole, got, out = sum(comps.values()), sum(weights), [0] * len(weights), {}
    taken = [0] * len(weights)
    for i, (name, size) in enumerate(order):
        target = [Fraction(w * total, whole) for w in weights]
        empty = [k for k in range(len(weights)) if not taken[k]]
        among = empty if empty and len(order) - i <= len(empty) else range(len(weights))
        k = max(among, key=lambda k: ((target[k] - got[k]) / max(target[k], 1), -k))
        got[k] += size
        taken[k] += 1
        out[name] = "abcd"[k]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_balanced_split_equals_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    n = rng.choice([1, 2, 3, 4, 40, 150])
    kinds = rng.choice([[1], [1, 2, 3], [5, 7, 1000], range(1, 100)])
    comps = {f"c{i}": rng.choice(list(kinds)) for i in range(n)}
    weights = rng.choice([[8, 1, 1], [1, 1], [3, 2, 2, 1]])
    rows = spark.createDataFrame([*comps.items(), (None, 5)], "component string, size long")
    found = {r.component: r.split for r in splits.balanced_split(rows, list("abcd")[: len(weights)], weights, seed).collect()}
    assert found == plain_split(comps, weights, seed)


def test_balanced_split_of_odd_sizes(spark):
    rows = spark.createDataFrame([("a", None), ("b", 0), ("c", -4), ("d", 1)], "component string, size long")
    found = splits.balanced_split(rows, ["x", "y"], [1, 1]).collect()
    assert {r.size for r in found} == {1} and sorted(r.split for r in found) == ["x", "x", "y", "y"]
    assert splits.balanced_split(rows.limit(0), ["x", "y"], [1, 1]).count() == 0


def plain_lines(boxes):
    slopes = []
    for _, q in boxes:
        for a, b in ((0, 1), (3, 2)):
            dx = q[b][0] - q[a][0]
            if abs(dx) >= 1 and abs((q[b][1] - q[a][1]) / dx) <= 0.35:
                slopes.append((q[b][1] - q[a][1]) / dx)
    slope = median(slopes) if len(slopes) >= 2 else 0.0
    tokens = []
    for name, q in boxes:
        ys = [y - slope * x for x, y in q]
        tokens.append((name, min(x for x, _ in q), (min(ys) + max(ys)) / 2, max(ys) - min(ys)))
    mid = median(t[3] for t in tokens)
    lines = []
    for t in sorted(tokens, key=lambda t: (t[2], t[1], t[0])):
        for line in lines:
            if abs(line["cy"] - t[2]) <= max(mid * 0.65, min(line["h"], t[3]) * 0.7):
                break
        else:
            lines.append(line := {"items": [], "cy": t[2], "h": t[3]})
        line["items"].append(t)
        line["cy"] = sum(i[2] for i in line["items"]) / len(line["items"])
        line["h"] = max(i[3] for i in line["items"])
    lines.sort(key=lambda line: line["cy"])
    return {t[0]: (i, k) for i, line in enumerate(lines) for k, t in enumerate(sorted(line["items"], key=lambda t: (t[1], t[0])))}


def test_lines_equal_a_plain_version(spark):
    rng, rows, want = random.Random(4), [], {}
    for page in range(25):
        boxes, skew = [], rng.uniform(-0.2, 0.2)
        for i in range(rng.randint(1, 60)):
            x, y, w, h = rng.randint(0, 500), rng.randint(0, 12) * 17 + rng.randint(-4, 4), rng.randint(0, 60), rng.randint(6, 40)
            boxes.append((i, [[float(a), b + skew * a] for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]))
        want |= {(page, k): v for k, v in plain_lines(boxes).items()}
        rows += [(page, i, q, "extra") for i, q in boxes]
    bad = [None, [], [[0.0, 0.0]] * 3, [[0.0, float("nan")]] * 4, [[0.0]] * 4, [[0.0, None]] * 4, [None] * 4]
    rows += [(1, 1000 + i, q, None) for i, q in enumerate(bad)] + [(None, 1, rows[0][2], None)]
    df = spark.createDataFrame(rows, "page long, box long, q array<array<double>>, line string")
    found = {(r.page, r.box): (r.line, r.place) for r in document_lines(df, "page", "box", "q").collect()}
    assert found == want
    assert document_lines(df.limit(0), "page", "box", "q").count() == 0


def plain_greedy(pairs):
    left, right, out = set(), set(), []
    for p in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if p[0] not in left and p[1] not in right:
            left.add(p[0])
            right.add(p[1])
            out.append(p)
    return sorted(out)


def test_greedy_matching_equals_the_sequential_rule(spark):
    rng = random.Random(5)
    for n, scores in ((0, 3), (30, 3), (300, 10), (300, 1000)):
        pairs = list({(a, b): (a, b, rng.randint(1, scores) / 4) for a, b in ((rng.randint(0, 25), rng.randint(0, 25)) for _ in range(n))}.values())
        odd = [(None, 1, 9.0, "x"), (1, None, 9.0, "x")]
        df = spark.createDataFrame([(*p, "x") for p in pairs + pairs[:5]] + odd, "l long, r long, score double, o string")
        found = sorted((r.l, r.r, r.score) for r in pairing.greedy_matching(df, "l", "r", [-F.col("score")]).collect())
        assert found == plain_greedy(pairs)
    chain = [(i // 2, (i + 1) // 2, float(i)) for i in range(14)]  # each pair waits for a better neighbour
    df = spark.createDataFrame(chain, "l long, r long, score double")
    assert sorted((r.l, r.r, r.score) for r in pairing.greedy_matching(df, "l", "r", [-F.col("score")]).collect()) == plain_greedy(chain)


def plain_area(p):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1], strict=True)) / 2


def plain_clip(subject, clip):
    turn = -1 if plain_area(clip) < 0 else 1
    for c, d in zip(clip, clip[1:] + clip[:1], strict=True):
        side = [((d[0] - c[0]) * (p[1] - c[1]) - (d[1] - c[1]) * (p[0] - c[0])) * turn for p in subject]
        out = []
        for i, q in enumerate(subject):
            p, sp, sq = subject[i - 1], side[i - 1], side[i]
            if (sp >= -1e-9) != (sq >= -1e-9):
                t = sp / (sp - sq)
                out.append([p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])])
            if sq >= -1e-9:
                out.append(q)
        subject = out
    return abs(plain_area(subject)) if len(subject) >= 3 else 0.0


def convex(rng):
    import math

    x, y, r, k = rng.uniform(-50, 50), rng.uniform(-50, 50), rng.uniform(2, 30), rng.randint(3, 7)
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(k))
    p = [[x + r * math.cos(t), y + r * math.sin(t)] for t in turns]
    return p[::-1] if rng.random() < 0.5 else p


def test_overlaps_equal_a_plain_version_at_every_cell_size(spark):
    rng = random.Random(6)
    left, right = {i: convex(rng) for i in range(40)}, {100 + i: convex(rng) for i in range(40)}
    want = {}
    for i, a in left.items():
        for j, b in right.items():
            if i % 2 == j % 2 and (v := plain_clip(a, b)) > 1e-6:
                want[i, j] = v
    bad = [(500, 0, None), (501, 0, [[0.0, 0.0], [9.0, 9.0]]), (None, 0, left[0]), (502, None, left[0])]
    kind = "id long, scene long, polygon array<array<double>>, n int"
    a = spark.createDataFrame([(i, i % 2, p, 1) for i, p in left.items()] + [(*r, 1) for r in bad], kind)
    b = spark.createDataFrame([(i, i % 2, p, 1) for i, p in right.items()] + [(*r, 1) for r in bad], kind)
    for cell in (3.0, 20.0, 1000.0):
        rows = polygons.overlapping(a, b, cell, "scene").filter("intersection > 1e-6").collect()
        found = {(r.left_id, r.right_id): r.intersection for r in rows if r.left_id < 100}
        assert len(rows) == len({(r.left_id, r.right_id) for r in rows})
        assert found.keys() == want.keys() and all(abs(found[k] - v) < 1e-6 for k, v in want.items())
        one = rows[0]
        ax, bx = abs(plain_area(left[one.left_id])), abs(plain_area(right[one.right_id]))
        assert abs(one.iou - one.intersection / (ax + bx - one.intersection)) < 1e-9 and abs(one.fraction_a - one.intersection / ax) < 1e-9
    assert polygons.overlapping(a.limit(0), b, 5.0).count() == 0


def test_detection_errors(spark):
    pairs = [(1, 1, 10, 0.9, 0.2), (1, 2, 10, 0.6, 0.2), (1, 3, 11, 0.3, 0.9), (1, 3, 12, 0.2, 0.5), (2, 5, 20, 0.1, 0.1)]
    df = spark.createDataFrame(pairs, "scene long, left_id long, right_id long, fraction_a double, fraction_b double")
    groups = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (1, 3, "y"), (2, 5, None)], "scene long, left_id long, group_id string")
    assert sorted(tuple(r) for r in polygons.detection_errors(df, groups, "scene").collect()) == [(1, 1, 1, 1), (2, 0, 0, 0)]


def test_division(spark):
    parts = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", 1), ("c", 3), ("d", None), ("d", 1), (None, 1)], "w string, p long")
    offers = spark.createDataFrame([(1, "x"), (1, "x"), (2, "x"), (1, "y"), (None, "x"), (3, None)], "p long, t string")
    assert sorted(tuple(r) for r in division.divided(parts, offers, "w", "p", "t").collect()) == [("a", "x"), ("b", "x"), ("b", "y")]
    named = spark.createDataFrame([("a", 1, "k"), ("a", 2, "l"), ("b", 1, "k"), ("c", 1, "k"), ("c", 2, "m"), ("d", 1, None), ("e", 1, "k"), ("e", 1, "k2")], "w string, p long, n string")
    names = spark.createDataFrame([("k", "s1"), ("k2", "s1"), ("l", "s2"), ("m", "s1"), ("m", "s2")], "n string, t string")
    found = {r.w: (r.n_parts, r.targets, r.outcome) for r in division.resolved_by_all_parts(named, names, "w", "p", "n", "t").collect()}
    assert found == {"a": (2, ["s1", "s2"], "several"), "b": (1, ["s1"], "one"), "c": (2, [], "none"), "d": (1, [], "none"), "e": (1, ["s1"], "one")}


def test_digests_depend_on_rows_alone_and_tell_where_tables_differ(spark):
    rows = [(i, ["a", None, "x\ny", "\x1f", "\\N", "é"][i % 6], i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, v string, n int")
    line = digests.line_of("k", "v")
    ways = [f(d, ["k"], F.shiftright("k", 4), line) for d in (df, df.repartition(7), df.orderBy(F.desc("k"))) for f in (digests.range_digests, digests.range_digests_streamed)]
    tables = [sorted(tuple(r) for r in w.collect()) for w in ways]
    assert all(t == tables[0] for t in tables) and len(tables[0]) == 19
    roots = {tuple(digests.merkle_root(w, 2).first()) for w in ways[:3]}
    assert len(roots) == 1 and roots.pop()[0] == 300
    other = df.withColumn("v", F.when(F.col("k") == 100, "z").otherwise(F.col("v"))).filter("k < 288")
    differ = digests.differing_ranges(ways[0], digests.range_digests(other, ["k"], F.shiftright("k", 4), line)).collect()
    assert sorted(tuple(r) for r in differ) == [(6, 16, 16), (18, 12, None)]
    assert digests.merkle_root(ways[0].limit(0), 2).count() == 0
    with pytest.raises(Exception, match="more ranges"):
        digests.merkle_root(ways[0], 1).collect()
    pairs = spark.createDataFrame([("a\x1fb", "c"), ("a", "b\x1fc"), ("\\N", "c"), (None, "c"), ("a\nb", "c")], "x string, y string")
    assert pairs.select(digests.line_of("x", "y").alias("l")).distinct().count() == 5


def test_first_rule_whose_base_is_known_wins(spark):
    rules = [rule_table.Rule("salt", "^(.+) (?:sodium|acetate)$"), rule_table.Rule("form", r"^(.+) \w+$"), rule_table.Rule("self", "^(.*)$")]
    names = spark.createDataFrame([("a sodium",), ("b sodium",), ("c d sodium",), ("a",), (None,), (" sodium",), ("a sodium",)], "name string")
    known = spark.createDataFrame([("a",), ("c d",), (None,), ("b",), ("b",)], "base string")
    found = {tuple(r) for r in rule_table.first_rules(names, rules, known).collect()}
    assert found == {("a sodium", "salt", "a", 1), ("b sodium", "salt", "b", 1), ("c d sodium", "salt", "c d", 1)}
    assert rule_table.first_rules(names, rules, known.filter("base = 'c d sodium'")).count() == 0


def test_slices_count_in_one_pass(spark):
    rows = spark.createDataFrame([(1, 5), (2, None), (3, 50), (3, 50), (None, 7)], "id long, v long")
    found = {r.slice: (r.n, int(r.fingerprint)) for r in slices.slice_plan(rows, {"big": F.col("v") > 6, "odd": F.col("id") % 2 == 1}, "id").collect()}
    part = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:12], 16)
    assert found == {"all": (5, part(1) + part(2) + 2 * part(3)), "big": (3, 2 * part(3)), "odd": (3, part(1) + 2 * part(3)), "big&odd": (2, 2 * part(3))}
    assert {r.slice for r in slices.slice_plan(rows, {"big": F.col("v") > 6}, "id", least=4).collect()} == {"all"}
    with pytest.raises(ValueError, match="62"):
        slices.slice_plan(rows, {str(i): F.lit(True) for i in range(63)}, "id")


def test_tokens_and_lines_are_used_once(spark):
    expected = spark.createDataFrame([(1, t) for t in ["a", "a", "b", None]] + [(2, "a")], "k long, token string")
    found = spark.createDataFrame([(1, t) for t in ["a", "b", "b", "c"]] + [(3, "z")], "k long, token string")
    assert sorted(tuple(r) for r in token_matching.consumed_tokens(expected, found, ["k"]).collect()) == [(1, 3, 4, 2), (2, 1, 0, 0), (3, 0, 1, 0)]
    pages = spark.createDataFrame([(1, [["a", "b"], ["a"], [], ["q"], ["a"]], [["a"], ["b", "a"], ["c"], ["a", "x"]]), (2, None, [["a"]]), (3, [["a"]], None)], "k long, e array<array<string>>, f array<array<string>>")
    rows = {r.k: (r.n_lines, r.n_matched, r.adjacent, r.in_order) for r in token_matching.matched_lines(pages, "e", "f").collect()}
    assert rows == {1: (5, 4, 2, 1), 2: (0, 0, 0, 0), 3: (1, 0, 0, 0)}
    numbered = token_matching.occurrence_numbers(expected.withColumn("at", F.monotonically_increasing_id()), ["k"], "token", ["at"]).filter("token = 'a'").collect()
    assert sorted((r.k, r.occurrence) for r in numbered) == [(1, 1), (1, 2), (2, 1)]
    texts = spark.createDataFrame([(["a", "b", "c", "d"],), (["a", "b"],), ([],), (None,)], "w array<string>")
    assert [r[0] for r in texts.select(windows(F.col("w"), 3)).collect()] == [["a b c", "b c d"], [], [], None]


def test_published_versions_are_audited(spark, tmp_path):
    shelf = Published(spark, f"file://{tmp_path}/table")
    with pytest.raises(ManifestError, match="nothing"):
        shelf.read()
    one = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    assert shelf.publish(one) == 1 and sorted(tuple(r) for r in shelf.read().collect()) == [(1, "a"), (2, None)]

    def refuse(written):
        raise ValueError("no")

    with pytest.raises(ValueError, match="no"):
        shelf.publish(one.limit(1), refuse)
    assert shelf.current() == 1 and shelf.publish(one.limit(0)) == 2 and shelf.read().count() == 0 and shelf.read(1).count() == 2
    assert not [p for p in (tmp_path / "table").iterdir() if "aside" in p.name]
    one.union(one).write.mode("append").parquet(f"{tmp_path}/table/v000001/data")
    with pytest.raises(ManifestError, match="isn't what"):
        shelf.read(1)
    manifest = tmp_path / "table/v000002/manifest.json"
    assert json.loads(manifest.read_text())["rows"] == 0
    manifest.unlink()
    with pytest.raises(ManifestError, match="no manifest"):
        shelf.read()


def test_contracts_name_each_broken_rule(spark, tmp_path):
    contract = contracts.Contract({"id": "bigint", "name": "string"}, {"id_above_0": F.col("record.id") > 0})
    lines = ['{"id": 1, "name": "a"}', "", '{"id": 0, "name": "b"}', '{"id": 2}', '{"id": 3, "name": null, "more": 1}', "no json", "[1]", '{"name": "x", "id": "y"}']
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    (tmp_path / "b.jsonl").write_text("")
    rows = contracts.read_strict(spark, str(tmp_path), contract).collect()
    assert {r.row: r.broken for r in rows} == {1: [], 3: ["id_above_0"], 4: ["keys", "type:name"], 5: ["keys", "type:name"], 6: ["object"], 7: ["object"], 8: ["type:id", "id_above_0"]}
    prints = {r.file.rsplit("/", 1)[1]: (r.bytes, r.sha256) for r in contracts.fingerprints(spark, str(tmp_path)).collect()}
    whole = "\n".join(lines).encode()
    assert prints == {"a.jsonl": (len(whole), hashlib.sha256(whole).hexdigest())}
    keyed = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("b", None), (None, "y"), (None, "z")], "k string, v string")
    assert sorted((r.k or "", r.n) for r in contracts.repeated_keys(keyed, ["k"]).collect()) == [("", 2), ("a", 2), ("b", 2)]
    assert sorted((r.k or "", r.n_values) for r in contracts.mixed_values(keyed, "k", "v").collect()) == [("", 2), ("b", 2)]


def test_places_have_no_gaps(spark):
    rng = random.Random(11)
    rows = [(rng.randint(0, 50) if i % 7 else None, i) for i in range(500)]
    df = spark.createDataFrame(rows, "v long, k long").repartition(7)
    found = {r.k: r.place for r in ordered.numbered(df, [F.col("v").asc_nulls_first(), F.col("k")]).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert found == {k: i for i, (_, k) in enumerate(order, 1)}
    ties = ordered.numbered(df, [F.col("v")]).collect()
    assert sorted(r.place for r in ties) == list(range(1, 501))
    assert ordered.numbered(df.limit(0), [F.col("v")]).count() == 0
    assert [tuple(r) for r in ordered.dictionary([(df.limit(0), "v"), (spark.createDataFrame([(3,), (1,), (None,), (3,)], "x long"), "x")]).orderBy("id").collect()] == [(1, 1), (3, 2)]
