"""Corpus and audit operators as queries over the driver's tables, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from posora.functions.arrays import windows
from posora.operators.digests import line_of, merkle_root, range_digests, range_digests_streamed
from posora.operators.division import divided, resolved_by_all_parts
from posora.operators.layout import document_lines, reading_order
from posora.operators.pairing import greedy_matching
from posora.operators.polygons import detection_errors, overlapping
from posora.operators.relational import query, read
from posora.operators.rule_table import Rule, first_rules
from posora.operators.slices import slice_plan
from posora.operators.splits import balanced_split, component_sizes, exposure_split
from posora.operators.token_matching import consumed_tokens, matched_lines, words
from posora.scratch import Scratch
from posora.sources.contracts import Contract, broken_rules, mixed_values, repeated_keys, strict_json
from posora.sources.published import Published

WORDS_SQL = r"list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


@query("""
    WITH RECURSIVE comps AS (SELECT md5(text) AS component, greatest(sum(n_chars), 1)::BIGINT AS size FROM documents WHERE text IS NOT NULL GROUP BY text),
    o AS (SELECT *, row_number() OVER (ORDER BY size DESC, sha256('7:' || component)) AS i, count(*) OVER () AS n FROM comps),
    walk AS (
        SELECT 0::BIGINT AS i, '' AS component, 0::BIGINT AS size, '' AS split, 0::HUGEINT AS a, 0::HUGEINT AS b, 0::HUGEINT AS c
        UNION ALL
        SELECT i, component, size, split, a + CASE split WHEN 'train' THEN size ELSE 0 END, b + CASE split WHEN 'val' THEN size ELSE 0 END, c + CASE split WHEN 'test' THEN size ELSE 0 END
        FROM (
            SELECT o.i, o.component, o.size, w.a, w.b, w.c,
                   CASE WHEN forced AND w.a = 0 THEN 'train' WHEN forced AND w.b = 0 THEN 'val' WHEN forced THEN 'test'
                        WHEN w.a <= 8 * w.b AND w.a <= 8 * w.c THEN 'train' WHEN w.b <= w.c THEN 'val' ELSE 'test' END AS split
            FROM (SELECT w.*, o2.n - o2.i + 1 <= (w.a = 0)::INT + (w.b = 0)::INT + (w.c = 0)::INT AS forced FROM walk w JOIN o o2 ON o2.i = w.i + 1) w JOIN o ON o.i = w.i + 1
        )
    )
    SELECT component, size, split FROM walk WHERE i > 0
""")
def balanced_documents(spark, sf_dir):
    """Texts, copies together, dealt to three parts by characters."""
    docs = read(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.md5(F.col("text").cast("binary")).alias("c"), "n_chars")
    return balanced_split(component_sizes(docs, "c", "n_chars"), ["train", "val", "test"], [8, 1, 1], seed=7)


def word_boxes(spark, sf_dir):
    """A box for each word of a conversation, laid out in skewed lines that jitter."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(words(F.col("text"))).alias("k", "w"))
    k, n = F.col("k"), F.length("w")
    x1 = (k % 8) * F.lit(90.0)
    x2 = x1 + F.lit(8.0) * F.least(n, F.lit(11))
    top = F.col("turn") * 200.0 + F.floor(k / 8) * 22.0 + ((n * 7 + k * 3) % 9 - 4)
    bottom = top + 10 + n % 5
    skew = (F.col("conv_id") % 7 - 3) * F.lit(0.02)
    corners = F.array(*(F.array(x, y + skew * x) for x, y in ((x1, top), (x2, top), (x2, bottom), (x1, bottom))))
    return turns.select("conv_id", (F.col("turn") * 100000 + k).alias("box_id"), corners.alias("corners"))


BOXES_SQL = f"""
    words AS (SELECT conv_id, turn, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS k FROM (SELECT conv_id, turn, {WORDS_SQL} AS w FROM conversations WHERE text IS NOT NULL)),
    laid AS (
        SELECT conv_id, turn * 100000 + k AS box_id, (k % 8) * 90.0::DOUBLE AS x1, (k % 8) * 90.0::DOUBLE + 8.0::DOUBLE * least(length(w), 11) AS x2,
               turn * 200.0::DOUBLE + (k // 8) * 22.0::DOUBLE + ((length(w) * 7 + k * 3) % 9 - 4) AS top, length(w) % 5 AS extra, (conv_id % 7 - 3) * 0.02::DOUBLE AS skew
        FROM words
    ),
    boxes AS (
        SELECT conv_id, box_id, x1, x2, top + skew * x1 AS y_ul, top + skew * x2 AS y_ur, top + 10 + extra + skew * x2 AS y_lr, top + 10 + extra + skew * x1 AS y_ll FROM laid
    )
"""


@query(f"""
    WITH RECURSIVE {BOXES_SQL},
    slopes AS (
        SELECT conv_id, CASE WHEN count(s) >= 2 THEN median(s) ELSE 0.0 END AS slope
        FROM (SELECT conv_id, CASE WHEN abs(x2 - x1) >= 1 AND abs(s) <= 0.35 THEN s END AS s FROM (SELECT *, unnest([(y_ur - y_ul) / (x2 - x1), (y_lr - y_ll) / (x2 - x1)]) AS s FROM boxes)) GROUP BY conv_id
    ),
    flat AS (
        SELECT conv_id, box_id, x1, slope, least(y_ul - slope * x1, y_ur - slope * x2, y_lr - slope * x2, y_ll - slope * x1) AS low, greatest(y_ul - slope * x1, y_ur - slope * x2, y_lr - slope * x2, y_ll - slope * x1) AS high
        FROM boxes JOIN slopes USING (conv_id)
    ),
    tokens AS (
        SELECT *, (low + high) / 2 AS cy, high - low AS h, median(high - low) OVER (PARTITION BY conv_id) AS med,
               row_number() OVER (PARTITION BY conv_id ORDER BY (low + high) / 2, x1, box_id) AS i
        FROM flat
    ),
    walk AS (
        SELECT conv_id, 0::BIGINT AS i, 0::BIGINT AS box_id, 0::BIGINT AS made, []::STRUCT(s DOUBLE, n BIGINT, h DOUBLE)[] AS lines FROM (SELECT DISTINCT conv_id FROM tokens)
        UNION ALL
        SELECT conv_id, i, box_id, made, CASE WHEN made > len(lines) THEN list_append(lines, {{'s': cy, 'n': 1, 'h': h}})
               ELSE list_transform(lines, lambda l, j: CASE WHEN j = made THEN {{'s': l.s + cy, 'n': l.n + 1, 'h': greatest(l.h, h)}} ELSE l END) END
        FROM (
            SELECT t.conv_id, t.i, t.box_id, t.cy, t.h, w.lines, coalesce(list_filter(range(1, len(w.lines) + 1), lambda j: abs(w.lines[j].s / w.lines[j].n - t.cy) <= greatest(t.med * 0.65, least(w.lines[j].h, t.h) * 0.7))[1], len(w.lines) + 1) AS made
            FROM walk w JOIN tokens t ON t.conv_id = w.conv_id AND t.i = w.i + 1
        )
    ),
    ends AS (SELECT conv_id, arg_max(lines, i) AS lines FROM walk GROUP BY conv_id),
    ranked AS (
        SELECT conv_id, made, row_number() OVER (PARTITION BY conv_id ORDER BY mean, made) - 1 AS line
        FROM (SELECT conv_id, unnest(range(1, len(lines) + 1)) AS made, unnest(list_transform(lines, lambda l: l.s / l.n)) AS mean FROM ends)
    )
    SELECT w.conv_id, w.box_id, r.line, row_number() OVER (PARTITION BY w.conv_id, r.line ORDER BY t.x1, w.box_id) - 1 AS place, round(t.cy, 4) AS cy, round(t.slope, 6) AS slope, round(t.med, 6) AS median_height
    FROM walk w JOIN ranked r USING (conv_id, made) JOIN tokens t ON t.conv_id = w.conv_id AND t.i = w.i
""")
def page_lines(spark, sf_dir):
    """Lines of words as a recogniser would have found them on the page."""
    found = document_lines(word_boxes(spark, sf_dir), "conv_id", "box_id", "corners")
    return found.select("conv_id", "box_id", "line", "place", F.round("cy", 4).alias("cy"), F.round("slope", 6).alias("slope"), F.round("median_height", 6).alias("median_height"))


@query(f"""
    WITH RECURSIVE {BOXES_SQL},
    o AS (SELECT conv_id, box_id, x1 AS x, y_ul AS y, row_number() OVER (PARTITION BY conv_id ORDER BY y_ul, x1, box_id) AS i FROM boxes),
    walk AS (
        SELECT DISTINCT conv_id, 0::BIGINT AS i, []::STRUCT(b BIGINT, x DOUBLE, y DOUBLE)[] AS l FROM o
        UNION ALL
        SELECT conv_id, i, l[1:k] || [{{'b': box_id, 'x': x, 'y': y}}] || l[k + 1:] FROM (
            SELECT o.*, w.l, coalesce(list_max(list_filter(range(1, len(w.l) + 1), lambda j: NOT (abs(o.y - w.l[j].y) < 10 AND o.x < w.l[j].x))), 0) AS k FROM walk w JOIN o ON o.conv_id = w.conv_id AND o.i = w.i + 1
        )
    ),
    ends AS (SELECT conv_id, arg_max(l, i) AS l FROM walk GROUP BY conv_id)
    SELECT conv_id, unnest(list_transform(l, lambda e: e.b)) AS box_id, unnest(range(len(l))) AS place FROM ends
""")
def page_reading_order(spark, sf_dir):
    """Words in the order in which rows of them are read."""
    return reading_order(word_boxes(spark, sf_dir), "conv_id", "box_id", "corners")


@query("""
    WITH RECURSIVE c AS (SELECT p_partkey, p_name || ' ' || p_size AS family FROM part), seen AS (SELECT DISTINCT p_name || ' ' || (s_suppkey % 40) AS family FROM part, supplier WHERE p_partkey = s_suppkey * 3),
    fresh AS (SELECT family, count(*) AS n FROM c WHERE family NOT IN (SELECT family FROM seen) GROUP BY family),
    o AS (SELECT *, row_number() OVER (ORDER BY n DESC, sha256('3:' || family), family) AS i, count(*) OVER () AS k FROM fresh),
    walk AS (
        SELECT 0::BIGINT AS i, NULL::VARCHAR AS family, NULL::VARCHAR AS split, 0::BIGINT AS a, 0::BIGINT AS b
        UNION ALL
        SELECT o.i, o.family, CASE WHEN CASE WHEN o.k - o.i < 1 AND w.b = 0 THEN false ELSE w.a <= w.b END THEN 'val' ELSE 'test' END, w.a + CASE WHEN w.a <= w.b AND NOT (o.k - o.i < 1 AND w.b = 0) THEN o.n ELSE 0 END,
               w.b + CASE WHEN w.a <= w.b AND NOT (o.k - o.i < 1 AND w.b = 0) THEN 0 ELSE o.n END FROM walk w JOIN o ON o.i = w.i + 1
    )
    SELECT c.p_partkey, c.family, coalesce(w.split, 'train') AS split FROM c LEFT JOIN walk w ON w.family = c.family
""")
def unseen_family_split(spark, sf_dir):
    """Products whose families were seen before train; the others are balanced over val and test."""
    part, supplier = read(spark, sf_dir, "part"), read(spark, sf_dir, "supplier")
    catalog = part.select("p_partkey", F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("family"))
    exposed = part.join(supplier, F.col("p_partkey") == F.col("s_suppkey") * 3).select(F.concat_ws(" ", "p_name", (F.col("s_suppkey") % 40).cast("string")).alias("family"))
    return exposure_split(catalog, exposed, "family", seed=3)


def shingles(text):
    """The distinct three-word shingles of a text."""
    return F.array_distinct(windows(words(text), 3))


def contaminations(spark, sf_dir, least):
    """(doc_id, item_id, coverage, share) of documents that hold at least the share ``least`` of a benchmark passage's three-word shingles.

    Shingles are exploded where they are made: as a column they would be made again for each expression that reads it.
    Only documents that hold so much are asked how many they have.
    """
    docs, items = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    wanted = items.select("item_id", F.explode(shingles(F.col("text"))).alias("shingle"))
    sizes = wanted.groupBy("item_id").agg(F.count("*").alias("n_item"))
    shared = docs.select("doc_id", F.explode(shingles(F.col("text"))).alias("shingle")).join(wanted, "shingle").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))
    met = shared.join(sizes, "item_id").withColumn("coverage", F.col("shared") / F.col("n_item"))
    near = Scratch(spark).save(met.filter(F.col("coverage") >= least))
    own = docs.join(near.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.sum(F.size(shingles(F.col("text")))).alias("n_doc"))
    return near.join(own, "doc_id").select("doc_id", "item_id", "coverage", (F.col("shared") / F.col("n_doc")).alias("share"))


@query(f"""
    WITH RECURSIVE d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents), b AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
    ds AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS s FROM d WHERE len(w) >= 3),
    bs AS (SELECT item_id, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS s FROM b WHERE len(w) >= 3),
    pairs AS (
        SELECT doc_id, item_id, count(*) * 1.0::DOUBLE / any_value(nb) AS coverage, count(*) * 1.0::DOUBLE / any_value(nd) AS share
        FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS nd FROM ds) x JOIN (SELECT *, count(*) OVER (PARTITION BY item_id) AS nb FROM bs) y USING (s) GROUP BY doc_id, item_id
    ),
    o AS (SELECT *, row_number() OVER (ORDER BY coverage DESC, share DESC, doc_id, item_id) AS i FROM pairs WHERE coverage >= 0.8),
    walk AS (
        SELECT 0::BIGINT AS i, []::BIGINT[] AS docs, []::BIGINT[] AS items, false AS won, 0::BIGINT AS doc_id, 0::BIGINT AS item_id, 0.0::DOUBLE AS coverage, 0.0::DOUBLE AS share
        UNION ALL
        SELECT o.i, CASE WHEN free THEN list_append(docs, o.doc_id) ELSE docs END, CASE WHEN free THEN list_append(items, o.item_id) ELSE items END, free, o.doc_id, o.item_id, o.coverage, o.share
        FROM (SELECT w.docs, w.items, o.*, NOT list_contains(w.docs, o.doc_id) AND NOT list_contains(w.items, o.item_id) AS free FROM walk w JOIN o ON o.i = w.i + 1) o
    )
    SELECT doc_id, item_id, round(coverage, 6) AS coverage, round(share, 6) AS share FROM walk WHERE won
""")
def passage_matching(spark, sf_dir):
    """Each benchmark passage with the document that holds most of it, one to one."""
    won = greedy_matching(contaminations(spark, sf_dir, 0.8), "doc_id", "item_id", [-F.col("coverage"), -F.col("share")])
    return won.select("doc_id", "item_id", F.round("coverage", 6).alias("coverage"), F.round("share", 6).alias("share"))


def regions(spark, sf_dir, odd: int):
    """Parallelograms from the first entries of embeddings, twenty of each side in a scene."""
    e = [F.element_at("embedding", i).cast("double") for i in range(1, 7)]
    x, y, w, h, s = e[0] * 300, e[1] * 300, 20 + 100 * F.abs(e[2]), 20 + 100 * F.abs(e[3]), 40 * e[4]
    corners = F.array(F.array(x - w - s, y - h), F.array(x + w - s, y - h), F.array(x + w + s, y + h), F.array(x - w + s, y + h))
    rows = read(spark, sf_dir, "embeddings").filter(F.col("vec_id") % 2 == odd)
    return rows.select(F.floor(F.col("vec_id") / 40).alias("scene"), F.col("vec_id").alias("id"), corners.alias("polygon"), (F.col("label") % 3).alias("group_id"))


def _clip_sql() -> str:
    """Sutherland-Hodgman, one table for each edge of the clip."""
    area = "abs(list_sum(list_transform(range(1, len({p}) + 1), lambda i: {p}[i].x * {p}[i % len({p}) + 1].y - {p}[i % len({p}) + 1].x * {p}[i].y))) / 2"
    shapes = """
        raw AS (SELECT vec_id, vec_id // 40 AS scene, label % 3 AS group_id, embedding[1]::DOUBLE * 300 AS x, embedding[2]::DOUBLE * 300 AS y, 20 + 100 * abs(embedding[3]::DOUBLE) AS w, 20 + 100 * abs(embedding[4]::DOUBLE) AS h, 40 * embedding[5]::DOUBLE AS s FROM embeddings),
        quads AS (SELECT vec_id, scene, group_id, [{'x': x - w - s, 'y': y - h}, {'x': x + w - s, 'y': y - h}, {'x': x + w + s, 'y': y + h}, {'x': x - w + s, 'y': y + h}] AS p FROM raw),
        c0 AS (SELECT a.scene, a.vec_id AS left_id, b.vec_id AS right_id, a.p AS a, b.p AS b, a.p AS p, CASE WHEN list_sum(list_transform(range(1, 5), lambda i: b.p[i].x * b.p[i % 4 + 1].y - b.p[i % 4 + 1].x * b.p[i].y)) < 0 THEN -1.0 ELSE 1.0 END AS turn
               FROM quads a JOIN quads b ON a.scene = b.scene AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1)"""
    for k in range(4):
        c, d = f"b[{k + 1}]", f"b[{k % 4 + 2 if k < 3 else 1}]"
        inside = f"(({d}.x - {c}.x) * (v.{{v}}.y - {c}.y) - ({d}.y - {c}.y) * (v.{{v}}.x - {c}.x)) * turn >= -1e-9"
        down = f"((v.a.x - v.b.x) * ({c}.y - {d}.y) - (v.a.y - v.b.y) * ({c}.x - {d}.x))"
        ab, cd = "(v.a.x * v.b.y - v.a.y * v.b.x)", f"({c}.x * {d}.y - {c}.y * {d}.x)"
        cross = f"CASE WHEN abs({down}) < 1e-9 THEN v.b ELSE {{'x': ({ab} * ({c}.x - {d}.x) - (v.a.x - v.b.x) * {cd}) / {down}, 'y': ({ab} * ({c}.y - {d}.y) - (v.a.y - v.b.y) * {cd}) / {down}}} END"
        step = f"CASE WHEN {inside.format(v='b')} THEN CASE WHEN {inside.format(v='a')} THEN [v.b] ELSE [{cross}, v.b] END WHEN {inside.format(v='a')} THEN [{cross}] ELSE [] END"
        shapes += f""",
        c{k + 1} AS (SELECT scene, left_id, right_id, a, b, turn, CASE WHEN len(p) = 0 THEN p ELSE flatten(list_transform(list_transform(range(1, len(p) + 1), lambda i: {{'a': p[CASE WHEN i = 1 THEN len(p) ELSE i - 1 END], 'b': p[i]}}), lambda v: {step})) END AS p FROM c{k})"""
    return shapes + f""",
        areas AS (SELECT scene, left_id, right_id, {area.format(p="a")} AS aa, {area.format(p="b")} AS ab, CASE WHEN len(p) >= 3 THEN {area.format(p="p")} ELSE 0.0 END AS i FROM c4),
        meets AS (SELECT scene, left_id, right_id, i AS intersection, i / (aa + ab - i) AS iou, i / aa AS fraction_a, i / ab AS fraction_b FROM areas WHERE i > 0)"""


CLIP_SQL = _clip_sql()


@query(f"""
    WITH {CLIP_SQL}
    SELECT scene, left_id, right_id, round(intersection, 3) AS intersection, round(iou, 6) AS iou, round(fraction_a, 6) AS fraction_a, round(fraction_b, 6) AS fraction_b FROM meets WHERE intersection > 0.001
""")
def polygon_overlaps(spark, sf_dir):
    pairs = overlapping(regions(spark, sf_dir, 0), regions(spark, sf_dir, 1), cell=100.0, scene="scene").filter("intersection > 0.001")
    return pairs.select("scene", "left_id", "right_id", F.round("intersection", 3).alias("intersection"), *(F.round(c, 6).alias(c) for c in ("iou", "fraction_a", "fraction_b")))


@query(f"""
    WITH RECURSIVE {CLIP_SQL},
    o AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY round(fraction_a, 9) DESC, round(fraction_b, 9) DESC, left_id, right_id) AS k FROM meets WHERE fraction_a >= 0.4),
    walk AS (
        SELECT DISTINCT scene, 0::BIGINT AS k, []::BIGINT[] AS used, 0::BIGINT AS n, 0.0::DOUBLE AS cover FROM meets
        UNION ALL
        SELECT scene, k, CASE WHEN free THEN used || [left_id, right_id] ELSE used END, n + free::INT, cover + CASE WHEN free THEN fraction_a ELSE 0 END
        FROM (SELECT w.used, w.n, w.cover, o.*, NOT list_contains(w.used, o.left_id) AND NOT list_contains(w.used, o.right_id) AS free FROM walk w JOIN o ON o.scene = w.scene AND o.k = w.k + 1)
    ),
    ends AS (SELECT scene, arg_max(n, k) AS n, arg_max(cover, k) AS cover FROM walk GROUP BY scene),
    merges AS (SELECT scene, right_id, count(*) AS k, count(DISTINCT q.group_id) AS g FROM meets o JOIN quads q USING (scene) WHERE q.vec_id = o.left_id AND fraction_a >= 0.6 GROUP BY ALL HAVING count(*) >= 2),
    splits AS (SELECT scene, left_id FROM meets WHERE fraction_a >= 0.2 AND fraction_b >= 0.5 GROUP BY ALL HAVING count(*) >= 2)
    SELECT e.scene, e.n::BIGINT AS matched, round(CASE WHEN e.n > 0 THEN e.cover / e.n ELSE 0 END, 6) AS mean_coverage, (SELECT count(*) FROM merges m WHERE m.scene = e.scene) AS merge_errors,
           (SELECT count(*) FROM merges m WHERE m.scene = e.scene AND g >= 2) AS cross_merges, (SELECT count(*) FROM splits s WHERE s.scene = e.scene) AS split_errors
    FROM ends e
""")
def detection_evaluation(spark, sf_dir):
    """Matches, merges and splits of each scene; a region is found where 0.4 of it is covered."""
    left = regions(spark, sf_dir, 0)
    pairs = Scratch(spark).save(overlapping(left, regions(spark, sf_dir, 1), cell=100.0, scene="scene"))
    won = greedy_matching(pairs.filter("fraction_a >= 0.4"), "left_id", "right_id", [-F.round("fraction_a", 9), -F.round("fraction_b", 9)])
    matched = won.groupBy("scene").agg(F.count("*").alias("matched"), F.avg("fraction_a").alias("mean"))
    errors = detection_errors(pairs, left.select("scene", F.col("id").alias("left_id"), "group_id"), "scene")
    return errors.join(matched, "scene", "left").select("scene", F.coalesce("matched", F.lit(0)).alias("matched"), F.round(F.coalesce("mean", F.lit(0.0)), 6).alias("mean_coverage"), "merge_errors", "cross_merges", "split_errors")


@query("""
    SELECT o.k AS o_orderkey, n.n_nationkey FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem) o, nation n
    WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.k AND NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = l.l_suppkey AND s.s_nationkey = n.n_nationkey))
""")
def orders_of_one_nation(spark, sf_dir):
    """Orders all of whose suppliers are of one nation, by division."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s_suppkey"))
    nations = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"))
    return divided(lines, nations, "o_orderkey", "s_suppkey", "n_nationkey")


@query("""
    WITH parts AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part), names AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word, p_type FROM part WHERE p_partkey % 211 = 0),
    known AS (SELECT word, count(*) AS k, any_value(p_type) AS p_type FROM names GROUP BY word)
    SELECT p_partkey, count(DISTINCT word) AS n_parts, coalesce(string_agg(DISTINCT p_type, ',' ORDER BY p_type) FILTER (WHERE p_type IS NOT NULL AND ok), '') AS targets,
           CASE WHEN NOT bool_and(ok) THEN 'none' WHEN count(DISTINCT p_type) = 1 THEN 'one' ELSE 'several' END AS outcome
    FROM (SELECT p.*, k.p_type, coalesce(k.k = 1, false) AS good, bool_and(coalesce(k.k = 1, false)) OVER (PARTITION BY p_partkey) AS ok FROM parts p LEFT JOIN known k USING (word)) GROUP BY p_partkey
""")
def concepts_by_all_words(spark, sf_dir):
    """Names whose words all belong to one known type each."""
    word = F.explode(F.split("p_name", " "))
    part = read(spark, sf_dir, "part")
    listed = part.select("p_partkey", word.alias("word")).withColumn("part", F.col("word"))
    known = part.filter("p_partkey % 211 = 0").select(word.alias("word"), "p_type")
    return resolved_by_all_parts(listed, known, "p_partkey", "part", "word", "p_type").select("p_partkey", "n_parts", F.array_join("targets", ",").alias("targets"), "outcome")


def _digest_sql(name: str, key: str, order: str, fields: list[str]) -> str:
    line = " || chr(31) || ".join(rf"coalesce(replace(replace(replace({f}, '\', '\\'), chr(31), '\f'), chr(10), '\l'), '\N')" for f in fields)
    levels = "".join(f", {name}{k + 1} AS (SELECT span >> 4 AS span, sum(n) AS n, sha256(string_agg(digest, chr(10) ORDER BY span)) AS digest FROM {name}{k} GROUP BY span >> 4)" for k in range(4))
    return f"{name}0 AS (SELECT {key} >> 10 AS span, count(*) AS n, sha256(string_agg(line, chr(10) ORDER BY {order}, line)) AS digest FROM (SELECT *, {line} AS line FROM {name}) GROUP BY {key} >> 10){levels}"


@query(rf"""
    WITH {_digest_sql("orders", "o_orderkey", "o_orderkey", ["o_orderkey::VARCHAR", "o_custkey::VARCHAR", "o_orderstatus", "round(o_totalprice * 100)::BIGINT::VARCHAR", "o_orderdate::DATE::VARCHAR", "o_orderpriority"])},
         {_digest_sql("lineitem", "l_orderkey", "l_orderkey, l_linenumber", ["l_orderkey::VARCHAR", "l_linenumber::VARCHAR", "l_partkey::VARCHAR", "l_suppkey::VARCHAR", "round(l_quantity)::BIGINT::VARCHAR", "round(l_extendedprice * 100)::BIGINT::VARCHAR", "l_returnflag", "l_shipdate::DATE::VARCHAR"])}
    SELECT 'orders' AS name, n::BIGINT AS n, digest, true AS agrees FROM orders4 UNION ALL SELECT 'lineitem', n::BIGINT, digest, true FROM lineitem4
""")
def table_digests(spark, sf_dir):
    """One digest a table, by two executors that must agree."""

    def cents(c):
        return F.round(F.col(c) * 100).cast("long")

    orders, lines = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    tables = [
        ("orders", orders, ["o_orderkey"], line_of("o_orderkey", "o_custkey", "o_orderstatus", cents("o_totalprice"), F.to_date("o_orderdate"), "o_orderpriority")),
        ("lineitem", lines, ["l_orderkey", "l_linenumber"], line_of("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("l_quantity").cast("long"), cents("l_extendedprice"), "l_returnflag", F.to_date("l_shipdate"))),
    ]
    out = None
    for name, rows, key, line in tables:
        span = F.shiftright(key[0], 10)
        ways = [merkle_root(ranges(rows, key, span, line), 4) for ranges in (range_digests, range_digests_streamed)]
        one = ways[0].join(ways[1].withColumnsRenamed({"n": "_n", "digest": "_digest"}), F.col("digest").eqNullSafe(F.col("_digest")), "left")
        one = one.select(F.lit(name).alias("name"), "n", "digest", F.col("_digest").isNotNull().alias("agrees"))
        out = one if out is None else out.union(one)
    return out


NAMING = [Rule("promotion", "^(.+) promo$"), Rule("grade", "^(.+) (?:economy|standard)$"), Rule("variant", "^(?:red|blue|hot|cold|old|new) (.+)$"), Rule("kind", "^(.+) [a-z]+$")]


@query("""
    WITH names AS (SELECT DISTINCT p_name || ' ' || lower(p_type) AS name FROM part),
    known AS (SELECT p_name AS base FROM part WHERE p_size <= 5 UNION SELECT split_part(p_name, ' ', 2) || ' ' || lower(p_type) FROM part WHERE p_size >= 45),
    rules AS (SELECT * FROM (VALUES (1, 'promotion', '^(.+) promo$'), (2, 'grade', '^(.+) (?:economy|standard)$'), (3, 'variant', '^(?:red|blue|hot|cold|old|new) (.+)$'), (4, 'kind', '^(.+) [a-z]+$')) r(rule, relation, pattern))
    SELECT name, relation, k.base, rule::BIGINT AS rule FROM names n JOIN rules r ON regexp_matches(n.name, r.pattern) JOIN known k ON k.base = regexp_extract(n.name, r.pattern, 1) AND k.base <> n.name
    QUALIFY row_number() OVER (PARTITION BY name ORDER BY rule) = 1
""")
def named_relations(spark, sf_dir):
    """Names placed under a known base by the first rule that fits."""
    part = read(spark, sf_dir, "part")
    kind = F.lower("p_type")
    known = part.filter("p_size <= 5").select(F.col("p_name").alias("base")).union(part.filter("p_size >= 45").select(F.concat_ws(" ", F.split_part("p_name", F.lit(" "), F.lit(2)), kind)))
    return first_rules(part.select(F.concat_ws(" ", "p_name", kind).alias("name")), NAMING, known)


SLICES = {f"lang_{v}": f"lang = '{v}'" for v in ("en", "de", "fr", "es")} | {f"chars_{n}": f"n_chars >= {n}" for n in (100, 500, 1000, 2000, 5000, 10000)} | {
    "short": "n_chars < 50", "lines": "text LIKE '%' || chr(10) || '%'", "digits": "regexp_like(text, '[0-9]')", "symbols": "regexp_like(text, '[#$%&*]')", "mail": "text LIKE '%@%'", "link": "text LIKE '%http%'",
    "license": "text LIKE '%icense%'", "source_0": "source = 'src0'", "even": "doc_id % 2 = 0", "bars": "text LIKE '%|%'",
}


@query(f"""
    WITH held AS (
        SELECT doc_id, list_filter([{", ".join(f"{{'name': '{n}', 'i': {i}, 'holds': coalesce({p.replace('regexp_like', 'regexp_matches')}, false)}}" for i, (n, p) in enumerate(SLICES.items()))}], lambda s: s.holds) AS s FROM documents
    ), each AS (
        SELECT doc_id, unnest(['all'] || list_transform(s, lambda x: x.name) || flatten(list_transform(s, lambda x: list_transform(list_filter(s, lambda y: y.i > x.i), lambda y: x.name || '&' || y.name)))) AS slice FROM held
    )
    SELECT slice, count(*) AS n, sum(('0x' || substr(md5(doc_id::VARCHAR), 1, 12))::BIGINT)::VARCHAR AS fingerprint FROM each GROUP BY slice HAVING count(*) >= 5
""")
def document_slices(spark, sf_dir):
    """Twenty slices of the documents and all their pairs, of five rows at least."""
    return slice_plan(read(spark, sf_dir, "documents"), {n: F.expr(p) for n, p in SLICES.items()}, "doc_id", least=5)


@query(f"""
    WITH t AS (SELECT conv_id, turn, {WORDS_SQL} AS w FROM conversations WHERE text IS NOT NULL), e AS (SELECT conv_id, turn, unnest(w) AS tok FROM t),
    x AS (SELECT conv_id, turn, tok, count(*) AS k FROM e GROUP BY ALL), y AS (SELECT conv_id, turn - 1 AS turn, tok, count(*) AS k FROM e GROUP BY ALL),
    j AS (SELECT coalesce(x.conv_id, y.conv_id) AS conv_id, coalesce(x.turn, y.turn) AS turn, coalesce(x.k, 0) AS a, coalesce(y.k, 0) AS b FROM x FULL JOIN y ON x.conv_id = y.conv_id AND x.turn = y.turn AND x.tok = y.tok)
    SELECT conv_id, turn, sum(a)::BIGINT AS n_expected, sum(b)::BIGINT AS n_found, sum(least(a, b))::BIGINT AS n_matched FROM j GROUP BY conv_id, turn
""")
def turn_tokens_reused(spark, sf_dir):
    """How many tokens of a turn the next one uses again, each occurrence once."""
    tokens = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(words(F.col("text"))).alias("token"))
    return consumed_tokens(tokens, tokens.withColumn("turn", F.col("turn") - 1), ["conv_id", "turn"])


@query(r"""
    WITH RECURSIVE lines AS (SELECT conv_id, turn, unnest(l) AS line, generate_subscripts(l, 1) AS k FROM (SELECT conv_id, turn, string_split(lower(text), chr(10)) AS l FROM conversations WHERE text IS NOT NULL)),
    tok AS (SELECT *, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w, substr(md5(line), 1, 1) AS d FROM lines),
    e AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) AS i, w FROM tok),
    f AS (SELECT conv_id, list(CASE WHEN d < '9' THEN w ELSE w[2:] END ORDER BY md5(line), turn, k) AS found FROM tok WHERE d >= '3' GROUP BY conv_id),
    walk AS (
        SELECT DISTINCT e.conv_id, 0::BIGINT AS i, []::BIGINT[] AS hits, coalesce(f.found, []) AS found FROM e LEFT JOIN f USING (conv_id)
        UNION ALL
        SELECT w.conv_id, e.i, list_append(w.hits, list_filter(range(1, len(w.found) + 1), lambda j: NOT list_contains(w.hits, j) AND list_has_all(w.found[j], e.w))[1]), w.found FROM walk w JOIN e ON e.conv_id = w.conv_id AND e.i = w.i + 1
    ),
    ends AS (SELECT conv_id, arg_max(hits, i) AS hits FROM walk GROUP BY conv_id)
    SELECT conv_id, len(hits)::BIGINT AS n_lines, len(list_filter(hits, lambda a: a IS NOT NULL))::BIGINT AS n_matched,
           len(list_filter(range(1, len(hits)), lambda i: hits[i] IS NOT NULL AND hits[i + 1] IS NOT NULL))::BIGINT AS adjacent, len(list_filter(range(1, len(hits)), lambda i: hits[i + 1] > hits[i]))::BIGINT AS in_order FROM ends
""")
def lines_found_again(spark, sf_dir):
    """Lines of a conversation looked for among its lines as a recogniser may give them: out of order, some cut, some lost."""
    turns = read(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    lines = turns.select("conv_id", "turn", F.posexplode(F.split(F.lower("text"), "\n")).alias("k", "line"))
    tok = lines.withColumn("w", words(F.col("line"))).withColumn("h", F.md5(F.col("line").cast("binary")))
    digit = F.substring("h", 1, 1)
    cut = F.when(digit < "9", F.col("w")).otherwise(F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))))
    pages = tok.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "k", "w"))).alias("e"),
        F.array_sort(F.collect_list(F.when(digit >= "3", F.struct("h", "turn", "k", cut.alias("w"))))).alias("f"),
    )
    page = pages.select("conv_id", F.transform("e", lambda x: x["w"]).alias("expected"), F.transform("f", lambda x: x["w"]).alias("found"))
    return matched_lines(page, "expected", "found").drop("expected", "found")


@query("""
    SELECT l_returnflag, l_linestatus, count(*) AS n, sum(round(l_quantity))::BIGINT AS quantity, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS cents FROM lineitem GROUP BY ALL
""")
def published_summary(spark, sf_dir):
    """A summary published as two versions after an audit, and the current one read back through its manifest."""
    lines = read(spark, sf_dir, "lineitem")
    summary = lines.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.round("l_quantity").cast("long")).alias("quantity"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"))
    shelf = Published(spark, f"{Scratch(spark).root}/published-{uuid.uuid4().hex}")
    shelf.publish(summary.filter("l_returnflag = 'A'"))

    def audit(written):
        if written.groupBy("l_returnflag", "l_linestatus").count().filter("count > 1").count():
            raise ValueError("a group stands twice")

    shelf.publish(summary, audit)
    return shelf.read()


@query("""
    SELECT event_type, rule, count(*) AS n FROM (
        SELECT event_type, unnest(list_filter([
            CASE WHEN k IS NULL OR k >= 80 THEN 'k_under_80' END, CASE WHEN value IS NULL OR value < 1 THEN 'value_from_1' END, CASE WHEN k % 2 = user_id % 2 THEN NULL ELSE 'k_like_user' END
        ], lambda r: r IS NOT NULL)) AS rule FROM (SELECT *, (props->>'$.k')::BIGINT AS k FROM events)
    ) GROUP BY ALL
""")
def event_contract(spark, sf_dir):
    """Broken rules of the events' properties, by type."""
    record = F.col("record.k")
    contract = Contract({"k": "bigint"}, {"k_under_80": record < 80, "value_from_1": F.col("value") >= 1, "k_like_user": record % 2 == F.col("user_id") % 2})
    return strict_json(read(spark, sf_dir, "events"), "props", contract).select("event_type", F.explode("broken").alias("rule")).groupBy("event_type", "rule").agg(F.count("*").alias("n"))


@query("""
    WITH r AS (SELECT conv_id, turn, role, text, length(text) AS n FROM conversations),
    broken AS (
        SELECT unnest(list_filter([CASE WHEN role IN ('user', 'assistant') THEN NULL ELSE 'role' END, CASE WHEN n BETWEEN 1 AND 400 THEN NULL ELSE 'length' END, CASE WHEN turn < 6 THEN NULL ELSE 'turn' END], lambda x: x IS NOT NULL)) AS rule FROM r
        UNION ALL SELECT 'repeated_text' FROM r GROUP BY text HAVING count(*) > 1
        UNION ALL SELECT 'mixed_roles' FROM r GROUP BY turn HAVING count(DISTINCT role) > 1
    ) SELECT rule, count(*) AS n FROM broken GROUP BY rule
""")
def conversation_contract(spark, sf_dir):
    """Broken rules of the conversations: of rows, of keys, and across documents."""
    rows = read(spark, sf_dir, "conversations")
    rules = {"role": F.col("role").isin("user", "assistant"), "length": F.length("text").between(1, 400), "turn": F.col("turn") < 6}
    named = broken_rules(rows, rules).select(F.explode("broken").alias("rule"))
    across = [repeated_keys(rows, ["text"]).select(F.lit("repeated_text").alias("rule")), mixed_values(rows, "turn", "role").select(F.lit("mixed_roles").alias("rule"))]
    return named.union(across[0]).union(across[1]).groupBy("rule").agg(F.count("*").alias("n"))
