"""The plans around recognition corpora and reports, each with its SQL; see ``cases``."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from posora.functions import forms, names
from posora.operators.boxes import overlapping
from posora.operators.ordered import dealt, numbered
from posora.plans import cases

case = cases.case


@case("SELECT round(sum(errors) * 1.0 / sum(chars), 6) AS cer, round(max(CASE WHEN chars > 0 THEN errors * 1.0 / chars ELSE 0 END), 6) AS worst, round(coalesce(sum(found) * 1.0 / nullif(sum(expected), 0), 1), 6) AS recall, count(*) AS n FROM samples", "samples")
def recognition_metrics(samples):
    cer, recall = F.try_divide(F.sum("errors"), F.sum("chars")), F.try_divide(F.sum("found"), F.sum("expected"))
    worst = F.max(F.coalesce(F.try_divide("errors", "chars"), F.lit(0.0)))
    return samples.agg(F.round(F.coalesce(cer, F.lit(0.0)), 6).alias("cer"), F.round(worst, 6).alias("worst"), F.round(F.coalesce(recall, F.lit(1.0)), 6).alias("recall"), F.count("*").alias("n"))


@case("""WITH t AS (SELECT id, errors, chars, unnest(string_split(tags, ',')) AS tag FROM samples), s AS (SELECT * FROM t WHERE tag <> '' UNION ALL SELECT id, errors, chars, 'overall' FROM samples)
    SELECT tag, count(*) AS n, sum(errors)::BIGINT AS errors, sum(chars)::BIGINT AS chars FROM s GROUP BY tag""", "samples")
def tag_slices(samples):
    tags = F.concat(F.filter(F.split("tags", ","), lambda t: t != ""), F.array(F.lit("overall")))
    return samples.withColumn("tag", F.explode(tags)).groupBy("tag").agg(F.count("*").alias("n"), F.sum("errors").alias("errors"), F.sum("chars").alias("chars"))


@case("SELECT coalesce(s.id, p.id) AS id, CASE WHEN p.id IS NULL THEN 'missing' WHEN s.id IS NULL THEN 'unexpected' WHEN s.text = p.text THEN 'exact' ELSE 'differs' END AS outcome FROM samples s FULL JOIN predicted p ON p.id = s.id", "samples", "predicted")
def prediction_coverage(samples, predicted):
    both = samples.select("id", F.col("text").alias("wanted"), F.lit(1).alias("s")).join(predicted.select("id", "text", F.lit(1).alias("p")), "id", "full_outer")
    return both.select("id", F.when(F.col("p").isNull(), "missing").when(F.col("s").isNull(), "unexpected").when(F.col("wanted") == F.col("text"), "exact").otherwise("differs").alias("outcome"))


@case("SELECT split, count(*) AS n, count(DISTINCT family) AS families, count(*) FILTER (regexp_matches(text, '[가-힣]')) AS hangul, count(*) FILTER (regexp_matches(text, '[A-Za-z]')) AS latin FROM samples GROUP BY split", "samples")
def dataset_statistics(samples):
    return samples.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("family").alias("families"), F.count_if(F.col("text").rlike("[가-힣]")).alias("hangul"), F.count_if(F.col("text").rlike("[A-Za-z]")).alias("latin"))


@case("SELECT DISTINCT split, unnest(string_split(text, '')) AS c FROM samples WHERE text IS NOT NULL", "samples")
def observed_characters(samples):
    return samples.filter("text IS NOT NULL").select("split", F.explode(F.split("text", "")).alias("c")).distinct()


#: The longest label and the characters of the model's dictionary.
LONGEST, DICTIONARY = 10, "abcdefghilmnorst 가나다"


@case(f"SELECT id, CASE WHEN text IS NULL THEN 'empty' WHEN length(text) > {LONGEST} THEN 'overlength' WHEN NOT regexp_full_match(text, '[{DICTIONARY}]*') THEN 'unknown_character' ELSE 'fits' END AS class FROM labels_t", "labels_t")
def model_compatibility(labels_t):
    strange = F.size(F.array_except(F.split("text", ""), F.array(*map(F.lit, DICTIONARY)))) > 0
    return labels_t.select("id", F.when(F.col("text").isNull(), "empty").when(F.length("text") > LONGEST, "overlength").when(strange, "unknown_character").otherwise("fits").alias("class"))


@case("SELECT split, id || chr(9) || coalesce(text, '') AS line FROM samples", "samples")
def label_export(samples):
    return samples.select("split", F.concat("id", F.lit("\t"), F.coalesce("text", F.lit(""))).alias("line"))


@case("SELECT id, CASE WHEN family IN (SELECT family FROM exposed) THEN 'historical' ELSE 'unseen' END AS pool FROM samples", "samples", "exposed")
def exposure_pools(samples, exposed):
    known = exposed.select("family", F.lit("historical").alias("was")).distinct()
    return samples.join(known, "family", "left").select("id", F.coalesce("was", F.lit("unseen")).alias("pool"))


@case("SELECT family, count(DISTINCT split) AS n_splits, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM samples GROUP BY family HAVING count(DISTINCT split) > 1", "samples")
def family_leakage(samples):
    splits = F.array_sort(F.collect_set("split"))
    return samples.groupBy("family").agg(F.count_distinct("split").alias("n_splits"), F.array_join(splits, ",").alias("splits")).filter("n_splits > 1")


@case("SELECT id, CASE WHEN (row_number() OVER (ORDER BY id) - 1 + 3) % 10 < 8 THEN 'train' WHEN (row_number() OVER (ORDER BY id) - 1 + 3) % 10 = 8 THEN 'val' ELSE 'test' END AS split FROM samples", "samples")
def split_by_cycle(samples):
    place = F.pmod(F.col("place") + 2, F.lit(10))
    return numbered(samples.select("id"), [F.col("id")]).select("id", F.when(place < 8, "train").when(place == 8, "val").otherwise("test").alias("split"))


@case("SELECT 'hist:' || id AS id, split FROM samples WHERE split = 'train' UNION ALL SELECT 'new:' || id, split FROM samples WHERE split <> 'train'", "samples")
def mixed_view(samples):
    old = samples.filter("split = 'train'").select(F.concat(F.lit("hist:"), "id").alias("id"), "split")
    return old.unionByName(samples.filter("split <> 'train'").select(F.concat(F.lit("new:"), "id").alias("id"), "split"))


@case("SELECT doc, box, row_number() OVER (PARTITION BY doc ORDER BY y0, x0) AS place, (x1 - x0) * (y1 - y0) AS area FROM boxes", "boxes")
def box_order(boxes):
    return boxes.select("doc", "box", F.row_number().over(W.partitionBy("doc").orderBy("y0", "x0")).alias("place"), ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"))


@case("""SELECT a.doc, a.box AS a, b.box AS b, round(i / (ar + br - i), 6) AS iou FROM (SELECT doc, box, *, (x1 - x0) * (y1 - y0) AS ar FROM boxes) a JOIN (SELECT *, (x1 - x0) * (y1 - y0) AS br FROM boxes) b ON a.doc = b.doc AND a.box < b.box,
    LATERAL (SELECT greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS i) WHERE i > 0""", "boxes")
def overlapping_boxes(boxes):
    area = [(F.col(f"{k}.x1") - F.col(f"{k}.x0")) * (F.col(f"{k}.y1") - F.col(f"{k}.y0")) for k in "ab"]
    iou = F.col("shared") / (area[0] + area[1] - F.col("shared"))
    return overlapping(boxes).select("doc", F.col("a.box").alias("a"), F.col("b.box").alias("b"), F.round(iou, 6).alias("iou"))


@case("SELECT field, count(*) FILTER (wanted = got) AS correct, count(*) FILTER (wanted IS NOT NULL AND got IS NULL) AS missing, count(*) FILTER (wanted IS NULL AND got IS NOT NULL) AS invented, count(*) FILTER (wanted <> got) AS wrong FROM fields GROUP BY field", "fields")
def parse_metrics(fields):
    w, g = F.col("wanted"), F.col("got")
    return fields.groupBy("field").agg(F.count_if(w == g).alias("correct"), F.count_if(w.isNotNull() & g.isNull()).alias("missing"), F.count_if(w.isNull() & g.isNotNull()).alias("invented"), F.count_if(w != g).alias("wrong"))


@case("SELECT model, row_number() OVER (ORDER BY gate DESC, recall DESC, precision DESC, latency, model) AS place FROM models", "models")
def model_ranking(models):
    order = [F.desc("gate"), F.desc("recall"), F.desc("precision"), F.col("latency"), F.col("model")]
    return numbered(models, order).select("model", "place")


@case("SELECT metric, coalesce(value >= coalesce(least, value) AND value <= coalesce(most, value), false) AS passed FROM metrics", "metrics")
def gates(metrics):
    inside = (F.col("value") >= F.coalesce("least", "value")) & (F.col("value") <= F.coalesce("most", "value"))
    return metrics.select("metric", F.coalesce(inside, F.lit(False)).alias("passed"))


@case("""SELECT med, bool_or(state IN ('hit', 'conditional') AND category <> 'split') AS alert, bool_or(category = 'split' AND label = '분할불가') AS no_split, bool_or(state = 'unknown') AS unknown FROM checks GROUP BY med""", "checks")
def badges(checks):
    own = checks.groupBy("med").agg(F.collect_list(F.struct("category", "state", "label")).alias("list"))
    return own.select(
        "med", F.exists("list", lambda x: x["state"].isin("hit", "conditional") & (x["category"] != "split")).alias("alert"),
        F.exists("list", lambda x: (x["category"] == "split") & (x["label"] == "분할불가")).alias("no_split"), F.exists("list", lambda x: x["state"] == "unknown").alias("unknown"),
    )


@case("""SELECT substance, max(name) FILTER (r = 1) AS name, sum(rows)::BIGINT AS rows FROM (SELECT *, row_number() OVER (PARTITION BY substance ORDER BY priority, dataset, name) AS r FROM evidence) GROUP BY substance""", "evidence")
def best_evidence(evidence):
    return evidence.groupBy("substance").agg(F.min_by("name", F.struct("priority", "dataset", "name")).alias("name"), F.sum("rows").alias("rows"))


@case("SELECT substance, lower(trim(name)) AS key, sum(rows)::BIGINT AS rows, min(priority) AS priority FROM evidence GROUP BY ALL", "evidence")
def merged_by_key(evidence):
    key = F.lower(names.clean(F.col("name")))
    return evidence.groupBy("substance", key.alias("key")).agg(F.sum("rows").alias("rows"), F.min("priority").alias("priority"))


@case("""SELECT person, bool_or(NOT mapped AND start <= DATE '2024-01-31' AND coalesce("end" >= DATE '2024-01-01', true)) AS blocked FROM current GROUP BY person""", "current")
def unmapped_blocks_clear(current):
    first, last = F.lit("2024-01-01").cast("date"), F.lit("2024-01-31").cast("date")
    may = ~F.col("mapped") & (F.col("start") <= last) & F.coalesce(F.col("end") >= first, F.lit(True))
    return current.groupBy("person").agg(F.bool_or(may).alias("blocked"))


@case("""SELECT grp, list_reduce(list_prepend('', list(model ORDER BY model)), lambda a, x: sha256(a || x)) AS chain, count(*) AS n FROM models GROUP BY grp""", "models")
def hash_chain(models):
    """A chain of digests over the ordered outputs of each group."""
    own = models.groupBy("grp").agg(F.array_sort(F.collect_list("model")).alias("list"))
    return own.select("grp", F.aggregate("list", F.lit(""), lambda acc, x: F.sha2(F.concat(acc, x), 256)).alias("chain"), F.size("list").cast("long").alias("n"))


@case("SELECT item_seq, CASE count(permit_form) WHEN 0 THEN 'unknown' ELSE CASE max(permit_form) WHEN '주사제' THEN 'injection' ELSE 'oral' END END AS route FROM products GROUP BY item_seq", "products")
def administration_routes(products):
    return products.groupBy("item_seq").agg(forms.administration_route(F.array_compact(F.collect_set("permit_form"))).alias("route"))


@case("""SELECT med, start AS day, row_number() OVER (PARTITION BY med ORDER BY clock NULLS LAST, slot) AS occurrence, slot FROM instances JOIN medications USING (med)""".replace("SELECT med, start AS day", "SELECT med, start AS \"day\"").replace("clock NULLS", "instances.clock NULLS"), "instances", "medications")
def occurrence_slots(instances, medications):
    rows = dealt(instances, "med").join(medications.select("med", F.col("start").alias("day")), "med")
    return rows.select("med", "day", F.row_number().over(W.partitionBy("med").orderBy(F.col("clock").asc_nulls_last(), "slot")).alias("occurrence"), "slot")
