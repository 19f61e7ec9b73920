"""Accuracy, latency, label inference and calibration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerlake.operators import metrics, mlprep, ranking
from answerlake.plans.derived import OPTIONS, VIEWS, Tables
from answerlake.plans.index import micros
from answerlake.plans.registry import query
from answerlake.sources import labels as label_files

VIEWS["f_truth8"] = "SELECT scan_id, name, expected FROM f_truth UNION ALL SELECT DISTINCT scan_id, 'q8', 'A' FROM f_cells WHERE scan_id % 50 = 0"
VIEWS["f_items"] = """SELECT t.scan_id, t.name, COALESCE(c.kind, 'missing') AS kind, t.expected, COALESCE(c.value, '') AS got, c.confidence, c.flag,
  COALESCE(c.needs_review = 1, FALSE) AS flagged, CASE WHEN c.kind IS NULL THEN NULL WHEN t.expected = '*' THEN c.needs_review = 1 ELSE t.expected = c.value END AS correct
  FROM f_truth8 t LEFT JOIN (SELECT *, CASE pos WHEN 1 THEN 'zone:barcode' WHEN 3 THEN 'custom' ELSE 'field' END AS kind FROM f_cells) c ON c.scan_id = t.scan_id AND c.name = t.name"""


def truth(t: Tables):
    extra = t.cells.where("scan_id % 50 = 0").select("scan_id", F.lit("q8").alias("name"), F.lit("A").alias("expected"))
    return t.truth.unionByName(extra.distinct())


def readings(t: Tables):
    kind = F.when(F.col("pos") == 1, "zone:barcode").when(F.col("pos") == 3, "custom").otherwise("field")
    return t.cells.select(
        "scan_id",
        "name",
        kind.alias("kind"),
        "value",
        "confidence",
        F.filter(F.array("flag"), lambda f: f != "").alias("flags"),
        (F.col("needs_review") == 1).alias("flagged"),
    )


def items(t: Tables):
    return metrics.compare_truth(truth(t), readings(t))


_COUNTERS = """COUNT(*) AS total, COUNT(*) FILTER (correct) AS correct, ROUND(COUNT(*) FILTER (correct) / COUNT(*), 6) AS accuracy,
  COUNT(*) FILTER (flagged) AS flagged, ROUND(COUNT(*) FILTER (flagged) / COUNT(*), 6) AS review_rate, COUNT(*) FILTER (NOT flagged) AS auto_accepted,
  ROUND(COUNT(*) FILTER (NOT flagged AND correct) / NULLIF(COUNT(*) FILTER (NOT flagged), 0), 6) AS auto_accepted_accuracy, COUNT(*) FILTER (NOT flagged AND NOT correct) AS silent_errors,
  ROUND(COUNT(*) FILTER (flagged AND NOT correct) / NULLIF(COUNT(*) FILTER (flagged), 0), 6) AS flagged_error_rate,
  ROUND(COUNT(*) FILTER (flagged AND NOT correct) / NULLIF(COUNT(*) FILTER (NOT correct), 0), 6) AS errors_caught_rate"""
_READ = "FROM f_items WHERE kind <> 'missing'"


@query("ml_compare_truth", "SELECT scan_id, name, kind, expected, got, flagged, correct FROM f_items")
def _(t):
    return items(t).select("scan_id", "name", "kind", "expected", "got", "flagged", "correct")


@query("ag_metrics_values", f"SELECT {_COUNTERS} {_READ}")
def _(t):
    return metrics.value_metrics(items(t))


@query(
    "ag_metrics_by_kind",
    f"""SELECT 'all' AS "group", {_COUNTERS} {_READ} UNION ALL SELECT 'kind:' || kind, {_COUNTERS} {_READ} GROUP BY kind
       UNION ALL SELECT 'bubbles', {_COUNTERS} {_READ} AND kind IN ('field', 'custom')""",
)
def _(t):
    return metrics.value_metrics(items(t), by_kind=True)


@query(
    "ag_metrics_sheets",
    """WITH r AS (SELECT s.scan_id, s.status, k.scan_id IS NOT NULL AS known, COALESCE(e.exact, TRUE) AS exact FROM f_scans s LEFT JOIN (SELECT DISTINCT scan_id FROM f_truth8) k ON k.scan_id = s.scan_id
         LEFT JOIN (SELECT scan_id, BOOL_AND(correct) AS exact FROM f_items WHERE kind <> 'missing' GROUP BY 1) e ON e.scan_id = s.scan_id),
       c AS (SELECT COUNT(*) AS total, COUNT(*) FILTER (status = 'error') AS error, COUNT(*) FILTER (status <> 'error' AND NOT known) AS missing_truth, COUNT(*) FILTER (status <> 'error' AND known) AS scanned,
         COUNT(*) FILTER (status = 'ok' AND known) AS ok, COUNT(*) FILTER (status = 'needs_review' AND known) AS needs_review, COUNT(*) FILTER (status <> 'error' AND known AND exact) AS exact_match,
         COUNT(*) FILTER (status = 'ok' AND known AND exact) AS auto_accepted_exact FROM r)
       SELECT *, ROUND(exact_match / scanned, 6) AS exact_match_rate, ROUND(needs_review / scanned, 6) AS review_rate, ROUND(auto_accepted_exact / ok, 6) AS auto_accepted_accuracy,
       ROUND(error / total, 6) AS error_rate, ROUND(auto_accepted_exact / total, 6) AS straight_through_rate FROM c""",
)
def _(t):
    return metrics.sheet_metrics(items(t), t.scans, truth(t).select("scan_id").distinct())


_BUBBLES = """WITH b AS (SELECT b.marked = 1 AS got, CONTAINS(t.expected, b.opt) AS want FROM f_bubbles b JOIN f_truth t ON t.scan_id = b.scan_id AND t.name = b.name WHERE t.expected <> '*'),
  c AS (SELECT COUNT(*) FILTER (want AND got) AS true_positive, COUNT(*) FILTER (NOT want AND got) AS false_positive, COUNT(*) FILTER (want AND NOT got) AS false_negative,
        COUNT(*) FILTER (NOT want AND NOT got) AS true_negative, 0 AS undecomposable_fields FROM b),
  r AS (SELECT *, ROUND(true_positive / (true_positive + false_positive), 6) AS precision, ROUND(true_positive / (true_positive + false_negative), 6) AS recall,
        ROUND((true_positive + true_negative) / (true_positive + false_positive + false_negative + true_negative), 6) AS accuracy FROM c)
  SELECT *, ROUND(2 * precision * recall / (precision + recall), 6) AS f1 FROM r"""


@query("ag_metrics_bubbles", _BUBBLES)
def _(t):
    return metrics.bubble_metrics(t.bubbles, t.truth, OPTIONS)


@query(
    "ag_review_reasons",
    f"SELECT CASE WHEN flag = '' THEN '(none)' ELSE flag END AS flag, COUNT(*) AS count, COUNT(*) FILTER (NOT correct) AS wrong {_READ} AND flagged GROUP BY 1",
)
def _(t):
    return metrics.review_reasons(items(t))


@query(
    "so_worst_errors",
    f"""SELECT scan_id, name, kind, expected, got, flagged {_READ} AND NOT correct ORDER BY flagged, COALESCE(confidence, 0) DESC, scan_id, name LIMIT 50""",
)
def _(t):
    return metrics.worst_errors(items(t)).select("scan_id", "name", "kind", "expected", "got", "flagged")


@query("ag_missing_columns", "SELECT DISTINCT name FROM f_truth8 WHERE name NOT IN (SELECT name FROM f_cells)")
def _(t):
    # Both lists in one aggregation: as many rows as there are columns, and no join
    both = truth(t).select("name", F.lit(1).alias("asked"), F.lit(0).alias("read")).unionByName(
        t.cells.select("name", F.lit(0).alias("asked"), F.lit(1).alias("read"))
    )
    sides = both.groupBy("name").agg(F.max("asked").alias("asked"), F.max("read").alias("read"))
    return sides.where("asked = 1 AND read = 0").select("name")


@query("ag_self_check", f"SELECT name, ROUND(AVG(CASE WHEN correct THEN 1.0 ELSE 0.0 END), 4) AS agreement, COUNT(*) AS n {_READ} GROUP BY ROLLUP (name)")
def _(t):
    return metrics.self_check(items(t))


@query(
    "ag_latency",
    "SELECT event_type AS stage, ROUND(AVG(value), 2) AS mean, ROUND(QUANTILE_CONT(value, 0.5), 2) AS p50, ROUND(QUANTILE_CONT(value, 0.95), 2) AS p95, ROUND(MAX(value), 2) AS max FROM events GROUP BY 1",
)
def _(t):
    return metrics.latency(t.raw("events").select(F.col("event_type").alias("stage"), F.col("value").alias("ms")))


@query(
    "ag_throughput",
    """SELECT job, COUNT(*) AS sheets, ROUND((MAX(EPOCH_US(ts)) - MIN(EPOCH_US(ts))) / 1e6, 3) AS elapsed, ROUND(COUNT(*) / ((MAX(EPOCH_US(ts)) - MIN(EPOCH_US(ts))) / 1e6), 8) AS per_second,
       ROUND((MAX(EPOCH_US(ts)) - MIN(EPOCH_US(ts))) / 1e6 / COUNT(*) * (2000000 - COUNT(*)), 2) AS eta FROM (SELECT user_id % 20 AS job, ts FROM events) e GROUP BY 1""",
)
def _(t):
    rows = t.raw("events").select((F.col("user_id") % 20).alias("job"), micros("ts").alias("us"))
    n, elapsed = F.count("*"), (F.max("us") - F.min("us")) / 1e6
    return rows.groupBy("job").agg(
        n.alias("sheets"),
        F.round(elapsed, 3).alias("elapsed"),
        F.round(n / elapsed, 8).alias("per_second"),
        F.round(elapsed / n * (2000000 - n), 2).alias("eta"),
    )


_FILLS = "SELECT marked, COUNT(*) AS count, " + ", ".join(
    f"ROUND(QUANTILE_CONT(fill_ratio, {q / 100}), 3) AS p{q}" for q in (1, 5, 50, 95, 99)
) + " FROM f_bubbles GROUP BY marked"


@query("ag_fill_percentiles", _FILLS)
def _(t):
    return metrics.fill_percentiles(t.bubbles)


@query(
    "ag_review_thresholds",
    f"""SELECT ROUND(top, 2) AS max_unmarked_fill_ratio, ROUND(LEAST(GREATEST(p5 - 0.4, top + 0.1), 0.5), 2) AS min_marked_fill_ratio FROM
       (SELECT LEAST(GREATEST(MAX(p99) FILTER (marked = 0) + 0.15, 0.35), 0.45) AS top, MAX(p5) FILTER (marked = 1) AS p5 FROM ({_FILLS}) f) x""",
)
def _(t):
    return metrics.review_thresholds(metrics.fill_percentiles(t.bubbles))


@query(
    "ag_blank_questions",
    "SELECT scan_id, COUNT(*) FILTER (NOT any_mark) AS blank, COUNT(*) AS questions FROM (SELECT scan_id, name, BOOL_OR(marked = 1) AS any_mark FROM f_bubbles GROUP BY 1, 2) b GROUP BY 1",
)
def _(t):
    marked = t.bubbles.groupBy("scan_id", "name").agg(F.bool_or(F.col("marked") == 1).alias("any_mark"))
    return marked.groupBy("scan_id").agg(F.count_if(~F.col("any_mark")).alias("blank"), F.count("*").alias("questions"))


@query("ag_marked_count", "SELECT scan_id, SUM(marked) AS marked, 'too_few_marks' AS flag FROM f_bubbles GROUP BY 1 HAVING SUM(marked) < 3")
def _(t):
    few = t.bubbles.groupBy("scan_id").agg(F.sum("marked").alias("marked")).where("marked < 3")
    return few.withColumn("flag", F.lit("too_few_marks"))


# ---- labels -------------------------------------------------------------------------------


@query(
    "ag_label_corr",
    """WITH k AS (SELECT name AS label, scan_id, expected FROM f_truth), tok AS (SELECT UNNEST(['A', 'N', 'R', '*']) AS token),
       m AS (SELECT scan_id, name || ':' || opt AS bubble FROM f_bubbles WHERE marked = 1), ab AS (SELECT 'q' || p.i || ':' || o.opt AS bubble FROM RANGE(1, 8) p(i), (VALUES ('A'), ('N'), ('R')) o(opt)),
       n AS (SELECT label, COUNT(*) AS n FROM k GROUP BY 1), sm AS (SELECT label, bubble, COUNT(*) AS sm FROM k JOIN m ON m.scan_id = k.scan_id GROUP BY 1, 2),
       sl AS (SELECT label, token, COUNT(*) AS sl FROM k JOIN tok ON CONTAINS(k.expected, tok.token) GROUP BY 1, 2),
       j AS (SELECT label, bubble, token, COUNT(*) AS sml FROM k JOIN m ON m.scan_id = k.scan_id JOIN tok ON CONTAINS(k.expected, tok.token) GROUP BY 1, 2, 3),
       f AS (SELECT ab.bubble, n.label, tok.token, COALESCE(sm, 0) / n AS mm, COALESCE(sl, 0) / n AS ml, COALESCE(sml, 0) / n AS mj FROM n CROSS JOIN ab CROSS JOIN tok
         LEFT JOIN sm ON sm.label = n.label AND sm.bubble = ab.bubble LEFT JOIN sl ON sl.label = n.label AND sl.token = tok.token LEFT JOIN j ON j.label = n.label AND j.bubble = ab.bubble AND j.token = tok.token)
       SELECT bubble, label, token, ROUND(CASE WHEN SQRT((mm - mm * mm) * (ml - ml * ml)) > 1e-9 THEN (mj - mm * ml) / SQRT((mm - mm * mm) * (ml - ml * ml)) ELSE 0 END, 6) AS corr FROM f""",
)
def _(t):
    names = [f"q{i}" for i in range(1, 8)]
    marks = t.bubbles.where("marked = 1").select("scan_id", F.concat_ws(":", "name", "opt").alias("bubble"))
    tokens = t.truth.select("scan_id", F.col("name").alias("label"), F.col("expected").alias("letters"))
    return metrics.label_correlation(marks, tokens, [f"{n}:{o}" for n in names for o in OPTIONS], names, [*OPTIONS, "*"])


VIEWS["f_labels"] = """SELECT c_custkey AS sheet, 'Roll' AS "column", CASE WHEN c_custkey % 11 = 0 THEN ' ' WHEN c_custkey % 7 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE RIGHT(c_name, 6) END AS value FROM customer
  UNION ALL SELECT c_custkey, 'Seg', c_mktsegment FROM customer UNION ALL SELECT c_custkey, 'Set2', CASE WHEN c_custkey % 9 = 0 THEN 'AB_' ELSE 'A' || CAST(10 + c_nationkey AS VARCHAR) END FROM customer
  UNION ALL SELECT c_custkey, 'Score', CAST(c_nationkey AS VARCHAR) FROM customer UNION ALL SELECT c_custkey, 'Void', '' FROM customer"""


def labels(t: Tables):
    key = F.col("c_custkey")

    def cell(name, value):
        return F.struct(F.lit(name).alias("column"), value.alias("value"))

    roll = F.when(key % 11 == 0, " ").when(key % 7 == 0, key.cast("string")).otherwise(F.right("c_name", F.lit(6)))
    second = F.when(key % 9 == 0, "AB_").otherwise(F.concat(F.lit("A"), (10 + F.col("c_nationkey")).cast("string")))
    cells = F.array(
        cell("Roll", roll),
        cell("Seg", F.col("c_mktsegment")),
        cell("Set2", second),
        cell("Score", F.col("c_nationkey").cast("string")),
        cell("Void", F.lit("")),
    )
    return t.raw("customer").select(key.alias("sheet"), F.inline(cells))


_SHAPE = """SELECT "column", COUNT(*) AS n, COUNT(*) FILTER (v <> '') AS filled, COUNT(*) FILTER (LENGTH(v) >= 2) AS longs, MIN(LENGTH(v)) FILTER (v <> '') AS lo, MAX(LENGTH(v)) AS hi,
  BOOL_AND(regexp_full_match(v, '[0-9]+')) FILTER (v <> '') AS digits FROM (SELECT *, TRIM(value) AS v FROM f_labels) l GROUP BY 1"""
_COMMON = """SELECT "column", len AS common, n AS n_common FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY "column" ORDER BY n DESC, len) AS rk FROM
  (SELECT "column", LENGTH(TRIM(value)) AS len, COUNT(*) AS n FROM f_labels WHERE TRIM(value) <> '' GROUP BY 1, 2) g) r WHERE rk = 1"""


@query(
    "ag_composite_split",
    f"""WITH p AS (SELECT s."column", common FROM ({_SHAPE}) s JOIN ({_COMMON}) c ON c."column" = s."column" WHERE filled >= 2 AND common >= 2 AND n_common >= 0.5 * filled AND longs >= 0.8 * filled)
       SELECT sheet, CASE WHEN common IS NULL THEN "column" ELSE CASE WHEN regexp_matches("column", '[0-9.]') THEN 'f' ELSE LOWER("column") END || i END AS name,
       CASE WHEN common IS NULL THEN v WHEN v = '' THEN '' WHEN LENGTH(v) <> common THEN NULL WHEN SUBSTR(v, CAST(i AS INTEGER), 1) IN (' ', '_', '-') THEN '' ELSE SUBSTR(v, CAST(i AS INTEGER), 1) END AS token FROM
       (SELECT l.sheet, l."column", TRIM(l.value) AS v, p.common, UNNEST(RANGE(1, COALESCE(p.common, 1) + 1)) AS i FROM f_labels l LEFT JOIN p ON p."column" = l."column") x""",
)
def _(t):
    return metrics.composite_split(labels(t))


@query(
    "ag_validation_infer",
    f"""SELECT "column", filled = n AS required, lo AS min_length, hi AS max_length, FALSE AS allow_gaps, lo <> hi AS allow_empty_ends FROM ({_SHAPE}) s WHERE digits AND hi >= 2""",
)
def _(t):
    return metrics.infer_validation(labels(t))


@query("ag_blank_columns", """SELECT "column" FROM f_labels GROUP BY 1 HAVING BOOL_AND(TRIM(value) = '')""")
def _(t):
    return metrics.blank_columns(labels(t))


VIEWS["f_votes"] = """SELECT p_type AS field, p_size % 4 AS place, CASE WHEN p_partkey % 5 = 0 THEN 'x' WHEN LENGTH(p_type) % 3 = 0 THEN CHR(CAST(65 + p_size % 4 AS INTEGER))
  WHEN LENGTH(p_type) % 3 = 1 THEN CAST(p_size % 4 + 3 AS VARCHAR) ELSE SUBSTR('AZQB', CAST(p_size % 4 + 1 AS INTEGER), 1) END AS token FROM part WHERE NOT (LENGTH(p_type) % 3 = 0 AND p_size % 4 = 2)"""


@query(
    "ag_value_order",
    """WITH c AS (SELECT field, place, arg_min(token, (-n, token)) AS token FROM (SELECT field, place, token, COUNT(*) AS n FROM f_votes GROUP BY 1, 2, 3) v GROUP BY 1, 2),
       q(rank, s) AS (VALUES (0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), (1, 'abcdefghijklmnopqrstuvwxyz'), (2, '0123456789'), (3, '1234567890'), (4, '123456789')),
       o AS (SELECT rank, s, UNNEST(RANGE(0, LENGTH(s) - 3)) AS off FROM q), k AS (SELECT field, COUNT(*) AS known FROM c GROUP BY 1),
       f AS (SELECT c.field, o.rank, o.off, COUNT(*) AS hits FROM c JOIN o ON SUBSTR(o.s, CAST(o.off + c.place + 1 AS INTEGER), 1) = c.token GROUP BY 1, 2, 3),
       b AS (SELECT f.field, arg_min(f.rank, f.rank * 100 + f.off) AS rank, arg_min(f.off, f.rank * 100 + f.off) AS off FROM f JOIN k ON k.field = f.field WHERE f.hits = k.known AND (f.off = 0 OR k.known = 4) GROUP BY 1)
       SELECT k.field, p.place, COALESCE(SUBSTR(q.s, CAST(b.off + p.place + 1 AS INTEGER), 1), c.token, 'v' || (p.place + 1)) AS value, q.s IS NOT NULL AS from_standard
       FROM k CROSS JOIN RANGE(0, 4) p(place) LEFT JOIN b ON b.field = k.field LEFT JOIN q ON q.rank = b.rank LEFT JOIN c ON c.field = k.field AND c.place = p.place""",
)
def _(t):
    place, shape = F.col("p_size") % 4, F.length("p_type") % 3
    token = (
        F.when(F.col("p_partkey") % 5 == 0, "x")
        .when(shape == 0, F.char(65 + place))
        .when(shape == 1, (place + 3).cast("string"))
        .otherwise(F.substring(F.lit("AZQB"), place + 1, F.lit(1)))
    )
    votes = t.raw("part").where(~((shape == 0) & (place == 2))).select(
        F.col("p_type").alias("field"), place.alias("place"), token.alias("token")
    )
    return metrics.infer_values(votes, 4)


# ---- model preparation --------------------------------------------------------------------


@query(
    "ml_samples",
    "SELECT b.scan_id, b.name, b.opt, CASE WHEN CONTAINS(t.expected, b.opt) THEN 'marked' ELSE 'empty' END AS label FROM f_bubbles b JOIN f_truth t ON t.scan_id = b.scan_id AND t.name = b.name WHERE t.expected <> '*'",
)
def _(t):
    return mlprep.samples(t.bubbles, t.truth, OPTIONS).select("scan_id", "name", "opt", "label")


VIEWS["f_manifest"] = """SELECT label || '/S' || CAST(scan_id AS VARCHAR) || '_' || name || '_' || opt AS path, label, 'bubble' AS kind, 'S' || CAST(scan_id AS VARCHAR) AS source, name AS field, opt AS value,
  CASE WHEN marked = 1 THEN 'marked' ELSE 'empty' END AS predicted, fill_ratio AS confidence FROM (SELECT b.*, CASE WHEN CONTAINS(t.expected, b.opt) THEN 'marked' ELSE 'empty' END AS label
  FROM f_bubbles b JOIN f_truth t ON t.scan_id = b.scan_id AND t.name = b.name WHERE t.expected <> '*') x"""


def labelled(t: Tables):
    """What a manifest needs of the labelled bubbles."""
    wanted = ("scan_id", "name", "opt", "label", "marked", "fill_ratio")
    return mlprep.samples(t.bubbles, t.truth, OPTIONS).select(*wanted)


def manifest(t: Tables):
    return mlprep.manifest(labelled(t))


@query("ml_manifest", "SELECT * FROM f_manifest")
def _(t):
    return manifest(t)


@query(
    "ml_split",
    """SELECT m.source, m.label, CASE WHEN place <= GREATEST(ROUND(total * 0.15), 1) THEN 'validation' ELSE 'train' END AS part, COUNT(*) AS n FROM f_manifest m JOIN
       (SELECT source, ROW_NUMBER() OVER (ORDER BY MD5(source || ':0'), source) AS place, COUNT(*) OVER () AS total FROM (SELECT DISTINCT source FROM f_manifest) s) g ON g.source = m.source GROUP BY 1, 2, 3
       UNION ALL SELECT src, label, CASE WHEN place <= GREATEST(ROUND(total * 0.15), CASE WHEN total >= 2 THEN 1 ELSE 0 END) THEN 'validation' ELSE 'train' END, COUNT(*) FROM
       (SELECT lang AS src, source AS label, ROW_NUMBER() OVER (PARTITION BY source ORDER BY MD5(doc_id || ':0'), doc_id) AS place, COUNT(*) OVER (PARTITION BY source) AS total FROM documents) d GROUP BY 1, 2, 3""",
)
def _(t):
    # The texts come in four languages only, too few groups, so they are split by label
    parts = [
        mlprep.split(manifest(t), "source", "path", "label").select("source", "label", "part"),
        mlprep.split(
            t.raw("documents").select("doc_id", F.col("lang").alias("source"), F.col("source").alias("label")), "source", "doc_id", "label"
        ).select("source", "label", "part"),
    ]
    return parts[0].unionByName(parts[1]).groupBy("source", "label", "part").agg(F.count("*").alias("n"))


@query(
    "ml_label_order",
    "SELECT label, ROW_NUMBER() OVER (ORDER BY CASE label WHEN 'empty' THEN 0 WHEN 'marked' THEN 1 ELSE 2 END, label) - 1 AS index FROM (SELECT DISTINCT CASE WHEN flag = 'low_confidence' THEN 'erased' WHEN value = '' THEN 'empty' ELSE 'marked' END AS label FROM f_cells) x",
)
def _(t):
    label = F.when(F.col("flag") == "low_confidence", "erased").when(F.col("value") == "", "empty").otherwise("marked")
    return mlprep.label_order(t.cells.select(label.alias("label")), "label")


VIEWS["f_logits"] = "SELECT vec_id, label AS target, [CAST(x AS DOUBLE) * 8 FOR x IN embedding[1:10]] AS l FROM embeddings"
VIEWS["f_probs"] = """SELECT vec_id, target, l, list_max(l) AS top, list_position(l, list_max(l)) - 1 AS predicted FROM f_logits"""


def logits(t: Tables):
    ten = F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double") * 8)
    return t.raw("embeddings").select("vec_id", F.col("label").alias("target"), ten.alias("logits"))


@query(
    "ag_nll",
    "SELECT ROUND(AVG(-GREATEST(l[target + 1] - top - LN(list_sum([EXP(x - top) FOR x IN l])), LN(1e-12))), 6) AS nll, COUNT(*) AS n FROM f_probs",
)
def _(t):
    return mlprep.nll(logits(t))


@query(
    "ag_ece",
    """SELECT ROUND(SUM(n * gap) / SUM(n), 6) AS ece, SUM(n) AS n FROM (SELECT CEIL(c * 15) AS bin, COUNT(*) AS n, ABS(AVG(r) - AVG(c)) AS gap FROM
       (SELECT 1.0 / list_sum([EXP(x - top) FOR x IN l]) AS c, CASE WHEN predicted = target THEN 1.0 ELSE 0.0 END AS r FROM f_probs) p GROUP BY 1) b""",
)
def _(t):
    return mlprep.calibration_error(logits(t))


_CLASS = """WITH c AS ({0}), a AS (SELECT target AS label, COUNT(*) AS support, COUNT(*) FILTER (target = predicted) AS tp FROM c GROUP BY 1), g AS (SELECT predicted AS label, COUNT(*) AS given FROM c GROUP BY 1),
  x AS (SELECT label, COALESCE(support, 0) AS support, COALESCE(tp / NULLIF(given, 0), 0) AS p, COALESCE(tp / NULLIF(support, 0), 0) AS r FROM a FULL JOIN g USING (label))
  SELECT label, ROUND(p, 5) AS precision, ROUND(r, 5) AS recall, ROUND(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 5) AS f1, support,
  (SELECT ROUND(COUNT(*) FILTER (target = predicted) / COUNT(*), 5) FROM c) AS accuracy FROM x"""


@query("ag_class_metrics", _CLASS.format("SELECT target, predicted FROM f_probs UNION ALL SELECT 100 + l.quality, 100 + CASE WHEN d.n_chars > 700 THEN 1 ELSE 0 END FROM labels l JOIN documents d ON d.doc_id = l.doc_id"))
def _(t):
    # Two sets side by side: the classifier's ten classes, and quality against length
    one = logits(t).select("target", mlprep.predicted(F.col("logits")).alias("predicted"))
    longer = F.when(F.col("n_chars") > 700, 101).otherwise(100)
    docs = t.raw("documents").select("doc_id", "n_chars")
    two = t.raw("labels").join(docs, "doc_id").select((100 + F.col("quality")).alias("target"), longer.alias("predicted"))
    return mlprep.class_metrics(one.unionByName(two))


def _temperature_sql() -> str:
    """Bisection on the sign of the slope of the mean loss, by the logarithm of the temperature."""
    z = "list_sum([EXP((x - top) / t) FOR x IN l])"
    log_p = f"(l[target + 1] - top) / t - LN({z})"
    slope = f"AVG(CASE WHEN {log_p} > LN(1e-12) THEN list_sum([x * EXP((x - top) / t) FOR x IN l]) / {z} - l[target + 1] ELSE 0 END)"
    steps = ["b0 AS (SELECT 0.05::DOUBLE AS low, 20.0::DOUBLE AS high)"]
    for k in range(40):
        # a rising slope in 1 / t: above zero, the least loss lies at a higher temperature
        steps.append(
            f"b{k + 1} AS MATERIALIZED (SELECT CASE WHEN g > 0 THEN t ELSE low END AS low, CASE WHEN g > 0 THEN high ELSE t END AS high FROM"
            f" (SELECT low, high, t, {slope} AS g FROM f_probs, (SELECT low, high, SQRT(low * high) AS t FROM b{k}) m GROUP BY ALL) s)"
        )
    loss = "AVG(-GREATEST({0}, LN(1e-12)))"
    return f"""WITH {", ".join(steps)}, e AS (SELECT t, {loss.format(log_p)} AS loss, {loss.format("l[target + 1] - top - LN(list_sum([EXP(x - top) FOR x IN l]))")} AS plain, COUNT(*) AS n, COUNT(*) FILTER (predicted <> target) AS errors
       FROM f_probs, (SELECT SQRT(low * high) AS t FROM b40) m GROUP BY t) SELECT ROUND(CASE WHEN loss > plain THEN 1.0 ELSE t END, 4) AS temperature, n, errors FROM e"""


@query(
    "ag_confusion",
    """WITH k AS (SELECT UNNEST(list_distinct(list_concat(list(target), list(predicted)))) AS c FROM f_probs), n AS (SELECT target, predicted, COUNT(*) AS n FROM f_probs GROUP BY ALL)
       SELECT a.c AS target, b.c AS predicted, COALESCE(n.n, 0) AS n FROM k a CROSS JOIN k b LEFT JOIN n ON n.target = a.c AND n.predicted = b.c""",
)
def _(t):
    return mlprep.confusion_matrix(logits(t).select("target", mlprep.predicted(F.col("logits")).alias("predicted")))


@query("ml_temperature", _temperature_sql())
def _(t):
    return mlprep.fit_temperature(logits(t)).withColumn("temperature", F.round("temperature", 4))


_U = "CAST('0x' || SUBSTR(MD5('7:' || scan_id || ':' || name || ':{0}'), 1, 8) AS BIGINT) / 4294967296.0"


@query(
    "ml_synthetic",
    f"""SELECT scan_id, name, CASE WHEN u < 0.1 THEN '' WHEN u < 0.15 THEN SUBSTR('ABCD', LEAST(f, (f + 1) % 4) + 1, 1) || SUBSTR('ABCD', GREATEST(f, (f + 1) % 4) + 1, 1) ELSE SUBSTR('ABCD', f + 1, 1) END AS value FROM
       (SELECT scan_id, name, {_U.format(0)} AS u, CAST(FLOOR({_U.format(1)} * 4) AS INTEGER) AS f FROM (SELECT CAST(o_orderkey AS VARCHAR) AS sid, o_orderkey AS scan_id FROM orders) s, (VALUES ('q1'), ('q2'), ('q3')) q(name)) x""",
)
def _(t):
    return mlprep.random_answers(t.scans, ["q1", "q2", "q3"], ["A", "B", "C", "D"], 0.1, 0.05, seed=7)


@query("ml_palette")
def _(t):
    # One colour per measured bubble and three of paper around it, on every sheet
    level = F.col("mean_intensity").cast("int")
    ink = t.bubbles.select("scan_id", (level * 9 / 10).cast("int").alias("b"), (level * 3 / 4).cast("int").alias("g"), level.alias("r"), F.lit(1).alias("n"))
    paper = t.bubbles.select("scan_id", F.lit(250).alias("b"), F.lit(252).alias("g"), F.lit(251).alias("r"), F.lit(3).alias("n"))
    return mlprep.palette(ink.unionByName(paper), "scan_id")


@query(
    "jn_truth",
    """SELECT s.scan_id, COALESCE(a.value, b.value, d.value) AS value, CASE WHEN a.key IS NOT NULL THEN 'id' WHEN b.key IS NOT NULL THEN 'name' WHEN d.key IS NOT NULL THEN 'stem' END AS matched FROM f_scans s
       LEFT JOIN f_keys a ON a.key = s.file_name LEFT JOIN f_keys b ON b.key = split_part(s.file_name, '/', 2) LEFT JOIN
       (SELECT regexp_replace(split_part(key, '/', -1), '\\.[^.]+$', '') AS stem, arg_min(value, pos) AS value, MIN(key) AS key FROM f_keys GROUP BY 1) d ON d.stem = regexp_replace(split_part(s.file_name, '/', 2), '\\.[^.]+$', '')""",
)
def _(t):
    return label_files.lookup_truth(t.scans, truth_keys(t))


VIEWS["f_keys"] = r"""SELECT scan_id AS pos, status AS value, CASE scan_id % 4 WHEN 0 THEN file_name WHEN 1 THEN split_part(file_name, '/', 2)
  WHEN 2 THEN 'old/' || regexp_replace(split_part(file_name, '/', 2), '\.[^.]+$', '') || '.tif' ELSE NULL END AS key FROM f_scans WHERE scan_id % 4 < 3"""


def truth_keys(t: Tables):
    from answerlake.functions import text as tx

    name = tx.base_name(F.col("file_name"))
    kind = F.col("scan_id") % 4
    key = (
        F.when(kind == 0, F.col("file_name"))
        .when(kind == 1, name)
        .otherwise(F.concat(F.lit("old/"), tx.stem(F.col("file_name")), F.lit(".tif")))
    )
    return t.scans.where("scan_id % 4 < 3").select(F.col("scan_id").alias("pos"), F.col("status").alias("value"), key.alias("key"))


@query(
    "wn_stem_first",
    r"""SELECT stem, pos, value FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY stem ORDER BY pos) AS rk FROM (SELECT CONCAT('S', CAST(pos % 500 AS VARCHAR)) AS stem, pos, value FROM f_keys) k) r WHERE rk = 1""",
)
def _(t):
    stem = F.concat(F.lit("S"), (F.col("pos") % 500).cast("string"))
    first = F.min_by(F.struct("pos", "value"), "pos").alias("f")
    return truth_keys(t).groupBy(stem.alias("stem")).agg(first).select("stem", "f.pos", "f.value")
