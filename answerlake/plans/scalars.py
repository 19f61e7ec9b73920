"""Queries that run each column function over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from answerlake.functions import text as tx
from answerlake.functions import values as vl
from answerlake.plans.derived import VIEWS, Tables
from answerlake.plans.registry import query

ANSWERS = ["A", "N", "R"]
WIDE = ["1", "10", "11", "101"]

# Short texts of many shapes, one per part.
VIEWS["f_texts"] = """
SELECT p_partkey AS id, CASE p_partkey % 8
  WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN CONCAT('0', CAST(p_size AS VARCHAR))
  WHEN 2 THEN CONCAT(CAST(p_size AS VARCHAR), '.50') WHEN 3 THEN p_name WHEN 4 THEN 'Y' WHEN 5 THEN ' '
  WHEN 6 THEN CONCAT(LPAD(CAST(p_size % 28 + 1 AS VARCHAR), 2, '0'), LPAD(CAST(p_partkey % 12 + 1 AS VARCHAR), 2, '0'), '2001')
  ELSE CONCAT(CAST(p_size AS VARCHAR), '/', CAST(p_size % 7 + 1 AS VARCHAR)) END AS text,
  CONCAT('q', CAST(p_size % 7 + 1 AS VARCHAR), CASE WHEN p_partkey % 2 = 0 THEN '..' ELSE '..q' END,
         CAST(p_size % 7 + p_partkey % 5 AS VARCHAR)) AS span
FROM part"""


def texts(t: Tables):
    key, size = F.col("p_partkey"), F.col("p_size")
    number = size.cast("string")
    two = lambda n: F.lpad((n + 1).cast("string"), 2, "0")
    choice = [
        number,
        F.concat(F.lit("0"), number),
        F.concat(number, F.lit(".50")),
        F.col("p_name"),
        F.lit("Y"),
        F.lit(" "),
        F.concat(two(size % 28), two(key % 12), F.lit("2001")),
        F.concat(number, F.lit("/"), (size % 7 + 1).cast("string")),
    ]
    text = choice[-1]
    for i in range(6, -1, -1):
        text = F.when(key % 8 == i, choice[i]).otherwise(text)
    span = F.concat(
        F.lit("q"),
        (size % 7 + 1).cast("string"),
        F.when(key % 2 == 0, "..").otherwise("..q"),
        (size % 7 + key % 5).cast("string"),
    )
    return t.raw("part").select(key.alias("id"), text.alias("text"), span.alias("span"))


_SPAN = r"""SELECT id, span, CASE WHEN lo {op} hi THEN ARRAY_TO_STRING([CONCAT('q', CAST(n AS VARCHAR)) FOR n IN RANGE(lo, hi + 1)], ' ') END AS names
FROM (SELECT id, span, CAST(regexp_extract(span, '^q(\d+)', 1) AS BIGINT) AS lo,
      CAST(regexp_extract(span, '(\d+)$', 1) AS BIGINT) AS hi FROM f_texts{where}) s"""


@query("fn_expand_range", _SPAN.format(where="", op="<="))
def _(t):
    names = F.array_join(tx.range_names(F.col("span")), " ")
    return texts(t).select("id", "span", names.alias("names"))


@query(
    "fn_expand_field",
    "SELECT names AS name, COUNT(*) AS parts FROM (SELECT UNNEST(string_split(names, ' ')) AS names FROM ("
    + _SPAN.format(where=" WHERE id % 2 = 0", op="<")
    + ") x WHERE names IS NOT NULL) y GROUP BY 1",
)
def _(t):
    name = F.explode(tx.range_names(F.col("span"), strict=True)).alias("name")
    return (
        texts(t).where(~F.col("span").contains("..q")).select(name).groupBy("name").agg(F.count("*").alias("parts"))
    )


@query(
    "fn_compress_labels",
    """SELECT scan_id, STRING_AGG(piece, ',' ORDER BY lo) AS labels FROM (
       SELECT scan_id, MIN(pos) AS lo, CASE WHEN COUNT(*) > 1 THEN CONCAT('q', MIN(pos), '..', MAX(pos))
              ELSE CONCAT('q', MIN(pos)) END AS piece
       FROM (SELECT scan_id, pos, pos - ROW_NUMBER() OVER (PARTITION BY scan_id ORDER BY pos) AS island FROM f_cells) i
       GROUP BY scan_id, island) p GROUP BY scan_id""",
)
def _(t):
    rank = F.row_number().over(Window.partitionBy("scan_id").orderBy("pos"))
    first, last = F.min("pos"), F.max("pos")
    prefix = F.concat(F.lit("q"), first.cast("string"))
    piece = F.when(
        first < last, F.concat(prefix, F.lit(".."), last.cast("string"))
    ).otherwise(prefix)
    runs = (
        t.cells.select("scan_id", "pos", (F.col("pos") - rank).alias("island"))
        .groupBy("scan_id", "island")
        .agg(F.struct(first.alias("lo"), piece.alias("piece")).alias("run"))
    )
    joined = F.array_join(F.array_sort(F.collect_list("run"))["piece"], ",")
    return runs.groupBy("scan_id").agg(joined.alias("labels"))


@query(
    "fn_fraction",
    """SELECT id, text, ROUND(CASE WHEN text LIKE '%/%' THEN CAST(split_part(text, '/', 1) AS DOUBLE) / CAST(split_part(text, '/', 2) AS DOUBLE)
       ELSE TRY_CAST(text AS DOUBLE) END, 6) AS number FROM f_texts""",
)
def _(t):
    return texts(t).select("id", "text", F.round(tx.fraction(F.col("text")), 6).alias("number"))


@query(
    "fn_answer_type",
    """SELECT name AS question, CASE WHEN n = 1 THEN 'standard' WHEN marks = 1 THEN 'multiple-correct'
       ELSE 'multiple-correct-weighted' END AS answer_type, n AS answers FROM (
       SELECT name, COUNT(DISTINCT value) AS n, COUNT(DISTINCT LENGTH(value)) AS marks FROM f_cells WHERE value <> '' GROUP BY 1) x""",
)
def _(t):
    # Every answer seen is allowed; a multi-mark is worth its length, so marks differ by length
    seen = t.cells.where("value <> ''").groupBy("name").agg(
        F.count_distinct("value").alias("n"), F.count_distinct(F.length("value")).alias("marks")
    )
    kind = (
        F.when(F.col("n") == 1, "standard")
        .when(F.col("marks") == 1, "multiple-correct")
        .otherwise("multiple-correct-weighted")
    )
    return seen.select(
        F.col("name").alias("question"), kind.alias("answer_type"), F.col("n").alias("answers")
    )


# ---- group columns: q1..q4 joined into one value per sheet --------------------------------

_STATE = """CASE WHEN value = '' AND NOT reviewed AND needs_review = 1 AND flag NOT IN ('', 'empty') THEN 'issue'
 WHEN value = '' THEN 'empty' WHEN reviewed THEN 'ok' WHEN flag = 'multi_marked' THEN 'multi'
 WHEN needs_review = 1 THEN 'issue' ELSE 'ok' END"""
VIEWS["f_columns"] = f"""SELECT scan_id, pos, name, value, needs_review, {_STATE} AS state
FROM (SELECT *, scan_id % 7 = 0 AS reviewed FROM f_cells) c"""


def columns(t: Tables):
    flags = F.filter(F.array("flag"), lambda f: f != "")
    state = vl.column_state(
        F.col("value"), flags, F.col("needs_review") == 1, F.col("scan_id") % 7 == 0
    )
    return t.cells.select("scan_id", "pos", "name", "value", "needs_review", state.alias("state"))


@query("fn_column_state", "SELECT name, state, COUNT(*) AS n FROM f_columns GROUP BY 1, 2")
def _(t):
    return columns(t).groupBy("name", "state").agg(F.count("*").alias("n"))


_FLAGGED = "(state = 'issue' OR (state = 'multi' AND needs_review = 1))"


@query(
    "fn_column_flagged",
    f"SELECT scan_id, name, state FROM f_columns WHERE {_FLAGGED}",
)
def _(t):
    flagged = vl.column_flagged(F.col("state"), F.col("needs_review") == 1)
    return columns(t).where(flagged).select("scan_id", "name", "state")


@query(
    "fn_join_group",
    f"""SELECT scan_id, STRING_AGG(CASE state WHEN 'ok' THEN value WHEN 'empty' THEN ' ' WHEN 'multi' THEN '*' ELSE '-' END,
       '' ORDER BY pos) AS value, BOOL_OR({_FLAGGED}) AS flagged FROM f_columns GROUP BY scan_id""",
)
def _(t):
    piece = vl.column_piece(F.col("value"), F.col("state"))
    flagged = vl.column_flagged(F.col("state"), F.col("needs_review") == 1)
    parts = F.array_sort(F.collect_list(F.struct("pos", piece.alias("piece"))))
    return columns(t).groupBy("scan_id").agg(
        F.array_join(parts["piece"], "").alias("value"), F.bool_or(flagged).alias("flagged")
    )


# ---- text ---------------------------------------------------------------------------------

_WS = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"


@query(
    "fn_normalize",
    rf"""SELECT doc_id, MD5(regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g')) AS stripped,
       regexp_replace(text, '\P{{Nd}}', '', 'g') AS digits, MD5(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g')) AS alnum,
       regexp_extract(text, '([A-Z])\w+', 1) AS first_upper FROM documents""",
)
def _(t):
    text = F.col("text")
    return t.raw("documents").select(
        "doc_id",
        F.md5(tx.normalize(text, "strip")).alias("stripped"),
        tx.normalize(text, "digits").alias("digits"),
        F.md5(tx.normalize(text, "alnum")).alias("alnum"),
        tx.normalize(text, (r"([A-Z])\w+", 1)).alias("first_upper"),
    )


@query(
    "fn_squeeze",
    rf"""SELECT doc_id, MD5(regexp_replace(text, '{_WS}+', '', 'g')) AS squeezed,
       LENGTH(regexp_replace(text, '{_WS}+', '', 'g')) AS n FROM documents""",
)
def _(t):
    out = tx.squeeze(F.col("text"), spaces=True, case=True)
    return t.raw("documents").select(
        "doc_id", F.md5(out).alias("squeezed"), F.length(out).cast("bigint").alias("n")
    )


@query(
    "fn_text_normalise",
    rf"SELECT p_partkey, UPPER(regexp_replace(p_name, '{_WS}+', '', 'g')) AS text FROM part",
)
def _(t):
    return t.raw("part").select("p_partkey", tx.squeeze(F.col("p_name")).alias("text"))


_BARE = "regexp_replace(regexp_replace({0}, '\\P{{Nd}}', '', 'g'), '^0+', '')"


@query(
    "fn_key_of",
    rf"""SELECT c_custkey, CASE WHEN d = '' THEN '0' ELSE d END AS digits, LOWER(c_name) AS folded FROM (
       SELECT c_custkey, c_name, {_BARE.format('c_name')} AS d FROM customer) c""",
)
def _(t):
    name = F.col("c_name")
    return t.raw("customer").select(
        "c_custkey", tx.key_of(name, "digits").alias("digits"), tx.key_of(name, "text").alias("folded")
    )


VIEWS["f_paths"] = """SELECT scan_id, CASE scan_id % 4 WHEN 0 THEN file_name
  WHEN 1 THEN CONCAT('C:\\in\\S', CAST(scan_id AS VARCHAR), '.TIF')
  WHEN 2 THEN CONCAT('scans/2024/S', CAST(scan_id AS VARCHAR), '_p', CAST(scan_id % 5 AS VARCHAR), '.png')
  ELSE CONCAT('scans/S ', CAST(scan_id AS VARCHAR), '.v1.png') END AS path FROM f_scans"""


def paths(t: Tables):
    scan = F.col("scan_id")
    text = scan.cast("string")
    path = (
        F.when(scan % 4 == 0, F.col("file_name"))
        .when(scan % 4 == 1, F.concat(F.lit("C:\\in\\S"), text, F.lit(".TIF")))
        .when(
            scan % 4 == 2,
            F.concat(
                F.lit("scans/2024/S"), text, F.lit("_p"), (scan % 5).cast("string"), F.lit(".png")
            ),
        )
        .otherwise(F.concat(F.lit("scans/S "), text, F.lit(".v1.png")))
    )
    return t.scans.select("scan_id", path.alias("path"))


_STEM = r"regexp_replace(regexp_extract(path, '([^/]*)/*$', 1), '^(.+)\.[^.]+$', '\1')"


@query(
    "fn_file_key",
    rf"""SELECT scan_id, CASE WHEN LOWER(path) LIKE '%.png' THEN regexp_replace({_STEM}, '_p\d+$', '')
       ELSE {_STEM} END AS file_key FROM f_paths""",
)
def _(t):
    return paths(t).select("scan_id", tx.file_key(F.col("path")).alias("file_key"))


@query(
    "fn_zone_filename",
    rf"""SELECT scan_id, regexp_replace(regexp_replace(regexp_replace({_STEM} || '_roll_' || regexp_extract({_STEM}, '_p(\d+)$', 1),
       '.*/', ''), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') || '.png' AS file_name FROM f_paths""",
)
def _(t):
    name = tx.zone_file_name(F.col("path"), F.lit("roll"), "{file}_{zone}_{page}")
    return paths(t).select("scan_id", name.alias("file_name"))


@query(
    "fn_slug",
    r"""SELECT p_partkey, LOWER(regexp_replace(regexp_replace(p_type || ' / ' || p_brand || ' - ' || p_name, '[^A-Za-z0-9._-]+', '-', 'g'),
       '^[-._]+|[-._]+$', '', 'g'))[1:60] AS slug, regexp_replace(p_brand || ' ' || p_name || '.csv', '[^A-Za-z0-9._-]+', '_', 'g')[1:150] AS file FROM part""",
)
def _(t):
    label = F.concat_ws(" - ", F.concat_ws(" / ", "p_type", "p_brand"), "p_name")
    file = F.concat(F.concat_ws(" ", "p_brand", "p_name"), F.lit(".csv"))
    return t.raw("part").select(
        "p_partkey", tx.slug(label).alias("slug"), tx.safe_file_name(file).alias("file")
    )


@query(
    "fn_name_key",
    r"""SELECT s_suppkey, regexp_replace(regexp_replace(LOWER(s_name), '[^0-9a-z]', '', 'g'), '^([a-z]*)0*([0-9]+)$', '\1\2') AS name_key
       FROM supplier""",
)
def _(t):
    return t.raw("supplier").select("s_suppkey", tx.name_key(F.col("s_name")).alias("name_key"))


@query(
    "so_natural",
    r"""SELECT p_partkey, ARRAY_TO_STRING([CASE WHEN regexp_matches(x, '^\d') THEN LPAD(CAST(LENGTH(LTRIM(x, '0')) AS VARCHAR), 4, '0') || LTRIM(x, '0')
       ELSE x END FOR x IN regexp_extract_all(LOWER(p_name || ' ' || p_brand || p_size), '\d+|\D+')], '') AS sort_key FROM part""",
)
def _(t):
    text = F.concat(F.concat_ws(" ", "p_name", "p_brand"), F.col("p_size").cast("string"))
    return (
        t.raw("part")
        .select("p_partkey", tx.natural_key(text).alias("sort_key"))
        .orderBy("sort_key", "p_partkey")
    )


@query(
    "fn_label_dir",
    """SELECT label, CASE WHEN label = '<blank>' THEN '_blank_' WHEN regexp_matches(label, '^[A-Za-z]+$') AND label <> LOWER(label) THEN label || '_upper'
       WHEN regexp_matches(label, '^[A-Za-z0-9_-]+$') THEN label
       ELSE 'u' || ARRAY_TO_STRING([LPAD(LOWER(to_hex(ord(c))), 4, '0') FOR c IN string_split(label, '')], '_') END AS folder, n
       FROM (SELECT CASE WHEN value = '' THEN '<blank>' WHEN LENGTH(value) = 2 THEN SUBSTR(value, 1, 1) || '+' ELSE value END AS label, COUNT(*) AS n FROM f_cells GROUP BY 1) x""",
)
def _(t):
    label = (
        F.when(F.col("value") == "", "<blank>")
        .when(F.length("value") == 2, F.concat(F.substring("value", 1, 1), F.lit("+")))
        .otherwise(F.col("value"))
    )
    return (
        t.cells.groupBy(label.alias("label"))
        .agg(F.count("*").alias("n"))
        .withColumn("folder", tx.label_folder(F.col("label")))
    )


@query("fn_file_sha", "SELECT doc_id, SHA256(text) AS sha FROM documents")
def _(t):
    return t.raw("documents").select("doc_id", F.sha2("text", 256).alias("sha"))


@query(
    "fn_version_hash",
    """SELECT lang, source, COUNT(*) AS files, BIT_XOR(CAST('0x' || SUBSTR(h, 1, 15) AS BIGINT)) AS fp1,
       BIT_XOR(CAST('0x' || SUBSTR(h, 16, 15) AS BIGINT)) AS fp2
       FROM (SELECT lang, source, SHA256(CAST(doc_id AS VARCHAR) || chr(10) || SHA256(text)) AS h FROM documents) d GROUP BY 1, 2""",
)
def _(t):
    parts = tx.set_fingerprint(F.col("doc_id").cast("string"), F.sha2("text", 256))
    return t.raw("documents").groupBy("lang", "source").agg(*parts)


@query(
    "fn_stable_id",
    "SELECT scan_id, SHA1(CAST(job_id AS VARCHAR) || ':' || CAST(seq AS VARCHAR) || ':0')[1:32] AS id FROM f_scans",
)
def _(t):
    ident = tx.stable_id(F.col("job_id"), F.col("seq"), F.lit(0))
    return t.scans_seq.select("scan_id", ident.alias("id"))


@query(
    "fn_deep_merge",
    """SELECT event_id, COALESCE(props->>'$.k', '0') AS k, 'adaptive' AS mode FROM events""",
)
def _(t):
    base = F.create_map(F.lit("k"), F.lit("0"), F.lit("mode"), F.lit("adaptive"))
    merged = vl.merge_maps(base, F.from_json("props", "map<string,string>"))
    return t.raw("events").select(
        "event_id", merged["k"].alias("k"), merged["mode"].alias("mode")
    )


# ---- second reader's values ---------------------------------------------------------------

VIEWS["f_pairs"] = """SELECT c.scan_id, c.pos, c.name, c.value, e.cell,
  CASE WHEN TRIM(e.cell) = '*' THEN 'multi' WHEN TRIM(e.cell) IN ('', '-') THEN 'blank' WHEN LENGTH(TRIM(e.cell)) > 1 THEN 'multi' ELSE 'value' END AS tk,
  CASE WHEN TRIM(e.cell) IN ('', '-', '*') THEN '' ELSE UPPER(TRIM(e.cell)) END AS tt,
  CASE WHEN c.value = '' THEN 'blank' WHEN LENGTH(c.value) > 1 THEN 'multi' ELSE 'value' END AS ok,
  ARRAY_TO_STRING(list_sort(string_split(c.value, '')), '') AS ot
  FROM f_cells c JOIN f_external e ON e.seq_key = CONCAT('S0', CAST(c.scan_id AS VARCHAR)) AND e.name = c.name AND e.copy = 1"""


def pairs(t: Tables):
    ext = t.external.where("copy = 1").select("seq_key", "name", "cell")
    ours = t.cells.withColumn("seq_key", F.concat(F.lit("S0"), F.col("scan_id").cast("string")))
    return ours.join(ext, ["seq_key", "name"])


RULES = vl.CompareRules()


def _theirs():
    return vl.external_value(F.col("cell"), RULES, F.lit(True))


def _ours():
    return vl.our_value(F.col("value"), F.lit(None), F.lit(True), F.lit(False), RULES)


@query("fn_external_value", "SELECT cell, tk AS kind, tt AS text, COUNT(*) AS n FROM f_pairs GROUP BY 1, 2, 3")
def _(t):
    return (
        pairs(t).select("cell", F.inline(F.array(_theirs()))).groupBy("cell", "kind", "text").agg(F.count("*").alias("n"))
    )


@query("fn_our_value", "SELECT value, ok AS kind, ot AS text, COUNT(*) AS n FROM f_pairs GROUP BY 1, 2, 3")
def _(t):
    return (
        pairs(t).select("value", F.inline(F.array(_ours()))).groupBy("value", "kind", "text").agg(F.count("*").alias("n"))
    )


_DIFFERS = """CASE WHEN tk = 'multi' AND ok = 'multi' THEN FALSE WHEN 'multi' IN (tk, ok) THEN TRUE ELSE tk <> ok OR tt <> ot END"""


@query(
    "fn_differs",
    f"""SELECT scan_id, name, {_DIFFERS} AS strict, CASE WHEN 'blank' IN (tk, ok) AND tk <> ok THEN NULL WHEN 'multi' IN (tk, ok) THEN NULL
       ELSE tk <> ok OR tt <> ot END AS lenient FROM f_pairs""",
)
def _(t):
    lenient = vl.CompareRules(blank="ignore", multi="ignore")
    p = pairs(t).select("scan_id", "name", _theirs().alias("a"), _ours().alias("b"))
    return p.select(
        "scan_id",
        "name",
        vl.differs(F.col("a"), F.col("b"), RULES).alias("strict"),
        vl.differs(F.col("a"), F.col("b"), lenient).alias("lenient"),
    )


@query(
    "fn_shown",
    """SELECT cell, value, CASE WHEN tk = 'blank' THEN '' ELSE TRIM(cell) END AS theirs, CASE WHEN ok = 'blank' THEN '' ELSE value END AS ours,
       COUNT(*) AS n FROM f_pairs GROUP BY 1, 2, 3, 4""",
)
def _(t):
    p = pairs(t).select(
        "cell",
        "value",
        vl.shown(F.col("cell"), _theirs()["kind"]).alias("theirs"),
        vl.shown(F.col("value"), _ours()["kind"]).alias("ours"),
    )
    return p.groupBy("cell", "value", "theirs", "ours").agg(F.count("*").alias("n"))


BANDS = "A: q1..q4; N: q5..7\nR = q2,q6"


@query(
    "fn_sheet_band",
    """SELECT scan_id, theirs, ours, COALESCE(t.names, o.names, 'all') AS band FROM
       (SELECT scan_id, UPPER(TRIM(cell)) AS theirs, value AS ours FROM f_pairs WHERE name = 'q1') p
       LEFT JOIN (VALUES ('A', 'q1,q2,q3,q4'), ('N', 'q5,q6,q7'), ('R', 'q2,q6')) t(level, names) ON t.level = theirs
       LEFT JOIN (VALUES ('A', 'q1,q2,q3,q4'), ('N', 'q5,q6,q7'), ('R', 'q2,q6')) o(level, names) ON o.level = ours""",
)
def _(t):
    p = pairs(t).where("name = 'q1'")
    theirs, ours = F.upper(tx.strip(F.col("cell"))), F.col("value")
    band = vl.sheet_band(vl.parse_bands(BANDS), theirs, ours)
    text = F.coalesce(F.array_join(band, ","), F.lit("all"))
    return p.select(
        "scan_id", theirs.alias("theirs"), ours.alias("ours"), text.alias("band")
    )


@query(
    "st_band_union",
    """SELECT scan_id, COALESCE((SELECT STRING_AGG(DISTINCT q, ',' ORDER BY q) FROM (SELECT UNNEST(string_split(CONCAT_WS(',', t.names, o.names), ',')) AS q) u WHERE q <> ''), 'all') AS band FROM
       (SELECT scan_id, UPPER(TRIM(cell)) AS theirs, value AS ours FROM f_pairs WHERE name = 'q1') p
       LEFT JOIN (VALUES ('A', 'q1,q2,q3,q4'), ('N', 'q5,q6,q7'), ('R', 'q2,q6')) t(level, names) ON t.level = theirs
       LEFT JOIN (VALUES ('A', 'q1,q2,q3,q4'), ('N', 'q5,q6,q7'), ('R', 'q2,q6')) o(level, names) ON o.level = ours""",
)
def _(t):
    band = vl.sheet_band(vl.parse_bands(BANDS), F.col("cell"), F.col("value"), "either")
    text = F.coalesce(F.array_join(F.array_sort(band), ","), F.lit("all"))
    return pairs(t).where("name = 'q1'").select("scan_id", text.alias("band"))


@query(
    "fn_bands_parse",
    """SELECT level, name, COUNT(c.scan_id) AS sheets FROM (SELECT level, UNNEST(string_split(names, ',')) AS name FROM
       (VALUES ('A', 'q1,q2,q3,q4'), ('N', 'q5,q6,q7'), ('R', 'q2,q6')) b(level, names)) b
       JOIN f_cells c USING (name) WHERE c.value = level GROUP BY level, name""",
)
def _(t):
    import pyarrow as pa

    from answerlake.config import local_frame

    rows = [(k, n) for k, names in vl.parse_bands(BANDS).items() for n in names]
    bands = local_frame(t.spark, rows, pa.schema([("level", pa.string()), ("name", pa.string())]))
    return (
        t.cells.join(bands, "name")
        .where("value = level")
        .groupBy("level", "name")
        .agg(F.count("scan_id").alias("sheets"))
    )


# ---- bubble values ------------------------------------------------------------------------


@query(
    "fn_split_value",
    "SELECT scan_id, name, ARRAY_TO_STRING(string_split(value, ''), '+') AS picks FROM f_cells",
)
def _(t):
    picks = F.array_join(vl.split_value(F.col("value"), ANSWERS), "+")
    return t.cells.select("scan_id", "name", picks.alias("picks"))


_DIGITS = "CAST(CASE l_linenumber WHEN 1 THEN 1 WHEN 2 THEN 10 WHEN 3 THEN 11 WHEN 4 THEN 101 WHEN 5 THEN 1011 WHEN 6 THEN 110 ELSE 12 END AS VARCHAR)"


@query(
    "fn_split_ordered",
    r"""SELECT digits, CASE WHEN regexp_matches(digits, '^(1)?(10)?(11)?(101)?$') THEN CONCAT(
       CASE WHEN regexp_extract(digits, '^(1)?(10)?(11)?(101)?$', 1) <> '' THEN '0' ELSE '' END, CASE WHEN regexp_extract(digits, '^(1)?(10)?(11)?(101)?$', 2) <> '' THEN '1' ELSE '' END,
       CASE WHEN regexp_extract(digits, '^(1)?(10)?(11)?(101)?$', 3) <> '' THEN '2' ELSE '' END, CASE WHEN regexp_extract(digits, '^(1)?(10)?(11)?(101)?$', 4) <> '' THEN '3' ELSE '' END) END AS bubbles,
       COUNT(*) AS n FROM (SELECT """
    + _DIGITS
    + " AS digits FROM lineitem) x GROUP BY 1, 2",
)
def _(t):
    digits = F.expr(_DIGITS.replace("VARCHAR", "STRING"))
    bubbles = F.array_join(vl.split_ordered(F.col("digits"), WIDE), "")
    return (
        t.raw("lineitem")
        .select(digits.alias("digits"))
        .groupBy("digits", bubbles.alias("bubbles"))
        .agg(F.count("*").alias("n"))
    )


@query(
    "fn_toggle",
    """SELECT scan_id, name, CONCAT(CASE WHEN CONTAINS(value, 'A') THEN 'A' ELSE '' END,
       CASE WHEN NOT CONTAINS(value, 'N') THEN 'N' ELSE '' END, CASE WHEN CONTAINS(value, 'R') THEN 'R' ELSE '' END) AS toggled FROM f_cells""",
)
def _(t):
    out = vl.toggled(F.col("value"), F.lit("N"), ANSWERS)
    return t.cells.select("scan_id", "name", out.alias("toggled"))


@query(
    "fn_valid_combo",
    "SELECT name, COUNT(*) FILTER (NOT CONTAINS(value, 'R')) AS valid, COUNT(*) AS n FROM f_cells GROUP BY 1",
)
def _(t):
    valid = vl.split_value(F.col("value"), ["A", "N"]).isNotNull()
    return t.cells.groupBy("name").agg(F.count_if(valid).alias("valid"), F.count("*").alias("n"))


@query(
    "fn_distribute",
    r"""SELECT scan_id, joined, CASE WHEN LENGTH(joined) <= 4 THEN CONCAT(TRIM(SUBSTR(joined, 1, 1)), '|', TRIM(SUBSTR(joined, 2, 1)), '|', TRIM(SUBSTR(joined, 3, 1)), '|', TRIM(SUBSTR(joined, 4, 1))) END AS cells
       FROM (SELECT scan_id, STRING_AGG(CASE WHEN value = '' THEN ' ' ELSE SUBSTR(value, 1, 1) END, '' ORDER BY pos) AS joined FROM f_cells GROUP BY 1) g""",
)
def _(t):
    mark = F.when(F.col("value") == "", " ").otherwise(F.substring("value", 1, 1))
    parts = F.array_sort(F.collect_list(F.struct("pos", mark.alias("mark"))))["mark"]
    joined = t.cells.groupBy("scan_id").agg(F.array_join(parts, "").alias("joined"))
    cells = F.array_join(vl.distribute(F.col("joined"), [ANSWERS] * 4), "|")
    return joined.select("scan_id", "joined", cells.alias("cells"))


@query(
    "fn_same_value",
    r"""SELECT a.p_partkey, a.p_size, CASE WHEN d = l OR TRIM(d) = l THEN TRUE WHEN d LIKE '%*%' THEN FALSE WHEN REPLACE(d, ' ', '') = l THEN TRUE
       ELSE LTRIM(REPLACE(d, ' ', ''), '0') = LTRIM(l, '0') AND LENGTH(REPLACE(d, ' ', '')) <= LENGTH(l) + 1 END AS same
       FROM (SELECT p_partkey, p_size, CAST(p_size AS VARCHAR) AS l, CASE p_partkey % 5 WHEN 0 THEN ' ' || p_size WHEN 1 THEN '0' || p_size
             WHEN 2 THEN '00' || p_size WHEN 3 THEN '*' || p_size ELSE '1 ' || (p_size % 10) END AS d FROM part) a""",
)
def _(t):
    size = F.col("p_size").cast("string")
    kind = F.col("p_partkey") % 5
    decoded = F.concat(
        F.when(kind == 0, " ").when(kind == 1, "0").when(kind == 2, "00").when(kind == 3, "*").otherwise("1 "),
        F.when(kind == 4, (F.col("p_size") % 10).cast("string")).otherwise(size),
    )
    return t.raw("part").select("p_partkey", "p_size", vl.same_value(decoded, size).alias("same"))


# ---- typed values -------------------------------------------------------------------------


@query(
    "fn_cast",
    r"""SELECT id, CASE WHEN regexp_matches(x, '^[+-]?\d+$') AND NOT z THEN CAST(x AS BIGINT) END AS as_int,
       CASE WHEN x = '' THEN NULL WHEN NOT regexp_matches(x, '^[+-]?\d+$') THEN 'not a whole number' WHEN z THEN 'leading zero' END AS int_reason,
       CASE WHEN regexp_matches(x, '^[+-]?(\d+\.?\d*|\.\d+)$') AND NOT z THEN CAST(x AS DOUBLE) END AS as_number,
       CASE WHEN UPPER(x) IN ('1','Y','YES','TRUE','T','X') THEN TRUE WHEN UPPER(x) IN ('0','N','NO','FALSE','F','') THEN FALSE END AS as_bool,
       CAST(CAST(TRY_STRPTIME(CASE WHEN LENGTH(x) = 8 THEN x END, '%d%m%Y') AS DATE) AS VARCHAR) AS as_date
       FROM (SELECT id, TRIM(text) AS x, LENGTH(split_part(TRIM(text), '.', 1)) > 1 AND TRIM(text) LIKE '0%' AS z FROM f_texts) t""",
)
def _(t):
    text = F.col("text")
    whole = vl.cast_value(text, "int")
    day = vl.cast_value(text, "date", format="%d%m%Y")["value"]
    return texts(t).select(
        "id",
        whole["value"].alias("as_int"),
        whole["reason"].alias("int_reason"),
        vl.cast_value(text, "decimal")["value"].cast("double").alias("as_number"),
        vl.cast_value(text, "bool")["value"].alias("as_bool"),
        vl.text_of(day, "date").alias("as_date"),
    ).withColumn("as_date", F.nullif("as_date", F.lit("")))


@query(
    "fn_text_of",
    """SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS day, CAST(o_custkey AS VARCHAR) AS cust,
       CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END AS final FROM orders""",
)
def _(t):
    return t.raw("orders").select(
        "o_orderkey",
        vl.text_of(F.col("o_orderdate").cast("date"), "date", "%d/%m/%Y").alias("day"),
        vl.text_of(F.col("o_custkey"), "int").alias("cust"),
        vl.text_of(F.col("o_orderstatus") == "F", "bool").alias("final"),
    )


@query(
    "fn_csv_guard",
    r"""SELECT id, CASE WHEN regexp_matches(text, '^(0\d+|\d{16,})$') THEN '="' || text || '"' ELSE text END AS formula,
       CASE WHEN regexp_matches(text, '^(0\d+|\d{16,})$') THEN '''' || text ELSE text END AS quoted FROM f_texts""",
)
def _(t):
    text = F.col("text")
    return texts(t).select(
        "id", vl.csv_guard(text).alias("formula"), vl.csv_guard(text, "apostrophe").alias("quoted")
    )


_LIN = "CASE WHEN {0} / 255.0 > 0.04045 THEN POW(({0} / 255.0 + 0.055) / 1.055, 2.4) ELSE {0} / 255.0 / 12.92 END"
_F = "CASE WHEN {0} > 0.008856 THEN CBRT({0}) ELSE 7.787 * {0} + 16.0 / 116.0 END"


@query(
    "fn_to_lab",
    f"""WITH c AS (SELECT p_partkey, CAST(p_partkey % 256 AS DOUBLE) AS b, CAST(p_size * 5 % 256 AS DOUBLE) AS g, CAST(p_partkey * 7 % 256 AS DOUBLE) AS r FROM part),
       l AS (SELECT p_partkey, {_LIN.format('b')} AS lb, {_LIN.format('g')} AS lg, {_LIN.format('r')} AS lr FROM c),
       x AS (SELECT p_partkey, (0.412453 * lr + 0.357580 * lg + 0.180423 * lb) / 0.950456 AS x, 0.212671 * lr + 0.715160 * lg + 0.072169 * lb AS y,
             (0.019334 * lr + 0.119193 * lg + 0.950227 * lb) / 1.088754 AS z FROM l),
       f AS (SELECT p_partkey, {_F.format('x')} AS fx, {_F.format('y')} AS fy, {_F.format('z')} AS fz FROM x)
       SELECT p_partkey, ROUND(116.0 * fy - 16.0, 3) AS lightness, ROUND(500.0 * (fx - fy), 3) AS a, ROUND(200.0 * (fy - fz), 3) AS bb,
       ROUND(SQRT(POW(0.5 * (116.0 * fy - 16.0), 2) + POW(500.0 * (fx - fy), 2) + POW(200.0 * (fy - fz), 2)), 3) AS from_black FROM f""",
)
def _(t):
    key = F.col("p_partkey")
    bgr = [c.cast("double") for c in (key % 256, F.col("p_size") * 5 % 256, key * 7 % 256)]
    lightness, a, b = vl.lab(*bgr)
    black = [F.lit(0.0)] * 3
    return t.raw("part").select(
        "p_partkey",
        F.round(lightness, 3).alias("lightness"),
        F.round(a, 3).alias("a"),
        F.round(b, 3).alias("bb"),
        F.round(vl.lab_distance(bgr, black), 3).alias("from_black"),
    )


@query(
    "fn_box_union",
    """SELECT scan_id, MIN(x) AS x, MIN(y) AS y, MAX(x + 15) - MIN(x) AS w, MAX(y + 12) - MIN(y) AS h FROM
       (SELECT scan_id, opt_pos * 20 AS x, pos * 30 AS y FROM f_bubbles WHERE marked = 1) b GROUP BY scan_id""",
)
def _(t):
    x, y = F.col("opt_pos") * 20, F.col("pos") * 30
    return (
        t.bubbles.where("marked = 1")
        .groupBy("scan_id")
        .agg(
            F.min(x).alias("x"),
            F.min(y).alias("y"),
            (F.max(x + 15) - F.min(x)).alias("w"),
            (F.max(y + 12) - F.min(y)).alias("h"),
        )
    )


@query(
    "fn_expand_udtf",
    r"""SELECT CONCAT('q', CAST(n AS VARCHAR)) AS name, COUNT(*) AS parts FROM (SELECT UNNEST(RANGE(lo, hi + 1)) AS n FROM (SELECT CAST(regexp_extract(span, '^q(\d+)', 1) AS BIGINT) AS lo, CAST(regexp_extract(span, '(\d+)$', 1) AS BIGINT) AS hi
       FROM f_texts WHERE id % 2 = 0) s WHERE lo < hi) x GROUP BY 1""",
)
def _(t):
    from answerlake.functions import plugins

    # The table function runs once per distinct range, and the parts are counted before it
    plugins.register(t.spark)
    spans = texts(t).where(~F.col("span").contains("..q")).groupBy("span").agg(F.count("*").alias("n"))
    rows = spans.lateralJoin(plugins.ExpandFields(F.col("span").outer()))
    return rows.groupBy("name").agg(F.sum("n").alias("parts"))
