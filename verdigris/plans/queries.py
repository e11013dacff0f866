"""Registered queries over the reference operators, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions import match as M
from verdigris.functions import normalize as N
from verdigris.functions import spans as Sp
from verdigris.functions import stats as St
from verdigris.functions import text as T
from verdigris.operators import facts as Fa
from verdigris.operators import gates as G
from verdigris.operators import metrics as Me
from verdigris.operators import replies as R
from verdigris.operators import sampling as Sa
from verdigris.plans import inputs as I
from verdigris.plans.registry import Registry

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

LANGUAGES = {"english": "en", "deutsch": "de", "french": "fr", "spanish": "es"}
TASKS = Registry.of({"tasks": [
    {"id": "flag", "type": "binary", "question": "Is the length even?", "weight": 2},
    {"id": "lang", "type": "multiclass", "question": "Which language?", "output": {"enum": ["en", "de", "fr", "es"], "synonyms": LANGUAGES}},
    {"id": "number", "type": "extract_exact", "question": "Which number?"},
]})


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        _queries[name or f.__name__] = f
        if sql:
            _sql[name or f.__name__] = I.spelled(sql)
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- the same rules in SQL ------------------------------------------------------------------------------------------

WORDS = "('', '-', '--', 'n/a', 'na', 'nil', 'none', 'not applicable', 'not found', 'not specified', 'not stated', 'null', 'unspecified')"
CLEAN = lambda c: rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"
LOW = lambda c: f"lower({CLEAN(c)})"
GIVEN = lambda c, v: f"CASE WHEN {c} IS NULL OR {LOW(c)} IN {WORDS} THEN NULL ELSE {v} END"
BOOL = lambda c: GIVEN(c, f"CASE WHEN {LOW(c)} IN ('true','t','yes','y','1','affirmative','present') THEN 'true' WHEN {LOW(c)} IN ('false','f','no','n','0','negative','absent') THEN 'false' ELSE {LOW(c)} END")
LANG = lambda c: rf"""CASE WHEN {c} IS NULL THEN NULL WHEN {CLEAN(c)} IN ('en','de','fr','es') THEN {CLEAN(c)}
  WHEN {LOW(c)} = 'english' THEN 'en' WHEN {LOW(c)} = 'deutsch' THEN 'de' WHEN {LOW(c)} = 'french' THEN 'fr' WHEN {LOW(c)} = 'spanish' THEN 'es'
  WHEN regexp_replace({LOW(c)}, '[\s_\-.]+', '', 'g') IN ('en','de','fr','es') THEN regexp_replace({LOW(c)}, '[\s_\-.]+', '', 'g') WHEN {LOW(c)} IN {WORDS} THEN NULL ELSE {LOW(c)} END"""  # noqa: E731
FREE = lambda c: GIVEN(c, rf"""CASE WHEN regexp_matches({CLEAN(c)}, '^".+"$') THEN lower(trim(substr({CLEAN(c)}, 2, length({CLEAN(c)}) - 2))) ELSE {LOW(c)} END""")
_DOTS = lambda c: rf"regexp_replace(regexp_replace(regexp_replace({c}, '\b([a-z])\.([a-z])\.([a-z])\b\.?', '\1\2\3', 'g'), '\b([a-z])\.([a-z])\b\.?', '\1\2', 'g'), '[.,;:()\[\]''\x22`/\\]', ' ', 'g')"
SUFFIX = "incorporated|corporation|company|limited|inc|llc|llp|lllp|pllc|plc|ltd|corp|gmbh|ag|nv|bv|sa|spa|srl|pty|lp|pc|co"
ENTITY = lambda c: GIVEN(c, rf"trim(regexp_replace(regexp_replace({CLEAN(rf"regexp_replace({_DOTS(rf"replace({LOW(c)}, '&', ' and ')")}, '\s*-\s*', ' ', 'g')")}, '^(the|a|an) ', ''), '( ({SUFFIX}))+$', ''))")
SCALAR = "CAST(g IS NOT NULL AND p IS NOT NULL AND g = p AS BIGINT) AS tp, CAST(p IS NOT NULL AND (g IS NULL OR g <> p) AS BIGINT) AS fp, CAST(g IS NOT NULL AND (p IS NULL OR g <> p) AS BIGINT) AS fn, CAST(g IS NULL AND p IS NULL AS BIGINT) AS tn, (g IS NULL AND p IS NULL) OR coalesce(g = p, false) AS correct"
FACTS = f"""
n AS (SELECT doc_id, {BOOL('gold_flag')} AS g1, {BOOL('pred_flag')} AS p1, {LANG('gold_lang')} AS g2, {LANG('pred_lang')} AS p2, {FREE('gold_number')} AS g3, {FREE('pred_number')} AS p3 FROM ({I.CLASSES})),
u AS (SELECT CAST(doc_id AS STRING) AS doc_id, 'flag' AS task_id, 2.0 AS weight, g1 AS g, p1 AS p FROM n UNION ALL SELECT CAST(doc_id AS STRING), 'lang', 1.0, g2, p2 FROM n UNION ALL SELECT CAST(doc_id AS STRING), 'number', 1.0, g3, p3 FROM n),
facts AS (SELECT *, {SCALAR} FROM u)"""
PRF = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1"
CLASSCOUNTS = """
labels AS (SELECT 'flag' AS task_id, unnest(['true', 'false']) AS label UNION ALL SELECT 'lang', unnest(['en', 'de', 'fr', 'es'])),
seen AS (SELECT task_id, label, g, p FROM (SELECT task_id, g, p, unnest(list_distinct([g, p])) AS label FROM facts WHERE task_id <> 'number') WHERE label IS NOT NULL),
cc AS (SELECT task_id, label, count(*) FILTER (g = label AND p = label) AS tp, count(*) FILTER (p = label AND g IS DISTINCT FROM label) AS fp, count(*) FILTER (g = label AND p IS DISTINCT FROM label) AS fn FROM seen GROUP BY ALL),
classes AS (SELECT task_id, label, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM labels FULL JOIN cc USING (task_id, label))"""
Z2 = St.Z * St.Z
READ = "CASE WHEN support < 5 THEN 'not measurable' WHEN support < 10 THEN 'presence check only' WHEN support < 30 THEN 'detecting total failure' WHEN support < 50 THEN 'coarse comparison' WHEN support < 100 THEN 'a number with a caveat' ELSE 'a number' END"


def wilson_sql(hits: str, n: str) -> tuple[str, str]:
    centre, half = f"({hits} / {n} + {Z2} / (2 * {n})) / (1 + {Z2} / {n})", f"{St.Z} * sqrt({hits} / {n} * (1 - {hits} / {n}) / {n} + {Z2} / (4.0 * {n} * {n})) / (1 + {Z2} / {n})"
    return f"CASE WHEN {n} > 0 THEN greatest(0.0, {centre} - {half}) ELSE 0 END", f"CASE WHEN {n} > 0 THEN least(1.0, {centre} + {half}) ELSE 1 END"


# --- normalizers ----------------------------------------------------------------------------------------------------


def _one(name: str, sql_input: str, column: str, normal: Callable, sql: str, key: str = "id") -> None:
    query(f"SELECT {key}, {column} AS raw, {sql} AS value FROM ({sql_input})", name)(lambda spark, d: I.frame(spark, d, sql_input).select(key, F.col(column).alias("raw"), normal(F.col(column)).alias("value")))


_one("norm_boolean", I.CLASSES, "pred_flag", lambda c: N.boolean(c, {}), BOOL("pred_flag"), "doc_id")
_one("norm_enum", I.CLASSES, "pred_lang", lambda c: N.enum(c, TASKS["lang"].params), LANG("pred_lang"), "doc_id")
_one("norm_controlled_code", I.CLASSES, "pred_lang", lambda c: N.controlled_code(c, {"vocabulary": LANGUAGES}), LANG("pred_lang"), "doc_id")
_one("norm_free_string", I.CLASSES, "pred_number", lambda c: N.free_string(c, {}), FREE("pred_number"), "doc_id")
_one("norm_entity_name", I.NAMES, "pred", lambda c: N.entity_name(c, {}), ENTITY("pred"))
PERSON = rf"nullif(trim(regexp_replace(regexp_replace({CLEAN(rf"regexp_replace(regexp_replace(regexp_replace({LOW('name')}, '\bph\.d\.?', 'ph d', 'g'), '[.,;:()\[\]''\x22`/\\]', ' ', 'g'), '\s*-\s*', '-', 'g')")}, '^((mr|mrs|ms|mx|miss|dr|prof|professor|sir|dame|rev|hon)( |$))+', ''), '((^| )(phd|md|jd|esq|mba|cpa|dds|llm|msc|bsc))+$', '')), '')"
_one("norm_person_name", I.PEOPLE, "name", lambda c: N.person_name(c, {}), GIVEN("name", PERSON))
_NUM = r"CAST(regexp_extract(replace(pred, ' ', ''), '([0-9]+)', 1) AS DOUBLE)"
NUMBER = rf"""SELECT id, pred AS raw,
  CASE WHEN {LOW('pred')} IN {WORDS} OR NOT regexp_matches(pred, '[0-9]') THEN NULL WHEN pred LIKE '(%' THEN -{_NUM} WHEN pred LIKE '%thousand' THEN 1000 * {_NUM} ELSE {_NUM} END AS value,
  CASE WHEN {LOW('pred')} IN {WORDS} OR NOT regexp_matches(pred, '[0-9]') THEN NULL WHEN pred LIKE '%EUR' THEN 'EUR' WHEN pred LIKE '(%' THEN 'USD' ELSE 'USD' END AS unit,
  CASE WHEN {LOW('pred')} IN {WORDS} OR regexp_matches(pred, '[0-9]') THEN NULL ELSE lower(pred) END AS text
FROM ({I.AMOUNTS})"""


@query(NUMBER)
def norm_numeric(spark: SparkSession, d: str) -> DataFrame:
    v = N.numeric(F.col("pred"), {"unit": "USD"})
    return I.frame(spark, d, I.AMOUNTS).select("id", F.col("pred").alias("raw"), v["value"].alias("value"), v["unit"].alias("unit"), v["text"].alias("text"))


DATE = lambda c: rf"""CASE WHEN {LOW(c)} IN {WORDS} OR {c} = 'whenever' THEN NULL WHEN {c} LIKE 'march %' THEN concat(substr({c}, 7), '-03') WHEN {c} LIKE '%/%' THEN concat(substr({c}, 7, 4), '-', substr({c}, 1, 2), '-', substr({c}, 4, 2)) ELSE {c} END"""


@query(f"SELECT id, pred AS raw, iso, CASE WHEN iso IS NULL THEN NULL ELSE CAST(len(string_split(iso, '-')) AS INT) END AS parts, CASE WHEN pred = 'whenever' THEN pred END AS text FROM (SELECT *, {DATE('pred')} AS iso FROM ({I.DATES}))")
def norm_date(spark: SparkSession, d: str) -> DataFrame:
    v = N.date(F.col("pred"), {})
    return I.frame(spark, d, I.DATES).select("id", F.col("pred").alias("raw"), v["iso"].alias("iso"), v["parts"].alias("parts"), v["text"].alias("text"))


def _span(a: str, b: str):
    return F.struct(F.col(a).alias("start"), F.col(b).alias("stop"), F.lit(None).cast("string").alias("text"))


@query(f"SELECT id, CASE WHEN pred_stop > pred_start AND pred_start >= 0 THEN pred_start END AS start, CASE WHEN pred_stop > pred_start AND pred_start >= 0 THEN pred_stop END AS stop FROM ({I.SPANS})")
def norm_span(spark: SparkSession, d: str) -> DataFrame:
    v = N.span(_span("pred_start", "pred_stop"), {})
    return I.frame(spark, d, I.SPANS).select("id", v["start"].alias("start"), v["stop"].alias("stop"))


# --- matchers -------------------------------------------------------------------------------------------------------

COUNTS = ("tp", "fp", "fn", "tn", "correct")


def _match(name: str, sql_input: str, g: str, p: str, match: Callable, gold_sql: str, pred_sql: str, key: str = "id") -> None:
    sql = f"SELECT {key}, {SCALAR} FROM (SELECT {key}, {gold_sql} AS g, {pred_sql} AS p FROM ({sql_input}))"

    def run(spark: SparkSession, d: str) -> DataFrame:
        return I.frame(spark, d, sql_input).select(key, match(F.col(g), F.col(p)).alias("o")).select(key, *(f"o.{c}" for c in COUNTS))

    query(sql, name)(run)


_match("match_identity", I.CLASSES, "gold_lang", "pred_lang", lambda g, p: TASKS["lang"].match(g, p), LANG("gold_lang"), LANG("pred_lang"), "doc_id")
_match("match_boolean", I.CLASSES, "gold_flag", "pred_flag", lambda g, p: TASKS["flag"].match(g, p), BOOL("gold_flag"), BOOL("pred_flag"), "doc_id")
_match("match_exact", I.CLASSES, "gold_number", "pred_number", lambda g, p: M.exact(g, p, {}), FREE("gold_number"), FREE("pred_number"), "doc_id")
LCS = r"""
WITH RECURSIVE s AS ({pairs}),
q AS (SELECT id, g, p, array_to_string(list_sort(string_split(g, ' ')), ' ') AS a, array_to_string(list_sort(string_split(p, ' ')), ' ') AS b FROM s),
r AS (SELECT id, 0 AS i, list_transform(range(length(b) + 1), lambda k: 0) AS row_ FROM q WHERE g IS NOT NULL AND p IS NOT NULL
      UNION ALL
      SELECT r.id, i + 1, list_transform(range(1, length(b) + 2), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(row_[k], CASE WHEN k > 1 AND b[k - 1] = a[i + 1] THEN row_[k - 1] + 1 ELSE 0 END))))
      FROM r JOIN q ON q.id = r.id WHERE i < length(a)),
e AS (SELECT r.id, list_max(row_) AS lcs FROM r JOIN q ON q.id = r.id WHERE i = length(a)),
f AS (SELECT q.id, g, p, CASE WHEN g IS NULL OR p IS NULL THEN NULL WHEN a = b THEN 1.0 ELSE 2.0 * lcs / (length(a) + length(b)) END AS measure FROM q LEFT JOIN e ON e.id = q.id),
t AS (SELECT *, coalesce(measure >= {theta}, false) AS hit FROM f)
SELECT id, CAST(hit AS BIGINT) AS tp, CAST(p IS NOT NULL AND NOT hit AS BIGINT) AS fp, CAST(g IS NOT NULL AND NOT hit AS BIGINT) AS fn, CAST(g IS NULL AND p IS NULL AS BIGINT) AS tn,
       hit OR (g IS NULL AND p IS NULL) AS correct, round(measure, 6) AS measure, coalesce(g = p, false) AS strict_correct FROM t
"""


def _fuzzy(name: str, theta: float, normal: str, sql: Callable) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        o = M.matcher("entity_name")(F.col("gold"), F.col("pred"), {"theta": theta, "normalizer": normal})
        return I.frame(spark, d, I.NAMES).select("id", o.alias("o")).select("id", *(f"o.{c}" for c in COUNTS), F.round("o.measure", 6).alias("measure"), F.coalesce("o.strict.correct", F.lit(False)).alias("strict_correct"))

    query(LCS.replace("{theta}", str(theta)).replace("{pairs}", f"SELECT id, {sql('gold')} AS g, {sql('pred')} AS p FROM ({I.NAMES})"), name)(run)


_fuzzy("match_fuzzy", 0.9, "entity_name", ENTITY)
_fuzzy("match_free_text", 0.85, "free_string", FREE)

SETS = f"""
WITH e AS ({I.EVENTS}),
s AS (SELECT user_id, list(DISTINCT event_type) FILTER (b < 70) AS g, list(DISTINCT event_type) FILTER (b < 55 OR b >= 85) AS p FROM e GROUP BY user_id),
z AS (SELECT user_id, coalesce(g, []) AS g, coalesce(p, []) AS p FROM s)
SELECT user_id, len(list_intersect(g, p)) AS tp, len(p) - len(list_intersect(g, p)) AS fp, len(g) - len(list_intersect(g, p)) AS fn, CAST(len(g) + len(p) = 0 AS BIGINT) AS tn, len(list_intersect(g, p)) = len(g) AND len(g) = len(p) AS correct FROM z
"""


@query(SETS)
def match_set(spark: SparkSession, d: str) -> DataFrame:
    e = I.frame(spark, d, I.EVENTS)
    s = e.groupBy("user_id").agg(F.collect_set(F.when(F.col("b") < 70, F.col("event_type"))).alias("g"), F.collect_set(F.when((F.col("b") < 55) | (F.col("b") >= 85), F.col("event_type"))).alias("p"))
    return s.select("user_id", M.set_match(F.col("g"), F.col("p"), {"normalizer": "free_string"}).alias("o")).select("user_id", *(f"o.{c}" for c in COUNTS))


LISTS = f"""
WITH i AS ({I.ITEMS}),
o AS (SELECT DISTINCT l_orderkey FROM i),
g AS (SELECT l_orderkey, lower(p_name) AS x, count(*) AS n FROM i WHERE b < 80 GROUP BY ALL),
p AS (SELECT l_orderkey, lower(p_name) AS x, count(*) + count(*) FILTER (b >= 90) AS n FROM i WHERE b >= 10 GROUP BY ALL),
c AS (SELECT coalesce(g.l_orderkey, p.l_orderkey) AS l_orderkey, sum(least(coalesce(g.n, 0), coalesce(p.n, 0))) AS tp, sum(coalesce(g.n, 0)) AS m, sum(coalesce(p.n, 0)) AS k FROM g FULL JOIN p ON g.l_orderkey = p.l_orderkey AND g.x = p.x GROUP BY 1),
z AS (SELECT l_orderkey, CAST(coalesce(tp, 0) AS BIGINT) AS tp, CAST(coalesce(m, 0) AS BIGINT) AS m, CAST(coalesce(k, 0) AS BIGINT) AS k FROM o LEFT JOIN c USING (l_orderkey))
SELECT l_orderkey, tp, k - tp AS fp, m - tp AS fn, CAST(m + k = 0 AS BIGINT) AS tn, tp = m AND tp = k AS correct FROM z
"""


@query(LISTS)
def match_list(spark: SparkSession, d: str) -> DataFrame:
    i = I.frame(spark, d, I.ITEMS)
    twice = F.when(F.col("b") >= 90, F.array("p_name", "p_name")).when(F.col("b") >= 10, F.array("p_name"))
    s = i.groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("b") < 80, F.col("p_name"))).alias("g"), F.flatten(F.collect_list(twice)).alias("p"))
    return s.select("l_orderkey", M.list_match(F.col("g"), F.col("p"), {}).alias("o")).select("l_orderkey", *(f"o.{c}" for c in COUNTS))


MONEY = f"""
WITH n AS ({NUMBER}), j AS (SELECT n.*, k FROM n JOIN ({I.AMOUNTS}) a USING (id)),
s AS (SELECT id, value IS NULL AND text IS NULL AS none, coalesce(unit = 'USD' AND abs(k - value) <= 0.01 * abs(k), false) AS hit, CASE WHEN unit = 'USD' THEN round(abs(k - value) / (0.01 * abs(k)), 6) END AS measure FROM j)
SELECT id, CAST(hit AS BIGINT) AS tp, CAST(NOT none AND NOT hit AS BIGINT) AS fp, CAST(NOT hit AS BIGINT) AS fn, 0 AS tn, hit AS correct, measure FROM s
"""


@query(MONEY)
def match_numeric(spark: SparkSession, d: str) -> DataFrame:
    o = M.numeric(F.col("gold"), F.col("pred"), {"tolerance": 0.01, "unit": "USD"})
    return I.frame(spark, d, I.AMOUNTS).select("id", o.alias("o")).select("id", *(f"o.{c}" for c in COUNTS), F.round("o.measure", 6).alias("measure"))


WHEN = f"""
WITH n AS (SELECT id, gold, pred, {DATE('pred')} AS iso FROM ({I.DATES})),
s AS (SELECT id, iso IS NULL AND pred <> 'whenever' AS none, coalesce(iso = gold, false) AS hit FROM n)
SELECT id, CAST(hit AS BIGINT) AS tp, CAST(NOT none AND NOT hit AS BIGINT) AS fp, CAST(NOT hit AS BIGINT) AS fn, 0 AS tn, hit AS correct FROM s
"""


@query(WHEN)
def match_date(spark: SparkSession, d: str) -> DataFrame:
    o = M.date(F.col("gold"), F.col("pred"), {})
    return I.frame(spark, d, I.DATES).select("id", o.alias("o")).select("id", *(f"o.{c}" for c in COUNTS))


PLACES = f"""
WITH s AS (SELECT id, gold_start AS a, gold_stop AS b, CASE WHEN pred_stop > pred_start THEN pred_start END AS c, CASE WHEN pred_stop > pred_start THEN pred_stop END AS d FROM ({I.SPANS})),
o AS (SELECT *, greatest(0, least(b, d) - greatest(a, c)) AS x FROM s)
SELECT id, CASE WHEN c IS NULL THEN 0 ELSE x END AS tp, CASE WHEN c IS NULL THEN 0 ELSE d - c - x END AS fp, CASE WHEN c IS NULL THEN 1 ELSE b - a - x END AS fn, 0 AS tn, CASE WHEN c IS NULL THEN false ELSE x / (b - a + d - c - x) >= 0.5 END AS correct FROM o
"""


@query(PLACES)
def match_span(spark: SparkSession, d: str) -> DataFrame:
    o = M.span(_span("gold_start", "gold_stop"), _span("pred_start", "pred_stop"), {})
    return I.frame(spark, d, I.SPANS).select("id", o.alias("o")).select("id", *(f"o.{c}" for c in COUNTS))


# --- facts and metrics ----------------------------------------------------------------------------------------------


def pairs(spark: SparkSession, d: str) -> DataFrame:
    c = I.frame(spark, d, I.CLASSES)
    side = lambda s: F.struct(F.col(f"{s}_flag").alias("flag"), F.col(f"{s}_lang").alias("lang"), F.col(f"{s}_number").alias("number")).alias(s)
    return c.select("doc_id", "ok", side("gold"), side("pred"))


def facts(spark: SparkSession, d: str, **kw) -> DataFrame:
    return Fa.match_results(pairs(spark, d), TASKS, **kw)


@query(f"WITH {FACTS} SELECT doc_id, task_id, tp, fp, fn, tn, correct, g AS gold, p AS pred FROM facts")
def match_results(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d).select("doc_id", "task_id", *COUNTS, "gold", "pred")


@query(f"WITH {FACTS} SELECT doc_id, sum(CASE WHEN correct THEN weight ELSE 0 END)::DOUBLE / sum(weight)::DOUBLE AS aggregate, bool_and(correct) AS all_correct FROM facts GROUP BY doc_id")
def example_scores(spark: SparkSession, d: str) -> DataFrame:
    return Fa.example_scores(facts(spark, d)).drop("excluded")


@query(f"WITH {FACTS} SELECT doc_id, coalesce(sum(CASE WHEN correct THEN weight ELSE 0 END) FILTER (NOT (task_id = 'lang' AND coalesce(g IN ('es', 'de'), false)))::DOUBLE / sum(weight) FILTER (NOT (task_id = 'lang' AND coalesce(g IN ('es', 'de'), false)))::DOUBLE, 1.0) AS aggregate FROM facts GROUP BY doc_id")
def excluded_scores(spark: SparkSession, d: str) -> DataFrame:
    return Fa.example_scores(facts(spark, d, excluded={"lang": ["es", "de"]})).select("doc_id", "aggregate")


TALLY = f"{FACTS}, c AS (SELECT task_id, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tn)::BIGINT AS tn FROM facts GROUP BY task_id)"


@query(f"WITH {TALLY} SELECT *, {PRF} FROM c")
def task_counts(spark: SparkSession, d: str) -> DataFrame:
    return Me.task_counts(facts(spark, d))


@query(f"WITH {FACTS}, c AS (SELECT task_id, sum(tp)::BIGINT AS tp, sum(CASE WHEN fn > 0 AND tp = 0 AND fp = 0 THEN fn ELSE fp END)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tn)::BIGINT AS tn FROM facts GROUP BY task_id) SELECT *, {PRF} FROM c")
def best_guess_metrics(spark: SparkSession, d: str) -> DataFrame:
    return Me.task_counts(facts(spark, d, policy="best_guess"))


@query(f"WITH {FACTS}, w AS (SELECT *, 1.0 / (0.5 + (CAST(doc_id AS BIGINT) % 2) * 0.25) AS w FROM facts), c AS (SELECT task_id, sum(w * tp)::DOUBLE AS tp, sum(w * fp)::DOUBLE AS fp, sum(w * fn)::DOUBLE AS fn, sum(w * tn)::DOUBLE AS tn FROM w GROUP BY task_id) SELECT task_id, round(tp, 4) AS tp, round(fp, 4) AS fp, round(fn, 4) AS fn, round(tn, 4) AS tn, round(2 * tp / (2 * tp + fp + fn), 8) AS f1 FROM c")
def weighted_metrics(spark: SparkSession, d: str) -> DataFrame:
    w = 1 / (0.5 + (F.col("doc_id") % 2) * 0.25)
    return Me.weighted_counts(facts(spark, d, ipw=w)).select("task_id", *(F.round(c, 4).alias(c) for c in ("tp", "fp", "fn", "tn")), F.round("f1", 8).alias("f1"))


LOW_R, HIGH_R = wilson_sql("tp", "support")


@query(f"WITH {FACTS}, {CLASSCOUNTS}, s AS (SELECT *, tp + fn AS support, {PRF} FROM classes) SELECT task_id, label, tp, fp, fn, support, precision, recall, f1, round({LOW_R}, 9) AS recall_low, round({HIGH_R}, 9) AS recall_high, support >= 10 AS measurable, support >= 30 AS above_floor, {READ} AS readable_as FROM s")
def class_metrics(spark: SparkSession, d: str) -> DataFrame:
    return Me.class_metrics(facts(spark, d), TASKS).withColumns({c: F.round(c, 9) for c in ("recall_low", "recall_high")})


_ENDS = [*wilson_sql("tp", "(tp + fp)"), *wilson_sql("tp", "(tp + fn)")]


@query(f"""WITH {FACTS}, {CLASSCOUNTS}, r AS (SELECT task_id, 'true' AS counts, tp, fp, fn FROM classes WHERE task_id = 'flag' AND label = 'true'
UNION ALL SELECT task_id, 'all answers', sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT FROM facts WHERE task_id <> 'flag' GROUP BY task_id)
SELECT task_id, counts, tp + fn AS support, {PRF}, round({_ENDS[0]}, 9) AS precision_low, round({_ENDS[1]}, 9) AS precision_high, round({_ENDS[2]}, 9) AS recall_low, round({_ENDS[3]}, 9) AS recall_high FROM r""")
def answer_rates(spark: SparkSession, d: str) -> DataFrame:
    return Me.answer_rates(facts(spark, d), TASKS).withColumns({c: F.round(c, 9) for c in ("precision_low", "precision_high", "recall_low", "recall_high")})


@query(f"""WITH {TALLY}, {CLASSCOUNTS}, s AS (SELECT *, tp + fn AS support, {PRF} FROM classes),
b AS (SELECT task_id, avg(f1) FILTER (support >= 30) AS above, avg(f1) FILTER (tp + fp + fn > 0) AS seen, max(f1) FILTER (label = 'true') AS pos, min(support) AS rarest FROM s GROUP BY task_id),
r AS (SELECT task_id, avg(correct::INT) AS exact_match, avg((g IS NULL)::INT) AS gold_null_rate, avg((p IS NULL)::INT) AS pred_null_rate FROM facts GROUP BY task_id)
SELECT c.task_id, round(CASE c.task_id WHEN 'flag' THEN pos WHEN 'lang' THEN coalesce(above, seen, 0) ELSE CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END END, 9) AS primary_value,
       coalesce(rarest, tp + fn) >= 10 AS measurable, exact_match, gold_null_rate, pred_null_rate FROM c JOIN r USING (task_id) LEFT JOIN b USING (task_id)""")
def task_metrics(spark: SparkSession, d: str) -> DataFrame:
    return Me.primary_values(facts(spark, d), TASKS).select("task_id", F.round("primary", 9).alias("primary_value"), "measurable", "exact_match", "gold_null_rate", "pred_null_rate")


@query(f"WITH {FACTS} SELECT task_id, coalesce(g, '(null)') AS gold, coalesce(p, '(null)') AS pred, count(*) AS n FROM facts WHERE task_id <> 'number' GROUP BY ALL")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    return Me.confusion(facts(spark, d))


LOW_W, HIGH_W = wilson_sql("n", "total")


@query(f"SELECT source, n, total, round({LOW_W}, 9) AS low, round({HIGH_W}, 9) AS high, round((({HIGH_W}) - ({LOW_W})) / 2, 9) AS half_width FROM (SELECT source, count(*) FILTER (n_chars > 500) AS n, count(*) AS total FROM documents GROUP BY source)")
def wilson_ci(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").groupBy("source").agg(F.count_if(F.col("n_chars") > 500).alias("n"), F.count(F.lit(1)).alias("total"))
    low, high = St.wilson(F.col("n"), F.col("total"))
    return c.select("source", "n", "total", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"), F.round(St.wilson_half_width(F.col("n"), F.col("total")), 9).alias("half_width"))


@query("""WITH v AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, quality FROM labels), n AS (SELECT count(*) AS n FROM v),
g AS (SELECT r, CAST(concat('0x', substr(md5(concat('7:', r, ':', k)), 1, 8)) AS BIGINT) % n AS i FROM (SELECT unnest(range(2000)) AS r), n, LATERAL (SELECT unnest(range(n)) AS k)),
m AS (SELECT r, avg(quality) AS m FROM g JOIN v USING (i) GROUP BY r)
SELECT round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high, any_value(n) AS n FROM m, n""")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    out = St.bootstrap_interval(table(spark, d, "labels"), "quality", "doc_id", 2000, 7)
    return out.select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"), "n")


# --- sampling -------------------------------------------------------------------------------------------------------

RANK = lambda key, seed, why: f"md5(concat(CAST({key} AS STRING), ':{seed}:{why}'))"


@query(f"""WITH s AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY {RANK('doc_id', 11, 'sample')}, doc_id) AS r FROM (SELECT DISTINCT doc_id FROM documents)) WHERE r <= 120)
SELECT doc_id, row_number() OVER (ORDER BY {RANK('doc_id', 11, 'holdout')}, doc_id) <= greatest(1, round_even(count(*) OVER () * 0.25, 0)) AS is_holdout FROM s""")
def draw_sample(spark: SparkSession, d: str) -> DataFrame:
    return Sa.draw_sample(table(spark, d, "documents"), 120, 0.25, 11)


LABELS = Registry.of({"tasks": [{"id": "quality", "type": "binary", "question": "Good?"}, {"id": "toxic", "type": "binary", "question": "Toxic?"}, {"id": "lang", "type": "multiclass", "question": "Language?", "output": {"enum": ["en", "de", "fr", "es", "it"]}}]})
LONG = """docs AS (SELECT DISTINCT CAST(doc_id AS STRING) AS doc_id FROM labels),
long AS (SELECT CAST(doc_id AS STRING) AS doc_id, 'quality' AS task_id, CASE WHEN quality = 1 THEN 'true' ELSE 'false' END AS label FROM labels UNION ALL SELECT CAST(doc_id AS STRING), 'toxic', CASE WHEN toxic = 1 THEN 'true' ELSE 'false' END FROM labels
UNION ALL SELECT CAST(doc_id AS STRING), 'lang', lang FROM labels JOIN documents USING (doc_id))"""


def long_labels(spark: SparkSession, d: str) -> DataFrame:
    yes = lambda c: F.when(F.col(c) == 1, "true").otherwise("false").alias(c)
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return Fa.long_labels(rows.select("doc_id", F.struct(yes("quality"), yes("toxic"), "lang").alias("v")), LABELS, "v")


SUPPORTS = f"""{LONG}, n AS (SELECT count(DISTINCT doc_id) AS total FROM labels),
dec AS (SELECT 'quality' AS task_id, unnest(['true', 'false']) AS label UNION ALL SELECT 'toxic', unnest(['true', 'false']) UNION ALL SELECT 'lang', unnest(['en', 'de', 'fr', 'es', 'it'])),
sup AS (SELECT task_id, label, coalesce(c, 0) AS count FROM dec LEFT JOIN (SELECT task_id, label, count(*) AS c FROM long GROUP BY ALL) USING (task_id, label))"""


@query(f"WITH {SUPPORTS} SELECT task_id, label, count, total, count / total AS prevalence, {READ.replace('support', 'count')} AS readable_as, CASE WHEN count > 0 THEN CAST(ceil(30 * total / count) AS BIGINT) END AS documents_needed FROM sup, n")
def class_supports(spark: SparkSession, d: str) -> DataFrame:
    return Sa.class_supports(long_labels(spark, d), LABELS, table(spark, d, "labels").select("doc_id").distinct().count()).drop("half_width")


@query(f"WITH {SUPPORTS} SELECT task_id, label, count FROM sup WHERE count < 60")
def below_floor(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "labels").select("doc_id").distinct().count()
    return Sa.below_floor(Sa.class_supports(long_labels(spark, d), LABELS, n), 60).select("task_id", "label", "count")


STRATA = f"{LONG}, rare AS (SELECT task_id, label, count(*) AS n FROM long GROUP BY ALL), strata AS (SELECT doc_id, concat(m.task_id, '=', m.label) AS stratum FROM (SELECT doc_id, min({{'n': n, 'task_id': task_id, 'label': label}}) AS m FROM long JOIN rare USING (task_id, label) GROUP BY doc_id))"


@query(f"WITH {STRATA} SELECT doc_id, stratum FROM strata")
def stratification_key(spark: SparkSession, d: str) -> DataFrame:
    return Sa.stratification_key(table(spark, d, "labels").select("doc_id"), long_labels(spark, d))


@query(f"""WITH {STRATA}, k AS (SELECT doc_id, stratum, count(*) OVER (PARTITION BY stratum) AS n, row_number() OVER (PARTITION BY stratum ORDER BY {RANK('doc_id', 20260918, 'split')}, doc_id) AS pos FROM strata),
a AS (SELECT *, floor(n * 0.5) AS t, floor(n * 0.25) AS v, n - floor(n * 0.5) - 2 * floor(n * 0.25) AS rest, n * 0.5 - floor(n * 0.5) AS ft, n * 0.25 - floor(n * 0.25) AS fv FROM k),
b AS (SELECT *, CASE WHEN n < 3 THEN 1 ELSE t + CASE WHEN rest >= 1 AND ft >= fv OR rest >= 3 THEN 1 ELSE 0 END END AS nt,
             CASE WHEN n = 1 THEN 0 WHEN n = 2 THEN 1 ELSE v + CASE WHEN fv > ft AND rest >= 1 OR fv <= ft AND rest >= 2 THEN 1 ELSE 0 END END AS nv FROM a)
SELECT doc_id, stratum, CASE WHEN pos <= nt THEN 'train' WHEN pos <= nt + nv THEN 'val' ELSE 'holdout' END AS split FROM b""")
def make_splits(spark: SparkSession, d: str) -> DataFrame:
    return Sa.assign_splits(stratification_key(spark, d), (0.5, 0.25, 0.25))


@query(f"WITH docs AS (SELECT DISTINCT CAST(doc_id AS STRING) AS doc_id FROM labels) SELECT doc_id, (row_number() OVER (ORDER BY {RANK('doc_id', 20260918, 'fold')}, doc_id) - 1) % 5 AS fold FROM docs")
def cv_folds(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("doc_id")).distinct().withColumn("split", F.lit("train"))
    return Sa.with_folds(docs).select("doc_id", "fold")


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)licen[cs]ed? under')")
def keyword_stratum(spark: SparkSession, d: str) -> DataFrame:
    return Sa.keyword_stratum(table(spark, d, "documents"), "licen[cs]ed? under")


@query(f"WITH {LONG} SELECT DISTINCT doc_id FROM long WHERE task_id = 'toxic' AND label = 'true'")
def model_nominated(spark: SparkSession, d: str) -> DataFrame:
    return Sa.model_stratum(long_labels(spark, d), "toxic", "true")


@query(f"""WITH f AS (SELECT DISTINCT doc_id FROM documents WHERE lang = 'de' AND doc_id NOT IN (SELECT doc_id FROM labels)), k AS (SELECT doc_id, row_number() OVER (ORDER BY {RANK('doc_id', 3, 'enrich')}, doc_id) AS r, count(*) OVER () AS n FROM f)
SELECT doc_id, least(40, n) / n AS inclusion_probability FROM k WHERE r <= 40""")
def enrichment_plan(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return Sa.plan_enrichment(docs.where("lang = 'de'"), table(spark, d, "labels"), 40, 3)


@query(f"WITH {FACTS}, k AS (SELECT doc_id, task_id, row_number() OVER (PARTITION BY task_id ORDER BY md5(concat(task_id, ':', doc_id, ':0:errors')), doc_id) AS r FROM facts WHERE NOT correct) SELECT task_id, doc_id FROM k WHERE r <= 3")
def sampled_errors(spark: SparkSession, d: str) -> DataFrame:
    return Sa.sample_errors(facts(spark, d)).select("task_id", "doc_id")


# --- gates ----------------------------------------------------------------------------------------------------------


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).select(F.col("doc_id").cast("string").alias("doc_id"), "ok", F.col("pred").alias("values"), "gold")


@query(f"SELECT unnest(['coverage', 'schema']) AS name, unnest([true, avg((NOT ok)::INT) <= 0.005]) AS passed FROM ({I.CLASSES})")
def qa_coverage_schema(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents").count()
    return G.run_gates(outcomes(spark, d), TASKS, n).where("name <> 'manual spot-check'").select("name", "passed")


@query(f"""WITH c AS (SELECT * FROM ({I.CLASSES})), p AS (SELECT 'flag' AS task_id, pred_flag AS label, ok FROM c UNION ALL SELECT 'lang', pred_lang, ok FROM c), g AS (SELECT 'flag' AS task_id, gold_flag AS label FROM c UNION ALL SELECT 'lang', gold_lang FROM c),
a AS (SELECT task_id, label, count(*) / (SELECT count(*) FROM c WHERE ok) AS s FROM p WHERE ok GROUP BY ALL), b AS (SELECT task_id, label, count(*) / (SELECT count(*) FROM c) AS s FROM g GROUP BY ALL)
SELECT coalesce(a.task_id, b.task_id) AS task_id, coalesce(a.label, b.label) AS label, round(coalesce(a.s, 0) - coalesce(b.s, 0), 9) AS delta FROM a FULL JOIN b ON a.task_id = b.task_id AND a.label = b.label WHERE abs(coalesce(a.s, 0) - coalesce(b.s, 0)) > 0.15""")
def qa_class_shift(spark: SparkSession, d: str) -> DataFrame:
    o = outcomes(spark, d)
    moved = G.class_shifts(G.class_shares(o.where("ok"), TASKS, "values"), G.class_shares(o, TASKS, "gold"))
    return moved.withColumn("delta", F.round("delta", 9))


@query(f"WITH c AS (SELECT * FROM ({I.CLASSES}) WHERE ok) SELECT 'flag' AS task_id, avg(({LOW('pred_flag')} IN {WORDS})::INT) AS rate FROM c UNION ALL SELECT 'lang', avg(({LOW('pred_lang')} IN {WORDS})::INT) FROM c UNION ALL SELECT 'number', avg(({LOW('pred_number')} IN {WORDS})::INT) FROM c")
def qa_null_rates(spark: SparkSession, d: str) -> DataFrame:
    return G.null_rates(outcomes(spark, d).where("ok"), TASKS, "values")


@query(f"""WITH c AS (SELECT CAST(doc_id AS STRING) AS doc_id, ok FROM ({I.CLASSES})), k AS (SELECT doc_id, row_number() OVER (ORDER BY {RANK('doc_id', 0, 'slice')}, doc_id) AS r FROM c WHERE ok),
p AS (SELECT CAST(doc_id AS STRING) AS doc_id FROM documents WHERE n_chars > 12000)
SELECT 'failed' AS route, doc_id FROM c WHERE NOT ok UNION SELECT 'random_slice', doc_id FROM k WHERE r <= 50 UNION SELECT 'truncated', doc_id FROM p""")
def triage_routes(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "documents").select("doc_id", F.lit(0).alias("transcribed_pages"), F.lit(0).alias("unread_pages"), (F.col("n_chars") > 12000).alias("truncated"))
    return G.triage(outcomes(spark, d), TASKS, m)


MONEYTASK = Registry.of({"tasks": [{"id": "amount", "type": "extract_numeric", "question": "How much?", "match": {"tolerance": 0.01, "unit": "USD"}}]})


@query(f"""WITH n AS ({NUMBER}), j AS (SELECT n.*, k, abs(k - value) / (0.01 * k) AS m FROM n JOIN ({I.AMOUNTS}) a USING (id)),
r AS (SELECT id, CASE WHEN value IS NOT NULL AND unit <> 'USD' THEN 'units differ' WHEN value IS NOT NULL AND m BETWEEN 0.5 AND 2.0 THEN 'delta is near the tolerance' WHEN value IS NULL OR unit <> 'USD' OR m > 1 THEN 'error' END AS reason FROM j)
SELECT CAST(id AS STRING) AS doc_id, reason FROM r WHERE reason IS NOT NULL""")
def adjudicate(spark: SparkSession, d: str) -> DataFrame:
    p = I.frame(spark, d, I.AMOUNTS).select("id", F.struct(F.col("gold").alias("amount")).alias("gold"), F.struct(F.col("pred").alias("amount")).alias("pred"))
    return G.adjudicate(Fa.match_results(p, MONEYTASK, doc_id="id")).select("doc_id", "reason")


@query("""WITH v AS (SELECT source, avg((n_chars > 500)::INT) AS v, count(*) FILTER (n_chars > 500) AS n, count(*) AS total FROM documents WHERE doc_id % 2 = 0 GROUP BY source), h AS (SELECT source, avg((n_chars > 500)::INT) AS v, count(*) FILTER (n_chars > 500) AS n, count(*) AS total FROM documents WHERE doc_id % 2 = 1 GROUP BY source),
j AS (SELECT h.source AS task_id, coalesce(v.v, 0) AS validation, h.v AS holdout, """ + f"{wilson_sql('h.n', 'h.total')[0]} AS low, {wilson_sql('h.n', 'h.total')[1]} AS high" + """ FROM h LEFT JOIN v USING (source))
SELECT task_id, validation, holdout, validation BETWEEN low AND high AS within_ci, NOT (validation BETWEEN low AND high) AND validation - holdout > 0.10 AS is_large FROM j""")
def holdout_gaps(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    part = lambda k: docs.where(F.col("doc_id") % 2 == k).groupBy(F.col("source").alias("task_id")).agg(F.avg((F.col("n_chars") > 500).cast("int")).alias("value"), F.count_if(F.col("n_chars") > 500).alias("n"), F.count(F.lit(1)).alias("total"))
    low, high = St.wilson(F.col("n"), F.col("total"))
    return G.holdout_gaps(part(0), part(1).withColumns({"low": low, "high": high})).drop("gap")


@query("""WITH p AS (SELECT * FROM (VALUES ('click', 3.0, 15.0), ('view', 1.0, 5.0), ('purchase', 0.25, 1.25)) t(model, i, o))
SELECT event_type AS model, sum(event_id % 1000) AS input_tokens, sum(event_id % 77) AS output_tokens, round(sum(((event_id % 1000) * i + (event_id % 77) * o) / 1e6 * CASE WHEN user_id % 2 = 0 THEN 0.5 ELSE 1 END)::DOUBLE, 8) AS usd, bool_and(i IS NOT NULL) AS priced
FROM events LEFT JOIN p ON model = event_type GROUP BY event_type""")
def spend_totals(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_type").alias("model"), F.when(F.col("user_id") % 2 == 0, "batch").otherwise("live").alias("route"), (F.col("event_id") % 1000).alias("input_tokens"), (F.col("event_id") % 77).alias("output_tokens"))
    prices = spark.createDataFrame([("click", 3.0, 15.0), ("view", 1.0, 5.0), ("purchase", 0.25, 1.25)], "model string, input_per_million double, output_per_million double")
    return G.spend_totals(e, prices).withColumn("usd", F.round("usd", 8))


@query("SELECT source AS task_id, max(value) AS best FROM (SELECT source, lang, avg((n_chars % 40 = 0)::INT) AS value FROM documents GROUP BY ALL) GROUP BY source HAVING max(value) <= 0.05")
def upstream_problems(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "documents").groupBy(F.col("source").alias("task_id"), F.col("lang").alias("run")).agg(F.avg((F.col("n_chars") % 40 == 0).cast("int")).alias("value"))
    return G.upstream_problems(runs)


@query("SELECT doc_id FROM documents WHERE [[b|doc_id|done]] >= 50")
def pending_documents(spark: SparkSession, d: str) -> DataFrame:
    from verdigris.streaming.resume import pending

    done = spark.sql(I.spelled("SELECT doc_id, [[b|doc_id|done]] < 50 AS ok FROM {documents}", "spark"), documents=table(spark, d, "documents"))
    return pending(table(spark, d, "documents").select("doc_id"), done)


# --- text and replies -----------------------------------------------------------------------------------------------


@query("SELECT doc_id, item_id, CAST(strpos(documents.text, benchmark.text) - 1 AS INT) AS start, CAST(strpos(documents.text, benchmark.text) - 1 + length(benchmark.text) AS INT) AS stop FROM documents JOIN benchmark ON strpos(documents.text, benchmark.text) > 0")
def locate_quote(spark: SparkSession, d: str) -> DataFrame:
    quotes = table(spark, d, "benchmark").select("item_id", F.col("text").alias("quote"))
    docs = Sp.containing(table(spark, d, "documents").select("doc_id", "text"), quotes)
    at = Sp.locate(F.col("text"), F.col("quote"), folded=False)
    return docs.select("doc_id", "item_id", at.alias("at")).select("doc_id", "item_id", "at.start", "at.stop")


@query(f"SELECT doc_id, CASE WHEN length(text) <= 600 THEN text ELSE concat(substr(text, 1, 420), '{T.TRUNCATED}', right(text, 180)) END AS text FROM documents".replace("\n", "' || chr(10) || '"))
def truncate_head_tail(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.truncate(F.col("text"), 600, 0.7).alias("text"))


@query("""SELECT doc_id, CASE WHEN strpos(lower(text), 'license') > 0 THEN replace(substr(text, greatest(strpos(lower(text), 'license') - 50, 1), strpos(lower(text), 'license') + 57 - greatest(strpos(lower(text), 'license') - 50, 1)), chr(10), ' ') END AS w FROM documents""".replace("'license'", "'License'".lower()), "context_window")
def _context_window(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.context_window(F.col("text"), F.lit("license"), 50).alias("w"))


FORM = "concat('[[ ## reasoning ## ]] ', text, CASE WHEN turn % 3 > 0 THEN ' [[ ## answer ## ]] yes' ELSE '' END, CASE WHEN turn % 2 = 0 THEN ' [[ ## lang ## ]] en' ELSE '' END)"


@query("SELECT conv_id, turn, CASE WHEN turn % 3 > 0 THEN CASE WHEN turn % 2 = 0 THEN 'reasoning,answer,lang' ELSE 'reasoning,answer' END ELSE CASE WHEN turn % 2 = 0 THEN 'reasoning,lang' ELSE 'reasoning' END END AS fields, CASE WHEN turn % 3 > 0 AND turn % 2 = 0 THEN '' WHEN turn % 3 > 0 THEN 'lang' WHEN turn % 2 = 0 THEN 'answer' ELSE 'answer,lang' END AS missing FROM conversations")
def reply_fields(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn", R.chat_fields(F.expr(FORM)).alias("f"))
    return c.select("conv_id", "turn", F.array_join("f", ",").alias("fields"), F.array_join(R.missing_fields(F.col("f"), ["answer", "lang"]), ",").alias("missing"))


@query("SELECT page_id, length(trim(regexp_replace(html, '<[^>]*>', ' ', 'g'))) < 1200 AS thin FROM pages")
def thin_pages(spark: SparkSession, d: str) -> DataFrame:
    from verdigris.sources.extract import thin_pages as thin

    text = F.array(F.regexp_replace("html", "<[^>]*>", " "))
    return table(spark, d, "pages").select("page_id", (F.size(thin(text, F.array(F.lit(1.0)), 1200)) > 0).alias("thin"))


@query("SELECT page_id, trim(regexp_replace(trim(concat(' ', name)), '(?i)\\.pdf$', '')) AS doc_id, regexp_matches(name, '(?i)\\.pdf$') AND name NOT LIKE '.%' AS is_pdf FROM (SELECT page_id, concat(CASE WHEN page_id % 5 = 0 THEN '.' ELSE '' END, 'file ', page_id, CASE page_id % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.pdf ' ELSE '.txt' END) AS name FROM pages)")
def doc_ids(spark: SparkSession, d: str) -> DataFrame:
    name = F.expr("concat(CASE WHEN page_id % 5 = 0 THEN '.' ELSE '' END, 'file ', page_id, CASE page_id % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.pdf ' ELSE '.txt' END)")
    p = table(spark, d, "pages").select("page_id", name.alias("name"))
    return p.select("page_id", T.doc_id_of(F.col("name")).alias("doc_id"), T.is_pdf(F.col("name")).alias("is_pdf"))
