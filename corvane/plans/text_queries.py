"""Queries of answer texts, built-in and by Arrow-batched functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions import text, udf
from corvane.plans.registry import query
from corvane.session import ship, table

#: Answers in seven formats, as SQL that both engines read.
_TEXT = """CASE l_orderkey % 7 WHEN 0 THEN 'Adding up. #### ' || CAST(CAST(l_quantity AS BIGINT) AS STRING) || ' and later #### 1,0' || CAST(CAST(l_quantity AS BIGINT) % 10 AS STRING) || '0.50'
WHEN 1 THEN 'So the Answer is: $' || CAST(l_extendedprice AS STRING) || '.' WHEN 2 THEN 'We get ' || chr(92) || 'boxed{' || CAST(CAST(l_quantity AS BIGINT) AS STRING) || '} at last'
WHEN 3 THEN 'From 3 to -' || CAST(CAST(l_quantity AS BIGINT) AS STRING) || ',000.5 items' WHEN 4 THEN 'No digits here.' WHEN 5 THEN 'the answer is 7 or ####' || CAST(l_partkey AS STRING) ELSE '####-,. none' END"""
_ROWS = f"a AS (SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice, {_TEXT} AS text FROM lineitem)"
_NUM = "'^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$'"


def _number(s: str, most: str) -> str:
    return f"""CASE WHEN regexp_matches({s}, {_NUM}) AND abs(TRY_CAST({s} AS DOUBLE)) {most} THEN CASE WHEN TRY_CAST({s} AS DOUBLE) = floor(TRY_CAST({s} AS DOUBLE)) THEN CAST(CAST(TRY_CAST({s} AS DOUBLE) AS HUGEINT) AS VARCHAR) ELSE printf('%.6f', TRY_CAST({s} AS DOUBLE)) END ELSE lower({s}) END"""


_CLEAN = "trim(regexp_replace({x}, '[,$%]', '', 'g'))"
_FIRST = "CASE WHEN regexp_matches(text, '{p}') THEN regexp_extract(text, '{p}', 1) END"
_KEYS = "l_orderkey, l_partkey, l_suppkey, l_extendedprice"


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", F.expr(_TEXT).alias("text"))


def _extracted(spark: SparkSession, sf_dir: str, answer) -> DataFrame:
    return _answers(spark, sf_dir).select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", answer.alias("answer"))


@query(
    f"""WITH {_ROWS}, r AS (SELECT *, coalesce({_FIRST.format(p='####' + chr(92) + 's*([-0-9,.]+)')}, list_extract(regexp_extract_all(text, '[-0-9,.]+'), -1)) AS raw FROM a),
f AS (SELECT *, CASE WHEN l_partkey % 5 = 0 THEN 'Filtered 12' WHEN l_partkey % 5 = 1 THEN '[invalid]' END AS filtered FROM r), g AS (SELECT *, CASE WHEN filtered NOT IN ('[invalid]', '') THEN filtered ELSE raw END AS pick FROM f)
SELECT {_KEYS}, CASE WHEN trim(pick) <> '' THEN {_number(_CLEAN.format(x='pick'), '< 1e37')} END AS answer FROM g"""
)
def extract_bon(spark: SparkSession, sf_dir: str) -> DataFrame:
    filtered = F.when(F.col("l_partkey") % 5 == 0, "Filtered 12").when(F.col("l_partkey") % 5 == 1, "[invalid]")
    return _extracted(spark, sf_dir, text.extract_bon(filtered, F.col("text")))


@query(
    f"""WITH {_ROWS}, r AS (SELECT *, coalesce({_FIRST.format(p='####' + chr(92) + 's*([-0-9,.]+)')}, {_FIRST.format(p='(?i)answer' + chr(92) + 's+is:?' + chr(92) + 's*([-0-9,.]+)')},
{_FIRST.format(p=chr(92) * 2 + 'boxed' + chr(92) + '{([-0-9,.]+)' + chr(92) + '}')}, list_extract(regexp_extract_all(text, '-?[0-9][0-9,]*[.]?[0-9]*'), -1)) AS raw FROM a)
SELECT {_KEYS}, CASE WHEN raw IS NOT NULL THEN {_number(_CLEAN.format(x='raw'), '<= 1e15')} END AS answer FROM r"""
)
def extract_generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(spark, sf_dir, text.extract_generator(F.col("text")))


@query(
    f"""WITH {_ROWS} SELECT {_KEYS}, replace(coalesce(list_extract(regexp_extract_all(text, '####\\s*(-?[0-9][0-9,]*[.]?[0-9]*)', 1), -1), list_extract(regexp_extract_all(text, '-?[0-9][0-9,]*[.]?[0-9]*'), -1)), ',', '') AS answer FROM a"""
)
def extract_guided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(spark, sf_dir, text.extract_guided(F.col("text")))


_FORMS = "CASE l_orderkey % 6 WHEN 0 THEN ' $' || CAST(l_extendedprice AS STRING) || ' ' WHEN 1 THEN CAST(CAST(l_quantity AS BIGINT) AS STRING) || ',000%' WHEN 2 THEN '7d' WHEN 3 THEN '-' || CAST(l_extendedprice AS STRING) WHEN 4 THEN CASE l_partkey % 4 WHEN 0 THEN 'Yes ' WHEN 1 THEN '0.' || CAST(l_suppkey % 9 + 1 AS STRING) || CAST(l_partkey * 1000 + l_linenumber * 10 + 5 AS STRING) WHEN 2 THEN CAST(l_suppkey AS STRING) || '.' || CAST(1000000 + l_partkey * 10 + 5 AS STRING) ELSE '9007199254740' || CAST(l_orderkey AS STRING) END ELSE '' END"
_FROWS = f"a AS (SELECT {_KEYS}, {_FORMS} AS s FROM lineitem)"


def _forms(spark: SparkSession, sf_dir: str, f) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", f(F.expr(_FORMS)).alias("answer"))


@query(f"WITH {_FROWS} SELECT {_KEYS}, CASE WHEN trim(s) <> '' THEN {_number(_CLEAN.format(x='s'), '< 1e37')} END AS answer FROM a")
def normalize_bon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forms(spark, sf_dir, text.normalize_bon)


@query(f"WITH {_FROWS} SELECT {_KEYS}, {_number(_CLEAN.format(x='s'), '<= 1e15')} AS answer FROM a")
def normalize_generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forms(spark, sf_dir, text.normalize_generator)


@query(
    f"""WITH {_FROWS}, t AS (SELECT *, replace(trim(s), ',', '') AS x FROM a)
SELECT {_KEYS}, CASE WHEN regexp_matches(x, {_NUM}) THEN CAST(CAST(trunc(TRY_CAST(x AS DOUBLE)) AS HUGEINT) AS VARCHAR) ELSE x END AS answer FROM t"""
)
def normalize_guided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forms(spark, sf_dir, text.normalize_guided)


_NAME = "'out/vanilla_task_steps128' || CASE WHEN o_orderkey % 2 = 0 THEN '_temp0.' || CAST(o_orderkey % 9 AS STRING) ELSE '' END || CASE WHEN o_orderkey % 3 = 0 THEN '_at0.1_tp0.9' ELSE '' END || '_seed' || CAST(o_custkey AS STRING) || CASE WHEN o_orderkey % 5 = 0 THEN '_bon_c3' ELSE '' END || '.json'"


@query(
    f"""WITH f AS (SELECT o_orderkey, regexp_replace({_NAME}, '[.]json$', '') AS s FROM orders)
SELECT o_orderkey, coalesce(TRY_CAST(nullif(regexp_extract(s, '_temp([0-9.]+)', 1), '') AS DOUBLE), 0.2) AS temp, coalesce(TRY_CAST(nullif(regexp_extract(s, '_at([0-9.]+)', 1), '') AS DOUBLE), 0.0) AS alg_temp,
coalesce(TRY_CAST(nullif(regexp_extract(s, '_tp([0-9.]+)', 1), '') AS DOUBLE), 0.95) AS top_p, CAST(regexp_extract(s, '_seed([0-9]+)', 1) AS BIGINT) AS seed, nullif(regexp_extract(s, '_bon_(c[0-9]+)', 1), '') AS tag FROM f"""
)
def filename_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", *text.file_config(F.expr(_NAME)))


@query("SELECT c_custkey, 'Question: 1 + 1?' || chr(10) || 'Answer: 2' || chr(10) || chr(10) || 'Question: ' || c_name || chr(10) || 'Answer:' AS prompt FROM customer")
def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", text.few_shot_prompt(F.col("c_name"), [("1 + 1?", "2")]).alias("prompt"))


@query(f"WITH {_ROWS} SELECT {_KEYS}, CASE WHEN l_orderkey % 7 = 2 THEN regexp_extract(text, 'boxed.([0-9]+)', 1) END AS boxed FROM a")
def boxed_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return _extracted(spark, sf_dir, udf.column(udf.last_boxed, T.StringType(), "text")).withColumnRenamed("answer", "boxed")


@query(f"WITH {_ROWS} SELECT {_KEYS}, CASE WHEN l_orderkey % 7 = 2 THEN regexp_extract(text, 'boxed.([0-9]+)', 1) WHEN l_orderkey % 7 = 1 THEN '$' || split_part(CAST(l_extendedprice AS VARCHAR), '.', 1) WHEN l_orderkey % 7 = 5 THEN '7 or ####' || l_partkey END AS answer FROM a")
def boxed_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(spark, sf_dir, text.extract_boxed_flat(F.col("text")))


@query("SELECT p_partkey, 'Question: ' || p_name || chr(10) || 'Put the final answer in ' || chr(92) || 'boxed{}.' || chr(10) || 'Answer:' AS prompt, substr(p_name, 1, 9) AS brief, CASE WHEN p_partkey % 3 = 0 THEN 'math' WHEN p_partkey % 3 = 1 THEN 'gsm8k' ELSE p_name END AS task FROM part")
def prompt_and_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("p_partkey") % 3 == 0, "MATH500_test").when(F.col("p_partkey") % 3 == 1, "gsm8k_x").otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", text.boxed_prompt(F.col("p_name")).alias("prompt"), text.brief(F.col("p_name"), 9).alias("brief"), text.base_task(name).alias("task"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 2 = 0 AND o_orderkey % 9 = 4")
def files_of_configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_NAME).alias("name")).where(text.of_configuration(F.col("name"), "_bon_", 0.4)).select("o_orderkey")


@query("SELECT l_suppkey % 10 AS run, count(*) AS n, round(avg(CASE WHEN l_linenumber % 2 = 0 THEN l_discount ELSE l_tax END), 9) AS mean FROM lineitem GROUP BY 1")
def first_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that name their accuracy in one of two ways."""
    metrics = F.when(F.col("l_linenumber") % 2 == 0, F.create_map(F.lit("exact"), F.col("l_discount"), F.lit("loose"), F.col("l_tax"))).otherwise(F.create_map(F.lit("loose"), F.col("l_tax")))
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("run"), text.first_metric(metrics, ["exact", "loose"]).alias("v"))
    return rows.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 9).alias("mean"))


@query("SELECT c_custkey, substr(replace(c_name, 'r', ' '), 1, 300) AS message FROM customer")
def safe_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", text.safe_message(F.regexp_replace("c_name", "r", "\n")).alias("message"))


@query("SELECT item_id, sha256(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'))) AS key FROM benchmark")
def nfkc_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return table(spark, sf_dir, "benchmark").select("item_id", F.sha2(udf.column(udf.normal_text, T.StringType(), "text"), 256).alias("key"))


def _toy_grade(output: str, gold: str) -> float:
    if output == "O":
        raise ValueError("no grade\nfor O")
    return float(output == gold)


@query("SELECT l_linestatus AS output, CASE WHEN l_linestatus = 'O' THEN 'error' ELSE 'ok' END AS status, count(*) AS n, count(*) FILTER (l_linestatus <> 'O' AND l_linestatus = l_returnflag) AS n_correct FROM lineitem GROUP BY 1, 2")
def grade_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = udf.grade_status(table(spark, sf_dir, "lineitem").select("l_linestatus", "l_returnflag"), "l_linestatus", "l_returnflag", _toy_grade)
    return rows.groupBy(F.col("l_linestatus").alias("output"), F.col("grade.status").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.count_if("grade.correct").alias("n_correct"))


def _toy_score(batch: list[list[int]]) -> list[float]:
    return [float(sum(x)) for x in batch]


@query("SELECT event_id, CAST(sum(i) AS DOUBLE) AS score FROM events, unnest(range(0, event_id % 40)) AS r(i) GROUP BY event_id UNION ALL SELECT event_id, 0.0 FROM events WHERE event_id % 40 = 0")
def score_mapinpandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    ids = F.when(F.col("event_id") % 40 > 0, F.sequence(F.lit(0), (F.col("event_id") % 40 - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return udf.scored(table(spark, sf_dir, "events").select("event_id", ids.alias("ids")), "ids", _toy_score).select("event_id", "score")


@query()
def normalize_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms with Python's way of writing floats: tested against it, not by SQL."""
    ship(spark)
    return _forms(spark, sf_dir, udf.math_form)
