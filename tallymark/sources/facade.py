"""A measures table over the driver's star schema, the same in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallymark.functions.keys import with_keys

#: Both engines run this text; {names} are tables.
SQL = """
WITH v AS (
  SELECT l_orderkey,
         CAST(SUM(CASE WHEN l_returnflag <> 'R' THEN l_quantity END) AS BIGINT) AS yes_votes,
         CAST(SUM(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS BIGINT) AS no_votes
  FROM {lineitem} GROUP BY l_orderkey
)
SELECT
  o_orderkey AS id, CAST(year(o_orderdate) AS INT) AS year, r_name AS state, n_name AS county,
  CASE o_orderkey % 7 WHEN 0 THEN 'CA_SOS' WHEN 1 THEN 'CA_SOS_Scraper' WHEN 2 THEN 'NCSL' WHEN 3 THEN 'CEDA'
       WHEN 4 THEN 'ICPSR' WHEN 5 THEN 'UC_Law_SF' ELSE 'Other' END AS data_source,
  CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_custkey % 50 AS STRING) END AS measure_id,
  CASE WHEN o_orderkey % 4 = 1 THEN substr('ABCDEFGH', CAST(o_custkey % 8 + 1 AS INT), 1) END AS measure_letter,
  CASE o_orderkey % 6
    WHEN 0 THEN concat('Proposition ', CAST(o_custkey % 40 AS STRING))
    WHEN 1 THEN concat('ACA ', CAST(o_custkey % 20 AS STRING))
    WHEN 2 THEN concat(n_name, ' Measure ', substr('ABCDEFGH', CAST(o_custkey % 8 + 1 AS INT), 1))
    WHEN 3 THEN concat('sb ', CAST(o_custkey % 30 AS STRING), ' (relates)')
    WHEN 4 THEN concat('Local question ', CAST(o_custkey AS STRING)) END AS title,
  CASE WHEN o_orderkey % 3 = 0 THEN concat(c_mktsegment, ' bonds') END AS description,
  CASE WHEN o_orderkey % 9 = 0 THEN concat('Shall ', n_name, ' adopt ', o_orderpriority, '?') END AS ballot_question,
  v.yes_votes, v.no_votes, v.yes_votes + v.no_votes AS total_votes,
  CASE WHEN v.yes_votes + v.no_votes > 0 THEN CAST(floor(CAST(v.yes_votes AS DOUBLE) / (v.yes_votes + v.no_votes) * 100 * 100 + 0.5) AS DOUBLE) / 100 END AS percent_yes,
  CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS passed,
  CASE WHEN o_orderkey % 8 <> 0 THEN o_orderpriority END AS topic_primary,
  c_mktsegment AS category_topic,
  CASE WHEN o_orderkey % 10 = 0 THEN '#' WHEN o_orderkey % 2 = 0
       THEN concat('https://example.org/pdf/', CAST(o_orderkey AS STRING), '.pdf') END AS pdf_url,
  (o_orderkey % 4 = 0) AS has_summary,
  CASE WHEN o_orderkey % 4 = 0 THEN concat('Summary of ', c_mktsegment) END AS summary_text,
  (o_orderkey % 13 <> 0) AS is_active,
  (o_orderkey % 11 = 0) AS is_duplicate,
  CASE WHEN o_orderkey % 11 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'content' ELSE 'cross_source' END END AS duplicate_type,
  o_orderdate AS updated_at
FROM {orders}
JOIN {customer} ON o_custkey = c_custkey
JOIN {nation} ON c_nationkey = n_nationkey
JOIN {region} ON n_regionkey = r_regionkey
LEFT JOIN v ON v.l_orderkey = o_orderkey
"""
TABLES = ("lineitem", "orders", "customer", "nation", "region")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spark picks how the dimensions are joined, by their sizes."""
    return spark.sql(SQL, **{t: read(spark, sf_dir, t) for t in TABLES})


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_keys(measures(spark, sf_dir))
