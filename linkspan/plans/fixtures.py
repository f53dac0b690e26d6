"""Entity tables derived from `customer`, in SQL that Spark and DuckDB both run.

There is no noisy multi-source table among the inputs, so names, addresses and
their noise are arithmetic on the customer's key and nation; the true matches are
known. The lists below are fixed values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkspan.sources.shared import ship

FIRST = "golden,silver,northern,southern,eastern,western,prime,royal,urban,coastal,summit,valley,river,harbor,maple,cedar,lotus"
SECOND = "retail,foods,textiles,motors,logistics,pharma,studio,dental,marketing,properties,builders,travels,seafood,learning,barber,consultants,energy,optics,steel"
THIRD = "house,group,partners,works,center,traders,labs,systems,enterprise,associates,services,gallery,depot"
SUFFIX = "Inc,LLC,Corp,Ltd,Co"
STREET = "Oak,Elm,Ellis,Fawn,Mack,Hill,Lake"
KIND = "Road,Street,Avenue"
CITY = "Austin,Pune,Lyon,Phoenix,Bhopal,Nice,Tulsa,Delhi,Paris,Tampa,Surat"
FOREIGN = "राम मार्केटिंग"


def _pick(values: str, index: str) -> str:
    return f"split_part('{values}', ',', CAST({index} AS INT) + 1)"


def _noisy(source: str, shift: int) -> str:
    mode = f"(CAST(floor(k / 10) AS BIGINT) + {shift} + j) % 7"
    return f"""
SELECT '{source}-' || CAST(k * 10 + j AS STRING) AS entity_id,
  CASE {mode} WHEN 0 THEN upper(stem || ' ' || suffix) WHEN 1 THEN suffix || ' ' || stem
    WHEN 2 THEN stem || ' & Company' WHEN 3 THEN stem || ' ' || suffix
    WHEN 4 THEN replace(stem || ' ' || suffix, 'e', 'é')
    WHEN 5 THEN substr(stem || ' ' || suffix, 1, 3) || substr(stem || ' ' || suffix, 5)
    ELSE '{FOREIGN} ' || suffix END AS business_name,
  CASE WHEN (k + {shift} + j) % 29 = 0 THEN NULL
    WHEN (k + {shift}) % 4 = 1 THEN upper(replace(replace(addr, 'Road', 'Rd'), 'Street', 'St'))
    ELSE addr END AS business_address,
  country, 'S1-' || CAST(k AS STRING) AS true_s1
FROM (SELECT *, 0 AS j FROM er_ent WHERE k % 10 <> 0 UNION ALL SELECT *, 1 AS j FROM er_ent WHERE k % 10 <> 0 AND k % 3 = 0) AS copies"""


#: (name, SQL) of the derived tables; each may use those before it and `customer`.
VIEWS = (
    ("er_ent", f"""
SELECT c_custkey AS k,
  {_pick(FIRST, "c_custkey % 17")} || ' ' || {_pick(SECOND, "CAST(floor(c_custkey / 17) AS BIGINT) % 19")} || ' ' || {_pick(THIRD, "CAST(floor(c_custkey / 323) AS BIGINT) % 13")} AS stem,
  {_pick(SUFFIX, "c_custkey % 5")} AS suffix,
  CAST(100 + (c_custkey * 37) % 9900 AS STRING) || ' ' || {_pick(STREET, "c_custkey % 7")} || ' ' || {_pick(KIND, "c_custkey % 3")} || ', ' || {_pick(CITY, "c_custkey % 11")} AS addr,
  CASE c_nationkey % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'India' ELSE 'France' END AS country
FROM customer"""),
    ("er_source1", "SELECT 'S1-' || CAST(k AS STRING) AS entity_id, stem || ' ' || suffix AS business_name, addr AS business_address, country FROM er_ent"),
    ("er_noisy2", _noisy("S2", 0)),
    ("er_noisy3", _noisy("S3", 3)),
    ("er_source2", "SELECT entity_id, business_name, business_address, country FROM er_noisy2"),
    ("er_source3", "SELECT entity_id, business_name, business_address, country FROM er_noisy3"),
    ("er_pairs", "SELECT true_s1 AS s1_id, entity_id AS cand_id FROM er_noisy2 UNION ALL SELECT true_s1, entity_id FROM er_noisy3"),
)


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The derived tables by name, with er_truth (a list table of all of source 1)."""
    ship(spark)
    found: dict[str, DataFrame] = {"customer": spark.read.parquet(f"{sf_dir}/customer.parquet")}
    for name, sql in VIEWS:
        used = {k: v for k, v in found.items() if k in sql}
        for k in sorted(used, key=len, reverse=True):
            sql = sql.replace(f"FROM {k}", f"FROM {{{k}}}")
        found[name] = spark.sql(sql, **used)
    lists = found["er_pairs"].groupBy("s1_id").agg({"cand_id": "collect_list"})
    lists = lists.selectExpr("s1_id", "array_join(array_sort(`collect_list(cand_id)`), ',') AS ids")
    found["er_truth"] = (
        found["er_source1"].join(lists, found["er_source1"].entity_id == lists.s1_id, "left")
        .selectExpr("entity_id AS source1_entity_id", "coalesce(ids, '') AS matched_entity_ids")
    )
    return found


#: The same tables as common table expressions for the oracle.
CTES = (
    "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in VIEWS)
    + """,
er_truth AS (SELECT entity_id AS source1_entity_id, coalesce(ids, '') AS matched_entity_ids FROM er_source1
  LEFT JOIN (SELECT s1_id, string_agg(cand_id, ',' ORDER BY cand_id) AS ids FROM er_pairs GROUP BY s1_id) ON entity_id = s1_id)"""
)
