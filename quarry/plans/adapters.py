"""The engine's base tables on the driver's parquet tables. The same SQL text makes them in Spark and in the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ITEMS = """
SELECT p_partkey AS item_id,
  lower(p_name) || CASE p_partkey % 4 WHEN 0 THEN ' a' || CAST(p_size AS STRING) WHEN 1 THEN ' kırmızı pamuklu' WHEN 2 THEN ' erkek çantaları' ELSE '' END AS title,
  lower(p_type) || '/' || 'size ' || CAST(p_size % 10 AS STRING) || CASE WHEN p_partkey % 9 = 0 THEN '' ELSE '/leaf' END AS category,
  CASE WHEN p_partkey % 11 = 0 THEN 'unknown' WHEN p_partkey % 7 = 0 THEN 'brand ' || substring(p_brand, 7) ELSE 'brand' || substring(p_brand, 7) END AS brand,
  CASE p_partkey % 5 WHEN 0 THEN 'kadın' WHEN 1 THEN 'erkek' WHEN 2 THEN 'unisex' ELSE 'unknown' END AS gender,
  CASE p_partkey % 7 WHEN 0 THEN 'yetişkin' WHEN 1 THEN 'çocuk' WHEN 2 THEN 'bebek' WHEN 3 THEN 'bebek & çocuk' WHEN 4 THEN 'genç' ELSE 'unknown' END AS age_group,
  CASE WHEN p_partkey % 6 = 0 THEN 'unknown' ELSE 'renk: ' || CASE p_partkey % 5 WHEN 0 THEN 'siyah' WHEN 1 THEN 'antrasit' WHEN 2 THEN 'lacivert' WHEN 3 THEN 'altın' ELSE 'kırmızı' END
    || ', materyal: ' || CASE p_partkey % 3 WHEN 0 THEN 'pamuk' WHEN 1 THEN 'deri' ELSE 'a:b' END || ', foo, size : ' || CAST(p_size AS STRING)
    || CASE WHEN p_partkey % 4 = 0 THEN ', kol boyu: uzun kol, renk: gri' ELSE '' END END AS attributes
FROM {part}
"""

TERMS = """
SELECT c_custkey AS term_id,
  lower(p_name) || CASE c_custkey % 8 WHEN 0 THEN ' erkek' WHEN 1 THEN ' kadın' WHEN 2 THEN ' mavi' WHEN 3 THEN ' bebek' WHEN 4 THEN ' pamuklu çantalar' WHEN 5 THEN ' uzun kol altın' WHEN 6 THEN ' 500 ml xl' ELSE '' END
    || CASE c_custkey % 5 WHEN 0 THEN ' brand' || substring(p_brand, 7) WHEN 1 THEN ' a' || CAST(p_size AS STRING) WHEN 2 THEN ' ' || lower(p_type) ELSE '' END AS query
FROM {customer} JOIN {part} ON p_partkey = c_custkey
"""

PAIRS = "SELECT DISTINCT o_custkey AS term_id, l_partkey AS item_id FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey"

#: A score of each pair from its keys alone, for operators that take scores from elsewhere.
SCORES = "SELECT term_id, item_id, ((term_id * 7919 + item_id * 104729) % 1000) / CAST(1000 AS DOUBLE) AS score, CASE WHEN (term_id * 31 + item_id * 17) % 5 < 2 THEN 1 ELSE 0 END AS label FROM {pairs}"

BASE = ("part", "customer", "orders", "lineitem")


class Tables:
    """Lazy access to driver tables and adapters of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def items(self) -> DataFrame:
        return self.spark.sql(ITEMS, part=self.read("part"))

    @property
    def terms(self) -> DataFrame:
        return self.spark.sql(TERMS, part=self.read("part"), customer=self.read("customer"))

    @property
    def pairs(self) -> DataFrame:
        return self.spark.sql(PAIRS, orders=self.read("orders"), lineitem=self.read("lineitem"))

    @property
    def scores(self) -> DataFrame:
        return self.spark.sql(SCORES, pairs=self.pairs)

    def __getattr__(self, name: str) -> DataFrame:
        return self.read(name)


def with_tables(sql: str) -> str:
    """An oracle query with the adapters in front as common table expressions."""
    names = {b: b for b in BASE}
    head = ", ".join(f"{n} AS ({s.format(**names, pairs='pairs').strip()})" for n, s in (("items", ITEMS), ("terms", TERMS), ("pairs", PAIRS), ("scores", SCORES)))
    return f"WITH {head} {', ' + sql.strip()[5:] if sql.strip().upper().startswith('WITH ') else sql}"
