"""All queries over the reference tables, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from urlsieve.plans import model_queries, risk_queries, service_queries, table_queries, text_queries

QUERIES = text_queries.QUERIES | table_queries.QUERIES | risk_queries.QUERIES | model_queries.QUERIES | service_queries.QUERIES
SQL = text_queries.SQL | table_queries.SQL | risk_queries.SQL | model_queries.SQL | service_queries.SQL


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk_queries.feature_table(spark, sf_dir)
