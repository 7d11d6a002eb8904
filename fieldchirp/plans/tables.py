"""Reading the project's tables and what queries have in common."""

from pyspark.sql import DataFrame, SparkSession

from fieldchirp.session import ship

#: SQL that cleans a file key, for the oracles.
SQL_KEY = "nullif(regexp_replace(trim({}, ' \t\r\n'), '/{{2,}}', '/', 'g'), '')"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sql_key(column: str) -> str:
    return SQL_KEY.format(column)
