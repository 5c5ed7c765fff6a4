"""Token vault: what makes tokens reversible for those who may read the vault table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from palisade.functions.masking import as_text, token
from palisade.operators.lookups import splittable
from palisade.session import fresh_path


def token_vault(
    df: DataFrame, columns: list[str], *, salt: str = "", compat: bool = False, whole: bool = False
) -> DataFrame:
    """(column, token, value): one row per distinct value. Equal values fold together before
    the shuffle, so a value that fills a third of the table costs one row per task. ``whole``
    vaults serve ``mask(..., whole_tokens=True)``."""
    pairs = [
        F.struct(F.lit(c).alias("column"), as_text(F.col(c), df.schema[c].dataType, compat).alias("value"))
        for c in columns
    ]
    values = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.column", "p.value")
    values = values.filter("value is not null").distinct()
    return values.select("column", token(F.col("value"), salt, compat, whole).alias("token"), "value")


def detokenize(df: DataFrame, column: str, vault: DataFrame, ambiguous: str | None = None, stored: bool = False) -> DataFrame:
    """Give a tokenized column its values back; the row count never changes.

    A token the vault does not hold gives NULL. So does one that stands for several values,
    since none of them may be guessed; the optional column ``ambiguous`` is true for these.
    An equi join: the vault is folded to one row per token and shuffled afresh, so adaptive
    execution can split a token that fills much of the table. A vault from ``store_vault`` (``stored``) stays where it is; a
    token that fills much of the table then stays in one task.
    """
    per = vault.filter(F.col("column") == column).groupBy("token").agg(
        F.min("value").alias("_value"), (F.min("value") != F.max("value")).alias("_several")
    )
    own = (per if stored else splittable(per, "token")).withColumnRenamed("token", column)
    joined = df.join(own, column, "left")
    found = F.when(~F.col("_several"), F.col("_value"))
    out = [found.alias(c) if c == column else F.col(c) for c in df.columns]
    flag = [] if ambiguous is None else [F.coalesce("_several", F.lit(False)).alias(ambiguous)]
    return joined.select(*out, *flag)


def store_vault(vault: DataFrame, buckets: int | None = None) -> DataFrame:
    """The vault as files bucketed by token in the shared folder: ``detokenize`` with ``stored`` then moves the rows that it
    gives values to, once at most, and never the vault. The catalog does not keep the files."""
    spark = vault.sparkSession
    buckets, path = buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), fresh_path(spark, "vault")
    name = path.rpartition("/")[2].replace("-", "_")
    rows = vault.repartition(buckets, "token").sortWithinPartitions("token")
    rows.write.bucketBy(buckets, "token").sortBy("token").option("path", path).saveAsTable(name, format="parquet")
    stored = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # of the entry only: the files have a path of their own
    return stored


def token_collisions(vault: DataFrame) -> DataFrame:
    """Tokens that stand for more than one value of a column."""
    per = vault.groupBy("column", "token").agg(F.countDistinct("value").alias("values"))
    return per.filter("values > 1")
