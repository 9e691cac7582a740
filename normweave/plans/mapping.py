"""The engine's tables made from general ones: documents as articles, questions, logs, versions, references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.ship import ship


#: Bytes up to which a table of texts is spread over all cores after its scan: it may be one row group, hence one task.
SMALL = 64 << 20
TEXTS = {"documents", "pages"}


def _bytes(spark: SparkSession, path: str) -> int:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; filters and unused columns still go down to the scan where rows are spread."""
    ship(spark)
    path = f"{sf_dir}/{name}.parquet"
    rows, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if name in TEXTS and cores > 1 and _bytes(spark, path) < SMALL else rows


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as articles: a source is a rule, a language a division, the first line the title."""
    d = read(spark, sf_dir, "documents")
    key = F.col("doc_id").cast("string")
    return d.select(
        F.col("doc_id").alias("pos"), F.col("source").alias("rule_name"), F.col("lang").alias("division"), key.alias("article_no"),
        F.substring_index("text", "\n", 1).alias("article_title"), F.col("text").alias("body"), key.alias("source_key"),
        F.concat(F.lit("https://www.jnu.ac.kr/rule?mode=file&key="), key).alias("source_url"), F.lit("2024-01-01").alias("collected_at"),
        F.lit(None).cast("string").alias("record_type"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item, whole, as a question."""
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users said as questions, in order; a question is answered if the conversation's number is even."""
    c = read(spark, sf_dir, "conversations").where("role = 'user'")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("ts"), F.col("text").alias("question"), F.col("text").alias("response"), (F.col("conv_id") % 2 == 0).alias("answered"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as dated versions of a rule; the last order of each is the current, undated one."""
    from pyspark.sql import Window

    o = read(spark, sf_dir, "orders")
    of = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    rows = o.select(F.concat(F.lit("rule "), "o_custkey").alias("rule_name"), F.col("o_orderkey").alias("place"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.row_number().over(of).alias("n"))
    return rows.select("rule_name", "place", F.when(F.col("n") > 1, F.col("day")).alias("revised_on"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of all orders, shifted by half a year, asked of another customer's rule."""
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("probe_id"), F.concat(F.lit("rule "), F.col("o_custkey")).alias("rule_name"), F.date_format(F.date_sub("o_orderdate", 180), "yyyy-MM-dd").alias("date"))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a posted listing; labelled ones are collected, good ones current."""
    d, marks = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    rows = d.join(marks.select("doc_id", "quality"), "doc_id", "left")
    return rows.select(F.col("doc_id").alias("key"), F.concat(F.lit("doc "), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("name"), F.col("source").alias("division"), (F.coalesce("quality", F.lit(1)) == 1).alias("is_current"))


def referring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as articles that refer to another article of their customer's rule, to one of a neighbour's, and to law."""
    o = read(spark, sf_dir, "orders")
    own, next_ = F.col("o_custkey"), F.col("o_custkey") + 1
    name = lambda k: F.concat(F.lit("고객"), F.translate(k.cast("string"), "0123456789", "가나다라마바사아자차"), F.lit(" 규정"))
    number = lambda x: F.concat(F.lit("제"), x.cast("string"), F.lit("조"))
    body = F.concat(number(F.col("o_orderkey") + 1), F.lit("에 따른다. 「"), name(next_), F.lit("」 "), number(F.col("o_orderkey") % 97 + 1), F.lit("를 준용한다. ｢상법｣ 제3조를 본다."))
    return o.select(
        F.col("o_orderkey").alias("pos"), F.concat(F.lit("r-"), "o_orderkey").alias("record_id"), name(own).alias("rule_name"), number(F.col("o_orderkey")).alias("article_no"),
        body.alias("body"), F.col("o_custkey").cast("string").alias("source_key"), F.lit(V.MAIN).alias("record_type"),
    )
