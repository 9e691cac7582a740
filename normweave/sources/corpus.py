"""Readers of the corpus, the lineage and the categories, with the errors that each must raise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pii
from ..functions.frames import number
from ..operators.gate import require

#: Field names in files, and ours.
FIELDS = {
    "규정명": "rule_name", "편제": "division", "조문번호": "article_no", "조문제목": "article_title", "본문": "body", "source_key": "source_key",
    "source_url": "source_url", "수집일시": "collected_at", "record_type": "record_type", "revision": "revision", "record_id": "record_id", "장": "chapter", "절": "section",
}
_SHORT = {"조문번호": "article_no", "조문제목": "article_title", "본문": "body"}
_ARTICLES = "array<struct<" + ",".join(f"`{k}`:string" for k in _SHORT) + ">>"
_VERSIONS = f"array<struct<key:string,label:string,valid_from:string,valid_until:string,source_url:string,articles:{_ARTICLES}>>"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark's file systems have the path."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first path that exists, such as the whole corpus before its sample."""
    for path in paths:
        if exists(spark, path):
            return path
    raise FileNotFoundError(", ".join(paths))


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Articles of a JSON array (or of JSON lines) with pos, their order in the file.

    A file that is not JSON, or an array without objects, is an error; so is a required field that no
    object has. Fields that the schema lacks are left out.
    """
    ddl = ", ".join(f"`{k}` string" for k in FIELDS)
    raw = spark.read.schema(ddl + ", `_bad` string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    raw = raw.select("*", F.monotonically_increasing_id().alias("__at"))
    if raw.where(F.col("_bad").isNotNull()).head(1) or not raw.head(1):
        raise ValueError(f"no articles can be read from {path}")
    needed = list(FIELDS)[:7]
    counts = raw.agg(*[F.count(F.col(f"`{k}`")).alias(k) for k in needed]).first()
    missing = [k for k in needed if not counts[k]]
    if missing:
        raise ValueError(f"required fields are missing: {', '.join(missing)}")
    named = raw.select(*[F.col(f"`{k}`").alias(v) for k, v in FIELDS.items()], "__at")
    return require(number(named, [F.col("__at")]).drop("__at"))


def read_lineage(spark: SparkSession, path: str) -> DataFrame:
    """Versions (rule_name, place, key, label, valid_from, valid_until, source_url, articles) of a JSON object of arrays.

    A file that is missing or can't be read gives an empty table.
    """
    if exists(spark, path):
        text = spark.read.text(path, wholetext=True)
        maps = text.select(F.from_json("value", f"map<string,{_VERSIONS}>").alias("m")).where("m is not null")
    else:
        maps = spark.createDataFrame([], f"m map<string,{_VERSIONS}>")
    rules = maps.select(F.explode("m").alias("rule_name", "versions"))
    rows = rules.select("rule_name", F.posexplode("versions").alias("place", "v")).select("rule_name", "place", "v.*")
    return rows.withColumn("articles", F.transform("articles", lambda a: F.struct(*[a[k].alias(v) for k, v in _SHORT.items()])))


CODES = [f"INT-{i:02d}" for i in range(1, 10)]


def read_categories(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(categories, scenarios) of the classifier's JSON; an error unless it is declared synthetic, has exactly the nine codes, complete, and no personal data."""
    anchor = "struct<`편제`:array<string>,keywords:array<string>>"
    ddl = f"data_manifest struct<classification:string>, categories array<struct<code:string,name:string,typical_issue:string,selfcheck:array<string>,rule_anchor:{anchor},law_ref:array<string>,risk:string>>, demo_scenarios array<struct<user_input_example:string,matched_category:string,expected_response:string>>"
    one = spark.read.schema(ddl).option("multiLine", True).json(path)
    cats = one.select(F.posexplode("categories").alias("place", "c")).select("place", "c.code", "c.name", "c.typical_issue", "c.selfcheck", F.col("c.rule_anchor.`편제`").alias("divisions"), F.col("c.rule_anchor.keywords").alias("keywords"), "c.law_ref", "c.risk")
    scenarios = one.select(F.explode("demo_scenarios").alias("s")).select(F.col("s.matched_category").alias("code"), F.col("s.user_input_example").alias("text"))
    kind = one.select(F.lower(F.col("data_manifest.classification")).alias("k")).first()
    if kind is None or kind.k is None or "synthetic" not in kind.k:
        raise ValueError("the categories must be declared synthetic")
    rows = cats.select("code", "name", "typical_issue", F.size("selfcheck").alias("n"), F.col("keywords").isNotNull().alias("a")).limit(100).collect()
    if sorted(r.code or "" for r in rows) != CODES or any(not r.name or not r.typical_issue or r.n < 1 or not r.a for r in rows):
        raise ValueError("the categories are not the nine complete ones")
    if one.select(F.to_json(F.struct("categories", "demo_scenarios")).alias("t")).where(F.size(pii.scan(pii.folded(F.col("t")))) > 0).count():
        raise ValueError("the categories hold personal data")
    return cats, scenarios


def fingerprint(spark: SparkSession, path: str) -> str:
    """First 16 hex digits of the SHA-256 of a file's bytes."""
    return spark.read.format("binaryFile").load(path).select(F.substring(F.sha2("content", 256), 1, 16)).first()[0]
