"""Orders as a handbook of Korean rules in which every kind of mention occurs, and queries over it with their SQL.

A customer is a rule, an order one of its articles, numbered by key; customers of even number have one
attachment. The remainder of an order's key tells which of six texts an article has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import pii
from ..functions import text as X
from ..functions import values as V
from ..operators import annotate, classify, etl, operations, references, search, temporal
from . import mapping as M

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _name(k: Column) -> Column:
    return F.concat(F.lit("고객"), F.translate(k.cast("string"), "0123456789", "가나다라마바사아자차"), F.lit(" 규정"))


def handbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = M.read(spark, sf_dir, "orders").withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    kind, c = F.col("o_orderkey") % 6, F.col("o_custkey")
    body = (
        F.when(kind == 0, "금액은 별표 1과 같다.")
        .when(kind == 1, "① 위원회를 둔다.\n② 세부는 산학협력단장이 따로 정한다.")
        .when(kind == 2, F.concat(F.lit("신청은 「"), _name(c + 1), F.lit("」에 따른다.")))
        .when(kind == 3, F.concat(F.lit("이는 제"), (F.col("n") + 1).cast("string"), F.lit("조제2항에 따른다.")))
        .when(kind == 4, "① 「관련 규정」을 본다.\n② 삭제 <2020. 1. 1.>")
        .otherwise("비용은 「민법」에 의한다.")
    )
    rows = o.select(
        F.col("o_orderkey").cast("long").alias("pos"), F.concat(F.lit("r-"), "o_orderkey").alias("record_id"), _name(c).alias("rule_name"), F.concat(F.lit("제"), "n", F.lit("조")).alias("article_no"),
        F.lit("조문").alias("article_title"), F.lit("학사").alias("division"), body.alias("body"), F.when(c % 3 == 0, F.concat(F.lit("2200000"), c)).otherwise(c.cast("string")).alias("source_key"), F.lit(V.MAIN).alias("record_type"),
    )
    sheets = o.where("n = 1 and o_custkey % 2 = 0").select(
        (-F.col("o_custkey")).cast("long").alias("pos"), F.concat(F.lit("a-"), "o_custkey").alias("record_id"), _name(c).alias("rule_name"), F.lit("별표 1").alias("article_no"),
        F.lit("금액표").alias("article_title"), F.lit("학사").alias("division"), F.lit("<table><tr><td>1</td></tr></table>").alias("body"), c.cast("string").alias("source_key"), F.lit(V.ATTACHMENT).alias("record_type"),
    )
    return rows.unionByName(sheets).withColumn("repealed_clauses", annotate.repealed_clauses(F.col("body")))


_NAME = lambda k: f"'고객' || translate(CAST({k} AS VARCHAR), '0123456789', '가나다라마바사아자차') || ' 규정'"
_BOOK = f"""
art AS (
  SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 6 AS kind, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, 'r-' || o_orderkey AS id, {_NAME('o_custkey')} AS rule FROM orders
), customers AS (
  SELECT DISTINCT c, rule FROM art
), edge AS (
  SELECT id AS src_id, CASE WHEN c % 2 = 0 THEN 'attachment' ELSE 'attachment_not_collected' END AS kind, '별표 1' AS raw, CASE WHEN c % 2 = 0 THEN rule END AS target_rule, CASE WHEN c % 2 = 0 THEN '별표 1' END AS target_article,
    CAST(NULL AS VARCHAR) AS target_clause, c % 2 = 0 AS resolved, CASE WHEN c % 2 = 0 THEN 'a-' || c END AS dst_id, CASE WHEN c % 2 = 1 THEN CASE WHEN c % 3 = 0 OR length(CAST(c AS VARCHAR)) > 6 THEN 'image_only' ELSE 'parser_scope' END END AS reason_code,
    CAST(NULL AS VARCHAR) AS clause, CAST(NULL AS VARCHAR) AS delegate FROM art WHERE kind = 0
  UNION ALL SELECT id, 'unnamed_delegation', '② 세부는 산학협력단장이 따로 정한다', NULL, NULL, NULL, false, NULL, 'unnamed_delegation', '②', '산학협력단장' FROM art WHERE kind = 1
  UNION ALL SELECT id, CASE WHEN t.rule IS NULL THEN 'external_rule_unmatched' ELSE 'rule_level' END, '「' || {_NAME('a.c + 1')} || '」', t.rule, NULL, NULL, false, NULL, CASE WHEN t.rule IS NULL THEN 'external_rule_unmatched' END, NULL, NULL
    FROM art a LEFT JOIN customers t ON t.c = a.c + 1 WHERE kind = 2
  UNION ALL SELECT a.id, CASE WHEN t.kind = 4 THEN 'repealed_clause' ELSE 'same_rule' END, '제' || (a.n + 1) || '조제2항', CASE WHEN t.kind <> 4 THEN a.rule END, CASE WHEN t.kind <> 4 THEN '제' || (a.n + 1) || '조' END, CASE WHEN t.kind <> 4 THEN '제2항' END,
    coalesce(t.kind <> 4, false), CASE WHEN t.kind <> 4 THEN t.id END, CASE WHEN t.id IS NULL THEN 'no_record' WHEN t.kind = 4 THEN 'repealed_clause' END, NULL, NULL
    FROM art a LEFT JOIN art t ON t.c = a.c AND t.n = a.n + 1 WHERE a.kind = 3
  UNION ALL SELECT id, 'external_law', '「민법」', NULL, NULL, NULL, false, NULL, 'external_law', NULL, NULL FROM art WHERE kind = 5
)"""
_EDGE = "src_id, kind, raw, target_rule, target_article, target_clause, resolved, dst_id, reason_code, clause, delegate"


def _edges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    articles = handbook(spark, d)
    return articles, references.outbound(articles)


def _of_kinds(spark: SparkSession, d: str, *kinds: str) -> DataFrame:
    return _edges(spark, d)[1].where(F.col("kind").isin(*kinds)).select(*_EDGE.split(", "))


@query(f"WITH {_BOOK} SELECT {_EDGE} FROM edge WHERE kind IN ('attachment', 'attachment_not_collected')")
def g1_attachment_mentions(spark, d):
    return _of_kinds(spark, d, "attachment", "attachment_not_collected")


@query(f"WITH {_BOOK} SELECT {_EDGE} FROM edge WHERE kind = 'unnamed_delegation'")
def g2_delegations(spark, d):
    return _of_kinds(spark, d, "unnamed_delegation")


@query(f"WITH {_BOOK} SELECT {_EDGE} FROM edge WHERE kind IN ('rule_level', 'external_rule_unmatched', 'external_law')")
def g3_rule_mentions(spark, d):
    return _of_kinds(spark, d, "rule_level", "external_rule_unmatched", "external_law")


@query(f"WITH {_BOOK} SELECT {_EDGE} FROM edge WHERE kind IN ('repealed_clause', 'same_rule')")
def g7_repealed_clauses(spark, d):
    return _of_kinds(spark, d, "repealed_clause", "same_rule")


@query(f"WITH {_BOOK} SELECT src_id AS record_id, 'outbound' AS direction, dst_id AS other_id, kind, raw FROM edge UNION ALL SELECT dst_id, 'inbound', src_id, kind, raw FROM edge WHERE resolved")
def g10_related(spark, d):
    articles, edges = _edges(spark, d)
    return references.related(edges, articles, articles.select("record_id").distinct())


@query(f"WITH {_BOOK} SELECT count(*) FILTER (kind IN (2, 4, 5)) AS n_rows, count(*) FILTER (kind = 4) AS silent, round(count(*) FILTER (kind = 4) / count(*) FILTER (kind IN (2, 4, 5)), 4) AS rate FROM art")
def a9_silence(spark, d):
    """Names of rules that no edge covers: those that stand for no rule."""
    articles, edges = _edges(spark, d)
    return references.silence(articles, edges, F.regexp_extract_all("body", F.lit("「([^」]+)」"), 1))


# Words


_PARTICLE = "|".join(V.PARTICLES)
_FORMS = f"""
word AS (
  SELECT unnest(list_filter(regexp_extract_all(lower(body), '[0-9A-Za-z가-힣]+'), lambda w: length(w) >= 2 AND w NOT IN ({", ".join(f"'{w}'" for w in V.STOP_WORDS)}))) AS w FROM book
), bare AS (
  SELECT w, regexp_extract(w, '^(.{{2,}}?)({_PARTICLE})$', 1) AS b FROM word
)"""
_BODIES = f"book AS (SELECT CASE kind WHEN 0 THEN '금액은 별표 1과 같다.' WHEN 1 THEN '① 위원회를 둔다. ② 세부는 산학협력단장이 따로 정한다.' WHEN 2 THEN '신청은 「' || {_NAME('c + 1')} || '」에 따른다.' WHEN 3 THEN '이는 제' || (n + 1) || '조제2항에 따른다.' WHEN 4 THEN '① 「관련 규정」을 본다. ② 삭제 <2020. 1. 1.>' ELSE '비용은 「민법」에 의한다.' END AS body FROM art)"


@query(f"WITH {_BOOK}, {_BODIES}, {_FORMS} SELECT term, count(*) AS n FROM (SELECT w AS term FROM bare UNION ALL SELECT b FROM bare WHERE b <> '') GROUP BY term")
def t2_particles(spark, d):
    words = handbook(spark, d).where(F.col("record_type") == V.MAIN).select(F.explode(F.flatten(F.transform(X.words(F.col("body")), lambda w: X.full_forms(w)))).alias("term"))
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"WITH {_BOOK}, {_BODIES}, {_FORMS}, gram AS (SELECT unnest(list_distinct([('#' || substr(w, i, 2)) for i in range(1, length(w))] || [('#' || substr(w, i, 3)) for i in range(1, length(w) - 1)])) AS term FROM word WHERE regexp_full_match(w, '[가-힣]+')) "
    "SELECT term, count(*) AS n FROM gram GROUP BY term"
)
def t3_shingles(spark, d):
    words = handbook(spark, d).where(F.col("record_type") == V.MAIN).select(F.explode(F.flatten(F.transform(X.words(F.col("body")), lambda w: X.grams(w)))).alias("term"))
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


# Lookup, filters and versions


@query(f"WITH {_BOOK} SELECT id AS record_id, '본칙' AS record_type FROM art WHERE c = 1 AND n = 2")
def f2_point_lookup(spark, d):
    """An article by name and number, spaces in the number ignored."""
    rows = handbook(spark, d).withColumn("revision", F.lit(""))
    return operations.point_lookup(rows, " 고객나 규정 ", "제 2 조").select("record_id", "record_type")


@query("SELECT source AS rule_name, arg_min(lang, doc_id) AS division, count(*) AS n_articles FROM documents WHERE contains(lang, 'e') GROUP BY source")
def f3_division_filter(spark, d):
    return operations.rules_list(M.articles(spark, d), "e").select("rule_name", "division", "n_articles")


_VALID = """
o AS (
  SELECT 'rule ' || o_custkey AS rule_name, o_orderkey AS place, strftime(o_orderdate, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders
), dated AS (
  SELECT rule_name, place, CASE WHEN r > 1 THEN day END AS revised_on FROM o
), valid AS (
  SELECT rule_name, place, CASE WHEN revised_on IS NOT NULL THEN lag(revised_on) OVER (PARTITION BY rule_name ORDER BY revised_on ASC NULLS LAST, place) ELSE max(revised_on) OVER (PARTITION BY rule_name) END AS valid_from, revised_on AS valid_until FROM dated
), probe AS (
  SELECT o_orderkey AS probe_id, 'rule ' || o_custkey AS rule_name, strftime(CAST(o_orderdate AS DATE) - 180, '%Y-%m-%d') AS date FROM orders
), hit AS (
  SELECT p.probe_id, v.place, v.valid_from, v.valid_until, row_number() OVER (PARTITION BY p.probe_id ORDER BY v.place) AS r
  FROM probe p LEFT JOIN valid v ON p.rule_name = v.rule_name AND (v.valid_from IS NULL OR v.valid_from <= p.date) AND (v.valid_until IS NULL OR p.date < v.valid_until)
)"""


@query(
    f"WITH {_VALID} SELECT probe_id, CASE WHEN place IS NULL THEN 'not_found' ELSE 'ok' END AS status, CASE WHEN place IS NULL THEN NULL WHEN probe_id % 3 = 0 THEN '가격' WHEN probe_id % 3 = 1 THEN '개요,가격,기한' ELSE '개요,가격,기한,벌칙' END AS titles, "
    "CASE WHEN place IS NULL THEN NULL WHEN valid_from IS NULL AND valid_until IS NOT NULL THEN 'first' ELSE 'other' END AS version FROM hit WHERE r = 1"
)
def v3_articles_as_of(spark, d):
    """Articles of the version that held on a date; a keyword picks those that have it, or the first three."""
    article = lambda t: F.struct(F.lit(t).alias("article_title"), F.concat(F.lit("본문 "), F.col("place").cast("string")).alias("body"))
    versions = temporal.assign_validity(M.versions(spark, d)).withColumn("articles", F.array(*[article(t) for t in ("개요", "가격", "기한", "벌칙")]))
    word = F.when(F.col("probe_id") % 3 == 0, "가격 가").when(F.col("probe_id") % 3 == 1, "없는말 다른말")
    got = temporal.pick_articles(temporal.as_of(versions, M.probes(spark, d).withColumn("keyword", word)))
    titles = F.array_join(F.transform("articles", lambda a: a["article_title"]), ",")
    return got.select("probe_id", "status", F.when(F.col("status") == "ok", titles).alias("titles"), F.when(F.col("notice").startswith("earliest"), "first").when(F.col("notice").isNotNull(), "other").alias("version"))


@query("WITH a AS (SELECT doc_id, doc_id % 3 <> 0 AS cur, doc_id % 5 = 0 AS rep FROM documents), q AS (SELECT n_nationkey AS query_id, n_nationkey % 2 = 0 AS sup, n_nationkey % 3 = 0 AS old FROM nation) "
       "SELECT query_id, count(*) AS n FROM q JOIN a ON (cur OR sup) AND (NOT rep OR old) GROUP BY query_id")  # fmt: skip
def f1_version_flags(spark, d):
    """How many articles each question may use, by its two flags; all articles have the word asked for."""
    rows = M.articles(spark, d).withColumn("division", F.lit("공통낱말")).withColumn("is_current", F.col("pos") % 3 != 0).withColumn("is_repealed", F.col("pos") % 5 == 0)
    n = F.col("n_nationkey")
    asked = M.read(spark, d, "nation").select(n.alias("query_id"), F.lit("공통낱말").alias("query"), (n % 2 == 0).alias("include_superseded"), (n % 3 == 0).alias("include_repealed"))
    index = search.build(rows, search.question_terms(asked))
    return search.score(index, asked).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_BOOK}, hit AS (SELECT c % 40 AS query_id, id, k AS rank FROM art), up AS (SELECT query_id, target_rule, min(rank) AS first FROM hit JOIN edge ON id = src_id WHERE resolved AND kind = 'attachment' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first, target_rule) AS rank FROM up) SELECT query_id, target_rule, rank FROM r WHERE rank <= 8")
def j12_upstream_checks(spark, d):
    """Rules that the hits of a question refer to; attachments' rules stand for other rules here."""
    articles, edges = _edges(spark, d)
    other = edges.where("resolved and kind = 'attachment'").withColumn("kind", F.lit("cross_rule"))
    hits = M.read(spark, d, "orders").select((F.col("o_custkey") % 40).alias("query_id"), F.concat(F.lit("r-"), "o_orderkey").alias("record_id"), F.col("o_orderkey").alias("rank"))
    return operations.upstream_checks(hits, other).select("query_id", "target_rule", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_BOOK} SELECT id AS record_id, kind NOT IN (2, 4, 5) AS holds FROM art")
def p6_evidence(spark, d):
    """Whether a sentence says nothing that its article does not: a number, a rule or words of its own make it fail."""
    rows = handbook(spark, d).where(F.col("record_type") == V.MAIN)
    kind = F.col("pos") % 6
    said = F.when(kind == 5, "비용은 77에 의한다.").when(kind == 2, "신청은 「다른 지침」에 따른다.").otherwise(F.element_at(F.split("body", "\n"), 1))
    proof = F.array(F.struct("rule_name", "article_no", "article_title", "body"))
    return rows.select("record_id", operations.evidence_holds(said, proof).alias("holds"))


# Annotations and personal data


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN true END AS undetermined FROM part")
def l11_clause_index(spark, d):
    """Whether a clause's mark was lost at the head of a line."""
    part = M.read(spark, d, "part")
    body = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("① 첫째\n? "), "p_name")).otherwise(F.concat(F.lit("① 첫째\n② "), "p_name"))
    rows = part.select(F.col("p_partkey").cast("long").alias("pos"), F.lit("지침").alias("rule_name"), F.lit("제1조").alias("article_no"), body.alias("body"), F.col("p_partkey").cast("string").alias("record_id"))
    return annotate.annotate(rows).select(F.col("pos").alias("p_partkey"), F.col("clause_index_undetermined").alias("undetermined"))


@query("WITH w AS (SELECT c_custkey, c_custkey % 3 AS k FROM customer) SELECT c_custkey, CASE k WHEN 0 THEN '연락 [전화번호 마스킹] 바람' WHEN 1 THEN '메일 [이메일 마스킹] 바람' ELSE '번호 [주민등록번호 마스킹] 바람' END AS masked, CASE k WHEN 0 THEN '전화번호' WHEN 1 THEN '이메일' ELSE '주민등록번호' END AS kinds, "
       "'개인정보 감지: ' || CASE k WHEN 0 THEN '전화번호' WHEN 1 THEN '이메일' ELSE '주민등록번호' END AS notice FROM w")  # fmt: skip
def p1_folded_personal_data(spark, d):
    """Full-width digits and letters are folded before they are searched; kinds are named in one line."""
    k = F.col("c_custkey")
    said = F.when(k % 3 == 0, "연락 ０１０－１２３４－５６７８ 바람").when(k % 3 == 1, "메일 ａｂｃ＠ｅｘａｍｐｌｅ．ｃｏｍ 바람").otherwise("번호 ９００１０１－１２３４５６７ 바람")
    rows = pii.mask(M.read(spark, d, "customer").select("c_custkey", said.alias("masked")), "masked")
    return rows.select("c_custkey", "masked", F.array_join("pii_kinds", ",").alias("kinds"), pii.notice(F.col("pii_kinds")).alias("notice"))


_NESTED = T.StructType([T.StructField("to", T.StringType()), T.StructField("all", T.ArrayType(T.StructType([T.StructField("call", T.StringType())]))), T.StructField("by", T.MapType(T.StringType(), T.StringType()))])


@query("SELECT c_custkey, '[이메일 마스킹]' AS one, '[전화번호 마스킹],' || c_custkey AS two, '[전화번호 마스킹]' AS three FROM customer")
def p4_nested_personal_data(spark, d):
    """The same in structs, arrays of structs and maps."""
    call = F.lit("０１０－１２３４－５６７８")
    value = F.struct(F.lit("ｂ＠ｃ．ｋｒ").alias("to"), F.array(F.struct(call.alias("call")), F.struct(F.col("c_custkey").cast("string").alias("call"))).alias("all"), F.create_map(F.lit("k"), call).alias("by"))
    got = M.read(spark, d, "customer").select("c_custkey", pii.redact_nested(value, _NESTED).alias("v"))
    return got.select("c_custkey", F.col("v.to").alias("one"), F.array_join(F.transform("v.all", lambda x: x["call"]), ",").alias("two"), F.col("v.by")["k"].alias("three"))


@query("WITH c AS (SELECT conv_id * 1000 + turn AS ts, text FROM conversations WHERE role = 'user') SELECT ts, sha256('[이메일 마스킹] ' || regexp_replace(text, '[0-9A-Za-z._%+-]+@[0-9A-Za-z.-]+\\.[A-Za-z]{2,}', '[이메일 마스킹]', 'g')) AS question FROM c WHERE NOT regexp_matches(text, '[0-9]')")
def a14_masked_log(spark, d):
    """Questions without digits, each with an address put before it, as the log keeps them."""
    log = M.log(spark, d).where(~F.col("question").rlike("[0-9]")).withColumn("question", F.concat(F.lit("ab@cd.kr "), "question"))
    return operations.masked_log(log).select("ts", F.sha2("question", 256).alias("question"))


# From texts to records


@query("SELECT CAST(p_partkey AS VARCHAR) AS source_key, CAST(0 AS BIGINT) AS place, '제1조' AS article_no, '목적' AS article_title, p_name || chr(10) || '제3조의 예에 따른다' AS body FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), 2, '제2조의2', '뜻', p_brand FROM part")
def e5_reassembled(spark, d):
    """An article cut at a mention is put together again; a branch that the split took for a body becomes one."""
    key = F.col("p_partkey").cast("string")
    row = lambda place, no, title, body: F.struct(F.lit(place).alias("place"), F.lit(no).alias("article_no"), F.lit(title).alias("article_title"), body.alias("body"))
    rows = F.array(row(0, "제1조", "목적", F.col("p_name")), row(1, "제3조", "", F.lit("의 예에 따른다")), row(2, "제2조", "", F.concat(F.lit("2(뜻) "), "p_brand")))
    parts = M.read(spark, d, "part").select(key.alias("source_key"), F.explode(rows).alias("r")).select("source_key", "r.*")
    return etl.reassemble(parts).select("source_key", F.col("place").cast("long").alias("place"), "article_no", "article_title", "body")


@query("SELECT CAST(p_partkey AS VARCHAR) AS source_key, CASE p_partkey % 5 WHEN 0 THEN '제목' WHEN 1 THEN '목차의 제목' WHEN 2 THEN '첫 줄' WHEN 3 THEN '신청서' ELSE '' END AS title, CASE p_partkey % 5 WHEN 0 THEN 'own' WHEN 1 THEN 'contents' WHEN 2 THEN 'first_line' WHEN 3 THEN 'table_header' END AS title_source, "
       "CASE p_partkey % 5 WHEN 0 THEN '제22조 ③' WHEN 1 THEN '제5조 제2항' END AS given FROM part")  # fmt: skip
def e16_filled_titles(spark, d):
    """Titles of attachments by priority, and the articles that delegate to them, if need be from the body's first line."""
    k, part = F.col("p_partkey") % 5, M.read(spark, d, "part")
    title = F.when(k == 0, "제목 (제22조 ③항의 관련)").otherwise("")
    body = F.when(k == 1, "표 (제5조제2항 관련)\n글").when(k == 2, "<p>\n첫 줄").when(k == 3, "<th></th><th><b>x</b></th><th> 신청서 </th>").when(k == 4, "<td>x</td>").otherwise("글 " * 60)
    rows = part.select(F.col("p_partkey").cast("string").alias("source_key"), F.lit("별표  1").alias("label"), title.alias("title"), body.alias("body"))
    toc = etl.contents_titles(part.where(k == 1).select(F.col("p_partkey").cast("string").alias("source_key"), F.lit("차례\n## [별표 1] 목차의 제목 ------- 27").alias("markdown")))
    got = etl.fill_titles(rows, toc)
    return got.select("source_key", "title", "title_source", F.concat_ws(" ", "delegating_article.article_no", "delegating_article.clause").alias("given")).withColumn("given", F.when(F.col("given") != "", F.col("given")))


@query("SELECT p_partkey, '제7조의2' AS article_no, '제3항' AS clause, p_name AS title FROM part")
def e17_delegations(spark, d):
    title, given = etl.strip_delegation(F.concat("p_name", F.lit(" (제07조의 2 제 3 항 관련)")))
    return M.read(spark, d, "part").select("p_partkey", given["article_no"].alias("article_no"), given["clause"].alias("clause"), title.alias("title"))


@query("SELECT CAST(p_partkey AS BIGINT) AS pos, CASE p_size % 3 WHEN 0 THEN '적용 범위' WHEN 1 THEN '' ELSE '시행일' END AS article_title, CASE p_size % 3 WHEN 0 THEN '본칙' ELSE '부칙' END AS record_type, CASE p_size % 3 WHEN 0 THEN p_brand WHEN 1 THEN '이 지침은 공포한 날부터 시행한다.' ELSE '글' END AS body FROM part")
def e15_record_types(spark, d):
    k = F.col("p_size") % 3
    title, body = F.when(k == 2, "시행일").otherwise(""), F.when(k == 0, F.concat(F.lit("적용 범위\n"), "p_brand")).when(k == 1, "이 지침은 공포한 날부터 시행한다.").otherwise("글")
    rows = M.read(spark, d, "part").select(F.col("p_partkey").cast("long").alias("pos"), title.alias("article_title"), body.alias("body"), F.lit(V.MAIN).alias("record_type"))
    return etl.normalize_types(rows).select("pos", "article_title", "record_type", "body")


@query("SELECT CAST(doc_id AS VARCHAR) AS source_key, source AS rule_name, '별표 1' AS article_no, '표' AS article_title, '별표' AS record_type FROM documents WHERE doc_id % 4 = 1")
def e9_enriched_attachments(spark, d):
    """Attachments take name and address of their source's first article; unknown sources are left out, present ones not added again."""
    articles = M.articles(spark, d)
    sheets = articles.where("pos % 2 = 1").select("source_key", F.lit("별표 1").alias("label"), F.lit("표").alias("title"), F.lit("x").alias("body"))
    sheets = sheets.unionByName(sheets.limit(1).withColumn("source_key", F.lit("없음")))
    have = articles.select("source_key", "article_no").unionByName(articles.where("pos % 4 = 3").select("source_key", F.lit("별표 1").alias("article_no")))
    added = etl.append_missing(have, etl.enrich_attachments(sheets, articles).select("source_key", "article_no", "rule_name", "article_title", "record_type"))
    return added.where("record_type is not null").select("source_key", "rule_name", "article_no", "article_title", "record_type")


@query("WITH f AS (SELECT * FROM part WHERE p_partkey % 3 <> 0 AND p_size % 4 <> 0) SELECT CAST(p_partkey AS VARCHAR) AS source_key, p_name AS rule_name, unnest(['1.', '2.', '3.']) AS article_no, '항목' AS record_type FROM f")
def e11_failed_items(spark, d):
    """Items of failed sources that no other way brought in, past editions left out."""
    part = M.read(spark, d, "part")
    key, name = F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 4 == 0, F.concat("p_name", F.lit(" (2012. 3. 1.)"))).otherwise(F.col("p_name"))
    failures = part.select(name.alias("rule_name"), key.alias("source_key"), F.col("p_brand").alias("division"))
    texts = part.select(key.alias("source_key"), F.concat(F.lit("1. 가\n글\n2. 나\n"), "p_type", F.lit("\n3. 다\n끝")).alias("markdown"))
    have = part.where("p_partkey % 3 = 0").select(key.alias("source_key"))
    return etl.failed_items(failures, have, texts).select("source_key", "rule_name", "article_no", "record_type")


@query("WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber AS n FROM lineitem), s AS (SELECT *, max(n) FILTER (n IN (1, 5)) OVER w AS ch, max(n) FILTER (n IN (3, 5)) OVER w AS se FROM l WINDOW w AS (PARTITION BY l_orderkey ORDER BY n)) "
       "SELECT count(*) AS n_articles, count(*) FILTER (n IN (1, 3, 5)) AS n_changed, count(*) FILTER (ch IS NOT NULL) AS n_chapter, count(*) FILTER (se = 3 AND n > 3) AS n_section FROM s")  # fmt: skip
def e13_structure_changes(spark, d):
    n = F.col("l_linenumber")
    body = F.when(n == 1, "제1장 총칙\n글").when(n == 3, "글\n제2절 뒤").when(n == 5, "제2장 학사\n글").otherwise("글")
    rows = M.read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n_rows"))
    rows = rows.select(F.col("l_orderkey").cast("string").alias("rule_name"), (F.col("l_orderkey") * 10 + n).alias("pos"), body.alias("body"))
    return etl.structure_changes(rows, etl.promote_structure(rows))


@query("SELECT CAST(doc_id AS VARCHAR) AS source_key, CASE WHEN doc_id % 2 = 0 THEN 'listed ' || doc_id ELSE source END AS rule_name, doc_id % 2 = 1 AND length(CAST(doc_id AS VARCHAR)) <= 6 AS gone FROM documents")
def e20_reconciled_names(spark, d):
    rows = M.articles(spark, d)
    listing = rows.where("pos % 2 = 0").select(F.col("source_key").alias("key"), F.concat(F.lit("listed "), "source_key").alias("name"))
    renamed, gone = etl.reconcile_names(rows, listing)
    return renamed.select("source_key", "rule_name").join(gone.withColumn("gone", F.lit(True)), "source_key", "left").select("source_key", "rule_name", F.coalesce("gone", F.lit(False)).alias("gone"))


@query("SELECT n_nationkey AS code, n_name || ' 유형 (보통)' AS head, CASE WHEN n_regionkey = 0 THEN '연결 규정: 해당 규정 미확인' ELSE 'r' || n_regionkey END AS tail FROM nation")
def c6_rendered(spark, d):
    """First and last line of the classifier's answer as text."""
    n = M.read(spark, d, "nation")
    cited = F.when(F.col("n_regionkey") > 0, F.array(F.concat(F.lit("r"), "n_regionkey"))).otherwise(F.array().cast("array<string>"))
    text = F.split(classify.render(F.col("n_name"), F.lit("유형"), F.lit("보통"), F.lit("쟁점"), F.array(F.lit("하나?"), F.lit("둘?")), cited), "\n")
    return n.select(F.col("n_nationkey").alias("code"), F.element_at(text, 1).alias("head"), F.element_at(text, -1).alias("tail"))
