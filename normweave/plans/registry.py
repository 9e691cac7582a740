"""Registered queries of the engine over the general tables; SQL of each that SQL can express is in `oracle`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import pii
from ..functions import text as X
from ..functions import values as V
from ..operators import annotate, classify, etl, gate, operations, references, search, temporal
from ..sources import html
from ..streaming import candidates as streams
from . import handbook
from . import mapping as M
from .oracle import SQL

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return _QUERIES | handbook.QUERIES


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if k in _QUERIES} | handbook.SQL


def _index(spark: SparkSession, d: str, articles: DataFrame | None = None) -> tuple[search.Index, DataFrame]:
    q = M.questions(spark, d)
    return search.build(M.articles(spark, d) if articles is None else articles, search.question_terms(q)), q


# Identity and the load gate


@query
def l2_identity(spark, d):
    rows = gate.prepare(M.articles(spark, d))
    return rows.select(F.col("pos").alias("doc_id"), "record_id", "revision")


@query
def l3_gate(spark, d):
    rows = M.articles(spark, d).withColumn("source_key", F.col("rule_name")).withColumn("article_no", F.lit("1"))
    return gate.gate(rows, hosts=None).select(F.col("pos").alias("doc_id"), F.coalesce("reason", F.lit("accepted")).alias("reason"))


@query
def l4_official_url(spark, d):
    p = M.read(spark, d, "pages")
    ok = gate.official_url(F.concat_ws("", F.substring_index("url", "#", 1)), F.lit("2"), {"example.com": "page", "example.net": "page"})
    return p.select("page_id", ok.alias("official"))


@query
def a12_rejects_by_reason(spark, d):
    rows = M.articles(spark, d).withColumn("source_key", F.col("rule_name")).withColumn("article_no", F.lit("1"))
    return operations.rejects_by_reason(gate.gate(rows, hosts=None))


@query
def l14_review_queue(spark, d):
    rows = M.articles(spark, d).withColumn("source_key", F.col("rule_name")).withColumn("article_no", F.lit("1"))
    return operations.review_queue(gate.rejected(gate.gate(rows, hosts=None))).select("row", "reason", "rule_name", "source_key")


# Annotations


def _versioned(spark, d):
    note = F.when(F.col("pos") % 3 == 0, " (2012. 1. 2. 개정)").when(F.col("pos") % 7 == 0, " (개정 전)").otherwise("")
    number = F.concat(F.lit("제"), (F.col("pos") % 50).cast("string"), F.lit("조"))
    body = F.concat(F.when(F.col("pos") % 11 == 0, "<삭제 2013. 7. 5.> ").otherwise(""), F.lit("① "), F.col("body"), F.when(F.col("pos") % 2 == 0, "\n② 삭제 <2020. 6. 3.>\n3. (삭제) <개정 2024. 3. 22.>").otherwise("\n③ (삭제)\n7. 삭제 <2021. 1. 2.>"))
    rows = M.articles(spark, d).withColumn("rule_name", F.concat("rule_name", note)).withColumn("article_no", number).withColumn("body", body)
    return gate.prepare(rows)


@query
def l5_versions(spark, d):
    rows = annotate.annotate(_versioned(spark, d))
    return rows.select(F.col("pos").alias("doc_id"), "is_current", F.col("superseded_by").isNotNull().alias("has_successor"), "is_repealed", "repealed_date")


@query
def l8_repealed_parts(spark, d):
    rows = annotate.annotate(_versioned(spark, d))
    clause = F.try_element_at("repealed_clauses", F.lit(1))
    item = F.try_element_at("repealed_items", F.lit(1))
    return rows.select(F.col("pos").alias("doc_id"), clause["clause"].alias("clause"), clause["repealed_date"].alias("clause_date"), item["clause"].alias("item_clause"), item["item"].alias("item"), item["repealed_date"].alias("item_date"))


@query
def l10_damage(spark, d):
    rows = M.articles(spark, d).select("pos", F.replace("body", F.lit(", "), F.lit("?")).alias("body"))
    got = annotate.text_integrity(F.col("body"))
    return rows.select(F.col("pos").alias("doc_id"), got.alias("t")).where("t is not null").select("doc_id", "t.suspect_marks", F.array_join("t.kinds", ",").alias("kinds"))


@query
def a18_damage_inventory(spark, d):
    rows = M.articles(spark, d).withColumn("text_integrity", annotate.text_integrity(F.replace("body", F.lit(", "), F.lit("?"))))
    return operations.damage_inventory(rows)


# Words, index, search


@query
def t1_words(spark, d):
    words = M.read(spark, d, "documents").select(F.explode(X.words(F.col("text"))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query
def t4_query_words(spark, d):
    return M.questions(spark, d).select("query_id", F.posexplode(X.query_words(F.col("query"))).alias("place", "word"))


@query
def t6_normal_questions(spark, d):
    return M.log(spark, d).select("ts", X.normal_question(F.col("question")).alias("normalized"))


@query
def a1_term_statistics(spark, d):
    index = search.build(M.articles(spark, d))
    return index.stats.select("term", "df")


@query
def a1_lengths(spark, d):
    return search.build(M.articles(spark, d)).lengths.select("doc_id", F.col("length").cast("long").alias("length"))


@query
def a2_rule_profiles(spark, d):
    return search.profiles(M.articles(spark, d))


@query
def r1_idf(spark, d):
    index, q = _index(spark, d)
    known = search.known_terms(index, search.question_terms(q))
    return known.select("query_id", "term", "qf", F.round("idf", 4).alias("idf"))


@query
def r2_routes(spark, d):
    index, q = _index(spark, d)
    return search.route(index, search.known_terms(index, search.question_terms(q)))


@query
def r3_top5_documents(spark, d):
    """The flagship: five best documents for each benchmark item by term weights alone."""
    index, q = _index(spark, d)
    rows = search.score(index, q, boosts=False).select("query_id", "doc_id", F.round("score", 4).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return rows.withColumn("rank", rank.cast("long")).where("rank <= 5").select("query_id", "rank", "doc_id", "score")


def _ranked(spark, d, kinds: bool = False):
    rows = M.articles(spark, d)
    if kinds:
        rows = rows.withColumn("record_type", F.when(F.col("pos") % 4 == 0, V.ATTACHMENT).otherwise(V.MAIN))
    index, q = _index(spark, d, rows)
    return search.ranked(index, q)


@query
def r6_search(spark, d):
    results, _ = search.attachment_gate(_ranked(spark, d))
    return results.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score", "routing", F.array_join("matched_terms", " ").alias("matched"))


@query
def r7_attachment_gate(spark, d):
    results, omitted = search.attachment_gate(_ranked(spark, d, True))
    part = lambda rows, name: rows.select("query_id", "doc_id", F.lit(name).alias("part"))
    return part(results, "result").unionByName(part(omitted, "omitted"))


@query
def r9_hints(spark, d):
    index, q = _index(spark, d)
    results, _ = search.attachment_gate(search.ranked(index, q))
    return search.hints(results, q, search.unmatched_words(index, q))


@query
def t7_unmatched_words(spark, d):
    index, q = _index(spark, d)
    return search.unmatched_words(index, q).select("query_id", "word")


@query
def f7_attachment_summary(spark, d):
    rows = M.articles(spark, d).withColumn("record_type", F.lit(V.ATTACHMENT)).withColumn("body", F.concat(F.lit("<table><tr>"), "body"))
    return search.summarize_attachment(rows).select(F.col("pos").alias("doc_id"), "body", "body_cut", F.col("body_length").cast("long").alias("body_length"), F.col("n_tables").cast("long").alias("n_tables"), F.col("n_rows").cast("long").alias("n_rows"))


@query
def f9_citations(spark, d):
    return M.articles(spark, d).select(F.col("pos").alias("doc_id"), F.sha2(search.citation(F.col("rule_name"), F.col("article_no"), F.col("article_title"), F.col("body"), F.col("source_url")), 256).alias("cited"))


# Operations


@query
def a3_corpus_stats(spark, d):
    return operations.corpus_stats(gate.gate(M.articles(spark, d), hosts=None))


@query
def a4_rules_list(spark, d):
    return operations.rules_list(M.articles(spark, d))


def _coverage(spark, d):
    return operations.coverage(M.listing(spark, d), M.read(spark, d, "labels").select(F.col("doc_id").alias("key")))


@query
def a5_coverage(spark, d):
    return _coverage(spark, d).select("division", "posted", "collected", "rate", "current_posted", "current_collected", "current_rate", F.sha2(F.array_join("missing", ","), 256).alias("missing"))


@query
def a6_coverage_gaps(spark, d):
    return operations.coverage_gaps(_coverage(spark, d))


@query
def j11_not_collected(spark, d):
    posted = M.listing(spark, d)
    return etl.to_collect(posted, M.read(spark, d, "labels").select(F.col("doc_id").alias("key"))).select("key")


@query
def a7_distribution(spark, d):
    return operations.histogram(M.articles(spark, d), "division")


@query
def a8_duplicate_titles(spark, d):
    return operations.duplicate_titles(M.articles(spark, d)).select("rule_name", "article_title", "n", F.array_join("numbers", ",").alias("numbers"))


@query
def a10_candidates(spark, d):
    return operations.candidates(M.log(spark, d)).select("normalized_question", "question", "asked_count", "created_at", "updated_at", "status")


@query
def a11_sequence_ids(spark, d):
    from ..functions.frames import number

    log = number(M.log(spark, d), [F.col("ts")], "place")
    return log.select("ts", operations.sequence_id(F.col("place"), "q").alias("id"))


@query
def a16_contents_counts(spark, d):
    kind = F.when(F.col("pos") % 5 == 0, V.ADDENDUM).otherwise(V.MAIN)
    return operations.contents_counts(M.articles(spark, d).withColumn("record_type", kind))


@query
def a20_failures(spark, d):
    rows = M.read(spark, d, "events").where("event_type = 'error'").select(F.concat(F.lit("timeout of user "), F.col("user_id").cast("string")).alias("error"))
    return operations.failures_by_error(rows)


@query
def r12_contents(spark, d):
    number = F.concat(F.lit("제"), (F.col("pos") % 37).cast("string"), F.lit("조"), F.when(F.col("pos") % 2 == 0, F.concat(F.lit("의"), (F.col("pos") % 5).cast("string"))).otherwise(""))
    kind = F.when(F.col("pos") % 9 == 0, V.ADDENDUM).otherwise(V.MAIN)
    rows = operations.contents(M.articles(spark, d).withColumn("article_no", number).withColumn("record_type", kind))
    return rows.select("rule_name", F.col("rank").cast("long").alias("rank"), F.col("pos").alias("doc_id"))


@query
def r16_recent(spark, d):
    return operations.recent(M.log(spark, d), 20).select("ts", "question")


@query
def r15_candidate_order(spark, d):
    """The twenty most asked candidates."""
    return operations.candidate_order(operations.candidates(M.log(spark, d)), limit=20).select("normalized_question", "asked_count", "created_at")


@query
def j10_trusted_sources(spark, d):
    catalogue = M.articles(spark, d).select(F.concat(F.lit("doc-"), "article_no").alias("record_id"), "rule_name", "division")
    ids = F.array(*[F.concat(F.lit("doc-"), (F.col("ts") % 700 * i).cast("string")) for i in (1, 2, 3)])
    log = M.log(spark, d).select(F.col("ts").alias("id"), F.array_distinct(ids).alias("source_ids"))
    got = operations.trusted_sources(log, catalogue, ["rule_name", "division"])
    return got.select("id", F.array_join(F.transform("sources", lambda s: F.concat_ws("/", s["record_id"], s["rule_name"], s["division"])), ",").alias("sources"))


@query
def l13_ledger(spark, d):
    """Fingerprints of sources, appended twice: the second time adds nothing."""
    rows = M.articles(spark, d).groupBy("rule_name").agg(F.count(F.lit(1)).alias("accepted"))
    entry = rows.select(F.substring(F.sha2("rule_name", 256), 1, 16).alias("corpus_fingerprint"), "accepted")
    return operations.append_ledger(operations.append_ledger(None, entry), entry)


# Versions


@query
def e21_validity(spark, d):
    return temporal.assign_validity(M.versions(spark, d)).select("rule_name", "place", "valid_from", "valid_until")


@query
def j9_as_of(spark, d):
    found = temporal.as_of(temporal.assign_validity(M.versions(spark, d)), M.probes(spark, d))
    return found.select("probe_id", "rule_name", "date", F.col("version.place").alias("place"), F.col("version.valid_from").alias("valid_from"), F.col("version.valid_until").alias("valid_until"))


@query
def v1_resolve_names(spark, d):
    n, r = M.read(spark, d, "nation"), M.read(spark, d, "region")
    names = n.select(F.concat(F.lower("n_name"), F.lit(" rule")).alias("rule_name"), F.col("n_nationkey").alias("place"))
    asked = n.select(F.col("n_nationkey").alias("query_id"), F.concat(F.lit("what does "), F.lower("n_name"), F.lit(" rule say")).alias("text"))
    asked = asked.unionByName(r.select((F.col("r_regionkey") + 100).alias("query_id"), F.concat(F.lit("nation_"), F.col("r_regionkey")).alias("text")))
    return temporal.resolve_names(asked, names).select("query_id", "rule_name")


@query
def e22_revision_dates(spark, d):
    label = F.concat(F.lit("지침("), F.date_format("o_orderdate", "yyyy. M. d."), F.lit(" 개정)"))
    return M.read(spark, d, "orders").select("o_orderkey", temporal.revision_date(label).alias("revised_on"))


# References


def _edges(spark, d):
    articles = M.referring(spark, d)
    return articles, references.outbound(articles)


@query
def g4_edges(spark, d):
    _, edges = _edges(spark, d)
    return edges.select("src_id", "kind", "raw", "target_rule", "target_article", "resolved", "dst_id")


@query
def g9_inbound(spark, d):
    articles, edges = _edges(spark, d)
    return references.inbound(edges, articles).groupBy("record_id").agg(F.count(F.lit(1)).alias("n"))


@query
def g11_reachable(spark, d):
    articles, edges = _edges(spark, d)
    hits = articles.select(F.col("pos").alias("query_id"), "record_id")
    return references.reachable(hits, edges)


# Classifier


def _categories(spark, d):
    words = [("INT-01", "the edition", ["and", "of the"], ["tionan"]), ("INT-02", "der einung", ["und die", "erheit"], ["der"]), ("INT-03", "le mentre", ["et les", "éreoi"], ["la"])]
    rows = [(i, c, n, f"{n} issue", [f"{n}?"], div, key, "x") for i, (c, n, key, div) in enumerate(words)]
    cats = spark.createDataFrame(rows, "place int, code string, name string, typical_issue string, selfcheck array<string>, divisions array<string>, keywords array<string>, risk string")
    return classify.category_table(cats, spark.createDataFrame([], "code string, text string"), {})


@query
def c2_scores(spark, d):
    asked = M.read(spark, d, "documents").select(F.col("doc_id").alias("query_id"), "text")
    return classify.scores(asked, _categories(spark, d)).select("query_id", "code", "score", F.array_join("exact", " ").alias("exact"), F.col("phrase_hits").cast("long").alias("phrase_hits"))


@query
def c3_decisions(spark, d):
    asked = M.read(spark, d, "documents").select(F.col("doc_id").alias("query_id"), "text")
    return classify.decide(classify.scores(asked, _categories(spark, d))).select("query_id", "code", "score", "confidence", "matched")


# Personal data


@query
def p3_redact_email(spark, d):
    found = pii.redact(F.col("text"), [p for p in V.PERSONAL if p[0] == "이메일"])
    return M.read(spark, d, "documents").select("doc_id", F.sha2(found[0], 256).alias("masked"), F.size(found[1]).cast("long").alias("n_kinds"))


@query
def p2_personal_data(spark, d):
    rows = pii.mask(M.read(spark, d, "documents").select("doc_id", "text"), "text")
    return rows.where(F.size("pii_kinds") > 0).select("doc_id", F.array_join("pii_kinds", ",").alias("kinds"), F.sha2("text", 256).alias("masked"))


# Texts and listings


def _markdown(spark, d):
    part = M.read(spark, d, "part")
    text = F.concat(F.lit("머리말\n## 제1조("), "p_name", F.lit(") "), "p_brand", F.lit("\n둘째 줄\n제2조의3【"), "p_type", F.lit("】 끝\n부칙\n제9조 시행"))
    return part.select(F.col("p_partkey").cast("string").alias("source_key"), text.alias("markdown"))


@query
def e1_split_articles(spark, d):
    docs = _markdown(spark, d).withColumn("markdown", etl.cut_addendum(F.col("markdown")))
    return etl.split_articles(docs).select("source_key", F.col("place").cast("long").alias("place"), "article_no", "article_title", "body")


@query
def e10_items(spark, d):
    part = M.read(spark, d, "part")
    text = F.concat(F.lit("1. "), "p_name", F.lit("\n가\n5. x\n2. "), "p_type", F.lit("\n나\n3. "), "p_brand", F.lit("\n다"))
    docs = part.select(F.col("p_partkey").cast("string").alias("source_key"), text.alias("markdown"))
    return etl.extract_items(docs).select("source_key", "article_no", "article_title", "body")


@query
def e7_attachments(spark, d):
    part = M.read(spark, d, "part")
    text = F.concat(F.lit("[별표 1] "), "p_name", F.lit(" ..... 3\n[별표1] "), "p_type", F.lit(" <개정 2020. 1. 1.>\n긴 본문 "), "p_name", F.lit("\n【별표 1】\n짧다\n[별표 2] 서식\n"), "p_brand")
    docs = part.select(F.col("p_partkey").cast("string").alias("source_key"), text.alias("markdown"))
    return etl.extract_attachments(docs).select("source_key", "label", "title", "body")


@query
def e12_structure(spark, d):
    n = F.col("l_linenumber")
    body = F.when(n == 1, "제1장 총칙\n글").when(n == 3, "글\n제2절 뒤").when(n == 5, "제2장 학사\n글").otherwise("글")
    rows = M.read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n_rows"))
    rows = rows.select(F.col("l_orderkey").cast("string").alias("rule_name"), (F.col("l_orderkey") * 10 + n).alias("pos"), body.alias("body"))
    return etl.promote_structure(rows).select("rule_name", "pos", "chapter", "section", "body")


@query
def e18_core_listing(spark, d):
    """Forty rules to collect first, out of one for each part."""
    part = M.read(spark, d, "part")
    area = F.element_at(F.array(*[F.lit(a[0]) for a in V.CORE_DOMAINS]), (F.col("p_size") % 8 + 1).cast("int"))
    rows = part.select(F.concat(area, F.lit(" "), "p_name", F.lit(" 지침 "), F.col("p_partkey").cast("string")).alias("name"), F.col("p_partkey").cast("string").alias("key"), F.col("p_brand").alias("division"), F.lit("u").alias("source_url"))
    return etl.select_core(rows, 40).select("key", "score", F.col("place").cast("long").alias("place"))


@query
def e3_clean_names(spark, d):
    raw = F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(") "), "p_name", F.lit("  규정 (현행)"))
    return M.read(spark, d, "part").select("p_partkey", etl.clean_name(raw).alias("name"))


@query
def e4_keys(spark, d):
    p = M.read(spark, d, "pages")
    return p.select("page_id", etl.extract_key(F.replace("url", F.lit("page="), F.lit("key="))).alias("key"))


@query
def s9_html_text(spark, d):
    text = html.html_to_text(F.col("html"))
    return M.read(spark, d, "pages").select("page_id", F.length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("sha"))


@query
def s5_links(spark, d):
    """A listing made of each page's address: one folder, one link, found again."""
    page = F.concat(F.lit('<ul id="treeData"><li><a href="#none">1. 학생 (현행)</a><ul><li><a href="/x?mode=file&amp;key='), F.col("page_id").cast("string"), F.lit('">2) 이름 지침</a></li></ul></li></ul>'))
    docs = M.read(spark, d, "pages").select(F.col("page_id").alias("doc"), page.alias("html"))
    return html.listing(docs).select("doc", "key", "name", "division")


# Sets and streams


@query
def set_operations(spark, d):
    """Documents with labels, without, and both counted."""
    docs, marks = M.read(spark, d, "documents").select("doc_id"), M.read(spark, d, "labels").select("doc_id")
    part = lambda rows, name: rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    return part(docs.join(marks, "doc_id", "left_semi"), "both").unionByName(part(docs.join(marks, "doc_id", "left_anti"), "only")).unionByName(part(docs.union(marks).distinct(), "all"))


@query
def windowed_events(spark, d):
    return streams.windowed_counts(M.read(spark, d, "events")).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))
