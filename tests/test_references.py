import pytest
from pyspark.sql import functions as F

from normweave.functions.mentions import find
from normweave.operators import annotate, gate, references as R
from tests.fixtures import CORPUS, article, table

MORE = [
    article(20, "전남대학교 학칙", "규정집/학칙", "제5조", "학기", "① 첫 학기는 3월에 시작한다.\n② 삭제 <2020. 1. 1.>", "2200000000001", "https://law.go.kr/x?schlPubRulSeq=2200000000001"),
    article(21, "전남대학교 학칙", "규정집/학칙", "제6조", "준용", "학칙 제5조제2항과 제5조 및 제99조에 따른다. 별표 3과 별표 3을 본다.", "2200000000001", "https://law.go.kr/x?schlPubRulSeq=2200000000001"),
    article(22, "시험 지침", "학사", "제1조", "여러 가지", "평가방법 제3조를 본다. 「없는 이름」 제2조. 고등교육법 제10조. 「전남대학교 학칙」에 의한다. ‘등록금에 관한 규칙’을 따르고 전남대학교학칙 제5조제1항 각 호를 본다. 「민법」에 의한다.", "105"),
    article(23, "시험 지침", "학사", "제2조", "위임", "① 위원회를 둔다.② 총장이 따로 정한다.\n③ 제5조에서 따로 정한다.", "105"),
]


@pytest.fixture(scope="module")
def graph(spark):
    articles = annotate.annotate(gate.accepted(gate.gate(table(spark, CORPUS + MORE)))).cache()
    return articles, R.outbound(articles).cache()


def edges_of(graph, pos):
    articles, edges = graph
    src = articles.where(F.col("pos") == pos).first().record_id
    return [r for r in edges.where(F.col("src_id") == src).orderBy("place").collect()]


def test_kinds(graph):
    articles, _ = graph
    ids = {r.pos: r.record_id for r in articles.collect()}
    got = {(e.kind, e.raw): e for e in edges_of(graph, 2)}
    assert got["attachment", "별표 1"].dst_id == ids[3]
    assert got["repealed_clause", "제2조제2항"].resolved is False
    assert ("external_law", "｢개인정보 보호법｣ 제5조") in got
    money = edges_of(graph, 5)
    assert [(e.kind, e.dst_id) for e in money] == [("cross_rule", ids[1])]
    own = {(e.kind, e.raw) for e in edges_of(graph, 21)}
    assert ("repealed_clause", "학칙 제5조제2항") in own and ("same_rule", "제5조") in own and ("attachment_not_collected", "별표 3") in own
    missing = [e for e in edges_of(graph, 21) if e.raw == "제99조"]
    assert [e.reason_code for e in missing] == ["no_record"]
    assert [e.reason_code for e in edges_of(graph, 21) if e.kind == "attachment_not_collected"] == ["image_only"]


def test_names(graph):
    got = [(e.kind, e.raw) for e in edges_of(graph, 22)]
    assert ("external_law_unmatched", "「없는 이름」 제2조") in got and ("external_law", "고등교육법 제10조") in got
    assert ("rule_level", "「전남대학교 학칙」") in got and ("external_rule_unmatched", "‘등록금에 관한 규칙’") in got and ("external_law", "「민법」") in got
    cross = [e for e in edges_of(graph, 22) if e.kind == "cross_rule"]
    assert [(e.target_rule, e.target_article, e.target_clause) for e in cross] == [("전남대학교 학칙", "제5조", "제1항 각 호")]
    assert not any(r.startswith("평가방법") for _, r in got)


def test_delegations(graph):
    (one,) = [e for e in edges_of(graph, 23) if e.kind == "unnamed_delegation"]
    assert (one.clause, one.delegate) == ("②", None) or one.delegate == "총장"
    assert [m["type"] for m in find("제5조에서 따로 정한다.")] == ["article"]


def test_inbound_mirrors_resolved_edges(graph):
    articles, edges = graph
    back = R.inbound(edges, articles)
    assert back.count() == edges.where("resolved").count() > 0
    wanted = articles.where("pos = 1").select("record_id")
    both = R.related(edges, articles, wanted).collect()
    assert {r.direction for r in both} == {"inbound", "outbound"}
    hits = articles.where("pos = 5").select(F.lit(0).alias("query_id"), "record_id")
    assert R.reachable(hits, edges).count() == 2
    unresolved = edges.where("not resolved and kind != 'rule_level'")
    assert unresolved.where("reason is null").count() == 0


def test_kinds_of_one_lookup_share_a_branch(graph):
    """Attachments, delegations, rules as a whole, articles outside and inside: looking names up for each kind took 18 lookups, not 8."""
    articles, _ = graph
    assert R.outbound(articles)._jdf.queryExecution().analyzed().toString().count("AS __alias") <= 8


def test_mentions_of_all_types_share_one_plan(spark):
    """A branch for each type took 11 joins, 8 of them broadcast, and 5 windows, and its plan the driver's memory."""
    articles = table(spark, CORPUS + MORE).withColumn("record_id", F.concat(F.lit("r"), "pos"))
    plan = R.outbound(articles)._jdf.queryExecution().optimizedPlan().toString()
    # Spellings to aliases, names to mentions, numbers to records.
    assert (plan.count("Join "), plan.count("Window ["), plan.count("broadcast")) == (3, 1, 0)
