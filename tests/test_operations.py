import json

import pytest
from pyspark.sql import functions as F

from normweave.functions import pii
from normweave.functions.frames import keep_first, number
from normweave.operators import annotate, classify, gate, operations as O, search, temporal
from normweave.operators import etl, refresh
from normweave.plans.api import Engine
from normweave.sources import corpus, html, sinks
from normweave.streaming import candidates as streams
from tests.fixtures import CORPUS, table


def versions(spark):
    rows = [("학칙", 0, "2010-03-01"), ("학칙", 1, "2015-03-01"), ("학칙", 2, None), ("학칙 시행세칙", 0, None)]
    base = temporal.assign_validity(spark.createDataFrame(rows, "rule_name string, place int, revised_on string"))
    texts = F.array(F.struct(F.lit("제1조").alias("article_no"), F.lit("목적").alias("article_title"), F.concat(F.lit("판 "), "place").alias("body")))
    return base.select("rule_name", "place", F.col("place").cast("string").alias("key"), F.concat(F.lit("판 "), "place").alias("label"), "valid_from", "valid_until", F.lit("u").alias("source_url"), texts.alias("articles"))


def test_as_of(spark):
    probes = spark.createDataFrame([(i, "학칙", d) for i, d in enumerate(["2009-01-01", "2010-03-01", "2015-02-28", "2015-03-01", "2015-99-99"])] + [(9, "없음", "2020-01-01")], "probe_id int, rule_name string, date string")
    got = {r.probe_id: r.version and r.version.place for r in temporal.as_of(versions(spark), probes).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 2, 4: 2, 9: None}


def test_names(spark):
    names = spark.createDataFrame([("학칙", 0), ("학칙 시행세칙", 1), ("도서관 규정", 2), ("도서관 지침", 3)], "rule_name string, place int")
    asked = spark.createDataFrame([(0, "학칙 시행세칙 제3조"), (1, "시행세칙"), (2, "도서관"), (3, "규정 절차"), (4, ""), (5, None)], "query_id int, text string")
    got = {r.query_id: r.rule_name for r in temporal.resolve_names(asked, names).collect()}
    assert got == {0: "학칙 시행세칙", 1: "학칙 시행세칙", 2: None, 3: None, 4: None, 5: None}


def test_personal_data(spark):
    texts = ["전화 ０１０-1234-5678", "+82 (10) 1234-5678", "a.b@example.com 그리고 900101-1234567", "계좌번호: 110-123-456789", "경기도 수원시 영통구로 12", "학번 20201234", "아무것도 없음", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = pii.mask(df, "t").orderBy("i").collect()
    assert got[0].pii_kinds == ["전화번호"] and got[0].t == "전화 [전화번호 마스킹]" and got[1].pii_kinds == ["전화번호"]
    assert got[2].pii_kinds == ["주민등록번호", "이메일"] and got[3].pii_kinds[0] in ("전화번호", "계좌번호")
    assert got[5].pii_kinds == ["학번추정"] and got[6].pii_kinds == [] and got[7].t is None
    nested = spark.createDataFrame([({"a": ["x@example.com"]},)], "m map<string,array<string>>")
    safe = nested.select(pii.redact_nested(F.col("m"), nested.schema["m"].dataType).alias("m")).first().m
    assert safe == {"a": ["[이메일 마스킹]"]}


def test_candidates_and_log(spark, tmp_path):
    rows = [(1, "대출 기한은? 010-1111-2222", "", False), (2, "대출  기한은? 010-3333-4444", "", False), (3, "답한 질문", "답", True)]
    log = O.masked_log(spark.createDataFrame(rows, "ts long, question string, response string, answered boolean"))
    (one,) = O.candidates(log).collect()
    assert [x.count() for x in O.capture(spark.createDataFrame(rows, "ts long, question string, response string, answered boolean"))] == [3, 1]
    assert one.asked_count == 2 and "010" not in one.question and one.created_at == 1 and one.updated_at == 2
    assert O.recent(log, 0).count() == 0 and [r.ts for r in O.recent(log, 2).collect()] == [3, 2]
    src = str(tmp_path / "log")
    spark.createDataFrame(rows, "ts long, question string, response string, answered boolean").write.json(src)
    stream = spark.readStream.schema("ts long, question string, response string, answered boolean").json(src)
    streams.start_candidates(stream, "asked", str(tmp_path / "ckpt")).awaitTermination()
    assert [r.asked_count for r in spark.table("asked").collect()] == [2]


def test_coverage(spark):
    posted = spark.createDataFrame([("1", "가", "학생", True), ("2", "나", "학생", True), ("3", "다", "연구", False)], "key string, name string, division string, is_current boolean")
    got = {r.division: r for r in O.coverage(posted, posted.where("key = '1'").select("key")).collect()}
    assert (got["학생"].rate, got["학생"].missing, got["연구"].current_rate, got[None].rate) == (0.5, ["나"], None, 0.3333)
    assert [r.gap for r in O.coverage_gaps(O.coverage(posted, posted.where("key = '1'").select("key"))).collect()] == ["학생: 1 / 2"]


def test_generated_text(spark):
    article = [("도서관 지침", "제2조", "대출", "학생은 도서 10 권을 빌릴 수 있다")]
    cases = [("학생은 도서 10 권을 빌릴 수 있다.", True), ("학생은 도서 11 권을 빌릴 수 있다.", False), ("제3조에 따라 학생은 도서를 빌릴 수 있다.", False), ("우주 정거장 규정을 본다.", False), ("", False), (None, False)]
    df = spark.createDataFrame([(i, t, article) for i, (t, _) in enumerate(cases)], "i int, t string, a array<struct<rule_name:string,article_no:string,article_title:string,body:string>>")
    assert [r.ok for r in df.select("i", O.evidence_holds(F.col("t"), F.col("a")).alias("ok")).orderBy("i").collect()] == [ok for _, ok in cases]


@pytest.fixture(scope="module")
def categories_file(tmp_path_factory):
    cats = [
        {"code": c, "name": f"유형 {i}", "typical_issue": f"지적 {i}", "selfcheck": ["확인했는가"], "rule_anchor": {"편제": ["학생"], "keywords": ["대출 권수", "연체"] if i == 0 else [f"없는말{i}"]}, "law_ref": [], "risk": "중"}
        for i, c in enumerate(corpus.CODES)
    ]
    path = tmp_path_factory.mktemp("c") / "categories.json"
    path.write_text(json.dumps({"data_manifest": {"classification": "synthetic"}, "categories": cats, "demo_scenarios": [{"user_input_example": "도서 연체 대출 정지", "matched_category": "INT-01", "expected_response": "x"}]}, ensure_ascii=False))
    return str(path)


def test_classifier(spark, categories_file):
    cats, scenarios = corpus.read_categories(spark, categories_file)
    table_ = classify.category_table(cats, scenarios)
    asked = spark.createDataFrame([(0, "도서 연체로 대출 정지 상태"), (1, "연체"), (2, "우주 여행"), (3, None)], "query_id int, text string")
    decided = classify.decide(classify.scores(asked, table_))
    got = {r.query_id: (r.code, r.matched) for r in decided.collect()}
    assert got[0] == ("INT-01", True) and not got[1][1] and not got[2][1] and not got[3][1]
    index = search.build(annotate.annotate(gate.accepted(gate.gate(table(spark, CORPUS)))).cache())
    linked = classify.linked_articles(decided, table_, index).orderBy("rank").collect()
    assert linked and linked[0].query_id == 0 and linked[0].rank == 1


def test_sources(spark, tmp_path, categories_file):
    rows = [dict(zip(["규정명", "편제", "조문번호", "조문제목", "본문", "source_key", "source_url"], ["가 지침", "학생", f"제{i}조", "", "글", "1", "u"])) for i in range(3)]
    path = tmp_path / "corpus.json"
    path.write_text(json.dumps(rows, ensure_ascii=False))
    got = corpus.read_articles(spark, str(path)).orderBy("pos").collect()
    assert [(r.pos, r.article_no) for r in got] == [(0, "제0조"), (1, "제1조"), (2, "제2조")]
    assert corpus.first_existing(spark, str(tmp_path / "no"), str(path)) == str(path)
    path.write_text("not json")
    with pytest.raises(ValueError):
        corpus.read_articles(spark, str(path))
    assert corpus.read_lineage(spark, str(tmp_path / "none.json")).count() == 0
    path.write_text(json.dumps({"학칙": [{"key": "1", "label": "현행", "valid_from": None, "valid_until": None, "source_url": "u", "articles": [{"조문번호": "제1조", "조문제목": "목적", "본문": "글"}]}]}, ensure_ascii=False))
    assert corpus.read_lineage(spark, str(path)).first().articles[0].article_no == "제1조"
    bad = json.loads(open(categories_file).read())
    bad["categories"][0]["name"] = "010-1234-5678"
    path.write_text(json.dumps(bad, ensure_ascii=False))
    with pytest.raises(ValueError):
        corpus.read_categories(spark, str(path))


def test_html(spark):
    page = '<ul id="treeData"><li><a href="#none">1. 학생처</a><ul><li><a href="/f?mode=file&amp;key=12">3) 장학 지침 (현행)</a></li><li><a href="#" onclick="get(\'/f?mode=file&key=13\')">수업  지침(2012. 3. 4. 개정)</a></li><li><a href="/f?mode=file&key=12">again</a></li></ul></li></ul>'
    docs = spark.createDataFrame([(1, page)], "doc int, html string")
    got = html.listing(docs).orderBy("place").collect()
    assert [(r.key, r.name, r.division) for r in got] == [("12", "장학 지침", "학생처"), ("13", "수업 지침(2012. 3. 4. 개정)", "학생처")]
    assert [(r.key, r.revised_on) for r in html.version_links(docs, "수업").collect()] == [("13", "2012-03-04")]
    text = spark.createDataFrame([("<p>a &lt;td&gt; b</p><script>x</script>\n-\n<b>다</b> &amp; 라",)], "h string").select(html.html_to_text(F.col("h")).alias("t")).first().t
    assert text == "a\nb\n다\n& 라"


def test_sinks(spark, tmp_path):
    at = str(tmp_path / "t")
    sinks.replace_table(spark.range(3), at)
    with pytest.raises(ValueError):
        sinks.replace_table(spark.range(5), at, check=lambda d: False)
    assert spark.read.parquet(at).count() == 3
    sinks.replace_table(spark.range(4), at, check=lambda d: d.count() == 4)
    assert spark.read.parquet(at).count() == 4
    store = tmp_path / "s.json"
    store.write_text('{"a": 1}\n{broken\n')
    with pytest.raises(ValueError):
        sinks.read_store(spark, str(store), "a int")
    assert store.read_text().startswith('{"a": 1}') and any(".corrupt-" in p.name for p in tmp_path.iterdir())
    assert sinks.read_store(spark, str(tmp_path / "none"), "a int").count() == 0
    page = sinks.dashboard("<t>", {"x": spark.createDataFrame([("<script>",)], "a string")})
    assert "<script>" not in page and "&lt;script&gt;" in page


def test_frames(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(50)], "k int, v int")
    assert [r.pos for r in number(df, [F.col("v")]).orderBy("v").collect()] == list(range(50))
    assert sorted(tuple(r) for r in keep_first(df, ["k"], [F.desc("v")] and [F.col("v")]).collect()) == [(0, 0), (1, 1), (2, 2)]


def test_api(spark):
    engine = Engine(table(spark, CORPUS), versions(spark))
    assert [engine.search_rule("대출", k=k)["field"] for k in (0, 21, "3", 1.5, True)] == ["k"] * 5
    assert engine.search_rule("가" * 501) == {"status": "invalid_argument", "field": "query"}
    found = engine.search_rule("대출 권수")
    assert found["status"] == "ok" and found["results"][0]["article_no"] == "제2조"
    none = engine.search_rule("우주 정거장")
    assert none["status"] == "not_found" and none["hint"]["kind"] == "no_such_concept"
    got = engine.get_article("도서관 이용 지침", "제 2 조")
    assert got["article"]["article_title"] == "대출 권수"
    assert engine.get_article_as_of("학칙", "2015.1.1")["field"] == "date"
    assert engine.get_article_as_of("학칙 규정", "2012-01-01")["label"] == "판 1"
    assert engine.get_article_as_of("우주", "2012-01-01")["known_rules"] == ["학칙", "학칙 시행세칙"]
    assert {r["rule_name"] for r in engine.list_rules()["rules"]} == {"도서관 이용 지침", "장학금 지급 지침", "연구실 안전 지침"}
    contents = engine.get_contents("도서관 이용 지침")
    assert [c["article_no"] for c in contents["contents"]] == ["제1조", "제2조", "제3조", "별표 1"] and contents["counts"]["n_main"] == 4
    assert engine.corpus_stats()["n_articles"] == len(CORPUS)
    related = engine.get_related_articles(got["article"]["record_id"])
    assert {r["direction"] for r in related["related"]} == {"inbound"} and related["unresolved"][0]["kind"] == "unnamed_delegation"


def test_answers(spark):
    engine = Engine(table(spark, CORPUS), versions(spark))
    got = engine.answer("대출 권수")
    assert got["answered"] and got["backend"] == "original-text" and got["text"].startswith("다음 공식") and "출처: https://www.jnu.ac.kr" in got["text"]
    assert 1 <= len(got["sources"]) <= 3 and got["sources"][0]["article_no"] == "제2조" and got["sources"][0]["record_id"]
    good = engine.answer("대출 권수", summary="학생은 도서 열 권을 대출할 수 있다.")
    assert good["backend"] == "summary" and good["text"].startswith("학생은 도서")
    assert engine.answer("대출 권수", summary="학생은 도서 99 권을 대출할 수 있다.")["backend"] == "original-text"
    for nothing in ("", None, "우주 정거장"):
        assert engine.answer(nothing) == {"answered": False, "text": "해당 규정 미확인", "sources": [], "articles": [], "backend": "none"}
    assert engine.query_at("학칙 @2012-01-01")["label"] == "판 1"
    assert [engine.query_at(x)["field"] for x in ("학칙", "@2012-01-01", "")] == ["request"] * 3
    engine.close()
    assert engine.search_rule("대출 권수")["status"] == "ok"


def test_refresh(spark, tmp_path):
    path = str(tmp_path / "corpus")
    articles = table(spark, CORPUS)
    articles.write.parquet(path)
    new = articles.where("pos = 4").withColumn("pos", F.lit(90).cast("long")).withColumn("source_key", F.lit("900")).withColumn("rule_name", F.lit("새 지침"))
    texts = spark.createDataFrame([("101", "[별표 9] 새 표\n긴 본문 한 줄\n"), ("950", "1. 가\n글\n2. 나\n글\n3. 다\n끝")], "source_key string, markdown string")
    failures = spark.createDataFrame([("항목 지침", "950", "학생"), ("옛 지침(2012. 1. 1.)", "951", "학생"), ("이미", "101", "학생")], "rule_name string, source_key string, division string")
    listing = spark.createDataFrame([("102", "장학금 새 이름")], "key string, name string")
    sources = refresh.Sources(listing, new, texts, failures)
    todo = refresh.steps(sources)
    assert [n for n, _ in todo] == ["names", "collection", "record types", "structure", "attachments", "titles", "items"]
    same = [("same", lambda a: a)]
    refused = refresh.refresh(spark, path, same, {"never": lambda df: False})
    assert refused["state"] == "failed" and refused["failed_checks"] == ["never"] and spark.read.parquet(path).count() == len(CORPUS)
    broken = refresh.refresh(spark, path, [*same, ("broken", lambda a: a.select("no such column"))], {})
    assert broken["state"] == "failed" and broken["done"] == ["same"] and spark.read.parquet(path).count() == len(CORPUS)
    report = refresh.refresh(spark, path, todo, {"names": lambda df: df.where("rule_name is null").isEmpty()})
    assert report["state"] == "changed" and report["after"]["n_articles"] == len(CORPUS) + 1 + 1 + 3
    after = spark.read.parquet(path)
    assert {r.rule_name for r in after.where("source_key = '102'").collect()} >= {"장학금 새 이름"}
    assert sorted(r.article_no for r in after.where("source_key = '950'").collect()) == ["1.", "2.", "3."]
    assert after.where("article_no = '별표 9'").first().rule_name == "도서관 이용 지침"
    change = refresh.summary_change(articles, after).first()
    assert (change.n_articles_added, change.n_articles_before) == (5, len(CORPUS))
    assert refresh.refresh(spark, path, same, {})["state"] == "unchanged"


def test_small_sinks(spark, tmp_path):
    listing = spark.createDataFrame([("가", "1", "학생", "u", 1)], "name string, key string, division string, source_url string, more int")
    for _ in range(2):
        sinks.snapshot(listing, str(tmp_path / "snap"))
    assert spark.read.json(str(tmp_path / "snap")).columns == ["division", "key", "name", "source_url"] and spark.read.json(str(tmp_path / "snap")).count() == 1
    failures = spark.createDataFrame([("가", "fetch")], "rule_name string, stage string")
    sinks.append_failures(failures, str(tmp_path / "failed"))
    sinks.append_failures(failures, str(tmp_path / "failed"))
    assert spark.read.json(str(tmp_path / "failed")).count() == 2
    (tmp_path / "c.json").write_bytes(b"[]")
    assert corpus.fingerprint(spark, str(tmp_path / "c.json")) == "4f53cda18c2baa0c"
    same = spark.createDataFrame([("a",), ("a",), ("b",)], "record_id string")
    assert etl.same_ids(same, same) and not etl.same_ids(same, same.distinct())
