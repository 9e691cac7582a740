from pyspark.sql import functions as F

from normweave.operators import etl
from tests.fixtures import article, table


def docs(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "source_key string, markdown string")


def test_split_articles(spark):
    text = "# 머리말\n버리는 글\n## 제1조(목적) 이 지침은 목적이다.\n둘째 줄\n\n\n\n셋째 줄\n**제2조의3【정의】** 뜻\n제3조 제목 없음"
    got = etl.split_articles(docs(spark, text, None, "머리글만")).orderBy("place").collect()
    assert [(r.article_no, r.article_title, r.body) for r in got] == [
        ("제1조", "목적", "이 지침은 목적이다.\n둘째 줄\n\n셋째 줄"),
        ("제2조의3", "정의", "뜻"),
        ("제3조", "", "제목 없음"),
    ]


def test_reassemble(spark):
    text = "제1조(하나) 가\n제2조 2(둘째) 나\n제3조 에 따라 다\n제4조(넷) 라"
    got = etl.reassemble(etl.split_articles(docs(spark, text))).orderBy("place").collect()
    assert [(r.article_no, r.article_title) for r in got] == [("제1조", "하나"), ("제2조의2", "둘째"), ("제4조", "넷")]
    assert got[1].body == "나\n제3조에 따라 다"


def test_addendum_and_names(spark):
    df = spark.createDataFrame([("본문\n부  칙 <2020>\n제1조 시행", " 12) 시설  규정 (현행)", "a?mode=file&amp;key=77", "go('/x?mode=file&key=88')")], "t string, n string, u string, o string")
    got = df.select(etl.cut_addendum(F.col("t")), etl.clean_name(F.col("n")), etl.extract_key(F.col("u")), etl.extract_key(F.col("o")), etl.extract_key(F.lit("none"))).first()
    assert tuple(got) == ("본문", "시설 규정", "77", "88", None)


def test_attachments(spark):
    text = "[별표 1] 요금표 ..... 3\n[별표1] 요금표 <개정 2020. 1. 1.>\n긴 본문이다\n[별표 2〕\n## 서식\n내용\n[별표 1]과 같다\n【별표 1】\n짧다"
    got = {r.label: r for r in etl.extract_attachments(docs(spark, text)).collect()}
    assert set(got) == {"별표 1", "별표 2"}
    assert (got["별표 1"].title, got["별표 1"].body) == ("요금표", "긴 본문이다")
    assert got["별표 2"].title == "서식" and got["별표 2"].body.startswith("내용")


def test_items(spark):
    text = "1. 목적\n가\n5. 아님\n2. 범위\n나\n2. 다시\n3. 절차\n다"
    got = etl.extract_items(docs(spark, text, "1. 하나\n가\n2. 둘\n나")).orderBy("place").collect()
    assert [(r.article_no, r.article_title) for r in got] == [("1.", "목적"), ("2.", "범위"), ("3.", "절차")]
    assert got[0].body == "가\n5. 아님" and got[2].body == "다"


def test_structure(spark):
    rows = [
        article(0, no="제1조", body="제1장 총칙\n제1절 앞\n첫 글\n제2절 뒤\n<개정 2020>"),
        article(1, no="제2조", body="둘째 글\n<신설>"),
        article(2, no="제3조", body="제2장 학사\n셋째 글"),
        article(3, name="다른 지침", body="넷째 글"),
    ]
    once = etl.promote_structure(table(spark, rows)).cache()
    got = once.orderBy("pos").collect()
    assert [(r.chapter, r.section, r.body) for r in got] == [
        ("제1장 총칙", "제1절 앞", "첫 글"),
        ("제1장 총칙", "제2절 뒤", "둘째 글\n<신설>"),
        ("제2장 학사", None, "셋째 글"),
        (None, None, "넷째 글"),
    ]
    assert sorted(etl.promote_structure(once).collect()) == sorted(got)


def test_types_and_titles(spark):
    rows = [article(0, title="", body="적용 범위\n본문이 이어진다"), article(1, title="", body="이 지침은 공포한 날부터 시행한다.", kind="본칙"), article(2, title="다른 지침의 폐지", body="이 지침 시행과 동시에 폐지한다.")]
    got = etl.normalize_types(table(spark, rows)).orderBy("pos").collect()
    assert (got[0].article_title, got[0].body) == ("적용 범위", "본문이 이어진다")
    assert [r.record_type for r in got] == [None, "부칙", "부칙"]
    a = spark.createDataFrame([("1", "별표 1", "요금표(제22조의2 ③항의 관련)", "x"), ("1", "별표 2", "", "x"), ("1", "별표 3", "", "<p>\n첫 줄"), ("1", "별표 4", "", "<th></th><th>머리 <b>글</b></th><th> 머리  글 </th>"), ("1", "별표  5", "제목", "표 (제5조제2항 관련)\n글"), ("1", "별표  2", "", "")], "source_key string, label string, title string, body string")
    toc = spark.createDataFrame([("1", "별표 2", "목차 제목")], "source_key string, label string, title string")
    got = {r.label: r for r in etl.fill_titles(a, toc).collect()}
    assert got["별표 1"].title == "요금표" and tuple(got["별표 1"].delegating_article) == ("제22조의2", "③")
    assert [got[f"별표 {i}"].title_source for i in (1, 2, 3, 4)] == ["own", "contents", "first_line", "table_header"]
    assert got["별표 4"].title == "머리 글" and got["별표  2"].title == "목차 제목"
    assert (got["별표  5"].title, tuple(got["별표  5"].delegating_article)) == ("제목", ("제5조", "제2항"))


def test_selection(spark):
    listing = spark.createDataFrame([(f"연구 {i} 지침", str(i), "연구처", "u") for i in range(10)] + [("학생 지침", "20", "학생처", "u"), ("시설 지침(개정 전)", "21", "시설", "u"), ("기타", "22", "기타", "u")], "name string, key string, division string, source_url string")
    got = [r.key for r in etl.select_core(listing, 8).orderBy("place").collect()]
    assert len(got) == 8 and "20" in got and "21" not in got and "22" not in got
    have = spark.createDataFrame([("0",)], "key string")
    assert etl.to_collect(listing, have).count() == 12


def test_append_and_reconcile(spark):
    rows = table(spark, [article(0), article(1, no="제2조")])
    new = table(spark, [article(5, no="제2조"), article(6, no="제9조")])
    assert sorted(r.article_no for r in etl.append_missing(rows, new).collect()) == ["제1조", "제2조", "제9조"]
    listing = spark.createDataFrame([("101", "새 이름 지침")], "key string, name string")
    renamed, gone = etl.reconcile_names(table(spark, [article(0), article(1, key="999")]), listing)
    assert {r.rule_name for r in renamed.collect()} == {"새 이름 지침", "도서관 이용 지침"} and gone.first().source_key == "999"


def test_contents_titles(spark):
    text = "## [별표 3] 연구비 집행기준 ----------- 27\n[별표 4] 서식 ... 3\n[별표 3] 둘째 이름\n본문"
    got = {r.label: r.title for r in etl.contents_titles(docs(spark, text, None)).collect()}
    assert got == {"별표 3": "연구비 집행기준", "별표 4": "서식"}
