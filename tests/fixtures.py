"""Invented articles in the shape of the corpus."""

COLUMNS = "pos long, rule_name string, division string, article_no string, article_title string, body string, source_key string, source_url string, collected_at string, record_type string"


def url(key, host="www.jnu.ac.kr"):
    return f"https://{host}/rule?mode=file&key={key}"


def article(pos, name="도서관 이용 지침", division="학생", no="제1조", title="목적", body="이 지침은 도서관의 이용에 필요한 사항을 정한다.", key="101", source=None, kind=None):
    return (pos, name, division, no, title, body, key, source or url(key), "2024-01-01T00:00:00+09:00", kind)


def table(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


CORPUS = [
    article(0),
    article(1, no="제2조", title="대출 권수", body="① 학생은 도서 열 권을 대출할 수 있다.\n② 삭제 <2020. 6. 3.>\n③ 연체한 학생은 대출을 정지한다. 세부는 관장이 따로 정한다."),
    article(2, no="제3조", title="연체", body="연체 도서의 반납은 제2조제2항에 따르며 별표 1과 같다. ｢개인정보 보호법｣ 제5조를 준용한다."),
    article(3, no="별표 1", title="연체료 표", body="<table><tr><td>연체 도서 반납 대출 연체료</td></tr></table>" + "연체료 " * 100, kind="별표"),
    article(4, "장학금 지급 지침", "학생", "제1조", "목적", "이 지침은 장학금의 지급 절차를 정한다.", "102"),
    article(5, "장학금 지급 지침", "학생", "제2조", "지급 신청", "장학금을 받으려는 학생은 「도서관 이용 지침」 제2조를 확인하고 신청한다.", "102"),
    article(6, "장학금 지급 지침(2012. 12. 26. 제정)", "학생", "제1조", "목적", "옛 장학금 지급 기준이다.", "103"),
    article(7, "연구실 안전 지침", "연구", "제1조", "목적", "<삭제 2019. 3. 1.>", "104"),
    article(8, "연구실 안전 지침", "연구", "제2조", "점검", "1. 점검표 작성\n2. (삭제) <개정 2024. 3. 22.>\n실험?연구 장비를 점검한다.", "104"),
]
