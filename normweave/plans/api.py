"""Seven functions over one corpus: search, lookup, as-of lookup, rules, contents, statistics, references.

Each validates its arguments, collects a small result, and answers with a dict whose status is `ok`,
`not_found` or `invalid_argument`. The tables behind are built once and read from there.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.ship import ship
from ..operators import annotate, gate, operations, references, search, temporal

NOT_FOUND = "해당 규정 미확인"
#: Around the cited articles of an answer.
HEADING, CAUTION = "다음 공식 조문 원문을 확인하세요.", "※ 실제 업무 적용 전 최신 개정 여부와 소관 부서 해석을 확인하세요."
#: A question with a date behind it.
AT_DATE = re.compile(r"@\s*(\d{4}-\d{2}-\d{2})\s*$")


class InvalidArgument(ValueError):
    """Carries the name of the argument."""


def text_argument(name: str, value: object, most: int = V.QUERY_LENGTH) -> str:
    if not isinstance(value, str) or not value.strip() or len(value) > most:
        raise InvalidArgument(name)
    return value.strip()


def count_argument(name: str, value: object, most: int = V.MOST_RESULTS) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not 1 <= value <= most:
        raise InvalidArgument(name)
    return value


def flag_argument(name: str, value: object) -> bool:
    if not isinstance(value, bool):
        raise InvalidArgument(name)
    return value


def _answers(method):
    """Turns a bad argument into an envelope that names it."""

    def answer(self, *args, **kwargs):
        try:
            return method(self, *args, **kwargs)
        except InvalidArgument as e:
            return {"status": "invalid_argument", "field": str(e)}

    answer.__doc__, answer.__name__ = method.__doc__, method.__name__
    return answer


def _dict(row: Row) -> dict:
    return row.asDict(recursive=True)


class Engine:
    """The corpus `articles` (pos and the raw columns) and, if there is one, the lineage `versions`."""

    def __init__(self, articles: DataFrame, versions: DataFrame | None = None, hosts: dict[str, str] | None = V.SOURCE_HOSTS):
        ship(articles.sparkSession)
        self.gated = gate.gate(gate.require(articles), hosts).persist()
        self.versions = versions

    def close(self) -> None:
        """Gives back what the engine keeps in memory."""
        for name, held in list(self.__dict__.items()):
            for df in (held,) if isinstance(held, DataFrame) else (held.terms, held.lengths) if isinstance(held, search.Index) else ():
                if df.is_cached:
                    df.unpersist()
            if name in ("articles", "index", "edges"):
                del self.__dict__[name]

    @cached_property
    def articles(self) -> DataFrame:
        return annotate.annotate(gate.accepted(self.gated)).persist()

    @cached_property
    def index(self) -> search.Index:
        index = search.build(self.articles)
        index.terms = index.terms.persist()
        return index

    @cached_property
    def edges(self) -> DataFrame:
        return references.outbound(self.articles).persist()

    def _visible(self, superseded: bool, repealed: bool) -> DataFrame:
        rows = self.articles
        rows = rows if superseded else rows.where("is_current")
        return rows if repealed else rows.where("not is_repealed")

    @_answers
    def search_rule(self, query, k=5, include_superseded=False, include_repealed=False, include_attachments=False) -> dict:
        """Ranked articles with advisories, omitted attachments, and hints where there are hardly any."""
        query, k = text_argument("query", query), count_argument("k", k)
        flags = [flag_argument(n, v) for n, v in (("include_superseded", include_superseded), ("include_repealed", include_repealed), ("include_attachments", include_attachments))]
        asked = self.articles.sparkSession.createDataFrame([(0, query, k, *flags[:2])], "query_id int, query string, k int, include_superseded boolean, include_repealed boolean")
        ranked = search.ranked(self.index, asked).persist()
        results, omitted = search.attachment_gate(ranked, flags[2])
        found = results.drop("is_attachment", "k").join(self.articles, F.col("doc_id") == F.col("pos"))
        found = search.summarize_attachment(found).orderBy("rank").persist()
        rows = [_dict(r) for r in found.collect()]
        left = omitted.select("doc_id", "rank", "score").join(self.articles.select(F.col("pos").alias("doc_id"), "record_id", "rule_name", "article_no", "article_title", F.length("body").alias("body_length")), "doc_id").orderBy("rank")
        upstream = operations.upstream_checks(found.select("query_id", "record_id", "rank"), self.edges)
        out = {
            "status": "ok" if rows else "not_found",
            "results": rows,
            "attachments": [_dict(r) for r in left.collect()],
            "advisories": {
                "upstream_norm_check": [r.target_rule for r in upstream.orderBy("rank").collect()],
                "duplicate_article_title": [_dict(r) for r in operations.duplicate_titles(found).limit(5).collect()],
                "superseded_included": [r["record_id"] for r in rows if not r["is_current"]][:5],
            },
        }
        if len(rows) <= 1:
            words = [r.word for r in search.unmatched_words(self.index, asked).orderBy("place").collect()]
            out["hint"] = {"kind": "no_such_concept" if words else "cross_reference", "unmatched": words}
        if not rows:
            out["text"] = NOT_FOUND
        ranked.unpersist()
        found.unpersist()
        return out

    def answer(self, question, k=3, summary=None) -> dict:
        """The first k articles whose addresses are official, cited whole, under a summary if it says nothing that they don't.

        answered, text, sources, articles, and backend: `summary`, `original-text` or, without an answer, `none`.
        """
        none = {"answered": False, "text": NOT_FOUND, "sources": [], "articles": [], "backend": "none"}
        if not isinstance(question, str) or not question.strip():
            return none
        found = self.search_rule(question.strip()[: V.QUERY_LENGTH], k)
        if not found.get("results"):
            return none
        spark = self.articles.sparkSession
        rows = [(r["rank"], r["rule_name"], r["article_no"], r["article_title"], r["body"], r["source_key"], r["source_url"]) for r in found["results"]]
        held = spark.createDataFrame(rows, "rank int, rule_name string, article_no string, article_title string, body string, source_key string, source_url string")
        held = held.where(gate.official_url(F.col("source_url"), F.col("source_key")))
        cited = {r.rank: r.cited for r in held.select("rank", search.citation(*[F.col(c) for c in ("rule_name", "article_no", "article_title", "body", "source_url")]).alias("cited")).collect()}
        articles = [r for r in found["results"] if r["rank"] in cited]
        if not articles:
            return none
        proof = F.collect_list(F.struct("rule_name", "article_no", "article_title", "body"))
        good = isinstance(summary, str) and bool(held.agg(proof.alias("p")).select(operations.evidence_holds(F.lit(summary), F.col("p"))).first()[0])
        text = "\n\n".join([summary if good else HEADING, *(cited[r["rank"]] for r in articles), CAUTION])
        sources = [{c: r[c] for c in ("rule_name", "article_no", "source_key", "source_url", "record_id", "revision")} for r in articles]
        return {"answered": True, "text": text, "sources": sources, "articles": articles, "backend": "summary" if good else "original-text"}

    @_answers
    def query_at(self, request) -> dict:
        """`get_article_as_of` for a text such as `name or question @YYYY-MM-DD`; the text before the date is the keyword too."""
        asked = text_argument("request", request)
        date = AT_DATE.search(asked)
        name = AT_DATE.sub("", asked).strip()
        if not date or not name:
            raise InvalidArgument("request")
        return self.get_article_as_of(name, date[1], name)

    @_answers
    def get_article(self, rule_name, article_no, record_id=None) -> dict:
        """Records of a name and number; the first is the main one."""
        rows = operations.point_lookup(self.articles, text_argument("rule_name", rule_name), text_argument("article_no", article_no), record_id and text_argument("record_id", record_id))
        found = [_dict(r) for r in rows.collect()]
        return {"status": "ok", "article": found[0], "others": found[1:]} if found else {"status": "not_found"}

    @_answers
    def get_article_as_of(self, rule_name, date, keyword=None) -> dict:
        """Articles of a rule as they were on a date (YYYY-MM-DD)."""
        name, date = text_argument("rule_name", rule_name), text_argument("date", date, 10)
        if not re.match(temporal.DATE, date):
            raise InvalidArgument("date")
        word = None if keyword is None else text_argument("keyword", keyword)
        spark = self.articles.sparkSession
        if self.versions is None:
            return {"status": "not_found", "known_rules": []}
        names = self.versions.groupBy("rule_name").agg(F.min("place").alias("place"))
        asked = spark.createDataFrame([(0, name)], "query_id int, text string")
        rule = temporal.resolve_names(asked, names).first().rule_name
        known = {"status": "not_found", "known_rules": [r.rule_name for r in names.orderBy("rule_name").limit(100).collect()]}
        if rule is None:
            return known
        probe = spark.createDataFrame([(0, rule, date, word)], "probe_id int, rule_name string, date string, keyword string")
        row = temporal.pick_articles(temporal.as_of(self.versions, probe)).first()
        if row.status != "ok":
            return known | {"rule_name": rule}
        v = row.version
        return {"status": "ok", "rule_name": rule, "date": date, "label": v.label, "valid_from": v.valid_from, "valid_until": v.valid_until, "source_url": v.source_url, "articles": [_dict(a) for a in row.articles], "notice": row.notice}

    @_answers
    def list_rules(self, division=None, include_superseded=False) -> dict:
        division = None if division is None else text_argument("division", division)
        rows = operations.rules_list(self._visible(flag_argument("include_superseded", include_superseded), True), division)
        return {"status": "ok", "rules": [_dict(r) for r in rows.orderBy("division", "rule_name").collect()]}

    @_answers
    def get_contents(self, rule_name, include_addenda=True) -> dict:
        rows = self.articles.where(F.col("rule_name") == text_argument("rule_name", rule_name)).persist()
        listed = operations.contents(rows, flag_argument("include_addenda", include_addenda)).orderBy("rank").select("article_no", "article_title", "record_type", "chapter" if "chapter" in rows.columns else F.lit(None).alias("chapter"))
        counts = operations.contents_counts(rows).first()
        return {"status": "ok", "contents": [_dict(r) for r in listed.collect()], "counts": _dict(counts)} if counts else {"status": "not_found"}

    @_answers
    def corpus_stats(self, report: DataFrame | None = None) -> dict:
        """Counts, rows by division, rejects by reason, damage, and coverage gaps if there is a coverage report."""
        out = _dict(operations.corpus_stats(self.gated).first())
        out["by_division"] = [_dict(r) for r in operations.histogram(self.articles, "division").orderBy(F.desc("n"), "value").collect()]
        out["rejected_by_reason"] = {r.reason: r.n for r in operations.rejects_by_reason(self.gated).collect()}
        out["damage"] = [_dict(r) for r in operations.damage_inventory(self.articles).orderBy("kind", "tier").collect()]
        out["coverage_gaps"] = [] if report is None else [r.gap for r in operations.coverage_gaps(report).orderBy("division").collect()]
        return {"status": "ok"} | out

    @_answers
    def get_related_articles(self, record_id, direction="both", resolve=True) -> dict:
        """What a record refers to and what refers to it."""
        record_id = text_argument("record_id", record_id)
        if direction not in ("outbound", "inbound", "both"):
            raise InvalidArgument("direction")
        flag_argument("resolve", resolve)
        if self.articles.where(F.col("record_id") == record_id).isEmpty():
            return {"status": "not_found"}
        wanted = self.articles.where(F.col("record_id") == record_id).select("record_id").distinct()
        rows = references.related(self.edges, self.articles, wanted, direction)
        if resolve:
            rows = rows.join(self.articles.select(F.col("record_id").alias("other_id"), "rule_name", "article_no", "article_title", "body"), "other_id", "left")
        unresolved = self.edges.where((F.col("src_id") == record_id) & ~F.col("resolved")) if direction != "inbound" else self.edges.limit(0)
        return {"status": "ok", "related": [_dict(r) for r in rows.where("other_id is not null").collect()], "unresolved": [_dict(r) for r in unresolved.orderBy("place").collect()]}
