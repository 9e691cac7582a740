"""Mentions of other texts in a body, with their places: attachments, delegations, rules and articles."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import values as V

# Patterns of mentions.
_OPEN, _CLOSE = "「｢『《", "」｣』》"
ATTACHMENT = re.compile(r"별표\s*\d+(?:의\s*\d+)?|별지\s*서식\s*제\s*\d+\s*호|별지\s*제\s*\d+\s*호\s*서식|별표(?=\s*와\s*같)")
DELEGATION = re.compile(
    r"(?:(?P<who>[가-힣]{2,12}(?:총장|장|위원회))\s*(?:이|가)\s*)?(?:따로|별도로|달리)\s*정(?:한다|하는\s*바에\s*(?:따른다|의한다)|하여야\s*한다)"
    r"|(?P<body>[가-힣]{2,12}(?:총장|장|위원회))\s*(?:이|가)\s*정(?:한다|하는\s*바에\s*(?:따른다|의한다))"
)
NAMED = re.compile(rf"제\s*\d+\s*조|별표|별지|[{_OPEN}]|[‘“][^’”]{{2,50}}(?:규정|지침|학칙|규칙|세칙)[’”]")
RULE = re.compile(
    rf"(?:[{_OPEN}]\s*(?P<hard>[^{_CLOSE}]{{2,50}}?)\s*[{_CLOSE}]"
    r"|[‘“]\s*(?P<soft>[^’”]{2,50}?(?:규정|지침|학칙|규칙|세칙|요령|기준))\s*[’”]"
    r"|(?P<bare>[가-힣A-Za-z0-9·ㆍ]{3,30}(?:규정|지침|학칙|규칙|세칙|법률|법|시행령|시행규칙|조례|정관)))"
    r"(?!\s*[」｣』》’”]?\s*(?:부칙\s*)?제\s*\d+\s*조)(?!\s*(?:이)?란|\s*이라\s*함은|\s*이라\s*한다)"
)
ARTICLE = re.compile(
    r"(?:[「｢『《‘“]\s*(?P<hard>[^」｣』》’”]{2,50}?)\s*[」｣』》’”]\s*)?(?P<bare>[가-힣A-Za-z·]{2,30})?\s*(?P<addendum>부칙)?\s*"
    r"제\s*(?P<no>\d+)\s*조(?:\s*의\s*(?P<sub>\d+))?(?:\s*제\s*(?P<clause>\d+)\s*항)?(?P<each>\s*각\s*호)?"
)
#: What a body with any mention has: an attachment, a delegation, an opening mark, the tail of a name, or an article.
SIGN = r"별표|별지|정[한하]|[「｢『《‘“]|규정|지침|학칙|규칙|세칙|법|시행령|조례|정관|제(?U:\s*)\d"
#: Marks that say which clause a delegation stands in.
NEAR_MARKS = V.CLAUSE_MARKS[0][:15]

_FIELDS = ["type", "place", "raw", "name", "quoted", "addendum", "article", "clause", "delegate"]
_TYPES = {"place": T.IntegerType(), "quoted": T.BooleanType(), "addendum": T.BooleanType()}
KIND = T.ArrayType(T.StructType([T.StructField(f, _TYPES.get(f, T.StringType())) for f in _FIELDS]))


def _one_line(text: str) -> str:
    return " ".join(text.split())


def _mention(type_: str, match: re.Match, raw: str | None = None, **more: object) -> dict:
    return dict.fromkeys(_FIELDS) | {"type": type_, "place": match.start(), "raw": _one_line(match.group()) if raw is None else raw} | more


def find(body: str) -> list[dict]:
    """All mentions in the order of types attachment, delegation, rule, article, and by place inside a type."""
    out = [_mention("attachment", m) for m in ATTACHMENT.finditer(body)]
    for m in DELEGATION.finditer(body):
        line = body[body.rfind("\n", 0, m.start()) + 1 : m.start()]
        scope = line.rpartition("다.")[2]  # the sentence that the delegation ends
        if not NAMED.search(scope):
            mark = max(NEAR_MARKS, key=lambda c: body.rfind(c, 0, m.start()))
            clause = mark if body.rfind(mark, 0, m.start()) >= 0 else None
            out.append(_mention("delegation", m, _one_line(scope + m.group()), clause=clause, delegate=m["who"] or m["body"]))
    for m in RULE.finditer(body):
        name = (m["hard"] or m["soft"] or m["bare"] or "").strip()
        if name and name not in V.NOT_A_RULE and name not in V.VAGUE and not name.endswith(tuple(V.NOT_A_LAW_TAIL)):
            out.append(_mention("rule", m, name=name))
    for m in ARTICLE.finditer(body):
        number = f"제{int(m['no'])}조" + (f"의{int(m['sub'])}" if m["sub"] else "")
        clause = " ".join(filter(None, [f"제{int(m['clause'])}항" if m["clause"] else "", "각 호" if m["each"] else ""])) or None
        out.append(_mention("article", m, name=m["hard"] or m["bare"], quoted=bool(m["hard"]), addendum=bool(m["addendum"]), article=number, clause=clause))
    return out


@F.pandas_udf(KIND)
def mentions(bodies: pd.Series) -> pd.Series:
    return bodies.map(lambda b: find(b or ""))
