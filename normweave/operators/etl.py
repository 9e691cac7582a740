"""From converted texts and listings to article records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.text import blank, squeeze, strip

# Patterns of headers and notes.
ARTICLE = r"(?md)^[ \t]*(?:#{1,6}[ \t]*)?(?:[-*+>][ \t]*)?(?:\*\*|__)?제(?U:\s*)(\d+)(?U:\s*)조(?:(?U:\s*)의(?U:\s*)(\d+))?(?U:\s*)(?:[（(](?U:\s*)([^\n)）]+?)(?U:\s*)[)）]|【(?U:\s*)([^\n】]+?)(?U:\s*)】)?(?:\*\*|__)?[ \t]*(.*)$"
ADDENDUM = r"(?md)^부(?U:\s){0,6}칙(?U:\s*)(?:$|[<(（])"
ATTACHMENT = r"(?md)^#{0,4}(?U:\s*)[\[【<〔](?U:\s*)(별표[^\]】>〕』]{0,20}?)(?U:\s*)[\]】>〕』](?U:\s*)([^\n]*)$"
CONTENTS_TAIL = r"(?:[-.]{3,}(?U:\s*)\d+|(?U:\s)\d+)(?U:\s*)$"
SENTENCE_TAIL = r"(?:같다|따른다|의하다|참조)[.。]?(?U:\s*)$"
ITEM = r"(?md)^((?U:\s*)(\d{1,2})(?U:\s*)\.(?U:\s*)([^\n]{1,40}))$"
SECTION = r"^(?U:\s*)제(?U:\s*)(\d+)(?U:\s*)(장|절)((?U:\s)|$|[^가-힣])"
NOTE_LINE = r"^(?U:\s*)<[^>]*>(?U:\s*)$"
CONTENTS_LINE = r"^#*(?U:\s*)[\[【](?U:\s*)(별표[^\]】]*?)(?U:\s*)[\]】](?U:\s*)(.*?)(?U:\s*)[-·.\s]*\d*(?U:\s*)$"
DELEGATION = r"\((?U:\s*)제(?U:\s*)(\d+)(?U:\s*)조(?:(?U:\s*)의(?U:\s*)(\d+))?(?U:\s*)(?:제(?U:\s*)(\d+)(?U:\s*)항|([①-⑮])(?U:\s*)항)?[^)]*관련[^)]*\)"
SPLIT_HEAD = r"(?s)^(\d+)\(([^)\n]{1,40})\)(?U:\s*)(.*)"
FRAGMENT = r"^(?:[,)]|의 |에 |와 |과 |및 |내지 |부터 |까지 |제\d+[항호])"
#: First header cell with text alone; a name of a past edition.
TABLE_HEADER = r"<th[^>]*>([^<]{2,80})</th>"
PAST_EDITION = r"(?U)개정\s*전|이전|폐지|\(\s*\d{4}"
PAST = r"(?U)개정\s*전|이전|폐지"
MIN_ITEMS = 3


def clean_name(name: Column) -> Column:
    """Single spaces, no number in front, no mark of the current edition behind."""
    bare = F.regexp_replace(squeeze(blank(name)), r"(?U)^\s*\d+\s*[.)．]\s*", "")
    return strip(F.regexp_replace(bare, r"(?U)[\s(（]*(?:현행|현행본)[)）]?[\s]*$", ""))


def clean_markdown(text: Column) -> Column:
    lines = F.regexp_replace(F.regexp_replace(blank(text), r"(?md)^#{1,6}(?U:\s*)", ""), r"\r\n?", "\n")
    return strip(F.regexp_replace(F.regexp_replace(lines, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))


def extract_key(link: Column) -> Column:
    """Digits of `key=` in an address, or the key of a quoted `mode=file` address; null without either."""
    direct = F.regexp_extract(blank(link), r"(?i)(?:[?&]|&amp;)key=(\d+)", 1)
    quoted = F.regexp_extract_all(blank(link), F.lit(r"['\"]([^'\"]+)['\"]"), 1)
    file = F.filter(quoted, lambda q: q.rlike(r"(?i)[?&]mode=file(?:&|$)"))
    second = F.transform(file, lambda q: F.regexp_extract(q, r"[?&]key=([^&]+)", 1))
    return F.when(direct != "", direct).otherwise(F.try_element_at(F.filter(second, lambda k: k != ""), F.lit(1)))


def _blocks(text: Column, header: str, groups: int) -> Column:
    """Pieces of a text from each header to the next: a struct of the header's groups and the rest. What comes before is left out."""
    marks = "\u0001" + "".join(f"${i}\u0002" for i in range(1, groups + 1))
    pieces = F.slice(F.split(F.regexp_replace(text, header, marks), "\u0001"), 2, 1 << 30)
    return F.transform(pieces, lambda p: F.struct(*[F.get(F.split(p, "\u0002"), i).alias(f"g{i + 1}" if i < groups else "rest") for i in range(groups + 1)]))


def split_articles(documents: DataFrame) -> DataFrame:
    """documents (source_key, markdown) as one row for each article: (source_key, place, article_no, article_title, body).

    Text before the first header is dropped; a document without headers, or a null one, has no rows.
    """
    blocks = documents.select("source_key", F.posexplode(_blocks(blank(F.col("markdown")), ARTICLE, 5)).alias("place", "b"))
    number = F.concat(F.lit("제"), F.col("b.g1"), F.lit("조"), F.when(F.col("b.g2") != "", F.concat(F.lit("의"), F.col("b.g2"))).otherwise(""))
    title = squeeze(F.when(F.col("b.g3") != "", F.col("b.g3")).otherwise(F.col("b.g4")))
    parts = F.filter(F.array(strip(F.col("b.g5")), strip(F.col("b.rest"))), lambda p: p != "")
    return blocks.select("source_key", "place", number.alias("article_no"), title.alias("article_title"), clean_markdown(F.array_join(parts, "\n")).alias("body"))


def cut_addendum(text: Column) -> Column:
    """The text before its first addendum header."""
    return strip(F.get(F.split(F.regexp_replace(blank(text), ADDENDUM, "\u0001"), "\u0001"), F.lit(0)))


def reassemble(articles: DataFrame) -> DataFrame:
    """Articles of `split_articles` with accidents of the split undone.

    An untitled article whose body is `N(title)...` becomes branch N of its number. One whose body goes on
    with a connective is part of the article before it, and is put back there, or dropped if there is none.
    """
    body = F.regexp_replace(blank(F.col("body")), r"(?U)^\s+", "")
    bare = F.col("article_title") == ""
    branch = bare & (F.regexp_extract(body, SPLIT_HEAD, 1) != "") & ~F.col("article_no").contains("조의")
    fixed = articles.select(
        *[c for c in articles.columns if c not in ("article_no", "article_title", "body")],
        F.when(branch, F.concat("article_no", F.lit("의"), F.regexp_extract(body, SPLIT_HEAD, 1))).otherwise(F.col("article_no")).alias("article_no"),
        F.when(branch, strip(F.regexp_extract(body, SPLIT_HEAD, 2))).otherwise(F.col("article_title")).alias("article_title"),
        F.when(branch, strip(F.regexp_extract(body, SPLIT_HEAD, 3))).otherwise(F.col("body")).alias("body"),
        (bare & ~branch & body.rlike(FRAGMENT)).alias("__piece"),
    )
    running = Window.partitionBy("source_key").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    islands = fixed.withColumn("__island", F.count_if(~F.col("__piece")).over(running)).where("__island > 0")
    text = F.when(F.col("__piece"), F.concat("article_no", "body")).otherwise(F.regexp_replace("body", r"(?U)\s+$", ""))
    joined = islands.groupBy("source_key", "__island").agg(
        F.min("place").alias("place"), F.min_by("article_no", "place").alias("article_no"), F.min_by("article_title", "place").alias("article_title"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", text.alias("t")))), lambda x: x["t"]), "\n").alias("body"),
    )
    return joined.select("source_key", "place", "article_no", "article_title", "body")


def attachment_label(label: Column) -> Column:
    """`별표1` and `별표 1.` as `별표 1`."""
    text = F.regexp_replace(F.regexp_replace(squeeze(blank(label)), r"^[\[\]【】〔〕『』<>]+|[\[\]【】〔〕『』<>]+$", ""), r"\.+$", "")
    rest = F.trim(F.regexp_extract(text, "^별표(?U:\\s*)(.*)$", 1))
    return F.when(text.startswith("별표"), F.when(rest != "", F.concat(F.lit("별표 "), rest)).otherwise("별표")).otherwise(text)


def extract_attachments(documents: DataFrame) -> DataFrame:
    """(source_key, place, label, title, body) of documents (source_key, markdown): of each label the longest body, the first on ties.

    Lines of a table of contents, and sentences that only quote a label, are no headers. place orders
    labels as they were first seen.
    """
    # A header that is none is turned back into text before the cut: only real ones keep the mark.
    lines = F.transform(F.split(blank(F.col("markdown")), "\n"), lambda x: F.when(x.rlike(CONTENTS_TAIL) | x.rlike(SENTENCE_TAIL), F.regexp_replace(x, ATTACHMENT.replace("(?md)", ""), " $0")).otherwise(x))
    guarded = F.array_join(F.transform(lines, lambda x: F.when(x.rlike("^ #{0,4}\\s*[\\[【<〔]\\s*별표"), F.concat(F.lit("\u0004"), x)).otherwise(x)), "\n")
    blocks = documents.select("source_key", F.posexplode(_blocks(guarded, ATTACHMENT, 2)).alias("place", "b"))
    rest = strip(F.regexp_replace(F.col("b.rest"), "\u0004 ", ""))
    inline = strip(F.regexp_replace(F.regexp_replace(strip(F.col("b.g2")), r"^#+", ""), r"(?U)\s*<[^>]*>\s*$", ""))
    given = (inline != "") & ~inline.startswith("<")
    heading = F.regexp_extract(F.substring(rest, 1, 80), r"(?md)^#+(?U:\s*)(.+)$", 1)
    title = F.when(given, inline).otherwise(strip(heading))
    body = F.when(~given & (heading != ""), strip(F.regexp_replace(rest, r"(?sd)^(.{0,79}?)(?m:^#+[^\n]*$)", "$1"))).otherwise(rest)
    rows = blocks.select("source_key", "place", attachment_label(F.col("b.g1")).alias("label"), title.alias("title"), body.alias("body")).where("body != ''")
    best = rows.groupBy("source_key", "label").agg(F.min("place").alias("first"), F.min_by(F.struct("title", "body"), F.struct((-F.length("body")).alias("n"), F.col("place"))).alias("b"))
    return best.select("source_key", F.col("first").alias("place"), "label", "b.title", "b.body")


def append_missing(articles: DataFrame, new: DataFrame) -> DataFrame:
    """articles and those rows of new whose (source_key, article_no) they lack."""
    extra = new.join(articles.select("source_key", "article_no"), ["source_key", "article_no"], "left_anti")
    return articles.unionByName(extra, allowMissingColumns=True)


def enrich_attachments(attachments: DataFrame, articles: DataFrame) -> DataFrame:
    """Attachments as records, with name, division and address of the first article of their source; others are left out."""
    parent = articles.groupBy("source_key").agg(F.min_by(F.struct("rule_name", "division", "source_url"), "pos").alias("p"))
    return attachments.join(parent, "source_key").select("source_key", "p.*", F.col("label").alias("article_no"), F.col("title").alias("article_title"), "body", F.lit(V.ATTACHMENT).alias("record_type"))


def extract_items(documents: DataFrame) -> DataFrame:
    """(source_key, place, article_no, article_title, body) of numbered items of documents (source_key, markdown).

    A header counts only if its number is the next one, from 1; fewer than three make no items. Between
    headers that count, all text is body; an empty body makes no row.
    """
    blocks = documents.select("source_key", _blocks(blank(F.col("markdown")), ITEM, 3).alias("blocks"))
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<no:int,title:string,body:string>>").alias("items"))

    def step(state: Column, b: Column) -> Column:
        hit = b["g2"].cast("int") == state["next"]
        shown = F.concat(b["g1"], b["rest"])
        last = F.try_element_at(state["items"], F.lit(-1))
        longer = F.concat(F.slice(state["items"], 1, F.greatest(F.size(state["items"]) - 1, F.lit(0))), F.array(F.struct(last["no"].alias("no"), last["title"].alias("title"), F.concat(last["body"], shown).alias("body"))))
        added = F.concat(state["items"], F.array(F.struct(b["g2"].cast("int").alias("no"), b["g3"].alias("title"), b["rest"].alias("body"))))
        items = F.when(hit, added).when(F.size(state["items"]) > 0, longer).otherwise(state["items"])
        return F.struct(F.when(hit, state["next"] + 1).otherwise(state["next"]).alias("next"), items.alias("items"))

    found = blocks.select("source_key", F.aggregate("blocks", start, step)["items"].alias("items")).where(F.size("items") >= MIN_ITEMS)
    rows = found.select("source_key", F.posexplode("items").alias("place", "i"))
    return rows.select("source_key", "place", F.concat(F.col("i.no").cast("string"), F.lit(".")).alias("article_no"), squeeze(F.col("i.title")).alias("article_title"), strip(F.col("i.body")).alias("body")).where("body != ''")


def promote_structure(articles: DataFrame) -> DataFrame:
    """articles (pos, rule_name, body, and chapter, section if present) with chapter and section, and headings out of bodies.

    Headings in front of a body change its own place, headings behind it the next article's. A new chapter
    ends the section. Applied again, it changes nothing: what a row has already is where its state begins.
    """
    had = lambda c: F.col(c) if c in articles.columns else F.lit(None).cast("string")
    lines = F.split(blank(F.col("body")), "\n")
    heading, empty = lambda x: x.rlike(SECTION), lambda x: strip(x) == ""
    first = _first_index(lines, lambda x: ~(heading(x) | empty(x)))
    wide = articles.withColumn("__lines", lines).withColumn("__start", first)
    rest = F.slice("__lines", F.col("__start") + 1, F.size("__lines"))
    back = F.reverse(rest)
    keep = _first_index(back, lambda x: ~(heading(x) | empty(x) | x.rlike(NOTE_LINE)))
    wide = wide.withColumn("__rest", rest).withColumn("__tail", keep)
    tail = F.filter(F.slice("__rest", F.size("__rest") - F.col("__tail") + 1, F.size("__rest")), heading)
    wide = wide.withColumn("__after", tail).withColumn("__before", F.filter(F.slice("__lines", F.lit(1), F.col("__start")), heading))
    body = F.when(F.size("__after") > 0, F.slice("__rest", F.lit(1), F.size("__rest") - F.col("__tail"))).otherwise(F.col("__rest"))
    # Events in order: what the row had, headings before it, the row itself, headings after it.
    own = F.when(had("chapter").isNotNull() | had("section").isNotNull(), F.array(F.struct(F.lit("set").alias("kind"), had("chapter").alias("chapter"), had("section").alias("section")))).otherwise(F.array().cast("array<struct<kind:string,chapter:string,section:string>>"))
    event = lambda hs: F.transform(hs, lambda h: F.when(F.regexp_extract(h, SECTION, 2) == "장", F.struct(F.lit("set").alias("kind"), strip(h).alias("chapter"), F.lit(None).cast("string").alias("section"))).otherwise(F.struct(F.lit("section").alias("kind"), F.lit(None).cast("string").alias("chapter"), strip(h).alias("section"))))
    wide = wide.withColumn("__own", F.concat(own, event(F.col("__before")))).withColumn("__next", event(F.col("__after")))
    marks = wide.withColumn("__all", F.concat("__own", "__next"))
    of = Window.partitionBy("rule_name").orderBy("pos")
    before = of.rowsBetween(Window.unboundedPreceding, -1)
    folded = lambda es: F.aggregate(es, F.struct(F.lit(False).alias("set"), F.lit(None).cast("string").alias("chapter"), F.lit(False).alias("sec"), F.lit(None).cast("string").alias("section")), lambda s, e: F.when(e["kind"] == "set", F.struct(F.lit(True).alias("set"), e["chapter"].alias("chapter"), F.lit(True).alias("sec"), e["section"].alias("section"))).otherwise(F.struct(s["set"].alias("set"), s["chapter"].alias("chapter"), F.lit(True).alias("sec"), e["section"].alias("section"))))
    marks = marks.withColumn("__f", folded(F.col("__all"))).withColumn("__o", folded(F.col("__own")))
    chapter = F.last(F.when(F.col("__f.set"), F.struct(F.col("__f.chapter").alias("v"))), ignorenulls=True).over(before)["v"]
    section = F.last(F.when(F.col("__f.sec"), F.struct(F.col("__f.section").alias("v"))), ignorenulls=True).over(before)["v"]
    out = marks.withColumn("chapter", F.when(F.col("__o.set"), F.col("__o.chapter")).otherwise(chapter)).withColumn("section", F.when(F.col("__o.sec"), F.col("__o.section")).otherwise(section))
    return out.withColumn("body", strip(F.array_join(body, "\n"))).drop(*[c for c in out.columns if c.startswith("__")])


def _first_index(lines: Column, test) -> Column:
    """Place of the first line that passes, or the number of lines."""
    return F.coalesce(F.array_min(F.filter(F.transform(lines, lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull())), F.size(lines))


def normalize_types(articles: DataFrame) -> DataFrame:
    """Titles lifted from first lines, and addenda recognised by title and opening words."""
    title, body = strip(blank(F.col("article_title"))), blank(F.col("body"))
    first = r"^([가-힣A-Za-z0-9()·ㆍ\s]{2,30})\n"
    line, rest = F.regexp_extract(body, first, 1), strip(F.regexp_replace(body, first, ""))
    lift = (title == "") & (strip(line) != "") & (rest != "")
    lifted = articles.withColumn("__t", F.when(lift, strip(line)).otherwise(F.col("article_title"))).withColumn("body", F.when(lift, rest).otherwise(F.col("body"))).withColumn("article_title", F.col("__t")).drop("__t")
    title, body = strip(blank(F.col("article_title"))), blank(F.col("body"))
    opens, pair = body.rlike(r"(?U)^\s*(?:부\s*칙|이\s*(?:지침|규정|학칙|규칙|세칙|정관)은)"), body.rlike(r"(?U)^\s*이\s*(?:지침|규정|학칙|규칙|세칙)\s*(?:의\s*)?시행")
    late = title.isin(V.SUPPLEMENT_TITLES) | ((title == "") & (opens | pair)) | (title.rlike("(다른|종전).*(폐지)|폐지$") & pair)
    return lifted.withColumn("record_type", F.when(late, V.ADDENDUM).otherwise(F.col("record_type")))


def strip_delegation(title: Column) -> tuple[Column, Column]:
    """The title without `(제22조 ③항의 관련)`, and that as (article_no, clause), null without it."""
    part = lambda i: F.regexp_extract(blank(title), DELEGATION, i)
    whole = lambda x: x.cast("int").cast("string")
    number = F.concat(F.lit("제"), whole(part(1)), F.lit("조"), F.when(part(2) != "", F.concat(F.lit("의"), whole(part(2)))).otherwise(""))
    clause = F.when(part(3) != "", F.concat(F.lit("제"), whole(part(3)), F.lit("항"))).when(part(4) != "", part(4))
    return strip(F.regexp_replace(blank(title), DELEGATION, "")), F.when(part(1) != "", F.struct(number.alias("article_no"), clause.alias("clause")))


def contents_titles(documents: DataFrame) -> DataFrame:
    """(source_key, label, title): titles that lines of a table of contents give attachments; the first of each label."""
    lines = documents.select("source_key", F.posexplode(F.split(blank(F.col("markdown")), "\n")).alias("place", "line")).where(F.col("line").rlike(CONTENTS_LINE))
    title = F.regexp_replace(squeeze(F.regexp_extract("line", CONTENTS_LINE, 2)), r"^[ \-·.]+|[ \-·.]+$", "")
    rows = lines.select("source_key", "place", squeeze(F.regexp_extract("line", CONTENTS_LINE, 1)).alias("label"), title.alias("title")).where("title != ''")
    return rows.groupBy("source_key", "label").agg(F.min_by("title", "place").alias("title"))


def fill_titles(attachments: DataFrame, contents: DataFrame) -> DataFrame:
    """attachments (source_key, label, title, body) with title, title_source and delegating_article.

    In this order: its own title, the document's table of contents (source_key, label, title), the body's
    first line that is no markup, the first table header of 2 to 80 plain characters. Labels meet with
    single spaces. A title that names no delegating article leaves that to the body's first line.
    """
    toc = contents.groupBy("source_key", squeeze(blank(F.col("label"))).alias("__label")).agg(F.min("title").alias("__toc"))
    lines = F.filter(F.transform(F.split(blank(F.col("body")), "\n"), strip), lambda x: (x != "") & ~x.rlike(r"^(?:<|\||!\[|\[|-{3,}|={3,})"))
    line = F.try_element_at(lines, F.lit(1))
    line = F.when(F.length(line) <= 100, line)
    head = squeeze(F.regexp_extract(blank(F.col("body")), TABLE_HEADER, 1))
    head = F.when(F.length(head).between(2, 80), head)
    own = F.when(strip(blank(F.col("title"))) != "", F.col("title"))
    joined = attachments.withColumn("__label", squeeze(blank(F.col("label")))).join(toc, ["source_key", "__label"], "left")
    source = F.when(own.isNotNull(), "own").when(F.col("__toc").isNotNull(), "contents").when(line.isNotNull(), "first_line").when(head.isNotNull(), "table_header")
    joined = joined.withColumn("title_source", source).withColumn("__title", F.coalesce(own, "__toc", line, head, F.lit(""))).withColumn("__line", line)
    title, given = strip_delegation(F.col("__title"))
    _, below = strip_delegation(F.col("__line"))
    return joined.withColumn("delegating_article", F.coalesce(given, below)).withColumn("title", title).drop("__toc", "__title", "__line", "__label")


def failed_items(failures: DataFrame, articles: DataFrame, documents: DataFrame, include_past: bool = False) -> DataFrame:
    """Item records of failed sources: failures (rule_name, source_key, division) whose document (source_key, markdown) has numbered items.

    A source that articles have is left alone, and so are past editions unless asked for.
    """
    rows = failures.join(articles.select("source_key").distinct(), "source_key", "left_anti")
    rows = rows if include_past else rows.where(~blank(F.col("rule_name")).rlike(PAST_EDITION))
    items = extract_items(documents.join(rows.select("source_key").distinct(), "source_key", "left_semi"))
    return items.join(rows.dropDuplicates(["source_key"]), "source_key").withColumn("record_type", F.lit(V.ITEM))


def structure_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row of counts over articles before and after `promote_structure`: all, changed bodies, with chapter, with section."""
    met = after.join(before.select("pos", F.col("body").alias("__was")), "pos")
    return met.agg(
        F.count(F.lit(1)).alias("n_articles"), F.count_if(~F.col("body").eqNullSafe(F.col("__was"))).alias("n_changed"),
        F.count_if(blank(F.col("chapter")) != "").alias("n_chapter"), F.count_if(blank(F.col("section")) != "").alias("n_section"),
    )


def relevance(division: Column, name: Column) -> Column:
    """Points of a listed rule: keywords weigh more in the division than in the name, earlier ones more than later."""
    d, n = (F.replace(blank(c), F.lit(" "), F.lit("")) for c in (division, name))
    score = F.when(blank(name).contains("현행"), 5).otherwise(0)
    for i, word in enumerate(V.CORE_KEYWORDS):
        weight = max(1, len(V.CORE_KEYWORDS) - i)
        score = score + F.when(d.contains(word), 100 + weight).otherwise(0) + F.when(n.contains(word), 20 + weight).otherwise(0)
    return score


def select_core(listing: DataFrame, limit: int) -> DataFrame:
    """The rules of listing (name, key, division, source_url) to collect first, at most `limit`, with score and place.

    Past editions are out. Each of the eight areas gives up to a quota of rules not taken yet, then the
    best of the rest follow. What is not among the first limit * 9 of an area or of all can't be chosen,
    so at most that many rows come to the driver, where the areas take turns.
    """
    rows = listing.where(~blank(F.col("name")).rlike(PAST)).withColumn("score", relevance(F.col("division"), F.col("name"))).where("score > 0")
    order = [F.desc("score"), F.col("division"), F.col("name"), F.col("key").cast("long")]
    text = F.replace(F.concat("division", "name"), F.lit(" "), F.lit(""))
    rows = rows.withColumn("areas", F.array_compact(F.array(*[F.when(text.rlike("|".join(words)), i) for i, words in enumerate(V.CORE_DOMAINS)])))
    most, areas = limit * (len(V.CORE_DOMAINS) + 1), len(V.CORE_DOMAINS)
    each = rows.select("key", *[F.col(c) for c in ("score", "division", "name")], F.explode(F.concat("areas", F.array(F.lit(areas)))).alias("area"))
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("area").orderBy(*order))).where(F.col("rank") <= most)
    quota = max(1, min(3, limit // areas))
    taken: dict[str, int] = {}
    turns = dict.fromkeys(range(areas), 0)
    for r in ranked.orderBy("area", "rank").select("area", "key").collect():
        if len(taken) < limit and r.key not in taken and turns.get(r.area, -1) < quota:
            taken[r.key] = len(taken)
            if r.area in turns:
                turns[r.area] += 1
    chosen = listing.sparkSession.createDataFrame(list(taken.items()), "key string, place int")
    return rows.drop("areas").join(F.broadcast(chosen), "key")


def to_collect(listing: DataFrame, have: DataFrame) -> DataFrame:
    """Listed rules whose key is not there yet; current ones first, then by division and name."""
    return listing.join(have.select("key").distinct(), "key", "left_anti").orderBy(blank(F.col("name")).rlike(PAST), "division", "name")


def reconcile_names(articles: DataFrame, listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """articles with the listing's names for short numeric keys, and the keys that the listing no longer has."""
    names = listing.groupBy("key").agg(F.min("name").alias("__listed"))
    short = F.col("source_key").rlike(r"^\d{1,6}$")
    joined = articles.join(names, articles.source_key == names.key, "left")
    renamed = joined.withColumn("rule_name", F.when(short & F.col("__listed").isNotNull(), F.col("__listed")).otherwise(F.col("rule_name"))).drop("__listed", "key")
    gone = articles.where(short).select("source_key").distinct().join(names.select(F.col("key").alias("source_key")), "source_key", "left_anti")
    return renamed, gone


def same_ids(before: DataFrame, after: DataFrame) -> bool:
    """Whether two tables have the same record ids, each as often."""
    a, b = before.select("record_id"), after.select("record_id")
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
