"""WARC fixity audit by Merkle trees.

Records come from WARC files, split at their own lengths, or from pages laid out as WARC/1.0 records;
ordered by id and digest, each is hashed. A tree node
covers an ordered range of an archive: its digest is the hash of its children's keys, lengths and
digests, so of the offset ranges that follow from the lengths, and its length is their sum. The descent
carries each branch's first byte down, and reports the byte range of every record that differs. A node's key is a prefix of the records' keys, so the trees of two
replicas have the same shape even where records are missing or added, and both can be built where the
replica lies. The roots are compared first; below a node that is equal nothing is read.

A record's key is its id, eight bytes, high bit flipped, and the first bytes of its digest, as hex
digits. Equal records are one entry with a count. So a node has at most 256 children, or 4096 below
one id, also where that id (or the null id) stands on a third of all records. The root stands for the
digits that all keys of both replicas begin with.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ship import ship
from .runtime import cut, table

#: Hex digits of the id in a key, and of key and digest together; digits a level above the id and below it.
ID, KEY, STEP, SPREAD = 16, 22, 2, 3


def warc_record(record_id: Column, url: Column, payload: Column, date: str = "2024-01-01T00:00:00Z") -> Column:
    """Bytes of a WARC/1.0 response record. A null id or url is written as empty, a null payload as no bytes."""
    body = F.encode(F.coalesce(payload, F.lit("")), "UTF-8")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit(f"\r\nWARC-Date: {date}\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(F.encode(head, "UTF-8"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8"))


_BEGIN = re.compile(rb"WARC/\d+\.\d+\r\n")
_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$")
_ID = re.compile(rb"(?im)^warc-record-id:[ \t]*<?([^>\r\n]*?)>?[ \t]*\r?$")


def split_records(content: bytes) -> list[tuple[int, int, str | None, bool]]:
    """(offset, length, record id, whether it is sound) of each record of a WARC file, in order.

    A sound record has a version line, headers, as many bytes as its Content-Length says and the two line
    ends after them. What is not sound reaches to the next sound beginning, so all bytes are in some record.
    """
    out: list[tuple[int, int, str | None, bool]] = []

    def sound(at: int) -> tuple[int, str | None] | None:
        head = content.find(b"\r\n\r\n", at)
        if head < 0 or not _BEGIN.match(content, at):
            return None
        told, name = _LENGTH.search(content, at, head + 2), _ID.search(content, at, head + 2)
        end = head + 8 + int(told[1]) if told else len(content) + 1
        return (end, name[1].decode("utf-8", "replace") if name else None) if content[end - 4 : end] == b"\r\n\r\n" and end <= len(content) else None

    at = 0
    while at < len(content):
        found = sound(at)
        if found:
            out.append((at, found[0] - at, found[1], True))
            at = found[0]
            continue
        end = next((m.start() for m in _BEGIN.finditer(content, at + 1) if sound(m.start())), len(content))
        name = _ID.search(content, at, end)
        out.append((at, end - at, name[1].decode("utf-8", "replace") if name else None, False))
        at = end
    return out


def unzipped(content: bytes) -> bytes:
    """The bytes of a file of gzip members, or the content itself if it is none; what follows a broken member is lost with it."""
    parts = []
    while content[:2] == b"\x1f\x8b":
        one = zlib.decompressobj(31)
        try:
            parts.append(one.decompress(content))
        except zlib.error:
            break
        content = one.unused_data
    return b"".join(parts) or content


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, length, record_id, sound, sha) of all records of the WARC files at path, plain or of gzip members.

    Offsets of zipped files are those of their plain bytes. A file is read by one task.
    """
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                content = unzipped(raw.as_py())
                found = split_records(content)
                sha = [hashlib.sha256(content[a : a + n]).hexdigest() for a, n, _, _ in found]
                columns = [[file] * len(found), *([r[i] for r in found] for i in range(4)), sha]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "offset", "length", "record_id", "sound", "sha"])

    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return files.mapInArrow(run, "file string, offset bigint, length bigint, record_id string, sound boolean, sha string")


def of_files(found: DataFrame) -> DataFrame:
    """Records as `records` gives them, of what `read_warc` found: a page's number is the id, else a hash of the record id, null for none."""
    page = F.regexp_extract("record_id", r"^urn:page:(-?\d+)$", 1)
    number = F.when(page != "", page.cast("long")).otherwise(F.when(F.col("record_id").isNotNull() & (F.col("record_id") != "urn:page:"), F.xxhash64("record_id")))
    return keyed(found.select(number.alias("id"), "sha", "length"))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(id, key, sha, length, copies): equal records once. The pages' bytes are read here and not carried on.

    A null id has the key of sixteen zeros, as the lowest id would; their digests keep them apart.
    """
    raw = pages.select(F.col(id_col).cast("long").alias("id"), warc_record(F.col(id_col), F.col(url_col), F.col(payload_col)).alias("raw"))
    return keyed(raw.select("id", F.sha2("raw", 256).alias("sha"), F.octet_length("raw").cast("long").alias("length")))


def keyed(hashed: DataFrame) -> DataFrame:
    """(id, key, sha, length, copies) of hashed records (id, sha, length)."""
    one = hashed.groupBy("id", "sha", "length").agg(F.count(F.lit(1)).alias("copies"))
    flipped = F.coalesce(F.col("id"), F.lit(-(1 << 63)).cast("long")).bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
    return one.withColumn("key", F.concat(F.lower(F.lpad(F.hex(flipped), 16, "0")), F.substring("sha", 1, KEY - ID)))


def _parents(children: DataFrame, digits: int) -> DataFrame:
    """Nodes whose key is the first digits of their children's (key, sha, length)."""
    ordered = F.array_sort(F.collect_list(F.struct("key", "sha", "length")))
    text = F.array_join(F.transform(ordered, lambda c: F.concat_ws(":", c["key"], c["length"].cast("string"), c["sha"])), ",")
    nodes = children.groupBy(F.substring("key", 1, digits).alias("up")).agg(F.sha2(text, 256).alias("sha"), F.sum("length").alias("length"))
    return nodes.select(F.col("up").alias("key"), "sha", "length")


def shape(*replicas: DataFrame) -> list[int]:
    """Digits of the nodes' keys by level, from the root's: those that all records' keys begin with."""
    ends = [r.agg(F.min("key"), F.max("key")).first() for r in replicas]
    ends = [x for e in ends for x in e if x is not None]
    common = next((i for i, d in enumerate(zip(*ends)) if len(set(d)) > 1), ID) if ends else ID
    root = min(common, ID) // STEP * STEP
    return [*range(root, ID, STEP), *range(ID, KEY + 1, SPREAD)]


class Tree:
    """Levels of one replica, from the root down, in the shared folder."""

    def __init__(self, replica: DataFrame, widths: list[int]):
        """replica: from `records`; widths: from `shape` of all replicas that are to be compared."""
        self.records, self.widths = replica, widths
        # Records of one key (the same id, digests alike in their first digits) make its leaf.
        leaf = F.array_sort(F.collect_list(F.struct("id", "sha", "copies")))
        text = F.array_join(F.transform(leaf, lambda c: F.concat_ws(":", c["sha"], c["copies"].cast("string"))), ",")
        leaves = self.records.groupBy("key").agg(F.sha2(text, 256).alias("sha"), F.sum(F.col("length") * F.col("copies")).alias("length"))
        levels = [cut(leaves.select("key", "sha", "length"))]
        for digits in reversed(self.widths[:-1]):
            levels.append(cut(_parents(levels[-1], digits)))
        self.levels = levels[::-1]

    def root(self) -> tuple[str, int]:
        """Digest and length of the whole archive; of an empty one, that of no children and 0."""
        row = self.levels[0].first()
        return (row.sha, row.length) if row else ("", 0)


def audit(ours: Tree, theirs: Tree) -> DataFrame:
    """Rows on which two replicas differ: id, state (changed, missing, added or copies), sha, length and copies of either side, and our byte range.

    state: `changed` if both sides have records of the id with digests that the other lacks, `missing`
    if only we have the record, `added` if only they do, `copies` if its count differs. offset: bytes of
    our archive before the record, or, for an added one, before its place; ends: offset of the byte behind
    our copies of it, the same for an added one.
    """
    spark = ours.records.sparkSession
    # Branches that differ; base: bytes of our archive before the branch.
    keys = [t.levels[0].first() for t in (ours, theirs)]
    top = [k.key for k in keys if k is not None][:1]
    open_nodes = spark.createDataFrame([(k, 0) for k in top] if ours.root() != theirs.root() else [], "up string, base bigint")
    for k in range(1, len(ours.levels)):
        digits = ours.widths[k - 1]
        sides = []
        for tree, name in ((ours, "a"), (theirs, "b")):
            level = tree.levels[k].withColumn("up", F.substring("key", 1, digits))
            sides.append(level.join(open_nodes, "up", "left_semi" if name == "b" else "inner").select("up", "key", F.col("sha").alias(f"sha_{name}"), F.col("length").alias(f"length_{name}"), *(["base"] if name == "a" else [])))
        both = sides[0].drop("base").join(sides[1], ["up", "key"], "full")
        # A bounded number of children: their lengths, summed in order, give each child's own base.
        kids = both.groupBy("up").agg(F.array_sort(F.collect_list(F.struct("key", "sha_a", "sha_b", F.coalesce("length_a", F.lit(0)).alias("n")))).alias("kids"))
        kids = kids.join(open_nodes, "up").select("base", "kids", F.posexplode("kids").alias("i", "kid"))
        before = F.aggregate(F.slice("kids", 1, F.col("i")), F.lit(0).cast("long"), lambda s, c: s + c["n"])
        kids = kids.select("kid.*", (F.col("base") + before).alias("base"))
        open_nodes = cut(kids.where("not (sha_a <=> sha_b)").select(F.col("key").alias("up"), "base"))
    a = ours.records.join(open_nodes, ours.records.key == open_nodes.up).select("key", "id", "sha", "base", F.col("length").alias("length_a"), F.col("copies").alias("copies_a"))
    b = theirs.records.join(open_nodes, theirs.records.key == open_nodes.up).select("key", "id", "sha", F.col("base").alias("base_b"), F.col("length").alias("length_b"), F.col("copies").alias("copies_b"))
    met = a.withColumn("k", F.struct("id")).join(b.withColumn("k", F.struct("id")).drop("id"), ["key", "k", "sha"], "full").where("not (copies_a <=> copies_b)")
    met = met.withColumn("id", F.col("k.id"))
    sides = met.groupBy("k").agg(F.count_if(F.col("copies_b").isNull()).alias("__lost"), F.count_if(F.col("copies_a").isNull()).alias("__new"))
    state = (
        F.when(F.col("copies_a").isNotNull() & F.col("copies_b").isNotNull(), "copies")
        .when((F.col("__lost") > 0) & (F.col("__new") > 0), "changed")
        .when(F.col("copies_a").isNotNull(), "missing")
        .otherwise("added")
    )
    return met.join(sides, "k").select("id", state.alias("state"), "sha", F.coalesce("base", "base_b").alias("offset"), (F.coalesce("base", "base_b") + F.coalesce(F.col("length_a") * F.col("copies_a"), F.lit(0))).alias("ends"), F.coalesce("length_a", "length_b").alias("length"), F.coalesce("copies_a", F.lit(0)).alias("copies_here"), F.coalesce("copies_b", F.lit(0)).alias("copies_there"))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica of pages with known damage, by page_id: 7 of 100 changed at the end, 8 lost, 9 stored twice."""
    kind = F.coalesce(F.col("page_id") % 100, F.lit(0))
    html = F.when(kind == 7, F.concat(F.col("html"), F.lit(" "))).otherwise(F.col("html"))
    copies = F.when(kind == 9, 2).otherwise(1)
    rows = pages.where(kind != 8).withColumn("html", html).withColumn("__copy", F.explode(F.sequence(F.lit(1), copies)))
    return rows.drop("__copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of `pages` with what the audit against a damaged replica found: `intact` or a state of `audit`."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    replicas = [cut(records(p)) for p in (pages, damaged(pages))]
    ours, theirs = (Tree(r, shape(*replicas)) for r in replicas)
    found = cut(audit(ours, theirs))
    known = found.where("copies_here > 0").select(F.struct("id", "sha").alias("k"), "state", "offset", "ends", "copies_there")
    mine = ours.records.select(F.struct("id", "sha").alias("k"), F.col("id").alias("page_id"), "sha", "length", F.col("copies").alias("copies_here"))
    rows = mine.join(known, "k", "left").select("page_id", F.col("sha").alias("record_sha256"), "length", F.coalesce("state", F.lit("intact")).alias("state"), "offset", "ends", "copies_here", F.coalesce("copies_there", "copies_here").alias("copies_there"))
    other = found.where("copies_here = 0").select(F.col("id").alias("page_id"), F.col("sha").alias("record_sha256"), "length", "state", "offset", "ends", "copies_here", "copies_there")
    return rows.unionByName(other)


SQL = """
WITH a AS (
  SELECT page_id, url, html, page_id % 100 AS k FROM pages
), b AS (
  SELECT page_id, url, CASE WHEN k = 7 THEN html || ' ' ELSE html END AS html FROM a WHERE k <> 8
  UNION ALL SELECT page_id, url, html FROM a WHERE k = 9
), body AS (
  SELECT 'a' AS side, page_id, url, html FROM a UNION ALL SELECT 'b', page_id, url, html FROM b
), raw AS (
  SELECT side, page_id,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'WARC-Date: 2024-01-01T00:00:00Z' || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
    || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS r
  FROM body
), rec AS (
  SELECT page_id, sha256(r) AS sha, CAST(strlen(r) AS BIGINT) AS length, count(*) FILTER (side = 'a') AS copies_here, count(*) FILTER (side = 'b') AS copies_there
  FROM raw GROUP BY ALL
), placed AS (
  SELECT *, CAST(coalesce(sum(length * copies_here) OVER (ORDER BY page_id, substr(sha, 1, 6), sha ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begins,
    count(*) FILTER (copies_there = 0) OVER (PARTITION BY page_id) AS lost, count(*) FILTER (copies_here = 0) OVER (PARTITION BY page_id) AS new
  FROM rec
)
SELECT page_id, sha AS record_sha256, length,
  CASE WHEN copies_here = copies_there THEN 'intact' WHEN copies_here > 0 AND copies_there > 0 THEN 'copies'
       WHEN lost > 0 AND new > 0 THEN 'changed' WHEN copies_there = 0 THEN 'missing' ELSE 'added' END AS state,
  CASE WHEN copies_here = copies_there THEN NULL ELSE begins END AS offset,
  CASE WHEN copies_here = copies_there THEN NULL ELSE CAST(begins + length * copies_here AS BIGINT) END AS ends,
  copies_here, copies_there
FROM placed
"""
