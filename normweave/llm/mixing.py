"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Time is cut into slots, one block of rows each. In the ideal mixture every source that still has blocks
gets its weight's share of each moment; a block's release is the slot in which the ideal begins it, its
deadline the slot by which the ideal has done it. Slot by slot the released block of the earliest deadline
is taken. That keeps every deadline, so at any time each source is less than one block from the share that
its exact weight gives it, however long the run; nothing is rounded to a period.

Slots depend on those before them, so windows of slots are scheduled side by side from the states that
earliest-deadline-first most likely has there, and a window whose guess was wrong is run again from the
end of the one before, until all windows meet. A window is one row; its state is a count for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import let
from .runtime import cut, table

#: Slots of a window, rows of a block, and the power of a source's size that its default weight follows.
WINDOW, BLOCK, POWER = 1024, 16, 0.5
#: Chunks into which the rows of one source are spread to be numbered, and blocks of a row's copies that are dealt out together.
CHUNKS, RANGE = 4096, 4096
#: What floating-point sums may be off a whole number.
EPS = 1e-9


def _key(source: Column) -> Column:
    """A text for each source, the null source included."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def ideal(sizes: DataFrame, block: int) -> DataFrame:
    """One row for each tier of sizes (key, n, x, tier): arrays over its sources in the order in which the ideal ends them.

    b: blocks, short: rows that the last block lacks, e: when a source ends if it gets x blocks in a unit of
    time; slots that are done by then (f), slots of ended sources (sb) and the weight of the others (sx).
    """
    one = sizes.withColumn("b", F.ceil(F.col("n") / block)).withColumn("short", F.col("b") * block - F.col("n")).withColumn("e", F.col("b") / F.col("x"))
    order = Window.partitionBy("tier").orderBy("e", "key")
    one = one.withColumn("at", F.row_number().over(order)).withColumn("sb", F.coalesce(F.sum("b").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    one = one.withColumn("sx", F.sum("x").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))).withColumn("f", F.col("sb") + F.col("e") * F.col("sx"))
    of = one.groupBy("tier").agg(F.array_sort(F.collect_list(F.struct("at", "key", "n", "x", "b", "short", "e", "sb", "sx", "f"))).alias("of"), F.sum("b").alias("slots"), F.sum("n").alias("rows"))
    before = Window.orderBy("tier").rowsBetween(Window.unboundedPreceding, -1)
    offset = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("slots", "rows")]
    return of.select("tier", "slots", *offset, *[F.col(f"of.{c}").alias(c) for c in ("key", "x", "b", "short", "e", "sb", "sx", "f")])


def _time(slots: Column) -> Column:
    """When the ideal has done so many slots."""
    at = F.least(F.size(F.filter("f", lambda f: f < slots)), F.size("f") - 1)
    return let(at, lambda p: (slots - F.get("sb", p)) / F.get("sx", p))


def _slots(time: Column) -> Column:
    """Slots that the ideal has done by a time."""
    at = F.size(F.filter("e", lambda e: e < time))
    return let(at, lambda p: F.when(p == F.size("e"), F.col("slots").cast("double")).otherwise(F.get("sb", p) + time * F.get("sx", p)))


def guess(slots: Column) -> Column:
    """Blocks of each source after so many slots: what the ideal has done, and the earliest deadlines of what it has begun."""

    def state(time: Column) -> Column:
        done = F.zip_with("x", "b", lambda x, b: F.struct(x.alias("x"), F.least(b.cast("double"), x * time).alias("y")))
        done = F.transform(done, lambda d: F.struct(d["x"].alias("x"), d["y"].alias("y"), F.floor(d["y"] + EPS).alias("whole")))

        def pick(done: Column) -> Column:
            begun = F.filter(F.transform(done, lambda d, i: F.struct(((d["whole"] + 1) / d["x"]).alias("due"), i.alias("i"), (d["y"] > d["whole"] + EPS).alias("open"))), lambda d: d["open"])
            left = slots - F.aggregate(done, F.lit(0).cast("long"), lambda n, d: n + d["whole"])
            ahead = F.slice(F.transform(F.array_sort(begun), lambda d: d["i"]), F.lit(1), left.cast("int"))
            return let(ahead, lambda ahead: F.transform(done, lambda d, i: d["whole"] + F.when(F.array_contains(ahead, i), 1).otherwise(0)))

        return let(done, pick)

    return let(_time(slots), state)


def run(windows: DataFrame, window: int) -> DataFrame:
    """windows (tier, nr, start and the ideal) with `end`, the state after them, and `picks`: source, its block, and rows that blocks before it lack."""
    kind = "struct<done:array<bigint>,lacks:bigint,picks:array<struct<i:int,nth:bigint,lacks:bigint>>>"
    lacks = F.aggregate(F.zip_with(F.zip_with("start", "b", lambda c, b: c == b), "short", lambda ended, s: F.when(ended, s).otherwise(0)), F.lit(0).cast("long"), lambda n, s: n + s)
    begin = F.struct(F.col("start").alias("done"), lacks.alias("lacks"), F.array().cast("array<struct<i:int,nth:bigint,lacks:bigint>>").alias("picks")).cast(kind)

    def step(state: Column, slot: Column) -> Column:
        def choose(time: Column) -> Column:
            # Released are the blocks that the ideal has begun by the end of the slot.
            free = F.transform(
                F.zip_with(F.zip_with("x", "b", lambda x, b: F.struct(x.alias("x"), b.alias("b"))), state["done"], lambda s, c: F.struct(s["x"].alias("x"), s["b"].alias("b"), c.alias("c"))),
                lambda s, i: F.struct(F.when((s["c"] < s["b"]) & (s["x"] * time > s["c"] + EPS), (s["c"] + 1) / s["x"]).alias("due"), i.alias("i")),
            )
            return F.array_min(F.filter(free, lambda s: s["due"].isNotNull()))["i"]

        def take(i: Column) -> Column:
            nth = F.get(state["done"], i)
            picks = F.concat(state["picks"], F.array(F.struct(i.alias("i"), nth.alias("nth"), state["lacks"].alias("lacks"))))
            more = F.when(nth + 1 == F.get("b", i), F.get("short", i)).otherwise(0)
            return F.struct(F.transform(state["done"], lambda c, at: F.when(at == i, c + 1).otherwise(c)).alias("done"), (state["lacks"] + more).alias("lacks"), picks.alias("picks")).cast(kind)

        return let(let(_time(slot), choose), take)

    first = F.col("nr") * window
    ran = F.aggregate(F.sequence(first + 1, F.least(first + window, F.col("slots"))), begin, step)
    return windows.withColumn("ran", ran).withColumn("end", F.col("ran.done")).withColumn("picks", F.col("ran.picks")).drop("ran")


def schedule(sizes: DataFrame, block: int = BLOCK, window: int = WINDOW) -> DataFrame:
    """(key, block, release, deadline, slot, position) of every block of sizes (key, n, x, tier); tiers follow one another.

    position: rows before the block. The state of a window has an entry for each source: a run costs
    slots times sources, spread over its windows.
    """
    of = ideal(sizes, block)
    spread = of.withColumn("nr", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / window)))).repartition("tier", "nr")
    now = cut(run(spread.withColumn("start", guess(F.col("nr") * window)), window))
    while True:
        ends = now.select("tier", (F.col("nr") + 1).alias("nr"), F.col("end").alias("met"))
        wrong = now.join(ends, ["tier", "nr"]).where("start != met")
        again = cut(run(wrong.drop("start", "end", "picks").withColumnRenamed("met", "start"), window))
        if again.isEmpty():
            break
        now = cut(now.join(again.select("tier", "nr"), ["tier", "nr"], "left_anti").unionByName(again))
    taken = now.select("*", F.posexplode("picks").alias("at", "pick")).withColumn("place", F.col("nr") * window + F.col("at"))
    x, nth = F.get("x", F.col("pick.i")), F.col("pick.nth")
    slot = F.col("slots_before") + F.col("place")
    return taken.select(
        F.get("key", F.col("pick.i")).alias("key"), nth.alias("block"),
        (F.col("slots_before") + F.floor(_slots(nth / x) + EPS)).alias("release"), (F.col("slots_before") + F.ceil(_slots((nth + 1) / x) - EPS)).alias("deadline"),
        slot.alias("slot"), (F.col("rows_before") + F.col("place") * block - F.col("pick.lacks")).alias("position"),
    )


def numbered(rows: DataFrame) -> DataFrame:
    """rows (key, id) as (key, id, start, copies): equal rows are one, numbered inside their key from start.

    A key's rows are spread over chunks by hash, counted by chunk, and numbered inside chunks, so no
    task gets a whole key. The order inside a key is that of the hash.
    """
    hashed = F.xxhash64("id")
    one = rows.groupBy("key", "id").agg(F.count(F.lit(1)).alias("copies")).withColumn("h", hashed).withColumn("chunk", F.pmod(F.shiftrightunsigned("h", 20), F.lit(CHUNKS)))
    chunk = Window.partitionBy("key", "chunk")
    earlier = chunk.orderBy("h", F.asc_nulls_first("id")).rowsBetween(Window.unboundedPreceding, -1)
    inside = one.withColumn("inside", F.coalesce(F.sum("copies").over(earlier), F.lit(0)))
    sizes = one.groupBy("key", "chunk").agg(F.sum("copies").alias("n"))
    before = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("key", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return inside.join(sizes, ["key", "chunk"]).select("key", "id", (F.col("first") + F.col("inside")).alias("start"), "copies")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, window: int = WINDOW, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """(id, source, block, release, deadline, slot, position): one row for each row of docs.

    position counts from 0 without gaps in the order of the mixture. weights: of sources, in any unit;
    sources without a positive weight come after all others, mixed among themselves as if no weights were
    given. Without weights a source weighs the square root of its rows. When a source has run out the
    others share its slots in proportion. The null source is a source; null ids are ids; repeated rows are
    placed one after another. An empty table gives no rows. Other columns of docs, whatever their names,
    are not read.
    """
    rows = docs.select(_key(F.col(source_col)).alias("key"), F.col(id_col).alias("id"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    given = F.lit(None).cast("double")
    if weights:
        pairs = [F.lit(x) for k, v in sorted(weights.items()) if v > 0 for x in ("s" + k, float(v))]
        given = F.try_element_at(F.create_map(*pairs), F.col("key")) if pairs else given
    sizes = sizes.select("key", "n", F.coalesce(given, F.pow(F.col("n").cast("double"), F.lit(POWER))).alias("x"), given.isNull().cast("int").alias("tier"))
    blocks = cut(schedule(sizes, block, window))
    # A row's copies lie in consecutive blocks; those of a row with very many are dealt out in ranges.
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("copies") - 1) / block)
    placed = numbered(rows).withColumn("range", F.explode(F.sequence(F.floor(first / RANGE), F.floor(last / RANGE)))).repartition("key", "range", "start")
    placed = placed.withColumn("block", F.explode(F.sequence(F.greatest(first, F.col("range") * RANGE), F.least(last, F.col("range") * RANGE + RANGE - 1))))
    met = placed.join(blocks, ["key", "block"])
    inside = F.sequence(F.greatest(F.col("start"), F.col("block") * block), F.least(F.col("start") + F.col("copies"), (F.col("block") + 1) * block) - 1)
    met = met.withColumn("rank", F.explode(inside))
    source = F.when(F.col("key") == "n", F.lit(None)).otherwise(F.substring("key", 2, 1 << 30)).cast(docs.schema[source_col].dataType)
    return met.select(F.col("id").alias(id_col), source.alias("source"), "block", "release", "deadline", "slot", (F.col("position") + F.col("rank") % block).alias("position"))


def in_order(docs: DataFrame, **options) -> DataFrame:
    """All rows and columns of docs in the order of the mixture: partitions are ranges of position."""
    columns = docs.columns
    plan = mix(docs, **options).groupBy("doc_id", _key(F.col("source")).alias("__key")).agg(F.min("position").alias("__position"))
    keyed = docs.withColumn("__key", _key(F.col("source"))).withColumn("__id", F.struct("doc_id"))
    plan = plan.withColumn("__id", F.struct("doc_id")).drop("doc_id")
    return keyed.join(plan, ["__id", "__key"]).orderBy("__position").select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
