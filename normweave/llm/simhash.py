"""SimHash near-duplicates, compared by bit planes.

Fingerprints that share enough of their bits meet in a bucket: the 64 bits are cut into radius + 2
blocks, and two fingerprints within the radius agree in two blocks at least, so one table for each
pair of blocks misses no link. Inside a bucket the fingerprints are held as 64 bit planes, 64 of them
to a machine word. Differences are counted for all lanes of a word at once by a carry-save counter;
lanes that pass the radius set a sticky overflow bit, and a block of lanes is left as soon as all have
overflowed.

Equal fingerprints are one node from the start, so copies cost nothing. A bucket of more than CELL
fingerprints is cut into slots, and each pair of slots is compared in a task of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ship import ship
from .graph import components, contracted
from .runtime import cut, forget, in_few, pack, pieces, table, unpack

#: Fingerprints of a slot of a hot bucket; queries, and lanes in words, that are compared at a time.
CELL, QUERIES, LANES = 4096, 256, 64
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_BYTES = np.uint64(0x0101010101010101)


# Fingerprints


def shingles(text: str, width: int) -> list[bytes]:
    words = text.encode("utf-8", "replace").lower().split()
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(width)))))


def hashes(texts: list[str], width: int) -> list[np.ndarray]:
    """XXH64 of each text's shingles, repeats included."""
    return [np.fromiter(map(xxhash.xxh64_intdigest, s, repeat(42)), np.uint64, len(s)) for s in (shingles(t, width) for t in texts)]


def fingerprints(texts: list[str], width: int) -> np.ndarray:
    return majority(hashes(texts, width))


def majority(hashed: list[np.ndarray]) -> np.ndarray:
    """Of each text the bits set in over half its shingles' hashes; zero without words."""
    sizes = np.array([len(h) for h in hashed], np.int64)
    out = np.zeros(len(hashed), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    h, sizes = np.concatenate(hashed), sizes[full]
    starts = np.cumsum(sizes) - sizes
    # Runs of at most 255 hashes, whose bits can be summed in the bytes of a word.
    runs = -(-sizes // 255)
    first = np.cumsum(runs) - runs
    at = np.repeat(starts, runs) + 255 * (np.arange(runs.sum()) - np.repeat(first, runs))
    for b in range(8):
        lanes = np.add.reduceat((h >> np.uint64(b)) & _BYTES, at).view(np.uint8).reshape(-1, 8)
        counts = np.add.reduceat(lanes.astype(np.int64), first, axis=0)
        for byte in range(8):
            out[full] |= (2 * counts[:, byte] > sizes).astype(np.uint64) << np.uint64(8 * byte + b)
    return out


def with_fingerprint(docs: DataFrame, width: int = 3, text_col: str = "text", keep: list[str] | None = None, name: str = "fingerprint") -> DataFrame:
    """The columns keep (all but the text and a namesake) and the fingerprint (long, its bits signed). A null text has no words."""
    keep = [c for c in docs.columns if c not in (text_col, name)] if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            made = fingerprints([t.as_py() or "" for t in batch.column(len(keep))], width).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(made)], names=[*keep, name])

    ship(docs.sparkSession)
    kinds = dict(docs.dtypes)
    return docs.select(*keep, docs[text_col]).mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"{name} bigint"]))


# Comparison


def planes(values: np.ndarray) -> np.ndarray:
    """64 rows of words; bit i of a row is that row's bit of the i-th value. Lanes past the end are zero."""
    n = -(-len(values) // 64) * 64
    padded = np.zeros(n, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def _bits(lanes: np.ndarray) -> np.ndarray:
    """Flags of lanes as words, padded with ones: lanes past the end are out from the start."""
    short = -lanes.shape[-1] % 64
    full = np.concatenate([lanes, np.ones((*lanes.shape[:-1], short), bool)], axis=-1)
    return np.packbits(full, axis=-1, bitorder="little").view(np.uint64)


def beyond(differences: Callable[[int, np.ndarray], np.ndarray], over: np.ndarray, radius: int, seen: list[int] | None = None) -> np.ndarray:
    """Lanes in which over `radius` of 64 planes are set, as bits; lanes set in `over` are out from the start.

    differences(p, at): words of plane p, for the words numbered `at` only. Counters start so that the carry
    out of their top bit means just that; it stays set. A word all of whose lanes are out is left at the next
    look, after every 8 planes. seen: gets the number of words that each plane was read for.
    """
    bits = radius.bit_length()
    preset = (1 << bits) - 1 - radius
    out, at = over.copy(), np.flatnonzero(over != _ALL)
    over = out[at]
    counters = [np.full(len(at), _ALL if preset >> i & 1 else np.uint64(0)) for i in range(bits)]
    for p in range(64):
        if p % 8 == 0 and p:
            stay = over != _ALL
            if not stay.all():
                out[at] = over
                at, over, counters = at[stay], over[stay], [c[stay] for c in counters]
        if not len(at):
            break
        if seen is not None:
            seen.append(len(at))
        carry = differences(p, at)
        for c in counters:
            c ^= carry
            carry = carry & ~c
        over |= carry
    out[at] = over
    return out


def _lanes(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), axis=-1, bitorder="little")[..., :n].astype(bool)


def close_pairs(left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Of each pair (left[i], right[i]) whether it is within the radius."""
    out = np.zeros(len(left), bool)
    for at in range(0, len(left), 64 * LANES):
        x = planes(left[at : at + 64 * LANES] ^ right[at : at + 64 * LANES])
        n = min(64 * LANES, len(left) - at)
        out[at : at + n] = ~_lanes(beyond(lambda p, k: x[p][k], _bits(np.zeros(n, bool)), radius), n)
    return out


def close_block(queries: np.ndarray, block: np.ndarray, radius: int, out: np.ndarray | None = None, seen: list[int] | None = None) -> np.ndarray:
    """Matrix of the queries against all lanes of a block of planes of `block`, but for the pairs that `out` excludes."""
    x = planes(block)
    flip = np.where(queries[:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1), _ALL, np.uint64(0))
    words, n = x.shape[1], len(block)
    start = _bits(np.zeros((len(queries), n), bool) if out is None else out)
    far = beyond(lambda p, k: x[p][k % words] ^ flip[:, p][k // words], start.ravel(), radius, seen).reshape(len(queries), words)
    return ~_lanes(far, n)


def _join(label: np.ndarray, members: np.ndarray) -> None:
    roots = np.unique(label[members])
    if len(roots) > 1:
        label[np.isin(label, roots)] = roots[0]


def link_run(values: np.ndarray, side: np.ndarray, radius: int) -> np.ndarray:
    """Labels of one bucket's distinct values; equal labels are linked inside the bucket.

    side: the slot of each value; with two slots only pairs across them are compared.
    """
    label = np.arange(len(values))
    crossed = side[0] != side[-1]
    queries = np.flatnonzero(side == side[0]) if crossed else np.arange(len(values))
    for at in range(0, len(queries), QUERIES):
        q = queries[at : at + QUERIES]
        for start in range(0, len(values), 64 * LANES):
            part = np.arange(start, min(len(values), start + 64 * LANES))
            part = part[side[part] != side[0]] if crossed else part[part >= q[0]]
            if len(part):
                close = close_block(values[q], values[part], radius, part[None, :] <= q[:, None] if not crossed else None)
                for i in np.flatnonzero(close.any(axis=1)):
                    _join(label, np.append(part[close[i]], q[i]))
    return label


def link_sorted(keys: np.ndarray, side: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that join what is within the radius inside runs of equal keys; runs are whole."""
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
    sizes = np.diff(np.append(starts, len(keys)))
    ends = np.repeat(starts + sizes, sizes)
    a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    small = np.repeat(sizes <= 32, sizes)
    shift, at = 1, np.flatnonzero(small)
    while len(at := at[at + shift < ends[at]]):  # all small runs at once: each value with the one `shift` behind it
        ok = at[close_pairs(values[at], values[at + shift], radius)]
        a.append(values[ok])
        b.append(values[ok + shift])
        shift += 1
    for s, n in zip(starts[sizes > 32], sizes[sizes > 32]):
        label = link_run(values[s : s + n], side[s : s + n], radius)
        other = np.flatnonzero(label != np.arange(n))
        a.append(values[s + label[other]])
        b.append(values[s + other])
    return np.concatenate(a), np.concatenate(b)


def block_masks(radius: int) -> list[int]:
    """One mask for each pair of the radius + 2 blocks of the 64 bits."""
    n = radius + 2
    edges = [64 * i // n for i in range(n + 1)]
    block = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(n)]
    return [x | y for x, y in combinations(block, 2)]


def in_runs(keys: DataFrame, compare: Callable[[np.ndarray, np.ndarray, list[np.ndarray]], tuple[np.ndarray, np.ndarray]], sets: DataFrame | None = None) -> DataFrame:
    """Links (a, b) that compare finds in the buckets of keys (t, k, and long columns), over runs as in `link_sorted`.

    compare(number of the run, slot, columns): sorted by run, slot and columns, runs whole. Buckets of one
    are left out; hot ones are cut into slots, and each pair of slots becomes a run. sets (node, shingles):
    what compare gets as last column for each node of keys.
    """
    columns = keys.columns[2:]
    sizes = keys.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    cells = keys.join(sizes, ["t", "k"]).withColumn("slots", F.ceil(F.col("n") / CELL).cast("int"))
    cells = cells.withColumn("slot", F.pmod(F.xxhash64(*columns, "t"), F.col("slots")).cast("int"))
    carried = columns
    if sets is not None:
        cells, carried = cells.join(sets, "node"), [*columns, "shingles"]
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
    cells = cells.select("t", "k", F.least("slot", "other").alias("lo"), F.greatest("slot", "other").alias("hi"), "slot", *carried)
    runs = cells.repartition("t", "k", "lo", "hi").sortWithinPartitions("t", "k", "lo", "hi", "slot", *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []

        def link(rows: list[np.ndarray]) -> pa.RecordBatch:
            t, k, lo, hi, slot, *held = rows
            change = np.append(False, (t[1:] != t[:-1]) | (k[1:] != k[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in compare(np.cumsum(change), slot, held)], names=["a", "b"])

        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if kept:
                rows = [np.concatenate(x) for x in zip(kept, rows)]
            if not len(rows[0]):
                continue
            same = np.logical_and.reduce([r == r[-1] for r in rows[:4]])  # the last run may go on in the next batch
            cut_at = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            kept = [r[cut_at:].copy() for r in rows]
            if cut_at:
                yield link([np.ascontiguousarray(r[:cut_at]) for r in rows])
        if kept:
            yield link(kept)

    return runs.mapInArrow(run, "a bigint, b bigint")


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of `fingerprint` within the radius."""
    signed = [m - (1 << 64) if m >> 63 else m for m in block_masks(radius)]
    keys = distinct.select("fingerprint", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fingerprint").bitwiseAND(F.lit(m).cast("long")).alias("k")) for i, m in enumerate(signed)])).alias("x")).select("x.*", "fingerprint")
    return in_runs(keys, lambda number, slot, held: link_sorted(number, slot, held[0].view(np.uint64), radius))


def group(prints: DataFrame, radius: int = 3) -> DataFrame:
    """(fingerprint, component_id) of prints (doc_id, fingerprint): the smallest doc_id reachable.

    A null doc_id is linked like any other and never the smallest; a component of nulls alone has the
    null id. Repeated rows and equal fingerprints are one node. An empty table gives no rows.
    """
    nodes = cut(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")))
    roots = components(links(nodes.select("fingerprint"), radius))
    rooted = nodes.join(roots, nodes.fingerprint == roots.node, "left").select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(least, "root").select("fingerprint", "component_id", "root")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): one row for each row of docs, its 64 bits as 16 hex digits.

    Texts without words have the fingerprint zero and are linked like others. See `group` for nulls.
    """
    prints = cut(with_fingerprint(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), width, "text", ["doc_id"]))
    grouped = group(prints, radius)
    return prints.join(grouped, "fingerprint").select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


# Near copies by similarity

#: Words of a shingle, least similarity, and how far apart fingerprints of such texts may be (9.7 bits on average at 0.8).
WIDTH, SIMILAR, FAR = 5, 0.8, 20
#: Bands and the least hashes in each, by which similar texts meet: at 0.8 all but 4 of 10,000 pairs do.
BANDS, ROWS = 20, 5
#: Texts of a bucket up to which all close pairs are candidates at once; parts into which the members of one text's candidates are dealt;
#: times as many candidates of a text that are tested in each next round; sets of a bucket that are multiplied with queries at a time.
FEW, SALTS, MORE, SETS = 8, 64, 16, 512

_TURNS = np.random.default_rng(71).integers(1, 1 << 63, (2, BANDS * ROWS), np.uint64) | np.uint64(1)


def bands(hashed: list[np.ndarray]) -> list[np.ndarray]:
    """Of each text a key for each band of its least hashes; none without words."""
    sizes = np.array([len(h) for h in hashed], np.int64)
    full = np.flatnonzero(sizes)
    out = [np.zeros(0, np.uint64)] * len(hashed)
    if len(full):
        h, starts = np.concatenate(hashed), np.cumsum(sizes[full]) - sizes[full]
        key = np.zeros((len(full), BANDS), np.uint64)
        for i in range(BANDS * ROWS):
            least = np.minimum.reduceat((h ^ _TURNS[0, i]) * _TURNS[1, i], starts)
            k = (key[:, i // ROWS] ^ least) * np.uint64(0x9E3779B97F4A7C15)
            key[:, i // ROWS] = k ^ (k >> np.uint64(31))
        for row, k in zip(full, key):
            out[row] = k
    return out


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, node, fingerprint, bands) of docs (doc_id, text): node is a hash of all words, so texts of the same words are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = [t.as_py() or "" for t in batch.column(1)]
            hashed = hashes(texts, WIDTH)
            keys = bands(hashed)
            ends = np.cumsum([0, *map(len, keys)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node_of(texts)), pa.array(majority(hashed).view(np.int64)), lists], names=["doc_id", "node", "fingerprint", "bands"])

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, node bigint, fingerprint bigint, bands array<bigint>")


def node_of(texts: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(b" ".join(t.encode("utf-8", "replace").lower().split())) for t in texts], np.uint64).view(np.int64)


def _centred(number: np.ndarray, slot: np.ndarray, held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Candidates (a, b): of small runs all close pairs, of others each text with the one that most are close to, and with its nearest."""
    prints, nodes = held[0].view(np.uint64), held[1]
    starts = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
    sizes = np.diff(np.append(starts, len(number)))
    ends = np.repeat(starts + sizes, sizes)
    first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]  # places of candidates
    shift, at = 1, np.flatnonzero(np.repeat(sizes <= FEW, sizes))
    while len(at := at[at + shift < ends[at]]):
        ok = at[close_pairs(prints[at], prints[at + shift], FAR)]
        first.append(ok)
        second.append(ok + shift)
        shift += 1
    for s, n in zip(starts[sizes > FEW], sizes[sizes > FEW]):
        values, mine, nearest = prints[s : s + n], np.zeros(n, np.int64), np.full(n, -1)
        for x in range(0, n, QUERIES // 4):
            q = np.arange(x, min(n, x + QUERIES // 4))
            best = np.full(len(q), 65)
            for y in range(0, n, 64 * LANES):
                part = np.arange(y, min(n, y + 64 * LANES))
                i, j = np.nonzero(close_block(values[q], values[part], FAR, part[None, :] == q[:, None]))
                mine[q] += np.bincount(i, minlength=len(q))
                apart = np.bitwise_count(values[q[i]] ^ values[part[j]]).astype(np.int64)
                order = np.lexsort((apart, i))
                i, j, apart = i[order], j[order], apart[order]
                lead = np.flatnonzero(np.append(True, i[1:] != i[:-1])[: len(i)])
                better = lead[apart[lead] < best[i[lead]]]
                best[i[better]], nearest[q[i[better]]] = apart[better], part[j[better]]
        centre = np.full(n, -1)
        for r in np.lexsort((nodes[s : s + n], -mine)).tolist():  # the most central first; a text that no centre is close to becomes one
            if centre[r] < 0 and mine[r]:
                centre[np.flatnonzero(close_block(values[[r]], values, FAR)[0] & (centre < 0))] = r
        for other in (centre, nearest):
            ok = np.flatnonzero((other >= 0) & (other != np.arange(n)))
            first.append(s + other[ok])
            second.append(s + ok)
    x, y = np.concatenate(first), np.concatenate(second)
    return nodes[x], nodes[y]


def _across(number: np.ndarray, slot: np.ndarray, held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Candidates (a, b): all close pairs of a run whose texts are in different classes; of a run of two slots those across them.

    With packed shingles as last column of held, links: the pairs are verified here, and for those that are SIMILAR
    one pair of texts comes out of every two classes that they join, so fewer than the run has texts.
    """
    prints, nodes, roots = held[0].view(np.uint64), held[1], held[2]
    starts = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
    first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s, n in zip(starts, np.diff(np.append(starts, len(number)))):
        values, side = prints[s : s + n], slot[s : s + n]
        _, root = np.unique(roots[s : s + n], return_inverse=True)  # of each text its class's number
        shared = _Shared([_read(raw) for raw in held[3][s : s + n]]) if len(held) > 3 else None
        crossed = side[0] != side[-1]
        for x in range(0, n, QUERIES // 4):
            q = np.arange(x, min(n, x + QUERIES // 4))
            for y in range(x, n, 64 * LANES):
                part = np.arange(y, min(n, y + 64 * LANES))
                out = (root[part][None, :] == root[q][:, None]) | (part[None, :] <= q[:, None])
                if crossed:
                    out |= side[part][None, :] == side[q][:, None]
                if out.all():
                    continue
                i, j = np.nonzero(close_block(values[q], values[part], FAR, out))
                if shared is not None and len(i):
                    i, j = (z[shared.similar(q[i], part[j])] for z in (i, j))
                    u, v = contracted(root[q[i]], root[part[j]])
                    # One text of each class: the classes that are joined now, by their smallest numbers.
                    one = np.zeros(root.max() + 1, np.int64)
                    one[root] = np.arange(n)
                    first.append(s + one[v])
                    second.append(s + one[u])
                    to = np.arange(len(one))
                    to[u] = v
                    root = to[root]
                else:
                    first.append(s + q[i])
                    second.append(s + part[j])
    x, y = np.concatenate(first), np.concatenate(second)
    return nodes[x], nodes[y]


def _read(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw, np.uint32), dtype=np.uint32)


class _Shared:
    """Sets of one run, as columns of a matrix: a value for each that stands in several sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets], np.int64)
        _, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        several = times > 1
        kept = several[number]
        self.column = (np.cumsum(several) - 1)[number[kept]]
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(np.repeat(np.arange(len(sets)), self.sizes)[kept], minlength=len(sets)))])
        self.place = np.full(int(several.sum()), -1, np.int32)

    def rows(self, members: np.ndarray, columns: int) -> np.ndarray:
        """The members' sets as 0 and 1, in the columns that have a place."""
        each = [self.place[self.column[self.ends[m] : self.ends[m + 1]]] for m in members]
        at, row = np.concatenate(each), np.repeat(np.arange(len(members)), [len(e) for e in each])
        out = np.zeros((len(members), columns), np.float32)
        out[row[at >= 0], at[at >= 0]] = 1
        return out

    def similar(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of each pair (left[i], right[i]) whether it is SIMILAR or more."""
        a, i = np.unique(left, return_inverse=True)
        b, j = np.unique(right, return_inverse=True)
        used = np.unique(np.concatenate([self.column[self.ends[m] : self.ends[m + 1]] for m in a]))
        self.place[used] = np.arange(len(used))
        mine, both = self.rows(a, len(used)), np.zeros((len(a), len(b)), np.float32)
        for y in range(0, len(b), SETS):
            both[:, y : y + SETS] = mine @ self.rows(b[y : y + SETS], len(used)).T
        self.place[used] = -1
        shared = both[i, j].astype(np.int64)
        return shared >= SIMILAR * (self.sizes[left] + self.sizes[right] - shared)


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles) of nodes (node, doc_id): the sorted distinct hashes' high 32 bits, read again from the documents of these ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = [t.as_py() or "" for t in batch.column(1)]
            found = node_of(texts)
            mine = [k for k, wanted in enumerate(batch.column(0).to_pylist()) if wanted == found[k]]
            sets = [pack(np.diff(_distinct((h >> np.uint64(32)).astype(np.uint32)), prepend=np.uint32(0))) for h in hashes([texts[k] for k in mine], WIDTH)]
            yield pa.RecordBatch.from_arrays([pa.array(found[mine]), pa.array(sets, pa.binary())], names=["node", "shingles"])

    wanted = nodes.select("node", F.col("doc_id").alias("__id"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("__id"))).select("node", "text")
    return rows.mapInArrow(run, "node bigint, shingles binary").dropDuplicates(["node"])


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])[: len(x)]]


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, shingles of a, of b) those pairs that are SIMILAR or more."""
    for batch in pieces(batches):
        good = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, y = _read(x), _read(y)
            shared = len(x) + len(y) - len(_distinct(np.concatenate([x, y])))
            good.append(shared >= SIMILAR * (len(x) + len(y) - shared))
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are SIMILAR or more. The members of one text's pairs are dealt to several tasks."""
    parted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    left = parted.select("a", "salt").distinct().join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    held = parted.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b").join(left, ["a", "salt"])
    return held.select("a", "b", "x", "y").mapInArrow(_alike, "a bigint, b bigint")


def _joined(found: DataFrame, sets: DataFrame) -> DataFrame | None:
    """(node, root of its class, unless it is the root) after joining those of the candidates found that are SIMILAR; None: no class of several."""
    spark, roots = sets.sparkSession, None
    degree = found.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    # Of a pair, a is the one with more candidates.
    both = found.join(degree.select(F.col("node").alias("a"), F.col("n").alias("n_a")), "a").join(degree.select(F.col("node").alias("b"), F.col("n").alias("n_b")), "b")
    turn = (F.col("n_b") > F.col("n_a")) | ((F.col("n_b") == F.col("n_a")) & (F.col("b") < F.col("a")))
    todo = cut(both.select(F.when(turn, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("b"), F.greatest("n_a", "n_b").alias("n")))
    del both, degree
    forget(spark)
    most = 1
    while n := todo.count():
        todo = in_few(todo, n)
        rank = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("n"), "a"))
        ranked = todo.withColumn("rank", rank)
        good = cut(_verified(ranked.where(F.col("rank") <= most).select("a", "b"), sets))
        todo = ranked.where(F.col("rank") > most).drop("rank")
        if n := good.count():  # classes are stars already, so these and the new links take few rounds
            good = in_few(good, n)
            roots = components(good if roots is None else good.unionByName(roots.toDF("a", "b")))
        if roots is not None:  # texts that are in one class by now need no test
            x, y = (roots.select(F.col("node").alias(c), F.col("root").alias(f"r_{c}")) for c in "ab")
            todo = todo.join(x, "a", "left").join(y, "b", "left").where(F.coalesce("r_a", "a") != F.coalesce("r_b", "b")).select("a", "b", "n")
        todo, most = cut(todo), MORE * most
        del ranked, good
        forget(spark)
    return roots


def similar(docs: DataFrame) -> DataFrame:
    """(doc_id, node, root): the same root for texts that a chain of links joins, each of two texts whose sets of five-word shingles are 0.8 alike or more.

    Texts meet in buckets of least hashes; there fingerprints are compared by bit planes, and what is close
    is verified by its shingles: each text against its most central candidate, then against MORE times as many
    that are not in its class yet, and so on. Of a bucket of many the pairs about its centres and nearest
    neighbours come first, since these join most of it; then all other close pairs that are still in
    different classes, verified where they meet, so that only links leave a task, fewer than it has texts.
    No bucket is cut off and no close pair left out. A pair that never stands in one bucket, or whose fingerprints are over FAR apart, is not found: at a similarity of 0.8 less than 1 of
    1,000 by the buckets, and less than 1 of 1,000 by the fingerprints.
    """
    prints = cut(sketched(docs))
    now = cut(prints.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("fingerprint").alias("fingerprint"), F.first("bands").alias("bands")))
    keys = now.select(F.posexplode("bands").alias("t", "k"), "fingerprint", "node")
    ordered = lambda found: found.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    found = cut(ordered(in_runs(keys, _centred)))
    # A text that is close to any other of a bucket has a candidate by now, its nearest; all others are done.
    sets = cut(_sets(docs, now.select("node", "doc_id").join(found.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi")))
    forget(docs.sparkSession)
    roots = _joined(found, sets)
    # The rest of the large buckets: every close pair that is not in one class yet. Classes only grow, so this leaves none.
    rest = now.join(sets.select("node"), "node", "left_semi")
    rest = rest.withColumn("root", F.col("node")) if roots is None else rest.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    keys = cut(rest.select(F.posexplode("bands").alias("t", "k"), "fingerprint", "node", "root"))
    mixed = keys.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("x"), F.max("root").alias("y")).where((F.col("n") > FEW) & (F.col("x") != F.col("y")))
    # Pairs as rows would grow with the square of a bucket; so its texts' shingles come to it, and links leave.
    good = cut(in_runs(keys.join(mixed.select("t", "k"), ["t", "k"], "left_semi"), _across, sets))
    del keys, mixed, rest, found, sets
    forget(docs.sparkSession)
    if n := good.count():
        good = in_few(good, n)
        roots = components(good if roots is None else good.unionByName(roots.toDF("a", "b")))
    del good
    forget(docs.sparkSession)
    if roots is None:
        return prints.select("doc_id", "node", F.col("node").alias("root"))
    return prints.select("doc_id", "node").join(roots, "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text, any others) less near-copies as `similar` finds them: one row of the smallest doc_id stays for each class.

    A class is known by its root, not by its doc_id: an id on several rows may be the smallest of several
    classes, and each of them keeps a row. A class without any doc_id keeps one row. Texts without words are
    alike. An empty table gives no rows.
    """
    classes = cut(similar(docs))
    least = classes.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("m")).select(F.col("root").alias("__root"), F.col("m.doc_id").alias("__id"), F.col("m.node").alias("__node"))
    rows = classes.groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("rows")).where("id is not null")
    least = cut(least.join(rows, least["__id"] == rows["id"], "left").select("__root", "__id", "__node", (F.col("rows") == 1).alias("only")))
    columns = docs.columns
    only = docs.join(least.where("only"), F.col("doc_id") == F.col("__id"), "left_semi")
    # An id on several rows doesn't tell which of them is meant; its words do.
    several = least.where("only is null or not only")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = node_of([t.as_py() or "" for t in batch.column(batch.schema.get_field_index("text"))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*columns, "__found"])

    kinds = dict(docs.dtypes)
    again = docs.join(several.select("__id").distinct(), docs.doc_id.eqNullSafe(F.col("__id")), "left_semi").select(*columns)
    again = again.mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in columns] + ["__found bigint"]))
    again = again.join(several, again.doc_id.eqNullSafe(F.col("__id")) & (F.col("__found") == F.col("__node"))).dropDuplicates(["__root"])
    return only.select(*columns).unionByName(again.select(*columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
