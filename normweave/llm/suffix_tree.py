"""Language-model scores from a probabilistic suffix tree over words.

The root has every training token's share. A context, the last d words, becomes a state if it extends a
state, was seen often enough to be measured, and has a next-token distribution that diverges enough from
that state's. A state keeps the next tokens it was seen with often enough, discounted by a constant, and
gives the rest of its mass to the shorter state's distribution, so every state's probabilities sum to one.
Each token is scored in the longest suffix state of what stands before it. There is no greatest depth, and
all thresholds are counts, so the tree grows with the corpus; it ends where no context diverges any more.

No task holds the tree. Texts lie in chunks of about CHUNK tokens. For each depth a chunk asks for the
counts of its own distinct contexts and next tokens: 64-bit keys, sorted, as one array for each range of
keys. A range adds up what all chunks have sent and answers every chunk in the order of its question; answers
are written where the chunk lies, and no turn sends them again. Then chunks
ask which of their contexts have become states, and with the question goes each next token that counts,
from one chunk of those that have it; the range of a context judges it from these reports and answers.
What is saved of a chunk holds its open tokens only: what answers close is in the sums of the texts.

A context is not extended if its kept next tokens, as the state predicts them, cost less than the least
gain of a state in all: no extension could then pass the test, so nothing is lost. This ends the growth
inside copied passages, whose words soon follow from each other.
"""

from __future__ import annotations

import gc
import pickle
import time
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ship import ship
from .runtime import crc_bucket, cut, dealing, dealt, forget, pack, parts_of, table, unpack

#: Times that a next token of a context must have been seen, and a context.
SEEN, CONTEXT = 3, 6
#: What is taken off each count, and nats that each kept next token must gain.
DISCOUNT, GAIN = 0.75, 1.0
#: Parts of a count in which discounts are whole numbers.
UNIT = 4
#: Tokens of a chunk (one text may have more).
CHUNK = 3 << 18
#: What the folds of the query are.
FOLDS, HELD = 5, 1
#: The end of a text, as a word; no word is empty.
END = b""

#: Steps of answers: a chunk's state, counts of words, counts at a depth; RESTS and the depth: what is left to the shorter states.
STATE, FIRST, COUNTS, RESTS = -1, 0, 1, 1
#: A next token of a context: the context's place in the question that it goes with.
REPORT = np.dtype([("context", np.uint32), ("n", np.int64), ("total", np.int64), ("shorter", np.float64)])

_CONTEXT_KEY = np.uint64(0xD1B54A32D192ED03)


def mix(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """A 64-bit hash of pairs. Two of n keys agree by chance with probability n * n / 2**65."""
    with np.errstate(over="ignore"):
        x = (a ^ (a >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + b
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct keys, a place of each, and of each place its key's number.

    Sorts high bits of keys with places in the low ones, which numpy does several times faster than it finds
    an order; where different keys agree in the high bits and come out of order, the order is found after all.
    """
    bits = np.uint64(max(1, len(keys) - 1).bit_length())
    packed = keys >> bits << bits | np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    order = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    ordered = keys[order]
    if (ordered[1:] < ordered[:-1]).any():
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
    new = np.append(True, ordered[1:] != ordered[:-1])[: len(keys)]
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return ordered[new], order[new], number


def pack_keys(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw, np.uint64), dtype=np.uint64)


# Chunks


def chunked(rows: DataFrame) -> DataFrame:
    """Chunks of rows (doc_id, text, train): ids and train flags of their texts, their sizes in tokens, the
    hashes of the chunk's distinct words, the most frequent first, and each token's place among them."""
    kind = dict(rows.dtypes)["doc_id"]
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, number = defaultdict(count().__next__), TaskContext.get().partitionId() << 32
        ids: list[pa.Array] = []
        train: list[pa.Array] = []
        sizes: list[int] = []
        flat: list[np.ndarray] = []
        held = 0

        def out() -> pa.RecordBatch:
            local = np.concatenate(flat)
            words = np.fromiter(map(xxhash.xxh64_intdigest, places), np.uint64, len(places))
            often = np.argsort(-np.bincount(local), kind="stable")
            place = np.empty(len(often), np.uint32)
            place[often] = np.arange(len(often))
            both = pa.concat_arrays(ids), pa.concat_arrays(train)
            arrays = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in both]
            blobs = [pack(np.array(sizes, np.int64)), words[often].tobytes(), pack(place[local])]
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *arrays, *(pa.array([b], pa.binary()) for b in blobs)], names=["chunk", "ids", "train", "sizes", "words", "local"])

        for batch in batches:
            begun = 0
            for i, text in enumerate(batch.column(1)):
                words = (text.as_py() or "").encode("utf-8", "replace").lower().split()
                words.append(END)
                flat.append(np.fromiter(map(places.__getitem__, words), np.uint32, len(words)))
                sizes.append(len(words))
                held += len(words)
                if held >= CHUNK:
                    ids.append(batch.column(0).slice(begun, i + 1 - begun))
                    train.append(batch.column(2).slice(begun, i + 1 - begun))
                    begun = i + 1
                    yield out()
                    number += 1
                    ids, train, sizes, flat, held = [], [], [], [], 0
                    places = defaultdict(count().__next__)
            if begun < batch.num_rows:
                ids.append(batch.column(0).slice(begun))
                train.append(batch.column(2).slice(begun))
        if flat:
            yield out()

    return rows.mapInArrow(run, f"chunk bigint, ids array<{kind}>, train array<boolean>, sizes binary, words binary, local binary")


def small(x: np.ndarray) -> np.ndarray:
    """Counts in half the bytes, if they fit."""
    return x.astype(np.uint32) if x.max(initial=0) < 1 << 32 else x


class Question:
    """Sorted keys with what they carry, still without an answer."""

    def __init__(self, keys: np.ndarray, times: np.ndarray | None = None, reports: np.ndarray | None = None):
        self.keys, self.times, self.reports = keys, times, reports


class Chunk:
    """A chunk's texts, brought as far as its answers lead.

    Of each token that a longer context may still move it has the place `at`, the probability `p` in the
    longest state so far, the hash of that `context`, how often the token was seen `before` there, from depth 2 on the
    `reach`, the words of the longest context whose pairs of words were all seen often enough, less one, and, if
    known already (else it is negative), the `total` of the next longer context. The other tokens are in the sums of their texts.
    Once counts of a depth are known, `context`, `before` and `total` are those of the context asked for.
    """

    def __init__(self, row: dict):
        self.words = np.frombuffer(row["words"], np.uint64)
        self.packed = row["local"]
        self.sizes = unpack(row["sizes"], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.taught = np.array(row["train"], bool)

    @cached_property
    def local(self) -> np.ndarray:
        return unpack(self.packed, np.uint32)

    def times(self, number: np.ndarray, n: int, at: np.ndarray | None = None) -> np.ndarray:
        """How often each of n numbers stands at a training token."""
        train = np.repeat(self.taught, self.sizes)
        return np.bincount(number, train if at is None else train[at], n).astype(np.int64)

    def first(self) -> Question:
        order = np.argsort(self.words)
        return Question(self.words[order], self.times(self.local, len(order))[order])

    def of_words(self, answer: np.ndarray) -> np.ndarray:
        """How often each word was seen, from the answer to `first`."""
        times = np.empty(len(self.words), np.int64)
        times[np.argsort(self.words)] = answer >> 1
        return times

    def base(self, answer: np.ndarray, mass: float) -> tuple[np.ndarray, np.ndarray]:
        """Of each text, its known tokens and its score in the root."""
        times = self.of_words(answer)
        return np.add.reduceat((times > 0).astype(np.int64)[self.local], self.starts), np.add.reduceat(np.log((times + 0.5) / mass)[self.local], self.starts)

    def begin(self, answer: np.ndarray, mass: float) -> None:
        """Everything in the root, from the answer to `first`."""
        times = self.of_words(answer)
        share = (times + 0.5) / mass
        more = np.append(False, (times >= CONTEXT)[self.local[:-1]])
        more[self.starts] = False
        self.depth, self.pairs, self.at = 1, np.zeros(0, np.int64), np.flatnonzero(more)
        logs = np.log(share)[self.local]
        logs[self.at] = 0
        self.sums = np.add.reduceat(logs, self.starts)
        self.text = np.repeat(np.arange(len(self.sizes)), self.sizes)[self.at]
        word = self.local[self.at]
        self.p, self.before, self.total, self.context = share[word], times[word], times[self.local[self.at - 1]], np.zeros(len(word), np.uint64)
        self.reach = np.zeros(len(word), np.uint32)

    def keep(self, more: np.ndarray) -> None:
        closed = np.flatnonzero(~more)
        self.sums = self.sums + np.bincount(self.text[closed], np.log(self.p[closed]), len(self.sums))
        more = np.flatnonzero(more)
        self.at, self.text, self.p, self.before, self.context, self.total, self.reach = (x[more] for x in (self.at, self.text, self.p, self.before, self.context, self.total, self.reach))

    def save(self) -> bytes:
        """After the counts of one of the first two depths, only these: most tokens are open, and all else is found again in less than it takes.
        From the fourth depth on before its counts, when all that is no state is closed; the third is found again from its answers."""
        if self.depth <= 2:
            arrays = [small(self.pairs if self.depth == 1 else self.before)]
        else:
            arrays = [self.sums, np.diff(self.at, prepend=0).astype(np.uint32), self.p.astype(np.float32), small(self.before), small(np.maximum(self.total, -1) + 1), self.reach]
        return pickle.dumps((self.depth, [(x.dtype.str, pack(x)) for x in arrays]))

    def load(self, depth: int, packed: list[tuple[str, bytes]]) -> None:
        """What was saved; counts of one of the first two depths on top of what led there."""
        arrays = [unpack(raw, kind) for kind, raw in packed]
        if depth <= 2:
            counts = arrays[0].astype(np.int64)
            if len(self.at) and depth == 1:
                self.see(counts)
            elif len(self.at):
                self.context = mix(self.context, self.words[self.local[self.at - 2]])
                self.keep(self.total >= CONTEXT)
                self.before = counts
            return
        self.depth, (self.sums, steps, p, before, total, self.reach) = depth, arrays
        self.at, self.p, self.before, self.total = np.cumsum(steps, dtype=np.int64), p.astype(np.float64), before.astype(np.int64), total.astype(np.int64) - 1
        self.text = np.searchsorted(self.starts, self.at, side="right") - 1
        self.context = np.zeros(len(self.at), np.uint64)
        for d in range(1, depth) if len(self.at) else ():
            self.context = mix(self.context, self.words[self.local[self.at - d]])

    def see(self, pairs: np.ndarray) -> None:
        """The counts of contexts of one word. pairs: how often a token and the one before stand together, if asked."""
        self.pairs, self.before = pairs, pairs[self.at]
        self.context = mix(self.context, self.words[self.local[self.at - 1]])

    def longer(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The contexts one word longer, the tokens whose counts there are asked, those whose context's count is, the places that counts are of, and their distinct keys as of `distinct`."""
        context = mix(self.context, self.words[self.local[self.at - self.depth]])
        # A next token can only be seen as often here as behind the shorter context. Counts of contexts are mostly known.
        asked = np.flatnonzero(self.before >= SEEN)
        keys = [mix(context[asked], self.words[self.local[self.at[asked]]])]
        rest = np.flatnonzero(self.total < 0)
        return context, asked, rest, self.at[np.concatenate([asked, rest])], distinct(np.concatenate([*keys, mix(context[rest], _CONTEXT_KEY)]))

    def ask(self) -> Question:
        """For the counts of next tokens in longer contexts."""
        if not len(self.at):
            return Question(np.zeros(0, np.uint64), np.zeros(0, np.int64))
        *_, where, (keys, _, number) = self.longer()
        return Question(keys, self.times(number, len(keys), where))

    def counted(self, answer: np.ndarray) -> Question:
        """The question after the answer to `ask`: which contexts are states."""
        if not len(self.at):
            return Question(np.zeros(0, np.uint64))
        context, asked, rest, _, (_, place, number) = self.longer()
        n = np.zeros(len(self.at), np.int64)
        n[asked] = (answer >> 1)[number[: len(asked)]]
        # Of all chunks that asked for a next token, the one that was told so reports it.
        one = np.zeros(len(self.at), bool)
        one[asked[place[(answer & 1 == 1) & (place < len(asked))]]] = True
        one &= n >= SEEN
        if self.depth == 1:
            pairs = np.zeros(len(self.local), np.int64)
            pairs[self.at] = n
            self.see(pairs)
        else:
            self.before, self.context = n, context
            self.total[rest] = (answer >> 1)[number[len(asked) :]]
            enough = self.total >= CONTEXT
            self.keep(enough)
            one = one[enough]
        wanted, of = self.contexts()
        reports = np.empty(np.count_nonzero(one), REPORT)
        for name, x in (("context", of), ("n", self.before), ("total", self.total), ("shorter", self.p)):
            reports[name] = x[one]
        return Question(wanted, None, reports[np.argsort(reports["context"], kind="stable")])

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """The sorted distinct contexts whose counts are known, and the number of each token's."""
        if self.depth > 1:
            wanted, _, number = distinct(self.context)
            return wanted, number
        before = self.local[self.at - 1]  # contexts of one word are sorted by word
        used = np.flatnonzero(np.bincount(before, minlength=len(self.words)))
        keys = mix(np.zeros(len(used), np.uint64), self.words[used])
        order, number = np.argsort(keys), np.empty(len(self.words), np.int64)
        number[used[order]] = np.arange(len(used))
        return keys[order], number[before]

    def move(self, rests: np.ndarray) -> None:
        """To the contexts asked for, where these are states. rests: UNIT times what is left of the context's count, zero for no state, negative for one not to be extended."""
        if not len(self.at):
            self.depth += 1
            return
        rest = rests[self.contexts()[1]]
        state = rest != 0
        self.p = np.where(state, (np.where(self.before >= SEEN, self.before - DISCOUNT, 0.0) + np.abs(rest) / UNIT * self.p) / np.maximum(self.total, 1), self.p)
        if self.depth == 1:
            # No pair ends with the first word of a text, so no reach goes beyond it.
            places = np.arange(len(self.local), dtype=np.uint32)
            self.reach = (places - np.maximum.accumulate(np.where(self.pairs >= CONTEXT, 0, places)))[self.at - 1]
            self.total = self.pairs[self.at - 1]
        else:
            # The words of a context were counted as the last of them, unless those before were no context to ask about.
            counts = np.full(len(self.local), -1)
            counts[self.at] = self.before
            self.total = counts[self.at - 1]
        # The oldest two words of a context must have been seen as often as the context.
        self.keep(state & (rest > 0) & (self.reach >= self.depth) & ((self.total < 0) | (self.total >= CONTEXT)))
        self.depth += 1

    def scores(self) -> np.ndarray:
        return self.sums + np.bincount(self.text, np.log(self.p), len(self.sums))


def _ranges(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each of the 2**bits ranges of keys ends in the sorted keys, and 0 before."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


_ASKED = "chunk bigint, part int, keys binary, times binary"


def _questions(chunk: int, q: Question, bits: int, state: bytes | None = None) -> pa.RecordBatch:
    """One row for each range that the question meets, with its times or reports; a state is the row of a negative part, which few chunks share."""
    ends = _ranges(q.keys, bits)
    met = np.flatnonzero(np.diff(ends)).tolist()
    keys = [pack_keys(q.keys[ends[i] : ends[i + 1]]) for i in met]
    times: list[bytes | None] = [None] * len(met)
    if q.times is not None:
        times = [pack(q.times[ends[i] : ends[i + 1]]) for i in met]
    elif q.reports is not None:
        cuts = np.searchsorted(q.reports["context"], ends)
        parted = [q.reports[cuts[i] : cuts[i + 1]].copy() for i in met]
        for i, part in zip(met, parted):
            part["context"] -= np.uint32(ends[i])
        times = [pack(part) for part in parted]
    if state is not None:
        met, keys, times = [*met, -1 - ((chunk >> 32) * 31 + chunk % (1 << 32)) % (1 << 30)], [*keys, state], [*times, None]
    return pa.RecordBatch.from_arrays([pa.array([chunk] * len(met), pa.int64()), pa.array(met, pa.int32()), pa.array(keys, pa.binary()), pa.array(times, pa.binary())], names=["chunk", "part", "keys", "times"])


def _brought(held: pa.Table, answers: pa.Table, mass: float, to: int) -> tuple[int, Chunk, np.ndarray, np.ndarray]:
    """A chunk brought to the depth `to` by what was saved of it and the answers about its contexts; the first answer and that of counts, each in the order of its sorted question."""
    row = held.to_pylist()[0]
    raw: dict[int, list[tuple[int, bytes]]] = {}
    for step, part, answer in zip(answers["step"].to_pylist(), answers["part"].to_pylist(), answers["answer"].to_pylist()):
        raw.setdefault(step, []).append((part, answer))

    def found(step: int, kind: type) -> np.ndarray:  # a question of no keys has no answer
        return np.concatenate([np.zeros(0, kind), *(unpack(x, kind) for _, x in sorted(raw.get(step, [])))])

    chunk, first, counts = Chunk(row), found(FIRST, np.int64), found(COUNTS, np.int64)
    states = sorted(pickle.loads(x) for _, x in raw.get(STATE, []))
    if not states or states[0][0] == 1:
        chunk.begin(first, mass)
    for depth, arrays in states:
        chunk.load(depth, arrays)
        if depth <= 2:
            chunk.move(found(RESTS + depth, np.int64))
    if chunk.depth < to:
        chunk.counted(counts)
        chunk.move(found(RESTS + chunk.depth, np.int64))
    return row["chunk"], chunk, first, counts


def _counted(asked: DataFrame, step: int) -> DataFrame:
    """Answers (chunk, step, part, answer, tokens, kinds): twice the times of each key over all chunks, and 1
    more for one chunk of each key; tokens and kinds: on one row of each range, its sums and known keys.
    Of next tokens no times below SEEN are told, since they count as none. States of chunks stay as they are."""

    def add(rows: pa.Table) -> pa.Table:
        if rows["part"][0].as_py() < 0:
            none = pa.array([0] * len(rows), pa.int64())
            return pa.table({"chunk": rows["chunk"], "step": pa.array([STATE] * len(rows), pa.int32()), "part": rows["part"], "answer": rows["keys"], "tokens": none, "kinds": none})
        each = [unpack_keys(k) for k in rows["keys"].to_pylist()]
        keys, place, number = distinct(np.concatenate(each))
        times = np.concatenate([unpack(t, np.int64) for t in rows["times"].to_pylist()])
        total = np.bincount(number, times, len(keys)).astype(np.int64)
        answer = total << 1
        told = total >= (0 if step == FIRST else SEEN)
        answer[~told] = 0
        answer = answer[number]
        answer[place[told]] |= 1
        ends = np.cumsum([0, *map(len, each)])
        none = [0] * (len(each) - 1)
        return pa.table(
            {
                "chunk": rows["chunk"], "step": pa.array([step] * len(each), pa.int32()), "part": rows["part"],
                "answer": pa.array([pack(answer[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.binary()),
                "tokens": pa.array([int(total.sum()), *none], pa.int64()), "kinds": pa.array([int((total > 0).sum()), *none], pa.int64()),
            }
        )

    return asked.groupBy("part").applyInArrow(add, "chunk bigint, step int, part int, answer binary, tokens bigint, kinds bigint")


def judge(reports: np.ndarray, n: int) -> np.ndarray:
    """Of each of n contexts the mass left to the shorter state, negative if no longer context can be one; not a number if it is no state.

    reports: one for each context and next token that counts.
    """
    return _judged(reports, n)[0]


def _judged(reports: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """What `judge` says, and of each context its count, or not a number."""
    context, times, total = reports["context"], reports["n"].astype(np.float64), reports["total"].astype(np.float64)
    kept, seen, of = np.bincount(context, minlength=n), np.bincount(context, times, n), np.full(n, np.nan)
    of[context] = total
    rest = 1 - np.bincount(context, times - DISCOUNT, n) / of
    p = (times - DISCOUNT) / total + rest[context] * reports["shorter"]
    gain, cost = np.bincount(context, times * np.log(p / reports["shorter"]), n), np.bincount(context, -times * np.log(p), n)
    state = gain + (of - seen) * np.log(rest) >= GAIN * kept
    return np.where(state, np.where(cost >= GAIN, rest, -rest), np.nan), of


def _told(asked: DataFrame, depth: int) -> DataFrame:
    """Answers (chunk, step, part, answer): of each context asked for its state's rest in whole UNITs, which take fewer bytes than the share, or zero; and the states of chunks, as they are."""

    def tell(rows: pa.Table) -> pa.Table:
        step, out = RESTS + depth, rows["keys"]
        if rows["part"][0].as_py() < 0:
            step = STATE
        else:
            each = [unpack_keys(k) for k in out.to_pylist()]
            keys, _, number = distinct(np.concatenate(each))
            ends = np.cumsum([0, *map(len, each)])
            parts = [unpack(r, REPORT) for r in rows["times"].to_pylist()]
            reports = np.concatenate(parts)
            reports["context"] = number[np.repeat(ends[:-1], [len(x) for x in parts]) + reports["context"]]
            rest, of = _judged(reports, len(keys))
            left = np.where(np.isnan(rest), 0, np.rint(UNIT * rest * of)).astype(np.int64)[number]
            out = pa.array([pack(left[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.binary())
        return pa.table({"chunk": rows["chunk"], "step": pa.array([step] * len(rows), pa.int32()), "part": rows["part"], "answer": out})

    return asked.groupBy("part").applyInArrow(tell, "chunk bigint, step int, part int, answer binary")


def _let_go(spark: SparkSession) -> None:
    """Forgets what Python has let go just now: py4j tells the JVM of that in a thread that looks once a second."""
    gc.collect()
    time.sleep(1.1)
    forget(spark)


def score(docs: DataFrame, is_training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score): one row for each row of docs.

    Learns from the rows where is_training holds (null: it does not) and scores all. A null text is
    empty: one token, its end. Null and repeated ids are rows of their own. Without training rows every
    token is unknown and gets the probability 1. An empty table gives no rows. Other columns, whatever
    their names, are not read. A text is one chunk's however long it is.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(is_training, F.lit(False)).alias("train"))
    kind = dict(rows.dtypes)["doc_id"]
    parts = parts_of(rows)
    bits = max(1, parts - 1).bit_length()
    # Chunks lie where their answers will come to, so that they are dealt out once.
    chunks = dealt(chunked(rows), parts, "chunk")
    _let_go(docs.sparkSession)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _questions(row["chunk"], Chunk(row).first(), bits)

    def deal(answers: DataFrame) -> DataFrame:
        """Answers beside their chunks: each is sent once, however many turns need it."""
        with dealing(docs.sparkSession):
            return cut(answers.repartition(parts, "chunk"))

    counted = deal(_counted(chunks.mapInArrow(begin, _ASKED).repartition(parts, "part"), FIRST))
    tokens, kinds = counted.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    mass = tokens + 0.5 * (kinds + 1)

    def turn(answers: DataFrame, depth: int, known: bool) -> DataFrame:
        """The questions for counts, or those after the counts are known, with what is saved of the chunks."""

        def ask(held: pa.Table, answers: pa.Table) -> pa.Table:
            number, chunk, _, counts = _brought(held, answers, mass, depth)
            question = chunk.counted(counts) if known else chunk.ask()
            pa.default_memory_pool().release_unused()
            return pa.Table.from_batches([_questions(number, question, bits, chunk.save() if (depth <= 2 if known else depth > 3) else None)])

        return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(ask, _ASKED).repartition(parts, "part")

    # What is saved of the first two depths needs the answers before it.
    first = counted.drop("tokens", "kinds")
    depth, answers = 1, first
    while True:
        _let_go(docs.sparkSession)
        counts = deal(_counted(turn(answers, depth, False), COUNTS).drop("tokens", "kinds"))
        if counts.where(F.col("step") == COUNTS).isEmpty():
            break
        _let_go(docs.sparkSession)
        known = counts if depth > 3 else answers.unionByName(counts)
        told = deal(_told(turn(known, depth, True), depth))
        answers = (known if depth > 2 else answers).unionByName(told)
        depth += 1
        del counts, known, told
    if depth > 4:
        answers = answers.unionByName(first)

    def finish(held: pa.Table, answers: pa.Table) -> pa.Table:
        _, chunk, first, _ = _brought(held, answers, mass, depth)
        known, base = chunk.base(first, mass)
        return pa.table({"doc_id": held["ids"].combine_chunks().flatten(), "n_tokens": pa.array(chunk.sizes), "n_known": pa.array(known), "base_score": pa.array(base / np.log(10)), "score": pa.array(chunk.scores() / np.log(10))})

    scored = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, f"doc_id {kind}, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_bucket(F.col("doc_id"), FOLDS) == HELD
    scored = score(docs, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
