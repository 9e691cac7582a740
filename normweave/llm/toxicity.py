"""Toxicity: a lexicon trie met by Levenshtein automata, weighed by context windows.

The lexicon is learned from labelled rows: words and stems that come almost only in toxic documents.
Its terms form a trie; the product of the trie with a Levenshtein automaton is determinised into one
table, state by state as texts need them, so its size follows the words read and not the number of terms.
It finds exact and misspelled terms in a single run over the characters. All tokens of a block of texts
advance through the table together, and nearly all have died after a few steps.

Each find is judged by the characters around it: inside quotation marks, or behind words that report
speech, it counts as quotation, else as abuse. Misspelled and quoted finds count as fixed parts of an
exact one, since a sample may show too few of them; a logistic regression gives the sum its meaning.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import attach, crc_bucket, cut, labelled_sample, pieces, table

#: Labelled rows to learn from at most, and toxic ones among them that a term must be in, however many there are.
SAMPLE, SUPPORT = 20_000, 4
#: How many times likelier a term must be in toxic rows, lengths of stems, and rows that halve a weight.
LIFT, STEMS, DOUBT = 40.0, range(3, 9), 5
#: Words on either side of a find by which places of a term are told apart, SUPPORT of them at least.
NEAR = 2
#: Cells that the table of a lexicon may have before it is begun anew with the next block.
CELLS = 1 << 23
#: Characters that a block of texts may have (one text may have more), and of a context window on either side.
BLOCK, WINDOW = 1 << 21, 60
#: Score from which a document counts as toxic, and what the folds of the query are.
TOXIC, FOLDS, HELD = 0.7, 3, 1
#: Prior of the logistic regression (bias, and weight of the evidence e as e / (e + HALF)), and its strength.
PRIOR, STRENGTH, HALF = np.array([-4.0, 9.0]), 0.5, 0.3
#: What a misspelled find and a quoted one count for, when an exact one in the open counts 1.
MISSPELLED, QUOTED = 0.5, 0.08
#: Digits that stand for letters, quotation marks, and words that report speech.
LOOK = dict(zip("0134578", "oieastb"))
QUOTES = "\"“”„«»‘’'"
REPORTS = re.compile(r"\b(said|says|say|called|calls|quoted|quote|wrote|writes|word|term|meaning|defined|reported|dit|sagte|nannte|wort|dijo|palabra)\b[\s:,\"'“„«‘]*$", re.I)

TOKEN = re.compile(r"[^\W_]+")


def edits(word: str) -> int:
    """Edits that a term of this length tolerates."""
    return 0 if len(word) < 5 else 1 if len(word) < 9 else 2


def fold(char: str) -> str:
    low = char.lower()
    return low if len(low) == 1 else char


class Lexicon:
    """Terms as one deterministic table over classes of characters, made as it is needed.

    State 0 is dead, state 1 the start; a cell of -1 has not been needed yet. found[state] is the term
    (from 1) that a token ending there matches, with the edits in `cost`; whole[state] tells a stem that
    has matched exactly, whatever follows. A stem is compared with the nearest prefix of a token. Unless
    `wide`, the first letter of a term must be right and a stem tolerates no edit.
    """

    def __init__(self, terms: list[tuple[str, bool]], wide: bool = False):
        self.terms, self.wide = terms, wide
        self.letters = sorted({c for t, _ in terms for c in t})
        at = {c: 2 + i for i, c in enumerate(self.letters)}
        self.classes = np.zeros(1 << 16, np.int32)  # 0: between tokens; 1: a letter of no term
        for i in range(1 << 16):
            char = chr(i)
            if char.isalnum():
                self.classes[i] = at.get(fold(char), 1)
        for digit, letter in LOOK.items():
            self.classes[ord(digit)] = at.get(letter, 1)
        self._begin()

    def _begin(self) -> None:
        start = frozenset((t, 0, 0) for t in range(len(self.terms)))
        self.numbers, self.states = {frozenset(): 0}, [frozenset()]
        self.table = np.full((16, len(self.letters) + 2), -1, np.int32)
        self.table[0] = 0
        self.found, self.cost, self.whole = np.zeros(16, np.int64), np.zeros(16, np.int64), np.zeros(16, bool)
        self.numbers[start] = 1
        self.states.append(start)
        self.found[1], self.cost[1], self.whole[1] = self._found(start)

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("terms", "wide", "letters", "classes")}

    def __setstate__(self, held: dict) -> None:
        self.__dict__.update(held)
        self._begin()

    def _number(self, states: frozenset) -> int:
        n = self.numbers.setdefault(states, len(self.states))
        if n == len(self.states):
            self.states.append(states)
            if n == len(self.table):
                self.table = np.vstack([self.table, np.full_like(self.table, -1)])
                self.found, self.cost, self.whole = (np.append(x, np.zeros_like(x)) for x in (self.found, self.cost, self.whole))
            self.found[n], self.cost[n], self.whole[n] = self._found(states)
        return n

    def _next(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The states behind these characters' classes; cells that are not there yet are made."""
        to = self.table[state, char]
        new = np.flatnonzero(to < 0)
        if len(new):
            width = self.table.shape[1]
            for cell in np.unique(state[new].astype(np.int64) * width + char[new]).tolist():
                s, c = divmod(cell, width)
                n = self._number(self._step(self.states[s], self.letters[c - 2] if c > 1 else None, s == 1)) if c else 0
                self.table[s, c] = n
            to = self.table[state, char]
        return to

    def _step(self, states: frozenset, char: str | None, first: bool) -> frozenset:
        out: dict[tuple[int, int], int] = {}
        queue: list[tuple[int, int, int]] = []
        # Letters may be left out before the next one is read.
        skipped = {(t, at + k, e + k) for t, at, e in states for k in range(self._most(t, first) - e + 1) if at + k <= len(self.terms[t][0])}
        for t, at, e in states | skipped:
            term, stem = self.terms[t]
            if at == len(term) and stem:
                queue.append((t, at, e))
                continue
            if at < len(term) and term[at] == char:
                queue.append((t, at + 1, e))
            if e < self._most(t, first):
                queue += [(t, at, e + 1)] + [(t, at + 1, e + 1)] * (at < len(term))
        while queue:
            t, at, e = queue.pop()
            if out.get((t, at), 9) <= e:
                continue
            out[t, at] = e
        # A state that another reaches with as few edits or fewer adds nothing.
        keep = {(t, at, e) for (t, at), e in out.items() if not any(out.get((t, at + d), 9) + abs(d) <= e for d in (-2, -1, 1, 2))}
        return frozenset(keep)

    def _most(self, t: int, first: bool = False) -> int:
        term, stem = self.terms[t]
        return edits(term) if self.wide or not (stem or first) else 0

    def _found(self, states: frozenset) -> tuple[int, int, bool]:
        ends = []
        for t, at, e in states:
            term, stem = self.terms[t]
            left = len(term) - at
            if stem and not left and not e:
                return t + 1, 0, True
            if e + left <= self._most(t):
                ends.append((e + left, t + 1))
        cost, term = min(ends, default=(0, 0))
        return term, cost, False

    def hits(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, start, end, term, edits) of all finds; code points, end exclusive."""
        if self.table.size > CELLS:
            self._begin()
        joined = "\n".join(texts) + "\n"
        code = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        classes = self.classes[np.minimum(code, 0xFFFF)]
        word = classes > 0
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        if len(word) and word[0]:
            edge = np.append(0, edge)
        starts, ends = edge[::2], edge[1::2]
        state = np.ones(len(starts), np.int32)
        alive, at = np.arange(len(starts)), starts.copy()
        got = [np.zeros((0, 2), np.int64)]
        while len(alive):
            over = at >= ends[alive]
            done = over | self.whole[state]
            hit = done & (self.found[state] > 0)
            got.append(np.column_stack([alive[hit], state[hit]]))
            alive, at, state = alive[~done], at[~done], state[~done]
            state = self._next(state, classes[at])
            live = state > 0
            alive, at, state = alive[live], at[live] + 1, state[live]
        got = np.concatenate(got)
        got = got[np.argsort(got[:, 0], kind="stable")]
        begins = np.cumsum([0] + [len(t) + 1 for t in texts])
        out = []
        for token, state in got:
            i = int(np.searchsorted(begins, starts[token], side="right")) - 1
            out.append((i, int(starts[token] - begins[i]), int(ends[token] - begins[i]), int(self.found[state]) - 1, int(self.cost[state])))
        return out


def quoted(text: str, start: int, end: int) -> bool:
    """Whether the find stands between quotation marks on its line, near by, or right behind reported speech."""
    before, after = text[max(0, start - WINDOW) : start].rpartition("\n")[2], text[end : end + WINDOW].partition("\n")[0]
    marks = [c for i, c in enumerate(before) if c in QUOTES and not (c in "'’" and i and before[i - 1].isalnum() and before[i + 1 : i + 2].isalnum())]
    opened = bool(marks) and (marks[-1] in "“„«‘" or marks[-1] in "\"'" and marks.count(marks[-1]) % 2 == 1)
    return opened and any(c in QUOTES for c in after) or bool(REPORTS.search(before))


class Model:
    """A lexicon with a weight for each term, words near its terms that are clean, and the regression."""

    def __init__(self, terms: list[tuple[str, bool]], weights: list[float]):
        self.lexicon, self.weights = Lexicon(terms, wide=True), weights
        self.clean: set[str] = set()
        self.beta = PRIOR.copy()

    def finds(self, texts: list[str]) -> list[list[tuple[int, int, int, int, bool]]]:
        """Of each text (start, end, term, edits, quoted)."""
        out: list[list[tuple[int, int, int, int, bool]]] = [[] for _ in texts]
        for i, start, end, term, cost in self.lexicon.hits(texts):
            text = texts[i]
            if not cost or text[start:end].lower() not in self.clean:
                out[i].append((start, end, term, cost, quoted(text, start, end)))
        return out

    def evidence(self, finds: list[list[tuple[int, int, int, int, bool]]]) -> np.ndarray:
        """Columns 1 and the bounded evidence of each text."""
        e = np.array([sum(self.weights[t] * (MISSPELLED if c else 1) * (QUOTED if q else 1) for _, _, t, c, q in found) for found in finds], float)
        return np.column_stack([np.ones(len(finds)), e / (e + HALF)])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.beta, -30, 30)))


def _blocks(texts: list[str]) -> Iterator[list[str]]:
    block, size = [], 0
    for t in texts:
        if block and size + len(t) > BLOCK:
            yield block
            block, size = [], 0
        block.append(t)
        size += len(t)
    if block:
        yield block


def learn_terms(sample: DataFrame) -> list[tuple[str, bool, float]]:
    """(term, whether it is a stem, weight) of all terms with support and lift, from partial counts of the sample's rows.

    To the driver come the terms that pass; the sample's rows bound them.

    Rows that share their smallest five-word shingle count as one: words of a text that was copied often
    would else seem to be toxic by themselves.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [t.as_py().lower().encode().split() for t in batch.column(1)]
            keys = [min(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(w[i:] for i in range(5)))) if len(w) > 5 else [b" ".join(w)])) for w in words]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(keys, np.uint64).view(np.int64))], names=[*batch.schema.names, "sketch"])

    sample = sample.mapInArrow(sketch, "doc_id bigint, text string, y int, sketch bigint").dropDuplicates(["sketch", "y"]).drop("sketch")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        rows = [0, 0]
        for batch in batches:
            for text, y in zip(batch.column(1), batch.column(2).to_pylist()):
                words = {"".join(map(fold, w)) for w in set(TOKEN.findall(text.as_py()))}
                y = int(bool(y))
                rows[y] += 1
                counts[y].update({w[:k] for w in words for k in STEMS if len(w) >= k} | {w + "." for w in words if len(w) >= STEMS[0]})
        keys = [*(counts[0] | counts[1]), ""]
        toxic, clean = [counts[1][k] for k in keys[:-1]] + [rows[1]], [counts[0][k] for k in keys[:-1]] + [rows[0]]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(toxic, pa.int64()), pa.array(clean, pa.int64())], names=["term", "toxic", "clean"])

    counts = cut(sample.mapInArrow(count, "term string, toxic bigint, clean bigint").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    rows = counts.where("term = ''").first()
    if rows is None or not rows.toxic or not rows.clean:
        return []
    # A term's weight is its precision, drawn to nothing where few rows speak for it.
    weight = lambda r: float((r.toxic + 0.5) / (r.toxic + r.clean + 1) * r.toxic / (r.toxic + DOUBT))
    lift = ((F.col("toxic") + 0.5) / rows.toxic) / ((F.col("clean") + 0.5) / rows.clean)
    strong = counts.where((F.col("term") != "") & (F.col("toxic") >= SUPPORT)).withColumn("lift", lift).where(F.col("lift") >= LIFT)
    strong = strong.orderBy(F.desc("toxic"), "term").collect()
    held = sample.sparkSession.sparkContext.broadcast({r.term for r in strong})

    def surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = set()
            for text in batch.column(1):
                tokens = ["".join(map(fold, w)) for w in TOKEN.findall(text.as_py())]
                for i, w in enumerate(tokens):
                    around = None
                    for key in [*(w[:k] for k in STEMS if len(w) >= k), w + "."]:
                        if key in held.value:
                            around = around or xxhash.xxh64_intdigest(" ".join([*tokens[max(0, i - NEAR) : i], "", *tokens[i + 1 : i + 1 + NEAR]])) >> 1
                            seen.add((key, around))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.string()), pa.array([a for _, a in seen], pa.int64())], names=["term", "around"])

    # Near copies of a passage repeat its words with what stands around them; that is no evidence of a term.
    apart = sample.where("y = 1").mapInArrow(surroundings, "term string, around bigint").distinct().groupBy("term").count().where(F.col("count") >= SUPPORT)
    apart = {r.term for r in apart.collect()}
    best = {r.term: r for r in strong if r.term in apart}
    longer: dict[str, list[str]] = {}
    words: dict[str, list[str]] = {}
    for t in best:
        if t.endswith("."):
            for k in STEMS:
                if k < len(t):
                    words.setdefault(t[:k], []).append(t)
        else:
            longer.setdefault(t[:-1], []).append(t)
    terms: dict[str, tuple[bool, float]] = {}
    covered = lambda w: any(w[:k] in terms for k in range(1, len(w) + 1))
    for root in sorted((t for t in best if not t.endswith(".")), key=len):
        if covered(root) or root[:-1] in best and len(root) > STEMS[0]:
            continue
        # The longest stem that is in as many toxic rows; a whole word if that is what it always was.
        end, n = root, best[root].toxic
        while more := [t for t in longer.get(end, []) if best[t].toxic >= 0.97 * n]:
            end = more[0]
        ways = [t for t in words.get(end, []) if best[t].toxic >= 0.9 * n]
        term, stem = (max(ways, key=lambda t: best[t].toxic)[:-1], False) if ways else (end, True)
        if term not in terms:
            terms[term] = (stem, weight(best[root]))
    # Whole words that their own stems, being common in clean rows, do not stand for.
    for word in (t for t in best if t.endswith(".")):
        if not covered(word[:-1]):
            terms[word[:-1]] = (False, weight(best[word]))
    ranked = sorted(terms.items(), key=lambda x: (-best.get(x[0], best.get(x[0] + ".", rows)).toxic, x[0]))
    return [(t, stem, w) for t, (stem, w) in ranked]


def regress(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's steps, drawn to PRIOR."""
    beta = PRIOR.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (p - y) + STRENGTH * (beta - PRIOR)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + STRENGTH * np.eye(2), slope)
        beta = beta - step
        if np.abs(step).max() < 1e-9:
            break
    return np.maximum(beta, [-np.inf, 0.1])


def fit(docs: DataFrame, labels: DataFrame, modulus: int = FOLDS, held: int = HELD, sample: int = SAMPLE) -> Model:
    """Model of label `toxic` from at most `sample` labelled rows outside the held-out remainder.

    Without both kinds of rows the lexicon is empty and all scores are the prior's. To the driver come
    the candidate terms, the evidence of each sampled row, and its misspelled finds.
    """
    chosen = cut(labelled_sample(docs, labels, "toxic", modulus, held, sample))
    terms = learn_terms(chosen)
    model = Model([(t, s) for t, s, _ in terms], [w for *_, w in terms])
    if not terms:
        return model

    def misspelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            texts, ys = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            at = 0
            for block in _blocks(texts):
                for i, found in enumerate(model.finds(block)):
                    out += [(block[i][a:b].lower(), ys[at + i]) for a, b, _, cost, _ in found if cost]
                at += len(block)
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int32())], names=["word", "y"])

    near = chosen.mapInArrow(misspelled, "word string, y int").groupBy("word").agg(F.sum("y").alias("toxic"), F.count(F.lit(1)).alias("n"))
    model.clean = {r.word for r in near.where("2 * toxic <= n").collect()}

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.vstack([np.zeros((0, 2)), *(model.evidence(model.finds(b)) for b in _blocks(batch.column(1).to_pylist()))])
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(x[:, 1])], names=["y", "evidence"])

    rows = np.array([tuple(r) for r in chosen.mapInArrow(sums, "y int, evidence double").collect()], float)
    model.beta = regress(np.column_stack([np.ones(len(rows)), rows[:, 1]]), rows[:, 0])
    return model


_FINDS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("term", pa.string()), ("edits", pa.int32()), ("quoted", pa.bool_())]))
_TYPES = {"score": "double", "predicted": "int", "finds": "array<struct<start:bigint,end:bigint,term:string,edits:int,quoted:boolean>>"}


def score(docs: DataFrame, model: Model, outputs: tuple[str, ...] = ("score", "predicted", "finds"), threshold: float = TOXIC, text_col: str = "text") -> DataFrame:
    """docs with `score` (0 to 1), `predicted` (1 from the threshold on) and `finds` (span, term, edits, quoted).

    A null or empty text has no finds and the score of that. Texts are read whole; each row is scored
    alone, so repeated rows score alike. Input columns named like outputs are replaced, others stay.
    """
    stay = attach(docs, list(outputs))
    carry = [c for c in stay if c != text_col] + [text_col] * (text_col in stay)
    source = docs.select(*carry, *([] if text_col in carry else [docs[text_col]]))
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = [t for t, _ in model.lexicon.terms]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in pieces(batches):
            finds = []
            for block in _blocks([t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]):
                finds += model.finds(block)
            s = model.score(model.evidence(finds))
            made = {"score": pa.array(s), "predicted": pa.array((s >= threshold).astype(np.int32))}
            if "finds" in outputs:
                made["finds"] = pa.array([[dict(zip(("start", "end", "term", "edits", "quoted"), (a, b, names[t], c, q))) for a, b, t, c, q in f] for f in finds], _FINDS)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in carry]
            yield pa.RecordBatch.from_arrays([*columns, *(made[o] for o in outputs)], names=[*carry, *outputs])

    kinds = dict(docs.dtypes)
    return source.mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in carry] + [f"{o} {_TYPES[o]}" for o in outputs]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model, ("score", "predicted"))
    return scored.select("doc_id", (crc_bucket(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "score", "predicted")
