"""Secret scans through a trigram inverted index.

Each rule's regex is parsed into a Boolean query over trigrams that every match must contain. A
block of texts (an Arrow batch) is indexed once: a trigram's posting is the bit set of the block's
texts that hold it. A rule's candidates are its query over these postings, and only candidates are
given to the regex. A rule from which no trigram follows scans all texts of the block.

Only the trigrams that some rule asks for are indexed. Letters A-Z are folded in both the index and
the queries, so one index serves rules of either case. Blocks are bounded by the Arrow batch and
rows never meet, so nothing is shuffled and a lost task repeats its own blocks only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import product
from re import _constants as K
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .runtime import attach, pieces, table

#: Strings that a part of a regex may stand for before it counts as unknown.
EXACT = 24


@dataclass(frozen=True)
class Rule:
    """accept: of a match, whether it stays; a failing match is dropped but has used up its characters."""

    kind: str
    pattern: str
    flags: int = 0
    accept: Callable[[re.Match], bool] = field(default=lambda m: True, compare=False)


#: The base kinds, in the order in which ties of start are listed, then those that the method adds.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII, lambda m: m.end(2) - m.start(2) >= 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, lambda m: m.end() - m.start() >= 20),
    Rule("hex", r"[0-9a-f]+", 0, lambda m: m.end() - m.start() >= 24),
)
MORE = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9._~+/-]{20,}=*", re.IGNORECASE | re.ASCII),
    Rule("urlauth", r"[a-z][a-z0-9+]{1,10}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@"),
    Rule("prefixed", r"(?:ghp|gho|ghs|ghu|ghr|sk|pk|rk|xoxb|xoxp|xoxa)[_-][A-Za-z0-9_-]{16,}"),
)
RULES = BASE + MORE

# A query is True (any text may match), or ("and" | "or", parts), where a part is a query or a trigram.


def _trigrams(word: str) -> object:
    grams = dict.fromkeys(word[i : i + 3] for i in range(len(word) - 2))
    return ("and", tuple(grams)) if grams else True


def _all(parts: list) -> object:
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts: list) -> object:
    parts = list(dict.fromkeys(parts))
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _fold(char: int) -> str | None:
    return chr(char).lower() if char < 128 else None


def _strings(op: object, arg: object) -> set[str] | None:
    """All strings that a node can match, folded; None if they are too many or not known."""
    if op is K.LITERAL:
        return None if _fold(arg) is None else {_fold(arg)}
    if op is K.IN:
        out: set[str] = set()
        for kind, value in arg:
            chars = [value] if kind is K.LITERAL else range(value[0], value[1] + 1) if kind is K.RANGE and value[1] - value[0] < EXACT else None
            if chars is None or any(_fold(c) is None for c in chars):
                return None
            out |= {_fold(c) for c in chars}
        return out if len(out) <= EXACT else None
    if op is K.SUBPATTERN:
        return _sequence(arg[3])
    if op is K.BRANCH:
        each = [_sequence(x) for x in arg[1]]
        return None if any(e is None for e in each) or sum(map(len, each)) > EXACT else set().union(*each)
    if op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT) and arg[1] is not K.MAXREPEAT and arg[1] <= 4:
        one = _sequence(arg[2])
        if one is None or sum(len(one) ** n for n in range(arg[0], arg[1] + 1)) > EXACT:
            return None
        return {"".join(x) for n in range(arg[0], arg[1] + 1) for x in product(one, repeat=n)}
    return {""} if op is K.AT else None


def _sequence(nodes: object) -> set[str] | None:
    out = {""}
    for op, arg in nodes:
        one = _strings(op, arg)
        if one is None or len(out) * len(one) > EXACT:
            return None
        out = {a + b for a in out for b in one}
    return out


def _required(nodes: object) -> object:
    """What any match of the sequence must contain: runs of known strings, cut where one is unknown."""
    parts, run = [], {""}
    for op, arg in nodes:
        one = _strings(op, arg)
        if one is not None and len(run) * len(one) <= EXACT:
            run = {a + b for a in run for b in one}
            continue
        parts.append(_any([_trigrams(w) for w in sorted(run)]))
        run = one if one is not None else {""}
        if one is None:
            if op is K.SUBPATTERN:
                parts.append(_required(arg[3]))
            elif op is K.BRANCH:
                parts.append(_any([_required(x) for x in arg[1]]))
            elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT) and arg[0] >= 1:
                parts.append(_required(arg[2]))
    return _all([*parts, _any([_trigrams(w) for w in sorted(run)])])


def trigram_query(rule: Rule) -> object:
    return _required(_parser.parse(rule.pattern, rule.flags))


def grams_of(query: object) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(grams_of, query[1]))


class Scanner:
    """Compiled rules with their queries, and a table from a trigram's code to its posting."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.find = [re.compile(r.pattern, r.flags).finditer for r in rules]
        self.queries = [trigram_query(r) for r in rules]
        self.grams = {g: i + 1 for i, g in enumerate(sorted(set().union(*map(grams_of, self.queries))))}
        if len(self.grams) > 65_000:
            raise ValueError("too many trigrams")
        self.code = np.zeros(1 << 21, np.uint16)
        for g, i in self.grams.items():
            self.code[ord(g[0]) << 14 | ord(g[1]) << 7 | ord(g[2])] = i
        # All bytes of a text beyond ASCII share one code, which no trigram holds.
        self.fold = np.array([ord(chr(b).lower()) if 0 < b < 128 else 0 for b in range(256)], np.uint32)

    def postings(self, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Bit sets over the block's texts by trigram; raw: the texts' bytes, each followed by a zero byte."""
        sets = np.zeros((len(self.grams) + 1, len(ends)), bool)
        step = 1 << 22
        for at in range(0, max(0, len(raw) - 2), step):
            x = self.fold[raw[at : at + step + 2]]
            hit = self.code[x[:-2] << 14 | x[1:-1] << 7 | x[2:]]
            where = np.flatnonzero(hit)
            sets[hit[where], np.searchsorted(ends, where + at, side="right")] = True
        return sets

    def candidates(self, query: object, sets: np.ndarray) -> np.ndarray:
        if query is True:
            return np.ones(sets.shape[1], bool)
        if isinstance(query, str):
            return sets[self.grams[query]]
        return reduce(np.logical_and if query[0] == "and" else np.logical_or, (self.candidates(p, sets) for p in query[1]))

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Of each text its spans as (start, number of the rule, end), in order; code points, end exclusive."""
        encoded = [t.encode("utf-8", "replace") for t in texts]
        raw = np.frombuffer(b"\0".join(encoded) + b"\0", np.uint8)
        ends = np.cumsum([len(e) + 1 for e in encoded]) if encoded else np.zeros(0, int)
        sets = self.postings(raw, ends)
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, rule in enumerate(self.rules):
            for i in np.flatnonzero(self.candidates(self.queries[k], sets)):
                out[i] += [(m.start(), k, m.end()) for m in self.find[k](texts[i]) if rule.accept(m)]
        for spans in out:
            spans.sort()
        return out


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[secret]") -> str:
    """The text with each maximal run of overlapping spans replaced by mark."""
    parts, done = [], 0
    for start, _, end in spans:
        if start >= done:
            parts += [text[done:start], mark]
        done = max(done, end)
    return "".join([*parts, text[done:]])


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
#: Output columns that `scan` can give.
OUTPUTS = {"spans": (_SPANS, "array<struct<kind:string,start:bigint,end:bigint>>"), "redacted": (pa.string(), "string"), "span_text": (pa.string(), "string"), "base_sha256": (pa.string(), "string")}


def scan(docs: DataFrame, outputs: list[str], rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """docs with outputs: `spans` (kind, start, end by start, then by rule), `redacted` text, `span_text`
    (kind:start:end, comma-joined), `base_sha256` (of the same over base kinds), and `n_<kind>` counts.

    A null text counts as empty in all of them, but its redacted text stays null. Texts of any length
    are scanned whole. Repeated rows give repeated results. An input column named like an output is
    replaced by it; the others stay.
    """
    stay = attach(docs, outputs)
    carry = [c for c in stay if c != text_col] + [text_col] * (text_col in stay)
    source = docs.select(*carry, *([] if text_col in carry else [docs[text_col]]))
    kinds = [r.kind for r in rules]
    base = {k for k, r in enumerate(rules) if r in BASE}

    def give(name: str, text: str | None, spans: list[tuple[int, int, int]]) -> object:
        if name == "spans":
            return [{"kind": kinds[k], "start": a, "end": b} for a, k, b in spans]
        if name == "redacted":
            return None if text is None else redact(text, spans)
        if name.startswith("n_"):
            return sum(kinds[k] == name[2:] for _, k, _ in spans)
        joined = ",".join([f"{kinds[k]}:{a}:{b}" for a, k, b in spans if name == "span_text" or k in base])
        return joined if name == "span_text" else hashlib.sha256(joined.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in pieces(batches, 1024):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            found: list[list[tuple[int, int, int]]] = []
            at = 0
            while at < len(texts):  # blocks of at most 16 million characters, or one text
                end, chars = at + 1, len(texts[at] or "")
                while end < len(texts) and chars + len(texts[end] or "") <= 1 << 24:
                    chars, end = chars + len(texts[end] or ""), end + 1
                found += scanner.scan([t or "" for t in texts[at:end]])
                at = end
            made = [pa.array([give(o, t, s) for t, s in zip(texts, found)], OUTPUTS[o][0] if o in OUTPUTS else pa.int64()) for o in outputs]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in carry] + made, names=carry + outputs)

    types = dict(docs.dtypes)
    return source.mapInArrow(run, ", ".join([f"`{c}` {types[c]}" for c in carry] + [f"`{o}` {OUTPUTS[o][1] if o in OUTPUTS else 'bigint'}" for o in outputs]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, ["n_assign", "n_access", "n_hex", "base_sha256", "span_text"])
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", found.span_text.alias("spans"))
