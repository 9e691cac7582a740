"""Byte-level BPE by prefix dynamic programming.

A merge order gives every byte string exactly one encoding, and a token sequence is that encoding
exactly when each token and each pair of neighbours encode to themselves. So every prefix of a
string has one valid last token, and the table of last tokens holds all encodings of all prefixes:
following it back from the end spells the encoding, bytes appended later only add entries, and an
edit leaves all entries before it as they are.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .runtime import attach, pieces

#: Output columns that `code` can give, with their types.
OUTPUTS = {
    "n_tokens": pa.int64(),
    "ids": pa.list_(pa.int32()),
    "ids_sha256": pa.string(),
    "decoded": pa.string(),
    "decoded_sha256": pa.string(),
}
_DDL = {"n_tokens": "bigint", "ids": "array<int>", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}

#: Entries of each of the two generations of the piece memo, of the pair memo and of the shared prefix table; characters of
#: the longest piece that is remembered.
MEMO, PAIRS, PREFIXES, LONGEST = 150_000, 200_000, 150_000, 64

#: Bytes up to which a string is short.
SHORT = 32


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a .tiktoken file."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x)}


class PrefixBPE:
    """Encodes byte strings with the ranks of a byte-level vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self._valid: dict[int, bool] = {}
        self._pair: dict[tuple[int, int], bool] = {}
        self._split: dict[int, tuple[int, int] | None] = {}
        self._known: dict[bytes, int] = {}
        #: What tokens end with, and of each the tokens that it ends with itself, the longest first, with their lengths.
        self._ending: dict[bytes, tuple[tuple[int, int], ...]] = {b"": ()}
        for b in ranks:
            for i in range(len(b) - 1, -1, -1):
                if (end := b[i:]) not in self._ending:
                    shorter = self._ending[b[i + 1 :]]
                    self._ending[end] = ((len(end), ranks[end]), *shorter) if end in ranks else shorter

    def _merged(self, data: bytes, least: int = 1) -> list[int]:
        """Encoding of a short string straight from the definition: merge the lowest rank first, down to `least` parts."""
        get, never = self.ranks.get, 1 << 40
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = [get(data[i : i + 2], never) for i in range(len(data) - 1)]
        while len(parts) > least and (low := min(ranks)) < never:
            at = ranks.index(low)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = get(parts[at - 1] + parts[at], never)
            if at < len(ranks):
                ranks[at] = get(parts[at] + parts[at + 1], never)
        return [self.ranks[p] for p in parts]

    def _alone(self, token: int) -> bool:
        ok = self._valid.get(token)
        if ok is None:
            ok = self._valid[token] = self._merged(self.bytes_of[token]) == [token]
        return ok

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge, the last one, makes a token; None of a byte, and of a token that its merges don't give."""
        halves = self._split.get(token, 0)
        if halves == 0:
            parts = self._merged(self.bytes_of[token], 2) if self._alone(token) else []
            halves = self._split[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return halves

    def _together(self, left: int, right: int) -> bool:
        """Whether two tokens side by side stay as they are: taking merges back, the latest first, no pair across
        the border may have a lower rank than the merge that has taken one of the two."""
        ok = self._pair.get((left, right))
        if ok is None:
            if len(self._pair) >= PAIRS:
                self._pair.clear()
            ok = self._pair[left, right] = self._stay(left, right)
        return ok

    def _stay(self, left: int, right: int) -> bool:
        if not (self._alone(left) and self._alone(right)):
            return False
        get, raw, halves = self.ranks.get, self.bytes_of, self._halves
        x, y, limit = left, right, 1 << 40
        while True:
            across = get(raw[x] + raw[y])
            if across is not None and across < limit:
                return False
            a, b = halves(x), halves(y)
            if a and (not b or x > y):  # of equal ranks the left one merges first, so the right one is taken back first
                limit, x = x, a[1]
            elif b:
                limit, y = y + 1, b[0]
            else:
                return True

    def _last(self, data: bytes, end: int, before: Callable[[int], int]) -> int:
        """The valid last token of data[:end]; before(i) has that of data[:i]."""
        ending, fits, start = self._ending.get, (), end - 1
        while start >= 0 and (found := ending(data[start:end])) is not None:  # else no token ends with these bytes, nor with more of them
            fits, start = found, start - 1
        pair = self._pair.get
        for length, token in fits:
            if length == end:
                ok = self._alone(token)
            else:
                left = before(end - length)
                ok = pair((left, token))
                if ok is None:
                    ok = self._together(left, token)
            if ok:
                return token
        raise ValueError("the vocabulary lacks a byte")

    def last_tokens(self, data: bytes, table: list[int] | None = None) -> list[int]:
        """The last token of each prefix of data; table has those of a shorter prefix already."""
        table = [-1] if table is None else table
        for end in range(len(table), len(data) + 1):
            table.append(self._last(data, end, table.__getitem__))
        return table

    def _short(self, data: bytes) -> list[int]:
        """Encoding by a table that short strings share: equal prefixes have equal last tokens. Only prefixes that a later one asks about are filled in."""
        known = self._known
        if len(known) >= PREFIXES:
            known.clear()

        def before(end: int) -> int:
            token = known.get(part := data[:end])
            if token is None:
                token = known[part] = self._last(data, end, before)
            return token

        out, at = [], len(data)
        while at:
            out.append(before(at))
            at -= len(self.bytes_of[out[-1]])
        return out[::-1]

    def spell(self, table: list[int]) -> list[int]:
        out, at = [], len(table) - 1
        while at:
            out.append(table[at])
            at -= len(self.bytes_of[table[at]])
        return out[::-1]

    def edit(self, table: list[int], data: bytes, start: int, end: int, new: bytes) -> tuple[list[int], bytes]:
        """Table and bytes after data[start:end] has become new; recomputes only near the edit.

        An entry depends on the `longest` entries before it, so as many equal ones in a row fix the rest.
        """
        after = data[:start] + new + data[end:]
        fresh, shift, same = table[: start + 1], len(new) - (end - start), 0
        while len(fresh) <= len(after):
            if same >= self.longest:
                fresh += table[len(fresh) - shift :]
                break
            at = len(fresh)
            self.last_tokens(after[:at], fresh)
            same = same + 1 if at > start + len(new) and table[at - shift] == fresh[at] else 0
        return fresh, after

    def encode(self, data: bytes) -> list[int]:
        """A string that is itself in the vocabulary is one token, whatever its merges would give."""
        if not data:
            return []
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        return self._short(data) if len(data) <= SHORT else self.spell(self.last_tokens(data))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])


def _latin_pattern(pattern: str) -> re.Pattern:
    """The same pattern for texts below U+0250, its classes written out for the standard matcher."""
    low = [chr(i) for i in range(0x250)]
    letters = "".join(re.escape(c) for c in low if unicodedata.category(c)[0] == "L")
    numbers = "".join(re.escape(c) for c in low if unicodedata.category(c)[0] == "N")
    space = r"\t-\r \x85\xa0"
    for old, new in ((r"[^\s\p{L}\p{N}]", f"[^{space}{letters}{numbers}]"), (r"\p{L}", f"[{letters}]"), (r"\p{N}", f"[{numbers}]"), (r"\s", f"[{space}]"), (r"\S", f"[^{space}]")):
        pattern = pattern.replace(old, new)
    return re.compile(pattern)


class TextCodec:
    """Splits texts by a pattern and encodes each match on its own; remembers recent pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.bpe = PrefixBPE(ranks)
        self._any, self._latin = regex.compile(pattern).findall, _latin_pattern(pattern).findall
        self._beyond = re.compile("[ɐ-\U0010ffff]").search
        codec = self

        class Memo(dict):
            older: dict = {}

            def __missing__(self, piece: str) -> tuple[str, bytes]:
                found = self.older.get(piece)
                if found is None:
                    ids = codec.bpe.encode(piece.encode())
                    found = (" ".join(map(str, ids)), codec.bpe.decode(ids))
                if len(piece) > LONGEST:
                    return found
                if len(self) >= MEMO:
                    self.older = dict(self)
                    self.clear()
                self[piece] = found
                return found

        self.memo = Memo()

    def pieces(self, text: str) -> list[str]:
        return self._any(text) if self._beyond(text) else self._latin(text)

    def code(self, text: str) -> tuple[str, bytes]:
        """Ids as decimals joined by a space, and the bytes that these ids decode to."""
        memo = self.memo
        found = [memo[p] for p in self.pieces(text)]
        return " ".join([f[0] for f in found]), b"".join([f[1] for f in found])

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.code(text)[0].split()]

    def append(self, text: str, ids: list[int], more: str) -> list[int]:
        """Ids of text + more from those of text: only the last piece can change."""
        pieces = self.pieces(text)
        if not pieces:
            return self.encode(text + more)
        last = pieces[-1]
        return ids[: len(ids) - len(self.encode(last))] + self.encode(last + more)


@lru_cache(maxsize=2)
def _codec(data: bytes, pattern: str) -> TextCodec:
    return TextCodec(read_ranks(data), pattern)


def code(docs: DataFrame, ranks_file: str, pattern: str, outputs: list[str], text_col: str = "text") -> DataFrame:
    """docs with the chosen OUTPUTS of each whole text encoded and decoded again.

    A null text is coded as the empty one: no ids, decoded to empty. Any length is coded whole. An
    input column named like an output is replaced by it; all other columns stay. Rows do not meet,
    so nothing is shuffled; equal rows give equal outputs. ranks_file is read on the driver, and its
    bytes (a vocabulary, of fixed size) go to the executors.
    """
    with open(ranks_file, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())
    stay = attach(docs, outputs)
    carry = [c for c in stay if c != text_col] + [text_col] * (text_col in stay)
    source = docs.select(*carry, *([] if text_col in carry else [docs[text_col]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(held.value, pattern)
        for batch in pieces(batches):
            rows: dict[str, list] = {o: [] for o in outputs}
            for text in batch.column(batch.schema.get_field_index(text_col)):
                joined, raw = codec.code(text.as_py() or "")
                for name in outputs:
                    rows[name].append(_GIVE[name](joined, raw))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in carry]
            yield pa.RecordBatch.from_arrays(columns + [_lists(rows[o]) if o == "ids" else pa.array(rows[o], OUTPUTS[o]) for o in outputs], names=carry + outputs)

    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in carry] + [f"`{o}` {_DDL[o]}" for o in outputs])
    return source.mapInArrow(run, schema)


_GIVE: dict[str, Callable[[str, bytes], object]] = {
    "n_tokens": lambda joined, raw: joined.count(" ") + 1 if joined else 0,
    "ids": lambda joined, raw: np.fromstring(joined, np.int32, sep=" "),
    "ids_sha256": lambda joined, raw: hashlib.sha256(joined.encode()).hexdigest(),
    "decoded": lambda joined, raw: raw.decode("utf-8", "replace"),
    "decoded_sha256": lambda joined, raw: hashlib.sha256(raw).hexdigest(),
}


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *rows])))


def vocabulary(path: str | None = None) -> tuple[str, str]:
    """File of ranks and split pattern; the public 50k vocabulary unless a path is given."""
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .runtime import table

    file, pattern = vocabulary()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = code(docs, file, pattern, ["n_tokens", "ids_sha256", "decoded_sha256"])
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
