"""Byte-level BPE with cached units, exact against the ``tokenizers`` library.

A unit is a stretch between single blanks or single line feeds. The split pattern of byte-level BPE always breaks before a blank that
stands between two other characters, and on both sides of such a line feed, so a text's ids are its units' ids in a row. A text where
that does not hold (white space beside white space, at an end, or a special token's string) goes to the library whole.
"""

from __future__ import annotations

import base64
import os
from array import array
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidegraph.store import discard, materialize

SPECIAL = "<|endoftext|>"
LINE = array("I", [198]).tobytes()
_LATIN = "ɐ"  # below it the two libraries' character tables agree; other units go to ``tokenizers``
LONG = 200  # characters of the shortest unit that no cache keeps


def vocabulary(name: str = "byte_bpe_50k") -> str:
    """Path without its ending of a public vocabulary; both forms lie side by side."""
    import public_tokenizers

    return os.path.splitext(public_tokenizers.path(f"{name}.json"))[0]


@lru_cache(2)
def _coders(path: str):
    import public_tokenizers

    with open(f"{path}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(f"{path}.json"), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Odd(Exception):
    """The text can't be cut into units."""


class _Cache(dict):
    """Unit to value, bounded by ``most`` bytes; a full cache starts again from ``seed``."""

    def __init__(self, coder: Coder, make, seed: dict, most: int):
        super().__init__(seed)
        self.coder, self.make, self.seed, self.most, self.used = coder, make, seed, most, 0

    def __missing__(self, unit: str):
        line = unit[:1] == "\n"
        body = unit[1:] if line else unit
        if not body or body[0].isspace() or body[-1].isspace():
            raise Odd
        value = self.make(self.coder.ids(body if line else " " + body), line)
        if len(unit) < LONG:
            self.used += 200 + len(unit) + (len(value) if isinstance(value, bytes) else 0)  # with an entry's share of the table
            if self.used > self.most:
                self.clear()
                self.update(self.seed)
                self.used = 0
            self[unit] = value
        return value


class Coder:
    def __init__(self, path: str):
        self.tokenizer, self.fast = _coders(path)
        self.cut = self.fast.encode_ordinary

    def ids(self, piece: str) -> list[int]:
        if max(piece) < _LATIN and len(piece) < 2000:
            return self.cut(piece)
        return self.whole(piece)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids


def units(text: str) -> list[str]:
    """Units of a text; one that begins with a line feed follows one (the first one too), the others follow a blank."""
    return ("\n" + text).replace("\n", " \n").split(" ")[1:]


class Counts:
    """Token counts of texts. ``frequent``: unit to count, the first tier; the worker's own cache is the second."""

    def __init__(self, path: str, frequent: dict[str, int] | None = None, most: int = 32 << 20):
        self.coder = Coder(path)
        self.get = _Cache(self.coder, lambda ids, line: len(ids) + line, frequent or {}, most).__getitem__

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        if SPECIAL in text:
            return len(self.coder.whole(text))
        try:
            return sum(map(self.get, units(text))) - 1
        except Odd:
            return len(self.coder.whole(text))


class Ids:
    """Token ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, most: int = 32 << 20):
        self.coder = Coder(path)
        self.get = _Cache(self.coder, lambda ids, line: (LINE if line else b"") + array("I", ids).tobytes(), {}, most).__getitem__

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if SPECIAL not in text:
            try:
                return b"".join(map(self.get, units(text)))[4:]
            except Odd:
                pass
        return array("I", self.coder.whole(text)).tobytes()


def unit_counts(texts: pa.Array) -> pa.Table:
    """The different units of an array of texts and how often each occurs: ``units`` for a whole array, less what tier two wouldn't keep (200 characters
    or more) and texts with a special token's string, which aren't cut."""
    wide = texts.cast(pa.large_string()).drop_null()
    wide = wide.filter(pc.invert(pc.match_substring(wide, SPECIAL)))
    first, end = pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string())
    lines = pc.replace_substring(pc.binary_join_element_wise(first, wide, end), "\n", " \n")
    seen = pc.split_pattern(lines, " ").flatten().value_counts()
    size = pc.utf8_length(seen.field("values"))
    found = seen.filter(pc.and_(pc.greater(size, 0), pc.less(size, LONG)))
    return pa.table({"unit": found.field("values").cast(pa.string()), "n": found.field("counts")})


def frequent_units(docs: DataFrame, most: int, path: str) -> dict[str, int]:
    """Token counts of the ``most`` most frequent units of all texts, among those that occur twice at least (any of equally frequent ones at the end).

    Units are counted over whole texts, in the map tasks first. How many units have each frequency says which frequency is the least, so the driver gets
    those numbers and ``most`` units. It only fills the first tier ahead: any units give the same results."""

    def count(batches):
        for b in batches:
            yield from unit_counts(b.column("text")).to_batches()

    parts = docs.select("text").mapInArrow(count, "unit string, n long")
    often = materialize(parts.groupBy("unit").agg(F.sum("n").alias("n")).where("n > 1"), "units")
    try:
        left, least = most, None
        for n, k in sorted(often.groupBy("n").count().collect(), reverse=True):
            if k > left:
                least = n
                break
            left -= k
        rows = often.where(F.col("n") > (least or 0)).collect()
        if least and left:
            rows += often.where(F.col("n") == least).limit(left).collect()
    finally:
        discard(often)
    counts, out = Counts(path), {}
    for row in rows:
        try:
            out[row.unit] = counts.get(row.unit)
        except Odd:
            continue
    return out
