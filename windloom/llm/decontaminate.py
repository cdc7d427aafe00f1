"""Benchmark decontamination: one Aho-Corasick automaton over all windows of the test items.

Texts are normalised as bytes: A-Z become lower case, every other ASCII character that is not a
digit or a-z separates words, and bytes over 0x7F belong to words. A pattern is 13 consecutive item
words (or all of a shorter item). The automaton reads words as codes of one length, made from the
numbers of the items' words, so a match is always word-aligned and says where it ends in words; all
words that no item has share one more code. Each document is read once, and words map back to
offsets of the original text.

An automaton takes about 350 MB for a megabyte of item text (60 bytes for each of three or four
letters of each of 13 words), so it is built over ITEM_BYTES of them at most: thousands of
questions. A larger benchmark has several, which one task builds one after another over the texts
that it holds, so no more than one stands in memory and the table is still read once.

Nulls, empty texts and texts without words have no windows and no hits; items with a null id are
not used; repeated items count once by id; rows are judged one by one, so repeated rows or ids give
repeated results; empty tables give empty results or no hits. Extra columns are carried along,
whatever their names; a column with the name of the result is replaced.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windloom.llm.common import annotate, unused

WINDOW = 13
#: Bytes of item text for one automaton; bytes of it that are broadcast for one pass over the table.
ITEM_BYTES, SENT_BYTES = 1 << 20, 64 << 20
#: Rows and bytes of text that a task holds while it works through the automata.
HELD_ROWS, HELD_BYTES = 20_000, 64 << 20

_OTHER = bytes(c for c in range(128) if not (48 <= c <= 57 or 97 <= c <= 122))
TABLE = bytes.maketrans(bytes(range(65, 91)) + bytes(c for c in _OTHER if not 65 <= c <= 90), bytes(range(97, 123)) + b" " * len([c for c in _OTHER if not 65 <= c <= 90]))
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

FIELDS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("item_ids", T.ArrayType(T.LongType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("hits", T.BinaryType()),
])


def normal_words(text: bytes | None) -> list[bytes]:
    return text.translate(TABLE).split() if text else []


def patterns(items: list[tuple[int, bytes]], window: int) -> dict[tuple[bytes, ...], list[int]]:
    """Window -> ids of the items that hold it."""
    found: dict[tuple[bytes, ...], dict[int, None]] = {}
    for item, text in items:
        w = normal_words(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            found.setdefault(tuple(w[i : i + size]), {})[item] = None
    return {w: list(ids) for w, ids in found.items()}


class Scanner:
    """One automaton of all windows of some items, over codes of their words."""

    def __init__(self, items: list[tuple[int, bytes]], window: int):
        import ahocorasick

        found = patterns(items, window)
        known = sorted({w for key in found for w in key})
        # A code begins with a letter from 128 on and goes on with letters under 128; no word's code begins with OTHER.
        self.width, room = 1, 127
        while room < len(known):
            self.width, room = self.width + 1, room * 128
        self.codes = {}
        for i, w in enumerate(known):
            at, code = divmod(i, 127), ""
            code, rest = chr(128 + at[1]), at[0]
            for _ in range(self.width - 1):
                rest, digit = divmod(rest, 128)
                code += chr(digit)
            self.codes[w] = code
        self.other = "\xff" * self.width
        self.built = ahocorasick.Automaton()
        for key, ids in found.items():
            self.built.add_word("".join([self.codes[w] for w in key]), (len(key), ids))
        if found:
            self.built.make_automaton()

    def scan(self, tokens: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Word ranges (start, end) covered by matches, and the items matched."""
        if not tokens or not len(self.built):
            return [], set()
        ranges, items, get, other = [], set(), self.codes.get, self.other
        for end, (size, ids) in self.built.iter("".join([get(w, other) for w in tokens])):
            last = (end + 1) // self.width
            ranges.append((last - size, last))
            items.update(ids)
        return ranges, items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def original_spans(text: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as code-point offsets of the original text."""
    if not ranges:
        return []
    at = [(m.start(), m.end()) for m in WORD.finditer(text)]
    chars = lambda b: len(text[:b].decode("utf-8", "replace"))
    return [(chars(at[lo][0]), chars(at[hi - 1][1])) for lo, hi in ranges]


def dealt(benchmark: DataFrame, id_col: str, text_col: str, n_bytes: int):
    """The items in shares of about n_bytes of text; each is fetched by itself, when it is asked for."""
    items = benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = max(1, -(-total // n_bytes))
    part = F.pmod(F.xxhash64("i"), F.lit(n))
    for b in range(n):
        yield b + 1 == n, [(r["i"], r["t"].encode("utf-8", "surrogatepass")) for r in items.where(part == b).collect()]


def blocks(items: list[tuple[int, bytes]], n_bytes: int) -> list[list[tuple[int, bytes]]]:
    """The items in runs of about n_bytes of text, one at least."""
    found, size = [[]], 0
    for item in items:
        if size and size + len(item[1]) > n_bytes:
            found.append([])
            size = 0
        found[-1].append(item)
        size += len(item[1])
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, out: str = "contamination", keep: list[str] | None = None, item_bytes: int = ITEM_BYTES, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """Append struct `out`: n_words, n_hit (words inside matches), item_ids, spans (original offsets).

    One pass over the table for each `sent_bytes` of item text, which bounds what is broadcast; a
    pass hands its matches on to the next.
    """
    spark = docs.sparkSession
    kept = [c for c in (docs.columns if keep is None else keep) if c != out]
    carried = list(dict.fromkeys([*kept, text_col]))
    df, handed_as = docs, None
    for last, items in dealt(benchmark, item_id, item_text, sent_bytes):
        shared = spark.sparkContext.broadcast(items)

        def make(shared=shared, last=last):
            parts = blocks(shared.value, item_bytes)
            built = [Scanner(parts[0], window)]

            def work(texts, handed=None):
                tokens = [normal_words(t) for t in texts]
                ranges: list[list] = [[] for _ in texts]
                items: list[set] = [set() for _ in texts]
                if handed:
                    ranges = [[tuple(x) for x in np.frombuffer(h["hits"], np.int64).reshape(-1, 2).tolist()] for h in handed]
                    items = [set(h["item_ids"]) for h in handed]
                for part in parts:
                    if len(parts) > 1:  # the one before goes before the next is built
                        built.clear()
                        built.append(Scanner(part, window))
                    for w, r, ids in zip(tokens, ranges, items, strict=True):
                        more, matched = built[0].scan(w)
                        r += more
                        ids |= matched
                rows = []
                for text, w, r, ids in zip(texts, tokens, ranges, items, strict=True):
                    r = merged(r)
                    spans = [{"start": a, "end": b} for a, b in original_spans(text, r)] if last else []
                    rows.append((len(w), sum(b - a for a, b in r), sorted(ids), spans, b"" if last else np.array(r, np.int64).tobytes()))
                return rows

            return work

        inputs = [text_col]
        if handed_as:
            inputs.append(handed_as)
        target = out if last else unused("handed", docs)
        df = annotate(df, inputs, target, FIELDS, make, keep=kept if last else carried, piece=(HELD_ROWS, HELD_BYTES))
        handed_as = target
    return df.withColumn(out, F.col(f"`{out}`").dropFields("hits"))


def is_contaminated(found) -> Column:
    """The rule: any hit, and hits make up a twentieth of the words or more."""
    return (found["n_hit"] > 0) & (20 * found["n_hit"] >= found["n_words"])
