"""Phrase collocation mining over count streams in prefix and suffix order.

Texts (A-Z lower-cased, null as empty) are split at `.,;:!?` and line ends into pieces and those at spaces and
tabs into words. Phrases of 2 to LONGEST words with `least` contiguous occurrences or more are candidates,
by group (a null group is `und`). A cut after the first k words gives the counts l and r of both parts and
the score floor(1000*a*n/(l*r)), where n counts all words of the group; the lowest-scoring cut counts, of
equal ones that with the smallest k. Candidates inside a longer one that is as frequent are dropped.

Counting goes level by level: a phrase of k words is counted only where both its phrases of k-1 words may
be frequent. A fixed-size bit table of their hashes says so; a false yes costs a count, never a result. In
a task, words and then phrases are numbered, exactly, and counted before they are shuffled, and Spark adds
the counts, so no table of all phrases is ever in memory.

Estimation: the counts of frequent phrases are a stream. In prefix order (words from the left) a phrase
follows its beginnings, in suffix order (words from the right) its endings. One pass over each stream,
with the phrases that are still open on a stack of at most LONGEST, gives the counts of all left parts, of all
right parts, and the highest count of a one-word extension on either side. Both streams are then
merge-joined on the phrase. Streams are dealt by ranges of their first word; a range is streamed, so a
word that begins very many phrases costs time but no memory.

Rows with repeated or null ids count as they stand; ids are not read. Empty texts and tables give no words.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windloom.llm.common import LOWER, WordHash, grams, pieces, raw
from windloom.session import landed

LONGEST, LEAST, TOP = 5, 100, 2000
#: A candidate goes if a longer one has this share of its count, in a hundred.
COVER = 100
NO_GROUP = "und"
#: Bytes of text that a task counts before it emits, and bits of the table of frequent phrases (16 MB).
FLUSH, BITS = 16 << 20, 27

BREAKS = b".,;:!?\n\x0b\x0c\r"
#: What a byte is: part of a word, a blank or the end of a piece; and A-Z lower-cased.
WORD, BLANK, BREAK = 0, 1, 2
KIND = np.array([BREAK if b in BREAKS else BLANK if b in b" \t" else WORD for b in range(256)], np.uint8)
LOWERED = np.frombuffer(LOWER, np.uint8)


def tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(numbers, words, pieces) of all words of a string column in order: words[number] is the word, and words with the same piece follow each other without a break."""
    texts = texts.fill_null("").cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    text_starts = at[:-1] - at[0]
    kind = KIND[data]
    inside = kind == WORD
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = text_starts[text_starts < len(data)]
    begins[heads] |= inside[heads]
    begins = np.flatnonzero(begins)
    ends = np.append((np.cumsum(inside) - 1)[begins], inside.sum()).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(LOWERED[data[inside]].tobytes())])
    coded = found.dictionary_encode()
    piece = np.cumsum(kind == BREAK)[begins] + np.searchsorted(text_starts, begins, side="right")
    return coded.indices.to_numpy(), coded.dictionary, piece


def phrase_hash(h: np.ndarray, k: int, group: int) -> np.ndarray:
    """Bit numbers of all k-grams of word hashes."""
    return (grams(h ^ np.uint64(group), k) >> np.uint64(64 - BITS)).astype(np.int64)


def group_hash(group: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(group.encode("utf-8", "surrogatepass"))


def counted(numbers: np.ndarray, words: pa.Array, piece: np.ndarray, k: int, may: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray]:
    """(phrases, counts) of the k-grams within pieces; `may` says for each (k-1)-gram whether it may be frequent."""
    n = len(numbers) - k + 1
    if n <= 0:
        return words.slice(0, 0), np.empty(0, np.int64)
    if k == 1:
        return words, np.bincount(numbers, minlength=len(words))
    ok = piece[:n] == piece[k - 1 :]
    if may is not None:
        ok &= may[:n] & may[1 : n + 1]
    at = np.flatnonzero(ok)
    g = numbers[at].astype(np.int64)
    for j in range(1, k):  # numbers of the phrase so far and of its next word, side by side, are numbered again
        g = pa.array(g << 32 | numbers[at + j]).dictionary_encode().indices.to_numpy().astype(np.int64)
    n_each = np.bincount(g)
    first = np.empty(len(n_each), np.int64)
    first[g[::-1]] = at[::-1]
    return pc.binary_join_element_wise(*[words.take(pa.array(numbers[first + j])) for j in range(k)], pa.scalar(b" ", pa.large_binary())), n_each


COUNTS = "grp string, phrase string, f long"


def counts(docs: DataFrame, k: int, allowed: bytes | None) -> DataFrame:
    """(grp, phrase, f): phrases of k words, counted over all texts. `docs` holds (grp, text).

    `allowed` is the bit table of the phrases of k-1 words, of fixed size, which every task gets.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(allowed) if allowed is not None else None

    def run(batches):
        table = np.frombuffer(shared.value, np.uint8) if shared is not None else None

        def emitted(held):
            rows = pa.Table.from_batches(held)
            for group in pc.unique(rows.column(0)).to_pylist():
                texts = rows.column(1).filter(pc.equal(rows.column(0), group)).combine_chunks()
                numbers, words, piece = tokens(texts)
                may = None
                if table is not None:
                    cache = WordHash()
                    hashes = np.fromiter(map(cache.__getitem__, words.to_pylist()), np.uint64, len(words))
                    bit = phrase_hash(hashes[numbers], k - 1, group_hash(group))
                    may = (table[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
                phrases, n = counted(numbers, words, piece, k, may)
                for at in range(0, len(phrases), 100_000):
                    some = phrases.slice(at, 100_000).cast(pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([group] * len(some), pa.string()), some, pa.array(n[at : at + 100_000], pa.int64())], names=["grp", "phrase", "f"])

        held, size = [], 0
        for whole in batches:
            for b in pieces(whole):
                held.append(b)
                size += b.nbytes
                if size >= FLUSH:
                    yield from emitted(held)
                    held, size = [], 0
        if held:
            yield from emitted(held)

    return docs.mapInArrow(run, COUNTS).groupBy("grp", "phrase").agg(F.sum("f").alias("f"))


def bit_table(frequent: DataFrame, k: int) -> bytes:
    """The bit table of phrases: tasks set bits, Spark joins them in maps of 32,768 bits. Its size, 16 MB, does not depend on the number of phrases."""

    def run(batches):
        cache = WordHash()
        for b in batches:
            bits = np.empty(b.num_rows, np.int64)
            for i, (group, phrase) in enumerate(zip(b.column(0).to_pylist(), raw(b.column(1)), strict=True)):
                h = np.fromiter((cache[w] for w in phrase.split(b" ")), np.uint64, k)
                bits[i] = phrase_hash(h, k, group_hash(group))[0]
            if len(cache) > 400_000:
                cache.clear()
            yield pa.RecordBatch.from_arrays([pa.array(bits)], names=["bit"])

    each = frequent.select("grp", "phrase").mapInArrow(run, "bit long")
    maps = each.groupBy(F.shiftright("bit", 15).alias("i")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND((1 << 15) - 1)).alias("bits"))
    out, width = bytearray(1 << (BITS - 3)), 1 << 12
    for r in maps.collect():  # 4,096 rows at most
        out[r["i"] * width : (r["i"] + 1) * width] = r["bits"]
    return bytes(out)


def streams(frequent: DataFrame, suffix: bool) -> DataFrame:
    """(grp, phrase, f, parts, longer): for each phrase the counts of its first (or last) 1, 2, .. words, and the highest count of a phrase with one word more on the other end.

    `frequent` holds (grp, phrase, f), with every beginning and ending of each phrase.
    """
    words = F.split("phrase", " ", -1)
    keyed = frequent.withColumn("w", F.reverse(words) if suffix else words)
    n = max(1, int(frequent.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = keyed.repartitionByRange(n, "grp", F.col("w")[0]).sortWithinPartitions("grp", "w").select("grp", "phrase", "f", "w")

    def run(batches):
        open_: list[list] = []  # group, words, phrase, count, highest longer count; each is a beginning of the next
        done: list[tuple] = []

        def close(item):
            done.append((item[0], item[2], item[3], [x[3] for x in open_], item[4]))

        def batch():
            cols = list(zip(*done, strict=True)) if done else [[]] * 5
            kinds = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int64()]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["grp", "phrase", "f", "parts", "longer"])
            done.clear()
            return made

        for b in batches:
            for group, phrase, f, w in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                while open_ and (open_[-1][0] != group or open_[-1][1] != w[: len(open_[-1][1])]):
                    close(open_.pop())
                if open_ and len(w) == len(open_[-1][1]) + 1:
                    open_[-1][4] = max(open_[-1][4], f)
                open_.append([group, w, phrase, f, 0])
            yield batch()
        while open_:
            close(open_.pop())
        yield batch()

    schema = T.StructType([T.StructField("grp", T.StringType()), T.StructField("phrase", T.StringType()), T.StructField("f", T.LongType()), T.StructField("parts", T.ArrayType(T.LongType())), T.StructField("longer", T.LongType())])
    return ordered.mapInArrow(run, schema)


def big(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def frequent_phrases(docs: DataFrame, group_col: str | None, text_col: str, longest: int, least: int) -> tuple[DataFrame, DataFrame]:
    """(grp, phrase, f) of all phrases of 1 to `longest` words that occur `least` times, and (grp, n) of all words."""
    group = F.lit(NO_GROUP) if group_col is None else F.coalesce(F.col(f"`{group_col}`").cast("string"), F.lit(NO_GROUP))
    rows = docs.select(group.alias("grp"), F.col(f"`{text_col}`").alias("text"))
    every = landed(counts(rows, 1, None), "phrases")
    sizes = every.groupBy("grp").agg(F.sum("f").alias("n"))
    now = every.where(F.col("f") >= least)
    found = now
    for k in range(2, longest + 1):
        now = landed(counts(rows, k, bit_table(now, k - 1)).where(F.col("f") >= least), "phrases")
        found = found.unionByName(now)
        if now.isEmpty():
            break
    return found, sizes


def collocations(docs: DataFrame, *, group_col: str | None = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST, cover: int = COVER) -> DataFrame:
    """(grp, phrase, k, a, l, r, n, score) of all candidates that stay; k is the cut, score a long."""
    frequent, sizes = frequent_phrases(docs, group_col, text_col, longest, least)
    ahead = landed(streams(frequent, False), "prefix-stream").select("grp", "phrase", F.col("f").alias("a"), F.col("parts").alias("lefts"), F.col("longer").alias("longer_right"))
    back = landed(streams(frequent, True), "suffix-stream").select("grp", "phrase", F.reverse("parts").alias("rights"), F.col("longer").alias("longer_left"))
    met = ahead.where(F.size("lefts") > 0).join(back.hint("merge"), ["grp", "phrase"])
    met = met.where(100 * F.greatest("longer_right", "longer_left") < cover * F.col("a")).join(sizes.hint("merge"), "grp")
    # lefts[k-1] counts the first k words, rights[k-1] what follows them.
    cuts = F.transform(F.arrays_zip("lefts", "rights"), lambda x, i: F.struct(floored(F.col("a"), F.col("n"), x["lefts"], x["rights"]).alias("score"), (i + 1).alias("k"), x["lefts"].alias("l"), x["rights"].alias("r")))
    return met.withColumn("cut", F.array_min(cuts)).select("grp", "phrase", "cut.k", "a", "cut.l", "cut.r", "n", "cut.score")


def floored(a: Column, n: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000*a*n/(l*r)) in whole numbers of 38 digits. The result fits a long, as a is at most l and r; the products need not."""
    top = F.lit(1000).cast("decimal(4,0)") * (big(a) * big(n)).cast("decimal(33,0)")
    low = (big(l) * big(r)).cast("decimal(38,0)")
    return ((top - top % low) / low).cast("decimal(38,0)").cast("long")


def best(found: DataFrame, top: int = TOP) -> DataFrame:
    """(grp, rank, ..): each group's first by score, then count, then phrase in byte order. Spark keeps `top` rows a task and group before the shuffle."""
    order = Window.partitionBy("grp").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
