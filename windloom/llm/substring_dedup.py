"""Substring dedup by super-k-mers: words covered by a repeated 20-word window are removed.

A window's minimiser is the least hash of the m-grams of words inside it. It depends on the window's
words alone, so equal windows always meet in the bucket of their minimiser, and consecutive windows
that share it travel as one packed string of word codes. Inside a bucket, windows are sorted by
fingerprint and compared word by word: counts are exact whatever the hash does.

Hot passages: each task packs a super-k-mer once with its first position there; at the others all
windows are repeats, which is known without its bucket. m-grams that many documents of a sample hold
come last in the order of hashes. So where a passage runs on into the text of each document, the
windows on its edges get their minimiser from that text and spread over all buckets; windows wholly
inside it are the same strings everywhere. A bucket gets one of them from a task, not one from a
document. The sample only balances: which m-grams are taken for common changes no result.

Words are runs without ASCII white space of the whole text. A window is judged on the input: it is
repeated if the same words start earlier (smaller doc_id, or same document and earlier start).

Null or empty texts have no words. Rows with a null doc_id are neither sources nor judged: nothing
is removed. Repeated rows (same doc_id and text) are one document at the same positions, so none of
them is earlier than the other. Different texts under one doc_id are documents of their own, in the
order of a 31-bit tag of their text; all other rows have tag 0. Texts under 20 words have no windows. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windloom.llm.common import WordHash, annotate, grams, hash_words, mixed, parts_for, pieces, raw, size_of, sliding_min, unused, words
from windloom.session import landed

WINDOW, MINIMISER = 20, 4
#: Bytes of text for a bucket's share, buckets in a partition, windows in one packed string at most,
#: words that a task holds before it hands its packed strings on.
BUCKET_BYTES, BUCKETS_EACH, LONGEST, HELD_WORDS = 6 << 20, 2, 512, 3_000_000

#: Documents of the sample for common m-grams, and the share of them that makes one common.
SAMPLE_DOCS, COMMON = 5_000, 0.01

_B = np.uint64(0x9E3779B97F4A7C15)
_B_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Codes(dict):
    """word -> its number, in the order of first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i]+1, ... count[i] numbers for each i, in a row."""
    total = int(count.sum())
    begin = np.cumsum(count) - count
    return np.arange(total) - np.repeat(begin - first, count)


def ordered(g: np.ndarray, common: np.ndarray | None) -> np.ndarray:
    """Hashes of m-grams by which the least is chosen: common ones (given in ascending order) are larger than all others."""
    g = g >> np.uint64(1)
    if common is not None and len(common) and len(g):
        at = np.minimum(np.searchsorted(common, g), len(common) - 1)
        g = g | ((common[at] == g).astype(np.uint64) << np.uint64(63))
    return g


def common_grams(docs: DataFrame, n_rows: int, text_col: str, m: int = MINIMISER) -> np.ndarray:
    """Halved hashes of the m-grams in COMMON of the documents of a sample or more, ascending; no more than 1 / COMMON times those of a document."""

    def run(batches):
        import pyarrow as pa

        cache, found = WordHash(), []
        for whole in batches:
            for b in pieces(whole):
                for text in raw(b.column(0)):
                    w = words(text)
                    found.append(np.unique(grams(hash_words(cache, w), m)) >> np.uint64(1) if w else np.empty(0, np.uint64))
        g, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], names=["g", "n"])

    texts = docs.select(F.col(f"`{text_col}`").alias("t")).where("t is not null")
    share = SAMPLE_DOCS / max(1, n_rows)
    sample = texts.sample(share, 11) if share < 1 else texts
    least = max(2, int(COMMON * min(n_rows, SAMPLE_DOCS)))
    rows = sample.mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("g").toPandas()
    return np.sort(rows["g"].to_numpy(np.int64).view(np.uint64))


def super_kmers(h: np.ndarray, begin: np.ndarray, size: np.ndarray, window: int = WINDOW, m: int = MINIMISER, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, numbers of windows, minimisers and documents (by number) of the super-k-mers of many documents whose word hashes stand one after another."""
    n_win = np.maximum(size - window + 1, 0)
    starts = spread(begin, n_win)
    if not len(starts):
        return starts, starts, np.empty(0, np.uint64), starts
    least = sliding_min(ordered(grams(h, m), common), window - m + 1)[starts]
    first = np.zeros(len(starts), bool)
    first[(np.cumsum(n_win) - n_win)[n_win > 0]] = True
    first[1:] |= least[1:] != least[:-1]
    lead = np.flatnonzero(first)
    since = np.arange(len(starts)) - np.repeat(lead, np.diff(np.append(lead, len(starts))))
    lead = np.flatnonzero(since % LONGEST == 0)
    return starts[lead], np.diff(np.append(lead, len(starts))), least[lead], np.repeat(np.arange(len(size)), n_win)[lead]


def equal_runs(codes: np.ndarray, start: np.ndarray, length: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether codes[start:start+length] and codes[other:other+length] agree, for many at once; some runs at a time."""
    agree = np.empty(len(start), bool)
    ends = np.cumsum(length)
    for a in range(0, len(start), 50_000):
        part = slice(a, a + 50_000)
        differ = codes[spread(start[part], length[part])] != codes[spread(other[part], length[part])]
        agree[part] = np.add.reduceat(differ, ends[part] - length[part] - (ends[a] - length[a]), dtype=np.int32) == 0
    return agree


def grouped(codes: np.ndarray, h: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the runs in which equal ones are neighbours, and where each group begins in it."""
    power = np.full(len(h) + 1, _B)
    power[0] = 1
    inverse = np.full(len(h) + 1, _B_INVERSE)
    inverse[0] = 1
    np.multiply.accumulate(power, out=power)
    np.multiply.accumulate(inverse, out=inverse)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[:-1])])
    key = (sums[start + length] - sums[start]) * inverse[start]
    order = np.argsort(key, kind="stable")
    a, b = order[:-1], order[1:]
    same = (key[a] == key[b]) & (length[a] == length[b])
    near = np.flatnonzero(same)
    same[near] = equal_runs(codes, start[a[near]], length[a[near]], start[b[near]])
    return order, np.flatnonzero(np.concatenate([[True], ~same])) if len(order) else order


def packed(docs: DataFrame, id_col: str, text_col: str, n_buckets: int, window: int, common: np.ndarray, tag_col: str | None = None) -> DataFrame:
    """(bucket, later, blob): a task's super-k-mers of a bucket, words as codes into the blob's own word list; or, as `later`, runs that it knows to be repeats.

    A position is the document's tag in the high half and the word's number in the low half.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        ids, tags, texts, n = [], [], [], 0
        codes = Codes()
        for whole in batches:
            for b in pieces(whole):
                for doc, text, tag in zip(b.column(0).to_pylist(), raw(b.column(1)), b.column(2).to_pylist(), strict=True):
                    w = words(text)
                    if len(w) >= window:
                        ids.append(doc)
                        tags.append(tag)
                        texts.append(np.fromiter(map(codes.__getitem__, w), np.int32, len(w)))
                        n += len(w)
                    if n > HELD_WORDS:
                        yield from packed_chunk(ids, tags, texts, codes, n_buckets, window, shared.value)
                        ids, tags, texts, n, codes = [], [], [], 0, Codes()
        yield from packed_chunk(ids, tags, texts, codes, n_buckets, window, shared.value)

    kept = docs.select(F.col(f"`{id_col}`").cast("long").alias("d"), F.col(f"`{text_col}`").alias("t"), (F.lit(0) if tag_col is None else F.col(f"`{tag_col}`")).cast("long").alias("g")).where("d is not null and t is not null")
    return kept.mapInArrow(run, "bucket int, later boolean, blob binary")


def packed_chunk(ids: list[int], tags: list[int], texts: list[np.ndarray], codes: Codes, n_buckets: int, window: int, common: np.ndarray):
    import pyarrow as pa
    import xxhash

    if not ids:
        return
    # Words in sorted order: so does each blob's own list hold them, and neighbours share beginnings.
    vocabulary = sorted(codes)
    rank = np.empty(len(codes), np.int32)
    rank[np.fromiter(map(codes.__getitem__, vocabulary), np.int64, len(codes))] = np.arange(len(codes), dtype=np.int32)
    flat, size = rank[np.concatenate(texts)], np.fromiter(map(len, texts), np.int64, len(texts))
    texts.clear()
    begin = np.cumsum(size) - size
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, vocabulary), np.uint64, len(vocabulary))[flat]
    start, n_win, least, doc = super_kmers(h, begin, size, window, common=common)
    length = n_win + window - 1
    order, lead = grouped(flat, h, start, length)
    del h
    # By group, then position: the first of each group travels, the others are repeats of it.
    group = np.repeat(np.arange(len(lead)), np.diff(np.append(lead, len(order))))
    where_doc, where_start = np.array(ids, np.int64)[doc[order]], (start - begin[doc] + (np.array(tags, np.int64) << 32)[doc])[order]
    by = np.lexsort((where_start, where_doc, group))
    order, where_doc, where_start = order[by], where_doc[by], where_start[by]
    head, first_doc, first_start = order[lead], where_doc[lead], where_start[lead]
    later = (where_doc != first_doc[group]) | (where_start != first_start[group])
    if later.any():
        data = np.stack([where_doc[later], where_start[later], n_win[order[later]]]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([hash((ids[0], len(ids))) % n_buckets], pa.int32()), pa.array([True]), pa.array([pack_runs(data)], pa.binary())], names=["bucket", "later", "blob"])
    # By bucket: the heads and their first positions.
    bucket = (mixed(least[head]) % np.uint64(n_buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], np.diff(bucket[by]) != 0]))
    number = np.empty(len(vocabulary), np.int32)
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(by)], strict=True):
        own = by[a:b]
        all_codes = flat[spread(start[head[own]], length[head[own]])]
        used = np.flatnonzero(np.bincount(all_codes, minlength=len(vocabulary)))
        number[used] = np.arange(len(used))
        blob = pack([vocabulary[i] for i in used.tolist()], number[all_codes], length[head[own]], np.ones(len(own), np.int64), first_doc[own], first_start[own])
        yield pa.RecordBatch.from_arrays([pa.array([int(bucket[own[0]])], pa.int32()), pa.array([False]), pa.array([blob], pa.binary())], names=["bucket", "later", "blob"])


def planes(x: np.ndarray, width: int) -> bytes:
    """Integers byte by byte: all lowest bytes, then the next ones; such planes deflate well."""
    return np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()


def unplaned(data: bytes, width: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel().astype(np.int64)


def pack(vocabulary: list[bytes], codes: np.ndarray, n_words: np.ndarray, n_at: np.ndarray, doc: np.ndarray, start: np.ndarray) -> bytes:
    """One binary for many super-k-mers: word list, codes, word counts, position counts and positions."""
    import zstandard

    parts = [b" ".join(vocabulary), planes(codes, 4), planes(n_words, 4), planes(n_at, 4), planes(doc.view(np.uint64), 8), planes(start, 8)]
    head = np.array([len(vocabulary), *map(len, parts)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(parts))


def pack_runs(data: np.ndarray) -> bytes:
    """Documents, starts and windows of runs, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(b"".join(planes(x.view(np.uint64), 8) for x in data))


def unpack_runs(blob: bytes) -> np.ndarray:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(blob)
    n = len(data) // 3
    return np.stack([unplaned(data[i * n : (i + 1) * n], 8) for i in range(3)])


def unpack(blob: bytes, codes: Codes):
    """Codes in the reader's own numbering, word counts, position counts, documents, starts."""
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(blob)
    n_words, *sizes = np.frombuffer(data, np.int64, 7).tolist()
    cut = list(accumulate(sizes, initial=56))
    part = [data[a:b] for a, b in zip(cut, cut[1:], strict=False)]
    own = np.fromiter(map(codes.__getitem__, part[0].split(b" ")), np.int64, n_words)
    return own[unplaned(part[1], 4)], unplaned(part[2], 4), unplaned(part[3], 4), unplaned(part[4], 8), unplaned(part[5], 8)


def window_hashes(h: np.ndarray, window: int) -> np.ndarray:
    """A hash of each run of `window` values, from those of runs of powers of two."""
    n = len(h) - window + 1
    acc, at, size, run, base = np.zeros(n, np.uint64), 0, 1, h, _B
    while at < window:
        if window & size:
            acc = acc * base + run[at : at + n]
            at += size
        if size * 2 <= window:
            run = run[:-size] * base + run[size:]
        size *= 2
        with np.errstate(over="ignore"):
            base = base * base
    return mixed(acc)


def repeats(blobs: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one bucket: (doc, start, windows) of every run of windows that also start earlier."""
    codes = Codes()
    read = [unpack(b, codes) for b in blobs]
    flat, n_words, n_at, doc, start = (np.concatenate([r[i] for r in read]) for i in range(5))
    n_win = n_words - window + 1
    # The first position of each super-k-mer; at every other, all its windows are repeats.
    owner = np.repeat(np.arange(len(n_at)), n_at)
    order = np.lexsort((start, doc, owner))
    begin = np.cumsum(n_at) - n_at
    head = order[begin]
    first_doc, first_start = doc[head], start[head]
    later = (doc != first_doc[owner]) | (start != first_start[owner])
    out = [(doc[later], start[later], n_win[owner[later]])]
    # One fingerprint for each window of each super-k-mer, sorted; equal neighbours are compared.
    h = mixed(np.arange(len(codes), dtype=np.uint64) + np.uint64(1))[flat]
    at = spread(np.cumsum(n_words) - n_words, n_win)
    key = window_hashes(h, window)[at]
    del h
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    del key
    near = np.flatnonzero(same)
    if len(near):
        taken = np.zeros(len(order), bool)
        taken[near] = taken[near + 1] = True
        chosen = order[taken]
        follows = np.concatenate([[False], same])[taken]  # its key is that of the one before
        group = np.cumsum(~follows)
        clash = np.zeros(len(chosen), bool)
        for j in range(window):
            word = flat[at[chosen] + j]
            clash[1:] |= word[1:] != word[:-1]
        if (clash & follows).any():  # keys that agree by chance: group by the words themselves
            rows = np.ascontiguousarray(flat[at[chosen][:, None] + np.arange(window)].astype(np.uint32))
            group = np.unique(rows.view(np.dtype((np.void, 4 * window))).ravel(), return_inverse=True)[1]
        del order, same
        kmer = np.repeat(np.arange(len(n_win)), n_win)[chosen]
        offset = at[chosen] - (np.cumsum(n_words) - n_words)[kmer]
        d, s = first_doc[kmer], first_start[kmer] + offset
        by = np.lexsort((s, d, group))
        lead = np.concatenate([[True], np.diff(group[by]) != 0])
        least = by[np.flatnonzero(lead)][np.cumsum(lead) - 1]
        dup = by[(d[by] != d[least]) | (s[by] != s[least])]
        # Neighbouring windows of a super-k-mer as one run.
        dup = dup[np.lexsort((offset[dup], kmer[dup]))]
        if len(dup):
            k, o = kmer[dup], offset[dup]
            lead = np.flatnonzero(np.concatenate([[True], (np.diff(k) != 0) | (np.diff(o) != 1)]))
            out.append((d[dup][lead], s[dup][lead], np.diff(np.append(lead, len(dup)))))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def tagged(docs: DataFrame, id_col: str, text_col: str, tag: str) -> DataFrame:
    """The rows with column `tag`: of the text where its doc_id has another text too, else 0.

    Ids and hashes of texts are aggregated first; only if some id has several texts do the rows meet those ids.
    """
    doc, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    each = docs.select(doc.alias("d"), F.xxhash64(text).alias("h")).where("d is not null").groupBy("d").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    several = landed(each.where("lo <> hi").select(F.col("d").alias(f"{tag}_id")), "several-texts")
    if several.isEmpty():
        return docs.withColumn(tag, F.lit(0).cast("long"))
    met = docs.join(several.hint("merge"), doc == F.col(f"{tag}_id"), "left")
    return met.withColumn(tag, F.when(F.col(f"{tag}_id").isNotNull(), F.xxhash64(text).bitwiseAND((1 << 31) - 1)).otherwise(0)).drop(f"{tag}_id")


def repeated_ranges(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, tag_col: str | None = None) -> DataFrame:
    """(doc_id, tag, lo, hi): word ranges covered by repeated windows."""
    n_rows, n_bytes = size_of(docs, text_col)
    n_parts = parts_for(docs, n_bytes, BUCKET_BYTES * BUCKETS_EACH)
    n_buckets = max(n_parts * BUCKETS_EACH, -(-n_bytes // BUCKET_BYTES))
    sent = packed(docs, id_col, text_col, n_buckets, window, common_grams(docs, n_rows, text_col), tag_col)
    dealt = sent.repartitionById(n_parts, (F.col("bucket").cast("long") * n_parts / n_buckets).cast("int")).sortWithinPartitions("bucket", "later")

    def run(batches):
        import pyarrow as pa

        held, now = [], None

        def rows(doc, start, n):
            at = start & ((1 << 32) - 1)
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start >> 32), pa.array(at.astype(np.int32)), pa.array((at + n + window - 1).astype(np.int32))], names=["doc_id", "tag", "lo", "hi"])

        for b in batches:
            for bucket, later, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if later:
                    yield rows(*unpack_runs(blob.as_py()))
                    continue
                if bucket != now and held:
                    yield rows(*repeats(held, window))
                    held.clear()
                now = bucket
                held.append(blob.as_py())
        if held:
            yield rows(*repeats(held, window))

    return dealt.mapInArrow(run, "doc_id long, tag long, lo int, hi int")


FIELDS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_removed", T.LongType()),
    T.StructField("kept_sha256", T.StringType()),
    T.StructField("kept_text", T.StringType()),
])


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, out: str = "dedup", keep: list[str] | None = None, with_text: bool = True) -> DataFrame:
    """Append struct `out`: n_words, n_removed, kept_sha256 and (with_text) the kept words joined by spaces."""
    kept = [c for c in (docs.columns if keep is None else keep) if c != out]
    tag = unused("range_tag", docs)
    docs = tagged(docs, id_col, text_col, tag)
    found = repeated_ranges(docs, id_col=id_col, text_col=text_col, window=window, tag_col=tag)
    doc, own, ranges = unused("range_doc", docs), unused("range_own", docs), unused("ranges", docs)
    found = found.groupBy(F.col("doc_id").alias(doc), F.col("tag").alias(own)).agg(F.collect_list(F.struct("lo", "hi")).alias(ranges))
    carried = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*kept, id_col, text_col, tag])])
    both = carried.join(found.hint("merge"), (F.col(f"`{id_col}`").cast("long") == F.col(doc)) & (F.col(f"`{tag}`") == F.col(own)), "left")

    def make():
        def work(texts, ranges):
            rows = []
            for text, found in zip(texts, ranges, strict=True):
                w = words(text)
                left = w
                if found:
                    edge = np.zeros(len(w) + 1, np.int32)
                    np.add.at(edge, [r["lo"] for r in found], 1)
                    np.add.at(edge, [r["hi"] for r in found], -1)
                    left = [w[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                line = b" ".join(left)
                rows.append((len(w), len(w) - len(left), hashlib.sha256(line).hexdigest(), line.decode("utf-8", "replace") if with_text else None))
            return rows

        return work

    return annotate(both, [text_col, ranges], out, FIELDS, make, keep=kept)
