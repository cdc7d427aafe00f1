"""Token-ID output: texts become ids, ids become range-coded shard files, shards decode in parallel.

Documents are dealt to shards by ranges of doc_id, so the concatenation of all shards is the corpus
in ascending doc_id order. One frequency table, counted over all ids, is shared by all shards.

Shard file: magic, table checksum, documents, ids, then the document index (doc_ids, lengths;
deflated) and a directory of blocks, then the blocks (see rans). Shards are rows of a Parquet table,
one file's bytes each, so any file system that Spark writes to will do.

A null text is an empty one; a null doc_id sorts first; repeated doc_ids are separate documents,
ordered by their ids; empty tables give no shards and no rows; extra columns are not stored.
"""

from __future__ import annotations

import json
import struct
import unicodedata
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windloom.llm.common import parts_for, pieces, range_cuts, raw, size_of
from windloom.llm.rans import Coder, table
from windloom.session import landed

#: Bytes of text for one shard.
SHARD_BYTES = 16 << 20
BLOCK_IDS = 1 << 19
#: Words in a worker's cache, and words joined to one text for the library.
CACHE_WORDS, LINE_WORDS = 600_000, 128
#: Runs whose ids are gathered at once.
GATHER_RUNS = 2_000_000
#: Texts encoded together at most; the more, the fewer runs are looked up again.
PIECE_TEXTS = 20_000
MAGIC = b"WLTS0001"
HEAD = struct.Struct("<8sIQQII")
NULL_ID = -(1 << 63)


#: ASCII signs that may follow a word without joining its token.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

#: A normaliser and a pre-tokenizer, as a tokenizer file states them, that drop white
#: space, put letters into lower case one by one and cut behind each run of letters. What stands
#: between white space is then encoded by itself, and so are letters and the signs that follow them.
BY_RUN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}


def values(column) -> list:
    """An Arrow column as a list, made in one go and not value by value."""
    return column.to_numpy(zero_copy_only=False).tolist()


def letters(core: bytes) -> bytes | None:
    """A Latin, Greek or Cyrillic word in composed lower-case letters, else None; a capital sigma's lower case depends on its place."""
    word = core.decode("utf-8", "replace")
    if not word or max(word) >= "\u0530" or "\u03a3" in word:
        return None
    word = word.lower()
    return word.encode() if word.isalpha() and unicodedata.is_normalized("NFC", word) else None


class Encoder:
    """Columns of whole texts to ids, as the library encodes them.

    Where the tokenizer's file declares BY_RUN, a column is cut at white space and each distinct run
    is encoded once. A run of letters, with or without ASCII signs behind it, takes the ids of its
    lower-case word from a bounded cache; new words go to the library many at a time, to be told
    apart by its mark for the end of a word. They need no normalising and no cutting but at white
    space, so the library's model gets them directly. Other runs go to the library as they are, and
    so do whole texts where the file declares anything else.
    """

    def __init__(self, path: str, dtype: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tok, self.dtype, self.width = Tokenizer.from_file(path), dtype, np.dtype(dtype).itemsize
        self.words: dict[bytes, bytes] = {}
        declared = json.loads(self.tok.to_str())
        suffix = declared["model"].get("end_of_word_suffix")
        self.by_run = bool(suffix) and all(declared[k] == v for k, v in BY_RUN.items())
        if self.by_run:
            self.ends = np.array([(self.tok.id_to_token(i) or "").endswith(suffix) for i in range(self.tok.get_vocab_size())])
            self.model = Tokenizer.from_file(path)
            self.model.normalizer, self.model.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def encoded(self, texts: list[bytes]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tok.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]

    def learn(self, new: list[bytes]) -> None:
        """Put lower-case words of letters into the cache."""
        lines = [new[i : i + LINE_WORDS] for i in range(0, len(new), LINE_WORDS)]
        for line, e in zip(lines, self.model.encode_batch_fast([b" ".join(x).decode() for x in lines], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.dtype)
            cut = ((np.flatnonzero(self.ends[ids]) + 1) * self.width).tolist()
            data = ids.tobytes()
            if len(cut) != len(line) or cut[-1] != len(data):
                raise ValueError("a word has more or less than one end")
            self.words.update(zip(line, [data[a:b] for a, b in zip([0, *cut], cut, strict=False)], strict=True))

    def runs(self, distinct) -> list[bytes]:
        """The packed ids of distinct runs."""
        import pyarrow as pa
        import pyarrow.compute as pc

        core = pc.ascii_rtrim(distinct, characters=SIGNS)
        texts = values(distinct.cast(pa.binary()))
        cut = values(pc.binary_length(core))
        names = values(pc.if_else(pc.ascii_is_alpha(core), pc.ascii_lower(core), None).cast(pa.binary()))
        names = [name or letters(t[:n]) for name, t, n in zip(names, texts, cut, strict=True)]
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        words = self.words
        self.learn(list({w for w in names if w is not None and w not in words}))
        rest = list({t if w is None else t[n:] for t, w, n in zip(texts, names, cut, strict=True)})
        other = dict(zip(rest, self.encoded(rest), strict=True))
        return [other[t] if w is None else words[w] + other[t[n:]] for t, w, n in zip(texts, names, cut, strict=True)]

    def __call__(self, column) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts in a row, and the number of each text's; null is empty."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not self.by_run:
            found = self.encoded([t or b"" for t in raw(column)])
            return np.frombuffer(b"".join(found), self.dtype), np.fromiter(map(len, found), np.int64, len(found)) // self.width
        split = pc.ascii_split_whitespace(pc.fill_null(column, ""))
        count = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        runs = split.flatten().dictionary_encode()
        packed = self.runs(runs.dictionary.cast(pa.large_string() if pa.types.is_large_string(column.type) else pa.string()))
        size = np.fromiter(map(len, packed), np.int64, len(packed)) // self.width
        flat = np.frombuffer(b"".join(packed), self.dtype)
        first = np.cumsum(size) - size
        code = runs.indices.to_numpy()
        found, sizes = [], size[code]
        for a in range(0, len(code), GATHER_RUNS):
            n, at = sizes[a : a + GATHER_RUNS], first[code[a : a + GATHER_RUNS]]
            found.append(flat[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))])
        total = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.cumsum(count)
        return np.concatenate(found) if found else flat[:0], total[ends] - total[ends - count]


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, dtype: str) -> Encoder:
    """One encoder for each Python worker, so its cache outlives a task."""
    if (path, dtype) not in _ENCODERS:
        _ENCODERS[path, dtype] = Encoder(path, dtype)
    return _ENCODERS[path, dtype]


def vocabulary(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def tokenised(docs: DataFrame, id_col: str, text_col: str, path: str, end_id: int, cuts: np.ndarray, dtype: str) -> DataFrame:
    """(shard, blob): per task and shard, packed documents; the blob is a small deflated column store."""

    def run(batches):
        import zstandard

        encode, pack = encoder(path, dtype), zstandard.ZstdCompressor(level=3)
        held: dict[int, list] = {}
        size = 0

        def flush():
            import pyarrow as pa

            for part, rows in held.items():
                ids, lens = np.array([r[0] for r in rows], "<i8"), np.array([len(r[1]) for r in rows], "<u4")
                blob = struct.pack("<I", len(rows)) + pack.compress(ids.tobytes() + lens.tobytes() + np.concatenate([r[1] for r in rows]).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([blob], pa.binary())], names=["shard", "blob"])
            held.clear()

        for whole in batches:
            for b in pieces(whole, rows=PIECE_TEXTS):
                doc = np.array([NULL_ID if x is None else x for x in b.column(0).to_pylist()], np.int64)
                part = np.searchsorted(cuts, doc, side="left")
                flat, lens = encode(b.column(1))
                ends = np.cumsum(lens + 1)
                ids = np.empty(len(flat) + len(lens), dtype)
                is_end = np.zeros(len(ids), bool)
                is_end[ends - 1] = True
                ids[is_end], ids[~is_end] = end_id, flat
                for d, p, a, z in zip(doc.tolist(), part.tolist(), (ends - lens - 1).tolist(), ends.tolist(), strict=True):
                    held.setdefault(p, []).append((d, ids[a:z]))
                size += ids.nbytes
                if size > 64 << 20:
                    yield from flush()
                    size = 0
        yield from flush()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "shard int, blob binary")


def unpacked(blob: bytes, dtype: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    import zstandard

    n = struct.unpack_from("<I", blob)[0]
    body = zstandard.ZstdDecompressor().decompress(blob[4:])
    return np.frombuffer(body, "<i8", n), np.frombuffer(body, "<u4", n, 8 * n), np.frombuffer(body, dtype, -1, 12 * n)


def counted(tokens: DataFrame, n_vocab: int, dtype: str) -> np.ndarray:
    """How often each id occurs in all documents: counts by task, summed by id; as many rows as ids at most."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros(n_vocab, np.int64)
        for b in batches:
            for blob in b.column(0).to_pylist():
                total += np.bincount(unpacked(blob, dtype)[2], minlength=n_vocab)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["id", "n"])

    rows = tokens.select("blob").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(n_vocab, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return counts


def shard_file(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], coder: Coder, table_crc: int) -> tuple[bytes, int]:
    doc = np.concatenate([p[0] for p in parts])
    lens = np.concatenate([p[1] for p in parts]).astype(np.int64)
    ids = np.concatenate([p[2] for p in parts])
    begin = np.concatenate([[0], np.cumsum(lens)[:-1]])
    order = np.argsort(doc, kind="stable")
    same = np.flatnonzero(np.diff(doc[order]) == 0)
    if len(same):  # repeated doc_ids: by their ids, so that the order is fixed
        order = np.array(sorted(range(len(doc)), key=lambda i: (doc[i], ids[begin[i] : begin[i] + lens[i]].tobytes())))
    ids = np.concatenate([ids[begin[i] : begin[i] + lens[i]] for i in order])
    doc, lens = doc[order], lens[order]
    blocks = [coder.encode(ids[a : a + BLOCK_IDS]) for a in range(0, len(ids), BLOCK_IDS)]
    index = zlib.compress(doc.astype("<i8").tobytes() + lens.astype("<u4").tobytes(), 6)
    directory = np.array([len(b) for b in blocks], "<u4").tobytes()
    return b"".join([HEAD.pack(MAGIC, table_crc, len(doc), len(ids), len(index), len(blocks)), index, directory, *blocks]), len(ids)


class Shard:
    """A shard file: its document index, and its blocks to be decoded as they are asked for."""

    def __init__(self, data: bytes, coder: Coder, table_crc: int):
        magic, crc, n_docs, self.n_ids, n_index, n_blocks = HEAD.unpack_from(data)
        if magic != MAGIC or crc != table_crc:
            raise ValueError("not a shard of this store")
        at = HEAD.size
        index = zlib.decompress(data[at : at + n_index])
        at += n_index
        sizes = np.frombuffer(data, "<u4", n_blocks, at).astype(np.int64)
        self.data, self.coder = data, coder
        self.begin = at + 4 * n_blocks + np.cumsum(sizes) - sizes
        self.size = sizes
        self.doc, self.lens = np.frombuffer(index, "<i8", n_docs), np.frombuffer(index, "<u4", n_docs, 8 * n_docs).astype(np.int64)
        self.ends = np.cumsum(self.lens)
        if (int(self.ends[-1]) if n_docs else 0) != self.n_ids:
            raise ValueError("a shard is not whole")

    def ids(self, a: int = 0, b: int | None = None) -> np.ndarray:
        """The ids from a to b: only their blocks, and of these only what stands behind the checkpoint before a."""
        b = self.n_ids if b is None else b
        found = [np.empty(0, np.uint32)]
        for i in range(a // BLOCK_IDS, -(-b // BLOCK_IDS) if b > a else 0):
            block = self.data[self.begin[i] : self.begin[i] + self.size[i]]
            found.append(self.coder.decode(block, max(0, a - i * BLOCK_IDS), min(BLOCK_IDS, b - i * BLOCK_IDS)))
        return np.concatenate(found)


class Store:
    """What a written store consists of: the shard table, its frequency table, the ids before each shard and the doc_ids that part the shards."""

    def __init__(self, shards: DataFrame, freq: np.ndarray, before: dict[int, int], cuts: np.ndarray):
        self.shards, self.freq, self.before, self.cuts = shards, freq, before, cuts


def write(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> Store:
    n_vocab = vocabulary(tokenizer)
    dtype = "<u2" if n_vocab <= 65536 else "<u4"
    n_rows, n_bytes = size_of(docs, text_col)
    n = -(-n_bytes // SHARD_BYTES)
    cuts = range_cuts(docs, id_col, max(n, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), n_rows)
    tokens = landed(tokenised(docs, id_col, text_col, tokenizer, end_id, cuts, dtype), "token-ids", "none")
    freq = table(counted(tokens, n_vocab, dtype))
    shared, crc = docs.sparkSession.sparkContext.broadcast(freq), zlib.crc32(freq.tobytes())

    def run(batches):
        import pyarrow as pa

        coder, now, held = Coder(shared.value), None, []

        def close():
            data, n_ids = shard_file([unpacked(x, dtype) for x in held], coder, crc)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([n_ids], pa.int64()), pa.array([data], pa.binary())], names=["shard", "n_ids", "data"])

        for b in batches:
            for p, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if p != now and held:
                    yield close()
                    held = []
                now = p
                held.append(blob)
        if held:
            yield close()

    # A partition works through its shards one after another.
    n_parts = min(len(cuts) + 1, parts_for(docs, n_bytes, SHARD_BYTES))
    dealt = tokens.repartitionById(n_parts, (F.col("shard") * F.lit(n_parts) / F.lit(len(cuts) + 1)).cast("int")).sortWithinPartitions("shard")
    shards = landed(dealt.mapInArrow(run, "shard int, n_ids long, data binary"), "token-shards", "none")
    before, at = {}, 0
    for r in sorted(shards.select("shard", "n_ids").collect()):  # a row for each shard, so one for each 16 MB of text
        before[r["shard"]], at = at, at + r["n_ids"]
    return Store(shards, freq, before, cuts)


def read(store: Store) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the shard files alone."""
    shared, crc = store.shards.sparkSession.sparkContext.broadcast((store.freq, store.before)), zlib.crc32(store.freq.tobytes())

    def run(batches):
        import pyarrow as pa

        freq, before = shared.value
        coder = Coder(freq)
        for b in batches:
            for p, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                shard = Shard(data.as_py(), coder, crc)
                doc, lens, ends = shard.doc, shard.lens, shard.ends
                packed = memoryview(shard.ids().astype("<u4").tobytes())
                sums = [zlib.crc32(packed[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lens.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64(), mask=doc == NULL_ID), pa.array(ends - lens + before[p]), pa.array(lens), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return store.shards.select("shard", "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def documents(store: Store, wanted: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids) of the wanted documents: each shard decodes from the checkpoints before them, not as a whole.

    A wanted doc_id that the store lacks gives no row, one that it has several times gives as many;
    asking twice is asking once. A null doc_id asks for the documents without one.
    """
    spark = wanted.sparkSession
    shared, crc = spark.sparkContext.broadcast((store.freq, store.cuts)), zlib.crc32(store.freq.tobytes())

    def place(batches):
        import pyarrow as pa

        cuts = shared.value[1]
        for b in batches:
            doc = np.array([NULL_ID if x is None else x for x in b.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(cuts, doc, side="left").astype(np.int32)), pa.array(doc)], names=["shard", "doc"])

    asked = wanted.select(F.col(id_col).cast("long")).distinct().mapInArrow(place, "shard int, doc long").groupBy("shard").agg(F.collect_list("doc").alias("docs"))
    both = store.shards.select("shard", "data").join(asked.hint("merge"), "shard")

    def run(batches):
        import pyarrow as pa

        coder = Coder(shared.value[0])
        for b in batches:
            for data, docs in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                shard = Shard(data.as_py(), coder, crc)
                for i in np.flatnonzero(np.isin(shard.doc, np.array(docs, np.int64))).tolist():
                    ids = shard.ids(int(shard.ends[i] - shard.lens[i]), int(shard.ends[i]))
                    doc = None if shard.doc[i] == NULL_ID else int(shard.doc[i])
                    yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([ids.tolist()], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return both.select("shard", "data", "docs").mapInArrow(run, "doc_id long, ids array<long>")
