"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL-Proximal.

Tokens are runs of letters, of digits, or of other signs. Features are hashed into D buckets: the
lower-cased word, its shape (case and length class, or the sign run itself), pairs of neighbouring
shapes, pairs of neighbouring words and whether a word repeats the one before. A document's value
of a feature is its share of the document's features, so the score does not depend on length.

The training sample is dealt to a fixed number of shards; each runs the FTRL updates over its rows
in a fixed order for some epochs, and the shards' weights are averaged (parameter mixing). Scoring
is a sparse dot product in one pass over all rows.

Null and empty texts have no features: their score is that of the bias. Null and conflicting labels
are not used, repeated ones count once. With no labelled rows every score is 0.5. Rows are scored one
by one, null and repeated doc_ids too; an empty table gives no rows; extra columns are carried along,
whatever their names, but for one with the name of the result, which is replaced.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windloom.llm.common import annotate, raw

BITS = 18
D = 1 << BITS
SHARDS, EPOCHS = 8, 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
SCALE = 16.0

TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\sA-Za-z0-9\x80-\xff]+")
_P = np.uint64(0x9E3779B97F4A7C15)
_AGAIN = np.uint64(0xB7E151628AED2A6B)


def shape(token: bytes) -> bytes:
    """Case and length class of a word, sign runs as they are."""
    if token[:1].isdigit():
        return b"9"
    if not (token[0] >= 128 or token[:1].isalpha()):
        return token[:4]
    text = token.decode("utf-8", "replace")
    case = b"U" if text.isupper() and len(text) > 1 else b"T" if text[0].isupper() else b"l"
    return case + (b"1" if len(text) < 3 else b"2" if len(text) < 13 else b"3")


class Tokens(dict):
    """token -> (word hash, shape hash), bounded by clear()."""

    def __missing__(self, token: bytes) -> tuple[int, int]:
        import xxhash

        low = token.decode("utf-8", "replace").lower().encode()
        self[token] = found = (xxhash.xxh3_64_intdigest(low, 1), xxhash.xxh3_64_intdigest(shape(token), 2))
        return found


def features(text: bytes | None, cache: Tokens) -> np.ndarray:
    """Bucket numbers of a text's features, with repeats."""
    tokens = TOKEN.findall(text) if text else []
    if not tokens:
        return np.empty(0, np.int64)
    if len(cache) > 300_000:
        cache.clear()
    both = np.array([cache[t] for t in tokens], np.uint64)
    word, form = both[:, 0], both[:, 1]
    pair = lambda x, salt: (x[:-1] * _P + x[1:] + np.uint64(salt)) * _P
    again = np.full(int((word[1:] == word[:-1]).sum()), _AGAIN)
    every = np.concatenate([word * _P, form * _P, pair(form, 3), pair(word, 4), again])
    return (every >> np.uint64(64 - BITS)).astype(np.int64)


def ftrl(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights after FTRL-Proximal updates over rows of (feature buckets, label); the last is the bias."""
    z, n = np.zeros(D + 1), np.zeros(D + 1)
    prepared = []
    for f, y in rows:
        i, c = np.unique(f, return_counts=True)
        prepared.append((np.append(i, D), np.append(c * (SCALE / max(1, len(f))), 1.0), y))
    for _ in range(epochs):
        for i, x, y in prepared:
            zi, ni = z[i], n[i]
            w = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            z[i] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[i] = ni + g * g
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def train(sample: DataFrame, epochs: int = EPOCHS) -> np.ndarray:
    """Weights from (doc, text, label): SHARDS models of D weights each come back and are averaged."""

    def run(batches):
        import pyarrow as pa

        cache, rows = Tokens(), []
        for b in batches:
            for doc, text, y in zip(b.column(0).to_pylist(), raw(b.column(1)), b.column(2).to_pylist(), strict=True):
                rows.append((doc, features(text, cache).astype(np.int32), int(y > 0)))
        if rows:
            rows.sort(key=lambda r: hash((r[0], 7)))
            w = ftrl([(f, y) for _, f, y in rows], epochs)
            yield pa.RecordBatch.from_arrays([pa.array([len(rows)]), pa.array([w.astype(np.float32).tobytes()], pa.binary())], names=["n", "w"])

    shard = F.pmod(F.xxhash64("doc", F.lit("shard")), F.lit(SHARDS)).cast("int")
    models = sample.select("doc", "text", "label").repartitionById(SHARDS, shard).mapInArrow(run, "n long, w binary").collect()
    if not models:
        return np.zeros(D + 1, np.float32)
    return np.average([np.frombuffer(m["w"], np.float32) for m in models], axis=0, weights=[m["n"] for m in models]).astype(np.float32)


FIELDS = T.StructType([T.StructField("score", T.DoubleType())])


def score(docs: DataFrame, weights: np.ndarray, *, text_col: str = "text", out: str = "quality", keep: list[str] | None = None) -> DataFrame:
    """Append struct `out` with the score (0 to 1) of each text; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def make():
        w, cache = shared.value, Tokens()

        def work(texts):
            rows = []
            for t in texts:
                f = features(t, cache)
                dot = float(w[f].sum(dtype=np.float64)) * SCALE / max(1, len(f)) + float(w[D])
                rows.append((float(1 / (1 + np.exp(-np.clip(dot, -35, 35)))),))
            return rows

        return work

    return annotate(docs, [text_col], out, FIELDS, make, keep=keep)
