"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, with exception phrases.

Folding: compatibility forms, lower case, look-alike letters of other scripts, and digits or signs
that stand for letters before a letter (idi0t, $cum). White space becomes single spaces. A term is a
whole word or the beginning of one ("stem*"); matches must start at a word's start. A match inside
an exception phrase does not count. The weights of the matches are summed, divided by a norm of the
text's length, and squashed to a score between 0 and 1.

The lexicon is learned from labelled rows (see labelled): words and beginnings of words that are
significantly more frequent in toxic documents, counted by distinct contexts so that copies of one
document do not make terms; weights are log odds. Phrases of a term with a neighbour that only clean
documents hold become exceptions. The scale of the score is fitted on the same rows.

Null and empty texts score 0. Null and conflicting labels are not used, repeated ones count once;
with no labelled rows the lexicon is empty and every score is 0. Rows are judged one by one, null and
repeated doc_ids too; an empty table gives no rows; extra columns are carried along, whatever their
names, but for one with the name of the result, which is replaced.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windloom.llm.common import annotate, pieces, raw

#: Look-alike letters (Cyrillic, Greek) and the Latin letters they pass for.
HOMOGLYPHS = {"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i"}
#: Digits and signs written for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

_GLYPHS = str.maketrans(HOMOGLYPHS)
_SUBSTITUTE = re.compile(r"[013457@$](?=[013457@$]*[^\W\d_])")
_WORD = re.compile(r"\w+")

SHORTEST, LONGEST = 3, 10
#: A term is taken when its log-likelihood gain exceeds log(number of terms) + MARGIN.
MARGIN = 4.0
#: Fewest clean documents for a learned exception phrase.
EXCEPTION_DOCS = 3


def fold(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if not text.isascii():
        text = text.translate(_GLYPHS)
    return " ".join(_SUBSTITUTE.sub(lambda m: SUBSTITUTES[m[0]], text).split())


@dataclass
class Lexicon:
    """Terms ("word" or "stem*") with weights, exception phrases, and the scale of the score."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    scale: float = 1.0
    power: float = 0.5


class Matcher:
    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.lexicon, self.ac = lexicon, ahocorasick.Automaton()
        for term, weight in lexicon.weights.items():
            text, stem = term.rstrip("*"), term.endswith("*")
            old = self.ac.get(text, None)
            self.ac.add_word(text, (len(text), stem or bool(old and old[1]), max(weight, old[2] if old else 0.0), False))
        for phrase in lexicon.exceptions:
            self.ac.add_word(phrase, (len(phrase), False, 0.0, True))
        if len(self.ac):
            self.ac.make_automaton()

    def sum_of(self, text: str) -> tuple[float, list[tuple[int, int]]]:
        """Sum of the weights of what counts in a folded text, and where; the longest match of a word counts."""
        if not len(self.ac) or not text:
            return 0.0, []
        hits, spared = {}, []
        for end, (size, stem, weight, exception) in self.ac.iter(text):
            start = end - size + 1
            if start and (text[start - 1].isalnum() or text[start - 1] == "_"):
                continue
            if not stem and end + 1 < len(text) and (text[end + 1].isalnum() or text[end + 1] == "_"):
                continue
            if exception:
                spared.append((start, end + 1))
            elif start not in hits or size > hits[start][0]:
                hits[start] = (size, weight)
        # Of the phrases that begin no later than a match, the one that reaches farthest decides.
        begins, reach = sorted(spared), []
        for _, end in begins:
            reach.append(max(end, reach[-1]) if reach else end)
        far = lambda s: reach[i - 1] if (i := bisect_right(begins, (s, len(text) + 1))) else 0
        kept = [(s, n, w) for s, (n, w) in hits.items() if s + n > far(s)]
        return sum(w for _, _, w in kept), [(s, s + n) for s, n, _ in kept]


def score_of(total: float, n_words: int, scale: float, power: float) -> float:
    """Sum of weights by a norm that grows with length, between 0 and 1."""
    x = total / (1.0 + n_words / 200.0) ** power
    return x / (x + scale) if x > 0 else 0.0


def terms_of(text: str) -> set[str]:
    """Words of a folded text and their beginnings ("stem*"); a beginning of two or more of its words also as "stem*2"."""
    found, twice = set(), set()
    for w in _WORD.findall(text):
        for k in range(SHORTEST, min(len(w), LONGEST + 1)):
            stem = w[:k] + "*"
            if stem in found:
                twice.add(stem + "2")
            else:
                found.add(stem)
        found.add(w)
    return found | twice


def _document_counts(sample: DataFrame) -> DataFrame:
    """(term, toxic, clean): documents of the sample with each term; counted by task before the shuffle."""

    def run(batches):
        import pyarrow as pa

        counts = (Counter(), Counter())
        for whole in batches:
            for b in pieces(whole):
                for text, y in zip(raw(b.column(0)), b.column(1).to_pylist(), strict=True):
                    counts[y > 0].update(terms_of(fold(text.decode("utf-8", "replace"))))
        terms = list(counts[1].keys() | counts[0].keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([counts[1][t] for t in terms], pa.int64()), pa.array([counts[0][t] for t in terms], pa.int64())], names=["term", "toxic", "clean"])

    return sample.select("text", "label").mapInArrow(run, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _contexts(sample: DataFrame, terms: list[str]) -> DataFrame:
    """(term, before, after, label) of each place of the given terms; terms and the sample are bounded."""
    shared = sample.sparkSession.sparkContext.broadcast(set(terms))

    def run(batches):
        import pyarrow as pa

        wanted = shared.value
        for whole in batches:
            for b in pieces(whole):
                rows = []
                for text, y in zip(raw(b.column(0)), b.column(1).to_pylist(), strict=True):
                    w = _WORD.findall(fold(text.decode("utf-8", "replace")))
                    for i, x in enumerate(w):
                        for t in (x, *(x[:k] + "*" for k in range(SHORTEST, min(len(x) - 1, LONGEST) + 1))):
                            if t in wanted:
                                rows.append((t, x, w[i - 1] if i else "", w[i + 1] if i + 1 < len(w) else "", int(y > 0)))
                yield pa.RecordBatch.from_arrays([*[pa.array([r[i] for r in rows], pa.string()) for i in range(4)], pa.array([r[4] for r in rows], pa.int64())], names=["term", "word", "before", "after", "label"])

    return sample.select("text", "label").mapInArrow(run, "term string, word string, before string, after string, label long")


def beginnings(term: str):
    """The shorter beginnings of a term, as terms; a whole word also begins with itself."""
    stem = term.rstrip("*")
    return (stem[:k] + "*" for k in range(SHORTEST, len(stem) + (0 if term.endswith("*") else 1)))


def learn(sample: DataFrame) -> Lexicon:
    """A lexicon from (doc, text, label). What comes to the driver is bounded by the sample: each term has a share of its toxic words."""
    row = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    n, pos = int(row[0]), int(row[1])
    if not 0 < pos < n:
        return Lexicon()
    base = pos / n
    share = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    gain = F.col("toxic") * F.log(share / base) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - share) / (1 - base))).otherwise(0.0)
    counts = _document_counts(sample).persist()
    n_terms = counts.count()
    bar = math.log(max(2, n_terms)) + MARGIN
    chosen = counts.where((F.col("toxic") > 0) & (share > base)).withColumn("gain", gain).where(F.col("gain") > bar).orderBy(F.desc("gain"), "term")
    rows = chosen.collect()
    found, gains, hits = {}, {}, {}
    for r in rows:  # by gain: of "stem*" and "stem*2" the one that gains more
        term = r["term"].removesuffix("2") if r["term"].endswith("*2") else r["term"]
        if term not in found:
            found[term], gains[term], hits[term] = (r["toxic"], r["clean"]), round(r["gain"], 6), 2 if term != r["term"] else 1
    counts.unpersist()
    # Copies of a document repeat its contexts: a term needs as many different ones.
    needed = bar / math.log(1 / base)
    places = _contexts(sample, list(found)).persist()
    varied = {r["term"]: r["n"] for r in places.where("label = 1").groupBy("term").agg(F.count_distinct("before", "after").alias("n")).collect()}
    found = {t: c for t, c in found.items() if varied.get(t, 0) >= needed}
    # Of terms that are beginnings of each other only the one that gains most stays, the longest of equal ones.
    keep: set[str] = set()
    covered: set[str] = set()
    for t in sorted(found, key=lambda t: (-gains[t], -len(t.rstrip("*")), t.endswith("*"), t)):
        above = list(beginnings(t))
        if t not in covered and not keep.intersection(above):
            keep.add(t)
            covered.update(above)
    odds = lambda a, b: math.log((a + 0.5) * (n - pos - b + 0.5) / ((pos - a + 0.5) * (b + 0.5)))
    weights = {t: round(odds(*found[t]) / hits[t], 6) for t in sorted(keep)}  # of a match; a term that counts from two on is worth half
    phrases = places.where(F.col("term").isin(list(keep)) if keep else F.lit(False)).select(F.explode(F.array(F.concat_ws(" ", "before", "word"), F.concat_ws(" ", "word", "after"))).alias("phrase"), "label")
    only_clean = phrases.groupBy("phrase").agg(F.sum("label").alias("toxic"), F.count(F.lit(1)).alias("n")).where(f"toxic = 0 and n >= {EXCEPTION_DOCS}")
    exceptions = sorted(r["phrase"].strip() for r in only_clean.collect())
    places.unpersist()
    lexicon = Lexicon(weights, [p for p in exceptions if " " in p])
    return Lexicon(lexicon.weights, lexicon.exceptions, *_fitted(sample, lexicon))


def _fitted(sample: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> tuple[float, float]:
    """Scale and power of the score that separate the classes best at the threshold, from a few tried."""
    binned = matched(sample, lexicon, out="m", keep=["label"]).groupBy("label", F.round("m.total", 1).alias("total"), F.round(F.log2(1 + F.col("m.n_words")), 1).alias("size")).count()
    rows = binned.where("total > 0").collect()  # no more rows than the sample
    best, at = None, (1.0, 0.5)
    for power in (0.0, 0.25, 0.5, 0.75, 1.0):
        for scale in np.geomspace(0.05, 40, 60).tolist():
            loss = 0.0
            for r in rows:
                p = _squash(score_of(r["total"], int(2 ** r["size"]), scale, power), threshold)
                loss -= r["count"] * math.log(max(1e-9, p if r["label"] > 0 else 1 - p))
            if best is None or loss < best - 1e-9:
                best, at = loss, (scale, power)
    return at


def _squash(score: float, threshold: float) -> float:
    """A probability whose half is at the threshold."""
    s, t = min(max(score, 1e-6), 1 - 1e-6), threshold
    return 1 / (1 + math.exp(-2 * (math.log(s / (1 - s)) - math.log(t / (1 - t)))))


FIELDS = T.StructType([
    T.StructField("score", T.DoubleType()),
    T.StructField("total", T.DoubleType()),
    T.StructField("n_words", T.LongType()),
    T.StructField("n_matches", T.LongType()),
])


def matched(docs: DataFrame, lexicon: Lexicon, *, text_col: str = "text", out: str = "toxicity", keep: list[str] | None = None) -> DataFrame:
    """Append struct `out` (score, total, n_words, n_matches) of each text; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def make():
        matcher = Matcher(shared.value)

        def work(texts):
            rows = []
            for t in texts:
                text = fold((t or b"").decode("utf-8", "replace"))
                total, at = matcher.sum_of(text)
                n_words = text.count(" ") + 1 if text else 0
                rows.append((score_of(total, n_words, matcher.lexicon.scale, matcher.lexicon.power), total, n_words, len(at)))
            return rows

        return work

    return annotate(docs, [text_col], out, FIELDS, make, keep=keep)
