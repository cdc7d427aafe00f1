"""Line dedup by distinct-site spread: lines that many sites share are boilerplate.

Each line (trimmed of ASCII white space, of min_chars code points or more; EVERY_LINE takes all but
blank ones) is known by 128 bits of hash. Lines of fewer
documents than sites are needed, or of one site alone, go at the first count. The rest get
HyperLogLog sketches of the sites that show them, merged by aggregation, partially before the
shuffle, so a line on a third of all rows costs one sketch a task. A line whose estimate is far
above or below the threshold is decided by it; lines near it get exact distinct counts. A boilerplate
line stays in the document with the smallest doc_id that has it and goes from all others.

Everything is DataFrame functions. A null or empty text has no lines and stays as it is. Null sites
are not counted. Rows with a null doc_id lose boilerplate but never count as the first. Rows that share
a doc_id, or have none, are told apart by their texts; in all rows of the first document the line
stays, as often as it is there. A text from which nothing goes is returned unchanged. Empty
tables give no rows; other columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windloom.llm.common import unused
from windloom.session import landed

MIN_SITES, MIN_CHARS, EVERY_LINE = 5, 30, 1
#: log2 of the sketch's registers; estimates within these factors of the threshold are counted exactly.
LG_K, NEAR_BELOW, NEAR_ABOVE = 10, 0.6, 1.8

#: ASCII white space, as the trim functions take it.
BLANKS = " \t\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def line_key(line: Column) -> Column:
    """128 bits of a trimmed line."""
    return F.struct(F.xxhash64(line).alias("h"), F.xxhash64(F.lit("line"), line).alias("g"))


def document_key(doc: Column, text: Column) -> Column:
    """doc_id and a hash of the text, so that rows that share an id, or have none, are told apart."""
    return F.struct(doc.alias("doc"), F.xxhash64(text).alias("text"))


def boilerplate_places(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, pos, h, g, first_doc): each document with the place of each of its lines that min_sites or more distinct sites show, and the first document with it."""
    doc, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    shown = docs.select(document_key(doc, text).alias("doc"), F.col(f"`{site_col}`").cast("string").alias("site"), F.posexplode(F.transform(lines_of(text), trimmed)).alias("pos", "line")).where(F.char_length("line") >= min_chars)
    shown = shown.select("doc", "site", "pos", line_key(F.col("line")).alias("k")).select("doc", "site", "pos", "k.h", "k.g")
    # Only what more than one site and enough places show can be spread.
    often = shown.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.min("doc.doc").alias("first_doc"), F.min("site").alias("lo"), F.max("site").alias("hi"))
    often = often.where((F.col("n") >= min_sites) & ((F.col("lo") < F.col("hi")) | F.lit(min_sites < 2))).select("h", "g", "first_doc")
    places = landed(shown.join(often.hint("merge"), ["h", "g"]), "line-places")
    # One row of each site for a task, then a sketch for each line.
    sketches = places.groupBy("h", "g").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites")).where(F.col("sites") >= NEAR_BELOW * min_sites)
    sketches = landed(sketches, "line-spread")
    near = sketches.where(F.col("sites") < NEAR_ABOVE * min_sites).select("h", "g")
    exact = places.where("site is not null").join(near.hint("merge"), ["h", "g"], "left_semi").select("h", "g", "site").distinct().groupBy("h", "g").agg(F.count(F.lit(1)).alias("exact"))
    spread = sketches.where(F.col("sites") >= NEAR_ABOVE * min_sites).select("h", "g").unionByName(exact.where(F.col("exact") >= min_sites).select("h", "g"))
    return places.join(spread.hint("merge"), ["h", "g"], "left_semi").select("doc", "pos", "h", "g", "first_doc")


def remove_boilerplate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, out_text: str | None = None, n_removed: str | None = None) -> DataFrame:
    """The documents without the boilerplate lines of later documents.

    The text is replaced, or goes to `out_text`; `n_removed` names a column for the lines that went.
    The lines to remove come back to their documents as places, not as text; what stays is the runs
    between them, so the work in a document grows with its lines.
    """
    found = boilerplate_places(docs, id_col=id_col, text_col=text_col, site_col=site_col, min_sites=min_sites, min_chars=min_chars)
    key, gone = unused("line_doc", docs), unused("line_gone", docs)
    later = found.where(~F.col("doc.doc").eqNullSafe(F.col("first_doc"))).groupBy(F.col("doc").alias(key)).agg(F.array_sort(F.collect_set("pos")).alias(gone))
    text = F.col(f"`{text_col}`")
    mine = document_key(F.col(f"`{id_col}`"), text)
    both = docs.join(later.hint("merge"), F.col(f"{key}.doc").eqNullSafe(mine["doc"]) & F.col(f"{key}.text").eqNullSafe(mine["text"]), "left")
    # Removed places with one before the first line and one behind the last. The array binds lines and
    # places once for all runs; a text without any removed place is not split.
    once = F.array(F.struct(lines_of(text).alias("lines"), F.concat(F.array(F.lit(-1)), F.col(gone), F.array(F.size(lines_of(text)))).alias("at")))
    run = lambda x, i: F.slice(x["lines"], F.element_at(x["at"], i) + 2, F.element_at(x["at"], i + 1) - F.element_at(x["at"], i) - 1)
    joined = F.transform(once, lambda x: F.array_join(F.flatten(F.transform(F.sequence(F.lit(1), F.size(x["at"]) - 1), lambda i: run(x, i))), "\n"))
    left = F.when(F.col(gone).isNull() | text.isNull(), text).otherwise(joined[0])
    target = out_text or text_col
    columns = [left.alias(target) if c == target else F.col(f"`{c}`") for c in docs.columns]
    if target not in docs.columns:
        columns.append(left.alias(target))
    if n_removed:
        columns = [c for c, name in zip(columns, [*docs.columns, target], strict=False) if name != n_removed]
        columns.append(F.when(F.col(gone).isNull() | text.isNull(), F.lit(0)).otherwise(F.size(gone)).cast("long").alias(n_removed))
    return both.select(*columns)
