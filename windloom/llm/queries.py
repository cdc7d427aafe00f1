"""The registered queries of the text operators; each derives the contract's columns from an operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windloom.llm import chat, collocations, decontaminate, fingerprint, labelled, line_dedup, merkle, near_dedup, packing, quality, simhash, substring_dedup, token_store, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"], out="d", with_text=False)
    return found.select("doc_id", "d.n_words", "d.n_removed", "d.kept_sha256")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line that is not blank is judged by its sites, however short."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.remove_boilerplate(docs, min_chars=line_dedup.EVERY_LINE, n_removed="n_removed").select("doc_id", "n_removed", "text")


LINE_DEDUP_SQL = f"""
    WITH lines AS (
        SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {{documents}}
    ), cut AS (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS t FROM lines),
    spread AS (
        SELECT t, min(doc_id) AS first_doc FROM cut WHERE length(t) >= {line_dedup.EVERY_LINE} GROUP BY t HAVING count(DISTINCT source) >= {line_dedup.MIN_SITES}
    ), judged AS (
        SELECT doc_id, i, line, spread.t IS NOT NULL AND doc_id <> first_doc AS gone FROM cut LEFT JOIN spread USING (t)
    ), joined AS (
        SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text FROM judged GROUP BY doc_id
    )
    SELECT d.doc_id, coalesce(j.n_removed, 0)::BIGINT AS n_removed, CASE WHEN j.n_removed > 0 THEN j.text ELSE d.text END AS text
    FROM {{documents}} d LEFT JOIN joined j USING (doc_id)
"""


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    found = chat.format_paths(chat.linear(rows)).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.masked_text(F.col("formatted"), F.col("loss_spans")))
    return found.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


CHAT_SQL = r"""
    WITH rows AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
    ), sized AS (
        SELECT *, length(role) + length(text) + 21
            + 2 * length(role || text) - length(replace(role || text, '\', '')) - length(role || text)
            + (length(role) - length(replace(role, '<turn>', '12345'))) + (length(role) - length(replace(role, '</role>', '123456'))) + (length(role) - length(replace(role, '</turn>', '123456')))
            + (length(text) - length(replace(text, '<turn>', '12345'))) + (length(text) - length(replace(text, '</role>', '123456'))) + (length(text) - length(replace(text, '</turn>', '123456'))) AS chars
        FROM rows
    )
    SELECT conv_id, count(*)::BIGINT AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
        sum(chars)::BIGINT AS formatted_chars
    FROM sized GROUP BY conv_id
"""


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"))


TOXIC_AT, GOOD_AT = 0.3, 0.7


def _scored(found: DataFrame, at: float) -> DataFrame:
    return found.select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), F.col("s.score").alias("score"), (F.col("s.score") >= at).cast("int").alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.learn(labelled.training_rows(docs, table(spark, sf_dir, "labels"), "toxic"))
    return _scored(toxicity.matched(docs, lexicon, keep=["doc_id"], out="s"), TOXIC_AT)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = decontaminate.contamination(docs, items, keep=["doc_id"], out="c")
    return found.select(
        "doc_id",
        F.col("c.n_words").alias("n_words"),
        F.col("c.n_hit").alias("n_hit"),
        F.size("c.item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("c.item_ids", lambda x: x.cast("string"))), ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated(F.col("c")).alias("contaminated"),
    )


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_neighbours(table(spark, sf_dir, "documents"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_store.read(token_store.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = quality.train(labelled.training_rows(docs, table(spark, sf_dir, "labels"), "quality"))
    return _scored(quality.score(docs, weights, keep=["doc_id"], out="s"), GOOD_AT)


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations.best(collocations.collocations(table(spark, sf_dir, "documents")))
    return found.select(F.col("grp").alias("lang"), "rank", "phrase", "a", "l", "r", "n", "score")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    touched = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    found = merkle.manifest(docs, {"n_chars": F.col("n_chars") + 1}, touched)
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

COLLOCATIONS_SQL = rf"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
    ), worded AS (
        SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
    ), sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
    places AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM worded, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
    f AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f FROM places GROUP BY ALL HAVING count(*) >= 100),
    held AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
    cuts AS (SELECT lang, phrase, f AS a, unnest(range(1, k)) AS c, w, k FROM held),
    judged AS (
        SELECT c.lang, c.phrase, c.a, c.c, x.f AS l, y.f AS r, n, (1000::HUGEINT * c.a * n) // (x.f::HUGEINT * y.f) AS score
        FROM cuts c JOIN sizes USING (lang) JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : c.c], ' ')
        JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.c + 1 : c.k], ' ')
    ), lowest AS (SELECT * FROM judged QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
    inside AS (
        SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(f) AS longer
        FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM held)) GROUP BY ALL
    )
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a, l, r, n, score::BIGINT AS score
    FROM lowest LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a
    QUALIFY rank <= 2000
"""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{n_chars}", "text")) + ")"
_CRC = "list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::UBIGINT)), lambda c, b: {steps})"


def _crc_steps() -> str:
    """crc32 of one more byte b after the state c, bit by bit."""
    step = "xor(c, b)"
    for _ in range(8):
        step = f"list_transform([{step}], lambda v: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END)[1]"
    return step


MERKLE_SQL = f"""
    WITH RECURSIVE marked AS (SELECT *, xor({_CRC.format(steps=_crc_steps())}, 4294967295::UBIGINT) % 7 = 0 AS touched FROM documents),
    made AS (
        SELECT doc_id, coalesce('1' || lang, '0') AS g, {_LEAF.format(n_chars="n_chars")} AS leaf, CASE WHEN touched THEN {_LEAF.format(n_chars="(n_chars + 1)")} ELSE {_LEAF.format(n_chars="n_chars")} END AS other FROM marked
    ), leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, row_number() OVER () AS id FROM made),
    up AS (
        SELECT g, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM leaves
        UNION ALL SELECT g, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM up WHERE n > 1 GROUP BY g, level, pos // 2, n
    ), subroots AS (SELECT g, level AS height, h, row_number() OVER (ORDER BY g) - 1 AS pos FROM up WHERE n = 1),
    top AS (
        SELECT 0 AS level, pos, h, count(*) OVER () AS n FROM subroots
        UNION ALL SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY level, pos // 2, n
    ), levels AS (
        SELECT l.id, up.level AS step, up.pos - (l.pos >> up.level) AS side, up.pos, up.h FROM leaves l JOIN up ON up.g = l.g AND up.n > 1 AND up.pos // 2 = (l.pos >> up.level) // 2
        UNION ALL
        SELECT l.id, s.height + top.level, top.pos - (s.pos >> top.level), top.pos, top.h FROM leaves l JOIN subroots s USING (g) JOIN top ON top.n > 1 AND top.pos // 2 = (s.pos >> top.level) // 2
    ), steps AS (
        SELECT id, step, coalesce(string_agg(h, '' ORDER BY pos) FILTER (WHERE side < 0), '') AS before, coalesce(string_agg(h, '' ORDER BY pos) FILTER (WHERE side > 0), '') AS after FROM levels GROUP BY id, step
    ), folded AS (
        SELECT id, 0 AS step, other AS h FROM leaves
        UNION ALL SELECT f.id, f.step + 1, sha256(s.before || f.h || s.after) FROM folded f JOIN steps s ON s.id = f.id AND s.step = f.step
    )
    SELECT l.doc_id, l.leaf, s.h AS subroot, t.h AS root, sha256(coalesce((SELECT string_agg(before || after, '' ORDER BY step) FROM steps p WHERE p.id = l.id), '')) AS proof_sha256,
        f.h AS folded_root, f.h = t.h AS verified
    FROM leaves l JOIN subroots s USING (g) CROSS JOIN (SELECT h FROM top WHERE n = 1) t JOIN (SELECT id, arg_max(h, step) AS h FROM folded GROUP BY id) f ON f.id = l.id
"""

QUERIES = {
    "op2_line_dedup": op2_line_dedup,
    "op3_chat": op3_chat,
    "op5_packing": op5_packing,
    "op10_quality": op10_quality,
    "op4_toxicity": op4_toxicity,
    "op1_substring_dedup": op1_substring_dedup,
    "op7_near_dedup": op7_near_dedup,
    "op8_fingerprint": op8_fingerprint,
    "op9_token_store": op9_token_store,
    "op6_decontaminate": op6_decontaminate,
    "op11_simhash": op11_simhash,
    "op12_collocations": op12_collocations,
    "op13_merkle": op13_merkle,
}

ORACLES: dict[str, str] = {
    "op2_line_dedup": LINE_DEDUP_SQL.format(documents="documents"),
    "op3_chat": CHAT_SQL,
    "op12_collocations": COLLOCATIONS_SQL,
    "op13_merkle": MERKLE_SQL,
}
