"""The registered queries of this folder: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import table

#: Tokens beyond which a document is over the context limit.
CONTEXT = 2048


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.fingerprints import differing, edited, leaf_set, likeness, root, tree, with_next

    docs = with_next(table(spark, sf_dir, "documents")).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    docs = docs.withColumns({f"{c}_tree": tree(F.col(c)) for c in ("text", "edited", "next_text")})
    docs = docs.withColumns({f"{c}_leaves": leaf_set(F.col(f"{c}_tree")) for c in ("text", "edited", "next_text")})
    return docs.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        root(F.col("text_tree")).alias("fingerprint"), root(F.col("edited_tree")).alias("edited_fingerprint"),
        likeness(F.col("text_leaves"), F.col("edited_leaves")).alias("near_edited"), likeness(F.col("text_leaves"), F.col("next_text_leaves")).alias("near_next"),
        F.size(differing(F.col("text_tree"), F.col("edited_tree"))).cast("long").alias("n_differing"),
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lodestone.llm.token_counts import count_tokens

    out = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > CONTEXT)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.chat_format import format_rows, read_back

    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more)
    out = read_back(format_rows(rows))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lodestone.llm.byte_bpe import decode, encode

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = decode(encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.common import scratch_path
    from lodestone.llm.warc import read, write

    path = scratch_path(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    own = F.col("type") == "response"  # the one read of the archives yields payloads of responses only
    return read(spark, path).select(
        number("record_id").alias("page_id"), F.when(own, F.octet_length("payload").cast("long")).otherwise(F.col("full_length")).alias("payload_bytes"),
        F.when(own, F.sha1("payload")).otherwise(F.col("digest")).alias("payload_digest"), F.col("type").alias("record_type"), number("refers_to").alias("refers_to"),
    )


def held_out(doc_id: str = "doc_id"):
    """Rows that no model may learn from; a null id is never one of them."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.language_id import fit, identify

    docs = table(spark, sf_dir, "documents")
    out = identify(docs, fit(docs.where(~held_out())))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.decontamination import contamination

    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.substring_dedup import factorize

    out = factorize(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.near_dedup import near_duplicates

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "class_id", F.col("n_items").cast("long").alias("n_items"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.toxicity import fit, labelled, score

    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(labelled(docs.where(~held_out()), table(spark, sf_dir, "labels").where(~held_out()))))
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


_SECTIONS = "list_transform(string_split({0}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: string_split(p, '. ')))"
_ROOT = "sha256(array_to_string(list_transform(" + _SECTIONS + ", lambda s: sha256(array_to_string(list_transform(s, lambda p: sha256(array_to_string(list_transform(p, lambda x: sha256(x)), ','))), ','))), ','))"
_LEAVES = "list_distinct(list_transform(flatten(flatten(" + _SECTIONS + ")), lambda x: substr(sha256(x), 1, 16) || length(x)))"
_SIZE = "coalesce(list_sum(list_transform({0}, lambda x: substr(x, 17)::BIGINT)), 0)"
_NEAR = f"CASE WHEN {_SIZE.format('{0}')} + {_SIZE.format('{1}')} = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * {_SIZE.format('list_intersect({0}, {1})')} / ({_SIZE.format('{0}')} + {_SIZE.format('{1}')}) END"

_DIFFER = "coalesce(list_sum(list_transform(s, lambda x, i: len(list_filter(x, lambda p, k: p IS DISTINCT FROM t[i][k])))), 0)::BIGINT"
#: Words of decontamination: A-Z in lower case, then runs of digits, letters and what is beyond ASCII.
_WORDS = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES = {
    "op3_chat_format": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) AS t(k)
        )
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(length('### : </turn>') + 1 + length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')))::BIGINT AS formatted_chars
        FROM c GROUP BY conv_id""",
    "op7_decontamination": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format('text')} AS w FROM documents),
        i AS (SELECT row_number() OVER () AS q, item_id, {_WORDS.format('text')} AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, q, least(len(w), 13) AS n, array_to_string(w[k:k + least(len(w), 13) - 1], ' ') AS p FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
        occ AS (
            SELECT s.r, s.k, s.n, win.item_id FROM (SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS p FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM win))) s
            JOIN win ON s.p = win.p AND s.n = win.n
        ),
        hit AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(k, k + n)) AS at FROM occ) GROUP BY r),
        own AS (SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT r, item_id FROM occ WHERE item_id IS NOT NULL) GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN hit USING (r) LEFT JOIN own USING (r)""",
    "op8_substring_dedup": r"""
        WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST) AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        win AS (SELECT r, k, array_to_string(w[k:k + 19], ' ') AS p FROM (SELECT r, w, unnest(range(1, len(w) - 18)) AS k FROM d)),
        later AS (SELECT r, k FROM win QUALIFY row_number() OVER (PARTITION BY p ORDER BY r, k) > 1),
        gone AS (SELECT DISTINCT r, unnest(range(k, k + 20)) AS place FROM later),
        each AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place FROM d),
        kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS text FROM each ANTI JOIN gone USING (r, place) GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)""",
    "op1_fingerprints": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        n AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id DESC NULLS LAST, text), first_value(text) OVER (ORDER BY doc_id DESC NULLS LAST, text)) AS next_text FROM d),
        e AS (SELECT *, left(text, length(text) - length(text) // 2) || left(next_text, length(text) // 2) AS edited FROM n),
        l AS (SELECT *, {_LEAVES.format('text')} AS a, {_LEAVES.format('edited')} AS b, {_LEAVES.format('next_text')} AS c, {_SECTIONS.format('text')} AS s, {_SECTIONS.format('edited')} AS t FROM e)
        SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, {_ROOT.format('text')} AS fingerprint, {_ROOT.format('edited')} AS edited_fingerprint,
            {_NEAR.format('a', 'b')} AS near_edited, {_NEAR.format('a', 'c')} AS near_next, {_DIFFER} AS n_differing FROM l""",
    "op5_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
        g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS kept FROM p)
        SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN n >= 1000 AND page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN n >= 1000 AND page_id <> kept THEN kept END AS refers_to FROM g""",
}
