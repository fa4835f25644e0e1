"""The queries of this package by name; SQL where SQL can express the whole of one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from traceloom.llm import ann, bpe, chat, exact_dedup, fingerprints, langid, mixing, ngram_join, prefix_trie, repeats, secrets, toxicity, whitening
from traceloom.llm.common import held_out, read


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1, whose texts hold the template's own marks."""
    marks = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame(
        [(-1, 0, "user", marks), (-1, 1, "assistant", marks)], "conv_id bigint, turn bigint, role string, text string"
    )
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.format_records(chat.conversations_as_records(rows), "record"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return bpe.encode(read(spark, sf_dir, "documents"), vocabulary, decoded=True).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(read(spark, sf_dir, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.train(docs.where(~held_out(F.col("doc_id"))))
    return langid.predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(read(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~held_out(F.col("doc_id"))))
    return toxicity.score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    )


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"))


def op10_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(read(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.placed_turns(read(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(*prefix_trie.with_family_heads(turns)).drop("a", "b")


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(read(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_nearest_neighbours": op1_nearest_neighbours,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_bpe": op3_bpe,
    "op4_secret_scan": op4_secret_scan,
    "op5_language_id": op5_language_id,
    "op6_ngram_join": op6_ngram_join,
    "op7_mix_sources": op7_mix_sources,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_repeated_substrings": op10_repeated_substrings,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_fingerprints": op12_fingerprints,
    "op13_whitening": op13_whitening,
}

ORACLES = {
    "op2_chat_formatting": r"""
        WITH given AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
            UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
        )
        SELECT conv_id, count(*)::BIGINT AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(length('<|im_start|>') + length(role) + 1
                + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
        FROM given GROUP BY conv_id
    """,
    "op8_exact_dedup": r"""
        WITH given AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
        )
        SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
            doc_id = min(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
        FROM given WINDOW same AS (PARTITION BY norm)
    """,
    "op11_prefix_trie": r"""
        WITH given AS (
            SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
            FROM conversations WHERE conv_id IS NOT NULL
        ), convs AS (
            SELECT DISTINCT c, c - c % 5 AS f,
                xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                    lambda s, x: list_reduce(list_prepend(xor(s, x), range(8)), lambda t, i: xor(t >> 1, 3988292384 * (t & 1)))), 4294967295) % 9 AS h
            FROM given
        ), turns AS (
            SELECT convs.c, row_number() OVER (PARTITION BY convs.c ORDER BY given.c <> f, p) AS d, role, text
            FROM convs JOIN given ON (given.c = f AND p <= h) OR (given.c = convs.c AND p > h)
        ), chained AS (
            SELECT c, d, strlen(text) AS bytes,
                sha256(string_agg(sha256(strlen(role)::VARCHAR || ':' || role || text), '' ORDER BY d) OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING)) AS k
            FROM turns
        ), path AS (
            SELECT c, d, bytes, k, lag(k, 1, '') OVER (PARTITION BY c ORDER BY d) AS up, lead(k) OVER (PARTITION BY c ORDER BY d) IS NULL AS ends FROM chained
            UNION ALL SELECT c, 0, 0, '', NULL, NOT EXISTS (SELECT 1 FROM turns WHERE turns.c = convs.c) FROM convs
        ), nodes AS (
            SELECT k, d, min(c) AS c, count(*) AS n, min(bytes) AS bytes, min(up) AS up,
                sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
            FROM path GROUP BY k, d
        ), sized AS (
            SELECT nodes.*, (SELECT count(*) FROM nodes v WHERE v.up = nodes.k) AS children FROM nodes
        ), below AS (
            SELECT above.k, sum((v.n - 1) * v.bytes) AS saved, count(*) FILTER (v.children = 0) AS leaves
            FROM sized v JOIN path above ON above.c = v.c AND above.d <= v.d GROUP BY above.k
        )
        SELECT u.c AS conv_id, u.d AS depth, parent.c AS parent_conv_id, u.n AS n_convs, u.children AS n_children,
            leaves AS n_leaves, saved::BIGINT AS saved_tokens, u.ends_sha256
        FROM sized u JOIN below ON below.k = u.k LEFT JOIN nodes parent ON parent.k = u.up
    """,
}
