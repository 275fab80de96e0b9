"""The registered queries of the training-data operators: thin calls over whole tables, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontam, htmltext, langid, mtree, packing, periodic, pfor, quality, resample, simhash, tokencount
from .common import id_crc32, table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = F.pmod(id_crc32("doc_id"), F.lit(4)) == 2
    found = langid.identify(docs, langid.fit(docs, ~out))
    return found.withColumn("held_out", out).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfor.token_files(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more)
    return chat.digests(chat.format_conversations(rows, tokenizer("byte_bpe_50k.json")))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = F.pmod(id_crc32("doc_id"), F.lit(5)) == 0
    found = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels"), ~out))
    return found.withColumn("held_out", out).select("doc_id", "held_out", "score", "predicted")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.collapse_runs(periodic.with_planted(table(spark, sf_dir, "documents"))))


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_language_id, op2_token_files, op3_nearest_neighbours, op4_best_fit_packing, op5_chat_format, op6_quality, op7_decontamination, op8_token_counts, op9_simhash_dedup, op10_html_text, op11_periodic_runs, op12_exact_top_k, op13_resampling)}

#: CTE `crc`, the table of crc32 by its rule, and the expression of the crc32 of a text with it.
_CRC = """steps AS (
            SELECT i, i AS c, 0 AS k FROM range(256) r(i)
            UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8
        ), crc AS (
            SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8
        )"""


#: The words of a text as op13 takes them.
_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"


def _crc32(text: str) -> str:
    octets = f"list_transform(range(0, octet_length(encode({text}))), lambda j: ('0x' || substr(hex(encode({text})), (2 * j + 1)::INT, 2))::BIGINT)"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


ORACLE_SQL: dict[str, str] = {
    "op5_chat_format": """
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), said AS (
            SELECT *, length('<|turn|><|says|><|end|>') + length(replace(replace(role, '\\', '\\\\'), '<|', '<\\|'))
                + length(replace(replace(text, '\\', '\\\\'), '<|', '<\\|')) AS n FROM rows
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(n)::BIGINT AS formatted_chars
        FROM said GROUP BY conv_id
    """,
    "op11_periodic_runs": rf"""
        WITH RECURSIVE {_CRC}, docs AS (
            SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
                {_crc32("coalesce(doc_id::VARCHAR, '')")} AS h FROM documents, crc
        ), shaped AS (
            SELECT r, doc_id, w, len(w) AS n, h % 10 = 0 AS planted, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS parts FROM docs
        ), planted AS (
            SELECT r, doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: w[(CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // parts) END) + 1]) ELSE w END AS w FROM shaped
        ), each AS (
            SELECT r, n, unnest(range(n)) AS i, unnest(w) AS w FROM planted
        ), same AS (
            SELECT x.r, y.i - x.i AS q, x.i FROM each x JOIN each y ON x.r = y.r AND x.w = y.w AND y.i > x.i AND y.i - x.i <= x.n // 4
        ), islands AS (
            SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM same
        ), stretches AS (
            SELECT r, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY r, q, island HAVING count(*) + q >= greatest(6, 4 * q)
        ), runs AS (
            SELECT r, start, length, min(q) AS period FROM stretches GROUP BY r, start, length
        ), told AS (
            SELECT r, count(*) AS n_runs, arg_min({{'s': start, 'l': length, 'p': period}}, {{'l': -length, 's': start, 'p': period}}) AS longest,
                string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY r
        ), dropped AS (
            SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs
        ), kept AS (
            SELECT r, string_agg(w, ' ' ORDER BY i) AS text FROM (SELECT * FROM each ANTI JOIN dropped USING (r, i)) GROUP BY r
        )
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, longest.s AS start, longest.l AS length, longest.p AS period, 1000 * longest.l // longest.p AS exponent_milli,
            sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
        FROM planted LEFT JOIN told USING (r) LEFT JOIN kept USING (r)
    """,
    "op12_exact_top_k": """
        WITH whole AS (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
        )
        SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank, vec_id, score
        FROM scored QUALIFY rank <= 5
    """,
    "op13_resampling": f"""
        WITH RECURSIVE {_CRC}, docs AS (
            SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents
        ), items AS (
            SELECT {_WORDS} AS w FROM benchmark
        ), own AS (
            SELECT r, array_to_string(w[i : i + k - 1], ' ') AS f, count(*) AS n FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM docs), range(1, 4) g(k) WHERE i + k - 1 <= len(w) GROUP BY ALL
        ), aims AS (
            SELECT array_to_string(w[i : i + k - 1], ' ') AS f, count(*) AS n FROM (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM items), range(1, 4) g(k) WHERE i + k - 1 <= len(w) GROUP BY ALL
        ), hashed AS (
            SELECT f, {_crc32('f')} % 10000 AS b
            FROM (SELECT f FROM own UNION SELECT f FROM aims), crc
        ), s AS (
            SELECT b, sum(n) AS n FROM own JOIN hashed USING (f) GROUP BY b
        ), t AS (
            SELECT b, sum(n) AS n FROM aims JOIN hashed USING (f) GROUP BY b
        ), gain AS (
            SELECT i AS b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE
                / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS g
            FROM range(10000) r(i) LEFT JOIN s ON s.b = i LEFT JOIN t ON t.b = i
        ), summed AS (
            SELECT r, sum(n)::BIGINT AS n_features, sum(n * g)::BIGINT AS weight FROM own JOIN hashed USING (f) JOIN gain USING (b) GROUP BY r
        ), scored AS (
            SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
            FROM docs LEFT JOIN summed USING (r)
        ), ranked AS (
            SELECT *, row_number() OVER (ORDER BY n_words < 20, score DESC, doc_id NULLS LAST) AS place FROM scored
        )
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * (SELECT count(*) FROM scored WHERE n_words >= 20) // 100 THEN place END AS rank FROM ranked
    """,
}
