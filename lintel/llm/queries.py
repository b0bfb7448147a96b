"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.llm import chat, codes, cotraining, html_text, jaccard, language, lattice, line_dedup, media, mixing, nearest, phrases, sentencepieces
from lintel.session import prepare, table

#: Mixing: a source's weight is its number of documents to this power; documents in a block.
MIX_POWER, MIX_BLOCK = 0.5, 64


def piece_model() -> bytes:
    """The merge-type vocabulary's bytes; they travel with the tasks."""
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest.search(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepieces.encode_digests(docs, piece_model()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components_of(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (declared language, source as host) and pages (lang attribute, host of the address)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit(None).cast("long").alias("page_id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"))
    pages = table(spark, sf_dir, "pages").select(
        F.lit(None).cast("long").alias("doc_id"),
        "page_id",
        F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), r"<[^>]*>", " ").alias("text"),
        F.nullif(F.regexp_extract("html", r"(?i)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", 1), F.lit("")).alias("declared"),
        F.nullif(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1), F.lit("")).alias("host"),
    )
    both = docs.unionByName(pages).withColumn("item", F.concat_ws(":", F.col("doc_id").cast("string"), F.concat(F.lit("page"), F.col("page_id").cast("string"))))
    return language.identify(both, "item").select("doc_id", "page_id", "declared", "host", "language", "language_posterior", "language_kept")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return media.media_columns(docs).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "shard", "shard_offset"
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "lines_before", "lines_deleted", "text")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = chat.read_chats(chat.format_chats(turns))
    masked = F.array_join(F.transform("masked", chat.unescape), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length(masked).cast("long").alias("loss_chars"),
        F.sha2(masked, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs, power=MIX_POWER, block_docs=MIX_BLOCK)


def op11_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose id's crc32 leaves 2 when divided by 7 are held out; counts are kept for each language too."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (F.crc32(F.col("doc_id").cast("string")) % 7 == 2).alias("held_out"))
    return lattice.lattice_scores(docs, piece_model(), "held_out", by="lang")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.phrases(table(spark, sf_dir, "documents").select("lang", "text"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))[0]


QUERIES = {
    "op1_nearest": op1_nearest,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_jaccard": op3_jaccard,
    "op4_language": op4_language,
    "op5_media": op5_media,
    "op6_line_dedup": op6_line_dedup,
    "op7_html": op7_html,
    "op8_chat": op8_chat,
    "op9_quality": op9_quality,
    "op10_mixing": op10_mixing,
    "op11_lattice": op11_lattice,
    "op12_phrases": op12_phrases,
    "op13_codes": op13_codes,
}



def lloyd_sql(rounds: int) -> str:
    """Plain Lloyd rounds over the parts of the embeddings' integers."""
    steps = [
        """WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
part AS MATERIALIZED (SELECT vec_id, p, x[p * len(x) // 8 + 1:(p + 1) * len(x) // 8] AS x FROM v, range(8) AS r(p)),
e0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS j, x AS e FROM part QUALIFY j < 16)"""
    ]
    for k in range(rounds + 1):
        steps.append(
            f"""a{k} AS MATERIALIZED (SELECT vec_id, p, any_value(x) AS x, min((d, j)) AS best FROM
  (SELECT vec_id, part.p AS p, x, j, list_sum(list_transform(list_zip(x, e), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::BIGINT AS d FROM part JOIN e{k} USING (p)) GROUP BY vec_id, p)"""
        )
        if k < rounds:
            steps.append(
                f"""s{k} AS (SELECT p, best[2] AS j, i, sum(x[i]) AS s, count(*) AS n FROM a{k}, unnest(generate_series(1, len(x))) AS g(i) GROUP BY p, best[2], i),
m{k} AS (SELECT p, j, list(CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END::BIGINT ORDER BY i) AS e FROM s{k} GROUP BY p, j),
e{k + 1} AS MATERIALIZED (SELECT o.p, o.j, coalesce(m{k}.e, o.e) AS e FROM e{k} AS o LEFT JOIN m{k} ON m{k}.p = o.p AND m{k}.j = o.j)"""
            )
    return (
        ",\n".join(steps)
        + f""",
c AS (SELECT vec_id, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, sum(best[1]) AS error FROM a{rounds} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, j)) AS codebooks_sha256 FROM e{rounds})
SELECT vec_id, code, error::BIGINT AS error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM c JOIN v USING (vec_id), h"""
    )


ORACLE_SQL = {
    "op13_codes": lloyd_sql(6),
    "op8_chat": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
u AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n,
  length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) AS chars, length(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g')) AS role_chars FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars + CASE WHEN n = 1 OR role <> before THEN 24 + role_chars ELSE 8 END)::BIGINT AS formatted_chars
FROM u GROUP BY conv_id""",
    "op12_phrases": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS gram FROM w, (SELECT unnest([1, 2, 3]) AS size), unnest(generate_series(1, len(w) - size + 1)) AS s(i)),
f AS (SELECT lang, gram, any_value(size) AS size, count(*)::HUGEINT AS n FROM g GROUP BY lang, gram),
total AS (SELECT lang, sum(n) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, gram, size, n AS a, string_split(gram, ' ') AS w FROM f WHERE size > 1 AND n >= 10),
kept AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c AS o WHERE o.lang = c.lang AND o.size = 3 AND c.size = 2 AND 100 * o.a >= 50 * c.a AND (o.w[1:2] = c.w OR o.w[2:3] = c.w))),
cuts AS (SELECT kept.*, k, array_to_string(w[:k], ' ') AS one, array_to_string(w[k + 1:], ' ') AS two FROM kept, (SELECT unnest([1, 2]) AS k) WHERE k < size),
scored AS (SELECT cuts.lang, cuts.gram, a, k, l.n AS l, r.n AS r, (1000000 * a * a) // (l.n * r.n) AS score FROM cuts JOIN f AS l ON l.lang = cuts.lang AND l.gram = one JOIN f AS r ON r.lang = cuts.lang AND r.gram = two),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, k) = 1)
SELECT best.lang, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, gram) AS rank, gram AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, total.n::BIGINT AS n, score::BIGINT AS score
FROM best JOIN total USING (lang) QUALIFY rank <= 2000""",
}


def queries() -> dict:
    return {name: (lambda spark, sf_dir, f=f: f(prepare(spark), sf_dir)) for name, f in QUERIES.items()}
