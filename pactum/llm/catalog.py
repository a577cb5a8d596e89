"""The registered queries of this subpackage, thin over its operators, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document and benchmark item that leaked into it."""
    from pactum.llm.decontaminate import leaked

    return leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, whose texts look like control strings."""
    from pactum.llm.chat import conversation_digests, format_conversations

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return conversation_digests(format_conversations(rows.unionByName(extra)))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in a mix by sizes to the power 0.7, in blocks of 64."""
    from pactum.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of 5-word shingles, component at a Jaccard of 0.8, and number of links."""
    from pactum.llm.ngram_join import join_documents

    return join_documents(table(spark, sf_dir, "documents"))


def op4_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of op4_ngram_join under the name that they first had."""
    return op4_ngram_join(spark, sf_dir)


def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links and component at a cosine of 0.9."""
    from pactum.llm.vector_dedup import dedup_vectors

    return dedup_vectors(table(spark, sf_dir, "embeddings"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's own score, its site's rate, and both combined."""
    from pactum.llm.quality import classify

    scored = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "doc_score", "site_rate", "quality_score", "keep")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by labels of the rows whose crc32(doc_id as text) mod 5 isn't 0."""
    from pactum.llm.toxicity import score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = lambda c: F.pmod(F.crc32(c.cast("string")), F.lit(5))
    model = train(docs, table(spark, sf_dir, "labels"), lambda c: fold(c) != 0)
    scored = score(docs, model)
    spans = F.array_join(F.transform("offending", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", spans.alias("offending"))


def op8_token_files(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """Every document's ids through the block files and back."""
    from pactum.llm.token_files import token_report

    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path(TOKENIZER)
    return token_report(table(spark, sf_dir, "documents"), str(tokenizer_path))


def op9_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data: counts and digest of the four base kinds, and all spans."""
    from pactum.llm.pii import pii_report

    return pii_report(table(spark, sf_dir, "documents"))


#: host, path, verdict
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, the rule that holds for it and the verdict."""
    from pactum.llm.url_filter import judge_urls

    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark's words, its score with noise, and its rank among the drawn quarter."""
    from pactum.llm.resample import resample

    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of 64 sound components with its cluster of 40 after five rounds."""
    from pactum.llm.centroids import cluster_vectors, kept_vectors

    assigned, centroids = cluster_vectors(kept_vectors(table(spark, sf_dir, "embeddings")))
    found = assigned.join(F.broadcast(centroids), "cluster")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of its equals."""
    from pactum.llm.exact_dedup import dedup_exact

    return dedup_exact(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_chat_format": op2_chat_format,
    "op3_mix_sources": op3_mix_sources,
    "op4_ngram_join": op4_ngram_join,
    "op4_ngram_links": op4_ngram_links,
    "op5_vector_dedup": op5_vector_dedup,
    "op6_quality": op6_quality,
    "op7_toxicity": op7_toxicity,
    "op8_token_files": op8_token_files,
    "op9_pii_spans": op9_pii_spans,
    "op10_url_filter": op10_url_filter,
    "op11_resample": op11_resample,
    "op12_centroids": op12_centroids,
    "op13_exact_dedup": op13_exact_dedup,
}

#: The reflected polynomial of CRC-32, and what it makes of each half byte.
_CRC_POLYNOMIAL = 0xEDB88320


def _half_byte(n: int) -> int:
    for _ in range(4):
        n = n >> 1 ^ _CRC_POLYNOMIAL if n & 1 else n >> 1
    return n


_HALVES = ", ".join(str(_half_byte(n)) for n in range(16))


def _rounds_sql(rounds: int = 5) -> str:
    """Assignment and update, written out for each round; centroids c0, c1, ... and assignments a0, a1, ..."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
        d{r} AS MATERIALIZED (
            SELECT vec_id, x, j, list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(x, c)]) AS d FROM vectors, c{r}),
        a{r} AS MATERIALIZED (
            SELECT vec_id, any_value(x) AS x, CAST(min(d) AS BIGINT) AS d, arg_min(j, (d, j)) AS j FROM d{r} GROUP BY vec_id)""")
        if r < rounds:
            steps.append(f"""
        s{r} AS (
            SELECT j, i, sum(x[i]) AS s, count(*) AS n FROM a{r}, range(1, 65) AS t(i) GROUP BY j, i),
        m{r} AS (
            SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{r} GROUP BY j),
        c{r + 1} AS MATERIALIZED (
            SELECT c{r}.j, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (j))""")
    return ",".join(steps)


ORACLES = {
    "op11_resample": rf"""
        WITH words AS (
            SELECT doc_id, side, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM (SELECT doc_id, text, 's' AS side FROM documents UNION ALL SELECT item_id, text, 't' FROM benchmark)),
        features AS MATERIALIZED (
            SELECT doc_id, side, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])) AS f FROM words),
        distinct_features AS (SELECT DISTINCT f FROM features),
        bucketed AS MATERIALIZED (
            SELECT f, xor(list_reduce(
                [CAST(instr('0123456789ABCDEF', substr(h, CAST(q AS INT), 1)) - 1 AS BIGINT) FOR q IN list_transform(range(1, len(h) + 1), lambda z: z + CASE WHEN z % 2 = 1 THEN 1 ELSE -1 END)],
                lambda crc, half: xor(crc >> 4, ([{_HALVES}])[CAST((xor(crc, half) & 15) + 1 AS INT)]), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS b
            FROM (SELECT f, hex(f) AS h FROM distinct_features)),
        counts AS (
            SELECT k AS b, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 't') AS t
            FROM range(10000) AS r(k) LEFT JOIN (features JOIN bucketed USING (f)) ON b = k GROUP BY k),
        gains AS (
            SELECT b, CAST(floor(1000 * ln((t + 1.0::DOUBLE) * (sum(s) OVER () + 10000.0::DOUBLE) / ((s + 1.0::DOUBLE) * (sum(t) OVER () + 10000.0::DOUBLE)))) AS BIGINT) AS g FROM counts),
        summed AS (
            SELECT doc_id, sum(g) AS g, count(*) AS n FROM features JOIN bucketed USING (f) JOIN gains USING (b) WHERE side = 's' GROUP BY doc_id),
        scored AS (
            SELECT doc_id, len(w) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_features,
                   CAST(coalesce((g - ((g % n) + n) % n) // n, 0) AS BIGINT) AS weight,
                   CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) AS h
            FROM words LEFT JOIN summed USING (doc_id) WHERE side = 's'),
        noised AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM scored),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_words >= 20) OVER () AS fit FROM noised)
        SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * fit // 100 THEN place END AS rank FROM placed
    """,
    "op12_centroids": rf"""
        WITH vectors AS MATERIALIZED (
            SELECT vec_id, [CAST(floor(256 * CAST(v AS DOUBLE)) AS BIGINT) FOR v IN embedding] AS x FROM embeddings
            WHERE len(embedding) = 64 AND len([v FOR v IN embedding IF v IS NULL OR isnan(v) OR isinf(v)]) = 0),
        c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY h) - 1 AS j, x AS c FROM (SELECT x, sha256('2:' || vec_id) AS h FROM vectors ORDER BY h LIMIT 40)),
        {{rounds}},
        found AS (SELECT j, sum(d) AS of_cluster FROM a5 GROUP BY j)
        SELECT vec_id, CAST(a5.j AS INTEGER) AS cluster, d AS distance, CAST(of_cluster AS BIGINT) AS cluster_inertia,
               CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a5 JOIN found USING (j) JOIN c5 USING (j)
    """.format(rounds=_rounds_sql()),
    "op13_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op2_chat_format": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        sized AS (
            SELECT *, (SELECT sum((length(text) - length(replace(text, c, ''))) // length(c))
                       FROM (VALUES (chr(92)), ('<s>'), ('</s>'), ('[INST]'), ('[/INST]'), ('<|turn|>'), ('<|end|>')) AS v(c)) AS escapes
            FROM turns)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(3 + sum(8 + length(role) + 1 + length(text) + escapes + 8) AS BIGINT) AS formatted_chars,
               CAST(0 AS BIGINT) AS rewrites
        FROM sized GROUP BY conv_id
    """,
    "op4_ngram_join": r"""
        WITH RECURSIVE worded AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[])
                                WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                ELSE list_sort(list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)])) END AS s
            FROM worded),
        named AS (
            SELECT doc_id, s, len(s) AS n, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY s) END AS copy_of FROM sets),
        shingles AS (SELECT copy_of AS k, n, unnest(s) AS g FROM named WHERE doc_id = copy_of),
        links AS (
            SELECT a.k AS x, b.k AS y FROM shingles a JOIN shingles b ON a.g = b.g AND a.k <> b.k
            GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        reached AS (
            SELECT DISTINCT x AS root, x AS k FROM links
            UNION
            SELECT r.root, l.y FROM reached r JOIN links l ON l.x = r.k),
        least AS (SELECT k, min(root) AS root FROM reached GROUP BY k),
        copies AS (SELECT copy_of AS k, count(*) - 1 AS c FROM named WHERE n > 0 GROUP BY copy_of),
        counted AS (SELECT x AS k, sum(c + 1) AS m FROM links JOIN copies ON copies.k = y GROUP BY x)
        SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(root, copy_of) AS component_id, CAST(coalesce(c, 0) + coalesce(m, 0) AS BIGINT) AS n_links
        FROM named LEFT JOIN least ON least.k = copy_of LEFT JOIN copies ON n > 0 AND copies.k = copy_of LEFT JOIN counted ON n > 0 AND counted.k = copy_of
    """,
    "op5_vector_dedup": r"""
        WITH RECURSIVE sound AS (
            SELECT vec_id AS k, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE len([v FOR v IN embedding IF v IS NULL OR isnan(v) OR isinf(v)]) = 0 AND len([v FOR v IN embedding IF v <> 0]) > 0),
        links AS (
            SELECT a.k AS x, b.k AS y FROM sound a JOIN sound b ON a.k <> b.k AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
        reached AS (
            SELECT DISTINCT x AS root, x AS k FROM links
            UNION
            SELECT r.root, l.y FROM reached r JOIN links l ON l.x = r.k),
        least AS (SELECT k, min(root) AS root FROM reached GROUP BY k),
        counted AS (SELECT x, count(*) AS n FROM links GROUP BY x)
        SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) = vec_id AS kept
        FROM embeddings LEFT JOIN least ON k = vec_id LEFT JOIN counted ON x = vec_id
    """,
    "op10_url_filter": r"""
        WITH split AS (
            SELECT page_id, url,
                   translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
            FROM pages),
        ruled AS (
            SELECT page_id, host, path,
                   CASE WHEN host = 'www.example.com' OR host LIKE '%.www.example.com' THEN CASE WHEN starts_with(path, '/en/') THEN 'www.example.com/en/' END END AS r1,
                   CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/' END AS r2,
                   CASE WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
                        WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/' END AS r3,
                   CASE WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS r4
            FROM split)
        SELECT page_id, host, path, coalesce(r1, r2, r3, r4) AS rule,
               CASE coalesce(r1, r2, r3, r4) WHEN 'example.com/en/' THEN 'block' WHEN 'net/es/' THEN 'block' WHEN 'net/fr/' THEN 'block' ELSE 'allow' END AS verdict
        FROM ruled
    """,
}
