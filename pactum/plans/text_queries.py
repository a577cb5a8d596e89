"""Registered text, entity, law, file and stream queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.functions import text as T
from pactum.functions import model
from pactum.operators import analyses, approvals, audit, law_index, text_ops
from pactum.plans.twins import TWINS
from pactum.sources import document_source, files
from pactum.sources.domain import Domain, twin
from pactum.streaming import audit_stream

#: Pages from turns, with the lines that the text rules look for.
PAGES_SQL = """SELECT conv_id AS doc_id, CAST(turn + 1 AS INT) AS page_number, concat('CONFIDENTIAL DRAFT', chr(10), CASE WHEN turn % 2 = 0 THEN concat('Điều ', turn + 1, '. Mục “', turn, '”', chr(10)) ELSE '' END,
    CASE WHEN turn % 6 = 5 THEN '' ELSE concat(text, chr(10), 'thanh', chr(10), 'toán –  xong', chr(7), chr(10), chr(10), chr(10), chr(10)) END, '- ', turn + 1, ' -',
        chr(10), 'Trang ', turn + 1) AS text,
    CASE WHEN turn % 3 = 0 THEN 'ocr' ELSE 'native' END AS source, (turn % 10) / 10.0 AS confidence FROM {conversations}"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Domain(spark, sf_dir).sql(PAGES_SQL)


def header_footer_lines(spark, sf_dir):
    return text_ops.repeated_lines(pages(spark, sf_dir))


def normalize_pages(spark, sf_dir):
    return text_ops.normalize_pages(pages(spark, sf_dir))


def clause_split(spark, sf_dir):
    return text_ops.split_clauses(pages(spark, sf_dir))


def word_stats(spark, sf_dir):
    return text_ops.word_stats(pages(spark, sf_dir))


def _with_blanks(pages: DataFrame) -> DataFrame:
    return pages.withColumn("text", F.when(F.col("page_number") % 6 == 0, F.lit(" \n ")).otherwise(F.col("text")))


def doc_validation(spark, sf_dir):
    return text_ops.document_warnings(_with_blanks(pages(spark, sf_dir)))


def document_validation(spark, sf_dir):
    """All six warnings: documents without pages, pages and clauses with faults, documents without clauses."""
    every = Domain(spark, sf_dir)["conversations"].select(F.col("conv_id").alias("doc_id")).distinct()
    some = pages(spark, sf_dir).where("doc_id % 10 <> 9")
    clauses = text_ops.split_clauses(some.where("doc_id % 10 <> 8")).withColumn("title", F.when(F.col("clause_no") % 3 == 0, " ").otherwise(F.col("title")))
    found = text_ops.validate(every, _with_blanks(some), clauses)
    return found.select("doc_id", F.array_join("warnings", " | ").alias("warnings"))


def clause_stats(spark, sf_dir):
    return text_ops.clause_stats(text_ops.split_clauses(pages(spark, sf_dir)))


def page_markers(spark, sf_dir):
    return text_ops.page_markers(pages(spark, sf_dir))


def file_pages(spark, sf_dir):
    """Documents as files of five kinds: texts with and without bad bytes, archives that are none, pictures, and kinds that nobody reads."""
    ending = F.element_at(F.array(*map(F.lit, (".txt", ".DOCX", ".pdf", ".exe", ""))), (F.col("doc_id") % 5 + 1).cast("int"))
    content = F.when(F.col("doc_id") % 15 != 10, F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF41C3"))))
    named = Domain(spark, sf_dir)["documents"].select(F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), ending).alias("path"), content.alias("content"))
    return files.pages_of_files(named)


def stored_files(spark, sf_dir):
    """Digests of documents as lines of text files, written by Spark and read back as pages by the data source of contract files."""
    path, docs = files.shared_path(spark, "files"), Domain(spark, sf_dir)["documents"]
    line = F.concat_ws(" ", F.col("doc_id").cast("string"), F.sha2(F.coalesce("text", F.lit("")), 256))
    docs.where("doc_id is not null").select(line.alias("value")).write.text(path)
    document_source.register(spark)
    read = spark.read.format(document_source.NAME).option("pathGlobFilter", "part-*.txt").load(path)
    lines = read.where(F.col("kind") == files.PAGE_ROW).select(F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    return lines.select(F.substring_index("line", " ", 1).cast("long").alias("doc_id"), F.substring_index("line", " ", -1).alias("text_sha256"))


def document_json_sink(spark, sf_dir):
    """Documents written as JSON and read back."""
    path, own = files.shared_path(spark, "documents"), pages(spark, sf_dir)
    files.write_document_json(own, text_ops.split_clauses(own), path)
    back = files.read_document_json(spark, path)
    return back.select("doc_id", "file_name", F.size("pages").alias("n_pages"), F.size("clauses").alias("n_clauses"), F.array_join(F.transform("clauses", lambda c: c["title"]), "|").alias("titles"))


def clean_cells(spark, sf_dir):
    """Cells with control characters, wide blanks and letters that have a plain form."""
    told = F.concat(F.lit("\t \x07"), F.col("text"), F.lit("\u00a0\u00a0ﬁ①\r\n"), F.lit("Ａ"))
    return Domain(spark, sf_dir)["conversations"].select("conv_id", "turn", T.clean_cell(F.when(F.col("turn") % 7 != 3, told)).alias("cell"))


#: What a recogniser answers, in each of its shapes: named lists, lines with boxes, the same in one more list, nothing.
RECOGNISED_SQL = """SELECT conv_id AS doc_id, CAST(turn + 1 AS INT) AS page_number, CASE turn % 4
    WHEN 0 THEN concat('[', chr(123), '"rec_texts": ["a', turn, '", " ", "b"], "rec_scores": [0.5, 0.9, 0.75]', chr(125), ']')
    WHEN 1 THEN concat('[[[[0, 1], [2, 3]], ["line ', conv_id, '", 0.25]], [[[1, 1], [2, 2]], ["  ", 0.5]], [[[2, 2], [3, 3]], ["end", 0.75]]]')
    WHEN 2 THEN '[[[[[0, 1], [2, 3]], ["wrapped", 0.5]]]]' ELSE '[]' END AS answer FROM {conversations}"""


def ocr_fold(spark, sf_dir):
    return text_ops.ocr_pages(Domain(spark, sf_dir).sql(RECOGNISED_SQL))


def _assembled(spark, sf_dir, skip_ocr: bool):
    d = Domain(spark, sf_dir)
    kind = F.element_at(F.array(*map(F.lit, ("pdf", "pdf", "image", "txt", "docx"))), (F.col("doc_id") % 5 + 1).cast("int"))
    table = d["conversations"].select(F.col("conv_id").alias("doc_id")).distinct().select("doc_id", kind.alias("file_type"), (F.col("doc_id") % 5 != 1).alias("readable"))
    scanned = F.when((F.col("turn") % 3 == 1) | (F.col("conv_id") % 10 == 0), " \n").otherwise(F.concat(F.col("text"), F.lit("x" * 50)))
    native = d["conversations"].select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page_number"), scanned.alias("text"))
    plain = table.select("doc_id", F.lit(1).alias("page_number"), F.concat(F.lit("plain "), F.col("doc_id").cast("string")).alias("text"))
    return text_ops.assembled_pages(table, native, text_ops.ocr_pages(d.sql(RECOGNISED_SQL)), plain, skip_ocr)


def assembled_pages(spark, sf_dir):
    return _assembled(spark, sf_dir, False)


def assembled_pages_without_ocr(spark, sf_dir):
    return _assembled(spark, sf_dir, True)


def keyword_entities(spark, sf_dir):
    return text_ops.clause_entities(Domain(spark, sf_dir)["clause"])


#: Answers with values of every JSON type, the empty one of each, and keys that are equal in capitals.
ANSWERS_SQL = """SELECT event_id AS id, concat(CASE event_id % 3 WHEN 0 THEN concat('Here: ```json', chr(10)) WHEN 1 THEN 'Answer ' ELSE '' END,
    CASE WHEN event_id % 5 = 4 THEN 'none' ELSE concat(chr(123), '"party": "', event_type, '", "amount": "', event_id % 4, '", "empty": "", "paid": ', CASE event_id % 2
        WHEN 0 THEN 'true' ELSE 'false' END,
        ', "Rate": ', CASE event_id % 4 WHEN 0 THEN '0.0' WHEN 1 THEN '2.50' WHEN 2 THEN '17' ELSE '0' END, ', "parts": ', CASE event_id % 3 WHEN 0 THEN '[]'
            WHEN 1 THEN '["a", 1, true]' ELSE 'null' END,
        ', "RATE2": "first", "rate2": ', CASE event_id % 7 WHEN 0 THEN '""' ELSE '"second"' END, chr(125)) END,
    CASE WHEN event_id % 3 = 0 THEN concat(chr(10), '```') ELSE ' end' END) AS answer FROM {events}"""


def llm_json_repair(spark, sf_dir):
    return Domain(spark, sf_dir).sql(ANSWERS_SQL).select("id", F.coalesce(T.json_of_answer(F.col("answer")), F.lit("{}")).alias("json_text"))


def entity_normalize(spark, sf_dir):
    return text_ops.model_entities(Domain(spark, sf_dir).sql(ANSWERS_SQL))


def law_query_terms(spark, sf_dir):
    return Domain(spark, sf_dir)["clause"].select("id", T.law_terms(F.col("title"), F.col("content")).alias("query"))


def law_search_top5(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return text_ops.law_search(text_ops.law_queries(d["clause"]), d["law"])


def law_search_in_book(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return text_ops.law_search(text_ops.law_queries(d["clause"]), d["law"], top=3, law_name="Law 2")


#: Calls of the law tools: with and without arguments, of one book and of all, of tools and methods that aren't there, and no calls at all.
CALLS_SQL = """SELECT event_id AS id, CASE event_id % 9
    WHEN 0 THEN concat(chr(123), '"jsonrpc": "2.0", "method": "tools/call", "params": ', chr(123), '"name": "search_laws", "arguments": ', chr(123),
        '"query": "phạt vi phạm ', event_type, '"', chr(125), chr(125), chr(125))
    WHEN 1 THEN concat(chr(123), '"method": "tools/call", "params": ', chr(123), '"name": "search_laws", "arguments": ', chr(123),
        '"query": "PENALTY, the", "law_name": "Law ', event_id % 7, '"', chr(125), chr(125), chr(125))
    WHEN 2 THEN concat(chr(123), '"method": "tools/call", "params": ', chr(123), '"name": "search_laws", "arguments": ', chr(123), '"query": ""', chr(125), chr(125), chr(125))
    WHEN 3 THEN concat(chr(123), '"method": "tools/call", "params": ', chr(123), '"name": "get_law_article", "arguments": ', chr(123), '"law_name": "Law ', event_id % 5,
        '", "article_number": "Article ',
        event_id % 60, '"', chr(125), chr(125), chr(125))
    WHEN 4 THEN concat(chr(123), '"method": "tools/call", "params": ', chr(123), '"name": "get_law_article", "arguments": ', chr(123), '"law_name": "Law 1"', chr(125), chr(125), chr(125))
    WHEN 5 THEN concat(chr(123), '"method": "tools/call", "params": ', chr(123), '"name": "burn_law"', chr(125), chr(125))
    WHEN 6 THEN concat(chr(123), '"method": "', event_type, '/list"', chr(125)) WHEN 7 THEN concat(chr(123), '"method": "tools/list"', chr(125)) ELSE 'no call' END AS payload FROM {events}"""


def law_rpc(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return law_index.answer_calls(d.sql(CALLS_SQL), d["law"]).select("id", "text", "error_code", "error_message")


def law_reference_blocks(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return text_ops.law_references(text_ops.law_search(text_ops.law_queries(d["clause"]), d["law"]), d["law"])


def entity_upsert(spark, sf_dir):
    """Entities of all clauses put to those that every other clause had before; each stands once."""
    cols = ("clause_id", "entity_type", "entity_value")
    found = text_ops.clause_entities(Domain(spark, sf_dir)["clause"]).withColumn("clause_id", F.col("id")).select("id", *cols)
    return analyses.store_entities(found.unionByName(found), found.where("clause_id % 2 = 0").select(*cols))


def _client():
    """Stands for a model host, which no table holds: it answers in capitals, leaves some prompts open and fails on others."""

    def answer(prompts: list[str]) -> list[str]:
        if any("error" in p for p in prompts):
            raise ConnectionError("no model host")
        return [p.upper() if len(p) % 2 else "" for p in prompts]

    return answer


def model_boundary(spark, sf_dir):
    """All prompts put to a client, and all once more without one.

    Prompts of one kind each batch, so that failures are the same at every size: rows of a failing kind keep what the rule says.
    """
    prompts = Domain(spark, sf_dir)["events"].select("event_id", F.concat("event_type", F.repeat(F.lit("!"), (F.col("event_id") % 3).cast("int"))).alias("prompt"))
    fallback = F.concat(F.lit("rule: "), F.col("prompt"))
    fails = F.coalesce(F.contains("prompt", F.lit("error")), F.lit(False))
    asked = [model.with_answers(prompts.where(kind), "prompt", _client, fallback) for kind in (~fails, fails)]
    alone = model.with_answers(prompts.withColumn("event_id", -1 - F.col("event_id")), "prompt", None, fallback)
    return asked[0].unionByName(asked[1]).unionByName(alone)


def file_crypto(spark, sf_dir):
    docs = Domain(spark, sf_dir)["documents"]
    sealed = docs.select("doc_id", F.encode("text", "UTF-8").alias("raw")).withColumn("sealed", files.seal(F.col("raw"), "contract key"))
    return sealed.select("doc_id", (F.length("sealed") - F.length("raw")).alias("overhead"), (files.unseal(F.col("sealed"), "contract key") == F.col("raw")).alias("same"))


def audit_hours(spark, sf_dir):
    return audit_stream.run_once(spark, sf_dir)


def audit_append(spark, sf_dir):
    """Requests classified as a stream and appended to the log, read back from it."""
    d, path = Domain(spark, sf_dir), files.shared_path(spark, "audit-log")
    stored = d["contract"]
    d.known["events"] = audit_stream.file_stream(spark, sf_dir, "events.parquet")
    rows = audit.classify(d["request"], stored).where("action is not null")
    audit_stream.append_to(rows, path)
    return spark.read.schema(rows.schema).parquet(f"{path}/rows")


def approval_stream(spark, sf_dir):
    """Approvals taken as a stream, each workflow's states kept by Spark, their outcomes appended and read back."""
    stored, d, path = Domain(spark, sf_dir), Domain(spark, sf_dir), files.shared_path(spark, "approvals")
    d.known["events"] = audit_stream.file_stream(spark, sf_dir, "events.parquet")
    starts = approvals.boards(stored["workflow"], stored["step"], stored["dependency"])
    rows = approvals.approval_stream(d["approval"].withColumnRenamed("status", "action"), starts)
    audit_stream.append_to(rows, path)
    return spark.read.schema(rows.schema).parquet(f"{path}/rows")


QUERIES = {
    f.__name__: f
    for f in (
        header_footer_lines, normalize_pages, clause_split, clause_stats, page_markers, file_pages, stored_files, word_stats, doc_validation, document_validation, document_json_sink, clean_cells,
        ocr_fold, assembled_pages, assembled_pages_without_ocr, keyword_entities, entity_upsert, llm_json_repair, entity_normalize, model_boundary,
        law_query_terms, law_search_top5, law_search_in_book, law_reference_blocks, law_rpc, file_crypto, audit_hours, audit_append, approval_stream,
    )
}


def _page(body: str) -> str:
    return f"WITH page AS ({twin(PAGES_SQL)}) {body}"


def _lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {_lit(w)})" for w in words) + ")"


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_EDGE = """lines AS (SELECT doc_id, page_number, list_filter(list_transform(string_split(text, chr(10)), lambda l: {strip}), lambda l: l <> '') AS ls FROM page),
    edges AS (SELECT DISTINCT doc_id, page_number, unnest(list_concat(ls[1:3], ls[greatest(len(ls) - 2, 1):])) AS line FROM lines),
    repeated AS (SELECT doc_id, line, count(*) AS pages FROM edges WHERE length(line) > 5 GROUP BY ALL HAVING count(*) >= 3)""".replace("{strip}", _STRIP.format("l"))
_SOFT = rf"([^.!?:;)\"»0-9])\n([{T.LOWER_LETTERS}])"
_HEAD = r"(?im)^((?:điều|dieu|article|section|clause)\s+(?:[IVXLCDM]+|\d+)(?:[\s.:‐\-–—].*)?)$"

ORACLES = {
    "header_footer_lines": _page("").rstrip() + f", {_EDGE} SELECT doc_id, line, pages FROM repeated",
    "normalize_pages": _page("").rstrip() + f""", {_EDGE},
        a AS (SELECT doc_id, page_number, replace(translate(nfc_normalize(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g')), '“”‘’–—' || chr(160),
            '""''''-- '), '…', '...') AS t FROM page),
        b AS (SELECT doc_id, page_number, regexp_replace(regexp_replace(t, {_lit(_SOFT)}, '\\1 \\2', 'g'), {_lit(_SOFT)}, '\\1 \\2', 'g') AS t FROM a),
        c AS (SELECT doc_id, page_number, list_filter(string_split(t, chr(10)), lambda l: NOT regexp_matches(l,
            '(?i)^\\s*(?:[-–—]?\\s*)?(?:Page|Trang)?\\s*\\d{{1,4}}\\s*(?:[-–—]?\\s*)?$')) AS ls FROM b),
        r AS (SELECT doc_id, list(line) AS gone FROM repeated GROUP BY doc_id),
        d AS (SELECT doc_id, page_number, array_to_string(list_filter(ls, lambda l: NOT list_contains(coalesce(gone, []), {_STRIP.format('l')})), chr(10)) AS t FROM c LEFT JOIN r USING (doc_id))
        SELECT doc_id, page_number, {_STRIP.format("regexp_replace(regexp_replace(t, '[ " + chr(92) + "t]+', ' ', 'g'), '" + chr(92) + "n{3,}', chr(10) || chr(10), 'g')")} AS text FROM d""",
    "word_stats": _page(rf"SELECT doc_id, page_number, CAST(len(list_filter(regexp_split_to_array({_STRIP.format('text')}, '\s+'), lambda w: w <> '')) AS INT) AS words, {_STRIP.format('text')} = '' AS is_empty FROM page"),
    "doc_validation": _page("""SELECT doc_id, coalesce(string_agg(CAST(page_number AS VARCHAR), ',' ORDER BY page_number) FILTER (page_number % 6 = 0), '') AS empty_pages,
        coalesce(string_agg(CAST(page_number AS VARCHAR), ',' ORDER BY page_number) FILTER (source = 'ocr' AND confidence < 0.6), '') AS low_confidence_pages FROM page GROUP BY doc_id"""),
    "keyword_entities": twin(
        " UNION ALL ".join(
            [f"SELECT id, 'PARTY' AS entity_type, {_lit(n)} AS entity_value, {_lit(n.upper())} AS normalized_value, CAST(0.95 AS DECIMAL(5, 2)) AS confidence FROM {{clause}} WHERE {_any('lower(content)', w)}" for n, w in T.PARTY_WORDS]
            + [f"SELECT id, 'ACTION', {_lit(v)}, {_lit(c)}, CAST(0.90 AS DECIMAL(5, 2)) FROM {{clause}} WHERE {_any('lower(content)', w)}" for v, c, w in T.ACTION_WORDS]
        )
    ),
    "llm_json_repair": twin(ANSWERS_SQL).join(["WITH answers AS (", r""") SELECT id, coalesce(nullif(CASE WHEN regexp_extract(answer, '```(?:json)?\s*(\{.*?\})\s*```', 1, 's') <> '' THEN regexp_extract(answer, '```(?:json)?\s*(\{.*?\})\s*```', 1, 's')
        ELSE regexp_extract(answer, '(\{.*\})', 1, 's') END, ''), '{}') AS json_text FROM answers"""]),
    "entity_normalize": """WITH e AS (SELECT event_id AS id, event_type AS t FROM events WHERE event_id % 5 <> 4),
        v AS (SELECT id, 'PARTY' AS k, t AS v FROM e UNION ALL SELECT id, 'AMOUNT', CAST(id % 4 AS VARCHAR) FROM e UNION ALL SELECT id, 'PAID', 'True' FROM e WHERE id % 2 = 0
            UNION ALL SELECT id, 'RATE', CASE id % 4 WHEN 1 THEN '2.5' ELSE '17' END FROM e WHERE id % 4 IN (1, 2) UNION ALL SELECT id, 'PARTS', '[''a'', 1, True]' FROM e WHERE id % 3 = 1
            UNION ALL SELECT id, 'RATE2', 'second' FROM e WHERE id % 7 <> 0)
        SELECT id, k AS entity_type, v AS entity_value, upper(v) AS normalized_value, CAST(0.85 AS DECIMAL(5, 2)) AS confidence FROM v""",
    "audit_hours": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS events FROM events GROUP BY ALL",
    "file_crypto": "SELECT doc_id, CAST(28 AS INT) AS overhead, TRUE AS same FROM documents",
}
_TERMS = "concat_ws(' ', " + ", ".join(f"CASE WHEN {_any('low', w)} THEN {_lit(p)} END" for p, w in T.LAW_PHRASES) + ")"
_BARE = _STRIP.format(r"regexp_replace(title, '[^\p{L}\p{N}\s]', ' ', 'g')")
_QUERY = f"SELECT id, CASE WHEN {_TERMS} <> '' THEN {_TERMS} ELSE {_BARE} END AS query FROM (SELECT id, title, lower(concat_ws(' ', title, content)) AS low FROM {{clause}}) c"
ORACLES["law_query_terms"] = twin(_QUERY)
_SCORED = """WITH q AS (SELECT DISTINCT query, lower(query) AS lq FROM (<query>) t),
    w AS (SELECT query, trim(lq) AS lq, law_id, lower(article_title) AS title, lower(coalesce(tags, '')) AS tags, lower(content) AS body, lower(article_number) AS num,
        list_filter(regexp_split_to_array(translate(lq, ',.', '  '), '\\s+'), lambda x: length(x) >= 2) AS words FROM q CROSS JOIN {law} <where>),
    s AS (SELECT query, law_id, CASE WHEN len(words) = 0 THEN 0 ELSE CASE WHEN contains(title, lq) THEN 20 ELSE 0 END + CASE WHEN contains(tags, lq) THEN 15 ELSE 0 END +
        CASE WHEN contains(body, lq) THEN 10 ELSE 0 END
        + coalesce(list_sum(list_transform(words, lambda x: CASE WHEN list_contains(list_transform(string_split(tags, ','), lambda t: trim(t)), x) THEN 5 ELSE 0 END
            + CASE WHEN contains(num, x) OR contains(title, x) THEN 3 ELSE 0 END + CASE WHEN contains(body, x) THEN 1 ELSE 0 END)), 0) END AS score FROM w),
    r AS (SELECT query, law_id, CAST(score AS INT) AS score, row_number() OVER (PARTITION BY query ORDER BY score DESC, law_id) AS place FROM s WHERE score > 0)
    """.replace("<query>", _QUERY)
ORACLES["law_rpc"] = twin(
    """WITH calls AS (SELECT event_id AS id, event_id % 9 AS k, event_type, CASE event_id % 9 WHEN 0 THEN 'phạt vi phạm ' || event_type WHEN 1 THEN 'PENALTY, the' END AS query,
        CASE event_id % 9 WHEN 1 THEN 'Law ' || event_id % 7 END AS book, 'Law ' || event_id % 5 AS a_name, 'Article ' || event_id % 60 AS a_number FROM {events}),
    w AS (SELECT DISTINCT query, book, lower(query) AS lq FROM calls WHERE query IS NOT NULL),
    p AS (SELECT w.*, l.*, lower(article_title) AS title, lower(coalesce(tags, '')) AS tg, lower(content) AS body, lower(article_number) AS num,
        list_filter(regexp_split_to_array(translate(lq, ',.', '  '), '\\s+'), lambda x: length(x) >= 2) AS words FROM w JOIN {law} l ON book IS NULL OR book = l.law_name),
    s AS (SELECT query, book, law_id, law_name || ' - ' || article_number || ': ' || article_title || chr(10) || 'Nội dung: ' || content AS quote,
        CASE WHEN contains(title, lq) THEN 20 ELSE 0 END + CASE WHEN contains(tg, lq) THEN 15 ELSE 0 END + CASE WHEN contains(body, lq) THEN 10 ELSE 0 END
        + list_sum(list_transform(words, lambda x: CASE WHEN list_contains(list_transform(string_split(tg, ','), lambda t: trim(t)), x) THEN 5 ELSE 0 END
            + CASE WHEN contains(num, x) OR contains(title, x) THEN 3 ELSE 0 END + CASE WHEN contains(body, x) THEN 1 ELSE 0 END)) AS score FROM p),
    r AS (SELECT *, row_number() OVER (PARTITION BY query, book ORDER BY score DESC, law_id) AS place FROM s WHERE score > 0),
    f AS (SELECT query, book, string_agg('[' || place || '] ' || quote, chr(10) || chr(10) ORDER BY place) AS found FROM r WHERE place <= 5 GROUP BY query, book),
    a AS (SELECT law_name, article_number, arg_min(law_name || ' - ' || article_number || ': ' || article_title || chr(10) || 'Nội dung: ' || content, law_id) AS article FROM {law} GROUP BY ALL)
    SELECT c.id, CASE k WHEN 0 THEN coalesce(found, 'Không tìm thấy điều khoản luật tương ứng.') WHEN 1 THEN coalesce(found, 'Không tìm thấy điều khoản luật tương ứng.')
            WHEN 3 THEN coalesce(article, 'Không tìm thấy điều luật ' || a_number || ' của ' || a_name || '.') WHEN 7 THEN 'search_laws,get_law_article' END AS text,
        CASE k WHEN 2 THEN -32602 WHEN 4 THEN -32602 WHEN 5 THEN -32601 WHEN 6 THEN -32601 WHEN 8 THEN -32601 END AS error_code,
        CASE k WHEN 2 THEN 'Missing ''query'' argument' WHEN 4 THEN 'Missing ''law_name'' or ''article_number'' argument' WHEN 5 THEN 'Tool ''burn_law'' not found'
            WHEN 6 THEN 'Method ''' || event_type || '/list'' not found' WHEN 8 THEN 'Method ''None'' not found' END AS error_message
    FROM calls c LEFT JOIN f ON f.query = c.query AND f.book IS NOT DISTINCT FROM c.book LEFT JOIN a ON a.law_name = a_name AND a.article_number = a_number"""
)
ORACLES["law_search_top5"] = twin(_SCORED.replace("<where>", "") + "SELECT * FROM r WHERE place <= 5")
ORACLES["law_search_in_book"] = twin(_SCORED.replace("<where>", "WHERE law_name = 'Law 2'") + "SELECT * FROM r WHERE place <= 3")
ORACLES["law_reference_blocks"] = twin(
    _SCORED.replace("<where>", "")
    + """SELECT query, chr(10) || chr(10) || '[THAM CHIẾU LUẬT PHÁP VIỆT NAM (MCP)]:' || chr(10) || string_agg('[' || place || '] ' || law_name || ' - ' || article_number || ': ' || article_title
        || chr(10) || 'Nội dung: ' || content, chr(10) || chr(10) ORDER BY place) || chr(10) || '[HẾT THAM CHIẾU MCP]' AS reference FROM r JOIN {law} USING (law_id) WHERE place <= 5 GROUP BY query"""
)
ORACLES["entity_upsert"] = f"SELECT DISTINCT id AS clause_id, entity_type, entity_value FROM ({ORACLES['keyword_entities']}) e"
ORACLES["model_boundary"] = """WITH p AS (SELECT event_id, event_type || repeat('!', CAST(event_id % 3 AS INT)) AS prompt FROM events)
    SELECT event_id, prompt, CASE WHEN prompt NOT LIKE '%error%' AND length(prompt) % 2 = 1 THEN upper(prompt) ELSE 'rule: ' || prompt END AS answer FROM p
    UNION ALL SELECT -1 - event_id, prompt, 'rule: ' || prompt FROM p"""
ORACLES["approval_stream"] = twin(TWINS["approval_outcomes"])
ORACLES["audit_append"] = twin(TWINS["audit_classify"]).join(["SELECT * FROM (", ") a WHERE action IS NOT NULL"])
ORACLES["clean_cells"] = r"""SELECT conv_id, turn, CASE WHEN turn % 7 = 3 THEN '' ELSE trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g')) || ' fi1 A' END AS cell FROM conversations"""
ORACLES["ocr_fold"] = """SELECT conv_id AS doc_id, CAST(turn + 1 AS INT) AS page_number, CASE turn % 4 WHEN 0 THEN 'a' || turn || chr(10) || 'b' WHEN 1 THEN 'line ' || conv_id || chr(10) || 'end' WHEN 2 THEN 'wrapped' ELSE '' END AS text,
    'ocr' AS source, CASE turn % 4 WHEN 0 THEN 0.625 WHEN 1 THEN 0.5 WHEN 2 THEN 0.5 ELSE 0.0 END AS confidence, CASE turn % 4 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS line_count FROM conversations"""
_ASSEMBLED = f"""WITH ocr AS ({ORACLES['ocr_fold']}),
    native AS (SELECT conv_id AS doc_id, CAST(turn + 1 AS INT) AS page_number, CASE WHEN turn % 3 = 1 OR conv_id % 10 = 0 THEN ' ' || chr(10) ELSE text || repeat('x',
        50) END AS text, turn % 3 = 1 OR conv_id % 10 = 0 AS scan FROM conversations),
    plain AS (SELECT DISTINCT conv_id AS doc_id, 1 AS page_number, 'plain ' || conv_id AS text, 'txt' AS source, 1.0 AS confidence FROM conversations WHERE conv_id % 5 IN (1, 3))
    SELECT * FROM plain UNION ALL SELECT doc_id, page_number, text, 'pdf', 1.0 FROM native WHERE doc_id % 5 = 0 AND NOT scan
    UNION ALL SELECT doc_id, page_number, text, 'native', 1.0 FROM native WHERE doc_id % 5 = 4 UNION ALL """
ORACLES["assembled_pages"] = _ASSEMBLED + """SELECT o.doc_id, o.page_number, o.text, o.source, o.confidence FROM ocr o LEFT JOIN native n ON n.doc_id = o.doc_id AND n.page_number = o.page_number
    WHERE o.doc_id % 5 = 2 OR o.doc_id % 5 = 0 AND n.scan"""
ORACLES["assembled_pages_without_ocr"] = _ASSEMBLED + f"""SELECT doc_id, 1, CASE WHEN doc_id % 5 = 0 THEN {_lit(text_ops.SCAN_NOTE)} ELSE {_lit(text_ops.IMAGE_NOTE)} END, CASE WHEN doc_id % 5 = 0 THEN 'pdf' ELSE 'ocr' END, 1.0
    FROM native WHERE doc_id % 5 IN (0, 2) GROUP BY doc_id HAVING doc_id % 5 = 2 OR bool_and(scan)"""

# Pages joined behind markers, as the splitter sees them; another character stands for the one that this engine's strings can't hold.
_SPLIT = rf"""seg AS (SELECT doc_id, page_number, chr(1) || 'PAGE:' || page_number || chr(1) || chr(10) || text || chr(10) AS s FROM page),
    placed AS (SELECT *, sum(length(s)) OVER (PARTITION BY doc_id ORDER BY page_number) - length(s) AS off FROM seg),
    merged AS (SELECT doc_id, string_agg(s, '' ORDER BY page_number) AS m, max(page_number) AS max_page, max(off) AS last_offset FROM seg JOIN placed USING (doc_id, page_number, s) GROUP BY doc_id),
    cut AS (SELECT doc_id, max_page, m, regexp_extract_all(m, {_lit(_HEAD)}, 1) AS heads, regexp_split_to_array(m, {_lit(_HEAD)}) AS gaps FROM merged),
    rows AS (SELECT doc_id, max_page, k, {_STRIP.format("heads[k]")} AS title, {_STRIP.format(r"regexp_replace(gaps[k + 1], 'PAGE:\d+', '', 'g')")} AS body,
        list_sum(list_transform(gaps[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(heads[1:k - 1], lambda h: length(h))), 0) AS at FROM (SELECT *,
            unnest(range(1, len(heads) + 1)) AS k FROM cut) u
        UNION ALL SELECT doc_id, max_page, 0, 'Phần mở đầu', p, 0 FROM (SELECT *, {_STRIP.format(r"regexp_replace(gaps[1], 'PAGE:\d+', '', 'g')")} AS p FROM cut
            WHERE len(heads) > 0) x WHERE length(p) > 10
        UNION ALL SELECT doc_id, max_page, 0, 'Nội dung hợp đồng', {_STRIP.format(r"regexp_replace(m, 'PAGE:\d+', '', 'g')")}, 0 FROM cut WHERE len(heads) = 0),
    paged AS (SELECT doc_id, max_page, k, title, body, (SELECT max(p.page_number) FROM placed p WHERE p.doc_id = r.doc_id AND p.off <= r.at) AS start_page FROM rows r),
    clauses AS (SELECT doc_id, row_number() OVER w AS clause_no, title, body, start_page, coalesce(lead(start_page) OVER w, max_page) AS end_page FROM paged WINDOW w AS (PARTITION BY doc_id ORDER BY k))"""
ORACLES["page_markers"] = _page("").rstrip() + f", {_SPLIT} SELECT doc_id, length(m) AS merged_chars, max_page, CAST(last_offset AS INT) AS last_offset FROM merged"
ORACLES["clause_split"] = _page("").rstrip() + f", {_SPLIT} SELECT * FROM clauses"
ORACLES["clause_stats"] = _page("").rstrip() + rf""", {_SPLIT} SELECT doc_id, clause_no, CAST(len(list_filter(regexp_split_to_array(body, '\s+'), lambda w: w <> '')) AS INT) AS words, body = '' AS is_empty,
    end_page > start_page AS spans_multiple_pages FROM clauses"""
ORACLES["document_json_sink"] = _page("").rstrip() + f""", {_SPLIT} SELECT doc_id, doc_id || '_processed.json' AS file_name, (SELECT count(*) FROM page p WHERE p.doc_id = c.doc_id) AS n_pages, count(*) AS n_clauses,
    string_agg(title, '|' ORDER BY clause_no) AS titles FROM clauses c GROUP BY doc_id"""
_LISTED = "'[' || string_agg(CAST({n} AS VARCHAR), ', ' ORDER BY {n}) FILTER ({c}) || ']'"
ORACLES["document_validation"] = _page("").rstrip() + f""", {_SPLIT},
    p AS (SELECT doc_id, {_LISTED.format(n='page_number', c='page_number % 6 = 0')} AS e, {_LISTED.format(n='page_number', c="source = 'ocr' AND confidence < 0.6")} AS l
        FROM page WHERE doc_id % 10 <> 9 GROUP BY doc_id),
    f AS (SELECT doc_id, {_LISTED.format(n='clause_no', c="body = ''")} AS h, {_LISTED.format(n='clause_no', c='clause_no % 3 = 0')} AS n FROM clauses WHERE doc_id % 10 < 8 GROUP BY doc_id)
    SELECT d.doc_id, concat_ws(' | ', CASE WHEN d.doc_id % 10 = 9 THEN 'Tài liệu không có trang nào được trích xuất' END, 'Trang rỗng sau normalize: ' || p.e,
        'OCR confidence thấp (<0.6) tại trang: ' || p.l,
        'Điều khoản rỗng (không có nội dung): ' || f.h, 'Điều khoản thiếu tiêu đề: ' || f.n, CASE
            WHEN d.doc_id % 10 >= 8 THEN 'Không tìm thấy điều khoản nào — hãy kiểm tra format tài liệu' END) AS warnings
    FROM (SELECT DISTINCT doc_id FROM page) d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN f ON f.doc_id = d.doc_id"""
ORACLES["stored_files"] = "SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents WHERE doc_id IS NOT NULL"
ORACLES["file_pages"] = """SELECT '/in/' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.DOCX' WHEN 2 THEN '.pdf' WHEN 3 THEN '.exe' ELSE '' END AS path,
    CASE doc_id % 5 WHEN 0 THEN 'page' WHEN 2 THEN 'other' ELSE 'reject' END AS kind, CASE WHEN doc_id % 5 = 0 THEN 1 END AS page_number,
    CASE WHEN doc_id % 15 = 10 THEN '' WHEN doc_id % 5 = 0 THEN text || 'A' END AS text, CASE WHEN doc_id % 5 = 0 THEN 'native' END AS source, CASE
        WHEN doc_id % 5 = 0 THEN CAST(1 AS DOUBLE) END AS confidence,
    CASE doc_id % 5 WHEN 1 THEN 'Not a word-processor file: no zip archive' WHEN 3 THEN 'Unsupported file type: .exe' WHEN 4 THEN 'Unsupported file type: none' END AS error FROM documents"""
