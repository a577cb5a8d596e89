"""Page, clause, entity and law operators over DataFrames."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pactum.functions import text as T
from pactum.operators import law_index
from pactum.operators.common import ordered_text, top_by

#: A line is a page header or footer from this many pages on.
LEAST_PAGES = 3


def repeated_lines(pages: DataFrame) -> DataFrame:
    """doc_id, line, pages: edge lines on at least LEAST_PAGES pages of a document."""
    lines = pages.select("doc_id", "page_number", F.explode(T.edge_lines(F.col("text"))).alias("line"))
    return lines.groupBy("doc_id", "line").agg(F.count("*").alias("pages")).where(F.col("pages") >= LEAST_PAGES)


def normalize_pages(pages: DataFrame) -> DataFrame:
    """doc_id, page_number, text: pages cleaned, without their document's repeated lines."""
    repeated = repeated_lines(pages).groupBy("doc_id").agg(F.collect_set("line").alias("_lines"))
    joined = pages.join(repeated, "doc_id", "left")
    return joined.select("doc_id", "page_number", T.normalize(F.col("text"), F.coalesce("_lines", F.array().cast("array<string>"))).alias("text"))


def page_marker(number: Column) -> Column:
    return F.concat(F.lit("\x00PAGE:"), number.cast("string"), F.lit("\x00"))


def page_offsets(pages: DataFrame) -> DataFrame:
    """doc_id, page_number, offset, chars: where each page's marker stands in its document's pages put one after another, and how long marker and page are."""
    chars = F.length(page_marker(F.col("page_number"))) + 1 + F.length(F.coalesce("text", F.lit(""))) + 1
    sized = pages.select("doc_id", "page_number", chars.cast("long").alias("chars"))
    so_far = Window.partitionBy("doc_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sized.select("doc_id", "page_number", (F.sum("chars").over(so_far) - F.col("chars")).alias("offset"), "chars")


def page_markers(pages: DataFrame) -> DataFrame:
    """doc_id, merged_chars, max_page, last_offset: of a document's pages put one after another, without putting them."""
    last = F.max(F.struct("page_number", "offset"))
    return page_offsets(pages).groupBy("doc_id").agg(F.sum("chars").cast("int").alias("merged_chars"), F.max("page_number").alias("max_page"), last["offset"].cast("int").alias("last_offset"))


def clause_pieces(pages: DataFrame) -> DataFrame:
    """doc_id, page_number, piece, title, text: each page cut at the header lines in it; piece 0, without a title, goes on with the clause before.

    A header that is a page's last line takes the line after it into its title, which is the next page's marker.  So a
    page is read with that marker behind it, and no header needs more than its own page.
    """
    following = F.lead("page_number").over(Window.partitionBy("doc_id").orderBy("page_number"))
    ahead = F.when(following.isNotNull(), page_marker(following)).otherwise(F.lit(""))
    read = pages.select("doc_id", "page_number", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), ahead).alias("text"))
    header = F.lit(T.CLAUSE_HEADER)
    cut = read.select("doc_id", "page_number", F.regexp_extract_all("text", header, F.lit(1)).alias("heads"), F.split("text", T.CLAUSE_HEADER, -1).alias("gaps"))
    each = F.transform("gaps", lambda g, k: F.struct(k.alias("piece"), F.when(k > 0, T.strip(F.get(F.col("heads"), k - 1))).alias("title"), F.regexp_replace(g, r"\x00PAGE:(\d+)\x00", "").alias("text")))
    return cut.select("doc_id", "page_number", F.explode(each).alias("p")).select("doc_id", "page_number", "p.*")


def split_clauses(pages: DataFrame) -> DataFrame:
    """doc_id, clause_no, title, body, start_page, end_page.

    A clause begins at a header line; text before the first header is a clause
    of its own if it has over ten characters; without headers the whole
    document is one clause.  Headers are found page by page; a running count of
    them over a document's pieces numbers the clauses, so no row holds more
    than a page until a clause's own pieces are put together.  A null text is
    an empty page.
    """
    in_order = Window.partitionBy("doc_id").orderBy("page_number", "piece")
    numbered = clause_pieces(pages).withColumn("island", F.count("title").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # where a page goes on, the line of its marker is empty
    text = F.when(F.col("piece") == 0, F.concat(F.lit("\n"), F.col("text"))).otherwise(F.col("text"))
    joined = T.strip(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_number", "piece", text.alias("text")))), lambda p: p["text"]), ""))
    islands = numbered.groupBy("doc_id", "island").agg(F.max("title").alias("title"), joined.alias("body"), F.min("page_number").alias("start_page"), F.max("page_number").alias("last_page"))
    whole = Window.partitionBy("doc_id")
    told = islands.select("*", F.max("island").over(whole).alias("headers"), F.max("last_page").over(whole).alias("max_page"))
    kept = told.where((F.col("island") > 0) | (F.col("headers") == 0) | (F.length("body") > 10))
    title = F.when(F.col("island") > 0, F.col("title")).when(F.col("headers") == 0, "Nội dung hợp đồng").otherwise("Phần mở đầu")
    by_place = whole.orderBy("island")
    end = F.coalesce(F.lead("start_page").over(by_place), F.col("max_page"))
    return kept.select("doc_id", F.row_number().over(by_place).alias("clause_no"), title.alias("title"), "body", "start_page", end.alias("end_page"))


def word_stats(pages: DataFrame) -> DataFrame:
    return pages.select("doc_id", "page_number", T.word_count(F.col("text")).alias("words"), (T.strip(F.col("text")) == "").alias("is_empty"))


def clause_entities(clauses: DataFrame) -> DataFrame:
    return clauses.select("id", F.explode(T.entities(F.col("content"))).alias("e")).select("id", "e.*")


@F.pandas_udf(StringType())
def _python_text(values: pd.Series) -> pd.Series:
    """How Python writes a JSON value that isn't text, a whole number or a truth value: what stored entities hold."""
    return values.map(lambda v: None if v is None else str(json.loads(v)))


def model_entities(rows: DataFrame, answer: str = "answer") -> DataFrame:
    """id, entity_type, entity_value, normalized_value, confidence from {type: value} answers.

    Types are compared in capitals, and of equal ones the last counts.  Values keep their JSON types until then: null,
    false, zero, "", [] and {} are no entities, whatever is left is stored as text (true as True; fractions, lists and
    objects as Python writes them, which is the only part that leaves the JVM).  An answer that isn't a JSON object, or
    repeats a key within a value, gives no rows.
    """
    text = T.json_of_answer(F.col(answer))
    typed, plain = F.from_json(text, "map<string,variant>"), F.from_json(text, "map<string,string>")
    entry = lambda e, raw: F.struct(F.upper(e["key"]).alias("k"), e["value"].alias("v"), raw.alias("raw"))
    listed = rows.select("id", F.zip_with(F.map_entries(typed), F.map_values(plain), entry).alias("e"))
    last = F.filter("e", lambda x, i: ~F.exists(F.slice("e", i + 2, F.size("e")), lambda y: y["k"] == x["k"]))
    pairs = listed.select("id", F.explode(last).alias("x")).select("id", F.col("x.k").alias("k"), F.col("x.raw").alias("raw"), F.schema_of_variant("x.v").alias("kind"))
    kind = F.col("kind")
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(kind, F.lit("DECIMAL"))
    falsy = (
        F.when(kind == "VOID", True).when(kind == "BOOLEAN", F.col("raw") == "false").when(number, F.col("raw").try_cast("double") == 0).when(kind == "STRING", F.col("raw") == "")
        .otherwise(F.col("raw").isin("[]", "{}"))
    )
    kept = pairs.where(~F.coalesce(falsy, F.lit(False)))
    plainly = kind.isin("STRING", "BIGINT", "BOOLEAN")
    simple = F.when(kind.isin("STRING", "BIGINT"), F.col("raw")).when(kind == "BOOLEAN", "True")
    valued = kept.select("id", "k", F.coalesce(simple, _python_text(F.when(~plainly, F.col("raw")))).alias("v"))
    return valued.select("id", F.col("k").alias("entity_type"), F.col("v").alias("entity_value"), F.upper("v").alias("normalized_value"), F.lit("0.85").cast("decimal(5,2)").alias("confidence"))


def law_queries(clauses: DataFrame) -> DataFrame:
    """Distinct search phrases of clauses."""
    return clauses.select(T.law_terms(F.col("title"), F.col("content")).alias("query")).distinct()


def law_search(queries: DataFrame, laws: DataFrame, top: int = 5, law_name: str | None = None) -> DataFrame:
    """query, law_id, score, place: the best `top` laws for each distinct search phrase, ties by law_id; of one law book if it is named."""
    found = law_index.search(queries.select("query", F.lit(law_name).cast("string").alias("book")), laws, top)
    return found.select("query", "law_id", "score", "place")


# How laws are quoted, and what stands for none.
REFERENCE_HEAD, REFERENCE_TAIL = "\n\n[THAM CHIẾU LUẬT PHÁP VIỆT NAM (MCP)]:\n", "\n[HẾT THAM CHIẾU MCP]"


def law_references(found: DataFrame, laws: DataFrame) -> DataFrame:
    """(query, reference): the laws found for each phrase as one numbered block; phrases that found none have no row."""
    cited = found.join(laws, "law_id")
    text = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] "), law_index.quoted_law(F.col("law_name"), F.col("article_number"), F.col("article_title"), F.col("content")))
    blocks = cited.groupBy("query").agg(ordered_text(text, "\n\n", "place").alias("block"))
    return blocks.select("query", F.concat(F.lit(REFERENCE_HEAD), F.col("block"), F.lit(REFERENCE_TAIL)).alias("reference"))


def law_articles(wanted: DataFrame, laws: DataFrame) -> DataFrame:
    """(law_name, article_number, answer): each wanted article's text (the first by law_id), or that it isn't there."""
    key = ["law_name", "article_number"]
    one = top_by(laws, key, "law_id").select(*key, law_index.quoted_law(F.col("law_name"), F.col("article_number"), F.col("article_title"), F.col("content")).alias("found"))
    none = F.concat(F.lit("Không tìm thấy điều luật "), F.col("article_number"), F.lit(" của "), F.col("law_name"), F.lit("."))
    return wanted.select(*key).distinct().join(one, key, "left").select(*key, F.coalesce("found", none).alias("answer"))


def document_warnings(pages: DataFrame) -> DataFrame:
    """doc_id, empty_pages, low_confidence_pages (comma-separated page numbers)."""
    empty, low = page_faults()
    listed = lambda cond: F.coalesce(ordered_text(F.when(cond, F.col("page_number").cast("string")), ",", "page_number"), F.lit(""))
    return pages.groupBy("doc_id").agg(listed(empty).alias("empty_pages"), listed(low).alias("low_confidence_pages"))


#: Recognised text below this confidence is doubtful.
LEAST_CONFIDENCE = 0.6


def page_faults() -> tuple[Column, Column]:
    return T.strip(F.col("text")) == "", (F.col("source") == "ocr") & (F.col("confidence") < LEAST_CONFIDENCE)


def validate(documents: DataFrame, pages: DataFrame, clauses: DataFrame | None) -> DataFrame:
    """(doc_id, warnings): for every document an array of what is wrong with its pages and, if they are given, its clauses, in a fixed order."""
    numbers = lambda cond, number: F.concat(F.lit("["), ordered_text(F.when(cond, F.col(number).cast("string")), ", ", number), F.lit("]"))
    empty, low = page_faults()
    told = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"), numbers(empty, "page_number").alias("empty"), numbers(low, "page_number").alias("low"))
    out = documents.select("doc_id").join(told, "doc_id", "left")
    # fixed values: the texts of the warnings
    warnings = [
        F.when(F.col("n_pages").isNull(), "Tài liệu không có trang nào được trích xuất"), F.concat(F.lit("Trang rỗng sau normalize: "), F.col("empty")),
        F.concat(F.lit(f"OCR confidence thấp (<{LEAST_CONFIDENCE}) tại trang: "), F.col("low")),
    ]
    if clauses is not None:
        blank = lambda c: T.strip(F.coalesce(F.col(c), F.lit(""))) == ""
        faults = clauses.groupBy("doc_id").agg(F.count("*").alias("n_clauses"), numbers(blank("body"), "clause_no").alias("hollow"), numbers(blank("title"), "clause_no").alias("nameless"))
        out = out.join(faults, "doc_id", "left")
        warnings += [
            F.concat(F.lit("Điều khoản rỗng (không có nội dung): "), F.col("hollow")), F.concat(F.lit("Điều khoản thiếu tiêu đề: "), F.col("nameless")),
            F.when(F.col("n_clauses").isNull(), "Không tìm thấy điều khoản nào — hãy kiểm tra format tài liệu"),
        ]
    return out.select("doc_id", F.array_compact(F.array(*warnings)).alias("warnings"))


def clause_stats(clauses: DataFrame) -> DataFrame:
    """doc_id, clause_no, words, is_empty, spans_multiple_pages of split clauses."""
    return clauses.select("doc_id", "clause_no", T.word_count(F.col("body")).alias("words"), (T.strip(F.col("body")) == "").alias("is_empty"), (F.col("end_page") > F.col("start_page")).alias("spans_multiple_pages"))


#: A page with fewer characters than this, blanks and line ends aside, is a picture of text.
SCAN_CHARS = 50


def is_scan(text: Column) -> Column:
    return F.length(F.translate(F.coalesce(text, F.lit("")), " \n", "")) < SCAN_CHARS


def scan_flags(pages: DataFrame) -> DataFrame:
    """doc_id, pages, scan_pages, is_scan (more than half), ocr_confidence (mean of recognised pages to four places, 1 for none)."""
    sure = F.avg(F.when(F.col("source") == "ocr", F.col("confidence")))
    out = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count(F.when(is_scan(F.col("text")), 1)).alias("scan_pages"), F.round(F.coalesce(sure, F.lit(1.0)), 4).alias("ocr_confidence"))
    return out.select("doc_id", "pages", "scan_pages", (F.col("scan_pages") * 2 > F.col("pages")).alias("is_scan"), "ocr_confidence")


def ocr_pages(answers: DataFrame) -> DataFrame:
    """doc_id, page_number, text, source, confidence, line_count from a recogniser's answers (column `answer`, JSON).

    An answer is a list of {"rec_texts": [...], "rec_scores": [...]}, or of
    [box, [text, score]], perhaps within one more list.  Blank lines are left
    out, the others joined by line ends; confidence is their mean, 0 for none.
    """
    parts = F.from_json("answer", "array<string>")
    first = F.coalesce(F.get(parts, 0), F.lit(""))
    # the first entry is a line if its second part ends in a score, else a list of lines
    line = ~F.startswith(F.coalesce(F.get_json_object(first, "$[1][1]"), F.lit("[")), F.lit("["))
    wrapped = F.startswith(first, F.lit("[[")) & ~line
    entries = F.coalesce(F.when(wrapped, F.from_json(F.get(parts, 0), "array<string>")).otherwise(parts), F.array().cast("array<string>"))
    kept = "array<struct<text:string,score:double>>"

    def lines(e: Column) -> Column:
        named = F.from_json(e, "struct<rec_texts:array<string>,rec_scores:array<double>>")
        zipped = F.zip_with(named["rec_texts"], named["rec_scores"], lambda t, s: F.struct(t.alias("text"), s.alias("score")))
        single = F.array(F.struct(F.get_json_object(e, "$[1][0]").alias("text"), F.get_json_object(e, "$[1][1]").cast("double").alias("score")))
        return F.when(F.startswith(e, F.lit("{")), F.coalesce(zipped.cast(kept), F.array().cast(kept))).otherwise(single.cast(kept))

    every = F.filter(F.flatten(F.transform(entries, lines)), lambda x: x["text"].isNotNull() & x["score"].isNotNull() & (T.strip(x["text"]) != ""))
    text = F.array_join(F.transform("lines", lambda x: T.strip(x["text"])), "\n")
    mean = F.aggregate("lines", F.lit(0.0), lambda a, x: a + x["score"]) / F.size("lines")
    out = answers.withColumn("lines", every)
    return out.select("doc_id", "page_number", text.alias("text"), F.lit("ocr").alias("source"), F.when(F.size("lines") > 0, mean).otherwise(0.0).alias("confidence"), F.size("lines").alias("line_count"))


# What stands for a document that is only pictures when recognition is off.
SCAN_NOTE = "[Hệ thống: Đây là tài liệu dạng ảnh quét (scanned PDF) và tính năng trích xuất hình ảnh/OCR đã được tắt theo yêu cầu. Không có văn bản thuần để trích xuất.]"
IMAGE_NOTE = "[Hệ thống: Đây là file hình ảnh và tính năng trích xuất hình ảnh/OCR đã được tắt theo yêu cầu.]"
PAGE = ("doc_id", "page_number", "text", "source", "confidence")


def assembled_pages(files: DataFrame, native: DataFrame, recognised: DataFrame, plain: DataFrame, skip_ocr: bool = False) -> DataFrame:
    """Pages of documents (doc_id, file_type, readable) from what each reader gave: native text, recognised pictures, plain text.

    A PDF that can't be read falls back to its plain text.  Pages of a readable
    one are its native pages that hold text and, for the others, the recognised
    ones.  With recognition off the latter are left out, and a document that
    has no page left gets a note for a page.
    """
    row = lambda df, source: df.select("doc_id", "page_number", "text", F.lit(source).alias("source"), F.lit(1.0).alias("confidence"))
    kind = F.col("file_type")
    broken = (kind == "pdf") & ~F.col("readable")
    of = lambda cond: files.where(cond).select("doc_id")
    text = row(plain.join(of(broken | (kind == "txt")), "doc_id", "left_semi"), "txt")
    words = row(native.where(~is_scan(F.col("text"))).join(of((kind == "pdf") & ~broken), "doc_id", "left_semi"), "pdf")
    whole = row(native.join(of(kind == "docx"), "doc_id", "left_semi"), "native")
    pages = text.unionByName(words).unionByName(whole)
    if not skip_ocr:
        scans = native.where(is_scan(F.col("text"))).select("doc_id", "page_number").join(of((kind == "pdf") & ~broken), "doc_id", "left_semi")
        pictures = recognised.join(of(kind == "image"), "doc_id", "left_semi")
        return pages.unionByName(recognised.join(scans, ["doc_id", "page_number"], "left_semi").select(*PAGE)).unionByName(pictures.select(*PAGE))
    bare = files.where(kind.isin("pdf", "image")).join(pages.select("doc_id").distinct(), "doc_id", "left_anti")
    note = F.when(F.col("file_type") == "pdf", SCAN_NOTE).otherwise(IMAGE_NOTE)
    source = F.when(F.col("file_type") == "pdf", "pdf").otherwise("ocr")
    return pages.unionByName(bare.select("doc_id", F.lit(1).alias("page_number"), note.alias("text"), source.alias("source"), F.lit(1.0).alias("confidence")))
