"""Law search by an inverted index of character grams, and calls to its tools.

What is searched for are terms: the words of a phrase and the phrase itself.  A term that stands in a field of a law
brings all its grams of three characters (two, for a term of two) with it.  So each term is looked up under its rarest
gram only, in lists of the laws that hold it; what the lists give is confirmed on the law's own text, and scored.  No
phrase meets a law that has none of its words, laws are read and never broadcast, and a law's text moves once, to all
terms it is asked for together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactum.functions import text as T
from pactum.operators.common import broadcast_if_small, ordered_text, stash, top_by

FIELDS = ("article_title", "tags", "content", "article_number")
LONGEST_GRAM = 3


def _low(column: str) -> Column:
    return F.lower(F.coalesce(F.col(column), F.lit("")))


def grams(text: Column, n: int) -> Column:
    """All runs of n characters of a text, in order."""
    letters = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    runs = letters
    for k in range(1, n):
        left = F.greatest(F.size(letters) - k, F.lit(0))
        runs = F.zip_with(F.slice(runs, F.lit(1), left), F.slice(letters, F.lit(k + 1), left), lambda a, b: F.concat(a, b))
    return runs


def term_grams(terms: DataFrame) -> DataFrame:
    """(term, gram) of terms of at least two characters."""
    own = F.when(F.length("term") < LONGEST_GRAM, F.array("term")).otherwise(grams(F.col("term"), LONGEST_GRAM))
    return terms.where(F.length("term") >= 2).select("term", F.explode(F.array_distinct(own)).alias("gram"))


def postings(laws: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, law_id): of the wanted grams, the laws that hold each."""
    every = F.array_distinct(F.flatten(F.array(*[grams(_low(f), n) for f in FIELDS for n in (2, LONGEST_GRAM)])))
    return laws.select("law_id", F.explode(every).alias("gram")).join(broadcast_if_small(wanted.select("gram").distinct()), "gram", "left_semi")


def term_hits(terms: DataFrame, laws: DataFrame) -> DataFrame:
    """(law_id, law_name, term, number, title, tags, content, tag): where each law holds each term; pairs without any are no rows.

    tag: one of the law's tags is the term.  law_ids are unique.
    """
    asked = stash(term_grams(terms.select("term").distinct()), "law-terms")
    held = stash(postings(laws, asked), "law-postings")
    lengths = held.groupBy("gram").agg(F.count("*").alias("laws"))
    # a gram that no law holds leaves its term without any
    rarest = asked.join(lengths, "gram", "left").groupBy("term").agg(F.min(F.struct(F.coalesce("laws", F.lit(0)).alias("laws"), F.col("gram").alias("gram"))).alias("g"))
    found = rarest.where("g.laws > 0").select("term", F.col("g.gram").alias("gram")).join(held, "gram")
    # as many terms as the law's own text has room for
    asked_of = found.groupBy("law_id").agg(F.collect_list("term").alias("terms"))
    number, title, tags, content = (_low(f) for f in ("article_number", "article_title", "tags", "content"))
    names = F.transform(F.split(tags, ","), T.strip)

    def where(t: Column) -> Column:
        return F.struct(
            t.alias("term"), F.contains("_number", t).alias("number"), F.contains("_title", t).alias("title"), F.contains("_tags", t).alias("tags"), F.contains("_content", t).alias("content"),
            F.array_contains("_names", t).alias("tag"),
        )

    rows = laws.select("law_id", "law_name", number.alias("_number"), title.alias("_title"), tags.alias("_tags"), content.alias("_content"), names.alias("_names")).join(asked_of, "law_id")
    hits = F.filter(F.transform("terms", where), lambda h: h["number"] | h["title"] | h["tags"] | h["content"])
    return rows.select("law_id", "law_name", F.explode(hits).alias("h")).select("law_id", "law_name", "h.*")


def query_terms(queries: DataFrame) -> DataFrame:
    """(query, book, term, times, phrase): every word of two letters of a query, as often as it stands there, and its phrase; queries without words have no rows."""
    low = F.lower(F.coalesce("query", F.lit("")))
    words = F.filter(F.split(F.translate(low, ",.", "  "), r"\s+"), lambda w: F.length(w) >= 2)
    rows = queries.select("query", "book", words.alias("words"), T.strip(low).alias("whole")).where(F.size("words") > 0)
    single = rows.select("query", "book", F.explode("words").alias("term")).groupBy("query", "book", "term").agg(F.count("*").alias("times"))
    return single.withColumn("phrase", F.lit(False)).unionByName(rows.select("query", "book", F.col("whole").alias("term"), F.lit(1).cast("long").alias("times"), F.lit(True).alias("phrase")))


def search(queries: DataFrame, laws: DataFrame, top: int = 5) -> DataFrame:
    """(query, book, law_id, score, place): the best `top` laws of each query (query, book), ties by law_id; of the book alone where one is named.

    A phrase in the title counts 20, in the tags 15, in the content 10; each word, as often as the query has it, 5 as a
    tag, 3 in number or title, 1 in the content.  Laws that score nothing are no rows.
    """
    asked = stash(query_terms(queries.select("query", "book").distinct()), "law-queries")
    n = lambda c: F.col(c).cast("int")
    points = F.when(F.col("phrase"), 20 * n("title") + 15 * n("tags") + 10 * n("content")).otherwise(
        F.col("times") * (5 * n("tag") + 3 * (F.col("number") | F.col("title")).cast("int") + n("content")))
    hits = term_hits(asked, laws)
    met = asked.join(hits, "term").where(F.col("book").isNull() | (F.col("book") == F.col("law_name")))
    scored = met.groupBy("query", "book", "law_id").agg(F.sum(points).cast("int").alias("score")).where("score > 0")
    return top_by(scored, ["query", "book"], F.desc("score"), "law_id", n=top, place="place")


# Names of tools, codes and messages of failures, texts where nothing is found.
TOOLS = ("search_laws", "get_law_article")
NO_METHOD, BAD_ARGUMENTS = -32601, -32602
NO_LAW = "Không tìm thấy điều khoản luật tương ứng."


def quoted_law(name: Column, number: Column, title: Column, content: Column) -> Column:
    return F.concat(name, F.lit(" - "), number, F.lit(": "), title, F.lit("\nNội dung: "), content)


def answer_calls(calls: DataFrame, laws: DataFrame) -> DataFrame:
    """(id, text, error_code, error_message, response) of calls (id, payload): JSON-RPC requests to the law tools, as JSON text.

    search_laws needs a query and may name a book, get_law_article needs both of a law's names; an argument that is
    missing or empty is answered with -32602, a tool or a method that isn't there with -32601.  tools/list names the
    tools.  A payload that isn't JSON is a call of no method.  A tool whose name occurs in no call costs no search.
    """
    shape = "struct<method:string,params:struct<name:string,arguments:struct<query:string,law_name:string,article_number:string>>>"
    p = F.from_json("payload", shape)
    rows = calls.select("id", p["method"].alias("method"), p["params"]["name"].alias("name"), p["params"]["arguments"].alias("a"))
    given = lambda c: F.nullif(F.col(f"a.{c}"), F.lit(""))
    rows = rows.select("id", "method", "name", given("query").alias("query"), given("law_name").alias("book"), given("article_number").alias("article_number"))
    called = F.col("method") == "tools/call"
    asked = rows.where(called & (F.col("name") == TOOLS[0]) & F.col("query").isNotNull())
    quote = quoted_law(F.col("law_name"), F.col("article_number"), F.col("article_title"), F.col("content"))
    best = search(asked, laws).join(laws.select("law_id", quote.alias("quote")), "law_id")
    best = best.groupBy("query", "book").agg(ordered_text(F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] "), F.col("quote")), "\n\n", "place").alias("found"))
    one = top_by(laws, ["law_name", "article_number"], "law_id").select(F.col("law_name").alias("book"), "article_number", quote.alias("article"))
    # the search's key may hold a null, which an equality would lose
    key = lambda df: df.withColumn("_key", F.to_json(F.struct("query", "book")))
    rows = key(rows).join(key(best).select("_key", "found"), "_key", "left").join(one, ["book", "article_number"], "left")
    none = F.concat(F.lit("Không tìm thấy điều luật "), F.col("article_number"), F.lit(" của "), F.col("book"), F.lit("."))
    search_call, article_call = called & (F.col("name") == TOOLS[0]), called & (F.col("name") == TOOLS[1])
    lacks = search_call & F.col("query").isNull() | article_call & (F.col("book").isNull() | F.col("article_number").isNull())
    known = F.coalesce(search_call, F.lit(False)) | F.coalesce(article_call, F.lit(False)) | F.coalesce(F.col("method") == "tools/list", F.lit(False))
    code = F.when(~known, NO_METHOD).when(lacks, BAD_ARGUMENTS)
    message = (
        F.when(~F.coalesce(called, F.lit(False)) & ~known, F.concat(F.lit("Method '"), F.coalesce("method", F.lit("None")), F.lit("' not found")))
        .when(~known, F.concat(F.lit("Tool '"), F.coalesce("name", F.lit("None")), F.lit("' not found")))
        .when(lacks & search_call, "Missing 'query' argument").when(lacks, "Missing 'law_name' or 'article_number' argument")
    )
    text = F.when(code.isNotNull(), None).when(search_call, F.coalesce("found", F.lit(NO_LAW))).when(article_call, F.coalesce("article", none)).otherwise(F.lit(",".join(TOOLS)))
    rows = rows.select("id", text.alias("text"), code.alias("error_code"), message.alias("error_message"))
    error = F.when(F.col("error_code").isNotNull(), F.struct(F.col("error_code").alias("code"), F.col("error_message").alias("message")))
    content = F.when(F.col("error_code").isNull(), F.struct(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("content")))
    response = F.to_json(F.struct(F.lit("2.0").alias("jsonrpc"), content.alias("result"), error.alias("error"), "id"))
    return rows.select("id", "text", "error_code", "error_message", response.alias("response"))
