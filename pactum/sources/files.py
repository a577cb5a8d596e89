"""File sources and sinks: text and word-processor files as pages, sealed files, document JSON."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Kinds of files by extension, and their media types.
FILE_TYPES = {".docx": "docx", ".pdf": "pdf", ".png": "image", ".jpg": "image", ".jpeg": "image", ".txt": "txt"}
MEDIA_TYPES = {
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".pdf": "application/pdf", ".png": "image/png",
    ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".txt": "text/plain", ".html": "text/html",
}
PAGES = "path string, page_number int, text string, source string, confidence double"


def _known(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1))


def with_kinds(files: DataFrame, path: str = "path", size: str = "length") -> DataFrame:
    """ext, file_type (null if it can't be read), mime and size_mb (two places) beside the columns of files; size in bytes."""
    ext = extension(F.col(path))
    mime = F.coalesce(_known(MEDIA_TYPES, ext), F.lit("application/octet-stream"))
    return files.withColumns({"ext": ext, "file_type": _known(FILE_TYPES, ext), "mime": mime, "size_mb": F.round(F.col(size) / 1048576.0, 2)})


def document_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Files below a path with their kinds and contents, and those of no kind that can be read, without contents, with an error."""
    every = with_kinds(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))
    told = F.concat(F.lit("Unsupported file type: "), F.coalesce(F.nullif("ext", F.lit("")), F.lit("none")))
    return every.where("file_type is not null"), every.where("file_type is null").select("path", "ext", "length", told.alias("error"))


#: What reading a file gives: pages, or why there are none.
READ = "path string, kind string, page_number int, text string, source string, confidence double, error string"
# Kinds of rows, and what is wrong with a file.
PAGE_ROW, REJECT_ROW, OTHER_ROW = "page", "reject", "other"
NO_ZIP, NO_BODY, NO_XML = "Not a word-processor file: no zip archive", "Not a word-processor file: no document part", "Not a word-processor file: broken document part"
UNREADABLE = "File can't be opened"


def _docx_text(blob: bytes) -> str:
    """Paragraphs and table rows in document order, cells joined by tabs, blanks left out; ValueError with what is wrong."""
    import io
    import zipfile
    import zlib
    from xml.etree import ElementTree

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    words = lambda node: "".join(t.text or "" for t in node.iter(f"{w}t")).strip()
    try:
        part = zipfile.ZipFile(io.BytesIO(blob)).read("word/document.xml")
    except KeyError:
        raise ValueError(NO_BODY) from None
    except (zipfile.BadZipFile, zlib.error, EOFError, OSError, NotImplementedError, RuntimeError, ValueError):
        raise ValueError(NO_ZIP) from None
    try:
        body = ElementTree.fromstring(part).find(f"{w}body")
    except ElementTree.ParseError:
        raise ValueError(NO_XML) from None
    if body is None:
        raise ValueError(NO_BODY)
    lines = []
    for node in body:
        if node.tag == f"{w}p":
            lines.append(words(node))
        elif node.tag == f"{w}tbl":
            lines += ["\t".join(c for c in (words(cell) for cell in row.iter(f"{w}tc")) if c) for row in node.iter(f"{w}tr")]
    return "\n".join(x for x in lines if x)


def file_kind(path: str | None) -> str | None:
    """Kind of a file by its path's ending; None for one that nobody reads."""
    return FILE_TYPES.get(_ending(path))


def _ending(path: str | None) -> str:
    import re

    found = re.search(r"\.[A-Za-z0-9]+\Z", path or "")
    return found[0].lower() if found else ""


def read_file(path: str | None, content) -> dict:
    """One row of READ for a file; content() gives its bytes and is called for texts and word-processor files only."""
    kind, page, error = file_kind(path), None, None
    try:
        if kind is None:
            error = f"Unsupported file type: {_ending(path) or 'none'}"
        elif kind == "txt":
            page = content().decode("utf-8", "ignore")
        elif kind == "docx":
            page = _docx_text(content())
    except ValueError as wrong:
        error = str(wrong)
    except OSError as wrong:
        error = f"{UNREADABLE}: {type(wrong).__name__}"
    if page is None:
        return {"path": path, "kind": REJECT_ROW if error else OTHER_ROW, "error": error}
    return {"path": path, "kind": PAGE_ROW, "page_number": 1, "text": page, "source": "native", "confidence": 1.0}


def read_schema():
    """READ as an Arrow schema."""
    import pyarrow as pa

    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in READ.split(", "))])


def pages_of_files(files: DataFrame) -> DataFrame:
    """Each file (path, content) as rows of one pass: a page for a text or word-processor file, a reject with an error for one
    that can't be read, and for pictures and PDF files, whose readers are elsewhere, a row of kind other.

    Kinds go by the path's ending alone.  Texts are UTF-8 and bytes that aren't are left out, so no text is rejected; a
    null content is an empty file.  A broken archive, a missing or broken part rejects its file and no other.
    """

    def read(batches):
        import pyarrow as pa

        schema = read_schema()
        for batch in batches:
            paths, contents = batch.columns
            for k in range(len(batch)):
                # one file at a time, so a batch of large files doesn't stand in memory twice
                row = read_file(paths[k].as_py(), lambda k=k: contents[k].as_py() or b"")  # noqa: B023
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    known = with_kinds(files.withColumn("length", F.octet_length("content")))
    return known.select("path", F.when(F.col("file_type").isin("txt", "docx"), F.col("content")).alias("content")).mapInArrow(read, READ)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """All files below a path (of any store that Spark reads) as pages_of_files gives them, dealt to tasks by their bytes.

    Spark's reader passes over files without a byte and files beyond 2 GB end its job; the data source of document_source
    takes both, where Arrow reads the store.
    """
    return pages_of_files(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content"))


def text_pages(spark: SparkSession, path: str) -> DataFrame:
    """One page per text file, with confidence 1."""
    return read_documents(spark, path).where(F.col("kind") == PAGE_ROW).select("path", "page_number", "text", "source", "confidence")


def docx_pages(spark: SparkSession, path: str) -> DataFrame:
    """One page per .docx file: paragraphs and table rows in document order, cells joined by tabs, blanks left out; files that can't be read give none."""
    return text_pages(spark, path)


def seal(content: Column, key: str) -> Column:
    """AES-256-GCM under the SHA-256 of the key: nonce, cipher text, tag."""
    return F.aes_encrypt(content, F.unhex(F.sha2(F.lit(key), 256)), F.lit("GCM"))


def unseal(content: Column, key: str) -> Column:
    return F.aes_decrypt(content, F.unhex(F.sha2(F.lit(key), 256)), F.lit("GCM"))


def document_json(pages: DataFrame, clauses: DataFrame) -> DataFrame:
    """doc_id, file_name, pages, clauses: one row per document, nested and in order."""
    p = pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_number", "text"))).alias("pages"))
    c = clauses.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("clause_no", "title", "body", "start_page", "end_page"))).alias("clauses"))
    return p.join(c, "doc_id", "left").withColumn("file_name", F.concat(F.col("doc_id").cast("string"), F.lit("_processed.json")))


def write_document_json(pages: DataFrame, clauses: DataFrame, path: str) -> None:
    document_json(pages, clauses).write.json(path)


def read_document_json(spark: SparkSession, path: str) -> DataFrame:
    schema = """doc_id long, file_name string, pages array<struct<page_number: int, text: string>>,
        clauses array<struct<clause_no: int, title: string, body: string, start_page: int, end_page: int>>"""
    return spark.read.schema(schema).json(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that all machines see: spark.checkpoint.dir; where that is unset the warehouse, or on one machine a temporary folder."""
    import tempfile
    import uuid

    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        at = f"file://{tempfile.gettempdir()}" if spark.sparkContext.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir")
    return noted(f"{at.rstrip('/')}/pactum-core/{name}-{uuid.uuid4().hex}")


#: Paths made inside scratch(), by thread; None outside of it.
_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def noted(path: str) -> str:
    """`path`, marked for removal at the end of the scratch() it was made in, if any."""
    if (made := _SCRATCH.get()) is not None:
        made.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that operators put in the shared folder inside this block are removed at its end, also when it fails.

    Results are lazy and read those tables: write what is to stay before the block ends.  Blocks may be nested; each
    removes its own.  Tables of other threads stay.

        with scratch(spark):
            proofs.verify_proofs(documents, stored, transactions).write.parquet(out)
    """
    made: list[str] = []
    token = _SCRATCH.set(made)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for path in made:
            remove(spark, path)


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _folder(spark, path)
    return fs.exists(at)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what stands in a folder."""
    fs, at = _folder(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table or folder that nothing reads any more."""
    fs, at = _folder(spark, path)
    fs.delete(at, True)
