"""Registered queries against their SQL twins on the smallest tables."""

import datetime
import decimal
import re
from pathlib import Path

import duckdb
import pytest

from pactum.plans import catalog

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, bool | str) or v is None:
        return str(v)
    if isinstance(v, float | decimal.Decimal):
        return repr(round(float(v), 9))
    return v.isoformat(" ") if isinstance(v, datetime.datetime) else str(v)


@pytest.fixture(scope="module")
def other():
    c = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        c.sql(f"create view {f.stem} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_twin(spark, other, name):
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    twin = other.sql(catalog.ORACLES[name])
    assert sorted(twin.columns) == cols
    got = sorted(tuple(map(plain, r)) for r in df.select(*cols).collect())
    assert got == sorted(tuple(map(plain, r)) for r in twin.select(*cols).fetchall())


HEADER = re.compile(r"^((?:điều|dieu|article|section|clause)\s+(?:[IVXLCDM]+|\d+)(?:[\s.:‐\-–—].*)?)$", re.I | re.M)


def clauses_of(pages):
    merged, bounds = "", []
    for n, text in sorted(pages):
        bounds.append((n, len(merged)))
        merged += f"\0PAGE:{n}\0\n{text}\n"
    bare = lambda s: re.sub(r"\0PAGE:(\d+)\0", "", s).strip()
    page = lambda at: [n for n, o in bounds if o <= at][-1]
    heads = list(HEADER.finditer(merged))
    found = [("Phần mở đầu", bare(merged[: heads[0].start()]), 0)] if heads and len(bare(merged[: heads[0].start()])) > 10 else []
    for h, stop in zip(heads, [*(x.start() for x in heads[1:]), len(merged)], strict=False):
        found.append((h[1].strip(), bare(merged[h.end() : stop]), h.start()))
    found = found or [("Nội dung hợp đồng", bare(merged), 0)]
    last = max(n for n, _ in pages)
    return [(k + 1, t, b, page(at), page(found[k + 1][2]) if k + 1 < len(found) else last) for k, (t, b, at) in enumerate(found)]


@pytest.mark.parametrize("pages", [
    [(1, "Điều 1. Mục đích\nThân bài"), (2, "tiếp\nSECTION 2: Term\nbody"), (3, "Clause IV\nend")],
    [(1, "Preamble of the contract\nĐiều 3\nNội dung\nphần sau")],
    [(1, "0123456789\nArticle 1\nx")],
    [(1, "no header at all"), (2, "")],
    [(1, "section civil procedure\nbody"), (4, "dieu 2\r\nrest")],
])
def test_clause_split(spark, pages):
    from pactum.operators.text_ops import split_clauses

    df = spark.createDataFrame([(1, n, t) for n, t in pages], "doc_id long, page_number int, text string")
    got = sorted(tuple(r)[1:] for r in split_clauses(df).collect())
    assert got == clauses_of(pages)


def test_clauses_across_pages(spark):
    """Random documents whose headers stand at page ends, over two lines, or nowhere, against the rule on the joined pages."""
    import random

    from pactum.operators.text_ops import split_clauses

    rng = random.Random(12)
    lines = ["Điều 3", "Article IV", "SECTION 2: Term", "dieu", "clause", "7", "Clause 7x", "", " ", "body text", "thân bài", "Article\t9. x", "section civil law", "\r", "Điều 4\r", "x" * 30, "0123456789"]
    documents = {d: [(n, "\n".join(rng.choice(lines) for _ in range(rng.randrange(6)))) for n in sorted(rng.sample(range(1, 40), rng.randrange(1, 9)))] for d in range(150)}
    df = spark.createDataFrame([(d, n, t) for d, pages in documents.items() for n, t in pages], "doc_id long, page_number int, text string").repartition(5)
    got: dict = {}
    for r in split_clauses(df).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    assert {d: sorted(c) for d, c in got.items()} == {d: clauses_of(pages) for d, pages in documents.items()}
    assert split_clauses(df.where("false")).count() == 0


def test_clauses_of_a_very_long_document(spark):
    from pyspark.sql import functions as F

    from pactum.operators.text_ops import page_markers, split_clauses

    n = 100_000
    page = F.when(F.col("id") % 50 == 7, F.concat(F.lit("Điều "), F.col("id").cast("string"), F.lit(". Mục\nthân"))).otherwise(F.lit("trang chữ " * 20))
    df = spark.range(1, n + 1).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("page_number"), page.alias("text"))
    row = split_clauses(df).agg(F.count("*").alias("c"), F.max("end_page").alias("e"), F.sum(F.col("end_page") - F.col("start_page")).alias("s"), F.max("clause_no").alias("k")).first()
    assert tuple(row) == (2001, n, n - 1, 2001)
    assert page_markers(df).first()["max_page"] == n


def test_normalise(spark):
    from pactum.operators.text_ops import normalize_pages

    pages = [(1, n, f"CONFIDENTIAL DRAFT\n“Draft” copy\nthanh\ntoán xong.\nbên é a…\x07\n\n\n\n{n}\n- {n} -\nTrang {n}\n2024") for n in (1, 2, 3)]
    got = {r["page_number"]: r["text"] for r in normalize_pages(spark.createDataFrame(pages, "doc_id long, page_number int, text string")).collect()}
    # the quoted line differs once its quotes are plain, so it isn't taken for the repeated one
    assert got[1] == '"Draft" copy thanh toán xong.\nbên é a...'


def test_files(spark, tmp_path):
    import zipfile

    from pyspark.sql import functions as F

    from pactum.sources import files

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p('one')}{p(' ')}<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>{p('two')}</w:body></w:document>")
    assert files.docx_pages(spark, str(tmp_path / "a.docx")).first()["text"] == "one\na\tb\ntwo"
    (tmp_path / "b.txt").write_text("x\ny")
    assert files.text_pages(spark, str(tmp_path / "b.txt")).first()["text"] == "x\ny"
    sealed = spark.createDataFrame([(b"draft",)], "raw binary").withColumn("sealed", files.seal(F.col("raw"), "k"))
    row = sealed.select("sealed", files.unseal(F.col("sealed"), "k").alias("back")).first()
    assert len(row["sealed"]) == 33 and bytes(row["back"]) == b"draft"


def test_files_that_cannot_be_read(spark, tmp_path):
    """One bad file rejects itself and no other."""
    import io
    import zipfile

    from pactum.sources import files

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'

    def archive(name, content, cut=0):
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(name, content)
        return held.getvalue()[: len(held.getvalue()) - cut]

    good = f"<w:document {w}><w:body><w:p><w:r><w:t>fine</w:t></w:r></w:p></w:body></w:document>"
    told = {
        "a.docx": (archive("word/document.xml", good), "page", "fine"), "b.docx": (b"no zip", "reject", files.NO_ZIP), "c.docx": (archive("word/document.xml", good, 30), "reject", files.NO_ZIP),
        "d.docx": (archive("word/other.xml", good), "reject", files.NO_BODY), "e.docx": (archive("word/document.xml", "<w:broken"), "reject", files.NO_XML),
        "f.docx": (archive("word/document.xml", f"<w:document {w}/>"), "reject", files.NO_BODY), "g.docx": (b"", "reject", files.NO_ZIP),
        "h.txt": (b"ok \xff\xc3 end", "page", "ok  end"), "i.TXT": (b"", "page", ""), "j.pdf": (b"%PDF", "other", None), "k": (b"x", "reject", "Unsupported file type: none"),
    }
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for k, (name, (content, *_)) in enumerate(told.items()):
        (tmp_path / "in" / ("deep" if k % 2 else ".") / name).write_bytes(content)
    got = {r["path"].rsplit("/", 1)[1]: (r["kind"], r["text"] if r["kind"] == "page" else r["error"]) for r in files.read_documents(spark, str(tmp_path / "in")).collect()}
    # Spark's reader passes over files without a byte; as rows they have their kind
    assert got == {name: tuple(t[1:]) for name, t in told.items() if t[0]}
    empty = files.pages_of_files(spark.createDataFrame([(name, t[0]) for name, t in told.items() if not t[0]], "path string, content binary"))
    assert {r["path"]: r["kind"] for r in empty.collect()} == {"g.docx": "reject", "i.TXT": "page"}
    assert files.pages_of_files(spark.createDataFrame([("x.txt", None)], "path string, content binary")).first()["text"] == ""


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_scope_and_ledger_see_every_company(spark):
    """Against brute force in Python, on companies beyond any id bound and with all four brand words."""
    from pactum.operators import proofs, registry

    names = {k: f"Customer {k}" for k in range(1, 121)} | {3: "FPT one", 90: "big fpt", 4: "Techcom", 91: "TECHCOMBANK", 5: "Vin", 92: "vinhome", 6: "viettel", 93: "Viettel Post fpt"}
    staff = {10: (3, False), 11: (4, False), 12: (5, False), 13: (6, False), 14: (1, False), 15: (None, False), 27: (2, False), 1: (7, True), 16: (None, True)}
    companies = spark.createDataFrame([*names.items()], "id long, company_name string")
    people = spark.createDataFrame([(k, f"user {k}", c, s) for k, (c, s) in staff.items()], "id long, user_name string, company_id long, is_superuser boolean")
    brands = ("fpt", "techcom", "vin", "viettel")

    def sees(company, superuser, c):
        own = names.get(company, "").lower()
        return superuser or company is None or company == c or any(b in own and b in names[c].lower() for b in brands)

    contracts = spark.createDataFrame([(k, None if k % 10 == 0 else 1 + k % 120) for k in range(600)], "id long, company_id long")
    owned = [None if k % 10 == 0 else 1 + k % 120 for k in range(600)]
    counted = sorted((u, sum(c is None or sees(company, superuser, c) for c in owned)) for u, (company, superuser) in staff.items())
    assert sorted(map(tuple, registry.access_counts(people, companies, contracts).collect())) == counted
    keys = [f"COMPANY_{k}" for k in (0, 1, 49, 50, 51, 120, 121)] + ["USER_60", "7"]
    ledger = [(k, key, False, f"r{k}") for k, key in enumerate(keys)] + [(50, "COMPANY_0", False, "later"), (51, "USER_1", True, None)]
    taken = companies.selectExpr("concat('COMPANY_', id) AS record_key")
    got = sorted(tuple(r) for r in proofs.put_if_absent(spark.createDataFrame(ledger, "tx_id long, record_key string, is_delete boolean, record string"), taken).collect())
    assert got == sorted((key, k, f"r{k}") for k, key in enumerate(keys) if key not in {f"COMPANY_{k}" for k in names})


def test_audit_actions(spark):
    """Expected rows by hand: each rule, the order of rules, and contract codes."""
    from pactum.operators import audit

    told = [
        ("/login/", "POST", "Logged in successfully"), ("/login/", "GET", "Visited page: /login/"), ("/api/admin/users/7/delete/", "GET", "Admin request to delete user (ID: 7)"),
        ("/api/admin/config/ocr/", "POST", "Admin changed system OCR configuration"), ("/api/admin/config/ocr/", "GET", None), ("/api/contracts/", "GET", None),
        ("/api/contracts/5/analyze/", "POST", "Triggered AI analysis for contract: CON-5"), ("/api/contracts/6/analyze/", "POST", "Triggered AI analysis for contract (ID: 6)"),
        ("/contracts/5/detail/", "GET", "Viewed contract details: CON-5"), ("/contracts/6/detail/", "GET", "Visited page: /contracts/6/detail/"), ("/workflows/detail/5/", "GET", "Visited page: /workflows/detail/5/"),
        ("/contracts/5/review/x/approve/", "HEAD", "Submitted expert review for contract: CON-5"), ("/x/analyze/", "PATCH", "Performed PATCH request on /x/analyze/"), ("/" + "y" * 300, "GET", ("Visited page: /" + "y" * 300)[:100]),
        ("/contracts/99999999999999999999/analyze/", "GET", "Triggered AI analysis for contract (ID: 99999999999999999999)"),
    ]
    requests = spark.createDataFrame([(k, p, m, 200) for k, (p, m, _) in enumerate(told)] + [(90, "/login/", "POST", 404), (91, "/static/x", "GET", 200)], "id long, path string, method string, status_code int")
    got = {r["id"]: r["action"] for r in audit.classify(requests, spark.createDataFrame([(5, "CON-5")], "id long, contract_code string")).collect()}
    assert got == {k: a for k, (_, _, a) in enumerate(told)}


def test_titles_edges_and_serials(spark):
    """Findings against clauses, requested edges, certificate serials, paths and codes, by hand."""
    from pyspark.sql import functions as F

    from pactum.functions import names as N
    from pactum.operators import analyses, workflows

    findings = spark.createDataFrame([(1, 7, " Term "), (2, 7, None), (3, 7, "termination of contract"), (4, 8, "term")], "id long, version_id long, clause_title string")
    clauses = spark.createDataFrame([(10, 7, "TERM"), (11, 7, " "), (12, 7, "Long term lease"), (13, 9, "term")], "id long, version_id long, title string")
    assert rows(analyses.match_findings(findings, clauses)) == sorted((str(a), str(b)) for a, b in [(1, 10), (1, 12), (2, 11), (3, 10)])
    steps = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 2)], "id long, workflow_id long")
    have = spark.createDataFrame([(1, 2)], "prerequisite_id long, dependent_id long")
    asked = [(1, 1, 1, "self"), (1, 9, 1, "missing"), (1, 4, 1, "other workflow"), (2, 1, 1, "cycle"), (1, 2, 1, "known"), (2, 3, 1, "created"), (3, 1, 1, "created"), (1, 3, 2, "other workflow")]
    out = workflows.dependency_checks(spark.createDataFrame([a[:3] for a in asked], "prerequisite_id long, dependent_id long, workflow_id long"), steps, have)
    assert rows(out) == sorted(tuple(map(str, a)) for a in asked)
    text = spark.createDataFrame([("FPT Soft-ware Ltd", 12345, "/media/a%20b+c%2B.pdf", "CON/1 ằ_x-2", "4-NOT SPECIFIED")], "c string, id long, p string, code string, t string")
    row = text.select(N.certificate_serial(F.col("c"), F.col("id")), N.media_path(F.col("p")), N.safe_file_code(F.col("code")), N.title_case(F.col("t"))).first()
    assert re.fullmatch(r"CERT-FPT-SOFT-12345-[1-9][0-9]{3}", row[0]) and tuple(row)[1:] == ("a b+c+.pdf", "CON1ằ_x-2", "4-Not Specified")


def test_searches_and_pages(spark):
    from pyspark.sql import functions as F

    from pactum.operators import registry

    contracts = spark.createDataFrame([(1, "C-1", "Rent of Land", "DRAFT"), (2, None, "x", "APPROVED"), (3, "draft-7", None, "ANALYZED")], "id long, contract_code string, title string, status string")
    found = lambda t: sorted(r["id"] for r in registry.contract_search(contracts, t).collect())
    assert (found("DRAFT"), found(""), found("nothing"), found("land")) == ([1, 3], [1, 2, 3], [], [1])
    ids = spark.range(25)
    page = lambda n: [(r["id"], r["pages"]) for r in registry.page_of(ids, n, F.asc("id")).collect()]
    assert page(3) == [(k, 3) for k in range(20, 25)] and page(4) == []
    assert registry.page_of(ids.limit(0), 1, F.asc("id")).count() == 0
    with pytest.raises(ValueError, match="count from 1"):
        registry.page_of(ids, 0, F.asc("id"))
    with pytest.raises(ValueError, match="unknown order"):
        registry.history_page(ids, "best")


def test_files_of_all_kinds(spark, tmp_path):
    """Kinds, sizes in bytes and rejects of files; blocks that are none give nulls."""
    from pyspark.sql import functions as F

    from pactum.operators import proofs
    from pactum.sources import files

    (tmp_path / "a.TXT").write_bytes(b"x" * 2_000_000)
    (tmp_path / "b.exe").write_text("no")
    (tmp_path / "c").write_text("none")
    good, bad = files.document_files(spark, str(tmp_path))
    assert [(r["file_type"], r["mime"], r["size_mb"], len(r["content"])) for r in good.collect()] == [("txt", "text/plain", 1.91, 2_000_000)]
    assert sorted(r["error"] for r in bad.collect()) == ["Unsupported file type: .exe", "Unsupported file type: none"]
    odd = spark.createDataFrame([(b"",), (b"\x0b\x00",), (None,), (b"\x0a\x05\x08",)], "block binary").select(proofs.parse_block(F.col("block")).alias("h"))
    assert all(r["h"]["number"] is None for r in odd.collect())


def test_small_letters_class(spark):
    """A line break goes before the listed letters only."""
    from pyspark.sql import functions as F

    from pactum.functions import text as T

    df = spark.createDataFrame([("a\nắ",), ("a\nằ",), ("a.\nb",), ("a\nB",)], "t string").select(F.regexp_replace("t", T.SOFT_BREAK, " ").alias("t"))
    assert [r["t"] for r in df.collect()] == ["a ắ", "a\nằ", "a.\nb", "a\nB"]
