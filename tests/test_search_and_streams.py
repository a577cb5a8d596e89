"""Law search by its index, calls, typed answers, payloads, access groups and resumable counts, against brute force and by hand."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

LAWS = "law_id long, law_name string, article_number string, article_title string, tags string, content string"


def score(query, law):
    """The rule for one pair, as it is told."""
    words = [w for w in query.lower().replace(",", " ").replace(".", " ").split() if len(w) >= 2]
    _, _, number, title, tags, content = ((x or "").lower() if k else x for k, x in enumerate(law))
    if not words:
        return 0
    phrase = query.lower().strip()
    found = 20 * (phrase in title) + 15 * (phrase in tags) + 10 * (phrase in content)
    for w in words:
        found += 5 * (w in [t.strip() for t in tags.split(",")]) + 3 * (w in number or w in title) + (w in content)
    return found


def test_law_search_is_that_of_all_pairs(spark):
    from pactum.operators import law_index, text_ops

    rng = random.Random(3)
    pool = ["phạt", "vi", "phạm", "hợp", "đồng", "a", "ab", "abc", "abcd", "bcd", "x.y", "Điều", "𝒳z", "thử việc"] + [f"w{k}" for k in range(40)]
    text = lambda n: " ".join(rng.choice(pool) for _ in range(rng.randrange(n)))
    laws = [(k, f"Law {k % 3}", f"Điều {k}", text(5), None if k % 7 == 0 else ", ".join(rng.choice(pool) for _ in range(k % 4)), text(30)) for k in range(120)]
    queries = [text(5) for _ in range(60)] + ["", " ", "a", "a.b", "AB,", "phạt vi phạm", "Phạt  vi", "nothing here", "ab ab ab", " abc ", "'", "%", "..", "thử việc"]
    table = spark.createDataFrame(laws, LAWS).repartition(4)
    asked = spark.createDataFrame([(q, b) for q in queries for b in (None, "Law 1", "No law")], "query string, book string")
    expected = []
    for q in set(queries):
        for book in (None, "Law 1", "No law"):
            found = sorted((-s, law[0]) for law in laws if (book is None or law[1] == book) and (s := score(q, law)) > 0)
            expected += [(q, str(book), i, -s, place) for place, (s, i) in enumerate(found[:5], 1)]
    got = law_index.search(asked, table)
    assert sorted((r["query"], str(r["book"]), r["law_id"], r["score"], r["place"]) for r in got.collect()) == sorted(expected)
    assert text_ops.law_search(asked.where("false"), table).count() == 0 and law_index.search(asked, table.where("false")).count() == 0


def test_law_search_plan_and_size(spark):
    """No pair of a query and a law that share no word is made: 20,000 queries over 20,000 laws, each with one of its own."""
    from pactum.operators import law_index

    n = 20_000
    laws = spark.range(n).selectExpr("id AS law_id", "'L' AS law_name", "concat('No ', id) AS article_number", "'title' AS article_title", "cast(null as string) AS tags", "concat('content of word', id * 7919 % 1000003, 'x') AS content")
    queries = spark.range(n).selectExpr("concat('word', id * 7919 % 1000003, 'x') AS query", "cast(null as string) AS book")
    found = law_index.search(queries, laws)
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert found.count() == n and found.where("score = 11").count() == n


def test_calls(spark):
    from pactum.operators import law_index

    laws = spark.createDataFrame([(1, "Civil", "Điều 1", "Phạt vi phạm", "phạt", "Mức phạt"), (2, "Civil", "Điều 2", "Khác", None, "none"), (3, "Labor", "Điều 1", "Thử việc", None, "phạt")], LAWS)
    call = lambda name, **a: json.dumps({"method": "tools/call", "params": {"name": name, "arguments": a}})
    one, three = "Civil - Điều 1: Phạt vi phạm\nNội dung: Mức phạt", "Labor - Điều 1: Thử việc\nNội dung: phạt"
    told = {
        call("search_laws", query="phạt"): (f"[1] {one}\n\n[2] {three}", None), call("search_laws", query="phạt", law_name="Labor"): (f"[1] {three}", None),
        call("search_laws", query="zz"): (law_index.NO_LAW, None), call("search_laws"): (None, -32602), call("search_laws", query="", law_name="Labor"): (None, -32602),
        call("get_law_article", law_name="Labor", article_number="Điều 1"): (three, None), call("get_law_article", law_name="Labor", article_number="Điều 9"): ("Không tìm thấy điều luật Điều 9 của Labor.", None),
        call("get_law_article", law_name="Labor"): (None, -32602), call("other"): (None, -32601), '{"method": "tools/call"}': (None, -32601), '{"method": "x"}': (None, -32601), "{": (None, -32601), "": (None, -32601),
        '{"method": "tools/list"}': ("search_laws,get_law_article", None),
    }
    df = spark.createDataFrame(list(enumerate(told)), "id long, payload string")
    got = {r["id"]: r for r in law_index.answer_calls(df, laws).collect()}
    assert {k: (r["text"], r["error_code"]) for k, r in got.items()} == dict(enumerate(told.values()))
    assert json.loads(got[0]["response"]) == {"jsonrpc": "2.0", "result": {"content": [{"type": "text", "text": f"[1] {one}\n\n[2] {three}"}]}, "id": 0}
    assert json.loads(got[3]["response"]) == {"jsonrpc": "2.0", "error": {"code": -32602, "message": "Missing 'query' argument"}, "id": 3}
    assert {got[k]["error_message"] for k in (8, 9, 10, 11)} == {"Tool 'other' not found", "Tool 'None' not found", "Method 'x' not found", "Method 'None' not found"}


def test_typed_answers(spark):
    """What Python's truth and str() make of a model's answer; of keys that are equal in capitals the last counts."""
    from pactum.operators import text_ops

    answers = [
        '{"a": 0, "b": false, "c": [], "d": {}, "e": null, "f": "", "g": 0.0, "h": -0}', '{"a": 1, "b": true, "c": ["x", 1, true, null], "d": {"z": 1, "y": "q"}, "e": 1.50, "f": " ", "g": "[]", "h": "false", "i": 1e3}',
        '{"Key": "first", "KEY": "", "other": "", "OTHER": "last", "Other": "very last"}', '{"n": 12345678901234567890, "t": "đồng", "l": [[]], "s": "0"}', "no answer", "[1, 2]", None, "```json\n{\"x\": \"y\"}\n``` tail }",
    ]
    expected = []
    for k, a in enumerate(answers):
        try:
            found = json.loads(a if a and a.startswith("{") else '{"x": "y"}' if a and "```" in a else "{}")
        except ValueError:
            found = {}
        pairs = json.loads(a, object_pairs_hook=list) if k == 2 else list(found.items())
        expected += [(k, t, str(v), str(v).upper()) for t, v in {t.upper(): v for t, v in pairs}.items() if v]
    got = text_ops.model_entities(spark.createDataFrame(list(enumerate(answers)), "id long, answer string"))
    assert sorted((r["id"], r["entity_type"], r["entity_value"], r["normalized_value"]) for r in got.collect()) == sorted(expected)


def test_payloads(spark):
    from pactum.operators import audit

    told = [
        ("POST", "application/json", '{"password": "a", "x": {"secret": 1}, "n": "é"}', None, '{"password": "******", "x": {"secret": 1}, "n": "\\u00e9"}'),
        ("PUT", "application/json", '{"pass\\u0077ord": "a"}', "q=1", '{"password": "******"}'), ("POST", "application/json", "[1,2]", None, "[1, 2]"),
        ("POST", "application/json", "{", None, None), ("POST", "application/json", "", None, None), ("POST", "application/json", None, None, None),
        ("PATCH", "application/x-www-form-urlencoded", "a=1&secret=b&a=2&empty=", None, '{"a": ["1", "2"], "secret": ["******"], "empty": [""]}'),
        ("POST", "text/plain", "a=1", None, None), ("POST", None, "a=1", None, None), ("GET", "application/json", '{"a": 1}', "password=seen&x=1&x=2", '{"password": "seen", "x": "2"}'),
        ("GET", None, None, "", None), ("GET", None, None, None, None), ("HEAD", None, "a", "b=1", None), (None, None, None, None, None),
        ("POST", "application/json", json.dumps({"k": "z" * 5000}), None, ('{"k": "' + "z" * 5000)[:4000]),
    ]
    df = spark.createDataFrame([(k, *t[:4], None, "1.2.3.4") for k, t in enumerate(told)], "id long, method string, content_type string, body string, query string, forwarded_for string, remote_addr string")
    assert {r["id"]: r["payload"] for r in audit.mask_requests(df).collect()} == {k: t[4] for k, t in enumerate(told)}


def test_paths_and_sizes(spark):
    from pactum.functions import names as N
    from pactum.operators.common import broadcast_if_small

    paths = {"/media/a%20b+c%2B.pdf": "a b+c+.pdf", "100%zz%41%": "100%zzA%", "%": "%", "x%2": "x%2", "/media/%E1%BB%A3": "ợ"}
    df = spark.createDataFrame([(p,) for p in paths], "p string").select("p", N.media_path(F.col("p")).alias("m"))
    assert {r["p"]: r["m"] for r in df.collect()} == paths
    few = spark.range(3).select("id", F.repeat(F.lit("x"), 1000).alias("t"), F.array(F.lit("y")).alias("a"))
    hinted = lambda d: "broadcast" in d._jdf.queryExecution().logical().toString().lower() or "hint" in d._jdf.queryExecution().logical().toString().lower()
    assert hinted(broadcast_if_small(few)) and not hinted(broadcast_if_small(few, 2000)) and hinted(broadcast_if_small(few.limit(0), 0))


def test_access_groups(spark):
    """Counts and lists against every pair of users and contracts; an own company without a row counts too."""
    from pactum.operators import registry

    names = {k: f"Customer {k}" for k in range(1, 60)} | {3: "FPT one", 50: "big fpt vin", 4: "Techcom", 51: "TECHCOMBANK", 5: "Vin", 6: "viettel", 53: "Viettel Post fpt"}
    staff = {10: (3, False), 11: (4, False), 12: (5, False), 13: (6, False), 14: (1, False), 15: (None, False), 16: (99, False), 1: (7, True), 17: (50, False), 18: (53, False)}
    owned = {k: None if k % 10 == 0 else 99 if k % 37 == 1 else 1 + k % 58 for k in range(400)}
    brands = ("fpt", "techcom", "vin", "viettel")

    def sees(user, c):
        company, superuser = staff[user]
        same = any(b in names.get(company, "").lower() and b in names.get(c, "").lower() for b in brands)
        return superuser or company is None or c is None or company == c or same

    companies = spark.createDataFrame([*names.items()], "id long, company_name string")
    people = spark.createDataFrame([(k, f"user {k}", c, s) for k, (c, s) in staff.items()], "id long, user_name string, company_id long, is_superuser boolean")
    contracts = spark.createDataFrame([*owned.items()], "id long, company_id long")
    want = {u: {k for k, c in owned.items() if sees(u, c)} for u in staff}
    assert dict(map(tuple, registry.access_counts(people, companies, contracts).collect())) == {u: len(w) for u, w in want.items()}
    for u, w in want.items():
        assert sorted(r["id"] for r in registry.visible_contracts(contracts, companies, people, u).collect()) == sorted(w)
    assert registry.visible_contracts(contracts, companies, people, 77).count() == 0
    groups = {(r["user_id"], r["access"]) for r in registry.staff_groups(people, companies).collect()}
    assert {g for u, g in groups if u == 17} == {"company:50", "brand:fpt", "brand:vin"} and (1, "all") in groups and len(groups) < 3 * len(staff)


def test_tenant_scope_has_every_pair(spark):
    """Every pair of a user and a company that the user sees, each once, by the rule itself; the query gives them all."""
    from pactum.operators import registry
    from pactum.plans import catalog
    from pactum.sources.domain import Domain

    names = {k: f"Customer {k}" for k in range(1, 40)} | {3: "FPT one", 30: "big fpt vin", 4: "Techcom", 31: "VIN fpt Techcom", 5: None, 6: "viettel"}
    staff = [(10, 3, False), (11, 4, False), (12, 5, False), (13, None, False), (14, 99, False), (1, 7, True), (2, 99, True), (17, 30, False), (18, 31, None), (19, 6, False), (19, 6, False)]

    def sees(company, superuser, c):
        own = names.get(company) or ""
        return superuser or company is None or company == c or any(b in own.lower() and b in (names[c] or "").lower() for b in registry.BRANDS)

    companies = spark.createDataFrame([*names.items()], "id long, company_name string")
    people = spark.createDataFrame(staff, "id long, company_id long, is_superuser boolean")
    got = sorted(map(tuple, registry.visible_companies(people, companies).collect()))
    assert got == sorted((u, c) for u, company, superuser in staff for c in names if sees(company, superuser, c))
    data = "/root/testdata/sf0.001"
    stored, known = Domain(spark, data), {r["id"]: r["company_name"].lower() for r in Domain(spark, data)["company"].collect()}
    want = [
        (u["id"], c)
        for u in stored["staff"].collect()
        for c, name in known.items()
        if u["is_superuser"] or u["company_id"] is None or u["company_id"] == c or any(b in known.get(u["company_id"], "") and b in name for b in registry.BRANDS)
    ]
    assert sorted((r["user_id"], r["company_id"]) for r in catalog.QUERIES["tenant_scope"](spark, data).collect()) == sorted(want)


def test_tenant_scope_is_stored_in_little(spark, tmp_path, monkeypatch):
    """A pair takes a small part of a byte in a columnar file, with more users than a page has rows too; runs of any length give every pair, also of repeated and null ids."""
    from pactum.operators import registry

    companies = spark.range(1, 301).selectExpr("id", "concat('Customer ', id) AS company_name")
    people = spark.range(24_000).selectExpr("id * 7919 % 1000003 AS id", "CAST(NULL AS BIGINT) AS company_id", "false AS is_superuser")
    registry.visible_companies(people, companies).write.parquet(f"{tmp_path}/pairs")
    stored = spark.read.parquet(f"{tmp_path}/pairs")
    assert tuple(stored.selectExpr("count(*)", "count(DISTINCT user_id)", "sum(company_id)").first()) == (7_200_000, 24_000, 24_000 * 45_150)
    assert sum(f.stat().st_size for f in tmp_path.glob("pairs/*.parquet")) < 0.4 * 7_200_000
    names = [(k % 40, f"{('FPT', 'plain', 'vin Techcom', None)[k % 4]} {k}" if k % 4 < 3 else None) for k in range(70)] + [(None, "fpt"), (None, "none")]
    staff = [(k, (None, 4, 6, 1, 77)[k % 5], k % 7 == 0) for k in range(15)] + [(3, 1, None)]
    rows = [
        (u, c)
        for u, company, superuser in staff
        for own in ([n for c, n in names if c == company and c is not None] or [None])
        for c, n in names
        if superuser or company is None or (own is not None or company in dict(names)) and c == company or any(b in (own or "").lower() and b in (n or "").lower() for b in registry.BRANDS)
    ]
    for run, of in ((128, 8192), (3, 5), (1, 1)):
        monkeypatch.setattr(registry, "RUN", run)
        monkeypatch.setattr(registry, "LIST", of)
        got = registry.visible_companies(spark.createDataFrame(staff, "id long, company_id long, is_superuser boolean"), spark.createDataFrame(names, "id long, company_name string"))
        assert sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str)


def test_chain_stats_count_every_event(spark):
    """All totals against the stored tables: no transaction of the ledger is left out."""
    from pactum.plans import catalog

    data = "/root/testdata/sf0.001"
    ids = [r["event_id"] for r in spark.read.parquet(f"{data}/events.parquet").select("event_id").collect()]
    versions = [r["doc_id"] * 7 + 3 for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id").collect()]
    stored = [v for v in versions if v % 17]
    got = catalog.QUERIES["chain_stats"](spark, data).first().asDict()
    assert got == {
        "transactions": len(ids), "latest_block": 15000000 + max(k for k in ids if k % 3), "proofs": len(stored),
        "verified_proofs": sum(v % 4 == 1 for v in stored), "certificates": len(ids), "signatures": len(ids),
    }


@pytest.fixture
def at(tmp_path):
    return lambda name: str(tmp_path / name)


def test_counts_are_taken_up_again(spark, at):
    """Stopped half way, more files, started again, merged between: each row counts once, and states of past hours go."""
    from pactum.streaming import audit_stream as S

    schema = "ts timestamp, event_type string, value double"
    start = datetime.datetime(2024, 1, 1)
    rng = random.Random(4)
    hours = [[(start + datetime.timedelta(hours=h, minutes=rng.randrange(60)), rng.choice("abc"), 1.0) for _ in range(rng.randrange(20, 40))] for h in range(24)]
    # each hour also has rows of the one before, which are late but not too late
    parts = [hours[h] + [(t - datetime.timedelta(hours=1), e, v) for t, e, v in hours[h][:5]] for h in range(24)]
    expected = {}
    for t, e, _ in (r for p in parts for r in p):
        key = (t.replace(minute=0, second=0), e)
        expected[key] = expected.get(key, 0) + 1

    def put(some):
        for p in some:
            spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(at("in"))

    def count():
        return S.count_to(S.file_stream(spark, at("in"), "*.parquet", schema, files_a_batch=1), at("out"))

    def read():
        return {(r["hour"].replace(tzinfo=None), r["event_type"]): r["events"] for r in S.read_counts(spark, at("out")).collect()}

    assert read() == {}
    put(parts[:9])
    count()
    half = read()
    assert sum(half.values()) == sum(map(len, parts[:9]))
    # a run that fails in its first batch leaves what was there
    put(parts[9:12])
    good = S.audit_counts
    S.audit_counts = lambda events: good(events).withColumn("events", F.when(F.col("event_type") == "c", F.raise_error("stopped").cast("long")).otherwise(F.col("events")))
    try:
        with pytest.raises(Exception, match="stopped"):
            count()
    finally:
        S.audit_counts = good
    assert read() == half
    count()
    S.merge_counts(spark, at("out"))
    S.merge_counts(spark, at("out"))
    assert sum(read().values()) == sum(map(len, parts[:12]))
    put(parts[12:])
    progress = count()
    assert read() == expected
    S.merge_counts(spark, at("out"))
    assert read() == expected
    assert count() is not None and read() == expected
    # three hours of three types at most are kept, not all that were counted
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]) <= 15


def test_model_boundary(spark):
    """Answers where there are any, the fallback for open prompts and for batches that fail."""
    from pactum.functions import model

    def shouting():
        """Stands for a model host: it answers in capitals, leaves some prompts open and fails on others."""

        def answer(prompts):
            if any("error" in p for p in prompts):
                raise ConnectionError("no model host")
            return [p.upper() if len(p) % 2 else "" for p in prompts]

        return answer

    fallback = F.concat(F.lit("rule: "), F.coalesce("p", F.lit("none")))
    rows = lambda some: spark.createDataFrame([(p,) for p in some], "p string")
    got = {r["p"]: r["answer"] for r in model.with_answers(rows(["abc", "ab", None, ""]), "p", shouting, fallback).collect()}
    assert got == {"abc": "ABC", "ab": "rule: ab", None: "rule: none", "": "rule: "}
    failed = model.with_answers(rows(["abc", "error"]).coalesce(1), "p", shouting, fallback)
    assert {r["p"]: r["answer"] for r in failed.collect()} == {"abc": "rule: abc", "error": "rule: error"}
    assert {r["answer"] for r in model.with_answers(rows(["abc"]), "p", None, fallback).collect()} == {"rule: abc"}


def test_model_boundary_asks_for_every_event(spark, tmp_path):
    """The registered query puts each prompt to its client, and each once more without one; a prompt that is null keeps its row."""
    from pactum.plans import catalog

    stored = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "event_type").collect()]
    stored += [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "an error")]
    spark.createDataFrame(stored, "event_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    want = []
    for k, kind in stored:
        p = None if kind is None else kind + "!" * (k % 3)
        rule = None if p is None else f"rule: {p}"
        want += [(k, p, p.upper() if p and "error" not in p and len(p) % 2 else rule), (-1 - k, p, rule)]
    got = [tuple(r) for r in catalog.QUERIES["model_boundary"](spark, str(tmp_path)).select("event_id", "prompt", "answer").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and any((a or "").isupper() for _, _, a in got)
