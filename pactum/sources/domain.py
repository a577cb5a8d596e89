"""Domain tables as projections of the stored tables, and queries over them in SQL that two engines read alike.

A query names its inputs as {table}.  In Spark each is a DataFrame (lazy, so
Catalyst sees one plan down to the Parquet scan); a twin for another SQL engine
has the domain tables as common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: name -> SELECT over {stored} or {domain} tables
DOMAIN = {
    "company": """SELECT c_custkey AS id,
        concat(CASE c_custkey % 40 WHEN 3 THEN 'FPT ' WHEN 4 THEN 'Techcom ' WHEN 5 THEN 'VIN ' WHEN 6 THEN 'viettel ' ELSE '' END, c_name) AS company_name,
        CASE WHEN c_custkey % 13 = 0 THEN '' ELSE concat(c_mktsegment, '-', c_custkey % 97) END AS tax_code FROM {customer}""",
    "contract": """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 31 <> 0 THEN o_custkey END AS company_id, concat('CON-', o_orderkey) AS contract_code,
        concat(o_orderpriority, ' agreement ', o_orderkey % 100) AS title, o_orderpriority AS contract_type,
        CAST(o_orderdate AS DATE) AS start_date, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 12 * 30 AS INT) END AS end_date,
        CAST(CASE WHEN o_orderkey % 50 = 0 THEN 0 ELSE o_totalprice END AS DECIMAL(18, 2)) AS contract_value,
        CASE o_orderstatus WHEN 'O' THEN 'DRAFT' WHEN 'P' THEN 'ANALYZED' ELSE 'APPROVED' END AS status, o_orderdate AS created_at FROM {orders}""",
    "version": "SELECT DISTINCT l_orderkey * 8 + l_linenumber AS id, l_orderkey AS contract_id, l_linenumber AS version_number FROM {lineitem}",
    "rule": "SELECT p_partkey AS id, p_name AS rule_name, p_brand AS description, CASE p_partkey % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM {part}",
    "finding": """SELECT (l_partkey * 7919 + l_suppkey * 31 + l_orderkey) % 1000003 AS id, l_orderkey * 8 + l_linenumber AS version_id, l_partkey AS rule_id, CAST(floor(l_quantity * 2) AS INT) AS risk_score,
        CASE WHEN round(l_discount * 100) < 1 THEN 'NONE' WHEN round(l_discount * 100) < 4 THEN 'LOW' WHEN round(l_discount * 100) < 8 THEN 'MEDIUM'
             WHEN round(l_discount * 100) < 10 THEN 'HIGH' ELSE 'CRITICAL' END AS severity FROM {lineitem}""",
    "analysis": """SELECT version_id, count(*) AS findings, CAST(floor(coalesce(avg(CASE WHEN severity <> 'NONE' THEN risk_score END), 0)) AS INT) AS overall_score
        FROM {finding} GROUP BY version_id""",
    "staff": """SELECT s_suppkey AS id, s_name AS user_name, CASE WHEN s_suppkey % 10 <> 3 THEN s_nationkey END AS company_id, s_suppkey % 13 AS role_id,
        s_suppkey % 13 = 1 AS is_superuser FROM {supplier}""",
    "role": """SELECT * FROM (VALUES (1, 'ADMIN'), (2, 'MANAGER'), (3, 'STAFF'), (4, 'LEGAL'), (5, 'MANAGER_APPROVAL'), (6, 'FINANCE'), (7, 'TECHNICAL'),
        (8, 'SECURITY'), (9, 'COMPLIANCE'), (10, 'PROCUREMENT'), (11, 'EXECUTIVE')) AS r(id, role_name)""",
    "step": """SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey AS workflow_id, CAST(l_linenumber AS INT) AS step_order, max(l_partkey % 11 + 1) AS role_id,
        CASE max(l_linenumber % 4) WHEN 0 THEN 'Phê duyệt cấp quản lý' WHEN 1 THEN 'Rà soát dự thảo' WHEN 2 THEN 'Security Review' ELSE 'Ký kết hợp đồng' END AS step_name,
        CASE max(l_returnflag) WHEN 'A' THEN 'APPROVED' WHEN 'R' THEN 'REJECTED' ELSE 'PENDING' END AS status, concat('about step ', l_linenumber) AS description
        FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "workflow": "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'IN_PROGRESS' WHEN 'P' THEN 'PENDING' ELSE 'COMPLETED' END AS status, o_orderpriority AS workflow_type FROM {orders}",
    "dependency": "SELECT a.id AS prerequisite_id, b.id AS dependent_id, a.workflow_id FROM {step} a JOIN {step} b ON a.workflow_id = b.workflow_id AND b.step_order = a.step_order + 1",
    # events of a workflow's steps in order of id; some name a step that isn't there, or ask for nothing known
    "approval": """SELECT event_id AS id, user_id % 300 + 1 AS workflow_id, (user_id % 300 + 1) * 8 + event_id % 6 + 1 AS step_id, user_id,
        CASE event_type WHEN 'purchase' THEN 'FORCE_COMPLETE' WHEN 'click' THEN 'FORCE_COMPLETE' WHEN 'error' THEN 'REJECTED' WHEN 'signup' THEN 'LATER' ELSE 'APPROVED' END AS status,
        CASE WHEN event_id % 4 <> 0 THEN event_type ELSE '' END AS comment, ts AS approved_at FROM {events}""",
    "signing_key": """SELECT event_id AS id, user_id % 40 AS company_id, CAST(event_id % 9 AS INT) AS key_version,
        CASE event_id % 3 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'ROTATED' ELSE 'REVOKED' END AS status FROM {events} WHERE user_id % 40 <> 7 OR event_id % 3 <> 0""",
    # a contract's versions lie apart, contracts' ids interleave, and some numbers are left out
    "document": """SELECT version_id, contract_id, version_number + CASE WHEN version_number > 2 AND contract_id % 3 = 0 THEN 1 ELSE 0 END AS version_number,
        concat('CON-', contract_id) AS contract_code, CASE WHEN version_id % 4 <> 1 THEN concat('change ', version_id % 9) END AS change_summary, content
        FROM (SELECT doc_id * 7 + 3 AS version_id, CAST(floor(doc_id / 8) AS BIGINT) * 2 + doc_id % 2 AS contract_id, CAST(floor(doc_id % 8 / 2) AS BIGINT) + 1 AS version_number,
            CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 13 <> 1 THEN text END AS content FROM {documents}) d""",
    # each version's content and code, and those of its contract's version before
    "proof": """SELECT d.*, p.version_id AS previous_version_id, p.content AS previous_content, p.contract_code AS previous_code, p.version_number AS previous_number,
        p.change_summary AS previous_change FROM {document} d LEFT JOIN {document} p ON p.contract_id = d.contract_id AND p.version_number = d.version_number - 1""",
    "law": """SELECT item_id AS law_id, concat('Law ', item_id % 5) AS law_name, concat('Article ', item_id) AS article_number, substring(text, 1, 24) AS article_title, text AS content,
        CASE item_id % 3 WHEN 0 THEN 'phạt vi phạm, penalty' WHEN 1 THEN 'thử việc' END AS tags FROM {benchmark}""",
    "clause": """SELECT conv_id * 1000 + turn AS id, conv_id AS version_id, CASE WHEN turn % 5 = 4 THEN '' ELSE concat(' Clause ', turn % 3, ' ') END AS title,
        CASE turn % 4 WHEN 0 THEN 'TERM' WHEN 1 THEN 'PAYMENT' WHEN 2 THEN 'LIABILITY' END AS clause_type,
        concat(text, CASE turn % 7 WHEN 0 THEN ' Bên A and the Client agree' WHEN 1 THEN ' late payment penalty' WHEN 2 THEN ' Landlord: bên cho thuê' WHEN 3
            THEN ' TECHVIBE exclusivity'
            WHEN 4 THEN ' tranh chấp tại Tòa án' WHEN 5 THEN ' bản quyền, nhà tư vấn' ELSE ' thử việc' END) AS content FROM {conversations}""",
    # every kind of path that the audit log tells apart, by every kind of method
    "request": """SELECT event_id AS id, user_id, ts AS created_at,
        CASE event_id % 26 WHEN 0 THEN '/login/' WHEN 1 THEN '/logout/' WHEN 2 THEN concat('/api/admin/users/', user_id, '/delete/') WHEN 3 THEN
            concat('/api/contracts/', user_id, '/analyze/')
            WHEN 4 THEN concat('/api/contracts/', user_id, '/review/') WHEN 5 THEN '/api/contracts/' WHEN 6 THEN '/identity/' WHEN 7 THEN '/workflows/'
            WHEN 8 THEN concat('/workflows/steps/', user_id, '/approve/') WHEN 9 THEN '/static/app.js' WHEN 10 THEN concat('/contracts/', user_id, '/detail/')
                WHEN 11 THEN concat('/api/other/', event_id % 7, '/')
            WHEN 12 THEN '/admin-dashboard/' WHEN 13 THEN concat('/api/admin/users/', user_id, '/retry/') WHEN 14 THEN '/api/admin/config/ocr/' WHEN 15 THEN '/api/contracts/list/'
            WHEN 16 THEN '/api/companies/' WHEN 17 THEN '/api/register-user/' WHEN 18 THEN concat('/workflows/detail/', user_id, '/') WHEN 19 THEN '/admin/rules/'
            WHEN 20 THEN concat('/contracts/', user_id + 100000000, '/analyze/') WHEN 21 THEN '/analyze/now' WHEN 22 THEN '/contracts/new/detail/' WHEN 23 THEN
                '/media/a.png' WHEN 24 THEN '/favicon.ico'
            ELSE '/api/admin/stats/' END AS path,
        CASE CAST(floor(event_id / 26) AS INT) % 4 WHEN 0 THEN 'POST' WHEN 1 THEN 'GET' WHEN 2 THEN 'DELETE' ELSE 'HEAD' END AS method, CASE WHEN event_id % 29
            = 0 THEN 404 ELSE 200 END AS status_code,
        CASE WHEN event_id % 4 = 0 THEN concat('10.0.0.', user_id % 250, ', 172.16.0.1') WHEN event_id % 4 = 1 THEN '' END AS forwarded_for,
            concat('192.168.1.', user_id % 250) AS remote_addr,
        CASE WHEN event_id % 3 = 0 THEN 'application/x-www-form-urlencoded' ELSE 'application/json' END AS content_type,
        CASE WHEN event_id % 3 = 0 THEN concat('user=', user_id, '&', CASE event_id % 5 WHEN 0 THEN 'password' WHEN 1 THEN 'secret' ELSE 'note' END, '=p%20', event_id, '&tag=a&tag=b')
            WHEN event_id % 17 = 2 THEN 'no json' WHEN event_id % 17 = 4 THEN NULL
            ELSE concat(chr(123), '"user": ', user_id, ', "', CASE event_id % 5 WHEN 0 THEN 'password' WHEN 1 THEN 'password_hash' WHEN 2 THEN 'secret' ELSE 'note' END,
                '": "p', event_id, '", "inner": ', chr(123), '"secret": ', event_id % 10, chr(125), chr(125)) END AS body,
        CASE WHEN event_id % 2 = 0 THEN concat('q=a+b&page=', event_id % 10, '&q=last%26') END AS query
        FROM {events}""",
    "ledger": """SELECT event_id AS tx_id, concat(CASE event_id % 3 WHEN 0 THEN 'COMPANY_' WHEN 1 THEN 'USER_' ELSE '' END, user_id % 200) AS record_key, ts AS written_at,
        event_type = 'error' AS is_delete, CASE WHEN event_type <> 'error' THEN props END AS record FROM {events}""",
    # several analyses of a version, in time; some without a score
    "analysis_run": """SELECT (l_orderkey * 8 + l_linenumber) * 100000 + l_suppkey AS id, l_orderkey * 8 + l_linenumber AS version_id, concat('model-', l_suppkey % 3) AS model_name,
        CASE WHEN l_suppkey % 7 <> 0 THEN CAST(floor(max(l_quantity) * 2) AS INT) END AS overall_score, CASE WHEN max(l_quantity) >= 40 THEN 'HIGH' ELSE 'LOW' END AS risk_level,
        max(l_shipdate) AS created_at, concat('run of ', l_suppkey) AS summary FROM {lineitem} GROUP BY l_orderkey, l_linenumber, l_suppkey""",
    "run_finding": """SELECT (l_partkey * 7919 + l_suppkey * 31 + l_orderkey * 13 + l_linenumber) % 1000003 AS id, (l_orderkey * 8 + l_linenumber) * 100000 + l_suppkey AS analysis_id, l_partkey AS rule_id,
        CASE l_partkey % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM {lineitem}
        UNION ALL SELECT (l_partkey * 31 + l_orderkey) % 999983 + 2000000, (l_orderkey * 8 + l_linenumber) * 100000 + l_suppkey, l_partkey % 50 + 1, 'LOW' FROM {lineitem} WHERE l_orderkey % 3 = 0""",
    "clause_entity": """SELECT c.id AS clause_id, e.entity_type FROM {clause} c, (VALUES ('COMPANY_NAME'), ('DATE_EXPIRE'), ('PARTY')) AS e(entity_type) WHERE (c.id + length(e.entity_type)) % 3 <> 1""",
    "api_entity": """SELECT conv_id * 1000 + turn AS id, conv_id AS version_id,
        CASE turn % 4 WHEN 0 THEN 'clause 1' WHEN 1 THEN ' CLAUSE 2 of the annex' WHEN 2 THEN '' ELSE 'Clause' END AS clause_title,
        CASE turn % 3 WHEN 0 THEN 'DATE_EXPIRE' ELSE 'TAX_CODE' END AS entity_type, concat('v', turn % 2) AS entity_value, concat('V', turn % 2) AS normalized_value,
        CASE WHEN turn % 5 <> 3 THEN (turn % 10) / 10.0 END AS confidence FROM {conversations}""",
    "contract_file": """SELECT id * 4 AS id, id AS version_id, concat('/media/contracts/h%E1%BB%A3p+', id, '%20v1.pdf') AS file_path FROM {version}
        UNION ALL SELECT id * 4 + 1, id, concat('/media/contracts/second%2F', id, '.txt') FROM {version} WHERE id % 3 = 1
        UNION ALL SELECT id * 4 - 2, id, concat('elsewhere/', id, '%41.docx') FROM {version} WHERE id % 5 = 2""",
    "page_text": """SELECT conv_id * 1000 + turn AS id, conv_id AS version_id, CASE WHEN turn % 5 = 3 THEN 'note' ELSE 'raw_text' END AS context_type, text AS content
        FROM {conversations} WHERE conv_id % 3 = 0""",
    "file_text": "SELECT conv_id AS version_id, CASE WHEN max(conv_id) % 2 = 0 THEN concat('file of ', conv_id) ELSE '' END AS content FROM {conversations} WHERE conv_id % 3 = 1 GROUP BY conv_id",
    "api_finding": """SELECT conv_id * 1000 + turn AS id, conv_id AS version_id,
        CASE turn % 4 WHEN 0 THEN 'clause 1' WHEN 1 THEN ' CLAUSE 2 of the annex' WHEN 2 THEN '' ELSE 'Clause' END AS clause_title,
        CASE turn % 5 WHEN 0 THEN ' Small RING ' WHEN 1 THEN 'Late-payment risk!' WHEN 2 THEN 'late-payment RISK!' WHEN 3 THEN concat('Risk ', conv_id % 9)
            ELSE 'red widget' END AS risk_category,
        CASE turn % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM {conversations}""",
    "summary_event": """SELECT event_id AS id, user_id AS version_id, concat('summary ', event_type, ' ', event_id) AS summary,
        CASE WHEN event_id % 3 = 0 THEN concat('model-', event_id % 4) ELSE '' END AS model_id FROM {events}""",
    "review": """SELECT event_id AS id, user_id * 8 + 1 AS version_id,
        CASE event_id % 5 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'CRITICAL' END AS level, concat('comment ', event_id) AS comment FROM {events}""",
    "contract_event": """SELECT event_id AS id, user_id AS contract_id, ts AS happened_at, CASE event_type WHEN 'signup' THEN 'ANALYZE' WHEN 'view' THEN 'ANALYZED' WHEN 'click' THEN 'REVIEW'
        WHEN 'error' THEN 'FAILED' ELSE CASE WHEN event_id % 2 = 0 THEN 'NEW_VERSION' ELSE 'EXTRACT' END END AS action FROM {events}""",
    "workflow_run": "SELECT event_id AS id, user_id AS version_id, concat('WF_', upper(event_type)) AS workflow_type FROM {events} WHERE event_type <> 'error'",
    "edge_request": """SELECT prerequisite_id, dependent_id, workflow_id FROM {dependency} WHERE prerequisite_id % 3 = 0
        UNION ALL SELECT dependent_id, prerequisite_id, workflow_id FROM {dependency} WHERE prerequisite_id % 7 = 1
        UNION ALL SELECT id, id, workflow_id FROM {step} WHERE id % 11 = 2
        UNION ALL SELECT id, id + 16, workflow_id FROM {step} WHERE id % 13 = 3
        UNION ALL SELECT a.id, b.id, a.workflow_id FROM {step} a JOIN {step} b ON a.workflow_id = b.workflow_id AND b.step_order = a.step_order + 2""",
    # rotations and revocations name a key by the event that made it; some name none, or one still to come
    "key_event": """SELECT event_id AS id, CASE WHEN event_type = 'signup' THEN user_id % 40 END AS company_id,
        CASE event_type WHEN 'signup' THEN 'CREATE' WHEN 'error' THEN 'REVOKE' ELSE 'ROTATE' END AS action,
        CASE WHEN event_type <> 'signup' THEN event_id - 1 - user_id % 23 + CASE WHEN event_id % 31 = 0 THEN 40 ELSE 0 END END AS key_id FROM {events}""",
    "key_request": """SELECT event_id AS id, CASE WHEN event_id % 4 <> 0 THEN user_id END AS company_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE concat('key ', event_id) END AS key_alias,
        'local' AS key_provider, CASE WHEN event_id % 10 <> 7 THEN event_type END AS key_reference, 'RSA' AS algorithm FROM {events}""",
    "certificate": """SELECT event_id AS id, user_id, CASE WHEN event_id % 6 = 5 THEN 'SUSPENDED' ELSE 'ACTIVE' END AS status, event_id % 7 = 3 AS revoked, ts AS valid_from,
        CAST(event_id % 9 AS INT) AS valid_days FROM {events}""",
    "sign_request": "SELECT event_id AS id, CASE WHEN event_id % 8 = 1 THEN event_id + 100000000 ELSE event_id END AS certificate_id, CASE WHEN event_id % 5 = 2 THEN user_id + 1 ELSE user_id END AS user_id FROM {events}",
    # proofs as stored: some never made, some of an older content, some chained to a hash that isn't their predecessor's
    "stored_proof": """SELECT version_id, sha2(concat(coalesce(nullif(content, ''), concat_ws('-', contract_code, version_number, coalesce(change_summary, ''))),
            CASE WHEN version_id % 5 = 2 THEN '!' ELSE '' END), 256) AS document_hash,
        CASE WHEN previous_version_id IS NOT NULL AND version_id % 13 <> 4 THEN sha2(concat(coalesce(nullif(previous_content, ''), concat_ws('-', previous_code, previous_number,
            coalesce(previous_change, ''))), CASE WHEN previous_version_id % 5 = 2 THEN '!' ELSE '' END, CASE WHEN version_id % 7 = 3 AND version_id % 3 = 0 THEN '?'
                ELSE '' END), 256) END AS previous_hash,
        version_id % 4 = 1 AS verified, version_id % 250 AS generated_at FROM {proof} WHERE version_id % 17 <> 0""",
    "chain_tx": """SELECT event_id AS id, event_id % 1500 * 7 + 3 AS version_id, CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'view' THEN 'PENDING' ELSE 'CONFIRMED' END AS status,
        CASE WHEN event_id % 3 <> 0 THEN 15000000 + event_id END AS block_number, ts AS created_at FROM {events} WHERE event_id % 5 = 1""",
    # the whole ledger for its totals; chain_tx, a fifth of it, leaves proofs without a transaction for those that are to be anchored
    "chain_entry": """SELECT event_id AS id, event_id % 1500 * 7 + 3 AS version_id, CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'view' THEN 'PENDING' ELSE 'CONFIRMED' END AS status,
        CASE WHEN event_id % 3 <> 0 THEN 15000000 + event_id END AS block_number, ts AS created_at FROM {events}""",
    # what the ledger answered to proofs and to requests of registration; some requests got no answer
    "ledger_answer": """SELECT event_id AS request_id, event_id % 400 * 7 + 3 AS version_id, event_type <> 'error' AS ok, concat('tx-', event_id) AS tx_id, 15000000 + event_id AS block_number,
        concat('block-', event_id % 977) AS block_hash FROM {events} WHERE event_id % 23 <> 5""",
    "chain_audit": "SELECT event_id AS id, event_id - event_id % 3 AS tx_id, 'Anchor Proof' AS action FROM {events} WHERE event_id % 5 <> 0",
    # names and tax codes that clash with stored companies, with each other crosswise, and blanks
    "company_request": """SELECT event_id AS id, CASE WHEN event_id % 9 = 4 THEN '' WHEN event_id % 14 = 0 THEN concat('Customer#', lpad(CAST(user_id AS STRING), 9, '0'))
            ELSE concat('New company ', (event_id * 7 + user_id) % 1777) END AS company_name,
        CASE WHEN event_id % 11 = 5 THEN NULL ELSE concat('TAX-', (event_id * 3 + user_id) % 1999) END AS tax_code FROM {events}""",
    "staff_request": """SELECT event_id AS id, CASE WHEN event_id % 10 = 0 THEN concat('Supplier#', lpad(CAST(user_id % 50 AS STRING), 9, '0')) ELSE concat('person ', user_id % 350) END AS user_name,
        CASE WHEN event_id % 19 <> 7 THEN concat('p', event_id, '@example.org') END AS email, user_id % 90 AS company_id, event_id % 12 AS role_id FROM {events}""",
    "anchored_staff": """SELECT s_name AS user_name, CASE WHEN s_suppkey % 3 = 0 THEN 'ERROR' ELSE 'ACTIVE' END AS status, CASE WHEN s_suppkey % 4 <> 1 THEN s_suppkey + 100 END AS block_number
        FROM {supplier}""",
    "block": """SELECT event_id * event_id AS number, sha2(concat('previous ', event_id), 256) AS previous_hash, CASE WHEN event_id % 10 = 0 THEN '' ELSE sha2(concat('data ', event_id), 256) END AS data_hash FROM {events}""",
}


class Domain:
    """Lazy DataFrames of stored and domain tables under one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.known = spark, sf_dir, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.known:
            self.known[name] = self.sql(DOMAIN[name]) if name in DOMAIN else self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.known[name]

    def sql(self, query: str) -> DataFrame:
        return self.spark.sql(query, **{n: self[n] for n in inputs(query)})


def inputs(query: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", query)))


def twin(query: str) -> str:
    """The query for another engine: domain tables as common table expressions, in order of need."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in inputs(text):
            if name in DOMAIN and name not in order:
                need(DOMAIN[name])
                order.append(name)

    need(query)
    # the other engine's name for the digest that the tables are made with
    bare = lambda text: re.sub(r"\{(\w+)\}", r"\1", text).replace("sha2(", "sha256(").replace(", 256)", ")")
    heads = [f"{name} AS ({bare(DOMAIN[name])})" for name in order]
    body = bare(query).strip()
    if body[:14].upper() == "WITH RECURSIVE" and heads:
        return f"WITH RECURSIVE {', '.join(heads)}, {body[14:].lstrip()}"
    if body[:4].upper() == "WITH" and heads:
        return f"WITH {', '.join(heads)}, {body[4:].lstrip()}"
    return f"WITH {', '.join(heads)} {body}" if heads else body
