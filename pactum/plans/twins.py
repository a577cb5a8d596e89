"""The relational queries once more, in SQL for another engine; inputs are named as {table}."""

TWINS = {
    "contract_portfolio": r"""
        SELECT c.id, c.contract_code, c.title, c.status, nullif(c.contract_value, 0) AS contract_value, c.created_at, v.version_number, a.overall_score,
        CASE WHEN a.overall_score IS NOT NULL THEN CASE WHEN coalesce(a.overall_score, 0) >= 80 THEN 'HIGH' WHEN coalesce(a.overall_score, 0) >= 50 THEN
            'MEDIUM' ELSE 'LOW' END END AS risk_label
        FROM {contract} c LEFT JOIN (SELECT contract_id, id AS version_id, version_number FROM (SELECT *, row_number() OVER (PARTITION BY contract_id ORDER
            BY version_number DESC, id DESC) AS rn FROM {version}) v WHERE rn = 1) v ON v.contract_id = c.id LEFT JOIN {analysis} a ON a.version_id =
            v.version_id
    """,
    "risk_score": r"""
        SELECT version_id, findings, overall_score, concat('Total ', findings, ' findings, score ', overall_score) AS summary FROM {analysis}
    """,
    "analysis_history": r"""
        WITH named AS (SELECT f.version_id, r.rule_name, min(f.id) AS first_finding FROM {finding} f JOIN {rule} r ON r.id = f.rule_id GROUP BY
            f.version_id, r.rule_name),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY version_id ORDER BY first_finding, rule_name) AS rn FROM named),
        top AS (SELECT version_id, concat(max(CASE WHEN rn = 1 THEN rule_name END), coalesce('; ' || max(CASE WHEN rn = 2 THEN rule_name END), ''),
            coalesce('; ' || max(CASE WHEN rn = 3 THEN rule_name END), '')) AS risk_names
        FROM ranked WHERE rn <= 3 GROUP BY version_id)
        SELECT a.version_id, c.contract_code, a.findings, a.overall_score, CASE WHEN coalesce(a.overall_score, 0) >= 80 THEN 'HIGH' WHEN
            coalesce(a.overall_score, 0) >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS risk_label, CASE WHEN t.version_id IS NULL THEN '' ELSE t.risk_names END AS
            risk_names
        FROM {analysis} a JOIN {version} v ON v.id = a.version_id JOIN {contract} c ON c.id = v.contract_id LEFT JOIN top t ON t.version_id = a.version_id
    """,
    "history_search": r"""
        SELECT c.contract_code, c.title, a.overall_score FROM {analysis} a JOIN {version} v ON v.id = a.version_id JOIN {contract} c ON c.id = v.contract_id
        WHERE CASE WHEN coalesce(a.overall_score, 0) >= 80 THEN 'HIGH' WHEN coalesce(a.overall_score, 0) >= 50 THEN 'MEDIUM' ELSE 'LOW' END = 'HIGH' AND
            (contains(lower(coalesce(c.contract_code, '')), 'agreement 1') OR contains(lower(coalesce(c.title, '')), 'agreement 1'))
        ORDER BY a.overall_score DESC, a.version_id
    """,
    "contract_kpis": r"""
        SELECT count(*) AS total, count(CASE WHEN a.overall_score >= 80 THEN 1 END) AS high_risk, count(CASE WHEN c.status = 'ANALYZED' THEN 1 END) AS pending
        FROM {contract} c LEFT JOIN (SELECT contract_id, id AS version_id, version_number FROM (SELECT *, row_number() OVER (PARTITION BY contract_id ORDER
            BY version_number DESC, id DESC) AS rn FROM {version}) v WHERE rn = 1) v ON v.contract_id = c.id LEFT JOIN {analysis} a ON a.version_id =
            v.version_id
    """,
    "history_kpis": r"""
        SELECT count(*) AS total, count(CASE WHEN overall_score >= 80 THEN 1 END) AS high_count, CAST(floor(coalesce(avg(overall_score), 0) + 0.5) AS BIGINT)
            AS mean_score FROM {analysis}
    """,
    "global_counts": r"""
        SELECT (SELECT count(*) FROM {staff}) AS users, (SELECT count(*) FROM {company}) AS companies, (SELECT count(*) FROM {contract}) AS contracts,
            (SELECT count(*) FROM {request}) AS logs
    """,
    "company_directory": r"""
        SELECT id, company_name, tax_code FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(coalesce(nullif(tax_code, ''), company_name))) ORDER BY
            company_name, id DESC) AS rn FROM {company}) k WHERE rn = 1
    """,
    "user_directory": r"""
        SELECT u.id, u.user_name, coalesce(r.role_name, 'N/A') AS role_name, coalesce(c.company_name, 'N/A') AS company_name FROM {staff} u LEFT JOIN {role}
            r ON r.id = u.role_id LEFT JOIN {company} c ON c.id = u.company_id
    """,
    "role_gate": r"""
        SELECT u.id, u.user_name FROM {staff} u JOIN {role} r ON r.id = u.role_id WHERE upper(r.role_name) IN ('MANAGER', 'ADMIN')
    """,
    "audit_page": r"""
        SELECT q.id, q.path, coalesce(u.user_name, 'System') AS user_name, (SELECT greatest(1, CAST(ceil(count(*) / 10.0) AS BIGINT)) FROM {request}) AS pages
        FROM {request} q LEFT JOIN {staff} u ON u.id = q.user_id ORDER BY q.created_at DESC, q.id DESC LIMIT 10 OFFSET 20
    """,
    "contract_info_lookup": r"""
        SELECT w.id AS workflow_id, coalesce(c.contract_code, '') AS contract_code, coalesce(v.version_number, 1) AS version_number
        FROM {workflow} w LEFT JOIN {version} v ON v.id = w.id * 8 + 3 LEFT JOIN {contract} c ON c.id = v.contract_id
    """,
    "latest_and_oldest": r"""
        SELECT contract_id, max(CASE WHEN newest = 1 THEN version_id END) AS latest_version, max(CASE WHEN oldest = 1 THEN version_id END) AS oldest_version,
            max(version_number) + 1 AS next_number
        FROM (SELECT contract_id, id AS version_id, version_number, row_number() OVER (PARTITION BY contract_id ORDER BY version_number DESC, id DESC) AS
            newest,
        row_number() OVER (PARTITION BY contract_id ORDER BY id) AS oldest FROM {version}) x GROUP BY contract_id
    """,
    "previous_versions": r"""
        SELECT v.id AS version_id, p.id AS previous_id FROM {version} v LEFT JOIN {version} p ON p.contract_id = v.contract_id AND p.version_number =
            v.version_number - 1
    """,
    "rule_codes": r"""
        SELECT rule_name, min(id) AS rule_id, upper(replace(replace(rule_name, ' ', '_'), '-', '_')) AS created_code,
            regexp_replace(upper(replace(replace(rule_name, ' ', '_'), '-', '_')), '[^A-Z0-9_]', '') AS rule_code FROM {rule} GROUP BY rule_name
    """,
    "hash_proofs": r"""
        SELECT version_id, document_hash, file_size, previous_hash, sha2(concat(document_hash, coalesce(previous_hash, '')), 256) AS merkle_root FROM (
            SELECT version_id, sha2(CASE WHEN content <> '' THEN content ELSE contract_code || '-' || version_number || '-' || coalesce(change_summary, '') END, 256) AS document_hash,
                CASE WHEN content <> '' THEN strlen(content) ELSE length(contract_code || '-' || version_number || '-' || coalesce(change_summary, '')) END AS file_size,
                CASE WHEN previous_version_id IS NOT NULL THEN sha2(CASE WHEN previous_content <> '' THEN previous_content
                    ELSE previous_code || '-' || previous_number || '-' || coalesce(previous_change, '') END, 256) END AS previous_hash FROM {proof}) h
    """,
    "ledger_stats": r"""
        SELECT count(*) AS transactions, count(DISTINCT record_key) AS records, count(CASE WHEN is_delete THEN 1 END) AS deletions, coalesce(max(tx_id), 0)
            AS max_block FROM {ledger}
    """,
    "ledger_history": r"""
        SELECT record_key, tx_id, written_at, is_delete, coalesce(record, '') AS record, row_number() OVER (PARTITION BY record_key ORDER BY written_at,
            tx_id) AS revision,
        row_number() OVER (PARTITION BY record_key ORDER BY written_at DESC, tx_id DESC) = 1 AND NOT is_delete AS is_current FROM {ledger}
    """,
    "top_transactions": r"""
        SELECT id, user_id, approved_at FROM {approval} ORDER BY approved_at DESC, id DESC LIMIT 20
    """,
    "workflow_progress": r"""
        SELECT w.id, w.status, count(s.id) AS steps, count(CASE WHEN s.status = 'APPROVED' THEN 1 END) AS approved,
        CASE WHEN count(s.id) = 0 THEN 0 ELSE CAST(floor(100.0 * count(CASE WHEN s.status = 'APPROVED' THEN 1 END) / count(s.id) + 0.5) AS BIGINT) END AS
            progress
        FROM {workflow} w LEFT JOIN {step} s ON s.workflow_id = w.id GROUP BY w.id, w.status
    """,
    "workflow_kpis": r"""
        SELECT count(*) AS total, count(CASE WHEN status = 'PENDING' THEN 1 END) AS pending, count(CASE WHEN status = 'IN_PROGRESS' THEN 1 END) AS
            in_progress, count(CASE WHEN status = 'COMPLETED' THEN 1 END) AS completed FROM {workflow}
    """,
    "blocked_steps": r"""
        SELECT d.dependent_id AS step_id, count(*) AS unmet FROM {dependency} d JOIN {step} p ON p.id = d.prerequisite_id WHERE p.status <> 'APPROVED' OR
            p.status IS NULL GROUP BY d.dependent_id
    """,
    "approvable_steps": r"""
        SELECT s.id FROM {step} s WHERE s.status = 'PENDING' AND NOT EXISTS (SELECT 1 FROM {dependency} d JOIN {step} p ON p.id = d.prerequisite_id WHERE
            d.dependent_id = s.id AND p.status <> 'APPROVED')
    """,
    "reviewable_steps": r"""
        WITH gated AS (SELECT s.*, w.status AS workflow_status, contains(lower(step_name), 'ký kết hợp đồng') OR contains(lower(step_name),
            'lưu trữ kho hồ sơ') AS closing,
        role_id IN (5, 11) OR contains(lower(step_name), 'phê duyệt cấp quản lý') OR contains(lower(step_name), 'ban điều hành') AS manager,
        row_number() OVER (PARTITION BY workflow_id ORDER BY step_order) AS place,
        first_value(s.status) OVER (PARTITION BY workflow_id ORDER BY step_order) AS first_status,
        coalesce(sum(CASE WHEN s.status <> 'APPROVED' THEN 1 ELSE 0 END) OVER (PARTITION BY workflow_id ORDER BY step_order ROWS BETWEEN UNBOUNDED PRECEDING
            AND 1 PRECEDING), 0) AS open_before
        FROM {step} s JOIN {workflow} w ON w.id = s.workflow_id),
        counted AS (SELECT *, sum(CASE WHEN status <> 'APPROVED' AND place > 1 AND NOT (contains(lower(step_name), 'ký kết hợp đồng') OR
            contains(lower(step_name), 'lưu trữ kho hồ sơ')) THEN 1 ELSE 0 END) OVER (PARTITION BY workflow_id) AS open_middle FROM gated)
        SELECT id, workflow_id, step_order, status = 'PENDING' AND workflow_status IN ('PENDING', 'IN_PROGRESS') AND (place = 1 OR first_status = 'APPROVED'
            AND CASE
        WHEN manager THEN open_middle - CASE WHEN closing OR status = 'APPROVED' THEN 0 ELSE 1 END = 0 WHEN closing OR contains(lower(step_name),
            'bàn giao bản cứng') THEN open_before = 0 ELSE TRUE END) AS reviewable FROM counted
    """,
    "first_pending_step": r"""
        SELECT workflow_id, id AS step_id FROM (SELECT *, row_number() OVER (PARTITION BY workflow_id ORDER BY step_order) AS rn FROM {step} WHERE status =
            'PENDING') p WHERE rn = 1
    """,
    "step_renumber": r"""
        SELECT id, workflow_id, CASE WHEN step_order >= 3 THEN step_order + 1 ELSE step_order END AS after_insert, CASE WHEN step_order > 3 THEN step_order -
            1 ELSE step_order END AS after_delete,
        row_number() OVER (PARTITION BY workflow_id ORDER BY step_order) AS reindexed FROM {step}
    """,
    "approval_outcomes": r"""
        WITH RECURSIVE e AS (
            SELECT a.*, row_number() OVER (PARTITION BY a.workflow_id ORDER BY a.id) AS k, s.id IS NOT NULL AS there,
                coalesce((SELECT list(d.prerequisite_id) FROM {dependency} d WHERE d.dependent_id = a.step_id), []) AS needs FROM {approval} a
                LEFT JOIN {step} s ON s.id = a.step_id AND s.workflow_id = a.workflow_id),
        own AS (
            SELECT w.id AS workflow_id, any_value(w.status) AS status, count(s.id) AS n, coalesce(list(s.id) FILTER (s.status = 'APPROVED'), []) AS done,
                coalesce(list(s.id) FILTER (s.status = 'REJECTED'), []) AS bad
            FROM {workflow} w LEFT JOIN {step} s ON s.workflow_id = w.id GROUP BY w.id),
        walk AS (
            SELECT workflow_id, CAST(0 AS BIGINT) AS k, status, done, bad, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS step_id, CAST(NULL AS BIGINT) AS user_id,
                CAST(NULL AS VARCHAR) AS comment, CAST(NULL AS VARCHAR) AS outcome, n FROM own
            UNION ALL SELECT workflow_id, k, CASE o WHEN 'rejected' THEN 'REJECTED' WHEN 'completed' THEN CASE WHEN len(done2) = n THEN 'COMPLETED' ELSE 'IN_PROGRESS' END ELSE status END,
                done2, CASE o WHEN 'rejected' THEN list_distinct(list_append(bad, step_id)) WHEN 'completed' THEN list_filter(bad, lambda x: x <> step_id) ELSE bad END,
                id, step_id, user_id, CASE WHEN o = 'completed' AND coalesce(comment, '') = '' THEN 'Accepted & Completed by Manager' ELSE comment END, o, n
            FROM (SELECT *, CASE o WHEN 'completed' THEN list_distinct(list_append(done, step_id)) WHEN 'rejected' THEN list_filter(done, lambda x: x <> step_id) ELSE done END AS done2
                FROM (SELECT w.workflow_id, e.k, w.status, w.done, w.bad, w.n, e.id, e.step_id, e.user_id, e.comment,
                        CASE WHEN NOT e.there THEN 'missing' WHEN e.status NOT IN ('APPROVED', 'REJECTED', 'FORCE_COMPLETE') THEN 'invalid' WHEN e.status = 'REJECTED' THEN 'rejected'
                             WHEN NOT list_has_all(w.done, e.needs) THEN 'blocked' WHEN e.status = 'APPROVED' THEN 'signed' ELSE 'completed' END AS o
                    FROM walk w JOIN e ON e.workflow_id = w.workflow_id AND e.k = w.k + 1) x) y)
        SELECT id, workflow_id, step_id, user_id, comment, outcome, CASE WHEN outcome <> 'missing' THEN CASE WHEN list_contains(done, step_id) THEN 'APPROVED'
            WHEN list_contains(bad, step_id) THEN 'REJECTED' ELSE 'PENDING' END END AS step_status, status AS workflow_status FROM walk WHERE k > 0
    """,
    "approval_fold": r"""
        WITH RECURSIVE e AS (
            SELECT a.*, row_number() OVER (PARTITION BY a.workflow_id ORDER BY a.id) AS k, s.id IS NOT NULL AS there,
                coalesce((SELECT list(d.prerequisite_id) FROM {dependency} d WHERE d.dependent_id = a.step_id), []) AS needs FROM {approval} a
                LEFT JOIN {step} s ON s.id = a.step_id AND s.workflow_id = a.workflow_id),
        own AS (
            SELECT w.id AS workflow_id, any_value(w.status) AS status, count(s.id) AS n, coalesce(list(s.id) FILTER (s.status = 'APPROVED'), []) AS done,
                coalesce(list(s.id) FILTER (s.status = 'REJECTED'), []) AS bad
            FROM {workflow} w LEFT JOIN {step} s ON s.workflow_id = w.id GROUP BY w.id),
        walk AS (
            SELECT workflow_id, CAST(0 AS BIGINT) AS k, status, done, bad, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS step_id, CAST(NULL AS BIGINT) AS user_id,
                CAST(NULL AS VARCHAR) AS comment, CAST(NULL AS VARCHAR) AS outcome, n FROM own
            UNION ALL SELECT workflow_id, k, CASE o WHEN 'rejected' THEN 'REJECTED' WHEN 'completed' THEN CASE WHEN len(done2) = n THEN 'COMPLETED' ELSE 'IN_PROGRESS' END ELSE status END,
                done2, CASE o WHEN 'rejected' THEN list_distinct(list_append(bad, step_id)) WHEN 'completed' THEN list_filter(bad, lambda x: x <> step_id) ELSE bad END,
                id, step_id, user_id, CASE WHEN o = 'completed' AND coalesce(comment, '') = '' THEN 'Accepted & Completed by Manager' ELSE comment END, o, n
            FROM (SELECT *, CASE o WHEN 'completed' THEN list_distinct(list_append(done, step_id)) WHEN 'rejected' THEN list_filter(done, lambda x: x <> step_id) ELSE done END AS done2
                FROM (SELECT w.workflow_id, e.k, w.status, w.done, w.bad, w.n, e.id, e.step_id, e.user_id, e.comment,
                        CASE WHEN NOT e.there THEN 'missing' WHEN e.status NOT IN ('APPROVED', 'REJECTED', 'FORCE_COMPLETE') THEN 'invalid' WHEN e.status = 'REJECTED' THEN 'rejected'
                             WHEN NOT list_has_all(w.done, e.needs) THEN 'blocked' WHEN e.status = 'APPROVED' THEN 'signed' ELSE 'completed' END AS o
                    FROM walk w JOIN e ON e.workflow_id = w.workflow_id AND e.k = w.k + 1) x) y),
        ends AS (SELECT DISTINCT ON (workflow_id) workflow_id, done, bad FROM walk ORDER BY workflow_id, k DESC),
        kept AS (SELECT step_id, count(*) AS n, arg_max(coalesce(comment, ''), id) AS c FROM walk WHERE outcome IN ('signed', 'completed', 'rejected') GROUP BY step_id)
        SELECT s.id AS step_id, CASE WHEN list_contains(done, s.id) THEN 'APPROVED' WHEN list_contains(bad, s.id) THEN 'REJECTED' ELSE 'PENDING' END AS step_status,
            coalesce(n, 0) AS approvals, c AS last_comment FROM {step} s LEFT JOIN ends USING (workflow_id) LEFT JOIN kept ON kept.step_id = s.id
    """,
    "approval_workflows": r"""
        WITH RECURSIVE e AS (
            SELECT a.*, row_number() OVER (PARTITION BY a.workflow_id ORDER BY a.id) AS k, s.id IS NOT NULL AS there,
                coalesce((SELECT list(d.prerequisite_id) FROM {dependency} d WHERE d.dependent_id = a.step_id), []) AS needs FROM {approval} a
                LEFT JOIN {step} s ON s.id = a.step_id AND s.workflow_id = a.workflow_id),
        own AS (
            SELECT w.id AS workflow_id, any_value(w.status) AS status, count(s.id) AS n, coalesce(list(s.id) FILTER (s.status = 'APPROVED'), []) AS done,
                coalesce(list(s.id) FILTER (s.status = 'REJECTED'), []) AS bad
            FROM {workflow} w LEFT JOIN {step} s ON s.workflow_id = w.id GROUP BY w.id),
        walk AS (
            SELECT workflow_id, CAST(0 AS BIGINT) AS k, status, done, bad, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS step_id, CAST(NULL AS BIGINT) AS user_id,
                CAST(NULL AS VARCHAR) AS comment, CAST(NULL AS VARCHAR) AS outcome, n FROM own
            UNION ALL SELECT workflow_id, k, CASE o WHEN 'rejected' THEN 'REJECTED' WHEN 'completed' THEN CASE WHEN len(done2) = n THEN 'COMPLETED' ELSE 'IN_PROGRESS' END ELSE status END,
                done2, CASE o WHEN 'rejected' THEN list_distinct(list_append(bad, step_id)) WHEN 'completed' THEN list_filter(bad, lambda x: x <> step_id) ELSE bad END,
                id, step_id, user_id, CASE WHEN o = 'completed' AND coalesce(comment, '') = '' THEN 'Accepted & Completed by Manager' ELSE comment END, o, n
            FROM (SELECT *, CASE o WHEN 'completed' THEN list_distinct(list_append(done, step_id)) WHEN 'rejected' THEN list_filter(done, lambda x: x <> step_id) ELSE done END AS done2
                FROM (SELECT w.workflow_id, e.k, w.status, w.done, w.bad, w.n, e.id, e.step_id, e.user_id, e.comment,
                        CASE WHEN NOT e.there THEN 'missing' WHEN e.status NOT IN ('APPROVED', 'REJECTED', 'FORCE_COMPLETE') THEN 'invalid' WHEN e.status = 'REJECTED' THEN 'rejected'
                             WHEN NOT list_has_all(w.done, e.needs) THEN 'blocked' WHEN e.status = 'APPROVED' THEN 'signed' ELSE 'completed' END AS o
                    FROM walk w JOIN e ON e.workflow_id = w.workflow_id AND e.k = w.k + 1) x) y)
        SELECT workflow_id, arg_max(status, k) AS status, count(*) FILTER (outcome = 'blocked') AS refused FROM walk GROUP BY workflow_id
    """,
    "workflow_completion": r"""
        SELECT workflow_id, CASE WHEN count(*) = count(CASE WHEN status = 'APPROVED' THEN 1 END) THEN 'COMPLETED' ELSE 'IN_PROGRESS' END AS status FROM
            {step} GROUP BY workflow_id
    """,
    "active_keys": r"""
        WITH own AS (SELECT company_id, id, key_version, row_number() OVER (PARTITION BY company_id ORDER BY key_version DESC, id DESC) AS rn FROM
            {signing_key} WHERE status = 'ACTIVE'),
        any_key AS (SELECT id FROM {signing_key} WHERE status = 'ACTIVE' ORDER BY key_version DESC, id DESC LIMIT 1)
        SELECT k.company_id, coalesce(o.id, a.id) AS key_id, o.id IS NULL AS borrowed FROM (SELECT DISTINCT company_id FROM {signing_key}) k LEFT JOIN own o
            ON o.company_id = k.company_id AND o.rn = 1 CROSS JOIN any_key a
    """,
    "clause_texts": r"""
        SELECT version_id, id, substring(content, 1, 800) AS content FROM (SELECT *, row_number() OVER (PARTITION BY version_id ORDER BY id) AS rn FROM
            {clause}) c WHERE rn <= 15
    """,
    "contract_list": r"""
        SELECT c.id, c.contract_code, c.title, c.contract_type, strftime(c.start_date, '%Y-%m-%d') AS start_date, strftime(c.end_date, '%Y-%m-%d') AS end_date,
            CASE WHEN c.contract_value <> 0 THEN CAST(c.contract_value AS DOUBLE) END AS contract_value, c.status, a.overall_score AS risk_score,
            strftime(c.created_at, '%Y-%m-%dT%H:%M:%S') AS created_at
        FROM {contract} c LEFT JOIN (SELECT contract_id, arg_max(id, version_number) AS version_id FROM {version} GROUP BY contract_id) v ON v.contract_id = c.id
            LEFT JOIN {analysis} a ON a.version_id = v.version_id
    """,
    "contract_search": r"""
        SELECT id, contract_code, title, status FROM {contract} WHERE lower(contract_code || '|' || title || '|' || status) LIKE '%draft%'
    """,
    "admin_contract_search": r"""
        SELECT id, contract_code, title FROM {contract} WHERE status = 'APPROVED' AND (contract_code ILIKE '%agree%' OR title ILIKE '%agree%' OR contract_type ILIKE '%agree%')
            AND (contract_code ILIKE '%HIGH%' OR title ILIKE '%HIGH%' OR contract_type ILIKE '%HIGH%')
    """,
    "history_pages": r"""
        WITH r AS (SELECT id, coalesce(overall_score, 0) AS overall_score, created_at FROM {analysis_run})
        SELECT * FROM (SELECT 'newest' AS mode, * FROM r ORDER BY created_at DESC, id DESC LIMIT 50)
        UNION ALL SELECT * FROM (SELECT 'oldest', * FROM r ORDER BY created_at, id DESC LIMIT 50)
        UNION ALL SELECT * FROM (SELECT 'score-desc', * FROM r ORDER BY overall_score DESC, created_at DESC, id DESC LIMIT 50)
        UNION ALL SELECT * FROM (SELECT 'score-asc', * FROM r ORDER BY overall_score, created_at DESC, id DESC LIMIT 50)
    """,
    "risk_catalog": r"""
        SELECT DISTINCT r.rule_name, c.id, c.contract_code FROM {finding} f JOIN {rule} r ON r.id = f.rule_id JOIN {version} v ON v.id = f.version_id JOIN
            {contract} c ON c.id = v.contract_id
    """,
    "tenant_scope": r"""
        SELECT u.id AS user_id, c.id AS company_id FROM {staff} u LEFT JOIN {company} o ON o.id = u.company_id CROSS JOIN {company} c
        WHERE u.is_superuser OR u.company_id IS NULL OR o.id = c.id
            OR len([b FOR b IN ['fpt', 'techcom', 'vin', 'viettel'] IF contains(lower(o.company_name), b) AND contains(lower(c.company_name), b)]) > 0
    """,
    "company_scope": r"""
        SELECT id AS company_id, 'all' AS access FROM {company} UNION ALL SELECT id, 'company:' || id FROM {company}
        UNION ALL SELECT id, 'brand:' || b FROM {company}, (VALUES ('fpt'), ('techcom'), ('vin'), ('viettel')) AS v(b) WHERE contains(lower(company_name), b)
    """,
    "visible_contracts": r"""
        SELECT k.id, k.contract_code FROM {contract} k LEFT JOIN {company} c ON c.id = k.company_id, (SELECT u.*, o.company_name FROM {staff} u LEFT
            JOIN {company} o ON o.id = u.company_id WHERE u.id = 5) u
        WHERE u.is_superuser OR u.company_id IS NULL OR k.company_id IS NULL OR k.company_id = u.company_id
            OR len([b FOR b IN ['fpt', 'techcom', 'vin', 'viettel'] IF contains(lower(u.company_name), b) AND contains(lower(c.company_name), b)]) > 0
    """,
    "contract_access": r"""
        SELECT u.id AS user_id, count(*) FILTER (u.is_superuser OR u.company_id IS NULL OR k.company_id IS NULL OR k.company_id = u.company_id
                OR len([b FOR b IN ['fpt', 'techcom', 'vin', 'viettel'] IF contains(lower(u.company_name), b) AND contains(lower(k.company_name), b)]) > 0) AS contracts
        FROM (SELECT u.*, o.company_name FROM {staff} u LEFT JOIN {company} o ON o.id = u.company_id) u,
            (SELECT k.id, k.company_id, c.company_name FROM {contract} k LEFT JOIN {company} c ON c.id = k.company_id) k GROUP BY u.id
    """,
    "tenant_company": "SELECT id AS user_id, CASE WHEN NOT is_superuser THEN company_id END AS company_id FROM {staff}",
    "company_versions": "SELECT id AS version_id FROM {version} WHERE contract_id IN (SELECT id FROM {contract} WHERE company_id IN (SELECT company_id FROM {staff}))",
    "next_versions": "SELECT c.id AS contract_id, coalesce(max(v.version_number), 0) + 1 AS next_number FROM {contract} c LEFT JOIN {version} v ON v.contract_id = c.id GROUP BY c.id",
    "contract_tree": r"""
        SELECT c.id, c.contract_code, count(v.id) AS versions, CAST(coalesce(sum(f.n), 0) AS BIGINT) AS files, coalesce(string_agg(f.paths, '|' ORDER BY
            v.version_number), '') AS file_paths,
            CAST(coalesce(sum(a.n), 0) AS BIGINT) AS analyses, coalesce(string_agg(a.scores, '|' ORDER BY v.version_number), '') AS scores
        FROM {contract} c LEFT JOIN {version} v ON v.contract_id = c.id
            LEFT JOIN (SELECT version_id, count(*) AS n, string_agg(file_path, ',' ORDER BY id) AS paths FROM {contract_file} GROUP BY version_id) f ON f.version_id = v.id
            LEFT JOIN (SELECT version_id, count(*) AS n, string_agg(coalesce(CAST(overall_score AS VARCHAR), '-'), ',' ORDER BY id) AS scores FROM
                {analysis_run} GROUP BY version_id) a ON a.version_id = v.id
        GROUP BY c.id, c.contract_code
    """,
    "company_registration": r"""
        WITH RECURSIVE whole AS (SELECT id, company_name, tax_code FROM {company_request} WHERE company_name <> '' AND tax_code <> ''
            AND tax_code NOT IN (SELECT tax_code FROM {company} WHERE tax_code <> '') AND company_name NOT IN (SELECT company_name FROM {company} WHERE company_name <> '')),
        rounds AS (
            SELECT id, company_name, tax_code, 'open' AS state FROM whole
            UNION ALL SELECT id, company_name, tax_code, CASE WHEN won THEN 'kept' WHEN bool_or(won) OVER (PARTITION BY company_name)
                OR bool_or(won) OVER (PARTITION BY tax_code) THEN 'lost' ELSE 'open' END
            FROM (SELECT *, id = min(id) OVER (PARTITION BY company_name) AND id = min(id) OVER (PARTITION BY tax_code) AS won FROM rounds WHERE state = 'open') r),
        kept AS (SELECT id FROM rounds WHERE state = 'kept'),
        told AS (SELECT q.id, CASE WHEN coalesce(company_name, '') = '' OR coalesce(tax_code, '') = '' THEN 'missing' WHEN q.id NOT IN (SELECT id FROM kept) THEN 'duplicate'
                WHEN a.tx_id IS NULL THEN 'error' ELSE 'registered' END AS outcome, a.tx_id, a.block_number
            FROM {company_request} q LEFT JOIN {ledger_answer} a ON a.request_id = q.id AND a.ok)
        SELECT id, outcome, CASE outcome WHEN 'registered' THEN 'ACTIVE' WHEN 'error' THEN 'ERROR' END AS status, CASE WHEN outcome = 'registered' THEN tx_id END AS tx_id,
            CASE WHEN outcome = 'registered' THEN block_number END AS block_number FROM told
    """,
    "staff_registration": r"""
        WITH r AS (SELECT q.*, q.email IS NOT NULL AND q.user_name <> '' AS whole, q.company_id IN (SELECT id FROM {company}) AND q.role_id IN (SELECT id FROM {role}) AS known,
                q.id IN (SELECT request_id FROM {ledger_answer} WHERE ok) AS ok,
                q.user_name IN (SELECT user_name FROM {anchored_staff} WHERE status = 'ACTIVE' AND block_number IS NOT NULL) AS stored FROM {staff_request} q),
        so_far AS (SELECT *, count(*) FILTER (whole AND known AND ok) OVER (PARTITION BY user_name ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS good FROM r)
        SELECT id, user_name, CASE WHEN NOT whole THEN 'missing' WHEN NOT known THEN 'unknown' WHEN stored OR good > 0 THEN 'duplicate' WHEN ok THEN 'registered'
            ELSE 'error' END AS outcome FROM so_far
    """,
    "registered_staff": r"""
        WITH r AS (SELECT q.*, q.id IN (SELECT request_id FROM {ledger_answer} WHERE ok) AS ok FROM {staff_request} q
            WHERE email IS NOT NULL AND q.company_id IN (SELECT id FROM {company}) AND q.role_id IN (SELECT id FROM {role})
                AND q.user_name NOT IN (SELECT user_name FROM {anchored_staff} WHERE status = 'ACTIVE' AND block_number IS NOT NULL)),
        so_far AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY user_name ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS good FROM r)
        SELECT DISTINCT ON (user_name) user_name, email, company_id, role_id, CASE WHEN ok THEN 'ACTIVE' ELSE 'ERROR' END AS status FROM so_far WHERE good = 0 ORDER BY user_name, id DESC
    """,
    "certificate_serials": r"""
        SELECT s.id, 'CERT-' || left(replace(regexp_replace(upper(c.company_name), '[^A-Z0-9 ]', '', 'g'), ' ', '-'), 8) || '-' || printf('%04d', s.id) || '-'
            || CAST(1000 + list_reduce(list_transform(string_split(substr(sha256(c.company_name || ':' || s.id), 1, 8), ''), lambda h:
                CAST(instr('0123456789abcdef', h) - 1 AS BIGINT)), lambda a, h: a * 16 + h) % 9000 AS VARCHAR) AS serial
        FROM {staff} s JOIN {company} c ON c.id = s.company_id
    """,
    "version_list": r"""
        SELECT v.id AS version_id, v.contract_id, v.version_number, CAST(o.overall_score AS DOUBLE) AS overall_score, coalesce(o.risk_level, 'NONE') AS
            risk_level, n.id AS latest_id, n.overall_score AS latest_score
        FROM {version} v LEFT JOIN (SELECT DISTINCT ON (version_id) * FROM {analysis_run} ORDER BY version_id, id) o ON o.version_id = v.id
            LEFT JOIN (SELECT DISTINCT ON (version_id) * FROM {analysis_run} ORDER BY version_id, created_at DESC, id DESC) n ON n.version_id = v.id
    """,
    "version_files": r"""
        SELECT v.id AS version_id, f.id AS file_id, regexp_replace(url_decode(f.file_path), '^/media/', '') AS path, lower(nullif(regexp_extract(f.file_path,
            '(\.[A-Za-z0-9]+)$', 1), '')) AS ext
        FROM {version} v LEFT JOIN (SELECT DISTINCT ON (version_id) * FROM {contract_file} ORDER BY version_id, id) f ON f.version_id = v.id
    """,
    "safe_file_codes": "SELECT id, regexp_replace(title, '[^A-Za-z0-9_-]', '', 'g') AS code FROM {contract}",
    "finding_clause_match": r"""
        WITH f AS (SELECT id, version_id, lower(trim(clause_title)) AS t FROM {api_finding}), c AS (SELECT id, version_id, lower(trim(title)) AS t FROM {clause})
        SELECT f.id AS finding_id, c.id AS clause_id FROM f JOIN c ON c.version_id = f.version_id WHERE f.t = c.t OR f.t <> '' AND c.t <> '' AND (c.t LIKE '%'
            || f.t || '%' OR f.t LIKE '%' || c.t || '%')
    """,
    "rule_get_or_create": r"""
        WITH asked AS (SELECT DISTINCT ON (lower(trim(risk_category))) lower(trim(risk_category)) AS k, trim(risk_category) AS n, risk_level FROM {api_finding}
            ORDER BY lower(trim(risk_category)), id),
        have AS (SELECT DISTINCT ON (lower(rule_name)) lower(rule_name) AS k, rule_name, id FROM {rule} ORDER BY lower(rule_name), id)
        SELECT coalesce(h.rule_name, a.n) AS rule_name, regexp_replace(replace(replace(upper(coalesce(h.rule_name, a.n)), ' ', '_'), '-', '_'), '[^A-Z0-9_]', '', 'g') AS rule_code,
            CASE WHEN h.id IS NULL THEN a.risk_level END AS severity, h.id AS rule_id, h.id IS NULL AS created FROM asked a LEFT JOIN have h ON h.k = a.k
    """,
    "rule_table": r"""
        WITH fresh AS (SELECT DISTINCT ON (lower(trim(risk_category))) trim(risk_category) AS n FROM {api_finding} WHERE lower(trim(risk_category)) NOT IN
            (SELECT lower(rule_name) FROM {rule}) ORDER BY lower(trim(risk_category)), id)
        SELECT id, rule_name, description FROM {rule}
        UNION ALL SELECT (SELECT max(id) FROM {rule}) + row_number() OVER (ORDER BY n), n, 'Auto-created category for ' || n || '.' FROM fresh
    """,
    "summary_upsert": r"""
        SELECT version_id, arg_max(summary, id) AS summary, arg_max(model_id, id) FILTER (model_id <> '') AS model_id FROM {summary_event} GROUP BY version_id
    """,
    "review_outcomes": r"""
        SELECT id, CASE WHEN version_id NOT IN (SELECT version_id FROM {analysis}) THEN 'Analysis not found.' WHEN coalesce(level, '') NOT IN ('LOW', 'MEDIUM',
            'HIGH') THEN 'Invalid risk level.' ELSE 'stored' END AS outcome,
            CASE WHEN version_id IN (SELECT version_id FROM {analysis}) AND level IN ('LOW', 'MEDIUM', 'HIGH') THEN 'APPROVED' END AS status FROM {review}
    """,
    "contract_status": r"""
        WITH last AS (SELECT DISTINCT ON (contract_id) contract_id, action FROM {contract_event} ORDER BY contract_id, happened_at DESC, id DESC)
        SELECT c.id, CASE l.action WHEN 'ANALYZE' THEN 'ANALYZING' WHEN 'ANALYZED' THEN 'ANALYZED' WHEN 'REVIEW' THEN 'APPROVED' WHEN 'FAILED' THEN 'DRAFT'
            WHEN 'EXTRACT' THEN 'DRAFT'
            WHEN 'NEW_VERSION' THEN 'DRAFT' ELSE c.status END AS status FROM {contract} c LEFT JOIN last l ON l.contract_id = c.id
    """,
    "reanalysis": r"""
        SELECT id, version_id, model_name, overall_score FROM {analysis_run} WHERE version_id % 4 <> 1
        UNION ALL SELECT version_id, version_id, 'again', overall_score FROM {analysis} WHERE version_id % 4 = 1
    """,
    "reextract_cascade": r"""
        SELECT e.id AS entity_id, e.clause_id FROM (SELECT id, id AS clause_id, version_id FROM {clause}) e WHERE e.version_id % 3 <> 1
    """,
    "clause_types": "SELECT version_id, string_agg(DISTINCT clause_type, ',' ORDER BY clause_type) AS clause_types FROM {clause} WHERE clause_type IS NOT NULL GROUP BY version_id",
    "raw_contents": r"""
        WITH p AS (SELECT version_id, string_agg(content, chr(10) || chr(10) ORDER BY id) AS x FROM {page_text} WHERE context_type = 'raw_text' GROUP BY version_id),
        f AS (SELECT version_id, nullif(content, '') AS x FROM {file_text}),
        c AS (SELECT version_id, string_agg('--- ' || title || ' ---' || chr(10) || content, chr(10) || chr(10) ORDER BY id) AS x FROM {clause} GROUP BY version_id)
        SELECT v.version_id, coalesce(p.x, f.x, c.x, '') AS content, CASE WHEN p.x IS NOT NULL THEN 'pages' WHEN f.x IS NOT NULL THEN 'file' WHEN c.x IS NOT
            NULL THEN 'clauses' END AS origin
        FROM (SELECT DISTINCT version_id FROM {clause}) v LEFT JOIN p USING (version_id) LEFT JOIN f USING (version_id) LEFT JOIN c USING (version_id)
    """,
    "clause_order": r"""
        SELECT id AS clause_id, version_id, entity_type, entity_value, row_number() OVER (PARTITION BY version_id ORDER BY id, entity_type, entity_value) AS position
        FROM (SELECT id, version_id, unnest(['PARTY', 'ACTION']) AS entity_type, title AS entity_value FROM {clause}) e
    """,
    "dependency_checks": r"""
        SELECT r.prerequisite_id, r.dependent_id, r.workflow_id, CASE WHEN r.prerequisite_id = r.dependent_id THEN 'self'
            WHEN a.id IS NULL OR b.id IS NULL THEN 'missing' WHEN a.workflow_id <> r.workflow_id OR b.workflow_id <> r.workflow_id THEN 'other workflow'
            WHEN (r.dependent_id, r.prerequisite_id) IN (SELECT (prerequisite_id, dependent_id) FROM {dependency}) THEN 'cycle'
            WHEN (r.prerequisite_id, r.dependent_id) IN (SELECT (prerequisite_id, dependent_id) FROM {dependency}) THEN 'known' ELSE 'created' END AS outcome
        FROM {edge_request} r LEFT JOIN {step} a ON a.id = r.prerequisite_id LEFT JOIN {step} b ON b.id = r.dependent_id
    """,
    "step_signers": r"""
        WITH named AS (SELECT a.step_id, a.id, s.user_name || coalesce(' (' || r.role_name || ')', '') AS label FROM {approval} a JOIN {staff} s ON s.id =
            a.user_id LEFT JOIN {role} r ON r.id = s.role_id),
        once AS (SELECT step_id, label, min(id) AS first FROM named GROUP BY step_id, label)
        SELECT step_id, string_agg(label, ', ' ORDER BY first) AS signers FROM once GROUP BY step_id
    """,
    "anchor_steps": r"""
        WITH s AS (SELECT workflow_id, step_order, lower(step_name) AS low, step_name, role_id, description, row_number() OVER (PARTITION BY workflow_id ORDER BY
            step_order, id) AS k FROM {step}),
        heads AS (SELECT workflow_id, regexp_matches(low, 'sơ bộ|đầu tiên|tổng quan|tiếp nhận|dự thảo|đăng ký|kiểm tra ban đầu') AS begun FROM s WHERE k = 1),
        kept AS (SELECT workflow_id, k, step_name, role_id, description, role_id IN (5, 11) OR regexp_matches(low, 'phê duyệt|chủ trương|quản lý|giám đốc|ban điều hành') AS
            approves FROM s WHERE NOT regexp_matches(low, 'ký kết|signing|lưu trữ|archive')),
        every AS (SELECT workflow_id, k, step_name, role_id, description FROM kept
            UNION ALL SELECT workflow_id, 0, 'Rà soát & Tiếp nhận Dự thảo Hợp đồng', 4,
                'Kiểm tra tính đầy đủ của hồ sơ dự thảo, tư cách pháp nhân các bên và hình thức hợp đồng.' FROM heads WHERE NOT begun
            UNION ALL SELECT workflow_id, 1000, 'Phê duyệt Chủ trương & Phương án Thực hiện Cấp Quản lý', 5,
                'Cấp quản lý trực tiếp xét duyệt phương án triển khai, chi phí và định hướng hợp đồng.' FROM heads WHERE workflow_id NOT IN (SELECT workflow_id FROM kept WHERE approves)
            UNION ALL SELECT workflow_id, 1001, 'Thực hiện Ký kết Hợp đồng Chính thức', 4, 'Đại diện có thẩm quyền của các bên thực hiện ký kết hợp đồng bằng chữ ký số.' FROM heads
            UNION ALL SELECT workflow_id, 1002, 'Bàn giao Bản cứng & Lưu trữ Kho Hồ sơ Hợp đồng', 4,
                'Lưu trữ bản hợp đồng chính thức và các tài liệu bàn giao liên quan vào hệ thống quản lý.' FROM heads)
        SELECT workflow_id, row_number() OVER (PARTITION BY workflow_id ORDER BY k) AS step_order, step_name, role_id, description FROM every
    """,
    "default_workflow": r"""
        WITH w AS (SELECT id, CASE WHEN starts_with(t, 'WF_') THEN t WHEN t = '' THEN 'WF_STANDARD' ELSE 'WF_' || t END AS workflow_type FROM (SELECT id,
            upper(trim(coalesce(workflow_type, ''))) AS t FROM {workflow}) x),
        n AS (SELECT *, array_to_string(list_transform(regexp_extract_all(replace(workflow_type, 'WF_', ''), '[A-Za-z]+|[^A-Za-z]+'), lambda s: upper(s[1]) ||
            lower(s[2:])), '') AS label FROM w)
        SELECT id, workflow_type, 'Quy trình Phê duyệt Mặc định' || CASE WHEN label IN ('', 'Standard') THEN '' ELSE ' – ' || label END AS workflow_name,
            step_order, step_name, role_id
        FROM n CROSS JOIN (VALUES (1, 'Rà soát & Tiếp nhận Dự thảo Hợp đồng', 4), (2, 'Phê duyệt Chủ trương Cấp Quản lý', 5), (3, 'Thực hiện Ký kết Hợp đồng Chính thức', 4),
            (4, 'Bàn giao & Lưu trữ Kho Hồ sơ Hợp đồng', 4)) AS s(step_order, step_name, role_id)
    """,
    "step_roles": r"""
        WITH named AS (SELECT unnest(['Contract Negotiation', 'Legal Review', 'Technical Review', 'Security Review', 'Compliance Review', 'Finance Review',
            'Procurement Review', 'Manager Approval', 'Director Approval',
                'Executive Approval', 'Contract Signing', 'Document Archive']) AS step_name, unnest([4, 4, 7, 8, 9, 6, 10, 5, 11, 11, 4, 4]) AS role_id),
        every AS (SELECT step_name FROM {step} UNION ALL SELECT step_name FROM named)
        SELECT e.step_name, coalesce(n.role_id, 4) AS role_id, count(*) AS steps FROM every e LEFT JOIN named n ON n.step_name = e.step_name GROUP BY ALL
    """,
    "latest_workflow": "SELECT version_id, max(id) AS id, arg_max(workflow_type, id) AS workflow_type FROM {workflow_run} GROUP BY version_id",
    "workflow_replace": r"""
        SELECT id, version_id, workflow_type FROM {workflow_run} WHERE version_id % 5 <> 2 UNION ALL SELECT DISTINCT version_id + 1000000, version_id, 'WF_NEW'
            FROM {workflow_run} WHERE version_id % 5 = 2
    """,
    "workflow_replace_signatures": "SELECT a.id, a.workflow_id FROM (SELECT id, step_id AS workflow_id FROM {approval}) a WHERE a.workflow_id IN (SELECT id FROM {workflow_run} WHERE version_id % 5 <> 2)",
    "key_lifecycle": r"""
        WITH RECURSIVE keys AS (
            SELECT id, company_id, CAST(NULL AS BIGINT) AS previous_id, CAST(1 AS BIGINT) AS key_version FROM {key_event} WHERE action = 'CREATE'
            UNION ALL SELECT e.id, k.company_id, k.id, k.key_version + 1 FROM keys k JOIN {key_event} e ON e.key_id = k.id AND e.action = 'ROTATE' AND e.id > k.id
                AND NOT EXISTS (SELECT 1 FROM {key_event} r WHERE r.action = 'REVOKE' AND r.key_id = k.id AND r.id > k.id AND r.id < e.id))
        SELECT id, company_id, previous_id, key_version, CASE WHEN id IN (SELECT key_id FROM {key_event} WHERE action = 'REVOKE' AND key_id < id) THEN 'REVOKED'
            WHEN id IN (SELECT previous_id FROM keys WHERE previous_id IS NOT NULL) THEN 'ROTATED' ELSE 'ACTIVE' END AS status FROM keys
    """,
    "key_outcomes": r"""
        WITH RECURSIVE keys AS (
            SELECT id FROM {key_event} WHERE action = 'CREATE'
            UNION ALL SELECT e.id FROM keys k JOIN {key_event} e ON e.key_id = k.id AND e.action = 'ROTATE' AND e.id > k.id
                AND NOT EXISTS (SELECT 1 FROM {key_event} r WHERE r.action = 'REVOKE' AND r.key_id = k.id AND r.id > k.id AND r.id < e.id))
        SELECT id, CASE WHEN action = 'CREATE' THEN 'created' WHEN key_id IS NULL OR key_id >= id OR key_id NOT IN (SELECT id FROM keys) THEN 'missing' WHEN action = 'REVOKE' THEN 'revoked'
            WHEN id IN (SELECT id FROM keys) THEN 'rotated' ELSE 'refused' END AS outcome FROM {key_event}
    """,
    "required_fields": r"""
        SELECT id, CASE WHEN m = '' THEN '' ELSE 'Missing: ' || m END AS error FROM (SELECT id, concat_ws(', ', CASE WHEN company_id IS NULL THEN 'company_id'
            END, CASE WHEN key_alias = '' THEN 'key_alias' END,
            CASE WHEN key_reference IS NULL THEN 'key_reference' END) AS m FROM {key_request}) x
    """,
    "verify_proofs": r"""
        WITH now AS (SELECT *, sha256(CASE WHEN content <> '' THEN content ELSE contract_code || '-' || version_number || '-' || coalesce(change_summary, '') END) AS h FROM {proof}),
        told AS (SELECT n.version_id, s.document_hash AS proof_hash, CASE WHEN s.version_id IS NOT NULL THEN h END AS current_hash, CASE WHEN s.version_id IS NULL THEN 1
            WHEN s.document_hash <> n.h THEN 2
            WHEN b.version_id IS NOT NULL AND s.previous_hash IS DISTINCT FROM b.document_hash THEN 3
            WHEN n.version_id IN (SELECT version_id FROM {chain_tx} WHERE status = 'CONFIRMED') THEN 4 ELSE 5 END AS k
            FROM now n LEFT JOIN {stored_proof} s ON s.version_id = n.version_id LEFT JOIN {stored_proof} b ON b.version_id = n.previous_version_id)
        SELECT version_id, k >= 4 AS verified, ['No hash proof generated for this version.', 'Integrity check failed: document hash mismatch.',
            'Version chain integrity check failed: previous hash mismatch.',
            'Integrity successfully verified with blockchain anchors.', 'Integrity verified locally, but not anchored to the blockchain.'][k] AS message,
            proof_hash, current_hash, k = 4 AS anchored FROM told
    """,
    "verification_log": r"""
        WITH now AS (SELECT *, sha256(CASE WHEN content <> '' THEN content ELSE contract_code || '-' || version_number || '-' || coalesce(change_summary, '') END) AS h FROM {proof}),
        told AS (SELECT n.version_id, CASE WHEN s.version_id IS NULL THEN 1 WHEN s.document_hash <> n.h THEN 2
            WHEN b.version_id IS NOT NULL AND s.previous_hash IS DISTINCT FROM b.document_hash THEN 3
            WHEN n.version_id IN (SELECT version_id FROM {chain_tx} WHERE status = 'CONFIRMED') THEN 4 ELSE 5 END AS k
            FROM now n LEFT JOIN {stored_proof} s ON s.version_id = n.version_id LEFT JOIN {stored_proof} b ON b.version_id = n.previous_version_id)
        SELECT version_id, k >= 4 AS verify_result, ['No hash proof generated for this version.', 'Integrity check failed: document hash mismatch.',
            'Version chain integrity check failed: previous hash mismatch.',
            'Integrity successfully verified with blockchain anchors.', 'Integrity verified locally, but not anchored to the blockchain.'][k] AS reason,
            CAST(version_id % 2 + 7 AS BIGINT) AS user_id, CASE version_id % 2 WHEN 1 THEN 'morning' ELSE 'evening' END AS batch_id FROM told
    """,
    "proof_upsert": r"""
        SELECT version_id, sha256(CASE WHEN content <> '' THEN content ELSE contract_code || '-' || version_number || '-' || coalesce(change_summary, '') END) AS document_hash,
            CASE WHEN previous_version_id IS NOT NULL THEN sha256(CASE WHEN previous_content <> '' THEN previous_content
                ELSE previous_code || '-' || previous_number || '-' || coalesce(previous_change, '') END) END AS previous_hash
        FROM {proof} WHERE version_id % 3 = 0
        UNION ALL SELECT version_id, document_hash, previous_hash FROM {stored_proof} WHERE version_id % 3 <> 0
    """,
    "anchor_proofs": r"""
        SELECT DISTINCT ON (p.version_id) p.version_id, a.tx_id, a.block_number, a.block_hash, 'CONFIRMED' AS status, 'INVOKE' AS tx_type, 'System' AS sender
        FROM {stored_proof} p JOIN {ledger_answer} a ON a.version_id = p.version_id AND a.ok
        WHERE p.version_id NOT IN (SELECT version_id FROM {chain_tx} WHERE status = 'CONFIRMED') ORDER BY p.version_id, a.tx_id
    """,
    "anchor_audits": r"""
        SELECT min(a.tx_id) AS tx_id, 'Anchor Proof' AS action, 'HashProof:' || p.version_id AS resource, 'VERIFIED' AS after_state
        FROM {stored_proof} p JOIN {ledger_answer} a ON a.version_id = p.version_id WHERE a.ok AND NOT EXISTS
            (SELECT 1 FROM {chain_tx} t WHERE t.version_id = p.version_id AND t.status = 'CONFIRMED') GROUP BY p.version_id
    """,
    "latest_proof": "SELECT version_id, document_hash FROM {stored_proof} ORDER BY generated_at DESC, version_id DESC LIMIT 1",
    "newest_proofs": "SELECT version_id, document_hash, verified FROM {stored_proof} ORDER BY generated_at DESC, version_id DESC LIMIT 10",
    "chain_stats": r"""
        SELECT (SELECT count(*) FROM {chain_entry}) AS transactions, (SELECT max(block_number) FROM {chain_entry}) AS latest_block, (SELECT count(*) FROM {stored_proof}) AS proofs,
            (SELECT count(*) FROM {stored_proof} WHERE verified) AS verified_proofs, (SELECT count(*) FROM {certificate}) AS certificates, (SELECT count(*)
                FROM {sign_request}) AS signatures
    """,
    "proof_history": r"""
        SELECT p.version_id, t.id AS tx_id, t.status, count(a.id) AS audits, coalesce(string_agg(CAST(a.id AS VARCHAR), ',' ORDER BY a.id), '') AS audit_ids
        FROM {stored_proof} p JOIN {chain_tx} t ON t.version_id = p.version_id LEFT JOIN {chain_audit} a ON a.tx_id = t.id GROUP BY p.version_id, t.id, t.status
    """,
    "ledger_put_if_absent": r"""
        SELECT DISTINCT ON (record_key) record_key, tx_id, record FROM {ledger} WHERE NOT is_delete AND record_key NOT IN (SELECT 'COMPANY_' || id FROM
            {company}) ORDER BY record_key, tx_id
    """,
    "active_certificates": r"""
        SELECT id, user_id, strftime(valid_from + to_days(valid_days), '%Y-%m-%d %H:%M') AS valid_to FROM {certificate}
        WHERE status = 'ACTIVE' AND NOT revoked AND valid_from + to_days(valid_days) >= TIMESTAMP '2024-01-10 00:00:00'
    """,
    "signing_checks": r"""
        SELECT r.id, CASE WHEN c.id IS NULL THEN 'Signature certificate not found' WHEN c.user_id <> r.user_id THEN 'Certificate does not belong to the user'
            WHEN c.status <> 'ACTIVE' OR c.revoked THEN 'Certificate is not active or has been revoked'
            WHEN c.valid_from + to_days(c.valid_days) < TIMESTAMP '2024-01-10 00:00:00' THEN 'Certificate is expired' ELSE '' END AS error
        FROM {sign_request} r LEFT JOIN {certificate} c ON c.id = r.certificate_id
    """,
    "block_headers": r"""
        WITH n AS (SELECT number, previous_hash, data_hash, CASE WHEN length(h) % 2 = 1 THEN '0' || h ELSE h END AS h FROM (SELECT *, lower(to_hex(number)) AS h FROM {block}) x),
        d AS (SELECT *, CASE WHEN h[1] >= '8' THEN '00' || h ELSE h END AS digits FROM n),
        b AS (SELECT *, printf('02%02x', length(digits) // 2) || digits || printf('04%02x', length(previous_hash) // 2) || previous_hash || printf('04%02x',
            length(data_hash) // 2) || data_hash AS body FROM d)
        SELECT number, previous_hash, data_hash, sha256(unhex('30' || printf('%02x', length(body) // 2) || body)) AS block_hash FROM b
    """,
    "audit_classify": r"""
        WITH r AS (SELECT *, TRY_CAST(nullif(regexp_extract(path, '/contracts/([0-9]+)/(analyze|review|detail)/', 1), '') AS BIGINT) AS cid FROM {request} WHERE status_code < 400
            AND NOT (starts_with(path, '/static/') OR starts_with(path, '/media/') OR path = '/api/admin/stats/' OR path LIKE '%favicon%')),
        k AS (SELECT r.id, path, method, cid, c.contract_code AS code, coalesce(c.contract_code, '(ID: ' || cid || ')') AS which FROM r LEFT JOIN {contract} c ON c.id = r.cid)
        SELECT id, left(coalesce(CASE
            WHEN path = '/login/' AND method = 'POST' THEN 'Logged in successfully' WHEN path = '/logout/' THEN 'Logged out' WHEN path = '/admin-dashboard/'
                THEN 'Accessed custom Admin Dashboard'
            WHEN path LIKE '/api/admin/users/%/delete/%' THEN 'Admin request to delete user (ID: ' || string_split(path, '/')[-3] || ')'
            WHEN path LIKE '/api/admin/users/%/retry/%' THEN 'Admin request to retry anchoring user (ID: ' || string_split(path, '/')[-3] || ')'
            WHEN path = '/api/admin/config/ocr/' AND method = 'POST' THEN 'Admin changed system OCR configuration'
            WHEN path IN ('/api/contracts/', '/api/contracts/list/') THEN CASE WHEN method = 'POST' THEN 'Uploaded/Created a new contract' END
            WHEN path LIKE '%/analyze/%' THEN 'Triggered AI analysis for contract' || CASE WHEN code IS NULL THEN ' ' ELSE ': ' END || which
            WHEN path LIKE '%/review/%' THEN 'Submitted expert review for contract' || CASE WHEN code IS NULL THEN ' ' ELSE ': ' END || which
            WHEN path LIKE '%/detail/%' THEN 'Viewed contract details: ' || code
            WHEN path = '/identity/' THEN 'Accessed Identity Registry' WHEN path = '/api/companies/' AND method = 'POST' THEN 'Registered a new company node'
            WHEN path = '/api/register-user/' AND method = 'POST' THEN 'Registered a new decentralized staff identity' WHEN path = '/workflows/' THEN 'Accessed Workflow Board'
            WHEN path LIKE '%/approve/%' THEN 'Approved/Rejected workflow step' END,
            CASE WHEN method IN ('POST', 'PUT', 'DELETE', 'PATCH') THEN 'Performed ' || method || ' request on ' || path
                 WHEN method = 'GET' AND path NOT LIKE '/api/%' AND path NOT LIKE '/admin/%' THEN 'Visited page: ' || path END), 100) AS action FROM k
    """,
    "audit_mask": r"""
        WITH r AS (SELECT *, CASE event_id % 5 WHEN 0 THEN 'password' WHEN 1 THEN CASE WHEN event_id % 3 = 0 THEN 'secret' ELSE 'password_hash' END WHEN 2 THEN CASE
            WHEN event_id % 3 = 0 THEN 'note' ELSE 'secret' END
            ELSE 'note' END AS k FROM (SELECT *, id AS event_id FROM {request}) x)
        SELECT id, CASE WHEN forwarded_for <> '' THEN string_split(forwarded_for, ',')[1] ELSE remote_addr END AS ip_address,
            CASE WHEN method IN ('POST', 'PUT', 'DELETE', 'PATCH') THEN
                CASE WHEN id % 3 = 0 THEN '{"user": ["' || user_id || '"], "' || k || '": ["' || CASE WHEN k = 'note' THEN 'p ' || id ELSE '******' END || '"], "tag": ["a", "b"]}'
                     WHEN id % 17 IN (2, 4) THEN NULL
                     ELSE '{"user": ' || user_id || ', "' || k || '": "' || CASE WHEN k = 'note' THEN 'p' || id ELSE '******' END || '", "inner": {"secret": ' || id % 10 || '}}' END
                WHEN method = 'GET' AND id % 2 = 0 THEN '{"q": "last&", "page": "' || id % 10 || '"}' END AS payload FROM r
    """,
    "file_gate": r"""
        WITH p AS (SELECT page_id, lower(regexp_extract(regexp_replace(url, '[?#].*$', '') || CASE page_id % 4 WHEN 0 THEN '/a.PDF' WHEN 1 THEN '/b.docx' ELSE
            '' END, '(\.[A-Za-z0-9]+)$', 1)) AS ext, strlen(html) AS bytes FROM {pages})
        SELECT page_id, ext, CASE WHEN ext IN ('.docx', '.pdf', '.txt') THEN ext[2:] WHEN ext IN ('.png', '.jpg', '.jpeg') THEN 'image' END AS file_type,
            CASE ext WHEN '.docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN '.pdf' THEN 'application/pdf' WHEN '.png'
                THEN 'image/png' WHEN '.jpg' THEN 'image/jpeg'
                WHEN '.jpeg' THEN 'image/jpeg' WHEN '.txt' THEN 'text/plain' WHEN '.html' THEN 'text/html' ELSE 'application/octet-stream' END AS mime,
                    round(bytes / 1048576.0, 2) AS size_mb FROM p
    """,
    "page_scan_flags": r"""
        SELECT conv_id AS doc_id, count(*) AS pages, count(*) FILTER (length(replace(replace(text, ' ', ''), chr(10), '')) < 50) AS scan_pages,
            count(*) FILTER (length(replace(replace(text, ' ', ''), chr(10), '')) < 50) * 2 > count(*) AS is_scan,
            round(coalesce(avg(CASE WHEN role = 'user' THEN (turn % 10) / 10.0 END), 1.0), 4) AS ocr_confidence FROM {conversations} GROUP BY conv_id
    """,
    "law_article_lookup": r"""
        WITH asked AS (SELECT law_name, article_number FROM {law} UNION SELECT law_name, 'Article X' FROM {law})
        SELECT a.law_name, a.article_number, coalesce(l.law_name || ' - ' || l.article_number || ': ' || l.article_title || chr(10) || 'Nội dung: ' || l.content,
            'Không tìm thấy điều luật ' || a.article_number || ' của ' || a.law_name || '.') AS answer
        FROM asked a LEFT JOIN (SELECT DISTINCT ON (law_name, article_number) * FROM {law} ORDER BY law_name, article_number, law_id) l USING (law_name, article_number)
    """,
    "analysis_list": r"""
        WITH f AS (SELECT f.*, r.rule_name, r.severity, row_number() OVER (PARTITION BY f.analysis_id, r.rule_name ORDER BY f.id, f.risk_level, r.severity) AS n
            FROM {run_finding} f JOIN {rule} r ON r.id = f.rule_id),
        p AS (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY id, rule_name) AS place FROM f WHERE n = 1),
        shown AS (SELECT analysis_id, string_agg(rule_name || ':' || risk_level || ':' || severity, '; ' ORDER BY place) AS preview FROM p WHERE place <= 3 GROUP BY analysis_id)
        SELECT a.id, c.id AS contract_id, c.contract_code, c.title AS contract_title, c.status AS contract_status, a.model_name, coalesce(a.overall_score, 0) AS overall_score,
            CASE WHEN coalesce(a.overall_score, 0) >= 80 THEN 'HIGH' WHEN coalesce(a.overall_score, 0) >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS risk_label, a.summary,
            (SELECT count(*) FROM {run_finding} f WHERE f.analysis_id = a.id) AS findings_count, coalesce(s.preview, '') AS findings_preview, strftime(a.created_at, '%Y-%m-%d %H:%M') AS created_at
        FROM {analysis_run} a JOIN {version} v ON v.id = a.version_id JOIN {contract} c ON c.id = v.contract_id LEFT JOIN shown s ON s.analysis_id = a.id
    """,
    "entity_clear": r"""
        SELECT e.clause_id, e.entity_type FROM {clause_entity} e JOIN {clause} c ON c.id = e.clause_id
        WHERE c.version_id % 2 = 0 OR e.entity_type NOT IN ('COMPANY_NAME', 'TAX_CODE', 'CONTRACT_VALUE', 'DATE_EFFECTIVE', 'DATE_EXPIRE')
    """,
    "entity_spread": r"""
        WITH f AS (SELECT id, version_id, lower(trim(clause_title)) AS t, entity_type, entity_value, normalized_value, confidence FROM {api_entity}), c AS (SELECT id,
            version_id, lower(trim(title)) AS t FROM {clause}),
        m AS (SELECT f.*, c.id AS clause_id FROM f JOIN c ON c.version_id = f.version_id WHERE f.t = c.t OR f.t <> '' AND c.t <> '' AND (c.t LIKE '%' || f.t || '%' OR f.t LIKE '%' || c.t || '%')),
        fresh AS (SELECT DISTINCT ON (clause_id, entity_type, entity_value) clause_id, entity_type, entity_value, normalized_value, CAST(coalesce(confidence, 1) AS DECIMAL(5, 2)) AS confidence FROM m
            WHERE (clause_id, entity_type) NOT IN (SELECT (clause_id, entity_type) FROM {clause_entity} WHERE entity_type = 'DATE_EXPIRE' AND clause_id % 2 = 0) OR entity_value <> 'v0'
            ORDER BY clause_id, entity_type, entity_value, id)
        SELECT * FROM fresh UNION ALL SELECT clause_id, entity_type, 'v0', 'V0', CAST(0.5 AS DECIMAL(5, 2)) FROM {clause_entity} WHERE entity_type = 'DATE_EXPIRE' AND clause_id % 2 = 0
    """,
}
