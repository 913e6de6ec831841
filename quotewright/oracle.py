"""The same answers in plain SQL over the test tables, for the comparison with DuckDB.

Written from the table definitions, not from the Spark plans: windows and CASE where the library uses
aggregates and joins.
"""

from __future__ import annotations

import re

_BLANK = "('', 'nan', 'none')"
_NULL_TOKENS = (
    "('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', "
    "'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null')"
)
_AS_OF = "'2024-06-30'"


def _nt(c: str) -> str:
    return f"CASE WHEN {c} NOT IN {_NULL_TOKENS} THEN {c} END"


def _num(c: str, t: str = "DECIMAL(12,2)") -> str:
    return f"try_cast({c} AS {t})"


def _dbl(expr: str) -> str:
    return f"CAST(round({expr}, 4) AS DOUBLE)"


def _yn(c: str) -> str:
    return f"CASE WHEN upper(trim({c})) IN ('YES', 'NO') THEN upper(trim({c})) ELSE 'NO' END"


def _day(c: str) -> str:
    return f"coalesce(CAST(try_cast({_nt(c)} AS DATE) AS VARCHAR), '')"


def _safe(c: str) -> str:
    return (
        f"coalesce(nullif(trim(regexp_replace(coalesce(trim({c}), ''), '[^A-Za-z0-9._-]+', '_', 'g'), '._'), ''), 'NA')"
    )


def _id_part(c: str, default: str) -> str:
    return f"coalesce(nullif(regexp_replace(trim({c}), '\\s+', ' ', 'g'), ''), '{default}')"


_CTES: dict[str, str] = {
    "base": """
        SELECT *, l_orderkey * 1000000000 + l_partkey * 10000 + l_suppkey AS _seq,
               'PN-' || CAST(l_partkey AS VARCHAR) AS part_code,
               c_name || '_REF-' || CAST(l_orderkey - l_orderkey % 2 AS VARCHAR) AS quote_id,
               CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS quantity
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation ON s_nationkey = n_nationkey""",
    "rq": """
        SELECT quote_id, CAST(l_linenumber AS VARCHAR) AS sl_no,
               CASE WHEN l_orderkey % 13 = 0 THEN 'bad' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS date,
               ' ' || replace(c_name, '#', '  ') AS customer_name, CAST(o_custkey AS VARCHAR) AS customer_id,
               'REF-' || CAST(l_orderkey - l_orderkey % 2 AS VARCHAR) AS customer_ref_no,
               CASE WHEN l_suppkey % 7 = 0 THEN ' ' ELSE '' END || part_code AS part_no, p_name AS description,
               CASE l_returnflag WHEN 'A' THEN 'ar' WHEN 'N' THEN 'NE' ELSE 'Rp' END AS cond,
               CASE WHEN l_partkey % 17 = 0 THEN 'n/a' ELSE quantity END AS qty,
               CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS due_date,
               CASE WHEN l_orderkey % 11 = 0 THEN ' deleted' WHEN o_orderstatus = 'O' THEN 'UPLOADED'
                    WHEN o_orderstatus = 'P' THEN 'assigned ' ELSE 'COMPLETED' END AS status,
               CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS created_date, _seq
        FROM base""",
    "rs": """
        SELECT 'SUB' || CAST(_seq AS VARCHAR) AS submission_id, quote_id, part_code AS part_no,
               CASE WHEN l_linenumber = 7 THEN '' WHEN l_linenumber = 6 AND l_suppkey % 2 = 0 THEN 'NaN'
                    ELSE s_name || ' ' END AS supplier,
               n_name AS supplier_country, 'WEB' AS supplier_source,
               CASE WHEN l_partkey % 19 = 0 THEN 'abc'
                    ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) END AS price,
               CASE l_returnflag WHEN 'A' THEN 'AR' WHEN 'N' THEN 'NE' ELSE 'RP' END AS cond_available,
               quantity AS qty_available, CAST(l_linenumber * 7 AS VARCHAR) AS lt,
               CASE WHEN l_linestatus = 'F' THEN 'YES' ELSE 'NO' END AS certificate_available,
               CASE WHEN l_linestatus = 'F' THEN part_code || '.pdf' END AS certificate_file,
               CASE WHEN l_linestatus = 'F' THEN 'COC' ELSE '' END AS certificate_type, 'remark' AS remarks,
               CAST(l_suppkey % 10 AS VARCHAR) AS worker_id, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS submitted_date,
               CASE l_suppkey % 5 WHEN 0 THEN ' yes' WHEN 1 THEN 'NO' WHEN 3 THEN 'maybe' WHEN 4 THEN 'no ' END AS edit_required,
               CASE WHEN l_linenumber = 7 THEN 'YES' ELSE 'no' END AS no_quote,
               CASE WHEN l_linenumber = 7 THEN 'no stock' ELSE '' END AS no_quote_remark, _seq
        FROM base WHERE l_linenumber <> 3""",
    "ra": """
        SELECT c_name || '_REF-' || CAST(o_orderkey - o_orderkey % 2 AS VARCHAR) AS quote_id, 'ALL' AS part_no,
               CAST(o_custkey % 10 AS VARCHAR) AS assigned_to,
               CASE WHEN o_orderkey % 9 = 0 THEN 'unknown' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS assigned_date,
               CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS worker_due_date, o_orderkey * 10 AS _seq
        FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'O'
        UNION ALL
        SELECT c_name || '_REF-' || CAST(o_orderkey - o_orderkey % 2 AS VARCHAR), 'ALL',
               CAST((o_custkey + 3) % 10 AS VARCHAR), CAST(CAST(o_orderdate AS DATE) AS VARCHAR),
               CAST(CAST(o_orderdate AS DATE) AS VARCHAR), o_orderkey * 10 + 1
        FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'O' AND o_orderkey % 4 = 0""",
    "rf": """
        SELECT quote_id, part_code AS part_no, s_name AS supplier, CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
               CAST(l_discount * 100 AS DECIMAL(6,2)) AS margin_percent,
               CASE WHEN l_linenumber = 2 THEN '' ELSE 'SUB' || CAST(_seq AS VARCHAR) END AS selected_submission_id,
               CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS generated_date, quantity, _seq
        FROM base WHERE l_suppkey % 4 = 0 AND l_linenumber NOT IN (3, 7)""",
    # clean tables
    "u": "SELECT CAST(n_nationkey AS VARCHAR) AS user_id, n_name AS username, CASE WHEN n_nationkey = 9 THEN 'admin' ELSE 'worker' END AS role FROM nation WHERE n_nationkey < 10",
    "q": f"""
        SELECT quote_id, sl_no, {_day('date')} AS date, customer_name, customer_id, customer_ref_no, trim(part_no) AS part_no,
               description, cond, {_nt('qty')} AS qty, {_day('due_date')} AS due_date, upper(trim(status)) AS status,
               {_day('created_date')} AS created_date, _seq FROM rq""",
    "s": f"""
        SELECT submission_id, quote_id, part_no,
               CASE WHEN lower(trim(supplier)) IN {_BLANK} THEN '' ELSE trim(supplier) END AS supplier,
               supplier_country, supplier_source, price, cond_available, qty_available, lt, certificate_available,
               certificate_file, {_nt('certificate_type')} AS certificate_type, remarks, worker_id, submitted_date,
               {_yn('edit_required')} AS edit_required, {_yn('no_quote')} AS no_quote,
               {_nt('no_quote_remark')} AS no_quote_remark, _seq FROM rs""",
    "a": f"SELECT quote_id, part_no, assigned_to, {_day('assigned_date')} AS assigned_date, worker_due_date, _seq FROM ra",
    "f": """
        SELECT quote_id, part_no, supplier, price, margin_percent,
               CAST(CAST(price AS DECIMAL(12,2)) * (1 + CAST(margin_percent AS DECIMAL(7,2)) * CAST(0.01 AS DECIMAL(3,2))) AS DECIMAL(18,4)) AS final_unit_price,
               CAST(CAST(price AS DECIMAL(12,2)) * (1 + CAST(margin_percent AS DECIMAL(7,2)) * CAST(0.01 AS DECIMAL(3,2))) * CAST(quantity AS DECIMAL(10,0)) AS DECIMAL(18,4)) AS final_total,
               nullif(selected_submission_id, '') AS selected_submission_id, generated_date, _seq FROM rf""",
    # common parts
    "open_q": "SELECT * FROM q WHERE status IS DISTINCT FROM 'DELETED'",
    "offers": "SELECT * FROM s WHERE no_quote = 'NO' AND supplier <> ''",
    "stored": "SELECT 'PN-' || CAST(p_partkey AS VARCHAR) || '.pdf' AS file_name FROM part WHERE p_size > 10",
    "gone": "SELECT DISTINCT quote_id FROM q WHERE status = 'DELETED'",
    "ref_first": """
        SELECT customer_ref_no, status AS first_status, quote_id AS first_quote_id FROM
        (SELECT *, row_number() OVER (PARTITION BY customer_ref_no ORDER BY _seq) AS rn FROM open_q) WHERE rn = 1""",
    "grid": """
        WITH lines AS (
          SELECT DISTINCT quote_id, part_no, customer_ref_no, description, qty, due_date FROM open_q
          WHERE customer_ref_no NOT IN (SELECT customer_ref_no FROM ref_first WHERE first_status = 'COMPLETED')),
        offered AS (
          SELECT DISTINCT customer_ref_no FROM lines l
          WHERE EXISTS (SELECT 1 FROM offers o WHERE o.quote_id = l.quote_id AND o.part_no = l.part_no)),
        saved AS (
          SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY selected_submission_id ORDER BY _seq DESC) AS rn
                         FROM f WHERE selected_submission_id IS NOT NULL) WHERE rn = 1)
        SELECT true AS "select", o.submission_id, l.quote_id, l.customer_ref_no, l.part_no, l.description,
               coalesce(try_cast(l.qty AS DECIMAL(12,2)), 1) AS qty, l.due_date AS customer_due_date, o.supplier,
               o.supplier_country, o.cond_available AS condition, o.lt AS lead_time,
               coalesce(try_cast(o.price AS DECIMAL(12,2)), 0) AS price,
               CAST(coalesce(v.margin_percent, 15) AS DECIMAL(7,2)) AS margin_percent, o._seq AS offer_seq
        FROM lines l LEFT JOIN offers o ON o.quote_id = l.quote_id AND o.part_no = l.part_no
        LEFT JOIN saved v ON v.selected_submission_id = o.submission_id
        WHERE l.customer_ref_no IN (SELECT customer_ref_no FROM offered)""",
    "edited": """
        SELECT * REPLACE (
          CASE WHEN g.submission_id IS NULL THEN 'true' WHEN o.certificate_available = 'YES' THEN 'true' ELSE 'false' END AS "select",
          CAST(CASE WHEN g.submission_id IS NULL THEN margin_percent WHEN o.cond_available = 'NE' THEN 12.5 ELSE 0 END AS DECIMAL(7,2)) AS margin_percent)
        FROM grid g
        LEFT JOIN (SELECT submission_id AS sid, certificate_available, cond_available FROM offers) o ON o.sid = g.submission_id""",
    "exportable": """
        SELECT f.selected_submission_id, f.quote_id, f.part_no, f.supplier, f.final_unit_price, f.final_total,
               s.cond_available, s.lt, s.certificate_type, s.certificate_file, l.customer_id, l.customer_ref_no,
               l.description, l.qty
        FROM f LEFT JOIN s ON s.submission_id = f.selected_submission_id AND s.quote_id = f.quote_id AND s.part_no = f.part_no
        JOIN open_q l ON l.quote_id = f.quote_id AND l.part_no = f.part_no""",
    "held": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY assigned_to, quote_id
          ORDER BY try_cast(assigned_date AS DATE) DESC NULLS FIRST, _seq DESC) AS rn FROM a) WHERE rn = 1""",
    "tasks": """
        SELECT h.assigned_to AS worker_id, h.quote_id, h.worker_due_date, h._seq AS assignment_seq, l.part_no,
               l.customer_ref_no, l.description, l.qty, l._seq
        FROM held h LEFT JOIN open_q l ON l.quote_id = h.quote_id
        WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.worker_id = h.assigned_to AND s.quote_id = h.quote_id
          AND s.part_no = l.part_no AND (s.no_quote = 'YES' OR s.edit_required = 'YES'))""",
    "meta": """
        SELECT quote_id, part_no, customer_ref_no, description, status FROM
        (SELECT *, row_number() OVER (PARTITION BY quote_id, part_no ORDER BY date DESC NULLS LAST, _seq DESC) AS rn FROM q)
        WHERE rn = 1""",
    "twice": """
        SELECT * REPLACE (_seq * 2 AS _seq) FROM s
        UNION ALL SELECT * REPLACE (_seq * 2 + 1 AS _seq, submission_id || 'X' AS submission_id) FROM s""",
    "asked": "SELECT quote_id, count(DISTINCT part_no) AS requested, bool_or(status IN ('DELETED', 'COMPLETED')) AS closed FROM q GROUP BY quote_id",
    "answered_all": "SELECT quote_id, count(DISTINCT part_no) AS answered FROM s GROUP BY quote_id",
    "complete": """
        SELECT quote_id, requested, answered FROM asked JOIN answered_all USING (quote_id)
        WHERE requested > 0 AND answered >= requested AND NOT closed""",
    "requests": """
        SELECT quote_id, part_no, ' House Stock' AS supplier, 'NATION_0' AS supplier_country, 'DESK' AS supplier_source,
               sl_no || '0.50' AS price, upper(cond) AS cond_available, qty AS qty_available, sl_no AS lt,
               CASE WHEN cond = 'ar' THEN 'YES' ELSE 'no' END AS certificate_available,
               CASE WHEN cond = 'ar' AND sl_no >= '4' THEN 'upload.pdf' END AS certificate_file,
               'COC' AS certificate_type, 'from stock' AS remarks, right(customer_id, 1) AS worker_id, _seq * 2 AS _seq
        FROM q WHERE status = 'ASSIGNED'
        UNION ALL
        SELECT quote_id, part_no, supplier, supplier_country, 'REQUOTE', price, cond_available, qty_available, lt,
               certificate_available, certificate_file, certificate_type, remarks, worker_id, _seq * 2 + 1
        FROM offers WHERE cond_available = 'RP'""",
    "offer_values": """
        SELECT * REPLACE (trim(supplier) AS supplier, upper(trim(certificate_available)) AS certificate_available,
                          CASE WHEN upper(certificate_available) = 'YES' THEN certificate_file ELSE '' END AS certificate_file,
                          CASE WHEN upper(certificate_available) = 'YES' THEN certificate_type ELSE '' END AS certificate_type)
        FROM requests WHERE try_cast(price AS DOUBLE) > 0 AND (upper(certificate_available) = 'NO' OR coalesce(certificate_file, '') <> '')""",
    "last_values": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY quote_id, part_no, supplier ORDER BY _seq DESC) AS rn,
          min(_seq) OVER (PARTITION BY quote_id, part_no, supplier) AS first_seq FROM offer_values) WHERE rn = 1""",
    "top": "SELECT max(CAST(substr(submission_id, 4) AS BIGINT)) AS top_id, max(_seq) AS top_seq FROM s",
    "new_values": """
        SELECT *, row_number() OVER (ORDER BY first_seq) AS k FROM last_values v
        WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.quote_id = v.quote_id AND s.part_no = v.part_no AND s.supplier = v.supplier)""",
    "submitted": f"""
        SELECT s.submission_id, s.quote_id, s.part_no, s.supplier,
          CASE WHEN v.rn = 1 THEN v.supplier_country ELSE s.supplier_country END AS supplier_country,
          CASE WHEN v.rn = 1 THEN v.supplier_source ELSE s.supplier_source END AS supplier_source,
          CASE WHEN v.rn = 1 THEN v.price ELSE s.price END AS price,
          CASE WHEN v.rn = 1 THEN v.cond_available ELSE s.cond_available END AS cond_available,
          CASE WHEN v.rn = 1 THEN v.qty_available ELSE s.qty_available END AS qty_available,
          CASE WHEN v.rn = 1 THEN v.lt ELSE s.lt END AS lt,
          CASE WHEN v.rn = 1 THEN v.certificate_available ELSE s.certificate_available END AS certificate_available,
          CASE WHEN v.rn = 1 THEN v.certificate_file ELSE s.certificate_file END AS certificate_file,
          CASE WHEN v.rn = 1 THEN v.certificate_type ELSE s.certificate_type END AS certificate_type,
          CASE WHEN v.rn = 1 THEN v.remarks ELSE s.remarks END AS remarks,
          CASE WHEN v.rn = 1 THEN v.worker_id ELSE s.worker_id END AS worker_id,
          CASE WHEN v.rn = 1 THEN {_AS_OF} ELSE s.submitted_date END AS submitted_date,
          CASE WHEN v.rn = 1 THEN 'NO' ELSE s.edit_required END AS edit_required,
          CASE WHEN v.rn = 1 THEN 'NO' ELSE s.no_quote END AS no_quote,
          CASE WHEN v.rn = 1 THEN '' ELSE s.no_quote_remark END AS no_quote_remark, s._seq
        FROM s LEFT JOIN last_values v ON v.quote_id = s.quote_id AND v.part_no = s.part_no AND v.supplier = s.supplier
        UNION ALL
        SELECT 'SUB' || lpad(CAST(top_id + k AS VARCHAR), CAST(greatest(4, length(CAST(top_id + k AS VARCHAR))) AS INTEGER), '0'), quote_id, part_no,
               supplier, supplier_country, supplier_source, price, cond_available, qty_available, lt, certificate_available,
               certificate_file, certificate_type, remarks, worker_id, {_AS_OF}, 'NO', 'NO', '', top_seq + k
        FROM new_values CROSS JOIN top""",
}


def _with(sql: str) -> str:
    """The statement behind the views that it needs, directly or through others."""
    needed: set[str] = set()
    texts = [sql]
    while texts:
        words = set(re.findall(r"\w+", texts.pop()))
        new = words.intersection(_CTES) - needed
        needed |= new
        texts += [_CTES[name] for name in new]
    head = "WITH RECURSIVE " if "FROM walk" in sql else "WITH "
    return head + ", ".join(f"{name} AS ({body})" for name, body in _CTES.items() if name in needed) + "\n" + sql


_Q = (
    "quote_id, sl_no, date, customer_name, customer_id, customer_ref_no, part_no, description, cond, qty, due_date, "
    "status, created_date, _seq"
)
_UNIT = "price * (1 + margin_percent * CAST(0.01 AS DECIMAL(3,2)))"
_GRID_MONEY = (
    f"{_dbl('price')} AS price, {_dbl('price * qty')} AS total_price, {_dbl('margin_percent')} AS margin_percent, "
    f"{_dbl(_UNIT)} AS final_unit_price, {_dbl(_UNIT + ' * qty')} AS final_total"
)
_FINAL_MONEY = ", ".join(f"{_dbl(c)} AS {c}" for c in ("price", "margin_percent", "final_unit_price", "final_total"))


def _money_text(c: str) -> str:
    return f"'$' || CAST(CAST({c} AS DECIMAL(18,4)) AS VARCHAR)"


def _set_status(cond: str, status: str) -> str:
    return f"SELECT * REPLACE (CASE WHEN {cond} THEN '{status}' ELSE status END AS status) FROM q"


_VALID_UPLOAD = f"""
    SELECT regexp_replace(trim(customer_name), '\\s+', ' ', 'g') || '_' || customer_ref_no AS quote_id, sl_no,
           CAST(try_cast(date AS DATE) AS VARCHAR) AS date, trim(customer_name) AS customer_name, customer_id, customer_ref_no,
           part_no, description, upper(cond) AS cond, {_dbl(_num('qty'))} AS qty, due_date, 'UPLOADED' AS status,
           {_AS_OF} AS created_date, _seq
    FROM rq WHERE try_cast(date AS DATE) IS NOT NULL AND {_num('qty')} IS NOT NULL"""
_INGEST = f"""
    SELECT * REPLACE ({_dbl(_num('qty'))} AS qty) FROM q
    UNION ALL
    SELECT * REPLACE ((SELECT max(_seq) FROM q) + 1 + {{place}} AS _seq) FROM ({_VALID_UPLOAD})"""

_LABELS = """
    , ranked AS (
        SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS r0 FROM {rows}),
    first_d AS (SELECT *, row_number() OVER (PARTITION BY {group}, quote_id ORDER BY r0) AS r1 FROM ranked WHERE r0 > 1 AND quote_id IS NOT NULL)"""

ORACLE: dict[str, str] = {
    "scan_tolerant": f"""
        SELECT quote_id, sl_no, {_nt('date')} AS date, customer_name, customer_id, customer_ref_no, part_no,
               CASE WHEN sl_no = '2' THEN description || ' "new"' || chr(10) || 'line' ELSE description END AS description,
               CASE WHEN cond <> 'NE' THEN cond END AS cond, CASE WHEN cond <> 'NE' THEN {_nt('qty')} END AS qty,
               CASE WHEN cond <> 'NE' THEN due_date END AS due_date, CASE WHEN cond <> 'NE' THEN status END AS status,
               CASE WHEN cond <> 'NE' THEN created_date END AS created_date
        FROM rq WHERE cond <> 'ar'""",
    "scan_missing": "SELECT * FROM q",
    "normalize_dates": f"SELECT _seq, {_day('date')} AS date, due_date, created_date, cond AS promise_date FROM rq",
    "null_tokens": f"""
        SELECT _seq, {_nt('supplier')} AS supplier, price, {_nt('certificate_type')} AS certificate_type, certificate_file,
               edit_required, {_nt('no_quote_remark')} AS no_quote_remark FROM rs""",
    "enforce_schema": f"""
        SELECT f.quote_id, f.part_no, f.supplier, {_dbl('f.price')} AS price, {_dbl('f.margin_percent')} AS margin_percent,
               CAST(NULL AS DOUBLE) AS final_unit_price, {_dbl('f.final_total')} AS final_total, rf.selected_submission_id,
               CAST(NULL AS VARCHAR) AS generated_date, f._seq FROM f JOIN rf ON f._seq = rf._seq""",
    "validate_columns": "SELECT sl_no, date, customer_name, customer_id, customer_ref_no, part_no, description, qty, cond, due_date, _seq FROM rq",
    "append_rows": f"""
        SELECT {_Q} FROM q UNION ALL
        SELECT quote_id, NULL, NULL, NULL, NULL, NULL, part_no, NULL, NULL, qty, NULL, NULL, NULL, _seq + 1 FROM q""",
    "roundtrip_table": "SELECT * FROM s",
    "import_replace": "SELECT quote_id, part_no, assigned_to, assigned_date, CAST(NULL AS VARCHAR) AS worker_due_date, _seq FROM ra",
    "export_view": "SELECT * EXCLUDE (sl_no) FROM q WHERE coalesce(status, '') NOT IN ('COMPLETED', 'DELETED')",
    "attachment_manifest": """
        SELECT DISTINCT l.customer_ref_no, trim(s.certificate_file) AS file_name
        FROM f JOIN s ON s.submission_id = f.selected_submission_id JOIN open_q l ON l.quote_id = f.quote_id
        WHERE trim(s.certificate_file) IN (SELECT file_name FROM stored)""",
    "missing_attachments": """
        SELECT submission_id, quote_id, part_no, supplier, certificate_file AS file_name FROM s
        WHERE certificate_file IS NOT NULL AND certificate_file NOT IN (SELECT file_name FROM stored)""",
    "bundle_files": """
        SELECT DISTINCT certificate_file AS file_name FROM s WHERE edit_required = 'NO' AND no_quote = 'NO'
        AND certificate_file IN (SELECT file_name FROM stored)""",
    "attachments_to_purge": """
        SELECT DISTINCT certificate_file AS file_name FROM s
        WHERE certificate_file IS NOT NULL AND quote_id IN (SELECT quote_id FROM gone)""",
    "ensure_columns": "SELECT _seq, supplier, lt, '' AS worker_name, '' AS description FROM s",
    "normalize_keys": "SELECT _seq, trim(quote_id) AS quote_id, trim(part_no) AS part_no, trim(customer_ref_no) AS customer_ref_no, trim(customer_name) AS customer_name FROM rq",
    "normalize_flag": f"SELECT _seq, {_yn('edit_required')} AS edit_required, {_yn('no_quote')} AS no_quote, 'NO' AS urgent FROM rs",
    "filter_text": """
        SELECT * FROM q WHERE regexp_matches(quote_id, 'CUSTOMER#0+[1-5]', 'i')
        AND regexp_matches(customer_ref_no, 'ref-.*[02468]$', 'i') AND regexp_matches(part_no, 'pn-1', 'i')""",
    "filter_in": "SELECT _seq, quote_id, status, cond FROM q WHERE status IN ('UPLOADED', 'COMPLETED') AND cond IN ('ar', 'Rp')",
    "quotes_active": "SELECT * EXCLUDE (sl_no) FROM q WHERE coalesce(status, '') NOT IN ('COMPLETED', 'DELETED')",
    "quotes_archive": "SELECT * EXCLUDE (sl_no) FROM q WHERE status = 'COMPLETED'",
    "quotes_deleted": "SELECT * EXCLUDE (sl_no) FROM q WHERE status = 'DELETED'",
    "quotes_not_deleted": "SELECT * FROM open_q",
    "ingest_valid": _VALID_UPLOAD,
    "upload_preview": f"""
        SELECT sl_no, date, customer_name, customer_id, customer_ref_no, part_no, description, {_dbl(_num('qty'))} AS qty, cond,
               due_date, _seq, regexp_replace(trim(customer_name), '\\s+', ' ', 'g') || '_' || customer_ref_no AS quote_id
        FROM rq WHERE {_num('qty')} IS NOT NULL""",
    "supplier_offers": "SELECT _seq, submission_id, quote_id, part_no, supplier, no_quote FROM offers",
    "offers_reviewable": "SELECT _seq, submission_id, edit_required, no_quote FROM s WHERE edit_required = 'NO' AND no_quote = 'NO'",
    "offers_no_quote": "SELECT _seq, submission_id, edit_required, no_quote FROM s WHERE no_quote = 'YES'",
    "offers_sent_back": "SELECT _seq, submission_id, edit_required, no_quote FROM s WHERE edit_required = 'YES' AND no_quote <> 'YES'",
    "selected_rows": """SELECT _seq, lt, CASE lt WHEN '7' THEN 'True' ELSE ' true ' END AS "select" FROM s WHERE lt IN ('7', '14')""",
    "quality_report": """
        SELECT 'quotes' AS table_name, 'date' AS check_name, count(*) AS row_count, CAST(count(*) FILTER (try_cast(date AS DATE) IS NULL) AS BIGINT) AS failed_count FROM q
        UNION ALL SELECT 'quotes', 'qty', count(*), count(*) FILTER (try_cast(qty AS DOUBLE) IS NULL) FROM q
        UNION ALL SELECT 'quotes', 'part_no', count(*), count(*) FILTER (part_no IS NULL) FROM q
        UNION ALL SELECT 'submissions', 'supplier', count(*), count(*) FILTER (supplier = '') FROM s
        UNION ALL SELECT 'submissions', 'price', count(*), count(*) FILTER (NOT coalesce(try_cast(price AS DOUBLE) > 0, false)) FROM s
        UNION ALL SELECT 'final_quotes', 'selected_submission_id', count(*), count(*) FILTER (selected_submission_id IS NULL) FROM f""",
    "export_blockers": "SELECT customer_ref_no, quote_id, part_no, supplier FROM exportable WHERE selected_submission_id IS NULL",
    "normalize_condition": """
        SELECT _seq, CASE cond WHEN 'ar' THEN 'AR' WHEN 'NE' THEN 'NE' ELSE 'RP' END AS cond_available FROM rq
        UNION ALL SELECT _seq + 1, 'NE' FROM rq""",
    "certificate_rule": """
        SELECT _seq, certificate_available,
               CASE WHEN certificate_available = 'YES' AND lt <> '7' THEN certificate_file ELSE '' END AS certificate_file,
               CASE WHEN certificate_available = 'YES' THEN 'COC' ELSE '' END AS certificate_type,
               NOT (certificate_available = 'YES' AND lt = '7') AS certificate_ok FROM rs""",
    "workers": """
        SELECT user_id AS worker_id, username, n AS submissions FROM u
        LEFT JOIN (SELECT worker_id, count(*) AS n FROM s GROUP BY worker_id) ON worker_id = user_id WHERE role = 'worker'""",
    "pending_quotes": f"""
        SELECT quote_id, count(part_no) AS part_count, {_dbl("sum(coalesce(" + _num('qty') + ", 0))")} AS total_qty
        FROM q WHERE status = 'UPLOADED' GROUP BY quote_id""",
    "assigned_parts": """
        SELECT q.quote_id, q.part_no, q.description, q.qty, q.status, u.username AS assigned_to_user, l.assigned_date, l.worker_due_date
        FROM q LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY quote_id ORDER BY _seq DESC) AS rn FROM a) l
          ON l.quote_id = q.quote_id AND l.rn = 1
        LEFT JOIN u ON u.user_id = l.assigned_to WHERE q.status = 'ASSIGNED'""",
    "offer_details": f"""
        SELECT s.submission_id, s.quote_id, l.customer_ref_no, s.part_no, s.supplier, s.supplier_country, s.supplier_source,
               s.cond_available, s.lt, s.remarks, coalesce(s.certificate_type, '') AS certificate_type,
               coalesce(u.username, '') AS worker_name, s.submitted_date, {_dbl(_num('s.price'))} AS price,
               {_dbl(_num('s.qty_available'))} AS qty_available
        FROM s LEFT JOIN (SELECT DISTINCT quote_id, part_no, customer_ref_no, description FROM q) l
          ON l.quote_id = s.quote_id AND l.part_no = s.part_no
        LEFT JOIN u ON u.user_id = s.worker_id WHERE s.edit_required = 'NO' AND s.no_quote = 'NO'""",
    "no_quote_report": """
        SELECT l.customer_ref_no AS ref_no, s.part_no, l.description, u.username AS worker, s.no_quote_remark AS remark,
               s.submitted_date AS date, 'NO QUOTE' AS status
        FROM s LEFT JOIN (SELECT DISTINCT quote_id, part_no, customer_ref_no, description FROM q) l
          ON l.quote_id = s.quote_id AND l.part_no = s.part_no
        LEFT JOIN u ON u.user_id = s.worker_id WHERE s.no_quote = 'YES'""",
    "offers_for_ref": """
        SELECT l.customer_ref_no, o.submission_id, o.quote_id, o.part_no, o.supplier
        FROM offers o JOIN (SELECT DISTINCT customer_ref_no, quote_id, part_no FROM open_q) l
          ON l.quote_id = o.quote_id AND l.part_no = o.part_no""",
    "margin_grid": f"""
        SELECT "select", submission_id, quote_id, customer_ref_no, part_no, description, {_dbl('qty')} AS qty, customer_due_date,
               supplier, supplier_country, condition, lead_time, {_GRID_MONEY}
        FROM grid""",
    "margin_progress": """
        SELECT r.customer_ref_no, r.first_quote_id, r.first_status, coalesce(n.requested, 0) AS requested,
               coalesce(o.answered, 0) AS answered, r.first_status = 'COMPLETED' AS locked,
               coalesce(o.answered, 0) < coalesce(n.requested, 0) AS partial
        FROM ref_first r
        LEFT JOIN (SELECT customer_ref_no, quote_id, count(DISTINCT part_no) AS requested FROM open_q GROUP BY ALL) n
          ON n.customer_ref_no = r.customer_ref_no AND n.quote_id = r.first_quote_id
        LEFT JOIN (SELECT quote_id, count(DISTINCT part_no) AS answered FROM offers GROUP BY quote_id) o
          ON o.quote_id = r.first_quote_id""",
    "margin_preview": f"""
        SELECT customer_ref_no, part_no, supplier, {_GRID_MONEY} FROM edited WHERE "select" = 'true' AND coalesce(supplier, '') <> ''""",
    "internal_quote": f"""
        SELECT customer_ref_no AS ref_no, part_no, description, {_dbl('qty')} AS qty, supplier, condition, lead_time,
               {_GRID_MONEY}, customer_due_date FROM edited""",
    "client_quote": f""",
        rows_out AS MATERIALIZED (SELECT * FROM exportable),
        blocked AS (SELECT DISTINCT customer_ref_no AS blocked_ref FROM rows_out WHERE selected_submission_id IS NULL)
        SELECT customer_id, customer_ref_no AS ref_no, part_no, description, qty, {_money_text('final_unit_price')} AS unit_price,
               {_money_text('final_total')} AS total_price, cond_available AS condition, lt AS lead_time_days,
               certificate_type, certificate_file
        FROM rows_out LEFT JOIN blocked ON blocked_ref = customer_ref_no WHERE blocked_ref IS NULL""",
    "worker_queue": "SELECT worker_id, quote_id, customer_ref_no, part_no, description, qty, 'EA' AS measure_unit, worker_due_date FROM tasks",
    "my_submissions": """
        SELECT worker_id, customer_ref_no, part_no, description, supplier, supplier_country, supplier_source, price,
               cond_available, qty_available, lt, certificate_available, certificate_type, submitted_date
        FROM (SELECT t.*, m.customer_ref_no, m.description,
                     row_number() OVER (PARTITION BY t.worker_id, t.quote_id, t.part_no, t.supplier ORDER BY t._seq) AS rn
              FROM twice t LEFT JOIN meta m ON m.quote_id = t.quote_id AND m.part_no = t.part_no
              WHERE m.status IS DISTINCT FROM 'DELETED' AND t.no_quote = 'NO' AND t.edit_required = 'NO' AND t.supplier <> '')
        WHERE rn = 1""",
    "my_sent_back": """
        SELECT s.worker_id, s.quote_id, m.customer_ref_no, s.part_no, m.description, s.supplier, s.price, s.cond_available,
               s.qty_available, s.lt, s.remarks
        FROM s LEFT JOIN meta m ON m.quote_id = s.quote_id AND m.part_no = s.part_no
        WHERE m.status IS DISTINCT FROM 'DELETED' AND s.edit_required = 'YES' AND s.no_quote <> 'YES'""",
    "my_no_quotes": """
        SELECT s.worker_id, m.customer_ref_no AS ref_no, s.part_no, m.description, s.no_quote_remark AS remark, 'NO QUOTE' AS status
        FROM s LEFT JOIN meta m ON m.quote_id = s.quote_id AND m.part_no = s.part_no
        WHERE m.status IS DISTINCT FROM 'DELETED' AND s.no_quote = 'YES'""",
    "quote_progress": """
        SELECT asked.quote_id, requested, closed, coalesce(answered, 0) AS answered, coalesce(by_supplier, 0) AS answered_by_supplier
        FROM asked LEFT JOIN answered_all USING (quote_id)
        LEFT JOIN (SELECT quote_id, count(DISTINCT part_no) AS by_supplier FROM offers GROUP BY quote_id) USING (quote_id)""",
    "quotes_fully_submitted": "SELECT * FROM complete",
    "next_submission_id": "SELECT top_id + 1 AS next_number, 'SUB' || CAST(top_id + 1 AS VARCHAR) AS next_id FROM top",
    "next_quote_number": "SELECT max(CAST(customer_id AS BIGINT)) + 1 AS next_number FROM q",
    "distinct_options": """
        SELECT DISTINCT 'status' AS field, status AS value FROM q WHERE status IS NOT NULL
        UNION ALL SELECT DISTINCT 'cond', cond FROM q WHERE cond IS NOT NULL
        UNION ALL SELECT DISTINCT 'quote_id', quote_id FROM q UNION ALL SELECT DISTINCT 'customer_ref_no', customer_ref_no FROM q""",
    "option_lists": """
        SELECT worker_id, string_agg(cond_available, ',' ORDER BY cond_available) AS options
        FROM (SELECT DISTINCT worker_id, cond_available FROM s) GROUP BY worker_id""",
    "ref_status": "SELECT * FROM ref_first",
    "sole_worker": """
        SELECT quote_id, part_no, CASE WHEN count(DISTINCT worker_id) = 1 THEN min(worker_id) END AS sole_worker
        FROM s WHERE edit_required = 'NO' AND no_quote = 'NO' GROUP BY quote_id, part_no""",
    "latest_assignment": "SELECT * EXCLUDE (rn) FROM held",
    "quote_meta_latest": "SELECT * FROM meta",
    "sent_back_latest": """
        SELECT * REPLACE ('sent twice' AS remarks, _seq + 5000 AS _seq) FROM s WHERE edit_required = 'YES' AND no_quote <> 'YES'""",
    "unique_labels": _LABELS.format(
        group="worker_id, part_no, description", order="assignment_seq, _seq NULLS FIRST", rows="tasks"
    ) + """,
        second_d AS (SELECT *, row_number() OVER (PARTITION BY worker_id, part_no, description, customer_ref_no ORDER BY r0) AS r2
                     FROM first_d WHERE r1 > 1 AND customer_ref_no IS NOT NULL),
        rest AS (SELECT *, row_number() OVER (PARTITION BY worker_id, part_no, description ORDER BY r0) AS r3 FROM first_d
                 WHERE r1 > 1 AND (customer_ref_no IS NULL OR (worker_id, r0, part_no, description) IN
                   (SELECT (worker_id, r0, part_no, description) FROM second_d WHERE r2 > 1)))
        SELECT worker_id, quote_id, part_no, description, assignment_seq,
               trim(coalesce(part_no, '') || ' | ' || coalesce(description, '')) || tail AS label
        FROM (SELECT worker_id, quote_id, part_no, description, assignment_seq, _seq, '' AS tail FROM ranked WHERE r0 = 1
              UNION ALL SELECT worker_id, quote_id, part_no, description, assignment_seq, _seq, ' | ' || quote_id FROM first_d WHERE r1 = 1
              UNION ALL SELECT worker_id, quote_id, part_no, description, assignment_seq, _seq, ' | ' || customer_ref_no FROM second_d WHERE r2 = 1
              UNION ALL SELECT worker_id, quote_id, part_no, description, assignment_seq, _seq, ' (#' || CAST(r3 + 1 AS VARCHAR) || ')' FROM rest)""",
    "offer_labels": _LABELS.format(
        group="worker_id, part_no, supplier_country", order="_seq",
        rows="(SELECT * FROM twice WHERE no_quote = 'NO' AND edit_required = 'NO' AND supplier <> '')",
    ) + """,
        rest AS (SELECT *, row_number() OVER (PARTITION BY worker_id, part_no, supplier_country ORDER BY r0) AS r3 FROM first_d WHERE r1 > 1)
        SELECT worker_id, submission_id, _seq, part_no || ' | ' || supplier_country || tail AS label
        FROM (SELECT worker_id, submission_id, _seq, part_no, supplier_country, '' AS tail FROM ranked WHERE r0 = 1
              UNION ALL SELECT worker_id, submission_id, _seq, part_no, supplier_country, ' | ' || quote_id FROM first_d WHERE r1 = 1
              UNION ALL SELECT worker_id, submission_id, _seq, part_no, supplier_country, ' (#' || CAST(r3 + 1 AS VARCHAR) || ')' FROM rest)""",
    "labels_across_bases": """
        , picks AS (
          SELECT quote_id, submission_id, row_number() OVER (PARTITION BY quote_id ORDER BY _seq) AS i,
                 cond_available || CASE _seq % 4 WHEN 1 THEN ' (#2)' WHEN 2 THEN ' | T' ELSE '' END AS base,
                 CASE WHEN _seq % 5 < 3 THEN 'T' END AS d1, supplier_source AS d2 FROM s),
        named AS (
          SELECT *, list_filter([base, base || ' | ' || d1, base || ' | ' || d2], lambda x: x IS NOT NULL) AS candidates,
                 list_transform(range(2, i + 3), lambda n: base || ' (#' || n || ')') AS numbers FROM picks),
        walk AS (
          SELECT DISTINCT quote_id, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS taken FROM named
          UNION ALL
          SELECT w.quote_id, n.i, list_append(w.taken, list_filter(list_concat(n.candidates, n.numbers),
                   lambda x: NOT list_contains(w.taken, x))[1])
          FROM walk w JOIN named n ON n.quote_id = w.quote_id AND n.i = w.i + 1)
        SELECT n.quote_id, n.submission_id, w.taken[n.i] AS label FROM named n JOIN walk w ON w.quote_id = n.quote_id AND w.i = n.i""",
    "assign_submission_ids": """
        SELECT quote_id, part_no, _seq, 'SUB' || CAST(top_id + row_number() OVER (ORDER BY _seq) AS VARCHAR) AS submission_id
        FROM q CROSS JOIN top""",
    # scalar functions
    "fn_trim_case": "SELECT _seq, trim(status) AS stripped, upper(status) AS upper_case, lower(status) AS lower_case, upper(trim(status)) AS status_code FROM rq",
    "fn_clean_text": "SELECT _seq, trim(supplier) AS supplier, coalesce(trim(edit_required), '') AS edit_required FROM rs",
    "fn_quote_id": f"""
        SELECT _seq, {_id_part('customer_name', 'UNKNOWN')} || '_' || CASE WHEN sl_no IN ('2', '3') THEN 'NOREF' ELSE customer_ref_no END AS built_id
        FROM rq""",
    "fn_safe_filename": f"SELECT _seq, {_safe('customer_name')} AS safe_name, {_safe(chr(39) + '._' + chr(39) + ' || quote_id || ' + chr(39) + '/é.' + chr(39))} AS safe_quote FROM rq",
    "fn_attachment_name": f"SELECT _seq, {_safe('quote_id')} || '_' || {_safe('part_no')} || '_' || {_safe('supplier')} || '.pdf' AS file_name FROM rs",
    "fn_safe_ref": "SELECT _seq, replace(replace(customer_ref_no || '/A b', ' ', '_'), '/', '-') AS safe_ref FROM rq",
    "fn_to_number": """
        SELECT _seq, try_cast(qty AS DOUBLE) AS qty, coalesce(try_cast(qty AS DOUBLE), 1.0) AS qty_or_one,
               CAST(NULL AS DOUBLE) AS suffixed, try_cast(qty AS DOUBLE) * 10 AS scaled FROM rq""",
    "fn_to_date": """
        SELECT _seq, CAST(try_cast(date AS DATE) AS VARCHAR) AS date, due_date AS us_date, true AS month_is_no_date FROM rq""",
    "fn_date_text": "SELECT _seq, coalesce(CAST(try_cast(assigned_date AS DATE) AS VARCHAR), '') AS assigned_date FROM ra",
    "fn_as_of": f"SELECT _seq, {_AS_OF} AS as_of FROM ra",
    "fn_submission_id": """
        SELECT _seq, _seq AS number, true AS twice_is_no_id, 'SUB' || CAST(_seq + 1 AS VARCHAR) AS next_id,
               'SUB' || lpad(lt, 4, '0') AS short_id FROM rs""",
    "fn_currency": """
        SELECT _seq, CASE WHEN no_quote = 'YES' THEN '' ELSE '$' || price END AS price, ' $' || price AS prefixed,
               '$' || certificate_file AS missing FROM rs""",
    "fn_total": f"SELECT _seq, {_dbl('coalesce(' + _num('price') + ', 0) * coalesce(' + _num('qty_available') + ', 1)')} AS total FROM rs",
    "fn_final_price": f"""
        SELECT _seq, {_dbl('price * (1 + CAST(margin_percent AS DECIMAL(7,2)) * CAST(0.01 AS DECIMAL(3,2)))')} AS unit,
               {_dbl('price * (1 + CAST(margin_percent AS DECIMAL(7,2)) * CAST(0.01 AS DECIMAL(3,2))) * 3')} AS total FROM rf""",
    "fn_cost_fallback": "SELECT _seq, cost_column, price AS cost FROM rs CROSS JOIN (VALUES ('price'), ('cost_price_ea'), ('cost')) v(cost_column)",
    "fn_bool": "SELECT _seq, lt NOT IN ('14', '28') AS ticked, lt = '7' AS is_first FROM rs",
    "fn_basename": "SELECT _seq, certificate_file AS file_name, remarks AS bare FROM rs",
    "fn_label": """
        SELECT _seq, trim(quote_id || ' | ' || part_no || ' | ' || trim(supplier)) AS label,
               CASE WHEN no_quote_remark = '' THEN 'N/A' ELSE no_quote_remark END AS remark_label FROM rs""",
    # batch changes
    "ingest_quotes": _INGEST.format(place="_seq - (SELECT min(_seq) FROM rq)"),
    "soft_delete": _set_status("quote_id IN (SELECT quote_id FROM q WHERE status = 'UPLOADED' AND cond = 'Rp')", "DELETED"),
    "complete_refs": _set_status(
        """customer_ref_no IN (SELECT customer_ref_no FROM exportable WHERE customer_ref_no NOT IN
           (SELECT customer_ref_no FROM exportable WHERE selected_submission_id IS NULL))""", "COMPLETED"),
    "purge_quotes": "SELECT * FROM q WHERE quote_id NOT IN (SELECT quote_id FROM gone)",
    "purge_assignments": "SELECT * FROM a WHERE quote_id NOT IN (SELECT quote_id FROM gone)",
    "purge_submissions": "SELECT * FROM s WHERE quote_id NOT IN (SELECT quote_id FROM gone)",
    "purge_final": f"""
        SELECT quote_id, part_no, supplier, {_FINAL_MONEY}, selected_submission_id, generated_date, _seq
        FROM f WHERE quote_id NOT IN (SELECT quote_id FROM gone)""",
}

_ACCEPTED = """
    , accepted AS (
        SELECT * FROM (
          SELECT quote_id, right(customer_id, 1) AS worker_id, due_date, _seq,
                 row_number() OVER (PARTITION BY quote_id ORDER BY _seq) AS rn
          FROM q WHERE status = 'UPLOADED' AND right(customer_id, 1) IN (SELECT user_id FROM u WHERE role = 'worker')
            AND quote_id NOT IN (SELECT quote_id FROM a)
            AND quote_id NOT IN (SELECT quote_id FROM (SELECT *, row_number() OVER (PARTITION BY quote_id ORDER BY _seq) AS r FROM q)
                                 WHERE r = 1 AND status = 'COMPLETED')) WHERE rn = 1)"""

ORACLE |= {
    "assign_quotes": _ACCEPTED + _set_status("status <> 'DELETED' AND quote_id IN (SELECT quote_id FROM accepted)", "ASSIGNED"),
    "assign_quotes_assignments": _ACCEPTED + f"""
        SELECT * FROM a UNION ALL
        SELECT quote_id, 'ALL', worker_id, {_AS_OF}, due_date, (SELECT max(_seq) FROM a) + 1 + _seq FROM accepted""",
    "edit_offers": """
        SELECT * EXCLUDE (hit, late) REPLACE (
          CASE WHEN hit THEN (CASE WHEN late THEN 'LATE' ELSE 'X' END) ELSE supplier_country END AS supplier_country,
          CASE WHEN hit THEN (CASE WHEN cond_available <> 'AR' THEN lt || '.25' END) ELSE price END AS price,
          CASE WHEN hit THEN 'OH' ELSE cond_available END AS cond_available,
          CASE WHEN hit THEN (CASE WHEN NOT late THEN qty_available END) ELSE qty_available END AS qty_available,
          CASE WHEN hit THEN '' ELSE remarks END AS remarks, CASE WHEN hit THEN 'FORM1' ELSE certificate_type END AS certificate_type)
        FROM (SELECT *, edit_required = 'NO' AND no_quote = 'NO' AS hit, lt = '7' AND cond_available <> 'AR' AS late FROM s)""",
    "send_back": """
        SELECT * EXCLUDE (hit) REPLACE (CASE WHEN hit THEN 'YES' ELSE edit_required END AS edit_required,
                          CASE WHEN hit THEN right(part_no, 1) ELSE worker_id END AS worker_id)
        FROM (SELECT *, certificate_available = 'YES' AND edit_required = 'NO' AND no_quote = 'NO' AND right(part_no, 1) <> '9' AS hit FROM s)""",
    "attach_certificates": f"""
        SELECT * EXCLUDE (hit) REPLACE (
          CASE WHEN hit THEN {_safe('quote_id')} || '_' || {_safe('part_no')} || '_' || {_safe('supplier')} || '.pdf' ELSE certificate_file END AS certificate_file,
          CASE WHEN hit THEN 'YES' ELSE certificate_available END AS certificate_available,
          CASE WHEN hit AND cond_available = 'NE' THEN 'EASA' ELSE certificate_type END AS certificate_type)
        FROM (SELECT *, no_quote = 'NO' AND supplier <> '' AND certificate_available = 'NO' AS hit FROM s)""",
    "resubmit": f"""
        SELECT * EXCLUDE (hit) REPLACE (
          CASE WHEN hit THEN 'RE' ELSE supplier_country END AS supplier_country, CASE WHEN hit THEN 'MAIL' ELSE supplier_source END AS supplier_source,
          CASE WHEN hit THEN '5' ELSE qty_available END AS qty_available, CASE WHEN hit THEN 'again' ELSE remarks END AS remarks,
          CASE WHEN NOT hit THEN certificate_available WHEN lt IN ('7', '14') THEN 'YES' ELSE 'NO' END AS certificate_available,
          CASE WHEN NOT hit THEN certificate_file WHEN lt = '7' THEN 'new.pdf' WHEN lt = '14' THEN coalesce(certificate_file, '') ELSE '' END AS certificate_file,
          CASE WHEN NOT hit THEN certificate_type WHEN lt IN ('7', '14') THEN '8130' ELSE '' END AS certificate_type,
          CASE WHEN hit THEN {_AS_OF} ELSE submitted_date END AS submitted_date, CASE WHEN hit THEN 'NO' ELSE edit_required END AS edit_required)
        FROM (SELECT *, edit_required = 'YES' AND no_quote <> 'YES' AND coalesce(try_cast(price AS DOUBLE) > 0, false) AS hit FROM s)""",
    "valid_submissions": """
        SELECT r._seq, r.worker_id, r.quote_id, r.part_no, r.supplier FROM requests r
        WHERE EXISTS (SELECT 1 FROM open_q l WHERE l.quote_id = r.quote_id AND l.part_no = r.part_no)
          AND EXISTS (SELECT 1 FROM tasks t WHERE t.worker_id = r.worker_id AND t.quote_id = r.quote_id AND t.part_no = r.part_no)
          AND r.quote_id NOT IN (SELECT quote_id FROM (SELECT *, row_number() OVER (PARTITION BY quote_id ORDER BY _seq) AS rn FROM open_q)
                                 WHERE rn = 1 AND status = 'COMPLETED')""",
    "rejected_submissions": """
        SELECT r._seq, r.worker_id, r.quote_id, r.part_no, r.supplier FROM requests r
        WHERE NOT EXISTS (SELECT 1 FROM open_q l WHERE l.quote_id = r.quote_id AND l.part_no = r.part_no)
           OR NOT EXISTS (SELECT 1 FROM tasks t WHERE t.worker_id = r.worker_id AND t.quote_id = r.quote_id AND t.part_no = r.part_no)""",
    "submit_offers": "SELECT * FROM submitted",
    "submit_offers_quotes": _set_status(
        """status <> 'SUBMITTED' AND quote_id IN (SELECT quote_id FROM offer_values) AND quote_id IN (
           SELECT quote_id FROM asked JOIN (SELECT quote_id, count(DISTINCT part_no) AS answered FROM submitted GROUP BY quote_id) USING (quote_id)
           WHERE requested > 0 AND answered >= requested AND NOT closed)""", "SUBMITTED"),
    "promote_submitted": _set_status("quote_id IN (SELECT quote_id FROM complete)", "SUBMITTED"),
    "mark_no_quote": f"""
        , asks AS (
            SELECT *, row_number() OVER (ORDER BY rank_seq) AS k FROM (
              SELECT worker_id, quote_id, part_no, 'none for ' || part_no AS remark, _seq * 10 + CAST(worker_id AS INTEGER) AS rank_seq
              FROM tasks WHERE part_no IS NOT NULL AND description NOT LIKE 'red%')),
        last_asks AS (
            SELECT *, row_number() OVER (PARTITION BY worker_id, quote_id, part_no ORDER BY k DESC) AS rn,
                   min(k) OVER (PARTITION BY worker_id, quote_id, part_no) AS first_k FROM asks),
        marks AS (SELECT worker_id, quote_id, part_no, remark, first_k, 'SUB' || CAST(top_id + k AS VARCHAR) AS new_id
                  FROM last_asks CROSS JOIN top WHERE rn = 1)
        SELECT CASE WHEN m.new_id IS NULL THEN s.submission_id ELSE m.new_id END AS submission_id, s.quote_id, s.part_no, s.supplier,
          CASE WHEN m.new_id IS NULL THEN s.supplier_country ELSE '' END AS supplier_country,
          CASE WHEN m.new_id IS NULL THEN s.supplier_source ELSE '' END AS supplier_source,
          CASE WHEN m.new_id IS NULL THEN s.price END AS price,
          CASE WHEN m.new_id IS NULL THEN s.cond_available ELSE '' END AS cond_available,
          CASE WHEN m.new_id IS NULL THEN s.qty_available END AS qty_available,
          CASE WHEN m.new_id IS NULL THEN s.lt ELSE '' END AS lt,
          CASE WHEN m.new_id IS NULL THEN s.certificate_available ELSE 'NO' END AS certificate_available,
          CASE WHEN m.new_id IS NULL THEN s.certificate_file ELSE '' END AS certificate_file,
          CASE WHEN m.new_id IS NULL THEN s.certificate_type ELSE '' END AS certificate_type,
          CASE WHEN m.new_id IS NULL THEN s.remarks ELSE 'NO QUOTE' END AS remarks, s.worker_id,
          CASE WHEN m.new_id IS NULL THEN s.submitted_date ELSE {_AS_OF} END AS submitted_date,
          CASE WHEN m.new_id IS NULL THEN s.edit_required ELSE 'NO' END AS edit_required,
          CASE WHEN m.new_id IS NULL THEN s.no_quote ELSE 'YES' END AS no_quote,
          CASE WHEN m.new_id IS NULL THEN s.no_quote_remark ELSE m.remark END AS no_quote_remark, s._seq
        FROM s LEFT JOIN marks m ON s.supplier = '' AND m.quote_id = s.quote_id AND m.part_no = s.part_no AND m.worker_id = s.worker_id
        UNION ALL
        SELECT new_id, quote_id, part_no, '', '', '', NULL, '', NULL, '', 'NO', '', '', 'NO QUOTE', worker_id, {_AS_OF}, 'NO', 'YES',
               remark, top_seq + first_k
        FROM marks m CROSS JOIN top
        WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.supplier = '' AND s.quote_id = m.quote_id AND s.part_no = m.part_no AND s.worker_id = m.worker_id)""",
    "offer_from_no_quote": f"""
        , claimed AS (
            SELECT * REPLACE ('Alt Source' AS supplier, 'PHONE' AS supplier_source, '9.75' AS price, 'NO' AS certificate_available,
              '' AS certificate_file, '' AS certificate_type, 'found' AS remarks, {_AS_OF} AS submitted_date, 'NO' AS edit_required,
              'NO' AS no_quote, '' AS no_quote_remark) FROM s WHERE no_quote = 'YES'
            UNION ALL SELECT * FROM s WHERE no_quote <> 'YES'),
        wanted AS (
            SELECT *, row_number() OVER (ORDER BY first_seq) AS k FROM (
              SELECT *, row_number() OVER (PARTITION BY quote_id, part_no ORDER BY _seq DESC) AS rn,
                     min(_seq * 2 + 1) OVER (PARTITION BY quote_id, part_no) AS first_seq FROM s WHERE no_quote = 'YES') WHERE rn = 1)
        SELECT * FROM claimed UNION ALL
        SELECT 'SUB' || CAST(top_id + k AS VARCHAR), quote_id, part_no, 'Second Source', supplier_country, 'PHONE', '11', cond_available,
               qty_available, lt, 'NO', '', '', 'found', worker_id, {_AS_OF}, 'NO', 'NO', '', top_seq + k
        FROM wanted CROSS JOIN top""",
    "save_final": f""",
        draft AS MATERIALIZED (SELECT * FROM edited),
        drafted AS (SELECT DISTINCT quote_id AS drafted_id FROM draft)
        SELECT quote_id, part_no, supplier, {_FINAL_MONEY}, selected_submission_id, generated_date
        FROM f LEFT JOIN drafted ON drafted_id = quote_id WHERE drafted_id IS NULL
        UNION ALL
        SELECT quote_id, part_no, supplier, {_dbl('price')}, {_dbl('margin_percent')}, {_dbl(_UNIT)}, {_dbl(_UNIT + ' * qty')},
               submission_id, {_AS_OF} FROM draft WHERE "select" = 'true' AND coalesce(supplier, '') <> ''""",
    "stream_submit_offers": "SELECT * FROM submitted",
    "stream_ingest_quotes": _INGEST.format(place="place").replace(
        f"FROM ({_VALID_UPLOAD})",
        f"FROM (SELECT v.* REPLACE (place AS _seq) FROM ({_VALID_UPLOAD}) v JOIN "
        "(SELECT _seq, row_number() OVER (ORDER BY _seq) - 1 AS place FROM rq) p ON p._seq = v._seq)",
    ).replace("+ 1 + place AS _seq", "+ 1 + _seq AS _seq"),
}


_S = (
    "submission_id, quote_id, part_no, supplier, supplier_country, supplier_source, price, cond_available, qty_available, lt, "
    "certificate_available, certificate_file, certificate_type, remarks, worker_id, submitted_date, edit_required, no_quote, "
    "no_quote_remark, _seq"
)
_TO_DELETE = "SELECT quote_id FROM q WHERE status = 'UPLOADED' AND cond = 'Rp'"

ORACLE |= {
    "versioned_submissions": ORACLE["submit_offers"],
    "stream_compacted_offers": ORACLE["stream_submit_offers"],
    "versioned_progress": f"""
        SELECT l.quote_id, l.requested, coalesce(o.answered, 0) AS answered, l.closed
        FROM (SELECT quote_id, count(DISTINCT part_no) AS requested,
                     bool_or(coalesce(status IN ('DELETED', 'COMPLETED'), false) OR quote_id IN ({_TO_DELETE})) AS closed
              FROM q GROUP BY quote_id) l
        LEFT JOIN (SELECT quote_id, count(DISTINCT part_no) AS answered FROM submitted GROUP BY quote_id) o USING (quote_id)""",
    "affected_rows": f""",
        after_q AS ({ORACLE["submit_offers_quotes"]}),
        deleted_ids AS (SELECT quote_id FROM gone UNION {_TO_DELETE})
        SELECT 'submit_offers' AS change, 'submissions' AS table_name,
               (SELECT count(*) FROM (SELECT {_S} FROM submitted WHERE _seq IN (SELECT _seq FROM s) EXCEPT SELECT {_S} FROM s)) AS updated,
               (SELECT count(*) FROM submitted) - (SELECT count(*) FROM s) AS inserted, 0 AS deleted
        UNION ALL SELECT 'submit_offers', 'quotes', (SELECT count(*) FROM (SELECT {_Q} FROM after_q EXCEPT SELECT {_Q} FROM q)), 0, 0
        UNION ALL SELECT 'soft_delete', 'quotes',
               (SELECT count(*) FROM q WHERE quote_id IN ({_TO_DELETE}) AND status IS DISTINCT FROM 'DELETED'), 0, 0
        UNION ALL SELECT 'purge_deleted', 'quotes', 0, 0, (SELECT count(*) FROM q WHERE quote_id IN (SELECT quote_id FROM deleted_ids))
        UNION ALL SELECT 'purge_deleted', 'assignments', 0, 0, (SELECT count(*) FROM a WHERE quote_id IN (SELECT quote_id FROM deleted_ids))
        UNION ALL SELECT 'purge_deleted', 'submissions', 0, 0, (SELECT count(*) FROM submitted WHERE quote_id IN (SELECT quote_id FROM deleted_ids))
        UNION ALL SELECT 'purge_deleted', 'final_quotes', 0, 0, (SELECT count(*) FROM f WHERE quote_id IN (SELECT quote_id FROM deleted_ids))""",
}


def oracle_sql() -> dict[str, str]:
    return {name: _with(sql) for name, sql in ORACLE.items()}
