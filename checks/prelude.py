"""Finance-shaped relations over the driver tables, in DuckDB SQL, for the oracle queries.

Written independently of the Spark code: each relation is the plain definition of the mapping.
"""

from __future__ import annotations

import re

BY = "fiscal_year, fiscal_quarter"


def mm(x: str, unit: str = "1e6", digits: int = 2) -> str:
    return f"(round(CAST(sum({x}) AS DOUBLE) / {unit}, {digits}) + 0.0)"


def inmm(x: str, unit: str = "1e6", digits: int = 2) -> str:
    return f"(round(CAST({x} AS DOUBLE) / {unit}, {digits}) + 0.0)"


def mean(x: str) -> str:
    return f"(CAST(sum(CAST({x} AS DECIMAL(24,6))) AS DOUBLE) / nullif(count({x}), 0))"


def pct(a: str, b: str, digits: int = 1) -> str:
    return f"(round(100.0 * (CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0.0)), {digits}) + 0.0)"


def fiscal(d: str) -> str:
    return f"CAST(year({d}) AS INT) AS fiscal_year, CAST(quarter({d}) AS INT) AS fiscal_quarter"


COUNTRY = ("['US','CA','MX','DE','FR','GB','IT','ES','NL','BE','PL','CZ','CN','JP','IN','KR','AU','SG','TH',"
           "'BR','AR','CL','CO','ZA','EG']")
CURRENCY = "['USD','EUR','GBP','JPY']"
TYPES = "['ECONOMY','LARGE','MEDIUM','PROMO','SMALL','STANDARD']"
SEGS = "['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY']"


def region(c: str) -> str:
    return (f"CASE WHEN {c} IN ('US','CA','MX') THEN 'NA'"
            f" WHEN {c} IN ('DE','FR','GB','IT','ES','NL','BE','PL','CZ') THEN 'EMEA'"
            f" WHEN {c} IN ('CN','JP','IN','KR','AU','SG','TH') THEN 'APAC'"
            f" WHEN {c} IN ('BR','AR','CL','CO') THEN 'LATAM' ELSE 'OTHER' END")


SEGNO = "coalesce(list_position(" + SEGS + ", c_mktsegment), 9)"
ACCOUNT = ("CASE p_type WHEN 'ECONOMY' THEN '5000' WHEN 'STANDARD' THEN '5030' WHEN 'LARGE' THEN '6020'"
           " WHEN 'MEDIUM' THEN '6030' WHEN 'PROMO' THEN '7000' ELSE '6040' END")
KIND = "CASE WHEN p_type IN ('ECONOMY','STANDARD') THEN 'COGS' WHEN p_type = 'PROMO' THEN 'RD' ELSE 'SGA' END"
CENTS = lambda c: f"CAST(round({c} * 100) AS BIGINT)"
LINE_ID = (f"md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, {CENTS('l_quantity')}, {CENTS('l_extendedprice')},"
           f" {CENTS('l_discount')}, {CENTS('l_tax')}, l_returnflag, l_linestatus, CAST(l_shipdate AS DATE) - DATE '1970-01-01'))")

CTES = {
    "inv": f"""
      SELECT {LINE_ID} AS invoice_line_id, l_orderkey AS invoice_id, l_linenumber AS line_number,
        CAST(l_suppkey AS VARCHAR) AS supplier_id, l_suppkey, l_linenumber, l_quantity, l_partkey,
        CASE WHEN l_returnflag = 'R' THEN 'N' ELSE 'Y' END AS po_matched_flag,
        CAST(o_orderdate AS DATE) AS invoice_date, o_orderpriority AS payment_terms,
        CAST(o_orderdate AS DATE) + 30 AS due_date,
        CASE WHEN l_linestatus = 'F' THEN CAST(l_shipdate AS DATE) END AS payment_date,
        CASE WHEN l_linestatus = 'F' THEN 'PAID'
             WHEN CAST(l_shipdate AS DATE) > CAST(o_orderdate AS DATE) + 30 THEN 'OPEN_PAST_DUE'
             ELSE 'OPEN_CURRENT' END AS payment_status,
        {CURRENCY}[o_custkey % 4 + 1] AS currency, c_mktsegment AS segment_code, c_mktsegment,
        CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, CAST(l_quantity AS DECIMAL(18,3)) AS quantity,
        p_type, p_brand, p_type AS true_category_primary, p_type || '/' || p_brand AS true_category_secondary,
        p_name AS line_description, {ACCOUNT} AS gl_account, {KIND} AS gl_account_type,
        {SEGNO} * 10000 + CAST({ACCOUNT} AS BIGINT) AS code_combination_id,
        CASE WHEN p_type IN ('ECONOMY','STANDARD') THEN 'Direct' ELSE 'Indirect' END AS direct_indirect,
        CASE WHEN l_suppkey % 10 <> 9 AND l_suppkey % 12 = 0 THEN 'Non-Addressable' ELSE 'Addressable' END AS addressability,
        {fiscal('o_orderdate')}
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
      JOIN part ON l_partkey = p_partkey""",
    "pay": """SELECT *, CASE WHEN payment_date IS NOT NULL THEN payment_date <= due_date END AS on_time,
        payment_date - invoice_date AS days_to_pay FROM inv""",
    "pred": """SELECT *,
        CASE WHEN l_quantity > 10 THEN CASE WHEN l_linenumber % 7 = 0 THEN 'SMALL' ELSE p_type END END AS pp,
        CASE WHEN l_quantity > 10 THEN
          CASE WHEN l_linenumber % 7 = 0 THEN 'SMALL' ELSE p_type END || '/' ||
          CASE WHEN l_linenumber % 7 = 0 OR l_linenumber % 5 = 0 THEN 'Brand#1' ELSE p_brand END END AS pl,
        CASE WHEN l_quantity > 10 THEN 0.5 + l_quantity / 100 END AS pc,
        CASE WHEN l_quantity > 10 THEN 0.4 + l_quantity / 100 END AS lc FROM inv""",
    "sup": f"""
      SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) AS supplier_id, {COUNTRY}[s_nationkey + 1] AS country_code,
        {region(COUNTRY + '[s_nationkey + 1]')} AS region,
        CASE WHEN s_suppkey % 10 <> 9 THEN s_name END AS supplier_name,
        CASE WHEN s_suppkey % 10 <> 9 THEN {TYPES}[s_suppkey % 6 + 1] END AS category_primary,
        CASE WHEN s_suppkey % 10 <> 9 THEN (s_suppkey % 30) / 100 END AS maverick_propensity,
        CASE WHEN s_suppkey % 10 <> 9 THEN {SEGS}[s_suppkey % 5 + 1] END AS segment_affinity,
        CASE WHEN s_suppkey % 10 <> 9 THEN ['Net15','Net30','Net45','Net60'][s_suppkey % 4 + 1] END AS payment_terms,
        CASE WHEN s_suppkey % 10 <> 9 THEN s_suppkey % 12 = 0 END AS is_regulated_supplier
      FROM supplier""",
    "pr": f"""
      SELECT o_orderkey, 'PR-' || o_orderkey AS pr_number, c_mktsegment AS segment_code,
        CASE o_orderstatus WHEN 'F' THEN 'released' WHEN 'O' THEN 'cancelled' WHEN 'P' THEN 'open' END AS pr_status,
        CAST(o_totalprice AS DECIMAL(18,2)) AS value, {fiscal('o_orderdate')}
      FROM orders JOIN customer ON o_custkey = c_custkey""",
    "po": "SELECT 'PO-' || o_orderkey AS po_number, pr_number, segment_code, value, fiscal_year, fiscal_quarter "
          "FROM pr WHERE pr_status = 'released'",
    "amend": "SELECT l_orderkey, sum(-CAST(l_extendedprice AS DECIMAL(18,2))) AS delta FROM lineitem "
             "WHERE l_returnflag = 'R' GROUP BY 1",
    "contract": f"""
      SELECT o_orderkey, 'C-' || o_orderkey AS contract_id, CAST(o_custkey AS VARCHAR) AS customer_id,
        c_mktsegment AS segment_code, CASE WHEN o_orderstatus = 'F' THEN 'Expired' ELSE 'Active' END AS status,
        o_orderpriority AS commercial_terms, CAST(o_orderdate AS DATE) AS start_date,
        CAST(o_orderdate AS DATE) + CAST(365 * (1 + o_orderkey % 3) AS INT) AS end_date,
        CAST(o_totalprice AS DECIMAL(18,2)) AS total_contract_value, coalesce(delta, 0) AS delta,
        CAST(o_totalprice AS DECIMAL(18,2)) + coalesce(delta, 0) AS value
      FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN amend ON l_orderkey = o_orderkey
      WHERE o_orderkey % 10 <> 3""",
    "bill": f"""
      SELECT o_orderkey, 'C-' || o_orderkey AS contract_id, CAST(o_custkey AS VARCHAR) AS customer_id,
        c_mktsegment AS segment_code, CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
        CAST(o_orderdate AS DATE) AS bill_date, {CURRENCY}[o_custkey % 4 + 1] AS currency,
        CASE o_orderstatus WHEN 'F' THEN 'Paid' WHEN 'O' THEN 'Scheduled' ELSE 'Billed' END AS status,
        {fiscal('o_orderdate')}
      FROM orders JOIN customer ON o_custkey = c_custkey""",
    "cust": f"""
      SELECT CAST(c_custkey AS VARCHAR) AS customer_id, c_name AS customer_name,
        {COUNTRY}[c_nationkey + 1] AS country_code, {region(COUNTRY + '[c_nationkey + 1]')} AS region,
        CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 10 <> 3)
             THEN c_mktsegment END AS primary_segment_code
      FROM customer""",
    "coa": f"""
      SELECT segment_code, n * 10000 + CAST(acc AS BIGINT) AS code_combination_id, CAST(n AS VARCHAR) AS entity_code,
        acc AS natural_account_code, 'Account ' || acc AS description,
        substr(segment_code, 1, 3) || '-CC' || substr(acc, 1, 1) AS cost_center_code,
        CASE WHEN acc IN ('5000','5030') THEN 'COGS' WHEN acc IN ('6020','6030','6040') THEN 'SGA'
             WHEN acc = '7000' THEN 'RD' WHEN acc = '4000' THEN 'REVENUE' ELSE 'BS' END AS account_type,
        CASE WHEN acc = '1000' THEN 'N' ELSE 'Y' END AS enabled_flag
      FROM (SELECT DISTINCT c_mktsegment AS segment_code, {SEGNO} AS n FROM customer),
           (SELECT unnest(['5000','5030','6020','6030','6040','7000','4000','1000','1100','2000']) AS acc)""",
    "doc": """
      SELECT invoice_id, min(invoice_date) AS invoice_date, min(currency) AS currency, min(c_mktsegment) AS segment_code,
        CASE WHEN count(payment_date) = count(*) THEN max(payment_date) END AS payment_date,
        sum(amount) AS total, count(*) AS n FROM inv GROUP BY 1""",
    "jl": f"""
      SELECT invoice_id * 10 + 1 AS je_header_id, 'Purchase Invoices' AS je_category, 'Payables' AS je_source,
        invoice_date AS posted_date, currency,
        CAST(row_number() OVER (PARTITION BY invoice_id ORDER BY line_number, invoice_line_id) AS INT) AS je_line_num,
        code_combination_id, amount AS dr, CAST(0 AS DECIMAL(18,2)) AS cr FROM inv
      UNION ALL SELECT invoice_id * 10 + 1, 'Purchase Invoices', 'Payables', invoice_date, currency,
        CAST(n + 1 AS INT), list_position({SEGS}, segment_code) * 10000 + 2000, 0, total FROM doc
      UNION ALL SELECT invoice_id * 10 + 2, 'Payments', 'Payables', payment_date, currency, 1,
        list_position({SEGS}, segment_code) * 10000 + 2000, total, 0 FROM doc WHERE payment_date IS NOT NULL
      UNION ALL SELECT invoice_id * 10 + 2, 'Payments', 'Payables', payment_date, currency, 2,
        list_position({SEGS}, segment_code) * 10000 + 1000, 0, total FROM doc WHERE payment_date IS NOT NULL
      UNION ALL SELECT o_orderkey * 10 + 3, 'Sales Invoices', 'Receivables', bill_date, currency, 1,
        list_position({SEGS}, segment_code) * 10000 + 1100, amount, 0 FROM bill
      UNION ALL SELECT o_orderkey * 10 + 3, 'Sales Invoices', 'Receivables', bill_date, currency, 2,
        list_position({SEGS}, segment_code) * 10000 + 4000, 0, amount FROM bill""",
    "gle": f"""
      SELECT jl.*, strftime(posted_date, '%Y-%m') AS period_name, coa.segment_code, coa.account_type,
        coa.natural_account_code, coa.cost_center_code, coa.description, {fiscal('posted_date')}
      FROM jl LEFT JOIN coa USING (code_combination_id)""",
    "act": """
      SELECT fiscal_year, fiscal_quarter, segment_code, account_type,
        CASE WHEN account_type = 'REVENUE' THEN sum(cr - dr) ELSE sum(dr - cr) END AS amount, count(*) AS entry_count
      FROM gle WHERE account_type IN ('REVENUE','COGS','SGA','RD','INTEREST','TAX') GROUP BY 1, 2, 3, 4""",
    "prior": """SELECT *, lag(amount) OVER (PARTITION BY segment_code, account_type
        ORDER BY fiscal_year, fiscal_quarter) AS was FROM act""",
    "plan": """SELECT *, CAST(was * CASE WHEN account_type = 'REVENUE' THEN 1.03 ELSE 1.02 END AS DECIMAL(18,2)) AS budget
        FROM prior""",
    "fc": """SELECT *, CAST(round((coalesce(budget, 0) + coalesce(was, budget, 0)) * 0.5, 2) AS DECIMAL(18,2)) AS forecast
        FROM plan""",
    "ci": f"""
      SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) AS supplier_id, ['SOW','PRICING_AGREEMENT','MSA'][s_suppkey % 3 + 1] AS contract_type,
        {region(COUNTRY + '[s_nationkey + 1]')} AS region,
        CASE WHEN s_acctbal >= 1000 THEN 'Active' WHEN s_acctbal >= 0 THEN 'Expired' ELSE 'Draft' END AS status,
        CAST(abs(s_acctbal) * 1000 AS DECIMAL(18,2)) AS committed, CAST(abs(s_acctbal) * 375 AS DECIMAL(18,2)) AS actual,
        DATE '1998-01-01' + CAST(s_suppkey % 1500 AS INT) AS expiration_date,
        'CW-' || s_suppkey || suffix AS contract_workspace_id
      FROM supplier, (SELECT unnest(['', '-B']) AS suffix) WHERE suffix = '' OR s_suppkey % 9 = 0""",
    "ev": """SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events""",
    "ver": """SELECT user_id, ts AS effective_from, event_type AS segment_code,
        lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt,
        CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS version_seq
        FROM ev WHERE seq = 1 OR event_type IS DISTINCT FROM was""",
    "snap": """
      SELECT d AS snapshot_date, CAST(year(d) AS INT) AS fiscal_year, CAST(day(d) AS INT) AS fiscal_quarter, segment_code,
        count(DISTINCT user_id) AS headcount,
        CAST(sum(CAST((50000 + user_id * 100) * 1.30 * 0.25 AS DECIMAL(18,2))) AS DOUBLE) AS cost
      FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events) JOIN ver
        ON CAST(d AS TIMESTAMP) >= effective_from AND (nxt IS NULL OR CAST(d AS TIMESTAMP) < nxt)
      WHERE segment_code <> 'error' GROUP BY d, segment_code""",
    "macro": """
      SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS m, count(*) AS n,
        CAST(sum(CAST(o_totalprice AS DECIMAL(24,6))) AS DOUBLE) / count(*) AS v FROM orders GROUP BY 1""",
}


def with_ctes(sql: str) -> str:
    """Prefix the relations a query uses, in dependency order."""
    chosen: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in chosen and re.search(rf"(?i)\b(from|join|,)\s+\(?{name}\b", text):
                visit(CTES[name])
                if name not in chosen:
                    chosen.append(name)

    visit(sql)
    if not chosen:
        return sql
    body = ",\n".join(f"{name} AS ({CTES[name]})" for name in chosen)
    own = re.match(r"(?is)\s*with\s+(.*)", sql)
    return f"WITH {body},\n{own.group(1)}" if own else f"WITH {body}\n{sql}"
