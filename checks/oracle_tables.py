"""Oracle SQL for conformed tables, facts, postings, history, allocation and series."""

from checks.prelude import BY, COUNTRY, CURRENCY, LINE_ID, SEGS, TYPES, fiscal, region

D = lambda x, n: f"CAST({x} AS DOUBLE) AS {n}"
G = f"{BY}, segment_code"
SUP = "supplier_id, supplier_name, country_code, region, {lang} AS language_code, {made} AS created_date, category_primary, " \
      "{sec} AS category_secondary_json, maverick_propensity, segment_affinity, payment_terms, is_regulated_supplier"
NAMED = "s_suppkey % 10 <> 9"
SUP_NAMED = SUP.format(lang="'EN'", made="DATE '1995-01-01' + CAST(s_suppkey % 1000 AS INT)", sec="'[]'")
SUP_ALL = SUP.format(lang=f"CASE WHEN {NAMED} THEN 'EN' END",
                     made=f"CASE WHEN {NAMED} THEN DATE '1995-01-01' + CAST(s_suppkey % 1000 AS INT) END",
                     sec=f"CASE WHEN {NAMED} THEN '[]' END")
COMPANY = "['1100','1200','1300','1400','1900','9999'][o_custkey % 6 + 1]"
CO_SEG = "['HAD','HPA','HSB','HET','CORP','OTHER'][o_custkey % 6 + 1]"
LEAF = f"{TYPES}[l_partkey % 6 + 1]"
TERMS = "['Net15','Net30','Net45','Net60'][o_custkey % 4 + 1]"
ODATE = "CAST(o_orderdate AS DATE)"

SQL = {
    "silver_supplier": f"""
        SELECT 'sap_ariba' AS source_system, 'LFA1_SUPPLIER_MASTER' AS source_table, supplier_id AS source_primary_key,
          {SUP_NAMED}, CAST(NULL AS VARCHAR) AS supplier_canonical_id, CAST(NULL AS VARCHAR) AS entity_resolution_cluster_id
        FROM sup WHERE {NAMED}
        UNION ALL SELECT 'oracle_fusion', 'ap_supplier_sites_all', CAST(s_suppkey + 500000 AS VARCHAR), supplier_id, NULL,
          country_code, region, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
        FROM sup WHERE s_suppkey % 3 = 0 OR s_suppkey % 10 = 9""",
    "dim_supplier_dedup": f"""SELECT {SUP_ALL}, supplier_id AS canonical_supplier_id,
        CAST(NULL AS VARCHAR) AS entity_resolution_cluster_id FROM sup""",
    "customer_master": """SELECT 'oracle_fusion' AS source_system, 'ar_customer_sites_all+cms' AS source_table,
        customer_id AS source_primary_key, customer_id, customer_name, country_code, region, primary_segment_code FROM cust""",
    "dim_customer": "SELECT customer_id, customer_name, country_code, region, primary_segment_code FROM cust",
    "purchase_requests": f"""SELECT l_orderkey || '/' || lpad(CAST(l_linenumber AS VARCHAR), 4, '0') AS source_primary_key,
        CAST(l_orderkey AS VARCHAR) AS pr_number, l_linenumber AS pr_line_num, {COMPANY} AS company_code, {CO_SEG} AS segment_code,
        {ODATE} AS pr_created_date, {ODATE} + 14 AS requested_delivery_date,
        CASE o_orderstatus WHEN 'F' THEN 'B' WHEN 'O' THEN 'L' ELSE 'X' END AS pr_status_code,
        CASE o_orderstatus WHEN 'F' THEN 'released' WHEN 'O' THEN 'cancelled' ELSE 'x' END AS pr_status,
        CAST(l_suppkey AS VARCHAR) AS intended_supplier_id, CAST(l_partkey AS VARCHAR) AS material_number,
        {D('l_quantity', 'quantity')}, {D('l_extendedprice', 'estimated_unit_price')}, 1 AS price_unit,
        {LEAF} AS true_category_primary, {fiscal('o_orderdate')} FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "purchase_orders": f"""SELECT l_orderkey * 100 + l_linenumber AS po_line_id, 'PO-' || l_orderkey AS po_number,
        l_linenumber AS po_line_num, CAST(o_custkey % 100 AS VARCHAR) AS supplier_id, {ODATE} AS po_created_date,
        {ODATE} + 10 AS po_approved_date, CAST(year({ODATE} + 10) AS INT) AS fiscal_year,
        CAST(quarter({ODATE} + 10) AS INT) AS fiscal_quarter, ['HAD','HPA','HSB','HET'][l_suppkey % 4 + 1] AS segment_code,
        {D('l_quantity', 'quantity')}, {D('CAST(l_tax AS DECIMAL(18,2))', 'unit_price')},
        {D('CAST(CAST(l_quantity AS DECIMAL(18,3)) * CAST(l_tax AS DECIMAL(18,2)) AS DECIMAL(18,2))', 'extended_amount')},
        CAST(l_orderkey AS VARCHAR) AS source_pr_number, l_linenumber AS source_pr_line_num
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "ap_invoice_lines": f"""WITH x AS (SELECT *, CASE WHEN o_orderstatus = 'F' THEN {ODATE} + CAST(o_custkey % 60 AS INT) END AS paid
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
        SELECT CAST(l_orderkey * 100 + l_linenumber AS VARCHAR) AS source_primary_key,
        l_orderkey * 100 + l_linenumber AS invoice_line_id, l_orderkey AS invoice_id, 'INV-' || l_orderkey AS invoice_number,
        CAST(o_custkey % 100 AS VARCHAR) AS supplier_id, CASE WHEN o_orderstatus = 'P' THEN 'N' ELSE 'Y' END AS po_matched_flag,
        CASE WHEN o_orderstatus <> 'P' THEN o_orderkey END AS source_po_header_id, l_partkey AS po_line_id,
        {ODATE} AS invoice_date, strftime(o_orderdate, '%Y-%m') AS period_name, {TERMS} AS payment_terms,
        {ODATE} + 30 AS due_date, paid AS payment_date,
        CASE WHEN o_orderstatus = 'F' THEN 'PAID' ELSE 'OPEN_CURRENT' END AS payment_status,
        CASE WHEN paid IS NOT NULL THEN paid <= {ODATE} + 30 END AS is_on_time_payment,
        CAST(paid - {ODATE} AS INT) AS days_to_pay, {D('l_quantity', 'quantity')}, {D('l_extendedprice', 'amount')},
        ['HAD','HPA','HSB','HET'][l_suppkey % 4 + 1] AS segment_code, {LEAF} AS true_category_secondary, {fiscal('o_orderdate')} FROM x""",
    "sourcing_events": f"""SELECT 'EV-' || o_orderkey AS event_id, ['RFQ','RFP','Auction'][o_orderkey % 3 + 1] AS event_type,
        {ODATE} AS created_on, {ODATE} + 21 AS closed_on, CAST(o_custkey % 8 AS INT) AS suppliers_invited,
        CAST(o_custkey % 8 - o_custkey % 8 % 3 AS INT) AS suppliers_responded, CAST(o_custkey % 100 AS VARCHAR) AS awarded_supplier_id,
        {D('o_totalprice', 'awarded_amount')}, CAST(year({ODATE} + 21) AS INT) AS fiscal_year,
        CAST(quarter({ODATE} + 21) AS INT) AS fiscal_quarter FROM orders""",
    "ar_invoices": f"""SELECT CAST(o_orderkey AS VARCHAR) AS source_primary_key, 'AR-' || o_orderkey AS invoice_number,
        CAST(o_custkey AS VARCHAR) AS customer_id, {ODATE} AS invoice_date, strftime(o_orderdate, '%Y-%m') AS period_name,
        {CURRENCY}[o_custkey % 4 + 1] AS currency, {D('o_totalprice', 'total_amount')},
        CASE o_orderstatus WHEN 'F' THEN 'PAID' WHEN 'O' THEN 'OPEN' ELSE 'PARTIAL' END AS status, {fiscal('o_orderdate')} FROM orders""",
    "inbound_contract_master": f"""SELECT 'sap_ariba' AS source_system, 'ARIBA_CONTRACT_WORKSPACE' AS source_table,
        contract_workspace_id AS source_primary_key, contract_workspace_id, contract_type, 'Contract ' || s_name AS title,
        supplier_id, DATE '1995-01-01' AS effective_date, expiration_date, {D('committed', 'total_committed_spend')},
        {D('actual', 'actual_spend_to_date')}, status, region FROM ci JOIN (SELECT s_suppkey AS k, s_name FROM supplier) ON k = ci.s_suppkey""",
    "contract_effective_value": f"""SELECT contract_id, customer_id, segment_code, start_date, end_date,
        {D('total_contract_value', 'total_contract_value')}, {D('delta', 'amendment_value_delta')}, {D('value', 'effective_contract_value')},
        status FROM contract""",
    "coa_accounts": """SELECT code_combination_id, entity_code, cost_center_code, natural_account_code, '0000' AS intercompany_code,
        '0000' AS segment6_future1, account_type AS natural_account_type,
        CASE entity_code WHEN '1' THEN 'HAD' WHEN '2' THEN 'HPA' WHEN '3' THEN 'HSB' WHEN '4' THEN 'HET' ELSE 'OTHER' END AS segment_code,
        enabled_flag FROM coa""",
    "journal_headers": f"""SELECT DISTINCT CAST(je_header_id AS VARCHAR) AS source_primary_key, je_header_id,
        strftime(posted_date, '%Y-%m') AS period_name, je_source, je_category, posted_date, currency AS currency_code,
        {fiscal('posted_date')} FROM jl""",
    "journal_lines_conformed": f"""SELECT je_header_id || '/' || je_line_num AS source_primary_key, je_header_id,
        code_combination_id, {D('dr', 'accounted_dr')}, {D('cr', 'accounted_cr')}, {D('dr - cr', 'net_amount')} FROM jl""",
    "dim_employees": f"""SELECT CAST(user_id AS VARCHAR) AS employee_id, version_seq, CAST(effective_from AS DATE) AS effective_from,
        coalesce(CAST(nxt AS DATE), DATE '9999-12-31') AS effective_to, nxt IS NULL AS is_current,
        CASE WHEN segment_code = 'error' THEN 'terminated' ELSE 'active' END AS employment_status, segment_code,
        CAST(50000 + user_id * 100 AS DOUBLE) AS annual_base_salary_usd,
        {D('CAST((50000 + user_id * 100) * 1.30 * 0.25 AS DECIMAL(18,2))', 'quarterly_loaded_cost_usd')} FROM ver""",
    "classification_rows": """SELECT pp AS predicted_primary_category, pl AS predicted_secondary_category, pc AS primary_confidence,
        lc AS secondary_confidence, '1' AS model_version FROM pred WHERE pl IS NOT NULL""",
    "dim_account": "SELECT DISTINCT natural_account_code AS account_code, description AS account_description, account_type FROM coa",
    "dim_cost_center": """SELECT DISTINCT cost_center_code, segment_code, entity_code,
        segment_code || '-' || cost_center_code AS cost_center_key FROM coa""",
    "dim_spend_category": """SELECT DISTINCT p_type AS primary_code, p_type || '/' || p_brand AS secondary_code,
        CASE p_type WHEN 'ECONOMY' THEN '5000' WHEN 'STANDARD' THEN '5030' WHEN 'LARGE' THEN '6020' WHEN 'MEDIUM' THEN '6030'
          WHEN 'PROMO' THEN '7000' ELSE '6040' END AS gl_account,
        CASE WHEN p_type IN ('ECONOMY','STANDARD') THEN 'COGS' WHEN p_type = 'PROMO' THEN 'RD' ELSE 'SGA' END AS gl_account_type,
        p_type IN ('ECONOMY','STANDARD') AS is_direct FROM part""",
    "fact_invoices": f"""SELECT invoice_line_id, invoice_id, {G}, pred.supplier_id, supplier_name, region AS supplier_region,
        country_code AS supplier_country, maverick_propensity AS supplier_maverick_propensity, is_regulated_supplier,
        {D('amount', 'amount')}, {D('quantity', 'quantity')}, gl_account, gl_account_type, direct_indirect, addressability,
        true_category_secondary, pp AS predicted_primary_category, pl AS predicted_secondary_category, lc AS secondary_confidence
        FROM pred LEFT JOIN sup ON sup.supplier_id = pred.supplier_id""",
    "fact_purchase_orders": f"""SELECT 'PO-' || o.o_orderkey AS po_number, CAST(o.o_custkey % 100 AS VARCHAR) AS supplier_id, supplier_name,
        region AS supplier_region, segment_affinity AS supplier_segment_affinity, {D('value', 'extended_amount')}, {G}
        FROM pr JOIN orders o USING (o_orderkey) LEFT JOIN sup ON sup.s_suppkey = o.o_custkey % 100 WHERE pr_status = 'released'""",
    "fact_purchase_requests": f"""SELECT pr_number, CAST(o.o_custkey % 100 AS VARCHAR) AS supplier_id, supplier_name,
        country_code AS supplier_country, pr_status, {D('value', 'estimated_extended_amount')},
        {D('CAST(round(value * (CASE o.o_orderkey % 3 WHEN 0 THEN 1.000 WHEN 1 THEN 0.010 ELSE 0.001 END), 2) AS DECIMAL(18,2))', 'price_unit_adjusted')},
        segment_code FROM pr JOIN orders o USING (o_orderkey) LEFT JOIN sup ON sup.s_suppkey = o.o_custkey % 100""",
    "fact_revenue": f"""SELECT CAST(b.o_orderkey AS VARCHAR) AS schedule_id, b.contract_id, {D('b.amount', 'amount')}, fiscal_year, fiscal_quarter,
        start_date AS contract_start_date, end_date AS contract_end_date, {D('c.value', 'effective_contract_value')}
        FROM bill b LEFT JOIN contract c USING (contract_id)""",
    "gl_entries": f"""SELECT je_header_id, period_name, je_category, code_combination_id, segment_code, account_type,
        natural_account_code, cost_center_code, {D('dr', 'accounted_dr')}, {D('cr', 'accounted_cr')}, {D('dr - cr', 'net_amount')} FROM gle""",
    "trial_balance": f"""SELECT code_combination_id, {BY}, period_name, segment_code, account_type, natural_account_code, cost_center_code,
        {D('sum(dr)', 'period_dr')}, {D('sum(cr)', 'period_cr')}, {D('sum(dr - cr)', 'period_net')} FROM gle GROUP BY ALL""",
    "journal_lines": f"SELECT je_header_id, je_line_num, code_combination_id, {D('dr', 'accounted_dr')}, {D('cr', 'accounted_cr')} FROM jl",
    "headcount_snapshot": f"""SELECT {G}, headcount, cost AS quarterly_cost_usd,
        CAST(CAST(CAST(cost AS DECIMAL(18,2)) / headcount AS DECIMAL(18,2)) AS DOUBLE) AS avg_quarterly_cost_per_head FROM snap""",
    "period_balances": f"""SELECT code_combination_id, {D('sum(dr)', 'period_net_dr')}, {D('sum(cr)', 'period_net_cr')},
        year(posted_date) || '-12' AS period_name, {D('sum(dr - cr)', 'period_net_balance')} FROM jl
        GROUP BY code_combination_id, year(posted_date)""",
    "derived_orders": f"""WITH x AS (SELECT *, {CO_SEG} AS segment_code FROM lineitem JOIN orders ON l_orderkey = o_orderkey
            WHERE o_orderstatus = 'F' AND o_custkey % 6 <> 4),
          f AS (SELECT l_orderkey AS k, CAST(l_suppkey AS VARCHAR) AS first_supplier FROM x
            QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_suppkey AS VARCHAR)) = 1)
        SELECT 'PO-' || l_orderkey AS po_number, l_linenumber AS po_line_num, first_supplier AS supplier_id, segment_code,
          {D('l_quantity', 'quantity')}, {D('l_extendedprice', 'unit_price')},
          {D('CAST(CAST(l_quantity AS DECIMAL(18,3)) * CAST(l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(18,2))', 'extended_amount')},
          CAST(l_orderkey AS VARCHAR) AS source_pr_number FROM x JOIN f ON k = l_orderkey""",
    "due_dates": f"""SELECT o_orderkey AS invoice_id, {ODATE} + CAST([15, 30, 45, 60][o_custkey % 4 + 1] AS INT) AS due_date FROM orders""",
    "dim_date": """WITH x AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)
        SELECT d AS date_key, CAST(year(d) AS INT) AS calendar_year, CAST(year(d) AS INT) AS fiscal_year,
          CAST(quarter(d) AS INT) AS fiscal_quarter, CAST(month(d) AS INT) AS calendar_month, strftime(d, '%b') AS month_short_name,
          strftime(d, '%B') AS month_long_name, CAST(date_trunc('month', d) AS DATE) AS first_of_month, CAST(day(d) AS INT) AS day_of_month,
          CAST(dayofweek(d) + 1 AS INT) AS day_of_week, strftime(d, '%A') AS day_name, dayofweek(d) IN (0, 6) AS is_weekend FROM x""",
    "period_calendar": """WITH x AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders)
        SELECT strftime(m, '%Y-%m') AS period_name, CAST(year(m) AS INT) AS period_year, CAST(month(m) AS INT) AS period_num,
          m AS start_date, last_day(m) AS end_date, CASE WHEN m = (SELECT max(m) FROM x) THEN 'Open' ELSE 'Closed' END AS period_status FROM x""",
    "period_anchors": f"""WITH p AS (SELECT {fiscal('o_orderdate')}, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 1e6 AS t,
            count(*) AS n FROM orders GROUP BY 1, 2),
          c AS (SELECT {BY}, round(t, 1) AS revenue, round(t * 0.6, 1) AS cogs, round(t * 0.2, 1) AS oi, n FROM p),
          s AS (SELECT {BY}, code, mgn, round(revenue * share, 1) AS r, round(cogs * share, 1) AS g, CAST(floor(n * share) AS INT) AS h FROM c,
            (VALUES ('A', 0.503::DOUBLE, 0.203::DOUBLE), ('B', 0.297::DOUBLE, 0.107::DOUBLE), ('C', 0.2::DOUBLE, 0.153::DOUBLE)) AS m(code, share, mgn))
        SELECT {BY}, 'CONSOL' AS segment_code, revenue, cogs, revenue - cogs AS gross_profit, oi AS operating_income,
          CAST(n AS INT) AS headcount_total, 0.0::DOUBLE AS cash FROM c
        UNION ALL SELECT {BY}, code, r, g, round(r - g, 1), round(r * mgn, 1), h, NULL FROM s""",
    "scd2_history": """SELECT CAST(user_id AS VARCHAR) AS employee_id, version_seq, effective_from, nxt AS effective_to,
        nxt IS NULL AS is_current, segment_code FROM ver""",
    "scd2_snapshot": "SELECT snapshot_date, segment_code, headcount FROM snap",
    "allocate_monthly": f"""WITH m AS (SELECT {G}, strftime(invoice_date, '%Y-%m') AS period_name, count(*) AS w FROM inv GROUP BY ALL),
          q AS (SELECT {G}, CAST(sum(amount) AS DOUBLE) AS total, CAST(count(*) AS DOUBLE) AS s FROM inv GROUP BY ALL)
        SELECT {G}, period_name, round(total * (w / s), 4) AS allocated FROM m JOIN q USING ({G})""",
    "rescale_to_target": f"""WITH q AS (SELECT {G}, CAST(sum(amount) AS DOUBLE) AS s FROM inv GROUP BY ALL),
          t AS (SELECT {G}, round(s * (1 + CAST((fiscal_year * 10 + fiscal_quarter) % 7 - 3 AS DOUBLE) / 100) / 1e6, 4) * 1e6 / s AS f FROM q)
        SELECT invoice_id, {D('sum(CAST(round(CAST(CAST(amount AS DOUBLE) * f AS DECIMAL(28,8)), 2) AS DECIMAL(18,2)))', 'invoice_amount')}
        FROM inv JOIN t USING ({G}) GROUP BY 1""",
    "residual_last_line": f"""WITH x AS (SELECT {LINE_ID} AS id, l_orderkey, l_linenumber, CAST(o_totalprice AS DECIMAL(18,2)) AS total,
            l_quantity, sum(l_quantity) OVER (PARTITION BY l_orderkey) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
          y AS (SELECT *, CAST(round(CAST(CAST(total AS DOUBLE) * (l_quantity / q) AS DECIMAL(28,8)), 2) AS DECIMAL(18,2)) AS part FROM x),
          z AS (SELECT *, total - sum(part) OVER (PARTITION BY l_orderkey) AS gap,
            row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, id DESC) AS rn FROM y)
        SELECT id AS invoice_line_id, {D('part + CASE WHEN rn = 1 THEN gap ELSE 0 END', 'amount')} FROM z""",
    "interpolate_series": """WITH x AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS m, count(*) AS n FROM orders GROUP BY 1),
          k AS (SELECT * FROM x WHERE month(m) % 3 = 1),
          b AS (SELECT x.m, (SELECT max(k.m) FROM k WHERE k.m <= x.m) AS lo, (SELECT min(k.m) FROM k WHERE k.m >= x.m) AS hi FROM x)
        SELECT b.m, round(CASE WHEN lo IS NULL THEN h.n WHEN hi IS NULL OR lo = hi THEN l.n
          ELSE l.n + (CAST(h.n AS DOUBLE) - l.n) * (b.m - lo) / (hi - lo) END, 6) AS value
        FROM b LEFT JOIN k l ON l.m = lo LEFT JOIN k h ON h.m = hi""",
    "compound_index": """WITH x AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS m, count(*) AS n FROM orders GROUP BY 1)
        SELECT m, round(exp(sum(ln(pow(1 + least(greatest(n / 10000.0, 0.03), 0.08), 1.0 / 12))) OVER (ORDER BY m)), 6) AS idx FROM x""",
    "lagged_series": """WITH x AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS m, count(*) AS n FROM orders GROUP BY 1)
        SELECT m, n, coalesce(lag(n, 2) OVER (ORDER BY m), first_value(n) OVER (ORDER BY m)) AS lagged FROM x""",
    "standardised_series": """WITH x AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS m, count(*) AS n FROM orders GROUP BY 1)
        SELECT m, round(1.3 * (n - (SELECT avg(n) FROM x)) / greatest((SELECT stddev_pop(n) FROM x), 0.1), 6) AS z FROM x""",
    "split_by_mix": """WITH c AS (SELECT c_mktsegment AS segment_code, count(*) AS k FROM customer GROUP BY 1),
          y AS (SELECT CAST(year(o_orderdate) AS INT) AS fiscal_year, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 1e6 AS r FROM orders GROUP BY 1)
        SELECT fiscal_year, segment_code, round(r * (k / CAST((SELECT sum(k) FROM c) AS DOUBLE)), 1) AS revenue FROM y, c""",
    "scaled_estimates": f"""WITH s AS (SELECT {BY}, CAST(sum(amount) AS DOUBLE) AS spend FROM inv GROUP BY ALL),
          q AS (SELECT {BY}, CAST(sum(value) AS DOUBLE) AS est FROM pr JOIN s USING ({BY}) GROUP BY ALL)
        SELECT pr_number, round(CAST(value AS DOUBLE) * (spend * 1.25) / est, 4) AS scaled FROM pr JOIN s USING ({BY}) JOIN q USING ({BY})""",
    "upsert_predictions": """SELECT invoice_line_id, true_category_secondary, CASE WHEN line_number <= 2 THEN '1' ELSE '2' END AS model_version FROM inv
        UNION ALL SELECT 'new-' || invoice_line_id, true_category_secondary, '2' FROM inv WHERE line_number <= 2""",
    "upsert_in_place": """SELECT invoice_line_id, true_category_secondary, CASE WHEN invoice_id % 100 = 0 THEN '2' ELSE '1' END AS model_version FROM inv""",
    "hash_sample": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 100",
    "large_hash_sample": """SELECT l_orderkey, count(*) AS lines FROM (SELECT l_orderkey FROM lineitem
          ORDER BY md5(CAST(l_orderkey AS VARCHAR)), l_orderkey LIMIT (SELECT count(*) * 2 // 3 FROM lineitem)) GROUP BY 1""",
    "stream_ingest_events": """SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS events,
        CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value FROM events GROUP BY 1, 2""",
    "secondary_categories": "SELECT p_partkey, unnest([p_type, p_brand]) AS code FROM part",
}
