"""Oracle SQL for the analyst queries."""

from checks.prelude import BY, inmm, mean, mm, pct

RATE = "CAST(CAST(o_custkey % 8 - o_custkey % 8 % 3 AS DOUBLE) / nullif(CAST(o_custkey % 8 AS DOUBLE), 0.0) AS DECIMAL(24,12))"

SQL = {
    # spend
    "spend_by_segment_quarter": f"""SELECT {BY}, segment_code, {mm('amount')} AS spend_mm, count(*) AS invoice_lines,
        count(DISTINCT invoice_id) AS invoices, count(DISTINCT supplier_id) AS suppliers FROM inv GROUP BY {BY}, segment_code""",
    "spend_by_parent": f"""SELECT true_category_primary, count(*) AS lines, count(DISTINCT supplier_id) AS suppliers,
        {pct('sum(amount)', '(SELECT sum(amount) FROM inv)')} AS pct_of_total, {mm('amount')} AS spend_mm FROM inv GROUP BY 1""",
    "spend_by_leaf": f"""SELECT true_category_primary, true_category_secondary, count(*) AS lines, {mm('amount')} AS spend_mm,
        round({mean('amount')}, 0) AS avg_line_amount, count(DISTINCT supplier_id) AS suppliers FROM inv GROUP BY 1, 2""",
    "taxonomy_listing": """SELECT p_type AS primary_code, upper(substr(p_type,1,1)) || lower(substr(p_type,2)) AS primary_name,
        count(*) AS n_leaves, string_agg(leaf, ',' ORDER BY leaf) AS leaves
        FROM (SELECT DISTINCT p_type, p_type || '/' || p_brand AS leaf FROM part) GROUP BY 1""",
    "direct_indirect": f"""SELECT direct_indirect, count(*) AS lines, {mm('amount')} AS spend_mm,
        {pct('sum(amount)', '(SELECT sum(amount) FROM inv)')} AS pct_of_total FROM inv GROUP BY 1""",
    "addressability": f"""SELECT addressability, count(*) AS lines, count(DISTINCT supplier_id) AS suppliers, {mm('amount')} AS spend_mm,
        {pct('sum(amount)', '(SELECT sum(amount) FROM inv)')} AS pct_of_total FROM inv GROUP BY 1""",
    "funnel": f"""
        SELECT * FROM (SELECT {BY}, count(*) AS pr_lines, count(*) FILTER (pr_status = 'released') AS pr_released,
            count(*) FILTER (pr_status = 'cancelled') AS pr_cancelled, {mm('value')} AS pr_estimated_mm FROM pr GROUP BY {BY})
        FULL JOIN (SELECT {BY}, count(*) AS po_lines, {mm('value')} AS po_committed_mm FROM po GROUP BY {BY}) USING ({BY})
        FULL JOIN (SELECT {BY}, count(*) AS inv_lines, {mm('amount')} AS inv_realized_mm FROM inv GROUP BY {BY}) USING ({BY})""",
    "top_suppliers": f"""SELECT supplier_id, any_value(supplier_name) AS supplier_name, any_value(region) AS supplier_region,
        any_value(country_code) AS supplier_country, any_value(is_regulated_supplier) AS is_regulated_supplier,
        any_value(maverick_propensity) AS supplier_maverick_propensity, {mm('amount')} AS spend_mm, count(*) AS invoice_lines
        FROM inv JOIN sup USING (supplier_id) GROUP BY 1 ORDER BY sum(amount) DESC, supplier_id LIMIT 20""",
    "match_rate": f"""SELECT po_matched_flag, {BY}, count(DISTINCT invoice_id) AS invoices, {mm('amount')} AS amount_mm
        FROM inv GROUP BY 1, 2, 3""",
    "payment_ops": f"""SELECT {BY}, payment_status, count(DISTINCT invoice_id) AS invoices, {mm('amount')} AS amount_mm,
        {pct('count(*) FILTER (on_time)', 'count(on_time)')} AS on_time_pct,
        round({mean('days_to_pay')}, 1) AS avg_days_to_pay FROM pay GROUP BY {BY}, payment_status""",
    "payment_terms_mix": f"""SELECT payment_terms, count(DISTINCT supplier_id) AS suppliers, count(DISTINCT invoice_id) AS invoices,
        {mm('amount')} AS amount_mm, {pct('sum(amount)', '(SELECT sum(amount) FROM inv)')} AS pct_of_spend FROM inv GROUP BY 1""",
    "sourcing_throughput": f"""SELECT {BY}, event_type, count(*) AS events, round({mean('invited')}, 1) AS avg_invited,
        round({mean('rate')} * 100, 1) AS response_pct, {mm('award')} AS awarded_mm
        FROM (SELECT CAST(year(CAST(o_orderdate AS DATE) + 21) AS INT) AS fiscal_year,
            CAST(quarter(CAST(o_orderdate AS DATE) + 21) AS INT) AS fiscal_quarter, o_custkey % 8 AS invited,
            ['RFQ','RFP','Auction'][o_orderkey % 3 + 1] AS event_type, {RATE} AS rate,
            CAST(o_totalprice AS DECIMAL(18,2)) AS award FROM orders) GROUP BY 1, 2, 3""",
    "bridge_conversion": f"""SELECT {BY}, segment_code, count(DISTINCT pr.pr_number) AS released_prs,
        count(DISTINCT po_number) AS resulting_pos, {pct('count(DISTINCT po_number)', 'count(DISTINCT pr.pr_number)')} AS conversion_pct
        FROM pr LEFT JOIN (SELECT po_number, pr_number AS ref FROM po) ON pr_number = ref
        WHERE pr_status = 'released' GROUP BY {BY}, segment_code""",
    "prediction_accuracy": f"""SELECT pl IS NOT NULL AS has_prediction, count(*) AS lines, round({mean('lc')}, 3) AS avg_leaf_confidence,
        round({mean('pc')}, 3) AS avg_parent_confidence,
        {pct('count(*) FILTER (pl = true_category_secondary)', 'count(*)')} AS leaf_accuracy_pct,
        {pct('count(*) FILTER (pp = true_category_primary)', 'count(*)')} AS parent_accuracy_pct FROM pred GROUP BY 1""",
    "confusion": f"""SELECT true_category_primary AS truth_parent, pp AS pred_parent, count(*) AS lines, {mm('amount')} AS spend_mm
        FROM pred WHERE pp <> true_category_primary GROUP BY 1, 2 ORDER BY sum(amount) DESC, 1, 2 LIMIT 20""",
    "stage_counts": """SELECT 'PR' AS stage, count(*) AS row_count FROM pr UNION ALL SELECT 'PO', count(*) FROM po
        UNION ALL SELECT 'Invoice', count(*) FROM inv""",
    # revenue
    "revenue_by_segment_quarter": f"""SELECT {BY}, segment_code, {mm('amount')} AS revenue_mm, count(*) AS billing_events,
        count(DISTINCT customer_id) AS customers, count(DISTINCT contract_id) AS contracts FROM bill GROUP BY {BY}, segment_code""",
    "top_customers": f"""SELECT customer_id, customer_name, region, primary_segment_code, {mm('amount')} AS revenue_mm,
        count(DISTINCT contract_id) AS contracts, count(*) AS billing_events FROM bill LEFT JOIN cust USING (customer_id)
        GROUP BY 1, 2, 3, 4 ORDER BY sum(amount) DESC, customer_id LIMIT 20""",
    "billing_status": f"SELECT status, {BY}, count(*) AS events, {mm('amount')} AS amount_mm FROM bill GROUP BY 1, 2, 3",
    "contract_values": f"""SELECT segment_code, status, count(*) AS contracts, {mm('value')} AS total_value_mm,
        round({mean('value')} / 1e3, 1) AS avg_value_k,
        round(CAST(quantile_disc(value, 0.5) AS DOUBLE) / 1e3, 1) AS p50_value_k,
        round(CAST(quantile_disc(value, 0.95) AS DOUBLE) / 1e3, 1) AS p95_value_k FROM contract GROUP BY 1, 2""",
    "currency_mix": f"""SELECT currency, count(*) AS events, {mm('amount')} AS revenue_mm,
        {pct('sum(amount)', '(SELECT sum(amount) FROM bill)')} AS pct_of_revenue FROM bill GROUP BY 1""",
    "ar_flow": f"""SELECT {BY}, CASE status WHEN 'Paid' THEN 'PAID' WHEN 'Scheduled' THEN 'OPEN' ELSE 'PARTIAL' END AS status,
        count(*) AS invoices, {mm('amount')} AS amount_mm FROM bill GROUP BY 1, 2, 3""",
    # accounting
    "journal_volume": """SELECT strftime(posted_date, '%Y-%m') AS period_name, je_source,
        count(DISTINCT je_header_id) AS je_headers FROM jl GROUP BY 1, 2""",
    "journal_balance": """SELECT count(*) AS total_jes, count(*) FILTER (abs(net) > 0.01) AS unbalanced_jes,
        CAST(max(abs(net)) AS DOUBLE) AS worst_imbalance FROM (SELECT je_header_id, sum(dr - cr) AS net FROM jl GROUP BY 1)""",
    "latest_trial_balance": f"""SELECT period_name, segment_code, account_type, count(*) AS lines, {mm('dr')} AS dr_mm,
        {mm('cr')} AS cr_mm, {mm('dr - cr')} AS net_mm FROM gle
        WHERE period_name = (SELECT max(period_name) FROM gle) AND account_type IS NOT NULL GROUP BY 1, 2, 3""",
    "coa_coverage": """SELECT segment_code, account_type, count(*) AS code_combinations,
        count(DISTINCT cost_center_code) AS cost_centers, count(DISTINCT natural_account_code) AS natural_accounts
        FROM coa WHERE enabled_flag = 'Y' GROUP BY 1, 2""",
    "account_type_totals": f"""SELECT account_type, count(DISTINCT period_name) AS periods, {mm('dr')} AS period_dr_mm,
        {mm('cr')} AS period_cr_mm, {mm('dr - cr')} AS period_net_mm FROM gle WHERE account_type IS NOT NULL GROUP BY 1""",
    "top_accounts": f"""SELECT natural_account_code AS account_code, description AS account_description, account_type,
        count(*) AS entries, {mm('dr')} AS total_dr_mm FROM gle GROUP BY 1, 2, 3
        ORDER BY count(*) DESC, 1 LIMIT 15""",
    # legal
    "outbound_contracts": f"""SELECT segment_code, status, count(*) AS contracts, {mm('value')} AS total_value_mm,
        round({mean('value')} / 1e3, 1) AS avg_value_k, min(start_date) AS earliest_start, max(end_date) AS latest_end
        FROM contract GROUP BY 1, 2""",
    "inbound_utilisation": f"""SELECT contract_type, region, status, count(*) AS contracts, {mm('committed')} AS committed_mm,
        {mm('actual')} AS actual_mm, {pct('sum(actual)', 'sum(committed)')} AS utilization_pct FROM ci GROUP BY 1, 2, 3""",
    "amendments_by_year": f"""SELECT CAST(year(l_shipdate) AS INT) AS amendment_year,
        CASE WHEN l_linestatus = 'F' THEN 'TERMINATION' ELSE 'VALUE_CHANGE' END AS amendment_type, count(*) AS amendments,
        {mm('-CAST(l_extendedprice AS DECIMAL(18,2))')} AS value_delta_mm FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2""",
    "expiring_contracts": f"""SELECT CAST(date_trunc('month', end_date) AS DATE) AS expiration_month, segment_code,
        count(*) AS contracts_expiring, {mm('value')} AS expiring_value_mm FROM contract
        WHERE end_date BETWEEN DATE '1999-07-01' AND DATE '2000-07-01' GROUP BY 1, 2""",
    "outbound_terms": f"""SELECT commercial_terms, count(*) AS contracts, {mm('value')} AS total_value_mm,
        {pct('count(*)', '(SELECT count(*) FROM contract)')} AS pct_of_contracts FROM contract GROUP BY 1""",
    "off_contract": f"""SELECT segment_code, {BY}, count(*) AS invoice_lines, {mm('amount')} AS off_contract_mm FROM inv
        WHERE NOT EXISTS (SELECT 1 FROM ci WHERE ci.supplier_id = inv.supplier_id AND ci.status = 'Active')
        GROUP BY 1, 2, 3 ORDER BY sum(amount) DESC, 1, 2, 3 LIMIT 20""",
    # parties
    "supplier_regions": f"""SELECT region, category_primary, count(*) AS suppliers, round({mean('maverick_propensity')}, 3) AS avg_maverick
        FROM sup WHERE category_primary IS NOT NULL GROUP BY 1, 2""",
    "propensity_histogram": f"""WITH b AS (SELECT CASE WHEN maverick_propensity < 0.05 THEN '00-05 (clean)'
            WHEN maverick_propensity < 0.10 THEN '05-10' WHEN maverick_propensity < 0.15 THEN '10-15'
            WHEN maverick_propensity < 0.20 THEN '15-20 (eval slice)' WHEN maverick_propensity < 0.25 THEN '20-25'
            ELSE '25+ (very maverick)' END AS maverick_bin FROM sup WHERE maverick_propensity IS NOT NULL)
        SELECT maverick_bin, count(*) AS suppliers, {pct('count(*)', '(SELECT count(*) FROM b)')} AS pct FROM b GROUP BY 1""",
    "top_suppliers_active": f"""SELECT supplier_id, supplier_name, region, country_code, category_primary, maverick_propensity,
        {mm('amount')} AS spend_mm, count(DISTINCT invoice_id) AS invoices,
        count(DISTINCT fiscal_year * 10 + fiscal_quarter) AS active_quarters FROM inv LEFT JOIN sup USING (supplier_id)
        GROUP BY 1, 2, 3, 4, 5, 6 ORDER BY sum(amount) DESC, supplier_id LIMIT 25""",
    "customer_regions": """SELECT region, primary_segment_code, count(*) AS customers FROM cust
        WHERE primary_segment_code IS NOT NULL GROUP BY 1, 2""",
    "top_customers_active": f"""SELECT customer_id, customer_name, region, primary_segment_code, {mm('amount')} AS revenue_mm,
        count(DISTINCT contract_id) AS contracts, count(DISTINCT fiscal_year * 10 + fiscal_quarter) AS active_quarters
        FROM bill LEFT JOIN cust USING (customer_id) GROUP BY 1, 2, 3, 4 ORDER BY sum(amount) DESC, customer_id LIMIT 25""",
    "scorecard_by_quarter": f"""SELECT CAST(year(l_shipdate) AS VARCHAR) || 'Q' || quarter(l_shipdate) AS "EvaluationQuarter",
        round({mean('l_quantity * 2')}, 1) AS avg_ontime_pct, round({mean('l_discount * 50')}, 2) AS avg_quality,
        round({mean('l_tax * 50')}, 2) AS avg_responsiveness,
        round({mean('round((l_quantity * 2 / 20 + l_discount * 50 + l_tax * 50) / 3, 2)')}, 2) AS avg_overall,
        count(*) AS suppliers_scored FROM lineitem GROUP BY 1""",
    # planning
    "fpa_actuals": f"SELECT {BY}, segment_code, account_type, {inmm('amount')} AS amount_mm, entry_count FROM act",
    "fpa_budgets": f"SELECT {BY}, segment_code, account_type, CAST(budget AS DOUBLE) AS amount_usd FROM plan",
    "fpa_forecasts": f"SELECT {BY}, segment_code, account_type, CAST(forecast AS DOUBLE) AS amount_usd FROM fc",
    "fpa_variance": f"""SELECT {BY}, segment_code, account_type, {inmm('amount')} AS actual_mm, {inmm('budget')} AS budget_mm,
        {inmm('forecast')} AS forecast_mm, {pct('amount - budget', 'budget')} AS var_act_vs_bud_pct,
        {pct('amount - forecast', 'forecast')} AS var_act_vs_fcst_pct FROM fc
        WHERE fiscal_year * 10 + fiscal_quarter = (SELECT max(fiscal_year * 10 + fiscal_quarter) FROM act)""",
    "yoy_revenue": f"""WITH y AS (SELECT fiscal_year, segment_code, sum(amount) AS now FROM act WHERE account_type = 'REVENUE' GROUP BY 1, 2),
        z AS (SELECT *, lag(now) OVER (PARTITION BY segment_code ORDER BY fiscal_year) AS was FROM y)
        SELECT fiscal_year, segment_code, {inmm('now')} AS revenue_mm, {inmm('was')} AS prior_year_mm,
        {pct('now - was', 'was')} AS yoy_pct FROM z""",
    "op_margin": f"""WITH w AS (SELECT {BY}, segment_code, max(amount) FILTER (account_type = 'REVENUE') AS r,
            max(amount) FILTER (account_type = 'COGS') AS c, max(amount) FILTER (account_type = 'SGA') AS s,
            max(amount) FILTER (account_type = 'RD') AS d FROM act GROUP BY {BY}, segment_code)
        SELECT {BY}, segment_code, {inmm('r')} AS revenue_mm, {inmm('c')} AS cogs_mm, {inmm('s')} AS sga_mm, {inmm('d')} AS rd_mm,
        {inmm('r - coalesce(c, 0) - coalesce(s, 0) - coalesce(d, 0)')} AS op_income_mm,
        {inmm('r - greatest(c, s, d)')} AS op_income_ref_mm FROM w""",
    "headcount_cost": f"SELECT {BY}, segment_code, headcount, {inmm('cost')} AS quarterly_cost_mm FROM snap",
    "headcount_trend": f"""SELECT segment_code, count(*) AS quarters_observed, min(fiscal_year * 10 + fiscal_quarter) AS first_fyq,
        max(fiscal_year * 10 + fiscal_quarter) AS last_fyq, min(headcount) AS min_headcount, max(headcount) AS max_headcount,
        round({mean('headcount')}, 0) AS avg_headcount, {mm('CAST(cost AS DECIMAL(18,2))')} AS total_cost_mm FROM snap GROUP BY 1""",
    "headcount_change": f"""WITH l AS (SELECT *, lag(headcount) OVER (PARTITION BY segment_code ORDER BY {BY}) AS was FROM snap)
        SELECT {BY}, segment_code, headcount, was AS prior_qtr_headcount, headcount - was AS delta,
        {pct('headcount - was', 'was', 2)} AS pct_change FROM l""",
    # reference
    "calendar_sanity": """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)
        SELECT min(d) AS earliest_date, max(d) AS latest_date, count(*) AS total_days,
        count(DISTINCT year(d)) AS fiscal_years_covered, count(*) FILTER (dayofweek(d) IN (0, 6)) AS weekend_days FROM d""",
    "calendar_quarters": """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)
        SELECT CAST(year(d) AS INT) AS fiscal_year, CAST(quarter(d) AS INT) AS fiscal_quarter, count(*) AS days,
        min(d) AS quarter_start, max(d) AS quarter_end FROM d GROUP BY 1, 2""",
    "segment_listing": """WITH s AS (SELECT DISTINCT c_mktsegment FROM customer)
        SELECT c_mktsegment AS segment_code, c_mktsegment AS segment_name, CAST(NULL AS VARCHAR) AS company_code,
        CAST(coalesce(list_position(['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY'], c_mktsegment), 9) AS INT) AS sort_order FROM s""",
    "macro_recent": """SELECT m AS period_month, round(n / 100, 3) AS gdp, round(v / 1e5, 3) AS inflation,
        round(n / 150, 3) AS demand_sales, round(n / 175, 3) AS demand_mfg, round(v / 2e5, 3) AS supply_stress,
        round(month(m) / 12, 3) AS seasonality FROM macro WHERE m >= DATE '1999-01-01'""",
    "macro_quarterly": f"""SELECT CAST(year(m) AS INT) AS yr, CAST(quarter(m) AS INT) AS qtr, round({mean('n / 100')}, 3) AS gdp,
        round({mean('v / 1e5')}, 3) AS inflation, round({mean('n / 150')}, 3) AS demand_sales,
        round({mean('n / 175')}, 3) AS demand_mfg, round({mean('v / 2e5')}, 3) AS supply_stress FROM macro GROUP BY 1, 2""",
}
