"""Oracle SQL for gates, classification and sourcing marts."""

from checks.prelude import BY, mean, mm, pct

G = f"{BY}, segment_code"
D = lambda x, n: f"CAST({x} AS DOUBLE) AS {n}"
KEY = "fiscal_year || '/' || fiscal_quarter || '/' || segment_code"
LEVEL = lambda a, t, tol, bad: (
    f"CASE WHEN {t} = 0 THEN CASE WHEN abs({a}) <= 1 THEN 'ok' ELSE '{bad}' END"
    f" WHEN abs({a} - {t}) <= abs({t}) * {tol} THEN 'ok' ELSE '{bad}' END AS level")
DRIFT = lambda a, t: f"CASE WHEN {t} = 0 THEN 0.0 ELSE CAST({a} - {t} AS DOUBLE) / CAST({t} AS DOUBLE) END + 0.0 AS drift"
GATE = lambda gate, key, a, t, tol, bad: (
    f"SELECT '{gate}' AS gate, {key} AS key, {D(a, 'actual')}, {D(t, 'target')}, {DRIFT(a, t)}, {LEVEL(a, t, tol, bad)}")
MAV = "CASE WHEN l_suppkey % 10 <> 9 THEN (l_suppkey % 30) / 100 ELSE 0.0 END"
PART = (f"CASE WHEN {MAV} > 0.15 THEN 'maverick' WHEN CAST('0x' || substr(md5(invoice_line_id), 1, 8) AS BIGINT) % 100 < 80"
        " THEN 'train' ELSE 'holdout' END")
SPEND = "(SELECT * FROM pred WHERE pl IS NOT NULL AND addressability = 'Addressable')"
K = f"{G}, predicted_primary_category, predicted_secondary_category"
BASE = f"(SELECT {G}, pp AS predicted_primary_category, pl AS predicted_secondary_category, supplier_id, l_suppkey, sum(amount) AS spend FROM {SPEND} GROUP BY ALL)"
HINT = "CASE WHEN l_suppkey % 10 <> 9 THEN ['ECONOMY','LARGE','MEDIUM','PROMO','SMALL','STANDARD'][l_suppkey % 6 + 1] END"
HHI = "round(CAST(sum(spend * spend) AS DOUBLE) / (CAST(sum(spend) AS DOUBLE) * CAST(sum(spend) AS DOUBLE)), 6)"
F1 = """(SELECT {by}, cls, sum(s) AS support, sum(p) AS predicted, sum(h) AS tp FROM (
    SELECT {by}, {t} AS cls, count(*) AS s, 0 AS p, count(*) FILTER ({t} = {g}) AS h FROM {src} GROUP BY ALL
    UNION ALL SELECT {by}, coalesce({g}, '') AS cls, 0, count(*), 0 FROM {src} GROUP BY ALL) GROUP BY ALL)"""
ACTIVE = "(SELECT DISTINCT supplier_id FROM ci WHERE status = 'Active')"

EVAL = f"""
  ft AS (SELECT *, {PART} AS part FROM pred),
  fl AS (SELECT gl_account, true_category_secondary AS guess FROM ft WHERE part = 'train' GROUP BY 1, 2
    QUALIFY row_number() OVER (PARTITION BY gl_account ORDER BY count(*) DESC, true_category_secondary) = 1),
  src AS (SELECT 'challenger' AS model_alias, CASE part WHEN 'maverick' THEN 'maverick_holdout' ELSE part END AS slice,
      true_category_secondary AS t, true_category_primary AS tp, pl AS g, pp AS gp FROM ft WHERE part <> 'train'
    UNION ALL SELECT 'gl_account_baseline', CASE part WHEN 'maverick' THEN 'maverick_holdout' ELSE part END,
      true_category_secondary, true_category_primary, guess, split_part(guess, '/', 1) FROM ft JOIN fl USING (gl_account) WHERE part <> 'train')"""
M2 = "model_alias, slice"
TIER = lambda t, g, name: (
    f"(SELECT {M2}, round(CAST(sum(tp) AS DOUBLE) / sum(support), 6) AS {name}_top1_accuracy,"
    f" round(avg(CASE WHEN support + predicted = 0 THEN 0 ELSE CAST(2 * tp AS DOUBLE) / (support + predicted) END), 6) AS {name}_macro_f1,"
    f" CAST(sum(support) AS INT) AS n_rows FROM {F1.format(by=M2, t=t, g=g, src='src')} GROUP BY ALL)")

TERMS = r"""w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM documents WHERE text IS NOT NULL),
  t AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
  c AS (SELECT doc_id, term, count(*) AS n FROM t GROUP BY ALL),
  v AS (SELECT term, row_number() OVER (ORDER BY sum(n) DESC, term) - 1 AS i, count(*) AS rows,
          ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf
        FROM c GROUP BY term HAVING count(*) >= 3 ORDER BY sum(n) DESC, term LIMIT 5000)"""
LEVELS = """f AS (SELECT invoice_line_id, inv.supplier_id, segment_code, inv.payment_terms, currency, region AS supplier_region, gl_account, direct_indirect,
    addressability, coalesce(category_primary, '__NA__') AS category_primary_hint FROM inv JOIN sup ON sup.supplier_id = inv.supplier_id),
  pairs AS (UNPIVOT f ON COLUMNS(* EXCLUDE invoice_line_id) INTO NAME "column" VALUE "value"),
  seen AS (SELECT "column", "value", count(*) AS rows, count(*) < 50 AS rare FROM pairs GROUP BY ALL),
  numbered AS (SELECT "column", "value", rows, CAST(dense_rank() OVER (ORDER BY "column", rare, CASE WHEN NOT rare THEN "value" END) - 1 AS INT) AS "index" FROM seen)"""

# Names delivered in three runs, the last of which also renames some keys of the first. A spelling is numbered by its first
# run and the smallest key in it; two are linked from the run on that has both, if they are one edit apart, both lose a
# character to the same text, or a key has had both.
ENTITIES = """WITH RECURSIVE p AS (SELECT p_partkey, regexp_replace(p_brand, '[^0-9]', '', 'g') AS b, p_name || ' brand' AS t, p_partkey % 3 + 1 AS run, false AS again FROM part
            UNION ALL SELECT p_partkey, regexp_replace(p_brand, '[^0-9]', '', 'g'), 'cold ' || split_part(p_name, ' ', 2) || ' brand', 3, true FROM part WHERE p_partkey % 30 = 0),
          n AS (SELECT b, t, min(run * 1000000000 + p_partkey) AS node FROM p GROUP BY 1, 2),
          f AS (SELECT node, b || '|' || t AS form, node // 1000000000 AS run FROM n
            UNION SELECT node, b || '|' || substr(t, 1, i - 1) || substr(t, i + 1), node // 1000000000 FROM (SELECT *, CAST(unnest(range(1, length(t) + 1)) AS INT) AS i FROM n)
            UNION SELECT node, 'key ' || p_partkey, run FROM p JOIN n USING (b, t)),
          e AS (SELECT DISTINCT g, x.node AS u, y.node AS v FROM f x JOIN f y USING (form) JOIN range(1, 4) AS runs(g) ON greatest(x.run, y.run) <= g),
          r AS (SELECT g, u, v FROM e UNION SELECT r.g, r.u, e.v FROM r JOIN e ON r.v = e.u AND r.g = e.g),
          c AS (SELECT g, u, min(v) AS root FROM r GROUP BY 1, 2)"""

SQL = {
    "reconcile_spend": f"""WITH q AS (SELECT {G}, sum(amount) AS a FROM inv GROUP BY ALL),
          t AS (SELECT *, CAST(round(CAST(a AS DOUBLE) * (1 + CAST((fiscal_year * 10 + fiscal_quarter) % 7 - 3 AS DOUBLE) / 100) / 1e6, 4)
            AS DECIMAL(18,6)) * 1000000 AS t FROM q)
        {GATE('invoice_spend', KEY, 'a', 't', '0.02', 'breach')} FROM t""",
    "reconcile_revenue": f"""WITH q AS (SELECT {G}, sum(amount) AS a, floor(sum(amount) / 100000) * 100000 AS t FROM bill GROUP BY ALL)
        {GATE('billing_revenue', KEY, 'a', 'CAST(t AS DECIMAL(18,2))', '0.02', 'breach')} FROM q""",
    "funnel_cone": f"""WITH i AS (SELECT {G}, sum(amount) AS inv_total FROM inv GROUP BY ALL), o AS (SELECT {G}, sum(value) AS po_total FROM po GROUP BY ALL),
          j AS (SELECT {G}, coalesce(inv_total, 0) AS iv, coalesce(po_total, 0) AS pv FROM i FULL JOIN o USING ({G})),
          k AS (SELECT *, iv * 1.25 AS ti, pv * 1.25 AS tp FROM j)
        {GATE('orders_vs_invoices', KEY, 'pv', 'ti', '0.15', 'warn')} FROM k
        UNION ALL {GATE('requests_vs_orders', KEY, 'pv', 'tp', '0.15', 'warn')} FROM k""",
    "unbalanced_journals": f"""SELECT 'journal_balance' AS gate, CAST(je_header_id AS VARCHAR) AS key, {D('sum(dr - cr)', 'actual')},
        0.0::DOUBLE AS target, 0.0::DOUBLE AS drift, 'breach' AS level
        FROM (SELECT je_header_id, dr, cr + CASE WHEN je_header_id % 7 = 0 AND cr > 0 THEN 1 ELSE 0 END AS cr FROM jl) GROUP BY je_header_id
        HAVING abs(sum(dr - cr)) > 0.01""",
    "ap_control_account": f"""WITH p AS (SELECT strftime(posted_date, '%Y-%m') AS period_name,
            coalesce(sum(cr) FILTER (je_category = 'Purchase Invoices'), 0) AS created, coalesce(sum(dr) FILTER (je_category = 'Payments'), 0) AS paid FROM jl GROUP BY 1),
          u AS (SELECT strftime(invoice_date, '%Y-%m') AS period_name, sum(amount) AS open_invoices FROM inv WHERE payment_status <> 'PAID' GROUP BY 1),
          b AS (SELECT period_name, coalesce(created, 0) AS c, coalesce(paid, 0) AS p, coalesce(open_invoices, 0) AS o FROM p FULL JOIN u USING (period_name))
        SELECT period_name, {D('c', 'created')}, {D('p', 'paid')}, {D('o', 'open_invoices')},
          {D('sum(c - p) OVER (ORDER BY period_name)', 'implied_balance')}, {D('sum(o) OVER (ORDER BY period_name)', 'open_balance')} FROM b""",
    "taxonomy_parity": """SELECT 'taxonomy' AS gate, coalesce(pp, '-') || '/' || true_category_secondary AS key,
        CAST(count(*) AS DOUBLE) AS actual, 'breach' AS level FROM pred WHERE pp IS DISTINCT FROM true_category_primary GROUP BY 1, 2""",
    "leaf_hierarchy": """SELECT p_brand AS key, CAST(count(DISTINCT p_type) AS DOUBLE) AS actual, 'breach' AS level FROM part
        GROUP BY 1 HAVING count(DISTINCT p_type) > 1""",
    "labels_known": """WITH l AS (SELECT CASE WHEN pl LIKE '%1' THEN pl ELSE pl || '-old' END AS key FROM pred WHERE pl IS NOT NULL)
        SELECT key, CAST(count(*) AS DOUBLE) AS actual, 'breach' AS level FROM l
        WHERE key NOT IN (SELECT p_type || '/' || p_brand FROM part) GROUP BY 1""",
    "split_sanity": f"""WITH s AS (SELECT true_category_secondary AS label, {PART} AS part FROM inv),
          l AS (SELECT label, count(*) FILTER (part = 'train') AS t, count(*) FILTER (part = 'holdout') AS h, count(*) FILTER (part = 'maverick') AS m FROM s GROUP BY 1)
        SELECT 'labels_in_both' AS gate, label AS key, CAST(least(t, h) AS DOUBLE) AS actual, 1.0::DOUBLE AS target,
          CASE WHEN t > 0 AND h > 0 THEN 'ok' ELSE 'warn' END AS level FROM l WHERE t > 0 OR h > 0
        UNION ALL SELECT 'class_size', label, t, 50, CASE WHEN t >= 50 THEN 'ok' ELSE 'warn' END FROM l WHERE t > 0 OR h > 0
        UNION ALL SELECT 'split_complete', 'rows', sum(t + h + m), (SELECT count(*) FROM lineitem),
          CASE WHEN sum(t + h + m) = (SELECT count(*) FROM lineitem) THEN 'ok' ELSE 'breach' END FROM l
        UNION ALL SELECT 'maverick_size', 'rows', sum(m), 100, CASE WHEN sum(m) >= 100 THEN 'ok' ELSE 'warn' END FROM l""",
    "forbidden_terms": """WITH c AS (SELECT unnest([{'k': 'text', 'n': count(*) FILTER (regexp_matches(text, '(?i)(confidential|license|src1)'))},
            {'k': 'lang', 'n': count(*) FILTER (regexp_matches(lang, '(?i)(confidential|license|src1)'))},
            {'k': 'source', 'n': count(*) FILTER (regexp_matches(source, '(?i)(confidential|license|src1)'))}]) AS s FROM documents)
        SELECT 'forbidden_terms' AS gate, 'documents.' || s.k AS key, CAST(s.n AS DOUBLE) AS actual, 0.0::DOUBLE AS target,
          0.0::DOUBLE AS drift, CASE WHEN s.n > 0 THEN 'breach' ELSE 'ok' END AS level FROM c""",
    "headcount_gate": f"""WITH b AS (SELECT fiscal_year, fiscal_quarter + 1 AS fiscal_quarter, segment_code, headcount AS t FROM snap),
          j AS (SELECT b.fiscal_year, b.fiscal_quarter, b.segment_code, t, coalesce(headcount, 0) AS a FROM b LEFT JOIN snap USING ({G}))
        {GATE('headcount', KEY, 'a', 't', '0.10', 'warn')} FROM j""",
    "planning_gate": f"""WITH j AS (SELECT *, CAST(round(CAST(amount AS DOUBLE) / 1e6, 2) AS DECIMAL(18,6)) * 1000000 AS t FROM act)
        {GATE('planning_actuals', KEY + " || '/' || account_type", 'amount', 't', '0.01', 'breach')} FROM j""",
    "prediction_coverage": f"""SELECT count(*) AS source_rows, count(pl) AS matched_rows, {pct('count(pl)', 'count(*)', 2)} AS coverage_pct FROM pred""",
    "prediction_summary": f"""SELECT count(*) AS total_predictions, round({mean('lc')}, 4) AS mean_leaf_confidence,
        round(quantile_disc(lc, 0.1), 4) AS p10_leaf_confidence, round(quantile_disc(lc, 0.9), 4) AS p90_leaf_confidence,
        round({mean('pc')}, 4) AS mean_parent_confidence, round(quantile_disc(pc, 0.1), 4) AS p10_parent_confidence,
        round(quantile_disc(pc, 0.9), 4) AS p90_parent_confidence FROM pred WHERE pl IS NOT NULL""",
    "missing_labels": """SELECT DISTINCT true_category_secondary FROM inv
        EXCEPT SELECT true_category_secondary FROM inv WHERE supplier_id = '1'""",
    "clf_features": f"""SELECT invoice_line_id, line_description, inv.supplier_id, segment_code, inv.payment_terms, currency, region AS supplier_region,
        gl_account, direct_indirect, addressability, coalesce(category_primary, '__NA__') AS category_primary_hint,
        round(ln(1 + CAST(amount AS DOUBLE)), 6) AS log_amount, round(ln(1 + CAST(quantity AS DOUBLE)), 6) AS log_quantity,
        round(ln(1 + ((CAST(amount * 100 AS BIGINT) * 2 + CAST(quantity AS BIGINT)) // (2 * CAST(quantity AS BIGINT))) / 100), 6) AS log_unit_price,
        coalesce(maverick_propensity, 0.0) AS supplier_maverick_propensity, true_category_secondary AS label,
        true_category_primary AS label_primary, coalesce(maverick_propensity, 0.0) > 0.15 AS is_maverick_supplier
        FROM inv JOIN sup ON sup.supplier_id = inv.supplier_id""",
    "clf_split": f"SELECT {PART} AS part, true_category_primary AS label_primary, count(*) AS n FROM inv GROUP BY 1, 2",
    "label_distribution": """WITH c AS (SELECT true_category_secondary AS label, count(*) AS n FROM inv GROUP BY 1)
        SELECT * FROM (SELECT label, n, 'top' AS "end" FROM c ORDER BY n DESC, label LIMIT 5)
        UNION ALL SELECT * FROM (SELECT label, n, 'bottom' FROM c ORDER BY n, label LIMIT 5)""",
    "gl_floor_model": f"""SELECT gl_account, true_category_secondary AS floor_leaf FROM (SELECT *, {PART} AS part FROM inv) WHERE part = 'train'
        GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY gl_account ORDER BY count(*) DESC, true_category_secondary) = 1""",
    "clf_metrics": f"""WITH {EVAL} SELECT {M2}, a.n_rows, secondary_top1_accuracy, primary_top1_accuracy, secondary_macro_f1, primary_macro_f1
        FROM {TIER('t', 'g', 'secondary')} a JOIN {TIER('tp', 'gp', 'primary').replace('n_rows', 'n2')} b USING ({M2})""",
    "class_report": f"""SELECT cls AS "class", CAST(support AS BIGINT) AS support, round(CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END, 6) AS precision,
        round(CASE WHEN support = 0 THEN 0 ELSE tp / support END, 6) AS recall, round(2 * tp / (support + predicted), 6) AS f1
        FROM {F1.format(by='1 AS one', t='true_category_primary', g='pp', src='(SELECT * FROM pred WHERE pp IS NOT NULL)').replace('SELECT 1 AS one, cls', 'SELECT one, cls')}""",
    "category_levels": """WITH f AS (SELECT inv.supplier_id, segment_code, inv.payment_terms, currency, region AS supplier_region, gl_account, direct_indirect,
            addressability, coalesce(category_primary, '__NA__') AS category_primary_hint FROM inv JOIN sup ON sup.supplier_id = inv.supplier_id)
        SELECT "column", "value", count(*) AS rows FROM (UNPIVOT f ON COLUMNS(*) INTO NAME "column" VALUE "value") GROUP BY 1, 2 HAVING count(*) >= 50""",
    "class_weights": """WITH c AS (SELECT true_category_primary AS label_primary, count(*) AS n FROM inv GROUP BY 1)
        SELECT label_primary, round(CAST((SELECT sum(n) FROM c) AS DOUBLE) / ((SELECT count(*) FROM c) * n), 9) AS weight FROM c""",
    "tfidf_vocabulary": f"""WITH {TERMS} SELECT term, CAST(i AS INT) AS "index", rows, round(idf, 9) AS idf FROM v""",
    "tfidf_rows": f"""WITH {TERMS}, e AS (SELECT doc_id, (1 + ln(n)) * idf AS w FROM c JOIN v USING (term)),
          l AS (SELECT doc_id, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM e)
        SELECT d.doc_id, count(w) AS n_terms, round(coalesce(sum(w), 0), 6) AS weight, round(coalesce(max(w), 0), 6) AS largest
        FROM documents d LEFT JOIN l USING (doc_id) GROUP BY d.doc_id""",
    "category_index": f"""WITH {LEVELS} SELECT "column", "value", "index", rows FROM numbered""",
    "encoded_rows": f"""WITH {LEVELS} SELECT invoice_line_id, string_agg("index"::VARCHAR, ',' ORDER BY "index") AS indices
        FROM pairs JOIN numbered USING ("column", "value") GROUP BY 1""",
    "boosted_first_trees": """WITH r AS (SELECT CAST(l_quantity AS DOUBLE) AS q, round(l_discount * 100) AS d, round(l_tax * 100) AS t,
            CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS s, CASE WHEN l_quantity <= 10 THEN 0 WHEN round(l_discount * 100) >= 6 THEN 1 ELSE 2 END AS y FROM lineitem),
          c AS (SELECT k, avg(CASE WHEN y = k THEN 1.0::DOUBLE ELSE 0 END) AS p FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY k),
          e AS (SELECT 0 AS f, q AS v, y FROM r UNION ALL SELECT 1, d, y FROM r UNION ALL SELECT 2, t, y FROM r UNION ALL SELECT 3, s, y FROM r),
          b AS (SELECT k, p, f, v, count(*) AS n, sum(p - CASE WHEN y = k THEN 1 ELSE 0 END) AS g FROM e, c GROUP BY k, p, f, v),
          x AS (SELECT k, p, f, v, sum(n) OVER l AS nl, sum(g) OVER l AS gl, sum(n) OVER a - sum(n) OVER l AS nr, sum(g) OVER a - sum(g) OVER l AS gr FROM b
            WINDOW l AS (PARTITION BY k, f ORDER BY v), a AS (PARTITION BY k, f)),
          y AS (SELECT *, gl * gl / (nl * p * (1 - p) + 1) + gr * gr / (nr * p * (1 - p) + 1) AS gain FROM x WHERE least(nl, nr) >= 20),
          z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY k ORDER BY round(gain, 6) DESC, f, v) = 1)
        SELECT k AS "class", 1 AS node, f AS feature, v AS threshold, NULL::DOUBLE AS "value" FROM z
        UNION ALL SELECT k, 2, NULL, NULL, round(-0.5 * gl / (nl * p * (1 - p) + 1), 9) FROM z
        UNION ALL SELECT k, 3, NULL, NULL, round(-0.5 * gr / (nr * p * (1 - p) + 1), 9) FROM z""",
    "boosted_interaction": 'SELECT count(*) AS lines, count(*) AS "right", true AS beats_regression FROM lineitem',
    "embedding_cache_diff": """SELECT DISTINCT sha256(text) AS text_hash, CAST(length(text) AS INT) AS chars FROM documents
        WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0)""",
    "parent_rollup": f"""SELECT {G}, pp AS predicted_primary_category, {D('sum(amount)', 'parent_spend')},
        count(DISTINCT supplier_id) AS suppliers_in_parent FROM {SPEND} GROUP BY ALL""",
    "hhi": f"""SELECT {K}, {D('sum(spend)', 'leaf_spend')}, count(*) AS suppliers, {HHI} AS hhi FROM {BASE} GROUP BY ALL""",
    "supplier_shares": f"""WITH b AS {BASE}, s AS (SELECT *, CAST(spend AS DOUBLE) / CAST(sum(spend) OVER (PARTITION BY {G}, predicted_secondary_category) AS DOUBLE) AS sh FROM b)
        SELECT {K}, supplier_id, {D('spend', 'spend')}, round(sh, 6) AS share, round(sh * sh, 6) AS hhi_contribution FROM s""",
    "concentration_over_time": f"""SELECT {BY}, predicted_secondary_category, {D('sum(spend)', 'leaf_spend')}, {HHI} AS hhi
        FROM (SELECT {BY}, pl AS predicted_secondary_category, supplier_id, sum(amount) AS spend FROM {SPEND} GROUP BY ALL) GROUP BY ALL""",
    "maverick_spend": f"""SELECT {K}, {D(f"sum(CASE WHEN {HINT} <> predicted_primary_category THEN spend ELSE 0 END)", 'maverick_spend')},
        {D('sum(spend)', 'total_spend')} FROM {BASE} GROUP BY ALL""",
    "maverick_suppliers": f"""SELECT supplier_id, {D(f"sum(CASE WHEN {HINT} <> predicted_primary_category THEN spend ELSE 0 END)", 'maverick_spend')},
        {D('sum(spend)', 'total_spend')} FROM {BASE} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""",
    "off_contract_by_leaf": f"""SELECT {K}, {D('sum(spend)', 'off_contract_spend')} FROM {BASE}
        WHERE supplier_id NOT IN {ACTIVE} GROUP BY ALL""",
    "tail_spend": f"""WITH b AS (SELECT segment_code, pl, sum(amount) AS s FROM {SPEND} GROUP BY ALL),
          t AS (SELECT *, CAST(s AS DOUBLE) / CAST(sum(s) OVER (PARTITION BY pl) AS DOUBLE) AS sh FROM b)
        SELECT segment_code, count(*) AS tail_leaves, {D('sum(s)', 'tail_spend')} FROM t WHERE sh < 0.19 GROUP BY 1""",
    "sourcing_strategy": f"""WITH b AS {BASE}, p AS (SELECT {G}, predicted_primary_category, sum(spend) AS ps, count(DISTINCT supplier_id) AS ns FROM b GROUP BY ALL)
        SELECT {K}, {D('sum(spend)', 'leaf_spend')}, count(*) AS suppliers, {HHI} AS hhi,
          {D(f"sum(CASE WHEN {HINT} <> predicted_primary_category THEN spend ELSE 0 END)", 'maverick_spend')},
          {D(f"sum(CASE WHEN supplier_id NOT IN {ACTIVE} THEN spend ELSE 0 END)", 'off_contract_spend')},
          {D('any_value(ps)', 'parent_spend')}, any_value(ns) AS suppliers_in_parent, {pct('sum(spend)', 'any_value(ps)', 2)} AS leaf_share_of_parent
        FROM b JOIN p USING ({G}, predicted_primary_category) GROUP BY ALL""",
    "contract_burn_down": f"""SELECT contract_workspace_id, ci.supplier_id, contract_type, {D('any_value(committed)', 'total_committed_spend')},
        {D('coalesce(sum(amount), 0)', 'spend_to_date')}, {pct('coalesce(sum(amount), 0)', 'any_value(committed)', 2)} AS pct_consumed,
        CAST(any_value(expiration_date) - DATE '1999-07-01' AS INT) AS days_left
        FROM ci LEFT JOIN inv ON inv.supplier_id = ci.supplier_id AND invoice_date >= DATE '1995-01-01'
          AND invoice_date <= least(expiration_date, DATE '1999-07-01')
        WHERE ci.status = 'Active' AND contract_type IN ('SOW', 'PRICING_AGREEMENT') GROUP BY 1, 2, 3""",
    "renewal_queue": f"""SELECT contract_workspace_id, ci.supplier_id, expiration_date, CAST(expiration_date - DATE '1998-01-03' AS INT) AS days_left,
        {D('coalesce(sum(amount), 0)', 'trailing_spend')} FROM ci LEFT JOIN inv ON inv.supplier_id = ci.supplier_id
          AND invoice_date > DATE '1997-01-03' AND invoice_date <= DATE '1998-01-03'
        WHERE expiration_date BETWEEN DATE '1998-01-03' AND DATE '1998-01-03' + 180 GROUP BY 1, 2, 3""",
    "contract_leakage": f"""SELECT segment_code, supplier_id, count(*) AS leaked_lines, {D('sum(amount)', 'leaked_amount')} FROM inv
        WHERE supplier_id IN {ACTIVE} AND NOT EXISTS (SELECT 1 FROM ci WHERE ci.supplier_id = inv.supplier_id AND ci.status = 'Active'
          AND invoice_date BETWEEN DATE '1995-01-01' AND ci.expiration_date) GROUP BY 1, 2""",
    "supplier_scorecard": f"""WITH t AS (SELECT supplier_id, sum(amount) AS spend, count(DISTINCT invoice_id) AS invoices,
            {pct('count(*) FILTER (on_time)', 'count(on_time)')} AS on_time_pct, round({mean('days_to_pay')}, 1) AS avg_days_to_pay FROM pay GROUP BY 1),
          m AS (SELECT supplier_id, true_category_primary AS top_category, sum(amount) AS s FROM inv GROUP BY 1, 2
            QUALIFY row_number() OVER (PARTITION BY supplier_id ORDER BY sum(amount) DESC, true_category_primary) = 1)
        SELECT supplier_id, {D('spend', 'spend')}, invoices, on_time_pct, avg_days_to_pay, top_category, payment_terms, maverick_propensity,
          is_regulated_supplier, {pct('s', 'spend')} AS top_category_pct FROM t JOIN m USING (supplier_id) JOIN sup USING (supplier_id)""",
    "supplier_category_mix": f"SELECT supplier_id, true_category_primary, true_category_secondary, {D('sum(amount)', 'spend')} FROM inv GROUP BY 1, 2, 3",
    "terms_targets": f"""WITH s AS (SELECT supplier_id, sum(amount) AS spend FROM inv GROUP BY 1),
          x AS (SELECT supplier_id, payment_terms, CASE payment_terms WHEN 'Net15' THEN 15 WHEN 'Net30' THEN 30 WHEN 'Net45' THEN 45 WHEN 'Net60' THEN 60 END AS d
            FROM sup WHERE NOT coalesce(is_regulated_supplier, FALSE))
        SELECT supplier_id, payment_terms, d AS current_days, {D('spend', 'spend')}, {D('spend * (60 - d)', 'opportunity')}
        FROM s JOIN x USING (supplier_id) WHERE d < 60 ORDER BY spend * (60 - d) DESC, supplier_id LIMIT 50""",
    "suggest_suppliers": f"""SELECT segment_code, true_category_secondary, supplier_id, {D('sum(amount)', 'spend')},
        CAST(row_number() OVER (PARTITION BY segment_code, true_category_secondary ORDER BY sum(amount) DESC, supplier_id) AS INT) AS position
        FROM inv WHERE addressability = 'Addressable' GROUP BY 1, 2, 3 QUALIFY position <= 3""",
    "price_history": f"""SELECT ['ECONOMY','LARGE','MEDIUM','PROMO','SMALL','STANDARD'][o_orderkey % 6 + 1] AS material_number, {BY}, count(*) AS order_lines,
        {D('min(value)', 'lowest_price')}, {D('max(value)', 'highest_price')}, round(CAST(sum(value) AS DOUBLE) / count(*), 4) AS average_price,
        {D("max_by(value, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') || 'PO-' || o_orderkey)", 'latest_price')}
        FROM pr JOIN orders USING (o_orderkey) WHERE pr_status = 'released' GROUP BY 1, 2, 3""",
    "label_coverage": f"SELECT {G}, count(*) AS lines, count(pl) AS predicted_lines, {pct('count(pl)', 'count(*)', 2)} AS coverage_pct FROM pred GROUP BY ALL",
    "confidence_histogram": """WITH u AS (SELECT 'primary' AS tier, pc AS c FROM pred UNION ALL SELECT 'secondary', lc FROM pred)
        SELECT tier, CAST(least(floor(CAST(c AS DECIMAL(12,9)) * 10), 9) AS INT) AS bin, count(*) AS lines FROM u WHERE c IS NOT NULL GROUP BY 1, 2""",
    "disagreements": f"""SELECT true_category_secondary, pl AS predicted_secondary_category, count(*) AS lines, {D('sum(amount)', 'amount')}
        FROM pred WHERE pl <> true_category_secondary GROUP BY 1, 2""",
    "metric_set": f"""SELECT {G}, {mm('amount')} AS spend_mm, {pct('sum(amount) FILTER (lc >= 0.75)', 'sum(amount)')} AS managed_spend_pct,
        {pct('count(pl)', 'count(*)')} AS category_coverage_pct, {pct("sum(amount) FILTER (po_matched_flag = 'Y')", 'sum(amount)')} AS po_compliance_pct
        FROM pred GROUP BY ALL""",
    "managed_flag": "SELECT invoice_line_id, lc >= 0.75 AS managed FROM pred WHERE pl IS NOT NULL",
    "savings_against_budget": f"""WITH s AS (SELECT {G}, sum(CAST(round(amount * CASE o_orderkey % 3 WHEN 0 THEN 1.10 WHEN 1 THEN 1.00 ELSE 1.02 END, 2) AS DECIMAL(18,2)) - amount) AS r,
            sum(CAST(round(amount * CASE o_orderkey % 3 WHEN 0 THEN 0.01 WHEN 1 THEN 0.05 ELSE 0.02 END, 2) AS DECIMAL(18,2))) AS a FROM bill GROUP BY ALL),
          b AS (SELECT {G}, sum(budget) AS budget FROM plan WHERE account_type <> 'REVENUE' GROUP BY ALL)
        SELECT {G}, {D('r', 'reduction')}, {D('a', 'avoidance')}, {D('r + a', 'total_savings')}, {D('budget', 'budget')},
          {pct('r + a', 'budget', 2)} AS savings_pct_of_budget FROM s LEFT JOIN b USING ({G})""",
    "model_trend": """WITH r AS (SELECT segment_code AS slice, make_date(fiscal_year, 12, 31) AS evaluated_at,
            count(*) FILTER (pl = true_category_secondary) / CAST(count(*) AS DOUBLE) AS acc FROM pred GROUP BY 1, 2)
        SELECT 'challenger' AS model_alias, slice, evaluated_at, round(acc, 6) AS secondary_top1_accuracy,
          round(acc - lag(acc) OVER (PARTITION BY slice ORDER BY evaluated_at), 6) AS change FROM r""",
    "supplier_resolution": """WITH RECURSIVE p AS (SELECT p_partkey, regexp_replace(p_brand, '[^0-9]', '', 'g') AS b, p_name || ' brand' AS t FROM part),
          n AS (SELECT b, t, min(p_partkey) AS node FROM p GROUP BY 1, 2),
          f AS (SELECT node, b || '|' || t AS form FROM n UNION
            SELECT node, b || '|' || substr(t, 1, i - 1) || substr(t, i + 1) FROM (SELECT *, CAST(unnest(range(1, length(t) + 1)) AS INT) AS i FROM n)),
          e AS (SELECT DISTINCT x.node AS u, y.node AS v FROM f x JOIN f y USING (form)),
          r AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u),
          c AS (SELECT u, min(v) AS root FROM r GROUP BY 1)
        SELECT p_partkey AS supplier_id, root AS canonical_supplier_id FROM p JOIN n USING (b, t) JOIN c ON c.u = n.node""",
    "entity_merges": f"""{ENTITIES}
        SELECT DISTINCT CAST(y.g AS INT) AS run, CAST(x.root // 1000000000 AS INT) AS since, CAST(x.root % 1000000000 AS VARCHAR) AS entity_id,
          CAST(y.root % 1000000000 AS VARCHAR) AS into_id FROM c x JOIN c y ON x.u = y.u AND x.g + 1 = y.g WHERE x.root <> y.root AND x.u = x.root""",
    "dim_supplier_resolved": f"""{ENTITIES}
        SELECT CAST(p_partkey AS VARCHAR) AS supplier_id, p_name || ' ' || p_brand AS supplier_name,
          CAST(root % 1000000000 AS VARCHAR) AS canonical_supplier_id, substr(sha256(CAST(root % 1000000000 AS VARCHAR)), 1, 16) AS entity_resolution_cluster_id
        FROM p JOIN part USING (p_partkey) JOIN n USING (b, t) JOIN c ON c.u = n.node AND c.g = 3 WHERE NOT again""",
}
