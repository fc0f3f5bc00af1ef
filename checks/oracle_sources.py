"""DuckDB SQL for the source and sink queries: what the tables say, without the files in between."""

from __future__ import annotations

from ledgerloom import fixed_values as fixed

SEGMENT = "['HAD','HPA','HSB','HET','CORP'][{} % 5 + 1]"
PRICE = "CAST(round(o_totalprice * 100) AS DECIMAL(18,0)) / 100"
EARLY = "o_orderdate < TIMESTAMP '1998-01-01'"
LABEL = f"CASE WHEN {EARLY} THEN 1997 ELSE 2001 END AS fiscal_year"


def money(x: str = PRICE) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(18,2))) AS DOUBLE)"


def values(rows) -> str:
    def one(v):
        return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


LEAVES = [(parent, *leaf[:1], *leaf[2:4]) for parent, _, leaves in fixed.SPEND_TAXONOMY for leaf in leaves]

SQL = {
    "csv_full_scan": """SELECT c_custkey AS cust_acct_site_id, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS cust_account_id_ext,
          c_name || ', "Ltd"' AS customer_name, CAST(c_nationkey AS VARCHAR) AS country, CAST(NULL AS VARCHAR) AS city,
          true AS has_source, true AS has_time FROM customer""",
    "json_full_scan": f"""SELECT {SEGMENT.format('o_custkey')} AS entity_segment,
          CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS quarter_end,
          o_orderstatus AS status, count(*) AS contracts, {money()} AS value, CAST(0 AS BIGINT) AS customers FROM orders GROUP BY 1, 2, 3""",
    "csv_incremental": f"""SELECT {LABEL}, CASE WHEN {EARLY} THEN 4 ELSE 3 END AS fiscal_quarter, o_orderstatus AS status,
          count(*) AS invoices, {money()} AS amount, max(CAST(o_orderdate AS DATE)) AS last_day,
          (SELECT count(*) FROM orders WHERE {EARLY}) AS added_1, (SELECT count(*) FROM orders WHERE NOT ({EARLY})) AS added_2,
          CAST(0 AS BIGINT) AS added_3 FROM orders GROUP BY 1, 2, 3""",
    "json_incremental": f"""SELECT {SEGMENT.format('o_custkey')} AS segment_code, strftime(o_orderdate, '%Y-%m') AS month,
          count(*) AS bills, {money()} AS amount, CAST(0 AS BIGINT) AS added_again FROM orders GROUP BY 1, 2""",
    "full_refresh": f"""SELECT {LABEL}, count(*) AS invoices, {money(f'{PRICE} * CASE WHEN {EARLY} THEN 2 ELSE 1 END')} AS amount
          FROM orders GROUP BY 1""",
    "store_versions": f"""SELECT o_orderstatus, count(*) AS orders, count(*) FILTER (NOT ({EARLY})) AS priced,
          {money(f'CASE WHEN NOT ({EARLY}) THEN {PRICE} END')} AS price, max(o_orderkey) AS last_key, CAST(0 AS BIGINT) AS empty_rows
          FROM orders GROUP BY 1""",
    "replaced_view": f"SELECT o_orderstatus, count(*) AS orders, min(o_orderkey) AS first_key FROM orders WHERE NOT ({EARLY}) GROUP BY 1",
    "export_kinds": """SELECT kind, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS segment, count(*) AS customers,
          CAST(sum(CAST(CAST(round(c_acctbal * 100) AS DECIMAL(18,0)) / 100 AS DECIMAL(18,2))) AS DOUBLE) AS balance, max(c_name) AS last_name
          FROM customer, (VALUES ('csv'), ('json'), ('parquet')) AS k(kind) GROUP BY 1, 2""",
    "segment_names": f"""SELECT s.*, count(c_custkey) AS customers FROM (VALUES {values(fixed.SEGMENTS)}) AS s(segment_code, segment_name, company_code, sort_order)
          LEFT JOIN customer ON {SEGMENT.format('c_custkey')} = s.segment_code GROUP BY ALL""",
    "category_names": f"""SELECT primary_code, secondary_code, gl_account, gl_account_type, gl_account_type = 'COGS' AS is_direct,
          count(*) AS parts, min(p_partkey) AS first_part
          FROM (SELECT *, row_number() OVER (ORDER BY secondary_code) - 1 AS place FROM (VALUES {values(LEAVES)}) AS t(primary_code, secondary_code, gl_account, gl_account_type))
          JOIN part ON p_partkey % {len(LEAVES)} = place GROUP BY ALL""",
    "order_calendar": """SELECT CAST(year(o_orderdate) AS INT) AS calendar_year, strftime(o_orderdate, '%b') AS month_short_name,
          strftime(o_orderdate, '%A') AS day_name, dayofweek(o_orderdate) IN (0, 6) AS is_weekend, count(*) AS orders FROM orders GROUP BY ALL""",
    "month_spine": """SELECT CAST(m AS DATE) AS period_month, count(o_orderkey) AS orders
          FROM generate_series(TIMESTAMP '1994-11-01', TIMESTAMP '2002-02-01', INTERVAL 1 MONTH) AS g(m)
          LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 97 = 0) ON date_trunc('month', o_orderdate) = m GROUP BY 1""",
}
