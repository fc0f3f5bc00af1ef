"""Builders and reports on small hand-made tables with known answers."""
import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerloom import gates
from ledgerloom.lake import Lake
from ledgerloom.plans import accounting, legal, planning, spend
from ledgerloom.tables import gold, silver

day = dt.date.fromisoformat


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_suppliers_from_two_sources(spark, rows):
    lake = Lake({
        "LFA1_SUPPLIER_MASTER": frame(spark, "LIFNR string, NAME1 string, LAND1 string, ERSDA date, SPRAS string,"
            " _supplier_category_primary string, _supplier_category_secondary_json string, _maverick_propensity double,"
            " _industry_segment_affinity string, _payment_terms string, _is_regulated_flag boolean",
            ("S1", "One", "DE", day("2020-01-01"), "DE", "Travel", "[]", 0.2, "HAD", "Net30", False)),
        "ap_supplier_sites_all": frame(spark, "vendor_site_id bigint, vendor_id_ext string, country string, purchasing_site_flag string",
            (1, "S1", "US", "Y"), (2, "S1", "FR", "N"), (3, "S2", None, "Y"))})
    conformed = silver.supplier(lake)
    assert rows(conformed, "supplier_id", "source_system") == [("S1", "oracle_fusion"), ("S1", "sap_ariba"), ("S2", "oracle_fusion")]
    dim = gold.dim_supplier(Lake({"supplier": conformed}))
    assert rows(dim, "supplier_id", "supplier_name", "region", "canonical_supplier_id") == [
        ("S1", "One", "EMEA", "S1"), ("S2", None, "OTHER", "S2")]


def test_request_join_and_status(spark, rows):
    lake = Lake({
        "EBAN_PR_HEADER": frame(spark, "BANFN string, BUKRS string, AFNAM string, ERDAT date, BSART string, STATU string, LFDAT date",
            *[(f"P{s}", "1100", "u", day("2024-05-02"), "NB", s, None) for s in "BLNX"], ("EMPTY", "1100", "u", day("2024-05-02"), "NB", "B", None)),
        "EBAN_PR_LINE": frame(spark, "BANFN string, BNFPO int, MATNR string, MATGROUP string, TXZ01 string, MENGE double, MEINS string,"
            " PREIS double, PEINH int, WAERS string, _supplier_intended string, _true_category_primary string, _true_category_secondary string",
            *[(f"P{s}", 10, "m", "g", "t", 2.0, "EA", 50.0, 100, "USD", "S1", "p", "l") for s in "BLNX"],
            ("ORPHAN", 10, "m", "g", "t", 2.0, "EA", 50.0, 1, "USD", "S1", "p", "l"))})
    requests = silver.purchase_request(lake)
    assert rows(requests, "pr_number", "pr_status", "source_primary_key") == [
        ("PB", "released", "PB/0010"), ("PL", "cancelled", "PL/0010"), ("PN", "open", "PN/0010"), ("PX", "x", "PX/0010")]
    fact = gold.fact_purchase_requests(Lake({"purchase_request": requests, "dim_supplier": _dim(spark)}))
    assert fact.select("estimated_extended_amount", "price_unit_adjusted").first()[:] == (D("100.00"), D("1.00"))
    assert fact.count() == 4


def _dim(spark):
    return frame(spark, "supplier_id string, supplier_name string, region string, country_code string, maverick_propensity double,"
                 " is_regulated_supplier boolean, segment_affinity string, category_primary string, payment_terms string",
                 ("S1", "One", "EMEA", "DE", 0.2, False, "HAD", "leaf", "Net30"), ("R", "Reg", "NA", "US", 0.0, True, "HPA", "x", "Net15"))


@pytest.fixture
def invoices(spark):
    header = frame(spark, "invoice_id bigint, invoice_num string, vendor_id_ext string, po_matched_flag string, source_po_header_id bigint,"
        " invoice_date date, gl_date date, due_date date, payment_date date, period_name string, payment_terms_name string,"
        " payment_status_flag string, invoice_currency string",
        *[(i, f"I{i}", who, "N" if i == 3 else "Y", None if i == 3 else 9, day("2024-03-01"), day("2024-03-01"), day("2024-03-31"), paid,
           "2024-03", "Net30", "PAID" if paid else "OPEN_CURRENT", "USD") for i, who, paid in [
            (1, "S1", day("2024-03-31")), (2, "S1", day("2024-04-01")), (3, "R", None), (4, "NOBODY", None)]])
    lines = frame(spark, "invoice_line_id bigint, invoice_id bigint, line_number bigint, line_type_lookup_code string, item_description string,"
        " quantity double, unit_price double, amount double, po_line_id bigint, code_combination_id bigint, _segment_code string,"
        " _true_category_primary string, _true_category_secondary string",
        *[(10 + i, i, 1, "ITEM", "text", 1.0, 100.0, 100.0, None if i == 3 else 5, 500 if i < 4 else 999, "HAD", "parent", "leaf") for i in (1, 2, 3, 4)])
    coa = frame(spark, "code_combination_id bigint, natural_account_code string, natural_account_type string", (500, "5000", "COGS"))
    empty = frame(spark, "invoice_line_id bigint, predicted_primary_category string, predicted_secondary_category string, primary_confidence double,"
                  " secondary_confidence double, model_version string, scored_at timestamp")
    lake = Lake({"ap_invoices_all": header, "ap_invoice_lines_all": lines, "dim_supplier": _dim(spark), "coa_account": coa, "invoice_classification": empty})
    return lake.extend({"invoice_ap": silver.invoice_ap(lake), "fact_invoices": lambda l, want: gold.fact_invoices(l, want)})


def test_payment_flags(invoices, rows):
    assert rows(invoices["invoice_ap"], "invoice_id", "is_on_time_payment", "days_to_pay") == [
        (1, True, 30), (2, False, 31), (3, None, None), (4, None, None)]


def test_fact_keeps_every_line(invoices, rows):
    fact = invoices["fact_invoices"]
    assert rows(fact, "invoice_id", "direct_indirect", "addressability", "po_line_id", "predicted_primary_category") == [
        (1, "Direct", "Addressable", 5, None), (2, "Direct", "Addressable", 5, None),
        (3, "Direct", "Non-Addressable", None, None), (4, "Indirect", "Addressable", 5, None)]


def test_only_needed_dimensions_are_joined(invoices):
    plan = lambda *c: invoices.pick("fact_invoices", *c)._jdf.queryExecution().optimizedPlan().toString()
    assert plan("segment_code", "amount").count("Join") == 1
    assert plan("segment_code", "direct_indirect").count("Join") == 2
    assert plan("addressability", "predicted_primary_category").count("Join") == 3


def test_unscored_lines_count_as_wrong(spark, invoices, rows):
    scored = frame(spark, "invoice_line_id bigint, predicted_primary_category string, predicted_secondary_category string, primary_confidence double,"
                   " secondary_confidence double, model_version string, scored_at timestamp", (11, "parent", "leaf", 0.9, 0.8, "1", None),
                   (12, "parent", "other", 0.7, 0.6, "1", None))
    got = rows(spend.q_sp12(invoices.extend({"invoice_classification": scored})))
    assert got == [(False, 2, None, None, 0.0, 0.0), (True, 2, 0.7, 0.8, 50.0, 100.0)]


def test_amendments_and_contract_value(spark, rows):
    lake = Lake({
        "contract": frame(spark, "contract_id string, contract_number string, customer_id string, entity_segment string, signed_date date, start_date date,"
            " end_date date, total_contract_value decimal(18,2), currency string, status string, commercial_terms string, governing_law string",
            *[(c, c, "K", "HAD", None, None, None, D("100.00"), "USD", "Active", "Net30", "x") for c in "ABC"]),
        "contract_amendment": frame(spark, "contract_id string, value_delta decimal(18,2)", ("B", D("10")), ("C", D("10")), ("C", D("-30")))})
    assert rows(silver.contract_outbound(lake), "contract_id", "amendment_value_delta", "effective_contract_value") == [
        ("A", D("0.00"), D("100.00")), ("B", D("10.00"), D("110.00")), ("C", D("-20.00"), D("80.00"))]


def test_off_contract_counts_a_line_once(spark, rows):
    lines = frame(spark, "fiscal_year int, fiscal_quarter int, segment_code string, supplier_id string, amount decimal(18,2)",
                  *[(2024, 1, "HAD", s, D("1000000")) for s in ("two", "expired", "none", None)])
    contracts = frame(spark, "supplier_id string, status string", ("two", "Active"), ("two", "Active"), ("expired", "Expired"))
    got = rows(legal.q_lg6(Lake({"fact_invoices": lines, "contract_inbound": contracts})))
    assert got == [("HAD", 2024, 1, 3, 3.0)]


def _entries(spark, *rows):
    return frame(spark, "fiscal_year int, fiscal_quarter int, segment_code string, account_type string, accounted_dr decimal(18,2), accounted_cr decimal(18,2)", *rows)


def test_actuals_budget_forecast(spark, rows):
    z = D("0")
    entries = _entries(spark, (2024, 1, "A", "REVENUE", z, D("100")), (2024, 1, "A", "COGS", D("60"), z), (2024, 1, "A", "BS", D("60"), z),
                       (2024, 3, "A", "REVENUE", z, D("200")), (2024, 4, "A", "REVENUE", D("10"), D("310")))
    lake = Lake({"fact_gl_entries": entries})
    lake = lake.extend({"fact_fpa_actuals": gold.fact_fpa_actuals(lake)})
    lake = lake.extend({"fact_fpa_budgets": gold.fact_fpa_budgets(lake)})
    keys = ("fiscal_quarter", "account_type", "amount_usd")
    assert rows(lake["fact_fpa_actuals"], *keys) == [(1, "COGS", D("60.00")), (1, "REVENUE", D("100.00")), (3, "REVENUE", D("200.00")), (4, "REVENUE", D("300.00"))]
    assert rows(lake["fact_fpa_budgets"], *keys) == [(1, "COGS", None), (1, "REVENUE", None), (3, "REVENUE", D("103.00")), (4, "REVENUE", D("206.00"))]
    assert rows(gold.fact_fpa_forecasts(lake), *keys) == [(1, "COGS", D("0.00")), (1, "REVENUE", D("0.00")), (3, "REVENUE", D("101.50")), (4, "REVENUE", D("203.00"))]
    strict = rows(gold.fact_fpa_budgets(lake, strict_quarter=True), *keys)
    assert (3, "REVENUE", None) in strict and (4, "REVENUE", D("206.00")) in strict


def test_operating_income_and_its_reference(spark):
    m = D("1000000")
    actuals = frame(spark, "fiscal_year int, fiscal_quarter int, segment_code string, account_type string, amount_usd decimal(28,2)",
                    *[(2024, 1, "A", k, v * m) for k, v in (("REVENUE", 10), ("COGS", 4), ("SGA", 2), ("RD", 1))])
    row = planning.q_fp4(Lake({"fact_fpa_actuals": actuals})).first()
    assert (row.op_income_mm, row.op_income_ref_mm) == (3.0, 6.0)


def test_funnel_keeps_late_stages(spark, rows):
    q = "fiscal_year int, fiscal_quarter int"
    lake = Lake({
        "fact_purchase_requests": frame(spark, f"{q}, pr_status string, estimated_extended_amount decimal(18,2)", (2024, 1, "released", D("1000000"))),
        "fact_purchase_orders": frame(spark, f"{q}, extended_amount decimal(18,2)", (2024, 2, D("2000000"))),
        "fact_invoices": frame(spark, f"{q}, amount decimal(18,2)", (2024, 2, D("3000000")))})
    assert rows(spend.q_sp5(lake)) == [(2024, 1, 1, 1, 0, 1.0, None, None, None, None), (2024, 2, None, None, None, None, 1, 2.0, 1, 3.0)]


def test_journal_tolerance(spark, rows):
    lines = frame(spark, "je_header_id bigint, accounted_dr decimal(18,2), accounted_cr decimal(18,2)",
                  (1, D("5"), D("5")), (2, D("5.01"), D("5")), (3, D("5.02"), D("5")))
    assert rows(gates.journal_gate(lines), "key", "level") == [("3", "breach")]
    assert accounting.q_ac2(Lake({"gl_journal_line": lines})).first()[:] == (3, 1, D("0.02"))


def test_gates_fail_on_cue(spark):
    keys = "fiscal_year int, fiscal_quarter int, segment_code string"
    targets = frame(spark, f"{keys}, target decimal(18,2)", (2024, 1, "A", D("100")), (2024, 1, "B", D("50")))
    good = frame(spark, f"{keys}, amount decimal(18,2)", (2024, 1, "A", D("102")), (2024, 1, "B", D("50")))
    assert gates.enforce(gates.spend_gate(good, targets)) == {"ok": 2}
    with pytest.raises(gates.GateFailure, match="1 breach"):
        gates.enforce(gates.spend_gate(good.where("segment_code = 'A'"), targets))
    taxonomy = gold.dim_spend_category(spark)
    mixed = frame(spark, "true_category_primary string, true_category_secondary string", ("Logistics", "Travel"), ("Logistics", "Logistics_Freight"), (None, None))
    with pytest.raises(gates.GateFailure, match="Logistics/Travel"):
        gates.enforce(gates.taxonomy_gate("t", mixed, taxonomy))


def test_file_quarter_against_document_quarter(spark, rows):
    lines = frame(spark, "fiscal_year int, fiscal_quarter int, segment_code string, amount decimal(18,2), _source_file string",
                  (2024, 2, "A", D("7"), "/l/ap_invoice_lines_all_2024Q1.parquet"), (2024, 1, "A", D("3"), "/l/ap_invoice_lines_all_2024Q1.parquet"))
    assert rows(gates.timing_differences(lines)) == [("2024Q1", "2024Q2", 1, D("7.00"))]
    assert rows(gates.by_file_quarter(lines), "fiscal_year", "fiscal_quarter") == [(2024, 1), (2024, 1)]
