"""Explicit column types of the source files. Inference would lose leading zeros in codes."""

from __future__ import annotations

from dataclasses import dataclass

# File format, folder, whether one file arrives per quarter, and the columns in file order.
PROCUREMENT, LEDGER, CONTRACTS, PEOPLE = "sap_ariba", "oracle_fusion", "inhouse_cms", "workday"


@dataclass(frozen=True)
class Source:
    name: str
    folder: str
    kind: str
    incremental: bool
    columns: str

    @property
    def pattern(self) -> str:
        ending = {"csv": "csv", "parquet": "parquet", "json": "jsonl"}[self.kind]
        return f"{self.folder}/{self.name}{'_*' if self.incremental else ''}.{ending}"


_ALL = [
    Source("LFA1_SUPPLIER_MASTER", PROCUREMENT, "csv", False,
           "LIFNR string, NAME1 string, LAND1 string, ERSDA date, SPRAS string, _supplier_category_primary string,"
           " _supplier_category_secondary_json string, _maverick_propensity double,"
           " _industry_segment_affinity string, _payment_terms string, _is_regulated_flag boolean"),
    Source("ARIBA_CONTRACT_WORKSPACE", PROCUREMENT, "csv", False,
           "ContractWorkspaceId string, ContractType string, Title string, AwardedSupplierId string,"
           " EffectiveDate date, ExpirationDate date, TotalCommittedSpend decimal(18,2),"
           " ActualSpendToDate decimal(18,2), Status string, OwningRegion string"),
    Source("ARIBA_SOURCING_EVENT", PROCUREMENT, "csv", False,
           "EventId string, EventType string, Title string, OwnerOrgUnit string, CreatedOn date, ClosedOn date,"
           " SupplierInvitedCount int, SupplierRespondedCount int, AwardedSupplierId string,"
           " AwardedAmount decimal(18,2), Status string"),
    Source("ARIBA_SUPPLIER_PERFORMANCE", PROCUREMENT, "csv", True,
           "SupplierId string, EvaluationQuarter string, OnTimeDeliveryPct double, QualityScore double,"
           " ResponsivenessScore double, OverallRating double, EvaluatorOrgUnit string"),
    Source("EBAN_PR_HEADER", PROCUREMENT, "csv", True,
           "BANFN string, BUKRS string, AFNAM string, ERDAT date, BSART string, STATU string, LFDAT date"),
    Source("EBAN_PR_LINE", PROCUREMENT, "csv", True,
           "BANFN string, BNFPO int, MATNR string, MATGROUP string, TXZ01 string, MENGE decimal(18,3),"
           " MEINS string, PREIS decimal(18,2), PEINH int, WAERS string, _supplier_intended string,"
           " _true_category_primary string, _true_category_secondary string"),
    Source("gl_periods", LEDGER, "csv", False,
           "period_name string, period_year int, period_num int, start_date date, end_date date, period_status string"),
    Source("gl_code_combinations", LEDGER, "csv", False,
           "code_combination_id bigint, segment1_entity string, segment2_cost_center string,"
           " segment3_natural_account string, segment4_product string, segment5_intercompany string,"
           " segment6_future1 string, segment7_future2 string, natural_account_description string,"
           " natural_account_type string, _segment_code string, enabled_flag string"),
    Source("ap_supplier_sites_all", LEDGER, "csv", False,
           "vendor_site_id bigint, vendor_id_ext string, vendor_site_code string, country string,"
           " address_line1 string, city string, postal_code string, purchasing_site_flag string, pay_site_flag string"),
    Source("ar_customer_sites_all", LEDGER, "csv", False,
           "cust_acct_site_id bigint, cust_account_id_ext string, customer_name string, site_use_code string,"
           " country string, address_line1 string, city string, postal_code string"),
    Source("po_headers_all", LEDGER, "csv", True,
           "po_header_id bigint, segment1 string, type_lookup_code string, vendor_id_ext string,"
           " vendor_site_code string, currency_code string, creation_date date, approved_date date,"
           " po_status string, source_requisition_number_ext string"),
    Source("po_lines_all", LEDGER, "parquet", True,
           "po_line_id bigint, po_header_id bigint, line_num bigint, item_id_ext string, item_description string,"
           " quantity_committed double, unit_price double, currency_code string, material_group_code string,"
           " uom string, source_pr_number_ext string, source_pr_line_num_ext bigint, _segment_code string,"
           " _true_category_primary string, _true_category_secondary string"),
    Source("ap_invoices_all", LEDGER, "csv", True,
           "invoice_id bigint, invoice_num string, vendor_id_ext string, invoice_amount decimal(18,2),"
           " invoice_currency string, invoice_date date, gl_date date, period_name string,"
           " payment_terms_name string, due_date date, payment_date date, payment_status_flag string,"
           " po_matched_flag string, source_po_header_id bigint"),
    Source("ap_invoice_lines_all", LEDGER, "parquet", True,
           "invoice_line_id bigint, invoice_id bigint, line_number bigint, line_type_lookup_code string,"
           " item_description string, quantity double, unit_price double, amount double, po_line_id bigint,"
           " code_combination_id bigint, _segment_code string, _true_category_primary string,"
           " _true_category_secondary string"),
    Source("ar_invoices_all", LEDGER, "csv", True,
           "customer_trx_id bigint, trx_number string, cust_account_id_ext string, trx_date date, gl_date date,"
           " period_name string, invoice_currency_code string, total_amount decimal(18,2), status string"),
    Source("gl_je_headers", LEDGER, "csv", True,
           "je_header_id bigint, period_name string, ledger_id int, je_source string, je_category string,"
           " posted_flag string, posted_date date, currency_code string"),
    Source("gl_je_lines", LEDGER, "parquet", True,
           "je_header_id bigint, je_line_num bigint, code_combination_id bigint, entered_dr double,"
           " entered_cr double, accounted_dr double, accounted_cr double, description string"),
    Source("gl_trial_balance", LEDGER, "csv", True,
           "code_combination_id bigint, period_net_dr decimal(18,2), period_net_cr decimal(18,2),"
           " period_name string, period_net_balance decimal(18,2)"),
    Source("gl_balances", LEDGER, "parquet", True,
           "code_combination_id bigint, period_net_dr double, period_net_cr double, period_name string, balance double"),
    Source("contract", CONTRACTS, "json", False,
           "contract_id string, contract_number string, customer_id string, entity_segment string,"
           " signed_date date, start_date date, end_date date, total_contract_value decimal(18,2),"
           " currency string, status string, commercial_terms string, governing_law string"),
    Source("contract_party", CONTRACTS, "json", False,
           "contract_id string, party_role string, party_id string, party_name string, segment_code string"),
    Source("contract_line_item", CONTRACTS, "json", False,
           "contract_id string, line_no bigint, product_sku string, product_description string, qty bigint,"
           " unit_price decimal(18,2), currency string, revenue_recognition_method string, pct_complete double,"
           " line_amount decimal(18,2)"),
    Source("contract_amendment", CONTRACTS, "json", False,
           "contract_id string, amendment_no bigint, amendment_type string, effective_date date,"
           " value_delta decimal(18,2)"),
    Source("performance_obligation", CONTRACTS, "json", False,
           "obligation_id string, contract_id string, description string, standalone_selling_price decimal(18,2),"
           " recognition_pattern string, expected_completion_date date"),
    Source("billing_schedule", CONTRACTS, "json", True,
           "schedule_id string, contract_id string, customer_id string, segment_code string, bill_date date,"
           " amount decimal(18,2), currency string, status string"),
    Source("workers", PEOPLE, "csv", False,
           "worker_id string, version_seq bigint, effective_date date, effective_through date,"
           " is_current_row boolean, worker_name_first string, worker_name_last string, work_email string,"
           " hire_date date, termination_date date, worker_status string, organization_id string,"
           " cost_center_id string, country_code string, region string, job_family string,"
           " compensation_grade string, annual_base_salary_amount decimal(18,2), currency_code string"),
]
SOURCES = {s.name: s for s in _ALL}
