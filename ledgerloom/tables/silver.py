"""Conformed tables: typed, renamed, header and line joined, with lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import rules as R
from ledgerloom.lake import Lake
from ledgerloom.operators.keyed import one_per_key

FUSION, ARIBA, CMS = "oracle_fusion", "sap_ariba", "inhouse_cms"


def supplier(lake: Lake) -> DataFrame:
    """Source-tagged supplier master: every named supplier, plus every purchasing site.

    Resolved ids come from the table `supplier_entities`, if the lake has it.
    """
    master = lake["LFA1_SUPPLIER_MASTER"]
    named = master.select(
        *R.lineage(ARIBA, "LFA1_SUPPLIER_MASTER", "LIFNR"),
        F.col("LIFNR").alias("supplier_id"), F.col("NAME1").alias("supplier_name"),
        F.col("LAND1").alias("country_code"), R.region_of("LAND1").alias("region"),
        F.col("SPRAS").alias("language_code"), R.cast("ERSDA", "date", "created_date"),
        F.col("_supplier_category_primary").alias("category_primary"),
        F.col("_supplier_category_secondary_json").alias("category_secondary_json"),
        R.cast("_maverick_propensity", "double", "maverick_propensity"),
        F.col("_industry_segment_affinity").alias("segment_affinity"),
        F.col("_payment_terms").alias("payment_terms"),
        R.cast("_is_regulated_flag", "boolean", "is_regulated_supplier"))
    sites = lake["ap_supplier_sites_all"].where(F.col("purchasing_site_flag") == "Y").select(
        *R.lineage(FUSION, "ap_supplier_sites_all", "vendor_site_id"),
        F.col("vendor_id_ext").alias("supplier_id"),
        F.col("country").alias("country_code"), R.region_of("country").alias("region"))
    # Columns a site does not have come out as typed NULLs.
    every = named.unionByName(sites, allowMissingColumns=True)
    if "supplier_entities" not in lake:
        return every.select("*", R.null("string", "supplier_canonical_id"), R.null("string", "entity_resolution_cluster_id"))
    return every.join(lake.pick("supplier_entities", "supplier_id", "entity_resolution_cluster_id", supplier_canonical_id="canonical_supplier_id"),
                      "supplier_id", "left").select(*every.columns, "supplier_canonical_id", "entity_resolution_cluster_id")


def customer(lake: Lake) -> DataFrame:
    """One row per account. Its first site gives name and country, its first contract the segment."""
    sites = lake["ar_customer_sites_all"].select(
        F.col("cust_account_id_ext").alias("customer_id"), "customer_name",
        F.col("country").alias("country_code"), "cust_acct_site_id")
    # "First" needs an order to be repeatable: lowest site number, lowest contract id.
    master = one_per_key(sites, ["customer_id"], [
        F.col("cust_acct_site_id"), F.col("country_code"), F.col("customer_name")])
    parties = lake["contract_party"].where(F.col("party_role") == "Customer")
    segments = parties.join(lake["contract"].select("contract_id", "entity_segment"), "contract_id") \
        .groupBy(F.col("party_id").alias("customer_id")) \
        .agg(F.min_by("entity_segment", F.struct("contract_id", "entity_segment")).alias("primary_segment_code"))
    return master.join(segments, "customer_id", "left").select(
        *R.lineage(FUSION, "ar_customer_sites_all+cms", "customer_id"),
        "customer_id", "customer_name", "country_code",
        R.region_of("country_code").alias("region"), "primary_segment_code")


def purchase_request(lake: Lake) -> DataFrame:
    joined = lake["EBAN_PR_LINE"].join(lake["EBAN_PR_HEADER"], "BANFN")
    key = F.concat("BANFN", F.lit("/"), F.lpad(F.col("BNFPO").cast("string"), 4, "0"))
    return joined.select(
        *R.lineage(ARIBA, "EBAN_PR_HEADER+LINE", key),
        F.col("BANFN").alias("pr_number"), R.cast("BNFPO", "int", "pr_line_num"),
        F.col("BUKRS").alias("company_code"), R.segment_of_company("BUKRS").alias("segment_code"),
        F.col("AFNAM").alias("requester_id"), R.cast("ERDAT", "date", "pr_created_date"),
        R.cast("LFDAT", "date", "requested_delivery_date"), F.col("BSART").alias("pr_doc_type"),
        F.col("STATU").alias("pr_status_code"), R.request_status("STATU").alias("pr_status"),
        F.col("_supplier_intended").alias("intended_supplier_id"),
        F.col("MATNR").alias("material_number"), F.col("MATGROUP").alias("material_group_code"),
        F.col("TXZ01").alias("line_description"), R.quantity("MENGE", "quantity"),
        F.col("MEINS").alias("uom"), R.money("PREIS", "estimated_unit_price"),
        R.cast("PEINH", "int", "price_unit"), F.col("WAERS").alias("currency"),
        F.col("_true_category_primary").alias("true_category_primary"),
        F.col("_true_category_secondary").alias("true_category_secondary"), *R.fiscal("ERDAT"))


def purchase_order(lake: Lake) -> DataFrame:
    """Order lines; the fiscal period follows the approval date."""
    header = lake["po_headers_all"].select(
        "po_header_id", "segment1", "vendor_id_ext", "vendor_site_code", "type_lookup_code",
        "po_status", "creation_date", "approved_date")
    return lake["po_lines_all"].join(header, "po_header_id").select(
        *R.lineage(FUSION, "po_headers_all+po_lines_all", "po_line_id"),
        R.cast("po_header_id", "bigint"), R.cast("po_line_id", "bigint"),
        F.col("segment1").alias("po_number"), R.cast("line_num", "int", "po_line_num"),
        F.col("vendor_id_ext").alias("supplier_id"), F.col("vendor_site_code").alias("supplier_site_code"),
        F.col("type_lookup_code").alias("po_doc_type"), "po_status",
        R.cast("creation_date", "date", "po_created_date"),
        R.cast("approved_date", "date", "po_approved_date"), *R.fiscal("approved_date"),
        F.col("_segment_code").alias("segment_code"), F.col("item_id_ext").alias("material_number"),
        "material_group_code", F.col("item_description").alias("line_description"),
        R.quantity("quantity_committed", "quantity"), "uom", R.money("unit_price"),
        R.money(F.col("quantity_committed") * F.col("unit_price"), "extended_amount"),
        F.col("currency_code").alias("currency"),
        F.col("source_pr_number_ext").alias("source_pr_number"),
        R.cast("source_pr_line_num_ext", "int", "source_pr_line_num"),
        F.col("_true_category_primary").alias("true_category_primary"),
        F.col("_true_category_secondary").alias("true_category_secondary"))


def invoice_ap(lake: Lake) -> DataFrame:
    """Supplier invoice lines with their header; the fiscal period follows the invoice date."""
    header = lake["ap_invoices_all"].select(
        "invoice_id", "invoice_num", "vendor_id_ext", "po_matched_flag", "source_po_header_id",
        *[R.cast(c, "date") for c in ("invoice_date", "gl_date", "due_date", "payment_date")],
        "period_name", "payment_terms_name", "payment_status_flag", "invoice_currency")
    return lake["ap_invoice_lines_all"].join(header, "invoice_id").select(
        *R.lineage(FUSION, "ap_invoice_lines_all+ap_invoices_all", "invoice_line_id"),
        R.cast("invoice_line_id", "bigint"), R.cast("invoice_id", "bigint"),
        F.col("invoice_num").alias("invoice_number"), R.cast("line_number", "int"),
        F.col("line_type_lookup_code").alias("line_type"), F.col("vendor_id_ext").alias("supplier_id"),
        "po_matched_flag", R.cast("source_po_header_id", "bigint"), R.cast("po_line_id", "bigint"),
        "invoice_date", "gl_date", "period_name", F.col("payment_terms_name").alias("payment_terms"),
        "due_date", "payment_date", F.col("payment_status_flag").alias("payment_status"),
        F.col("invoice_currency").alias("currency"),
        R.paid_on_time("payment_date", "due_date").alias("is_on_time_payment"),
        R.days_to_pay("payment_date", "invoice_date").alias("days_to_pay"),
        F.col("item_description").alias("line_description"), R.quantity("quantity"),
        R.money("unit_price"), R.money("amount"), R.cast("code_combination_id", "bigint"),
        F.col("_segment_code").alias("segment_code"),
        F.col("_true_category_primary").alias("true_category_primary"),
        F.col("_true_category_secondary").alias("true_category_secondary"), *R.fiscal("invoice_date"))


def sourcing_event(lake: Lake) -> DataFrame:
    return lake["ARIBA_SOURCING_EVENT"].select(
        *R.lineage(ARIBA, "ARIBA_SOURCING_EVENT", "EventId"),
        F.col("EventId").alias("event_id"), F.col("EventType").alias("event_type"),
        F.col("Title").alias("title"), F.col("OwnerOrgUnit").alias("owner_org_unit"),
        R.cast("CreatedOn", "date", "created_on"), R.cast("ClosedOn", "date", "closed_on"),
        F.col("SupplierInvitedCount").alias("suppliers_invited"),
        F.col("SupplierRespondedCount").alias("suppliers_responded"),
        F.col("AwardedSupplierId").alias("awarded_supplier_id"),
        R.money("AwardedAmount", "awarded_amount"), F.col("Status").alias("status"),
        *R.fiscal("ClosedOn"))


def invoice_classification(lake: Lake) -> DataFrame:
    return lake["invoice_classifications"].select(
        R.cast("invoice_line_id", "bigint"), "predicted_primary_category",
        "predicted_secondary_category", R.cast("primary_confidence", "double"),
        R.cast("secondary_confidence", "double"), "model_version", R.cast("scored_at", "timestamp"))


def invoice_ar(lake: Lake) -> DataFrame:
    return lake["ar_invoices_all"].select(
        *R.lineage(FUSION, "ar_invoices_all", "customer_trx_id"),
        F.col("trx_number").alias("invoice_number"), F.col("cust_account_id_ext").alias("customer_id"),
        R.cast("trx_date", "date", "invoice_date"), R.cast("gl_date", "date", "posting_date"),
        "period_name", F.col("invoice_currency_code").alias("currency"),
        R.money("total_amount"), "status", *R.fiscal("trx_date"))


def gl_journal_header(lake: Lake) -> DataFrame:
    return lake["gl_je_headers"].select(
        *R.lineage(FUSION, "gl_je_headers", "je_header_id"), R.cast("je_header_id", "bigint"),
        "period_name", "ledger_id", "je_source", "je_category", "posted_flag",
        R.cast("posted_date", "date"), "currency_code", *R.fiscal("posted_date"))


def gl_journal_line(lake: Lake) -> DataFrame:
    key = F.concat_ws("/", F.col("je_header_id").cast("string"), F.col("je_line_num").cast("string"))
    return lake["gl_je_lines"].select(
        *R.lineage(FUSION, "gl_je_lines", key), R.cast("je_header_id", "bigint"), "je_line_num",
        R.cast("code_combination_id", "bigint"), R.money("entered_dr"), R.money("entered_cr"),
        R.money("accounted_dr"), R.money("accounted_cr"),
        R.money(F.col("accounted_dr") - F.col("accounted_cr"), "net_amount"), "description")


def coa_account(lake: Lake) -> DataFrame:
    """Account combinations; a segment outside the known ones becomes OTHER."""
    return lake["gl_code_combinations"].select(
        *R.lineage(FUSION, "gl_code_combinations", "code_combination_id"),
        R.cast("code_combination_id", "bigint"), F.col("segment1_entity").alias("entity_code"),
        F.col("segment2_cost_center").alias("cost_center_code"),
        F.col("segment3_natural_account").alias("natural_account_code"),
        F.col("segment4_product").alias("product_code"),
        F.col("segment5_intercompany").alias("intercompany_code"),
        "segment6_future1", "segment7_future2", "natural_account_description", "natural_account_type",
        R.known_segment("_segment_code").alias("segment_code"), "enabled_flag")


def contract_inbound(lake: Lake) -> DataFrame:
    return lake["ARIBA_CONTRACT_WORKSPACE"].select(
        *R.lineage(ARIBA, "ARIBA_CONTRACT_WORKSPACE", "ContractWorkspaceId"),
        F.col("ContractWorkspaceId").alias("contract_workspace_id"),
        F.col("ContractType").alias("contract_type"), F.col("Title").alias("title"),
        F.col("AwardedSupplierId").alias("supplier_id"),
        R.cast("EffectiveDate", "date", "effective_date"),
        R.cast("ExpirationDate", "date", "expiration_date"),
        R.money("TotalCommittedSpend", "total_committed_spend"),
        R.money("ActualSpendToDate", "actual_spend_to_date"),
        F.col("Status").alias("status"), F.col("OwningRegion").alias("region"))


def contract_outbound(lake: Lake) -> DataFrame:
    """Customer contracts with the value all amendments leave them at."""
    deltas = lake["contract_amendment"].groupBy("contract_id") \
        .agg(F.sum(R.money("value_delta")).alias("_delta"))
    value, delta = R.money("total_contract_value"), R.money(F.coalesce("_delta", F.lit(0)))
    return lake["contract"].join(deltas, "contract_id", "left").select(
        *R.lineage(CMS, "contract", "contract_id"), "contract_id", "contract_number", "customer_id",
        F.col("entity_segment").alias("segment_code"), R.cast("signed_date", "date"),
        R.cast("start_date", "date"), R.cast("end_date", "date"),
        R.money("total_contract_value"), delta.alias("amendment_value_delta"),
        R.money(value + delta, "effective_contract_value"), "currency", "status",
        "commercial_terms", "governing_law")


BUILDERS = {f.__name__: f for f in (
    supplier, customer, purchase_request, purchase_order, invoice_ap, sourcing_event,
    invoice_classification, invoice_ar, gl_journal_header, gl_journal_line, coa_account,
    contract_inbound, contract_outbound)}
