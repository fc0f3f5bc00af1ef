"""Presents the retail order tables (customer, orders, lineitem, ...) as finance tables.

The driver tables are not finance data, so this module says which column stands for which finance
concept. It yields raw-shaped tables for the conforming builders and conformed tables for the
analyst queries; everything downstream is the ordinary library code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.functions import rules as R
from ledgerloom.lake import Lake, settled
from ledgerloom.operators import posting
from ledgerloom.operators.history import scd2
from ledgerloom.session import tune
from ledgerloom.tables import gold, silver

# Fixed values of the mapping.
SEGMENT_NUMBER = {"AUTOMOBILE": "1", "BUILDING": "2", "FURNITURE": "3", "HOUSEHOLD": "4", "MACHINERY": "5"}
PART_ACCOUNT = {"ECONOMY": "5000", "STANDARD": "5030", "LARGE": "6020", "MEDIUM": "6030", "SMALL": "6040",
                "PROMO": "7000"}
ACCOUNT_TYPE = {"5000": "COGS", "5030": "COGS", "6020": "SGA", "6030": "SGA", "6040": "SGA", "7000": "RD",
                "4000": "REVENUE", "1000": "BS", "1100": "BS", "2000": "BS"}
NATION_COUNTRY = ["US", "CA", "MX", "DE", "FR", "GB", "IT", "ES", "NL", "BE", "PL", "CZ", "CN", "JP", "IN",
                  "KR", "AU", "SG", "TH", "BR", "AR", "CL", "CO", "ZA", "EG"]
CURRENCIES = ["USD", "EUR", "GBP", "JPY"]
PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def pick_from(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def segment_number(segment) -> Column:
    return R.coded(segment, SEGMENT_NUMBER, "9").cast("bigint")


def account_of(part_type) -> Column:
    return R.coded(part_type, PART_ACCOUNT, "6040")


def combination(segment, account) -> Column:
    """Account combination number: segment number and natural account side by side."""
    return segment_number(segment) * 10000 + R.col(account).cast("bigint")


def country_of(nation) -> Column:
    return pick_from(NATION_COUNTRY, R.col(nation))


def line_id() -> Column:
    """Identity of an order line: no column pair is unique, so all columns are hashed."""
    whole = lambda c: F.col(c).cast("string")
    cents = lambda c: F.rint(F.col(c) * 100).cast("bigint").cast("string")
    return F.md5(F.concat_ws(
        "|", whole("l_orderkey"), whole("l_partkey"), whole("l_suppkey"), whole("l_linenumber"),
        cents("l_quantity"), cents("l_extendedprice"), cents("l_discount"), cents("l_tax"),
        "l_returnflag", "l_linestatus", F.unix_date(F.col("l_shipdate").cast("date")).cast("string")))


def exact_money(value) -> Column:
    """Double with at most two decimals -> money, by whole cents; far cheaper than a text-based cast."""
    return (F.rint(R.col(value) * 100).cast("bigint").cast("decimal(18,0)")
            * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(18,2)")


_SCHEMAS: dict[str, StructType] = {}


class Retail:
    """Reads the tables of one scale folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = tune(spark), folder.rstrip("/")
        self._open: dict[str, DataFrame] = {}
        self._posted: tuple[DataFrame, DataFrame] | None = None
        self._segments: DataFrame | None = None

    def read(self, name: str) -> DataFrame:
        if name not in self._open:
            path = f"{self.folder}/{name}.parquet"
            # The file footer is read for its schema once per table, not once per query.
            reader = self.spark.read.schema(_SCHEMAS[path]) if path in _SCHEMAS else self.spark.read
            self._open[name] = reader.parquet(path)
            _SCHEMAS[path] = self._open[name].schema
        return self._open[name]

    # -- conformed tables -----------------------------------------------------------------

    def invoice_ap(self, lake: Lake, want: set[str] | None) -> DataFrame:
        """Order lines as invoice lines. Joins the customer or the part only for columns that need them.

        Orders meet their customers, and lines their parts, before lines meet orders: the lines, by far the most rows, are
        shuffled by the order last, and come out partitioned by their invoice. Of a line's own columns only its 16-byte
        identity and those asked for are shuffled.
        """
        need = lambda *names: want is None or bool(want & set(names))
        by_segment = need("segment_code", "code_combination_id", "payables_account", "cash_account")
        by_part = need("true_category_primary", "true_category_secondary", "line_description",
                       "code_combination_id")
        lines = self.read("lineitem").withColumn("_line", F.unhex(line_id()))
        if by_part:
            lines = lines.join(self.read("part"), F.col("l_partkey") == F.col("p_partkey"))
        out = lines.join(self._order_documents() if by_segment else self.read("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        identity = F.lower(F.hex("_line"))
        invoiced, shipped = F.col("o_orderdate").cast("date"), F.col("l_shipdate").cast("date")
        due, paid = F.date_add(invoiced, 30), F.when(F.col("l_linestatus") == "F", shipped)
        direct, amount = F.col("l_returnflag") == "R", exact_money("l_extendedprice")
        order_key = F.col("l_orderkey")
        columns = {
            "invoice_line_id": lambda: identity, "invoice_id": lambda: order_key,
            "invoice_number": lambda: F.concat(F.lit("INV-"), order_key.cast("string")),
            "line_number": lambda: F.col("l_linenumber"), "line_type": lambda: F.lit("ITEM"),
            "supplier_id": lambda: F.col("l_suppkey").cast("string"),
            "po_matched_flag": lambda: F.when(direct, "N").otherwise("Y"),
            "source_po_header_id": lambda: F.when(~direct, order_key),
            "po_line_id": lambda: F.when(~direct, identity),
            "invoice_date": lambda: invoiced, "gl_date": lambda: invoiced,
            "period_name": lambda: R.month_name(invoiced), "payment_terms": lambda: F.col("o_orderpriority"),
            "due_date": lambda: due, "payment_date": lambda: paid,
            "payment_status": lambda: F.when(paid.isNotNull(), "PAID").when(shipped > due, "OPEN_PAST_DUE")
                                       .otherwise("OPEN_CURRENT"),
            "currency": lambda: pick_from(CURRENCIES, F.col("o_custkey") % 4),
            "is_on_time_payment": lambda: R.paid_on_time(paid, due),
            "days_to_pay": lambda: R.days_to_pay(paid, invoiced),
            "quantity": lambda: F.col("l_quantity").cast("decimal(18,3)"),
            "unit_price": lambda: R.money(amount / F.nullif(F.col("l_quantity").cast("decimal(18,3)"), F.lit(0))),
            "amount": lambda: amount,
            "fiscal_year": lambda: F.year(invoiced), "fiscal_quarter": lambda: F.quarter(invoiced),
            "segment_code": lambda: F.col("c_mktsegment"),
            "payables_account": lambda: combination("c_mktsegment", F.lit("2000")),
            "cash_account": lambda: combination("c_mktsegment", F.lit("1000")),
            "line_description": lambda: F.col("p_name"), "true_category_primary": lambda: F.col("p_type"),
            "true_category_secondary": lambda: F.concat_ws("/", "p_type", "p_brand"),
            "code_combination_id": lambda: combination("c_mktsegment", account_of("p_type"))}
        return out.select(*[make().alias(name) for name, make in columns.items() if want is None or name in want])

    def invoice_classification(self, lake: Lake, want: set[str] | None) -> DataFrame:
        """Stand-in predictions: small lines unscored, some leaves and some parents wrong."""
        lines = self.read("lineitem").where(F.col("l_quantity") > 10) \
            .join(self.read("part"), F.col("l_partkey") == F.col("p_partkey"))
        other = F.col("l_linenumber") % 7 == 0
        parent = F.when(other, "SMALL").otherwise(F.col("p_type"))
        brand = F.when(other | (F.col("l_linenumber") % 5 == 0), "Brand#1").otherwise(F.col("p_brand"))
        return lines.select(
            line_id().alias("invoice_line_id"), parent.alias("predicted_primary_category"),
            F.concat_ws("/", parent, brand).alias("predicted_secondary_category"),
            (0.5 + F.col("l_quantity") / 100).alias("primary_confidence"),
            (0.4 + F.col("l_quantity") / 100).alias("secondary_confidence"),
            F.lit("1").alias("model_version"), F.lit("2024-01-01").cast("timestamp").alias("scored_at"))

    def _order_documents(self) -> DataFrame:
        return self.read("orders").join(self.read("customer"), F.col("o_custkey") == F.col("c_custkey"))

    def purchase_request(self, lake: Lake, want) -> DataFrame:
        created = F.col("o_orderdate").cast("date")
        code = R.coded("o_orderstatus", {"F": "B", "O": "L", "P": "N"}, "X")
        return self._order_documents().select(
            *R.lineage("orders", "orders", "o_orderkey"),
            F.concat(F.lit("PR-"), F.col("o_orderkey").cast("string")).alias("pr_number"),
            F.lit(10).alias("pr_line_num"), F.col("c_mktsegment").alias("segment_code"),
            F.col("c_custkey").cast("string").alias("requester_id"), created.alias("pr_created_date"),
            F.date_add(created, 14).alias("requested_delivery_date"), F.lit("NB").alias("pr_doc_type"),
            code.alias("pr_status_code"), R.request_status(code).alias("pr_status"),
            (F.col("o_custkey") % 100).cast("string").alias("intended_supplier_id"),
            pick_from(PART_TYPES, F.col("o_orderkey") % 6).alias("material_number"),
            F.col("o_orderpriority").alias("line_description"), F.lit(1).cast("decimal(18,3)").alias("quantity"),
            F.lit("EA").alias("uom"), exact_money("o_totalprice").alias("estimated_unit_price"),
            pick_from(["1", "100", "1000"], F.col("o_orderkey") % 3).cast("int").alias("price_unit"),
            pick_from(CURRENCIES, F.col("o_custkey") % 4).alias("currency"),
            R.null("string", "true_category_primary"), R.null("string", "true_category_secondary"),
            *R.fiscal(created))

    def purchase_order(self, lake: Lake, want) -> DataFrame:
        created = F.col("o_orderdate").cast("date")
        price = exact_money("o_totalprice")
        return self._order_documents().where(F.col("o_orderstatus") == "F").select(
            *R.lineage("orders", "orders", "o_orderkey"), F.col("o_orderkey").alias("po_header_id"),
            F.col("o_orderkey").alias("po_line_id"),
            F.concat(F.lit("PO-"), F.col("o_orderkey").cast("string")).alias("po_number"),
            F.lit(10).alias("po_line_num"), (F.col("o_custkey") % 100).cast("string").alias("supplier_id"),
            created.alias("po_created_date"), created.alias("po_approved_date"),
            F.lit("STANDARD").alias("po_doc_type"), F.lit("OPEN").alias("po_status"),
            F.col("c_mktsegment").alias("segment_code"),
            pick_from(PART_TYPES, F.col("o_orderkey") % 6).alias("material_number"),
            F.lit(1).cast("decimal(18,3)").alias("quantity"), F.lit("EA").alias("uom"), price.alias("unit_price"),
            price.alias("extended_amount"), pick_from(CURRENCIES, F.col("o_custkey") % 4).alias("currency"),
            F.concat(F.lit("PR-"), F.col("o_orderkey").cast("string")).alias("source_pr_number"),
            F.lit(10).alias("source_pr_line_num"), *R.fiscal(created))

    def invoice_ar(self, lake: Lake, want) -> DataFrame:
        dated = F.col("o_orderdate").cast("date")
        return self._order_documents().select(
            F.concat(F.lit("AR-"), F.col("o_orderkey").cast("string")).alias("invoice_number"),
            F.col("o_orderkey").alias("document_id"), F.col("o_custkey").cast("string").alias("customer_id"),
            dated.alias("invoice_date"), R.month_name(dated).alias("period_name"),
            pick_from(CURRENCIES, F.col("o_custkey") % 4).alias("currency"),
            exact_money("o_totalprice").alias("total_amount"),
            R.coded("o_orderstatus", {"F": "PAID", "O": "OPEN"}, "PARTIAL").alias("status"),
            combination("c_mktsegment", F.lit("1100")).alias("receivables_account"),
            combination("c_mktsegment", F.lit("4000")).alias("revenue_account"), *R.fiscal(dated))

    def _books(self, lake: Lake) -> tuple[DataFrame, DataFrame]:
        """Invoice lines to post and their documents, written once: five postings read them."""
        if self._posted is None:
            lines = lake.pick("invoice_ap", "invoice_id", "invoice_line_id", "invoice_number", "line_number",
                              "invoice_date", "payment_date", "currency", "amount", "code_combination_id",
                              "payables_account", "cash_account")
            # The identity only orders lines here: as bytes it orders them alike at half the size.
            lines = settled(lines.withColumn("invoice_line_id", F.unhex("invoice_line_id")), "lines", rebalance=False)
            self._posted = lines, settled(posting.documents_of(lines), "documents", rebalance=False)
        return self._posted

    def _journals(self, lake: Lake) -> list[tuple[DataFrame, DataFrame]]:
        """Creation, payment and receivable journals; the last digit of the id tells them apart."""
        lines, documents = self._books(lake)
        number = lambda c, kind: F.col(c) * 10 + kind
        return [posting.post_payables(lines, documents, number("invoice_id", 1)),
                posting.post_payments(documents, number("invoice_id", 2)),
                posting.post_receivables(lake["invoice_ar"], number("document_id", 3))]

    def gl_journal_header(self, lake: Lake, want) -> DataFrame:
        """From the documents alone: no line is ordered or numbered for them, and none is stored."""
        if self._posted is None:
            documents = posting.documents_of(lake.pick("invoice_ap", "invoice_id", "invoice_number", "invoice_date", "payment_date", "currency",
                                                       "amount", "code_combination_id", "payables_account", "cash_account"))
        else:
            documents = self._posted[1]
        number = lambda c, kind: F.col(c) * 10 + kind
        joined = posting.headers(documents, lake["invoice_ar"], (
            number("invoice_id", 1), number("invoice_id", 2), number("document_id", 3)))
        return joined.select("*", *R.fiscal("posted_date"))

    def _entries(self, lake: Lake) -> DataFrame:
        """Journal lines for totals: straight from the invoice lines, nothing numbered and nothing stored."""
        shared = ["invoice_id", "invoice_date", "currency", "amount"]
        lines = lake.pick("invoice_ap", *shared, "code_combination_id")
        documents = posting.documents_of(lake.pick("invoice_ap", *shared, "invoice_number", "payment_date", "payables_account", "cash_account"))
        number = lambda c, kind: F.col(c) * 10 + kind
        return posting.unnumbered_entries(lines, documents, lake["invoice_ar"], (
            number("invoice_id", 1), number("invoice_id", 2), number("document_id", 3)))

    @staticmethod
    def _numbered(want) -> bool:
        return want is None or bool(want & {"je_line_num", "description", "entered_dr", "entered_cr"})

    def gl_journal_line(self, lake: Lake, want) -> DataFrame:
        if not self._numbered(want):
            return self._entries(lake)
        first, second, third = (lines for _, lines in self._journals(lake))
        return first.unionByName(second).unionByName(third).withColumn(
            "net_amount", (F.col("accounted_dr") - F.col("accounted_cr")).cast("decimal(18,2)"))

    def fact_gl_entries(self, lake: Lake, want) -> DataFrame:
        """Each journal is joined with its own headers, before the union: same keys, smaller joins.

        For totals the headers' facts are on the lines already, and no header is joined.
        """
        if not self._numbered(want):
            entries = self._entries(lake).withColumn("period_name", R.month_name("posted_date")).select("*", *R.fiscal("posted_date"))
            return gold.enrich(entries, want, lambda: lake["coa_account"], "code_combination_id", gold.LEDGER_PART)
        parts = [gold.fact_gl_entries(
            lake.extend({"gl_journal_header": header.select("*", *R.fiscal("posted_date")),
                         "gl_journal_line": lines.withColumn(
                             "net_amount", (F.col("accounted_dr") - F.col("accounted_cr")).cast("decimal(18,2)"))}),
            want) for header, lines in self._journals(lake)]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    def coa_account(self, lake: Lake, want) -> DataFrame:
        accounts = F.array(*[F.struct(F.lit(code).alias("code"), F.lit(kind).alias("kind"))
                             for code, kind in ACCOUNT_TYPE.items()])
        if self._segments is None:  # written, so that Spark knows how few there are and does not shuffle lines to meet them
            self._segments = settled(self.read("customer").select(F.col("c_mktsegment").alias("segment_code")).distinct(), "segments")
        return self._segments.withColumn("_a", F.explode(accounts)).select(
            combination("segment_code", F.col("_a.code")).alias("code_combination_id"),
            segment_number("segment_code").cast("string").alias("entity_code"),
            F.concat(F.substring("segment_code", 1, 3), F.lit("-CC"), F.substring("_a.code", 1, 1))
             .alias("cost_center_code"),
            F.col("_a.code").alias("natural_account_code"), F.lit("000").alias("product_code"),
            F.lit("0000").alias("intercompany_code"),
            F.concat(F.lit("Account "), F.col("_a.code")).alias("natural_account_description"),
            F.col("_a.kind").alias("natural_account_type"), "segment_code",
            F.when(F.col("_a.code") == "1000", "N").otherwise("Y").alias("enabled_flag"))

    def dim_spend_category(self, lake: Lake, want) -> DataFrame:
        pairs = self.read("part").select("p_type", "p_brand").distinct()
        account = account_of("p_type")
        kind = R.coded(account, ACCOUNT_TYPE, None)
        return pairs.select(
            F.col("p_type").alias("primary_code"), F.initcap("p_type").alias("primary_name"),
            F.concat_ws("/", "p_type", "p_brand").alias("secondary_code"),
            F.col("p_brand").alias("secondary_name"), account.alias("gl_account"),
            kind.alias("gl_account_type"), (kind == "COGS").alias("is_direct"),
            F.lit("CROSS").alias("segment_affinity"))

    def dim_employees(self, lake: Lake, want) -> DataFrame:
        """Users of the event stream as workers; the event type is the unit they work in."""
        events = self.read("events").select(
            F.col("user_id").cast("string").alias("employee_id"), "ts", "event_id",
            F.col("event_type").alias("segment_code"))
        versions = scd2(events, "employee_id", "ts", ["segment_code"], "event_id")
        salary = (50000 + F.col("employee_id").cast("int") * 100).cast("decimal(18,2)")
        return versions.select(
            "employee_id", "version_seq", "effective_from", "effective_to", "is_current", "segment_code",
            F.when(F.col("segment_code") == "error", "terminated").otherwise("active").alias("employment_status"),
            salary.alias("annual_base_salary_usd"),
            (salary * F.lit("1.30").cast("decimal(3,2)") / 4).cast("decimal(18,2)").alias("quarterly_loaded_cost_usd"))

    def event_days(self) -> DataFrame:
        """Each event day stands for a quarter: its number is the quarter, its date the snapshot."""
        days = self.read("events").select(F.to_date("ts").alias("snapshot_date")).distinct()
        return days.select("snapshot_date", F.year("snapshot_date").alias("fiscal_year"),
                           F.dayofmonth("snapshot_date").alias("fiscal_quarter"))

    def fact_emp_quarterly_cost(self, lake: Lake, want) -> DataFrame:
        return gold.employee_cost(lake["dim_employees"], self.event_days(), step="day")

    def anchors(self, lake: Lake) -> DataFrame:
        """Period targets per quarter and segment: the spend, moved by -3 to +3 percent."""
        by = ["fiscal_year", "fiscal_quarter", "segment_code"]
        spend = lake.pick("fact_invoices", *by, "amount").groupBy(*by).agg(F.sum("amount").alias("_s"))
        shift = 1 + ((R.period_key() % 7) - 3).cast("double") / 100
        return spend.select(*by, F.round(F.col("_s").cast("double") * shift / 1e6, 4).alias("target_mm"))

    def macro(self, lake: Lake, want) -> DataFrame:
        """Monthly order statistics as macro indices."""
        month = F.trunc(F.col("o_orderdate").cast("date"), "month")
        monthly = self.read("orders").groupBy(month.alias("period_month")).agg(
            F.count("*").alias("n"), R.mean("o_totalprice").alias("v"))
        return monthly.select(
            "period_month", (F.col("n") / 100).alias("gdp_growth_idx"), (F.col("v") / 1e5).alias("inflation_idx"),
            (F.col("n") / 150).alias("demand_idx_sales"), (F.col("n") / 175).alias("demand_idx_mfg"),
            (F.col("v") / 2e5).alias("supply_chain_stress_idx"),
            (F.month("period_month") / 12).alias("seasonality_idx"))

    # -- raw-shaped tables ----------------------------------------------------------------

    def raw(self) -> dict:
        """Tables named and shaped like source files, for the conforming builders."""
        supplier, orders, lines = self.read("supplier"), self.read("orders"), self.read("lineitem")
        key = F.col("s_suppkey")
        dated = F.col("o_orderdate").cast("date")
        shipped = F.col("l_shipdate").cast("date")
        company = pick_from(["1100", "1200", "1300", "1400", "1900", "9999"], F.col("o_custkey") % 6)
        segment = pick_from(["HAD", "HPA", "HSB", "HET"], F.col("l_suppkey") % 4)
        leaf = pick_from(PART_TYPES, F.col("l_partkey") % 6)
        contracts = orders.where(F.col("o_orderkey") % 10 != 3)
        contract_id = F.concat(F.lit("C-"), F.col("o_orderkey").cast("string"))
        base = supplier.select(
            F.concat(F.lit("CW-"), key.cast("string")).alias("ContractWorkspaceId"),
            pick_from(["SOW", "PRICING_AGREEMENT", "MSA"], key % 3).alias("ContractType"),
            F.concat(F.lit("Contract "), F.col("s_name")).alias("Title"),
            key.cast("string").alias("AwardedSupplierId"), F.lit("1995-01-01").alias("EffectiveDate"),
            F.date_add(F.lit("1998-01-01").cast("date"), (key % 1500).cast("int")).cast("string").alias("ExpirationDate"),
            (F.abs("s_acctbal") * 1000).alias("TotalCommittedSpend"), (F.abs("s_acctbal") * 375).alias("ActualSpendToDate"),
            F.when(F.col("s_acctbal") >= 1000, "Active").when(F.col("s_acctbal") >= 0, "Expired").otherwise("Draft").alias("Status"),
            R.region_of(country_of("s_nationkey")).alias("OwningRegion"), key.alias("_key"))
        second = base.where(F.col("_key") % 9 == 0) \
            .withColumn("ContractWorkspaceId", F.concat("ContractWorkspaceId", F.lit("-B")))
        customers = self.read("customer").select(
            F.col("c_custkey").cast("string").alias("cust_account_id_ext"), F.col("c_name").alias("customer_name"),
            country_of("c_nationkey").alias("country"), (F.col("c_custkey") * 2).alias("cust_acct_site_id"))
        extra = self.read("customer").where(F.col("c_custkey") % 5 == 0).select(
            F.col("c_custkey").cast("string"), F.concat("c_name", F.lit(" II")),
            F.lit("ZZ"), F.col("c_custkey") * 2 + 1)
        return {
            "LFA1_SUPPLIER_MASTER": lambda lake, want: supplier.where(key % 10 != 9).select(
                key.cast("string").alias("LIFNR"), F.col("s_name").alias("NAME1"),
                country_of("s_nationkey").alias("LAND1"),
                F.date_add(F.lit("1995-01-01").cast("date"), (key % 1000).cast("int")).alias("ERSDA"),
                F.lit("EN").alias("SPRAS"), pick_from(PART_TYPES, key % 6).alias("_supplier_category_primary"),
                F.lit("[]").alias("_supplier_category_secondary_json"),
                ((key % 30) / 100).alias("_maverick_propensity"),
                pick_from(list(SEGMENT_NUMBER), key % 5).alias("_industry_segment_affinity"),
                pick_from(["Net15", "Net30", "Net45", "Net60"], key % 4).alias("_payment_terms"),
                (key % 12 == 0).alias("_is_regulated_flag")),
            "ap_supplier_sites_all": lambda lake, want: supplier.where((key % 3 != 2) | (key % 10 == 9)).select(
                (key + 500000).alias("vendor_site_id"), key.cast("string").alias("vendor_id_ext"),
                country_of("s_nationkey").alias("country"),
                F.when((key % 3 == 1) & (key % 10 != 9), "N").otherwise("Y").alias("purchasing_site_flag")),
            "ar_customer_sites_all": lambda lake, want: customers.union(extra),
            "contract_party": lambda lake, want: contracts.select(
                contract_id.alias("contract_id"), F.lit("Customer").alias("party_role"),
                F.col("o_custkey").cast("string").alias("party_id")),
            "contract": lambda lake, want: contracts.join(self.read("customer"), F.col("o_custkey") == F.col("c_custkey")).select(
                contract_id.alias("contract_id"),
                F.concat(F.lit("N-"), F.col("o_orderkey").cast("string")).alias("contract_number"),
                F.col("o_custkey").cast("string").alias("customer_id"), F.col("c_mktsegment").alias("entity_segment"),
                F.date_sub(dated, 14).alias("signed_date"), dated.alias("start_date"),
                F.date_add(dated, (365 * (1 + F.col("o_orderkey") % 3)).cast("int")).alias("end_date"),
                exact_money("o_totalprice").alias("total_contract_value"),
                pick_from(CURRENCIES, F.col("o_custkey") % 4).alias("currency"),
                F.when(F.col("o_orderstatus") == "F", "Expired").otherwise("Active").alias("status"),
                F.col("o_orderpriority").alias("commercial_terms"), F.lit("NONE").alias("governing_law")),
            "contract_amendment": lambda lake, want: lines.where(F.col("l_returnflag") == "R").select(
                F.concat(F.lit("C-"), F.col("l_orderkey").cast("string")).alias("contract_id"),
                F.col("l_linenumber").alias("amendment_no"),
                F.when(F.col("l_linestatus") == "F", "TERMINATION").otherwise("VALUE_CHANGE").alias("amendment_type"),
                shipped.alias("effective_date"), (-exact_money("l_extendedprice")).alias("value_delta")),
            "billing_schedule": lambda lake, want: orders.join(self.read("customer"), F.col("o_custkey") == F.col("c_custkey")).select(
                F.col("o_orderkey").cast("string").alias("schedule_id"), contract_id.alias("contract_id"),
                F.col("o_custkey").cast("string").alias("customer_id"), F.col("c_mktsegment").alias("segment_code"),
                dated.alias("bill_date"), exact_money("o_totalprice").alias("amount"),
                pick_from(CURRENCIES, F.col("o_custkey") % 4).alias("currency"),
                R.coded("o_orderstatus", {"F": "Paid", "O": "Scheduled"}, "Billed").alias("status")),
            "ARIBA_CONTRACT_WORKSPACE": lambda lake, want: base.union(second).drop("_key"),
            "ARIBA_SOURCING_EVENT": lambda lake, want: orders.select(
                F.concat(F.lit("EV-"), F.col("o_orderkey").cast("string")).alias("EventId"),
                pick_from(["RFQ", "RFP", "Auction"], F.col("o_orderkey") % 3).alias("EventType"),
                F.lit("Event").alias("Title"), F.lit("ORG").alias("OwnerOrgUnit"),
                dated.alias("CreatedOn"), F.date_add(dated, 21).alias("ClosedOn"),
                (F.col("o_custkey") % 8).cast("int").alias("SupplierInvitedCount"),
                (F.col("o_custkey") % 8 - F.col("o_custkey") % 8 % 3).cast("int").alias("SupplierRespondedCount"),
                (F.col("o_custkey") % 100).cast("string").alias("AwardedSupplierId"),
                F.col("o_totalprice").alias("AwardedAmount"), F.lit("Awarded").alias("Status")),
            "ARIBA_SUPPLIER_PERFORMANCE": lambda lake, want: lines.select(
                F.col("l_suppkey").cast("string").alias("SupplierId"),
                R.quarter_label(F.year(shipped), F.quarter(shipped)).alias("EvaluationQuarter"),
                (F.col("l_quantity") * 2).alias("OnTimeDeliveryPct"), (F.col("l_discount") * 50).alias("QualityScore"),
                (F.col("l_tax") * 50).alias("ResponsivenessScore")).withColumn(
                "OverallRating", R.overall_rating("OnTimeDeliveryPct", "QualityScore", "ResponsivenessScore")),
            "EBAN_PR_HEADER": lambda lake, want: orders.select(
                F.col("o_orderkey").cast("string").alias("BANFN"), company.alias("BUKRS"),
                F.col("o_custkey").cast("string").alias("AFNAM"), dated.alias("ERDAT"), F.lit("NB").alias("BSART"),
                R.coded("o_orderstatus", {"F": "B", "O": "L", "P": "X"}, None).alias("STATU"),
                F.date_add(dated, 14).alias("LFDAT")),
            "EBAN_PR_LINE": lambda lake, want: lines.select(
                F.col("l_orderkey").cast("string").alias("BANFN"), F.col("l_linenumber").alias("BNFPO"),
                F.col("l_partkey").cast("string").alias("MATNR"), leaf.alias("MATGROUP"),
                F.lit("text").alias("TXZ01"), F.col("l_quantity").alias("MENGE"), F.lit("EA").alias("MEINS"),
                F.col("l_extendedprice").alias("PREIS"), F.lit(1).alias("PEINH"), F.lit("USD").alias("WAERS"),
                F.col("l_suppkey").cast("string").alias("_supplier_intended"), leaf.alias("_true_category_primary"),
                leaf.alias("_true_category_secondary")),
            "po_headers_all": lambda lake, want: orders.select(
                F.col("o_orderkey").alias("po_header_id"),
                F.concat(F.lit("PO-"), F.col("o_orderkey").cast("string")).alias("segment1"),
                F.lit("STANDARD").alias("type_lookup_code"), (F.col("o_custkey") % 100).cast("string").alias("vendor_id_ext"),
                F.lit("01").alias("vendor_site_code"), dated.alias("creation_date"),
                F.date_add(dated, 10).alias("approved_date"), F.lit("OPEN").alias("po_status")),
            "po_lines_all": lambda lake, want: lines.select(
                (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("po_line_id"), F.col("l_orderkey").alias("po_header_id"),
                F.col("l_linenumber").alias("line_num"), F.col("l_partkey").cast("string").alias("item_id_ext"),
                F.lit("text").alias("item_description"), F.col("l_quantity").alias("quantity_committed"),
                F.col("l_tax").alias("unit_price"), F.lit("USD").alias("currency_code"),
                leaf.alias("material_group_code"), F.lit("EA").alias("uom"),
                F.col("l_orderkey").cast("string").alias("source_pr_number_ext"),
                F.col("l_linenumber").alias("source_pr_line_num_ext"), segment.alias("_segment_code"),
                leaf.alias("_true_category_primary"), leaf.alias("_true_category_secondary")),
            "ap_invoices_all": lambda lake, want: orders.select(
                F.col("o_orderkey").alias("invoice_id"),
                F.concat(F.lit("INV-"), F.col("o_orderkey").cast("string")).alias("invoice_num"),
                (F.col("o_custkey") % 100).cast("string").alias("vendor_id_ext"), F.lit("USD").alias("invoice_currency"),
                dated.alias("invoice_date"), dated.alias("gl_date"), R.month_name(dated).alias("period_name"),
                pick_from(["Net15", "Net30", "Net45", "Net60"], F.col("o_custkey") % 4).alias("payment_terms_name"),
                F.date_add(dated, 30).alias("due_date"),
                F.when(F.col("o_orderstatus") == "F", F.date_add(dated, (F.col("o_custkey") % 60).cast("int"))).alias("payment_date"),
                F.when(F.col("o_orderstatus") == "F", "PAID").otherwise("OPEN_CURRENT").alias("payment_status_flag"),
                F.when(F.col("o_orderstatus") == "P", "N").otherwise("Y").alias("po_matched_flag"),
                F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey")).alias("source_po_header_id")),
            "ap_invoice_lines_all": lambda lake, want: lines.select(
                (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("invoice_line_id"),
                F.col("l_orderkey").alias("invoice_id"), F.col("l_linenumber").alias("line_number"),
                F.lit("ITEM").alias("line_type_lookup_code"), F.lit("text").alias("item_description"),
                F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("unit_price"),
                F.col("l_extendedprice").alias("amount"), F.col("l_partkey").alias("po_line_id"),
                F.col("l_suppkey").alias("code_combination_id"), segment.alias("_segment_code"),
                leaf.alias("_true_category_primary"), leaf.alias("_true_category_secondary")),
            "ar_invoices_all": lambda lake, want: orders.select(
                F.col("o_orderkey").alias("customer_trx_id"),
                F.concat(F.lit("AR-"), F.col("o_orderkey").cast("string")).alias("trx_number"),
                F.col("o_custkey").cast("string").alias("cust_account_id_ext"), dated.alias("trx_date"),
                dated.alias("gl_date"), R.month_name(dated).alias("period_name"),
                pick_from(CURRENCIES, F.col("o_custkey") % 4).alias("invoice_currency_code"),
                F.col("o_totalprice").alias("total_amount"),
                R.coded("o_orderstatus", {"F": "PAID", "O": "OPEN"}, "PARTIAL").alias("status")),
        }

    def ledger_raw(self) -> dict:
        """Raw-shaped ledger and workforce tables that are themselves derived."""
        own = self.lake
        code = R.coded("entity_code", {"1": "HAD", "2": "HPA", "3": "HSB", "4": "HET"}, "XXX")
        return {
            "gl_code_combinations": lambda lake, want: self.coa_account(own(), None).select(
                "code_combination_id", F.col("entity_code").alias("segment1_entity"),
                F.col("cost_center_code").alias("segment2_cost_center"),
                F.col("natural_account_code").alias("segment3_natural_account"),
                F.col("product_code").alias("segment4_product"), F.col("intercompany_code").alias("segment5_intercompany"),
                F.lit("0000").alias("segment6_future1"), F.lit("0000").alias("segment7_future2"),
                "natural_account_description", "natural_account_type", code.alias("_segment_code"), "enabled_flag"),
            "gl_je_headers": lambda lake, want: self.gl_journal_header(own(), None),
            "gl_je_lines": lambda lake, want: self.gl_journal_line(own(), None),
            "workers": lambda lake, want: own()["dim_employees"].select(
                F.col("employee_id").alias("worker_id"), "version_seq", F.to_date("effective_from").alias("effective_date"),
                F.to_date("effective_to").alias("effective_through"), F.col("is_current").alias("is_current_row"),
                F.lit("A").alias("worker_name_first"), F.lit("B").alias("worker_name_last"), F.lit("a@b").alias("work_email"),
                R.null("date", "hire_date"), R.null("date", "termination_date"),
                F.initcap("employment_status").alias("worker_status"), F.col("segment_code").alias("organization_id"),
                F.lit("CC1").alias("cost_center_id"), F.lit("US").alias("country_code"), F.lit("NA").alias("region"),
                F.lit("Ops").alias("job_family"), F.lit("G1").alias("compensation_grade"),
                F.col("annual_base_salary_usd").alias("annual_base_salary_amount"), F.lit("USD").alias("currency_code")),
            "invoice_classifications": lambda lake, want: self.invoice_classification(own(), None),
        }

    # -- lakes ----------------------------------------------------------------------------

    def conforming_lake(self) -> Lake:
        """Raw-shaped tables with all library builders on top."""
        return Lake({**gold.derived(), **self.raw(), **self.ledger_raw()})

    def lake(self) -> Lake:
        """Conformed tables for the analyst queries; gold tables come from the library builders."""
        own = {name: getattr(self, name) for name in (
            "invoice_ap", "invoice_classification", "purchase_request", "purchase_order", "invoice_ar",
            "gl_journal_header", "gl_journal_line", "fact_gl_entries", "coa_account", "dim_spend_category",
            "dim_employees", "fact_emp_quarterly_cost")}
        return Lake({**gold.derived(), **self.raw(), **own, "dim_macro_environment": self.macro})
