"""Double-entry postings derived from invoices, as row expansions rather than loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import rules as R
from ledgerloom.lake import settled
from ledgerloom.operators.allocate import settle_residual
from ledgerloom.operators.ordered import along

LINE_COLUMNS = ["je_header_id", "je_line_num", "code_combination_id", "entered_dr", "entered_cr",
                "accounted_dr", "accounted_cr", "description"]


def _entry(number, account, debit, credit, text) -> Column:
    zero = F.lit(0).cast("decimal(18,2)")
    debit, credit = (zero if v is None else F.col(v).cast("decimal(18,2)") for v in (debit, credit))
    return F.struct(
        F.lit(number).alias("je_line_num"), F.col(account).cast("bigint").alias("code_combination_id"),
        debit.alias("entered_dr"), credit.alias("entered_cr"),
        debit.alias("accounted_dr"), credit.alias("accounted_cr"), text.alias("description"))


def _pair(documents: DataFrame, je_id: Column, first: Column, second: Column) -> DataFrame:
    return documents.select(je_id.alias("je_header_id"),
                            F.explode(F.array(first, second)).alias("_e")) \
        .select("je_header_id", "_e.*").select(*LINE_COLUMNS)


def _header_columns(je_id: Column, source: str, category: str, posted: str, currency: str) -> list[Column]:
    return [je_id.alias("je_header_id"), R.month_name(posted).alias("period_name"),
            F.lit(1).alias("ledger_id"), F.lit(source).alias("je_source"),
            F.lit(category).alias("je_category"), F.lit("Y").alias("posted_flag"),
            F.col(posted).alias("posted_date"), F.col(currency).alias("currency_code")]


CREATION = ("Payables", "Purchase Invoices", "invoice_date", "currency")
PAYMENT = ("Payables", "Payments", "payment_date", "currency")
RECEIVABLE = ("Receivables", "Sales Invoices", "invoice_date", "currency")


def headers(documents: DataFrame, receivables: DataFrame, kinds: tuple[Column, Column, Column]) -> DataFrame:
    """The headers of all journals. `kinds` are the journal ids of creation, payment and receivable.

    A document gives the header of its creation and, once paid, that of its payment in one expansion.
    """
    create, pay, bill = kinds
    both = F.array(F.struct(*_header_columns(create, *CREATION)), F.struct(*_header_columns(pay, *PAYMENT)))
    posted = F.when(F.col("payment_date").isNull(), F.slice(both, 1, 1)).otherwise(both)
    return documents.select(F.explode(posted).alias("_h")).select("_h.*").unionByName(receivables.select(*_header_columns(bill, *RECEIVABLE)))


def documents_of(lines: DataFrame) -> DataFrame:
    """One row per invoice from its lines: header facts and the total."""
    return lines.groupBy("invoice_id").agg(
        F.min("invoice_number").alias("invoice_number"), F.min("invoice_date").alias("invoice_date"),
        F.min("currency").alias("currency"), F.min("payables_account").alias("payables_account"),
        F.min("cash_account").alias("cash_account"),
        # Paid once every line is paid, on the day of the last payment.
        F.when(F.count("payment_date") == F.count("*"), F.max("payment_date")).alias("payment_date"),
        F.sum("amount").cast("decimal(18,2)").alias("invoice_amount"), F.count("*").alias("lines"))


def _numbered(lines: DataFrame, documents: DataFrame, order: list[str], lines_per_slice: int) -> DataFrame:
    """The lines with `_no`, their place in the document: in slices where the document is long, else one shuffle and no copy."""
    long = settled(documents.where(F.col("lines") > lines_per_slice).select(F.col("invoice_id").alias("_d")), "long")
    place = F.row_number().over(Window.partitionBy("invoice_id").orderBy(*order))
    if long.isEmpty():
        return lines.withColumn("_no", place)
    same = F.col("invoice_id").eqNullSafe(F.col("_d"))
    short = lines.join(long, same, "left_anti").withColumn("_no", place)
    return short.unionByName(along(lines.join(long, same, "left_semi"), ["invoice_id"], order, number="_no", rows=lines_per_slice))


def post_payables(lines: DataFrame, documents: DataFrame, je_id: Column,
                  lines_per_slice: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """Invoice creation: a debit per line, one credit of the payable for the document total.

    The last debit absorbs the rounding so that each journal balances to the cent. Lines of a document
    with more than `lines_per_slice` of them are numbered through slices that are cut from the lines
    themselves, so a document of any length is spread over tasks, also if its lines have no numbers.
    """
    order = ["line_number", "invoice_line_id"]
    numbered = _numbered(lines, documents, order, lines_per_slice)
    booked = settle_residual(numbered, "invoice_id", order, "amount", documents, "invoice_amount", "_debit")
    zero = F.lit(0).cast("decimal(18,2)")
    debits = booked.select(
        je_id.alias("je_header_id"), F.col("_no").alias("je_line_num"),
        F.col("code_combination_id").cast("bigint").alias("code_combination_id"),
        F.col("_debit").alias("entered_dr"), zero.alias("entered_cr"),
        F.col("_debit").alias("accounted_dr"), zero.alias("accounted_cr"),
        F.concat(F.lit("AP "), "invoice_number", F.lit(" line "), F.col("_no").cast("string")).alias("description"))
    credits = documents.select(
        je_id.alias("je_header_id"),
        _entry(0, "payables_account", None, "invoice_amount",
               F.concat(F.lit("AP "), "invoice_number", F.lit(" credit"))).alias("_e"), "lines") \
        .select("je_header_id", (F.col("lines") + 1).cast("int").alias("je_line_num"),
                *[f"_e.{c}" for c in LINE_COLUMNS[2:]])
    return documents.select(*_header_columns(je_id, *CREATION)), debits.unionByName(credits)


def _amounts(posted, currency, source: str, category: str, account, debit, credit) -> list[Column]:
    zero = F.lit(0).cast("decimal(18,2)")
    debit, credit = (zero if v is None else F.col(v).cast("decimal(18,2)") for v in (debit, credit))
    return [F.col(posted).alias("posted_date"), F.col(currency).alias("currency_code"), F.lit(source).alias("je_source"),
            F.lit(category).alias("je_category"), F.col(account).cast("bigint").alias("code_combination_id"),
            debit.alias("accounted_dr"), credit.alias("accounted_cr"), (debit - credit).cast("decimal(18,2)").alias("net_amount")]


def unnumbered_entries(lines: DataFrame, documents: DataFrame, receivables: DataFrame, kinds: tuple[Column, Column, Column]) -> DataFrame:
    """All journal lines with what their headers say, for totals: without line numbers and descriptions.

    Lines carry the date and currency of their document, and a document's total is the sum of its lines, so no line
    takes a rounding difference and nothing has to be ordered. `kinds` are the journal ids of creation, payment and
    receivable. A document gives its one credit and, once paid, two payment lines in one expansion.
    """
    create, pay, bill = kinds
    debits = lines.select(create.alias("je_header_id"), *_amounts(
        "invoice_date", "currency", "Payables", "Purchase Invoices", "code_combination_id", "amount", None))
    payables, payments = ("Payables", "Purchase Invoices"), ("Payables", "Payments")
    entry = lambda je_id, *parts: F.struct(je_id.alias("je_header_id"), *_amounts(*parts))
    posted = F.array(
        entry(create, "invoice_date", "currency", *payables, "payables_account", None, "invoice_amount"),
        entry(pay, "payment_date", "currency", *payments, "payables_account", "invoice_amount", None),
        entry(pay, "payment_date", "currency", *payments, "cash_account", None, "invoice_amount"))
    unpaid = F.slice(posted, 1, 1)
    booked = documents.select(F.explode(F.when(F.col("payment_date").isNull(), unpaid).otherwise(posted)).alias("_e")).select("_e.*")
    sales = ("Receivables", "Sales Invoices")
    billed = receivables.select(F.explode(F.array(
        entry(bill, "invoice_date", "currency", *sales, "receivables_account", "total_amount", None),
        entry(bill, "invoice_date", "currency", *sales, "revenue_account", None, "total_amount"))).alias("_e")).select("_e.*")
    return debits.unionByName(booked).unionByName(billed)


def post_payments(documents: DataFrame, je_id: Column) -> tuple[DataFrame, DataFrame]:
    """Payment of paid invoices: debit the payable, credit cash."""
    paid = documents.where(F.col("payment_date").isNotNull())
    label = lambda tail: F.concat(F.lit("Payment "), "invoice_number", F.lit(tail))
    lines = _pair(paid, je_id,
                  _entry(1, "payables_account", "invoice_amount", None, label(" DR AP")),
                  _entry(2, "cash_account", None, "invoice_amount", label(" CR Cash")))
    return paid.select(*_header_columns(je_id, *PAYMENT)), lines


def post_receivables(invoices: DataFrame, je_id: Column) -> tuple[DataFrame, DataFrame]:
    """Customer invoice: debit the receivable, credit revenue."""
    label = lambda tail: F.concat(F.lit("AR "), "invoice_number", F.lit(tail))
    lines = _pair(invoices, je_id,
                  _entry(1, "receivables_account", "total_amount", None, label(" debit")),
                  _entry(2, "revenue_account", None, "total_amount", label(" revenue")))
    return invoices.select(*_header_columns(je_id, *RECEIVABLE)), lines


def period_balances(lines: DataFrame, period: Column, by: tuple[str, ...] = ("code_combination_id",)) -> DataFrame:
    """Debits, credits and net per code combination, labelled with the period."""
    return lines.groupBy(*by).agg(
        R.exact_sum("accounted_dr").alias("period_net_dr"),
        R.exact_sum("accounted_cr").alias("period_net_cr")) \
        .withColumn("period_name", period) \
        .withColumn("period_net_balance", (F.col("period_net_dr") - F.col("period_net_cr")).cast("decimal(28,2)"))


def derive_orders(requests: DataFrame, order_id: Column) -> DataFrame:
    """Purchase orders from request lines: released only, one order per request, lines one to one,
    the supplier and currency of the first line; corporate requests stop here."""
    live = requests.where((F.col("pr_status") == "released") & (F.col("segment_code") != "CORP"))
    first = live.groupBy("pr_number").agg(
        F.min_by(F.struct("intended_supplier_id", "currency"),
                 F.struct("pr_line_num", "source_primary_key", "intended_supplier_id", "currency")).alias("_f"))
    return live.join(first, "pr_number").select(
        order_id.alias("po_number"), F.col("pr_line_num").alias("po_line_num"),
        F.col("_f.intended_supplier_id").alias("supplier_id"),
        F.lit("STANDARD").alias("po_doc_type"), F.lit("OPEN").alias("po_status"),
        F.col("pr_created_date").alias("po_created_date"), "segment_code", "material_number",
        "line_description", "quantity", "uom", F.col("estimated_unit_price").alias("unit_price"),
        (F.col("quantity") * F.col("estimated_unit_price")).cast("decimal(18,2)").alias("extended_amount"),
        F.col("_f.currency").alias("currency"), F.col("pr_number").alias("source_pr_number"),
        F.col("pr_line_num").alias("source_pr_line_num"),
        "true_category_primary", "true_category_secondary")
