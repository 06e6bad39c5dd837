"""Fundamentals from reported facts: one value per filing and metric, ratios and growth, daily snapshots."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagoon.functions.exprs import clip, ratio, safe_ratio, symmetric_change
from lagoon.operators.calendar import next_session
from lagoon.operators.panel import forward_fill, ordered
from lagoon.operators.select import keep_one

# The metrics with their tags in order of preference, unit and kind of period.
METRICS: list[tuple[str, str, str, list[str]]] = [
    ("assets", "USD", "instant", ["Assets"]),
    ("current_assets", "USD", "instant", ["AssetsCurrent", "CurrentAssets"]),
    ("current_liabilities", "USD", "instant", ["LiabilitiesCurrent", "CurrentLiabilities"]),
    ("liabilities", "USD", "instant", ["Liabilities"]),
    ("equity", "USD", "instant", ["StockholdersEquity"]),
    ("cash", "USD", "instant", ["CashAndCashEquivalentsAtCarryingValue", "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents"]),
    ("long_term_debt", "USD", "instant", ["LongTermDebtNoncurrent", "LongTermDebt"]),
    ("current_debt", "USD", "instant", ["DebtCurrent", "LongTermDebtCurrent", "ShortTermBorrowings"]),
    ("inventory", "USD", "instant", ["InventoryNet"]),
    ("receivables", "USD", "instant", ["AccountsReceivableNetCurrent"]),
    ("payables", "USD", "instant", ["AccountsPayableCurrent"]),
    ("deferred_revenue", "USD", "instant", ["DeferredRevenueCurrent"]),
    ("property_plant_equipment", "USD", "instant", ["PropertyPlantAndEquipmentNet"]),
    ("goodwill", "USD", "instant", ["Goodwill"]),
    ("intangibles", "USD", "instant", ["IntangibleAssetsNetExcludingGoodwill"]),
    ("shares_outstanding", "shares", "instant", ["CommonStockSharesOutstanding"]),
    ("revenue", "USD", "income", ["RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "SalesRevenueNet", "RevenueFromContractWithCustomerIncludingAssessedTax"]),
    ("gross_profit", "USD", "income", ["GrossProfit"]),
    ("operating_income", "USD", "income", ["OperatingIncomeLoss"]),
    ("net_income", "USD", "income", ["NetIncomeLoss"]),
    ("pretax_income", "USD", "income", ["IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest"]),
    ("income_tax", "USD", "income", ["IncomeTaxExpenseBenefit"]),
    ("interest_expense", "USD", "income", ["InterestExpenseNonOperating"]),
    ("research_development", "USD", "income", ["ResearchAndDevelopmentExpense"]),
    ("selling_general_admin", "USD", "income", ["SellingGeneralAndAdministrativeExpense"]),
    ("cost_of_revenue", "USD", "income", ["CostOfRevenue", "CostOfGoodsAndServicesSold"]),
    ("operating_cash_flow", "USD", "cash_ytd", ["NetCashProvidedByUsedInOperatingActivities"]),
    ("capital_expenditure", "USD", "cash_ytd", ["PaymentsToAcquirePropertyPlantAndEquipment"]),
    ("repurchases", "USD", "cash_ytd", ["PaymentsForRepurchaseOfCommonStock"]),
    ("acquisitions", "USD", "cash_ytd", ["PaymentsToAcquireBusinessesNetOfCashAcquired"]),
    ("depreciation_amortization", "USD", "cash_ytd", ["DepreciationDepletionAndAmortization"]),
    ("share_compensation", "USD", "cash_ytd", ["ShareBasedCompensation", "EmployeeServiceShareBasedCompensationNoncash"]),
]
GROWTH = ["revenue", "gross_profit", "operating_income", "net_income", "assets", "equity", "cash", "long_term_debt", "inventory", "receivables", "shares_outstanding"]
PERIOD_FROM = ["revenue", "net_income", "operating_cash_flow", "assets"]
ANNUAL = ["10-K", "20-F", "40-F"]
FORMS = ["10-Q", *ANNUAL]

NAMES = [m for m, *_ in METRICS]


@dataclass(frozen=True)
class Share:
    """A feature: `of` over `to`, within bounds; `scale` says by what the numerator is brought to a year."""

    name: str
    of: str
    to: str = "assets"
    low: float = 0.0
    high: float = 3.0
    scale: str | None = None


SHARES = [
    Share("gross_margin", "gross_profit", "revenue", -5.0, 5.0),
    Share("operating_margin", "operating_income", "revenue", -5.0, 5.0),
    Share("net_margin", "net_income", "revenue", -5.0, 5.0),
    Share("tax_rate", "income_tax", "pretax_income", -2.0, 2.0),
    Share("research_development_intensity", "research_development", "revenue", 0.0, 2.0),
    Share("selling_general_admin_intensity", "selling_general_admin", "revenue", 0.0, 3.0),
    Share("annualized_roa", "net_income", low=-3.0, scale="income"),
    Share("annualized_operating_roa", "operating_income", low=-3.0, scale="income"),
    Share("annualized_asset_turnover", "revenue", high=10.0, scale="income"),
    Share("cash_to_assets", "cash", high=2.0),
    Share("liabilities_to_assets", "liabilities", high=5.0),
    Share("equity_to_assets", "equity", low=-3.0),
    Share("current_ratio", "current_assets", "current_liabilities", 0.0, 20.0),
    Share("inventory_to_assets", "inventory"),
    Share("receivables_to_assets", "receivables"),
    Share("payables_to_assets", "payables"),
    Share("deferred_revenue_to_assets", "deferred_revenue"),
    Share("ppe_to_assets", "property_plant_equipment"),
    Share("goodwill_to_assets", "goodwill"),
    Share("intangibles_to_assets", "intangibles"),
    Share("operating_cash_flow_to_assets", "operating_cash_flow", low=-5.0, high=5.0, scale="cash"),
    Share("capex_to_assets", "capital_expenditure", high=5.0, scale="cash"),
    Share("repurchases_to_assets", "repurchases", high=5.0, scale="cash"),
    Share("acquisitions_to_assets", "acquisitions", high=5.0, scale="cash"),
    Share("depreciation_to_assets", "depreciation_amortization", high=5.0, scale="cash"),
    Share("share_compensation_to_assets", "share_compensation", high=5.0, scale="cash"),
]

#: The 41 features of `fundamental_features`.
FEATURES = [s.name for s in SHARES] + ["debt_to_assets", "accruals_to_assets"] + [f"{m}_yoy_change" for m in GROWTH] + ["fundamental_field_coverage", "filing_is_annual"]


def metric_tags(spark: SparkSession) -> DataFrame:
    """(metric, kind, tag, unit, preference): METRICS as a table of some 40 rows."""
    rows = [(m, kind, tag, unit, i) for m, unit, kind, tags in METRICS for i, tag in enumerate(tags)]
    return spark.createDataFrame(rows, "metric string, kind string, tag string, unit string, preference int")


def chosen_facts(facts: DataFrame, filings: DataFrame) -> DataFrame:
    """(accession, cik, form, report_date, accepted_at, available_at_quality, picks): each filing's best fact per metric.

    facts: accession, tag, unit, period_start, period_end, value, fiscal_year, fiscal_period, available_at.
    filings: accession, cik, form, report_date, accepted_at, available_at_quality; one row an accession.
    picks maps a metric to (value, days, period_end, fiscal_period, fiscal_year). The best fact is the one
    that ends nearest the report date (within 45 days), then that whose length fits the kind of period, then
    by preference of its tag. All metrics come out of one scan; filings without a usable fact stay, with
    no picks. Facts without value, period end or availability are left out, filings without acceptance too.
    """
    of = filings.where(F.col("form").isin(FORMS) & F.col("accepted_at").isNotNull())
    tags = F.broadcast(metric_tags(facts.sparkSession))
    days = F.date_diff("period_end", "period_start")
    annual = F.col("form").isin(ANNUAL)
    year_to_date = F.when(F.col("fiscal_period") == "Q1", 91).when(F.col("fiscal_period") == "Q2", 182).when(F.col("fiscal_period") == "Q3", 273).when(F.col("fiscal_period") == "FY", 365)
    wanted = F.when(F.col("kind") == "income", F.when(annual, 365).otherwise(91)).otherwise(F.coalesce(year_to_date, F.when(annual, 365).otherwise(clip("days", 60, 300))))
    misfit = F.when(F.col("kind") == "instant", F.when(F.col("period_start").isNotNull(), 500).otherwise(0)).otherwise(F.abs(F.col("days") - wanted))
    usable = facts.where(F.col("value").isNotNull() & F.col("period_end").isNotNull() & F.col("available_at").isNotNull())
    near = (
        usable.join(tags, ["tag", "unit"])
        .join(of.select("accession", "form", "report_date"), "accession")
        .withColumns({"days": days, "away": F.abs(F.date_diff("period_end", F.coalesce("report_date", "period_end")))})
        .where("away <= 45 and (kind = 'instant' or days between 45 and 430)")
    )
    order = F.struct((F.col("away") * 10000 + misfit * 10 + F.col("preference")).alias("s"), "available_at", "tag", "period_end", "days", "value")
    best = near.groupBy("accession", "metric").agg(F.min_by(F.struct("value", "days", "period_end", "fiscal_period", "fiscal_year"), order).alias("pick"))
    picks = best.groupBy("accession").agg(F.map_from_entries(F.collect_list(F.struct("metric", "pick"))).alias("picks"))  # at most one entry per metric
    return of.select("accession", "cik", "form", "report_date", "accepted_at", "available_at_quality").join(picks, "accession", "left")


def _yearly_change(metric: str) -> Column:
    """Against the first report of the period before, of the same fiscal period and company; in [-2, 2]."""
    same_end = Window.partitionBy("cik", "fiscal_period", "period_end").orderBy("accepted_at", "accession").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first(f"__{metric}", ignorenulls=True).over(same_end)
    return F.when(F.col("fiscal_period").isNotNull() & F.col("period_end").isNotNull(), first)


def fundamental_features(chosen: DataFrame) -> DataFrame:
    """Filings with period_end, fiscal_period, fiscal_year and the 41 FEATURES, from `chosen_facts`.

    A metric that a filing lacks is carried over from the company's filing before; growth uses reported
    values only. All windows lie within a company, so one exchange serves them.
    """
    pick = lambda m, f: F.try_element_at("picks", F.lit(m))[f]
    first_of = lambda f: F.coalesce(*[pick(m, f) for m in PERIOD_FROM])
    d = chosen.repartition("cik").withColumns({f"__{m}": pick(m, "value").cast("double") for m in NAMES})
    d = d.withColumns(
        {
            "period_end": first_of("period_end"),
            "fiscal_period": F.coalesce(first_of("fiscal_period"), F.when(F.col("form").isin(ANNUAL), "FY")),
            "fiscal_year": first_of("fiscal_year"),
            "__days": F.coalesce(pick("operating_cash_flow", "days"), pick("capital_expenditure", "days")),
        }
    ).drop("picks")
    d = d.withColumns({f"__first_{m}": _yearly_change(m) for m in GROWTH})
    earlier = Window.partitionBy("cik", "fiscal_period").orderBy(F.unix_date("period_end")).rangeBetween(Window.unboundedPreceding, -1)
    dated = F.col("fiscal_period").isNotNull() & F.col("period_end").isNotNull()
    d = d.withColumns({f"{m}_yoy_change": symmetric_change(f"__{m}", F.when(dated, F.last(f"__first_{m}", ignorenulls=True).over(earlier))) for m in GROWTH})
    w = ordered("cik", ["accepted_at", "accession"])
    d = d.withColumns({f"__{m}": forward_fill(f"__{m}", w) for m in NAMES})
    yearly = {"income": F.when(F.col("form").isin(ANNUAL), 1.0).otherwise(4.0), "cash": ratio(F.lit(365.0), clip(F.col("__days").cast("double"), 60.0, 430.0))}
    v = lambda m: F.col(f"__{m}")
    out = {s.name: safe_ratio(v(s.of) * yearly[s.scale] if s.scale else v(s.of), v(s.to), s.low, s.high) for s in SHARES}
    out["debt_to_assets"] = safe_ratio(F.coalesce(v("long_term_debt"), F.lit(0.0)) + F.coalesce(v("current_debt"), F.lit(0.0)), v("assets"), 0.0, 3.0)
    out["accruals_to_assets"] = safe_ratio(v("net_income") * yearly["income"] - v("operating_cash_flow") * yearly["cash"], v("assets"), -5.0, 5.0)
    out["fundamental_field_coverage"] = sum((F.when(v(m).isNotNull(), 1).otherwise(0) for m in NAMES), F.lit(0)) / F.lit(float(len(NAMES)))
    out["filing_is_annual"] = F.when(F.col("form").isin(ANNUAL), 1.0).otherwise(0.0)
    d = d.withColumns(out)
    return d.select("accession", "cik", "form", "accepted_at", "available_at_quality", "period_end", "fiscal_period", "fiscal_year", *FEATURES)


def filing_snapshots(features: DataFrame, entities: DataFrame, sessions: DataFrame, session: str, least: int = 1, zone: str = "America/New_York", ticker: str = "ticker", cols: Sequence[str] = tuple(FEATURES)) -> DataFrame:
    """Per ticker and session the last filing that may first be traded then: the session after its local date.

    Filings with fewer than `least` features, or beyond the calendar, are left out. Several tickers may
    share a company.
    """
    enough = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in cols), F.lit(0)) >= least
    d = features.where(enough).withColumn("__local", F.to_date(F.from_utc_timestamp(F.col("accepted_at").cast("timestamp"), zone)))
    d = next_session(d, "__local", sessions, session).where("trade_date is not null").drop("__local")
    return keep_one(entities.join(d, "cik"), [ticker, "trade_date"], [F.col("accepted_at").desc(), F.col("accession").desc()])
