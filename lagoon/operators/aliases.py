"""Names of entities with the spans in which they may be used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of aliases that today's knowledge supplies, and which therefore need a first date.
PROSPECTIVE = ["brand", "product", "subsidiary", "executive", "prospective"]
COLUMNS = ["ticker", "alias", "alias_kind", "valid_from", "valid_to", "source", "confidence", "retrieved_at"]


def iso_day(x: Column) -> Column:
    """The date at the head of an ISO instant; NULL if there is none."""
    return F.regexp_extract(x, r"^\s*([0-9]{4}-[0-9]{2}-[0-9]{2})", 1).try_cast("date")


def registrant_aliases(df: DataFrame, ticker: str, payload: str, retrieved: str) -> DataFrame:
    """COLUMNS of former and legal names from registrants' JSON: name, formerNames (name, from, to).

    A former name holds from its first to its last day. The legal name holds from the day after the last end
    of a former one; without such an end from the day of retrieval only, so that it is never used earlier.
    Blank names are left out, and payloads that are no JSON object give nothing.
    """
    kind = "struct<name: string, formerNames: array<struct<name: string, `from`: string, `to`: string>>>"
    j = df.select(F.col(ticker).alias("ticker"), F.from_json(payload, kind).alias("j"), F.col(retrieved).cast("string").alias("retrieved_at")).where("j is not null")
    former = F.filter(
        F.transform(F.coalesce("j.formerNames", F.array().cast("array<struct<name: string, `from`: string, `to`: string>>")), lambda f: F.struct(F.trim(f["name"]).alias("alias"), F.lit("sec_former_name").alias("alias_kind"), iso_day(f["from"]).alias("valid_from"), iso_day(f["to"]).alias("valid_to"))),
        lambda f: F.coalesce(f["alias"], F.lit("")) != "",
    )
    begins = F.coalesce(F.date_add(F.array_max(F.transform("former", lambda f: f["valid_to"])), 1), iso_day(F.col("retrieved_at")))
    legal = F.struct(F.trim("j.name").alias("alias"), F.lit("sec_legal_name").alias("alias_kind"), begins.alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    names = j.withColumn("former", former).select("ticker", "retrieved_at", F.explode(F.concat("former", F.array(legal))).alias("n"))
    return names.select("ticker", "n.*", F.lit("sec_submissions").alias("source"), F.lit(1.0).alias("confidence"), "retrieved_at").where("alias <> ''").select(*COLUMNS)


def curated_aliases(df: DataFrame) -> DataFrame:
    """COLUMNS of reviewed aliases (ticker, alias, alias_kind, valid_from; the others if there are any).

    A row without ticker, alias or kind is an error, and so is one of a PROSPECTIVE kind without valid_from.
    """
    if lacking := {"ticker", "alias", "alias_kind", "valid_from"} - set(df.columns):
        raise ValueError(f"aliases without {sorted(lacking)}")
    text = lambda c, other="": F.coalesce(F.trim(F.col(c).cast("string")), F.lit(other)) if c in df.columns else F.lit(other)
    ticker, alias, kind, begin = F.upper(text("ticker")), text("alias"), F.lower(text("alias_kind")), text("valid_from")
    where = F.concat_ws(" ", ticker, alias, kind)
    checked = (
        F.when((ticker == "") | (alias == "") | (kind == ""), F.raise_error(F.concat(F.lit("incomplete alias: "), where)))
        .when(kind.isin(PROSPECTIVE) & (begin == ""), F.raise_error(F.concat(F.lit("alias without valid_from: "), where)))
        .otherwise(alias)
    )
    return df.select(ticker.alias("ticker"), checked.alias("alias"), kind.alias("alias_kind"), iso_day(begin).alias("valid_from"), iso_day(text("valid_to")).alias("valid_to"), text("source", "curated").alias("source"), F.coalesce(text("confidence", "1.0").try_cast("double"), F.lit(1.0)).alias("confidence"), text("retrieved_at").alias("retrieved_at"))
