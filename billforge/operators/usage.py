"""Token-usage rollups at three grains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usage_grains(usage: DataFrame) -> DataFrame:
    """One row per tenant for everything, each vendor and each model; ``usage`` has client_id, provider, model, tokens.

    Grains must not be added up: each holds all tokens once.
    """
    out = usage.groupingSets([["client_id"], ["client_id", "provider"], ["client_id", "model"]], "client_id", "provider", "model").agg(
        F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_calls"), F.grouping_id().alias("g")
    )
    grain = F.when(F.col("g") == 3, "aggregate").when(F.col("g") == 1, "provider").otherwise("model")
    return out.select("client_id", grain.alias("grain"), F.coalesce("provider", "model", F.lit("aggregate")).alias("name"), "tokens", "n_calls")


def stored_totals(rows: DataFrame, tenants: DataFrame, tenant: str = "client_id") -> DataFrame:
    """grain ('provider' or 'model'), name and the three sums over the usage rows of ``tenants``.

    Stored rows are of three grains: a vendor's have no model and are not of 'aggregate', a
    model's have one; each is added up by itself, as all hold the same tokens.
    """
    own = rows.join(tenants.select(tenant).distinct(), tenant, "left_semi")
    grain = F.when(F.col("model").isNotNull(), "model").when(F.col("provider") != "aggregate", "provider")
    told = own.select(grain.alias("grain"), F.coalesce("model", "provider").alias("name"), "input_tokens", "output_tokens", "total_tokens").where("grain is not null")
    return told.groupBy("grain", "name").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens", "total_tokens")))
