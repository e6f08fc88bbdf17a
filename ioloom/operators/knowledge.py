"""Evidence retrieval by labels and signature, and scoring of text recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def signed_similarity(query: Column, entry: Column) -> Column:
    """Mean over keys of both maps where the query isn't 0 of the smaller over the larger value; 0 without such keys."""
    both = F.filter(F.map_values(F.map_zip_with(query, entry, lambda _, x, y: F.struct(x.alias("x"), y.alias("y")))), lambda p: p["x"].isNotNull() & p["y"].isNotNull() & (p["x"] != 0))
    parts = F.transform(both, lambda p: F.least(p["x"], p["y"]) / F.greatest(p["x"], p["y"], F.lit(1e-9)))
    return F.when(F.size(parts) == 0, 0.0).otherwise(F.aggregate(parts, F.lit(0.0), lambda s, v: s + v) / F.size(parts))


def json_in_text(text: Column, schema: str) -> Column:
    """A JSON object in a reply: the whole text, a fenced block, or the span from the first to the last brace."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    span = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.from_json(F.when(F.trim(text).startswith("{"), text), schema), F.from_json(F.nullif(fenced, F.lit("")), schema), F.from_json(F.nullif(span, F.lit("")), schema))


def groundedness(responses: DataFrame) -> DataFrame:
    """model, n_recommendations, n_grounded, grounded share of those whose citation names a retrieved entry. responses: model, cited, retrieved (ids)."""
    hit = F.exists("retrieved", lambda e: F.contains(F.coalesce("cited", F.lit("")), e))
    return responses.select("model", F.coalesce(hit, F.lit(False)).alias("hit")).groupBy("model").agg(F.count("*").alias("n_recommendations"), F.count_if("hit").alias("n_grounded"), F.avg(F.col("hit").cast("double")).alias("grounded"))


#: The checks of a recommendation's claims.
CLAIMS = ["dimension_match", "fix_type_match", "code_pattern_match", "api_change_match", "speedup_plausible"]


def claim_statistics(checked: DataFrame) -> DataFrame:
    """Per model: recommendations in all, cited and not, the share with a valid citation, each claim's share among the
    cited, and claim_groundedness, the claims' mean. checked: model, has_citation, citation_valid and CLAIMS as booleans."""
    total, cited = F.greatest(F.count("*"), F.lit(1)), F.greatest(F.count_if("has_citation"), F.lit(1))
    held = {c: F.count_if(F.coalesce(c, F.lit(False))) for c in CLAIMS}
    share = lambda n, of: F.round(n / of, 4)
    return checked.groupBy("model").agg(
        F.count("*").alias("n_recs_total"), F.count_if("has_citation").alias("n_recs_cited"), F.count_if(~F.coalesce("has_citation", F.lit(False))).alias("n_recs_uncited"), share(F.count_if(F.coalesce("citation_valid", F.lit(False))), total).alias("citation_groundedness"),
        *[share(n, cited).alias(f"{c}_rate") for c, n in held.items()], share(sum(held.values(), F.lit(0)), 5 * cited).alias("claim_groundedness"),
    )


def canonical_fixes(kb: DataFrame) -> DataFrame:
    """dimension, fix: of the first entry (by ordinal) that lists the dimension, its fix for it, else its first fix.

    kb: ordinal, dims, fixes (array of structs with dimension). Entries are aggregated by dimension, never gathered.
    """
    first = kb.select("ordinal", "fixes", F.explode("dims").alias("dimension")).groupBy("dimension").agg(F.min_by("fixes", "ordinal").alias("fixes"))
    own = F.filter("fixes", lambda f: f["dimension"] == F.col("dimension"))
    return first.select("dimension", F.coalesce(F.get(own, F.lit(0)), F.get("fixes", F.lit(0))).alias("fix"))


def token_cost(usage: DataFrame, rates: DataFrame) -> DataFrame:
    """model, cost in USD (4 places) of tokens_in and tokens_out by the model's rates for a million; 1 and 3 for a model without rates.

    rates: model, rate_in, rate_out, a row a model; usage is summed by model before the join.
    """
    sums = usage.groupBy("model").agg(F.sum("tokens_in").alias("i"), F.sum("tokens_out").alias("o"))
    cost = (F.col("i") * F.coalesce("rate_in", F.lit(1.0)) + F.col("o") * F.coalesce("rate_out", F.lit(3.0))) / 1e6
    return sums.join(rates, "model", "left").select("model", F.round(cost, 4).alias("cost"))


def cache_key(*parts: Column) -> Column:
    return F.md5(F.concat(*[F.coalesce(p, F.lit("")) for p in parts]))
