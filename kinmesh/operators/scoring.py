"""Comparison of candidate pairs field by field, score rules, conflicts, signals, decision.

Records are joined to pairs twice by key; the two similarities are computed once per pair in Arrow batches, everything else
stays in generated code. Pairs are oriented by a_key < b_key, on which the length rules depend.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmesh.config import ScoringConfig
from kinmesh.functions.similarity import jaro_winkler

FIELDS = ["name", "phone", "email", "dob", "natid", "address"]
NEEDED = [*[f"{f}_norm" for f in FIELDS], "record_hash"]


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def with_records(pairs: DataFrame, norm: DataFrame) -> DataFrame:
    side = lambda p: norm.select(F.col("customer_key").alias(f"{p}_key"), *[F.col(c).alias(f"{p}_{c}") for c in NEEDED])
    return pairs.join(side("a"), "a_key").join(side("b"), "b_key")


def compared(pairs: DataFrame, norm: DataFrame, cfg: ScoringConfig) -> DataFrame:
    """Adds <field>_kind, <field>_sim and <field>_gain to pairs with both records' fields."""
    return _compared(with_records(pairs, norm), cfg)


def _compared(df: DataFrame, cfg: ScoringConfig) -> DataFrame:
    df = df.withColumns({"name_sim": jaro_winkler("a_name_norm", "b_name_norm"), "address_sim": jaro_winkler("a_address_norm", "b_address_norm")})
    least = {"name": cfg.name_fuzzy, "address": cfg.address_fuzzy}
    out = {}
    for f in FIELDS:
        a, b, w = F.col(f"a_{f}_norm"), F.col(f"b_{f}_norm"), cfg.weights[f]
        kind = F.when(a.isNull() & b.isNull(), "both_null").when(a.isNull() | b.isNull(), "one_null")
        if f in least:
            s = F.col(f"{f}_sim")
            out[f"{f}_kind"] = kind.when(s >= 0.99, "exact_match").when(s >= least[f], "fuzzy_match").when(s >= 0.7, "low_similarity").otherwise("mismatch")
            out[f"{f}_gain"] = F.when(a.isNull() | b.isNull(), 0.0).when(s >= 0.99, w).when(s >= least[f], w * s).when(s >= 0.7, 0.5 * w * s).otherwise(-0.3 * w)
        else:
            out[f"{f}_kind"] = kind.when(a == b, "exact_match").otherwise("mismatch")
            out[f"{f}_sim"] = F.when(a == b, 1.0).otherwise(0.0)
            out[f"{f}_gain"] = F.when(a.isNull() | b.isNull(), 0.0).when(a == b, w).otherwise(-0.5 * w)
    return df.withColumns(out)


def conflicts() -> Column:
    """Hard conflicts of a compared pair: differing identifiers without a strong identity, birth years more than two apart."""
    strong = (F.col("name_sim") >= 0.85) & ((F.col("email_kind") == "exact_match") | (F.col("phone_kind") == "exact_match") | (F.col("address_sim") >= 0.85))
    years = F.abs(F.year(F.to_date("a_dob_norm")) - F.year(F.to_date("b_dob_norm")))
    return F.array_compact(F.array(F.when((F.col("natid_kind") == "mismatch") & ~strong, "natid_mismatch"), F.when(years > 2, "dob_major_mismatch")))


def signals() -> Column:
    exact = lambda f: F.col(f"{f}_kind") == "exact_match"
    return F.array_compact(F.array(
        F.when(exact("name"), "exact_name").when(F.col("name_sim") >= 0.85, "fuzzy_name_high"), *[F.when(exact(f), f"exact_{f}") for f in ("phone", "email", "natid", "dob")],
        F.when(exact("address"), "exact_address").when(F.col("address_sim") >= 0.80, "address_high"),
    ))


def same_hash() -> Column:
    """Equal content; records without any content are not equal."""
    return (F.col("a_record_hash") == F.col("b_record_hash")) & F.coalesce(*[f"a_{f}_norm" for f in FIELDS]).isNotNull()


def rules(cfg: ScoringConfig) -> Column:
    """Average over fields both sides have, low-information cap, long-name boost, exact-name boost; in this order."""
    gained = sum(F.greatest(F.col(f"{f}_gain"), F.lit(0.0)) for f in FIELDS)
    seen = sum(F.when(F.col(f"{f}_kind").isin("both_null", "one_null"), 0.0).otherwise(cfg.weights[f]) for f in FIELDS)
    name, sim, length = F.col("name_kind"), F.col("name_sim"), F.length("a_name_norm")
    trusted = (name == "exact_match") | ((name == "fuzzy_match") & (sim > 0.88) & (length > 10))
    others = F.greatest(*[f"{f}_gain" for f in FIELDS if f != "name"]) > 0
    cap = lambda s: F.when((seen < 0.4) & (s > 0.8) & ~trusted, 0.8).otherwise(s)
    boost = lambda s: F.when(sim >= 0.90, F.when(length > 8, F.greatest(s, F.lit(0.93))).otherwise(s)).when((sim >= 0.85) & (length > 10), F.greatest(s, F.lit(0.90))).otherwise(s)
    link = lambda s: F.when((name == "exact_match") & others, F.greatest(s, F.lit(0.98))).otherwise(s)
    average = F.when(seen < 0.1, 0.0).otherwise(F.try_divide(gained, seen))
    return _let(average, lambda s: _let(cap(s), lambda c: _let(boost(c), link)))


def score(df: DataFrame, cfg: ScoringConfig) -> DataFrame:
    """compared() with score, hard_conflicts, signals_hit; equal hashes skip all rules."""
    df = df.withColumns({"same_hash": same_hash(), "hard_conflicts": conflicts(), "signals_hit": signals()})
    clamped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), rules(cfg)))
    return df.withColumns({
        "score": F.when(F.col("same_hash"), 1.0).when(F.size("hard_conflicts") > 0, 0.1).otherwise(clamped),
        "hard_conflicts": F.when(F.col("same_hash"), F.array().cast("array<string>")).otherwise(F.col("hard_conflicts")),
        "signals_hit": F.when(F.col("same_hash"), F.array(F.lit("exact_hash_match"), F.lit("auto_link_forced"))).otherwise(F.col("signals_hit")),
    })


def decide(cfg: ScoringConfig) -> Column:
    s = F.round("score", 9)
    return F.when(F.size("hard_conflicts") > 0, "REJECT").when((s >= cfg.auto) & ((F.size("signals_hit") >= 2) | (s >= 0.98)), "AUTO_LINK").when(s >= cfg.review, "REVIEW").otherwise("REJECT")


def _said(field: Column, kind: Column, sim: Column) -> Column:
    """What a comparison is explained by."""
    # Texts of the explanations.
    share = F.format_string("%.1f%%", F.round(100 * sim, 1))
    about = lambda head: F.concat(F.lit(f"{head} similarity ("), share, F.lit(") on "), field)
    return (
        F.when(kind == "both_null", "Both values are null - no evidence").when(kind == "one_null", F.concat(F.lit("One value is null ("), field, F.lit(")"))).when(kind == "exact_match", F.concat(F.lit("Exact match on "), field))
        .when(kind == "fuzzy_match", about("High")).when(kind == "low_similarity", about("Moderate")).when(field.isin("name_norm", "address_norm"), about("Low")).otherwise(F.concat(F.lit("Values differ for "), field))
    )


def evidence() -> Column:
    """The comparison of each field as an array of structs of seven; one element for pairs of equal hash.

    The explanation is added by one expression for all fields, which keeps the generated code small.
    """

    def item(field, a, b, kind, sim, gain):
        return F.struct(F.lit(field).alias("field"), a.alias("value_a"), b.alias("value_b"), kind.alias("type"), sim.alias("similarity"), gain.alias("weight"))

    items = [item(f"{f}_norm", F.col(f"a_{f}_norm"), F.col(f"b_{f}_norm"), F.col(f"{f}_kind"), F.col(f"{f}_sim"), F.col(f"{f}_gain")) for f in FIELDS]
    whole = item("record_hash", F.col("a_record_hash"), F.col("b_record_hash"), F.lit("exact_match"), F.lit(1.0), F.lit(1.0))
    every = F.when(F.col("same_hash"), F.array(whole)).otherwise(F.array(*items))
    keep = lambda e: [e[n].alias(n) for n in ("field", "value_a", "value_b", "type")]
    return F.transform(every, lambda e: F.struct(*keep(e), F.round(e["similarity"], 6).alias("similarity"), F.round(e["weight"], 6).alias("weight"), _said(e["field"], e["type"], e["similarity"]).alias("explanation")))


def decisions(pairs: DataFrame, norm: DataFrame, cfg: ScoringConfig) -> DataFrame:
    """Every pair with score, evidence columns and decision."""
    return score(compared(pairs, norm, cfg), cfg).withColumn("decision", decide(cfg))


def decided(met: DataFrame, cfg: ScoringConfig) -> DataFrame:
    """decisions() of pairs that already have both records' fields, as blocking.meetings() gives them."""
    return score(_compared(met, cfg), cfg).withColumn("decision", decide(cfg))
