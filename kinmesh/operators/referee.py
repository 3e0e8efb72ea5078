"""Rule-based second opinion on pairs, its texts, and the reading of written judgements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinmesh.config import ScoringConfig


def in_gray_zone(score: Column, conflicts: Column, cfg: ScoringConfig) -> Column:
    return score.between(*cfg.gray) & (F.size(conflicts) == 0)


def judgement(score: Column, conflicts: Column, cfg: ScoringConfig) -> Column:
    """MATCH or NO_MATCH where rules decide, null in the gray zone."""
    return F.when(F.size(conflicts) > 0, "NO_MATCH").when(score > cfg.gray[1], "MATCH").when(score < cfg.gray[0], "NO_MATCH")


def explanation(score: Column, conflicts: Column, cfg: ScoringConfig) -> Column:
    # Texts of the explanations, here and in template().
    two = F.format_string("%.2f", F.round(score, 2))
    return (
        F.when(F.size(conflicts) > 0, F.concat(F.lit("Automated Rejection: Critical conflicts detected ("), F.array_join(conflicts, ", "), F.lit(").")))
        .when(score > cfg.gray[1], F.concat(F.lit("Automated Confirmation: Match score ("), two, F.lit(") is very high and exceeds the verification threshold.")))
        .when(score < cfg.gray[0], F.concat(F.lit("Automated Rejection: Match score ("), two, F.lit(") is too low to be considered a potential match.")))
    )


def template(score: Column, evidence: Column) -> Column:
    lines = F.transform(evidence, lambda e: F.concat(F.lit("- **"), e["field"], F.lit("**: "), e["type"], F.lit(" ("), F.format_string("%.0f%%", F.round(e["similarity"] * 100, 0)), F.lit(")")))
    head = F.concat(F.lit("## Match Analysis (Template Fallback)\n**Match Score:** "), F.format_string("%.1f%%", F.round(score * 100, 1)), F.lit("\n\n### Evidence:"))
    return F.concat_ws("\n", F.array(head), lines, F.array(F.lit("\n### Guidance:"), F.lit("Please review the fields manually.")))


def parse(text: Column) -> dict[str, Column]:
    """judgement and analysis of a written answer; UNSURE and the text itself where the markers are missing."""
    said = F.upper(F.trim(F.regexp_extract(text, r"(?im)^\s*JUDGEMENT:(.*)$", 1)))
    kind = F.when(said.contains("NO_MATCH") | said.contains("NO MATCH"), "NO_MATCH").when(said.contains("MATCH") & ~said.contains("NO"), "MATCH").otherwise("UNSURE")
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    kept = F.filter(lines, lambda x: (x != "") & ~F.upper(x).startswith("JUDGEMENT"))
    body = F.array_join(F.transform(kept, lambda x: F.when(F.upper(x).startswith("ANALYSIS:"), F.trim(F.regexp_replace(x, r"(?i)^ANALYSIS:", ""))).otherwise(x)), " ")
    return {"judgement": kind, "analysis": F.when(body != "", body).otherwise(text)}
