"""Classification of texts by keyword and pattern tables (H27-H31, N5). The tables are parameters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.rules import DOC_TYPE_PATTERNS, PAYER_SIGNATURES


def _count(flags: Sequence[Column]) -> Column:
    out = F.lit(0)
    for f in flags:
        out = out + F.when(f, 1).otherwise(0)
    return out


def _any(flags: Sequence[Column]) -> Column:
    out = F.lit(False)
    for f in flags:
        out = out | f
    return out


def best(scores: Mapping[str, Column], least: float, none: str | None) -> tuple[Column, Column]:
    """The name with the highest score of at least ``least``, the first of equals, and that score."""
    top = F.greatest(*scores.values(), F.lit(0.0))
    name = F.lit(none).cast("string")
    for key, score in reversed(scores.items()):
        name = F.when(score == top, key).otherwise(name)
    found = (top > 0) & (top >= least)
    return F.when(found, name).otherwise(F.lit(none)), F.when(found, top).otherwise(0.0)


def payer_scores(text: Column, signatures: Mapping = PAYER_SIGNATURES) -> dict[str, Column]:
    """0.65 for any primary keyword, 0.10 for each secondary one up to 0.30; a negative keyword makes it 0."""
    t = F.lower(text)
    out = {}
    for name, (primary, secondary, negative) in signatures.items():
        score = F.when(_any([t.contains(k) for k in primary]), 0.65).otherwise(0.0) + F.least(_count([t.contains(k) for k in secondary]) * 0.10, F.lit(0.30))
        out[name] = F.round(F.when(_any([t.contains(k) for k in negative]), 0.0).otherwise(score), 4)
    return out


def payer(text: Column, signatures: Mapping = PAYER_SIGNATURES) -> tuple[Column, Column]:
    return best(payer_scores(F.coalesce(text, F.lit("")), signatures), 0.0, "UNKNOWN")


def page_payer(text: Column, signatures: Mapping = PAYER_SIGNATURES) -> tuple[Column, Column]:
    """As ``payer`` for a single page: null below 0.30."""
    return best(payer_scores(F.coalesce(text, F.lit("")), signatures), 0.30, None)


def is_cover(text: Column, keywords: Sequence[str], least: int = 2) -> Column:
    t = F.lower(text)
    return _count([t.contains(k) for k in keywords]) >= least


def cover_score(text: Column, weights: Mapping[str, float], auth: str | None = None, limit: float = 1.5) -> Column:
    """Whether the weights of the patterns found reach the limit and no authorization keyword is found."""
    total = F.lit(0.0)
    for pattern, weight in weights.items():
        total = total + F.when(text.rlike("(?i)" + pattern), weight).otherwise(0.0)
    return (total >= limit) & (~text.rlike("(?i)" + auth) if auth else F.lit(True))


def doc_type(text: Column, patterns: Mapping = DOC_TYPE_PATTERNS, none: str = "OTHER") -> tuple[Column, Column]:
    """0.50 and 0.12 for each strong pattern up to 0.35, 0.05 for each weak one up to 0.15; a negative pattern makes it 0."""
    scores = {}
    for name, (strong, weak, negative) in patterns.items():
        hit = lambda p: text.rlike("(?i)" + p)
        n, m = _count([hit(p) for p in strong]), _count([hit(p) for p in weak])
        score = F.when(n > 0, 0.50 + F.least(n * 0.12, F.lit(0.35))).otherwise(0.0) + F.least(m * 0.05, F.lit(0.15))
        scores[name] = F.round(F.when(_any([hit(p) for p in negative]), 0.0).otherwise(score), 4)
    return best(scores, 0.0, none)


def decision(kind: Column) -> Column:
    return F.when(kind == "PRIOR_AUTH_APPROVAL", "APPROVED").when(kind.isin("PRIOR_AUTH_DENIAL", "PEER_TO_PEER_DENIAL"), "DENIED")
