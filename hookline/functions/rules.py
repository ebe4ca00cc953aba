"""Scalar rule columns: verdict/confidence (M4-M6), warnings (M7-M8),
status text (M9), documented risk indicators (M11)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.ml.functions import vector_to_array

from hookline.fixed import (INDICATOR_RULES, NEW_DOMAIN_DAYS, NO_WARNINGS_TEXT, WARN_IP,
                            WARN_NEW_DOMAIN, WARN_NO_HTTPS, WARN_TYPOSQUAT)

_OPS = {
    ">": lambda c, v: c > v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    "==": lambda c, v: c == v,
    "in [0, v)": lambda c, v: (c >= 0) & (c < v),
}


def warnings(has_https="has_https", has_ip="has_ip_address", typo="typosquatting_score",
             brand="closest_brand", age="domain_age_days") -> Column:
    """M7: array of fired warning texts, in rule order."""
    c = F.col
    head, tail = WARN_TYPOSQUAT.split("{brand}")
    rules = [
        F.when(c(has_https) == 0, F.lit(WARN_NO_HTTPS)),
        F.when(c(has_ip) != 0, F.lit(WARN_IP)),
        F.when(c(typo) > 0, F.concat(F.lit(head), F.coalesce(c(brand), F.lit("unknown")), F.lit(tail))),
        F.when((c(age) >= 0) & (c(age) < NEW_DOMAIN_DAYS), F.lit(WARN_NEW_DOMAIN)),
    ]
    return F.filter(F.array(*rules), lambda x: x.isNotNull())


def warning_text(warn: Column) -> Column:
    """M8: newline-joined warnings, or the no-warning text."""
    return F.when(F.size(warn) == 0, F.lit(NO_WARNINGS_TEXT)).otherwise(F.array_join(warn, "\n"))


def indicator_names() -> list[str]:
    return [name for name, *_ in INDICATOR_RULES]


def risk_indicators() -> Column:
    """Array of the names of fired documented indicators."""
    fired = [F.when(_OPS[op](F.col(feat), F.lit(val)), F.lit(name))
             for name, feat, op, val in INDICATOR_RULES]
    return F.filter(F.array(*fired), lambda x: x.isNotNull())


def indicator_count() -> Column:
    """Number of fired indicators (0..13) without building the array."""
    terms = [F.when(_OPS[op](F.col(feat), F.lit(val)), 1).otherwise(0)
             for _, feat, op, val in INDICATOR_RULES]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def is_phishing(prediction: Column) -> Column:
    """M4."""
    return prediction == 1.0


def confidence(probability: Column) -> Column:
    """M5: the larger class probability."""
    return F.array_max(vector_to_array(probability))


def phishing_probability(probability: Column) -> Column:
    """M6: probability of class 1."""
    return vector_to_array(probability)[1]


def status_line(verdict: Column, url: Column, conf: Column) -> Column:
    """M9: ``PHISHING``/``SAFE`` status text with the url cut to 50 characters."""
    status = F.when(verdict, F.lit("PHISHING")).otherwise(F.lit("SAFE"))
    pct = F.format_string("%.0f%%", conf * 100)
    return F.format_string("%-8s %s... (%s)", status, F.substring(url, 1, 50), pct)
