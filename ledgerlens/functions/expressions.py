"""Scalar column expressions (all JVM-side, codegen-friendly, no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.plans import rules as R


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def when_chain(pairs, otherwise) -> Column:
    """``CASE WHEN c1 THEN v1 WHEN c2 THEN v2 ... ELSE otherwise END``."""
    expr = None
    for cond, value in pairs:
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    return expr.otherwise(otherwise) if expr is not None else F.lit(otherwise)


def income_level(revenue) -> Column:
    """> 150000 high, > 50000 medium, else low (strict comparisons)."""
    r = col(revenue)
    return when_chain([(r > t, lbl) for t, lbl in R.INCOME_LEVELS], R.INCOME_DEFAULT)


def age_years(birth_date, ref_date) -> Column:
    """Birthday-aware age in whole years at ``ref_date``."""
    b, ref = col(birth_date), col(ref_date)
    before_birthday = F.date_format(ref, "MMdd") < F.date_format(b, "MMdd")
    return (F.year(ref) - F.year(b) - F.when(before_birthday, 1).otherwise(0)).cast("int")


def age_bucket(birth_date, ref_date) -> Column:
    """18-24, 25-39, 40-59, else 60+ (so ages under 18 also give 60+)."""
    a = age_years(birth_date, ref_date)
    return when_chain([(a.between(18, 24), "18-24"), (a.between(25, 39), "25-39"),
                       (a.between(40, 59), "40-59")], "60+")


def clamp01(x) -> Column:
    """Clamp to [0, 1]."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), col(x)))


def sigmoid(z) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(z)))


# Strings Spark's integer cast accepts: optional sign, digits, optional
# fraction, surrounding whitespace.
INTEGER_TEXT = r"^\s*[+-]?[0-9]+(\.[0-9]*)?\s*$"


def int_or_null(text) -> Column:
    """``try_cast(text as int)``, with non-numeric text rejected by a regex first.

    Same result as ``try_cast``, but the try-cast path is slow on the many
    strings that are not numbers, while the regex test is cheap.
    """
    t = col(text)
    return F.when(t.rlike(INTEGER_TEXT), t.try_cast("int"))


def customer_label(first, last, cust_id) -> Column:
    """``first last (ID n)``, without a name that is unknown."""
    return F.concat_ws(" ", col(first), col(last), F.format_string("(ID %d)", col(cust_id)))


def parse_customer_label(label) -> Column:
    return F.regexp_extract(col(label), r"\(ID (\d+)\)", 1).try_cast("bigint")


def money_sum(x) -> Column:
    """Exact sum of a money column (cents), returned as double."""
    return F.sum(col(x).cast("decimal(18,2)")).cast("double")


def credit_rate(base_rate, credit_score, revenue, jitter=None) -> Column:
    """Base (null -> 4.0) + score adj + income adj + jitter, clamped [1, 9], 2 digits."""
    s, r = col(credit_score), col(revenue)
    base = F.coalesce(col(base_rate).cast("double"), F.lit(R.CREDIT_BASE_RATE_DEFAULT))
    score_adj = when_chain([(s >= t, F.lit(a)) for t, a in R.CREDIT_SCORE_ADJ],
                           F.lit(R.CREDIT_SCORE_ADJ_ELSE))
    income_adj = when_chain([(r >= t, F.lit(a)) for t, a in R.CREDIT_INCOME_ADJ],
                            F.lit(R.CREDIT_INCOME_ADJ_ELSE))
    j = F.lit(0.0) if jitter is None else F.coalesce(col(jitter).cast("double"), F.lit(0.0))
    raw = base + score_adj + income_adj + j
    clamped = F.greatest(F.lit(R.CREDIT_RATE_MIN), F.least(F.lit(R.CREDIT_RATE_MAX), raw))
    # round via decimal so both engines round the decimal value half-up
    return F.round(clamped.cast("decimal(10,4)"), 2).cast("double")


def credit_risk_class(credit_score, revenue) -> Column:
    """Individual risk class from score and revenue."""
    s, r = col(credit_score), col(revenue)
    return when_chain([((s >= ts) & (r >= tr), lbl) for ts, tr, lbl in R.CREDIT_RISK_RULES],
                      R.CREDIT_RISK_ELSE)


def deal_volume_bounds(revenue) -> tuple[Column, Column]:
    """(lower, upper) deal-volume band by revenue."""
    r = col(revenue)
    lo = when_chain([(r >= t, F.lit(lo)) for t, lo, _ in R.DEAL_VOLUME_BANDS], F.lit(R.DEAL_VOLUME_ELSE[0]))
    hi = when_chain([(r >= t, F.lit(hi)) for t, _, hi in R.DEAL_VOLUME_BANDS], F.lit(R.DEAL_VOLUME_ELSE[1]))
    return lo.cast("bigint"), hi.cast("bigint")


def coverage_band(coverage) -> Column:
    c = col(coverage)
    return when_chain([(c < t, lbl) for t, lbl in R.COVERAGE_BANDS], R.COVERAGE_DEFAULT_BAND)


def contains_any(text_lower, keywords) -> Column:
    """OR of ``contains`` over literal keywords (fixed, short lists only)."""
    t = col(text_lower)
    expr = F.lit(False)
    for kw in keywords:
        expr = expr | t.contains(kw)
    return expr
