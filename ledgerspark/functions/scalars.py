"""Column-level helpers (ops H1-H28). All are built-in Spark expressions,
so they stay inside whole-stage codegen; no Python UDF anywhere."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- money ----

def cents(c) -> Column:
    """Amount as whole cents (bigint). Amounts carry at most 2 decimals, so
    the rounding only removes binary noise."""
    return F.round(col(c) * 100).cast("long")


def money_sum(c) -> Column:
    """Exact sum of 2-dp amounts: summed as bigint cents, one division at the
    end. Independent of summation order, so every engine gets the same bits."""
    return F.sum(cents(c)) / F.lit(100.0)


def cents_sum(c) -> Column:
    return F.sum(cents(c))


def from_cents(c) -> Column:
    return col(c) / F.lit(100.0)


# ---------------------------------------------------------------- dates ----

def parse_date(c) -> Column:
    """H1: ``yyyy-MM-dd`` text to date, NULL when it does not parse."""
    return F.try_to_date(F.trim(col(c)), "yyyy-MM-dd")


def parse_amount(c) -> Column:
    """Amount text to double, NULL when it does not parse."""
    return F.trim(col(c)).try_cast("double")


def day_of_week(c) -> Column:
    """H2: Monday = 0 .. Sunday = 6."""
    return F.weekday(col(c))


def month_start(c) -> Column:
    """H6: month bucket as the first day of the month."""
    return F.trunc(col(c), "MM")


def month_text(c) -> Column:
    """H8: ``yyyy-MM``."""
    return F.date_format(col(c), "yyyy-MM")


def is_weekend(c) -> Column:
    return (day_of_week(c) >= 5).cast("int")


def is_month_start(c) -> Column:
    return (F.dayofmonth(col(c)) <= 5).cast("int")


def is_month_end(c) -> Column:
    return (F.dayofmonth(col(c)) >= 25).cast("int")


def after_days_before(date_col, as_of, days: int) -> Column:
    """Rows of the last ``days`` days as the reference selects them:
    ``date >= now - days`` with a clock time after midnight keeps dates
    strictly after ``as_of - days``."""
    return col(date_col) > F.date_sub(F.lit(as_of), days)


# ----------------------------------------------------------------- null ----

def default_if_blank(c, default: str) -> Column:
    """NULL or empty text -> default."""
    return F.coalesce(F.nullif(col(c), F.lit("")), F.lit(default))


# ------------------------------------------------------------- lookups -----

def literal_map(pairs) -> Column:
    """Literal map column from (key, value) pairs, in the given order."""
    return F.create_map(*[x for k, v in pairs for x in (F.lit(k), F.lit(v))])


def category_by_index(idx) -> Column:
    """The category at 0-based position ``idx`` of the 16-value list."""
    return F.element_at(F.array(*[F.lit(c) for c in S.CATEGORIES]), col(idx).cast("int") + 1)


# ---------------------------------------------------------------- bands ----

def risk_level(prob) -> Column:
    """H19 + F9: ladder tried from the highest threshold down, ``>=``."""
    p = col(prob)
    return reduce(
        lambda acc, lv: acc.when(p >= F.lit(lv[1]), F.lit(lv[0])),
        S.RISK_THRESHOLDS[1:],
        F.when(p >= F.lit(S.RISK_THRESHOLDS[0][1]), F.lit(S.RISK_THRESHOLDS[0][0])),
    ).otherwise(F.lit("low"))


def gauge_band(prob) -> Column:
    """Gauge colour (fixed values), strict ``>`` at 0.7 / 0.5 / 0.3."""
    p = col(prob)
    return (
        F.when(p > 0.7, F.lit("#f43f5e"))
        .when(p > 0.5, F.lit("#f59e0b"))
        .when(p > 0.3, F.lit("#3b82f6"))
        .otherwise(F.lit("#10b981"))
    )


def score_band(prob) -> Column:
    """Dashboard card band, strict ``>`` at 0.7 / 0.4."""
    p = col(prob)
    return F.when(p > 0.7, F.lit("rose")).when(p > 0.4, F.lit("amber")).otherwise(F.lit("emerald"))


def level_text(level) -> Column:
    """Label of a risk level."""
    lv = col(level)
    return (
        F.when(lv == "critical", F.lit("Critical Risk"))
        .when(lv == "high", F.lit("High Risk"))
        .when(lv == "medium", F.lit("Moderate Risk"))
        .otherwise(F.lit("Low Risk"))
    )


def priority_rank(priority) -> Column:
    """high 0, medium 1, low 2, anything else 99."""
    p = col(priority)
    out = F.when(p == S.PRIORITY_ORDER[0][0], F.lit(S.PRIORITY_ORDER[0][1]))
    for name, rank in S.PRIORITY_ORDER[1:]:
        out = out.when(p == name, F.lit(rank))
    return out.otherwise(F.lit(99))


def overspend_priority(pct, threshold) -> Column:
    """High when the share exceeds 1.5 x threshold, else medium."""
    return F.when(col(pct) > col(threshold) * 1.5, F.lit("high")).otherwise(F.lit("medium"))


# ----------------------------------------------------------------- text ----

def whole_number(c) -> Column:
    """Thousands-separated whole number (half-even, like Python's format)."""
    return F.format_number(col(c), 0)


def plain_number(c) -> Column:
    """Whole number without separators, half-even like Python's ``.0f``
    (``format_number`` rounds half-even on the binary value; ``format_string``
    with ``%.0f`` would round half-up)."""
    return F.regexp_replace(F.format_number(col(c), 0), ",", "")


def whole_percent(c) -> Column:
    """Ratio as a whole percent like Python's ``.0%``, e.g. 0.355 -> ``36%``."""
    return F.concat(plain_number(col(c) * 100), F.lit("%"))


def feature_label(name) -> Column:
    """``rolling_3m_avg`` -> ``Rolling 3m Avg``."""
    return F.initcap(F.regexp_replace(col(name), "_", " "))


def strip_model_prefix(name) -> Column:
    """Drop the ``classifier_`` / ``risk_`` prefix of a global importance."""
    return F.regexp_replace(col(name), "^(classifier_|risk_)", "")


def contains_ci(text, needle: str) -> Column:
    """Case-insensitive substring test."""
    return F.lower(col(text)).contains(needle.lower())


def js_round(c) -> Column:
    """Math.round for the dashboard: half rounds up."""
    return F.floor(col(c) + F.lit(0.5)).cast("long")


# -------------------------------------------------------------- bitmaps ----

def category_bits(c="category") -> Column:
    """One bit per category of the schema, one more for any other; NULL for none. The
    bits of a group's rows, or-ed, count its distinct categories without a row each."""
    known = F.array_position(F.array(*[F.lit(x) for x in S.CATEGORIES]), col(c)).cast("int")
    return F.pow(F.lit(2), known).cast("long")


def day_bits(c="date") -> Column:
    """One bit per day of the month (for rows of one month)."""
    return F.pow(F.lit(2), F.dayofmonth(col(c))).cast("long")


def distinct_bits(bits: Column) -> Column:
    """How many distinct values a group has, from the bits of its rows (an aggregate)."""
    return F.coalesce(F.bit_count(F.bit_or(bits)), F.lit(0)).cast("long")
