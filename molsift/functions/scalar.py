"""Row-local column expressions (section B of the inventory).

Every function returns a ``Column`` built from ``pyspark.sql.functions`` so
that it stays inside whole-stage codegen; nothing here runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = "Column | str"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def nan_to_null(col) -> Column:
    """A parsed ``NaN`` becomes SQL NULL (Spark would rank NaN highest)."""
    c = _c(col)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def to_double(col) -> Column:
    """Numeric coercion, unparsable text or NaN -> NULL."""
    c = F.trim(_c(col).cast("string")).try_cast("double")
    return nan_to_null(c)


def is_finite(col) -> Column:
    """True when the value is a number, not NULL, NaN or +-Infinity."""
    c = _c(col).cast("double")
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))),
                      F.lit(False))


def sigmoid(col) -> Column:
    """1 / (1 + exp(-x))."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(col)))


def yes_no(col) -> Column:
    """1 when the trimmed text equals ``Yes``, else 0 (NULL -> 0)."""
    return F.when(F.trim(_c(col)) == F.lit("Yes"), F.lit(1)).otherwise(F.lit(0))


def threshold_label(col, threshold: float = 0.5) -> Column:
    """``Yes`` if p >= threshold else ``No``; NULL stays NULL."""
    c = _c(col)
    return F.when(c.isNull(), F.lit(None).cast("string")) \
        .when(c >= F.lit(threshold), F.lit("Yes")).otherwise(F.lit("No"))


# The attachment-label patterns. Any numbered label, or only the
# labels 1 to 16, are rewritten to the plain attachment ``[*]``.
ANY_LABEL_PATTERN = r"\[\d+\*\]"
LABEL_1_TO_16_PATTERN = r"\[(?:[1-9]|1[0-6])\*\]"


def normalize_attachments(col, max_label: int | None = None) -> Column:
    """``[n*]`` -> ``[*]``; with ``max_label=16`` only labels 1..16."""
    if max_label is None:
        pattern = ANY_LABEL_PATTERN
    elif max_label == 16:
        pattern = LABEL_1_TO_16_PATTERN
    else:
        alts = "|".join(str(i) for i in range(1, max_label + 1))
        pattern = r"\[(?:" + alts + r")\*\]"
    return F.regexp_replace(_c(col), pattern, "[*]")


def strip_stereo(col) -> Column:
    """Drop the stereo marks ``/``, ``\\`` and ``@``."""
    return F.regexp_replace(_c(col), r"[/\\@]", "")


def group_order(col) -> Column:
    """``f_`` -> 1, ``s_`` -> 2, ``t_`` -> 3, anything else -> 1."""
    c = _c(col)
    return (F.when(c.startswith("s_"), F.lit(2))
            .when(c.startswith("t_"), F.lit(3))
            .otherwise(F.lit(1)))


def pct(num, den) -> Column:
    """100 * num / den, 0 when the denominator is 0 or NULL."""
    n, d = _c(num).cast("double"), _c(den).cast("double")
    return F.when(F.coalesce(d, F.lit(0.0)) > 0, F.lit(100.0) * n / d).otherwise(F.lit(0.0))


def pct_text(num, den, decimals: int = 2) -> Column:
    """The same ratio rendered as text with a percent sign."""
    return F.concat(F.format_number(pct(num, den), decimals), F.lit("%"))


def sa_proxy(mw) -> Column:
    """Synthetic-accessibility proxy = molecular weight / 100."""
    return _c(mw) / F.lit(100.0)


def strip_text(col) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(_c(col), r"(?U)^\s+|\s+$", "")


def non_blank(col) -> Column:
    """B23 predicate: stripped text is not empty (NULL is blank)."""
    return F.coalesce(F.length(strip_text(col)) > 0, F.lit(False))


def verdict(r2_train, r2_test) -> Column:
    """Bands of fit on the training R^2 and of use on the test R^2.

    Training: above 0.85 good, above 0.7 average, else poor. Testing: above
    0.6 generalises, else does not.
    """
    train, test = _c(r2_train), _c(r2_test)
    fit = F.when(train > 0.85, F.lit("good")).when(train > 0.7, F.lit("average")).otherwise(F.lit("poor"))
    use = F.when(test > 0.6, F.lit("good")).otherwise(F.lit("poor"))
    return F.struct(F.when(train.isNotNull(), fit).alias("fit"), F.when(test.isNotNull(), use).alias("generalises"))
