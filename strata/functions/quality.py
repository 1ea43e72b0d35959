"""Rule outcome columns: breach, alert level, alert message."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rule types that breach when the measured value is too small.
MINIMUM_RULES = ("uniqueness", "volume_compare")

# Relative deviation above which an alert is an error or a warning, and the
# smallest divisor used for it.
ERROR_DEVIATION = 2.0
WARN_DEVIATION = 1.0
SMALLEST_DIVISOR = 0.01


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def breach(rule_type, actual, threshold) -> Column:
    """True when the measured value is on the wrong side of the threshold; null without a value."""
    actual, threshold = _col(actual), _col(threshold)
    return F.when(_col(rule_type).isin(*MINIMUM_RULES), actual < threshold).otherwise(actual > threshold)


def alert_level(actual, threshold) -> Column:
    actual, threshold = _col(actual), _col(threshold)
    deviation = F.abs(actual - threshold) / F.greatest(threshold, F.lit(SMALLEST_DIVISOR))
    return (
        F.when(deviation > ERROR_DEVIATION, "error")
        .when(deviation > WARN_DEVIATION, "warn")
        .when(deviation.isNotNull(), "info")
    )


def alert_message(table, column, rule_type, actual, threshold) -> Column:
    rule_type = _col(rule_type)
    side = F.when(rule_type.isin(*MINIMUM_RULES), "below").otherwise("above")
    return F.format_string(
        "%s, %s: measured %s of %.4f, which is %s the limit of %.4f",
        _col(table), F.coalesce(_col(column), F.lit("(whole table)")), rule_type,
        _col(actual), side, _col(threshold),
    )
