from salescope.functions.exprs import (
    as_double,
    count_if,
    count_rows,
    day_diff,
    margin_pct,
    mean,
    money,
    month_text,
    nonzero,
    pct,
    round_half_up,
    safe_ratio,
    ship_days,
    year_month_text,
    year_text,
)

__all__ = [
    "as_double",
    "count_if",
    "count_rows",
    "day_diff",
    "margin_pct",
    "mean",
    "money",
    "month_text",
    "nonzero",
    "pct",
    "round_half_up",
    "safe_ratio",
    "ship_days",
    "year_month_text",
    "year_text",
]
