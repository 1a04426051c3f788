"""Column functions shared by batch and streaming jobs."""

from .scalar import (  # noqa: F401
    age_interval, band, band_label, bmi, bmi_index, finite_positive, fmt2,
    fmt_pct1, normalize_gender, percentile_text, restrict, round_even,
    safe_double, safe_int, with_default,
)
