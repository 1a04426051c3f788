"""cohortlens: population body-measurement analytics on Spark DataFrames.

The names below are the public API; each takes and returns DataFrames or
Columns, so they compose with any other Spark code.
"""

__version__ = "0.1.0"

from .functions import (  # noqa: F401
    age_interval, band, band_label, bmi, bmi_index, finite_positive, fmt2, fmt_pct1,
    normalize_gender, percentile_text, restrict, round_even, safe_double, safe_int,
    with_default,
)
from .operators.aggregate import (  # noqa: F401
    category_gender_counts, contingency, counts, crosstab, crosstab_counts, crosstab_pct,
    gender_pivot, levels, mean_by, multi_counts, pct_of_total, pct_within, share,
    with_proportions,
)
from .operators.clean import (  # noqa: F401
    coerce_numeric, complete_cases, fill_bmi, finite_positive_rows, head, profile, quarantine,
    require_rows, round_measures, subset_equal, valid, valid_submissions,
)
from .operators.distribution import (  # noqa: F401
    below_above, box_stats, cumulative, density, ecdf, histogram, outliers, percentile_many,
    percentile_of, quantile_sketches, quantiles, quantiles_approx, scatter_bins, scatter_points,
    sketch_quantiles,
)
from .operators.enrich import enrich, score, with_category  # noqa: F401
from .operators.hypothesis import chi_square, chi_square_pvalue, report, verdict  # noqa: F401
from .operators.users import cohort_summary, compare_users, latest  # noqa: F401
from .session import checkpoint_root, get_session, keep, release, scratch_path  # noqa: F401
from .sources.ingest import (  # noqa: F401
    detect_dialect, harmonize, null_tokens, read_mixed, read_people,
)
from .sources.sinks import append_scored, read_log, write_table  # noqa: F401
