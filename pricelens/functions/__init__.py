"""Column-level functions and reusable aggregate kernels."""

from .columns import (  # noqa: F401
    DEFAULT_ITEMS,
    NULL_TOKENS,
    nan_to_null,
    null_tokens,
    parse_header_date,
    parse_price,
    period_label,
)
from .quantiles import exact_quantiles  # noqa: F401
