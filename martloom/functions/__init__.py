"""Column-level building blocks; every one is a native Spark expression."""

from .labels import (bin_fixed, date_key_of, date_of_key, daypart, is_late,
                     late_minutes_over, names_of, rfm_segment, value_map)
from .numeric import clean_nan, half_even, money, safe_ratio

__all__ = ["bin_fixed", "clean_nan", "date_key_of", "date_of_key", "daypart", "half_even", "is_late",
           "late_minutes_over", "money", "names_of", "rfm_segment",
           "safe_ratio", "value_map"]
