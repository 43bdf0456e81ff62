"""Column-level building blocks (all JVM-side expressions)."""

from statline.functions.arrays import (  # noqa: F401
    collect_distinct, find_first, fold_sums, null_safe_array_union, within)
from statline.functions.positions import (  # noqa: F401
    draftworthy, roster_position, slots_of, top_k_bound)
