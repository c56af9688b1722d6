"""What a field's plan does: counts of the operators that cost, for tests and for looking at one's own graphs."""

from __future__ import annotations

import re
from collections import Counter

from ..field import Field

_COSTLY = re.compile(r"^[\s:+\-*()0-9]*(\w*Join|Exchange|BroadcastExchange|Window|Generate|\w*Aggregate|\w*Python\w*|\w*Arrow\w*|\w*Pandas\w*|Scan \w+|FileScan \w+)", re.M)


def plan_counts(f: Field) -> Counter:
    """Operators of the physical plan by name, as planned before adaptive execution."""
    return Counter(m.group(1) for m in _COSTLY.finditer(f.df()._jdf.queryExecution().sparkPlan().toString()))
