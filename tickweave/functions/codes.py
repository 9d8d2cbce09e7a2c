"""Stock codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_code(code: Column) -> Column:
    """Six digits of a code in any notation: exchange marks, blanks and case drop, lost leading zeros
    return. Null where no digit is left."""
    digits = F.regexp_replace(code.cast("string"), "[^0-9]", "")
    return F.when(F.length(digits) >= 6, digits).when(F.length(digits) > 0, F.lpad(digits, 6, "0"))
