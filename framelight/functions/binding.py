"""Values that are made once and used often."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once: as a lambda's variable. The optimizer would else copy a long expression to
    each place that names it, beyond what code generation can compile."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def once(value: Column) -> Column:
    return let(value, lambda x: x)
