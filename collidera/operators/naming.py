"""Column names of callers kept apart from the names that operators use themselves."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import wraps
from inspect import signature

from pyspark.sql import DataFrame

from collidera.functions.cells import cell
from collidera.operators.cube import rows_of


def apart(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Let an operator over ``(df, value, by, ..., weight)`` take columns of any name.

    It sees only the columns it is asked about, under names of their own. Groups get
    their names back; a column of the operator that has the name of a group is followed
    by an underscore.
    """

    @wraps(operator)
    def run(*args, **named) -> DataFrame:
        given = signature(operator).bind(*args, **named)
        given.apply_defaults()
        asked = given.arguments
        by: Sequence[str] = asked["by"]
        asked["df"], asked["weight"] = rows_of(asked["df"], [*by, asked["value"]], asked["weight"])
        inner = [f"_by{i}" for i in range(len(by))]
        columns = [cell(b).alias(k) for b, k in zip(by, inner, strict=True)]
        columns.append(cell(asked["value"]).alias("_value"))
        if asked["weight"] is not None:
            columns.append(cell(asked["weight"]).alias("_weight"))
            asked["weight"] = "_weight"
        asked |= {"df": asked["df"].select(*columns), "value": "_value", "by": inner}
        out = operator(*given.args, **given.kwargs)
        outer = dict(zip(inner, by, strict=True))
        return out.select(
            *[cell(c).alias(outer.get(c, f"{c}_" if c in by else c)) for c in out.columns]
        )

    return run
