"""Binding of composed arguments, so that nested formulas stay small.

A formula that names an argument several times copies its whole expression tree each
time; a few levels of nesting grow the tree beyond what the analyzer can hold.  ``let``
computes such an argument once per row and hands the formula a variable.  Plain columns
and literals are passed as they are and keep whole-stage code generation.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PLAIN = re.compile(r"Column<'-?[\w.]+(\[\w+\])*'>")


def _plain(value) -> bool:
    return not isinstance(value, Column) or value.__dict__.get("_is_variable", False) or bool(PLAIN.fullmatch(str(value)))


def let(formula: Callable[..., Column]) -> Callable[..., Column]:
    """The formula, with each composed positional argument evaluated once."""

    @functools.wraps(formula)
    def bound(*args):
        for k, value in enumerate(args):
            if not _plain(value):

                def body(variable: Column) -> Column:
                    variable.__dict__["_is_variable"] = True
                    return bound(*args[:k], variable, *args[k + 1 :])

                return F.transform(F.array(value), body)[0]
        return formula(*args)

    return bound
