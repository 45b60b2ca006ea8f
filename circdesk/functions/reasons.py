"""Ordered checks: the first one that fails names the outcome of a request."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    code: str
    fails: Column
    message: Column | str


def first_failing(checks: Sequence[Check]) -> tuple[Column, Column]:
    """(code, message) of the first failing check, null when all pass.

    A check whose condition is null counts as passed, as in three-valued SQL logic.
    """
    code = F.lit(None).cast("string")
    message = F.lit(None).cast("string")
    for check in reversed(checks):
        text = F.lit(check.message) if isinstance(check.message, str) else check.message
        code = F.when(check.fails, F.lit(check.code)).otherwise(code)
        message = F.when(check.fails, text).otherwise(message)
    return code, message


def fill(template: str, *values: str | Column) -> Column:
    """``template`` with each ``{}`` replaced by a column; a null value makes the text null."""
    texts = template.split("{}")
    parts: list[Column] = [F.lit(texts[0])]
    for value, text in zip(values, texts[1:], strict=True):
        column = F.col(value) if isinstance(value, str) else value
        parts += [column.cast("string"), F.lit(text)]
    return F.concat(*parts)
