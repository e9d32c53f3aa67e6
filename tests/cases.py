"""Cases: inputs in turn over numbered rows, and what each must give."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands for a row's number in the texts of cases, so that every row differs.
MARK = "§"
CASES: dict[str, tuple] = {}


def pick(values: list, key: Column) -> Column:
    """The number's value of a list that goes round, with the number in place of the mark."""
    out = F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))
    return F.replace(out, F.lit(MARK), key.cast("string")) if any(isinstance(v, str) for v in values) else out


def cases(name: str, inputs: dict, outputs: dict, table: str = "", key: str = "c_custkey", prepare=None) -> None:
    CASES[name] = (inputs, outputs, key, prepare)
