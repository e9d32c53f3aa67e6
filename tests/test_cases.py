"""Each function and page operator on small cases, whose results follow from reading."""

import cases_pages  # noqa: F401  each module adds its cases
import cases_rows  # noqa: F401
import pytest
from cases import CASES, MARK, pick
from pyspark.sql import functions as F


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(spark, name):
    inputs, outputs, key, prepare = CASES[name]
    count = 2 * len(next(iter(inputs.values()))) + 1
    rows = spark.range(count).select(F.col("id").alias(key)).select(key, *[pick(v, F.col(key)).alias(c) for c, v in inputs.items()])
    rows = prepare(rows) if prepare else rows
    got = {r[0]: tuple(r)[1:] for r in rows.select(key, *[f(F.col).alias(c) for c, (f, _) in outputs.items()]).collect()}
    told = lambda v, k: v.replace(MARK, str(k)) if isinstance(v, str) else v
    assert got == {k: tuple(told(v[k % len(v)], k) for _, v in outputs.values()) for k in range(count)}
