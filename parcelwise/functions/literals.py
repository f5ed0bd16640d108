"""Small constant tables as local relations, so that the optimizer knows their size."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _sql(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return f"{v!r}D"
    if isinstance(v, int):
        return str(v)
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_table(spark: SparkSession, rows: list[tuple], *names: str) -> DataFrame:
    body = ", ".join("(" + ", ".join(_sql(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(names)})")
