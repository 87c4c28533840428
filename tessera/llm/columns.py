"""Names of added columns where a table of the caller has the same ones."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fresh(df: DataFrame, name: str) -> str:
    """name, with lines added until no column of df is called so (Spark's names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def cleared(df: DataFrame, *names: str) -> DataFrame:
    """df with its own columns of these names kept as `<name>_input`, so that an operator's column can take the name."""
    wanted = {n.lower() for n in names}
    for c in df.columns:
        if c.lower() in wanted:
            df = df.withColumnRenamed(c, fresh(df, f"{c}_input"))
    return df
