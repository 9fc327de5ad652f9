"""Stages of a pipeline whose errors stay with their row.

A stage gives each row a value or an error; an error never ends the job. A row whose
stage fails is blocked, or goes on with the text it had where the stage may be left
out. A row's filter mode says which stages it takes part in.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Filter modes, fixed values: only stages that redact; none.
REDACT, PASSTHROUGH = "redact", "passthrough"
_RESULT = "struct<text:string,error:string>"


@dataclass(frozen=True)
class Stage:
    """``apply`` takes the text's column and returns ``text, error`` (see ``attempt``, ``isolated``)."""

    name: str
    apply: Callable[[Column], Column]
    critical: bool = True
    redacts: bool = False


def attempt(text: Column, error: Column | None = None) -> Column:
    """A stage's result: the text, or where ``error`` isn't null the error. A null text is one too: what ``try_`` functions give."""
    said = F.lit(None).cast("string") if error is None else error
    return F.struct(text.alias("text"), F.coalesce(said, F.when(text.isNull(), F.lit("no_value"))).alias("error")).cast(_RESULT)


def isolated(function: Callable[[str], str]) -> Callable[[Column], Column]:
    """A Python function of a text as a stage; what it raises is the row's error (the name of its class)."""

    def one(text: str) -> tuple[str | None, str | None]:
        try:
            return function(text), None
        except Exception as e:  # any error belongs to its row
            return None, type(e).__name__

    @F.pandas_udf(_RESULT)
    def apply(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if t is None else one(t) for t in texts], columns=["text", "error"])

    return apply


def run_stages(df: DataFrame, text_col: str, stages: Sequence[Stage], mode: Column | None = None, phase: str = "request", forward: bool = False) -> DataFrame:
    """Replace the text by what all stages make of it; adds ``disposition, actions, reasons, failed``.

    Stages run in order on rows that no stage blocked. In the request phase, with
    ``forward``, an error of a stage that isn't critical is only noted; any other
    error blocks the row, with the text it had. ``failed`` lists ``stage, error``.
    Rows of null take part in no stage. No shuffle.
    """
    mode = F.coalesce(mode, F.lit("")) if mode is not None else F.lit("")
    none = F.array().cast("array<string>")
    out = df.withColumns({"_mode": mode, "disposition": F.lit("allow"), "actions": none, "reasons": none, "failed": F.array().cast("array<struct<stage:string,error:string>>")})
    for stage in stages:
        active = (F.col("disposition") != "block") & (F.col("_mode") != PASSTHROUGH) & F.col(text_col).isNotNull()
        if not stage.redacts:
            active = active & (F.col("_mode") != REDACT)
        soft = forward and phase == "request" and not stage.critical
        out = out.withColumn("_own", F.when(active, F.col(text_col))).withColumn("_result", stage.apply(F.col("_own")))
        bad = F.col("_own").isNotNull() & F.col("_result.error").isNotNull()
        action = F.lit(f"{phase}_pipeline:{'degraded' if soft else 'error'}:{stage.name}")
        out = out.withColumns(
            {
                text_col: F.when(F.col("_own").isNotNull() & ~bad, F.col("_result.text")).otherwise(F.col(text_col)),
                "actions": F.when(bad, F.concat("actions", F.array(action))).otherwise(F.col("actions")),
                "failed": F.when(bad, F.concat("failed", F.array(F.struct(F.lit(stage.name).alias("stage"), F.col("_result.error").alias("error"))))).otherwise(F.col("failed")),
                "reasons": F.when(bad & F.lit(not soft), F.concat("reasons", F.array(F.lit(f"{phase}_filter_error")))).otherwise(F.col("reasons")),
                "disposition": F.when(bad & F.lit(not soft), F.lit("block")).otherwise(F.col("disposition")),
            }
        ).drop("_own", "_result")
    return out.drop("_mode")


def rejects(df: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """One row for each error of ``run_stages``: ids, ``stage, error``."""
    return df.select(*id_cols, F.explode_outer("failed").alias("f")).where("f is not null").select(*id_cols, "f.*")
