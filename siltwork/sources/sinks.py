"""Cleaned data, manifests, evidence and plans to files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltwork.functions import texts as X
from siltwork.functions import values as V
from siltwork.operators.registry import RID
from siltwork.plans.plan import CleaningPlan


def neutralized(df: DataFrame) -> DataFrame:
    """No cell that a spreadsheet would take for a formula."""
    return df.withColumns({c: V.formula_safe(F.col(f"`{c}`")) for c, kind in df.dtypes if kind == "string"})


def write_csv(df: DataFrame, path: str) -> None:
    neutralized(df.drop(RID)).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def write_corpus(df: DataFrame, path: str) -> None:
    """JSON lines with id, label and text, and a manifest without texts."""
    df.select(F.col("path").alias("id"), F.col("class").alias("label"), "text").write.mode("overwrite").json(f"{path}/documents")
    rest = df.select("path", "class", "suspected_mislabel", X.word_count(F.col("text")).alias("words"))
    neutralized(rest).write.mode("overwrite").option("header", "true").csv(f"{path}/manifest")


def write_media_manifest(df: DataFrame, path: str) -> None:
    neutralized(df.drop("phash", "thumb", "signature", RID)).write.mode("overwrite").option("header", "true").csv(path)


def write_evidence(evidence: DataFrame, path: str) -> None:
    evidence.write.mode("overwrite").partitionBy("kind").parquet(path)


SCRIPT = '''"""Runs a cleaning plan again: spark-submit this_file.py INPUT OUTPUT (Parquet folders)."""
import sys

from pyspark.sql import SparkSession

from siltwork.plans.plan import CleaningPlan, execute_plan

PLAN = CleaningPlan.from_json({plan!r})
spark = SparkSession.builder.getOrCreate()
run = execute_plan(PLAN, spark.read.parquet(sys.argv[1]))
if run.errors:
    sys.exit("\\n".join(run.errors))
run.df.write.parquet(sys.argv[2])
'''


def plan_script(plan: CleaningPlan) -> str:
    return SCRIPT.format(plan=plan.to_json())
