"""Problem 3: values packed in the copy-orientation field of image annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.multivalue import SEPARATORS, split_values
from ..tables import table

FIELD = "话术分析"
MAX_NAMES = 10_000  # names are a lookup list; a table beyond this isn't one


def protected_names(labels: DataFrame, task: str) -> list[str]:
    """Names in label_set that hold a separator; the list is small by contract and its size is checked."""
    holds = f"[{''.join(chr(92) + c if c in '|/+&' else c for c in SEPARATORS)}]"
    names = labels.where(F.col("task") == task).select(F.explode(F.array("name_en", "name_zh")).alias("name")).where(F.col("name").rlike(holds)).distinct().limit(MAX_NAMES + 1).collect()
    if len(names) > MAX_NAMES:
        raise ValueError(f"label_set holds over {MAX_NAMES} names with separators")
    return sorted(r.name for r in names)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ann_id, pos, item_value) of every value; a row delivered twice counts once, by its last delivery.

    The last delivery is the greatest (submitted_at, field); rows with a null ann_id have no identity and are left out.
    """
    names = protected_names(table(spark, sf_dir, "label_set"), "image_classification")
    rows = table(spark, sf_dir, "image_annotations").select("ann_id", FIELD, "submitted_at").where(F.col("ann_id").isNotNull())
    once = rows.groupBy("ann_id").agg(F.max_by(FIELD, F.struct("submitted_at", FIELD)).alias(FIELD))
    return split_values(once, FIELD, ["ann_id"], names)


QUERIES = {"p3_found": p3_found}
SQL: dict[str, str] = {}
