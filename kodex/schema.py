"""Fixed seeds and enumerations of the data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Courts, and who may depart from whose decisions (citing court, citing panel, cited court, binding).
COURTS = [("US", "Ústavní soud"), ("NSS", "Nejvyšší správní soud"), ("NS", "Nejvyšší soud")]
AUTHORITY = [
    ("NSS", "extended", "NSS", True), ("NS", "grand", "NS", True), ("US", "plenary", "US", True), ("US", "panel", "NSS", True), ("US", "panel", "NS", True),
    ("US", "plenary", "NSS", True), ("US", "plenary", "NS", True), ("NSS", "panel", "NSS", False), ("NS", "panel", "NS", False),
]
LABELS = ["FOLLOWED", "MENTIONED", "DISTINGUISHED", "NARROWED", "DEPARTED", "CRITICIZED", "QUASHED", "UNCLASSIFIED"]
#: Labels a model may give.
MODEL_LABELS = LABELS[:-1]
#: Labels that are told apart with difficulty.
CLUSTER = ["DISTINGUISHED", "NARROWED", "DEPARTED"]


def courts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COURTS, "code string, name string")


def authority(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(AUTHORITY, "citing_court string, citing_panel string, cited_court string, binding boolean")
