"""Routes: which upstream serves a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import variants as V

DEFAULT_KEY = "__default_upstream__"  # fixed value of the file format
FALLBACK_URL = "http://localhost:8000"  # fixed value: used when the file names no default


def routes_from_json(text: DataFrame, column: str = "value") -> DataFrame:
    """``(model, url, patch_sse)`` from a JSON object of model -> url or {url, patch_sse, ...}."""
    pairs = text.select(F.explode(V.entries(F.parse_json(F.col(column)))).alias("model", "route"))
    route = F.col("route")
    url = F.coalesce(V.plain_string(route), V.text_of(route, "url"))
    checked = F.when(url.isNotNull(), url).otherwise(
        F.raise_error(F.concat(F.lit("route needs a url: "), F.col("model")))
    )
    return pairs.where(~F.startswith("model", F.lit("_comment"))).select(
        "model", checked.alias("url"),
        F.coalesce(V.get(route, "patch_sse", "boolean"), F.lit(False)).alias("patch_sse"),
    )


def load_routes(spark: SparkSession, path: str) -> DataFrame:
    return routes_from_json(spark.read.text(path, wholetext=True))


def split_default(routes: DataFrame) -> tuple[DataFrame, str]:
    """Routes by model, and the default upstream."""
    row = routes.where(F.col("model") == DEFAULT_KEY).select("url").first()
    return routes.where(F.col("model") != DEFAULT_KEY), row[0] if row else FALLBACK_URL
