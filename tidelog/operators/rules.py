"""Row rules: why a row is skipped, how its status is shown, where it is routed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import variants as V
from ..schema import MESSAGES_PATH


def skip_reason() -> Column:
    """First rule a row breaks, NULL for a row to keep. A NULL status breaks the first."""
    return (
        F.when(~F.col("status").eqNullSafe(200), F.lit("status"))
        .when(F.coalesce("error", F.lit("")) != "", F.lit("error"))
        .when(F.upper("method") != "POST", F.lit("method"))
        .when(~F.contains("path", F.lit(MESSAGES_PATH)), F.lit("path"))
    )


def kept_row() -> Column:
    """The same rules as one predicate that pushes down to the scan."""
    return (
        (F.col("status") == 200)
        & (F.coalesce("error", F.lit("")) == "")
        & (F.upper("method") == "POST")
        & F.contains("path", F.lit(MESSAGES_PATH))
    )


def searchable() -> Column:
    """Search is looser: the path matches in any case, errors do not matter."""
    return (F.col("status") == 200) & (F.col("method") == "POST") & F.col("path").ilike(f"%{MESSAGES_PATH}%")


def status_class() -> Column:
    """Status 0 counts as pending, as a missing one does."""
    return (
        F.when(F.col("status") == 200, F.lit("ok"))
        .when(F.coalesce("status", F.lit(0)) != 0, F.lit("err"))
        .otherwise("pending")
    )


def model_of_body(body: Column) -> Column:
    """Model named in a JSON body, empty when it names none."""
    return F.coalesce(V.text_of(V.parse_object(body), "model"), F.lit(""))


def resolve_route(log: DataFrame, routes: DataFrame, default_url: str) -> DataFrame:
    """Add the upstream of each row: ``url``, ``patch_sse`` and ``target``.

    A plain join: Spark broadcasts the routes if their bytes allow. An empty
    model never matches.
    """
    usable = routes.where("model <> ''").select("model", F.col("url").alias("_url"), F.col("patch_sse").alias("_patch"))
    url = F.coalesce("_url", F.lit(default_url))
    return (
        log.join(usable, "model", "left")
        .withColumn("url", url)
        .withColumn("patch_sse", F.coalesce("_patch", F.lit(False)))
        .withColumn("target", F.concat(F.rtrim("url", F.lit("/")), "path"))
        .drop("_url", "_patch")
    )
