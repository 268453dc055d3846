"""Article bodies from ``clean``: body blocks in order, joined by a line feed, without white space."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# White space as Python's str.isspace has it: Unicode White_Space and the four information separators.
SPACE = r"(?U)[\s\x1c-\x1f]+"


def squeezed_bodies(clean: DataFrame) -> DataFrame:
    """(article_id, body): the body without white space; null ids are left out, null blocks count as empty."""
    body = F.array_join(F.transform(F.filter("blocks", lambda b: b["type"] == "body"), lambda b: b["text"]), "\n")
    return clean.where("article_id is not null").select(
        "article_id", F.regexp_replace(F.coalesce(body, F.lit("")), SPACE, "").alias("body")
    )
