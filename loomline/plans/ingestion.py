"""The ingestion plan: filter, judge staleness, set aside what is known, understand the rest in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators.ingest import BLACKLIST, canonical_url, rule_filter

Understand = Callable[[pd.DataFrame], pd.DataFrame]


def ingest(items: DataFrame, known: DataFrame, understand: Understand, schema: str, blacklist: tuple[str, ...] = BLACKLIST) -> DataFrame:
    """Rows of `items` (id, title, content, url) that pass the rules and whose URL is not in `known` (urlHash), as
    `understand` maps them, a batch at a time. The function is given, so that tests and other models can stand in."""
    fresh = items.withColumn("urlHash", F.sha2(canonical_url(F.col("url")), 256)).join(known.select("urlHash"), "urlHash", "left_anti")
    passed = rule_filter(fresh, "title", "content", "url", blacklist).filter("not filtered").select("id", "title", "content", "url", "urlHash", "score")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield understand(b)

    return passed.mapInPandas(run, schema)
