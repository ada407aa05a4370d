"""Scalar functions on text that Spark has no built-in for, as Arrow-batched functions."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql.functions import pandas_udf

ANCHOR = re.compile(r"""(?is)<a\b[^>]*\bhref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>""")
DROPPED = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->")
NOTICE = "\n[truncated]"


@pandas_udf("string")
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def model_input(text: str | None, most: int = 32_000) -> str | None:
    """HTML as plain text: scripts, styles and comments dropped, links as `text (link: url)`, entities decoded, at most `most` characters."""
    if text is None:
        return None
    text = DROPPED.sub(" ", text)
    text = ANCHOR.sub(lambda m: f"{m[2]} (link: {m[1]})", text)
    text = html.unescape(re.sub(r"<[^>]+>", " ", text))
    text = re.sub(r"\s+", " ", text).strip()
    return text if len(text) <= most else text[:most] + NOTICE


@pandas_udf("string")
def as_model_input(texts: pd.Series) -> pd.Series:
    return texts.map(model_input)
