"""Texts to an outside extractor a few at a time. The extractor is a parameter: nothing here reaches a network."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONGEST = 8000


def extracted(texts: DataFrame, extract: Callable[[list[str]], list[str]], key: str = "id", size: int = 5) -> DataFrame:
    """key and reply of texts(key, text): extract is called with up to `size` trimmed texts of at most LONGEST characters.

    If it fails or gives another number of replies, the texts of that call go one by one; one that fails again, or is
    blank, has a null reply.
    """
    one = F.nullif(F.left(F.trim("text"), F.lit(LONGEST)), F.lit(""))

    def asked(some: list[str]) -> list[str | None]:
        try:
            replies = extract(some)
        except Exception:  # the extractor may raise anything; its failure is a null reply
            replies = []
        if len(replies) == len(some):
            return list(replies)
        return [None] if len(some) == 1 else [asked([t])[0] for t in some]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame.reset_index(drop=True)
            given = frame.index[frame["text"].notna()]
            replies = pd.Series([None] * len(frame), dtype=object)
            for i in range(0, len(given), size):
                part = given[i : i + size]
                replies[part] = asked(frame.loc[part, "text"].tolist())
            yield pd.DataFrame({key: frame[key], "reply": replies})

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, one.alias("text")).mapInPandas(run, f"{key} {kind}, reply string")
