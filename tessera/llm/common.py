"""Pieces the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than the six ASCII white-space ones.
WORD = r"[^\x20\x09-\x0D]+"


def slices(batches: Iterator[pd.DataFrame], rows: int = 400) -> Iterator[pd.DataFrame]:
    """Batches of whole texts in parts of few rows, so that what is made of a part fits a worker; the session's own batch size stays."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.iloc[at : at + rows]


def is_held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text is divisible by 5; a null id is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
