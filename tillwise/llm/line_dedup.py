"""Line dedup by overlapping three-line windows (DataFrame functions only).

Every run of three consecutive non-blank lines is hashed; windows that occur more than once anywhere are found by
one aggregation; every occurrence but the first is removed by merging the places that such windows cover.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillwise.llm import repeats

RUN = 3


def line_dedup(docs: DataFrame, run: int = RUN) -> DataFrame:
    """``docs`` with repeated lines cut from ``text``, plus n_lines and n_removed.

    The first occurrence is that of the smallest (doc_id, text hash, line). Blank lines are skipped when windows
    are formed and go only when they lie between removed lines. Null text stays null with 0 lines; an empty text
    has one blank line; a document of fewer than three non-blank lines is left alone. Rows that repeat a doc_id with
    the same text are one document and get the same result; a null doc_id sorts first. Extra columns are
    kept, those called n_lines or n_removed are replaced.
    """
    lines = F.when(F.col("text").isNull(), F.array().cast("array<string>")).otherwise(F.split("text", "\n"))
    gone = repeats.covered(repeats.windows(docs, lines, run, 1))
    return repeats.without(docs, gone, lines, "\n", ("n_lines", "n_removed"))
