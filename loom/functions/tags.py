"""The grammar of tagged responses: think, answer and seg blocks, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: the tag patterns
THINK = r"(?s)<think>(.*?)</think>"
ANSWER = r"(?s)<answer>(.*?)</answer>"
SEGMENT = r"<seg>\s*(\d+(?:\.\d+)?)\s*,\s*(\d+(?:\.\d+)?)\s*</seg>"
WHOLE = r"(?s)^\s*<think>(.*?)</think>\s*<answer>(.*?)</answer>\s*$"
# ---


def answers(response: Column) -> Column:
    return F.transform(F.regexp_extract_all(response, F.lit(ANSWER), F.lit(1)), lambda x: strip(x))


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def answer(response: Column, which: int = 1) -> Column:
    """The first (1), second (2) or last (-1) answer, stripped; empty where there is none."""
    return F.coalesce(F.try_element_at(answers(response), F.lit(which)), F.lit(""))


def segments(response: Column) -> Column:
    """All (start, end) pairs of well-formed seg tags."""
    side = lambda k: F.transform(F.regexp_extract_all(response, F.lit(SEGMENT), F.lit(k)), lambda x: x.cast("double"))
    return F.arrays_zip(side(1).alias("start"), side(2).alias("end"))


def n_segments(response: Column) -> Column:
    return F.size(F.regexp_extract_all(response, F.lit(SEGMENT), F.lit(0)))


def has_think(response: Column) -> Column:
    return response.rlike(THINK)


def has_answer(response: Column) -> Column:
    return response.rlike(ANSWER)


def opens_think(response: Column) -> Column:
    return response.contains("<think>")


def structured(response: Column) -> Column:
    """Whether the whole response is a think block with a segment and a non-empty answer block."""
    think, found = F.regexp_extract(response, WHOLE, 1), strip(F.regexp_extract(response, WHOLE, 2))
    return response.rlike(WHOLE) & think.rlike(SEGMENT) & (found != "")


# --- fixed values: what normalising strips from answers
SECONDS, PUNCTUATION, ARTICLES = r"(\d+(?:\.\d+)?)\s*seconds?", r"[!-/:-@\[-`{-~]", r"\b(a|an|the)\b"
# ---


def normalised_answer(x: Column) -> Column:
    """Lower case, single blanks, no final periods, and "N seconds" as N."""
    x = F.rtrim(F.regexp_replace(F.lower(strip(x)), r"\s+", " "), F.lit("."))
    return strip(F.regexp_replace(x, SECONDS, "$1"))


def qa_normalised(x: Column) -> Column:
    """Lower case without ASCII punctuation, articles and extra blanks."""
    x = F.regexp_replace(F.lower(x), PUNCTUATION, "")
    return strip(F.regexp_replace(F.regexp_replace(x, ARTICLES, " "), r"\s+", " "))


def segment_count_valid(response: Column, duration: Column | None = None) -> Column:
    """Segments with start below 0, end before start, or end beyond the duration."""
    bad = lambda s: (s["start"] < 0) | (s["end"] < s["start"]) | ((s["end"] > duration) if duration is not None else F.lit(False))
    return F.size(F.filter(segments(response), bad))
