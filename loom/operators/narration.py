"""Reasoning texts: written from evidence by question type, read back from their tags, and diversified."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from loom.functions import fmt, tags

# --- fixed values: the sentences of each question type; a and b are the first two events, t the last one
NARRATIVES = {
    "gap": (
        "{a_seg} contains {a} and ends at {a_end} seconds. {b_seg} contains {b} and begins at {b_start} seconds. The gap is {b_start} - {a_end} = {gap} seconds, which rounds to {answer}.",
        "The relevant first event is {a_seg}, where {a} ends at {a_end} seconds. The next event is {b_seg}, where {b} starts at {b_start} seconds. Subtracting the end time from the next start time gives {gap} seconds, so the closest choice is {answer}.",
    ),
    "repeated_event_gap": ("{a_seg} marks the earlier occurrence, which ends at {a_end} seconds. {b_seg} marks the following occurrence, which starts at {b_start} seconds. The elapsed time between them is {b_start} - {a_end} = {gap} seconds, rounding to {answer}.",),
    "overlap": ("{a_seg} contains {a} from {a_start} to {a_end} seconds. {b_seg} contains {b} from {b_start} to {b_end} seconds. Their shared interval runs from {from} to {to} seconds, lasting {common} seconds. Rounded to one decimal place, this is {answer}.",),
    "duration_compare": ("{a_seg} contains {a} and lasts {a_len} seconds. {b_seg} contains {b} and lasts {b_len} seconds. Since {longer_len} seconds is longer than {shorter_len} seconds, the longer event is {longer}.",),
    "order": ("{a_seg} shows {a} beginning at {a_start} seconds. {b_seg} shows {b} beginning at {b_start} seconds. Comparing the two start times, {first} begins first.",),
    "start_percentage": ("{a_seg} contains {a}, which begins at {a_start} seconds. The full audio lasts {total} seconds. The start point is {a_start} / {total} times 100 = {start_share}% of the total duration. Using the available choices, this corresponds to {answer}.",),
    "duration_percentage": ("{a_seg} contains {a} and lasts {a_len} seconds. The full audio lasts {total} seconds. Dividing {a_len} by {total} and multiplying by 100 gives {len_share}%, which is closest to {answer}.",),
    "count_before": ("{completed}. {t_seg} contains the target event, which begins at {t_start} seconds. There are {n} completed timestamped events before that start time, so the answer is {answer}.",),
}
COMPLETED = "{seg} shows completed event {k} ending at {end} seconds"
# --- fixed values: what is stripped from the words before a tag, in this order
LABEL_TAILS = (
    r"^the\s+", r"\s+(?:segment|sound|event|part|portion|clip|audio)\s*$", r"\s+(?:ends?|finishes?|stops?|ceases?|concludes?)\s+(?:at|before|after)?\s*$",
    r"\s+(?:begins?|starts?|commences?|initiates?|appears?|occurs?|emerges?|enters?)\s+(?:at|before|after)?\s*$", r"\s+from\s*$",
    r"\s+(?:contains?|shows?|marks?|indicates?|captures?|features?|reveals?|is|are|was|were|has?|have?)\s*$", r"\s+(?:which|that|who)\s+.*$", r"^,\s*", r"^\s*\.\s*",
)
LABEL_EDGE, NO_LABEL, LABEL_WORDS = r"[.,;: ]+$", "this sound", 8
# ---


def filled(template: str, values: dict[str, Column]) -> Column:
    """The template with its {names} replaced."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[p].cast("string") if k % 2 else F.lit(p) for k, p in enumerate(parts) if k % 2 or p])


def segment(event: Column) -> Column:
    return F.concat(F.lit("<seg>"), fmt.time(event["start"]), F.lit(", "), fmt.time(event["end"]), F.lit("</seg>"))


def narrated(kind: Column, events: Column, answer: Column, duration: Column, key: Column) -> Column:
    """The tagged response of a question: its type's sentences over evidence (start, end, phrase), then the answer.

    Of several versions of a type, the key's hash picks one.  Another type, or count_before with less
    than two events, is an error.  A missing or zero duration counts as 10 seconds.
    """
    a, b, t = F.get(events, F.lit(0)), F.get(events, F.lit(1)), F.element_at(events, -1)
    total = F.coalesce(F.nullif(duration, F.lit(0.0)), F.lit(10.0))
    length = lambda e: e["end"] - e["start"]
    # rounds the number itself, a tie to even, as C's printf does; Java's rounds its shortest decimal text up
    three = lambda x: F.call_function("format_number", x, F.lit("0.000"))
    two = lambda x: F.call_function("format_number", x, F.lit("0.00"))
    start, end = F.greatest(a["start"], b["start"]), F.least(a["end"], b["end"])
    done = F.filter(F.slice(events, 1, F.greatest(F.size(events) - 1, F.lit(0))), lambda e: e["end"] <= t["start"] + 1e-6)
    completed = F.transform(done, lambda e, i: filled(COMPLETED, {"seg": segment(e), "k": i + 1, "end": fmt.time(e["end"])}))
    values = {
        "a": a["phrase"], "a_seg": segment(a), "a_start": fmt.time(a["start"]), "a_end": fmt.time(a["end"]), "a_len": three(length(a)), "b": b["phrase"], "b_seg": segment(b), "b_start": fmt.time(b["start"]), "b_end": fmt.time(b["end"]), "b_len": three(length(b)),
        "gap": three(b["start"] - a["end"]), "from": fmt.time(start), "to": fmt.time(end), "common": three(F.greatest(F.lit(0.0), end - start)), "longer_len": three(F.greatest(length(a), length(b))), "shorter_len": three(F.least(length(a), length(b))),
        "longer": F.when(length(a) > length(b), a["phrase"]).otherwise(b["phrase"]), "first": F.when(a["start"] <= b["start"], a["phrase"]).otherwise(b["phrase"]), "total": fmt.time(total), "start_share": two(a["start"] / total * 100), "len_share": two(length(a) / total * 100),
        "completed": F.array_join(completed, "; "), "n": F.size(done), "t_seg": segment(t), "t_start": fmt.time(t["start"]), "answer": answer,
    }
    text = F.raise_error(F.concat(F.lit("no sentences for "), kind)).cast("string")
    for name, versions in NARRATIVES.items():
        chosen = F.element_at(F.array(*[filled(v, values) for v in versions]), picked(key, "version", len(versions)) + 1)
        if name == "count_before":
            chosen = F.when(F.size(events) < 2, F.raise_error(F.lit("count_before needs two events")).cast("string")).otherwise(chosen)
        text = F.when(kind == name, chosen).otherwise(text)
    return F.concat(F.lit("<think>"), F.trim(text), F.lit("</think><answer>"), answer, F.lit("</answer>"))


def picked(key: Column, slot: Column | str, n: int) -> Column:
    """A number below n from the digest of key and slot."""
    digest = F.md5(F.concat_ws("_", key.cast("string"), F.lit(slot) if isinstance(slot, str) else slot))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % n).cast("int")


def tagged_segments(think: Column) -> Column:
    """Array of (seg, start, end, dur, before, after): only the first one has words before it, for what follows a tag is after it."""
    pattern = r"<seg>\s*[\d.]+\s*,\s*[\d.]+\s*</seg>"
    number = lambda s, k: F.regexp_extract(s, r"<seg>\s*([\d.]+)\s*,\s*([\d.]+)\s*</seg>", k).cast("double")
    found, between = F.regexp_extract_all(think, F.lit(pattern), F.lit(0)), F.split(think, pattern)
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    after = lambda i: strip(F.regexp_replace(strip(F.get(between, i + 1)), r"\s*\.\s*$", ""))
    return F.transform(found, lambda s, i: F.struct(
        s.alias("seg"), number(s, 1).alias("start"), number(s, 2).alias("end"), F.round(number(s, 2) - number(s, 1), 3).alias("dur"), F.when(i == 0, strip(F.get(between, F.lit(0)))).otherwise("").alias("before"), after(i).alias("after")))


def event_label(before: Column) -> Column:
    """The event that the words before a tag name: without verbs and fillers, eight words at most, with an article."""
    strip = lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), LABEL_EDGE, "")
    x = strip(before)
    for pattern in LABEL_TAILS:
        x = F.regexp_replace(x, f"(?i){pattern}", "")
    words = F.array_join(F.slice(F.split(F.regexp_replace(strip(x), r"^\s+|\s+$", ""), r"\s+"), 1, LABEL_WORDS), " ")
    return F.when(strip(x) == "", NO_LABEL).when(F.lower(words).startswith("the "), words).otherwise(F.concat(F.lit("the "), words))


def event_labels(segments: Column) -> Column:
    """Labels of all segments; where all of several are the same, they are numbered."""
    labels = F.transform(segments, lambda s: event_label(s["before"]))
    numbered = F.transform(labels, lambda _, i: F.concat(F.lit("the "), fmt.ordinal(i + 1), F.lit(" event")))
    return F.when((F.size(labels) > 1) & (F.size(F.array_distinct(labels)) == 1), numbered).otherwise(labels)


def n_words(x: Column) -> Column:
    return F.size(F.filter(F.split(x, r"\s+"), lambda w: w != ""))


def diversified(key: Column, parts: Sequence[Sequence[Column]], fallback: Column, extras: Sequence[str], least: int, most: int, attempts: int = 10) -> Column:
    """One of each of parts' versions, joined by blanks: the first of ``attempts`` seeded draws of ``least`` to ``most`` words.

    If no draw fits, the fallback with seeded extras behind it until it has ``least`` words.
    """
    draws = [F.concat_ws(" ", *[F.element_at(F.array(*versions), picked(key, f"{k}_{slot}", len(versions)) + 1) for slot, versions in enumerate(parts)]) for k in range(attempts)]
    fits = F.get(F.filter(F.array(*draws), lambda x: n_words(x).between(least, most)), F.lit(0))
    tail = lambda i: F.element_at(F.array(*map(F.lit, extras)), picked(key, F.concat(F.lit("pad_"), i.cast("string")), len(extras)) + 1)
    padded = F.aggregate(F.sequence(F.lit(1), F.lit(least)), fallback, lambda x, i: F.when(n_words(x) < least, F.concat_ws(" ", x, tail(i))).otherwise(x))
    return F.coalesce(fits, padded)


def reread(response: Column) -> tuple[Column, Column]:
    """(segments, answer) of a tagged response."""
    return tagged_segments(F.regexp_extract(response, tags.THINK, 1)), tags.answer(response)
