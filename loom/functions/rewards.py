"""Rule scorers of responses, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loom.functions import tags

zero = lambda: F.lit(0.0)


def score_format(response: Column) -> Column:
    return F.when(tags.has_think(response), 0.25).otherwise(0.0) + F.when(tags.has_answer(response), 0.25).otherwise(0.0)


def violations(response: Column) -> Column:
    """Segments whose next character that is no blank is upper-case or opens a tag."""
    return F.size(F.filter(F.slice(F.split(response, "</seg>"), 2, 1 << 30), lambda x: x.rlike(r"^\s*(\p{Lu}|<)")))


def score_consistency(response: Column, positive: bool = False) -> Column:
    penalty = F.least(F.round(violations(response) * 0.1, 1), F.lit(0.5))
    return F.lit(0.5) - penalty if positive else -penalty


def correct(response: Column, gold: Column) -> Column:
    found = tags.answer(response)
    return (F.coalesce(gold, F.lit("")) != "") & (found != "") & (tags.normalised_answer(found) == tags.normalised_answer(F.coalesce(gold, F.lit(""))))


def answerable(response: Column, gold: Column) -> Column:
    return (F.coalesce(gold, F.lit("")) != "") & (tags.answer(response) != "")


def score_accuracy(response: Column, gold: Column, logprob: Column | None = None) -> Column:
    """Half for a right answer; with a mean log-probability, weighted by confidence, and negative for a wrong one."""
    right = correct(response, gold)
    plain = F.when(right, 0.5).otherwise(0.0)
    if logprob is None:
        return plain
    c = F.least(F.lit(1.0), F.greatest(zero(), F.exp(logprob)))
    weighted = F.when(right, (1 - (c - 1) * (c - 1)) * 0.5).otherwise(c * c * -0.5)
    return F.when(~answerable(response, gold), 0.0).when(logprob.isNull(), plain).otherwise(weighted)


def score_segment(response: Column, gold: Column) -> Column:
    return F.when(correct(response, gold) & (tags.n_segments(response) > 0), 0.5).otherwise(0.0)


def total(response: Column, gold: Column, logprob: Column | None = None) -> Column:
    """Struct of the components, their sum, and the sum to four places."""
    parts = {"format": score_format(response), "consistency": score_consistency(response), "accuracy": score_accuracy(response, gold, logprob), "segment": score_segment(response, gold)}
    whole = sum(parts.values(), zero())
    return F.struct(*[c.alias(k) for k, c in parts.items()], whole.alias("total"), F.round(whole, 4).alias("rollout_total"))


# --- fixed values: the immediate-follow segment pattern of the audio QA scorer
FOLLOWED = r"<seg>([\d.]+,\s*[\d.]+)</seg>(.?)[^<]?"
# ---


def audio_qa(response: Column, gold: Column, experiment: str) -> Column:
    """Struct of the scores of an experiment: which parts count, and how much segments give."""
    spans = F.regexp_extract_all(response, F.lit(FOLLOWED), F.lit(1))
    pairs = F.array_sort(F.transform(spans, lambda x: F.struct(F.split(F.replace(x, F.lit(" ")), ",")[0].cast("double").alias("s"), F.split(F.replace(x, F.lit(" ")), ",")[1].cast("double").alias("e"))))
    n = F.size(pairs)
    length = F.aggregate(pairs, zero(), lambda t, p: t + p["e"] - p["s"])
    start = F.struct(zero().alias("reach"), zero().alias("n"), F.lit(True).alias("first"))
    # where a span begins beyond the reach it counts whole, else what it adds
    merged = F.aggregate(pairs, start, lambda t, p: F.struct(
        F.when(t["first"] | (p["s"] > t["reach"]), p["e"]).otherwise(F.greatest(t["reach"], p["e"])).alias("reach"),
        (t["n"] + F.when(t["first"] | (p["s"] > t["reach"]), p["e"] - p["s"]).otherwise(F.greatest(p["e"] - t["reach"], zero()))).alias("n"), F.lit(False).alias("first")), lambda t: t["n"])
    follow = F.size(F.filter(F.regexp_extract_all(response, F.lit(FOLLOWED), F.lit(2)), lambda x: x.rlike(r"^(\p{Lu}|<)")))
    once = (F.size(F.regexp_extract_all(response, F.lit(tags.THINK), F.lit(0))) == 1) & (F.size(tags.answers(response)) == 1)
    form = F.when(once, 0.5).otherwise(0.0)
    acc = F.when(once & (tags.answer(response) == gold), 0.5).otherwise(0.0)
    cap = {"11": 2, "12": 3}.get(experiment)
    tool = F.when(acc <= 0, 0.0).otherwise(acc * F.least(n, F.lit(cap)) / cap if cap else F.when(n > 0, acc).otherwise(0.0))
    consistency = -F.least(follow, F.lit(5)) / 10
    apart = F.when(length > 0, merged * 0.5 / length).otherwise(0.0)
    used = {"1": (form, acc, consistency), "2": (form, acc, tool), "3": (form, acc, tool, consistency), "6": (form, acc, tool, consistency), "11": (form, acc, tool, consistency, apart), "12": (form, acc, tool, consistency, apart)}.get(experiment, (form, acc))
    return F.struct(sum(used, zero()).alias("score"), acc.alias("acc_score"), form.alias("format_score"), n.alias("seg_count"), tool.alias("tool_score"), consistency.alias("consistency_score"), apart.alias("non_overlap_score"))


def final_number(text: Column, strict: bool = True) -> Column:
    """The number after ####, without commas; or the last number that is no period. Null where there is none."""
    if strict:
        return F.replace(F.nullif(F.regexp_extract(text, r"#### (-?[0-9.,]+)", 1), F.lit("")), F.lit(","), F.lit(""))
    found = F.regexp_extract_all(text, F.lit(r"-?[0-9.,]+"), F.lit(0))
    return F.try_element_at(F.coalesce(F.nullif(F.filter(found, lambda x: x != "."), F.array().cast("array<string>")), found), F.lit(-1))


def matches(found: Column, gold: Column, score: float = 1.0, other: float = 0.0) -> Column:
    return F.when(found.isNull(), 0.0).when(found == gold, score).otherwise(other)


def exact_match(response: Column, golds: Column, part: bool = False) -> Column:
    """1 if the last answer equals (or holds) a gold answer, both normalised; a quarter if tags are spammed."""
    last = F.try_element_at(tags.answers(response), F.lit(-1))
    said = tags.qa_normalised(last)
    hit = F.exists(golds, lambda g: said.contains(tags.qa_normalised(g)) if part else tags.qa_normalised(g) == said)
    spam = (F.size(F.split(response, "<answer>")) > 11) | (F.size(F.split(response, "</answer>")) > 11)
    return F.when(last.isNull() | ~hit, 0.0).otherwise(F.lit(1.0) if part else F.when(spam, 0.25).otherwise(1.0))


def whole_format(response: Column) -> Column:
    return F.when(response.rlike(r"(?s)^<think>.*?</think>\s*<answer>.*?</answer>\z"), 1.0).otherwise(0.0)


def react_format(response: Column) -> Column:
    return F.when(response.rlike(r"(?s)^<think>.*?</think>\s*Action:.*?Action Input:.*$"), 1.0).otherwise(0.0)


def cosine_length(length: Column, right: Column, most: int = 1000, wrong: tuple[float, float] = (-0.5, 0.0), correct: tuple[float, float] = (1.0, 0.5)) -> Column:
    """From the value at length 0 to that at ``most`` along half a cosine."""
    low = F.when(right, correct[1]).otherwise(wrong[1])
    high = F.when(right, correct[0]).otherwise(wrong[0])
    return high - (high - low) * (1 - F.cos(length * F.lit(3.141592653589793) / most)) / 2


def repetition_penalty(text: Column, n: int = 3, most: float = -1.0) -> Column:
    """The share of repeated n-grams of blank-separated lower-case words, times ``most``."""

    def penalty(words: Column) -> Column:
        count = F.size(words) - (n - 1)
        grams = F.slice(words, F.lit(1), F.greatest(count, F.lit(0)))
        for k in range(1, n):
            grams = F.zip_with(grams, F.slice(words, F.lit(k + 1), F.greatest(count, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
        return F.when(count < 1, 0.0).otherwise((F.lit(1.0) - F.size(F.array_distinct(grams)) / count) * most)

    # the words are a variable of their own, for an expression used at each place would be computed there
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    return F.get(F.transform(F.array(words), penalty), F.lit(0))


def soft_overlong(length: Column, most: int, cache: int) -> Column:
    return F.least(-(length - (most - cache)) / cache, F.lit(0.0))


def knights(response: Column, roles: Column) -> Column:
    """1 for exactly one answer block in order, else -1; plus 2, -1.5 or -2 for right, wrong and unreadable roles.

    roles: array of (name, role).
    """
    count = lambda tag: F.size(F.split(response, tag)) - 1
    ok = (count("<answer>") == 1) & (count("</answer>") == 1) & (F.instr(response, "<answer>") <= F.instr(response, "</answer>"))
    said = tags.answer(response, -1)
    named = F.size(F.split(F.lower(said), "knight|knave")) - 1
    role = lambda r: F.lower(F.call_function("regexp_extract", said, F.concat(F.lit(r"(?i)\b"), r["name"], F.lit(r"\b\s+is\s+a\s+\b(knight|knave)\b")), F.lit(1)))
    read = F.transform(roles, lambda r: F.struct(role(r).alias("said"), r["role"].alias("true")))
    parsed = (named == F.size(roles)) & F.forall(read, lambda r: r["said"] != "")
    answer = F.when(~ok | (said == "") | ~parsed, -2.0).when(F.forall(read, lambda r: r["said"] == r["true"]), 2.0).otherwise(-1.5)
    return F.when(ok, 1.0).otherwise(-1.0) + answer


def verdict(response: Column, gold: Column) -> Column:
    """Of answers that begin with a yes or no line and an analysis: form 1 or -1, plus 2, -1.5 or -2."""
    pattern = r"(?m)^([是否])\s*\n*(.*)"
    said = F.regexp_extract(response, pattern, 1)
    ok = (said != "") & (tags.strip(F.regexp_extract(response, pattern, 2)) != "")
    return F.when(ok, F.lit(1.0) + F.when(said == gold, 2.0).otherwise(-1.5)).otherwise(-3.0)


def verdict_f1(response: Column, gold: Column) -> Column:
    """1 only where both first lines say yes."""
    first = lambda x: tags.strip(F.split(x, "\n")[0])
    return F.when((first(response) == "是") & (first(gold) == "是"), 1.0).otherwise(0.0)


def token_match(prediction: Column, answer: Column, choices: Column) -> Column:
    """The answer's words are all said, and no word that only wrong choices have."""
    words = lambda x: F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(r"\b\w+\b"), F.lit(0)))
    said, gold = words(prediction), words(answer)
    wrong = F.array_except(F.flatten(F.transform(F.filter(choices, lambda c: c != answer), words)), gold)
    return (F.size(said) > 0) & (F.size(F.array_except(gold, said)) == 0) & ~F.arrays_overlap(wrong, said)


def first_contained(response: Column, choices: Column) -> Column:
    """The first choice that the response holds, else the first choice, else empty."""
    return F.coalesce(F.get(F.filter(choices, lambda c: response.contains(c)), F.lit(0)), F.get(choices, F.lit(0)), F.lit(""))


def dispatched(source: Column, scorers: dict[str, Column]) -> Column:
    """The scorer of the row's source; an unknown source is an error."""
    out = F.raise_error(F.concat(F.lit("no scorer for "), source)).cast("double")
    for name, score in scorers.items():
        out = F.when(source == name, score).otherwise(out)
    return out
