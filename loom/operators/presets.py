"""Per-dataset preprocessors: small maps, filters and flat-maps from a dataset's columns to messages.

Each takes a DataFrame with the dataset's columns and adds or replaces columns, or drops rows.  The
prompts are fixed values of the datasets' conventions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loom.operators import messages as M

C = F.col


def _pair(query: Column, response: Column) -> Column:
    return M.from_parts(F.lit(None).cast("string"), query, response)


def stripped_prefix(df: DataFrame, column: str, prefix: str) -> DataFrame:
    return df.withColumn(column, F.when(C(column).startswith(prefix), F.trim(C(column).substr(F.lit(len(prefix) + 1), F.length(column)))).otherwise(C(column)))


def numbered_title(df: DataFrame) -> DataFrame:
    """title, with a differing abstract after it; of a numbered one what follows the number; empty ones go."""
    title = F.when(F.coalesce("abs", F.lit("")).isin("") | (C("abs") == C("title")), C("title")).otherwise(F.concat_ws("，", "title", "abs"))
    short = F.regexp_extract(title, r"\d+[.,\s、](.+)", 1)
    return df.withColumn("response", F.when(short != "", short).otherwise(title)).where(C("response") != "")


def without_default_system(messages: Column, default: str = "You are a helpful assistant.") -> Column:
    first = F.get(messages, F.lit(0))
    return F.when((first["role"] == "system") & (first["content"] == default), F.slice(messages, 2, F.size(messages))).otherwise(messages)


def mentions(messages: Column, pattern: str = "moss|human:|assistant:|user:") -> Column:
    return F.exists(messages, lambda m: F.lower(m["content"]).rlike(pattern))


def several_plugins(system: Column) -> Column:
    return F.size(F.array_distinct(F.regexp_extract_all(system, F.lit(r'\d\. \{"plugin_name": "(.+?)"'), F.lit(1)))) > 1


def text_to_sql(df: DataFrame) -> DataFrame:
    q = F.format_string("Sql Table information:\n%s\n%s", "sql_context", "sql_prompt")
    return df.withColumn("messages", _pair(q, F.format_string("Let's think step by step:\n%s\nSo the final sql is:\n%s", "sql_explanation", "sql")))


def with_answer(df: DataFrame) -> DataFrame:
    return df.withColumn("messages", _pair(C("query"), F.format_string("%s\n\nAnswer: %s", "output", "answer")))


def chapters(df: DataFrame, columns: list[str]) -> DataFrame:
    """A response of type, title, the chapters that are not null, and the text."""
    return df.withColumn("response", F.concat(F.format_string("%s\n%s\n", "type", "title"), F.concat_ws("", *columns), "response"))


def at_fence(df: DataFrame, fence: str = "```python") -> DataFrame:
    """A problem before the first fenced block, the code and an explanation after it."""
    at = F.instr("code_with_problem", fence)
    problem = F.regexp_replace(C("code_with_problem").substr(F.lit(1), at - 1), "^# ", "")
    code = F.trim(C("code_with_problem").substr(at, F.length("code_with_problem")))
    return df.withColumn("messages", _pair(problem, F.concat_ws("\n\n", code, "explanation_only")))


def similarity(df: DataFrame, least: float | None = None) -> DataFrame:
    return df if least is None else df.where(C("score") >= least)


def similarity_prompt(df: DataFrame) -> DataFrame:
    q = F.format_string("Task: Based on the given two sentences, provide a similarity score between 0.0 and 1.0.\nSentence 1: %s\nSentence 2: %s\nSimilarity score: ", "sentence1", "sentence2")
    return df.withColumn("messages", _pair(q, F.format_string("%.1f", "score")))


def repaired_json(x: Column) -> Column:
    """Missing commas between objects on lines."""
    return F.replace(x, F.lit("}\n {"), F.lit("},\n {"))


def folded_chat(df: DataFrame, rules: str) -> DataFrame:
    """Chat-room turns folded into the system text; the last turn is the response. Rows without query or response go."""
    m = C("messages")
    first, last = F.get(m, F.lit(0)), F.element_at(m, -1)["content"]
    query = F.when(first["role"] == "user", first["content"]).otherwise("")
    turns = F.array_join(F.transform(F.slice(m, 2, F.greatest(F.size(m) - 2, F.lit(0))), lambda t: F.concat(F.lit("\n "), t["role"], F.lit(":"), t["content"])), "")
    system = F.when(first["role"] == "system", first["content"]).otherwise("")
    told = F.when((system != "") & ~system.contains("【注意事项】"), F.concat(system, F.lit(rules))).otherwise(system)
    text = F.when((first["role"] == "user") | system.contains("next_speakers:"), system).otherwise(F.concat(told, F.lit("\n\n【chat history】"), turns))
    return df.withColumn("system", text).withColumn("query", query).withColumn("response", last).where((C("query") != "") & (C("response") != ""))


def human_or_not(df: DataFrame, seed: int, labels: bool = False) -> DataFrame:
    """Two rows per question, each with one seeded answer of either origin."""
    pick = lambda c, k: F.get(C(c), F.pmod(F.xxhash64(F.lit(seed + k), "query"), F.size(c)).cast("int"))
    ask = lambda a: F.concat(F.lit("Classification Task: Are the following responses from a human or from ChatGPT?\nQuestion: "), C("query"), F.lit("\nAnswer: "), a, F.lit("\nCategory: Human, ChatGPT\nOutput:"))
    rows = F.array(*[F.struct(ask(pick(c, k)).alias("query"), (F.lit(k) if labels else F.lit(name)).alias("label" if labels else "response")) for k, (name, c) in enumerate((("Human", "human_answers"), ("ChatGPT", "chatgpt_answers")))])
    return df.select(F.explode(rows).alias("r")).select("r.*")


def question_generation(df: DataFrame) -> DataFrame:
    two = F.split("text1", r"\[SEP\]")
    return df.withColumn("messages", _pair(F.concat(F.lit("Task: Question Generation\nContext: "), two[1], F.lit("\nAnswer: "), two[0], F.lit("\nQuestion:")), C("text2")))


def transcripts(df: DataFrame, chosen: str = "chosen", other: str = "rejected") -> DataFrame:
    marks = "\n\nHuman:|\n\nAssistant:|\n\nHum:|^Human:"
    return df.withColumn("messages", M.speakers(C(chosen), marks)).withColumn("rejected_messages", M.speakers(C(other), marks))


def tool_calls(x: Column, schema: str = "array<struct<name:string,arguments:map<string,string>>>") -> Column:
    return F.transform(F.from_json(x, schema), lambda t: M.message("tool_call", F.to_json(t)))


def one_of(x: Column, key: Column, seed: int) -> Column:
    return F.get(x, F.pmod(F.xxhash64(F.lit(seed), key), F.size(x)).cast("int"))


def plain_emoji(x: Column) -> Column:
    return F.replace(x, F.lit("️"), F.lit(""))


def delimited(df: DataFrame) -> DataFrame:
    """Turns between User: and Assistant: marks; they must alternate and be filled, else the row goes."""
    marks = "User:|User：|Assistant：|Assistant:|Asssistent:|Assistent:|Assistenz:"
    who = F.regexp_extract_all("instruction", F.lit(f"({marks})"), F.lit(1))
    said = F.transform(F.slice(F.split("instruction", marks), 2, 1 << 30), lambda x: F.trim(x))
    turns = F.arrays_zip(who.alias("who"), said.alias("said"))
    ok = F.forall(F.transform(turns, lambda t, i: (t["said"] != "") & F.when(i % 2 == 0, t["who"].startswith("User")).otherwise(t["who"].startswith("Ass"))), lambda b: b) & (F.size(turns) % 2 == 0)
    past = F.transform(turns, lambda t, i: M.message(F.when(i % 2 == 0, "user").otherwise("assistant"), t["said"]))
    return df.where(ok).withColumn("messages", F.concat(past, F.array(M.message("user", F.trim(F.regexp_replace("input", "^User:", ""))), M.message("assistant", C("output")))))


def described_tools(df: DataFrame) -> DataFrame:
    rest = M.without_system(C("messages"))["messages"]
    return df.withColumn("tools", F.when(F.coalesce("function_description", F.lit("")) != "", F.split("function_description", "\n\n"))).withColumn("messages", rest)


def with_context(df: DataFrame) -> DataFrame:
    given = F.when(F.coalesce("context", F.lit("")) != "", F.concat(F.lit("Here gives some useful information:\n"), C("context"), F.lit("\n"))).otherwise("")
    return df.withColumn("messages", _pair(F.concat(given, "instruction"), C("response")))


def without_source(df: DataFrame, source: str = "toxic-dpo-v0.2") -> DataFrame:
    return df.where(F.coalesce(C("source") != source, F.lit(True)))


def named(df: DataFrame, names: dict[str, tuple[str, str]], suffix: str = "", prefix: str = "") -> DataFrame:
    """Placeholders {{KEY}} filled by the row's tag (zh: first, else second value)."""
    for c in ("query", "response"):
        for key, (zh, en) in names.items():
            df = df.withColumn(c, F.replace(C(c), F.lit("{{" + key.upper() + "}}"), F.when(C("tag") == "zh", zh).otherwise(en)))
    return df.withColumn("query", F.concat("query", F.lit(suffix))).withColumn("response", F.concat(F.lit(prefix), "response"))


def templated(df: DataFrame, template: str, tag: str = "{{QUERY}}") -> DataFrame:
    return df.withColumn("query", F.replace(F.lit(template), F.lit(tag), C("query")))


def classified(df: DataFrame, labels: list[str], task: str, pair: bool = False) -> DataFrame:
    """A prompt that names the categories, and the label's name; rows without a label go."""
    given = F.format_string("Sentence1: %s\nSentence2: %s", "sentence1", "sentence2") if pair else F.format_string("Sentence: %s", "sentence")
    ask = F.concat(F.lit(f"Task: {task}\n"), given, F.lit(f"\nCategory: {', '.join(labels)}\nOutput:"))
    return df.where("label IS NOT NULL").withColumn("query", ask).withColumn("response", F.get(F.array(*map(F.lit, labels)), C("label").cast("int")))


def grounding_prompt(key: Column, english: list[str], chinese: list[str], seed: int) -> Column:
    """A seeded prompt: English for four of five keys."""
    return F.when(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(5)) < 4, one_of(F.array(*map(F.lit, english)), key, seed + 1)).otherwise(one_of(F.array(*map(F.lit, chinese)), key, seed + 2))


def existing(df: DataFrame, path: Column, files: DataFrame) -> DataFrame:
    """Rows whose file is in a listing (column path)."""
    return df.withColumn("_p", path).join(files.select(C("path").alias("_p")).distinct(), "_p", "left_semi").drop("_p")


def rewritten_path(x: Column, prefixes: dict[str, str]) -> Column:
    out = x
    for old, new in prefixes.items():
        out = F.when(x.startswith(old), F.concat(F.lit(new), x.substr(F.lit(len(old) + 1), F.length(x)))).otherwise(out)
    return out


def option_letter(index: Column) -> Column:
    return F.char(F.lit(65) + index.cast("int"))


def spans_overlap(spans: Column) -> Column:
    """Whether sorted (start, end) spans overlap."""
    s = F.array_sort(spans)
    pairs = F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: b["start"] < a["end"])
    return F.exists(pairs, lambda x: F.coalesce(x, F.lit(False)))


def spliced(text: Column, spans: Column, tag: str = "<ref-object><bbox>") -> Column:
    """Spans of a text replaced by a tag."""
    out = F.aggregate(F.array_sort(spans), F.struct(F.lit("").alias("t"), F.lit(0).alias("at")), lambda a, s: F.struct(F.concat(a["t"], text.substr(a["at"] + 1, s["start"] - a["at"]), F.lit(tag)).alias("t"), s["end"].alias("at")))
    return F.concat(out["t"], text.substr(out["at"] + 1, F.length(text)))


def cleaned_title(x: Column) -> Column:
    """ [title] as a period, bracketed remarks away, one pass over double blanks."""
    x = F.replace(F.trim(x), F.lit(" [title]"), F.lit(". "))
    return F.replace(F.regexp_replace(x, r"\[.*?\]", ""), F.lit("  "), F.lit(" "))


def final_answer(x: Column) -> Column:
    """The number after ####, without commas; a text without is an error."""
    found = F.regexp_extract(x, r"#### (-?[0-9.,]+)", 1)
    return F.when(found != "", F.replace(found, F.lit(","), F.lit(""))).otherwise(F.raise_error(F.lit("no final answer")).cast("string"))


def shuffled_options(options: Column, key: Column, seed: int) -> Column:
    """Struct of options in a seeded order and the letter of the first given one."""
    mixed = F.array_sort(F.transform(options, lambda o, i: F.struct(F.md5(F.concat_ws("_", F.lit(str(seed)), key.cast("string"), i.cast("string"))).alias("h"), i.alias("i"), o.alias("o"))))
    at = F.array_position(F.transform(mixed, lambda m: m["i"]), 0) - 1
    return F.struct(F.transform(mixed, lambda m: m["o"]).alias("options"), option_letter(at).alias("gold"))


def dated(df: DataFrame, column: str, low: str, high: str) -> DataFrame:
    """Dates as text compare as text."""
    return df.where((C(column) >= low) & (C(column) < high))


# --- fixed values: the prompts of the knights and knaves set
KNIGHTS_PROMPTS = {
    "base": """The user asks a question, and the Assistant solves it.The assistant first thinks about the reasoning process in the mind and then provides the user with the final answer. The reasoning process and answer are enclosed within <think> </think> and <answer> </answer> tags, respectively, i.e., <think> reasoning process here </think><answer> answer here </answer>. Now the user asks you to solve a logical reasoning problem. After thinking, when you finally reach a conclusion, clearly state the identity of each character within <answer> </answer> tags. List the identity of each person one by one, for example, <answer> (1) Zoey is a knight\n(2) Oliver is a knight\n(3)... </answer>.\n\nUser:{quiz}\nAssistant: <think>""",
    "qwen-instruct": """<|im_start|>system\nYou are a helpful assistant. The assistant first thinks about the reasoning process in the mind and then provides the user with the answer. The reasoning process and answer are enclosed within <think> </think> and<answer> </answer> tags, respectively, i.e., <think> reasoning process here </think><answer> answer here </answer>.  Now the user asks you to solve a logical reasoning problem. After thinking, when you finally reach a conclusion, clearly state the identity of each character within <answer> </answer> tags. i.e., <answer> (1) Zoey is a knight\n(2) ... </answer>.\n<|im_end|>\n<|im_start|>user\n{quiz}\n<|im_end|>\n<|im_start|>assistant\n<think>""",
}
# ---


def knights_prompt(quiz: Column, template: str) -> Column:
    """The quiz in the prompt of a template."""
    before, after = KNIGHTS_PROMPTS[template].split("{quiz}")
    return F.concat(F.lit(before), quiz, F.lit(after))


def query_and_response(df: DataFrame) -> DataFrame:
    return df.select("query", "response")


def with_files(df: DataFrame, path: str, files: DataFrame) -> DataFrame:
    """Rows whose path is among the files' names (column path); rows without one go. A semi-join with a listing, no look at a disk per row."""
    return df.where(F.coalesce(F.col(path), F.lit("")) != "").join(files.select(F.col("path").alias("_path")), F.col(path) == F.col("_path"), "left_semi")
