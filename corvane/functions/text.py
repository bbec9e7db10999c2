"""Answer texts: extraction, normalisation, file names, prompts. Built-in expressions; see `udf` for the rest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a number, in both engines alike: no suffixes, no underscores.
NUMERIC = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: Fixed patterns of the answer formats.
LOOSE = r"[\-0-9,\.]+"
STRICT = r"-?[0-9][0-9,]*\.?[0-9]*"


def let(value: Column, f) -> Column:
    """f(value), with the value computed once however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group, or null."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def _last(text: Column, pattern: str, group: int) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1))


def numeric(s: Column) -> Column:
    """The double of a numeric string, else null."""
    return F.when(s.rlike(NUMERIC), s.try_cast("double"))


def _plain(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, "[,$%]", ""))


def whole_text(value: Column) -> Column:
    """The digits of a whole double under 1e38 without a sign, all of them exact: beyond 2^53 as three limbs of 52 bits."""
    limb = lambda x: F.floor(x).cast("decimal(38,0)")
    high, rest = F.floor(value / 2.0**104), value % 2.0**104
    parts = limb(high) * F.lit(str(1 << 104)).cast("decimal(38,0)") + limb(F.floor(rest / 2.0**52)) * F.lit(str(1 << 52)).cast("decimal(38,0)") + limb(rest % 2.0**52)
    return F.when(value < 2.0**53, value.cast("bigint").cast("string")).otherwise(parts.cast("string"))


def fixed6(value: Column) -> Column:
    """A double under 1e38 with six decimals, rounded on its exact binary value as C's printf does; null stays.

    Only the part behind the point is scaled. The product's own rounding error comes back by splitting the
    factor into halves that multiply without one, and decides where the rounded product is halfway.
    """

    def halves(g: Column) -> Column:
        wide = g * 134217729.0  # 2^27 + 1
        top = wide - (wide - g)
        p = g * 1e6
        low = F.floor(p).cast("double")
        lost = (g - top) * 1e6 - (p - top * 1e6)
        gap = p - low
        up = (gap > 0.5) | ((gap == 0.5) & ((lost > 0) | ((lost == 0) & (low % 2 == 1))))
        return low + up.cast("double")

    def text(v: Column) -> Column:
        size = F.abs(v)
        whole = F.when(size < 2.0**53, F.floor(size).cast("double")).otherwise(size)
        digits = let(halves(size - whole), lambda r: F.concat(whole_text(whole + (r == 1e6).cast("double")), F.lit("."), F.lpad((r % 1e6).cast("bigint").cast("string"), 6, "0")))
        return F.concat(F.when(v < 0, "-").otherwise(""), digits)

    return let(value, text)


def _number_text(s: Column, value: Column) -> Column:
    """Whole numbers without decimals, others with six; the string in lower case where there is no number."""
    whole = F.concat(F.when(value < 0, "-").otherwise(""), whole_text(F.abs(value)))
    return F.when(value.isNull(), F.lower(s)).when(value == F.rint(value), whole).otherwise(fixed6(value))


def normalize_bon(answer: Column) -> Column:
    """Without separators and signs of currency or percent: a canonical number, else lower case; empty is null."""
    text = lambda s: let(numeric(s), lambda v: _number_text(s, F.when(F.abs(v) < 1e37, v)))
    return let(answer, lambda a: F.when(F.trim(a) != "", let(_plain(a), text)))


def normalize_generator(answer: Column) -> Column:
    """As `normalize_bon`, but huge numbers stay text, an empty string stays, and null is "none"."""
    return let(_plain(F.coalesce(answer, F.lit("none"))), lambda s: let(numeric(s), lambda v: _number_text(s, F.when(F.abs(v) <= 1e15, v))))


def normalize_guided(answer: Column) -> Column:
    """Commas dropped; numbers cut to their whole part; other strings unchanged."""
    cut = lambda s: let(numeric(s), lambda v: F.when(F.abs(v) < 1e37, F.concat(F.when(v <= -1, "-").otherwise(""), whole_text(F.abs(v - v % 1)))).otherwise(s))
    return let(F.regexp_replace(F.trim(answer), ",", ""), cut)


def extract_bon(filtered: Column, response: Column) -> Column:
    """The filtered response unless it is invalid; else the first #### number, else the last run of number signs."""
    ok = F.trim(filtered)
    raw = F.coalesce(_found(response, rf"####\s*({LOOSE})"), _last(response, f"({LOOSE})", 1))
    return normalize_bon(F.when(~ok.isin("[invalid]", ""), filtered).otherwise(raw))


def extract_generator(text: Column) -> Column:
    """First ####, then "answer is", then a boxed number, then the last number with a digit; null without."""
    raw = F.coalesce(
        _found(text, rf"####\s*({LOOSE})"),
        _found(text, rf"(?i)answer\s+is:?\s*({LOOSE})"),
        _found(text, rf"\\boxed\{{({LOOSE})\}}"),
        _last(text, f"({STRICT})", 1),
    )
    return let(raw, lambda r: F.when(r.isNotNull(), normalize_generator(r)))


def extract_guided(text: Column) -> Column:
    """Last #### number, then the last number; commas dropped."""
    return F.regexp_replace(F.coalesce(_last(text, rf"####\s*({STRICT})", 1), _last(text, f"({STRICT})", 1)), ",", "")


def extract_boxed_flat(text: Column) -> Column:
    """The last boxed expression of one level of nesting, else what follows "answer is" up to a full stop or line end."""
    boxed = _last(text, r"\\boxed\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}", 1)
    return F.trim(F.coalesce(boxed, _found(text, r"(?i)answer\s+is[:\s]*(.+?)(?:\.|$)")))


def file_config(name: Column) -> list[Column]:
    """temp, alg_temp, top_p, seed and tag of a result file's name, with the defaults .2, 0 and .95."""
    stem = F.regexp_replace(F.regexp_extract(name, r"([^/]*)$", 1), r"\.[^.]*$", "")
    number = lambda p: F.regexp_replace(_found(stem, p), r"\.$", "").try_cast("double")
    return [
        F.coalesce(number(r"_temp([0-9.]+)"), F.lit(0.2)).alias("temp"),
        F.coalesce(number(r"_at([0-9.]+)"), F.lit(0.0)).alias("alg_temp"),
        F.coalesce(number(r"_tp([0-9.]+)"), F.lit(0.95)).alias("top_p"),
        _found(stem, r"_seed([0-9]+)").try_cast("bigint").alias("seed"),
        _found(stem, r"_bon_(c[0-9]+)").alias("tag"),
    ]


def parse_methods(raw: str) -> list[str]:
    """The methods named, in canonical order, with the two baselines always among them."""
    known = ["majority", "oracle", "prm", "orm"]
    asked = {x.strip() for x in raw.split(",") if x.strip()}
    if asked - set(known):
        raise ValueError(f"unknown methods: {sorted(asked - set(known))}")
    return [m for m in known if m in asked or m in ("majority", "oracle")]


def few_shot_prompt(question: Column, shots: list[tuple[str, str]]) -> Column:
    """Questions and answers, blank lines between them, and the question without one."""
    parts = [F.lit(f"Question: {q}\nAnswer: {a}") for q, a in shots]
    return F.concat_ws("\n\n", *parts, F.concat(F.lit("Question: "), question, F.lit("\nAnswer:")))


def boxed_prompt(question: Column) -> Column:
    """The question and the request to box the answer, without examples."""
    return F.concat(F.lit("Question: "), question, F.lit("\nPut the final answer in \\boxed{}.\nAnswer:"))


#: What a task's name begins with, longest first, and the task that it belongs to.
TASKS = (("math500", "math"), ("math", "math"), ("gsm8k", "gsm8k"))


def base_task(name: Column) -> Column:
    """The task that a name begins with, in any case; another name stays as it is."""
    out = name
    for prefix, task in reversed(TASKS):
        out = F.when(F.lower(name).startswith(prefix), F.lit(task)).otherwise(out)
    return out


def brief(text: Column, most: int = 100) -> Column:
    """The first `most` characters."""
    return F.substring(text, 1, most)


def seconds(value: Column) -> Column:
    """Seconds to a tenth."""
    return F.round(value, 1)


def of_configuration(name: Column, part: str, temperature: float, tolerance: float = 1e-3) -> Column:
    """Does a result file's name hold `part`, and is its temperature the given one?"""
    temp = file_config(name)[0]
    return name.contains(part) & (F.abs(temp - temperature) <= tolerance)


def first_metric(metrics: Column, names: list[str]) -> Column:
    """The value of the first of the names that a map of metrics has."""
    return F.coalesce(*[F.try_element_at(metrics, F.lit(n)) for n in names])


def utc_now() -> Column:
    """The moment of the query in UTC, ISO 8601 to the second."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def chat_messages(system: str, question: Column) -> Column:
    """JSON of a system and a user message."""
    return F.to_json(F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), question.alias("content"))))


def conclusion(two_pass: Column, both: Column) -> Column:
    gap = both - two_pass
    return F.when(gap.isNull(), "n/a").otherwise(F.concat(F.when(gap < 0.02, "recovers").otherwise("fails to recover"), F.format_string(" (gap=%+.3f)", gap)))


def safe_message(message: Column) -> Column:
    """One line of 300 characters at most."""
    return F.substring(F.regexp_replace(message, r"[\r\n]", " "), 1, 300)
