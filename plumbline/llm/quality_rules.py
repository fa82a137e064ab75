"""Quality rules: a threshold table compiled into one projection of native expressions.

Defined cases: a null or empty text has no words and fails the base rule; texts of fewer than five words have no
five-word windows; ties don't occur (each row is judged alone); repeated rows are judged alike; an empty table gives an
empty table. Columns of the input are kept, but for those named like a column that is made, which give way; working columns
carry a leading ``_q_`` and are dropped again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words

#: Frequent function words of the four languages (fixed list, lower case).
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she "
    "der die und das von zu mit sich des auf ist im dem nicht ein eine als auch es den für "
    "le la les de et des un une du que qui dans en pour est pas sur au il ce avec par "
    "el los las y del se por con no una su para lo como más al"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a row only if least <= metric <= most; a null metric (nothing to divide by) passes."""

    name: str
    metric: str
    least: float | None = None
    most: float | None = None


#: Production thresholds.
RULES = (
    Rule("words", "n_words", 10, None),
    Rule("word_length", "mean_word_chars", 2.0, 15.0),
    Rule("symbols", "symbol_ratio", None, 0.3),
    Rule("stop_words", "stop_ratio", 0.06, None),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.5),
    Rule("upper_case", "upper_ratio", None, 0.4),
    Rule("exclamations", "exclamation_ratio", None, 0.3),
)


def _covered(grams: Column, width: int) -> Column:
    """Positions covered by windows of `width` whose hash is found twice or more in grams."""

    def of_sorted(st: Column) -> Column:
        near = lambda x, j: F.coalesce(x["h"] == F.get(st, j - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(st, j + 1)["h"], F.lit(False))
        starts = F.array_sort(F.transform(F.filter(st, near), lambda x: x["i"]))
        gap = lambda ix: F.aggregate(
            F.transform(ix, lambda i, j: F.least(F.lit(width), F.coalesce(F.get(ix, j + 1) - i, F.lit(width)))), F.lit(0), lambda a, x: a + x
        )
        return let(starts, gap)

    pairs = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), let(pairs, of_sorted)).otherwise(F.lit(0))


def _grams(w: Column, width: int) -> Column:
    """64-bit hashes of all windows of `width` words."""
    at = lambda i: F.xxhash64(*[F.get(w, i + k if k else i) for k in range(width)])
    return F.when(F.size(w) >= width, F.transform(F.sequence(F.lit(0), F.size(w) - width), at)).otherwise(F.array().cast("array<bigint>"))


def quality_metrics(docs: DataFrame, text: str = "text", prefix: str = "", keep_text: bool = True, extra=None) -> DataFrame:
    """docs with the metrics that rules name, each called prefix + its name. extra: more metrics of words and text, as
    (words, text) -> columns by name; with it come n_lines and n_stop, too.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words count as the contract of op1 says; windows are compared by
    64-bit hashes within one text. Ratios are null where their divisor is 0, the stop-word ratio also
    for fewer than 20 words.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    forms = sorted({f for s in STOP_WORDS for f in (s, s.capitalize(), s.upper())})
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    kept = [c for c in docs.columns if keep_text or c != text]
    df = docs.select(*[F.col(f"`{c}`") for c in kept], t.alias("_q_t"), words(F.col(text)).alias("_q_w"), lines.alias("_q_l"))
    more = extra(F.col("_q_w"), F.col("_q_t")) if extra else {}
    df = df.select(
        *[F.col(f"`{c}`") for c in kept],
        F.size("_q_w").cast("long").alias("_q_n_words"),
        F.length(F.array_join("_q_w", "")).cast("long").alias("_q_word_chars"),
        F.length(F.regexp_replace("_q_t", r"[^#*$%&|<>]+", "")).cast("long").alias("_q_n_symbols"),
        F.size("_q_l").cast("long").alias("_q_n_lines"),
        (F.size("_q_l") - F.size(F.array_distinct("_q_l"))).cast("long").alias("_q_n_dup_lines"),
        F.size(F.filter("_q_w", lambda x: x.isin(forms))).cast("long").alias("_q_n_stop"),
        F.length(F.regexp_replace("_q_t", r"[^A-Z]+", "")).cast("long").alias("_q_n_upper"),
        F.length(F.regexp_replace("_q_t", r"[^!]+", "")).cast("long").alias("_q_n_exclamations"),
        _grams(F.col("_q_w"), 5).alias("_q_g"),
        *[c.alias("_q_x_" + k) for k, c in more.items()],
    )
    n, of = F.col("_q_n_words"), lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    made = {
        "n_words": n,
        "word_chars": F.col("_q_word_chars"),
        "n_symbols": F.col("_q_n_symbols"),
        "n_dup_lines": F.col("_q_n_dup_lines"),
        "n_repeat_words": _covered(F.col("_q_g"), 5).cast("long"),
        "mean_word_chars": of("_q_word_chars", "_q_n_words"),
        "symbol_ratio": of("_q_n_symbols", "_q_n_words"),
        "stop_ratio": F.when(n >= 20, of("_q_n_stop", "_q_n_words")),
        "dup_line_ratio": of("_q_n_dup_lines", "_q_n_lines"),
        "upper_ratio": of("_q_n_upper", "_q_word_chars"),
        "exclamation_ratio": of("_q_n_exclamations", "_q_n_words"),
    }
    if extra:
        made |= {"n_lines": F.col("_q_n_lines"), "n_stop": F.col("_q_n_stop")} | {k: F.col("_q_x_" + k) for k in more}
    return df.select(*[F.col(f"`{c}`") for c in kept], *[c.alias(prefix + k) for k, c in made.items()])


def compile_rules(rules=RULES, prefix: str = "") -> Column:
    """One Boolean expression: every rule of the table holds."""
    out = F.lit(True)
    for r in rules:
        m = F.col(prefix + r.metric)
        if r.least is not None:
            out &= F.coalesce(m >= F.lit(float(r.least)), F.lit(True))
        if r.most is not None:
            out &= F.coalesce(m <= F.lit(float(r.most)), F.lit(True))
    return out


def base_failed(prefix: str = "") -> Column:
    n = F.col(prefix + "n_words")
    return (n < 10) | (100 * F.col(prefix + "n_repeat_words") > 20 * n)


def _held(verdict: Column) -> Column:
    """verdict, which no filter above can be pushed below: else Catalyst writes the metrics' expressions into the filter, nested
    and repeated, and evaluates them anew for each use."""
    return verdict & (F.monotonically_increasing_id() >= 0)


def judge(docs: DataFrame, text: str = "text", rules=RULES, keep_text: bool = True) -> DataFrame:
    """docs with metrics, base_failed and kept; columns of docs with these names give way."""
    df = quality_metrics(docs, text, prefix="_q_m_", keep_text=keep_text).withColumn("_q_m_base_failed", base_failed("_q_m_"))
    df = df.withColumn("_q_m_kept", _held(~F.col("_q_m_base_failed") & compile_rules(rules, "_q_m_")))
    made = {c: c.removeprefix("_q_m_") for c in df.columns if c.startswith("_q_m_")}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in made and c not in made.values()], *[F.col(c).alias(k) for c, k in made.items()])


def filter_quality(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs."""
    df = quality_metrics(docs, text, prefix="_q_m_")
    df = df.withColumn("_q_kept", _held(~base_failed("_q_m_") & compile_rules(rules, "_q_m_")))
    return df.filter("_q_kept").select(*[F.col(f"`{c}`") for c in docs.columns])
