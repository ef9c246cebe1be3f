"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a boolean column over features of the text. A rule's cost and rejection rate are measured on a
sample; the cascade asks the rules in the order of rejections per cost, and a document leaves it at the first
rule that rejects it, so that the features of later rules are not computed for it. The order changes the time,
never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let, without, write_table

#: Fixed by the rules' definition: white space, counted symbols, window length, limits of the base rules.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30

#: Rows, about, on which costs and rejection rates are measured; how often a rule is asked on each, and how many
#: times its time is taken, of which the least counts.
SAMPLE_ROWS = 500
ASKED, TIMES = 8, 2


@dataclass(frozen=True)
class Rule:
    """`rejects` takes features by name and gives a boolean column, never null."""

    name: str
    rejects: Callable[[Callable[[str], Column]], Column]


BASE = [
    Rule("few_words", lambda c: c("n_words") < LEAST_WORDS),
    Rule("repeated_words", lambda c: c("n_repeat_words") * 100 > c("n_words") * MOST_REPEATED),
]
#: The cascade's own rules, beside the base rules. Limits leave ordinary prose of any language far behind.
RULES = [
    Rule("symbols", lambda c: c("n_symbols") * 10 > c("n_words") * 3),
    Rule("repeated_lines", lambda c: c("n_dup_lines") * 10 > c("n_lines") * 4),
    Rule("long_words", lambda c: c("word_chars") > c("n_words") * 20),
    Rule("same_word_runs", lambda c: let(c("words"), lambda w: _runs(w)) * 10 > c("n_words") * 3),
    Rule("few_letters", lambda c: F.size(F.filter(c("words"), lambda w: w.rlike(r"\p{L}"))) * 2 < c("n_words")),
]


def _runs(words: Column) -> Column:
    """Words that equal the word before them."""
    return F.size(F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: (i > 0) & (F.get(words, i) == F.get(words, i - 1))))


def _repeated(words: Column) -> Column:
    """Words inside windows of WINDOW words that stand in the text twice or more."""
    hashes = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])))

    def covered(windows: Column) -> Column:
        placed = F.array_sort(F.transform(windows, lambda x, i: F.struct(x.alias("hash"), i.alias("at"))))
        twice = let(placed, lambda s: F.filter(s, lambda x, i: (x["hash"] == F.get(s, i - 1)["hash"]) | (x["hash"] == F.get(s, i + 1)["hash"])))
        starts = F.sort_array(F.transform(twice, lambda x: x["at"]))
        step = lambda s: F.transform(s, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(s, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(let(starts, step), F.lit(0), lambda a, x: a + x)

    counted = let(hashes, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(covered(w)))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(counted)


#: Names of the counts, in order.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def _split(docs: DataFrame, text: str) -> tuple[DataFrame, dict[str, Column]]:
    """`docs` with the words and lines of the text in columns of fresh names, and every feature as an expression
    over them, which costs nothing where it is not asked for."""
    body, words, lines = (fresh(x, docs.columns) for x in ("body", "split_words", "split_lines"))
    out = docs.withColumn(body, F.coalesce(F.col(text), F.lit("")))
    out = out.withColumn(words, F.filter(F.split(body, SPACE), lambda w: w != ""))
    out = out.withColumn(lines, F.filter(F.split(body, "\n"), lambda x: x.rlike(NOT_SPACE)))
    counts = [F.size(words), F.length(F.array_join(words, "")), F.length(body) - F.length(F.regexp_replace(body, SYMBOLS, "")), F.size(lines) - F.size(F.array_distinct(lines)), _repeated(F.col(words)), F.size(lines)]
    return out, {k: v.cast("long") for k, v in zip(COUNTS, counts, strict=True)} | {"words": F.col(words)}


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (long) and words.

    Columns of these names are replaced. A null or empty text has no words and zeros. Rows are independent,
    so repeated rows and ties need nothing; a text of any length is one row and is read whole.
    """
    docs = without(docs, [*COUNTS, "words"])
    split, counts = _split(docs, text)
    return split.select(*docs.columns, *[v.alias(k) for k, v in counts.items()])


def base_failed(c: Callable[[str], Column]) -> Column:
    return BASE[0].rejects(c) | BASE[1].rejects(c)


def order_rules(docs: DataFrame, rules: list[Rule], text: str = "text", rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per cost on a random sample of about `rows` rows; ties keep the given order.

    A rule's cost is the time in which it is asked ASKED times on each row of the sample, less the time of a rule
    that needs no more than the text split into words and lines; so neither the start of a job nor what all rules
    share counts. The draw is row by row, and only drawn rows are moved. An empty sample gives the given order.
    """
    total = docs.count()
    if not total:
        return list(rules)
    drawn = docs.select(F.col(text).alias("text")).sample(min(1.0, rows / total), seed=7).repartition(8)
    sample = write_table(drawn, "quality-sample")
    n = sample.count()
    if not n:
        return list(rules)
    again = sample.withColumn("again", F.explode(F.array_repeat(F.lit(1), ASKED)))
    split, counts = _split(again, "text")

    def ask(rule: Rule) -> tuple[float, int]:
        took, rejected = [], 0
        for _ in range(TIMES):
            began = time.perf_counter()
            rejected = split.agg(F.count_if(rule.rejects(counts.__getitem__)), F.max(F.size(counts["words"]) + counts["n_lines"])).first()[0]
            took.append(time.perf_counter() - began)
        return min(took), rejected

    nothing, _ = ask(Rule("nothing", lambda c: F.lit(False)))
    score = []
    for rule in rules:
        took, rejected = ask(rule)
        score.append(rejected / (n * ASKED) / max(took - nothing, 1e-3))
    return [rule for _, rule in sorted(zip(score, rules, strict=True), key=lambda x: -x[0])]


def cascade(rules: list[Rule], c: Callable[[str], Column] = F.col) -> Column:
    """Name of the first rule that rejects, else null. Later rules are not computed."""
    out = None
    for rule in rules:
        hit = rule.rejects(c)
        out = F.when(hit, rule.name) if out is None else out.when(hit, rule.name)
    return F.lit(None).cast("string") if out is None else out


def judge(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text") -> DataFrame:
    """`docs` with the features, base_failed and kept.

    kept is false where a base rule or any other rule of the cascade rejects. Columns of these names are
    replaced. Nulls, empty texts and empty tables: see `features`.
    """
    ordered = order_rules(docs, [*BASE, *(RULES if rules is None else rules)], text)
    featured = features(without(docs, ["base_failed", "kept"]), text)
    return featured.withColumn("base_failed", base_failed(F.col)).withColumn("kept", cascade(ordered).isNull())


def keep_good(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns as they are, that no base rule and no other rule rejects.

    A document that a rule rejects is not asked further, and features that only later rules need are never made for
    it. The verdict is a generator with one row or none, as a filter would be pushed below the splitting of the text
    and split it anew for each feature.
    """
    ordered = order_rules(docs, [*BASE, *(RULES if rules is None else rules)], text)
    split, counts = _split(docs, text)
    one = F.when(cascade(ordered, counts.__getitem__).isNull(), F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    return split.select(*docs.columns, F.explode(one)).select(*docs.columns)
