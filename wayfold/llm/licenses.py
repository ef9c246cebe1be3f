"""License scans in DataFrame functions only: fixed phrases, and an exact set-similarity join with templates.

The join finds every text block that holds at least THRESHOLD of a template's distinct words. A block is a line,
or, in the registered query, a run of WINDOW times as many words as the template has, wherever lines break, so
that wrapped notices are found and words scattered over a long line are not. Words are
ordered from rare to frequent over the whole table; a block and a template that share enough words must share
one among the first few of each (prefix filter), the block must be long enough (length filter), and what
remains behind the shared word must suffice (positional filter). Words that no template has match nothing; they
count as the rarest. What passes is verified by the exact intersection.

Licenses quote each other, so a template may be found in the text of another. In runs, `own_labels` leaves out a
template whose best run shares only words that the best run of another label's template shares too, with more, or
with no more but as a larger part of that template.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let
from .license_notices import NOTICES

#: Separators of words, phrases and their labels.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

#: What documents say of their license in a line, and labels.
SENTENCES = [
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license", "agpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("all rights reserved", "proprietary"),
]
#: Templates of the set-similarity join and their labels; `read_templates` takes others from a table.
TEMPLATES = SENTENCES + [(" ".join(re.split(SEPARATORS, text.lower())).strip(), label) for text, label in NOTICES]
THRESHOLD = 0.8
#: Templates whose index is broadcast, a few hundred bytes for each word of their prefixes; with more the join shuffles.
MOST_BROADCAST = 10_000
#: Distinct words of all templates, which the plan holds as a list; a table with more is refused.
MOST_WORDS = 20_000
WINDOW = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; a null text has none."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), lambda w: w != "")


def phrase_places(words: Column, phrases: list[tuple[str, str]] = PHRASES) -> Column:
    """array<struct<start, label>> of all places where a phrase's words stand consecutively, in order of start."""

    def at(w: Column, i: Column) -> Column:
        label = F.lit(None).cast("string")
        for phrase, name in phrases:
            same = None
            for k, part in enumerate(phrase.split()):
                here = F.get(w, i + k) == part
                same = here if same is None else same & here
            label = F.when(same, name).otherwise(label)
        return label

    none = F.array().cast("array<struct<start:int,label:string>>")
    lasts = F.array(*[F.lit(x) for x in sorted({p.split()[-1] for p, _ in phrases})])
    found = let(words, lambda w: F.filter(F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.named_struct(F.lit("start"), i, F.lit("label"), at(w, i))), lambda x: x["label"].isNotNull()))
    return F.when(F.arrays_overlap(words, lasts), found).otherwise(none)


def read_templates(table: DataFrame, text: str = "text", label: str = "label") -> list[tuple[str, str]]:
    """Templates for `scan` from a table of texts and labels, in order of label and text.

    Texts become their words. Rows of a null label or without words are left out, and repeated ones count once.
    ValueError if the texts have more than MOST_WORDS different words; only their number is read before that.
    """
    said, words = table.select(words_of(F.col(text)).alias("words"), F.col(label).alias("label")), F.array_join("words", " ")
    said = said.where((F.size("words") > 0) & F.col("label").isNotNull())
    if said.select(F.explode("words").alias("word")).distinct().count() > MOST_WORDS:
        raise ValueError(f"the templates have more than {MOST_WORDS} different words")
    return sorted(((r["text"], r["label"]) for r in said.select(words.alias("text"), "label").distinct().collect()), key=lambda x: (x[1], x[0]))


def _vocabulary(templates: list[tuple[str, str]]) -> list[str]:
    return sorted({w for text, _ in templates for w in text.split()})


def rare_to_frequent(docs: DataFrame, templates: list[tuple[str, str]], text: str = "text") -> list[str]:
    """The templates' words by the number of documents that have them, over the whole table; ties by word.

    Only counts of template words reach the driver; their number is fixed by the templates.
    """
    vocabulary = _vocabulary(templates)
    held = F.array_intersect(F.array(*[F.lit(w) for w in vocabulary]), words_of(F.col(text)))
    counts = {r["word"]: r["n"] for r in docs.select(F.explode(held).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def template_rows(order: list[str], templates: list[tuple[str, str]], threshold: float) -> list[tuple]:
    """A row of the index for each template and each word of its prefix."""
    rank, rows = {w: i for i, w in enumerate(order)}, []
    for number, (text, label) in enumerate(templates):
        words = sorted(set(text.split()), key=rank.__getitem__)
        least = math.ceil(threshold * len(words) - 1e-9)
        rows += [(w, number, label, j, len(words), least, words) for j, w in enumerate(words[: len(words) - least + 1])]
    return rows


INDEX = "word string, template int, label string, place int, size int, least int, words array<string>"


def _small(index: DataFrame, templates: list[tuple[str, str]]) -> DataFrame:
    """The index with a hint to broadcast it, if the templates are few enough."""
    return F.broadcast(index) if len(templates) <= MOST_BROADCAST else index


def _scan_windows(base: DataFrame, keep: list[str], row: str, words: str, index: DataFrame, order: list[str], reach: dict[str, int], window: int, templates: list[tuple[str, str]]) -> DataFrame:
    """`scan` with runs of words as blocks. A run that holds enough of a template holds one of its prefix words, so
    each place of a prefix word becomes a row with the words around it, as far as a run over that place can reach:
    `reach` has for each prefix word the longest run of a template that has it in its prefix."""
    near, hit_word, held, at, here, place, nth = (fresh(x, base.columns) for x in ("near_words", "hit_word", "held", "at", "here", "place", "nth"))
    prefix_words = F.array(*[F.lit(w) for w in reach])
    longest = F.create_map(*[F.lit(x) for pair in reach.items() for x in pair])
    w, none = F.col(words), F.array().cast("array<struct<word:string,place:int,at:int,near:array<string>>>")

    def around(i: Column) -> Column:
        def within(run: Column) -> Column:
            first = F.greatest(i - (run - 1), F.lit(0))
            return F.named_struct(F.lit("word"), F.get(w, i), F.lit("place"), i, F.lit("at"), i - first, F.lit("near"), F.slice(w, first + 1, i - first + run))

        return let(F.element_at(longest, F.get(w, i)), within)

    def places(held_words: Column) -> Column:
        return F.transform(F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.array_contains(held_words, F.get(w, i))), around)

    hits = F.when(F.arrays_overlap(w, prefix_words), let(F.array_intersect(w, prefix_words), places)).otherwise(none)
    found = base.select(*keep, row, F.size(w).cast("long").alias("n_words"), phrase_places(w).alias("places"), F.posexplode_outer(hits).alias(nth, here))
    found = found.select(*keep, row, "n_words", "places", nth, F.col(here)["word"].alias(hit_word), F.col(here)["place"].alias(place), F.col(here)["at"].alias(at), F.col(here)["near"].alias(near))
    index = index.select(*[F.col(c).alias(f"template_{c}") for c in index.columns])
    joined = found.join(_small(index, templates), F.col(hit_word) == F.col("template_word"), "left")
    # The row of a run's rarest shared word has all its other shared words behind that in the order.
    size, least, run = F.col("template_size"), F.col("template_least"), F.col("template_size") * window
    first = F.greatest(F.col(at) - (run - 1), F.lit(0))
    reach = F.slice(F.col(near), first + 1, F.col(at) - first + run)
    joined = joined.withColumn(near, F.when(F.col("template_word").isNotNull(), reach)).withColumn(at, F.col(at) - first)
    joined = joined.withColumn(held, F.array_intersect(F.array(*[F.lit(x) for x in order]), F.col(near)))
    behind = F.size(held) - F.array_position(held, F.col(hit_word)) + 1
    enough = (F.size(F.array_intersect(held, F.col("template_words"))) >= least) & (behind >= least)

    def share(start: Column) -> Column:
        return F.struct(F.size(F.array_intersect(F.slice(F.col(near), start + 1, run), F.col("template_words"))).alias("n"), (-start).alias("back"))

    best = F.when(enough, F.array_max(F.transform(F.sequence(F.lit(0), F.col(at)), share)))
    # The best run's count, place (the first of equals is the largest) and shared words.
    joined = joined.withColumn(here, F.when(best["n"] >= least, best))
    shared = F.array_intersect(F.slice(F.col(near), 1 - F.col(here)["back"], run), F.col("template_words"))
    joined = joined.withColumn(here, F.when(F.col(here).isNotNull(), F.struct(F.col(here)["n"].alias("n"), (F.col(here)["back"] - (F.col(place) - F.col(at))).alias("back"), shared.alias("words"))))
    # Of what found nothing a document needs one row only. One best run of each template is kept, however many it has.
    joined = joined.where(F.col(here).isNotNull() | F.col(nth).isNull() | (F.col(nth) == 0))
    names = [F.when(F.col(here).isNotNull(), F.col(c)).alias(c) for c in ("template_template", "template_label", "template_size")]
    each = joined.select(row, *keep, "n_words", "places", *names, here).groupBy(row, *keep, "n_words", "places", "template_template", "template_label", "template_size").agg(F.max(here).alias(here))
    kept = F.struct(F.col("template_label").alias("label"), (F.col(here)["n"] / F.col("template_size")).alias("share"), F.col(here)["words"].alias("words"))
    found = each.groupBy(row, *keep, "n_words", "places").agg(F.collect_list(F.when(F.col(here).isNotNull(), kept)).alias(here))

    def labels(of: Column) -> Column:
        return F.array_sort(F.array_distinct(F.transform(of, lambda x: x["label"])))

    def explained(x: Column) -> Column:
        def more(y: Column) -> Column:  # or as many, which are more of what it is
            return (F.size(y["words"]) > F.size(x["words"])) | ((F.size(y["words"]) == F.size(x["words"])) & (y["share"] > x["share"]))

        return F.exists(here, lambda y: (y["label"] != x["label"]) & more(y) & (F.size(F.array_except(x["words"], y["words"])) == 0))

    own = labels(F.filter(here, lambda x: ~explained(x))).alias("own_labels")
    containment = F.coalesce(F.array_max(F.transform(here, lambda x: x["share"])), F.lit(0.0)).alias("containment")
    return found.select(*keep, "n_words", "places", labels(F.col(here)).alias("template_labels"), own, containment)


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, text: str = "text", keep: list[str] | None = None, window: int | None = None) -> DataFrame:
    """The columns `keep` of each row (default: all but the text), with

    n_words, places (array of start and label of each phrase), template_labels (sorted distinct labels of the
    templates that some block contains to `threshold`) and containment (the highest such share, else 0).
    Blocks are lines, or with `window` the runs of `window` times a template's words, across lines; then own_labels
    follows: the labels without those of templates that another explains. A template's best run has most of its
    words, the first of equals; another label's template explains it whose best run shares all those words and more,
    or just those as a larger part of its own.
    Columns of these names are replaced. A null or empty text has no words and no finds. Each row stands for
    itself, so repeated rows and repeated ids stay apart. An empty table gives an empty result.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    keep = [c for c in keep if c.lower() not in ("n_words", "places", "template_labels", "own_labels", "containment")]
    order = rare_to_frequent(docs, templates, text)
    rows = template_rows(order, templates, threshold)
    index = docs.sparkSession.createDataFrame(rows, INDEX)
    sizes: dict[str, int] = {}
    for first, _, _, _, most, *_ in rows:
        sizes[first] = max(most, sizes.get(first, 0))
    row, words, block, held, size, at, word = (fresh(x, docs.columns) for x in ("row_key", "row_words", "block", "held", "block_size", "at", "found_word"))

    base = docs.select(*keep, F.col(text).alias(block), words_of(F.col(text)).alias(words), F.monotonically_increasing_id().alias(row))
    if window:
        return _scan_windows(base, keep, row, words, index, order, {w: n * window for w, n in sizes.items()}, window, templates)
    # Most documents have no prefix word and stay one row; of the others each line becomes one.
    may = F.arrays_overlap(words, F.array(*[F.lit(w) for w in sizes]))
    lines = base.select(*keep, row, F.size(words).cast("long").alias("n_words"), phrase_places(F.col(words)).alias("places"), F.explode(F.when(may, F.split(block, "\n")).otherwise(F.array(F.lit("")))).alias(block))
    in_line = F.array_distinct(words_of(F.col(block)))
    ordered = F.array(*[F.lit(w) for w in order])
    held_lines = lines.withColumn(words, in_line).withColumn(held, F.array_intersect(ordered, F.col(words))).withColumn(size, F.size(words)).drop(block, words)
    tokens = held_lines.select("*", F.posexplode_outer(held).alias(at, word))
    index = index.select(*[F.col(c).alias(f"template_{c}") for c in index.columns])
    place = F.col(size) - F.size(held) + F.col(at)  # words of no template stand first
    near = (F.col(word) == F.col("template_word")) & (F.col(size) >= F.col("template_least")) & (place <= F.col(size) - F.col("template_least")) & (1 + F.least(F.col(size) - place, F.col("template_size") - F.col("template_place")) - 1 >= F.col("template_least"))
    joined = tokens.join(_small(index, templates), near, "left")
    shared = F.size(F.array_intersect(F.col(held), F.col("template_words")))
    hit = F.when(shared >= F.col("template_least"), F.col("template_label"))
    share = F.when(shared >= F.col("template_least"), shared / F.col("template_size"))
    return (
        joined.groupBy(row, *keep, "n_words", "places")
        .agg(F.array_sort(F.collect_set(hit)).alias("template_labels"), F.coalesce(F.max(share), F.lit(0.0)).alias("containment"))
        .drop(row)
    )
