"""Each operator against a plain version of its contract, on the small tables and on awkward rows."""

import base64
import hashlib
import random
import re
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from wayfold.llm import bpe, chat, decontam, langid, licenses, queries, quality, rollup, similar, simhash, token_files, warc
from wayfold.llm.common import new_path, write_table
from wayfold.llm.license_notices import NOTICES

SF = "/root/testdata/sf0.001"
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "src0", 0),
    (3, "   \n\t \x0b\n", "en", None, 7),
    (4, "the same line here\nthe same line here\n" * 30, "en", "src0", 1140),
    (4, "the same line here\nthe same line here\n" * 30, "en", "src0", 1140),
    (5, "Ünïcödé wörds, 中文 and 😀 " * 500, "de", "src1", 12000),
    (None, "no id but some text of a few words and more of them to make it long enough to be kept by rules", "en", "src1", 90),
    (6, "\x00ctrl \x1c\x85 odd space  two   three", "fr", "src2", 30),
    (7, "x" * 200_000, None, "src0", 200_000),
    (8, "MIT License\nReleased under the MIT License.\nApache\n\nLicense, GNU General Public License! cc-by x", "en", "src0", 80),
]


@pytest.fixture(scope="module")
def docs(spark):
    odd = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    return write_table(odd.unionByName(spark.read.parquet(f"{SF}/documents.parquet").where("doc_id > 8")), "test-docs")


@pytest.fixture(scope="module")
def table(docs, spark, tmp_path_factory):
    """A folder of tables with the awkward documents, as a query reads them."""
    folder = str(tmp_path_factory.mktemp("sf"))
    docs.withColumn("n_tokens", F.lit(1)).withColumn("extra", F.lit("x")).write.parquet(f"{folder}/documents.parquet")
    for name in ("benchmark", "pages", "conversations", "labels", "embeddings"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "benchmark", "pages", "conversations", "labels", "embeddings"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return folder


def texts(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_op1(spark, table, docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for doc_id, text in texts(docs):
        ids = library.encode_ordinary(text)
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        want.append((doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert rows(queries.op1_byte_bpe(spark, table), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)


def test_bpe_is_exact_on_random_texts():
    ranks = bpe.load_ranks(queries.RANKS)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder = bpe.Encoder(ranks, bpe.halves_of(ranks), P.PATTERN)
    draw = random.Random(3)
    for _ in range(3000):
        text = "".join(draw.choice("abcdehinorst  \n\t.,'sé ü中😀\x1c\x85#1") for _ in range(draw.randint(0, 40)))
        got = encoder.encode(text)
        assert [int.from_bytes(got[i : i + 4], "little") for i in range(0, len(got), 4)] == library.encode_ordinary(text), text


def test_op2(spark, table, docs):
    want = []
    for doc_id, text in texts(docs):
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = defaultdict(list)
        for i in range(len(w) - 7):
            windows[tuple(w[i : i + 8])].append(i)
        covered = {k for at in windows.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        dup = len(lines) - len(set(lines))
        symbols = len(re.findall(r"[#*$%&|<>]", text))
        base = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        runs = sum(a == b for a, b in zip(w, w[1:]))
        letters = sum(any(ch.isalpha() for ch in x) for x in w)
        chars = sum(map(len, w))
        rejected = symbols * 10 > len(w) * 3 or dup * 10 > len(lines) * 4 or chars > 20 * len(w) or runs * 10 > 3 * len(w) or letters * 2 < len(w)
        want.append((doc_id, len(w), chars, symbols, dup, len(covered), base, not base and not rejected))
    got = queries.op2_quality_rules(spark, table)
    assert rows(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept") == sorted(want, key=str)


def test_cascade_order_never_changes_the_verdict(docs):
    f = quality.features(docs)
    every = [*quality.BASE, *quality.RULES]
    ways = [f.select("doc_id", quality.cascade(r).isNull().alias("kept")) for r in (every, every[::-1])]
    assert rows(ways[0], "doc_id", "kept") == rows(ways[1], "doc_id", "kept")


def test_kept_documents_are_those_that_the_verdict_keeps(docs):
    want = quality.judge(docs).where("kept").select(*docs.columns)
    assert rows(quality.keep_good(docs), *docs.columns) == rows(want, *docs.columns)


def test_a_dear_rule_of_equal_rejection_is_asked_last(spark):
    df = spark.range(400).select(F.concat_ws(" ", F.array_repeat(F.concat(F.lit("w"), F.col("id")), 40)).alias("text"))
    dear = F.aggregate(F.sequence(F.lit(0), F.lit(20_000)), F.lit(0).cast("long"), lambda s, x: s + F.pmod(F.xxhash64(x), F.lit(7)))
    rules = [quality.Rule("dear", lambda c: (dear + c("n_words")) > 0), quality.Rule("cheap", lambda c: c("n_words") > 0)]
    assert [r.name for r in quality.order_rules(df, rules)] == ["cheap", "dear"]


def test_op3_is_accurate_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op3_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_op3_learns_from_no_held_out_row(spark, docs):
    spoiled = docs.withColumn("lang", F.when(langid.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    assert "xx" not in langid.train(spoiled).languages


def test_ngrams_do_not_depend_on_pieces(monkeypatch):
    import numpy as np

    text = "Ein  Text, mit   Lücken - und Wörtern 😀 an jeder Stelle. " * 5
    want = np.sort(np.concatenate(list(langid.ngrams(text))))
    for piece in (1, 2, 3, 7, 50):
        monkeypatch.setattr(langid, "PIECE", piece)
        assert np.array_equal(np.sort(np.concatenate(list(langid.ngrams(text)))), want)


def test_rare_and_many_languages_are_learned(spark):
    rows_in = [(i, f"{'aeiou'[i % 5] * 3}{chr(97 + i % 20) * 4} " * 12, f"l{i % 20:02}") for i in range(800)] + [(9000 + i, "zzzz qqqq xxxx " * 9, "rare") for i in range(6)]
    df = spark.createDataFrame(rows_in, "doc_id long, text string, lang string")
    model = langid.train(df)
    assert model.languages == sorted({r[2] for r in rows_in}) and model.predict("zzzz qqqq xxxx zzzz")[0] == "rare"
    few = langid.train(df, sample_rows=10)  # fewer rows than languages: those that are drawn
    assert 0 < len(few.languages) <= 21 and set(few.languages) <= set(model.languages)


def test_op3_odd_rows(spark, table):
    got = {r["doc_id"]: r for r in queries.op3_language_id(spark, table).collect()}
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (1, 2, 3))


def license_places(words):
    out = []
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        out += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return sorted(out)


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))


def test_op4(spark, table, docs):
    want = []
    for doc_id, text in texts(docs):
        w = alnum_words(text)
        places = license_places(w)
        found, best = [], 0.0
        for template, label in licenses.TEMPLATES:
            t = set(template.split())
            most = max((t & set(alnum_words(line)) for line in text.split("\n")), key=len)
            if len(most) / len(t) >= licenses.THRESHOLD:
                found.append((label, most, len(most) / len(t)))
                best = max(best, len(most) / len(t))
        labels = {x[1] for x in places} | {x for x, held, part in found if not any(x != y and (held < more or (held == more and part < larger)) for y, more, larger in found)}
        starts = [x[0] for x in places]
        want.append((doc_id, len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x[1] for x in places})), ",".join(sorted(labels)), 1.0 if places else best))
    got = queries.op4_license_scan(spark, table)
    assert rows(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score") == sorted(want, key=str)
    assert any(x[7] > 0 for x in want)


def test_containment_join_finds_all_that_brute_force_finds(spark):
    draw = random.Random(5)
    vocabulary = "abcdefghij"
    templates = [(" ".join(draw.sample(vocabulary, n)), f"t{i}") for i, n in enumerate((3, 5, 5, 8, 10))]
    lines = ["\n".join(" ".join(draw.choice(vocabulary + "xyz") for _ in range(draw.randint(0, 12))) for _ in range(draw.randint(1, 4))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    for threshold in (0.5, 0.8, 1.0):
        want = sorted((i, sorted({n for t, n in templates for x in text.split("\n") if len(set(t.split()) & set(x.split())) >= threshold * len(set(t.split())) - 1e-9})) for i, text in enumerate(lines))
        got = sorted((r["doc_id"], r["template_labels"]) for r in licenses.scan(df, templates, threshold).collect())
        assert got == want


MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files (the Software)"
BSD = "Redistribution and use in source and binary\nforms, with or without modification,\nare permitted"
MPL = " * This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy"
GPL = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License"


def test_op4_finds_wrapped_notices_and_no_scattered_words(spark, tmp_path):
    filler = " ".join(f"word{i}" for i in range(3000))
    texts = [MIT, BSD, MPL, GPL, f"{filler}\n{BSD}\n{filler}", f"all {filler} rights {filler} reserved", "All rights\nreserved."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["labels"] for r in queries.op4_license_scan(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(7)] == ["mit", "bsd", "mpl-2.0", "gpl", "bsd", "", "proprietary"]


def test_op4_finds_whole_notices_in_comments_and_no_halves(spark, tmp_path):
    def wrapped(text, width=9):
        words = text.split()
        return "\n".join(" * " + " ".join(words[i : i + width]) for i in range(0, len(words), width))

    filler = " ".join(f"word{i}" for i in range(2000))
    half = [" ".join(text.split()[len(text.split()) // 2 :]) for text, label in NOTICES if label in ("isc", "zlib", "unlicense")]
    without_year = [f"{filler}\n/*\n * Copyright 2001 Nobody\n{wrapped(text)}\n */\n{filler}" for text, _ in NOTICES]
    documents = without_year + half
    spark.createDataFrame(list(enumerate(documents)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op4_license_scan(spark, str(tmp_path)).collect()}
    for i, (_, label) in enumerate(NOTICES):
        assert label in got[i]["labels"].split(","), label
        assert got[i]["score"] == 1.0
        assert got[i]["labels"] == label if label not in ("apache-2.0", "gpl") else "lgpl" not in got[i]["labels"], label
    assert [got[len(NOTICES) + i]["labels"] for i in range(len(half))] == [""] * len(half)


def test_op4_labels_of_a_license_quoted_in_another(spark, tmp_path):
    notice = {label: text for text, label in NOTICES}
    texts = [notice["bsl-1.0"], f"{notice['bsl-1.0']}\n{MIT}", notice["lgpl"], f"{notice['lgpl']}\n\n{notice['gpl']}", notice["agpl"], f"{notice['bsl-1.0']} " * 3]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in licenses.scan(docs, window=licenses.WINDOW).collect()}
    assert "mit" in got[0]["template_labels"] and "gpl" in got[2]["template_labels"]
    assert [got[i]["own_labels"] for i in range(6)] == [["bsl-1.0"], ["bsl-1.0", "mit"], ["lgpl"], ["gpl", "lgpl"], ["agpl"], ["bsl-1.0"]]


def test_license_templates_from_a_table(spark, monkeypatch):
    table = spark.createDataFrame([("The Fine, license", "fine"), ("the fine  LICENSE", "fine"), (None, "x"), ("...", "x"), ("a b", None), ("b c", "bc")], "text string, label string")
    assert licenses.read_templates(table) == [("b c", "bc"), ("the fine license", "fine")]
    assert licenses.read_templates(table.limit(0)) == []
    docs = spark.createDataFrame([(1, "under the\nfine license"), (2, None), (3, "c a b")], "doc_id long, text string")
    for templates in (licenses.read_templates(table), []):
        got = sorted((r["doc_id"], r["own_labels"]) for r in licenses.scan(docs, templates, window=2).collect())
        assert got == [(1, ["fine"] if templates else []), (2, []), (3, ["bc"] if templates else [])]
    monkeypatch.setattr(licenses, "MOST_WORDS", 4)
    with pytest.raises(ValueError, match="more than 4"):
        licenses.read_templates(table)


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_windows_find_all_that_brute_force_finds(spark, threshold):
    draw = random.Random(6)
    vocabulary = "abcdefghij"
    templates = [(" ".join(draw.sample(vocabulary, n)), f"t{i}") for i, n in enumerate((3, 5, 5, 8, 10))]
    texts = [" ".join(draw.choice(vocabulary + "uvwxyz" * 2) + draw.choice(("", "\n")) for _ in range(draw.randint(0, 60))) for _ in range(200)]
    want = []
    for i, text in enumerate(texts):
        w, best = text.split(), {}
        for t, name in templates:
            t = set(t.split())
            most = max((len(t & set(w[k : k + 2 * len(t)])) for k in range(len(w))), default=0) / len(t)
            if most >= threshold - 1e-9:
                best[name] = most
        want.append((i, sorted(best), max(best.values(), default=0.0)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r["doc_id"], r["template_labels"], r["containment"]) for r in licenses.scan(df, templates, threshold, window=2).collect())
    assert got == want


def brute_hits(words, items, window):
    hit, found = set(), set()
    for item, w in items:
        n = min(window, len(w))
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(item)
    return hit, found


def test_op5(spark, table, docs):
    items = [(str(r["item_id"]), alnum_words(r["text"] or "")) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = []
    for doc_id, text in texts(docs):
        w = alnum_words(text)
        hit, found = brute_hits(w, items, 10) if len(w) < 20_000 else (set(), set())
        want.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    got = queries.op5_decontaminate(spark, table)
    assert rows(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(want, key=str)


@pytest.mark.parametrize("block", [5, 1000])
def test_automaton_against_brute_force(spark, block):
    draw = random.Random(block)
    text = lambda n: " ".join(draw.choice("abc") for _ in range(n))
    items = [(i, text(draw.choice([0, 1, 2, 3, 4, 5, 9, 12]))) for i in range(12)] + [(3, "c c c c c c"), (None, None)]
    lines = [(i, text(draw.randint(0, 25))) for i in range(60)]
    bench, df = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(lines, "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontam.find_contamination(df, bench, window=4, block_words=block).withColumn("n", decontam.hit_words()).collect()}
    known = [("" if i is None else str(i), (t or "").split()) for i, t in items]
    for doc_id, t in lines:
        hit, found = brute_hits(t.split(), known, 4)
        assert (got[doc_id]["n"], got[doc_id]["items"]) == (len(hit), sorted(found)), t
        assert {k for s in got[doc_id]["spans"] for k in range(s["start"], s["end"])} == hit


@pytest.mark.parametrize("block", [3, 1000])
def test_removal_cuts_passages_and_keeps_the_rest(spark, block):
    item = "one two three four five six seven eight nine ten eleven"
    clean = "Nothing, of the kind; here!\n"
    df = spark.createDataFrame([(1, f"Before, {item.upper()}! After it come {'more ' * 20}", "en"), (2, clean, "en"), (3, item, "en"), (4, None, "en")], "doc_id long, text string, spans string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: r["text"] for r in decontam.remove_contamination(df, bench, block_words=block).collect()}
    assert got == {1: f"Before, ! After it come {'more ' * 20}", 2: clean, 4: None}


def test_blocks_of_items_are_searched_side_by_side(spark, docs):
    bench = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(20))) for i in range(60)], "item_id long, text string")
    found = decontam.find_contamination(docs, bench, block_words=150)
    plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(x) - len(x.lstrip(" :+-*()0123456789")) for x in plan if "MapInArrow" in x]
    assert len(depth) > 5 and len(set(depth)) == 1  # none stands below another


def test_op6(spark):
    big, small = "é" * 900, "small"
    pages = [(1, "http://a/", big), (2, "http://b/\r\nX: y", big), (3, None, small), (4, "http://c", small), (5, "u", None), (None, "n", "x" * 1500), (9, "d", big + "!"), (9, "d", big + "!")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    sha = lambda x: hashlib.sha1(x.encode()).hexdigest()
    want = [(1, 1800, sha(big), "revisit", 2), (2, 1800, sha(big), "response", None), (3, 5, sha(small), "response", None), (4, 5, sha(small), "response", None), (5, 0, sha(""), "response", None), (None, 1500, sha("x" * 1500), "response", None)] + [(9, 1801, sha(big + "!"), "response", None)] * 2
    assert rows(warc.round_trip(df), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=str)


def test_normaliser_reads_monolithic_streams_and_its_index_finds_each_record():
    import gzip
    import io

    import pyarrow as pa

    many = [warc.record_bytes(i, "u", b"body\r\n\r\n" * i, "0", None, "d") for i in range(50)]
    for packed in (gzip.compress(b"".join(many)), b"".join(map(gzip.compress, many))):
        assert list(warc.records(warc.inflate(pa.PythonFile(io.BytesIO(packed), mode="r")))) == many


def test_inflate_is_bounded_and_refuses_what_is_cut_off():
    import gzip
    import io

    import pyarrow as pa

    read = lambda packed: list(warc.inflate(pa.PythonFile(io.BytesIO(packed), mode="r")))
    bomb = gzip.compress(b"\0" * (5 * warc.PIECE + 3))
    assert max(map(len, read(bomb))) <= warc.PIECE and sum(map(len, read(bomb + bomb))) == 2 * (5 * warc.PIECE + 3)
    for cut in (1, 5, 8, len(bomb) // 2):
        with pytest.raises(ValueError):
            read(bomb[:-cut])


def test_op7(spark, table):
    by = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        by[r["conv_id"]].append((r["role"], r["text"] or ""))
    by[-7] = [("user", queries.CONTROL), ("assistant", queries.CONTROL)]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(c, len(t), sha("".join(f"{a}\n{b}\n" for a, b in t)), sum(len(b) for a, b in t if a == "assistant"), sha("".join(b for a, b in t if a == "assistant"))) for c, t in by.items()]
    assert rows(queries.op7_chat_format(spark, table), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == sorted(want, key=str)


def test_chat_odd_rows(spark):
    odd = [(1, 0, "us>er\n<", "a</turn>\n<turn x>\n"), (1, 1, "assistant", "\n\\<\\\\"), (1, 2, "assistant", ""), (1, None, None, None), (None, 0, "assistant", "\n</turn>\n")]
    got = {r["conv_id"]: r for r in chat.format_conversations(spark.createDataFrame(odd, "conv_id long, turn long, role string, text string")).collect()}
    assert chat.parse_turns(got[1]["formatted"]) == [("", ""), ("us>er\n<", "a</turn>\n<turn x>\n"), ("assistant", "\n\\<\\\\"), ("assistant", "")]
    mask = [chat.unescape(got[1]["formatted"][s["start"] : s["end"]]) for s in got[1]["loss"]]
    assert mask == ["\n\\<\\\\", ""] and not got[1]["rewrites_history"]
    assert got[1]["spans"][-1]["end"] == len(got[1]["formatted"])


def test_chat_detects_rewritten_history():
    trims = lambda turns: "".join(f"[{r}]{t if i == len(turns) - 1 else t[:2]}" for i, (r, t) in enumerate(turns))
    assert chat.locate(trims, [("user", "long text"), ("assistant", "x")]).turns is None
    assert chat.locate(chat.turn_template, [("user", "long text"), ("assistant", "x")]).turns is not None


def brute_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = sorted(parent)
    for i, a in enumerate(known):
        for b in known[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    return {f: root(f) for f in fps}


def test_op8(spark, table, docs):
    fps = [(i, brute_fingerprint(t)) for i, t in texts(docs)]
    comp = brute_components([f for _, f in fps])
    least = {}
    for i, f in fps:
        if i is not None:
            least[comp[f]] = min(i, least.get(comp[f], i))
    want = [(i, f"{f:016x}", least.get(comp[f])) for i, f in fps]
    assert rows(queries.op8_simhash(spark, table), "doc_id", "fingerprint", "component_id") == sorted(want, key=str)


@pytest.mark.parametrize("cell", [4096, 8])
def test_links_connect_all_that_brute_force_connects(spark, monkeypatch, cell):
    """With small cells as with large ones, which are split again and again."""
    monkeypatch.setattr(simhash, "CELL", cell)
    draw = random.Random(9)
    fps = set()
    for _ in range(12):
        centre = draw.getrandbits(64)
        for _ in range(20):
            x = centre
            for b in draw.sample(range(64), draw.randint(0, 4)):
                x ^= 1 << b
            fps.add(x)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"))
    got = {r["node"] % (1 << 64): r["label"] for r in simhash.components(edges).collect()}
    want = brute_components(list(fps))
    groups = lambda m: sorted(sorted(v) for v in _by(m).values() if len(v) > 1)
    assert groups(got) == groups(want)


def test_cells_of_equal_counts_are_split_by_bits(spark, monkeypatch):
    """Fingerprints of one bit in each segment have equal counts throughout, so no grid of counts parts them."""
    monkeypatch.setattr(simhash, "CELL", 8)
    draw = random.Random(4)
    word = lambda picks: sum(1 << (2 * i + b) for i, b in enumerate(picks))
    centres = [[draw.randint(0, 1) for _ in range(32)] for _ in range(6)]
    fps = {word(c) for c in centres}
    for c in centres:
        for i in draw.sample(range(32), 5):
            fps.add(word([b ^ (k == i) for k, b in enumerate(c)]))
    edges = simhash.links(spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long"))
    got = {r["node"] % (1 << 64): r["label"] for r in simhash.components(edges).collect()}
    groups = lambda m: sorted(sorted(v) for v in _by(m).values() if len(v) > 1)
    assert groups(got) == groups(brute_components(list(fps))) and groups(got)


def _by(m):
    out = defaultdict(list)
    for k, v in m.items():
        out[v].append(k)
    return out


def test_components_of_a_chain_in_random_order(spark):
    numbers = random.Random(8).sample(range(1000), 120)
    edges = spark.createDataFrame(list(zip(numbers, numbers[1:])), "a long, b long")
    assert {r["node"]: r["label"] for r in simhash.components(edges).collect()} == {x: min(numbers) for x in numbers}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["label"] for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100}


def test_keep_one_each(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows_in = [(3, text, "a"), (5, text, "b"), (5, text, "b"), (None, text, "c"), (9, "quite another text", "d"), (None, "text without an id", "e")]
    got = simhash.keep_one_each(spark.createDataFrame(rows_in, "doc_id long, text string, kept_id string"))
    assert rows(got, "doc_id", "kept_id") == [(3, "a"), (9, "d"), (None, "e")]
    twice = [(3, text, "b"), (3, text, "a"), (3, text, "a"), (4, text, "c"), (9, "quite another text", "d")]
    got = simhash.keep_one_each(spark.createDataFrame(twice, "doc_id long, text string, kept_id string"))
    assert rows(got, "doc_id", "kept_id") == [(3, "a"), (9, "d")]


def test_op9(spark, table, docs):
    library = Tokenizer.from_file(queries.DEFINITION)
    start, want = 0, []
    for doc_id, text in sorted(texts(docs), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        want.append((doc_id, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    assert rows(queries.op9_token_files(spark, table), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=str)


def test_op9_gives_added_tokens_as_the_library_does(spark):
    library = Tokenizer.from_file(queries.DEFINITION)
    odd = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y<|endoftext|>", "<|endoftext| >", "plain words, and <|endoftext|>\n\nmore", "<|endoftext|><|endoftext|> "]
    got = token_files.round_trip(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), queries.DEFINITION)
    ids = [[*library.encode(x, add_special_tokens=False).ids, 0] for x in odd]
    assert len(ids[0]) == 5 and 50256 in ids[0]
    assert rows(got, "doc_id", "n_tokens", "ids_crc32") == [(i, len(x), zlib.crc32(b"".join(n.to_bytes(4, "little") for n in x))) for i, x in enumerate(ids)]


def test_sequences_are_equal_and_padding_is_masked(tmp_path):
    import numpy as np
    import pyarrow as pa

    path = str(tmp_path / "x.arrow")
    with pa.OSFile(path, "wb") as sink:
        out = token_files.SequenceWriter(sink, np.dtype("<u2"), 8)
        out.add(np.arange(8 * token_files.BATCH + 13, dtype="<u2"))
        out.close()
    got = pa.ipc.open_file(pa.memory_map(path)).read_all()
    assert got["ids"].type == pa.list_(pa.uint16(), 8) and len(got) == token_files.BATCH + 2
    assert sum(sum(x) for x in got["mask"].to_pylist()) == 8 * token_files.BATCH + 13
    assert token_files.SequenceFile(f"file://{path}").tokens(2000, 61).tolist() == list(range(2000, 2061))


@pytest.mark.parametrize("change", [{"add_prefix_space": True}, {"use_regex": False}, {"normalizer": {"type": "Lowercase"}}])
def test_op9_encodes_whole_texts_for_other_definitions(spark, docs, tmp_path, change):
    """A definition that is not split at spaces in the usual way gives what the library gives."""
    import json

    definition = json.load(open(queries.DEFINITION))
    (key, value), = change.items()
    (definition if key == "normalizer" else definition["pre_tokenizer"])[key] = value
    path = f"{tmp_path}/other.json"
    json.dump(definition, open(path, "w"))
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    some = docs.where("length(text) < 3000 or text is null")
    want = [(i, len(library.encode(t, add_special_tokens=False).ids) + 1) for i, t in texts(some)]
    assert not token_files.splits_at_spaces(open(path).read())
    assert rows(token_files.round_trip(some, path), "doc_id", "n_tokens") == sorted(want, key=str)


def test_op10(spark, table, docs):
    ranks = {k: {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(v, "rb"))} for k, v in queries.VERSIONS.items()}
    old, new = (tiktoken.Encoding(k, pat_str=P.PATTERN, mergeable_ranks=r, special_tokens={}) for k, r in ranks.items())
    want = defaultdict(lambda: [0, 0])
    for r in docs.collect():
        a, b = (len(e.encode_ordinary(r["text"] or "")) for e in (old, new))
        if b >= 20:
            for name, n in ((old.name, a + 1), (new.name, b)):
                total = want[r["source"], r["lang"], name]
                total[0], total[1] = total[0] + 1, total[1] + n
    got = rows(queries.op10_token_rollup(spark, table), "source", "lang", "tokenizer", "n_docs", "n_tokens")
    assert got == sorted(((*k, *v) for k, v in want.items()), key=str)


def test_op10_of_two_writers_of_a_batch_one_commits(spark):
    """Both find the name free and write; the second's rename is refused and leaves nothing."""
    df = spark.createDataFrame([("a", "en", "t1", 5)], "source string, lang string, tokenizer string, n_tokens long")
    folder = new_path(spark, "test-rollup")
    one, other = rollup.Rollup(spark, folder), rollup.Rollup(spark, folder)
    other.committed = lambda: []
    assert one.commit("x", rollup.inserts(df)) and not other.commit("x", rollup.inserts(df))
    rollup.roll_up(rollup.inserts(df)).write.parquet(f"{folder}/_writing-broken-off")
    assert rows(one.totals(), "n_docs", "n_tokens") == [(1, 5)]
    assert one._names("_writing") == ["-broken-off"]


def test_op10_compaction_changes_no_total_and_forgets_no_batch(spark):
    df = spark.createDataFrame([("a", "en", "t1", 5), ("b", None, "t1", 2)], "source string, lang string, tokenizer string, n_tokens long")
    r = rollup.Rollup(spark, new_path(spark, "test-rollup"))
    for k in range(4):
        assert r.commit(f"batch {k}", rollup.inserts(df)) and r.compact()
        assert not r.commit("batch 0", rollup.inserts(df))
        assert rows(r.totals(), "source", "n_docs", "n_tokens") == [("a", k + 1, 5 * (k + 1)), ("b", k + 1, 2 * (k + 1))]
    assert r._names("base-") == ["2", "3"] and r._names("batch-") == ["batch 3"]


def test_op10_commits_are_idempotent(spark):
    df = spark.createDataFrame([("a", "en", "t1", 5), ("a", "en", "t1", 7), (None, None, "t1", None)], "source string, lang string, tokenizer string, n_tokens long")
    r = rollup.Rollup(spark, new_path(spark, "test-rollup"))
    assert r.totals().count() == 0
    assert r.commit("1", rollup.inserts(df)) and not r.commit("1", rollup.inserts(df))
    assert rows(r.totals(), "source", "n_docs", "n_tokens") == [("a", 2, 12), (None, 1, 0)]
    assert r.commit("2", rollup.deletes(df.where("n_tokens = 5"))) and r.commit("3", rollup.revisions(df.where("n_tokens = 7"), df.where("n_tokens = 7").withColumn("n_tokens", F.lit(9))))
    assert rows(r.totals(), "source", "n_docs", "n_tokens") == [("a", 1, 9), (None, 1, 0)]
    assert r.committed() == ["1", "2", "3"]


CLASHES = ["N_Words", "Words", "Base_Failed", "KEPT", "Lang_Pred", "Score", "Places", "Template_Labels", "Containment", "Spans", "Items", "Fp", "Component", "Text_Hash", "Ids", "Decoded", "Start", "N_Tokens", "Row_Key", "Bands", "Body"]


def test_columns_with_clashing_names(spark, docs):
    """Each operator on a table that has columns of the names that it makes or uses, in other case."""
    plain = docs.select("doc_id", "text", "lang").where("doc_id < 40")
    odd = plain.select("*", *[F.lit("x").alias(c) for c in CLASHES])
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    n = plain.count()
    model = langid.train(plain)
    digest = lambda df, *names: rows(df, "doc_id", *names)
    pairs = [
        (lambda d: quality.judge(d), ("n_words", "n_repeat_words", "base_failed", "kept")),
        (lambda d: quality.keep_good(d), ("text",)),
        (lambda d: langid.identify(d, model), ("lang_pred", "score")),
        (lambda d: langid.keep_identified(d, model), ("text",)),
        (lambda d: licenses.scan(d, window=licenses.WINDOW), ("n_words", "places", "template_labels", "own_labels")),
        (lambda d: licenses.scan(d), ("n_words", "places", "template_labels")),
        (lambda d: decontam.find_contamination(d, bench), ("n_words", "spans", "items")),
        (lambda d: decontam.remove_contamination(d, bench), ("text",)),
        (lambda d: simhash.near_duplicates(d), ("fp", "component_id")),
        (lambda d: simhash.keep_one_each(d), ("text",)),
        (lambda d: similar.near_duplicates(d), ("component",)),
        (lambda d: token_files.round_trip(d, queries.DEFINITION), ("start", "n_tokens", "ids_crc32")),
        (lambda d: bpe.encode_documents(d, queries.RANKS, P.PATTERN), ("ids",)),
        (lambda d: rollup.count_tokens(d, {"n_tokens": queries.RANKS}, P.PATTERN), ("n_tokens",)),
    ]
    for work, names in pairs:
        assert digest(work(odd), *names) == digest(work(plain), *names)
    back = bpe.decode_documents(bpe.encode_documents(odd, queries.RANKS, P.PATTERN), queries.RANKS)
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in back.collect()) and back.count() == n


def test_an_empty_table_has_no_conversations(spark):
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string, Spans string")).count() == 0


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n != "op7_chat_format"])
def test_empty_tables_give_empty_results(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", [n for n in queries.QUERIES])
def test_odd_rows_and_extra_columns_do_not_crash(spark, table, name):
    assert queries.QUERIES[name](spark, table).count() > 0


def test_pipeline_stages_keep_the_columns_and_clean_documents(spark, table):
    docs = spark.read.parquet(f"{table}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = write_table(stage(spark, docs, table), "test-stage")
        assert docs.columns == columns, name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, table)
    assert all(r["decodes"] for r in last.collect()) and last.count() == docs.count() > 0


def test_near_dedup_stage_against_brute_force(spark):
    """Clusters of near copies at 5-word similarities on both sides of 0.8, chains, short and empty texts."""
    draw = random.Random(3)
    texts = ["", "two words", "Two  words", "one two three four five six"]
    for _ in range(25):
        words = [f"w{draw.randrange(5000)}" for _ in range(draw.choice((30, 80, 200)))]
        texts.append(" ".join(words))
        for _ in range(draw.randint(0, 8)):
            words = list(words) if draw.random() < 0.5 else texts[-1].split()
            for at in draw.sample(range(len(words)), max(1, len(words) // draw.choice((30, 60, 90)))):
                words[at] = f"v{draw.randrange(5000)}"
            texts.append(" ".join(words))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    want = sorted(min(i for i in range(len(texts)) if group[i] == g) for g in set(group))
    assert len(want) < len(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect())
    assert got == want
    assert got != sorted(r["doc_id"] for r in simhash.keep_one_each(df).collect())


def test_near_dedup_asks_what_simhash_links(spark, monkeypatch):
    """Pairs of equal fingerprints and of linked ones are candidates, and the stage of the pipeline has them."""
    marked = spark.createDataFrame([(5, 1, 10), (5, 2, 11), (5, 1, 10), (4, 3, 12), (1 << 40, 4, 13), (0xFF00FF, 5, 14)], "fp long, key long, n long")
    got = similar._by_fingerprint(marked).collect()
    assert sorted(tuple(r) for r in got) == [(1, 2, 10, 11), (1, 3, 10, 12), (1, 4, 10, 13)] or sorted(tuple(r) for r in got) == [(1, 2, 10, 11), (1, 3, 10, 12), (3, 4, 12, 13)]
    asked, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda fps: asked.append({r["fp"] for r in fps.collect()}) or links(fps))
    texts = ["one two three four five six", "seven eight nine ten", "one two three four five six", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == [0, 1, 3]
    assert asked == [{(f - (1 << 64)) if f >> 63 else f for f in map(simhash.fingerprint, texts)}]


@pytest.mark.parametrize("block", [2048, 3])
def test_near_dedup_verifies_what_it_merges(spark, monkeypatch, block):
    """Members of one MinHash cell that are not similar to its smallest still meet each other, in one block or many."""
    monkeypatch.setattr(similar, "BLOCK", block)
    words = [f"w{i}" for i in range(90)]
    texts = [" ".join(words[:60] + [f"{c}{i}" for i in range(25)] + [x]) for c in "abcdefgh" for x in "xy"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect())
    assert got == list(range(0, 16, 2))


@pytest.mark.parametrize("across", [False, True])
def test_a_forest_connects_what_all_pairs_would(across):
    """Of members that are alike in several cells; pairs are given in one cell only, by forests fewer than members."""
    draw = np.random.default_rng(5)
    size, base = 120, draw.integers(0, 1 << 62, 150)
    sets = [np.unique(np.concatenate([base[: draw.integers(120, 150)], draw.integers(0, 1 << 62, draw.integers(0, 30))]).view(np.uint64)) for _ in range(size)]
    cells = [sorted({c for c in (7, 8, 9) if draw.random() < 0.8}) for _ in sets]
    label = draw.integers(0, 60, size)
    data = [{"key": i, "n": len(s), "label": int(label[i]), "part": i % 2, "sketch": similar.sketch(s).tolist(), "cells": c} for i, (s, c) in enumerate(zip(sets, cells))]

    def joined(pairs):
        group = label.copy()
        for a, b in pairs:
            group[group == group[a]] = group[b]
        return {frozenset(np.flatnonzero(group == g).tolist()) for g in group}

    every, forests = [], []
    for cell in (7, 8, 9):
        block = similar._Block(cell, across, pa.array([d for d in data if cell in d["cells"]]), 0.8)
        every += map(tuple, np.sort(block.pairs(), axis=1).tolist())
        forest = [tuple(x) for x in np.sort(block.forest(), axis=1).tolist()]
        assert len(forest) < len(block.key) and joined(forest) == joined(np.sort(block.pairs(), axis=1).tolist())
        forests += forest
    assert len(every) == len(set(every)) > len(forests) > 0 and set(forests) <= set(every)
    assert joined(forests) == joined(every)
    similar_sets = {(a, b) for a in range(size) for b in range(a + 1, size) if label[a] != label[b] and set(cells[a]) & set(cells[b]) and (not across or (a + b) % 2) and len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))}
    assert similar_sets <= set(every)


def test_training_sample_stays_out_of_python_lists():
    draw = np.random.default_rng(3)
    ids = [str(draw.integers(900)) for _ in range(1000)]
    lists = [draw.integers(0, langid.BUCKETS, 1000).astype(np.int32) for _ in ids]
    got = pa.table({"doc_id": ids[:900] + [f"only {i}" for i in range(1000)], "buckets": pa.array(lists[:900] + lists, pa.list_(pa.int32()))})
    by_id = sorted(range(got.num_rows), key=lambda i: (got["doc_id"][i].as_py(), got["buckets"][i].as_py()))
    tracemalloc.start()
    order = list(langid._order(got.slice(900)))  # ids that stand once
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(order) == list(range(1000)) and peak < 5_000_000
    assert [int(x) for x in langid._order(got)] == np.array(by_id)[np.random.default_rng(5).permutation(got.num_rows)].tolist()


def test_values_scaled_row_by_row_train_the_same():
    draw = np.random.default_rng(4)
    rows = [(np.unique(draw.integers(0, 500, 40)).astype(np.int32), int(draw.integers(3))) for _ in range(60)]
    rows = [(b, draw.random(len(b)).astype(np.float32), y) for b, y in rows]
    idf = draw.random(langid.BUCKETS) + 0.5
    once = langid.ftrl([(b, langid.SCALE * s * idf[b], y) for b, s, y in rows], 3)
    assert all(np.array_equal(x, y) for x, y in zip(once, langid.ftrl(rows, 3, scale=idf), strict=True))
