"""Queries of this subpackage: each applies its operator to its whole table and digests the result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, chat, decontam, langid, licenses, mixing, phrases, quality, rollup, simhash, token_files, warc
from .common import new_path, read_table, write_table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DEFINITION = public_tokenizers.path("byte_bpe_50k.json")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read_table(spark, sf_dir, "documents").select("doc_id", "text"), RANKS, public_tokenizers.PATTERN, ["doc_id"]).drop("decodes")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs.select("doc_id", "text"), langid.train(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"), window=licenses.WINDOW)
    starts, base = F.transform("places", lambda p: p["start"]), F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, "own_labels")), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.col("containment")).alias("score"),
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_contamination(docs, read_table(spark, sf_dir, "benchmark"))
    hit = decontam.hit_words("spans")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


CONTROL = "\\### Assistant: </turn> ok"


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)], rows.schema)
    return chat.read_back(chat.format_conversations(rows.unionByName(extra))).drop("rewrites_history")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.to_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(read_table(spark, sf_dir, "documents"), DEFINITION)


#: Tokenizer versions of the rollup: op9's vocabulary and op1's.
VERSIONS = {"byte_bpe_50k": public_tokenizers.path("byte_bpe_50k.tiktoken"), "byte_bpe_multi_50k": RANKS}


def op10_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted with their token counts by one vocabulary, then by another; the first's counts are
    revised to hold the end id as well; documents of under 20 tokens of the second are deleted; the totals are
    compacted; and the first batch is sent again and must change nothing."""
    old, new = VERSIONS
    docs = read_table(spark, sf_dir, "documents").select("source", "lang", "text")
    counted = write_table(rollup.count_tokens(docs, VERSIONS, public_tokenizers.PATTERN).drop("text"), "rollup-counts")
    by = lambda rows, name, n: rows.select("source", "lang", F.lit(name).alias("tokenizer"), n.alias("n_tokens"))
    first, second, revised = (lambda rows: by(rows, old, F.col(old))), (lambda rows: by(rows, new, F.col(new))), (lambda rows: by(rows, old, F.col(old) + 1))
    totals = rollup.Rollup(spark, new_path(spark, "rollup"))
    totals.commit("1-load", rollup.inserts(first(counted)))
    totals.commit("2-load", rollup.inserts(second(counted)))
    totals.commit("3-revise", rollup.revisions(first(counted), revised(counted)))
    short = counted.where(F.col(new) < 20)
    totals.commit("4-short", rollup.deletes(revised(short).unionByName(second(short))))
    totals.compact()
    totals.commit("1-load", rollup.inserts(first(counted)))
    return totals.totals()


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, _ = centroids.cluster(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return centroids.with_inertia(write_table(assigned.drop("distances"), "assigned"))


def op12_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(read_table(spark, sf_dir, "documents").select("lang", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_quality_rules": op2_quality_rules,
    "op3_language_id": op3_language_id,
    "op4_license_scan": op4_license_scan,
    "op5_decontaminate": op5_decontaminate,
    "op6_warc": op6_warc,
    "op7_chat_format": op7_chat_format,
    "op8_simhash": op8_simhash,
    "op9_token_files": op9_token_files,
    "op10_token_rollup": op10_token_rollup,
    "op11_centroids": op11_centroids,
    "op12_mix": op12_mix,
    "op13_phrases": op13_phrases,
    "pipeline": pipeline,
}


def _rounds_sql(clusters: int, rounds: int) -> str:
    """Centroids as a table of (j, c) for each round, and vectors' nearest ones."""
    square = "list_sum(list_transform(list_zip(v.w, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint"
    parts = [
        f"""v as (select row_number() over () as i, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as w from embeddings
          where len(embedding) = {centroids.SIZE} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {centroids.SIZE})""",
        f"c0 as materialized (select row_number() over (order by h, w) - 1 as j, w as c from (select w, sha256('2:' || vec_id) as h from v order by h, w limit {clusters}))",
    ]
    for n in range(rounds + 1):
        parts.append(f"a{n} as materialized (select i, min(struct_pack(d := d, j := j)) as m from (select v.i, {square} as d, c.j from v cross join c{n} c) group by i)")
        if n < rounds:
            means = f"""select j, list(m order by p) as c from (
              select j, p, (sum(x)::hugeint - ((sum(x)::hugeint % count(*) + count(*)) % count(*))) // count(*) as m
              from (select a.m.j as j, unnest(v.w) as x, generate_subscripts(v.w, 1) as p from a{n} a join v using (i)) group by j, p) group by j"""
            parts.append(f"c{n + 1} as materialized (select c.j, coalesce(m.c, c.c) as c from c{n} c left join ({means}) m using (j))")
    last = f"""select v.vec_id, a.m.j::int as cluster, a.m.d::bigint as distance, sum(a.m.d) over (partition by a.m.j)::bigint as cluster_inertia,
      sum(a.m.d) over ()::bigint as inertia, sha256(array_to_string(c.c, ',')) as centroid_sha256 from v join a{rounds} a using (i) join c{rounds} c on c.j = a.m.j"""
    return f"with {', '.join(parts)} {last}"


_COLLOCATIONS = """
    with p as (select row_number() over () as pid, lang, piece from (
      select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents)),
    w as (select pid, lang, unnest(ws) as w, generate_subscripts(ws, 1) as pos from (select pid, lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') as ws from p)),
    x as (select lang, [w, lead(w, 1) over o, lead(w, 2) over o, lead(w, 3) over o, lead(w, 4) over o] as five from w window o as (partition by pid order by pos)),
    g as (select lang, array_slice(five, 1, k) as ph from x cross join range(1, 6) r(k) where five[k] is not null),
    f as materialized (select lang, ph, len(ph) as k, count(*) as a from g group by lang, ph),
    n as (select lang, sum(a)::bigint as n from f where k = 1 group by lang),
    c as materialized (select * from f where k > 1 and a >= 100),
    inside as (select lang, array_slice(ph, i, i + s - 1) as ph, max(a) as more from (select *, unnest(range(1, k)) as i from c) cross join range(2, 5) q(s) where s < k and i + s - 1 <= k group by 1, 2),
    often as materialized (select * from f where a >= 100),
    parts as materialized (select c.lang, c.ph, c.a, x.k, array_slice(c.ph, 1, x.k) as lp, array_slice(c.ph, x.k + 1, c.k) as rp from c join range(1, 5) x(k) on x.k < c.k),
    cuts as (select p.lang, p.ph, p.a, n.n, p.k, l.a as l, r.a as r, (1000::hugeint * p.a * n.n) // (l.a::hugeint * r.a) as score
      from parts p join n using (lang) join often l on l.lang = p.lang and l.ph = p.lp join often r on r.lang = p.lang and r.ph = p.rp),
    best as (select * from cuts qualify row_number() over (partition by lang, ph order by score, k) = 1),
    ranked as (select b.lang, array_to_string(b.ph, ' ') as phrase, b.a, b.l, b.r, b.n, b.score from best b left join inside i on i.lang = b.lang and i.ph = b.ph where i.more is null or 100 * i.more < 100 * b.a)
    select lang, row_number() over o as rank, phrase, a, l, r, n, score::bigint as score from ranked
    window o as (partition by lang order by score desc, a desc, phrase) qualify row_number() over o <= 2000"""

ORACLES = {
    "op6_warc": """
        with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
        q as (select page_id, octet_length(payload) as n, sha1(payload) as d from p),
        r as (select *, max(page_id) over (partition by d) as top from q)
        select page_id, cast(n as bigint) as payload_bytes, d as payload_digest,
               case when n >= 1000 and page_id <> top then 'revisit' else 'response' end as record_type,
               case when n >= 1000 and page_id <> top then top end as refers_to
        from r""",
    "op7_chat_format": r"""
        with a as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
                   union all select -7, 0, 'user', '\### Assistant: </turn> ok'
                   union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        e as (select *, replace(replace(text, '\', '\\'), '<', '\<') as safe from a)
        select conv_id, cast(count(*) as bigint) as n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
               cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
               sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
               cast(sum(length(role) + length(safe) + 17) as bigint) as formatted_chars
        from e group by conv_id""",
    "op11_centroids": _rounds_sql(centroids.CLUSTERS, centroids.ROUNDS),
    "op13_phrases": _COLLOCATIONS,
}
