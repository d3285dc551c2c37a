"""The registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import bpe, clustering, decontaminate, hostrules, jaccard, linededup, lm, negatives, pii, quality, secrets, sharding, topk
from folioscope.llm.common import table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN).select("doc_id", "ids")
    both = bpe.decode(coded, RANKS, public_tokenizers.PATTERN)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.col("n_item").cast("long").alias("n_item"), F.col("n_shared").cast("long").alias("n_shared"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select("doc_id", "text", "lang", "source"), models).select("doc_id", "quality_score", "toxic_score", "accepted")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(topk.build_index(vectors, is_query=F.col("vec_id") % 20 == 0), k=20)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.train(docs)).select("doc_id", "secrets")
    base = F.filter("secrets", lambda s: s["kind"] != "markov")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in secrets.KINDS),
        F.sha2(secrets.spans_text(base), 256).alias("base_sha256"),
        secrets.spans_text(F.col("secrets")).alias("spans"),
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    out = sharding.assign_shards(docs, shards=8, keep=["doc_id", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard.jaccard_components(table(spark, sf_dir, "documents"), width=4, percent=85)
    return out.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    base = F.filter("pii", lambda s: s["rank"] < len(pii.BASE))
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(kind.name).alias(f"n_{kind.name}") for kind in pii.KINDS),
        F.sha2(pii.spans_text(base), 256).alias("base_sha256"),
        pii.spans_text(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda s: F.format_number(s["score"], 1)), ",").alias("scores"),
    )


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clustering.cluster(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dim=64, scale=64)
    if found is None:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    own, every = clustering.inertia(found)
    return found.assigned.select(
        F.col("id").alias("vec_id"), "cluster", "distance", own.alias("cluster_inertia"), every.alias("inertia"), clustering.digests(found).alias("centroid_sha256")
    )


def op12_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hostrules.judge(table(spark, sf_dir, "documents"))
    base = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return out.select(*base, F.array_join("failed", ",").alias("failed_rules"), F.array_join("host_rejected", ",").alias("host_rejected"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = vectors.select("vec_id", "embedding", label.alias("label"))
    return negatives.mine(vectors, is_anchor=F.col("vec_id") % 100 == 0, positives=5, negatives=10, low=30, high=90, scale=256)


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_bpe, op3_decontamination, op4_quality_classifier, op5_topk, op6_secrets, op7_sharding, op8_lm_scoring, op9_jaccard_join, op10_pii, op11_centroid_clustering, op12_host_rules, op13_hard_negatives)}

_ROUND = """,
far{n} as (select r, vec_id, q, c, list_sum(list_transform(list_zip(q, centre), lambda p: (p[1] - p[2])::hugeint * (p[1] - p[2])))::bigint d from v, centres{n}),
near{n} as (select *, row_number() over (partition by r order by d, c) place from far{n}),
own{n} as (select r, vec_id, q, c, d from near{n} where place = 1)"""
_MOVE = """,
sums{n} as (select c, j, sum(x) s, count(*) n from (select c, unnest(q) x, generate_subscripts(q, 1) j from own{n}) group by c, j),
centres{m} as (select c, coalesce(any_value(moved), any_value(centre)) centre from centres{n} left join (select c, list(((s - ((s % n) + n) % n) // n)::bigint order by j) moved from sums{n} group by c) using (c) group by c)"""

ORACLES: dict[str, str] = {
    "op11_centroid_clustering": """with v as (select row_number() over () r, vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) q from embeddings
 where embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
centres0 as (select row_number() over (order by h nulls last, q) - 1 c, q centre from (select sha256('1:' || vec_id) h, q from v order by h nulls last, q limit 16))"""
    + "".join(_ROUND.format(n=n) + _MOVE.format(n=n, m=n + 1) for n in range(3))
    + _ROUND.format(n=3)
    + """,
told as (select c, sum(d) s from own3 group by c)
select vec_id, cast(o.c as int) "cluster", d distance, s::bigint cluster_inertia, (select sum(s) from told)::bigint inertia, sha256(array_to_string(centre, ',')) centroid_sha256 from own3 o join told using (c) join centres3 using (c)""",
    "op12_host_rules": r"""with d as (select doc_id, source, coalesce(text, '') t from documents),
w as (select doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') words, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) lines from d),
grams as (select doc_id, unnest(range(1, len(words) - 1)) j, words from w where len(words) > 2),
keyed as (select doc_id, j, list_slice(words, j, j + 2) gram from grams),
twice as (select doc_id, j from keyed qualify count(*) over (partition by doc_id, gram) > 1),
repeats as (select doc_id, count(distinct p) n from (select doc_id, unnest([j, j + 1, j + 2]) p from twice) group by doc_id),
m as (select doc_id, source, len(words) n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) n_symbols,
 len(lines) n_lines, len(lines) - len(list_distinct(lines)) n_dup_lines, coalesce(n, 0) n_repeat_words from w left join repeats using (doc_id)),
f as (select *, n_words < 50 r_short, 100 * n_repeat_words > 50 * n_words r_repeated, 10 * n_symbols > n_words r_symbols, word_chars < 3 * n_words or word_chars > 10 * n_words r_word_length, 2 * n_dup_lines > n_lines r_lines from m),
tests as (select doc_id, source, unnest(['short', 'repeated', 'symbols', 'word_length', 'lines']) rule, unnest([r_short, r_repeated, r_symbols, r_word_length, r_lines]) failed from f),
hosts as (select source, rule, count(*)::double n, sum(failed::int)::double fails from tests where source is not null group by source, rule),
sums as (select rule, count(*)::double hosts, sum(n) total, sum(n * n) squares, sum(fails) failed, sum(fails * fails / n) spread from hosts group by rule),
parts as (select *, failed / total mean, (spread - failed * failed / total) / nullif(hosts - 1, 0) between_hosts, (failed - spread) / nullif(total - hosts, 0) within_hosts, (total - squares / total) / nullif(hosts - 1, 0) size from sums),
shares as (select *, (between_hosts - within_hosts) / nullif(between_hosts + (size - 1) * within_hosts, 0) share from parts),
priors as (select rule, mean, case when hosts < 2 or total = hosts or failed in (0, total) or share is null or share <= 0 then total else least(greatest((1 - share) / share, 1), total) end weight from shares),
rates as (select source, rule, (fails + mean * weight) / (n + weight) rate from hosts join priors using (rule)),
judged as (select t.doc_id, t.rule, t.failed, coalesce(rate, mean) rate from tests t join priors p on p.rule = t.rule left join rates x on x.source = t.source and x.rule = t.rule),
verdicts as (select doc_id, bool_or(failed and rule in ('short', 'repeated')) base_failed, bool_or(failed and rate >= 0.01) or bool_or(rate > 0.5) goes,
 coalesce(string_agg(rule, ',' order by list_position(['short', 'repeated', 'symbols', 'word_length', 'lines'], rule)) filter (failed), '') failed_rules,
 coalesce(string_agg(rule, ',' order by list_position(['short', 'repeated', 'symbols', 'word_length', 'lines'], rule)) filter (rate > 0.5), '') host_rejected from judged group by doc_id)
select doc_id, n_words::bigint n_words, word_chars::bigint word_chars, n_symbols::bigint n_symbols, n_dup_lines::bigint n_dup_lines, n_repeat_words::bigint n_repeat_words, base_failed, not base_failed and not goes kept, failed_rules, host_rejected from m join verdicts using (doc_id)""",
    "op13_hard_negatives": """with v as (select row_number() over () r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) q from embeddings
 where label is not null and vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (select a.r, a.vec_id anchor_id, a.label = b.label same, b.r br, b.vec_id, cast(list_dot_product(cast(a.q as double[]), cast(b.q as double[])) as bigint) score from v a join v b on a.r <> b.r and len(a.q) = len(b.q) where a.vec_id % 100 = 0),
positives as (select * from pairs where same qualify row_number() over (partition by r order by score desc, vec_id, br) <= 5),
found as (select p.anchor_id, p.vec_id positive_id, n.vec_id negative_id, p.score positive_score, n.score negative_score, row_number() over (partition by p.r, p.br order by n.score desc, n.vec_id, n.br) place
 from positives p join pairs n on n.r = p.r and not n.same and 30 * p.score <= 100 * n.score and 100 * n.score <= 90 * p.score)
select anchor_id, positive_id, cast(place as int) "rank", negative_id, positive_score, negative_score from found where place <= 10""",
    "op5_topk": """with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) q from embeddings
 where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (select a.vec_id query_id, b.vec_id vec_id, cast(list_dot_product(cast(a.q as double[]), cast(b.q as double[])) as bigint) score from v a join v b on a.vec_id <> b.vec_id and len(a.q) = len(b.q) where a.vec_id % 20 = 0),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) r from pairs)
select query_id, cast(r as int) "rank", vec_id, score from ranked where r <= 20""",
}
