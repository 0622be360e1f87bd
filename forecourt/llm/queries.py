"""Queries of the corpus operators over whole tables: op<N>_<name>."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forecourt.llm import (decontaminate, html_extract, line_dedup, lm_scoring, mixing, mtree, ngram_join, quality_rules, token_align, token_counts, toxicity,
                           turn_repair, url_filter)
from forecourt.llm.common import cut_lineage, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RULES = url_filter.Rules(
    (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")),
    (("spam-farm.example.org", "/"), ("cheap-pills.example.com", "/")),
)


def query(sql: str | None = None):
    def register(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


@query()
def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"), lm_scoring.Settings(min_count=1))


@query()
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


@query(r"""
with split as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
                      generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as place from documents),
keyed as (select *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from split),
firsts as (select key, min(doc_id) as first from keyed where length(key) >= 10 group by key),
marked as (select k.*, f.first is not null and f.first < k.doc_id as gone from keyed k left join firsts f on f.key = k.key)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by place) filter (not gone), '')) as kept_sha256
from marked group by doc_id""")
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return rows.select("doc.doc_id", "kept.n_lines", "kept.n_dropped", F.sha2(F.coalesce("kept.text", F.lit("")), 256).alias("kept_sha256"))


@query(mixing.ORACLE)
def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query(r"""
with cut as (select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
parts as (select page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                 regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from cut),
rules(rule_host, rule_path, verdict) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fitting as (select page_id, max_by(struct_pack(rule := rule_host || rule_path, verdict := verdict), length(rule_host || rule_path)) as best
            from parts join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path) group by page_id)
select p.page_id, host, path, best.rule as rule,
       coalesce(best.verdict, case when starts_with(path, '/') and (host = 'spam-farm.example.org' or ends_with(host, '.spam-farm.example.org')
         or host = 'cheap-pills.example.com' or ends_with(host, '.cheap-pills.example.com')) then 'block' else 'allow' end) as verdict
from parts p left join fitting f on f.page_id = p.page_id""")
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES).drop("url")


@query()
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query(r"""
with clean as (select vec_id, [cast(floor(1024 * cast(x as double)) as bigint) for x in embedding] as v, len(embedding) as n from embeddings
               where embedding is not null and vec_id is not null and len(embedding) > 0
                 and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
scored as (select q.vec_id as query_id, c.vec_id, cast(list_sum([q.v[i] * c.v[i] for i in range(1, q.n + 1)]) as bigint) as score
           from clean q join clean c on q.vec_id <> c.vec_id and q.n = c.n where q.vec_id % 100 = 0)
select query_id, cast(row_number() over w as int) as rank, vec_id, score from scored
window w as (partition by query_id order by score desc, vec_id) qualify row_number() over w <= 10""")
def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"))


@query()
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query()
def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_align.alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query()
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turn_repair.damaged(table(spark, sf_dir, "conversations"))
    decided = cut_lineage(turn_repair.decisions(rows))
    digests = turn_repair.digests(rows, decided).withColumnRenamed("conv_id", "key")
    return decided.join(digests, F.col("conv_id").eqNullSafe(F.col("key"))).drop("key")


@query()
def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.filtered(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
