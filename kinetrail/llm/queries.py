"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kd_search, language, progressive_jpeg, quality, toxicity
from .common import documents, fold, tokenizer_path
from .near_dedup import near_duplicates
from .packing import pack_documents
from .preferences import format_preferences, self_pairs
from .sentencepiece_bpe import encode_decode
from .token_files import read_token_files, write_token_files


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(spark, write_token_files(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json")))


def op2_kd_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return kd_search.top_k(vectors.where(F.col("vec_id") % 50 == 0), kd_search.build_index(vectors), k=5)


def op3_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.fit(docs.where(fold(F.col("doc_id"), 5) != 0))
    found = language.predict_languages(docs, model)
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def op4_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return format_preferences(self_pairs(turns), "conv_id")


def op5_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), 85)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold(F.col("doc_id"), 4) != 2)


def _scored(docs: DataFrame, model, threshold: float) -> DataFrame:
    scored = docs.select(F.col("doc_id"), (fold(F.col("doc_id"), 4) == 2).alias("held_out"), quality.score_column(docs, model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def op6_rff_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return _scored(docs, quality.fit(docs, _labels(spark, sf_dir)), 0.7)


def op7_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return _scored(docs, toxicity.fit(docs, _labels(spark, sf_dir)), 0.3)


def op8_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op9_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = progressive_jpeg.decode_media(progressive_jpeg.store_texts(documents(spark, sf_dir)))
    payload, rgb = F.col("payload"), F.col("rgb")
    return found.select(
        "doc_id",
        "n_bytes",
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.format_string("%dx%d rgb %08x", "width", "height", F.crc32(rgb)).alias("feature"),
    )


def op10_sentencepiece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.tiktoken"))


QUERIES = {f.__name__: f for f in (op1_token_files, op2_kd_topk, op3_crf_language, op4_preferences, op5_hyperminhash, op6_rff_quality, op7_toxicity_grammar, op8_vector_packing, op9_progressive_jpeg, op10_sentencepiece_bpe)}

#: DuckDB, over the same tables.
ORACLES: dict[str, str] = {
    "op2_kd_topk": """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as double)) as e from embeddings
           where vec_id is not null and embedding is not null and len(embedding) > 0
             and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select q.vec_id as query_id, v.vec_id, cast(list_inner_product(q.e, v.e) as bigint) as score
      from v q join v on v.vec_id <> q.vec_id and len(v.e) = len(q.e) where q.vec_id % 50 = 0)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5""",
    "op5_hyperminhash": """
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as ws from documents),
s as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
             else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) end as sh from w),
e as (select doc_id, unnest(sh) as x from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as i from e a join e b on a.x = b.x and a.doc_id <> b.doc_id group by all),
l as (select p.a, p.b from p join s sa on sa.doc_id = p.a join s sb on sb.doc_id = p.b where 100 * p.i >= 85 * (len(sa.sh) + len(sb.sh) - p.i)),
r as (select doc_id as a, doc_id as b from documents union select r.a, l.b from r join l on r.b = l.a)
select s.doc_id, cast(len(s.sh) as bigint) as n_shingles, c.component_id, s.doc_id = c.component_id as kept
from s join (select a as doc_id, min(b) as component_id from r group by a) c on c.doc_id = s.doc_id""",
    "op4_preferences": """
with t as (select conv_id, turn, coalesce(role, 'user') as role, coalesce(text, '') as text from conversations),
l as (select conv_id, max(turn) filter (role = 'assistant') as last from t group by conv_id),
p as (select t.conv_id, max_by(t.text, t.turn) as earlier from t join l on l.conv_id = t.conv_id and t.role = 'assistant' and t.turn < l.last group by t.conv_id),
c as (select l.conv_id, l.last, t.text as good, coalesce(p.earlier, '') as bad
      from l left join t on t.conv_id = l.conv_id and t.turn = l.last left join p on p.conv_id = l.conv_id),
h as (select c.conv_id, c.last, c.good, c.bad, count(t.turn) as n,
             coalesce(string_agg('<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10), '' order by t.turn), '') as prompt
      from c left join t on t.conv_id = c.conv_id and (c.last is null or t.turn < c.last or (t.turn = c.last and c.good = c.bad)) group by all)
select conv_id, cast(n as bigint) as prompt_turns, prompt,
       case when last is null then null when good = bad then '' else '<|assistant|>' || chr(10) || good || '<|end|>' || chr(10) end as chosen,
       case when last is null then null when good = bad then '' else '<|assistant|>' || chr(10) || bad || '<|end|>' || chr(10) end as rejected,
       case when last is null then null when good = bad then '' else '14-' || cast(14 + length(good) + 8 as varchar) end as chosen_mask,
       case when last is null then null when good = bad then '' else '14-' || cast(14 + length(bad) + 8 as varchar) end as rejected_mask
from h""",
}
