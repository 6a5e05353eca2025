"""The registered queries of this package, with production parameters, and their SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.llm import alignment, chat, fingerprints, knn, line_rules, lines, near, negatives, packing, phrases, pieces, quality, warc
from barloom.llm.common import arrow

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


# -- 3: chat formatting ------------------------------------------------------------------

PROBE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
CHAT_DDL = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def chat_digest(turns: DataFrame) -> DataFrame:
    """Read the formatted output back, turn by turn, and sum up each conversation; the input's order is kept."""
    out = arrow(CHAT_DDL)

    class Sum:
        def __init__(self, conv):
            self.conv, self.n, self.loss, self.chars = conv, 0, 0, 0
            self.turns, self.masked = hashlib.sha256(), hashlib.sha256()

        def row(self):
            return self.conv, self.n, self.turns.hexdigest(), self.loss, self.masked.hexdigest(), self.chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for conv, added, start, text_start, text_end in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or conv != now.conv:
                    rows += [now.row()] if now else []
                    now = Sum(conv)
                for role, text in chat.read_turns(added):
                    now.n += 1
                    now.turns.update(f"{role}\n{text}\n".encode())
                    if role == "assistant":
                        masked = chat.unescape(added[text_start - start : text_end - start])
                        now.loss += len(masked)
                        now.masked.update(masked.encode())
                now.chars += len(added)
            if len(rows) >= 512:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)
                rows = []
        rows += [now.row()] if now else []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    return turns.select("conv_id", "added", "start", "text_start", "text_end").mapInArrow(run, CHAT_DDL)


def op3_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    probe = spark.createDataFrame(PROBE, "conv_id bigint, turn bigint, role string, text string")
    rows = _read(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat_digest(chat.format_turns(rows))


def _chat_sql() -> str:
    text = "replace(coalesce(text, ''), '\\', '\\\\')"
    for c in chat.CONTROL:
        text = f"replace({text}, '{c}', '{c[0]}\\{c[1:]}')"
    return f"""
with r as (
  select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t as (
  select *, length({text}) chars, lag(role) over (partition by conv_id order by turn, role, text) before from r)
select conv_id, count(*) n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) turns_sha256,
  coalesce(sum(case when role = 'assistant' then length(text) end), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) loss_sha256,
  sum(chars + case when before is null or before = 'assistant' then 3 else 0 end
    + case role when 'user' then 13 when 'assistant' then 4 when 'system' then 15 else 14 + length(role) end)::bigint formatted_chars
from t group by conv_id"""


# -- the others --------------------------------------------------------------------------


def op1_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_scores(_read(spark, sf, "documents"), _read(spark, sf, "labels"))


def op2_voronoi_topk(spark: SparkSession, sf: str) -> DataFrame:
    return knn.top_inner(_read(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


TOPK_SQL = """
with v as (
  select distinct vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) e from embeddings
  where vec_id is not null and embedding is not null and list_count(embedding) = len(embedding)
    and len(list_filter(embedding, lambda x: not isfinite(x))) = 0),
s as (
  select q.vec_id query_id, c.vec_id vec_id, list_inner_product(q.e, c.e)::bigint score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int "rank", vec_id, score
from s qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5"""


def op4_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_phrase_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.repeat_digest(_read(spark, sf, "documents"))


def op6_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.compare_with_next(_read(spark, sf, "documents"))


def op7_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return lines.repeated_lines(_read(spark, sf, "documents"))


def op8_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc.archive_round_trip(_read(spark, sf, "pages"))


WARC_SQL = """
with p as (
  select page_id, strlen(coalesce(html, ''))::bigint payload_bytes, sha256(coalesce(html, '')) payload_digest from pages),
f as (select payload_digest, min(page_id) first_id from p where payload_bytes >= 100 group by 1)
select page_id, payload_bytes, payload_digest,
  case when first_id is null or first_id = page_id then 'response' else 'revisit' end record_type,
  case when first_id <> page_id then first_id end refers_to
from p left join f using (payload_digest)"""


def op9_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of every document, and the digest of the text decoded from them."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    encoded = pieces.encode_documents(_read(spark, sf, "documents"), path)
    return pieces.decode_documents(encoded, path).select("doc_id", "n_ids", "ids", F.sha2("text", 256).alias("text_sha256"))


def op10_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near.near_duplicates(_read(spark, sf, "documents"))


def op11_line_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return line_rules.verdicts(_read(spark, sf, "documents")).drop("removed")


def op12_alignment(spark: SparkSession, sf: str) -> DataFrame:
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.link_scores(_read(spark, sf, "documents"), a, b, derive={"groups_sha256": digest})


def op13_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """Every seventh vector is mislabelled first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = _read(spark, sf, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0)


NEGATIVES_SQL = """
with v as (
  select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end l, list_transform(embedding, lambda x: floor(256 * x::double)) e
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and list_count(embedding) = len(embedding)
    and len(list_filter(embedding, lambda x: not isfinite(x))) = 0),
s as (
  select q.vec_id anchor_id, q.l anchor_label, c.vec_id, c.l, list_inner_product(q.e, c.e)::bigint score
  from v q join v c on true where q.vec_id % 100 = 0),
p as (
  select anchor_id, vec_id positive_id, score positive_score from s where l = anchor_label and vec_id <> anchor_id
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id)::int "rank",
  vec_id negative_id, positive_score, score negative_score
from p join s on p.anchor_id = s.anchor_id and l <> anchor_label and 80 * positive_score <= 100 * score and score <= positive_score
qualify row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id) <= 5"""


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_quality, op2_voronoi_topk, op3_chat_format, op4_packing, op5_phrase_dedup, op6_fingerprints, op7_line_dedup, op8_warc,
        op9_pieces, op10_near_dedup, op11_line_frequency, op12_alignment, op13_hard_negatives)}


def oracle_sql() -> dict[str, str]:
    return {"op2_voronoi_topk": TOPK_SQL, "op3_chat_format": _chat_sql(), "op8_warc": WARC_SQL, "op11_line_frequency": line_rules.ORACLE,
            "op13_hard_negatives": NEGATIVES_SQL}
