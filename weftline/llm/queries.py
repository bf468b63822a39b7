"""The query of each operator, over whole tables, and its SQL where there is one."""

from __future__ import annotations

import public_tokenizers

from pyspark.sql import functions as F

from weftline.llm import chat, exact_dedup, fingerprint, lm, ngram_join, packing, pii, sentence_pieces, toxicity, warc


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def op1_chat(spark, d):
    """Spans as start:end, comma-joined."""
    found = chat.rotate(table(spark, d, "conversations"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.withColumn("spans", spans)


def op2_pii(spark, d):
    return pii.find(table(spark, d, "documents"))


def op3_exact_dedup(spark, d):
    return exact_dedup.exact_duplicates(table(spark, d, "documents"))


def op4_warc(spark, d):
    return warc.round_trip(table(spark, d, "pages"))


def op5_toxicity(spark, d):
    return toxicity.score(table(spark, d, "documents"), table(spark, d, "labels"))


def op6_fingerprint(spark, d):
    return fingerprint.fingerprints(table(spark, d, "documents"))


def op7_lm(spark, d):
    return lm.score(table(spark, d, "documents"))


def op8_ngram_join(spark, d):
    return ngram_join.similar(table(spark, d, "documents"))


def op9_sentence_pieces(spark, d):
    return sentence_pieces.round_trip(table(spark, d, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_packing(spark, d):
    return packing.pack(table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op1_chat": op1_chat, "op2_pii": op2_pii, "op3_exact_dedup": op3_exact_dedup, "op4_warc": op4_warc, "op5_toxicity": op5_toxicity, "op6_fingerprint": op6_fingerprint, "op7_lm": op7_lm, "op8_ngram_join": op8_ngram_join, "op9_sentence_pieces": op9_sentence_pieces, "op10_packing": op10_packing}

_NORMAL = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"

ORACLE_SQL = {
    # whole conversations of at most 64 turns a segment: cut as the operator cuts them where turn numbers are distinct
    "op1_chat": """
        with t as (
            select conv_id, turn, turn // 64 as bucket, coalesce(role, 'unknown') as role, replace(coalesce(text, ''), '<|', '< |') || '<|end|>' || chr(10) as body from conversations),
        p as (select distinct conv_id, role as participant from t where role <> 'system'),
        r as (
            select t.*, participant, role = participant as own,
                   '<|' || case when role = 'system' then role when role = participant then 'assistant' else 'user:' || role end || '|>' || chr(10) as head
            from t join p using (conv_id)),
        o as (select *, coalesce(sum(length(head) + length(body)) over (partition by conv_id, participant, bucket order by turn rows between unbounded preceding and 1 preceding), 0) as pos from r),
        s as (
            select conv_id, participant, bucket, min(turn) as first_turn, count(*) as n_turns, count(*) as n_rows, string_agg(head || body, '' order by turn) as text,
                   coalesce(string_agg(cast(pos + length(head) as bigint) || ':' || cast(pos + length(head) + length(body) as bigint), ',' order by turn) filter (where own), '') as spans,
                   coalesce(sum(length(body)) filter (where own), 0) as mask_chars
            from o group by conv_id, participant, bucket)
        select conv_id, participant, row_number() over w - 1 as segment_id, first_turn, n_turns, n_rows,
               cast(coalesce(sum(n_turns) over b, 0) as bigint) as turn_start, cast(coalesce(sum(length(text)) over b, 0) as bigint) as char_start, text, spans, cast(mask_chars as bigint) as mask_chars
        from s window w as (partition by conv_id, participant order by bucket), b as (partition by conv_id, participant order by bucket rows between unbounded preceding and 1 preceding)""",
    "op3_exact_dedup": f"""
        select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
               doc_id = min(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
        from (select doc_id, {_NORMAL} as t from documents)""",
    # digests in base 32: each digit is five bits out of three hexadecimal ones
    "op4_warc": """
        with b as (select page_id, coalesce(html, '') as t from pages),
        m as (select page_id, octet_length(encode(t)) as n, sha1(t) || '00' as d, max(page_id) over (partition by t) as keep from b)
        select page_id, cast(n as bigint) as payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + ((cast('0x' || substr(d, 1 + cast(5 * i // 4 as integer), 3) as integer) >> cast(7 - 5 * i % 4 as integer)) & 31), 1)), '') as payload_digest,
               case when keep = page_id then 'response' else 'revisit' end as record_type,
               case when keep <> page_id then keep end as refers_to,
               cast(case when keep <> page_id then 1 else greatest(1, ceil(n / 262144.0)) end as integer) as chunks
        from m""",
}
