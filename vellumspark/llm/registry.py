"""Registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .codes import compress_vectors
from .common import crc_mod, table
from .forest import near_duplicates
from .jaccard import jaccard_classes
from .langid import identify
from .media import text_payload_columns
from .mixing import mix_documents
from .packing import pack_documents
from .pieces import sentence_pieces
from .quality import classify_quality
from .secrets import findings_by_path, scan_history, span_digest
from .suffixes import remove_repeats
from .whitening import whiten
from .wrapper import main_text


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc_mod("doc_id", 4) == 2)
    found = identify(docs, ~F.col("held_out"))
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op2_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_previous_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_mod("label_id", 3) != 1)
    return found.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op5_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op6_blob_ledger_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(findings_by_path(scan_history(table(spark, sf_dir, "documents"))))


def op7_jaccard_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


def op8_gif_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_payload_columns(table(spark, sf_dir, "documents"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_documents(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def op10_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_digit_slice_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op12_prefix_table_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentence_pieces(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_hamerly_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compress_vectors(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", "codebooks_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_hyperdimensional_language": op1_hyperdimensional_language,
        "op2_projection_forest": op2_projection_forest,
        "op3_previous_factors": op3_previous_factors,
        "op4_boosted_quality": op4_boosted_quality,
        "op5_wrapper_induction": op5_wrapper_induction,
        "op6_blob_ledger_secrets": op6_blob_ledger_secrets,
        "op7_jaccard_regions": op7_jaccard_regions,
        "op8_gif_payload": op8_gif_payload,
        "op9_mix_sources": op9_mix_sources,
        "op10_best_two_fit": op10_best_two_fit,
        "op11_digit_slice_whitening": op11_digit_slice_whitening,
        "op12_prefix_table_pieces": op12_prefix_table_pieces,
        "op13_hamerly_codes": op13_hamerly_codes,
    }


_REACHED = """both_ways as (select x as a, y as b from links union select y, x from links),
reach as (select k, k as r from ids union select reach.k, both_ways.b from reach join both_ways on both_ways.a = reach.r)"""

_OP2 = f"""with recursive usable as (
  select vec_id, label, cast(embedding as double[]) as v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
unit as (select vec_id, label, v, sqrt(list_dot_product(v, v)) as norm from usable),
links as (select a.vec_id as x, b.vec_id as y from unit a join unit b on a.label = b.label and a.vec_id < b.vec_id and len(a.v) = len(b.v)
          where list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.93),
ids as (select vec_id as k from embeddings), {_REACHED},
counted as (select a, count(*) as n from both_ways group by a)
select k as vec_id, coalesce(any_value(n), 0) as n_links, min(r) as component_id, k = min(r) as kept from reach left join counted on a = k group by k"""

_OP7 = f"""with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
grams as (select distinct doc_id, g from (
  select doc_id, unnest(list_transform(range(1, greatest(2, cast(len(w) as bigint) - 3)), lambda i: array_to_string(w[i:i+4], ' '))) as g from words where len(w) > 0) u),
sizes as (select doc_id, count(*) as n from grams group by doc_id),
common as (select p.doc_id as x, q.doc_id as y, count(*) as c from grams p join grams q on p.g = q.g and p.doc_id < q.doc_id group by p.doc_id, q.doc_id),
links as (select x, y from common join sizes s on s.doc_id = x join sizes t on t.doc_id = y where 100 * c >= 75 * (s.n + t.n - c)),
ids as (select doc_id as k from documents), {_REACHED}
select k as doc_id, coalesce(any_value(n), 0) as n_shingles, min(r) as component_id from reach left join sizes on sizes.doc_id = k group by k"""


def _kind(number: int, kind: str, pattern: str, group: int = 0) -> str:
    """Matches of one kind with their places: what lies between matches and the matches before give a match's start."""
    return f"""select doc_id, {number} as number, '{kind}' as kind, unnest(list_transform(range(1, len(m) + 1), lambda i: {{
        's': list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(m[1:i-1], lambda g: length(g))), 0), 'm': m[i], 'g': g[i]}})) as f
      from (select doc_id, regexp_extract_all(x, '{pattern}') as m, regexp_split_to_array(x, '{pattern}') as gaps, regexp_extract_all(x, '{pattern}', {group}) as g from numbered where regexp_matches(x, '{pattern}')) q"""


_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_HEX = "[0-9a-f]{24,}"
_OP6 = f"""with t as (select row_number() over () as row, doc_id as id, coalesce(text, '') as x from documents), numbered as (select row as doc_id, x from t),
found as ({" union all ".join(_kind(*k) for k in ((0, "assign", _ASSIGN, 2), (1, "access", "AKIA[A-Z0-9]+"), (2, "hex", _HEX)))}),
kept as (select doc_id, number, kind, cast(f.s as bigint) as s, cast(f.s + length(f.m) as bigint) as e from found where case number when 0 then length(f.g) >= 6 when 1 then length(f.m) >= 20 else true end),
spans as (select doc_id, count(*) filter (where number = 0) as a, count(*) filter (where number = 1) as k, count(*) filter (where number = 2) as h,
  string_agg(kind || ':' || s || ':' || e, ',' order by s, number) as spans from kept group by doc_id)
select id as doc_id, coalesce(a, 0) as n_assign, coalesce(k, 0) as n_access, coalesce(h, 0) as n_hex, sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
from t left join spans on spans.doc_id = t.row"""


def oracle_sql() -> dict[str, str]:
    """SQL for the two joins and the scan's findings; the other operators are learned, cut bytes or depend on their method, and tests hold them against brute force."""
    return {"op2_projection_forest": _OP2, "op6_blob_ledger_secrets": _OP6, "op7_jaccard_regions": _OP7}
