"""The corpus operators as registered queries, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from karavel.llm import decontaminate, html_text, language_id, line_dedup, near_dedup, periodic_runs, quality, quality_classifier, sentencepiece_codec, suffix_dedup, token_alignment, token_counts, warc


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify(table(spark, folder, "documents"))


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.length_histogram(token_counts.encoded_lengths(table(spark, folder, "documents")))


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    left = suffix_dedup.remove_repeats(table(spark, folder, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: total + x["end"] - x["start"])
    return left.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    leaks = decontaminate.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return leaks.select("doc_id", "item_id", "shared", "similarity")


def op3_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract_text(table(spark, folder, "pages"))


def op6_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, folder, "documents"), k=4).select("doc_id", "n_shingles", "component_id", "kept")


def op7_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepiece_codec.round_trip(table(spark, folder, "documents"))


def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, folder, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.measured(table(spark, folder, "documents"))


def op11_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return token_alignment.alignment_digests(table(spark, folder, "documents"))


def op12_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_classifier.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.find_runs(periodic_runs.planted(table(spark, folder, "documents"))))


# every window that holds a shingle of the item is tried; items have five words or more
OP2_SQL = r"""
with w as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') ws from documents),
  b as (select item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') ws from benchmark),
  d as (select doc_id, n, p, ws[p + 1:p + 5] g from (select doc_id, ws, len(ws) n, unnest(range(0, len(ws) - 4)) p from w where len(ws) >= 5)),
  i as (select item_id, n, p, ws[p + 1:p + 5] g from (select item_id, ws, len(ws) n, unnest(range(0, len(ws) - 4)) p from b where len(ws) >= 5)),
  ic as (select item_id, g, count(*) c from i group by all),
  near as (select distinct d.doc_id, d.n, i.item_id, i.n size, d.p from d join i using (g)),
  starts as (select distinct doc_id, item_id, size, least(n, size) - 4 runs, unnest(range(greatest(0, p - size + 5), 1 + least(p, greatest(0, n - size)))) s from near),
  wc as (select s.doc_id, s.item_id, s.size, s.runs, s.s, d.g, count(*) c from starts s join d on d.doc_id = s.doc_id and d.p >= s.s and d.p < s.s + s.runs group by all),
  sh as (select doc_id, item_id, runs, size - 4 item_runs, s, sum(least(wc.c, ic.c))::bigint shared from wc join ic using (item_id, g) group by all)
select doc_id, item_id, max(shared) shared, max(shared / (runs + item_runs - shared)) similarity
from sh where 100 * shared >= 80 * (runs + item_runs - shared) group by doc_id, item_id
"""

OP9_SQL = """
with p as (select page_id, coalesce(html, '') h from pages),
  d as (select page_id, octet_length(encode(h)) payload_bytes, upper(sha1(h)) x, h from p),
  g as (select h, max(page_id) top from p group by h)
select d.page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(x, (1 + 5 * (i // 4))::bigint, 5))::bigint >> (15 - 5 * (i % 4))) & 31), 1) for i in range(0, 32)], '') payload_digest,
  case when d.page_id = top then 'response' else 'revisit' end record_type,
  case when d.page_id <> top then top end refers_to,
  case when d.page_id = top then true end digest_ok
from d join g using (h)
"""

# a word window is kept as the list of its words, so equality is exact
OP10_SQL = r"""
with w as (select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents),
  grams as (select doc_id, i, ws[i:i+7] g from (select doc_id, ws, unnest(range(1, len(ws) - 6)) i from w where len(ws) >= 8)),
  again as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) c from grams) where c > 1),
  covered as (select doc_id, count(distinct j) n from (select doc_id, unnest(range(i, i + 8)) j from again) group by doc_id),
  lines as (select doc_id, l from (select doc_id, unnest(string_split(t, chr(10))) l from w) where regexp_matches(l, '[^\x20\x09-\x0D]')),
  dup as (select doc_id, count(*) n, count(*) - count(distinct l) d from lines group by doc_id),
  m as (select w.doc_id, len(ws) n_words, coalesce(list_sum([length(x) for x in ws]), 0)::bigint word_chars,
      length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) n_symbols, coalesce(d, 0) n_dup_lines, coalesce(covered.n, 0) n_repeat_words, coalesce(dup.n, 0) n_lines
    from w left join dup using (doc_id) left join covered using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words or word_chars < 2 * n_words or word_chars > 20 * n_words
    or 10 * n_symbols > n_words or 10 * n_dup_lines > 3 * n_lines) kept
from m
"""

# crc32 by bits; runs of equal words at one lag from pairs of equal six words, which every run holds
OP13_SQL = """
with c as (select doc_id, coalesce(text, '') t, xor(4294967295, list_reduce(list_prepend(4294967295::bigint,
      flatten([[ascii(x)::bigint, -1, -1, -1, -1, -1, -1, -1, -1] for x in string_split(doc_id::varchar, '')])),
      lambda crc, v: case when v >= 0 then xor(crc, v) else xor(crc >> 1, case when crc % 2 = 1 then 3988292384 else 0 end) end)) h from documents),
  o as (select doc_id, h, h // 10 g, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws, len(ws)::bigint n from c),
  q as (select *, case when h % 10 = 0 and n > 0 then g % n end a, case when h % 10 = 0 and n > 0 then 1 + (n - g % n) // (3 + g % 8) end p from o),
  d as (select doc_id, n, case when a is null then ws else [case when i < a then ws[i + 1] else ws[a + (i - a) % p + 1] end for i in range(0, n)] end ws from q),
  gr as (select doc_id, i, ws[i + 1:i + 6] gram from (select doc_id, ws, unnest(range(0, n - 5)) i from d where n >= 12)),
  pr as (select x.doc_id, x.i, y.i - x.i lag from gr x join gr y on x.doc_id = y.doc_id and x.gram = y.gram and y.i > x.i),
  st as (select doc_id, lag, min(i) s, count(*) + 5 + lag len from (select *, i - row_number() over (partition by doc_id, lag order by i) isle from pr) z group by doc_id, lag, isle),
  rn as (select doc_id, s, len, min(lag) p from st where len >= greatest(12, 2 * lag) group by doc_id, s, len),
  dr as (select distinct doc_id, unnest(range(s + p, s + len)) i from rn),
  kept as (select w.doc_id, string_agg(w.x, ' ' order by w.i) t from (select doc_id, unnest(ws) x, unnest(range(0, n)) i from d) w
    anti join dr on w.doc_id = dr.doc_id and w.i = dr.i group by w.doc_id),
  ag as (select doc_id, count(*) n_runs, max_by((s, len, p), len * 1000000000 - s) b, string_agg(s || ',' || len || ',' || p || chr(10), '' order by s, p) l from rn group by doc_id)
select d.doc_id, coalesce(n_runs, 0) n_runs, b[1] "start", b[2] length, b[3] period, 1000 * b[2] // b[3] exponent_milli,
  sha256(coalesce(l, '')) runs_sha256, sha256(coalesce(kept.t, '')) collapsed_sha256
from d left join ag using (doc_id) left join kept using (doc_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_html_text": op3_html_text,
    "op4_language_id": op4_language_id,
    "op5_token_counts": op5_token_counts,
    "op6_near_dedup": op6_near_dedup,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_line_dedup": op8_line_dedup,
    "op9_warc": op9_warc,
    "op10_quality_rules": op10_quality_rules,
    "op11_token_alignment": op11_token_alignment,
    "op12_quality_classifier": op12_quality_classifier,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLES = {"op2_decontamination": OP2_SQL, "op9_warc": OP9_SQL, "op10_quality_rules": OP10_SQL, "op13_periodic_runs": OP13_SQL}
