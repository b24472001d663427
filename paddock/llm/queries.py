"""The operators as queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from . import decontam, fim, htmltext, licenses, linededup, lmscore, mixing, pii, quality, secrets, simhash, spelling, suffixdedup
from .common import table


def queries() -> dict:
    return {
        "op1_simhash_dedup": lambda s, d: simhash.simhash_components(table(s, d, "documents")),
        "op2_license_scan": lambda s, d: licenses.license_scan(table(s, d, "documents")).drop("text_licenses"),
        "op2_license_texts": lambda s, d: licenses.license_scan(table(s, d, "documents")).select("doc_id", "text_licenses"),
        "op2_license_rules": lambda s, d: licenses.license_rules(table(s, d, "documents")),
        "op3_lm_scoring": lambda s, d: lmscore.pseudo_likelihood(table(s, d, "documents")),
        "op4_suffix_dedup": lambda s, d: suffixdedup.dedup_substrings(table(s, d, "documents")).drop("spans"),
        "op5_source_mix": lambda s, d: mixing.mix_sources(table(s, d, "documents")),
        "op6_line_dedup": lambda s, d: linededup.report(table(s, d, "documents")).drop("tid"),
        "op7_secret_scan": lambda s, d: secrets.secret_report(table(s, d, "documents")),
        "op8_pii": lambda s, d: pii.pii_report(table(s, d, "documents")),
        "op9_quality_rules": lambda s, d: quality.quality_verdicts(table(s, d, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"),
        "op10_decontamination": lambda s, d: decontam.verdicts(table(s, d, "documents"), table(s, d, "benchmark")),
        "op11_spelling_variants": lambda s, d: spelling.spelling_variants(table(s, d, "documents")),
        "op12_fill_in_middle": lambda s, d: fim.digests(table(s, d, "documents")),
        "op13_html_extraction": lambda s, d: htmltext.page_texts(table(s, d, "pages")),
    }


DECONTAMINATION = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
p as (select distinct item_id, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as phrase, least(len(w), 10) as n
      from (select item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) as i from b where len(w) > 0)),
places as (select doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') as phrase
       from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from d, (select distinct n from p) where len(w) >= n)),
hits as (select distinct doc_id, i, n, item_id from places join p using (n, phrase)),
covered as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(generate_series(i, i + n - 1)) as k from hits) group by doc_id),
named as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct doc_id, item_id::varchar as id from hits) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (doc_id) left join named using (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_license_scan": licenses.sql(),
        "op2_license_rules": licenses.rules_sql(),
        "op5_source_mix": mixing.SQL.replace("{docs}", "documents"),
        "op10_decontamination": DECONTAMINATION,
        "op12_fill_in_middle": fim.SQL,
    }
