"""Queries of the training-data operators and their SQL twins, by name."""

from __future__ import annotations

from . import bpe, chat, decontaminate, extract, interactions, licences, mixing, neardup, neighbours, quality, spelling, urlfilter, warc

QUERIES = {
    "op1_minhash_near_dedup": neardup.query,
    "op2_warc": warc.query,
    "op3_mix_sources": mixing.query,
    "op4_extract_html": extract.query,
    "op5_bpe": bpe.query,
    "op6_nearest_neighbours": neighbours.query,
    "op7_url_filter": urlfilter.query,
    "op8_chat_perspectives": chat.query,
    "op9_quality_rules": quality.query,
    "op9_quality_ablations": quality.query_ablations,
    "op10_licence_scan": licences.query,
    "op11_filter_interactions": interactions.query,
    "op12_spelling_variants": spelling.query,
    "op13_decontaminate": decontaminate.query,
}

SQL = {
    "op1_minhash_near_dedup": neardup.SQL,
    "op2_warc": warc.SQL,
    "op3_mix_sources": mixing.SQL,
    "op7_url_filter": urlfilter.SQL,
    "op8_chat_perspectives": chat.SQL,
    "op9_quality_rules": quality.SQL,
    "op9_quality_ablations": quality.ABLATIONS_SQL,
    "op11_filter_interactions": interactions.SQL,
    "op12_spelling_variants": spelling.SQL,
    "op13_decontaminate": decontaminate.SQL,
}
