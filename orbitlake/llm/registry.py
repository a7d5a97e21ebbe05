"""Queries of the corpus operators and the SQL of those that SQL can express."""

from . import fingerprint, language_id, line_dedup, mtree, packing, repair, secret_scan, simhash, source_mix, warc

QUERIES = {
    "op1_secret_scan": secret_scan.query,
    "op2_fingerprint": fingerprint.query,
    "op3_mix_sources": source_mix.query,
    "op4_language_id": language_id.query,
    "op5_warc": warc.query,
    "op6_line_dedup": line_dedup.query,
    "op7_repair_ids": repair.query,
    "op8_simhash_dedup": simhash.query,
    "op9_mtree_topk": mtree.query,
    "op10_packing": packing.query,
}
SQL = {
    "op1_secret_scan": secret_scan.SQL,
    "op2_fingerprint": fingerprint.SQL,
    "op3_mix_sources": source_mix.SQL,
    "op5_warc": warc.SQL,
    "op9_mtree_topk": mtree.SQL,
}
