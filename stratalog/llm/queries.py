"""The subpackage's queries and their SQL, for the driver's entry file."""

from __future__ import annotations

from . import alignment, conversations, decontaminate, exact_dedup, langid, license_scan, line_dedup, packing, quality, simhash, sketch, token_count, warc

QUERIES = {
    "op1_best_fit_packing": packing.query,
    "op2_warc": warc.query,
    "op3_quality_ranking": quality.query,
    "op4_line_dedup": line_dedup.query,
    "op5_token_counts": token_count.query,
    "op6_license_scan": license_scan.query,
    "op7_exact_dedup": exact_dedup.query,
    "op8_decontamination": decontaminate.query,
    "op9_simhash_near_dedup": simhash.query,
    "op10_language_id": langid.query,
    "op11_conversation_repair": conversations.query,
    "op12_token_alignment": alignment.query,
    "op13_scaled_sketch": sketch.query,
}

SQL = {
    "op2_warc": warc.SQL,
    "op4_line_dedup": line_dedup.SQL,
    "op7_exact_dedup": exact_dedup.SQL,
    "op13_scaled_sketch": sketch.SQL,
}
