"""The queries of the subpackage and their SQL."""

from __future__ import annotations

from kestrel.llm import bpe, decontaminate, html_text, langid, lattice_lm, license_scan, simhash, topk, toxicity, warc

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_language_id": langid.op2_language_id,
    "op3_simhash": simhash.op3_simhash,
    "op4_html_text": html_text.op4_html_text,
    "op5_bpe": bpe.op5_bpe,
    "op6_warc": warc.op6_warc,
    "op7_lattice_lm": lattice_lm.op7_lattice_lm,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_top_k": topk.op10_top_k,
}
SQL = {"op1_license_scan": license_scan.oracle(), "op6_warc": warc.SQL, "op10_top_k": topk.SQL}
