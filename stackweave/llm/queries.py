"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from stackweave.llm import (decontaminate, exact, fingerprints, infill, licenses, mixing, near, pages, periods, personal, repeats,
                            token_files, toxicity)

QUERIES = {f.__name__: f for f in (
    licenses.op1_license_scans, pages.op2_html_extraction, personal.op3_pii, near.op4_ngram_jaccard_join, mixing.op5_mix_sources,
    fingerprints.op6_document_fingerprints, toxicity.op7_toxicity, token_files.op8_token_files,
    decontaminate.op9_benchmark_decontamination, repeats.op10_substring_dedup, exact.op11_exact_dedup, infill.op12_fill_in_middle,
    periods.op13_periodic_runs)}

#: Queries that SQL can express; the others are tested against brute force, round trips or held-out labels.
ORACLE = {
    "op1_license_scans": licenses.SQL, "op4_ngram_jaccard_join": near.SQL, "op6_document_fingerprints": fingerprints.SQL,
    "op9_benchmark_decontamination": decontaminate.SQL, "op10_substring_dedup": repeats.SQL,
    "op11_exact_dedup": exact.SQL, "op12_fill_in_middle": infill.SQL, "op13_periodic_runs": periods.SQL,
}
