"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from verilake.llm import bpe, chunks, collocations, fingerprints, html_text, language, media, mixing, runs, search, simhash, suffixes, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_html": html_text.op2_html,
    "op3_suffixes": suffixes.op3_suffixes,
    "op4_language": language.op4_language,
    "op5_media": media.op5_media,
    "op6_search": search.op6_search,
    "op7_chunks": chunks.op7_chunks,
    "op8_bpe": bpe.op8_bpe,
    "op9_mixing": mixing.op9_mixing,
    "op10_simhash": simhash.op10_simhash,
    "op11_runs": runs.op11_runs,
    "op12_fingerprints": fingerprints.op12_fingerprints,
    "op13_collocations": collocations.op13_collocations,
}

SQL = {
    "op9_mixing": mixing.SQL,
    "op13_collocations": collocations.SQL,
}
