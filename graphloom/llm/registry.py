"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from graphloom.llm.chat import OP7_SQL, op7_perspective_rotation
from graphloom.llm.fill_middle import OP12_SQL, op12_fill_in_middle
from graphloom.llm.forest import op8_prefix_forest
from graphloom.llm.language import op9_language_fusion, op9_language_fusion_pages
from graphloom.llm.line_dedup import op6_line_dedup
from graphloom.llm.merkle import OP11_SQL, op11_merkle_manifest
from graphloom.llm.mixing import op2_source_mixing
from graphloom.llm.packing import op5_best_fit_packing
from graphloom.llm.repeats import op13_repeated_passages
from graphloom.llm.simhash import op10_simhash_components
from graphloom.llm.toxicity import op3_toxicity
from graphloom.llm.warc import OP4_SQL, op4_warc_captures
from graphloom.llm.weighted_sampling import op1_weighted_fingerprints

QUERIES = {
    "op1_weighted_fingerprints": op1_weighted_fingerprints,
    "op2_source_mixing": op2_source_mixing,
    "op3_toxicity": op3_toxicity,
    "op4_warc_captures": op4_warc_captures,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_line_dedup": op6_line_dedup,
    "op7_perspective_rotation": op7_perspective_rotation,
    "op8_prefix_forest": op8_prefix_forest,
    "op9_language_fusion": op9_language_fusion,
    "op9_language_fusion_pages": op9_language_fusion_pages,
    "op10_simhash_components": op10_simhash_components,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_repeated_passages": op13_repeated_passages,
}

ORACLES: dict[str, str] = {"op4_warc_captures": OP4_SQL, "op7_perspective_rotation": OP7_SQL, "op11_merkle_manifest": OP11_SQL, "op12_fill_in_middle": OP12_SQL}
