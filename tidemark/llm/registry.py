"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import brown_lm, exact_dedup, fill_middle, jaccard_join, main_text, mixing, phrases, quality_model, quality_rules, sentence_pieces, suffix_dedup, toxicity, warc

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_brown_lm": brown_lm.op3_brown_lm,
    "op4_sentence_pieces": sentence_pieces.op4_sentence_pieces,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_warc_derivatives": warc.op6_warc_derivatives,
    "op7_quality_model": quality_model.op7_quality_model,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_mixing": mixing.op9_mixing,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
    "op11_fill_middle": fill_middle.op11_fill_middle,
    "op12_main_text": main_text.op12_main_text,
    "op13_phrases": phrases.op13_phrases,
}
SQL = {"op5_exact_dedup": exact_dedup.SQL, "op8_quality_rules": quality_rules.SQL, "op9_mixing": mixing.SQL, "op10_jaccard_join": jaccard_join.SQL, "op11_fill_middle": fill_middle.SQL, "op13_phrases": phrases.SQL}
