"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from colligate.llm import collocations, decontamination, extraction, jaccard, language, neighbours, packing, pieces, quality, ranking, secrets, toxicity, warc

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_quality": quality.op2_quality,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_extraction": extraction.op4_extraction,
    "op5_secrets": secrets.op5_secrets,
    "op6_language": language.op6_language,
    "op7_sentencepiece": pieces.op7_sentencepiece,
    "op8_jaccard": jaccard.op8_jaccard,
    "op9_neighbours": neighbours.op9_neighbours,
    "op10_warc": warc.op10_warc,
    "op11_ranking": ranking.op11_ranking,
    "op12_decontamination": decontamination.op12_decontamination,
    "op13_collocations": collocations.op13_collocations,
}

ORACLE_SQL: dict[str, str] = {
    "op2_quality": quality.SQL,
    "op8_jaccard": jaccard.SQL,
    "op10_warc": warc.SQL,
    "op11_ranking": ranking.SQL,
    "op12_decontamination": decontamination.SQL,
    "op13_collocations": collocations.SQL,
}
