"""The queries of this subpackage, and SQL where it can express them on whole tables."""

from plumbline.llm import bestfit, conversations, decontamination, html_text, language, mixing, neardup, neighbours, oracles, packing, quality, secrets, sharding, whitening

QUERIES = {
    "op1_neardup": neardup.op1_neardup,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_language": language.op3_language,
    "op4_sharding": sharding.op4_sharding,
    "op5_packing": packing.op5_packing,
    "op6_secrets": secrets.op6_secrets,
    "op7_neighbours": neighbours.op7_neighbours,
    "op8_quality": quality.op8_quality,
    "op9_html": html_text.op9_html,
    "op10_mixing": mixing.op10_mixing,
    "op11_conversations": conversations.op11_conversations,
    "op12_bestfit": bestfit.op12_bestfit,
    "op13_whitening": whitening.op13_whitening,
}

ORACLE_SQL = oracles.ORACLE_SQL
