"""Registered queries of this subpackage and their SQL where SQL can express them."""

from __future__ import annotations

from vellum.llm import codes, exact, mixing, phrases, topk
from vellum.llm.bpe import op11_bpe
from vellum.llm.codes import op13_codes
from vellum.llm.exact import op6_exact_dedup
from vellum.llm.html import op8_html
from vellum.llm.langid import op2_langid
from vellum.llm.lines import op3_line_dedup
from vellum.llm.mixing import op5_mixing
from vellum.llm.packing import op7_packing
from vellum.llm.phrases import op12_phrases
from vellum.llm.pii import op10_pii
from vellum.llm.simhash import op1_simhash
from vellum.llm.topk import op4_topk
from vellum.llm.toxicity import op9_toxicity

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_langid": op2_langid,
    "op3_line_dedup": op3_line_dedup,
    "op4_topk": op4_topk,
    "op5_mixing": op5_mixing,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_packing": op7_packing,
    "op8_html": op8_html,
    "op9_toxicity": op9_toxicity,
    "op10_pii": op10_pii,
    "op11_bpe": op11_bpe,
    "op12_phrases": op12_phrases,
    "op13_codes": op13_codes,
}

ORACLE = {
    "op4_topk": topk.ORACLE,
    "op5_mixing": mixing.ORACLE,
    "op6_exact_dedup": exact.ORACLE,
    "op12_phrases": phrases.ORACLE,
    "op13_codes": codes.ORACLE,
}
