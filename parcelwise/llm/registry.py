"""Registered queries of the numbered operators and their oracle SQL."""
from . import (op1_spotsigs, op2_ngram_join, op3_pitman_yor, op4_secrets, op5_chat_tree, op6_wrappers, op7_line_crf, op8_packing, op9_mixing,
               op10_surrogates, op11_chat_repair, op12_kernel_quality, op13_whitening)

_OPERATORS = (op1_spotsigs, op2_ngram_join, op3_pitman_yor, op4_secrets, op5_chat_tree, op6_wrappers, op7_line_crf, op8_packing, op9_mixing,
              op10_surrogates, op11_chat_repair, op12_kernel_quality, op13_whitening)

QUERIES = {m.NAME: m.query for m in _OPERATORS}
ORACLES = {m.NAME: m.ORACLE_SQL for m in _OPERATORS if m.ORACLE_SQL is not None}
