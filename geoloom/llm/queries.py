"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from .decontamination import OP1_SQL, op1_decontamination
from .fill_in_middle import OP11_SQL, op11_fill_in_middle
from .filter_audit import OP12_SQL, op12_filter_audit
from .hidden_markov import op10_language_model
from .language_id import op13_language_id
from .line_dedup import OP2_SQL, op2_line_dedup
from .neighbours import OP7_SQL, op7_nearest
from .packing import op4_best_fit_packing
from .quality import op5_quality
from .simhash import op6_simhash
from .toxicity import op9_toxicity
from .url_filter import op3_url_filter
from .warc import OP8_SQL, op8_warc

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_line_dedup": op2_line_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_quality": op5_quality,
    "op6_simhash": op6_simhash,
    "op7_nearest": op7_nearest,
    "op8_warc": op8_warc,
    "op9_toxicity": op9_toxicity,
    "op10_language_model": op10_language_model,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_filter_audit": op12_filter_audit,
    "op13_language_id": op13_language_id,
}

ORACLE_SQL = {
    "op1_decontamination": OP1_SQL,
    "op2_line_dedup": OP2_SQL,
    "op7_nearest": OP7_SQL,
    "op8_warc": OP8_SQL,
    "op11_fill_in_middle": OP11_SQL,
    "op12_filter_audit": OP12_SQL,
}
