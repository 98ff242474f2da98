"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .op1_toxicity import op1_toxicity
from .op2_decontaminate import op2_decontamination
from .op3_html import op3_html_main_text
from .op4_warc import OP4_SQL, op4_warc_segments
from .op5_substring import op5_substring_dedup
from .op6_quality import op6_quality
from .op7_simhash import op7_simhash_near_dedup
from .op8_tokens import op8_token_files
from .op9_exact_dedup import OP9_SQL, op9_exact_dedup
from .op10_mixing import op10_mixing
from .op11_fill_middle import OP11_SQL, op11_fill_middle
from .op12_graph_search import op12_graph_search
from .op13_runs import op13_periodic_runs

QUERIES = {f.__name__: f for f in (
    op1_toxicity,
    op2_decontamination,
    op3_html_main_text,
    op4_warc_segments,
    op5_substring_dedup,
    op6_quality,
    op7_simhash_near_dedup,
    op8_token_files,
    op9_exact_dedup,
    op10_mixing,
    op11_fill_middle,
    op12_graph_search,
    op13_periodic_runs,
)}

ORACLE = {"op4_warc_segments": OP4_SQL, "op9_exact_dedup": OP9_SQL, "op11_fill_middle": OP11_SQL}
