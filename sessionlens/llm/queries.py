"""The queries of this subpackage and the SQL that checks those SQL can express."""

from __future__ import annotations

from .cover_tree import op3_embedding_near_dedup
from .decontaminate import OP12_SQL, op12_benchmark_decontamination
from .fill_middle import OP11_SQL, op11_fill_in_middle
from .html_extract import op4_html_extraction
from .jaccard_join import op8_ngram_jaccard_join
from .mixing import OP5_SQL, op5_mixing
from .packing import op10_best_fit_packing
from .quality import op9_quality_rules
from .secret_scan import OP1_SQL, op1_secret_scan
from .spelling import op13_spelling_variants
from .substring_dedup import op7_substring_dedup
from .token_files import op6_token_files
from .toxicity import op2_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_toxicity, op3_embedding_near_dedup, op4_html_extraction, op5_mixing, op6_token_files,
        op7_substring_dedup, op8_ngram_jaccard_join, op9_quality_rules, op10_best_fit_packing,
        op11_fill_in_middle, op12_benchmark_decontamination, op13_spelling_variants,
    )
}
#: op2 to op4, op6 to op10 and op13 are held against brute force, round trips and held-out labels in tests.
ORACLES = {"op1_secret_scan": OP1_SQL, "op5_mixing": OP5_SQL, "op11_fill_in_middle": OP11_SQL, "op12_benchmark_decontamination": OP12_SQL}
