"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline

from .decontaminate import op6_decontaminate
from .html_extract import op1_html_extract
from .mixing import op2_mix_sources
from .preferences import op10_preferences
from .quality import op9_quality
from .runs import op12_word_runs
from .sanitise import op13_personal_data
from .simhash import op5_simhash
from .sql import ORACLES  # noqa: F401
from .suffix_dedup import op4_suffix_dedup
from .tokens import op3_token_counts
from .topk import op7_top_k
from .url_filter import op8_url_filter
from .whitening import op11_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_html_extract,
        op2_mix_sources,
        op3_token_counts,
        op4_suffix_dedup,
        op5_simhash,
        op6_decontaminate,
        op7_top_k,
        op8_url_filter,
        op9_quality,
        op10_preferences,
        op11_whitening,
        op12_word_runs,
        op13_personal_data,
    )
}
QUERIES["pipeline"] = corpus_pipeline.run
