"""Queries and DuckDB SQL of the corpus operators."""

from __future__ import annotations

from .decontamination import op10_template_leaks
from .embedding_dedup import OP12_SQL, op12_int8_tiles
from .filter_audit import OP13_SQL, op13_filter_audit
from .jaccard_join import op4_chosen_path_join
from .line_dedup import OP8_SQL, op8_winnowed_lines
from .mixing import op1_mix_sources
from .passage_dedup import op5_passage_dedup
from .periodic_runs import op11_baier_runs
from .pii import op2_pii_boosting
from .quality_classifier import op9_attention_mil
from .quality_rules import op3_quality_rules
from .sharding import op6_histogram_shards
from .warc import op7_warc_derivatives


def queries() -> dict:
    return {
        "op1_mix_sources": op1_mix_sources,
        "op2_pii_boosting": op2_pii_boosting,
        "op3_quality_rules": op3_quality_rules,
        "op4_chosen_path_join": op4_chosen_path_join,
        "op5_passage_dedup": op5_passage_dedup,
        "op6_histogram_shards": op6_histogram_shards,
        "op7_warc_derivatives": op7_warc_derivatives,
        "op8_winnowed_lines": op8_winnowed_lines,
        "op9_attention_mil": op9_attention_mil,
        "op10_template_leaks": op10_template_leaks,
        "op11_baier_runs": op11_baier_runs,
        "op12_int8_tiles": op12_int8_tiles,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict:
    return {"op8_winnowed_lines": OP8_SQL, "op12_int8_tiles": OP12_SQL, "op13_filter_audit": OP13_SQL}
