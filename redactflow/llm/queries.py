"""The registered queries of this subpackage: name -> (query, oracle SQL or None)."""

from __future__ import annotations

from redactflow.llm.collocations import OP13_SQL, op13_phrase_collocations
from redactflow.llm.dac_files import op12_token_id_output
from redactflow.llm.decontaminate import op2_benchmark_decontamination
from redactflow.llm.html_extract import op1_html_extraction
from redactflow.llm.language_id import op9_language_id
from redactflow.llm.line_dedup import OP8_COUNTS_SQL, OP8_SQL, op8_line_dedup, op8_line_reference_counts
from redactflow.llm.minhash import OP4_SQL, op4_minhash_near_dedup
from redactflow.llm.packing import op3_packing
from redactflow.llm.periodic_runs import op11_periodic_runs
from redactflow.llm.pu_quality import op10_quality_classifier
from redactflow.llm.quality_rules import OP6_ABLATION_SQL, OP6_SQL, op6_quality_rules, op6_rule_ablation
from redactflow.llm.suffix_dedup import OP7_SQL, op7_suffix_array_dedup
from redactflow.llm.token_files import op5_token_counts

QUERIES = {
    "op1_html_extraction": (op1_html_extraction, None),
    "op2_benchmark_decontamination": (op2_benchmark_decontamination, None),
    "op3_packing": (op3_packing, None),
    "op4_minhash_near_dedup": (op4_minhash_near_dedup, OP4_SQL),
    "op5_token_counts": (op5_token_counts, None),
    "op6_quality_rules": (op6_quality_rules, OP6_SQL),
    "op7_suffix_array_dedup": (op7_suffix_array_dedup, OP7_SQL),
    "op8_line_dedup": (op8_line_dedup, OP8_SQL),
    "op9_language_id": (op9_language_id, None),
    "op10_quality_classifier": (op10_quality_classifier, None),
    "op11_periodic_runs": (op11_periodic_runs, None),
    "op12_token_id_output": (op12_token_id_output, None),
    "op13_phrase_collocations": (op13_phrase_collocations, OP13_SQL),
    # further parts of the methods of operators 6 and 8, over whole tables
    "op6_rule_ablation": (op6_rule_ablation, OP6_ABLATION_SQL),
    "op8_line_reference_counts": (op8_line_reference_counts, OP8_COUNTS_SQL),
}
