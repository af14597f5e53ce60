"""The corpus queries and their SQL."""

from __future__ import annotations

from importlib import import_module

#: query -> (module, function, name of the module's SQL or None)
QUERIES = {
    "op1_mix_sources": ("mixing", "op1_mix_sources", "ORACLE"),
    "op2_simhash_near_dedup": ("simhash", "op2_simhash_near_dedup", None),
    "op3_token_counts": ("token_counts", "op3_token_counts", None),
    "op4_quality_classifier": ("quality", "op4_quality_classifier", None),
    "op5_line_dedup": ("line_dedup", "op5_line_dedup", "ORACLE"),
    "op6_lm_scoring": ("ngram_lm", "op6_lm_scoring", None),
    "op7_decontaminate": ("decontaminate", "op7_decontaminate", None),
    "op8_shard_documents": ("sharding", "op8_shard_documents", None),
    "op9_quality_rules": ("rules", "op9_quality_rules", "ORACLE"),
    "rule_ablations": ("rules", "rule_ablations", "ABLATIONS"),
    "op10_token_files": ("token_files", "op10_token_files", None),
    "op11_align_tokenizers": ("alignment", "op11_align_tokenizers", None),
    "op12_lexical_search": ("lexical", "op12_lexical_search", "ORACLE"),
    "op13_nearest_neighbours": ("neighbours", "op13_nearest_neighbours", "ORACLE"),
}


def _part(module: str, name: str):
    return getattr(import_module(f"{__package__}.{module}"), name)


def queries() -> dict:
    return {q: _part(module, name) for q, (module, name, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {q: _part(module, sql) for q, (module, _, sql) in QUERIES.items() if sql}
