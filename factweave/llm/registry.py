"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from importlib import import_module

#: Module of each operator; a module has a function named like the query and maybe SQL for it.
MODULES = {
    "op1_bestfit_packing": "packing",
    "op2_exact_dedup": "exact_dedup",
    "op3_quality_rules": "quality_rules",
    "op4_lm_scoring": "lm_scoring",
    "op5_quality_classifier": "quality_classifier",
    "op6_secret_scan": "secret_scan",
    "op7_line_dedup": "line_dedup",
    "op8_minhash_dedup": "minhash_dedup",
    "op9_mixing": "mixing",
    "op10_substring_dedup": "substring_dedup",
    "op11_fill_in_middle": "fill_in_middle",
    "op12_token_counts": "token_counts",
    "op13_centroid_clustering": "centroid_clustering",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in MODULES.values():
        out |= getattr(import_module(f"{__package__}.{module}"), "SQL", {})
    return out
