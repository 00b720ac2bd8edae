"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

_AT = {
    "op1_neighbours": ("neighbours", "op1"),
    "op2_suffix_dedup": ("suffix_dedup", "op2"),
    "op3_substring_dedup": ("substring_dedup", "op3"),
    "op4_line_dedup": ("line_dedup", "op4"),
    "op5_quality_rules": ("quality_rules", "op5"),
    "op6_quality_classifier": ("quality_classifier", "op6"),
    "op7_near_duplicates": ("near_duplicates", "op7"),
    "op8_source_mixing": ("mixing", "op8"),
    "op9_sentencepiece": ("piece_codec", "op9"),
    "op10_secret_scan": ("secret_scan", "op10"),
    "op11_prefix_trie": ("prefix_trie", "op11"),
    "op12_byte_bpe": ("byte_codec", "op12"),
    "op13_centroids": ("centroids", "op13"),
}


def queries():
    return {name: getattr(import_module(f"{__package__}.{module}"), function) for name, (module, function) in _AT.items()}


def oracle_sql():
    from .centroids import OP13_SQL
    from .line_dedup import OP4_SQL
    from .mixing import OP8_SQL
    from .near_duplicates import OP7_SQL
    from .prefix_trie import OP11_SQL
    from .substring_dedup import OP3_SQL
    from .suffix_dedup import OP2_SQL

    return {"op2_suffix_dedup": OP2_SQL, "op3_substring_dedup": OP3_SQL, "op4_line_dedup": OP4_SQL, "op7_near_duplicates": OP7_SQL, "op8_source_mixing": OP8_SQL, "op11_prefix_trie": OP11_SQL, "op13_centroids": OP13_SQL}
