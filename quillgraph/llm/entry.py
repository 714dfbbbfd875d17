"""Queries and SQL of the training-data operators, as ``__spark_entry__.py`` registers them."""

from __future__ import annotations

import importlib

#: name -> module of this subpackage
_OPERATORS = {
    "op1_bpe": "op1_bpe",
    "op2_records": "op2_records",
    "op3_embedding_dedup": "op3_embeddings",
    "op4_decontaminate": "op4_decontaminate",
    "op5_warc": "op5_warc",
    "op6_pii": "op6_pii",
    "op7_near_dedup": "op7_minhash",
    "op8_langid": "op8_langid",
    "op9_license_scan": "op9_licenses",
    "op10_chat_format": "op10_chat",
    "op11_sentencepiece": "op11_pieces",
    "op12_centroids": "op12_clusters",
    "op13_sale_versions": "op13_valid_time",
}
_SQL = {"op9_license_scan": ("op9_licenses", "OP9_SQL"), "op3_embedding_dedup": ("op3_embeddings", "OP3_SQL"), "op5_warc": ("op5_warc", "OP5_SQL"), "op10_chat_format": ("op10_chat", "OP10_SQL"), "op12_centroids": ("op12_clusters", "OP12_SQL"), "op13_sale_versions": ("op13_valid_time", "OP13_SQL")}


def _module(name: str):
    return importlib.import_module(f"{__package__}.{name}")


def queries() -> dict:
    return {name: getattr(_module(module), name) for name, module in _OPERATORS.items()}


def oracle_sql() -> dict:
    return {name: getattr(_module(module), sql) for name, (module, sql) in _SQL.items()}
