"""Queries of the training-data operators and the SQL that says what they return."""

from __future__ import annotations

from loamworks.llm import avi, decontam, html_text, langid, mixing, neardup, oracles, pii, prefix_trie, quality, secrets, segment_search, token_counts, turn_repair
from loamworks.session import read_table

import corpus_pipeline


def _over(operator, *tables: str):
    """A query that applies an operator to whole tables."""
    return lambda spark, sf_dir: operator(*[read_table(spark, sf_dir, t) for t in tables])


def queries() -> dict:
    return {
        "op1_pii": _over(pii.digest, "documents"),
        "op2_mixing": _over(mixing.digest, "documents"),
        "op3_secrets": _over(secrets.digest, "documents"),
        "op4_html_text": _over(html_text.digest, "pages"),
        "op5_token_counts": _over(token_counts.token_counts, "documents"),
        "op6_avi": _over(avi.digest, "documents"),
        "op7_decontam": _over(decontam.digest, "documents", "benchmark"),
        "op8_langid": _over(langid.digest, "documents"),
        "op9_neardup": _over(neardup.digest, "documents"),
        "op10_quality": _over(quality.digest, "documents", "labels"),
        "op11_topk": _over(segment_search.digest, "embeddings"),
        "op12_prefix_trie": _over(prefix_trie.digest, "conversations"),
        "op13_turn_repair": _over(turn_repair.digest, "conversations"),
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": oracles.OP2, "op11_topk": oracles.OP11, "op12_prefix_trie": oracles.OP12, "op13_turn_repair": oracles.OP13}
