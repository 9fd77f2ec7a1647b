"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import byte_bpe, chat, divergence, edit_embedding, exact_dedup, filter_audit, nbsvm, packing, simhash, source_mix, substring_dedup, suffix_tree, training_order

QUERIES = {
    f.__name__: f
    for f in (
        suffix_tree.op1_suffix_tree,
        exact_dedup.op2_exact_dedup,
        chat.op3_chat,
        packing.op4_packing,
        training_order.op5_training_order,
        edit_embedding.op6_fingerprints,
        substring_dedup.op7_substring_dedup,
        byte_bpe.op8_byte_bpe,
        nbsvm.op9_quality,
        simhash.op10_simhash,
        source_mix.op11_source_mix,
        divergence.op12_source_divergence,
        filter_audit.op13_filter_audit,
    )
}

ORACLE_SQL = {"op2_exact_dedup": exact_dedup.ORACLE_SQL, "op3_chat": chat.ORACLE_SQL, "op11_source_mix": source_mix.ORACLE_SQL, "op12_source_divergence": divergence.ORACLE_SQL, "op13_filter_audit": filter_audit.ORACLE_SQL}
