"""The corpus operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import audit, chosen, codes, decontaminate, extract, lm, mixing, neighbours, passages, quality, sharding, simhash, warc

QUERIES = {
    f.__name__: f
    for f in (
        simhash.op1_simhash_near_dedup,
        sharding.op2_rendezvous_sharding,
        passages.op3_collinear_substring_dedup,
        extract.op4_crf_html_extraction,
        decontaminate.op5_benchmark_decontamination,
        lm.op6_elias_fano_lm,
        neighbours.op7_vantage_point_neighbours,
        quality.op8_quality_rff_ridge,
        warc.op9_content_addressed_warc,
        mixing.op10_pareto_mix,
        audit.op11_filter_interaction_audit,
        codes.op12_vector_codes,
        chosen.op13_chosen_path_near_dedup,
    )
} | {"pipeline": corpus_pipeline.run}

ORACLE_SQL = {
    "op5_benchmark_decontamination": decontaminate.ORACLE_OP5,
    "op7_vantage_point_neighbours": neighbours.ORACLE_OP7,
    "op11_filter_interaction_audit": audit.ORACLE_OP11,
    "op12_vector_codes": codes.ORACLE_OP12,
    "op13_chosen_path_near_dedup": chosen.ORACLE_OP13,
    "op9_content_addressed_warc": warc.ORACLE_OP9,
}
