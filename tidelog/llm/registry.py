"""Registered queries of the subpackage and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline

from . import (
    byte_bpe,
    decontamination,
    imatch,
    language_id,
    near_dedup,
    secrets,
    sharding,
    toxicity,
    url_filter,
    warc,
)


def queries() -> dict:
    operators = (
        imatch.op1_imatch,
        byte_bpe.op2_byte_bpe,
        sharding.op3_rendezvous_sharding,
        near_dedup.op4_tensored_minhash,
        warc.op5_warc,
        url_filter.op6_url_vocabulary,
        language_id.op7_language_viterbi,
        decontamination.op8_prefix_decontamination,
        toxicity.op9_nearest_toxicity,
        secrets.op10_assignment_secrets,
    )
    return {f.__name__: f for f in operators} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_rendezvous_sharding": sharding.oracle(),
        "op4_tensored_minhash": near_dedup.oracle(),
        "op5_warc": warc.oracle(),
        "op6_url_vocabulary": url_filter.oracle(),
        "op8_prefix_decontamination": decontamination.oracle(),
    }
