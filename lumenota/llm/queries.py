"""The registered queries of the operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from lumenota.llm import (
    audit,
    decontaminate,
    fertility,
    licenses,
    mixing,
    neardup,
    privacy,
    repeats,
    sharding,
    spelling,
    toxicity,
    urls,
    warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": urls.op1_url_filter,
    "op2_near_duplicates": neardup.op2_near_duplicates,
    "op3_source_mix": mixing.op3_source_mix,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_repeated_strings": repeats.op6_repeated_strings,
    "op7_personal_data": privacy.op7_personal_data,
    "op8_warc_transactions": warc.op8_warc_transactions,
    "op9_hilbert_shards": sharding.op9_hilbert_shards,
    "op10_token_fertility": fertility.op10_token_fertility,
    "op11_filter_interaction": audit.op11_filter_interaction,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_spelling_variants": spelling.op13_spelling_variants,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {
    "op3_source_mix": mixing.OP3_SQL,
    "op5_decontamination": decontaminate.OP5_SQL,
    "op8_warc_transactions": warc.OP8_SQL,
    "op11_filter_interaction": audit.OP11_SQL,
}
