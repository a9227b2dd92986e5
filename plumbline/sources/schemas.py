"""Schemas of the persisted relations."""

from __future__ import annotations

from pyspark.sql.types import StructType

PASSAGE = "struct<passage_id:string,text:string,is_answer_bearing:boolean,is_injected:boolean>"
_DDL = {
    "case": f"case_id string, query string, passages array<{PASSAGE}>, answer string, dimension string, perturbation_type string, noise_ratio double, seed_source string, seed_id string, gen_params map<string,string>",
    "seed": f"seed_id string, source string, query string, answer string, passages array<{PASSAGE}>, extra_passages array<{PASSAGE}>, meta map<string,string>",
    "embedding": "passage_id string, vector array<float>",
    "result": "key string, case_id string, config_id string, dimension string, noise_ratio double, final_answer string, raw_text string, reasoning_trace string, retrieved_passage_ids array<string>, prompt_tokens long, completion_tokens long, truncated boolean, error string, latency_s double",
    "scored": "config_id string, case_id string, dimension string, category string, answer_correct boolean, is_answerable boolean, noise_ratio double, crs_score int, final_answer string, seed_id string, truncated boolean",
    "ratios": "key string, dimension string, pipeline_class string, faithfulness double, answer_relevance double, context_relevance double",
    "label_sheet": "case_id string, dimension string, question_no int, question string, answer_yes_no string, notes string",
    "cache": "key string, model string, text string, prompt_tokens long, completion_tokens long, latency_s double, created_at timestamp",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(_DDL[name])
