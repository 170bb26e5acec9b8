"""Explicit schemas of the stores, as DDL; ``struct`` needs a running session."""

from pyspark.sql import types as T


def struct(schema: str | T.StructType) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


ITEM = "item_id string, source_dataset string, source_version string, issue string, dimension string, country_context string, language string, source_language string, translation_origin string, translation_method string, translator_type string, independently_authored boolean, parallel_item_id string, translation_notes string, prompt_original string, reference_position string, reference_distribution map<string,double>, metadata map<string,string>"
VARIANT = "variant_id string, item_id string, language string, perturbation_type string, semantic_equivalence_status string, template_id string, variant_text string"
PROMPT = "variant_id string, item_id string, language string, render_mode string, template_id string, rendered_text string, rendered_prompt_hash string"
REQUEST = "struct<rendered_prompt_hash:string,rendered_text:string,model_id:string,model_revision:string,tokenizer_revision:string,backend:string,precision:string,decoding:struct<temperature:double,top_p:double,max_new_tokens:int,seed:int>,item_id:string,variant_id:string,template_id:string>"
GENERATION = f"cache_key string, request {REQUEST}, raw_text string, finish_reason string, input_tokens int, output_tokens int, latency_seconds double, gpu struct<physical_index:int,uuid:string,driver_version:string,power_limit_w:double>, error string, timestamp double, batch_size int"
EVALUATION = "generation_cache_key string, evaluator_id string, evaluator_version string, outcome string, confidence double, native_label string, notes string"
SHEET = "sample_id string, statement string, response string, relation string, mode string, confidence_1to3 string, notes string"
QUEUE = "sample_id string, relation_A string, relation_C string, mode_A string, mode_C string, commitment_differs string, relation_adjudicated string, mode_adjudicated string, adjudication_notes string"
