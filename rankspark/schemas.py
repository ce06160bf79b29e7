"""Schemas of inputs and of the engine's own tables, as DDL."""

from __future__ import annotations

DOCUMENTS = "id string, content string"
EXAMPLES = "id string, query string, gold_ids array<string>, negative_ids array<string>, image_paths array<string>"
EXAMPLES_MULTIMODAL = EXAMPLES + ", positive_images array<struct<image_path:string>>, negative_images array<struct<image_path:string>>"
EXAMPLES_MULTIMODAL_PLAIN = EXAMPLES + ", positive_images array<string>, negative_images array<string>"
IMAGES = "path string, bytes binary"

CORPUS = "domain string, doc_id string, pos bigint, content string"
QUERIES = "domain string, query_id string, query string, image_paths array<string>"
EXCLUSIONS = "domain string, query_id string, doc_id string"
QRELS = "domain string, query_id string, doc_id string, rel int"
EMBEDDINGS = "model string, domain string, modality string, id string, embedding array<float>"
RUN = "model string, domain string, query_id string, doc_id string, score double, rank int"
METRICS = "model string, task string, domain string, metric string, k int, value double"

#: An exclusion that stands for none.
NO_EXCLUSION = "N/A"
PAIR_SEPARATOR = "|||"
NO_IMAGE = "__NO_IMAGE__"
