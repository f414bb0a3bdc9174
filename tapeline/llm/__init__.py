"""Operators for training-data pipelines, and the queries that apply them to whole tables."""

from tapeline.llm.bpe import op6_bpe
from tapeline.llm.collisions import op3_collisions
from tapeline.llm.hnsw import op1_hnsw
from tapeline.llm.huffman import op4_huffman
from tapeline.llm.language import op8_language
from tapeline.llm.minhash import op2_minhash
from tapeline.llm.packing import op7_packing
from tapeline.llm.pii import op9_pii
from tapeline.llm.quality import op5_quality
from tapeline.llm.toxicity import op10_toxicity

QUERIES = {f.__name__: f for f in (op1_hnsw, op2_minhash, op3_collisions, op4_huffman, op5_quality, op6_bpe, op7_packing, op8_language, op9_pii, op10_toxicity)}
ORACLE_SQL: dict[str, str] = {}
