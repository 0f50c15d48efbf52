"""Known embedding and re-ranking models; a backend for one is plugged in by name, nothing is downloaded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Name, kind, dimensions, longest input in tokens, recommended chunk size and overlap.
MODELS = """
paraphrase-multilingual-MiniLM-L12-v2 embedding 384 512 800 100
all-MiniLM-L6-v2 embedding 384 512 800 100
all-MiniLM-L12-v2 embedding 384 512 800 100
all-mpnet-base-v2 embedding 768 512 800 100
BAAI/bge-base-en-v1.5 embedding 768 512 800 100
BAAI/bge-large-en-v1.5 embedding 1024 512 800 100
BAAI/bge-m3 embedding 1024 8192 2048 256
nomic-ai/nomic-embed-text-v1.5 embedding 768 8192 2048 256
jinaai/jina-embeddings-v3 embedding 1024 8192 2048 256
Snowflake/snowflake-arctic-embed-l-v2.0 embedding 1024 8192 2048 256
Alibaba-NLP/gte-Qwen2-1.5B-instruct embedding 1536 32000 4096 512
paraphrase-MiniLM-L6-v2 embedding 384 512 800 100
multi-qa-MiniLM-L6-cos-v1 embedding 384 512 800 100
multi-qa-mpnet-base-cos-v1 embedding 768 512 800 100
openai/text-embedding-3-small embedding 1536 8192 2048 256
openai/text-embedding-3-large embedding 3072 8192 2048 256
voyage-ai/voyage-3 embedding 1024 32000 4096 512
cross-encoder/ms-marco-MiniLM-L-6-v2 reranker 0 512 800 100
cross-encoder/ms-marco-MiniLM-L-12-v2 reranker 0 512 800 100
cross-encoder/ms-marco-TinyBERT-L-2-v2 reranker 0 512 800 100
cross-encoder/stsb-TinyBERT-L-4 reranker 0 512 800 100
BAAI/bge-reranker-v2-m3 reranker 0 8192 800 100
BAAI/bge-reranker-base reranker 0 512 800 100
jinaai/jina-reranker-v2-base-multilingual reranker 0 8192 800 100
mixedbread-ai/mxbai-rerank-base-v1 reranker 0 512 800 100
"""
# What a model wants in front of queries and documents.
PREFIXES = {
    "nomic-ai/nomic-embed-text-v1.5": ("search_query: ", "search_document: "),
    "Snowflake/snowflake-arctic-embed-l-v2.0": ("Represent this sentence for searching relevant passages: ", ""),
}
SCHEMA = "name string, kind string, dimensions int, max_tokens int, chunk_size int, chunk_overlap int, query_prefix string, document_prefix string"


def models(spark: SparkSession, kind: str | None = None) -> DataFrame:
    """The catalog, or its models of one kind."""
    rows = []
    for line in MODELS.split("\n"):
        if line:
            name, what, *numbers = line.split()
            rows.append((name, what, *map(int, numbers), *PREFIXES.get(name, ("", ""))))
    out = spark.createDataFrame(rows, SCHEMA)
    return out if kind is None else out.filter(out["kind"] == kind)
