"""Embedders (E1-E4): a protocol, the hashing default and an ONNX model where one is supplied."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.config import EMBED_DIM, EMBED_MAX_TOKENS, QUERY_PREFIX

BATCH = 32
_WORD = re.compile(r"[^\W_]+")


class Embedder(Protocol):
    """Texts to unit vectors. Instances travel to the executors, so they hold settings, not models."""

    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Counts of words by hash bucket, scaled to length 1: deterministic, and the same as the SQL form."""

    def __init__(self, dim: int = EMBED_DIM):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, text in enumerate(texts):
            for w in _WORD.findall(text.lower()):
                out[i, _bucket(w, self.dim)] += 1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


@cache
def _bucket(word: str, dim: int) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dim


class OnnxEmbedder:
    """A sentence model in a directory with tokenizer.json and model.onnx: first-token pooling, unit length."""

    def __init__(self, directory: str, dim: int = EMBED_DIM, threads: int = 1):
        for name in ("tokenizer.json", "model.onnx"):
            if not os.path.exists(os.path.join(directory, name)):
                raise FileNotFoundError(f"{directory} has no {name}")
        self.directory, self.dim, self.threads = directory, dim, threads

    def embed(self, texts: list[str]) -> np.ndarray:
        tokenizer, session = _model(self.directory, self.threads)
        wanted = {i.name for i in session.get_inputs()}
        out = []
        for a in range(0, len(texts), BATCH):
            coded = tokenizer.encode_batch(texts[a : a + BATCH])
            fields = {
                "input_ids": [c.ids for c in coded], "attention_mask": [c.attention_mask for c in coded], "token_type_ids": [c.type_ids for c in coded],
            }
            states = session.run(None, {k: np.array(v, np.int64) for k, v in fields.items() if k in wanted})[0]
            first = states[:, 0, :].astype(np.float64)
            out.append(first / np.maximum(np.linalg.norm(first, axis=1, keepdims=True), 1e-12))
        return np.concatenate(out) if out else np.zeros((0, self.dim))


@cache
def _model(directory: str, threads: int):
    """Tokenizer and session, loaded once a worker process."""
    import onnxruntime
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(os.path.join(directory, "tokenizer.json"))
    tokenizer.enable_truncation(EMBED_MAX_TOKENS)
    tokenizer.enable_padding()
    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = threads
    options.graph_optimization_level = onnxruntime.GraphOptimizationLevel.ORT_ENABLE_ALL
    return tokenizer, onnxruntime.InferenceSession(os.path.join(directory, "model.onnx"), options, providers=["CPUExecutionProvider"])


def with_vectors(df: DataFrame, text_column: str, embedder: Embedder, into: str = "vector", query: bool = False) -> DataFrame:
    """df with a float vector of each text; queries get the query prefix first, documents none. Batches are
    sorted by length, so that padding is short. Null texts are embedded as empty ones."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            filled = [(QUERY_PREFIX if query else "") + (t or "") for t in texts]
            order = np.argsort([len(t) for t in filled], kind="stable")
            vectors = np.empty((len(filled), embedder.dim), np.float32)
            if len(order):
                vectors[order] = embedder.embed([filled[i] for i in order])
            yield pd.Series(list(vectors))

    return df.withColumn(into, embed(F.col(text_column)))
