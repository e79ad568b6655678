"""The ONNX path on a tiny model made here: a table of word vectors, looked up by token."""

import json

import numpy as np
import pytest

from quillmark.operators.embedders import OnnxEmbedder, _model, with_vectors

DIM = 6


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, value):
    """One field of a protocol buffer message: a whole number, or bytes."""
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def tensor_of(name, kind, shape):
    dims = b"".join(field(1, field(2, d) if isinstance(d, str) else field(1, d)) for d in shape)
    return field(1, name) + field(2, field(1, field(1, kind) + field(2, dims)))


def write_model(folder, table, inputs):
    """Inputs are whole numbers by batch and place; the output is the table's rows at input_ids."""
    node = field(1, "table") + field(1, "input_ids") + field(2, "states") + field(4, "Gather")
    held = b"".join(field(1, d) for d in table.shape) + field(2, 1) + field(8, "table") + field(9, table.astype("<f4").tobytes())
    graph = field(1, node) + field(2, "tiny") + field(5, held)
    graph += b"".join(field(11, tensor_of(i, 7, ["batch", "place"])) for i in inputs)
    graph += field(12, tensor_of("states", 1, ["batch", "place", DIM]))
    (folder / "model.onnx").write_bytes(field(1, 8) + field(7, graph) + field(8, field(1, "") + field(2, 13)))
    words = {"[PAD]": 0, "[UNK]": 1, "cache": 2, "expires": 3, "Represent": 4}
    (folder / "tokenizer.json").write_text(
        json.dumps({"version": "1.0", "added_tokens": [], "pre_tokenizer": {"type": "WhitespaceSplit"}, "model": {"type": "WordLevel", "vocab": words, "unk_token": "[UNK]"}})
    )


@pytest.mark.parametrize("inputs", [["input_ids"], ["input_ids", "attention_mask", "token_type_ids"]])
def test_first_token_pooling_unit_length_and_truncation(spark, tmp_path, inputs):
    table = np.arange(1, 5 * DIM + 1, dtype=float).reshape(5, DIM) ** 1.5
    write_model(tmp_path, table, inputs)
    embedder = OnnxEmbedder(str(tmp_path), dim=DIM)
    unit = table / np.linalg.norm(table, axis=1, keepdims=True)
    texts = ["expires cache", "cache " + "x " * 1000, "nothing known", "cache"]
    assert np.allclose(embedder.embed(texts), unit[[3, 2, 1, 2]], atol=1e-6)
    tokenizer, _ = _model(str(tmp_path), 1)
    assert [len(e.ids) for e in tokenizer.encode_batch(texts)] == [512] * 4  # cut, and padded to the longest
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r.id: r.vector for r in with_vectors(df, "text", embedder).collect()}
    assert all(np.allclose(got[i], unit[k], atol=1e-5) for i, k in enumerate([3, 2, 1, 2]))
    asked = with_vectors(df, "text", embedder, query=True).first().vector  # the prefix comes first
    assert np.allclose(asked, unit[4], atol=1e-5)
    assert embedder.embed([]).shape == (0, DIM)
