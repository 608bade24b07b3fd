"""Encoded batches and batch predictors: plug-in points for subword tokenizers and neural models.

A plug-in is a function without arguments that makes the encoder or predictor; it runs once per
Python worker, and its failure fails the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.labels import LABELS


def tokenizer_file(path: str) -> Callable:
    """An encoder of a `tokenizers` JSON file: texts -> lists of ids."""

    def make():
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]

    return make


def encode(rows: DataFrame, make: Callable, max_length: int = 256, start: int | None = None, end: int | None = None, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, input_ids, attention_mask, n_tokens): ids cut to max_length; n_tokens counts before the cut, with the special ids.

    start and end are put around the ids and count towards max_length. A NULL text is the empty
    one. :func:`quern.operators.models.truncation` sums up n_tokens.
    """
    special = (start is not None) + (end is not None)
    if not special < max_length:
        raise ValueError("max_length leaves no room for a token")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make()
        for b in batches:
            ids = encoder([t or "" for t in b.column(1).to_pylist()])
            full = [len(x) + special for x in ids]
            cut = [([start] if start is not None else []) + list(x[: max_length - special]) + ([end] if end is not None else []) for x in ids]
            mask = [[1] * len(x) for x in cut]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cut, pa.list_(pa.int64())), pa.array(mask, pa.list_(pa.int64())), pa.array(full, pa.int32())], ["id", "input_ids", "attention_mask", "n_tokens"])

    kind = rows.schema[id_col].dataType.simpleString()
    src = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"id {kind}, input_ids array<bigint>, attention_mask array<bigint>, n_tokens int")


def predict_batches(rows: DataFrame, make: Callable, batch_size: int = 16, labels: Sequence[str] = LABELS, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, predicted_label, probabilities) of a model that gives one row of logits per text, in the order of ``labels``.

    Ties go to the first label. Logits of another shape are an error.
    """
    k = len(labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            parts = [np.asarray(model(texts[i : i + batch_size]), dtype=np.float64) for i in range(0, len(texts), batch_size)]
            logits = np.concatenate(parts) if parts else np.zeros((0, k))
            if logits.shape != (len(texts), k):
                raise ValueError(f"expected logits of shape {(len(texts), k)}, got {logits.shape}")
            e = np.exp(logits - logits.max(axis=1, keepdims=True)) if len(texts) else logits
            p = e / e.sum(axis=1, keepdims=True) if len(texts) else e
            best = pa.array(np.asarray(labels, dtype=object)[p.argmax(axis=1)] if len(texts) else [], pa.string())
            offsets = pa.array(np.arange(len(texts) + 1) * k, pa.int32())
            maps = pa.MapArray.from_arrays(offsets, pa.array(list(labels) * len(texts), pa.string()), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), best, maps], ["id", "predicted_label", "probabilities"])

    kind = rows.schema[id_col].dataType.simpleString()
    src = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"id {kind}, predicted_label string, probabilities map<string,double>")
