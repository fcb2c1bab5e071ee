"""Registries of text embedders and language models, with offline stand-ins.

The stand-ins are deterministic: `hashed` counts hashed character trigrams, `fixed` answers every
request with an approval. Neither is equivalent to a hosted model; real ones are registered by name.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EMBEDDERS: dict[str, Callable[[list[str]], np.ndarray]] = {}
MODELS: dict[str, Callable[[list[str]], list[str]]] = {}


def hashed(texts: list[str], size: int = 64) -> np.ndarray:
    """Counts of hashed trigrams, at unit length."""
    out = np.zeros((len(texts), size), np.float32)
    for row, t in zip(out, texts, strict=True):
        for k in range(max(1, len(t) - 2)):
            row[zlib.crc32(t[k : k + 3].encode()) % size] += 1
        row /= np.linalg.norm(row) or 1
    return out


EMBEDDERS["hashed"] = hashed
MODELS["fixed"] = lambda prompts: [json.dumps({"summary": "No model is configured.", "decision": "comment", "confidence": 0.5, "file_reviews": []}) for _ in prompts]


def provider(kind: dict, name: str):
    if name not in kind:
        raise ValueError(f"unknown provider {name!r}; registered: {', '.join(sorted(kind))}")
    return kind[name]


def embed(text: Column, name: str = "hashed") -> Column:
    """Embeddings of a text column, in Arrow batches."""
    f = provider(EMBEDDERS, name)

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(list(f(s.fillna("").tolist())), dtype=object)

    return run(text)


def embed_new(text: Column, name: str = "hashed") -> Column:
    """Embeddings of the texts that aren't null; the embedder never sees the others."""
    f = provider(EMBEDDERS, name)

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(s), dtype=object)
        at = np.flatnonzero(s.notna())
        if len(at):
            for i, v in zip(at, f(s.iloc[at].tolist()), strict=True):
                out.iloc[i] = v
        return out

    return run(text)


def answers(model: Callable[[list[str]], list], prompts: list[str]) -> list[tuple[str | None, str | None, str | None]]:
    """(content, finish_reason, error) of each prompt. A model gives texts, or dictionaries of content and finish_reason; where it raises for
    several prompts, they are asked one by one, and those that fail have the error."""
    try:
        said = model(prompts) if prompts else []
    except Exception as e:
        if len(prompts) == 1:
            return [(None, None, f"{type(e).__name__}: {e}")]
        return [answers(model, [p])[0] for p in prompts]
    return [(a.get("content"), a.get("finish_reason", "stop"), None) if isinstance(a, dict) else (a, "stop", None) for a in said]


def generate(prompt: Column, name: str = "fixed") -> Column:
    """Answers to a column of prompts, in Arrow batches."""
    f = provider(MODELS, name)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(f(s.fillna("").tolist()))

    return run(prompt)


def signature_ok(payload: Column, signature: Column, secret: str, allow_empty_secret: bool = False) -> Column:
    """Whether `sha256=<hex>` is the payload's HMAC. Without a secret nothing passes unless that is allowed."""
    if not secret:
        return F.lit(allow_empty_secret)

    @F.pandas_udf("boolean")
    def run(p: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([hmac.compare_digest("sha256=" + hmac.new(secret.encode(), (x or "").encode(), hashlib.sha256).hexdigest(), y or "") for x, y in zip(p, s, strict=True)])

    return run(payload, signature)
