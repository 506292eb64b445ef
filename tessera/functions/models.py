"""Embedding contracts: registry, fingerprints, resolution, compatibility, text preparation, and a plug-in encoder."""

from __future__ import annotations

import hashlib
import json
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx


class IncompatibleModel(RuntimeError):
    """The collection was made with another embedding contract."""


@dataclass(frozen=True)
class ModelSpec:
    name: str
    dimension: int
    query_prefix: str | None = None
    document_prefix: str | None = None
    lowercase: bool = False
    normalize: bool = True
    trust_remote_code: bool | None = None
    max_seq_length: int | None = None
    note: str = ""

    @property
    def fingerprint(self) -> str:
        """First 16 hex digits of the sha256 of what shapes the vector space, as JSON with sorted keys."""
        contract = {
            "nome": self.name,
            "dimensao": self.dimension,
            "prefixo_query": self.query_prefix,
            "prefixo_documento": self.document_prefix,
            "lowercase": self.lowercase,
            "normalizar": self.normalize,
        }
        return hashlib.sha256(json.dumps(contract, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]

    @property
    def summary(self) -> str:
        return f"{self.name} ({self.dimension}d, fp={self.fingerprint})"


# Fixed values, which results depend on.
_INSTRUCT = "Instruct: Given a web search query, retrieve relevant passages that answer the query\nQuery: "
MODELS = {
    s.name: s
    for s in (
        ModelSpec("Alibaba-NLP/gte-Qwen2-1.5B-instruct", 1536, _INSTRUCT, None, trust_remote_code=False),
        ModelSpec("infly/inf-retriever-v1-1.5b", 1536, "query: ", "passage: ", trust_remote_code=True),
        ModelSpec("dunzhang/stella_en_1.5B_v5", 1536, "s2p_query: ", "s2p_document: ", trust_remote_code=True, max_seq_length=512),
        ModelSpec("BAAI/bge-m3", 1024, trust_remote_code=False),
        ModelSpec("intfloat/multilingual-e5-large", 1024, "query: ", "passage: ", trust_remote_code=False),
        ModelSpec("sentence-transformers/paraphrase-multilingual-MiniLM-L12-v2", 384, trust_remote_code=False),
        ModelSpec("text-embedding-3-small", 1536),
        ModelSpec("text-embedding-3-large", 3072),
    )
}
# Fixed values, which results depend on: the first mark that a name contains decides.
FAMILIES = (
    ("gte-qwen2", "Alibaba-NLP/gte-Qwen2-1.5B-instruct"),
    ("inf-retriever", "infly/inf-retriever-v1-1.5b"),
    ("stella", "dunzhang/stella_en_1.5B_v5"),
    ("bge-m3", "BAAI/bge-m3"),
    ("multilingual-e5", "intfloat/multilingual-e5-large"),
    ("paraphrase-multilingual", "sentence-transformers/paraphrase-multilingual-MiniLM-L12-v2"),
    ("text-embedding-3-small", "text-embedding-3-small"),
    ("text-embedding-3-large", "text-embedding-3-large"),
)
# Fixed values, which results depend on.
LOCAL = ("local", "huggingface", "hf", "st", "stella", "infini", "gte", "e5", "bge")
API = ("api", "openai", "infini-cloud", "cloud", "infini_api")
NEUTRAL_DIMENSION = 1536
DEFAULT_MODELS = {
    "stella": "dunzhang/stella_en_1.5B_v5",
    "infini": "infly/inf-retriever-v1-1.5b",
    "local": "Alibaba-NLP/gte-Qwen2-1.5B-instruct",
    "api": "text-embedding-3-small",
}


def resolve(model: str) -> ModelSpec:
    """Exact name, else the first family whose mark the name contains, else a neutral contract."""
    name = (model or "").strip()
    if not name:
        raise ValueError("name an embedding model")
    if name in MODELS:
        return MODELS[name]
    for mark, registered in FAMILIES:
        if mark in name.lower():
            return replace(MODELS[registered], note=f"alias of {registered}")
    return ModelSpec(name, NEUTRAL_DIMENSION, note="unregistered: neutral contract")


def provider_kind(provider: str | None) -> str:
    chosen = (provider or "local").strip().lower()
    if chosen in LOCAL:
        return "local"
    if chosen in API:
        return "api"
    raise ValueError(f"unknown provider: {provider}")


def model_for(provider: str | None = None, model: str | None = None, configured: str | None = None) -> ModelSpec:
    """The model asked for, else the provider's own; `configured` (an environment's choice) counts for remote ones."""
    kind, chosen = provider_kind(provider), (provider or "local").strip().lower()
    own = DEFAULT_MODELS.get(chosen, DEFAULT_MODELS[kind])
    return resolve(model or (configured if kind == "api" else None) or own)


def registry_table(spark: SparkSession) -> DataFrame:
    rows = [(s.name, s.dimension, s.query_prefix, s.document_prefix, s.lowercase, s.normalize, s.fingerprint) for s in MODELS.values()]
    return spark.createDataFrame(
        rows, "name string, dimension int, query_prefix string, document_prefix string, lowercase boolean, normalize boolean, fingerprint string"
    )


def resolve_table(names: DataFrame, name: str = "model") -> DataFrame:
    """Adds the registered name (null: neutral contract) of each model name, by the same order of precedence."""
    found = F.when(F.col(name).isin(list(MODELS)), F.col(name))
    for mark, registered in FAMILIES:
        found = found.when(F.lower(name).contains(mark), F.lit(registered))
    return names.withColumn("registered", found)


def contract_of(spec: ModelSpec) -> dict:
    """What a collection records about the model that its vectors come from."""
    return {"space": "cosine", "dimensions": spec.dimension, "model": spec.name, "fingerprint": spec.fingerprint}


def check_compatible(recorded: dict, spec: ModelSpec, permit: bool = False) -> None:
    """Raises (or, if permitted, warns) when a recorded contract differs; what is not recorded passes.

    The fingerprint stands for the model, so names only count where there is none.
    """
    asked = contract_of(spec)
    by = ["dimensions", "fingerprint" if recorded.get("fingerprint") else "model"]
    differ = {k: (recorded[k], asked[k]) for k in by if recorded.get(k) not in (None, "", asked[k])}
    if not differ:
        return
    listed = "; ".join(f"{k} {was} instead of {now}" for k, (was, now) in differ.items())
    message = f"the collection's vectors are of {recorded.get('model') or 'an unknown model'}, not of {spec.name}: {listed}"
    if not permit:
        raise IncompatibleModel(message)
    warnings.warn(message, stacklevel=2)


def prepared(text: Column, spec: ModelSpec, prefix: str | None) -> Column:
    """What is encoded: stripped, lower-cased if the model asks for it, behind the prefix as it stands."""
    clean = tx.strip(F.coalesce(text, F.lit("")))
    clean = F.lower(clean) if spec.lowercase else clean
    return F.concat(F.lit(prefix), clean) if prefix else clean


def document_input(text: Column, spec: ModelSpec) -> Column:
    return prepared(text, spec, spec.document_prefix)


def query_input(text: Column, spec: ModelSpec) -> Column:
    """Queries are encoded like documents; the query prefix only takes part in the fingerprint."""
    return document_input(text, spec)


def flattened(text: Column) -> Column:
    """One line, as remote encoders get it."""
    return tx.strip(F.regexp_replace(text, "\r\n|\n", " "))


def encoder(spec: ModelSpec, encode: Callable[[list[str]], np.ndarray], batch: int = 16) -> Callable[[Column], Column]:
    """A column function from texts to vectors; `encode` is loaded with each worker and called by batches."""

    @F.pandas_udf("array<float>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            listed, out = texts.tolist(), []
            for i in range(0, len(listed), batch):
                vectors = np.asarray(encode(listed[i : i + batch]), dtype=np.float64)
                if vectors.shape[1] != spec.dimension:
                    raise ValueError(f"the encoder gave {vectors.shape[1]} numbers, {spec.name} has {spec.dimension}")
                if spec.normalize:
                    size = np.linalg.norm(vectors, axis=1, keepdims=True)
                    vectors = vectors / np.where(size > 0, size, 1)
                out += vectors.astype(np.float32).tolist()
            yield pd.Series(out)

    return run


def hashed_words(dimension: int) -> Callable[[list[str]], np.ndarray]:
    """A stand-in encoder without a model: signed hashed word counts. For tests and dry runs only."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension))
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                out[i, h % dimension] += 1 if h >> 63 else -1
        return out

    return encode
