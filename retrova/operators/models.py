"""Models behind the hooks: sentence encoders, cross-encoders, hosted embedding and chat, each loaded on the worker that runs it.

A model object holds names and numbers only, so it is small to send; the library or client is opened at the first call in
each Python worker. A missing library is told when the model is made, not in the middle of a job.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Callable
from typing import Any, Protocol

import numpy as np

from . import embed

#: Names of public models and what they want before a query (fixed values).
SENTENCE_MODELS = {"minilm": ("sentence-transformers/all-MiniLM-L6-v2", ""), "bge-small": ("BAAI/bge-small-en-v1.5", embed.QUERY_PREFIX)}
CROSS_ENCODERS = {"ms-marco-minilm": "cross-encoder/ms-marco-MiniLM-L-6-v2", "bge-reranker": "BAAI/bge-reranker-base"}
#: Dimensions of the hosted models, and the encoding that counts their tokens (fixed values).
HOSTED_DIMS, HOSTED_ENCODING = {"text-embedding-3-small": 1_536, "text-embedding-3-large": 3_072}, "cl100k_base"


def need(library: str) -> None:
    if importlib.util.find_spec(library) is None:
        raise RuntimeError(f"this model needs the library {library}, which isn't installed")


class Opened:
    """Opens what `_open` makes at its first use and never sends it: each worker opens its own."""

    def __init__(self) -> None:
        self._it: Any = None

    def _open(self) -> Any:
        raise NotImplementedError

    @property
    def it(self) -> Any:
        if self._it is None:
            self._it = self._open()
        return self._it

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_it": None}


class SentenceModel(Opened):
    """An encoder of the sentence_transformers library; what is beyond its token limit is cut by the library."""

    def __init__(self, name: str, query_prefix: str = "", batch: int = 64):
        super().__init__()
        need("sentence_transformers")
        self.name, self.query_prefix, self.batch = name, query_prefix, batch
        self.dim, self.max_tokens = self.it.get_embedding_dimension(), self.it.max_seq_length

    def _open(self):
        from sentence_transformers import SentenceTransformer

        return SentenceTransformer(self.name)

    def embed(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros((0, self.dim), np.float32)
        return np.asarray(self.it.encode(texts, batch_size=self.batch, show_progress_bar=False), np.float32)

    def count_tokens(self, texts: list[str]) -> list[int]:
        """With the special tokens, which count toward the limit too."""
        return [len(x) for x in self.it.tokenizer(texts, truncation=False, verbose=False)["input_ids"]] if texts else []


class CrossEncoder(Opened):
    """A re-ranker that reads question and passage together."""

    def __init__(self, name: str, batch: int = 32):
        super().__init__()
        need("sentence_transformers")
        self.name, self.batch = CROSS_ENCODERS.get(name, name), batch

    def _open(self):
        from sentence_transformers import CrossEncoder as Model

        return Model(self.name)

    def score(self, question: str, passages: list[str]) -> np.ndarray:
        both = [(question, p) for p in passages]
        return np.asarray(self.it.predict(both, batch_size=self.batch, show_progress_bar=False), np.float32) if both else np.zeros(0, np.float32)


class Client(Protocol):
    """A hosted service. An answer may come in any order: each vector says which text it is of."""

    def embeddings(self, model: str, texts: list[str]) -> list[tuple[int, list[float]]]: ...

    def complete(self, model: str, system: str, user: str) -> str: ...


class OfficialClient:
    """The client over the openai library, with its own retries."""

    def __init__(self, retries: int = 6):
        from openai import OpenAI

        self.api = OpenAI(max_retries=retries)

    def embeddings(self, model: str, texts: list[str]) -> list[tuple[int, list[float]]]:
        return [(x.index, x.embedding) for x in self.api.embeddings.create(model=model, input=texts).data]

    def complete(self, model: str, system: str, user: str) -> str:
        told = [{"role": "system", "content": system}, {"role": "user", "content": user}]
        return self.api.chat.completions.create(model=model, temperature=0, messages=told).choices[0].message.content


class Hosted(Opened):
    """What the hosted models share: a function that opens their client on the worker (default: the openai library's)."""

    def __init__(self, client: Callable[[], Client] | None = None):
        super().__init__()
        if client is None:
            need("openai")
        self.client = client or OfficialClient

    def _open(self) -> Client:
        return self.client()


def hosted_tokens(texts: list[str]) -> list[int]:
    import tiktoken

    return [len(x) for x in tiktoken.get_encoding(HOSTED_ENCODING).encode_ordinary_batch(texts)]


class HostedEmbedder(Hosted):
    """A hosted embedder: requests of bounded texts and tokens; a text over the limit is refused, not cut."""

    query_prefix, max_tokens = "", embed.TEXT_TOKENS

    def __init__(self, name: str = "text-embedding-3-small", client: Callable[[], Client] | None = None, count: Callable[[list[str]], list[int]] = hosted_tokens):
        if name not in HOSTED_DIMS:
            raise ValueError(f"no hosted model is called {name!r}; there are {', '.join(sorted(HOSTED_DIMS))}")
        super().__init__(client)
        self.name, self.dim, self.count = name, HOSTED_DIMS[name], count

    def count_tokens(self, texts: list[str]) -> list[int]:
        return self.count(texts)

    def embed(self, texts: list[str]) -> np.ndarray:
        request = np.array(embed.batch_numbers(self.count_tokens(texts)), np.int64)
        out = np.zeros((len(texts), self.dim), np.float32)
        for n in range(int(request[-1]) + 1 if len(texts) else 0):
            own = np.flatnonzero(request == n)
            got = self.it.embeddings(self.name, [texts[i] for i in own])
            if sorted(i for i, _ in got) != list(range(len(own))):
                raise ValueError(f"{len(own)} texts were sent and {len(got)} vectors came back")
            for i, vector in got:
                out[own[i]] = vector
        return out


class HostedAnswerer(Hosted):
    """A hook for `answer.answer`: one completion a prompt, stripped."""

    def __init__(self, name: str, system: str, client: Callable[[], Client] | None = None):
        super().__init__(client)
        self.name, self.system = name, system

    def __call__(self, prompts: list[str]) -> list[str]:
        return [self.it.complete(self.name, self.system, p).strip() for p in prompts]


#: Known models and how to make them.
MODELS: dict[str, Callable[..., embed.Embedder]] = {
    "bag-of-words": embed.BagOfWords,
    "hashed-words": embed.HashedWords,
    **{short: lambda name=name, prefix=prefix: SentenceModel(name, prefix) for short, (name, prefix) in SENTENCE_MODELS.items()},
    "openai-small": lambda **more: HostedEmbedder("text-embedding-3-small", **more),
}


def make_model(name: str, *args, **kwargs) -> embed.Embedder:
    if name not in MODELS:
        raise ValueError(f"no model is called {name!r}; there are {', '.join(sorted(MODELS))}")
    return MODELS[name](*args, **kwargs)
