"""Models behind HTTP: a local model server, and the chat interface that many services share.

Both are plain values, so they travel to the workers and serve as embedder or extractor
of an engine.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

# Where a local server listens, and the paths of both interfaces.
LOCAL = "http://localhost:11434"
EMBED, GENERATE, CHAT = "/api/embeddings", "/api/generate", "/chat/completions"
SYSTEM = "You find relations between the named things of a text. Answer with one JSON object a line and nothing else."
#: Answers that are worth another try.
AGAIN = (408, 425, 429, 500, 502, 503, 504)


class ProviderError(RuntimeError):
    """A request that got no usable answer."""


@dataclass(frozen=True)
class Provider:
    """Where a model is and how long to wait for it.  A request that fails for want of a
    connection, or in a way that may pass, is tried `retries` times more, each after
    twice the delay of the one before."""

    model: str = ""
    base_url: str = LOCAL
    api_key: str = ""
    timeout: float = 120.0
    retries: int = 3
    delay: float = 1.0

    def _open(self, request: urllib.request.Request) -> bytes:
        for attempt in range(self.retries + 1):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    return answer.read()
            except urllib.error.HTTPError as e:
                e.close()
                failure = ProviderError(f"status {e.code}")
                if e.code not in AGAIN:
                    raise failure from None
            except OSError as e:
                failure = ProviderError(str(e))
            if attempt < self.retries:
                time.sleep(self.delay * 2**attempt)
        raise failure

    def post(self, path: str, body: dict) -> dict:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
        answer = self._open(urllib.request.Request(self.base_url.rstrip("/") + path, json.dumps(body).encode(), headers))
        try:
            found = json.loads(answer)
        except ValueError as e:
            raise ProviderError(f"the answer isn't JSON: {e}") from e
        if not isinstance(found, dict):
            raise ProviderError("the answer isn't an object")
        return found

    def ping(self) -> None:
        """An error unless the server answers."""
        self._open(urllib.request.Request(self.base_url.rstrip("/") + "/"))

    def chat(self, prompt: str, system: str = "", path: str = CHAT) -> str:
        messages = [{"role": "system", "content": system}] if system else []
        found = self.post(path, {"model": self.model, "messages": [*messages, {"role": "user", "content": prompt}], "temperature": 0.1})
        choices = found.get("choices") or []
        if not choices:
            raise ProviderError("no response from the service")
        return choices[0]["message"]["content"] or ""


@dataclass(frozen=True)
class LocalModel(Provider):
    """A local model server: embeddings, and completions as text or as JSON."""

    concurrency: int = 5

    def embed(self, texts: list[str]) -> list[list[float]]:
        """A vector for each text, in order; a text without one is an error that names it."""

        def one(numbered: tuple[int, str]) -> list[float]:
            try:
                return self.post(EMBED, {"model": self.model, "prompt": numbered[1]})["embedding"]
            except (ProviderError, KeyError) as e:
                raise ProviderError(f"embedding failed for text {numbered[0]}: {e}") from e

        with ThreadPoolExecutor(max(1, self.concurrency)) as pool:
            return list(pool.map(one, enumerate(texts)))

    def generate(self, prompt: str, system: str = "", as_json: bool = False) -> str:
        """A completion; as JSON it goes by the chat interface where the address asks for that."""
        if as_json and "openrouter" in self.base_url:
            return self.chat(prompt, system, "/v1" + CHAT)
        body = {"model": self.model, "prompt": prompt, "stream": False} | ({"system": system} if system else {})
        return self.post(GENERATE, body | ({"format": "json"} if as_json else {})).get("response", "")

    def complete(self, prompt: str) -> str:
        return self.generate(prompt, SYSTEM, as_json=True)


@dataclass(frozen=True)
class ChatModel(Provider):
    """A service with the chat interface."""

    def complete(self, prompt: str) -> str:
        return self.chat(prompt, SYSTEM)


def choose(options: dict, timeout: float = 300.0) -> tuple[LocalModel, Provider]:
    """The embedder and the extractor of a profile's options.

    `llm_provider` says which extractor; without it the address does, and a local
    server is what is left.  Vectors always come from the local server.
    """
    base = options.get("llm_base_url") or ""
    graph = options.get("graph_driver") or {}
    named = (options.get("llm_provider") or "").lower()
    if not named and ("openrouter" in base or "openai" in base):
        named = "openai"
    embedder = LocalModel(options.get("embedding_model") or "", timeout=timeout)
    model, key = graph.get("model") or "", options.get("llm_api_key") or ""
    if named == "openai":
        return embedder, ChatModel(model, base, key, timeout)
    return embedder, LocalModel(model, base or LOCAL, timeout=timeout)
