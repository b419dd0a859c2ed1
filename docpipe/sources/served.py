"""A client for language models behind a local HTTP server that streams its answer as lines of JSON."""

from __future__ import annotations

import base64
import json
import urllib.error
import urllib.request
from dataclasses import dataclass, field
from typing import Any

from docpipe.sources.plugins import model_ready

# What a text and a vision request ask for.
TEXT_OPTIONS = {"temperature": 0.1, "top_p": 0.9, "top_k": 20, "num_predict": 1536, "num_ctx": 4096, "repeat_penalty": 1.05, "num_keep": 4}
VISION_OPTIONS = {"temperature": 0.1, "num_predict": 1024}


class ModelError(RuntimeError):
    """The server refused a request or gave no answer. A request that is itself at fault is not worth trying again."""

    def __init__(self, message: str, code: int | None = None):
        super().__init__(message)
        self.retryable = code is None or code >= 500 or code in (408, 429)


def answer_of(lines: Any) -> str:
    """The text that streamed lines make up: their `response` parts until one says `done`; lines that are no JSON are skipped."""
    parts = []
    for line in lines:
        try:
            chunk = json.loads(line)
        except ValueError:
            continue
        if isinstance(chunk, dict):
            parts.append(str(chunk.get("response") or ""))
            if chunk.get("done"):
                break
    text = "".join(parts)
    if not text:
        raise ModelError("empty answer")
    return text


@dataclass(frozen=True)
class ServedModel:
    """A LanguageModel: text requests ask for JSON, vision requests carry an image (bytes, or their base64)."""

    url: str
    model: str
    timeout: float = 300.0
    options: dict = field(default_factory=lambda: dict(TEXT_OPTIONS))
    vision_options: dict = field(default_factory=lambda: dict(VISION_OPTIONS))

    def request(self, prompt: str, image: bytes | str | None = None) -> dict:
        if image is None:
            return {"model": self.model, "prompt": prompt, "stream": True, "format": "json", "options": self.options}
        encoded = image if isinstance(image, str) else base64.b64encode(image).decode()
        return {"model": self.model, "prompt": prompt, "images": [encoded], "stream": True, "options": self.vision_options}

    def _open(self, path: str, body: dict | None = None):
        data = None if body is None else json.dumps(body).encode()
        try:
            return urllib.request.urlopen(urllib.request.Request(self.url.rstrip("/") + path, data, {"Content-Type": "application/json"}), timeout=self.timeout)  # noqa: S310  the address is the caller's
        except urllib.error.HTTPError as e:
            raise ModelError(f"{e.code}: {e.read(500).decode('utf-8', 'replace')}", e.code) from e

    def identity(self, image: bool = False) -> str:
        """What an answer depends on besides the question; for a ledger of answers."""
        return json.dumps({"model": self.model, "options": self.vision_options if image else self.options}, sort_keys=True)

    def complete(self, prompt: str, image: bytes | str | None = None) -> str:
        with self._open("/api/generate", self.request(prompt, image)) as lines:
            return answer_of(lines)

    def listed(self) -> list[str]:
        """Names of the models that the server has."""
        with self._open("/api/tags") as answer:
            return [str(m.get("name", "")) for m in json.load(answer).get("models", [])]

    def ensure(self) -> bool:
        """On the driver, before a job: asks the server to fetch the model if it has none of that name; whether it was there."""
        if model_ready(self.model, self.listed()):
            return True
        with self._open("/api/pull", {"name": self.model}) as lines:
            for line in lines:
                if b'"error"' in line:
                    raise ModelError(line.decode("utf-8", "replace").strip())
        return False
