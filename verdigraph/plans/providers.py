"""Evaluators that ask a model service over HTTP. One is built for each partition; keys come from the environment of the task.

A service takes one of two shapes of request: chat completions, or messages with a system text. Models differ in what they accept; see
:func:`body`. Other evaluators are added with :func:`register`.
"""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from .evaluate import Evaluator, Offline


@dataclass(frozen=True)
class Service:
    """Where a provider is asked, the variable that holds its key, and the shape of its requests."""

    key: str
    address: str
    shape: str = "chat"


#: Providers, the variables of their keys and their public addresses; temperature and the bound of an answer's tokens.
SERVICES = {
    "openai": Service("OPENAI_API_KEY", "https://api.openai.com/v1/chat/completions"),
    "deepseek": Service("DEEPSEEK_API_KEY", "https://api.deepseek.com/chat/completions"),
    "anthropic": Service("ANTHROPIC_API_KEY", "https://api.anthropic.com/v1/messages", "messages"),
    "openrouter": Service("OPENROUTER_API_KEY", "https://openrouter.ai/api/v1/chat/completions"),
}
TEMPERATURE, ANSWER_TOKENS = 0.7, 64_000


def messages(context: str, prompt: str) -> list[dict]:
    """The two turns of a request."""
    return [{"role": "system", "content": context}, {"role": "user", "content": prompt}]


def body(shape: str, model: str, context: str, prompt: str, thinking: bool = False) -> dict:
    """What is sent. The newest of one family take no temperature; one family is held to JSON; only chat requests can ask for thinking."""
    if shape == "messages":
        return {"model": model, "system": context, "messages": messages(context, prompt)[1:], "max_tokens": ANSWER_TOKENS, "temperature": TEMPERATURE}
    out: dict = {"model": model, "messages": messages(context, prompt)}
    newest, plain_json = model.startswith("gpt-5"), "llama" in model
    if not newest:
        out["temperature"] = TEMPERATURE
    if plain_json and not newest:
        out["response_format"] = {"type": "json_object"}
    elif thinking:
        out["enable_thinking"] = True
    return out


def answer(shape: str, reply: dict) -> tuple[str, str | None, tuple[int, int, int] | None]:
    """Text, reasoning and usage of a reply."""
    usage = reply.get("usage") or {}
    if shape == "messages":
        text = "".join(block["text"] for block in reply.get("content", []) if block.get("type") == "text")
        n, m = usage.get("input_tokens"), usage.get("output_tokens")
        return text, "", None if n is None or m is None else (n, m, n + m)
    told = reply["choices"][0]["message"]
    counts = tuple(usage.get(k) for k in ("prompt_tokens", "completion_tokens", "total_tokens"))
    return told.get("content") or "", told.get("reasoning_content") or "", None if None in counts else counts


class Http:
    """Asks one model. A refusal raises with its status, so that the caller may wait and ask again."""

    def __init__(self, service: Service, model: str, thinking: bool = False, timeout: float = 600.0) -> None:
        self.service, self.model, self.thinking, self.timeout = service, model, thinking, timeout
        key = os.environ.get(service.key)
        if not key:
            raise ValueError(f"{service.key} is not set")
        own = {"x-api-key": key, "anthropic-version": "2023-06-01"} if service.shape == "messages" else {"Authorization": f"Bearer {key}"}
        self.headers = {"Content-Type": "application/json", **own}

    def __call__(self, context, prompt, warning_id, walk, level):
        sent = json.dumps(body(self.service.shape, self.model, context, prompt, self.thinking)).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(self.service.address, sent, self.headers), timeout=self.timeout) as reply:
                return answer(self.service.shape, json.load(reply))
        except urllib.error.HTTPError as e:
            raise RuntimeError(f"status {e.code}: {e.read(500).decode('utf-8', 'replace')}") from None


_known: dict[str, Callable[[str], Evaluator]] = {}


def register(provider: str, make: Callable[[str], Evaluator]) -> None:
    """make: an evaluator of a model's name, called in the tasks."""
    _known[provider] = make


def maker(provider: str, model: str, thinking: bool = False) -> Callable[[], Evaluator]:
    """What builds a provider's evaluator in each partition. The model of a service with messages must be one of its own."""
    if provider in _known:
        make = _known[provider]
        return lambda: make(model)
    if provider not in SERVICES:
        raise ValueError(f"unknown provider {provider!r}: {', '.join(sorted({*SERVICES, *_known}))}")
    service = SERVICES[provider]
    if ("claude" in model) != (service.shape == "messages"):
        raise ValueError(f"{model!r} is no model of {provider!r}")
    return lambda: Http(service, model, thinking)


register("offline", lambda model: Offline())
