"""Summarisers behind one small protocol: a name, and complete(task, text) -> text.

A backend must give the same bytes for the same input, so that retried and speculative tasks agree.
PrefixBackend is expressible in SQL and serves as the oracle's model; HttpBackend talks to a local
model server.
"""

from __future__ import annotations

import json
import math
import re
import urllib.error
import urllib.request
from dataclasses import dataclass, field
from typing import Protocol

from brevia.config import EngineConfig
from brevia.functions.text import fnv1a, u16


class BackendError(Exception):
    """A call failed or its answer can't be used; becomes an error column, or blocks, by policy."""


class Backend(Protocol):
    def complete(self, task: str, text: str, config: EngineConfig) -> str: ...


@dataclass(frozen=True)
class PrefixBackend:
    """The first share of a text's characters."""

    share: float = 0.4

    def complete(self, task: str, text: str, config: EngineConfig) -> str:
        return text[: math.ceil(len(text) * self.share)]


@dataclass(frozen=True)
class ExtractiveBackend:
    """The lines that carry numbers, paths or errors, in order, up to a share of the text."""

    share: float = 0.4

    def complete(self, task: str, text: str, config: EngineConfig) -> str:
        room, kept = int(u16(text) * self.share), []
        for line in dict.fromkeys(text.split("\n")):
            if re.search(r"\d|/|error|fail|warn", line, re.I) and u16(line) + 1 <= room:
                kept.append(line)
                room -= u16(line) + 1
        return "\n".join(kept)


@dataclass(frozen=True)
class FailingBackend:
    message: str = "no model"

    def complete(self, task: str, text: str, config: EngineConfig) -> str:
        raise BackendError(self.message)


# --- local model server ----------------------------------------------------------------------------


def request_json(url: str, body: dict | None = None, timeout_ms: int = 120_000) -> dict:
    """GET, or POST of a body, with errors that say what to do."""
    data = None if body is None else json.dumps(body).encode()
    call = urllib.request.Request(url, data=data, headers={"content-type": "application/json"})
    try:
        with urllib.request.urlopen(call, timeout=timeout_ms / 1000) as answer:
            return json.loads(answer.read())
    except urllib.error.HTTPError as error:
        raise BackendError(f"HTTP {error.code}: {error.read().decode(errors='replace')}") from error
    except TimeoutError as error:
        raise BackendError(f"no answer from {url} within {timeout_ms} ms; raise the time limit or use a smaller model") from error
    except urllib.error.URLError as error:
        if isinstance(error.reason, TimeoutError):
            raise BackendError(f"no answer from {url} within {timeout_ms} ms; raise the time limit or use a smaller model") from error
        raise BackendError(f"cannot reach {url} ({error.reason}); is the model server running?") from error
    except ValueError as error:
        raise BackendError(f"{url} answered no JSON") from error


def chat(base_url: str, model: str, messages: list[dict], options: dict | None = None, think: bool | None = None, timeout_ms: int = 120_000) -> dict:
    """One reply, not streamed, with its timings in ms and tokens a second (null without a time)."""
    body = {"model": model, "messages": messages, "stream": False} | ({"options": options} if options else {}) | ({} if think is None else {"think": think})
    raw = request_json(f"{base_url.rstrip('/')}/api/chat", body, timeout_ms)
    message, spent = raw.get("message") or {}, raw.get("eval_duration") or 0
    return {
        "model": raw.get("model", model), "role": message.get("role"), "content": message.get("content", ""), "thinking": message.get("thinking"), "done_reason": raw.get("done_reason"),
        "total_duration_ms": round((raw.get("total_duration") or 0) / 1e6), "prompt_tokens": raw.get("prompt_eval_count"), "completion_tokens": raw.get("eval_count"),
        "tokens_per_second": round((raw.get("eval_count") or 0) / (spent / 1e9), 1) if spent else None,
    }


#: What the model is told, by task.
PROMPTS = {
    "chunk": "Shorten the text to at most {percent} % of its length. Keep facts, numbers, names, paths, commands and error messages as they are, in the text's own language. Answer with the shortened text only.",
    "history": "Summarise this part of a conversation as a list. Keep goals, decisions, file paths, commands, errors with their remedies, open tasks, explicit wishes and figures, in the conversation's own language. Stay under a third of its length. Answer with the summary only.",
    "merge": "The text holds the answers to one instruction for the parts of a file. Join them into one answer without losing anything.",
}


def call_options(task: str, text: str, config: EngineConfig) -> dict:
    """Options of a call: temperature 0 and a seed from the text, so that equal texts get equal answers."""
    room = config.prune_max_summary_tokens if task == "history" else max(256, math.ceil(u16(text) * config.target_ratio))
    return {"temperature": 0, "seed": fnv1a(text), "num_predict": room, "num_ctx": config.distill_num_ctx}


@dataclass(frozen=True)
class HttpBackend:
    base_url: str
    model: str
    prompts: dict = field(default_factory=lambda: dict(PROMPTS))

    def complete(self, task: str, text: str, config: EngineConfig) -> str:
        told = self.prompts.get(task, task).format(percent=round(config.target_ratio * 100))
        limit = config.prune_timeout_ms if task == "history" else config.distill_timeout_ms
        reply = chat(self.base_url, self.model, [{"role": "system", "content": told}, {"role": "user", "content": text}], call_options(task, text, config), False, limit)
        return reply["content"] or ""
