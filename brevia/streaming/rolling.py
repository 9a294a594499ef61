"""Pruning as a stream: each conversation's chain is keyed state, each micro-batch of its turns a request.

The state holds the turns not yet rolled and the chain, so it is bounded by the budget and the number of
blocks, not by the conversation's length. Turns that come before their predecessors wait in the state.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from brevia.config import EngineConfig
from brevia.operators.prune import Chain, Turn, roll, turns_of
from brevia.sources.backends import Backend

OUT = "conv_id long, next_seq long, n_open int, covered int, n_blocks int, newly int, open_tokens long, after_tokens long"
STATE = "state string"


def _load(state: GroupState) -> dict:
    return json.loads(state.get[0]) if state.exists else {"next": 0, "covered": 0, "blocks": [], "open": [], "early": {}}


def step(state: dict, rows: list[tuple[int, Turn]], backend: Backend, config: EngineConfig, overhead: int = 0) -> tuple[dict, dict | None]:
    """Takes turns in; gives the new state and what the request is then, or None if no turn was in order. overhead:
    tokens of the request's system text and tools."""
    early = {int(k): Turn(*(tuple(x) if isinstance(x, list) else x for x in v)) for k, v in state["early"].items()}
    for seq, turn in rows:
        if seq >= state["next"]:
            early.setdefault(seq, turn)
    still_open = [Turn(tuple(t[0]), *t[1:]) for t in state["open"]]
    at = state["next"]
    while at in early:
        still_open.append(early.pop(at))
        at += 1
    arrived = at > state["next"]
    chain, covered, newly = Chain(state["covered"], "", [tuple(b) for b in state["blocks"]]), state["covered"], 0
    if arrived:
        done = roll(still_open, chain if covered else None, overhead, backend, config, gone=covered)
        if done is not None:
            chain, newly = done.chain, done.newly
            still_open = still_open[chain.covered - covered :]
            covered = chain.covered
    blocks = chain.blocks
    flat = lambda t: [list(t.texts), t.tokens, t.content, t.is_result, t.is_call]
    new = {"next": at, "covered": covered, "blocks": blocks, "open": [flat(t) for t in still_open], "early": {k: flat(t) for k, t in early.items()}}
    if not arrived:
        return new, None
    open_tokens = sum(t.tokens for t in still_open)
    return new, {
        "next_seq": at, "n_open": len(still_open), "covered": covered, "n_blocks": len(blocks), "newly": newly,
        "open_tokens": open_tokens, "after_tokens": open_tokens + Chain(0, "", blocks).tokens(config.token_estimate_factor),
    }


def prune_stream(messages: DataFrame, backend: Backend, config: EngineConfig) -> DataFrame:
    """A streaming (conv_id, seq, role, content) frame -> one row for each conversation and micro-batch. A column
    overhead gives the tokens of the request's system text and tools; the last one known counts."""

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows, held = [], _load(state)
        for frame in frames:
            frame = frame.sort_values("seq", kind="stable")
            if "overhead" in frame and frame.overhead.notna().any():
                held["overhead"] = int(frame.overhead.dropna().iloc[-1])
            rows += [(int(s), Turn(tuple(t), int(n), c, bool(r), bool(k))) for s, t, n, c, r, k in zip(frame.seq, frame.texts, frame.tokens, frame.content, frame.is_result, frame.is_call, strict=True)]
        new, out = step(held, rows, backend, config, held.get("overhead", 0))
        new["overhead"] = held.get("overhead", 0)
        state.update((json.dumps(new, ensure_ascii=False),))
        if out is not None:
            yield pd.DataFrame([{"conv_id": key[0]} | out])

    return turns_of(messages, config).groupBy("conv_id").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def notice_stream(notices: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Notices (at, conv_id, notice_key, ...) of a stream, each key of a conversation once."""
    return notices.withWatermark("at", watermark).dropDuplicatesWithinWatermark(["conv_id", "notice_key"])
