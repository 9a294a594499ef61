"""Parameters of the engine, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    enabled: bool = True
    announce_to_agent: bool = True
    base_url: str = "http://127.0.0.1:11434"
    default_model: str = ""
    timeout_ms: int = 120_000
    routing_guidance: bool = True

    distill_enabled: bool = True
    distill_model: str = ""
    distill_min_chars: int = 2000
    target_ratio: float = 0.4
    distill_roles: tuple[str, ...] = ("user",)
    distill_system: bool = False
    distill_chunk_chars: int = 3000
    distill_num_ctx: int = 8192
    run_max_context_tokens: int = 12_000
    distill_timeout_ms: int = 180_000
    distill_on_error: str = "pass"
    #: Cold texts distilled for one request; a count, where a wall clock would make results depend on load.
    distill_call_budget: int = 64
    token_estimate_factor: float = 1.0
    distill_cache_limit: int = 50_000
    distill_cache_path: str = ""
    distill_notice: bool = True
    distill_notice_always: bool = False

    prune_enabled: bool = True
    prune_budget_tokens: int = 60_000
    prune_keep_recent: int = 12
    prune_batch_size: int = 12
    prune_max_source_chars: int = 12_000
    prune_max_summary_tokens: int = 2048
    prune_chain_max_batches: int = 20
    prune_max_new_blocks: int = 3
    prune_roll_margin: float = 1.2
    prune_timeout_ms: int = 120_000
    prune_notice: bool = True

    @property
    def threshold(self) -> float:
        return self.prune_budget_tokens * self.prune_roll_margin

    @property
    def summary_model(self) -> str:
        return self.distill_model or self.default_model
