"""History pruning: each conversation's oldest turns are rolled into write-once summary blocks.

A request is its conversation's summary blocks, then the turns not yet rolled. Nothing is rolled while
it stays under budget x margin; once it is over, batches are rolled until it is within the budget.
Blocks are never rewritten, so a request's beginning stays the same from turn to turn; only when there
are too many are they merged into one. The last turn is never rolled.

The rolling is sequential in one conversation, as the size of each new block decides on the next, and
independent between conversations: a grouped map over conv_id, or keyed state in a stream.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brevia.config import EngineConfig
from brevia.functions.markers import prune_block, strip_prune_lines
from brevia.functions.text import base36, calibrated, fingerprint36, fnv1a, round_half_up, u16, u16_len, u16_right, u16_tail
from brevia.operators.accounting import billed_fragments, flattened_texts, has_tool_call, has_tool_result
from brevia.operators.distill import accept_history
from brevia.sources.backends import Backend, BackendError


SNAPSHOT = "__prune__snap__"


@dataclass(frozen=True)
class Turn:
    """What rolling needs of a message."""

    texts: tuple[str, ...]
    tokens: int
    content: str  # its blocks as JSON
    is_result: bool = False
    is_call: bool = False


@dataclass
class Chain:
    """Blocks (key, text) that cover the first turns of a conversation, whose hash they were made from."""

    covered: int = 0
    covered_hash: str = ""
    blocks: list[tuple[str, str]] = field(default_factory=list)

    def tokens(self, factor: float) -> int:
        return sum(calibrated(text, factor) for _, text in self.blocks)

    def key(self) -> str:
        return "__chain__" + hash_of([k for k, _ in self.blocks])


def hash_of(value) -> str:
    """Fingerprint of a value's JSON, base 36; turns give their content."""
    return base36(fnv1a(json.dumps(value, ensure_ascii=False, separators=(",", ":"))))


def content_hash(turns: list[Turn]) -> str:
    return base36(fnv1a("[" + ",".join(t.content for t in turns) + "]"))


def parts_exchange(turns: list[Turn], at: int) -> bool:
    """Whether a cut before turn at would part a tool result from its call."""
    return at < len(turns) and (turns[at].is_result or turns[at - 1].is_call)


def guard(turns: list[Turn], start: int, end: int) -> int:
    """The cut nearest to end that parts no exchange: the last one after start and up to end, else the first one after
    end that leaves the last turn out, else start, which makes no batch."""
    cuts = [*range(end, start, -1), *range(end + 1, len(turns))]
    return next((at for at in cuts if not parts_exchange(turns, at)), start)


def source_text(turns: list[Turn], most: int) -> str:
    """The newest texts' ends up to `most` characters, in order."""
    parts, room = [], most
    for turn in reversed(turns):
        for text in reversed(turn.texts):
            if room <= 0:
                break
            part = u16_tail(text, room)
            if not part:  # half of a character is left
                room = 0
                break
            parts.append(part)
            room -= u16(part)
    return "\n\n".join(reversed(parts))


def make_block(source: str, omitted: int, kept: int, backend: Backend, config: EngineConfig) -> str | None:
    """A summary block, or None if the backend gave none that may be used."""
    if not source.strip():
        return None
    try:
        summary = accept_history(source, backend.complete("history", source, config))
    except BackendError:
        return None
    factor = config.token_estimate_factor
    return prune_block(omitted, kept, calibrated(source, factor), calibrated(summary, factor), summary)


def plan(tokens: float, has_chain: bool, config: EngineConfig) -> tuple[int, int]:
    """(turns in a batch, batches at most) for a request of so many tokens."""
    over = tokens / config.threshold if config.threshold > 0 else 1
    batch = max(3 * config.prune_batch_size, 48) if over > 2 else config.prune_batch_size
    cap = config.prune_max_new_blocks if has_chain else max(config.prune_max_new_blocks, 8)
    return batch, max(cap, min(48, max(12, round_half_up(over) * 3))) if over > 1 else cap


def compact(chain: Chain, kept: int, backend: Backend, config: EngineConfig) -> Chain:
    """All blocks merged into one, made from as many whole blocks of the newest as fit (one at least); the chain
    itself if that fails."""
    parts, size = [], 0
    for _, text in reversed(chain.blocks):
        body = strip_prune_lines(text)
        if parts and size + u16(body) > config.prune_max_source_chars:
            break
        parts.append(body)
        size += u16(body)
    merged = make_block("\n\n".join(reversed(parts)), chain.covered, kept, backend, config)
    if merged is None:
        return chain
    return Chain(chain.covered, chain.covered_hash, [("__compact__" + hash_of([k for k, _ in chain.blocks]), merged)])


@dataclass
class Pruned:
    chain: Chain
    before: int  # tokens of all turns
    after: int  # tokens of blocks and remaining turns
    newly: int
    rolled: bool


def roll(turns: list[Turn], chain: Chain | None, overhead: int, backend: Backend, config: EngineConfig, known: dict[str, str] | None = None, gone: int = 0) -> Pruned | None:
    """One request: the chain it leaves behind, or None if the request stays as it is.

    known: blocks by key, which are used again and added to. gone: how many turns before the given ones the caller
    has dropped, as the chain, which must then be the valid one, covers them; before and after leave them out.
    """
    n, keep = gone + len(turns), max(1, config.prune_keep_recent)
    if not config.prune_enabled or config.prune_budget_tokens <= 0 or n <= keep:
        return None
    rest = [0]
    for turn in reversed(turns):
        rest.append(rest[-1] + turn.tokens)
    suffix = lambda at: rest[n - at]  # noqa: E731  tokens from turn at on
    factor, limit = config.token_estimate_factor, config.threshold
    if chain is not None and not gone and (chain.covered > n or chain.covered_hash != content_hash(turns[: chain.covered])):
        chain = None
    if chain is None and suffix(0) + overhead <= limit:
        return None
    done = Chain(chain.covered, chain.covered_hash, list(chain.blocks)) if chain else Chain()
    known = {} if known is None else known
    summaries, at = done.tokens(factor), done.covered
    size, most = plan(summaries + suffix(at) + overhead, at > 0, config)
    in_zone = min(size, max(1, min(config.prune_batch_size, keep)))
    target, made = limit, 0
    while made < most and at < n - 1 and summaries + suffix(at) + overhead > target:
        target = config.prune_budget_tokens
        wanted = min(at + (in_zone if at >= n - keep else size), n - 1)
        end = gone + guard(turns, at - gone, wanted - gone)
        batch = turns[at - gone : end - gone]
        if not batch:
            break
        key = "__prune__" + content_hash(batch)
        if key not in known:
            block = make_block(source_text(batch, config.prune_max_source_chars), len(batch), n - end, backend, config)
            if block is None:
                break
            known[key] = block
        done.blocks.append((key, known[key]))
        summaries += calibrated(known[key], factor)
        at, made = end, made + 1
    if not at:
        return None
    newly, done.covered = at - done.covered, at
    if not gone:
        done.covered_hash = content_hash(turns[:at])
    if len(done.blocks) > max(1, config.prune_chain_max_batches):
        done = compact(done, n - at, backend, config)
    return Pruned(done, suffix(gone), done.tokens(factor) + suffix(at), newly, made > 0)


# --- DataFrames -----------------------------------------------------------------------------------------

CHAIN = "covered int, covered_hash string, block_keys array<string>, block_texts array<string>"
KNOWN = "known_keys array<string>, known_texts array<string>"
RESULT = f"conv_id long, n_messages int, {CHAIN}, newly int, before_tokens long, after_tokens long, chain_key string, {KNOWN}"


def turns_of(messages: DataFrame, config: EngineConfig) -> DataFrame:
    """(conv_id, seq, texts, tokens, content, is_result, is_call) of messages; prices are computed in the JVM. A column
    tool_calls, an array, counts as calls too; a column overhead is kept."""
    from brevia.operators.accounting import sum_tokens

    role, content = F.col("role"), F.col("content")
    calls = F.col("tool_calls") if "tool_calls" in messages.columns else None
    return messages.select(
        "conv_id", "seq", flattened_texts(content).alias("texts"), sum_tokens(billed_fragments(role, content), config.token_estimate_factor).alias("tokens"),
        F.to_json("content").alias("content"), has_tool_result(role, content).alias("is_result"), has_tool_call(role, content, calls).alias("is_call"),
        *(["overhead"] if "overhead" in messages.columns else []),
    )


def read_turns(rows: pd.DataFrame) -> list[Turn]:
    rows = rows.sort_values("seq", kind="stable")
    return [Turn(tuple(t), int(n), c, bool(r), bool(k)) for t, n, c, r, k in zip(rows.texts, rows.tokens, rows.content, rows.is_result, rows.is_call, strict=True)]


def result_row(conv_id, n: int, done: Pruned, known: dict[str, str]) -> tuple:
    keys, texts = [k for k, _ in done.chain.blocks], [t for _, t in done.chain.blocks]
    return (conv_id, n, done.chain.covered, done.chain.covered_hash, keys, texts, done.newly, done.before, done.after, done.chain.key(), list(known), list(known.values()))


def _pruned(conv_id, rows: pd.DataFrame, about, backend: Backend, config: EngineConfig) -> pd.DataFrame:
    """The row of one conversation; about: what is known of it, a row of EXTRA's columns, or None."""
    chain, known, overhead = None, {}, 0
    if about is not None:
        overhead = 0 if pd.isna(about.overhead) else int(about.overhead)
        if not pd.isna(about.covered):
            chain = Chain(int(about.covered), about.covered_hash, list(zip(about.block_keys, about.block_texts, strict=True)))
        if about.known_keys is not None:
            known = dict(zip(about.known_keys, about.known_texts, strict=True))
    turns = read_turns(rows)
    done = roll(turns, chain, overhead, backend, config, known)
    return pd.DataFrame([result_row(conv_id, len(turns), done, known)] if done else [], columns=[x.split()[0] for x in RESULT.split(", ")])


def prune_history(messages: DataFrame, backend: Backend, config: EngineConfig, chains: DataFrame | None = None, overheads: DataFrame | None = None) -> DataFrame:
    """One row for each conversation that is pruned: its chain, what it saves, and all blocks ever made of it (known).

    chains: (conv_id, covered, covered_hash, block_keys, block_texts[, known_keys, known_texts]) from earlier requests,
    such as these rows or recall(); overheads: (conv_id, overhead) tokens of system text and tools. A conversation is
    read whole by one task.
    """
    turns = turns_of(messages, config).groupBy("conv_id")
    if chains is None and overheads is None:
        return turns.applyInPandas(lambda key, rows: _pruned(key[0], rows, None, backend, config), RESULT)
    fields = [x.split() for x in f"{CHAIN}, {KNOWN}".split(", ")]
    about = None
    if chains is not None:
        about = chains.select(F.col("conv_id").alias("about_id"), *(F.col(n) if n in chains.columns else F.lit(None).cast(k).alias(n) for n, k in fields))
    if overheads is not None:
        more = overheads.select(F.col("conv_id").alias("about_id"), F.col("overhead").cast("long").alias("overhead"))
        about = more if about is None else about.join(more, "about_id", "full")
    about = about.select("about_id", *(F.col(n) if n in about.columns else F.lit(None).cast(k).alias(n) for n, k in [*fields, ("overhead", "long")]))

    def run(key, rows: pd.DataFrame, extra: pd.DataFrame) -> pd.DataFrame:
        return _pruned(key[0], rows, extra.iloc[0] if len(extra) else None, backend, config) if len(rows) else pd.DataFrame(columns=[x.split()[0] for x in RESULT.split(", ")])

    return turns.cogroup(about.groupBy("about_id")).applyInPandas(run, RESULT)


def conversation_keys(messages: DataFrame) -> DataFrame:
    """(conv_id, conv_key): a fingerprint of each conversation's first message, which knows it again under another id."""
    first = messages.groupBy("conv_id").agg(F.min_by(F.to_json("content"), "seq").alias("head"))
    return first.select("conv_id", F.concat(F.lit(SNAPSHOT), fingerprint36(F.col("head"))).alias("conv_key"))


def snapshots(messages: DataFrame, pruned: DataFrame) -> DataFrame:
    """(conv_key, chain, known blocks) of pruned conversations, to be kept until the next request."""
    names = [x.split()[0] for x in f"{CHAIN}, {KNOWN}".split(", ")]
    return pruned.join(conversation_keys(messages), "conv_id").groupBy("conv_key").agg(F.max_by(F.struct(*names), "covered").alias("x")).select("conv_key", "x.*")


def recall(messages: DataFrame, kept: DataFrame) -> DataFrame:
    """snapshots() as chains of messages' conversations."""
    return conversation_keys(messages).join(kept, "conv_key").drop("conv_key")


def assemble(messages: DataFrame, pruned: DataFrame) -> DataFrame:
    """The messages that are sent: each chain's blocks as user messages, then the turns it doesn't cover."""
    from brevia.schema import SOURCE, text_block

    tag = F.struct(F.lit("plugin").alias("kind"), F.lit("brevia").alias("plugin"), F.lit(None).cast("string").alias("form"), F.lit(None).cast("string").alias("summary")).cast(SOURCE)
    blocks = pruned.select("conv_id", F.posexplode("block_texts").alias("k", "text")).select("conv_id", (F.col("k") - 1_000_000).cast("long").alias("seq"), F.lit("user").alias("role"), F.array(text_block(F.col("text"))).alias("content"), tag.alias("source"))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("seq"))
    rest = messages.withColumn("__place", place).join(pruned.select("conv_id", "covered"), "conv_id", "left").filter(F.col("__place") > F.coalesce("covered", F.lit(0)))
    return blocks.unionByName(rest.select(blocks.columns))


def source_window(turns: DataFrame, config: EngineConfig) -> DataFrame:
    """(conv_id, seq, text) rows -> (conv_id, source): source_text() of all turns as window functions."""
    from pyspark.sql import Window

    newer = Window.partitionBy("conv_id").orderBy(F.col("seq").desc()).rowsBetween(Window.unboundedPreceding, -1)
    size = u16_len(F.col("text"))
    room = F.lit(config.prune_max_source_chars) - F.coalesce(F.sum(size).over(newer), F.lit(0))
    taken = turns.filter("text <> ''").withColumn("room", room).filter("room > 0").withColumn("part", u16_right(F.col("text"), F.col("room").cast("int")))
    parts = F.array_sort(F.collect_list(F.struct("seq", "part")))
    return taken.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["part"]), "\n\n").alias("source"))


def whole_block_window(blocks: DataFrame, most: int) -> DataFrame:
    """(conv_id, seq, text) rows -> (conv_id, n_taken, source): the newest whole texts that fit, one at least."""
    from pyspark.sql import Window

    newest = Window.partitionBy("conv_id").orderBy(F.col("seq").desc())
    sums = blocks.withColumn("size", F.sum(u16_len(F.col("text"))).over(newest.rowsBetween(Window.unboundedPreceding, 0))).withColumn("place", F.row_number().over(newest))
    taken = sums.filter((F.col("place") == 1) | (F.col("size") <= most))
    parts = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return taken.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_taken"), F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("source"))
