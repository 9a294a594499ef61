"""Session analytics: folding event logs, pairing calls with results, and stability of request prefixes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brevia.config import EngineConfig
from brevia.operators import accounting as A
from brevia.operators.accounting import billed_fragments
from brevia.operators.prune import guard, prune_history, read_turns, roll, turns_of
from brevia.sources.backends import Backend

LOG = "seq long, type string, time string, data string, op string, start long, end long"


def read_log(spark: SparkSession, path: str, last: int | None = None) -> DataFrame:
    """Events of JSON lines; lines that are no JSON are left out."""
    found = spark.read.schema(f"{LOG}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    found = found.filter(F.col("seq").isNotNull()).drop("_bad")
    return found if last is None else found.filter(F.col("seq") <= last)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """(path, line) of files that are several zstandard frames after one another; bad frames are skipped. A line may
    go on from frame to frame, and ends at a line feed only. A file is read whole by one task."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        magic = b"\x28\xb5\x2f\xfd"
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                whole, parts, at = memoryview(content), [], content.find(magic)
                while at >= 0:
                    reader = zstandard.ZstdDecompressor().decompressobj()
                    try:
                        parts.append(reader.decompress(whole[at:]))
                        at = content.find(magic, len(content) - len(reader.unused_data))
                    except zstandard.ZstdError:
                        at = content.find(magic, at + 1)
                lines = b"".join(parts).decode(errors="replace").split("\n")
                if not lines[-1]:
                    lines.pop()
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(lines), pa.string()), pa.array(lines, pa.string())], ["path", "line"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, line string")


class Surface:
    """Events in order as a linked list. A place is a number that grows along the list, and one that takes the place of
    others takes the first one's number, so what comes first is known without a walk."""

    def __init__(self):
        self.after: dict[int | None, int | None] = {None: None}
        self.before: dict[int | None, int | None] = {None: None}
        self.place: dict[int, int] = {}
        self.n = 0

    def append(self, event: int) -> None:
        self._link(self.before[None], event, None)
        self.place[event] = self.n
        self.n += 1

    def _link(self, left, event, right) -> None:
        self.after[left], self.before[event], self.after[event], self.before[right] = event, left, right, event

    def replace(self, first: int, last: int, event: int) -> None:
        """event instead of first to last; of first alone if last comes before it."""
        if self.place[last] < self.place[first]:
            last = first
        left, right, place, gone = self.before[first], self.after[last], self.place[first], first
        while gone != right:
            del self.place[gone]
            gone = self.after[gone]
        self._link(left, event, right)
        self.place[event] = place

    def __iter__(self):
        at = self.after[None]
        while at is not None:
            yield at
            at = self.after[at]


def fold(events: DataFrame) -> DataFrame:
    """(session, place, seq, type, role, text) of what is left of each session's events.

    append adds an event; replace puts it in the place of the events from start to end (by seq): an unknown
    start appends, an unknown end replaces one. Messages of assistants without text go.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        surface, by_seq = Surface(), {}
        rows = rows.sort_values("seq", kind="stable").reset_index(drop=True)
        for k, (seq, op, start, end) in enumerate(zip(rows.seq, rows.op, rows.start, rows.end, strict=True)):
            first, last = by_seq.get(start), by_seq.get(end)
            if op == "replace" and first in surface.place:
                surface.replace(first, last if last in surface.place else first, k)
            else:
                surface.append(k)
            by_seq[seq] = k
        left = rows.loc[[k for k in surface if not (rows.role[k] == "assistant" and not (rows.text[k] or ""))]].copy()
        left["place"] = range(len(left))
        return left[["session", "place", "seq", "type", "role", "text"]]

    return events.select("session", "seq", "type", "role", "text", "op", "start", "end").groupBy("session").applyInPandas(run, "session long, place int, seq long, type string, role string, text string")


def tool_pairs(calls: DataFrame, results: DataFrame) -> DataFrame:
    """(conv_id, call_id, call_seq, result_seq) of each call and the first result of its id that follows.

    Calls and results of an id are sorted together and each call looks ahead, so repeated ids make no pairs
    of all with all. result_seq is null for calls that stay unanswered.
    """
    both = calls.select("conv_id", "call_id", "seq", F.lit(True).alias("is_call")).union(results.select("conv_id", "call_id", "seq", F.lit(False).alias("is_call")))
    # from the last to the first, so that the frame only grows; of one seq, calls come before results
    later = Window.partitionBy("conv_id", "call_id").orderBy(F.col("seq").desc(), F.col("is_call").cast("int").desc()).rowsBetween(Window.unboundedPreceding, -1)
    answer = F.min(F.when(~F.col("is_call"), F.col("seq"))).over(later)
    return both.withColumn("result_seq", answer).filter("is_call").select("conv_id", "call_id", F.col("seq").alias("call_seq"), "result_seq")


def orphan_results(results: DataFrame, calls: DataFrame) -> DataFrame:
    """Results whose call isn't there."""
    return results.join(calls.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti")


def calls_and_results(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    blocks = messages.select("conv_id", "seq", "role", F.explode("content").alias("b"))
    calls = blocks.filter("role = 'assistant' and b.type = 'tool-call'").select("conv_id", "seq", F.col("b.id").alias("call_id"))
    return calls, blocks.filter("b.type = 'tool-result'").select("conv_id", "seq", F.col("b.tool_call_id").alias("call_id"))


def boundaries(messages: DataFrame, config: EngineConfig) -> DataFrame:
    """(conv_id, start, wanted, end) of each conversation's batches, one after the other, before and after the guard.
    They end before the last turn, or where the guard leaves a batch empty."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        turns, out, at = read_turns(rows), [], 0
        while at < len(turns) - 1:
            wanted = min(at + config.prune_batch_size, len(turns) - 1)
            end = guard(turns, at, wanted)
            out.append((rows.conv_id.iloc[0], at, wanted, end))
            if end <= at:
                break
            at = end
        return pd.DataFrame(out, columns=["conv_id", "start", "wanted", "end"])

    return turns_of(messages, config).groupBy("conv_id").applyInPandas(run, "conv_id long, start int, wanted int, end int")


def owner(requests: DataFrame, events: DataFrame, agents: DataFrame | None = None, recent: int = 8, window: int = 500) -> DataFrame:
    """(request_id, agent): the first agent one of whose last `window` events is among the request's last `recent`
    messages; a sole agent owns all requests. requests: (request_id, seq, message_id); events: (agent, seq, message_id);
    agents: (agent, place), their order; without it, that of their first events (ties: by name)."""
    from brevia.sources.cache import latest

    if agents is None:
        agents = events.groupBy("agent").agg(F.min("seq").alias("place"))
    sole = agents.select("agent").distinct().limit(2).collect()
    rows = requests.select("request_id").distinct()
    if len(sole) == 1:
        return rows.withColumn("agent", F.lit(sole[0].agent))
    tail = latest(requests.filter("message_id is not null"), "request_id", "seq", recent).select("request_id", "message_id")
    seen = latest(events, "agent", "seq", window).select("agent", "message_id").join(agents, "agent")
    found = tail.join(seen, "message_id").groupBy("request_id").agg(F.min(F.struct("place", "agent")).alias("x")).select("request_id", "x.agent")
    return rows.join(found, "request_id", "left")


def wire_order(messages: DataFrame) -> DataFrame:
    """(conv_id, seq, call_id, valid) of every tool result: valid if the nearest message before it that holds no result
    is an assistant's with that call. Messages of users with results are results alone; tool messages without any
    are a result of no call."""
    content, role = F.col("content"), F.col("role")
    has = lambda kind: F.coalesce(F.exists(content, lambda b: b["type"] == kind), F.lit(False))
    ids = lambda kind, field: F.transform(F.filter(content, lambda b: b["type"] == kind), lambda b: b[field])
    answers = (role == "tool") | ((role == "user") & has("tool-result"))
    calls = F.when((role == "assistant") & has("tool-call"), ids("tool-call", "id")).otherwise(F.array().cast("array<string>"))
    before = Window.partitionBy("conv_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    known = F.last(F.when(~answers, F.struct(calls.alias("ids"))), ignorenulls=True).over(before)
    rows = messages.select("conv_id", "seq", answers.alias("answers"), ids("tool-result", "tool_call_id").alias("results"), known.alias("known"))
    found = rows.filter("answers").select("conv_id", "seq", F.explode_outer("results").alias("call_id"), F.col("known.ids").alias("ids"))
    return found.select("conv_id", "seq", "call_id", F.coalesce(F.array_contains("ids", F.col("call_id")), F.lit(False)).alias("valid"))


# --- stability of what is sent -----------------------------------------------------------------------------


def wire_sizes(messages: DataFrame) -> DataFrame:
    """(conv_id, seq, size): characters that a turn adds to its request: role, fragments and separators."""
    parts = billed_fragments(F.col("role"), F.col("content"))
    size = F.length("role") + F.aggregate(parts, F.lit(0), lambda n, t: n + F.length(t) + 1) + 1
    return messages.select("conv_id", "seq", size.cast("long").alias("size"))


def wire_text(messages: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """(conv_id, wire): what a request is to a provider's prefix cache: system text and tools, then each message's role
    and billed fragments, tagged by kind, in order, with NUL between. requests: (conv_id, system, tools_json)."""
    reasons = A.has_tool_call(F.col("role"), F.col("content"))
    tag = lambda kind, text: F.concat(F.lit(f"{kind}:"), text)

    def of(b):
        kind, none = b["type"], F.array().cast("array<string>")
        inner = F.transform(F.filter(F.coalesce(b["content"], F.array().cast("array<struct<type:string,text:string>>")), lambda x: (x["type"] == "text") & x["text"].isNotNull()), lambda x: tag("t", x["text"]))
        held = F.when(kind == "text", F.array(tag("t", b["text"]))).when((kind == "reasoning") & reasons, F.array(tag("r", b["text"]))).when(kind == "tool-call", F.array(tag("a", b["arguments"])))
        return F.when(kind == "tool-result", inner).otherwise(F.coalesce(F.filter(held, lambda t: t.isNotNull()), none))

    parts = F.concat(F.col("role"), F.lit("{"), F.array_join(F.flatten(F.transform("content", of)), "|"), F.lit("}"))
    listed = messages.select("conv_id", "seq", parts.alias("part")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seq", "part"))).alias("parts"))
    body = F.transform("parts", lambda x: x["part"])
    if requests is None:
        return listed.select("conv_id", F.array_join(F.concat(F.array(F.lit("SYS:")), body), "\0").alias("wire"))
    tools = F.when(F.col("tools_json").isNotNull() & (F.col("tools_json") != "[]"), F.array(F.concat(F.lit("TOOLS:"), "tools_json"))).otherwise(F.array().cast("array<string>"))
    head = F.concat(F.array(F.concat(F.lit("SYS:"), F.coalesce("system", F.lit("")))), tools)
    return listed.join(requests, "conv_id", "left").select("conv_id", F.array_join(F.concat(head, body), "\0").alias("wire"))


def plain_stability(sizes: DataFrame) -> DataFrame:
    """(conv_id, seq, hit_percent) of unpruned requests that grow by one turn: the share of each request that
    the one before it holds already."""
    upto = Window.partitionBy("conv_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("size").over(upto)
    return sizes.withColumn("total", total).withColumn("hit_percent", F.floor((F.col("total") - F.col("size")) * 1000 / F.col("total") + 0.5) / 10).filter(F.col("total") > F.col("size")).select("conv_id", "seq", "hit_percent")


def common_prefix(a: str, b: str) -> int:
    """Length of the longest common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def pruned_stability(messages: DataFrame, backend: Backend, config: EngineConfig, first: int = 1) -> DataFrame:
    """Replays each conversation turn by turn: (conv_id, n_requests, mean_hit, min_hit, n_high, n_rolls,
    n_compactions, mean_interval, max_blocks)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        turns = read_turns(rows)
        chain, known, before, hits, rolls, merges, blocks, most = None, {}, None, [], [], 0, 0, 0
        ends = [0]  # of each turn in all turns, with a separator after each
        for t in turns:
            ends.append(ends[-1] + len(t.content) + 1)
        for n in range(first, len(turns) + 1):
            done = roll(turns[:n], chain, 0, backend, config, known)
            chain = done.chain if done else None
            head = [t for _, t in chain.blocks] if chain else []
            if done and done.rolled:
                rolls.append(n)
            merges += len(head) < blocks
            blocks, most = len(head), max(most, len(head))
            covered = chain.covered if chain else 0
            size = sum(map(len, head)) + len(head) + ends[n] - ends[covered] - 1
            if before is not None:
                old_head, old_covered, old_n, old_size = before
                if head == old_head and covered == old_covered:  # turns were added, nothing else
                    same = old_size
                else:  # what is sent differs within the blocks, or where one has turns and the other a block
                    wire = lambda blocks, turns: "\0".join([*blocks, *(t.content for t in turns)])
                    same = common_prefix(wire(old_head, turns[old_covered:old_n]), wire(head, turns[covered:n]))
                hits.append(100 * same / max(1, size))
            before = (head, covered, n, size)
        gaps = [b - a for a, b in zip([first - 1, *rolls], rolls, strict=False)]
        mean = lambda x: float(sum(x) / len(x)) if len(x) else None
        row = (rows.conv_id.iloc[0], len(turns) - first + 1, mean(hits), min(hits, default=None), sum(h >= 90 for h in hits), len(rolls), merges, mean(gaps), most)
        return pd.DataFrame([row], columns=["conv_id", "n_requests", "mean_hit", "min_hit", "n_high", "n_rolls", "n_compactions", "mean_interval", "max_blocks"])

    schema = "conv_id long, n_requests int, mean_hit double, min_hit double, n_high int, n_rolls int, n_compactions int, mean_interval double, max_blocks int"
    return turns_of(messages, config).groupBy("conv_id").applyInPandas(run, schema)


__all__ = ["boundaries", "calls_and_results", "fold", "orphan_results", "owner", "plain_stability", "prune_history", "pruned_stability", "read_frames", "read_log", "tool_pairs", "wire_order", "wire_sizes", "wire_text"]
