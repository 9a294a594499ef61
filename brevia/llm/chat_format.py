"""Chat formatting with tool-call linking.

Messages, tool calls and tool results are three tables of one conversation id each. Calls and results
are joined by (conversation, identifier). Arguments are checked against the tool's schema and written,
like everything else, as canonical JSON: no blanks, keys sorted by code point, numbers as ECMAScript writes
them (1.50 is 1.5, 2.0 is 2; whole numbers keep all their digits), characters unescaped where JSON allows,
halves of surrogate pairs escaped.

Order: an argument "$call:ID" refers to the result of call ID of the same conversation. A rank is given
to every event, the smallest that is no less than its turn and greater than the ranks of what it must
follow: a result its call, a call the results it refers to (or their calls, if unanswered). Events
sorted by (rank, kind, turn, call_id) are in topological order. The calls of a conversation, of up to WHOLE,
are ranked by one task in one pass; of a call it holds the identifier, its references and two numbers. Ranks of
larger conversations are found in rounds of joins on the
identifier: a call that refers to one other is a function max(a, x + b) of when that one ends, and such
functions are composed, so a chain takes as many rounds as the logarithm of its length; a call with several
references waits for all of them, so chains of such calls take as many rounds as they are long. Calls in or
behind a circle of references keep their turn and are called cyclic. No text is gathered in one place.

Of several calls (results) of one identifier the first turn counts, of one turn the first by a hash of what is
said, and the others are duplicate; equal rows are one event told twice and share its status. Results without
call are orphan, calls without result unanswered. References to calls that aren't there are ignored. Null texts
are JSON null. Arguments that are no JSON object or hold a key twice, null ones too, are invalid and written as
a JSON string (null: null). Extra columns are left out; empty tables are fine.
"""

from __future__ import annotations

import json
import math
import re
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brevia.llm.shared import cut, tables

#: The tools of op10: a subset of JSON Schema (type, required, properties, additionalProperties, items, enum, minimum, maximum).
SCHEMAS = {
    "search": {"type": "object", "required": ["query", "limit"], "additionalProperties": False, "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1}}},
    "lookup": {"type": "object", "required": ["id", "after"], "additionalProperties": False, "properties": {"id": {"type": "integer"}, "after": {"type": "string"}, "also": {"type": "string"}}},
    "scale": {"type": "object", "required": ["by"], "properties": {"by": {"type": "number", "minimum": 0}, "of": {"type": "integer"}}},
}
KIND = {"message": 0, "call": 1, "result": 2}
LONE = re.compile("[\ud800-\udfff]")


def _string(x) -> str:
    """JSON of a string or null; halves of surrogate pairs, which no UTF-8 text holds, are escaped."""
    out = json.dumps(x, ensure_ascii=False)
    return out if out.isascii() else LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", out)


def _number(x: float) -> str:
    """The shortest digits that read back as x, written as ECMAScript does."""
    if not math.isfinite(x):
        raise ValueError("not a JSON number")
    if x == 0:
        return "0"
    if 1e-6 <= abs(x) < 1e21:
        digits = format(Decimal(repr(x)), "f")
        return digits.rstrip("0").rstrip(".") if "." in digits else digits
    digits, _, power = repr(x).partition("e")
    return f"{digits.removesuffix('.0')}e{int(power):+d}"


def canonical(value) -> str:
    """Canonical JSON of a parsed value; raises ValueError for numbers that JSON lacks."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{_string(k)}:{canonical(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, float):
        return _number(value)
    return _string(value)


_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def fault(value, schema: dict, at: str = "") -> str | None:
    """The first fault of a parsed value against a schema, or None."""
    where = at or "arguments"
    kind = schema.get("type")
    if kind in ("integer", "number"):
        fits = isinstance(value, int | float) and not isinstance(value, bool) and (kind == "number" or value == int(value))
    else:
        fits = kind is None or isinstance(value, _TYPES[kind])
    if not fits:
        return f"{where}: not of type {kind}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{where}: not in the enumeration"
    if "minimum" in schema and value < schema["minimum"]:
        return f"{where}: less than {schema['minimum']}"
    if "maximum" in schema and value > schema["maximum"]:
        return f"{where}: more than {schema['maximum']}"
    if isinstance(value, dict):
        properties = schema.get("properties", {})
        for name in schema.get("required", ()):
            if name not in value:
                return f"{at + '.' if at else ''}{name}: missing"
        for name in sorted(value):
            here = f"{at + '.' if at else ''}{name}"
            if name in properties:
                if found := fault(value[name], properties[name], here):
                    return found
            elif schema.get("additionalProperties", True) is False:
                return f"{here}: unknown"
    if isinstance(value, list) and "items" in schema:
        for k, item in enumerate(value):
            if found := fault(item, schema["items"], f"{where}[{k}]"):
                return found
    return None


class _Repeated(ValueError):
    pass


def _refuse(token: str):
    raise ValueError(token)


def _object(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise _Repeated
    return out


def read_arguments(name: str | None, raw: str | None, schemas: dict) -> tuple[str, str | None]:
    """Canonical JSON of a call's arguments, and their fault."""
    try:
        value = json.loads(raw, parse_constant=_refuse, object_pairs_hook=_object) if raw is not None else None
        text = canonical(value)
    except _Repeated:
        return _string(raw), "arguments: repeated key"
    except (ValueError, RecursionError, OverflowError):
        return _string(raw), "arguments: not JSON"
    if not isinstance(value, dict):
        return _string(raw), "arguments: not of type object"
    if name not in schemas:
        return text, "unknown tool"
    found = fault(value, schemas[name])
    return text, found and LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", found)


def _message_json(role: Column, text: Column) -> Column:
    @F.arrow_udf("string")
    def form(roles: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.array([f'{{"content":{_string(t)},"role":{_string(r)}}}' for r, t in zip(roles.to_pylist(), texts.to_pylist(), strict=True)], pa.string())

    return form(role, text)


def _call_json(call_id: Column, name: Column, arguments: Column, schemas: dict) -> Column:
    @F.arrow_udf("struct<json:string,error:string>")
    def form(ids: pa.Array, names: pa.Array, raws: pa.Array) -> pa.Array:
        out, errors = [], []
        for k, name, raw in zip(ids.to_pylist(), names.to_pylist(), raws.to_pylist(), strict=True):
            text, error = read_arguments(name, raw, schemas)
            out.append(f'{{"arguments":{text},"id":{_string(k)},"name":{_string(name)}}}')
            errors.append(error)
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(errors, pa.string())], ["json", "error"])

    return form.asNondeterministic()(call_id, name, arguments)


def _result_json(call_id: Column, text: Column) -> Column:
    @F.arrow_udf("string")
    def form(ids: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.array([f'{{"content":{_string(t)},"role":"tool","tool_call_id":{_string(k)}}}' for k, t in zip(ids.to_pylist(), texts.to_pylist(), strict=True)], pa.string())

    return form(call_id, text)


WHO = ["conv_id", "call_id"]
#: Calls (distinct identifiers) of a conversation that one task ranks, some 60 MB.
WHOLE = 200_000


def _said(*columns: str) -> Column:
    return F.xxhash64(*columns)


def _linked(calls: DataFrame, results: DataFrame) -> DataFrame:
    """(conv_id, call_id, first, turn, refs, answer, answered) of every identifier: its first call (turn, hash) and what that
    refers to, and its first result; null where there is none. One hash join."""
    refs = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col("arguments"), F.lit("")), F.lit(r'"\$call:([^"\\]+)"'), F.lit(1)))
    event = lambda *said: F.struct("turn", _said(*said).alias("said"))
    asked = calls.groupBy(*WHO).agg(F.min(F.struct(event("name", "arguments").alias("event"), refs.alias("refs"))).alias("x"))
    answers = results.groupBy(*WHO).agg(F.min(event("text")).alias("answer"))
    both = asked.hint("shuffle_hash").join(answers, WHO, "full")
    return cut(both.select(*WHO, F.col("x.event").alias("first"), F.col("x.event.turn").alias("turn"), F.col("x.refs").alias("refs"), "answer", F.col("answer.turn").alias("answered")))


def _waits() -> tuple[Column, Column]:
    """a and b of a row of _linked(): a call that waits for x ends at max(a, x + b)."""
    replied = F.col("answered").isNotNull()
    return F.when(replied, F.greatest("answered", F.col("turn") + 1)).otherwise(F.col("turn")), F.when(replied, 2).otherwise(1).cast("long")


def solve(calls: list[tuple]) -> tuple[list[int | None], list[int | None]]:
    """Of all calls (identifier, a, b, references) of a conversation, in their order: when each ends, None in or behind
    a circle, and the latest end of what it refers to."""
    at = {call[0]: k for k, call in enumerate(calls)}
    followers: list[list[int]] = [[] for _ in calls]
    open_refs, ends, above = [0] * len(calls), [None] * len(calls), [None] * len(calls)
    for k, (_, _, _, refs) in enumerate(calls):
        for r in refs:
            if r in at:
                followers[at[r]].append(k)
                open_refs[k] += 1
    ready = [k for k, n in enumerate(open_refs) if not n]
    while ready:
        k = ready.pop()
        _, a, b, _ = calls[k]
        end = a if above[k] is None else above[k] + b if a is None else max(a, above[k] + b)
        if end is None:  # without a turn
            continue
        ends[k] = end
        for f in followers[k]:
            above[f] = end if above[f] is None else max(above[f], end)
            open_refs[f] -= 1
            if not open_refs[f]:
                ready.append(f)
    return ends, above


def _whole(called: DataFrame) -> DataFrame:
    """(conv_id, call_id, end, above) of the calls of called, each conversation's by one task."""
    a, b = _waits()
    rows = called.select(*WHO, a.cast("long").alias("a"), b.alias("b"), "refs").repartition("conv_id").sortWithinPartitions("conv_id")
    kinds = [called.schema[x].dataType.simpleString() for x in WHO]

    def run(batches):
        out, held, last, types = [], [], None, None

        def close():
            if held:
                out.extend((last, call[0], end, above) for call, end, above in zip(held, *solve(held), strict=True))
                held.clear()

        def rows_out():
            columns = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*types, pa.int64(), pa.int64()], strict=True)], [*WHO, "end", "above"])

        for batch in batches:
            types = [batch.schema.field(k).type for k in range(2)]
            for conv, *call in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != last:
                    close()
                    last = conv
                    if len(out) >= 10_000:
                        yield rows_out()
                        out.clear()
                held.append(call)
        close()
        if out:
            yield rows_out()

    return rows.mapInArrow(run, f"conv_id {kinds[0]}, call_id {kinds[1]}, end long, above long")


def _ends(linked: DataFrame, wanted: DataFrame) -> DataFrame:
    """(conv_id, call_id, end) of the calls of linked: the rank of the last event of each, null in or behind a circle.
    wanted: (conv_id, call_id, ref) of references to calls that are there."""
    counted = wanted.groupBy(*WHO).agg(F.count(F.lit(1)).alias("n"), F.min("ref").alias("ref"))
    a, b = _waits()
    rows = linked.join(counted, WHO, "left")
    state = cut(rows.select(*WHO, F.when(F.col("n").isNull(), a).alias("end"), F.when(F.col("n") == 1, F.col("ref")).alias("ref"), (F.col("n") > 1).alias("many"), a.alias("a"), b.alias("b")), True)
    waiting, deep, many = _waiting(state)
    idle = 0
    while waiting and idle <= deep.bit_length():  # by then chains that lead to no end are as short as can be
        there = state.select("conv_id", F.col("call_id").alias("ref"), F.col("end").alias("x"), F.col("ref").alias("next"), F.col("a").alias("a2"), F.col("b").alias("b2"))
        hops = state.join(there, ["conv_id", "ref"], "left")
        jump = F.col("end").isNull() & F.col("x").isNull() & F.col("next").isNotNull()
        moved = hops.select(
            *WHO, F.coalesce("end", F.when(F.col("x").isNotNull(), F.greatest("a", F.col("x") + F.col("b")))).alias("end"), F.when(jump, F.col("next")).otherwise(F.col("ref")).alias("ref"), "many",
            F.when(jump, F.greatest("a", F.col("a2") + F.col("b"))).otherwise(F.col("a")).alias("a"), F.when(jump, F.col("b") + F.col("b2")).otherwise(F.col("b")).alias("b"),
        )
        if many:
            last = wanted.join(there.select("conv_id", "ref", "x"), ["conv_id", "ref"]).groupBy(*WHO).agg(F.max("x").alias("last"), F.count_if(F.col("x").isNull()).alias("open")).filter("open = 0")
            done = F.when(F.col("many"), F.greatest("a", F.col("last") + F.col("b")))
            moved = moved.join(last, WHO, "left").select(*WHO, F.coalesce("end", F.when(F.col("last").isNotNull(), done)).alias("end"), "ref", "many", "a", "b")
        state = cut(moved, True)
        before = waiting
        waiting, deep, many = _waiting(state)
        idle = 0 if waiting < before else idle + 1
    return state.select(*WHO, "end")


def _waiting(state: DataFrame) -> tuple[int, int, int]:
    """How many calls have no end, how many at most in a conversation, and how many of all have several references."""
    by = state.filter("end is null").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("many").alias("many"))
    return tuple(by.agg(*(F.coalesce(x, F.lit(0)) for x in (F.sum("n"), F.max("n"), F.sum("many")))).first())


def _by_rounds(called: DataFrame) -> DataFrame:
    """What _whole() gives, by joins."""
    wanted = cut(called.select(*WHO, F.explode("refs").alias("ref")).join(called.select("conv_id", F.col("call_id").alias("ref")), ["conv_id", "ref"], "left_semi"), True)
    ends = _ends(called, wanted)
    above = wanted.join(ends.withColumnsRenamed({"call_id": "ref", "end": "x"}), ["conv_id", "ref"]).groupBy(*WHO).agg(F.max("x").alias("above"))
    return ends.join(above, WHO, "left").select(*WHO, "end", "above")


def _ranks(linked: DataFrame) -> DataFrame:
    """linked with rank, result_rank and cyclic."""
    called = linked.filter("first is not null and conv_id is not null and call_id is not null")
    counts = called.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    if (counts.agg(F.max("n")).first()[0] or 0) <= WHOLE:
        found = _whole(called)
    else:
        large = F.broadcast(cut(counts.filter(F.col("n") > WHOLE).select("conv_id"), True))
        found = _whole(called.join(large, "conv_id", "left_anti")).union(_by_rounds(called.join(large, "conv_id", "left_semi")))
    cyclic = F.col("first").isNotNull() & F.col("end").isNull()
    rank = F.when(cyclic | F.col("above").isNull(), F.col("turn")).otherwise(F.greatest("turn", F.col("above") + 1))
    after = F.when(F.col("answered").isNotNull(), F.greatest("answered", F.col("rank") + 1))
    return linked.join(found, WHO, "left").withColumn("cyclic", cyclic).withColumn("rank", rank).withColumn("result_rank", after)


def link(messages: DataFrame, calls: DataFrame, results: DataFrame, schemas: dict) -> DataFrame:
    """(conv_id, turn, kind, call_id, rank, status, error, json) of every event.

    messages: (conv_id, turn, role, text); calls: (conv_id, turn, call_id, name, arguments: JSON text);
    results: (conv_id, turn, call_id, text).
    """
    ranks = cut(_ranks(_linked(calls, results)).select(*WHO, "first", "answer", "rank", "result_rank", "cyclic"))
    is_one = lambda event, *said: (F.col("turn") == F.col(f"{event}.turn")) & (_said(*said) == F.col(f"{event}.said"))

    placed = calls.select(*WHO, "turn", "name", "arguments").join(ranks, WHO, "left")
    status = F.when(~is_one("first", "name", "arguments"), "duplicate").when(F.col("cyclic"), "cyclic").when(F.col("result_rank").isNull(), "unanswered").otherwise("linked")
    call_rows = placed.withColumn("__form", _call_json(F.col("call_id"), F.col("name"), F.col("arguments"), schemas)).select(
        "conv_id", "turn", F.lit("call").alias("kind"), "call_id", F.coalesce("rank", "turn").alias("rank"), status.alias("status"), F.col("__form.error").alias("error"), F.col("__form.json").alias("json")
    )
    answers = results.select(*WHO, "turn", "text").join(ranks, WHO, "left")
    status = F.when(F.col("first").isNull(), "orphan").when(~is_one("answer", "text"), "duplicate").otherwise("linked")
    result_rows = answers.select("conv_id", "turn", F.lit("result").alias("kind"), "call_id", F.greatest("turn", "result_rank").alias("rank"), status.alias("status"), F.lit(None).cast("string").alias("error"), _result_json(F.col("call_id"), F.col("text")).alias("json"))
    message_rows = messages.select("conv_id", "turn", F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.col("turn").alias("rank"), F.lit("message").alias("status"), F.lit(None).cast("string").alias("error"), _message_json(F.col("role"), F.col("text")).alias("json"))
    return message_rows.union(call_rows).union(result_rows)


def derived_events(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results for op10, whose table holds plain turns.

    Every assistant turn makes a call with one of three tools, and a user turn that follows directly is its result. By
    conv_id modulo 4, lookups refer 0: to the call two turns before and that four before, 1: to the call two turns later,
    2: in pairs to each other, 3: to the call two turns before; in the first three all calls are lookups. In every
    eleventh conversation calls are made twice, the second time a turn later; in every fifth, results come again two
    turns later; in every seventh, results are of calls that aren't there.
    """
    call_id = lambda turn: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    turn, kind = F.col("turn"), F.pmod(F.col("conv_id"), F.lit(4))
    tool = F.when(kind == 3, F.pmod(F.col("conv_id") + turn, F.lit(3))).otherwise(1)
    size = F.coalesce(F.length("text"), F.lit(0))
    quoted = F.to_json(F.struct(F.coalesce(F.substring("text", 1, 40), F.lit("")).alias("query"), F.pmod(size, F.lit(5)).alias("limit")))
    to = F.when(kind == 1, turn + 2).when(kind == 2, F.when(F.floor(turn / 2) % 2 == 0, turn + 2).otherwise(turn - 2)).otherwise(turn - 2)
    after = F.when(to >= 0, F.concat(F.lit(', "after": "$call:'), call_id(to), F.lit('"'))).otherwise("")
    also = F.when((kind == 0) & (turn >= 4), F.concat(F.lit(', "also": "$call:'), call_id(turn - 4), F.lit('"'))).otherwise("")
    lookup = F.concat(F.lit('{"id": '), F.col("conv_id").cast("string"), after, also, F.lit("}"))
    scale = F.concat(F.lit('{"of": '), turn.cast("string"), F.lit(', "by": '), F.format_string("%d.%02d", F.expr("coalesce(length(text), 0) div 4"), (F.pmod(size, F.lit(4)) * 25)), F.lit("}"))
    times = lambda every, again: F.explode(F.when(F.pmod(F.col("conv_id"), F.lit(every)) == 0, F.array(turn, turn + again)).otherwise(F.array(turn)))
    calls = conversations.filter("role = 'assistant'").select(
        "conv_id", times(11, 1).alias("turn"), call_id(turn).alias("call_id"),
        F.when(tool == 0, "search").when(tool == 1, "lookup").otherwise("scale").alias("name"),
        F.when(tool == 0, quoted).when(tool == 1, lookup).otherwise(scale).alias("arguments"),
    )
    asked = calls.select("conv_id", "call_id").distinct()
    users = conversations.filter("role = 'user' and turn >= 1").select("conv_id", times(5, 2).alias("turn"), call_id(turn - 1).alias("call_id"), "text")
    named = F.when(F.pmod(F.col("conv_id"), F.lit(7)) == 0, F.concat(F.lit("x"), F.col("call_id"))).otherwise(F.col("call_id"))
    return calls, users.join(asked, ["conv_id", "call_id"], "left_semi").select("conv_id", "turn", named.alias("call_id"), "text")


def op10_chat_format(spark, sf_dir: str) -> DataFrame:
    conversations = tables(spark, sf_dir, "conversations")
    return link(conversations, *derived_events(conversations), SCHEMAS)


def oracle() -> str:
    end = "CASE WHEN answered IS NULL THEN r.rank ELSE greatest(answered, r.rank + 1) END"
    return f"""WITH RECURSIVE c AS (SELECT *, 'c' || conv_id || '-' AS stem, conv_id % 4 AS kind, CASE WHEN conv_id % 4 = 3 THEN (conv_id + turn) % 3 ELSE 1 END AS tool, length(text) AS size,
        CASE WHEN conv_id % 4 = 1 OR conv_id % 4 = 2 AND (turn // 2) % 2 = 0 THEN turn + 2 ELSE turn - 2 END AS there FROM conversations),
    k AS (SELECT *, stem || turn AS own FROM c WHERE role = 'assistant'),
    first_results AS (SELECT c.*, CASE WHEN c.conv_id % 7 = 0 THEN 'x' ELSE '' END || k.own AS whose FROM c JOIN k ON k.conv_id = c.conv_id AND k.turn = c.turn - 1 WHERE c.role = 'user'),
    results AS (SELECT *, turn AS heard FROM first_results UNION ALL SELECT *, turn + 2 FROM first_results WHERE conv_id % 5 = 0),
    n AS (SELECT k.*, r.turn AS answered FROM k LEFT JOIN first_results r ON r.conv_id = k.conv_id AND r.whose = k.own),
    refs AS (SELECT a.conv_id, a.own, b.own AS ref FROM k a JOIN k b ON b.conv_id = a.conv_id AND (b.turn = a.there OR a.kind = 0 AND b.turn = a.turn - 4) WHERE a.tool = 1),
    walk AS (SELECT conv_id, own, ref, 1 AS depth FROM refs UNION ALL SELECT w.conv_id, w.own, r.ref, depth + 1 FROM walk w JOIN refs r ON r.conv_id = w.conv_id AND r.own = w.ref WHERE w.conv_id % 4 = 2 AND depth < 40),
    circles AS (SELECT DISTINCT conv_id, own FROM walk WHERE depth = 40),
    r AS (SELECT conv_id, own, turn::BIGINT AS rank, answered FROM n WHERE NOT EXISTS (SELECT 1 FROM refs WHERE refs.conv_id = n.conv_id AND refs.own = n.own)
        UNION ALL
        SELECT n.conv_id, n.own, greatest(n.turn, {end.replace("answered", "r.answered")} + 1), n.answered FROM r JOIN refs ON refs.conv_id = r.conv_id AND refs.ref = r.own JOIN n ON n.conv_id = refs.conv_id AND n.own = refs.own),
    ranked AS (SELECT n.*, coalesce(rank, turn) AS rank, rank IS NULL AS cyclic FROM n LEFT JOIN (SELECT conv_id, own, max(rank) AS rank FROM r GROUP BY ALL) USING (conv_id, own)),
    ends AS (SELECT *, CASE WHEN answered IS NOT NULL THEN greatest(answered, rank + 1) END AS result_rank FROM ranked)
    SELECT conv_id, turn, 'message' AS kind, NULL AS call_id, turn AS rank, 'message' AS status, NULL AS error,
        '{{"content":' || to_json(text)::VARCHAR || ',"role":' || to_json(role)::VARCHAR || '}}' AS json FROM c
    UNION ALL
    SELECT conv_id, turn + again, 'call', own, rank, CASE WHEN again = 1 THEN 'duplicate' WHEN cyclic THEN 'cyclic' WHEN answered IS NULL THEN 'unanswered' ELSE 'linked' END,
        CASE WHEN tool = 0 AND size % 5 = 0 THEN 'limit: less than 1' WHEN tool = 1 AND there < 0 THEN 'after: missing' END,
        '{{"arguments":' || CASE tool WHEN 0 THEN '{{"limit":' || (size % 5) || ',"query":' || to_json(left(text, 40))::VARCHAR || '}}'
            WHEN 1 THEN '{{' || CASE WHEN there >= 0 THEN '"after":"$call:' || stem || there || '",' ELSE '' END || CASE WHEN kind = 0 AND turn >= 4 THEN '"also":"$call:' || stem || (turn - 4) || '",' ELSE '' END || '"id":' || conv_id || '}}'
            ELSE '{{"by":' || (size // 4) || CASE size % 4 WHEN 1 THEN '.25' WHEN 2 THEN '.5' WHEN 3 THEN '.75' ELSE '' END || ',"of":' || turn || '}}' END
            || ',"id":"' || own || '","name":"' || CASE tool WHEN 0 THEN 'search' WHEN 1 THEN 'lookup' ELSE 'scale' END || '"}}'
    FROM (SELECT *, unnest(CASE WHEN conv_id % 11 = 0 THEN [0, 1] ELSE [0] END) AS again FROM ends)
    UNION ALL
    SELECT results.conv_id, heard, 'result', whose, greatest(heard, result_rank), CASE WHEN own IS NULL THEN 'orphan' WHEN heard > results.turn THEN 'duplicate' ELSE 'linked' END, NULL,
        '{{"content":' || to_json(results.text)::VARCHAR || ',"role":"tool","tool_call_id":"' || whose || '"}}' FROM results LEFT JOIN ends ON ends.conv_id = results.conv_id AND own = whose"""
