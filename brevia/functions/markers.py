"""Stats lines that wrap summaries, written and read back.

A distilled block is an opening line with its statistics, the summary and a closing line; so is a
pruned one. A percentage of tokens that were gained, not saved, is written with a plus sign; the reader
takes both signs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brevia.functions.text import first_line, round_half_up, savings_percent

# The grammar of both blocks.
DISTILL_PREFIX = "⟦本地蒸馏"
DISTILL_OPEN = "⟦本地蒸馏·原文{0}字符·≈{1}→{2} tokens（{3}%）⟧"
DISTILL_CLOSE = "⟦蒸馏结束⟧"
DISTILL_LINE = r"^⟦本地蒸馏·原文(\d+)字符·≈(\d+)→(\d+) tokens（([+-]?\d+)%）⟧"
PRUNE_PREFIX = "⟦历史剪枝"
PRUNE_OPEN = "⟦历史剪枝·省略{0}条消息·保留最近{1}条·原文≈{2}→{3} tokens（{4}%）⟧"
PRUNE_CLOSE = "⟦剪枝结束⟧"
PRUNE_LINE = r"^⟦历史剪枝·省略(\d+)条消息·保留最近(\d+)条·原文≈(\d+)→(\d+) tokens（([+-]?\d+)%）⟧"


def percent_sign(before: int, after: int) -> str:
    saved = round_half_up((1 - after / before) * 100) if before else 0
    return f"-{saved}" if saved >= 0 else f"+{-saved}"


def distill_block(chars: int, before: int, after: int, summary: str) -> str:
    return f"{DISTILL_OPEN.format(chars, before, after, percent_sign(before, after))}\n{summary}\n{DISTILL_CLOSE}"


def prune_block(omitted: int, kept: int, before: int, after: int, summary: str) -> str:
    return f"{PRUNE_OPEN.format(omitted, kept, before, after, percent_sign(before, after))}\n{summary}\n{PRUNE_CLOSE}"


def strip_prune_lines(text: str) -> str:
    return "\n".join(line for line in text.split("\n") if not line.startswith(PRUNE_PREFIX) and line != PRUNE_CLOSE)


def _filled(template: str, *values: Column) -> Column:
    parts, rest = [], template
    for k, value in enumerate(values):
        left, _, rest = rest.partition(f"{{{k}}}")
        parts += [F.lit(left), value.cast("string")]
    return F.concat(*parts, F.lit(rest))


def signed_percent(before: Column, after: Column) -> Column:
    saved = savings_percent(before, after)
    return F.concat(F.when(saved >= 0, "-").otherwise("+"), F.abs(saved).cast("string"))


def distill_line_column(chars: Column, before: Column, after: Column) -> Column:
    return _filled(DISTILL_OPEN, chars, before, after, signed_percent(before, after))


def distill_block_column(chars: Column, before: Column, after: Column, summary: Column) -> Column:
    return F.concat(distill_line_column(chars, before, after), F.lit("\n"), summary, F.lit(f"\n{DISTILL_CLOSE}"))


def is_marked(c: Column) -> Column:
    return c.startswith(DISTILL_PREFIX) | c.startswith(PRUNE_PREFIX)


def mark_line(c: Column) -> Column:
    """The stats line of a distilled text, else null."""
    return F.when(c.startswith(DISTILL_PREFIX), first_line(c))


def read_mark(line: Column) -> Column:
    """(chars, before, after, percent) of a stats line; null if it can't be read."""
    part = lambda k: F.regexp_extract(line, DISTILL_LINE, k).cast("long")
    return F.when(line.rlike(DISTILL_LINE), F.struct(*(part(k + 1).alias(name) for k, name in enumerate(("chars", "before", "after", "percent")))))


def strip_prune_lines_column(c: Column) -> Column:
    lines = F.filter(F.split(c, "\n"), lambda x: ~x.startswith(PRUNE_PREFIX) & (x != PRUNE_CLOSE))
    return F.array_join(lines, "\n")
