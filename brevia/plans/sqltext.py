"""SQL fragments that oracles share: the functions of brevia.functions, written for DuckDB."""

from __future__ import annotations

from brevia.functions.markers import DISTILL_OPEN
from brevia.functions.text import CJK, FNV_PRIME, FNV_START, OTHER_WEIGHT


def u16(t: str) -> str:
    return rf"(length({t}) + len(regexp_extract_all({t}, '[\x{{10000}}-\x{{10ffff}}]')))"


def rounded(x: str) -> str:
    return f"floor(({x}) + 0.5::DOUBLE)::BIGINT"


def estimate(t: str) -> str:
    cjk = f"len(regexp_extract_all({t}, '{CJK}'))"
    return f"greatest(1, {rounded(f'{cjk} + {OTHER_WEIGHT}::DOUBLE * ({u16(t)} - {cjk})')})"


def calibrated(t: str, factor: float) -> str:
    return rounded(f"{estimate(t)} * {factor}::DOUBLE")


def fnv1a(t: str) -> str:
    """Of texts without astral characters."""
    return f"list_reduce(list_prepend({FNV_START}::BIGINT, list_transform(string_split({t}, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c) * {FNV_PRIME}) & 4294967295)"


def saved(before: str, after: str) -> str:
    return f"CASE WHEN {before} > 0 THEN {rounded(f'(1 - {after}::DOUBLE / {before}) * 100')} ELSE 0 END"


def trimmed(t: str) -> str:
    return rf"regexp_replace({t}, '^\s+|\s+$', '', 'g')"


def prefix(t: str, share: float) -> str:
    return f"left({t}, ceil(length({t}) * {share}::DOUBLE)::BIGINT)"


def filled(template: str, *values: str) -> str:
    """A text with {0}, {1}, ... as an expression of the values put in."""
    out = f"'{template}'"
    for k, value in enumerate(values):
        out = out.replace(f"{{{k}}}", f"' || {value} || '")
    return f"({out})"


def signed(percent: str) -> str:
    return f"CASE WHEN {percent} >= 0 THEN '-' ELSE '+' END || abs({percent})"


def distill_line(chars: str, before: str, after: str) -> str:
    return filled(DISTILL_OPEN, chars, before, after, signed(saved(before, after)))


def chunks(t: str, most: int) -> str:
    """chunk_text() as a fold over lines, over-long ones cut beforehand."""
    pieces = f"flatten(list_transform(string_split({t}, chr(10)), lambda l: CASE WHEN length(l) <= {most} THEN [l] ELSE list_transform(range(0, length(l), {most}), lambda k: substring(l, k + 1, {most})) END))"
    fold = (
        f"list_reduce(list_prepend([''], list_transform({pieces}, lambda p: [p])), lambda a, l: CASE WHEN a[len(a)] = '' THEN list_concat(a[1:len(a) - 1], l) "
        f"WHEN length(a[len(a)]) + 1 + length(l[1]) <= {most} THEN list_concat(a[1:len(a) - 1], [a[len(a)] || chr(10) || l[1]]) ELSE list_concat(a, l) END)"
    )
    return f"CASE WHEN length({t}) <= {most} THEN [{t}] ELSE list_filter({fold}, lambda x: x <> '') END"
