"""Oracle SQL of the sequential operators, as recursive queries, for texts without ideographs and astral characters.

Each function takes a query that gives (id, t, ...) and returns one; they nest.
"""

from __future__ import annotations

from brevia.functions.chunking import TRUNCATED
from brevia.functions.markers import DISTILL_CLOSE, PRUNE_CLOSE, PRUNE_OPEN
from brevia.functions.text import OTHER_WEIGHT
from brevia.plans import sqltext as S

BREAK = "chr(10) || chr(10)"
GRAMS = "CASE WHEN length({0}) >= 3 THEN list_distinct(list_transform(range(1, length({0}) - 1), lambda k: substring({0}, k, 3))) ELSE [] END"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def token_chunks(source: str) -> str:
    """(id, chunks) of (id, t, budget)."""
    most = f"greatest(1, list_max(list_filter(range((budget / {OTHER_WEIGHT}::DOUBLE)::BIGINT - 5, (budget / {OTHER_WEIGHT}::DOUBLE)::BIGINT + 9), lambda k: floor({OTHER_WEIGHT}::DOUBLE * k + 0.5::DOUBLE) <= budget)))"
    return f"""(WITH RECURSIVE src AS (SELECT id, t, budget::BIGINT AS budget, {most} AS most FROM ({source})),
        lines AS (SELECT *, {S.estimate("l")} AS cost FROM (SELECT id, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS k, unnest(string_split(t, chr(10))) AS l FROM src)),
        f AS (SELECT id, budget, most, 0::BIGINT AS k, NULL::VARCHAR AS held, 0::BIGINT AS spent, []::VARCHAR[] AS done FROM src
            UNION ALL
            SELECT id, budget, most, k, CASE WHEN cost > budget THEN NULL WHEN kept IS NULL THEN nullif(l, '') ELSE kept || chr(10) || l END,
                CASE WHEN cost <= budget THEN used + cost + 1 WHEN kept IS NULL THEN used ELSE 0 END,
                CASE WHEN cost > budget THEN list_concat(out, CASE WHEN kept IS NULL THEN [] ELSE [kept] END, list_transform(range(0, length(l), most), lambda j: substring(l, j + 1, most))) ELSE out END
            FROM (SELECT *, CASE WHEN full_up THEN NULL ELSE held END AS kept, CASE WHEN full_up THEN 0 ELSE spent END AS used, CASE WHEN full_up THEN list_append(done, held) ELSE done END AS out
                FROM (SELECT f.id, budget, most, x.k, held, spent, done, l, cost, held IS NOT NULL AND spent + cost + 1 > budget AS full_up FROM f JOIN lines x ON x.id = f.id AND x.k = f.k + 1)))
        SELECT id, CASE WHEN held IS NULL THEN done ELSE list_append(done, held) END AS chunks FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC) = 1)"""


def truncated(source: str) -> str:
    """(id, content, truncated, original_tokens) of (id, t, budget)."""
    head = token_chunks("SELECT id, t, greatest(1, budget * 6 // 10) AS budget FROM long")
    return f"""(WITH src AS (SELECT id, t, budget, {S.estimate("t")} AS whole FROM ({source})), long AS (SELECT * FROM src WHERE whole > budget),
        back AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k DESC) AS place, sum({S.estimate("l")} + 1) OVER (PARTITION BY id ORDER BY k DESC) AS size
            FROM (SELECT id, budget - greatest(1, budget * 6 // 10) AS room, unnest(range(len(string_split(t, chr(10))))) AS k, unnest(string_split(t, chr(10))) AS l FROM long)),
        tails AS (SELECT id, string_agg(l, chr(10) ORDER BY k) AS tail FROM back WHERE place = 1 OR size <= room GROUP BY id)
        SELECT s.id, CASE WHEN tail IS NULL THEN t ELSE coalesce(chunks[1], '') || {quoted(TRUNCATED)} || tail END AS content, tail IS NOT NULL AS truncated, whole AS original_tokens
        FROM src s LEFT JOIN tails USING (id) LEFT JOIN {head} h ON h.id = s.id)"""


def prefix_answer(share: float) -> str:
    return S.prefix("part", share)


def extract_answer(share: float) -> str:
    """The lines with facts, each once, as many as there is room for."""
    lines = "list_filter(string_split(part, chr(10)), lambda l, k: list_position(string_split(part, chr(10)), l) = k AND regexp_matches(l, '(?i)[0-9]|/|error|fail|warn'))"
    fits = f"coalesce(list_sum(list_transform(a, lambda x: length(x) + 1)), 0) + length(l[1]) + 1 <= floor(length(part) * {share}::DOUBLE)"
    return f"array_to_string(list_reduce(list_prepend([]::VARCHAR[], list_transform({lines}, lambda x: [x])), lambda a, l: CASE WHEN {fits} THEN list_concat(a, l) ELSE a END), chr(10))"


def distilled(source: str, most: int, answer: str) -> str:
    """(id, n_parts, pieces, error) of (id, t): what is left of the pieces of each text; pieces is null where none got shorter
    or one failed."""
    return f"""(WITH RECURSIVE src AS (SELECT id, {S.chunks("t", most)} AS parts FROM ({source})),
        asked AS (SELECT id, k, part, {S.trimmed(answer)} AS said FROM (SELECT id, unnest(range(1, len(parts) + 1)) AS k, unnest(parts) AS part FROM src)),
        checked AS (SELECT id, k, part, CASE WHEN said = '' THEN 'empty answer' WHEN length(said) < length(part) AND length(said) < 0.05::DOUBLE * length(part) THEN 'answer too short (' || length(said) || ' of ' || length(part) || ')' END AS problem,
            CASE WHEN length(said) >= length(part) THEN part ELSE said END AS short, {GRAMS.format("left(short, 1500)")} AS grams FROM asked),
        f AS (SELECT id, 0::BIGINT AS k, 0 AS echoes, NULL::VARCHAR[] AS last, []::VARCHAR[] AS pieces, FALSE AS shorter, NULL::VARCHAR AS error FROM src
            UNION ALL
            SELECT f.id, x.k, CASE WHEN echoes >= 2 THEN echoes WHEN short = part THEN echoes + 1 ELSE 0 END,
                CASE WHEN echoes >= 2 OR short = part OR coalesce(alike, FALSE) THEN last ELSE grams END,
                CASE WHEN echoes >= 2 THEN list_append(pieces, part) WHEN coalesce(alike, FALSE) THEN pieces ELSE list_append(pieces, short) END,
                shorter OR (echoes < 2 AND short <> part), CASE WHEN echoes < 2 THEN problem END
            FROM (SELECT f.*, x.k AS next, part, short, problem, grams, CASE WHEN last IS NULL THEN FALSE WHEN len(grams) + len(last) = 0 THEN TRUE ELSE len(list_intersect(grams, last))::DOUBLE / len(list_distinct(list_concat(grams, last))) >= 0.8::DOUBLE END AS alike
                FROM f JOIN checked x ON x.id = f.id AND x.k = f.k + 1 WHERE error IS NULL) f JOIN (SELECT DISTINCT id, k FROM checked) x ON x.id = f.id AND x.k = f.next)
        SELECT f.id, len(parts) AS n_parts, CASE WHEN shorter AND error IS NULL THEN pieces END AS pieces, error FROM f JOIN src USING (id) QUALIFY row_number() OVER (PARTITION BY f.id ORDER BY k DESC) = 1)"""


def block_line(omitted: str, kept: str, before: str, after: str) -> str:
    return S.filled(PRUNE_OPEN, omitted, kept, before, after, S.signed(S.rounded(f"(1 - {after}::DOUBLE / {before}) * 100")))


def usable(short: str, source: str) -> str:
    return f"{short} <> '' AND length({short}) < length({source}) AND length({short}) >= least(80, 0.02::DOUBLE * length({source}))"


def base36(t: str) -> str:
    return f"lower(to_base({S.fnv1a(t)}, 36))"


def pruned(c) -> str:
    """(conv_id, n, tokens, pos, made, blocks, keys, merged, chain) of conversations that the settings c prune, for texts that
    fit a block's source and turns without tools. blocks and keys are those before a merge; merged is the one block
    of a chain that was too long, else null."""
    step = f"""SELECT r.*, p.texts, p.contents, p.tokens, p.n, least(pos + CASE WHEN pos >= n - {c.prune_keep_recent} THEN least({min(c.prune_batch_size, c.prune_keep_recent)}, size) ELSE size END, n - 1) AS stop
        FROM r JOIN p USING (conv_id) WHERE pos < n - 1 AND made < cap AND chain + list_sum(tokens[pos + 1:n]) > target"""
    for column in (
        f"array_to_string(texts[pos + 1:stop], {BREAK}) AS source", f"{S.trimmed(S.prefix('source', 0.4))} AS short", f"{S.estimate('source')} AS before, {S.estimate('short')} AS after",
        f"{block_line('(stop - pos)', '(n - stop)', 'before', 'after')} || chr(10) || short || chr(10) || '{PRUNE_CLOSE}' AS block",
        f"""'__prune__' || {base36("'[' || array_to_string(contents[pos + 1:stop], ',') || ']'")} AS key""",
    ):
        step = f"SELECT *, {column} FROM ({step})"
    whole = f"SELECT *, list_transform(range(1, made + 1), lambda k: list_sum(list_transform(shorts[k:made], lambda x: length(x)))) AS sizes FROM last WHERE made > {c.prune_chain_max_batches}"
    first = f"list_min(list_filter(range(1, made + 1), lambda k: k = made OR sizes[k] <= {c.prune_max_source_chars}))"
    merge = f"SELECT conv_id, array_to_string(shorts[{first}:made], {BREAK}) AS source, pos, n FROM ({whole})"
    merge = f"SELECT *, {S.trimmed(S.prefix('source', 0.4))} AS short, {S.estimate('source')} AS before FROM ({merge})"
    merge = f"SELECT conv_id, {block_line('pos', '(n - pos)', 'before', S.estimate('short'))} || chr(10) || short || chr(10) || '{PRUNE_CLOSE}' AS merged FROM ({merge}) WHERE {usable('short', 'source')}"
    return f"""(WITH RECURSIVE c AS (SELECT conv_id, list(text ORDER BY turn) AS texts, list('[{{"type":"text","text":' || to_json(text) || '}}]' ORDER BY turn) AS contents, list({S.estimate("text")} ORDER BY turn) AS tokens, count(*) AS n FROM conversations GROUP BY conv_id),
        e AS (SELECT *, list_sum(tokens) / {c.threshold}::DOUBLE AS over FROM c WHERE n > {c.prune_keep_recent} AND list_sum(tokens) > {c.threshold}),
        p AS (SELECT *, CASE WHEN over > 2 THEN {max(3 * c.prune_batch_size, 48)} ELSE {c.prune_batch_size} END AS size, greatest({max(c.prune_max_new_blocks, 8)}, least(48, greatest(12, floor(over + 0.5::DOUBLE) * 3))) AS cap FROM e),
        r AS (SELECT conv_id, 0::BIGINT AS pos, 0 AS made, {c.threshold}::DOUBLE AS target, []::VARCHAR[] AS blocks, []::VARCHAR[] AS shorts, []::VARCHAR[] AS keys, 0::BIGINT AS chain FROM p
            UNION ALL
            SELECT conv_id, stop, made + 1, {c.prune_budget_tokens}::DOUBLE, list_append(blocks, block), list_append(shorts, short), list_append(keys, key), chain + {S.estimate("block")} FROM ({step}) WHERE {usable('short', 'source')}),
        last AS (SELECT r.*, tokens, n FROM r JOIN (SELECT conv_id, tokens, n FROM p) USING (conv_id) WHERE made > 0 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY made DESC) = 1)
        SELECT conv_id, n, tokens, pos, made, blocks, keys, merged, CASE WHEN merged IS NULL THEN chain ELSE {S.estimate("merged")} END AS chain FROM last LEFT JOIN ({merge}) USING (conv_id))"""


def pruned_rows(c) -> str:
    """The digest of prune_history() that the queries give."""
    return f"""SELECT conv_id, n::INTEGER AS n_messages, pos::INTEGER AS covered, CASE WHEN merged IS NULL THEN made ELSE 1 END::INTEGER AS n_blocks, pos::INTEGER AS newly, list_sum(tokens)::BIGINT AS before_tokens,
        (chain + list_sum(tokens[pos + 1:n]))::BIGINT AS after_tokens, md5(coalesce(merged, array_to_string(blocks, {BREAK}))) AS digest FROM {pruned(c)}"""


def thousands(x: str) -> str:
    return f"(({x} + 50) // 1000 || '.' || ({x} + 50) // 100 % 10 || 'K')"


def notices(c, d) -> str:
    """Notices of conversations pruned by the settings c, of which what is left is distilled by d, one chunk a text."""
    eligible = " OR ".join(f"role = '{r}'" for r in d.distill_roles)
    figures = f"chars || ' characters, ' || before || ' to ' || after || ' tokens (' || {S.saved('before', 'after')} || ' % saved)'"
    line = lambda name, x: f"CASE WHEN {x} > 0 THEN chr(10) || '- {name}: ' || {thousands(x)} ELSE '' END"
    return f"""WITH pr AS (SELECT conv_id, pos, chain, list_sum(tokens) AS all_tokens, '__chain__' || {base36("CASE WHEN merged IS NULL THEN '[' || array_to_string(list_transform(keys, lambda k: '\"' || k || '\"'), ',') || ']' ELSE '' END")} AS chain_key FROM {pruned(c)}),
        t AS (SELECT *, ({eligible}) AND {S.u16("text")} >= {d.distill_min_chars} AS wanted, {S.trimmed(S.prefix("text", 0.4))} AS short
            FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations) LEFT JOIN pr USING (conv_id) WHERE place > coalesce(pos, 0)),
        m AS (SELECT *, {S.u16("text")} AS chars, {S.calibrated("text", d.token_estimate_factor)} AS before, {S.calibrated("short", d.token_estimate_factor)} AS after FROM t),
        k AS (SELECT *, CASE WHEN wanted THEN {S.distill_line("chars", "before", "after")} END AS mark FROM m),
        sums AS (SELECT conv_id, any_value(pos) AS pos, any_value(chain_key) AS chain_key, any_value(all_tokens) AS all_tokens, coalesce(any_value(chain), 0)::BIGINT AS history,
            sum(CASE WHEN wanted THEN {S.calibrated(f"mark || chr(10) || short || chr(10) || '{DISTILL_CLOSE}'", c.token_estimate_factor)} ELSE {S.calibrated("text", c.token_estimate_factor)} END)::BIGINT AS conversation,
            list_sort(list_distinct(list(substring(sha256(mark), 1, 16)) FILTER (WHERE wanted))) AS ids, count(*) FILTER (WHERE wanted) AS n, min(mark) AS one,
            sum(chars) FILTER (WHERE wanted) AS chars, sum(before) FILTER (WHERE wanted) AS before, sum(after) FILTER (WHERE wanted) AS after FROM k GROUP BY conv_id),
        s AS (SELECT *, history + conversation AS total, coalesce(all_tokens, history + conversation)::BIGINT AS whole, chain_key IS NOT NULL AS is_pruned, n > 0 AS is_fresh,
            CASE WHEN n = 1 THEN one ELSE n || ' texts shortened: ' || {figures} END AS row_text, CASE WHEN n = 1 THEN one ELSE n || ' texts: ' || {figures} END AS card_text FROM sums)
        SELECT conv_id, CASE WHEN is_pruned THEN 'p|' || chain_key ELSE '' END || CASE WHEN is_pruned AND is_fresh THEN '|' ELSE '' END || CASE WHEN is_fresh THEN 'm|' || array_to_string(ids, ',') ELSE '' END AS notice_key,
            CASE WHEN is_pruned THEN pos || ' turns summarised, ' || {S.saved("whole", "total")} || ' % saved' || CASE WHEN is_fresh THEN ', ' || n || ' texts shortened' ELSE '' END ELSE row_text END AS summary,
            'sent ' || {thousands("total")} || ' of ' || {thousands("whole")} || ' tokens' || {line("summaries", "history")} || {line("conversation", "conversation")} || CASE WHEN is_fresh THEN chr(10) || card_text ELSE '' END AS text
        FROM s WHERE is_pruned OR is_fresh"""


def stability(c) -> str:
    """pruned_stability() of conversations that settings c prune without ever merging blocks."""
    suffix = "list_sum(tokens[pos + 1:n])"
    over = f"(start / {c.threshold}::DOUBLE)"
    most = f"CASE WHEN {over} > 1 THEN greatest(first, least(48, greatest(12, floor({over} + 0.5::DOUBLE) * 3))) ELSE first END"
    step = f"""SELECT f.*, c.texts, c.contents, c.tokens, c.total, {suffix} AS rest, CASE WHEN {over} > 2 THEN {max(3 * c.prune_batch_size, 48)} ELSE {c.prune_batch_size} END AS size, {most} AS most FROM f JOIN c USING (conv_id) WHERE n <= total"""
    for column in (
        f"n > {c.prune_keep_recent} AND pos < n - 1 AND made < most AND chain + rest > target AS due, least(pos + CASE WHEN pos >= n - {c.prune_keep_recent} THEN least({min(c.prune_batch_size, c.prune_keep_recent)}, size) ELSE size END, n - 1) AS stop",
        f"array_to_string(texts[pos + 1:stop], {BREAK}) AS source", f"{S.trimmed(S.prefix('source', 0.4))} AS short", f"{S.estimate('source')} AS before, {S.estimate('short')} AS after, due AND {usable('short', 'source')} AS rolls",
        f"{block_line('(stop - pos)', '(n - stop)', 'before', 'after')} || chr(10) || short || chr(10) || '{PRUNE_CLOSE}' AS block", "array_to_string(list_concat(blocks, contents[pos + 1:n]), chr(1)) AS now",
        "CASE WHEN NOT rolls AND wire IS NOT NULL THEN coalesce(list_position(list_transform(list_zip(string_split(wire, ''), string_split(now, '')), lambda z: z[1] IS DISTINCT FROM z[2]), TRUE) - 1, length(now)) END AS same",
    ):
        step = f"SELECT *, {column} FROM ({step})"
    return f"""WITH RECURSIVE c AS (SELECT conv_id, list(text ORDER BY turn) AS texts, list('[{{"type":"text","text":' || to_json(text) || '}}]' ORDER BY turn) AS contents, list({S.estimate("text")} ORDER BY turn) AS tokens, count(*) AS total FROM conversations GROUP BY conv_id),
        f AS (SELECT conv_id, 1::BIGINT AS n, 0::BIGINT AS pos, 0 AS made, {c.threshold}::DOUBLE AS target, []::VARCHAR[] AS blocks, 0::BIGINT AS chain, tokens[1]::BIGINT AS start, {max(c.prune_max_new_blocks, 8)} AS first, NULL::VARCHAR AS wire, NULL::DOUBLE AS hit, 0::BIGINT AS rolled_at FROM c
            UNION ALL
            SELECT conv_id, CASE WHEN rolls THEN n ELSE n + 1 END, CASE WHEN rolls THEN stop ELSE pos END, CASE WHEN rolls THEN made + 1 ELSE 0 END, CASE WHEN rolls THEN {c.prune_budget_tokens}::DOUBLE ELSE {c.threshold}::DOUBLE END,
                CASE WHEN rolls THEN list_append(blocks, block) ELSE blocks END, CASE WHEN rolls THEN chain + {S.estimate("block")} ELSE chain END, CASE WHEN rolls THEN start ELSE (chain + list_sum(tokens[pos + 1:n + 1]))::BIGINT END,
                CASE WHEN rolls THEN first WHEN pos > 0 THEN {c.prune_max_new_blocks} ELSE {max(c.prune_max_new_blocks, 8)} END, CASE WHEN rolls THEN wire ELSE now END, CASE WHEN NOT rolls THEN 100 * same::DOUBLE / length(now) END, CASE WHEN NOT rolls AND made > 0 THEN n ELSE 0 END FROM ({step}))
        SELECT conv_id, max(n - 1)::INTEGER AS n_requests, round(avg(hit), 6) AS mean_hit, round(min(hit), 6) AS min_hit, count(*) FILTER (WHERE hit >= 90)::INTEGER AS n_high, count(*) FILTER (WHERE rolled_at > 0)::INTEGER AS n_rolls, 0 AS n_compactions,
            round(CASE WHEN max(rolled_at) > 0 THEN max(rolled_at)::DOUBLE / count(*) FILTER (WHERE rolled_at > 0) END, 6) AS mean_interval, max(len(blocks))::INTEGER AS max_blocks FROM f GROUP BY conv_id"""
