"""Mixing sources to target weights by hierarchical budgeting.

Documents hang in a tree domain - language - source. A token budget is handed down it by weight. A
child that cannot use its share, having too few tokens even over MAX epochs, gets what it can use, and
the rest goes to its siblings by weight; only what all siblings together cannot use is left to the
level above. As a node's capacity is the sum of its leaves', that is one pass from the root: at every
node the children are sorted by capacity / weight, and the first ones, as long as the level of the
remaining ones isn't below theirs, are full. Shares are whole tokens; those that rounding down
leaves go one each to the first children that aren't full.

A leaf's budget is some whole epochs of its documents and a prefix of one more. Each epoch has an
order of its own, by md5 of seed, epoch and key, then a hash of the text; the prefix ends inside the document whose tokens cross
the budget, of which the first tokens are taken. A token is a word, [^\\x20\\x09-\\x0D]+.

Everything is DataFrame operations. The end of a prefix is found by sums over 4096 ranges of the hash,
then inside one range of each leaf, so a source with a third of all rows is in no one task. What is
applied to the documents is one row for each leaf; it is broadcast if there are at most MAX_LEAVES.

Null language, source or text count as empty, a null key as a key of its own. Equal rows at which a prefix
ends are cut alike: each takes an equal part of what it leaves them, up to one token a row less than the budget. Leaves of weight 0 and
empty tables give no rows. Columns of the documents are kept by mix_documents(), others replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brevia.llm.shared import cut, tables

WORD = r"[^\x20\x09-\x0D]+"
LEAF = ("domain", "lang", "source")
MAX_LEAVES = 100_000


def _cases(column: str, values: dict, default) -> str:
    def sql(x) -> str:
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    return f"CASE {column} {' '.join(f'WHEN {sql(k)} THEN {sql(v)}' for k, v in values.items())} ELSE {sql(default)} END"


@dataclass(frozen=True)
class Mix:
    """Weights are whole numbers, 0 or more; those of unlisted names are `other`."""

    share: float = 0.8  # of all tokens there are
    max_epochs: int = 3
    seed: int = 42
    domains: dict = field(default_factory=lambda: {f"src{k}": "web" if k < 10 else "books" if k < 15 else "reference" for k in range(20)})
    domain_weights: dict = field(default_factory=lambda: {"web": 45, "books": 30, "reference": 20})
    lang_weights: dict = field(default_factory=lambda: {"en": 50, "de": 20, "fr": 15, "es": 15})
    source_weights: dict = field(default_factory=lambda: {"src0": 2, "src12": 3, "src19": 4})
    other: dict = field(default_factory=lambda: {"domain": 5, "lang": 5, "source": 1})

    def domain_sql(self) -> str:
        return _cases("source", self.domains, "other")

    def weight_sql(self, level: str) -> str:
        return _cases(level, getattr(self, f"{level}_weights"), self.other[level])


def _leaf_columns(mix: Mix) -> dict[str, Column]:
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    domain = F.lit("other")
    for name, value in mix.domains.items():
        domain = F.when(source == name, value).otherwise(domain)
    return {"domain": domain, "lang": F.coalesce(F.col("lang").cast("string"), F.lit("")), "source": source}


def measure(docs: DataFrame, mix: Mix, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, domain, lang, source, n_tokens, said: a hash of the text) of every row."""
    words = F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(key).alias("key"), *(c.alias(n) for n, c in _leaf_columns(mix).items()), words.alias("n_tokens"), _said(text))


def _said(text: str) -> Column:
    return F.xxhash64(F.col(text).cast("string")).alias("said")


def _hand_down(children: DataFrame, parents: list[str], name: str) -> DataFrame:
    """children: (parents..., name, weight, capacity, budget: the parent's) -> with share, the child's budget.
    The budget is at most the sum of the capacities, and capacities are 0 where weights are."""
    family = Window.partitionBy(*parents)
    ordered = family.orderBy("ratio", name)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    big = "decimal(19,0)"
    ranked = (
        children.withColumn("ratio", F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(0.0))
        .withColumn("full_before", F.coalesce(F.sum("capacity").over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(family) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("full", F.col("capacity").cast(big) * F.col("weight_left").cast(big) <= F.col("weight").cast(big) * (F.col("budget") - F.col("full_before")).cast(big))
    )
    rest = F.when(~F.col("full"), F.col("weight")).otherwise(0)
    shared = (
        ranked.withColumn("left_over", F.col("budget") - F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(family))
        .withColumn("weights", F.sum(rest).over(family))
        .withColumn("part", F.when(F.col("full"), F.col("capacity")).otherwise(F.expr(f"cast(left_over as {big}) * cast(weight as {big}) div cast(weights as {big})")))
        .withColumn("spare", F.col("budget") - F.sum("part").over(family))
        .withColumn("place", F.when(~F.col("full"), F.sum(F.when(~F.col("full"), 1).otherwise(0)).over(ordered)))
    )
    share = F.col("part") + F.when(F.col("place") <= F.col("spare"), 1).otherwise(0)
    return shared.select(*parents, name, F.col("capacity"), share.alias("share"))


def budgets(supply: DataFrame, mix: Mix) -> DataFrame:
    """(domain, lang, source, tokens) of all leaves -> with budget."""
    leaves = supply.withColumn("weight", F.expr(mix.weight_sql("source")).cast("long"))
    usable = (F.col("weight") > 0) & (F.expr(mix.weight_sql("lang")) > 0) & (F.expr(mix.weight_sql("domain")) > 0)
    leaves = leaves.withColumn("capacity", F.when(usable, F.col("tokens") * mix.max_epochs).otherwise(0))
    langs = leaves.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity")).withColumn("weight", F.expr(mix.weight_sql("lang")).cast("long"))
    domains = langs.groupBy("domain").agg(F.sum("capacity").alias("capacity")).withColumn("weight", F.expr(mix.weight_sql("domain")).cast("long"))
    total = leaves.agg(F.least(F.floor(F.sum("tokens") * F.lit(mix.share)), F.sum("capacity")).cast("long")).first()[0]
    domains = _hand_down(domains.withColumn("budget", F.lit(total).cast("long")), [], "domain")
    langs = _hand_down(langs.join(domains.select("domain", F.col("share").alias("budget")), "domain"), ["domain"], "lang")
    leaves = leaves.join(langs.select("domain", "lang", F.col("share").alias("budget")), ["domain", "lang"])
    return _hand_down(leaves, ["domain", "lang"], "source").join(supply, list(LEAF)).select(*LEAF, "tokens", F.col("share").alias("budget"))


def _order(mix: Mix, epoch: Column) -> Column:
    by_key = F.md5(F.concat_ws(":", F.lit(str(mix.seed)), epoch.cast("string"), F.col("key").cast("string")).cast("binary"))
    return F.concat(by_key, F.lpad(F.hex("said"), 16, "0"))


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= MAX_LEAVES else df


def plan(measured: DataFrame, mix: Mix) -> tuple[DataFrame, int]:
    """For each leaf with a budget its whole epochs and where the prefix of the next one ends:
    (leaf, epochs, cut_key, cut_tokens, cut_rows), and the number of leaves."""
    supply = cut(measured.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens")))
    leaves = cut(budgets(supply, mix).filter("budget > 0").select(*LEAF, F.expr("budget div tokens").alias("epochs"), F.expr("budget % tokens").alias("rest")))
    n = leaves.count()
    keyed = measured.join(_small(leaves.filter("rest > 0"), n), list(LEAF)).withColumn("at", _order(mix, F.col("epochs"))).withColumn("range", F.substring("at", 1, 3))
    sums = keyed.groupBy(*LEAF, "range", "rest").agg(F.sum("n_tokens").alias("tokens"))
    up_to = Window.partitionBy(*LEAF).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    crossed = sums.withColumn("before", F.coalesce(F.sum("tokens").over(up_to), F.lit(0))).filter("before < rest and rest <= before + tokens").select(*LEAF, "range", "before")
    inside = keyed.join(_small(crossed, n), [*LEAF, "range"]).groupBy(*LEAF, "range", "at", "rest", "before").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("cut_rows"))
    up_to = Window.partitionBy(*LEAF, "range").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    here = F.col("before") + F.coalesce(F.sum("tokens").over(up_to), F.lit(0))
    ends = inside.withColumn("here", here).filter("here < rest and rest <= here + tokens").select(*LEAF, F.col("at").alias("cut_key"), (F.col("rest") - F.col("here")).alias("cut_tokens"), "cut_rows")
    return cut(leaves.drop("rest").join(ends, list(LEAF), "left")), n


def _draw(measured: DataFrame, planned: DataFrame, n: int, mix: Mix) -> DataFrame:
    """Rows of measured, once for each epoch that takes them, with epoch and take_tokens."""
    joined = measured.join(_small(planned, n), list(LEAF)).withColumn("at", _order(mix, F.col("epochs")))
    last = F.when(F.col("at") < F.col("cut_key"), F.col("n_tokens")).when(F.col("at") == F.col("cut_key"), F.least("n_tokens", F.expr("cut_tokens div cut_rows")))
    whole = F.transform(F.array_repeat(F.col("n_tokens"), F.col("epochs").cast("int")), lambda t, k: F.struct(k.alias("epoch"), t.alias("take_tokens")))
    part = F.array(F.struct(F.col("epochs").cast("int").alias("epoch"), last.alias("take_tokens")))
    return joined.withColumn("taken", F.explode(F.filter(F.concat(whole, part), lambda x: x["take_tokens"].isNotNull()))).select("*", "taken.epoch", "taken.take_tokens").drop("taken", "at", "said", "epochs", "cut_key", "cut_tokens", "cut_rows")


def select(docs: DataFrame, mix: Mix, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, domain, lang, source, n_tokens, epoch, take_tokens): a row for each epoch that takes a document."""
    measured = cut(measure(docs, mix, key, text))
    return _draw(measured, *plan(measured, mix), mix).withColumnRenamed("key", key)


def mix_documents(docs: DataFrame, mix: Mix, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are taken, all columns of docs, once for each epoch; the one at which a leaf's
    prefix ends has only its first take_tokens words. Texts aren't shuffled."""
    held = "__brevia_row"
    there = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(held), F.col(key), F.col("lang"), F.col("source"), F.col(text))
    measured = measure(there.drop(held), mix, key, text)
    planned, n = plan(cut(measured), mix)
    words = F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = there.select(held, F.col(key).alias("key"), *(c.alias(m) for m, c in _leaf_columns(mix).items()), words.alias("n_tokens"), _said(text))
    drawn = _draw(rows, planned, n, mix)
    whole = F.col(f"{held}.`{text}`")
    some = F.array_join(F.slice(F.regexp_extract_all(whole, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), F.col("take_tokens").cast("int")), "")
    cut_text = F.when(F.col("take_tokens") < F.col("n_tokens"), some).otherwise(whole)
    return drawn.select(*((cut_text if c == text else F.col(f"{held}.`{c}`")).alias(c) for c in docs.columns))


def op1_source_mixing(spark, sf_dir: str) -> DataFrame:
    return select(tables(spark, sf_dir, "documents"), Mix())


def _hand_down_sql(children: str, parents: str, name: str) -> str:
    """The same level in SQL: children has parents, name, weight, capacity, budget."""
    family = f"PARTITION BY {parents}" if parents else ""
    columns = f"{parents}, {name}" if parents else name
    before = f"{family} ORDER BY ratio, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""(SELECT {columns}, part + CASE WHEN NOT is_full AND place <= spare THEN 1 ELSE 0 END AS share FROM (
        SELECT *, budget - sum(part) OVER ({family}) AS spare,
            sum(CASE WHEN is_full THEN 0 ELSE 1 END) OVER ({family} ORDER BY ratio, {name}) AS place FROM (
        SELECT *, CASE WHEN is_full THEN capacity ELSE (left_over * weight) // weights END AS part FROM (
        SELECT *, budget - sum(CASE WHEN is_full THEN capacity ELSE 0 END) OVER ({family}) AS left_over,
            sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({family}) AS weights FROM (
        SELECT *, capacity * weight_left <= weight * (budget - full_before) AS is_full FROM (
        SELECT *, coalesce(sum(capacity) OVER ({before}), 0)::HUGEINT AS full_before,
            sum(weight) OVER ({family}) - coalesce(sum(weight) OVER ({before}), 0) AS weight_left FROM (
        SELECT {columns}, capacity::HUGEINT AS capacity, weight::HUGEINT AS weight, budget::HUGEINT AS budget,
            CASE WHEN weight > 0 THEN capacity::DOUBLE / weight::DOUBLE ELSE 0 END AS ratio FROM {children})))))))"""


def oracle(mix: Mix | None = None) -> str:
    mix = mix or Mix()
    word = WORD.replace("'", "''")
    return f"""WITH measured AS (
        SELECT doc_id, {mix.domain_sql()} AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            coalesce(len(regexp_extract_all(text, '{word}')), 0)::BIGINT AS n_tokens FROM documents),
    supply AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM measured GROUP BY ALL),
    leaves AS (SELECT *, {mix.weight_sql("source")} AS weight, tokens * {mix.max_epochs} AS capacity FROM supply),
    langs AS (SELECT domain, lang, sum(capacity) AS capacity, any_value({mix.weight_sql("lang")}) AS weight FROM leaves GROUP BY domain, lang),
    domains AS (SELECT domain, sum(capacity) AS capacity, any_value({mix.weight_sql("domain")}) AS weight FROM langs GROUP BY domain),
    total AS (SELECT least(floor(sum(tokens) * {mix.share}::DOUBLE)::BIGINT, sum(capacity)) AS budget FROM leaves),
    d AS (SELECT * FROM {_hand_down_sql("(SELECT * FROM domains, total)", "", "domain")}),
    l AS (SELECT * FROM {_hand_down_sql("(SELECT langs.*, d.share AS budget FROM langs JOIN d USING (domain))", "domain", "lang")}),
    s AS (SELECT * FROM {_hand_down_sql("(SELECT leaves.*, l.share AS budget FROM leaves JOIN l USING (domain, lang))", "domain, lang", "source")}),
    planned AS (SELECT domain, lang, source, (share // tokens)::BIGINT AS epochs, (share % tokens)::BIGINT AS rest FROM s JOIN supply USING (domain, lang, source) WHERE share > 0),
    joined AS (SELECT *, md5(concat_ws(':', '{mix.seed}', epochs::VARCHAR, doc_id::VARCHAR)) AS place FROM measured JOIN planned USING (domain, lang, source)),
    placed AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS here FROM joined)
    SELECT doc_id, domain, lang, source, n_tokens, unnest(range(epochs))::INTEGER AS epoch, n_tokens AS take_tokens FROM placed
    UNION ALL
    SELECT doc_id, domain, lang, source, n_tokens, epochs::INTEGER, least(n_tokens, rest - here) FROM placed WHERE here < rest"""
