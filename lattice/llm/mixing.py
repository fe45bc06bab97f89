"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed into cells of (source, language, topic). Raking scales the cells' weights to the target shares of each
margin in turn, until all margins hold. A document is kept with the probability weight / tokens of its cell, decided by
a hash of its id; the kept total is the largest one up to the aim for which no cell has to give more tokens than it has, so
the margins hold whatever the aim. Only built-in DataFrame functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattice.plans.materialize import bounded_broadcast, discard, materialize

MARGINS = ("source", "lang", "topic")
#: Most of all tokens to keep; exponents that temper the margins' shares; most that tempering may raise a share by.
KEEP, TEMPER, LIFT = 0.6, {"source": 0.5, "lang": 0.7, "topic": 0.7}, 1.25
#: Rounds of raking after which the plan is cut and the margins are compared, most rounds, largest residual of a raked margin.
CUT, ROUNDS, TOLERANCE = 8, 48, 1e-12
#: Most cells that are raked in one task; more are raked by aggregations and joins.
CELLS = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def tokens(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def form(text: Column) -> Column:
    """The kind of a text by its form: table, markup, loud or prose; stands in for a topic where a table has none."""
    return F.when(text.contains(" | "), "table").when(text.contains("!! "), "loud").when(text.rlike(r"[#$%&*]{3}"), "markup").otherwise("prose")


def with_cell(docs: DataFrame, text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None) -> list[Column]:
    """The cell columns of a document; nulls are the empty name. Without ``topic_col`` the topic is the form of the text."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return [name(source_col).alias("source"), name(lang_col).alias("lang"), (name(topic_col) if topic_col else form(name(text_col))).alias("topic")]


def shares(cells: DataFrame, margin: str, exponent: float, lift: float = LIFT) -> DataFrame:
    """(margin, target): shares of tokens ** exponent, but no name above ``lift`` times its own share; what that leaves over goes to
    names below this bound in proportion to their distance from it. So a tiny name can't hold back the total."""
    own = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("held")).filter("held > 0")
    total, powers = (x or 1.0 for x in own.agg(F.sum("held"), F.sum(F.pow("held", F.lit(exponent)))).first())
    most = F.col("held") * (lift / total)
    capped = own.select(margin, most.alias("most"), F.least(F.pow("held", F.lit(exponent)) / powers, most).alias("share"))
    left, room = (x or 0.0 for x in capped.agg(1.0 - F.sum("share"), F.sum(F.col("most") - F.col("share"))).first())
    return capped.select(margin, (F.col("share") + (F.col("most") - F.col("share")) * (left / room if room else 0.0)).alias("target"))


def rake(cells: DataFrame, keep: float = KEEP, temper: dict[str, float] | None = None, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, most: int = CELLS, lift: float = LIFT) -> DataFrame:
    """(source, lang, topic, tokens, weight, total, residual_<margin>) from cells with tokens; cells without tokens have weight 0.

    ``targets`` gives for a margin a table (margin, share); names without tokens or share get 0, the shares of the others are scaled to 1.
    Other margins aim at :func:`shares`. total is the sum of the weights, at most ``keep`` of all tokens, and as large as the cells
    allow. residual_<margin> is the largest distance of a name's part of the total from its target; it is above
    ``TOLERANCE`` only where the targets of different margins contradict each other.
    """
    temper, targets = temper or TEMPER, targets or {}
    few = cells.limit(most + 1).count() <= most
    one = (lambda df: df.coalesce(1)) if few else (lambda df: df)  # every window below then runs in one small task without a shuffle
    now = one(cells)
    for m in MARGINS:
        if m in targets:
            there = cells.filter("tokens > 0").select(m).distinct()
            share = targets[m].groupBy(m).agg(F.sum("share").cast("double").alias("share")).join(there, m, "left_semi")
            share = share.select(m, (F.col("share") / (share.agg(F.sum("share")).first()[0] or 1.0)).alias("target"))
        else:
            share = shares(cells, m, temper[m], lift)
        now = now.join(bounded_broadcast(share.withColumnRenamed("target", f"t_{m}")), m, "left").withColumn(f"t_{m}", F.coalesce(f"t_{m}", F.lit(0.0)))
    everything = cells.agg(F.sum("tokens").cast("double")).first()[0] or 1.0
    now = materialize(now.withColumn("weight", F.col("tokens") / F.lit(everything)))

    def whole(df: DataFrame, m: str) -> DataFrame:
        if few:
            return df.withColumn("_whole", F.sum("weight").over(Window.partitionBy(m)))
        return df.join(bounded_broadcast(df.groupBy(m).agg(F.sum("weight").alias("_whole"))), m)

    for k in range(1, rounds + 1):
        for m in MARGINS:
            scaled = F.when(F.col("_whole") > 0, F.col("weight") * F.col(f"t_{m}") / F.col("_whole")).otherwise(0.0)
            now = whole(one(now), m).withColumn("weight", scaled).drop("_whole")
            if not few:
                now = materialize(now)
        if k % CUT == 0 or k == rounds:
            before, now = now, materialize(now)
            discard(before)
            if max(_residuals(now).values()) <= TOLERANCE:
                break
    left = _residuals(now)
    total = now.agg(F.least(F.lit(keep * everything), F.min(F.when(F.col("weight") > 0, F.col("tokens") / F.col("weight")))).alias("t")).first()["t"] or 0.0
    return now.select(*MARGINS, "tokens", (F.col("weight") * total).alias("weight"), F.lit(float(total)).alias("total"), *(F.lit(left[m]).alias(f"residual_{m}") for m in MARGINS))


def _residuals(now: DataFrame) -> dict[str, float]:
    """For each margin the largest distance of a name's weight from its target."""
    of = lambda m: now.groupBy(m).agg(F.abs(F.sum("weight") - F.max(f"t_{m}")).alias("d")).agg(F.max("d")).first()[0] or 0.0
    return {m: of(m) for m in MARGINS}


def unit(key: Column) -> Column:
    """A number from 0 to below 1 from a key (string)."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), key)), 1, 13), 16, 10).cast("double") / 2.0**52


def mix(docs: DataFrame, keep: float = KEEP, temper: dict[str, float] | None = None, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, probability, total, residual_<margin>): the kept documents.

    Nulls in source, language or topic are the empty name, a null text has no tokens; very long texts are counted whole. A document of a
    cell without tokens is never kept. Rows that repeat an id share its number; null ids share one. Other columns are ignored; an
    empty table gives no rows.
    """
    cell = with_cell(docs, text_col, source_col, lang_col, topic_col)
    slim = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), *cell, tokens(F.col(text_col)).alias("n_tokens")))
    chances = probabilities(slim, keep, temper, targets, rounds)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    kept = slim.join(bounded_broadcast(chances), list(MARGINS)).filter(unit(key) < F.col("probability"))
    rounded = [F.round(c, at).alias(c) for c, at in (("probability", 9), ("total", 3), *((f"residual_{m}", 7) for m in MARGINS))]
    return kept.select("doc_id", *MARGINS, "n_tokens", *rounded)


def probabilities(slim: DataFrame, keep: float = KEEP, temper: dict[str, float] | None = None, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(source, lang, topic, probability, total, residual_<margin>) from documents with these and n_tokens."""
    cells = materialize(slim.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")))
    raked = rake(cells, keep, temper, targets, rounds)
    chance = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    return materialize(raked.select(*MARGINS, chance.alias("probability"), "total", *(f"residual_{m}" for m in MARGINS)))


def sample(docs: DataFrame, keep: float = KEEP, temper: dict[str, float] | None = None, targets: dict[str, DataFrame] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None) -> DataFrame:
    """``docs`` sampled as :func:`mix` does, all columns kept; decided row by row, without a join on ids."""
    cell = with_cell(docs, text_col, source_col, lang_col, topic_col)
    chances = probabilities(docs.select(*cell, tokens(F.col(text_col)).alias("n_tokens")), keep, temper, targets)
    hidden = [f"_lattice_{m}" for m in MARGINS]
    named = chances.select(*(F.col(m).alias(h) for m, h in zip(MARGINS, hidden, strict=True)), F.col("probability").alias("_lattice_probability"))
    marked = docs.select("*", *(c.alias(h) for c, h in zip(cell, hidden, strict=True)))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    return marked.join(bounded_broadcast(named), hidden).filter(unit(key) < F.col("_lattice_probability")).select(*docs.columns)
