"""Mixing sources to target weights by Sainte-Laguë apportionment.

Sources in code point order (null last) take the weights in turn and share a budget of words; a
source's target stops at ``max_repeats`` times its size, and the excess goes to the others by
weight. Documents are dealt by a seeded hash into shards of about ``shard_docs``; the documents of
one source in one shard are a cell, laid out as one run of words in seeded order and cut into equal
blocks of about ``block_words``. Highest quotients v/(2k + 1) then give whole numbers of blocks,
first to the sources by their targets, then within a source to its cells by their blocks. A cell
takes every block as often as its quota covers all of them, and for the rest a run of neighbouring
blocks from a seeded start, so that documents are taken whole but for the two at the ends.

Highest quotients without a queue: with V votes, N seats and S parties every party gets between
round(v(N − S/2)/V) and round(v(N + S/2)/V) seats, so only the quotients in between, about 2S of
them, are ranked for the open seats. A window holds one cell, hence one shard at most; ranks and
sums over all sources or all cells of a source are running passes that cut them anywhere.

Null and empty texts have size 0 and are taken 0 times; a null source is a source; rows with the
same id and size may swap their places, which changes no result. An empty table gives no rows.
Same table, same parameters: same mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.running import Agg, running
from .common import step_table, words

WEIGHTS = (5, 2, 1)
BUDGET_PERCENT = 150
MAX_REPEATS = 2
BLOCK_WORDS = 16
SHARD_DOCS = 1024


def targets(sources: DataFrame, budget: str, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``sources`` (source, source_size, ...) with ``target``: the fill level λ with
    Σ min(cap, λ · weight) = ``budget`` (an expression over the sum ``total`` of all sizes).

    In the order of cap/weight, λ is the largest (budget − caps before) / weights from here on.
    """
    one = sources.selectExpr("*", "source IS NULL AS no_source", "'' AS everyone")
    total = one.groupBy("everyone").agg(F.sum("source_size").alias("total"))
    ranked = running(one, [], ["no_source", "source"], [Agg("place", "count", F.lit(1))]).join(F.broadcast(total), "everyone").selectExpr(
        "*", f"element_at(array({', '.join(map(str, weights))}), CAST(place % {len(weights)} + 1 AS int)) AS weight")
    level = running(ranked.selectExpr("*", f"CAST({max_repeats} * source_size AS double) / weight AS full_at"), [],
                    ["full_at", "no_source", "source"],
                    [Agg("caps_before", "sum", F.col("source_size") * max_repeats), Agg("weights_before", "sum", F.col("weight"))])
    top = level.groupBy("everyone").agg(F.sum("weight").alias("weights"))
    level = level.join(F.broadcast(top), "everyone").selectExpr(
        "*", f"({budget} - coalesce(caps_before, 0)) / (weights - coalesce(weights_before, 0)) AS level_here")
    fill = level.groupBy("everyone").agg(F.max("level_here").alias("fill"))
    return level.join(F.broadcast(fill), "everyone").selectExpr(
        *[f"`{c}`" for c in sources.columns],
        f"if(full_at <= fill, CAST({max_repeats} * source_size AS double), fill * weight) AS target")


def apportion(parties: DataFrame, group: list[str], party: str, votes: str, seats: str, out: str = "quota") -> DataFrame:
    """Sainte-Laguë: ``out`` = each party's share of its group's ``seats`` (a whole number, equal
    throughout the group) by ``votes``. Ties go to the smaller party. Parties without votes get 0."""
    share = parties.where(f"{votes} > 0").groupBy(*group).agg(
        F.sum(votes).alias("_all"), F.count(F.lit(1)).alias("_n"), F.max(seats).alias("_seats"))

    def on(left: str, right: str, names: list[str]):
        return F.expr(" AND ".join(f"{left}.`{c}` <=> {right}.`{c}`" for c in names))

    open_ = parties.alias("p").join(share.alias("s"), on("p", "s", group), "left").selectExpr(
        "p.*", "_seats", f"if({votes} > 0, greatest(0L, floor(p.{votes} * greatest(0, _seats - _n / 2.0D) / _all + 0.5D)), 0L) AS _least",
        f"if({votes} > 0, floor(p.{votes} * (_seats + _n / 2.0D) / _all + 0.5D) + 1, 0L) AS _most")
    sure = open_.groupBy(*group).agg(F.sum("_least").alias("_given"))
    quotients = (open_.where("_most > _least").selectExpr(*group, party, "_seats", f"{votes} AS _votes", "explode(sequence(_least, _most - 1)) AS _k")
                 .selectExpr(*group, party, "_seats", "- _votes / (2 * _k + 1) AS _falling"))
    ranked = running(quotients, group, ["_falling", party], [Agg("_before", "count", F.lit(1))])
    won = ranked.alias("p").join(sure.alias("g"), on("p", "g", group)).where("_given + _before < _seats").groupBy(
        *[F.col(f"p.`{g}`") for g in group], party).agg(F.count(F.lit(1)).alias("_won"))
    return open_.alias("p").join(won.alias("w"), on("p", "w", [*group, party]), "left").selectExpr(
        *[f"p.`{c}`" for c in parties.columns], f"_least + coalesce(_won, 0L) AS `{out}`")


def mix_sources(docs: DataFrame, weights=WEIGHTS, budget_percent: int = BUDGET_PERCENT, max_repeats: int = MAX_REPEATS,
                block_words: int = BLOCK_WORDS, shard_docs: int = SHARD_DOCS, seed: str = "mix") -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, shard, taken (words, repeats counted)
    and ``parts``, array<struct<from, to, times>>: word ranges of the text and how often each is taken."""
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = step_table(docs.select("doc_id", "source", F.size(words(F.coalesce("text", F.lit("")))).cast("long").alias("size"),
                                   key.alias("place")))
    shards = max(1, -(-sized.count() // shard_docs))
    sized = sized.selectExpr("*", f"CAST(conv(substr(place, 1, 8), 16, 10) AS bigint) % {shards} AS shard")

    cells = step_table(sized.groupBy("source", "shard").agg(F.sum("size").alias("words")).selectExpr(
        "*", f"if(words = 0, 0L, greatest(1L, (words + {block_words // 2}) div {block_words})) AS blocks"))
    sources = targets(cells.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("blocks").alias("source_blocks")),
                      f"total * {budget_percent / 100}D", weights, max_repeats)
    # a source that is taken as often as allowed needs no quotient; the others share what is left, in blocks
    sources = step_table(sources.selectExpr(
        "*", f"target >= CAST({max_repeats} * source_size AS double) AS filled",
        "if(source_size = 0, 0D, target * source_blocks / source_size) AS votes", "source IS NULL AS no_source", "coalesce(source, '') AS name"))
    rest = sources.where("NOT filled").groupBy("filled").agg(F.expr("CAST(round(sum(votes)) AS bigint) AS seats"))
    rest = sources.where("NOT filled").join(F.broadcast(rest), "filled").selectExpr("*", "struct(no_source, name) AS party")
    quotas = apportion(rest, ["filled"], "party", "votes", "seats").selectExpr(
        "source", f"least(quota, {max_repeats} * source_blocks) AS quota").unionByName(
        sources.where("filled").selectExpr("source", f"{max_repeats} * source_blocks AS quota"))

    of_cell = cells.alias("c").join(quotas.alias("q"), F.expr("c.source <=> q.source")).selectExpr("c.*", "quota AS source_quota")
    cell_quota = step_table(apportion(of_cell, ["source"], "shard", "blocks", "source_quota").selectExpr(
        "source", "shard", "words", "blocks", f"least(quota, {max_repeats} * blocks) AS quota",
        f"if(blocks = 0, 0L, CAST(conv(substr(md5(concat_ws(':', '{seed}', coalesce(source, ''), CAST(shard AS string))), 1, 8), 16, 10)"
        " AS bigint) % blocks) AS skip"))

    before = Window.partitionBy("source", "shard").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = sized.select("*", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    placed = laid.alias("d").join(cell_quota.alias("q"), F.expr("d.source <=> q.source AND d.shard = q.shard")).join(
        sources.alias("s"), F.expr("d.source <=> s.source")).selectExpr(
        "doc_id", "d.source", "size", "source_size", "target", "d.shard", "start", "if(blocks = 0, 0L, quota div blocks) AS whole",
        # the extra run of blocks [first, skip + quota mod blocks) may go on at the cell's beginning
        "if(blocks = 0, 0L, skip * words div blocks) AS a",
        "if(blocks = 0, 0L, least(skip + quota % blocks, blocks) * words div blocks) AS b",
        "if(blocks = 0, 0L, greatest(skip + quota % blocks - blocks, 0L) * words div blocks) AS c")
    # words of the document in the run [a, b) and in its continuation [0, c); c <= a, so they do not overlap
    inside = placed.selectExpr(
        "*", "least(greatest(c - start, 0L), size) AS p1", "least(greatest(a - start, 0L), size) AS p2", "least(greatest(b - start, 0L), size) AS p3")
    pieces = ("array(struct(0L AS `from`, p1 AS `to`, whole + 1 AS times), struct(p1 AS `from`, p2 AS `to`, whole AS times), "
              "struct(p2 AS `from`, p3 AS `to`, whole + 1 AS times), struct(p3 AS `from`, size AS `to`, whole AS times))")
    return inside.selectExpr(
        "doc_id", "source", "size", "source_size", "target", "shard",
        "whole * size + p1 + p3 - p2 AS taken",
        f"filter({pieces}, x -> x.`to` > x.`from` AND x.times > 0) AS parts")
