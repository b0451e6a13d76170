"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Rows of a source are dealt by hash into blocks. What a source gives is some whole passes over its blocks
and a last, partial one, which ends in the block where the target is reached, cut to words. So each pass
over a source has an exact quota of block draws.

A tree splits these quotas among the output shards. At a node the draws of all passes stand in a row, a
random permutation says which go to which child, and what is counted there by pass is a multivariate
hypergeometric draw of the child's quotas. A leaf is a shard: it draws its quota of each pass from that
pass's permuted blocks, beginning where the leaves before it end, so draws are disjoint. What no leaf
draws is not taken. ``shuffled`` orders rows within a shard.

All is built-in SQL functions on tables; permutations are arithmetic (Feistel rounds on the numbers
below n), so nothing is sorted to draw. One task orders the sources, a row for each. Rows that are equal
in id, source and text are numbered, so each is a row of its own in its own block; rows of a third of all
rows are numbered by input task first.

Defined results: a null or empty text has size 0 and gives no words; null sources are one source,
ordered last; null ids are as good as others; of equal rows some may be taken and others not; an empty
table gives an empty result; other columns are carried by ``mixed_rows`` and not read elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tagloom.llm.common import numbered_out, prefix_sums, written

WORD, SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]"
#: Expected rows of a block, words of a shard, children of a node, most shards that a task shuffles.
BLOCK_ROWS, SHARD_WORDS, FAN, TASK_SHARDS = 1024, 1 << 23, 16, 16
#: Feistel rounds; most walks until a number falls below n, each failing with a chance of 1/4 at most.
ROUNDS, WALKS = 4, 48
#: The pass that is cut.
PARTIAL = 0


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Never null, and distinct for null and every name."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """The place of ``x`` (a long from 0 to n - 1) in a permutation of these numbers drawn by ``key``."""
    high = F.ceil(F.sqrt(n.cast("double")))
    low = F.ceil(n / high)

    def walk(y: Column) -> Column:
        first = F.struct(F.floor(y / low).alias("i"), F.pmod(y, low).alias("j"))

        def turn(a: Column, k: Column) -> Column:
            i = F.pmod(a["i"] + F.pmod(F.xxhash64(*key, k, a["j"]), high), high)
            return F.struct(i.alias("i"), F.pmod(a["j"] + F.pmod(F.xxhash64(*key, k, i), low), low).alias("j"))

        return F.aggregate(F.array(*(F.lit(k) for k in range(ROUNDS))), first, turn, lambda a: a["i"] * low + a["j"])

    # negative: not yet walked
    step = lambda y, _: F.when((y >= 0) & (y < n), y).otherwise(walk(F.when(y < 0, -y - 1).otherwise(y)))
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), -x - 1, step)


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``sizes`` (a row for each source: ``_s``, ``n`` words) with ``target``, the words to take. Sources by code
    point, null last, have the repeating ``weights`` and share ``share`` times all words; none exceeds ``cap``
    times its size, and what is above is shared by weight among those that are not capped.

    In order of size per weight the capped ones come first: of each source is known what is left to share,
    and to whom, if all before it are capped; the first that its part does not exceed sets the level of all after."""
    at = F.pmod(F.row_number().over(W.orderBy(F.col("_s") == "n", "_s")) - 1, F.lit(len(weights))) + 1
    out = sizes.withColumn("_w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), at.cast("int"))).withColumn("_cap", F.lit(float(cap)) * F.col("n"))
    by = W.orderBy(F.col("_cap") / F.col("_w"), "_s")
    capped = F.coalesce(F.sum("_cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    whole = W.partitionBy()
    level = (F.lit(float(share)) * F.sum("n").over(whole) - capped) / F.sum("_w").over(by.rowsBetween(0, W.unboundedFollowing))
    out = out.withColumn("_level", level).withColumn("_at", F.row_number().over(by))
    first = F.min(F.when(F.col("_cap") / F.col("_w") >= F.col("_level"), F.struct("_at", "_level"))).over(whole)["_level"]
    return out.withColumn("target", F.least(F.col("_cap"), F.coalesce(first * F.col("_w"), F.col("_cap")))).drop("_w", "_cap", "_level", "_at")


def quota_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """Splits ``quotas`` (``_s``, ``_pass``, ``quota``) among shards: a row for each ``leaf`` and pass with draws in it.

    A node holds the shards from ``low`` to ``high`` and is split into at most ``FAN`` children, each of
    which gets draws in proportion to its shards, to within one draw a shard."""
    nodes, width = quotas.select(F.lit(0).cast("long").alias("low"), F.lit(shards).cast("long").alias("high"), "_s", "_pass", F.col("quota").cast("long").alias("quota")).where("quota > 0"), shards
    while width > 1:
        step = -(-width // FAN)  # shards of a child
        by = W.partitionBy("low").orderBy("_s", "_pass")
        row = nodes.withColumn("total", F.sum("quota").over(W.partitionBy("low"))).withColumn("end", F.sum("quota").over(by))
        slots = numbered_out(row, "quota", "slot").withColumn("slot", F.col("slot") + F.col("end") - F.col("quota"))
        leaf = F.floor(permuted(F.col("slot"), F.col("total"), F.lit(seed), F.col("low"), F.lit(width)) * (F.col("high") - F.col("low")) / F.col("total"))
        first = F.col("low") + F.floor(F.col("leaf") / step) * step
        nodes = slots.select("low", "high", "_s", "_pass", leaf.alias("leaf")).select(first.alias("low"), "high", "_s", "_pass")
        nodes = nodes.withColumn("high", F.least(F.col("low") + step, F.col("high")))
        nodes = written(nodes.groupBy("low", "high", "_s", "_pass").agg(F.count("*").alias("quota")))
        width = step
    return nodes.select(F.col("low").alias("leaf"), "_s", "_pass", "quota")


def told_apart(rows: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """``rows`` (with ``_h``) with ``_g``, a hash that equal rows do not share. ``repeated``: hashes of several rows."""
    if repeated is None:
        return rows.withColumn("_g", F.xxhash64("_h", F.lit(0).cast("long")))
    with_task = rows.withColumn("_task", F.spark_partition_id())
    marked = with_task.join(repeated.select("_h", F.lit(True).alias("_many")), "_h", "left")
    one = marked.where("_many is null").withColumn("_copy", F.lit(0).cast("long"))
    many = written(marked.where("_many"))
    before = many.groupBy("_h", "_task").agg(F.count("*").alias("_k"))
    before = before.withColumn("_before", F.sum("_k").over(W.partitionBy("_h").orderBy("_task")) - F.col("_k")).drop("_k")  # a row for each input task
    own = F.row_number().over(W.partitionBy("_h", "_task").orderBy("_h"))
    many = many.withColumn("_own", own).join(before, ["_h", "_task"]).withColumn("_copy", F.col("_before") + F.col("_own") - 1).drop("_own", "_before")
    return one.unionByName(many).withColumn("_g", F.xxhash64("_h", "_copy")).drop("_task", "_many", "_copy")


class Mix:
    """The plan of one mix: ``sizes`` (a table of every row's key, size and hash) and ``blocks`` (what each gives)."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], share: float, cap: float, seed: int):
        self.seed, self.id_col, self.text_col, self.source_col = seed, id_col, text_col, source_col
        thin = written(docs.select(F.col(id_col).alias("_id"), *self.keys(docs)))
        repeated = written(thin.groupBy("_h").agg(F.count("*").alias("k")).where("k > 1").select("_h"))
        self.repeated = None if repeated.isEmpty() else repeated
        self.sizes = told_apart(thin, None) if self.repeated is None else written(told_apart(thin, self.repeated))
        sources = targets(self.sizes.groupBy("_s").agg(F.sum("_size").alias("n"), F.count("*").alias("_rows")), weights, share, cap)
        want = F.round("target").cast("long")
        full = F.when(F.col("n") > 0, F.floor(want / F.col("n"))).otherwise(F.lit(0)).cast("long")
        sources = sources.select("_s", F.col("n").alias("source_size"), "target", full.alias("_full"), (want - full * F.col("n")).alias("_rest"), F.ceil(F.col("_rows") / BLOCK_ROWS).cast("long").alias("_nb"))
        self.sources = written(sources)
        words = written(self.placed(self.sizes).groupBy("_s", "_block").agg(F.sum("_size").alias("_words")))
        partial = self.partial(words)
        self.blocks = self.drawn(words, partial)

    def keys(self, docs: DataFrame) -> list[Column]:
        """``_s``, ``_size`` and ``_h``: source, words, and a hash of id, source and text."""
        id_, source, text = F.col(self.id_col), source_key(F.col(self.source_col)), F.coalesce(F.col(self.text_col), F.lit(""))
        return [source.alias("_s"), word_count(F.col(self.text_col)).alias("_size"), F.xxhash64(F.lit(self.seed), id_, id_.isNull(), source, text).alias("_h")]

    def placed(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with _s and _g) with what their source has and the block they are in."""
        return rows.join(self.sources, "_s").withColumn("_block", F.pmod(F.shiftrightunsigned("_g", 13), F.col("_nb")))

    def block_at(self, rank: Column, which: Column) -> Column:
        return permuted(rank, F.col("_nb"), F.lit(self.seed + 1), F.col("_s"), which)

    def partial(self, words: DataFrame) -> DataFrame:
        """Draws of the partial passes by ``_rank``: ``_block``, and ``_extra``, the words it gives."""
        some = numbered_out(self.sources.where("_rest > 0"), "_nb", "_rank")
        order = some.withColumn("_block", self.block_at(F.col("_rank"), F.lit(PARTIAL))).join(words, ["_s", "_block"])
        order = prefix_sums(written(order.select("_s", "_rest", "_rank", "_block", "_words")), "_rank", "_words", "_before", ("_s",))
        return written(order.where("_before < _rest").select("_s", "_rank", "_block", F.least(F.col("_words"), F.col("_rest") - F.col("_before")).alias("_extra")))

    def drawn(self, words: DataFrame, partial: DataFrame) -> DataFrame:
        """What the leaves draw of each block: ``_whole``, the shard of each whole pass, and for the partial pass
        ``_last``, its shard, ``_extra``, its words, and, where it is cut, ``_inside``, the block's sizes by hash."""
        passes = self.sources.where("_full > 0").select("_s", F.explode(F.sequence(F.lit(1), F.col("_full").cast("int"))).alias("_pass"), F.col("_nb").alias("quota"))
        last = partial.groupBy("_s").agg((F.max("_rank") + 1).alias("quota")).select("_s", F.lit(PARTIAL).alias("_pass"), "quota")
        total = self.sources.agg(F.sum(F.col("source_size") * F.col("_full") + F.col("_rest"))).first()[0] or 0
        self.shards = max(1, -(-total // SHARD_WORDS))
        leaves = written(quota_tree(written(passes.unionByName(last)), self.shards, self.seed))
        starts = prefix_sums(leaves, "leaf", "quota", "_start", ("_s", "_pass"))
        draws = numbered_out(starts.join(self.sources.select("_s", "_nb"), "_s"), "quota", "_rank").withColumn("_rank", F.col("_rank") + F.col("_start"))
        draws = draws.withColumn("_block", self.block_at(F.col("_rank"), F.col("_pass")))
        by_block = draws.groupBy("_s", "_block").agg(
            F.transform(F.array_sort(F.collect_list(F.when(F.col("_pass") != PARTIAL, F.struct("_pass", "leaf")))), lambda x: x["leaf"]).alias("_whole"),
            F.max(F.when(F.col("_pass") == PARTIAL, F.struct("_rank", "leaf"))).alias("_part"),
        )  # at most one draw for each pass
        by_block = by_block.select("_s", "_block", "_whole", F.col("_part._rank").alias("_rank"), F.col("_part.leaf").alias("_last"))
        got = by_block.join(partial.drop("_block"), ["_s", "_rank"], "left").join(words, ["_s", "_block"])
        got = written(got.select("_s", "_block", "_words", "_whole", "_last", F.coalesce("_extra", F.lit(0)).alias("_extra")))
        # rows of the blocks at the limit, one for each source
        cut = got.where("_extra > 0 and _extra < _words").select("_s", "_block")
        inside = self.placed(self.sizes).join(cut, ["_s", "_block"]).groupBy("_s", "_block").agg(F.array_sort(F.collect_list(F.struct("_g", "_size"))).alias("_inside"))
        return written(got.join(inside, ["_s", "_block"], "left"))

    def taken(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with _s, _g, _size) with ``taken``, ``_part`` (words of the partial pass), ``_whole`` and ``_last``."""
        before = F.aggregate(F.filter("_inside", lambda x: x["_g"] < F.col("_g")), F.lit(0).cast("long"), lambda a, x: a + x["_size"])
        part = F.when(F.col("_extra") <= 0, F.lit(0)).when(F.col("_extra") >= F.col("_words"), F.col("_size")).otherwise(F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_extra") - before)))
        out = self.placed(rows).join(self.blocks, ["_s", "_block"], "left").withColumn("_extra", F.coalesce("_extra", F.lit(0))).withColumn("_part", part.cast("long"))
        return out.withColumn("_whole", F.coalesce("_whole", F.array().cast("array<bigint>"))).withColumn("taken", F.size("_whole") * F.col("_size") + F.col("_part"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 20) -> DataFrame:
    """One row per document: id, ``size``, ``source_size``, ``target``, ``taken``, and ``shards``, the
    output shard of each pass over it (the partial one last)."""
    plan = Mix(docs, id_col, text_col, source_col, weights, share, cap, seed)
    out = plan.taken(plan.sizes)
    shards = F.concat("_whole", F.when(F.col("_part") > 0, F.array("_last")).otherwise(F.array().cast("array<bigint>")))
    return out.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target", "taken", shards.alias("shards"))


def first_words(text: Column, n: Column) -> Column:
    """``text`` up to the end of its ``n``-th word."""
    return F.call_function("regexp_extract", text, F.concat(F.lit(f"^(?:{SPACE}*+{WORD}+){{"), n.cast("string"), F.lit("}+")), F.lit(0))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 20, shard_col: str | None = None) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row for each pass over a document; the row of a
    partial pass has the text up to its last word taken. With ``shard_col`` rows are dealt to the
    output shards and shuffled within, and that column tells the shard."""
    plan = Mix(docs, id_col, text_col, source_col, weights, share, cap, seed)
    rows = told_apart(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *plan.keys(docs)), plan.repeated)
    text = F.col("_row")[text_col]
    whole = F.transform("_whole", lambda leaf: F.struct(F.col("_size").alias("n"), leaf.alias("shard")))
    last = F.filter(F.array(F.struct(F.col("_part").alias("n"), F.col("_last").alias("shard"))), lambda p: p["n"] > 0)
    out = plan.taken(rows).where("_size > 0").select("_row", "_size", F.explode(F.concat(whole, last)).alias("_p"))
    new = {c: F.col("_row").getField(c) for c in docs.columns} | {text_col: F.when(F.col("_p.n") == F.col("_size"), text).otherwise(first_words(text, F.col("_p.n")))}
    columns = [new[c].alias(c) for c in docs.columns]
    if shard_col:
        columns.append(F.col("_p.shard").alias(shard_col))
    return shuffled(out.select(*columns), shard_col, plan.shards, seed) if shard_col else out.select(*columns)


def shuffled(mixed: DataFrame, shard_col: str, shards: int, seed: int = 20) -> DataFrame:
    """Rows by shard, each in a task's hands, in an order of hashes within. A task has one shard, or, if there are more
    than the session has shuffle partitions, up to ``TASK_SHARDS`` neighbouring ones."""
    tasks = min(shards, max(int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-shards // TASK_SHARDS)))
    order = F.xxhash64(F.lit(seed), *(F.col(f"`{c}`") for c in mixed.columns if c != shard_col))
    return mixed.repartitionById(tasks, F.floor(F.col(shard_col) * tasks / shards).cast("int")).sortWithinPartitions(shard_col, order)
