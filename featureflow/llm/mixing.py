"""Mixing sources to target weights with a low-discrepancy schedule.

* Targets: all sizes are shared by weight; a target stops at `most` times its
  source's size and the excess is reshared until none is above.
* Lines: each source's rows are put in a shuffled order (by hash) on a line of
  tokens that repeats up to `most` times; the line is cut into equal-token
  blocks. Positions come from (source, hash bucket) partial sums, summed in two
  levels, so no window holds a whole source or all its buckets.
* Schedule: slot n maps the golden-ratio point frac(n * phi) through the
  cumulative target shares to a source; the k-th slot of a source takes its
  k-th block. Slots past a target are dropped, missing ones close the
  schedule, so every source's words equal its target rounded down. The slots are
  the mix's order: every stretch of it holds the sources near their target shares.
  taken() names each row's first slot; each partition of documents() is a hashed
  share of the blocks in slot order (a global order would shuffle the texts again).

The list of sources (a weight each, set by a person) is read to the driver:
one small row per source, never rows of data.

Null texts have size 0 and are never taken; a null source is a source (last).
Equal rows get their own places. Reruns agree: order depends on hashes only.
The rows' own columns travel packed, so their names may be any.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featureflow.session import scratch_path

BLOCK = 256        # tokens of a block
ROWS_A_BUCKET = 1000
SLOT_CHUNK = 4096
PHI = 0.6180339887498949
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[int], most: int = 3) -> list[Fraction]:
    """Share sum(sizes) by weight; none above most * size; the excess is reshared by weight."""
    total, out = Fraction(sum(sizes)), [Fraction(0)] * len(sizes)
    caps = [Fraction(most * s) for s in sizes]
    free = set(range(len(sizes)))
    while free:
        left = total - sum(out[i] for i in range(len(sizes)) if i not in free)
        weight = sum(weights[i] for i in free)
        share = {i: left * weights[i] / weight for i in free}
        full = {i for i in free if share[i] > caps[i]}
        for i in full or free:
            out[i] = caps[i] if full else share[i]
        if not full:
            break
        free -= full
    return out


def sums_before(rows: DataFrame, group: str, at: str, value: str, span: int = SLOT_CHUNK) -> DataFrame:
    """rows with `__before`: the sum of value over the group's rows of smaller `at` (distinct in a group; null groups
    are one). Ranges of `span` are summed first, so a window holds the rows of one range, or one row a range."""
    ranged = rows.withColumn("__range", F.floor(F.col(at) / span))
    total = ranged.groupBy(F.col(group).alias("__g"), F.col("__range").alias("__r")).agg(F.sum(value).alias("__sum"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    total = total.select("__g", "__r", F.coalesce(F.sum("__sum").over(earlier(Window.partitionBy("__g").orderBy("__r"))),
                                                  F.lit(0)).alias("__low"))
    inside = F.coalesce(F.sum(value).over(earlier(Window.partitionBy(group, "__range").orderBy(at))), F.lit(0))
    ranged = ranged.withColumn("__inside", inside)
    out = ranged.join(total, ranged[group].eqNullSafe(total["__g"]) & (ranged["__range"] == total["__r"]))
    return out.select(*[ranged[c] for c in rows.columns], (F.col("__low") + F.col("__inside")).alias("__before"))


class Mix:
    """The plan of a mix: sources with their targets, rows on their lines, and the schedule."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
                 cycle: tuple[int, ...] = (1, 2, 3), most: int = 3, block: int = BLOCK, seed: int = 17):
        self.docs, self.block, self.most, self.id_col = docs, block, most, id_col
        self.spark = docs.sparkSession
        n = docs.count()
        self.buckets = max(1, n // ROWS_A_BUCKET)
        order = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"))
        self._keys = {"__size": n_words(F.col(text_col)), "__source": F.col(source_col).cast("string"), "__order": order,
                      "__bucket": F.pmod(order, F.lit(self.buckets)), "__id": F.col(id_col).cast("string")}
        sums = docs.select(*[e.alias(c) for c, e in self._keys.items()]).groupBy("__source", "__bucket").agg(
            F.sum("__size").alias("__sum"))
        path = scratch_path(self.spark, "mix")
        sums.write.parquet(f"{path}/sums")
        sums = self.spark.read.parquet(f"{path}/sums")
        # one row per source
        sources = sums.groupBy("__source").agg(F.sum("__sum").alias("size")).orderBy(F.asc_nulls_last("__source")).collect()
        self.sizes = [r["size"] for r in sources]
        self.weights = [cycle[i % len(cycle)] for i in range(len(sources))]
        self.targets = targets(self.sizes, self.weights, most)
        plan = [(r["__source"], i, s, float(t), int(t)) for i, (r, s, t) in enumerate(zip(sources, self.sizes, self.targets))]
        self.sources = self.spark.createDataFrame(
            plan, "__source string, source_no int, source_size long, target double, quota long")
        self.offsets = sums_before(sums, "__source", "__bucket", "__sum")

    def lines(self, *kept: str) -> DataFrame:
        """`row` (a struct of the kept columns) with size, source_no, source_size, target, quota and the start on the
        source's line."""
        rows = self.docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
                                *[e.alias(c) for c, e in self._keys.items()]).alias("r")
        o = self.offsets.alias("o")
        same = F.col("r.__source").eqNullSafe(F.col("o.__source")) & (F.col("r.__bucket") == F.col("o.__bucket"))
        rows = rows.join(o, same).select("r.*", "__before")
        running = F.sum("__size").over(Window.partitionBy("__source", "__bucket").orderBy("__order", "__id", "__size"
                                                                                          ).rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn("start", F.col("__before") + running - F.col("__size")).withColumnRenamed("__size", "size")
        s = F.broadcast(self.sources).alias("s")  # one row per source
        out = rows.alias("r").join(s, F.col("r.__source").eqNullSafe(F.col("s.__source")))
        return out.select("r.row", "size", "start", "source_no", "source_size", "target", "quota")

    def schedule(self) -> DataFrame:
        """(slot, source_no, block): which block of which source each slot of the mix takes."""
        total = sum(self.targets)
        need = [-(-int(t) // self.block) for t in self.targets]
        if not total:
            return self.spark.createDataFrame([], "slot long, source_no int, block long")
        n_slots = -(-int(total) // self.block)
        shares, edge = [], Fraction(0)
        for t in self.targets[:-1]:
            edge += t / total
            shares.append(float(edge))
        hi = F.pmod(F.shiftright("id", 20) * F.lit((PHI * 2 ** 20) % 1.0), F.lit(1.0))
        point = F.pmod(hi + F.pmod(F.col("id"), F.lit(1 << 20)) * F.lit(PHI), F.lit(1.0))
        edges = F.array(*[F.lit(x) for x in shares]) if shares else F.expr("cast(array() as array<double>)")
        slots = self.spark.range(n_slots).withColumn("point", point)
        slots = slots.select(F.col("id").alias("slot"), F.floor(F.col("id") / SLOT_CHUNK).alias("chunk"),
                             F.size(F.filter(edges, lambda e: e <= F.col("point"))).alias("source_no"))
        counts = slots.groupBy("chunk", "source_no").agg(F.count("*").alias("n"))
        rank = F.row_number().over(Window.partitionBy("chunk", "source_no").orderBy("slot")) - 1
        ranked = slots.withColumn("rank", rank).join(sums_before(counts, "source_no", "chunk", "n").drop("n"), ["chunk", "source_no"])
        wanted = F.broadcast(self.spark.createDataFrame(list(enumerate(need)), "source_no int, need long"))  # one row per source
        taken = ranked.withColumn("block", F.col("rank") + F.col("__before")).join(wanted, "source_no").filter(
            "block < need").select("slot", "source_no", "block")
        have = counts.groupBy("source_no").agg(F.sum("n").alias("have"))
        short = wanted.join(have, "source_no", "left").withColumn("have", F.coalesce("have", F.lit(0))).filter("have < need")
        closing = short.select("source_no", F.explode(F.sequence("have", F.col("need") - 1)).alias("block")).select(
            (F.lit(n_slots) + F.col("block")).alias("slot"), "source_no", "block")
        return taken.unionByName(closing)

    def pieces(self, lines: DataFrame) -> DataFrame:
        """(slot, start, source_no, epoch, word_from, word_to): the mix, block by block."""
        size, quota = F.col("size"), F.col("quota")
        rows = lines.filter(size > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(self.most - 1))))
        rows = rows.withColumn("a", F.col("start") + F.col("epoch") * F.col("source_size")).filter(F.col("a") < quota)
        rows = rows.withColumn("b", F.least(F.col("a") + size, quota))
        rows = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("a") / self.block), F.floor((F.col("b") - 1) / self.block))))
        low = F.greatest(F.col("a"), F.col("block") * self.block) - F.col("a")
        high = F.least(F.col("b"), (F.col("block") + 1) * self.block) - F.col("a")
        rows = rows.select("start", "source_no", "block", "epoch", low.alias("word_from"), high.alias("word_to"))
        return rows.join(self.schedule(), ["source_no", "block"])

    def taken(self) -> DataFrame:
        """Every row's (id_col, size, source_size, target, taken, slot): slot is the first one that takes some of its
        words (null: none does)."""
        path = scratch_path(self.spark, "mix-lines")
        self.lines(self.id_col).write.parquet(path)
        lines = self.spark.read.parquet(path)
        words = self.pieces(lines.drop("row")).groupBy("source_no", "start").agg(
            F.sum(F.col("word_to") - F.col("word_from")).alias("taken"), F.min("slot").alias("slot"))
        lines = lines.withColumn("start", F.when(F.col("size") > 0, F.col("start")))
        out = lines.join(words, ["source_no", "start"], "left")
        return out.select(F.col("row")[self.id_col].alias(self.id_col), "size", "source_size", "target",
                          F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "slot")

    def documents(self) -> DataFrame:
        """Whole rows of docs, once for every pass over the line that reaches their first word; in each partition in
        slot order."""
        lines = self.lines(*self.docs.columns).filter("size > 0").withColumn(
            "epoch", F.explode(F.sequence(F.lit(0), F.lit(self.most - 1))))
        first = F.col("start") + F.col("epoch") * F.col("source_size")
        lines = lines.filter(first < F.col("quota")).withColumn("first", first).withColumn("block", F.floor(first / self.block))
        placed = lines.join(self.schedule(), ["source_no", "block"]).select("row", "slot", "first")
        return placed.sortWithinPartitions("slot", "first").select("row.*")
