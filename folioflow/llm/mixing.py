"""Mixing sources to target weights by Pfair scheduling.

A source's rows are cut into blocks. Block j of a source with weight w has release time floor(j / w)
and deadline ceil((j + 1) / w); at each slot the released block with the earliest deadline is placed,
so after any number t of slots a source has had w t blocks, off by less than one. Weights are ratios of
whole numbers, taken exactly; the schedule repeats after their sum (.6, .3 and .1 do every 10 slots).
The mix states its weights in whole parts of at most PERIOD slots, whatever the size of the input, so the driver plans
one period, or until a source runs dry before; every block's slot then follows from its number. When a source runs dry, the rest share the slots by their own weights in turn: no row is
dropped, and there are at most as many such phases as sources.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import Scratch, numbered

#: Weights are whole parts of about so many slots at most, and a plan is broadcast up to so many numbers.
PERIOD, MOST_SENT = 1 << 16, 1 << 23


def parts(weights: dict[str, float]) -> dict[str, int]:
    """The least whole numbers in the very ratio of the weights (as decimals); their sum is the period.

    Sources of weight 0 have no part beside others: they wait until only such sources are left.
    """
    exact = {s: Fraction(repr(float(w))) for s, w in weights.items() if w > 0} or dict.fromkeys(weights, Fraction(1))
    unit = math.lcm(*(x.denominator for x in exact.values()))
    whole = {s: int(x * unit) for s, x in exact.items()}
    common = math.gcd(*whole.values())
    return {s: n // common for s, n in whole.items()}


def stated(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """The weights as whole parts: exact where their period allows, else rounded to parts of it, none of them to 0.

    So a source's weight is about half a part from the one given at most (1 / 131072 of all), but for those lifted to one part.
    """
    exact = parts(weights)
    total, most = sum(exact.values()), max(period, 16 * len(exact))
    if total > most:
        exact = parts({s: max(1, (2 * n * most + total) // (2 * total)) for s, n in exact.items()})
    return {s: exact.get(s, 0) for s in weights}


def pfair(shares: dict[str, int], blocks: dict[str, int] | None = None) -> list[str]:
    """The source of each slot, by earliest deadline among released blocks: a period, or until a source's blocks are used up."""
    period = sum(shares.values())
    window = lambda s, j: (j * period // shares[s], -((-(j + 1) * period) // shares[s]))
    waiting = [(window(s, 0)[0], s, 0) for s in sorted(shares)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    slots = []
    while len(slots) < period:
        while waiting and waiting[0][0] <= len(slots):
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (window(s, j)[1], s, j))
        _, s, j = heapq.heappop(ready)
        slots.append(s)
        if blocks and j + 1 == blocks[s]:
            break
        if j + 1 < shares[s]:
            heapq.heappush(waiting, (window(s, j + 1)[0], s, j + 1))
    return slots


def phases(blocks: dict[str, int], weights: dict[str, float]) -> list[dict]:
    """Plan until every source is used up.

    A phase has its first slot, its period's slots by source, and for each source the number of its
    first block and of blocks placed. It ends at the slot at which the first of its sources is dry; a
    phase shorter than its weights' period is planned whole and does not repeat.
    """
    left, done, slot, plan = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0, []
    while left:
        shares = parts({s: weights[s] for s in left})
        order = pfair(shares, left)
        at: dict[str, list[int]] = {s: [] for s in shares}
        for t, s in enumerate(order):
            at[s].append(t)
        length = len(order)
        if length == sum(shares.values()):
            # the slot of a source's last block, were the phase to last
            length = min((left[s] - 1) // n * len(order) + at[s][(left[s] - 1) % n] for s, n in shares.items()) + 1
        whole, rest = divmod(length, len(order))
        used = {s: whole * len(at[s]) + sum(t < rest for t in at[s]) for s in shares}
        plan.append({"slot": slot, "period": len(order), "at": at, "first": {s: done[s] for s in shares}, "used": used})
        slot += length
        for s, n in used.items():
            done[s] += n
            left[s] -= n
        left = {s: n for s, n in left.items() if n}
    return plan


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, rows_in_block: int = 64, source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """docs with source_key, block, slot, position and target_weight: the order of the mix.

    weights gives target weights by source; sources without one take part with the least weight given.
    Without weights a source's is its number of rows to the power of temperature. Within a source,
    rows come in the order of their columns' hash; a block is rows_in_block of them, its last may be
    shorter. position is slot * rows_in_block plus the place in the block: gaps occur after short
    blocks only. target_weight is the weight as stated(), the one that the less than one block holds for. A null source is the source "" (an empty name likewise); null ids and repeated
    rows are placed like others; an empty table gives none. Clashing columns are replaced.
    """
    spark = docs.sparkSession
    added = ["source_key", "block", "slot", "position", "target_weight"]
    own = [c for c in docs.columns if c not in added]
    keyed = docs.select(*own, F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source_key"))
    with Scratch(spark, "mixing") as scratch:
        rows = {r["source_key"]: r["n"] for r in keyed.groupBy("source_key").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per source
        if not rows:
            return keyed.select(*own, "source_key", *[F.lit(None).cast("bigint").alias(c) for c in added[1:4]], F.lit(None).cast("double").alias("target_weight"))
        target = {s: float(weights.get(s, min(weights.values()))) for s in rows} if weights else {s: n**temperature for s, n in rows.items()}
        target = stated(target)
        blocks = {s: math.ceil(n / rows_in_block) for s, n in rows.items()}
        table, total = [], sum(target.values())
        for p in phases(blocks, target):
            for s, slots in p["at"].items():
                if slots:
                    table.append((s, p["first"][s], p["first"][s] + p["used"][s], p["slot"], p["period"], slots, target[s] / total))
        plan = spark.createDataFrame(table, "_s string, _from bigint, _to bigint, _slot bigint, _period bigint, _at array<int>, _w double")
        ranked = numbered(keyed, ["source_key"], own, "_rank", sum(rows.values()))
        ranked = ranked.withColumn("block", F.expr(f"_rank div {rows_in_block}"))
        # a row for each source and phase, with a number for each of its blocks at most
        small = sum(8 + len(r[5]) for r in table) <= MOST_SENT
        put = ranked.join(F.broadcast(plan) if small else plan, (F.col("source_key") == F.col("_s")) & (F.col("block") >= F.col("_from")) & (F.col("block") < F.col("_to")))
        turn = "(block - _from)"
        slot = F.expr(f"_slot + {turn} div size(_at) * _period + element_at(_at, cast({turn} % size(_at) as int) + 1)")
        placed = put.withColumn("slot", slot).withColumn("position", F.col("slot") * rows_in_block + F.col("_rank") % rows_in_block)
        return placed.select(*own, "source_key", "block", "slot", "position", F.col("_w").alias("target_weight"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mix(docs)
