"""Which requests of a batch get what they ask for when they compete.

A request claims an amount of one or more keys (copies of a book, room on a card) and gets all of
its claims or none. The result is that of handling the requests one after another, found over the
whole batch at once in two ways that take turns:

* A pass looks at all waiting requests. A claim surely fits if it fits even when every earlier waiting
  request is accepted; it surely fails if it does not fit beside the earlier ones already accepted. A
  request whose claims all fit is accepted, one with a failing claim is rejected, the rest wait.
* Where requests hang on each other in chains, passes decide few. Then the waiting requests fall into
  components over the keys they compete for. A component's first requests depend on nothing outside
  it, so they are settled in order in one go, all components beside each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from circdesk.operators.components import components
from circdesk.operators.ordering import BLOCK
from circdesk.operators.scratch import durable
from circdesk.operators.skew import ROWS_PER_TASK, spread_join

KEY = ["loai", "khoa"]
CLAIM = ["request_id", "seq", BLOCK, *KEY, "so_luong", "suc_chua"]
FIRST_CLAIMS = 600  # of a component, settled in one go
_WHOLE = -1


def contended_claims(claims: DataFrame) -> DataFrame:
    """Claims on keys whose total demand exceeds their capacity; null capacity is unlimited.

    Everything else fits whatever happens and stays out. ``_n`` is the number of claims on the key.
    """
    tight = (
        claims.groupBy(*KEY)
        .agg(
            F.sum("so_luong").alias("_demand"),
            F.max("suc_chua").alias("_room"),
            F.count(F.lit(1)).alias("_rows"),
        )
        .where(F.col("_demand") > F.col("_room"))
        .select(*KEY, "_rows", F.col("_rows").alias("_n"))
    )
    return spread_join(claims.select(*CLAIM), tight, KEY, "inner", counted="_rows")


def refused_requests(
    claims: DataFrame, rows_per_task: int = ROWS_PER_TASK, first_claims: int = FIRST_CLAIMS
) -> DataFrame:
    """Distinct ``request_id`` that do not fit; all other requests in ``claims`` do.

    ``claims`` has the columns of ``CLAIM`` with one row per (request, key) and comes from files.
    Passes go in pairs, since the acceptances of one let the next one reject. When a pair leaves more
    than half of the claims waiting, the first requests of every component are settled.
    A key on which nothing waits any more leaves, and accepted requests stay only on keys that others
    still wait for, so every step shrinks to what is undecided.
    """
    contended, seen = durable(contended_claims(claims), waiting=F.count(F.lit(1)))
    names = contended.select("request_id").distinct()
    waiting, decided = seen["waiting"], []
    # How many claims a request has, so that a huge one is not gathered for its verdict.
    sizes = contended.groupBy("request_id").agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") > rows_per_task)
    left = contended.withColumn("_nhan", F.lit(False)).join(
        F.broadcast(sizes), "request_id", "left")  # at most rows / rows_per_task of them
    while waiting:
        before = waiting
        left, seen = durable(_pass(durable(_pass(left, rows_per_task)), rows_per_task), waiting=F.count_if(~F.col("_nhan")))
        if seen["waiting"] * 2 > before:
            decided.append(left.where("_nhan").select("request_id"))
            left, seen = durable(_first_settled(_busy(left), rows_per_task, first_claims), waiting=F.count_if(~F.col("_nhan")))
        waiting = seen["waiting"]
        decided.append(left.where("_nhan").select("request_id"))
        left = _busy(left)
    if not decided:
        return names
    accepted = decided[0]
    for rows in decided[1:]:
        accepted = accepted.unionByName(rows)
    return names.join(accepted.distinct(), "request_id", "left_anti")


def _busy(claims: DataFrame) -> DataFrame:
    """Claims on keys for which some request still waits."""
    return claims.join(claims.where(~F.col("_nhan")).select(*KEY).distinct(), KEY, "left_semi")


def _with_totals(claims: DataFrame, rows_per_task: int) -> DataFrame:
    """Add what earlier claims on the key ask for (``_truoc``) and what earlier accepted ones took (``_lay``).

    A key with more than ``rows_per_task`` claims is totalled in two levels: inside its blocks of the
    batch, after the sums of the earlier blocks. All other keys are one block.
    """
    key = [*KEY, "_phan"]
    rows = claims.withColumns({
        "_phan": F.when(F.col("_n") > rows_per_task, F.col(BLOCK)).otherwise(F.lit(_WHOLE)),
        "_truoc": F.col("so_luong"),
        "_lay": F.when(F.col("_nhan"), F.col("so_luong")).otherwise(F.lit(0).cast("bigint")),
    })
    earlier = Window.partitionBy(*KEY).orderBy("_phan").rowsBetween(Window.unboundedPreceding, -1)
    # What the earlier blocks come to stands in front of a block as a row of its own.
    starts = (
        rows.where(F.col("_n") > rows_per_task).groupBy(*key)
        .agg(F.sum("_truoc").alias("_truoc"), F.sum("_lay").alias("_lay"))
        .withColumns({c: F.sum(c).over(earlier) for c in ("_truoc", "_lay")})
        .where("_truoc is not null")
    )
    inside = Window.partitionBy(*key).orderBy(F.col("request_id").isNotNull(), "seq", "request_id").rowsBetween(
        Window.unboundedPreceding, -1)
    return (
        rows.unionByName(starts, allowMissingColumns=True)
        .withColumns({c: F.coalesce(F.sum(c).over(inside), F.lit(0).cast("bigint")) for c in ("_truoc", "_lay")})
        .where(F.col("request_id").isNotNull())
        .drop("_phan")
    )


def _pass(claims: DataFrame, rows_per_task: int) -> DataFrame:
    """Mark newly accepted requests and leave out the rejected ones.

    Rejected claims are gone, so the plain running total is the pessimistic one and the total of
    accepted claims the optimistic one. A request with very many claims (``_m``) is judged in
    pieces, whose verdicts are then put together.
    """
    rows = _with_totals(claims, rows_per_task).withColumns({
        "_fits": F.col("_truoc") + F.col("so_luong") <= F.col("suc_chua"),
        "_fails": F.col("_lay") + F.col("so_luong") > F.col("suc_chua"),
        "_phan": F.coalesce(
            F.expr(f"cast(pmod(xxhash64(loai, khoa), cast(ceil(_m / {rows_per_task}) as bigint)) as int)"), F.lit(_WHOLE)),
    }).drop("_truoc", "_lay")
    huge = rows.where(F.col("_m").isNotNull()).groupBy("request_id").agg(
        F.min("_fits").alias("_fits_all"), F.max("_fails").alias("_fails_any"))
    own = Window.partitionBy("request_id", "_phan")
    judged = rows.join(F.broadcast(huge), "request_id", "left").withColumns({  # bounded like ``_m``
        "_fits": F.coalesce("_fits_all", F.min("_fits").over(own)),
        "_fails": F.coalesce("_fails_any", F.max("_fails").over(own)),
    })
    return (
        judged.where(F.col("_nhan") | ~F.col("_fails"))
        .withColumn("_nhan", F.col("_nhan") | F.col("_fits"))
        .select(*CLAIM, "_n", "_m", "_nhan")
    )


def _first_settled(claims: DataFrame, rows_per_task: int, first_claims: int) -> DataFrame:
    """Decide the first waiting requests of every component, as many as have ``first_claims`` claims.

    A request that has more claims by itself is left to the passes, and so is what comes after it.
    """
    rows = durable(_with_totals(claims, rows_per_task))
    waiting = rows.where(~F.col("_nhan"))
    # Requests that wait for a key are tied to the first of them.
    first = waiting.groupBy(*KEY).agg(F.min("request_id").alias("_dau"), F.count(F.lit(1)).alias("_c"))
    ties = spread_join(waiting.select("request_id", *KEY), first, KEY, "inner", counted="_c", rows_per_task=rows_per_task)
    member = components(ties.select("request_id", "_dau"), "request_id", "_dau")
    place = F.row_number().over(Window.partitionBy("component").orderBy("seq", "request_id"))
    early = (
        waiting.join(member.withColumnRenamed("node", "request_id"), "request_id", "left")
        .withColumn("component", F.coalesce("component", "request_id"))
        .withColumn("_place", place)
        .where(F.col("_place") <= first_claims + 1)
        .select("component", "seq", "request_id", "_place", F.struct(
            F.struct(*KEY).alias("key"), F.col("so_luong").alias("q"), (F.col("suc_chua") - F.col("_lay")).alias("room")).alias("claim"))
    )
    requests = early.groupBy("component", "seq", "request_id").agg(
        F.collect_list("claim").alias("claims"), F.max("_place").alias("_last"))
    # Of a component with more claims the last request seen may be cut off.
    per = Window.partitionBy("component")
    whole = requests.withColumn("_end", F.max("_last").over(per)).where(
        (F.col("_end") <= first_claims) | (F.col("_last") < F.col("_end")))
    in_order = whole.groupBy("component").agg(F.sort_array(F.collect_list(F.struct("seq", "request_id", "claims"))).alias("r"))
    verdicts = (
        in_order.withColumn("keys", F.expr("array_distinct(flatten(transform(r, x -> x.claims.key)))"))
        .withColumn("steps", F.expr(_STEPS))
        .select(F.explode(F.arrays_zip(F.col("r.request_id").alias("request_id"), F.expr(_IN_ORDER).alias("_ok"))).alias("v"))
        .select("v.request_id", "v._ok")
    )
    settled = rows.join(verdicts, "request_id", "left")
    return settled.where(F.coalesce("_ok", F.lit(True))).withColumn(
        "_nhan", F.col("_nhan") | F.coalesce("_ok", F.lit(False))
    ).select(*CLAIM, "_n", "_m", "_nhan")


_STEPS = """
    transform(r, x -> transform(x.claims, c ->
      named_struct('i', cast(array_position(keys, c.key) - 1 as int), 'q', c.q, 'room', c.room)))
"""
# One request after another: ``used`` is what those accepted here took of each key of the component.
_IN_ORDER = """
    aggregate(
      steps,
      named_struct('used', array_repeat(0L, size(keys)), 'ok', cast(array() as array<boolean>)),
      (s, claims) -> if(
        forall(claims, c -> s.used[c.i] + c.q <= c.room),
        named_struct(
          'used', transform(s.used, (u, i) -> u + aggregate(claims, 0L, (a, c) -> a + if(c.i = i, c.q, 0L))),
          'ok', array_append(s.ok, true)),
        named_struct('used', s.used, 'ok', array_append(s.ok, false))),
      s -> s.ok)
"""
