"""Quarantine and cascading release: faulty turns are retried until repaired, and hold their dependants back meanwhile.

A turn's delivery is a function of its parent's: each attempt waits for the parent, so with the time of the first attempt s, a
turn is delivered at s plus a shift that depends on s piecewise, or never. Such functions compose to functions of the same kind.
Pointer doubling composes each turn's with its ancestors': in round r a turn knows its delivery as a function of that of its
2^r-th ancestor, and a join with that ancestor's row doubles the reach, until all have passed a turn without a parent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, ordered

#: Seconds between arrivals; attempts before a turn is dead; seconds after the first attempt at which each attempt comes.
STEP = 7
ATTEMPTS = 6
WAITS = [10 * (2**a - 1) for a in range(ATTEMPTS)]
#: Later than any delivery.
NEVER = 1 << 60

PIECE = "struct<lo:bigint,hi:bigint,add:bigint,at:bigint>"
KEY = ["unnamed", "conv"]

#: f after g, both lists of pieces: for an input in [lo, hi) the result is input + add, or at, or no delivery where both are null.
COMPOSED = f"""
flatten(transform(g, x -> CASE
    WHEN x.add IS NOT NULL THEN filter(
        transform(f, y -> CAST(struct(greatest(x.lo, y.lo - x.add), least(x.hi, y.hi - x.add), x.add + y.add, y.at) AS {PIECE})),
        z -> z.lo < z.hi)
    WHEN x.at IS NOT NULL THEN transform(
        filter(f, y -> y.lo <= x.at AND x.at < y.hi),
        y -> CAST(struct(x.lo, x.hi, NULL, coalesce(y.at, x.at + y.add)) AS {PIECE}))
    ELSE array(x) END))
"""


def drawn(k: int) -> Column:
    """h(k) of a turn; a null conv_id or turn is written as nothing."""
    return F.crc32(F.concat_ws(":", F.lit(str(k)), F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.coalesce(F.col("turn").cast("string"), F.lit(""))).cast("binary"))


def _piece(lo, hi, add=None, at=None) -> Column:
    parts = [c if isinstance(c, Column) else F.lit(c) for c in (lo, hi, add, at)]
    return F.struct(*[c.cast("long").alias(n) for c, n in zip(parts, ("lo", "hi", "add", "at"))])


def with_faults(turns: DataFrame) -> DataFrame:
    """Arrival, parent's number (null without one), and of faulty turns when they are repaired and which attempts can succeed."""
    distance = drawn(0) % 5
    out = turns.withColumn("arrived", F.col("p") * STEP).withColumn("parent", F.when((distance > 0) & (distance <= F.col("p")), F.col("p") - distance))
    out = out.withColumn("repaired", F.when(drawn(1) % 101 < 50, F.col("arrived") + drawn(2) % 101))
    lucky = F.array(*[drawn(a + 3) % 3 != 0 for a in range(ATTEMPTS)])
    return out.withColumn("lucky", F.when(F.col("repaired").isNotNull(), lucky).otherwise(F.array(F.lit(True))))


def pieces() -> Column:
    """The turn's delivery by its parent's; of a turn without a parent, by nothing: one piece for all inputs."""
    # Attempt a comes after the repair from this time of the first attempt on; the waits grow, so later attempts reach further back.
    since = [F.greatest(F.coalesce("repaired", "arrived") - wait, F.col("arrived")) for wait in WAITS]
    lucky = [F.coalesce(F.get("lucky", F.lit(a)), F.lit(False)) for a in range(ATTEMPTS)]
    ends = [F.least(F.lit(NEVER), F.lit(NEVER), *[F.when(lucky[b], since[b]) for b in range(a)]) for a in range(ATTEMPTS + 1)]
    works = [lucky[a] & (since[a] < ends[a]) for a in range(ATTEMPTS)]
    made = [F.when(works[a], _piece(since[a], ends[a], add=wait)) for a, wait in enumerate(WAITS)]
    first = F.coalesce(*[F.when(works[a] & (since[a] == F.col("arrived")), F.col("arrived") + wait) for a, wait in enumerate(WAITS)])
    dead = F.when(ends[ATTEMPTS] > F.col("arrived"), _piece(F.col("arrived"), ends[ATTEMPTS]))
    # A parent is never delivered before it arrives itself; until this turn's own arrival its delivery changes nothing.
    waiting = _piece(F.col("parent") * STEP, F.col("arrived"), at=first)
    all_pieces = F.filter(F.array(waiting, *made, dead), lambda x: x.isNotNull())
    return F.when(F.col("parent").isNotNull(), all_pieces).otherwise(F.array(_piece(0, NEVER, at=first)))


def replay(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """Each turn's status, attempts and place in its conversation's releases.

    conv_id, turn, status (delivered; dead after six failures; blocked where the parent is dead or blocked), attempts, first_at
    and last_at (seconds of the first and last attempt), release_no (delivered turns by last_at, turn), state (sum of release_no
    times the text's crc32 through this release; modulo 2^64, as a signed number). Null where it does not apply.

    Turns of one number come by the hash of their text; repeated rows are turns of their own, one after the other. A null turn
    comes first, rows of null conv_id are one conversation, null and empty texts add nothing to the state; other columns
    are not read. An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = turns.select("conv_id", "turn", F.crc32(text).alias("crc"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumns({"unnamed": F.col("conv_id").isNull(), "conv": F.coalesce("conv_id", F.lit(0))})
    order = ["turn", "tie", "row"]
    placed = ordered.place(spark, rows, KEY, order, "turns")
    numbered = ordered.running(placed, KEY, order, "p", F.lit(1)).withColumn("p", F.col("p") - 1)
    begun = with_faults(numbered).withColumn("pieces", pieces())
    state = common.cut(spark, begun.select(*KEY, "conv_id", "turn", "crc", "p", "parent", "repaired", "lucky", F.col("parent").alias("up"), "pieces"), "chains")
    common.free(spark, placed)

    while not state.where("up IS NOT NULL").isEmpty():
        above = state.select(*KEY, F.col("p").alias("up"), F.col("up").alias("next"), F.col("pieces").alias("g"))
        met = state.where("up IS NOT NULL").withColumnRenamed("pieces", "f").join(above.hint("merge"), [*KEY, "up"])
        reached = met.withColumn("pieces", F.expr(COMPOSED)).withColumn("up", F.col("next")).select(*state.columns)
        before, state = state, common.cut(spark, state.where("up IS NULL").unionByName(reached), "chains")
        common.free(spark, before)

    at = F.col("pieces")[0]["at"]
    parents = state.select(*KEY, F.col("p").alias("parent"), at.alias("freed"), F.lit(True).alias("known"))
    met = state.withColumn("delivered", at.isNotNull()).join(parents.hint("merge"), [*KEY, "parent"], "left")
    arrived = F.col("p") * STEP
    blocked = F.col("known").isNotNull() & F.col("freed").isNull()
    met = met.withColumn("first_at", F.when(~blocked, F.greatest(arrived, F.coalesce("freed", arrived))))
    tried = F.lit(None).cast("int")
    for a in reversed(range(ATTEMPTS)):
        works = F.coalesce(F.get("lucky", F.lit(a)), F.lit(False)) & (F.col("repaired").isNull() | (F.col("first_at") + WAITS[a] >= F.col("repaired")))
        tried = F.when(works, F.lit(a + 1)).otherwise(tried)
    met = met.withColumn("attempts", F.when(blocked, 0).otherwise(F.coalesce(tried, F.lit(ATTEMPTS))))
    waited = F.get(F.array(*map(F.lit, WAITS)), F.col("attempts") - 1)
    met = met.withColumn("last_at", F.when(~blocked, F.col("first_at") + waited))
    met = met.withColumn("status", F.when(blocked, "blocked").when(F.col("delivered"), "delivered").otherwise("dead"))
    met = met.select(*KEY, "conv_id", "turn", "p", "crc", "status", "attempts", "first_at", "last_at", "delivered")

    order = ["last_at", "p"]
    placed = ordered.place(spark, met, KEY, order, "releases")
    common.free(spark, state)
    released = ordered.running(placed, KEY, order, "release_no", F.col("delivered").cast("long"))
    weight = F.when(F.col("delivered"), F.col("release_no").cast("decimal(19,0)") * F.col("crc").cast("decimal(10,0)")).otherwise(F.lit(0).cast("decimal(30,0)"))
    numbers = common.cut(spark, released, "numbers")
    common.free(spark, placed)
    released = ordered.running(numbers, KEY, order, "state", weight.cast("decimal(30,0)"))
    around = F.lit(str(1 << 64)).cast("decimal(38,0)")
    modulo = F.pmod(F.col("state").cast("decimal(38,0)"), around)
    signed = F.when(modulo >= F.lit(str(1 << 63)).cast("decimal(38,0)"), modulo - around).otherwise(modulo).cast("long")
    done = F.col("delivered")
    return released.select("conv_id", "turn", "status", F.col("attempts").cast("int").alias("attempts"), "first_at", "last_at", F.when(done, F.col("release_no")).alias("release_no"), F.when(done, signed).alias("state"))


def _oracle() -> str:
    h = [common.crc32_sql(f"'{k}:' || id") for k in range(9)]
    lucky = ", ".join(f"{x} % 3 <> 0" for x in h[3:])
    waits = ", ".join(map(str, WAITS))
    return f"""
WITH RECURSIVE numbered AS (
  SELECT conv_id, turn, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS p,
    coalesce(CAST(conv_id AS VARCHAR), '') || ':' || coalesce(CAST(turn AS VARCHAR), '') AS id
  FROM conversations),
drawn AS (
  SELECT conv_id, turn, text, p, 7 * p AS arrived, {h[0]} % 5 AS distance, {h[1]} % 101 < 50 AS faulty, 7 * p + {h[2]} % 101 AS repaired, [{lucky}] AS lucky
  FROM numbered),
turns AS (SELECT *, CASE WHEN distance BETWEEN 1 AND p THEN p - distance END AS parent FROM drawn),
tried AS (
  SELECT conv_id, p, first_at, first_at + [{waits}][attempt] AS at, attempt, false AS blocked
  FROM (SELECT *, arrived AS first_at, CASE WHEN NOT faulty THEN 1 ELSE list_filter(range(1, 7), lambda a: lucky[a] AND arrived + [{waits}][a] >= repaired)[1] END AS attempt FROM turns WHERE parent IS NULL)
  UNION ALL
  SELECT conv_id, p, CASE WHEN NOT blocked THEN first_at END, CASE WHEN NOT blocked THEN first_at + [{waits}][attempt] END, CASE WHEN NOT blocked THEN attempt END, blocked
  FROM (
    SELECT *, CASE WHEN NOT faulty THEN 1 ELSE list_filter(range(1, 7), lambda a: lucky[a] AND first_at + [{waits}][a] >= repaired)[1] END AS attempt
    FROM (SELECT t.*, greatest(t.arrived, r.at) AS first_at, r.at IS NULL AS blocked FROM turns t JOIN tried r ON t.conv_id IS NOT DISTINCT FROM r.conv_id AND t.parent = r.p))),
judged AS (
  SELECT t.*, r.first_at, r.blocked, r.attempt, CASE WHEN NOT r.blocked THEN r.first_at + [{waits}][coalesce(r.attempt, 6)] END AS last_at, NOT r.blocked AND r.attempt IS NOT NULL AS delivered
  FROM turns t JOIN tried r ON t.conv_id IS NOT DISTINCT FROM r.conv_id AND t.p = r.p),
released AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY last_at, p) AS release_no, {common.crc32_sql("text")} AS crc FROM judged WHERE delivered),
states AS (SELECT conv_id, p, release_no, CAST(sum(release_no * crc) OVER (PARTITION BY conv_id ORDER BY release_no) AS BIGINT) AS state FROM released)
SELECT j.conv_id, j.turn, CASE WHEN blocked THEN 'blocked' WHEN delivered THEN 'delivered' ELSE 'dead' END AS status,
  CAST(CASE WHEN blocked THEN 0 ELSE coalesce(attempt, 6) END AS INTEGER) AS attempts, first_at, last_at, s.release_no, s.state
FROM judged j LEFT JOIN states s ON j.conv_id IS NOT DISTINCT FROM s.conv_id AND j.p = s.p
"""


#: For tables whose turns are distinct within a conversation.
ORACLE = _oracle()
