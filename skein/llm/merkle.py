"""Merkle manifest of a dataset: a tree of digests for each source, one over the sources, and each document's proof.

Trees grow bottom-up, a persisted level at a time; proofs come top-down: a node joins its parent's row, which holds the run it
lies in, and puts its siblings there in front of the proof that the parent inherited.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, ordered

#: Nodes of a run, which become one node of the next level.
FAN = 16

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A source as a key: sources may be null.
TREE = ["unnamed", "name"]
NO_STEPS = "CAST(array() AS array<struct<before:string,after:string>>)"


def field(value: Column) -> Column:
    """A value as it is hashed: its length in bytes, a colon and itself; a dash if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    return F.sha2(F.concat(field(F.col("doc_id")), field(F.col("source")), field(F.col("lang")), field(F.col("n_chars")), field(text)), 256)


def levels(spark: SparkSession, nodes: DataFrame) -> list[DataFrame]:
    """The trees over ``nodes`` (TREE, place from 0, digest), level by level: TREE, place, digest, run (the digests below).

    A tree that is down to one node has no further level. Each level is written to the shared folder; only the largest tree's
    number of nodes reaches the driver.
    """
    out, below = [], nodes
    while (below.agg(F.max("place")).first()[0] or 0) > 0:
        runs = below.withColumn("up", F.floor(F.col("place") / FAN)).groupBy(*TREE, "up").agg(F.array_sort(F.collect_list(F.struct("place", "digest"))).alias("nodes"))
        # A run of one makes a node only where its tree has other runs.
        runs = runs.where((F.col("up") > 0) | (F.size("nodes") > 1)).withColumn("run", F.col("nodes.digest"))
        below = common.cut(spark, runs.select(*TREE, F.col("up").alias("place"), F.sha2(F.concat_ws("", "run"), 256).alias("digest"), "run"), "level")
        out.append(below)
    return out


def tops(nodes: DataFrame, above: list[DataFrame]) -> DataFrame:
    """What each tree comes down to: TREE, digest, height (the level of its only node; 0 for the leaves')."""
    out = None
    for height, level in enumerate([nodes, *above]):
        only = level.groupBy(*TREE).agg(F.max("place").alias("last"), F.min(F.when(F.col("place") == 0, F.col("digest"))).alias("digest"))
        only = only.where("last = 0").select(*TREE, "digest", F.lit(height).alias("height"))
        out = only if out is None else out.unionByName(only)
    return out


def _step(at: Column) -> Column:
    """The siblings of the node at ``at`` of its run, before and after it."""
    return F.struct(F.concat_ws("", F.slice("run", F.lit(1), at)).alias("before"), F.concat_ws("", F.slice("run", at + 2, F.lit(FAN))).alias("after"))


def proofs(spark: SparkSession, nodes: DataFrame, above: list[DataFrame], inherited: DataFrame) -> DataFrame:
    """``nodes`` with ``proof``, the siblings before and after at each level: from the run of the node itself to its tree's top,
    and on with the top's own proof. ``inherited``: TREE, height, proof and whatever else a tree's nodes shall hold.

    A level's parents are the nodes one level up and, for trees that end at this level, their row of ``inherited``.
    """
    extra = [c for c in inherited.columns if c not in (*TREE, "height", "proof")]
    parents, levels_up = None, [nodes, *above]
    for height in reversed(range(len(levels_up))):
        ends = inherited.where(F.col("height") == height).select(*TREE, F.lit(0).cast("long").alias("up"), F.lit(None).cast("array<string>").alias("run"), F.col("proof").alias("rest"), *extra)
        parents = ends if parents is None else parents.select(*TREE, F.col("place").alias("up"), "run", F.col("proof").alias("rest"), *extra).unionByName(ends)
        level = levels_up[height].withColumnRenamed("run", "below") if height else levels_up[height]
        met = level.withColumn("up", F.floor(F.col("place") / FAN)).join(parents.hint("merge"), [*TREE, "up"])
        own = F.concat(F.array(_step((F.col("place") % FAN).cast("int"))), F.col("rest"))
        met = met.withColumn("proof", F.when(F.col("run").isNull(), F.col("rest")).otherwise(own)).drop("up", "run", "rest")
        parents = common.cut(spark, met.withColumnRenamed("below", "run"), "proofs") if height else met
    return parents


def folded(digest: Column, proof: Column) -> Column:
    """The root that a digest gives with the siblings of a proof."""
    return F.aggregate(proof, digest, lambda held, step: F.sha2(F.concat(step["before"], held, step["after"]), 256))


def manifest(spark: SparkSession, documents: DataFrame, tampered: Column | None = None) -> DataFrame:
    """Each document's leaf, its source's subroot, the root, and whether the leaf proves to lie below it.

    doc_id, leaf, subroot, root, proof_sha256 (of the siblings, from the leaf's level to the root), folded_root (of the leaf of
    ``tampered``, a text to stand for the document's, and the original siblings), verified (equals root).

    Leaves of one doc_id come by their digests; repeated rows are leaves of their own; null doc_ids come first. Other columns
    are not read. An empty table has no root and an empty result. Texts are hashed where they are read; only digests are
    shuffled. A source may hold any share of the rows, and there may be as many sources as rows.
    """
    text = F.col("text") if tampered is None else tampered
    hashed = documents.select("doc_id", F.col("source").isNull().alias("unnamed"), F.coalesce("source", F.lit("")).alias("name"), leaf(F.col("text")).alias("digest"), leaf(text).alias("shown"), F.monotonically_increasing_id().alias("row"))
    order = ["doc_id", "digest", "row"]
    placed = ordered.place(spark, hashed, TREE, order, "leaves")
    numbered = ordered.running(placed, TREE, order, "place", F.lit(1)).withColumn("place", F.col("place") - 1)
    leaves = common.cut(spark, numbered.select(*TREE, "place", "doc_id", "digest", "shown"), "numbered")
    common.free(spark, placed)
    own = levels(spark, leaves.select(*TREE, "place", "digest"))

    # The tree over the sources: one tree, whose leaves are the subroots, null first.
    found = common.cut(spark, tops(leaves, own).withColumnsRenamed({"unnamed": "of_unnamed", "name": "of_name", "height": "of_height"}), "tops")
    found = found.withColumns({"one": F.lit(True), "named": ~F.col("of_unnamed"), "unnamed": F.lit(False), "name": F.lit("")})
    placed = ordered.place(spark, found, ["one"], ["named", "of_name"], "subroots")
    subroots = ordered.running(placed, ["one"], ["named", "of_name"], "place", F.lit(1)).withColumn("place", F.col("place") - 1)
    subroots = common.cut(spark, subroots.select("of_unnamed", "of_name", "of_height", *TREE, "place", "digest"), "sources")
    common.free(spark, placed)
    top = levels(spark, subroots.select(*TREE, "place", "digest"))
    root = tops(subroots, top).select(*TREE, "height", F.expr(NO_STEPS).alias("proof"), F.col("digest").alias("root"))
    over = proofs(spark, subroots, top, root)
    over = common.cut(spark, over.select(F.col("of_unnamed").alias("unnamed"), F.col("of_name").alias("name"), F.col("of_height").alias("height"), "proof", F.col("digest").alias("subroot"), "root"), "over")

    proved = proofs(spark, leaves, own, over)
    siblings = F.concat_ws("", F.transform("proof", lambda step: F.concat(step["before"], step["after"])))
    out = proved.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded(F.col("shown"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def lowered_fifth() -> Column:
    """The text, its A-Z in lower case where 5 divides the crc32 of the document's id."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return F.when(chosen, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))


def _oracle(most: int = 6) -> str:
    """SQL with ``most`` levels of each tree written out, for up to 16^most nodes."""

    def field(c: str) -> str:
        return f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"

    def tree(name: str, nodes: str) -> str:
        """CTEs: levels of the trees over ``nodes`` (grp, place, digest), their siblings and each tree's top."""
        ctes, below = [f"{name}0 AS ({nodes})"], f"{name}0"
        for k in range(1, most + 1):
            ctes.append(f"""{name}{k} AS (SELECT grp, place // {FAN} AS place, sha256(string_agg(digest, '' ORDER BY place)) AS digest FROM {below}
  WHERE grp IN (SELECT grp FROM {below} GROUP BY grp HAVING count(*) > 1) GROUP BY grp, place // {FAN})""")
            below = f"{name}{k}"
        for k in range(most + 1):
            run = f"PARTITION BY grp, place // {FAN} ORDER BY place ROWS BETWEEN"
            ctes.append(f"""{name}s{k} AS (SELECT grp, place, digest, coalesce(string_agg(digest, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
  coalesce(string_agg(digest, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a, count(*) OVER (PARTITION BY grp) > 1 AS goes_on FROM {name}{k})""")
        ctes.append(f"{name}top AS (" + " UNION ALL ".join(f"SELECT grp, digest FROM {name}s{k} WHERE NOT goes_on" for k in range(most + 1)) + ")")
        return ",\n".join(ctes)

    def walk(name: str, row: str, grp: str, place: str) -> tuple[str, str]:
        """Joins of a row with its nodes of all levels that have siblings or a run, and its siblings."""
        joins = " ".join(f"LEFT JOIN {name}s{k} {name}n{k} ON {name}n{k}.grp = {row}.{grp} AND {name}n{k}.place = {row}.{place} // {FAN**k} AND {name}n{k}.goes_on" for k in range(most))
        siblings = " || ".join(f"coalesce({name}n{k}.b || {name}n{k}.a, '')" for k in range(most))
        return joins, siblings

    def folds(name: str, held: str, rows: str, columns: str, joins: str) -> str:
        """CTEs that fold ``held`` level by level."""
        ctes = [f"{name}f0 AS (SELECT {columns}, {held} AS held, " + ", ".join(f"{name}n{k}.b AS b{k}, {name}n{k}.a AS a{k}" for k in range(most)) + f" FROM {rows} {joins})"]
        for k in range(most):
            ctes.append(f"{name}f{k + 1} AS (SELECT * REPLACE (CASE WHEN b{k} IS NULL THEN held ELSE sha256(b{k} || held || a{k}) END AS held) FROM {name}f{k})")
        return ",\n".join(ctes)

    lowered = f"CASE WHEN {common.crc32_sql('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END"
    start = " || ".join(map(field, ("doc_id", "source", "lang", "n_chars")))
    own_joins, own_siblings = walk("d", "l", "grp", "place")
    top_joins, top_siblings = walk("t", "g", "one", "grp")
    return f"""
WITH groups AS (SELECT source, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS grp FROM (SELECT DISTINCT source FROM documents)),
hashed AS (SELECT doc_id, source, sha256({start} || {field('text')}) AS digest, sha256({start} || {field('shown')}) AS shown FROM (SELECT *, {lowered} AS shown FROM documents)),
leaves AS (SELECT doc_id, grp, digest, shown, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, digest) - 1 AS place FROM hashed h JOIN groups g ON h.source IS NOT DISTINCT FROM g.source),
{tree("d", "SELECT grp, place, digest FROM leaves")},
{tree("t", "SELECT 0 AS grp, grp AS place, digest FROM dtop")},
proved AS (SELECT l.doc_id, l.grp, l.place, l.digest, l.shown, {own_siblings} AS siblings FROM leaves l {own_joins}),
{folds("d", "l.shown", "leaves l", "l.grp, l.place", own_joins)},
sources AS (SELECT g.grp, {top_siblings} AS siblings FROM (SELECT grp, 0 AS one FROM groups) g {top_joins}),
carried AS (SELECT f.grp, f.place, f.held, 0 AS one FROM df{most} f),
{folds("t", "g.held", "carried g", "g.grp, g.place", top_joins)}
SELECT p.doc_id, p.digest AS leaf, d.digest AS subroot, t.digest AS root, sha256(p.siblings || s.siblings) AS proof_sha256, f.held AS folded_root, f.held = t.digest AS verified
FROM proved p JOIN sources s ON s.grp = p.grp JOIN dtop d ON d.grp = p.grp CROSS JOIN ttop t JOIN tf{most} f ON f.grp = p.grp AND f.place = p.place
"""


ORACLE = _oracle()
