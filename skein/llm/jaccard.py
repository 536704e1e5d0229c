"""Near copies by the Jaccard similarity of their word shingles, found exactly by prefix filtering.

Shingles are put in one order, the same for all texts. Two sets whose similarity is at least SIMILARITY share a shingle among
the first n - ceil(SIMILARITY n) + 1 of each (n: the set's size). So texts meet at the shingles of their prefixes. Where they
meet first, the shingles that are left must suffice for the similarity; and each class of hashes whose parity differs holds a
shingle of one set only. Pairs that pass both are compared on whole sets; no pair is lost. Shingles that are common in a
bounded sample come last in the order, so that few texts meet at one: the sample decides how fast it goes, never what is found.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .components import components
from .simhash import text_hashes

WORDS = 5
#: At least 4 / 5, in whole numbers.
SIMILARITY = (4, 5)
#: Texts that the order of shingles is taken from: one in SAMPLE_SHARE, SAMPLE at least; how many of them make a shingle
#: common, and the most of those.
SAMPLE = 8192
SAMPLE_SHARE = 8
COMMON_TEXTS = 3
COMMON_MOST = 1_000_000
#: Bits of a set's parities: a power of 2 of at least its size, within these.
PARITY_BITS = (64, 1 << 16)
#: Stands for the one shingle of texts without a word.
WORDLESS = 0


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; texts without a word share one of their own."""
    return np.unique(np.asarray(text_hashes(text, words) or [WORDLESS], np.uint64))


def prefix_size(n: int) -> int:
    a, b = SIMILARITY
    return n - -(-a * n // b) + 1


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    a, b = SIMILARITY
    if b * min(len(x), len(y)) < a * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return b * both >= a * (len(x) + len(y) - both)


def parity_of(s: np.ndarray) -> np.ndarray:
    """Whether each class of hashes holds an odd number of them, packed; hashes are classed by their lowest bits."""
    least, most = PARITY_BITS
    bits = min(most, max(least, 1 << (len(s) - 1).bit_length()))
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def unequal(x: bytes, y: bytes) -> int:
    """Classes of unequal parity, the finer parities folded to the coarser ones: at most the shingles that are in one set only."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(a) > len(b):
        a, b = b, a
    return int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)).sum())


def text_id() -> Column:
    return F.xxhash64(F.col("text").cast("binary"))


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """id and s (the sorted hashes, little-endian) of each row of ``texts``: id, text."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t, words).astype("<u8").tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["id", "s"])

    return texts.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "id long, s binary")


def _common(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles common in the sample, sorted, and how many sampled texts hold each."""
    n = texts.count()
    sampled = texts.where(F.pmod(F.xxhash64("id"), F.lit(max(1, min(SAMPLE_SHARE, n // SAMPLE)))) == 0).dropDuplicates(["id"])

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for t in b.column(1).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t, words).view(np.int64))], ["token"])

    counted = sampled.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "token long").groupBy("token").count().where(F.col("count") >= COMMON_TEXTS)
    # bounded (see COMMON_MOST)
    rows = counted.orderBy(F.desc("count"), "token").limit(COMMON_MOST).toArrow()
    token, held = rows.column(0).to_numpy().view(np.uint64), rows.column(1).to_numpy()
    order = np.argsort(token)
    return token[order], held[order]


def _prefixes(texts: DataFrame, words: int, token: np.ndarray, held: np.ndarray) -> DataFrame:
    """id, n, parity and tokens (the prefix) of every row of ``texts``."""
    names = ["id", "n", "parity", "tokens"]
    order = texts.sparkSession.sparkContext.broadcast((token, held))  # COMMON_MOST at most

    def run(batches):
        import pyarrow as pa

        common.let_go()
        token, held = order.value
        for b in batches:
            out, sizes, parity = [], [], []
            for t in b.column(1).to_pylist():
                s = shingles(t, words)
                parity.append(parity_of(s).tobytes())
                sizes.append(len(s))
                if len(token):
                    at = np.minimum(np.searchsorted(token, s), len(token) - 1)
                    weight = np.where(token[at] == s, held[at], 0)
                    if weight.any():
                        s = s[np.argsort(weight, kind="stable")]
                out.append(s[: prefix_size(len(s))].view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int32()), pa.array(parity, pa.binary()), pa.array(out, pa.list_(pa.int64()))], names)

    return texts.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "id long, n int, parity binary, tokens array<long>")


def _suffices(x: str, y: str) -> Column:
    """Whether texts x and y that meet first at a shingle (its place in each prefix is pos) have enough shingles left."""
    a, b = SIMILARITY
    col = lambda t, c: F.col(f"{t}.{c}" if t else c)
    most = F.least(col(x, "n") - col(x, "pos"), col(y, "n") - col(y, "pos"))
    return (b * F.least(col(x, "n"), col(y, "n")) >= a * F.greatest(col(x, "n"), col(y, "n"))) & ((a + b) * most >= a * (col(x, "n") + col(y, "n")))


def _possible(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """Those of the pairs u, v that their parities do not rule out."""
    a, b = SIMILARITY

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(2, 6)]
            ok = [(a + b) * unequal(x, y) <= (b - a) * (n + m) for n, x, m, y in zip(*columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(ok, pa.bool_()))

    one = prints.select(F.col("id").alias("u"), F.col("n").alias("xn"), F.col("parity").alias("x"))
    other = prints.select(F.col("id").alias("v"), F.col("n").alias("yn"), F.col("parity").alias("y"))
    return pairs.join(one, "u").join(other, "v").select("u", "v", "xn", "x", "yn", "y").mapInArrow(run, "u long, v long")


def verified(spark: SparkSession, pairs: DataFrame, texts: DataFrame, words: int = WORDS) -> DataFrame:
    """Those of the pairs u, v that are similar as whole sets; texts: id, text."""
    pairs = common.cut(spark, pairs, "possible")
    wanted = pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct()
    sets = common.cut(spark, _sets(texts.join(wanted, "id", "left_semi").dropDuplicates(["id"]), words), "sets")

    def whole(batches):
        import pyarrow as pa

        for batch in batches:
            ok = [similar(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(sets.select(F.col("id").alias("u"), F.col("s").alias("x")), "u").join(sets.select(F.col("id").alias("v"), F.col("s").alias("y")), "v")
    out = common.cut(spark, both.select("u", "v", "x", "y").mapInArrow(whole, "u long, v long"), "verified")
    common.free(spark, pairs, sets)
    return out


def near_copies(spark: SparkSession, docs: DataFrame, words: int = WORDS) -> DataFrame:
    """id and component (the least id reachable) of every text that is similar to another; ids are ``text_id()`` of docs' text.

    Texts are similar if the Jaccard similarity of their sets of ``words``-word shingles is at least SIMILARITY. Words are
    lower-cased and parted as for ``simhash``; fewer words than a shingle make one. Null and wordless texts are alike. Equal
    texts have one id. First all that meet at a shingle are compared with the least of them; then only pairs whose parts are
    not joined yet.
    """
    common.bounded_batches(spark)
    texts = docs.select(text_id().alias("id"), "text")
    met = Window.partitionBy("token")
    prefixes = common.cut(spark, _prefixes(texts, words, *_common(texts, words)), "prefixes")
    prints = prefixes.drop("tokens").dropDuplicates(["id"])
    entries = prefixes.select(F.posexplode("tokens").alias("pos", "token"), "id", "n")
    least = F.min(F.struct("id", "n", "pos")).over(met)
    shared = entries.withColumns({"lo": least, "hi": F.max("id").over(met)}).where("lo.id <> hi").select("token", "id", "n", "pos", "lo")
    shared = common.cut(spark, shared, "shared")
    stars = shared.where("id <> lo.id").where(_suffices("", "lo")).select(F.col("id").alias("u"), F.col("lo.id").alias("v")).distinct()
    links = verified(spark, _possible(stars, prints), texts, words)
    joined = components(spark, links)
    parted = shared.join(joined, "id", "left").select("token", "id", "n", "pos", F.coalesce("component", "id").alias("part"))
    parted = parted.distinct().withColumns({"first": F.min("part").over(met), "last": F.max("part").over(met), "least": F.min("id").over(met)}).where("first <> last").select("token", "id", "n", "pos", "part", "least")
    parted = common.cut(spark, parted, "parted")
    common.free(spark, shared)
    x, y = parted.alias("x"), parted.alias("y")
    apart = (F.col("x.token") == F.col("y.token")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.part") != F.col("y.part")) & (F.col("x.id") != F.col("x.least"))
    pairs = x.join(y, apart).where(_suffices("x", "y")).select(F.col("x.id").alias("u"), F.col("y.id").alias("v")).distinct()
    more = verified(spark, _possible(pairs, prints), texts, words)
    common.free(spark, prefixes, parted)
    return components(spark, links.unionByName(more))
