"""Language of each word by a linear-chain conditional random field, and of a document by its words.

A chain is a line's words (runs of letters, in lower case), cut after CHAIN_WORDS. Features of a word are its affixes, its
character n-grams and its entry in a lexicon learned with the model; transitions between labels are learned with them, on
lines of labelled documents and on chains spliced from lines of several languages, so that switches occur. Labels' posterior
chances come from forward-backward; a document's language is the one its words most add up to, whole text.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

UNKNOWN = "und"
#: Bounds of the training sample: labelled documents (by a hash of doc_id), and pieces of their whole texts (by a hash). A piece
#: is a line, cut after PIECE_CHARS at the end of a word.
FIT_DOCS = 1500
FIT_PIECES = 12_000
PIECE_CHARS = 1000
#: Words of the lexicon (the commonest of the sample) and the least count of one.
LEXICON_WORDS = 20_000
LEAST_COUNT = 3
BUCKETS = 1 << 15
CHAIN_WORDS = 256
ROUNDS = 30
RATE = 0.3
DECAY = 1e-4
#: Of all training chains, those spliced, and the words of a spliced part.
SPLICED = 0.3
PART_WORDS = (3, 15)
MEMO_WORDS = 200_000
#: Characters labelled at once, and words whose features are made at once; both bound memory only.
AT_ONCE = 1 << 20
NEW_WORDS = 10_000
#: The pipeline's least score.
LEAST_SCORE = 0.35


def features(word: str) -> list[int]:
    """Buckets of the affixes up to 3 letters and the n-grams of 2 and 3 letters, ends marked."""
    w = f"<{word}>"
    names = [f"p{word[:k]}" for k in (1, 2, 3)] + [f"s{word[-k:]}" for k in (1, 2, 3)]
    names += [w[i : i + 2] for i in range(len(w) - 1)] + [w[i : i + 3] for i in range(len(w) - 2)]
    return [zlib.crc32(x.encode("utf-8", "replace")) & (BUCKETS - 1) for x in names]


def chains_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, words) of chains of at most CHAIN_WORDS, longest first, for runs of these lengths in a row."""
    starts = np.cumsum(lengths) - lengths
    n = -(-lengths // CHAIN_WORDS)
    run = np.repeat(np.arange(len(lengths)), n)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    first = starts[run] + nth * CHAIN_WORDS
    size = np.minimum(lengths[run] - nth * CHAIN_WORDS, CHAIN_WORDS)
    order = np.argsort(-size, kind="stable")
    return first[order], size[order]


def forward_backward(emission: np.ndarray, transition: np.ndarray, first: np.ndarray, size: np.ndarray, pairs: bool = False):
    """Posterior of each label at each word; with ``pairs`` also the expected transitions, summed."""
    psi = np.exp(emission - emission.max(axis=1, keepdims=True))
    m = np.exp(transition - transition.max())
    every = np.ones_like(m)  # x @ every: each row's sum in all its places, faster than a sum over a short axis
    alpha, beta = np.zeros_like(psi), np.zeros_like(psi)
    if len(first) == 0:
        return psi, np.zeros_like(m)
    active = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")  # chains of more than t words
    for t, n in enumerate(active):
        at = first[:n] + t
        a = psi[at] if t == 0 else (alpha[at - 1] @ m) * psi[at]
        alpha[at] = a / (a @ every)
    beta[first + size - 1] = 1.0
    for t in range(len(active) - 2, -1, -1):
        at = first[: active[t + 1]] + t
        b = (psi[at + 1] * beta[at + 1]) @ m.T
        beta[at] = b / (b @ every)
    post = alpha * beta
    post /= post @ every
    if not pairs:
        return post, None
    inner = np.ones(len(psi), bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    left, right = alpha[at - 1], psi[at] * beta[at]
    weight = 1.0 / (((left @ m) * right) @ every[:, 0])
    return post, m * ((left * weight[:, None]).T @ right)


class WordField:
    """The learned weights: by feature bucket and label, by lexicon entry and label, and between labels."""

    def __init__(self, labels: list[str], lexicon: dict[str, np.ndarray]):
        k = len(labels)
        self.labels, self.lexicon = labels, lexicon
        self.weights, self.entry, self.transition = np.zeros((BUCKETS, k)), np.zeros((k, k)), np.zeros((k, k))

    def _flat(self, words: list[str]):
        each = [np.asarray(features(w), np.int32) for w in words]
        n = np.fromiter(map(len, each), np.int64, len(each))
        none = np.zeros(len(self.labels))
        lex = np.stack([self.lexicon.get(w, none) for w in words]) if words else np.zeros((0, len(none)))
        return np.concatenate(each).astype(np.int64) if each else np.zeros(0, np.int64), n, lex

    def emissions(self, words: list[str]) -> np.ndarray:
        flat, n, lex = self._flat(words)
        if not words:
            return lex
        return np.add.reduceat(self.weights[flat], np.cumsum(n) - n, axis=0) / n[:, None] + lex @ self.entry

    @classmethod
    def fit(cls, lines: list[tuple[str, list[str]]], seed: int = 42) -> "WordField":
        """From (label, words) of lines; the gradient of the chains' likelihood, by Adagrad over all chains each round."""
        rng = np.random.default_rng(seed)
        labels = sorted({x for x, _ in lines})
        place = {x: k for k, x in enumerate(labels)}
        k = len(labels)
        counts: dict[str, np.ndarray] = {}
        for label, words in lines:
            for w in words:
                counts.setdefault(w, np.zeros(k))[place[label]] += 1
        common_words = sorted((w for w, c in counts.items() if c.sum() >= LEAST_COUNT), key=lambda w: (-counts[w].sum(), w))[:LEXICON_WORDS]
        field = cls(labels, {w: counts[w] / (counts[w].sum() + 1) for w in common_words})
        # a chain is a list of parts (words, label)
        chains = [[(words, place[label])] for label, words in lines if words]
        by_label = [[c[0][0] for c in chains if c[0][1] == y] for y in range(k)]
        for _ in range(int(len(chains) * SPLICED / (1 - SPLICED)) if k > 1 else 0):
            mixed = []
            for y in rng.permutation(k)[: rng.integers(2, min(k, 3) + 1)]:
                own = by_label[y][rng.integers(len(by_label[y]))]
                n = int(rng.integers(PART_WORDS[0], PART_WORDS[1] + 1))
                at = int(rng.integers(0, max(1, len(own) - n + 1)))
                mixed.append((own[at : at + n], y))
            chains.append(mixed)
        parts = [p for c in chains for p in c]
        types = {w: i for i, w in enumerate(dict.fromkeys(w for own, _ in parts for w in own))}
        words = np.fromiter((types[w] for own, _ in parts for w in own), np.int64)
        truth = np.repeat([y for _, y in parts], [len(own) for own, _ in parts])
        first, size = chains_of(np.fromiter((sum(len(own) for own, _ in c) for c in chains), np.int64, len(chains)))
        del chains, parts, by_label
        flat, n, lex = field._flat(list(types))
        owner = np.repeat(np.arange(len(types)), n)
        inner = np.ones(len(words), bool)
        inner[first] = False
        at = np.flatnonzero(inner)
        seen = np.zeros((k, k))
        np.add.at(seen, (truth[at - 1], truth[at]), 1)
        total = len(words)
        squares = [np.zeros_like(x) + 1e-12 for x in (field.weights, field.entry, field.transition)]
        for _ in range(ROUNDS):
            by_type = np.add.reduceat(field.weights[flat], np.cumsum(n) - n, axis=0) / n[:, None] + lex @ field.entry
            post, expected = forward_backward(by_type[words], field.transition, first, size, pairs=True)
            off = post
            off[np.arange(total), truth] -= 1
            by = np.stack([np.bincount(words, off[:, y], minlength=len(types)) for y in range(k)], axis=1) / total
            share = by / n[:, None]
            grads = [np.stack([np.bincount(flat, share[owner, y], minlength=BUCKETS) for y in range(k)], axis=1), lex.T @ by, (expected - seen) / total]
            for x, g, s in zip((field.weights, field.entry, field.transition), grads, squares):
                g += DECAY * x / BUCKETS
                s += g * g
                x -= RATE * g / np.sqrt(s)
        return field


class Labeller:
    """Words' emissions are kept for the words met before."""

    def __init__(self, field: WordField):
        import regex

        self.field = field
        self.find = regex.compile(r"\p{L}+|\n").findall
        self.memo: dict[str, int] = {}
        self.table = np.zeros((0, len(field.labels)))

    def words(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """All words and line ends of all texts, and how many each text has."""
        each = [self.find(t.lower()) for t in texts]
        return [w for x in each for w in x], np.fromiter(map(len, each), np.int64, len(each))

    def posteriors(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(words, posteriors of each, text of each)."""
        flat, n = self.words(texts)
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        if "\n" not in self.memo:
            self.memo["\n"] = 0
            self.table = np.zeros((1, len(self.field.labels)))
        new = [w for w in dict.fromkeys(flat) if w not in self.memo]
        if new:
            self.memo.update(zip(new, range(len(self.table), len(self.table) + len(new))))
            self.table = np.concatenate([self.table, *[self.field.emissions(new[k : k + NEW_WORDS]) for k in range(0, len(new), NEW_WORDS)]])
        ids = np.fromiter(map(self.memo.__getitem__, flat), np.int64, len(flat))
        text = np.repeat(np.arange(len(texts)), n)
        real = ids > 0
        line = np.cumsum(~real) + text  # a new run at each line end and each text: both only grow
        ids, text, line = ids[real], text[real], line[real]
        runs = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(ids) else np.zeros(0, np.int64)
        first, size = chains_of(np.diff(np.append(runs, len(ids))))
        post, _ = forward_backward(self.table[ids], self.field.transition, first, size)
        return [w for w, r in zip(flat, real) if r] if len(flat) else [], post, text

    def languages(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Label and score of each text; texts without letters: UNKNOWN and 0."""
        labels: list[str] = []
        scores: list[float] = []
        first = size = 0
        for k, t in enumerate(texts):
            size += len(t)
            if size >= AT_ONCE or k == len(texts) - 1:
                got = self._languages(texts[first : k + 1])
                labels += got[0]
                scores += got[1]
                first, size = k + 1, 0
        return labels, scores

    def _languages(self, texts: list[str]) -> tuple[list[str], list[float]]:
        _, post, text = self.posteriors(texts)
        total = np.stack([np.bincount(text, post[:, y], minlength=len(texts)) for y in range(post.shape[1])], axis=1) if post.shape[1] else np.zeros((len(texts), 0))
        n = np.bincount(text, minlength=len(texts))
        best = np.argmax(total, axis=1) if total.shape[1] else np.zeros(len(texts), np.int64)
        return [self.field.labels[b] if c else UNKNOWN for b, c in zip(best, n)], [min(1.0, float(total[i, b] / c)) if c else 0.0 for i, (b, c) in enumerate(zip(best, n))]


def held_out(doc_id):
    """Documents that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame) -> WordField | None:
    """Learns from text and lang of a bounded sample of the documents that aren't held out; None if no such row has words.

    First the doc_ids alone are read to find the hash below which FIT_DOCS lie, then the pieces of those.
    """
    import regex

    order = F.xxhash64("doc_id", F.lit("fit"))
    able = F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    top = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(order.alias("h")).orderBy("h").limit(FIT_DOCS).agg(F.max("h")).first()[0]
    if top is None:
        return None
    pieces = F.regexp_extract_all("text", F.lit(rf"[^\n]{{1,{PIECE_CHARS}}}\b|[^\n]{{1,{PIECE_CHARS}}}"), F.lit(0))
    some = docs.where(able & (order <= top)).select("lang", "doc_id", F.explode(pieces).alias("piece")).select("lang", "piece", F.xxhash64("doc_id", "piece").alias("h"))
    rows = some.orderBy("h", "lang", "piece").limit(FIT_PIECES).collect()
    find = regex.compile(r"\p{L}+").findall
    chains = [(r[0], w) for r in rows if (w := find(r[1].lower()))]
    return WordField.fit(chains) if chains else None


def predict(spark: SparkSession, docs: DataFrame, keep=None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of ``docs`` (doc_id, text, lang; more columns are not read).

    lang serves to learn only. Null or letterless text is UNKNOWN with score 0; so is every text if there is nothing to
    learn from. Rows with equal or null doc_id give a row each; a null one is neither held out nor learned from. With
    ``keep`` (columns) those come instead of doc_id and held_out.
    """
    common.bounded_batches(spark)
    field = train(docs)

    def run(batches):
        import pyarrow as pa

        common.let_go()
        own = Labeller(field) if field else None
        for b in batches:
            texts = [(x or b"").decode("utf-8", "replace") for x in b.column(0).to_pylist()]
            label, score = own.languages(texts) if own else ([UNKNOWN] * len(texts), [0.0] * len(texts))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(label, pa.string()), pa.array(score, pa.float64())], [*b.schema.names[1:], "lang_pred", "score"])

    kept = keep or [F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out")]
    inner = docs.select(F.col("text").cast("binary").alias("__text"), *kept)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields[1:])
    return inner.mapInArrow(run, f"{schema}, lang_pred string, score double")


def keep_known(spark: SparkSession, docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` whose language is known with at least this score, all their columns unchanged."""
    return predict(spark, docs, keep=[F.struct("*").alias("__row")]).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("__row.*")
