"""Samplers: what is computed for each selected node from its neighbourhood, and pipelines of them."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.scalars import annotate
from .graph import Graph
from .operators.automaton import adjacency_by
from .operators.degrees import degrees
from .operators.search import Selector
from .operators.tables import cut, free, laid_out
from .operators.vectors import hashed_embedding
from .session import ship


class Sampler(ABC):
    """compute gives (id, artifact: JSON) for some of the selected nodes; those without a row are skipped, an error ends the pass."""

    id: str = "sampler"

    def selector(self) -> Selector:
        return Selector.all()

    @abstractmethod
    def compute(self, g: Graph, selected: DataFrame, annotations: DataFrame | None) -> DataFrame: ...

    def sample(self, g: Graph, annotations: DataFrame | None = None) -> "Result":
        return Result(self.id, self.compute(g, self.selector().matches(g.nodes), annotations))


class Result:
    def __init__(self, sampler: str, artifacts: DataFrame):
        self.sampler, self.artifacts = sampler, artifacts

    def get(self, id: int) -> str | None:
        row = self.artifacts.where(F.col("id") == id).first()
        return row["artifact"] if row else None

    def __len__(self) -> int:
        return self.artifacts.count()

    def __iter__(self) -> Iterable:
        return self.artifacts.toLocalIterator()


class NoOpSampler(Sampler):
    id = "noop"

    def compute(self, g, selected, annotations):
        return selected.where(F.lit(False)).select("id", F.lit("").alias("artifact"))


class DegreeSampler(Sampler):
    """in, out and total; a loop counts once in each direction."""

    id = "degree"

    def selector(self):
        return Selector.by_kind("File")

    def compute(self, g, selected, annotations):
        d = degrees(g).join(selected.select("id"), "id", "left_semi")
        return d.select("id", F.to_json(F.struct(F.col("in_degree").alias("in"), F.col("out_degree").alias("out"), (F.col("in_degree") + F.col("out_degree")).alias("total"))).alias("artifact"))


class MetadataSampler(Sampler):
    """All metadata, or chosen keys; nodes without any are skipped."""

    id = "metadata"

    def __init__(self, keys: list[str] | None = None):
        self.keys = keys

    def compute(self, g, selected, annotations):
        m = F.col("metadata")
        own = F.map_filter(m, lambda k, v: k.isin(self.keys)) if self.keys is not None else m
        return selected.select("id", own.alias("m")).where(F.size("m") > 0).select("id", F.to_json("m").alias("artifact"))


class EmbeddingSampler(Sampler):
    """Vectors of File and Module nodes from their path, or from what an embedder (texts to vectors) makes of it in batches."""

    id = "embedding"

    def __init__(self, dim: int = 64, embed: Callable[[list[str]], list[list[float]]] | None = None):
        self.dim, self.embed = dim, embed

    def selector(self):
        return Selector.predicate(F.col("kind").isin("File", "Module"))

    def vectors(self, selected: DataFrame) -> DataFrame:
        text = F.concat_ws(" ", "kind", "path")
        if self.embed is None:
            return selected.select("id", hashed_embedding(text, self.dim).alias("embedding"))
        embed = self.embed
        ship(selected.sparkSession)

        def run(batches):
            for b in batches:
                yield b[["id"]].assign(embedding=embed(b["text"].tolist()))

        return selected.select("id", text.alias("text")).mapInPandas(run, "id long, embedding array<float>")

    def compute(self, g, selected, annotations):
        return self.vectors(selected).select("id", F.to_json(F.struct(F.lit("feature-hash" if self.embed is None else "custom").alias("model"), F.size("embedding").alias("dim"))).alias("artifact"))


class Pipeline:
    """Stages in order; each one's artifacts become annotations, by its id, for those after it."""

    def __init__(self, *stages: Sampler):
        self.stages = list(stages)

    def with_stage(self, stage: Sampler) -> "Pipeline":
        return Pipeline(*self.stages, stage)

    def run(self, g: Graph) -> DataFrame:
        """id and annotations (sampler to JSON) of every node."""
        notes = g.nodes.select("id", F.expr("cast(map() as map<string,string>)").alias("annotations"))
        for stage in self.stages:
            got = stage.sample(g, notes).artifacts.select("id", "artifact")
            merged = F.when(F.col("artifact").isNull(), F.col("annotations")).otherwise(annotate(F.col("annotations"), stage.id, F.col("artifact")))
            notes = notes.join(got, "id", "left").select("id", merged.alias("annotations"))
        return notes


UNREADABLE = "unreadable answer"


class ModelRule:
    """A rule backed by a model: prompts are rendered as JSON, answered in batches by ``client`` (prompts to texts), and parsed.

    States of nodes whose answer can't be read stay as they are, with the reason in ``feedback``.
    """

    def __init__(self, client: Callable[[list[str]], list[str]], instruction: str = ""):
        self.client, self.instruction = client, instruction

    def prompts(self, g: Graph, state: DataFrame) -> DataFrame:
        """id, prompt: own state and the neighbours' count and mean activation."""
        return self._prompts(g.adjacency(), state)

    def _prompts(self, adjacency: DataFrame, state: DataFrame, of_peers: DataFrame | None = None) -> DataFrame:
        peers = (state if of_peers is None else of_peers).select(F.col("id").alias("peer"), F.col("activation").alias("a"))
        near = adjacency.join(peers, "peer").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("a"), 6).alias("mean"))
        doc = F.to_json(F.struct(F.lit(self.instruction).alias("instruction"), F.struct("activation").alias("current"), F.struct("n", "mean").alias("neighbors")))
        return state.join(near, "id", "left").fillna({"n": 0, "mean": 0.0}).select("id", "activation", doc.alias("prompt"))

    def tick(self, g: Graph, state: DataFrame, workers: int = 8) -> DataFrame:
        """id, activation, feedback after all nodes were asked, ``workers`` tasks at a time; the answers apply together at the end."""
        return self._answers(self.prompts(g, state), workers)

    def _answers(self, prompts: DataFrame, workers: int) -> DataFrame:
        from .functions.scalars import scrub_response

        client = self.client
        ship(prompts.sparkSession)

        def run(batches):
            for b in batches:
                yield b[["id", "activation"]].assign(answer=client(b["prompt"].tolist()))

        answered = prompts.repartition(workers).mapInPandas(run, "id long, activation double, answer string")
        read = F.from_json(scrub_response(F.col("answer")), "activation double, feedback string")
        new = answered.withColumn("r", read)
        return new.select("id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("r.activation", "activation"))).alias("activation"), F.coalesce("r.feedback", F.when(F.col("r.activation").isNull(), F.lit(UNREADABLE))).alias("feedback"))


    def tick_in_turn(self, g: Graph, state: DataFrame) -> DataFrame:
        """As tick(), but node after node by id, each seeing the answers of those before it.

        A node waits only for its neighbours of a lower id, so all nodes that wait for none are asked together; what comes out
        is what asking one at a time gives. A round for each step of the longest chain of rising ids.
        """
        adjacency = adjacency_by(g, "id", "id")
        # Who waits for whom lies by the one waited for, and the neighbours by the one asked: rounds shuffle what they ask only.
        waits = laid_out(adjacency.where("peer < id").select("id", "peer"), "peer")
        current = state.select("id", "activation")
        waiting, done = cut(current.select("id")), None
        while not waiting.isEmpty():
            blocked = waits.join(waiting.select(F.col("id").alias("peer")), "peer", "left_semi").select("id").distinct()
            ready = cut(waiting.join(blocked, "id", "left_anti"))
            answered = cut(self._asked(adjacency, current, ready))
            done = answered if done is None else done.unionByName(answered)
            new = answered.select("id", F.col("activation").alias("new"))
            spent = (current, waiting, ready)
            current = cut(current.join(new, "id", "left").select("id", F.coalesce("new", "activation").alias("activation")))
            waiting = cut(waiting.join(ready, "id", "left_anti"))
            free(*spent)
        free(adjacency, waits, current, waiting)
        return done if done is not None else self.tick(g, state)

    def _asked(self, adjacency: DataFrame, state: DataFrame, only: DataFrame) -> DataFrame:
        """Answers of the nodes of ``only`` (id): none but their neighbours are joined."""
        near = adjacency.join(only, "id", "left_semi")
        return self._answers(self._prompts(near, state.join(only, "id", "left_semi"), state), 8)

    def run(self, g: Graph, state: DataFrame, most: int = 10, in_turn: bool = False) -> tuple[DataFrame, list[tuple[int, int]]]:
        """Ticks until one changes nothing and fails nowhere, ``most`` at most: the last answers and (transitions, errors) of each."""
        history, current, answers = [], state.select("id", "activation"), None
        for _ in range(most):
            spent = answers
            answers = cut(self.tick_in_turn(g, current) if in_turn else self.tick(g, current))
            old = current.select("id", F.col("activation").alias("old"))
            moved = F.count_if(F.col("activation") != F.col("old"))
            history.append(tuple(answers.join(old, "id").agg(moved, F.count_if(F.col("feedback") == UNREADABLE)).first()))
            current = answers.select("id", "activation")
            free(spent)
            if history[-1] == (0, 0):
                break
        return answers, history


def resolver_of(rows: DataFrame, order: str, n: int) -> DataFrame:
    """rows' ``order`` column with ``resolver``: n of them in turn, by a dense number in that order."""
    from .operators.layout import dense_ids

    dense = dense_ids(rows.select(F.col(order).alias("id")))
    return dense.select(F.col("id").alias(order), F.pmod("index", F.lit(n)).alias("resolver"))


class Constitution:
    """Conditions that a change must meet; none: every change is allowed."""

    def __init__(self, name: str, version: str = "1", policies: list[str] | None = None):
        self.name, self.version, self.policies, self.evaluators = name, version, policies or [], []

    def add_evaluator(self, condition) -> "Constitution":
        self.evaluators.append(condition)
        return self

    def allowed(self):
        out = F.lit(True)
        for c in self.evaluators:
            out = out & c
        return out
