"""A rule-driven graph automaton: synchronous ticks of messages, sums and rules over DataFrames.

A tick is one join of the adjacency with the neighbours' states, one aggregation wide enough for all rules, one left join
and one chain of columns. Rules give a struct (activation, payload, changed) or null to skip; the first that gives one in
priority order wins.

Ticks are semi-naive. A rule reads a node's state and its neighbours', so a node whose state and whose neighbours' states the
last tick left alone does in this tick what it did in the last: it is carried over, with what it did, and only nodes at or next
to a change are joined, summed and asked.

What a node's neighbours sum up to stays in the table of states. Where most nodes change in each tick, a node is still not summed
again while it is held: activations end at 1, so with a neighbour at 1 its maximum is 1 whatever the others do. Held nodes are
asked with what they had; their edges are left out of the adjacency that ticks join, until some node leaves 1. Once few nodes are
not held, a run folds its table: until a node leaves 1, held nodes of one state and the same messages go on alike, so that one row
stands for all of them, and a tick joins and writes these rows and the other nodes only.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import CONTAINS, Graph
from .tables import cut, free, in_buckets, laid_out, size_of, summed

STATE = ("id", "activation", "payload", "changed", "stability")
PAYLOAD = "struct<neighbor_count:bigint,import_count:bigint,complexity:double>"


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def outcome(activation: Column, payload: Column | None = None, changed: Column | None = None) -> Column:
    """What a rule gives: the new activation, clamped, and the payload and flag it leaves or sets."""
    return F.struct(clamp(activation).alias("activation"), (F.col("payload") if payload is None else payload).alias("payload"), (F.col("changed") if changed is None else changed).alias("changed"))


class Rule(ABC):
    """guard says where the rule applies, apply gives its outcome or null; both may use the state and message columns."""

    id: str = "rule"
    priority: int = 0
    #: The messages that guard and apply use; None: it may be any.
    reads: tuple[str, ...] | None = None
    #: Whether it goes by the state and the messages alone, not by the id: it does the same to all nodes that are alike in these.
    alike: bool = False

    def guard(self) -> Column:
        return F.lit(True)

    @abstractmethod
    def apply(self) -> Column: ...


class NoOp(Rule):
    """A transition to the same state."""

    id, reads = "noop", ()
    alike = True

    def apply(self) -> Column:
        return outcome(F.col("activation"))


class Composite(Rule):
    """The first outcome among guarded rules, by priority."""

    def __init__(self, rules: list[Rule], id: str = "composite", priority: int = 0):
        self.rules, self.id, self.priority = sorted(rules, key=lambda r: -r.priority), id, priority

    def apply(self) -> Column:
        return F.coalesce(*[F.when(r.guard(), r.apply()) for r in self.rules])


class Delegate(Rule):
    """Hands over to another rule of the registry where its condition holds; that one's skip is a skip."""

    def __init__(self, condition: Column, to: Rule, id: str = "delegate", priority: int = 0):
        self.condition, self.to, self.id, self.priority = condition, to, id, priority

    def guard(self) -> Column:
        return self.condition

    def apply(self) -> Column:
        return self.to.apply()


class ImportPropagation(Rule):
    id, priority, reads = "import_propagation", 10, ("max_all", "max_linked")
    alike = True

    def __init__(self, factor: float = 0.3, threshold: float = 0.1, decay: float = 0.8):
        self.factor, self.threshold, self.decay = factor, threshold, decay

    def guard(self) -> Column:
        return F.coalesce(F.col("max_all") >= self.threshold, F.lit(False))

    def apply(self) -> Column:
        new = F.least(F.lit(1.0), F.col("activation") * 0.7 + F.coalesce("max_linked", F.lit(0.0)) * self.factor * self.decay * 0.3)
        return F.when(F.abs(new - F.col("activation")) >= 0.001, outcome(new))


class ModuleActivation(Rule):
    id, priority, reads = "module_activation", 5, ("n_contains", "max_contains", "avg_contains")
    alike = True

    def __init__(self, weight: float = 0.5):
        self.weight = weight

    def guard(self) -> Column:
        return F.coalesce(F.col("n_contains") > 0, F.lit(False))

    def apply(self) -> Column:
        mix = 0.6 * F.col("max_contains") + 0.4 * F.col("avg_contains")
        new = F.least(F.lit(1.0), F.col("activation") * (1 - self.weight) + mix * self.weight)
        return F.when(F.abs(new - F.col("activation")) >= 0.001, outcome(new))


class ChangeProximity(Rule):
    id, priority, reads = "change_proximity", 15, ("near_changed",)
    alike = True

    def __init__(self, boost: float = 0.5, neighbor_boost: float = 0.2):
        self.boost, self.neighbor_boost = boost, neighbor_boost

    def guard(self) -> Column:
        return F.col("changed") | F.coalesce(F.col("near_changed"), F.lit(False))

    def apply(self) -> Column:
        more = F.when(F.col("changed"), self.boost).otherwise(F.when(F.coalesce(F.col("near_changed"), F.lit(False)), self.neighbor_boost).otherwise(0.0))
        return outcome(F.col("activation") + more)


class ComplexityTracking(Rule):
    id, priority, reads = "complexity", 0, ("n_all", "n_imports")
    alike = True

    def apply(self) -> Column:
        n, i = F.coalesce("n_all", F.lit(0)), F.coalesce("n_imports", F.lit(0))
        new = F.struct(n.cast("long").alias("neighbor_count"), i.cast("long").alias("import_count"), F.least(F.lit(1.0), 0.1 * n + 0.2 * i).alias("complexity"))
        return F.when(~F.col("payload").eqNullSafe(new), outcome(F.col("activation"), payload=new))


class DampedPropagation(Rule):
    id, priority, reads = "damped_propagation", 10, ("max_all", "max_linked")
    alike = True

    def __init__(self, damping: float = 0.5, share: float = 0.25):
        self.damping, self.share = damping, share

    def guard(self) -> Column:
        return (F.col("activation") > 0.01) | F.coalesce(F.col("max_all") > 0.01, F.lit(False))

    def apply(self) -> Column:
        delta = (self.share * F.coalesce("max_linked", F.lit(0.0)) - F.col("activation")) * (1 - F.col("stability") * self.damping)
        new = clamp(F.col("activation") + delta)
        return F.when(F.abs(new - F.col("activation")) >= 0.005, outcome(new))


class Life(Rule):
    """Born with 3 live neighbours, alive with 2 or 3; skips where nothing changes."""

    id = "life"

    def apply(self) -> Column:
        alive, n = F.col("activation") >= 0.5, F.coalesce("n_alive", F.lit(0))
        lives = (n == 3) | (alive & (n == 2))
        return F.when(lives != alive, outcome(F.when(lives, 1.0).otherwise(0.0)))


class Registry:
    """Rules by id; a new one of the same id replaces the old. Equal priorities: in the order registered."""

    def __init__(self, *rules: Rule):
        self.rules: dict[str, Rule] = {}
        for r in rules:
            self.register(r)

    def register(self, rule: Rule) -> "Registry":
        self.rules[rule.id] = rule
        return self

    def get(self, id: str) -> Rule:
        if id not in self.rules:
            raise KeyError(f"no such rule: {id}")
        return self.rules[id]

    def by_priority(self) -> list[Rule]:
        return sorted(self.rules.values(), key=lambda r: -r.priority)


def default_rules() -> Registry:
    return Registry(ChangeProximity(), ImportPropagation(), ModuleActivation())


def description_rules(damping: float = 0.5) -> Registry:
    """With stabilities: damped before import, as equal priorities go by registration here."""
    return Registry(ChangeProximity(), DampedPropagation(damping), ImportPropagation(), ModuleActivation(), ComplexityTracking())


def initial_state(nodes: DataFrame, activation: Column | float = 0.0, changed: Column | bool = False, stability: Column | float = 0.0) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return nodes.select("id", clamp(lit(activation).cast("double")).alias("activation"), F.lit(None).cast(PAYLOAD).alias("payload"), lit(changed).alias("changed"), lit(stability).cast("double").alias("stability"))


def seeded(state: DataFrame, condition: Column, activation: float) -> DataFrame:
    """Activates the nodes that meet a condition; a later seed wins."""
    return state.withColumn("activation", F.when(condition, F.lit(activation)).otherwise(F.col("activation")))


#: The columns of ``messages``, by session: making columns takes longer than a tick over few rows.
_SUMS: WeakKeyDictionary = WeakKeyDictionary()


def messages(adjacency: DataFrame, state: DataFrame) -> DataFrame:
    """For each node what all rules need of its distinct neighbours: one shuffle for the join, one for the sum."""
    if state.sparkSession not in _SUMS:
        linked, inside = F.col("relationship").isin("uses", "imports", CONTAINS), F.col("relationship") == CONTAINS
        _SUMS[state.sparkSession] = (F.col("id").alias("peer"), F.col("activation").alias("a"), F.col("changed").alias("c")), (
            F.max("a").alias("max_all"), F.avg("a").alias("avg_all"), F.count(F.lit(1)).alias("n_all"), F.max(F.when(linked, F.col("a"))).alias("max_linked"), F.max(F.when(inside, F.col("a"))).alias("max_contains"),
            F.avg(F.when(inside, F.col("a"))).alias("avg_contains"), F.count_if(inside).alias("n_contains"), F.count_if(F.col("relationship").isin("uses", "imports")).alias("n_imports"), F.count_if(F.col("a") >= 0.5).alias("n_alive"), F.max("c").alias("near_changed"), F.min(F.when(inside, F.col("a"))).alias("min_contains"),
        )
    peers, sums = _SUMS[state.sparkSession]
    return adjacency.join(state.select(*peers), "peer").groupBy("id").agg(*sums)


def evaluate(state: DataFrame, adjacency: DataFrame, rules: list[Rule]) -> DataFrame:
    """state with ``outcome`` (null: all skipped), ``fired`` (the rule that gave it) and ``guarded`` (the first whose guard held)."""
    joined = state.join(messages(adjacency, state), "id", "left")
    arms = [F.when(r.guard(), r.apply()) for r in rules]
    out = joined.withColumn("outcome", F.coalesce(*arms))
    fired = F.coalesce(*[F.when(r.guard() & r.apply().isNotNull(), F.lit(r.id)) for r in rules])
    guarded = F.coalesce(*[F.when(r.guard(), F.lit(r.id)) for r in rules])
    return out.withColumn("fired", fired).withColumn("guarded", guarded)


def applied(evaluated: DataFrame) -> DataFrame:
    keep = lambda c: F.when(F.col("outcome").isNotNull(), F.col("outcome")[c]).otherwise(F.col(c)).alias(c)
    return evaluated.select("id", keep("activation"), keep("payload"), keep("changed"), "stability")


def tick(state: DataFrame, adjacency: DataFrame, rules: Registry | list[Rule]) -> DataFrame:
    """One synchronous step: all rules read the old state."""
    return applied(evaluate(state, adjacency, rules.by_priority() if isinstance(rules, Registry) else rules))


def apply_rule(state: DataFrame, adjacency: DataFrame, rules: Registry, id: str) -> DataFrame:
    """One step of one rule, its guard ignored."""
    rule = rules.get(id)
    joined = state.join(messages(adjacency, state), "id", "left")
    return applied(joined.withColumn("outcome", rule.apply()))


@dataclass
class Tick:
    tick: int
    transitions: int
    skipped: int
    avg_activation: float
    errors: int = 0

    @property
    def rate(self) -> float:
        done = self.transitions + self.skipped
        return self.transitions / done if done else 0.0

    @property
    def had_transitions(self) -> bool:
        return self.transitions > 0


def quiet(history: list[Tick], window: int = 3, rate: float = 0.01) -> bool:
    """The last ``window`` ticks each had few transitions."""
    return len(history) >= window and all(t.rate < rate for t in history[-window:])


def converged(history: list[Tick], window: int = 5, variance: float = 0.001) -> bool:
    """The mean activation of the last ``window`` ticks hardly varies."""
    last = [t.avg_activation for t in history[-window:]]
    if len(last) < window:
        return False
    mean = sum(last) / window
    return sum((x - mean) ** 2 for x in last) / window < variance


def adjacency_by(g: Graph, by: str, near: str | None = None) -> DataFrame:
    """A graph's adjacency, ``laid_out``; its pairs are summed and written once, half as many rows."""
    pairs = cut(g.pairs())
    out = laid_out(g.adjacency(pairs), by, near, 2 * size_of(pairs))
    free(pairs)
    return out


#: Where more than one node in so many changed, the next tick asks all nodes: finding the neighbours would cost more than it saves.
DENSE = 8
#: What ``messages`` gives; of these, what a change below 1 may alter in spite of a neighbour at 1, and what follows from the edges and ``changed``.
MESSAGES = ("max_all", "avg_all", "n_all", "max_linked", "max_contains", "avg_contains", "n_contains", "n_imports", "n_alive", "near_changed", "min_contains")
LOOSE, FIXED = ("avg_all", "n_alive"), ("n_all", "n_contains", "n_imports", "near_changed")
#: The edges of nodes that aren't held are written anew once they are at most this share of those that ticks join.
OPEN = 0.5
#: Ticks that must be left for a run to fold its table, where at most one edge in DENSE is of a node not held.
FOLD = 4


def kept_messages(rules: list[Rule]) -> list[str]:
    """The messages that stay in the table of states; none if a rule reads what a neighbour at 1 doesn't settle."""
    read = {c for r in rules for c in (LOOSE if r.reads is None else r.reads)}
    inside = {"n_contains", "min_contains"} if read & {"max_contains", "avg_contains", "min_contains"} else set()
    return [] if read & set(LOOSE) else sorted(read | inside | {"max_all", "max_linked", "n_all"})


def first_outcome(rules: list[Rule]) -> Column:
    return F.coalesce(*[F.when(r.guard(), r.apply()) for r in rules]) if rules else F.lit(None).cast(f"struct<activation:double,payload:{PAYLOAD},changed:boolean>")


def changes() -> tuple[list[Column], Column, Column]:
    """Of rows with ``outcome``: the state after it, whether that is another one, and whether a node left 1 or its flag changed."""
    after = [F.when(F.col("outcome").isNotNull(), F.col("outcome")[c]).otherwise(F.col(c)) for c in STATE[1:4]]
    same = [a.eqNullSafe(F.col(c)) for a, c in zip(after, STATE[1:4])]
    turned = ~same[2] | (~same[0] & F.coalesce((F.col("activation") >= 1) | (after[0] > 1) | F.col("activation").isNull(), F.lit(False)))
    return [a.alias(c) for a, c in zip(after, STATE[1:4])], ~(same[0] & same[1] & same[2]), turned


def at_top(kept: list[str]) -> Column:
    """At 1 and not above, with a neighbour there; all it contains too, where their mean is read."""
    inside = (F.col("n_contains") == 0) | (F.col("min_contains") == 1) if "min_contains" in kept else F.lit(True)
    return F.coalesce((F.col("max_all") == 1) & (F.col("max_linked") == 1) & inside, F.lit(False))


def alike(rows: DataFrame, classes: DataFrame, key: list[str]) -> DataFrame:
    """Rows with the other columns of the class that is like them in ``key``, nulls like nulls."""
    named = classes.withColumnsRenamed({c: f"class_{c}" for c in key})
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"class_{c}"))
    return rows.join(named, same).drop(*[f"class_{c}" for c in key])


@dataclass
class Automaton:
    """Runs ticks over a graph; each tick's states are a table of their own, and one small sum a tick reaches the driver.

    ``state`` is good until the step after the next one: older tables are taken away. A new ``state`` or other rules may be set
    at any time; the next tick then asks all nodes.
    """

    graph: Graph
    rules: Registry
    state: DataFrame
    min_ticks: int = 3
    max_ticks: int = 30
    stable: Callable[[list[Tick]], bool] = quiet
    history: list[Tick] = field(default_factory=list)

    def __post_init__(self):
        # What the last tick left: its table with marks, how many nodes changed, by which rules, and the state it gave.
        self._table, self._fresh, self._by, self._gave, self._spent = None, 0, [], None, None
        # Edges of nodes not held when they were written, about how many ticks join and need; ticks since a node left 1, and how many to await.
        self._open, self._joined, self._needed, self._calm, self._await = None, 0, 0, 0, 1
        # All edges, and whether held nodes were found to be in few states.
        self._edges, self._folds = 0, True
        # The columns of a tick, for the rules and kind of tick that they were made for.
        self._made_for, self._made = None, None

    @cached_property
    def adjacency(self) -> DataFrame:
        """The graph's, laid out when a tick or a caller first needs it."""
        return adjacency_by(self.graph, "peer", "id")

    @classmethod
    def fast(cls, *a, **k) -> "Automaton":
        return cls(*a, **({"max_ticks": 10} | k))

    @classmethod
    def thorough(cls, *a, **k) -> "Automaton":
        return cls(*a, **({"max_ticks": 500, "min_ticks": 20} | k))

    def step(self, rule: Rule | None = None) -> Tick:
        rules = [rule] if rule else self.rules.by_priority()
        known = self._known(rules)
        if known and not self._fresh:
            # Nothing changed: every node does the same again.
            last = self.history[-1] if self.history else self._last
            self._last = Tick(len(self.history) + 1, last.transitions, last.skipped, last.avg_activation)
            self.history.append(self._last)
            return self._last
        # States lie as the adjacency does, so that both sides of a tick's joins are dealt out alike.
        by = "id" if in_buckets(self.adjacency) else None
        before = self._table if known else cut(self.state.select(*STATE).withColumns({"moved": F.lit(False), "fresh": F.lit(True)}), by)
        held = known and self._calm > 0
        self._leave_out_held(before, held)
        done, sums, near = self._ask(before, rules, by, only_near=known and self._fresh * DENSE <= self._last.transitions + self._last.skipped, held=held)
        free(self._spent, near, None if known else self._table)
        self._spent, self._table, self._by = before, done, rules
        self._joined = self._joined if self._open else sums.edges
        self.state = self._gave = done.select(*STATE)
        return self._note(sums)

    def _known(self, rules: list[Rule]) -> bool:
        """Whether the last tick was of these rules and its states are those at hand."""
        return self._table is not None and self.state is self._gave and len(rules) == len(self._by) and all(a is b for a, b in zip(rules, self._by))

    def _advance(self, most: int, enough: Callable[[list[Tick]], bool]) -> bool:
        """A tick or more, at most ``most``; whether the history is enough after the last."""
        rules = self.rules.by_priority()
        if most >= FOLD and self._folds and self._known(rules) and self._fresh and self._calm and kept_messages(rules) and all(r.alike for r in rules) and self._needed * DENSE <= self._edges:
            self._leave_out_held(self._table, True)
            if self._open:
                before = len(self.history)
                done = self._folded(rules, most, enough)
                if len(self.history) > before:
                    return done
        self.step()
        return enough(self.history)

    def _folded(self, rules: list[Rule], most: int, enough: Callable[[list[Tick]], bool]) -> bool:
        """Ticks over a folded table, up to the first after which the history is enough, a node left 1 or changed its flag, or no
        state changed; the table is unfolded then."""
        before, by = self._table, "id" if in_buckets(self.adjacency) else None
        key = [*STATE[1:], *[f"was_{c}" for c in kept_messages(rules)]]
        held, others = before.where("held"), before.where("NOT held")
        classes = held.groupBy(*key).agg(F.count(F.lit(1)).alias("weight")).withColumns({"of": F.lit(None).cast(before.schema["id"].dataType), "held": F.lit(True)})
        first = classes.unionByName(others.select(*key, F.lit(1).cast("long").alias("weight"), F.col("id").alias("of"), "held")).withColumn("id", F.monotonically_increasing_id())
        first, sums = summed(first.withColumns({"moved": F.lit(False)}), F.count(F.lit(1)).alias("rows"), F.sum("weight").alias("n"))
        if sums.rows * DENSE > sums.n:
            free(first)
            self._folds = False
            return False
        # The places of others and of their neighbours in the folded table.
        own = first.where("of IS NOT NULL").select("of", F.col("id").alias("to"))
        edges = self._open.join(own.select(F.col("of").alias("id"), F.col("to").alias("from")), "id")
        near = held.join(edges.select(F.col("peer").alias("id")), "id", "left_semi")
        places = alike(near, first.where("of IS NULL").select(*key, F.col("id").alias("to")), key).select(F.col("id").alias("peer"), "to").unionByName(own.withColumnRenamed("of", "peer"))
        edges = cut(edges.join(places, "peer").select(F.col("from").alias("id"), F.col("to").alias("peer"), "relationship"))
        table, ends, begun = first, False, len(self.history)
        while not ends and len(self.history) - begun < most:
            older = table
            table, sums, _ = self._ask(older, rules, None, only_near=False, held=True, adjacency=edges)
            if older is not first:
                free(older)
            self._note(sums)
            ends = enough(self.history)
            if sums.turned or not sums.fresh:
                break
        # All by their first state, as they are after the last tick.
        columns = [c for c in before.columns if c not in ("id", "stability")]
        after = first.where("of IS NULL").select("id", *key).join(table.select("id", *[F.col(c).alias(f"now_{c}") for c in columns]), "id").drop("id")
        back = alike(held.select("id", *key), after, key).select("id", "stability", *[F.col(f"now_{c}").alias(c) for c in columns])
        back = back.unionByName(table.where("of IS NOT NULL").select(F.col("of").alias("id"), "stability", *columns))
        done = cut(back.select(*before.columns), by)
        free(edges, first, table, self._spent)
        self._spent, self._table = before, done
        self.state = self._gave = done.select(*STATE)
        return ends

    def _note(self, sums) -> Tick:
        """Takes in what a tick's sums say."""
        self._fresh, self._needed, self._edges, self._calm = sums.fresh, sums.open, sums.edges, 0 if sums.turned else self._calm + 1
        self._last = Tick(len(self.history) + 1, sums.moved, sums.n - sums.moved, sums.mean)
        self.history.append(self._last)
        return self._last

    def _leave_out_held(self, before: DataFrame, held: bool) -> None:
        """Writes the edges that are still summed, where they have become few; takes them away when they are no longer all."""
        if not held:
            if self._open:
                self._await *= 2  # nodes leave 1 now and then: leaving edges out must pay for longer
            free(self._open)
            self._open = None
        elif self._calm >= self._await and self._needed <= OPEN * self._joined and self._needed < self._joined:
            older = self._open
            ids, by = before.where("NOT held").select("id"), "peer" if in_buckets(self.adjacency) else None
            self._open = cut((older or self.adjacency).join(ids, "id", "left_semi").select("id", "peer", "relationship"), by)
            free(older)
            self._joined = self._needed

    def _ask(self, before: DataFrame, rules: list[Rule], by: str | None, only_near: bool, held: bool = False, adjacency: DataFrame | None = None):
        """The table after a tick over ``before``, sums over it, and the table of the nodes asked if those were some only.
        ``held``: no node left 1 or changed its flag in the last tick, so that what ``before`` holds is still true.
        ``adjacency``: of a folded table, whose rows count by their weight."""
        folded, near = adjacency is not None, None
        adjacency = adjacency if folded else self._open or self.adjacency
        if only_near:
            fresh = before.where("fresh").select("id")
            reached = adjacency.join(fresh.withColumnRenamed("id", "peer"), "peer", "left_semi").select("id")
            near = cut(fresh.unionByName(reached).distinct())
            adjacency = adjacency.join(near, "id", "left_semi")
        joined = before.join(messages(adjacency, before), "id", "left")
        if near is not None:
            joined = joined.join(near.withColumn("near", F.lit(True)), "id", "left")
        kind = (near is not None, held, folded, "held" in before.columns)
        if self._made is None or self._made_for[1] != kind or len(self._made_for[0]) != len(rules) or any(a is not b for a, b in zip(self._made_for[0], rules)):
            self._made_for, self._made = (rules, kind), self._columns(rules, *kind)
        own, outcome, done, sums = self._made
        own = own or [c for c in joined.columns if c not in before.columns[5:] or c == "moved"]  # what a rule may read unsaid
        table, sums = summed(joined.select(*own).select("*", outcome).select(*done), *sums, by=by)
        return table, sums, near

    def _columns(self, rules: list[Rule], near: bool, held: bool, folded: bool, marked: bool) -> tuple:
        """What a tick selects: the state and the messages (none: all there are), the outcome, the table after it; and its sums."""
        kept, asked, extra = kept_messages(rules), F.col("near").isNotNull() if near else F.lit(True), ["of", "weight"] if folded else []
        own = []
        if kept:
            anew = asked & ~F.col("held") if held else asked
            own = [*STATE, "moved", *extra, *(["near"] if near else [])]  # what a rule reads unsaid is missed, not stale
            own += [F.col(f"was_{c}").alias(c) if held and c in FIXED else F.when(anew, F.col(c)).otherwise(F.col(f"was_{c}")).alias(c) for c in kept] if marked else kept
        after, fresh, turned = changes()
        moved = F.when(asked, F.col("outcome").isNotNull()).otherwise(F.col("moved"))
        marks, weight = {"moved": moved, "fresh": fresh}, F.col("weight") if folded else F.lit(1)
        some = lambda c, n: F.coalesce(F.sum(F.when(c, n)), F.lit(0))
        sums = [F.lit(0).alias("open"), F.lit(0).alias("edges"), F.lit(1).alias("turned")]
        if kept:
            marks |= {f"was_{c}": F.col(c) for c in kept} | {"held": at_top(kept), "turned": turned}
            ends = weight * F.col("was_n_all")
            sums = [some(~F.col("held"), ends).alias("open"), some(F.lit(True), ends).alias("edges"), F.count_if("turned").alias("turned")]
        mean = F.sum(weight * F.col("activation")) / F.sum(F.when(F.col("activation").isNotNull(), weight)) if folded else F.avg("activation")
        n = F.sum(weight) if folded else F.count(F.lit(1))
        sums = [n.alias("n"), some(F.col("moved"), weight).alias("moved"), some(F.col("fresh"), weight).alias("fresh"), F.coalesce(mean, F.lit(0.0)).alias("mean"), *sums]
        return own, F.when(asked, first_outcome(rules)).alias("outcome"), ["id", *after, "stability", *[c.alias(n) for n, c in marks.items()], *extra], sums

    def run(self) -> "Automaton":
        """Until stable after min_ticks, max_ticks at most."""
        while len(self.history) < self.max_ticks and not self._advance(self.max_ticks - len(self.history), lambda h: len(h) >= self.min_ticks and self.stable(h)):
            pass
        return self

    def run_ticks(self, n: int) -> "Automaton":
        end = len(self.history) + n
        while len(self.history) < end:
            self._advance(end - len(self.history), lambda h: False)
        return self

    def run_until_still(self, most: int) -> bool:
        """Until a tick without transitions, ``most`` at most; whether it ended before."""
        end = len(self.history) + most
        while len(self.history) < end:
            if self._advance(end - len(self.history), lambda h: not h[-1].had_transitions):
                return len(self.history) < end
        return False

    def reset(self) -> "Automaton":
        """Counters anew, states kept."""
        self.history = []
        return self

    def ticks(self) -> DataFrame:
        rows = [(t.tick, t.transitions, t.skipped, t.errors, t.avg_activation) for t in self.history]
        return self.state.sparkSession.createDataFrame(rows, "tick int, transitions long, skipped long, errors long, avg_activation double")


def marked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` with ``mine``: whether their id is among ``ids`` (id)."""
    mark = ids.select("id", F.lit(True).alias("mine")).distinct()
    return rows.join(mark, "id", "left").withColumn("mine", F.coalesce("mine", F.lit(False)))


def change_explorer(g: Graph, changed: DataFrame) -> Automaton:
    """Seeds: the nodes of ``changed`` (id), active and changed."""
    nodes, mine = marked(g.nodes.select("id"), changed), F.col("mine")
    return Automaton(g, default_rules(), initial_state(nodes, F.when(mine, 1.0).otherwise(0.0), mine), max_ticks=20)


def impact_analyzer(g: Graph, start: DataFrame) -> Automaton:
    """Seeds: the nodes of ``start`` (id), active."""
    nodes = marked(g.nodes.select("id"), start)
    return Automaton(g, Registry(ImportPropagation(0.5, 0.05, 0.9), ModuleActivation()), initial_state(nodes, F.when(F.col("mine"), 1.0).otherwise(0.0)), max_ticks=50)


def with_description(g: Graph, config: DataFrame, changed: DataFrame, damping: float = 0.5) -> Automaton:
    """Seeds: changed ids 1, others a twentieth of their stability; config: id, stability."""
    nodes = marked(g.nodes.select("id").join(config.select("id", "stability"), "id", "left"), changed).withColumn("stability", F.coalesce("stability", F.lit(0.0)))
    return Automaton(g, description_rules(damping), initial_state(nodes, F.when(F.col("mine"), 1.0).otherwise(F.col("stability") * 0.05), F.col("mine"), F.col("stability")))


def transition_rate() -> Column:
    return F.coalesce(F.try_divide(F.col("transitions"), F.col("transitions") + F.col("skipped")), F.lit(0.0))


def stability_marks(ticks: DataFrame) -> DataFrame:
    """tick, rate, quiet, converged at each tick of a history; the history of one run is small."""
    order = Window.orderBy("tick")
    r = ticks.withColumn("rate", transition_rate())
    quiet_ = (F.count(F.lit(1)).over(order.rowsBetween(-2, 0)) == 3) & (F.max("rate").over(order.rowsBetween(-2, 0)) < 0.01)
    still = (F.count(F.lit(1)).over(order.rowsBetween(-4, 0)) == 5) & (F.var_pop("avg_activation").over(order.rowsBetween(-4, 0)) < 0.001)
    return r.select("tick", "rate", quiet_.alias("quiet"), still.alias("converged"))


def last_transitions(transitions: DataFrame, window: int) -> DataFrame:
    """The last ``window`` transitions of each node (1 at least)."""
    order = Window.partitionBy("id").orderBy(F.desc("seq"))
    return transitions.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= max(1, window)).drop("__n")


def activation_trend(transitions: DataFrame, window: int) -> DataFrame:
    """avg, min and max activation over the last ``window`` transitions and the current one."""
    return last_transitions(transitions, window + 1).groupBy("id").agg(F.avg("activation").alias("avg"), F.min("activation").alias("min"), F.max("activation").alias("max"))


def temporal_stats(g: Graph, state: DataFrame, transitions: DataFrame) -> DataFrame:
    """One row: node and edge counts, transitions (one more than applied for each node), mean activation, evolved nodes."""
    seq = transitions.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    per = state.select("id", "activation").join(seq, "id", "left").select("activation", (F.coalesce("n", F.lit(0)) + 1).alias("next"))
    nodes = per.agg(F.count(F.lit(1)).alias("nodes"), F.sum("next").alias("transitions"), F.avg("activation").alias("avg_activation"), F.count_if(F.col("next") > 1).alias("evolved"))
    return nodes.join(F.broadcast(g.edges.agg(F.count(F.lit(1)).alias("edges"))))


def top_activated(state: DataFrame, n: int) -> DataFrame:
    return state.orderBy(F.desc("activation"), "id").limit(n)


def hot(state: DataFrame, threshold: float) -> DataFrame:
    return state.where(F.col("activation") >= threshold)


def active_neighbors(adjacency: DataFrame, state: DataFrame, threshold: float) -> DataFrame:
    return adjacency.join(hot(state, threshold).select(F.col("id").alias("peer"), "activation"), "peer").select("id", "peer", "activation")


def neighbor_means(adjacency: DataFrame, state: DataFrame) -> DataFrame:
    """Mean activation over distinct neighbours, 0 for none."""
    peers = state.select(F.col("id").alias("peer"), F.col("activation").alias("a"))
    means = adjacency.select("id", "peer").distinct().join(peers, "peer").groupBy("id").agg(F.avg("a").alias("a"))
    return state.select("id").join(means, "id", "left").select("id", F.coalesce("a", F.lit(0.0)).alias("avg_activation"))
