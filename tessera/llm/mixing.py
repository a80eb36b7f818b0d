"""Mixing overlapping sources to target weights by min-cost flow.

A document may belong to several sources.  Documents are aggregated by membership pattern, the set of their sources; a
pattern can give its words once at no cost and again at a cost that grows with each repetition.  The cheapest flow from
patterns through their sources to the sources' targets says how many words each pattern gives: a number of whole passes
and a rest.  The rest is filled with whole documents in the order of a seeded hash: each that still fits is taken, until
none does.  Histograms of hash prefixes (PREFIX hex digits more at each level, a bounded number of rows for each pattern)
find where the order meets a document that doesn't fit; behind it the search goes on over those that do.  A pattern is
settled one by one on the driver once so few documents are left to look at that all such patterns have at most FEW.

What reaches the driver grows with the patterns, of which at most MAX_PATTERNS are taken, not with the documents.

Defined results: a null text has no words; a null source is a source of its own, the last in order; documents without
words take nothing; rows that are repeated are taken one by one, and any of them may be the one; a source without words
has target 0; reruns on the same rows agree; an empty table gives none.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field
from fractions import Fraction
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, columns_for, materialise

#: Patterns whose flow the driver solves, some hundred bytes each; more are an error, never left out.
MAX_PATTERNS = 1_000_000
PREFIX, KEY = 3, 32
FEW = 20_000


class Network:
    """Min-cost flow in whole numbers, by phases: shortest distances under potentials, then a blocking flow along all
    shortest paths at once.  Phases are as many as path lengths there are, which the few repetition costs keep small."""

    def __init__(self) -> None:
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []
        self.out: dict[int, list[int]] = {}

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        at = len(self.to)
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out.setdefault(x, []).append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return at

    def _distances(self, source: int, price: dict[int, int]) -> dict[int, int]:
        best, heap = {source: 0}, [(0, source)]
        while heap:
            d, x = heappop(heap)
            if d > best[x]:
                continue
            for e in self.out[x]:
                y, far = self.to[e], d + self.cost[e] + price[x] - price[self.to[e]]
                if self.room[e] > 0 and far < best.get(y, far + 1):
                    best[y] = far
                    heappush(heap, (far, y))
        return best

    def _block(self, source: int, sink: int, price: dict[int, int]) -> int:
        """Flow along arcs of reduced cost 0 and rising level, until no such path is left."""
        flat = lambda x, e: self.room[e] > 0 and self.cost[e] + price[x] == price[self.to[e]]
        level, queue = {source: 0}, deque([source])
        while queue:
            x = queue.popleft()
            for e in self.out[x]:
                if self.to[e] not in level and flat(x, e):
                    level[self.to[e]] = level[x] + 1
                    queue.append(self.to[e])
        if sink not in level:
            return 0
        sent, path, at = 0, [], dict.fromkeys(self.out, 0)
        x = source
        while True:
            if x == sink:
                step = min(self.room[e] for e in path)
                for e in path:
                    self.room[e] -= step
                    self.room[e ^ 1] += step
                sent += step
                path, x = [], source
            elif at[x] < len(self.out[x]):
                e = self.out[x][at[x]]
                if flat(x, e) and level.get(self.to[e], -1) == level[x] + 1:
                    path.append(e)
                    x = self.to[e]
                else:
                    at[x] += 1
            elif path:
                x = self.to[path.pop() ^ 1]
                at[x] += 1
            else:
                return sent

    def run(self, source: int, sink: int) -> tuple[int, int]:
        """(flow, cost) of the cheapest largest flow; `room` of an arc's twin is then what flows through it."""
        price, flow, paid = dict.fromkeys(self.out, 0), 0, 0
        for x in (source, sink):
            self.out.setdefault(x, [])
            price.setdefault(x, 0)
        while sink in (far := self._distances(source, price)):
            most = far[sink]
            for x in price:
                price[x] += min(far.get(x, most), most)
            while sent := self._block(source, sink, price):
                flow, paid = flow + sent, paid + sent * (price[sink] - price[source])
        return flow, paid


def in_order(sources: list[str | None]) -> list[str | None]:
    """By code point, null last."""
    return sorted(set(sources), key=lambda s: (s is None, s or ""))


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, most: int = 2) -> dict[str | None, Fraction]:
    """Words wanted of each source: `percent` of all words shared by repeating `weights`, at most `most` times a source's
    size, with what is above shared again."""
    left = {s: weights[i % len(weights)] for i, s in enumerate(in_order(list(sizes)))}
    rest, out = Fraction(sum(sizes.values()) * percent, 100), {}
    while left:
        unit = rest / sum(left.values())
        above = [s for s, w in left.items() if unit * w > most * sizes[s]]
        if not above:
            return out | {s: unit * w for s, w in left.items()}
        for s in above:
            out[s] = Fraction(most * sizes[s])
            rest -= out[s]
            del left[s]
    return out


@dataclass
class Plan:
    """For each pattern (its sources and its words): passes, and the words wanted beyond them.  flows: words from pattern
    to source."""

    sources: dict[str, tuple]
    words: dict[str, int]
    passes: dict[str, int] = field(default_factory=dict)
    rest: dict[str, int] = field(default_factory=dict)
    flows: dict[tuple[str, str | None], int] = field(default_factory=dict)
    runs: dict[str, list[tuple[str, str, int]]] = field(default_factory=dict)
    picked: set[tuple[str, str]] = field(default_factory=set)


def route(sources: dict[str, tuple], words: dict[str, int], wanted: dict[str | None, int], most: int = 2) -> Plan:
    """The cheapest flow of the patterns' words to the wanted words; the e-th repetition of a word costs e * e."""
    plan, net = Plan(sources, words), Network()
    names = in_order([s for some in sources.values() for s in some])
    place = {s: 2 + i for i, s in enumerate(names)}
    arcs, gives = {}, {}
    for i, p in enumerate(sorted(sources)):
        node = 2 + len(names) + i
        gives[p] = [net.arc(0, node, words[p], e * e) for e in range(most)]
        for s in in_order(list(sources[p])):
            arcs[p, s] = net.arc(node, place[s], most * words[p], 0)
    for s in names:
        net.arc(place[s], 1, wanted.get(s, 0), 0)
    net.run(0, 1)
    plan.flows = {k: net.room[e ^ 1] for k, e in arcs.items()}
    for p in sources:
        given = sum(net.room[e ^ 1] for e in gives[p])
        plan.passes[p], plan.rest[p] = divmod(given, words[p]) if words[p] else (0, 0)
    return plan


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.array_remove(F.split(text, SPACES + "+"), "")), F.lit(0)).cast("long")


def _keyed(docs: DataFrame, members: Column, seed: int, each: bool) -> DataFrame:
    """docs with __size, __sources, __pattern and __key, the seeded place in the order; `each` tells repeated rows apart."""
    first = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    second = F.xxhash64(F.monotonically_increasing_id()) if each else F.lit(0).cast("long")
    key = F.lower(F.concat(*[F.lpad(F.hex(x), KEY // 2, "0") for x in (first, second)]))
    sources = F.array_sort(F.array_distinct(members))
    size = F.when(F.col("text").isNull(), 0).otherwise(word_count(F.col("text"))).cast("long")
    return docs.withColumns({"__size": size, "__sources": sources, "__pattern": F.to_json(F.struct(sources.alias("s"))), "__key": key})


def _after(key: str) -> str:
    """Follows `key` and comes before every other key that follows it."""
    return key + "0"


def _choose(rows: DataFrame, plan: Plan) -> None:
    """Fills plan.runs, the (from, below, most) of keys and sizes that are taken, and plan.picked, single keys.  Together
    they are what one walk over the keys takes that takes all that fits; rows of one key go together."""
    spark = rows.sparkSession
    left = {p: n for p, n in plan.rest.items() if n > 0}
    start = dict.fromkeys(left, "")
    plan.runs = {p: [] for p in plan.words}

    def fitting(some: list[str]) -> DataFrame:
        at = spark.createDataFrame([(p, start[p], left[p]) for p in some], "__pattern string, __from string, __left long")
        return rows.join(F.broadcast(at), "__pattern").where((F.col("__key") >= F.col("__from")) & F.col("__size").between(1, F.col("__left")))

    while left:
        counts = {r["__pattern"]: r["count"] for r in fitting(list(left)).groupBy("__pattern").count().collect()}
        left = {p: n for p, n in left.items() if p in counts}
        few, total = [], 0
        for p in sorted(left, key=lambda p: (counts[p], p)):
            total += counts[p]
            if total > FEW:
                break
            few.append(p)
        if few:
            each = fitting(few).groupBy("__pattern", "__key").agg(F.sum("__size").alias("n")).collect()
            for p, k, n in sorted((r["__pattern"], r["__key"], r["n"]) for r in each):
                if n <= left[p]:
                    plan.picked.add((p, k))
                    left[p] -= n
            for p in few:
                del left[p]
        if not left:
            break
        most, prefix = dict(left), dict.fromkeys(left, "")
        began = dict(start)
        fits = fitting(list(left))  # by where the walk stands now
        for length in [*range(PREFIX, KEY, PREFIX), KEY]:
            if not prefix:
                break
            at = spark.createDataFrame(list(prefix.items()), "__pattern string, __prefix string")
            some = fits.join(F.broadcast(at), "__pattern").where(F.col("__key").startswith(F.col("__prefix")))
            found = some.groupBy("__pattern", F.substring("__key", 1, length).alias("k")).agg(F.sum("__size").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
            by: dict[str, list] = {}
            for r in found:
                by.setdefault(r["__pattern"], []).append((r["k"], r["n"], r["rows"]))
            deeper = {}
            for p, buckets in by.items():
                below = prefix[p] + "g"  # after every hex digit
                for k, n, count in sorted(buckets):
                    if n > left[p]:
                        below = k
                        if count > 1 and left[p] > 0 and length < KEY:
                            deeper[p] = k
                        break
                    left[p] -= n
                start[p] = _after(below) if len(below) == KEY else below
                if p not in deeper:
                    plan.runs[p].append((began[p], below, most[p]))
            prefix = deeper
        left = {p: n for p, n in left.items() if n > 0}


def _planned(rows: DataFrame, weights: tuple[int, ...], percent: int, most: int) -> tuple[Plan, dict, dict]:
    """rows: with __size, __sources, __pattern and __key.  (plan, size of each source, target of each source)."""
    found = rows.groupBy("__pattern").agg(F.first("__sources").alias("s"), F.sum("__size").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    sources = {r["__pattern"]: tuple(r["s"]) for r in found}
    words = {r["__pattern"]: r["n"] for r in found}
    sizes: dict = {}
    for p, some in sources.items():
        for s in some:
            sizes[s] = sizes.get(s, 0) + words[p]
    total = sum(words.values())
    wanted = targets(sizes, weights, percent, most) if sum(sizes.values()) == total else _overlapping(sizes, total, weights, percent, most)
    plan = route(sources, words, {s: round(t) for s, t in wanted.items()}, most)
    _choose(rows, plan)
    return plan, sizes, {s: float(t) for s, t in wanted.items()}


def _overlapping(sizes: dict, total: int, weights: tuple[int, ...], percent: int, most: int) -> dict:
    """Targets where sources overlap: `percent` of the words that there are, not of the sum over sources."""
    scale = Fraction(total, max(1, sum(sizes.values())))
    return targets(sizes, weights, 100, most) if percent * scale == 100 else {s: t * scale for s, t in targets(sizes, weights, percent, most).items()}


def _copies(rows: DataFrame, plan: Plan) -> DataFrame:
    """rows with __copies, how often each document is taken."""
    spark = rows.sparkSession
    per = spark.createDataFrame([(p, plan.passes[p], plan.runs[p]) for p in plan.words] or [("", 0, [])], "__pattern string, __passes int, __runs array<struct<from:string,below:string,most:long>>")
    picked = spark.createDataFrame(sorted(plan.picked) or [("", "")], "__pattern string, __key string").withColumn("__picked", F.lit(1))
    out = rows.join(F.broadcast(per), "__pattern", "left").join(F.broadcast(picked), ["__pattern", "__key"], "left")
    taken = F.exists("__runs", lambda r: (F.col("__key") >= r["from"]) & (F.col("__key") < r["below"]) & F.col("__size").between(1, r["most"]))
    more = taken | F.col("__picked").isNotNull()
    return out.withColumn("__copies", F.coalesce(F.col("__passes") + more.cast("int"), F.lit(0)))


def mix(docs: DataFrame, members: Column | None = None, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, most: int = 2, seed: int = 17) -> DataFrame:
    """(doc_id, size, source_size, target, taken); source_size and target are sums over the document's sources."""
    members = F.array(F.col("source")) if members is None else members
    rows = materialise(_keyed(docs, members, seed, True).select("doc_id", "__size", "__sources", "__pattern", "__key"), "mix")
    plan, sizes, wanted = _planned(rows, weights, percent, most)
    about = [(p, sum(sizes[s] for s in some), float(sum(wanted[s] for s in some))) for p, some in plan.sources.items()]
    about = rows.sparkSession.createDataFrame(about or [("", 0, 0.0)], "__pattern string, source_size long, target double")
    out = _copies(rows, plan).join(F.broadcast(about), "__pattern", "left")
    return out.select("doc_id", F.col("__size").alias("size"), "source_size", "target", (F.col("__copies") * F.col("__size")).alias("taken"))


def mixed(docs: DataFrame, members: Column | None = None, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, most: int = 2, seed: int = 17) -> DataFrame:
    """The documents of the mix with the columns of `docs`, each as many times as it is taken.  Rows that are repeated
    are taken or left together."""
    members = F.array(F.col("source")) if members is None else members
    rows = materialise(_keyed(docs, members, seed, False).select("__size", "__sources", "__pattern", "__key"), "mix")
    plan, _, _ = _planned(rows, weights, percent, most)
    taken = _copies(_keyed(docs, members, seed, False), plan).where("__copies > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(docs.columns)
