"""Mixing overlapping sources to target weights by min-cost flow over membership patterns.

A document belongs to one or more sources; its *pattern* is that set. Documents are summed by
pattern, so that the flow network has a node for each distinct pattern and each source, however
many documents there are. From the network's start an arc reaches each pattern for each
repetition: the first carries the pattern's size at no cost, each further one the same size at a
cost that rises (a convex cost of repetition). Arcs lead from a pattern to its sources, and from a
source to the end with its quota as capacity. The flow of least cost that meets the quotas says how
often each pattern is repeated; seeded hashes then choose the documents of the last, partial
repetition.

Defined cases: null text has size 0; documents of size 0 and of null source take part (null is a
source of its own, last in order); no document: an empty result; repeated rows are rows of their
own, of which the cut may take some: as many as the target has room for.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, text_of, written
from .components import components

#: Weights by rank of the source, repeating.
WEIGHTS = (5, 2, 1)
#: A document is taken so often at most, and a target stops at so many times its source's size.
MOST = 3
#: The seed of the choice of documents, and the bins in which their sizes are summed to find the cut.
SEED, BINS = 20, 4096


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) -> with target: weights' shares of the total, each at most `most` sizes.

    Capped sources give their excess to the others by weight until none is above its cap. That is
    the level L at which sum(min(most * size, L * weight)) is the total: with sources in the order
    of cap / weight, L is the first of (total - caps so far) / (weights from here on) that does not
    exceed the next ratio. One row for each source goes through the two windows.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("_w", w).withColumn("_cap", F.lit(float(most)) * F.col("source_size")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    by = Window.orderBy("_ratio", F.col("source").isNull(), F.col("source").cast("binary"))
    all_rows = Window.partitionBy()
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    onward = by.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("_total", F.sum("source_size").over(all_rows).cast("double"))
    s = s.withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(onward))
    s = s.withColumn("_at", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_level"))).over(all_rows)["_level"])
    # With no such level (rounding) every source is at its cap.
    return s.select("source", "source_size", F.least(F.col("_cap"), F.coalesce(F.col("_at") * F.col("_w"), F.col("_cap"))).alias("target"))


def min_cost_flow(sizes: dict, members: dict, quotas: dict, most: int = MOST) -> dict:
    """Flow of least cost: {(pattern, source): amount}.

    sizes: of each pattern; members: its sources; quotas: of each source. The cost of the k-th
    repetition of a unit is k, so that the whole cost is convex in what a pattern gives. Successive
    shortest paths, each augmented as far as it can carry; connected parts are solved on their own,
    so that sources without overlap cost one path for each repetition.
    """
    near = defaultdict(list)
    for p, sources in members.items():
        for s in sources:
            near[("s", s)].append(("p", p))
            near[("p", p)].append(("s", s))
    seen, flow = set(), {}
    for start in near:
        if start in seen:
            continue
        part, todo = [], [start]
        seen.add(start)
        while todo:
            part.append(x := todo.pop())
            for y in near[x]:
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        flow |= _flow_of_part([x for kind, x in part if kind == "p"], [x for kind, x in part if kind == "s"], sizes, members, quotas, most)
    return flow


def _flow_of_part(patterns, sources, sizes, members, quotas, most):
    arcs: list[list] = []  # to, room, cost, back arc
    out = defaultdict(list)

    def arc(a, b, room, cost):
        out[a].append(len(arcs))
        arcs.append([b, float(room), cost, len(arcs) + 1])
        out[b].append(len(arcs))
        arcs.append([a, 0.0, -cost, len(arcs) - 1])

    for p in patterns:
        for k in range(most):
            arc("start", ("p", p), sizes[p], k)
    link = {}
    for p in patterns:
        for s in members[p]:
            link[p, s] = len(arcs)
            arc(("p", p), ("s", s), float("inf"), 0)
    for s in sources:
        arc(("s", s), "end", quotas[s], 0)
    tiny = 1e-9 * max(1.0, sum(quotas[s] for s in sources))
    height = defaultdict(float)
    while True:
        best, came, heap, n = {"start": 0.0}, {}, [(0.0, 0, "start")], 0
        while heap:
            d, _, a = heapq.heappop(heap)
            if d > best[a]:
                continue
            for i in out[a]:
                b, room, cost, _ = arcs[i]
                to = d + cost + height[a] - height[b]
                if room > tiny and to < best.get(b, float("inf")) - 1e-12:
                    best[b], came[b], n = to, i, n + 1
                    heapq.heappush(heap, (to, n, b))
        if "end" not in best:
            break
        for a, d in best.items():
            height[a] += d
        path, b = [], "end"
        while b != "start":
            path.append(came[b])
            b = arcs[arcs[came[b]][3]][0]
        amount = min(arcs[i][1] for i in path)
        for i in path:
            arcs[i][1] -= amount
            arcs[arcs[i][3]][1] += amount
    return {ps: arcs[arcs[i][3]][1] for ps, i in link.items()}


_PLAN = "pattern array<string>, whole int, rest double, source_size long, target double"


def planned(by_pattern: DataFrame, aims: DataFrame, most: int = MOST) -> DataFrame:
    """(pattern, size) and (source, source_size, target) -> _PLAN: how often each pattern is taken whole, and what of it once more.

    Sources that no pattern joins have nothing to do with each other: each connected part is a flow of
    its own, solved where its patterns and sources meet, and none is gathered on the driver. Patterns of
    no source have parts of their own and give nothing.
    """
    one = by_pattern.withColumn("_source", F.explode_outer("pattern"))
    if by_pattern.agg(F.max(F.size("pattern"))).first()[0] in (None, 0, 1):
        part = one.withColumn("part", F.xxhash64("_source"))
    else:
        # Patterns and sources are nodes; ids of both are hashes, the lowest bit tells them apart.
        node = lambda c, bit: F.shiftleft(F.shiftright(F.xxhash64(c), 1), 1).bitwiseOR(F.lit(bit))
        pairs = written(one.select("pattern", "size", "_source", node("pattern", 0).alias("_p"), node("_source", 1).alias("_s")))
        found = components(pairs.where("size(pattern) > 0").select(F.col("_p").alias("u"), F.col("_s").alias("v")))
        part = pairs.join(found, F.col("_p") == F.col("node"), "left").withColumn("part", F.coalesce("component", "_p"))
    joined = part.join(aims.withColumnRenamed("source", "_aim"), F.col("_source").eqNullSafe(F.col("_aim")) & (F.size("pattern") > 0), "left")

    def solved(rows):
        sizes, members, quotas, known = {}, defaultdict(list), {}, {}
        for pattern, size, source, source_size, target in zip(rows["pattern"], rows["size"], rows["_source"], rows["source_size"], rows["target"], strict=True):
            p = tuple(pattern)
            sizes[p] = int(size)
            if p:
                members[p].append(source)
                quotas[source], known[source] = float(target), int(source_size)
        given = defaultdict(float)
        for (p, _), amount in min_cost_flow(sizes, members, quotas, most).items():
            given[p] += amount
        out = []
        for p, size in sizes.items():
            whole = min(most, int(given[p] // size + 1e-9)) if size else 0
            rest = max(0.0, given[p] - whole * size) if whole < most else 0.0
            out.append((list(p), whole, rest, known[p[0]] if p else 0, quotas[p[0]] if p else 0.0))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _PLAN.split(", ")])

    return joined.select("part", "pattern", "size", "_source", "source_size", "target").groupBy("part").applyInPandas(solved, _PLAN)


def mix(docs: DataFrame, quotas: dict | None = None, weights=WEIGHTS, most: int = MOST, seed: int = SEED, bins: int = BINS, sources: str = "source", row: str | None = None) -> DataFrame:
    """doc_id, pattern, source_size, target, size, times of each document (times: how often the mix takes it).

    `sources` is a column with a document's source, or an array of its sources. quotas: words by
    source; absent, targets() of the sources' own sizes. A document of several sources reports the
    first one's size and target. row: a column that is passed on, and tells rows apart that are
    otherwise equal at the cut.
    """
    kind = dict(docs.dtypes)[sources]
    pattern = F.array_sort(F.array_distinct(F.col(sources))) if kind.startswith("array") else F.array(F.col(sources).cast("string"))
    passed = [F.col(row).alias("_row")] if row else []
    rows = docs.select(F.col("doc_id"), pattern.alias("pattern"), F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"), *passed)
    rows = rows.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "size")).withColumn("_bin", F.pmod("_h", F.lit(bins)).cast("int"))
    rows = written(rows, docs)
    sized = rows.groupBy("pattern", "_bin").agg(F.sum("size").alias("size"))
    sized = written(sized.coalesce(8))
    by_pattern = sized.groupBy("pattern").agg(F.sum("size").alias("size"))
    by_source = by_pattern.select(F.explode("pattern").alias("source"), "size").groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = targets(by_source, weights, most)
    if quotas is not None:
        words = F.create_map(*[F.lit(x) for k, v in quotas.items() if k is not None for x in (k, float(v))]) if any(k is not None for k in quotas) else F.lit(None).cast("map<string,double>")
        aims = aims.withColumn("target", F.when(F.col("source").isNull(), F.lit(float(quotas.get(None, 0.0)))).otherwise(F.coalesce(F.try_element_at(words, "source"), F.lit(0.0))))
    plan = written(planned(by_pattern, aims, most).coalesce(8))
    # The cut: bins whose sizes fit in the rest are taken whole; documents of the next bin are taken in order of hash.
    so_far = Window.partitionBy("pattern").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    cut = sized.withColumn("_before", F.coalesce(F.sum("size").over(so_far), F.lit(0)))
    cut = cut.join(plan, "pattern").where((F.col("_before") <= F.col("rest")) & (F.col("_before") + F.col("size") > F.col("rest")))
    cut = cut.groupBy("pattern").agg(F.min("_bin").alias("_cut"), F.min_by("_before", "_bin").alias("_full"))
    plan = written(plan.join(cut, "pattern", "left").coalesce(8))
    out = rows.join(plan, "pattern")
    edge = out.where(F.col("_bin") == F.col("_cut"))
    run = Window.partitionBy("pattern").orderBy("_h", "doc_id", "size", *(["_row"] if row else [])).rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("_before", F.col("_full") + F.coalesce(F.sum("size").over(run), F.lit(0)))
    # A document that straddles the cut is taken if that comes nearer to it.
    edge = edge.withColumn("_extra", (F.col("_before") + F.col("size") / 2 <= F.col("rest")).cast("int"))
    even = out.where(F.col("_cut").isNull() | (F.col("_bin") != F.col("_cut")))
    even = even.withColumn("_extra", (F.col("rest") > 0).cast("int") * F.when(F.col("_cut").isNull(), 1).otherwise((F.col("_bin") < F.col("_cut")).cast("int")))
    columns = ["doc_id", "pattern", "size", "source_size", "target", F.least(F.lit(most), F.col("whole") + F.col("_extra")).cast("long").alias("times"), *(["_row"] if row else [])]
    return even.select(*columns).unionAll(edge.select(*columns))


def op7_mixing(spark, sf_dir):
    """op7's digest over the whole documents table."""
    from .common import table

    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def keep_mix(docs: DataFrame) -> DataFrame:
    """The documents as often as the mix takes them, with their own columns.

    Each row is taken as often as it itself is due, whatever ids or texts it shares; null is a source
    of its own; texts without words are never due and go; an empty table gives no rows.
    """
    row, times, copy = fresh(docs.columns, "_row_number", "_times", "_copy")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), docs)
    due = mix(rows.select("doc_id", "text", "source", row), row=row).where("times > 0").select(F.col("_row").alias(f"{row}due"), F.col("times").alias(times))
    repeated = rows.join(due, F.col(row) == F.col(f"{row}due")).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))))
    return repeated.select(*docs.columns)
