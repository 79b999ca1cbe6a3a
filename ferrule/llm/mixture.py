"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of its documents' tokens. The queues are the leaves of a tree. An inner node passes the tokens
that it is granted to its two halves in the proportion of their targets; what a half's share exceeds the whole tokens
that it has been granted is its deficit, less than a token, which is carried from window to window. A queue that runs
dry leaves its share to the others. So every window has the target proportions, to a token for each level of the
tree, and so has any run of windows. Documents are cut where a window is full and go on in the next one: every window
but the last is full and no token is lost.

A deficit depends on nothing but the number of tokens granted so far, for which Plan has a closed form. So windows are
filled in groups, in parallel, and each group begins with the very deficits that the one before leaves; how windows
are grouped changes no row. Documents' places in their queues are prefix sums over hash buckets, so a hot source is no
single task's work; texts don't move, only ids and lengths do.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, ship, small, stored
from .token_counts import PATTERN, VOCABULARY, token_count

WINDOW = 8192
#: Windows that a task fills together.
GROUP_WINDOWS = 2048
#: Documents in a hash bucket of a source's queue.
BUCKET = 1 << 16
#: Without targets a source's share is its tokens to this power, which lifts small sources.
TEMPER = 0.7
#: Shares are whole numbers of this sum, about.
UNITS = 1 << 16

SCHEMA = "window bigint, tokens int, sources array<string>, doc_ids array<bigint>, doc_starts array<bigint>, lengths array<int>"


def _units(shares: list[float]) -> list[int]:
    total = sum(shares)
    return [max(1, round(UNITS * x / total)) if x > 0 else 0 for x in shares]


class Node:
    """Sources lo to hi - 1 of a tree, in the order in which they run dry when each is granted tokens by its weight.

    If k of them are dry when the node has been granted n tokens, each other one's share is its weight x
    (n - dry[k]) / live[k], where dry is the tokens of those that are dry and live the weight of the others.
    """

    def __init__(self, lo: int, hi: int, order: list[int], totals: list[int], weights: list[int]) -> None:
        self.lo, self.hi = lo, hi
        dry, live = [0], [sum(weights[s] for s in order)]
        ends = []
        for s in order:
            # the first whole n at which s is dry: all others have had their share of what s took
            ends.append(dry[-1] + -(-totals[s] * live[-1] // weights[s]))
            dry.append(dry[-1] + totals[s])
            live.append(live[-1] - weights[s])
        self.ends, self.dry, self.live = np.array(ends, np.int64), np.array(dry, np.int64), np.array(live, np.int64)
        self.halves: tuple[Node, Node] | None = None
        if hi - lo > 1:
            mid = (lo + hi) // 2
            self.halves = tuple(Node(*span, [s for s in order if span[0] <= s < span[1]], totals, weights) for span in ((lo, mid), (mid, hi)))  # type: ignore[assignment]
            self.left_dry = np.cumsum([0, *(s < mid for s in order)])

    def first(self, n: np.ndarray) -> np.ndarray:
        """Of n tokens granted so far, those that went to the left half."""
        assert self.halves
        k = np.searchsorted(self.ends, n, "right")
        left = self.halves[0]
        j = self.left_dry[k]
        rest, live = n - self.dry[k], self.live[k]
        share = left.live[j]
        if len(n) and int(rest.max()) * int(share.max()) >= 1 << 62:
            part = np.array([int(r) * int(x) // max(int(y), 1) for r, x, y in zip(rest, share, live)], np.int64)
        else:
            part = rest * share // np.maximum(live, 1)
        return left.dry[j] + part


def _grown(sources: list[int], totals: list[int], weights: list[int]) -> Node:
    """The tree over some sources, which it numbers from 0."""
    t, w = [totals[s] for s in sources], [weights[s] for s in sources]
    order = sorted(range(len(sources)), key=lambda i: (Fraction(t[i], w[i]), i))
    return Node(0, len(sources), order, t, w)


class Plan:
    """How many tokens each source has sent when n tokens are scheduled, for any n.

    Sources without a target come when all others are dry, in proportion to their tokens. Counts never fall as n grows,
    add up to n, and are within log2(sources) + 1 of the share.
    """

    def __init__(self, totals: list[int], shares: list[float]) -> None:
        self.totals = [int(t) for t in totals]
        self.total = sum(self.totals)
        self.trees: list[tuple[int, int, list[int], Node]] = []  # first n, tokens, sources, tree
        start = 0
        wanted = _units(shares) if sum(shares) > 0 else [0] * len(totals)
        for use, these in ((wanted, [s for s, t in enumerate(self.totals) if t and wanted[s]]), (_units([float(t) for t in self.totals]), [s for s, t in enumerate(self.totals) if t and not wanted[s]])):
            if these:
                n = sum(self.totals[s] for s in these)
                self.trees.append((start, n, these, _grown(these, self.totals, use)))
                start += n

    def sent(self, source: int, n: np.ndarray) -> np.ndarray:
        """Tokens that source has sent when n are scheduled."""
        for start, tokens, these, node in self.trees:
            if source in these:
                at, x = these.index(source), np.clip(n - start, 0, tokens)
                while node.halves:
                    first = node.first(x)
                    left, right = node.halves
                    node, x = (left, first) if at < left.hi else (right, x - first)
                return x
        return np.zeros(len(n), np.int64)

    def all_sent(self, n: np.ndarray, sources: np.ndarray) -> np.ndarray:
        """The same for several ascending sources, a row each; a branch without any of them isn't visited."""
        row = {int(s): i for i, s in enumerate(sources)}
        out = np.zeros((len(sources), len(n)), np.int64)

        def visit(node: Node, x: np.ndarray, these: list[int]) -> None:
            if not any(s in row for s in these[node.lo : node.hi]):
                return
            if node.halves is None:
                out[row[these[node.lo]]] = x
                return
            first = node.first(x)
            visit(node.halves[0], first, these)
            visit(node.halves[1], x - first, these)

        for start, tokens, these, node in self.trees:
            visit(node, np.clip(n - start, 0, tokens), these)
        return out

    def group(self, source: int, at: np.ndarray, tokens: int) -> np.ndarray:
        """The group of tokens tokens in which source sends its at-th token."""
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), -(-self.total // tokens) - 1)
        while (lo < hi).any():
            mid = (lo + hi) // 2
            later = self.sent(source, np.minimum((mid + 1) * tokens, self.total)) <= at
            lo, hi = np.where(later, mid + 1, lo), np.where(later, hi, mid)
        return lo


def cut(bounds: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cut the spans start, start + size at the ascending bounds: for each part its span, interval, start and size."""
    a = np.searchsorted(bounds, start, "right") - 1
    z = np.searchsorted(bounds, start + size, "left")
    n = z - a
    span = np.repeat(np.arange(len(start)), n)
    interval = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    first = np.maximum(start[span], bounds[interval])
    last = np.minimum((start + size)[span], bounds[interval + 1])
    some = last > first
    return span[some], interval[some], first[some], (last - first)[some]


def _spread(plan: Plan, tokens: int):
    """Each document's span of its queue, cut at the edges of groups of so many tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            source, start, size = (b.column(c).to_numpy() for c in (0, 1, 2))
            for s in np.unique(source):
                at = np.flatnonzero(source == s)
                a, n = start[at], size[at]
                low, high = plan.group(int(s), a, tokens), plan.group(int(s), a + n - 1, tokens)
                count = high - low + 1
                span = np.repeat(np.arange(len(at)), count)
                group = np.repeat(low, count) + np.arange(len(span)) - np.repeat(np.cumsum(count) - count, count)
                first, last = a[span].copy(), (a + n)[span].copy()
                inner = np.flatnonzero(group > low[span])
                edge = plan.sent(int(s), group[inner] * tokens)
                first[inner] = edge
                last[inner - 1] = edge
                some = last > first
                span, group, first, last = span[some], group[some], first[some], last[some]
                ids = b.column(3).take(pa.array(at[span]))
                yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(np.full(len(span), s, np.int32)), pa.array(first), pa.array(last - first), ids, pa.array(first - a[span])], ["group", "sid", "start", "size", "doc_id", "doc_start"])

    return run


def _filled(names: list[str | None], plan: Plan, window: int, group_windows: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks().sort_by([("sid", "ascending"), ("start", "ascending")])
        sid, start, size, doc_start = (rows[c].to_numpy() for c in ("sid", "start", "size", "doc_start"))
        group = rows["group"][0].as_py()
        edges = np.minimum(np.arange(group * group_windows, (group + 1) * group_windows + 1, dtype=np.int64) * window, plan.total)
        edges = edges[: int(np.searchsorted(edges, plan.total)) + 1]
        sources, first = np.unique(sid, return_index=True)
        sent = plan.all_sent(edges, sources)
        parts = []
        for k, (a, z) in enumerate(zip(first, np.append(first[1:], len(sid)))):
            span, w, at, n = cut(sent[k], start[a:z], size[a:z])
            parts.append((span + a, w, at - start[a:z][span], n))
        row, w, inside, n = (np.concatenate(c) for c in zip(*parts))
        order = np.argsort(w, kind="stable")
        row, w, inside, n = row[order], w[order], inside[order], n[order]
        offsets = pa.array(np.searchsorted(w, np.arange(len(edges))).astype(np.int32))
        listed = lambda x: pa.ListArray.from_arrays(offsets, x)
        label = pa.array(names, pa.string()).take(pa.array(sid[row]))
        ids = rows["doc_id"].combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        return pa.table(
            {
                "window": pa.array(group * group_windows + np.arange(len(edges) - 1)),
                "tokens": pa.array(np.diff(edges).astype(np.int32)),
                "sources": listed(label),
                "doc_ids": listed(ids.take(pa.array(row))),
                "doc_starts": listed(pa.array(doc_start[row] + inside)),
                "lengths": listed(pa.array(n.astype(np.int32))),
            }
        )

    return run


def pack_mixture(docs: DataFrame, targets: dict[str | None, float] | None = None, window: int = WINDOW, group_windows: int = GROUP_WINDOWS, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """One row for each window of window tokens (the last may have fewer).

    sources, doc_ids, doc_starts and lengths list the window's segments: lengths tokens of document doc_ids from its
    token doc_starts on. targets gives the sources' shares of each window, by default tokens ** TEMPER; a source that
    it leaves out, or gives 0, comes when all others have run out, in proportion to its tokens. A null source is a
    source of its own. A queue's order is that of a hash of doc_id, so it doesn't depend on the files.

    Null and empty texts have no tokens and stand in no window. Repeated rows are packed each; a null doc_id stands in
    doc_ids as null. An empty table gives no windows. Further columns are left out. The sources' names and totals come
    to the driver: sources are kinds of documents, tens of thousands at most.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.where("text <> ''").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), token_count(spark, F.col("text"), vocabulary, pattern).alias("tokens"))
    light = stored(texts, "tokens").where("tokens > 0")
    found = sorted(light.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")).collect(), key=lambda r: (r["source"] is None, r["source"]))
    if not found:
        return spark.createDataFrame([], SCHEMA)
    names, totals = [r["source"] for r in found], [r["tokens"] for r in found]
    plan = Plan(totals, [t**TEMPER for t in totals] if targets is None else [float(targets.get(n, 0)) for n in names])

    known = small(spark.createDataFrame([(i, n, -(-r["docs"] // BUCKET)) for i, (n, r) in enumerate(zip(names, found))], "sid int, __name string, buckets bigint"))
    h = F.xxhash64("doc_id", "tokens")
    queued = light.join(known, F.col("source").eqNullSafe(F.col("__name"))).select("sid", F.pmod(h, "buckets").alias("bucket"), h.alias("h"), "doc_id", "tokens")
    before = Window.partitionBy("sid").orderBy("bucket")
    sums = queued.groupBy("sid", "bucket").agg(F.sum("tokens").alias("n"))
    base = small(stored(sums.select("sid", "bucket", (F.sum("n").over(before) - F.col("n")).alias("base")), "base"))
    inside = Window.partitionBy("sid", "bucket").orderBy("h", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    placed = queued.join(base, ["sid", "bucket"]).select("sid", (F.col("base") + F.sum("tokens").over(inside) - F.col("tokens")).alias("start"), "tokens", "doc_id")
    spread = placed.mapInArrow(_spread(plan, window * group_windows), "group bigint, sid int, start bigint, size bigint, doc_id bigint, doc_start bigint")
    return spread.groupBy("group").applyInArrow(_filled(names, plan, window, group_windows), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_mixture(read(spark, sf_dir, "documents"))
