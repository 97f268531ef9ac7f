"""Filling windows of fixed capacity with texts: Karmarkar-Karp multiway differencing in groups.

Texts are dealt by hash into groups of about `windows_per_group` windows. Within a group the method
merges partial partitions with opposing imbalances, which gives near-equal windows; overfull
windows and some with room are filled anew by best fit, and the number of windows rises whenever items are left. A text is divided only if it alone exceeds the
capacity. Groups are of bounded size at any scale, and each is one task's small piece of work.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaesta.common import durable

WINDOWS = "window_id int, capacity int, window string, doc_id bigint, piece int, start bigint, n_tokens bigint"


def differencing(sizes: list[int], k: int) -> tuple[list[int], int]:
    """Bin of each item, and the fullest bin, after Karmarkar-Karp differencing into k bins.

    A partial partition is held by its used bins only (descending sums and a node per bin). The two
    with the largest spread are merged so that the fullest bins of one meet the emptiest of the other.
    """
    n = len(sizes)
    parent = np.arange(n)
    heap = [(-s, i, np.array([s]), np.array([i])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tick = n
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        over = len(a) + len(b) - k
        if over <= 0:
            s, z = np.concatenate((a, b)), np.concatenate((x, y))
        else:
            keep = k - len(b)
            b, y = b[::-1], y[::-1]
            parent[y[:over]] = x[keep:]
            s = np.concatenate((a[:keep], a[keep:] + b[:over], b[over:]))
            z = np.concatenate((x, y[over:]))
        order = np.argsort(-s, kind="stable")
        s, z = s[order], z[order]
        heapq.heappush(heap, (-(int(s[0]) - (int(s[-1]) if len(s) == k else 0)), tick, s, z))
        tick += 1
    _, _, s, z = heap[0]
    while True:  # every node to its root
        up = parent[parent]
        if (up == parent).all():
            break
        parent = up
    label = np.full(n, -1)
    label[z] = np.arange(len(z))
    return label[parent].tolist(), int(s[0])


def best_fit(items: list[int], sizes: list[int], rooms: list[tuple[int, int]]) -> tuple[dict[int, int], list[int]]:
    """Bin of each item, the largest first, where it leaves the least of the given (room, bin); and the items that fit nowhere."""
    rooms = sorted(rooms)
    put, left = {}, []
    for i in sorted(items, key=lambda i: (-sizes[i], i)):
        at = bisect.bisect_left(rooms, (sizes[i], -1))
        if at == len(rooms):
            left.append(i)
            continue
        room, b = rooms.pop(at)
        put[i] = b
        bisect.insort(rooms, (room - sizes[i], b))
    return put, left


def repair(sizes: list[int], bins: list[int], k: int, capacity: int) -> int:
    """Empty the overfull bins and some of the roomiest, and put their items by best fit into these and
    what room the others have; twice as many bins are opened until no item is left. In place; the sizes
    left over when all bins were opened."""
    used = [0] * k
    content: list[list[int]] = [[] for _ in range(k)]
    for i, b in enumerate(bins):
        used[b] += sizes[i]
        content[b].append(i)
    order = sorted(range(k), key=lambda b: (used[b] <= capacity, used[b]))
    open_ = 2 * sum(u > capacity for u in used) + 2
    while True:
        mine = order[:open_]
        chosen = set(mine)
        rooms = [(capacity, b) for b in mine] + [(capacity - used[b], b) for b in range(k) if b not in chosen]
        put, left = best_fit([i for b in mine for i in content[b]], sizes, rooms)
        if not left:
            for i, b in put.items():
                bins[i] = b
            return 0
        if open_ >= k:
            return sum(sizes[i] for i in left)
        open_ *= 2


def fill(sizes: list[int], capacity: int) -> tuple[list[int], int]:
    """Bin of each item (all at most `capacity`) and the number of bins.

    The number starts at the least possible one. Differencing makes the bins near-equal, the few that
    are overfull are repaired by best fit; if that fails, the number rises by what is left over.
    """
    k = max(1, -(-sum(sizes) // capacity), sum(2 * s > capacity for s in sizes))
    while True:
        bins, most = differencing(sizes, k)
        left = repair(sizes, bins, k, capacity) if most > capacity else 0
        if not left:
            return bins, k
        k += max(1, left // capacity)


def pack(sizes: DataFrame, windows: DataFrame, windows_per_group: int = 224) -> DataFrame:
    """Windows of each capacity: WINDOWS columns, one row per document (or piece of one) and capacity.

    sizes: doc_id, n_tokens; windows: window_id, capacity (a small fixed table, read to the driver).
    A text longer than the capacity fills windows of its own; what is left of it is packed with the
    others. Texts without tokens are assigned too and take no space. Null doc_id or null size: left
    out. Capacities that are null or not positive are no windows.
    """
    sizes = sizes.filter(F.col("doc_id").isNotNull() & F.col("n_tokens").isNotNull()).select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"))
    caps = [(int(r["window_id"]), int(r["capacity"])) for r in windows.select("window_id", "capacity").distinct().filter("capacity > 0 and window_id is not null").limit(1001).collect()]
    if len(caps) > 1000:
        raise ValueError("more than 1000 capacities")
    spark = sizes.sparkSession
    if not caps:
        return spark.createDataFrame([], WINDOWS)
    left = sizes.agg(*[F.coalesce(F.sum(F.col("n_tokens") % c), F.lit(0)).alias(f"r{i}") for i, (_, c) in enumerate(caps)], F.count(F.lit(1)).alias("n")).collect()[0]
    groups = [max(1, round(max(left[f"r{i}"] / (c * windows_per_group), left["n"] / 20_000))) for i, (_, c) in enumerate(caps)]
    options = F.array(*[F.struct(F.lit(w).alias("window_id"), F.lit(c).alias("capacity"), F.lit(g).alias("groups")) for (w, c), g in zip(caps, groups)])
    items = sizes.select("doc_id", "n_tokens", F.explode(options).alias("o")).select("doc_id", "n_tokens", "o.window_id", "o.capacity", "o.groups")
    cap, n = F.col("capacity"), F.col("n_tokens")
    whole = (
        items.filter(n >= cap)
        .select("window_id", "capacity", "doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(n / cap) - 1)).alias("piece"))
        .select("window_id", "capacity", F.lit(-1).cast("long").alias("grp"), "doc_id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * cap).alias("start"), cap.cast("long").alias("n_tokens"))
    )
    rest = items.filter((n % cap > 0) | (n == 0)).select(
        "window_id", "capacity", F.pmod(F.xxhash64("doc_id", "window_id"), F.col("groups")).alias("grp"), "doc_id", F.floor(n / cap).cast("int").alias("piece"), (n - n % cap).alias("start"), (n % cap).alias("n_tokens")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                it = sorted(r.items, key=lambda x: (-x["n_tokens"], x["doc_id"], x["piece"]))
                size = [int(x["n_tokens"]) for x in it if x["n_tokens"] > 0]
                bins, _ = fill(size, r.capacity) if size else ([], 1)
                for x, b in zip(it, [*bins, *[0] * (len(it) - len(bins))]):
                    out.append((r.window_id, r.capacity, f"g{r.grp}:{b}", x["doc_id"], x["piece"], x["start"], x["n_tokens"]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in WINDOWS.split(", ")])

    grouped = rest.groupBy("window_id", "capacity", "grp").agg(F.collect_list(F.struct("doc_id", "piece", "start", "n_tokens")).alias("items"))
    packed = grouped.repartition("window_id", "grp").mapInPandas(run, WINDOWS)
    # windows that one piece fills alone are named after document and piece
    own = whole.select("window_id", "capacity", F.concat(F.lit("d"), "doc_id", F.lit(":"), "piece").alias("window"), "doc_id", "piece", "start", "n_tokens")
    return packed.unionByName(own)


def pack_documents(docs: DataFrame, windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Windows for all documents; `counts` (doc_id, n_tokens) is written once, as several steps read it."""
    return pack(durable(counts), windows)


def fill_report(packed: DataFrame) -> DataFrame:
    """Per capacity: windows, tokens, and the share of space used."""
    w = packed.groupBy("window_id", "capacity", "window").agg(F.sum("n_tokens").alias("used"))
    return w.groupBy("window_id", "capacity").agg(
        F.count(F.lit(1)).alias("n_windows"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"), F.round(F.sum("used") / (F.count(F.lit(1)) * F.col("capacity")), 6).alias("filled")
    )
