"""Problem 7: filling containers of fixed capacity with documents measured in tokens.

Method (linear grouping scheme): lengths above a threshold are large. They are split into groups of
equal cardinality and rounded up to the longest length of their group; with only a few sizes left,
configurations (multisets of sizes that fit a container) are optimised; actual documents are then
substituted for the rounded sizes, and the small documents go best-fit into what stays free.

Nothing here but the last join looks at single documents: the length histogram (at most capacity + 1
rows, whatever the corpus) is packed on the driver in runs "count containers with this content", and
documents take their places by their rank among the documents of equal length.
"""

from __future__ import annotations

import bisect
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampmill.session import materialize

CAPACITY = 2048
#: Lengths above CAPACITY / SMALL_PARTS are large.
SMALL_PARTS = 8
#: Numbers of groups of equal cardinality that are tried. Few leave rooms that small documents fill, many waste less where there are few small ones.
GROUPS = (24, 384)
#: Rows that are ranked in one piece: a length has as many hash buckets as its count asks for, so that no length is one task's work.
RANK_ROWS = 100_000


def _best_configuration(sizes: list[int], values: list[float], left: list[int], capacity: int) -> list[int]:
    """How often each size stands in the most valuable multiset within the capacity, no size more often than left: a bounded knapsack.

    One vectorised pass over all rooms for each copy of a size; the passes' choices are walked back.
    """
    best = np.zeros(capacity + 1)
    passes: list[tuple[int, np.ndarray]] = []
    for g, (size, value) in enumerate(zip(sizes, values)):
        for _ in range(min(left[g], capacity // size) if size <= capacity else 0):
            with_one = best[:-size] + value
            taken = with_one > best[size:] + 1e-9
            if not taken.any():
                break
            best[size:] = np.where(taken, with_one, best[size:])
            passes.append((g, taken))
    room, config = int(np.argmax(best)), [0] * len(sizes)
    for g, taken in reversed(passes):
        size = sizes[g]
        if room >= size and taken[room - size]:
            config[g] += 1
            room -= size
    return config


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """(how often each size, number of containers): covers all counts; sizes from the largest on.

    Each round begins a container with the largest size left, which only becomes harder to place, fills
    the rest of it best (a knapsack in which larger sizes break ties), and repeats that as often as the
    remaining counts allow; at least one size is used up in each round, so there are at most len(sizes).
    """
    left, out = list(counts), []
    values = [s * (1 + 1e-3 * s / capacity) for s in sizes]
    for top, size in enumerate(sizes):
        while left[top]:
            rest = [n - (g == top) for g, n in enumerate(left)]
            config = _best_configuration(sizes, values, rest, capacity - size)
            config[top] += 1
            times = min(left[g] // n for g, n in enumerate(config) if n)
            left = [a - n * times for a, n in zip(left, config)]
            out.append((config, times))
    return out


def pack_histogram(histogram: dict[int, int], capacity: int = CAPACITY, groups: int | tuple[int, ...] = GROUPS, small_parts: int = SMALL_PARTS) -> list[tuple[tuple[int, ...], int]]:
    """Runs (content of a container as lengths, number of such containers) that hold the histogram exactly: the plan with the fewest containers among those for the numbers of groups.

    Lengths are 1..capacity. Work and result are bounded by the number of distinct lengths, not by their counts.
    """
    plans = [_packed(histogram, capacity, g, small_parts) for g in ((groups,) if isinstance(groups, int) else groups)]
    return min(plans, key=lambda runs: sum(n for _, n in runs))


def _packed(histogram: dict[int, int], capacity: int, groups: int, small_parts: int) -> list[tuple[tuple[int, ...], int]]:
    """The plan for one number of groups."""
    hist = {s: n for s, n in histogram.items() if n > 0 and s > 0}
    large = sorted((s for s in hist if s > capacity // small_parts), reverse=True)
    small = sorted((s for s in hist if s <= capacity // small_parts), reverse=True)
    # linear grouping: equal cardinality, longest first; members keep their actual lengths
    total = sum(hist[s] for s in large)
    per_group = max(1, -(-total // groups))
    members: list[list[list[int]]] = []  # by group: [length, count], longest first
    room = 0
    for s in large:
        n = hist[s]
        while n:
            if room == 0:
                members.append([])
                room = per_group
            take = min(n, room)
            members[-1].append([s, take])
            n -= take
            room -= take
    runs: Counter[tuple[int, ...]] = Counter()
    if members:
        tops = [m[0][0] for m in members]
        for config, times in configurations(tops, [sum(n for _, n in m) for m in members], capacity):
            slots = [g for g, n in enumerate(config) for _ in range(n)]
            while times:
                # substitution: the longest left of each slot's group; a run ends where a length does
                picked: list[list[int]] = []
                need: Counter[int] = Counter()
                run = times
                for g in slots:
                    before = need[g]
                    entry = next(e for e in members[g] if e[1] > 0 and (before := before - e[1]) < 0)
                    picked.append(entry)
                    need[g] += 1
                for entry, k in Counter(map(id, picked)).items():
                    e = next(x for x in picked if id(x) == entry)
                    run = min(run, e[1] // k) if e[1] >= k else 0
                run = max(1, run)
                for e in picked:
                    e[1] -= run
                runs[tuple(sorted((e[0] for e in picked), reverse=True))] += run
                times -= run
    # best-fit of the small ones, longest first, into runs ordered by free room
    by_room: dict[int, Counter[tuple[int, ...]]] = {}
    for content, n in runs.items():
        by_room.setdefault(capacity - sum(content), Counter())[content] += n
    rooms = sorted(by_room)
    for s in small:
        n = hist[s]
        while n:
            i = bisect.bisect_left(rooms, s)
            if i == len(rooms):
                fit = capacity // s  # a new container takes as many as fit; the rest of the room serves shorter ones
                full, rest = divmod(n, fit)
                for k, times in ((fit, full), (rest, 1)):
                    if k and times:
                        free = capacity - k * s
                        if free not in by_room:
                            bisect.insort(rooms, free)
                        by_room.setdefault(free, Counter())[(s,) * k] += times
                n = 0
                break
            r = rooms[i]
            content, have = next(iter(by_room[r].items()))
            # one container after the other takes what it can, as best-fit would
            fit = r // s
            full, rest = divmod(n, fit)
            k, times = (fit, min(have, full)) if full else (rest, 1)
            by_room[r][content] -= times
            if not by_room[r][content]:
                del by_room[r][content]
                if not by_room[r]:
                    del by_room[r]
                    rooms.pop(i)
            free = r - k * s
            if free not in by_room:
                bisect.insort(rooms, free)
            by_room.setdefault(free, Counter())[(*content, *(s,) * k)] += times
            n -= k * times
    out: Counter[tuple[int, ...]] = Counter()
    for counter in by_room.values():
        out.update(counter)
    return sorted(((c, n) for c, n in out.items() if n), key=lambda x: (-sum(x[0]), x[0]))


def rank_within(df: DataFrame, key: str, order: str, buckets: Column | int) -> DataFrame:
    """df with column rank: 0, 1, ... within equal key, without ever collecting a key's rows in one task.

    Rows of one key are ranked in hash buckets of the order column, whose number (a column of the key,
    at least 1) follows the key's count; the buckets' offsets come from their counts (buckets rows a
    key). Ties in the order column are broken arbitrarily but uniquely.
    """
    salted = df.withColumn("__b", F.pmod(F.xxhash64(order), F.lit(buckets) if isinstance(buckets, int) else buckets).cast("int"))
    counts = salted.groupBy(key, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inside = F.row_number().over(Window.partitionBy(key, "__b").orderBy(order)) - 1
    return salted.withColumn("__r", inside).join(offsets, [key, "__b"]).withColumn("rank", F.col("__r") + F.col("__off")).drop("__b", "__r", "__off")


def pack_documents(counts: DataFrame, capacity: int = CAPACITY, groups: int | tuple[int, ...] = GROUPS, small_parts: int = SMALL_PARTS) -> DataFrame:
    """Containers for documents measured as (doc_id, n_tokens).

    Result (doc_id, n_tokens, n_pieces, piece, piece_tokens, container_id): one row per document, or one
    per piece of a document that alone exceeds the capacity (whole containers first, then the remainder,
    which shares a container). Documents without tokens take no room and lie in container 0. Repeated
    rows are documents of their own; a null count is taken as 0. Empty input gives an empty result.
    counts is read twice; give a materialised table.
    """
    sized = counts.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
    pieces = sized.select(
        "doc_id",
        "n_tokens",
        F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / capacity)).cast("int").alias("n_pieces"),
    ).select("*", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)).alias("piece"))
    pieces = pieces.withColumn("piece_tokens", F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece") * capacity).cast("int"))
    # at most capacity + 1 rows, however large the corpus
    histogram = {r.piece_tokens: r.n for r in pieces.groupBy("piece_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    spark = counts.sparkSession
    places, first_container = [], 0
    taken: Counter[int] = Counter()
    for content, times in pack_histogram(histogram, capacity, groups, small_parts):
        for length, k in Counter(content).items():
            # times containers, each with k pieces of this length
            places.append((length, taken[length], taken[length] + k * times, first_container, k))
            taken[length] += k * times
        first_container += times
    schema = "piece_tokens int, from_rank long, to_rank long, first_container long, per_container int"
    # bounded by the runs of pack_histogram, thus by the capacity
    runs = spark.createDataFrame(places, schema).groupBy("piece_tokens").agg(
        F.array_sort(F.collect_list(F.struct("from_rank", "to_rank", "first_container", "per_container"))).alias("runs")
    )
    # as many buckets as a length's count asks for; the map has at most capacity + 1 entries
    split = {size: 1 + n // RANK_ROWS for size, n in histogram.items() if n >= RANK_ROWS}
    buckets = F.coalesce(F.create_map(*[F.lit(x) for kv in split.items() for x in kv])[F.col("piece_tokens")], F.lit(1)) if split else 1
    ranked = rank_within(pieces.withColumn("__key", F.xxhash64("doc_id", "piece")), "piece_tokens", "__key", buckets).drop("__key")
    found = F.element_at(F.filter("runs", lambda x: (F.col("rank") >= x["from_rank"]) & (F.col("rank") < x["to_rank"])), 1)
    placed = ranked.join(F.broadcast(runs), "piece_tokens", "left").withColumn("__run", found)
    container = F.col("__run.first_container") + F.floor((F.col("rank") - F.col("__run.from_rank")) / F.col("__run.per_container"))
    return placed.select("doc_id", "n_tokens", "n_pieces", "piece", "piece_tokens", F.when(F.col("piece_tokens") == 0, F.lit(0)).otherwise(container).cast("long").alias("container_id"))


def packed_corpus(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """pack_documents over the token counts of docs (doc_id, text), which are encoded once."""
    from ampmill.llm.bpe import count_tokens

    return pack_documents(materialize(count_tokens(docs, vocabulary=vocabulary), "token-counts"), capacity)
