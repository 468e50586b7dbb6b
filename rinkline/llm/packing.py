"""Filling fixed-capacity containers with documents, mixture-controlled (problem 8).

Documents are spread over shards of bounded size. In a shard each source has a queue; a deficit round-robin fills one
window of containers after another, each source being owed its share of every window and carrying what it was not given
to the next. Shards begin with the deficits that the shards before them leave behind, so the proportions hold along the
whole sequence. Inside a window the documents drawn go to the container they fill best, largest first; what finds no room
goes back to the head of its queue and its deficit with it.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rinkline.operators.staging_area import staged

SHARD_TOKENS = 4_000_000  # about this many tokens are packed by one task
WINDOW = 256  # containers in a window

_PLACED = "container_no long, window_no long, doc_id long, piece int, source string, tokens long"


def fill_shard(items: list[tuple[int, int, str, int]], owed: dict[str, float], share: dict[str, float], capacity: int, window: int = WINDOW) -> list[tuple]:
    """Pieces ``(doc_id, piece, source, tokens)`` into containers: rows of ``_PLACED``.

    Every piece is placed once, and no container holds more than its capacity.
    """
    queues: dict[str, deque] = {}
    for it in items:
        queues.setdefault(it[2], deque()).append(it)
    deficit = {s: owed.get(s, 0.0) for s in queues}
    left = sum(it[3] for it in items)
    out: list[tuple] = []
    number = window_no = 0
    while live := [s for s, q in queues.items() if q]:
        n = max(1, min(window, -(-left // capacity)))
        whole = sum(share.get(s, 0.0) for s in live)
        for s in live:
            deficit[s] += n * capacity * (share.get(s, 0.0) / whole if whole else 1 / len(live))
        drawn = _draw(queues, deficit, n * capacity)
        contents: list[list[tuple]] = [[] for _ in range(n)]
        free = [(capacity, k) for k in range(n)]  # by room, smallest first

        def place(it: tuple) -> bool:
            at = bisect_left(free, (it[3], -1))
            if at == len(free):
                return False
            room, k = free.pop(at)
            insort(free, (room - it[3], k))
            contents[k].append(it)
            return True

        back = [it for it in sorted(drawn, key=lambda it: (-it[3], it[0], it[1])) if not place(it)]
        for s in sorted(live, key=lambda s: -deficit[s]):  # what is next in the queues may fill the gaps
            held: list[tuple] = []
            q = queues[s]
            while q and free[-1][0] > 0 and len(held) < window:
                it = q.popleft()
                if place(it):
                    deficit[s] -= it[3]
                else:
                    held.append(it)
            q.extendleft(reversed(held))
        for it in reversed(back):
            queues[it[2]].appendleft(it)
            deficit[it[2]] += it[3]
        for c in contents:
            if c:
                out += [(number, window_no, *it) for it in c]
                left -= sum(it[3] for it in c)
                number += 1
        window_no += 1
    return out


def _draw(queues: dict[str, deque], deficit: dict[str, float], room: int) -> list[tuple]:
    """Deficit round-robin: the next pieces of each source as far as it is owed them; when none is owed its next, the
    source nearest to it goes first, so that the room is always used."""
    drawn: list[tuple] = []
    while room > 0:
        live = [s for s, q in queues.items() if q]
        if not live:
            break
        before = len(drawn)
        for s in sorted(live, key=lambda s: -deficit[s]):
            q = queues[s]
            while q and room > 0 and deficit[s] >= q[0][3]:
                it = q.popleft()
                deficit[s] -= it[3]
                room -= it[3]
                drawn.append(it)
        if len(drawn) == before:
            s = max(live, key=lambda s: (deficit[s] - queues[s][0][3], s))
            it = queues[s].popleft()
            deficit[s] -= it[3]
            room -= it[3]
            drawn.append(it)
    return drawn


def pieces_of(sizes: DataFrame, capacity: int) -> DataFrame:
    """Documents over the capacity cut into full pieces and a rest; all others whole. ``(doc_id, piece, source, tokens)``."""
    n = F.greatest(F.lit(1), F.ceil(F.col("tokens") / capacity)).cast("int")
    cut = sizes.select("doc_id", "source", F.col("tokens").alias("all"), F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    return cut.select("doc_id", "piece", F.coalesce("source", F.lit("")).alias("source"), F.least(F.col("all") - F.col("piece").cast("long") * capacity, F.lit(capacity).cast("long")).alias("tokens"))


def sums_before(rows: DataFrame, by: str | None, block: int = 1024) -> DataFrame:
    """``rows(shard, t, [by])`` with ``before``: the sum of ``t`` over all smaller shards (of the same ``by``), in two levels:
    over whole blocks of shards, then inside a block, so that no task holds more than one block or the blocks' sums."""
    key = [by] if by else []
    blocked = rows.withColumn("block", F.floor(F.col("shard") / block))
    earlier = lambda *p: Window.partitionBy(*p).rowsBetween(Window.unboundedPreceding, -1)
    per_block = blocked.groupBy(*key, "block").agg(F.sum("t").alias("s"))
    upper = per_block.withColumn("group", F.floor(F.col("block") / block)).groupBy(*key, "group").agg(F.sort_array(F.collect_list(F.struct("block", "s"))).alias("blocks"), F.sum("s").alias("s"))
    tops = Window.partitionBy(*(key or [F.lit(0)])).orderBy("group").rowsBetween(Window.unboundedPreceding, -1)  # one row for each block * block shards
    upper = upper.select(*key, "blocks", F.coalesce(F.sum("s").over(tops), F.lit(0)).alias("base")).select(*key, "blocks", "base", F.posexplode("blocks").alias("i", "b"))
    starts = upper.select(*key, F.col("b.block").alias("block"), (F.col("base") + F.aggregate(F.slice("blocks", F.lit(1), F.col("i")), F.lit(0).cast("long"), lambda a, x: a + x["s"])).alias("start"))
    inside = blocked.withColumn("inner", F.coalesce(F.sum("t").over(earlier(*key, "block").orderBy("shard")), F.lit(0)))
    return inside.join(starts, [*key, "block"]).withColumn("before", F.col("start") + F.col("inner")).drop("block", "inner", "start")


def pack(sizes: DataFrame, kind: str, capacity: int) -> DataFrame:
    """``(container_kind, shard, container_no, window_no, doc_id, piece, source, tokens)``: every document in containers of one kind.

    ``sizes`` has ``(doc_id, source, tokens)``; target shares are the sources' shares of all tokens, the only ones that a
    packing of every document can hold throughout. Shards are cut by a
    hash of the document and their number follows the total, so a task packs about ``SHARD_TOKENS`` tokens whatever
    the input; a source that holds a third of all documents is spread like any other. Only the total and
    the sources' totals (sent as a table, joined to shards) are gathered.

    Defined results: documents without tokens are placed too; null sources are one source; repeated rows are packed each;
    an empty table gives no rows; other columns are ignored.
    """
    total = sizes.agg(F.sum(F.greatest(F.col("tokens"), F.lit(1)))).first()[0] or 0
    shards = max(1, round(total / SHARD_TOKENS))
    run_of_pieces = F.floor(F.col("piece") / max(1, SHARD_TOKENS // (4 * capacity)))  # a giant document's pieces go to many shards
    pieces = pieces_of(sizes, capacity).withColumn("shard", F.pmod(F.xxhash64("doc_id", run_of_pieces, F.lit(kind)), F.lit(shards)).cast("long"))
    by_source = staged(pieces.groupBy("shard", "source").agg(F.sum("tokens").alias("t")), "p8-shards")
    whole = by_source.agg(F.sum("t")).first()[0] or 1
    sources = by_source.groupBy("source").agg((F.sum("t") / whole).alias("share"))
    owed = sums_before(by_source, "source").join(sums_before(by_source.groupBy("shard").agg(F.sum("t").alias("t")), None).select("shard", F.col("before").alias("so_far")), "shard").join(sources, "source")
    owed = owed.select("shard", "source", "share", (F.col("share") * F.col("so_far") - F.col("before")).alias("owed"))

    def run(key: tuple, mine: pd.DataFrame, terms: pd.DataFrame) -> pd.DataFrame:
        mine = mine.sort_values(["source", "doc_id", "piece"])
        items = list(zip(mine["doc_id"], mine["piece"], mine["source"], mine["tokens"], strict=True))
        rows = fill_shard([(int(a), int(b), c, int(d)) for a, b, c, d in items], dict(zip(terms["source"], terms["owed"], strict=True)), dict(zip(terms["source"], terms["share"], strict=True)), capacity)
        out = pd.DataFrame(rows, columns=["container_no", "window_no", "doc_id", "piece", "source", "tokens"])
        out.insert(0, "shard", key[0])
        return out

    packed = pieces.groupBy("shard").cogroup(owed.groupBy("shard")).applyInPandas(run, "shard long, " + _PLACED)
    return packed.select(F.lit(kind).alias("container_kind"), "*")


def fill_report(placed: DataFrame, capacities: DataFrame) -> DataFrame:
    """``(container_kind, n_containers, tokens, unused_share)`` of packed containers."""
    used = placed.groupBy("container_kind", "shard", "container_no").agg(F.sum("tokens").alias("t"))
    per = used.groupBy("container_kind").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("t").alias("tokens"))
    return per.join(capacities, "container_kind").select("container_kind", "n_containers", "tokens", F.round(1 - F.col("tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6).alias("unused_share"))
