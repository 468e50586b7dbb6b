"""Near-duplicate texts: word sets whose Jaccard similarity reaches a threshold (problem 5).

Every text is the set of its words (n-grams of one word, since the similarity is defined on words) under one global
order, rarest first. The sets are stored in a prefix tree whose subtrees are shared out to tasks by their first label,
and, as a task holds a bounded number of labels, by groups of sets: every two groups meet in one task for each share of
the labels. A set is sent once to each task that holds a subtree it may stand in, and each task walks its subtrees in
memory (:mod:`rinkline.llm.prefixtree`). What its bit sets cannot rule out is compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinkline.llm.components import closed_groups
from rinkline.llm.prefixtree import DEPTH, Part, path_part, probe_length
from rinkline.operators.staging_area import staged

ORDER_BUCKETS = 1 << 18  # hashed word counts that make the global order; any order gives the same result
PART_ENTRIES = 20_000_000  # labels that one task holds, about: 150 MB
HOT_TEXTS = 500_000  # a first-level node with more texts is shared out by its second label
BITS = 256
_WORDS = 1_000_000  # words of sets laid out at a time, about
_SEEN = 250_000  # keys of sets a task keeps to know copies by

_RECORD = "part int, node long, n int, " + ", ".join(f"b{i} long" for i in range(BITS // 64)) + ", labels array<int>"


def text_words(text: Column) -> Column:
    """Hashes of the distinct words of a text: runs of letters and digits, lower-cased."""
    return F.array_distinct(F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.xxhash64(w)))


def set_key(words: Column) -> Column:
    return F.xxhash64(F.sort_array(words))


def word_sets(df: DataFrame, item_id: str, text: Column) -> DataFrame:
    """``(id, node, w)``: the sets of all texts, written once, words as 32-bit hashes; texts without words have no set."""
    rows = df.select(F.col(item_id).cast("long").alias("id"), text_words(text).alias("words")).where(F.size("words") > 0)
    return staged(rows.select("id", set_key(F.col("words")).alias("node"), F.transform("words", lambda h: F.shiftright(h, 32).cast("int")).alias("w")), "p5-sets")


def _lists(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a list column."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = a.offsets.to_numpy()
    return a.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], np.diff(offsets)


def _unseen(node: np.ndarray, seen: set[int]) -> np.ndarray:
    """Places of the keys that are not in ``seen``, which they are put into."""
    new = []
    for i, x in enumerate(node.tolist()):
        if x not in seen:
            seen.add(x)
            new.append(i)
    return np.array(new, dtype=np.int64)


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``_WORDS`` words, so that long texts are laid out a few at a time."""
    at = np.cumsum(_lists(b.column("w"))[1]) // _WORDS
    cut = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), b.num_rows]
    return (b.slice(i, j - i) for i, j in zip(cut, cut[1:], strict=False) if j > i)


def _pair_number(i, j):
    """Number of a pair of groups, i <= j."""
    return j * (j + 1) // 2 + i


def _groups_of(number: int) -> tuple[int, int]:
    j = 0
    while _pair_number(0, j + 1) <= number:
        j += 1
    return number - _pair_number(0, j), j


def _group(node: np.ndarray, groups: int) -> np.ndarray:
    return ((node.view(np.uint64) >> np.uint64(16)) % np.uint64(groups)).astype(np.int64)


def shape(n_sets: float, counts: np.ndarray, threshold: float, tasks: int, part_entries: int, hot_texts: int) -> tuple[int, int]:
    """Into how many shares of the labels and how many groups of the sets the tree is cut: one group while a task can hold
    all sets (``part_entries`` labels); else the cut that sends the fewest copies of a set to tasks that hold so many.

    A set stands in about as many subtrees as it has labels to pass over, more where a hot label (of more than
    ``hot_texts`` sets, by ``counts``) is shared out by its second.
    """
    each = max(1.0, float(counts.sum()) / max(1.0, n_sets))
    most = max(2.0, part_entries / ((1 - threshold) * each + DEPTH))  # sets of a task
    if n_sets <= most:
        return tasks, 1
    hot = max(0.0, (1 - threshold) - float(counts[counts <= hot_texts].sum()) / max(1.0, float(counts.sum()))) * each
    entries = ((1 - threshold) * each + 1) * (1 + hot / 2)
    cuts = []
    few = int(np.ceil(2 * n_sets / most))  # groups of which any two fit into one task
    for groups in {1, *(max(2, few * k // 8) for k in range(1, 9))}:
        held = n_sets * min(1.0, 2 / groups)
        parts = max(-(-tasks // _pair_number(0, groups)), int(np.ceil(held * entries / most)) if held > most else 1)
        if parts > ORDER_BUCKETS and groups != few:
            continue
        cuts.append((groups * (-parts * np.expm1(entries * np.log1p(-1 / parts)) if parts > 1 else 1), parts, groups))
    return min(cuts)[1:]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(ORDER_BUCKETS, dtype=np.int64)
    for b in batches:
        if b.num_rows:
            counts += np.bincount(_lists(b.column("w"))[0] & (ORDER_BUCKETS - 1), minlength=ORDER_BUCKETS)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["bucket", "n"])


def _records(order: np.ndarray, parts: int, groups: int, hot_from: int, threshold: float):
    """Sets as ordered prefixes, one record for each part that holds a subtree of theirs."""
    pairs = np.array([[_pair_number(min(g, h), max(g, h)) for h in range(groups)] for g in range(groups)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies of one set leave a task once
        for b in (x for whole in batches for x in _slices(whole)):
            if len(seen) > _SEEN:
                seen.clear()
            new = _unseen(b.column("node").to_numpy(), seen)
            if not len(new):
                continue
            b = b.take(pa.array(new))
            node = b.column("node").to_numpy()
            w, n = _lists(b.column("w"))
            row = np.repeat(np.arange(len(n)), n)
            bits = np.zeros((len(n), BITS), dtype=bool)
            bits[row, (w >> 18) % (BITS - 1)] = True
            packed = np.packbits(bits, axis=1).view(np.int64)
            label = order[w & (ORDER_BUCKETS - 1)]
            at = np.argsort((label.astype(np.int64) << 32) | w.astype(np.uint32), kind="stable")
            at = at[np.argsort(row[at], kind="stable")]
            label = label[at]
            start = np.cumsum(n) - n
            pos = np.arange(len(row)) - start[row]
            probe = probe_length(n.astype(np.int64), threshold)
            kept = np.minimum(n, probe + DEPTH - 1)
            first = pos < probe[row]
            cold = first & (label < hot_from)
            r, p = [row[cold]], [label[cold] % parts]
            for i in np.flatnonzero(first & (label >= hot_from)):
                k = row[i]
                behind = label[i + 1 : start[k] + min(n[k], probe[k] + 1)]
                p.append(path_part(label[i], behind, parts))
                r.append(np.full(len(behind), k))
            goes = np.unique(np.concatenate(r) * parts + np.concatenate(p))
            inside = pos < kept[row]
            prefixes = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(kept))).astype(np.int32)), pa.array(label[inside].astype(np.int32)))
            step = max(1, 20_000 // groups)
            for k in range(0, len(goes), step):
                rows = goes[k : k + step] // parts
                to = pairs[_group(node[rows], groups)] * parts + (goes[k : k + step] % parts)[:, None]
                q = np.repeat(rows, groups)
                columns = [pa.array(to.ravel().astype(np.int32)), pa.array(node[q]), pa.array(n[q].astype(np.int32)), *[pa.array(packed[q, i]) for i in range(BITS // 64)], prefixes.take(pa.array(q))]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "node", "n", *[f"b{i}" for i in range(BITS // 64)], "labels"])

    return run


def _walk(parts: int, groups: int, hot_from: int, threshold: float):
    def walked(number: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        node, n, bits, labels, lengths = (np.concatenate([h[k] for h in held]) for k in range(5))
        held.clear()
        i, j = _groups_of(number // parts)
        part = Part(node, n, bits, labels, lengths, threshold, None if i == j else _group(node, groups) == j)
        del node, n, bits, labels, lengths
        for a, b in part.batches(number % parts, parts, hot_from):
            for k in range(0, len(a), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[k : k + 50_000]), pa.array(np.maximum(a, b)[k : k + 50_000])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, set[int]] = {}
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            of = batch.column("part").to_numpy()
            for number in np.unique(of).tolist():
                mine = batch.filter(pa.array(of == number)) if (of != number).any() else batch
                new = _unseen(mine.column("node").to_numpy(), seen.setdefault(number, set()))
                if len(new) < mine.num_rows:
                    mine = mine.take(pa.array(new))
                labels, lengths = _lists(mine.column("labels"))
                bits = np.stack([mine.column(f"b{i}").to_numpy() for i in range(BITS // 64)], axis=1)
                held.setdefault(number, []).append((mine.column("node").to_numpy().copy(), mine.column("n").to_numpy().copy(), bits, labels.copy(), lengths.astype(np.int64)))
        seen.clear()
        for number in list(held):
            yield from walked(number, held.pop(number))

    return run


def candidate_sets(sets: DataFrame, threshold: float, part_entries: int = PART_ENTRIES, hot_texts: int = HOT_TEXTS, parts: int = 0, groups: int = 0) -> DataFrame:
    """``(a, b)``, a < b: keys of the different sets that may reach the threshold: all that do are among them.

    The order of words is by their hashed counts over all texts (``ORDER_BUCKETS`` numbers, whatever the input). The tree
    is cut by :func:`shape`, unless ``parts`` and ``groups`` are given.
    """
    spark = sets.sparkSession
    counted = sets.select("w").mapInArrow(_word_counts, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(ORDER_BUCKETS, dtype=np.int64)
    counts[counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    by_count = np.argsort(counts, kind="stable")
    order = np.empty(ORDER_BUCKETS, dtype=np.int32)
    order[by_count] = np.arange(ORDER_BUCKETS)
    if not (parts and groups):
        rows, different = sets.agg(F.count(F.lit(1)), F.approx_count_distinct("node", 0.02)).first()
        different = min(rows, 1.05 * different)
        parts, groups = shape(different, counts * (different / max(1, rows)), threshold, spark.sparkContext.defaultParallelism, part_entries, hot_texts)
    hot_from = int(np.searchsorted(counts[by_count], hot_texts, side="right")) if parts > 1 else ORDER_BUCKETS
    records = sets.select("node", "w").mapInArrow(_records(order, parts, groups, hot_from, threshold), _RECORD)
    return records.repartitionById(parts * _pair_number(0, groups), F.col("part")).mapInArrow(_walk(parts, groups, hot_from, threshold), "a long, b long").distinct()


def similar_sets(df: DataFrame, item_id: str, text: Column, sets: DataFrame, threshold: float, **limits: int) -> DataFrame:
    """``(a, b)``: keys of different word sets with Jaccard similarity of at least ``threshold``, each pair once.

    Candidates are compared on the words of one text of each set, read again by its id.
    """
    found = staged(candidate_sets(sets, threshold, **limits), "p5-candidates")
    ends = found.select(F.col("a").alias("node")).union(found.select("b")).distinct()
    read = staged(sets.select("id", "node").join(ends, "node").groupBy("node").agg(F.min("id").alias("id")), "p5-compared")
    texts = df.select(F.col(item_id).cast("long").alias("id"), text.alias("text")).join(read.select("id").distinct(), "id", "left_semi").select("id", text_words(F.col("text")).alias("words"))
    words = texts.withColumn("node", set_key(F.col("words"))).join(read, ["id", "node"]).groupBy("node").agg(F.any_value("words").alias("words"))
    both = found.join(words.select(F.col("node").alias("a"), F.col("words").alias("wa")), "a").join(words.select(F.col("node").alias("b"), F.col("words").alias("wb")), "b")
    common = F.size(F.array_intersect("wa", "wb"))
    return both.where(common >= (F.size("wa") + F.size("wb") - common) * F.lit(threshold) - 1e-9).select("a", "b")


def near_pairs(df: DataFrame, item_id: str, text: Column, threshold: float = 0.6, **limits: int) -> DataFrame:
    """``(item_a, item_b)``, item_a < item_b: all pairs of items whose word sets reach the threshold, equal sets included.

    Exact: no pair is missed, whatever the order, place or number of the edits. Items with equal sets are one node until
    the end, so copies, however many, are compared once, and leave a task once. A node of the tree that holds very many
    texts is shared out over tasks by its second label.

    Defined results: null texts, and texts without a word, are in no pair; repeated ids pair with others but not with
    themselves; texts of any length are taken whole; an empty table gives no rows; other columns are ignored.
    """
    sets = word_sets(df, item_id, text)
    pairs = similar_sets(df, item_id, text, sets, threshold, **limits)
    members = sets.select("id", "node")
    other = pairs.join(members.select(F.col("node").alias("a"), F.col("id").alias("p")), "a").join(members.select(F.col("node").alias("b"), F.col("id").alias("q")), "b").select("p", "q")
    copies = members.groupBy("node").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("node")
    same = members.join(copies, "node")
    equal = same.select("node", F.col("id").alias("p")).join(same.select("node", F.col("id").alias("q")), "node").where("p < q").select("p", "q")
    return other.where("p != q").unionByName(equal).select(F.least("p", "q").alias("item_a"), F.greatest("p", "q").alias("item_b")).distinct()


def near_classes(df: DataFrame, item_id: str, text: Column, threshold: float = 0.6, **limits: int) -> DataFrame:
    """``(item_id, class_id, n_links)``: one row per item with a set: the smallest item of its class, and how many distinct
    other word sets of the class it is directly similar to. Copies are not paired. Otherwise as :func:`near_pairs`."""
    sets = word_sets(df, item_id, text)
    pairs = staged(similar_sets(df, item_id, text, sets, threshold, **limits), "p5-links")
    nodes = sets.select("node").distinct()
    links = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    grouped = sets.select("id", "node").join(closed_groups(nodes, pairs), "node").join(links, "node", "left")
    first = grouped.groupBy("label").agg(F.min("id").alias("class_id"))
    return grouped.join(first, "label").select(F.col("id").alias("item_id"), "class_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
