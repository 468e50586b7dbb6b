"""Variant spellings of the names of persons and clubs (problem 3).

Stored strings are folded to forms (decoding undone, accents, doubled letters and usual spelling habits levelled, parts
in sorted order). Forms of one scope meet where they share a part or have similar parts; similar parts come from a
prefix-filtered set-similarity join on their q-grams, rarest grams first. A pair of forms is then judged by the soft
similarity of all its parts, each weighted by its rarity, with initials, abbreviations and short names understood.
Links that rest on full parts are closed transitively; forms that say less (initials, a lone surname) join a group only
if just one fits. Two forms typed in the same list of the same load group are never one entity.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinkline.functions.textkeys import ascii_key
from rinkline.llm.components import closed_groups
from rinkline.llm.encoding import repair, suspicious
from rinkline.operators.staging_area import staged

# Letters that do not decompose, spelling habits, and what clubs' designations stand for.
_LETTERS = str.maketrans({"ø": "o", "æ": "a", "þ": "t", "ð": "d", "ł": "l", "đ": "d", "ß": "s", "ı": "i"})
_HABITS = (("ae", "a"), ("oe", "o"), ("aa", "a"), ("ue", "u"), ("ck", "k"), ("ph", "f"), ("th", "t"), ("qv", "kv"), ("qu", "kv"), ("w", "v"), ("z", "s"), ("y", "i"), ("x", "ks"), ("c", "k"), ("q", "k"))
_CLUBS = {"hockeyklubb": "hk", "hockeyclub": "hc", "idrottsklubb": "ik", "idrottsforening": "if", "sportklubb": "sk", "bollklubb": "bk", "hockeyforening": "hf"}
_CLUB_KINDS = {*_CLUBS.values()}
_OPEN_KINDS = {"hockey", "alag", "lag", "a"}

GRAM_SHARE = 0.34  # Jaccard similarity of q-gram sets from which parts count as similar
_BUCKETS = 1 << 16
_SURNAME = math.log(200)  # a part this rare (one in about 200 parts) may stand for a whole name


def _fold(part: str) -> str:
    s = unicodedata.normalize("NFKD", part.lower().translate(_LETTERS))
    return "".join(c for c in s if not unicodedata.combining(c))


@lru_cache(maxsize=100_000)
def _spelling(part: str) -> str:
    s = _fold(part)
    for a, b in _HABITS:
        s = s.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", s)


_WORDS = re.compile(r"[^\W_]+")


def person_form(name: str, short: dict[str, str]) -> str:
    """Sorted folded parts of a person's name, known short given names put as the formal ones."""
    return "p " + " ".join(sorted(short.get(s, s) for s in map(_spelling, _WORDS.findall(name))))


def club_form(name: str) -> str:
    """Sorted folded parts of a club's name, its designation abbreviated and set apart by a slash."""
    parts, letters, kind = [], "", ""
    for w in [*map(_fold, _WORDS.findall(name)), ""]:
        if len(w) == 1:
            letters += w
            continue
        for x in filter(None, (letters, w)):
            k = _CLUBS.get(x, x)
            if k in _CLUB_KINDS or k in _OPEN_KINDS or re.fullmatch(r"hockey\w*|idrott\w*|a?lag", k):
                kind = k if k in _CLUB_KINDS else kind
            else:
                parts.append(_spelling(x))
        letters = ""
    return "t " + " ".join([*sorted(parts), "/" + kind])


@lru_cache(maxsize=200_000)
def _distance(a: str, b: str) -> int:
    """Edits between two parts, a swap of neighbours being one."""
    if abs(len(a) - len(b)) > 2:
        return 9
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        before, row = row, new
    return row[-1]


def _close(a: str, b: str) -> float:
    """Similarity of two parts that a slip of the keys may tell apart, else 0."""
    m = min(len(a), len(b))
    if m < 3:
        return 0.0
    d = _distance(a, b)
    return 1 - d / max(len(a), len(b)) if d <= (1 if m < 6 else 2) else 0.0


NONE, A_SAYS_LESS, B_SAYS_LESS, SAME, SHORT_NAME = 0, 1, 2, 3, 4


def judge(a: str, b: str, rarity) -> int:
    """How two forms relate: the same, one a shorter statement of the other, perhaps a short name, or not at all."""
    x, y = a.split()[1:], b.split()[1:]
    if a[0] == "t":
        ka, kb = x.pop(), y.pop()
        if ka != kb and ka != "/" and kb != "/":
            return NONE
        if len(x) == len(y) == 1 and abs(len(x[0]) - len(y[0])) > 1 and min(len(x[0]), len(y[0])) > 2 and (x[0].startswith(y[0]) or y[0].startswith(x[0])):
            return A_SAYS_LESS if len(x[0]) < len(y[0]) else B_SAYS_LESS
        got = _match(x, y, rarity)
        if got in (NONE, SHORT_NAME) or not x or not y:
            return NONE
        if ka == kb:
            return got
        less = A_SAYS_LESS if ka == "/" else B_SAYS_LESS
        return less if got in (SAME, less) else NONE
    return _match(x, y, rarity)


def _match(x: list[str], y: list[str], rarity) -> int:
    x, y = list(x), list(y)
    total, got, anchor, anchor_rarity, total_parts = [sum(rarity(t) for t in z if len(t) > 1) for z in (x, y)], 0.0, False, 0.0, (tuple(x), tuple(y))
    for one, two in ((x, y), (y, x)):  # two parts written as one
        for t in [t for t in one if len(t) > 5 and t not in two]:
            cut = next((i for i in range(2, len(t) - 1) if t[:i] in two and t[i:] in two), None)
            if cut:
                one.remove(t)
                one += [t[:cut], t[cut:]]
    for t in list(x):
        if t in y:
            x.remove(t)
            y.remove(t)
            if len(t) > 1:
                got += rarity(t)
                anchor |= len(t) > 2
                anchor_rarity = max(anchor_rarity, rarity(t))
    for t in sorted(x, key=len, reverse=True):
        if y and len(t) > 2:
            s, u = max((_close(t, u), u) for u in y)
            if s:
                x.remove(t)
                y.remove(u)
                w = min(rarity(t), rarity(u))  # a slip makes any part rare: both count as the one that is usual
                got += s * w
                total[0] -= rarity(t) - w
                total[1] -= rarity(u) - w
                anchor |= len(t) > 3
                anchor_rarity = max(anchor_rarity, w)
    matched = len(total_parts[0]) - len(x)
    fx, fy = [t for t in x if len(t) > 1], [t for t in y if len(t) > 1]
    if fx and fy and anchor and len(fx) <= 2 and len(fy) <= 2 and _run_together(fx, fy, matched):
        got += min(sum(map(rarity, fx)), sum(map(rarity, fy)))
        x, y = [t for t in x if len(t) == 1], [t for t in y if len(t) == 1]
    elif matched > 1 and x and y and not fx and not fy:  # middle initials come and go
        x, y = [], []
    if not anchor:
        return NONE
    less = [False, False]
    for mine, theirs, side in ((x, y, 0), (y, x, 1)):
        for t in list(mine):
            u = next((u for u in theirs if len(t) <= 5 and len(u) > len(t) and u.startswith(t)), None)
            if u:
                mine.remove(t)
                theirs.remove(u)
                less[side] = True
                got += rarity(u) / 2
                total[1 - side] -= rarity(u) / 2
                total[side] -= rarity(t) - rarity(u) / 2 if len(t) > 1 else -rarity(u) / 2
    if x and y:  # one full part on either side may be a short name of the other's
        if not any(_short_of(t, u) for t in x for u in y) or min(len(x), len(y)) != 1 or max(len(x), len(y)) > 2 or any(less):
            return NONE
        return SHORT_NAME if got >= 0.3 * min(total) else NONE
    rest = [t for t in (x or y) if len(t) > 1]
    if rest:  # a lone part stands for the whole name only if it is the rarer one
        if anchor_rarity < min(_SURNAME, 0.9 * max(map(rarity, rest))) or got < 0.25 * max(total):
            return NONE
        less[1 if x else 0] = True
    elif got < 0.5 * max(total):
        return NONE
    if all(less):
        return NONE
    return A_SAYS_LESS if less[0] else B_SAYS_LESS if less[1] else SAME


def _run_together(x: list[str], y: list[str], matched: int) -> bool:
    """Whether leftover parts are the same letters parted elsewhere, or short parts of a longer name with a slip in one."""
    if len(x) == len(y) == 1:
        a, b = sorted((x[0], y[0]), key=len)
        if matched < 2 or len(a) < 2 or len(b) > 5:
            return False
        it = iter(b)
        return _distance(a, b) == 1 or all(c in it for c in a) and len(b) - len(a) <= 2 and a[0] == b[0]
    cats = [{"".join(z), "".join(reversed(z))} for z in (x, y)]
    return any(min(len(a), len(b)) > 4 and _distance(a, b) <= 1 for a in cats[0] for b in cats[1])


def _short_of(a: str, b: str) -> bool:
    """Whether one given name may be a familiar form of the other: the same first letters, or those of one inside the other."""
    return len(a) > 1 and len(b) > 1 and (a[:2] == b[:2] or a[:3] in b or b[:3] in a)


def _grams(part: str) -> set[str]:
    s = f"^{part}$"
    return {s[i : i + 2] for i in range(len(s) - 1)}


def _forms_udf(short: dict[str, str]):
    result = T.StructType([T.StructField("form", T.StringType()), T.StructField("damaged", T.BooleanType())])

    @F.pandas_udf(result)
    def forms(kind: pd.Series, name: pd.Series, odd: pd.Series) -> pd.DataFrame:
        out = []
        for k, s, o in zip(kind, name, odd, strict=True):
            text, damaged, _ = repair(s) if o else (s, False, False)
            out.append((person_form(text, short) if k == "player" else club_form(text), damaged))
        return pd.DataFrame(out, columns=["form", "damaged"])

    return forms


def gram_prefix(part: str, order: dict[str, int]) -> list[int]:
    """The rarest q-grams of a part, as many as any similar part must share one of."""
    g = sorted(order[x] if x in order else -1 - zlib.crc32(x.encode()) % (1 << 30) for x in _grams(part))
    return g[: len(g) - math.ceil(GRAM_SHARE * len(g)) + 1]


def _prefix_udf(order: dict[str, int]):
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def prefix(parts: pd.Series) -> pd.Series:
        return parts.map(lambda p: gram_prefix(p, order))

    return prefix


def _rarity_of(rarity: list[float]):
    """How rare a part is: its hashed count's logarithmic weight."""
    memo: dict[str, float] = {}

    def rare(t: str) -> float:
        r = memo.get(t)
        if r is None:
            if len(memo) > 500_000:
                memo.clear()
            r = memo[t] = rarity[xxhash.xxh64_intdigest(t.encode(), 42) % _BUCKETS]
        return r

    return rare


def _judge_udf(rarity: list[float]):
    @F.pandas_udf(T.IntegerType())
    def verdict(a: pd.Series, b: pd.Series) -> pd.Series:
        rare = _rarity_of(rarity)
        return pd.Series([judge(x, y, rare) for x, y in zip(a, b, strict=True)], dtype="int32")

    return verdict


def _meeting_parts():
    """The parts of a form by which it may meet others; clubs also meet by the first letters of their place."""
    full = F.filter(F.split("form", " "), lambda t, i: (i > 0) & (F.length(t) > 1) & ~t.startswith("/"))
    starts = F.transform(F.filter(full, lambda t: F.length(t) > 2), lambda t: F.concat(F.lit("^"), F.substring(t, 1, 3)))
    return F.array_distinct(F.when(F.col("form").startswith("t"), F.concat(full, starts)).otherwise(full))


LOCAL = 5_000  # strings in a scope that one task still resolves by itself


class _Scope:
    """The strings of one scope, resolved in memory by the same steps as :func:`_resolved_apart` takes by joins."""

    def __init__(self, rows: list[tuple[str, str, int, bool]], order: dict[str, int], rarity):
        self.nodes: dict[str, int] = {}
        self.lists: list[int] = []
        for _, form, lists, damaged in rows:
            k = self.nodes.setdefault(form, len(self.nodes))
            if k == len(self.lists):
                self.lists.append(0)
            if not damaged:
                self.lists[k] |= lists
        self.up = list(range(len(self.lists)))
        judged = [(i, j, v) for i, j in self._candidates(order) if (v := judge(self.forms[i], self.forms[j], rarity))]
        for i, j, v in judged:
            if v == SAME:
                self._join(i, j)
        if any(r[3] for r in rows):
            bones: dict[str, list] = {}
            for name, form, _, damaged in rows:
                bones.setdefault(_bones(name), []).append((self.nodes[form], damaged))
            for same in bones.values():
                if any(d for _, d in same):
                    for k, _ in same[1:]:
                        self._join(same[0][0], k)
        lean = [(x, y, v) for i, j, v in judged if v != SAME for x, y in ([(i, j)] if v != B_SAYS_LESS else []) + ([(j, i)] if v != A_SAYS_LESS else [])]
        for _ in range(2):
            self._only_fits(lean)

    def label(self, form: str) -> int:
        return self._top(self.nodes[form])

    def _top(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = k = self.up[self.up[k]]
        return k

    def _join(self, i: int, j: int) -> None:
        i, j = self._top(i), self._top(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)

    def _candidates(self, order: dict[str, int]) -> set[tuple[int, int]]:
        self.forms = list(self.nodes)
        holders: dict[str, list[int]] = {}
        for k, form in enumerate(self.forms):
            for p in _parts_to_meet(form):
                holders.setdefault(p, []).append(k)
        met = [(p, p) for p, ks in holders.items() if len(ks) > 1]
        branches: dict[int, list[str]] = {}
        for p in holders:
            if len(p) > 3 and p[0] != "^":
                near = set()
                for g in gram_prefix(p, order):
                    held = branches.setdefault(g, [])
                    near.update(held)
                    held.append(p)
                met += [(p, q) for q in near if abs(len(p) - len(q)) <= 2 and _edits(p, q) <= 2]
        out = set()
        for p, q in met:
            for i in holders[p]:
                for j in holders[q]:
                    if i != j and not self.lists[i] & self.lists[j]:
                        out.add((i, j) if i < j else (j, i))
        return out

    def _only_fits(self, lean: list[tuple[int, int, int]]) -> None:
        lists: dict[int, int] = {}
        for k, x in enumerate(self.lists):
            t = self._top(k)
            lists[t] = lists.get(t, 0) | x
        fits: dict[int, dict[int, int]] = {}
        for x, y, v in lean:
            a, b = self._top(x), self._top(y)
            if a != b and not lists[a] & lists[b]:
                of = fits.setdefault(a, {})
                of[b] = min(v, of.get(b, v))
        only = {a: next(iter(of.items())) for a, of in fits.items() if len(of) == 1}
        for a, (b, v) in only.items():
            if v != SHORT_NAME or only.get(b, (None,))[0] == a:
                self._join(a, b)


@lru_cache(maxsize=200_000)
def _edits(a: str, b: str) -> int:
    """Levenshtein distance of two parts."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


_ASCII_RUNS = re.compile("[^a-z0-9]+")


def _bones(name: str) -> str:
    """The same key as ``ascii_key``."""
    return " ".join(sorted(_ASCII_RUNS.split(name.lower()))).lstrip(" ") or name.lower()


def _parts_to_meet(form: str) -> list[str]:
    full = list(dict.fromkeys(t for t in form.split()[1:] if len(t) > 1 and t[0] != "/"))
    return full + list(dict.fromkeys("^" + t[:3] for t in full if len(t) > 2)) if form[0] == "t" else full


def _resolved_in_memory(named: DataFrame, order: dict[str, int], rarity: list[float]) -> DataFrame:
    """``named`` with ``label``, scope by scope; scopes are short runs of rows of a sorted partition."""
    fields = ["kind", "league", "team_id", "name", "scope", "form", "lists", "damaged"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rare = _rarity_of(rarity)
        held: list[tuple] = []

        def close() -> list[tuple]:
            s = _Scope([(r[3], r[5], sum(1 << int(k) for k in r[6]), r[7]) for r in held], order, rare)
            return [(*r[:4], s.label(r[5])) for r in held]

        for pdf in batches:
            out: list[tuple] = []
            for r in zip(*(pdf[c] for c in fields), strict=True):
                if held and r[4] != held[0][4]:
                    out += close()
                    held = []
                held.append(r)
            yield pd.DataFrame(out, columns=["kind", "league", "team_id", "name", "label"])
        if held:
            yield pd.DataFrame(close(), columns=["kind", "league", "team_id", "name", "label"])

    rows = named.select(*fields).repartition("scope").sortWithinPartitions("scope")
    return rows.mapInPandas(run, "kind string, league string, team_id string, name string, label long")


def link_variants(strings: DataFrame, short_forms: dict[str, str], local: int = LOCAL) -> DataFrame:
    """``(kind, league, team_id, name, label)``: every stored string with the group of strings that mean the same entity.

    ``strings`` has ``kind`` (``player`` or ``team``), ``league``, ``team_id``, ``name``, and ``lists``, the numbers of the
    lists the string was typed in: strings with a list in common are different entities unless only writing or decoding
    tells them apart (an empty array knows of none). ``short_forms`` (folded short given name to folded formal name) is a fixed table.
    Labels are numbers that tell groups of one scope apart.

    Scopes of up to ``local`` strings are resolved in memory, one after another; larger ones by joins on (scope, gram)
    and (scope, part) and by labels travelling along links, so no unbounded scope is gathered in one task. Both ways take
    the same steps. The gram order and hashed part counts sent to the workers have at most 40 x 40 and 65,536 numbers.

    Defined results: null names are left out; names without letters or digits form one group per scope; equal strings are
    one row per scope; an empty table gives no rows; other columns are ignored.
    """
    named = strings.where("name is not null").select("kind", "league", "team_id", "name", "lists", F.xxhash64("kind", "league", "team_id").alias("scope"), suspicious(F.col("name")).alias("odd"))
    named = named.withColumn("f", _forms_udf(short_forms)("kind", "name", "odd")).select("kind", "league", "team_id", "name", "scope", "lists", F.col("f.form").alias("form"), F.col("f.damaged").alias("damaged"))
    named = staged(named, "p3-strings")

    parts = named.select(F.explode(F.filter(F.split("form", " "), lambda t, i: i > 0)).alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    parts = staged(parts.where((F.length("part") > 1) & ~F.col("part").startswith("/")), "p3-parts")
    buckets = {r[0]: r[1] for r in parts.groupBy(F.pmod(F.xxhash64("part"), F.lit(_BUCKETS))).agg(F.sum("n")).collect()}  # at most 65,536 rows
    total = max(1, sum(buckets.values()))
    rarity = [math.log(1 + total / (1 + buckets.get(k, 0))) for k in range(_BUCKETS)]
    grams = parts.where(F.col("part").rlike("^[a-z0-9]+$")).mapInPandas(_count_grams, "g string, n long").groupBy("g").agg(F.sum("n").alias("n"))
    order = {r[0]: i for i, r in enumerate(grams.orderBy("n", "g").collect())}  # letters, one digit, two ends: at most 38 x 38 rows

    large = staged(named.groupBy("scope").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > local).select("scope"), "p3-large")
    if not large.limit(1).count():
        return _resolved_in_memory(named, order, rarity)
    small = _resolved_in_memory(named.join(large, "scope", "left_anti"), order, rarity)
    return small.unionByName(_resolved_apart(named.join(large, "scope"), order, rarity))


def _count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter = Counter()
    for pdf in batches:
        for p, n in zip(pdf["part"], pdf["n"], strict=True):
            for g in _grams(p):
                counts[g] += n
    yield pd.DataFrame({"g": list(counts.keys()), "n": list(counts.values())}, columns=["g", "n"]).astype({"g": object, "n": "int64"})


def _all_lists():
    """The lists of a group of strings; a scope has a bounded number of lists."""
    return F.array_distinct(F.flatten(F.collect_set("lists"))).alias("lists")


def _resolved_apart(named: DataFrame, order: dict[str, int], rarity: list[float]) -> DataFrame:
    """The same as :func:`_resolved_in_memory` for scopes of any size, by joins."""
    named = named.withColumn("lists", F.when(F.col("damaged"), F.array().cast("array<int>")).otherwise(F.col("lists"))).withColumn("node", F.xxhash64("scope", "form")).withColumn("skeleton", ascii_key(F.col("name")))
    nodes = staged(named.groupBy("scope", "node", "form").agg(_all_lists()), "p3-forms")
    parts = nodes.select("scope", "node", "form", "lists", F.explode(_meeting_parts()).alias("part"))
    known = parts.select("scope", "part").distinct()
    grams = known.where((F.length("part") > 3) & ~F.col("part").startswith("^")).select("scope", "part", F.explode(_prefix_udf(order)("part")).alias("g"))
    left, right = grams.select("scope", "g", F.col("part").alias("s")), grams.select("scope", "g", F.col("part").alias("t"))
    similar = left.join(right, ["scope", "g"]).where((F.col("s") < F.col("t")) & (F.abs(F.length("s") - F.length("t")) <= 2) & (F.levenshtein("s", "t") <= 2)).select("scope", "s", "t").distinct()

    a = parts.select("scope", F.col("part").alias("s"), F.col("node").alias("a"), F.col("form").alias("form_a"), F.col("lists").alias("lists_a"))
    b = parts.select("scope", F.col("part").alias("t"), F.col("node").alias("b"), F.col("form").alias("form_b"), F.col("lists").alias("lists_b"))
    apart = ~F.arrays_overlap("lists_a", "lists_b")
    exact = a.join(b.withColumnRenamed("t", "s"), ["scope", "s"]).where((F.col("a") < F.col("b")) & apart)
    near = a.join(similar, ["scope", "s"]).join(b, ["scope", "t"]).where(apart & (F.col("a") != F.col("b")))
    near = near.select(*[F.when(F.col("a") < F.col("b"), F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in (("a", "b", "a"), ("b", "a", "b"), ("form_a", "form_b", "form_a"), ("form_b", "form_a", "form_b"))])
    candidates = exact.select("a", "b", "form_a", "form_b").unionByName(near).groupBy("a", "b").agg(F.any_value("form_a").alias("form_a"), F.any_value("form_b").alias("form_b"))
    judged = staged(candidates.select("a", "b", _judge_udf(rarity)("form_a", "form_b").alias("v")).where("v > 0"), "p3-judged")

    bones = named.where("damaged").select("scope", "skeleton", F.col("node").alias("a")).distinct()
    same_bones = bones.join(named.select("scope", "skeleton", F.col("node").alias("b")), ["scope", "skeleton"]).where("a != b").select("a", "b").distinct()
    groups = staged(closed_groups(nodes.select("node"), judged.where(f"v = {SAME}").select("a", "b").unionByName(same_bones)), "p3-groups")
    lean = judged.where(f"v != {SAME}")
    lean = lean.where(f"v != {B_SAYS_LESS}").select(F.col("a").alias("x"), F.col("b").alias("y"), "v").unionByName(lean.where(f"v != {A_SAYS_LESS}").select(F.col("b").alias("x"), F.col("a").alias("y"), "v"))
    for _ in range(2):  # a form that says little may fit two groups which the first round makes one
        groups = _joined_by_the_only_fit(nodes, groups, lean)
    return named.select("kind", "league", "team_id", "name", "node").join(groups, "node").select("kind", "league", "team_id", "name", "label")


def _joined_by_the_only_fit(nodes: DataFrame, groups: DataFrame, lean: DataFrame) -> DataFrame:
    """Groups after each that says less has joined the only group it fits; short names join if each is the other's only fit."""
    held = nodes.join(groups, "node").groupBy("label").agg(_all_lists())
    ends = lean.join(groups.select(F.col("node").alias("x"), F.col("label").alias("a")), "x").join(groups.select(F.col("node").alias("y"), F.col("label").alias("b")), "y").where("a != b").groupBy("a", "b").agg(F.min("v").alias("v"))
    ends = ends.join(held.select(F.col("label").alias("a"), F.col("lists").alias("la")), "a").join(held.select(F.col("label").alias("b"), F.col("lists").alias("lb")), "b").where(~F.arrays_overlap("la", "lb"))
    only = staged(ends.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("b"), F.min("v").alias("v")).where("n = 1"), "p3-only")
    mutual = only.where(f"v = {SHORT_NAME}").alias("p").join(only.alias("q"), (F.col("p.a") == F.col("q.b")) & (F.col("p.b") == F.col("q.a"))).select("p.a", "p.b")
    joined = closed_groups(held.select(F.col("label").alias("node")), only.where(f"v != {SHORT_NAME}").select("a", "b").unionByName(mutual))
    return staged(groups.join(joined.select(F.col("node").alias("label"), F.col("label").alias("top")), "label").select("node", F.col("top").alias("label")), "p3-groups")


def linked_pairs(groups: DataFrame) -> DataFrame:
    """``(kind, league, team_id, name_a, name_b)``: every pair of different strings of one group, name_a first by code point."""
    key = ["kind", "league", "team_id", "label"]
    a, b = groups.withColumnRenamed("name", "name_a"), groups.withColumnRenamed("name", "name_b")
    return a.join(b, key).where("name_a < name_b").select("kind", "league", "team_id", "name_a", "name_b")


def typed_names(players: DataFrame, goalies: DataFrame, standings: DataFrame, leagues: DataFrame) -> DataFrame:
    """The stored strings with their scopes and lists, for :func:`link_variants`.

    A list is one table in one season group, numbered within its league. Names of season groups that no league lists have
    no scope and are left out.
    """
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("league").orderBy("season_group_id")) - 1
    order = leagues.select("season_group_id", "league").distinct().withColumn("place", place)
    none = F.lit("")
    rows = players.select("season_group_id", F.lit("player").alias("kind"), F.coalesce("team_id", none).alias("team_id"), F.col("player_name").alias("name"), F.lit(0).alias("src")).distinct()
    rows = rows.unionByName(goalies.select("season_group_id", F.lit("player").alias("kind"), F.coalesce("team_id", none).alias("team_id"), F.col("goalie_name").alias("name"), F.lit(1).alias("src")).distinct())
    rows = rows.unionByName(standings.select("season_group_id", F.lit("team").alias("kind"), none.alias("team_id"), F.col("team_name").alias("name"), F.lit(0).alias("src")).distinct())
    number = (2 * F.col("place") + F.col("src")).cast("int")
    return rows.where("name is not null").join(order, "season_group_id").groupBy("kind", "league", "team_id", "name").agg(F.collect_set(number).alias("lists"))


def short_given_names(table: DataFrame) -> dict[str, str]:
    """Folded short form to folded formal name of the fixed nickname table (refused beyond 10,000 rows)."""
    rows = table.where("formal_name is not null and short_name is not null").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("the nickname table is sent to every worker and may have 10,000 rows at most")
    return {_spelling(r["short_name"]): _spelling(r["formal_name"]) for r in rows}
