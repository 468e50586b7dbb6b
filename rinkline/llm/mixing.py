"""Mixing sources to target shares of all tokens, small sources repeated a capped number of times (problem 9).

A classifier fitted on a table of labelled documents (their written sources) gives every document soft memberships: the
posteriors of the sources. Nonnegative rates (expected uses) of the documents are then fitted by projected-gradient least
squares, so that the sources' token totals meet the targets twice: by written source, and in expectation under the
memberships. The totals by written source are met from the start and are held: after each step along the gradient of the
totals under the memberships, the rates of a source are shifted together until its total is the target again. Each round
the cluster sums the totals of all documents, for a fixed number of shifts; only these sums reach the driver, and the
rates of a document follow from the sums of the rounds so far, so nothing of the size of the documents is stored between
rounds.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rinkline.llm.tokens import VOCABULARY, encoder
from rinkline.operators.staging_area import staged

SAMPLE = 20_000  # labelled documents the classifier is fitted on, about
FEATURES = 1 << 14
SOURCES = 1_000  # sources, and rows of targets, at most
ROUNDS = 15  # of the gradient, at most
SOFT = 0.02  # weight of the totals under the memberships against those by written source, which must be met
SHIFTS = 65  # tried each round; fewer for mixes of very many sources, whose next rounds make up for it
BUCKETS = 4096
HELD = 1 << 26  # bytes of known pieces a worker holds, about

_WORD = re.compile(r"[^\W\d_]+")
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # the tokenizer's; Python's has four more
_PIECE = re.compile(f"[{_SPACE}]?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])")


class Pieces(dict):
    """Pieces of texts (signs without space between, with the last space before them; what other space there is), with
    their tokens and hashed words, worked out once and forgotten beyond ``HELD``. Neither a word nor a match of the
    tokenizer's pattern reaches from one piece into the next, so the tokens of a text are the sum of its pieces'."""

    def __init__(self, enc=None):
        self.enc = enc
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.held, self.tokens, self.words, self.ends = 0, array("q"), array("q"), array("q", [0])

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        self.tokens.append(len(self.enc.encode_ordinary(piece)) if self.enc else 0)
        self.words.extend(zlib.crc32(w.encode()) % FEATURES for w in _WORD.findall(piece.lower()))
        self.ends.append(len(self.words))
        self.held += 150 + 4 * len(piece)
        return n

    def counted(self, texts: Iterable[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each text its tokens (0 without an encoder), its hashed words and how often each stands in it."""
        cut: list[np.ndarray] = []
        n = 0
        for text in texts:
            pieces = _PIECE.findall(text or "")
            cut.append(np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces)))
            n += len(pieces)
            if n > 500_000 or self.held > HELD:
                yield from self._summed(cut)
                cut, n = [], 0
                if self.held > HELD:
                    self.forget()
        if cut:
            yield from self._summed(cut)

    def _summed(self, cut: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        tokens, words, ends = (np.array(x, dtype=np.int64) for x in (self.tokens, self.words, self.ends))
        piece, text = np.concatenate(cut), np.repeat(np.arange(len(cut)), [len(x) for x in cut])
        sizes = np.bincount(text, tokens[piece], len(cut))
        many = np.diff(ends)[piece]
        at = np.repeat(ends[piece] + many - np.cumsum(many), many) + np.arange(many.sum())
        keys, times = np.unique(np.repeat(text, many) * FEATURES + words[at], return_counts=True)
        bounds = np.searchsorted(keys, np.arange(len(cut) + 1) * FEATURES)
        keys %= FEATURES
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            yield int(sizes[i]), keys[a:b], times[a:b]


_known: dict[str, Pieces] = {}


def pieces_of(vocabulary: str) -> Pieces:
    """The pieces a worker knows under a vocabulary."""
    if vocabulary not in _known:
        _known[vocabulary] = Pieces(encoder(vocabulary))
    return _known[vocabulary]


@dataclass(frozen=True)
class Classifier:
    """Multinomial naive Bayes on hashed words."""

    names: list[str]
    prior: np.ndarray
    words: np.ndarray  # a row for each hashed word

    def posteriors(self, text: str | None) -> np.ndarray:
        return self.posteriors_by([next(Pieces().counted([text]))[1:]])[0]

    def posteriors_by(self, counts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """A row for each text, by its hashed words and how often each stands in it."""
        z = np.tile(self.prior, (len(counts), 1))
        if self.names:
            for i, (f, n) in enumerate(counts):
                z[i] += np.log1p(n) @ self.words[f] / np.sqrt(1 + len(f))
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
        return z


def fit_classifier(labelled: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Fitted on a sample of about ``sample`` documents of ``labelled(doc_id, source, text)``, drawn by a threshold on the
    hash of their ids. The sums it needs are made by the cluster: one row of word counts per source and task."""
    known = labelled.where("source is not null and text is not null")
    share = min(1.0, sample / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("source", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: dict[str, np.ndarray] = {}
        n: Counter = Counter()
        known = Pieces()
        for pdf in batches:
            for s, (_, f, times) in zip(pdf["source"], known.counted(pdf["text"]), strict=True):
                n[s] += 1
                words.setdefault(s, np.zeros(FEATURES))[f] += np.log1p(times)
        yield pd.DataFrame([(s, int(k), words.get(s, np.zeros(FEATURES))) for s, k in n.items()], columns=["source", "n", "w"])

    parts = drawn.mapInPandas(count, "source string, n long, w array<double>")
    rows = parts.select("source", "n", F.posexplode("w").alias("k", "w")).where("w > 0 or k = 0").groupBy("source", "k").agg(F.sum("w").alias("w"), F.sum(F.when(F.col("k") == 0, F.col("n"))).alias("n")).toPandas()  # sources x FEATURES at most
    names = sorted(rows["source"].unique())
    if len(names) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    at = {s: i for i, s in enumerate(names)}
    counts, prior = np.full((FEATURES, len(names)), 0.1), np.ones(len(names))
    of = rows["source"].map(at).to_numpy(dtype=int)
    counts[rows["k"].to_numpy(dtype=int), of] += rows["w"].to_numpy()
    np.add.at(prior, of, rows["n"].fillna(0).to_numpy())
    return Classifier(names, np.log(prior / prior.sum()), np.log(counts / counts.sum(axis=0)))


def sized_members(docs: DataFrame, model: Classifier, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, source, tokens, member)`` of ``docs(doc_id, source, text)``: tokens and posteriors of every document, whole
    texts, in one pass, written once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = pieces_of(vocabulary)
        for pdf in batches:
            counted = list(known.counted(pdf.pop("text")))
            pdf["tokens"] = [n for n, _, _ in counted]
            pdf["member"] = list(model.posteriors_by([c for _, *c in counted]))
            yield pdf

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").alias("text"))
    return staged(rows.mapInPandas(run, "doc_id long, source string, tokens long, member array<float>"), "p9-members")


@dataclass
class Mix:
    """One mix: its sources, their shares of the total and caps, and the gradients of the rounds so far."""

    name: str
    sources: list[str]
    share: np.ndarray
    cap: np.ndarray
    columns: list[int]  # the sources' places among the classifier's, -1 for one it does not know
    total: float = 0.0
    start: np.ndarray = field(default_factory=lambda: np.zeros(0))
    step: float = 0.0
    past: list[np.ndarray] = field(default_factory=list)  # of each round: shifts by written source, residuals by membership
    pull: np.ndarray = field(default_factory=lambda: np.zeros(0))  # residuals by membership for the next round
    middle: np.ndarray = field(default_factory=lambda: np.zeros(0))  # mean memberships of each source's tokens
    before: np.ndarray = field(default_factory=lambda: np.zeros(0))  # residuals by membership of the last rates

    def inside(self, source: pd.Series, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of each document's written source (-1: none), its memberships among the mix's sources, its cap. A document
        without a written source takes part if it rather belongs to the mix's sources than to others."""
        at = source.map({s: i for i, s in enumerate(self.sources)}).fillna(-1).to_numpy(dtype=int)
        p = np.zeros((len(source), len(self.sources)))
        for i, k in enumerate(self.columns):
            if k >= 0 and member.shape[1]:
                p[:, i] = member[:, k]
        whole = p.sum(axis=1)
        soft = source.isna().to_numpy() & (whole > 0.5)
        p = p / np.maximum(whole, 1e-9)[:, None]
        least = np.where(p > 0, self.cap, np.inf).min(axis=1, initial=np.inf)
        cap = np.where(at >= 0, self.cap[at], np.where(soft, np.where(np.isfinite(least), least, 0.0), 0.0))
        return at, p, cap

    def rates(self, at: np.ndarray, p: np.ndarray, cap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The documents' rates after the rounds so far (accelerated projected gradient, replayed), and the point at which
        the next gradient is taken."""
        r = np.minimum(np.where(at >= 0, self.start[at], self.start.mean() if len(self.start) else 0.0), cap)
        y, before, k = r, r, len(self.sources)
        for n, e in enumerate(self.past):
            r = np.clip(y - self.step * (p @ e[k:]) - np.where(at >= 0, e[:k][at], 0.0), 0.0, cap)
            y, before = r + n / (n + 3) * (r - before), r
        return r, y

    def shifts(self) -> np.ndarray:
        """Shifts of each source's rates that are tried in the next round, around the one that keeps the mean rate."""
        widest = 2 * self.step * np.ptp(self.pull) + 1e-9 + self.cap.max(initial=0.0) / 8
        x = np.linspace(-1, 1, max(5, min(SHIFTS, 2_000_000 // (len(self.sources) + 1) ** 2 | 1)))
        return -self.step * (self.middle @ self.pull)[:, None] + widest * np.sign(x) * x**2

    def _pulled(self, soft: np.ndarray) -> np.ndarray:
        """The gradient by membership: documents without a written source add to the whole, so a document counts by how much
        it differs from the shares that there are."""
        return soft - (self.share + soft) @ soft

    def opened(self, sums: np.ndarray) -> None:
        """Takes the sums at the start: the memberships of the rates, those of the tokens by source (none last), and their
        products. The step is the inverse of the largest curvature left when the sources' means are held."""
        k = len(self.sources)
        used, held, both = sums[0], sums[1 : k + 2], sums[k + 2 :]
        tokens = np.maximum(held.sum(axis=1), 1e-9)
        self.middle = held[:k] / tokens[:k, None]
        spread = both - self.middle.T @ held[:k]
        steepest = float(np.linalg.eigvalsh((spread + spread.T) / 2)[-1]) / self.total if self.total else 0.0
        self.step = 1 / steepest if steepest > 1e-9 * tokens.sum() / max(self.total, 1e-9) else 0.0
        self.before = used / max(used.sum(), 1e-9) - self.share
        self.pull = self._pulled(self.before)

    def moved(self, sums: np.ndarray) -> np.ndarray:
        """Takes the sums of a round, (source, shift, tokens and memberships): the shifts that hold the totals by written
        source, and the residuals by membership there. Returns the residuals: by written source, then by membership."""
        k, tried = len(self.sources), self.shifts()
        shift, got = np.zeros(k), sums[k, 0, 1:].copy()
        written = np.zeros(k)
        for i in range(k):
            total = sums[i, :, 0]
            shift[i] = np.interp(-self.total * self.share[i], -total, tried[i]) if total[0] > total[-1] else 0.0
            written[i] = np.interp(shift[i], tried[i], total) / self.total - self.share[i]
            got += [np.interp(shift[i], tried[i], sums[i, :, 1 + j]) for j in range(k)]
        soft, n = got / max(got.sum(), 1e-9) - self.share, len(self.past)
        self.past.append(np.concatenate((shift, self.pull)))
        self.pull, self.before = self._pulled(soft + n / (n + 3) * (soft - self.before)), soft
        return np.concatenate((written, soft))


def _members(pdf: pd.DataFrame, k: int) -> np.ndarray:
    return np.stack(pdf["member"].to_numpy()).astype(float) if len(pdf) and k else np.zeros((len(pdf), k))


def mixes_of(docs: DataFrame, targets: DataFrame, names: list[str]) -> list[Mix]:
    """The mixes of a fixed table of targets (refused beyond ``SOURCES`` rows), with the largest totals that the caps allow."""
    wanted = targets.where("target_share is not null").select("mix_name", "source", "target_share", "max_repeats").limit(SOURCES + 1).collect()
    held = {r["source"]: float(r["t"]) for r in docs.where("source is not null").groupBy("source").agg(F.sum("tokens").alias("t")).join(targets.select("source").distinct(), "source").collect()}
    if len(wanted) > SOURCES:
        raise ValueError(f"more than {SOURCES} rows of targets")
    out = []
    for name in sorted({w["mix_name"] for w in wanted}):
        mine = [w for w in wanted if w["mix_name"] == name and held.get(w["source"]) and w["target_share"] > 0]
        if not mine:
            continue
        share = np.array([float(w["target_share"]) for w in mine])
        cap = np.array([float(w["max_repeats"] if w["max_repeats"] is not None else 1) for w in mine])
        tokens = np.array([held[w["source"]] for w in mine])
        share = share / share.sum()
        m = Mix(name, [w["source"] for w in mine], share, cap, [names.index(w["source"]) if w["source"] in names else -1 for w in mine])
        m.total = float(np.min(tokens * cap / share))
        m.start = m.total * share / tokens
        out.append(m)
    return out


def _summed(docs: DataFrame, mixes: list[Mix], sums_of) -> dict[str, np.ndarray]:
    """``sums_of(mix, at, p, cap, tokens)`` of each mix, added up over all documents by the cluster."""
    k = max((i + 1 for m in mixes for i in m.columns), default=0)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got: dict[str, np.ndarray] = {}
        for pdf in batches:
            member, tokens = _members(pdf, k), pdf["tokens"].to_numpy().astype(float)
            for m in mixes:
                at, p, cap = m.inside(pdf["source"], member)
                mine = cap > 0
                got[m.name] = got.get(m.name, 0.0) + sums_of(m, at[mine], p[mine], cap[mine], tokens[mine])
        yield pd.DataFrame([(n, i, float(x)) for n, v in got.items() for i, x in enumerate(v.ravel()) if x], columns=["mix", "i", "x"])

    rows = docs.select("source", "tokens", "member").mapInPandas(sums, "mix string, i long, x double").groupBy("mix", "i").agg(F.sum("x").alias("x")).toPandas()
    none = {m.name: sums_of(m, np.zeros(0, dtype=int), np.zeros((0, len(m.sources))), np.zeros(0), np.zeros(0)) for m in mixes}
    for n, v in none.items():
        mine = rows[rows["mix"] == n]
        v.ravel()[mine["i"].to_numpy(dtype=int)] = mine["x"].to_numpy()
    return none


def _opening(m: Mix, at: np.ndarray, p: np.ndarray, cap: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    held = p * tokens[:, None]
    by_source = [held[at == (i if i < len(m.sources) else -1)].sum(axis=0) for i in range(len(m.sources) + 1)]
    return np.stack([m.rates(at, p, cap)[0] @ held, *by_source, *(p.T @ held)])


def _round(m: Mix, at: np.ndarray, p: np.ndarray, cap: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    k, tried = len(m.sources), m.shifts()
    z, weighted = m.rates(at, p, cap)[1] - m.step * (p @ m.pull), np.concatenate((np.ones((len(p), 1)), p), axis=1) * tokens[:, None]
    out = np.zeros((k + 1, tried.shape[1], k + 1))
    for i in range(k + 1):
        mine = at == (i if i < k else -1)
        zi, most, wi = z[mine], cap[mine], weighted[mine]
        for g, x in enumerate(tried[i] if i < k else [0.0]):
            out[i, g] = np.clip(zi - x, 0.0, most) @ wi
    return out


def fit_rates(docs: DataFrame, mixes: list[Mix], rounds: int = ROUNDS) -> list[Mix]:
    """Rounds of projected gradient, with momentum: the cluster sums the tokens that the rates of all documents give each
    source, by written source and by membership, for every shift tried; the differences from the targets under the
    memberships are the gradient of the next round, and the shifts hold the totals by written source."""
    mixes = [m for m in mixes if m.total]
    if not mixes or rounds < 1:
        return mixes
    opening = _summed(docs, mixes, _opening)
    for m in mixes:
        m.opened(opening[m.name])
    error: dict[str, float] = {}
    for _ in range(rounds):
        got = _summed(docs, mixes, _round)
        moving = False
        for m in mixes:
            residual, k = m.moved(got[m.name]), len(m.sources)
            now = float(np.sum(residual[:k] ** 2) + SOFT * np.sum(residual[k:] ** 2))
            moving |= abs(error.get(m.name, np.inf) - now) > 0.002 * now + 1e-10
            error[m.name] = now
        if not moving:
            break
    return mixes


def draws(docs: DataFrame, targets: DataFrame, names: list[str], rounds: int = ROUNDS) -> DataFrame:
    """``(mix_name, doc_id, source, tokens, repeats)``: the documents of each mix and how often each is repeated.

    ``docs`` has ``(doc_id, source, tokens, member)``, ``member`` in the order of ``names``. A rate of 2.3 repeats a document
    twice and, with a chance of 0.3 by a hash, a third time; within each source the chances are cut where running totals
    over a fixed number of buckets come nearest to the source's target, so that rounding loses no share. Counts combine
    map-side; the cuts are as many as sources and mixes. No document is repeated more often than its source may be, and
    none is split.

    Defined results: documents without a written source take part by membership; sources outside a mix take no part in
    it; sources without documents leave their share to the others in proportion; documents without tokens follow their
    rates; repeated rows are drawn each; an empty table gives no rows; other columns are ignored.
    """
    mixes = fit_rates(docs, mixes_of(docs, targets, names), rounds)
    k = max((i + 1 for m in mixes for i in m.columns), default=0)

    def rated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            member, u = _members(pdf, k), pdf["u"].to_numpy()
            for m in mixes:
                at, p, cap = m.inside(pdf["source"], member)
                rate = m.rates(at, p, cap)[0]
                whole = np.floor(rate + 1e-9)
                part = np.maximum(rate - whole, 0.0)
                with np.errstate(divide="ignore", invalid="ignore"):
                    chance = np.where(part > 1e-9, np.minimum(u / part, 4.0), 5.0)
                out = pd.DataFrame({"mix_name": m.name, "doc_id": pdf["doc_id"], "source": pdf["source"], "tokens": pdf["tokens"], "whole": whole.astype("int32"), "bucket": np.where(chance > 4, -1, chance * BUCKETS).astype("int32"), "part": part})
                yield out[(whole > 0) | (part > 1e-9)]

    u = (F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 40)) + 0.5) / (1 << 40)
    used = staged(docs.select("doc_id", "source", "tokens", "member", u.alias("u")).mapInPandas(rated, "mix_name string, doc_id long, source string, tokens long, whole int, bucket int, part double"), "p9-rates")
    used = used.withColumn("s", F.coalesce("source", F.lit("")))
    sums = used.groupBy("mix_name", "s", "bucket").agg(F.sum(F.when(F.col("bucket") >= 0, F.col("tokens")).otherwise(0)).alias("t"), F.sum(F.col("tokens") * F.col("whole")).alias("base"), F.sum(F.col("tokens") * F.col("part")).alias("extra"))
    of = Window.partitionBy("mix_name", "s")
    aims = docs.sparkSession.createDataFrame([(m.name, s, float(m.total * x)) for m in mixes for s, x in zip(m.sources, m.share, strict=True)], "mix_name string, s string, aim double")
    running = of.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumns({"upto": F.sum("t").over(running), "want": F.sum("base").over(of), "soft": F.sum("extra").over(of)}).join(aims, ["mix_name", "s"], "left").withColumn("want", F.coalesce(F.col("aim") - F.col("want"), F.col("soft")))
    cuts = sums.where("bucket >= 0 and want > 0").where(F.col("upto") - F.col("t") / 2 <= F.col("want")).groupBy("mix_name", "s").agg(F.max("bucket").alias("cut"))
    out = used.join(cuts, ["mix_name", "s"], "left")
    repeats = F.col("whole") + F.when((F.col("bucket") >= 0) & (F.col("bucket") <= F.col("cut")), 1).otherwise(0)
    return out.select("mix_name", "doc_id", "source", "tokens", repeats.cast("int").alias("repeats")).where("repeats > 0")


def reached_shares(drawn: DataFrame, docs: DataFrame, targets: DataFrame, names: list[str]) -> DataFrame:
    """``(mix_name, source, target_share, reached_share, expected_share, tokens, mean_repeats, max_repeats)``: what each mix
    came to, by written source and, in expectation, by the memberships of the documents drawn."""
    uses = F.col("tokens") * F.col("repeats")
    got = drawn.groupBy("mix_name", "source").agg(F.sum(uses).alias("tokens"))
    held = docs.groupBy("source").agg(F.sum("tokens").alias("held"))
    listed = targets.groupBy("mix_name").agg(F.collect_set("source").alias("listed"))
    soft = drawn.groupBy("doc_id", "mix_name").agg(F.sum(uses).alias("uses")).join(docs.select("doc_id", "member").dropDuplicates(["doc_id"]), "doc_id").join(listed, "mix_name")
    soft = soft.select("mix_name", "uses", "listed", F.posexplode("member").alias("k", "p")).select("mix_name", "uses", F.get(F.array(*map(F.lit, names)) if names else F.array().cast("array<string>"), F.col("k")).alias("source"), "p", "listed")
    soft = soft.where(F.array_contains("listed", F.col("source"))).groupBy("mix_name", "source").agg(F.sum(F.col("uses") * F.col("p")).alias("e"))
    soft = soft.withColumn("expected_share", F.round(F.col("e") / F.sum("e").over(Window.partitionBy("mix_name")), 6)).drop("e")
    rows = targets.join(got, ["mix_name", "source"], "left").join(held, "source", "left").join(soft, ["mix_name", "source"], "left")
    all_of = F.sum(F.coalesce("tokens", F.lit(0))).over(Window.partitionBy("mix_name"))
    return rows.select("mix_name", "source", "target_share", F.round(F.coalesce("tokens", F.lit(0)) / F.greatest(F.lit(1), all_of), 6).alias("reached_share"), F.coalesce("expected_share", F.lit(0.0)).alias("expected_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.round(F.coalesce("tokens", F.lit(0)) / F.greatest(F.lit(1), "held"), 6).alias("mean_repeats"), "max_repeats")
