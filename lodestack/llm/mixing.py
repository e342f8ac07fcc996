"""Mixing sources to target shares of tokens, by iterative proportional fitting.

Token weights are raked to the marginals of source, language and topic; documents are then taken by
calibrated probabilities. Only cells (source, language, topic) and weight histograms leave the executors.
"""

from __future__ import annotations

import base64
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.sources.tables import stored

BINS = 4096
#: topics, the dimensions of hashed words, the tasks of a pass that fits them; sums are of whole parts of one
TOPICS, TOPIC_DIMS, TOPIC_TASKS, _WHOLE = 12, 4096, 64, float(1 << 26)
#: texts whose words meet the topics at once: what is computed of them stays in a processor's cache
_CHUNK = 1000
_LONG_WORD = re.compile(r"[^\W\d_]{4,}")


def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, text: str, tokenizer_path: str, pattern: str, keep: list[str], topics: np.ndarray | None = None) -> DataFrame:
    """`keep` columns and n_tokens, by a public byte-pair vocabulary read on the executors; null text counts 0. With `topics` also the topic, in the same pass."""
    shared = docs.sparkSession.sparkContext.broadcast(topics)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(tokenizer_path, pattern)
        for pdf in batches:
            pdf["n_tokens"] = [len(enc.encode_ordinary(x)) if x else 0 for x in pdf[text]]
            if shared.value is not None:
                pdf["topic"] = [f"t{t:02d}" if t >= 0 else None for t in topic_of(pdf[text].tolist(), shared.value)]
            yield pdf.drop(columns=text)

    kinds = dict(docs.dtypes)
    return docs.select(*keep, text).mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", n_tokens long" + (", topic string" if topics is not None else ""))


def count_tokens_and_topics(docs: DataFrame, text: str, tokenizer_path: str, pattern: str, keep: list[str], doc_id: str = "doc_id") -> DataFrame:
    """`keep` columns, n_tokens and topic, the topics fitted on these documents: texts are read once, for tokens and hashed words alike."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(tokenizer_path, pattern)
        for pdf in batches:
            pdf["n_tokens"] = [len(enc.encode_ordinary(x)) if x else 0 for x in pdf[text]]
            pdf["at"], pdf["n"] = _packed(pdf.pop(text))
            yield pdf

    kinds = dict(docs.dtypes)
    own = ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", n_tokens long"
    counted = stored(docs.select(*keep, F.xxhash64(doc_id, F.lit("topic")).alias("h"), text).mapInPandas(
        lambda b: (p[[*keep, "n_tokens", "h", "at", "n"]] for p in run(b)), own + ", h long, at binary, n binary"))
    topics = _fit(counted)
    shared = docs.sparkSession.sparkContext.broadcast(topics)

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _chunks(batches):
            row = np.repeat(np.arange(len(pdf)), pdf["at"].str.len().to_numpy(np.int64) // 2)
            at = np.frombuffer(b"".join(pdf["at"]), np.uint16).astype(np.int64)
            near = _nearest(len(pdf), row, at, 1 + np.log(np.frombuffer(b"".join(pdf["n"]), np.int32)), shared.value)
            yield pdf[[*keep, "n_tokens"]].assign(topic=[f"t{t:02d}" if t >= 0 else None for t in near])

    return counted.mapInPandas(name, own + ", topic string")


def source_key(col: Column) -> Column:
    """Sources not written alike: blanks and case dropped, hyphens and spaces as underscores."""
    return F.regexp_replace(F.lower(F.trim(col)), r"[\s\-]+", "_")


def _vectors(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hashed word, dampened count) of the words of four letters and more."""
    row, at, n = [], [], []
    for i, x in enumerate(texts):
        seen = Counter(_LONG_WORD.findall(x.lower())) if x else {}
        row += [i] * len(seen)
        at += [zlib.crc32(w.encode("utf-8", "replace")) % TOPIC_DIMS for w in seen]
        n += [1 + math.log(c) for c in seen.values()]
    return np.array(row, np.int64), np.array(at, np.int64), np.array(n)


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for at in range(0, len(pdf), _CHUNK):
            yield pdf.iloc[at : at + _CHUNK]


def _weighed(batch: pd.DataFrame, idf: np.ndarray) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(vectors with some weight, text number, hashed word, unit weight, first place of each text)."""
    size = batch["at"].str.len().to_numpy(np.int64) // 2
    row, at = np.repeat(np.arange(len(batch)), size), np.frombuffer(b"".join(batch["at"]), np.uint16).astype(np.int64)
    x = (1 + np.log(np.frombuffer(b"".join(batch["n"]), np.int32))) * idf[at]
    length = np.sqrt(np.bincount(row, x * x, len(batch)))
    some = length > 0
    keep = some[row]
    row, at, x = (np.cumsum(some) - 1)[row[keep]], at[keep], x[keep] / length[row[keep]]
    return batch[some], row, at, x, np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else row


def fit_topics(docs: DataFrame, text: str, doc_id: str = "doc_id", n: int = TOPICS, seed: int = 11) -> np.ndarray:
    """Topics as directions in word space (words x topics, weighted by rarity): spherical k-means over all documents.

    Words are hashed once, to a stored table; each first centre (drawn by its distance from those there are, by a hash of its
    id) and each round is a pass over that table. Sums are of whole numbers, so no order shows; the driver holds words x topics.
    Fewer topics where there are fewer texts.
    """

    some = docs.filter(F.length(text) > 0).select(F.xxhash64(doc_id, F.lit("topic")).alias("h"), text)

    def hash_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["at"], pdf["n"] = _packed(pdf.pop(text))
            yield pdf

    return _fit(stored(some.mapInPandas(hash_, "h long, at binary, n binary")), n, seed)


def _packed(texts: Iterable[str | None]) -> tuple[list[bytes], list[bytes]]:
    """Of each text its hashed words of four letters and more, in order, and how often each comes."""
    places, counts, known = [], [], _Places()
    for x in texts:
        seen = Counter(_LONG_WORD.findall(x.lower())) if x else {}
        at, n = np.array([known[w] for w in seen], np.uint16), np.array(list(seen.values()), np.int32)
        order = np.lexsort((n, at))
        places.append(at[order].tobytes())
        counts.append(n[order].tobytes())
    return places, counts


class _Places(dict):
    """Words to their places, remembered for a batch."""

    def __missing__(self, w: str) -> int:
        got = self[w] = zlib.crc32(w.encode("utf-8", "replace")) % TOPIC_DIMS
        return got


def _fit(vectors: DataFrame, n: int = TOPICS, seed: int = 11) -> np.ndarray:
    """As fit_topics, of the stored table of hashed words: h, at, n."""
    vectors = vectors.select("h", "at", "n").filter(F.length("at") > 0)
    total = vectors.count()
    vectors = vectors.coalesce(TOPIC_TASKS)  # every task gives a sum of words x topics

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(TOPIC_DIMS, np.int64)
        for pdf in batches:
            held += np.bincount(np.frombuffer(b"".join(pdf["at"]), np.uint16), minlength=TOPIC_DIMS)
        yield pd.DataFrame({"word": np.flatnonzero(held), "held": held[held > 0]})

    held = np.zeros(TOPIC_DIMS)
    got = vectors.select("at").mapInPandas(words, "word int, held long").groupBy("word").agg(F.sum("held").alias("held")).toPandas()
    if got.empty:
        return np.zeros((TOPIC_DIMS, 1), np.float32)
    held[got["word"]] = got["held"]
    idf = np.log((1 + total) / (1 + held))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best, by_word = None, flat()
        for pdf in _chunks(batches):
            pdf, _, at, x, first = _weighed(pdf, idf)
            if not len(pdf):
                continue
            near = np.add.reduceat(by_word[at] * x[:, None].astype(np.float32), first).max(1) if len(centres) else np.zeros(len(pdf))
            far = np.maximum(1 - near, 0) ** 2
            with np.errstate(over="ignore"):
                z = pdf["h"].to_numpy().view(np.uint64) + np.uint64((seed * 1000 + len(centres) + 1) * 0x9E3779B97F4A7C15 % 2**64)
                z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            wait = -np.log(((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53 + 1e-17)
            wait = np.where(far > 1e-9, wait / np.maximum(far, 1e-9), np.inf)  # the first to come is drawn in proportion to `far`
            i = int(wait.argmin())
            if np.isfinite(wait[i]) and (best is None or wait[i] < best["wait"][0]):
                best = {"wait": [float(wait[i])], "h": [pdf["h"].iloc[i]], "at": [pdf["at"].iloc[i]], "n": [pdf["n"].iloc[i]]}
        if best:
            yield pd.DataFrame(best)

    centres = np.zeros((0, TOPIC_DIMS))
    flat = lambda: np.ascontiguousarray(centres.T, np.float32)
    while len(centres) < n:
        one = vectors.mapInPandas(draw, "wait double, h long, at binary, n binary").orderBy("wait", "h", "at", "n").limit(1).toPandas()
        if one.empty:
            break
        _, _, at, x, _ = _weighed(one, idf)
        centres = np.concatenate([centres, np.bincount(at, x, TOPIC_DIMS)[None]])
        centres[-1] /= np.sqrt((centres[-1] ** 2).sum())
    if not len(centres):
        return np.zeros((TOPIC_DIMS, 1), np.float32)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, by_word = np.zeros(len(centres) * TOPIC_DIMS, np.int64), flat()
        for pdf in _chunks(batches):
            pdf, row, at, x, first = _weighed(pdf, idf)
            if len(pdf):
                near = np.add.reduceat(by_word[at] * x[:, None].astype(np.float32), first).argmax(1)
                sums += np.rint(np.bincount(near[row] * TOPIC_DIMS + at, np.rint(x * _WHOLE), len(sums))).astype(np.int64)
        some = np.flatnonzero(sums)
        yield pd.DataFrame({"place": some, "value": sums[some]})

    for _ in range(15):
        got = vectors.mapInPandas(add, "place int, value long").groupBy("place").agg(F.sum("value").alias("value")).toPandas()
        fresh = np.zeros(centres.size)
        fresh[got["place"]] = got["value"] / _WHOLE
        fresh = fresh.reshape(centres.shape)
        none = ~fresh.any(1)
        fresh[none] = centres[none]
        fresh /= np.maximum(np.sqrt((fresh * fresh).sum(1, keepdims=True)), 1e-9)
        if np.abs(fresh - centres).max() < 1e-4:
            break
        centres = fresh
    return (centres * idf).T.astype(np.float32)


def topic_of(texts: list[str | None], topics: np.ndarray) -> np.ndarray:
    """The number of each text's topic; -1 for texts without words."""
    return _nearest(len(texts), *_vectors(texts), topics)


def _nearest(n: int, row: np.ndarray, at: np.ndarray, value: np.ndarray, topics: np.ndarray) -> np.ndarray:
    out = np.full(n, -1)
    if len(row):
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        out[row[first]] = np.add.reduceat(topics[at] * value[:, None].astype(np.float32), first).argmax(1)
    return out


def rake(cells: pd.DataFrame, targets: dict[str, float], caps: dict[str, float], rounds: int = 200) -> tuple[pd.DataFrame, float]:
    """Weights (expected repeats) per cell of columns source, lang, topic, tokens; and the total tokens of the mix.

    The total is the largest at which every source can reach its share within its cap. Sources come last in each
    round, so their shares hold exactly; language and topic follow the corpus as far as the caps allow.
    """
    c = cells[cells["source"].isin(targets) & (cells["tokens"] > 0)].reset_index(drop=True).copy()
    if c.empty:
        return c.assign(weight=[]), 0.0
    have = c.groupby("source")["tokens"].sum()
    share = pd.Series({s: targets[s] for s in have.index})
    share = share / share.sum()
    cap = c["source"].map(caps).to_numpy(float)
    total = float(min(have[s] * caps[s] / share[s] for s in have.index if share[s] > 0))
    tok = c["tokens"].to_numpy(float)
    base = tok * c["source"].map(share / have).to_numpy(float)
    want = {k: c.assign(b=tok).groupby(k)["b"].sum() / tok.sum() * total for k in ("lang", "topic")}
    w = base / tok * total
    for _ in range(rounds):
        before = w.copy()
        for k in ("lang", "topic"):
            now = pd.Series(w * tok).groupby(c[k]).sum()
            w = np.minimum(w * c[k].map(want[k] / now.where(now > 0, 1)).to_numpy(float), cap)
        for s in have.index:  # sources exactly, what a cap cuts off going to the source's other cells
            m = (c["source"] == s).to_numpy()
            goal = share[s] * total
            for _ in range(50):
                got = (w[m] * tok[m]).sum()
                if got <= 0 or abs(got - goal) <= 1e-9 * goal:
                    break
                w[m] = np.minimum(w[m] * goal / got, cap[m])
        if np.abs(w - before).max() < 1e-9:
            break
    return c.assign(weight=w), total


def mix_sources(docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(chosen documents, shares reached).

    `docs` has doc_id, source, lang, topic, n_tokens; `targets` has source, target_share, max_repeats. Chosen: doc_id,
    source, repeats, n_tokens, one row per document used. Shares: one row per target source. A document of weight w
    is used floor(w) times and once more with probability w - floor(w), decided by a hash of its id; the cut-off of
    the hash is calibrated per source on a histogram so that the tokens come out at the target. Never more than
    max_repeats. Sources without target, null sources and documents without tokens are not used; null language or
    topic is a class of its own. A source of the targets that has no documents reaches 0, the others are scaled up.
    """
    d = stored(docs.select(
        F.col(doc_id).alias("doc_id"), "source", F.coalesce("lang", F.lit("?")).alias("lang"), F.coalesce("topic", F.lit("?")).alias("topic"),
        F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens")))
    spark = docs.sparkSession
    goal = targets.toPandas()
    goals, caps = dict(zip(goal["source"], goal["target_share"].astype(float))), dict(zip(goal["source"], goal["max_repeats"].astype(float)))
    used = d.filter(F.col("source").isin(list(goals)) & (F.col("n_tokens") > 0))
    cells, total = rake(used.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens")).toPandas(), goals, caps)
    schema = "source string, lang string, topic string, weight double"
    weights = spark.createDataFrame([tuple(r) for r in cells[["source", "lang", "topic", "weight"]].itertuples(index=False)], schema)
    # cells are few: sources of the targets times languages times topics, the latter closed sets
    w = used.join(F.broadcast(weights), ["source", "lang", "topic"]).withColumns({
        "whole": F.floor(F.col("weight") + 1e-12), "part": F.col("weight") - F.floor(F.col("weight") + 1e-12)})
    draw = (F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 30)) + 0.5) / (1 << 30)
    w = w.withColumn("rank", F.when(F.col("part") > 1e-9, draw / F.col("part")))
    w = w.withColumn("bin", F.least(F.floor(F.col("rank") * (BINS // 4)), F.lit(BINS)).cast("int"))
    hist = w.groupBy("source", "bin").agg(
        F.sum(F.col("n_tokens") * F.col("whole")).alias("sure"), F.sum("n_tokens").alias("tokens")).toPandas()
    share = pd.Series(goals)[[s for s in goals if s in set(cells["source"])]] if len(cells) else pd.Series(dtype=float)
    cuts = []
    for s, h in hist.groupby("source"):
        rest = share[s] / share.sum() * total - h["sure"].sum()
        cum = h.dropna(subset=["bin"]).sort_values("bin")
        best, gap, run = -1, abs(rest), 0.0
        for b, t in zip(cum["bin"], cum["tokens"]):
            run += t
            if abs(rest - run) < gap:
                best, gap = int(b), abs(rest - run)
        cuts.append((s, best))
    cutoff = spark.createDataFrame(cuts, "source string, cut int")
    limit = spark.createDataFrame([(s, int(c)) for s, c in caps.items()], "source string, cap int")
    chosen = (
        w.join(F.broadcast(cutoff), "source").join(F.broadcast(limit), "source")
        .withColumn("repeats", F.least(F.col("whole") + F.coalesce((F.col("bin") <= F.col("cut")).cast("int"), F.lit(0)), F.col("cap")).cast("int"))
        .filter("repeats > 0").select("doc_id", "source", "lang", "topic", "n_tokens", "repeats")
    )
    got = chosen.groupBy("source").agg(
        F.count("*").alias("n_documents"), F.max("repeats").alias("most_repeats"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"))
    all_tokens = got.agg(F.sum("tokens").alias("all_tokens"))
    shares = targets.join(got, "source", "left").crossJoin(F.broadcast(all_tokens)).select(
        "source", "target_share", "max_repeats", F.coalesce("n_documents", F.lit(0)).cast("long").alias("n_documents"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"),
        F.round(F.coalesce(F.try_divide("tokens", "all_tokens"), F.lit(0.0)), 6).alias("share"))
    return chosen, shares
