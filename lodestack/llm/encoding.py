"""Garbled text from wrong decoding: found and repaired by expectation-maximisation over encoding chains.

A chain is a true encoding read as a wrong one, once or twice. For every word with characters outside ASCII
the chains that can be undone give candidate originals; a character model of sound words and the shares of
the chains per source are re-estimated together, so that weak evidence is pooled over all records of a
source. Each record is then repaired word by word by its posterior, its own words being pooled once more.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.sources.tables import stored

#: read as -> really; None in the third place: once, else the whole is undone so many times
CHAINS = [
    *((wrong, "utf-8", 1) for wrong in ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "iso8859-15", "cp1253", "cp1254", "koi8-r", "cp866", "cp852")),
    ("cp1252", "utf-8", 2), ("latin-1", "utf-8", 2), ("cp1252", "utf-8", 3), ("mac_roman", "utf-8", 2), ("cp437", "utf-8", 2),
    *((wrong, "cp1252", 1) for wrong in ("cp437", "cp850", "mac_roman", "cp1250", "cp1251", "cp1253", "koi8-r", "cp866", "cp852")),
    *(("cp1252", right, 1) for right in ("cp437", "cp850", "mac_roman")),
    ("latin-1", "cp850", 1), ("latin-1", "mac_roman", 1),
]
LOST = len(CHAINS)  # the chain whose bytes are gone: replacement characters
POOLS, BUCKETS = 1024, 1 << 18
#: rounds end when no chain's share of all words moves by more than SETTLED of itself (of one in a thousand, if it is rarer), and after ROUNDS
ROUNDS, SETTLED = 5, 0.1
_WORD = re.compile(r"[^ \t\n\r\f\v]+")
_SMOOTH, _BACK_OFF, _FLAG = 0.02, 2.0, 0.5


def _table(codec: str) -> dict[int, int]:
    """Character to byte; bytes that the codec leaves undefined stand for the control character of the same number."""
    out = {}
    for b in range(256):
        try:
            out[ord(bytes([b]).decode(codec))] = b
        except UnicodeDecodeError:
            out.setdefault(b, b)
    return out


_TABLES = {c: _table(c) for c in {w for w, _, _ in CHAINS}}
_READ = {r: [bytes([b]).decode(r, "replace") for b in range(256)] for r in {r for _, r, _ in CHAINS} - {"utf-8"}}


def _undo_once(word: str, wrong: str, right: str) -> tuple[str, bool] | None:
    """The word as it was before, and whether nothing of it is missing; None if this chain can't have made it."""
    table = _TABLES[wrong]
    try:
        raw = bytes(table[ord(c)] for c in word)
    except KeyError:
        return None
    if right != "utf-8":
        got = "".join(_READ[right][b] for b in raw)
        return None if got == word or "�" in got or any("\x7f" <= c <= "\x9f" or c < " " for c in got) else (got, True)
    try:
        return raw.decode("utf-8"), True
    except UnicodeDecodeError:
        got = raw.decode("utf-8", "replace")
        sound = sum(ord(c) > 127 and c != "�" for c in got)
        cut_off = len(re.findall(rb"[\xe2-\xef][\x80-\xbf](?![\x80-\xbf])", raw))
        return (got, False) if (sound and got.count("�") <= sound) or cut_off else None


@lru_cache(maxsize=200_000)
def candidates(word: str) -> tuple[tuple[int, str, bool], ...]:
    """(chain, original, whole) for every chain that can be undone; the fewest chains for equal originals."""
    if "�" in word:
        return ((LOST, word, False),)
    out, seen = [], {word}
    for k, (wrong, right, times) in enumerate(CHAINS):
        now, whole = word, True
        for _ in range(times):
            step = None if now.isascii() else _undo_once(now, wrong, right)
            if step is None:
                now = None
                break
            now, whole = step[0], whole and step[1]
        if now is None or now in seen or (times > 1 and not whole):
            continue
        if any(c < " " or "\x7f" <= c <= "\x9f" for c in now):
            continue  # half way: a longer chain leads on
        seen.add(now)
        out.append((k, now, whole))
    return tuple(out)


def _kind(c: str) -> str:
    o = ord(c)
    if c.isascii():
        return "w" if c.isalnum() else "p"
    if 0x2500 <= o <= 0x25FF:
        return "box"
    if 0x370 <= o <= 0x3FF:
        return "greek"
    if 0x400 <= o <= 0x4FF:
        return "cyrillic"
    if 0x80 <= o <= 0x9F:
        return "control"
    if o > 0x24F and c.isalpha() and not 0x1E00 <= o <= 0x1EFF:
        return "foreign"
    return "w" if c.isalpha() else "s"


def _mixed(word: str) -> bool:
    """Scripts or drawing characters that don't share a word with Latin letters, capitals amid small letters, signs between letters."""
    kinds = [_kind(c) for c in word]
    if "control" in kinds or ("w" in kinds and any(k in ("box", "greek", "cyrillic", "foreign") for k in kinds)):
        return True
    return any(a.islower() and not b.isascii() and (b.isupper() or kinds[i + 1] == "s" and b not in "’‘–—·²³₂°") and c.islower()
               for i, (a, b, c) in enumerate(zip(word, word[1:], word[2:])))


def _grams(word: str) -> tuple[list[int], list[int], list[int]]:
    """Buckets of the trigrams that touch a character outside ASCII, of their contexts, and of their last characters."""
    w = "\x02\x02" + word + "\x03"
    tri, ctx, one = [], [], []
    for i in range(len(w) - 2):
        a, b, c = ord(w[i]), ord(w[i + 1]), ord(w[i + 2])
        if c > 127 or b > 127 or a > 127:
            h = (a * 1_000_003 + b) * 1_000_003
            tri.append((h + c * 7919 + 1) % 2_305_843_009_213_693_951 % BUCKETS)
            ctx.append((h + 11) % 2_305_843_009_213_693_951 % BUCKETS)
            one.append((c * 104_729 + 5) % 2_305_843_009_213_693_951 % BUCKETS)
    return tri, ctx, one


class _Model:
    def __init__(self, tri: np.ndarray, ctx: np.ndarray, prior: dict[int, np.ndarray], default: np.ndarray):
        self.tri, self.ctx, self.prior, self.default = tri, ctx, prior, default
        self.all = float(tri.sum()) / 2 + 1.0  # every trigram is counted once for itself and once for its last character
        self.cache: dict[str, float] = {}
        self.plain: dict[tuple[int, str], bool] = {}

    def sound(self, pool: int, word: str) -> bool:
        """Whether nothing speaks for a chain, by the shares of the source alone; kept, as words recur."""
        got = self.plain.get((pool, word))
        if got is None:
            c = candidates(word)
            got = not c or self.posterior(word, c, self.prior.get(pool, self.default))[0] > 0.98
            if len(self.plain) < 300_000:
                self.plain[pool, word] = got
        return got

    def score(self, word: str) -> float:
        got = self.cache.get(word)
        if got is None:
            tri, ctx, one = _grams(word)
            chance = (self.tri[one] + _SMOOTH) / self.all
            got = float(np.log((self.tri[tri] + _BACK_OFF * chance) / (self.ctx[ctx] + _BACK_OFF)).sum()) if tri else 0.0
            got -= 9.0 * word.count("�") + 12.0 * sum("\x7f" <= c <= "\x9f" for c in word)
            if len(self.cache) < 300_000:
                self.cache[word] = got
        return got

    def posterior(self, word: str, cands, prior: np.ndarray) -> np.ndarray:
        """Of identity, then of each candidate."""
        if cands[0][0] == LOST:
            return np.array([0.0, 1.0])
        s = np.array([self.score(word)] + [self.score(x) for _, x, _ in cands])
        s += np.log(np.array([prior[-1]] + [prior[k] for k, _, _ in cands]))
        s = np.exp(s - s.max())
        return s / s.sum()


def _words(text: str) -> list[str]:
    return [] if text.isascii() else [w for w in _WORD.findall(text) if not w.isascii()]


def _pool(source: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(F.regexp_replace(F.lower(F.trim(source)), r"[\s\-]+", "_"), F.lit("?"))), F.lit(POOLS)).cast("int")


def _count_words(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: Counter = Counter()
            for pool, x in zip(pdf["pool"], pdf["text"]):
                for w in _words(x):
                    seen[pool, w] += 1
            yield pd.DataFrame([(p, w, n) for (p, w), n in seen.items()], columns=["pool", "word", "n"])

    return docs.mapInPandas(run, "pool int, word string, n long").groupBy("pool", "word").agg(F.sum("n").alias("n"))


def _expect(words: DataFrame, model: _Model | None) -> DataFrame:
    """One pass: expected counts of trigrams (kind 0), contexts (1), and of each chain per pool (2)."""
    shared = words.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        tri, ctx, chain = np.zeros(BUCKETS), np.zeros(BUCKETS), Counter()
        for pdf in batches:
            for pool, w, n in zip(pdf["pool"], pdf["word"], pdf["n"]):
                c = candidates(w)
                if not c:
                    post = [1.0]
                elif c[0][0] == LOST:
                    post = [0.0, 0.0]
                elif m is None:  # first guess: UTF-8 that can be undone hardly ever is chance; single bytes only in odd company
                    odd = _mixed(w)
                    multi = [i for i, (k, x, _) in enumerate(c) if CHAINS[k][1] == "utf-8" and (odd or not _mixed(x))]
                    if multi:
                        best = max(multi, key=lambda i: (c[i][2], CHAINS[c[i][0]][2], -i))
                        post = [0.02] + [0.98 * (i == best) for i in range(len(c))]
                    else:
                        post = [0.05 if odd else 1.0] + [0.0] * len(c)
                else:
                    post = m.posterior(w, c, m.prior.get(pool, m.default))
                for x, p in zip([w, *(x for _, x, _ in c)], post):
                    if p > 1e-4:
                        a, b, one = _grams(x)
                        np.add.at(tri, a, n * p)
                        np.add.at(tri, one, n * p)
                        np.add.at(ctx, b, n * p)
                chain[pool, -1] += n * float(post[0])
                for (k, _, _), p in zip(c, post[1:]):
                    if p > 1e-4:
                        chain[pool, k] += n * float(p)
        i, j = np.flatnonzero(tri), np.flatnonzero(ctx)
        yield pd.DataFrame({"kind": 0, "pool": i, "chain": 0, "n": tri[i]})
        yield pd.DataFrame({"kind": 1, "pool": j, "chain": 0, "n": ctx[j]})
        yield pd.DataFrame([(2, p, k, v) for (p, k), v in chain.items()], columns=["kind", "pool", "chain", "n"])

    return words.mapInPandas(run, "kind int, pool int, chain int, n double").groupBy("kind", "pool", "chain").agg(F.sum("n").alias("n"))


def fit(words: DataFrame, rounds: int = ROUNDS) -> _Model:
    """EM over the counted words, until it settles. Sources share POOLS classes of shares by a hash, each half those of all. What reaches the driver is bounded: two tables of BUCKETS numbers, POOLS x chains shares."""
    model, before = None, None
    for _ in range(rounds):
        got = _expect(words, model).toPandas()
        tri, ctx = np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32)
        a, b, c = (got[got["kind"] == k] for k in (0, 1, 2))
        tri[a["pool"].to_numpy(int)], ctx[b["pool"].to_numpy(int)] = a["n"], b["n"]
        width = len(CHAINS) + 2  # the last place is that of identity
        total, prior = np.full(width, 1e-2), {}
        for k, n in zip(c["chain"], c["n"]):
            total[k if k >= 0 else width - 1] += n
        total /= total.sum()
        for pool, rows in c.groupby("pool"):
            v = 50 * total
            for k, n in zip(rows["chain"], rows["n"]):
                v[k if k >= 0 else width - 1] += n
            # half its own shares, half those of all sources: a chain rare everywhere isn't ruled out in a large source
            prior[int(pool)] = np.maximum(0.5 * v / v.sum() + 0.5 * total, 1e-7)
        model = _Model(tri, ctx, prior, np.maximum(total, 1e-7))
        if before is not None and (np.abs(total - before) <= SETTLED * np.maximum(before, 1e-3)).all():
            break
        before = total
    return model


def repair_text(text: str, model: _Model, pool: int) -> tuple[str, int, int, str] | None:
    """(restored text, words garbled, of these not wholly restored, commonest chain); None for a sound text."""
    words = _words(text)
    n = Counter(words)
    if all(model.sound(pool, w) for w in n):
        return None
    found = {w: c for w in n if (c := candidates(w))}
    source = model.prior.get(pool, model.default)
    prior, post = source, {}
    for _ in range(2):  # the record's own words pooled: a chain met once is likelier in the rest of the record
        post = {w: model.posterior(w, c, prior) for w, c in found.items()}
        mix = 4.0 * source
        for w, c in found.items():
            for (k, _, _), p in zip(c, post[w][1:]):
                if p > 0.05:
                    mix[k] += n[w] * p
        mix[-1] += sum(n[w] * (post[w][0] if w in post else 1.0) for w in n)
        prior = np.maximum(mix / mix.sum(), 1e-7)
    fixed, bad, lost, chains = {}, 0, 0, Counter()
    for w, c in found.items():
        p = post[w]
        if p[0] >= _FLAG:
            continue
        i = int(np.argmax(p[1:]))
        k, x, whole = c[i]
        bad += n[w]
        lost += n[w] * (not whole)
        chains[k] += n[w]
        fixed[w] = x  # where bytes are missing it holds a mark
    if not bad:
        return None
    k = chains.most_common(1)[0][0]
    name = "lost" if k == LOST else "{1} read as {0}".format(*CHAINS[k]) + (f", {CHAINS[k][2]} times" if CHAINS[k][2] > 1 else "")
    return _WORD.sub(lambda m: fixed.get(m.group(), m.group()), text), bad, lost, name


def repair_encoding(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per garbled record: doc_id, restored_text, n_garbled, n_lost, chain.

    n_lost counts words of which bytes are gone (they show a replacement character where the source has none to
    give back). Null, empty and pure ASCII texts are sound. Records of a null source form a class of their own; spellings
    of a source that differ in case, blanks or hyphens are one. Repeated ids are judged each for themselves; an empty
    table gives no rows; further columns are not read. Texts are read whole, twice: once to count their words, once
    to repair them.
    """
    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), _pool(F.col(source)).alias("pool")).filter(
        F.col("text").rlike(r"[^\x00-\x7F]"))
    model = fit(stored(_count_words(rows.select("pool", "text"))))
    model.cache = {}
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            out = [(i, *r) for i, x, p in zip(pdf["doc_id"], pdf["text"], pdf["pool"]) if (r := repair_text(x, m, p))]
            yield pd.DataFrame(out, columns=["doc_id", "restored_text", "n_garbled", "n_lost", "chain"])

    return rows.mapInPandas(run, f"doc_id {kind}, restored_text string, n_garbled int, n_lost int, chain string")
