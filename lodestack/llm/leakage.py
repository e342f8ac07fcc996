"""Evaluation passages leaking into training text, found with suffix arrays over shards of the corpus.

Texts become sequences of word numbers (case, accents, punctuation, markup, hyphenation and layout gone).
Every shard sorts its suffixes in full, all test suffixes are binary-searched in it, and each longest verbatim match is
extended over an occasional changed, added or lost word.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: words of a passage that make a leak, share of them that must agree
MIN_WORDS, MIN_AGREE = 25, 0.85
#: words of a verbatim match to start from: of n >= 25 words with at most 15 % changed, some 5 stand unchanged in a row
SEED_WORDS = 5
#: a run of words that stands in more items than this is common wording; a match starts from it only with the words that make it rarer
COMMON_ITEMS = 64
#: of the words about a seed so many must agree, on a diagonal no further off than this, before it is looked at closely: any NEAR_WORDS
#: of a leak's window of 25 hold at least 17 (of 25 agree 22)
NEAR_WORDS, NEAR_AGREE, NEAR_SHIFT = 20, 15, 3
#: characters of text sorted at once; a single longer text is a shard of its own
SHARD_CHARS = 6_000_000
#: the held-out side is sent to every executor; a larger one is searched in several passes of this size
EVAL_CHARS = 16_000_000
_INLINE = re.compile(r"</?(?:b|i|u|em|strong|span|a|sup|sub|code|mark|font|small|tt|s)(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
_LINK = re.compile(r"\]\([^()\s]*\)")
_BREAK = re.compile(r"[-­‐‑]\s*\n\s*")
_SPELT = [("ß", "ss"), ("ẞ", "ss"), ("œ", "oe"), ("Œ", "oe"), ("æ", "ae"), ("Æ", "ae"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("\r", "\n")]
_SKIP, _HYPHEN = 1, 2


@lru_cache(maxsize=1)
def _codes() -> np.ndarray:
    """Per code point: 0 between words, 1 nothing, 2 a hyphen inside a word, else the plain lower-case character."""
    lut = np.zeros(0x110000, np.uint32)
    lut[0xE0000:0xE0200] = _SKIP  # tags and selectors; no letter stands above the third plane's
    for o in range(0x32400):
        c = chr(o)
        kind = unicodedata.category(c)
        if kind in ("Mn", "Me", "Cf") or c in "*_`~":
            lut[o] = _SKIP
        elif c in "-‐‑":
            lut[o] = _HYPHEN
        elif c.isalnum():
            plain = [x for x in unicodedata.normalize("NFKD", c.lower()) if x.isalnum()]
            lut[o] = ord(plain[0]) if plain else o
    return lut


def _plain(text: str) -> str:
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    if "](" in text:
        text = _LINK.sub("]", text)
    return text.replace("\x00", " ")


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit word hashes, hyphens inside each word, number of the text each word is in), in order."""
    s = "\x00".join(_plain(t) for t in texts)
    for a, b in _SPELT:
        if a in s:
            s = s.replace(a, b)
    s = _BREAK.sub("-", s)
    raw = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    code = _codes()[raw]
    doc_at = np.cumsum(raw == 0, dtype=np.int32)
    keep = code != _SKIP
    code, doc_at = code[keep], doc_at[keep]
    letter = code > _HYPHEN
    inside = np.zeros(len(code), bool)
    if len(code) > 2:  # a hyphen joins what stands on both its sides
        inside[1:-1] = (code[1:-1] == _HYPHEN) & letter[:-2] & letter[2:]
    word = letter | inside
    start = np.flatnonzero(word & ~np.r_[False, word[:-1]])
    if not len(start):
        e = np.zeros(0, np.int64)
        return e.astype(np.uint64), e, e
    end = np.flatnonzero(word & ~np.r_[word[1:], False]) + 1
    base = np.uint64(0x9E3779B97F4A7C15)
    # position inside the word, hyphens not counted
    real = np.cumsum(letter)
    first = np.repeat(start, end - start)
    pos = (real[np.flatnonzero(word)] - real[first]).astype(np.int64)
    top = int(pos.max()) + 1
    powers = np.ones(min(top, 1 << 16), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(1, len(powers)):
            powers[i] = powers[i - 1] * base
        val = np.where(letter[word], (code[word].astype(np.uint64) + np.uint64(1)) * powers[np.minimum(pos, len(powers) - 1)], np.uint64(0))
        offsets = np.r_[0, np.cumsum(end - start)[:-1]]
        h = np.add.reduceat(val, offsets)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    hyphens = np.add.reduceat(inside[word].astype(np.int64), offsets)
    return h, hyphens, doc_at[start].astype(np.int64)


class Passages:
    """The test side: its words numbered, where each item's words begin, and from how many words on a match starts at each."""

    def __init__(self, ids: list, texts: list[str]):
        h, hyphens, item = words_of(texts)
        self.vocab = np.unique(h)
        words = np.searchsorted(self.vocab, h).astype(np.int64)
        # a gap of one word, equal to none, behind each item
        at = np.arange(len(h)) + item
        self.words = np.full(len(h) + len(texts) + MIN_WORDS + NEAR_WORDS, -2, np.int64)
        self.words[at] = words
        self.item = np.full(len(self.words), -1, np.int64)
        self.item[at] = item
        weight = np.zeros(len(self.words), np.int64)
        weight[at] = hyphens + 1
        self.weight, self.total = weight, np.r_[0, np.cumsum(weight)]
        self.ids = ids
        self.bounds = np.searchsorted(item, np.arange(len(texts) + 1)) + np.arange(len(texts) + 1)
        self.starts, self.need = self._seeds(at)

    def _seeds(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, words needed there): SEED_WORDS, more where these stand in more than COMMON_ITEMS items, at most MIN_WORDS."""
        for k in range(SEED_WORDS):  # places with so many words left
            at = at[self.words[at + k] >= 0]
        rank = np.zeros(len(at), np.int64)
        for k in range(SEED_WORDS):
            rank = np.unique(rank * (len(self.vocab) + 1) + self.words[at + k], return_inverse=True)[1]
        place, need = [], []
        for n in range(SEED_WORDS, MIN_WORDS + 1):
            if not len(at):
                break
            pairs = np.unique(rank * (len(self.ids) + 1) + self.item[at]) // (len(self.ids) + 1)
            common = np.bincount(pairs, minlength=int(rank.max()) + 1)[rank] > COMMON_ITEMS
            good = ~common if n < MIN_WORDS else np.ones(len(at), bool)
            place.append(at[good])
            need.append(np.full(int(good.sum()), n))
            more = common & (self.words[np.minimum(at + n, len(self.words) - 1)] >= 0)
            at, rank = at[more & ~good], rank[more & ~good]
            rank = np.unique(rank * (len(self.vocab) + 1) + self.words[at + n], return_inverse=True)[1] if len(at) else rank
        place_, need_ = np.concatenate(place) if place else at, np.concatenate(need) if need else at
        o = np.argsort(place_)
        return place_[o], need_[o]


def suffix_order(words: np.ndarray) -> np.ndarray:
    """The positions of known words (>= 0) by the suffixes that begin there, in full: a suffix ends before the next unknown word.

    By doubling: ranks of 1, 2, 4 .. words; only what is still tied is sorted again. Equal suffixes stand in order of position.
    """
    n = len(words)
    known = np.flatnonzero(words >= 0)
    lone = n - len(known)
    rank = np.empty(n + 1, np.int64)
    rank[np.flatnonzero(words < 0)] = np.arange(lone)  # an unknown word is like no other
    rank[n] = -1
    order = known[np.argsort(words[known], kind="stable")]
    w = words[order]
    head = np.r_[True, w[1:] != w[:-1]] if len(order) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
    rank[order] = lone + start
    step = 1
    while True:
        alone = head & np.r_[head[1:], True] if len(order) else head
        tied = np.flatnonzero(~alone)
        if not len(tied):
            return order
        pos = order[tied]
        group, then = rank[pos], rank[np.minimum(pos + step, n)]
        o = np.argsort(group * (n + 2) + then + 1, kind="stable")
        pos, group, then = pos[o], group[o], then[o]
        order[tied] = pos
        head[tied] = np.r_[True, (group[1:] != group[:-1]) | (then[1:] != then[:-1])]
        first = np.maximum.accumulate(np.where(head[tied], tied, 0))
        rank[pos] = lone + first
        step *= 2


def _search(words: np.ndarray, order: np.ndarray, test: np.ndarray, at: np.ndarray, need: np.ndarray, upper: bool, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each test suffix the first place in order[lo:hi] not below (or above) its first `need` words; all at once."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) // 2
        p, q, n = order[mid], at[open_], need[open_]
        sign = np.zeros(len(open_), np.int64)
        for k in range(int(n.max())):
            d = np.sign(words[p + k] - test[q + k])
            sign = np.where((sign == 0) & (k < n), d, sign)
            if (sign != 0).all():
                break
        right = (sign <= 0) if upper else (sign < 0)
        lo[open_] = np.where(right, mid + 1, lo[open_])
        hi[open_] = np.where(right, hi[open_], mid)


def _near(words: np.ndarray, passages: Passages, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which seeds stand among NEAR_WORDS words of the item that agree by NEAR_AGREE or more, a word by any diagonal near its own."""
    out = np.zeros(len(p), bool)
    span, shift = np.arange(-(NEAR_WORDS - 1), NEAR_WORDS), np.arange(-NEAR_SHIFT, NEAR_SHIFT + 1)
    for a in range(0, len(p), 20_000):
        qq = q[a : a + 20_000, None] + span
        t = passages.words[np.clip(qq, 0, len(passages.words) - 1)]
        ok = (qq >= 0) & (passages.item[np.clip(qq, 0, len(passages.words) - 1)] == passages.item[q[a : a + 20_000], None])
        agree = np.zeros(t.shape, bool)
        for d in shift:
            agree |= words[np.clip(p[a : a + 20_000, None] + span + d, 0, len(words) - 1)] == t
        got = np.cumsum(np.where(agree & ok, passages.weight[np.clip(qq, 0, len(passages.words) - 1)], 0), 1)
        got = np.concatenate([np.zeros((len(got), 1), got.dtype), got], 1)
        out[a : a + 20_000] = (got[:, NEAR_WORDS:] - got[:, :-NEAR_WORDS]).max(1) >= NEAR_AGREE
    return out


_EDITS = [(1, 1), (1, 0), (0, 1), (2, 2), (2, 1), (1, 2), (2, 0), (0, 2), (3, 3)]


def _grow(a, b, i: int, j: int, step: int, a_end: int, b_end: int) -> tuple[int, int, int]:
    """From (i, j) on in one direction: where agreement ends and how many words agreed; gaps must be followed by 3 equal words."""
    same, end_i, end_j = 0, i, j
    while i != a_end and j != b_end:
        if a[i] == b[j]:
            i, j, same = i + step, j + step, same + 1
            end_i, end_j = i, j
            continue
        for di, dj in _EDITS:
            x, y = i + step * di, j + step * dj
            room = min((a_end - x) * step, (b_end - y) * step)
            need = min(3, room)
            if need >= 2 and all(a[x + step * k] == b[y + step * k] for k in range(need)):
                i, j = x, y
                break
        else:
            break
    return end_i, end_j, same


def match_shard(texts: list[str], passages: Passages) -> list[tuple[int, int, int, int, int, int]]:
    """(text number, item number, passage words, agreeing words, longest verbatim match, first word in the text)."""
    h, _, text_of = words_of(texts)
    if not len(h) or not len(passages.starts):
        return []
    place = np.minimum(np.searchsorted(passages.vocab, h), len(passages.vocab) - 1)
    # a gap of one word, equal to none, behind each text and at the end
    at = np.arange(len(h)) + text_of
    words = np.full(len(h) + len(texts) + MIN_WORDS + NEAR_WORDS, -1, np.int64)
    words[at] = np.where(passages.vocab[place] == h, place, -1)
    doc = np.zeros(len(words), np.int64)
    doc[at] = text_of
    order = suffix_order(words)
    # a suffix shorter than a seed can't match
    run = np.zeros(len(words), bool)
    run[: -SEED_WORDS] = np.logical_and.reduce([words[k : len(words) - SEED_WORDS + k] >= 0 for k in range(SEED_WORDS)])
    order = order[run[order]]
    if not len(order):
        return []
    t, starts, need = passages.words, passages.starts, passages.need
    least = np.full(len(starts), SEED_WORDS)
    none, all_ = np.zeros(len(starts), np.int64), np.full(len(starts), len(order), np.int64)
    lo, hi = _search(words, order, t, starts, least, False, none, all_), _search(words, order, t, starts, least, True, none, all_)
    long = np.flatnonzero((need > SEED_WORDS) & (hi > lo))
    if len(long):
        a, b = lo[long].copy(), hi[long].copy()
        lo[long] = _search(words, order, t, starts[long], need[long], False, a, b)
        hi[long] = _search(words, order, t, starts[long], need[long], True, a, b)
    counts = hi - lo
    hit = np.flatnonzero(counts > 0)
    if not len(hit):
        return []
    counts = counts[hit]
    q = np.repeat(starts[hit], counts)
    p = order[np.repeat(lo[hit] - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())]
    # of seeds that follow each other on a diagonal the first counts: the others are inside its match
    o = np.lexsort((p, p - q, passages.item[q], doc[p]))
    p, q = p[o], q[o]
    first = np.r_[True, (np.diff(p) != 1) | (np.diff(q) != 1)]
    p, q = p[first], q[first]
    near = _near(words, passages, p, q)
    p, q = p[near], q[near]
    if not len(p):
        return []
    ends = np.searchsorted(text_of, np.arange(len(texts) + 1)) + np.arange(len(texts) + 1)
    best: dict[tuple[int, int], tuple] = {}
    covered: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}
    wl, tl = words, t
    for p0, q0 in zip(p.tolist(), q.tolist()):
        d, e = int(doc[p0]), int(passages.item[q0])
        seen = covered.setdefault((d, e), [])
        if any(a <= p0 < b and x <= q0 < y for a, b, x, y in seen):
            continue
        k = SEED_WORDS
        while wl[p0 + k] == tl[q0 + k]:
            k += 1
        back = 0
        while p0 > back and q0 > back and wl[p0 - back - 1] == tl[q0 - back - 1]:
            back += 1
        d_end, e_end = int(ends[d + 1]) - 1, int(passages.bounds[e + 1]) - 1
        i2, j2, more = _grow(wl, tl, p0 + k, q0 + k, 1, d_end, e_end)
        i1, j1, less = _grow(wl, tl, p0 - back - 1, q0 - back - 1, -1, int(ends[d]) - 1, int(passages.bounds[e]) - 1)
        i1, j1 = i1 + 1, j1 + 1
        seen.append((i1, i2, j1, j2))
        agree = k + back + more + less
        span = int(passages.total[j2] - passages.total[j1])
        if span >= MIN_WORDS and agree >= MIN_AGREE * max(i2 - i1, j2 - j1):
            got = best.get((d, e))
            longest = max(k + back, got[2] if got else 0)
            best[d, e] = (span, agree, longest, i1 - int(ends[d])) if not got or span > got[0] else (*got[:2], longest, got[3])
    return [(d, e, *v) for (d, e), v in best.items()]


def find_leaks(docs: DataFrame, evals: DataFrame, doc_id: str = "doc_id", text: str = "text", eval_id: str = "eval_id", eval_text: str = "text") -> DataFrame:
    """One row per (document, test item it leaks): doc_id, eval_id, passage_words, agreeing_words, longest_verbatim, first_word.

    A leak is a run of at least MIN_WORDS words of the item, MIN_AGREE of which stand in the document in order; such a run
    has SEED_WORDS words unchanged in a row. Wording that more than COMMON_ITEMS items share starts a match only with the
    words that make it rarer, so that a common sentence doesn't pair every document with every item. passage_words is the longest such run. Null and empty texts leak nothing; an
    item shorter than MIN_WORDS can't leak; items that repeat an id are one. Every document is judged for itself, so
    copies all come out, and nothing is shuffled: shards of documents are sorted and searched where they are read.
    """
    kind, ekind = dict(docs.dtypes)[doc_id], dict(evals.dtypes)[eval_id]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter(F.length("text") > MIN_WORDS)
    items = evals.select(eval_id, eval_text).filter(F.length(eval_text) > MIN_WORDS)
    out = None
    for part in _blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(Passages([i for i, _ in part], [x for _, x in part]))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            tests = shared.value
            for ids, texts in _shards(batches):
                got = match_shard(texts, tests)
                yield pd.DataFrame(
                    [(ids[d], tests.ids[e], *v) for d, e, *v in got],
                    columns=["doc_id", "eval_id", "passage_words", "agreeing_words", "longest_verbatim", "first_word"])

        found = rows.mapInPandas(run, f"doc_id {kind}, eval_id {ekind}, passage_words int, agreeing_words int, longest_verbatim int, first_word int")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], f"doc_id {kind}, eval_id {ekind}, passage_words int, agreeing_words int, longest_verbatim int, first_word int")
    return out


def _blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """The test side in passes of at most EVAL_CHARS characters; read one partition at a time, never whole."""
    part, size = [], 0
    for r in items.toLocalIterator():
        part.append((r[0], r[1]))
        size += len(r[1])
        if size >= EVAL_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def _shards(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list[str]]]:
    ids, texts, size = [], [], 0
    for pdf in batches:
        for i, x in zip(pdf["doc_id"], pdf["text"]):
            ids.append(i)
            texts.append(x)
            size += len(x)
            if size >= SHARD_CHARS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts
