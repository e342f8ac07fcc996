"""Template residue, filler, error-page text and script notices, found by a regularised linear classifier.

Texts are judged segment by segment (lines and sentences), so that residue beside real content shows. Features are
hashed word n-grams with the shapes of fill-in marks, length, and the place of the segment (title or not). Weak labels
come from phrases and from the recorded status; documents whose id hashes into a held-out part validate the fit.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.sources.tables import stored

DIMS = 1 << 17
#: the tasks of a pass over the labelled segments, each of which gives a sum of DIMS numbers; sums are of whole parts of one
FIT_TASKS, _WHOLE = 64, float(1 << 46)
#: one host in HELD_OUT is kept for validation; a segment counts from the log-odds on at which so large a share of those
#: found on the unseen hosts is residue by its label
HELD_OUT, PRECISION = 10, 0.995
_RIDGE, _STEPS, _MEMORY = 3e-6, 80, 30

_SEGMENT = re.compile(r"[^\n\f]+")
_SENTENCE = re.compile(r"(?<=[.!?])[”\"’]?\s+(?=[A-ZÀ-ÞŒ0-9“„«‘\[{<$%#@_(])")
_TURN = re.compile(r"(?<=[^\s.!?:])[ \t]*\f\s*(?=\S)")
_TOKEN = re.compile(r"\{\{|\}\}|\{%|%\}|\$\{|<<|>>|@@|__+|[^\W\d_]+|\d+|_|[^\w\s]")
#: shapes of fill-in marks; they are features beside the words, never rules by themselves
_SHAPES = [
    (re.compile(r"\{\{[^{}\n]+\}\}|\{%[^%\n]+%\}|\$\{[^{}\n]+\}"), "s:curly"),
    (re.compile(r"<<[^<>\n]+>>|<[A-Za-zÀ-ÿ][^<>\n]+>"), "s:angle"),
    (re.compile(r"\[(?:insert|enter|type|add|xx+|tbc|tbd|●|\.\.\.|…|insérer|saisir|escriba|introduzca|einfügen|hier)[^\[\]\n]*\]|\[[^\[\]\n]+(?:inserted|compléter|ausfüllen|eintragen|completar)\]", re.I), "s:square"),
    (re.compile(r"\[(?!sic\b|see\b|note\b|cf\b)[a-zà-ÿ][a-zà-ÿ _]{2,}\]"), "s:bracketed"),
    (re.compile(r"%[A-Z][A-Z_]{2,}%|#[A-Z][A-Z_]{2,}#|@@[A-Z_]{3,}@@"), "s:marked"),
    (re.compile(r"«[a-z][a-z_ .]{2,}»"), "s:guillemets"),
    (re.compile(r"_{2,}|\.{5,}"), "s:blank"),
    (re.compile(r"\b(?:dd|tt|jj|mm)[/.](?:mm|dd)[/.](?:yyyy|jjjj|aaaa)\b|\b20XX\b", re.I), "s:date"),
    (re.compile(r"\bX{1,3}\s?(?:%|km\b|no of\b)|\bXX+\b"), "s:x"),
]
_CHARS = re.compile(r"[{}<>\[\]%#@«»_$|X]")
_MARK_HINT = re.compile(r"[{}\[\]#@«»_$|]|%(?=[A-Za-z{])|(?<=[A-Za-z_])%|<(?![\s\d=])|(?<![\s\d])>")
_MARKS = frozenset("{{ }} {% %} ${ << >> @@ __ { } < > [ ] % # @ « » _ $ |".split())

#: phrases of the weak labels: wording of servers, viewers, templates and filler, none of it of this data alone
_PHRASES = re.compile(
    r"lorem ipsum|dolor sit amet|\b(?:dummy|sample|filler|body|bullet) (?:text|copy)(?: (?:text|copy|for layout|body|goes|only)|\s*[.!]?\s*$)|text goes here|type (?:your|here)|blindtext|texte? factice|texto de relleno|placeholder (?:copy|text)"
    r"|nonsense copy|greeking:|body text body|sample copy|click (?:or tap |icon |here |to )(?:here |to )?(?:to )?(?:add|enter|edit)|double-click to edit|choose an item|enter body copy|insert (?:text|your)|heading (?:one|two|three)\s*$|^caption\s*$"
    r"|(?:\b(?:asdf|qwer|qwerty|jkl|blah|xxxx|aaaa|foo|bar|baz|abc|zzz|test)\b\s?){3}|template[ \n]+only|^template$|^only$|guidance to author|delete this (?:paragraph|text)|^(?:project|prepared by|revision|client|date)\s*:\s*(?:[-–_.]*)\s*$"
    r"|please find attached .*(?:\[|\{|<|__)|to be inserted\]"
    r"|^(?:error|http)?\s*(?:40[0-9]|50[0-9])\b[\s:–-]+(?:not found|forbidden|bad gateway|gateway time|service unavail|internal server|page not found|error|unauthori[sz]ed)|^(?:error|http)\s+\d{3}\b"
    r"|do not have permission to|^erreur \d{3}|demandée est introuvable|seite (?:wurde )?nicht gefunden|página no encontrada|(?:page|file|drawing|resource|document) (?:not found|could not be (?:located|found))|can[’']t find the page|moved or renamed|something went wrong|team has been notified|^access denied|^forbidden|session has expired|sign in again"
    r"|too many requests|try again in \d|download quota|again tomorrow\.$|locked for editing|preview is not available|upload incomplete|ocr failed|internal error while|#(?:ref|name|value|div/0|n/a)[!?]|[a-z]+\.[a-z.]*exception\b|stack ?trace|connection before opening|this may take a few seconds"
    r"|(?:enable|activate|activer|activez|aktivieren|active|habilite|switch on|allow|turn on|requires?|need to enable|necesita|erforderlich)\b.*(?:javascript|scripts?\b|scripting|skripte)|(?:javascript|scripts?|skripte|scripting)\b.*(?:disabled|must be allowed|is off|erforderlich|désactivé|deshabilitad|requis|to run)|^noscript"
    r"|browser (?:is out of date|does not support)|navigateur (?:est obsolète|ne prend pas)|navegador (?:no admite|está desactualizado|no es compatible)|browser (?:ist veraltet|unterstützt)|unterstützt diese ansicht nicht|update it to see|turn them on and reload|some features of .* will not work|^reference: [0-9a-f]{6,}$", re.I)
#: a text without any of these holds none of the phrases (a plain search, many times faster)
_TRIGGERS = (
    "lorem", "dolor", "dummy", "sample", "filler", "body ", "bullet", "text goes", "type your", "type here", "blindtext", "factice", "de relleno", "placeholder", "nonsense",
    "greeking", "click", "choose an", "insert", "enter body", "heading", "caption", "asdf", "qwer", "jkl", "blah", "xxxx", "aaaa", "zzz", "foo ", "abc ", "bar ", "baz", "test test",
    "template", "guidance to", "delete this", "project:", "prepared by", "revision:", "client:", "date:", "project :", "revision :", "client :", "date :", "please find",
    "error", "http", "not found", "forbidden", "gateway", "unavail", "internal server", "unauthori", "permission", "erreur", "introuvable", "nicht gefunden", "no encontrada",
    "could not be", "find the page", "moved or", "went wrong", "been notified", "denied", "session", "sign in", "too many", "try again", "quota", "again tomorrow", "locked for",
    "preview is", "upload incomplete", "ocr failed", "#ref", "#name", "#value", "#div", "#n/a", "exception", "stack", "connection before", "few seconds", "script", "skript",
    "browser", "navigateur", "navegador", "update it", "turn them on", "some features", "reference:",
)
#: blanks that the triggers don't foresee, and letters that a search in any case takes for i, k or s
_ODD = re.compile("[^\\S ]|  |[\u0130\u0131\u017f\u212a]")
#: words of the traditional Latin filler (a fixed public passage and its generators)
_LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipisicing adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat"
    " duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit anim laborum perspiciatis unde omnis iste natus error"
    " voluptatem accusantium doloremque laudantium totam rem aperiam eaque ipsa quae inventore veritatis quasi architecto beatae vitae dicta explicabo nemo ipsam quia voluptas aspernatur odit aut fugit consequuntur magni dolores"
    " ratione sequi nesciunt neque porro quisquam dolorem adipisci numquam eius modi tempora incidunt magnam aliquam quaerat minima nostrum ullam corporis suscipit laboriosam nihil molestiae illum quo at vero eos accusamus"
    " iusto dignissimos ducimus blanditiis praesentium voluptatum deleniti atque corrupti quos quas molestias excepturi obcaecati cupiditate similique mollitia animi harum quidem rerum facilis expedita distinctio libero tempore"
    " cum soluta nobis eligendi optio cumque impedit minus maxime placeat facere possimus assumenda repellendus temporibus autem quibusdam officiis debitis necessitatibus saepe eveniet voluptates repudiandae recusandae itaque earum"
    " hic tenetur a sapiente delectus reiciendis voluptatibus maiores alias perferendis doloribus asperiores repellat provident eum fuga ab et in ut ad non".split())


def _cut(text: str) -> list[tuple[str, int]]:
    """(segment, place): lines cut into sentences; place 0 is a title (first line alone), 2 an end that is cut off, 1 the rest."""
    out, first = [], True
    if "\f" in text:  # a page turn inside a sentence doesn't end it
        text = _TURN.sub(" ", text)
    for m in _SEGMENT.finditer(text):
        line = m.group().strip()
        if not line:
            continue
        title = first and len(line) < 120 and line[-1] not in ".!?"
        first = False
        if title:
            out.append((line, 0))
        else:
            out += [(s, 1) for s in _SENTENCE.split(line) if s]
    if len(out) > 1 and out[-1][0][-1] not in ".!?:;”\"’)":
        out[-1] = (out[-1][0], 2)
    return out


def _triggered(text: str) -> bool:
    low = text.lower()
    return any(t in low for t in _TRIGGERS)


def _may_hold_marks(segment: str) -> bool:
    """Whether a segment can hold a fill-in mark at all (plain searches, many times faster)."""
    return bool(_CHARS.search(segment)) or "....." in segment or "mm" in segment.lower()


def _may_hold_phrases(segment: str) -> bool:
    """Whether a segment can hold a phrase at all: most of a text with a trigger have none themselves."""
    return _triggered(segment) or segment.lower() == "only" or bool(_ODD.search(segment))


def _phrase(segment: str, triggered: bool | None = None) -> bool:
    """The weak label of a segment; it marks what the classifier is fitted on, and has no say in what is found."""
    if (triggered if triggered is not None else _triggered(segment)) and _may_hold_phrases(segment) and _PHRASES.search(segment):
        return True
    if _may_hold_marks(segment) and any(p.search(segment) for p, _ in _SHAPES):
        return True
    words = segment.lower().replace(".", " ").replace(",", " ").split()
    if len(words) < 3:
        return bool(words) and segment.endswith(".") and all(len(w) > 4 and w in _LATIN for w in words)
    return sum(w in _LATIN for w in words) >= 0.6 * len(words)


def _outlines(segment: str) -> list[str]:
    """Runs of three and four tokens about a mark, words by their case alone: how fill-in marks look, whatever stands in them."""
    regions: list[list[int]] = []
    for m in _MARK_HINT.finditer(segment):
        a, b = max(0, m.start() - 60), m.end() + 60
        if regions and a <= regions[-1][1]:
            regions[-1][1] = b
        else:
            regions.append([a, b])
    out = []
    for a, b in regions:
        t = []
        for m in _TOKEN.finditer(segment, a, b):
            x = m.group()
            if x[0].isalpha():
                x = "U" if len(x) > 1 and x.isupper() else "W" if x[0].isupper() else "w"
            elif x.isdigit():
                x = "0"
            elif len(x) > 1 and x[0] == "_":
                x = "__"
            t.append(" " + x if m.start() and segment[m.start() - 1].isspace() else x)
        begin = {(i - k, n) for i, x in enumerate(t) if x.strip() in _MARKS for n in (3, 4) for k in range(n) if 0 <= i - k <= len(t) - n}
        out += ["o:" + "".join(t[i : i + n]) for i, n in sorted(begin)]
    return out


class _Numbers(dict):
    """Words to their hashes; numbers count as one word. The commonest are remembered."""

    def __missing__(self, w: str) -> int:
        got = zlib.crc32(("0" if w.isdigit() else w.lower()).encode("utf-8", "replace"))
        if len(self) < 400_000:
            self[w] = got
        return got


class _Hasher:
    """Segments to hashed features, a batch at a time: words are numbered once, n-grams are array arithmetic."""

    def __init__(self):
        self.words = _Numbers()
        self.latin = np.unique([self.words[w] for w in _LATIN])
        self.length = np.array([self.words[f"l:{i}"] for i in range(11)])
        self.place = np.array([self.words[f"p:{i}"] for i in range(3)])
        self.placed = np.array([[self.words[f"p:{i}:{j}"] for j in range(4)] for i in range(3)])

    def __call__(self, segments: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(features, offsets of each segment, values): n-grams share a unit length, marks count in full however long the segment."""
        ids: list[int] = []
        lens = np.empty(len(segments), np.int64)
        extra: list[int] = []
        extra_at: list[int] = []
        get = self.words.__getitem__
        for n, (s, _) in enumerate(segments):
            t = _TOKEN.findall(s)
            ids.append(1)
            ids.extend(map(get, t))
            ids.append(2)
            lens[n] = len(t) + 2
            more = []
            if len(t) < 7:
                if t and t[-1] == ":":
                    more.append("s:field")
                if len(t) < 5 and s.isupper():
                    more.append("s:caps")
            if _may_hold_marks(s):
                more += [name for p, name in _SHAPES if p.search(s)]
                if _MARK_HINT.search(s):
                    more += _outlines(s)
            if more:
                extra += map(get, more)
                extra_at += [n] * len(more)
        size, place = lens - 2, np.array([p for _, p in segments], np.int64)
        latin = np.add.reduceat(np.isin(np.array(ids, np.int64), self.latin), np.r_[0, np.cumsum(lens)[:-1]].astype(np.int64), dtype=np.int64) if len(lens) else lens
        short, fifths = np.minimum(size, 12) // 4, latin * 5 // np.maximum(size, 1)
        for n in np.flatnonzero(latin):
            extra += [get(f"lat:{fifths[n]}"), get(f"lat:{fifths[n]}:{short[n]}:{place[n]}")]
            extra_at += [n, n]
        own = [self.length[np.minimum(size, 40) // 4], self.place[place], self.placed[place, short]]
        extra = [*extra, *np.concatenate(own).tolist()]
        extra_at = [*extra_at, *np.tile(np.arange(len(segments)), 3).tolist()]
        a = np.array(ids, np.uint64)
        seg = np.repeat(np.arange(len(segments)), lens)
        m = np.uint64(0x9E3779B97F4A7C15)
        with np.errstate(over="ignore"):
            uni = a * m
            bi = (a[:-1] * np.uint64(31) + a[1:] * np.uint64(1_000_003)) * m
            tri = (a[:-2] * np.uint64(131) + a[1:-1] * np.uint64(31) * np.uint64(1_000_003) + a[2:] * np.uint64(7_368_787)) * m
            own = np.array(extra, np.uint64) * m + np.uint64(77)
        sb, st = seg[:-1] == seg[1:], seg[:-2] == seg[2:] if len(seg) > 2 else np.zeros(0, bool)
        f = np.concatenate([uni, bi[sb], tri[st], own]) >> np.uint64(64 - 17)
        at = np.concatenate([seg, seg[:-1][sb], seg[:-2][st], np.array(extra_at, np.int64)])
        o = np.argsort(at, kind="stable")
        counts = np.bincount(at, minlength=len(segments))
        unit = 1 / np.sqrt(counts[at])
        unit[len(unit) - len(extra_at):] = 1.0
        return f[o].astype(np.int64), np.r_[0, np.cumsum(counts)], unit[o].astype(np.float32)


def _score(features, w: np.ndarray, bias: float) -> np.ndarray:
    f, off, value = features
    return _sums((w[f] * value).astype(float), np.diff(off)).astype(np.float32) + bias if len(off) > 1 else np.zeros(0)


def _sums(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs of so many numbers each; of an empty run 0."""
    out, some = np.zeros(len(sizes)), np.flatnonzero(sizes)
    if len(some):
        out[some] = np.add.reduceat(x, (np.cumsum(sizes, dtype=np.int64) - sizes)[some])
    return out


def _minimise(cost: Callable[[np.ndarray], tuple[float, np.ndarray]], size: np.ndarray) -> tuple[np.ndarray, float]:
    """(weights, bias) of least cost, by L-BFGS; `cost` gives the loss and its slope without the ridge.

    size: per feature, and for the bias, the sum of weighted squares. Slopes are scaled by its root: common features, which all
    segments pull at, take small steps and rare ones large steps, which takes far fewer passes to the same least cost.
    """

    def ridged(w: np.ndarray) -> tuple[float, np.ndarray]:
        loss, g = cost(w)
        return loss + _RIDGE / 2 * float((w[:-1] ** 2).sum()), g + np.r_[_RIDGE * w[:-1], 0.0]

    w = np.zeros(DIMS + 1)
    now, g = ridged(w)
    scale = 1 / np.sqrt(size / 4 + _RIDGE)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(_STEPS):
        d, alphas = -g, []
        for s, t, r in reversed(past):
            alphas.append(r * (s @ d))
            d = d - alphas[-1] * t
        d = d * scale
        if past:
            s, t, r = past[-1]
            d *= 1 / (r * (t @ (scale * t)))
        for (s, t, r), a in zip(past, reversed(alphas)):
            d += (a - r * (t @ d)) * s
        step = 1.0
        slope = float(g @ d)
        for _ in range(20):
            new, g2 = ridged(w + step * d)
            if new <= now + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, t = step * d, g2 - g
        if s @ t > 1e-18:
            past = [*past[-_MEMORY + 1 :], (s, t, 1 / float(s @ t))]
        done = now - new < 1e-4 * now
        w, g, now = w + s, g2, new
        if done:
            break
    return w[:-1].astype(np.float32), float(w[-1])


def _weight(seen: np.ndarray) -> np.ndarray:
    return 1 + np.log(np.maximum(seen, 1))


def _parts(features) -> tuple[np.ndarray, np.ndarray]:
    """(features, sizes in pairs): of each segment those that share a unit length, then its own, which count in full."""
    f, off, value = features
    own = np.add.reduceat(value == 1, off[:-1], dtype=np.int32)
    return f, np.column_stack([np.diff(off).astype(np.int32) - own, own]).ravel()


def _units(runs: np.ndarray, n: int) -> np.ndarray:
    """The values of the features of n segments: of those that share a unit length, and of each of its own. runs: sizes as of `_parts`,
    for all features or for the lower and then the upper ones."""
    unit = np.ones((n, 2))
    unit[:, 0] = 1 / np.sqrt(runs.reshape(-1, n, 2).sum((0, 2)))
    return unit


def _by_feature(f: np.ndarray, runs: np.ndarray, each: np.ndarray) -> np.ndarray:
    """Sums by feature of what each of its segments says, in whole parts, so that no order of adding shows."""
    whole = np.rint(each * _WHOLE).ravel()
    return np.bincount(f, np.repeat(np.tile(whole, len(runs) // len(whole)), runs), DIMS).astype(np.int64)


def _slopes(f: np.ndarray, runs: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> tuple[int, np.ndarray]:
    """(loss, its slope by weights and bias) of some segments in whole parts."""
    unit = _units(runs, len(y))
    z = (_sums(w[f], runs).reshape(-1, len(y), 2).sum(0) * unit).sum(1) + w[-1]
    err = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) * weight
    g = _by_feature(f, runs, err[:, None] * unit)
    return int(np.rint((np.logaddexp(0, z) - y * z) * weight * _WHOLE).astype(np.int64).sum()), np.r_[g, np.rint(err * _WHOLE).astype(np.int64).sum()]


def _squares(f: np.ndarray, runs: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted squares by feature, and the weight, in whole parts."""
    return np.r_[_by_feature(f, runs, weight[:, None] * _units(runs, len(weight)) ** 2), np.rint(weight * _WHOLE).astype(np.int64).sum()]


def fit_classifier(segments: list[tuple[str, int]], label: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression with a ridge penalty, minimised by L-BFGS; classes weigh alike, a segment by the logarithm of how often it is seen."""
    (f, pairs), y, weight = _parts(_Hasher()(segments)), label.astype(float), _weight(seen)
    weight = np.where(label, weight / max(weight[label].sum(), 1e-9), weight / max(weight[~label].sum(), 1e-9)) / 2

    def cost(w: np.ndarray) -> tuple[float, np.ndarray]:
        loss, g = _slopes(f, pairs, y, weight, w)
        return loss / _WHOLE, g / _WHOLE

    return _minimise(cost, _squares(f, pairs, weight) / _WHOLE)


def _label(records: DataFrame) -> DataFrame:
    """Weakly labelled segments. Others than positive ones come only from records whose status says real; a status that
    says otherwise leaves a segment without phrase unlabelled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for host, status, text in zip(pdf["host"], pdf["status"], pdf["text"]):
                hot = _triggered(text)
                for s, place in _cut(text):
                    if _phrase(s, hot):
                        out.append((s, place, True, host))
                    elif status == "real":
                        out.append((s, place, False, host))
            yield pd.DataFrame(out, columns=["segment", "place", "positive", "host"])

    return records.select("host", "status", "text").mapInPandas(run, "segment string, place int, positive boolean, host long")


#: segments of a stored block: rows stay small
_BLOCK_SIZE, _HALF = 16, 1 << 16
_BLOCK = "held boolean, n_positive long, n_other long, w_positive long, w_other long, y binary, seen binary, pairs binary, lower binary, upper binary"


def _blocks(records: DataFrame) -> DataFrame:
    """All labelled segments, each once, as stored blocks: y (label), seen (how often), its features in two
    halves, of which 16 bits are kept, and pairs, the sizes as of `_parts` in the one and in the other. A segment is held out if the host of least checksum that has it is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = _Hasher()
        for big in batches:
            for at in range(0, len(big), 2000):
                pdf = big.iloc[at : at + 2000]
                out = []
                for held, part in pdf.groupby(pdf["host"] % HELD_OUT == 0):
                    f, pairs = _parts(hasher(list(zip(part["segment"], part["place"]))))
                    of_pair, up, f = np.repeat(np.arange(len(pairs)), pairs), f >= _HALF, f.astype(np.uint16)
                    sizes = [np.bincount(of_pair[at], minlength=len(pairs)).astype(np.int32) for at in (~up, up)]
                    halves = [(f[at], np.r_[0, np.cumsum(n)]) for at, n in zip((~up, up), sizes)]
                    y, seen = part["positive"].to_numpy(bool), part["n"].to_numpy(np.int64)
                    whole = np.rint(_weight(seen) * (1 << 20)).astype(np.int64)
                    for i in range(0, len(y), _BLOCK_SIZE):
                        j = min(i + _BLOCK_SIZE, len(y))
                        is_, n, of = y[i:j], int(y[i:j].sum()), int(whole[i:j][y[i:j]].sum())
                        out.append((bool(held), n, j - i - n, of, int(whole[i:j].sum()) - of, is_.tobytes(), seen[i:j].tobytes(),
                                    np.stack([x[2 * i : 2 * j] for x in sizes]).tobytes(), *[h[ends[2 * i] : ends[2 * j]].tobytes() for h, ends in halves]))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in _BLOCK.split(", ")])

    hosts = records.withColumn("host", F.crc32(F.coalesce("host", F.lit("")).cast("binary")))
    once = _label(hosts).groupBy("segment", "place", "positive").agg(F.count("*").alias("n"), F.min("host").alias("host"))
    return stored(once.mapInPandas(run, _BLOCK), compression="none")  # hashes don't shrink, and are read in every pass


def _opened(batches: Iterator[pd.DataFrame], n: int = 250) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(features, first the lower ones, sizes as of `_units`, labels, how often seen) of blocks, n at a time."""
    for pdf in batches:
        for at in range(0, len(pdf), n):
            lower, upper, y, seen = (np.frombuffer(b"".join(pdf[c].iloc[at : at + n]), t) for c, t in (("lower", np.uint16), ("upper", np.uint16), ("y", bool), ("seen", np.int64)))
            f = np.empty(len(lower) + len(upper), np.intp)
            f[: len(lower)], f[len(lower) :] = lower, upper
            f[len(lower) :] += _HALF
            pairs = [np.frombuffer(x, np.int32).reshape(2, -1) for x in pdf["pairs"].iloc[at : at + n]]
            yield f, np.concatenate(pairs, 1).ravel(), y, seen


def _added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sums of at most FIT_TASKS tasks as one."""
    yield pd.DataFrame({"sums": [sum((np.frombuffer(x, np.int64) for pdf in batches for x in pdf["sums"]), np.zeros(DIMS + 2, np.int64)).tobytes()]})


def _fit(blocks: DataFrame, w_positive: int, w_other: int) -> tuple[np.ndarray, float]:
    """As fit_classifier, over stored blocks: a pass for each cost, of which the driver holds DIMS numbers."""
    spark = blocks.sparkSession
    blocks = blocks.select("y", "seen", "pairs", "lower", "upper").coalesce(FIT_TASKS)
    each = np.array([w_other, w_positive]) / (1 << 20) * 2

    def passed(w: np.ndarray | None) -> np.ndarray:
        """Slope and loss at w, or squares."""
        shared = spark.sparkContext.broadcast(w)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums, w = np.zeros(DIMS + 2, np.int64), shared.value
            for f, runs, y, seen in _opened(batches):
                weight = _weight(seen) / each[y.astype(int)]
                loss, g = _slopes(f, runs, y.astype(float), weight, w) if w is not None else (0, _squares(f, runs, weight))
                sums[:-1] += g
                sums[-1] += loss
            yield pd.DataFrame({"sums": [sums.tobytes()]})

        got = blocks.mapInPandas(run, "sums binary").repartition(1).mapInPandas(_added, "sums binary").collect()
        shared.destroy()
        return np.frombuffer(got[0]["sums"], np.int64) / _WHOLE

    def cost(w: np.ndarray) -> tuple[float, np.ndarray]:
        sums = passed(w)
        return float(sums[-1]), sums[:-1]

    return _minimise(cost, passed(None)[:-1])


def _last_good(right: np.ndarray, said: np.ndarray, precision: float) -> int:
    """The last place up to which so large a share of what is said is right; -1 if there is none."""
    good = np.flatnonzero(right >= precision * said)
    return int(good[-1]) if len(good) else -1


def least_score(z: np.ndarray, label: np.ndarray, seen: np.ndarray, precision: float = PRECISION, enough: int = 30) -> float:
    """The least log-odds from which on so large a share of the segments is residue by label; 0 where fewer than `enough` are."""
    if label.sum() < enough:
        return 0.0
    o = np.argsort(-z, kind="stable")
    at = _last_good(np.cumsum((label * seen)[o]), np.cumsum(seen[o]), precision)
    if at < 0:
        return float(z.max())
    return float(z[o[at]] + z[o[min(at + 1, len(z) - 1)]]) / 2


def _ranks(z: np.ndarray) -> np.ndarray:
    """Numbers in the order of 32-bit scores."""
    u = (np.asarray(z, np.float32) + np.float32(0)).view(np.uint32)
    return np.where(u >> 31, ~u, u | np.uint32(1 << 31)).astype(np.int64)


def _score_of(rank: int) -> float:
    u = rank ^ (1 << 31) if rank >> 31 else rank ^ 0xFFFFFFFF
    return float(np.array([u], np.uint32).view(np.float32)[0])


def held_out_score(blocks: DataFrame, w: np.ndarray, bias: float, precision: float = PRECISION, enough: int = 30) -> dict[str, float]:
    """threshold as of least_score, precision and recall over all segments of `blocks`, which stay where they are: sums by the upper
    half of the scores' bits come first, then those scores one by one among which the share can be reached, the lowest first."""
    shared = blocks.sparkSession.sparkContext.broadcast((w, bias))
    blocks = blocks.select("y", "seen", "pairs", "lower", "upper").coalesce(FIT_TASKS)

    def tally(within: list[int] | None) -> pd.DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            w, bias = shared.value
            for f, runs, y, seen in _opened(batches):
                unit = _units(runs, len(y)).astype(np.float32).ravel()
                said = _sums((w[f] * np.repeat(np.tile(unit, len(runs) // len(unit)), runs)).astype(float), runs)
                rank = _ranks(said.reshape(-1, len(y), 2).sum((0, 2)).astype(np.float32) + bias)  # as _score
                part = pd.DataFrame({"rank": rank >> 16 if within is None else rank, "residue": seen * y, "seen": seen, "labels": y.astype(np.int64)})
                yield part if within is None else part[np.isin(rank >> 16, within)]

        got = blocks.mapInPandas(run, "rank long, residue long, seen long, labels long").groupBy("rank").agg(*[F.sum(c).alias(c) for c in ("residue", "seen", "labels")])
        return got.toPandas().sort_values("rank", ascending=False, ignore_index=True)

    bins = tally(None)
    right, said = bins["residue"].cumsum().to_numpy(), bins["seen"].cumsum().to_numpy()
    all_right = int(right[-1])

    def report(threshold: float, right: int, said: int) -> dict[str, float]:
        return {"threshold": threshold, "precision": float(right / max(1, said)), "recall": float(right / max(1, all_right))}

    if bins["labels"].sum() < enough:
        zero = int(_ranks(np.zeros(1))[0])
        fine = tally([zero >> 16])
        above, over = bins["rank"] > zero >> 16, fine["rank"] > zero
        return report(0.0, *(int(bins[c][above].sum() + fine[c][over].sum()) for c in ("residue", "seen")))
    before_right, before = right - bins["residue"], said - bins["seen"]
    can = np.flatnonzero((bins["residue"] > 0) & (right >= precision * (before + bins["residue"])))[::-1]
    for i in can:
        fine = tally([int(bins["rank"][j]) for j in (i, i + 1) if j < len(bins)])
        mine = fine["rank"].to_numpy() >> 16 == bins["rank"][i]
        r, s = before_right[i] + fine["residue"].cumsum().to_numpy(), before[i] + fine["seen"].cumsum().to_numpy()
        at = _last_good(r[mine], s[mine], precision)
        if at >= 0:
            threshold = (_score_of(int(fine["rank"][at])) + _score_of(int(fine["rank"][min(at + 1, len(fine) - 1)]))) / 2
            last = at + 1 < len(fine)  # the least score of all is its own threshold, which nothing at it passes
            return report(threshold, int(r[at] if last else before_right[i] + fine["residue"][:at].sum()), int(s[at] if last else before[i] + fine["seen"][:at].sum()))
    return report(_score_of(int(tally([int(bins["rank"][0])])["rank"][0])), 0, 0)


def train(records: DataFrame) -> tuple[np.ndarray, float, dict[str, float]]:
    """(weights, bias, validation on unseen hosts) from `records` with record_id, host, status, kind, text.

    Every labelled segment of every record is fitted on or, of the unseen hosts, validates. The report holds `threshold`,
    found on the unseen hosts, and precision and recall there.
    """
    blocks = _blocks(records)
    had = {r["held"]: r for r in blocks.groupBy("held").agg(*[F.sum(c).alias(c) for c in ("n_positive", "n_other", "w_positive", "w_other")]).collect()}
    count = lambda c, *held: sum(had[h][c] for h in held if h in had)
    if not count("n_positive", True, False) or not count("n_other", True, False):
        return np.zeros(DIMS, np.float32), -9.0, {"validated": 0.0, "threshold": 0.0}
    on = (False,) if count("n_positive", False) and count("n_other", False) else (True, False)
    w, b = _fit(blocks.filter(F.col("held").isin(*on)), count("w_positive", *on), count("w_other", *on))
    report = {"validated": float(count("n_positive", True) + count("n_other", True)), "threshold": 0.0}
    if report["validated"]:
        report |= held_out_score(blocks.filter("held"), w, b)
    return w, b, report


def find_residue(records: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """(record_id, kind, score, segment) of every record with residue, and the validation report.

    A record is residue if the classifier gives one of its segments log-odds above the threshold found on unseen hosts;
    no phrase is looked at after the fit. score is the largest log-odds of a segment, segment the text it is of.
    `records` has record_id, host, status, kind, text. Null, empty and blank texts are no cases; a null status labels
    nothing; a null host is a host of its own. Repeated ids are judged each for themselves. Without any segment of either
    kind to learn from nothing is found. Texts are read whole; nothing is shuffled but the labelled segments, and the sums of a pass over them.
    """
    rows = records.select("record_id", "host", "status", "kind", "text").filter(F.col("text").isNotNull())
    w, b, report = train(rows)
    shared = records.sparkSession.sparkContext.broadcast((w, b, report["threshold"]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, b, threshold = shared.value
        hasher = _Hasher()
        for big in batches:
            for at in range(0, len(big), 2000):
                pdf = big.iloc[at : at + 2000]
                seg, owner = [], []
                for i, x in enumerate(pdf["text"]):
                    part = _cut(x)
                    seg += part
                    owner += [i] * len(part)
                if not seg:
                    continue
                z = _score(hasher(seg), w, b)
                out = {}
                for k in np.flatnonzero(z.astype(float) > threshold):
                    if z[k] > out.get(owner[k], (-1e9,))[0]:
                        out[owner[k]] = (float(z[k]), seg[k][0])
                if out:
                    keep = sorted(out)
                    yield pd.DataFrame({
                        "record_id": pdf["record_id"].iloc[keep].to_numpy(), "kind": pdf["kind"].iloc[keep].to_numpy(),
                        "score": [out[i][0] for i in keep], "segment": [out[i][1] for i in keep]})

    return rows.mapInPandas(run, "record_id string, kind string, score double, segment string"), report
