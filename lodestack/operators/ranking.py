"""Search: terms in texts, boolean queries, ranking, fusion of rankings, grouping of results, snippets."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.functions.text import word_tokens

RRF_K, LEG_LIMIT = 60, 200
#: vectors searched for at once
QUERY_ROWS = 4_096
STOP_WORDS = frozenset("a an and are as at be by for from in is it its of on or that the this to was were will with".split())


def parse_query(query: str) -> tuple[list[list[str]], list[list[str]], list[str]]:
    """(any-of groups that must each match, phrases among them as word lists, words that must not occur).

    `word word` needs both, `a or b` either, `"a b"` the words in a row, `-word` excludes. Stop words are left out.
    """
    need: list[list[str]] = []
    phrases, ban, either = [], [], False
    for m in re.finditer(r'(-?)"([^"]*)"|(\S+)', query.lower()):
        if m.group(2) is not None:
            words = re.findall("[a-z0-9]+", m.group(2))
            if m.group(1):
                ban += words
            elif words:
                phrases.append(words)
            continue
        raw = m.group(3)
        if raw == "or":
            either = bool(need)
            continue
        words = [w for w in re.findall("[a-z0-9]+", raw) if w not in STOP_WORDS]
        if raw.startswith("-"):
            ban += words
        elif words:
            if either:
                need[-1] += words
            else:
                need.append(words)
        either = False
    return need, phrases, ban


def matches(text: Column, query: str) -> Column:
    """Whether a text satisfies a query; an empty query matches nothing."""
    need, phrases, ban = parse_query(query)
    if not need and not phrases:
        return F.lit(False)
    words = word_tokens(text)
    row = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    parts = [F.arrays_overlap(words, F.array(*map(F.lit, g))) for g in need] + [F.contains(row, F.lit(" " + " ".join(p) + " ")) for p in phrases]
    parts += [~F.array_contains(words, w) for w in ban]
    return F.coalesce(reduce(lambda a, b: a & b, parts), F.lit(False))


def query_words(query: str) -> list[str]:
    need, phrases, _ = parse_query(query)
    return list(dict.fromkeys(w for g in need + phrases for w in g))


def rank(text: Column, query: str) -> Column:
    """Occurrences of the query's words, damped by the length of the text."""
    words = word_tokens(text)
    asked = F.array(*map(F.lit, query_words(query) or ["\x00"]))
    return F.round(F.size(F.filter(words, lambda w: F.array_contains(asked, w))) / (F.lit(1.0) + F.ln(F.greatest(F.size(words), F.lit(1)))), 6)


def lexical(df: DataFrame, query: str, text: str = "text") -> DataFrame:
    return df.filter(matches(F.col(text), query)).withColumn("rank", rank(F.col(text), query))


def cascade(df: DataFrame, query: str, text: str = "text") -> DataFrame:
    """All words; if nothing matches any word; if nothing matches the literal text, ranked 0. One result set, gated by emptiness.

    Every row is marked once with the first leg it matches; the least leg that occurs is the gate, and its rows are given: a
    row of an earlier leg is one of a later leg too.
    """
    either = " or ".join(query_words(query)) or "\x00"
    literal = F.contains(F.lower(text), F.lit(query.lower()))
    leg = F.when(matches(F.col(text), query), 1).when(matches(F.col(text), either), 2).when(literal, 3)
    marked = df.withColumn("leg", leg).filter("leg is not null")
    gate = F.broadcast(marked.agg(F.min("leg").alias("gate")))  # one row
    hits = marked.crossJoin(gate).filter(F.col("leg") == F.col("gate")).drop("gate")
    return hits.withColumn("rank", F.when(F.col("leg") == 3, F.lit(0.0)).otherwise(rank(F.col(text), query)))


def top(df: DataFrame, score: str, key: str, limit: int = LEG_LIMIT, ascending: bool = False) -> DataFrame:
    """The best rows with their place; the limit comes first, so no full sort lands in one task."""
    order = [F.col(score).asc() if ascending else F.col(score).desc(), F.col(key).asc()]
    return df.orderBy(*order).limit(limit).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def cosine_distance(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return F.lit(1.0) - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector_search(rows: DataFrame, asked: DataFrame, key: str, vector: str, limit: int = LEG_LIMIT) -> DataFrame:
    """(query_id, key, distance, place): of all rows the `limit` nearest of each row of `asked`, by cosine distance to 6 places; ties to the smaller key.

    Queries go to the executors QUERY_ROWS at a time, each block against all rows; each batch of rows sends back its best.
    Null vectors and vectors of length 0 take no part.
    """
    kind, out = dict(rows.dtypes)[key], None
    usable = F.col(vector).isNotNull() & F.exists(vector, lambda x: x != 0)
    for ids, vectors in _query_blocks(asked.filter(usable).select(key, vector)):
        shared = rows.sparkSession.sparkContext.broadcast((ids, vectors))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            for pdf in batches:
                if not len(pdf):
                    continue
                pdf = pdf.sort_values(key, kind="stable")
                x = np.stack(pdf[vector].to_numpy()).astype(float)
                x /= np.sqrt((x * x).sum(1, keepdims=True))
                for a in range(0, len(ids), 256):
                    far = np.round(1 - q[a : a + 256] @ x.T, 6) + 0.0
                    at = np.argsort(far, 1, kind="stable")[:, :limit]
                    yield pd.DataFrame({"query_id": np.repeat(ids[a : a + 256], at.shape[1]), key: pdf[key].to_numpy()[at.ravel()], "distance": np.take_along_axis(far, at, 1).ravel()})

        found = rows.filter(usable).select(key, vector).mapInPandas(scan, f"query_id {dict(asked.dtypes)[key]}, {key} {kind}, distance double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = rows.sparkSession.createDataFrame([], f"query_id {dict(asked.dtypes)[key]}, {key} {kind}, distance double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", key))
    return out.withColumn("place", place).filter(F.col("place") <= limit)


def _query_blocks(asked: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, unit vectors) of QUERY_ROWS queries at a time, read one partition at a time."""
    part = []
    for r in asked.toLocalIterator():
        part.append(r)
        if len(part) == QUERY_ROWS:
            yield _unit_block(part)
            part = []
    if part:
        yield _unit_block(part)


def _unit_block(part: list) -> tuple[np.ndarray, np.ndarray]:
    q = np.array([r[1] for r in part], float)
    return np.array([r[0] for r in part]), q / np.sqrt((q * q).sum(1, keepdims=True))


def fuse(first: DataFrame, second: DataFrame, key: str, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two rankings with `place`; ties by the place in the first, then in the second."""
    a, b = first.select(key, F.col("place").alias("p1")), second.select(key, F.col("place").alias("p2"))
    part = lambda p: F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(p)), F.lit(0.0))
    return a.join(b, key, "full_outer").withColumn("score", F.round(part("p1") + part("p2"), 6))


def group_results(hits: DataFrame) -> DataFrame:
    """Chunks to results: an item, a figure or a page of a document; the best chunk gives score, text and page."""
    rid = F.coalesce("knowledge_item_id", "asset_id", F.concat_ws(":", "document_id", F.col("page_from").cast("string")))
    best = F.struct("rank", "id")
    return hits.withColumn("result_id", rid).groupBy("result_id", "result_kind", "document_id").agg(
        F.max("rank").alias("score"), F.bool_or("is_placeholder").alias("is_placeholder"), F.min("placeholder_status").alias("placeholder_status"),
        F.max_by("id", best).alias("best_chunk"), F.max_by("page_from", best).alias("page_from"), F.count("*").alias("n_chunks"))


def snippet(text: Column, query: str, words: int = 28) -> Column:
    """Up to `words` words from a little before the first hit on, hits in double brackets."""
    asked = query_words(query) or ["\x00"]
    pattern = r"(?i)(?<![a-z0-9])(" + "|".join(map(re.escape, asked)) + r")(?![a-z0-9])"
    parts = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    first = F.coalesce(F.array_position(F.transform(parts, lambda w: w.rlike(pattern)), F.lit(True)), F.lit(0))
    cut = F.slice(parts, F.greatest(first - 5, F.lit(1)).cast("int"), words)
    return F.regexp_replace(F.array_join(cut, " "), pattern, "[[$1]]")
