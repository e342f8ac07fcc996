import os

import numpy as np
import pandas as pd
import pytest

from lodestack.llm import mixing


def docs(spark, n=3000):
    rows = [(i, ["a", "b", "c", "other", None][i % 5], ["en", "fr", None][i % 3], "t", 50 + (i * 37) % 400) for i in range(n)]
    rows += [(n + i, "small", "en", "u", 100) for i in range(20)] + [(n + 99, "a", "en", "t", None), (n + 100, "a", "en", "t", 0)]
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, n_tokens long")


def test_shares_and_caps(spark):
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("small", 0.05, 4), ("c", 0.15, 1), ("nowhere", 0.1, 3)], "source string, target_share double, max_repeats int")
    chosen, shares = mixing.mix_sources(docs(spark), t)
    got = {r.source: r for r in shares.collect()}
    for s, want in (("a", 0.5), ("b", 0.3), ("small", 0.05), ("c", 0.15)):
        assert got[s].share == pytest.approx(want, rel=0.02) and got[s].most_repeats <= got[s].max_repeats
    assert got["nowhere"].tokens == 0 and got["small"].most_repeats == 4
    rows = chosen.collect()
    assert len({r.doc_id for r in rows}) == len(rows) and all(r.repeats >= 1 for r in rows)
    assert sum(r.repeats * r.n_tokens for r in rows) == sum(r.tokens for r in got.values())


def test_empty(spark):
    t = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    chosen, shares = mixing.mix_sources(docs(spark).limit(0), t)
    assert chosen.count() == 0 and [r.share for r in shares.collect()] == [0.0]


def test_rake_holds_marginals():
    c = pd.DataFrame([(s, la, "t", 100 * (1 + i + 2 * j)) for i, s in enumerate("ab") for j, la in enumerate(["x", "y"])], columns=["source", "lang", "topic", "tokens"])
    got, total = mixing.rake(c, {"a": 0.5, "b": 0.5}, {"a": 3, "b": 3})
    mass = (got["weight"] * got["tokens"]).groupby(got["source"]).sum()
    assert mass["a"] == pytest.approx(mass["b"]) and mass.sum() == pytest.approx(total)
    lang = (got["weight"] * got["tokens"]).groupby(got["lang"]).sum() / total
    want = c.groupby("lang")["tokens"].sum() / c["tokens"].sum()
    assert abs(lang - want).max() < 0.02


@pytest.mark.skipif(not os.path.exists("/opt/tokenizers/byte_bpe_50k.tiktoken"), reason="no vocabulary here")
def test_tokens(spark):
    from lodestack.llm.queries import TOKENIZERS, WORD_PATTERN

    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "<|endoftext|>")], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in mixing.count_tokens(df, "text", f"{TOKENIZERS}/byte_bpe_50k.tiktoken", WORD_PATTERN, ["doc_id"]).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1


def test_topics_follow_the_words(spark):
    """Three vocabularies: texts of one fall together; texts without words have no topic; the fit doesn't depend on partitions."""
    import random

    rng = random.Random(2)
    vocab = [[f"{a}{chr(97 + i % 26)}{chr(97 + i // 26)}word" for i in range(60)] for a in ("alpha", "beta", "gamma")]
    rows = [(i, " ".join(rng.choice(vocab[i % 3]) for _ in range(40))) for i in range(300)] + [(300, ""), (301, None), (302, "12 34")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    topics = mixing.fit_topics(df, "text", n=3)
    assert np.array_equal(topics, mixing.fit_topics(df.repartition(7), "text", n=3))
    got = mixing.topic_of([x for _, x in rows], topics)
    assert all(len(set(got[k:300:3])) == 1 for k in range(3)) and len(set(got[:300])) == 3 and set(got[300:]) == {-1}
    assert set(mixing.topic_of(["any words here"], mixing.fit_topics(df.limit(0), "text"))) <= {0}


def test_topics_are_fitted_on_every_document(spark):
    """Two kinds of text and one text unlike all others, whichever it is of 9,000: a topic of its own."""
    from pyspark.sql import functions as F

    late = spark.range(9_000).orderBy(F.pmod(F.xxhash64("id", F.lit("topic")), F.lit(1_000_000)).desc()).first().id
    kinds = ["common words about walls", "usual phrases regarding roofs"]
    rows = [(i, "seldom heard names" if i == late else kinds[i % 2]) for i in range(9_000)]
    topics = mixing.fit_topics(spark.createDataFrame(rows, "doc_id long, text string"), "text", n=3)
    got = mixing.topic_of([x for _, x in rows], topics).tolist()
    assert got.count(got[late]) == 1 and len(set(got)) == 3


def test_passes_take_few_texts_at_a_time():
    """However large a batch, words meet the topics of a thousand texts at once; none is lost and the order stays."""
    got = list(mixing._chunks(iter([pd.DataFrame({"h": range(2500)}), pd.DataFrame({"h": []}), pd.DataFrame({"h": [2500]})])))
    assert max(map(len, got)) <= 1000 and [int(h) for p in got for h in p["h"]] == list(range(2501))
