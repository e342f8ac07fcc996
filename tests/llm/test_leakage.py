import random

from lodestack.llm import leakage as L

W = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]


def test_cases(spark):
    rng = random.Random(5)
    item = [rng.choice(W) for _ in range(80)]
    fill = lambda n: [rng.choice(W) for _ in range(n)]
    changed = item[10:50]
    changed[12] = "other"
    del changed[25]
    changed.insert(30, "more")
    docs = {
        1: fill(100) + item[20:50] + fill(100), 2: fill(50) + changed + fill(20), 3: fill(200), 4: fill(30) + item[:15] + fill(30), 5: item, 6: item,
        7: fill(10) + [w.upper() for w in item[30:70]], 8: item[30:55], 9: item[30:54],
    }
    rows = [(k, " ".join(v)) for k, v in docs.items()]
    rows += [(10, "<p>" + " ".join(f"<b>{w}</b>" for w in item[5:40]) + "</p>"), (11, "\n".join(item[5:40])), (12, None), (13, ""), (14, " ".join(w[:1] + "-\n" + w[1:] for w in item[5:40])),
             (15, " ".join(w.replace("a", "á") for w in item[5:40]) + "!"), (16, "x" * 200_000 + " " + " ".join(item[5:40]))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    e = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "too short"), (4, " ".join(fill(60)))], "eval_id long, text string")
    got = {(r.doc_id, r.eval_id): r for r in L.find_leaks(d, e).collect()}
    hyphenated = {14}  # every word is broken there and on the other side none is
    assert {k[0] for k in got} - hyphenated == {1, 2, 5, 6, 7, 8, 10, 11, 15, 16} and {k[1] for k in got} == {1}
    assert got[5, 1].passage_words == 80 and got[1, 1].longest_verbatim >= 30 and got[1, 1].first_word in (98, 99, 100)
    assert L.find_leaks(d.limit(0), e).count() == 0 and L.find_leaks(d, e.limit(0)).count() == 0


def test_suffix_order_against_sorting():
    import numpy as np

    rng = np.random.default_rng(1)
    for n, most in ((0, 2), (1, 2), (300, 4), (300, 1), (2000, 2)):
        words = rng.integers(-1, most, n)
        if n == 2000:
            words[500:900] = words[0:400]  # a long repeat
        known = np.flatnonzero(words >= 0)
        stop = [next((k for k in range(p, n) if words[k] < 0), n) for p in range(n)]
        want = sorted(known.tolist(), key=lambda p: (*words[p : stop[p]].tolist(), *([-5, stop[p]] if stop[p] < n else [-9])))
        got = L.suffix_order(words).tolist()
        assert sorted(got) == known.tolist()
        full = lambda p: words[p : stop[p]].tolist()
        assert [full(p) for p in got] == [full(p) for p in want]


def _leaks(docs, items):
    return {(d, e): v for d, e, *v in L.match_shard([" ".join(x) for x in docs], L.Passages(list(range(len(items))), [" ".join(x) for x in items]))}


def test_any_passage_of_the_rule_is_found():
    """Changed words as often as the rule allows, wherever they stand."""
    rng = random.Random(9)
    item = [f"v{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    docs = []
    for n, at in [(25, (6, 13, 20)), (28, (7, 14, 21)), (27, (5, 11, 17, 22)), (34, (5, 11, 17, 23, 28)), (47, (5, 11, 17, 23, 29, 35, 41))]:
        part = item[40 : 40 + n]
        docs.append([rng.choice(W) for _ in range(30)] + [("changed" if i in at else w) for i, w in enumerate(part)] + [rng.choice(W) for _ in range(30)])
    got = _leaks(docs, [item])
    # the first ends in the fifth word behind its last change, the others agree in 85 of 100
    assert {d for d, _ in got} == set(range(len(docs)))
    few = [("changed" if i % 5 == 4 else w) for i, w in enumerate(item[40:80])]
    assert not _leaks([few], [item])


def test_common_wording_starts_no_match_alone():
    import time

    rng = random.Random(4)
    common = [f"c{chr(97 + i)}" for i in range(20)]
    own = lambda: [f"o{rng.randrange(10**6)}" for _ in range(40)]
    items = [own() + common + own() for _ in range(300)]
    docs = [own() + common + own() for _ in range(2000)] + [items[7][10:70]]
    began = time.time()
    got = _leaks(docs, items)
    assert set(got) == {(2000, 7)} and got[2000, 7][0] == 60
    assert time.time() - began < 20


def test_words_are_alike():
    a = L.words_of(["Der Grünē Hof – m² 'x' low-\nrise Straße"])[0].tolist()
    b = L.words_of(["der GRUNE hof m2 x low-rise strasse"])[0].tolist()
    assert a == b
