from lodestack.llm import encoding as E

SOUND = ["Le théâtre près de la forêt reste à étudier, l’été déjà passé.", "Für die Südfassade gilt ein Höchstwert von 12 m² – gemäß Prüfung.", "El muro de contención añade «valor» aquí.",
         "The owner’s “façade” is ≤ 25 °C and 3 µg/m³.", "PROJET « ÂME DU LIEU » – NIVEAU À REVOIR.", "Станция «Верба»: навес 12 м.", "│ Achse │ Höhe │\n├───┼───┤", "Use √2 : 1, ΔT ≤ 4 K, Ω."]


def garble(x, right, wrong):
    return "".join(bytes([b]).decode(wrong, "ignore") or chr(b) for b in x.encode(right))


def test_find_and_restore(spark):
    rows = [(i, SOUND[i % len(SOUND)] + f" {i}", "s") for i in range(400)]
    cases = {}
    for k, (right, wrong) in enumerate([("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp1251")]):
        for j in range(4):
            cases[1000 + 10 * k + j] = (SOUND[j], garble(SOUND[j], right, wrong))
    twice = garble(garble(SOUND[0], "utf-8", "cp1252"), "utf-8", "cp1252")
    cases[2000] = (SOUND[0], twice)
    rows += [(i, g, "S ") for i, (_, g) in cases.items()] + [(3000, "Une fa�ade", None), (3001, None, "s"), (3002, "", "s"), (3003, "plain", "s")]
    rows.append((3004, SOUND[1] + "\n" + garble(SOUND[0], "utf-8", "cp1252") + "\n" + SOUND[3], "s"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in E.repair_encoding(df).collect()}
    assert set(got) == set(cases) | {3000, 3004}
    right = sum(got[i].restored_text == x for i, (x, _) in cases.items())
    assert right >= 0.9 * len(cases)
    assert got[3000].n_lost == 1 and got[3004].restored_text == "\n".join([SOUND[1], SOUND[0], SOUND[3]])
    assert E.repair_encoding(df.limit(0)).count() == 0


def test_decoys_have_no_common_multibyte_reading():
    for w in ("CORAÇÃO,", "Maçã", "Ângulo", "Ã", "√2", "Станция"):
        assert not any(E.CHAINS[k][:2] in (("cp1252", "utf-8"), ("latin-1", "utf-8")) for k, _, _ in E.candidates(w))
