import numpy as np
import pytest

from loomgraph.llm import knn, spellings
from loomgraph.llm.spellings import asks, channel, link_spellings, normal_form, one_edit, posts


def test_forms_and_channel():
    assert normal_form("Telékukla, Dr. Dorothea") == normal_form("dorothea telekukla")
    assert normal_form("FC Titobrema") == normal_form("Titobrema Football Club") and normal_form("Isle of Mihosanzu") == normal_form("Mihosanzu Isl.")
    assert one_edit("abcd", "abdc") and one_edit("abcd", "abc") and one_edit("abcd", "abxd") and not one_edit("abcd", "badc")
    f = normal_form
    for a, b in [("F. Tantrazega", "Frederick Tantrazega"), ("Bertl Mekapsme", "Adalbert Mekapame"), ("Frederick M. Nibrifezan", "Frederick Nibrifezan"), ("Isabella Tranzeeese", "Isabella Tranzehese"), ("L. Drukirana", "Lake Drukirana")]:
        assert channel(f(a), f(b)) is not None
    for a, b in [("Dorothea Telekukla", "Frederick Telekukla"), ("Lake Kelivaro", "Port Kelivaro"), ("Kelivaro Regatta", "Kelivaro Museum of Law"), ("X. Tantrazega", "Frederick Tantrazega")]:
        assert channel(f(a), f(b)) is None


def test_link_spellings(spark):
    names = {"Adalbert Mekapame": 9, "adalbert mekapame": 2, "Bertl Mekapame": 1, "A Mekapame": 1, "Mekapame, Adalbert": 1, "Adalebrt Mekapame": 1, "Adalbert Meka-Pame": 1, "Dorothea Mekapame": 4, "Lake Mekapame": 3, "Mekapame Lake": 1, "null": 5, " ": 2, "<fused_text>": 2, "Q" * 4000: 1}
    rows = [(f" {n} ", i) for n, k in names.items() for i in range(k)] + [(None, 0)]
    got = {tuple(r) for r in link_spellings(spark.createDataFrame(rows, "text string, form int")).collect()}
    one = sorted(["Adalbert Mekapame", "adalbert mekapame", "Bertl Mekapame", "A Mekapame", "Mekapame, Adalbert", "Adalebrt Mekapame", "Adalbert Meka-Pame"])
    assert got == {(a, b) for i, a in enumerate(one) for b in one[i + 1 :]} | {("Lake Mekapame", "Mekapame Lake")}
    assert link_spellings(spark.createDataFrame([], "text string")).count() == 0


def test_every_accepted_pair_meets():
    names = ["Henrietta Mekapame", "Hettie Mekapame", "H. Mekapame", "H. Mekapme", "Hetie Mekapame", "Etta Mekapmae", "Henrietta M.", "M. Henrietta", "M. H.", "M. Hettie", "Henrietta J. Mekapame", "Henrietta", "Hetttie", "Bert Kelivaro Li", "Robert Kelivaro Li", "R. Kelivaro L.", "R Kelivro Li", "Li W", "Li Wei", "Lake Mihosanzu Museum", "Lk Mihosanzu Musem", "L. Mihosanzu Muesum", "New New York", "New N York", "A. B.", "A. B. C.", "Quint Vasa", "Quentin Vasa", "Kit Vasa", "Kitty Vasa", "Katherine Vasa", "Kitt Vassa", "Willie Vasa Orla", "William Vasa Orlla", "Wilie Vasa Orla"]
    forms = sorted({normal_form(n) for n in names})
    accepted = [(v, c) for v in forms for c in forms if v != c and channel(v, c) is not None]
    assert len(accepted) > 30 and all(set(asks(v)) & set(posts(c)) for v, c in accepted)


def test_frequent_words_link_variants(spark):
    rng = np.random.default_rng(3)
    others = ["".join(rng.choice(list("bcdfgk"), 9)) + " Mekapame" for _ in range(60)]  # more than 50 forms with one surname
    rows = [(n,) for n in others] + [("Henrietta Mekapame",)] * 5 + [("H. Mekapame",), ("Hettie Mekapame",)]
    got = {tuple(r) for r in link_spellings(spark.createDataFrame(rows, "text string")).collect()}
    assert got == {("H. Mekapame", "Henrietta Mekapame"), ("H. Mekapame", "Hettie Mekapame"), ("Henrietta Mekapame", "Hettie Mekapame")}


def test_growing_tables_are_not_broadcast(spark):
    df = spark.createDataFrame([(n,) for n in ["Adalbert Mekapame"] * 3 + ["Bertl Mekapame", "A Mekapame", "Mekapame Lake", "Lake Mekapame"]], "text string")
    store = spark._jsparkSession.sharedState().statusStore()
    listed = lambda: store.executionsList().size()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = {store.executionsList().apply(i).executionId() for i in range(listed())}
    assert len(link_spellings(df).collect()) == 4
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    plans = [e.physicalPlanDescription() for i in range(listed()) if (e := store.executionsList().apply(i)).executionId() not in before]
    assert sum("SortMergeJoin" in p for p in plans) > 4 and not any("BroadcastExchange" in p for p in plans)


def brute(vectors, k, least):
    ids = sorted(vectors)
    m = np.array([vectors[i] for i in ids], float)
    m /= np.linalg.norm(m, axis=1)[:, None]
    s, out = np.round(m @ m.T, 6), set()
    for i, a in enumerate(ids):
        for j in sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[i, j], ids[j]))[:k]:
            if s[i, j] >= least:
                out.add((min(a, ids[j]), max(a, ids[j])))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_similar_pairs(spark, monkeypatch, small):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 16))
    vectors = {f"n{i:04d}": [float(np.float32(x)) for x in centres[i % 40] + 0.25 * rng.standard_normal(16)] for i in range(800)}
    for i in range(20):
        vectors[f"same{i:02d}"] = vectors["n0001"]
    if small:  # many shards in each division
        monkeypatch.setattr(knn, "SHARD", 128)
        monkeypatch.setattr(knn, "SAMPLE", 300)
    ids = list(vectors)
    rows = [(ids[i : i + 50], [vectors[x] for x in ids[i : i + 50]]) for i in range(0, len(ids), 50)]
    rows += [(["bad0", "bad1", "bad2", "bad3", None], [None, [0.0] * 16, [1.0] * 15, [float("nan")] * 16, [1.0] * 16]), rows[0], (None, None), ([], [])]
    df = spark.createDataFrame([(*r, "m") for r in rows], "node_ids array<string>, embeddings array<array<float>>, model string")
    got, want = {tuple(r) for r in knn.similar_pairs(df, dim=16).collect()}, brute(vectors, 5, 0.8)
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)
    assert knn.similar_pairs(df.limit(0), dim=16).count() == 0


def test_forest_recall_with_one_percent_of_candidates():
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((1500, 32))
    m = centres[rng.integers(0, 1500, 12_000)] + 0.3 * rng.standard_normal((12_000, 32))
    m /= np.linalg.norm(m, axis=1)[:, None]
    sims = m @ m.T
    np.fill_diagonal(sims, -2)
    top = np.argsort(-sims, axis=1)[:, :5]
    want = {(i, int(j)) for i in range(12_000) for j in top[i] if sims[i, j] >= 0.8}
    got, total = set(), 0
    for division in range(4):  # as a vector is met in the shards of several divisions
        a, b, met = knn.forest_neighbours(m, division, enough=20)
        got |= set(zip(a.tolist(), b.tolist(), strict=True))
        total += met.mean()
        assert met.min() >= 20 and np.bincount(a).max() <= knn.KEEP
    assert total <= 0.01 * len(m) and len(want & got) >= 0.9 * len(want)


def test_divisions_are_even_and_grow_with_the_bits():
    rng = np.random.default_rng(10)
    m = rng.standard_normal((4000, 16)) + 3.0  # far from the origin, so plain signs would be one-sided
    m /= np.linalg.norm(m, axis=1)[:, None]
    d = knn.Divisions(m[:1500], 3, 4, 16)
    for k in range(3):
        n = np.bincount(d.of(m, k), minlength=16)
        assert n.min() > 100 and n.max() < 500
    assert knn.division_count(0) == knn.division_count(3) == knn.DIVISIONS < knn.division_count(10) < knn.division_count(16) < 80


def test_near_equal_vectors_and_ties(spark):
    base = [1.0] + [0.0] * 15
    rows = [[f"v{i:02d}" for i in range(40)], [[1.0, 1e-7 * (i // 2)] + base[2:] for i in range(40)]]
    df = spark.createDataFrame([tuple(rows)], "node_ids array<string>, embeddings array<array<double>>")
    vectors = dict(zip(*rows, strict=True))
    got = {tuple(r) for r in knn.similar_pairs(df, dim=16).collect()}
    assert all(knn.np.round(np.dot(vectors[a], vectors[b]), 6) >= 0.8 for a, b in got) and len({x for p in got for x in p}) == 40


def test_short_forms_are_learnt_from_the_names(spark):
    surnames = ["Mekapame", "Tolvarin", "Osgrabel", "Pindural", "Quastemo"]
    rows = [f"Daniel {s}" for s in surnames for _ in range(3)] + [f"Danny {s}" for s in surnames] + [f"Thomas {s}" for s in surnames] + ["Dorian Mekapame", "danny", None, "", "Daniel", "A"]
    df = spark.createDataFrame([(r,) for r in rows], "text string")
    forms = df.filter("text <> ''").select(spellings.F.lower("text").alias("t")).distinct().select(spellings.F.array_join(spellings.F.array_sort(spellings.F.split("t", " ")), " ").alias("form"))
    assert spellings.learnt_short_forms(forms) == {"danny": "daniel"}
    assert spellings.learnt_short_forms(forms.limit(0)) == {}
    got = {tuple(r) for r in spellings.link_spellings(df).collect()}
    assert {("Daniel " + s, "Danny " + s) for s in surnames} <= got
    assert not any("Thomas" in x or "Dorian" in x for p in got for x in p)


def test_short_forms_are_learnt_beside_many_words(spark):
    rng = np.random.default_rng(11)
    others = ["da" + "".join(rng.choice(list("bcfgk"), 6)) for _ in range(60)]  # more than 50 words with one beginning
    rows = [(f"{w} {s}",) for s in ("mekapame", "tolvarin", "zosgrabel") for w in ["daniel", "danny", *others]]
    assert spellings.learnt_short_forms(spark.createDataFrame(rows, "form string")) == {"danny": "daniel"}


def test_short_forms_meet_by_keys():
    rng = np.random.default_rng(12)
    drawn = sorted({"".join(rng.choice(list("anise"), rng.integers(1, 8))) for _ in range(400)}) + ["danny", "daniel", "zach", "zachary", "thea", "dorothea", "bess", "bessie"]
    pairs = [(x, y) for x in drawn for y in drawn if spellings.shortens(x, y)]
    assert len(pairs) > 50 and all(set(spellings.short_keys(x)) & set(spellings.full_keys(y)) for x, y in pairs)


@pytest.mark.parametrize(("short", "full", "yes"), [("danny", "daniel", True), ("zach", "zachary", True), ("thea", "dorothea", True), ("inst", "institute", True), ("lake", "port", False), ("robert", "thomas", False), ("ann", "anna", True), ("karl", "carl", False), ("x", "xaver", False), ("fred", "fred", False), ("hettie", "henrietta", False)])
def test_looks_of_short_forms(short, full, yes):
    assert spellings.shortens(short, full) is yes
