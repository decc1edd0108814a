import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from loomgraph.llm import neardup, packing, truncation
from loomgraph.llm.defects import LanguageModel, _capitals, bare, defect_of, defective_pairs, fit_language_model, judge, whole_share
from loomgraph.llm.endings import cut_at_end
from loomgraph.llm.leakage import RADIUS, WINDOW, ItemIndex, fingerprints, leak_report, leaked_items
from loomgraph.llm.neardup import common_share, near_duplicates
from loomgraph.llm.truncation import truncated, truncation_report
from loomgraph.llm.words import chunks, word_keys, words

rng = random.Random(11)
VOCAB = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(900)]


def text(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def edited(t, share):
    w = t.split()
    for i in rng.sample(range(len(w)), int(len(w) * share)):
        w[i] = rng.choice(VOCAB) + "x"
    rng.shuffle(w)
    return " ".join(w)


def near_rows():
    rows = []
    for i in range(60):
        t = text(rng.choice([14, 20, 60, 300]))
        rows.append(("doc", i * 10, t))
        for k in range(rng.randint(0, 3)):
            rows.append(("doc", i * 10 + k + 1, edited(t, rng.choice([0.0, 0.05, 0.1, 0.3]))))
        rows.append(("prop", i * 10, t))
    return rows + [("doc", 9001, None), ("doc", 9002, ""), ("doc", 9003, "too short"), ("doc", None, text(20)), rows[0]]


def brute_near(rows):
    out = set()
    rows = [r for r in dict.fromkeys(rows) if r[1] is not None and len(words(r[2])) >= 12]
    for i, (ka, a, ta) in enumerate(rows):
        for kb, b, tb in rows[i + 1 :]:
            if ka == kb and a != b:
                common, longest = common_share(ta, tb)
                if 5 * common >= 4 * longest:
                    out.add((ka, min(a, b), max(a, b)))
    return out


def test_near_duplicates(spark, monkeypatch):
    rows = near_rows()
    df = spark.createDataFrame([(*r, "e") for r in rows], "kind string, id long, text string, cid string")
    want = brute_near(rows)
    got = {tuple(r) for r in near_duplicates(df).collect()}
    assert got <= want and len(got) >= 0.98 * len(want)
    monkeypatch.setattr(neardup, "HOT", 3)  # lists are split before the exchange
    monkeypatch.setattr(neardup, "ROWS", 300)
    assert {tuple(r) for r in near_duplicates(df).collect()} == got
    monkeypatch.setattr(neardup, "LIST", 2)  # every list is skipped and split
    split = {tuple(r) for r in near_duplicates(df).collect()}
    assert split <= want and len(split) >= 0.97 * len(want)
    assert near_duplicates(df.limit(0)).count() == 0


def test_many_copies_give_a_star(spark, monkeypatch):
    monkeypatch.setattr(neardup, "EXPANDED", 3)
    t = text(20)
    other = " ".join([*t.split()[:-1], "zzz"])
    df = spark.createDataFrame([("doc", i, t.upper() if i % 2 else t) for i in range(6)] + [("doc", 10, other)], "kind string, id long, text string")
    assert {tuple(r)[1:] for r in near_duplicates(df).collect()} == {(0, i) for i in range(1, 6)} | {(0, 10)}


def test_large_groups_give_all_pairs(spark, monkeypatch):
    w = [f"word{i}" for i in range(20)]
    rows = [("doc", i, " ".join(rng.sample(w, len(w)))) for i in range(40)]  # one bag of words in many orders
    rows += [("doc", 100 + i, " ".join(w[:-1]).upper() + " other") for i in range(35)]  # exact copies, near the first group
    df = spark.createDataFrame(rows + rows[:5], "kind string, id long, text string")
    want = brute_near(rows)
    assert len(want) == 75 * 74 // 2
    assert {tuple(r) for r in near_duplicates(df).collect()} == want
    monkeypatch.setattr(neardup, "BLOCK", 8)  # groups in several blocks
    assert {tuple(r) for r in near_duplicates(df).collect()} == want


def test_labelled_texts_are_judged_whole():
    en, de = "the house was built by people who came from the north and wanted to live there ", "das haus wurde von menschen gebaut die aus dem norden kamen und dort leben wollten "
    odd = ("de", "zebra " + en * 15 + de * 60)  # a long foreign opening
    judged = []

    class Watched(LanguageModel):
        def best(self, words):
            judged.append(len(words))
            return super().best(words)

    Watched([("en", en * 20), ("de", de * 20), odd])
    assert max(judged) > 900


def test_shares_of_batches():
    a = [text(n) for n in (3, 40, 700, 0, 12)] * 3
    b = [edited(t, 0.2) if t else "" for t in a]
    b[1] += " " + " ".join(a[1].split()[:9])
    got = {}
    for rows, common, longest in neardup._shares(pd.Series(a), pd.Series(b)):
        got |= {int(r): (int(c), int(n)) for r, c, n in zip(rows, common, longest, strict=True)}
    assert got == {i: common_share(x, y) for i, (x, y) in enumerate(zip(a, b, strict=True))}


def test_runs_across_batches():
    frames = pd.DataFrame({"key": [1, 1, 1, 2, 3, 3], "id": [1, 2, 3, 9, 5, 6], "two": [0, 0, 0, 0, 0, 1], "step": [0] * 6})
    a, b = neardup._alike(frames["id"].to_numpy()[:3], np.zeros(3, np.int64))
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == {(1, 2), (1, 3), (2, 3)}


def test_word_keys():
    texts = ["Ein Maß, zwei MASSE!", None, "", "...", "a_b ǅ ½ x² İstanbul ΟΔΟΣ", "ein " * 3, "\ud800 zwei"]
    lengths, keys = word_keys(texts)
    assert lengths.tolist() == [len(words(t)) for t in texts]
    flat = [w for t in texts for w in words(t)]
    assert len(set(zip(flat, keys.tolist(), strict=True))) == len(set(flat)) == len(set(keys.tolist()))
    many = [text(30) for _ in range(50)]
    cut = list(chunks(many, 500))
    assert len(cut) > 10 and np.array_equal(np.concatenate([k for _, _, k in cut]), word_keys(many)[1]) and [i for r, _, _ in cut for i in r] == list(range(50))
    assert word_keys([])[1].size == word_keys([None])[1].size == 0


def test_fingerprints_and_blocks():
    k = word_keys([text(5000)])[1]
    f = fingerprints(k)
    assert len(f) == 5000 - WINDOW + 1 and f[100] == fingerprints(k[100 : 100 + WINDOW])[0]
    items = [(i, text(30)) for i in range(40)]
    ix = ItemIndex(items)
    probe = ix.prints[:200].copy()
    for i in range(200):  # any change within the radius is found
        for bit in rng.sample(range(64), rng.randint(0, RADIUS)):
            probe[i] ^= np.uint64(1) << np.uint64(bit)
    at, win = ix.near(probe, ix.masks())
    assert all((i, i) in set(zip(at.tolist(), win.tolist(), strict=True)) for i in range(200))


def test_leaks_against_brute_force(spark):
    items = [(1, [text(40), None]), (2, [text(12), text(30)]), (3, ["short text", None]), (4, None), (None, [text(20)])]
    docs = [(i, text(80)) for i in range(30)]
    for i in range(0, 30, 3):
        q = rng.choice(items[:2])
        t = next(x for x in q[1] if x)
        w = t.upper().split()
        n = rng.choice([11, 12])
        docs.append((100 + i, text(10) + " <b>" + ", ".join(w[:n]) + "! " + text(9)))
    docs += [(300, None), (301, ""), (302, text(70_000) + " " + items[0][1][0]), docs[0], (None, items[0][1][0])]
    d = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, question_id int")
    q = spark.createDataFrame(items, "question_id long, texts array<string>")
    grams = {}
    for i, ts in items:
        for t in ts or []:
            w = words(t)
            if i is not None:
                for j in range(len(w) - 11):
                    grams.setdefault(tuple(w[j : j + 12]), set()).add(i)
    want = set()
    for i, t in docs:
        w = words(t)
        if i is not None:
            want |= {(i, x) for j in range(len(w) - 11) for x in grams.get(tuple(w[j : j + 12]), ())}
    found = leaked_items(d, q)
    assert {tuple(r) for r in found.collect()} == want and len(want) > 3
    assert {tuple(r) for r in leaked_items(d, q, windows=10).collect()} == want  # more items than an index holds
    assert leak_report(found, q).count() == len({x for _, x in want})
    assert leaked_items(d.limit(0), q, windows=10).count() == 0
    assert leaked_items(d, q.limit(0)).count() == 0 == leaked_items(d.limit(0), q).count()


@pytest.mark.parametrize("windows", [1_000, 5])
def test_edited_passages_leak_below_full_similarity(spark, windows):
    item = text(24)
    changed = item.split()
    for i in (3, 14):  # no 12 words in a row are left
        changed[i] = "changed"
    d = spark.createDataFrame([(1, text(30) + " " + " ".join(changed) + " " + text(30)), (2, text(200)), (3, item)], "doc_id long, text string")
    q = spark.createDataFrame([(7, [item])], "question_id long, texts array<string>")
    changed[8] = "also"
    assert {tuple(r) for r in leaked_items(d, q, windows=windows).collect()} == {(3, 7)}
    assert {tuple(r) for r in leaked_items(d, q, least=0.9, width=1, radius=12, windows=windows).collect()} == {(1, 7), (3, 7)}


@pytest.mark.parametrize("seed", range(8))
def test_plan_bins(seed):
    r = random.Random(seed)
    cap = r.choice([10, 37, 2048])
    counts = Counter(r.randint(1, cap) for _ in range(r.choice([1, 7, 400])))
    got, bins = Counter(), 0
    for pattern, n in packing.plan_bins(counts, cap):
        assert sum(pattern) <= cap and n > 0
        bins += n
        for s in pattern:
            got[s] += n
    assert got == counts and bins <= 1.25 * -(-sum(s * n for s, n in counts.items()) // cap) + 1


def fewest(sizes, cap):
    """The least possible number of bins, by trying every choice."""
    sizes = tuple(sorted(sizes, reverse=True))
    best = len(sizes)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= sizes[k]:
                rest = list(rooms)
                rest.remove(room)
                place(k + 1, (*rest, room - sizes[k]))
        place(k + 1, (*rooms, cap - sizes[k]))

    place(0, ())
    return best


def test_reduction_keeps_the_optimum():
    r, shrunk, triples = random.Random(5), 0, 0
    for _ in range(5000):
        cap = r.choice([10, 20, 30, 60])
        low = r.choice([1, 1, cap // 6, cap // 4])
        sizes = [r.randint(low, cap) if r.random() < 0.5 else r.randint(low, max(low, cap // 2)) for _ in range(r.randint(3, 8))]
        fixed, rest = packing.reduce_bins(Counter(sizes), cap)
        n = sum(fixed.values())
        assert n + fewest(Counter(rest).elements(), cap) == fewest(sizes, cap), (cap, sizes)
        shrunk += n > 0
        triples += any(len(p) == 3 for p in fixed)
        assert sum((Counter({s: p.count(s) * k for s in set(p)}) for p, k in fixed.items()), Counter(rest)) == Counter(sizes)
    assert shrunk > 3000 and triples > 100
    assert packing.reduce_bins({15: 1, 7: 1, 4: 1, 1: 1, 21: 1, 26: 1}, 30)[0][(26, 4)] == 1


def test_plan_is_never_worse_than_best_fit():
    r = random.Random(6)
    for _ in range(300):
        counts = Counter(r.randint(1, 100) for _ in range(r.randint(8, 200)))
        assert sum(n for _, n in packing.plan_bins(counts, 100)) <= sum(n for _, n in packing._best_fit(Counter(counts), 100))


def test_pack(spark):
    sizes = [(i, rng.choice([1, 5, 700, 1024, 1500, 2048, 5000])) for i in range(500)] + [(900, 0), (901, None), (None, 5), (902, 2048 * 3), (0, None)]
    df = spark.createDataFrame([*sizes, sizes[0]], "doc_id long, n_tokens long")
    rows = packing.pack(df).collect()
    load = Counter()
    for r in rows:
        load[r["context_id"]] += r["n_tokens"]
    assert max(load.values()) <= 2048
    per = Counter()
    for r in rows:
        per[r["doc_id"]] += r["n_tokens"]
    assert per == Counter({i: n for i, n in sizes if i is not None and n})
    assert len(rows) == len({(r["doc_id"], r["part"]) for r in rows})
    whole = {i for i, n in sizes if i is not None and n and n <= 2048}
    assert all(r["part"] == 0 for r in rows if r["doc_id"] in whole)
    rep = packing.pack_report(packing.pack(df)).first()
    rooms = []  # plain best fit in decreasing order, item by item
    for n in sorted((r["n_tokens"] for r in rows), reverse=True):
        fits = [i for i, room in enumerate(rooms) if room >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(2048 - n)
    assert rep["least_contexts"] <= rep["n_contexts"] <= len(rooms)
    assert packing.pack(df.limit(0)).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (4, "<|endoftext|> x" * 2000)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in packing.token_counts(df).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 2000


WHOLE = ["A whole sentence.", "It closed in 1890. (Ann Lee, 1943)", "Text.\nExternal links", "Text.\nLast edited 7 November 2012", "Text.\n\n— Ann Lee, Port 1908", "Text.\nwool | 909 t\ntin | 42 t", "Text.\nSee also: A Town; B Hall; Lake C", "He said “It rains.”", '"... and still the rain..."', "<p>Done.</p>", "Text.\nReferences\n[1] Ann Lee, The Mill, 1860", "by the Mill Corp..", "Text.\nCategories: Law in A | Art in B", "What is it?”"]
CUT = ["It was the gre", "It was the great wall of", "It was a mo-", "He went to the…", "He went to the ...", "He went [...]", "Some text in (more)", "the people of Read more", "crates of <a hre", "of Dorothea &am", "it ended at �", "Text.\nIsabella Gema", "Text.\nAs a young printer, Isabella"]


def test_endings():
    assert [t for t in WHOLE if cut_at_end(t)] == [] and [t for t in CUT if not cut_at_end(t)] == []
    assert not cut_at_end(None) and not cut_at_end("  \n") and cut_at_end("Text.\nLast edited 7 November 2012", True) and not cut_at_end("Done.", True)


def test_truncated(spark):
    rows = [(i, "lim", ("Word and word " * 50)[:499].strip() + "x" * (500 - len(("Word and word " * 50)[:499].strip()))) for i in range(20)]
    rows += [(100 + i, "lim", "A sentence that ends. " * (i + 1)) for i in range(60)]
    rows += [(200, "other", "It was the gre"), (201, None, "cut in the midd"), (202, "other", None), (203, "other", "  "), (204, None, "Fine."), (200, "other", "It was the gre"), (205, "other", "word " * 30_000)]
    rows += [(300, "lim", ("A sentence that ends. " * 30)[:478] + "\nLast edited 7 May 20")]
    df = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, source string, text string, at_limit boolean")
    got = {r["doc_id"]: r["at_limit"] for r in truncated(df).collect()}
    assert set(got) >= {*range(20), 200, 201, 205} and not set(got) & {202, 203, 204, *range(100, 160)}
    assert got[0] and not got[200]
    rep = {r["source"]: r["n_cut"] for r in truncation_report(df, truncated(df)).collect()}
    assert rep["other"] == 2 and rep[""] == 1
    assert truncated(df.limit(0)).count() == 0


def test_false_discovery_control_ranks_over_all(spark, monkeypatch):
    r = random.Random(2)
    rows = [("s", "chars", i, r.randint(3, 9), 10 ** r.uniform(-9, 0) if i % 3 else 10 ** r.uniform(-400, -1) + 0.0) for i in range(400)]
    df = spark.createDataFrame(rows, "source string, measure string, length int, n int, p double")
    order = sorted(x[4] for x in rows)
    cut = max((p for k, p in enumerate(order, 1) if p <= k * truncation.FDR / len(rows)), default=-1)
    want = {x[2] for x in rows if x[4] <= cut}
    assert {x["length"] for x in truncation.significant_lengths(df).collect()} == want and want
    assert truncation.significant_lengths(df.limit(0)).count() == 0


SENTENCES = {
    "en": "the house of the old man was near the river and it was built by his son who had come from the town in the year after the war. no document of the council says that they could not agree on it, and this would contradict what other people have told us. which of the two was the first to leave is not known. she kept the letter that he wrote when the work was done",
    "de": "das haus des alten mannes war nahe dem fluss und es wurde von seinem sohn gebaut der aus der stadt kam und nach dem krieg dort wohnte. kein schreiben des rates sagt dass sie sich nicht einigen konnten, und das widerspricht dem was andere leute uns gesagt haben. wer von den beiden zuerst ging ist nicht bekannt. sie behielt den brief den er schrieb als die arbeit getan war",
    "fr": "la maison du vieil homme était près de la rivière et elle fut construite par son fils qui était venu de la ville après la guerre. aucun document du conseil ne dit qu'ils ne pouvaient pas se mettre d'accord, et cela contredit ce que les autres nous ont dit. lequel des deux est parti le premier n'est pas connu. elle garda la lettre qu'il écrivit quand le travail fut fini",
    "es": "la casa del hombre viejo estaba cerca del río y fue construida por su hijo que había venido de la ciudad después de la guerra. ningún documento del consejo dice que no pudieron ponerse de acuerdo, y esto contradice lo que otras personas nos han dicho. no se sabe cuál de los dos se fue primero. ella guardó la carta que él escribió cuando el trabajo estaba hecho",
}


@pytest.fixture(scope="module")
def model():
    return LanguageModel([(k, (v + ". ") * 8) for k, v in SENTENCES.items()])


@pytest.mark.parametrize(
    ("question", "answer", "defect"),
    [
        ("Who built the old house of the town?", None, "empty"), ("Who built it?", " **  ** ", "empty"), ("Who built it?", '{"answer": null}', "empty"), ("Who built it?", "N/A", "empty"),
        ("Who built it?", "I'm sorry, but I cannot answer this question.", "refusal"), ("Who built it?", "Das lässt sich nicht beantworten.", "refusal"), ("Who built it?", "No document contradicts it, and the council could not agree.", None),
        ("Who built the old house of the town?", "who biult the old house of the town", "copy"), ("Who built the old house of the town?", "Question: Who built the old house of the town?", "copy"), ("Who built the old house of the town?", "Ann Lee built the old house of the town.", None),
        ("Who built the house?", "The house was built by the son of the", "truncated"), ("Who built the house?", "It was the son who...", "truncated"), ("Who built the house?", "The Royal Mill of Lake", None), ("Who built the house?", "1890", None),
        ("Was it built by the son who came from the town?", "Nein", "language"), ("Was it built by the son who came from the town?", "Yes", None), ("Who built the house of the man who came from the town?", "Das Haus wurde von seinem Sohn gebaut, der aus der Stadt kam.", "language"), ("Who built the house of the man?", "It was built by his son.", None),
        (None, "It was built by his son.", None), ("", "x" * 100_000 + ".", None),
    ],
)
def test_defects(model, question, answer, defect):
    assert defect_of(question, answer, model) == defect


@pytest.mark.parametrize("answer", ["She left because she was unable to find work.", "The council decided that it could not provide the funds.", "He could not give a date for the opening of the mill.", "They do not know each other, he wrote.", "The mill does not contain any wood."])
def test_stories_of_inability_are_no_refusals(model, answer):
    assert defect_of("Who built the old house of the town?", answer, model) is None


def test_end_of_text_likelihood_decides(model):
    done, cut = judge("Who built it?", "It was built after the war", model), judge("Who built it?", "It was built by the man and th", model)
    assert done[0] == cut[0] == "truncated/" and done[1] < 0 < cut[1]
    assert defect_of("Who built it?", "It was built after the war", model) is None and defect_of("Who built it?", "It was built by the man and th", model) == "truncated"
    # where nearly no sentence without a full stop is whole, none is taken for whole
    assert defect_of("Who built it?", "It was built after the war", model, share=0.001) == "truncated"
    assert whole_share([(-3.0, 90), (3.0, 10)]) > 0.8 and whole_share([(3.0, 90), (0.0, 10)]) < 0.1 and whole_share([]) == 0.5


def test_prompts_are_in_labelled_languages():
    m = LanguageModel([(k, (v + ". ") * 8) for k, v in SENTENCES.items()], ["¿En qué ciudad nació Ann Lee?", "¿En qué ciudad nació Bo Day?"])
    p = m.asked("¿En qué ciudad nació Cy Fox?")
    assert set(p) == set(SENTENCES) and p["es"] > 0.99 and m.asked("") != {} and LanguageModel([]).asked("Who?") == {}


def test_model_is_fitted_on_all_documents_and_questions(spark):
    docs = [(k, " ".join(rng.sample(v.split(), 40)) + f" {'abcdefghij'[i % 10]}{k}{'klmnopqrst'[i // 10 % 10]}{'uvwx'[i // 100]} end. " + (v + ". ")) for k, v in SENTENCES.items() for i in range(320)]
    docs += [("en", SENTENCES["de"] + ". ")] * 3 + [("de", "X" * 300), ("fr", SENTENCES["fr"] + " ... ")]
    asked = [f"Who built the {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100 % 10]}{'efg'[i // 1000]} mill?" for i in range(2100)]
    want = LanguageModel(docs, asked)
    got = fit_language_model(spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], "doc_id long, lang string, text string"), spark.createDataFrame([(q,) for q in [*asked, None]], "question string"))
    assert got.labels == want.labels and got.vocabulary == want.vocabulary and got.log.keys() == want.log.keys() and got.unseen == pytest.approx(want.unseen)
    assert all(got.log[k].keys() == want.log[k].keys() and got.log[k] == pytest.approx(want.log[k]) for k in want.log)
    assert (got.ends, got.places) == (want.ends, want.places)
    assert all(got.end_odds(x) == want.end_odds(x) for x in [w for _, t in docs[::40] for w in t.split()])


def test_texts_in_capitals():
    drawn = ["".join(rng.choices("aàßz AÀÉZ.1²_ǅЖж\ud800漢", weights=[w, w, w, w, *[1] * 14], k=rng.randint(0, 40))) for w in (0, 1, 3) for _ in range(2000)]
    want = [bool(x := [c for c in t if c.isalpha()]) and sum(c.isupper() for c in x) > 0.7 * len(x) for t in drawn]
    assert [_capitals(t) for t in drawn] == want and 100 < sum(want) < 5000


def test_defective_pairs(spark):
    docs = spark.createDataFrame([(i * 4 + j, k.upper(), (v + ". ") * 3) for j, (k, v) in enumerate(SENTENCES.items()) for i in range(4)] + [(99, None, None)], "doc_id long, lang string, text string")
    asked = [(1, "Who built the old house of the town?", "Ann Lee"), (2, "Wer hat das alte Haus der Stadt gebaut?", None), (3, None, "N/A"), (None, "Who?", "")]
    q = spark.createDataFrame([*asked, asked[0]], "question_id long, question string, answer string")
    given = [(1, 1, "It was built by the son of the old man."), (2, 1, "Das Haus wurde von seinem Sohn gebaut, der aus der Stadt kam."), (3, 2, "Das Haus wurde von seinem Sohn gebaut, der aus der Stadt kam."), (4, 1, None), (5, 9, "I cannot answer this."), (6, None, "It was the son who..."), (7, 1, "who built the old house of the town"), (None, 1, ""), (8, 1, "word " * 50_000 + ".")]
    a = spark.createDataFrame([(*r, "x") for r in [*given, given[1]]], "answer_id long, question_id long, answer string, defect string")
    got = {tuple(r) for r in defective_pairs(a, q, docs).collect()}
    assert got == {("result", 2, "language"), ("result", 4, "empty"), ("result", 5, "refusal"), ("result", 6, "truncated"), ("result", 7, "copy"), ("gold", 2, "empty"), ("gold", 3, "empty")}
    assert {r["defect"] for r in defective_pairs(a, q, docs.limit(0)).collect()} >= {"empty", "refusal", "copy"} and defective_pairs(a.limit(0), q.limit(0), docs).count() == 0


def test_bare():
    assert bare('{"answer": "X"}') == "X" and bare("**Answer: X**") == "X" and bare("<p></p>") == "" and bare("[]") == ""
