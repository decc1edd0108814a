import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.functions import replies as R
from loomgraph.functions import text as T
from loomgraph.functions.vector import cosine, hashed_words


def norm(x):
    x = re.sub(r"[^\w\s.\-]", "", (x or "").lower())
    for a in ("a ", "an ", "the "):
        x = x.replace(a, " ")
    return re.sub(r"\s+", " ", x).strip()


def f1(g, p):
    g, p = norm(g).split(), norm(p).split()
    if not g or not p:
        return float(g == p)
    same = sum((Counter(g) & Counter(p)).values())
    return 2 * same / (len(g) + len(p)) if same else 0.0


CASES = [("The Cat.", "the cat"), ("banana x", "banan x"), ("U.S. co-operate", "u.s. cooperate"), ("", None), (None, "x"), ("a b b c", "b b d"), ("Übergröße, the", "übergröße"), ("x" * 5000, "x")]


def test_normalise_and_f1(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(CASES)], "i int, a string, b string")
    for r in df.select("i", T.normalize_answer("a").alias("n"), T.exact_match("a", "b").alias("em"), T.token_f1("a", "b").alias("f1"), T.token_f1("b", "a").alias("back")).collect():
        a, b = CASES[r["i"]]
        assert r["n"] == norm(a) and r["em"] == float(norm(a) == norm(b)) and abs(r["f1"] - f1(a, b)) < 1e-9 and r["f1"] == r["back"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab .-T'h\"e", max_size=12), st.text(alphabet="ab .-T'h\"e", max_size=12)), min_size=1, max_size=20))
def test_f1_against_counting(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    for r in df.select("i", T.token_f1("a", "b").alias("f1")).collect():
        assert abs(r["f1"] - f1(*pairs[r["i"]])) < 1e-9


def test_json_short_answers_and_types(spark):
    row = spark.createDataFrame([("say ```json\n{\"answer\": \"X\"}\n``` ok", "x {\"answer\": \"Y\"} z", "none", " \"It's  so.\" ", "CAUSED_BY", "backward")], "a string, b string, c string, s string, t string, d string")
    r = row.select(R.reply_field("a", "answer"), R.reply_field("b", "answer"), R.reply_field("c", "answer"), T.clean_short_answer("s"), T.edge_type("t"), T.direction("d")).first()
    assert tuple(r) == ("X", "Y", None, "It's so", "DETAIL", "2->1")


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 0.0], [0.0, 3.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(cosine(df.a, df.b)).collect()] == [1.0, 0.0, 0.0]
    v = spark.createDataFrame([("Aa aa b",), (None,)], "t string").select(hashed_words("t").alias("v")).collect()
    assert sum(v[0]["v"]) == 3 and sum(v[1]["v"]) == 0
