"""Problem 4: variant spellings of names, by noisy-channel attribution."""

from __future__ import annotations

import math
import re
import unicodedata
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .survivor import names_something, trimmed

# Titles, which are no part of a name.
TITLES = frozenset("mr mrs ms mme mlle dr prof sir dame lady lord herr frau señor señora don doña".split())
# Short words that spellings leave out or move.
SMALL = frozenset("the of de la le der die das von du des and".split())
# Abbreviations of words in names of places, organisations and events.
ABBREVIATIONS = {
    "st": "saint", "ste": "saint", "mt": "mount", "pt": "port", "isl": "island", "is": "island", "isle": "island", "lk": "lake",
    "inst": "institute", "univ": "university", "uni": "university", "mus": "museum", "corp": "corporation", "co": "company",
    "assn": "association", "assoc": "association", "orch": "orchestra", "rwy": "railway", "rly": "railway", "ry": "railway",
    "reg": "regatta", "gt": "great", "fest": "festival", "soc": "society", "acad": "academy", "dept": "department",
    "bros": "brothers", "intl": "international", "natl": "national", "govt": "government", "ltd": "limited", "inc": "incorporated",
}
# Short forms of given names and the names they stand for.
NICKNAMES = {
    "bertl": "adalbert albert", "bert": "adalbert albert herbert robert", "alex": "alexander alexandra", "sandy": "alexander alexandra", "lex": "alexander", "al": "albert alexander adalbert",
    "charlie": "charles", "chuck": "charles", "chas": "charles", "dora": "dorothea", "dot": "dorothea", "dottie": "dorothea", "dolly": "dorothea", "thea": "dorothea",
    "liz": "elizabeth", "lizzie": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "eliza": "elizabeth", "bess": "elizabeth", "fred": "frederick alfred", "freddie": "frederick alfred", "freddy": "frederick", "fritz": "frederick",
    "gabi": "gabriela", "gaby": "gabriela", "gabby": "gabriela", "ella": "gabriela isabella", "etta": "henrietta", "hettie": "henrietta", "hetty": "henrietta", "harriet": "henrietta",
    "bella": "isabella", "izzy": "isabella", "belle": "isabella", "joe": "joseph", "joey": "joseph", "jo": "joseph", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kitty": "katherine", "kit": "katherine christopher",
    "len": "leonard", "lenny": "leonard", "leo": "leonard", "maggie": "margaret", "peggy": "margaret", "meg": "margaret", "greta": "margaret", "nick": "nicholas", "nico": "nicholas", "nicky": "nicholas", "klaus": "nicholas",
    "ollie": "oliver", "olly": "oliver", "noll": "oliver", "pippa": "philippa", "pip": "philippa", "quint": "quentin", "quin": "quentin", "bob": "robert", "bobby": "robert", "rob": "robert", "robbie": "robert", "bertie": "robert albert",
    "sam": "samuel", "sammy": "samuel", "tom": "thomas", "tommy": "thomas", "ulla": "ursula", "ursel": "ursula", "uschi": "ursula", "val": "valentin", "vicky": "victoria", "tori": "victoria", "vic": "victoria", "vicki": "victoria",
    "bill": "william", "billy": "william", "will": "william", "willy": "william", "willie": "william", "yoli": "yolanda", "yola": "yolanda", "zach": "zachary", "zack": "zachary", "zac": "zachary",
}

#: Log likelihoods of what writers do to a word of the canonical form.
TYPO, INITIAL, NICKNAME, EXTRA = math.log(0.02), math.log(0.05), math.log(0.08), math.log(0.1)
#: Log prior of a rare spelling being a name of its own rather than a variant of a form it can come from.
OWN = math.log(1e-4)
#: Words a nickname can be short for, or that are nicknames themselves.
GIVEN = frozenset(NICKNAMES) | frozenset(n for meant in NICKNAMES.values() for n in meant.split())
_FIXED = dict(NICKNAMES)
#: A short form is learnt from so many different names at least, that are this share of the names it is in.
SEEN, SHARE = 3, 0.5


def _use(learnt: dict[str, str]) -> None:
    """Let this process know the short forms learnt from the data beside the fixed ones."""
    global NICKNAMES, GIVEN
    merged = {k: " ".join(sorted({*_FIXED.get(k, "").split(), *learnt.get(k, "").split()})) for k in {*_FIXED, *learnt}}
    if merged != NICKNAMES:
        NICKNAMES = merged
        GIVEN = frozenset(merged) | frozenset(n for meant in merged.values() for n in meant.split())
        for cached in (_slips, _meant, _weakened):
            cached.cache_clear()


def _stem(short: str) -> str:
    """A word without its pet ending and the letter doubled before it."""
    stem = re.sub(r"(?:ie|ey|y|i|e|s)$", "", short)
    return stem[:-1] if len(stem) > 3 and stem[-1] == stem[-2] else stem


def shortens(short: str, full: str) -> bool:
    """Whether a word looks like a short form of another: its beginning with a pet ending or none, or its end."""
    if short == full or min(len(short), len(full)) < 2 or (len(short) > 3 and len(full) > 3 and one_edit(short, full)):
        return False
    stem = _stem(short)
    if len(stem) > 2 and full.startswith(stem) and len(stem) < len(full) or short == stem and len(short) > 2 and full.startswith(short):
        return True
    return len(short) > 3 and len(short) < len(full) and full.endswith(short)


def short_keys(word: str) -> list[str]:
    """What a word as a short form shares with every word it ``shortens``: the beginning or the end of that one."""
    stem = _stem(word)
    return ["^" + stem] * (len(stem) > 2) + ["$" + word] * (len(word) > 3)


def full_keys(word: str) -> list[str]:
    """The beginnings and ends of a word that a short form of it can have."""
    return ["^" + word[:i] for i in range(3, len(word))] + ["$" + word[-i:] for i in range(4, len(word))]


def learnt_short_forms(forms: DataFrame) -> dict[str, str]:
    """Short forms and what they stand for, from normal forms that differ in one word.

    A word x is taken for a short form of y when it looks like one and at least SEEN different names, and the
    SHARE of all names that have x, are also there with y in its place; all names count, however many words are met
    in one place. Which words look like short forms of which is told first, from the different words by keys; y
    must be in the SHARE of as many names as x, so the rows that are compared grow with the names only. What is
    learnt is a list of words, so it is small beside the data.
    """

    @F.pandas_udf("array<struct<rest:string,word:string>>")
    def parts(forms: pd.Series) -> pd.Series:
        def of(form: str) -> list[dict[str, str]]:
            w = form.split()
            return [{"rest": " ".join(w[:i] + w[i + 1 :]), "word": x} for i, x in enumerate(w) if len(x) > 1 and x.isalpha()] if len(w) > 1 and max(map(len, w)) > 1 else []

        return forms.map(of)

    scratch = Scratch(forms.sparkSession, "short-forms")
    each = scratch.write(forms.select(F.explode(parts("form")).alias("p")).select("p.rest", "p.word").distinct(), "each")
    often = scratch.write(each.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= SEEN), "often")
    keys_of = {f: F.pandas_udf(lambda s, f=f: s.map(f), "array<string>") for f in (short_keys, full_keys)}
    looks = F.pandas_udf(lambda a, b: pd.Series([shortens(x, y) for x, y in zip(a, b, strict=True)], dtype=bool), "boolean")
    shorts = often.select(F.col("word").alias("x"), F.col("n").alias("all"), F.explode(keys_of[short_keys]("word")).alias("key"))
    fulls = often.select(F.col("word").alias("y"), F.col("n").alias("ny"), F.explode(keys_of[full_keys]("word")).alias("key"))
    alike = shorts.join(fulls.hint("merge"), "key").filter((F.col("x") != F.col("y")) & (F.col("ny") >= SHARE * F.col("all"))).select("x", "y", "all").distinct().filter(looks("x", "y"))
    asked = each.withColumnRenamed("word", "x").join(alike.hint("merge"), "x")
    met = asked.join(each.withColumnRenamed("word", "y").hint("merge"), ["rest", "y"]).groupBy("x", "y", "all").agg(F.count(F.lit(1)).alias("n"))
    out: dict[str, str] = {}
    for r in met.filter((F.col("n") >= SEEN) & (F.col("n") >= SHARE * F.col("all"))).select("x", "y").orderBy("x", "y").collect():
        out[r["x"]] = f"{out[r['x']]} {r['y']}" if r["x"] in out else r["y"]
    scratch.drop(each, often)
    return out


def normal_form(text: str) -> str:
    """The words of a spelling in small letters without accents, abbreviations written out, in order of the alphabet.

    Spellings with one form differ only in case, accents, order, punctuation, titles and abbreviations.
    """
    t = "".join(c for c in unicodedata.normalize("NFKD", text.replace("ß", "ss").replace("ø", "o").replace("ł", "l")) if not unicodedata.combining(c)).lower()
    t = re.sub(r"\bf\.?\s?c\b\.?", " football club ", t)
    t = re.sub(r"(?<=[a-z])[-'’‐‑](?=[a-z])", "", t)
    words = [ABBREVIATIONS.get(w, w) for w in re.findall(r"[^\W_]+", t) if w not in TITLES]
    kept = [w for w in words if w not in SMALL] or words
    return " ".join(sorted(kept)) or t.strip()


def one_edit(a: str, b: str) -> bool:
    """Whether one letter was added, left out or changed, or two neighbours swapped."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (i + 1 < len(a) and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])


def _stands_for(short: str, full: str) -> bool:
    meant = NICKNAMES.get(short, "").split()
    return full in meant or (full in NICKNAMES and bool(set(meant) & set(NICKNAMES[full].split())))


def level(form: str) -> int:
    """How much of the name a form leaves out: its initials and short forms of given names."""
    return sum(len(w) == 1 or w in NICKNAMES for w in form.split())


def channel(variant: str, canonical: str) -> float | None:
    """Log likelihood of a writer making ``variant`` of ``canonical``, or None where none would."""
    v, c = variant.split(), canonical.split()
    left = list(c)
    mine = []
    for w in v:
        if w in left:
            left.remove(w)
        else:
            mine.append(w)
    shared = [w for w in c if w not in left]
    # initials of further given names come and go
    out, full = 0.0, sum(len(w) > 1 for w in shared)
    while len(mine) > len(left) and (extra := next((w for w in mine if len(w) == 1 and (full > 1 or len(v) > 2)), None)):
        mine.remove(extra)
        out += EXTRA
    if len(mine) != len(left) or len(mine) > 2:
        return None
    best = None
    for order in ([left] if len(left) < 2 else [left, left[::-1]]):
        total, typos, weak = out, 0, 0
        for x, y in zip(mine, order, strict=True):
            if len(x) == 1 and len(y) > 1 and x == y[0]:
                total, weak = total + INITIAL, weak + 1
            elif _stands_for(x, y):
                total, weak = total + NICKNAME, weak + 1
            elif min(len(x), len(y)) > 3 and one_edit(x, y):
                total, typos = total + TYPO, typos + 1
            elif x in NICKNAMES or len(x) < 5 or not any(one_edit(x, n) and y in NICKNAMES[n].split() for n in NICKNAMES if abs(len(n) - len(x)) < 2 and len(n) > 3):
                break
            else:
                total, typos, weak = total + NICKNAME + TYPO, typos + 1, weak + 1
        else:
            # a writer makes one slip; an initial alone names nobody
            if typos < 2 and weak < 2 and (shared or typos) and (best is None or total > best):
                best = total
    return best


def _deletions(word: str) -> list[str]:
    return [word] + [word[:i] + word[i + 1 :] for i in range(len(word))] if len(word) > 3 else []


@lru_cache(50_000)
def _key(tag: str, word: str) -> int:
    return xxhash.xxh64_intdigest(word, ord(tag))


@lru_cache(20_000)
def _slips(word: str) -> tuple[int, ...]:
    """Keys of which two words one edit apart, both of more than three letters, share one."""
    return tuple(_key("t", d) for d in _deletions(word))


@lru_cache(20_000)
def _meant(word: str) -> tuple[int, ...]:
    """Keys of the names a short form, or a slip of one, can stand for."""
    near = [word] if word in NICKNAMES or len(word) < 5 else [n for n in NICKNAMES if len(n) > 3 and one_edit(word, n)]
    return tuple({_key("n", full) for n in near for full in NICKNAMES.get(n, "").split()})


@lru_cache(20_000)
def _weakened(word: str) -> tuple[int, ...]:
    """Keys of what a word of a canonical form can become as an initial or a short form."""
    return (_key("i", word[0]), *({_key("n", full) for full in (word, *NICKNAMES.get(word, "").split())} if word in GIVEN else ()))


def _parts(form: str) -> tuple[list[str], list[int], int, list[int]]:
    """The words longer than an initial, their keys and the sum of these, and the keys of the initials."""
    words = form.split()
    core = [w for w in words if len(w) > 1]
    keys = [_key("w", w) for w in core]
    return core, keys, sum(keys), [_key("i", w) for w in {w for w in words if len(w) == 1}]


def _signed(keys: set[int]) -> list[int]:
    return [(k + 2**63) % 2**64 - 2**63 for k in keys]


def posts(form: str) -> list[int]:
    """Keys of a form as a canonical one: what stays of it, with how the one or two words that change can be met."""
    core, keys, total, initials = _parts(form)
    out = {total + _key("e", "")}
    for a, x in enumerate(core):
        rest = total - keys[a]
        weak = _weakened(x)
        if len(core) == 1 and not initials:  # an initial alone names nobody
            weak = weak[1:]
        out.update(rest + k for k in weak)
        for t in _slips(x):
            out.add(rest + t)
            for b, y in enumerate(core):
                if b != a:
                    out.update(rest - keys[b] + t + 3 * k for k in _weakened(y))
    return _signed(out)


def asks(form: str) -> list[int]:
    """Keys of a form as a variant. It shares one with the posts of every form ``channel`` can make it of:

    the words that stay are in the key, and of those that change a slip is met by a letter left out, an initial by
    the first letter, and a short form by the full name, so a frequent word alone is never a key.
    """
    core, keys, total, initials = _parts(form)
    out = {total + k for k in [_key("e", "")] * bool(initials) + initials}
    for a, x in enumerate(core):
        rest = total - keys[a]
        out.update(rest + k for k in _meant(x))
        for t in _slips(x):
            out.add(rest + t)
            out.update(rest + t + 3 * k for k in initials)
            for b, y in enumerate(core):
                if b != a and y in NICKNAMES:
                    out.update(rest - keys[b] + t + 3 * k for k in _meant(y))
    return _signed(out)


def link_spellings(names: DataFrame) -> DataFrame:
    """Pairs (text_lo, text_hi) of different spellings that name the same entity.

    ``names`` has one column, text. Spellings are brought to a normal form (case, accents, order,
    punctuation, titles and known abbreviations do not matter) whose frequency over all rows is the prior of
    the form as a canonical one. Candidates of a form are found by keys of the words that stay together with
    how the others change, so every form it can come from is met, however frequent its words. Every form is then attached to
    the candidate of maximum posterior, prior times the likelihood of typos, initials, nicknames and left-out
    words; the canonical form must leave out less of the name, or as much and be more frequent. Roots are
    followed by pointer jumping; all spellings under one root are one entity. Short forms of names are the fixed ones and those
    learnt from the names themselves (see ``learnt_short_forms``). Types are not used, as they
    are not always right. All tables joined here grow with the names, so none is broadcast, whatever its files weigh:
    a table under the threshold on disk takes many times that in the driver.

    Defined cases: null, blank and placeholder texts are no spellings; outer blanks are removed, letter case
    is kept; repeated rows raise the frequency only; a form without candidate stays by itself; equal
    posteriors go to the smaller form; empty input, empty result; other columns are ignored.
    """
    spark = names.sparkSession
    scratch = Scratch(spark, "spellings")
    clean = names.select(F.col("text").cast("string").alias("raw")).filter(names_something(F.col("raw"))).select(trimmed("raw").alias("text"))
    form_of = F.pandas_udf(lambda s: s.map(normal_form), "string")
    spellings = scratch.write(clean.groupBy("text").agg(F.count(F.lit(1)).alias("n")).withColumn("form", form_of("text")), "spellings")
    plain = scratch.write(spellings.groupBy("form").agg(F.sum("n").alias("n")), "plain")
    learnt = spark.sparkContext.broadcast(learnt_short_forms(plain))

    def told(f):
        """``f`` over a column, in a process that knows what was learnt."""

        def call(s: pd.Series) -> pd.Series:
            _use(learnt.value)
            return s.map(f)

        return call

    level_of = F.pandas_udf(lambda s: told(level)(s).astype("int32"), "int")
    posts_of = F.pandas_udf(lambda s: told(posts)(s), "array<long>")
    asks_of = F.pandas_udf(lambda s: told(asks)(s), "array<long>")
    forms = scratch.write(plain.withColumn("level", level_of("form")), "forms")

    posted = forms.select(F.col("form").alias("c"), F.explode(posts_of("form")).alias("key"))
    asked = forms.select(F.col("form").alias("v"), F.explode(asks_of("form")).alias("key"))
    met = asked.join(posted.hint("merge"), "key").filter("v <> c").select("v", "c").distinct()
    of_v = forms.select(F.col("form").alias("v"), F.col("n").alias("nv"), F.col("level").alias("lv"))
    of_c = forms.select(F.col("form").alias("c"), F.col("n").alias("nc"), F.col("level").alias("lc"))
    met = met.join(of_v.hint("merge"), "v").join(of_c.hint("merge"), "c")
    before = (F.col("lc") < F.col("lv")) | ((F.col("lc") == F.col("lv")) & (F.struct(F.col("nc"), F.col("v")) > F.struct(F.col("nv"), F.col("c"))))

    @F.pandas_udf("double")
    def likelihood(v: pd.Series, c: pd.Series) -> pd.Series:
        _use(learnt.value)
        return pd.Series([channel(x, y) for x, y in zip(v, c, strict=True)], dtype="float64")

    scored = met.filter(before).withColumn("like", likelihood("v", "c")).filter(F.col("like").isNotNull() & ~F.isnan("like"))
    scored = scored.withColumn("post", F.log("nc") + F.col("like")).filter(F.col("post") > F.log("nv") + OWN)
    parent = scored.groupBy("v").agg(F.min(F.struct((-F.col("post")).alias("p"), "c")).alias("b")).select(F.col("v").alias("form"), F.col("b.c").alias("root"))
    roots = scratch.write(parent, "roots")
    while True:  # pointer jumping: the depth halves each time
        up = roots.select(F.col("form").alias("root"), F.col("root").alias("next"))
        new = scratch.write(roots.join(up.hint("merge"), "root", "left").select("form", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = new.filter("moved").limit(1).count()
        scratch.drop(roots)
        roots = new.drop("moved")
        if not moved:
            break
    named = scratch.write(spellings.join(roots.hint("merge"), "form", "left").select("text", F.coalesce("root", "form").alias("root")), "named")
    x, y = named.alias("x"), named.alias("y")
    pairs = x.join(y.hint("merge"), (F.col("x.root") == F.col("y.root")) & (F.col("x.text") < F.col("y.text")))
    return pairs.select(F.col("x.text").alias("text_lo"), F.col("y.text").alias("text_hi"))
