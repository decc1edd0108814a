"""Problem 7: broken prompt and response pairs, with the kind of defect."""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .endings import OPENERS
from .words import words

#: Different words a task counts before it hands them on.
COUNTED = 300_000
#: Pairs that are judged by one task, while there are no more than MOST_TASKS.
ROWS, MOST_TASKS = 5_000, 20_000
#: Log odds against prompt and response being of one language from which the pair counts as defective.
MARGIN = 4.0
#: Characters the end-of-text likelihood looks at, and how often it must have met them.
CONTEXT, MET = 6, 12

# Codes of one language.
CODES = {"en": "en", "eng": "en", "english": "en", "de": "de", "deu": "de", "ger": "de", "german": "de", "fr": "fr", "fra": "fr", "fre": "fr", "french": "fr", "es": "es", "spa": "es", "spanish": "es"}
# Short texts for languages that no labelled row has; a response may be in one of them.
OTHER_LANGUAGES = {
    "it": "il treno era già partito quando lei arrivò alla stazione della città e nessuno sapeva dove fosse andato. gli anni che passarono tra la nascita e la morte furono molti. si trasferì nella casa del fratello prima di dirigere la scuola, che fu fondata nel paese dove è nata. l'opera fu scritta da lui e mostrata per la prima volta in quel tempo. era allora impiegato presso una ditta. sì, anche gli elenchi mostrano dove lavoravano. dopo di che non c'era più niente da fare, perché tutti gli altri erano partiti con loro. questa è la storia di una donna che è stata molto felice nel suo giardino",
    "pt": "o trem já tinha partido quando ela chegou à estação da cidade e ninguém sabia para onde ele foi. os anos que passaram entre o nascimento e a morte foram muitos. mudou-se para a casa do irmão antes de dirigir a escola, que foi fundada na aldeia onde nasceu. a obra foi escrita por ele e mostrada pela primeira vez naquele tempo. era então empregado de uma empresa. sim, também as listas mostram onde trabalhavam. depois disso não havia mais nada a fazer, porque todos os outros tinham ido com eles. esta é a história de uma mulher que foi muito feliz no seu jardim",
    "nl": "de trein was al vertrokken toen zij bij het station van de stad aankwam en niemand wist waar hij heen was gegaan. de jaren die tussen de geboorte en de dood verliepen waren er veel. hij verhuisde naar het huis van zijn broer voordat hij de school leidde, die werd opgericht in het dorp waar zij geboren is. het werk werd door hem geschreven en voor het eerst getoond in die tijd. hij was toen in dienst van een bedrijf. ja, ook de lijsten laten zien waar zij werkten. daarna was er niets meer te doen, omdat alle anderen met hen waren vertrokken. dit is het verhaal van een vrouw die zeer gelukkig was in haar tuin",
}
# Answers that say nothing, in lower case without blanks around.
_NOTHING = frozenset(["", "-", "--", "n/a", "na", "none", "null", "nil", "nan", "tbd", "tba", "todo", "(no answer)", "no answer", "no response", "(empty)", "empty", "(blank)", "blank", "unknown", "undefined", "placeholder", "[answer]", "<answer>", "[placeholder]", "(none)", "keine antwort", "sans réponse", "sin respuesta", "xxx", "lorem ipsum", "not available", "...", "…", "?", "."])
_LEAD = re.compile(r"^(?:(?:final |short |the )?(?:answer|response|result|antwort|réponse|respuesta|a)\s*[:：=-]\s*|(?:the |your )?(?:question|prompt|frage|pregunta)\s*(?:is|was|lautet|est|es)?\s*[:：]\s*|you (?:asked|are asking)\s*[:,]?\s*|q\s*:\s*)+", re.IGNORECASE)
_TAGS = re.compile(r"<[^<>]{0,80}>")
_MARKUP = re.compile(r"[*_`#~|>\\]+")
_INVISIBLE = re.compile("[​‌‍⁠﻿­]")
# Yes and no with the languages they belong to.
_YES_NO = {"yes": {"en"}, "no": {"en", "es", "it"}, "ja": {"de", "nl"}, "nein": {"de"}, "oui": {"fr"}, "non": {"fr"}, "sí": {"es"}, "si": {"es", "it"}, "sì": {"it"}, "sim": {"pt"}, "não": {"pt"}, "nee": {"nl"}}
# How a response declines. An inability must be the writer's own or that of the evidence, or be
# stated without a subject, and its object the answer, so that people in the story who could not do things are left alone.
_SELF = r"(?:(?:^|[.:;,!?–—]\s+|\b(?:but|and|that|so|hence|therefore|thus|unfortunately|sorry) )(?:unfortunately,? |sadly,? |regrettably,? )?|\b(?:i|we|model|assistant|it is|it's|one|(?:documents?|texts?|passages?|evidence|context|sources?|question|answer|this)(?: provided| given| retrieved)?) )(?:(?:am|are|is|was|'m|’m|be) )?"
_REFUSAL = re.compile(
    _SELF + r"(?:i'm |i’m )?(?:can(?:not|'t|’t| not)|could(?:n't|n’t| not)|unable to|not able to|not possible to)\s+(?:\w+ly\s+|be\s+)?(?:answer(?:ed)?|help|assist|respond|determined?|verif(?:y|ied)|give (?:an?|any)|provide (?:an?|any)|say(?: (?:for|with) certain\w*)?|tell|confirm(?:ed)?|find (?:an?|any) (?:answer|information|mention|evidence)|comment|comply|establish(?:ed)?|derived?|conclude|do that|fulfil)\b"
    r"|\bquestion cannot be (?:answered|determined|established|resolved)\b|\bno (?:definite |clear |certain )?answer can be\b|\bcan(?:not|'t|’t) (?:help|assist) (?:you|with)\b"
    r"|\b(?:i|we) (?:really )?(?:do not|don't|don’t) (?:know|have (?:enough|sufficient|any) (?:information|evidence|context|data|details?))\b"
    r"|\b(?:documents?|texts?|passages?|evidence|context|sources?|propositions?)(?: \w+)? (?:do not|don't|don’t|does not|doesn't|doesn’t) (?:contain|provide|give|include|hold|offer) (?:enough|sufficient|any) (?:information|evidence|context|data|details?)\b"
    r"|\b(?:insufficient|not enough|no sufficient) (?:information|evidence|data|context|details?)\b|\bsay nothing (?:on|about) (?:this|the question|it)\b|\brather not (?:guess|say|answer)\b|\bmust decline\b|\b(?:i|we) decline to\b|\bdecline to (?:answer|respond)\b"
    r"|\boutside (?:of )?what i am allowed\b|\bi(?: am|'m|’m) not allowed to\b|\bas an? (?:ai|language model|large language model|assistant)\b|\bnone of the (?:retrieved |given |provided )?(?:passages|documents|propositions|texts) mentions?\b|\bi (?:have|'ve) no (?:information|idea|answer)\b"
    r"|\bnicht (?:beantworten|beantwortet|zu beantworten)\b|\b(?:ich|wir|man|dazu)\b[^.!?]{0,40}\bnicht (?:bestimmen|beurteilen|sagen|helfen)\b|\b(?:ich|wir|dazu)\b[^.!?]{0,30}\bkeine (?:auskunft|angaben?|antwort|informationen?|aussage)\b|\bweiß (?:es |ich )?(?:leider )?nicht\b|\btut mir leid\b|\bnicht genug informationen\b"
    r"|\b(?:ne|n['’])\s*(?:peux|puis|pouvons|permettent|permet|suis)\s+(?:pas|malheureusement pas)(?:\s+en mesure)?\s+(?:de |d['’])?(?:répondre|conclure|déterminer|dire|aider|savoir)|\bimpossible de (?:répondre|conclure|déterminer)\b|\bje ne sais pas\b|\bje suis désolée?\b|\bpas assez d['’]informations?\b"
    r"|\bno (?:puedo|podemos|es posible|se puede|soy capaz de|me es posible) (?:responder|contestar|determinar|decir|ayudar|saber)|\bno hay (?:datos|información|pruebas|evidencia) (?:suficientes?|alguna)\b|\blo siento\b|\bno lo sé\b|\bno dispongo de\b|\bno puedo (?:dar|ofrecer) (?:una|ninguna)\b"
    r"|\bnon (?:posso|è possibile) (?:rispondere|determinare|dire)\b|\bmi dispiace\b|\bnão (?:posso|é possível) (?:responder|dizer)\b",
    re.IGNORECASE,
)
_BARE_TAIL = re.compile(r"[.!?][\"”“’'»«)\]]*$")


_LOWER = bytes(range(97, 123))
_OTHER = bytes(i for i in range(128) if not chr(i).isalpha())


def _capitals(text: str) -> bool:
    """Whether more than 0.7 of the letters are capitals."""
    b = text.encode(errors="replace")
    lower = len(b) - len(b.translate(None, _LOWER))
    most = len(text) - lower - (len(b) - len(b.translate(None, _OTHER)))  # capitals there can be at most
    if 3 * most < 7 * lower:
        return False
    letters = [c for c in text if c.isalpha()]
    return bool(letters) and sum(c.isupper() for c in letters) > 0.7 * len(letters)


def small_words(text: str, known: frozenset[str] | set[str] = frozenset()) -> list[str]:
    """The words of a text that may tell its language: in small letters, and no words of ``known`` names.

    A text wholly in capitals is read in small letters.
    """
    if _capitals(text):
        text = text.lower()
    return [w for w in re.findall(r"[^\W\d_]+", text) if w == w.lower() and w not in known]


def asking_words(question: str) -> list[str]:
    """The words of a question that may tell its language: small words and the first, without those inside names.

    A small word between two words with capitals may belong to a name (``Museum of Weaving``) and is left out
    where enough others are left.
    """
    w = re.findall(r"[^\W\d_]+", question)
    if not w:
        return []
    small = small_words(question)
    if len(small) == len(w):
        return small
    inner = [x for i, x in enumerate(w) if x == x.lower() and not (0 < i < len(w) - 1 and w[i - 1][:1].isupper() and w[i + 1][:1].isupper())]
    kept = inner if len(set(inner)) > 2 else small
    return [w[0].lower(), *kept]


def _grams(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + n] for n in (1, 2, 3, 4) for i in range(len(w) - n + 1)]


def _shares(logs: dict[str, float]) -> dict[str, float]:
    if not logs:
        return {}
    top = max(logs.values())
    each = {k: math.exp(v - top) for k, v in logs.items()}
    total = sum(each.values())
    return {k: v / total for k, v in each.items()}


def gram_counts(counted: Iterable[tuple[str, int]]) -> Counter:
    """How often each n-gram occurs in words that occur so often."""
    grams: Counter = Counter()
    for w, n in counted:
        for g in _grams(w):
            grams[g] += n
    return grams


def count_ends(text: str, ends: Counter, inner: Counter) -> None:
    """Count the words that end the sentences of a text, and the others in these."""
    for part in re.split(r"(?<=[.!?])\s+", text.strip()):
        tokens = part.split()
        if len(tokens) > 3 and tokens[-1][-1] in ".!?":
            ends[" " + tokens[-1].rstrip(".!?")] += 1
            inner.update(" " + t for t in tokens[:-1])


def end_pieces(word: str, n: int, last: bool, end: Counter, mid: Counter) -> None:
    """Count the last characters of a word that ends a sentence, and those before a cut in a word.

    A cut may fall behind every character of a word; behind the whole last word the sentence ends.
    """
    if last:
        for k in range(1, min(CONTEXT, len(word)) + 1):
            end[word[-k:]] += n
    for i in range(2, len(word) + (not last)):
        for k in range(1, min(CONTEXT, i) + 1):
            mid[word[i - k : i]] += n


class LanguageModel:
    """Naive Bayes over character n-grams of small words, and the likelihood of characters that end sentences."""

    #: All languages count as if they had been seen with this many n-grams, however long their texts.
    SEEN = 4_000

    def __init__(self, labelled: list[tuple[str, str]], prompts: list[str] | None = None) -> None:
        self.labels = frozenset(lang for lang, _ in labelled)
        self._set(labelled)
        # labels are wrong now and then: texts that clearly belong elsewhere are left out of the final count
        kept = [(lang, text) for lang, text in labelled if self.best(small_words(text))[0] in (lang, None)]
        self._set(kept)
        # prompts have words that labelled texts lack; each goes to its likeliest language, and the counts are made again
        for _ in range(2 if prompts else 0):
            self._set(kept + [t for q in prompts if (t := self.told(q))])
        self.vocabulary = {w for w, n in Counter(w for _, t in kept for w in small_words(t)).items() if n > 2} | {w for t in OTHER_LANGUAGES.values() for w in small_words(t)}
        self._fit_ends([t for _, t in kept])

    @classmethod
    def of_counts(cls, labels: Iterable[str], grams: dict[str, Counter]) -> LanguageModel:
        """A model from n-grams counted elsewhere; the words and ends of sentences are still to be given."""
        model = cls([])
        model.labels = frozenset(labels)
        model._weigh({lang: grams.get(lang, Counter()) for lang in {*model.labels, *grams}})
        return model

    def told(self, question: str) -> tuple[str, str] | None:
        """The likeliest language of a question and its words, if there is any labelled language."""
        p = self.asked(question)
        return (max(sorted(p), key=p.get), " ".join(asking_words(question))) if p else None

    def _set(self, labelled: list[tuple[str, str]]) -> None:
        seen: dict[str, Counter] = {}
        for lang, text in labelled:
            seen.setdefault(lang, Counter()).update(small_words(text))
        self._weigh({lang: gram_counts(c.items()) for lang, c in seen.items()})

    def _weigh(self, labelled: dict[str, Counter]) -> None:
        grams = {lang: Counter(c) for lang, c in labelled.items()}
        for lang, text in OTHER_LANGUAGES.items():
            grams.setdefault(lang, Counter()).update(gram_counts(Counter(small_words(text)).items()))
        most = self.SEEN + 0.05 * len(set().union(*grams.values())) if grams else 1.0
        self.log = {lang: {g: math.log((n * self.SEEN / c.total() + 0.05) / most) for g, n in c.items()} for lang, c in grams.items()}
        self.unseen = math.log(0.05 / most)
        self.scores: dict[str, dict[str, float]] = {}

    def _score(self, word: str) -> dict[str, float]:
        if word not in self.scores:
            if len(self.scores) > 100_000:
                self.scores.clear()
            grams = _grams(word)
            self.scores[word] = {lang: sum(table.get(g, self.unseen) for g in grams) / 4 for lang, table in self.log.items()}
        return self.scores[word]

    def posteriors(self, tokens: list[str]) -> dict[str, float]:
        """Log posterior of each language; every distinct word counts once."""
        each = [self._score(w) for w in set(tokens)]
        return {lang: sum(s[lang] for s in each) for lang in self.log}

    def asked(self, question: str) -> dict[str, float]:
        """Probability of each labelled language for a question; prompts are in these."""
        p = {k: v for k, v in self.posteriors(asking_words(question)).items() if k in self.labels}
        return _shares(p)

    def best(self, tokens: list[str]) -> tuple[str | None, float]:
        p = self.posteriors(tokens)
        if not tokens or not p:
            return None, 0.0
        lang = max(sorted(p), key=p.get)
        return lang, p[lang] - max((v for k, v in p.items() if k != lang), default=0.0)

    def _fit_ends(self, texts: list[str]) -> None:
        """Counts of the last characters at the end of a sentence, and of those before any other place in one."""
        ends, inner = Counter(), Counter()
        for text in texts:
            count_ends(text, ends, inner)
        e, m = Counter(), Counter()
        for word, n in ends.items():
            end_pieces(word, n, True, e, m)
        for word, n in inner.items():
            end_pieces(word, n, False, e, m)
        self.set_ends(((x, e[x], m[x]) for x in e.keys() | m.keys()), ends.total(), sum(n for x, n in m.items() if len(x) == 1))

    def set_ends(self, pieces: Iterable[tuple[str, int, int]], ends: int, places: int) -> None:
        """Take pieces with how often each was met at an end and elsewhere, of so many ends and other places.

        Pieces met less than MET times are never asked for, so they may be left out.
        """
        self.end, self.mid = [Counter() for _ in range(CONTEXT)], [Counter() for _ in range(CONTEXT)]
        for x, e, m in pieces:
            self.end[len(x) - 1][x], self.mid[len(x) - 1][x] = e, m
        self.ends, self.places = ends, places

    def end_odds(self, text: str) -> float:
        """Log likelihood of the last characters at the end of a sentence over any other place in one.

        The longest run of up to CONTEXT characters that was met often enough decides; a full stop is not looked at.
        """
        last = " " + (text.split() or [""])[-1]
        for k in range(min(CONTEXT, len(last)), 0, -1):
            e, m = self.end[k - 1][last[-k:]], self.mid[k - 1][last[-k:]]
            if e + m >= MET:
                return math.log((e + 0.5) / (self.ends + 1)) - math.log((m + 0.5) / (self.places + 1))
        return -1.0


def _rows(counts: dict[tuple[str, str], Counter]) -> pd.DataFrame:
    rows = [(what, lang, w, n) for (what, lang), c in counts.items() for w, n in c.items()]
    return pd.DataFrame(rows, columns=["what", "lang", "word", "n"]).astype({"n": "int64"})


def fit_language_model(documents: DataFrame, questions: DataFrame) -> LanguageModel:
    """The model from all labelled documents and all questions.

    The steps are those of ``LanguageModel`` over lists, but tasks count and the driver gets sums: n-grams of up to
    four letters, words met more than twice and pieces of words met MET times.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "languages")
    code = F.coalesce(*[F.when(F.lower(F.trim("lang")) == k, F.lit(v)) for k, v in CODES.items()])
    docs = documents.select(code.alias("lang"), "text").filter("lang IS NOT NULL AND length(text) >= 200")
    kinds = "what string, lang string, word string, n long"

    def counted(rows: DataFrame, label: str, shared=None) -> DataFrame:
        """Small words of the texts, all or those ``shared`` finds in their language; of the latter also the ends."""

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            counts: dict[tuple[str, str], Counter] = {}
            for b in batches:
                for lang, text in zip(b["lang"], b["text"], strict=True):
                    counts.setdefault(("label", lang), Counter())[""] += 1
                    tokens = small_words(text)
                    if shared and shared.value.best(tokens)[0] not in (lang, None):
                        continue
                    counts.setdefault(("word", lang), Counter()).update(tokens)
                    if shared:
                        count_ends(text, counts.setdefault(("end", ""), Counter()), counts.setdefault(("inner", ""), Counter()))
                if sum(map(len, counts.values())) > COUNTED:
                    yield _rows(counts)
                    counts = {}
            yield _rows(counts)

        return scratch.write(rows.mapInPandas(count, kinds).groupBy("what", "lang", "word").agg(F.sum("n").alias("n")), label)

    def grams(rows: DataFrame) -> dict[str, Counter]:
        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield _rows({("gram", lang): gram_counts(zip(w["word"], w["n"].tolist(), strict=True)) for lang, w in b.groupby("lang")})

        out: dict[str, Counter] = {}
        for r in rows.filter("what = 'word'").mapInPandas(cut, kinds).groupBy("lang", "word").agg(F.sum("n").alias("n")).toLocalIterator():
            out.setdefault(r["lang"], Counter())[r["word"]] = r["n"]
        return out

    share = spark.sparkContext.broadcast
    first = counted(docs, "all")
    labels = [r["lang"] for r in first.filter("what = 'label'").select("lang").collect()]
    # labels are wrong now and then: texts that clearly belong elsewhere are left out of the final count
    kept = counted(docs, "kept", share(LanguageModel.of_counts(labels, grams(first))))
    base = grams(kept)
    model = LanguageModel.of_counts(labels, base)
    asked = questions.select("question").filter("question IS NOT NULL").distinct()
    for _ in range(2):  # prompts have words that labelled texts lack
        shared = share(model)

        def tell(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for b in batches:
                counts: dict[tuple[str, str], Counter] = {}
                for q in b["question"]:
                    if t := shared.value.told(q):
                        counts.setdefault(("word", t[0]), Counter()).update(small_words(t[1]))
                yield _rows(counts)

        new = grams(asked.mapInPandas(tell, kinds).groupBy("what", "lang", "word").agg(F.sum("n").alias("n")))
        model = LanguageModel.of_counts(labels, {k: base.get(k, Counter()) + new.get(k, Counter()) for k in {*base, *new}})
    common = kept.filter("what = 'word'").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 2")
    model.vocabulary |= {r["word"] for r in common.select("word").toLocalIterator()}

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            e, m = Counter(), Counter()
            for what, w, n in zip(b["what"], b["word"], b["n"].tolist(), strict=True):
                end_pieces(w, n, what == "end", e, m)
            yield pd.DataFrame([(x, e[x], m[x]) for x in e.keys() | m.keys()], columns=["x", "e", "m"]).astype({"e": "int64", "m": "int64"})

    tokens = kept.filter("what IN ('end', 'inner')")
    size = F.length("word")
    total = tokens.agg(F.sum(F.when(F.col("what") == "end", F.col("n"))), F.sum(F.when(F.col("what") == "end", F.greatest(size - 2, F.lit(0)) * F.col("n")).otherwise((size - 1) * F.col("n")))).first()
    met = tokens.mapInPandas(pieces, "x string, e long, m long").groupBy("x").agg(F.sum("e").alias("e"), F.sum("m").alias("m")).filter(F.col("e") + F.col("m") >= MET)
    model.set_ends(((r["x"], r["e"], r["m"]) for r in met.toLocalIterator()), total[0] or 0, total[1] or 0)
    scratch.drop(first, kept)
    return model


def bare(answer: str | None) -> str:
    """What an answer says, without markup, JSON, quotes and labels."""
    if answer is None:
        return ""
    t = _INVISIBLE.sub("", answer).strip()
    if t[:1] in "{[" and t[-1:] in "}]":
        try:
            v = json.loads(t)
            if isinstance(v, dict):
                v = next((v[k] for k in ("answer", "short_answer", "final_answer", "response", "text") if k in v), " ".join(str(x) for x in v.values()))
            t = " ".join(map(str, v)) if isinstance(v, list) else "" if v is None else str(v)
        except ValueError:
            pass
    t = _MARKUP.sub(" ", _TAGS.sub(" ", t)).strip()
    t = re.sub(r"\s+", " ", t)
    while (m := _LEAD.match(t)) and m.end():
        t = t[m.end() :].strip()
    if len(t) > 1 and t[0] == t[-1] and t[0] in "\"'":
        t = t[1:-1].strip()
    return t


def _near(a: str, b: str) -> bool:
    """Whether two words differ by at most one edit (two in long words) or a swap."""
    if a == b:
        return True
    most = 1 if len(a) < 8 else 2
    # an edit brings or takes one letter each at most
    if abs(len(a) - len(b)) > most or min(len(a), len(b)) < 3 or len(set(a) ^ set(b)) > 2 * most:
        return False
    row = list(range(len(b) + 1))
    above: list[int] = []
    for i, x in enumerate(a, 1):
        above, last, row = row, above, [i]
        for j, y in enumerate(b, 1):
            d = min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, last[j - 2] + 1)
            row.append(d)
    return row[-1] <= most or (len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 2 and sorted(a) == sorted(b))


def _copies(question: str, said: str) -> bool:
    """Only the question again: nearly all words of each in the other, and no new name or number."""
    q, a = words(question), words(said)
    if len(a) < 4 or len(q) < 4:
        return False
    rest, asked = Counter(q), set(q)
    fresh = []
    for w in a:
        if rest[w] > 0:
            rest[w] -= 1
        else:
            fresh.append(w)
    unmet = list(rest.elements())
    # a new word meets one of the unmet at most
    if len(unmet) - len(fresh) > 0.25 * len(q):
        return False
    new = []
    for w in fresh:
        hit = next((x for x in unmet if _near(w, x)), None)
        if hit is not None:
            unmet.remove(hit)
        elif w not in asked and not any(_near(w, x) for x in asked):
            new.append(w)
    if len(unmet) > 0.25 * len(q) or len(new) > 0.15 * len(a):
        return False
    names = {w.lower() for w in re.findall(r"[^\W_]+", said) if w[:1].isupper() or w[:1].isdigit()} if not said.isupper() else set()
    return not any(w in names and w not in ("the", "question", "you", "is") for w in new)


#: Words that no sentence ends with, whatever the counts.
_PARTICLES = frozenset("of the de la le du des von der y and del und et in di".split())


def _cut(said: str, raw: str, model: LanguageModel) -> float | None:
    """Log odds of a response to be cut rather than whole by what it ends with; None for a whole one.

    Infinite where a mark shows it (dots, a hyphen, an open bracket); for sentences without a full stop it is the
    negative of ``end_odds``, still without the share of whole ones among them.
    """
    t = raw.rstrip(" \n\t\r*_`")
    if t[:1] == "{" and t[-1:] != "}" or t[:1] == "[" and t[-1:] != "]" or t.count("```") % 2:
        return math.inf
    t = said.rstrip()
    if not t:
        return None
    if t.endswith(("...", "…", "-", "‐", "�", ",", ";", "(", "[")) or t.endswith(":"):
        return math.inf
    if _BARE_TAIL.search(t):
        return None
    if t[-1] in ")]”\"»’" and t.count("(") == t.count(")") and t.count("[") == t.count("]"):
        return None
    tokens = words(t)
    if tokens and tokens[-1] in _PARTICLES:
        return math.inf
    # a bare name, number or yes/no needs no full stop: in names only particles are in small letters
    small = [w for w in small_words(t) if w not in _PARTICLES and (t != t.lower() or w in model.vocabulary)]
    small += [w for w in tokens[:1] if w in OPENERS and w not in _PARTICLES]
    return -model.end_odds(t) if small and len(tokens) > 2 else None


def whole_share(odds: Iterable[tuple[float, int]]) -> float:
    """Share of whole ones among the sentences without a full stop, from (log odds of a cut, how many).

    The likelihood ratio of each is known, so the share of the mixture follows by expectation and maximisation.
    """
    rows = [(math.exp(min(50.0, max(-50.0, -x))), n) for x, n in odds if math.isfinite(x)]
    total = sum(n for _, n in rows)
    share = 0.5
    for _ in range(200):
        if not total:
            break
        share = min(0.999, max(0.001, sum(n * share * r / (share * r + 1 - share) for r, n in rows) / total))
    return share


def judge(question: str | None, answer: str | None, model: LanguageModel) -> tuple[str | None, float]:
    """The defect of one pair, and for sentences without a full stop the log odds of a cut.

    The first that holds of empty, refusal, copy, truncated, language. Where the odds are finite, ``truncated`` is
    given with them and what else the pair would be is given as ``truncated/...``.
    """
    said = bare(answer)
    if not said or said.lower().strip(" .!?-–—:;,\"'()[]{}") == "" or said.lower() in _NOTHING or said.lower().strip(" .!\"'[](){}<>") in _NOTHING:
        return "empty", 0.0
    if _REFUSAL.search(said):
        return "refusal", 0.0
    question = question or ""
    if question and _copies(question, said):
        return "copy", 0.0
    odds = _cut(said, answer or "", model)
    if odds == math.inf:
        return "truncated", 0.0
    other = "language" if question and _other_language(question, said, model) else ""
    if odds is not None:
        return f"truncated/{other}", odds
    return other or None, 0.0


def _other_language(question: str, said: str, model: LanguageModel) -> bool:
    """Whether the posteriors of prompt and response leave no room for one language of both."""
    asked = model.asked(question)
    if not asked:
        return False
    first = said.lower().rstrip(".! ")
    if first in _YES_NO:
        return sum(v for k, v in asked.items() if k in _YES_NO[first]) < math.exp(-MARGIN)
    known = set(words(question))
    tokens = [w for w in small_words(said) if w not in known]
    tokens += [w for w in words(said)[:1] if w in model.vocabulary and w not in known]
    if len(set(tokens)) < 2 or sum(map(len, set(tokens))) < 6:
        return False
    p = _shares(model.posteriors(tokens))
    return sum(v * p.get(k, 0.0) for k, v in asked.items()) < math.exp(-MARGIN) * max(p.values())


def settled(defect: str | None, odds: float, share: float) -> str | None:
    """The defect when ``share`` of the sentences without a full stop are whole."""
    if defect is None or not defect.startswith("truncated/"):
        return defect
    return "truncated" if odds + math.log((1 - share) / share) > 0 else defect.removeprefix("truncated/") or None


def defect_of(question: str | None, answer: str | None, model: LanguageModel, share: float = 0.5) -> str | None:
    """The defect of one pair, or None."""
    return settled(*judge(question, answer, model), share)


def defective_pairs(results: DataFrame, questions: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows (pair_kind, pair_id, defect) of answers and gold answers unusable for their question.

    Languages are told by naive Bayes over character n-grams of the words in small letters (names, which
    are the same in all languages, are left out; so are the question's own words): a pair is defective when
    the posteriors of prompt and response leave next to no probability that both are of one language. The model is
    fitted on all labelled documents and adapted to all questions. Truncation is told by the likelihood of the last
    characters at the end of a sentence against any other place in one, for answers that are sentences without a
    full stop; how many of these are whole all the same is estimated over all of them, and an answer counts as
    cut when both together make it more likely than not. Refusals and copies are told by set phrases and by aligning words with edits.

    Defined cases: a null answer is ``empty``; an answer without question can be empty, refusal or truncated
    only; a null id is skipped; repeated rows give one row; empty tables, empty result; other columns are
    ignored.
    """
    spark = results.sparkSession
    scratch = Scratch(spark, "defects")
    shared = spark.sparkContext.broadcast(fit_language_model(documents, questions))
    asked = questions.filter("question_id IS NOT NULL").groupBy("question_id").agg(F.min("question").alias("question"))
    result = results.select(F.lit("result").alias("pair_kind"), F.col("answer_id").alias("pair_id"), "question_id", "answer").distinct().join(asked, "question_id", "left").select("pair_kind", "pair_id", "question", "answer")
    gold = questions.select(F.lit("gold").alias("pair_kind"), F.col("question_id").alias("pair_id"), "question", "answer").distinct()

    @F.pandas_udf("defect string, odds double")
    def judged(question: pd.Series, answer: pd.Series) -> pd.DataFrame:
        found = [judge(q, a, shared.value) for q, a in zip(question, answer, strict=True)]
        return pd.DataFrame({"defect": pd.Series([d for d, _ in found], dtype=object), "odds": [o for _, o in found]})

    pairs = result.unionByName(gold).filter("pair_id IS NOT NULL").select("pair_kind", F.col("pair_id").cast("long").alias("pair_id"), "question", "answer")
    # a hot question is no hot task: rows are dealt out by the pair's own id before the judging, into tasks of so
    # many rows, as it is the judging and not the bytes that takes time
    tasks = min(MOST_TASKS, max(1, -(-(results.count() + questions.count()) // ROWS)))
    dealt = pairs.repartition(tasks, "pair_kind", "pair_id")
    found = scratch.write(dealt.withColumn("j", judged("question", "answer")).select("pair_kind", "pair_id", "j.defect", "j.odds").filter("defect IS NOT NULL").distinct(), "found")
    open_odds = found.filter(F.col("defect").startswith("truncated/")).groupBy(F.round("odds", 1).alias("odds")).count().collect()
    share = whole_share((r["odds"], r["count"]) for r in open_odds)
    cut = F.col("odds") + math.log((1 - share) / share) > 0
    rest = F.when(F.col("defect") == "truncated/language", "language")
    defect = F.when(~F.col("defect").startswith("truncated/"), F.col("defect")).when(cut, "truncated").otherwise(rest)
    return found.select("pair_kind", "pair_id", defect.alias("defect")).filter("defect IS NOT NULL").distinct()
