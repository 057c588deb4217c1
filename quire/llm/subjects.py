"""Subject areas of documents.

Method: a multi-pattern automaton matches curated subject terms (a parameter
file, one concept a line with a weight and its words in several languages), longest match first, as whole
words, plurals included, where the script has such. A term weighs its curated weight by its rarity in the corpus, shared
between the subjects that use it; a sentence's score for a subject is the
weight of its terms, normalized by the length of the sentence. A sentence whose terms
fit several subjects alike goes with the subject the rest of the document speaks
of. A document has each subject whose share of sentences reaches that subject's
threshold, calibrated on all annotated documents around the wanted quarter.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from importlib.resources import files

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import sentences
from quire.llm.dedup import is_blank
from quire.llm.sentences import BoundaryModel, decode
from quire.session import materialize, spread

#: Share of sentences that makes a subject, and the thresholds annotated documents may choose from instead.
QUARTER, CUTS = 0.25, tuple(round(0.25 - 0.005 * k, 3) for k in range(13))
#: Least weight of terms for each word of a sentence.
LEAST = 0.02
GENERAL = "general"

ARTICLES = {
    "en": frozenset("the a an of and in on at with for by since after because although while so that".split()),
    "de": frozenset("der die das den dem des ein eine und im am mit für bei nach weil obwohl während damit".split()),
    "fr": frozenset("le la les un une des du et en au aux pour dans parce que alors tandis sorte".split()),
    "es": frozenset("el la los las un una y en al del para con por porque aunque mientras modo".split()),
}
WORDS = regex.compile(r"[\p{L}\p{M}]+")
HAN = regex.compile(r"\p{Script=Han}")
KANA = regex.compile(r"[\p{Script=Hiragana}\p{Script=Katakana}]")
CODE = regex.compile(r"[{};]\s*$|^<\|.*\|>$|^\W*$|\w\(.*\)\s*[{;]")
HEADING = regex.compile(r"[.!?…。！？»”」』\"]\s*$")

#: A use of a term: language, subject, weight.
Terms = dict[str, list[tuple[str, str, float]]]
#: Endings a word may have beyond a term's form, for each language.
ENDINGS = {"en": ("s", "es"), "de": ("e", "n", "en", "er", "ern", "s", "es", "nen"), "fr": ("s", "x", "e", "es"), "es": ("s", "es")}
LONGEST_ENDING = max(len(e) for row in ENDINGS.values() for e in row)


def default_terms() -> str:
    """The curated terms that come with the package."""
    return files("quire.llm").joinpath("subject_terms.tsv").read_text(encoding="utf-8")


def read_terms(listing: str) -> Terms:
    """{term in lower case: its uses} of a tab-separated listing: subject, weight, and a column for each language of the header."""
    lines = [x.split("\t") for x in listing.splitlines() if x.strip()]
    languages = lines[0][2:]
    out: Terms = {}
    for subject, weight, *words in lines[1:]:
        for language, word in zip(languages, words):
            if word and (use := (language, subject, float(weight))) not in out.setdefault(word.lower(), []):
                out[word.lower()].append(use)
    return out


def build(terms: Terms) -> ahocorasick.Automaton:
    """The automaton of all terms: each with its uses and whether it stands in a script without spaces."""
    auto = ahocorasick.Automaton()
    for term, uses in terms.items():
        auto.add_word(term, (term, uses, bool(HAN.match(term) or KANA.match(term))))
    auto.make_automaton()
    return auto


_LANGUAGES = tuple(ARTICLES)
#: Places in _LANGUAGES of the languages a function word belongs to.
_FUNCTION_WORDS: dict[str, tuple[int, ...]] = {w: tuple(k for k, x in enumerate(_LANGUAGES) if w in ARTICLES[x]) for x in ARTICLES.values() for w in x}


def language_of(sentence: str, words: list[str]) -> str | None:
    """Language of a sentence by its script and function words (its words in lower case); None if nothing tells."""
    if not sentence.isascii():
        if KANA.search(sentence):
            return "ja"
        if HAN.search(sentence):
            return "zh"
    counts = [0] * len(_LANGUAGES)
    for w in words:
        for k in _FUNCTION_WORDS.get(w, ()):
            counts[k] += 1
    best = max(counts)
    return _LANGUAGES[counts.index(best)] if best and counts.count(best) == 1 else None


def _ending(text: str, at: int) -> str | None:
    """What letters follow a term up to the end of its word; None if they are too many for an ending."""
    end = at
    while end < len(text) and text[end].isalpha():
        end += 1
        if end - at > LONGEST_ENDING:
            return None
    return text[at:end]


def match(sentence: str, auto: ahocorasick.Automaton, language: str | None) -> list[tuple[str, dict[str, float]]]:
    """(term, subjects with weights) of a sentence: longest matches that do not overlap, of its own language if known."""
    text = sentence.lower()
    found = []
    for end, (term, uses, dense) in auto.iter(text):
        start = end - len(term) + 1
        more = ""
        if not dense:
            if start and text[start - 1].isalpha():
                continue
            more = _ending(text, end + 1)
            if more is None:
                continue
        subjects = {s: w for k, s, w in uses if (language is None or k == language) and (not more or more in ENDINGS.get(k, ()))}
        if subjects:
            found.append((start, end, term, subjects))
    if len(found) < 2:
        return [(t, s) for _, _, t, s in found]
    found.sort(key=lambda m: (m[0] - m[1], m[0]))
    taken: list[tuple[int, int]] = []
    out = []
    for start, end, term, subjects in found:
        if all(end < a or b < start for a, b in taken):
            taken.append((start, end))
            out.append((start, term, subjects))
    return [(t, s) for _, t, s in sorted(out, key=lambda m: m[0])]


def content_sentences(text: str, model: BoundaryModel) -> list[tuple[str, list[str]]]:
    """(sentence, its words in lower case) of a text without headings, code and lines of marks."""
    out = []
    for s, e in decode(text, model):
        x = text[s:e].strip()
        words = WORDS.findall(x.lower())
        if CODE.search(x) or len(words) < 2 and not HAN.search(x) and not KANA.search(x):
            continue
        out.append((x, words))
    return out


def shares(text: str, auto: ahocorasick.Automaton, weight: dict[str, float], model: BoundaryModel) -> dict[str, float]:
    """Share of the sentences that treat each subject."""
    sure: Counter[str] = Counter()
    open_: list[set[str]] = []
    total = 0
    for x, words in content_sentences(text, model):
        language = language_of(x, words)
        terms = match(x, auto, language)
        if not terms and not HEADING.search(x):
            continue
        total += 1
        score: Counter[str] = Counter()
        for t, subjects in terms:
            for s, w in subjects.items():
                score[s] += w * weight.get(t, 1.0) / len(subjects)
        length = max(1, len(words) if language not in ("zh", "ja") else len(x) // 2)
        special = {s: v for s, v in score.items() if s != GENERAL and v / length >= LEAST}
        if not special:
            continue
        best = max(special.values())
        top = {s for s, v in special.items() if v >= best - 1e-9}
        if len(top) == 1:
            sure[next(iter(top))] += 1
        else:
            open_.append(top)
    for top in open_:
        # As much as the document's other sentences speak for each; nothing known leaves it with the first by name.
        sure[max(sorted(top), key=lambda s: sure[s])] += 1
    return {s: n / total for s, n in sure.items()} if total else {}


#: Kind of the events that count, for each term, the documents that hold it; and the cell that counts all documents.
TERM, ALL = 9, -1


def survey(docs: DataFrame, text: str, terms: Terms) -> tuple[dict[str, float], BoundaryModel]:
    """(weight of each term by rarity, sentence model) in one pass over all documents.

    The weight is the log of one over the share of documents that hold the term, over its value at a share of a
    thousandth; no copies of the corpus change it.
    """
    names = sorted(terms)

    def also(auto_of: dict, t: str) -> Iterator[tuple[int, ...]]:
        if not auto_of:
            auto_of["auto"], auto_of["at"] = build(terms), {n: i for i, n in enumerate(names)}
        yield TERM, 0, ALL, 0, 0, 0
        for term in {term for _, (term, _, _) in auto_of["auto"].iter(t.lower())}:
            yield TERM, 0, auto_of["at"][term], 0, 0, 0

    counts = materialize(sentences.count_events(docs, text, also))
    # One row for each term.
    n = {r["prev"]: r["n"] for r in counts.filter(F.col("kind") == TERM).collect()}
    total = max(1, n.get(ALL, 1))
    weight = {t: max(0.2, min(1.0, math.log(total / n[i]) / math.log(1000))) if i in n else 1.0 for i, t in enumerate(names)}
    return weight, sentences.learn(counts.filter(F.col("kind") != TERM))


def calibrate(scored: DataFrame, annotations: DataFrame) -> dict[str, float]:
    """Threshold of each subject of those in CUTS that agrees most with all annotated documents; the wanted quarter where they do not tell.

    `scored` has one row per document, `annotations` (doc_id, subject) may be wrong in part, repeated and differently written.
    All counting is done where the rows lie; a row for each subject comes back.
    """
    said = annotations.select("doc_id", F.lower(F.trim("subject")).alias("subject")).filter(F.col("subject").isNotNull() & F.col("doc_id").isNotNull()).distinct()
    marked = said.select("doc_id").distinct()
    truth = said.filter(F.col("subject") != GENERAL).withColumn("real", F.lit(1))
    got = scored.join(marked, "doc_id").select("doc_id", F.explode(F.arrays_zip("subjects", "parts")).alias("x")).select("doc_id", F.col("x.subjects").alias("subject"), F.col("x.parts").alias("part"))
    both = got.join(truth, ["doc_id", "subject"], "full")
    sums = [F.sum(F.when(F.col("part") >= c - 1e-9, F.coalesce("real", F.lit(0))).otherwise(0)).alias(f"hit{k}") for k, c in enumerate(CUTS)]
    sums += [F.count_if(F.col("part") >= c - 1e-9).alias(f"said{k}") for k, c in enumerate(CUTS)]
    out: dict[str, float] = {}
    for r in both.groupBy("subject").agg(F.sum("real").alias("real"), *sums).collect():
        best, cut = -1.0, QUARTER
        # From the wanted quarter down, so that it stays where annotations do not tell.
        for k, c in enumerate(CUTS):
            f1 = 2 * (r[f"hit{k}"] or 0) / max(1, (r[f"said{k}"] or 0) + (r["real"] or 0))
            if f1 >= best + 1e-3:
                best, cut = f1, c
        out[r["subject"]] = cut
    return out


def classify(docs: DataFrame, annotations: DataFrame | None, listing: str | None = None) -> DataFrame:
    """(doc_id, subject): subjects of each document with a non-blank text.

    Null and blank texts have none; a document without any term is general;
    repeated rows of one id count once. Annotations may be missing.
    """
    terms = read_terms(listing or default_terms())
    # Costly rows: two splits for each core even out what one long split would hold up.
    rows = materialize(spread(docs.filter(~is_blank(F.col("text"))).select("doc_id", "text"), splits_per_core=2))
    weight, model = survey(rows, "text", terms)
    shared = docs.sparkSession.sparkContext.broadcast((terms, weight, model))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t, w, m = shared.value
        auto = build(t)
        for pdf in batches:
            found = [shares(x, auto, w, m) for x in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "subjects": [list(s) for s in found], "parts": [[float(v) for v in s.values()] for s in found]})

    scored = materialize(rows.mapInPandas(run, "doc_id bigint, subjects array<string>, parts array<double>"))
    cuts = {} if annotations is None else calibrate(scored, annotations)
    cut = F.lit(QUARTER)
    limit = lambda s: F.coalesce(F.create_map(*[F.lit(v) for kv in cuts.items() for v in kv])[s], cut) if cuts else cut
    above = F.filter(F.zip_with("subjects", "parts", lambda s, p: F.struct(s.alias("s"), p.alias("p"))), lambda x: x["p"] >= limit(x["s"]) - 1e-9)
    chosen = F.transform(above, lambda x: x["s"])
    return scored.select("doc_id", F.explode(F.when(F.size(chosen) > 0, chosen).otherwise(F.array(F.lit(GENERAL)))).alias("subject")).distinct()
