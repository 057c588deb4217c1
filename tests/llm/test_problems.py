"""Operators for training data: brute force, exact round trips and edge cases on small tables."""

import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import align, confusables, dedup, defects, mixture, ocr, pieces, queries, sentences, subjects, tokens


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# 8: encoding


def test_encoding_equals_exact_merging():
    import base64

    import public_tokenizers
    import tiktoken

    path = tokens.default_vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    exact = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(5)
    texts = ["".join(r.choice("abcdefghtheinsanou  éü漢字📘\n1234<|endoftext|>") for _ in range(r.randint(0, 200))) for _ in range(800)]
    texts += ["a" * 3000, "<|endoftext|>", " \n\t ", "ﬀ", "the" * 900]
    assert tokens.encoder(path).encode_batch(texts) == [exact.encode_ordinary(t) for t in texts]


def test_encoding_edge_cases(spark):
    df = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "a b", 9), (3, "a b", 9), (None, "x", 9)], "doc_id bigint, text string, ids int")
    assert rows(tokens.encode(df)) == sorted([(1, []), (2, []), (3, [64, 275]), (3, [64, 275]), (None, [87])], key=str)
    assert tokens.encode(df.limit(0)).count() == 0


# 4: formatting-blind duplicates


def test_copies_against_brute_force(spark):
    texts = [
        "Title: A dog; Author: B; Pages: 10", "pages=10 / AUTHOR=b / title=a  dog", "Title: B; Author: A dog; Pages: 10", "In 1.5 days, go!", "in 1.5 DAYS go", "In 15 days, go!",
        "> In 1.5 days, go", "straße", "STRASSE", "", None, "...", "x", "x", "a b", "b a",
    ]
    df = spark.createDataFrame(list(enumerate(texts, 1)), "chunk_id bigint, original string").withColumn("digest", F.lit("clash"))
    assert rows(dedup.copies_found(df)) == [(1, 2), (13, 14), (4, 5), (4, 7), (8, 9)]
    records = dict(rows(dedup.records(df)))
    assert records == {1: 2, 3: 1, 4: 3, 6: 1, 8: 2, 13: 2, 15: 1, 16: 1}
    assert dedup.copies_found(df.limit(0)).count() == 0 and dedup.records(df.limit(0)).count() == 0


def test_invariant_is_shared_by_copies(spark):
    r = random.Random(2)
    base = "Often, the box 12.5 opens; the door K7."
    made = [base]
    for _ in range(40):
        t = r.choice([base.upper(), base.lower(), base.replace(" ", "  "), "*" + base + "*", base.replace(",", " -"), "[" + base + "]!"])
        made.append(t)
    df = spark.createDataFrame(list(enumerate(made)), "id int, t string")
    assert df.select(dedup.cheap_invariant(F.col("t")).alias("i")).distinct().count() == 1
    assert df.select(dedup.costly_key(F.col("t")).alias("i")).distinct().count() == 1


# 7: look-alikes


@pytest.mark.parametrize(
    ("text", "wanted"),
    [("Ｋｏｍ module", "Kom module"), ("é", "é"), ("a​b­c", "abc"), ("a b c", "a b c"), ("lеdgеr", "ledger"), ("ΟSJEΡDRA", "OSJEPDRA"), ("Ёлка и хор", "Ёлка и хор"), ("x²", "x²"), (None, None), ("", "")],
)
def test_unify(text, wanted):
    assert confusables.unify(text) == (unicodedata.normalize("NFC", wanted) if wanted else wanted)


def test_terms(spark):
    g = spark.createDataFrame([(1, "Komhor module"), (2, "Ｋｏｍｈｏｒ ｍｏｄｕｌｅ"), (3, "Pelé"), (4, None), (5, "​")], "line_no int, source string")
    c = spark.createDataFrame([(1, "the komhor modulе."), (2, "komhor modules"), (3, "Pele"), (4, "Komhor module"), (5, None), (6, "xPelé Pelé")], "chunk_id bigint, original string")
    found = confusables.find_terms(c.withColumn("line_no", F.lit(0)), g, disguised_only=True)
    assert rows(found) == [(1, 1), (1, 2), (4, 2), (6, 3)] or rows(found) == [(1, 1), (1, 2), (4, 2)]
    assert (4, 1) in rows(confusables.find_terms(c, g))
    assert confusables.find_terms(c.limit(0), g).count() == 0 and confusables.find_terms(c, g.limit(0)).count() == 0
    assert rows(confusables.find_terms(c, g, block_terms=1)) == rows(confusables.find_terms(c, g))
    assert rows(confusables.unify_column(c, "original", "u").select("chunk_id", "u"))[0] == (1, "the komhor module.")


# 2: sentences


@pytest.fixture(scope="module")
def boundary(spark):
    r = random.Random(1)
    nouns, verbs, ends = ["box", "lamp", "street", "judge", "window"], ["opens", "covers", "shows"], ["", " at 7 a.m.", " on p. 12.", " with the lid, etc.", " in Fig. 4.", " for Norvel Ltd."]
    texts = []
    for _ in range(1500):
        out = []
        for _ in range(r.randint(1, 5)):
            who = r.choice(["The " + r.choice(nouns), "Dr. Ombrel", "J. K. Zorvan", "Often, the " + r.choice(nouns)])
            s = f"{who} {r.choice(verbs)} the {r.choice(nouns)}{r.choice(ends)}"
            out.append(s if s.endswith(".") else s + r.choice([".", ".", "?", " because the box opens."]))
        texts.append(" ".join(out))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return sentences.train(df, "t")


@pytest.mark.parametrize(
    "parts",
    [
        ["Dr. Ombrel opens the box. ", "The lamp shows p. 12 at 7 a.m. ", "The judge opens it."],
        ["“The box opens. The lamp shows,” said Dr. Ombrel. ", "The street opens."],
        ["The box opens with the lid, etc. ", "Often, the lamp opens."],
        ["1. The box opens. ", "2. The lamp opens."],
        ["The box... opens the lamp; the street, too: yes. ", "The end"],
        ["箱子打开灯。", "2. 灯打开箱子。", "IV. 家庭打开！"],
        ["The box opens at 7 a.m. ", "IV. The lamp opens."],
        ["„Die Box.“ ", "The lamp opens."],
        ["A heading\n\n", "The box\nopens the lamp."],
        ["The box opens.", "The lamp shows."],
        ["箱子打开灯。", "老师说：“灯打开。箱子关闭。”", "家庭打开！"],
        ["窓は箱を開く。", "先生は「箱を開く。」と言った。"],
        ["क्या चालक पंप रखता है? ", "माली शहर में है। ", "वह"],
        ["หมอเปิดประตูราว 29.6 เมตร ", "ครูซื้อกล่อง"],
        ["เขาเรียน Python และ Java ที่มหาวิทยาลัย ", "ครูซื้อกล่อง"],
    ],
)
def test_sentences(boundary, parts):
    text = "".join(parts)
    starts, at = [], 0
    for p in parts:
        starts.append(at)
        at += len(p)
    assert [s for s, _ in sentences.decode(text, boundary)] == starts


def test_sentence_edge_cases(spark, boundary):
    for t in ("", " \n", "...", "•", "📘", "?!"):
        assert sentences.decode(t, boundary) == []
    long = "The box opens the lamp. " * 2000
    assert len(sentences.decode(long, boundary)) == 2000
    df = spark.createDataFrame([(1, None), (2, ""), (3, " A b. C d."), (3, " A b. C d.")], "doc_id int, text string")
    assert {r[1] for r in rows(sentences.sentence_starts(df, ["doc_id"], "text", boundary))} >= {1}
    assert sentences.train(df.limit(0), "text").seen.sum() == 0
    counts = sentences.count_events(spark.createDataFrame([("A b. C d. E f.",)] * 9, "t string"), "t")
    assert counts.agg(F.sum("n")).first()[0] % 9 == 0


def test_training_does_not_depend_on_the_number_of_pairs(spark):
    r = random.Random(4)
    name = lambda: "".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(7)).capitalize()
    texts = [f"The lamp of Abt. {name()} opens the box. Then the {name().lower()} covers it. It ends." for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    small, large = sentences.train(df, "t"), sentences.train(df, "t", most=50)
    for k in ("ends", "seen", "start", "start_shape", "inner_word", "inner_shape", "start_like"):
        assert np.allclose(getattr(small, k), getattr(large, k), rtol=1e-6, atol=1e-12), k
    assert small.inner_total.keys() == large.inner_total.keys() and len(large.inner.keys) == len(small.inner)
    assert all(abs(large.inner.get(k, 0.0) - v) < 1e-6 for k, v in small.inner.items()) and large.inner.get((1, 1), 0.5) == 0.5
    assert large.ending("Abt") == pytest.approx(small.ending("Abt"), abs=1e-6)
    assert [sentences.decode(t, large) for t in texts[:50]] == [sentences.decode(t, small) for t in texts[:50]]


def test_boundaries_do_not_depend_on_copies_of_the_corpus(spark):
    texts = ["Dr. Ombrel opens the box. The lamp shows p. 12 at 7 a.m. The judge opens it!", "Abt. 7 closes. Often, Abt. 9 opens? It rains etc. The street ends.", "箱子打开灯。灯打开箱子。", "หมอเปิดประตู ครูซื้อกล่อง"] * 3
    starts = []
    for k in (1, 10, 100):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts * k)], "id int, t string")
        starts.append(rows(sentences.sentence_starts(df.filter("id < 12"), ["id"], "t", sentences.train(df, "t"))))
    assert starts[0] == starts[1] == starts[2]


# 5: splitting


def test_pieces_properties(boundary):
    r = random.Random(4)
    for _ in range(200):
        words = ["x" * r.randint(1, 30) + r.choice(["", ",", ".", ". ", " ", "\n", "。"]) for _ in range(r.randint(1, 80))]
        text = " ".join(words)[: r.randint(1, 900)]
        limit, overlap = r.randint(5, 120), r.randint(0, 60)
        cut = pieces.split_item(text, limit, overlap, sentences.decode(text, boundary))
        assert cut[0][0] == 0 and cut[-1][1] == len(text)
        assert all(0 < e - s <= limit for s, e, _ in cut)
        assert all(b[0] <= a[1] and b[1] > a[1] and b[0] > a[0] for a, b in zip(cut, cut[1:]))
    assert pieces.split_item("", 5, 1, []) == [] and pieces.split_item("abc", 5, 1, []) == [(0, 3, 4)]


def test_boundary_kinds(spark, boundary):
    assert pieces.boundary_kind("a " + "x" * 30, 20, []) == "none"
    assert pieces.boundary_kind("a b, c d e f g h", 5, [(0, 16)]) == "inner"
    assert pieces.boundary_kind("ab. cd. ef.", 5, [(0, 3), (4, 7), (8, 11)]) == "sentence"
    items = spark.createDataFrame([(1, "x" * 30, 20, 5), (2, "short", 20, 5), (3, None, 20, 5), (4, "y" * 30, None, None)], "id int, original string, max_chars int, overlap_chars int")
    out = pieces.split_items(items, boundary, ["id"]).collect()
    assert [(r["id"], r["boundary"], len(r["pieces"])) for r in out] == [(1, "none", 2)]


# 1: alignment


def test_alignment_of_a_small_corpus(spark):
    r = random.Random(3)
    a, b = [f"w{i}" for i in range(40)], [f"übel{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40)]
    lines, wanted = [], set()
    for doc in range(60):
        left = [[r.randrange(40) for _ in range(r.randint(3, 7))] for _ in range(14)]
        right = [(i, ws) for i, ws in enumerate(left)]
        gone = r.randrange(14)
        right = [x for x in right if x[0] != gone]
        k = r.randrange(len(right) - 1)
        right[k], right[k + 1] = right[k + 1], right[k]
        for seq in range(14):
            o = " ".join(a[w] for w in left[seq])
            t = " ".join(b[w] for w in right[seq][1]) if seq < len(right) else None
            lines.append((doc, seq + 1, o, t, "en", "de"))
        wanted |= {(doc, i + 1, j + 1) for j, (i, _) in enumerate(right)}
    df = spark.createDataFrame(lines, "doc_id bigint, seq int, original string, translation string, source_lang string, target_lang string")
    got = {tuple(x) for x in align.align(df.withColumn("pair", F.lit("clash"))).select("doc_id", "original_seq", "translation_seq").collect()}
    assert len(got & wanted) > 0.93 * len(wanted) and len(got & wanted) > 0.97 * len(got)
    assert align.align(df.limit(0)).count() == 0


def _parallel(r, vocabulary, doc, n, kept, moved=()):
    """Rows of a document whose translation renders the originals of `kept` in that order, and the true links."""
    originals = [" ".join(r.choice(vocabulary) for _ in range(r.randint(6, 11))) + "." for _ in range(n)]
    order = [i for i in kept if i not in set(moved)] + list(moved)
    other = lambda w: w[::-1] + "ka"
    translations = [" ".join(other(w) for w in originals[i].rstrip(".").split() if r.random() > 0.1) + "." for i in order]
    size = max(n, len(order))
    rows_ = [(doc, q + 1, originals[q] if q < n else None, translations[q] if q < len(order) else None, "en", "xx") for q in range(size)]
    return rows_, {(doc, i + 1, j + 1) for j, i in enumerate(order)}


def test_long_documents_with_omissions_and_moves(spark):
    r = random.Random(4)
    vocabulary = ["".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(r.randint(2, 3))) for _ in range(900)]
    data, truth = [], set()
    for doc, n, kept, moved in [
        (1, 1000, range(300, 1000), ()),  # the first 300 are left out
        (2, 1200, range(1200), range(100, 220)),  # a chapter stands at the end
        (3, 900, [i for i in range(900) if not 400 <= i < 430], (5,)),
        *((k, 20, range(20), ()) for k in range(10, 90)),
    ]:
        rows_, links = _parallel(r, vocabulary, doc, n, kept, moved)
        data += rows_
        truth |= links
    df = spark.createDataFrame(data, "doc_id bigint, seq int, original string, translation string, source_lang string, target_lang string")
    got = [tuple(x) for x in align.align(df).select("doc_id", "original_seq", "translation_seq").collect()]
    assert len(got) == len(set(got))
    for doc in (1, 2, 3):
        found, real = {x for x in got if x[0] == doc}, {x for x in truth if x[0] == doc}
        assert len(found & real) >= 0.95 * len(real) and len(found & real) >= 0.95 * len(found), doc


def test_blocks_and_whole_documents_agree(spark):
    r = random.Random(9)
    vocabulary = ["".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(r.randint(2, 3))) for _ in range(600)]
    data, truth = [], set()
    for doc, n in ((None, 130), (2, 260), *((k, 20) for k in range(10, 60))):
        rows_, links = _parallel(r, vocabulary, doc, n, [i for i in range(n) if i % 37 != 5])
        data += rows_ + rows_[:1]
        truth |= links
    data += [(3, 1, None, "x", "en", "xx"), (3, None, "a b", "c d", "en", "xx"), (4, 1, "", " ", None, None), (5, 1, "one " * 4000, "eno " * 3000, "en", "xx")]
    df = spark.createDataFrame(data, "doc_id bigint, seq int, original string, translation string, source_lang string, target_lang string").distinct().withColumn("cells", F.lit("clash"))
    for window in (400, 50):
        got = {tuple(x) for x in align.align(df, window).select("doc_id", "original_seq", "translation_seq").collect()}
        for doc in (None, 2):
            found, real = {x for x in got if x[0] == doc}, {x for x in truth if x[0] == doc}
            assert len(found & real) >= 0.97 * max(len(found), len(real)), (window, doc)


def test_long_documents_without_rare_words(spark):
    r = random.Random(4)
    vocabulary = sorted({"".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(r.randint(2, 3))) for _ in range(60)})
    # Every word stands all over the documents. One lacks its first 200 sentences, the other has them at the end in any order.
    data, truth = _parallel(r, vocabulary, 1, 800, range(200, 800))
    more, links = _parallel(r, vocabulary, 2, 800, [*range(200, 800), *r.sample(range(200), 200)])
    data, truth = data + more, truth | links
    data += [x for k in range(10, 60) for x in _parallel(r, vocabulary, k, 20, range(20))[0]]
    df = spark.createDataFrame(data, "doc_id bigint, seq int, original string, translation string, source_lang string, target_lang string")
    got = {tuple(x) for x in align.align(df, 100).filter("doc_id < 10").select("doc_id", "original_seq", "translation_seq").collect()}
    for doc in (1, 2):
        found, real = {x for x in got if x[0] == doc}, {x for x in truth if x[0] == doc}
        assert len(found & real) >= 0.97 * max(len(found), len(real)), (doc, len(found), len(real), len(found & real))


def test_a_long_document_alone_trains_on_itself(spark):
    r = random.Random(7)
    vocabulary = sorted({"".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(r.randint(2, 4))) for _ in range(1500)})
    data, truth = _parallel(r, vocabulary, 1, 1600, [i for i in range(1600) if not 200 <= i < 400 and r.random() > 0.03])
    df = spark.createDataFrame(data, "doc_id bigint, seq int, original string, translation string, source_lang string, target_lang string")
    got = {tuple(x) for x in align.align(df).select("doc_id", "original_seq", "translation_seq").collect()}
    assert len(got & truth) >= 0.97 * max(len(got), len(truth)), (len(got), len(truth), len(got & truth))


def test_tiles_give_the_links_of_whole_documents():
    from quire.llm.lexicon import CELLS, Lexicon, Strengths

    for seed in range(60):
        r = random.Random(seed)
        size = r.choice([6, 15, 40])
        entries = sorted({(a, 100 + b): (r.uniform(0.1, 1), r.uniform(0.1, 1)) for a in range(size) for b in {a, *r.sample(range(size), 2)}}.items())
        keys = np.array([*range(size), *range(100, 100 + size)])
        w = np.array([r.uniform(0.3, 3) for _ in keys])
        lex = Strengths.of(Lexicon({"a-b": 0}, np.array([a * CELLS + b for (a, b), _ in entries]), np.array([v[0] for _, v in entries]), np.array([v[1] for _, v in entries]), keys, w, keys, w))
        s = [sorted({r.randrange(size) for _ in range(r.randint(0, 7))}) for _ in range(r.randint(1, 30))]
        t = [[]]
        for x in r.sample(s, len(s)) if seed % 3 == 0 else s:
            y = [100 + c for c in x if r.random() > 0.15]
            how = r.random()
            # Split, merged with the one before, left out, or as it is.
            if how < 0.3:
                t = [*t, y[: len(y) // 2], y[len(y) // 2 :]] if how < 0.15 else [*t[:-1], list(dict.fromkeys(t[-1] + y))]
            elif how < 0.9:
                t.append(y)
        crowded = tuple(np.array([c for c in range(200) if sum(c in x for x in side) > max(3, align.CROWD * len(side))], np.int64) for side in (s, t))
        wanted = align.lexical_links([s], [t], ["a-b"], lex)[0]
        for tile in (1, 3, 7, 50):
            found = []
            for a in range(0, len(s), tile):
                for b in range(0, len(t), tile):
                    i, j, *gains = align._places(align.Scores([s[max(0, a - 1) : a + tile]], [t[max(0, b - 1) : b + tile]], ["a-b"], lex, crowded), int(a > 0), int(b > 0))
                    found.append((i + a, j + b, *gains))
            places = [np.concatenate(x)[::-1] for x in zip(*found)]
            got = align.place_links(*places) if len(places[0]) else []
            assert [x[:2] for x in got] == [x[:2] for x in wanted] and np.allclose([x[2] for x in got], [x[2] for x in wanted], atol=1e-5), (seed, tile)


def test_scores_by_brute_force():
    from quire.llm.lexicon import CELLS, Lexicon, Strengths

    r = random.Random(8)
    entries = sorted({(a, b): (r.uniform(0.1, 1), r.uniform(0.1, 1)) for a in range(12) for b in r.sample(range(20, 34), 3)}.items())
    weights = {c: r.uniform(0.5, 3) for c in range(40)}
    keys = np.array(sorted(weights))
    w = np.array([weights[k] for k in keys])
    lex = Lexicon({"a-b": 0}, np.array([a * CELLS + b for (a, b), _ in entries]), np.array([v[0] for _, v in entries]), np.array([v[1] for _, v in entries]), keys, w, keys, w)
    s = [[[0, 1, 5], [2, 35], [3, 4, 36]], [[1, 7, 8]]]
    t = [[[20, 22, 25], [35, 27], [30, 31], [36]], [[21, 29], [33, 5]]]
    sc = align.Scores(s, t, ["a-b", "a-b"], Strengths.of(lex))
    for d in range(2):
        for i, a in enumerate(s[d]):
            for j, b in enumerate(t[d]):
                value = 0.0
                for word in a:
                    own = {y: v[0] for (x, y), v in entries if x == word}
                    best = max(own.values(), default=1.0)
                    own = {y: (v / best) ** 0.5 for y, v in own.items() if v > 0.05 * best} or {word: 1.0}
                    value += weights[word] * max((v for y, v in own.items() if y in b), default=0.0)
                assert abs(value / sum(weights[x] for x in a) - sc.s[i, j, d]) < 1e-5


def test_alignment_does_not_depend_on_copies_of_the_corpus(spark):
    r = random.Random(6)
    vocabulary = ["".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(r.randint(2, 3))) for _ in range(300)]
    data = [x for doc in range(1, 25) for x in _parallel(r, vocabulary, doc, 12, [i for i in range(12) if i != doc % 12])[0]]
    schema = "doc_id bigint, seq int, original string, translation string, source_lang string, target_lang string"
    one = align.align(spark.createDataFrame(data, schema)).select("doc_id", "original_seq", "translation_seq")
    many = align.align(spark.createDataFrame([(x[0] + 1000 * k, *x[1:]) for k in range(10) for x in data], schema)).filter("doc_id < 1000").select("doc_id", "original_seq", "translation_seq")
    assert rows(one) == rows(many)



# 6: defects


def test_defects(spark):
    r = random.Random(6)
    a, b = ["box", "lamp", "street", "judge", "winter", "teacher"], ["kiste", "lampe", "straße", "richter", "winter", "lehrer"]
    data = []
    for i in range(900):
        ws = [r.randrange(6) for _ in range(8)]
        data.append([1, i, "The " + " the ".join(a[w] for w in ws) + ".", "Die " + " die ".join(b[w] for w in ws) + ".", "en", "de"])
    for i in range(900, 1100):
        ws = [r.randrange(6) for _ in range(8)]
        data.append([1, i, "The " + " the ".join(a[w] for w in ws) + ".", "".join("箱灯街官冬师"[w] for w in ws) + "。", "en", "zh"])
    data[0][3], data[1][3], data[2][3] = None, data[1][2], "I'm sorry, but I cannot translate this text."
    data[3][3] = data[3][3][: len(data[3][3]) // 3]
    data[4] = [1, 4, "A24-245", "", "en", "de"]
    data[5] = [1, 5, " ", "", "en", "de"]
    df = spark.createDataFrame(data, "doc_id bigint, seq int, original string, translation string, source_lang string, target_lang string")
    got = {x["seq"]: x["defect"] for x in defects.defects(df).collect()}
    assert {k: got.get(k) for k in range(6)} == {0: "empty", 1: "copy", 2: "refusal", 3: "truncated", 4: None, 5: None}
    assert len(got) < 40
    assert defects.defects(df.limit(0)).count() == 0


@pytest.mark.parametrize(("text", "wanted"), [("A24-245", False), ("docs.norvel.example/150", False), ("54.5 / 34", False), ("* * *", False), ("desk66@quelda.example", False), ("The box", True), ("箱", True), (None, False)])
def test_words_to_translate(text, wanted):
    assert defects.has_words(text) is wanted


def test_defects_do_not_depend_on_how_often_a_translation_recurs(spark, monkeypatch):
    from types import SimpleNamespace

    # A text that ends in the open, truncated by the classifier and a refusal by a probability under the threshold.
    features = SimpleNamespace(of=lambda o, *a: (np.ones((len(o), 40)), None, None))
    model = SimpleNamespace(probabilities=lambda x, *a: np.tile([0.2, 0.0, 0.9, 0.0], (len(x), 1)), cut=np.full(4, 0.5))
    monkeypatch.setattr(defects, "train", lambda rows: (features, model))
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: SimpleNamespace(value=value))
    df = spark.createDataFrame([(1, i, f"The {w} opens the garden.", "Bitte warten und", "en", "de") for i, w in enumerate("box lamp door wind boat tree road bell fish".split())], "doc_id bigint, seq int, original string, translation string, source_lang string, target_lang string")
    for k in (1, 9):
        assert [r["defect"] for r in defects.defects(df.limit(k)).collect()] == ["truncated"] * k


def test_defects_do_not_depend_on_copies_of_the_corpus(spark):
    r = random.Random(2)
    a, b, c = ["box", "lamp", "street", "judge", "winter", "teacher", "garden", "bridge"], ["kiste", "lampe", "straße", "richter", "jahreszeit", "lehrer", "garten", "brücke"], "箱灯街官冬师园桥"
    data = []
    for i in range(240):
        ws = [r.randrange(8) for _ in range(8)]
        o, t, k = "The " + " the ".join(a[w] for w in ws) + ".", "Die " + " die ".join(b[w] for w in ws) + ".", "de"
        if i % 5 == 0:
            t, k = "".join(c[w] for w in ws) + "。", "zh"
        t = {7: None, 11: o, 13: t[: len(t) // 3], 17: "I'm sorry, but I cannot translate this text."}.get(i % 40, t)
        data.append((1, i, o, t, "en", k))
    schema = "doc_id bigint, seq int, original string, translation string, source_lang string, target_lang string"
    found = [rows(defects.defects(spark.createDataFrame([(d + 10 * k, *x) for k in range(n) for d, *x in data], schema)).filter("doc_id = 1")) for n in (1, 10)]
    assert found[0] == found[1] and {x[2] for x in found[0]} >= {"empty", "copy", "truncated", "refusal"}


def test_subjects_do_not_depend_on_copies_of_the_corpus(spark):
    r = random.Random(7)
    words = {"law": ["judge", "verdict", "court"], "music": ["violin", "choir", "symphony"], "general": ["lamp", "street", "chair"]}
    docs = [(i, " ".join(f"The {r.choice(words[s])} moves the {r.choice(words[s])}." for s in r.choices(list(words), k=8)), None) for i in range(60)]
    marks = [(i, r.choice(["law", "music", "general"]), "a") for i in range(0, 60, 2)]
    found = []
    for k in (1, 10, 100):
        df = spark.createDataFrame([(i + 1000 * c, t, x) for c in range(k) for i, t, x in docs], "doc_id bigint, text string, extra string")
        m = spark.createDataFrame([(i + 1000 * c, s, w) for c in range(k) for i, s, w in marks], "doc_id bigint, subject string, annotator string")
        found.append(rows(subjects.classify(df, m).filter("doc_id < 1000")))
    assert found[0] == found[1] == found[2]


def test_coverage_by_brute_force():
    from quire.llm import lexicon
    from quire.llm.lexicon import CELLS, Lexicon

    r = random.Random(5)
    p = {(a, b): r.uniform(0.05, 0.5) for a in range(10) for b in r.sample(range(20, 30), 3)}
    keys = sorted(p)
    weights = {c: r.uniform(0.1, 3) for c in range(10)}
    lex = Lexicon({"a-b": 0}, np.array([a * CELLS + b for a, b in keys]), np.array([p[k] for k in keys]), np.zeros(len(keys)), np.arange(10), np.array([weights[c] for c in range(10)]), np.zeros(0, int), np.zeros(0))
    features = defects.Features(lex, defects.languages(__import__("pandas").DataFrame({"k": [], "c": [], "n": []})), {})
    o, t = [[r.randrange(14) for _ in range(r.randint(0, 9))] for _ in range(60)], [[r.randrange(8, 32) for _ in range(r.randint(0, 9))] for _ in range(60)]
    cover, tail, last, front = features.coverage(np.zeros(60, np.int64), *defects._joined(o), *defects._joined(t))
    for i, (a, b) in enumerate(zip(o, t)):
        marks = []
        for c in a:
            own = {y: v for (x, y), v in p.items() if x == c}
            if own or c in b:
                marks.append((weights.get(c, 4.0), 1.0 if c in b else min(1.0, 3 * max((v for y, v in own.items() if y in b), default=0.0))))
        total = sum(w for w, _ in marks)
        run = 0.0
        for w, v in reversed(marks):
            if v > 0.25 and w > 0.3:
                break
            run += w
        assert abs(cover[i] - (sum(w * v for w, v in marks) / total if total else 0.5)) < 1e-9
        assert abs(tail[i] - (run / total if total else 0.0)) < 1e-9
        for got, order, part in ((last[i], marks[::-1], total / 3), (front[i], marks, total / 2)):
            have = gain = 0.0
            for w, v in order:
                if have > part + 1e-12:
                    break
                have, gain = have + w, gain + w * v
            assert abs(got - (gain / have if have else 0.5)) < 1e-9
    assert defects.sentence_count("It opens at approx. 8 bar. Dr. Ombrel closes it! Does it? Yes.") == 4 and defects.sentence_count("箱子。灯？") == 2


# 3: scanned pages


def test_kinds():
    assert [ocr.kind_of(t, y, 10.0) for t, y in (("- 3O -", 818.0), ("xiv", 45.0), ("Page 9", 45.0), ("12 / 40", 45.0), ("Handbook 7", 33.0), ("Chapter 2: A box   50", 33.0), ("Chapter 2\nThe box", 115.0), ("388", 300.0), ("3 A note.", 770.0), ("The box opens.", 300.0), (None, 300.0), ("x y", None))] == [
        "page_number", "page_number", "page_number", "page_number", "running_line", "running_line", "heading", "cell", "footnote", "body", "blank", "body",
    ]


def test_scanned_blocks(spark):
    body = "The window opens the garden with the cross-border lamp and the neighbour covers version 4.2."
    data = [("ocr", 1, p, i, body, 100.0 + 20 * i, 13.0) for p in range(1, 30) for i in range(4)]
    data += [
        ("ocr", 2, 1, 0, "Handbook of X 7", 33.0, 10.0), ("ocr", 2, 1, 1, "The win-\ndow opens the gar­\nden.", 100.0, 26.0), ("ocr", 2, 1, 2, "The winclow covers version 4.2 with the cross-\nborder lamp.", 130.0, 26.0),
        ("ocr", 2, 1, 3, "The neigh-", 160.0, 13.0), ("ocr", 2, 1, 4, "- 12 -", 820.0, 10.0), ("ocr", 2, 2, 0, "bour opens the lamp.", 80.0, 13.0), ("ocr", 2, 2, 1, "version 4.l2 covers", 100.0, 13.0), ("ocr", 2, 2, 2, None, 120.0, 13.0),
        ("ocr", None, None, None, "xii", 820.0, 10.0), (None, None, None, 3, "The winclow opens.", None, None),
    ]
    df = spark.createDataFrame(data, "origin string, doc_id bigint, page int, idx int, text string, top_y double, height double").withColumn("kind", F.lit("clash"))
    got = [tuple(r)[2:] for r in ocr.defects(df).filter("doc_id = 2").orderBy("page", "idx", "defect").collect()]
    assert got == [(1, 0, "running_line"), (1, 1, "broken_word"), (1, 2, "misread"), (1, 3, "broken_word"), (1, 4, "page_number"), (2, 1, "misread")]
    assert {tuple(r) for r in ocr.defects(df).filter("doc_id IS NULL").collect()} == {("ocr", None, None, None, "page_number"), ("", None, None, 3, "misread")}
    texts = {r["page"]: r["text"] for r in ocr.paragraphs(df).filter("doc_id = 2 AND para_no = 1").collect()}
    assert texts[1] == "The window opens the garden." and texts[2].startswith("opens the lamp.")
    assert ocr.defects(df.limit(0)).count() == 0 and ocr.paragraphs(df.limit(0)).count() == 0


def test_headings_cells_and_footnotes_are_paragraphs(spark):
    body = "The window opens the garden with the lamp and the neighbour covers the version."
    data = [("ocr", 1, p, i, body, 100.0 + 20 * i, 13.0) for p in range(1, 30) for i in range(4)]
    data += [
        ("ocr", 2, 1, 0, "Handbook of X 7", 33.0, 10.0), ("ocr", 2, 1, 1, "Chapter 2\nThe lamp", 100.0, 26.0), ("ocr", 2, 1, 2, "The window opens", 140.0, 13.0), ("ocr", 2, 1, 3, "388\n12", 160.0, 13.0),
        ("ocr", 2, 1, 4, "the garden.", 180.0, 13.0), ("ocr", 2, 1, 5, " ", 200.0, 13.0), ("ocr", 2, 1, 6, "3 The neigh-\nbour.", 770.0, 13.0), ("ocr", 2, 1, 7, "- 12 -", 820.0, 10.0),
    ]
    df = spark.createDataFrame(data, "origin string, doc_id bigint, page int, idx int, text string, top_y double, height double")
    got = ocr.paragraphs(df).filter("doc_id = 2").orderBy("para_no").collect()
    assert [(r["kind"], r["text"]) for r in got] == [("heading", "Chapter 2 The lamp"), ("body", "The window opens the garden."), ("cell", "388 12"), ("footnote", "3 The neighbour.")]


def test_paragraphs_go_on_across_pages_and_slices(spark, monkeypatch):
    body = "The window opens the garden with the lamp and the neighbour covers the version."
    data = [("ocr", 1, p, 0, body, 100.0, 13.0) for p in range(1, 90)]
    data += [
        ("ocr", 2, 1, 0, "The window opens the neigh-", 100.0, 13.0), ("ocr", 2, 1, 1, "3 The lamp.", 770.0, 13.0), ("ocr", 2, 2, 0, "bour and", 100.0, 13.0),
        *[("ocr", 2, p, 0, "388", 300.0, 13.0) for p in range(3, 25)], ("ocr", 2, 25, 0, "the Garden. The lamp covers", 100.0, 13.0),
        ("ocr", 2, 26, 0, "Lamp version.", 100.0, 13.0), ("ocr", 2, 27, 0, "The lamp opens the", 100.0, 13.0), ("ocr", 2, 28, 0, "Chapter 3\nThe garden", 100.0, 26.0), ("ocr", 2, 28, 1, "The window covers", 140.0, 13.0),
        *[("ocr", 3, 1, i, "the lamp covers", 100.0 + i, 1.0) for i in range(5)], ("ocr", 3, 1, 5, "the lamp.", 106.0, 1.0), ("ocr", 3, 2, 0, "The window.", 100.0, 13.0),
    ]
    df = spark.createDataFrame(data, "origin string, doc_id bigint, page int, idx int, text string, top_y double, height double")
    monkeypatch.setattr(ocr, "SLICE", 2)
    monkeypatch.setattr(ocr, "GROUP", 10)
    got = ocr.continuous(df).filter("doc_id > 1").orderBy("doc_id", "para_no").collect()
    assert [(r["doc_id"], r["page"], r["kind"], r["text"]) for r in got if r["text"] != "388"] == [
        (2, 1, "body", "The window opens the neighbour and the Garden. The lamp covers Lamp version."), (2, 1, "footnote", "3 The lamp."),
        (2, 27, "body", "The lamp opens the"), (2, 28, "heading", "Chapter 3 The garden"), (2, 28, "body", "The window covers"),
        (3, 1, "body", "the lamp covers " * 5 + "the lamp."), (3, 2, "body", "The window."),
    ]
    assert [r["para_no"] for r in got if r["doc_id"] == 2] == list(range(1, 28)) and ocr.continuous(df.limit(0)).count() == 0
    # Every state counts: after an end, in the open, under a heading.
    assert [ocr.goes_on(e, l, headed=h) for e in (True, False) for l in (True, False) for h in (True, False)] == [False, True, False, False, True, True, False, True]


def _pages(copies):
    r = random.Random(3)
    vocabulary = ["".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(r.randint(2, 4))) for _ in range(60)] + ["modern"] * 4 + ["corner", "clear", "of", "the"]
    out = []
    for page in range(1, 25):
        words = [r.choice(vocabulary) for _ in range(80)]
        lines = [" ".join(words[i : i + 8]) for i in range(0, 80, 8)]
        lines[2] = lines[2][:-2] + "-"
        lines[3] = words[23][-2:] + " " + lines[3]
        if page % 12 == 0:
            lines[5] += " modem ofthe"
        out += [(1, page, 0, "Old Book", 30.0), (1, page, 1, "\n".join(lines) + ".", 200.0), (1, page, 2, str(page + 7), 820.0)]
    return [("ocr", d + 10 * k, p, i, t, y, 20.0) for k in range(copies) for d, p, i, t, y in out]


def test_repair_does_not_depend_on_copies_of_the_corpus(spark):
    schema = "origin string, doc_id bigint, page int, idx int, text string, top_y double, height double"
    found = [rows(ocr.defects(spark.createDataFrame(_pages(k), schema)).filter("doc_id = 1")) for k in (1, 10, 100)]
    assert found[0] == found[1] == found[2] and {"broken_word", "misread", "running_line", "page_number"} == {x[4] for x in found[0]}


def test_rare_words_come_by_join(spark):
    schema = "origin string, doc_id bigint, page int, idx int, text string, top_y double, height double"
    df = spark.createDataFrame(_pages(1), schema)
    words, rarer = ocr.train(df, common=0.014)
    assert 0 < len(words.count) <= 1 / 0.014 and rarer.count() > 0
    pages, model = ocr.repair(df, common=0.014)
    known = {**{r["word"]: r["n"] for r in rarer.collect()}, **words.count}
    for r in pages.collect():
        body = [(b["idx"], b["text"]) for b in r["blocks"] if b["kind"] == "body"]
        wanted = ocr.asked(body, model.count)
        assert ocr._counts(r["rare"]).items() >= {w: known[w] for w in wanted if w in known}.items()


def test_words_run_together_and_margins():
    words = ocr.Words.of({"of": 400, "the": 700, "river": 60, "bridge": 50, "word": 90})
    assert [p.printed for p in ocr.decode([(0, "bridge ofthe river")], words)] == ["bridge", "of the", "river"]
    assert ocr.kind_of("mix", 30.0, 9.0) == "running_line" and ocr.kind_of("xiv", 30.0, 9.0, True) == "page_number"
    assert ocr.kind_of("The old bridge closes late in winter.", 30.0, 9.0) == "body" and ocr.kind_of("The old bridge closes late in winter.", 30.0, 9.0, True) == "running_line"
    assert ocr.margin_keys("xiv", 3) == ["r"] and ocr.margin_keys("- 17 -", 3) == ["n14"] and ocr.margin_keys("Handbook 60", 1) == ocr.margin_keys("Handbook 61", 2)


# 9: mixing


def test_permutations_and_deal():
    for n in (1, 2, 7, 100, 1025):
        assert sorted(mixture.permute(np.arange(n), np.full(n, n), np.full(n, 3))) == list(range(n))
    counts = mixture.deal([100, 50, 7], 16, 1)
    assert counts.sum(axis=0).tolist() == [100, 50, 7] and set(counts.sum(axis=1)[:-1]) == {16}
    p = mixture.plan([("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.2, 2), ("d", 0.1, 3)], {"a": 100_000, "b": 1_000, "c": 50_000})
    assert all(s <= b * r for s, b, r in zip(p.slots, p.blocks, p.repeats)) and p.slots[3] == 0


def test_mixture(spark):
    r = random.Random(8)
    docs = [(i, r.choice(["A-x ", "a_X", "a x"]) if i % 3 else "b", "word " * r.randint(1, 300)) for i in range(600)] + [(900, None, "x"), (901, "zz", "x"), (902, "b", None), (903, "b", "")]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string").withColumn("part", F.lit("clash"))
    targets = spark.createDataFrame([("a_x", 0.4, 1), ("b", 0.6, 3), ("c", 0.0, 1)], "source string, target_share double, max_repeats int")
    mix, shares = mixture.mixture(df, targets, block=64, shard_slots=50)
    got = {x["source"]: x for x in shares.collect()}
    assert abs(got["a_x"]["reached_share"] - 0.4) < 0.01 and got["c"]["mixed_tokens"] == 0
    used = mix.select("source", "doc_id", "pass_no", "slot", "shard", F.explode(F.sequence("from_token", F.col("from_token") + F.size("ids") - 1)).alias("t"))
    most = {x["source"]: x["m"] for x in used.groupBy("source", "doc_id", "t").count().groupBy("source").agg(F.max("count").alias("m")).collect()}
    assert most["a_x"] <= 1 and most["b"] <= 3
    ids = {x["doc_id"]: x["ids"] for x in tokens.encode(df).collect()}
    for x in mix.limit(200).collect():
        assert ids[x["doc_id"]][x["from_token"] : x["from_token"] + len(x["ids"])] == x["ids"]
    assert mixture.mixture(df.limit(0), targets)[0].count() == 0
    assert {x["reached_share"] for x in mixture.mixture(df.limit(0), targets)[1].collect()} == {0.0}


# 10: subjects


def test_subjects(spark):
    docs = [
        (1, "The molecule moves the laboratory. The enzyme opens the planet. The lamp covers the box. The chair opens."),
        (2, "法官改善证人。法院打开合同。守门员打开球场。比赛改变奖牌。"),
        (3, "The lamp opens the window. The chair covers the street."),
        (4, None),
        (5, " ..."),
        (6, "The court opens the lawsuit. The court covers the judge. The court moves."),
        (7, "A magnetic field opens. The lamp. The box opens the chair. The street covers the lamp. The lamp covers the street. The chair opens."),
    ]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("subjects", F.lit("clash"))
    labels = spark.createDataFrame([(1, " Science", "a"), (1, "science", "b"), (99, None, "c")], "doc_id bigint, subject string, annotator string")
    assert rows(subjects.classify(df, labels)) == sorted([(1, "science"), (2, "law"), (2, "sport"), (3, "general"), (6, "law"), (7, "general")], key=str)
    assert subjects.classify(df.limit(0), None).count() == 0


def test_subjects_of_texts_that_are_not_of_the_tables(spark):
    texts = {
        "science": "Mitochondria release energy inside every living cell. Two up quarks and a down quark form a proton. Photosynthesis turns light into sugar.",
        "software": "Kubernetes restarts the container image when a probe fails. The borrow checker rejects this code. We opened a pull request in the repository.",
        "medicine": "The hospital treated the infection with antibiotics. Her blood pressure fell overnight. An x-ray showed the fracture.",
        "finance": "The central bank fears inflation. Investors sold their portfolios. The loans were repaid before the bankruptcy.",
        "sport": "Der Torwart hielt den Elfmeter. Die Meisterschaft endet im Mai. Der Schiedsrichter pfiff ab.",
        "music": "El compositor escribió una sonata para piano. La soprano cantó en la ópera. El cuarteto de cuerda ensaya.",
        "farming": "L'agriculteur sème le blé en automne. Le bétail est au pâturage. La sécheresse menace les semis.",
        "law": "被告在法庭上提出证词。检察官要求徒刑。最高法院驳回了禁令。",
        "travel": "搭乗券とスーツケースを持って空港へ行く。観光の後、ホステルに泊まる。",
        "cooking": "Whisk the egg yolks with sugar and vanilla. Let the soup simmer with garlic. Add a tablespoon of vinegar.",
        "general": "My grandmother keeps her umbrella by the door. The children slept late. We talked about the weather.",
    }
    df = spark.createDataFrame(list(enumerate(texts.values())), "doc_id bigint, text string")
    got = dict(rows(subjects.classify(df, None)))
    assert [got[i] for i in range(len(texts))] == list(texts)


def test_thresholds_by_subject(spark):
    scored = spark.createDataFrame([(i, ["law", "sport"], [0.2 + 0.001 * (i % 60), 0.3]) for i in range(100)], "doc_id bigint, subjects array<string>, parts array<double>")
    marks = spark.createDataFrame([(i, s, "a") for i in range(0, 100) for s in (["law"] if i % 60 >= 25 else []) + ["sport "]], "doc_id bigint, subject string, annotator string")
    cuts = subjects.calibrate(scored, marks)
    assert cuts["sport"] == subjects.QUARTER and abs(cuts["law"] - 0.225) < 1e-9


def test_queries_are_registered():
    names = queries.queries()
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 6, 7, 10)} | {"p8_ids", "p9_mix", "p9_shares"} <= set(names)
