import collections
import random
import re

import pyarrow as pa
import pytest

from quern.llm import abuse, bpe, cutoff, langid, liststuff, lookalike, neardup, packing, pageframe, sitelines

RAW = "id string, url string, title string, description string, body_text string, language string, site string, line int"  # site and line clash with inner names


def raw(spark, rows):
    base = {"id": None, "url": "https://www.Site.example:443/x", "title": None, "description": None, "body_text": None, "language": None, "site": "other", "line": 7}
    return spark.createDataFrame([tuple((base | r)[c.split(" ")[0]] for c in RAW.split(", ")) for r in rows], RAW)


def rows(df):
    return sorted(map(tuple, df.collect()))


# ---- problem 8 and 9

@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.DEFAULT_VOCABULARY)
    t.encode_special_tokens = True
    return t


def test_automaton_equals_library(tokenizer):
    rng = random.Random(1)
    pieces = ["I'll", " don't", "'s", "  ", "\n\n", "\t", "word", "Größe", "мир", "日本", "👩‍💻", "123", "!?", "<|endoftext|>", " ", "é", "x" * 300, "'re're", "\r\n", "²"]
    texts = [None, "", " ", *("".join(rng.choices(pieces, k=rng.randint(1, 12))) for _ in range(400))]
    table = bpe.WordTable(bpe.DEFAULT_VOCABULARY)
    sizes, ids = table.encode(pa.array(texts))
    at = 0
    for t, n in zip(texts, sizes):
        got = ids[at : at + n].tolist()
        at += n
        assert got == tokenizer.encode(t or "", add_special_tokens=False).ids
        assert table.automaton.decode(got) == (t or "")


def test_encode_documents_null_empty_repeated(spark):
    d = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "hi", "c"), (3, "hi", "c")], "doc_id long, text string, ids string")
    r = rows(bpe.encode_documents(d))
    assert [(k, list(v)) for k, v in r][:2] == [(1, []), (2, [])] and len(r) == 4 and r[2] == r[3]
    assert bpe.encode_documents(d.limit(0)).count() == 0


def test_packing_is_whole_and_fits(spark):
    d = spark.createDataFrame([(i, "word " * (i * 7 % 90)) for i in range(300)] + [(900, None), (901, "word " * 1000)], "doc_id long, text string").repartition(5)
    r = packing.pack(d, [(1, 64), (2, 256), (3, None)], open_bins=4, fan_in=2).toPandas()
    sizes = {x.doc_id: x.n_tokens for x in bpe.count_tokens(d).collect()}
    for c, cap in ((1, 64), (2, 256)):
        x = r[r.capacity_id == c]
        assert x.groupby("container").n_tokens.sum().max() <= cap
        assert x.groupby("doc_id").n_tokens.sum().to_dict() == sizes
        pieces = x.groupby("doc_id").size()
        assert all((pieces[k] > 1) == (n > cap) for k, n in sizes.items())
        assert len(x.container.unique()) <= sum(sizes.values()) / cap * 1.3 + 1


# ---- problem 1

def test_repeated_lines_equal_brute_force(spark):
    rng = random.Random(2)
    lines = ["Notice One", "notice one!", "Share this", "12 | 3", "", "Only here {}"]
    data = [{"id": str(i), "body_text": "\n".join(rng.choice(lines).format(i) for _ in range(5)), "url": f"http://s{i % 2}.example/{i}"} for i in range(40)]
    data += [data[0], {"id": "n", "body_text": None}, {"id": "e", "body_text": ""}]
    count, all_rows = collections.defaultdict(set), set()
    for r in data:
        for n, line in enumerate((r["body_text"] or "").split("\n"), 1):
            key = (r.get("url"), "".join(c for c in line.lower() if c.isalpha()))
            key = (key[0] and key[0].split("/")[2], key[1])
            if key[1]:
                count[key].add(r["id"])
                all_rows.add((r["id"], n, key))
    assert rows(sitelines.found(raw(spark, data))) == sorted((i, n) for i, n, k in all_rows if len(count[k]) >= 8)
    assert sitelines.found(raw(spark, [])).count() == 0


def test_blocks_span_documents(spark):
    data = [{"id": str(i), "body_text": f"Alpha line\nBeta line\nown {chr(97 + i)}{chr(97 + i)}"} for i in range(9)]
    b = sitelines.blocks(sitelines.line_rows(raw(spark, data))).collect()
    assert [(x.n_lines, x.n_documents) for x in b] == [(2, 9)]


def test_long_blocks_are_whole(spark):
    def line(i):
        return f"Clause {chr(97 + i // 26)}{chr(97 + i % 26)} holds"

    notice = [line(i) for i in range(70)]
    data = [{"id": str(i), "body_text": "\n".join([f"own {chr(97 + i) * 3}", *notice[:70 if i < 10 else 40], f"end {chr(97 + i) * 3}"])} for i in range(20)]
    data += [{"id": f"p{i}", "body_text": "\n".join([*notice[5:8], f"last {chr(97 + i) * 4}"])} for i in range(9)]
    b = sitelines.blocks(sitelines.line_rows(raw(spark, data))).collect()
    assert sorted((x.n_lines, x.n_documents) for x in b) == [(3, 29), (40, 20), (70, 10)]
    assert all(len(x.lines) == x.n_lines for x in b)


# ---- problem 5

def test_canonical_text_cases():
    c = lookalike.canonical_text
    assert c("ｆｕｌｌ ﬁle so­ft no break é") == "full file soft no break é"
    assert c("раypal саse") == "paypal case"
    assert c("О нас, Пoмощь") == "О нас, Помощь"
    assert c("👩‍💻 a‍b café “q” – …") == "👩‍💻 ab café “q” – …"


def test_lookalike_found_and_canonical(spark):
    d = raw(spark, [{"id": "1", "title": "ｗide", "body_text": "plain"}, {"id": "2", "title": None, "body_text": "so­ft\nОсновной текст"}, {"id": "3", "title": "café", "body_text": "  "}, {"id": "2", "title": None, "body_text": "so­ft\nОсновной текст"}])
    assert rows(lookalike.found(d)) == [("1", "title"), ("2", "body_text")]
    r = {x.id: x for x in lookalike.canonical_records(d).collect()}
    assert len(r) == 3 and r["1"].title == "wide" and r["2"].body_text == "soft\nОсновной текст" and r["2"].title is None
    assert lookalike.found(raw(spark, [])).count() == 0


# ---- problem 6

def test_similarity_join_equals_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(60)]
    bases = [[rng.choice(vocab) for _ in range(rng.randint(3, 60))] for _ in range(12)]
    data = []
    for i in range(90):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        data.append({"id": f"{i:03d}", "title": w[0], "body_text": " ".join(w[1:])})
    data += [data[5], {"id": "n", "body_text": None, "title": "w1 w2 w3"}, {"id": "b", "body_text": "  ", "title": "w1 w2 w3"}, {"id": "s", "body_text": "x", "title": None}]
    sets = {}
    for r in data:
        if r["body_text"] and r["body_text"].strip():
            w = re.findall(r"\w+", f"{r['title'] or ''}\n{r['body_text']}".lower())
            sets[r["id"]] = set(zip(w, w[1:], w[2:]))
    ids = sorted(sets)
    want = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6]
    d = raw(spark, data)
    assert rows(neardup.found(d)) == want
    # hot shingles spread over blocks give the same
    members, pairs = neardup.similar_sets(neardup.record_texts(d), most=3)
    again = {tuple(sorted(p)) for p in pairs.select("a", "b").collect()}
    members, pairs = neardup.similar_sets(neardup.record_texts(d))
    assert again == {tuple(sorted(p)) for p in pairs.select("a", "b").collect()}
    assert neardup.found(raw(spark, [])).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 40)] + [(7, 9), (9, 8), (7, 7), (7, 9)]
    rng.shuffle(edges)
    got = dict(map(tuple, neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 100 for i in range(100, 161)}, **{500 + i: 500 for i in range(40)}, 7: 7, 8: 7, 9: 7}
    assert neardup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_of_a_chain(spark):
    words = [f"w{i}" for i in range(80)]
    d = raw(spark, [{"id": f"{i:02d}", "body_text": " ".join(words[i * 6 : i * 6 + 40])} for i in range(6)] + [{"id": "x", "body_text": "one two three four"}, {"id": "y", "body_text": "one two three four"}])
    r = {x.id: (x.copy_class, x.n_links, x.group_id) for x in neardup.groups(d).collect()}
    assert {r[f"{i:02d}"][2] for i in range(6)} == {"00"} and r["00"][1] == 1 and r["03"][1] == 2 and r["y"] == ("x", 0, "x")


# ---- problems 2, 3, 4, 7

SENTENCES = {"en": ["The old house stands near the river and nobody lives there.", "We found the answer in a small book about history."],
             "de": ["Das alte Haus steht am Fluss und niemand wohnt dort.", "Wir haben die Antwort in einem kleinen Buch gefunden."]}


def samples(spark):
    extra = {"en": ["There is no reason to wait for the others.", "Most people think that this is not true."], "de": ["Es gibt keinen Grund auf die anderen zu warten.", "Die meisten Leute denken, dass das nicht wahr ist."]}
    return spark.createDataFrame([(k, t) for k in SENTENCES for t in SENTENCES[k] + extra[k]], "language string, text string")


def test_related_languages_are_not_mixed_up(spark):
    """A doubtful sentence makes no second language; a body without a finished sentence has a language too."""
    en, de = SENTENCES["en"], SENTENCES["de"]
    d = raw(spark, [{"id": "1", "language": "en", "body_text": "\n".join([*en, "Hand in Hand.", *en]), "url": "https://a.example"}, {"id": "2", "language": None, "body_text": "niemand wohnt dort und das Haus", "url": "https://b.example"},
                    {"id": "3", "language": "en", "body_text": "\n".join([*en, *de]), "url": "https://c.example"}])
    r = sorted(map(tuple, langid.languages(d, samples(spark)).select("id", "line_no", "language").collect()))
    assert r == [("1", 0, "en"), ("2", 0, "de"), ("3", 1, "en"), ("3", 2, "en"), ("3", 3, "de"), ("3", 4, "de")]


def test_list_pages_with_words_that_sentences_use(spark):
    """Phrases that stand in sentences of two hosts, but far more often in lists, are no language."""
    own = "The {a} house stands near the {b} and nobody lives there. We found cheap shoes online for the {a} farm."
    data = [{"id": f"s{i}", "url": f"https://s{i}.example/", "body_text": own.format(a=f"old{chr(97 + i)}", b=f"hill{chr(97 + i)}")} for i in range(3)]
    data += [{"id": f"k{i}", "url": f"https://k{i}.example/", "body_text": "\n".join("cheap shoes online" for _ in range(20))} for i in range(6)]
    assert rows(liststuff.found(raw(spark, data))) == [(f"k{i}",) for i in range(6)]


def test_languages(spark):
    en, de = " ".join(SENTENCES["en"] * 2), " ".join(SENTENCES["de"] * 2)
    d = raw(spark, [{"id": "1", "language": "de-AT", "body_text": en}, {"id": "2", "language": "English", "body_text": en}, {"id": "3", "language": None, "body_text": de}, {"id": "4", "language": "en", "body_text": f"{en}\n\n{de}"}, {"id": "5", "body_text": None}, {"id": "6", "body_text": " "}])
    from pyspark.sql import functions as F

    d = d.withColumn("url", F.concat(F.lit("https://h"), "id", F.lit(".example/")))  # else the shared lines were frame
    assert rows(langid.found(d, samples(spark))) == [("1", 0, "en"), ("3", 0, "de"), ("4", 1, "en"), ("4", 3, "de")]


def test_list_pages_and_frame(spark):
    own = [f"The {a} house stands near the {b} and nobody lives there. We found the answer in a {a} book about {b}." for a, b in zip("old new red big sad shy odd dry".split(), "river lake hill road town farm mill pond".split())]
    data = [{"id": str(i), "url": f"https://h{i % 2}.example/{i}", "body_text": f"Home | News | Contact\n{t}\n© {2000 + i} Host Inc."} for i, t in enumerate(own)]
    data.append({"id": "spam", "url": "https://h0.example/s", "body_text": "\n".join(f"- zork{i} shop vark{i}" for i in range(20))})
    d = raw(spark, data)
    assert rows(liststuff.found(d)) == [("spam",)]
    assert rows(pageframe.found(d)) == sorted((str(i), n) for i in range(8) for n in (1, 3))
    assert {r.id: r.body_text for r in pageframe.main_text(d).collect()}["3"] == own[3]


@pytest.mark.parametrize("pages", [12, 240])
def test_keyword_pages_at_every_corpus_size(spark, pages):
    rng = random.Random(4)
    stock = "buy cheap free top shop sale best deal".split()

    def name():
        return "".join(rng.choice("ba ke li mo nu ra so ti".split()) for _ in range(4))

    data = []
    for i in range(pages):
        keywords = [name(), name()]
        items = [" ".join([rng.choice(stock), rng.choice(keywords), rng.choice(stock), rng.choice(stock)][: rng.choice([2, 3, 4])]) for _ in range(30)]
        body = [" / ".join(items), ", ".join(items) + ".", "\n".join(items), " ".join(f"{x.capitalize()} {keywords[0]} {rng.choice(stock)} {keywords[1]}." for x in items)][i % 4]
        data.append({"id": f"k{i}", "url": f"https://k{i % 7}.example/{i}", "body_text": body})
        own = f"The {rng.choice(stock)} house stands near the {name()} and nobody lives there. We found the answer in a small book about {name()}."
        data.append({"id": f"s{i}", "url": f"https://s{i % 7}.example/{i}", "body_text": own})
    assert rows(liststuff.found(raw(spark, data))) == sorted((f"k{i}",) for i in range(pages))


def test_copies_of_a_page_are_no_template(spark):
    rng = random.Random(5)

    def words(n):
        return " ".join("".join(rng.choice("ba ke li mo nu ra so ti".split()) for _ in range(3)) for _ in range(n)).capitalize() + "."

    data, want = [], []
    paragraphs = [words(25) for _ in range(5)]
    for i in range(24):  # a third of all rows are copies, each with a paragraph of its own instead of one of theirs
        own = [words(25) for _ in range(5)] if i % 3 else [*paragraphs[: i // 3 % 5], words(25), *paragraphs[i // 3 % 5 + 1 :]]
        data.append({"id": f"{i:02d}", "body_text": "\n".join(["Home | News | Contact", *own, "All rights reserved."])})
        want += [(f"{i:02d}", 1), (f"{i:02d}", 7)]
    d = raw(spark, data)
    assert rows(pageframe.frame_lines(d)) == want


def test_copies_keep_languages_and_endings(spark):
    en, de = " ".join(SENTENCES["en"] * 2), " ".join(SENTENCES["de"] * 2)
    d = raw(spark, [{"id": str(i), "language": "en", "body_text": f"{en}\n{de}"} for i in range(4)])
    assert rows(langid.found(d, samples(spark))) == sorted((str(i), n, k) for i in range(4) for n, k in ((1, "en"), (2, "de")))
    d = raw(spark, [{"id": str(i), "body_text": "All is well here. The house near the"} for i in range(4)])
    assert rows(cutoff.found(d)) == [(str(i), "body_text") for i in range(4)]


def test_hidden_limit_and_endings(spark):
    data = [{"id": str(i), "title": ("Some rather long headline number %d about things" % i)[:24] if i % 2 else "Short %d" % i, "description": "A finished sentence here. An unfinished one that", "body_text": "Complete text."} for i in range(40)]
    data += [{"id": "m", "title": "Marked...", "description": "All is well.", "body_text": "Debris at the e&am"}, {"id": "n"}]
    r = set(map(tuple, cutoff.found(raw(spark, data)).collect()))
    assert {(str(i), "title") for i in range(40) if i % 2} <= r and not {(str(i), "title") for i in range(0, 40, 2)} & r
    assert ("m", "title") in r and ("m", "body_text") in r and ("m", "description") not in r and not any(k == "n" for k, _ in r)


# ---- problem 10

def test_abuse_scores(spark):
    texts = ["You are a filthy 1d10t.", "You i d i o t.", "The dialog is idiot-proof.", 'Posts that call others "idiot" are removed.', None, "", "Immigrants are vermin and should be driven out of town.", "Vermin such as rats got into the store."]
    d = spark.createDataFrame([(i, t, None if i % 2 else "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    assert [r.doc_id for r in abuse.found(d).orderBy("doc_id").collect()] == [0, 1, 6]
    assert sum(r.n_documents for r in abuse.rates(d).collect()) == len(texts)


def test_weights_of_small_terms_add_up(spark):
    rng = random.Random(6)
    small = [*abuse.SEXUAL, *abuse.DEGRADING, *abuse.GROUPS, *abuse.EXPEL, *abuse.SHUT, *abuse.PERSON, *abuse.VIOLENCE, *abuse.ABSENCE, *abuse.WISH, *abuse.INTENT, *abuse.BODY]
    texts = ["Hot lonely wives and singles on webcam tonight, no strings", "There is no place for immigrants, they must be driven out of town once and for all"]
    texts += [" ".join(rng.choice(small).replace("_", " ") for _ in range(rng.randint(1, 4))) + rng.choice([".", " table. The lamp."]) for _ in range(200)]
    d = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.doc_id: (r.score, r.label) for r in abuse.scores(d).collect()}
    assert got[0][0] >= 1 and got[1][0] >= 1
    assert got == {i: abuse.text_score(t, {}) for i, t in enumerate(texts)}


UNSEEN = ["You are an idoit.", "You stupid morno", "What a bicth you are.", "You whroe.", "You absolute muppet", "I will stab you in your sleep.", "Come see my tits and pussy live", "Someone should slit your throat.", "Hot lonely wives, amateurs and singles on webcam cam tonight",
          "Shut up, I wish you had vanished tomorrow", "Du bist ein elender Hurensohn.", "Ты просто тварь, и все это знают.", "We will burn your house down.", "Refugees are parasites."]
HARMLESS = ["He broke his leg in two places.", "You can kill the process with one key.", "I will find you a chair.", "Her mother died last year, I hope you understand.", "Breast cancer patients need care.", "We should cut your costs by half.",
            "The rats of the city eat what people leave.", "The word idiot comes from Greek.", "Why did your aunt call?", "The train has a delay, malgré le retard.", "Sexual reproduction in ferns needs water."]


def test_unseen_sentences(spark):
    d = spark.createDataFrame([(i, t, "s") for i, t in enumerate(UNSEEN + HARMLESS)], "doc_id long, text string, source string")
    assert [r.doc_id for r in abuse.found(d).orderBy("doc_id").collect()] == list(range(len(UNSEEN)))


def test_frequent_neighbours_are_words(spark):
    rows_ = [(i, "You closers meet the loosers.", "s") for i in range(30)] + [(99, "You looser.", "s"), (100, "You loser.", "s")]
    d = spark.createDataFrame(rows_, "doc_id long, text string, source string")
    assert [r.doc_id for r in abuse.found(d).orderBy("doc_id").collect()] == [99, 100]


def test_possible_holds_for_all_that_is_near():
    from quern.plans.search_queries import osa_distance

    rng = random.Random(7)
    trie = abuse.lexicon()["trie"]
    terms = sorted(t for t in trie.terms if trie.edits(t))
    words = []
    for _ in range(600):
        w = list(rng.choice(terms))
        for _ in range(rng.randint(1, 2)):
            i = rng.randrange(len(w))
            w[i : i + 2] = rng.choice([[rng.choice("abcxyz")], w[i : i + 2][::-1], [*w[i : i + 2], "q"], w[i : i + 1]])
        words.append("".join(w))
    possible = trie.possible(words)
    for w, p in zip(words, possible):
        if len(w) >= 4 and any(osa_distance(w, t) <= trie.edits(t) for t in terms if abs(len(t) - len(w)) <= 2):
            assert p, w


def test_trie_equals_brute_force():
    from quern.plans.search_queries import osa_distance

    trie = abuse.Trie(["idiot", "bastard", "vermin", "fantasies"])
    for word in ("bastrad", "fanatsies", "bastar", "vermins", "idiof", "xbastard", "vrmni"):
        want = {t for t in trie.terms if osa_distance(word, t) <= trie.edits(t) and (word == t or trie.plausible(t, word))}
        assert {t for t, _ in trie.near(word)} == want
