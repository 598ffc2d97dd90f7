import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagloom.llm import pseudonyms, sharding, templates, toxicity, winnow


def fill(shards, size):
    h = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:15], 16)
    order = [[(h(s + "/offset") % size + j * (h(s + "/skip") % (size - 1) + 1)) % size for j in range(size)] for s in shards]
    owner, at, turn, left = [None] * size, [0] * len(shards), 0, size
    while left:
        slot = order[turn][at[turn]]
        at[turn] += 1
        if owner[slot] is None:
            owner[slot], left = shards[turn], left - 1
            turn = (turn + 1) % len(shards)
    return owner


def test_table_is_filled_in_turns(spark, odd, none):
    shards = ("a", "b", "c", "d")
    table = sharding.lookup_table(spark, shards, 31)
    got = [r.shard for r in table.orderBy("slot").collect()]
    assert got == fill(shards, 31)
    assert max(got.count(s) for s in shards) - min(got.count(s) for s in shards) <= 1
    placed = sharding.place(odd, "doc_id", table, 31)
    assert placed.count() == odd.count() and placed.where("shard IS NULL").count() == 0
    assert sharding.place(none, "doc_id", table, 31).count() == 0
    with pytest.raises(ValueError):
        sharding.lookup_table(spark, shards, 30)


def brute_winnow(text, k, w):
    p = winnow.code_points(text)
    h = winnow.gram_hashes(p, k) if len(p) else []
    out = set()
    for a in range(max(1, len(h) - w + 1) if len(h) else 0):
        win = list(h[a : a + w])
        out.add((a + max(i for i, x in enumerate(win) if x == min(win)), int(min(win))))
    return sorted(out)


@pytest.mark.parametrize("piece", [winnow.PIECE, 50])
def test_winnowing(monkeypatch, piece):
    monkeypatch.setattr(winnow, "PIECE", piece)
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 10, 47, 300):
        text = "".join(rng.choice(list("abé🤗"), n)) if n else ""
        for k, w in ((1, 1), (4, 3), (5, 8), (24, 24)):
            positions, hashes = winnow.selected(winnow.code_points(text), k, w)
            assert list(zip(positions.tolist(), hashes.tolist(), strict=True)) == brute_winnow(text, k, w)
    a, b = "x" * 40 + "the shared passage of forty-seven code points, or so" + "y" * 40, "the shared passage of forty-seven code points, or so"
    assert set(winnow.selected(winnow.code_points(a))[1].tolist()) & set(winnow.selected(winnow.code_points(b))[1].tolist())


def brute_edits(docs):
    """The rows of edit_pairs() for texts in order."""
    out = []
    for k, (i, t) in enumerate(docs):
        following, half = docs[(k + 1) % len(docs)][1], len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        own, new, after = (brute_winnow(x, winnow.K, winnow.WINDOW) for x in (t, edited, following))
        near = lambda a, b: 1.0 if not a and not b else len({h for _, h in a} & {h for _, h in b}) / len({h for _, h in [*a, *b]})
        hexed = lambda x: "".join(f"{h:08x}" for _, h in x)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), hexed(own), hexed(new), near(own, new), near(own, after), [p for p, _ in own], [p for p, _ in new]))
    return out


def test_edit_pairs_equal_brute_force(spark, none):
    rng = np.random.default_rng(1)
    docs = [(i, "".join(rng.choice(list("ab cé🤗"), int(n)))) for i, n in enumerate(rng.integers(0, 200, 60))] + [(60, ""), (61, ""), (62, "x")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(tuple(r) for r in winnow.edit_pairs(frame).collect()) == brute_edits(docs)
    assert winnow.edit_pairs(none).count() == 0


def test_edit_pairs_of_one_id(spark, odd):
    """Rows of one id (and those without one) follow each other in some order, and none is lost or gathered in one range."""
    texts = [f"text number {k}" for k in range(400)]
    frame = spark.createDataFrame([(7, t) for t in texts] + [(9, "the last")], "doc_id long, text string")
    got = winnow.edit_pairs(frame).collect()
    halves = {hashlib.sha256((a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode()).hexdigest() for a in texts for b in [*texts[:1], "the last"]}
    assert len(got) == 401 and sum(r.edited_sha256 in halves for r in got) >= 400
    assert winnow.in_ranges(frame).where("own").groupBy("part").count().count() > 4
    got = winnow.edit_pairs(odd).collect()
    assert len(got) == odd.count() and winnow.fingerprints(odd).where("doc_id = 3").count() == 0


def test_automaton_accepts_exactly_one_error():
    m = toxicity.Matcher({"trash": 1.0, "bad": 1.0}, {"vequ": 1.0}, frozenset({"crash"}))
    kinds = {w: m.match(w)[0] for w in ("trash", "trsh", "traash", "trasx", "xrash", "txxsh", "crash", "bad", "bed", "vequar", "veq", "trashy", "tra", "rash")}
    assert kinds == {
        "trash": toxicity.EXACT, "trsh": toxicity.NEAR, "traash": toxicity.NEAR, "trasx": toxicity.NEAR, "xrash": toxicity.NEAR, "txxsh": toxicity.OUT, "crash": toxicity.OUT,
        "bad": toxicity.EXACT, "bed": toxicity.OUT, "vequar": toxicity.START, "veq": toxicity.OUT, "trashy": toxicity.NEAR, "tra": toxicity.OUT, "rash": toxicity.NEAR,
    }


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:]


def test_automaton_equals_edit_distance():
    rng = np.random.default_rng(0)
    lexicon = {"".join(rng.choice(list("abc"), 6)) for _ in range(12)}
    m = toxicity.Matcher(dict.fromkeys(lexicon, 1.0), {})
    for _ in range(2000):
        w = "".join(rng.choice(list("abc"), rng.integers(4, 9)))
        assert bool(m.match(w)[0]) == any(near(w, t) for t in lexicon)


def test_quotation_weighs_less_than_abuse():
    s = toxicity.Scorer(toxicity.Matcher({"idiot": 2.0}, {}))
    plain, quoted, aimed = (s.evidence(t)[0] for t in ("what an idiot this is", 'the word "idiot" has a long past', "you are an idiot really"))
    assert quoted < plain < aimed and s.evidence("")[0] == 0 and s.evidence("the 1d!ot here")[0] > 0
    assert s.evidence("*" * 60 + "1d!ot" + "*" * 60)[0] > 0  # whatever its length


def test_toxicity_learns(spark, odd, none):
    docs = [(i, ("you moron and fool " if i % 5 == 0 else "kind words ") + f"number{i} text") for i in range(400)] + [(1000, None), (1001, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(400)] + [(None, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(frame, labels).collect()}
    assert all(got[i].predicted == (i % 5 == 0) for i in range(400)) and got[1000].score == got[1001].score < 0.5
    assert toxicity.toxicity(odd, labels.limit(0)).count() == odd.count()
    assert toxicity.toxicity(none, labels).count() == 0
    model = toxicity.fit(frame, labels)
    twice = toxicity.fit(frame.union(frame), labels.union(labels.selectExpr("doc_id", "quality", "0")))
    assert (twice.words, twice.weights) == (model.words, model.weights)  # a document counts once, and is toxic if any label says so
    assert toxicity.without_toxic(odd, model).columns == odd.columns and toxicity.without_toxic(odd, model).count() == odd.count()


KEY = b"key of the tests"


def test_held_out_documents_are_told_apart(spark):
    """Quality on the held-out fifth of the labelled documents of sf0.01."""
    from lagloom.llm import queries

    path = "/root/testdata/sf0.01"
    got = queries.op3_toxicity(spark, path).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").where("held_out").collect()
    bad, good = ([r.score for r in got if r.toxic == y] for y in (1, 0))
    auc = sum((a > b) + 0.5 * (a == b) for a in bad for b in good) / (len(bad) * len(good))
    assert auc >= 0.75 and sum(s >= 0.5 for s in good) <= 0.02 * len(good)


def test_feistel_is_a_permutation():
    f = pseudonyms.Feistel(b"k")
    for n in (1, 2, 10, 97, 256):
        image = [f.permute(x, n) for x in range(n)]
        assert sorted(image) == list(range(n)) and [f.permute(y, n, forth=False) for y in image] == list(range(n))


def test_pseudonyms():
    text = (
        "card 4539 5787 6362 1486, bad card 4539578763621487, mail é.x9@example.com, call +1 (017) 555-7713 on 2021-03-04, 12/31/1999 or 30.02.2020, "
        'ip 97.51.17.173 not 97.51.17.373, v2.0.1, ssn 123-45-6789 not 000-12-3456, token "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", GB82 WEST 1234 5698 7654 32.'
    )
    new, found = pseudonyms.Pseudonymizer(KEY).text(text)
    assert found == {"card": 1, "email": 1, "phone": 1, "date": 2, "ip": 1, "ssn": 1, "secret": 1, "iban": 1}
    for kept in ("4539578763621487", "30.02.2020", "97.51.17.373", "v2.0.1", "000-12-3456", "@example.com"):
        assert kept in new
    for gone in ("4539 5787 6362 1486", "555-7713", "2021-03-04", "97.51.17.173", "123-45-6789", "24be64439e3e"):
        assert gone not in new
    assert len(new) - len(text) == len(new.split("ip ")[1].split(" ")[0]) - len("97.51.17.173")
    assert pseudonyms.Pseudonymizer(KEY, forth=False).text(new)[0] == text
    again, _ = pseudonyms.Pseudonymizer(KEY).text("again 4539-5787-6362-1486")
    assert again.replace("-", "")[6:] in new.replace(" ", "")  # one value, one pseudonym
    card = again[6:].replace("-", "")
    assert pseudonyms.luhn_digit(card[:-1]) == card[-1]


def test_pseudonymize_tables(spark, odd, none):
    rows = pseudonyms.pseudonymize(odd, KEY).collect()
    assert len(rows) == odd.count() and sum(r.n_found for r in rows) == 2
    assert [r.pseudonyms for r in rows if r.doc.text is None] == [None]
    assert pseudonyms.pseudonymize(none, KEY).count() == 0


def test_one_value_has_one_pseudonym_in_all_layouts():
    p, back = pseudonyms.Pseudonymizer(KEY), pseudonyms.Pseudonymizer(KEY, forth=False)
    only = lambda s: "".join(c for c in s if c.isdigit())
    for layouts in (("+44 20 7946 0958", "+442079460958", "+44-20-7946-0958", "+44 (0)20 7946 0958"), ("+1 202 555 0142", "+12025550142"), ("+353 1 234 5678", "+35312345678")):
        new = [p.text(x)[0] for x in layouts]
        assert len({only(x.replace("(0)", "")) for x in new}) == 1 and [back.text(x)[0] for x in new] == list(layouts)
        assert all(n != x and [c.isdigit() for c in n] == [c.isdigit() for c in x] for n, x in zip(new, layouts))
    assert only(p.text("3782 822463 10005")[0]) == p.text("378282246310005")[0] != "378282246310005"
    dates = ("2020-01-02", "1/2/2020", "01/02/2020", "2.1.2020", "2 January 2020", "January 2, 2020", "2 Jan 2020")
    new = [p.text(x)[0] for x in dates]
    day = pseudonyms.date.fromisoformat(new[0])
    assert new[1:4] == [f"{day.month}/{day.day}/{day.year}", f"{day.month:02d}/{day.day:02d}/{day.year}", f"{day.day}.{day.month}.{day.year}"]
    assert new[4] == f"{day.day} {pseudonyms.MONTHS[day.month - 1]} {day.year}" and [back.text(x)[0] for x in new[:6]] == list(dates[:6])
    six = [p.text(x)[0] for x in ("2001:db8::8a2e:370:7334", "2001:0db8:0000:0000:0000:8a2e:0370:7334")]
    assert six[0] == six[1] and back.text(six[0])[0] == "2001:db8:0:0:0:8a2e:370:7334"
    for kept in ("at 12:30:45 and a::b or std::vector", "31/12/2020", "30 February 2020", "+0 123 456 789"):
        assert p.text(kept) == (kept, {})


def test_pseudonyms_of_all_documents_can_be_put_back(spark, sf_dir):
    """The query's whole result: only values that it counts have changed, each one to one, and the key gives all texts back."""
    from lagloom.llm import queries

    texts = {r.doc_id: r.text for r in queries.documents(spark, sf_dir).collect()}
    rows = queries.op9_feistel_pseudonyms(spark, sf_dir).collect()
    back = pseudonyms.Pseudonymizer(queries.DEMONSTRATION_KEY.encode(), forth=False)
    names, values = {}, 0
    for r in rows:
        old, new = (list(pseudonyms.PATTERN.finditer(t)) for t in (texts[r.doc_id], r.text))
        assert back.text(r.text)[0] == texts[r.doc_id] and r.n_found <= len(old) == len(new)
        assert pseudonyms.PATTERN.sub("#", texts[r.doc_id]) == pseudonyms.PATTERN.sub("#", r.text)
        changed = [(a[0], b[0]) for a, b in zip(old, new) if a[0] != b[0]]
        values += r.n_found
        for a, b in changed:
            assert names.setdefault(a, b) == b
        assert len(changed) <= r.n_found
    assert len(rows) == len(texts) and values > 10 and len(set(names.values())) == len(names)


ITEMS = [
    (1, "Alice Brown has 12 apples and gives Bob Smith 5 kg of them before noon, so how many apples remain in the basket?"),
    (2, "the quick brown fox jumps over the lazy dog while seven small birds sing in the old tree"),
    (3, None),
    (4, ""),
    (5, "too short"),
]


def test_reparameterised_items_are_found(spark, odd, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    again = ITEMS[0][1].replace("12", "31").replace("5 kg", "7 lb").replace("Alice Brown", "Clara White").replace("Bob Smith", "David Black")
    docs = [
        (1, "Before. " + again + " After it comes more."),
        (2, "Intro text here\n" + ITEMS[1][1].upper() + "\nand an end"),
        (3, "clean words about a brown fox that jumps over nothing at all"),
        (4, None),
        (5, ""),
        (6, "a text that is too short"),
    ]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in templates.leaks(frame, items).collect()}
    assert set(got) == {(1, 1), (2, 2), (6, 5)} and got[2, 2].coverage == 1.0
    small = {(r.doc_id, r.item_id) for r in templates.leaks(frame, items, bits=1 << 15).collect()}
    assert small == set(got)
    assert sorted(r.doc_id for r in templates.without_leaks(frame, items).collect()) == [3, 4, 5]
    assert templates.leaks(frame, items.limit(0)).count() == 0 and templates.leaks(none, items).count() == 0
    assert templates.without_leaks(odd, items).columns == odd.columns and templates.without_leaks(odd, items).count() == odd.count()


def test_inconsistent_slots_do_not_count(spark):
    items = spark.createDataFrame([(1, "take 3 apples then add 3 pears then add 3 plums then eat 3 of all these then stop 3 times")], "item_id long, text string")
    same = "take 4 apples then add 4 pears then add 4 plums then eat 4 of all these then stop 4 times"
    mixed = "take 4 apples then add 5 pears then add 6 plums then eat 7 of all these then stop 8 times"
    frame = spark.createDataFrame([(1, same), (2, mixed)], "doc_id long, text string")
    assert [r.doc_id for r in templates.leaks(frame, items).collect()] == [1]


def test_one_value_does_not_stand_for_several(spark):
    item = "Alice has 12 apples and gives 5 apples to Bob. Alice then buys 7 apples at the market in Paris and asks Bob how many of them are left."
    fair = item.replace("Alice", "Emma").replace("Bob", "Tom").replace("12", "31").replace("5", "8").replace("7", "9").replace("apples", "pears")
    mixed = "Emma has 12 pears and gives 12 plums to Tom. Emma then buys 12 pears at the market in Lyon and asks Zoe how many of them are left."
    frame = spark.createDataFrame([(1, fair), (2, mixed)], "doc_id long, text string")
    assert [r.doc_id for r in templates.leaks(frame, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()] == [1]


ITEM = "the baker sold 24 loaves of bread before noon and then baked 36 more while his helper carried 12 sacks of flour up from the cellar below"


def test_each_occurrence_counts_by_itself(spark):
    other = lambda a, b, c: ITEM.replace("24", a).replace("36", b).replace("12", c)
    inserted = other("5", "8", "9").replace("more while", "more of the dark kind while")
    docs = [
        (1, f"{ITEM} and so on . {other('7', '9', '11')}"),
        (2, " ".join(other(str(k), str(k + 3), str(k + 5)) for k in range(40, 46))),
        (3, f"some words come first and then {inserted} next {other('70', '90', '110')} and last {other('1', '3', '4')}"),
        (4, " ".join("the baker sold 1 loaves of bread before" for _ in range(3))),
    ]
    frame, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    got = {r.doc_id: r for r in templates.leaks(frame, items).collect()}
    assert set(got) == {1, 2, 3} and got[1].agreement == got[2].agreement == 1.0


def brute_leaks(docs, items, size=templates.WINDOW):
    """Items leaked into documents, by comparing every window of one with every window of the other."""
    from collections import Counter, defaultdict

    reader = templates.Reader()

    def shown(text, size):
        tokens = reader.read([text or ""])
        w = min(size, len(tokens.codes))
        at, h, typed = tokens.windows(w) if w else ((), (), ())
        return [(int(p), int(x), bool(y), tokens.slots(int(p), w)) for p, x, y in zip(at, h, typed)], w, len(tokens.codes)

    def passes(item, met):
        at, stands = {p for p, _ in met}, defaultdict(Counter)
        for k, values in met:
            for a, b in zip(item[k][3], values):
                stands[a][b] += 1
        typed, all_typed = sum(item[k][2] for k in at), sum(x[2] for x in item)
        share = max(len(at) / len(item), typed / max(all_typed, len(item) / 2))
        best = {a: max(c, key=lambda b, c=c: (c[b], b)) for a, c in stands.items()}
        claims = Counter(best.values())
        total, agree = sum(sum(c.values()) for c in stands.values()), sum(c[best[a]] for a, c in stands.items() if claims[best[a]] == 1)
        return share >= templates.COVERAGE and (not total or agree / total >= templates.AGREEMENT)

    out = set()
    for i, text in docs:
        for j, item_text in items:
            item, w, length = shown(item_text, size)
            if not item:
                continue
            doc, _, _ = shown(text, w)
            spots, half = defaultdict(list), max(length // 2, 1)
            for k, (p, h, _, _) in enumerate(item):
                for q, g, _, values in doc:
                    if g == h:
                        for spot in ((1, q - p), (2, (q - p) // half), (2, (q - p) // half - 1)):
                            spots[spot].append((k, values))
                        if (k, values) not in spots[0]:
                            spots[0].append((k, values))
            if any(passes(item, met) for met in spots.values() if met):
                out.add((i, j))
    return out


GIVEN = "{0} has {1} {2} and gives {3} {2} to {4}. {0} then buys {5} {2} at the market in {6} and asks {4} how many of them are left."
FILLS = [
    ("Alice", "12", "apples", "5", "Bob", "7", "Paris"),
    ("Emma", "thirty", "pears", "five", "Tom", "nine", "Lyon"),
    ("Mary Smith", "1,250", "stamps", "17", "Bob-Ray", "twenty-one", "New York"),
    ("Jean O'Neil", "two hundred", "marbles", "$4", "Ann", "3.5", "Rome"),
]


def test_leaks_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    items = [(k, x) for k, x in ITEMS] + [(10, GIVEN.format(*FILLS[0])), (11, ITEM), (12, "3 4 5 6 7 8 9 10 11 12 13"), (10, "another text of the same id with some more words in it")]
    words = "the of and apples baker sold 24 loaves Bob has bread before noon then 36 more Alice five gives to quick brown fox".split()
    docs = [(k, " ".join(rng.choice(words, int(rng.integers(0, 60))))) for k in range(40)]
    docs += [(100 + k, "Some text first. " + GIVEN.format(*f) + " And an end.") for k, f in enumerate(FILLS)]
    docs += [(200, "it says 3 4 5 6 7 8 9 10 11 12 13 there"), (201, "it says 14 15 16 17 18 19 20 21 22 23 24 there"), (202, ITEM), (203, "or another text of the same id with some more words in it")]
    got = templates.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = brute_leaks(docs, items)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    assert want >= {(100, 10), (101, 10), (102, 10), (103, 10), (200, 12), (202, 11), (203, 10)} and (201, 12) not in want


def test_recall_on_reparameterised_items(spark):
    """Nine of ten items with all names, numbers and nouns changed are found, and no other text."""
    rng = np.random.default_rng(4)
    pick = lambda x: x[int(rng.integers(len(x)))]
    frames = [GIVEN, "A train leaves {6} at {1} and {0} waits {3} {2} for it, while {4} walks {5} {2} to the next station beside the river.", "If {0} reads {1} {2} in {3} days and {4} reads {5} {2} in the same time, who of the two in {6} has read more of them?"]
    fill = lambda: (pick(["Alice", "Mary Smith", "Tom", "Bob-Ray"]), str(rng.integers(2, 99)), pick(["apples", "pages", "coins"]), pick(["three", "14", "nineteen"]), pick(["Eva", "Jean Paul", "Carl"]), str(rng.integers(2, 99)), pick(["Rome", "New York", "Lyon"]))
    items = [(k, f.format(*fill())) for k, f in enumerate(frames)]
    docs = [(k, "Some words before it. " + frames[k % 3].format(*fill()) + " Then more words follow here.") for k in range(60)]
    docs += [(100 + k, " ".join(rng.permutation(docs[k][1].split()))) for k in range(60)]
    got = {(r.doc_id, r.item_id) for r in templates.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len({(k, k % 3) for k in range(60)} & got) >= 54 and not [d for d, _ in got if d >= 100]


def test_rows_of_one_id_are_not_mixed(spark):
    items, half = spark.createDataFrame([(1, ITEM)], "item_id long, text string"), ITEM.split()
    for i in (None, 7):
        docs = [(i, " ".join(half[:10])), (i, " ".join(half[16:])), (i, "an innocent text"), (i, ITEM), (i, ITEM)]
        frame = spark.createDataFrame(docs, "doc_id long, text string")
        assert sorted(r.text for r in templates.without_leaks(frame, items).collect()) == sorted(t for _, t in docs[:3])
        assert templates.leaks(frame, items).count() == 1


def test_queries_are_registered():
    from lagloom.llm import queries

    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{n}" for n in range(1, 11)]
    assert F is not None
