import random

from sparkloom.llm import decontaminate as d

VOCABULARY = [a + b for a in "bcdfgklmnprst" for b in ("a", "en", "or", "ish", "um", "el", "ig", "ot")]


def sentence(rng, n):
    return (" ".join(rng.choice(VOCABULARY) for _ in range(n))).capitalize() + "."


def test_wand_finds_all_units_above_the_threshold():
    rng = random.Random(1)
    items = [(i, sentence(rng, rng.randrange(3, 120)) + " " + sentence(rng, rng.randrange(3, 20))) for i in range(120)]
    index = d.Index(items)
    for _ in range(200):
        terms = sorted(rng.sample(range(len(index.terms)), rng.randrange(1, 60)))
        for threshold in (0.1, 0.3, 0.5):
            sums = {}
            for t in terms:
                for u, x in zip(index.posted[t], index.weights[t]):
                    sums[u] = sums.get(u, 0) + x
            got = dict(index.retrieve(terms, threshold))
            assert set(got) == {u for u, x in sums.items() if x >= threshold - 1e-9}
            assert all(abs(got[u] - sums[u]) < 1e-9 for u in got)


def test_planted_leaks(spark):
    rng = random.Random(4)
    items = [(i, sentence(rng, rng.randrange(8, 90)) + "\n" + sentence(rng, rng.randrange(4, 12))) for i in range(60)]
    items += [(60, items[0][1]), (61, None), (62, "")]
    docs, truth = [], set()
    for i in range(150):
        text = [sentence(rng, rng.randrange(3, 30)) for _ in range(rng.randrange(1, 40))]
        if i % 5 == 0:
            k = rng.randrange(1, 60)
            text.insert(rng.randrange(len(text) + 1), items[k][1].upper() if i % 10 else items[k][1].replace(".", " !"))
            truth.add((i, k))
        docs.append((i, " ".join(text), "x"))
    docs += [(500, None, "x"), (501, "", "x"), (None, items[0][1], "x"), docs[0]]
    found = d.leaks(spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    pairs = [(r.doc_id, r.item_id) for r in found]
    assert {p for p in pairs if p[0] is not None} == truth
    assert sorted(p[1] for p in pairs if p[0] is None) == [0, 60] and pairs.count(next(p for p in truth if p[0] == 0)) == 2
    several = d.leaks(spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(items, "item_id long, text string"), index_items=13).collect()
    assert sorted(map(str, ((r.doc_id, r.item_id) for r in several))) == sorted(map(str, pairs))


def test_empty(spark):
    docs, items = spark.createDataFrame([(1, "text")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert d.leaks(docs, items).count() == 0 and d.leaks(docs.limit(0), spark.createDataFrame([(1, "some item text")], "item_id long, text string")).count() == 0


def scores_by_brute_force(items):
    """Every unit's weights by the formula, over all items at once."""
    units = [(n, u.tolist()) for n, (_, text) in enumerate(items) for u in d.units_of(text)]
    total, mean = len(units), sum(len(u) for _, u in units) / len(units)
    frequency = {}
    for _, u in units:
        for w in set(u):
            frequency[w] = frequency.get(w, 0) + 1
    out = []
    for n, u in units:
        weights = {}
        for w in set(u):
            tf = u.count(w)
            idf = d.math.log(1 + (total - frequency[w] + 0.5) / (frequency[w] + 0.5))
            weights[w] = idf * tf * (d.K1 + 1) / (tf + d.K1 * (1 - d.B + d.B * len(u) / mean))
        own = sum(weights.values())
        out.append((n, {w: x / own for w, x in weights.items()}))
    return out


def brute(docs, items):
    """{(row, item number): (score, question share, answer share)}: every passage against every unit, without index or bounds."""
    units, found = scores_by_brute_force(items), {}
    for row, text in enumerate(docs):
        words = d.words_of(text or "")
        for s in range(0, max(1, len(words) - d.PASSAGE + d.STEP), d.STEP):
            passage = words[s : s + d.PASSAGE]
            held = set(passage.tolist())
            for n, weights in units:
                score = sum(x for w, x in weights.items() if w in held)
                if score < d.THRESHOLD - 1e-9 or found.get((row, n), (0,))[0] >= score - 1e-9:
                    continue
                question, answer = map(d.grams, d.question_and_answer(items[n][1]))
                reach = len(question) + len(answer) + 2 * d.NGRAM
                around = d.grams(words[max(0, s - reach) : s + d.PASSAGE + reach])
                q, a = len(question & around), len(answer & around)
                if q >= d.QUESTION * len(question) and (a >= d.ANSWER * len(answer) or not answer) or q + a >= d.TOGETHER * (len(question) + len(answer)):
                    found[row, n] = (score, q / max(1, len(question)), a / max(1, len(answer)))
    return found


def test_the_whole_query_against_brute_force_in_any_number_of_passes(spark):
    rng = random.Random(9)
    items = [(i, sentence(rng, rng.randrange(4, 130)) + " " + sentence(rng, rng.randrange(3, 14))) for i in range(40)]
    docs = []
    for i in range(60):
        text = [sentence(rng, rng.randrange(3, 30)) for _ in range(rng.randrange(1, 12))]
        for _ in range(i % 3):
            words = items[rng.randrange(40)][1].split()
            kept = [w for w in words if rng.random() > (i % 5) / 10]  # some are damaged beyond the thresholds
            text.insert(rng.randrange(len(text) + 1), " ".join(kept))
        docs.append(" ".join(text))
    want = brute(docs, items)
    assert 20 < len(want)
    frame, benchmark = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for passes in (1, 2, 8):
        got = {(r.doc_id, r.item_id): (r.score, r.question_share, r.answer_share) for r in d.leaks(frame, benchmark, index_items=-(-40 // passes)).collect()}
        assert set(got) == set(want)
        assert all(abs(x - y) < 1e-9 for k in want for x, y in zip(got[k], want[k]))
        left = {r.doc_id for r in d.cleaned(frame, benchmark, index_items=-(-40 // passes)).collect()}
        assert left == set(range(60)) - {row for row, _ in want}


def test_scores_do_not_depend_on_the_number_of_passes(spark):
    rng = random.Random(12)
    items = [(i, sentence(rng, 40) + " " + sentence(rng, 9)) for i in range(30)]
    docs = spark.createDataFrame([(i, sentence(rng, 20) + " " + items[i % 30][1]) for i in range(60)], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    one, two, eight = (sorted(map(tuple, d.leaks(docs, benchmark, index_items=n).collect())) for n in (30, 15, 4))
    assert len(one) >= 60 and one == two == eight


def test_a_very_long_text(spark):
    rng = random.Random(2)
    item = sentence(rng, 30) + " " + sentence(rng, 8)
    text = " ".join(rng.choice(VOCABULARY) for _ in range(400_000))
    docs = spark.createDataFrame([(1, text + " " + item + " " + text), (2, text)], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in d.leaks(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()] == [(1, 7)]


def test_what_is_not_retrieved_is_not_verified():
    """Half of an item's question and its answer, but of words that all items have: enough trigrams, too little weight."""
    common, rare = VOCABULARY[:12], [f"rare{i}" for i in range(11)]
    items = [(i, " ".join(common) + " " + " ".join(f"own{i}x{k}" for k in range(10)) + ". " + " ".join(common[:4]) + ".") for i in range(1, 60)]
    items.append((0, " ".join(common + rare[:10]) + ". " + " ".join(common[:4]) + "."))
    index, text = d.Index(items), " ".join(common) + ". " + " ".join(common[:4])
    words = d.words_of(text)
    assert index.verified(59, words) and index.search(words, d.np.array([0, len(words)])) == [{}]
    words = d.words_of(" ".join(common + rare[:10]) + ". " + " ".join(common[:4]))
    assert set(index.search(words, d.np.array([0, len(words)]))[0]) == {59}


def test_maxima_rule_out_nothing_that_reaches_the_threshold():
    rng = random.Random(8)
    items = [(i, sentence(rng, rng.randrange(1, 100)) + " " + sentence(rng, rng.randrange(1, 9))) for i in range(150)]
    index = d.Index(items)
    words = d.words_of(" ".join(sentence(rng, 20) + " " + " ".join(w for w in rng.choice(items)[1].split() if rng.random() < 0.7) for _ in range(120)))
    starts = d.np.arange(0, len(words), 13)
    ends = d.np.minimum(starts + d.PASSAGE, len(words))
    numbers = index.numbers(words)
    reaching = {p for p, (s, e) in enumerate(zip(starts, ends)) if index.retrieve(sorted(set(numbers[s:e][numbers[s:e] < len(index.terms)].tolist())))}
    found = {p for p, _ in index.candidates(numbers, starts, ends)}
    assert reaching and reaching <= found < set(range(len(starts)))
