import random
from itertools import combinations

import numpy as np
import pytest

from lumenloom.llm import harm
from lumenloom.llm.seeds import HARMFUL, HARMLESS


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(3)
    fine = ["The council approved page {} of the plan.", "See table {} for the floor area.", "The scan of page {} is tilted.", "A map of the harbour hangs in hall {}.", "The bitch of kennel {} had six pups.", "Kill process {} and start it again."]
    bad = ["You are a stupid {}.", "Shut your mouth, you filthy {}.", "I hope you die, {}.", "Only a {} like you could say that."]
    insult = ["moron", "idiot", "bastard", "imbecile", "asshole"]

    def document(harmful):
        lines = [r.choice(fine).format(r.randint(1, 99)) for _ in range(r.randint(2, 8))]
        if harmful:
            lines.insert(r.randrange(len(lines)), r.choice(bad).format(r.choice(insult)))
        return " ".join(lines)

    labels = [i % 5 == 0 for i in range(400)]
    return [document(y) for y in labels], labels


@pytest.fixture(scope="module")
def model(corpus):
    texts, labels = corpus
    return harm.train(texts[:250], labels[:250])


def test_held_out_accuracy(corpus, model):
    texts, labels = corpus
    found = np.array(model.score(texts[300:])) > 0
    truth = np.array(labels[300:])
    assert (found & truth).sum() / truth.sum() > 0.85
    assert (found & ~truth).sum() / (~truth).sum() < 0.05


def test_other_spellings(model):
    texts = ["Shut your mouth, you filthy mor0n.", "SHUT YOUR MOUTH, YOU FILTHY MORRRRRON.", "Shut your mouth, you filthy id*ot.", "Shut your mouth, you fil-\nthy idiot.", "Shut your mouth, you fіlthy idіot."]
    assert all(s > 0 for s in model.score(texts))


def test_folding_equals_the_kernel(corpus):
    lines = harm.lines_of(corpus[0][0]) + list(HARMFUL[:20])
    pool = harm.Features(lines)
    rows = np.arange(len(lines))
    weights = np.linspace(-1, 1, len(lines))
    direct = pool.kernel(rows) @ weights
    assert np.allclose(direct, harm.line_scores(lines, pool.fold(rows, weights)), atol=1e-3)


def test_kernel_is_the_gap_weighted_one():
    lines = ["you absolute fool", "y-o-u fo1ol", "abc", "abcd", "aXbXcXd", "completely different words"]
    pool = harm.Features(lines)
    codes, offsets = harm.characters(lines)

    def subsequences(i):
        own = codes[offsets[i] : offsets[i + 1]].tolist()
        found = {}
        for start in range(len(own)):
            for rest in combinations(range(start + 1, min(len(own), start + harm.SPAN)), harm.LENGTH - 1):
                key = (own[start], *(own[k] for k in rest))
                found[key] = found.get(key, 0.0) + harm.DECAY ** (rest[-1] - start + 1 - harm.LENGTH)
        return found

    scale = harm._lengths(offsets)
    every = [subsequences(i) for i in range(len(lines))]
    occurrences = {}
    for i in range(len(lines)):
        own = codes[offsets[i] : offsets[i + 1]].tolist()
        for start in range(len(own)):
            for rest in combinations(range(start + 1, min(len(own), start + harm.SPAN)), harm.LENGTH - 1):
                key = (own[start], *(own[k] for k in rest))
                occurrences[key] = occurrences.get(key, 0) + 1
    rarity = {k: min(1.0, max(0.1, np.log(len(lines) / n) / np.log(len(lines)))) for k, n in occurrences.items()}
    want = [[sum(v * b.get(k, 0.0) * rarity[k] ** 2 for k, v in a.items()) / scale[i] / scale[j] for j, b in enumerate(every)] for i, a in enumerate(every)]
    assert np.allclose(pool.kernel(np.arange(len(lines))), want, atol=1e-3)


def test_inserted_letters(model):
    assert all(s > 0 for s in model.score(["Shut your mouth, you f-i-l-t-h-y m o r o n.", "Shut your mouthh, you fillthy moroon."]))


def test_seeds_of_the_random_choices_agree(corpus):
    texts, labels = corpus
    found = [{i for i, s in enumerate(harm.train(texts[:250], labels[:250], seed).score(texts[250:])) if s > 0} for seed in (1, 2, 3)]
    assert all(len(a & found[0]) / len(a | found[0]) >= 0.95 for a in found[1:])


def test_lines_and_edge_cases(model):
    assert harm.lines_of("") == []
    assert harm.lines_of("One. Two! three?\nfour  five") == ["One.", "Two!", "three?", "four", "five"]
    long = "x y " * 200
    assert all(len(x) <= harm.LINE for x in harm.lines_of(long))
    low = model.score([None, "", " \n", "a"])
    assert low == [-9.0] * 4
    assert len(model.score(["word " * 15_000, "\u0000퟿" * 10])) == 2


def test_insult_at_the_end_of_a_long_text(model):
    text = "See table 5 for the floor area. " * 3_000 + "You are a stupid moron."
    assert model.score([text])[0] > 0


def test_training_without_labels():
    model = harm.train([], [])
    found = np.array(model.score([HARMFUL[0], HARMLESS[0]])) > 0
    assert found.tolist() == [True, False]


def test_corpus_queries(spark, corpus):
    texts, labels = corpus
    docs = spark.createDataFrame([(i, t, "s" if i % 2 else None, 1) for i, t in enumerate(texts)] + [(900, None, "s", 1), (901, "", "s", 1)], "doc_id bigint, text string, source string, score int")
    marks = spark.createDataFrame([(i, i, int(y)) for i, y in enumerate(labels[:250])] + [(1000, 0, 0), (1001, 3, None), (1002, None, 1)], "label_id bigint, doc_id bigint, harmful int")
    sample = harm.labelled_sample(docs, marks)
    assert sample.count() == 249  # document 0 has contradicting labels
    scored = harm.score_corpus(docs, harm.fit(docs, marks))
    assert scored.count() == docs.count()
    rates = {r.source: r for r in harm.rates(scored).collect()}
    assert rates[None].n_documents == 200 and rates["s"].n_documents == 202
    assert harm.score_corpus(docs.limit(0), harm.fit(docs.limit(0), marks.limit(0))).count() == 0


@pytest.fixture(scope="module")
def skewed():
    """Documents of which a twentieth holds the same abusive form, and the labels of a third of them, some wrong."""
    r = random.Random(8)
    fine = ["The {} plan of ward {} was approved.", "See table {1} for the {0} floor.", "A {} map hangs in hall {}.", "Note {1} names the {0} wing.", "Page {1} shows a {0} line."]
    word = lambda: "".join(r.choice("bdfglmnprst") + r.choice("aeiou") for _ in range(3))
    texts, labels = [], []
    for i in range(1500):
        lines = [r.choice(fine).format(word(), r.randint(1, 99)) for _ in range(r.randint(3, 7))]
        if i % 20 == 0:
            lines.insert(r.randrange(len(lines)), f"Shovelmouth lot {r.randint(1, 99)} ought to be scrubbed off our pavement.")
        texts.append(" ".join(lines))
        labels.append(i % 20 == 0 if i % 97 else i % 20 != 0)
    return texts, labels


def test_a_frequent_harmful_form_is_learned(skewed):
    texts, labels = skewed
    model = harm.train(texts[:500], labels[:500])
    found = np.array(model.score(texts[1000:])) > 0
    truth = np.arange(1000, 1500) % 20 == 0
    assert found[truth].all()
    assert found[~truth].mean() < 0.05


def test_lines_late_in_long_texts_are_learned(spark, skewed):
    filler = "See table 5 for the floor area. " * 700
    texts = [filler + t for t in skewed[0][:1000]] + skewed[0][1000:]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:1000])], "doc_id bigint, text string")
    marks = spark.createDataFrame([(i, int(y)) for i, y in enumerate(skewed[1][:500])], "doc_id bigint, harmful int")
    model = harm.fit(docs, marks)
    found = np.array(model.score(texts[1000:])) > 0
    truth = np.arange(1000, 1500) % 20 == 0
    assert found[truth].all()
    assert found[~truth].mean() < 0.05


def test_frequent_forms_with_a_few_harmful_labels_are_harmless():
    """Of harmful forms a sixth of the documents is labelled so; a hundred harmless forms have one to three such labels of many documents."""
    r = np.random.default_rng(4)
    everywhere = np.concatenate([r.integers(8, 40, 40), r.integers(100, 400, 60)]).astype(float)
    bad = np.concatenate([np.maximum(1, np.round(everywhere[:40] / 6)), r.integers(1, 4, 60)])
    told = harm._chance_forms(bad, everywhere, 300, 100_000)
    assert not told[:40].any() and told[40:].all()
    assert not harm._chance_forms(bad[:10], everywhere[:10], 300, 100_000).any()  # too few forms to tell


def test_forms_are_counted_in_all_texts(spark):
    texts = ["Unsure about the unit, kW seems right.", "All of KW seems right. The tree seems tall.", "kW seems right. kW seems right.", "He says kW seems right.", None, ""]
    counter = harm.FormCounter(["kW seems right.", "Page 5.", "Lot 7 of Oslo is a muddy hole."])
    assert set(counter.pieces) == {"kw seems right.", "lot 0 of n is a muddy hole."}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "Lot 81 of New York is a muddy hole."])], "doc_id bigint, text string")
    counts, n_texts = harm.form_counts(docs.repartition(3), counter)
    assert counts == {"kw seems right.": 2, "lot 0 of n is a muddy hole.": 1} and n_texts == 5
    assert harm.form_counts(docs.limit(0), counter)[1] == 0


def test_a_frequent_harmless_form_in_few_harmful_documents_is_not_found():
    r = random.Random(12)
    word = lambda: "".join(r.choice("bdfglmnprst") + r.choice("aeiou") for _ in range(3))
    harmless = [" ".join(["The", *(word() for _ in range(4)), "hall."]) for _ in range(40)]
    insults = [" ".join(["You", *(word() for _ in range(4)), "swine."]) for _ in range(40)]
    texts = [r.choice(insults) if i % 50 == 0 else r.choice(harmless) for i in range(20_000)]
    labelled = [(r.choice(insults), True) for _ in range(120)] + [(f"Page {i} of the plan.", False) for i in range(300)] + [(x, True) for x in harmless[:25] for _ in range(2)]
    counted = harm.train([t for t, _ in labelled], [y for _, y in labelled], 5, lambda counter: (counter.count(texts), len(texts)))
    assert np.mean(np.array(counted.score(harmless)) > 0) < 0.05
    assert np.mean(np.array(counted.score(insults)) > 0) > 0.9
