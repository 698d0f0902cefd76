"""Trained operators: brute-force scoring, held-out quality by form and length, bounded samples."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from wayfold.llm import common, language_id, toxicity

WORDS = ["".join(random.Random(n).choice("abcdefghijklmnop") for _ in range(6)) for n in range(400)]
BAD = ["worthless", "pathetic", "disgusting"]


def prose(rng, n, bad=()):
    """n ordinary words, with a word of ``bad`` for each 40 of them and one at least."""
    said = [rng.choice(WORDS) for _ in range(n)]
    for _ in range(max(1, n // 40) if bad else 0):
        said[rng.randrange(n)] = rng.choice(bad)
    return " ".join(said)


@pytest.fixture(scope="module")
def model():
    rng = random.Random(2)
    labels = [n % 2 for n in range(800)]
    return toxicity.fit([prose(rng, rng.choice((15, 60, 200)), BAD if y else ()) for y in labels], labels)


def brute_grams(word):
    """Buckets of a word's grams by plain Python arithmetic."""
    data, mask, prime = f"<{word}>".encode(), (1 << 64) - 1, 1099511628211
    keys = []
    for n in toxicity.GRAMS:
        for at in range(len(data) - n + 1):
            h = 0
            for c in data[at : at + n]:
                h = (h * prime + c + 1) & mask
            keys.append(h ^ n)
    keys.append(sum(c * pow(prime, at, 1 << 64) for at, c in enumerate(data)) & mask)
    return [(((k ^ k >> 31) * 11400714819323198485) & mask) >> 64 - toxicity.BITS for k in keys]


def brute_score(text, numbers, bias):
    bag = Counter(toxicity.words(text))
    total = sum(math.sqrt(n) * np.mean([float(numbers[b]) for b in brute_grams(w)]) for w, n in bag.items())
    return 1 / (1 + math.exp(-(bias + total / (sum(map(math.sqrt, bag.values())) + toxicity.NEUTRAL))))


def test_scores_are_the_brute_force_ones(model):
    rng = random.Random(3)
    scorer = toxicity.Scorer(*model)
    texts = ["", "...", "x", "Straße 漢字 worthless", "a " * 500, *(prose(rng, n, BAD) for n in (1, 5, 300))]
    assert all(abs(scorer.score(t) - brute_score(t, *model)) < 1e-4 for t in texts)
    small = toxicity.Scorer(*model, most=3)  # values forgotten all the time
    assert all(abs(scorer.score(t) - small.score(t)) < 1e-6 for t in texts)


@pytest.mark.parametrize("n", [15, 60, 200, 3000])
@pytest.mark.parametrize("bad", [BAD, ["worthles", "pathetc", "disgustng"], ["worthlessness", "pathetically", "disgustingly"], ["w0rthless", "pathettic", "disqusting"]])
def test_forms_and_lengths(model, n, bad):
    rng, scorer = random.Random(4), toxicity.Scorer(*model)
    clean = [scorer.score(prose(rng, n)) for _ in range(60)]
    toxic = [scorer.score(prose(rng, n, bad)) for _ in range(60)]
    assert np.mean([c < toxicity.TOXIC for c in clean]) >= 0.95
    assert np.mean([t > c for t in toxic for c in clean]) >= 0.97
    if bad is BAD:
        assert np.mean([t >= toxicity.TOXIC for t in toxic]) >= 0.9


def test_toxicity_frames_with_odd_rows(spark):
    rng = random.Random(5)
    rows = [(n, prose(rng, 40, BAD if n % 2 else ()), n % 2) for n in range(300)]
    docs = spark.createDataFrame([(i, t, "k", 0.5, True, "x") for i, t, _ in rows] + [(2, rows[2][1], "k", 0.5, True, "x")] * 50 + [(900, "pathetic " * 60_000, "k", 0.0, False, None)], "doc_id long, text string, key string, score double, held_out boolean, label string")
    labels = spark.createDataFrame([(i, y, "d") for i, _, y in rows] + [(2, 0, "d"), (None, 1, "d"), (900, None, None)], "doc_id long, toxic int, text string")
    got = toxicity.score_documents(docs, toxicity.train(docs, labels, sample=60)).collect()
    assert len(got) == len(rows) + 51 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 300]
    assert np.mean([r.predicted == r.doc_id % 2 for r in held]) > 0.9
    assert [r.predicted for r in got if r.doc_id == 900] == [1]


def test_samples_are_bounded_and_whole(spark):
    rows = [("a", n % 40, "x" * (n % 40 + 1)) for n in range(4000)] + [("b", 7, "y" * 9000), ("b", 8, None), ("c", None, "z")]
    frame = spark.createDataFrame(rows, "label string, key long, text string")
    sizes = {"a": 40, "b": 2}
    got = common.in_budget(frame.where(common.drawn(sizes, 10)), 10**9)
    own = [r.key for r in got if r.label == "a"]
    assert 0 < len(own) < 25 and len(set(own)) == len(own) and all(len(r.text) == r.key + 1 for r in got if r.label == "a")
    assert [len(r.text) for r in got if r.label == "b"] == [9000] and not [r for r in got if r.label == "c"]
    few = common.in_budget(frame.where(common.drawn(sizes, 100)), 100)
    assert [len(r.text) for r in few if r.label == "b"] == [9000]  # one at least, never a prefix
    sizes = [len(r.text) for r in few if r.label == "a"]
    assert sum(sizes) >= 100 > sum(sizes) - max(sizes)


def brute_language(model, text):
    letters = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    data = (" " + " ".join(letters) + " ").encode()
    count = Counter()
    for at in range(len(data) - 1):
        pair = (data[at] * 257 + data[at + 1]) & 0xFFFFFFFF
        count[(pair * 2654435761 & 0xFFFFFFFF) >> 19] += 1
        if at + 2 < len(data):
            count[((pair * 263 + data[at + 2] + 70001) * 2246822519 & 0xFFFFFFFF) >> 19] += 1
    vector = {b: math.log1p(n) * float(model.idf[b]) for b, n in count.items()}
    norm = math.sqrt(sum(v * v for v in vector.values()))
    return max((sum(v * float(c[b]) for b, v in vector.items()) / norm, model.languages[o]) for c, o in zip(model.centroids, model.owners, strict=True))


def test_languages_are_the_nearest_centroids():
    rng = random.Random(6)
    stems = {"en": "the of and that thing over".split(), "de": "der die und nicht schön über".split(), "fr": "le été où français très".split()}
    model = language_id.fit([(lang, " ".join(rng.choice(own) for _ in range(40))) for lang, own in stems.items() for _ in range(30)])
    texts = ["the", "É", "der, die; UND 12 nicht", *(" ".join(rng.choice(rng.choice(list(stems.values()))) for _ in range(n)) for n in (3, 50, 40_000))]
    for text in texts:
        lang, score, _ = model.predict(text)
        wanted, best = brute_language(model, text)
        assert abs(score - wanted) < 1e-4 and lang == best


def test_languages_learned_are_bounded(spark):
    rows = [(n, f"wort{n % 7} haus", f"junk{n}" if n % 2 else "de") for n in range(200)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), languages=3)
    assert len(model.languages) == 3 and "de" in model.languages
