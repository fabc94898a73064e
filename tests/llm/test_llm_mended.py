"""Rival licence templates, holdouts of copies, exception spans, and time that follows a text's length."""
import random
import time

import pytest

from tests.llm.helpers import documents, labels

from statuta.llm import license_scan, quality_rules, toxicity

IDF = {w: 1.0 for _, text, _ in license_scan.TEMPLATES for w in license_scan.words_of(text)}
INDEX = license_scan.build_index(IDF)
NEEDED = frozenset(INDEX["postings"]) | {license_scan.words_of(p)[0] for p in license_scan.BASE} | {
    k[0] for *_, keys in INDEX["entries"] for k in keys}


def scan(text):
    return license_scan.scan(text, INDEX, NEEDED)


@pytest.mark.parametrize("text, found", [
    ("Licensed under the GNU Affero General Public License version 3", "agpl-3.0,gpl"),
    ("Licensed under the GNU General Public License, version 3", "gpl,gpl-3.0"),
    ("licensed under the gnu general public license version 2", "gpl,gpl-2.0"),
    ("Licensed under the GNU Lesser General Public License version 3.", "gpl,lgpl-3.0"),
    ("Released under the MIT license", "mit"), ("the mit press has a license", ""), ("apache and license", ""),
    ("Licensed under CC BY 4.0", "cc-by,cc-by-4.0"),
])
def test_rival_templates(text, found):
    assert scan("some words before " + text + " and some after")[5] == found


def test_templates_are_found_whole_and_with_one_word_lost():
    rng = random.Random(2)
    for label, text, keys in license_scan.TEMPLATES:
        words = text.split()
        assert label in scan("x " * 40 + text + " y" * 40)[5].split(",")
        in_key = {w for k in keys for w in k.split()}
        loose = [i for i, w in enumerate(words) if w not in in_key]
        if len(words) > 14:
            i = rng.choice(loose)
            assert label in scan(" ".join(words[:i] + words[i + 1:]))[5].split(",")


def matches_plainly(folded, found):
    hits, spans = {}, []
    for end, (weight, size) in found.iter(folded):
        start = end - size + 1
        if weight is None:
            spans.append((start, end))
        elif weight > hits.get(start, 0.0):
            hits[start] = weight
    return {s: w for s, w in hits.items() if not any(a <= s < b for a, b in spans)}


def test_exception_spans_match_the_plain_reading():
    found = toxicity.automaton({"trash": 2.0, "idiot": 3.0, "tras*": 1.0},
                               [toxicity.fold_entry(p) for p in ("trash can", "can trash idiot", "idiot proof")])
    rng = random.Random(1)
    for _ in range(400):
        folded = toxicity.fold(" ".join(rng.choices(["trash", "can", "idiot", "proof", "x", "trashy"], k=rng.randint(0, 12))))
        assert toxicity.matches(folded, found) == matches_plainly(folded, found)


def grows_in_proportion(work, n):
    def seconds(k):
        start = time.process_time()
        work(k)
        return time.process_time() - start

    seconds(n // 4)
    return seconds(4 * n) <= 6 * max(seconds(n), 0.05)


def test_time_follows_the_length_of_a_text():
    assert grows_in_proportion(lambda n: scan("released under the mit x license " * n), 8_000)
    found = toxicity.automaton({"idiot": 3.0, "trash": 2.0}, ["trash can"])
    assert grows_in_proportion(lambda n: toxicity.matches(toxicity.fold("trash can idiot " * n), found), 20_000)

    class Lexicon:
        value = {"idiot": 3.0}

    import pandas as pd

    phrases = toxicity._explode_phrases(Lexicon)
    assert grows_in_proportion(lambda n: list(phrases([pd.DataFrame({"toxic": [1], "text": ["an idiot said so " * n]})])), 20_000)


def test_copies_do_not_widen_the_holdout(spark):
    """Each document many times with the same labels gives the cutoffs of the documents once."""
    rng = random.Random(7)
    rows, marks = [], []
    for i in range(720):
        bad = i % 4 == 0
        words = [("#" * 30 if bad and k % 2 else "word") + str(rng.randrange(10 ** 6)) for k in range(60)]
        rows.append((i, " ".join(words), "en", "s"))
        marks.append((i, int(not bad), 0))

    def cutoffs(some, these):
        features = quality_rules.count_features(documents(spark, some))
        return sorted(tuple(r) for r in quality_rules.calibrate(features, labels(spark, these), 0.05).collect())

    once = cutoffs(rows, marks)
    few, few_marks = rows[:24], marks[:24]
    assert cutoffs(few * 30, few_marks * 30) == []
    copies = [(1000 * k + i, t, la, s) for k in range(30) for i, t, la, s in few]
    assert cutoffs(copies, [(i, few_marks[i % 1000][1], 0) for i, *_ in copies]) == []
    assert once and cutoffs(rows * 2, marks * 2) == once
