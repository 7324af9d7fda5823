import re

from snapgraph.llm import licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    found = [(i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in found]
    return len(words), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({label for _, label in found}))


TEXTS = [
    "Released under the MIT License.",
    "under the mit license under the mit license",
    "Licensed under CC BY-NC 4.0. And the APACHE license, Version 2.0!",
    "É under\x7fthe_mit license",
    "nothing here",
    "",
    None,
    "xunder the mit license",
    "word " * 30_000 + "cc by nc",
]


def test_base_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(200)
    extra = spark.createDataFrame([(10_000 + i, t, 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words int")
    for df in (docs, extra):
        texts = {r.doc_id: r.text for r in df.collect()}
        for r in licenses.scan_documents(df).collect():
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
            assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
            assert 0 <= r.score <= 1 and (r.n_base == 0 or r.score == 1)


def test_edits_are_found():
    assert licenses.scan("under the mitt license")["labels"] == {"mit"}
    assert licenses.scan("undr the mit licence")["labels"] == {"mit"}
    got = licenses.scan("see the Apache Licence, Version 2")
    assert got["labels"] == {"apache-2"} and not got["base"] and 0.9 < got["score"] < 1
    assert got["spans"] == [(2, 4, "apache-2", 1)]
    assert licenses.scan("under the ISC license")["labels"] == set()
    assert licenses.scan("cc by sa")["labels"] == {"cc-by-sa"}


def test_seeds_lose_nothing():
    """Every match of the pattern over the whole text is found by way of the seeds."""
    import random

    random.seed(1)
    for _ in range(300):
        n = random.choice(licenses.NOTICES)
        text = list(n.phrase.decode())
        for _ in range(random.randrange(n.edits + 2)):
            at = random.randrange(len(text))
            text[at : at + random.randrange(2)] = random.choice(["x", "", "e"])
        joined = f" some words {' '.join(''.join(text).split())} and more ".encode()
        whole = [a for a in licenses.word_starts(joined) if n.pattern.match(joined, a)]
        assert bool(licenses.fuzzy(joined, n, licenses.word_starts(joined))) == bool(whole)


def best_first(joined, n):
    """(start, end, edits) by edit distances of all runs of words: of what overlaps, the fewest edits stay, then the first."""
    starts = [i + 1 for i, c in enumerate(joined[:-1]) if c == 32]
    ends = [i for i, c in enumerate(joined) if c == 32 and i]
    found = []
    for a in starts:
        row = list(range(len(n.phrase) + 1))
        for at in range(a, min(len(joined), a + len(n.phrase) + n.edits + 1)):
            if at in ends and row[-1] <= n.edits:
                found.append((row[-1], a, at))
            new = [row[0] + 1]
            for k, c in enumerate(n.phrase):
                new.append(min(row[k] + (c != joined[at]), row[k + 1] + 1, new[-1] + 1))
            row = new
    out = []
    for edits, a, b in sorted(found):
        if all(b <= x or a >= y for x, y, _ in out):
            out.append((a, b, edits))
    return sorted(out)


def test_adjacent_places_are_all_found():
    """Inexact places before a better one stay, whatever stands between them."""
    import random

    assert [s[::3] for s in licenses.scan("mozilla public licence mozilla public license")["spans"]] == [(0, 1), (3, 0)]
    assert [s[::3] for s in licenses.scan("under the mit licence under the mit license")["spans"]] == [(0, 1), (4, 0)]
    random.seed(2)
    fuzzy = [n for n in licenses.NOTICES if n.edits]
    for _ in range(300):
        n, parts = random.choice(fuzzy), []
        for _ in range(random.randrange(2, 6)):
            text = list(n.phrase.decode())
            for _ in range(random.randrange(n.edits + 2)):
                at = random.randrange(len(text))
                if text[at] != " ":
                    text[at] = random.choice("xqz")
            parts += ["".join(text), *random.choices(["license", "public", "other", "under the"], k=random.randrange(3))]
        joined = f" {' '.join(parts)} ".encode()
        assert licenses.fuzzy(joined, n, licenses.word_starts(joined)) == best_first(joined, n), (joined, n.label)


def test_work_grows_with_the_text():
    """A million places, and seeds without a match, in seconds."""
    import time

    began = time.time()
    got = licenses.scan("cc by nc " * 1_000_000)
    assert len(got["base"]) == 1_000_000 and (got["base"][0], got["base"][-1]) == (0, 2_999_997)
    assert not licenses.scan("public license " * 20_000)["labels"]
    assert time.time() - began < 90


def test_edge_tables(spark):
    schema = "doc_id long, text string, spans string"
    assert licenses.scan_documents(spark.createDataFrame([], schema)).count() == 0
    got = licenses.scan_documents(spark.createDataFrame([(None, "under the mit license", "x"), (None, "under the mit license", "x"), (1, None, None)], schema)).collect()
    assert sorted((r.doc_id or 0, r.n_base, r.first_word) for r in got if r.n_base) == [(0, 1, 0), (0, 1, 0)]
    assert [(r.n_words, r.first_word, r.labels, r.score) for r in got if r.doc_id == 1] == [(0, None, "", 0.0)]
