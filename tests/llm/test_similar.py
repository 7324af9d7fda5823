"""Union-find, near-duplicates, line and span dedup against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from snapgraph import scratch
from snapgraph.llm import lines, lsh, neardup, spans, unionfind


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def test_union_find(spark):
    random.seed(1)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 480)] + [(500, j) for j in range(501, 560)] + [(7, 7), (-5, 3)]
    random.shuffle(edges)
    s = Sets()
    for a, b in edges:
        s.join(a, b)
    want = {x: s.find(x) for x in s.up if sum(s.find(y) == s.find(x) for y in s.up) > 1}
    got = {r.node: r.root for r in unionfind.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == want
    assert unionfind.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rounds_take_few_tasks(spark, monkeypatch):
    """However many shuffle partitions there are, few edges are handled by a task a core, and no step deals them out once more."""
    files, keep = [], scratch.keep
    monkeypatch.setattr(scratch, "keep", lambda df, name, *a, **b: (out := keep(df, name, *a, **b), files.append((name, len(out.inputFiles()))))[0])
    settings = {"spark.sql.shuffle.partitions": "61", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in settings}
    edges = [(i, i // 2) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(50)]
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = {r.node: r.root for r in unionfind.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == {i: 0 for i in range(400)} | {1000 + i: 1000 for i in range(51)}
    assert files and max(n for _, n in files) <= spark.sparkContext.defaultParallelism


def test_components_joined_by_further_links(spark):
    random.seed(3)
    first, more = ([(random.randrange(120), random.randrange(120)) for _ in range(n)] for n in (40, 25))
    labels = unionfind.components(spark.createDataFrame(first, "a long, b long"))
    got = {r.node: r.root for r in lsh.joined(labels, spark.createDataFrame(more, "a long, b long"), 2).collect()}
    assert got == {r.node: r.root for r in unionfind.components(spark.createDataFrame(first + more, "a long, b long")).collect()}
    assert lsh.joined(labels, spark.createDataFrame([], "a long, b long"), 2).count() == labels.count()


def test_buckets_keep_all_candidates(spark):
    random.seed(2)
    rows = [(i, [random.randrange(30) if j else 7 for j in range(3)]) for i in range(400)]
    found = Sets()
    for r in lsh.stars(spark.createDataFrame(rows, "node long, bands array<long>").repartition(5)).collect():
        found.join(r.a, r.b)
    by = defaultdict(list)
    for i, bands in rows:
        for b in bands:
            by[b].append(i)
    want = Sets()
    for members in by.values():
        for x in members:
            want.join(members[0], x)
    assert all(found.find(i) == want.find(i) for i, _ in rows)


def test_buckets_meet_as_packed_arrays(monkeypatch):
    """Few rows carry many pairs, and what tasks hold of a hot bucket is packed apart without losing a member or a single pivot."""
    monkeypatch.setattr(lsh, "SLICES", 4)
    monkeypatch.setattr(lsh, "PACK", 3000)
    rng = np.random.default_rng(4)
    pairs = [(int(b), int(x)) for b, x in zip(rng.integers(-300, 300, 9000), rng.integers(-5000, 5000, 9000), strict=True)]
    pairs += [(7, x) for x in range(-200, 2000)] + [(8, 11)] * 50 + [(9, x) for x in range(30)]
    random.Random(4).shuffle(pairs)
    want = defaultdict(set)
    for b, x in pairs:
        want[b].add(x)
    for many in (3, 40, 10**6):
        monkeypatch.setattr(lsh, "MANY", many)
        dealt = []
        for at in range(0, len(pairs), 4000):  # tasks
            some = pairs[at : at + 4000]
            for kind in (0, 1):
                part = some[kind::2]
                values, counts = np.array([b for b, _ in part]), np.ones(len(part), int)
                bands = lsh.packed(values, counts) if kind else pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1), pa.int32()), pa.array(values))
                batch = pa.RecordBatch.from_arrays([pa.array([x for _, x in part]), bands], ["node", "bands"])
                dealt += [r for b in lsh._pack(iter([batch.slice(0, 700), batch.slice(700)])) for r in b.to_pylist()]
        if many > 40:
            assert len(dealt) < len(pairs) / 100 and all(r["kind"] == 0 for r in dealt)
        else:
            assert {r["kind"] for r in dealt} == {0, 1, 2} and max(len(r["band"]) for r in dealt if r["kind"] == 0) < len(pairs) * 8 / 4
        schema = pa.schema([("slice", pa.int32()), ("kind", pa.int32()), ("band", pa.binary()), ("node", pa.binary())])
        runs = []
        for part in range(3):  # as Spark deals and sorts them
            own = sorted((r for r in dealt if r["slice"] % 3 == part), key=lambda r: (r["slice"], r["kind"]))
            table = pa.RecordBatch.from_pylist(own, schema)
            runs += [r for b in lsh._runs(iter([table.slice(0, 17), table.slice(17)])) for r in b.to_pylist()]
        head = {}
        for r in runs:
            if r["piece"]:
                head[r["band"]] = min(r["pivot"], head.get(r["band"], r["pivot"]))
        got = {(r["band"], head.get(r["band"], r["pivot"]), r["node"]) for r in runs}
        assert {x for x in got if x[1] != x[2]} == {(b, min(m), x) for b, m in want.items() for x in m if x != min(m)}


def similarity(a, b):
    """Weighted Jaccard similarity of two dicts of weights."""
    if not a and not b:
        return 1.0
    both = sum(min(w, b[x]) for x, w in a.items() if x in b)
    return both / (sum(a.values()) + sum(b.values()) - both)


def as_dicts(sets):
    h, w, ptr = sets
    return [dict(zip(h[a:b].tolist(), w[a:b].tolist(), strict=True)) for a, b in zip(ptr, ptr[1:], strict=False)]


def test_similarities():
    random.seed(3)
    base = sorted(random.sample(range(10_000), 60))
    for weights in ([1.0], [1.0, 1.5, 3.0]):
        parts = []
        for _ in range(40):
            own = sorted(set(random.sample(base, random.randrange(40, 60)) + random.sample(range(10_000), random.randrange(12))))
            parts.append((np.array(own, np.uint64), np.array([random.choice(weights) for _ in own]), np.array([0, len(own)])))
        parts += [(np.zeros(0, np.uint64), np.zeros(0), np.zeros(2, int))] * 2
        sets = lsh.join(parts)
        plain, every = as_dicts(sets), np.arange(42)
        want = np.array([[similarity(a, b) for b in plain] for a in plain])
        for left, right in ((np.append(every[:20], 41), every[20:41]), (every, every)):
            for root in (every, every // 2):
                near = Sets()
                for i in left.tolist():
                    for j in right.tolist():
                        if want[i, j] >= 0.7 and i != j:
                            near.join(int(root[i]), int(root[j]))
                got = Sets()
                for i, j in lsh.joins(sets, left, right, 0.7, root):
                    assert want[i, j] >= 0.7 and got.find(int(root[i])) != got.find(int(root[j]))
                    got.join(int(root[i]), int(root[j]))
                assert all(got.find(int(r)) == near.find(int(r)) for r in root)
        partner = np.array([random.randrange(42) for _ in every])
        assert np.allclose(lsh.jaccard(sets, lsh.select(sets, every[::-1]), partner), want[partner, every[::-1]])


def corpus(seed, n_groups=12):
    """Random texts in groups of copies and edits, and texts that share passages."""
    random.seed(seed)
    vocabulary = ["".join(random.choices("abcdeé", k=random.randrange(2, 7))) for _ in range(900)]

    def prose(n):
        words = random.choices(vocabulary, k=n)
        return "".join(w + random.choice([" ", " ", " ", ". ", ", ", "\n"]) for w in words)

    texts = [prose(random.randrange(3, 160)) for _ in range(60)]
    shared = prose(60)
    texts += [prose(random.randrange(20)) + "\n" + shared + "\n" + prose(random.randrange(100)) for _ in range(15)]
    for g in range(n_groups):
        words = prose(random.randrange(40, 200)).split(" ")
        for _ in range(random.randrange(2, 9)):
            own = list(words)
            for _ in range(random.randrange(4)):
                own[random.randrange(len(own))] = random.choice(vocabulary)
            texts.append(" ".join(own))
    texts += ["", "", None, None, "!!!", "one", "One!", "a\n\n\nb", texts[0], texts[0]]
    random.shuffle(texts)
    return list(enumerate(texts))


def tf_idf(texts):
    """Weights of each text's runs of five words, by document frequencies that are counted one by one."""
    runs = []
    for t in texts:
        own = WORD.findall((t or "").lower())
        runs.append(Counter(zip(*(own[k:] for k in range(5)), strict=False)) if len(own) >= 5 else Counter([tuple(own)] if own else []))
    df = Counter(x for r in runs for x in r)
    return [{x: n * math.log2(1 + len(texts) / df[x]) for x, n in r.items()} for r in runs]


def partition(rows, least):
    """The class (its smallest id) of each row by similarity of `least` or more, from weights of the test's own."""
    sets = tf_idf([t for _, t in rows])
    by = defaultdict(list)
    for i, d in enumerate(sets):
        for x in d:
            by[x].append(i)
    s = Sets()
    for i, (_, t) in enumerate(rows):
        s.join(i, i)
        for j in {j for x in sets[i] for j in by[x] if j < i} | {j for j in range(i) if not sets[i] and t == rows[j][1]}:
            if t == rows[j][1] or (sets[i] and similarity(sets[i], sets[j]) >= least):
                s.join(i, j)
    least_id = {}
    for i, (d, _) in enumerate(rows):
        least_id[s.find(i)] = min(d, least_id.get(s.find(i), d))
    return {d: least_id[s.find(i)] for i, (d, _) in enumerate(rows)}


def finer(a, b):
    """Whether classes of a lie within classes of b."""
    to = {}
    return all(to.setdefault(a[d], b[d]) == b[d] for d in a)


def assert_classes(got, rows, slack=0.01):
    """got holds all links above 0.8 + slack and none below 0.8 - slack; hashed document frequencies account for the slack."""
    assert finer(partition(rows, 0.8 + slack), got) and finer(got, partition(rows, 0.8 - slack))


def test_near_duplicates(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame([(d, t, "x", 3) for d, t in rows], "doc_id long, text string, node string, _class int")
        got = {r.doc_id: r for r in neardup.report(df).collect()}
        want = {d: r.class_id for d, r in got.items()}
        assert_classes(want, rows)
        assert all(r.class_size == sum(v == want[d] for v in want.values()) and r.representative == (d == want[d]) for d, r in got.items())
        kept = neardup.dedupe(df)
        assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_near_duplicate_edge_cases(spark):
    schema = "doc_id long, text string"
    assert neardup.report(spark.createDataFrame([], schema)).count() == 0
    got = neardup.report(spark.createDataFrame([(None, "a b c"), (None, "a b c"), (5, "x"), (5, "x"), (4, None)], schema)).collect()
    assert sorted((r.class_size, r.class_id or -1) for r in got) == [(1, 4), (2, -1), (2, -1), (2, 5), (2, 5)]
    assert neardup.dedupe(spark.createDataFrame([(None, "a b c"), (None, "a b c"), (5, "x"), (5, "x")], schema)).count() == 2
    long = "word%d " * 3
    big = " ".join(f"w{i}" for i in range(30_000))
    got = neardup.report(spark.createDataFrame([(1, big), (2, big + " end"), (3, long)], schema)).collect()
    assert sorted(r.class_size for r in got) == [1, 2, 2]


def test_large_groups_of_near_copies(spark, monkeypatch):
    """Copies that are not similar to each other, only to the original, still form one class; blocks and second pivots are used."""
    monkeypatch.setattr(lsh, "BLOCK", 16)
    monkeypatch.setattr(lsh, "CENTRAL", 20)
    random.seed(8)
    words = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(words))]
    for d in range(1, 90):
        own = list(words)
        for at in random.sample(range(150), 2):
            own[at] = f"x{d}_{at}"
        rows.append((d, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(neardup, "LARGE", 32)
    assert {r.class_id for r in neardup.report(df).collect()} == {0}
    # unfolded, what all share weighs little, and the copies part
    monkeypatch.setattr(neardup, "LARGE", 1000)
    got = {r.doc_id: r.class_id for r in neardup.report(df).collect()}
    assert_classes(got, rows)
    assert len(set(got.values())) > 80


def lines_by_force(rows):
    places = [((d, t), i, x.strip(" ").lower()) for d, t in in_order(rows) for i, x in enumerate(t.split("\n")) if x.strip(" ")]
    distinct = sorted({x for *_, x in places})
    sets = as_dicts(lines.elements(pa.array(distinct)))
    s = Sets()
    for i, x in enumerate(distinct):
        s.join(x, x)
        for j in range(i):
            if similarity(sets[i], sets[j]) >= 0.8:
                s.join(x, distinct[j])
    seen, gone = {}, defaultdict(set)
    for d, i, x in places:
        if seen.setdefault(s.find(x), (d, i)) != (d, i):
            gone[d].add(i)
    return gone


def test_line_dedup(spark):
    for seed in (3, 4):
        rows = [(d, t) for d, t in corpus(seed)]
        df = spark.createDataFrame([(d, t, 1, "y") for d, t in rows], "doc_id long, text string, n_chars long, removed string")
        want = {d: gone for (d, _), gone in lines_by_force(rows).items()}
        texts = {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want.get(d, ())) for d, t in rows}
        got = {r.doc_id: r for r in lines.report(df).collect()}
        assert {d: set(r.removed) for d, r in got.items()} == {d: want.get(d, set()) for d, _ in rows}
        assert {d: r.text for d, r in got.items()} == texts
        out = lines.dedupe(df)
        assert out.columns == df.columns
        assert {r.doc_id: (r.text, r.n_chars, r.removed) for r in out.collect()} == {d: (t, None if t is None else len(t), "y") for d, t in texts.items()}


def test_line_edge_cases(spark):
    schema = "doc_id long, text string"
    assert lines.report(spark.createDataFrame([], schema)).count() == 0
    got = lines.report(spark.createDataFrame([(None, "same"), (2, "same\nSAME \n\n\nx"), (1, ""), (3, None), (2, "same\nSAME \n\n\nx")], schema)).collect()
    assert sorted((r.doc_id or 9, r.text) for r in got if r.text is not None) == [(1, ""), (2, "same\n\n\nx"), (2, "same\n\n\nx"), (9, "")]


WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def xxhash64(data, seed=42):
    got = xxhash.xxh64(data, seed).intdigest()
    return got - (1 << 64) if got >> 63 else got


def in_order(rows):
    """Rows in the order of documents: id, null last, then hash of the text."""
    return sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is None, r[0] or 0, xxhash64(r[1].encode())))


def result(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))


def spans_by_force(rows):
    """Every run of sentences, of any length, instead of the spans that are hashed."""
    first, every = {}, []
    for d, t in in_order(rows):
        sentences, end = [], None
        for m in WORD.finditer(t or ""):
            if end is None or re.search(r"[.!?\n]", t[end : m.start()]):
                sentences.append([m.start(), []])
            sentences[-1][1].append(m[0].lower())
            end = m.end()
        at = [0] + [s[0] for s in sentences[1:]] + [len(t or "")]
        for i in range(len(sentences)):
            own = []
            for j in range(i, len(sentences)):
                own += sentences[j][1]
                if j - i + 1 >= 4 or (j > i and len(own) >= 12):
                    key = " ".join(own)
                    first.setdefault(key, (d, t, i))
                    every.append((key, d, t, i, at[i], at[j + 1]))
    gone = defaultdict(set)
    for key, d, t, i, a, b in every:
        if first[key] != (d, t, i):
            gone[d, t].update(range(a, b))
    return [(d, None if t is None else "".join(c for k, c in enumerate(t) if k not in gone[d, t])) for d, t in rows]


def test_span_dedup(spark):
    for seed in (5, 6):
        rows = corpus(seed)
        passage = ". ".join(" ".join(f"p{seed}{i}{j}" for j in range(9)) for i in range(7)) + ". "
        rows += [(1000, "Own words here. " + passage + "More own words."), (1001, "x. " + passage), (1002, passage + passage), (1003, " ".join(f"q{i}" for i in range(60))), (1004, "Begin! " + " ".join(f"q{i}" for i in range(60)))]
        df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, removed int")
        got = {r.doc_id: r for r in spans.report(df).collect()}
        assert result((d, r.text) for d, r in got.items()) == result(spans_by_force(rows))
        assert got[1000].n_removed == 0 and "p" not in got[1001].text.split(". ")[0] and got[1004].n_removed == 0  # one sentence is no run


def test_span_edge_cases(spark):
    schema = "doc_id long, text string"
    assert spans.report(spark.createDataFrame([], schema)).count() == 0
    text = "one two three four five six. seven eight nine ten eleven twelve."
    got = spans.report(spark.createDataFrame([(None, text), (1, text), (2, None), (3, ""), (1, text)], schema)).collect()
    assert sorted((r.doc_id or 9, r.text) for r in got if r.text is not None) == [(1, text), (1, text), (3, ""), (9, "")]
    assert spans.report(spark.createDataFrame([(1, "x. " * 50_000)], schema)).select(F.length("text")).first()[0] < 150_000


def test_all_runs_of_sentences(spark):
    """The last sentences of a repeated passage go too, behind a long sentence as well as behind short ones."""
    long, ten = " ".join(f"q{i}" for i in range(60)), [" ".join(f"t{k}{i}" for i in range(10)) for k in range(2)]
    rows = [(1, f"Own begin. {long}. The last one. Own end."), (2, f"Other begin. {long}. The last one. Other end."), (3, f"{long}. The last one.")]
    rows += [(4, f"{ten[0]}. {ten[1]}. Tail. Rest here."), (5, f"Before. {ten[0]}. {ten[1]}. Tail. Others follow.")]
    rows += [(6, f"One. {long}. Two"), (7, f"Three. {long}! Four")]
    random.seed(9)
    lengths = (1, 1, 2, 5, 9, 11, 12, 48, 49, 50, 51, 70)
    pool = [" ".join(f"r{k}x{i}" for i in range(random.choice(lengths))) for k in range(40)]
    for d in range(100, 160):
        at = random.randrange(30)
        rows.append((d, ". ".join([f"own{d}", *pool[at : at + random.randrange(1, 9)], *random.choices(pool, k=3)]) + "."))
    got = {r.doc_id: r.text for r in spans.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(spans_by_force(rows))
    assert got[2] == "Other begin. Other end." and got[3] == "" and got[5] == "Before. Others follow."
    for seed in (5, 6):
        rows = corpus(seed)
        got = {r.doc_id: r.text for r in spans.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == dict(spans_by_force(rows))


def test_short_runs_of_several_sentences(spark):
    """Four short sentences go, three of few words stay, three of twelve words go; repeats within a text too."""
    four, three, twelve = "Call now. Do not wait. It is free. Really.", "Yes. No. Maybe so.", "One two three four. Five six seven eight. Nine ten eleven twelve."
    rows = [(1, f"Own first. {four} Own last. {three}"), (2, f"Another beginning. {four} Another end. {three}"), (3, f"Third beginning. {twelve} Third end."), (4, f"Fourth beginning. {twelve} Fourth end."), (5, f"{four} Between. {four}")]
    got = {r.doc_id: r.text for r in spans.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(spans_by_force(rows))
    assert got[2] == f"Another beginning. Another end. {three}" and got[4] == "Fourth beginning. Fourth end." and got[5].strip() == "Between."


def test_frequent_boilerplate_weighs_little(spark):
    """Equal bodies below different frequent passages, 0.6 of all shingles, are near-duplicates by TF-IDF; equal passages alone are not."""
    passages = [" ".join(f"p{k}w{i}" for i in range(52)) for k in range(3)]
    bodies = [" ".join(f"b{k}w{i}" for i in range(160)) for k in range(300)]
    rows = [(2 * k + side, f"{passages[(k + side) % 3]} {body}") for k, body in enumerate(bodies) for side in range(2)]
    got = {r.doc_id: r.class_id for r in neardup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d - d % 2 for d, _ in rows}


def repeated_ids(seed):
    """Texts under ids that are null or shared, some rows twice."""
    rows = [(random.choice([None, 1, 2, d]), t) for d, t in corpus(seed, 5)]
    return rows + rows[:9]


def test_lines_and_spans_under_null_and_shared_ids(spark):
    rows = [(None, "same words here. and more of them to come in this. own"), (None, "same words here. and more of them to come in this. other"), (None, "line\nfirst own line"), (None, "line\nsecond own line")]
    rows += [(7, "line\nthird own line"), (7, "line\nfourth own line")] + repeated_ids(12)
    df = spark.createDataFrame([(d, t, 5, "s") for d, t in rows], "doc_id long, text string, n_chars long, span string")
    want = lines_by_force(rows)
    want = [(d, None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want[d, t])) for d, t in rows]
    assert result((r.doc_id, r.text) for r in lines.report(df).collect()) == result(want)
    assert sum(t == "line" or (t or "").startswith("line\n") for _, t in want) == 1
    out = spans.dedupe(df)
    assert out.columns == df.columns
    got = out.collect()
    assert result((r.doc_id, r.text) for r in got) == result(spans_by_force(rows))
    assert all(r.n_chars == (None if r.text is None else len(r.text)) and r.span == "s" for r in got)


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    """Tables too large to send, hot keys apart, and short blocks."""
    monkeypatch.setattr(lsh, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(lsh, "HOT", 20)
    rows = corpus(13, 3)[:90]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in spans.report(df).collect()} == dict(spans_by_force(rows))
    got = {r.doc_id: r for r in neardup.report(df).collect()}
    assert_classes({d: r.class_id for d, r in got.items()}, rows)


def test_very_long_lines_and_texts(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(1, long), (2, long + " end"), (3, "x\n" * 100_000), (4, "\n".join(f"own line {i} of this text" for i in range(30_000)))]
    got = {r.doc_id: r for r in lines.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[3].n_removed, got[3].n_lines) == (0, 1, 99_999, 100_001)
