import random
from collections import Counter, defaultdict

from landq.llm.components import components
from landq.llm.near_duplicates import SMALL_REGION, one_of_each, op4_near_duplicates, with_components

SF = "/root/testdata/sf0.001"


def shingle_set(text, k):
    words = (text or "").encode().lower().split()
    if len(words) < k:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(docs, k):
    """Row number to (set size, smallest doc_id reachable)."""
    sets = [shingle_set(t, k) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, s in enumerate(sets):
        shared = Counter(j for g in s for j in where[g])
        for g in s:
            where[g].append(i)
        for j, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(len(s), d if not s else least.get(root(i))) for i, (s, (d, _)) in enumerate(zip(sets, docs, strict=True))]


def planted():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    docs, at = [], 0

    def add(text):
        nonlocal at
        docs.append((at, text))
        at += 1

    base = [word() for _ in range(300)]
    for _ in range(6 * SMALL_REGION):  # a region larger than the small ones
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(300)] = word()
        add(" ".join(copy))
    for _ in range(40):  # pairs on either side of the bound
        one = [word() for _ in range(rng.choice([6, 20, 100]))]
        two = list(one)
        for _ in range(rng.randint(0, 5)):
            two[rng.randrange(len(two))] = word()
        add(" ".join(one))
        add(" ".join(two).upper())
    for _ in range(50):
        add(" ".join(base[:60] + [word() for _ in range(200)]))  # a shared passage is no near-copy
    add("x y z")
    add("X  y\nz")
    add("x y")
    return docs


def check(spark, docs, k, frame=None):
    frame = frame if frame is not None else spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in with_components(frame, k).collect())
    want = Counter((d, n, c, d == c) for (d, _), (n, c) in zip(docs, brute(docs, k), strict=True))
    assert got == want


def test_planted(spark):
    check(spark, planted(), 4)


def crowds():
    """A template with variants that are similar to it and not to each other, and a chain of edits; several hundred each."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))

    def edited(words):
        new = list(words)
        for i in rng.sample(range(4, len(words) - 4, 4), len(words) // 40):
            new[i] = word()
        return new

    texts, template = [], [word() for _ in range(400)]
    texts += [edited(template) for _ in range(300)] + [template]
    chain = [[word() for _ in range(400)]]
    while len(chain) < 300:
        chain.append(edited(chain[-1]))
    # many that share two thirds, so that they crowd regions, and a few near-copies among them
    base = [word() for _ in range(400)]
    apart = [base[:330] + [word() for _ in range(70)] for _ in range(300)]
    texts += chain + apart + [edited(apart[i]) for i in range(0, 300, 7)]
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_crowded_regions(spark):
    check(spark, crowds(), 4)


def test_odd_rows(spark, odd_docs, no_docs):
    check(spark, [(r.doc_id, r.text) for r in odd_docs.collect()], 5, odd_docs)
    assert with_components(no_docs).count() == 0


def test_one_of_each(spark, odd_docs):
    kept = one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = kept.collect()
    assert sum(r.text == odd_docs.filter("doc_id = 6").first().text for r in rows) == 1
    assert sum(not (r.text or "").split() for r in rows) == sum(not (r.text or "").split() for r in odd_docs.collect())


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {d: (n, c, d == c) for (d, _), (n, c) in zip(docs, brute(docs, 4), strict=True)}
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in op4_near_duplicates(spark, SF).collect()} == want


def test_components(spark):
    rng = random.Random(9)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 440)] + [(500, 500 + i) for i in range(30)]
    parent = {x: x for link in links for x in link}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "x long, y long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}
    assert components(spark.createDataFrame([], "x long, y long")).count() == 0
