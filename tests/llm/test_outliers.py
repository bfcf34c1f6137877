import re
from collections import Counter, defaultdict

import numpy as np

from landq.llm import outliers
from landq.llm.outliers import CUT, ENTRIES, FLOORS, LEAST_ROWS, SHARE, STEPS, TYPICAL_WORD, UNIT, good_documents, judged, op7_quality

SF = "/root/testdata/sf0.01"
WORD = re.compile("[^\x20\x09-\x0d]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    failed = n < 10 or 100 * len(covered) > 20 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed, len(lines)


def half_up(x):
    return np.floor(np.abs(x) + 0.5) * np.sign(x)


def vector(stats):
    n, chars, symbols, dups, _, _, lines = stats
    n, chars = max(n, 1), max(chars, 1)
    word = np.log(chars / n / TYPICAL_WORD) * np.sqrt(min(n, 100) / 100)
    return [float(half_up(UNIT * x)) for x in (np.log(n), word, np.sqrt(symbols / chars), np.sqrt(dups / max(lines, 1)))]


def distances(x, mean, cov):
    off = x - mean
    return np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off)


def robust(x):
    """Squared distances by concentration steps from medians and median deviations on."""
    floor = np.diag([(UNIT * f) ** 2 for f in FLOORS])
    mean = np.median(x, axis=0)
    cov = np.diag((1.4826 * np.median(np.abs(x - mean), axis=0)) ** 2) + floor
    for _ in range(STEPS):
        bins = np.floor(256 * np.log1p(distances(x, mean, cov)))
        near = x[bins <= np.percentile(bins, 100 * SHARE)]
        mean = near.mean(axis=0)
        cov = outliers.CONSISTENCY * np.cov(near.T, bias=True) + floor
    return distances(x, mean, cov)


def expected(rows):
    """Statistics and verdict of each (lang, source, text)."""
    stats = [base(t) for _, _, t in rows]
    good = [i for i, s in enumerate(stats) if not s[5]]
    own = Counter(rows[i][:2] for i in good)
    small = Counter(lang for (lang, _), n in own.items() if n < LEAST_ROWS for _ in range(n))
    groups = defaultdict(list)
    for i in good:
        lang, source, _ = rows[i]
        groups[(lang, source) if own[lang, source] >= LEAST_ROWS else (lang,) if small[lang] >= LEAST_ROWS else ()].append(i)
    kept = [False] * len(rows)
    for members in groups.values():
        for i, d in zip(members, robust(np.array([vector(stats[i]) for i in members])), strict=True):
            kept[i] = bool(d <= CUT)
    return [(*s[:6], k) for s, k in zip(stats, kept, strict=True)]


def planted():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghijé"), rng.integers(1, 10))) for _ in range(3000)]
    rows = []
    for i in range(500):
        text = " ".join(rng.choice(words, int(np.exp(rng.normal(5, 1))) + 1))
        if i % 25 == 7:
            text = text.replace(" ", "### ")
        if i % 40 == 3:
            text = "\n".join([text[:50]] * 9 + [text])
        rows.append((["en", "de"][i % 2], ["s1", "s2", None][i % 3] if i % 7 else f"rare{i}", text))
    return rows + [("en", "s1", "a b c d e f g h i j k l " * 20), ("en", "s1", None), (None, None, ""), (None, "s1", "x " * 9)]


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def test_statistics_and_verdicts(spark):
    rows = planted()
    frame = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string, kept string")
    got = {r[0]: tuple(r[1:]) for r in judged(frame.repartition(5)).select("row.doc_id", *COLUMNS).collect()}
    want = expected(rows)
    assert [got[i] for i in range(len(rows))] == want
    assert {i for i in range(500) if i % 25 == 7 and want[i][0] > 30} <= {i for i, w in enumerate(want) if not w[6]}


def test_repeated_words_edges(spark):
    texts = ["a " * 5, "a " * 6, "a b c d e a b c d e", "a b c d e f a b c d e", "a b c d e x " * 3 + "q", "", " \n\t", "w"]
    frame = spark.createDataFrame([(i, t, "l", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.n_repeat_words for r in judged(frame).select("row.doc_id", "n_repeat_words").collect()}
    assert got == {i: base(t)[4] for i, t in enumerate(texts)}


def test_odd_rows_and_order(spark, odd_docs, no_docs):
    out = good_documents(odd_docs)
    assert out.columns == odd_docs.columns
    assert judged(no_docs).count() == 0 and good_documents(no_docs).count() == 0
    a = sorted(map(str, judged(odd_docs).select("row.doc_id", *COLUMNS).collect()))
    b = sorted(map(str, judged(odd_docs.repartition(7)).select("row.doc_id", *COLUMNS).collect()))
    assert a == b


def test_plan_is_native(spark):
    plan = op7_quality(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and len(ENTRIES) == len(FLOORS)


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = {d.doc_id: e for d, e in zip(docs, expected([(d.lang, d.source, d.text) for d in docs]), strict=True)}
    assert {r[0]: tuple(r[1:]) for r in op7_quality(spark, SF).select("doc_id", *COLUMNS).collect()} == want
