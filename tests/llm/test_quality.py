import re
from collections import Counter, defaultdict

from tracelattice.llm import quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def lines_of(text):
    """(raw, normal, words) of each line."""
    return [(x, " ".join(WORD.findall(x)).lower(), len(WORD.findall(x))) for x in (text or "").split("\n")]


def frequent(rows, max_docs):
    """(host, line) of lines in more than max_docs different texts of a host; rows: (text, host)."""
    seen = defaultdict(set)
    for text, host in rows:
        for _, line, n in lines_of(text):
            if n:
                seen[host or "", line].add(text or "")
    return {k for k, v in seen.items() if len(v) > max_docs}


def brute(rows, max_docs):
    """rows: (text, host); the columns of judge() in order."""
    out, many = [], frequent(rows, max_docs)
    for text, host in rows:
        t = text or ""
        w = WORD.findall(t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        twice = Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if twice[g] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        removed = sum(n for _, line, n in lines_of(t) if (host or "", line) in many)
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        out.append((len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed, removed, not failed and 2 * removed <= len(w)))
    return out


def rows():
    body = lambda i, n: " ".join(f"word{i}x{j}" for j in range(n))
    footer = "Read  the terms of this site " + " ".join(f"t{i}" for i in range(30))
    out = [(None, "a"), ("", None), ("\n \x0b\n", "a"), ("# a # a # a * $ | < > x", "b"), (body(1, 60) + "\n" + body(1, 60), "a"), ("ab cd ef ab cd ef " + body(2, 50), None)]
    for i in range(14):
        out.append((body(i, 40) + "\n" + footer, "hot"))
        out.append((body(i, 20) + "\n" + footer.upper() + "\n\n", "hot"))
        out.append((body(i, 80) + "\n" + footer, f"h{i % 2}"))
        out.append((body(999, 70) + "\nlast " + str(i % 3), "copies"))
    return out + [out[6]]


def test_judge_matches_brute_force(spark):
    data = rows()
    df = spark.createDataFrame([(t, h, i, "x") for i, (t, h) in enumerate(data)], "text string, source string, doc_id long, kept string").repartition(3)
    got = {r.doc_id: tuple(r[c] for c in (*quality.METRICS, "base_failed", "removed_words", "kept")) for r in quality.judge(df).collect()}
    want = brute(data, quality.MAX_DOCS)
    assert [got[i] for i in range(len(data))] == want
    assert any(w[6] for w in want) and any(not w[5] and not w[7] for w in want)


def test_clean_removes_frequent_lines(spark):
    data = rows()
    df = spark.createDataFrame([(t, h, i) for i, (t, h) in enumerate(data)], "text string, source string, doc_id long")
    out = {r.doc_id: r for r in quality.judge(df, clean=True).collect()}
    assert all("terms" not in (r.text or "").lower() for r in out.values() if r.source == "hot")
    assert out[4].text == data[4][0] and out[0].text is None
    many = frequent(data, quality.MAX_DOCS)
    assert all((out[i].text or "") == "\n".join(raw for raw, line, _ in lines_of(t) if (h or "", line) not in many) for i, (t, h) in enumerate(data))


def test_longest_lines_are_found_too(spark):
    notice = " ".join(f"n{k}" for k in range(40))
    body = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    data = [(f"{body(i, 20)}\n{notice}", "h") for i in range(30)] + [(f"{body(i, 39)}\n{body(i + 50, 5)}\n{notice}", "h") for i in range(100, 104)] + [(f"{body(1, 60)}", "h")]
    df = spark.createDataFrame(data, "text string, source string").repartition(3)
    got = [tuple(r) for r in quality.judge(df).select("n_words", "removed_words", "kept").collect()]
    assert Counter(got) == {(60, 40, False): 30, (84, 40, True): 4, (60, 0, True): 1}


def test_copies_count_once(spark):
    text = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(text, "h")] * 50 + [(text, None)] * 50, "text string, source string").repartition(3)
    assert {(r.removed_words, r.kept) for r in quality.judge(df).collect()} == {(0, True)}


def test_very_long_text_and_null_keys(spark):
    data = [(None, " ".join(f"w{k}" for k in range(400_000)) + "\n" + "x" * 1_000_000, "h"), (None, None, None)]
    got = quality.judge(spark.createDataFrame(data, "doc_id long, text string, source string")).orderBy("n_words").collect()
    assert [(r.doc_id, r.n_words, r.kept) for r in got] == [(None, 0, False), (None, 400_001, True)]


def test_empty_table(spark):
    assert quality.judge(spark.createDataFrame([], "text string, source string")).count() == 0
