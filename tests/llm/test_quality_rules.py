import math
import random
import re

from pyspark.sql import functions as F

from strandframe.llm.quality_rules import largest_count, merging, quality_rules, query, text_statistics


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(hit)


def test_statistics_match_brute_force(spark):
    rng = random.Random(1)
    texts = ["", None, " \t\n", "one", "  a b", "é# |\x1cx", "a\r\na\r\n\n \na", "w " * 7, "w " * 8, "w " * 9, "x" * 200_000]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    texts += [rng.choice(["\n", " "]).join(rng.choice(["a", "b|", "é"]) for _ in range(30)) for _ in range(20)]
    rows = [(i, t, 0) for i, t in enumerate(texts)]
    got = {r.doc_id: tuple(r)[2:] for r in text_statistics(spark.createDataFrame(rows, "doc_id long, text string, n_lines int").select("doc_id", F.lit(0).alias("x"), "text")).collect()}
    assert got == {i: brute(t) for i, t, _ in rows}


def test_largest_count_is_the_exact_binomial_bound(spark):
    ns = [0, 1, 10, 100, 461, 3000]
    got = {r.n: r.k for r in spark.createDataFrame([(n,) for n in ns], "n long").select("n", largest_count(F.col("n"), 0.0125, 0.003).alias("k")).collect()}
    for n in ns:
        cdf, k = 0.0, -1
        for i in range(n + 1):
            cdf += math.comb(n, i) * 0.0125**i * 0.9875 ** (n - i)
            if cdf > 0.003:
                break
            k = i
        assert got[n] == k


def test_rules_reject_bad_and_spare_good(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, labels = [], []
    for i in range(2400):
        bad = i % 6 == 0
        rows.append((i, " ".join(word() + ("%%" if bad else "") for _ in range(40)), "x"))
        labels.append((i, 0 if bad else 1))
    rows += [(9000, None, None), (9001, "", ""), (None, "a b", ""), (0, rows[0][1], "x")]
    out = quality_rules(spark.createDataFrame(rows, "doc_id long, text string, kept string"), spark.createDataFrame([*labels, (None, 1), (9000, None)], "doc_id long, quality int")).collect()
    assert len(out) == len(rows)
    good = [r.kept for r in out if r.doc_id is not None and r.doc_id < 2400 and r.doc_id % 6]
    assert sum(good) > 0.98 * len(good)
    assert not any(r.kept for r in out if r.doc_id is not None and r.doc_id < 2400 and not r.doc_id % 6)
    assert all(r.base_failed for r in out if r.doc_id in (9000, 9001, None))


def test_no_labels_and_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, "a b c " * 10), (2, " ".join(map(str, range(30))))], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in quality_rules(docs, none).collect()} == {1: False, 2: True}
    assert quality_rules(docs.limit(0), none).count() == 0


def test_strata_merge_until_a_cutoff_can_be_certain(spark):
    names, sql = zip(*merging(100), strict=True)
    for n in ([500, 500, 500, 500], [44, 139, 124, 26], [0, 0, 0, 0], [100, 0, 99, 1], [99, 1, 0, 100], [10, 10, 10, 300]):
        row = spark.createDataFrame([n], "n0 long, n1 long, n2 long, n3 long")
        for name, x in zip(names, sql, strict=True):
            row = row.withColumn(name, F.expr(x))
        got = list(row.select("s0", "s1", "s2", "s3").first())
        want, held = [], 0
        for k in n:
            if want and held >= 100:
                want.append(want[-1] + 1)
                held = k
            else:
                want.append(want[-1] if want else 0)
                held += k
        if held < 100 and want[-1]:
            want = [min(x, want[-1] - 1) for x in want]
        assert got == want


def test_rules_are_fitted_on_the_test_tables(spark):
    """The SQL that the query is held against goes through the method: there are cutoffs, and they reject documents."""
    out = query(spark, "/root/testdata/sf0.01")
    assert out.where("not kept and not base_failed").count() > 0


def test_rows_of_one_id_are_one_trial(spark):
    rng = random.Random(3)
    text = lambda bad: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) + "%%" * bad for _ in range(40))
    rows = [(i, text(i % 3 == 0)) for i in range(90)]
    many = rows * 40  # as often as would make a cutoff certain, if each row were a trial
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(90)], "doc_id long, quality int")
    out = quality_rules(spark.createDataFrame(many, "doc_id long, text string"), labels)
    assert out.where("not kept").count() == 0


def test_long_words_are_told_apart(spark):
    """Statistics have no ceiling: words of 150 characters are good, of 300 bad."""
    rows = [(i, " ".join(f"{k}".rjust(300 if i % 5 == 0 else 150, "x") for k in range(i, i + 25))) for i in range(1500)]
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(1500)], "doc_id long, quality int")
    out = quality_rules(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()
    assert all(r.kept == (r.doc_id % 5 != 0) for r in out)
