import re
from collections import Counter

from pyspark.sql import functions as F

from tessitura.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    tri = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if tri[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_base_figures_equal_brute_force(docs, rows):
    got = sorted((r[0], *r[1:7]) for r in Q.judge(docs).select("doc_id", *Q.BASE).collect())
    assert got == sorted((r[0], *brute(r[1])) for r in rows)


def test_repeats_symbols_and_lines(spark):
    texts = ["a b c a b c", "# $ x\nx\nx\n\n", "a b", None, "a a a a"]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r[0]: tuple(r[1:7]) for r in Q.judge(df).select("doc_id", *Q.BASE).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_frequent_lines_deplete_but_copies_do_not(spark):
    foot = "\n".join(" ".join(f"foot{j}x{k}" for k in range(15)) for j in range(8))
    own = lambda i, n: " ".join(f"o{i}x{k}" for k in range(n))
    rows = [(i, own(i, 200) + "\n" + foot, "h") for i in range(60)]
    rows += [(100 + i, own(1000 + i, 10) + "\n" + foot, "h") for i in range(30)]  # nearly all footer
    copy = "\n".join(own(f"c{j}", 20) for j in range(6))
    rows += [(200 + i, copy, "h") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r[0] for r in Q.judge(df, Q.LineLimits(min_docs=20, share=0.02)).filter("kept").collect()}
    assert kept == set(range(60)) | set(range(200, 260))


def test_copies_do_not_hide_a_template(spark):
    """100 pages of one template among 9,900 copies of another text: the copies are one document of the host."""
    line = lambda name: " ".join(f"{name}x{k}" for k in range(12))
    template = "\n".join(line(f"t{j}") for j in range(10))
    rows = [(i, f"{template}\nown{i} page", "h") for i in range(100)] + [(100 + i, line("copy") + "\n" + " ".join(f"c{k}" for k in range(60)), "h") for i in range(9900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    kept = {r[0] for r in Q.judge(df).filter("kept").collect()}
    assert kept == set(range(100, 10000))


def test_a_word_tells_documents_apart(spark):
    """200 pages of one template and a line of one word: 200 documents, all depleted."""
    template = "\n".join(" ".join(f"t{j}x{k}" for k in range(12)) for j in range(10))
    df = spark.createDataFrame([(i, f"{template}\nid{i}", "h") for i in range(200)], "doc_id long, text string, source string")
    assert Q.judge(df).filter("kept").count() == 0


def test_every_different_page_counts_whatever_lines_it_shares(spark):
    line = lambda name: " ".join(f"{name}x{k}" for k in range(10))
    pages = lambda host, n, shared, own: [("\n".join([line(f"{host}s{j}") for j in range(shared)] + [line(f"{host}o{i}y{j}") for j in range(own)]), host) for i in range(n)]
    rows = pages("a", 300, 8, 1) + pages("b", 300, 20, 2)
    rows += pages("c", 1, 8, 1) * 300  # exact copies are one document
    rows += [("\n".join([line("ds")] * 3 + [f"{i}k{k}" for k in range(30)]), "d") for i in range(300)]  # one-word lines that are no trifle
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, source string")
    got = Counter((r["host"], r["n_docs"]) for r in Q.frequent_lines(df).collect())
    assert got == {("a", 300): 8, ("b", 300): 20, ("d", 300): 1}
    kept = {r[0] for r in Q.judge(df).filter("kept").collect()}
    assert kept == set(range(600, 1200))  # those of d lose half their words


def test_keep_returns_rows_unchanged_and_empty_table(docs, empty, rows):
    clash = docs.withColumn("host", F.lit("x")).withColumn("text_key", F.lit(1)).withColumn("kept", F.lit(False))
    kept = Q.keep(clash)
    assert kept.columns == clash.columns
    good = [r for r in rows if not brute(r[1])[5]]
    assert sorted(r[0] for r in kept.collect()) == sorted(r[0] for r in good)
    assert Q.judge(empty).count() == 0 and Q.keep(empty).count() == 0


def test_lines_above_limits_are_removed_from_what_is_kept(spark):
    line = lambda name, n=12: " ".join(f"{name}x{k}" for k in range(n))
    foot = "All  Rights\treserved by the host of these pages"
    rows = [(i, line(f"a{i}", 60) + "\n" + (foot if i % 2 else foot.upper()) + "\n\n" + line(f"b{i}", 20), "h", i) for i in range(60)]
    rows += [(1000, line("own", 70) + "\n" + foot, "other", 0), (None, line("n1", 60) + "\n" + foot, "h", 1), (None, line("n2", 60) + "\n" + foot, "h", 2), (5, rows[5][1], "h", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, pos int")
    kept = sorted((str(r["doc_id"]), r["text"], r["pos"]) for r in Q.keep(df).collect())
    cut = lambda t: "\n".join(x for x in t.split("\n") if x.lower().split() != foot.lower().split())
    assert kept == sorted((str(i), cut(t) if h == "h" else t, p) for i, t, h, p in rows)


def test_thirty_hosts_whose_pages_are_a_template(spark):
    """All pages of a host are the host's 30 lines and one line of their own: all are depleted."""
    line = lambda name: " ".join(f"{name}x{k}" for k in range(6))
    rows = []
    for h in range(30):
        template = [line(f"h{h}l{j}") for j in range(30)]
        rows += [(len(rows) + i, "\n".join([*template, line(f"own{h}y{i}")]), f"host{h}") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert Q.judge(df).filter("kept").count() == 0 and Q.judge(df).filter("n_lost_words = 180").count() == len(rows)


def test_many_repeated_windows_are_found_by_either_way(spark):
    import random

    rng = random.Random(3)
    texts = []
    for distinct in (10, 60, 64, 65, 66, 67, 200):
        once = [f"r{distinct}w{k}" for k in range(distinct)]
        texts += [" ".join(once + [f"m{k}" for k in range(9)] + once), " ".join(once * 3 + ["end"])]
    texts.append(" ".join(rng.choice("abcdefg") for _ in range(3000)))
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r[0]: tuple(r[1:7]) for r in Q.judge(df).select("doc_id", *Q.BASE).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
