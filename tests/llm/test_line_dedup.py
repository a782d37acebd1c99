import hashlib
import random
import re

from tessitura.llm import line_dedup as L


def edit_at_most_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i + 1 :] == b[i + 1 :]


def kind_and_tokens(x):
    words = x.split(" ")
    return ("w", words) if len(words) >= L.TOKENS else ("c", list(x))


def brute(rows):
    first, places = {}, []
    for d, t in rows:
        for p, line in enumerate((t or "").split("\n")):
            x = re.sub(r"[\x20\x09-\x0D]+", " ", line.lower()).strip()
            if x:
                at = (d is None, d or 0, hashlib.md5((t or "").encode()).digest(), p)
                first[x] = min(first.get(x, at), at)
                places.append((d, t, p, at, x))
    long = {x: kind_and_tokens(x) for x in first}
    long = {x: kt for x, kt in long.items() if len(kt[1]) >= L.TOKENS}
    near = {x for x, (k, w) in long.items() if any(first[y] < first[x] and k == j and edit_at_most_one(w, v) for y, (j, v) in long.items() if y != x)}
    gone = {(d, t, p) for d, t, p, at, x in places if at > first[x] or x in near}
    out = []
    for d, t in rows:
        lines = t.split("\n") if t is not None else []
        kept = [x for p, x in enumerate(lines) if (d, t, p) not in gone]
        out.append((d, len(lines), len(lines) - len(kept), None if t is None else "\n".join(kept)))
    return out


def key(r):
    return tuple((x is not None, x) for x in r)


def test_against_brute_force(docs, rows):
    got = [tuple(r) for r in L.dedup(docs).collect()]
    assert sorted(got, key=key) == sorted(brute([(r[0], r[1]) for r in rows]), key=key)


def test_edits_of_every_kind(spark, empty):
    base = "a b c d e f g"
    rows = [(3, base), (4, "A b  c d e f g"), (5, "a b c X e f g"), (6, "a b c e f g"), (7, "z a b c d e f g"), (8, "a b d c e f g"), (9, "a b c d e f g\n\nshort one\na b c d e f Q"), (2, "short one"), (None, base), (10, None), (11, "x a b c d e f y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in L.dedup(df).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    assert L.dedup(empty).count() == 0


def test_null_ids_and_short_lines(spark):
    """Texts under one id are apart; lines of one to four words are near by characters."""
    texts = ["same line here\nx", "same line here\ny", "same line hero\nab\nac", "title: one", "title: ones", "titel: one", "ab", "abcd", "abce", "abcde", "abcdf", "héllo wörld", "hello wörld", "hello wörlds\n\n \n"]
    rows = [(None, t) for t in texts] + [(None, None), (None, texts[0]), (1, "abcdef"), (1, "abcdeg\nzzz"), (1, "abcdef")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, key string, pos int")
    got = [tuple(r) for r in L.dedup(df).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_lengths_about_every_rounding(spark):
    """One substitution or deletion at any place of lines of 5 to 80 tokens."""
    rng, rows = random.Random(6), []
    for m in range(5, 80):
        for kind in ("sub", "del", "short"):
            words = [f"{kind}{m}x{k}" for k in range(m)] if kind != "short" else [rng.choice("abcdefghij") + str(m)]
            line = " ".join(words) if kind != "short" else "".join(rng.choice("abcdefghijklmnop") for _ in range(m))
            at = rng.randrange(m)
            if kind == "sub":
                words[at] = "other"
            elif kind == "del":
                del words[at]
            other = " ".join(words) if kind != "short" else line[:at] + "Z" + line[at:]
            rows += [(len(rows), line), (len(rows) + 1, other)]
    got = [tuple(r) for r in L.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    want = brute(rows)
    assert sorted(got, key=key) == sorted(want, key=key) and sum(r[2] for r in want) == len(rows) // 2 - 1
