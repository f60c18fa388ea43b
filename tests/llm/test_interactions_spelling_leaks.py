"""Filter interactions, spelling variants and benchmark decontamination against brute force on small fixtures."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from frameledger.llm import decontaminate, interactions, spelling

CLASHING = "doc_id long, text string, source string, part string, n long, key long, a int, b int, word string, `dotted.name` int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", -1, -1, -1, -1, "y", 0) for i, t, s in rows], CLASHING)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# 11


def brute_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = defaultdict(lambda: [0] * 6)
    shapley = Counter()
    for i, t, s in rows:
        t, s = t or "", s or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and t in least and least[t] < i}
        for order in itertools.permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                row = out[s, "".join(order), step]
                removed = fails[f] and not gone
                row[2] += fails[f] and gone
                gone |= removed
                row[0] += not gone
                row[1] += removed
                row[3] += fails[f] and sum(fails.values()) == 1
                row[4] += removed and i in good
                row[5] += removed and i in toxic
                shapley[s, f] += removed
    return {k: (*map(int, v), shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit_rows(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_audit_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(None, None, None), (None, "", "s1"), (3, "", "s1"), (3, "", "s2"), (4, None, ""), (5, "Äb $", "s1"), (9, "word " * 40_000, "s1")]
    for i in range(60):
        words = [rng.choice(["alpha", "Beta", "GAMMA", "d|e", "x", "y%", *map(str, range(40))]) for _ in range(rng.choice([0, 3, 49, 50, 80]))]
        text = " ".join(words) if rng.random() < 0.5 else "\n".join(f"w{k}" for k in range(60))
        rows.append((rng.choice([i, i, 7, None]), text, rng.choice(["s1", "s2", None])))
    rows += rows[:20]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(40)] + [(7, 0, 1), (7, 1, 0), (None, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = interactions.audit(interactions.failure_patterns(table(spark, rows), marks))
    assert audit_rows(got) == brute_audit(rows, labels)


def test_audit_of_no_documents_and_no_labels(spark):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interactions.audit(interactions.failure_patterns(table(spark, []), marks)).count() == 0
    rows = [(1, "a", "s")]
    assert audit_rows(interactions.audit(interactions.failure_patterns(table(spark, rows), marks))) == brute_audit(rows, [])


def test_intervals_cover_each_order_once():
    for n in (1, 3, 5):
        numbered = interactions.orders(n)
        for mask in range(1 << n):
            steps = {}
            for step, first, end in interactions.removal_intervals(mask, n):
                for number in range(first, end):
                    assert number not in steps
                    steps[number] = step
            want = {k: min((i + 1 for i, f in enumerate(o) if mask >> f & 1), default=None) for k, o in enumerate(numbered)}
            assert steps == {k: v for k, v in want.items() if v}
        assert len(numbered) == math.factorial(n)


# 12


def brute_words(rows, one_in=spelling.MISSPELT):
    n = Counter()
    for i, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= 5}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(words):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, xs in near.items():
        if xs and (best := min(xs, key=lambda x: (-words[x], x))) and words[best] >= 5 * words[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items()}


def variant_rows(df):
    rows = df.collect()
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(got) == len(rows)
    return got


def spelling_rows():
    rng = random.Random(2)
    words = ["aaaaaaa", "ñandúes", "Straßes", "entire", "lettersandmoreletters", "abcabcabc", "x" * 70, "÷×÷×÷×"]
    for w in list(words):
        for _ in range(8):
            k = rng.randrange(len(w))
            words.append(rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abÿ") + w[k:], w[:k] + rng.choice("abc") + w[k + 1 :]]))
    rows = [(None, None, "s"), (None, "", "s"), (2, "12 $$ short", "s")]
    for i in range(60):
        rows.append((rng.choice([i, i, None]), " ".join(w if rng.random() < 0.5 else w.upper() for w in rng.choices(words, weights=[1 + 400 * (k % 9 == 0) + 60 * (k % 7 == 0) for k in range(len(words))], k=200)), "s"))
    rows.append((70, "chained " * 6 + "chainedb " * 40 + "chainedbc " * 300, "s"))
    return rows + rows[:9] + [(99, "entire9" * 30_000, "s"), (98, "y" * 50_000, "s")]


def test_variants_equal_brute_force(spark):
    rows = spelling_rows()
    words = brute_words(rows)
    want = brute_variants(words)
    assert sum(v[0] is not None for v in want.values()) > 10 and any(v[1] != v[0] and v[0] for v in want.values())
    assert variant_rows(spelling.variants(table(spark, rows))) == want


def test_no_words_give_no_variants(spark):
    assert spelling.variants(table(spark, [])).count() == 0
    assert spelling.variants(table(spark, [(1, None, "s"), (2, "rare words only", "s")])).count() == 0


def test_crowded_tiles_are_compared_in_blocks(spark):
    """Every pair of letters in one window: tiles hold more words than a block."""
    letters = "abcdefghijklmnop"
    words = {f"same{x}{y}": 5 for x in letters for y in letters} | {f"same{x}": 5 for x in letters}
    words = {w: n for w, n in words.items() if len(w) >= 5}
    table_ = spark.createDataFrame(list(words.items()), "word string, n long")
    assert table_.count() > spelling.BLOCK * 2
    got = Counter((r.word, r.near) for r in spelling.near_words(table_).collect())
    assert set(got.values()) == {1}
    assert set(got) == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_random_words_of_a_tile():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.choice([6, 7]))) for _ in range(150)})
    n = len(words)
    lengths = np.array([len(w) for w in words])
    found = set()
    for m in (6, 7, 8):
        rows = [k for k in range(n) if lengths[k] in (m, m - 1)]
        if rows:
            i, j = spelling.single_edits([words[k] for k in rows], lengths[rows], np.zeros(len(rows), int), np.full(len(rows), m), np.zeros(len(rows), int), np.full(len(rows), m))
            found |= {frozenset((words[rows[x]], words[rows[y]])) for x, y in zip(i, j)}
    assert found == {frozenset((a, b)) for a in words for b in words if one_edit(a, b)}


# 13


def cut(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def brute_leaks(rows, items, width=10, slop=1):
    df = Counter(w for _, t, _ in rows for w in cut(t))
    out = []
    for i, t, _ in rows:
        w = cut(t)
        at = defaultdict(set)
        for p, x in enumerate(w):
            at[x].add(p)
        hit, exact, near = set(), set(), set()
        for name, text in items:
            v = cut(text)
            need = min(width, len(v))
            for s in range(len(v) - need + 1) if v else ():
                window = v[s : s + need]
                for p in at[window[0]]:
                    if w[p : p + need] == window:
                        hit |= set(range(p, p + need))
                        exact.add("" if name is None else str(name))
                rare = min(range(need), key=lambda k: (df[window[k]], k))
                for p in at[window[rare]]:
                    if all(any(p - rare + k + d in at[x] for d in range(-slop, slop + 1)) for k, x in enumerate(window) if k != rare):
                        near.add("" if name is None else str(name))
        out.append((i, len(w), len(hit), len(exact), hashlib.sha256(",".join(sorted(exact)).encode()).hexdigest(), bool(hit), len(near)))
    return Counter(out)


def leak_rows(df):
    return Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated, r.n_near_items) for r in df.collect())


def leak_fixture():
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(30)] + ["Éa", "été", "x9"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 9, 10, 11, 25])))) for k in range(12)]
    items += [(3, "same words same words same words same words same words same words"), (None, "w1-w2,W3"), (20, None), (21, ""), (22, " ... "), items[0], (30, "z " * 14)]
    rows = [(None, None, "s"), (None, "", "s"), (1, "z " * 5000, "s"), (2, "same words " * 30, "s")]
    for i in range(40):
        words = rng.choices(vocabulary, k=rng.randrange(1, 80))
        for _ in range(rng.randrange(3)):
            v = (rng.choice(items)[1] or "").split()
            k = rng.randrange(len(v) + 1)
            part = v[k : k + rng.randrange(8, 20)]
            if len(part) > 4 and rng.random() < 0.5:
                x = rng.randrange(len(part) - 1)
                part[x], part[x + 1] = part[x + 1], part[x]
            at = rng.randrange(len(words) + 1)
            words[at:at] = part
        text = rng.choice([" ", "\n", ", "]).join(words)
        rows.append((rng.choice([i, i, None]), text.upper() if rng.random() < 0.3 else text, "s"))
    return rows + rows[:12], items


def test_leaks_equal_brute_force(spark):
    rows, items = leak_fixture()
    tests = spark.createDataFrame([(i, t, 0, 0) for i, t in items], "item_id long, text string, term int, j int")
    got = leak_rows(decontaminate.contamination(table(spark, rows), tests))
    assert got == brute_leaks(rows, items)
    assert any(r[6] > r[3] for r in got) and any(r[5] for r in got)


def test_leaks_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = [(1, "a b c", "s"), (None, None, "s")]
    assert leak_rows(decontaminate.contamination(table(spark, rows), none)) == brute_leaks(rows, [])
    assert decontaminate.contamination(table(spark, []), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_index_finds_phrases_where_they_stand(spark):
    rows = [(1, "one two three four five six seven eight nine ten eleven", "s"), (2, "one two three five four six seven eight nine ten", "s")]
    items = decontaminate.read_items(spark.createDataFrame([(5, rows[0][1])], "item_id long, text string"))
    index = decontaminate.build_index(table(spark, rows), items)
    assert index.count() == 21
    assert [tuple(r) for r in decontaminate.find(index, items, slop=0).select("name", "exact", "begin", "end").collect()] == [("5", True, 0, 11)]
    found = decontaminate.find(index, items, slop=1)
    assert found.where(~F.col("exact")).select("a", "b").distinct().count() == 2
