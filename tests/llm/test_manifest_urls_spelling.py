"""Merkle manifest, URL templates and spelling variants against brute force, and on odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from panelwright.llm import merkle, spelling, urls

DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, path string, _row string, _group string, word string, n long"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def odd(spark):
    """NULLs in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    long_text = "\n".join(f"wörd{'abcdefghij'[i % 10]}line" for i in range(40_000))
    base = [
        (1, None, None, None, None), (2, "a", "en", 3, ""), (2, "a", "en", 3, ""), (2, "a", "en", 4, "other"), (None, "a", "en", 1, "x\ny"),
        (None, None, None, None, None), (7, "b", "de", 9, long_text), (8, "", "en", 2, "one\ntwo"), (-3, "é", "fr", 5, "tab\tend\n"), (40, "Z", None, 0, "\n\n"),
        *[(100 + i, "hot", "en", i, f"line {i}\nnext {i % 3}") for i in range(32)],
    ]
    return spark.createDataFrame([(*r, "x", "y", "z", "g", "w", 1) for r in base], DOCS)


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    values = (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        h = levels[-1]
        levels.append([H(*h[i:i + 3]) for i in range(0, len(h), 3)])
    return levels


def steps(levels, at):
    for h in levels[:-1]:
        run = h[at // 3 * 3:at // 3 * 3 + 3]
        yield run[:at % 3], run[at % 3 + 1:]
        at //= 3


def plain_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        tampered = r["text"]
        if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and tampered is not None:
            tampered = tampered.replace("\n", "")
        groups["" if r["source"] is None else "=" + r["source"]].append((r["doc_id"], leaf_of(r, r["text"]), leaf_of(r, tampered)))
    names = sorted(groups, key=str.encode)
    trees = {}
    for g in names:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = plain_tree([x[1] for x in groups[g]])
    crown = plain_tree([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for at, (doc, leaf, checked) in enumerate(groups[g]):
            sides = [*steps(trees[g], at), *steps(crown, k)]
            h = checked
            for left, right in sides:
                h = H(*left, h, *right)
            out.append((doc, leaf, trees[g][-1][0], crown[-1][0], H(*["".join(a) + "".join(b) for a, b in sides]), h, h == crown[-1][0]))
    return Counter(out)


def test_manifest_equals_plain_trees(spark, odd):
    rows = [r.asDict() for r in odd.collect()]
    got = merkle.verify_documents(odd).collect()
    assert Counter(tuple(r) for r in got) == plain_manifest(rows)
    assert {r["verified"] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_manifest_sizes(spark, n):
    docs = spark.createDataFrame([(i, "s", "en", 1, f"t{i}\n") for i in range(n)], "doc_id long, source string, lang string, n_chars long, text string")
    assert Counter(tuple(r) for r in merkle.verify_documents(docs).collect()) == plain_manifest([r.asDict() for r in docs.collect()])


def test_manifest_of_an_empty_table(odd):
    assert merkle.verify_documents(odd.limit(0)).collect() == []


def test_prove_carries_columns_and_other_fanouts(spark):
    rows = spark.range(20).select(F.col("id"), (F.col("id") % 2).cast("string").alias("g"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"), F.lit(1).alias("_hash"))
    got = merkle.prove(rows, "g", "id", fanout=2).withColumn("back", merkle.fold(F.col("path"), F.col("leaf"))).collect()
    assert len(got) == 20 and all(r["back"] == r["root"] and r["_hash"] == 1 for r in got)
    assert len({r["root"] for r in got}) == 1 and len({r["subroot"] for r in got}) == 2


# -- urls ----------------------------------------------------------------------


def test_url_parts_and_rules(spark):
    long_path = "/" + "/".join(f"s{i}" for i in range(5000))
    cases = [
        ("https://Sub.EXAMPLE.org/es/x?q#f", "sub.example.org", "/es/x", "example.org/es/", "block"),
        ("http://example.org/en/17", "example.org", "/en/17", "example.org/en/1", "block"),
        ("http://example.org/en/2#/fr/", "example.org", "/en/2", "org/", "allow"),
        ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        ("a://b.com/fr/x", "b.com", "/fr/x", "com/fr/", "allow"), ("a://b.com/de/", "b.com", "/de/", "com/de/", "block"),
        ("a://b.com/DE/", "b.com", "/DE/", None, None), ("x://y.org?z=://q.com/de/", "y.org", "", None, None), ("http://É.Com/de/\nx", "É.com", "/de/\nx", "com/de/", "block"),
        ("://org/", "org", "/", "org/", "allow"), ("no scheme", "", "", None, None), ("", "", "", None, None), (None, "", "", None, None), ("h://big.net" + long_path, "big.net", long_path, None, None),
    ]
    frame = spark.createDataFrame([(i, c[0], "x", "y", 1) for i, c in enumerate(cases)], "page_id long, url string, host string, template string, _total long")
    got = {r["page_id"]: r for r in urls.judge(frame).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(cases):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), i
        assert got[i]["verdict"] == verdict or verdict is None and got[i]["verdict"] in ("allow", "block")
    assert got[13]["template"].endswith("/**")
    assert urls.judge(frame.limit(0)).collect() == []


def test_templates_generalise_merge_and_reject(spark):
    rows = [(f"http://shop.net/item/{i}.html", "block" if i < 30 else None) for i in range(60)]
    rows += [(f"http://shop.net/news/{i}", "allow" if i < 30 else None) for i in range(60)]
    rows += [(f"http://shop.net/blog/{i}", "allow" if i < 30 else None) for i in range(60)]
    rows += [(f"http://shop.net/help/{i}", None) for i in range(9)]
    rows += [("http://shop.net/news/*", None), (None, "block")] + [("http://shop.net/news/7", None)] * 40
    frame = spark.createDataFrame([(i, u, label) for i, (u, label) in enumerate(rows)], "page_id long, url string, label string")
    got = urls.judge(frame, rules=(), labels="label").collect()
    kinds = {(re.sub(r"\d+", "0", r["path"]), r["template"], r["verdict"]) for r in got if r["path"]}
    assert ("/item/0.html", "/item/<0.a>", "block") in kinds and ("/help/0", "/help/<0>", "allow") in kinds
    # the page asked for forty times has a branch of its own, which its labels do not tell from the others
    assert {(t, v) for p, t, v in kinds if p in ("/news/0", "/blog/0")} == {("/{blog|news}/{7|<0>}", "allow")}
    assert len(got) == len(rows) and [r["template"] for r in got if r["host"] == ""] == ["/"]


def test_hot_nodes_are_salted_without_effect(spark, monkeypatch):
    rows = [(i, f"http://h{i % 3}.com/{'fr' if i % 2 else 'de'}/{i % 7}/{i}") for i in range(300)]
    frame = spark.createDataFrame(rows, "page_id long, url string")
    want = {tuple(r) for r in urls.judge(frame).collect()}
    monkeypatch.setattr(urls, "HOT", 2)
    assert {tuple(r) for r in urls.judge(frame).collect()} == want and len(want) == 300


# -- spelling ------------------------------------------------------------------


def near_by_force(words):
    def one(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    return {(a, b) for a in words for b in words if one(a, b)}


@pytest.mark.parametrize("bucket", [1, 4])
@pytest.mark.parametrize("alphabet", ["ab", "abcé"])
def test_neighbours_equal_brute_force(spark, alphabet, bucket):
    rng = random.Random(len(alphabet))
    words = {"".join(rng.choice(alphabet) for _ in range(rng.randint(6, 9))) for _ in range(220)} | {"a" * n for n in range(6, 14)}
    frame = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    got = [tuple(r) for r in spelling.neighbours(frame, bucket=bucket).collect()]
    assert len(got) == len(set(got)) and set(got) == near_by_force(words)


def test_long_words_and_hot_nodes(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HOT", 3)
    rng = random.Random(3)
    base = ["".join(rng.choice("abc") for _ in range(n)) for n in (11, 12, 12, 13, 25)]
    words = set(base) | {w[:i] + w[i + 1:] for w in base for i in (0, 5, len(w) - 1)} | {w[:4] + "q" + w[4:] for w in base} | {w + "z" for w in base}
    frame = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    assert {tuple(r) for r in spelling.neighbours(frame, long=12).collect()} == near_by_force(words)


def plain_variants(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = defaultdict(list)
    for a, b in near_by_force(counts):
        near[a].append(b)
    form = {}
    for w in counts:
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return out


def test_variants_equal_plain_words(spark):
    words = ["garden", "gardens", "garde", "Gardén", "gardén", "gardenss", "kitchen", "kitchenÀ", "×kitchen", "kitchen÷x", "naïve-ness"]
    times = [200, 30, 40, 6, 6, 5, 90, 15, 5, 5, 7]
    rows = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(zip(words, times, strict=True))]
    rows += [(None, "garden kitchen"), (None, None), (5, ""), (6, "12 34"), (7, "gardens " * 3000), *[(90 + i, "kitchen, Kitchem; kitchemm!") for i in range(700)]]
    frame = spark.createDataFrame([(*r, "x", 1, "f") for r in rows], "doc_id long, text string, word string, n long, form string")
    got = spelling.variants(frame).collect()
    assert {tuple(r) for r in got} == plain_variants(rows) and len(got) == len({r["word"] for r in got})
    assert any(r["form"] and r["root"] != r["form"] for r in got)
    assert spelling.variants(frame.limit(0)).collect() == []
