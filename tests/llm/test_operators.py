"""The corpus operators against brute force, SQL, round trips and held-out rows, and on odd tables."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from check import TABLES, differences
from panelwright.llm import bloomlm, fingerprints, language, licenses, mixing, neardup, packing, suite, topk, toxicity, warc
from panelwright.llm.common import Words, read, remainder, shingles

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, bucket int, _row string, id long, n long"


def words(text):
    return WORD.findall((text or "").translate(LOW))


def rows_of(sf=SF):
    return duckdb.sql(f"select doc_id, text, lang, source from '{sf}/documents.parquet'").fetchall()


@pytest.fixture(scope="module")
def docs(spark):
    return read(spark, SF, "documents")


@pytest.fixture(scope="module")
def odd(spark):
    """NULLs in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    long_text = " ".join(f"w{i % 997}x" for i in range(60_000))
    base = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", "a"), (4, "one", "en", "b"), (5, long_text, "de", "b"), (6, long_text, "de", "b"),
        (6, long_text, "de", "b"), (7, "12345 !!! 678", None, "c"), (None, "a text without any id here at all", "en", None), (None, None, None, None),
        (8, "Released under the MIT  License.", "en", "z"), (9, "été  中文 <|endoftext|> it's x", "fr", "\U0001F600"), (-3, "one", "en", "b"),
    ]
    return spark.createDataFrame([(*r, None, 7, 1, "x", 3, 9) for r in base], ODD_SCHEMA)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(suite.SQL))
def test_query_equals_its_sql(spark, con, name):
    assert differences(suite.QUERIES[name](spark, SF).toPandas(), con.execute(suite.SQL[name]).df()) == ""


def test_mixed_documents_are_not_shuffled(spark):
    """Documents meet the plan of their source where they are; a bucket is taken once more up to the last one."""
    docs = spark.createDataFrame([(i, "w " * (i % 7), ["a", "b", "c", None][i % 4]) for i in range(400)], "doc_id long, text string, source string")
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    rows = mixing.with_repeats(docs).withColumn("bucket", mixing.bucket("doc_id", "mix")).collect()
    for source in ("a", "b", "c", None):
        own = sorted((r["bucket"], r["repeats"]) for r in rows if r["source"] == source)
        assert [n for _, n in own] == sorted((n for _, n in own), reverse=True)


def test_shingles_are_sets_of_words():
    texts = ["a b a b a", "A  b", "x", "", None, "a b a b a"]
    for width in (1, 2, 5):
        found, bounds = shingles(Words(pa.array(texts)), width)
        sizes = np.diff(bounds).tolist()
        for t, size in zip(texts, sizes, strict=True):
            w = words(t)
            assert size == (len({tuple(w[i:i + width]) for i in range(len(w) - width + 1)}) if len(w) >= width else int(bool(w)))
        assert found[bounds[0]:bounds[1]].tolist() == found[bounds[5]:bounds[6]].tolist()


# -- licenses ------------------------------------------------------------------


def test_license_places_equal_brute_force(docs):
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    for i, text, *_ in rows_of():
        w = split.findall((text or "").translate(LOW))
        places = sorted((k, label) for p, label in phrases.items() for k in range(len(w)) if w[k:k + len(p.split())] == p.split())
        r = got[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(places), ",".join(sorted({x for _, x in places})))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def test_pieces_find_every_place_with_few_edits():
    """A plain search of all windows finds no notice that the pieces miss."""
    rng = random.Random(5)
    notices = tuple(n for n in licenses.NOTICES if n.errors)
    for _ in range(60):
        n = rng.choice(notices)
        text = list(n.phrase)
        for _ in range(rng.randint(0, n.errors)):
            at = rng.randrange(1, len(text) - 1)
            if text[at] != " ":
                text[at] = rng.choice("qz")
        found = licenses.matches(("some words " + "".join(text) + " after").encode(), (n,))
        assert found and found[0][3] <= n.errors


def test_license_spans_and_odd_rows(spark, odd, empty):
    got = licenses.scan(odd).collect()
    assert len(got) == odd.count() and licenses.scan(empty).count() == 0
    mit = next(r for r in got if r["doc_id"] == 8)
    assert (mit["n_base"], mit["first_word"], mit["labels"], mit["score"]) == (1, 3, "mit", 1.0)
    fuzzy = spark.createDataFrame([(1, "under the Apache-Licence"), (2, "commit license")], "doc_id long, text string")
    by_id = {r["doc_id"]: r for r in licenses.scan(fuzzy).collect()}
    assert (by_id[1]["n_base"], by_id[1]["labels"]) == (0, "apache") and by_id[1]["spans"][0]["edits"] == 1
    assert by_id[2]["n_base"] == 0


# -- archive ---------------------------------------------------------------------


def test_archive_gives_back_exact_records(spark, tmp_path):
    pages = spark.createDataFrame(
        [(3, "u3", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "u2", None), (5, "u5", ""), (4, "a\r\nb", "x\r\n\r\nWARC/1.1\r\n"), (4, "a\r\nb", "x\r\n\r\nWARC/1.1\r\n"), (None, "u", "y")],
        "page_id long, url string, html string")
    path = str(tmp_path / "a")
    warc.write_archive(warc.page_records(pages), path)
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    rows = warc.read_archive(spark, path).withColumn("page", warc.record_number(warc.header_field("WARC-Record-ID"))).collect()
    assert len(rows) == 7
    for r in rows:
        head, body = bytes(r["record"]).split(b"\r\n\r\n", 1)
        assert head + b"\r\n\r\n" == bytes(r["header"]) and body.endswith(b"\r\n\r\n")
        assert int(re.search(rb"Content-Length: (\d+)", head)[1]) == len(body) - 4
        if r["record_type"] == "response":
            assert body[:-4] == bytes(r["payload"])
    kinds = {r["page"]: r["record_type"] for r in rows}
    assert kinds == {1: "response", 3: "revisit", 2: "response", 5: "revisit", 4: "response", None: "response"}
    broken = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.encode(F.lit("other"), "UTF-8"))
    broken.write.parquet(f"{path}/other/payloads")
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read_payloads(spark, f"{path}/other").collect()


# -- mixing ------------------------------------------------------------------------


def test_mix_targets_and_odd_rows(spark, docs, odd, empty):
    rows = mixing.with_repeats(docs).collect()
    again = {(r["doc_id"], r["repeats"]) for r in mixing.with_repeats(docs.repartition(5)).collect()}
    assert again == {(r["doc_id"], r["repeats"]) for r in rows}
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        taken = sum(r["size"] * r["repeats"] for r in own)
        assert own[0]["target"] <= 3 * own[0]["source_size"] and max(r["repeats"] for r in own) <= 3
        assert abs(taken - own[0]["target"]) <= max(r["size"] for r in own)
    assert abs(sum({r["source"]: r["target"] for r in rows}.values()) - sum(r["size"] for r in rows)) < 1e-3
    assert mixing.with_repeats(odd).count() == odd.count() and mixing.with_repeats(empty).count() == 0
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns and mixing.mix(empty).count() == 0
    weights = spark.createDataFrame([("src0", 5), ("src1", 1)], "source string, weight long")
    assert {r["source"] for r in mixing.with_repeats(docs, weights).collect()} == {"src0", "src1"}


# -- packing ------------------------------------------------------------------------


def _packed(frame):
    import public_tokenizers as P

    return packing.pack(frame, P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")).toPandas()


def _true_ids(texts):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return [np.array([*e.ids, packing.END], "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_packed_pieces_are_the_documents(docs):
    got = _packed(docs)
    rows = rows_of()
    for (i, *_), ids in zip(rows, _true_ids([r[1] for r in rows]), strict=True):
        at = 0
        for p in got[got.doc_id == i].sort_values("start").itertuples():
            assert (p.start, p.doc_tokens) == (at, len(ids)) and p.ids_crc32 == zlib.crc32(ids[at:at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == (s.length.cumsum() - s.length).tolist()
        assert s.length.sum() == s.tier.iloc[0] and s.tier.iloc[0] <= 2048 and s.tier.iloc[0] & (s.tier.iloc[0] - 1) == 0
    steps = got.groupby(["step_group"]).agg(tiers=("tier", "nunique"), tokens=("length", "sum"))
    assert (steps.tiers == 1).all() and (steps.tokens <= packing.STEP_TOKENS).all()


def test_packing_odd_rows(odd, empty):
    got = _packed(odd.coalesce(1))
    assert got.length.sum() == sum(len(x) for x in _true_ids([r["text"] for r in odd.collect()]))
    assert len(_packed(empty)) == 0


def test_encoder_equals_the_library_on_hard_texts():
    import public_tokenizers as P

    texts = ["a  b", " a", "a ", "a\n b", "a \n b", "x  y", "x 　y", "é é", "don't 's 12 ½", "中 文", "", "a b  c", "<|endoftext|> <|endoftext|>", "tab\tx y\tz"]
    encoder = packing.Encoder(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"))
    for _ in range(2):
        for mine, true in zip(encoder.encode(pa.array(texts)), _true_ids(texts), strict=True):
            assert mine.tolist() == true.tolist()


# -- top k ---------------------------------------------------------------------------


def test_large_components_are_scored_in_whole_numbers():
    rng = np.random.default_rng(12)
    vectors = rng.integers(-(1 << 29), 1 << 29, (300, 6)) * 2 + 1
    lists = topk.SortedLists(np.arange(300), vectors)
    for q in (0, 7):
        ids, scores, _ = lists.top(q, vectors[q], 10, step=8)
        exact = sorted(((-sum(int(a) * int(b) for a, b in zip(vectors[q], v, strict=True)), i) for i, v in enumerate(vectors) if i != q))[:10]
        assert [(-int(s), int(i)) for s, i in zip(scores, ids, strict=True)] == exact
    with pytest.raises(OverflowError):
        lists.top(0, np.full(6, 1 << 40), 10)


def test_top_k_of_odd_tables(spark):
    rows = [(1, [1, 2], "x", 3), (2, [2, 1], "x", 3), (2, [2, 1], "x", 3), (3, None, "x", 3), (None, [1, 1], "x", 3), (4, [1], "x", 3), (5, [], "x", 3)]
    frame = spark.createDataFrame(rows, "vec_id long, vector array<long>, dims string, rank int")
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(frame, frame, 2).collect()}
    assert {g for g in got if g[0] == 1} == {(1, 1, 2, 4), (1, 2, 2, 4)} and not {g for g in got if g[0] in (4, 5)}
    assert topk.top_k(frame.limit(0), frame, 2).count() == 0 and topk.top_k(frame, frame.limit(0), 2).count() == 0


def test_threshold_search_is_exact_with_ties(spark):
    rng = np.random.default_rng(3)
    vectors = rng.integers(-3, 4, (700, 6))
    vectors[100:160] = vectors[0]
    data = [(int(i), [int(x) for x in v]) for i, v in enumerate(vectors)] + [(9000, None), (None, [1] * 6), (9001, [1, 2])]
    table = spark.createDataFrame(data, "vec_id long, vector array<long>")
    asked = table.filter("vec_id % 50 = 0")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(asked, table, 10, 3, 2).collect()}
    for q in range(0, 700, 50):
        scores = vectors @ vectors[q]
        best = sorted((-int(s), i) for i, s in enumerate(scores) if i != q)[:10]
        assert [got[q, k + 1] for k in range(10)] == [(i, -s) for s, i in best]
    lists = topk.SortedLists(np.arange(700), vectors)
    lead = np.array([1, 0, 0, 0, 0, 0])
    assert topk.SortedLists(np.arange(5000), rng.normal(0, 1000, (5000, 4)).astype(int)).top(-1, np.array([900, 5, 1, 0]), 5)[2] < 5000
    assert len(lists.top(-1, lead * 0, 10)[0]) == 10
    assert topk.top_k(asked.limit(0), table).count() == 0 and topk.top_k(asked, table.limit(0)).count() == 0
    raw = spark.createDataFrame([(1, [0.5, -0.1]), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, [float("inf"), 1.0]), (5, None)], "vec_id long, e array<float>")
    assert [r[0] for r in raw.select(topk.whole_numbers("e")).collect()] == [[512, -103], None, None, None, None]


# -- language model --------------------------------------------------------------------


def test_base_scores_equal_brute_force_and_the_filter_never_undercounts(docs, odd, empty):
    rows = [(i, [*words(t), None]) for i, t, *_ in rows_of()]
    train = docs.filter(remainder("doc_id", 5) != 1)
    model, counts = bloomlm.train(train, bits=1 << 22)
    c = Counter(w for i, ws in rows if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    total, kinds = sum(c.values()), len(c)
    assert (model.total, model.kinds) == (total, kinds)
    model.head, model.head_counts = model.head[::2], model.head_counts[::2]  # the rest takes the joined way
    got = {r["doc_id"]: r for r in bloomlm.score(docs, model, counts).collect()}
    for i, ws in rows:
        base = sum(math.log10((c[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in ws)
        assert got[i]["base_score"] == pytest.approx(base, rel=1e-9) and got[i]["n_tokens"] == len(ws) and got[i]["n_known"] == sum(c[w] > 0 for w in ws)
        assert got[i]["score"] < 0
    exact = counts.toPandas()
    estimate = model.count(exact["h"].to_numpy(np.int64).view(np.uint64), 1)
    assert (estimate >= 2.0 ** np.floor(np.log2(exact["c"]))).all() and np.mean(estimate < 2.0 ** (1 + np.floor(np.log2(exact["c"])))) > 0.97
    assert bloomlm.score(odd, model, counts).count() == odd.count()
    nothing, none = bloomlm.train(empty, bits=1 << 16)
    assert all(abs(r["base_score"]) < 1e-6 for r in bloomlm.score(odd, nothing, none).collect()) and bloomlm.score(empty, nothing, none).count() == 0


def test_the_filter_grows_with_its_ngrams_and_holds_every_pair(spark, docs):
    sizes = []
    for part in (docs.filter("doc_id % 8 = 0"), docs):
        model, _ = bloomlm.train(part)
        sizes.append(len(model.bits))
        _, pairs, _ = bloomlm.tokens(Words(pa.array([r["text"] for r in part.collect()])))
        kinds, n = np.unique(pairs, return_counts=True)
        assert (n == 1).any() and (model.count(kinds, 2) >= 2.0 ** np.floor(np.log2(n))).all()
        unseen = np.random.default_rng(1).integers(0, 2**63, 100_000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        assert (model.count(unseen, 2) > 0).mean() < 1.2 * bloomlm.RATE
    assert sizes[1] > 2 * sizes[0]


# -- near duplicates ----------------------------------------------------------------------


def _groups(texts, width):
    sets = {}
    for i, t in texts:
        w = words(t)
        sets[i] = frozenset(tuple(w[k:k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicate_groups_equal_brute_force(docs, width):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs, width).collect()}
    assert got == _groups([(i, t) for i, t, *_ in rows_of()], width)


def test_chains_stars_and_odd_rows(spark, odd, empty):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    texts = [(1000, " ".join(base))]
    for k in range(60):  # a star: each close to the first, few close to each other
        w = list(base)
        for at in rng.sample(range(120), 6):
            w[at] = f"k{k}x{at}"
        texts.append((1001 + k, " ".join(w)))
    for k in range(12):  # a chain: each close to the one before only
        texts.append((2000 + k, " ".join(f"c{i}" for i in range(8 * k, 8 * k + 120))))
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(frame, 2).collect()}
    assert got == _groups(texts, 2)
    found = neardup.near_duplicates(odd, 5).collect()
    assert len(found) == odd.count() and neardup.near_duplicates(empty, 5).count() == 0
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[6]["component_id"] == 5 and by_id[4]["component_id"] == -3 and by_id[2]["kept"] and by_id[1]["n_shingles"] == 0


def test_pairs_on_one_template_are_all_found(spark):
    """Hundreds of texts close below the bound to each other hide pairs above it from any choice of a few by sketch."""
    rng = random.Random(8)
    base = [f"t{i}" for i in range(77)]
    texts = []
    for k in range(300):
        tail = [f"k{k}x{i}" for i in range(12)]
        texts += [(2 * k, " ".join(base + tail)), (2 * k + 1, " ".join(base + tail[:4] + [f"k{k}y{i}" for i in range(8)]))]
    rng.shuffle(texts)
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(frame, 2).collect()}
    assert got == {i: (88, i - i % 2) for i, _ in texts}


def _rows(sets):
    """Rows (region, id, n, comp, parity words) of lists of hashes, all in one region."""
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    words = neardup.parities(np.concatenate(sets), bounds).view(np.int64).T
    n = np.diff(bounds)
    return np.concatenate([np.stack([np.zeros(len(n), np.int64), np.arange(len(n)), n, np.arange(len(n))]), words])


@pytest.mark.parametrize("size", [9, 90, 900, 9000])
def test_parity_keeps_every_link_and_drops_most_others(size):
    """Pairs exactly at 0.8 all stay; of pairs at 0.5 few do, while the sets are no larger than the bits."""
    rng = np.random.default_rng(size)
    for shared, stay in ((size * 8 // 9, 1.0), (size * 2 // 3, 0.05 if size in (90,) else 1.0)):
        sets = []
        for _ in range(200):
            h = rng.integers(0, 2**63, 2 * size - shared, dtype=np.uint64)
            sets += [h[:size], h[size - shared:]]
        rows = _rows(sets)
        i = np.arange(0, 400, 2)
        kept = neardup._possible(rows, i + 1, i)[0].mean()
        assert kept == 1.0 if shared == size * 8 // 9 else kept <= stay


def test_many_texts_of_one_template_make_few_candidates():
    """Two thousand rows of one region that share two thirds: all pairs are compared, next to none come out."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 120, dtype=np.uint64)
    rows = _rows([np.concatenate([base, rng.integers(0, 2**63, 60, dtype=np.uint64)]) for _ in range(2000)])
    pairs, more = neardup._nearest(rows, np.zeros(2000, np.int64), np.arange(2000), np.arange(1, 2000), neardup.NEAREST)
    assert pairs.shape[1] < 200 and not more


def test_links_are_found_by_label_and_by_component(spark):
    """Pairs of similarity 0.8 that share a region come out of every order of a round."""
    rng = np.random.default_rng(6)
    hashes = rng.integers(0, 2**63, (2_000, 10), dtype=np.uint64)
    sides = [np.delete(hashes, 9 - k, axis=1) for k in (0, 1)]
    a, b = (neardup.signatures(x.ravel(), np.arange(2_001) * 9) for x in sides)
    at = np.flatnonzero((a == b).reshape(-1, neardup.TREES, neardup.DEPTH).all(axis=2).any(axis=1))[:40]
    bounds = np.arange(2_001) * 9
    parity = [neardup.parities(x.ravel(), bounds) for x in sides]
    classes = spark.createDataFrame(
        [(bytes(s[r].tobytes()), int(2 * r + k), 9, int(2 * r + k), bytes(parity[k][r].tobytes())) for r in at for k, s in enumerate((a, b))],
        "signature binary, id long, n long, comp long, parity binary")
    want = {(int(2 * r), int(2 * r + 1)) for r in at}
    for order, meet in ((("id",), "head"), (("label", "id"), "before"), (("comp", "id"), "others")):
        got = {tuple(sorted((r["head"], r["id"]))) for r in neardup.neighbours(neardup.forest(classes), order, meet).collect()}
        assert got == want


def test_trees_without_company_are_not_planted(spark):
    """A set that meets others in some trees only is shuffled for these; sets met by nobody, and copies alone, never."""
    words = [[f"t{g}w{i}" for i in range(60)] for g in range(20)]
    texts = [" ".join(w) for w in words] + [" ".join(w[:-6] + ["x"] * 6) for w in words[:5]] + [" ".join(words[9])] * 7
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    signed = neardup.store(neardup.sign(docs, 2))
    met = neardup._met(signed)
    rows = met.collect()
    assert {r["doc_id"] for r in rows} == {*range(5), *range(20, 25)}
    sig = {r["doc_id"]: np.frombuffer(r["signature"], np.uint16).reshape(neardup.TREES, neardup.DEPTH) for r in rows}
    for r in rows:
        other = (r["doc_id"] + 20) % 40
        assert r["trees"] == sum(1 << int(t) for t in np.flatnonzero((sig[r["doc_id"]] == sig[other]).all(axis=1)))
    assert neardup.forest(met).count() == sum(r["trees"].bit_count() for r in rows) < neardup.TREES * len(rows)


def test_sets_are_compared_from_packed_texts(spark):
    """Links and no others, from texts with an odd blank, a blank row's neighbour and a long text."""
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base), "\t".join(base[:-20]), " ".join(base[:300]), "Ünï " * 30 + "ende", "ünï " * 30 + "ende"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    classes = neardup.sign(docs, 2).withColumn("id", F.col("doc_id") + 100)
    pairs = spark.createDataFrame([(100, 101), (100, 102), (103, 104)], "head long, id long")
    want = set()
    for a, b in ((0, 1), (0, 2), (3, 4)):
        x, y = ({tuple(w[i:i + 2]) for i in range(len(w) - 1)} for w in (re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in texts[k])) for k in (a, b)))
        if 100 * len(x & y) >= 80 * len(x | y):
            want.add((a + 100, b + 100))
    assert {tuple(r) for r in neardup.confirmed(pairs, docs, classes, 2).collect()} == want and (100, 101) in want and (100, 102) not in want


def test_recall_on_thousands_of_near_copies(spark):
    """Near copies of many texts, most above 0.8: the share of true links inside one component is printed and at least 0.9."""
    rng = random.Random(11)
    texts, true = [], []
    for g in range(400):
        base = [f"g{g}w{i}" for i in range(60)]
        for k in range(5):
            own = list(base)
            for at in rng.sample(range(60), rng.randint(0, 3)):
                own[at] = f"e{g}x{k}x{at}"
            texts.append((len(texts), " ".join(own)))
    sets = [{tuple(t.split()[i:i + 2]) for i in range(59)} for _, t in texts]
    for g in range(400):
        for a in range(5 * g, 5 * g + 5):
            true += [(a, b) for b in range(a + 1, 5 * g + 5) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), 2).collect()}
    recall = sum(comp[a] == comp[b] for a, b in true) / len(true)
    print(f"recall {recall:.4f} of {len(true)} links among {len(texts)} texts")
    assert recall >= 0.9 and all(c // 5 == i // 5 for i, c in comp.items())


# -- language ---------------------------------------------------------------------------------


def test_phrases_equal_a_plain_parse_and_languages_are_found(docs, odd, empty):
    samples = language.sample(docs)
    learned = tuple(samples[k] for k in sorted(samples))
    for _, text, *_ in rows_of()[:3]:
        data = np.frombuffer(text.encode(), np.uint8)
        seq, at = language.symbols(data, np.array([0, len(data)]))
        for k, ref in enumerate(learned):
            known = language.symbols(np.frombuffer(ref, np.uint8), np.array([0, len(ref)]))[0].tobytes()
            n = 0
            for a in range(0, len(seq), language.CHUNK):
                part, i = seq[a:a + language.CHUNK].tobytes(), 0
                while i < len(part):
                    j = i + 1
                    while j <= len(part) and part[i:j] in known:
                        j += 1
                    i, n = max(j - 1, i + 1), n + 1
            assert language.phrases(learned, seq, at)[0, k] == n
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs, samples).collect()}
    held = [(i, lang) for i, _, lang, _ in rows_of() if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i] == lang for i, lang in held]) > 0.9
    answers = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(odd, samples).collect()}
    assert answers[1] == answers[2] == answers[7] == ("und", 0.0) and answers[9][0] != "und"
    assert {r["lang_pred"] for r in language.predict(odd, {}).collect()} == {"und"}
    assert language.predict(empty, samples).count() == 0 and language.sample(empty) == {} and language.keep(odd, samples).columns == odd.columns


# -- toxicity -----------------------------------------------------------------------------------


def test_toxicity_separates_held_out_rows(spark, odd, empty):
    rng = random.Random(4)
    plain = [f"word{i}" for i in range(400)]

    def text(toxic):
        w = rng.choices(plain, k=rng.randint(20, 300))
        for at in rng.sample(range(len(w)), max(1, len(w) // 25)) if toxic else ():
            w[at] = rng.choice(["vile", "awful", "nasty"])
        return " ".join(w)

    y = [int(k % 4 == 0) for k in range(800)]
    model = toxicity.fit([text(c) for c in y], y)
    fresh = [int(k % 3 == 0) for k in range(200)]
    score = model.score(Words(pa.array([text(c) for c in fresh])))
    assert np.mean((score >= 0.5) == np.array(fresh)) > 0.97
    out = toxicity.score(odd, model).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out) and toxicity.score(empty, model).count() == 0
    assert toxicity.keep(odd, model).columns == odd.columns
    one = toxicity.fit(["a b", "c"], [0, 0])
    assert (one.score(Words(pa.array(["a", None, ""]))) < 0.5).all() and len(toxicity.fit([], []).score(Words(pa.array(["a"])))) == 1
    labels = spark.createDataFrame([(4, 1), (4, 0), (2, 0), (None, 1), (5, None), (99, 1)], "doc_id long, toxic int")
    assert {(r["toxic"], r["text"]) for r in toxicity.sample(odd, labels).collect()} <= {(1, "one"), (0, "")}
    assert len(toxicity.learn(odd, labels).weights) == len(toxicity.learn(empty, labels.limit(0)).weights) == 3


def test_long_texts_leave_room_for_the_others(spark):
    rows = [(i, "x" * 50_000 if i % 10 == 0 else f"short é{i}", "en") for i in range(1, 200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i, *_ in rows], "doc_id long, toxic int")
    usable = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    got = toxicity.sample(frame, labels, most=20_000).collect()
    assert len(got) == len(usable) and {r["text"] for r in got} >= {t for _, t, _ in usable if len(t) < 100}
    assert all(sum(len(r["text"].encode()) for r in got if r["toxic"] == c) <= 20_000 for c in (0, 1))
    whole = toxicity.sample(frame, labels).collect()
    assert sorted(r["text"] for r in whole) == sorted(t for _, t, _ in usable)
    learned = language.sample(frame)["en"].decode()
    assert all(t in learned for i, t, _ in rows if len(t) < 100 and zlib.crc32(str(i).encode()) % 3 != 1) and len(learned.encode()) <= language.SAMPLE_BYTES


# -- fingerprints ----------------------------------------------------------------------------------


def test_sketches_merge_and_estimate_containment(spark):
    rng = random.Random(1)
    a = [f"x{rng.randrange(10**6)}" for _ in range(3000)]
    b = a[:1000]
    df = spark.createDataFrame([(" ".join(a), " ".join(b))], "a string, b string").select(
        fingerprints.sketch(fingerprints.shingle_hashes(F.col("a"))).alias("a"), fingerprints.sketch(fingerprints.shingle_hashes(F.col("b"))).alias("b"),
        fingerprints.sketch(F.concat(fingerprints.shingle_hashes(F.col("a")), fingerprints.shingle_hashes(F.col("b")))).alias("both"))
    r = df.select("a", "b", "both", fingerprints.merge(F.col("a"), F.col("b")).alias("merged"), fingerprints.containment(F.col("b"), F.col("a")).alias("c")).first()
    assert r["merged"] == r["both"] == r["a"] and r["c"] == 1.0 and 120 < len(r["a"]) < 260


def test_fingerprints_of_odd_rows(odd, empty):
    rows = fingerprints.fingerprint_edits(odd).collect()
    assert len(rows) == odd.count() and fingerprints.fingerprint_edits(empty).count() == 0
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1]["fingerprint"] == "" and by_id[2]["near_edited"] == 1.0
    assert by_id[5]["fingerprint"] == by_id[6]["fingerprint"] != "" and by_id[4]["fingerprint"] == by_id[-3]["fingerprint"]
    assert by_id[6]["near_next"] == 1.0


def test_archive_of_odd_pages(spark, tmp_path):
    """NULLs, a very long payload, repeated rows, line ends in a URL, clashing extra columns and an empty table."""
    long_html = "<p>" + "long text é\r\n" * 200_000
    rows = [(1, None, None), (2, "http://a/\r\nX: y", ""), (3, "http://b", long_html), (3, "http://b", long_html), (None, "http://c", "x"), (9, None, long_html), (10, "u", "x")]
    pages = spark.createDataFrame([(*r, "p", "s", 5) for r in rows], "page_id long, url string, html string, payload string, sha256 string, owner int")
    for name, frame in (("some", pages), ("none", pages.limit(0))):
        path = f"file://{tmp_path}/{name}"
        warc.write_archive(warc.page_records(frame), path)
        back = warc.read_archive(spark, path)
        got = back.select(warc.record_number(warc.header_field("WARC-Record-ID")).alias("id"), "payload_bytes", "record_type", warc.record_number(warc.header_field("WARC-Refers-To")).alias("of")).collect()
        assert len(got) == frame.count()
        if name == "some":
            of = {(r["id"], r["record_type"], r["of"], r["payload_bytes"]) for r in got}
            size = len(long_html.encode())
            assert {(3, "response", None, size), (9, "revisit", 3, size), (1, "response", None, 0), (2, "revisit", 1, 0), (10, "response", None, 1)} <= of
            assert spark.read.parquet(f"{path}/payloads").count() == 3
