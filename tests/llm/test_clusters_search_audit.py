"""Integer clustering, benchmark search and filter audit against plain versions, and on odd input."""

import hashlib
import random
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from tagmill.llm import benchmark_search, bitmaps, centroid_clustering, filter_audit, line_dedup
from tests import oracle


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# ------------------------------------------------------------------ op11


def plain_clusters(rows, k, rounds, width, scale, seed):
    kept = [(i, [int(np.floor(scale * float(v))) for v in e]) for i, e in rows if e is not None and len(e) == width and all(v is not None and np.isfinite(v) for v in e)]
    start = sorted(kept, key=lambda r: (r[0] is None, sha(f"{seed}:{r[0]}") if r[0] is not None else "", r[1]))[:k]
    centroids = [list(x) for _, x in start]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        own = [near(x)[1] for _, x in kept]
        for c in range(len(centroids)):
            members = [x for (_, x), o in zip(kept, own) if o == c]
            if members:
                centroids[c] = [sum(col) // len(members) for col in zip(*members)]
    placed = [(i, *near(x)[::-1]) for i, x in kept]
    inertia = [sum(d for _, c, d in placed if c == n) for n in range(len(centroids))]
    return sorted(((i, c, d, inertia[c], sum(inertia), sha(",".join(map(str, centroids[c])))) for i, c, d in placed), key=repr)


@pytest.fixture(scope="module")
def vectors(spark):
    def make(rows):
        full = [(i, e, 7, [1], 2.0) for i, e in rows]
        return spark.createDataFrame(full, "vec_id long, embedding array<float>, cluster int, x array<int>, distance double")

    return make


def found_clusters(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_equal_plain_version(vectors, seed):
    rng = random.Random(seed)
    rows = [(n, [float(np.float32(rng.gauss(n % 5, 1.5))) for _ in range(4)]) for n in range(150)]
    rows += [(n, [1.0, 1.0, -1.0, -0.5]) for n in range(200, 240)]  # one common vector
    rows += [(5, rows[5][1]), (5, [0.0, -0.0, 1e-9, -1e-9])]  # a repeated row, a repeated id
    rows += [(300, None), (301, []), (302, [1.0]), (303, [1.0, None, 2.0, 3.0]), (304, [1.0, float("nan"), 2.0, 3.0]), (305, [float("inf")] * 4), (306, [-float("inf")] * 4), (None, [2.0, 2.0, 2.0, 2.0])]
    for rounds in (0, 1, 4, 30):
        got = centroid_clustering.cluster_vectors(vectors(rows), k=5, rounds=rounds, components=4, scale=16)
        assert found_clusters(got) == plain_clusters(rows, 5, rounds, 4, 16, 3)


def test_clusters_of_few_vectors(vectors):
    assert centroid_clustering.cluster_vectors(vectors([]), components=4).collect() == []
    for rows in ([(1, [1.0, 2.0, 3.0, 4.0])], [(n, [1.0] * 4) for n in range(3)], [(None, [1.0] * 4), (2, [0.0] * 4)]):
        got = centroid_clustering.cluster_vectors(vectors(rows), k=8, rounds=3, components=4)
        assert found_clusters(got) == plain_clusters(rows, 8, 3, 4, 1024, 3)
    with pytest.raises(Exception, match="beyond"):
        centroid_clustering.cluster_vectors(vectors([(1, [3e5] * 4)]), components=4).collect()


def test_products_follow_changes_only():
    rng = np.random.default_rng(3)
    x, old, new = rng.integers(-9, 9, (50, 6)), rng.integers(-9, 9, (3, 6)), None
    new = old.copy()
    new[1, [0, 4]] += 5
    got = centroid_clustering.update_products(x, x @ old.T, new - old)
    assert (got == x @ new.T).all() and (got[:, [0, 2]] == (x @ old.T)[:, [0, 2]]).all()


# ------------------------------------------------------------------ op12

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_items(docs, items, n):
    patterns = {}
    for item, text in items:
        w = plain_words(text)
        for i in range(max(1, len(w) - n + 1) if w else 0):
            patterns.setdefault(tuple(w[i : i + n]), set()).add(None if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, names = plain_words(text), set(), set()
        for length in {len(p) for p in patterns}:
            for i in range(len(w) - length + 1):
                if tuple(w[i : i + length]) in patterns:
                    hit.update(range(i, i + length))
                    names |= patterns[tuple(w[i : i + length])]
        out.append((doc, len(w), len(hit), tuple(sorted(names - {None}))))
    return sorted(out, key=repr)


def found_items(df):
    rows = df.collect()
    for r in rows:
        assert r.n_hit == sum(s.stop - s.first for s in r.spans) and all(s.first < s.stop for s in r.spans)
        assert all(a.stop < b.first for a, b in zip(r.spans, r.spans[1:]))
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in rows), key=repr)


def search_case(seed):
    rng = random.Random(seed)
    letters = ["a", "b", "ab", "Ba", "é", "7", "漢", "abcdefgh", "abcdefgi", "x" * 30]
    line = lambda n: rng.choice([" ", "  ", "\n", ", ", "\x00"]).join(rng.choice(letters) for _ in range(n))
    items = [(i, line(rng.choice([1, 2, 3, 4, 6, 9]))) for i in range(25)] + [(None, line(5)), (None, "a"), (3, line(4)), (90, None), (91, ""), (92, " .,-\n"), (10, items_twice := line(7)), (11, items_twice)]
    docs = [(d, line(rng.randint(0, 60))) for d in range(60)]
    docs += [(100 + i, f"{line(3)} {text} {line(3)}") for i, (_, text) in enumerate(items) if text]
    docs += [(200, None), (201, ""), (202, "..."), (None, items[0][1]), (5, docs[5][1]), (5, docs[6][1]), (203, "AB " * 4000), (204, line(9000))]
    return docs, items


@pytest.mark.parametrize("seed,window,pairs", [(1, 4, 200_000), (2, 4, 20), (3, 10, 200_000), (4, 1, 7)])
def test_search_equals_plain_windows(spark, frame, seed, window, pairs):
    docs, items = search_case(seed)
    benchmark = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, n_words long, items string")
    got = benchmark_search.find_items(frame(docs), benchmark, window, pairs)
    assert found_items(got) == plain_items(docs, items, window)


def test_search_of_odd_tables(spark, frame, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    assert found_items(benchmark_search.find_items(frame(odd), none)) == plain_items([r[:2] for r in odd], [], 10)
    items = [(1, odd[3][1]), (2, odd[8][1][:200]), (3, "é ü ß"), (4, "word word")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert found_items(benchmark_search.find_items(frame(odd), benchmark)) == plain_items([r[:2] for r in odd], items, 10)
    assert benchmark_search.find_items(frame([(1, "x")]).limit(0), benchmark).collect() == []


def test_table_jumps_and_confirms(monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(benchmark_search, "LANE", 7)
    patterns = [f" {' '.join(rng.choice(['stone', 'river', 'cloud', 'tree']) for _ in range(6))} ".encode() for _ in range(20)]
    patterns = list(dict.fromkeys(patterns))
    table = benchmark_search.Table(patterns, np.arange(len(patterns)))
    assert table.shift.max() == table.least - table.width + 1 and (table.shift == 0).sum() <= len(patterns)
    text = b"".join(rng.choice([b" stone", b" river", b" cloud", b" tree"]) for _ in range(3000)) + b" "
    data = np.frombuffer(text + bytes(benchmark_search.WIDEST), np.uint8)
    at, which = table.search(data)
    want = {(m.start(), i) for i, p in enumerate(patterns) for m in re.finditer(b"(?=" + re.escape(p) + b")", text)}
    assert len(at) == len(want) and set(zip(at.tolist(), which.tolist())) == want


def test_blocks_keep_texts_apart():
    texts = ["a b", None, "", "B a", "..", "é1"] * 50
    for limit in (1, 10, 1 << 20):
        got = []
        for b in benchmark_search.canonical_blocks(pa.array(texts), limit):
            raw = b.data.tobytes()
            got += [[raw[s:e].decode() for s, e in zip(b.starts[i:j], b.stops[i:j])] for i, j in zip(b.first[:-1], b.first[1:])]
        assert got == [plain_words(t) for t in texts]


# ------------------------------------------------------------------ op13


def plain_audit(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    first = {}
    for d, text, *_ in docs:
        if d is not None:
            first[text or ""] = min(d, first.get(text or "", d))
    rows = []
    for d, text, lang in docs:
        t = text or ""
        w = [x.decode("utf-8", "surrogatepass") for x in t.encode().split()]
        fails = {f for f, bad in zip("ABCDE", (
            len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), bool(set(t) & set("#$%&*|")),
            d is not None and d > first[t],
        )) if bad}
        rows.append((lang or "", fails, d in good, d in toxic))
    out = []
    for part in {r[0] for r in rows}:
        own, shapley, mine = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0), []
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                failing = [r for r in own if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                mine.append((part, order, step, len(left), len(gone), len(failing) - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone), f))
        out += [(*r[:-1], shapley[r[-1]]) for r in mine]
    return sorted(out)


def test_audit_equals_plain_version(spark, frame, odd):
    rng = random.Random(6)
    line = lambda n: " ".join(rng.choice(["w%d", "W%d", "V%d", "x%d"]) % rng.randint(0, 300) for _ in range(n))
    docs = [(d, line(rng.randint(60, 140)) + rng.choice(["", " #", " a|b"]), rng.choice(["en", "de", None])) for d in range(120)]
    docs += [(200 + i, docs[3][1], rng.choice(["en", "fr"])) for i in range(30)]  # copies over languages
    docs += [(3, docs[3][1], "en"), (3, "other text", "en"), (None, docs[3][1], "en"), (None, None, None), (None, "no id", "en"), (201, docs[3][1], "fr")]
    docs += [(1000 + (r[0] or 0), r[1], (r[2:] or ("en",))[0]) for r in odd] + [(999, None, "zz"), (998, "", "zz")]
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for d in range(0, 230, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (10**6, 1, 1), (1004, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit_filters(frame([(d, t, lang, "s") for d, t, lang in docs]), table)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r) for r in got.collect()) == plain_audit(docs, labels)


def test_audit_of_empty_tables(spark, frame):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(frame([(1, "x")]).limit(0), labels).collect() == []
    got = filter_audit.audit_filters(frame([(1, "x")]), labels).collect()
    assert len(got) == 600 and {r.part for r in got} == {"en"} and sum(r.removed for r in got) == 120


def test_contraction_equals_sums():
    tensor = np.random.default_rng(7).integers(0, 100, (2,) * 5)
    for name, chosen in filter_audit.selectors().items():
        got = filter_audit.contract(tensor, chosen)
        for r in random.Random(8).sample(range(600), 20):
            want = sum(tensor[i] * np.prod([chosen[r, a, i[a]] for a in range(5)]) for i in np.ndindex(tensor.shape))
            assert got[r] == want, name


@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op12_benchmark_search", "op13_filter_audit"])
def test_query_equals_its_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    assert oracle.compare(spark, oracle.connect(sf), name, entry.queries()[name], entry.oracle_sql()[name], sf) is None


# ------------------------------------------------------------------ line filters


def test_line_filters_follow_the_number_of_lines(frame, monkeypatch):
    lines = [(d, "\n".join(f"line {d} {i}" for i in range(200))) for d in range(100)]
    docs = frame(lines).select("doc_id", "text")
    bits = line_dedup.filter_bits(docs)
    assert bits == line_dedup.LEAST_BITS
    monkeypatch.setattr(line_dedup, "LEAST_BITS", 1 << 10)
    bits = line_dedup.filter_bits(docs)
    assert 20_000 * line_dedup.BITS_PER_LINE <= bits < 40_000 * line_dedup.BITS_PER_LINE
    packed = line_dedup.twice_seen(docs.select("doc_id", "text"), 1, bits)
    h = np.array([line_dedup._hash(f"line {d} {i}".encode()) for d in range(100) for i in range(200)], np.uint64).view(np.int64)
    a, b = line_dedup._places(h, bits)
    assert (bitmaps.test(packed, a) & bitmaps.test(packed, b)).mean() < 0.1  # keys of one document that would be shuffled
    monkeypatch.setattr(line_dedup, "MOST_BITS", 1 << 12)
    assert line_dedup.filter_bits(docs) == 1 << 12
    assert line_dedup.filter_bits(docs.limit(0)) == 1 << 10
