"""Operators on documents: brute force, edge cases, held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fareflow import llm
from fareflow.llm import langid, mixing, packing, pii, quality, simhash, toxicity
from fareflow.llm.common import crc32_mod
from fareflow.llm.components import components, meet

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 200_000
EDGE = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t", "en", "a", 3), (4, "Café naïve. ", "fr", None, 12), (5, LONG, "en", "b", len(LONG)), (6, "same text here now", "en", "a", 18), (6, "same text here now", "en", "a", 18), (None, "no id at all", "en", "b", 12)]


def docs(spark, rows=EDGE, schema=DOCS):
    return spark.createDataFrame(rows, schema).repartition(3)


def texts_of(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def clash(df, *names):
    """Columns with the operators' own names."""
    return df.withColumns({n: F.lit("clash") for n in names})


@pytest.mark.parametrize("name", sorted(llm.QUERIES))
def test_queries_cover_their_table(spark, name):
    got = llm.QUERIES[name](spark, SF)
    n = {"op1": "pages", "op10": "pages", "op4": None, "op2": None}.get(name.split("_")[0], "documents")
    if n:
        assert got.count() == spark.read.parquet(f"{SF}/{n}.parquet").count()
    else:
        assert got.count() > 0


# op2


def test_token_ids_agree_with_the_library():
    rng = random.Random(1)
    samples = ["", " ", "a\n\n b", "<|endoftext|>", "x<|endoftext|>y", "naïve été ß", "日本語 text", "a" * 3000, "1234 56", "\u00a0\u2003x", "don't WE'LL"]
    samples += ["".join(rng.choice("ab é\n 1.'\u024f\u0250\u3042😀") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    for s in samples:
        assert packing.token_ids(s).tolist() == packing.token_ids(s, same_as=None).tolist(), s


def test_token_ids_of_long_runs():
    """Blanks beyond the stack of the fast encoder's pattern."""
    for t in (" " * 1_000_000, "\n" * 1_000_000, "\u00a0" * 1_000_000, "x" + "\t" * 900_000 + "y"):
        assert (packing.token_ids(t) == packing.token_ids(t, same_as=None)).all()


def test_pieces_are_those_of_a_plain_cut(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, t in texts_of(spark).items():
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) if len(ids) <= 1024 else (len(ids) % 1024 or 1024)
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, p] = (a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b])))
    rows = llm.QUERIES["op2_packing"](spark, SF).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    check_packing(rows, 1024)


def test_packing_deals_equal_rows_and_says_what_is_certified(spark):
    equal = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(30).cast("long").alias("length"), F.lit("x").alias("offset"))
    packed = packing.pack(equal, 100, per_partition=500)
    rows = packed.collect()
    assert check_packing(rows, 100) <= 1334 + 8 and packed.columns == ["doc_id", "length", "sequence_id", "offset", "certified"]
    assert len({r["sequence_id"] >> 32 for r in rows}) >= 6  # partitions, although all rows are equal
    assert all(r["certified"] for r in rows)
    gap = spark.createDataFrame([(i, x) for i, x in enumerate((44, 24, 24, 22, 21, 17, 8, 8, 6, 6))], "id long, length long")  # three sequences would do
    got = packing.pack(gap, 60).collect()
    assert check_packing(got, 60) == 4 and {r["length"] for r in got if r["certified"]} == {22, 21, 17}


def test_pieces_and_bounds():
    assert [p[1:3] for p in packing.pieces_of(np.arange(10, dtype="u4"), 4)] == [(0, 2), (2, 4), (6, 4)]
    assert [p[1:3] for p in packing.pieces_of(np.arange(8, dtype="u4"), 4)] == [(0, 4), (4, 4)]
    rng = np.random.default_rng(2)
    for _ in range(60):
        lengths = rng.integers(1, 21, rng.integers(1, 9))
        bins, offsets, n = packing.best_fit_decreasing(lengths, 20)
        best = _fewest(sorted(lengths.tolist(), reverse=True), 20)
        assert packing.lower_bound(np.bincount(lengths, minlength=21), 20) <= best <= n
        assert all(lengths[bins == b].sum() <= 20 for b in range(n))


def _fewest(lengths, size):
    """By trying every way."""
    best = len(lengths)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= lengths[i]:
                go(i + 1, [*rooms[:k], rooms[k] - lengths[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, size - lengths[i]])

    go(0, [])
    return best


def check_packing(rows, size):
    at = {}
    for r in rows:
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in at.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= size
    return len(at)


def test_packing_edge_rows_and_exchange(spark):
    rows = packing.pack_documents(clash(docs(spark), "piece", "offset")).collect()
    check_packing(rows, 1024)
    ids = Counter(r["doc_id"] for r in rows if r["piece"] == 0)
    assert ids == Counter(r[0] for r in EDGE)
    tokens = packing.token_ids(LONG, same_as=None).size + 1
    assert sum(r["length"] for r in rows if r["doc_id"] == 5) == tokens
    pieces = spark.range(3000).select(F.col("id").alias("doc_id"), (F.pmod(F.xxhash64("id"), F.lit(90)) + 11).alias("length"))
    packed = packing.pack(pieces, 100, per_partition=500)
    n = check_packing(packed.collect(), 100)
    assert packed.count() == 3000
    assert n <= 1.02 * packing.lower_bound(np.bincount([r["length"] for r in pieces.collect()], minlength=101), 100) + 1
    assert packing.pack_documents(docs(spark, [])).count() == 0


# op3


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    import xxhash

    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """prints: (id, fingerprint) list."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return {doc: least[find(i)] for i, (doc, _) in enumerate(prints) if doc is not None}


def test_fingerprints_and_groups(spark):
    texts = texts_of(spark)
    got = {r["doc_id"]: r for r in llm.QUERIES["op3_simhash"](spark, SF).collect()}
    assert all(got[i]["fingerprint"] == format(brute_print(t), "016x") for i, t in texts.items())
    want = brute_components([(i, brute_print(t)) for i, t in texts.items()])
    assert {i: r["component_id"] for i, r in got.items()} == want


@pytest.mark.parametrize("per_cell", [4096, 16])
def test_links_match_all_pairs(spark, per_cell):
    """Clusters, chains and single points; small cells force the salted parts of hot leaves."""
    rng = random.Random(4)
    prints, chain = [0, (1 << 64) - 1], rng.getrandbits(64)
    for _ in range(40):
        chain ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64)) | (1 << rng.randrange(64))
        prints.append(chain)
    for _ in range(60):
        centre = rng.getrandbits(64)
        prints += [centre, centre ^ sum(1 << b for b in rng.sample(range(64), 4)), centre ^ sum(1 << b for b in rng.sample(range(64), 5))]
    hot = rng.getrandbits(64)
    prints += [hot ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)]
    rows = list(enumerate(prints)) + [(10_000 + i, prints[i]) for i in range(20)]
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in rows]
    got = simhash.group(spark.createDataFrame(signed, "doc_id long, fp long"), per_cell=per_cell, per_leaf=4)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == brute_components(rows)


@pytest.mark.parametrize("split", [True, False])
def test_components_with_hubs(spark, split):
    """Hubs above and below the size from which their row is broadcast, with the smallest and the largest key, joined by a chain."""
    edges = [(0, i) for i in range(10, 1510)] + [(9_000, i) for i in range(2_000, 3_400)] + [(9_001, i) for i in range(4_000, 4_100)]
    edges += [(i, i + 1) for i in range(5_000, 5_040)] + [(1_509, 5_000), (5_040, 2_000), (7, 7), (8_000, 8_001)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(edges * 2, "a long, b long"), split).collect()
    assert sorted((r["node"], r["root"]) for r in got) == sorted((i, find(i)) for i in root if find(i) != i)


def test_rows_of_hot_keys_meet_once(spark):
    keys = [1] * 1500 + [2] * 1000 + list(range(3, 500)) + [None]
    rows = spark.createDataFrame(list(zip(keys, range(len(keys)))), "k long, n long")
    found = spark.createDataFrame([(k, keys.count(k), -k) for k in range(1, 400)], "k long, n long, x long")
    got = [tuple(r) for r in meet(rows, found, "k", len(keys)).collect()]
    assert sorted(got) == [(k, i, -k) for i, k in enumerate(keys) if k is not None and k < 400]
    assert sorted(map(tuple, meet(rows, found, "k", None).collect())) == sorted(got)
    none = rows.where("false")
    assert meet(none, none.groupBy("k").agg(F.count("*").alias("n"), F.min("n").alias("x")), "k", 0).count() == 0


def test_blocks_cover_every_radius():
    for radius in range(13):
        for n in (10, 10**6, 10**8):
            blocks = simhash.cover(radius, n)
            assert sorted(p for places, _ in blocks for p in places) == list(range(64))
            assert sum(reach for _, reach in blocks) + len(blocks) > radius


def test_partners_meet_in_a_leaf():
    """Whatever 4 bits differ, in data that fill the space unevenly."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 62, 20000, dtype=np.uint64) & rng.integers(0, 1 << 62, 20000, dtype=np.uint64)
    y = x.copy()
    for _ in range(4):
        y ^= np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64)
    blocks = simhash.cover(4, 10**6)
    met = np.zeros(len(x), bool)
    for (places, _), tree in zip(blocks, simhash.plant(blocks, 10**6, x[:4096, None])):
        at = [set() for _ in x]
        for row, leaf in zip(*tree.leaves(simhash.gather(x[:, None], places))):
            at[row].add(leaf)
        for row, leaf in zip(*tree.leaves(simhash.gather(y[:, None], places))):
            met[row] |= leaf in at[row]
    assert met.all()


def test_trees_grow_far_less_than_pairs():
    """Rows after sharding and salting: less than five times as many for four times the fingerprints."""

    def rows(n):
        x = np.random.default_rng(1).integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1)
        blocks, total = simhash.cover(4, n), 0
        for (places, _), tree in zip(blocks, simhash.plant(blocks, n, x[:16384, None])):
            size = np.unique(tree.leaves(simhash.gather(x[:, None], places))[1], return_counts=True)[1]
            total += (size * np.where(size > 8192, -(-size // 4096), 1)).sum()
        return total

    assert rows(4_000_000) < 5 * rows(1_000_000)


def test_shared_elements_match_set_intersections():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 62, 80, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(80) < 0.8], rng.integers(0, 50, rng.integers(0, 9)).astype(np.uint64)])) for _ in range(60)] + [np.empty(0, np.uint64)]
    want = [[len(np.intersect1d(a, b)) if i < j else 0 for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    assert simhash.shared(sets, often=20, step=500).tolist() == simhash.shared(sets).tolist() == want


def test_similar_copies_go_and_others_stay(spark):
    rng = random.Random(12)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(300)] for _ in range(40)]
    rows = []
    for i, words in enumerate(base):
        changed = list(words)
        for at in rng.sample(range(300), 3):  # 15 of 296 shingles differ: similarity 0.9
            changed[at] = "new"
        half = words[:150] + [f"v{rng.randrange(10**6)}" for _ in range(150)]  # similarity 0.33
        rows += [(i, " ".join(words)), (100 + i, " ".join(changed)), (200 + i, " ".join(half)), (300 + i, " ".join(words).upper())]
    rows += [(1000 + i, f"short text number {i}") for i in range(50)] + [(2000, ""), (2001, None)]
    d = docs(spark, [(i, t, "en", "a", 1) for i, t in rows])
    kept = {r["doc_id"] for r in simhash.without_near_duplicates(d).collect()}
    assert kept == {*range(40), *range(200, 240), *range(1000, 1050), 2000}


def brute_similar(rows):
    """id: component of all pairs of five-word shingles' Jaccard similarity of 0.8 or more, by trying all."""
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in rows for w in [t.lower().split()]}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(sets):
        for j in sets:
            if j < i and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize(("per_cell", "cluster_rows"), [(8192, 1024), (64, 40)])
def test_similar_groups_are_those_of_all_pairs(spark, per_cell, cluster_rows):
    """Pairs from 0.75 to 0.86, and a large group of copies of one text; small cells and clusters force salted parts."""
    rng = random.Random(21)
    rows = []
    for i in range(120):
        words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        same = round(404 * 2 * (s := 0.75 + 0.11 * i / 120) / (1 + s)) - 8  # a changed tail leaves that many shingles the same
        rows += [(i, " ".join(words)), (1000 + i, " ".join(words[:same] + [f"v{rng.randrange(10**6)}" for _ in range(400 - same)]))]
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    for i in range(150):
        changed = list(base)
        for at in rng.sample(range(300), 6):
            changed[at] = f"v{rng.randrange(10**6)}"
        rows.append((2000 + i, " ".join(changed)))
    want = brute_similar(rows)
    assert 20 < sum(want[1000 + i] == i for i in range(120)) < 100
    got = simhash.similar_groups(docs(spark, [(i, t, "en", "a", 1) for i, t in rows]), per_cell=per_cell, per_leaf=16, cluster_rows=cluster_rows)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == want


def test_repeated_ids_lose_no_text(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    rows = [(1, two), (5, one), (5, two), (5, three), (5, three), (6, one)]
    kept = simhash.without_near_duplicates(docs(spark, [(i, t, "en", "a", 1) for i, t in rows])).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(1, two), (5, one), (5, three)]


def test_near_duplicate_edges(spark):
    rows = simhash.near_duplicates(clash(docs(spark), "fp", "fingerprint", "component_id")).collect()
    assert len(rows) == len(EDGE)
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["fingerprint"] == by[2]["fingerprint"] == by[3]["fingerprint"] == "0" * 16
    assert {by[i]["component_id"] for i in (1, 2, 3)} == {1}
    kept = simhash.without_near_duplicates(docs(spark))
    assert kept.columns == docs(spark).columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 4, 5, 6, None])
    assert simhash.near_duplicates(docs(spark, [])).count() == simhash.without_near_duplicates(docs(spark, [])).count() == 0


# op5


def brute_quality(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    c, m = Counter(zip(w, w[1:], w[2:])), [0] * len(w)
    for i in range(len(w) - 2):
        if c[tuple(w[i : i + 3])] > 1:
            m[i] = m[i + 1] = m[i + 2] = 1
    seen, dup = set(), 0
    for x in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, sum(m)


def test_quality_measures(spark):
    for t in [*texts_of(spark).values(), *[r[1] for r in EDGE[:4]], "a b c a b c", "x\nx\n\n\u2003\n\u2003", "a\x1fb\x85c d"]:
        assert quality.measure(t) == brute_quality(t)


def test_quality_verdicts(spark):
    prose = "".join(" ".join(f"word{i}x{j}" for j in range(12)) + ".\n" for i in range(6))
    assert quality.judge(prose)[-1]
    assert quality.judge(prose + "All rights reserved.\nHome | About | Contact | Login")[-1]
    assert not quality.judge("Home | About | Contact | Login | Help | More\n" * 30)[-1]
    assert not quality.judge("\n".join(f"thing&&& other%%% word{i}*** here$$$" for i in range(30)))[-1]
    assert quality.clean_text("Good line here.\nAll rights reserved.\nGood line here.")[0] == "Good line here."
    assert quality.judge(None) == quality.judge("") == (0, 0, 0, 0, 0, True, False)
    got = quality.judge_documents(clash(docs(spark), "kept", "n_words")).collect()
    assert len(got) == len(EDGE) and quality.judge_documents(docs(spark, [])).count() == 0
    cleaned = quality.clean_lines(docs(spark, [(1, prose + "All rights reserved.", "en", "a", 1), (2, None, "en", "a", 1)]))
    assert [r["text"] for r in cleaned.collect()] == [prose.rstrip("\n")] or cleaned.count() == 1


# op6


def test_mix_meets_targets(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix(clash(d, "size", "target", "taken", "copies")).collect()
    by = {}
    for r in rows:
        s = by.setdefault(r["source"], [0, 0, r["source_size"], r["target"]])
        s[0] += r["size"]
        s[1] += r["taken"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    want = _targets({k: v[0] for k, v in by.items()})
    for k, (size, taken, source_size, target) in by.items():
        assert source_size == size and target == pytest.approx(want[k]) and abs(taken - target) <= 0.01 * target
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(d.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in rows}


def _targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    budget, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [n for n in names if n not in fixed]
        left = budget - sum(fixed.values())
        share = {n: left * weight[n] / sum(weight[m] for m in open_) for n in open_}
        over = [n for n in open_ if share[n] > 2 * sizes[n]]
        if not over:
            return fixed | share
        fixed |= {n: 2.0 * sizes[n] for n in over}


def test_mix_edges_and_hot_sizes(spark):
    rows = mixing.mix(docs(spark)).collect()
    assert len(rows) == len(EDGE) and all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert mixing.mix(docs(spark, [])).count() == 0
    hot = [(i, "one two three", "en", "a", 13) for i in range(3000)] + [(5000 + i, "x " * (i % 40 + 1), "en", "b", 1) for i in range(900)]
    got = mixing.mix(docs(spark, hot), per_range=64)
    taken = {r["source"]: (r["t"], r["g"]) for r in got.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g")).collect()}
    assert all(abs(t - g) <= 3 for t, g in taken.values())
    out = mixing.mixed_documents(docs(spark, hot))
    assert out.columns == docs(spark).columns and out.count() == got.agg(F.sum("copies")).first()[0]


def test_mix_splits_equal_rows(spark):
    """A thousand rows equal in id and text: as many as the target needs, also where they fill many ranges."""
    for words, options in ((3, {}), (4, {"per_range": 16}), (4, {"per_range": 16, "broadcast_bytes": 0})):
        text = "w " * words
        d = docs(spark, [(1, text, "en", "a", 1)] * 1000 + [(2, text, "en", None, 1)] * 1000 + [(i, text, "en", "b", 1) for i in range(10, 40)])
        got = mixing.mix(d, **options).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("copies").alias("most"))
        for r in got.collect():
            assert abs(r["taken"] - r["target"]) <= words and r["most"] <= 2


def test_mixed_documents_keep_every_column(spark):
    d = docs(spark, [(i, "one two three", "en", "a", 13) for i in range(20)]).withColumns({"size": F.lit("L0"), "Target": F.lit("keep"), "copies": F.lit(9), "_c": F.lit(1)})
    out = mixing.mixed_documents(d)
    assert out.dtypes == d.dtypes
    assert {(r["size"], r["Target"], r["copies"]) for r in out.collect()} == {("L0", "keep", 9)}


def test_fill_needs_little_memory():
    import tracemalloc

    tracemalloc.start()
    take = mixing.fill([2 * i for i in range(1, 4001)], [50] * 4000, 65535)
    assert sum(2 * (i + 1) * n for i, n in enumerate(take)) == 65534
    assert tracemalloc.get_traced_memory()[1] < 8 << 20
    tracemalloc.stop()


def test_fit_is_exact_where_it_can_be():
    rng = random.Random(5)
    for _ in range(100):
        sizes = rng.sample(range(1, 60), 12)
        counts = [rng.randint(1, 6) for _ in sizes]
        budget = rng.randint(0, sum(s * c for s, c in zip(sizes, counts)))
        take = mixing.fit(sizes, counts, budget, 1 << 16, 1)
        assert all(0 <= t <= c for t, c in zip(take, counts))
        reach = {0}
        for s, c in zip(sizes, counts):
            reach = {r + s * k for r in reach for k in range(c + 1)}
        assert abs(budget - sum(s * t for s, t in zip(sizes, take))) <= min(abs(budget - r) for r in reach) + 2


# op7


def toxic_rows(n, seed):
    rng = random.Random(seed)
    syllables = "an en ou re ti sh st er ing tion ea ha".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    out = []
    for i in range(n):
        sentences = [" ".join(word() for _ in range(8)) + "." for _ in range(6)]
        bad = i % 5 == 0
        if bad:
            sentences[rng.randrange(6)] = f"{word()} {word()} {rng.choice(('idiot', 'scumbag', 'moron'))} {word()}."
        out.append((i, " ".join(sentences), int(bad)))
    return out


def test_toxicity_finds_gapped_insults(spark):
    rows = toxic_rows(400, 6)
    model = toxicity.train([t for _, t, _ in rows], [y for *_, y in rows])
    held = toxic_rows(200, 7)
    scores = model.score([t for _, t, _ in held])
    assert sum((s >= 0.7) == bool(y) for s, (_, _, y) in zip(scores, held)) >= 196
    hidden = model.score(["You are an i d i o t for sure.", "Such an id-i.o.t here.", "What an idiiot.", "A sc*umb*ag he is.", "Entire restoration."])
    assert min(hidden[:4]) >= 0.7 > hidden[4]
    assert model.score([None, "", "Clean words."]).max() < 0.7
    assert toxicity.train(["a"], [0]).score(["idiot"])[0] == 0


def test_toxicity_finds_one_inserted_letter():
    rows = [(i, t.replace("scumbag", "scum").replace("moron", "loser"), y) for i, t, y in toxic_rows(400, 6)]
    rows += [(1000 + i, f"A scrum of players entered the station {i}.", 0) for i in range(40)]
    model = toxicity.train([t for _, t, _ in rows], [y for *_, y in rows])
    inserted = [w[:k] + c + w[k:] for w in ("idiot", "scum", "loser") for k in range(1, len(w)) for c in "qxz"]
    assert {"idxiot", "scxum", "loxser"} < set(inserted)
    assert model.score([f"He is an {w} there." for w in inserted]).min() >= 0.7
    assert model.score(["The scrum was over.", "An idea is it.", "Consider it."]).max() < 0.7


def test_toxicity_learns_short_and_long_insults():
    for insult in ("git", "zx", "blockhead" * 4):
        change = lambda t: re.sub(r"\b(idiot|scumbag|moron)\b", insult, t)  # noqa: E731, B023
        model = toxicity.train([change(t) for _, t, _ in toxic_rows(400, 6)], [y for *_, y in toxic_rows(400, 6)])
        held = toxic_rows(200, 7)
        assert sum((s >= 0.7) == bool(y) for s, (*_, y) in zip(model.score([change(t) for _, t, _ in held]), held)) >= 196


def test_toxicity_kernel_matches_its_definition():
    kernel = toxicity.Kernel()
    for word in ("idiot", "idxiot", "aaaa", "ab"):
        s = [0, *toxicity.symbols(word).tolist()]
        phi = Counter()
        for i in range(len(s)):
            for k in range(i + 2, min(i + 6, len(s))):
                for j in range(i + 1, k):
                    phi[s[i] << 12 | s[j] << 6 | s[k]] += 0.6 ** (k - i - 2)
        codes, values = kernel.features(np.array(s))
        norm = sum(v * v for v in phi.values()) ** 0.5
        assert dict(zip(codes.tolist(), values.tolist())) == pytest.approx({c: v / norm for c, v in phi.items()})


def plain_kernel(a, b):
    """Common subsequences of three symbols, each weighing 0.6 for each symbol skipped, normalized."""

    def phi(w):
        out, s = Counter(), [0, *[c for c in toxicity.symbols(w).tolist() if c != toxicity.SKIP]]
        for i in range(len(s)):
            for k in range(i + 2, min(i + 6, len(s))):
                for j in range(i + 1, k):
                    out[s[i], s[j], s[k]] += 0.6 ** (k - i - 2)
        return out

    x, y = phi(a), phi(b)
    norm = (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
    return sum(v * y[c] for c, v in x.items()) / norm if norm else 0.0


def test_toxicity_scores_are_those_of_a_plain_machine():
    """Sentence features, landmark matrix, map, margins and score worked out word by word."""
    rows = toxic_rows(300, 16)
    model = toxicity.train([t for _, t, _ in rows], [y for *_, y in rows])
    marks = model.landmarks
    words = ["".join(chr(c + 96) for c in w[1:]) for w in marks.words]
    assert set(words) >= {"idiot", "scumbag", "moron"}

    def feature(word):
        k = np.array([plain_kernel(word, m) for m in words])
        x = np.where(k >= 0.55, k**3, 0)
        for j in np.flatnonzero(k >= 0.55):
            if toxicity.spelled(word) not in marks.clean and toxicity.gapped(toxicity.spelled(word), marks.words[j]):
                x = np.maximum(x, feature(words[j]))
        return x

    gram = np.array([feature(w) for w in words])
    assert marks.gram() == pytest.approx(gram, abs=1e-5)
    root = toxicity.inverse_root(gram)
    assert gram @ root @ root @ gram == pytest.approx(gram, abs=2e-2)
    for text in [t for _, t, _ in toxic_rows(40, 17)] + ["He is an idqiot. A scumbags! What a morron", "Quiet words. Nothing else."]:
        features = [np.max([feature(w) for w in re.findall(r"[a-z]+", s.lower())], axis=0) for s in re.split(r"(?<=[.!?])\s", text) if re.search("[a-z]", s.lower())]
        margins = sorted((max(0.0, f @ model.v) + model.bias if f.any() else model.bias for f in features), reverse=True)[:3]
        margins += [model.bias] * (3 - len(margins))
        margins = sorted(margins, reverse=True)
        logit = max(np.dot(margins, model.curve[:-1]) + model.curve[-1], margins[0] * model.single[0] + model.single[1])
        assert model.score([text])[0] == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-3), text


def test_toxicity_sample_is_bounded(spark):
    rows = toxic_rows(60, 8)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    d = docs(spark, [(i, t + "x" * (10_000 if i == 5 else 0), "en", "a", 1) for i, t, _ in rows])
    texts, found = toxicity.labelled_sample(d, labels, None, 50, 50, 5_000, 2_000)
    assert max(map(len, texts)) <= 5_000 and all(sum(len(t) for t, y in zip(texts, found) if y == k) <= 2_000 for k in (0, 1)) and set(found) == {0, 1}


def test_toxicity_edges(spark):
    rows = toxic_rows(60, 8)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    d = docs(spark, [(i, t, "en", "a", len(t)) for i, t, _ in rows] + [(None, None, None, None, None), (99, LONG, "en", "a", 1)])
    model = toxicity.fitted(clash(d, "score"), labels)
    assert toxicity.score_documents(d, model).count() == 62
    twice = toxicity.score_documents(d.unionAll(d), model).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("score").alias("k")).collect()
    assert all(r["n"] == 2 and r["k"] == 1 for r in twice)
    kept = toxicity.without_toxic(d, model)
    assert kept.columns == d.columns and 48 <= kept.count() <= 52
    assert toxicity.score_documents(docs(spark, []), toxicity.fitted(docs(spark, []), labels)).count() == 0


# op8


def brute_pii(t):
    out = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), m.end(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and pii.luhn(digits):
            out.append((m.start(), m.end(), 2))
    out += [(m.start(), m.end(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_pii_base_is_what_the_patterns_find(spark):
    rng = random.Random(9)
    samples = [*texts_of(spark).values(), "a@b.c@d.e", "4111 1111-1111 1111", "1.2.3.4.5.6.7.8", "+1 (202) 555-0175 x", "é@x.yz ü.a@b-c.d"]
    samples += ["".join(rng.choice("12@+. -()a.%0") for _ in range(rng.randint(1, 40))) for _ in range(20000)]
    for t in samples:
        assert [s for s in pii.find(t) if s[2] < 4] == brute_pii(t), t


def test_pii_adds_and_redacts(spark):
    t = 'Konto: DE89 3704 0044 0532 0130 00. token = "9b0b3c6a43eb78aa99cb" and ftp://joe:pw1@host/x, passport no. X1234567.'
    kinds = [pii.KINDS[k] for _, _, k in pii.find(t)]
    assert kinds == ["account", "secret", "login", "account"]
    assert "9b0b" not in pii.redact(t) and "<SECRET>" in pii.redact(t)
    assert pii.find("An accountant kept tokens: none of it.") == []
    got = {r["doc_id"]: r for r in pii.find_pii(clash(docs(spark), "spans")).collect()}
    assert got[1]["base_sha256"] == got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[1]["spans"] == ""
    d = docs(spark, [(1, "mail a@b.cd now", "en", "a", 15), (2, None, None, None, None)])
    out = {r["doc_id"]: r for r in pii.redact_documents(d).collect()}
    assert out[1]["text"] == "mail <EMAIL> now" and out[1]["n_chars"] == 16 and out[2]["text"] is None
    assert pii.find_pii(docs(spark, [])).count() == 0


def spans_of(t, kind):
    return [t[a:b] for a, b, k in pii.find(t) if pii.KINDS[k] == kind]


def test_pii_accounts_of_any_length():
    value = "X12-34" * 300
    assert spans_of(f"account no. {value} end", "account") == [value]
    assert spans_of("IBAN: DE89 3704 0044 0532 0130 00 AND MORE", "account") == ["DE89 3704 0044 0532 0130 00"]
    assert spans_of("Konto GB82WEST12345698765432, passport X1234567-", "account") == ["GB82WEST12345698765432", "X1234567"]
    assert spans_of("account of the house, iban none, passport AB12", "account") == []
    assert pii.find("IBAN " * 100_000) == pii.find("account: " * 100_000) == []


def test_pii_addresses():
    for t, want in {
        "He lives at 221B Baker Street, London.": "221B Baker Street", "1600 Pennsylvania Ave. is white": "1600 Pennsylvania Ave.", "in der Musterstraße 12a in Berlin": "Musterstraße 12a",
        "Lange Straße 7, 10115": "Lange Straße 7", "au 10 rue de la Paix, Paris": "10 rue de la Paix", "12 bis, avenue Victor Hugo": "12 bis, avenue Victor Hugo", "en Calle Mayor 25, Madrid": "Calle Mayor 25", "Avenida de América, 3.": "Avenida de América, 3",
    }.items():
        assert spans_of(t, "street") == [want], t
    for t in ("the street was long", "In 1999 the Street view", "la rue est longue", "Place de la", "3 roads and a lane", "Die Straße war lang", "rue " * 50_000, "1 A " * 50_000 + "Street"):
        assert spans_of(t, "street") in ([], ["1 A Street"]), t[:40]
    assert spans_of("from 2001:db8:85a3::8a2e:370:7334 and fe80::1:2, ::1", "ipv6") == ["2001:db8:85a3::8a2e:370:7334", "fe80::1:2"]
    assert spans_of("1:2:3:4:5:6:7:8 or 12:30:45, a::b, std::vector, x:1:2:3:4:5:6:7:8", "ipv6") == ["1:2:3:4:5:6:7:8"]
    assert pii.find("a:" * 200_000) == [] and pii.redact("at fe80::1:2 now") == "at <IPV6> now"


def test_pii_secrets_of_any_length():
    value = "a1B2c3" * 500
    for t in (f'token = "{value}" end', f"password: '{value}' end", f"secret={value} end"):
        assert [pii.KINDS[k] for _, _, k in pii.find(t)] == ["secret"]
        assert value[:20] not in pii.redact(t) and value[-20:] not in pii.redact(t)
    run = "token=" * 100_000  # looked through once, not once for each cue
    assert pii.find(run) == []
    assert pii.redact(f'{run}"{value}" end').endswith('"<SECRET>" end')


# op9


def test_language_accuracy_and_edges(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = langid.fitted(d, crc32_mod("doc_id", 5) != 0, train_rows=150)
    held = [r for r in d.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["lang"]]
    found, scores = net.predict([r["text"] for r in held])
    assert sum(a == r["lang"] for a, r in zip(found, held)) >= 0.97 * len(held)
    assert all(0 <= s <= 1 for s in scores)
    assert net.predict([None, "", "123 !"]) == (["und"] * 3, [0.0] * 3)
    rows = langid.identify(clash(docs(spark), "score", "lang_pred"), net).collect()
    assert len(rows) == len(EDGE)
    assert langid.fitted(docs(spark, [])).predict(["text"]) == (["und"], [0.0])
    assert langid.identify(docs(spark, []), net).count() == 0
    long = ["word" * 300_000, " " * 1_000_000, "\n".join(["wort"] * 200_000)]  # a megabyte without blanks, and one of nothing else
    assert net.predict(long)[0][1] == "und" and net.predict(long)[1][0] > 0


def test_language_scores_are_those_of_a_plain_network():
    """Windows, filters, maxima and softmax worked out byte by byte."""
    net = langid.train(["the cat and the dog went home " * 20, "der hund und die katze gehen heim " * 20] * 6, ["en", "de"] * 6, filters=3, window=32, epochs=2)

    def logits(window):
        best = []
        for w, table in zip(net.widths, net.tables):
            sums = [[sum(float(table[k][window[i + k]][f]) for k in range(w)) for f in range(3)] for i in range(len(window) - w + 1)]
            best += [max(0.0, max(s[f] for s in sums)) for f in range(3)]
        return [sum(b * float(net.out[i][c]) for i, b in enumerate(best)) + float(net.out[-1][c]) for c in range(2)]

    for text in ("the dog", "Die Katze, 12 und der Hund! " * 4, "x" * 33, "und the " * 8):
        raw = [b if b >= 128 or chr(b).isalpha() else 32 for b in text.lower().encode()]
        starts = range(0, len(raw), 32) if len(raw) > 32 else [0]
        total = [0.0, 0.0]
        for s in starts:
            part = raw[max(0, min(s, len(raw) - 32)) :][:32]
            share = min(32, len(raw) - s) / len(raw) if len(raw) > 32 else 1
            for c, z in enumerate(logits(part + [0] * (32 - len(part)))):
                total[c] += share * z
        p = np.exp(total) / np.exp(total).sum()
        (label,), (score,) = net.predict([text])
        assert label == net.languages[int(p.argmax())] and score == pytest.approx(p.max(), abs=1e-4)


def test_every_language_can_be_learned(spark):
    """More languages than rows to learn from in all: one document each; and a hot id doesn't crowd out the others."""
    rows = [(i, f"text of {i % 30} " * 3, f"l{i % 30:02d}", "a", 1) for i in range(300)] + [(7, "again and again", "l07", "a", 1)] * 500
    texts, labels = langid.labelled_sample(docs(spark, rows), None, 600, 60, 100)
    assert {f"l{i:02d}" for i in range(30)} == set(labels) and Counter(labels)["l01"] == 2
