"""Operators on pages and vectors, and the pipeline."""

import base64
import hashlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from fareflow.llm import ann, toxicity, url_filter, warc

SF = "/root/testdata/sf0.001"
URLS = [None, "", "no scheme", "http://", "http://COM/en/x", "http://a.Example.com/en/7?q=/en/", "http://a.example.com/en/8", "http://xexample.com/en/7", "https://b.net/de/1#f", "https://example.net/de/80", "http://org?x/es/", "ftp://x.org/es/", "x://a.com/e", "http://a.com/en/://b.net/de/"]


def brute_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = tail[: min([i for i in (tail.find(c) for c in "?#") if i >= 0], default=len(tail))]
    fit = [(len(h + p), h + p, a) for h, p, a in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best[1] if best else None, best[2] if best else "allow"


def rules(spark):
    return spark.createDataFrame(list(url_filter.RULES), "host string, path string, action string")


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0}, {"max_filter_bytes": 32}])
def test_url_rules(spark, options):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(3, "http://com/en/x"), (None, "http://com/en/x")], "page_id long, url string").withColumns({"rule": F.lit(1), "keys": F.lit(2)})
    got = url_filter.filter_urls(pages, rules(spark), **options).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute_url(r["url"]), r["url"]
    assert url_filter.filter_urls(pages.limit(0), rules(spark)).count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(pages, rules(spark).limit(0)).collect()} == {"allow"}


def test_bloom_has_no_false_negatives():
    rng = np.random.default_rng(1)
    keys, others = rng.integers(-(2**63), 2**63, 5000), rng.integers(-(2**63), 2**63, 50000)
    blocks = url_filter.BlockedBloom.blocks_for(5000, 16, 1 << 20)
    words = np.zeros((blocks, 8), np.uint32)
    at, masks = url_filter.BlockedBloom.place(keys, blocks)
    np.bitwise_or.at(words, at, masks)
    bloom = url_filter.BlockedBloom(words)
    assert bloom.may_have(keys).all() and bloom.may_have(others).mean() < 0.01
    assert url_filter.BlockedBloom.blocks_for(10**9, 16, 1 << 20) * 32 <= 1 << 20


def test_archive_round_trip(spark, tmp_path):
    pages = [(5, "http://a/", "<p>é</p>"), (3, "http://b/\r\nX: 1", "<p>é</p>"), (3, "http://b/\r\nX: 1", "<p>é</p>"), (1, None, None), (2, "u", ""), (None, "u", "only"), (9, "u", "x" * 300_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)
    archive = warc.write_archive(df, f"{tmp_path}/a")
    got = sorted(archive.index().collect(), key=lambda r: (r["page_id"] is None, r["page_id"], r["record_type"]))
    digest = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    assert [(r["page_id"], r["record_type"], r["refers_to"]) for r in got] == [(1, "response", None), (2, "revisit", 1), (3, "response", None), (3, "revisit", 3), (5, "revisit", 3), (9, "response", None), (None, "response", None)]
    assert [r["payload_digest"] for r in got] == [digest(s) for s in ("", "", "<p>é</p>", "<p>é</p>", "<p>é</p>", "x" * 300_000, "only")]
    assert got[5]["payload_bytes"] == 300_000 and archive.payloads.count() == 4
    records = [bytes(r["record"]) for r in archive.records().collect()]
    assert len(records) == 7
    for r in records:
        head, _, body = r.partition(b"\r\n\r\n")
        length = int([x for x in head.split(b"\r\n") if x.startswith(b"Content-Length")][0].split(b": ")[1])
        assert len(body) == length + 4 and body.endswith(b"\r\n\r\n") and head.startswith(b"WARC/1.1\r\n")
    originals = [bytes(r["record"]).partition(b"\r\n\r\n")[2].partition(b"\r\n\r\n")[2] for r in archive.originals().collect()]
    assert sorted(originals) == sorted((h or "").encode() + b"\r\n\r\n" for *_, h in pages)
    small = warc.write_archive(df, f"{tmp_path}/b", min_payload=9).index()
    assert small.where("record_type = 'revisit'").count() == 2
    assert warc.write_archive(df.limit(0), f"{tmp_path}/c").index().count() == 0


def test_archive_notices_damage(spark, tmp_path):
    archive = warc.write_archive(spark.createDataFrame([(1, "u", "good")], "page_id long, url string, html string"), f"{tmp_path}/a")
    bad = zstandard.ZstdCompressor().compress(b"bad")
    archive.stored.select("digest", F.lit(bad).alias("frame")).coalesce(1).write.parquet(f"{tmp_path}/b/payloads")
    archive.heads.write.parquet(f"{tmp_path}/b/heads")
    for read in (lambda a: a.index(), lambda a: a.payloads):
        with pytest.raises(Exception, match="damaged payload"):
            read(warc.Archive(spark, f"{tmp_path}/b")).collect()
    archive.stored.limit(0).write.parquet(f"{tmp_path}/c/payloads")
    archive.heads.write.parquet(f"{tmp_path}/c/heads")
    with pytest.raises(Exception, match="no payload"):
        warc.Archive(spark, f"{tmp_path}/c").index().collect()


def test_archive_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    first = {}
    for r in sorted(rows, key=lambda r: r["page_id"]):
        first.setdefault(r["html"] or "", r["page_id"])
    want = {}
    for r in rows:
        payload = (r["html"] or "").encode()
        own = first[r["html"] or ""]
        want[r["page_id"]] = (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if own == r["page_id"] else "revisit", None if own == r["page_id"] else own)
    assert {r["page_id"]: tuple(r)[1:] for r in warc.op10_warc(spark, SF).collect()} == want


def brute_nearest(ids, x, asked, k):
    out = {}
    for q in asked:
        s = x @ x[ids.index(q)]
        order = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-s[i], ids[i]))[:k]
        out[q] = [(ids[i], s[i]) for i in order]
    return out


def test_neighbours_recall_and_scores(spark):
    t = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").toArrow().to_pydict()
    ids, x = t["vec_id"], np.array(t["embedding"], dtype=np.float64)
    x *= np.linspace(0.5, 2, len(x))[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, cell_rows=40).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute_nearest(ids, x, [i for i in ids if i % 20 == 0], 20)
    hits = 0
    for q, near in want.items():
        mine = sorted(got[q])
        assert [r for r, *_ in mine] == list(range(1, 21))
        assert all(s == pytest.approx(float(x[ids.index(q)] @ x[ids.index(v)]), abs=1e-12) for _, v, s in mine)
        hits += len({v for _, v, _ in mine} & {v for v, _ in near})
    assert hits >= 0.9 * 20 * len(want)


def test_neighbours_recall_of_the_query(spark):
    """All queries of 2,000 vectors, with the parameters of the registered query."""
    t = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toArrow().to_pydict()
    ids, x = t["vec_id"], np.array(t["embedding"], dtype=np.float64)
    want = brute_nearest(ids, x, [i for i in ids if i % 20 == 0], 20)
    got = ann.op4_ann(spark, "/root/testdata/sf0.1").collect()
    assert len(got) == 20 * len(want)
    assert sum(r["vec_id"] in {v for v, _ in want[r["query_id"]]} for r in got) >= 0.95 * len(got)


def test_neighbours_edges(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (8, [float("inf"), 0.0]), (20, [0.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"list": F.lit("x"), "score": F.lit(1)})
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 0, 0.0), (20, 3, 1, 0.0), (20, 4, 2, 0.0)]
    other = df.unionByName(spark.createDataFrame([(40, [0.0, 0.0, 2.0]), (60, [1.0] * 5)], "vec_id long, embedding array<double>").withColumns({"list": F.lit("x"), "score": F.lit(1)}))
    got = [tuple(r) for r in ann.search(other, F.col("vec_id") >= 40).collect()]
    assert got == [(40, 1, 7, 6.0)]  # vectors of its own length only
    many = spark.range(700).select(F.col("id").alias("vec_id"), F.array(F.cos("id"), F.sin("id"), F.lit(0.5)).alias("embedding"))
    equal = many.unionAll(spark.range(1000, 1500).select("id", F.array(F.lit(1.0), F.lit(0.0), F.lit(0.5))))  # a list of equal vectors, cut
    got = ann.search(equal, F.col("vec_id") == 1001, k=5, cell_rows=50).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got] == [(1, 0, 1.25), (2, 1000, 1.25), (3, 1002, 1.25), (4, 1003, 1.25), (5, 1004, 1.25)]
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, SF)
        assert out.columns == docs.columns, name
        seen = spark.createDataFrame(out.toPandas(), docs.schema)
        assert seen.count() > 0
    ids = {r["doc_id"] for r in seen.select("doc_id").collect()}
    packed = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in packed.collect()} == ids
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, SF).collect()}
    clean = [i for i, y in labels.items() if y == 0]
    assert sum(i in kept for i in clean) >= 0.95 * len(clean)
    assert isinstance(toxicity.Model(None).score(["x"])[0], float)


def write_tables(spark, folder, rows, labels):
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = {"size": F.lit("L0"), "target": F.lit("keep"), "offset": F.lit(1), "Sequence_id": F.lit(2), "score": F.lit("x"), "node": F.lit("n"), "t": F.lit(0), "spans": F.array(F.lit(1))}
    d.withColumns(extra).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_pipeline_edges(spark, tmp_path):
    prose = lambda i, n=60: " ".join(f"w{(i * 7919 + k * 104729) % 1_000_003}" for k in range(n))
    long = [" ".join(f"v{k}" for k in range(150_000)), "x" * 1_200_000, " " * 1_000_000, "ab" * 400_000 + " mail a@b.cd"]
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, prose(3), "en", "a", 5), (3, prose(3), "en", "a", 5), (4, prose(3), "en", None, 5), (None, prose(5), None, "b", 1), (None, prose(5), None, "b", 1)]
    rows += [(20 + i, t, "en", "b", len(t)) for i, t in enumerate(long)] + [(100 + i, prose(100 + i, 5 + i % 4), "de", "abc"[i % 3], 7) for i in range(80)]
    documents = write_tables(spark, f"{tmp_path}/a", rows, [(3, 1, 0), (None, 1, 1), (100, None, None)])
    seen, kept = documents, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, f"{tmp_path}/a")
        assert seen.dtypes == documents.dtypes, name
        seen.write.parquet(f"{tmp_path}/{name}")
        seen = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = sorted((r["doc_id"] or 0 for r in seen.collect()))
        assert {(r["size"], r["target"], r["offset"], r["score"]) for r in seen.collect()} == {("L0", "keep", 1, "x")}
    assert len(kept["toxicity"]) == len(rows)
    # 1 and 2 and the blanks are alike, 3 and 4; rows without an id all stay
    assert kept["near duplicates"] == sorted([1, 3, 20, 21, 23, 0, 0, *range(100, 180)]) and kept["personal data"] == kept["near duplicates"]
    assert all("a@b.cd" not in r["text"] for r in spark.read.parquet(f"{tmp_path}/personal data").where("text is not null").collect())
    packed = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    assert {r["doc_id"] or 0 for r in packed} == set(kept["mixing"])
    write_tables(spark, f"{tmp_path}/none", [], [])
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_checkpoints_need_a_shared_folder_on_a_cluster(spark):
    from types import SimpleNamespace

    from fareflow.llm import common

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_folder(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None)))
