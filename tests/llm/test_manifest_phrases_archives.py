"""Merkle manifest, phrase collocations and WARC archives against plain versions, and on the cases each has to define."""

import gzip
import hashlib
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotemill.llm import merkle, phrases, queries, warc
from tests.llm import brute

LOWERED = lambda: F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
DOC = "doc_id long, source string, lang string, n_chars long, text string"


# --- manifest -----------------------------------------------------------------------------------


def tamper(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def run_manifest(docs):
    return merkle.manifest(docs, F.crc32(F.col("doc_id").cast("string")) % 5 == 0, {"text": LOWERED()})


def found(rows):
    return {r.doc_id: (r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) for r in rows.collect()}


@pytest.mark.parametrize("sizes", [[1], [16], [17], [1, 2, 300], [5, 256, 257], [1] * 20 + [600]])
def test_manifest(spark, sizes):
    rows, at = [], 0
    for s, size in enumerate(sizes):
        source = None if s == 1 else f"é{s}"
        for _ in range(size):
            rows.append((at * 7 % 99_991, source, None if at % 3 else "de", at, None if at % 11 == 0 else f"Text {at} Ünï" * (at % 4)))
            at += 1
    docs = spark.createDataFrame(rows, DOC).repartition(3)
    got, _ = run_manifest(docs)
    want = brute.manifest(rows, tamper)
    assert found(got) == want
    assert {r.doc_id: r.verified for r in got.collect()} == {i: w[2] == w[4] for i, w in want.items()}


def test_versions_share_all_nodes_but_their_ancestors(spark):
    rows = [(i, f"s{i % 3}", "en", i, f"Text {i}") for i in range(900)]
    got, nodes = run_manifest(spark.createDataFrame(rows, DOC))
    shared = {(r.source, r.top, r.level, r.place): r.digest for r in nodes.collect()}
    sources = sorted({r[1] for r in rows})
    for number, s in enumerate(sources):
        levels = brute.tree([brute.sha(*r) for r in rows if r[1] == s])
        for level, digests in enumerate(levels[1:], 1):
            assert [shared[s, False, level, p] for p in range(len(digests))] == digests
    for r in got.where("copied IS NOT NULL").limit(20).collect():
        # the version's tree: its own nodes over the shared ones
        own = {(None if c.top else r.source, c.top, c.level, c.place): c.digest for c in r.copied}
        assert len(own) == 4 and set(own) <= set(shared)
        mine = [x for x in rows if x[1] == r.source]
        leaves = [brute.sha(*x[:4], x[4].lower()) if x[0] == r.doc_id else brute.sha(*x) for x in mine]
        levels = brute.tree(leaves)
        version = shared | own
        for level, digests in enumerate(levels[1:], 1):
            assert [version[r.source, False, level, p] for p in range(len(digests))] == digests
        assert version[None, True, 1, 0] == r.folded_root != r.root


def test_manifest_edge_cases(spark):
    clash = spark.createDataFrame(
        [(None, None, None, None, None, 1, 2), (3, "", "x", 0, "", 1, 2), (3, "", "x", 0, "", 1, 2), (4, "-", "x", 9, "A" * 200_000, 1, 2)],
        DOC + ", place int, tree int",
    )
    rows = {(r.doc_id, r.place): r for r in run_manifest(clash)[0].collect()}
    assert set(rows) == {(None, 0), (3, 0), (3, 1), (4, 0)}
    assert rows[3, 0].leaf == rows[3, 1].leaf and rows[3, 0].subroot == hashlib.sha256((rows[3, 0].leaf * 2).encode()).hexdigest()
    assert rows[4, 0].source == "-" and rows[None, 0].source is None and rows[None, 0].subroot == rows[None, 0].leaf
    tops = [rows[k].subroot for k in ((None, 0), (3, 0), (4, 0))]
    assert {r.root for r in rows.values()} == {hashlib.sha256("".join(tops).encode()).hexdigest()}
    got, nodes = run_manifest(clash.where("false"))
    assert got.count() == nodes.count() == 0


# --- phrases ------------------------------------------------------------------------------------


def run_phrases(spark, rows, **options):
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    return sorted(tuple(r) for r in phrases.collocations(docs, **options).collect())


@pytest.mark.parametrize("seed, top, margin", [(0, 2000, 0.5), (1, 15, 0.5), (2, 5, 1.0), (3, 40, 0.9), (4, 1, 0.5)])
def test_phrases(spark, seed, top, margin):
    rng = np.random.default_rng(seed)
    words = [f"W{i}" for i in range(40)] + ["Ü", "a\x00b"]
    share = 1 / np.arange(1, len(words) + 1)
    rows = []
    for d in range(60):
        text = "".join(w + str(rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n"])) for w in rng.choice(words, 80, p=share / share.sum()))
        rows.append((["en", "de", None][d % 3], text + " new york city hall " * int(rng.integers(0, 3)) + "; new york"))
    rows += [("en", None), ("en", ""), (None, " . "), ("xx", "only once here")]
    rows += [rows[0]] * 5
    assert run_phrases(spark, rows, top=top, margin=margin) == brute.phrases(rows, top)


def test_a_frequent_words_hash_is_its_own(spark):
    """With the first seed all words share a few hashes; the search takes the next one."""
    rows = [("en", "a b c d. b c a.") for _ in range(12)]

    def poor(word, seed):
        return phrases.word_hash(word, seed) % 2 if seed == 0 else phrases.word_hash(word, seed)

    assert run_phrases(spark, rows, hasher=poor) == brute.phrases(rows)


def test_phrases_of_nothing_and_of_one_long_text(spark):
    assert run_phrases(spark, [("en", "x")][:0] or [(None, None)]) == []
    rows = [("en", " ".join(f"w{i % 700} red car" for i in range(60_000)))]
    assert run_phrases(spark, rows, top=50) == brute.phrases(rows, 50)
    docs = spark.createDataFrame([("en", "red car " * 10, 1)], "lang string, text string, h1 int")
    assert phrases.collocations(docs).count() == 1 and phrases.collocations(docs.where("false")).count() == 0


# --- archives -----------------------------------------------------------------------------------


def round_trip(spark, pages, path):
    records = warc.page_records(pages)
    warc.write_warc(records, path, fileBytes="20000")
    read = warc.read_warc(spark, path)
    return read, {r.record_id: r for r in read.where("record_type <> 'warcinfo'").collect()}


def test_archives(spark, tmp_path):
    big = "é<p>text</p>\r\n\r\n" * 200
    rows = [(i, big) for i in range(40)] + [(100 + i, f"{i}" * 700) for i in range(20)] + [(200 + i, f"{i % 3}") for i in range(9)] + [(300, None), (301, "")]
    pages = spark.createDataFrame([(i, f"http://x/{i}?a b\r\nWARC-Type: x", t) for i, t in rows], "page_id long, url string, html string").repartition(4)
    read, records = round_trip(spark, pages, str(tmp_path / "a"))
    want = brute.revisits(rows)
    assert len(records) == len(want)
    for i, text in rows:
        r, (size, digest, kind, refers) = records[f"<urn:page:{i}>"], want[i]
        assert (r.record_type, r.payload_length, r.payload_digest) == (kind, size, digest)
        assert r.refers_to == (None if refers is None else f"<urn:page:{refers}>")
        assert bytes(r.payload) == (b"" if kind == "revisit" else (text or "").encode())
        assert r.target_uri == f"http://x/{i}?a%20b%0D%0AWARC-Type:%20x"
    files = {r.file for r in records.values()}
    assert len(files) > 1
    for f in files:  # any gzip reader finds plain records
        data = gzip.open(f).read()
        assert data.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and data.endswith(b"\r\n\r\n")


def test_filters_are_tested_on_headers(spark, tmp_path):
    rows = [(i, None if i == 5 else f"u{i}", "x" * (1000 + i // 2)) for i in range(30)]
    path = str(tmp_path / "a")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    read, _ = round_trip(spark, pages, path)
    whole = read.where("record_type <> 'warcinfo'").toPandas()
    for test in (
        "record_type = 'revisit'", "payload_length > 1010", "payload_length BETWEEN 1003 AND 1005", "target_uri LIKE 'u1%'", "target_uri IS NULL",
        "NOT target_uri LIKE 'u1%'", "record_id IN ('<urn:page:3>', '<urn:page:4>')", "target_uri <=> 'u7'", "refers_to IS NOT NULL AND NOT payload_length = 1002",
        "target_uri LIKE '%5' OR payload_length = 1001",
    ):
        got = read.where("record_type <> 'warcinfo'").where(test)
        spark.createDataFrame(whole[["record_id", "record_type", "target_uri", "refers_to", "payload_length"]].astype(object).where(lambda x: x.notna(), None), "record_id string, record_type string, target_uri string, refers_to string, payload_length long").createOrReplaceTempView("plain_records")
        assert {r.record_id for r in got.collect()} == {r.record_id for r in spark.sql(f"SELECT record_id FROM plain_records WHERE {test}").collect()}, test

    reader = warc.WarcReader(warc.SCHEMA, {"path": path})
    kept = list(reader.pushFilters([warc.ds.EqualTo(("record_type",), "revisit"), warc.ds.EqualTo(("payload",), b"")]))
    assert [t.attribute for t in kept] == [("payload",)] and len(reader.tests) == 1


def test_unwanted_payloads_are_not_read(tmp_path):
    """Of a large record that isn't wanted only the start of its member is read."""
    blob = np.random.default_rng(0).bytes(3 << 20)
    out = b"".join(warc.member(warc.record_bytes({"record_type": k, "payload": blob, "record_id": f"<urn:x:{k}>"})) for k in ("resource", "metadata", "response"))
    (tmp_path / "x.warc.gz").write_bytes(out)
    touched = []

    class Counting(warc._Bytes):
        def at(self, offset, n):
            touched.append(min(n, self.size - offset))
            return super().at(offset, n)

    def read(wanted, with_payload=True):
        touched.clear()
        with warc.pafs.LocalFileSystem().open_input_file(str(tmp_path / "x.warc.gz")) as source:
            return [(c["record_type"], p) for _, c, p in warc._members(Counting(source), wanted, with_payload)]

    assert read(lambda c: c["record_type"] == "response") == [("response", blob)]
    assert sum(touched) < len(blob) * 1.1
    assert read(lambda c: True, False) == [(k, None) for k in ("resource", "metadata", "response")]
    assert sum(touched) < 20_000


def test_archives_of_others(spark, tmp_path):
    """Members without lengths, plain records, and records that are cut off."""
    records = [warc.record_bytes({"record_type": "resource", "record_id": f"<urn:x:{i}>", "payload": b"%d" % i * 9000}) for i in range(5)]
    (tmp_path / "gz").mkdir(), (tmp_path / "plain").mkdir(), (tmp_path / "cut").mkdir(), (tmp_path / "none").mkdir()
    (tmp_path / "gz" / "x.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "plain" / "x.warc").write_bytes(b"".join(records))
    for kind in ("gz", "plain"):
        got = warc.read_warc(spark, str(tmp_path / kind)).where("record_id <> '<urn:x:2>'").collect()
        assert [(r.record_id, bytes(r.payload)) for r in got] == [(f"<urn:x:{i}>", b"%d" % i * 9000) for i in (0, 1, 3, 4)]
        assert warc.read_warc(spark, str(tmp_path / kind), ["record_id"]).count() == 5
    assert warc.read_warc(spark, str(tmp_path / "none")).count() == 0
    noise = warc.record_bytes({"record_type": "resource", "payload": np.random.default_rng(0).bytes(9000)})
    (tmp_path / "cut" / "x.warc.gz").write_bytes(gzip.compress(noise)[:-400])
    with pytest.raises(Exception, match="cut off"):
        warc.read_warc(spark, str(tmp_path / "cut")).collect()


def test_written_files_count_once_listed(spark, tmp_path):
    path = str(tmp_path / "a")
    pages = spark.createDataFrame([(1, "u", "x"), (2, "u", "y")], "page_id long, url string, html string")
    warc.write_warc(warc.page_records(pages), path)
    (tmp_path / "a" / "part-lost.warc.gz").write_bytes(b"what a lost task left")
    count = lambda: warc.read_warc(spark, path).where("record_type = 'response'").count()
    assert count() == 2
    warc.write_warc(warc.page_records(pages), path, mode="append")
    assert count() == 4
    warc.write_warc(warc.page_records(pages.limit(1)), path)
    assert count() == 1


def test_archive_edge_cases(spark, tmp_path):
    rows = [(None, None, "x" * 2000), (1, None, "x" * 2000), (1, "u", "x" * 2000), (0, "u", "x" * 2000), (None, None, None), (7, "é", "y" * 300_000)]
    clash = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, payload int, key int")
    read, _ = round_trip(spark, clash, str(tmp_path / "a"))
    got = sorted((r.record_type, r.record_id, r.refers_to or "") for r in read.where("record_type <> 'warcinfo'").collect())
    one = "<urn:page:1>"
    assert got == [("response", one, ""), ("response", one, ""), ("response", "<urn:page:7>", ""), ("response", "<urn:page:null>", ""), ("revisit", "<urn:page:0>", one), ("revisit", "<urn:page:null>", one)]
    assert round_trip(spark, clash.where("false"), str(tmp_path / "b"))[1] == {}


def test_registered_queries(spark, tmp_path):
    docs = [(i, f"s{i % 4}", "en", 5, f"Big red car {i % 7}. Big red car") for i in range(60)]
    spark.createDataFrame(docs, DOC).write.parquet(str(tmp_path / "documents.parquet"))
    pages = [(i, "u", f"{i % 5}" * 1500) for i in range(20)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    run = lambda name: queries.QUERIES[name](spark, str(tmp_path)).collect()
    assert {r.doc_id: tuple(r)[1:6] for r in run("op11_merkle")} == brute.manifest(docs, tamper)
    assert sorted(map(tuple, run("op12_phrases"))) == brute.phrases([(d[2], d[4]) for d in docs])
    assert {r.page_id: tuple(r)[1:] for r in run("op13_warc")} == brute.revisits([(p[0], p[2]) for p in pages])
