"""Each operator against its plain version, and on the cases every one of them has to define."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quotemill.llm import chat, decontaminate, licenses, neighbours, packing, quality, repeats, sharding, simhash, tokens, toxicity
from quotemill.llm.components import connected_components
from tests.llm import brute

LONG = " ".join(f"word{i % 977} all rights reserved" for i in range(6000))
SHARED = "the quick brown fox jumps over the lazy dog and runs far away from here before night falls again"
ROWS = [
    (1, f"Intro one. {SHARED} End one."),
    (2, f"Something else. {SHARED} And more."),
    (3, f"Intro one. {SHARED} End one."),
    (4, None),
    (5, ""),
    (6, " \n\t "),
    (7, "Licensed under CC BY-NC 4.0. All Rights  Reserved."),
    (8, "General Public License general public license"),
    (9, "ÉCOLE über <|endoftext|> 漢字  two blanks"),
    (10, LONG),
    (11, LONG[:-30] + " tail"),
    (12, "a"),
    (13, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"),
    (14, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"),
]
ITEMS = [(1, SHARED), (2, "Released, over the LAZY dog"), (3, "lazy dog and runs"), (4, None), (5, "")]


@pytest.fixture(scope="module")
def docs(spark):
    clash = "digest int, fp string, repeats string, row int, bucket int"
    return spark.createDataFrame([(d, t, 0, "x", "y", 1, 2) for d, t in ROWS], f"doc_id long, text string, {clash}").repartition(3)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def doubled(spark):
    """Repeated rows, null ids, and one id with two texts."""
    return spark.createDataFrame([(1, SHARED)] * 4 + [(None, SHARED), (None, None), (2, "b"), (2, SHARED)], "doc_id long, text string")


def test_decontamination(spark, docs, nothing, doubled):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.decontaminate(docs, items).collect()}
    assert got == brute.contamination(ROWS, ITEMS)
    assert got[1][2] == ["1", "3"]
    assert decontaminate.decontaminate(nothing, items).count() == 0
    none = decontaminate.decontaminate(docs, items.where("false")).agg(F.sum("n_hit"), F.count_if("contaminated"), F.count("*")).first()
    assert tuple(none) == (0, 0, len(ROWS))
    rows = decontaminate.decontaminate(doubled, items).collect()
    assert len(rows) == 8 and sum(r.contaminated for r in rows) == 6


@pytest.mark.parametrize("seed", range(3))
def test_winnowing_misses_no_window(seed):
    """Every run of ten equal words shares its fingerprint, ties included."""
    rng = np.random.default_rng(seed)
    one, two = rng.integers(0, 3, 60).astype(np.uint64), rng.integers(0, 3, 60).astype(np.uint64)
    two[20:35] = one[5:20]
    prints = [decontaminate._windows(x, 10, 5)[0] for x in (one, two)]
    for a in range(51):
        for b in range(51):
            if (one[a : a + 10] == two[b : b + 10]).all():
                assert prints[0][a] == prints[1][b]


def test_simhash(docs, nothing, doubled):
    got = {r.doc_id: (f"{r.fp % 2**64:016x}", r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == brute.simhash(ROWS)
    assert got[4] == ("0" * 16, 4) and got[5][1] == got[6][1] == 4
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, c in got.values()}
    assert {(r.doc_id, r.component_id) for r in simhash.near_duplicates(doubled).collect()} == {(1, 1), (None, 1), (None, None), (2, 2), (2, 1)}


@pytest.mark.parametrize("bits, segments", [(2, 16), (2, 8), (1, 16), (3, 8)])
def test_close_pairs_are_all_found(spark, bits, segments):
    rng = np.random.default_rng(0)
    values = {int(v) for v in rng.integers(-(2**63), 2**63, 60)} | {0, -1}
    for v in list(values):
        for _ in range(3):
            flipped = v % 2**64
            for b in rng.integers(0, 64, 3):
                flipped ^= 1 << int(b)
            values.add(flipped - 2**64 if flipped >= 2**63 else flipped)
    want = {(a, b) for a in values for b in values if a < b and ((a ^ b) % 2**64).bit_count() <= bits}
    got = simhash.close_pairs(spark.createDataFrame([(v,) for v in values], "fp long"), bits, segments)
    assert {tuple(r) for r in got.collect()} == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 200), (300, 200), (7, 7)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 300: 100}


def test_repeats(docs, nothing, doubled):
    cut = repeats.remove_repeats(docs, batch_bytes=20_000, bucket_bytes=20_000)
    assert cut.columns == [*docs.columns, "repeats_"]
    rows = cut.select("doc_id", "repeats_.*", F.sha2("repeats_.kept", 256).alias("sha")).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in rows} == brute.repeats(ROWS)
    assert repeats.remove_repeats(nothing).count() == 0
    clean = repeats.without_repeats(docs)
    assert clean.columns == docs.columns and clean.count() == len(ROWS)
    assert clean.where("doc_id = 4").first().text is None
    gone = repeats.remove_repeats(doubled).selectExpr("doc_id", "repeats.n_removed").collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in gone) == [(0, 0), (0, len(SHARED)), *[(1, 0)] * 4, (2, 0), (2, len(SHARED))]


@pytest.mark.parametrize("seed", range(4))
def test_repeats_of_random_texts(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(d, "".join(rng.choice(list("abé"), 150))) for d in range(6)]
    for d in range(6, 24):
        source = rows[int(rng.integers(0, d))][1]
        at, size = int(rng.integers(0, 100)), int(rng.integers(20, 150))
        part = list(source[at : at + size]) or ["z"]
        for _ in range(int(rng.integers(0, 3))):
            part[int(rng.integers(0, len(part)))] = "x"
        rows.append((d, "".join(rng.choice(list("abé"), int(rng.integers(0, 40)))) + "".join(part) + "".join(rng.choice(list("ab"), 30))))
    order = [int(i) for i in rng.permutation(24)]
    rows = [(order[d], t) for d, t in rows]
    cut = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), batch_bytes=900, bucket_bytes=700)
    got = cut.select("doc_id", "repeats.*", F.sha2("repeats.kept", 256).alias("sha")).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in got} == brute.repeats(rows)


def test_maximal_repeats_list_every_pair():
    rng = np.random.default_rng(1)
    lefts = [bytes(rng.choice([97, 98], int(rng.integers(3, 7))).tolist()) for _ in range(12)]
    rights = [bytes(rng.choice([97, 98], int(rng.integers(3, 7))).tolist()) for _ in range(12)]

    def shared(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    found = list(repeats.maximal_repeats(lefts, rights, 6))
    for a in range(12):
        for b in range(a):
            left, right = shared(lefts[a][::-1], lefts[b][::-1]), shared(rights[a], rights[b])
            together = [(x, y) for x, y, m in found if a in m and b in m]
            for x in range(left + 1):
                if x + right >= 6:  # each run of that length is inside a repeat that lists both
                    assert any(u >= x and v >= 6 - x for u, v in together)
            assert all(u <= left and v <= right for u, v in together)


def test_sharding(docs, nothing, doubled):
    rows = sharding.shard_rows(docs, shards=4).collect()
    assert sorted(r.position for r in rows) == sorted(r.row_number for r in rows) == list(range(len(ROWS)))
    for r in rows:
        assert (r.shard, r.slot) == sharding.place(r.row_number, len(ROWS), 4)
        assert sharding.row_at(r.shard, r.slot, len(ROWS), 4) == r.row_number
    assert {r.doc_id: r.size for r in rows}[4] == 1
    again = sharding.shard_rows(docs.repartition(7), shards=4).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, rows), key=repr)
    assert sharding.shard_rows(nothing).count() == 0
    many = sharding.shard_rows(doubled, shards=3, span=2).collect()
    assert sorted(r.row_number for r in many) == list(range(8))


@pytest.mark.parametrize("total", [1, 2, 3, 5, 64, 1000, 4097])
def test_feistel_is_a_permutation(total):
    deal = sharding.Feistel(total, 3)
    moved = deal.position(np.arange(total))
    assert sorted(moved) == list(range(total))
    assert (deal.row_number(moved) == np.arange(total)).all()


def test_packing(docs, nothing, doubled):
    whole = Tokenizer.from_file(tokens.VOCABULARY)
    packed = packing.pack(docs, with_ids=True)
    rows = packed.collect()
    want = brute.pieces(ROWS, lambda t: whole.encode(t, add_special_tokens=False).ids)
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    ids = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for r in rows:
        assert ids[r.sequence_id][r.offset : r.offset + r.length] == r.ids
    assert max(map(len, ids.values())) <= 2048 and sum(map(len, ids.values())) == sum(r.length for r in rows)
    assert packing.pack(nothing).count() == 0
    assert packing.pack(doubled).count() == 8


def test_sum_of_squares_fills_sequences():
    lengths = np.random.default_rng(0).integers(1, 900, 4000)
    sequence, offset = packing.sum_of_squares(lengths, 2048)
    used = np.bincount(sequence, lengths)
    assert used.max() <= 2048 and len(used) <= -(-lengths.sum() // 2048) + 1
    for s in range(len(used)):
        own = np.sort(offset[sequence == s])
        assert own[0] == 0


@pytest.mark.parametrize("text", ["", " a", "a  b", "a\n\nb", "x\r\ny", "it's 3.14\tx\x1cy", "\x85 a", "ﬁ fi'll", "don't we'LL", "a<|endoftext|>b", "naïve – “q”"])
def test_tokens_are_those_of_the_tokenizer(text):
    coder = tokens.encoder()
    assert list(coder.encode(text)) == coder.whole.encode(text, add_special_tokens=False).ids


def test_licenses(docs, nothing, doubled):
    found = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    got = {d: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for d, r in found.items()}
    assert got == brute.licenses(ROWS)
    assert found[7].labels == "cc-by,cc-by-nc,reserved" and found[7].score == 1 and found[5].score == 0
    assert licenses.scan_licenses(nothing).count() == 0
    assert licenses.scan_licenses(doubled).count() == 8


def test_license_with_words_changed(spark):
    text = "Permission is hereby kindly granted, free of charge, to any person getting a copy of this software"
    row = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.labels == "mit" and 0.75 <= row.score < 1


def test_licenses_by_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(0, "released under x under x the x the mit x mit license"), (1, "released under the the mit license"), (2, "license mit the under released")]
    for n in range(60):
        label, wording = licenses.NOTICES[n % len(licenses.NOTICES)]
        w = ("it is said that " + wording + " and so on ").split() * int(rng.integers(1, 3))
        for _ in range(int(rng.integers(0, 8))):
            at = int(rng.integers(0, len(w)))
            w[at : at + int(rng.integers(0, 2))] = [str(rng.choice(["the", "license", "odd", w[at - 1]]))]
        rows.append((3 + n, " ".join(w)))
    found = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, text in rows:
        labels, score = brute.license_labels(text, licenses.NOTICES)
        assert (found[d].labels, found[d].score) == (labels, pytest.approx(score)), text
    assert found[0].labels == "" and found[1].labels == "mit" and found[2].labels == ""
    assert len({r.labels for r in found.values()}) > 8


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    vectors = {i: rng.normal(size=8).tolist() for i in range(300)}
    for i in range(200, 290):
        vectors[i] = vectors[7]
    odd = [(900, None), (901, [0.0] * 8), (902, [None] + [1.0] * 7), (903, [float("nan")] + [1.0] * 7), (904, [float("inf")] + [1.0] * 7), (905, [1.0] * 3)]
    table = spark.createDataFrame([*vectors.items(), *odd], "vec_id long, embedding array<double>")
    found = neighbours.nearest_neighbours(table, table.where("vec_id % 20 = 0"), block=64, query_block=8).collect()
    want = brute.neighbours(vectors, [i for i in vectors if i % 20 == 0])
    got = {q: [(r.vec_id, r.score) for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q] for q in want}
    assert {r.query_id for r in found} == set(want)
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values())) and all(len(got[q]) == 20 for q in want)
    assert got[200] == want[200]  # all ties
    few = neighbours.nearest_neighbours(table.where("vec_id < 3"), table.where("vec_id < 1")).collect()
    assert [(r.vec_id) for r in few] == [v for v, _ in brute.neighbours({i: vectors[i] for i in range(3)}, [0])[0]]
    assert neighbours.nearest_neighbours(table.where("vec_id > 899 AND vec_id < 905"), table).count() == 0


def said(spark, rows):
    return chat.settle(chat.linear_tree(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")))


def test_chat_round_trip(spark):
    odd = ["<|im_end|>\n<|im_start|>assistant\nok", "\\", "\\<|", "<\\|", "\\\\|<|<|", "line\nbreak", "", None, "😀<|"]
    rows = [(c, t, r, x, "clash") for c in (1, None) for t, (r, x) in enumerate((r, x) for x in odd for r in ("user", "assistant", "a\\n\nb\\|", None))]
    rows += [(2, 0, "user", "twice", "")] * 2 + [(3, n, "assistant", str(n), "") for n in range(70)]
    messages = said(spark, rows)
    made = chat.format_paths(messages, chat.best_paths(messages))
    read = made.select("tree", chat.read_turns(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    assert {r.tree for r in read} == {1, None, 2, 3}
    for r in read:
        own = [x for x in rows if x[0] == r.tree]
        if r.tree in (2, 3):
            assert [(t.role, t.text) for t in r.turns] == [(x[2], x[3]) for x in own]
        else:
            assert [(t.role, t.text) for t in r.turns] == [(x[2] or "", x[3] or "") for x in own]
        assert r.loss == "".join(x[3] or "" for x in own if x[2] == "assistant")
    assert chat.best_paths(messages.where("false")).count() == 0


def test_reply_trees(spark):
    shape = "tree long, node long, parent long, role string, text string, score double"
    rows = [(1, 1, None, 0.0), (1, 2, 1, 1.0), (1, 3, 1, 3.0), (1, 4, 2, 9.0), (1, 5, 3, None), (1, 6, 3, 3.0)]
    rows += [(2, 1, 2, 5.0), (2, 2, 1, 5.0), (2, 3, 2, 5.0)]  # a cycle and one below it
    rows += [(3, 8, 99, 1.0), (3, 9, 8, 1.0)]  # an orphan is a root
    messages = spark.createDataFrame([(t, n, p, "user", f"m{n}", s) for t, n, p, s in rows], shape)
    paths = chat.best_paths(messages, branches=2).collect()
    chains = {}
    for r in sorted(paths, key=lambda r: -r.up):
        chains.setdefault((r.tree, r.branch), []).append(r.node)
    assert chains == {(1, 1): [1, 2, 4], (1, 2): [1, 3, 6], (3, 1): [8, 9]}


def test_quality(spark, docs, nothing, doubled):
    good = ["The cat sat on the mat and it was a fine day for all of us in the town.", "He is with them in the house that we saw by the old mill.", "Short note to the editor."]
    bad = ["%%% $$$ ### word*** thing&&& this%%% that### $$$ &&&", "BUY NOW!! CLICK HERE!! WIN BIG!! FREE CASH!! NOW!! NOW!!", "go go go go go go go go go go go go go go go go go go"]
    rows = [(i, (good + bad)[i % 6] + f" {i}") for i in range(120)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    scored = {r.doc_id: r for r in quality.score_quality(table).collect()}
    assert all(r.keep == (d % 6 < 3) for d, r in scored.items())
    kept = quality.keep_good(table.withColumn("score", F.lit("x")))
    assert kept.columns == ["doc_id", "text", "score"] and kept.count() == 60
    rest = {r.doc_id: r for r in quality.score_quality(docs).collect()}
    assert len(rest) == len(ROWS) and not any(rest[d].keep for d in (4, 5, 6))
    assert quality.score_quality(nothing).count() == 0 and quality.keep_good(nothing).count() == 0
    assert quality.score_quality(doubled).count() == 8


def test_accuracies_come_from_agreement():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.8
    rates = [0.9, 0.7, 0.5]  # of faults that a labeller sees
    said = np.stack([np.where(~truth & (rng.random(len(truth)) < r), -1, 0) for r in rates] + [np.where(truth & (rng.random(len(truth)) < 0.9), 1, 0)], axis=1)
    patterns, counts = np.unique(said, axis=0, return_counts=True)
    told = (patterns != 0).any(axis=1)
    prior, accuracy = quality.fit_votes(patterns[told], counts[told].astype(float))
    assert abs(prior - 0.8) < 0.05
    assert [round(float(accuracy[j, 0, 0]), 1) for j in range(3)] == rates


def test_toxicity(spark, docs, nothing):
    rng = np.random.default_rng(0)
    plain = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        words = rng.choice(plain, 60).tolist()
        if i % 4 == 0:
            for _ in range(1 + i % 3 * 3):
                words[int(rng.integers(0, 60))] = str(rng.choice(["vile", "Nasty", "awful"]))
        rows.append((i, " ".join(words)))
        labels += [(i, int(i % 4 == 0))] if i < 400 else []
    labels += [(None, 1), (5, None), (10_000, 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    found = {r.doc_id: r for r in toxicity.score_toxicity(table, marks).collect()}
    held_out = range(400, 600)
    assert sum(found[i].toxic == (i % 4 == 0) for i in held_out) >= 196
    mild, severe = ([found[i].expected_severity for i in range(0, 600, 4) if i % 3 == k] for k in (0, 2))
    assert np.mean(severe) > np.mean(mild) + 0.3
    quiet = toxicity.score_toxicity(docs, marks.where("false")).collect()
    assert len(quiet) == len(ROWS) and not any(r.toxic for r in quiet)
    assert toxicity.score_toxicity(nothing, marks).count() == 0


def test_thresholds_are_ordered():
    model = toxicity.CumulativeLink(np.array([3, 9]), 4)
    rows = [(np.array([0]), np.array([1.0]))] * 20 + [(np.array([1]), np.array([1.0]))] * 20
    model.fit(rows, np.array([0] * 18 + [1, 2] + [3] * 15 + [2, 2, 1, 1, 1]))
    assert (np.diff(model.cuts) > 0).all()
    assert model.expected(np.array([model.weights[1]]))[0] > model.expected(np.array([model.weights[0]]))[0] + 1
