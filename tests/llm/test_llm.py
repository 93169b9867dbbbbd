"""Clusters, neighbours, packing, leakage and languages on small fixtures, against brute force where there is one."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from eavesgraph.llm import density, languages, leakage, neighbours, packing, subtitles
from eavesgraph.llm.vamana import ShardIndex
from eavesgraph.operators.clouds import selected_places


def place_table(spark, x, frame="a"):
    return spark.createDataFrame([(frame, i, *map(float, p)) for i, p in enumerate(x)], "frame_id string, point_id long, px double, py double, pz double")


@pytest.mark.parametrize("seed", [0, 1])
def test_density_groups_are_the_components(spark, seed):
    rng = np.random.default_rng(seed)
    x = (rng.random((400, 3)) * [1.2, 1.2, 0.3]).round(3)
    x[-5:] = x[0]
    label = np.arange(len(x))
    near = ((x[:, None] - x[None]) ** 2).sum(-1) <= 0.01
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            break
        label = new
    want = {(i, label[i]) for i in range(len(x)) if (label == label[i]).sum() >= 5}
    members, groups = density.density_groups(place_table(spark, x))
    assert {(r.point_id, r.label) for r in members.select("point_id", "label").collect()} == want
    told = density.describe_groups(members, groups).collect()
    assert sum(r.n_points for r in told) == len(want) and all(1 <= len(r.central) <= 3 for r in told)


def test_density_of_nothing(spark):
    members, groups = density.density_groups(place_table(spark, [(0, 0, 0)]).limit(0))
    assert members.count() == groups.count() == 0


def test_selected_places(spark, rows):
    points = spark.createDataFrame([("a", i, 1.0, 1.0, 1.0, 9.0) for i in (0, 0, 1, 2, 3, 4)], "frame_id string, point_id long, x double, y double, z double, dx double")
    nan = float("nan")
    pred = spark.createDataFrame([("a", 0, 0.9, 1.0, 0.0, 0.0), ("a", 0, 0.9, 1.0, 0.0, 0.0), ("a", 1, nan, 0.0, 0.0, 0.0), ("a", 2, None, 0.0, 0.0, 0.0), ("a", 3, 0.9, -10.0, -10.0, -10.0), ("a", 4, 0.5, 0.0, 0.0, 0.0), ("a", 9, 0.9, 0.0, 0.0, 0.0), (None, 1, 0.9, None, 0.0, 0.0)], "frame_id string, point_id long, score double, dx double, dy double, dz double")
    assert rows(selected_places(pred, points)) == [("a", 0, 2.0, 1.0, 1.0)]


def test_recall_and_equal_vectors():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 11)).round(3)
    x[2000:2100] = x[5]
    ids = rng.permutation(3000)
    q, own = x[:200], ids[:200]
    truth = neighbours.brute_force(x, ids, q, own, 10)
    row, found, _ = ShardIndex(ids, x).nearest(q, own, 10, 64)
    recall = np.mean([len(set(found[row == i]) & set(truth[i])) / 10 for i in range(200)])
    assert recall >= 0.98
    assert found[row == 5].tolist() == truth[5].tolist()


def test_neighbours_over_shards(spark, rows):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 11)).round(3)
    data = [(i, f"r{i % 2}", x[i, :3].tolist(), x[i, 3:8].tolist(), x[i, 8:].tolist(), "extra") for i in range(300)]
    data += [(900, "r0", None, [0.0] * 5, [0.0] * 3, ""), (901, "r0", [0.0] * 2, [0.0] * 5, [0.0] * 3, ""), (902, "r0", [float("nan"), 0.0, 0.0], [0.0] * 5, [0.0] * 3, ""), (903, "r0", [None, 0.0, 0.0], [0.0] * 5, [0.0] * 3, ""), (904, "lonely", [0.0] * 3, [0.0] * 5, [0.0] * 3, "")]
    fusion = spark.createDataFrame(data, "vec_id long, run_id string, xyz array<double>, fpfh array<double>, mrgd array<double>, shard string")
    base = neighbours.vectors(fusion)
    assert base.count() == 301
    near = neighbours.nearest(base, base.where("vec_id < 40 or vec_id = 904"), shard=40)
    got = {}
    for r in near.collect():
        got.setdefault(r.vec_id, []).append(r.neighbour)
    assert 904 not in got
    hits = 0
    for i in range(40):
        ids = np.array([j for j in range(300) if j % 2 == i % 2])
        hits += len(set(got[i]) & set(neighbours.brute_force(x[ids], ids, x[[i]], [i], 10)[0]))
    assert hits >= 396
    assert neighbours.nearest(base.limit(0), base.limit(0)).count() == 0


def test_packing(spark, rows):
    sizes = [8192, 8193, 20000, 1, 0, 5000, 5000, 3192, 3192, 8191]
    docs = spark.createDataFrame([(i, "x" * n, 1, 2) for i, n in enumerate(sizes)] + [(50, None, 1, 2), (None, "x", 1, 2), (51, "ü" * 4097, 1, 2)], "doc_id long, text string, piece int, bin int")
    packed = packing.pack(docs)
    all_ = packed.collect()
    assert {r.doc_id for r in all_ if r.n_pieces > 1} == {1, 2, 51}
    assert {(r.doc_id, r.piece): r.size for r in all_} == {(0, 0): 8192, (1, 0): 8192, (1, 1): 1, (2, 0): 8192, (2, 1): 8192, (2, 2): 3616, (3, 0): 1, (5, 0): 5000, (6, 0): 5000, (7, 0): 3192, (8, 0): 3192, (9, 0): 8191, (51, 0): 8192, (51, 1): 2}
    used = packing.containers(packed).collect()
    assert all(r.unused >= 0 for r in used) and len(used) == 9
    assert packing.pack(docs.limit(0)).count() == 0


def test_packing_over_shards_keeps_every_item(spark):
    rng = np.random.default_rng(0)
    docs = spark.createDataFrame([(i, "x" * int(n)) for i, n in enumerate(rng.integers(1, 4000, 600))], "doc_id long, text string")
    packed = packing.pack(docs, shard=100)
    assert packed.count() == 600 == packed.select("doc_id").distinct().count()
    used = packing.containers(packed)
    total = used.agg(F.sum("n_tokens")).first()[0]
    assert used.where("n_tokens > 8192").count() == 0 and used.count() <= 1.03 * total / 8192 + 1


def test_crossover_and_mutation_keep_the_items():
    p = packing.Packer(np.random.default_rng(1).integers(1, 5000, 300), 8192, 1)
    a, b = p.fresh(0.0), p.fresh(0.5)
    for child in (p.cross(a, b), p.mutate(a), p.mutate(p.cross(b, a))):
        assert (child >= 0).all() and np.bincount(child, weights=p.size).max() <= 8192
    assert p.evolve([a], 3, 4)[0][0] >= p.fitness(a)


WORDS = "apple river stone cloud bread winter lantern garden engine harbour candle mountain brother kettle window promise secret village bridge pocket".split()


def subtitle(words, per=4, head="﻿"):
    cues = [words[i : i + per] for i in range(0, len(words), per)]
    return head + "\r\n\r\n".join(f"{k + 1}\r\n00:00:{k:02d},000 --> 00:00:{k + 1:02d},000\r\n<i>- {' '.join(c).capitalize()}!</i>\r\n[door creaks]" for k, c in enumerate(cues))


def test_leaked_passages(spark, rows):
    other = [f"word{i}" for i in range(60)]
    changed = WORDS[:12].copy()
    changed[4], changed[8] = "different", "words"
    three = changed.copy()
    three[2] = "more"
    added = [*WORDS[:6], "extra", *WORDS[6:12]]
    left_out = [w for i, w in enumerate(WORDS[:18]) if i not in (5, 9, 13)]
    docs = [(1, subtitle(other[:9] + WORDS[:12] + other[9:])), (2, subtitle(WORDS[:11])), (3, subtitle(changed)), (4, subtitle(three)), (5, subtitle(added)), (6, subtitle(left_out)), (7, None), (8, ""), (9, subtitle(WORDS) * 2), (9, subtitle(WORDS))]
    documents = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(100, " ".join(WORDS).title() + "."), (101, "too short an item"), (102, None)], "item_id long, text string")
    assert rows(leakage.leaked(documents, items), "doc_id", "item_id", "n_words", "n_errors") == [(1, 100, 12, 0), (3, 100, 12, 2), (5, 100, 12, 1), (6, 100, 18, 3), (9, 100, 20, 0)]
    assert leakage.leaked(documents.limit(0), items).count() == 0 and leakage.leaked(documents, items.limit(0)).count() == 0


def test_winnowing_keeps_one_of_every_window():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 50, 500).astype(np.int32)
    h = leakage.gram_hashes(ids)
    at = set(leakage.winnow(h).tolist())
    assert all(at & set(range(i, i + leakage.WINDOW)) for i in range(len(h) - leakage.WINDOW + 1))
    shared = ids[100 : 100 + leakage.K + leakage.WINDOW - 1]
    there = leakage.gram_hashes(np.concatenate((rng.integers(0, 50, 30).astype(np.int32), shared, rng.integers(0, 50, 30).astype(np.int32))))
    assert {int(h[i]) for i in at & set(range(100, 100 + leakage.WINDOW))} & {int(there[i]) for i in leakage.winnow(there)}


def test_encodings_are_repaired():
    text = "Müde Tür geschlossen über"
    assert subtitles.repair(text.encode().decode("latin-1")) == text
    assert subtitles.repair(text.encode().decode("latin-1").encode().decode("latin-1")) == text
    assert subtitles.repair("дверь гора".encode("cp1251").decode("latin-1")) == "дверь гора"
    assert subtitles.repair("była góra".encode("cp1250").decode("latin-1")) == "była góra"
    assert leakage.words_of("m�de") == leakage.words_of("Müde")


def labelled():
    en = "the and you that with have this what your they door water morning".split()
    de = "und der die das nicht mit wir ich haben eine wasser morgen tür".split()
    fr = "le la les et vous nous avec une que pas eau matin porte".split()
    rng = np.random.default_rng(0)
    say = lambda words, n: "\n\n".join(f"{k}\n00:00:{k % 60:02d},000 --> 00:00:{k % 60:02d},900\n" + " ".join(rng.choice(words, 7)) for k in range(1, n + 1))
    docs = [(i, say(w, 12), lab) for i, (w, lab) in enumerate([(en, "en"), (de, "German"), (fr, "fr")] * 6)]
    docs += [(100, say(de, 12), "en"), (101, say(fr, 12), None), (102, say(en, 12), "EN "), (103, say(en, 8) + "\n\n" + say(de, 8), "en"), (104, None, None), (105, "", "xx"), (106, "1\n00:00:01,000 --> 00:00:02,000\nDownloaded from x.example\n", None), (107, say(en, 14) + "\n\n" + say(fr, 1), "en")]
    return docs


def test_languages(spark, rows):
    documents = spark.createDataFrame([(*d, 1) for d in labelled()], "doc_id long, text string, lang string, n_words int")
    codes = spark.createDataFrame([("en", "en"), ("German", "de"), ("fr", "fr")], "label string, lang string")
    seg = languages.language_segments(documents, codes)
    found = languages.document_languages(seg)
    assert rows(languages.label_faults(documents, codes, found)) == [(100, "de"), (101, "fr"), (102, "en"), (103, "de"), (103, "en")]
    assert rows(seg.where("doc_id = 103"), "lang") == [("de",), ("en",)]
    assert all(0 <= r.confidence <= 1 + 1e-9 for r in seg.collect())
    assert languages.language_segments(documents.limit(0), codes).count() == 0
    assert languages.language_segments(documents, codes.limit(0)).count() == 0


def test_forward_sum_is_the_sum_over_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab"]
    m = languages.PieceModel(["l"], {p: i for i, p in enumerate(pieces)}, np.array([[0.1], [0.2], [0.3], [0.05], [0.15], [0.2]]), 3)
    want = 0.2 + 0.2 * 0.05 + 0.1 * 0.15 + 0.1 * 0.3 * 0.05
    assert np.isclose(np.exp(m.score("ab")[0]), want)
    assert np.isfinite(m.word_ids(["x" * 5000])[0]) and np.isfinite(m.table()).all()
    assert languages.fit({"l": Counter({"ab": 3}), "k": Counter({"ba": 3})}, pieces).score("ab").argmax() == 1
