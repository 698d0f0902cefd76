"""Operators across documents against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from wayfold.llm import decontamination, simhash_dedup, topk_search

EXTRA = "doc_id long, text string, key string, fp long, at int, met long, hash long, rows long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1, 2, 3, 4, 5) for i, t in rows], EXTRA)


def items(spark, rows):
    return spark.createDataFrame([(i, t, 1) for i, t in rows], "item_id long, text string, at int")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def brute_hits(docs, bench):
    out = []
    for doc_id, text in docs:
        w, hit, found = words_of(text), set(), set()
        for item, other in bench:
            b = words_of(other)
            n = min(10, len(b))
            windows = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
            for i in range(len(w) - n + 1 if n else 0):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=repr)


def test_decontamination_is_exact(spark):
    rng = random.Random(11)
    vocabulary = ["The", "a", "ÉTÉ", "été", "naïve", "x1", "of", "Σας", "b2", "C"]

    def run(n):
        return "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))

    bench = [(n, run(rng.choice([1, 3, 9, 10, 11, 30]))) for n in range(12)] + [(3, run(15)), (50, ""), (51, None), (52, "...")]
    docs = [(n, run(rng.randint(0, 40)) + (bench[n % 12][1] if n % 2 else "") + run(rng.randint(0, 20))) for n in range(60)]
    docs += [(200, None), (200, ""), (201, "--"), (1, docs[1][1]), (1, "other text entirely"), (None, bench[5][1]), (202, (bench[5][1] + " ") * 40)]
    for limit in (decontamination.BROADCAST_WINDOWS, 0):  # by broadcast, and by shuffle
        got = decontamination.decontaminate(frame(spark, docs), items(spark, bench), broadcast_windows=limit)
        assert sorted(map(tuple, got.collect()), key=repr) == brute_hits(docs, bench)
    kept = decontamination.clean(frame(spark, docs), items(spark, bench))
    wanted = sorted([d for d in docs if not brute_hits([d], bench)[0][5]], key=repr)
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=repr) == wanted and len(kept.columns) == 8


def test_decontamination_of_nothing(spark):
    docs = [(1, "a b c"), (2, None)]
    got = decontamination.decontaminate(frame(spark, docs), items(spark, [])).collect()
    assert sorted((r.doc_id, r.n_words, r.contaminated) for r in got) == [(1, 3, False), (2, 0, False)]
    assert decontamination.decontaminate(frame(spark, []), items(spark, [(1, "a b")])).collect() == []


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def near_texts(rng):
    base = [" ".join(rng.choice("qrstuvwxyz") * rng.randint(1, 4) for _ in range(120)) for _ in range(25)]
    rows = []
    for text in base:
        own = text.split()
        for _ in range(6):
            changed = list(own)
            changed[rng.randrange(len(own))] = "new"
            rows.append(" ".join(changed))
        rows += [text, text]
    return rows


def test_simhash_is_exact(spark):
    rng = random.Random(13)
    docs = [(n, t) for n, t in enumerate(near_texts(rng))] + [(900, None), (901, ""), (902, " \t"), (903, "One"), (904, "one"), (905, "a b"), (905, "a b"), (None, "One"), (906, "x\u00a0y É"), (907, "w " * 9000)]
    prints = [brute_print(t) for _, t in docs]
    assert [simhash_dedup.fingerprint(t) for _, t in docs] == prints
    groups = brute_components(prints)
    least = {}
    for (i, _), g in zip(docs, groups, strict=True):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    wanted = sorted([(i, f"{p:016x}", least[g]) for (i, _), p, g in zip(docs, prints, groups, strict=True)], key=repr)
    for point in (simhash_dedup.POINT, 1):  # pairs in grid points, and every shared point met in the middle
        got = simhash_dedup.near_duplicates(frame(spark, docs), point=point)
        assert sorted(map(tuple, got.collect()), key=repr) == wanted
    kept = simhash_dedup.deduplicate(frame(spark, docs))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values()) and kept.columns == EXTRA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")


def test_simhash_links_by_chosen_bits(spark):
    """Fingerprints at known distances, through the grid alone and the middle alone."""
    rng = random.Random(17)
    prints = {rng.getrandbits(64) for _ in range(40)}
    for p in list(prints):
        a, b, c = rng.sample(range(64), 3)
        prints |= {p ^ 1 << a, p ^ 1 << a ^ 1 << b, p ^ 1 << a ^ 1 << b ^ 1 << c}
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    distinct = spark.createDataFrame([(s,) for s in signed], "fp long")
    wanted = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert {(r.a, r.b) for r in simhash_dedup.links(distinct, point=10**6).collect()} == wanted
    groups = brute_components(prints)
    for point in (1, 3):  # through all three widths, and some through fewer
        found = simhash_dedup.connected_components(simhash_dedup.links(distinct, point=point), checkpoint=simhash_dedup.checkpointed)
        by = {}
        for r in found.collect():
            by.setdefault(r.component, set()).add(r.node)
        own = {}
        for s, g in zip(signed, groups, strict=True):
            own.setdefault(g, set()).add(s)
        assert sorted(map(sorted, by.values())) == sorted(sorted(v) for v in own.values() if len(v) > 1)


def test_simhash_narrow_segments_find_the_pairs(spark, monkeypatch):
    """Each width alone finds what brute force finds, among prints that crowd few points."""
    rng = random.Random(31)
    base = rng.getrandbits(64)
    prints = {base} | {base ^ 1 << a ^ 1 << b for a, b in (rng.sample(range(64), 2) for _ in range(60))} | {rng.getrandbits(64) for _ in range(30)}
    signed = np.array(sorted(prints), np.uint64).view(np.int64).tolist()
    distinct = spark.createDataFrame([(s,) for s in signed], "fp long")
    wanted = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    for width in (4, 2):
        monkeypatch.setattr(simhash_dedup, "WIDTHS", (width, 1))
        assert {(r.a, r.b) for r in simhash_dedup.links(distinct, point=10**6).collect()} == wanted
    points = simhash_dedup._points(distinct, 2)
    assert points.count() <= 65 * len(signed) and points.select("fp", "point").distinct().count() == points.count()


def test_simhash_of_nothing(spark):
    assert simhash_dedup.near_duplicates(frame(spark, [])).collect() == []
    alone = simhash_dedup.deduplicate(frame(spark, [(None, "a"), (None, "a"), (None, "b c d e f")])).collect()
    assert sorted(r.text for r in alone) == ["a", "b c d e f"]


def test_simhash_keeps_a_row_of_each_component_where_ids_repeat(spark):
    rng = random.Random(29)
    texts = [" ".join(rng.choice("qrstuvwxyz") * rng.randint(1, 4) for _ in range(60)) for _ in range(12)]
    rows = [(7, t) for t in texts[:8]] + [(7, texts[0]), (8, texts[1]), (9, texts[9]), (None, texts[9]), (None, texts[10]), (3, texts[11]), (7, texts[11])]
    kept = simhash_dedup.deduplicate(frame(spark, rows)).collect()
    wanted = [(7, t) for t in texts[:8]] + [(9, texts[9]), (None, texts[10]), (3, texts[11])]
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted(wanted, key=repr)


def brute_top(rows, k=5):
    good = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in good:
        if q % 50 == 0:
            scores = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q and len(w) == len(v)))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


def test_top_k_is_exact(spark):
    rng = random.Random(19)
    rows = [(n, [float(np.float32(rng.choice([-1.5, -0.001, 0.0, 0.25, 1e-30, rng.gauss(0, 1)]))) for _ in range(6)]) for n in range(420)]
    rows += [(1000, None), (1001, [None] * 6), (1050, [float("nan")] * 6), (1100, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (1150, [1e9, -1e9, 3e8, 1.0, 2.0, 3.0]), (1200, [1.0, 2.0])]
    table = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<float>, label int, score long")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    for block, shard in ((2048, 4096), (3, 17)):
        got = topk_search.top_k(table, F.col("id") % 50 == 0, block=block, shard=shard)
        assert sorted(map(tuple, got.collect())) == brute_top(rows)
    assert topk_search.top_k(table.where("false"), F.col("id") % 50 == 0).collect() == []


def test_top_k_sends_each_vector_once_a_cell(spark, monkeypatch):
    """Neither shards nor blocks are repeated for every pair of them, and lists come once a region."""
    rng = random.Random(37)
    rows = [(n, [rng.gauss(0, 1) for _ in range(8)]) for n in range(3000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    seen, tiles = [], topk_search._tiles
    monkeypatch.setattr(topk_search, "_tiles", lambda given, *rest: seen.append((given, tiles(given, *rest))) or seen[-1][1])
    got = topk_search.top_k(table, F.col("id") % 50 == 0, block=4, shard=64)
    assert sorted(map(tuple, got.collect())) == brute_top(rows)
    regions = -(-3000 // 64)
    assert seen[0][0].select(F.sum(F.length("matrix"))).first()[0] <= 8 * 8 * (3000 + 60 * regions)
    assert seen[0][1].count() <= 60 * 5 * regions


def test_top_k_in_groups_with_copies_and_odd_rows(spark):
    rng = random.Random(43)
    most = 2**63 - 1
    same = [0.25, -0.5, 0.125]
    rows = [(n, same if n % 3 else [rng.gauss(0, 1) for _ in range(3)]) for n in range(-60, 400)]
    rows += [(7, same), (7, same), (7, [9.0, -9.0, 9.0]), (most, same), (most - 1, [200.0, -300.0, 1.0]), (500, [1e6, 2e6, -3e6]), (501, [1e7, 0.0, -1e7])]
    rows += [(600, [1.0, 2.0]), (650, []), (651, []), (700, [1.0, 2.0, 3.0, 4.0]), (most - 2, [1.0, 2.0, 3.0, 4.0]), (750, [1.0, None, 2.0]), (800, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asks = F.col("id") % 50 == 0
    assert topk_search._shape(topk_search._given(table, "vec_id", "embedding"), asks, 5, 9, 500)[0] > 4
    for block, shard, group in ((512, 4096, topk_search.GROUP), (512, 4096, 500), (2, 9, 500), (1, 1, 10**9)):
        got = topk_search.top_k(table, asks, block=block, shard=shard, group=group)
        assert sorted(map(tuple, got.collect())) == brute_top(rows)
    whole = [(n, [rng.randint(-3, 3) for _ in range(4)]) for n in range(120)]
    got = topk_search.top_k(spark.createDataFrame(whole, "vec_id int, embedding array<int>"), asks, k=200)
    assert sorted(map(tuple, got.collect())) == brute_top(whole, 200)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(23)
    vocabulary = {"en": "the of and that thing over water house".split(), "de": "der die und nicht schoen ueber wasser haus".split()}

    def text(lang, n=80):
        return " ".join(rng.choice(vocabulary[lang]) + str(rng.randint(0, 99)) for _ in range(n))

    bench = [(n, text("en", 20)) for n in range(3)]
    rows = [(n, text(lang), lang, "src", 0) for n, lang in enumerate(["en", "de"] * 20)]
    rows += [(100, rows[0][1], "en", "src", 0), (101, text("en") + " " + bench[0][1], "en", "src", 0), (102, "12345", None, "src", 0), (103, text("de") + " token = deadbeef99", "de", "src", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(range(40)) | {103}
    from wayfold.llm import pieces, sentencepiece_codec

    path = corpus_pipeline.public_tokenizers.path("piece_bpe_32k.model")
    wanted = pieces.load(path).processor.encode(rows[-1][1].replace("token = deadbeef99", "[REDACTED]"))
    assert got[103].ids == wanted and sentencepiece_codec.codec(path).decode(np.array(wanted)).endswith("[REDACTED]")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "decontamination", "secret_scans", "sentencepiece"]


def test_pipeline_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(41)
    stems = "the of and that thing over water house people other would their about which there".split()
    text = lambda n: " ".join(rng.choice(stems) + "abcdefgh"[rng.randrange(8)] for _ in range(n))
    same = text(60)
    rows = [(n, text(60)) for n in range(30)] + [(50, None), (51, ""), (52, "123 456"), (53, text(20_000)), (7, text(60)), (60, same), (61, same), (61, same), (None, same), (None, text(60))]
    columns = "doc_id long, text string, lang string, source string, n_chars long, fp long, key string, _kept long, hit string"
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 1, "k", 2, "h") for i, t in rows], columns)
    bench = spark.createDataFrame([(1, "entirely different words of a benchmark that nobody else has said before")], "item_id long, text string")
    for name, frame_ in (("whole", docs), ("empty", docs.where("false"))):
        folder = f"{tmp_path}/{name}"
        frame_.write.parquet(f"{folder}/documents.parquet")
        bench.write.parquet(f"{folder}/benchmark.parquet")
        got = sorted([r.doc_id for r in corpus_pipeline.run(spark, folder).collect()], key=repr)
        wanted = [*range(30), 53, 7, 60, None] if name == "whole" else []
        assert got == sorted(wanted, key=repr)
