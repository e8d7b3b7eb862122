"""Near copies, mixing, shards, archives, ranking and the pipeline against plain Python."""

from __future__ import annotations

import base64
import hashlib
import os
import random
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import cases
import corpus_pipeline
import oracle
from stratalens.llm import common, mixing, ranking, sharding, simhash, warc
from stratalens.llm.queries import ORACLE, QUERIES
from stratalens.sources.staging import staged


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    return cases.stored(spark, tmp_path_factory.mktemp("docs") / "t", cases.documents(spark))


def groups(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# --- helpers -----------------------------------------------------------------------

def test_numbered_covers_ties_and_nulls(spark):
    rows = spark.createDataFrame([(None, 1), (3, 2), (3, 2), (1, 9), (3, 0)] * 40, "k int, v int").repartition(6)
    got = sorted((r.place, r.k, r.v) for r in common.numbered(rows, ["k", "v"], "place").collect())
    assert [p for p, *_ in got] == list(range(200))
    assert [(k, v) for _, k, v in got] == sorted([(None, 1), (3, 2), (3, 2), (1, 9), (3, 0)] * 40, key=lambda x: (x[0] is not None, x))
    assert common.numbered(rows.limit(0), ["k"], "place").collect() == []


@pytest.mark.parametrize("limit", [common.BROADCAST_ROWS, 1])
def test_attach_broadcast_and_salted(spark, monkeypatch, limit):
    monkeypatch.setattr(common, "BROADCAST_ROWS", limit)
    rows = spark.createDataFrame([(i, ["a", None, "b", "z"][i % 4]) for i in range(100)], "id long, k string")
    small = staged(spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "k string, n int"), "small")
    got = {r.id: r.n for r in common.attach(rows, small, ["k"], F.col("id")).collect()}
    assert got == {i: [1, 2, 3, None][i % 4] for i in range(100)}


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1064)]
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    links = spark.createDataFrame(pairs, "a long, b long")
    assert {r.node: r.root for r in common.components(links).collect()} == groups(nodes, [p for p in pairs if p[0] != p[1]])
    assert common.components(links.limit(0)).collect() == []


def test_workers_get_the_package_from_the_driver(tmp_path):
    """In a folder from which nothing can be imported, operators still run."""
    code = ("import sys; sys.path.insert(0, %r)\n"
            "from stratalens.session import local_session\n"
            "spark = local_session(1, 1)\n"
            "from stratalens.llm import sharding\n"
            "rows = spark.createDataFrame([(1, 'a'), (None, None)], 'doc_id long, text string')\n"
            "print('ROWS', sharding.assign(rows, 4).count())" % str(Path(__file__).parents[2]))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "ROWS 2" in done.stdout, done.stderr[-2000:]


# --- near copies -------------------------------------------------------------------

def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("crowd", [simhash.CROWD, 2])
def test_grid_links_connect_all_close_fingerprints(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(6)
    marks = {0, (1 << 64) - 1}
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(25):
            flipped = base
            for _ in range(rng.randint(0, 4)):
                flipped ^= 1 << rng.randint(0, 63)
            marks.add(flipped)
    for i in range(40):  # a crowded neighbourhood
        marks.add(0xF0F0 ^ (1 << rng.randint(0, 63)) ^ (1 << rng.randint(0, 63)))
    marks = sorted(signed(m) for m in marks)
    close = [(a, b) for i, a in enumerate(marks) for b in marks[:i] if bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 2]
    table = staged(spark.createDataFrame([(m,) for m in marks], "fingerprint long"), "marks")
    links = [(r.a, r.b) for r in simhash.links(table).collect()]
    assert all(bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 2 for a, b in links)
    assert groups(marks, links) == groups(marks, close)


def test_popcounts_bound_the_distance(spark):
    rng = np.random.default_rng(1)
    rows = [(int(a), int(b)) for a, b in rng.integers(-(1 << 63), 1 << 63, (200, 2))]
    df = spark.createDataFrame(rows, "a long, b long").select("a", "b", simhash.embedded(F.col("a")).alias("x"), simhash.embedded(F.col("b")).alias("y"))
    for a, b, x, y in df.collect():
        parts = [((x >> 4 * i) & 15, (y >> 4 * i) & 15) for i in range(16)]
        assert [p for p, _ in parts] == [bin((a >> 4 * i) & 15).count("1") for i in range(16)]
        assert sum(abs(p - q) for p, q in parts) <= bin((a ^ b) & ((1 << 64) - 1)).count("1")


def test_classes_of_awkward_rows(docs):
    got = simhash.classes(docs).collect()
    by = {}
    for key, text in docs.select("doc_id", "text").collect():
        by.setdefault(f"{simhash.simhash(simhash.shingle_hashes(text or '', 3)) & ((1 << 64) - 1):016x}", []).append(key)
    marks = sorted(by)
    near = groups(marks, [(a, b) for a in marks for b in marks if bin(int(a, 16) ^ int(b, 16)).count("1") <= 2])
    want = []
    for mark, keys in by.items():
        ids = [k for m in marks if near[m] == near[mark] for k in by[m] if k is not None]
        want += [(k, mark, min(ids) if ids else None) for k in keys]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert {r.fingerprint for r in got if r.doc_id in (0, 1, 2)} == {"0" * 16}
    assert simhash.classes(docs.limit(0)).collect() == []


def test_simhash_counts_bits_over_half():
    text = " ".join(cases.prose(3, 50_000).split())
    hashes = simhash.shingle_hashes(text, 3)
    want = sum(1 << b for b in range(64) if 2 * int(((hashes >> np.uint64(b)) & np.uint64(1)).sum()) > len(hashes))
    assert simhash.simhash(hashes) & ((1 << 64) - 1) == want
    assert len(simhash.shingle_hashes("A b", 3)) == 1 and len(simhash.shingle_hashes(" \n", 3)) == 0


def test_near_copies_leave_one_of_each_group(spark, tmp_path):
    rng = random.Random(12)
    given, group = [], {}
    for g in range(25):
        base = [f"{w}{rng.randint(0, 400)}" for w in cases.prose(g, 150).split()]
        for c in range(rng.randint(1, 6)):
            words = list(base)
            if c:  # one changed word in 150: at least 0.9 alike
                words[rng.randrange(150)] = f"changed{c}"
            group[len(given)] = g
            given.append((len(given), " ".join(words), "en", "a"))
    given += [(1000, None, None, None), (1001, "", "en", "a"), (1002, " \n", "en", "a"), (1003, given[0][1], "de", "b")]
    docs = cases.stored(spark, tmp_path / "t", cases.documents(spark, given))
    kept = simhash.dedup(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert len({group.get(i) for i in ids if i < 1000}) == 25 and len([i for i in ids if i < 1000]) + (1003 in ids) == 25
    assert len(ids & {1000, 1001, 1002}) == 1
    assert simhash.dedup(docs.limit(0)).collect() == []


def test_near_copy_stage_joins_what_op5_joins(spark, tmp_path):
    # a repeated line decides the fingerprint; the different shingles are mostly unlike
    given = [(i, "same line here again please " * 40 + cases.prose(i, 20), "en", "a") for i in range(4)]
    given += [(10 + i, cases.prose(50 + i, 90), "en", "a") for i in range(4)]
    docs = cases.stored(spark, tmp_path / "t", cases.documents(spark, given))
    classes = {r.doc_id: r.component_id for r in simhash.classes(docs).collect()}
    assert [classes[i] for i in range(4)] == [0] * 4
    assert simhash.similarity(given[0][1], given[1][1], 5) < 0.8
    kept = corpus_pipeline.near_copy_stage(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 10, 11, 12, 13]


def test_unlike_texts_stay_apart(spark, tmp_path):
    given = [(i, cases.prose(i, 90), "en", "a") for i in range(60)]
    docs = cases.stored(spark, tmp_path / "t", cases.documents(spark, given))
    assert simhash.dedup(docs).count() == 60


def test_copies_that_only_their_base_links_are_one_group(spark, tmp_path, monkeypatch):
    """Copies of a base, each at least 0.8 like it and less like one another."""
    monkeypatch.setattr(simhash, "BLOCK", 64)
    rng = random.Random(21)
    base = [f"w{i}" for i in range(300)]
    given = [(0, " ".join(base), "en", "a")]
    for c in range(1, 400):
        words = list(base)
        for i in rng.sample(range(10, 290), 6):
            words[i] = f"c{c}x{i}"
        given.append((c, " ".join(words), "en", "a"))
    given += [(1000 + i, cases.prose(i, 90), "en", "a") for i in range(20)]
    sets = {k: set(simhash.shingle_hashes(t, 5).tolist()) for k, t, *_ in given}
    like = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(like) < 3000
    docs = cases.stored(spark, tmp_path / "t", cases.documents(spark, given).repartition(3))
    want = groups(sets, like)
    assert len(set(want.values())) == 21
    ids = {r._row: r._given.doc_id for r in common.given(docs).collect()}
    found = {ids[r._row]: ids[r._root] for r in simhash.near_copies(common.given(docs).select("_row", F.col("_given.text").alias("text"))).collect()}
    pairs = [(k, found.get(k, k)) for k in sets]
    assert groups(sets, pairs) == want
    assert simhash.dedup(docs).count() == 21


def test_texts_with_a_shared_passage_alone_do_not_move(spark, tmp_path, monkeypatch):
    """A common passage makes pairs of entries; texts move where enough of their rarest shingles agree."""
    passage = " ".join(f"shared{i}" for i in range(9))
    given = [(i, " ".join(f"w{i}x{j}" for j in range(60)) + " " + passage, None, None) for i in range(30)]
    given += [(100, given[0][1] + " more", None, None)]
    docs = cases.stored(spark, tmp_path / "t", cases.documents(spark, given))
    asked, compare = [], simhash._verified
    monkeypatch.setattr(simhash, "_verified", lambda rows, pairs, *how: asked.append(pairs.count()) or compare(rows, pairs, *how))
    monkeypatch.setattr(simhash, "bands", lambda hashes: [])  # all is left to the rarest shingles,
    monkeypatch.setattr(simhash, "COMMON", 0)  # the passage's among them
    monkeypatch.setattr(common, "BROADCAST_ROWS", 3)
    assert simhash.dedup(docs).count() == 30
    assert sum(asked) == 1


@pytest.mark.parametrize("bits", [1 << 20, 1 << 21, simhash.MAP_BITS])
def test_the_map_passes_every_shared_shingle(spark, bits, monkeypatch):
    monkeypatch.setattr(simhash, "MAP_BITS", bits)
    monkeypatch.setattr(simhash, "PART_BITS", 1 << 19)
    keys = [0, -1, 1, (1 << 63) - 1, -(1 << 63), *[x * 0x9E3779B97F4A7C15 % (1 << 63) - (1 << 62) for x in range(500)]]
    marked = simhash._marked(spark.createDataFrame([(k,) for k in keys], "_h long"))
    rows = [(i, 3, 2, [k, k + 12345 if k < 1 << 62 else 7]) for i, k in enumerate(keys)]
    chosen = spark.createDataFrame([*rows, (9999, 0, 0, [])], "_row long, _size int, _rare int, _prefix array<long>")
    listed = {(r._row, r._at, r._h) for r in simhash._listed(chosen, marked).collect()}
    assert {(i, 0, k) for i, k in enumerate(keys)} <= listed
    assert len(listed) < len(keys) + 20 and all(rows[i][3][at] == h for i, at, h in listed)


@pytest.mark.parametrize("block", [simhash.BLOCK, 4])
def test_near_copies_equal_brute_force(spark, tmp_path, monkeypatch, block):
    """Also without bands, fingerprints and leaders to help: all pairs near the limit are found."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "bands", lambda hashes: [])
    rng = random.Random(5)
    given = []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(rng.choice([8, 60, 150]))]
        for c in range(15):
            words = list(base)[:rng.randint(len(base) * 3 // 4, len(base))]
            for i in rng.sample(range(len(words)), rng.randint(0, max(1, len(words) // 40))):
                words[i] = f"c{c}x{i}"
            given.append((len(given), " ".join(words), "en", "a"))
    sets = {k: set(simhash.shingle_hashes(t, 5).tolist()) for k, t, *_ in given}
    like = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    docs = cases.stored(spark, tmp_path / "t", cases.documents(spark, given).repartition(3))
    assert simhash.dedup(docs).count() == len(set(groups(sets, like).values()))


# --- mixing ------------------------------------------------------------------------

def plain_targets(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, full = float(sum(sizes.values())), set()
    while True:
        left = total - sum(3.0 * sizes[s] for s in full)
        free = sum(weight[s] for s in order if s not in full)
        share = {s: 3.0 * sizes[s] if s in full else weight[s] * left / free for s in order}
        over = {s for s in order if s not in full and share[s] > 3.0 * sizes[s]}
        if not over:
            return share
        full |= over


def check_mix(df):
    rows = mixing.plan(df).collect()
    text = {}
    for r in df.select("doc_id", "text").collect():
        text.setdefault(r.doc_id, set()).add(len((r.text or "").encode().split()))
    sizes = {}
    for r in rows:
        assert r["size"] in text[r.doc_id]
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    want = plain_targets(sizes)
    largest = {}
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-9)
        assert r.taken == r["size"] * r.times and 0 <= r.times <= 3
        largest[r.source] = max(largest.get(r.source, 0), r["size"])
    for source in sizes:
        taken = sum(r.taken for r in rows if r.source == source)
        assert abs(taken - want[source]) <= largest[source] + 1
    assert sorted(map(str, rows)) == sorted(map(str, mixing.plan(df).collect()))


def test_mix_of_awkward_rows(docs):
    check_mix(docs)
    assert mixing.plan(docs.limit(0)).collect() == []


def test_mix_meets_targets(spark, sf_dir, tmp_path):
    check_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    given = [(i, cases.prose(i, 20 + i % 50), "en", "big" if i % 3 else f"s{i % 7}") for i in range(600)]
    docs = cases.stored(spark, tmp_path / "t", cases.documents(spark, given))
    check_mix(docs)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    times = {r.doc_id: r.times for r in mixing.plan(docs).collect()}
    found = {}
    for r in mixed.collect():
        found[r.doc_id] = found.get(r.doc_id, 0) + 1
    assert found == {k: t for k, t in times.items() if t}


def test_thresholds_nest(spark, tmp_path):
    given = [(i, cases.prose(i, 30), "en", "a") for i in range(200)]
    sized = mixing.plan(cases.stored(spark, tmp_path / "t", cases.documents(spark, given)), also=("text",))
    sized = staged(sized.select("doc_id", "source", F.col("size").alias("_size"),
                                F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1).alias("_hash")), "sized")
    taken = []
    for rest in (500.0, 1500.0, 4000.0):
        limit = mixing.thresholds(sized, spark.createDataFrame([("a", rest)], "source string, rest double")).first()["limit"]
        rows = sized.where(F.col("_hash") <= limit).collect()
        assert abs(sum(r._size for r in rows) - rest) <= 30
        taken.append({r.doc_id for r in rows})
    assert taken[0] < taken[1] < taken[2]


# --- shards ------------------------------------------------------------------------

def plain_jump(key: int, n: int) -> int:
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_equals_the_plain_loop_and_moves_only_to_new_shards():
    keys = np.random.default_rng(3).integers(0, 1 << 63, 4000, dtype=np.uint64)
    before = None
    for n in (1, 2, 5, 16, 17):
        got = sharding.jump(keys, n)
        assert got.tolist() == [plain_jump(int(k), n) for k in keys]
        assert np.bincount(got, minlength=n).min() > 4000 / n * 0.7
        if before is not None and n == 17:
            assert set(got[got != before]) == {16} and (got != before).mean() < 0.1
        before = got


def test_shards_of_awkward_rows(docs):
    rows = sharding.assign(docs, 16).collect()
    assert len(rows) == docs.count()
    where, slots = {}, {}
    for r in rows:
        assert where.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard)
        assert r.grown_shard in (r.shard, 16)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = sorted((str(k), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in docs.select("doc_id", "text").collect())
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in rows) == want
    assert sharding.assign(docs.limit(0), 16).collect() == []
    with pytest.raises(ValueError):
        sharding.assign(docs, 0)


def test_written_shards_hold_all_rows(spark, docs, tmp_path):
    sharding.write_shards(docs.drop("shard"), str(tmp_path / "s"), 4, files_per_shard=2)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == docs.count() and {r.shard for r in back.collect()} <= set(range(4))


# --- archives ----------------------------------------------------------------------

def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, _row int")


PAGES = [(5, "http://A.example.com:8080/x?q=1#top", "<p>same</p>", "d", 1), (3, "https://www.example.com/a", "<p>same</p>", "d", 1),
         (9, None, None, "d", 1), (4, "http://example.com/b\r\nWARC-Type: x", "", "d", 1), (7, "not a url", "a\r\n\r\nb\r\n\r\n", "d", 1),
         (8, "http://[bad", "é🙂\n" * 2000, "d", 1), (3, "https://www.example.com/a", "<p>same</p>", "d", 1),
         (10, "http://example.com/a", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc", "d", 1), (11, "http://example.com/a", "x" * 300_000, "d", 1)]


@pytest.mark.parametrize("least", [0, 5])
def test_archives_round_trip(spark, tmp_path, least):
    given = cases.stored(spark, tmp_path / "p", pages(spark, PAGES))
    got = warc.round_trip(given, least).collect()
    first = {}
    for key, _, html, *_ in PAGES:
        first[html or ""] = min(first.get(html or "", key), key)
    want = []
    for key, _, html, *_ in PAGES:
        data = (html or "").encode()
        refers = first[html or ""] if len(data) >= least and first[html or ""] != key else None
        want.append((key, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if refers else "response", refers))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    ordered = [(r.urlkey, r.timestamp, r.page_id) for r in sorted(got, key=lambda r: (r.part, r.place))]
    assert ordered == sorted(ordered)
    assert warc.round_trip(given.limit(0)).collect() == []


def test_loser_tree_merges_like_a_sort():
    rng = random.Random(9)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((rng.randint(0, 40), (i, j)) for j in range(rng.choice([0, 1, 30]))) for i in range(k)]
        assert [(x, y) for x, y in warc.merged([[(key, (key, row)) for key, row in r] for r in runs])] == sorted(x for r in runs for x in r)


def test_index_is_ordered_over_many_parts(spark, tmp_path):
    rows = [(i, f"http://host{i % 3}.example.com/{i % 50}", f"<p>{i % 400}</p>", "d", 1) for i in range(2000)]
    given = cases.stored(spark, tmp_path / "p", pages(spark, rows).repartition(5))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = warc.round_trip(given).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    keys = [(r.urlkey, r.timestamp, r.page_id) for r in sorted(index, key=lambda r: (r.part, r.place))]
    assert keys == sorted(keys) and len(keys) == 2000 and len({r.part for r in index}) > 1


# --- ranking -----------------------------------------------------------------------

def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = QUERIES["op2_pairwise_ranking"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    good, bad = [r.score for r in held if r.quality], [r.score for r in held if not r.quality]
    assert sum((r.predicted == r.quality) for r in held) / len(held) > 0.95
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.95


def test_ranking_of_awkward_rows(spark, docs):
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(12)] * 2 + [(None, 1, 0), (99, None, 0)], "doc_id long, quality int, toxic int")
    rows = ranking.classify(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.score == 0.5 and r.predicted == 1 for r in ranking.classify(docs, labels.limit(0)).collect())
    assert ranking.classify(docs.limit(0), labels).collect() == []


def test_pairs_are_ordered():
    rng = np.random.default_rng(2)
    good, bad = rng.normal(0.6, 0.1, (300, 3)), rng.normal(0.4, 0.1, (100, 3))
    model = ranking.fit(good, bad, 0.25)
    assert model.agreement > 0.95 and all(w > 0 for w in model.weights)
    assert ranking.fit(good, bad[:0], 0.0).weights == [0.0] * 3


# --- pipeline and queries ----------------------------------------------------------

def test_stages_keep_columns_and_act(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, "/root/testdata/sf0.001")
        if name != names[-1]:
            assert out.dtypes == rows.dtypes
        rows = cases.stored(spark, tmp_path / name, out)
        seen[name] = {r.doc_id for r in rows.collect()}
    first = {r.doc_id for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert seen["quality_rules"] < first and seen["line_dedup"] == seen["quality_rules"]
    assert seen["simhash_near_dedup"] <= seen["line_dedup"] and seen["source_mixing"] <= seen["simhash_near_dedup"]
    assert seen["bpe_encoding"] == seen["source_mixing"] and "ids" in rows.columns


def test_stages_of_awkward_rows(spark, docs, tmp_path):
    rows = docs
    for name, stage in corpus_pipeline.STAGES:
        rows = cases.stored(spark, tmp_path / name, stage(spark, rows, ""))
    assert "n_tokens" in rows.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").collect() == []


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, sf_dir, name):
    assert oracle.differences(QUERIES[name](spark, sf_dir), oracle.connect(sf_dir), ORACLE[name]) == []


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))


def test_a_damaged_record_stops_the_read(spark, tmp_path):
    import gzip

    pages = spark.createDataFrame([(1, "http://a.b/c", "payload one")], "page_id long, url string, html string")
    warc.write(cases.stored(spark, tmp_path / "pages", pages), str(tmp_path / "w"))
    [archive] = list((tmp_path / "w").glob("part-*.gz"))
    data = gzip.decompress(archive.read_bytes())
    assert len(warc.captures(gzip.compress(data), "x")) == 1
    with pytest.raises(ValueError, match="payload of the record at 0"):
        warc.captures(gzip.compress(data.replace(b"payload one", b"payload two")), "x")


def test_ranges_of_the_index_grow_in_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "PER_RANGE", 10)
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.b/{i}", "x") for i in range(300)], "page_id long, url string, html string")
    got = warc.round_trip(cases.stored(spark, tmp_path / "pages", pages)).orderBy("part", "place").collect()
    assert len({r.part for r in got}) > 10
    assert [(r.urlkey, r.timestamp, r.page_id) for r in got] == sorted((r.urlkey, r.timestamp, r.page_id) for r in got)
    index = warc.ranked(warc.round_trip(cases.stored(spark, tmp_path / "again", pages))).orderBy("rank").collect()
    assert [r.page_id for r in index] == [r.page_id for r in got]
    assert [r["rank"] for r in index] == list(range(len(got)))
