"""Conversation repair, digest index and periodic runs against plain Python."""

from __future__ import annotations

import random
import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import cases
from stratalens.llm import common, conversation_repair, digest_index, line_templates, mixing, periodic_runs, quality_rules
from stratalens.sources.staging import staged_path

TALK = "conv_id long, turn long, role string, text string, fault string, cost long, _row long, _copy long"


# --- row numbers --------------------------------------------------------------------------

def split_anew(spark, cores: int) -> None:
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", str(cores))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k" if cores > 8 else "128m")


@pytest.fixture
def files(spark, tmp_path):
    cases.documents(spark).repartition(6).write.parquet(str(tmp_path / "a b"))
    yield spark.read.parquet(str(tmp_path / "a b"))
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_row_numbers_do_not_depend_on_the_split(spark, files):
    seen = []
    for cores in (2, 4, 64):
        split_anew(spark, cores)
        rows = common.with_row(files.select("text"), "_n").collect()
        assert len({r["_n"] for r in rows}) == len(rows) == files.count()
        seen.append(sorted((r["_n"], r["text"] or "") for r in rows))
    assert seen[0] == seen[1] == seen[2]


@pytest.mark.parametrize("made", [line_templates.dedup, quality_rules.filter_rows, mixing.mix],
                         ids=["lines", "quality", "mix"])
def test_operators_built_under_one_split_and_read_under_another(spark, files, made):
    split_anew(spark, 2)
    first = made(files)
    expected = sorted(map(repr, first.collect()))
    second = made(files)
    split_anew(spark, 64)
    assert sorted(map(repr, second.collect())) == expected


def test_rows_of_no_stored_table_are_written_first(spark):
    rows = common.with_row(spark.range(5).union(spark.range(5)), "_n").collect()
    assert len({r["_n"] for r in rows}) == 10


# --- conversations ------------------------------------------------------------------------

def cheapest(rows: list[tuple[str, int]]) -> tuple[int, str]:
    """Least (cost, edits) by trying all edits from the end."""
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    best = {}
    for i in range(len(rows), -1, -1):
        now = {s: ((0, "") if s in ("", "a") else (10 ** 9, "")) for s in after} if i == len(rows) else {}
        if i < len(rows):
            initial, fault = rows[i]
            for s in after:
                ways = [(2, "D", s)]
                if fault in (0, 3):
                    more = 5 if fault else 0
                    ways.append((1 + more, "R", after[s]))
                    if initial == after[s] or (initial == "s" and s == ""):
                        ways.append((more, "K", initial))
                now[s] = min((c + best[t][0], e + best[t][1]) for c, e, t in ways)
        for _ in range(4):
            for s, t in after.items():
                now[s] = min(now[s], (5 + now[t][0], "I" + now[t][1]))
        best = now
    return best[""]


def plainly_repaired(rows: list[tuple], damage: bool) -> dict:
    """rows: (conv, turn, role, text) in stored order."""
    talks = {conv: [] for conv, *_ in rows}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        shown = [" " if x is None else str(x) for x in (conv, turn)]
        kind = zlib.crc32(":".join(shown).encode()) % 20 if damage else 19
        if kind == 0:
            continue
        text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        talks[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, talk in talks.items():
        talk.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, faults = set(), []
        for _, role, text in talk:
            bare = text.strip(" \t\n\x0b\f\r")
            fault = 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0
            seen.add((role, text))
            faults.append(fault)
        cost, audit = cheapest([(role[:1], f) for (_, role, _), f in zip(talk, faults)])
        lines, at, state = [], 0, ""
        for edit in audit:
            added = "assistant" if state == "u" else "user"
            if edit == "I":
                lines.append(f"{added}:")
            elif edit in "KR":
                lines.append(f"{talk[at][1] if edit == 'K' else added}:{talk[at][2]}")
            at += edit != "I"
            if edit != "D":
                state = lines[-1][0]
        turns = {t for t, *_ in talk if t is not None}
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(talk, talk[1:])]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(f) for f in (1, 2, 3)],
                     sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha256("\n".join(lines).encode()).hexdigest())
    return out


def talks(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for conv in [*range(60), None, 2 ** 60 + 1]:
        for turn in range(rng.randint(1, 12)):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 1, turn * 3, None]),
                         rng.choice(["user", "assistant", "assistant", "user", "system", "tool", None, "", "Users"]),
                         rng.choice(["Yes.", "No!", "why?", "cut off", "", " \n", None, "é🙂 x. ", "A.b!c?"])))
    rows += [(7, 1, "user", "Same.")] * 3 + [(1000, t, ("user", "assistant")[t % 2], f"Line {t}.") for t in range(300)]
    return rows


def repaired(spark, path, rows, damage, **how):
    table = cases.stored(spark, path, spark.createDataFrame([(*r, "f", 1, 2, 3) for r in rows], TALK).coalesce(1))
    found = conversation_repair.repair(table, damage=damage, **how).collect()
    assert len(found) == len({r[0] for r in rows})
    return {r["conv_id"]: tuple(r[c] for c in (*conversation_repair.COUNTS, "audit", "repaired_sha256")) for r in found}


@pytest.mark.parametrize("damage", [True, False])
def test_conversations_equal_plain_repair(spark, tmp_path, damage):
    rows = talks(3)
    assert repaired(spark, tmp_path / "t", rows, damage) == plainly_repaired(rows, damage)


def test_long_conversations_spill_blocks(spark, tmp_path):
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), f"Line {rng.randint(0, 400)}" + rng.choice([".", "", "!"]))
            for c in (1, 2) for t in range(700)]
    assert repaired(spark, tmp_path / "u", rows, True, block_rows=64) == plainly_repaired(rows, True)


def test_blocks_of_pointers_join_up():
    """Any cut of a conversation into blocks gives the same edits."""
    steps_of = conversation_repair.machine()
    assert len(steps_of.into) < 256
    rng = random.Random(5)
    for _ in range(300):
        rows = [(rng.choice("suax"), rng.randrange(4)) for _ in range(rng.randint(0, 14))]
        state, cost, steps = 0, 0, []
        for initial, fault in reversed(rows):
            step = steps_of.next[state][conversation_repair.kind_of(initial, fault)]
            steps.append(step)
            state, cost = steps_of.into[step], cost + steps_of.least[step]
        talk = conversation_repair.Conversation("=1")
        steps, faults = bytes(steps[::-1]), bytes(f for _, f in rows)
        for start in range(0, len(rows), 4):
            talk.block(steps[start:start + 4], faults[start:start + 4], cost + steps_of.costs[state][0])
            for initial, _ in rows[start:start + 4]:
                talk.row(None, initial, "x")
        if rows:
            *_, total, audit, _ = talk.result()
            assert (total, audit) == cheapest(rows)


def test_a_block_that_does_not_fit_is_refused():
    talk = conversation_repair.Conversation("=1")
    talk.block(b"\0\0", b"\0\0", None)
    with pytest.raises(ValueError, match="left over"):
        talk.block(b"\0", b"\0", 1)


def test_no_conversations(spark, tmp_path):
    assert repaired(spark, tmp_path / "t", [], True) == {}


# --- digest index ---------------------------------------------------------------------------

@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    return cases.stored(spark, tmp_path_factory.mktemp("docs") / "t", cases.documents(spark))


def test_groups_of_equal_texts(spark, docs):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    found = [tuple(r) for r in digest_index.groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    expected = []
    for text in {t for _, t in rows}:
        ids = [i for i, t in rows if t == text]
        keep = max((i for i in ids if i is not None), default=None)
        kept = [False] * len(ids)
        kept[ids.index(keep)] = True
        expected += [(i, keep, len(ids), k, sha256(text.encode()).hexdigest()) for i, k in zip(ids, kept)]
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(found, key=order) == sorted(expected, key=order)
    assert digest_index.groups(docs.limit(0)).count() == 0


def test_arrivals_meet_the_stored_index(spark, docs):
    path = staged_path(spark, "index")
    index = digest_index.open_index(spark, path, T.LongType(), buckets=4)
    texts = lambda df: sorted((r["text"] or "") for r in df.collect())
    distinct = {r["text"] or "" for r in docs.select("text").collect()}
    assert texts(digest_index.admit(docs, index, "one")) == sorted(distinct)
    assert digest_index.admit(docs, index, "two").count() == 0
    assert texts(digest_index.admit(docs, index, "one")) == sorted(distinct)  # repeated after a failure
    spark.sql(f"DROP TABLE {index.table}")  # a later session knows the folder only
    again = digest_index.open_index(spark, path, T.LongType(), buckets=99)
    assert again.buckets == 4 and again.entries().count() == len(distinct)
    more = cases.documents(spark, [(900, "a new text", "en", "a"), (901, "one", "en", "a"), (899, "a new text", "en", "a")])
    new = digest_index.admit(more, again, "three").collect()
    assert [(r["doc_id"], r["text"], r["_text"]) for r in new] == [(900, "a new text", "t")]
    packed = again.compact(staged_path(spark, "packed"))
    assert packed.entries().count() == len(distinct) + 1


def test_the_index_is_read_in_place_by_a_sort_merge_join(spark, docs):
    index = digest_index.open_index(spark, staged_path(spark, "index"), T.LongType(), buckets=4)
    digest_index.admit(docs, index, "one")
    new = docs.select(digest_index.digest_of(F.col("text")).alias("digest")).distinct()
    plan = new.hint("merge").join(index.entries(), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan and plan.count("Exchange") == 1


# --- periodic runs --------------------------------------------------------------------------

def plain_runs(words: list) -> list[tuple[int, int, int]]:
    found, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                part = words[i:j + q]
                if not any(part[p:] == part[:-p] for p in range(1, q)):
                    found.append((i, j - i + q, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_equal_all_shifts():
    rng = random.Random(2)
    for _ in range(3000):
        n, k = rng.randint(0, 80), rng.choice([1, 2, 2, 3, 6, 30])
        words = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.6:
            a = rng.randrange(n)
            p = 1 + (n - a) // rng.randint(3, 10)
            words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
        expected = plain_runs(words)
        assert list(map(tuple, periodic_runs.runs(np.array(words, dtype=np.int64)).tolist())) == expected
        closed = np.array([w + 1 for w in words] + [0])  # the trees alone, without cuts
        assert list(map(tuple, periodic_runs.runs_of(closed, 1).tolist())) == expected


def test_extensions_equal_letter_by_letter():
    rng = random.Random(4)
    for _ in range(200):
        symbols = [rng.randint(1, 3) for _ in range(rng.randint(1, 40))] + [0]
        leaves, between = periodic_runs.Tree(symbols).tour()
        assert [symbols[i:] for i in leaves] == sorted(symbols[i:] for i in range(len(symbols)))
        common = periodic_runs.Extensions(leaves, between)
        pairs = [(i, j) for i in range(len(symbols)) for j in range(len(symbols)) if i != j]
        found = common.common(np.array([i for i, _ in pairs]), np.array([j for _, j in pairs]))
        for (i, j), length in zip(pairs, found):
            assert symbols[i:i + length] == symbols[j:j + length]
            assert symbols[i + length:i + length + 1] != symbols[j + length:j + length + 1]


def test_documents_equal_plain_runs(spark, docs):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()
            if len(r["text"] or "") < 20_000]
    rows += [(i, " ".join(random.Random(i).choices("abcdefg", k=90)) + " x y" * 7) for i in range(100, 180)]
    rows += [(2 ** 60 + 1, "a b " * 9), (None, "no end " * 5)]
    table = cases.documents(spark, [(i, t, "en", "a") for i, t in rows])
    names = ["doc_id", *[c.split()[0] for c in periodic_runs.RESULT.split(", ")]]
    found = [tuple(r[c] for c in names) for r in periodic_runs.detect(table, damage=True).collect()]
    expected = []
    for i, text in rows:
        words = [w for w in text.translate({c: " " for c in range(9, 14)}).split(" ") if w]
        n, h = len(words), zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (k - a) % p] if k >= a else w for k, w in enumerate(words)]
        runs = plain_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        kept = [w for k, w in enumerate(words) if not any(s + q <= k < s + n for s, n, q in runs)]
        expected.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
                         sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
                         sha256(" ".join(kept).encode()).hexdigest()))
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    assert periodic_runs.detect(table.limit(0)).count() == 0
