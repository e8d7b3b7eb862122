"""Encoding, secrets, quality rules, line templates and fingerprints against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import cases
from stratalens.sources.staging import staged
from stratalens.llm import bpe, common, fingerprints, line_templates, quality_rules, secrets
from stratalens.llm.queries import tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    return cases.stored(spark, tmp_path_factory.mktemp("docs") / "t", cases.documents(spark))


@pytest.fixture(scope="module")
def rows(docs):
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]


# --- encoding ----------------------------------------------------------------------

def library():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(tokenizer())


def test_codec_equals_the_library():
    theirs, own = library(), bpe.Codec(tokenizer())
    rng = random.Random(3)
    given = [t or "" for t in cases.texts()] + ["a" * 5000, " " * 3000 + "x", "'s''re" * 40, "日本語 テキスト" * 50]
    given += ["".join(rng.choice("abcé'sll <|endoftext|> \n\t日$#0🙂\x1f\x85") for _ in range(rng.randint(0, 90)))
              for _ in range(800)]
    for text in given:
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == theirs.decode(ids, skip_special_tokens=False)


def test_fragments_are_cut_only_where_no_token_reaches():
    own = bpe.Codec(tokenizer())
    raw = "qzjxkvwq 99éé日".encode()
    parts = own.fragments(raw)
    assert b"".join(parts) == raw and len(parts) > 1
    for left, right in zip(parts, parts[1:]):
        assert not any(left[-1:] + right[:1] in token for token in own.bytes_of.values())
    assert own.fragments(b"") == [b""]


def test_scan_and_queue_merge_alike():
    own = bpe.Codec(tokenizer())
    rng = random.Random(5)
    for _ in range(200):
        raw = bytes(rng.choice(b"aaabcdeth ing") for _ in range(rng.randint(1, bpe.SCANNED)))
        assert own.encode_fragment(raw) == own._merged_by_queue([own.id_of_byte[b] for b in raw])


def test_round_trip_of_awkward_rows(docs, rows):
    theirs = library()
    want = []
    for key, text in rows:
        ids = theirs.encode(text or "", add_special_tokens=False).ids
        want.append((key, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    got = [tuple(r) for r in bpe.round_trip(docs, tokenizer()).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    back = bpe.decode(bpe.encode(docs, tokenizer()), tokenizer())
    assert set(back.columns) == {*docs.columns, "n_tokens"}
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(k), t or "") for k, t in rows)
    assert bpe.round_trip(docs.limit(0), tokenizer()).collect() == []


# --- secrets -----------------------------------------------------------------------

def plain_spans(text: str) -> list[tuple[str, int, int]]:
    assign = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|"""
                        r"""[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m.group(2)) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 16]
    return [(secrets.KINDS[k], s, e) for s, k, e in sorted(found)]


def test_pattern_spans():
    rng = random.Random(8)
    parts = ["password", "toKEN", "apikey", "API_KEY", ":", "=", " ", '"', "'", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789",
             "ſecret", "x", "\n", "-", "é"]
    given = [t or "" for t in cases.texts()] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(3000)]
    for text in given:
        assert secrets.pattern_spans(text) == plain_spans(text), text


def test_candidates_are_labelled_where_they_touch_a_span():
    text = ("x1234567890123 token = abcdefgh12345678 127.100.200.201/abc deadbeefdeadbeef00 "
            "incomprehensible " + "q7Z" * 60 + "=deadbeefdeadbeef")
    spans = secrets.pattern_spans(text)
    seen = secrets.candidates(text, spans)
    shown = set()
    for start, end, context, label in seen:
        inside = context[secrets.BEFORE:secrets.BEFORE + secrets.WITHIN].rstrip("\0")
        assert len(context) == secrets.WINDOW and inside in text[start:end]
        touched = any(s < end and e > start for _, s, e in spans)
        assert (label == secrets.INNOCENT) == (not touched)
        shown.add(text[start:end])
    assert shown == set(re.findall(r"[A-Za-z0-9+/_.=-]{12,}", text))  # with a digit or without
    assert {label for *_, label in seen} == {0, 1, 2}


def test_windows_show_whole_candidates():
    text = "before " + "".join(chr(48 + i % 10) for i in range(777)) + " after"
    for start, end in [(7, 19), (7, 47), (7, 48), (7, 784)]:
        covered = set()
        for at, to, context in secrets.windows(text, start, end):
            assert context[secrets.BEFORE:secrets.BEFORE + secrets.WITHIN].rstrip("\0") == text[at:to]
            covered |= set(range(at, to))
        assert covered == set(range(start, end))


def test_scan_of_awkward_rows_keeps_all_pattern_spans(docs, rows):
    got = sorted(((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in secrets.find(docs).collect()), key=str)
    want = []
    for key, text in rows:
        spans = plain_spans(text or "")
        shown = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        counts = Counter(k for k, _, _ in spans)
        want.append((key, counts["assign"], counts["access"], counts["hex"], hashlib.sha256(shown.encode()).hexdigest(), shown))
    want.sort(key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert [s for s in g[5].split(",") if not s.startswith(secrets.MODEL_KIND)] == w[5].split(",")
    assert secrets.find(docs.limit(0)).collect() == []


def test_network_learns_and_keeps_the_recall():
    rng = random.Random(4)
    hexed = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    address = lambda: ".".join(str(rng.randint(100, 255)) for _ in range(4))
    texts = [f"the token = {hexed()} ends" for _ in range(150)] + [f"seen from {address()} at noon" for _ in range(150)]
    found = [(c[2], c[3]) for t in texts for c in secrets.candidates(t, secrets.pattern_spans(t))]
    rng.shuffle(found)
    net = secrets.train(found[:200], found[200:])
    assert net.recall >= secrets.RECALL - 0.02 and net.precision >= 0.95
    score = net.score(secrets.codes([c for c, _ in found[200:]]))
    wrong = [(s >= net.threshold) != bool(y) for s, (_, y) in zip(score, found[200:])]
    assert sum(wrong) <= 3
    assert secrets.train([], []) is None and secrets.train([("x", 1)], [("x", 1)]) is None


def test_curve_through_scores_is_calibrated():
    rng = np.random.default_rng(3)
    sums = rng.normal(0, 30, 20000)
    y = (rng.random(20000) < secrets.logistic(0.08 * sums - 0.5)).astype(int)
    slope, offset = secrets.calibrated(sums, y)
    assert abs(slope - 0.08) < 0.01 and abs(offset + 0.5) < 0.1


def test_secrets_of_kinds_without_a_pattern_are_added(spark, tmp_path):
    """Key names, prefixes and places that neither the patterns nor the variants know; the
    innocent values beside them stay out."""
    rng = random.Random(11)
    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    value = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    known = [f"{cases.prose(i, 30)} token = {value(mixed, 30)} and {value('0123456789abcdef', 40)} {cases.prose(i + 7, 20)}"
             for i in range(300)]
    planted = [f"{cases.prose(i, 20)} webhook_cred: '{value(mixed, 40)}' {cases.prose(i + 3, 9)}" for i in range(60)]
    planted += [f"{cases.prose(i, 20)} (pat_{value(mixed, 36)}) {cases.prose(i + 5, 9)}" for i in range(60)]
    planted += [f"{cases.prose(i, 20)} lease {'word/' * 12}{value(mixed, 40)}" for i in range(60)]  # past the first window
    clean = [f"{cases.prose(i, 20)} https://data.example.com/{cases.prose(i, 1)}/{i}/overview.html {cases.prose(i, 9)}" for i in range(60)]
    clean += [f"{cases.prose(i, 20)} internationalisation-and-misunderstandings {cases.prose(i, 9)}" for i in range(60)]
    given = [(i, t, "en", "plain") for i, t in enumerate(known + planted + clean)]
    docs = cases.stored(spark, tmp_path / "t", cases.documents(spark, given))
    added = {r.doc_id: r.n_model for r in secrets.find(docs).collect()}
    first, last = len(known), len(known) + len(planted)
    assert sum(added[i] > 0 for i in range(first, last)) >= 0.9 * len(planted)
    assert sum(added[i] > 0 for i in range(last, len(given))) <= 0.05 * len(clean)


def test_all_labelled_windows_are_learned_from(spark, tmp_path, monkeypatch):
    """Every finding has a say, however many parts they are dealt to."""
    rng = random.Random(5)
    given = [(i, f"{cases.prose(i, 8)} token = {''.join(rng.choice('abcdefghjkmnpqrstuvw0123456789') for _ in range(30))} "
              f"data/{i}/overview-{i}.html", "en", "plain") for i in range(1800)]
    docs = cases.stored(spark, tmp_path / "t", cases.documents(spark, given))
    monkeypatch.setattr(secrets, "PART", 4000)
    fitted, fit_all = [], secrets.fit_all
    monkeypatch.setattr(secrets, "fit_all", lambda known: fitted.append(
        (known.where("kind = 0").count(), known.where("label = 0 and kind < 3").count())) or fit_all(known))
    scanned = staged(secrets.scan(docs), "scanned")
    net = secrets.learned(scanned)
    want = [scanned.selectExpr("explode(seen) s").where(f"s.label = {x}").select("s.context").distinct().count()
            for x in (secrets.SECRET, secrets.INNOCENT)]
    assert want[0] > 1500  # more than a sample would hold
    assert [f[0] for f in fitted] == [want[0]] * 2
    assert 0.95 * want[1] <= fitted[1][1] <= want[1]
    assert net.recall >= secrets.RECALL - 0.02 and net.precision >= 0.95
    again = secrets.learned(scanned.repartition(7))
    assert all(np.array_equal(a, b) for a, b in zip(net.weights(), again.weights()))


# --- quality rules -----------------------------------------------------------------

def plain_figures(text: str) -> tuple:
    words = WORD.findall(text)
    runs = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(runs)
    covered = {i + k for i, run in enumerate(runs) if often[run] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_figures_and_base_rule(docs, rows):
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
           for r in quality_rules.judged(docs).collect()]
    want = []
    for key, text in rows:
        f = plain_figures(text or "")
        want.append((key, *f, f[0] < 50 or 100 * f[4] > 50 * f[0]))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_thresholds_adapt_to_the_group(spark, tmp_path):
    given = [(i, cases.prose(i, 80), "en", "plain") for i in range(150)]
    given += [(1000 + i, cases.prose(i, 80).replace(" ", "# "), "en", "notes") for i in range(150)]
    given += [(5000, cases.prose(7777, 80).replace(" ", "# "), "en", "plain")]
    docs = cases.stored(spark, tmp_path / "t", cases.documents(spark, given))
    kept = quality_rules.filter_rows(docs)
    assert kept.columns == docs.columns
    gone = {k for k, *_ in given} - {r.doc_id for r in kept.collect()}
    assert gone == {5000}  # symbols are common among the notes, not elsewhere


def test_sketches_merge_exactly(spark, docs):
    read = quality_rules.measured(docs, "text", ["lang", "source"]).withColumns(quality_rules.shares())
    whole = quality_rules.sketches(read, ["lang"])
    parts = quality_rules.merged(quality_rules.sketches(read, ["lang", "source"]), ["lang"])
    assert sorted(map(str, whole.collect())) == sorted(map(str, parts.select(*whole.columns).collect()))


def test_filter_keeps_rows_whole(docs):
    before = sorted(map(str, docs.collect()))
    after = sorted(map(str, quality_rules.filter_rows(docs).collect()))
    assert set(after) <= set(before)
    assert quality_rules.filter_rows(docs.limit(0)).collect() == []


# --- line templates ----------------------------------------------------------------

def test_first_document_keeps_a_recurring_line(spark, tmp_path):
    foot = "Copyright {} by the people of the Northern Valley Press Association, all rights reserved."
    long_ = cases.prose(99, 60)
    given = [(1, cases.prose(1, 30) + "\n" + foot.format(2019) + "\nshort line", "en", "a"),
             (2, foot.format(2021) + "\n" + cases.prose(2, 30) + "\nshort line", "en", "a"),
             (3, cases.prose(3, 30) + "\n" + long_, "en", "a"), (4, long_ + "\r\n" + cases.prose(4, 30), "en", "b"),
             (5, foot.format(2020), "en", "b"), (6, None, None, None), (7, "", "en", "a"),
             (8, cases.prose(8, 30) + "\n" + cases.prose(8, 30), "en", "a")]
    docs = cases.stored(spark, tmp_path / "t", cases.documents(spark, given).coalesce(1))
    out = line_templates.dedup(docs, dropped="gone")
    assert out.columns == [*docs.columns, "gone"]
    got = {r.doc_id: (r.text, r.gone) for r in out.collect()}
    assert got[1] == (given[0][1], []) and got[3] == (given[2][1], [])
    assert got[2] == (cases.prose(2, 30), [0, 2])
    assert got[4] == (cases.prose(4, 30), [0]) and got[5] == ("", [0])
    assert got[6] == (None, []) and got[7] == ("", []) and got[8] == (given[7][1], [])


def test_variable_words_are_generalised(spark, tmp_path):
    line = "Posted on the front page by user {} in the weather section of our paper today"
    given = [(i, cases.prose(i, 20) + "\n" + line.format(n), "en", "a") for i, n in enumerate(["anna", "bert", "carl"])]
    given += [(9, "Posted on the front page was a note that nobody in town ever cared to read", "en", "a")]
    docs = cases.stored(spark, tmp_path / "t", cases.documents(spark, given).coalesce(1))
    got = {r.doc_id: r.gone for r in line_templates.dedup(docs, dropped="gone").collect()}
    assert got == {0: [], 1: [1], 2: [1], 9: []}


def test_families_of_one_leaf_have_templates_of_their_own(spark, tmp_path):
    """A hot and a small family of like start and length, and two of like size."""
    hot = "Posted on the front page by user {} in the weather section of our paper today"
    small = "Posted on the front page while visitor {} was reading about old boats near Genoa bay"
    one, two = "Seen at the north gate where {} sold red apples", "Seen at the north gate before {} drew blue horses"
    names = ["anna", "bert", "carl", "dora", "egon", "fritz"]
    lines = [[hot.format(n)] for n in names] + [[small.format(n), one.format(n), two.format(n)] for n in names[:2]]
    given = [(i, "\n".join([cases.prose(i, 20), *x]), "en", "a") for i, x in enumerate(lines)]
    docs = cases.stored(spark, tmp_path / "t", cases.documents(spark, given).coalesce(1))
    got = {r.doc_id: r.gone for r in line_templates.dedup(docs, dropped="gone").collect()}
    assert got == {0: [], **{i: [1] for i in range(1, 6)}, 6: [], 7: [1, 2, 3]}


def test_many_families_of_one_leaf_take_few_turns(spark, tmp_path, monkeypatch):
    """200 families in one leaf, each with a field of few values shared by all families and
    one of its own: no field tears a family apart, and turns do not grow with families."""
    rng, turns, led = random.Random(2), [], line_templates._led
    monkeypatch.setattr(line_templates, "_led", lambda forms: turns.append(1) or led(forms))
    word = lambda: "".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(4))
    families = [[word() for _ in range(8)] for _ in range(200)]
    line = lambda family, colour: " ".join(["Now at the far gate", *family[:4], colour, *family[4:], word()])
    given = [(i, "\n".join([cases.prose(i, 20), *(line(f, colour) for f in families)]), "en", "a")
             for i, colour in enumerate(["red", "green", "blue"])]
    docs = cases.stored(spark, tmp_path / "t", cases.documents(spark, given).coalesce(1))
    got = {r.doc_id: r.gone for r in line_templates.dedup(docs, dropped="gone").collect()}
    assert got == {0: [], 1: list(range(1, 201)), 2: list(range(1, 201))}
    assert len(turns) <= 7


def test_wide_tables_are_not_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", 5000)
    rows = [(i, ["word"] * 50) for i in range(60)]
    small = cases.stored(spark, tmp_path / "s", spark.createDataFrame(rows, "k long, tokens array<string>"))
    assert not common.fits_broadcast(small) and common.fits_broadcast(small.limit(3)) and common.fits_broadcast(small.select("k"))
    assert common.fits_broadcast(small.limit(0))
    left = spark.range(600).select((F.col("id") % 70).alias("k"), "id")
    joined = common.attach(left, small, ["k"], F.col("id"))
    assert joined.count() == 600 and joined.where("tokens IS NULL").count() == sum(i % 70 >= 60 for i in range(600))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 10)
    assert not common.fits_broadcast(small.select("k"))


def test_short_lines_recur_too(spark, tmp_path):
    given = [(i, f"All rights reserved.\n\n{cases.prose(i, 20)}\nPage {i} of 9\n \nMenu" + "\nonly two" * (i < 2), "en", "a")
             for i in range(4)]
    docs = cases.stored(spark, tmp_path / "t", cases.documents(spark, given).coalesce(1))
    got = {r.doc_id: r.gone for r in line_templates.dedup(docs, dropped="gone").collect()}
    assert got == {0: [], 1: [0, 3, 5, 6], 2: [0, 3, 5], 3: [0, 3, 5]}  # lines 1 and 4 have no token


@pytest.mark.parametrize("hot", [1, 1 / 20, 0])
def test_lines_of_all_lengths_against_brute_force(spark, tmp_path, monkeypatch, hot):
    """Lines of one to six tokens: two forms of six tokens that share a leaf agree in five, so
    a template is the number of tokens and the first five, variables masked. Some, all or no
    forms are hot; the first line is everywhere."""
    monkeypatch.setattr(line_templates, "HOT", hot)
    rng = random.Random(7)
    words = ["red", "mill", "gate", "v1", "v22", "long", "é"]
    made = lambda: (" " * rng.randint(1, 2)).join(rng.choice(words) for _ in range(rng.choice([1, 3, 4, 5, 6, 6])))
    given = [(i, "\n".join(["Home", *(made() for _ in range(rng.randint(0, 14))), ""]), "en", "a") for i in range(50)]
    first, want = {}, {}
    for i, text, *_ in given:
        want[i] = []
        for at, line in enumerate(text.split("\n")):
            tokens = ["<*>" if re.search("[0-9]", t) else t for t in line.split()]
            if tokens and first.setdefault((len(tokens), *tokens[:5]), i) != i:
                want[i].append(at)
    docs = cases.stored(spark, tmp_path / "t", cases.documents(spark, given).coalesce(1))
    assert {r.doc_id: r.gone for r in line_templates.dedup(docs, dropped="gone").collect()} == want
    assert sum(map(len, want.values())) > 100


@pytest.mark.parametrize("block", [line_templates.BLOCK, 3])
def test_forms_that_share_a_crowded_segment_only_find_each_other(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(line_templates, "BLOCK", block)
    word = lambda i: "".join("abcdefghij"[int(c)] for c in f"{i:03}")
    # two of three tokens agree within a pair, one between pairs: all share the first
    given = [(g, f"it was told that in every p{word(g)} q{word(g)}", "en", "a") for g in range(25)]
    given += [(100 + g, f"it was told that in every p{word(g)} r{word(g)}", "en", "a") for g in range(25)]
    docs = cases.stored(spark, tmp_path / "t", cases.documents(spark, given))
    got = {r.doc_id: r.gone for r in line_templates.dedup(docs, dropped="gone").collect()}
    assert got == {k: [0] if k >= 100 else [] for k, *_ in given}


def test_line_templates_of_awkward_rows(docs):
    out = line_templates.dedup(docs, dropped="gone").select("doc_id", "text", "gone").collect()
    assert len(out) == docs.count()
    assert [r.text for r in out if r.doc_id == 12] == [cases.texts()[12]]  # repeats in one document only
    assert line_templates.dedup(docs.limit(0)).collect() == []


# --- fingerprints ------------------------------------------------------------------

def test_edited_fingerprints(docs, rows):
    order = sorted(((k, t or "", i) for i, (k, t) in enumerate(rows)), key=lambda x: (x[0] is not None, x[0] or 0, x[2]))
    want = []
    for (key, text, _), (_, after, _) in zip(order, [*order[1:], order[0]]):
        half = len(text) // 2
        edit = text[:len(text) - half] + after[:half]
        want.append((key, len(text), hashlib.sha256(edit.encode()).hexdigest()))
    got = fingerprints.edited(docs).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == sorted(want, key=str)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert all(r.near_edited == 1 for r in got if r.fingerprint == r.edited_fingerprint)
    assert fingerprints.edited(docs.limit(0)).collect() == []
    alone = fingerprints.edited(docs.where("doc_id = 8")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1


def test_likeness_tells_an_edit_from_another_text(spark, tmp_path):
    given = [(i, "\n".join(cases.prose(100 * i + j, 60) + f" {i}x{j}" for j in range(4)), "en", "a") for i in range(12)]
    got = fingerprints.edited(cases.stored(spark, tmp_path / "t", cases.documents(spark, given))).collect()
    assert all(r.near_edited > 0.3 and r.near_edited > r.near_next for r in got)


def test_all_lanes_of_both_hashes_are_there(spark, tmp_path):
    docs = cases.stored(spark, tmp_path / "t", cases.documents(spark, [(1, cases.prose(1, 400), "", "")]))
    likeness = fingerprints.fingerprint(docs).first().fingerprint[8 * fingerprints.EXACT:]
    lanes = [likeness[i:i + len(likeness) // 128] for i in range(0, len(likeness), len(likeness) // 128)]
    assert len(lanes) == 128 == fingerprints.LANES and lanes[:64] != lanes[64:]


def test_fingerprint_is_a_homomorphism_of_multisets(spark, tmp_path):
    a, b = cases.prose(1, 40) + "\n" + cases.prose(2, 30), cases.prose(3, 50) + "\n" + cases.prose(1, 40)
    given = [(1, a, "", ""), (2, b, "", ""), (3, a + "\n" + b, "", ""), (4, "\n".join(sorted((a + "\n" + b).split("\n"))), "", ""),
             (5, None, "", ""), (6, a + "\n" + cases.prose(1, 40), "", "")]
    docs = cases.stored(spark, tmp_path / "t", cases.documents(spark, given))
    made = fingerprints.fingerprint(docs)
    of = {r.doc_id: r.fingerprint for r in made.collect()}
    assert of[3] == of[4] and len({of[1], of[2], of[3], of[5], of[6]}) == 5 and set(of[5]) == {"0"}
    pair = spark.createDataFrame([(of[1], of[2], of[3])], "a string, b string, c string")
    sums = pair.select(fingerprints.combine(F.col("a"), F.col("b")), fingerprints.combine(F.col("c"), F.col("b"), -1)).first()
    assert tuple(sums) == (of[3], of[1])


def test_long_repetitive_texts_do_not_outgrow_the_lanes(spark, tmp_path):
    long = "a b " * 40_000
    table = cases.stored(spark, tmp_path / "t", cases.documents(spark, [(1, long, "en", "a"), (2, "other words here", "en", "a")]))
    got = {r.doc_id: r for r in fingerprints.edited(table).collect()}
    assert got[1].near_edited > 0.99 and got[1].near_next < 0.5
    # reduced lanes still add up
    both = spark.createDataFrame([(1, long + "\n" + long)], "doc_id long, text string")
    whole = fingerprints.fingerprint(cases.stored(spark, tmp_path / "u", both)).first().fingerprint
    one = F.lit(got[1].fingerprint)
    assert spark.range(1).select(fingerprints.combine(one, one).alias("f")).first().f == whole


def test_repeated_words_of_very_long_texts_are_exact(spark):
    words = [f"w{i:x}" for i in range(4_000_000)]
    text = " ".join([*words, *words[1000:1003]])
    row = quality_rules.measured(spark.createDataFrame([(1, text)], "doc_id long, text string"), "text", ["doc_id"]).first()
    assert (row.n_words, row.n_repeat_words) == (4_000_003, 6)


def test_fences_follow_their_group(spark):
    """A source in which words are long, and one in which lines repeat, set fences of their own."""
    rng = random.Random(6)
    made = lambda size: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(size - 2, size + 2))) for _ in range(80))
    rows = [(i, made(5), "en", "short") for i in range(400)] + [(1000 + i, made(14), "en", "long") for i in range(400)]
    rows += [(5000, made(14), "en", "short"), (5001, made(14), "en", "long"), (5002, "$$ ## " * 9 + made(5), "en", "short")]
    kept = {r.doc_id: r.kept for r in quality_rules.judged(cases.documents(spark, rows)).collect()}
    assert not kept[5000] and kept[5001] and not kept[5002]
    assert sum(kept.values()) == len(rows) - 2


def test_fences_are_pooled_by_weight(spark):
    sketch = lambda rows: spark.createDataFrame(rows, "lang string, source string, rule string, value long, n long")
    own = quality_rules.fences(sketch([("en", "a", "word_length", v, 10) for v in (40_000, 50_000, 60_000, 70_000)]), ["lang", "source"]).first()
    assert (own.texts, own.most, own.decided) == (40, 60_000 + 5 * 20_000, True)
    none = quality_rules.fences(sketch([("en", "a", "upper_share", 0, 10)]), ["lang", "source"]).first()
    assert (none.texts, none.most, none.decided) == (0, None, False)
    row = spark.createDataFrame([(40, 100, 400), (0, None, 400), (10 ** 6, 100, 400)], "t long, m long, c long")
    assert [r.p for r in row.select(quality_rules.pooled("t", "m", "c").alias("p")).collect()] == [266, 400, 100]
