"""The review flow against a plain Python walk over one project at a time."""

from __future__ import annotations

import json
import random

import pytest
from helpers import files, record

from stratalens.operators import parts
from stratalens.plans.full import Replies, analyze_full
from stratalens.plans.scored import score_files
from stratalens.sources.catalog import ENTRIES
from stratalens.sources.projects import split_sources
from stratalens.sources.report import nested_reports
from stratalens.operators.review import ambiguous_names
from pyspark.sql import functions as F

SEVERITY = {key: severity for key, severity, _, _ in ENTRIES}
POINTS = {"CRITICAL": 15, "HIGH": 10, "MEDIUM": 5, "LOW": 2}
KINDS = [
    {}, {"has_broad_catch": True}, {"uses_new_keyword": True}, {"controller_deps": 2},
    {"layer": "controller", "has_http_handling": True}, {"has_data_access": True},
    {"layer": "controller", "has_validation": True}, {"layer": "unknown", "has_validation": True},
]


def corpus(seed: int, projects: int = 12, size: int = 9) -> list[dict]:
    rng = random.Random(seed)
    rows = []
    for pid in range(projects):
        for seq in range(rng.randint(1, size)):
            given = dict(rng.choice(KINDS), total_cross_layer_deps=rng.randint(0, 7))
            text = None if pid % 4 == 3 or rng.random() < 0.3 else f"class F{seq}"
            rows.append(record(project_id=pid, file_seq=seq, source_code=text, **given))
    return rows


def verdict_text(pid: int, kind: str) -> str | None:
    rng = random.Random(f"{pid}{kind}")
    reply = {"is_valid": rng.random() < 0.6, "description": rng.choice(["", "seen"]),
             "severity": rng.choice(["", "CRITICAL"]), "after_code": rng.choice(["", "x"])}
    shape = rng.randrange(4)
    if shape == 3:
        return rng.choice([None, "no idea", "[]"])
    return json.dumps(reply) if shape else f"```json\n{json.dumps(reply)}\n```"


def check_text(pid: int, seq: int) -> str:
    rng = random.Random(f"{pid}-{seq}")
    found = [{"type": t, "severity": rng.choice(["LOW", "HIGH"]), "description": f"d{seq}"}
             for t in rng.sample(["broad_catch", "layer_skip", "", "no_validation"], 2)]
    return json.dumps({"has_issues": rng.random() < 0.7, "anti_patterns": found})


def assessment(pid: int, names: list[str]) -> str:
    rng = random.Random(pid * 7)
    scores = {n: rng.choice([rng.randint(-20, 130), "n/a", str(rng.randint(0, 9))])
              for n in sorted(names) if rng.random() < 0.6}
    body = {"overall_score": 50, "reasoning": "why", "file_scores": scores, "strengths": ["s"]}
    if pid % 5 == 0:
        body.pop("overall_score")
    return f"Here: {json.dumps(body)} done"


def confidence(row: dict) -> float:
    return random.Random(f"{row['project_id']}/{row['file_seq']}").choice([0.55, 0.65, 0.7, 0.9])


def walk(rows: list[dict], labels: dict, layers: dict, scores: dict) -> dict:
    """Expected outcome of one project, file by file."""
    pid = rows[0]["project_id"]
    kept, order, clean, cleared, rejected = {}, [], [], set(), 0
    groups: dict[str, list] = {}
    for row in rows:
        seq = row["file_seq"]
        if labels[pid, seq] == "clean":
            clean.append(seq)
        else:
            groups.setdefault(labels[pid, seq], []).append(seq)
    source = {r["file_seq"] for r in rows if r["source_code"]}
    attempted = bool(source and groups)
    for kind, members in groups.items():
        text = verdict_text(pid, kind) if attempted and source & set(members) else None
        reply = {}
        if text and "{" in text:
            reply = json.loads(text.removeprefix("```json\n").removesuffix("\n```"))
        if not reply.get("is_valid", True):
            rejected += 1
            clean += members
            cleared |= set(members)
            continue
        kept[kind] = {
            "files": list(members), "layers": {layers[pid, s] for s in members},
            "conf": [confidence(rows[s]) for s in members],
            "severity": reply.get("severity") or SEVERITY[kind], "seen": bool(reply),
            "fix": bool(reply) and bool(reply.get("after_code")),
        }
        order.append(kind)
    again = [s for s in clean if attempted and s in source and s not in cleared
             and confidence(rows[s]) < 0.7]
    for seq in sorted(again):
        reply = json.loads(check_text(pid, seq))
        for finding in reply["anti_patterns"] if reply["has_issues"] else []:
            kind = finding["type"]
            if not kind:
                continue
            if kind not in kept:
                order.append(kind)
                kept[kind] = {"files": [], "layers": set(), "conf": [], "seen": True,
                              "severity": finding["severity"], "fix": False}
            kept[kind]["files"].append(seq)
            kept[kind]["layers"].add(rows[seq]["layer"])
            kept[kind]["conf"].append(0.0)
            if seq in clean:
                clean.remove(seq)
    names = [r["file_name"] for r in rows]
    told = json.loads(assessment(pid, names)[6:-5])
    given = told["file_scores"] if "overall_score" in told else {}
    final = {}
    for row in rows:
        seq, score = row["file_seq"], scores[pid, row["file_seq"]]
        if source and row["file_name"] in given:
            try:
                reply_score = float(given[row["file_name"]])
            except ValueError:
                reply_score = score
            value = 0.4 * score + 0.6 * reply_score
        elif source:
            value = score - sum(POINTS.get(g["severity"], 0) * g["files"].count(seq)
                                for g in kept.values())
            value += 5 * (seq in clean) + 3 * (seq in cleared)
        else:
            value = score
        final[seq] = round(max(0.0, min(100.0, value)), 1)
    rank = {s: i for i, s in enumerate(["CRITICAL", "HIGH", "MEDIUM", "LOW", "NONE"])}
    details = [
        (k, kept[k]["severity"], ", ".join(sorted(kept[k]["layers"])),
         round(sum(kept[k]["conf"]) / len(kept[k]["conf"]), 2), len(kept[k]["files"]),
         kept[k]["seen"], kept[k]["fix"])
        for k in sorted(order, key=lambda k: rank.get(kept[k]["severity"], 5))
    ]
    lists = {k: [rows[s]["file_name"] for s in kept[k]["files"]] for k in kept}
    method = "ml_only"
    if source:
        method = "hybrid" if "overall_score" in told else "ml_adjusted" if attempted else "ml_only"
    return {"details": details, "lists": lists, "clean": sorted(clean), "scores": final,
            "rejected": rejected, "enhanced": attempted, "method": method}


def tables(spark, rows: list[dict]):
    df, _ = split_sources(files(spark, *rows))
    values = [(r["project_id"], r["file_seq"], confidence(r)) for r in rows]
    sure = spark.createDataFrame(values, "project_id long, file_seq long, conf double")
    scored = score_files(df).join(sure, ["project_id", "file_seq"]).withColumn(
        "confidence", F.col("conf")).drop("conf")
    pids = sorted({r["project_id"] for r in rows})
    n_parts = 1 + max(r["file_seq"] for r in rows) // parts.PART_FILES
    names = {p: [r["file_name"] for r in rows if r["project_id"] == p] for p in pids}
    verdicts = [(p, k, i, verdict_text(p, k)) for p in pids for k in SEVERITY for i in range(n_parts)]
    replies = Replies(
        spark.createDataFrame(verdicts, "project_id long, type string, part long, reply string"),
        spark.createDataFrame([(r["project_id"], r["file_seq"],
                                check_text(r["project_id"], r["file_seq"])) for r in rows],
                              "project_id long, file_seq long, reply string"),
        spark.createDataFrame([(p, i, assessment(p, names[p])) for p in pids for i in range(n_parts)],
                              "project_id long, part long, reply string"),
    )
    return scored, replies


def outcome(spark, rows: list[dict], stage: bool = True, by_part: bool = True) -> tuple:
    scored, replies = tables(spark, rows)
    if not by_part:
        replies = replies._replace(
            verdicts=replies.verdicts.drop("part").distinct(),
            assessments=replies.assessments.drop("part").distinct())
    scored = scored.cache()
    report = analyze_full(scored, replies, stage=stage)
    found: dict[int, dict] = {}
    for r in report.projects.collect():
        found[r["project_id"]] = {
            "details": [], "lists": {}, "clean": [], "scores": {},
            "rejected": r["false_positives_filtered"], "enhanced": r["llm_enhanced"],
            "method": r["scoring_method"],
        }
    for r in report.details.orderBy("project_id", "position").collect():
        found[r["project_id"]]["details"].append((
            r["type"], r["severity"], r["affected_layer"], r["confidence"], r["n_files"],
            r["llm_validated"], r["fix_suggestion"] is not None))
    for r in report.detail_files.orderBy("part").collect():
        found[r["project_id"]]["lists"].setdefault(r["type"], []).extend(r["files"])
    for r in report.clean_files.orderBy("file_seq").collect():
        found[r["project_id"]]["clean"].append(r["file_seq"])
    for r in report.files.collect():
        found[r["project_id"]]["scores"][r["file_seq"]] = r["quality_score"]
    return scored, found, report


def expected(scored, rows: list[dict]) -> dict:
    labels, layers, scores = {}, {}, {}
    for r in scored.collect():
        key = (r["project_id"], r["file_seq"])
        labels[key], layers[key], scores[key] = r["type"], r["resolved_layer"], r["quality_score"]
    result = {}
    for pid in {r["project_id"] for r in rows}:
        mine = [r for r in rows if r["project_id"] == pid]
        result[pid] = walk(mine, labels, layers, scores)
    return result


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_review_equals_walk(spark, seed):
    rows = corpus(seed)
    scored, found, _ = outcome(spark, rows)
    assert found == expected(scored, rows)


@pytest.mark.parametrize("by_part", [True, False])
def test_hot_project_in_many_parts(spark, monkeypatch, by_part):
    """One project holds most files; parts of two files give the same report,
    with replies for each part or one reply for the whole."""
    rng = random.Random(9)
    rows = corpus(5, projects=4, size=4)
    rows = [r for r in rows if r["project_id"] != 1]
    rows += [
        record(project_id=1, file_seq=i, source_code="class X" if i % 5 else "x",
               total_cross_layer_deps=rng.randint(0, 6), **rng.choice(KINDS))
        for i in range(40)
    ]
    monkeypatch.setattr(parts, "PART_FILES", 2)
    scored, found, _ = outcome(spark, rows, by_part=by_part)
    want = expected(scored, rows)
    for pid in want:
        # Lists come part by part: model findings and discoveries of each part.
        for per in (found[pid]["lists"], want[pid]["lists"]):
            for kind in per:
                per[kind] = sorted(per[kind])
    assert found == want


def test_row_order_partitions_and_staging_do_not_matter(spark):
    rows = corpus(4)
    _, one, _ = outcome(spark, rows)
    shuffled = rows[:]
    random.Random(0).shuffle(shuffled)
    previous = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        _, two, _ = outcome(spark, shuffled, stage=False)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", previous)
    assert one == two


def test_every_file_is_clean_or_in_a_group(spark):
    rows = corpus(6)
    _, found, report = outcome(spark, rows)
    for pid, result in found.items():
        listed = {name for names in result["lists"].values() for name in names}
        names = {r["file_seq"]: r["file_name"] for r in rows if r["project_id"] == pid}
        clean = {names[s] for s in result["clean"]}
        assert listed | clean == set(names.values()) and not listed & clean
        assert all(0 <= s <= 100 for s in result["scores"].values())


def test_no_replies_gives_model_only(spark):
    rows = [{**r, "source_code": None} for r in corpus(7)]
    scored, _ = tables(spark, rows)
    report = analyze_full(scored)
    scores = {(r["project_id"], r["file_seq"]): r["quality_score"] for r in scored.collect()}
    got = {(r["project_id"], r["file_seq"]): r["quality_score"] for r in report.files.collect()}
    assert got == scores
    for r in report.projects.collect():
        assert (r["scoring_method"], r["llm_enhanced"]) == ("ml_only", False)
    assert report.fixes.count() == 0


def test_nested_report_and_names(spark):
    rows = corpus(8)
    scored, replies = tables(spark, rows)
    report = analyze_full(scored, replies)
    last = scored.groupBy("project_id").agg(F.max("file_seq").alias("last_seq"))
    nested = {r["project_id"]: r for r in nested_reports(report, last).collect()}
    assert len(nested) == len({r["project_id"] for r in rows})
    for pid, row in nested.items():
        scores = [f["quality_score"] for f in row["files"]]
        assert scores == sorted(scores)
        assert len(scores) == sum(r["project_id"] == pid for r in rows)
    twins = files(spark, record(), record(file_seq=1, file_name="F0.java"), record(file_seq=2))
    assert [(r["file_name"], r["n_files"]) for r in ambiguous_names(twins).collect()] == [("F0.java", 2)]
