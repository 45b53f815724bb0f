"""Walks and joins against plain versions: chains in order, containment, ignore rules, related rows."""

import fnmatch
import random

import pytest
from pyspark.sql import functions as F

from codeweave.operators import chains, explorer, extract, runtime
from codeweave.plans.containment import containing
from codeweave.sources import files as sources

STEP = "workspace_id string, at string, source_kind string, source string, kind string, target_kind string, target string, rel_id long, n int"
START = "workspace_id string, source_kind string, source string, kind string, target_kind string, target string, rel_id long"


def chains_by_hand(starts, follow, depth):
    """All chains of one workspace in depth-first order, each as the names it passes."""
    out = []
    for source, target in sorted(starts):
        found = []

        def walk(at, path, seen, left):
            if left == 0 or not follow.get(at):
                found.append(path)  # noqa: B023
                return
            for t in follow[at]:
                if t not in seen:
                    walk(t, [*path, t], seen | {t}, left - 1)

        walk(target, [source, target], {source, target}, depth)
        out += found or [[source, target]]
    return out


@pytest.mark.parametrize(("limit", "target"), [(None, None), (5, None), (4, "n1")])
def test_chains_in_order(spark, limit, target):
    rng = random.Random(3)
    graphs, starts, steps = {}, [], []
    for w in ("w0", "w1", "w2"):
        follow = {f"n{i}": rng.sample([f"n{j}" for j in range(9)], rng.randrange(0, 4)) for i in range(9)}
        begin = [(f"s{i}", f"n{rng.randrange(9)}") for i in range(3)]
        graphs[w] = chains_by_hand(begin, follow, 4)
        starts += [(w, "symbol", s, "matches", "symbol", t, None) for s, t in begin]
        steps += [(w, a, "symbol", a, "calls_method", "method", t, None, i) for a, ts in follow.items() for i, t in enumerate(ts)]
    found = chains.expand_chains(spark.createDataFrame(starts, START), spark.createDataFrame(steps, STEP), depth=4, limit=limit, target=target)
    rows = found.orderBy("workspace_id", "ordinal").collect()
    got = {w: [[r.path[0].source, *[s.target for s in r.path]] for r in rows if r.workspace_id == w] for w in graphs}
    holds = lambda path: target is None or any(x.startswith(target) for x in path)
    assert got == {w: [p for p in paths if holds(p)][:limit] for w, paths in graphs.items()}


def test_wide_graphs_stay_within_the_limit(spark):
    """50 ways on from each of 6 levels are 50**6 chains; only the first 20 are followed."""
    steps = spark.range(6).crossJoin(spark.range(50).withColumnRenamed("id", "a")).crossJoin(spark.range(50).withColumnRenamed("id", "b"))
    name = lambda level, i: F.concat(F.lit("l"), level.cast("string"), F.lit("x"), F.lpad(i.cast("string"), 2, "0"))
    at, to = name(F.col("id"), F.col("a")), name(F.col("id") + 1, F.col("b"))
    steps = steps.select(F.lit("w").alias("workspace_id"), at.alias("at"), F.lit("symbol").alias("source_kind"), at.alias("source"), F.lit("calls_method").alias("kind"), F.lit("method").alias("target_kind"), to.alias("target"), F.lit(None).cast("long").alias("rel_id"), F.col("b").cast("int").alias("n"))
    starts = spark.createDataFrame([("w", "symbol", "s", "matches", "symbol", "l0x00", None)], START)
    rows = chains.format_chains(chains.expand_chains(starts, steps, limit=20)).orderBy("ordinal").collect()
    assert [r.path[-1].target for r in rows] == [f"l6x{i:02d}" for i in range(20)] and all(len(r.path) == 7 for r in rows)
    assert rows[0].json.startswith('{"nodes":[{"kind":"symbol","identifier":"s"},') and rows[0].tree.count("\n") == 7


def test_containing(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab/c") for _ in range(rng.randrange(0, 14))) for _ in range(120)]
    needles = ["", *["".join(rng.choice("ab/c") for _ in range(rng.randrange(1, 7))) for _ in range(60)]]
    of = lambda i: f"w{i % 2}"
    got = containing(spark.createDataFrame([(of(i), x) for i, x in enumerate(needles)], "workspace_id string, needle string"), spark.createDataFrame([(of(i), x) for i, x in enumerate(texts)], "workspace_id string, text string"))
    want = {(of(i), n, t) for i, n in enumerate(needles) if n for j, t in enumerate(texts) if of(i) == of(j) and n in t}
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def ignored(path, rules):
    parts = path.lower().replace("\\", "/").split("/")
    for rule in (r.strip().replace("\\", "/").lower() for r in rules):
        if not rule or rule.startswith("#"):
            continue
        body = rule[1:] if rule.startswith("/") else rule
        body = body[:-1] if body.endswith("/") else body
        for i in range(len(parts)):
            if rule.endswith("/") and i == len(parts) - 1:
                continue
            if fnmatch.fnmatchcase("/".join(parts[: i + 1]), body) or (not rule.startswith("/") and fnmatch.fnmatchcase(parts[i], body)):
                return True
    return False


def test_ignore_rules_against_a_plain_version(spark):
    rng = random.Random(5)
    names = ["src", "Lib", "a.cs", "b.Test.cs", "tmp", "x1", "docs", "gen.g.ts", "v2"]
    paths = sorted({"/".join(rng.choice(names) for _ in range(rng.randrange(1, 5))) for _ in range(150)})
    rules = ["tmp/", "/src", "*.test.cs", "docs/x?", "?1/", "*", "# no", "", "lib/*.cs", "/v2/*/a.cs", "gen*", "\\docs\\tmp"]
    files = spark.createDataFrame([(f"w{k}", p, "") for k in range(len(rules)) for p in paths], "workspace_id string, relative_path string, content string")
    held = spark.createDataFrame([(f"w{k}", r) for k, r in enumerate(rules)] + [("w0", "v2")], "workspace_id string, rule string")
    got = {(r.workspace_id, r.relative_path) for r in sources.apply_ignore_rules(files, held).collect()}
    assert got == {(f"w{k}", p) for k, rule in enumerate(rules) for p in paths if not ignored(p, [rule, "v2"] if k == 0 else [rule])}


def test_related_and_grouped_rows(spark):
    rows = [("w", "symbol", s, k, t_kind, t, None) for s, k, t_kind, t in (
        ("a/x.cs::Go", "calls_method", "method", "IRepo.Load"), ("b/y.cs::Load", "reads_table", "database-table", "dbo.T"), ("a/x.cs::Other", "calls_method", "method", "IJob.Run"),
        ("c/z.cs::Call", "calls_method", "method", "A.Go"), ("a/x.cs/in.cs::Deep", "writes_table", "database-table", "dbo.U"), ("q.cs::No", "calls_method", "method", "No.Thing"),
    )]
    edges = extract.evidence_ids(spark.createDataFrame(rows, "workspace_id string, source_kind string, source_identifier string, relationship_kind string, target_kind string, target_identifier string, metadata string"))
    items = explorer.relationship_items(edges, "backend")
    selected = items.where("source_identifier = 'a/x.cs::Go'")
    found = explorer.related_local(items, selected).join(items.select("id", "source_identifier"), "id")
    assert {(r.label.split()[0], r.source_identifier) for r in found.collect()} == {("Outgoing", "b/y.cs::Load"), ("Incoming", "c/z.cs::Call"), ("Same", "a/x.cs::Other"), ("Same", "a/x.cs/in.cs::Deep")}
    groups = {r.label: (r.place, r.summary) for r in explorer.group_evidence(items).collect()}
    assert groups == {"Method calls": (1, "4 relationships / 4 targets"), "Table reads": (2, "1 relationship / 1 target"), "Table writes": (3, "1 relationship / 1 target")}
    assert [r.source_identifier for r in explorer.filter_items(items, text="DBO.", target_kind="database-table", path="b/").collect()] == ["b/y.cs::Load"]
    first = selected.first()
    assert first.display_locator.startswith("Go - Evidence #") and first.display_title == "Go -> IRepo.Load" and first.evidence_summary == ":Go calls method IRepo.Load."


def test_path_coverage(spark):
    step = "struct<stage:string,title:string,detail:string,kind:string>"
    shape = f"workspace_id string, category string, flows array<struct<category:string,title:string,steps:array<{step}>,confidence:bigint>>"
    s = lambda stage, kind="x": (stage, "t", "d", kind)
    one = ("ui", "f", [s("Entry point")], 1)
    api, cloud, plain = ("ui", "f", [s("UI"), s("HTTP call")], 1), ("ui", "g", [s("Start"), s("Blob store")], 1), ("job", "h", [s("Entry point")], 1)
    paths = spark.createDataFrame([("w", "ui", [one]), ("w", "ui", [api, cloud]), ("w", "ui", [plain])], shape)
    flows = spark.createDataFrame([("w", [s("SQL table")]), ("v", [s("a", "database-table")])], f"workspace_id string, steps array<{step}>")
    entries = spark.createDataFrame([("w",), ("v",), ("v",)], "workspace_id string")
    got = {r.workspace_id: tuple(r)[1:] for r in runtime.path_coverage(entries, paths, flows).collect()}
    assert got == {"w": (3, 1, 1, 1, 4, 1, 0, 0, 1), "v": (2, 0, 0, 0, 1, 0, 0, 1, 0)}


def test_related_rows_move_few_columns(spark, monkeypatch):
    """What is shown of a row is not written out to find what is related to it, and each end of a row moves once."""
    from codeweave import queries

    written = []
    monkeypatch.setattr(queries, "cut", lambda df: written.append(df) or df)
    queries.QUERIES["u7_related_rows"](spark, "/root/testdata/sf0.001")
    assert set(written[0].columns) == {"workspace_id", "id", "relationship_kind", "source_identifier", "target_identifier", "file_path"}


def test_every_match_starts_chains(spark):
    """Without a limit each of a workspace's matches is a start, with one the first four times as many."""
    rows = [("w", "symbol", f"web/a{i}.ts::load", "matches_backend_handler", "symbol", f"api/A{i}.cs::Get", None) for i in range(100)]
    edges = spark.createDataFrame(rows, "workspace_id string, source_kind string, source_identifier string, relationship_kind string, target_kind string, target_identifier string, metadata string")
    starts = chains.chain_starts(edges, limit=None)
    assert starts.count() == 100 and chains.chain_starts(edges).count() == 80
    assert chains.expand_chains(starts, chains.next_steps(edges)).select("start").distinct().count() == 100
