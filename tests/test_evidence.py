from codeweave.operators import chains, extract, inventory, link
from codeweave.sources import files as sources

FILES = "workspace_id string, relative_path string, content string"


def edges_of(spark, *rows):
    symbols, edges = extract.extract_evidence(spark.createDataFrame([("w", p, c) for p, c in rows], FILES))
    return symbols, edges


def triples(edges, kind):
    return {(r.source_identifier, r.target_identifier) for r in edges.where(f"relationship_kind = '{kind}'").collect()}


def test_ignore_rules(spark):
    paths = ["a/tmp/x.cs", "tmp", "b/y.skip.cs", "top.sql", "q/top.sql", "docs/z.md", "src/docs/z.md", "keep.cs"]
    files = spark.createDataFrame([("w", p, "") for p in paths], FILES)
    rules = spark.createDataFrame([("w", r) for r in ("tmp/", "*.skip.cs", "/top.sql", "docs", "# no", "")], "workspace_id string, rule string")
    left = {r.relative_path for r in sources.apply_ignore_rules(files, rules).collect()}
    assert {"keep.cs", "q/top.sql", "tmp"} <= left
    assert not left & {"b/y.skip.cs", "top.sql", "docs/z.md"}


def test_excluded_and_generated(spark):
    rows = [("w", p, "x", n) for p, n in (("bin/a.cs", 1), ("A/OBJ/b.cs", 1), ("a.designer.cs", 1), ("b.cs", 2_000_000), ("c.cs", 1))]
    files = spark.createDataFrame(rows, FILES + ", size_bytes long")
    assert [r.relative_path for r in sources.indexable(files).collect()] == ["c.cs"]


def test_route_constants(spark):
    text = "const base = '/api';\nconst urls = {\n  one: `${base}/one`,\n};\nfunction f() {\n  this.http.get(urls.one);\n  this.http.post(base + '/two');\n  this.http.put(other);\n}"
    _, edges = edges_of(spark, ("w/a.ts", text))
    assert {t for _, t in triples(edges, "calls_api")} == {"GET /api/one", "POST /api/two"}


def test_header_add_is_no_write(spark):
    text = "public class C\n{\n    private readonly HttpClient _client;\n    public void M()\n    {\n        _client.DefaultRequestHeaders.Add(\"a\", \"b\");\n    }\n}"
    _, edges = edges_of(spark, ("c.cs", text))
    assert not triples(edges, "writes_table")


def test_nested_class_scope(spark):
    text = "public class A\n{\n    public class B\n    {\n        public void Inner()\n        {\n        }\n    }\n    public void Outer()\n    {\n        Helper();\n    }\n}"
    symbols, edges = edges_of(spark, ("a.cs", text))
    assert {(r.name, r.container) for r in symbols.where("kind = 'method'").collect()} == {("Inner", "B"), ("Outer", "A")}
    assert triples(edges, "calls_method") == {("a.cs::Outer", "a.cs::Helper")}


def test_procedures(spark):
    text = "CREATE PROCEDURE dbo.P AS\nBEGIN\n UPDATE [dbo].[T] SET a = 1\n -- DELETE FROM dbo.No\nEND\nGO\nSELECT * FROM dbo.Outside\nCREATE VIEW dbo.V AS\nSELECT * FROM dbo.T2"
    _, edges = edges_of(spark, ("a.sql", text))
    assert triples(edges, "writes_table") == {("dbo.P", "dbo.T")}
    assert triples(edges, "reads_table") == {("dbo.P", "dbo.T")}


def test_empty_and_null_files(spark):
    symbols, edges = edges_of(spark, ("a.cs", ""), ("b.ts", None), ("c.html", " "), ("d.sql", ""))
    assert symbols.count() == 0 and edges.count() == 0


def test_cycle_stops(spark):
    rows = [("w", "symbol", s, "calls_method", "method", t, None) for s, t in (("f::a", "f::b"), ("f::b", "f::a"))]
    rows.append(("w", "symbol", "x.ts::go", "matches_backend_handler", "symbol", "f::a", "match=exact"))
    edges = spark.createDataFrame(rows, "workspace_id string, source_kind string, source_identifier string, relationship_kind string, target_kind string, target_identifier string, metadata string")
    paths = chains.expand_chains(chains.chain_starts(edges), chains.next_steps(edges))
    assert paths.count() <= 1


def test_summary_counts_each_workspace(spark):
    assert inventory.has("a", " ") is not None
    symbols, edges = edges_of(spark, ("src/a.cs", "public class A\n{\n}"), ("src/x.Tests/t.cs", "public class T\n{\n}"))
    files = sources.indexable(spark.createDataFrame([("w", "src/a.cs", "x", 1), ("w", "src/x.Tests/t.cs", "x", 1)], FILES + ", size_bytes long"))
    rows = {(r.section, r.title): r.n for r in inventory.workspace_summary(files, symbols, link.linked(edges, symbols)).collect()}
    assert rows["total", "files"] == 1 and rows["total", "symbols"] == 1


def test_deep_types_and_blanks_between_tokens(spark):
    opened = "".join(f"{'    ' * i}public class T{i}\n{'    ' * i}{{\n" for i in range(9))
    inner = " " * 36 + "public void Deep()\n" + " " * 36 + "{\n" + " " * 40 + "Helper ( );\n" + " " * 36 + "}\n"
    symbols, edges = edges_of(spark, ("a.cs", opened + inner + "".join(f"{'    ' * i}}}\n" for i in reversed(range(9)))))
    assert [(r.name, r.container) for r in symbols.where("kind = 'method'").collect()] == [("Deep", "T8")]
    assert triples(edges, "calls_method") == {("a.cs::Deep", "a.cs::Helper")}
    text = "function f() {\n  this.HTTP . get < X > ( '/a' );\n  router.push( '/b' );\n  myrouter.push('/c');\n  history('/d');\n  x.client.post('/e');\n}"
    _, edges = edges_of(spark, ("w/a.ts", text))
    assert {t for _, t in triples(edges, "calls_api")} == {"GET /a", "POST /e"}
    assert {t for _, t in triples(edges, "navigates_to")} == {"/b"}


def test_writing_one_workspace_keeps_the_others(spark, tmp_path):
    schema, path = "workspace_id string, relative_path string, is_deleted boolean", f"file://{tmp_path}/files"
    sources.write_evidence(spark.createDataFrame([("a", "x.cs", False), ("b", "y.cs", False)], schema), path, ["relative_path"])
    sources.write_evidence(spark.createDataFrame([("b", "z.cs", False), ("b", "z.cs", False), ("b", "old.cs", True)], schema), path, ["relative_path"])
    assert {(r.workspace_id, r.relative_path) for r in sources.read_evidence(spark, path).collect()} == {("a", "x.cs"), ("b", "z.cs")}


def test_relationships_of_deleted_files_go(spark):
    rows = [("w", "symbol", s, "calls_method", "method", t, None) for s, t in (("a.cs::A", "b.cs::B"), ("b.cs::B", "c.cs::C"), ("c.cs::C", "IThing.Do"))]
    edges = spark.createDataFrame(rows, "workspace_id string, source_kind string, source_identifier string, relationship_kind string, target_kind string, target_identifier string, metadata string")
    files = spark.createDataFrame([("w", "a.cs", False), ("w", "b.cs", True), ("w", "c.cs", False)], "workspace_id string, relative_path string, is_deleted boolean")
    assert [r.source_identifier for r in sources.without_deleted(edges, files).collect()] == ["c.cs::C"]


def test_first_registration_wins_and_common_names_do_not_pair_out(spark):
    """The first registered implementation is followed, not the least by name; a name shared by many classes is met only by what no class resolves."""
    order = "workspace_id string, source_kind string, source_identifier string, relationship_kind string, target_kind string, target_identifier string, metadata string, relative_path string, line int, col int"
    rows = [("w", "service", "IJob", "implemented_by", "class", c, None, "d.cs", n, 0) for n, c in ((1, "Zeta"), (2, "Alpha"))]
    rows += [("w", "symbol", f"{c}.cs::{c}", "contains_symbol", "method", f"{c}.cs::Get", None, f"{c}.cs", 1, 0) for c in ("Zeta", "Alpha", *(f"C{i}" for i in range(200)))]
    rows += [("w", "symbol", f"{c}.cs::Get", "reads_table", "database-table", f"t{c}", None, f"{c}.cs", 2, 0) for c in ("Zeta", "Alpha")]
    rows += [("w", "symbol", "a.cs::Go", "calls_method", "method", "IJob.Get", None, "a.cs", 1, 0)]
    steps = chains.next_steps(spark.createDataFrame(rows, order))
    assert [r.target for r in steps.where("at = 'ijob.get'").collect()] == ["tZeta"]
