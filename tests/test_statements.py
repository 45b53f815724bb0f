"""Extraction from ordinary layouts: wrapped headers, comments and texts with brackets, members of any place."""

import textwrap

from codeweave.operators import extract, statements
from pyspark.sql import functions as F

FILES = "workspace_id string, relative_path string, content string"

ONE_LINE = """
using Azure.Storage.Blobs;
namespace Shop.Api;
[ApiController]
[Route("api/[controller]")]
public class Orders : ControllerBase, IOrders
{
    private readonly IStore _store;
    private readonly ShopDbContext _db;
    public DbSet<Order> Orders2 { get; set; }
    public Orders(IStore store, [FromKeyedServices("main")] IQueue queue, ShopDbContext db)
    {
        _store = store;
        _queue = queue;
        _db = db;
    }
    [HttpGet("{id}")]
    public async Task<Dictionary<string, int>> Get(int id, string name)
    {
        _store.Load(id);
        Check(id);
        _db.Orders.Add(new Order());
        _db.SaveChanges();
        _db.Database.ExecuteSqlRaw("EXEC dbo.GetOrder");
        return null;
    }
    private void Check(int id) => _queue.Send(id);
}
"""

WRAPPED = """
using Azure.Storage.Blobs;
namespace Shop.Api;
[ApiController]
[Route(
    "api/[controller]")]
public class Orders
    : ControllerBase,
      IOrders
{
    private readonly IStore
        _store;
    private readonly ShopDbContext _db; /* } */ // {
    public DbSet<Order> Orders2
    {
        get; set;
    }
    public Orders(
        IStore store, // the "store" {
        [FromKeyedServices("main")] IQueue queue,
        ShopDbContext db)
    {
        _store = store; _queue =
            queue;
        _db = db;
        var odd = '{'; var path = @"C:\\"; var raw = \"\"\"
            } ) ; public class No { }
            \"\"\"; var s = "\\"{"; var t = $"{(id > 1 ? "}" : "{")} }}";
    }
    [HttpGet(
        "{id}")]
    public async Task<
        Dictionary<string, int>>
        Get(
            int id,
            string name)
    {
        #region calls {
        _store
            .Load(id);
        /* Gone(); { { " */
        Check(
            id);
        _db.Orders
            .Add(new Order());
        _db.SaveChanges();
        _db.Database.ExecuteSqlRaw(
            "EXEC dbo.GetOrder");
        #endregion
        return null;
    }
    private void Check(int id)
        => _queue
            .Send(id);
}
"""


def evidence(spark, **texts):
    """Symbols and links of each text, all from one run; the path is left out of identifiers."""
    rows = [("w", f"{name}.{'sql' if name.startswith('sql') else 'cs'}", text) for name, text in texts.items()]
    files = spark.createDataFrame(rows, FILES)
    symbols, edges = extract.extract_evidence(files, {k: v for k, v in extract.EXTRACTORS.items() if any(p.endswith(k) for _, p, _ in rows)})
    symbols, edges = symbols.collect(), edges.where("relationship_kind <> 'contains_symbol'").collect()
    out = []
    for _, path, _ in rows:
        bare = lambda x: x.replace(f"{path}::", "")  # noqa: B023, E731
        names = sorted((r.kind, r.name, r.container or "") for r in symbols if r.relative_path == path)
        out.append((names, sorted((r.source_kind, bare(r.source_identifier), r.relationship_kind, r.target_kind, bare(r.target_identifier), r.metadata or "") for r in edges if r.relative_path == path)))
    return out


def test_wrapped_layout_gives_the_same(spark):
    one, wrapped = evidence(spark, one=ONE_LINE, wrapped=WRAPPED)
    assert wrapped == one
    assert one[0] == [("constructor", "Orders", "Orders"), ("controller", "Orders", "Shop.Api"), ("method", "Check", "Orders"), ("method", "Get", "Orders"), ("property", "Orders2", "Orders")]
    api = ("controller=Orders",)
    assert one[1] == sorted([
        ("api", "GET /api/Orders/{id}", "handled_by", "method", "Get", *api),
        ("symbol", "Get", "handles_api", "api", "GET /api/Orders/{id}", *api),
        ("domain-model", "Order", "maps_to_table", "database-table", "Orders2", "dbContext=Orders"),
        ("symbol", "Orders", "maps_dbset", "domain-model", "Order", "property=Orders2"),
        ("file", "azure-service-reference", "uses_azure_service", "azure-service", "Azure Blob Storage", ""),
        *[("symbol", "Orders", "depends_on", "service", t, "") for t in ("IStore", "IQueue", "ShopDbContext")],
        ("symbol", "Orders", "depends_on", "service", "IQueue", "parameter=queue;field=_queue;key=main;source=FromKeyedServices"),
        *[("symbol", "Orders", "inherits_from", "class", t, "") for t in ("ControllerBase", "IOrders")],
        ("symbol", "Get", "calls_method", "method", "IStore.Load", "receiver=_store"),
        ("symbol", "Get", "calls_method", "method", "Check", "receiver=this;direct=true"),
        ("symbol", "Get", "writes_table", "database-table", "Orders", "context=_db;method=Add"),
        ("symbol", "Get", "saves_changes", "db-context", "ShopDbContext", "receiver=_db"),
        ("symbol", "Get", "executes_procedure", "procedure", "dbo.GetOrder", "method=ExecuteSqlRaw"),
        ("symbol", "Check", "calls_method", "method", "IQueue.Send", "receiver=_queue"),
    ])


def test_places_are_those_of_names(spark):
    symbols, _ = extract.extract_evidence(spark.createDataFrame([("w", "a.cs", WRAPPED), ("w", "b.sql", "\nCREATE\n  PROCEDURE dbo.P AS SELECT 1 CREATE TABLE [s].[T] (a int)")], FILES))
    lines = {"a.cs": WRAPPED.split("\n"), "b.sql": ["", "CREATE", "  PROCEDURE dbo.P AS SELECT 1 CREATE TABLE [s].[T] (a int)"]}
    found = symbols.collect()
    assert len(found) == 7
    for r in found:
        there = lines[r.relative_path][r.line - 1][r.col - 1 :]
        assert there.startswith((r.name, f"dbo.{r.name}", f"[s].[{r.name}]")), r


ODD = ["/* } */", "/* { \n ' \" */", "'{';", "var a = '\\'';", 'var p = @"C:\\";', 'var v = @"a "" { b";', 'var r = """ } " { """;', "var i = $\"{x} {{ {f(\"}\")} \";", "// '\"{", "#if DEBUG {\n#endif", 'var s = "\\\\";', "var c = 'a'; // don't {"]


def test_lexical_state_ends_where_it_should(spark):
    plain = "public class A\n{\n    public void One()\n    {\n        %s\n    }\n    public void Two()\n    {\n        Helper();\n    }\n}"
    for odd, (symbols, edges) in zip(ODD, evidence(spark, **{f"f{i}": plain % odd for i, odd in enumerate(ODD)}), strict=True):
        assert symbols == [("class", "A", ""), ("method", "One", "A"), ("method", "Two", "A")], odd
        assert [e[1:5] for e in edges] == [("Two", "calls_method", "method", "Helper")], odd


def test_members_of_every_place(spark):
    text = textwrap.dedent("""
        namespace A.B
        {
            namespace C { public interface IThing { int Count { get; } void Do(int a); } }
            public record Point(int X, int Y);
            public enum Color { Red, Green = Max(1) }
            internal class Outer<T> : Base<T, int>, IThing where T : class
            {
                private IFirst _a, _b;
                int IThing.Count => _a.Count();
                void IThing.Do(int a) { _b.Go(); void Local(int z) { Inner2(); } Local(2); }
                public int Prop { get { return _a.Never(); } }
                public struct Nested { public void InNested() { Deep(); } }
                public Outer() : base(Lost()) { _a.InConstructor(); }
                void After() { if (x) { await Later(); } new Thing(); var y = nameof(After); }
            }
        }
    """)
    names, edges = evidence(spark, a=text)[0]
    assert names == sorted([
        ("interface", "IThing", "C"), ("property", "Count", "IThing"), ("method", "Do", "IThing"), ("record", "Point", "A.B"), ("enum", "Color", "A.B"),
        ("class", "Outer", "A.B"), ("property", "Count", "Outer"), ("method", "Do", "Outer"), ("property", "Prop", "Outer"), ("struct", "Nested", "Outer"),
        ("method", "InNested", "Nested"), ("constructor", "Outer", "Outer"), ("method", "After", "Outer"),
    ])
    assert {(e[1], e[4]) for e in edges if e[2] == "calls_method"} == {("Do", "IFirst.Go"), ("Do", "Inner2"), ("Do", "Local"), ("After", "Later")}
    assert {e[4] for e in edges if e[2] == "inherits_from"} == {"Base<T, int>", "IThing"}
    assert {e[4] for e in edges if e[2] == "depends_on"} == {"IFirst"}


def test_types_nest_at_any_depth_in_a_fixed_plan(spark):
    deep = 60
    text = "".join(f"class T{i} {{ void M{i}() {{ F{i}(); }}\n" for i in range(deep)) + "}" * deep
    files = spark.createDataFrame([("w", "a.cs", text)], FILES)
    symbols, edges = extract.extract_evidence(files)
    assert {(r.name, r.container) for r in symbols.where("kind = 'method'").collect()} == {(f"M{i}", f"T{i}") for i in range(deep)}
    assert {(r.source_identifier, r.target_identifier) for r in edges.where("relationship_kind = 'calls_method'").collect()} == {(f"a.cs::M{i}", f"a.cs::F{i}") for i in range(deep)}
    width = len(statements.cs_statements(files).columns)
    assert width == len(statements.cs_statements(spark.createDataFrame([("w", "a.cs", "class A { }")], FILES)).columns)


def test_procedures_in_any_layout(spark):
    text = textwrap.dedent("""
        /* outer /* CREATE PROCEDURE dbo.No AS */ don't CREATE TABLE dbo.No2 (a int) */
        CREATE PROCEDURE
            dbo.P
        AS
        BEGIN
            INSERT INTO
                [dbo].[Orders] (Id) VALUES ('from dbo.Text');
            UPDATE TOP (5)
                dbo.U SET a = 'it''s -- ' FROM dbo.U JOIN
                "dbo"."V" ON 1 = 1 -- FROM dbo.Comment
            CREATE TABLE #t (a int)
            SELECT * FROM #t CROSS APPLY dbo.fn(1) f JOIN dbo.fn2(2) g ON 1 = 1
            /* FROM dbo.Never */ DELETE FROM dbo.D
        END
        GO
        SELECT * FROM dbo.Outside
        GO 5
        CREATE VIEW dbo.W AS SELECT * FROM dbo.X
    """)
    names, edges = evidence(spark, sql=text)[0]
    assert names == sorted([("procedure", "P", "dbo"), ("table", "#t", ""), ("view", "W", "dbo")], key=lambda x: (x[0], x[1]))
    got = {k: {e[4] for e in edges if e[2] == k} for k in ("writes_table", "reads_table")}
    assert got["writes_table"] == {"dbo.Orders", "dbo.U", "dbo.D"} and got["reads_table"] == {"dbo.Orders", "dbo.U", "dbo.V", "#t", "dbo.D"}
    assert {e[1] for e in edges} == {"dbo.P"}


def test_long_texts_and_comments(spark):
    filler = "/*" + " * / ' \" {" * 40_000 + "*/\n" + 'var s = "' + "\\\\ {" * 40_000 + '";\n'
    sql = "/*" + " /* * / ' */" * 20_000 + "*/ CREATE TABLE dbo.T (a varchar(5) default '" + "''" * 20_000 + "')"
    cs, tables = evidence(spark, a=filler + "class A { void M() { } }", sql=sql)
    assert cs[0] == [("class", "A", ""), ("method", "M", "A")] and tables[0] == [("table", "T", "dbo")]


def test_statements_are_folded_where_their_file_is(spark):
    """Lines are neither sorted, grouped nor moved; words of access end as in Java's patterns, parts of one line meet."""
    texts = ["int a(\npublicé b,\nint c) {\n  x; y\n}", "void f(\npublic int g() { }", "[A]\n[B] int x\n  [0]\n  .y();", None, ""]
    files = spark.createDataFrame([("w", f"{i}.cs", t) for i, t in enumerate(texts)], "workspace_id string, relative_path string, content string")
    found = statements.cs_statements(files)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Sort", "Window", "Aggregate")), plan
    rows = sorted((r.relative_path, r.pos, tuple(r.lines), r.depth, r.opens, r.code) for r in found.collect())
    assert rows == [
        ("0.cs", 1, (1, 2, 3), 0, 1, "int a(\npublicé b,\nint c) {"), ("0.cs", 2, (4,), 1, 0, "  x;"), ("0.cs", 3, (4, 5), 1, -1, " y\n}"),
        ("1.cs", 1, (1,), 0, 0, "void f("), ("1.cs", 2, (2,), 0, 1, "public int g() {"), ("1.cs", 3, (2,), 1, -1, " }"),
        ("2.cs", 1, (1,), 0, 0, "[A]"), ("2.cs", 2, (2, 3, 4), 0, 0, "[B] int x\n  [0]\n  .y();"),
    ]


def test_runs_go_over_line_ends_but_no_directives(spark):

    text = "class A\n{\n  int a;\n\n#if x { \"\n  /* b */ # c\n  int d = 'e';\n \t#endif\n}\n# last"
    blanks = "\n".join(["class A", "{", "  int a;", "", " " * 9, " " * 13, "  int d = ' ';".replace("' '", '" "'), " " * 8, "}", " " * 6])
    row = statements.cs_lexed(spark.createDataFrame([("w", "a.cs", text)], "workspace_id string, relative_path string, content string")).collect()[0]
    assert row.code == blanks and row.text == blanks.replace('" "', "'e'")

    tokens = spark.createDataFrame([(text,)], "t string").select(F.regexp_extract_all("t", F.lit(statements._CS), F.lit(0)).alias("t")).collect()[0].t
    assert "".join(tokens) == text and tokens[0] == "class A\n{\n  int a;\n"
