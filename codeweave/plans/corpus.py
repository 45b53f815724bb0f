"""A corpus of source files derived from the ``part`` table: one bundle of files per part.

The same columns tell which evidence each bundle must give, so extraction can be held against SQL over ``part``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _lines(*lines: Column | str) -> Column:
    return F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else x for x in lines])


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part``, dealt to all cores: a row of a few bytes becomes files of a few thousand, so that the tasks by its
    compressed size, of which the whole table makes one, would each write gigabytes of text alone."""
    return spark.read.parquet(f"{sf_dir}/part.parquet").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")


def part_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source_files`` rows: controller, service, repository, registration, procedure, client, template, component."""
    part = parts(spark, sf_dir)
    k, b = F.col("k"), F.col("b")
    part = part.select(F.col("p_partkey").cast("string").alias("k"), F.regexp_replace("p_brand", "Brand#", "b").alias("b"), F.col("p_partkey").alias("n"), F.col("p_size").cast("string").alias("size"), "p_name")
    n = F.col("n")

    def by_four(zero: Column, one: Column, two: Column, three: Column) -> Column:
        return F.when(n % 4 == 0, zero).when(n % 4 == 1, one).when(n % 4 == 2, two).otherwise(three)

    verb = by_four(F.lit('    [HttpGet("{id}")]'), F.lit('    [HttpPost("save")]'), F.lit("    [HttpPut]"), F.lit('    [HttpDelete("{id}/{rev}")]'))
    controller = _lines(
        F.when(n % 3 == 0, "using Azure.Storage.Blobs;").otherwise("using System.Linq;"),
        _text('[Route("api/', b, '/[controller]")]'),
        _text("public sealed class P", k, "Controller : ControllerBase"),
        "{",
        _text("    private readonly IP", k, "Service _svc;"),
        _text("    public P", k, "Controller(IP", k, "Service svc)"),
        "    {",
        "        _svc = svc;",
        "    }",
        verb,
        _text("    public IActionResult Act", k, "(int id)"),
        "    {",
        _text("        _svc.Load", k, "();"),
        "        return Ok();",
        "    }",
        "}",
    )
    service = _lines(
        _text("public class P", k, "Service : IP", k, "Service"),
        "{",
        _text("    private readonly IP", k, "Repository _repo;"),
        _text("    public P", k, "Service(IP", k, "Repository repo)"),
        "    {",
        "        _repo = repo;",
        "    }",
        _text("    public void Load", k, "()"),
        "    {",
        _text("        _repo.Fetch", k, "();"),
        _text("        Audit", k, "();"),
        "    }",
        _text("    private void Audit", k, "()"),
        "    {",
        "    }",
        "}",
    )
    even = n % 2 == 0
    repository = _lines(
        _text("public class P", k, "Repository : IP", k, "Repository"),
        "{",
        "    private readonly ShopDbContext _db;",
        _text("    public P", k, "Repository(ShopDbContext db)"),
        "    {",
        "        _db = db;",
        "    }",
        _text("    public void Fetch", k, "()"),
        "    {",
        F.when(even, _text('        _db.Database.ExecuteSqlRaw("EXEC dbo.GetP', k, ' @Id");')).otherwise("        _db.Parts.Add(new Part());"),
        F.when(even, "").otherwise("        _db.SaveChanges();"),
        "    }",
        "}",
    )
    registration = _lines(
        _text("services.AddScoped<IP", k, "Service, P", k, "Service>();"),
        F.when(n % 7 == 0, _text("services.AddKeyedScoped<IP", k, "Repository, P", k, 'Repository>("main");')).otherwise(_text("services.AddScoped<IP", k, "Repository, P", k, "Repository>();")),
    )
    m = (n % 50).cast("string")
    procedure = _lines(_text("CREATE PROCEDURE dbo.GetP", k), "AS", "BEGIN", _text("    INSERT INTO dbo.Audit", m, " (Id) VALUES (1);"), _text("    SELECT Id FROM dbo.Part", m, ";"), "END")
    route = _text("/api/", b, "/P", k)
    call = by_four(
        _text("    this.http.get('", route, "/", F.col("size"), "', {});"),
        _text("    this.http.post(`", "${base}", "/P", k, "/save`, {});"),
        _text("    this.http.put('/v2", route, "', {});"),
        _text("    this.http.delete('", route, "/1', {});"),
    )
    client = _lines(_text("const base = '/api/", b, "';"), _text("export class P", k, "Service {"), _text("  load", k, "() {"), call, "  }", "}")
    template = _text('<button (click)="go', k, '()">', F.col("p_name"), "</button>")
    component = _lines(_text("export class P", k, "Component {"), _text("  go", k, "() {"), _text("    this.api.load", k, "();"), _text("    this.router.navigate(['/p/", k, "']);"), "  }", "}")
    tests = _lines("using Azure.Storage.Blobs;", _text("public sealed class P", k, "Tests { }"))
    junk = _text("public class Junk", k, " { }")

    def file(path: Column, content: Column, when: Column | None = None) -> Column:
        row = F.struct(path.alias("relative_path"), content.alias("content"))
        return row if when is None else F.when(when, row)

    files = F.array(
        file(_text("src/", b, "/Api/P", k, "Controller.cs"), controller),
        file(_text("src/", b, "/Core/P", k, "Service.cs"), service),
        file(_text("src/", b, "/Data/P", k, "Repository.cs"), repository),
        file(_text("src/", b, "/Di/P", k, "Registration.cs"), registration),
        file(_text("sql/", b, "/GetP", k, ".sql"), procedure),
        file(_text("web/", b, "/p", k, ".service.ts"), client),
        file(_text("web/", b, "/p", k, ".component.html"), template),
        file(_text("web/", b, "/p", k, ".component.ts"), component),
        file(_text("src/", b, "/P", k, ".Tests/P", k, "Tests.cs"), tests, n % 10 == 0),
        file(_text("src/", b, "/bin/P", k, ".cs"), junk, n % 25 == 0),
        file(_text("src/", b, "/P", k, ".designer.cs"), junk, n % 25 == 0),
        file(_text("web/", b, "/p", k, ".min.js"), _text("var p", k, "=1;"), n % 25 == 0),
    )
    rows = part.select(_text("ws", (n % 5).cast("string")).alias("workspace_id"), F.explode(F.filter(files, lambda f: f.isNotNull())).alias("f"))
    return rows.select("workspace_id", "f.relative_path", "f.content", F.octet_length("f.content").cast("long").alias("size_bytes"))


def other_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source_files`` rows in another layout: nested types in a namespace, triggers, keyed services, query texts in
    variables, minimal APIs, React and Angular routes with blanks between tokens, and look-alikes in comments and names."""
    part = parts(spark, sf_dir)
    n, k = F.col("p_partkey"), F.col("p_partkey").cast("string")
    m = (n % 50).cast("string")
    job = _lines(
        "namespace Shop.Jobs", "{",
        _text("    public class Job", k), "    {",
        "        private readonly IStore _store;",
        _text("        public Job", k, '([FromKeyedServices("main")] IStore store)'), "        {",
        "            _store = store; // _store.Gone();", "        }",
        _text('        [Function("run', k, '")]'),
        _text("        public void Run", k, '([HttpTrigger("get", "post", Route = "jobs/', k, '")] Request req)'), "        {",
        _text('            var text = "SELECT Id FROM dbo.Part', m, '";'),
        "            _store.ExecuteQuery(text);", "        }",
        _text("        public class Inner", k), "        {",
        _text("            public void Deep", k, "()"), "            {",
        _text("                Helper", k, "();"), "            }", "        }", "    }", "}",
    )
    minimal = _text('app.MapGet("/mini/', k, '", () => 1);')
    page = _lines(
        _text("export const Page", k, " = () => <a />;"), _text("  return <button onClick = { save", k, " } onHover={ no } />;"),
        _text('  <Route path="/p/', k, '" element={<Page', k, " />} />"), _text("  const routes = [{ path : 'a/", k, "', component : Page", k, " }];"), _text("  return myrouter.push('/no/", k, "');"), _text("  router.push(target", k, ");"),
    )
    file = lambda path, content: F.struct(path.alias("relative_path"), content.alias("content"))
    files = F.array(file(_text("fn/F", k, ".cs"), job), file(_text("fn/M", k, ".cs"), minimal), file(_text("web2/v", k, ".tsx"), page))
    rows = part.select(F.lit("ws0").alias("workspace_id"), F.explode(files).alias("f"))
    return rows.select("workspace_id", "f.relative_path", "f.content", F.octet_length("f.content").cast("long").alias("size_bytes"))


def wrapped_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The C# and T-SQL files of ``part_corpus`` in another layout: declarations, calls and statements wrap, and comments,
    directives, characters and texts hold brackets and quotes. Extraction must give the same."""
    part = parts(spark, sf_dir)
    k, b = F.col("p_partkey").cast("string"), F.regexp_replace("p_brand", "Brand#", "b")
    n, m = F.col("p_partkey"), (F.col("p_partkey") % 50).cast("string")
    verb = F.when(n % 4 == 0, '[HttpGet(\n        "{id}")]').when(n % 4 == 1, '[HttpPost ( "save" ), Obsolete("} ] )")]').when(n % 4 == 2, "[HttpPut] // [HttpGet]").otherwise('[HttpDelete(\n"{id}/{rev}"\n)]')
    controller = _lines(
        F.when(n % 3 == 0, "using Azure.Storage.Blobs; /* using Azure.Identity; */").otherwise("/* using Azure.Identity; { */ using System.Linq;"),
        _text("[Route(\n    \"api/", b, '/[controller]"\n)]'),
        _text("public sealed class P", k, "Controller"), "    : ControllerBase // : Nothing {", "{", "#region fields {",
        _text("    private readonly", "\n        IP", k, "Service", "\n        _svc;"),
        "#endregion",
        _text("    public P", k, "Controller("), _text("        IP", k, "Service svc) // the service ("), "    {", "        var odd = '{'; var path = @\"C:\\\"; _svc", "            = svc;", "    }",
        _text("    ", verb), "    public", "        IActionResult", _text("        Act", k, "("), "            int id)", "    {",
        _text("        _svc", "\n            .Load", k, "("), "            );", "        /* _svc.Gone(); } */", "        return Ok();", "    }", "}",
    )
    service = _lines(
        _text("public class P", k, "Service :"), _text("    IP", k, "Service"), "{", _text("    private readonly IP", k, "Repository _repo; public P", k, "Service(IP", k, "Repository repo) { _repo = repo; }"),
        _text("    public void Load", k, "() { _repo.Fetch", k, '(); var s = $"{(1 > 0 ? "}" : "{")} {{"; Audit', k, "(); }"),
        "    /// <summary> { \" </summary>", _text("    private void Audit", k, "("), "    )", "    {", '        var raw = """', "            } public void No() { No2(); }", '            """;', "    }", "}",
    )
    repository = _lines(
        _text("public class P", k, "Repository : IP", k, "Repository {"), "    private readonly ShopDbContext _db;",
        _text("    public P", k, "Repository(\n        ShopDbContext db\n    )"), "    {", "        _db =", "            db;", "    }",
        _text("    public void Fetch", k, "()"), "    {",
        F.when(n % 2 == 0, _text("        _db.Database.ExecuteSqlRaw(\n            \"EXEC dbo.GetP", k, ' @Id"); // "EXEC dbo.No"')).otherwise("        _db\n            .Parts\n            .Add(\n                new Part());"),
        F.when(n % 2 == 0, "").otherwise("        _db\n            .SaveChanges();"), "    }", "}",
    )
    registration = _lines(
        _text("services\n    .AddScoped<\n        IP", k, "Service,\n        P", k, "Service>();"),
        F.when(n % 7 == 0, _text("services.AddKeyedScoped<IP", k, "Repository, P", k, 'Repository>(\n    "main");')).otherwise(_text("services /* ; */ .AddScoped<IP", k, "Repository, P", k, "Repository>();")),
    )
    procedure = _lines(
        "/* outer /* CREATE TABLE dbo.No (a int) */ don't */", "CREATE", _text("  PROCEDURE dbo.GetP", k), "AS", "BEGIN", "    -- FROM dbo.Comment", _text("    INSERT INTO\n        [dbo].[Audit", m, "] (Id) VALUES ('FROM dbo.Text');"),
        "    SELECT Id", "    FROM", _text("        dbo . Part", m, ";"), "END", "GO", "SELECT * FROM dbo.Outside",
    )
    file = lambda path, content: F.struct(path.alias("relative_path"), content.alias("content"))
    files = F.array(
        file(_text("src/", b, "/Api/P", k, "Controller.cs"), controller), file(_text("src/", b, "/Core/P", k, "Service.cs"), service), file(_text("src/", b, "/Data/P", k, "Repository.cs"), repository),
        file(_text("src/", b, "/Di/P", k, "Registration.cs"), registration), file(_text("sql/", b, "/GetP", k, ".sql"), procedure),
    )
    rows = part.select(_text("ws", (n % 5).cast("string")).alias("workspace_id"), F.explode(files).alias("f"))
    return rows.select("workspace_id", "f.relative_path", "f.content", F.octet_length("f.content").cast("long").alias("size_bytes"))
