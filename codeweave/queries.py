"""Registered queries of the code-evidence operators and their oracle SQL.

Most run on the corpus derived from ``part`` (plans/corpus.py); the SQL derives what must come out from the columns of
``part``, never from the text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.text import language_title
from .operators import chains, explorer, extract, inventory, link, relink, runtime, trace
from .plans.corpus import other_corpus, part_corpus, parts, wrapped_corpus
from .plans.materialise import cut, join_by_rows, shared_folder
from .plans.star_graph import star_graph
from .sources import files as sources
from .sources import tree
from .streaming import listings
from .streaming.incremental import index_stream, latest

_P = "p AS (SELECT p_partkey AS k, replace(p_brand, 'Brand#', 'b') AS b, 'ws' || (p_partkey % 5) AS ws, p_size, p_name FROM part)"
_ACT = "'src/' || b || '/Api/P' || k || 'Controller.cs'"
_SVC = "'src/' || b || '/Core/P' || k || 'Service.cs'"
_REPO = "'src/' || b || '/Data/P' || k || 'Repository.cs'"
_WEB = "'web/' || b || '/p' || k"
_API = "CASE k % 4 WHEN 0 THEN 'GET /api/' || b || '/P' || k || '/{id}' WHEN 1 THEN 'POST /api/' || b || '/P' || k || '/save' WHEN 2 THEN 'PUT /api/' || b || '/P' || k ELSE 'DELETE /api/' || b || '/P' || k || '/{id}/{rev}' END"
_CALL = "CASE k % 4 WHEN 0 THEN 'GET /api/' || b || '/P' || k || '/' || p_size WHEN 1 THEN 'POST /api/' || b || '/P' || k || '/save' WHEN 2 THEN 'PUT /v2/api/' || b || '/P' || k ELSE 'DELETE /api/' || b || '/P' || k || '/1' END"
_MATCH = f"""SELECT ws AS workspace_id, {_WEB} || '.service.ts::load' || k AS frontend, {_ACT} || '::Act' || k AS handler,
       CASE WHEN k % 4 = 1 THEN 'exact' ELSE 'template' END AS match,
       'frontendApi=' || {_CALL} || ';backendApi=' || {_API} || ';match=' || CASE WHEN k % 4 = 1 THEN 'exact' ELSE 'template' END || ';controller=P' || k || 'Controller' AS metadata
  FROM p WHERE k % 4 <> 3"""

_SYMBOLS = f"""s AS (
        SELECT ws, {_WEB} || '.service.ts' AS path, 'base' AS name, 'const' AS kind, NULL AS container, 1 AS line, 1 AS col FROM p
        UNION ALL SELECT ws, {_WEB} || '.service.ts', 'P' || k || 'Service', 'class', NULL, 2, 1 FROM p
        UNION ALL SELECT ws, {_WEB} || '.service.ts', 'load' || k, 'method', NULL, 3, 3 FROM p
        UNION ALL SELECT ws, {_WEB} || '.component.ts', 'P' || k || 'Component', 'class', NULL, 1, 1 FROM p
        UNION ALL SELECT ws, {_WEB} || '.component.ts', 'go' || k, 'method', NULL, 2, 3 FROM p
        UNION ALL SELECT ws, {_WEB} || '.component.html', 'click:go' || k, 'ui-event', NULL, 1, 1 FROM p
        UNION ALL SELECT ws, 'sql/' || b || '/GetP' || k || '.sql', 'GetP' || k, 'procedure', 'dbo', 1, 18 FROM p
        UNION ALL SELECT ws, {_ACT}, 'P' || k || 'Controller', 'controller', NULL, 3, 21 FROM p
        UNION ALL SELECT ws, {_ACT}, 'P' || k || 'Controller', 'constructor', 'P' || k || 'Controller', 6, 12 FROM p
        UNION ALL SELECT ws, {_ACT}, 'Act' || k, 'method', 'P' || k || 'Controller', 11, 26 FROM p
        UNION ALL SELECT ws, {_SVC}, 'P' || k || 'Service', 'class', NULL, 1, 14 FROM p
        UNION ALL SELECT ws, {_SVC}, 'P' || k || 'Service', 'constructor', 'P' || k || 'Service', 4, 12 FROM p
        UNION ALL SELECT ws, {_SVC}, 'Load' || k, 'method', 'P' || k || 'Service', 8, 17 FROM p
        UNION ALL SELECT ws, {_SVC}, 'Audit' || k, 'method', 'P' || k || 'Service', 13, 18 FROM p
        UNION ALL SELECT ws, {_REPO}, 'P' || k || 'Repository', 'repository', NULL, 1, 14 FROM p
        UNION ALL SELECT ws, {_REPO}, 'P' || k || 'Repository', 'constructor', 'P' || k || 'Repository', 4, 12 FROM p
        UNION ALL SELECT ws, {_REPO}, 'Fetch' || k, 'method', 'P' || k || 'Repository', 8, 17 FROM p
        UNION ALL SELECT ws, 'src/' || b || '/P' || k || '.Tests/P' || k || 'Tests.cs', 'P' || k || 'Tests', 'class', NULL, 2, 21 FROM p WHERE k % 10 = 0)"""
#: How many relationships of each kind a part gives: a number, or the parts that give one.
_PER_PART = {
    "contains_symbol": "25 * count(*)", "calls_api": "count(*)", "navigates_to": "count(*)", "calls_method": "4 * count(*)", "inherits_from": "3 * count(*)", "depends_on": "3 * count(*)",
    "handles_api": "count(*)", "handled_by": "count(*)", "implemented_by": "2 * count(*)", "invokes_handler": "2 * count(*)", "reads_table": "2 * count(*)", "writes_table": "count(*) + count_if(k % 2 = 1)",
    "executes_procedure": "count_if(k % 2 = 0)", "saves_changes": "count_if(k % 2 = 1)", "uses_azure_service": "count_if(k % 3 = 0)", "matches_backend_handler": "count_if(k % 4 <> 3)",
}
_KINDS = "r AS (" + " UNION ALL ".join(f"SELECT ws, '{kind}' AS kind, CAST({n} AS BIGINT) AS n FROM p GROUP BY ws" for kind, n in _PER_PART.items()) + ")"
_LIVE = r"s2 AS (SELECT * FROM s WHERE path NOT LIKE '%.Tests/%')"
_TEN = "row_number() OVER (PARTITION BY ws ORDER BY n DESC, title)"
_SUMMARY = f"""WITH {_P}, {_SYMBOLS}, {_KINDS}, {_LIVE}, k AS (
        SELECT ws, 'language' AS section, l.title, CAST(l.f * count(*) AS BIGINT) AS n FROM p, (VALUES ('csharp', 4), ('sql', 1), ('typescript', 2), ('html', 1)) l(title, f) GROUP BY ws, l.title, l.f
        UNION ALL SELECT ws, 'symbol', kind, count(*) FROM s2 GROUP BY ws, kind
        UNION ALL SELECT ws, 'azure', 'Azure Blob Storage', n FROM r WHERE kind = 'uses_azure_service' AND n > 0
        UNION ALL SELECT ws, 'relationship', title, n FROM (SELECT ws, kind AS title, n, {_TEN} AS i FROM (SELECT ws, kind, kind AS title, n FROM r WHERE n > 0)) WHERE i <= 10)
    SELECT ws AS workspace_id, section, title, n FROM k
    UNION ALL SELECT ws, 'total', 'files', 8 * count(*) FROM p GROUP BY ws
    UNION ALL SELECT ws, 'total', 'symbols', count(*) FROM s2 GROUP BY ws
    UNION ALL SELECT ws, 'total', 'relationships', CAST(sum(n) AS BIGINT) FROM r GROUP BY ws"""
_DEPENDS = f"""WITH {_P}, d AS (
        SELECT ws AS workspace_id, {_ACT} || '::P' || k || 'Controller' AS source_identifier, 'IP' || k || 'Service' AS target_identifier FROM p
        UNION ALL SELECT ws, {_SVC} || '::P' || k || 'Service', 'IP' || k || 'Repository' FROM p
        UNION ALL SELECT ws, {_REPO} || '::P' || k || 'Repository', 'ShopDbContext' FROM p)
    SELECT workspace_id, 'depends_on' AS relationship_kind, source_identifier, target_identifier, CAST(NULL AS VARCHAR) AS metadata FROM d
    QUALIFY row_number() OVER (PARTITION BY workspace_id ORDER BY source_identifier, target_identifier) <= 50"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            join_by_rows(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.indexable(part_corpus(spark, sf_dir))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as plain files of mixed extensions."""
    return _as_files(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _as_files(docs: DataFrame) -> DataFrame:
    docs = docs.where("doc_id is not null")
    ext = F.element_at(F.array(*[F.lit(x) for x in (".cs", ".sql", ".ts", ".tsx", ".html", ".json", ".md", ".bin")]), (F.col("doc_id") % 8 + 1).cast("int"))
    path = F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), ext)
    return docs.select(F.col("source").alias("workspace_id"), path.alias("relative_path"), F.col("text").alias("content"), F.octet_length("text").cast("long").alias("size_bytes"), "doc_id")


_DOCS = "d AS (SELECT source AS workspace_id, lang || '/' || doc_id || (['.cs','.sql','.ts','.tsx','.html','.json','.md','.bin'])[doc_id % 8 + 1] AS relative_path, text, doc_id, (['csharp','sql','typescript','typescript','html','json','markdown','unknown'])[doc_id % 8 + 1] AS language_id FROM documents)"
_HASH = "CASE language_id WHEN 'csharp' THEN 'csharp-analysis-v2:' ELSE 'analysis-v1:' END || upper(sha256(text))"


def _edges(spark: SparkSession, sf_dir: str, *extensions: str) -> DataFrame:
    wanted = {e: f for e, f in extract.EXTRACTORS.items() if not extensions or set(e) & set(extensions)}
    return extract.extract_evidence(_files(spark, sf_dir), wanted)[1]


def _evidence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    files = cut(_files(spark, sf_dir).select("workspace_id", "relative_path", "language_id", "content"))  # each language reads them
    symbols, edges = extract.evidence_tables(files)
    return files, symbols, cut(link.linked(edges, symbols))


def _of(edges: DataFrame, *kinds: str) -> DataFrame:
    return edges.where(F.col("relationship_kind").isin(*kinds)).select("workspace_id", "source_kind", "source_identifier", "relationship_kind", "target_kind", "target_identifier", "metadata")


@query(f"WITH {_P}, f AS (SELECT ws AS workspace_id, unnest([{_ACT}, {_SVC}, {_REPO}, 'src/' || b || '/Di/P' || k || 'Registration.cs', 'sql/' || b || '/GetP' || k || '.sql', {_WEB} || '.service.ts', {_WEB} || '.component.html', {_WEB} || '.component.ts'] || CASE WHEN k % 10 = 0 THEN ['src/' || b || '/P' || k || '.Tests/P' || k || 'Tests.cs'] ELSE [] END) AS relative_path FROM p) SELECT workspace_id, relative_path, CASE WHEN relative_path LIKE '%.cs' THEN 'csharp' WHEN relative_path LIKE '%.sql' THEN 'sql' WHEN relative_path LIKE '%.ts' THEN 'typescript' ELSE 'html' END AS language_id, 'parsed' AS parse_status FROM f")
def s2_indexable_files(spark, sf_dir):
    return _files(spark, sf_dir).select("workspace_id", "relative_path", "language_id", "parse_status")


@query(f"WITH {_DOCS} SELECT workspace_id, relative_path, language_id, {_HASH} AS content_hash FROM d WHERE octet_length(encode(text)) <= 1048576")
def s6_fingerprints(spark, sf_dir):
    return sources.indexable(_documents(spark, sf_dir)).select("workspace_id", "relative_path", "language_id", "content_hash")


@query(f"WITH {_P} SELECT ws AS workspace_id, 'symbol' AS source_kind, {_WEB} || '.service.ts::load' || k AS source_identifier, 'calls_api' AS relationship_kind, 'api' AS target_kind, {_CALL} AS target_identifier, 'line=4' AS metadata FROM p")
def x11_calls_api(spark, sf_dir):
    return _of(_edges(spark, sf_dir, ".ts"), "calls_api")


@query(f"WITH {_P} SELECT ws AS workspace_id, 'symbol' AS source_kind, {_WEB} || '.component.ts::go' || k AS source_identifier, 'navigates_to' AS relationship_kind, 'route' AS target_kind, '/p/' || k AS target_identifier, 'line=4' AS metadata FROM p UNION ALL SELECT ws, 'symbol', {_WEB} || '.component.ts::go' || k, 'calls_method', 'method', {_WEB} || '.component.ts::api.load' || k, 'line=3' FROM p")
def x12_x14_client_edges(spark, sf_dir):
    return _of(_edges(spark, sf_dir, ".ts"), "navigates_to", "calls_method")


@query(f"WITH {_P} SELECT ws AS workspace_id, 'ui-event' AS source_kind, {_WEB} || '.component.html::click:go' || k AS source_identifier, 'invokes_handler' AS relationship_kind, 'method' AS target_kind, {_WEB} || '.component.html::go' || k AS target_identifier, 'line=1' AS metadata FROM p")
def x15_template_events(spark, sf_dir):
    return _of(_edges(spark, sf_dir, ".html"), "invokes_handler")


@query(f"WITH {_P} SELECT ws AS workspace_id, 'procedure' AS source_kind, 'dbo.GetP' || k AS source_identifier, r.kind AS relationship_kind, 'database-table' AS target_kind, 'dbo.' || r.t || (k % 50) AS target_identifier, 'source=tsql' AS metadata FROM p, (VALUES ('writes_table', 'Audit'), ('reads_table', 'Audit'), ('reads_table', 'Part')) r(kind, t)")
def x17_procedure_tables(spark, sf_dir):
    return _of(_edges(spark, sf_dir, ".sql"), "reads_table", "writes_table")


@query(f"WITH {_P}, c AS (SELECT ws, {_ACT} || '::P' || k || 'Controller' AS s, 'ControllerBase' AS base, 'IP' || k || 'Service' AS dep FROM p UNION ALL SELECT ws, {_SVC} || '::P' || k || 'Service', 'IP' || k || 'Service', 'IP' || k || 'Repository' FROM p UNION ALL SELECT ws, {_REPO} || '::P' || k || 'Repository', 'IP' || k || 'Repository', 'ShopDbContext' FROM p) SELECT ws AS workspace_id, s AS source_identifier, 'inherits_from' AS relationship_kind, base AS target_identifier FROM c UNION ALL SELECT ws, s, 'depends_on', dep FROM c")
def x20_x23_class_edges(spark, sf_dir):
    return _of(_edges(spark, sf_dir, ".cs"), "inherits_from", "depends_on").select("workspace_id", "source_identifier", "relationship_kind", "target_identifier")


@query(f"WITH {_P} SELECT ws AS workspace_id, {_ACT} || '::Act' || k AS source_identifier, 'IP' || k || 'Service.Load' || k AS target_identifier, 'receiver=_svc' AS metadata FROM p UNION ALL SELECT ws, {_SVC} || '::Load' || k, 'IP' || k || 'Repository.Fetch' || k, 'receiver=_repo' FROM p UNION ALL SELECT ws, {_SVC} || '::Load' || k, {_SVC} || '::Audit' || k, 'receiver=this;direct=true' FROM p")
def x25_x26_method_calls(spark, sf_dir):
    return _of(_edges(spark, sf_dir, ".cs"), "calls_method").select("workspace_id", "source_identifier", "target_identifier", "metadata")


@query(f"WITH {_P} SELECT ws AS workspace_id, {_REPO} || '::Fetch' || k AS source_identifier, 'executes_procedure' AS relationship_kind, 'dbo.GetP' || k AS target_identifier FROM p WHERE k % 2 = 0 UNION ALL SELECT ws, {_REPO} || '::Fetch' || k, 'writes_table', {_REPO} || '::Parts' FROM p WHERE k % 2 = 1 UNION ALL SELECT ws, {_REPO} || '::Fetch' || k, 'saves_changes', 'ShopDbContext' FROM p WHERE k % 2 = 1")
def x27_x31_data_access(spark, sf_dir):
    return _of(_edges(spark, sf_dir, ".cs"), "executes_procedure", "writes_table", "reads_table", "saves_changes").select("workspace_id", "source_identifier", "relationship_kind", "target_identifier")


@query(f"WITH {_P} SELECT ws AS workspace_id, 'symbol' AS source_kind, {_ACT} || '::Act' || k AS source_identifier, 'handles_api' AS relationship_kind, 'api' AS target_kind, {_API} AS target_identifier, 'controller=P' || k || 'Controller' AS metadata FROM p UNION ALL SELECT ws, 'api', {_API}, 'handled_by', 'method', {_ACT} || '::Act' || k, 'controller=P' || k || 'Controller' FROM p")
def x33_mvc_endpoints(spark, sf_dir):
    return _of(_edges(spark, sf_dir, ".cs"), "handles_api", "handled_by")


@query(f"WITH {_P} SELECT ws AS workspace_id, 'IP' || k || 'Service' AS source_identifier, 'P' || k || 'Service' AS target_identifier, 'lifetime=AddScoped' AS metadata FROM p UNION ALL SELECT ws, 'IP' || k || 'Repository', 'P' || k || 'Repository', CASE WHEN k % 7 = 0 THEN 'lifetime=AddKeyedScoped;key=main' ELSE 'lifetime=AddScoped' END FROM p")
def x37_registrations(spark, sf_dir):
    return _of(_edges(spark, sf_dir, ".cs"), "implemented_by").select("workspace_id", "source_identifier", "target_identifier", "metadata")


@query(f"WITH {_P} SELECT ws AS workspace_id, {_ACT} || '::azure-service-reference' AS source_identifier, 'Azure Blob Storage' AS target_identifier FROM p WHERE k % 3 = 0 UNION ALL SELECT ws, 'src/' || b || '/P' || k || '.Tests/P' || k || 'Tests.cs::azure-service-reference', 'Azure Blob Storage' FROM p WHERE k % 10 = 0")
def x38_azure_services(spark, sf_dir):
    return _of(_edges(spark, sf_dir, ".cs"), "uses_azure_service").select("workspace_id", "source_identifier", "target_identifier")


def _symbols(spark: SparkSession, sf_dir: str, *extensions: str) -> DataFrame:
    wanted = {e: f for e, f in extract.EXTRACTORS.items() if not extensions or set(e) & set(extensions)}
    return extract.extract_evidence(_files(spark, sf_dir), wanted)[0].select("workspace_id", "relative_path", "name", "kind", "container", "line", "col")


_SYMBOL_ROWS = "SELECT ws AS workspace_id, path AS relative_path, name, kind, container, line, col FROM s"


@query(f"WITH {_P}, {_SYMBOLS} {_SYMBOL_ROWS} WHERE path LIKE 'web/%'")
def x3_x4_client_symbols(spark, sf_dir):
    return _symbols(spark, sf_dir, ".ts", ".html")


@query(f"WITH {_P}, {_SYMBOLS} {_SYMBOL_ROWS} WHERE path LIKE 'sql/%'")
def x16_sql_symbols(spark, sf_dir):
    return _symbols(spark, sf_dir, ".sql")


@query(f"WITH {_P}, {_SYMBOLS} {_SYMBOL_ROWS} WHERE path LIKE 'src/%'")
def x18_x19_types_and_members(spark, sf_dir):
    return _symbols(spark, sf_dir, ".cs")


@query(f"WITH {_P}, {_SYMBOLS} SELECT ws AS workspace_id, 'file' AS source_kind, path AS source_identifier, kind AS target_kind, path || '::' || name AS target_identifier, 'line=' || line || ';column=' || col AS metadata FROM s UNION ALL SELECT ws, 'symbol', path || '::' || container, kind, path || '::' || name, NULL FROM s WHERE container IS NOT NULL")
def x39_contains_symbol(spark, sf_dir):
    return _of(_edges(spark, sf_dir), "contains_symbol").drop("relationship_kind")


@query(f"WITH {_P}, {_SYMBOLS} SELECT ws AS workspace_id, kind, name, path || ':' || line AS location FROM s WHERE contains(lower(name), 'load') QUALIFY row_number() OVER (PARTITION BY ws ORDER BY name, path, line, kind) <= 200")
def q3_search_symbols(spark, sf_dir):
    return inventory.search_symbols(_symbols(spark, sf_dir), "LOAD")


@query(f"WITH {_P}, {_SYMBOLS}, f AS (SELECT ws, CAST(8 * count(*) + count_if(k % 10 = 0) AS BIGINT) AS n FROM p GROUP BY ws) SELECT ws AS workspace_id, any_value(f.n) AS file_count, count(*) AS symbol_count FROM s JOIN f USING (ws) GROUP BY ws")
def q1_workspace_status(spark, sf_dir):
    return inventory.workspace_status(_files(spark, sf_dir), _symbols(spark, sf_dir))


@query(f"WITH {_P}, {_SYMBOLS}, e AS (SELECT DISTINCT ws, 1 AS section, {_API} AS entry FROM p UNION ALL SELECT ws, 2, path || '::' || name FROM s WHERE kind = 'method' AND container IS NOT NULL) SELECT ws AS workspace_id, section, entry FROM e QUALIFY row_number() OVER (PARTITION BY ws ORDER BY section, entry) <= 1000")
def q20_trace_entries(spark, sf_dir):
    return inventory.trace_entries(_edges(spark, sf_dir, ".cs"))


def _other_edges(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    return _of(extract.extract_evidence(sources.indexable(other_corpus(spark, sf_dir)))[1], *kinds)


_K = "p AS (SELECT p_partkey AS k FROM part)"


@query(f"WITH {_K} SELECT 'ui-event' AS source_kind, 'web2/v' || k || '.tsx::onClick:save' || k AS source_identifier, 'web2/v' || k || '.tsx::save' || k AS target_identifier, 'line=2' AS metadata FROM p UNION ALL SELECT 'route', '/p/' || k, 'Page' || k, 'line=3;framework=react' FROM p UNION ALL SELECT 'route', '/a/' || k, 'Page' || k, 'line=4;framework=angular' FROM p UNION ALL SELECT 'symbol', 'web2/v' || k || '.tsx::Page' || k, '/target' || k, 'line=6' FROM p")
def x6_x8_events_and_routes(spark, sf_dir):
    return _other_edges(spark, sf_dir, "invokes_handler", "renders_component", "navigates_to").select("source_kind", "source_identifier", "target_identifier", "metadata")


@query(f"WITH {_K} SELECT 'fn/F' || k || '.cs::Job' || k AS source_identifier, 'IStore' AS target_identifier, 'parameter=store;field=_store;key=main;source=FromKeyedServices' AS metadata FROM p UNION ALL SELECT 'fn/F' || k || '.cs::Job' || k, 'IStore', NULL FROM p")
def x24_keyed_dependencies(spark, sf_dir):
    return _other_edges(spark, sf_dir, "depends_on").select("source_identifier", "target_identifier", "metadata")


@query(f"WITH {_K} SELECT 'fn/F' || k || '.cs::Run' || k AS source_identifier, 'reads_table' AS relationship_kind, 'dbo.Part' || (k % 50) AS target_identifier, 'method=ExecuteQuery' AS metadata FROM p")
def x30_x32_query_texts(spark, sf_dir):
    return _other_edges(spark, sf_dir, "reads_table", "writes_table", "executes_procedure").select("source_identifier", "relationship_kind", "target_identifier", "metadata")


@query(f"WITH {_K}, v AS (SELECT k, v.verb || ' /jobs/' || k AS api FROM p, (VALUES ('GET'), ('POST')) v(verb)) SELECT 'symbol' AS source_kind, 'fn/F' || k || '.cs::Run' || k AS source_identifier, 'handles_api' AS relationship_kind, 'api' AS target_kind, api AS target_identifier, 'azureFunction=run' || k AS metadata FROM v UNION ALL SELECT 'api', api, 'handled_by', 'azure-function', 'fn/F' || k || '.cs::Run' || k, 'azureFunction=run' || k FROM v UNION ALL SELECT 'api', 'GET /mini/' || k, 'handled_by', 'minimal-api', 'GET /mini/' || k, 'source=minimal-api' FROM p")
def x35_x36_triggers_and_minimal_apis(spark, sf_dir):
    return _other_edges(spark, sf_dir, "handles_api", "handled_by").drop("workspace_id")


@query(f"WITH {_P} SELECT ws AS workspace_id, {_WEB} || '.component.html::click:go' || k AS source_identifier, {_WEB} || '.component.ts::go' || k AS target_identifier, 'resolved=true' AS metadata FROM p")
def l1_template_handlers(spark, sf_dir):
    symbols, edges = extract.extract_evidence(_files(spark, sf_dir), {e: f for e, f in extract.EXTRACTORS.items() if ".ts" in e or ".html" in e})
    return link.resolve_template_handlers(edges, symbols).select("workspace_id", "source_identifier", "target_identifier", "metadata")


@query(f"WITH {_P} {_MATCH}")
def l4_backend_matches(spark, sf_dir):
    found = link.match_backend_handlers(cut(_edges(spark, sf_dir, ".ts", ".cs")))
    return inventory.list_flows(found, limit=None)


@query(f"WITH {_P}, m AS ({_MATCH}), r AS (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY frontend, handler, metadata) AS n FROM m) SELECT workspace_id, frontend, handler, match, metadata FROM r WHERE n <= 50")
def q16_list_flows(spark, sf_dir):
    return inventory.list_flows(link.match_backend_handlers(cut(_edges(spark, sf_dir, ".ts", ".cs"))))


@query(f"WITH {_P}, a AS (SELECT ws AS workspace_id, {_API} AS api, {_ACT} || '::Act' || k AS handler, 'controller=P' || k || 'Controller' AS metadata FROM p WHERE k % 4 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY api, handler) AS n FROM a) SELECT workspace_id, api, handler, metadata FROM r WHERE n <= 50")
def q7_list_apis(spark, sf_dir):
    return inventory.list_apis(_edges(spark, sf_dir, ".cs"), verb="get")


@query(f"WITH {_P}, a AS (SELECT ws AS workspace_id, 'Azure Blob Storage' AS service, {_ACT} || '::azure-service-reference' AS source, 1 AS n FROM p WHERE k % 3 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY service, source) AS i FROM a) SELECT workspace_id, service, source, CAST(n AS BIGINT) AS n FROM r WHERE i <= 50")
def q8_azure_services(spark, sf_dir):
    return inventory.list_azure_services(_edges(spark, sf_dir, ".cs"))


@query(f"WITH {_DOCS}, r AS (SELECT workspace_id, relative_path, language_id, row_number() OVER (PARTITION BY workspace_id ORDER BY relative_path) AS n FROM d WHERE language_id = 'typescript') SELECT workspace_id, relative_path, language_id FROM r WHERE n <= 200")
def q2_list_files(spark, sf_dir):
    return inventory.list_files(sources.indexable(_documents(spark, sf_dir)), language="typescript").select("workspace_id", "relative_path", "language_id")


@query(f"WITH {_DOCS}, a AS (SELECT workspace_id, relative_path, {_HASH} AS h FROM d WHERE doc_id % 10 < 9), b AS (SELECT workspace_id, relative_path, CASE language_id WHEN 'csharp' THEN 'csharp-analysis-v2:' ELSE 'analysis-v1:' END || upper(sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END)) AS h FROM d) SELECT b.workspace_id, b.relative_path FROM b LEFT JOIN a ON a.workspace_id = b.workspace_id AND lower(a.relative_path) = lower(b.relative_path) WHERE a.h IS NULL OR a.h <> b.h")
def i1_changed_files(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    stored = sources.indexable(docs.where("doc_id % 10 < 9")).withColumn("is_deleted", F.lit(False))
    edited = docs.withColumn("content", F.when(F.col("doc_id") % 7 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return sources.changed_files(sources.indexable(edited), stored).select("workspace_id", "relative_path")


@query(f"WITH {_DOCS} SELECT workspace_id, relative_path, doc_id % 3 = 0 AS is_deleted FROM d")
def i3_soft_delete(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    stored = docs.withColumn("is_deleted", F.lit(False))
    return sources.soft_delete_missing(stored, docs.where("doc_id % 3 <> 0")).select("workspace_id", "relative_path", "is_deleted")


@query(_SUMMARY)
def q19_workspace_summary(spark, sf_dir):
    return inventory.workspace_summary(*_evidence(spark, sf_dir))


@query()
def o1_o6_overview(spark, sf_dir):
    files, _, edges = _evidence(spark, sf_dir)
    return inventory.overview(files, edges)


@query(_DEPENDS)
def q17_backend_listing(spark, sf_dir):
    return inventory.backend_listing(_edges(spark, sf_dir, ".cs", ".sql"))


@query("""WITH r AS (SELECT 'api/O' || l_orderkey || '.cs::Act' AS s, 'IPart' || l_partkey || '.Load' AS t FROM lineitem), b AS (SELECT s, t FROM r QUALIFY row_number() OVER (ORDER BY s, t) <= 200)
    SELECT 'ws0' AS workspace_id, 'backend' AS surface, 'Act -> ' || t AS title, 'symbol / calls_method / method' AS subtitle, 'symbol:' || s || chr(9) || 'calls_method' || chr(9) || 'method:' || t AS detail,
           'symbol' AS source_kind, s AS source_identifier, 'calls_method' AS relationship_kind, 'method' AS target_kind, t AS target_identifier, split_part(s, '::', 1) AS file_path, CAST(NULL AS INTEGER) AS line, CAST(NULL AS VARCHAR) AS metadata,
           'Act -> ' || t AS display_title, 'symbol calls method method: ' || t AS display_subtitle, 'Act - Evidence' AS display_locator, ':Act calls method ' || t || '.' AS evidence_summary, lower('backend|' || t || '|:Act|calls_method') AS occurrence_key,
           row_number() OVER (PARTITION BY t ORDER BY s) AS occurrence, count(*) OVER (PARTITION BY t) AS occurrence_count, 'with-location' AS quality FROM b""")
def q10_u3_u4_explorer(spark, sf_dir):
    """The number behind ``Evidence`` is left out: it is a hash."""
    rows = explorer.explorer_relationships(extract.evidence_ids(star_graph(spark, sf_dir)), "backend")
    rows = inventory.evidence_quality(inventory.occurrences(rows)).drop("id")
    return rows.withColumn("display_locator", F.regexp_replace("display_locator", " #.*", "")).withColumn("occurrence", F.col("occurrence").cast("long"))


@query("WITH kinds AS (SELECT 'ws0' AS workspace_id, * FROM (VALUES ('relationship_kind', 'matches_backend_handler'), ('relationship_kind', 'calls_method'), ('relationship_kind', 'implemented_by'), ('relationship_kind', 'contains_symbol'), ('relationship_kind', 'reads_table'), ('relationship_kind', 'uses_azure_service'), ('source_kind', 'symbol'), ('source_kind', 'service'), ('source_kind', 'file'), ('target_kind', 'symbol'), ('target_kind', 'method'), ('target_kind', 'class'), ('target_kind', 'database-table'), ('target_kind', 'azure-service')) v(facet, value)) SELECT * FROM kinds")
def u1_facets(spark, sf_dir):
    return inventory.facet_values(star_graph(spark, sf_dir))


@query("SELECT 'ws0' AS workspace_id, 'dbo.Supp' || l_suppkey AS title, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_suppkey QUALIFY row_number() OVER (ORDER BY count(DISTINCT l_partkey) DESC, 'dbo.Supp' || l_suppkey) <= 10")
def o5_data_touchpoints(spark, sf_dir):
    files = spark.createDataFrame([], "workspace_id string, relative_path string, language_id string")
    return inventory.overview(files, star_graph(spark, sf_dir)).where("section = 'data'").select("workspace_id", "title", "n")


@query(f"WITH {_P}, n AS (SELECT ws AS workspace_id, {_WEB} || '.service.ts::load' || k || ' -> ' || {_ACT} || '::Act' || k AS start, CASE WHEN k % 2 = 0 THEN 4 ELSE 3 END AS chains FROM p WHERE k % 4 <> 3) SELECT workspace_id, start, CAST(chains AS BIGINT) AS chains FROM n")
def g3_flow_chains(spark, sf_dir):
    _, _, edges = _evidence(spark, sf_dir)
    paths = chains.expand_chains(chains.chain_starts(edges, limit=None), chains.next_steps(edges))
    return chains.format_chains(paths).groupBy("workspace_id", "start").agg(F.count("*").alias("chains"))


@query(f"WITH {_P} SELECT ws AS workspace_id, 'api-entry' AS category, least(95, 65 + count(*)) AS confidence FROM p GROUP BY ws UNION ALL SELECT ws, 'cross-stack-entry', least(95, 70 + count(*)) FROM p WHERE k % 4 <> 3 GROUP BY ws")
def r1_entry_points(spark, sf_dir):
    edges = cut(_edges(spark, sf_dir, ".ts", ".cs"))
    return runtime.entry_points(_files(spark, sf_dir), edges.select(*link.RELATION).unionByName(link.match_backend_handlers(edges))).select("workspace_id", "category", "confidence")


@query("SELECT 'api/O' || l_orderkey || '.cs::Act' AS start, count(*) AS hops, min(first) AS first, min(last) AS last FROM (SELECT l_orderkey, min('IPart' || l_partkey || '.Load') AS first FROM lineitem GROUP BY 1) a CROSS JOIN (SELECT min('dbo.Supp' || l_suppkey) AS last FROM lineitem) b CROSS JOIN (VALUES (1), (2)) GROUP BY l_orderkey")
def r2_downstream(spark, sf_dir):
    graph = star_graph(spark, sf_dir)
    starts = graph.where("relationship_kind = 'calls_method'").select("workspace_id", F.col("source_identifier").alias("start")).distinct()
    return runtime.downstream_steps(graph, starts).groupBy("start").agg(F.count("*").alias("hops"), F.min_by("at", "hop").alias("first"), F.max_by("at", "hop").alias("last"))


_FLOWS = f"""SELECT ws AS workspace_id, 'cross-stack' AS category, {_WEB} || '.service.ts::load' || k AS source, {_ACT} || '::Act' || k AS target, 95 AS confidence, 8 - k % 2 AS n_steps FROM p WHERE k % 4 <> 3
       UNION ALL SELECT ws, 'backend-api', {_ACT} || '::Act' || k, {_API}, 80, 5 FROM p WHERE k % 4 = 3
       UNION ALL SELECT ws, 'ui-interaction', {_WEB} || '.component.html::click:go' || k, {_WEB} || '.component.html::go' || k, 78 - 4 * (k % 2), 6 - k % 2 FROM p
       UNION ALL SELECT ws, 'ui-interaction', {_WEB} || '.component.html::click:go' || k, {_WEB} || '.component.ts::go' || k, 82 - 4 * (k % 2), 7 - k % 2 FROM p"""


@query(f"WITH {_P} {_FLOWS}")
def r6_runtime_flows(spark, sf_dir):
    flows = runtime.runtime_flows(_evidence(spark, sf_dir)[2], limit=None)
    return flows.select("workspace_id", "category", "source", "target", "confidence", F.size("steps").alias("n_steps"))


@query(f"WITH {_P}, f AS ({_FLOWS}) SELECT workspace_id, 2 AS entry_points, count(*) AS flows, count_if(category <> 'ui-interaction') AS reach_api, count(*) AS reach_backend, count(*) AS reach_data, 0 AS reach_cloud FROM f GROUP BY workspace_id")
def r14_runtime_coverage(spark, sf_dir):
    files, _, edges = _evidence(spark, sf_dir)
    return runtime.runtime_coverage(runtime.entry_points(files, edges), runtime.runtime_flows(edges, limit=None))


_PATHS = f"""WITH {_P}, t AS (
        SELECT ws, b, k, 95 AS c, 8 - k % 2 AS n, 'api / ' || lower(b) || ' / p' || k || CASE k % 4 WHEN 0 THEN ' / id' WHEN 1 THEN ' / save' ELSE '' END AS title FROM p WHERE k % 4 <> 3
        UNION ALL SELECT ws, b, k, 80, 5, 'api / ' || lower(b) || ' / p' || k || ' / id / rev' FROM p WHERE k % 4 = 3),
    e AS (SELECT DISTINCT ws, 'backend-startup' AS category, 'src/' || b || '/Api/Program.cs' AS detail, b FROM p),
    f AS (SELECT e.ws, e.category, e.detail, t.c, t.n, row_number() OVER (PARTITION BY e.ws, e.detail ORDER BY t.c DESC, t.title) AS i FROM e JOIN t ON e.ws = t.ws AND e.b = t.b),
    j AS (SELECT DISTINCT ws, 'jobs/Stock.Audit' || (k % 50) || '/Program.cs' AS detail, 'audit' || (k % 50) AS token FROM p),
    x AS (SELECT DISTINCT ws, 'dbo.GetP' || k AS s, r AS kind, 'dbo.Audit' || (k % 50) AS d FROM p, (VALUES (12), (14)) v(r)),
    y AS (SELECT j.ws, j.detail, row_number() OVER (PARTITION BY j.ws, j.detail ORDER BY x.kind, x.s, x.d) AS i FROM j JOIN x ON j.ws = x.ws AND contains(lower(x.d), j.token))
    SELECT ws AS workspace_id, category, detail, CAST(max(c) AS BIGINT) AS confidence, count(*) AS n_flows, CAST(sum(n) AS BIGINT) AS n_steps FROM f WHERE i <= 6 GROUP BY ALL
    UNION ALL SELECT ws, 'backend-startup', detail, 73, count(*), 3 * count(*) FROM y WHERE i <= 6 GROUP BY ws, detail
    UNION ALL SELECT DISTINCT ws, 'backend-startup', 'tools/Program.cs', 90, 1, 1 FROM p"""


@query(_PATHS)
def r8_execution_paths(spark, sf_dir):
    """Start files beside the corpus: in the folder of handlers, in a project named after a table, and in neither."""
    files, _, edges = _evidence(spark, sf_dir)
    part = parts(spark, sf_dir).withColumn("workspace_id", F.concat(F.lit("ws"), (F.col("p_partkey") % 5).cast("string")))
    brand = F.replace("p_brand", F.lit("Brand#"), F.lit("b"))
    places = F.array(F.concat(F.lit("src/"), brand, F.lit("/Api/Program.cs")), F.concat(F.lit("jobs/Stock.Audit"), (F.col("p_partkey") % 50).cast("string"), F.lit("/Program.cs")), F.lit("tools/Program.cs"))
    starts = part.select("workspace_id", F.explode(places).alias("relative_path")).distinct()
    entries = runtime.entry_points(starts, edges).where("category = 'backend-startup'")
    paths = runtime.execution_paths(entries, runtime.runtime_flows(edges, limit=None), edges, limit=None)
    return paths.select("workspace_id", "category", "detail", "confidence", F.size("flows").cast("long").alias("n_flows"), "n_steps")


@query(f"WITH {_DOCS}, r AS (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY relative_path) AS n FROM d WHERE contains(language_id, 'sql')) SELECT workspace_id, relative_path AS title, 'sql parsed' AS subtitle, lang_of AS folder FROM (SELECT *, split_part(relative_path, '/', 1) AS lang_of FROM r) WHERE n <= 200")
def q9_explorer_files(spark, sf_dir):
    return inventory.explorer_files(sources.indexable(_documents(spark, sf_dir)), "SQL").select("workspace_id", "title", "subtitle", "folder")


_DATA = "(SELECT count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_suppkey ORDER BY n DESC LIMIT 10)"


@query(f"SELECT 'ws0' AS workspace_id, 'data' AS section, CAST(sum(n) AS BIGINT) AS score FROM {_DATA} UNION ALL SELECT 'ws0', 'azure', count(*) FROM orders UNION ALL SELECT 'ws0', 'flow', least(10, count(*)) FROM orders JOIN customer ON c_custkey = o_custkey")
def o7_starting_points(spark, sf_dir):
    files = spark.createDataFrame([], "workspace_id string, relative_path string, language_id string")
    return inventory.starting_points(inventory.overview(files, star_graph(spark, sf_dir)))


@query("SELECT 'ws0' AS workspace_id, '' AS technologies, 0 AS n_api, 10 AS n_flow, (SELECT least(10, count(DISTINCT l_suppkey)) FROM lineitem) AS n_data, (SELECT least(10, count(DISTINCT o_orderpriority)) FROM orders) AS n_azure")
def o8_overview_totals(spark, sf_dir):
    files = spark.createDataFrame([], "workspace_id string, relative_path string, language_id string")
    return inventory.overview_totals(inventory.overview(files, star_graph(spark, sf_dir)))


@query(f"WITH {_DOCS} SELECT workspace_id, relative_path, language_id, {_HASH} AS content_hash FROM d WHERE octet_length(encode(text)) <= 1048576")
def i6_incremental_stream(spark, sf_dir):
    """``documents`` as a file stream, indexed once; the stream is then started again and finds nothing new."""
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    folder = shared_folder(spark, "stream")
    for _ in range(2):
        # a pattern, so that one file as well as a folder of files can stand there
        arriving = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parque[t]")
        index_stream(arriving, f"{folder}/index", f"{folder}/checkpoint", _as_files).awaitTermination()
    return latest(spark, f"{folder}/index").select("workspace_id", "relative_path", "language_id", "content_hash")


def _order_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = star_graph(spark, sf_dir)
    return trace.trace(graph, graph.where("relationship_kind = 'calls_method'").select("workspace_id", F.col("source_identifier").alias("entry")))


@query("WITH s AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1), o AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), t AS (SELECT l_orderkey, 1 + sum(1 + n) AS n FROM o JOIN s USING (l_partkey) GROUP BY 1) SELECT 'api/O' || l_orderkey || '.cs::Act' AS entry, CAST(least(24, n) AS BIGINT) AS n_steps, n > 24 AS has_more FROM t")
def t7_trace_status(spark, sf_dir):
    return trace.trace_status(_order_traces(spark, sf_dir)).select("entry", "n_steps", "has_more")


@query("""WITH s AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), o AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
       r AS (SELECT l_orderkey, 'IPart' || l_partkey || '.Load' AS c, '' AS d, 'DI handoff' AS stage FROM o UNION ALL SELECT l_orderkey, 'IPart' || l_partkey || '.Load', 'dbo.Supp' || l_suppkey, 'Database read' FROM o JOIN s USING (l_partkey) UNION ALL SELECT DISTINCT l_orderkey, '', '', 'Entry' FROM o),
       n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY c, d) AS step FROM r),
       g AS (SELECT *, step - row_number() OVER (PARTITION BY l_orderkey, stage ORDER BY step) AS run FROM n WHERE step <= 24)
       SELECT 'api/O' || l_orderkey || '.cs::Act' AS entry, stage, CAST(min(step) AS INTEGER) AS first_step, count(*) AS n FROM g GROUP BY l_orderkey, stage, run""")
def t11_step_groups(spark, sf_dir):
    return trace.step_groups(_order_traces(spark, sf_dir)).select("entry", "stage", "first_step", "n")


_CALL_TEXT = "CASE k % 4 WHEN 0 THEN 'this.http.get(''/api/' || b || '/P' || k || '/' || p_size || ''', {});' WHEN 1 THEN 'this.http.post(`${base}/P' || k || '/save`, {});' WHEN 2 THEN 'this.http.put(''/v2/api/' || b || '/P' || k || ''', {});' ELSE 'this.http.delete(''/api/' || b || '/P' || k || '/1'', {});' END"


@query(f"WITH {_P} SELECT ws AS workspace_id, {_ACT} || '::Act' || k AS identifier, 11 AS line, 'public IActionResult Act' || k || '(int id)' AS preview FROM p UNION ALL SELECT ws, {_WEB} || '.service.ts::load' || k, 4, {_CALL_TEXT} FROM p")
def t9_source_previews(spark, sf_dir):
    edges = cut(_edges(spark, sf_dir, ".ts", ".cs"))
    handlers = edges.where("relationship_kind = 'handled_by'").select("workspace_id", F.col("target_identifier").alias("identifier"), F.lit(None).cast("string").alias("metadata"))
    calls = edges.where("relationship_kind = 'calls_api'").select("workspace_id", F.col("source_identifier").alias("identifier"), "metadata")
    return trace.source_previews(handlers.unionByName(calls), edges, _files(spark, sf_dir)).select("workspace_id", "identifier", "line", "preview")


@query(f"WITH {_DOCS} SELECT workspace_id, CASE language_id WHEN 'csharp' THEN 'C# / ASP.NET' WHEN 'sql' THEN 'SQL / T-SQL' WHEN 'typescript' THEN 'TypeScript' WHEN 'html' THEN 'HTML / Angular Templates' WHEN 'json' THEN 'JSON configuration' ELSE language_id END AS title, count(*) AS n FROM d WHERE octet_length(encode(text)) <= 1048576 GROUP BY ALL")
def f12_language_titles(spark, sf_dir):
    files = sources.indexable(_documents(spark, sf_dir))
    return files.groupBy("workspace_id", language_title(F.col("language_id")).alias("title")).agg(F.count("*").alias("n"))


def entry(spark: SparkSession) -> DataFrame:
    return q16_list_flows(spark, "/root/testdata/sf0.001")


def _wrapped(spark: SparkSession, sf_dir: str, *extensions: str) -> tuple[DataFrame, DataFrame]:
    wanted = {e: f for e, f in extract.EXTRACTORS.items() if set(e) & set(extensions)}
    return extract.extract_evidence(sources.indexable(wrapped_corpus(spark, sf_dir)), wanted)


@query(f"WITH {_P}, {_SYMBOLS} SELECT ws AS workspace_id, path AS relative_path, name, kind, container FROM s WHERE (path LIKE 'src/%' OR path LIKE 'sql/%') AND path NOT LIKE '%.Tests/%'")
def x18_wrapped_symbols(spark, sf_dir):
    return _wrapped(spark, sf_dir, ".cs", ".sql")[0].select("workspace_id", "relative_path", "name", "kind", "container")


_ROWS = "workspace_id, source_identifier, relationship_kind, target_identifier, metadata"


@query(f"""WITH {_P}, w AS (
        SELECT workspace_id, source_identifier, relationship_kind, target_identifier, CAST(NULL AS VARCHAR) AS metadata FROM ({ORACLES['x20_x23_class_edges']})
        UNION ALL SELECT workspace_id, source_identifier, 'calls_method', target_identifier, metadata FROM ({ORACLES['x25_x26_method_calls']})
        UNION ALL SELECT workspace_id, source_identifier, relationship_kind, target_identifier, CASE relationship_kind WHEN 'executes_procedure' THEN 'method=ExecuteSqlRaw' WHEN 'writes_table' THEN 'context=_db;method=Add' ELSE 'receiver=_db' END FROM ({ORACLES['x27_x31_data_access']})
        UNION ALL SELECT workspace_id, source_identifier, relationship_kind, target_identifier, metadata FROM ({ORACLES['x33_mvc_endpoints']})
        UNION ALL SELECT workspace_id, source_identifier, 'implemented_by', target_identifier, metadata FROM ({ORACLES['x37_registrations']})
        UNION ALL SELECT workspace_id, source_identifier, 'uses_azure_service', target_identifier, NULL FROM ({ORACLES['x38_azure_services']}) WHERE source_identifier NOT LIKE '%.Tests/%'
        UNION ALL SELECT workspace_id, source_identifier, relationship_kind, target_identifier, metadata FROM ({ORACLES['x17_procedure_tables']}))
    SELECT {_ROWS} FROM w""")
def x20_wrapped_relationships(spark, sf_dir):
    edges = _wrapped(spark, sf_dir, ".cs", ".sql")[1]
    return edges.where("relationship_kind <> 'contains_symbol'").select("workspace_id", "source_identifier", "relationship_kind", "target_identifier", "metadata")


_TOP = "(SELECT source, target, okey, row_number() OVER (ORDER BY source, target) AS i FROM (SELECT 'web/n' || c_nationkey || '/c' || c_custkey || '.ts::load' AS source, 'api/O' || o_orderkey || '.cs::Act' AS target, o_orderkey AS okey FROM customer JOIN orders ON c_custkey = o_custkey) ORDER BY i LIMIT 80)"


@query(f"""WITH s AS {_TOP}, l AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), d AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), c AS (
        SELECT s.i, source, target, 'IPart' || l.l_partkey || '.Load' AS call, 'svc/Part' || l.l_partkey || '.cs::Load' AS method, 'dbo.Supp' || l_suppkey AS t
        FROM s LEFT JOIN l ON l.l_orderkey = okey LEFT JOIN d ON d.l_partkey = l.l_partkey), n AS (SELECT *, row_number() OVER (ORDER BY i, call, t) AS n FROM c)
    SELECT 'ws0' AS workspace_id, CAST(n AS INTEGER) AS n,
           'symbol:' || source || ' --matches_backend_handler--> symbol:' || target || coalesce(' --calls_method--> method:' || call || ' --resolved_to--> symbol:' || method || ' --reads_table--> database-table:' || t, '') AS compact,
           'symbol:' || source || chr(10) || '  matches_backend_handler -> symbol:' || target || coalesce(chr(10) || '    calls_method -> method:' || call || chr(10) || '      resolved_to -> symbol:' || method || chr(10) || '        reads_table -> database-table:' || t, '') AS tree
    FROM n WHERE n <= 20""")
def g5_g6_first_chains(spark, sf_dir):
    graph = star_graph(spark, sf_dir)
    found = chains.format_chains(chains.expand_chains(chains.chain_starts(graph), chains.next_steps(graph), limit=20))
    n = F.row_number().over(Window.partitionBy("workspace_id").orderBy("ordinal"))
    return found.select("workspace_id", n.alias("n"), "compact", "tree")


@query("WITH p AS (SELECT p_partkey AS k FROM part), e AS (SELECT 'v' || k || '/items/' AS entry, 'api' || k AS m FROM p WHERE k % 3 = 0 UNION ALL SELECT 'GET /v' || k || '/items/{id:int}/all/', 'api' || k FROM p WHERE k % 3 = 1 UNION ALL SELECT 'site/GET /v' || k || '/items/{id}/all/more', 'api' || k FROM p WHERE k % 3 = 2 UNION ALL SELECT 'Run' || k || 'x', 'job' || k FROM p UNION ALL SELECT 'nowhere' || k, NULL FROM p) SELECT 'w' AS workspace_id, entry, CASE WHEN m LIKE 'api%' THEN 'api/A' || substr(m, 4) || '.cs::Get' WHEN m IS NOT NULL THEN 'job/J' || substr(m, 4) || '.cs::Run' || substr(m, 4) || 'x' END AS method, CASE WHEN m IS NULL THEN 'not-found' ELSE 'found' END AS status FROM e")
def t1_entries(spark, sf_dir):
    """Entries that are part of one route, equal one, or hold one, and method names, at most one of each for each part."""
    k, n = F.col("p_partkey").cast("string"), F.col("p_partkey") % 3
    part = parts(spark, sf_dir)
    text = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    api = F.struct(F.lit("api").alias("source_kind"), text("GET /v", k, "/items/{id:int}/all").alias("source_identifier"), F.lit("handled_by").alias("relationship_kind"), F.lit("method").alias("target_kind"), text("api/A", k, ".cs::Get").alias("target_identifier"))
    job = F.struct(F.lit("symbol").alias("source_kind"), text("job/J", k, ".cs::J").alias("source_identifier"), F.lit("contains_symbol").alias("relationship_kind"), F.lit("method").alias("target_kind"), text("job/J", k, ".cs::Run", k, "x").alias("target_identifier"))
    edges = part.select(F.lit("w").alias("workspace_id"), F.explode(F.array(api, job)).alias("e")).select("workspace_id", "e.*", F.lit(None).cast("string").alias("metadata"))
    route = F.when(n == 0, text("v", k, "/items/")).when(n == 1, text("GET /v", k, "/items/{id:int}/all/")).otherwise(text("site/GET /v", k, "/items/{id}/all/more"))
    entries = part.select(F.lit("w").alias("workspace_id"), F.explode(F.array(route, text("Run", k, "x"), text("nowhere", k))).alias("entry"))
    return trace.find_entries(edges, entries).withColumnRenamed("at", "method")


def _dispatch_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per part: a call to an injected job (by key for even parts) whose base class calls back into overrides."""
    k, even = F.col("p_partkey").cast("string"), F.col("p_partkey") % 2 == 0
    text = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])

    def row(kind: str, source: Column, target_kind: str, target: Column, metadata: Column | str | None = None, source_kind: str = "symbol") -> Column:
        note = metadata if isinstance(metadata, Column) else F.lit(metadata).cast("string")
        return F.struct(F.lit(source_kind).alias("source_kind"), source.alias("source_identifier"), F.lit(kind).alias("relationship_kind"), F.lit(target_kind).alias("target_kind"), target.alias("target_identifier"), note.alias("metadata"))

    at = lambda name, member=None: text(name, k, ".cs::", *([member] if member else [name, k]))
    direct = "receiver=this;direct=true"
    rows = [
        row("contains_symbol", at("C"), "method", text("C", k, ".cs::Go", k)), row("calls_method", text("C", k, ".cs::Go", k), "method", text("IJob", k, ".Run"), "receiver=_job"),
        row("depends_on", at("C"), "service", text("IJob", k)), row("depends_on", at("C"), "service", text("IJob", k), F.when(even, "parameter=job;field=_job;key=b;source=FromKeyedServices")),
        *[row("implemented_by", text("IJob", k), "class", text("Job", j, k), F.when(even, f"lifetime=AddKeyedScoped;key={j.lower()}").otherwise("lifetime=AddScoped"), "service") for j in "AB"],
        *[row("inherits_from", at(f"Job{j}"), "class", text("Base", k)) for j in "AB"], row("inherits_from", at("Base"), "class", text("Root", k)), row("inherits_from", at("Root"), "class", text("Root", k)),
        *[row("contains_symbol", at(f"Job{j}"), "method", at(f"Job{j}", m)) for j in "AB" for m in ("Run", "Hook")], *[row("contains_symbol", at("Base"), "method", at("Base", m)) for m in ("Inner", "Hook")],
        row("contains_symbol", at("Root"), "method", at("Root", "Deep")), *[row("calls_method", at(f"Job{j}", "Run"), "method", at(f"Job{j}", "Inner"), direct) for j in "AB"],
        *[row("calls_method", at("Base", "Inner"), "method", at("Base", m), direct) for m in ("Deep", "Hook")], row("calls_method", at("Root", "Deep"), "method", at("Root", "Gone"), direct),
        *[row("reads_table", at(f"Job{j}", "Hook"), "database-table", text("dbo.T", j, k)) for j in "AB"],
    ]
    edges = parts(spark, sf_dir).select(F.lit("w").alias("workspace_id"), F.explode(F.array(*rows)).alias("e")).select("workspace_id", "e.*")
    entries = edges.where("relationship_kind = 'calls_method' and metadata = 'receiver=_job'").select("workspace_id", F.col("source_identifier").alias("entry"))
    return trace.trace(edges, entries)


@query("""WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN 'B' ELSE 'A' END AS j FROM part), s AS (
        SELECT k, 1 AS step, 'Entry' AS stage, 'C' || k || '.cs::Go' || k AS target, 'C' || k || '.cs::Go' || k AS next FROM p
        UNION ALL SELECT k, 2, CASE WHEN j = 'B' THEN 'Keyed DI handoff' ELSE 'DI handoff' END, 'IJob' || k || '.Run', 'Job' || j || k || '.cs::Run' FROM p
        UNION ALL SELECT k, 3, 'Base class call', 'Job' || j || k || '.cs::Inner', 'Base' || k || '.cs::Inner' FROM p
        UNION ALL SELECT k, 4, 'Base class call', 'Base' || k || '.cs::Deep', 'Root' || k || '.cs::Deep' FROM p
        UNION ALL SELECT k, 5, 'Unresolved call', 'Root' || k || '.cs::Gone', NULL FROM p
        UNION ALL SELECT k, 6, 'Override call', 'Base' || k || '.cs::Hook', 'Job' || j || k || '.cs::Hook' FROM p
        UNION ALL SELECT k, 7, 'Database read', 'dbo.T' || j || k, NULL FROM p)
    SELECT 'C' || k || '.cs::Go' || k AS entry, step, stage, target, next FROM s""")
def t3_t4_dispatch(spark, sf_dir):
    return _dispatch_trace(spark, sf_dir).select("entry", "step", "stage", "target", "next")


_COUNTED = "CAST(n AS VARCHAR) || ' {0}' || CASE WHEN n = 1 THEN '' ELSE 's' END"


@query(f"""WITH d AS (SELECT source, lang, (['.cs','.sql','.ts','.tsx','.html','.json','.md','.bin'])[doc_id % 8 + 1] AS ext FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL), s AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem),
        b(label, i, n, m) AS (
            SELECT 'API to backend handoff', 1, (SELECT count(*) FROM orders JOIN customer ON c_custkey = o_custkey) + (SELECT count(*) FROM part), (SELECT count(DISTINCT o_orderkey) FROM orders JOIN customer ON c_custkey = o_custkey) + (SELECT count(*) FROM part)
            UNION ALL SELECT 'Method calls', 2, (SELECT count(*) FROM lineitem), (SELECT count(DISTINCT l_partkey) FROM lineitem)
            UNION ALL SELECT 'Table reads', 3, (SELECT count(*) FROM s), (SELECT count(DISTINCT l_suppkey) FROM s)
            UNION ALL SELECT 'Code relationships', 4, (SELECT count(*) FROM part), (SELECT count(*) FROM part)),
        f AS (SELECT source, lang, count(*) AS n, array_to_string(list_slice(list_sort(list(DISTINCT ext)), 1, 3), ', ') AS e FROM d GROUP BY source, lang), a AS (SELECT 'Service ' || o_orderpriority AS label, count(*) AS n FROM orders GROUP BY o_orderpriority)
    SELECT 'ws0' AS workspace_id, 'backend' AS surface, label, i AS place, n AS n_rows, {_COUNTED.format('relationship')} || ' / ' || m || ' target' || CASE WHEN m = 1 THEN '' ELSE 's' END AS summary FROM b
    UNION ALL SELECT 'ws0', 'azure', label, CAST(row_number() OVER (ORDER BY lower(label), label) AS INTEGER), n, {_COUNTED.format('usage')} || ' in ' || {_COUNTED.format('file')} FROM a
    UNION ALL SELECT source, 'files', lang, CAST(row_number() OVER (PARTITION BY source ORDER BY lower(lang), lang) AS INTEGER), n, {_COUNTED.format('file')} || ' / ' || e FROM f""")
def u5_evidence_groups(spark, sf_dir):
    graph = extract.evidence_ids(star_graph(spark, sf_dir))
    rows = [explorer.explorer_relationships(graph, surface, limit=None) for surface in ("backend", "azure")]
    files = explorer.file_items(_documents(spark, sf_dir).where("relative_path is not null and workspace_id is not null").withColumn("language_id", F.lit("")).withColumn("parse_status", F.lit("parsed")))
    return explorer.group_evidence(rows[0].unionByName(rows[1])).unionByName(explorer.group_evidence(files))


@query("SELECT 'IPart' || p_partkey AS selected, 'Outgoing from this evidence' AS label, 'contains_symbol' AS relationship_kind, 'svc/Part' || p_partkey || '.cs::Part' || p_partkey AS source_identifier FROM part WHERE p_partkey % 2 = 0")
def u7_related_rows(spark, sf_dir):
    graph = extract.evidence_ids(star_graph(spark, sf_dir))
    rows = explorer.relationship_items(graph, explorer.surface_of(F.col("relationship_kind")))
    rows = cut(rows.select("workspace_id", "id", "relationship_kind", "source_identifier", "target_identifier", "file_path"))
    selected = rows.where("relationship_kind = 'implemented_by' and cast(substr(source_identifier, 6) as int) % 2 = 0")
    found = explorer.related_local(rows, selected).join(rows.select("workspace_id", "id", "relationship_kind", "source_identifier"), ["workspace_id", "id"])
    return found.join(selected.select("workspace_id", F.col("id").alias("selected_id"), F.col("source_identifier").alias("selected")), ["workspace_id", "selected_id"]).select("selected", "label", "relationship_kind", "source_identifier")


@query("WITH r AS (SELECT DISTINCT 'svc/Part' || l_partkey || '.cs::Load' AS s, 'dbo.Supp' || l_suppkey AS t FROM lineitem WHERE l_suppkey::VARCHAR LIKE '1%') SELECT 'ws0' AS workspace_id, 'reads_table' AS relationship_kind, s AS source_identifier, t AS target_identifier FROM r QUALIFY row_number() OVER (ORDER BY s, t) <= 50")
def q4_n3_search_relationships(spark, sf_dir):
    found = inventory.search_relationships(star_graph(spark, sf_dir), search="SUPP1", kind="table", source="svc/")
    return found.select("workspace_id", "relationship_kind", "source_identifier", "target_identifier")


@query(f"""WITH s AS {_TOP}, l AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), d AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), c AS (
        SELECT i, source || ' -> ' || target AS start, l.l_partkey AS p, row_number() OVER (ORDER BY i, 'IPart' || l.l_partkey || '.Load', 'dbo.Supp' || l_suppkey) AS n FROM s LEFT JOIN l ON l.l_orderkey = okey LEFT JOIN d ON d.l_partkey = l.l_partkey), t AS (SELECT * FROM c WHERE n <= 20)
    SELECT start, 'backend' AS stage, CAST(sum(CASE WHEN p IS NULL THEN 1 ELSE 2 END) AS BIGINT) AS n FROM t GROUP BY start UNION ALL SELECT start, 'database', count(p) FROM t WHERE p IS NOT NULL GROUP BY start""")
def g7_stage_profile(spark, sf_dir):
    graph = star_graph(spark, sf_dir)
    return chains.stage_profile(chains.expand_chains(chains.chain_starts(graph), chains.next_steps(graph), limit=20)).select("start", "stage", "n")


@query("""WITH c AS (SELECT p_partkey AS k, '/c' || p_partkey AS route, CASE WHEN p_partkey % 2 = 0 THEN 'Big' || p_partkey || 'Panel' ELSE 'List' || p_partkey || 'Component' END AS component FROM part),
        s AS (SELECT 'web/x-BIG' || p_partkey || 'panel-view.ts::load' AS start, '' AS stands FROM part UNION ALL SELECT 'web/list-' || p_partkey || '.component.ts::go', 'list' || p_partkey || 'component' FROM part),
        m AS (SELECT start, route, component FROM s JOIN c ON lower(component) = stands OR contains(lower(start), lower(component)))
    SELECT start, arg_min(route, route || ' ' || component) AS route, arg_min(component, route || ' ' || component) AS component FROM m GROUP BY start""")
def r4_component_routes(spark, sf_dir):
    k, even = F.col("p_partkey").cast("string"), F.col("p_partkey") % 2 == 0
    part = parts(spark, sf_dir)
    component = F.when(even, F.concat(F.lit("Big"), k, F.lit("Panel"))).otherwise(F.concat(F.lit("List"), k, F.lit("Component")))
    routes = part.select(F.lit("w").alias("workspace_id"), F.lit("renders_component").alias("relationship_kind"), F.concat(F.lit("/c"), k).alias("source_identifier"), component.alias("target_identifier"))
    places = F.array(F.concat(F.lit("web/x-BIG"), k, F.lit("panel-view.ts::load")), F.concat(F.lit("web/list-"), k, F.lit(".component.ts::go")))
    return runtime.component_routes(routes, part.select(F.lit("w").alias("workspace_id"), F.explode(places).alias("start"))).select("start", "route", "component")


@query("WITH t AS (SELECT CAST((SELECT count(*) FROM orders JOIN customer ON c_custkey = o_custkey) + (SELECT count(*) FROM lineitem) + 2 * (SELECT count(*) FROM part) + (SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)) + (SELECT count(*) FROM orders) AS BIGINT) AS n) SELECT 'ws0' AS workspace_id, n AS n_rows, n AS n_ids FROM t")
def x41_evidence_ids(spark, sf_dir):
    """Repeated rows have ids of their own."""
    return extract.evidence_ids(star_graph(spark, sf_dir)).groupBy("workspace_id").agg(F.count("*").alias("n_rows"), F.count_distinct("rel_id").alias("n_ids"))


@query("SELECT 'C' || p_partkey || '.cs::Go' || p_partkey AS entry, 5 AS step, 'Unresolved call: Root' || p_partkey || '.cs::Gone' AS warning FROM part")
def t6_trace_warnings(spark, sf_dir):
    return trace.warnings(_dispatch_trace(spark, sf_dir)).select("entry", "step", "warning")


@query("SELECT 'C' || p_partkey || '.cs::Go' || p_partkey AS entry, v.step, v.category FROM part, (VALUES (1, 'entry'), (2, 'handoff'), (3, 'app'), (4, 'app'), (5, 'app'), (6, 'app'), (7, 'data')) v(step, category)")
def t8_t10_visible_steps(spark, sf_dir):
    return trace.visible_steps(_dispatch_trace(spark, sf_dir), boundary=False).select("entry", "step", "category")


@query("""WITH p AS (SELECT p_partkey AS k, p_partkey % 9 AS c FROM part), f AS (
        SELECT k, c, CASE c WHEN 0 THEN 'src/Temp' || k || '/x.cs' WHEN 1 THEN 'src/a/Gen' || k || '.Skip.cs' WHEN 2 THEN 'top' || k || '.sql' WHEN 3 THEN 'q/top' || k || '.sql' WHEN 4 THEN 'src/docs/z' || k || '.md'
               WHEN 5 THEN 'src/keep' || k || '.cs' WHEN 6 THEN 'lib' || k || '/v1/deep/y.cs' WHEN 7 THEN 'temp' || k ELSE 'a/b' || k || '/x1.ts' END AS path FROM p)
    SELECT 'w' || (k % 3) AS workspace_id, path AS relative_path FROM f WHERE NOT (c IN (0, 1, 2, 4, 6) OR (c = 8 AND k % 3 = 1))""")
def s3_ignore_rules(spark, sf_dir):
    """Per part one path and, in its workspace, rules of every form: of these, w1 has one without literals."""
    k, c = F.col("p_partkey").cast("string"), F.col("p_partkey") % 9
    text = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    paths = [text("src/Temp", k, "/x.cs"), text("src/a/Gen", k, ".Skip.cs"), text("top", k, ".sql"), text("q/top", k, ".sql"), text("src/docs/z", k, ".md"), text("src/keep", k, ".cs"), text("lib", k, "/v1/deep/y.cs"), text("temp", k), text("a/b", k, "/x1.ts")]
    part = parts(spark, sf_dir).select("p_partkey", text("w", (F.col("p_partkey") % 3).cast("string")).alias("workspace_id"), F.element_at(F.array(*paths), (c + 1).cast("int")).alias("relative_path"))
    own = F.array(text("temp", k, "/"), text("/TOP", k, ".sql"), text("lib", k, "/v?/deep"), F.lit("*.skip.cs"), F.lit("docs"), F.lit("# keep*"), F.lit(" "), F.when(F.col("workspace_id") == "w1", "??.ts"))
    rules = part.select("workspace_id", F.explode(F.array_compact(own)).alias("rule")).distinct()
    return sources.apply_ignore_rules(part.drop("p_partkey"), rules)


@query("""WITH d AS (SELECT source AS workspace_id, doc_id, (['csharp','sql','typescript','typescript','html','json','markdown','unknown'])[doc_id % 8 + 1] AS lang, octet_length(encode(text)) > 1048576 AS big FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL)
    SELECT workspace_id, count(*) AS files_scanned, count(*) FILTER (doc_id % 7 = 0 AND NOT big) AS files_indexed, count(*) FILTER (big) AS files_skipped, count(*) FILTER (doc_id % 7 = 0 AND NOT big) AS symbols_indexed FROM d GROUP BY workspace_id""")
def i5_index_summary(spark, sf_dir):
    """``documents`` as files, of which every seventh changed; each has one symbol."""
    docs = _documents(spark, sf_dir).where("relative_path is not null and workspace_id is not null")
    stored = sources.indexable(docs).withColumn("is_deleted", F.lit(False))
    edited = sources.indexable(docs.withColumn("content", F.when(F.col("doc_id") % 7 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))))
    return sources.index_summary(docs, sources.changed_files(edited, stored), stored.select("workspace_id", "relative_path"))


@query("""WITH p AS (SELECT DISTINCT l_partkey AS k, l_suppkey AS s FROM lineitem)
    SELECT 'svc/Part' || k || '.cs::Load' AS source_identifier, CASE WHEN k % 5 = 0 THEN 'new.T' || s ELSE 'dbo.Supp' || s END AS target_identifier FROM p""")
def i2_replaced_evidence(spark, sf_dir):
    """The table reads after every fifth service file was read again and reads other tables."""
    reads = star_graph(spark, sf_dir).where("relationship_kind = 'reads_table'")
    path = F.regexp_extract("source_identifier", "^(.*)::", 1)
    again = reads.where(F.regexp_extract("source_identifier", r"Part(\d+)", 1).cast("long") % 5 == 0)
    changed = again.select("workspace_id", path.alias("relative_path")).distinct()
    fresh = again.withColumn("target_identifier", F.regexp_replace("target_identifier", "^dbo.Supp", "new.T"))
    return sources.replace_file_evidence(reads, changed, fresh).select("source_identifier", "target_identifier")


@query(f"""WITH d AS (SELECT source AS ws, lang, (['C# / ASP.NET','SQL / T-SQL','TypeScript','TypeScript','HTML / Angular Templates','JSON configuration','markdown','unknown'])[doc_id % 8 + 1] AS title FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL),
        t AS (SELECT ws, 'technology' AS section, title, count(*) AS n FROM d GROUP BY ws, title UNION ALL SELECT ws, 'folder', lang, count(*) FROM d GROUP BY ws, lang
            UNION ALL SELECT 'ws0', 'data', 'dbo.Supp' || l_suppkey, count(DISTINCT l_partkey) FROM lineitem GROUP BY l_suppkey UNION ALL SELECT 'ws0', 'azure', 'Service ' || o_orderpriority, count(*) FROM orders GROUP BY o_orderpriority
            UNION ALL SELECT 'ws0', 'flow', 'O / ' || o_orderkey, count(*) FROM (SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey ORDER BY 'GET /o/' || o_orderkey || ';' LIMIT 30) GROUP BY o_orderkey)
    SELECT ws AS workspace_id, section, title, n FROM t QUALIFY row_number() OVER (PARTITION BY ws, section ORDER BY n DESC, title) <= 10""")
def o1_o6_sections(spark, sf_dir):
    """Technologies and folders of ``documents`` as files; flows, data and cloud services of the star graph."""
    files = sources.indexable(_documents(spark, sf_dir).where("relative_path is not null and workspace_id is not null"))
    return inventory.overview(files, star_graph(spark, sf_dir))


@query(f"""WITH {_P}, m AS (
        SELECT ws, 'matches_backend_handler' AS relationship_kind, {_WEB} || '.service.ts::load' || k AS source_identifier, {_ACT} || '::Act' || k AS target_identifier,
               'frontendApi=' || CASE WHEN k % 20 = 11 THEN {_CALL} || '/2' ELSE {_CALL} END || ';backendApi=' || CASE WHEN k % 20 = 3 THEN replace({_API}, '/{{rev}}', '') ELSE {_API} END || ';match=' || CASE WHEN k % 4 = 1 THEN 'exact' ELSE 'template' END || ';controller=P' || k || 'Controller' AS metadata
          FROM p WHERE (k % 4 <> 3 OR k % 20 IN (3, 11)) AND k % 20 <> 1 AND k % 10 <> 2
        UNION ALL SELECT ws, 'invokes_handler', {_WEB} || '.component.html::click:go' || k, {_WEB} || CASE WHEN k % 10 = 6 THEN '.component.view.ts::go' ELSE '.component.ts::go' END || k, 'resolved=true' FROM p WHERE k % 10 <> 4)
    SELECT ws AS workspace_id, relationship_kind, source_identifier, target_identifier, metadata FROM m""")
def l1_l4_relinked(spark, sf_dir):
    """The links of the corpus after some of its files were edited, deleted and moved, from those files alone."""
    wanted = {e: f for e, f in extract.EXTRACTORS.items() if {".ts", ".html", ".cs"} & set(e)}
    files = sources.indexable(part_corpus(spark, sf_dir).where("relative_path rlike '(service.ts|component.ts|component.html|Controller.cs)$'"))
    symbols, edges = extract.evidence_tables(files, wanted)
    old = cut(link.linked(edges, symbols))
    path, k = F.col("relative_path"), F.regexp_extract("relative_path", r"(\d+)[A-Za-z.]*$", 1).cast("long")
    content = F.when(path.endswith("service.ts") & (k % 20 == 11), F.replace("content", F.lit("/1'"), F.lit("/1/2'"))).when(path.endswith("service.ts") & (k % 20 == 1), F.replace("content", F.lit("/save"), F.lit("/gone")))
    content = content.when(path.endswith("Controller.cs") & (k % 20 == 3), F.replace("content", F.lit("/{rev}"), F.lit(""))).when(path.endswith("html") & (k % 10 == 5), F.concat("content", F.lit(" ")))
    edited = files.withColumn("content", content).where("content is not null")
    moved = files.where(path.endswith("component.ts") & (k % 10 == 6))
    gone = files.where((path.endswith("component.ts") & (k % 10 == 4)) | (path.endswith("Controller.cs") & (k % 10 == 2)))
    now = edited.unionByName(moved.withColumn("relative_path", F.replace(path, F.lit(".ts"), F.lit(".view.ts"))))
    new_symbols, fresh = extract.evidence_tables(now, wanted)
    changed = cut(edited.unionByName(moved).unionByName(gone).unionByName(now).select("workspace_id", "relative_path").distinct())
    symbols = symbols.join(changed, ["workspace_id", "relative_path"], "left_anti").unionByName(new_symbols)
    kept, added = relink.relink(old, changed, fresh, symbols)
    links = kept.unionByName(added).where("relationship_kind = 'matches_backend_handler' or (relationship_kind = 'invokes_handler' and metadata = 'resolved=true')")
    return links.select("workspace_id", "relationship_kind", "source_identifier", "target_identifier", "metadata")


@query(f"""WITH {_DOCS}, f AS (SELECT * FROM d WHERE octet_length(encode(text)) <= 1048576)
    SELECT workspace_id, relative_path, change, n FROM (
        SELECT workspace_id, relative_path, 'added' AS change, CASE WHEN doc_id % 10 = 9 THEN 2 ELSE 1 END AS n FROM f
        UNION ALL SELECT workspace_id, relative_path, 'changed', 2 FROM f WHERE doc_id % 7 = 0 AND doc_id % 10 <> 9
        UNION ALL SELECT workspace_id, relative_path, 'deleted', 3 FROM f WHERE doc_id % 3 = 0)""")
def i6_listing_changes(spark, sf_dir):
    """``documents`` as three listings: nine of ten files, all with every seventh edited, then without every third. The
    stream runs once behind each: every micro-batch looks through all paths for those that are gone, so that their number
    must not grow with the files."""
    docs = _documents(spark, sf_dir).where("workspace_id is not null and relative_path is not null and content is not null")
    edited = F.when((F.col("doc_id") % 7 == 0) & (F.col("n") > 1), F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    folder, rows = shared_folder(spark, "listings"), docs.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).where("not (n = 1 and doc_id % 10 = 9) and not (n = 3 and doc_id % 3 = 0)")
    at = F.timestamp_seconds(F.col("n") * 86_400 + 1_700_000_000).alias("listed_at")
    rows = cut(rows.select("workspace_id", "relative_path", edited.alias("content"), "size_bytes", at, "n"))
    for n in (1, 2, 3):
        rows.where(F.col("n") == n).drop("n").write.mode("append").parquet(f"{folder}/in")
        end = spark.range(1).select(*[F.lit(None).cast(t).alias(c) for c, t in rows.dtypes[:4]], F.timestamp_seconds(F.lit(n * 86_400 + 1_700_000_000)).alias("listed_at"))
        end.write.mode("append").parquet(f"{folder}/in")
        arriving = spark.readStream.schema(rows.drop("n").schema).parquet(f"{folder}/in")
        listings.index_listings(arriving, f"{folder}/index", f"{folder}/checkpoint").awaitTermination()
    found = listings.changes_of(spark, f"{folder}/index")
    return found.select("workspace_id", "relative_path", "change", ((F.unix_seconds("listed_at") - 1_700_000_000) / 86_400).cast("int").alias("n"))


@query(f"""WITH {_DOCS} SELECT CASE doc_id % 9 WHEN 1 THEN 'gen/' || workspace_id || '/' || relative_path || '.min.js' ELSE workspace_id || '/' || relative_path END AS relative_path, octet_length(encode(text)) AS size_bytes,
       doc_id % 9 = 1 OR octet_length(encode(text)) > 1048576 AS skipped, CASE WHEN doc_id % 9 <> 1 AND octet_length(encode(text)) <= 1048576 THEN sha256(text) END AS sha256 FROM d WHERE doc_id % 9 <> 0""")
def s1_scanned_tree(spark, sf_dir):
    """``documents`` as files of a folder tree, scanned: every ninth in an excluded folder, every ninth generated."""
    docs = _documents(spark, sf_dir).where("workspace_id is not null and relative_path is not null and content is not null")
    path = F.concat("workspace_id", F.lit("/"), "relative_path")
    path = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("web/node_modules/"), path)).when(F.col("doc_id") % 9 == 1, F.concat(F.lit("gen/"), path, F.lit(".min.js"))).otherwise(path)
    root = shared_folder(spark, "tree")
    tree.write_tree(docs.select(path.alias("relative_path"), "content").repartition("relative_path"), root)
    return tree.scan_tree(spark, root, "docs").select("relative_path", "size_bytes", "skipped", F.sha2("content", 256).alias("sha256"))
