"""Listing, search, summary, overview and browsing over evidence tables. Limits hold per workspace."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import after_path, flow_name, language_title, member_name, metadata_value, top_level_folder

BACKEND_KINDS = ("depends_on", "implemented_by", "calls_method", "executes_procedure", "reads_table", "writes_table", "saves_changes")
BACKEND_SURFACE = ("calls_method", "executes_procedure", "reads_table", "writes_table", "saves_changes", "handled_by", "calls_api", "invokes_handler", "matches_backend_handler", "implemented_by", "depends_on", "contains_symbol", "renders_component", "navigates_to")
DATA_KINDS = ("reads_table", "writes_table", "executes_procedure")
_TEST_PATH = r"(?i)[\\/]tests?[\\/]|\.tests[\\/]"


def exclude_test_relationships(relationships: DataFrame) -> DataFrame:
    """N1."""
    return relationships.where(~F.col("source_identifier").rlike(_TEST_PATH) & ~F.col("target_identifier").rlike(_TEST_PATH))


def exclude_test_files(rows: DataFrame) -> DataFrame:
    """N2."""
    return rows.where(~F.col("relative_path").rlike(_TEST_PATH))


def has(column: str | Column, text: str | None) -> Column:
    """Contains, in any case and literally; a blank text holds for all."""
    if not (text or "").strip():
        return F.lit(True)
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.lower(column).contains(text.lower()), F.lit(False))


def relationship_filters(relationships: DataFrame, search: str | None = None, kind: str | None = None, source: str | None = None, target: str | None = None) -> DataFrame:
    """N3."""
    anywhere = has("source_identifier", search) | has("target_identifier", search) | has("relationship_kind", search)
    return relationships.where(anywhere & has("relationship_kind", kind) & has("source_identifier", source) & has("target_identifier", target))


def take(rows: DataFrame, n: int | None, *order: str | Column, by: tuple[str, ...] = ("workspace_id",)) -> DataFrame:
    """The first ``n`` rows of each workspace; all of them, unsorted, where ``n`` is None."""
    if n is None:
        return rows
    return rows.withColumn("n_", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("n_") <= n).drop("n_")


def workspace_status(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Q1: live files and their symbols per workspace."""
    live = files.where("not is_deleted") if "is_deleted" in files.columns else files
    counted = symbols.join(live.select("workspace_id", "relative_path"), ["workspace_id", "relative_path"], "left_semi").groupBy("workspace_id").agg(F.count("*").alias("symbol_count"))
    return live.groupBy("workspace_id").agg(F.count("*").alias("file_count")).join(counted, "workspace_id", "left").select("workspace_id", "file_count", F.coalesce("symbol_count", F.lit(0)).alias("symbol_count"))


def list_files(files: DataFrame, language: str | None = None, folder: str | None = None, limit: int = 200) -> DataFrame:
    """Q2."""
    path = F.col("relative_path")
    if language:
        files = files.where(F.col("language_id") == language)
    if folder == "(root)":
        files = files.where(~path.rlike(r"[/\\]"))
    elif folder:
        files = files.where(path.startswith(f"{folder}/") | path.contains(f"/{folder}/"))
    return take(files, limit, "relative_path")


def search_symbols(symbols: DataFrame, text: str | None = None, limit: int = 200) -> DataFrame:
    """Q3."""
    found = take(symbols.where(has("name", text)), limit, "name", "relative_path", "line", "kind")
    return found.select("workspace_id", "kind", "name", F.concat("relative_path", F.lit(":"), F.col("line").cast("string")).alias("location"))


def search_relationships(relationships: DataFrame, limit: int = 50, **filters: str | None) -> DataFrame:
    """Q4."""
    found = relationship_filters(exclude_test_relationships(relationships), **filters)
    return take(found, limit, "source_identifier", "relationship_kind", "target_identifier", "metadata")


def list_apis(relationships: DataFrame, verb: str | None = None, route: str | None = None, controller: str | None = None, limit: int = 50) -> DataFrame:
    """Q7."""
    found = exclude_test_relationships(relationships.where("relationship_kind = 'handles_api'"))
    found = found.where(has("target_identifier", route) & (has("source_identifier", controller) | has("metadata", controller)))
    if verb:
        found = found.where(F.lower("target_identifier").startswith(f"{verb.lower()} "))
    return take(found, limit, "target_identifier", "source_identifier").select("workspace_id", F.col("target_identifier").alias("api"), F.col("source_identifier").alias("handler"), "metadata")


def list_azure_services(relationships: DataFrame, service: str | None = None, limit: int = 50) -> DataFrame:
    """Q8."""
    found = exclude_test_relationships(relationships.where("relationship_kind = 'uses_azure_service'")).where(has("target_identifier", service))
    grouped = found.groupBy("workspace_id", F.col("target_identifier").alias("service"), F.col("source_identifier").alias("source")).agg(F.count("*").alias("n"))
    return take(grouped, limit, "service", "source")


def list_flows(relationships: DataFrame, api: str | None = None, source: str | None = None, handler: str | None = None, limit: int | None = 50) -> DataFrame:
    """Q16."""
    found = exclude_test_relationships(relationships.where("relationship_kind = 'matches_backend_handler'")).where(has("metadata", api) & has("source_identifier", source) & has("target_identifier", handler))
    return take(found, limit, "source_identifier", "target_identifier", "metadata").select("workspace_id", F.col("source_identifier").alias("frontend"), F.col("target_identifier").alias("handler"), metadata_value(F.col("metadata"), "match").alias("match"), "metadata")


def backend_listing(relationships: DataFrame, kind: str | None = None, limit: int = 50) -> DataFrame:
    """Q17: each kind in its fixed order and limited, then distinct, then limited."""
    kinds = (kind,) if kind else BACKEND_KINDS
    place = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("relationship_kind"))
    rows = exclude_test_relationships(relationships.where(F.col("relationship_kind").isin(*kinds))).withColumn("place", place)
    each = take(rows, limit, "source_identifier", "target_identifier", "metadata", by=("workspace_id", "relationship_kind"))
    unique = each.groupBy("workspace_id", "place", "relationship_kind", "source_identifier", "target_identifier").agg(F.min("metadata").alias("metadata"))
    return take(unique, limit, "place", "source_identifier", "target_identifier").drop("place")


def occurrences(rows: DataFrame) -> DataFrame:
    """U4: which of how many rows of its occurrence key a row is."""
    same = Window.partitionBy("workspace_id", "occurrence_key")
    order = same.orderBy("source_identifier", "relationship_kind", "target_identifier")
    return rows.withColumn("occurrence", F.row_number().over(order)).withColumn("occurrence_count", F.count("*").over(same))


def evidence_quality(rows: DataFrame) -> DataFrame:
    """U3."""
    inferred = F.col("relationship_kind").isin("matches_backend_handler", "implemented_by", "depends_on", "navigates_to")
    located = F.col("file_path").isNotNull() | F.col("line").isNotNull()
    return rows.withColumn("quality", F.when(inferred, "inferred-link").when(located, "with-location").otherwise("source-backed"))


def facet_values(relationships: DataFrame) -> DataFrame:
    """The distinct relationship, source and target kinds."""
    facets = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in ("relationship_kind", "source_kind", "target_kind")])
    return relationships.select("workspace_id", F.explode(facets).alias("f")).select("workspace_id", "f.*").distinct()


def related_evidence(relationships: DataFrame, selected: DataFrame, limit: int = 6) -> DataFrame:
    """Q12 and Q13: for each of ``selected(sel_id, workspace_id, source_identifier, target_identifier)`` its outgoing,
    incoming, same-dependency and same-file evidence, each limited; a row shows once per selection, in the first group.

    Candidates meet on exploded keys (identifier, member, path), so each group is an equi-join.
    """
    rows = exclude_test_relationships(relationships).select("workspace_id", F.col("source_identifier").alias("s"), F.col("relationship_kind").alias("kind"), F.col("target_identifier").alias("t")).distinct()
    suffix = lambda c: F.when(c.contains("::"), F.concat(F.lit("::"), after_path(c)))
    member = lambda c: F.concat(F.lit("::"), member_name(c))
    exact = lambda c: F.concat(F.lit("="), c)
    path = lambda c: F.when(c.contains("::"), F.concat(F.lit("/"), F.regexp_extract(c, r"^(.*)::", 1)))
    sides = rows.withColumn("s_keys", F.array(exact(F.col("s")), suffix(F.col("s")), path(F.col("s")))).withColumn("t_keys", F.array(exact(F.col("t")), suffix(F.col("t"))))
    a, b = F.col("source_identifier"), F.col("target_identifier")
    wanted = F.array(
        *[F.struct(F.lit(g).alias("group_no"), F.lit(side).alias("side"), k.alias("key")) for g, side, k in (
            (1, "s", exact(a)), (1, "s", exact(b)), (1, "s", member(a)),
            (2, "t", exact(a)), (2, "t", exact(b)), (2, "t", member(a)), (2, "t", member(b)),
            (3, "t", exact(b)), (3, "s", exact(b)), (3, "t", member(b)),
            (4, "s", path(a)),
        )]
    )
    keys = selected.select("sel_id", "workspace_id", "source_identifier", "target_identifier", F.explode(wanted).alias("w")).select("sel_id", "workspace_id", "source_identifier", "target_identifier", "w.*").where("key is not null").distinct()
    by_key = sides.select("workspace_id", "s", "kind", "t", F.explode(F.concat(F.transform("s_keys", lambda k: F.struct(F.lit("s").alias("side"), k.alias("key"))), F.transform("t_keys", lambda k: F.struct(F.lit("t").alias("side"), k.alias("key"))))).alias("k")).select("workspace_id", "s", "kind", "t", "k.*").where("key is not null")
    found = keys.join(by_key, ["workspace_id", "side", "key"]).where(~((F.col("s") == a) & (F.col("t") == b))).select("sel_id", "workspace_id", "group_no", "s", "kind", "t").distinct()
    limited = take(found, limit, "s", "kind", "t", by=("sel_id", "group_no"))
    first = Window.partitionBy("sel_id", "s", "kind", "t").orderBy("group_no")
    names = F.element_at(F.array(*[F.lit(x) for x in ("Outgoing", "Incoming", "Same dependency", "Same file")]), F.col("group_no"))
    return limited.withColumn("n_", F.row_number().over(first)).where("n_ = 1").select("sel_id", names.alias("group_label"), F.col("s").alias("source_identifier"), F.col("kind").alias("relationship_kind"), F.col("t").alias("target_identifier"))


def _top(rows: DataFrame, section: str, key: Column, limit: int) -> DataFrame:
    counted = rows.groupBy("workspace_id", key.alias("title")).agg(F.count("*").alias("n"))
    return take(counted, limit, F.col("n").desc(), "title").select("workspace_id", F.lit(section).alias("section"), "title", "n")


def workspace_summary(files: DataFrame, symbols: DataFrame, relationships: DataFrame, limit: int = 10) -> DataFrame:
    """Q19: totals and the most frequent languages, symbol kinds, relationship kinds and cloud services."""
    files, symbols, relationships = exclude_test_files(files), exclude_test_files(symbols), exclude_test_relationships(relationships)
    total = lambda rows, name: rows.groupBy("workspace_id").agg(F.count("*").alias("n")).select("workspace_id", F.lit("total").alias("section"), F.lit(name).alias("title"), "n")
    parts = [
        total(files, "files"), total(symbols, "symbols"), total(relationships, "relationships"),
        _top(files, "language", F.col("language_id"), limit), _top(symbols, "symbol", F.col("kind"), limit), _top(relationships, "relationship", F.col("relationship_kind"), limit),
        _top(relationships.where("relationship_kind = 'uses_azure_service'"), "azure", F.col("target_identifier"), limit),
    ]
    return reduce(DataFrame.unionByName, parts)


def overview(files: DataFrame, relationships: DataFrame, limit: int = 10) -> DataFrame:
    """``(workspace_id, section, title, n)`` of technologies, folders, APIs, flows, data and cloud services."""
    relationships = exclude_test_relationships(relationships)
    folder = top_level_folder(F.col("relative_path"))
    folders = files.groupBy("workspace_id", F.lower(folder).alias("k")).agg(F.min(folder).alias("title"), F.count("*").alias("n"))
    folders = take(folders, limit, F.col("n").desc(), "title").select("workspace_id", F.lit("folder").alias("section"), "title", "n")
    apis = relationships.where("relationship_kind = 'handles_api'").groupBy("workspace_id", F.col("target_identifier").alias("title"), "source_identifier").agg(F.count("*").alias("n"))
    apis = take(apis, limit, "title", "source_identifier").select("workspace_id", F.lit("api").alias("section"), "title", "n")
    matches = take(relationships.where("relationship_kind = 'matches_backend_handler'"), 3 * limit, "metadata", "source_identifier", "target_identifier")
    flows = matches.groupBy("workspace_id", F.lower(flow_name(F.col("metadata"))).alias("k")).agg(F.min(flow_name(F.col("metadata"))).alias("title"), F.count("*").alias("n"))
    flows = take(flows, limit, F.col("n").desc(), "title").select("workspace_id", F.lit("flow").alias("section"), "title", "n")
    data = relationships.where(F.col("relationship_kind").isin(*DATA_KINDS)).groupBy("workspace_id", "target_kind", F.col("target_identifier").alias("title")).agg(F.count("*").alias("n"))
    data = take(data, limit, F.col("n").desc(), "title", "target_kind").select("workspace_id", F.lit("data").alias("section"), "title", "n")
    azure = _top(relationships.where("relationship_kind = 'uses_azure_service'"), "azure", F.col("target_identifier"), limit)
    technology = _top(files, "technology", language_title(F.col("language_id")), limit)
    return reduce(DataFrame.unionByName, [technology, folders, apis, flows, data, azure])


def trace_entries(relationships: DataFrame, limit: int = 1000) -> DataFrame:
    """Q20: APIs that are handled, then methods, each once in any case."""
    apis = relationships.where("relationship_kind = 'handled_by' and source_kind = 'api'").select("workspace_id", F.lit(1).alias("section"), F.col("source_identifier").alias("entry"))
    methods = relationships.where("relationship_kind = 'contains_symbol' and source_kind = 'symbol' and target_kind = 'method'").select("workspace_id", F.lit(2).alias("section"), F.col("target_identifier").alias("entry"))
    first = Window.partitionBy("workspace_id", F.lower("entry")).orderBy("section", "entry")
    unique = apis.unionByName(methods).withColumn("n_", F.row_number().over(first)).where("n_ = 1").drop("n_")
    return take(unique, limit, "section", "entry")


def explorer_files(files: DataFrame, text: str | None = None, limit: int = 200) -> DataFrame:
    """Q9: files whose path, language or status contains ``text``."""
    found = exclude_test_files(files).where(has("relative_path", text) | has("language_id", text) | has("parse_status", text))
    return take(found, limit, "relative_path").select("workspace_id", F.col("relative_path").alias("title"), F.concat_ws(" ", "language_id", "parse_status").alias("subtitle"), F.col("relative_path").alias("file_path"), top_level_folder(F.col("relative_path")).alias("folder"))


def lookup_evidence(listed: DataFrame, relationships: DataFrame, selected: DataFrame, key: tuple[str, ...] = ("workspace_id", "source_identifier", "relationship_kind", "target_identifier")) -> DataFrame:
    """Q11: selected rows that the listing lacks, in front of it (``place`` 0, the listing's rows 1)."""
    picked = relationships.join(selected.select(*key).distinct(), list(key), "left_semi").join(listed.select(*key).distinct(), list(key), "left_anti")
    return picked.select(listed.columns).withColumn("place", F.lit(0)).unionByName(listed.withColumn("place", F.lit(1)))


def starting_points(sections: DataFrame) -> DataFrame:
    """Of ``overview`` the sections flow, api, data, azure and folder, with the sum of their scores."""
    wanted = sections.where("section in ('flow', 'api', 'data', 'azure', 'folder')")
    return wanted.groupBy("workspace_id", "section").agg(F.sum("n").alias("score"))


def overview_totals(sections: DataFrame) -> DataFrame:
    """Per workspace the first four technologies and the number of listed APIs, flows, data and cloud services."""
    technology = F.array_sort(F.collect_list(F.when(F.col("section") == "technology", F.struct((-F.col("n")).alias("n"), "title"))))
    size = lambda s: F.count_if(F.col("section") == s).alias(f"n_{s}")
    return sections.groupBy("workspace_id").agg(F.array_join(F.transform(F.slice(technology, 1, 4), lambda x: x["title"]), ", ").alias("technologies"), size("api"), size("flow"), size("data"), size("azure"))
