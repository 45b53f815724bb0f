"""Source files: scan, filters, fingerprint, evidence tables on disk and incremental re-indexing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import LANGUAGE_BY_EXTENSION, extension, lookup
from ..plans.containment import GRAMS, gram_size, grams, grams_of
from ..plans.materialise import cut

# Directories left out, the size limit and the fingerprint's versions.
EXCLUDED_DIRECTORIES = (".git", ".vs", ".idea", "bin", "obj", "node_modules", "dist", "build", ".next", "coverage", "packages")
MAX_BYTES = 1024 * 1024
FINGERPRINT_VERSIONS = {"csharp": "csharp-analysis-v2"}
DEFAULT_VERSION = "analysis-v1"


def scan_source_files(spark: SparkSession, root: str, workspace_id: str) -> DataFrame:
    """Every file below ``root`` as ``source_files`` rows; files that vanish meanwhile are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(root)
    scheme = r"^[a-z0-9]+:/*"
    path = F.regexp_replace(F.col("path"), scheme, "/")
    relative = F.expr("substring(p, length(r) + 2)")
    return files.withColumn("p", path).withColumn("r", F.regexp_replace(F.regexp_replace(F.lit(root.rstrip("/")), scheme, "/"), "^/+", "/")).select(
        F.lit(workspace_id).alias("workspace_id"), relative.alias("relative_path"), F.decode("content", "UTF-8").alias("content"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("last_write")
    )


def directories(path: Column) -> Column:
    """The directory names of a path, outermost first."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def exclude_directories(files: DataFrame) -> DataFrame:
    """Drops files below an excluded directory (its name in any case)."""
    return files.where(~F.exists(directories(F.col("relative_path")), lambda d: F.lower(d).isin(*EXCLUDED_DIRECTORIES)))


def _rule_pattern(rule: Column) -> Column:
    """A regular expression of a rule's text: ``*`` crosses slashes, ``?`` is one character, the rest is literal."""
    literal = F.regexp_replace(rule, r"([\\.\[\]{}()+^$|])", r"\\$1")
    return F.regexp_replace(F.regexp_replace(literal, r"\*", ".*"), r"\?", ".")


#: Wildcard rules are looked up by at least this many characters of their longest literal part; shorter ones are tried on
#: all paths.
RULE_GRAM = 3


def _clean_rules(rules: DataFrame) -> DataFrame:
    clean = F.translate(F.trim("rule"), "\\", "/")
    rules = rules.select("workspace_id", clean.alias("rule")).where("rule <> '' and not startswith(rule, '#')").distinct()
    rules = rules.withColumn("dirs_only", F.col("rule").endswith("/")).withColumn("anchored", F.col("rule").startswith("/"))
    return rules.withColumn("body", F.lower(F.regexp_replace("rule", "^/|/$", ""))).withColumn("wild", F.col("body").rlike("[*?]")).where("body <> ''")


def _ways(path: Column) -> Column:
    """What rules may be held against of a path: itself and each directory above it, whole and by its last name."""
    parts = F.split(path, "/")

    def one(part: Column, i: Column) -> Column:
        prefix = F.array_join(F.slice(parts, F.lit(1), i + 1), "/")
        return F.array(F.struct(prefix.alias("text"), F.lit(True).alias("whole"), (i < F.size(parts) - 1).alias("is_dir")), F.struct(part.alias("text"), (i == 0).alias("whole"), (i < F.size(parts) - 1).alias("is_dir")))

    return F.array_distinct(F.flatten(F.transform(parts, one)))


def rules_met(indexed: DataFrame, texts: DataFrame) -> DataFrame:
    """``indexed(workspace_id, pattern, literal, size, dirs_only, anchored)`` with each ``texts(workspace_id, text)`` that has
    the one of a rule's grams that the fewest texts have. Grams are as long as the literal allows: of numbered names,
    short ones recur in more texts the more texts there are."""
    rule = ["workspace_id", "pattern", "dirs_only", "anchored"]
    sizes = [r[0] for r in indexed.select("size").distinct().collect()]
    per_gram = indexed.select(*rule, F.explode(grams("literal", F.col("size"))).alias("gram"))
    texts = texts.select("workspace_id", "text", F.explode(grams_of("text", sizes)).alias("gram"))
    texts = texts.join(per_gram.select("workspace_id", "gram").distinct(), ["workspace_id", "gram"], "left_semi")
    counts = texts.groupBy("workspace_id", "gram").agg(F.count("*").alias("n"))
    rarest = per_gram.join(counts, ["workspace_id", "gram"], "left").groupBy(*rule).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).where("r.n > 0")
    return rarest.select(*rule, "r.gram").join(texts, ["workspace_id", "gram"])


def apply_ignore_rules(files: DataFrame, rules: DataFrame) -> DataFrame:
    """S3: drops files that a rule of their workspace's ``rules(workspace_id, rule)`` matches, or below such a directory.

    Blank and ``#`` lines are no rules. A rule ending in ``/`` is for directories only, a leading ``/`` anchors it at
    the root; another rule also matches a base name, or a path below it. Case does not count; there is no negation.

    Rules without wildcards meet paths, their directories and names by equality. Of the wildcard rules, those of one
    workspace with the same rarest literal gram are tried together, on the names and paths that have that gram; only
    rules without three literal characters in a row are tried on every path of their workspace.
    """
    rules = _clean_rules(rules)
    paths = files.select("workspace_id", "relative_path").distinct()
    tried = paths.select("workspace_id", "relative_path", F.explode(_ways(F.lower(F.translate("relative_path", "\\", "/")))).alias("w")).select("workspace_id", "relative_path", "w.*")
    fits = (~F.col("dirs_only") | F.col("is_dir")) & (~F.col("anchored") | F.col("whole"))
    exact = tried.join(rules.where("not wild").select("workspace_id", F.col("body").alias("text"), "dirs_only", "anchored"), ["workspace_id", "text"]).where(fits)

    literal = F.array_max(F.transform(F.split("body", "[*?]+"), lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    wild = rules.where("wild").withColumn("literal", literal).withColumn("pattern", F.concat(F.lit("(?s)^"), _rule_pattern(F.col("body")), F.lit("$")))
    wild = cut(wild.withColumn("size", gram_size("literal", tuple(n for n in GRAMS if n >= RULE_GRAM))))
    open_rules = wild.where("size = 0")
    met = rules_met(wild.where("size > 0"), tried.select("workspace_id", "text").distinct()).where(F.expr("text rlike pattern")).select("workspace_id", "text", "dirs_only", "anchored").distinct()
    by_gram = tried.join(met, ["workspace_id", "text"]).where(fits)
    by_any = tried.join(open_rules.select("workspace_id", "pattern", "dirs_only", "anchored"), "workspace_id").where(fits & F.expr("text rlike pattern"))
    hit = exact.select("workspace_id", "relative_path").unionByName(by_gram.select("workspace_id", "relative_path")).unionByName(by_any.select("workspace_id", "relative_path"))
    return files.join(hit.distinct(), ["workspace_id", "relative_path"], "left_anti")


def mark_skipped(files: DataFrame) -> DataFrame:
    """``skipped`` for files over the size limit and generated ones; they still count as seen."""
    generated = F.lower("relative_path").rlike(r"\.g\.cs$|\.designer\.cs$|\.min\.js$")
    return files.withColumn("skipped", (F.col("size_bytes") > MAX_BYTES) | generated)


def detect_language(path: Column) -> Column:
    """S5."""
    return lookup(LANGUAGE_BY_EXTENSION, extension(path), F.lit("unknown"))


def fingerprint(language: Column, content: Column) -> Column:
    """The analysis version of a language, and the content's SHA-256 in upper-case hex."""
    version = lookup(FINGERPRINT_VERSIONS, language, F.lit(DEFAULT_VERSION))
    return F.concat(version, F.lit(":"), F.upper(F.sha2(content.cast("binary"), 256)))


def indexable(files: DataFrame) -> DataFrame:
    """Files to analyse, with language, fingerprint and whether an extractor takes them."""
    kept = mark_skipped(exclude_directories(files)).where("not skipped").drop("skipped")
    kept = kept.withColumn("language_id", detect_language(F.col("relative_path")))
    kept = kept.withColumn("content_hash", fingerprint(F.col("language_id"), F.col("content")))
    supported = extension(F.col("relative_path")).isin(".cs", ".sql", ".tsql", ".ts", ".tsx", ".js", ".jsx", ".html")
    status = F.when(~supported, "not-supported").when(F.col("content").isNull(), "error").otherwise("parsed")
    return kept.withColumn("parse_status", status)


def write_evidence(table: DataFrame, path: str, keys: list[str]) -> None:
    """One row per key, partitioned by workspace. Only the partitions of ``table``'s workspaces are replaced."""
    first = Window.partitionBy("workspace_id", *keys).orderBy(*[c for c in table.columns if c not in keys])
    unique = table.withColumn("n_", F.row_number().over(first)).where("n_ = 1").drop("n_")
    unique.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("workspace_id").parquet(path)


def read_evidence(spark: SparkSession, path: str, workspace_id: str | None = None) -> DataFrame:
    """An evidence table; a workspace is read from its partition alone, deleted files are left out."""
    table = spark.read.parquet(path)
    if workspace_id is not None:
        table = table.where(F.col("workspace_id") == workspace_id)
    return table.where("not is_deleted") if "is_deleted" in table.columns else table


def changed_files(seen: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of ``seen`` that are new, differ in fingerprint, or were deleted before (paths in any case)."""
    old = stored.select(F.col("workspace_id").alias("w_"), F.lower("relative_path").alias("p_"), F.col("content_hash").alias("h_"), F.col("is_deleted").alias("d_"))
    joined = seen.join(old, (seen.workspace_id == F.col("w_")) & (F.lower(seen.relative_path) == F.col("p_")), "left")
    return joined.where("p_ is null or d_ or not (h_ <=> content_hash)").drop("w_", "p_", "h_", "d_")


def replace_file_evidence(relationships: DataFrame, changed: DataFrame, fresh: DataFrame, keep_incoming: bool = False) -> DataFrame:
    """The relationships after re-indexing ``changed(workspace_id, relative_path)``.

    Edges from or, unless ``keep_incoming``, into a changed file go; ``fresh`` comes in.
    """
    paths = changed.select("workspace_id", F.col("relative_path").alias("f_")).distinct()
    ends = ("source_identifier",) if keep_incoming else ("source_identifier", "target_identifier")
    kept = relationships
    for end in ends:
        owner = F.regexp_replace(F.col(end), "(?s)::.*$", "")
        kept = kept.withColumn("f_", owner).join(paths, ["workspace_id", "f_"], "left_anti").drop("f_")
    return kept.unionByName(fresh)


def soft_delete_missing(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """``stored`` with ``is_deleted`` set for files that are no longer seen."""
    here = seen.select(F.col("workspace_id").alias("w_"), F.lower("relative_path").alias("p_")).distinct()
    joined = stored.join(here, (stored.workspace_id == F.col("w_")) & (F.lower(stored.relative_path) == F.col("p_")), "left")
    return joined.withColumn("is_deleted", F.col("is_deleted") | F.col("p_").isNull()).drop("w_", "p_")


def without_deleted(relationships: DataFrame, files: DataFrame) -> DataFrame:
    """The relationships left when those from or into files with ``is_deleted`` are removed."""
    gone = files.where("is_deleted")
    return replace_file_evidence(relationships, gone, relationships.limit(0))


def index_summary(files: DataFrame, changed: DataFrame, symbols: DataFrame) -> DataFrame:
    """Per workspace, files scanned, indexed and skipped, and symbols of changed files."""
    scanned = mark_skipped(exclude_directories(files)).groupBy("workspace_id").agg(F.count("*").alias("files_scanned"), F.count_if("skipped").alias("files_skipped"))
    indexed = changed.groupBy("workspace_id").agg(F.count("*").alias("files_indexed"))
    new = symbols.join(changed.select("workspace_id", "relative_path").distinct(), ["workspace_id", "relative_path"], "left_semi").groupBy("workspace_id").agg(F.count("*").alias("symbols_indexed"))
    out = scanned.join(indexed, "workspace_id", "left").join(new, "workspace_id", "left")
    return out.select("workspace_id", "files_scanned", F.coalesce("files_indexed", F.lit(0)).alias("files_indexed"), "files_skipped", F.coalesce("symbols_indexed", F.lit(0)).alias("symbols_indexed"))
