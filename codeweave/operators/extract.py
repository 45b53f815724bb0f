"""Evidence extraction: source text to symbols and relationships, as set operations over lines.

Every extractor takes ``source_files`` rows and returns ``(symbols, relationships)`` with identifiers as written in
the file; ``normalise`` qualifies them. Relationship rows carry ``line`` and ``col`` as their order of discovery.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import base_name, extension, qualify
from ..functions.tokens import CLOSE, DOT, NAME, OPEN, QUOTED, TYPE_ARGUMENTS, any_of, apart, either, keep, line, maybe, seq
from ..plans.materialise import cut
from .statements import cs_statements, place, sql_code, with_block

FILE = ("workspace_id", "relative_path")
SYMBOL = (*FILE, "name", "kind", "container", "line", "col")
EDGE = (*FILE, "source_kind", "source", "relationship_kind", "target_kind", "target", "metadata", "line", "col")
Extractor = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def explode_lines(files: DataFrame) -> DataFrame:
    """One row per line, from 1, in order."""
    return files.select(*FILE, F.posexplode(F.split("content", "\r?\n")).alias("pos", "text")).select(*FILE, (F.col("pos") + 1).alias("line"), "text")


def group(text: str | Column, pattern: str, i: int = 1) -> Column:
    """A group of the first match, or null."""
    found = F.regexp_extract(text, pattern, i)
    return F.when(found != "", found)


def every(text: str, pattern: str, *names: str) -> Column:
    """An array of structs of groups 1, 2, ... of all matches; unmatched groups are empty strings."""
    arrays = [F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(i + 1)).alias(n) for i, n in enumerate(names)]
    return F.arrays_zip(*arrays)


def holding(df: DataFrame, text: str, *marks: str) -> DataFrame:
    """Rows whose text holds all of some marks without which a pattern can't match: most hold none, and a look for plain
    characters costs far less than a pattern for each of its groups."""
    return df.where(reduce(Column.__and__, [F.col(text).contains(m) for m in marks]))


def edge(df: DataFrame, source_kind, source, kind: str | Column, target_kind, target, metadata=None) -> DataFrame:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    col = F.col("col") if "col" in df.columns else F.lit(0)
    return df.select(
        *FILE, as_column(source_kind).alias("source_kind"), as_column(source).alias("source"), F.lit(kind).alias("relationship_kind"), as_column(target_kind).alias("target_kind"),
        as_column(target).alias("target"), (as_column(metadata) if metadata is not None else F.lit(None)).cast("string").alias("metadata"), "line", col.cast("int").alias("col"),
    )


def symbol(df: DataFrame, name, kind, container=None) -> DataFrame:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    col = F.length(F.regexp_extract("text", r"^\s*", 0)) + 1
    return df.select(*FILE, as_column(name).alias("name"), as_column(kind).alias("kind"), (as_column(container) if container is not None else F.lit(None)).cast("string").alias("container"), "line", col.cast("int").alias("col"))


def _global(name: Column) -> Column:
    return F.concat(F.lit("global::"), name)


def _line_note() -> Column:
    return F.concat(F.lit("line="), F.col("line").cast("string"))


# --- JavaScript and TypeScript -------------------------------------------------------------------------------------

# Words that declare, receivers and members that requests, moves and ordinary calls are told by.
_TS_WORDS = ("class", "interface", "function", "const", "let", "var", "type")
_TS_NOT_METHODS = ("if", "for", "foreach", "while", "switch", "catch")
_TS_CLIENTS = ("http", "httpClient", "client")
_TS_VERBS = ("get", "post", "put", "patch", "delete")
_TS_MOVERS = ("router", "history", "navigate", "navigation")
_TS_MOVES = ("navigate", "navigateByUrl", "push", "replace")
_TS_NOT_RECEIVERS = (*_TS_CLIENTS, "axios", "console", "Math", "JSON", "Object", "Array")
_TS_NOT_MEMBERS = (*_TS_VERBS, "log", "map", "filter", "reduce", "subscribe", *_TS_MOVES)
_TS_EVENTS = ("Click", "Submit", "Change", "Blur", "Focus")
_TS_NO_SCOPE = ("const", "let", "var", "constant", "type-alias")

_EXPORTED = maybe(r"export\b") + maybe(r"default\b")
_PARAMETERS = seq(OPEN, "[^)]*", CLOSE)
_TS_NAMED = line(_EXPORTED + apart(keep(any_of(*_TS_WORDS)), keep(NAME)))
_TS_ASYNC = line(_EXPORTED + apart("async", "function", keep(NAME)))
_TS_ARROW = line(keep(NAME), "[=:]", maybe(r"async\b") + _PARAMETERS, "=>")
_TS_METHOD = line(maybe(any_of("public", "protected", "private")) + maybe(r"async\b") + keep(NAME), _PARAMETERS, maybe(":", "[^;{]+") + "[;{]?", r"\}?", "$")
_TS_REQUEST = r"(?i)(?<![\w$])" + either(seq(any_of(*_TS_CLIENTS, "axios"), DOT, keep(any_of(*_TS_VERBS)), maybe(TYPE_ARGUMENTS)), r"fetch\s*") + seq(OPEN, "([^),]+)")
_TS_NAVIGATE = r"(?<![\w$])" + either(seq(any_of(*_TS_MOVERS), DOT, any_of(*_TS_MOVES)), r"(?<!\.)navigate") + seq("", OPEN, r"\[?", "([^)\\],]+)")
_TS_CALL = r"(?<![\w$])" + seq(keep(NAME), DOT, keep(NAME), OPEN)
_TS_EVENT = r"\bon" + seq(keep(any_of(*_TS_EVENTS)), "=", r"\{", keep(NAME), r"\}")
_TS_ANGULAR = r"\b" + seq("path", ":", QUOTED) + r"[^{}]*?\b" + seq("component", ":", keep(NAME))
_TS_REACT = r"<Route\b[^>]*?\b" + seq("path", "=", QUOTED) + "[^>]*?" + either(seq("element", "=", r"\{", "<"), seq("component", "=", r"\{")) + r"\s*" + keep(NAME)


def ts_declarations(lines: DataFrame) -> DataFrame:
    """Lines with ``name`` and ``kind`` of what they declare, and the enclosing ``scope``."""
    word, named = group("text", _TS_NAMED), group("text", _TS_NAMED, 2)
    other = F.coalesce(group("text", _TS_ASYNC), group("text", _TS_ARROW))
    method = group("text", _TS_METHOD)
    method = F.when(~method.isin(*_TS_NOT_METHODS), method)
    component = extension(F.col("relative_path")).isin(".tsx", ".jsx")
    capital = named.rlike("^[A-Z]")
    of_word = F.when(word.isin("const", "let", "var") & capital, F.when(component, "react-component").otherwise("constant")).when(word == "type", "type-alias").otherwise(word)
    lines = lines.withColumn("name", F.coalesce(named, other, method))
    lines = lines.withColumn("kind", F.when(named.isNotNull(), of_word).when(other.isNotNull(), "function").when(method.isNotNull(), "method"))
    scope = F.when(~F.col("kind").isin(*_TS_NO_SCOPE), F.col("name"))
    so_far = Window.partitionBy(*FILE).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("scope", F.coalesce(F.last(scope, ignorenulls=True).over(so_far), base_name(F.col("relative_path"))))


def _simple(known: Column, part: Column) -> Column:
    """X10 of one operand: a literal's text, a template with its constants filled in, or a constant's value."""
    part = F.trim(part)
    quoted = part.rlike(r"^(['\"]).*\1$")
    template = part.rlike("^`.*`$")
    body = F.substring(part, F.lit(2), F.length(part) - 2)
    names = F.regexp_extract_all(body, F.lit(r"\$\{([^}]+)\}"), F.lit(1))
    filled = F.aggregate(names, body, lambda s, t: F.replace(s, F.concat(F.lit("$"), F.lit("{"), t, F.lit("}")), F.coalesce(F.try_element_at(known, F.trim(t)), F.lit(""))))
    return F.when(quoted, body).when(template, filled).otherwise(F.try_element_at(known, part))


def ts_resolve(known: Column, expression: Column) -> Column:
    """The route that an expression stands for, or null; operands that don't resolve are left out of a sum."""
    e = F.regexp_replace(F.trim(expression), r"[;,]\s*$", "")
    whole = _simple(known, e)
    parts = F.filter(F.split(e, r"\+"), lambda p: ~F.trim(p).startswith("urlFactory("))
    summed = F.array_join(F.transform(parts, lambda p: F.coalesce(_simple(known, p), F.lit(""))), "")
    value = F.coalesce(whole, F.when(F.size(F.split(e, r"\+")) > 1, summed))
    return F.when(value.startswith("/"), value)


def ts_constants(lines: DataFrame) -> DataFrame:
    """Per file, a map of its constants' values; each is resolved with those above it."""
    constant = maybe(r"export\b") + apart("const", keep(NAME)) + r"\s*" + maybe(":", "[^=]+") + "="
    plain, value = group("text", line(constant, r"[^\s{]")), group("text", line(constant, "(.+)$"), 2)
    opened = group("text", line(constant, r"\{", "$"))
    closed = F.col("text").rlike(line(r"\}", maybe(apart("as", "const")) + "[;,]?", "$"))
    so_far = Window.partitionBy(*FILE).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("object", F.last(F.when(opened.isNotNull(), opened).when(closed, ""), ignorenulls=True).over(so_far))
    prop, prop_value = (group("text", line(keep(NAME), ":", "(.+)$"), i) for i in (1, 2))
    inside = (F.coalesce("object", F.lit("")) != "") & prop.isNotNull() & opened.isNull()
    name = F.when(plain.isNotNull(), plain).when(inside, F.concat("object", F.lit("."), prop))
    found = marked.select(*FILE, "line", name.alias("name"), F.when(plain.isNotNull(), value).otherwise(prop_value).alias("expression")).where("name is not null")
    listed = found.groupBy(*FILE).agg(F.array_sort(F.collect_list(F.struct("line", "name", "expression"))).alias("all"))
    empty = F.expr("cast(map() as map<string,string>)")

    def add(known: Column, c: Column) -> Column:
        route = ts_resolve(known, c["expression"])
        return F.when(route.isNull(), known).otherwise(F.map_concat(F.map_filter(known, lambda n, _: n != c["name"]), F.create_map(c["name"], route)))

    return listed.select(*FILE, F.aggregate("all", empty, add).alias("known"))


def client_route(text: Column) -> Column:
    """Without quotes, with one leading slash."""
    bare = F.regexp_replace(F.trim(text), "^['\"`]+|['\"`]+$", "")
    return F.when(bare.startswith("/"), bare).otherwise(F.concat(F.lit("/"), bare))


def extract_ts(files: DataFrame, fetch_verb: str = "") -> tuple[DataFrame, DataFrame]:
    """X3 to X14. ``fetch_verb`` is the verb given to ``fetch`` calls; by default none, so that they stay unmatched."""
    lines = explode_lines(files)
    declared = cut(ts_declarations(lines))
    symbols = symbol(declared.where("name is not null"), F.col("name"), F.col("kind"))
    spread = lambda mark, pattern, *names: holding(declared, "text", mark).select(*FILE, "line", "scope", F.posexplode(every("text", pattern, *names)).alias("col", "m"))
    events = spread("on", _TS_EVENT, "event", "handler")
    out = [edge(events, "ui-event", F.concat(F.lit("on"), F.col("m.event"), F.lit(":"), F.col("m.handler")), "invokes_handler", "function", F.col("m.handler"), _line_note())]
    body = F.concat("m.single", "m.double", "m.tick")
    angular, react = (spread("path", p, "single", "double", "tick", "component") for p in (_TS_ANGULAR, _TS_REACT))
    for routes, framework in ((angular, "angular"), (react, "react")):
        out.append(edge(routes, "route", client_route(body), "renders_component", "component", _global(F.col("m.component")), F.concat(_line_note(), F.lit(f";framework={framework}"))))
    moves = spread("(", _TS_NAVIGATE, "to")
    out.append(edge(moves, "symbol", F.col("scope"), "navigates_to", "route", client_route(F.col("m.to")), _line_note()))
    calls = spread("(", _TS_CALL, "receiver", "member")
    calls = calls.where(~F.col("m.receiver").isin(*_TS_NOT_RECEIVERS) & ~F.col("m.member").isin(*_TS_NOT_MEMBERS))
    out.append(edge(calls, "symbol", F.col("scope"), "calls_method", "method", F.concat("m.receiver", F.lit("."), "m.member"), _line_note()))
    requests = spread("(", _TS_REQUEST, "verb", "argument").join(ts_constants(lines), list(FILE), "left")
    known = F.coalesce("known", F.expr("cast(map() as map<string,string>)"))
    requests = requests.withColumn("route", ts_resolve(known, F.col("m.argument"))).where("route is not null")
    verb = F.when(F.col("m.verb") == "", fetch_verb).otherwise(F.upper("m.verb"))
    out.append(edge(requests, "symbol", F.col("scope"), "calls_api", "api", F.concat(verb, F.lit(" "), F.col("route")), _line_note()))
    return symbols, union(out)


def extract_html(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """X15."""
    pattern = "(?i)" + seq(OPEN, keep(any_of("click", "submit", "ngSubmit", "change", "blur", "focus")), CLOSE, "=", "[\"']", keep(NAME), OPEN)
    found = holding(explode_lines(files), "text", "(", "=").select(*FILE, "line", "text", F.posexplode(every("text", pattern, "event", "handler")).alias("col", "m"))
    name = F.concat("m.event", F.lit(":"), "m.handler")
    return symbol(found, name, "ui-event"), edge(found, "ui-event", name, "invokes_handler", "method", F.col("m.handler"), _line_note())


# --- SQL -----------------------------------------------------------------------------------------------------------

_PART = either(r"\[[^\]]+\]", r"\"[^\"]+\"", r"#{0,2}\w++")
_OBJECT = keep(_PART + rf"(?:\s*\.\s*{_PART})*+")
_TOP = maybe("top", r"\([^)]*\)", maybe("percent"))


def _after(*ways: str) -> str:
    """The objects that follow one of some phrases."""
    return r"(?i)(?<![\w@#])" + either(*(apart(*w.split()) for w in ways)) + r"\s+" + _TOP + _OBJECT


#: Phrases before the tables that a statement writes and reads, in procedures and in texts of programs.
_WRITTEN = _after("merge into", r"merge(?!\s+into\b)", "insert into", r"insert(?!\s+into\b)", "update", "delete from", r"delete(?!\s+from\b)")
_READ = _after("from", "join", "using") + r"(?!\s*\()"
_TEXT_WRITTEN = _after("insert into", "update", "delete from")
_TEXT_READ = _after("from", "join")
_EXECUTED = _after("execute", "exec", "call")
#: What stands before goes on from the match before: behind the last object no other start is tried.
_CREATED = r"(?is)\G(.*?)\bcreate\s+" + keep(any_of("table", "view", "procedure", "proc", "function")) + r"\s+" + _OBJECT
#: A procedure and what it does: in its batch, up to the next object that can't be created inside of it.
_PROCEDURE = r"(?is)\bcreate\s+" + any_of("procedure", "proc") + r"\s+" + _OBJECT + r"(.*?)(?=\bcreate\s+" + any_of("view", "procedure", "proc", "function") + r"|\z)"


def _plain(name: Column) -> Column:
    return F.regexp_replace(name, r"[\[\]\"]|\s*(?=\.)|(?<=\.)\s*", "")


def _sql_symbols(files: DataFrame) -> DataFrame:
    """Created objects, at the line and column of their name, however the statement wraps."""
    match = F.arrays_zip(*[F.regexp_extract_all("code", F.lit(_CREATED), F.lit(i)).alias(n) for i, n in enumerate(("whole", "before", "kind", "object"))])
    found = files.select(*FILE, F.posexplode(match).alias("i", "m")).select(*FILE, "i", "m.*")
    ahead = F.substring(F.col("whole"), F.lit(1), F.length("whole") - F.length("object"))
    wraps = lambda c: F.length(F.regexp_replace(c, r"[^\n]", ""))
    earlier = Window.partitionBy(*FILE).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    line = F.coalesce(F.sum(wraps("whole")).over(earlier), F.lit(0)) + wraps(ahead) + 1
    # two on one line: the column counts on from the line's start
    rest = F.when(wraps(ahead) == 0, F.coalesce(F.lag(F.length(F.substring_index("whole", "\n", -1))).over(Window.partitionBy(*FILE).orderBy("i")), F.lit(0))).otherwise(0)
    plain, kind = _plain(F.col("object")), F.lower("kind")
    schema = F.when(plain.contains("."), F.substring_index(F.regexp_replace(plain, r"\.[^.]*$", ""), ".", -1))
    return found.select(*FILE, F.substring_index(plain, ".", -1).alias("name"), F.when(kind == "proc", "procedure").otherwise(kind).alias("kind"), schema.alias("container"), line.cast("int").alias("line"), (rest + F.length(F.substring_index(ahead, "\n", -1)) + 1).cast("int").alias("col"))


def extract_sql(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Created objects, and what each procedure reads and writes. A written table is also read."""
    files = files.select(*FILE, sql_code(F.regexp_replace("content", "\r\n?", "\n")).alias("code"))
    batch = F.posexplode(F.split("code", r"(?im)^[ \t]*GO[ \t]*(?:\d+[ \t]*)?$")).alias("batch", "code")
    procedure = F.arrays_zip(*[F.regexp_extract_all("code", F.lit(_PROCEDURE), F.lit(i)).alias(n) for i, n in ((1, "procedure"), (2, "body"))])
    bodies = files.select(*FILE, batch).select(*FILE, "batch", F.posexplode(procedure).alias("line", "p"))
    bodies = bodies.select(*FILE, _plain(F.col("p.procedure")).alias("procedure"), (F.col("batch") * 1000 + F.col("line")).alias("line"), *[F.regexp_extract_all("p.body", F.lit(pattern), F.lit(1)).alias(name) for name, pattern in (("written", _WRITTEN), ("read", _READ))])
    tables = lambda names, kind: F.transform(names, lambda t, i: F.struct(F.lit(kind).alias("kind"), i.alias("col"), t.alias("table")))
    both = bodies.select(*FILE, "procedure", "line", F.explode(F.concat(tables("written", "writes_table"), tables("written", "reads_table"), tables("read", "reads_table"))).alias("t"))
    both = both.select(*FILE, "procedure", "line", "t.kind", "t.col", _plain(F.col("t.table")).alias("table"))
    first = Window.partitionBy(*FILE, F.lower("procedure"), "kind", F.lower("table")).orderBy("line", "col", "table")
    both = both.withColumn("n", F.row_number().over(first)).where("n = 1")
    return _sql_symbols(files), edge(both, "procedure", _global(F.col("procedure")), F.col("kind"), "database-table", _global(F.col("table")), "source=tsql")


# --- C# ------------------------------------------------------------------------------------------------------------

# Methods of data sets that write and read, and calls that are no steps of a flow.
_EF_WRITES = ("Add", "AddAsync", "AddRange", "AddRangeAsync", "Update", "UpdateRange", "Remove", "RemoveRange")
_EF_READS = ("Find", "FindAsync", "Where", "First", "FirstAsync", "FirstOrDefault", "FirstOrDefaultAsync", "Single", "SingleAsync", "SingleOrDefault", "SingleOrDefaultAsync", "ToList", "ToListAsync")
_NO_STEPS = ("nameof", "ConfigureAwait", "Ok", "BadRequest", "StatusCode", "GetType", "ReferenceEquals")
_CONNECTIONS = ("GetShardConnection", "GetReadonlyShardConnection")
# Namespaces of cloud services and the services' names.
AZURE_SERVICES = {
    "Azure.Storage.Blobs": "Azure Blob Storage",
    "Azure.Storage.Queues": "Azure Queue Storage",
    "Azure.Messaging.ServiceBus": "Azure Service Bus",
    "Azure.Messaging.EventGrid": "Azure Event Grid",
    "Azure.Security.KeyVault": "Azure Key Vault",
    "Microsoft.Azure.Cosmos": "Azure Cosmos DB",
    "Azure.Identity": "Azure Identity",
    "Microsoft.Azure.Functions": "Azure Functions",
    "Microsoft.Azure.WebJobs": "Azure Functions",
}
_SQL_CALL = r"(?i)Sql|Query|Execute|Procedure"

# Words of the language: modifiers, words that begin something other than a member with a type, and words before a
# round bracket that call nothing.
_MODIFIERS = ("public", "private", "protected", "internal", "static", "sealed", "abstract", "partial", "readonly", "async", "virtual", "override", "new", "extern", "unsafe", "const", "volatile", "required", "ref", "file")
_NO_TYPES = (*_MODIFIERS, "class", "interface", "struct", "record", "enum", "delegate", "event", "namespace", "using", "operator", "implicit", "explicit", "return", "await", "throw", "yield", "else", "case", "goto", "in", "is", "as", "not", "and", "or", "when", "where", "out", "params", "this", "base")
_NO_CALLS = (*_NO_TYPES, "if", "for", "foreach", "while", "switch", "catch", "lock", "typeof", "sizeof", "default", "checked", "unchecked", "fixed", "stackalloc", "var", "with", "get", "set", "init")

_WORD = r"[A-Za-z_]\w*+"
_ARGUMENTS = r"<[^<>(){};]*+(?:<[^<>(){};]*+(?:<[^<>(){};]*+>[^<>(){};]*+)*+>[^<>(){};]*+)*+>"
_CS_TYPE = rf"(?!{any_of(*_NO_TYPES)})(?:{_WORD}(?:\s*(?:\.|::)\s*{_WORD})*+(?:\s*{_ARGUMENTS})?(?:\s*\.\s*{_WORD}(?:\s*{_ARGUMENTS})?)?|\([^()]*+\))(?:\?|\s*\[[,\s]*+\])*+"
_HEAD = rf"(?s)^(\s*(?:{any_of(*_MODIFIERS)}\s+)*"
_OF_INTERFACE = rf"(?:{_WORD}(?:{_ARGUMENTS})?\s*\.\s*)*+"
_ROUND = r"\(((?:[^()]|\((?:[^()]|\((?:[^()]|\([^()]*+\))*+\))*+\))*+)\)"
_DECLARED = _HEAD + rf"(class|interface|struct|record|enum)\s+(?:(?:struct|class)\s+)?)({_WORD})(?:\s*{_ARGUMENTS})?\s*(?:{_ROUND})?\s*(?::(.*?))?(?:\bwhere\b[^{{;]*+)?[{{;]?\s*$"
_METHOD = _HEAD + rf"({_CS_TYPE})\s+{_OF_INTERFACE})({_WORD})\s*(?:{_ARGUMENTS})?\s*{_ROUND}"
_CONSTRUCTOR = _HEAD + rf")({_WORD})\s*{_ROUND}"
_PROPERTY = _HEAD + rf"({_CS_TYPE})\s+{_OF_INTERFACE})({_WORD})\s*(?:\{{|=>)"
_FIELD = _HEAD + rf"({_CS_TYPE})\s+)({_WORD}(?:\s*,\s*{_WORD})*+)\s*(?:;|=(?!>))"
_NAMESPACE = r"^\s*namespace\s+([\w.]+)"
_ATTRIBUTES = r"^\s*(?:\[(?:[^\[\]]|\[[^\[\]]*+\])*+\]\s*)+"
_CS_CALL = rf"(?<!\w)(?<!\?\.)({_WORD})\s*\.\s*({_WORD})\s*(?:{_ARGUMENTS}\s*)?\("
_CS_SET_CALL = rf"(?<!\w)(?<!\?\.)({_WORD})\s*\.\s*({_WORD})\s*\.\s*({_WORD})\s*(?:{_ARGUMENTS}\s*)?\("
_CS_ASSIGNED = rf"\b(?:this\s*\.\s*)?({_WORD})\s*=\s*(?:\w+\s*\.\s*)*+({_WORD})\s*;"
#: Texts as written: filled-in ones (no literals), verbatim, raw and plain ones; their bodies are groups 1 to 3.
_CS_TEXT = r"(?:(?:\$@|@\$|\$+)\"(?:[^\"\\]|\\.)*+\"|@\"([^\"]*+(?:\"\"[^\"]*+)*+)\"|\"\"\"(?s:(.*?))\"\"\"|\"([^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+)\")"


def _attribute(names: str) -> str:
    """An attribute of one of some names, dotted or with its long name, in a list or alone."""
    return rf"(?:\[|,)\s*(?:[\w.]+\.)?{names}(?:Attribute)?(?=\s*[\](,])"


def _first_text(names: str) -> str:
    return _attribute(names) + r"\s*\([^\")]*+\"([^\"]*+)\""


def _groups(text: str, pattern: str, *groups: int) -> Column:
    """Some groups of a pattern that matches at the start of a text, and what follows the match; null if it doesn't.
    All from one match, so that a long pattern is tried once."""
    marked = F.split(F.regexp_replace(text, pattern, "".join(f"${i}\u0001" for i in groups)), "\u0001")
    return F.when(F.size(marked) > 1, marked)


def _part(array: str, i: int) -> Column:
    return F.nullif(F.get(F.col(array), F.lit(i)), F.lit(""))


def cs_members(files: DataFrame, tasks: int | None = None) -> DataFrame:
    """Statements with the ``owner`` type around them (its word, and its line as ``owner_at``), what they declare
    (``type_name``, ``method_name``, ``constructor``, ``property_name``, each at ``line`` and ``col``), their
    ``attributes``, and for statements of a method or constructor ``method``, ``method_at`` and ``body``."""
    s = cs_statements(files, tasks)
    file = Window.partitionBy(*FILE).orderBy("pos")
    so_far, earlier = file.rowsBetween(Window.unboundedPreceding, 0), file.rowsBetween(Window.unboundedPreceding, -1)
    # attributes on the declaration itself give way to blanks; those that stand alone above it are carried down
    ahead = F.regexp_extract("code", _ATTRIBUTES, 0)
    alone = (F.length(ahead) == F.length("code")) & (ahead != "")
    own = F.substring(F.col("text"), F.lit(1), F.length(ahead))
    run = F.coalesce(F.sum(F.when(alone, 0).otherwise(1)).over(earlier), F.lit(0))
    s = s.withColumn("alone", alone).withColumn("run", run).withColumn("own", own)
    above = Window.partitionBy(*FILE, "run").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("attributes", F.concat_ws("\n", F.collect_list(F.when(F.col("own") != "", F.col("own"))).over(above)))
    s = s.where("not alone").withColumn("code", F.concat(F.regexp_replace(ahead, r"[^\n]", " "), F.substring(F.col("code"), F.length(ahead) + 1, F.length("code")))).drop("own", "run", "alone")

    types = r"\b(?:class|interface|struct|record|enum)\b"
    s = s.withColumn("d", F.when(F.col("code").rlike(types), _groups("code", _DECLARED, 1, 2, 3, 5)))
    s = s.withColumn("type_word", _part("d", 1)).withColumn("type_name", _part("d", 2)).withColumn("bases", _part("d", 3))
    s = s.withColumn("namespace_name", F.when(F.col("code").contains("namespace"), group("code", _NAMESPACE)))
    kind = F.when(F.col("type_name").isNotNull(), "type").when(F.col("namespace_name").isNotNull(), "namespace").otherwise("other")
    s = with_block(s, F.struct(kind.alias("kind"), F.coalesce("type_name", "namespace_name").alias("name"), F.col("type_word").alias("word"), F.col("line").alias("at")))
    in_type, of_file = F.coalesce(F.col("block.kind") == "type", F.lit(False)), F.last(F.when((F.col("depth") == 0) & F.col("code").endswith(";"), F.col("namespace_name")), ignorenulls=True).over(so_far)
    owner = F.when(in_type, F.struct(F.col("block.name").alias("name"), F.col("block.word").alias("word"), F.col("block.at").alias("at")))
    s = s.withColumn("member", in_type & F.col("type_name").isNull()).withColumn("o", owner)
    s = s.withColumn("namespace", F.when(F.col("block.kind") == "namespace", F.col("block.name")).when(~in_type, of_file))
    # what a member may be is looked for where its marks are; a method's head may also be a function's inside of a body
    member, calls, opens = F.col("member"), F.col("code").contains("("), F.col("code").rlike(r"\{$|=>")
    s = s.withColumn("c", F.when(member & calls & F.col("code").contains(F.col("o.name")), _groups("code", _CONSTRUCTOR, 1, 2, 3)))
    s = s.withColumn("constructor", F.when(_part("c", 1) == F.col("o.name"), _part("c", 1)))
    s = s.withColumn("h", F.when(F.col("constructor").isNull() & calls & (member | opens) & F.col("type_name").isNull(), _groups("code", _METHOD, 1, 3, 4)))
    s = s.withColumn("method_name", F.when(member, _part("h", 1)))
    s = s.withColumn("p", F.when(member & opens & F.col("constructor").isNull() & F.col("method_name").isNull(), _groups("code", _PROPERTY, 1, 2, 3)))
    s = s.withColumn("property_name", _part("p", 2)).withColumn("property_type", _part("p", 1))
    declares = F.when(F.col("type_name").isNotNull(), F.col("d")).when(F.col("constructor").isNotNull(), F.col("c")).when(F.col("method_name").isNotNull(), F.col("h")).when(F.col("property_name").isNotNull(), F.col("p"))
    line, col = place(F.coalesce(F.get(declares, F.lit(0)), F.lit("")))
    s = s.withColumn("first", F.col("line")).withColumn("line", F.coalesce(line, F.col("line"))).withColumn("col", col)
    head = F.when(F.col("constructor").isNotNull(), F.col("c")).when(F.col("method_name").isNotNull(), F.col("h"))
    listed = F.get(head, F.lit(2))
    # the rest behind the match is the last part; the parameters end one bracket before it
    start = F.length("code") - F.length(F.element_at(head, -1)) - F.length(listed)
    s = s.withColumn("parameters", F.when(F.length(listed) > 0, F.substring(F.col("text"), start, F.length(listed))))

    # a member's statements are those deeper than it, up to the next member
    now = F.struct("o", "depth", F.col("pos").alias("at"), F.coalesce("method_name", "constructor").alias("name"), F.col("constructor").isNotNull().alias("builds"))
    started = F.when(F.col("member"), now).when(F.col("type_name").isNotNull() | (F.col("depth") == 0), F.struct(F.lit(None).cast(s.schema["o"].dataType).alias("o"), "depth", F.col("pos").alias("at"), F.lit(None).cast("string").alias("name"), F.lit(False).alias("builds")))
    s = s.withColumn("m", F.last(started, ignorenulls=True).over(so_far))
    itself = F.col("pos") == F.col("m.at")
    inside = F.col("m.name").isNotNull() & ((F.col("depth") > F.col("m.depth")) | itself)
    s = s.withColumn("owner", F.when(inside, F.col("m.o.name")).otherwise(F.col("o.name"))).withColumn("owner_word", F.when(inside, F.col("m.o.word")).otherwise(F.col("o.word")))
    s = s.withColumn("method", F.when(inside, F.col("m.name"))).withColumn("method_at", F.when(inside, F.col("m.at"))).withColumn("in_constructor", F.coalesce(inside & F.col("m.builds"), F.lit(False)))
    arrow = F.regexp_extract("code", r"(?s)=>(.*)$", 1)
    rest = F.element_at("h", -1)
    local = ~F.col("member") & F.coalesce(rest.rlike(r"^\s*(?:where\b[^{;=]*+)?(?:\{|=>)"), F.lit(False))
    within = F.when(local, F.concat(F.get("h", F.lit(2)), F.lit(")"), rest)).otherwise(F.col("code"))
    s = s.withColumn("body", F.when(inside & itself, arrow).when(inside, within))
    return s.withColumn("body_text", F.substring(F.col("text"), F.length("code") - F.length("body") + 1, F.length("body"))).withColumnRenamed("text", "whole_text").drop("m", "o", "block", "lines", "d", "c", "h", "p")


def cs_type_kind() -> Column:
    """The kind of a type from its word, name, bases, attributes and path."""
    name = F.col("type_name")
    model = F.col("relative_path").rlike("(?i)/(Domain|Models)/") | name.rlike("(Model|Entity)$")
    has = lambda names: F.coalesce(F.col("attributes").rlike(_attribute(names)), F.lit(False))
    of_class = (
        F.when(name.endswith("Controller") | has("(?:Api)?Controller"), "controller")
        .when(name.endswith("Repository"), "repository")
        .when(name.endswith("Function") | F.coalesce(F.col("has_function"), F.lit(False)), "azure-function")
        .when(F.coalesce(F.col("bases"), F.lit("")).rlike(r"DbContext\s*(?:,|$)"), "db-context")
        .when(model, "domain-model")
        .otherwise("class")
    )
    return F.when(F.col("type_word") == "class", of_class).otherwise(F.col("type_word"))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _listed(text: str | Column) -> Column:
    """Parts of a list between commas outside of brackets."""
    return F.transform(F.regexp_extract_all(text, F.lit(rf"(?:[^,<>()\[\]\"]|{_ARGUMENTS}|{_ROUND}|\[(?:[^\[\]\"]|\"[^\"]*+\")*+\]|\"[^\"]*+\"|[<>])++"), F.lit(0)), _strip)


def member_types(s: DataFrame) -> DataFrame:
    """``(file, owner, member, type)`` of classes: fields, then parameters and assignments of each constructor in
    turn; the later wins. An assignment passes the type of the parameter on, else that of the field."""
    s = s.where("owner_word = 'class'")
    fields = s.where("member and method_name is null and constructor is null and property_name is null").select(*FILE, "owner", group("code", _FIELD, 2).alias("type"), F.explode(F.split(group("code", _FIELD, 3), r"\s*,\s*")).alias("member"), "line", F.struct(F.lit(0).alias("at"), F.lit(0).alias("step"), F.col("pos").alias("pos")).alias("order"))
    parameter = rf"(?s)^(?:\[(?:[^\[\]]|\[[^\[\]]*+\])*+\]\s*)*+(?:(?:this|ref|out|in|params)\s+)*+({_CS_TYPE})\s+({_WORD})\s*(?:=.*)?$"
    given = s.where("constructor is not null").select(*FILE, "owner", "line", "pos", F.posexplode(_listed("parameters")).alias("i", "p"))
    given = given.select(*FILE, "owner", group("p", parameter).alias("type"), group("p", parameter, 2).alias("member"), "line", F.struct(F.col("pos").alias("at"), F.lit(1).alias("step"), F.col("i").alias("pos")).alias("order")).where("member is not null")
    assigned = holding(s.where("in_constructor"), "body", "=").select(*FILE, "owner", "line", "pos", "method_at", F.explode(every("body", _CS_ASSIGNED, "left", "right")).alias("a"))
    assigned = assigned.select(*FILE, "owner", F.col("a.left").alias("member"), F.col("a.right").alias("right"), "line", F.struct(F.col("method_at").alias("at"), F.lit(2).alias("step"), F.col("pos").alias("pos")).alias("order"))
    known = union([x.select(*FILE, "owner", F.col("member").alias("right"), "type", F.col("order.at").alias("from")) for x in (fields, given)])
    passed = assigned.join(known, [*FILE, "owner", "right"]).where("from = 0 or from = order.at")
    passed = passed.groupBy(*FILE, "owner", "member", "line", "order").agg(F.max_by("type", "from").alias("type"))
    every_one = union([x.select(*FILE, "owner", "member", "type", "line", "order") for x in (fields, given, passed)])
    return every_one.groupBy(*FILE, "owner", "member").agg(F.max_by("type", "order").alias("type"), F.min("line").alias("line"))


def _mvc(s: DataFrame) -> DataFrame:
    """Endpoints by verb attributes; class and method routes combined."""
    types = s.where("type_word = 'class'").select(*FILE, F.col("type_name").alias("owner"), group("attributes", _first_text("Route")).alias("class_route"))
    found = s.where("method_name is not null and owner_word = 'class'").withColumn("own_route", group("attributes", _first_text("Route")))
    verb = _attribute("Http(Get|Post|Put|Patch|Delete)") + r"(?:\s*\([^\")]*+(?:\"([^\"]*+)\")?)?"
    verbs = holding(found, "attributes", "Http").select(*FILE, "line", "owner", "method_name", "own_route", F.posexplode(every("attributes", verb, "verb", "template")).alias("col", "m"))
    verbs = verbs.join(types, [*FILE, "owner"], "left")
    own = F.when(F.col("m.template") != "", F.col("m.template")).otherwise(F.col("own_route"))
    joined = F.array_join(F.filter(F.array(F.col("class_route"), own), lambda x: x.isNotNull() & (F.trim(x) != "")), "/")
    named = F.regexp_replace(F.regexp_replace(joined, r"(?i)\[controller\]", F.regexp_replace("owner", "Controller$", "")), r"(?i)\[action\]", F.col("method_name"))
    return verbs.withColumn("api", F.concat(F.upper("m.verb"), F.lit(" /"), _bare_route(named)))


def _bare_route(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), "^/+|/+$", "")


def extract_cs(files: DataFrame, tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """X18 to X38, from statements, which ``tasks`` tasks take."""
    s = cut(cs_members(files, tasks))
    is_function = F.col("attributes").rlike(_attribute("Function(?:Name)?")) & F.col("method_name").isNotNull()
    has_function = s.where(is_function).select(*FILE, F.col("owner").alias("type_name"), F.lit(True).alias("has_function")).distinct()
    types = s.where("type_name is not null").join(has_function, [*FILE, "type_name"], "left").withColumn("type_kind", cs_type_kind())
    made = lambda df, name, kind, container: df.select(*FILE, F.col(name).alias("name"), (kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"), container.alias("container"), F.col("line").cast("int").alias("line"), F.col("col").cast("int").alias("col"))
    symbols = [made(types, "type_name", F.col("type_kind"), F.coalesce("owner", "namespace"))]
    for column, kind in (("method_name", "method"), ("constructor", "constructor"), ("property_name", "property")):
        symbols.append(made(s.where(F.col(column).isNotNull()), column, kind, F.col("owner")))
    s = s.drop("col").withColumn("place", F.col("pos")).drop("line").withColumnRenamed("first", "line")

    out = []
    based = types.where("type_word = 'class' and bases is not null").select(*FILE, "line", "type_name", F.posexplode(_listed("bases")).alias("col", "base")).where("base <> ''")
    out.append(edge(based, "symbol", F.col("type_name"), "inherits_from", "class", _global(F.col("base"))))
    sets = s.where("property_name is not null and owner_word = 'class'").withColumn("entity", F.trim(group("property_type", r"(?s)^DbSet<(.*)>$"))).where("entity is not null")
    out.append(edge(sets, "symbol", F.col("owner"), "maps_dbset", "domain-model", F.col("entity"), F.concat(F.lit("property="), "property_name")))
    out.append(edge(sets, "domain-model", F.col("entity"), "maps_to_table", "database-table", F.col("property_name"), F.concat(F.lit("dbContext="), "owner")))

    # computed once, by the first of the joins below that is run, and by none where none of them is asked for
    known = member_types(s).persist(StorageLevel.DISK_ONLY)
    needed = known.groupBy(*FILE, "owner", "type").agg(F.min("line").alias("line"))
    out.append(edge(needed, "symbol", F.col("owner"), "depends_on", "service", _global(F.col("type"))))
    keyed = holding(s.where("constructor is not null and owner_word = 'class'"), "parameters", "FromKeyedServices").select(*FILE, "owner", "line", "pos", F.posexplode(every("parameters", rf"\[\s*(?:\w+\.)*FromKeyedServices(?:Attribute)?\s*\(\s*(?:\"([^\"]*+)\"|nameof\s*\(\s*([\w.]+)\s*\))\s*\)\s*\]\s*({_CS_TYPE})\s+({_WORD})", "key", "named", "type", "parameter")).alias("col", "k"))
    assigned = holding(s.where("in_constructor"), "body", "=").select(*FILE, "owner", F.col("method_at").alias("pos"), F.col("place"), F.explode(every("body", _CS_ASSIGNED, "field", "parameter")).alias("a")).groupBy(*FILE, "owner", "pos", F.col("a.parameter").alias("parameter")).agg(F.min_by("a.field", "place").alias("field"))
    keyed = keyed.select(*FILE, "owner", "line", "pos", "col", "k.*").join(assigned, [*FILE, "owner", "pos", "parameter"], "left")
    key = F.when(F.col("key") != "", F.col("key")).otherwise(F.col("named"))
    note = F.concat(F.lit("parameter="), "parameter", F.lit(";field="), F.coalesce("field", F.lit("")), F.lit(";key="), key, F.lit(";source=FromKeyedServices"))
    out.append(edge(keyed.where(F.coalesce(key, F.lit("")) != ""), "symbol", F.col("owner"), "depends_on", "service", _global(F.col("type")), note))

    bodies = s.where("body is not null and not in_constructor and owner_word = 'class'")
    spread = lambda mark, pattern, *names: holding(bodies, "body", "(", mark).select(*FILE, "line", "owner", "method", F.posexplode(every("body", pattern, *names)).alias("col", "c")).select(*FILE, "line", "owner", "method", "col", "c.*")
    typed_as = lambda column: known.select(*FILE, "owner", F.col("member").alias(column), "type")
    calls = spread(".", _CS_CALL, "receiver", "member")
    saves = F.col("member").isin("SaveChanges", "SaveChangesAsync")
    skipped = saves | F.col("member").isin(*_EF_WRITES, *_EF_READS, *_CONNECTIONS) | F.col("member").rlike(_SQL_CALL) | F.col("member").startswith("Log") | F.col("type").startswith("ILogger")
    typed = calls.join(typed_as("receiver"), [*FILE, "owner", "receiver"]).where(~skipped)
    out.append(edge(typed, "symbol", F.col("method"), "calls_method", "method", _global(F.concat("type", F.lit("."), "member")), F.concat(F.lit("receiver="), "receiver")))
    saving = spread("SaveChanges", _CS_CALL, "receiver", "member").where(saves).join(typed_as("receiver"), [*FILE, "owner", "receiver"], "left")
    out.append(edge(saving, "symbol", F.col("method"), "saves_changes", "db-context", _global(F.coalesce("type", F.when(F.col("receiver").isin("this", "base"), "DbContext").otherwise(F.col("receiver")))), F.when(~F.col("receiver").isin("this", "base"), F.concat(F.lit("receiver="), "receiver"))))
    direct = spread("(", rf"(?<![\w.\"@])(?<!\bnew\s{{1,9}})({_WORD})\s*\(", "member").where(~F.col("member").isin(*_NO_CALLS, *_NO_STEPS))
    out.append(edge(direct, "symbol", F.col("method"), "calls_method", "method", F.col("member"), "receiver=this;direct=true"))
    tables = spread(".", _CS_SET_CALL, "context", "set", "member").join(typed_as("context"), [*FILE, "owner", "context"]).where(F.col("type").rlike(r"Context\??$|\.DbContext"))
    note = F.concat(F.lit("context="), "context", F.lit(";method="), "member")
    for kind, members in (("writes_table", _EF_WRITES), ("reads_table", _EF_READS)):
        out.append(edge(tables.where(F.col("member").isin(*members)), "symbol", F.col("method"), kind, "database-table", F.col("set"), note))
    out += _sql_in_text(bodies)

    api = _mvc(s)
    note = F.concat(F.lit("controller="), "owner")
    out.append(edge(api, "symbol", F.col("method_name"), "handles_api", "api", F.col("api"), note))
    out.append(edge(api, "api", F.col("api"), "handled_by", "method", F.col("method_name"), note))
    trigger = holding(s.where("method_name is not null"), "parameters", "HttpTrigger").where(F.col("parameters").rlike(_attribute("HttpTrigger"))).withColumn("trigger", F.regexp_extract("parameters", _attribute("HttpTrigger") + r"((?:[^\]\"]|\"[^\"]*+\")*+)\]", 1))
    named = F.coalesce(group("attributes", _first_text("Function")), group("attributes", _first_text("FunctionName")))
    route = _bare_route(F.coalesce(group("trigger", r"\bRoute\s*=\s*\"?((?<=\")[^\"]*+|null)"), named, F.col("method_name")))
    verbs = F.array_distinct(F.transform(F.regexp_extract_all("trigger", F.lit(r"(?i)\"(get|post|put|patch|delete)\""), F.lit(1)), F.upper))
    trigger = trigger.select(*FILE, "line", "method_name", F.coalesce(named, F.col("method_name")).alias("function"), route.alias("route"), F.posexplode(F.when(F.size(verbs) == 0, F.array(F.lit("ANY"))).otherwise(verbs)).alias("col", "verb"))
    address, note = F.concat("verb", F.lit(" /"), "route"), F.concat(F.lit("azureFunction="), "function")
    out.append(edge(trigger, "symbol", F.col("method_name"), "handles_api", "api", address, note))
    out.append(edge(trigger, "api", address, "handled_by", "azure-function", F.col("method_name"), note))
    minimal = holding(s, "whole_text", "Map").select(*FILE, "line", F.posexplode(every("whole_text", r"\.\s*Map(Get|Post|Put|Patch|Delete)\s*\([^\")]*+\"([^\"]*+)\"", "verb", "route")).alias("col", "m")).where("trim(m.route) <> ''")
    address = F.concat(F.upper("m.verb"), F.lit(" /"), _bare_route(F.col("m.route")))
    out.append(edge(minimal, "api", address, "handled_by", "minimal-api", address, "source=minimal-api"))
    registration = rf"\.\s*(Add(?:Keyed)?(?:Scoped|Transient|Singleton))\s*<\s*({_CS_TYPE})\s*,\s*({_CS_TYPE})\s*(?:,[^()]*)?>\s*\(\s*(?:\"([^\"]*+)\"|nameof\s*\(\s*([\w.]+)\s*\))?"
    registered = holding(s, "whole_text", "Add", "<").select(*FILE, "line", F.posexplode(every("whole_text", registration, "added", "service", "implementation", "key", "named")).alias("col", "d")).select(*FILE, "line", "col", "d.*")
    key = F.when(F.col("key") != "", F.col("key")).when(F.col("named") != "", F.col("named"))
    note = F.concat(F.lit("lifetime="), "added", F.when(F.col("added").startswith("AddKeyed") & key.isNotNull(), F.concat(F.lit(";key="), key)).otherwise(""))
    out.append(edge(registered, "service", _global(F.col("service")), "implemented_by", "class", _global(F.col("implementation")), note))
    using = holding(s.where("depth = 0"), "code", "using").withColumn("namespace_used", group("code", r"^\s*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;")).where("namespace_used is not null")
    service = F.coalesce(*[F.when(F.col("namespace_used").startswith(prefix), name) for prefix, name in AZURE_SERVICES.items()])
    used = using.withColumn("service", service).where("service is not null").groupBy(*FILE, "service").agg(F.min("line").alias("line"))
    out.append(edge(used, "file", "azure-service-reference", "uses_azure_service", "azure-service", _global(F.col("service"))))
    return union(symbols), union(out)


def _texts(text: str) -> Column:
    """The values of the literals in a piece of C#."""
    verbatim, raw, plain = (F.regexp_extract_all(text, F.lit(_CS_TEXT), F.lit(i)) for i in (1, 2, 3))
    value = lambda t: F.when(t["0"] != "", F.replace(t["0"], F.lit('""'), F.lit('"'))).when(t["1"] != "", t["1"]).otherwise(F.regexp_replace(F.regexp_replace(t["2"], r"\\[nrt]", " "), r"\\(.)", "$1"))
    return F.filter(F.transform(F.arrays_zip(verbatim.alias("0"), raw.alias("1"), plain.alias("2")), value), lambda t: F.trim(t) != "")


def _sql_in_text(bodies: DataFrame) -> list[DataFrame]:
    """Procedures and tables named in the string arguments of calls that look like SQL execution."""
    declared = rf"[\w>\]?,]\s+({_WORD})\s*=\s*(?=@?\")"
    variables = holding(bodies, "body", "=", '"').select(*FILE, "method_at", "pos", group("body", declared).alias("variable"), F.get(_texts("body_text"), F.lit(0)).alias("value")).where("variable is not null and value is not null")
    variables = variables.groupBy(*FILE, "method_at", "variable").agg(F.min_by("value", "pos").alias("value"))
    names = F.regexp_extract_all("body", F.lit(rf"({_WORD})\s*(?:{_ARGUMENTS}\s*)?\("), F.lit(1))
    looks = F.filter(names, lambda n: n.rlike(_SQL_CALL))
    runs = holding(bodies, "body", "(").where(F.col("body").rlike(_SQL_CALL)).where((F.size(looks) > 0) | F.col("body").contains("CommandType.StoredProcedure")).withColumn("by", F.coalesce(F.get(looks, F.lit(0)), F.get(names, F.lit(0)))).where("by is not null")
    inline = runs.select(*FILE, "line", "method", "by", F.explode(_texts("body_text")).alias("sql"))
    words = runs.select(*FILE, "line", "method", "method_at", "by", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(rf"(?<![\w.])({_WORD})\s*(?=[,)])"), F.lit(1)))).alias("variable"))
    through = words.join(variables, [*FILE, "method_at", "variable"]).select(*FILE, "line", "method", "by", F.col("value").alias("sql"))
    texts = inline.unionByName(through).distinct()
    note = F.concat(F.lit("method="), "by")
    called = F.regexp_extract_all("sql", F.lit(_EXECUTED), F.lit(1))
    alone = F.when(F.trim("sql").rlike(r"^[\[\]\w$]+(?:\.[\[\]\w$]+)?$") & (F.col("sql").contains(".") | F.trim("sql").rlike(r"(?i)(?:Procedure|Proc)$|^sp")), F.array(F.trim("sql"))).otherwise(F.expr("cast(array() as array<string>)"))
    out = [edge(texts.select("*", F.explode(F.concat(called, alone)).alias("object")), "symbol", F.col("method"), "executes_procedure", "procedure", _global(_plain(F.col("object"))), note)]
    for kind, pattern in (("reads_table", _TEXT_READ), ("writes_table", _TEXT_WRITTEN)):
        found = texts.select("*", F.explode(F.regexp_extract_all("sql", F.lit(pattern), F.lit(1))).alias("object"))
        out.append(edge(found, "symbol", F.col("method"), kind, "database-table", _global(_plain(F.col("object"))), note))
    return [x.distinct() for x in out]


# --- All languages -------------------------------------------------------------------------------------------------

EXTRACTORS: dict[tuple[str, ...], Extractor] = {
    (".ts", ".tsx", ".js", ".jsx"): extract_ts,
    (".html",): extract_html,
    (".sql", ".tsql"): extract_sql,
    (".cs",): extract_cs,
}


#: Source text of one task. As sorted statements with their texts and attributes it is about a hundred times as large.
TASK_CHARACTERS = 1 << 20
#: Source text of one task that only reads C# into statements, file by file: few, so that what moves between the tasks of
#: both steps is not in too many pieces.
READ_CHARACTERS = 1 << 23


def extract_evidence(files: DataFrame, extractors: dict[tuple[str, ...], Extractor] | None = None) -> tuple[DataFrame, DataFrame]:
    """``(symbols, relationships)`` of all files, qualified. ``extractors`` replaces or extends the built-in ones."""
    symbols, edges = _extracted(files, extractors or EXTRACTORS)
    return symbols, normalise(symbols, edges)


def evidence_tables(files: DataFrame, extractors: dict[tuple[str, ...], Extractor] | None = None) -> tuple[DataFrame, DataFrame]:
    """``extract_evidence`` as tables. Containment is told by the table of symbols, so that they are found once."""
    symbols, edges = _extracted(files, extractors or EXTRACTORS)
    symbols = cut(symbols)
    return symbols, cut(normalise(symbols, edges))


def _extracted(files: DataFrame, extractors: dict[tuple[str, ...], Extractor]) -> tuple[DataFrame, DataFrame]:
    """Symbols and relationships of all files, with identifiers as written."""
    wanted = {e for ext in extractors for e in ext}
    kind = extension(F.col("relative_path"))
    characters = dict(files.where(kind.isin(*wanted)).groupBy(kind).agg(F.sum(F.length("content"))).collect())
    found = []
    for ext, f in extractors.items():
        n = sum(characters.get(e) or 0 for e in ext)
        tasks = max(1 + n // TASK_CHARACTERS, min(files.sparkSession.sparkContext.defaultParallelism, 1 + n // (TASK_CHARACTERS // 16)))
        # whole files move once; their lines are then sorted where they are, in memory. Left to itself, Spark puts files
        # together by their compressed size
        own = files.where(kind.isin(*ext))
        if f is extract_cs:
            readers = max(1 + n // READ_CHARACTERS, min(tasks, 4 * files.sparkSession.sparkContext.defaultParallelism))
            found.append(f(own.repartition(readers, *FILE), tasks))
        else:
            found.append(f(own.repartition(tasks, *FILE)))
    return union([s.select(*SYMBOL) for s, _ in found]), union([r.select(*EDGE) for _, r in found])


def contains_symbol(symbols: DataFrame) -> DataFrame:
    """File to symbol, and container to symbol."""
    path, name = F.col("relative_path"), F.col("name")
    of_file = F.struct(F.lit("file").alias("source_kind"), path.alias("source"), F.concat(F.lit("line="), F.col("line").cast("string"), F.lit(";column="), F.col("col").cast("string")).alias("metadata"))
    of_type = F.when(F.col("container").isNotNull(), F.struct(F.lit("symbol").alias("source_kind"), F.concat(path, F.lit("::"), "container").alias("source"), F.lit(None).cast("string").alias("metadata")))
    both = symbols.select(*FILE, F.explode(F.filter(F.array(of_file, of_type), lambda x: x.isNotNull())).alias("e"), F.col("kind"), F.concat(path, F.lit("::"), name).alias("target"), "line", "col")
    return both.select("workspace_id", "relative_path", "e.source_kind", F.col("e.source").alias("source_identifier"), F.lit("contains_symbol").alias("relationship_kind"), F.col("kind").alias("target_kind"), F.col("target").alias("target_identifier"), "e.metadata", "line", "col")


def normalise(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Relationships with qualified identifiers, containment included."""
    path = F.col("relative_path")
    named = edges.select("workspace_id", "relative_path", "source_kind", qualify(path, F.col("source")).alias("source_identifier"), "relationship_kind", "target_kind", qualify(path, F.col("target")).alias("target_identifier"), "metadata", "line", "col")
    return contains_symbol(symbols).unionByName(named)


def evidence_ids(relationships: DataFrame) -> DataFrame:
    """A stable ``rel_id`` from the natural key and the place among its repeats."""
    key = ["workspace_id", "source_kind", "source_identifier", "relationship_kind", "target_kind", "target_identifier"]
    order = Window.partitionBy(*key).orderBy(*[c for c in ("relative_path", "line", "col") if c in relationships.columns], "metadata")
    return relationships.withColumn("rel_id", F.xxhash64(*key, F.row_number().over(order)))
