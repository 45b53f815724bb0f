"""Source text as statements: lexical state, logical lines and the block around each.

Lexical state is resolved file by file: one pattern matches comments, directives, texts of all kinds and what is
between them, so that a quote inside a comment or a brace inside a text never counts. Physical lines are then cut
behind ``;``, ``{`` and ``}``, and counts of brackets fold the parts into statements, wherever they wrap: one pass over
a file in a task, so that its lines are neither sorted nor grouped. The rest is column functions and windows over one file.

Patterns repeat groups possessively: Java runs those without recursion, however long a comment or text is.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILE = ("workspace_id", "relative_path")

_DIRECTIVE = r"(?m:^[ \t]*+#[^\n]*+)"
_LINE_COMMENT, _DASH_COMMENT, _BLOCK_COMMENT = r"//[^\n]*+", r"--[^\n]*+", r"/\*(?s:.*?)(?:\*/|\z)"
_RAW = r"\$*+(\"{3,})(?s:.*?)(?:\1\"*+|\z)"
_VERBATIM = r"(?:@\$?|\$@)\"[^\"]*+(?:\"\"[^\"]*+)*+(?:\"|\z)"
_HOLE = r"\{[^\"{}\n]*+(?:\"[^\"\n]*+\"[^\"{}\n]*+)*+\}"
_FILLED = rf"\$\"(?:[^\"\\\n{{]++|\\.|\{{\{{|{_HOLE}|\{{)*+\"?+"
_PLAIN = r"\"[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+\"?+"
_CHARACTER = r"'(?:[^'\\\n]|\\[^\n][^'\n]{0,9})'"
#: Runs without a possible start of one of these, over line ends that no directive follows: most of a file is few of them.
_RUN = r"(?![ \t]*+#)(?:[^/\"'@$\n]++|\n(?![ \t]*+#))++"
#: What C# is read as, first match first; the rest, in runs, and line ends.
_CS = "|".join([_DIRECTIVE, _LINE_COMMENT, _BLOCK_COMMENT, _RAW, _VERBATIM, _FILLED, _PLAIN, _CHARACTER, _RUN, r"[^/\"'@$\n]++", r"(?s:.)"])


def _nested(levels: int) -> str:
    """Block comments inside block comments, to a depth."""
    inside = r"\*(?!/)|/(?!\*)"
    return r"/\*[^*/]*+(?:(?:" + inside + ("|" + _nested(levels - 1) if levels else "") + r")[^*/]*+)*+\*/"


#: T-SQL: comments nest (eight deep here); texts double their quote; names may stand in brackets or quotes.
_SQL_TEXT, _SQL_NAME = r"'[^']*+(?:''[^']*+)*+(?:'|\z)", r"\[[^\]\n]*+\]|\"[^\"\n]*+\""
_SQL = "|".join([_DASH_COMMENT, _nested(8), _SQL_TEXT, _SQL_NAME, r"[^-/'\[\"]++", r"(?s:.)"])


def _blank(token: Column) -> Column:
    return F.regexp_replace(token, r"[^\n]", " ")


def _between(token: Column) -> Column:
    """A text without its body, as long as before."""
    inner = F.substring(token, F.lit(2), F.length(token) - 2)
    return F.when(F.length(token) > 1, F.concat(F.lit('"'), _blank(inner), F.lit('"'))).otherwise(F.lit('"'))


def cs_lexed(files: DataFrame) -> DataFrame:
    """``(file, text, code)``, both as long as the file: ``text`` without comments and directives, ``code`` also without
    the bodies of texts and characters. Line ends are made alike first."""
    tokens = files.select(*FILE, F.regexp_extract_all(F.regexp_replace("content", "\r\n?", "\n"), F.lit(_CS), F.lit(0)).alias("tokens"))
    void = lambda t: t.startswith("//") | t.startswith("/*") | t.rlike(r"^[ \t]*#")
    quoted = lambda t: t.rlike(r"^[@$]*\"") | t.rlike("(?s)^'.+'$")
    text = F.transform("tokens", lambda t: F.when(void(t), _blank(t)).otherwise(t))
    code = F.transform("tokens", lambda t: F.when(void(t), _blank(t)).when(quoted(t), _between(t)).otherwise(t))
    return tokens.select(*FILE, F.array_join(text, "").alias("text"), F.array_join(code, "").alias("code"))


def sql_code(content: Column) -> Column:
    """T-SQL without comments and bodies of texts, as long as before."""
    tokens = F.regexp_extract_all(content, F.lit(_SQL), F.lit(0))
    void = lambda t: t.startswith("--") | t.rlike(r"^/\*.")
    return F.array_join(F.transform(tokens, lambda t: F.when(void(t), _blank(t)).when(t.startswith("'"), _blank(t)).otherwise(t)), "")


#: Parts of a line: up to and with ``;``, ``{`` or ``}``, or what is left behind the last of them. As in Java's
#: patterns, white space is ASCII's, words end where no letter follows, and ``$`` stands before a last line end of Unicode.
_PARTS = re.compile(r"[^;{}]*[;{}]|[^;{}]+")
_ACCESS = re.compile(r"[ \t-\r]*(?:public|private|protected|internal|namespace)\b")
_ATTRIBUTE = re.compile(r"\][ \t-\r]*[\u0085\u2028\u2029]?$")
_GOES_ON = re.compile(r"[ \t-\r]*[.?:=+*/&|,)<>-]")


def _fold(code: str, text: str) -> Iterator[tuple]:
    """The statements of one file: its parts in order, put together until one ends outside of brackets."""
    lines = enumerate(zip(code.split("\n"), text.split("\n"), strict=False), 1)
    parts = [(line, m.start(), m[0], t[m.start() : m.end()]) for line, (c, t) in lines for m in _PARTS.finditer(c) if m[0].strip(" ")]
    depth = before = opened = begin = 0
    for i, (_, _, c, _) in enumerate(parts):
        if _ACCESS.match(c):
            if i > begin:
                yield _statement(parts[begin:i], before)
            begin, before, opened = i, depth, 0
        depth += c.count("{") - c.count("}")
        opened += c.count("(") + c.count("[") - c.count(")") - c.count("]")
        # attributes that stand alone, unless what follows goes on with an expression
        if opened <= 0 and (c[-1] in ";{}" or (_ATTRIBUTE.search(c) and not (i + 1 < len(parts) and _GOES_ON.match(parts[i + 1][2])))):
            yield _statement(parts[begin : i + 1], before)
            begin, before = i + 1, depth
    if begin < len(parts):
        yield _statement(parts[begin:], before)


def _statement(parts: list[tuple], depth: int) -> tuple:
    """``(line, lines, at, depth, code, text, opens)`` of the parts of a statement; a new line goes with a line end."""
    line, at, code, text = parts[0]
    if len(parts) > 1:
        ends = ["\n" if a[0] != b[0] else "" for a, b in pairwise(parts)]
        code += "".join(e + p[2] for e, p in zip(ends, parts[1:], strict=True))
        text += "".join(e + p[3] for e, p in zip(ends, parts[1:], strict=True))
    return line, list(dict.fromkeys(p[0] for p in parts)), at, depth, code, text, code.count("{") - code.count("}")


_STATEMENT = {"line": pa.int32(), "lines": pa.list_(pa.int32()), "at": pa.int32(), "depth": pa.int64(), "code": pa.string(), "text": pa.string(), "opens": pa.int32()}


def _statements(code: pa.Array, text: pa.Array) -> pa.Array:
    """The statements of each file of a batch."""
    offsets, rows = [0], []
    for c, t in zip(code.to_pylist(), text.to_pylist(), strict=True):
        rows += [] if c is None else _fold(c, t)
        offsets.append(len(rows))
    columns = zip(*rows, strict=True) if rows else [()] * len(_STATEMENT)
    fields = [pa.array(column, kind) for column, kind in zip(columns, _STATEMENT.values(), strict=True)]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, list(_STATEMENT)))


# the functions travel with the tasks: workers need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def cs_statements(files: DataFrame, tasks: int | None = None) -> DataFrame:
    """``(file, pos, line, lines, at, depth, code, text, opens)``: the statements of each file.

    A statement ends behind ``;``, ``{`` or ``}`` outside of round and square brackets, behind attributes that stand
    alone, and before a word of access (which no bracket can hold, so an unclosed one does no harm beyond it).
    ``lines`` are its physical lines (blank ones left out), ``at`` the column of its first character, from 0; ``depth``
    is the number of braces open before it, ``opens`` how many more are after it. ``pos`` orders a file's statements.

    Spark forgets behind a Python function that files lie together, and would deal the statements anew, in as few tasks as
    their compressed size allows. ``tasks`` says how many take them instead, so that each sorts its share in memory.
    """
    folded = F.arrow_udf(_statements, "array<struct<line:int,lines:array<int>,at:int,depth:bigint,code:string,text:string,opens:int>>")
    found = cs_lexed(files).select(*FILE, F.posexplode(folded("code", "text")).alias("i", "s")).select(*FILE, (F.col("i") + 1).alias("pos"), "s.*")
    return found if tasks is None else found.repartition(tasks, *FILE)


def with_block(statements: DataFrame, block: Column) -> DataFrame:
    """Adds ``block``: of the innermost block around each statement, what ``block`` gives for the statement that opens it.

    At depth d that is the last statement that opened a block at depth d - 1. Each statement looks from depth d - 1, and
    stands as an opener at its own depth, so a window over (file, depth) answers all of them, however deep they nest.
    """
    looks = F.struct((F.col("depth") - 1).alias("level"), F.lit(True).alias("looks"))
    stands = F.when(F.col("opens") > 0, F.struct(F.col("depth").alias("level"), F.lit(False).alias("looks")))
    both = statements.select("*", F.when(F.col("opens") > 0, block).alias("own"), F.explode(F.filter(F.array(looks, stands), lambda x: x.isNotNull())).alias("role"))
    level = Window.partitionBy(*FILE, "role.level").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    opener = F.when(~F.col("role.looks"), F.struct("own"))
    return both.withColumn("block", F.last(opener, ignorenulls=True).over(level)["own"]).where("role.looks").drop("role", "own")


def place(prefix: Column) -> tuple[Column, Column]:
    """Line and column (from 1) of what follows ``prefix`` in a statement."""
    wraps = F.length(F.regexp_replace(prefix, r"[^\n]", ""))
    last = F.length(F.substring_index(prefix, "\n", -1))
    return F.element_at("lines", wraps + 1), F.when(wraps == 0, F.col("at") + last).otherwise(last) + 1
