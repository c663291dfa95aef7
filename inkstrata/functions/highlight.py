"""A code tokeniser as a plan: comments, strings, numbers, keywords and type names as ranges.

A language is a row of a small table: a pattern whose matches, one after the other, are the whole code, its comment marks, quotes and words. Blocks meet their language by a
broadcast join of that fixed table, are cut by the pattern in the JVM, and running sums of the pieces' lengths give the ranges.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Comment marks, quotes and common keywords of each language, chosen here, and aliases of language names.
C_WORDS = "if else for while do switch case default break continue return struct class enum public private protected static const void int long float double char bool true false null new this try catch throw import package interface extends implements final"
LANGUAGES = {
    "c": ("//", ("/*", "*/"), "\"'", C_WORDS),
    "java": ("//", ("/*", "*/"), "\"'", C_WORDS),
    "javascript": ("//", ("/*", "*/"), "\"'`", C_WORDS + " function var let async await yield of in typeof export from undefined"),
    "swift": ("//", ("/*", "*/"), "\"", C_WORDS + " func let var guard defer extension protocol init self nil where in as is"),
    "rust": ("//", ("/*", "*/"), "\"", C_WORDS + " fn let mut impl trait pub use mod match loop ref move self crate where as in"),
    "go": ("//", ("/*", "*/"), "\"'`", C_WORDS + " func var type range map chan go defer select fallthrough nil"),
    "python": ("#", None, "\"'", "def class if elif else for while in is not and or return yield import from as with try except finally raise lambda pass break continue None True False global nonlocal async await del assert"),
    "ruby": ("#", None, "\"'", "def class module if elsif else unless end do while until for in return yield begin rescue ensure nil true false self require"),
    "shell": ("#", None, "\"'", "if then else elif fi for while do done case esac function in return exit export local echo"),
    "sql": ("--", ("/*", "*/"), "'\"", "select from where group by order having join left right inner outer on as and or not null insert into values update set delete create table with union all distinct limit"),
    "yaml": ("#", None, "\"'", "true false null"),
    "json": (None, None, "\"", "true false null"),
    "css": (None, ("/*", "*/"), "\"'", ""),
    "kotlin": ("//", ("/*", "*/"), "\"", C_WORDS + " fun val var when is in object companion data sealed override open internal suspend init lateinit by where as"),
    "csharp": ("//", ("/*", "*/"), "\"'", C_WORDS + " using namespace var string object async await override virtual readonly get set is as in out ref foreach"),
    "php": ("//", ("/*", "*/"), "\"'", C_WORDS + " function echo foreach as use namespace require include global fn match"),
    "scala": ("//", ("/*", "*/"), "\"", C_WORDS + " def val var object trait match with yield implicit lazy override sealed given using"),
    "dart": ("//", ("/*", "*/"), "\"'", C_WORDS + " var late required async await factory mixin with on is as in get set dynamic"),
    "zig": ("//", None, "\"'", C_WORDS + " fn var pub comptime defer errdefer orelse usingnamespace test union error undefined"),
    "perl": ("#", None, "\"'", "my our local sub use package if elsif else unless while until for foreach return last next and or not undef"),
    "lua": ("--", None, "\"'", "local function end if then elseif else for while do repeat until return break in and or not nil true false"),
    "haskell": ("--", ("{-", "-}"), "\"", "module import where let in case of do if then else data type newtype class instance deriving qualified as"),
    "elixir": ("#", None, "\"'", "def defp defmodule do end if else unless case cond when fn use import alias require true false nil and or not in"),
    "r": ("#", None, "\"'", "function if else for while repeat return next break in TRUE FALSE NULL NA Inf library"),
    "powershell": ("#", ("<#", "#>"), "\"'", "function param if else elseif foreach for while switch return try catch finally throw begin process end"),
    "toml": ("#", None, "\"'", "true false"),
    "ini": (";", None, "\"'", ""),
    "dockerfile": ("#", None, "\"'", "FROM RUN CMD COPY ADD ENV ARG WORKDIR EXPOSE ENTRYPOINT VOLUME USER LABEL AS"),
    "makefile": ("#", None, "\"'", "ifeq ifneq ifdef ifndef else endif include define endef export"),
}
ALIASES = {"js": "javascript", "ts": "javascript", "typescript": "javascript", "py": "python", "rb": "ruby", "sh": "shell", "bash": "shell", "zsh": "shell", "rs": "rust", "golang": "go", "c++": "c", "cpp": "c", "h": "c", "objc": "c", "cs": "csharp", "kt": "kotlin", "yml": "yaml", "pl": "perl", "hs": "haskell", "ex": "elixir", "ps1": "powershell", "docker": "dockerfile", "make": "makefile", "sc": "scala", "patch": "diff"}
#: Languages whose words count in any case.
FOLDED = {"sql", "powershell"}


def canonical(language: Column) -> Column:
    name = F.lower(F.coalesce(language, F.lit("")))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair]), name), name)


def _pattern(line: str | None, block: tuple[str, str] | None, quotes: str) -> str:
    """Matches that together are any text: comments, strings, numbers, words, and what is between them."""
    rules = [re.escape(block[0]) + f".*?(?:{re.escape(block[1])}|\\z)"] if block else []
    rules += [re.escape(line) + "[^\\n]*"] if line else []
    for q in quotes:
        inside = r"[^\\" + q + ("" if q == "`" else r"\n") + "]*+"
        rules.append(rf"{q}{inside}(?:\\.{inside})*+{q}?")
    return "(?sU)" + "|".join([*rules, r"\d[\w.]*", r"[^\W\d]\w*", r"\s+", "."])


def languages(blocks: DataFrame) -> DataFrame:
    """name, pattern, marks (how comments begin), quotes, words, folded: the fixed table of languages; in diffs each line is a piece."""
    rows = [(name, _pattern(line, block, quotes), [m for m in (line, block[0] if block else None) if m], quotes, words.split(), name in FOLDED) for name, (line, block, quotes, words) in LANGUAGES.items()]
    return blocks.sparkSession.createDataFrame([*rows, ("diff", r"[^\n]+|\n", [], "", [], False)], "name string, pattern string, marks array<string>, quotes string, words array<string>, folded boolean")


def _class(piece: Column) -> Column:
    first, starts = F.substring(piece, 1, 1), lambda *marks: F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: F.startswith(piece, m))
    of_diff = F.when(starts("+++", "---", "@@"), F.lit("comment")).when(starts("+"), F.lit("added")).when(starts("-"), F.lit("removed"))
    word = F.when(F.array_contains("words", F.when(F.col("folded"), F.lower(piece)).otherwise(piece)), F.lit("keyword")).when(first != F.lower(first), F.lit("type"))
    of_code = F.when(F.exists("marks", lambda m: F.startswith(piece, m)), F.lit("comment")).when(F.instr(F.col("quotes"), first) > 0, F.lit("string")).when(first.rlike(r"(?U)^\d"), F.lit("number")).when(first.rlike(r"(?U)^\w"), word)
    return F.when(F.col("name") == "diff", of_diff).otherwise(of_code)


def highlighted(blocks: DataFrame, id_col: str, code_col: str, language_col: str) -> DataFrame:
    """A row per coloured range (start, end in code points, class) of each code block. Unknown languages, null and empty code have none; rows with one id
    are blocks of their own."""
    rows = blocks.select(F.col(id_col), F.col(code_col).alias("_code"), canonical(F.col(language_col)).alias("_name")).where("_code is not null").withColumn("_row", F.monotonically_increasing_id())
    known = rows.join(F.broadcast(languages(blocks)), F.col("_name") == F.col("name"))
    pieces = known.select(id_col, "_row", "name", "marks", "quotes", "words", "folded", F.posexplode(F.regexp_extract_all("_code", F.col("pattern"), F.lit(0))).alias("_at", "_piece"))
    length = F.length("_piece")
    until = F.sum(length).over(Window.partitionBy("_row").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    placed = pieces.select(id_col, "_row", "_at", length.alias("_n"), until.cast("int").alias("end"), _class(F.col("_piece")).alias("class"), "_piece")
    return placed.where("class is not null").select(id_col, (F.col("end") - F.col("_n")).cast("int").alias("start"), "end", "class")
