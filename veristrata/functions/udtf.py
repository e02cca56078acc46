"""Extractors as table functions for SQL: `SELECT ... FROM files, LATERAL extract_symbols(path, language, text)`."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import UserDefinedTableFunction

from . import extract as ex

_COLUMNS = {
    "ord": IntegerType(), "name": StringType(), "qualified_name": StringType(), "kind": StringType(), "signature": StringType(), "start_line": IntegerType(), "end_line": IntegerType(), "exported": BooleanType(), "error": StringType(),
    "version": StringType(), "owner": StringType(), "parameters": ArrayType(StringType()),
}
#: What a call gives without `columns`, and what more it gives where the language is a constant that has it.
SYMBOL_COLUMNS = ("ord", "name", "qualified_name", "kind", "signature", "start_line", "end_line", "exported", "error")
MORE = {"manifest": ("version",), "python": ("owner", "parameters"), "go": ("owner",), "typescript": ("owner",), "rust": ("owner",)}


def _owner(row: dict) -> str | None:
    """The type that a method belongs to: the last but one part of its qualified name."""
    parts = (row["qualified_name"] or "").split(".")
    return parts[-2] if row["kind"] == "method" and len(parts) > 1 else None


def _parameters(row: dict) -> list[str] | None:
    """The names between the parentheses of a signature."""
    signature = row["signature"] or ""
    if "(" not in signature or not signature.endswith(")"):
        return None
    inside = signature[signature.index("(") + 1 : -1]
    return [p.strip() for p in inside.split(",") if p.strip()]


def _version(row: dict) -> str | None:
    """What a dependency's signature says after its name, which may begin with an @ of its own."""
    shown = (row["signature"] or "").removeprefix("dependency ").removesuffix(" (indirect)")
    at = shown.find("@", 1)
    return shown[at + 1 :] if row["kind"] == "dependency" and at > 0 else None


_DERIVED = {"owner": _owner, "parameters": _parameters, "version": _version}


class ExtractSymbols:
    """extract_symbols(path, language, text [, columns => 'name,kind']): a row for each declaration of a file.

    Its columns depend on the call: `columns`, a constant, names them; without it they are those of a symbol, and where
    the language is a constant also what that language has (a manifest's versions, a method's owner, parameters). A null
    or unknown language, and a text without declarations, have no rows; one that does not parse has one row with its error.
    """

    @staticmethod
    def analyze(path: AnalyzeArgument, language: AnalyzeArgument, text: AnalyzeArgument, columns: AnalyzeArgument | None = None) -> AnalyzeResult:
        for name, arg in (("path", path), ("language", language), ("text", text)):
            if arg.isTable or not isinstance(arg.dataType, StringType) and arg.dataType.typeName() != "void":
                raise ValueError(f"{name} must be a string")
        names = list(SYMBOL_COLUMNS)
        if columns is not None:
            if not columns.isConstantExpression or not columns.value:
                raise ValueError("columns must be a constant list of names")
            names = [c.strip() for c in columns.value.split(",")]
        elif language.isConstantExpression:
            names += MORE.get(language.value, ())
        unknown = [n for n in names if n not in _COLUMNS]
        if unknown or len(set(names)) != len(names):
            raise ValueError(f"columns must be some of {', '.join(_COLUMNS)}, each once")
        return AnalyzeResult(StructType([StructField(n, _COLUMNS[n]) for n in names]))

    def __init__(self, analyzed: AnalyzeResult | None = None):
        self.names = [f.name for f in analyzed.schema.fields] if analyzed else list(SYMBOL_COLUMNS)

    def eval(self, path: str, language: str, text: str, columns: str | None = None):
        for k, row in enumerate(ex.symbols_of(path or "", text, language)):
            row = row | {"ord": k}
            yield tuple(_DERIVED[n](row) if n in _DERIVED else row[n] for n in self.names)


class ScriptBlocks:
    """script_blocks(text): (lines, content) of the script blocks of a component or page, outside comments."""

    def eval(self, text: str):
        yield from ex.script_blocks(text or "")


def register(spark: SparkSession) -> None:
    """Make the table functions known to a session's SQL."""
    spark.udtf.register("extract_symbols", UserDefinedTableFunction(ExtractSymbols, returnType=None, name="extract_symbols"))
    spark.udtf.register("script_blocks", UserDefinedTableFunction(ScriptBlocks, returnType="lines int, content string", name="script_blocks"))
