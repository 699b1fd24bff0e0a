"""Literal casts, escapes, connection strings, file extensions, labels."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Literal type names by the XSD type they stand for.
TYPE_NAMES = {
    "boolean": ["boolean", "Boolean", "xsd:boolean"],
    "string": ["string", "String", "xsd:string"],
    "integer": ["uint8", "uint16", "sint32", "uint32", "Uint32", "integer", "xsd:integer"],
    "long": ["uint64", "Uint64", "long", "xsd:long"],
    "dateTime": ["datetime", "dateTime", "xsd:dateTime"],
    "double": ["double", "xsd:double"],
}

# Extensions of source files that may hold SQL.
SOURCE_EXTENSIONS = [
    ".c", ".cc", ".cxx", ".cpp", ".c++", ".java", ".ii", ".ixx", ".ipp", ".i++",
    ".pc", ".pcc", ".inl", ".idl", ".ddl", ".odl",
    ".h", ".hh", ".hxx", ".hpp", ".h++",
    ".cs", ".d", ".php", ".php4", ".php5", ".phtml", ".inc",
    ".py", ".pyw", ".f90", ".f", ".for", ".tcl", ".as", ".js",
    ".sh", ".csh", ".bash", ".sql", ".pls", ".pks",
]

# Connection-string keys that hold a secret.
SECRET_KEYS = ["CERTIFICATEPASSWORD", "JET OLEDB:DATABASE PASSWORD", "PASSWORD", "PWD"]


def xsd_type(name: Column) -> Column:
    """XSD name of a CIM or XSD type name; unknown ones are strings."""
    out = None
    for xsd, names in TYPE_NAMES.items():
        out = (F if out is None else out).when(name.isin(names), F.lit(xsd))
    return out.otherwise("string")


def cast_literals(triples: DataFrame) -> DataFrame:
    """Typed columns beside the text, filled where the literal's type says so.

    Unsigned 64-bit values do not fit a BIGINT, so integers are DECIMAL(20,0).
    """
    kind = F.when(F.col("o_kind") == "lit", xsd_type(F.col("o_type")))
    text = F.col("o")
    return triples.withColumns(
        {
            "xsd": kind,
            "v_boolean": F.when(kind == "boolean", text.try_cast("boolean")),
            "v_integer": F.when(kind.isin("integer", "long"), text.try_cast("decimal(20,0)")),
            "v_double": F.when(kind == "double", text.try_cast("double")),
            "v_time": F.when(kind == "dateTime", text.try_cast("timestamp")),
        }
    )


# C escapes of one character.
ESCAPES = {
    b"a": b"\a", b"b": b"\b", b"f": b"\f", b"n": b"\n", b"r": b"\r", b"t": b"\t", b"v": b"\v",
    b"\\": b"\\", b"'": b"'", b'"': b'"', b"?": b"?", b"e": b"\x1b",
}
ESCAPE = re.compile(rb"\\([0-7]{1,3}|x[0-9A-Fa-f]{1,2}|.)", re.S)


@F.pandas_udf(T.StringType())
def decode_octal(buffers: pd.Series) -> pd.Series:
    """C escapes of a printed buffer to the text its bytes are in UTF-8.

    An escape that is none, or is cut off, stays as it stands; bytes that are no
    UTF-8 become the replacement character.
    """

    def one(found: re.Match) -> bytes:
        code = found[1]
        if code[:1] == b"x" and len(code) > 1:
            return bytes([int(code[1:], 16)])
        if code.isdigit() and code[:1] < b"8":
            return bytes([int(code, 8) & 255])
        return ESCAPES.get(code, found[0])

    def decode(text):
        return None if text is None else ESCAPE.sub(one, text.encode()).decode("utf-8", "replace")

    return buffers.map(decode)


def dsn_parts(text: Column) -> Column:
    """Connection string to a map, keys upper-cased; the last of equal keys wins."""
    tokens = F.filter(F.split(text, ";"), lambda t: F.instr(t, "=") > 1)
    pairs = F.transform(
        tokens,
        lambda t: F.struct(
            F.upper(F.trim(F.substring_index(t, "=", 1))).alias("key"),
            F.trim(F.substr(t, F.instr(t, "=") + 1)).alias("value"),
        ),
    )
    last_only = F.filter(
        pairs,
        lambda x, i: ~F.exists(
            F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))),
            lambda y: y["key"] == x["key"],
        ),
    )
    return F.map_from_entries(last_only)


def mask_dsn(text: Column, mask: str = "xxx") -> Column:
    """The connection string with its secrets replaced."""
    keys = "|".join(SECRET_KEYS)
    return F.regexp_replace(text, rf'(?i)(^|;)( *(?:{keys}) *= *)("[^"]*"|[^;]*)', f"$1$2{mask}")


def short_dsn(text: Column) -> Column:
    dsn = F.regexp_extract(text, r"(?i)^.*DSN=([^;]+)", 1)
    server = F.regexp_extract(text, r"(?i)^.*SERVER=([^;]+)", 1)
    return F.when(dsn != "", dsn).when(server != "", server).otherwise(text)


def extension(path: Column) -> Column:
    """Extension with its dot; empty for none and for names that only start with dots."""
    base = F.regexp_replace(F.substring_index(path, "/", -1), r"^\.+", "")
    found = F.concat(F.lit("."), F.substring_index(base, ".", -1))
    return F.when(F.instr(base, ".") > 0, found).otherwise("")


def script_files_only(df: DataFrame, col: str = "path") -> DataFrame:
    return df.where(F.lower(extension(F.col(col))).isin(SOURCE_EXTENSIONS))


def plural_label(count: Column, name: Column) -> Column:
    """Display label of a class for a number of objects."""
    tail = F.right(name, F.lit(1))
    return (
        F.when(count == 1, name)
        .when(~tail.rlike(r"\p{L}"), name)
        .when((tail == "s") & (F.length(name) > 1) & ~name.endswith("ss"), name)
        .when(tail == "s", F.concat(name, F.lit("es")))
        .when(tail == "y", F.concat(F.regexp_replace(name, "y$", ""), F.lit("ies")))
        .otherwise(F.concat(name, F.lit("s")))
    )
