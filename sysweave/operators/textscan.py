"""Scans of texts for SQL, URLs, identifiers, paths, connection strings and words."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sysweave.model import triples

# Characters of a query and the three statement patterns.
QUERY_CHARS = r"[ ,a-z_0-9\.='\"\+\-\*\$\(\)%]*"
SQL_PATTERNS = {
    "SELECT": rf"select\s+{QUERY_CHARS}\s+from\s+{QUERY_CHARS}",
    "INSERT": rf"insert\s+{QUERY_CHARS}\s+into\s+{QUERY_CHARS}",
    "UPDATE": rf"update\s+{QUERY_CHARS}\s+set\s+{QUERY_CHARS}",
}
#: Every character one of these statements can hold.
SQL_CHARS = r"[ ,a-zA-Z_0-9\.='\"\+\-\*\$\(\)%\s]"
URL_PATTERN = r"https?://[a-z_0-9\.]+"
GUID_PATTERN = r"\{[0-9A-F]{8}-[0-9A-F]{4}-[0-9A-F]{4}-[0-9A-F]{4}-[0-9A-F]{12}\}"
WORD_PATTERN = r"[a-zA-Z0-9]{5,}"
LINUX_PATH_PART = r"/[-a-zA-Z0-9\._\+]{3,50}"
WINDOWS_DRIVE = r"[^a-zA-Z][A-Z]:"
WINDOWS_PART = r'[/\\](?:[^\\/<>:"\|\*\?]+[^. ]|\.\.|\.)'
WINDOWS_DROP = r"""[^-_= \t/\\:@.#%$"'!?a-zA-Z0-9]"""


def find_sql_column(text: Column) -> Column:
    """Array of (kind, text) of the statements in a text."""
    return F.flatten(F.array(*[_statements(text, k, p) for k, p in SQL_PATTERNS.items()]))


def _statements(text: Column, kind: str, pattern: str) -> Column:
    found = F.regexp_extract_all(text, F.lit("(?i)" + pattern), F.lit(0))
    return F.transform(found, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("text")))


def find_sql(df: DataFrame, col: str = "text", source: str = "source", per_line: bool = False):
    """(source, kind, text) of SQL statements; one row per find."""
    text = F.coalesce(F.col(col), F.lit(""))
    if per_line:
        df = df.select(source, F.explode(F.split(text, r"\r?\n")).alias(col))
        text = F.col(col)
    return df.select(source, F.explode(find_sql_column(text)).alias("h")).select(source, "h.*")


def clean_sql(
    hits: DataFrame, source: str = "source", col: str = "text", min_length: int = 1
) -> DataFrame:
    """Split at runs of Z, as left by memory fill; empty pieces, or those under
    ``min_length`` characters, are no queries."""
    pieces = hits.select(source, F.explode(F.split(col, "ZZZ*")).alias("query"))
    return pieces.where(F.length("query") >= min_length).distinct()


def find_urls(df: DataFrame, col: str = "text", source: str = "source") -> DataFrame:
    """Distinct (source, url, plausible); a last label of more than four characters
    may be broken off, and such a URL is not plausible."""
    hits = df.select(
        source, F.explode(F.regexp_extract_all(col, F.lit(URL_PATTERN), F.lit(0))).alias("url")
    )
    plausible = F.length(F.substring_index("url", ".", -1)) <= 4
    return hits.distinct().withColumn("plausible", plausible)


def find_guids(df: DataFrame, col: str = "text", source: str = "source") -> DataFrame:
    return df.select(
        source, F.explode(F.regexp_extract_all(col, F.lit(GUID_PATTERN), F.lit(0))).alias("guid")
    ).distinct()


def find_paths(
    df: DataFrame, col: str = "text", source: str = "source", min_depth: int = 3,
    dialect: str = "linux",
) -> DataFrame:
    """Distinct (source, path) of plausible file names, at least ``min_depth`` parts deep."""
    if dialect == "linux":
        pattern = LINUX_PATH_PART * min_depth
        return df.select(
            source, F.explode(F.regexp_extract_all(col, F.lit(pattern), F.lit(0))).alias("path")
        ).distinct()
    # The first character only tells that no word continues into the drive letter.
    pattern = WINDOWS_DRIVE + WINDOWS_PART * (min_depth + 1)
    raw = df.select(
        source, F.explode(F.regexp_extract_all(col, F.lit(pattern), F.lit(0))).alias("path")
    )
    cut = F.substring_index(F.substr("path", F.lit(2)), "\x00", 1)
    # A list of paths is split before the characters no path has are dropped.
    parts = F.transform(F.split(cut, ";"), lambda p: F.regexp_replace(p, WINDOWS_DROP, ""))
    return raw.select(source, F.explode(parts).alias("path")).where("path <> ''").distinct()


# Keys of connection strings with the pattern of their value.
_FLAG = "[a-zA-Z01]*"
_USER = r"\w+"
_SECRET = '([^ "=;]*|"[^"]*")'
_HEX = "[0-9a-fA-F]+"
_NUMBER = r"\d+"
_ALPHA = "[a-zA-Z]+"
_ANY = "[^=]+"
_FILE = r"[^;=]+"
_ORACLE = r"\([^;]*\)"
DSN_KEYS = {
    "ALLOWBATCH": _FLAG,
    "ALLOWUSERVARIABLES": _FLAG,
    "ALLOWZERODATETIME": _FLAG,
    "ATTACHDBFILENAME": _FILE,
    "AUTOENLIST": _FLAG,
    "CACHESERVERPROPERTIES": _FLAG,
    "CACHETYPE": _ALPHA,
    "CERTIFICATE STORE LOCATION": _USER,
    "CERTIFICATE THUMBPRINT": _HEX,
    "CERTIFICATEFILE": _FILE,
    "CERTIFICATEPASSWORD": _SECRET,
    "CHARSET": r"\w+",
    "CHECKPARAMETERS": _FLAG,
    "COMMAND LOGGING": _FLAG,
    "CONNECTION ?LIFETIME": _NUMBER,
    "CONNECTION TIMEOUT": _NUMBER,
    "CONNECTIONRESET": _FLAG,
    "CONNECTIONTYPE": r"[a-zA-Z]+",
    "CONVERTZERODATETIME": _FLAG,
    "DATA SOURCE": rf"([^\(]{_FILE}|{_ORACLE})",
    "DATABASE": "[ a-zA-Z0-9._]+",
    "DB": r"[a-zA-Z0-9\._]*",
    "DBA PRIVILEGE": "[a-zA-Z0-9_]*",
    "DBQ": _FILE,
    "DECR POOL SIZE": _NUMBER,
    "DEFAULT COMMAND TIMEOUT": _NUMBER,
    "DEFAULTTABLECACHEAGE": _NUMBER,
    "DRIVER": r"(\{[^}]*\}|[a-zA-Z0-9 ]+)",
    "DSN": r"\w+",
    "ENCRYPT": _FLAG,
    "EXCLUSIVE": _FLAG,
    "EXTENDEDANSISQL": _FLAG,
    "EXTENDED PROPERTIES": '"[^"]*"',
    "EXTENSIONS": r"[a-zA-Z0-9,]+",
    "FILEDSN": _FILE,
    "HOST": r"[0-9\.]+",
    "IGNORE PREPARE": _FLAG,
    "INCR POOL SIZE": _NUMBER,
    "INITIAL CATALOG": "[a-zA-Z0-9_ ]+",
    "INTEGRATED SECURITY": _FLAG,
    "JET OLEDB:DATABASE PASSWORD": _SECRET,
    "KEEPALIVE": _NUMBER,
    "LOCALE IDENTIFIER": r"\d+",
    "LOAD BALANCING": _FLAG,
    "MAX POOL SIZE": _NUMBER,
    "MIN POOL SIZE": _NUMBER,
    "MAXIMUMPOOLSIZE": _NUMBER,
    "MINIMUMPOOLSIZE": _NUMBER,
    "MODE": "[a-zA-Z ]+",
    "NETWORK LIBRARY": "[a-zA-Z ]+",
    "ODBCKEY[12]": _ANY,
    "OLDGUIDS": _FLAG,
    "OLEDBKEY[12]": _ANY,
    "OPTION": _ANY,
    "OSAUTHENT": _FLAG,
    "PASSWORD": _SECRET,
    "PERSIST SECURITY INFO": _FLAG,
    "PIPENAME": r"\w+",
    "POOLING": _FLAG,
    "PORT": r"\d+",
    "PROCEDURECACHESIZE": _NUMBER,
    "PROTOCOL": r"\w+",
    "PROVIDER": "[ a-zA-Z0-9._]+",
    "PWD": _SECRET,
    "REMOTE SERVER": _ANY,
    "SERVER": rf"([- a-zA-Z0-9\._\\#:]+|\(localdb\)\\[0-9a-zA-Z\.\\]*|{_ORACLE})",
    "SHARED MEMORY NAME": r"\w+",
    "SOCKET": _ANY,
    "SQLSERVERMODE": _FLAG,
    "SSLCERT": _FILE,
    "SSLKEY": _FILE,
    "SSLMODE": r"\w+",
    "SSLVERIFY": _FLAG,
    "STMT": _ANY,
    "SYSTEMDB": _ANY,
    "TABLECACHE": _FLAG,
    "TRUSTED_CONNECTION": _FLAG,
    "UID": _USER,
    "USEAFFECTEDROWS": _FLAG,
    "USECOMPRESSION": _FLAG,
    "USER": _USER,
    "USER ID": _USER,
    "USEPERFORMANCEMONITOR": _FLAG,
    "USEPROCEDUREBODIES": _FLAG,
    "USEUSAGEADVISOR": _FLAG,
}
# The keys met most often.
COMMON_DSN_KEYS = [
    "DATA SOURCE", "DATABASE", "DB", "DRIVER", "DSN", "PROTOCOL", "PROVIDER", "PWD",
    "REMOTE SERVER", "SERVER", "SHARED MEMORY NAME", "SOCKET", "SQLSERVERMODE",
    "TRUSTED_CONNECTION", "UID", "USER", "USER ID",
]


def dsn_pattern(keys=None) -> str:
    return "|".join(f"[; ]*{key} *= *{DSN_KEYS[key]} *" for key in (keys or DSN_KEYS))


def find_dsn(
    df: DataFrame, col: str = "text", source: str = "source", keys=None, glue: bool = True
) -> DataFrame:
    """(source, offset, dsn): key=value tokens, tokens that touch each other as one.

    Built-in functions give matches without offsets, so this one scan is an
    Arrow function over whole texts. A text without an equal sign holds no token
    and is not sent to Python.
    """
    pattern = re.compile(dsn_pattern(keys), re.IGNORECASE)

    @F.pandas_udf("array<struct<offset:bigint,dsn:string>>")
    def tokens(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: _tokens(pattern, text, glue))

    maybe = df.where(F.instr(col, "=") > 0)
    return maybe.select(source, F.explode(tokens(F.col(col))).alias("t")).select(source, "t.*")


def _tokens(pattern: re.Pattern, text: str, glue: bool) -> list[dict]:
    found: list[dict] = []
    end = None
    for hit in pattern.finditer(text):
        if glue and hit.start() == end:
            found[-1]["parts"].append(hit.group())
        else:
            found.append({"offset": hit.start(), "parts": [hit.group()]})
        end = hit.end()
    return [{"offset": f["offset"], "dsn": "".join(f["parts"])} for f in found]


def find_words(
    df: DataFrame, col: str = "text", source: str = "source", regex: str = WORD_PATTERN,
    max_hits: int | None = None,
) -> DataFrame:
    """(source, line, hit, word): matches per line, lines and hits counted from 1.

    A row is the text of one source. ``max_hits`` makes a report of the first
    so many of each source. Numbering happens inside the row, without a shuffle.
    """
    lines = F.transform(
        F.split(F.col(col), r"\r?\n"),
        lambda line, n: F.transform(
            F.regexp_extract_all(line, F.lit(regex), F.lit(0)),
            lambda word: F.struct((n + 1).alias("line"), word.alias("word")),
        ),
    )
    hits = F.flatten(lines)
    if max_hits is not None:
        hits = F.slice(hits, 1, max_hits)
    return df.select(source, F.posexplode(hits).alias("k", "h")).select(
        source, "h.line", (F.col("k") + 1).alias("hit"), "h.word"
    )


def hits_to_triples(hits: DataFrame, source_node: Column, predicate, col: str) -> DataFrame:
    """Finds as facts about the object they were found in."""
    return triples(hits, source_node, predicate, F.col(col))
