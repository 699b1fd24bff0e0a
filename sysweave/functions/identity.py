"""Object identity: node text to host, class and keys, and back."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sysweave.model import PROPERTY_PREFIX

# The three node dialects, the safe charset and the base64 prefix.
LOCAL_NODE = r"^([-0-9A-Za-z_]*\\?[-0-9A-Za-z_\.]*@)?([a-zA-Z_][a-z0-9A-Z_/]*)\.(.*)"
WMI_NODE = r"^(?:\\\\\\?([-0-9A-Za-z_\.]*)\\)?([a-zA-Z0-9_]+\\[^.]*)(\..*)"
WBEM_NODE = r"^(https?://[^/]*)/([^.]*)(\..*)?"
KEY_VALUE_PAIRS = r'(?:[^,"]+|"(?:\\.|[^"\\])*")+'
SAFE_VALUE = r"^[-A-Za-z0-9_/:=\.]*$"
BASE64_PREFIX = "B64_"


def unquote(text: Column) -> Column:
    """Percent-decoding that leaves ``+`` and broken escapes alone."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def encode_value(value: Column) -> Column:
    """Base64 with a prefix, for values that would not survive in a node text."""
    packed = F.regexp_replace(
        F.translate(F.base64(F.encode(value, "UTF-8")), "+/", "-_"), r"[=\s]", ""
    )
    safe = value.rlike(SAFE_VALUE) & ~value.startswith(BASE64_PREFIX)
    return F.when(safe, value).otherwise(F.concat(F.lit(BASE64_PREFIX), packed))


def decode_value(value: Column) -> Column:
    packed = F.translate(F.substr(value, F.lit(len(BASE64_PREFIX) + 1)), "-_", "+/")
    return F.when(
        value.startswith(BASE64_PREFIX), F.decode(F.unbase64(packed), "UTF-8")
    ).otherwise(value)


def split_moniker(text: Column) -> Column:
    """``k1=v1,k2="v,2"`` as a map; the last of two equal keys wins."""

    def pair(token: Column) -> Column:
        at = F.locate("=", token) if isinstance(token, str) else F.instr(token, "=")
        key = F.when(at > 0, F.substr(token, F.lit(1), at - 1)).otherwise(token)
        raw = F.when(at > 0, F.substr(token, at + 1)).otherwise(F.lit(""))
        quoted = (F.length(raw) >= 2) & raw.startswith('"') & raw.endswith('"')
        bare = F.when(quoted, F.substr(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
        return F.struct(key.alias("key"), decode_value(bare).alias("value"))

    pairs = F.transform(F.regexp_extract_all(text, F.lit(KEY_VALUE_PAIRS), F.lit(0)), pair)
    last_only = F.filter(
        pairs,
        lambda x, i: ~F.exists(
            F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))),
            lambda y: y["key"] == x["key"],
        ),
    )
    return F.map_from_entries(last_only)


def parse_nodes(df: DataFrame, col: str = "node") -> DataFrame:
    """Add ``host``, ``cls``, ``keys``; three dialects tried in order, else empty text."""
    raw = F.col(col)
    decoded = unquote(raw)
    is_local = raw.rlike(LOCAL_NODE)
    is_wmi = decoded.rlike(WMI_NODE)
    is_wbem = decoded.rlike(WBEM_NODE)
    part = F.regexp_extract
    host = (
        F.when(is_local, F.regexp_replace(part(raw, LOCAL_NODE, 1), "@$", ""))
        .when(is_wmi, part(decoded, WMI_NODE, 1))
        .when(is_wbem, part(decoded, WBEM_NODE, 1))
        .otherwise("")
    )
    cls = (
        F.when(is_local, part(raw, LOCAL_NODE, 2))
        .when(is_wmi, part(decoded, WMI_NODE, 2))
        .when(is_wbem, part(decoded, WBEM_NODE, 2))
        .otherwise("")
    )
    ident = (
        F.when(is_local, unquote(part(raw, LOCAL_NODE, 3)))
        .when(is_wmi, F.substr(unquote(part(decoded, WMI_NODE, 3)), F.lit(2)))
        .when(is_wbem, F.substr(unquote(part(decoded, WBEM_NODE, 3)), F.lit(2)))
        .otherwise("")
    )
    return df.withColumns(
        {"host": host, "cls": cls, "ident": ident, "keys": split_moniker(ident)}
    )


def make_nodes(df: DataFrame, cls: str, keys: Mapping[str, str | Column], name: str = "node"):
    """Add the node text ``class.k1=v1,k2=v2`` with keys in the given order."""
    return df.withColumn(name, node_text(cls, keys))


def node_text(cls: str, keys: Mapping[str, str | Column]) -> Column:
    pairs = []
    for key, value in keys.items():
        column = value if isinstance(value, Column) else F.col(value)
        pairs.append(F.concat(F.lit(key + "="), encode_value(column.cast("string"))))
    return F.concat(F.lit(cls + "."), F.concat_ws(",", *pairs))


def node_of_integer(cls: str, key: str, value: str | Column) -> Column:
    """Node text for a numeric key, which never needs encoding."""
    column = value if isinstance(value, Column) else F.col(value)
    return F.concat(F.lit(f"{cls}.{key}="), column.cast("string"))


def alias_text(node: Column) -> Column:
    """Identity of an object whatever server named it.

    The host part, either a URL's authority or the text before ``@``, is
    lower-cased and loses its port; URLs are reduced to their ``xid`` argument.
    """
    url = r"^https?://([^/:?]*)[^?]*\?(?:.*&)?xid=([^&]*)"
    is_url = node.rlike(url)
    body = F.when(is_url, unquote(F.regexp_extract(node, url, 2))).otherwise(node)
    named = F.regexp_extract(body, r"^([^@,=]*)@", 1)
    authority = F.when(is_url, F.regexp_extract(node, url, 1)).otherwise("")
    host = F.when(named != "", named).otherwise(authority)
    rest = F.regexp_replace(body, r"^[^@,=]*@", "")
    return F.concat(rest, F.lit("@"), F.lower(F.regexp_replace(host, r":\d+$", "")))


def universal_alias(df: DataFrame, col: str = "node", name: str = "alias") -> DataFrame:
    return df.withColumn(name, alias_text(F.col(col)))


def property_uri(parts, args: Mapping[str, Column] | None = None) -> Column:
    """Parts joined with ``___``, spaces and hyphens to ``_``, prefix in front."""
    text = F.concat_ws("___", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    if args:
        pairs = F.concat_ws("&", *[F.concat(F.lit(k + "="), v) for k, v in args.items()])
        text = F.concat(text, F.lit("?"), pairs)
    return F.concat(F.lit(PROPERTY_PREFIX), F.translate(text, " -", "__"))


def property_name(uri: Column, sort_prefix: str = "----") -> Column:
    """Short name of a property: prefix and arguments off, dots and spaces to ``_``."""
    bare = F.regexp_replace(uri, r"\?[^?]*$", "")
    short = F.translate(F.substring_index(F.substring_index(bare, "#", -1), "/", -1), ". ", "__")
    return F.regexp_replace(short, "^" + sort_prefix, "")


def property_args(uri: Column) -> Column:
    """Arguments after the last ``?`` as a map, null when there are none."""
    tail = F.regexp_extract(uri, r"\?([^?]*)$", 1)
    return F.when(F.instr(uri, "?") > 0, F.str_to_map(tail, F.lit("&"), F.lit("=")))


def clean_uri(text: Column) -> Column:
    # Characters a triple store refuses in a URL.
    for char, escape in [
        (" ", "%20"),
        ("\\", "%5C"),
        ("[", "%5B"),
        ("]", "%5D"),
        ("{", "%7B"),
        ("}", "%7D"),
    ]:
        text = F.replace(text, F.lit(char), F.lit(escape))
    return text


def clean_uris(triples: DataFrame) -> DataFrame:
    return triples.withColumns({"s": clean_uri(F.col("s")), "o": clean_uri(F.col("o"))})
