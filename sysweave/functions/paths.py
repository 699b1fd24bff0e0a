"""Paths, file descriptors, endpoints and open modes, as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that are not files of the file system.
STANDARD_STREAMS = ["stdin", "stdout", "stderr"]
NON_FILE_PREFIXES = [
    "pipe:[", "TCP:", "TCPv6:[", "anon_inode:[", "NETLINK:[", "UDP:[", "UNIX:[", "UDPv6:",
    "/dev/", "/proc/",
]
UNKNOWN_DESCRIPTOR = "UnknownFileDescr"

# Ordered categories, each a pattern anchored at the start.
CATEGORIES = [
    ("Shared libraries",
     r"^(/usr/lib[^/]*/.*\.so|/var/lib[^/]*/.*\.so|/lib/.*\.so|/lib64/.*\.so)"),
    ("System config files",
     r"^(/etc/|/usr/share/fonts/|/usr/share/fontconfig/|/usr/share/locale/|/usr/share/zoneinfo/)"),
    ("Other libraries", r"^(/usr/share/|/usr/lib/|/usr/lib64/|/var/lib/|/var/lib64/)"),
    ("System executables", r"^(/bin/|/usr/bin/|/usr/bin64/)"),
    ("Kernel file systems", r"^(/proc|/run)"),
    ("Temporary files", r"^(/tmp/|/var/log/|/var/cache/)"),
    ("Pipes and terminals", r"^(/sys|/dev|pipe:|socket:|UNIX:|NETLINK:)"),
    ("Connected TCP sockets", r"^(TCP:\[.*->.*\]|TCPv6:\[.*->.*\])"),
    ("Other TCP/IP sockets", r"^(TCP:|TCPv6:|UDP:|UDPv6:)"),
]
DEFAULT_CATEGORY = "Others"

# Paths hidden because they say little about a process.
FONT_AND_LOCALE_PREFIXES = [
    "/usr/share/locale/", "/usr/share/fonts/", "/etc/locale/", "/var/cache/fontconfig/",
    "/usr/lib/jvm/",
]
SHARED_LIBRARY = r"(?i)^(/lib/.*\.so\..*|/usr/lib/.*\.so\..*)"
MAP_PREFIXES = [
    "/usr/share/locale/", "/usr/share/fonts/", "/etc/locale/", "/var/cache/fontconfig/",
    "/usr/bin/perl",
]
MAP_NAMES = [
    "/usr/bin/kdeinit", "/bin/bash", "/usr/lib/gconv/gconv-modules.cache",
    "[stack]", "[vdso]", "[heap]", "[anon]",
]
MAP_PATTERNS = (
    r"(?i)^(.*/lib/.*\.so\..*|/var/tmp/kdecache-.*/ksycoca|/home/.*/.local/share/mime/mime.cache)"
)

# Integer open flags a library tracer prints.
READ_FLAGS = ["0x80000", "0x90800", "0", "0x100"]
WRITE_FLAGS = ["0x241", "0x242", "0x441", "0x802", "0xc2"]


def starts_with_any(path: Column, prefixes) -> Column:
    return reduce(or_, [path.startswith(p) for p in prefixes])


def is_plain_file(path: Column) -> Column:
    return ~starts_with_any(path, NON_FILE_PREFIXES)


def normalise_path(path: Column, cwd: Column) -> Column:
    """Absolute path without ``.`` and ``..``; names that are no files stay as they are."""
    slashed = F.translate(path, "\\", "/")
    full = F.when(slashed.startswith("/"), slashed).otherwise(
        F.concat_ws("/", F.translate(cwd, "\\", "/"), slashed)
    )
    up = F.lit("..")
    parts = F.aggregate(
        F.split(full, "/"),
        F.array().cast("array<string>"),
        lambda kept, part: F.when(part.isin("", "."), kept)
        .when(part == up, F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
        .otherwise(F.concat(kept, F.array(part))),
    )
    absolute = F.concat(F.lit("/"), F.array_join(parts, "/"))
    untouched = (
        path.isin(STANDARD_STREAMS)
        | starts_with_any(path, NON_FILE_PREFIXES)
        | path.startswith(UNKNOWN_DESCRIPTOR)
    )
    return F.when(untouched, path).otherwise(absolute)


def path_category(path: Column) -> Column:
    first, *others = CATEGORIES
    out = F.when(path.rlike(first[1]), F.lit(first[0]))
    for name, pattern in others:
        out = out.when(path.rlike(pattern), F.lit(name))
    return out.otherwise(DEFAULT_CATEGORY)


def is_shared_library(path: Column) -> Column:
    return (
        path.endswith(".so")
        | path.rlike(SHARED_LIBRARY)
        | starts_with_any(path, FONT_AND_LOCALE_PREFIXES)
    )


def is_font_file(path: Column) -> Column:
    return starts_with_any(path, FONT_AND_LOCALE_PREFIXES)


def is_noise_path(path: Column, libraries: bool = True, fonts: bool = True) -> Column:
    noise = F.lit(False)
    if libraries:
        noise = noise | is_shared_library(path)
    if fonts:
        noise = noise | is_font_file(path)
    return noise


def is_noise_map(path: Column) -> Column:
    """The second list, for memory maps."""
    return (
        path.endswith(".so")
        | starts_with_any(path, MAP_PREFIXES)
        | path.isin(MAP_NAMES)
        | path.rlike(MAP_PATTERNS)
    )


def fd_to_path(fd: Column, in_force: Column | None = None) -> Column:
    """``3</path>`` to its path; a bare descriptor through the table of open files."""
    named = F.regexp_extract(fd, r"^[^<]*<(?s:(.*)).$", 1)
    known = (
        F.when(fd == "0", F.lit("stdin")).when(fd == "1", F.lit("stdout")).when(fd == "2", "stderr")
    )
    opened = F.coalesce(in_force, known) if in_force is not None else known
    return (
        F.when(F.instr(fd, "<") > 0, named)
        .when(opened.isNotNull(), opened)
        .when(fd == "-1", F.lit("Invalid device"))
        .otherwise(F.concat(F.lit(UNKNOWN_DESCRIPTOR + ":"), fd))
    )


def socket_destination(path: Column) -> Column:
    """Far end of a connected socket name, ``host:port``, else null."""
    end = F.regexp_extract(path, r"^TCP(?:v6)?:\[.*->(.*)\]", 1)
    return F.when(path.rlike(r"^TCP(v6)?:\[.*->.*\]"), end)


def destination(path: Column) -> Column:
    end = socket_destination(path)
    return F.regexp_replace(end, r":[^:]*$", "")


def port(path: Column) -> Column:
    end = socket_destination(path)
    return F.when(F.instr(end, ":") > 0, F.substring_index(end, ":", -1))


def endpoint_host(text: Column) -> Column:
    """Host of ``host:port`` or ``[v6]:port``; ``%`` becomes ``_``; no colon gives empty."""
    host = F.regexp_replace(text, r":[^:]*$", "")
    bare = F.when(host.startswith("["), F.regexp_replace(host, r"^\[|.$", "")).otherwise(host)
    return F.when(F.instr(text, ":") > 0, F.translate(bare, "%", "_")).otherwise("")


def endpoint_port(text: Column) -> Column:
    return F.when(F.instr(text, ":") > 0, F.substring_index(text, ":", -1)).otherwise("0")


def open_mode(flag: Column) -> Column:
    """``R`` or ``W``; null for a flag nobody knows."""
    return (
        F.when(flag.isNull() | flag.startswith("????") | flag.isin(READ_FLAGS), F.lit("R"))
        .when(flag.isin(WRITE_FLAGS), F.lit("W"))
        .when(flag.contains("O_RDONLY"), F.lit("R"))
        .when(flag.contains("O_RDWR") | flag.contains("O_WRONLY"), F.lit("W"))
    )
