"""Tokens and labels of node names, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Substrings of process names by kind, in order of the kinds.
SYSTEM_PROCESSES = (
    "systemd", "cron", "sshd", "pg_isready_22727", "pg_isready_8172", "apparmor_parser_22734", "apparmor_parser_22732",
    "apparmor_parser_22726", "apparmor_parser_22768", "apparmor_parser_22769", "docker-runc", "apt-get", "apt-key", "man-db",
    "update-motd-reb", "apt.systemd.dai", "unshadow", "update-motd-fsc", "runc:[1:child]",
)
PROGRAM_PROCESSES = (
    "python", "python3", "bash", "sh", "wget", "curl", "ssh", "scp", "top", "which", "cat", "grep", "sed", "cut", "echo", "ls", "mv", "cp",
    "ping", "unzip", "bzip2", "solc", "solc-v0.5.11", "powershell.exe", "john", "mesg", "dumpe2fs", "release-upgrade", "gpg", "gpgv", "gdbus",
)
USER_PROCESSES = (
    "firefox", "fluxbox", "entrypoint.sh", "setup.sh", "run.sh", "00-header", "10-help-text", "50-motd-news", "90-updates-avai", "97-overlayroot",
)
# Substrings of file names and their labels, in order.
FILE_LABELS = (("sys", "system_file"), ("lib", "lib_file"), ("proc", "proc_file"), ("tmp", "temp_file"), ("usr", "user_file"))
# Ids of the words of label sequences.
LABEL_IDS = {
    "system_file": 1, "lib_file": 2, "proc_file": 3, "temp_file": 4, "user_file": 5, "other_file": 6, "system_process": 7,
    "program_process": 8, "user_process": 9, "lib_process": 10, "ip_address": 11, "execve": 12, "clone": 13, "write": 14,
    "read": 15, "recvfrom": 16, "write_vector": 17, "sendto": 18, "recvmsg": 19,
}


def _none() -> Column:
    return F.array().cast("array<string>")


def _parts(text: Column, mark: str) -> Column:
    return F.split(text, {"\\": r"\\", "/": "/", "_": "_", ":": ":", ".": r"\."}[mark])


def _without_empty_head(parts: Column) -> Column:
    return F.when(F.element_at(parts, 1) == "", F.slice(parts, 2, F.size(parts))).otherwise(parts)


def process_tokens(name: Column) -> Column:
    """struct(tokens, flag). Names with an underscore only (else flag 3).

    Path components, the last of which gives what is before and after its first
    underscore, or nothing (flag 1 for backslashes, 2 for slashes); without a
    path the parts between underscores. An empty component before a first slash
    is left out.
    """

    def path(mark: str, flag: int) -> Column:
        parts = _parts(name, mark)
        head = F.slice(parts, 1, F.size(parts) - 1)
        head = F.when(F.size(head) > 0, _without_empty_head(head)).otherwise(head) if mark == "/" else head
        last = F.element_at(parts, -1)
        good = last.contains("_")
        return F.struct(F.when(good, F.concat(head, F.slice(_parts(last, "_"), 1, 2))).otherwise(head).alias("tokens"), F.when(good, 0).otherwise(flag).alias("flag"))

    plain = F.struct(_parts(name, "_").alias("tokens"), F.lit(0).alias("flag"))
    nothing = F.struct(_none().alias("tokens"), F.lit(3).alias("flag"))
    return F.when(~name.contains("_"), nothing).when(name.contains("\\"), path("\\", 1)).when(name.contains("/"), path("/", 2)).otherwise(plain)


def socket_tokens(name: Column) -> Column:
    """struct(tokens, flag) of ``source->destination``.

    Each side gives four octets and a port, or the octets of a bare address (as
    many as the source has, for the destination), or address and port where it
    contains ``null``. Flag 2 without an arrow, 1 with several, 3 for a side
    that is cut short; the tokens are then empty.
    """
    sides = F.split(name, "->")
    src, dst = F.try_element_at(sides, F.lit(1)), F.try_element_at(sides, F.lit(2))

    def octets(side: Column) -> Column:
        return _parts(F.try_element_at(_parts(side, ":"), F.lit(1)), ".")

    def side(x: Column, bare: Column | None) -> Column:
        parts = _parts(x, ":")
        port = F.try_element_at(parts, F.lit(2))
        null = F.when(F.size(parts) >= 2, F.slice(parts, 1, 2))
        full = F.when(F.size(octets(x)) >= 4, F.concat(F.slice(octets(x), 1, 4), F.array(port)))
        alone = _parts(x, ".") if bare is None else F.when(F.size(_parts(x, ".")) >= bare, F.slice(_parts(x, "."), 1, bare))
        return F.when(x.contains("null"), null).when(x.contains(":"), full).otherwise(alone)

    many = F.when(src.contains("null"), F.lit(None).cast("int")).otherwise(F.greatest(F.size(octets(src)), F.lit(1)))
    both = F.concat(side(src, None), side(dst, many))
    flag = F.when(F.size(sides) < 2, 2).when(F.size(sides) > 2, 1).when(both.isNull(), 3).otherwise(0)
    return F.struct(F.when(flag == 0, both).otherwise(_none()).alias("tokens"), flag.alias("flag"))


def file_tokens(name: Column) -> Column:
    """struct(tokens, flag): components by backslash, else slash (an empty first one left out), else colon, else none."""
    parts = F.when(name.contains("\\"), _parts(name, "\\")).when(name.contains("/"), _without_empty_head(_parts(name, "/"))).when(name.contains(":"), _parts(name, ":")).otherwise(_none())
    return F.struct(parts.alias("tokens"), F.lit(0).alias("flag"))


def node_tokens(name: Column, kind: Column) -> Column:
    """struct(tokens, flag) by node type; flag 4 for other types; empty names have no tokens."""
    nothing = lambda flag: F.struct(_none().alias("tokens"), F.lit(flag).alias("flag"))
    return F.when(name == "", nothing(0)).when(kind == "process", process_tokens(name)).when(kind == "socket", socket_tokens(name)).when(kind == "file", file_tokens(name)).otherwise(nothing(4))


def _contains_any(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(p) for p in parts))


def node_label(kind: Column, name: Column) -> Column:
    """The label of a node: by substring of its lower-cased name for files and processes, else an address."""
    text = F.trim(F.lower(name))
    file = reduce(lambda found, x: found.when(text.contains(x[0]), x[1]), FILE_LABELS[1:], F.when(text.contains(FILE_LABELS[0][0]), FILE_LABELS[0][1])).otherwise("other_file")
    process = F.when(_contains_any(text, SYSTEM_PROCESSES), "system_process").when(_contains_any(text, PROGRAM_PROCESSES), "program_process").when(_contains_any(text, USER_PROCESSES), "user_process").otherwise("lib_process")
    return F.when(kind == "file", file).when(kind == "process", process).otherwise("ip_address")


def label_ids(text: Column) -> Column:
    """Ids of the words of a label sequence; unknown words are left out."""
    ids = F.create_map(*[F.lit(x) for pair in LABEL_IDS.items() for x in pair])
    return F.filter(F.transform(F.split(text, " "), lambda w: ids[w]), lambda i: i.isNotNull())


def padded(ids: Column, length: int = 400) -> Column:
    """The first ``length`` ids, zeros after the last."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(0), length)), 1, length)


def positional_similarity(a: Column, b: Column) -> Column:
    """1 less the share of positions, of the longer list, that differ; null for two empty lists."""
    longer = F.greatest(F.size(a), F.size(b))
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda n, x: n + x)
    return F.lit(1.0) - F.try_divide((longer - same).cast("double"), longer.cast("double"))
