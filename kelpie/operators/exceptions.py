"""Exceptions as stable signatures (X07, X08): messages without their variable parts, frames without their lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What varies in a message, longer structures first, and the token that takes its place. An integer in a longer
#: number or word is no number; a sign belongs to its number unless a word precedes it.
VARIABLE = [
    (r"[a-zA-Z]:\\[^\s'\"]+\\[^\s'\"]+", "<PATH>"),
    (r"(?<![\w'])/(?:[^\s'\"/]+/)+[^\s'\"]+", "<PATH>"),
    (r"\"[^\"]*\"", "'<STR>'"),
    (r"'[^']*'", "'<STR>'"),
    (r"0x[0-9a-fA-F]+", "<HEX>"),
    (r"(?<![\w.])-?\d+\.\d+(?![\w.])", "<NUM>"),
    (r"(?<![\w.])-?\d+(?![\w.])", "<NUM>"),
]


def canonical_message(c: Column) -> Column:
    """The message with tokens for paths, quoted texts, hexadecimal and other numbers, and single spaces; null stays null."""
    for pattern, token in VARIABLE:
        c = F.regexp_replace(c, pattern, token)
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def frames(text: Column, root: str = "/srv/") -> Column:
    """The frames of the first traceback in a text, outermost first: an array of (module, function). A file's path below `root`
    without its ending is the module."""
    files = F.regexp_extract_all(text, F.lit(r'File "([^"]+)", line \d+, in (\S+)'), 1)
    names = F.regexp_extract_all(text, F.lit(r'File "([^"]+)", line \d+, in (\S+)'), 2)
    module = lambda f: F.translate(F.regexp_replace(F.regexp_replace(f, f"^{root}|^/", ""), r"\.py$", ""), "/", ".")
    return F.zip_with(files, names, lambda f, n: F.struct(module(f).alias("module"), n.alias("function")))


def signature(text: Column, libraries: list[str]) -> dict[str, Column]:
    """The parts of a traceback's signature and their hash.

    exception_type and message_template come from the line that ends the traceback; operator_fqn is the innermost frame of one of the
    libraries (empty if there is none), site_library the innermost frame's module, to three parts; user_frame_depth how many
    frames lie within that operator frame. A text without a traceback has nulls. `libraries`: the top packages that hold operators."""
    f = frames(text)
    end = F.regexp_extract(text, r"(?s)Traceback \(most recent call last\):.*?\n([A-Za-z_][\w.]*)(?:: ([^\n]*))?(?:\n|$)", 1)
    message = F.regexp_extract(text, r"(?s)Traceback \(most recent call last\):.*?\n([A-Za-z_][\w.]*)(?:: ([^\n]*))?(?:\n|$)", 2)
    ours = F.filter(F.transform(f, lambda x, i: F.when(F.split_part(x["module"], F.lit("."), F.lit(1)).isin(*libraries), i)), lambda i: i.isNotNull())
    last = F.when(F.size(ours) > 0, F.element_at(ours, -1))
    op = F.when(last.isNotNull(), F.element_at(f, last + 1))
    site = F.when(F.size(f) > 0, F.array_join(F.slice(F.split(F.element_at(f, -1)["module"], r"\."), 1, 3), "."))
    there = text.contains("Traceback (most recent call last):") & (end != "")
    part = {
        "exception_type": F.element_at(F.split(end, r"\."), -1),
        "message_template": canonical_message(message),
        "operator_fqn": F.coalesce(F.concat_ws(".", op["module"], op["function"]), F.lit("")),
        "site_library": F.coalesce(site, F.lit("")),
        "user_frame_depth": F.when(last.isNull(), 0).otherwise(F.size(f) - last - 1),
    }
    nul = F.lit("\x00")
    joined = F.concat(*[x for k in sorted(part) for x in (F.lit(k), nul, part[k].cast("string"), nul)])
    return {k: F.when(there, v) for k, v in part.items()} | {"signature": F.when(there, F.sha2(joined, 256))}
