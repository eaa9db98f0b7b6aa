"""Text expressions. Everything here is a Catalyst expression except the boundary chunker's helper."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

# Split points in falling precedence - blank line, heading, sentence end, white space.
BREAKS = (r"\n\s*\n", r"\n#+\s", r"[.!?]\s+", r"\s+")

# Language named for a file extension; anything else is a "text file".
LANGUAGES = {
    ".py": "Python",
    ".c": "C",
    ".h": "C header",
    ".cpp": "C++",
    ".cc": "C++",
    ".cxx": "C++",
    ".hpp": "C++ header",
    ".rs": "Rust",
    ".go": "Go",
    ".java": "Java",
    ".js": "JavaScript",
    ".ts": "TypeScript",
    ".md": "Markdown",
    ".rst": "reStructuredText",
    ".json": "JSON",
    ".yaml": "YAML",
    ".yml": "YAML",
    ".toml": "TOML",
    ".ini": "INI",
    ".cfg": "config",
}

# Everything up to the end of the last break of one kind; greedy, so it is found from the right.
_UP_TO_LAST = tuple(re.compile(f"(?s:.*)(?:{p})") for p in BREAKS)

Window = tuple[int, int]


def cut_window(text: str, begin: int, target: int) -> Window:
    """The window from ``begin`` of at most ``target`` characters, ended behind the last break of the
    strongest kind that it has; without a break it is full."""
    full = min(begin + target, len(text))
    breaks = (rx.match(text, begin, full) for rx in _UP_TO_LAST)
    return begin, next((m.end() for m in breaks if m), full)


def following(text: str, window: Window, target: int, overlap: int) -> Window | None:
    """The window behind one: it goes back by the overlap unless that would not get ahead."""
    begin, end = window
    if end == len(text):
        return None
    back = end - overlap
    return cut_window(text, end if back <= begin else back, target)


def spans(text: str, target: int, overlap: int) -> Iterator[Window]:
    """All windows of a text, each made from the one before it; none for an empty text."""
    window = cut_window(text, 0, target) if text else None
    while window:
        yield window
        window = following(text, window, target, overlap)


def strip(col: Column) -> Column:
    """Strip all white space at both ends (Spark's ``trim`` only strips blanks)."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def is_blank(col: Column) -> Column:
    return ~F.coalesce(col, F.lit("")).rlike(r"\S")


def newlines(col: Column) -> Column:
    return F.length(col) - F.length(F.replace(col, F.lit("\n"), F.lit("")))


def title_key(col: Column) -> Column:
    """Titles that differ only by case or white space share one key."""
    return F.lower(strip(F.regexp_replace(col, r"\s+", " ")))


def shorten(col: Column, limit: int) -> Column:
    """At most ``limit`` characters, the last three being dots when cut."""
    return F.when(F.length(col) <= limit, col).otherwise(F.concat(F.substring(col, 1, limit - 3), F.lit("...")))


def clip(col: Column, limit: int) -> Column:
    """First ``limit`` characters plus dots when longer."""
    return F.when(F.length(col) > limit, F.concat(F.substring(col, 1, limit), F.lit("..."))).otherwise(col)


def token_estimate(col: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(col) / 4).cast("int"))


def language_hint(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.element_at(table, F.lower(extension(path))), F.lit("text file"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    parent = F.regexp_replace(path, r"/[^/]*$", "")
    return F.when(parent == "", F.lit("/")).otherwise(parent)


def extension(path: Column) -> Column:
    """Extension with its dot; leading dots of a name do not start an extension."""
    return F.regexp_extract(basename(path), r"[^.].*?(\.[^.]*)$", 1)


def ancestors(path: Column) -> Column:
    """The path itself and every directory above it, without the root."""
    parts = F.split(F.regexp_replace(path, r"^/+|/+$", ""), "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")),
    )


def numbered_lines(col: Column, first: int = 1) -> Column:
    """Lines prefixed with a right-aligned six-digit number, as shown to a topic model."""
    return F.array_join(
        F.transform(
            F.split(col, "\n"),
            lambda line, i: F.concat(
                F.when(i + first < 1_000_000, F.lpad((i + first).cast("string"), 6, " ")).otherwise(
                    (i + first).cast("string")
                ),
                F.lit("  "),
                line,
            ),
        ),
        "\n",
    )


def glob_regex(pattern: Column) -> Column:
    """Shell glob (``*``, ``?``, ``[..]``, ``[!..]``) as an anchored regular expression.

    The pattern is split into classes and what lies between them. A ``[`` without its ``]`` is an
    ordinary character. In a class ``]`` may come first, ranges stay, and a range whose ends are the
    wrong way round matches nothing.
    """
    # A class: [, perhaps !, perhaps ] as its first member, and all up to the next ].
    pieces = F.regexp_extract_all(pattern, F.lit(r"(?s)(\[!?\]?[^\]]*\]|.)"), F.lit(1))
    return F.concat(F.lit("(?s)^"), F.array_join(F.transform(pieces, _glob_piece), ""), F.lit("$"))


def _glob_piece(piece: Column) -> Column:
    inner = F.regexp_replace(F.substring(piece, 2, 1_000_000), r"(?s)\]$", "")
    negated = F.startswith(inner, F.lit("!"))
    members = F.when(negated, F.substring(inner, 2, 1_000_000)).otherwise(inner)
    # A range of two members, or a single member; reversed ranges have no members.
    listed = F.regexp_extract_all(members, F.lit(r"(?s)(.-.|.)"), F.lit(1))
    known = F.filter(listed, lambda m: (F.length(m) < 3) | (F.substring(m, 1, 1) <= F.substring(m, 3, 1)))
    safe = F.transform(
        known,
        lambda m: F.when(
            F.length(m) == 3, F.concat(_quoted(F.substring(m, 1, 1)), F.lit("-"), _quoted(F.substring(m, 3, 1)))
        ).otherwise(_quoted(m)),
    )
    body = F.array_join(safe, "")
    none = F.when(negated, F.lit(".")).otherwise(F.lit("(?!)"))
    as_class = F.when(F.size(known) == 0, none).otherwise(F.concat(F.when(negated, "[^").otherwise("["), body, F.lit("]")))
    return (
        F.when(F.length(piece) > 1, as_class).when(piece == "*", ".*").when(piece == "?", ".").otherwise(_quoted(piece))
    )


def _quoted(member: Column) -> Column:
    return F.regexp_replace(member, r"([^\p{L}\p{N}\s_/])", r"\\$1")


def downscaled(width: Column, height: Column, max_side: int) -> tuple[Column, Column]:
    """Size after shrinking the longer side to ``max_side``; smaller images keep their size."""
    longest = F.greatest(width, height)
    scale = F.lit(max_side).cast("double") / longest

    def side(x: Column) -> Column:
        return F.when(longest > max_side, F.greatest(F.lit(1), F.bround(x * scale).cast("int"))).otherwise(x)

    return side(width), side(height)


def unfenced(text: Column) -> Column:
    """Reply text without surrounding white space and code fence."""
    stripped = strip(text)
    opened = F.regexp_replace(stripped, r"^```[^\n]*\n", "")
    return F.when(F.startswith(stripped, F.lit("```")), F.regexp_replace(opened, r"\s*```$", "")).otherwise(stripped)


def base64_line(content: Column) -> Column:
    """Base64 without the line breaks that ``base64`` may insert."""
    return F.translate(F.base64(content), "\r\n", "")
