"""String columns: hashing, lines, comments, API usages, clean-up of predictions.

Everything here is a built-in column expression, so it stays in the JVM. Offsets are
0-based counts of code points, as the input tables store them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as whitespace and as a line break in the source data.
WHITESPACE = "[\\s\\x1C-\\x1F]"
LINE_BREAK = "\\r\\n|[\\n\\r\\x0B\\f\\x1C\\x1D\\x1E\\u0085\\u2028\\u2029]"
RARE_BREAK = "[\\r\\x0B\\f\\x1C\\x1D\\x1E\\u0085\\u2028\\u2029]"

# Marks of generated files, and strings that end a generated statement.
GENERATED_MARKS = ["auto-generated", "autogenerated", "automatically generated"]
STOP_STRINGS = ["\n//", "\n@", "\nif", ");", ") {", "\n{", ")\n", ")."]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove leading and trailing whitespace of any kind."""
    return F.regexp_replace(_col(c), f"(?U)^{WHITESPACE}+|{WHITESPACE}+\\z", "")


def content_hash(c: Column | str) -> Column:
    """MD5 of the text without any whitespace."""
    return F.md5(F.regexp_replace(_col(c), f"(?U){WHITESPACE}+", ""))


def line_count(c: Column | str) -> Column:
    """Number of lines; a final line break does not open another line.

    Texts whose only breaks are newlines, nearly all, are counted by byte lengths alone.
    """
    c = _col(c)
    newlines = F.octet_length(c) - F.octet_length(F.replace(c, F.lit("\n"), F.lit("")))
    open_end = F.when((F.octet_length(c) == 0) | F.endswith(c, F.lit("\n")), 0).otherwise(1)
    body = F.regexp_replace(c, f"({LINE_BREAK})\\z", "")
    by_split = F.when(F.octet_length(c) == 0, 0).otherwise(F.size(F.split(body, LINE_BREAK, -1)))
    return F.when(c.rlike(RARE_BREAK), by_split).otherwise(newlines + open_end)


def is_autogenerated(c: Column | str, scan_width: int = 5) -> Column:
    """Does one of the first lines say that the text was generated?"""
    head = F.slice(F.split(_col(c), LINE_BREAK, scan_width + 1), 1, scan_width)
    return F.exists(head, lambda line: F.lower(line).rlike("|".join(GENERATED_MARKS)))


def strip_comments(c: Column | str) -> Column:
    """Replace C-style comments by a space, keep quoted literals, drop blank lines."""
    # extraction, not replacement: what stands between comments and literals is a piece as well,
    # and a line comment ends at a newline only, as it does in Java source
    pieces = F.regexp_extract_all(
        _col(c),
        F.lit(r"""(?s)//[^\n]*|/\*.*?\*/|'(?:\\.|[^\\'])*+'|"(?:\\.|[^\\"])*+"|[^/'"]+|."""),
        F.lit(0),
    )
    code = F.array_join(
        F.transform(pieces, lambda p: F.when(p.startswith("//") | p.startswith("/*"), " ").otherwise(p)), ""
    )
    return F.array_join(F.filter(F.split(code, "\n", -1), lambda line: strip(line) != ""), "\n")


def ws_tokens(c: Column | str) -> Column:
    """Tokens between runs of whitespace."""
    return F.filter(F.split(_col(c), f"(?U){WHITESPACE}+", -1), lambda t: t != "")


def flatten_lines(c: Column | str) -> Column:
    """All lines, stripped, on one line."""
    return F.array_join(F.transform(F.split(_col(c), "\n", -1), strip), " ")


# --- API usages ---------------------------------------------------------------------------


def parse_api_seq(c: Column | str) -> Column:
    """``Class.call idx|...`` to an array of ``(cls, call, idx)``; null where an entry is malformed.

    An index that is no integer leaves ``idx`` null and so drops only its own usage.
    """
    entries = F.transform(
        F.filter(F.split(_col(c), "[|]", -1), lambda e: e != ""), lambda e: F.split(e, "[.]", -1)
    )

    def words(part: Column) -> Column:
        return F.split(strip(part), " ", -1)

    malformed = F.exists(
        entries, lambda e: F.when(F.size(e) < 2, True).otherwise(F.size(words(F.get(e, F.lit(1)))) < 2)
    )
    parsed = F.transform(
        entries,
        lambda e: F.struct(
            F.get(words(F.get(e, F.lit(0))), F.lit(0)).alias("cls"),
            F.get(words(F.get(e, F.lit(1))), F.lit(0)).alias("call"),
            F.get(words(F.get(e, F.lit(1))), F.lit(1)).try_cast("int").alias("idx"),
        ),
    )
    return F.when(~malformed, parsed)


def fqn(cls: Column | str, call: Column | str) -> Column:
    return F.concat_ws(".", _col(cls), _col(call))


def split_fqn(c: Column | str) -> Column:
    """``Class.call`` to a struct of ``api`` and ``call``."""
    parts = F.split(_col(c), "[.]", -1)
    return F.struct(F.get(parts, F.lit(0)).alias("api"), F.get(parts, F.lit(1)).alias("call"))


def prefix(c: Column | str, idx: Column | str) -> Column:
    """The text before offset ``idx``."""
    return F.substring(_col(c), F.lit(1), _col(idx))


def span(c: Column | str, start: Column, end: Column) -> Column:
    """The text from offset ``start`` up to, not including, ``end``."""
    return F.substring(_col(c), start + 1, end - start)


def usage_start(code: Column | str, idx: Column | str, cls: Column | str, call: Column | str) -> Column:
    """Struct ``(start, end)``: from the class name if it is the receiver, else from the call name."""
    code, idx, cls, call = _col(code), _col(idx), _col(cls), _col(call)
    at = idx - F.length(cls) - 1
    is_receiver = (at >= 0) & (F.substring(code, at + 1, F.length(cls)) == cls)
    return F.struct(F.when(is_receiver, at).otherwise(idx).alias("start"), (idx + F.length(call)).alias("end"))


def balanced_end(code: Column | str, end: Column | str, max_scan: int | None = None) -> Column:
    """Offset behind the parenthesis that closes the argument list opened at ``end``; null if unbalanced.

    Where no parenthesis stands at ``end`` the span grows by one. The text is cut before each
    parenthesis, so the fold takes one step per parenthesis. ``max_scan`` limits how far the
    closing one is looked for; by default that is the end of the text.
    """
    code, end = _col(code), _col(end)

    def state(depth: Column, n: Column, done: Column) -> Column:
        return F.named_struct(F.lit("depth"), depth, F.lit("n"), n, F.lit("done"), done)

    def step(acc: Column, piece: Column) -> Column:
        depth = acc["depth"] + F.when(piece.startswith("("), 1).otherwise(-1)
        moved = state(depth, acc["n"] + F.when(depth == 0, 1).otherwise(F.length(piece)), depth == 0)
        return F.when(acc["done"], acc).otherwise(moved)

    width = F.length(code) if max_scan is None else F.lit(max_scan)
    pieces = F.split(F.substring(code, end + 1, width), "(?=[()])", -1)
    closed = F.aggregate(
        pieces, state(F.lit(0), F.lit(0), F.lit(False)), step, lambda acc: F.when(acc["done"], end + acc["n"])
    )
    first = F.substring(code, end + 1, F.lit(1))
    return F.when(~first.isin("(", ")"), end + 1).otherwise(closed)


# --- predictions --------------------------------------------------------------------------


def _count(c: Column, ch: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))


def clean_prediction(c: Column | str) -> Column:
    """Cut behind the last ``)`` and drop closing parentheses that nothing opened."""
    cut = F.regexp_extract(strip(c), "(?s)^(.*\\))", 1)
    extra = _count(cut, ")") - _count(cut, "(")
    drop = (extra > 0) & F.endswith(cut, F.repeat(F.lit(")"), F.greatest(extra, F.lit(0))))
    return F.when(drop, F.substring(cut, F.lit(1), F.length(cut) - extra)).otherwise(cut)


def is_complete(c: Column | str, stops: list[str] = STOP_STRINGS) -> Column:
    """Are the parentheses of a generated statement closed, or is a stop string in it?"""
    c = _col(c)
    closed = (_count(c, "(") > 0) & (_count(c, ")") >= _count(c, "("))
    stopped = F.exists(F.array(*[F.lit(s) for s in stops]), lambda s: F.contains(c, s))
    return closed | stopped
