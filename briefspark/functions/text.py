"""Text scalars as Catalyst expressions (no Python in the data path)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from briefspark.functions import constants as K


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once.

    A Column used n times in an expression is n copies of its tree; inside a lambda
    each of them is evaluated for every element.  Binding it to the variable of a
    one-element transform keeps both the plan and the work small.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def js_trim(c: Column) -> Column:
    """Strip Unicode blanks on both sides; Spark's trim only strips U+0020."""
    return F.regexp_replace(c, rf"^[{K.BLANK}]+|[{K.BLANK}]+\z", "")


def js_rtrim(c: Column) -> Column:
    return F.regexp_replace(c, rf"[{K.BLANK}]+\z", "")


def has_text(c: Column) -> Column:
    """True when the text holds a non-blank character (stops at the first one)."""
    return c.rlike(rf"[^{K.BLANK}]")


def drop_blanks(c: Column) -> Column:
    return F.regexp_replace(c, rf"[{K.BLANK}]+", "")


def find_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(K.edged(pattern)), F.lit(group))


def replace_pattern(c: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(c, K.edged(pattern), by)


# -- paths ------------------------------------------------------------------


def basename_of(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"/+\z", ""), r"(?s)^.*[/\\]", "")


def ext_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename_of(path), r"(?s)^.+\.([^.]*)\z", 1))


def stem_of(path: Column) -> Column:
    return F.lower(F.regexp_replace(basename_of(path), r"(?s)^(.+)\.[^.]*\z", "$1"))


def is_sandbox_path(path: Column) -> Column:
    inner = F.concat(F.lit("/"), F.regexp_replace(path, K.SANDBOX_PREFIX, ""))
    return path.rlike(K.SANDBOX_PREFIX) | inner.rlike(K.SANDBOX_DIR)


def is_binary_file(path: Column) -> Column:
    return ext_of(path).isin(*K.BINARY_EXTENSIONS)


def looks_like_url(name: Column) -> Column:
    """A dotted host before the first slash: a link, not a file of the user."""
    host = F.regexp_replace(F.substring_index(name, "/", 1), r"(?i)^https?://", "")
    return F.contains(name, F.lit("/")) & host.rlike(K.URL_HOST)


def canvas_filename(name: Column, doc_type: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in K.CANVAS_EXTENSIONS.items() for x in kv])
    fallback = F.when(doc_type.startswith("code/"), F.lit("txt")).otherwise(F.lit("md"))
    ext = F.coalesce(F.try_element_at(table, doc_type), fallback)
    return F.when(name.rlike(r"(?i)\.[a-z0-9]+\z"), name).otherwise(
        F.concat(name, F.lit("."), ext)
    )


def slug(title: Column) -> Column:
    dashed = F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-")
    cut = F.substring(F.regexp_replace(dashed, r"^-+|-+\z", ""), 1, K.SLUG_CHARS)
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit(K.DEFAULT_SLUG))


# -- token sets ---------------------------------------------------------------


def token_set(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all tokens of two sets; two empty sets are equal."""
    shared = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - shared
    return F.when(either == 0, F.lit(1.0)).otherwise(
        shared / F.when(either == 0, F.lit(1)).otherwise(either)
    )


def overlap_tokens(c: Column) -> Column:
    """Tokens for the table overlap: letters, digits, dot, percent, dollar."""
    parts = F.split(F.lower(c), "[^a-z0-9.%$]+")
    return F.array_distinct(F.filter(parts, lambda t: F.length(t) > 0))


# -- images -------------------------------------------------------------------


def common_subject(labels: Column) -> Column:
    """One subject for several image labels: the shared leading words when there
    are at least two of them, else the first label that says more than "image"."""
    clean = F.filter(
        F.transform(labels, js_trim),
        lambda x: (F.length(x) > 0) & (F.lower(x) != "image"),
    )

    def shared_words(words: Column) -> Column:
        first = F.get(words, F.lit(0))
        differs = F.filter(
            F.sequence(F.lit(0), F.size(first) - 1),
            lambda i: ~F.forall(words, lambda w: F.lower(F.get(w, i)).eqNullSafe(F.lower(F.get(first, i)))),
        )
        return F.slice(first, F.lit(1), F.coalesce(F.array_min(differs), F.size(first)))

    def choose(kept: Column) -> Column:
        words = F.transform(kept, lambda x: F.split(x, rf"[{K.BLANK}]+"))
        prefix = F.when(F.size(kept) > 1, let(words, shared_words))
        return F.when(F.size(kept) == 0, F.lit("image")).otherwise(
            F.coalesce(
                let(prefix, lambda p: F.when(F.size(p) >= 2, F.array_join(p, " "))), F.get(kept, F.lit(0))
            )
        )

    return let(clean, choose)


def image_subject(labels: Column, from_search: Column) -> Column:
    suffix = F.when(from_search, F.lit(" (image search)")).otherwise(F.lit(""))
    return F.concat(common_subject(labels), suffix)


# -- JSON ----------------------------------------------------------------------


def compact_json(text: Column) -> Column:
    """Drop blanks outside strings, keep the order of the keys."""
    return F.regexp_replace(text, r'("(?:[^"\\]|\\.)*+")|[ \t\r\n]+', "$1")


def one_line_preview(text: Column) -> Column:
    line = js_trim(F.regexp_replace(text, rf"[{K.BLANK}]+", " "))
    cut = lambda x: F.when(
        F.length(x) > K.PREVIEW_CHARS, F.concat(F.substring(x, 1, K.PREVIEW_CHARS), F.lit("…"))
    ).otherwise(x)
    return let(line, cut)


def variant_text(v: Column, path: str = "$") -> Column:
    """The string at the path, NULL for any other JSON type."""
    return let(
        F.try_variant_get(v, path, "variant"),
        lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")),
    )


def variant_field(v: Column, path: str) -> Column:
    """The value at the path with JSON null folded into SQL NULL."""
    return let(F.try_variant_get(v, path, "variant"), lambda x: F.when(~F.is_variant_null(x), x))


def variant_list(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def variant_truthy(v: Column, path: str = "$") -> Column:

    def test(p: Column) -> Column:
        leaf, kind = p["x"], p["kind"]
        return (
            F.when(kind == "VOID", F.lit(False))
            .when(kind == "BOOLEAN", F.try_variant_get(leaf, "$", "boolean"))
            .when(kind == "STRING", F.length(F.try_variant_get(leaf, "$", "string")) > 0)
            .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), F.lit(True))
            .otherwise(F.try_variant_get(leaf, "$", "double") != 0)
        )

    typed = let(
        F.try_variant_get(v, path, "variant"),
        lambda x: F.struct(x.alias("x"), F.schema_of_variant(x).alias("kind")),
    )
    return F.coalesce(let(typed, test), F.lit(False))


def source_lines(pairs: Column) -> Column:
    """Array of (title, url) -> the block of source lines, empty when none."""
    lines = F.transform(pairs, lambda p: F.concat(F.lit("- "), p["title"], F.lit(": "), p["url"]))
    joined = F.nullif(F.array_join(lines, "\n"), F.lit(""))
    return F.coalesce(F.concat(F.lit("\n\nSources:\n"), joined), F.lit(""))


def first_per_url(pairs: Column) -> Column:
    """Keep the first pair of each url, in order."""
    return let(
        pairs,
        lambda ps: F.filter(ps, lambda p, i: F.array_position(F.transform(ps, lambda x: x["url"]), p["url"]) == i + 1),
    )


def last_title_per_url(pairs: Column) -> Column:
    """Keep each url at its first place with the title seen last."""
    return let(
        pairs,
        lambda ps: F.transform(
            F.array_distinct(F.transform(ps, lambda p: p["url"])),
            lambda u: F.struct(
                F.element_at(F.filter(ps, lambda p: p["url"] == u), -1)["title"].alias("title"), u.alias("url")
            ),
        ),
    )
