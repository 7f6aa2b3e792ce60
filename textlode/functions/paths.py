"""Column expressions over file paths."""

from pyspark.sql import Column, functions as F

from .fixed import (BINARY_EXTENSIONS, EXCLUDED_EXTENSIONS, EXCLUDED_PATH_PATTERNS,
                    EXTRA_KNOWN_FILE_NAMES, GREP_EXCLUDE_PATTERNS, KNOWN_FILE_NAMES,
                    LANGUAGE_BY_EXTENSION, CODE_LANGUAGES)
from .matching import ascii_edges


def lit_map(mapping):
    """A constant lookup table inside the plan (a few dozen entries at most)."""
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def normalize(path: Column) -> Column:
    return F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))


def file_name(path):
    return F.substring_index(normalize(path), "/", -1)


def parent_dir(path):
    return F.regexp_replace(normalize(path), r"/?[^/]*$", "")


def dir_name(path):
    return file_name(parent_dir(path))


def base_name(path):
    """File name up to its last dot; a leading dot does not count."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def extension(path):
    """Extension with its dot, empty for none or for a leading dot only."""
    return F.regexp_extract(file_name(path), r"^.+(\.[^.]*)$", 1)


def bare_extension(path):
    """Lower-cased text after the last dot of the file name (the whole name when there is no dot)."""
    return F.lower(F.substring_index(file_name(path), ".", -1))


def stem_name(path):
    """Lower-cased file name without its last extension."""
    return F.regexp_replace(F.lower(file_name(path)), r"\.[^.]+$", "")


def split_path(path):
    return F.filter(F.split(normalize(path), "/"), lambda p: F.length(p) > 0)


def is_inside(path, directory):
    p, d = normalize(path), normalize(directory)
    return F.startswith(p, F.concat(d, F.lit("/"))) | (p == d)


def relative_to(path, root):
    """Path below root; paths outside root are returned unchanged."""
    p, r = normalize(path), normalize(root)
    return F.when(F.startswith(p, F.concat(r, F.lit("/"))), F.substr(p, F.length(r) + 2)).otherwise(p)


def short_dir(path):
    """The last two directories above the file."""
    parts = F.split(parent_dir(path), "/")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), "/")


def ancestors(path):
    """Every proper ancestor prefix of a path, shortest first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1),
        lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(
            F.array().cast("array<string>"))


def suffixes(path, most=5):
    """The path itself and its last 1..most segments, for loose path matching."""
    parts = split_path(path)
    n = F.least(F.size(parts), F.lit(most))
    tails = F.when(n >= 1, F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: F.array_join(F.slice(parts, -i, i), "/"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(path), tails))


def language(path, extended=False):
    """Language tag: known bare names, then the extension table, then the extension itself."""
    known = {**KNOWN_FILE_NAMES, **(EXTRA_KNOWN_FILE_NAMES if extended else {})}
    name = file_name(path)
    ext = bare_extension(path)
    return F.coalesce(
        F.try_element_at(lit_map(known), F.lower(name)),
        F.when(~F.contains(name, F.lit(".")), F.lit("text")),
        F.try_element_at(lit_map(LANGUAGE_BY_EXTENSION), ext),
        F.nullif(ext, F.lit("")),
        F.lit("text"))


def is_binary(path):
    return bare_extension(path).isin(*BINARY_EXTENSIONS)


def any_rlike(value, patterns):
    cond = F.lit(False)
    for p in patterns:
        cond = cond | value.rlike(ascii_edges(p))
    return cond


def should_index(path):
    """Whether code search reads this file at all."""
    ext = F.substring_index(F.lower(F.substring_index(path, "/", -1)), ".", -1)
    return ~ext.isin(*EXCLUDED_EXTENSIONS) & ~any_rlike(path, EXCLUDED_PATH_PATTERNS)


def is_source(lang):
    return F.coalesce(lang.isin(*CODE_LANGUAGES), F.lit(False))


def grep_excluded(path):
    return any_rlike(path, GREP_EXCLUDE_PATTERNS)


def matches_file_pattern(path, pattern, regex=False):
    if regex:
        return path.rlike(pattern)
    return F.contains(F.lower(path), F.lit(pattern.lower()))


def folder_allowed(folder, include=(), exclude=()):
    """Case-insensitive folder filter; an exclusion beats an inclusion."""
    name = F.lower(folder)
    out = F.lit(False)
    for e in exclude:
        out = out | F.contains(name, F.lit(e.lower()))
    ok = F.lit(not include)
    for i in include:
        ok = ok | F.contains(name, F.lit(i.lower()))
    return ~out & ok


def human_size(n):
    """Bytes as B, KB or MB with one decimal."""
    return (F.when(n < 1024, F.format_string("%d B", n.cast("long")))
            .when(n < 1024 * 1024, F.concat(F.format_string("%.1f", n / F.lit(1024.0)), F.lit(" KB")))
            .otherwise(F.concat(F.format_string("%.1f", n / F.lit(1024.0 * 1024)), F.lit(" MB"))))
