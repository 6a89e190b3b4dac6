"""Scalar text functions, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from beaconry import rules

ACCENTS = ("àáâãäåèéêëìíîïòóôõöùúûüýÿñç", "aaaaaaeeeeiiiiooooouuuuyync")


def terms(c: Column) -> Column:
    """Searchable terms in order, each once: dotted or joined fragments, words, camel-case pieces."""
    low = F.lower(c)
    joined = F.filter(F.split(low, r"[\\/\s,]+"), lambda x: x.rlike(r"[._-]"))
    words = F.regexp_extract_all(low, F.lit("([a-z0-9]+)"), F.lit(1))
    pieces = lambda p: F.transform(F.regexp_extract_all(p, F.lit("([A-Z][a-z0-9]*|[a-z][a-z0-9]*)"), F.lit(1)), F.lower)
    parts = F.filter(F.split(c, "[^a-zA-Z0-9]+"), lambda p: p != "")
    camel = F.flatten(F.transform(parts, lambda p: F.concat(pieces(p), F.array(F.lower(p)))))
    return F.array_distinct(F.concat(joined, words, camel))


def meaningful(c: Column) -> Column:
    """terms() of two and more characters that are no stop words."""
    stop = F.array(*map(F.lit, sorted(rules.STOP_WORDS)))
    return F.filter(terms(c), lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, t))


def expand(list_: Column) -> Column:
    """Each term, followed by its base form where it is irregular; repetitions stay."""
    bases = F.create_map(*(F.lit(x) for kv in sorted(rules.BASE_OF.items()) for x in kv))
    return F.flatten(F.transform(list_, lambda t: F.filter(F.array(t, F.try_element_at(bases, t)), lambda x: x.isNotNull())))


def words(c: Column) -> Column:
    """Tokens of the full-text lane: runs of letters and digits, folded to small letters without accents."""
    return F.regexp_extract_all(F.translate(F.lower(c), *ACCENTS), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def token_estimate(c: Column) -> Column:
    """A quarter of the code points, rounded up, one at least."""
    return F.greatest(F.lit(1), F.ceil(F.length(c) / 4)).cast("long")


def round_half_up(c: Column, digits: int = 2) -> Column:
    return F.floor(c * 10**digits + 0.5) / 10**digits


def dirname(path: Column) -> Column:
    d = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    return F.when(d == "", F.lit(".")).otherwise(d)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased, without the dot; empty where there is none."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def language(path: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in sorted(rules.LANGUAGES.items()) for x in kv))
    ext = F.regexp_extract(path, r"\.([^./]+)$", 1)
    return F.coalesce(F.try_element_at(known, ext), F.when(ext.isin(*sorted(rules.LINE_ONLY)), ext))


def by_language(lang: Column, table: dict[str, str], path: Column) -> Column:
    """Whether path matches the language's expression; others than those listed follow `rg`."""
    out = path.rlike(table["rg"]) if "rg" in table else F.lit(False)
    for name, rx in table.items():
        out = F.when(lang == name, path.rlike(rx)).otherwise(out)
    return out


def is_test_file(path: Column, lang: Column | None = None) -> Column:
    """The language's pattern, if given, or a path segment that names tests; testing.py is none."""
    seg = F.exists(
        F.split(path, "/"),
        lambda s: s.isin("test", "tests", "spec", "conftest.py") | s.rlike(r"^(test|spec)_|_test$|_test\.|\.(spec|test)\."),
    )
    return seg if lang is None else (by_language(lang, {k: v for k, v in rules.TEST_FILES.items() if k != "rg"}, path) | seg)


def is_document(path: Column) -> Column:
    return extension(path).isin(*sorted(rules.PROSE | rules.CONVERTIBLE))


def module_path(at_file: Column, module: Column) -> Column:
    """A relative module against its importer's directory, without extension; others as they are."""
    joined = F.concat(dirname(at_file), F.lit("/"), module)
    for _ in range(8):
        joined = F.regexp_replace(joined, r"(^|/)\./", "$1")
        joined = F.regexp_replace(joined, r"(^|/)(?!\.\./)[^/]+/\.\./", "$1")
    return F.regexp_replace(F.when(module.startswith("."), joined).otherwise(module), r"\.[A-Za-z]+$", "")


def moniker_name(c: Column) -> Column:
    """The last descriptor's name of a SCIP symbol string."""
    return F.regexp_extract(c, r"([A-Za-z0-9_$]+)[`().#/:!\[\]]*$", 1)
