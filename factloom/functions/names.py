"""Names, keys and routes as column functions; all of them run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def kebab(name: Column) -> Column:
    """``lookupGapSite`` and ``lookup_gap`` in kebab case."""
    split = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1-$2"), "([A-Z]+)([A-Z][a-z])", "$1-$2")
    return F.lower(F.regexp_replace(split, "[_ ]+", "-"))


def words(name: Column) -> Column:
    """The words of a name, in lower case."""
    return F.filter(F.split(kebab(name), "[^a-z0-9]+"), lambda w: w != "")


def subtokens(text: Column) -> Column:
    """The parts of identifiers and paths, of at least two characters, in lower case: ``onUnmountedHook`` gives on, unmounted, hook."""
    return F.transform(F.filter(F.regexp_extract_all(text, F.lit("[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+"), F.lit(0)), lambda x: F.length(x) > 1), F.lower)


def last_segment(name: Column, separator: str = ".") -> Column:
    """What stands behind the last separator."""
    return F.substring_index(name, separator, -1)


def accessor(field: Column, prefix: str) -> Column:
    """``get`` or ``set`` before a field's name."""
    return F.concat(F.lit(prefix), F.upper(F.substring(field, 1, 1)), F.substring(field, 2, 1 << 30))


def placeholder_keys(text: Column) -> Column:
    """Keys of ``${key}`` and ``${key:default}``."""
    return F.regexp_extract_all(text, F.lit(r"\$\{([\w.-]+)(?::[^}]*)?\}"), F.lit(1))


def bare_route(url: Column) -> Column:
    """A URL without scheme, host, query and fragment, and without a slash at its end."""
    path = F.regexp_replace(F.regexp_replace(url, r"^[a-z][a-z0-9+.-]*://[^/]*", ""), r"[?#].*$", "")
    return F.regexp_replace(path, r"(.)/+$", "$1")


def tokens(text: Column) -> Column:
    """Words of at least two letters in a text, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]{2,}"), F.lit(0))


def slashed(path: Column) -> Column:
    """A path with forward slashes and without leading ``./``."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def relaxed(name: Column) -> Column:
    """A name without case, hyphens, underscores and dots, as configuration keys are compared."""
    return F.lower(F.regexp_replace(name, "[-_.]", ""))


def positions(text: Column, char: str) -> Column:
    """Places of a character in a text, from 0; null for null."""
    places = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)))
    return F.when(text.isNotNull(), F.filter(places, lambda k: F.substr(text, k + 1, F.lit(1)) == char))


def prefixes(name: Column, deepest: int, separator: str = ".") -> Column:
    """The first 1 to ``deepest`` segments of a name, each put together again; null for null."""
    parts = F.split(name, F.lit(f"\\Q{separator}\\E"))
    levels = F.sequence(F.lit(1), F.least(F.size(parts), F.lit(deepest)))
    return F.when(name.isNotNull(), F.transform(levels, lambda k: F.array_join(F.slice(parts, F.lit(1), k), separator)))


def without_comments(code: Column) -> Column:
    """Code of the C family with a blank in place of each comment and double-quoted string."""
    return F.regexp_replace(code, r'(?s)/\*.*?\*/|//[^\n]*|"[^"\n]*"', " ")
