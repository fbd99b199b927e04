"""Page search by predicates on the page table."""

from __future__ import annotations

from functools import reduce
from itertools import groupby
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesmith.constants import ERROR_PATTERNS

Patterns = str | list[str] | None


def _as_list(patterns: Patterns) -> list[str]:
    return [patterns] if isinstance(patterns, str) else list(patterns)


def contains_any(text: Column, patterns: Patterns) -> Column:
    """Text contains one of the strings, case-sensitive.

    Strings that contain another one of the list cannot change the answer and are
    left out; those with a common beginning are tried only where that beginning occurs.
    """
    wanted = sorted(set(_as_list(patterns)))
    needed = [p for p in wanted if not any(q != p and q in p for q in wanted)]
    tests = []
    for head, group in groupby(needed, key=lambda p: p[:3]):
        group = list(group)
        any_of_group = reduce(or_, [text.contains(p) for p in group])
        tests.append(any_of_group if len(group) < 3 else text.contains(head) & any_of_group)
    return reduce(or_, tests)


def search_pages(
    pages: DataFrame,
    namespace_ids: list[int] | None = None,
    include_redirects: bool = True,
    model: str | None = None,
    search_pattern: Patterns = None,
    search_regex: Patterns = None,
    search_exclude: Patterns = None,
    regex_exclude: Patterns = None,
) -> DataFrame:
    """All given predicates at once.

    No namespace list means no filter, an empty one matches nothing. Regexes are Java's.
    A null body passes neither the including nor the excluding text filters.
    """
    body = F.col("body")
    tests = []
    if namespace_ids is not None:
        tests.append(F.col("namespace_id").isin(namespace_ids) if namespace_ids else F.lit(False))
    if not include_redirects:
        tests.append(F.col("redirect_to").isNull())
    if model is not None:
        tests.append(F.col("model") == model)
    if search_pattern:
        tests.append(contains_any(body, search_pattern))
    if search_regex:
        tests.append(reduce(or_, [body.rlike(r) for r in _as_list(search_regex)]))
    if search_exclude:
        tests.append(~contains_any(body, search_exclude))
    if regex_exclude:
        tests.append(reduce(and_, [~body.rlike(r) for r in _as_list(regex_exclude)]))
    return pages.where(reduce(and_, tests)) if tests else pages


def count_pages(pages: DataFrame, **filters) -> DataFrame:
    """Number of pages under the same filters, as one row ``n``."""
    return search_pages(pages, **filters).agg(F.count(F.lit(1)).alias("n"))


def all_pages(pages: DataFrame, require_space: bool = True, **filters) -> DataFrame:
    """Scan under filters; without a pattern the body must contain a blank.

    So redirects, which have no body, never pass unless ``require_space`` is off.
    """
    if require_space and not filters.get("search_pattern"):
        filters["search_pattern"] = " "
    return search_pages(pages, **filters)


def error_scan(pages: DataFrame, patterns: list[str] = ERROR_PATTERNS) -> DataFrame:
    """Main-namespace pages that contain a known error pattern."""
    return all_pages(pages, namespace_ids=[0], search_pattern=patterns)


def error_hits(pages: DataFrame, patterns: list[str] = ERROR_PATTERNS) -> DataFrame:
    """One row per flagged page and pattern found in it."""
    listed = F.array(*[F.lit(p) for p in patterns])
    hits = F.filter(listed, lambda p: F.contains(F.col("body"), p))
    return error_scan(pages, patterns).select("title", "namespace_id", F.explode(hits).alias("pattern"))


def error_counts(pages: DataFrame, patterns: list[str] = ERROR_PATTERNS) -> DataFrame:
    """Flagged pages per pattern."""
    return error_hits(pages, patterns).groupBy("pattern").agg(F.count(F.lit(1)).alias("pages"))
