"""Batch title lookup and redirect resolution.

Requests are ``request_id, title, namespace_id`` (namespace null: any). The work is done
per distinct request: titles are matched on narrow rows without bodies, the page found is
joined once by its key, and only then does the result go back to the requests. So a title
asked for by a third of all requests meets the page table as one row, and rows without a
page or without a redirect take part in no join on a null key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesmith.functions.text import first_upper
from pagesmith.operators.ingest import strip_main
from pagesmith.operators.joins import skew_join
from pagesmith.sources.tables import local_names

PAGE_COLUMNS = ("redirect_to", "body", "model")
ASKED = ["asked_title", "asked_ns"]
# Requests of one key that share a copy of its result.
ROWS_PER_COPY = 1_000_000


def _distinct_keys(requests: DataFrame) -> DataFrame:
    """Requested keys with the number of their requests."""
    return requests.groupBy(F.col("title").alias("asked_title"), F.col("namespace_id").alias("asked_ns")).agg(
        F.count(F.lit(1)).alias("asked_times")
    )


def candidates(keys: DataFrame, namespaces: DataFrame) -> DataFrame:
    """Requested keys with the titles to try, best first."""
    capital = F.col("canonical_name").isin("Template", "Module")
    ns = local_names(namespaces).select(F.col("id").alias("asked_ns"), "canonical_name", F.col("name").alias("ns_name"))
    clean = strip_main(F.replace(F.col("asked_title"), F.lit("_"), F.lit(" ")))
    keys = keys.select(*ASKED, clean.alias("wanted")).where(F.col("wanted") != "").join(ns, "asked_ns", "left")
    prefix = F.concat("ns_name", F.lit(":"))
    in_main = F.col("asked_ns").isNull() | (F.col("asked_ns") == 0)
    prefixed = F.when(in_main | F.col("wanted").startswith(prefix), F.col("wanted")).otherwise(F.concat(prefix, "wanted"))
    rest = F.col("exact").substr(F.length(prefix) + 1, F.length("exact"))
    upper = F.when(~in_main & capital, F.concat(prefix, first_upper(rest)))
    tries = F.filter(
        F.array(
            F.struct(F.lit(0).alias("rank"), F.col("exact").alias("title")),
            F.struct(F.lit(1).alias("rank"), F.when(upper != F.col("exact"), upper).alias("title")),
        ),
        lambda t: t["title"].isNotNull(),
    )
    return keys.withColumn("exact", prefixed).select(*ASKED, F.explode(tries).alias("t")).select(
        *ASKED, "t.rank", "t.title"
    )


def _find(keys: DataFrame, pages: DataFrame, namespaces: DataFrame, no_redirect: bool) -> DataFrame:
    """Requested keys that have a page, with its key and redirect. No body is read.

    The exact title comes before the one with a capital first letter; without a
    namespace the lowest one that has the title wins (O2: one page per key).
    """
    source = pages.where(F.col("redirect_to").isNull()) if no_redirect else pages
    page = source.select("title", F.col("namespace_id").alias("found_ns"), "redirect_to")
    same_ns = F.col("asked_ns").isNull() | (F.col("asked_ns") == F.col("found_ns"))
    hits = candidates(keys, namespaces).join(page, "title").where(same_ns)
    best = F.min_by(F.struct(F.col("title").alias("found_title"), "found_ns", "redirect_to"), F.struct("rank", "found_ns"))
    return hits.groupBy(*ASKED).agg(best.alias("page")).select(*ASKED, "page.*")


def _with_columns(found: DataFrame, pages: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    found = found.select(*ASKED, "found_title", "found_ns")
    if not columns:
        return found
    page = pages.select(F.col("title").alias("found_title"), F.col("namespace_id").alias("found_ns"), *columns)
    return found.join(page, ["found_title", "found_ns"]).select(*ASKED, "found_title", "found_ns", *columns)


def _answer(requests: DataFrame, keys: DataFrame, found: DataFrame) -> DataFrame:
    """Requests with what was found for their key.

    A key with very many requests gets several copies of its result, over which its
    requests are spread, so that no task handles them all.
    """
    copies = F.ceil(F.col("asked_times") / ROWS_PER_COPY).cast("int")
    # At most one row per ROWS_PER_COPY requests, hence small enough to broadcast.
    hot = keys.where(F.col("asked_times") > ROWS_PER_COPY).select(*ASKED, copies.alias("copies"))
    same = lambda left, right: (F.col(f"{left}.asked_title") == F.col(f"{right}.asked_title")) & F.col(
        f"{left}.asked_ns"
    ).eqNullSafe(F.col(f"{right}.asked_ns"))
    spread = requests.withColumns({"asked_title": F.col("title"), "asked_ns": F.col("namespace_id")}).alias("r").join(
        F.broadcast(hot.alias("h")), same("r", "h"), "left"
    ).select("r.*", F.coalesce(F.pmod(F.xxhash64("request_id"), F.col("h.copies")), F.lit(0)).alias("copy"))
    copied = found.alias("f").join(F.broadcast(hot.alias("h")), same("f", "h"), "left").select(
        "f.*", F.explode(F.sequence(F.lit(0), F.coalesce("h.copies", F.lit(1)) - 1)).alias("copy")
    )
    outputs = [c for c in found.columns if c not in ASKED]
    on = same("r", "f") & (F.col("r.copy") == F.col("f.copy"))
    return spread.alias("r").join(copied.alias("f"), on, "left").select(
        *[F.col(f"r.{c}") for c in requests.columns], *[F.col(f"f.{c}") for c in outputs]
    )


def lookup_pages(
    requests: DataFrame,
    pages: DataFrame,
    namespaces: DataFrame,
    no_redirect: bool = False,
    columns: tuple[str, ...] = PAGE_COLUMNS,
) -> DataFrame:
    """Requests with the page found, null columns where there is none."""
    keys = _distinct_keys(requests)
    found = _find(keys, pages, namespaces, no_redirect)
    return _answer(requests, keys, _with_columns(found, pages, columns))


def pages_exist(titles: DataFrame, pages: DataFrame, namespaces: DataFrame) -> DataFrame:
    """Requests with a flag; the namespace column is ignored."""
    anywhere = titles.withColumn("namespace_id", F.lit(None).cast("int"))
    found = lookup_pages(anywhere, pages, namespaces, columns=())
    return found.select("request_id", "title", F.col("found_title").isNotNull().alias("page_exists"))


def resolve_redirects(
    requests: DataFrame, pages: DataFrame, namespaces: DataFrame, columns: tuple[str, ...] = PAGE_COLUMNS
) -> DataFrame:
    """One hop; the target must lie in the requested namespace and be no redirect itself."""
    keys = _distinct_keys(requests)
    first = _find(keys, pages, namespaces, no_redirect=False)
    direct = first.where(F.col("redirect_to").isNull()).select(*ASKED, "found_title", "found_ns")
    hops = first.where(F.col("redirect_to").isNotNull())
    targets = hops.select(F.col("redirect_to").alias("asked_title"), "asked_ns").distinct()
    second = _find(targets, pages, namespaces, no_redirect=True)
    on = (F.col("h.redirect_to") == F.col("s.asked_title")) & F.col("h.asked_ns").eqNullSafe(F.col("s.asked_ns"))
    resolved = hops.alias("h").join(second.alias("s"), on).select(
        "h.asked_title", "h.asked_ns", "s.found_title", "s.found_ns"
    )
    return _answer(requests, keys, _with_columns(direct.unionByName(resolved), pages, columns))


def redirect_targets(titles: DataFrame, pages: DataFrame, unresolved: bool = False) -> DataFrame:
    """J5 for the titles of links: ``link_title, new`` for every redirect that resolves, in any namespace.

    ``titles`` has each ``link_title`` once. Missing pages have no row. Redirects to missing pages and double
    redirects have none either; with ``unresolved`` they have the title they name.
    """
    nowhere = F.lit(None).cast("int")
    none = pages.sparkSession.createDataFrame([], "id int, canonical_name string, name string")
    keys = titles.select(F.col("link_title").alias("asked_title"), nowhere.alias("asked_ns"))
    hops = _find(keys, pages, none, no_redirect=False).where(F.col("redirect_to").isNotNull()).select("asked_title", "redirect_to")
    targets = hops.select(F.col("redirect_to").alias("asked_title"), nowhere.alias("asked_ns")).distinct()
    second = _find(targets, pages, none, no_redirect=True).select(
        F.col("asked_title").alias("redirect_to"), F.col("found_title").alias("new"))
    if unresolved:
        named = targets.select(F.col("asked_title").alias("redirect_to"))
        second = named.join(second, "redirect_to", "left").withColumn("new", F.coalesce("new", "redirect_to"))
    return skew_join(hops, second, ["redirect_to"], ["asked_title"]).select(F.col("asked_title").alias("link_title"), "new")
