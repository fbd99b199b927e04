"""From raw dump pages to the page table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagesmith.functions.text import bind
from pagesmith.operators.intervals import KEY
from pagesmith.schemas import PAGES
from pagesmith.sources import versions
from pagesmith.sources.dump import read_dump
from pagesmith.sources.tables import PAGE_COLUMNS, local_names, read_pages

# Content models whose pages are kept.
KEPT_MODELS = ["wikitext", "Scribunto", "json"]


def eligible(raw: DataFrame, namespaces: DataFrame) -> DataFrame:
    """B1: pages of known namespaces that are neither documentation nor test cases."""
    plain = ~F.col("title").endswith("/documentation") & ~F.col("title").contains("/testcases")
    return raw.where(plain).join(namespaces.select(F.col("id").alias("ns")).distinct(), "ns", "left_semi")


def content_model_filter(raw: DataFrame) -> DataFrame:
    """B2: non-redirects are kept for three content models only."""
    return raw.where(F.col("redirect").isNotNull() | F.col("model").isin(KEPT_MODELS))


def split_redirect(raw: DataFrame) -> DataFrame:
    """Redirects have a target and no body, other pages a body and no target."""
    is_redirect = F.col("redirect").isNotNull()
    return raw.select(
        "ord", "title", F.col("ns").alias("namespace_id"), F.col("redirect").alias("redirect_to"),
        F.when(~is_redirect, F.coalesce("text", F.lit(""))).alias("body"), "model",
    )


def normalise_title(pages: DataFrame, namespaces: DataFrame, lang: str | None = None) -> DataFrame:
    """Local namespace prefix added, ``Main:`` removed, null model set.

    A namespace table of several languages needs ``lang``; an id that occurs twice is an error.
    """
    names = local_names(namespaces, lang).select(F.col("id").alias("namespace_id"), F.col("name").alias("ns_name"))
    prefix = F.concat(F.coalesce("ns_name", F.lit("")), F.lit(":"))
    bare = F.col("namespace_id").isNull() | (F.col("namespace_id") == 0) | F.col("title").startswith(prefix)
    title = F.when(bare, F.col("title")).otherwise(F.concat(prefix, "title"))
    return (
        pages.join(names, "namespace_id", "left")
        .withColumn("title", strip_main(title))
        .withColumn("model", F.coalesce("model", F.lit("wikitext")))
        .select(*pages.columns)
    )


def strip_main(title: Column) -> Column:
    return F.when(title.startswith("Main:"), title.substr(F.lit(6), F.length(title))).otherwise(title)


def _outside(text: Column, start: str, end: str, unclosed: str | None = None) -> Column:
    """The text without what stands from a start mark to the next end mark.

    Cut at the start marks, a piece with an end mark gives what is behind it. One without lies inside when a
    later piece has an end mark; behind the last such piece nothing is closed: there ``unclosed`` stands for
    the start mark of pieces that stay, and without it they go.
    """

    def of(pieces: Column) -> Column:
        closing = F.transform(pieces, lambda p, i: F.when((i > 0) & p.rlike(end), i).otherwise(-1))

        def kept(last: Column) -> Column:
            rest = lambda p: F.lit("") if unclosed is None else F.concat(F.lit(unclosed), p)
            return F.array_join(F.transform(pieces, lambda p, i: (
                F.when(i == 0, p).when(p.rlike(end), F.get(F.split(p, end, 2), F.lit(1))).when(i < last, "").otherwise(rest(p))
            )), "")

        return bind(F.array_max(closing), kept)

    return bind(F.split(text, start), of)


def _insides(text: Column, start: str, end: str) -> Column:
    """struct<found,text>: how many start marks have an end mark, and what stands between them, joined."""
    state = F.struct(F.lit(0).alias("found"), F.lit("").alias("text"), F.lit(None).cast("string").alias("open"))

    def step(s: Column, piece: Column) -> Column:
        # A start mark inside an open pair is part of its text.
        bare = F.regexp_replace(piece, "^" + start, "")
        open_ = F.when(s["open"].isNotNull(), F.concat(s["open"], piece)).when(piece.rlike("^" + start), bare)

        def of(o: Column) -> Column:
            closed = F.coalesce(o.rlike(end), F.lit(False))
            inside = F.when(closed, F.get(F.split(o, end, 2), F.lit(0))).otherwise("")
            return F.struct(
                (s["found"] + closed.cast("int")).alias("found"), F.concat(s["text"], inside).alias("text"),
                F.when(~closed, o).alias("open"))

        return bind(open_, of)

    return F.aggregate(F.split(text, f"(?={start})"), state, step)


def template_body(body) -> Column:
    """The part of a template page that is transcluded.

    Comments go, then ``noinclude`` parts; one that is not closed takes the rest along. Where there is an
    ``onlyinclude`` pair, only the insides of such pairs stay. Marks of ``includeonly`` go, their text stays.
    """
    c = F.col(body) if isinstance(body, str) else body
    mark = lambda name: rf"(?iU)<{name}\s*>"
    c = _outside(c, "<!--", "-->", unclosed="<!--")
    c = _outside(c, mark("noinclude"), mark("/noinclude"))
    c = F.split_part(c, F.lit("<!--"), F.lit(1))

    def chosen(text: Column) -> Column:
        only = bind(text, lambda t: _insides(t, mark("onlyinclude"), mark("/onlyinclude")))
        any_empty = text.rlike(r"(?iU)<onlyinclude\s*/>")
        return bind(only, lambda o: F.when((o["found"] > 0) | any_empty, o["text"]).otherwise(text))

    return F.regexp_replace(bind(c, chosen), r"(?iU)<\s*(?:/\s*)?includeonly\s*(?:/\s*)?>", "")


def transclude_templates(pages: DataFrame, namespaces: DataFrame, lang: str | None = None) -> DataFrame:
    """B5 on the pages of the template namespace that are no redirects."""
    ids = local_names(namespaces, lang).where(F.col("canonical_name") == "Template").select(
        F.col("id").alias("namespace_id"), F.lit(True).alias("is_template")
    )
    reduced = F.when(F.col("is_template") & F.col("redirect_to").isNull(), template_body("body")).otherwise(F.col("body"))
    return pages.join(ids, "namespace_id", "left").withColumn("body", reduced).select(*pages.columns)


def latest(pages: DataFrame, *order: str) -> DataFrame:
    """Last page per key. Spark keeps one row per key and task before the shuffle."""
    w = Window.partitionBy(*KEY).orderBy(*[F.col(c).desc() for c in order])
    return pages.withColumn("nth", F.row_number().over(w)).where(F.col("nth") == 1).drop("nth")


def upsert_pages(base: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Insert or overwrite by (title, namespace_id); within the batch the last one wins.

    ``base`` holds every key once. Only the keys of the batch meet it, in an anti join:
    with a small batch the base table is not shuffled.
    """
    new = latest(batch, "ord")
    if base is None:
        return new
    columns = [c for c in base.columns if c in new.columns]
    kept = base.join(batch.select(*KEY).distinct(), KEY, "left_anti")
    return kept.select(*columns).unionByName(new.select(*columns))


def prepare(raw: DataFrame, namespaces: DataFrame, lang: str | None = None) -> DataFrame:
    """B1-B5 in order."""
    pages = split_redirect(content_model_filter(eligible(raw, namespaces)))
    return transclude_templates(normalise_title(pages, namespaces, lang), namespaces, lang)


def ingest_dump(spark: SparkSession, path: str, namespaces: DataFrame, out: str) -> int:
    """Dump into the page table at ``out``; returns the number of pages the table then has.

    The first dump makes the table. A later one replaces the pages it has and adds new ones: its pages are
    staged by namespace, and only these namespaces are merged and written anew, as a new version that
    readers see when it is complete (``sources.versions``). A run that stops leaves the table as it was.
    """
    pointer = versions.current(spark, out)
    batch = upsert_pages(None, prepare(read_dump(spark, path), namespaces)).select(*PAGE_COLUMNS)
    if pointer is None:
        versions.replace_parts(batch, out, None, "namespace_id")
    else:
        staged, touched = versions.write_parts(batch, f"{out}/_staged", None, "namespace_id")
        new = spark.read.schema(PAGES).parquet(f"{out}/_staged/v={staged}").select(*PAGE_COLUMNS)
        old = versions.read_parts(spark, out, pointer, PAGES, touched)
        kept = old.join(new.select(*KEY), KEY, "left_anti").select(*PAGE_COLUMNS)
        versions.replace_parts(kept.unionByName(new), out, pointer, "namespace_id")
    return read_pages(spark, out).count()
