"""Page archives to rows: links, ranked candidates, table cells, fingerprints."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import ascii_fold, decimal_comma
from .tables import ARROW, grid, named_batches, page_tables

ANCHOR = r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>"""
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&"))


def plain(html: Column) -> Column:
    """Text without tags, five entities decoded, spaces collapsed."""
    text = F.regexp_replace(html, r"(?s)<[^>]*>", " ")
    for code, char in ENTITIES:
        text = F.replace(text, F.lit(code), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def plain_cell(html: Column) -> Column:
    """`plain`, for short texts that seldom have anything to replace."""
    return F.when(html.rlike(r"[<&]|[^\S ]|  "), plain(html)).otherwise(F.trim(html))


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#:]+)", 1)), r"^www\.", "")


def absolute(base: Column, href: Column) -> Column:
    root, folder = F.regexp_extract(base, r"^([a-zA-Z]+://[^/?#]+)", 1), F.regexp_extract(base, r"^([a-zA-Z]+://[^?#]*/)", 1)
    href = F.trim(F.regexp_replace(href, "#.*$", ""))
    return (
        F.when(href.rlike("^[a-zA-Z]+://"), href).when(href.startswith("//"), F.concat(F.regexp_extract(base, "^([a-zA-Z]+:)", 1), href))
        .when(href.startswith("/"), F.concat(root, href)).when(href == "", base).otherwise(F.concat(F.when(folder == "", F.concat(root, F.lit("/"))).otherwise(folder), href))
    )


def links(pages: DataFrame) -> DataFrame:
    """(page_id, base, url, text, position): links to the same host, each URL once per page at its first place."""
    hits = F.arrays_zip(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(2)).alias("label"))
    each = pages.select("page_id", F.col("url").alias("base"), F.posexplode(hits).alias("position", "a"))
    each = each.select("page_id", "base", absolute(F.col("base"), F.col("a.href")).alias("url"), plain(F.col("a.label")).alias("text"), F.col("position").cast("long").alias("position"))
    each = each.where(host(F.col("url")) == host(F.col("base")))
    first = Window.partitionBy("page_id", "url").orderBy("position")
    return each.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def ranked_candidates(found: DataFrame, cities: list[str], vocabulary: list[str], days: DataFrame, top: int = 12, least: int = 5) -> DataFrame:
    """Article candidates of each landing page by a score of city, vocabulary, date and path signals; days(page_id, day)."""
    both = F.concat_ws(" ", ascii_fold(F.col("text")), ascii_fold(F.col("url")))
    hits = lambda terms: F.size(F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(both, t)))
    some = lambda n, first: F.when(n > 0, first + F.least(n - 1, F.lit(2))).otherwise(0)
    path = F.regexp_extract("url", r"^[a-zA-Z]+://[^/]+([^?#]*)", 1)
    score = (
        some(hits(cities), 4) + some(hits(vocabulary), 3) + F.when(F.col("dated"), 4).otherwise(0) + F.when(path.rlike("(?i)/(haber|yazi|article|news|post)"), 2).otherwise(0)
        + F.when(path.rlike(r"[a-z0-9]+-[a-z0-9]+-[a-z0-9]+"), 1).otherwise(0) - F.when(path.rlike("(?i)/(login|about|contact|privacy|tag)"), 4).otherwise(0)
        - F.when(path.rlike(r"(?i)\.(jpg|png|gif|css|js|pdf)$") | (F.col("url") == F.col("base")), 100).otherwise(0)
    )
    order = Window.partitionBy("page_id").orderBy(F.col("score").desc(), "position")
    return dated_links(found, days).withColumn("score", score.cast("long")).where(F.col("score") >= least).withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= top).drop("dated")


def cells(pages: DataFrame) -> DataFrame:
    """(page_id, table_no, depth, row_no, col_no, cell, head, origin): every place of every HTML table, nested ones too.

    A cell that spans columns or rows stands at every place it covers, `origin` at the first; its text is that of no inner table.
    """
    return grid(pages).select("page_id", "table_no", "depth", "row_no", "col_no", plain(F.col("body")).alias("cell"), "head", "origin")


def date_spellings(days: DataFrame) -> DataFrame:
    """(day, spelling): the spellings of each different `day`, folded as link texts are; five are different after folding."""
    d = F.col("day")
    patterns = ["yyyy-MM-dd", "dd-MM-yyyy", "dd.MM.yyyy", "dd/MM/yyyy", "ddMMyyyy", "yyyyMMdd", "d-M-yyyy", "d.M.yyyy", "d/M/yyyy"]  # fixed values
    each = days.select("day").where("day is not null").distinct().select("day", F.explode(F.array(*[F.date_format(d, p) for p in patterns])).alias("spelling"))
    return each.select("day", ascii_fold(F.col("spelling")).alias("spelling")).distinct()


# What may be a spelling in a folded text: every place at which one can begin, so that longer numbers hold shorter ones.
DATE_FORMS = [r"(?=(\d{4} \d\d \d\d))", r"(?=(\d\d \d\d \d{4}))", r"(?=(\d{8}))", r"(?=(\d \d \d{4}))", r"(?=(\d\d \d \d{4}))", r"(?=(\d \d\d \d{4}))"]


def dated_links(found: DataFrame, days: DataFrame) -> DataFrame:
    """`found` links with `dated`: whether text or URL holds a spelling of the page's day; days(page_id, day).

    The spellings are a table of their own, met by equality with what looks like a date in the link, so no link is
    compared with a list.
    """
    both = F.concat_ws(" ", ascii_fold(F.col("text")), ascii_fold(F.col("url")))
    forms = F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(both, F.lit(p), F.lit(1)) for p in DATE_FORMS])))
    each = found.select("page_id", "url", F.explode(forms).alias("spelling")).join(days.select("page_id", "day"), "page_id")
    hits = each.join(date_spellings(days), ["day", "spelling"]).select("page_id", "url").distinct().withColumn("dated", F.lit(True))
    return found.join(hits, ["page_id", "url"], "left").withColumn("dated", F.coalesce("dated", F.lit(False)))


def tables(pages: DataFrame) -> DataFrame:
    """(page_id, table_no, depth, lines): every table of a page in one row; `lines` are its rows with their cells' HTML."""
    return page_tables(pages).select("page_id", F.explode("tables").alias("t")).select("page_id", "t.table_no", "t.depth", "t.lines")


def named_columns(found: DataFrame, aliases: dict[str, list[str]], header_rows: int = 4) -> DataFrame:
    """(page_id, table_no, row_no, logical columns by name): rows of `tables`, the columns told by header text in the first rows.

    A logical column is the first place of one of its spellings; rows after the last of these places that have a cell in
    any of the columns are returned. A table is one row, so nothing is exchanged.
    """
    spellings = {name: sorted({ascii_fold_text(a) for a in all_}) for name, all_ in aliases.items()}
    cells = lambda l: F.transform(l["cells"], lambda c, i: F.struct(l["row_no"].alias("row_no"), i.alias("col_no"), ascii_fold(plain(c)).alias("folded")))
    heads = F.flatten(F.transform(F.filter("lines", lambda l: l["row_no"] < header_rows), cells))
    known = F.filter(heads, lambda h: h["folded"].isin(sorted({x for all_ in spellings.values() for x in all_})))
    first = lambda name: F.array_min(F.transform(F.filter("heads", lambda h: h["folded"].isin(spellings[name])), lambda h: F.struct(h["row_no"].alias("row_no"), h["col_no"].alias("col_no"))))
    names = sorted(aliases)
    placed = found.withColumn("heads", known).where(F.size("heads") > 0).select("page_id", "table_no", "lines", *[first(n).alias(f"_{n}") for n in names])
    placed = placed.withColumn("_last", F.array_max(F.array(*[F.col(f"_{n}")["row_no"] for n in names])))
    lines = placed.select("page_id", "table_no", "_last", *[F.col(f"_{n}")["col_no"].alias(f"_{n}") for n in names], F.explode("lines").alias("l")).where("l.row_no > _last")
    bodies = lines.select("page_id", "table_no", "l.row_no", *[F.try_element_at("l.cells", F.col(f"_{n}") + 1).alias(n) for n in names]).where(F.coalesce(*[F.col(n) for n in names]).isNotNull())
    return bodies.select("page_id", "table_no", "row_no", *[plain(F.col(n)).alias(n) for n in names])


def named_rows(pages: DataFrame, aliases: dict[str, list[str]], header_rows: int = 4, largest: bool = False) -> DataFrame:
    """`named_columns` of all tables of the pages, or of the largest one of each, by one pass over the pages: what isn't a named column never leaves it."""
    names, known = sorted(aliases), {}
    for k, name in enumerate(names):
        for folded in {ascii_fold_text(a) for a in aliases[name]}:
            known.setdefault(folded, []).append(k)
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = named_batches(known, names, folded_cell, header_rows, largest, ARROW[kind])
    found = pages.select("page_id", "html").mapInArrow(rows, f"page_id {kind}, table_no int, row_no int, {', '.join(f'`{n}` string' for n in names)}")
    return found.select("page_id", "table_no", "row_no", *[plain_cell(F.col(n)).alias(n) for n in names])


@lru_cache(4096)
def folded_cell(html: str) -> str:
    """A header cell as `ascii_fold` of `plain` gives it."""
    text = re.sub(r"(?s)<[^>]*>", " ", html)
    for code, char in ENTITIES:
        text = text.replace(code, char)
    return ascii_fold_text(text)


def ascii_fold_text(text: str) -> str:
    low = text.translate(str.maketrans("Iİ", "ıi")).lower().translate(str.maketrans("ığüşöç", "igusoc"))
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in low).split())


# Header spellings.
HISTORY_HEADERS = {
    "date": ["Tarih"], "city": ["Şehir"], "distance": ["Msf", "Mesafe"], "track": ["Pist"], "place": ["S", "Sıra"], "carried": ["Sıklet", "Kilo"], "jockey": ["Jokey"], "odds": ["Gny", "Ganyan"], "hp": ["HP"],
}


def history_rows(pages: DataFrame) -> DataFrame:
    """Past races of a horse from the largest table of its page; who needs them newest first orders by `race_date`."""
    rows = named_rows(pages, HISTORY_HEADERS, largest=True)
    number = lambda c: F.regexp_extract(c, r"\d+", 0).try_cast("int")
    return rows.select(
        "page_id", F.try_to_date("date", "dd.MM.yyyy").alias("race_date"), "city", number("distance").alias("distance_meters"), "track", number("place").alias("finish_position"),
        decimal_comma(F.col("carried")).alias("weight"), "jockey", decimal_comma(F.col("odds")).alias("odds"), number("hp").alias("hp"),
    ).where("race_date is not null")


def result_rows(found: DataFrame) -> DataFrame:
    """NAME(no) cells with a place: (page_id, race_no, horse_number, name, finish_position); "did not run" is 0; the first table of a race counts."""
    name = F.regexp_extract("runner", r"^(.*?)\s*\((\d+)\)", 1)
    number = F.regexp_extract("runner", r"\((\d+)\)", 1).try_cast("int")
    place = F.when(F.lower("place").rlike("kosmaz|koşmaz|did not run"), 0).otherwise(F.regexp_extract("place", r"^\d+", 0).try_cast("int"))
    first = Window.partitionBy("page_id", "race_no").orderBy("table_no")
    return (
        found.withColumn("_t", F.dense_rank().over(first)).where("_t = 1").select("page_id", "race_no", number.alias("horse_number"), name.alias("name"), place.alias("finish_position"))
        .where("horse_number is not null")
    )


def fingerprint(df: DataFrame, key: str, *columns: str) -> DataFrame:
    return df.select(key, F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256).alias("fingerprint"))


def changed(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """Rows whose fingerprint is new or other than before."""
    return now.join(before, [key, "fingerprint"], "left_anti")
