"""Programme pages and frozen snapshots to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import city_fold, decimal_comma, lower_tr
from .pages import links, named_rows, plain

# Spellings of the programme pages.
CARD_HEADERS = {"number": ["N", "No"], "name": ["At İsmi"], "weight": ["Sıklet", "Kilo"], "jockey": ["Jokey"], "share": ["AGF"], "hp": ["HP"]}
RACE_WORD, POOL, STARTS_HERE = "koşu", "6 lı ganyan", "bu koşudan başlar"
TRACKS = {"kum": "Kum", "çim": "Çim", "cim": "Çim", "sentetik": "Sentetik"}
PROGRAMME_PATH = r"/GunlukYarisProgrami\b"
CITY_KEY = "SehirAdi"
FOREIGN = "(YD"

BLOCK = r"(?is)<h3[^>]*>.*?</h3>|<table[^>]*>.*?</table>|>[^<]*[^<\s][^<]*(?=<)"

# The headings and, as empty strings, the tables of BLOCK; its other texts have no tag, so they take nothing from these.
HEADING = r"(?is)(<h3[^>]*>.*?</h3>)|<table[^>]*>.*?</table>"

INNER = r">[^<]*[^<\s][^<]*(?=<)"


def tokens(text: Column) -> Column:
    """Runs of letters and runs of digits, lower case; what stands between them only parts them."""
    apart = F.regexp_replace(F.regexp_replace(lower_tr(F.coalesce(text, F.lit(""))), r"(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})", " "), r"[^\p{L}\p{N}]+", " ")
    return F.filter(F.split(apart, " "), lambda t: t != "")


def race_mark(words: Column) -> Column:
    """struct(race_no, time) of a heading like "3. Koşu 14.30"; NULL for others."""
    number = F.try_element_at(words, F.lit(1))
    later = F.filter(F.slice(words, F.lit(3), F.greatest(F.size(words) - 2, F.lit(0))), lambda t: t.rlike("^[0-9]+$"))
    hour, minute = F.try_element_at(later, F.lit(1)), F.try_element_at(later, F.lit(2))
    whole = F.coalesce(number.rlike("^[0-9]+$"), F.lit(False)) & (F.try_element_at(words, F.lit(2)) == RACE_WORD) & (F.length(hour) <= 2) & (F.length(minute) == 2)
    return F.when(F.coalesce(whole, F.lit(False)), F.struct(number.try_cast("long").alias("race_no"), F.concat(F.lpad(hour, 2, "0"), F.lit(":"), minute).alias("time")))


def surface_named(words: Column) -> Column:
    """struct(distance_meters, track) where three or four digits stand before the name of a track."""
    names = F.create_map(*[F.lit(x) for pair in TRACKS.items() for x in pair])
    before = F.slice(F.concat(F.array(F.lit("")), words), F.lit(1), F.size(words))
    pairs = F.zip_with(before, words, lambda n, t: F.struct(n.alias("n"), F.try_element_at(names, t).alias("track")))
    first = F.try_element_at(F.filter(pairs, lambda p: p["track"].isNotNull() & p["n"].rlike("^[0-9]{3,4}$")), F.lit(1))
    return F.when(first.isNotNull(), F.struct(first["n"].cast("long").alias("distance_meters"), first["track"].alias("track")))


def start_mark(words: Column) -> Column:
    """1 or 2 where a text says that this pool starts with this race."""
    line = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    number = F.substring_index(F.substring_index(line, f" {POOL} ", 1), " ", -1)
    after = F.substring(line, F.locate(f" {POOL} ", line).cast("int") + len(POOL), F.length(line))
    return F.when(F.contains(line, F.lit(f" {POOL} ")) & number.isin("1", "2") & F.contains(after, F.lit(f" {STARTS_HERE} ")), number.cast("long"))


def pieces(pages: DataFrame) -> DataFrame:
    """(page_id, position, block, text, kind, words, mark): headings, tables and other texts of a page in order; a race heading has a mark."""
    each = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(BLOCK), F.lit(0))).alias("position", "block"))
    heading = F.col("kind") == "h3"
    each = each.withColumn("kind", F.when(F.lower(F.col("block")).startswith("<h3"), "h3").when(F.lower(F.col("block")).startswith("<table"), "table").otherwise("text"))
    each = each.withColumn("text", plain(F.when(F.col("kind") == "text", F.substr("block", F.lit(2))).otherwise(F.col("block"))))
    return each.withColumn("words", F.when(heading, tokens(F.col("text")))).withColumn("mark", race_mark(F.col("words")))


def tables_of_races(pages: DataFrame) -> DataFrame:
    """(page_id, table_no, race_no, time, distance_meters, track): the tables at or after a race heading, each of the nearest one before it.

    The surface is that of the first heading after the race heading that names one, as far down the page as need be: it is
    found from the page's end, so that both walks look one row back. The texts stay out of the walks.
    """
    each = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(HEADING), F.lit(1))).alias("position", "block"))
    each = each.select("page_id", "position", F.when(F.col("block") == "", "table").otherwise("h3").alias("kind"), F.when(F.col("block") != "", tokens(plain(F.col("block")))).alias("words"))
    each = each.withColumn("mark", race_mark(F.col("words")))
    each = each.select("page_id", "position", "kind", "mark", F.when(F.col("mark").isNull(), surface_named(F.col("words"))).alias("surface"))
    page = Window.partitionBy("page_id")
    up, down = page.orderBy(F.col("position").desc()), page.orderBy("position")
    later = F.last("surface", ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = each.withColumn("later", later).withColumn("race", F.when(F.col("mark").isNotNull(), F.struct("mark.race_no", "mark.time", F.col("later").alias("surface"))))
    known = marked.where("kind = 'table' or race is not null").withColumn("race", F.last("race", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    tables = known.withColumn("table_no", F.count_if(F.col("kind") == "table").over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1).where("kind = 'table' and race is not null")
    return tables.select("page_id", F.col("table_no").cast("int").alias("table_no"), "race.race_no", "race.time", "race.surface.distance_meters", "race.surface.track")


def card_rows(pages: DataFrame) -> DataFrame:
    """A row a runner: tables with a name and a jockey column, paired with the nearest race heading before them; a table without one has no rows."""
    rows = named_rows(pages, CARD_HEADERS).where(F.col("name").isNotNull() & F.col("jockey").isNotNull() & (F.col("name") != "") & F.col("number").rlike(r"\d"))
    number = lambda c: decimal_comma(F.col(c)).cast("long")
    share = F.coalesce(*[F.nullif(F.regexp_extract("share", p, 1), F.lit("")) for p in (r"%\s*(\d+(?:[,.]\d+)?)", r"(\d+(?:[,.]\d+)?)\s*%")])
    return rows.join(tables_of_races(pages), ["page_id", "table_no"]).select(
        "page_id", "race_no", "time", "distance_meters", "track", number("number").alias("horse_number"), "name", decimal_comma(F.col("weight")).alias("weight"),
        F.nullif("jockey", F.lit("")).alias("jockey"), number("hp").alias("hp"), decimal_comma(share).alias("agf_percent"),
    )


def sixfold_starts(pages: DataFrame) -> DataFrame:
    """(page_id, race_no, sixfold_numbers): start markers anywhere in a page, in tables and headings too, carried by the nearest race heading at or before them.

    A block's markers are read before the walk down the page, which then takes race headings and blocks with markers only;
    blocks without the pool's last word have none.
    """
    inner = F.transform(F.regexp_extract_all("block", F.lit(INNER), F.lit(0)), lambda t: plain(F.substr(t, F.lit(2))))
    texts = F.when(F.col("kind") == "table", inner).when(F.col("kind") == "text", F.array("text")).otherwise(F.concat(inner, F.array("text")))  # a marker may be cut by tags within a heading
    numbers = F.array_compact(F.transform(texts, lambda t: start_mark(tokens(t))))
    found = F.when(F.contains(lower_tr(F.col("block")), F.lit(POOL.split()[-1])), numbers).otherwise(F.array().cast("array<bigint>"))
    each = pieces(pages).select("page_id", "position", F.col("mark.race_no").alias("race_no"), found.alias("numbers")).where("race_no is not null or size(numbers) > 0")
    down = Window.partitionBy("page_id").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hits = each.withColumn("race_no", F.last("race_no", ignorenulls=True).over(down)).where("race_no is not null").select("page_id", "race_no", F.explode("numbers").alias("n"))
    return hits.groupBy("page_id", "race_no").agg(F.array_sort(F.collect_set("n")).alias("sixfold_numbers"))


def meeting_links(pages: DataFrame, path: str = PROGRAMME_PATH, key: str = CITY_KEY) -> DataFrame:
    """(page_id, city, url): programme links of index pages, foreign meetings left out, the first one a folded city.

    The city comes from the query parameter, else from the label without parentheses; links without either are left out.
    """
    city = F.coalesce(F.nullif(F.trim(F.try_url_decode(F.regexp_extract("url", rf"[?&]{key}=([^&#]*)", 1))), F.lit("")), F.nullif(F.trim(F.regexp_replace("text", r"\s*\(.*$", "")), F.lit("")))
    found = links(pages).where(F.col("url").rlike(path) & ~F.contains("text", F.lit(FOREIGN))).withColumn("city", city).withColumn("folded", city_fold(F.col("city"))).where("folded <> ''")
    first = Window.partitionBy("page_id", "folded").orderBy("position")
    return found.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("page_id", "city", "url")


SNAPSHOT = "struct<runners:array<struct<horse_number:bigint,picks:array<struct<source_key:string,source_rank:bigint>>>>>"


def snapshot_rows(frozen: DataFrame, document: str = "snapshot") -> DataFrame:
    """Frozen race documents to a row a runner and pick; a runner without picks has one row, an unreadable document or one without runners none."""
    keys: list[Column] = [F.col(c) for c in frozen.columns if c != document]
    runner = frozen.select(*keys, F.explode(F.from_json(document, SNAPSHOT)["runners"]).alias("_r")).where("_r.horse_number is not null")
    return runner.select(*keys, F.col("_r.horse_number").alias("horse_number"), F.explode_outer("_r.picks").alias("_p")).select(*keys, "horse_number", "_p.source_key", "_p.source_rank")
