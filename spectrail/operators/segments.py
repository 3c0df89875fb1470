"""Lines of documents and the molecule segments in them.

Every window is partitioned by document, so documents stay whole on one task only as far as their line tables, never their texts.
Empty documents have one empty line and no segment; documents whose statistics are uniform have none either (the comparisons are strict).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectrail.functions import text as X
from spectrail.functions.geometry import percent_box

LINES_PER_PAGE = 50


def document_lines(docs: DataFrame, key: str, column: str, per_page: int = LINES_PER_PAGE) -> DataFrame:
    """Rows (key, seq, page, line, text): the lines of each text, 0-based; null texts give no row."""
    lines = docs.select(key, F.posexplode_outer(F.split(column, "\n")).alias("seq", "text")).filter("seq is not null")
    return lines.select(key, F.col("seq").cast("bigint").alias("seq"), F.expr(f"seq div {per_page}").alias("page"), (F.col("seq") % per_page).cast("bigint").alias("line"), "text")


def renumber(blocks: DataFrame, key: str, order: list[str | Column]) -> DataFrame:
    """Blocks of a page in reading order: line numbers from 0 by the given order, which must be total."""
    return blocks.withColumn("line", (F.row_number().over(Window.partitionBy(key, "page").orderBy(*order)) - 1).cast("bigint"))


def page_blocks(blocks: DataFrame, keys: list[str], block: str, text: str, page_size: tuple[float, float], width: int = 250) -> DataFrame:
    """The lines of pages from their text blocks: cleaned, wrapped at words where longer than width, numbered from 0 in order of the blocks'
    upper edges, blocks and pieces, with the box in hundredths of the page as (y0, x0, y1, x1).

    blocks: keys (document and page), block, text and corners x0, y0, x1, y1. Blocks without text or box give no line.
    """
    from spectrail.operators.extraction import wrapped_lines

    w, h = page_size
    whole = blocks.filter(F.col(text).isNotNull() & F.col("y0").isNotNull()).withColumn(text, X.clean_text(F.col(text)))
    box = percent_box(*map(F.col, ("x0", "y0", "x1", "y1")), F.lit(w), F.lit(h))
    pieces = wrapped_lines(whole.withColumn("bbox", box), [*keys, block, "bbox"], text, width)
    order = Window.partitionBy(*keys).orderBy("bbox.y0", block, "piece")
    return pieces.select(*keys, (F.row_number().over(order) - 1).cast("bigint").alias("line"), "text", "bbox")


def line_statistics(lines: DataFrame, key: str) -> DataFrame:
    """Rows (key, seq, likelihood, spaces) of the eligible lines: more than 10 characters without blanks and noise, not starting Rf or mp."""
    t = X.without_noise(F.col("text"))
    eligible = lines.filter((F.length(F.replace(t, F.lit(" "), F.lit(""))) > 10) & ~F.col("text").startswith("Rf") & ~F.col("text").startswith("mp"))
    return eligible.select(key, "seq", X.name_likelihood(t).alias("likelihood"), X.count_of(t, " ").cast("bigint").alias("spaces"))


def _with_marks(stats: DataFrame, key: str, **marks: Column) -> DataFrame:
    """One row a document: the marks, and its lines' statistics as an array, so that statistics are computed and shuffled once.

    The arrays hold three numbers a line, less than the document's text, which is one value anyway.
    """
    return stats.groupBy(key).agg(F.collect_list(F.struct("seq", "likelihood", "spaces")).alias("__l"), *(c.alias(n) for n, c in marks.items()))


def segment_starts(stats: DataFrame, key: str, tokens_mark: float = 80, spaces_mark: float = 35) -> DataFrame:
    """Lines above the document's likelihood percentile and under its spaces percentile; both strict."""
    marked = _with_marks(stats, key, __t=F.percentile("likelihood", F.lit(tokens_mark / 100)), __s=F.percentile("spaces", F.lit(spaces_mark / 100)))
    return marked.select(key, F.inline(F.filter("__l", lambda x: (x["likelihood"] > F.col("__t")) & (x["spaces"] < F.col("__s")))))


def first_over(stats: DataFrame, key: str, mark: float = 50) -> DataFrame:
    """The first line of each document above its likelihood percentile."""
    marked = _with_marks(stats, key, __t=F.percentile("likelihood", F.lit(mark / 100)))
    over = F.transform(F.filter("__l", lambda x: x["likelihood"] > F.col("__t")), lambda x: x["seq"])
    return marked.select(key, F.array_min(over).alias("seq")).filter("seq is not null")


def option_starts(stats: DataFrame, key: str, options: DataFrame) -> DataFrame:
    """Starts under each of a few (option, tokens, spaces) marks, in one job: the percentiles of a document are taken as one array each.

    The options are a parameter table, written by hand, so they are expanded from literals instead of joined.
    """
    rows = [tuple(r) for r in options.select("option", "tokens", "spaces").orderBy("option").collect()]
    array = lambda i: F.array(*(F.lit(r[i] / 100) for r in rows))
    marked = _with_marks(stats, key, __t=F.percentile("likelihood", array(1)), __s=F.percentile("spaces", array(2)))
    zipped = F.arrays_zip(F.array(*(F.lit(r[0]) for r in rows)).alias("option"), F.col("__t").alias("t"), F.col("__s").alias("s"))
    expanded = marked.select(key, "__l", F.explode(zipped).alias("o"))
    return expanded.select(key, F.col("o.option").alias("option"), F.inline(F.filter("__l", lambda x: (x["likelihood"] > F.col("o.t")) & (x["spaces"] < F.col("o.s")))))


def segment_lines(lines: DataFrame, starts: DataFrame, key: str) -> DataFrame:
    """All lines with the number of their segment (from 1): each start opens one up to the next; lines before the first are dropped."""
    marked = lines.join(starts.select(key, "seq", F.lit(1).alias("__start")), [key, "seq"], "left")
    own = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marked.withColumn("segment", F.sum(F.coalesce("__start", F.lit(0))).over(own)).filter("segment > 0").drop("__start")


def segments(lines: DataFrame, starts: DataFrame, key: str) -> DataFrame:
    """Rows (key, segment, first_seq, last_seq, start_page, end_page, n_lines)."""
    grouped = segment_lines(lines, starts, key).groupBy(key, "segment")
    return grouped.agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.min("page").alias("start_page"), F.max("page").alias("end_page"), F.count(F.lit(1)).alias("n_lines"))


def segment_names(lines: DataFrame, key: str, group: str = "segment", depth: int = 3) -> DataFrame:
    """Rows (key, group, name): what stands before the tag in the first 1..depth lines joined, else the first line."""
    first = lines.withColumn("__i", F.row_number().over(Window.partitionBy(key, group).orderBy("seq"))).filter(F.col("__i") <= depth)
    joined = first.groupBy(key, group).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "text"))), lambda x: x["text"]).alias("__l"))
    tries = [X.compound_name(F.array_join(F.slice("__l", 1, n), "")) for n in range(1, depth + 1)]
    return joined.select(key, group, X.safe_name(F.coalesce(*tries, F.col("__l")[0])).alias("name"))


def keyword_lines(lines: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """Lines that hold a word (case counts): one row for each line and each such word, as every family is searched by itself."""
    return lines.withColumn("word", F.explode(F.filter(F.array(*(F.lit(w) for w in words)), lambda w: F.contains("text", w))))


def look_around(lines: DataFrame, hits: DataFrame, key: str, before: int = 1, after: int = 20, limit: str | None = None) -> DataFrame:
    """For each hit the lines [seq - before, seq + after), clipped to the document (or to the column limit): rows (key, hit, seq, text).

    Hits, of which there are fewer than lines, are expanded to the lines they may reach, at most before + after each, which makes a range
    join an equi-join. A line that is a hit by several words is one hit: its window is the same for each of them.
    """
    limits = [limit] if limit else []
    chosen = hits.select(key, F.col("seq").alias("hit"), *limits).distinct()
    spread = chosen.withColumn("seq", F.explode(F.sequence(F.col("hit") - before, F.col("hit") + (after - 1))))
    return lines.join(spread, [key, "seq", *limits]).select(key, "hit", "seq", "text")


def joined_text(windows: DataFrame, key: str) -> DataFrame:
    """Rows (key, hit, text, ends): the lines of a window joined without separator, and the length through each line."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "text")))
    rows = windows.groupBy(key, "hit").agg(parts.alias("__p"))
    ends = F.transform(F.sequence(F.lit(1), F.size("__p")), lambda i: F.aggregate(F.slice("__p", F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x["text"])))
    return rows.select(key, "hit", F.array_join(F.transform("__p", lambda x: x["text"]), "").alias("text"), F.transform("__p", lambda x: x["seq"]).alias("seqs"), ends.alias("ends"))


def end_line(joined: DataFrame, needle: Column) -> Column:
    """The seq of the first line through which the joined text holds the needle; null if it doesn't."""
    through = F.instr(joined["text"], needle) + F.length(needle) - 1
    return F.when(F.contains(joined["text"], needle), F.get(joined["seqs"], F.size(F.filter(joined["ends"], lambda e: e < through))))


def split_long(segs: DataFrame, key: str, max_pages: int = 1) -> DataFrame:
    """The segments that span more pages than allowed, to be located again with milder marks."""
    return segs.filter(F.col("end_page") - F.col("start_page") > max_pages)


def segment_pages(segs: DataFrame, key: str) -> DataFrame:
    """Rows (key, segment, page): every page of a segment."""
    return segs.select(key, "segment", F.explode(F.sequence("start_page", "end_page")).alias("page"))


def metadata(docs: DataFrame, key: str, column: str) -> DataFrame:
    """Rows (key, title, author, university, year, subject): labelled headings, else the first line that suggests one.

    Without a label: the title is the first line (of the first 5), author what follows ``by``, university and subject the first line
    with the word, year the first number of four digits.
    """
    lines = F.split(column, "\n")

    def first(of: Column, test, then) -> Column:
        return F.get(F.transform(F.filter(of, test), then), F.lit(0))

    low = lambda x, w: F.contains(F.lower(x), F.lit(w))
    year = r"(?:^|\W)(\d{4})(?:\W|$)"
    return docs.select(
        key,
        F.coalesce(X.labelled(F.col(column), "title"), F.trim(F.get(lines, F.lit(0)))).alias("title"),
        F.coalesce(X.labelled(F.col(column), "author"), first(lines, lambda x: low(x, "by"), lambda x: F.trim(F.substring_index(F.trim(x), "by", -1)))).alias("author"),
        F.coalesce(X.labelled(F.col(column), "university"), first(lines, lambda x: low(x, "university"), lambda x: F.trim(x))).alias("university"),
        F.coalesce(X.labelled(F.col(column), "year"), F.nullif(F.regexp_extract(column, year, 1), F.lit(""))).alias("year"),
        F.coalesce(X.labelled(F.col(column), "subject"), first(lines, lambda x: low(x, "subject"), lambda x: F.trim(x))).alias("subject"),
    )


def split_at_ends(inside: DataFrame, ends: DataFrame, keys: list[str]) -> DataFrame:
    """Adds part (from 1): a segment's lines cut behind each end (keys, seq); a segment without ends is one part."""
    marked = inside.join(ends.select(*keys, "seq", F.lit(1).alias("__end")).distinct(), [*keys, "seq"], "left")
    before = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return marked.withColumn("part", (F.coalesce(F.sum("__end").over(before), F.lit(0)) + 1).cast("bigint")).drop("__end")


def first_pages(lines: DataFrame, key: str, pages: int = 5) -> DataFrame:
    """Rows (key, text): the text of the first pages, as much as there is."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return lines.filter(F.col("page") < pages).groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text"))
