"""Cut quality: where block borders fall in a document's lines, fences, tables and sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratadoc.functions.text import is_fence, lone_fences, strip_left

#: Fixed values.
HEADING = r"^(#{1,6})[\s\p{Z}]+(.+)$"
TABLE_RULE = r"^\s*\|[\s:|-]+\|\s*$"


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, n, line, start (character offset), mark (a fence line's first three characters), bare."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    before = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    bare = strip_left(F.col("line"))
    return rows.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("long")).withColumn("bare", bare).withColumn(
        "mark", F.when(is_fence(F.col("line")), F.substring(bare, 1, 3))
    )


def fenced_lines(docs: DataFrame) -> DataFrame:
    """lines() with fence: the number of the fence that a line belongs to, its two marks included; null outside.

    A fence ends at a line with the mark that opened it. The fences of a document are folded over its fence lines alone.
    """
    all_lines = lines(docs)
    marks = all_lines.filter(F.col("mark").isNotNull()).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "mark"))).alias("marks"))
    state = "struct<spans:array<struct<first:int,last:int>>,mark:string,first:int>"
    start = F.expr(f"cast(named_struct('spans', array(), 'mark', null, 'first', null) as {state})")

    def step(s, m):
        opens = F.struct(s["spans"].alias("spans"), m["mark"].alias("mark"), m["n"].alias("first"))
        closed = F.concat(s["spans"], F.array(F.struct(s["first"].alias("first"), m["n"].alias("last"))))
        closes = F.struct(closed.alias("spans"), F.lit(None).cast("string").alias("mark"), F.lit(None).cast("int").alias("first"))
        return F.when(s["mark"].isNull(), opens).when(s["mark"] == m["mark"], closes).otherwise(s).cast(state)

    ends = F.aggregate("marks", start, step, lambda s: F.when(s["first"].isNull(), s["spans"]).otherwise(F.concat(s["spans"], F.array(F.struct(s["first"].alias("first"), F.lit(2**31 - 1).alias("last"))))))
    spans = marks.select("doc_id", F.posexplode(ends).alias("fence", "span")).select("doc_id", "fence", "span.first", "span.last")
    firsts = spans.select("doc_id", F.col("first").alias("n"), "fence", "last")
    seen = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    joined = all_lines.join(firsts, ["doc_id", "n"], "left")
    joined = joined.withColumn("at", F.last("fence", True).over(seen)).withColumn("to", F.last("last", True).over(seen))
    return joined.withColumn("fence", F.when(F.col("n") <= F.col("to"), F.col("at"))).drop("at", "to", "last")


def fence_ranges(docs: DataFrame) -> DataFrame:
    """doc_id, start, end (half-open, in characters) of each fence; one without an end reaches the text's."""
    return fenced_lines(docs).filter(F.col("fence").isNotNull()).groupBy("doc_id", "fence").agg(
        F.min("start").alias("start"), F.max(F.col("start") + F.length("line")).alias("end")
    ).drop("fence")


def table_ranges(docs: DataFrame) -> DataFrame:
    """doc_id, start, end of each run of lines that begin with a bar."""
    rows = lines(docs).withColumn("is_row", F.startswith("bare", F.lit("|")))
    by_n = Window.partitionBy("doc_id").orderBy("n")
    island = F.sum(F.when(F.col("is_row"), 0).otherwise(1)).over(by_n.rowsBetween(Window.unboundedPreceding, 0))
    runs = rows.withColumn("island", island).filter("is_row").groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max(F.col("start") + F.length("line")).alias("end"))
    return runs.filter(F.col("end") - F.col("start") > 1).drop("island")


def headings(docs: DataFrame) -> DataFrame:
    """doc_id, offset, level, title of the headings outside fences."""
    rows = fenced_lines(docs).filter(F.col("fence").isNull() & F.col("bare").rlike(HEADING))
    return rows.select("doc_id", F.col("start").alias("offset"), F.length(F.regexp_extract("bare", HEADING, 1)).cast("long").alias("level"), F.trim(F.regexp_extract("bare", HEADING, 2)).alias("title"))


def _titles(heads: DataFrame) -> DataFrame:
    """heads with titles: an array of six, the title in force at each level when this heading has come; null where none is."""
    named = heads
    upto = Window.partitionBy("doc_id").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    for n in range(1, 7):
        here = F.when(F.col("level") == n, F.struct("offset", "title"))
        named = named.withColumn(f"l{n}", F.last(here, True).over(upto)).withColumn(f"r{n}", F.max(F.when(F.col("level") < n, F.col("offset"))).over(upto))
    alive = lambda n: F.when(F.col(f"r{n}").isNull() | (F.col(f"l{n}.offset") > F.col(f"r{n}")), F.col(f"l{n}.title"))
    return named.select("doc_id", "offset", F.array(*map(alive, range(1, 7))).alias("titles"))


def sections(docs: DataFrame) -> DataFrame:
    """doc_id, section, body, path (level to title): each heading outside fences begins a section, which holds it.

    Lines end at a line feed; empty lines around a body go, and a body of white space alone is no section. All of it runs
    in the JVM: fences are folded over their marks, sections are counts of headings so far, titles the last ones alive.
    """
    rows = fenced_lines(docs).withColumn("head", F.col("fence").isNull() & F.col("bare").rlike(HEADING))
    upto = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_s", F.count_if("head").over(upto))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    bodies = rows.groupBy("doc_id", "_s").agg(F.regexp_replace(joined, r"\A\n+|\n+\z", "").alias("body"), F.min(F.when(F.col("head"), F.col("start"))).alias("offset"))
    bodies = bodies.filter(F.col("body").rlike(r"[^\s\p{Z}]"))
    heads = rows.filter("head").select("doc_id", F.col("start").alias("offset"), F.length(F.regexp_extract("bare", HEADING, 1)).alias("level"), F.regexp_replace(F.regexp_extract("bare", HEADING, 2), r"[\s\p{Z}]+\z", "").alias("title"))
    entries = F.filter(F.transform("titles", lambda t, k: F.struct((k + 1).alias("key"), t.alias("value"))), lambda e: e["value"].isNotNull())
    paths = _titles(heads).select("doc_id", "offset", F.map_from_entries(entries).alias("path"))
    order = Window.partitionBy("doc_id").orderBy("_s")
    none = F.expr("cast(map() as map<int,string>)")
    return bodies.join(paths, ["doc_id", "offset"], "left").select("doc_id", (F.row_number().over(order) - 1).alias("section"), "body", F.coalesce("path", none).alias("path"))


def atoms(docs: DataFrame) -> DataFrame:
    """doc_id, atom, kind (text, fence or table), text: a document's lines as runs of one kind; each fence is one of its own."""
    kind = F.when(F.col("fence").isNotNull(), "fence").when(F.startswith("bare", F.lit("|")), "table").otherwise("text")
    rows = fenced_lines(docs).withColumn("kind", kind)
    by_n = Window.partitionBy("doc_id").orderBy("n")
    same = (F.lag("kind").over(by_n) == F.col("kind")) & F.lag("fence").over(by_n).eqNullSafe(F.col("fence"))
    rows = rows.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("atom", F.sum("_new").over(by_n.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy("doc_id", "atom", "kind").agg(text.alias("text"))


def path_at(points: DataFrame, heads: DataFrame) -> DataFrame:
    """The section path (titles joined by " > ") in force at each point (doc_id, offset): headings up to it, inclusive.

    A heading's titles above it are worked out once for each heading; a point then takes the last heading before it. A
    level counts if no shallower heading came after it.
    """
    paths = _titles(heads).select("doc_id", "offset", F.array_join(F.array_compact("titles"), " > ").alias("path"))
    # Points and headings in one order: a point takes the last path before it, in one pass over each document.
    both = points.select("doc_id", "offset", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("path")).unionByName(paths.withColumn("kind", F.lit(0)))
    order = Window.partitionBy("doc_id").orderBy("offset", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("path", F.coalesce(F.last("path", True).over(order), F.lit(""))).filter("kind = 1").drop("kind")


def cuts(pieces: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, offset, place of each block's start but a document's first: line, fence, table or prose.

    place is line where only white space stands before the cut in its line, else what the cut line belongs to.
    """
    starts = pieces.filter("ord > 0").select("doc_id", F.col("offset").cast("long").alias("offset"))
    rows = fenced_lines(docs).select("doc_id", F.col("start").alias("offset"), F.col("line"), F.col("start").alias("line_start"), F.col("fence").isNotNull().alias("fenced"), F.startswith("bare", F.lit("|")).alias("row"))
    both = starts.withColumn("kind", F.lit(1)).unionByName(rows.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy("doc_id").orderBy("offset", "kind").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, True).over(order)
    placed = both.select("doc_id", "offset", "kind", last("line").alias("line"), last("line_start").alias("line_start"), last("fenced").alias("fenced"), last("row").alias("row")).filter("kind = 1")
    ahead = F.substring(F.col("line"), F.lit(1), (F.col("offset") - F.col("line_start")).cast("int"))
    place = F.when(strip_left(ahead) == "", "line").when(F.col("fenced"), "fence").when(F.col("row"), "table").otherwise("prose")
    return placed.select("doc_id", "offset", place.alias("place"))


def headerless(text):
    """Whether a block begins with a table row whose next line is no rule."""
    parts = F.split(text, "\n", -1)
    return (F.size(parts) >= 2) & F.startswith(strip_left(parts[0]), F.lit("|")) & ~F.get(parts, 1).rlike(TABLE_RULE)


def cut_quality(pieces: DataFrame, docs: DataFrame, size: int = 500) -> DataFrame:
    """Counts for each document: blocks, cuts by place, and blocks with torn fences, headless tables, too many characters."""
    torn, over = lone_fences(F.col("text")) % 2 == 1, F.length("text") > size
    blocks = pieces.groupBy("doc_id").agg(
        F.count("*").alias("n_blocks"), F.count_if(torn).alias("torn"), F.count_if(headerless(F.col("text"))).alias("headerless"), F.count_if(over).alias("over_size"), F.count_if(~torn & ~over).alias("clean")
    )
    places = cuts(pieces, docs).groupBy("doc_id").agg(*(F.count_if(F.col("place") == p).alias(f"cut_{p}") for p in ("line", "fence", "table", "prose")))
    zero = [F.coalesce(f"cut_{p}", F.lit(0)).alias(f"cut_{p}") for p in ("line", "fence", "table", "prose")]
    return blocks.join(places, "doc_id", "left").select("doc_id", "n_blocks", "torn", "headerless", "over_size", "clean", *zero)


def cut_deltas(totals: DataFrame, measures: list[str], before: str, after: str) -> DataFrame:
    """measure, before, after, diff and percent (of before, null where that is 0), from one row of totals for each chunker."""
    rows = totals.select("chunker", F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("long").alias("n")) for m in measures))).alias("m"))
    of = lambda name: F.max(F.when(F.col("chunker") == name, F.col("m.n")))
    found = rows.groupBy("m.measure").agg(of(before).alias("before"), of(after).alias("after")).withColumn("diff", F.col("after") - F.col("before"))
    return found.withColumn("percent", F.col("diff") * 100.0 / F.nullif(F.col("before"), F.lit(0)))
