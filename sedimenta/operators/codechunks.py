"""Chunks of code files for retrieval, from their text and a frame of their definitions.

A definition of up to MOST lines is a chunk. A larger one gives a chunk of its head, up to its first member, and its members take its place, and so on
down; without members it is cut into overlapping windows. What lies between is module code. Definitions (path, kind, name, parent, start, end):
name is qualified, parent the name of the definition around it or null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions.files import language
from sedimenta.plans import codebase as cb
from sedimenta.plans.registry import query
from sedimenta.plans.storage import Kept

c = F.col
#: Lines of a chunk, of a gap that is worth one, of a window and of its overlap; levels of members that are looked at.
MOST, LEAST_GAP, WIDE, OVERLAP, LEVELS = 120, 3, 60, 10, 6
# Languages whose definitions are known, endings of documents, and kinds whose functions are methods.
GRAMMARS = "python javascript typescript tsx go rust java ruby c cpp csharp kotlin php swift".split()
DOCUMENTS = (".md", ".mdx", ".rst", ".txt", ".adoc")
WITH_METHODS = ("class", "impl", "trait", "interface")


def windows(start: Column, end: Column) -> Column:
    """Runs of WIDE lines that overlap by OVERLAP, the last one ending at `end`."""
    step = WIDE - OVERLAP
    n = F.greatest(F.lit(1), F.ceil((end - start + 1 - OVERLAP) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((start + i * step).cast("int").alias("start"), F.least(end, start + i * step + (WIDE - 1)).cast("int").alias("end")))


def blank(line: Column) -> Column:
    return ~line.rlike(r"\S")


def _chosen(definitions: DataFrame, kept: Kept) -> DataFrame:
    """Definitions that become chunks, with first, the line of their first member, if all around them are too large: (path, kind, name, parent, start, end, first)."""
    d = definitions.select("path", "kind", "name", "parent", c("start").cast("int").alias("start"), c("end").cast("int").alias("end")).distinct()
    d = kept.write(d, "definitions")
    first = d.filter("parent is not null").groupBy("path", c("parent").alias("name")).agg(F.min("start").alias("first"))
    d = kept.write(d.join(first, ["path", "name"], "left"), "first")
    large = (c("end") - c("start") + 1 > MOST) & c("first").isNotNull()
    level, out = d.filter("parent is null"), []
    for _ in range(LEVELS):
        out.append(level)
        around = level.filter(large).select("path", c("name").alias("parent"), c("kind").alias("of")).distinct()
        level = d.filter("parent is not null").join(around, ["path", "parent"])
        level = level.withColumn("kind", F.when((c("kind") == "function") & c("of").isin(*WITH_METHODS), "method").otherwise(c("kind"))).select(d.columns)
        level = kept.write(level, "level")
        if not level.limit(1).count():
            break
    return reduce(DataFrame.unionByName, out)


def code_chunks(files: DataFrame, definitions: DataFrame) -> DataFrame:
    """Chunks of files (path, lines: an array of texts): path, kind, name, parent, start, end, truncated (the head of a larger definition), content.

    Lines that no chunk of a definition covers are module chunks, in windows, if LEAST_GAP of them are left without the blank ones at either
    end; a file without definitions is module code whatever its length. Empty files have no chunks. Definitions of files that aren't there don't matter.
    A file's places are gathered first, and its lines are joined with them once and never broadcast."""
    kept = Kept(definitions.sparkSession, "chunks")
    d = _chosen(definitions, kept)
    size, has = c("end") - c("start") + 1, c("first").isNotNull()
    head = F.least(F.greatest(c("start"), c("first") - 1), c("start") + MOST - 1).cast("int")
    whole = F.array(F.struct("start", "end", F.lit(False).alias("truncated")))
    cut = F.transform(windows(c("start"), c("end")), lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), F.lit(False).alias("truncated")))
    parts = F.when(size <= MOST, whole).when(has, F.array(F.struct(c("start"), head.alias("end"), F.lit(True).alias("truncated")))).otherwise(cut)
    own = d.select("path", "kind", "name", "parent", F.when((size > MOST) & has, head).otherwise(c("end")).alias("to"), c("start").alias("from"), parts.alias("parts"))

    # gaps: after the greatest end so far, within a file, whose definitions are few; the last one, up to the file's end, follows with its lines
    w = Window.partitionBy("path").orderBy("from", "to").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("after", F.coalesce(F.max("to").over(w), F.lit(0)))
    gap = F.when(c("from") > c("after") + 1, F.struct((c("after") + 1).alias("a"), (c("from") - 1).alias("b")))
    chunk = F.transform("parts", lambda p: F.struct("kind", "name", "parent", p["start"].alias("start"), p["end"].alias("end"), p["truncated"].alias("truncated")))
    own = own.groupBy("path").agg(F.flatten(F.collect_list(chunk)).alias("own"), F.collect_list(gap).alias("gaps"), F.max("to").alias("last"))
    own = kept.write(own, "result")
    kept.drop(but="result")

    # a hint, as the size that Spark expects of an array doesn't depend on its length
    f = files.filter(F.size("lines") > 0).select("path", "lines").hint("merge").join(own, "path", "left")
    rest = F.struct((F.coalesce("last", F.lit(0)) + 1).alias("a"), F.size("lines").alias("b"))
    spans = F.filter(F.concat(F.coalesce("gaps", F.array().cast("array<struct<a:int,b:int>>")), F.array(rest)), lambda g: g["a"] <= F.least(g["b"], F.size("lines")))

    def trimmed(g):
        """The gap without blank lines at either end; nulls if all are blank."""
        text = F.transform(F.sequence(g["a"], F.least(g["b"], F.size("lines"))), lambda i: F.when(~blank(F.get("lines", i - 1)), i))
        return F.struct(F.array_min(text).alias("a"), F.array_max(text).alias("b"))

    worth = lambda g: (g["b"] - g["a"] + 1 >= LEAST_GAP) | (c("own").isNull() & g["a"].isNotNull())
    none = F.lit(None).cast("string")
    module = lambda p: F.struct(F.lit("module").alias("kind"), none.alias("name"), none.alias("parent"), p["start"].alias("start"), p["end"].alias("end"), F.lit(False).alias("truncated"))
    f = f.select("path", "lines", "own", F.transform(spans, trimmed).alias("gaps"))
    module = F.transform(F.flatten(F.transform(F.filter("gaps", worth), lambda g: windows(g["a"], g["b"]))), module)
    f = f.select("path", "lines", F.when(c("own").isNull(), module).otherwise(F.concat("own", module)).alias("chunks"))
    content = lambda p: F.array_join(F.slice("lines", p["start"], F.greatest(p["end"] - p["start"] + 1, F.lit(0))), "\n")
    every = f.select("path", F.explode(F.transform("chunks", lambda p: p.withField("content", content(p)))).alias("p")).select("path", "p.*")
    # windows of blank lines alone are left out, whole definitions never are
    return every.filter(~blank(c("content")))


def split_lines(text: Column) -> Column:
    """Lines of a text, without an empty one after the last end of line."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\r\n|[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", "\n"), r"\n\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(plain, "\n"))


def route(path: Column) -> Column:
    """How a file is cut: section (documents), code (a language whose definitions are known) or window."""
    doc = reduce(lambda a, b: a | b, [F.lower(path).endswith(e) for e in DOCUMENTS]) | F.coalesce(language(path) == "markdown", F.lit(False))
    return F.when(doc, "section").when(F.coalesce(language(path).isin(GRAMMARS), F.lit(False)), "code").otherwise("window")


def chunk_files(files: DataFrame, definitions: DataFrame, sections) -> DataFrame:
    """Chunks of files (path, content) of every kind: source_type, path, kind, name, start, end, content. sections(files) cuts documents into (path,
    name, start, end, content)."""
    f = files.select("path", "content", split_lines(c("content")).alias("lines"), route(c("path")).alias("how")).filter(F.size("lines") > 0)
    code = code_chunks(f.filter("how = 'code'").select("path", "lines"), definitions).select(F.lit("code").alias("source_type"), "path", "kind", "name", "start", "end", "content")
    rest = f.filter("how = 'window'").select("path", "lines", F.explode_outer(windows(F.lit(1), F.size("lines"))).alias("p"))
    cut = F.slice("lines", c("p.start"), c("p.end") - c("p.start") + 1)
    rest = rest.filter(F.exists(cut, lambda x: ~blank(x))).select(F.lit("code").alias("source_type"), "path", F.lit("window").alias("kind"), F.lit(None).cast("string").alias("name"), "p.start", "p.end", F.array_join(cut, "\n").alias("content"))
    docs = sections(f.filter("how = 'section'").select("path", "content")).select(F.lit("doc").alias("source_type"), "path", F.lit("section").alias("kind"), "name", "start", "end", "content")
    return code.unionByName(rest).unionByName(docs)


@query("c02_code_chunks", f"""WITH {cb.SYMBOLS_SQL}, {cb.FILES_SQL}, d AS (SELECT *, b - a + 1 > 120 AS large, (SELECT min(x.a) FROM symbols x WHERE x.path = s.path AND x.parent = s.name) AS first FROM symbols s),
top AS (SELECT * FROM d WHERE parent IS NULL UNION ALL SELECT d.* FROM d JOIN d p ON p.path = d.path AND p.name = d.parent WHERE p.large),
own AS (SELECT path, kind, name, a, CASE WHEN large AND first IS NOT NULL THEN least(greatest(a, first - 1), a + 119) ELSE b END AS z, large AND first IS NOT NULL AS truncated, large AND first IS NULL AS cut FROM top),
cover AS (SELECT DISTINCT path, unnest(range(a, z + 1)) AS line FROM own),
free AS (SELECT f.path, line FROM files f, (SELECT unnest(range(1, 241)) AS line) l WHERE (f.path, line) NOT IN (SELECT (path, line) FROM cover)),
runs AS (SELECT path, line, line - row_number() OVER (PARTITION BY path ORDER BY line) AS g FROM free),
gap AS (SELECT path, min(line) AS a, max(line) AS z FROM runs WHERE line % 11 <> 0 GROUP BY path, g HAVING max(line) - min(line) >= 2),
pieces AS (SELECT path, kind, name, a, z, truncated, cut FROM own UNION ALL SELECT path, 'module', NULL, a, z, false, true FROM gap),
wins AS (SELECT path, kind, name, CASE WHEN cut THEN a + 50 * i ELSE a END AS s, CASE WHEN cut THEN least(z, a + 50 * i + 59) ELSE z END AS e, truncated FROM (SELECT *, unnest(range(0, CASE WHEN cut THEN greatest(1, CAST(ceil((z - a + 1 - 10) / 50) AS INT)) ELSE 1 END)) AS i FROM pieces)),
kept AS (SELECT *, list_transform(range(s, e + 1), lambda x: CASE WHEN x % 11 = 0 THEN '' ELSE concat('line ', x) END) AS lines FROM wins)
SELECT path, kind, name, CAST(s AS INT) AS start, CAST(e AS INT) AS end_line, truncated, md5(array_to_string(lines, chr(10))) AS content FROM kept WHERE len(list_filter(lines, lambda x: x <> '')) > 0""")
def c02(t):
    """Files of 240 lines, each eleventh of them blank."""
    lines = F.transform(F.sequence(F.lit(1), F.lit(240)), lambda i: F.when(i % 11 == 0, "").otherwise(F.concat(F.lit("line "), i.cast("string"))))
    out = code_chunks(cb.files(t).select("path", lines.alias("lines")), cb.symbols(t))
    return out.select("path", "kind", "name", "start", c("end").alias("end_line"), "truncated", F.md5("content").alias("content"))
