"""Names of a code base: what a name means in a file, which class a class extends, which definition a call reaches.

A name passes a cascade of lookups; the surest that finds something counts, by a least-of aggregate that Spark begins before the shuffle.
Each lookup is one equi-join with an index that has few rows for a key: definitions by file and name, definitions that are the only ones
of their name, the first two methods of a name and class. Uses are made distinct by file, name and class first, and steps are stored, so plans
stay short. A name of the same package may mean many definitions, which grow with the code base, as its uses do: such an answer stays the name of
its folder through all steps, and the definitions come in with the last join, whose rows aren't stored.

Frames: symbols (path, language, name, kind, parent, start, end), a name being qualified ("Queue.put") and one row for each path and
name; bindings as in operators.modules.Bindings.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions.files import dirname
from sedimenta.operators.modules import Bindings
from sedimenta.plans import codebase as cb
from sedimenta.plans.registry import query
from sedimenta.plans.storage import Kept

c = F.col
# Kinds that a bare name may mean, kinds with members, words for one's own class, names too common to be told
# by name alone, languages whose files of a folder see each other.
TARGET_KINDS = "function method class struct interface trait type enum protocol".split()
CLASS_KINDS = "class struct interface trait protocol enum type impl".split()
SELF_WORDS = "self this cls $this @ Self me super".split()
GENERIC_NAMES = """get set put add pop push append extend insert remove delete update clear copy keys values items format join split strip
replace find index count sort reverse encode decode lower upper startswith endswith read write close open flush send recv
then catch finally map filter reduce forEach some every slice splice concat includes indexOf toString valueOf equals hashCode
log debug info warn warning error exception critical print next iter len str repr run start stop call apply bind
emit on off once has exists match test exec execute load dump dumps loads parse render init setup main wait sleep""".split()
SAME_PACKAGE = "go java kotlin csharp php swift".split()
#: Links that a passed-on name may take, unless the caller says otherwise; and levels and size of a class's ancestry.
HOPS, LEVELS, MOST_ANCESTORS = 3, 4, 12


def short(name: Column) -> Column:
    return F.regexp_replace(name, r"^.*(?:\.|::)", "")


def _plain(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def _first_two(rows: DataFrame, group: list[str]) -> DataFrame:
    """The first two keys of each group; the rank limit applies before the shuffle."""
    w = Window.partitionBy(*group).orderBy("key")
    return rows.withColumn("rn", F.row_number().over(w)).filter("rn <= 2").groupBy(*group).agg(F.sort_array(F.collect_list("key")).alias("keys"))


class Index:
    """A code base's definitions, arranged for lookups. Steps that use it are stored beside it until close()."""

    def __init__(self, symbols: DataFrame):
        self.kept = Kept(symbols.sparkSession, "names")
        own = [short(c("name")).alias("short"), short(c("parent")).alias("parent_short"), F.concat("path", F.lit("::"), "name").alias("key")]
        self.symbols = self.kept.write(symbols.select("path", "language", "name", "kind", "parent", "start", "end", *own), "symbols")
        s = self.symbols
        lone = s.filter(c("parent").isNull() & c("kind").isin(TARGET_KINDS)).groupBy("short").agg(F.count("*").alias("n"), F.min("key").alias("key"))
        self.unique = lone.filter((c("n") == 1) & (F.length("short") >= 4) & ~c("short").isin(GENERIC_NAMES)).select(c("short").alias("want"), F.array("key").alias("keys"))
        methods = s.filter("parent is not null")
        lone = methods.groupBy("short").agg(F.count("*").alias("n"), F.min("key").alias("key"))
        self.unique_method = lone.filter((c("n") == 1) & (F.length("short") >= 4) & ~c("short").isin(GENERIC_NAMES)).select(c("short").alias("want"), F.array("key").alias("keys"))
        typed = methods.withColumn("type", _plain(c("parent_short")))
        self.members = _first_two(methods, ["path", "parent_short", "short"]).select(c("path").alias("at"), "parent_short", c("short").alias("want"), "keys")
        self.members_anywhere = _first_two(methods, ["parent_short", "short"]).select("parent_short", c("short").alias("want"), "keys")
        self.typed = _first_two(typed, ["type", "short"]).select("type", c("short").alias("want"), "keys")

    @cached_property
    def defined(self) -> DataFrame:
        """The names that a file defines (at, want)."""
        return self.kept.write(self.symbols.select(c("path").alias("at"), c("short").alias("want")).distinct(), "defined")

    @cached_property
    def visible(self) -> DataFrame:
        """By file and last name: definitions at the top if there are any, else members."""
        top = self.symbols.groupBy("path", "short").agg(F.sort_array(F.collect_list(F.when(c("parent").isNull(), c("key")))).alias("tops"), F.sort_array(F.collect_list("key")).alias("all"))
        top = top.select(c("path").alias("at"), c("short").alias("want"), "tops", F.when(F.size("tops") > 0, c("tops")).otherwise(c("all")).alias("keys"))
        return self.kept.write(top, "visible")

    @cached_property
    def folders(self) -> DataFrame:
        """By folder and last name: definitions at the top of a file."""
        top = self.symbols.filter("parent is null").groupBy(dirname(c("path")).alias("folder"), c("short").alias("want"))
        return self.kept.write(top.agg(F.sort_array(F.collect_list("key")).alias("keys")), "folders")

    def folder_classes(self, most: int) -> DataFrame:
        """By folder and last name: the first classes at the top of a file, n being their place (folder, want, n, key, at)."""
        top = self.symbols.filter(c("parent").isNull() & c("kind").isin(CLASS_KINDS)).select(dirname(c("path")).alias("folder"), c("short").alias("want"), "key", c("path").alias("at"))
        w = Window.partitionBy("folder", "want").orderBy("key")
        return top.withColumn("n", F.row_number().over(w) - 1).filter(c("n") < most)

    def close(self, *results: DataFrame):
        """The result or results, stored; the steps go."""
        results = [self.kept.write(df, "result") for df in results]
        self.kept.drop(but="result")
        return results if len(results) > 1 else results[0]



def passed_on(bindings: Bindings, index: Index, hops: int | None = None) -> DataFrame:
    """Where the names that a file imports are defined: (at, want, file, name, hops), through files that only pass them on, by pointer
    jumping. Each round doubles the links that a pointer spans, so a chain of n links takes log n rounds.

    A name's alternatives are tried in order. One that leads to a name without a definition, or lies on a circle, is dropped, and
    the next one is tried. `hops` bounds the links of a chain; None follows all. A file's own definitions come before its imports.
    Names that a file gets by importing another whole aren't followed here (lookup() does).

    A pointer is stored again only when it has moved, and a round's steps go with the round."""
    kept, defined = Kept(index.symbols.sparkSession, "names"), index.defined
    order = F.struct(c("seq"), c("target"), c("orig"))
    links = bindings.names.select(c("path").alias("at"), c("local").alias("want"), order.alias("pick"))
    links = kept.write(links.join(defined, ["at", "want"], "left_anti").distinct(), "links")
    while True:
        to = F.struct(c("pick.target"), c("pick.orig"))
        first = links.groupBy("at", "want").agg(F.min("pick").alias("pick"), (F.min(to) != F.max(to)).alias("branch"))
        first = first.select("at", "want", c("pick.target").alias("file"), c("pick.orig").alias("name"), "branch")
        first = kept.write(first, "first")
        ends = defined.select(c("at").alias("file"), c("want").alias("name"), F.lit(True).alias("end"))
        heads = first.select(c("at").alias("file"), c("want").alias("name"), F.lit(True).alias("head"))
        state = F.when(c("end"), "done").when(c("head"), "open").otherwise("dead")
        at = first.join(ends, ["file", "name"], "left").join(heads, ["file", "name"], "left")
        at = kept.write(at.select("at", "want", "file", "name", F.lit(1).cast("long").alias("hops"), "branch", state.alias("state")), "pointers")
        settled, open_ = at.filter("state <> 'open'"), at.filter("state = 'open'")
        count = F.struct(F.count("*").alias("n"), F.countDistinct("file", "name").alias("ends"))
        before, now = None, open_.select(count.alias("x")).first().x
        # when neither pointers nor their ends get fewer, all that is open has come to a circle, and the ends are all of its names
        while now.n and now != before:
            on = settled.unionByName(open_).select(c("at").alias("file"), c("want").alias("name"), *[c(x).alias(f"{x}_") for x in ("file", "name", "hops", "branch", "state")])
            moved = open_.join(on, ["file", "name"])
            moved = moved.select("at", "want", c("file_").alias("file"), c("name_").alias("name"), (c("hops") + c("hops_")).alias("hops"), (c("branch") | c("branch_")).alias("branch"), c("state_").alias("state"))
            moved = kept.write(moved, "pointers")
            settled, open_ = settled.unionByName(moved.filter("state <> 'open'")), moved.filter("state = 'open'")
            before, now = now, open_.select(count.alias("x")).first().x
        # only pointers through a name with alternatives can be saved by another round
        if not settled.filter("state = 'dead'").unionByName(open_).filter("branch").limit(1).count():
            break
        circle = open_.select(c("file").alias("at"), c("name").alias("want")).distinct()
        dead = settled.filter("state = 'dead' and not branch").select(c("at").alias("file"), c("want").alias("name"))
        none = first.join(ends, ["file", "name"], "left_anti").join(heads, ["file", "name"], "left_anti").select("file", "name").distinct()
        lost = first.join(circle, ["at", "want"], "left_semi").unionByName(first.join(dead.unionByName(none), ["file", "name"], "left_semi").select(first.columns))
        lost = kept.write(lost.select("at", "want", "file", "name").distinct(), "lost")
        if not lost.limit(1).count():
            break
        left = links.join(lost, (links["at"] == lost["at"]) & (links["want"] == lost["want"]) & (links["pick.target"] == lost["file"]) & (links["pick.orig"] == lost["name"]), "left_anti")
        links = kept.write(left, f"links{kept.n}")
        kept.drop(but=f"links{kept.n - 1}")
    out = settled.filter("state = 'done'").select("at", "want", "file", "name", "hops")
    out = kept.write(out.filter(c("hops") <= hops) if hops is not None else out, "result")
    kept.drop(but="result")
    return out


def lookup(index: Index, bindings: Bindings, asks: DataFrame, hops: int = HOPS - 1) -> DataFrame:
    """(at, want, keys): what a name asked of a file means there. The file's definitions, at its top if there are any; else what the first
    of its imports of that name leads to, then of the files that it imports whole, through at most `hops` further files."""
    defined, level = index.visible.select("at", "want", "keys"), asks.select("at", "want").distinct()
    names = bindings.names.select(c("path").alias("at"), c("local").alias("want"), F.struct(F.lit(0).alias("w"), c("seq").cast("string").alias("s")).alias("pick"), c("target").alias("to"), c("orig").alias("ask"))
    whole = bindings.wildcards.select(c("path").alias("at"), c("target").alias("to"))
    levels, steps = [], []
    for _ in range(hops):
        levels.append(index.kept.write(level.join(defined, ["at", "want"], "left"), "asks"))
        open_ = levels[-1].filter("keys is null").select("at", "want")
        step = open_.join(names, ["at", "want"]).unionByName(open_.join(whole, "at").select("at", "want", F.struct(F.lit(1).alias("w"), c("to").alias("s")).alias("pick"), "to", c("want").alias("ask")))
        step = index.kept.write(step, "steps")
        steps.append(step)
        level = step.select(c("to").alias("at"), c("ask").alias("want")).distinct()
    found = level.join(defined, ["at", "want"])
    for level, step in zip(levels[::-1], steps[::-1], strict=True):
        best = step.join(found.select(c("at").alias("to"), c("want").alias("ask"), "keys"), ["to", "ask"]).groupBy("at", "want").agg(F.min_by("keys", F.struct("pick", "to", "ask")).alias("keys"))
        found = level.filter("keys is not null").unionByName(best)
    return index.kept.write(found, "looked")


class Ways:
    """What several lookups find for sites, told apart by the columns `key`; best() has what the first of them finds: keys, or a folder that has them."""

    def __init__(self, key: list[str]):
        self.key, self.found = key, []

    def add(self, hits: DataFrame, confidence: float, via: str) -> None:
        none = lambda name, kind: c(name) if name in hits.columns else F.lit(None).cast(kind).alias(name)
        answer = F.struct(none("keys", "array<string>"), none("folder", "string"), F.lit(confidence).alias("confidence"), F.lit(via).alias("via"))
        self.found.append(hits.select(*self.key, F.lit(len(self.found)).alias("way"), answer.alias("answer")))

    def best(self) -> DataFrame:
        every = reduce(DataFrame.unionByName, self.found)
        return every.groupBy(*self.key).agg(F.min_by("answer", "way").alias("a")).select(*self.key, "a.*")


def spread(rows: DataFrame, folders: DataFrame, want: str = "want") -> DataFrame:
    """Rows (want, keys, folder, ...) with the keys of their folder where they name one. Folders aren't broadcast, as they grow with the code base."""
    near = rows.filter("folder is not null").drop("keys").join(folders.withColumnRenamed("want", want).hint("merge"), ["folder", want])
    return rows.filter("folder is null").drop("folder").unionByName(near.drop("folder"))


def resolve_names(index: Index, bindings: Bindings, sites: DataFrame) -> DataFrame:
    """(path, want, parent, keys, confidence, via) of bare names used in a file: sites (path, language, want, parent), one row each, parent being the
    class around the use or null.

    In turn: what the file imports by that name; a member of the same class (not in Python); the file's own definition; what a file
    imported whole has; a definition of the same folder, in languages that see those; the only definition of that name anywhere."""
    return spread(meanings(index, bindings, sites), index.folders)


def meanings(index: Index, bindings: Bindings, sites: DataFrame) -> DataFrame:
    """resolve_names(), stored before definitions of the same folder come in: those rows have a folder and no keys."""
    key = ["path", "want", "parent"]
    ways, sites = Ways(key), index.kept.write(sites, "sites")
    named = bindings.names.select("path", c("local").alias("want"), "seq", "target", F.when(c("orig") == "default", c("local")).otherwise(c("orig")).alias("ask"))
    own = index.kept.write(sites.join(named, ["path", "want"]), "imported")
    whole = index.kept.write(sites.join(bindings.wildcards, "path").select(*key, "target"), "whole")
    looked = lookup(index, bindings, own.select(c("target").alias("at"), c("ask").alias("want")).unionByName(whole.select(c("target").alias("at"), "want")))
    hits = own.join(looked.select(c("at").alias("target"), c("want").alias("ask"), "keys"), ["target", "ask"])
    ways.add(hits.groupBy(*key).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("seq", "target", "keys"))), lambda x: x["keys"])).alias("keys")), 1.0, "import")
    local = index.symbols.filter("parent is not null").groupBy("path", c("short").alias("want"), "parent").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    ways.add(sites.filter("language <> 'python' and parent is not null").join(local, key), 0.95, "same class")
    ways.add(sites.join(index.visible.filter("size(tops) > 0").select(c("at").alias("path"), "want", c("tops").alias("keys")), ["path", "want"]), 0.95, "same file")
    ways.add(whole.join(looked.withColumnRenamed("at", "target"), ["target", "want"]).groupBy(*key).agg(F.min_by("keys", "target").alias("keys")), 0.85, "wildcard import")
    near = sites.filter(c("language").isin(SAME_PACKAGE)).withColumn("folder", dirname(c("path")))
    ways.add(near.join(index.folders.select("folder", "want"), ["folder", "want"], "left_semi"), 0.85, "same package")
    ways.add(sites.join(index.unique, "want"), 0.5, "unique name")
    return index.kept.write(ways.best(), "meant")


def enclosing(symbols: DataFrame, sites: DataFrame, line: str = "line", kinds: list[str] | None = None) -> DataFrame:
    """Sites (path, ...) with the key, name, kind and parent of the innermost definition around their line, or nulls."""
    s = symbols.filter(c("kind").isin(kinds)) if kinds else symbols
    lines = sites.select("path", line).distinct()
    inner = lines.join(s.select("path", "key", "name", "kind", "parent", "start", "end"), "path").filter(c(line).between(c("start"), c("end")))
    best = inner.groupBy("path", line).agg(F.min(F.struct((c("end") - c("start")).alias("span"), "key", "name", "kind", "parent")).alias("in"))
    return sites.join(best.select("path", line, c("in.key").alias("owner"), c("in.name").alias("owner_name"), c("in.kind").alias("owner_kind"), c("in.parent").alias("owner_parent")), ["path", line], "left")


def inheritance(index: Index, bindings: Bindings, bases: DataFrame) -> DataFrame:
    """(cls, base, line, confidence, via): of each base (path, class_line, name, line) the class around it and the first class that the name
    means there, not itself."""
    own = enclosing(index.symbols, bases, "class_line", CLASS_KINDS).filter("owner is not null")
    language = index.symbols.select("path", "language").distinct()
    sites = own.select("path", c("name").alias("want")).distinct().join(language, "path").withColumn("parent", F.lit(None).cast("string"))
    meant = meanings(index, bindings, sites)
    classes = index.symbols.filter(c("kind").isin(CLASS_KINDS)).select(c("key").alias("base"))
    told = meant.select("path", c("want").alias("name"), F.posexplode("keys").alias("at", "base"), "confidence", "via").join(classes, "base", "left_semi")
    # of a folder's classes two are enough, as one of them at most is the class itself
    near = meant.join(index.folder_classes(2), ["folder", "want"]).select(c("key").alias("base"), "path", c("want").alias("name"), c("n").alias("at"), "confidence", "via")
    hits = own.join(told.unionByName(near), ["path", "name"]).filter("base <> owner")
    best = hits.groupBy(c("owner").alias("cls"), "line", c("name").alias("named")).agg(F.min_by(F.struct("base", "confidence", "via"), "at").alias("b"))
    return index.kept.write(best.select("cls", "b.base", "line", "b.confidence", "b.via"), "inherits")


def ancestors(inherits: DataFrame, of: DataFrame, kept: Kept, levels: int = LEVELS, most: int = MOST_ANCESTORS) -> DataFrame:
    """(cls, base, level, place) of the classes in `of`: nearest first, in declared order, each base once, however many ways lead to it.
    No further level once `most` are found. Circles end where they come back."""
    direct = inherits.groupBy(c("cls").alias("from"), "base").agg(F.min("line").alias("line"))
    step = lambda line: F.array(F.struct(line.alias("line"), c("base").alias("base")))
    none = F.array().cast("array<struct<line:int,base:string>>")
    level = kept.write(of.select("cls", c("cls").alias("base"), F.lit(0).alias("level"), none.alias("place")), "level")
    seen = level
    for k in range(1, levels + 1):
        room = seen.filter("level > 0").groupBy("cls").count().filter(c("count") >= most).select("cls")
        on = level.join(room, "cls", "left_anti") if k > 1 else level
        nxt = on.select("cls", c("base").alias("from"), "place").join(direct, "from").select("cls", "base", F.lit(k).alias("level"), F.concat(c("place"), step(c("line").cast("int"))).alias("place"))
        level = nxt.join(seen.select("cls", "base"), ["cls", "base"], "left_anti").groupBy("cls", "base", "level").agg(F.min("place").alias("place"))
        level = kept.write(level, "level")
        seen = seen.unionByName(level)
    return seen.filter("level > 0")


def resolve_calls(index: Index, bindings: Bindings, calls: DataFrame, inherits: DataFrame) -> DataFrame:
    """(path, line, name, receiver, owner, target, confidence, via): what calls (path, line, name, receiver) reach; owner is the definition around
    the call, null at the top of a file. Calls of names that nothing here has, and of a definition by itself, are left out.

    A bare name goes through the ladder of resolve_names(). With a receiver: a member of one's own class, or of its nearest ancestor; what a module of that
    local name has; a member of a class of that name; of the class that the receiver is named after; the only method of that name."""
    return targets(reached(index, bindings, calls, inherits), index.folders)


def targets(rows: DataFrame, folders: DataFrame) -> DataFrame:
    """A row for each definition that reached() found, folders spread."""
    hit = spread(rows, folders, "name").select("path", "line", "name", "receiver", "owner", F.explode("keys").alias("target"), "confidence", "via")
    return hit.filter(c("owner").isNull() | (c("owner") != c("target")))


def reached(index: Index, bindings: Bindings, calls: DataFrame, inherits: DataFrame) -> DataFrame:
    """resolve_calls() before a call's definitions become rows: (path, line, name, receiver, owner, keys, folder, confidence, via), the definitions
    of a folder not listed."""
    language = index.symbols.select("path", "language").distinct()
    known = index.symbols.select(c("short").alias("name")).distinct()
    at = enclosing(index.symbols, calls.join(known, "name", "left_semi").distinct(), "line")
    at = at.withColumn("receiver", c("receiver").cast("string"))
    at = at.withColumn("cls", F.coalesce("owner_parent", F.when(c("owner_kind").isin(CLASS_KINDS), c("owner_name"))))
    at = index.kept.write(at, "calls")
    sites = at.select("path", c("name").alias("want"), "receiver", "cls", c("owner_parent").alias("parent")).distinct().join(language, "path", "left").withColumn("language", F.coalesce("language", F.lit("")))
    last = F.regexp_replace("receiver", r"^.*(?:\.|::|->)", "")
    sites = index.kept.write(sites.withColumn("last", last), "uses")
    key = ["path", "want", "receiver", "cls", "parent"]
    ways = Ways(key)

    own = sites.filter(c("receiver").isin(SELF_WORDS))
    alias = bindings.modules.select("path", c("local").alias("receiver"), "target").distinct()
    rest = sites.filter(c("receiver").isNotNull() & ~c("receiver").isin(SELF_WORDS))
    through = index.kept.write(rest.join(alias, ["path", "receiver"]), "through")
    rest = index.kept.write(rest.join(alias.select("path", "receiver").distinct(), ["path", "receiver"], "left_anti"), "rest")
    capital = rest.filter(F.substring("last", 1, 1).rlike(r"^\p{Lu}"))

    bare = sites.filter("receiver is null").select("path", "language", "want", "parent")
    meant = meanings(index, bindings, bare.unionByName(capital.select("path", "language", c("last").alias("want"), "parent")).distinct())
    answer = meant.select(c("path").alias("p"), c("want").alias("w"), c("parent").alias("o"), "keys", "folder", "confidence", "via")
    plain = sites.filter("receiver is null").join(answer, (c("path") == c("p")) & (c("want") == c("w")) & c("parent").eqNullSafe(c("o"))).select(*key, "keys", "folder", "confidence", "via")

    members = index.symbols.filter("parent is not null").groupBy("path", c("parent").alias("cls"), c("short").alias("want")).agg(F.sort_array(F.collect_list("key")).alias("keys"))
    ways.add(own.filter("receiver <> 'super'").join(members, ["path", "cls", "want"]), 1.0, "self")
    mine = own.withColumn("k", F.concat("path", F.lit("::"), "cls"))
    up = ancestors(inherits, mine.select(c("k").alias("cls")).filter("cls is not null").distinct(), index.kept)
    bases = index.symbols.select(c("key").alias("base"), c("path").alias("at"), c("name").alias("of"))
    up = up.join(bases, "base").select(c("cls").alias("k"), "level", "place", "at", "of")
    hits = mine.join(up, "k").join(members.select(c("path").alias("at"), c("cls").alias("of"), "want", "keys"), ["at", "of", "want"])
    ways.add(hits.groupBy(*key).agg(F.min_by("keys", F.struct("level", "place")).alias("keys")), 0.9, "inherited")

    looked = lookup(index, bindings, through.select(c("target").alias("at"), "want"))
    hits = through.join(looked.withColumnRenamed("at", "target"), ["target", "want"]).groupBy(*key).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("target", "keys"))), lambda x: x["keys"])).alias("keys"))
    ways.add(hits, 1.0, "module import")

    classes = index.symbols.filter(c("kind").isin(CLASS_KINDS)).select("key", c("path").alias("at"), c("short").alias("of"))
    told = answer.select("p", c("w").alias("l"), "o", F.posexplode("keys").alias("n", "key")).join(classes, "key")
    # of a folder's classes of one name the first decides: it has the method itself, or any class of that name has it
    near = answer.join(index.folder_classes(1).withColumnRenamed("want", "w"), ["folder", "w"]).select("p", c("w").alias("l"), "o", "n", "at", c("w").alias("of"))
    told = told.select("p", "l", "o", "n", "at", "of").unionByName(near)
    told = capital.join(told, (c("path") == c("p")) & (c("last") == c("l")) & c("parent").eqNullSafe(c("o"))).select(*key, "n", "at", "of")
    here = capital.join(classes.select(c("at").alias("path"), c("of").alias("last")).distinct(), ["path", "last"])
    both = index.kept.write(told.unionByName(here.select(*key, F.lit(1_000_000).alias("n"), c("path").alias("at"), c("last").alias("of"))), "classes")
    near = both.join(index.members.withColumnRenamed("parent_short", "of"), ["at", "of", "want"]).select(*key, "n", F.lit(0).alias("far"), "keys")
    far = both.join(index.members_anywhere.withColumnRenamed("parent_short", "of"), ["of", "want"]).select(*key, "n", F.lit(1).alias("far"), "keys")
    ways.add(near.unionByName(far).groupBy(*key).agg(F.min_by("keys", F.struct("n", "far", "keys")).alias("keys")), 0.9, "class member")
    ways.add(rest.withColumn("type", _plain(c("last"))).join(index.typed, ["type", "want"]), 0.7, "receiver name")
    ways.add(rest.join(index.unique_method, "want"), 0.4, "unique method name")

    meant = index.kept.write(plain.unionByName(ways.best()), "reached").select(*[c(x).alias(f"{x}_") for x in key], "keys", "folder", "confidence", "via")
    same = (c("path") == c("path_")) & (c("name") == c("want_")) & c("receiver").eqNullSafe(c("receiver_")) & c("cls").eqNullSafe(c("cls_")) & c("owner_parent").eqNullSafe(c("parent_"))
    return at.join(meant, same).select("path", "line", "name", "receiver", "owner", "keys", "folder", "confidence", "via")


def _lookup_sql(p: str, asks: str) -> str:
    """lookup() of the CTE `asks` (spot, want) as CTE `p`, two further files deep."""

    def step(name: str, level: str) -> str:
        open_ = f"(SELECT spot, want FROM {level} l WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.path = l.spot AND v.short = l.want))"
        return f"""{name} AS (SELECT spot, want, 0 AS w, CAST(seq AS STRING) AS sq, target AS nxt, orig AS ask FROM {open_} JOIN links ON links.path = spot AND local = want
UNION ALL SELECT spot, want, 1, target, target, want FROM {open_} JOIN wildcards ON wildcards.path = spot)"""

    def found(name: str, level: str, children: str = "", below: str = "") -> str:
        own = f"SELECT spot, want, keys FROM {level} JOIN v ON v.path = spot AND v.short = want"
        if not children:
            return f"{name} AS ({own})"
        return f"{name} AS ({own} UNION ALL SELECT x.spot, x.want, arg_min(r.keys, struct_pack(a := w, b := sq, c := nxt, d := ask)) FROM {children} x JOIN {below} r ON r.spot = nxt AND r.want = ask GROUP BY x.spot, x.want)"

    level = lambda name, children: f"{name} AS (SELECT DISTINCT nxt AS spot, ask AS want FROM {children})"
    return ",\n".join([f"{p}0 AS (SELECT DISTINCT spot, want FROM {asks})", step(f"{p}s0", f"{p}0"), level(f"{p}1", f"{p}s0"), step(f"{p}s1", f"{p}1"), level(f"{p}2", f"{p}s1"), found(f"{p}f2", f"{p}2"), found(f"{p}f1", f"{p}1", f"{p}s1", f"{p}f2"), found(p, f"{p}0", f"{p}s0", f"{p}f1")])


_DEFINED_SQL = f"""{cb.SYMBOLS_SQL}, {cb.SCOPE_SQL},
s AS (SELECT *, concat(path, '::', name) AS key, regexp_replace(parent, '^.*[.]', '') AS parent_short FROM symbols),
v AS (SELECT path, short, coalesce(list(key ORDER BY key) FILTER (WHERE parent IS NULL), list(key ORDER BY key)) AS keys, list(key ORDER BY key) FILTER (WHERE parent IS NULL) AS tops FROM s GROUP BY path, short)"""
#: All uses of names, tried in all ways at once; the least way that finds something counts.
_NAMES_SQL = f"""{cb.CALLS_SQL}, {cb.BASES_SQL},
known AS (SELECT DISTINCT path, line, name, receiver FROM calls WHERE name IN (SELECT short FROM s)),
o AS (SELECT path, line, key AS owner, name AS owner_name, kind AS owner_kind, parent AS owner_parent FROM (SELECT DISTINCT path, line FROM known) k JOIN s USING (path) WHERE line BETWEEN a AND b QUALIFY row_number() OVER (PARTITION BY path, line ORDER BY b - a, key) = 1),
at_ AS (SELECT known.*, owner, owner_parent, coalesce(owner_parent, CASE WHEN owner_kind = 'class' THEN owner_name END) AS cls, regexp_replace(receiver, '^.*[.]', '') AS last FROM known LEFT JOIN o USING (path, line)),
uses AS (SELECT path, name AS want, owner_parent AS parent FROM at_ WHERE receiver IS NULL UNION SELECT path, last, owner_parent FROM at_ WHERE regexp_matches(last, '^[A-Z]') UNION SELECT path, name, NULL FROM bases),
sites AS (SELECT uses.*, language FROM uses JOIN (SELECT DISTINCT path, language FROM symbols) USING (path)),
asks AS (SELECT target AS spot, orig AS want FROM links UNION SELECT target, want FROM sites JOIN wildcards USING (path) UNION SELECT target, name FROM at_ JOIN modules ON modules.path = at_.path AND local = receiver),
{_lookup_sql('looked', 'asks')},
folders AS (SELECT regexp_replace(path, '/[^/]*$', '') AS folder, short, list(key ORDER BY key) AS keys FROM s WHERE parent IS NULL GROUP BY 1, 2),
alone AS (SELECT short, min(key) AS key FROM s WHERE parent IS NULL AND kind IN ('function', 'class') GROUP BY short HAVING count(*) = 1 AND len(short) >= 4),
ways AS (
SELECT sites.path, sites.want, parent, 1 AS way, keys, 1.0 AS confidence, 'import' AS via FROM sites JOIN links ON links.path = sites.path AND local = sites.want JOIN looked ON spot = target AND looked.want = orig
UNION ALL SELECT path, want, parent, 2, list(key ORDER BY key), 0.95, 'same class' FROM sites JOIN s USING (path, parent) WHERE s.short = want AND sites.language <> 'python' GROUP BY path, want, parent
UNION ALL SELECT sites.path, want, parent, 3, tops, 0.95, 'same file' FROM sites JOIN v ON v.path = sites.path AND short = want WHERE tops IS NOT NULL
UNION ALL SELECT sites.path, sites.want, parent, 4, arg_min(keys, target), 0.85, 'wildcard import' FROM sites JOIN wildcards USING (path) JOIN looked ON spot = target AND looked.want = sites.want GROUP BY sites.path, sites.want, parent
UNION ALL SELECT path, want, parent, 5, keys, 0.85, 'same package' FROM sites JOIN folders ON folder = regexp_replace(path, '/[^/]*$', '') AND short = want WHERE language IN ('go', 'java')
UNION ALL SELECT path, want, parent, 6, [key], 0.5, 'unique name' FROM sites JOIN alone ON short = want),
named AS (SELECT * FROM ways QUALIFY row_number() OVER (PARTITION BY path, want, parent ORDER BY way) = 1),
inherits AS (SELECT own.key AS cls, arg_min(base.key, i) AS base, line, any_value(confidence) AS confidence, any_value(via) AS via
             FROM bases JOIN s own ON own.path = bases.path AND own.kind = 'class' AND class_line BETWEEN own.a AND own.b JOIN (SELECT *, unnest(keys) AS base_key, generate_subscripts(keys, 1) AS i FROM named WHERE parent IS NULL) n ON n.path = bases.path AND n.want = bases.name
             JOIN s base ON base.key = base_key AND base.kind = 'class' AND base.key <> own.key GROUP BY own.key, line, bases.name)"""
_CALLS_SQL = """up(cls, base, level, seen) AS (SELECT cls, base, 1, [cls, base] FROM inherits UNION ALL SELECT up.cls, inherits.base, level + 1, list_append(seen, inherits.base) FROM up JOIN inherits ON inherits.cls = up.base WHERE level < 4 AND NOT list_contains(seen, inherits.base)),
m AS (SELECT path, parent, short, list(key ORDER BY key) AS keys FROM s WHERE parent IS NOT NULL GROUP BY path, parent, short),
ms AS (SELECT path, parent_short, short, list_slice(list(key ORDER BY key), 1, 2) AS keys FROM s WHERE parent IS NOT NULL GROUP BY path, parent_short, short),
ma AS (SELECT parent_short, short, list_slice(list(key ORDER BY key), 1, 2) AS keys FROM s WHERE parent IS NOT NULL GROUP BY parent_short, short),
mt AS (SELECT regexp_replace(lower(parent_short), '[^a-z0-9]', '', 'g') AS type, short, list_slice(list(key ORDER BY key), 1, 2) AS keys FROM s WHERE parent IS NOT NULL GROUP BY 1, 2),
mu AS (SELECT short, min(key) AS key FROM s WHERE parent IS NOT NULL GROUP BY short HAVING count(*) = 1 AND len(short) >= 4),
c AS (SELECT *, row_number() OVER () AS r, receiver IN ('self', 'super') AS own FROM at_),
classes AS (SELECT r, c.path, c.name, s.path AS spot, s.short AS cls_short, i FROM c JOIN (SELECT *, unnest(keys) AS k, generate_subscripts(keys, 1) AS i FROM named) n ON n.path = c.path AND n.want = c.last AND n.parent IS NOT DISTINCT FROM c.owner_parent JOIN s ON s.key = k AND s.kind = 'class' WHERE receiver IS NOT NULL AND NOT own AND regexp_matches(last, '^[A-Z]')
            UNION ALL SELECT DISTINCT r, c.path, c.name, s.path, s.short, 1000000 FROM c JOIN s ON s.path = c.path AND s.short = c.last AND s.kind = 'class' WHERE receiver IS NOT NULL AND NOT own),
reach AS (
SELECT r, 1 AS way, 0 AS spot, keys, confidence, via FROM c JOIN named ON named.path = c.path AND want = name AND parent IS NOT DISTINCT FROM owner_parent WHERE receiver IS NULL
UNION ALL SELECT r, 2, 0, keys, 1.0, 'self' FROM c JOIN m ON m.path = c.path AND parent = cls AND short = name WHERE receiver = 'self'
UNION ALL SELECT r, 3, level, keys, 0.9, 'inherited' FROM c JOIN up ON up.cls = concat(c.path, '::', c.cls) JOIN s b ON b.key = up.base JOIN m ON m.path = b.path AND m.parent = b.name AND m.short = c.name WHERE own
UNION ALL SELECT r, 4, 0, flatten(list(keys ORDER BY target)), 1.0, 'module import' FROM c JOIN modules ON modules.path = c.path AND local = receiver LEFT JOIN looked ON looked.spot = target AND looked.want = name GROUP BY r
UNION ALL SELECT r, 5, i * 2, keys, 0.9, 'class member' FROM classes JOIN ms ON ms.path = spot AND parent_short = cls_short AND short = name
UNION ALL SELECT r, 5, i * 2 + 1, keys, 0.9, 'class member' FROM classes JOIN ma ON parent_short = cls_short AND short = name
UNION ALL SELECT r, 6, 0, keys, 0.7, 'receiver name' FROM c JOIN mt ON type = regexp_replace(lower(last), '[^a-z0-9]', '', 'g') AND short = name WHERE receiver IS NOT NULL AND NOT own
UNION ALL SELECT r, 7, 0, [key], 0.4, 'unique method name' FROM c JOIN mu ON short = name WHERE receiver IS NOT NULL AND NOT own),
best AS (SELECT * FROM reach QUALIFY row_number() OVER (PARTITION BY r ORDER BY way, spot, keys) = 1)"""


def _scope(t):
    return Index(cb.symbols(t)), Bindings(*cb.bindings(t))


@query("g21_passed_on_names", f"""WITH RECURSIVE {_DEFINED_SQL},
walk(path, want, file, name, hops) AS (SELECT path, local, target, orig, 1 FROM links l WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.path = l.path AND v.short = l.local)
UNION ALL SELECT walk.path, want, target, orig, hops + 1 FROM walk JOIN links ON links.path = file AND local = name WHERE hops < 60 AND NOT EXISTS (SELECT 1 FROM v WHERE v.path = file AND v.short = name))
SELECT walk.path, want, file, name, CAST(hops AS BIGINT) AS hops FROM walk JOIN v ON v.path = file AND v.short = name""")
def g21(t):
    index, bindings = _scope(t)
    return index.close(passed_on(bindings, index).withColumnRenamed("at", "path"))


@query("g22_name_resolution", f"""WITH {_DEFINED_SQL}, {_NAMES_SQL} SELECT named.path, named.want, named.parent, array_to_string(keys, ' ') AS keys, CAST(confidence AS DOUBLE) AS confidence, via
FROM (SELECT DISTINCT path, name AS want, owner_parent AS parent FROM at_ WHERE receiver IS NULL) u JOIN named ON named.path = u.path AND named.want = u.want AND named.parent IS NOT DISTINCT FROM u.parent""")
def g22(t):
    """Bare names that are called, by file and the class around the call."""
    index, bindings = _scope(t)
    known = cb.calls(t).filter("receiver is null").distinct().join(index.symbols.select(c("short").alias("name")).distinct(), "name", "left_semi")
    at = enclosing(index.symbols, known)
    sites = at.select("path", c("name").alias("want"), c("owner_parent").alias("parent")).distinct().join(index.symbols.select("path", "language").distinct(), "path")
    # a folder's definitions are one text before they come in, so that a row takes a copy
    text = F.array_join("keys", " ").alias("keys")
    found, folders = index.close(meanings(index, bindings, sites).withColumn("keys", text), index.folders.select("folder", "want", text))
    return spread(found, folders)


@query("c15_inheritance", f"WITH {_DEFINED_SQL}, {_NAMES_SQL} SELECT cls, base, line, CAST(confidence AS DOUBLE) AS confidence, via FROM inherits")
def c15(t):
    index, bindings = _scope(t)
    return index.close(inheritance(index, bindings, cb.bases(t)))


@query("c16_call_resolution", f"""WITH RECURSIVE {_DEFINED_SQL}, {_NAMES_SQL}, {_CALLS_SQL}
SELECT * FROM (SELECT path, line, name, receiver, owner, unnest(keys) AS target, CAST(confidence AS DOUBLE) AS confidence, via FROM c JOIN best USING (r)) WHERE owner IS NULL OR owner <> target""")
def c16(t):
    index, bindings = _scope(t)
    bindings = Bindings(*(index.kept.write(df, tag) for df, tag in zip(bindings, Bindings._fields, strict=True)))  # eight steps read them
    return targets(*index.close(reached(index, bindings, cb.calls(t), inheritance(index, bindings, cb.bases(t))), index.folders))
