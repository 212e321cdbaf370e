"""What an import points at: files of the repository by each language's rules, or a package outside.

An import turns into a ranked list of paths that it might mean; all imports are then joined once with the paths that exist, whole ones
and, for languages that search roots, the best path of each ending. The least rank that exists wins. No import is compared
with more than one row for each of its candidates, however many files share a name.

Frames: files (path, language); imports (imp, path, language, line, module, names, aliases, alias, level), where imp is the caller's
key of an import, names an array, aliases a map from local to original names; go_modules (dir, module).
"""

from __future__ import annotations

import sys
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.functions.files import basename, dirname, normal_path
from sedimenta.functions.text import import_key
from sedimenta.plans import codebase as cb
from sedimenta.plans.registry import query
from sedimenta.plans.storage import Kept

c = F.col
PY_STDLIB = sorted(sys.stdlib_module_names)
# Endings in the order in which they are tried, and modules that come with a runtime.
JS_ENDINGS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts", ".d.ts")
NODE_BUILTINS = """fs path os http https url crypto util events stream child_process zlib net assert buffer readline
worker_threads process querystring timers tty dns cluster perf_hooks""".split()
ECOSYSTEMS = {"python": "pypi", "javascript": "npm", "typescript": "npm", "tsx": "npm", "go": "go", "rust": "cargo", "ruby": "rubygems"}
JS = ("javascript", "typescript", "tsx")


class Resolved(NamedTuple):
    """single (imp, ord, file), imports that mean single files; folders (imp, folder), Go imports, which mean all of sources (folder, file) there;
    submodules (imp, name, file), externals (imp, package). single, folders and externals may carry further columns of the imports."""

    single: DataFrame
    folders: DataFrame
    sources: DataFrame
    submodules: DataFrame
    externals: DataFrame

    @property
    def targets(self) -> DataFrame:
        """(imp, ord, file). A Go import has a row for each file of its folder, so their number grows with the product of both."""
        return self.single.select("imp", "ord", "file").unionByName(self.folders.join(self.sources, "folder").select("imp", F.lit(0).alias("ord"), "file"))


def go_modules(manifests: DataFrame) -> DataFrame:
    """(dir, module) of manifests (path, content) named go.mod."""
    found = F.regexp_extract(c("content"), r"(?m)^\s*module\s+(\S+)", 1)
    return manifests.filter(basename(c("path")) == "go.mod").select(dirname(c("path")).alias("dir"), found.alias("module")).filter("module <> ''")


def _ask(mode: str, key: Column) -> Column:
    return F.struct(F.lit(mode).alias("mode"), key.alias("key"))


def _join(base: Column, rest: Column) -> Column:
    return normal_path(F.when(base == "", rest).otherwise(F.concat(base, F.lit("/"), rest)))


def _climb(folder: Column, times: Column) -> Column:
    parts = F.filter(F.split(folder, "/"), lambda s: s != "")
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - times, F.lit(0))), "/")


def _js_paths(target: Column) -> Column:
    """The path itself, its stem with each ending, and the index of a folder; the endings' order is in the keys of the files."""
    return F.array(_ask("path", target), _ask("stem", F.regexp_replace(target, r"\.(m|c)?js$", "")), _ask("index", target))


def python_folder(path: Column | None = None) -> Column:
    """Folder or module path that a relative Python import names."""
    base = _climb(dirname(c("path") if path is None else path), c("level") - 1)
    rel = F.replace(c("module"), F.lit("."), F.lit("/"))
    return F.when(rel == "", base).when(base == "", rel).otherwise(F.concat(base, F.lit("/"), rel))


def _python(target: Column) -> Column:
    return F.array(_ask("path", F.concat(target, F.lit(".py"))), _ask("path", F.concat(target, F.lit("/__init__.py"))))


def _javascript() -> Column:
    spec = F.substring_index(c("module"), "?", 1)
    up = F.filter(F.split(dirname(c("path")), "/"), lambda s: s != "")
    folders = F.transform(F.sequence(F.size(up), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(up, F.lit(1), n), "/"))
    rest = F.substring(spec, 3, 100_000)
    below = lambda d, p: F.when(d == "", p).otherwise(F.concat(d, F.lit("/"), p))
    roots = F.transform(F.flatten(F.transform(folders, lambda d: F.array(below(d, F.concat(F.lit("src/"), rest)), below(d, rest)))), normal_path)
    return F.flatten(F.transform(F.when(spec.startswith("."), F.array(c("near"))).when(spec.startswith("@/") | spec.startswith("~/"), roots), _js_paths))


def _dotted(endings: tuple[str, ...]) -> Column:
    """The whole name as a path, then without its member; leading segments may be missing, two stay at least."""
    parts = F.split(c("module"), r"\.")
    n = F.size(parts)
    ends = F.array(*[F.lit(e) for e in endings])

    def cut(k: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), k - 1))
        rel = F.transform(starts, lambda s: F.array_join(F.slice(parts, s, k - s + 1), "/"))
        return F.flatten(F.transform(rel, lambda r: F.transform(ends, lambda e: _ask("ending", F.concat(r, e)))))

    return F.when(F.element_at(parts, -1) == "*", F.lit(None)).when(n < 2, cut(n)).otherwise(F.concat(cut(n), cut(n - 1)))


def _rust() -> Column:
    segs = F.filter(F.split(c("module"), "::"), lambda s: s != "")
    head = F.try_element_at(segs, F.lit(1))
    folder = dirname(c("path"))
    root = F.when(F.contains(c("path"), F.lit("/src/")), F.concat(F.substring_index(c("path"), "/src/", 1), F.lit("/src"))).otherwise("src")
    base = F.when(head == "crate", root).when(head == "super", dirname(folder)).otherwise(folder)
    rest = F.slice(segs, F.lit(2), F.greatest(F.size(segs) - 1, F.lit(0)))
    sizes = F.when(F.size(rest) > 0, F.sequence(F.size(rest), F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    rel = F.transform(sizes, lambda n: F.concat_ws("/", F.nullif(base, F.lit("")), F.array_join(F.slice(rest, F.lit(1), n), "/")))
    paths = F.flatten(F.transform(rel, lambda r: F.array(F.concat(r, F.lit(".rs")), F.concat(r, F.lit("/mod.rs")))))
    return F.when(head.isin("crate", "self", "super"), F.transform(paths, lambda p: _ask("path", p)))


def _ruby() -> Column:
    rb = lambda p: F.when(p.endswith(".rb"), p).otherwise(F.concat(p, F.lit(".rb")))
    return F.when(c("module").startswith("."), F.array(_ask("path", rb(c("near"))))).otherwise(F.array(_ask("path", rb(c("module"))), _ask("ending", F.concat(F.lit("lib/"), rb(c("module"))))))


def _c() -> Column:
    return F.when(c("level") >= 0, F.array(_ask("path", c("near")), _ask("ending", c("module"))))


def candidates() -> Column:
    """Ranked (mode, key) of an import: whole paths, endings of paths, or Python modules under a source root. near is the path that the
    module names from the importing file's folder, folder what a relative Python import names."""
    lang = c("language")
    python = F.when(c("level") > 0, _python(c("folder"))).otherwise(F.array(_ask("python", c("module"))))
    out = F.when(lang == "python", python).when(lang.isin(*JS), _javascript()).when(lang.isin("java", "kotlin"), _dotted((".java", ".kt"))).when(lang == "php", _dotted((".php",)))
    return out.when(lang == "rust", _rust()).when(lang == "ruby", _ruby()).when(lang.isin("c", "cpp"), _c())


def external() -> Column:
    """The package that an import without a file here names; null if there is none."""
    lang, m = c("language"), c("module")
    spec = F.substring_index(m, "?", 1)
    first = F.when(spec.startswith("@"), F.substring_index(spec, "/", 2)).otherwise(F.substring_index(spec, "/", 1))
    js = F.when(spec.startswith("node:"), F.substring_index(F.substring(spec, 6, 100_000), "/", 1)).when(~(spec.startswith(".") | spec.startswith("@/") | spec.startswith("~/")), first)
    head = F.try_element_at(F.filter(F.split(m, "::"), lambda s: s != ""), F.lit(1))
    out = F.when((lang == "python") & (c("level") <= 0), F.substring_index(m, ".", 1)).when(lang.isin(*JS), js).when(lang == "go", m)
    out = out.when(lang.isin("java", "kotlin", "php") & ~m.endswith("*"), F.substring_index(m, ".", 2))
    return out.when((lang == "rust") & ~head.isin("crate", "self", "super", "std", "core", "alloc"), head).when((lang == "ruby") & ~m.startswith("."), F.substring_index(m, "/", 1))


def _shortest(file: str = "file") -> Column:
    return F.min(F.struct(F.length(file).alias("n"), c(file).alias("file")))["file"].alias("file")


def path_keys(files: DataFrame) -> DataFrame:
    """(mode, key, file, root, rank): all that an import may call a file: its path, an ending of it, its path without the JavaScript ending of that
    rank, a Python module under a root (the folder before it, else null; a name of the standard library counts only at the top, in src or in lib)."""
    none = F.lit(None).cast("string").alias("root")
    whole = files.select(F.lit("path").alias("mode"), c("path").alias("key"), c("path").alias("file"), none)
    segs = F.split("path", "/")
    ends = files.select(F.lit("ending").alias("mode"), F.explode(F.transform(F.sequence(F.lit(1), F.size(segs)), lambda i: F.array_join(F.slice(segs, i, F.size(segs)), "/"))).alias("key"), c("path").alias("file"), none)
    parts = F.split(F.regexp_replace("path", r"(/__init__)?\.py$", ""), "/")
    py = files.filter("path like '%.py' and path <> '__init__.py'").select("path", parts.alias("parts"))
    py = py.select("path", "parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("i"))
    py = py.select(F.lit("python").alias("mode"), F.array_join(F.slice("parts", c("i"), F.size("parts")), ".").alias("key"), c("path").alias("file"), F.array_join(F.slice("parts", F.lit(1), c("i") - 1), "/").alias("root"), F.element_at("parts", c("i")).alias("top"))
    cut = lambda mode, k, end: F.when(c("path").endswith(end), F.struct(F.lit(mode).alias("mode"), F.expr(f"left(path, length(path) - {len(end)})").alias("key"), F.lit(k).alias("rank")))
    js = F.filter(F.array(*[cut(m, k, f"{tail}{e}") for m, tail in (("stem", ""), ("index", "/index")) for k, e in enumerate(JS_ENDINGS)]), lambda x: x.isNotNull())
    js = files.select(c("path").alias("file"), none, F.explode(js).alias("x")).select("x.mode", "x.key", "file", "root", "x.rank")
    keys = whole.unionByName(ends).unionByName(py.filter(~c("top").isin(PY_STDLIB) | c("root").isin("", "src", "lib")).drop("top"))
    return keys.withColumn("rank", F.lit(0)).unionByName(js)


def path_index(files: DataFrame) -> DataFrame:
    """(mode, key, rank, file): the shortest path that each key may mean; a Python root that is a package itself doesn't count."""
    packages = files.filter("path like '%/__init__.py'").select(F.regexp_replace("path", r"/__init__\.py$", "").alias("root"))
    return path_keys(files).join(packages, "root", "left_anti").groupBy("mode", "key", "rank").agg(_shortest())


def asked_paths(imports: DataFrame, keep: tuple[str, ...] = ("imp", "path", "names")) -> DataFrame:
    """(*keep, every, ord, mode, key): ranked keys of imports; `every` if all that exist are meant."""
    # the outer form, as Spark would otherwise work the candidates out twice more to drop imports without any
    near = imports.withColumn("near", _join(dirname(c("path")), F.substring_index("module", "?", 1))).withColumn("folder", python_folder())
    return near.select(*keep, ((c("language") == "python") & (c("level") > 0)).alias("every"), F.posexplode_outer(candidates()).alias("ord", "ask")).select(*keep, "every", "ord", "ask.*")


def _place() -> Column:
    """A path that stands for all files whose imports of one text mean the same: those of a folder, or all."""
    alone = c("language").isin("java", "kotlin", "php") | ((c("language") == "python") & ~F.coalesce(c("level") > 0, F.lit(False)))
    return F.when(alone, "_").otherwise(F.concat_ws("/", F.nullif(dirname(c("path")), F.lit("")), F.lit("_")))


def resolve_modules(files: DataFrame, imports: DataFrame, modules: DataFrame, kept: Kept | None = None, carry: tuple[str, ...] = ()) -> Resolved:
    """Files that each import means (ord counts them), names that are themselves modules, and packages outside.

    A relative Python import may mean a module and a package of one name, a Go import all files of a folder that aren't tests;
    others mean one file. Imports that mean nothing here and name no package have no rows. What a text means in a folder is looked up once,
    however often it is imported there, and Go imports, whose meanings are few, are joined without a shuffle of their own. With `kept`, steps
    are written, and what the result reads has the tag "result": imports are written once, and what they mean is read from there. Columns
    named in `carry` come along, so that they needn't be joined again."""
    step = (lambda df, tag: df) if kept is None else kept.write
    index = step(path_index(files), "index")
    own = ["place", "language", "module", "deep"]
    text = F.unhex(F.md5(F.concat("language", F.lit("\0"), "module", F.lit("\0"), "place", F.lit("\0"), c("deep").cast("string")))).alias("text")
    # coalesce() merges nothing here: it ends a function that with the imports' own expressions would be too long for the JVM to compile
    cut = lambda df: df.coalesce(1 << 20)
    asks = cut(imports.select(*dict.fromkeys(["imp", "path", "language", "module", "names", "level", *carry])).filter("not language <=> 'go'"))
    asks = cut(asks.withColumn("place", _place()).withColumn("deep", F.coalesce("level", F.lit(-1))))
    texts = asks.select(*own).distinct().select(text, "language", "module", c("place").alias("path"), c("deep").alias("level"))
    hits = asked_paths(texts, ("text",)).filter("mode is not null").join(index, ["mode", "key"])
    found = hits.groupBy("text").agg(F.first("every").alias("every"), F.sort_array(F.collect_list(F.struct("ord", "rank", "file"))).alias("hits"))
    every = F.transform("hits", lambda h: F.struct(h["ord"].alias("ord"), h["file"].alias("file")))
    found = found.select("text", F.when(c("every"), every).otherwise(F.array(F.struct(F.lit(0).alias("ord"), c("hits")[0]["file"].alias("file")))).alias("found"))
    # what is asked of an import later on, in place of the columns that it is told from
    inner = F.when((c("language") == "python") & (F.size("names") > 0) & c("level").isNotNull(), c("names")).alias("inner")
    folder = F.when(c("inner").isNotNull() & (c("level") > 0), python_folder(c("place"))).alias("folder")
    asks = asks.withColumn("inner", inner).select("imp", *carry, text, "inner", folder, external().alias("package"))
    asks = step(asks.join(found, "text", "left").drop("text"), "result")
    single = asks.select("imp", *carry, F.inline("found"))

    up = F.split("module", "/")
    gone = cut(imports.select(*dict.fromkeys(["imp", "path", "language", "module", "level", *carry])).filter("language = 'go'"))
    go = gone.select("module").distinct()
    go = go.select("module", F.explode(F.transform(F.sequence(F.lit(1), F.size(up)), lambda n: F.array_join(F.slice(up, F.lit(1), n), "/"))).alias("prefix"))
    go = go.join(modules.select(c("module").alias("prefix"), "dir"), "prefix")
    go = go.groupBy("module").agg(F.max(F.struct(F.length("prefix").alias("n"), "prefix", "dir")).alias("m"))
    folder = F.concat_ws("/", F.nullif(c("m.dir"), F.lit("")), F.nullif(F.expr("substring(module, length(m.prefix) + 2)"), F.lit("")))
    go = step(go.select("module", folder.alias("folder")), "result")
    folders = gone.join(go, "module").select("imp", *carry, "folder")
    sources = files.filter("path like '%.go' and path not like '%\\_test.go'").select(dirname(c("path")).alias("folder"), c("path").alias("file"))

    relative = asks.filter("inner is not null and folder is not null").select("imp", "inner", "folder")
    package = asks.filter("inner is not null and folder is null and found[0].file like '%/__init__.py'")
    package = package.select("imp", "inner", F.regexp_replace(c("found")[0]["file"], r"/__init__\.py$", "").alias("folder"))
    named = relative.unionByName(package).select("imp", "folder", F.explode("inner").alias("name"))
    named = named.select("imp", "name", F.posexplode(_python(_join(c("folder"), c("name")))).alias("ord", "ask")).select("imp", "name", "ord", "ask.*")
    subs = step(named.join(index, ["mode", "key"]).groupBy("imp", "name").agg(F.min_by("file", "ord").alias("file")), "result")
    # a relative import of modules alone means those
    bare = asks.filter("folder is not null and found is null").select("imp", *carry)
    alone = bare.join(subs.select("imp", F.lit(0).alias("ord"), "file").distinct(), "imp")
    outside = asks.filter("found is null and package is not null").select("imp", *carry, "package")
    outside = outside.unionByName(gone.join(go, "module", "left_anti").withColumn("package", external()).filter("package is not null").select("imp", *carry, "package"))
    return Resolved(single.unionByName(alone), folders, step(sources, "result"), subs, outside)


class Bindings(NamedTuple):
    """What imports bring into a file's scope: names (path, local, seq, target, orig), modules (path, local, target), wildcards
    (path, target). seq is the order of the alternatives of a local name."""

    names: DataFrame
    modules: DataFrame
    wildcards: DataFrame


#: Columns of an import that its scope depends on.
SCOPE = ("path", "language", "line", "module", "names", "aliases", "alias")


def beside(imports: DataFrame, found: DataFrame, *columns: str) -> DataFrame:
    """What imports mean with columns of the imports, which are joined unless they came along."""
    missing = [x for x in columns if x not in found.columns]
    return imports.select("imp", *missing).join(found, "imp") if missing else found


def dealt(rows: DataFrame) -> DataFrame:
    """Few rows that a join turns into very many, dealt out by path: adaptive plans would leave them in one task, as they are small before."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "path")


def bind(imports: DataFrame, resolved: Resolved) -> Bindings:
    """Scopes from imports and what they mean."""
    i = imports.select("imp", *SCOPE)
    t = beside(imports, resolved.single, *SCOPE)
    whole = (c("language") == "python") & (F.size("names") == 0)
    local = F.when(whole, F.coalesce("alias", "module")).when(c("language") == "go", F.coalesce("alias", F.substring_index("module", "/", -1))).otherwise(c("alias"))
    modules = t.select("path", local.alias("local"), c("file").alias("target")).filter("local is not null")
    # what a file has of a folder is made distinct before the folder's files come in; no other import of a Go file means one of them
    go = beside(imports, resolved.folders, *SCOPE).select("path", local.alias("local"), "folder").filter("local is not null").distinct()
    go = dealt(go).join(resolved.sources.distinct(), "folder").select("path", "local", c("file").alias("target"))
    rest = t.filter(~(whole | (c("language") == "go")))
    star = F.array_contains("names", "*") | (c("language").isin("ruby", "c", "cpp") & (F.size("names") == 0))
    wildcards = rest.filter(star).select("path", c("file").alias("target")).distinct()
    back = F.map_from_entries(F.transform(F.map_entries("aliases"), lambda e: F.struct(e["value"], e["key"])))
    of = lambda name: F.coalesce(F.try_element_at(back, name), name)
    named = rest.withColumn("back", back).select("imp", "path", "line", "ord", "file", F.posexplode("names").alias("at", "name"), F.col("back"))
    named = named.filter("name <> '*'").withColumn("local", F.coalesce(F.try_element_at("back", c("name")), c("name")))
    names = named.join(resolved.submodules.select("imp", "name"), ["imp", "name"], "left_anti")
    names = names.select("path", "local", F.struct("line", "imp", "at", "ord").alias("seq"), c("file").alias("target"), c("name").alias("orig"))
    subs = i.filter(~(whole | (c("language") == "go"))).join(resolved.submodules, "imp").select("path", of(c("name")).alias("local"), c("file").alias("target"))
    return Bindings(names, modules.unionByName(subs).distinct().unionByName(go), wildcards)


def bound_names() -> Column:
    """Local names that an import of a package introduces, at most twelve, sorted."""
    entries = F.map_entries("aliases")
    back = F.map_from_entries(F.transform(entries, lambda e: F.struct(e["value"], e["key"])))
    own = F.transform(F.filter("names", lambda n: ~n.isin("*", "default")), lambda n: F.coalesce(F.try_element_at(back, n), n))
    default = F.transform(F.filter(entries, lambda e: e["value"] == "default"), lambda e: e["key"])
    given = F.concat(own, default, F.when(c("alias").isNotNull(), F.array("alias")).otherwise(F.array().cast("array<string>")))
    parts = F.split(F.regexp_replace("module", "^@+", ""), "[./:]")
    plain = F.array(F.when(F.contains("module", F.lit("/")), F.element_at(parts, -1)).otherwise(F.element_at(parts, 1)))
    return F.slice(F.array_sort(F.array_distinct(F.when(F.size(given) > 0, given).otherwise(plain))), 1, 12)


def is_stdlib(language: Column, name: Column) -> Column:
    return F.when(language == "python", name.isin(PY_STDLIB)).when(language.isin(*JS), name.isin(*NODE_BUILTINS)).when(language == "go", ~F.contains(F.substring_index(name, "/", 1), F.lit("."))).otherwise(False)


def external_targets(imports: DataFrame, resolved: Resolved, declared: DataFrame) -> DataFrame:
    """(path, kind, key, label, stdlib, line, bound) of imports that leave the repository: the dependency that a manifest declares
    (declared: seq, ecosystem, name), or else a module. For Go it is the first declared one that is the import or a folder above it."""
    eco = F.create_map(*[F.lit(x) for pair in ECOSYSTEMS.items() for x in pair])
    out = beside(imports, resolved.externals, *SCOPE).withColumn("eco", F.try_element_at(eco, c("language")))
    up = F.split("package", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(up)), lambda n: F.array_join(F.slice(up, F.lit(1), n), "/"))
    asks = out.select("package", "eco").filter("eco is not null").distinct()
    asks = asks.select("package", "eco", F.explode(F.when(c("eco") == "go", prefixes).otherwise(F.array(import_key(c("eco"), c("package"))))).alias("ikey"))
    # of manifests that declare one package the last names it; for Go the first
    named = F.when(c("ecosystem") == "go", -c("seq")).otherwise(c("seq"))
    known = declared.select(c("ecosystem").alias("eco"), import_key(c("ecosystem"), c("name")).alias("ikey"), "name", named.alias("pick")).groupBy("eco", "ikey").agg(F.max("pick").alias("pick"), F.max_by("name", "pick").alias("name"))
    meant = asks.join(known, ["eco", "ikey"]).groupBy("package", "eco").agg(F.max_by("name", "pick").alias("name"))
    out = out.join(meant, ["package", "eco"], "left")
    group = F.coalesce("eco", "language")
    label = F.coalesce("name", "package")
    stdlib = F.when(c("name").isNull(), is_stdlib(c("language"), c("package")))
    return out.select("path", F.when(c("name").isNotNull(), "dependency").otherwise("module").alias("kind"), F.concat(group, F.lit(":"), label).alias("key"), label.alias("label"), stdlib.alias("stdlib"), "line", bound_names().alias("bound"))


#: Each language's rule over whole paths, as far as the projected imports need it.
_RESOLVE_SQL = f"""WITH {cb.FILES_SQL}, {cb.IMPORTS_SQL},
pm AS (SELECT DISTINCT module, concat(replace(module, '.', '/'), tail) AS tail FROM imports, (VALUES ('.py'), ('/__init__.py')) x(tail) WHERE language = 'python' AND level = 0),
pc AS (SELECT module, path, CASE WHEN path = tail THEN '' ELSE left(path, len(path) - len(tail) - 1) END AS root FROM pm JOIN files ON path = tail OR ends_with(path, concat('/', tail))),
pb AS (SELECT module, arg_min(path, struct_pack(a := len(path), b := path)) AS file FROM pc WHERE root = '' OR concat(root, '/__init__.py') NOT IN (SELECT path FROM files) GROUP BY module),
jm AS (SELECT module, string_split(module, '.') AS p FROM (SELECT DISTINCT module FROM imports WHERE language = 'java')),
jc AS (SELECT module, (len(p) - k) * 100 + s AS rank, concat(array_to_string(list_slice(p, s, k), '/'), '.java') AS tail
       FROM (SELECT module, p, k, unnest(range(1, greatest(1, k - 1) + 1)) AS s FROM (SELECT module, p, unnest([len(p), len(p) - 1]) AS k FROM jm))),
jb AS (SELECT module, arg_min(path, struct_pack(a := rank, b := len(path), c := path)) AS file FROM jc JOIN files ON path = tail OR ends_with(path, concat('/', tail)) GROUP BY module),
found AS (
SELECT imp, 0 AS ord, file FROM imports JOIN pb USING (module) WHERE language = 'python' AND level = 0
UNION ALL SELECT imp, o, files.path FROM imports, (VALUES (0, '.py'), (1, '/__init__.py')) x(o, tail), files WHERE imports.language = 'python' AND level = 2 AND files.path = concat(regexp_replace(imports.path, '/[^/]*/[^/]*$', ''), '/', replace(module, '.', '/'), tail)
UNION ALL SELECT imp, 0, file FROM imports JOIN jb USING (module) WHERE language = 'java'
UNION ALL SELECT imp, 0, files.path FROM imports JOIN files ON files.path IN (concat('web/src/', substr(module, 3), '.tsx'), concat('web/src/', substr(module, 3), '/index.tsx')) WHERE imports.language = 'tsx' AND module LIKE '@/%'
UNION ALL SELECT imp, 0, files.path FROM imports JOIN files ON files.path IN (concat('web/src/', substr(module, 4), '.tsx'), concat('web/src/', substr(module, 4), '/index.tsx')) WHERE imports.language = 'tsx' AND module LIKE '../%' AND imports.path NOT LIKE '%/index.tsx'
UNION ALL SELECT imp, 0, files.path FROM imports JOIN files ON files.path LIKE '%.go' AND regexp_replace(files.path, '/[^/]*$', '') = replace(module, 'example.org/', '') WHERE imports.language = 'go'),
subs AS (SELECT imp, name, arg_min(files.path, len(files.path)) AS file FROM imports JOIN found USING (imp) JOIN files ON files.path IN (replace(found.file, '__init__', name), concat(replace(found.file, '__init__.py', name), '/__init__.py'))
         WHERE imports.language = 'python' AND level = 0 AND ends_with(found.file, '/__init__.py') GROUP BY imp, name),
outside AS (SELECT imp, CASE language WHEN 'python' THEN string_split(module, '.')[1] WHEN 'java' THEN array_to_string(string_split(module, '.')[1:2], '.') WHEN 'tsx' THEN '@scope/pkg' ELSE module END AS package
            FROM imports WHERE imp NOT IN (SELECT imp FROM found) AND level = 0 AND module NOT LIKE '@/%' AND module NOT LIKE '../%' AND module NOT LIKE 'example.org/%')"""


def _resolved(t, *carry):
    i, kept = cb.imports(t), Kept(t.spark, "modules")
    resolved = resolve_modules(cb.files(t), i, cb.go_modules(t), kept, carry)
    kept.drop(but="result")
    return i, resolved


@query("c12_module_resolver", f"{_RESOLVE_SQL} SELECT imp, 'file' AS what, ord, file AS target FROM found UNION ALL SELECT imp, 'module', 0, file FROM subs UNION ALL SELECT imp, 'package', 0, package FROM outside")
def c12(t):
    r = _resolved(t)[1]
    row = lambda df, what, ord, target: df.select("imp", F.lit(what).alias("what"), ord.cast("int").alias("ord"), c(target).alias("target"))
    return row(r.targets, "file", c("ord"), "file").unionByName(row(r.submodules, "module", F.lit(0), "file")).unionByName(row(r.externals, "package", F.lit(0), "package"))


@query("c13_bindings", f"""{_RESOLVE_SQL} SELECT DISTINCT 'name' AS scope, path, name AS local, file AS target FROM imports JOIN found USING (imp) WHERE language <> 'go' AND name <> '*' AND (imp, name) NOT IN (SELECT (imp, name) FROM subs)
UNION ALL SELECT DISTINCT 'module', path, split_part(module, '/', -1), file FROM imports JOIN found USING (imp) WHERE language = 'go'
UNION ALL SELECT DISTINCT 'module', path, imports.name, file FROM imports JOIN subs USING (imp)
UNION ALL SELECT DISTINCT 'all', path, NULL, file FROM imports JOIN found USING (imp) WHERE language <> 'go' AND name = '*'""")
def c13(t):
    b = bind(*_resolved(t, *SCOPE))
    row = lambda df, scope, local: df.select(F.lit(scope).alias("scope"), "path", local.alias("local"), "target")
    return row(b.names, "name", c("local")).distinct().unionByName(row(b.modules, "module", c("local"))).unionByName(row(b.wildcards, "all", F.lit(None).cast("string")))


@query("c14_external_targets", f"""{_RESOLVE_SQL}, {cb.DECLARED_SQL},
o AS (SELECT *, CASE language WHEN 'python' THEN 'pypi' WHEN 'tsx' THEN 'npm' WHEN 'go' THEN 'go' END AS eco FROM imports JOIN outside USING (imp)),
k AS (SELECT package, eco, CASE WHEN eco = 'go' THEN arg_min(declared.name, seq) ELSE arg_max(declared.name, seq) END AS dep FROM (SELECT DISTINCT package, eco FROM o) JOIN declared ON ecosystem = eco
      AND CASE eco WHEN 'pypi' THEN lower(regexp_replace(declared.name, '[-_.]+', '_', 'g')) = lower(regexp_replace(package, '[-_.]+', '_', 'g')) WHEN 'npm' THEN declared.name = package ELSE package = declared.name OR starts_with(package, concat(declared.name, '/')) END GROUP BY package, eco)
SELECT path, CASE WHEN dep IS NULL THEN 'module' ELSE 'dependency' END AS kind, concat(coalesce(o.eco, language), ':', coalesce(dep, o.package)) AS key, CASE WHEN dep IS NULL THEN language = 'python' AND o.package = 'json' END AS stdlib, line,
       CASE WHEN name <> '*' THEN name WHEN contains(module, '/') THEN regexp_extract(module, '[^./:]*$') ELSE regexp_extract(module, '^[^./:]*') END AS bound
FROM o LEFT JOIN k ON k.package = o.package AND k.eco = o.eco""")
def c14(t):
    i, r = _resolved(t, *SCOPE)
    return external_targets(i, r, cb.declared(t)).select("path", "kind", "key", "stdlib", "line", F.array_join("bound", ",").alias("bound"))
